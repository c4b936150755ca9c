"""The pipeline's stages on their own inputs."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import pytest

from tessera.llm import langid, mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    base, docs, out = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        made.write.parquet(str(base / name))
        after = spark.read.parquet(str(base / name))
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(steps):
    assert [n for n, _, _ in steps] == ["language_id", "simhash_near_dedup", "substring_dedup", "source_mix", "byte_bpe"]
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns


def test_decisions(steps):
    by = {n: (b, a) for n, b, a in steps}
    before, after = by["simhash_near_dedup"]
    assert 0 < after.count() < before.count() and after.groupBy("text").count().where("count > 1").count() == 0
    before, after = by["substring_dedup"]
    assert after.count() == before.count()
    words = [r.text.encode().split() for r in before.collect()]
    seen = {}
    for w in words:
        for i in range(len(w) - 34):
            key = tuple(w[i : i + 35])
            seen[key] = seen.get(key, 0) + 1
    left = sum(not any(seen[tuple(w[j : j + 35])] > 1 for j in range(max(0, i - 34), min(i, len(w) - 35) + 1)) for w in words for i in range(len(w)))
    assert sum(len(r.text.encode().split()) for r in after.collect()) == left
    before, after = by["source_mix"]
    size = sum(len(r.text.encode().split()) for r in before.collect())
    assert abs(sum(len(r.text.encode().split()) for r in after.collect()) - 1.5 * size) <= 60
    before, after = by["byte_bpe"]
    assert after.count() == before.count() and after.where("n_tokens <> size(ids)").count() == 0


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps[-1][2].count()


DOCS = "doc_id long, text string, lang string, source string, n_chars int, _copy int, node string, chunk long, n long, row string"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def awkward(spark):
    rng = random.Random(2)
    words = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    passage = " ".join(words[:50])
    texts = [None, "", " \t", "12 34 !", "one", passage, passage, f"{passage} x", f"before it {passage}", " ".join(rng.choice(words) for _ in range(6000)), "two words", "two words"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(25)]
    rows = [(i, t, ("en", "de")[i % 2], ("a", "b", None)[i % 3], 7, 1, "n", 5, 6, "r") for i, t in enumerate(texts)]
    rows += [rows[9], rows[5], (None, passage, None, None, None, 1, "n", 5, 6, "r"), (None, "no id here", "en", "a", 1, 1, "n", 5, 6, "r"), (4, "another text under the same id", "en", "a", 1, 1, "n", 5, 6, "r")]
    return spark.createDataFrame(rows, DOCS)


def component_of(texts):
    """Components of pairs whose sets of five-word shingles are at 0.8 or more, by all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_run_on_awkward_rows(spark, tmp_path):
    """Each stage against brute force on its own input, over nulls, empty and long texts, repeated rows, missing ids and columns of clashing names; run() gives the same."""
    docs = awkward(spark)
    (tmp_path / "sf").mkdir()
    docs.coalesce(1).write.parquet(str(tmp_path / "sf/documents.parquet"))
    docs, steps = spark.read.parquet(str(tmp_path / "sf/documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        steps[name] = (rows_of(docs), rows_of(spark.read.parquet(str(tmp_path / name))))
        assert name == "byte_bpe" or spark.read.parquet(str(tmp_path / name)).columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / name))
    before, after = steps["language_id"]
    model = langid.LanguageModel(langid.learn(spark.read.parquet(str(tmp_path / "sf/documents.parquet"))))
    assert Counter(map(str, after)) == Counter(str(r) for r in before if model.predict([r["text"]])[0][0] != "und") and 0 < len(after) < len(before)
    before, after = steps["simhash_near_dedup"]
    groups = {}
    for r, c in zip(before, component_of([r["text"] for r in before]), strict=True):
        groups.setdefault(c, []).append(r)
    first = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]
    assert Counter((r["doc_id"], r["text"]) for r in after) == Counter((r["doc_id"], r["text"]) for r in first)
    before, after = steps["substring_dedup"]
    seen = Counter(tuple(w[i : i + 35]) for r in before for w in [r["text"].split()] for i in range(len(w) - 34))
    want = Counter()
    for r in before:
        w = r["text"].split()
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        want[r["doc_id"], " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r["text"]] += 1
    assert Counter((r["doc_id"], r["text"]) for r in after) == want
    before, after = steps["source_mix"]
    taken = {}
    for r in rows_of(mixing.mix(spark.read.parquet(str(tmp_path / "substring_dedup")))):
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    got = Counter()
    for r in after:
        got[r["doc_id"]] += len(r["text"].split())
    assert got == +Counter(taken)
    whole = {r["doc_id"]: r["text"] for r in before if r["doc_id"] != 4}
    assert all(whole[r["doc_id"]].startswith(r["text"].split()[0]) for r in after if r["doc_id"] in whole)
    before, after = steps["byte_bpe"]
    assert Counter(hashlib.sha256(r["text"].encode()).hexdigest() for r in before) == Counter(r["decoded_sha256"] for r in after)
    run = corpus_pipeline.run(spark, str(tmp_path / "sf"))
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in rows_of(run)) == Counter((r["doc_id"], r["ids_sha256"]) for r in after)


def test_empty_table(spark, tmp_path):
    awkward(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
