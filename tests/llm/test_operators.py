"""The ten operators against brute force and libraries, on awkward small tables and on whole test tables."""

import base64
import hashlib
import os
import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, common, htmltext, kdtree, langid, layouts, mixing, quality, queries, repeats, simhash, substring, suffix, urlfilter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kind string, chunk long, key string, score double"


def docs_of(spark, texts, first=0):
    """Texts as documents with extra columns whose names clash with the operators' own."""
    rows = [(None if t == "no id" else first + i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, None, "k", 1, "x", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


WORDS = [f"w{i}é" for i in range(60)]


def awkward():
    rng = random.Random(11)
    shared = " ".join(rng.choice(WORDS) for _ in range(50))
    long = " ".join(rng.choice(WORDS) for _ in range(9000))
    texts = [None, "", " \t\n", "one", "no id", "A b C d E", "a B c D e", shared, shared, f"before {shared} after", f"x {shared[40:]} y", long, "z" * 30_000, "word " * 300]
    texts += [long[:5000] + " tail", "é" * 250, "é" * 251, "#### $$$$ | |", "line one\nline one\n\nline two", "\u2003wide\u00a0space\x1cfile"]
    return texts + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 80))) for _ in range(12)]


@pytest.fixture(scope="module")
def texts():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return docs_of(spark, texts).cache()


def rows(df):
    return [r.asDict() for r in df.collect()]


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name]).select(*df.columns)
    assert Counter(map(str, (tuple(r) for r in df.collect()))) == Counter(map(str, rel.fetchall()))


def test_mix(spark, docs):
    got = rows(mixing.mix(docs))
    size = {r["doc_id"]: r["size"] for r in got}
    assert len(got) == docs.count() and size[0] == 0 and size[11] == 9000
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3
    assert sorted(map(str, got)) == sorted(map(str, rows(mixing.mix(docs.repartition(5)))))
    assert mixing.mix(empty(spark)).count() == 0
    unnamed = rows(mixing.mix(docs.withColumn("doc_id", F.lit(None).cast("long"))))
    assert len(unnamed) == len(got) and sum(r["size"] for r in unnamed) == sum(size.values())
    made = mixing.apply_mix(docs)
    assert made.columns == docs.columns
    assert sum(len((r["text"] or "").encode().split()) for r in rows(made)) == sum(r["taken"] for r in got)


def test_apportion_is_highest_quotients(spark):
    rng = random.Random(2)
    for seats in (0, 1, 7, 50):
        weights = [rng.randint(0, 100) for _ in range(9)]
        df = spark.createDataFrame([(1, i, w, seats) for i, w in enumerate(weights)], "g int, i int, w long, seats long")
        got = {r["i"]: r["quota"] for r in rows(mixing.apportion(df, ["g"], "i", "w", "seats"))}
        won = Counter(i for _, i in sorted((-w / (2 * k + 1), i) for i, w in enumerate(weights) if w for k in range(seats + 1))[:seats])
        assert got == {i: won[i] for i in range(9)}


def test_language(spark, docs):
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(held, langid.learn(held)).join(held.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert right / n > 0.97
    small = {r["doc_id"]: r for r in rows(langid.identify(docs, {"en": b" one two three ", "fr": b" un deux trois "}))}
    assert [small[i]["lang_pred"] for i in (0, 1, 2, 3)] == ["und", "und", "und", "en"] and small[17]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in small.values()) and len(small) == docs.count()
    assert {r["lang_pred"] for r in rows(langid.identify(docs, langid.learn(empty(spark))))} == {"und"}
    nameless = held.withColumn("doc_id", F.lit(None).cast("long"))
    assert langid.learn(nameless, docs_per_language=100).keys() == langid.learn(held).keys()  # rows without doc_id are drawn one by one
    kept = langid.keep_identified(docs, {"en": b" one two "})
    assert kept.columns == docs.columns and kept.where("text = 'one'").count() == 1 and kept.where("text IS NULL").count() == 0


def cut(text, taught):
    """Longest-match pieces, by search."""
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in taught:
            size += 1
        at, count = at + size, count + 1
    return count


def test_pieces_are_longest_matches():
    rng = random.Random(4)
    for _ in range(100):
        samples = {n: bytes(rng.choice(b"abc ") for _ in range(rng.randint(1, 40))) for n in "xyz"}
        texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.choice((0, 1, 5, 40)))) for _ in range(rng.choice((1, 30)))]
        model = langid.LanguageModel(samples)
        got = model.pieces([t.translate(model.code) for t in texts])
        for k, name in enumerate(model.names):
            assert got[k].tolist() == [cut(t, samples[name]) for t in texts]
            assert all(langid.SuffixAutomaton(samples[name]).pieces(t) == cut(t, samples[name]) for t in texts)


def test_language_cost_and_score():
    """The fewest pieces, times the bits that name one, win; the score is the distance to the second."""
    rng = random.Random(6)
    samples = {n: langid.normalised(" ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(60))) for n, letters in (("a", "abcd"), ("b", "bcde"), ("c", "çéab"))}
    texts = [" ".join("".join(rng.choice("abcdeçéx") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 40))) + rng.choice(("", "!", " 12 ")) for _ in range(60)]
    names, scores = langid.LanguageModel(samples).predict(texts + [None, "", "12 !"])
    assert names[60:] == ["und"] * 3 and scores[60:] == [0.0] * 3
    for text, name, score in zip(texts, names, scores, strict=False):
        plain = (" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode()
        cost = sorted((cut(plain, s) * np.log2(len(s) + 2), n) for n, s in samples.items())
        assert name == cost[0][1] and abs(score - (1 - cost[0][0] / cost[1][0])) < 1e-12


def test_language_sample_is_whole_texts(spark):
    docs = spark.createDataFrame([(i, f"text{'abc'[i % 3]} " * (3 if i else 9000), "en" if i < 8 else "xx") for i in range(9)], "doc_id long, text string, lang string").where("doc_id % 1000 <> 999")
    learned = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))), sample_bytes=400)
    assert all(len(v) <= 200 for v in learned.values())  # the long text is left out as a whole
    alone = langid.learn(docs.where("doc_id = 0"), sample_bytes=400)
    assert all(v == langid.normalised("texta " * 9000) for v in alone.values())


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/", "http://example.com/EN/", "http://a.example.com/en/1?x#y", "http://example.com", "http://x.net/fr/1",
    "http://x.net/france", "http://x.net?/es/", "https://casino-win.example.org/a", "https://x.org/casino", "ftp://u:p@h.net:80/es/://", "http://notexample.com/en/", "http://spam-farm.example.org", "x://é.net/es/\n/b",
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in rows(urlfilter.filter_urls(pages))}
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    for i, u in enumerate(URLS):
        rest = u.partition("://")[2] if u and "://" in u else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[0] + best[1]), u
        assert got[i]["verdict"] == (best[2] if best else "block" if re.search(r"casino|spam", host) else "allow"), u
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0
    free = urlfilter.UrlRule("any digit", "block", "[0-9]")
    assert urlfilter.filter_urls(pages, (free,)).where("verdict = 'block'").count() == 3


def test_thousands_of_rules(spark):
    """Every rule that fits is found among thousands; each is filed under its rarest token; a rule whose token a URL lacks never runs its expression."""
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "el", "ix", "or")]
    rules = [urlfilter.listed_rule(rng.choice(("allow", "block")), ".".join(rng.sample(words, rng.randint(1, 3))) + rng.choice((".com", ".net")), "/" + "".join(w + "/" for w in rng.sample(words, rng.randint(0, 2)))) for _ in range(3000)]
    rules = list({r.name: r for r in rules}.values())
    urls = [f"http://{'.'.join(rng.sample(words, rng.randint(1, 4)))}{rng.choice(('.com', '.net', '.org'))}/{'/'.join(rng.sample(words, rng.randint(0, 3)))}/" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    broken = urlfilter.UrlRule("broken", "block", "(", ("neverseen",))
    got = {r["page_id"]: r for r in rows(urlfilter.filter_urls(pages, (*rules, broken)))}
    hits = 0
    for i, u in enumerate(urls):
        host, _, path = u.removeprefix("http://").partition("/")
        fit = [r for r in rules if (lambda h, p: (host == h or host.endswith("." + h)) and ("/" + path).startswith("/" + p))(*r.name.split("/", 1))]
        best = max(fit, key=lambda r: (len(r.name), r.name), default=None)
        hits += bool(fit)
        assert (got[i]["rule"], got[i]["verdict"]) == ((best.name, best.action) if best else (None, "allow")), u
    assert hits > 50
    split = pages.select("page_id", urlfilter.host_of(F.col("url")).alias("host"), urlfilter.path_of(F.col("url")).alias("path"))
    counts, seen = urlfilter.token_counts(split, tuple(rules)), Counter(t for u in urls for t in set(re.findall("[a-z0-9]+", u.removeprefix("http://"))))
    assert all(counts[t] == seen[t] for r in rules for t in r.literals)
    buckets, _, _ = urlfilter.rule_index(tuple(rules), counts)
    filed = {e["name"]: e["token"] for b in spark.range(1).select(buckets.alias("b")).first()["b"] for e in b}
    assert all(counts[filed[r.name]] == min(counts[t] for t in r.literals) for r in rules)


def test_bpe(spark, docs, texts):
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path(bpe.VOCABULARY), "rb"))}
    library = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in rows(bpe.encode_documents(docs))}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(("" if t is None else t))
        r = got[None if t == "no id" else i]
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and bpe.decode_ids(ids) == (t or "").encode()
    assert bpe.encode_documents(empty(spark)).count() == 0
    rng, codec = random.Random(8), bpe.encoder()
    for _ in range(200):
        t = "".join(rng.choice("aab \x1c\x85\t\n#é漢x🎉") for _ in range(rng.randint(0, 120)))
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode_ordinary(t)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    vectors += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (600, [1.0, 2.0]), (700, []), (800, []), (None, [0.5] * 6), (900, [1e15] * 6)]
    vectors += [vectors[5], vectors[100]]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, shard int, score int")
    good = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good[i] = [int(np.floor(1024.0 * x)) for x in v]
    want = set()
    good.pop(401, None)
    twice = {5: 2}
    for q in [i for i in good if i % 100 == 0]:
        score = {c: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(good[q], good[c], strict=True)))) for c in good if c != q and len(good[c]) == len(good[q])}
        ranked = [c for c in sorted(score, key=lambda c: (-score[c], c)) for _ in range(twice.get(c, 1))]
        want |= {(q, k + 1, c, score[c]) for k, c in enumerate(ranked[:10])}
    for shard in (64, 1000):
        assert {tuple(r) for r in kdtree.top_k(df, shard_rows=shard, query_block=3).collect()} == want
    assert kdtree.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0]), (100, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in kdtree.top_k(few).orderBy("rank").collect()] == [(100, 1, 2, 4194304), (100, 2, 1, 3145728), (100, 3, 1, 3145728)]


def windows_gone(units, size):
    seen = Counter(tuple(u[i : i + size]) for u in units for i in range(len(u) - size + 1))
    out = []
    for u in units:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - size + 1):
            if seen[tuple(u[i : i + size])] > 1:
                gone[i : i + size] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("window", [5, 35])
def test_substring(spark, docs, texts, window):
    words = [(t or "").encode().split() for t in texts]
    gone = windows_gone(words, window)
    got = {r["doc_id"]: r for r in rows(substring.digest(docs, window))}
    kept = {r["doc_id"]: r for r in rows(substring.remove_repeats(docs, window))}
    for i, (t, w, g) in enumerate(zip(texts, words, gone, strict=True)):
        key = None if t == "no id" else i
        left = b" ".join(x for x, gone_ in zip(w, g, strict=True) if not gone_)
        assert (got[key]["n_words"], got[key]["n_removed"], got[key]["kept_sha256"]) == (len(w), int(g.sum()), hashlib.sha256(left).hexdigest()), t
        assert kept[key]["text"] == (left.decode() if g.any() else t)
    assert substring.digest(empty(spark)).count() == 0


@pytest.mark.parametrize(("length", "gram"), [(12, 4), (200, 32)])
def test_suffix(spark, docs, texts, length, gram):
    raw = [(t or "").encode() for t in texts]
    gone = windows_gone(raw, length)
    got = {r["doc_id"]: r for r in rows(suffix.digest(docs, length, gram))}
    for i, (t, b, g) in enumerate(zip(texts, raw, gone, strict=True)):
        r = got[None if t == "no id" else i]
        left = bytes(np.frombuffer(b, np.uint8)[~g]) if b else b""
        runs = int((np.diff(g.astype(int), prepend=0) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(g.sum()), runs, hashlib.sha256(left).hexdigest()), t
    assert suffix.digest(empty(spark)).count() == 0


def lattice(size, low, high):
    """Two strings that agree under polynomial hashes modulo 2**64 with any odd base: their difference is a product of (x**(2**i) - 1)."""
    sign = np.array([1], np.int64)
    while len(sign) < size:
        sign = np.concatenate((-sign, sign))
    return ["".join(low if (s < 0) == flip else high for s in sign[:size]) for flip in (True, False)]


def test_colliding_texts(spark):
    """Texts whose hashes modulo 2**64 agree are still told apart."""
    a, b = lattice(4096, "a", "b")
    both = [np.frombuffer(x.encode(), np.uint8).astype(np.uint64) for x in (a, b)]
    assert a != b and (repeats.Prefix(both[0]).rolling(4096) == repeats.Prefix(both[1]).rolling(4096)).all()
    texts = ["x" * 10 + a[:1024] + "y" * 190, "z" * 10 + b[:1024] + "y" * 190, f"{a} tail one", f"{b} tail two", "q" + a[:1024] + "r", "s" + b[:1024] + "t"]
    docs = docs_of(spark, texts)
    for got, gone in ((rows(suffix.digest(docs)), windows_gone([t.encode() for t in texts], 200)),):
        assert {r["doc_id"]: r["n_removed"] for r in got} == {i: int(g.sum()) for i, g in enumerate(gone)}
    words = [[f"w{i}" for i in range(17)] + [x] + [f"v{i}" for i in range(17)] for x in (a, b)]
    assert [r["n_removed"] for r in rows(substring.digest(docs_of(spark, [" ".join(w) for w in words])))] == [0, 0]
    key = repeats.Key()
    one, two = ([(h := substring.Words(list(substring.pieces([" ".join(w).encode()], 35))[0], key)).windows(np.array([0]), 35)] for w in words)
    assert one[0][0] != two[0][0]


def test_sort_is_verified_and_decides():
    """A sort that hash collisions mislead is noticed on the bytes; without the right order the repeats are wrong."""
    rng = random.Random(9)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)), np.uint8)
    start = np.arange(0, 2900, 3)
    size = np.minimum(60, len(data) - start)
    order, common = suffix.sorted_suffixes(data, start, size, 60)
    strings = [data[s : s + z].tobytes() for s, z in zip(start, size, strict=True)]
    assert [strings[i] for i in order] == sorted(strings)
    assert all(c == len(os.path.commonprefix([strings[i], strings[j]])) for c, i, j in zip(common[1:], order[1:], order, strict=False))
    _, right = suffix.neighbours(data, start, size, np.arange(len(start)), 60)
    assert not right
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in lattice(4096, "a", "b"))
    both = np.concatenate((a, a[:10], b))  # the hashes of a and b agree
    order, common = suffix.sorted_suffixes(both, np.array([0, 4106]), np.array([4096, 4096]), 4096)
    assert common[1] == 0 and both[np.array([0, 4106])[order]].tolist() == [97, 98]


def strings_of(span, length):
    left, right, body, _ = span
    return {d: body[left - d : left - d + length] for d in range(max(0, length - right), left + 1)}


def test_repeated_spans():
    """The two sorted sides of a bucket give the strings that occur twice, by brute force over all strings."""
    rng = random.Random(1)
    for _ in range(150):
        (length, gram), letters = rng.choice(((12, 4), (20, 5), (8, 8))), rng.choice((b"ab", b"abc\xff"))
        grams, spans = [bytes(rng.choice(letters) for _ in range(gram)) for _ in range(2)], {}
        for _ in range(rng.randint(1, 12)):
            left = rng.randint(0, length - gram)
            right = rng.randint(max(gram, length - left), length)
            body = bytes(rng.choice(letters) for _ in range(left)) + rng.choice(grams) + bytes(rng.choice(letters) for _ in range(right - gram))
            spans[left, body] = (left, right, body, rng.choice((1, 1, 1, 2)))
        spans = list(spans.values())
        got = suffix.repeated(np.frombuffer(b"".join(x[2] for x in spans), np.uint8), *(np.array([x[i] for x in spans]) for i in (0, 1, 3)), length, gram)
        seen = Counter()
        for x in spans:
            for place in strings_of(x, length).items():
                seen[place] += x[3]
        for row, x in zip(got, spans, strict=True):
            assert set(np.flatnonzero(row).tolist()) == {d for d, t in strings_of(x, length).items() if seen[d, t] > 1}


def test_hot_grams_and_collapsed_rows(spark, docs, texts):
    """Grams above the limit go another way to the same result; rows that repeat more often than COPIES are collapsed and come back."""
    want = sorted(map(str, rows(suffix.digest(docs, 12, 4))))
    assert sorted(map(str, rows(suffix.digest(docs, 12, 4, hot=2)))) == want == sorted(map(str, rows(suffix.digest(docs, 12, 4, hot=5))))
    words = " ".join(f"u{i}" for i in range(40))
    one = spark.createDataFrame([(None, words, "en", "s", 7, "k", 1, "x", 0.5), (3, "short text here", "en", "s", 7, "k", 1, "x", 0.5)], DOCS)
    many = one.crossJoin(spark.range(repeats.COPIES + 5).select(F.col("id").alias("_i"))).drop("_i").unionByName(docs_of(spark, [f"a {words} b", "alone"]))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in rows(substring.digest(many)))
    assert got == {(None, 40, 40): repeats.COPIES + 5, (3, 3, 0): repeats.COPIES + 5, (0, 42, 40): 1, (1, 1, 0): 1}
    kept = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in rows(substring.remove_repeats(many)))
    assert kept == {(None, "", 0): repeats.COPIES + 5, (3, "short text here", 15): repeats.COPIES + 5, (0, "a b", 3): 1, (1, "alone", 5): 1}
    got = Counter((r["doc_id"], r["n_bytes"] - r["n_removed"]) for r in rows(suffix.digest(many, 40, 8)))
    assert got == {(None, 0): repeats.COPIES + 5, (3, 15): repeats.COPIES + 5, (0, 4): 1, (1, 5): 1}


def test_long_texts_in_pieces(monkeypatch):
    """Pieces hold each window, and each string of bytes, once."""
    rng = random.Random(5)
    texts = [b" ".join(rng.choice((b"a", b"bb", b"ccc", b"d" * 60)) for _ in range(n)) for n in (0, 1, 3, 200, 40)] + [b" " * 300 + b"x" * 500 + b" y"]
    monkeypatch.setattr(substring, "PIECE", 50)
    monkeypatch.setattr(suffix, "PIECE", 64)
    seen, whole = Counter(), Counter()
    for doc, t in enumerate(texts):
        w = t.split()
        whole.update((doc, i, tuple(w[i : i + 5])) for i in range(len(w) - 4))
    for of in substring.pieces(texts, 5):
        words = substring.Words(of, repeats.Key())
        flat = [x for p in of for x in p.words]
        seen.update((of[words.piece[i]].doc, int(words.place[i]), tuple(flat[i : i + 5])) for i in np.flatnonzero(words.whole(5)))
    assert seen == whole
    none = pa.table({"keys": pa.array([], "binary"), "kind": pa.array([], "int32")})
    back = {i: [] for i in range(len(texts))}
    for doc, own, keep in substring.kept_words(texts, none, 5, 8, repeats.Key()):
        back[doc] += own
        assert keep.all()
    assert [back[i] for i in range(len(texts))] == [t.split() for t in texts]
    found = Counter()
    for of in suffix.pieces(texts, 12):
        spans = suffix.Spans(of, 12, 4)
        for f, last in zip(spans.first.tolist(), spans.last.tolist(), strict=True):
            for i in range(f, last + 1):
                p = int(np.searchsorted(spans.ends, i, side="right"))
                found[of[p].doc, of[p].first + i - int(spans.starts[p])] += 1
    assert found == Counter((d, i) for d, t in enumerate(texts) for i in range(len(t) - 11))


def test_suffix_sort():
    rng = random.Random(3)
    for _ in range(150):
        d = bytes(rng.choice(b"ab\x00c"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 200)))
        start = np.array([rng.randrange(len(d)) for _ in range(rng.randint(1, 50))])
        size = np.array([rng.randint(0, len(d) - s) for s in start])
        data = np.frombuffer(d, np.uint8)
        order = suffix.suffix_sort(repeats.Prefix(data.astype(np.uint64) + np.uint64(1)), data, start, size)
        sorted_ = [d[start[i] : start[i] + size[i]] for i in order]
        assert sorted_ == sorted(sorted_)


def repeated(words):
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)})


def test_quality(spark, docs, texts):
    got = {r["doc_id"]: r for r in rows(quality.judge(docs, None))}
    for i, t in enumerate(texts):
        r, t = got[None if t == "no id" else i], "" if t is None else t
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.add(line)
        n, again = len(words), repeated(words)
        assert [r[c] for c in quality._BASE] == [n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, again], t
        assert r["base_failed"] == (n < 10 or 100 * again > 20 * n) and r["kept"] == (not r["base_failed"])
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(d, labels.where("doc_id % 2 = 0"))
    judged = quality.judge(d, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed")
    right, n = judged.agg(F.count_if(F.col("kept") == (F.col("quality") == 1)), F.count(F.lit(1))).first()
    assert right / n > 0.97
    again = quality.train(d.where("doc_id % 8 = 0").unionByName(d.where("doc_id % 8 = 0")), labels.unionByName(labels))
    once = quality.train(d.where("doc_id % 8 = 0"), labels)
    assert again.roots == once.roots and np.array_equal(again.value, once.value)
    assert quality.train(d, labels.limit(0)) is None and quality.judge(empty(spark), model).count() == 0


def test_quality_query_by_walking_trees(spark):
    """The registered query's verdicts, text by text and node by node."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in rows(queries.QUERIES["op7_quality_rules"](spark, SF))}
    assert len(got) == docs.count()
    for r in rows(docs):
        base, features = quality.statistics(r["text"])
        score = model.start
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if features[model.feature[node]] <= model.threshold[node] else model.right[node]
            score += model.value[node]
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        assert (got[r["doc_id"]]["base_failed"], got[r["doc_id"]]["kept"]) == (failed, not failed and score >= 0), r["doc_id"]


def test_trees_are_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * rng.random(2000) < 0.6).astype(float)
    model = quality.BoostedTrees(falling=(0,)).fit(x, y)
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.4), np.full(200, 0.6)], 1)
    assert (np.diff(model.predict(grid)) <= 1e-12).all()
    assert ((model.predict(x) > 0.5) == (y > 0)).mean() > 0.85


PAGE = """<html><head><title>T &amp; U</title><style>p{}</style></head><body><div class="cookie-notice">We set cookies</div><nav><a href=/>Home</a></nav><header>Site</header>
<article><h1>Head &eacute;</h1><p>First  <b>bold</b>
words of a paragraph<br>after break.<div class="ad">Buy!</div><p>Second &lt;one&gt; <a href="x">linked</a> here.<ul><li>Point</li></ul><form><button>Go</button></form></article>
<section id="comments"><p>Nice post, thanks a lot for it</p></section><aside>More</aside><footer>(c) me</footer><script>var a="<p>no</p>";</script></body></html>"""


def made_of(page):
    """Markup, words of the main text and words of all text of a labelled page."""
    words = lambda parts: " ".join(htmltext.html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"<(script|style|title)\b.*?</\1>", " ", m))) for m in parts).split()
    return "".join(m for m, _ in page), words(m for m, main in page if main), words(m for m, _ in page)


def test_html_on_labelled_pages():
    """Held-out labelled pages: main text found, other text left out; with the scan switched off the text is worse."""
    right = Counter()
    for page in layouts.labelled_pages(100, seed=5):
        markup, want, every = made_of(page)
        want, every = Counter(want), Counter(every)
        for name, scan in (("scan", htmltext.region), ("off", lambda s: (0, len(s)))):
            got = Counter(re.sub(r"([a-z])\b([.?!])", r"\1\2", htmltext.extract(markup, scan=scan)).split())
            right[name, "stray"] += sum(((got & every) - want).values())
        right["lost"] += sum((want - Counter(htmltext.extract(markup).split())).values())
        right["main"] += sum(want.values())
    assert right["lost"] < 0.05 * right["main"] and right["scan", "stray"] < 0.05 * right["main"]
    assert right["scan", "stray"] < 0.9 * right["off", "stray"]
    stray = "<html><body><p>Read on.</p><article><h1>A title</h1><p>The text is here, and it is longer than that.</p></article><p>Read on.</p></body></html>"
    assert htmltext.extract(stray) == "A title\n\nThe text is here, and it is longer than that." != htmltext.extract(stray, scan=lambda s: (0, len(s)))


@pytest.mark.parametrize("wrapper", ["article", "div", "main"])
def test_html_by_place_not_by_name(wrapper):
    text = "word " * 59 + "word."
    parted = htmltext.extract(f"<html><body><{wrapper}><p>{text}</p><aside><p>{'side ' * 400}</p></aside><p>{text}</p></{wrapper}></body></html>")
    assert len(parted.split()) == 120
    unmarked = f"<html><body><div><a>Home</a> <a>About</a> <a>Contact</a></div><{wrapper}><h1>A title</h1><p>{text}</p></{wrapper}><div>Copyright 2024 Example Ltd. All rights reserved.</div></body></html>"
    assert htmltext.extract(unmarked) == f"A title\n\n{text}"
    for name in ("section-header", "side-by-side", "related-work", "menu-items", "rail-transport"):
        assert "Some words" in htmltext.extract(f"<nav><a>Home</a></nav><{wrapper}><h1>The title</h1><div class='{name}'><p>Some words of this part here.</p></div><p>{text}</p></{wrapper}>")


def test_html(spark):
    want = "Head é\n\nFirst bold words of a paragraph after break.\n\nSecond <one> linked here.\n\nPoint"
    assert htmltext.extract(PAGE) == want
    odd = """<main><p title=it's data-x="a > b" lang='d > e'>First part.</p><p class="open>Second part.</p><p>Third part.</p></main>"""
    assert htmltext.extract(odd) == "First part.\n\nSecond part.\n\nThird part."
    assert htmltext.extract("<a =\"x\" " * 5000) is not None  # no end of a tag: linear, not by all ways to read the quotes
    pages = spark.createDataFrame([(1, "u", PAGE, 9), (2, None, None, 9), (3, "u", "", 9), (4, "u", "<script>x", 9), (5, "u", "plain words only", 9), (None, "u", "<!-- <p>x", 9)], "page_id long, url string, html string, n_chars int")
    got = {r["page_id"]: r for r in rows(htmltext.extract_pages(pages))}
    assert [got[i]["text"] for i in (1, 2, 3, 4, 5, None)] == [want, "", "", "", "plain words only", ""] and got[1]["n_chars"] == len(want)
    real = {r["page_id"]: r["html"] for r in rows(spark.read.parquet(f"{SF}/pages.parquet"))}
    for r in rows(htmltext.extract_pages(spark.read.parquet(f"{SF}/pages.parquet"))):
        body = re.search(r"<article>(.*)</article>", real[r["page_id"]], re.S)[1]
        blocks = [" ".join(htmltext.html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("boiler", ["<div class='share'>{}</div>", "<nav><ul>{}</ul></nav>", "<aside><p>{}</p><p>{}</p></aside>"])
@pytest.mark.parametrize("name", ["article", "main"])
def test_html_keeps_text_around_long_boilerplate(boiler, name):
    long = boiler.replace("{}", "<li><a href='/x'>one of many links</a></li>" * 60)
    page = f"<html><body><nav>Home</nav><{name}><h1>A title of five words</h1>{long}<p>The first paragraph of the text itself.</p>{long}<p>A closing word.</p></{name}><footer>{'imprint ' * 60}</footer><p>Stray.</p></body></html>"
    assert htmltext.extract(page) == "A title of five words\n\nThe first paragraph of the text itself.\n\nA closing word."
    outside = f"<body><aside><{name}>{'related words ' * 30}</{name}></aside><p>Stray.</p>{long}<{name}><p>The text has more words than that.</p></{name}></body>"
    assert htmltext.extract(outside) == "The text has more words than that."


def test_golay_keys():
    """Words at distance 2 or less share a key, over all cosets."""
    every = [sum(1 << i for i in c) for w in range(4) for c in combinations(range(23), w)]
    near = [0] + [sum(1 << i for i in c) for w in (1, 2) for c in combinations(range(23), w)]
    words = np.array(every, np.int64)
    own, n = simhash.golay().keys(words)
    assert len(every) == 2048 and set(n.tolist()) == {1, 6}
    for e in near:
        other, _ = simhash.golay().keys(words ^ e)
        assert (own[:, :, None] == other[:, None, :]).any((1, 2)).all()


def test_simhash(spark, docs, texts):
    near = docs_of(spark, ["".join(f"{a} " for a in WORDS) * 20 + f"end{i}" for i in range(40)] + ["", None, "same text here", "Same TEXT here"], first=1000)
    both = docs.unionByName(near).unionByName(near.limit(1))
    got = rows(simhash.near_duplicates(both))
    assert len(got) == both.count()
    fp = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    ids = sorted(i for i in fp if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(ids, 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert all(r["component_id"] == find(r["doc_id"]) for r in got if r["doc_id"] is not None)
    assert fp[0] == fp[1] == 0 and fp[1042] == fp[1043] != 0
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(both)
    assert kept.columns == both.columns and kept.where("doc_id = 1043").count() == 0 and kept.where("doc_id IS NULL").count() == 1


def test_keep_one_by_row(spark):
    """Decisions are for rows: another text under a removed doc_id stays, copies without doc_id go, of full repeats one stays; columns of any name stay."""
    long = " ".join(f"w{i}" for i in range(60))
    made = [(1, long), (2, long), (2, "quite another text that has nothing to do with it"), (None, long), (None, "no id, alone"), (None, "no id, alone"), (5, "five"), (5, "five"), (6, None), (7, "")]
    df = spark.createDataFrame([(i, t, 9, "n") for i, t in made], "doc_id long, text string, _copy int, node string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    want = {(1, long), (2, made[2][1]), (None, "no id, alone"), (5, "five"), (6, None)}
    assert Counter((r["doc_id"], r["text"]) for r in rows(got)) == Counter(want)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_scratch_is_refused_where_nothing_is_shared(spark):
    class Conf:
        def get(self, *_):
            return None

    class Elsewhere:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getConf": lambda self: Conf()})()

    with pytest.raises(RuntimeError):
        common.Scratch(Elsewhere(), "x")
    mark = common.made()
    table = common.Scratch(spark, "x").table(spark.range(3), "t")
    assert table.count() == 3 and common.made() == mark + 1
    common.release(spark, mark)
    assert common.made() == mark


def test_wide_keys_find_the_same_links(spark):
    """Long keys are shared by all pairs at 4 or fewer bits, and give the components of the short ones."""
    rng = random.Random(3)
    for _ in range(300):
        fp = rng.getrandbits(64)
        other = fp
        for b in rng.sample(range(64), rng.randint(0, 4)):
            other ^= 1 << b
        keys, owners = simhash.wide_keys(np.array([fp, other], np.uint64))
        assert set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist())
    near = docs_of(spark, [" ".join(rng.choice(WORDS[:9]) for _ in range(30)) for _ in range(60)] + ["".join(f"{a} " for a in WORDS) * 20 + f"end{i}" for i in range(40)])
    assert sorted(map(str, rows(simhash.near_duplicates(near, wide=True)))) == sorted(map(str, rows(simhash.near_duplicates(near, wide=False))))


def test_large_buckets_of_spans_in_bounded_memory(monkeypatch):
    """A bucket is sorted in parts: the answers are those of the whole, and the memory does not grow with some 60 times the bucket."""
    import tracemalloc

    rng = np.random.default_rng(4)
    once = rng.integers(97, 123, 2_600_000, np.uint8).tobytes()
    sent = []
    for chunk, text in enumerate((once, b"-" + once[:2_000_000], rng.integers(97, 123, 1_000_000, np.uint8).tobytes() + once[:5000])):
        spans = suffix.Spans([suffix.Piece(0, 0, text)], 200, 32)
        sent.append(suffix._sent(chunk, 8, spans, 0, np.arange(len(spans.keys)), np.ones(len(spans.keys), np.int64)))
    bucket = pa.concat_tables(sent)
    size = sum(len(x.as_py()) for x in bucket["body"])
    tracemalloc.start()
    got = suffix._found(bucket, 200, 32)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert size > 15_000_000 and most < 10 * size
    monkeypatch.setattr(suffix, "PART", 1 << 40)
    whole = suffix._found(bucket, 200, 32)
    assert got.num_rows > 256 and sorted(map(str, got.to_pylist())) == sorted(map(str, whole.to_pylist()))


def test_links_far_apart_are_not_lost():
    """A forest has the components of all links, also in a chain where each fingerprint is near its neighbours only."""
    fps = np.array([(1 << (4 * k)) - 1 for k in range(17)], np.uint64)
    left, right = simhash._forest(fps, 4)
    assert sum(map(len, left)) == 16 == sum(map(len, right))


def similar(a, b):
    a, b = (set(zip(*[t.lower().encode().split()[i:] for i in range(5)], strict=False)) for t in (a, b))
    return 5 * len(a & b) >= 4 * len(a | b)


def test_near_copies_at_similarity(spark):
    """keep_one has the components of all pairs at a 5-shingle similarity of 0.8 or more, among them pairs far above four bits."""
    rng = random.Random(5)
    texts = []
    for _ in range(30):
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(40, 300))]
        texts.append(" ".join(words))
        for changed in (0.01, 0.02, 0.04):
            texts.append(" ".join(w if rng.random() > changed else "other" for w in words))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    far = 0
    for i, j in combinations(range(len(texts)), 2):
        if similar(texts[i], texts[j]):
            far += (simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[j], 5)).bit_count() > 4
            x, y = sorted((find(i), find(j)))
            root[y] = x
    kept = sorted(r["doc_id"] for r in rows(simhash.keep_one(docs_of(spark, texts))))
    assert far > 10 and kept == [i for i in range(len(texts)) if find(i) == i]


def test_near_copies_by_fingerprints(spark, monkeypatch):
    """The SimHash step alone, without bands of min-hashes, finds all similar pairs at 4 or fewer bits; the sets decide on them."""
    monkeypatch.setattr(simhash, "similar_links", lambda docs, nodes, *rest, of=simhash.similar_links: of(docs, nodes.withColumn("keys", F.array().cast("array<long>")), *rest))
    rng = random.Random(6)
    texts = [" ".join(f"v{rng.randrange(5000)}" for _ in range(400)) for _ in range(12)]
    texts += [f"{t} end" for t in texts] + ["a b c d e f", "a b c d e f g h"]
    near = {i: (simhash.majority(np.unique(simhash.shingle_hashes(texts[i], 5))) ^ simhash.majority(np.unique(simhash.shingle_hashes(texts[i + 12], 5)))).bit_count() <= 4 for i in range(12)}
    kept = {r["doc_id"] for r in rows(simhash.keep_one(docs_of(spark, texts)))}
    assert sum(near.values()) > 8 and all(i in kept and (i + 12 in kept) != near[i] for i in range(12)) and {24, 25} <= kept
