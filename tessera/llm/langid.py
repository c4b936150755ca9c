"""Language identification by cross-parsing entropy.

A text becomes its letters in lower case, one space for all between, as UTF-8 bytes. Labelled text of each language makes a suffix automaton of such
bytes. A whole text is parsed from its first byte to its last into the longest pieces that occur in the labelled text, across words; fewer pieces mean a
better fit. A text's cost in a language is pieces * log2(size of the language's text) / bytes, the usual estimate of cross entropy from
cross-parsing; the language with the lowest cost wins, ties to the smaller name. The score is 1 - lowest / second lowest.

The automata are laid out as one table of transitions, in which a missing transition leads on from the root and counts a piece. The texts of a batch are parsed side by
side, a byte of each in a step; the last few long ones go on by themselves.

Learning takes a bounded sample of labelled rows, whole texts only: the languages with the most rows (``languages`` at most), about ``docs_per_language`` rows of
each, drawn by a hash of doc_id (or of the text where that is null; repeated rows count once), in drawn order as far as ``sample_bytes`` in
all go, shared equally by the languages; a text that does not fit any more is left out as a whole, but of each language the smallest drawn one is
taken. These bounds are parameters. Predictions parse whole texts and use the text alone.

Defined cases: null text, and text without a letter, is ``und`` with score 0; so is every text if nothing can be learned; with a
single learned language the score is 1; documents without doc_id count as not held out; null lang teaches nothing; repeated
rows are predicted each; texts of any length are parsed whole (a batch's bytes are in memory); an empty table gives an empty result; other columns, of any name, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import spread, trim, worker_state

_LETTERS = regex.compile(r"\p{L}+")
_DRAWS = 1 << 48
_ALONE = 12  # texts that are left when the rest of a batch is parsed one by one


def normalised(text: str | None) -> bytes:
    """The letters of a text, words between single spaces; empty without a letter."""
    words = _LETTERS.findall((text or "").lower())
    return f" {' '.join(words)} ".encode() if words else b""


class SuffixAutomaton:
    """The smallest automaton of all substrings of a text (of bytes or characters)."""

    def __init__(self, text: bytes):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = copy
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
            last = new

    def pieces(self, text: bytes) -> int:
        """Longest-match pieces of ``text``; a byte that never occurs is one piece."""
        states, state, count = self.next, 0, 0
        for c in text:
            to = states[state].get(c)
            if to is None:
                count += 1
                to = states[0].get(c)
                if to is None:
                    count += state > 0
                    state = 0
                    continue
                count -= state == 0
            state = to
        return count + (state > 0)


class LanguageModel:
    """The automata of all languages as one table: row of a state + code of a byte -> next row * 4 + pieces that end."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        self.bits = np.array([math.log2(len(samples[x]) + 2) for x in self.names])
        used = sorted(set(b"".join(samples.values())))
        self.code = bytes((used.index(b) + 1 if b in used else 0) for b in range(256))
        width, parts, self.roots, at = len(used) + 1, [], [], 0
        for name in self.names:
            states = SuffixAutomaton(samples[name].translate(self.code)).next
            root, part = at * width, np.zeros((len(states), width), np.int64)
            part[:] = root << 2 | 2  # a byte unknown to the language: the piece before it ends, and it is one
            for c, to in states[0].items():
                part[:, c] = (at + to) * width << 2 | 1  # from a state without this transition: a piece ends, the next begins
            part[0] -= 1
            for state, to in enumerate(states):
                for c, t in to.items():
                    part[state, c] = (at + t) * width << 2
            parts.append(part.astype(np.int32) if int(part.max()) < 2**31 else part)
            self.roots.append(root)
            at += len(states)
        self.table = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int32)

    def pieces(self, texts: list[bytes]) -> np.ndarray:
        """Pieces of each text (as codes) in each language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = (np.cumsum(sizes) - sizes)[order]
        left, n, step = sizes[order], int((sizes > 0).sum()), 0
        rows = np.repeat(np.array(self.roots, self.table.dtype)[:, None], n, 1)
        count = np.zeros((len(self.roots), len(texts)), np.int64)
        here = np.zeros_like(rows, np.int64)
        while n > _ALONE:
            stop = int(left[n - 1])  # until the shortest one ends
            place, now, sums = at[:n] + step, np.ascontiguousarray(rows[:, :n]), np.zeros((len(self.roots), n), np.int64)
            for _ in range(step, stop):
                found = self.table.take(now + data[place])
                sums += found & 3
                now = found >> 2
                place += 1
            here[:, :n] += sums
            rows[:, :n], step = now, stop
            n = int(np.searchsorted(-left, -stop, side="left"))
        for i in range(n):
            rest = data[at[i] + step : at[i] + left[i]].tobytes()
            for k in range(len(self.roots)):
                row, sum_, table = int(rows[k, i]), 0, self.scalar
                for c in rest:
                    found = table[row + c]
                    sum_ += found & 3
                    row = found >> 2
                here[k, i] += sum_
                rows[k, i] = row
        here += rows != np.array(self.roots, self.table.dtype)[:, None]  # the last piece
        count[:, order[: here.shape[1]]] = here
        return count

    @property
    def scalar(self) -> memoryview:
        return memoryview(self.table)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        plain = [normalised(t) for t in texts]
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        cost = self.pieces([t.translate(self.code) for t in plain]) * self.bits[:, None]
        best = cost.argmin(0)
        low, second = cost.min(0), np.partition(cost, 1, 0)[1] if len(self.names) > 1 else None
        score = np.ones(len(texts)) if second is None else np.clip(1 - low / np.maximum(second, 1e-300), 0, 1)
        return [self.names[b] if t else "und" for b, t in zip(best.tolist(), plain, strict=True)], [s if t else 0.0 for s, t in zip(score.tolist(), plain, strict=True)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, languages: int = 64, docs_per_language: int = 100, sample_bytes: int = 320_000) -> dict[str, bytes]:
    """Normalised text of each language from documents that are not held out."""
    taught = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = taught.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages).collect()
    if not most:
        return {}
    budget = sample_bytes // len(most)
    share = F.element_at(F.create_map(*[F.lit(x) for r in most for x in (r["lang"], min(1.0, docs_per_language / r["n"]))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), F.lit("language sample")), F.lit(_DRAWS))
    drawn = taught.where(F.col("lang").isin([r["lang"] for r in most])).select("lang", "text", draw.alias("draw"), F.octet_length("text").alias("size")).where(F.col("draw") < share * _DRAWS).distinct()
    smallest = F.row_number().over(Window.partitionBy("lang").orderBy("size", "draw", "text"))
    rows = drawn.withColumn("place", smallest).where((F.col("size") <= budget) | (F.col("place") == 1)).collect()
    samples: dict[str, list[bytes]] = {}
    room = {r["lang"]: budget for r in most}
    for row in sorted(rows, key=lambda r: (r["lang"], r["place"] > 1, r["draw"], r["text"])):
        text = normalised(row["text"])
        if text and (len(text) <= room[row["lang"]] or row["lang"] not in samples):
            room[row["lang"]] -= len(text)
            samples.setdefault(row["lang"], []).append(text)
    return {k: b"".join(v).replace(b"  ", b" ") for k, v in samples.items()}


def model_of(samples: dict[str, bytes]) -> LanguageModel:
    return worker_state(("langid", tuple(sorted(samples.items()))), lambda: LanguageModel(samples))


def identify(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document. The samples (bounded by learn()) are broadcast; workers build the automata."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for batch in batches:
            names, scores = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        trim()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return spread(plain).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, samples: dict[str, bytes], languages: list[str] | None = None) -> DataFrame:
    """The documents in a learned language (one of ``languages``, if given), all columns kept; ``und`` goes."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    allowed = set(languages) if languages is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            names, _ = model.predict([None if x is None else str(x) for x in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([x != "und" and (allowed is None or x in allowed) for x in names], pa.bool_()))
        trim()

    return spread(docs).mapInArrow(run, docs.schema)
