"""Quality rules: gradient-boosted trees over document statistics.

Statistics of whole texts go through trees trained here on labelled documents (logistic loss, histogram splits). The trees are
flattened into numpy node arrays, and a batch is scored by stepping all its rows down a tree at once. Features in
``FALLING`` have monotonic constraints: more symbols, repeated lines, repeated windows or capitals never raise a score.

Training takes at most ``train_rows`` labelled rows, those with the smallest hash of doc_id; the bound is a parameter. Of rows that
share a doc_id one text (the smallest) is taken, so that the bound holds whatever is repeated.

Defined cases: null text has no words, statistics 0 and fails the base rule; labels with null doc_id or quality teach nothing;
without labels of both kinds the verdict is the base rule's alone; repeated rows are judged each; texts of any length are counted whole (one text's words are in memory); an empty table
gives an empty result; other columns, of any name, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import spread, trim

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACES = str.maketrans("", "", "\x20\x09\x0a\x0b\x0c\x0d")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "digits", "marks", "distinct", "line_words", "closed_lines", "top_word")
FALLING = ("symbols", "dup_lines", "repeats", "capitals")


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words in windows of ``size`` words that are found twice or more, the first included."""
    n = len(words)
    if n <= size:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    key, base = ids[: n - size + 1].copy(), len(seen)
    distinct = base
    for i in range(1, size):
        if distinct > (1 << 62) // base:  # renumber before a key could overflow
            _, key = np.unique(key, return_inverse=True)
            distinct = int(key.max()) + 1
        key = key * base + ids[i : n - size + 1 + i]
        distinct *= base
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    step[at] += 1
    step[at + size] -= 1
    return int((np.cumsum(step[:n]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(text.translate(_SPACES))
    symbols = len(_SYMBOLS.findall(text))
    seen: set[str] = set()
    dup = full = closed = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            full += 1
            closed += line.rstrip()[-1:] in ".!?\"'"
            if line in seen:
                dup += 1
            seen.add(line)
    again = repeat_words(words)
    letters = max(1, chars)
    capitals = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    digits = len(re.findall(r"[0-9]", text))
    marks = len(re.findall(r"[.,;:!?]", text))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [n, chars, symbols, dup, again], [
        float(np.log1p(n)), chars / max(1, n), symbols / letters, dup / max(1, full), again / max(1, n), capitals / letters, digits / letters,
        marks / letters, len(counts) / max(1, n) ** 0.75, n / max(1, full), closed / max(1, full), max(counts.values(), default=0) / max(1, n),
    ]


class BoostedTrees:
    """Trees as node arrays: feature, threshold, left, right, value; ``roots`` has the first node of each."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 10, falling: tuple[int, ...] = ()):
        self.trees, self.depth, self.rate, self.bins, self.least, self.falling = trees, depth, rate, bins, least, set(falling)
        self.feature: list[int] | np.ndarray = []
        self.threshold: list[float] | np.ndarray = []
        self.left: list[int] | np.ndarray = []
        self.right: list[int] | np.ndarray = []
        self.value: list[float] | np.ndarray = []
        self.roots: list[int] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
            self.roots.append(len(self.feature))
            self._grow(binned, edges, gradient, weight, np.arange(len(y)), 0, -np.inf, np.inf, score)
        for name in ("feature", "threshold", "left", "right", "value"):
            setattr(self, name, np.asarray(getattr(self, name)))
        return self

    def _grow(self, binned, edges, gradient, weight, rows, depth, low, high, score) -> int:
        node = len(self.feature)
        total_g, total_w = gradient[rows].sum(), weight[rows].sum()
        best = (1e-9, None)
        if depth < self.depth and len(rows) >= 2 * self.least:
            for f, e in enumerate(edges):
                size = len(e) + 1
                if size < 2:
                    continue
                b = binned[rows, f]
                g, w, c = (np.cumsum(np.bincount(b, v, size))[:-1] for v in (gradient[rows], weight[rows], np.ones(len(rows))))
                ok = (c >= self.least) & (len(rows) - c >= self.least)
                lv, rv = g / (w + 1), (total_g - g) / (total_w - w + 1)
                if f in self.falling:
                    ok &= lv >= rv
                gain = np.where(ok, g * lv + (total_g - g) * rv - total_g**2 / (total_w + 1), -1.0)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], f, at, float(np.clip(lv[at], low, high)), float(np.clip(rv[at], low, high)))
        value = self.rate * float(np.clip(total_g / (total_w + 1), low, high))
        for a, v in ((self.feature, 0), (self.threshold, np.inf), (self.left, node), (self.right, node), (self.value, value)):
            a.append(v)
        if best[1] is None:
            score[rows] += value
            return node
        _, f, at, lv, rv = best
        self.feature[node], self.threshold[node] = f, float(edges[f][at])
        lows, highs = (low, low), (high, high)
        if f in self.falling:
            middle = (lv + rv) / 2
            lows, highs = (middle, low), (high, middle)
        inside = binned[rows, f] <= at
        self.left[node] = self._grow(binned, edges, gradient, weight, rows[inside], depth + 1, lows[0], highs[0], score)
        self.right[node] = self._grow(binned, edges, gradient, weight, rows[~inside], depth + 1, lows[1], highs[1], score)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; a leaf leads to itself, so every row takes ``depth`` steps."""
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            score += self.value[at]
        return 1 / (1 + np.exp(-score))


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    both = [statistics(text.as_py()) for text in batch.column(1)]
    return np.array([b for b, _ in both], np.int64).reshape(-1, len(_BASE)), np.array([f for _, f in both], np.float64).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 12_000) -> BoostedTrees | None:
    """Trees from labelled documents, or None if the labels are not of both kinds."""
    ship(docs.sparkSession)
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    drawn = marked.orderBy(F.xxhash64("doc_id", F.lit("quality sample")), "doc_id", "quality").select("doc_id", F.col("quality").cast("double").alias("quality")).limit(train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, features = _rows(batch)
            yield pa.RecordBatch.from_arrays([batch.column(2), *[pa.array(c) for c in features.T]], ["quality", *FEATURES])
        trim()

    schema = "quality double, " + ", ".join(f"{f} double" for f in FEATURES)
    plain = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    known = plain.join(F.broadcast(drawn.distinct()), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    known = known.select("doc_id", "text", "quality").mapInArrow(run, schema).toPandas()
    y = (known["quality"].to_numpy() > 0).astype(float)
    if not 0 < y.sum() < len(y):
        return None
    order = np.lexsort(known.to_numpy().T)  # the same trees whatever order the rows came in
    return BoostedTrees(falling=tuple(map(FEATURES.index, FALLING))).fit(known[list(FEATURES)].to_numpy()[order], y[order])


def judge(docs: DataFrame, model: BoostedTrees | None, threshold: float = 0.5) -> DataFrame:
    """The base counts, base_failed, score and kept of every document."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, features = _rows(batch)
            failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
            score = shared.value.predict(features) if shared.value is not None else np.ones(len(base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c) for c in base.T], pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))],
                ["doc_id", *_BASE, "base_failed", "score", "kept"],
            )
        trim()

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _BASE) + ", base_failed boolean, score double, kept boolean"
    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, schema)
