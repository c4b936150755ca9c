"""Substring dedup by fixed-block anchors.

A window is ``window`` consecutive words of one document; a word goes if a window over it starts anywhere else too. Blocks of half a
window (rounded up) are cut at fixed places from each document's start, so that every window holds a whole block.

1. Index and probe. Each document's blocks are the index; every rolling stretch of block length, of all documents, is a probe.
   A block is an anchor if its words are probed twice or more (once by itself). Probes are counted by the exchange of repeats.py.
2. Extend. Each hit is extended word by word to both sides as far as windows around the anchor occur elsewhere: all windows that hold
   an anchor are compared with all others of their kind, and runs of repeated windows make the maximal exact repeats. Both copies
   of a repeated window hold an anchor: each holds a block of its own document, whose words the other copy holds too.
3. Remove. Words under repeated windows go.

Words are told apart by 128-bit BLAKE2b with a salt drawn for each run, windows by 93 bits of two polynomials modulo 2**61 - 1 over the two halves
of these, with bases drawn for each run: no text can be made that collides. Nothing depends on how often a
passage occurs: a chunk of documents sends and gets each key once.

Defined cases: null text has no words; texts shorter than a window lose nothing; repeated rows are copies of each other, so all lose
their repeated windows (rows that repeat very often are collapsed, see repeats.py); texts of any length are cut into pieces of ``PIECE`` bytes that
share ``window`` - 1 words, so that hashes of one piece are in memory; an empty table gives an empty result; other columns, of any name, are
kept by remove_repeats() and ignored by the query.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import ship
from .common import WORD, Scratch
from .repeats import MESSAGE, Chunks, Key, Prefix, Prefix61, answered, bucket_bits, chunk_of, exchange, frugal, member, messages, mix, narrow, short_key, texts_of, with_answers

WINDOW = 35
PIECE = 4_000_000
_WORD = re.compile(WORD.encode())
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Piece:
    """A stretch of a document's words: document, place of the first word, how many are its own; the words after these open the next piece."""

    __slots__ = ("doc", "first", "words", "own")

    def __init__(self, doc: int, first: int, words: list[bytes], own: int):
        self.doc, self.first, self.words, self.own = doc, first, words, own


def pieces(texts: list[bytes], window: int) -> Iterator[list[Piece]]:
    """All texts in pieces, in lists of about PIECE bytes."""
    out, size = [], 0
    for doc, text in enumerate(texts):
        at = first = 0
        while at < len(text) or not first and not at:
            end = at + PIECE
            gap = _SPACE.search(text, end) if end < len(text) else None
            end = gap.start() if gap else len(text)
            words = text[at:end].split()
            ahead = [m[0] for m in islice(_WORD.finditer(text, end), window - 1)] if gap else []
            out.append(Piece(doc, first, words + ahead, len(words)))
            size, first, at = size + end - at, first + len(words), max(end, at + 1)
            if size >= PIECE:
                yield out
                out, size = [], 0
    if out:
        yield out


class Words:
    """The words of some pieces: keyed 128-bit hashes, piece of each, place in the document."""

    def __init__(self, of: list[Piece], key: Key):
        known: dict[bytes, int] = {}
        number = known.setdefault
        ids = np.array([number(w, len(known)) for p in of for w in p.words], np.int64)
        halves = np.frombuffer(key.digests(list(known)), np.uint64).reshape(-1, 2)[ids]
        self.halves, self.bases = (np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])), key.bases
        self.count = np.array([len(p.words) for p in of], np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.piece = np.repeat(np.arange(len(of)), self.count)
        inside = np.arange(len(ids)) - self.start[self.piece]
        self.place = inside + np.array([p.first for p in of], np.int64)[self.piece]
        self.own = inside < np.array([p.own for p in of], np.int64)[self.piece]

    def whole(self, size: int) -> np.ndarray:
        """Which stretches of ``size`` begin at one of the piece's own words and lie in it."""
        n = len(self.piece) - size + 1
        return self.own[:n] & (self.piece[size - 1 :] == self.piece[:n]) if n > 0 else np.zeros(0, bool)

    def blocks(self, size: int) -> np.ndarray:
        """Hashes of all stretches, to find candidates by."""
        return mix(Prefix(self.halves[0]).rolling(size))

    def windows(self, at: np.ndarray, size: int) -> list[np.ndarray]:
        """Two secret hashes of the windows at the given places."""
        return [mix(Prefix61(h, b).stretch(at, at + size)) for h, b in zip(self.halves, self.bases, strict=True)]


def _near_anchor(words: Words, anchors: np.ndarray, window: int, block: int, bits: int) -> np.ndarray:
    """Places of the windows that hold a known anchor of their document's own blocks."""
    at = np.flatnonzero(words.whole(window))
    if not len(anchors) or not len(at):
        return np.zeros(0, np.int64)
    held = at + (-words.place[at]) % block  # the first block that starts in the window
    return at[member(short_key(words.blocks(block)[held], bits), anchors)]


def repeats(chunks: Chunks, key: Key, scratch: Scratch, window: int = WINDOW) -> tuple[list[DataFrame], int]:
    """The answers about anchors and windows, and the bits of a bucket."""
    block, bits, rows = (window + 1) // 2, bucket_bits(chunks.total // 5), chunks.rows

    def probe(table: pa.Table) -> pa.Table:
        out = []
        for of in pieces(texts_of(table), window):
            words = Words(of, key)
            whole = words.whole(block)
            own = words.place[: len(whole)][whole] % block == 0
            out.append(messages(table["chunk"][0].as_py(), bits, words.blocks(block)[: len(whole)][whole], asked=own))
        return pa.concat_tables(out)

    anchors = exchange(rows.groupBy("chunk").applyInArrow(frugal(probe), MESSAGE), 6, scratch, "anchors")

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        none = messages(0, bits, np.zeros(0, np.uint64))
        known, _ = answered(answers, 0, 6)
        if not table.num_rows or not len(known):
            return none
        out = [none]
        for of in pieces(texts_of(table), window):
            words = Words(of, key)
            at = _near_anchor(words, known, window, block, bits)
            if len(at):
                out.append(messages(table["chunk"][0].as_py(), bits, *words.windows(at, window)))
        return pa.concat_tables(out)

    windows = exchange(with_answers(rows, [anchors], extend, MESSAGE), 12, scratch, "windows")
    return [anchors, windows], bits


def kept_words(texts: list[bytes], answers: pa.Table, window: int, bits: int, key: Key) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """Document, own words of a piece and which of them stay, piece by piece in order."""
    block = (window + 1) // 2
    known, _ = answered(answers, 0, 6)
    k, m = answered(answers, 1, 12)
    doc, carried = -1, np.zeros(0, np.int64)  # whether windows of the piece before cover the first words of this one
    for of in pieces(texts, window):
        words = Words(of, key) if len(k) else None
        cover = np.zeros(len(words.piece) + 1 if words else 1, np.int64)
        if words:
            at = _near_anchor(words, known, window, block, bits)
            if len(at):
                a, b = words.windows(at, window)
                at = at[member(a, k, narrow(b), m)]
                cover[at] += 1
                cover[at + window] -= 1
        covered = np.cumsum(cover[:-1]) > 0
        for i, p in enumerate(of):
            gone = covered[words.start[i] : words.start[i] + len(p.words)].copy() if words else np.zeros(len(p.words), bool)
            if p.doc == doc:
                gone[: len(carried)] |= carried[: len(gone)]
            doc, carried = p.doc, gone[p.own :]
            yield p.doc, p.words[: p.own], ~gone[: p.own]


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    ship(docs.sparkSession)
    scratch, key, chunks = Scratch(docs.sparkSession, "substring"), Key(), Chunks(docs)
    answers, bits = repeats(chunks, key, scratch, window)

    def judge(table: pa.Table, answers: pa.Table) -> pa.Table:
        count, left = (np.zeros(table.num_rows, np.int64) for _ in range(2))
        sha = [hashlib.sha256() for _ in range(table.num_rows)]
        for doc, words, keep in kept_words(texts_of(table), answers, window, bits, key):
            stay = words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            if stay:
                sha[doc].update((b" " if left[doc] else b"") + b" ".join(stay))
            count[doc] += len(words)
            left[doc] += len(stay)
        return pa.table(
            [table["doc_id"], pa.array(count), pa.array(count - left), pa.array([s.hexdigest() for s in sha], pa.string()), table["n"]],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "n"],
        )

    return chunks.spread(with_answers(chunks.rows, answers, judge, "doc_id long, n_words long, n_removed long, kept_sha256 string, n long"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows and columns, texts without their repeated windows. A text that loses nothing stays as it is, another has its kept words
    joined by one space; n_chars, where there is one, follows the text."""
    ship(docs.sparkSession)
    scratch, key, chunks = Scratch(docs.sparkSession, "substring"), Key(), Chunks(docs)
    answers, bits = repeats(chunks, key, scratch, window)
    others = [c for c in docs.columns if c != "text"]
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"))
    collapsed = None
    if chunks.hot is not None:  # each window of a text that repeats in full repeats
        often = chunks.hot.where("n > 1").select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text").eqNullSafe(F.col("_text"))
        long = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))) >= window
        collapsed = full.join(often, same, "left_semi").select(F.when(long, F.lit("")).otherwise(F.col("text")).alias("text"), "rest")
        full = full.join(often, same, "left_anti")
    full = full.withColumn("chunk", chunk_of(chunks.chunks))
    schema = StructType([StructField("text", StringType()), full.schema["rest"]])

    def clean(table: pa.Table, answers: pa.Table) -> pa.Table:
        out, left, lost = table["text"].to_pylist(), [[] for _ in range(table.num_rows)], [False] * table.num_rows
        for doc, words, keep in kept_words(texts_of(table), answers, window, bits, key):
            lost[doc] |= not keep.all()
            left[doc] += [w for w, k in zip(words, keep.tolist(), strict=True) if k]
        out = [b" ".join(w).decode() if x else t for t, w, x in zip(out, left, lost, strict=True)]
        return pa.table([pa.array(out, pa.string()), table["rest"]], ["text", "rest"])

    cleaned = with_answers(full, answers, clean, schema)
    if collapsed is not None:
        cleaned = cleaned.unionByName(collapsed)
    values = {c: F.col("rest").getField(c) for c in others} | {"text": F.col("text")}
    if "n_chars" in values:
        values["n_chars"] = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(values["n_chars"])
    return cleaned.select(*[values[c].alias(c) for c in docs.columns])
