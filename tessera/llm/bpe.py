"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut by the tokenizer's pattern into pre-tokens. A pre-token that is itself a vocabulary entry is
one id. Any other is a linked list of byte ids; each adjacent pair whose joined bytes are an entry is filed in the
bucket of that entry's rank. A two-level bitmap marks the ranks whose buckets hold positions: find-first-set gives the
lowest rank, its bucket the leftmost position. A position whose pair no longer has that rank is stale and skipped. Merges
therefore cost O(log n) each, also in pre-tokens of a million bytes.

Decoding joins the bytes of the ids. Results of pre-tokens are kept in each Python worker, up to a fixed number of bytes.

Defined cases: null text is encoded as the empty text (no ids); empty text has no ids; repeated rows are encoded each;
texts of any length are encoded whole; special tokens are never produced; an empty table gives an empty result; other columns, of any name, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import spread, trim, worker_state

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_SPAN = 256  # ranks under one bit of the upper level
_KEEP_BYTES, _LONGEST_KEPT, _KEEP_PAIRS = 32_000_000, 256, 500_000


class RankQueue:
    """Positions by rank. The upper level has a bit for each span of ranks, the lower one a bit for each rank."""

    def __init__(self, ranks: int):
        self.top, self.low, self.buckets = 0, [0] * (ranks // _SPAN + 1), {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            span = rank // _SPAN
            self.low[span] |= 1 << rank % _SPAN
            self.top |= 1 << span
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        span = (self.top & -self.top).bit_length() - 1
        bits = self.low[span]
        rank = span * _SPAN + (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[span] = bits & (bits - 1)
            if not self.low[span]:
                self.top &= self.top - 1
        return rank, position


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.vocabulary: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.vocabulary[rank] = piece
        self.bytes = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.queue = RankQueue(len(self.vocabulary))
        self.kept: dict[str, bytes] = {}
        self.kept_bytes = 0

    def rank(self, left: int, right: int) -> int:
        """The id of the joined pair, or -1."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= _KEEP_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.ranks.get(self.vocabulary[left] + self.vocabulary[right], -1)
        return found

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids, n, rank, queue = [self.bytes[b] for b in piece], len(piece), self.rank, self.queue
        if min(ids) < 0:
            raise ValueError("the vocabulary lacks a byte")
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            r = rank(ids[i], ids[i + 1])
            if r >= 0:
                queue.push(r, i)
        while queue.top:
            r, i = queue.pop()
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i], ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := rank(r, ids[k])) >= 0:
                    queue.push(s, i)
            if (p := before[i]) >= 0 and (s := rank(ids[p], r)) >= 0:
                queue.push(s, p)
        return [x for x in ids if x >= 0]

    def packed(self, token: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers, from those kept where possible."""
        ids = b"".join(i.to_bytes(4, "little") for i in self.piece(token.encode()))
        if len(token) <= _LONGEST_KEPT:
            if self.kept_bytes > _KEEP_BYTES:
                self.kept.clear()
                self.kept_bytes = 0
            self.kept[token] = ids
            self.kept_bytes += len(token) + len(ids)
        return ids

    def encode(self, text: str) -> bytes:
        out, kept = [], self.kept
        for token in self.pattern.findall(text):
            ids = kept.get(token)
            out.append(self.packed(token) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, memoryview(ids).cast("I").tolist()))


def encoder(path: str | None = None, pattern: str | None = None) -> BytePairEncoder:
    """The encoder of a rank file, read once in each worker; by default the installed multilingual one."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def read() -> BytePairEncoder:
        with open(path, "rb") as lines:
            return BytePairEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    return worker_state(("bpe", path, pattern), read)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) of every document."""
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path, pattern)
        for batch in batches:
            n, sha, back, all_ids = [], [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(all_ids), np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        trim()

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, schema)


def decode_ids(ids: list[int], path: str | None = None) -> bytes:
    codec = encoder(path)
    return b"".join(codec.vocabulary[i] for i in ids)
