"""What the two repeat removers share: chunks of documents, hashes of stretches, and an exchange that tells every chunk
which of its keys occur anywhere else.

A chunk is a set of whole documents, given by a hash of the row, so that every pass forms the same chunks again. For each bucket
of key values a chunk sends one packed message with its distinct keys and a bit for those it holds twice. A bucket's task adds
up and answers each chunk with the keys that occur twice or more in all. A key that a third of all documents share is thus one key of
each chunk, never a row of each document; no pair of documents is ever formed.

Rows that repeat in full (doc_id and text) more than ``COPIES`` times would all fall into one chunk. They are collapsed first: two stand for
all in the exchange (each repeats the other, as all of them do), and one of these carries the number of rows that its result is for.

Two kinds of hashes are used. ``Prefix`` works modulo 2**64; texts can be made that collide under it, so it only chooses candidates
and orders comparisons that are verified on bytes. What decides without a look at the bytes is keyed: BLAKE2b with a salt drawn for each
run, or polynomials modulo 2**61 - 1 with a base drawn for each run over such hashes (``Prefix61``).
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Scratch, trim, worker_state

CHUNK_BYTES, BUCKET_KEYS, LEAST_BUCKET_BITS, COPIES = 512_000, 1_000_000, 8, 64
_BASE = 0x9E3779B97F4A7C15  # odd, so that powers have inverses modulo 2**64
P61 = np.uint64((1 << 61) - 1)
MESSAGE = "bucket int, chunk long, keys binary, twice binary, asked binary"
ANSWER = "chunk long, keys binary, hot binary"
_EMPTY = np.zeros(0, np.uint64)
_LONG = np.dtype([("k", "<u8"), ("m", "<u4")])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(base: int, n: int, modulus: int, times: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, n of each at least; by doubling, kept in the worker for the latest bases."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        if len(_powers) > 3:
            _powers.clear()
        size, both = 1 << max(17, (n - 1).bit_length()), []
        for value in (base, pow(base, -1, modulus)):
            p = np.ones(size, _U)
            done, step = 1, value
            while done < size:
                p[done : 2 * done] = times(p[:done], _U(step))
                done, step = 2 * done, step * step % modulus
            both.append(p)
        have = _powers[base] = (both[0], both[1])
    return have


class Prefix:
    """Prefix polynomial hashes of a sequence modulo 2**64: the hash of any stretch in constant time. For candidates and verified comparisons only."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = _table(_BASE, len(values) + 1, 1 << 64, lambda a, b: a * b)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * self.up[: len(values)], out=self.sums[1:])

    def rolling(self, size: int) -> np.ndarray:
        """Hashes of all stretches of ``size``."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n] if n > 0 else _EMPTY

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x >> _U(61)) + (x & P61)
    return np.where(x >= P61, x - P61, x)


def times61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 of numbers below it."""
    low = _U((1 << 31) - 1)
    ah, al, bh, bl = a >> _U(31), a & low, b >> _U(31), b & low
    middle = al * bh + ah * bl
    return _fold((ah * bh << _U(1)) + (middle >> _U(30)) + ((middle & _U((1 << 30) - 1)) << _U(31)) + al * bl)


class Prefix61:
    """Prefix polynomial hashes modulo the prime 2**61 - 1 with a secret base: two different sequences of n values agree with a probability of n / 2**61."""

    def __init__(self, values: np.ndarray, base: int):
        self.up, self.down = _table(base, len(values) + 1, int(P61), times61)
        terms = times61(_fold(values), self.up[: len(values)])
        high, low = np.cumsum(terms >> _U(32)), np.cumsum(terms & _U(0xFFFFFFFF))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        self.sums[1:] = _fold(times61(_fold(high), np.full(1, 1 << 32, _U)) + _fold(low))

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return times61(_fold(self.sums[end] + (P61 - self.sums[start])), self.down[start])


class Key:
    """What a run hashes with: salt and personalisation of BLAKE2b and two bases modulo 2**61 - 1, drawn on the driver and sent with the tasks."""

    def __init__(self):
        self.salt, self.bases = secrets.token_bytes(32), [secrets.randbelow(int(P61) - 2) + 2 for _ in range(2)]

    def digests(self, strings: Iterable[bytes], size: int = 16) -> bytes:
        begun, out = hashlib.blake2b(digest_size=size, salt=self.salt[:16], person=self.salt[16:]).copy, []
        for x in strings:
            h = begun()
            h.update(x)
            out.append(h.digest())
        return b"".join(out)


def chunk_of(chunks: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long")


class Chunks:
    """The rows (doc_id, text, chunk, n) of all documents and what is known of them: bytes of all texts, number of chunks, and the texts that
    repeat too often (``hot``: doc_id, text, n; None if there are none). A row stands for n rows of the table; the second of the two
    that stand for collapsed ones has n = 0."""

    def __init__(self, docs: DataFrame):
        plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        row = F.xxhash64("doc_id", "text").alias("row")
        by_row = plain.groupBy(row).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
        total, often = by_row.agg(F.sum("bytes"), F.count_if(F.col("n") > COPIES)).first()
        self.total, self.hot = int(total or 0), None
        self.chunks = max(1, -(-self.total // CHUNK_BYTES))
        if often:
            marked = by_row.where(F.col("n") > COPIES).select("row")
            every = plain.withColumn("row", F.xxhash64("doc_id", "text"))
            self.hot = every.join(marked, "row", "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
            two = F.when(F.col("n") > 1, F.array(F.col("n"), F.lit(0).cast("long"))).otherwise(F.array("n"))
            plain = every.join(marked, "row", "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("n")).unionByName(self.hot.withColumn("n", F.explode(two)))
        else:
            plain = plain.withColumn("n", F.lit(1).cast("long"))
        self.rows = plain.withColumn("chunk", chunk_of(self.chunks))

    def spread(self, judged: DataFrame) -> DataFrame:
        """Results for all rows of the table again, from results with n."""
        if self.hot is None:
            return judged.drop("n")
        return judged.where("n > 0").withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")


def in_order(table: pa.Table) -> pa.Table:
    """The rows of a chunk in one order, however they came: passes number what they find."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def texts_of(table: pa.Table) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in table["text"]]


def bucket_bits(keys: int) -> int:
    """Buckets of about BUCKET_KEYS keys, as a power of two; at least 2**8."""
    return max(LEAST_BUCKET_BITS, (max(1, keys) // BUCKET_KEYS).bit_length())


def messages(chunk: int, bits: int, keys: np.ndarray, more: np.ndarray | None = None, asked: np.ndarray | None = None, counted: bool = False) -> pa.Table:
    """Messages of a chunk. Keys have 96 bits with ``more``; without, a bucket compares 48 of 64 bits besides its own.
    ``asked``: for which keys an answer is wanted (all, if None). ``counted``: the message says how often (255 at most) instead of whether twice."""
    if not len(keys):
        return pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())], ["bucket", "chunk", "keys", "twice", "asked"])
    if more is None:
        order = np.argsort(keys, kind="stable")
    else:
        more = narrow(more)
        order = np.lexsort((more, keys))
        more = more[order]
    keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    if more is not None:
        first[1:] |= more[1:] != more[:-1]
    at = np.flatnonzero(first)
    often = np.diff(np.append(at, len(keys)))
    wanted = np.ones(len(at), bool) if asked is None else np.logical_or.reduceat(asked[order], at)
    keys = keys[at]
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = np.append(0, cuts), np.append(cuts, len(keys))
    if more is None:
        packed = short_key(keys, bits).view(np.uint8).reshape(-1, 8)[:, :6]
    else:
        packed = np.rec.fromarrays([keys, more[at]], dtype=_LONG).view(np.uint8).reshape(-1, 12)
    number = np.minimum(often, 255).astype(np.uint8)
    times = [(number[s:e] if counted else np.packbits(often[s:e] > 1)).tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    rows = [(packed[s:e].tobytes(), t, np.packbits(wanted[s:e]).tobytes()) for s, e, t in zip(starts.tolist(), ends.tolist(), times, strict=True)]
    return pa.table(
        [pa.array(bucket[starts], pa.int32()), pa.array(np.full(len(starts), chunk), pa.int64()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(3)]],
        ["bucket", "chunk", "keys", "twice", "asked"],
    )


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def answer(table: pa.Table, width: int, hot: int | None = None) -> pa.Table:
    """For one bucket: to each chunk the wanted keys that occur twice or more in all; those that occur ``hot`` times or more apart (messages are counted then)."""
    chunks = table["chunk"].to_numpy()
    raw = [x.as_py() for x in table["keys"]]
    sizes = np.array([len(x) // width for x in raw])
    data = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
    if hot is None:
        often = np.concatenate([_bits(x.as_py(), n) for x, n in zip(table["twice"], sizes, strict=True)]) + np.int64(1)
    else:
        often = np.frombuffer(b"".join([x.as_py() for x in table["twice"]]), np.uint8).astype(np.int64)
    asked = np.concatenate([_bits(x.as_py(), n) for x, n in zip(table["asked"], sizes, strict=True)])
    if width == 6:
        wide = np.zeros((len(data), 8), np.uint8)
        wide[:, :6] = data
        keys, more = wide.view(np.uint64).ravel(), None
        order = np.argsort(keys, kind="stable")
    else:
        both = np.ascontiguousarray(data).reshape(-1).view(_LONG)
        keys, more = np.ascontiguousarray(both["k"]), np.ascontiguousarray(both["m"])
        order = np.lexsort((more, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if more is not None:
        m = more[order]
        new[1:] |= m[1:] != m[:-1]
    group = np.cumsum(new) - 1
    count = np.bincount(group, often[order])
    total = np.zeros(len(k), np.int64)
    total[order] = count[group]
    total[~asked] = 0
    found = total >= 2
    many = found & (total >= hot) if hot is not None else np.zeros(len(k), bool)
    few = found & ~many
    ends = np.cumsum(sizes)
    out = [(c, data[s:e][few[s:e]].tobytes(), data[s:e][many[s:e]].tobytes()) for c, s, e in zip(chunks.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True) if found[s:e].any()]
    return pa.table([pa.array([x[0] for x in out], pa.int64()), *[pa.array([x[i] for x in out], pa.binary()) for i in (1, 2)]], ["chunk", "keys", "hot"])


def narrow(more: np.ndarray) -> np.ndarray:
    """The 32 bits of a second hash that messages hold besides the 64 of the first."""
    return more & np.uint64(0xFFFFFFFF)


def answered(table: pa.Table, kind: int, width: int, column: str = "keys") -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the answers of one kind to a chunk: (48-bit keys, none) at a width of 6, else (keys, second hashes as by narrow())."""
    got = b"".join(x.as_py() or b"" for x, k in zip(table[column], table["kind"], strict=True) if k.as_py() == kind)
    if width == 6:
        wide = np.zeros((len(got) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(got, np.uint8).reshape(-1, 6)
        return np.sort(wide.view(np.uint64).ravel()), _EMPTY
    data = np.frombuffer(got, _LONG)
    return _sorted(data["k"].astype(np.uint64), data["m"].astype(np.uint64))


def _sorted(keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((more, keys))
    return keys[order], more[order]


def short_key(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 48 bits of 64-bit keys that messages hold. They only choose candidates: a chance agreement costs a check, not a result."""
    return keys >> np.uint64(max(0, 16 - bits)) & np.uint64((1 << 48) - 1)


def member(keys: np.ndarray, of: np.ndarray, more: np.ndarray | None = None, of_more: np.ndarray | None = None) -> np.ndarray:
    """Which keys (pairs, with ``more``) are in the sorted list."""
    if not len(of) or not len(keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(of, keys), len(of) - 1)
    hit = of[at] == keys
    if more is None:
        return hit
    end = np.searchsorted(of, keys, side="right")
    hit &= of_more[at] == more
    for i in np.flatnonzero(~hit & (end - at > 1)):  # equal first halves: look through the few
        hit[i] = more[i] in of_more[at[i] : end[i]]
    return hit


def frugal(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """run for one group, without what other operators keep in the worker, giving freed memory back now and then."""

    def one(left: pa.Table) -> pa.Table:
        worker_state("repeats", dict)
        out = run(left)
        trim(32)
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        worker_state("repeats", dict)
        out = run(left, right)
        trim(32)
        return out

    return two if run.__code__.co_argcount == 2 else one


def exchange(sent: DataFrame, width: int, scratch: Scratch, name: str, hot: int | None = None) -> DataFrame:
    """Answers to messages, as a table."""
    return scratch.table(sent.groupBy("bucket").applyInArrow(frugal(lambda t: answer(t, width, hot)), ANSWER), name)


def with_answers(docs: DataFrame, answers: list[DataFrame], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(rows, answers) for every chunk; answers have a column kind, their place in the list."""
    ship(docs.sparkSession)
    every = None
    for kind, a in enumerate(answers):
        a = a.withColumn("kind", F.lit(kind))
        every = a if every is None else every.unionByName(a, allowMissingColumns=True)
    return docs.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInArrow(frugal(run), schema)
