"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprints. A-Z in lower case, words, shingles of ``shingle`` words joined by a space, repeats included; fewer words make one
shingle of all; no word gives fingerprint zero. A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).

Candidates. 64 bits are cut into three segments (22, 21 and 21 bits). Each, padded to 23 bits, is decoded with the perfect binary
Golay code: its keys are the nearest codeword and, at distance 3, the five codewords at distance 4. Words at distance 2 or less
always share a key (checked over all cosets in the tests). Two fingerprints at distance 5 or less have two segments at distance 2
or less each (three segments with two of them at 3 or more would need 6), so a key is a pair of segments' keys: 2**24 values a pair.

Where there are ``WIDE`` distinct fingerprints or more, 24 bits would bring too many together under one key. The same links, up to 4 bits, are then found by longer keys:
all three segments' keys at once (2**36 values), which pairs with 2 or less in each segment share, and for those with 3 or 4 in one segment, hence 1 at most in the two
others together, one of these exactly with the other's keys (2**34 values). A key's task does not grow with the square of the table.

Verification. Equal fingerprints are one node. Distinct ones are dealt by key; within a key distances are
counted, but only a spanning forest of the links leaves the task: a breadth-first walk that removes what it reaches, so that a
ball of near copies costs a few passes over it and no pair list. Memory: 8 bytes for each distinct fingerprint under one key.

Components. Forest links are contracted by alternating large-star and small-star rounds until nothing changes; each round is
a partial aggregation and a join, its result a table in the shared folder.

The pipeline's stage (keep_one) links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Texts with equal sets are one
node with one fingerprint. The nodes' fingerprints are linked by Golay keys and contracted as above; each component is a bucket of candidates, so every
pair at 4 or fewer bits is one. At 0.8 two fingerprints differ by about 10 of 64 bits, which no such link reaches. So that no link is lost, texts that share
one of 27 bands of four min-hashes are candidates besides (a pair at 0.8 shares none with a probability of 7e-7, a closer pair with less). All links are
verified by the sets themselves. Buckets with the same members are solved once; a bucket's task holds its members' sets.

Defined cases: null text has no words; rows without doc_id keep their fingerprint and take the component of their fingerprint, but name none (null
if no other row is reachable); repeated rows are one node; texts of any length are hashed whole (one text's words are in memory); an empty table gives an empty result; other
columns, of any name, are ignored by near_duplicates() and kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..session import ship
from .common import Scratch, spread, trim, worker_state

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # offset and width in bits
#: Fixed value: generator polynomial of the binary Golay code [23, 12, 7].
GENERATOR = 0b101011100011
#: Bands of min-hashes and min-hashes in a band.
BANDS, BAND_ROWS = 27, 4
WIDE = 1 << 26


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle in order, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory in very long texts
        votes += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("simhash", golay)
        for batch in batches:
            found = np.array([fingerprint(text.as_py(), shingle) for text in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])
        trim()

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, fp long")


class Golay:
    """Syndromes of 23-bit words; for each, the error patterns that lead to the word's keys (the first one six times if it has one key)."""

    def __init__(self):
        check = np.zeros(23, np.int64)
        for i in range(23):
            x = 1 << i
            for bit in range(22, 10, -1):
                if x >> bit & 1:
                    x ^= GENERATOR << (bit - 11)
            check[i] = x
        self.parts = [np.zeros(256, np.int64) for _ in range(3)]
        for p, table in enumerate(self.parts):
            for v in range(256):
                for b in range(8):
                    if v >> b & 1 and 8 * p + b < 23:
                        table[v] ^= check[8 * p + b]
        patterns: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(5):
            for c in combinations(range(23), weight):
                s = int(np.bitwise_xor.reduce(check[list(c)])) if c else 0
                if weight < 4 or patterns[s][0].bit_count() == 3:
                    patterns[s].append(sum(1 << i for i in c))
        self.patterns = np.array([(p * 6)[:6] for p in patterns], np.int64)
        self.counts = np.array([len(p) for p in patterns], np.int64)

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codeword numbers (12 bits; six a word, repeated where there are fewer) and how many differ: 1 or 6."""
        s = self.parts[0][words & 255] ^ self.parts[1][words >> 8 & 255] ^ self.parts[2][words >> 16 & 255]
        return (words[:, None] ^ self.patterns[s]) >> 11, self.counts[s]


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def _segments(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each segment: the bits, the keys (six each) and which of these are real."""
    bits, out = fps.view(np.uint64), []
    for o, w in SEGMENTS:
        part = (bits >> np.uint64(o) & np.uint64((1 << w) - 1)).astype(np.int64)
        keys, n = golay().keys(part)
        out.append((part, keys, np.arange(6) < n[:, None]))
    return out


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the fingerprint) for every key of every fingerprint."""
    by_segment, keys, owners = _segments(fps), [], []
    for pair, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        (_, a, na), (_, b, nb) = by_segment[i], by_segment[j]
        both = (pair << 24 | a[:, :, None] << 12 | b[:, None, :]).reshape(len(fps), 36)
        real = (na[:, :, None] & nb[:, None, :]).reshape(len(fps), 36)
        keys.append(both[real])
        owners.append(np.repeat(np.arange(len(fps)), real.sum(1)))
    return np.concatenate(keys).astype(np.int32), np.concatenate(owners)


def wide_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with longer keys, for links of 4 bits at most."""
    by_segment, keys, owners = _segments(fps), [], []

    def add(made: np.ndarray, real: np.ndarray) -> None:
        keys.append(made[real])
        owners.append(np.repeat(np.arange(len(fps)), real.reshape(len(fps), -1).sum(1)))

    (_, a, na), (_, b, nb), (_, c, nc) = by_segment
    add(a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :], na[:, :, None, None] & nb[:, None, :, None] & nc[:, None, None, :])
    for kind, (i, j) in enumerate(((i, j) for i in range(3) for j in range(3) if i != j), 1):
        exact, other, real = by_segment[i][0], by_segment[j][1], by_segment[j][2]
        add(kind << 36 | exact[:, None] << 12 | other, real)
    return np.concatenate(keys), np.concatenate(owners)


def _forest(fps: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect the same fingerprints as all links at ``bits`` or fewer differing bits do."""
    rest, left, right = fps, [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= bits
            if near.any():
                found, rest = rest[near], rest[~near]
                left.append(np.full(len(found), at))
                right.append(found)
                queue.extend(found)
    return left, right


def links(distinct: DataFrame, bits: int, partitions: int, wide: bool = False) -> DataFrame:
    """Forest links (a, b) among distinct fingerprints (column fp)."""
    ship(distinct.sparkSession)
    if not 0 <= bits <= 5 - wide:
        raise ValueError("the keys find fingerprints at 5 (wide keys: 4) or fewer differing bits")
    of, kind = (wide_keys, np.int64) if wide else (fuzzy_keys, np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 2048):
                part = np.ascontiguousarray(fps[at : at + 2048])
                keys, owners = of(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[owners])], ["key", "fp"])
        trim()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the last key of a batch waits for the next batch."""

        def solve(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
            size = ends - starts
            two = starts[size == 2]
            near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= bits
            left, right = [fps[two][near]], [fps[two + 1][near]]
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                a, b = _forest(fps[s:e], bits)
                left += a
                right += b
            a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        keys, fps = np.zeros(0, kind), np.zeros(0, np.uint64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k, f = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            waiting.append((k, f))
            if k[-1] == waiting[0][0][0]:
                continue
            keys, fps = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield solve(keys[:cut], fps[:cut])
            waiting = [(keys[cut:], fps[cut:])]
        if waiting:
            yield solve(*(np.concatenate([w[i] for w in waiting]) for i in (0, 1)))

    dealt = distinct.select("fp").mapInArrow(deal, f"key {'long' if wide else 'int'}, fp long")
    met = dealt.repartition(partitions, "key").sortWithinPartitions("key", "fp").mapInArrow(meet, "a long, b long")
    return met.distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """node, root (the smallest node of its component) for every node of the links (a, b); stars by alternating rounds."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        met = both.join(low, "a")
        if large:
            moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            moved = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
        return moved.where(F.col("a") != F.col("b")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.table(edges, f"{name}0")
    before, step = state(now), 0
    while before[0]:
        step += 1
        now = scratch.table(star(star(now, True), False), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def linked(nodes: DataFrame, bits: int, wide: bool | None, scratch: Scratch, name: str = "") -> DataFrame:
    """node, root of the distinct fingerprints (column fp of a table) that have a link."""
    spark = nodes.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.rdd.getNumPartitions())
    wide = bits <= 4 and nodes.count() >= WIDE if wide is None else wide
    return components(scratch.table(links(nodes, bits, partitions, wide), f"{name}links"), scratch, f"{name}stars")


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, wide: bool | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable through links) of every row. ``wide``: longer keys (None: from WIDE fingerprints on)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.table(fingerprints(docs, shingle), "fingerprints")
    nodes = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    stars = linked(nodes, bits, wide, scratch)
    rooted = nodes.join(stars, nodes["fp"] == stars["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = scratch.table(rooted.join(named, "root").select("fp", "component_id"), "classes")
    scratch.drop("nodes", "links")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes of a set of shingles; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    flips, factors, weights = worker_state("bands", _bands)
    low = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        np.minimum(low, ((hashes[None, at : at + 1024] ^ flips) * factors).min(1), out=low)
    return (low.reshape(BANDS, BAND_ROWS) * weights).sum(1, dtype=np.uint64).view(np.int64)


def _bands() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    flips, factors, weights = rng.integers(0, 2**64, (3, BANDS * BAND_ROWS), np.uint64)
    return flips[:, None], (factors | np.uint64(1))[:, None], (weights | np.uint64(1)).reshape(BANDS, BAND_ROWS)


def similar_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the same sets (sorted, without repeats) as all links at a Jaccard similarity of 0.8 or more do."""
    sizes, rest, found = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            own, near = sets[at], np.zeros(len(rest), bool)
            could = np.flatnonzero((5 * sizes[rest] >= 4 * len(own)) & (5 * len(own) >= 4 * sizes[rest]))
            for part in np.split(could, np.flatnonzero(np.diff(np.cumsum(sizes[rest[could]]) >> 20)) + 1):  # a million hashes at a time
                if not len(part):
                    continue
                flat = np.concatenate([sets[i] for i in rest[part]])
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                both = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(sizes[rest[part]])[:-1])), dtype=np.int64)
                near[part] = 9 * both >= 4 * (len(own) + sizes[rest[part]])
            queue.extend(rest[near].tolist())
            found += [(int(at), int(i)) for i in rest[near]]
            rest = rest[~near]
    return found


def similar_links(docs: DataFrame, nodes: DataFrame, classes: DataFrame, shingle: int, partitions: int, scratch: Scratch) -> DataFrame:
    """Forest links (a, b) among nodes (node, own, fp, keys) whose shingle sets are similar; own is the md5 of one of the node's texts in docs.
    Candidates share a class of fingerprints (node, root) or a band of min-hashes."""
    classed = nodes.select("node", "fp").join(classes.select(F.col("node").alias("fp"), "root"), "fp", "left")
    banded = nodes.select("node", F.explode("keys").alias("key")).unionByName(classed.select("node", F.xxhash64(F.lit("class"), F.coalesce("root", "fp")).alias("key")))
    bucket = Window.partitionBy("key")
    mark = [F.bit_xor(F.xxhash64("node", F.lit(i))).over(bucket).alias(f"mark{i}") for i in range(2)]
    shared = banded.select("key", "node", F.count(F.lit(1)).over(bucket).alias("n"), *mark).where("n > 1")
    shared = scratch.table(shared.groupBy("n", "mark0", "mark1", "node").agg(F.min("key").alias("key")).select("key", "node"), "shared")
    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("own")
    texts = docs.select(F.col("text").cast("string").alias("text")).join(wanted, F.md5("text") == F.col("own"), "left_semi").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(0)[at : at + 256]]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.binary()), lists], ["node", "hashes"])
        trim()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key."""

        def solve() -> pa.RecordBatch:
            pairs = [sorted((names[i], names[j])) for i, j in similar_forest(sets)]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], ["a", "b"])

        key, names, sets = None, [], []
        for batch in batches:
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for i, (k, name) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if k != key:
                    if len(sets) > 1:
                        yield solve()
                    key, names, sets = k, [], []
                names.append(name)
                sets.append(flat[ends[i] : ends[i + 1]].copy())
        if len(sets) > 1:
            yield solve()
        trim()

    cuts = texts.mapInArrow(cut, "node binary, hashes array<long>")
    dealt = shared.join(cuts, "node").select("key", "node", "hashes").repartition(partitions, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(meet, "a binary, b binary").distinct()


def node_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(np.ascontiguousarray(hashes).tobytes())


def near_copies(docs: DataFrame, shingle: int = 5, bits: int = 4) -> DataFrame:
    """doc_id, own (md5 of the text) and component of every row; a component is connected by links at a similarity of 0.8 or more."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near_copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)]
            nodes, keys = pa.array([node_of(s) for s in sets], pa.binary()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            fps = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), nodes, fps, keys], ["doc_id", "own", "node", "fp", "keys"])
        trim()

    text = F.col("text").cast("string")
    plain = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("own")))
    found = scratch.table(plain.mapInArrow(run, "doc_id long, own string, node binary, fp long, keys array<long>"), "rows")
    nodes = scratch.table(found.groupBy("node").agg(F.min("own").alias("own"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.rdd.getNumPartitions())
    classes = linked(scratch.table(nodes.select("fp").distinct(), "fps"), bits, None, scratch, "fp_")
    stars = components(scratch.table(similar_links(docs, nodes, classes, shingle, partitions, scratch), "links"), scratch)
    scratch.drop("fps", "fp_links")
    return found.select("doc_id", "own", "node").join(stars, "node", "left").select("doc_id", "own", F.coalesce("root", "node").alias("component"))


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of each component of near copies, all columns kept: the one with the smallest doc_id (rows without doc_id last, then by the hash of
    the text). Decisions are made for rows, so that another text under the same doc_id stays; of rows that repeat in doc_id and text one stays."""
    scratch = Scratch(docs.sparkSession, "keep_one")
    found = near_copies(docs.select("doc_id", "text"), shingle).groupBy("component", "doc_id", "own").agg(F.count(F.lit(1)).alias("n"))
    found = scratch.table(found.select("component", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "own").alias("row"), "n"), "rows")
    first = found.groupBy("component").agg(F.min("row").alias("first")).select(F.col("first.doc_id").alias("id"), F.col("first.own").alias("own"))
    listed = found.select(F.col("row.doc_id").alias("id"), F.col("row.own").alias("own"), "n")  # a row's component follows from its text, so that rows and not components are dealt
    gone = listed.join(first, listed["id"].eqNullSafe(first["id"]) & listed["own"].eqNullSafe(first["own"]), "left_anti").select("id", "own")
    every = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col("doc_id").cast("long").alias("id"), F.md5(F.col("text").cast("string")).alias("own"))

    def same(side: DataFrame):
        return every["id"].eqNullSafe(side["id"]) & every["own"].eqNullSafe(side["own"])

    kept = every.join(gone, same(gone), "left_anti")
    again = listed.where("n > 1").select("id", "own")
    if not again.isEmpty():
        hashed = [F.col(f"all.`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
        one = every.join(gone, same(gone), "left_anti").join(again, same(again), "left_semi").groupBy("id", "own").agg(F.min_by("all", F.xxhash64(*hashed)).alias("all"))
        kept = kept.join(again, same(again), "left_anti").select("all").unionByName(one.select("all"))
    return kept.select("all.*")
