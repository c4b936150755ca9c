"""Exact top-k by integer inner product with a KD-tree for each shard.

Components x become floor(scale * x). Vectors are dealt into shards of about ``shard_rows`` by a hash of their id; a shard's task
builds a KD-tree by median splits along the widest side, each node with its tight bounding box. The inner product of a query with any
point of a box is at most sum(max(q * low, q * high)); best-first traversal opens nodes by falling bound and
stops below the k-th score.

The k-th score is propagated in two rounds: each query first searches one shard, chosen by hash; what it found there is the threshold with which it visits all others,
in blocks of ``query_block`` queries, so that a task holds one shard and one block. Only scores at or above the threshold leave a task, k at most
for each query and shard; ties are kept until the end, where the smaller id wins. Shards have ``shard_rows`` vectors, or fewer where there would be under
64 shards; a vector goes to as many tasks as there are blocks of queries, a query to as many as there are shards.

The work grows with queries times vectors: exact search in many dimensions prunes little, and nothing is dropped to escape that.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part, nor do rows without id; only vectors of a query's own length are its
candidates; rows with the query's id are its own row and no candidates of it; identical repeated rows are one query, and as many candidates as there are rows;
fewer than k candidates give all; vectors of any length are compared (a shard's are in memory); an empty table gives an empty result; scores beyond 64 bits are cut to
the limits of a long, and are ties there; other columns, of any name, are ignored.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import Scratch

HIT = "query_id long, vec_id long, score long, n long"
_EXACT = float(1 << 53)


class KdTree:
    """Median splits of integer points; nodes as arrays, boxes tight around their points."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = 32):
        order = np.arange(len(points))
        low, high, child, span = [], [], [], []

        def build(start: int, end: int) -> int:
            node = len(low)
            part = points[order[start:end]]
            low.append(part.min(0))
            high.append(part.max(0))
            child.append((-1, -1))
            span.append((start, end))
            if end - start > leaf:
                wide = int((high[node] - low[node]).argmax())
                if high[node][wide] > low[node][wide]:
                    middle = (start + end) // 2
                    order[start:end] = order[start:end][np.argpartition(part[:, wide], middle - start)]
                    child[node] = (build(start, middle), build(middle, end))
            return node

        build(0, len(points))
        self.low, self.high, self.child, self.span = np.stack(low), np.stack(high), child, span
        self.points, self.ids, self.place = points[order], ids[order], order

    def search(self, query: np.ndarray, own: int, k: int, threshold: float) -> list[tuple[float, int, int]]:
        """(score, id, place in the shard) of the best k at or above the threshold, best first, without the id ``own``."""
        bounds = np.maximum(query, 0) @ self.high.T + np.minimum(query, 0) @ self.low.T
        queue: list[tuple[float, int]] = [(-bounds[0], 0)]
        best: list[tuple[float, int, int]] = []  # a heap with the worst first: (score, -id, place)
        while queue:
            bound, node = heappop(queue)
            if -bound < threshold:
                break
            a, b = self.child[node]
            if a >= 0:
                heappush(queue, (-bounds[a], a))
                heappush(queue, (-bounds[b], b))
                continue
            start, end = self.span[node]
            scores = self.points[start:end] @ query
            if scores.dtype == object:
                scores = np.array([max(-(2**63), min(2**63 - 1, s)) for s in scores], object)
            for i in np.flatnonzero(scores >= threshold).tolist():
                if (vec := int(self.ids[start + i])) == own:
                    continue
                hit = (scores[i], -vec, int(self.place[start + i]))
                if len(best) < k:
                    heappush(best, hit)
                elif hit > best[0]:
                    heappop(best)
                    heappush(best, hit)
                if len(best) == k:
                    threshold = max(threshold, best[0][0])
        return [(s, -v, i) for s, v, i in sorted(best, reverse=True)]


def _matrix(column: pa.ChunkedArray, dims: np.ndarray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
    starts = np.cumsum(dims) - dims
    return np.stack([flat[s : s + dim] for s in starts[dims == dim]]) if dim else np.zeros((int((dims == 0).sum()), 0), np.int64)


def _search(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """All queries of a block against one shard; by length of vector."""
    out: list[tuple[int, int, int, int]] = []
    if queries.num_rows and vectors.num_rows:
        qdim, vdim = (pa.compute.list_value_length(c).to_numpy() for c in (queries["q"], vectors["v"]))
        for dim in np.intersect1d(qdim, vdim).tolist():
            q, v = _matrix(queries["q"], qdim, dim), _matrix(vectors["v"], vdim, dim)
            most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0)) * max(1, dim)
            exact = np.float64 if most < _EXACT else object  # beyond doubles' whole numbers Python's integers take over
            q, v = q.astype(exact), v.astype(exact)
            ids, copies = (vectors[c].to_numpy()[vdim == dim] for c in ("vec_id", "n"))
            tree = KdTree(v, ids) if dim else None
            kths = np.array([float("-inf") if x is None else x for x in queries["kth"].to_pylist()], object)[qdim == dim]
            for x, own, least in zip(q, queries["query_id"].to_numpy()[qdim == dim].tolist(), kths, strict=True):
                hits = tree.search(x, own, k, least) if tree else [(0, i, p) for i, p in sorted(zip(ids.tolist(), range(len(ids)), strict=True)) if i != own][:k]
                out += [(own, vec, int(s), int(copies[p])) for s, vec, p in hits]
    return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], ["query_id", "vec_id", "score", "n"])


def top_k(vectors: DataFrame, k: int = 10, query_mod: int = 100, scale: int = 1024, shard_rows: int = 32_768, query_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score for every query: a row whose vec_id is divisible by ``query_mod``."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "kdtree")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    points = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    points = scratch.table(points.select("vec_id", whole.alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")), "points")
    rows, asked = points.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % query_mod == 0)).first()
    shards, blocks = max(1, -(-rows // shard_rows), min(64, rows // 1024)), max(1, -(-asked // query_block))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    queries = points.where(F.col("vec_id") % query_mod == 0).select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.pmod(F.xxhash64("vec_id", F.lit("pilot")), F.lit(shards)).cast("int").alias("pilot"),
        F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"),
    )
    vectors_of = dealt.select("shard", "vec_id", "v", "n")

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        return _search(q, v, k)

    first = queries.select("query_id", "q", F.lit(None).cast("long").alias("kth"), F.col("pilot").alias("shard"))
    pilot = scratch.table(first.groupBy("shard").cogroup(vectors_of.groupBy("shard")).applyInArrow(run, HIT), "pilot")
    known = pilot.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    rest = queries.join(known, "query_id", "left").select(
        "query_id", "q", "kth", "block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("pilot"))).alias("shard")
    )
    copies = vectors_of.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    others = rest.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInArrow(lambda q, v: _search(q, v, k), HIT)
    found = pilot.unionByName(others).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k).cast("long")))))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
