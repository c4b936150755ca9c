"""Measured phases of candidates: what is written and read, how long it takes, whether it reads back right. Rows of samples go to the evidence operators."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence
from ..session import scratch_dir
from ..sources import generate, parquet, store, trades

PHASES = ("noop", "write", "read-range cold", "read-full cold", "read-range warm", "read-full warm")
SAMPLE = "dataset string, variant string, round int, role string, candidate string, phase string, cache string, op_ns long, bytes long, rows long, digest_ok boolean, flags array<string>, place long"


def _timed(run) -> tuple[object, int]:
    begun = time.perf_counter_ns()
    return run(), time.perf_counter_ns() - begun


def _drained(df: DataFrame) -> int:
    """All rows of all columns into nothing; how many there were by a sum that needs each."""
    return df.agg(F.count(F.lit(1)), F.sum(F.hash(*df.columns))).first()[0]


def measure(df: DataFrame, dataset: str, candidates: list[str], rounds: int, warmups: int = 1, variant: str = "v1") -> DataFrame:
    """Samples of every candidate, a configuration of parquet.SINKS, through all phases of all rounds; candidates change places from round to round.

    df: a table that a store can hold. The range is a sixteenth of all time from the middle on, of the first row's symbol. There is no way to empty caches from here: ``cold`` is the first
    read by a path, ``warm`` a later one."""
    spark, base, out = df.sparkSession, f"{scratch_dir(df.sparkSession)}/phases-{uuid.uuid4().hex}", []
    names = spark.createDataFrame(list(enumerate(candidates)), "i long, name string")
    places: dict[int, list[str]] = {}
    for r in evidence.rotated(names, rounds).orderBy("round", "place").collect():
        places.setdefault(r["round"], []).append(r["name"])
    low, high = df.agg(F.min("t"), F.max("t")).first()
    symbol, start = df.orderBy("block", "pos").select("symbol").first()[0], (low + high) // 2
    end, want = start + (high - low) // 16, trades.table_digest(df, "pos", df.columns).first()["sha256"]
    inside = df.where((F.col("symbol") == symbol) & F.col("t").between(start, end)).count()
    for r in range(rounds):
        for name in places[r]:
            path = f"{base}/{r}-{name}"
            seen: list[tuple[str, str | None, int, int | None, int | None, bool | None]] = [("noop", None, _timed(lambda: spark.range(1).count())[1], None, None, None)]
            opened, ns = _timed(lambda path=path, name=name: store.write(df, path, **parquet.SINKS[name]))
            seen.append(("write", None, ns, parquet.tree_bytes(spark, f"{path}/data").first()["bytes"], None, None))
            for cache in ("cold", "warm"):
                n, ns = _timed(lambda path=path: _drained(store.Store(spark, path).range_query(symbol, start, end)))
                seen.append(("read-range", cache, ns, None, n, n == inside))
                n, ns = _timed(lambda path=path: _drained(store.Store(spark, path).read_all()))
                seen.append(("read-full", cache, ns, None, n, trades.table_digest(opened.read_all(), "pos", df.columns).first()["sha256"] == want if cache == "cold" else None))
            role = "warmup" if r < warmups else "measured"
            out += [(dataset, variant, r, role, name, phase, cache, ns, size, n, ok, [], len(out) + k) for k, (phase, cache, ns, size, n, ok) in enumerate(seen)]
    return spark.createDataFrame(out, SAMPLE)


def blocks_bench(spark: SparkSession, sizes: list[int], repetitions: int = 3, seed: int = 0) -> DataFrame:
    """kind, regime, rows, raw_bytes, bytes, encode_ns, decode_ns: packed columns of generated tables, the median of some repetitions."""
    from ..sources import codec

    out = []
    for kind, tail in generate.TAILS.items():
        for regime in ("quiet", "volatile"):
            for rows in sizes:
                columns = [*generate.HEAD, *tail]
                made = generate.generate(spark, kind, regime, rows, seed).persist()
                made.count()
                took = []
                for _ in range(repetitions):
                    packed = codec.pack(made, columns).persist()
                    size, encode = _timed(lambda packed=packed: packed.agg(F.sum("bytes")).first()[0])
                    n, decode = _timed(lambda packed=packed, columns=columns: codec.unpack(packed, columns).count())
                    packed.unpersist()
                    took.append((encode, decode, size))
                made.unpersist()
                encode, decode = (sorted(t[i] for t in took)[repetitions // 2] for i in (0, 1))
                out.append((kind, regime, rows, 8 * len(columns) * rows, took[0][2], encode, decode))
    return spark.createDataFrame(out, "kind string, regime string, rows long, raw_bytes long, bytes long, encode_ns long, decode_ns long")
