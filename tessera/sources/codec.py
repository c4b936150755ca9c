"""Packed columns: each long column of a block by its best predictor, packed in groups, compressed where that makes it smaller, with a checksum.

A payload says all that its inverse needs. Blocks are packed and unpacked side by side; nothing is read beyond what the header announces.
"""

from __future__ import annotations

import struct
import time
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..operators.columns import GROUP, RAW, SAMPLE, _params, _quotients
from ..session import ship
from . import store

#: Bounds of a segment; columns of an eight-column table.
MOST_BLOCKS, MOST_ROWS, MOST_BYTES, EIGHT = 256, 16_777_216, 2**30, 8
MODES = ("absolute", "delta", "linear", "reference")
_HEAD = struct.Struct("<BBIqqqQIIB")  # predictor, other column, rows, origin, step, base, scale, payload, expanded, codec
PACKED = "block long, column string, predictor string, rows long, raw_bytes long, bytes long, compressed boolean, payload binary"


def _residual(values: list[np.ndarray], at: int, mode: int, other: int) -> tuple[np.ndarray, int, int]:
    """Residuals (unsigned 64 bits, wrapping), origin and step of a column in one mode."""
    v = values[at]
    origin, step = int(v[:1].view(np.int64)[0]), int((v[min(1, len(v) - 1)] - v[0]).view(np.int64))
    if mode == 0:
        return v, 0, 0
    if mode == 1:
        return np.concatenate((np.zeros(1, np.uint64), v[1:] - v[:-1])), origin, 0
    if mode == 2:
        return v - v[0] - np.int64(step).view(np.uint64) * np.arange(len(v), dtype=np.uint64), origin, step
    return v - values[other], 0, 0


def pack_column(values: list[np.ndarray], at: int, modes: tuple[str, ...] = MODES) -> tuple[int, bytes, bool]:
    """Predictor, payload and whether it is compressed. The predictor with the lowest width over the first 1,024 rows wins (delta costs one bit more), ties to the earlier."""
    forms = [(m, 0) for m in range(3) if MODES[m] in modes] + [(3, o) for o in range(at) if "reference" in modes]
    early = [v[:SAMPLE] for v in values]
    _, _, (mode, other) = min((_params(_residual(early, at, m, o)[0].view(np.int64))[2] + (m == 1), rank, (m, o)) for rank, (m, o) in enumerate(forms))
    residual, origin, step = _residual(values, at, mode, other)
    base, scale, _ = _params(residual.view(np.int64))
    q, out = _quotients(residual.view(np.int64), base, scale), []
    for start in range(0, len(q), GROUP):
        group = q[start : start + GROUP]
        width = int(group.max()).bit_length()
        if width > 32:
            out.append(bytes([RAW]) + group.astype("<u8").tobytes())
            continue
        full = np.zeros(GROUP, np.uint64)
        full[: len(group)] = group
        out.append(bytes([width]) + np.packbits((full[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes())
    plain = b"".join(out)
    small = pa.compress(plain, codec="lz4_raw", asbytes=True)
    smaller = len(small) < len(plain)
    body = _HEAD.pack(mode, other, len(q), origin, step, base, scale, len(small if smaller else plain), len(plain), smaller) + (small if smaller else plain)
    return mode, body + struct.pack("<I", zlib.crc32(body)), smaller


def unpack_column(payload: bytes, before: list[np.ndarray]) -> np.ndarray:
    """The column's values as unsigned 64 bits. A payload that is cut, longer than it says, or differs from its checksum is an error."""
    if len(payload) < _HEAD.size + 4:
        raise ValueError("a cut payload")
    mode, other, rows, origin, step, base, scale, size, expanded, small = _HEAD.unpack_from(payload)
    if len(payload) != _HEAD.size + size + 4 or rows > store.MOST_ROWS or expanded > 9 * rows + 16 * GROUP:
        raise ValueError("a payload that is not what it says")
    if struct.unpack("<I", payload[-4:])[0] != zlib.crc32(payload[:-4]):
        raise ValueError("a payload that differs from its checksum")
    body = payload[_HEAD.size : -4]
    plain = pa.decompress(body, decompressed_size=expanded, codec="lz4_raw", asbytes=True) if small else body
    q, at = np.zeros(rows, np.uint64), 0
    for start in range(0, rows, GROUP):
        n, width = min(GROUP, rows - start), plain[at]
        at += 1
        if width == RAW:
            q[start : start + n] = np.frombuffer(plain, "<u8", n, at)
            at += 8 * n
        else:
            bits = np.unpackbits(np.frombuffer(plain, np.uint8, 16 * width, at), bitorder="little").reshape(GROUP, width)[:n].astype(np.uint64)
            q[start : start + n] = (bits << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)
            at += 16 * width
    if at != len(plain):
        raise ValueError("a payload with a rest")
    residual = q * np.uint64(scale) + np.int64(base).view(np.uint64)
    first = np.int64(origin).view(np.uint64)
    if MODES[mode] == "delta":
        return first + np.cumsum(residual, dtype=np.uint64)
    if MODES[mode] == "linear":
        return residual + first + np.int64(step).view(np.uint64) * np.arange(rows, dtype=np.uint64)
    return residual + before[other] if MODES[mode] == "reference" else residual


def pack(df: DataFrame, columns: list[str], modes: tuple[str, ...] = MODES) -> DataFrame:
    """block, column, predictor, rows, raw_bytes, bytes, compressed, payload of every long column of every block; rows by pos. A reference is an earlier column."""
    ship(df.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        table, block = table.sort_by("pos"), table["block"][0].as_py()
        values = [table[c].to_numpy().astype(np.int64).view(np.uint64) for c in columns]
        out = []
        for at, c in enumerate(columns):
            mode, payload, small = pack_column(values, at, modes)
            out.append({"block": block, "column": c, "predictor": MODES[mode], "rows": table.num_rows, "raw_bytes": 8 * table.num_rows, "bytes": len(payload), "compressed": small, "payload": payload})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("column", pa.string()), ("predictor", pa.string()), ("rows", pa.int64()), ("raw_bytes", pa.int64()), ("bytes", pa.int64()), ("compressed", pa.bool_()), ("payload", pa.binary())]))

    return df.select("block", "pos", *columns).groupBy("block").applyInArrow(run, PACKED)


def unpack(packed: DataFrame, columns: list[str]) -> DataFrame:
    """block, i (place in the block, from 0) and the columns of every row."""
    ship(packed.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        found, values = dict(zip(table["column"].to_pylist(), table["payload"].to_pylist(), strict=True)), []
        for c in columns:
            values.append(unpack_column(found[c], values))
        n = len(values[0])
        return pa.table([pa.array(np.full(n, table["block"][0].as_py())), pa.array(np.arange(n)), *[pa.array(v.view(np.int64)) for v in values]], ["block", "i", *columns])

    return packed.select("block", "column", "payload").groupBy("block").applyInArrow(run, f"block long, i long, {', '.join(f'`{c}` long' for c in columns)}")


def valid_columns(schema: StructType, columns: list[str]) -> None:
    """An eight-column table has eight long columns of different names."""
    if len(columns) != EIGHT or len(set(columns)) != EIGHT or not all(isinstance(schema[c].dataType, LongType) for c in columns):
        raise ValueError("eight long columns")


def segment_gate(packed: DataFrame) -> None:
    """Refuses a segment of too many blocks, rows or bytes, or in which a block lacks a column."""
    by_block = packed.groupBy("block").agg(F.max("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count_distinct("column").alias("columns"))
    r = by_block.agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.min("columns").alias("low"), F.max("columns").alias("high")).first()
    if r["n"] > MOST_BLOCKS or (r["rows"] or 0) > MOST_ROWS or (r["bytes"] or 0) > MOST_BYTES or r["low"] != r["high"]:
        raise ValueError("a segment of too many blocks, rows or bytes, or with unlike blocks")


def write_segment(df: DataFrame, path: str, columns: list[str], metadata: dict | None = None) -> None:
    """Packs a table into a new folder; with metadata its contract is checked first. An existing path is an error."""
    if metadata is not None:
        store.contract(metadata, df.schema)
    packed = pack(df, columns)
    packed.write.mode("errorifexists").parquet(f"{path}/parts")
    segment_gate(df.sparkSession.read.parquet(f"{path}/parts"))


def read_segment(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The table of a segment; its bounds are checked on the headers before a payload is read."""
    packed = spark.read.schema(PACKED).parquet(f"{path}/parts")
    segment_gate(packed)
    return unpack(packed, columns)


def fixture(spark: SparkSession, family: str) -> tuple[DataFrame, dict]:
    """Three rows and their metadata that fulfil the contract of trades (tick) or book levels (book)."""
    head = "block bigint, pos bigint, source_utc_ns bigint, received_utc_ns bigint, clock_error_ns bigint, available_utc_ns bigint, sequence bigint, symbol string, price bigint, quantity bigint, side tinyint"
    rows = [(0, i, 1_000 + i, 1_100 + i, 50, 1_150 + i, i + 1, "BTCUSDT", 6_000_000 + 5 * i, 100 * (i + 1), i % 2) for i in range(3)]
    meta = {"family": family, "schema_version": 1, "source_sha256": "1" * 64, "price_decimals": 2, "quantity_decimals": 3}
    if family == "tick":
        return spark.createDataFrame(rows, head), meta | {"subtype": "trade"}
    if family == "book":
        return spark.createDataFrame([(*r, i, 1) for i, r in enumerate(rows)], head + ", level bigint, action tinyint"), meta | {"depth": 3}
    raise ValueError("unknown family")


def report(spark: SparkSession, path: str, metadata: dict | None = None) -> dict:
    """What a store holds: totals, schema, whether facts and checksums are right, the verdict on its contract, nanoseconds of each step. All blocks are read."""
    marks = [time.perf_counter_ns()]
    opened = store.Store(spark, path)
    totals = opened.totals()
    marks.append(time.perf_counter_ns())
    read = opened.read_all().count()
    marks.append(time.perf_counter_ns())
    verified = opened.verify()
    marks.append(time.perf_counter_ns())
    verdict = None
    if metadata is not None:
        try:
            store.contract(metadata, opened.schema)
            verdict = "ok"
        except ValueError as refused:
            verdict = str(refused)
    steps = dict(zip(("index_ns", "read_ns", "check_ns"), np.diff(marks).tolist(), strict=True))
    return totals | {"read": read, "verified": verified and read == totals["rows"], "contract": verdict, "schema": opened.schema.simpleString()} | steps


def profiled(df: DataFrame) -> dict[str, int]:
    """Nanoseconds of a full scan of a frame: planning, and running into the no-op sink."""
    begun = time.perf_counter_ns()
    df._jdf.queryExecution().executedPlan()
    planned = time.perf_counter_ns()
    df.write.format("noop").mode("overwrite").save()
    return {"plan_ns": planned - begun, "run_ns": time.perf_counter_ns() - planned}


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small summary as a Markdown table; more than ``most`` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    shown = lambda x: "" if x is None else f"{x:,.3f}" if isinstance(x, float) else f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *[[shown(x) for x in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)

