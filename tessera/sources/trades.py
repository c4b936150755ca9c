"""Trades: strict CSV, exact normalisation of doubles to integers and back, order-sensitive digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..session import ship

#: Columns of an aggregate-trades CSV line, in order.
CSV = ("agg_id", "price", "qty", "first_id", "last_id", "transact_time", "is_buyer_maker", "is_best_match")
#: The kinds of eight-column tables as bytes; bit patterns of doubles, longs and the symbol of the edge table.
KIND_BYTES = {"quote": 1, "trade": 2, "l2": 3}
EDGE_BITS = (
    0x0000000000000000, 0x8000000000000000, 0x0000000000000001, 0x0010000000000000, 0x3E45798EE2308C3A, 0x3FD3333333333333, 0x3FD3333333333334, 0x40AF4023D70A3D71,
    0x4197D78400000000, 0x7FEFFFFFFFFFFFFF, 0x7FF0000000000000, 0xFFF0000000000000, 0x7FF8000000000000, 0x7FF8000000000001, 0xFFF8000000000123, 0x3FF0000000000000,
)
EDGE_LONGS = (
    exact.MIN_LONG, -1, 0, 1, 2, 99_999_999_999_999_999, 4_000_170_000_000, 1_234_567_812_345_678,
    exact.MAX_LONG, exact.MAX_LONG - 1, 9_007_199_254_740_993, 100_000_000, 10_000_000_000_000_000, 4_611_686_018_427_387_904, -9_007_199_254_740_993, 7,
)
EDGE_SYMBOL = "PAXGUSDT"
_KINDS = {"bigint": "i64", "double": "f64", "boolean": "bool", "string": "utf8"}


def placed(lines: DataFrame, order: str = "pos") -> DataFrame:
    """The rows of text files with ``pos``, counted from 0 without gaps in the order of file names and lines. Lines are counted within each split of a file and the splits are
    added up, so that no task sees a whole file."""
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    marked = lines.select("*", *split, F.monotonically_increasing_id().alias("_line"))
    inside = Window.partitionBy("_file", "_start").orderBy("_line")
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    sizes = marked.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_file", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    counted = marked.withColumn("_in", F.row_number().over(inside) - 1).join(offsets, ["_file", "_start"])
    return counted.withColumn(order, (F.col("_before") + F.col("_in")).cast("bigint")).drop("_file", "_start", "_line", "_n", "_before", "_in")


def read_csv(spark: SparkSession, path: str, symbol: str, limit: int | None = None, symbols: tuple[str, ...] = ()) -> DataFrame:
    """pos (from 0, without gaps) and the typed columns, prices and quantities times 10**8. A line that breaks the grammar fails the read: eight fields, no header, no
    quoting, no carriage return, decimals with eight digits, True or False. So do agg_ids that do not rise, times that fall, fewer than ``limit`` rows, and
    a symbol that is not among ``symbols`` (if any are given)."""
    if symbols and symbol not in symbols:
        raise ValueError("unknown symbol")
    lines = placed(spark.read.option("lineSep", "\n").text(path))
    parts = F.split("value", ",", -1)
    g = dict(zip(CSV, [F.get(parts, F.lit(i)) for i in range(8)], strict=True))
    typed = {c: exact.strict_unsigned(g[c]) for c in ("agg_id", "first_id", "last_id", "transact_time")}
    typed |= {f"{c}_e8": exact.strict_decimal(g[c]) for c in ("price", "qty")} | {c: exact.strict_bool(g[c]) for c in CSV[6:]}
    ok = (F.size(parts) == 8) & ~F.col("value").contains("\r")
    for c in typed.values():
        ok = ok & c.isNotNull()
    checked = lines.withColumn("ok", F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("refused line: "), F.col("value"))).cast("boolean")))
    if limit is not None:
        checked = checked.where(F.col("pos") < limit)
    out = checked.where("ok").select("pos", *[v.alias(k) for k, v in typed.items()], F.lit(symbol).alias("symbol"))
    if limit is not None and out.count() < limit:
        raise ValueError("fewer rows than asked for")
    if not violations(out).isEmpty():
        raise ValueError("an agg_id does not rise, or a time falls")
    return out


def violations(df: DataFrame, block: int = 32_768, key: str = "agg_id", time: str = "transact_time") -> DataFrame:
    """pos of rows whose key does not rise or whose time falls against the row before. Windows stay in blocks of positions; the first row of a block is held
    against the last row of the latest block before it, found among one row a block."""
    own = Window.partitionBy("block").orderBy("pos")
    marked = df.select("pos", F.col(key).alias("k"), F.col(time).alias("t"), F.expr(f"pos div {block}").alias("block"))
    lagged = marked.withColumn("before", F.lag(F.struct("k", "t")).over(own))
    ends = marked.groupBy("block").agg(F.max_by(F.struct("k", "t"), "pos").alias("end"))
    handed = ends.select("block", F.lag("end").over(Window.orderBy("block")).alias("end"))  # one row a block
    met = lagged.where("before IS NULL").join(handed, "block").select("pos", "k", "t", F.col("end").alias("before"))
    both = lagged.where("before IS NOT NULL").select("pos", "k", "t", "before").unionByName(met)
    return both.where((F.col("before.k") >= F.col("k")) | (F.col("before.t") > F.col("t"))).select("pos")


def sorted_by(df: DataFrame, key: str = "agg_id", block: int = 32_768) -> DataFrame:
    """rows, is_sorted: whether the key rises from row to row by pos."""
    broken = violations(df.select("pos", key, F.lit(0).alias("_still")), block, key, "_still").select(F.lit(0).alias("row"), F.lit(1).alias("bad"))
    both = df.select(F.lit(1).alias("row"), F.lit(0).alias("bad")).unionByName(broken)
    return both.agg(F.coalesce(F.sum("row"), F.lit(0)).alias("rows"), (F.coalesce(F.sum("bad"), F.lit(0)) == 0).alias("is_sorted"))


def resorted(df: DataFrame, key: str = "agg_id") -> DataFrame:
    """The rows with pos given anew in the order of the key; ties in the order they had. Counted in ranges of the key, no task sorts all rows."""
    ranged = df.repartitionByRange(F.col(key), F.col("pos")).sortWithinPartitions(key, "pos").withColumn("_part", F.spark_partition_id()).withColumn("_line", F.monotonically_increasing_id())
    inside = Window.partitionBy("_part").orderBy("_line")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    counted = ranged.withColumn("_in", F.row_number().over(inside) - 1).join(offsets, "_part")
    return counted.withColumn("pos", (F.col("_before") + F.col("_in")).cast("bigint")).drop("_part", "_line", "_in", "_before")


def normalise(df: DataFrame, names: dict[str, str], power: int = 8) -> DataFrame:
    """Doubles to integers times 10**power, renamed; a value that does not divide back to the same double, or is 2**53 or more, is an error."""
    for old, new in names.items():
        n = exact.exact_scaled(F.col(old), power)
        ok = n.isNotNull() & (F.abs(n) < 2**53)
        df = df.withColumn(new, F.when(ok, n).otherwise(F.raise_error(F.concat(F.lit("not exact: "), F.col(old).cast("string"))).cast("bigint"))).drop(old)
    return df


def denormalise(df: DataFrame, names: dict[str, str], power: int = 8) -> DataFrame:
    """Integers to doubles; one whose double does not scale back to the same integer is an error."""
    for old, new in names.items():
        v = F.col(old) / F.lit(float(10**power))
        ok = (F.abs(F.col(old)) < 2**53) & F.coalesce(exact.exact_scaled(v, power) == F.col(old), F.lit(False))
        df = df.withColumn(new, F.when(ok | F.col(old).isNull(), v).otherwise(F.raise_error(F.concat(F.lit("not exact: "), F.col(old).cast("string"))).cast("double"))).drop(old)
    return df


def _payloads(kind: str, column: pa.ChunkedArray) -> list[tuple[int, bytes]]:
    """(stage, bytes) of a stretch of a column: facts (count, bytes of text), values or lengths, text."""
    if column.null_count:
        raise ValueError("null in a column")
    if kind == "utf8":
        raw = [x.encode() for x in column.to_pylist()]
        sizes = np.array([len(x) for x in raw], "<u4")
        return [(0, np.array([len(raw), int(sizes.sum(dtype=np.uint64))], "<u8").tobytes()), (1, sizes.tobytes()), (2, b"".join(raw))]
    if kind == "bool":
        values = np.asarray(column.to_pylist(), np.uint8).tobytes()
    else:
        values = column.to_numpy().astype("<i8" if kind == "i64" else "<f8").tobytes()
    return [(0, np.array([len(column), 0], "<u8").tobytes()), (1, values)]


def _streams(df: DataFrame, order: str, columns: list[str], kinds: dict[str, str]) -> DataFrame:
    """place (of the column), stage, part, payload: stretches of columns, by ranges of ``order``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
                table = pa.Table.from_batches([batch])
                out = [(i, stage, part, n, data) for i, c in enumerate(columns) for stage, data in _payloads(kinds[c], table[c])]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["place", "stage", "part", "batch", "payload"])

    ranged = df.select(*dict.fromkeys([order, *columns])).repartitionByRange(order).sortWithinPartitions(order).select(F.spark_partition_id().alias("_part"), *columns)
    return ranged.mapInArrow(run, "place int, stage int, part int, batch int, payload binary")


def _hashed(streams: DataFrame, columns: list[str], kinds: dict[str, str], typed: bool, prefix: bytes) -> DataFrame:
    """rows, sha256 of all streams one after the other. A SHA-256 is one sequence: a single task reads the stretches in order, a few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, rows, facts, place = hashlib.sha256(), 0, np.zeros(2, np.uint64), -1
        begun = False
        for batch in batches:
            for at, stage, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), strict=True):
                if at != place:
                    place, facts, begun = at, np.zeros(2, np.uint64), False
                if stage == 0:
                    facts = facts + np.frombuffer(data.as_py(), "<u8")
                    continue
                if not begun:
                    begun, rows = True, int(facts[0])
                    if place == 0 and not typed:
                        h.update(prefix + rows.to_bytes(8, "little"))
                    if typed:
                        h.update(f"col|{columns[place]}|{kinds[columns[place]]}|{rows}\n".encode())
                        if kinds[columns[place]] == "utf8":
                            h.update(int(facts[1]).to_bytes(8, "little"))
                h.update(data.as_py())
        if place >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([h.hexdigest()], pa.string())], ["rows", "sha256"])

    return streams.repartition(1).sortWithinPartitions("place", "stage", "part", "batch").mapInArrow(run, "rows long, sha256 string")


def _kinds_of(df: DataFrame, columns: list[str]) -> dict[str, str]:
    kinds = dict(df.dtypes)
    for c in columns:
        if kinds[c] not in _KINDS:
            raise TypeError(f"unsupported type {kinds[c]} of {c}")
    return {c: _KINDS[kinds[c]] for c in columns}


def table_digest(df: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """rows, sha256 of a whole table: its columns one after another, each with name, type and count, doubles by their bits, text with its total, its lengths and its bytes; rows in
    ``order``, which is hashed only if it is among ``columns`` (all but order and block, if None). A null is an error; no rows give no digest."""
    columns = [c for c in df.columns if c not in (order, "block")] if columns is None else columns
    kinds = _kinds_of(df, columns)
    return _hashed(_streams(df, order, columns, kinds), columns, kinds, True, b"")


def columns_digest(df: DataFrame, order: str, kind: str, columns: list[str]) -> DataFrame:
    """rows, sha256 of eight long columns: a byte for the kind, the number of rows in 64 bits, then the columns' values, all little-endian."""
    kinds = _kinds_of(df, columns)
    if len(columns) != 8 or set(kinds.values()) != {"i64"} or kind not in KIND_BYTES:
        raise ValueError("eight long columns of a quote, trade or l2")
    return _hashed(_streams(df, order, columns, kinds), columns, kinds, False, bytes([KIND_BYTES[kind]]))


def edge_table(spark: SparkSession, scaled: bool = False) -> DataFrame:
    """pos, block (of 20 rows) and the nine columns of a trades table at its edges: bit patterns that text cannot express, extremes of longs, empty and non-ASCII symbols.
    ``scaled``: prices and quantities as integers."""
    i = np.arange(64)
    doubles, longs = np.array(EDGE_BITS, np.uint64).view(np.float64), np.array(EDGE_LONGS, np.int64)
    late = {60: 9_007_199_254_740_993, 61: 4_611_686_018_427_387_904, 62: exact.MAX_LONG - 1, 63: exact.MAX_LONG}
    times = 1_759_276_803_099_156 + i * 7_000_000 + i % 3
    times[60:] = (4_611_686_018_427_387_000, 4_611_686_018_427_387_904, exact.MAX_LONG - 1, exact.MAX_LONG)
    named = {3: "ZZZUSDT", 5: "", 6: "\u00c5\u00df\u20ac"}
    first = longs[i * 3 % 16]
    tail = "_e8" if scaled else ""
    made = {
        "pos": i, "block": i // 20, "agg_id": np.array([late.get(k, k) for k in range(64)]), f"price{tail}": (longs if scaled else doubles)[i % 16], f"qty{tail}": (longs if scaled else doubles)[(i * 5 + 1) % 16],
        "first_id": first, "last_id": np.where(i % 4 == 0, first, longs[i * 7 % 16]), "transact_time": times, "is_buyer_maker": i % 3 == 0, "is_best_match": i % 5 != 0,
        "symbol": [named.get(k % 8, EDGE_SYMBOL) for k in range(64)],
    }
    return spark.createDataFrame(pa.table(made))
