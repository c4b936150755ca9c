"""Block facts and reversible column transforms. Frames carry ``block`` and ``pos`` (row order in the stored table);
every window is inside a block, so transforms scale with the number of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..session import ship

SAMPLE, GROUP, RAW = 1024, 128, 255


def in_order() -> Window:
    return Window.partitionBy("block").orderBy("pos")


def before() -> Window:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def blocks(df: DataFrame, rows: int) -> DataFrame:
    """Adds ``block``: fixed numbers of rows by position; the last may be short."""
    return df.withColumn("block", F.expr(f"pos div {rows}"))


def facts_of(time: str, symbol: str) -> list[Column]:
    """Aggregates of a zone map: rows, min_time, max_time, symbols (sorted, distinct)."""
    return [F.count(F.lit(1)).alias("rows"), F.min(time).alias("min_time"), F.max(time).alias("max_time"), F.sort_array(F.collect_set(symbol)).alias("symbols")]


def zone_map(df: DataFrame, time: str = "t", symbol: str = "symbol") -> DataFrame:
    """block, rows, min_time, max_time, symbols: all by partial aggregation."""
    return df.groupBy("block").agg(*facts_of(time, symbol))


def column_params(df: DataFrame, column: str) -> DataFrame:
    """block, base (min), scale (gcd of offsets, 1 at least), bits of the largest quotient. Offsets wrap to unsigned 64 bits; a scale above a long is its bit pattern."""
    ship(df.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        base, scale, bits = _params(table[column].to_numpy().astype(np.int64))
        return pa.table({"block": [table["block"][0].as_py()], "base": [base], "scale": pa.array(np.array([scale], np.uint64).view(np.int64)), "bits": pa.array([bits], pa.int32())})

    return df.select("block", column).groupBy("block").applyInArrow(run, "block long, base long, scale long, bits int")


def delta(df: DataFrame, column: str, out: str = "residual") -> DataFrame:
    """Wrapping difference from the row before; 0 in the first row, whose value is kept as ``origin``."""
    v = F.col(column)
    return df.withColumn("origin", F.first(column).over(before())).withColumn(out, F.coalesce(exact.sub(v, F.lag(column).over(in_order())), F.lit(0)))


def undelta(df: DataFrame, residual: str = "residual", out: str = "restored") -> DataFrame:
    total = F.sum(exact.wide(F.col(residual))).over(before())
    return df.withColumn(out, exact.wrap(total + exact.wide(F.col("origin"))))


def linear(df: DataFrame, column: str, out: str = "residual") -> DataFrame:
    """Wrapping difference from origin + step * i; step is the difference of the first two rows (0 if there is one row)."""
    w = in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i = exact.wide(F.row_number().over(in_order()) - 1)
    df = df.withColumn("origin", F.first(column).over(w)).withColumn("second", F.coalesce(F.nth_value(column, 2).over(w), F.first(column).over(w)))
    df = df.withColumn("step", exact.sub(F.col("second"), F.col("origin"))).drop("second")
    return df.withColumn(out, exact.wrap(exact.wide(F.col(column)) - exact.wide(F.col("origin")) - exact.wide(F.col("step")) * i))


def unlinear(df: DataFrame, residual: str = "residual", out: str = "restored") -> DataFrame:
    i = exact.wide(F.row_number().over(in_order()) - 1)
    return df.withColumn(out, exact.wrap(exact.wide(F.col(residual)) + exact.wide(F.col("origin")) + exact.wide(F.col("step")) * i))


def reference(df: DataFrame, column: str, other: str, out: str = "residual") -> DataFrame:
    return df.withColumn(out, exact.sub(F.col(column), F.col(other)))


def unreference(df: DataFrame, other: str, residual: str = "residual", out: str = "restored") -> DataFrame:
    return df.withColumn(out, exact.add(F.col(residual), F.col(other)))


def runs(df: DataFrame, column: str) -> DataFrame:
    """block, run (from 1), value, length: equal neighbours as one row."""
    changed = F.when(F.col(column).eqNullSafe(F.lag(column).over(in_order())) & (F.row_number().over(in_order()) > 1), 0).otherwise(1)
    marked = df.select("block", "pos", column).withColumn("changed", changed).withColumn("run", F.sum("changed").over(before()))
    return marked.groupBy("block", "run").agg(F.first(column).alias("value"), F.count(F.lit(1)).alias("length"))


def unruns(df: DataFrame) -> DataFrame:
    """block, i (from 0), value of every row that runs() folded."""
    start = F.sum("length").over(Window.partitionBy("block").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return df.withColumn("start", start).select("block", "value", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("i"))


def run_decision(df: DataFrame, column: str) -> DataFrame:
    """block, rows, runs, rle: whether runs are at most a quarter of the rows."""
    counted = runs(df, column).groupBy("block").agg(F.sum("length").alias("rows"), F.count(F.lit(1)).alias("runs"))
    return counted.withColumn("rle", F.col("runs") <= F.floor(F.col("rows") / 4))


def _quotients(v: np.ndarray, base: int, scale: int) -> np.ndarray:
    """Wrapping offsets from the base, divided by the scale, as unsigned 64 bits."""
    return (v.view(np.uint64) - np.int64(base).view(np.uint64)) // np.uint64(scale)


def _params(v: np.ndarray) -> tuple[int, int, int]:
    """Base, scale (unsigned) and bits of the largest quotient."""
    base = int(v.min())
    offsets = v.view(np.uint64) - np.int64(base).view(np.uint64)
    scale = max(1, int(np.gcd.reduce(np.unique(offsets))))
    return base, scale, (int(offsets.max()) // scale).bit_length()


def _in_order(table: pa.Table, column: str) -> np.ndarray:
    return table.sort_by("pos")[column].to_numpy().astype(np.int64)


def pack_groups(df: DataFrame, column: str) -> DataFrame:
    """block, part (of 128 rows), base, scale (bit pattern), width, rows, payload: quotients bit by bit, the lowest bit first, in ``width`` bits each, filled up to
    128; width 255 marks a raw group of 64-bit quotients, where 32 bits do not suffice. One task a block."""
    ship(df.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        v, out = _in_order(table, column), []
        base, scale, _ = _params(v)
        q = _quotients(v, base, scale)
        for part, at in enumerate(range(0, len(q), GROUP)):
            group = q[at : at + GROUP]
            width = int(group.max()).bit_length()
            if width > 32:
                payload, width = group.astype("<u8").tobytes(), RAW
            else:
                full = np.zeros(GROUP, np.uint64)
                full[: len(group)] = group
                payload = np.packbits((full[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
            out.append((part, width, len(group), payload))
        n = len(out)
        columns = [pa.array([table["block"][0].as_py()] * n, pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([base] * n, pa.int64())]
        columns += [pa.array(np.full(n, scale, np.uint64).view(np.int64)), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.binary())]
        return pa.table(columns, ["block", "part", "base", "scale", "width", "rows", "payload"])

    return df.select("block", "pos", column).groupBy("block").applyInArrow(run, "block long, part long, base long, scale long, width int, rows int, payload binary")


def unpack_groups(packed: DataFrame) -> DataFrame:
    """block, i (place in the block, from 0) and value of every row that pack_groups() packed; group by group, without a shuffle."""
    ship(packed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks_, places, values = [], [], []
            for r in batch.to_pylist():
                if r["width"] == RAW:
                    q = np.frombuffer(r["payload"], "<u8").astype(np.uint64)
                else:
                    bits = np.unpackbits(np.frombuffer(r["payload"], np.uint8), bitorder="little").reshape(GROUP, -1)[: r["rows"]].astype(np.uint64)
                    q = (bits << np.arange(r["width"], dtype=np.uint64)).sum(1, dtype=np.uint64)
                v = q * np.int64(r["scale"]).view(np.uint64) + np.int64(r["base"]).view(np.uint64)
                values.append(v.view(np.int64))
                places.append(np.arange(r["rows"]) + GROUP * r["part"])
                blocks_.append(np.full(r["rows"], r["block"]))
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (blocks_, places, values)], ["block", "i", "value"])

    return packed.mapInArrow(run, "block long, i long, value long")


def group_widths(df: DataFrame, column: str) -> DataFrame:
    """block, part (of 128 rows), width of the largest quotient, bytes: packed, or raw where 32 bits do not suffice."""
    ship(df.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        v = _in_order(table, column)
        base, scale, _ = _params(v)
        q = _quotients(v, base, scale)
        starts = np.arange(0, len(q), GROUP)
        width = np.array([int(x).bit_length() for x in np.maximum.reduceat(q, starts)])
        size = np.where(width > 32, 1 + 8 * np.diff(np.append(starts, len(q))), 1 + 16 * width)
        return pa.table({"block": pa.array(np.full(len(starts), table["block"][0].as_py())), "part": pa.array(np.arange(len(starts))), "width": pa.array(width, pa.int32()), "bytes": pa.array(size, pa.int64())})

    return df.select("block", "pos", column).groupBy("block").applyInArrow(run, "block long, part long, width int, bytes long")


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """block, value, id: distinct values in first-seen order; a null row counts as the empty string."""
    first = df.select("block", "pos", F.coalesce(F.col(column), F.lit("")).alias("value")).groupBy("block", "value").agg(F.min("pos").alias("seen"))
    return first.select("block", "value", (F.row_number().over(Window.partitionBy("block").orderBy("seen")) - 1).cast("bigint").alias("id"))


def encode_dictionary(df: DataFrame, column: str) -> DataFrame:
    """block, pos, id, valid of every row."""
    words = dictionary(df, column)
    coded = df.select("block", "pos", F.coalesce(F.col(column), F.lit("")).alias("value"), F.col(column).isNotNull().alias("valid"))
    return coded.join(words, ["block", "value"]).select("block", "pos", "id", "valid")


def decode_dictionary(coded: DataFrame, words: DataFrame) -> DataFrame:
    return coded.join(words, ["block", "id"]).select("block", "pos", F.when(F.col("valid"), F.col("value")).alias("value"))


def string_budget(df: DataFrame, columns: list[str], limit: int = 128 * 2**20) -> DataFrame:
    """block, bytes of all valid strings, whether they are within the limit that the columns share."""
    total = sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in columns), F.lit(0))
    return df.groupBy("block").agg(total.cast("bigint").alias("bytes")).withColumn("within", F.col("bytes") <= limit)


def expansion_estimate(df: DataFrame, columns: int, fields: int, strings: list[str], limit: int = 128 * 2**20) -> DataFrame:
    """block, estimate: rows * (columns + fields) * 8 and rows * widest entry for each string column; an upper bound on decoded bytes."""
    n = F.count(F.lit(1))
    total = n * (columns + fields) * 8
    for c in strings:
        total = total + n * F.coalesce(F.max(F.octet_length(c)), F.lit(0))
    return df.groupBy("block").agg(total.cast("bigint").alias("estimate")).withColumn("within", F.col("estimate") <= limit)


def scale_selection(df: DataFrame, column: str) -> DataFrame:
    """block, power, scaled: the smallest power of ten (0 to 9) exact on the first 1,024 rows, and whether it is exact on all; else raw bits."""
    place = F.row_number().over(in_order())
    powers = [exact.exact_scaled(F.col(column), k).isNotNull() | F.col(column).isNull() for k in range(10)]
    tested = df.select("block", (place <= SAMPLE).alias("early"), F.array(*powers).alias("ok"))
    every = [F.every(F.col("ok")[k] | ~F.col("early")).alias(f"e{k}") for k in range(10)] + [F.every(F.col("ok")[k]).alias(f"a{k}") for k in range(10)]
    found = tested.groupBy("block").agg(*every)
    pick = F.coalesce(*[F.when(F.col(f"e{k}"), F.lit(k)) for k in range(10)])
    proven = F.coalesce(F.element_at(F.array(*[F.col(f"a{k}") for k in range(10)]), pick + 1), F.lit(False))
    return found.select("block", pick.alias("power"), proven.alias("scaled"))


def predictor_choice(df: DataFrame, column: str, others: list[str] = ()) -> DataFrame:
    """block, predictor, bits: the lowest bit width of residuals over the first 1,024 rows (delta costs one more); ties in the order absolute, delta, linear, others.
    One pass over a block's rows scores all forms."""
    ship(df.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").slice(0, SAMPLE)
        v = table[column].to_numpy().astype(np.int64).view(np.uint64)
        step = v[min(1, len(v) - 1)] - v[0]
        forms = [("absolute", v, 0), ("delta", np.concatenate((np.zeros(1, np.uint64), v[1:] - v[:-1])), 1), ("linear", v - v[0] - step * np.arange(len(v), dtype=np.uint64), 0)]
        forms += [(f"reference:{o}", v - table[o].to_numpy().astype(np.int64).view(np.uint64), 0) for o in others]
        bits, _, name = min((_params(x.view(np.int64))[2] + cost, rank, name) for rank, (name, x, cost) in enumerate(forms))
        return pa.table({"block": table["block"][:1], "predictor": [name], "bits": pa.array([bits], pa.int32())})

    return df.select("block", "pos", column, *others).groupBy("block").applyInArrow(run, "block long, predictor string, bits int")


def bits_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often, doubles compared by their bits (so -0.0 differs from 0.0, and not-a-numbers by their payload)."""
    if a.schema.simpleString() != b.schema.simpleString():
        return False

    def bits(df: DataFrame) -> DataFrame:
        doubles = {c for c, kind in df.dtypes if kind == "double"}
        if not doubles:
            return df
        ship(df.sparkSession)
        schema = ", ".join(f"`{c}` {'long' if c in doubles else kind}" for c, kind in df.dtypes)

        def of(c: pa.Array) -> pa.Array:
            """The values' buffer read as longs; nulls stay null."""
            return pa.Array.from_buffers(pa.int64(), len(c), c.buffers(), c.null_count, c.offset)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([of(c) if n in doubles else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

        return df.mapInArrow(run, schema)

    x, y = bits(a), bits(b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def monotonic_violations(df: DataFrame, key: str, time: str) -> DataFrame:
    """block, pos of rows whose key does not rise or whose time falls against the row before."""
    w = in_order()
    bad = (F.lag(key).over(w) >= F.col(key)) | (F.lag(time).over(w) > F.col(time))
    return df.withColumn("bad", bad).where("bad").select("block", "pos")


def range_query(df: DataFrame, symbol: str, start: int, end: int, zones: DataFrame | None = None, time: str = "t", column: str = "symbol") -> DataFrame:
    """Rows of one symbol with start <= time <= end, all columns. With a zone map only blocks that can hold such rows are read.

    A reversed range is an error. Order by (block, pos) at output only.
    """
    if start > end:
        raise ValueError("reversed range")
    exact_rows = (F.col(column) == symbol) & F.col(time).between(start, end)
    if zones is None:
        return df.where(exact_rows)
    return df.join(touched(zones, symbol, start, end).select("block"), "block", "left_semi").where(exact_rows)


def touched(zones: DataFrame, symbol: str, start: int, end: int) -> DataFrame:
    return zones.where((F.col("max_time") >= start) & (F.col("min_time") <= end) & F.array_contains("symbols", symbol))


def middle_window(df: DataFrame, width: int, time: str = "t") -> tuple[int, int]:
    """Time of the middle row and ``width`` later (no later than the largest long)."""
    n = df.count()
    start = df.where(F.col("pos") == n // 2).select(time).first()[0]
    return start, min(start + width, exact.MAX_LONG)


def planes(df: DataFrame, column: str) -> DataFrame:
    """block, pos and byte planes p0..p7 of the offsets from the block's base."""
    joined = df.select("block", "pos", column).join(df.groupBy("block").agg(F.min(column).alias("base")), "block")
    q = exact.sub(F.col(column), F.col("base"))
    return joined.select("block", "pos", "base", *[exact.byte_plane(q, k).alias(f"p{k}") for k in range(8)])


def unplanes(df: DataFrame) -> Column:
    return exact.add(exact.merge_planes([F.col(f"p{k}") for k in range(8)]), F.col("base"))
