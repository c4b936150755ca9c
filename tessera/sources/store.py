"""Block store: Parquet in the order of (block, pos) and an index of blocks that is written last, as the commit.

Layout: ``data/<attempt>/`` holds the rows of one write, ``index/`` one row a block: its facts, the attempt and file that hold it, the bytes it expands to,
and a checksum of its rows. Readers open only what the index names, so that rows of a write that never came to its index are not there for them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThanOrEqual
from pyspark.sql.types import BooleanType, ByteType, DoubleType, LongType, StringType, StructType, TimestampType

from ..operators.columns import facts_of, zone_map
from ..session import scratch_dir, ship

#: The limits of a store and of contract metadata.
MOST_BLOCKS, MOST_ROWS, MOST_COLUMNS, MOST_DECIMALS = 100_000, 1_048_576, 64, 12
_TYPES = (LongType, DoubleType, BooleanType, StringType, ByteType, TimestampType)
FACTS = ["rows", "min_time", "max_time", "symbols"]
INDEX = "block long, rows long, min_time long, max_time long, symbols array<string>, attempt string, file string, bytes long, checksum string"


def gate(schema: StructType, time: str = "t", symbol: str = "symbol") -> None:
    """Refuses what a store cannot hold exactly: other types, too many or repeated columns, wrong index columns."""
    names = schema.names
    if not 1 <= len(names) <= MOST_COLUMNS or len(set(names)) != len(names) or not all(1 <= len(n) <= 128 for n in names):
        raise ValueError("1 to 64 columns with different names of 1 to 128 characters")
    for f in schema.fields:
        if not isinstance(f.dataType, _TYPES):
            raise TypeError(f"unsupported type {f.dataType.simpleString()} of {f.name}")
    if not isinstance(schema[time].dataType, LongType) or not isinstance(schema[symbol].dataType, StringType):
        raise TypeError("the index needs a long time and a string symbol")


def contract(metadata: dict, schema: StructType) -> None:
    """The normalized contract of trades, quotes and book levels: family, version, source hash, decimals, required columns."""
    family, columns = metadata.get("family"), {f.name: f.dataType.simpleString() for f in schema.fields}
    if family not in ("tick", "book") or metadata.get("schema_version") != 1:
        raise ValueError("unknown family or version")
    source = metadata.get("source_sha256", "")
    if len(source) != 64 or set(source) - set("0123456789abcdef") or set(source) == {"0"}:
        raise ValueError("the source hash is 64 lower-case hex digits, not all zero")
    for k in ("price_decimals", "quantity_decimals"):
        if not isinstance(metadata.get(k), int) or not 0 <= metadata[k] <= MOST_DECIMALS:
            raise ValueError(f"{k} is 0 to 12")
    if family == "book" and not 1 <= metadata.get("depth", 0) <= 100_000:
        raise ValueError("depth is 1 to 100,000")
    if family == "tick" and metadata.get("subtype") not in ("trade", "quote"):
        raise ValueError("a tick is a trade or a quote")
    common = dict.fromkeys(("source_utc_ns", "received_utc_ns", "clock_error_ns", "available_utc_ns", "sequence"), "bigint") | {"symbol": "string"}
    sided = {"price": "bigint", "quantity": "bigint", "side": "tinyint"}
    needed = common | (sided | {"level": "bigint", "action": "tinyint"} if family == "book" else sided if metadata["subtype"] == "trade" else dict.fromkeys(("bid", "ask", "bid_quantity", "ask_quantity"), "bigint"))
    wrong = [c for c, kind in needed.items() if columns.get(c) != kind]
    if wrong:
        raise ValueError(f"missing or mistyped: {', '.join(wrong)}")


def _bits(schema: StructType) -> list[Column]:
    """Columns as they are hashed: doubles by their shortest text, which tells the zeros apart (hash functions fold them)."""
    return [F.col(f.name).cast("string") if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in schema.fields]


def _row_hashes(schema: StructType) -> list[Column]:
    named = [F.struct(F.lit(i).alias("i"), c.isNull().alias("null"), c.alias("value")) for i, c in enumerate(_bits(schema))]
    return [F.xxhash64(*named).alias("_h"), F.xxhash64(F.lit("second"), *named).alias("_g")]


def _checksum() -> Column:
    total = F.sum(F.col("_h").cast("decimal(38,0)")).cast("string")
    packed = F.concat_ws("|", F.count(F.lit(1)).cast("string"), total, F.bit_xor("_g").cast("string"))
    return F.concat(F.lpad(F.hex(F.crc32(packed.cast("binary"))), 8, "0"), F.lpad(F.hex(F.bit_xor("_h")), 16, "0")).alias("checksum")


def checksums(df: DataFrame) -> DataFrame:
    """block, checksum: of the set of a block's rows (``pos`` is one of the columns, so order counts); partial aggregation, no sort.

    CRC-32 of the count, the sum and the exclusive or of two 64-bit row hashes. Null and absent differ, since each null has its place in the row's hash."""
    return df.select("block", *_row_hashes(df.schema)).groupBy("block").agg(_checksum())


def index_of(df: DataFrame) -> DataFrame:
    return zone_map(df)


def differing(a: DataFrame, b: DataFrame, fields: list[str] = FACTS) -> DataFrame:
    """blocks, differing: how many blocks two indexes have, and in how many they disagree."""
    x, y = (i.select("block", F.struct(*fields).alias(n)) for i, n in ((a, "x"), (b, "y")))
    return x.join(y, "block", "full").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("differing"))


def insane(index: DataFrame) -> DataFrame:
    """Rows of an index that cannot be: wrong row counts, reversed times, symbols that are missing, repeated or unsorted, a block twice."""
    ok = (F.col("rows").between(1, MOST_ROWS)) & (F.col("min_time") <= F.col("max_time")) & (F.size("symbols") > 0)
    ok = ok & (F.sort_array(F.array_distinct("symbols")) == F.col("symbols"))
    often = F.count(F.lit(1)).over(Window.partitionBy("block"))
    return index.withColumn("_often", often).where(~F.coalesce(ok, F.lit(False)) | (F.col("_often") > 1)).drop("_often")


def _described(spark: SparkSession, path: str, attempt: str) -> DataFrame:
    """Index rows of one attempt, from what was written."""
    df = spark.read.parquet(f"{path}/data/{attempt}")
    wide = sum((F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") if isinstance(f.dataType, StringType) else F.lit(8).cast("long") for f in df.schema.fields), F.lit(0).cast("long"))
    rows = df.select("block", "t", "symbol", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("_file"), wide.alias("_wide"), *_row_hashes(df.schema))
    file = F.when(F.min("_file") == F.max("_file"), F.min("_file")).alias("file")  # null: in several files
    facts = rows.groupBy("block").agg(*facts_of("t", "symbol"), file, F.sum("_wide").alias("bytes"), _checksum())
    return facts.select("block", *FACTS, F.lit(attempt).alias("attempt"), "file", "bytes", "checksum")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.index = spark.read.schema(INDEX).parquet(f"{self.path}/index")
        self._rows: list | None = None
        self._schema: StructType | None = None

    def blocks(self) -> list:
        """The index on the driver, in the order of blocks (MOST_BLOCKS rows at the most), refused where it cannot be."""
        if self._rows is None:
            rows = self.index.orderBy("block").limit(MOST_BLOCKS + 1).collect()
            if len(rows) > MOST_BLOCKS or len({r["block"] for r in rows}) < len(rows):
                raise ValueError("too many blocks, or a block twice")
            for r in rows:
                symbols = list(r["symbols"] or [])
                if not 1 <= r["rows"] <= MOST_ROWS or r["min_time"] > r["max_time"] or not symbols or symbols != sorted(set(symbols)):
                    raise ValueError(f"the index of block {r['block']} cannot be")
            self._rows = rows
        return self._rows

    @property
    def schema(self) -> StructType:
        if self._schema is None:
            rows = self.blocks()
            if not rows:
                raise ValueError("an empty store")
            self._schema = self.spark.read.parquet(f"{self.path}/data/{rows[0]['attempt']}").schema
        return self._schema

    def _files(self, rows: list) -> list[str]:
        return sorted({f"{self.path}/data/{r['attempt']}" + (f"/{r['file']}" if r["file"] else "") for r in rows})

    def _read(self, rows: list) -> DataFrame:
        """All rows of the given blocks; opens only their files."""
        if not rows:
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.schema(self.schema).parquet(*self._files(rows))
        numbers = sorted(r["block"] for r in rows)
        whole = numbers == list(range(numbers[0], numbers[0] + len(numbers)))
        return df.where(F.col("block").between(numbers[0], numbers[-1]) if whole else F.col("block").isin(numbers))

    def read_all(self) -> DataFrame:
        return self._read(self.blocks())

    data = property(read_all)

    def totals(self) -> dict[str, int]:
        """Metadata alone: blocks, rows, columns, bytes they expand to, attempts."""
        rows = self.blocks()
        return {"blocks": len(rows), "rows": sum(r["rows"] for r in rows), "columns": len(self.schema.names), "bytes": sum(r["bytes"] for r in rows), "attempts": len({r["attempt"] for r in rows})}

    def _bounded(self, rows: list, most_rows: int | None, most_bytes: int | None) -> list:
        """Refuses before anything is read."""
        if most_rows is not None and sum(r["rows"] for r in rows) > most_rows or most_bytes is not None and sum(r["bytes"] for r in rows) > most_bytes:
            raise ValueError("more rows or bytes than allowed")
        return rows

    def read_block(self, block: int, most_rows: int | None = None, most_bytes: int | None = None, check: bool = False) -> DataFrame:
        """One block; its row and byte counts are checked against the index before anything is read, its checksum on demand."""
        known = [r for r in self.blocks() if r["block"] == block]
        if not known:
            raise ValueError("no such block")
        rows = self._read(self._bounded(known, most_rows, most_bytes))
        if check and [r["checksum"] for r in checksums(rows).collect()] != [known[0]["checksum"]]:
            raise ValueError(f"block {block} is not what was written")
        return rows

    def visit(self, visitor) -> None:
        """visitor(rows of one block) in order, one block at a time, until it returns False."""
        for row in self.blocks():
            if visitor(self._read([row])) is False:
                return

    def restore(self, into: DataFrame, visitor) -> DataFrame:
        """Another frame's blocks through visitor(rows of a block), one after the other, as one frame."""
        made = [visitor(self._read([r])) for r in self.blocks()]
        for df in made:
            into = into.unionByName(df)
        return into

    def hit(self, symbol: str, start: int, end: int) -> list:
        if start > end:
            raise ValueError("reversed range")
        return [r for r in self.blocks() if r["max_time"] >= start and r["min_time"] <= end and symbol in r["symbols"]]

    def range_query(self, symbol: str, start: int, end: int, most_rows: int | None = None, most_bytes: int | None = None) -> DataFrame:
        """Rows of a symbol with start <= t <= end: only files of blocks that can hold such rows are opened, and symbol, time and block are pushed into them."""
        rows = self._bounded(self.hit(symbol, start, end), most_rows, most_bytes)
        return self._read(rows).where((F.col("symbol") == symbol) & F.col("t").between(start, end))

    def stats(self, symbol: str, start: int, end: int) -> DataFrame:
        rows = self.hit(symbol, start, end)
        return self.spark.createDataFrame([(len(rows), sum(r["rows"] for r in rows))], "blocks_read long, rows_read long")

    def verify(self) -> bool:
        return self.differing().first()["differing"] == 0

    def differing(self) -> DataFrame:
        """blocks, differing: against facts and checksums of the rows as they are."""
        rows = self.read_all()
        return differing(self.index, zone_map(rows).join(checksums(rows), "block"), [*FACTS, "checksum"])


def _refuse(df: DataFrame) -> None:
    gate(df.schema)
    unset = F.col("t").isNull() | F.col("symbol").isNull() | F.col("block").isNull()
    counted = df.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.count_if(unset).alias("unset"))
    if not counted.where((F.col("n") > MOST_ROWS) | (F.col("unset") > 0)).isEmpty():
        raise ValueError("a block is too long, or an index column has a null")


def _commit(df: DataFrame, path: str, partitions: int | None, mode: str, options: dict[str, str]) -> None:
    """Rows into a folder of their own, then their index rows; only these make the rows part of the store."""
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    dealt = df.repartitionByRange(partitions, "block") if partitions else df.repartitionByRange("block")
    dealt.sortWithinPartitions("block", "pos").write.options(**options).mode("errorifexists").parquet(f"{path}/data/{attempt}")
    _described(spark, path, attempt).coalesce(1).write.mode(mode).parquet(f"{path}/index")


def write(df: DataFrame, path: str, partitions: int | None = None, **options: str) -> Store:
    """A new store of a frame with block, pos, t, symbol. An existing path is an error; the index goes last. ``options``: of the Parquet writer (see parquet.SINKS)."""
    path = path.rstrip("/")
    _refuse(df)
    if exists(df.sparkSession, f"{path}/index"):
        raise ValueError("there is a store already")
    _commit(df, path, partitions, "errorifexists", options)
    return Store(df.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append(df: DataFrame, path: str, partitions: int | None = None, **options: str) -> None:
    """Further blocks: rows first, index last. A block that the store has is an error; a write that ended before its index leaves a folder that no reader
    opens, and may be written again."""
    path, spark = path.rstrip("/"), df.sparkSession
    _refuse(df)
    if exists(spark, f"{path}/index"):
        known = spark.read.schema(INDEX).parquet(f"{path}/index")
        new = df.select("block").distinct()
        if not new.join(known, "block", "left_semi").isEmpty():
            raise ValueError("the store has such a block")
        if known.count() + new.count() > MOST_BLOCKS:
            raise ValueError("too many blocks")
    _commit(df, path, partitions, "append", options)


def temporary(df: DataFrame) -> Store:
    return write(df, f"{scratch_dir(df.sparkSession)}/store-{uuid.uuid4().hex}")


_kept: dict[tuple[str, str], Store] = {}


def kept(spark: SparkSession, name: str, make) -> Store:
    """A store in the shared folder under a name, made at the first use in a session and read from then on."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _kept:
        _kept[key] = temporary(make())
    return _kept[key]


def recover_frames(frames: DataFrame) -> DataFrame:
    """The longest prefix of complete blocks. A complete block before the cut with a wrong checksum is corruption, not a crash: an error.

    frames: block, complete, crc_ok (one row a block).
    """
    cut = F.min(F.when(~F.col("complete"), F.col("block"))).over(Window.partitionBy())
    kept = frames.withColumn("cut", cut).where(F.col("cut").isNull() | (F.col("block") < F.col("cut"))).drop("cut")
    return kept.where(F.when(F.col("crc_ok"), F.lit(True)).otherwise(F.raise_error(F.lit("corrupt block")).cast("boolean")))


def frames(spark: SparkSession, path: str) -> DataFrame:
    """block, rows, complete, crc_ok of every indexed block, from the files that are there. A folder that is gone leaves its blocks incomplete."""
    old = Store(spark, path)
    there = [r for r in old.blocks() if exists(spark, old._files([r])[0])]
    if not there:
        return old.index.select("block", "rows", F.lit(False).alias("complete"), F.lit(False).alias("crc_ok"))
    rows = old._read(there)
    now = zone_map(rows).select("block", F.col("rows").alias("now")).join(checksums(rows).withColumnRenamed("checksum", "found"), "block")
    complete, right = F.coalesce(F.col("now") >= F.col("rows"), F.lit(False)), F.coalesce(F.col("found") == F.col("checksum"), F.lit(False))
    return old.index.join(now, "block", "left").select("block", "rows", complete.alias("complete"), right.alias("crc_ok"))


def recover(spark: SparkSession, path: str, new: str) -> Store:
    """Indexed blocks whose rows are all there, up to the first that is not, as a new store; a complete one that differs from its checksum is an error. The old store is left alone."""
    old = Store(spark, path)
    good = {r["block"] for r in recover_frames(frames(spark, path)).select("block").collect()}  # at most MOST_BLOCKS
    return write(old._read([r for r in old.blocks() if r["block"] in good]), new)


class _Part(InputPartition):
    def __init__(self, blocks: list[int], files: list[str]):
        self.blocks, self.files = blocks, files


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.index, self.names = json.loads(options["index"]), schema.names
        self.symbol, self.low, self.high = None, None, None

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("symbol",):
                self.symbol = f.value
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("t",):
                self.low = f.value
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("t",):
                self.high = f.value
            yield f  # Spark applies the exact filter again

    def partitions(self) -> list[_Part]:
        files: dict[str, list[int]] = {}
        for block, low, high, symbols, file in self.index:
            if (self.symbol is None or self.symbol in symbols) and (self.low is None or high >= self.low) and (self.high is None or low <= self.high):
                files.setdefault(file, []).append(block)
        return [_Part(blocks, [file]) for file, blocks in files.items()] or [_Part([], [])]

    def read(self, part: _Part) -> Iterator:
        import pyarrow.dataset as ds

        if part.blocks:
            yield from ds.dataset(part.files, format="parquet").to_table(columns=self.names, filter=ds.field("block").isin(part.blocks)).to_batches()


class BlockSource(DataSource):
    """A store as a data source that prunes blocks, and with them files, from pushed filters; for files that pyarrow can open."""

    @classmethod
    def name(cls) -> str:
        return "tessera_blocks"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.options["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def as_source(opened: Store) -> DataFrame:
    """The store through BlockSource; its index (at most 100,000 blocks) travels as an option. A partition opens the one file (or folder) of its blocks."""
    spark = opened.spark
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockSource)
    index = [[r["block"], r["min_time"], r["max_time"], list(r["symbols"]), opened._files([r])[0].removeprefix("file://")] for r in opened.blocks()]
    return spark.read.format("tessera_blocks").options(schema=opened.schema.json(), index=json.dumps(index)).load()
