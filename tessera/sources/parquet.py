"""Plain Parquet and files: writer configurations, exact reads, slices, inspection, strict JSON."""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship
from . import trades

#: Writer options by configuration. Byte-stream split and BROTLI are not among what Spark's writer offers.
SINKS = {
    "plain": {"compression": "uncompressed", "parquet.enable.dictionary": "false"},
    "plain-lz4": {"compression": "lz4_raw", "parquet.enable.dictionary": "false"},
    "dictionary-lz4": {"compression": "lz4_raw", "parquet.enable.dictionary": "true"},
    "delta-lz4": {"compression": "lz4_raw", "parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
    "delta-snappy": {"compression": "snappy", "parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
    "delta-zstd": {"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}
#: Bounds of a bounded import; first bytes of formats.
MOST_BYTES, MOST_ROWS = 256 * 2**20, 1_048_576
MAGIC = {"parquet": "50415231", "gzip": "1F8B", "zstd": "28B52FFD", "zip": "504B0304"}


def write(df: DataFrame, path: str, sink: str = "plain") -> None:
    """A new Parquet folder in one of the configurations of SINKS; an existing path is an error."""
    df.write.mode("errorifexists").options(**SINKS[sink]).parquet(path)


def write_source(df: DataFrame, path: str, order: str) -> DataFrame:
    """Writes plain and uncompressed, reads back and compares the digests of both tables; returns what was read. Different digests are an error."""
    write(df, path)
    back = df.sparkSession.read.parquet(path)
    if table_of(df, order) != table_of(back, order):
        raise ValueError("what was written reads back differently")
    return back


def table_of(df: DataFrame, order: str) -> list[tuple]:
    return [tuple(r) for r in trades.table_digest(df, order, df.columns).collect()]


def read_exact(spark: SparkSession, path: str, schema: StructType, rows: int | None = None) -> DataFrame:
    """Exactly these columns, names, types and order in every file, or an error; so is another number of rows, if one is given. Footers are read where the files are."""
    want = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    for found in inspected(spark, path).select("columns").distinct().limit(2).collect():
        if [tuple(x) for x in found["columns"]] != want:
            raise ValueError(f"expected {want}, found {[tuple(x) for x in found['columns']]}")
    df = spark.read.schema(schema).parquet(path)
    if rows is not None and df.count() != rows:
        raise ValueError("another number of rows")
    return df


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified of every file below a path; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", "length", F.col("modificationTime").alias("modified"))


def tree_bytes(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def bounded(spark: SparkSession, path: str, columns: list[str], most_bytes: int = MOST_BYTES, most_rows: int = MOST_ROWS) -> DataFrame:
    """Some columns of files that are refused, before anything is read, above a number of bytes or rows."""
    df = spark.read.parquet(path)
    if tree_bytes(spark, path).first()["bytes"] > most_bytes or df.count() > most_rows:  # the count reads footers only
        raise ValueError("more bytes or rows than allowed")
    return df.select(*columns)


def rows_of(df: DataFrame, group_rows: int, group: int, skip: int, take: int) -> DataFrame:
    """``take`` rows after ``skip`` of one group of rows, by position: a range that reaches the scan. Fewer rows are an error at the end of the table only."""
    if skip < 0 or take < 0 or skip + take > group_rows:
        raise ValueError("a slice lies in one group")
    start = group * group_rows + skip
    return df.where(F.col("pos").between(start, start + take - 1))


def inspected(spark: SparkSession, path: str) -> DataFrame:
    """path, length, rows, groups, codecs, columns (name and type) of Parquet files, from their footers. Files are read whole (2 GB at the most), each in its own task."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        kinds = {"int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint", "double": "double", "float": "float", "string": "string", "large_string": "string", "bool": "boolean", "binary": "binary"}
        for batch in batches:
            for name, length, content in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                f = pq.ParquetFile(BytesIO(content))
                meta = f.metadata
                codecs = sorted({meta.row_group(g).column(c).compression for g in range(meta.num_row_groups) for c in range(meta.num_columns)})
                columns = [(x.name, kinds.get(str(x.type), str(x.type))) for x in f.schema_arrow]
                yield pa.RecordBatch.from_pylist(
                    [{"path": name, "length": length, "rows": meta.num_rows, "groups": meta.num_row_groups, "codecs": codecs, "columns": [{"name": n, "type": t} for n, t in columns]}],
                    pa.schema([("path", pa.string()), ("length", pa.int64()), ("rows", pa.int64()), ("groups", pa.int32()), ("codecs", pa.list_(pa.string())), ("columns", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())])))]),
                )

    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return f.select("path", "length", "content").mapInArrow(run, "path string, length long, rows long, groups int, codecs array<string>, columns array<struct<name:string,type:string>>")


def kind_of(content: Column) -> Column:
    """The format by the first bytes, never by name."""
    head, found = F.hex(F.substring(content, 1, 4)), F.lit("unknown")
    for name, magic in MAGIC.items():
        found = F.when(F.startswith(head, F.lit(magic)), F.lit(name)).otherwise(found)
    return found


def file_report(spark: SparkSession, path: str) -> DataFrame:
    """file, length, format and sha256 of whole files (2 GB at the most each)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", kind_of(F.col("content")).alias("format"), F.sha2("content", 256).alias("sha256"))


def strict_json(text: Column, schema: StructType) -> Column:
    """The typed value of JSON text. Malformed text, wrong types, missing fields and unknown fields, at every level, are errors."""
    parsed = F.from_json(text, schema, {"mode": "FAILFAST"})

    def known(inner: Column, kind: StructType) -> Column:
        names = F.json_object_keys(inner)
        ok = F.size(F.array_except(names, F.array(*[F.lit(n) for n in kind.names]))) == 0
        ok = ok & (F.size(names) == F.size(F.array_distinct(names)))
        for f in kind.fields:
            if not f.nullable:
                ok = ok & F.array_contains(names, f.name)
            if isinstance(f.dataType, StructType):
                part = F.get_json_object(inner, f"$.{f.name}")
                ok = ok & F.when(part.isNull(), F.lit(True)).otherwise(known(part, f.dataType))
        return F.coalesce(ok, F.lit(False))

    return F.when(known(text, schema), parsed).otherwise(F.raise_error(F.lit("unknown or missing field")))


def restamped(df: DataFrame, names: dict[str, str], metadata: dict[str, dict] | None = None) -> DataFrame:
    """Columns renamed, and their metadata set; values are not touched."""
    out = df.withColumnsRenamed(names)
    for column, facts in (metadata or {}).items():
        out = out.withMetadata(column, facts)
    return out
