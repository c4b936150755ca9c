"""Command line: python -m tessera COMMAND ...; every command prints JSON or a Markdown table."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evidence
from .plans import phases
from .session import session
from .sources import codec, parquet, store, trades


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *args: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        for a in args:
            p.add_argument(a)
        return p

    add("inspect", "totals, schema and checks of a store", "path")
    add("verify", "whether a store is what was written", "path")
    add("recover", "the whole blocks of a store before a crash, as a new store", "path", "new")
    add("query", "rows of a symbol in a range of time", "path", "symbol", "start", "end")
    add("validate", "the verdict of a contract (JSON metadata) on a store", "path", "metadata")
    add("demo", "three rows of a family as a new segment", "family", "path")
    p = add("csv", "trades CSV into a new plain Parquet table, digests compared", "path", "symbol", "new")
    p.add_argument("--limit", type=int)
    p = add("synthetic-edge", "the edge table as a new plain Parquet table", "new")
    p.add_argument("--scaled", action="store_true")
    add("digest", "the digest of a plain Parquet table", "path", "order")
    add("files", "length, format and hash of every file below a path", "path")
    add("seal", "one hash over all files below a path", "path")
    p = add("measure", "candidates through all phases, from a store", "path")
    p.add_argument("--rounds", type=int, default=3)
    p.add_argument("--candidates", nargs="+", default=list(parquet.SINKS))
    p = add("blocks", "packed columns of generated tables")
    p.add_argument("--sizes", type=int, nargs="+", default=[4096])
    p.add_argument("--repetitions", type=int, default=3)
    p.add_argument("--seed-offset", type=int, default=0)
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    def rows(df: DataFrame) -> str:
        return codec.markdown(df)

    if args.command == "inspect":
        return json.dumps(codec.report(spark, args.path), indent=1)
    if args.command == "verify":
        return json.dumps({"verified": store.Store(spark, args.path).verify()})
    if args.command == "recover":
        return json.dumps(store.recover(spark, args.path, args.new).totals())
    if args.command == "query":
        return rows(store.Store(spark, args.path).range_query(args.symbol, int(args.start), int(args.end)).orderBy("block", "pos"))
    if args.command == "validate":
        return json.dumps({"contract": codec.report(spark, args.path, json.loads(args.metadata))["contract"]})
    if args.command == "demo":
        df, meta = codec.fixture(spark, args.family)
        longs = [c for c, kind in df.dtypes if kind == "bigint" and c not in ("block", "pos")]
        codec.write_segment(df, args.path, longs, meta)
        return rows(codec.read_segment(spark, args.path, longs).orderBy("block", "i"))
    if args.command == "csv":
        df = trades.read_csv(spark, args.path, args.symbol, args.limit)
        return rows(trades.table_digest(parquet.write_source(df, args.new, "pos"), "pos", df.columns))
    if args.command == "synthetic-edge":
        df = trades.edge_table(spark, args.scaled)
        return rows(trades.table_digest(parquet.write_source(df, args.new, "pos"), "pos", df.columns))
    if args.command == "digest":
        df = spark.read.parquet(args.path)
        return rows(trades.table_digest(df, args.order, df.columns))
    if args.command == "files":
        return rows(parquet.file_report(spark, args.path).orderBy("file"))
    if args.command == "seal":
        return rows(evidence.sealed(parquet.file_report(spark, args.path).select(F.col("file").alias("path"), "sha256")))
    if args.command == "measure":
        samples = phases.measure(store.Store(spark, args.path).read_all(), "store", args.candidates, args.rounds)
        middle = samples.where("role = 'measured'").groupBy("candidate", "phase", "cache").agg(F.median("op_ns").cast("long").alias("median_ns"), F.max("bytes").alias("bytes"), F.every("digest_ok").alias("exact"))
        return rows(middle.orderBy("candidate", "phase", "cache"))
    return rows(phases.blocks_bench(spark, args.sizes, args.repetitions, args.seed_offset).orderBy("kind", "regime", "rows"))


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    print(run(session("tessera"), args))


if __name__ == "__main__":
    main()
