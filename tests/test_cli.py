"""Commands and measured phases."""

import json

import pytest

from tessera import __main__ as cli
from tessera.operators import evidence
from tessera.plans import phases
from tessera.sources import generate, store


def made(spark):
    from pyspark.sql import functions as F

    df = generate.generate(spark, "trade", "quiet", 600, 3)
    return df.withColumn("block", F.expr("pos div 200")).withColumn("t", F.col("receive_ns")).withColumn("symbol", F.when(F.col("pos") % 3 == 0, "A").otherwise("B"))


def test_commands(spark, tmp_path):
    def said(*argv):
        return cli.run(spark, cli._parser().parse_args(list(argv)))

    s = str(tmp_path / "s")
    opened = store.write(made(spark), s)
    assert json.loads(said("inspect", s))["rows"] == 600 and json.loads(said("verify", s)) == {"verified": True}
    assert json.loads(said("recover", s, str(tmp_path / "r")))["blocks"] == 3
    first = opened.blocks()[0]
    assert said("query", s, "A", str(first["min_time"]), str(first["min_time"] + 3_000_000)).count("\n") == 1 + 2
    assert "unknown family" in said("validate", s, json.dumps({"family": "x"}))
    assert said("demo", "book", str(tmp_path / "demo")).count("\n") == 4
    (tmp_path / "a.csv").write_text("".join(f"{i},1.00000000,2.50000000,1,2,{i},True,False\n" for i in range(9)))
    digest = said("csv", str(tmp_path / "a.csv"), "S", str(tmp_path / "csv"))
    assert digest == said("digest", str(tmp_path / "csv"), "pos") and "| 9 |" in digest
    assert "| 64 |" in said("synthetic-edge", str(tmp_path / "edge"), "--scaled")
    assert said("files", str(tmp_path / "csv")).count("parquet") >= 1 and "| 1 |" not in said("seal", str(tmp_path / "s")).splitlines()[-1]
    assert said("blocks", "--sizes", "300", "--repetitions", "1").count("\n") == 1 + 6
    with pytest.raises(SystemExit):
        cli._parser().parse_args(["unknown"])


def test_phases(spark):
    samples = phases.measure(made(spark), "d", ["plain", "delta-zstd"], rounds=2)
    samples = spark.createDataFrame(samples.collect(), samples.schema)
    assert samples.count() == 2 * 2 * 6 and samples.where("digest_ok = false").count() == 0
    cell = evidence.cell_summary(samples, ["dataset", "variant"]).first()
    assert (cell["attempted"], cell["valid"], cell["underpowered"]) == (1, 1, True)
    size = {r["candidate"]: r["bytes"] for r in samples.where("phase = 'write' AND round = 1").collect()}
    assert size["delta-zstd"] < size["plain"]
