"""Every registered market-data query against its SQL on DuckDB, over whole tables."""

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = catalogue.TABLES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x != x:
        return None
    return x.item() if hasattr(x, "item") else x


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted([tuple(map(str, r)) for r in df.select(*names).collect()])
    rel = con.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == names
    want = sorted([tuple(str(plain(dict(zip(rel.columns, r, strict=True))[c])) for c in names) for r in rel.fetchall()])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_footers_of_tables_in_part_files(spark, tmp_path):
    """A table is one row by its name, whether it is a file or a folder of part files."""
    for t in TABLES:
        if t not in ("documents", "nation"):
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    whole.repartition(3).write.partitionBy("lang").parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/nation.parquet").limit(0).write.parquet(str(tmp_path / "nation.parquet"))
    got = {r["file"]: r["rows"] for r in catalogue.QUERIES["parquet_footers"](spark, str(tmp_path)).collect()}
    assert set(got) == {f"{t}.parquet" for t in TABLES} and got["documents.parquet"] == whole.count() and got["nation.parquet"] == 0
    assert got["orders.parquet"] == spark.read.parquet(f"{SF}/orders.parquet").count()
