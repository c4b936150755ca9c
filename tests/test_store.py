"""Stores that crash or are damaged, digests at known values, strict readers."""

import hashlib
import math
import struct
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tessera.functions import exact
from tessera.operators import columns, evidence, timing
from tessera.plans import catalogue
from tessera.session import scratch_dir
from tessera.sources import book, codec, generate, parquet, store, trades
from tessera.streaming.append import commit

ROWS = "block long, pos long, t long, symbol string, price long"


def block(spark, number, n=3, first=0):
    return spark.createDataFrame([(number, number * 10 + i, 100 * number + i, "AB"[i % 2], first + i) for i in range(n)], ROWS)


def test_replay_after_crash(spark, tmp_path):
    """Rows of a batch that ended before its index are in no read; the batch is written again, once."""
    path, three = str(tmp_path / "s"), block(spark, 0).drop("block")
    commit(three, 0, path)
    block(spark, 1).write.parquet(f"{path}/data/crashed")  # batch 1: rows, no index
    assert store.Store(spark, path).read_all().count() == 3
    for _ in range(2):
        commit(block(spark, 1).drop("block"), 1, path)
    opened = store.Store(spark, path)
    assert opened.read_all().count() == 6 and opened.range_query("A", 0, 10**6).where("block = 1").count() == 2 and opened.verify()
    with pytest.raises(ValueError, match="such a block"):
        store.append(block(spark, 1), path)


def test_damage_is_seen(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write(block(spark, 0), path)
    store.append(block(spark, 1), path)
    store.append(block(spark, 2), path)
    opened = store.Store(spark, path)
    rows = {r["block"]: r for r in opened.blocks()}
    assert opened.read_block(1, most_rows=3, most_bytes=rows[1]["bytes"], check=True).count() == 3
    for bounds in ({"most_rows": 2}, {"most_bytes": rows[1]["bytes"] - 1}):
        with pytest.raises(ValueError, match="more rows or bytes"):
            opened.read_block(1, **bounds)
    with pytest.raises(ValueError, match="more rows or bytes"):
        opened.range_query("A", 0, 10**6, most_rows=8)
    with pytest.raises(ValueError, match="no such block"):
        opened.read_block(9)
    seen = []
    opened.visit(lambda df: seen.append(df.count()) or len(seen) < 2)
    assert seen == [3, 3]
    assert opened.restore(spark.createDataFrame([], ROWS), lambda df: df.withColumn("price", F.lit(1).cast("long"))).agg(F.sum("price")).first()[0] == 9
    # a torn tail: the last block's folder is gone
    gone = Path(path, "data", rows[2]["attempt"])
    gone.rename(tmp_path / "elsewhere")
    assert store.recover(spark, path, str(tmp_path / "r1")).read_all().count() == 6
    (tmp_path / "elsewhere").rename(gone)
    # another value under the same facts: corruption, not a crash
    changed = Path(path, "data", rows[1]["attempt"])
    changed.rename(tmp_path / "old")
    block(spark, 1, first=50).coalesce(1).write.parquet(str(tmp_path / "new"))
    changed.mkdir()
    next(Path(tmp_path, "new").glob("part-*.parquet")).rename(changed / rows[1]["file"])
    spark.catalog.refreshByPath(path)
    again = store.Store(spark, path)
    assert not again.verify() and again.differing().first()["differing"] == 1
    with pytest.raises(ValueError, match="not what was written"):
        again.read_block(1, check=True)
    with pytest.raises(Exception, match="corrupt"):
        store.recover(spark, path, str(tmp_path / "r2"))


def test_index_gate(spark, tmp_path):
    good = (0, 3, 0, 2, ["A", "B"], "x", "f", 1, "c")
    for i, (change, n) in enumerate((((), 0), ((1, 0), 1), ((2, 5), 1), ((4, []), 1), ((4, ["B", "A"]), 1))):
        row = list(good)
        if change:
            row[change[0]] = change[1]
        index = spark.createDataFrame([tuple(row)], store.INDEX)
        assert store.insane(index).count() == n
        index.write.parquet(str(tmp_path / f"s{i}/index"))
        if n:
            with pytest.raises(ValueError, match="cannot be"):
                store.Store(spark, str(tmp_path / f"s{i}")).blocks()
    assert store.insane(spark.createDataFrame([good, good], store.INDEX)).count() == 2


def test_pruned_files_and_pushed_filters(spark, tmp_path):
    many = block(spark, 0)
    for number in range(1, 6):
        many = many.unionByName(block(spark, number))
    opened = store.write(many, str(tmp_path / "s"), partitions=6)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = opened.range_query("A", 200, 210)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(df.inputFiles()) == 1 < len(opened.read_all().inputFiles())
    assert "GreaterThanOrEqual(t,200)" in plan and "EqualTo(symbol,A)" in plan and "LessThanOrEqual(block,2)" in plan


def test_scratch_needs_a_shared_folder(spark):
    class Unset:
        def get(self, *_):
            return None

    elsewhere = type("Session", (), {"conf": Unset(), "sparkContext": type("Context", (), {"master": "yarn", "getConf": lambda self: Unset()})()})()
    with pytest.raises(RuntimeError, match="share"):
        scratch_dir(elsewhere)


def test_columns_digest_by_hand(spark):
    names = [*generate.HEAD, *generate.TAILS["trade"]]
    df = generate.generate(spark, "trade", "quiet", 300, 7)
    rows = df.orderBy("pos").collect()
    want = hashlib.sha256(b"\x02" + struct.pack("<Q", 300) + b"".join(struct.pack("<q", r[c]) for c in names for r in rows)).hexdigest()
    assert trades.columns_digest(df.repartition(4), "pos", "trade", names).first()["sha256"] == want
    with pytest.raises(ValueError):
        trades.columns_digest(df, "pos", "trade", names[:7])


def test_generator_first_draws():
    """SplitMix64 from seed 0, by its published first values."""
    assert [int(x) for x in generate.draws(0, np.arange(3))] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]


def test_edge_table(spark, tmp_path):
    rows = trades.edge_table(spark).orderBy("pos").collect()
    assert len(rows) == 64 and [r["agg_id"] for r in rows[60:]] == [9_007_199_254_740_993, 4_611_686_018_427_387_904, exact.MAX_LONG - 1, exact.MAX_LONG]
    assert math.copysign(1, rows[1]["price"]) == -1 and math.isnan(rows[12]["price"]) and rows[5]["symbol"] == "" and rows[0]["symbol"] == "PAXGUSDT"
    kept = trades.edge_table(spark)
    assert columns.bits_equal(kept, kept.repartition(3))
    assert not columns.bits_equal(kept, kept.withColumn("price", F.when(F.col("pos") == 1, F.lit(0.0)).otherwise(F.col("price"))))
    back = parquet.write_source(trades.edge_table(spark, scaled=True), str(tmp_path / "edge"), "pos")
    assert back.count() == 64 and {r["codecs"][0] for r in parquet.inspected(spark, str(tmp_path / "edge")).collect()} == {"UNCOMPRESSED"}


def test_bits_equal_with_nulls(spark):
    one = spark.createDataFrame([(0, None), (1, 2.0), (2, float("nan"))], "pos long, v double")
    assert columns.bits_equal(one, one.repartition(2))
    assert not columns.bits_equal(one, spark.createDataFrame([(0, 0.0), (1, 2.0), (2, float("nan"))], "pos long, v double"))


def test_borders_and_dense_places(spark, tmp_path):
    """A time that falls at the first row of a block is found; places are counted without gaps over splits and files."""
    df = spark.createDataFrame([(i, i, 100 + i - (50 if i >= 4 else 0)) for i in range(8)], "pos long, agg_id long, transact_time long")
    assert [r["pos"] for r in trades.violations(df, block=4).collect()] == [4] == [r["pos"] for r in trades.violations(df, block=3).collect()]
    assert trades.violations(df.where("pos <> 4"), block=2).count() == 1  # also over a block that is gone
    line = "{0},1.00000000,2.50000000,1,2,{1},True,False\n"
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text("".join(line.format(100 * k + i, 1000 + 100 * k + i) for i in range(40)))
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        got = trades.read_csv(spark, str(tmp_path), "S", symbols=("S",)).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert [r["pos"] for r in got] == list(range(120)) and [r["agg_id"] for r in got] == [100 * k + i for k in range(3) for i in range(40)]
    (tmp_path / "part-1.csv").write_text(line.format(5, 5000))
    with pytest.raises(ValueError, match="does not rise"):
        trades.read_csv(spark, str(tmp_path), "S")
    assert trades.read_csv(spark, str(tmp_path / "part-0.csv"), "S", limit=7).count() == 7
    with pytest.raises(ValueError, match="fewer rows"):
        trades.read_csv(spark, str(tmp_path / "part-0.csv"), "S", limit=41)
    with pytest.raises(ValueError, match="unknown symbol"):
        trades.read_csv(spark, str(tmp_path / "part-0.csv"), "S", symbols=("T",))


@pytest.mark.parametrize("values", [[exact.MIN_LONG, exact.MAX_LONG], [exact.MIN_LONG, exact.MAX_LONG, 0, 1], [7] * 300, list(range(0, 5000, 7)), [2**32, 0], [2**32 - 1, 0], [-5]])
def test_packing_at_extremes(spark, values):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "block long, pos long, v long")
    packed = columns.pack_groups(df, "v")
    assert [r["value"] for r in columns.unpack_groups(packed).orderBy("i").collect()] == values
    widths = {r["part"]: (r["width"], r["bytes"]) for r in columns.group_widths(df, "v").collect()}
    for r in packed.collect():
        assert widths[r["part"]][1] == 1 + len(r["payload"]) and (r["width"] == 255) == (widths[r["part"]][0] > 32)


def test_denormalise_is_proven(spark):
    df = spark.createDataFrame([(1, 123), (2, 2**53)], "pos long, v_e8 long")
    assert trades.denormalise(df.where("pos = 1"), {"v_e8": "v"}).first()["v"] == 1.23e-6
    with pytest.raises(Exception, match="not exact"):
        trades.denormalise(df, {"v_e8": "v"}).collect()


def message(raw, digest=None):
    import json

    return json.dumps({"raw_payload": raw, "payload_sha256": digest or hashlib.sha256(raw.encode()).hexdigest(), "receipt_utc_ns": 5}) + "\n"


GOOD = '{"type":"delta","ts":1,"cts":2,"data":{"s":"X","u":3,"seq":4,"b":[["1.5","2"],["1.25","0"]],"a":[]}}'


def test_book_messages(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(message(GOOD) + message(GOOD.replace("delta", "snapshot").replace('"a":[]', '"a":[["9","1.00000001"]]')))
    got = book.read_messages(spark, str(tmp_path / "a.jsonl")).orderBy("event_index", "side", "level_index").collect()
    assert [(r["event_index"], r["side"], r["level_index"], r["price_e8"], r["quantity_e8"], r["snapshot"]) for r in got] == [
        (0, 0, 0, 150_000_000, 200_000_000, 0), (0, 0, 1, 125_000_000, 0, 0), (1, 0, 0, 150_000_000, 200_000_000, 1), (1, 0, 1, 125_000_000, 0, 1), (1, 1, 0, 900_000_000, 100_000_001, 1),
    ]
    for n, bad in enumerate((message(GOOD, "0" * 64), message(GOOD.replace("delta", "other")), message(GOOD.replace('"u":3,', "")), message(GOOD.replace('"1.5"', '"1.5x"')), message(GOOD.replace('["1.25","0"]', '["1.25"]')))):
        (tmp_path / f"bad{n}.jsonl").write_text(bad)
        with pytest.raises(Exception, match="hash mismatch|unknown event|missing field|invalid level"):
            book.read_messages(spark, str(tmp_path / f"bad{n}.jsonl")).collect()


def test_parquet_gate(spark, tmp_path):
    kind = StructType([StructField("a", LongType()), StructField("b", StringType()), StructField("c", DoubleType())])
    df = spark.createDataFrame([(1, "x", 0.5), (2, "y", -0.0)], kind)
    for sink in parquet.SINKS:
        parquet.write(df, str(tmp_path / sink), sink)
        assert columns.bits_equal(parquet.read_exact(spark, str(tmp_path / sink), kind, rows=2), df)
    codecs = {s: parquet.inspected(spark, str(tmp_path / s)).first()["codecs"] for s in parquet.SINKS}
    assert codecs["plain"] == ["UNCOMPRESSED"] and codecs["delta-snappy"] == ["SNAPPY"] and codecs["delta-zstd"] == ["ZSTD"] and codecs["dictionary-lz4"][0].startswith("LZ4")
    for wrong in (StructType(kind.fields[:2]), StructType([kind[1], kind[0], kind[2]]), StructType([StructField("a", DoubleType()), kind[1], kind[2]])):
        with pytest.raises(ValueError, match="expected"):
            parquet.read_exact(spark, str(tmp_path / "plain"), wrong)
    with pytest.raises(ValueError, match="another number"):
        parquet.read_exact(spark, str(tmp_path / "plain"), kind, rows=3)
    assert parquet.bounded(spark, str(tmp_path / "plain"), ["a"]).columns == ["a"]
    for bound in ({"most_bytes": 10}, {"most_rows": 1}):
        with pytest.raises(ValueError, match="more bytes or rows"):
            parquet.bounded(spark, str(tmp_path / "plain"), ["a"], **bound)
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.parquet").write_bytes(b"\x1f\x8bzz")
    r = parquet.file_report(spark, str(tmp_path / "f")).first()
    assert (r["format"], r["sha256"], r["length"]) == ("gzip", hashlib.sha256(b"\x1f\x8bzz").hexdigest(), 4)
    assert parquet.tree_bytes(spark, str(tmp_path / "f")).first()["bytes"] == 4
    assert parquet.restamped(df, {"a": "z"}, {"z": {"unit": "ns"}}).schema["z"].metadata == {"unit": "ns"}
    with pytest.raises(ValueError):
        parquet.rows_of(df, 10, 0, 5, 6)


def test_strict_json(spark):
    inner = StructType([StructField("x", LongType(), False)])
    kind = StructType([StructField("a", LongType()), StructField("b", inner)])
    read = lambda text: spark.createDataFrame([(text,)], "t string").select(parquet.strict_json(F.col("t"), kind).alias("v")).collect()
    assert read('{"a":1,"b":{"x":2}}')[0]["v"]["b"]["x"] == 2 and read('{"a":1}')[0]["v"]["b"] is None
    for bad in ('{"a":1,"c":2}', '{"a":1,"b":{"x":2,"y":3}}', '{"b":{}}', '{"a":"text"}', "[1]", "{", '{"a":1,"a":2}'):
        with pytest.raises(Exception):
            read(bad)


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(exact.crc32(F.lit("abc"))) == zlib.crc32(b"abc")
    assert [one(exact.byte_width(F.lit(x).cast("long"))) for x in (0, 255, 256, -1)] == [0, 1, 2, 8]
    assert [one(exact.ceil_div(F.lit(x).cast("long"), 4)) for x in (0, 1, 4, exact.MAX_LONG)] == [0, 1, 1, 2**61]
    assert one(exact.little_endian(F.lit(b"\x01\x02\xff"), 1, 2)) == 0xFF02
    assert [one(exact.source_hash_ok(F.lit(x))) for x in ("0" * 64, "a" * 64, "A" * 64, "a" * 63)] == [False, True, False, False]
    assert exact.safe_text("a-Z_0.1/:+=,@") == "a-Z_0.1/:+=,@"
    for bad in ("", "a b", "a'b", "é"):
        with pytest.raises(ValueError):
            exact.safe_text(bad)
    found = [one(exact.leaks(F.lit(x))) for x in ("see /home/me/x", "at 100.64.0.1 now", "1100.64.0.1", "a@b.org", "BEGIN RSA PRIVATE KEY", "plain text")]
    assert found == [True, True, False, True, True, False]
    with pytest.raises(ValueError, match="two or more"):
        evidence.bootstrap(np.array([1.0]), np.array([2.0]))


def test_blocks_of_large_positions(spark):
    assert columns.blocks(spark.createDataFrame([(2**62 + 511,), (2**62 + 512,)], "pos long"), 512).orderBy("pos").collect()[1]["block"] == (2**62 + 512) // 512


def test_as_of_hands_states_on(spark):
    """Readings long after the last state still have it; ties take the largest value; a reading before all states has none."""
    states = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 900, 3), ("b", 400, 9)], "k string, published long, id long")
    readings = spark.createDataFrame([("a", t) for t in (4, 5, 6, 899, 900, 10**6)] + [("b", 399), ("b", 401), ("c", 7)], "k string, at long")
    for spans in (1, 2, 64):
        got = {(r["k"], r["at"]): r["as_of"] for r in timing.latest_state(readings, states, ["k"], "at", "published", "id", spans).collect()}
        assert got == {("a", 4): None, ("a", 5): 2, ("a", 6): 2, ("a", 899): 2, ("a", 900): 3, ("a", 10**6): 3, ("b", 399): None, ("b", 401): 9, ("c", 7): None}
    assert timing.latest_state(readings, states.limit(0), ["k"], "at", "published", "id").where("as_of IS NOT NULL").count() == 0


def test_evidence_folder(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    recorded = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "path string, sha256 string")
    texts = spark.createDataFrame([("a", "fine"), ("b", "mail me@example.org")], "path string, text string")
    got = {(r["path"], r["problem"]) for r in evidence.evidence_problems(["a", "z"], files, recorded, texts).collect()}
    assert got == {("z", "missing"), ("b", "hash"), ("c", "hash"), ("b", "leak")}
    none = spark.createDataFrame([], "path string, original_sha256 string, public_sha256 string")
    assert {(r["path"], r["status"]) for r in evidence.receipts(recorded, files, none).collect()} == {("a", "original bytes"), ("b", "MISMATCH"), ("c", "MISMATCH")}


def test_canonical_digest_query(spark):
    """The registered digest equals one made from rows that DuckDB reads, column after column."""
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"WITH events AS (SELECT * FROM '{sf}/events.parquet'), {catalogue.TICK} SELECT pos, t, symbol, price, value FROM tick ORDER BY pos").fetchall()
    h = hashlib.sha256()
    for i, (name, kind) in enumerate((("pos", "i64"), ("t", "i64"), ("symbol", "utf8"), ("price", "i64"), ("value", "f64"))):
        h.update(f"col|{name}|{kind}|{len(rows)}\n".encode())
        if kind == "utf8":
            texts = [r[i].encode() for r in rows]
            h.update(struct.pack("<Q", sum(map(len, texts))) + b"".join(struct.pack("<I", len(x)) for x in texts) + b"".join(texts))
        else:
            h.update(b"".join(struct.pack("<q" if kind == "i64" else "<d", r[i]) for r in rows))
    got = catalogue.QUERIES["canonical_digest"](spark, sf).first()
    assert (got["rows"], got["sha256"]) == (len(rows), h.hexdigest())


@pytest.mark.parametrize("values", [[exact.MIN_LONG, exact.MAX_LONG, -1], [5], list(range(0, 9000, 9)), [7] * 400, [(-1) ** i * 2**40 * i for i in range(300)]])
def test_packed_columns(values):
    columns_ = [np.array(values, np.int64).view(np.uint64), np.array(values, np.int64).view(np.uint64) + np.uint64(3)]
    before = []
    for at, want in enumerate(columns_):
        _, payload, _ = codec.pack_column(columns_, at)
        got = codec.unpack_column(payload, before)
        assert (got == want).all()
        before.append(got)
        for bad in (payload[:-5], payload + b"x", payload[:60] + bytes([payload[60] ^ 1]) + payload[61:] if len(payload) > 61 else payload[:-1]):
            with pytest.raises(ValueError):
                codec.unpack_column(bad, before)
    assert codec.pack_column(columns_, 1)[0] in (0, 1, 2, 3)


def test_segments_fixtures_and_reports(spark, tmp_path):
    for family in ("tick", "book"):
        df, meta = codec.fixture(spark, family)
        longs = ["source_utc_ns", "received_utc_ns", "sequence", "price", "quantity"]
        codec.write_segment(df, str(tmp_path / family), longs, meta)
        got = codec.read_segment(spark, str(tmp_path / family), longs).orderBy("i").collect()
        assert [tuple(r)[2:] for r in got] == [tuple(r) for r in df.orderBy("pos").select(*longs).collect()]
        with pytest.raises(ValueError):
            codec.write_segment(df, str(tmp_path / "bad"), longs, meta | {"schema_version": 2})
    df, meta = codec.fixture(spark, "tick")
    store.write(df.withColumn("t", F.col("available_utc_ns")), str(tmp_path / "s"))
    r = codec.report(spark, str(tmp_path / "s"), meta)
    assert (r["rows"], r["verified"], r["contract"]) == (3, True, "ok") and r["read_ns"] > 0
    assert codec.report(spark, str(tmp_path / "s"), meta | {"family": "x"})["contract"] != "ok"
    with pytest.raises(ValueError, match="eight"):
        codec.valid_columns(df.schema, df.columns[:8])
    assert codec.markdown(spark.createDataFrame([(1234, "a|b", None)], "n long, s string, x double")) == "| n | s | x |\n| --- | --- | --- |\n| 1,234 | a\\|b |  |"
    assert codec.profiled(df)["run_ns"] > 0


def test_checkpoint_lines(spark, tmp_path):
    path = str(tmp_path / "c.jsonl")
    evidence.append_line(path, {"round": 1, "dataset": "d"})
    with open(path, "a") as f:
        f.write('{"round": 2, "da')  # a crash
    evidence.append_line(path, {"round": 3, "dataset": "d"})
    assert [tuple(r) for r in evidence.resumed(spark.read.text(path), "round long, dataset string").orderBy("round").collect()] == [(1, "d"), (3, "d")]
