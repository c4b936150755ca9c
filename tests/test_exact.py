"""Round trips and refusals on awkward values."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import exact
from tessera.operators import columns as c
from tessera.operators import evidence, timing
from tessera.sources import generate, store, trades

LOW, HIGH = -(2**63), 2**63 - 1


def shapes():
    rng = random.Random(5)
    yield [7] * 40
    yield [HIGH - 5 + i if i < 6 else LOW + i - 6 for i in range(40)]
    yield [rng.randint(LOW, HIGH) for _ in range(130)]
    yield [100 + rng.randrange(8) for _ in range(60)]
    yield [v for v in range(9) for _ in range(rng.randint(1, 9))]
    yield [LOW, HIGH, 0, -1, 1] * 6
    yield [12 * rng.randrange(1000) for _ in range(50)]
    yield [5]


def frame(spark, values):
    return spark.createDataFrame([Row(block=b, pos=i, v=v, w=values[-1 - i]) for b in (0, 1) for i, v in enumerate(values)])


@pytest.mark.parametrize("values", list(shapes()))
def test_inverse(spark, values):
    df = frame(spark, values)
    want = sorted((r.block, r.pos, r.v) for r in df.collect())
    for restored in (c.undelta(c.delta(df, "v")), c.unlinear(c.linear(df, "v")), c.unreference(c.reference(df, "v", "w"), "w")):
        assert sorted((r.block, r.pos, r.restored) for r in restored.collect()) == want
    p = c.planes(df, "v")
    assert sorted((r.block, r.pos, r.restored) for r in p.select("block", "pos", c.unplanes(p).alias("restored")).collect()) == want
    back = c.unruns(c.runs(df, "v"))
    assert sorted((r.block, r.i, r.value) for r in back.collect()) == want
    z = df.select("block", "pos", exact.unzigzag(exact.zigzag(F.col("v"))).alias("v"))
    assert sorted((r.block, r.pos, r.v) for r in z.collect()) == want


def test_params(spark):
    p = c.column_params(spark.createDataFrame([Row(block=0, pos=i, v=v) for i, v in enumerate([LOW, HIGH])]), "v").first()
    assert (p.base, p.bits) == (LOW, 1)


def test_dictionary_codes_nulls_as_empty(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(["b", None, "a", "b", ""])], "block long, pos long, s string")
    coded = c.encode_dictionary(df, "s")
    assert [(r.id, r.valid) for r in coded.orderBy("pos").collect()] == [(0, True), (1, False), (2, True), (0, True), (1, True)]
    back = c.decode_dictionary(coded, c.dictionary(df, "s"))
    assert [r.value for r in back.orderBy("pos").collect()] == ["b", None, "a", "b", ""]


def test_strict_texts(spark):
    texts = ["1.00000000", "1.0", "-1.00000000", "x", "99999999999999.00000000", "5.", "92233720368.54775807", "92233720368.54775808"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", exact.strict_decimal(F.col("s")).alias("a"), exact.decimal_e8(F.col("s")).alias("b")).collect()
    assert {r.s: (r.a, r.b) for r in rows} == {
        "1.00000000": (10**8, 10**8), "1.0": (None, 10**8), "-1.00000000": (None, None), "x": (None, None),
        "99999999999999.00000000": (None, None), "5.": (None, 5 * 10**8), "92233720368.54775807": (HIGH, HIGH), "92233720368.54775808": (None, None),
    }


def test_exact_scale_refuses_minus_zero(spark):
    df = spark.createDataFrame([(x,) for x in (0.3, -0.0, 0.0, 1e300, float("nan"), float("inf"), 0.1 + 0.2)], "v double")
    assert [r[0] for r in df.select(exact.exact_scaled(F.col("v"), 2)).collect()] == [30, None, 0, None, None, None, None]
    with pytest.raises(Exception, match="not exact"):
        trades.normalise(df, {"v": "n"}).collect()


def test_csv(spark, tmp_path):
    good = "1,1.00000000,2.50000000,1,2,1000,True,False\n3,0.00000000,2.00000000,3,3,1000,False,True\n"
    (tmp_path / "a.csv").write_text(good)
    rows = trades.read_csv(spark, str(tmp_path / "a.csv"), "S").collect()
    assert [(r.agg_id, r.qty_e8, r.is_buyer_maker) for r in rows] == [(1, 250_000_000, True), (3, 200_000_000, False)]
    for bad in ("1,1.0,2.50000000,1,2,1000,True,False\n", "1,1.00000000,2.50000000,1,2,1000,true,False\n", good.replace("\n", "\r\n"), "a,b\n", good + "1\n"):
        (tmp_path / "b.csv").write_text(bad)
        with pytest.raises(Exception, match="refused line"):
            trades.read_csv(spark, str(tmp_path / "b.csv"), "S").collect()


def test_store(spark, tmp_path):
    blocks = [([10, 12, 11], "BTC,ETH,BTC"), ([100, 102], "ETH,ETH"), ([9, 110], "BTC,BTC")]
    rows = [(b, i, t, s, 123) for b, (ts, ss) in enumerate(blocks) for i, (t, s) in enumerate(zip(ts, ss.split(","), strict=True))]
    df = spark.createDataFrame(rows, "block long, pos long, t long, symbol string, price long")
    opened = store.write(df, str(tmp_path / "s"))
    got = opened.range_query("BTC", 9, 11).orderBy("block", "pos").collect()
    assert [r.t for r in got] == [10, 11, 9]  # late rows in stored order
    assert opened.stats("BTC", 9, 11).first()["blocks_read"] == 2
    assert opened.stats("X", 0, 1000).first()["blocks_read"] == 0
    assert opened.verify()
    with pytest.raises(ValueError, match="reversed"):
        opened.range_query("BTC", 11, 9)
    with pytest.raises(ValueError, match="a store already"):
        store.write(df, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="more rows"):
        opened.read_block(0, most_rows=2)
    with pytest.raises(TypeError):
        store.write(df.withColumn("a", F.array(F.lit(1))), str(tmp_path / "n"))
    df.where("block = 0").withColumn("block", F.lit(7).cast("long")).write.parquet(str(tmp_path / "s/data/crashed"))  # a crash before the index
    again = store.Store(spark, str(tmp_path / "s"))
    assert again.verify() and again.data.count() == 7
    assert store.recover(spark, str(tmp_path / "s"), str(tmp_path / "r")).data.count() == 7


def test_recover_frames(spark):
    frames = spark.createDataFrame([(0, True, True), (1, True, True), (2, False, False), (3, True, True)], "block long, complete boolean, crc_ok boolean")
    assert sorted(r.block for r in store.recover_frames(frames).collect()) == [0, 1]
    bad = spark.createDataFrame([(0, True, False), (1, True, True)], "block long, complete boolean, crc_ok boolean")
    with pytest.raises(Exception, match="corrupt"):
        store.recover_frames(bad).collect()


def test_contract(spark):
    meta = {"family": "tick", "subtype": "trade", "schema_version": 1, "source_sha256": "a" * 64, "price_decimals": 8, "quantity_decimals": 8}
    schema = spark.createDataFrame([], "source_utc_ns long, received_utc_ns long, clock_error_ns long, available_utc_ns long, sequence long, symbol string, price long, quantity long, side byte").schema
    store.contract(meta, schema)
    for change in ({"family": "x"}, {"source_sha256": "0" * 64}, {"price_decimals": 13}, {"subtype": "quote"}, {"schema_version": 2}):
        with pytest.raises(ValueError):
            store.contract(meta | change, schema)


def test_clock_error_rounds_up(spark):
    reading = "named_struct('session', X'01', 'epoch', 1BD, 'utc_ns', 1788868800123456789L, 'monotonic_ns', 2000000001L, 'read_span_ns', 50BD)"
    state = "named_struct('session', X'01', 'epoch', 1BD, 'id', 42BD, 'collection_started_mono_ns', 1000000000L, 'published_mono_ns', 1100000000L, 'valid_until_mono_ns', 6000000000L, 'synchronized', true, 'base_error_ns', 20000BD, 'growth_allowance_ppb', 1000BD)"
    r = timing.assess(spark.sql(f"SELECT {reading} AS reading, {state} AS state")).first()
    assert (r.quality, r.error_ns, int(r.clock_state_id)) == ("Estimated", 21_051, 42)


def test_digest_sees_bits_and_order(spark):
    def digest(rows, parts=1):
        return trades.table_digest(spark.createDataFrame(rows, "block long, pos long, v double, s string").repartition(parts), "pos").first()["sha256"]

    base = [(0, i, float(i), "é" * i) for i in range(9)]
    assert digest(base) == digest(base, 3)
    plain = hashlib.sha256()
    for name, kind, values in (("v", "f64", [struct.pack("<d", r[2]) for r in base]), ("s", "utf8", None)):
        plain.update(f"col|{name}|{kind}|9\n".encode())
        if values:
            plain.update(b"".join(values))
        else:
            texts = [r[3].encode() for r in base]
            plain.update(struct.pack("<Q", sum(map(len, texts))) + b"".join(struct.pack("<I", len(t)) for t in texts) + b"".join(texts))
    assert digest(base, 5) == plain.hexdigest()
    assert digest([(0, 0, -0.0, "")]) != digest([(0, 0, 0.0, "")])


def test_generator_is_reproducible(spark):
    a = generate.columns("l2", "volatile", 300, 9)
    assert (np.diff(a["receive_ns"]) >= 0).all() and set(a["action"].tolist()) == {1, 2}
    assert generate.generate(spark, "trade", "quiet", 0, 1).count() == 0
    with pytest.raises(ValueError):
        generate.columns("trade", "quiet", 2_000_000, 1)


def test_bootstrap_and_verdict(spark):
    a, b = np.arange(10.0) + 5, np.arange(10.0) + 50
    assert evidence.bootstrap(a, b, draws=200) == evidence.bootstrap(a, b, draws=200)
    rho, low, high = evidence.bootstrap(a, b, draws=200)
    assert low <= rho <= high < 1
    cases = [(0.9, 0.85, 0.96, "BETTER"), (0.96, 0.9, 0.99, "INCONCLUSIVE"), (1.0, 0.97, 1.03, "EQUIVALENT"), (1.2, 1.1, 1.3, "WORSE")]
    for rho, low, high, want in cases:
        assert spark.range(1).select(evidence.verdict(F.lit(rho), F.lit(low), F.lit(high), 0.05)).first()[0] == want


def plain_bootstrap(a, b, length, draws, seed=evidence.SEED):
    """Round by round with Python's own generator and medians."""
    from statistics import median

    n, rng, found = len(a), random.Random(seed), []
    for _ in range(draws):
        index = []
        while len(index) < n:
            start = rng.randrange(0, n - length + 1)
            index += range(start, start + length)
        below = median(b[i] for i in index[:n])
        found.append(median(a[i] for i in index[:n]) / below if below else math.inf)
    found.sort()
    return found[int(0.025 * draws)], found[min(draws - 1, math.ceil(0.975 * draws) - 1)]


@pytest.mark.parametrize("n", [2, 3, 7, 100, 1001])
def test_bootstrap_is_the_plain_one(n):
    rng = random.Random(n)
    a, b = ([rng.randrange(0, 50) for _ in range(n)] for _ in range(2))
    ahead, back = evidence.bootstrap_both(np.array(a), np.array(b), draws=200)
    assert ahead[1:] == plain_bootstrap(a, b, min(3, n), 200) + plain_bootstrap(a, b, 1, 200)
    assert back[1:] == plain_bootstrap(b, a, min(3, n), 200) + plain_bootstrap(b, a, 1, 200)
    assert evidence.bootstrap(np.array(a), np.array(b), draws=200) == ahead[:3]


@pytest.mark.parametrize("n", [2, 5, 100, 1001])
def test_bootstrap_of_many_series_shares_the_draws(n):
    """Each pair has the figures that it has alone; also where the median must be looked for among all ranks."""
    rng = random.Random(n)
    base, *others = ([rng.randrange(0, 50) for _ in range(n + i)] for i in range(4))
    for block in (3, 1):
        found = evidence.bootstrap_against(np.array(base), [np.array(o) for o in others], block, draws=200)
        for o, x in zip(others, found, strict=True):
            assert x[1:3] == plain_bootstrap(base, o, min(block, n), 200) and x[4:] == plain_bootstrap(o[:n], base, min(block, n), 200)
    series = [np.array(base), np.arange(n)]
    assert (evidence._resampled_medians(series, 3, 200, 1) == evidence._resampled_medians(series, 3, 200, 1, sigmas=0)).all()


def test_bootstrap_query_takes_all_rounds(spark):
    from itertools import permutations

    from tessera.plans import catalogue

    sf = "/root/testdata/sf0.001"
    series = {}
    for r in sorted(catalogue._bench(spark, sf).collect(), key=lambda r: r["round"]):
        series.setdefault(r["kind"], {}).setdefault(r["codec"], []).append(r["ns"])
    got = {(r["kind"], r["candidate"], r["baseline"]): r for r in catalogue.QUERIES["bootstrap_ci"](spark, sf).collect()}
    assert set(got) == {(k, *p) for k, by in series.items() for p in permutations(by, 2)}
    for (kind, x, y), r in got.items():
        a, b = series[kind][x], series[kind][y]
        assert r["n"] == min(len(a), len(b)) and r["unpaired"] == abs(len(a) - len(b))
        assert r["ratio"] == np.median(a[: r["n"]]) / np.median(b[: r["n"]])
    kind, x, y = max(got, key=lambda k: got[k]["n"])
    a, b = (series[kind][c][: got[kind, x, y]["n"]] for c in (x, y))
    assert len(a) > 15 and (got[kind, x, y]["low"], got[kind, x, y]["high"]) == plain_bootstrap(a, b, 3, evidence.DRAWS)


def test_stream_append(spark, tmp_path):
    from tessera.streaming.append import append_stream

    schema = "pos long, t long, symbol string"
    for n in range(2):
        spark.createDataFrame([(n * 10 + i, 100 - n, "S") for i in range(3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        append_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    opened = store.Store(spark, str(tmp_path / "s"))
    assert opened.data.count() == 6 and opened.index.count() == 2 and opened.verify()
