"""Order-book messages: JSON lines with hashed payloads, nested levels, event boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exact
from .trades import placed

ENVELOPE = "raw_payload string, payload_sha256 string, receipt_utc_ns bigint"
PAYLOAD = "type string, ts bigint, cts bigint, data struct<s:string, u:bigint, seq:bigint, b:array<array<string>>, a:array<array<string>>>"
SPAN = 65_536


def explode_levels(messages: DataFrame, fields: list[str]) -> DataFrame:
    """One row a level: event, side (0 bids, 1 asks), level (place in its list) and the level's fields. Events without levels give none."""
    sides = [
        messages.select("event", F.lit(side).cast("bigint").alias("side"), F.posexplode(name).alias("level", "x")).select(
            "event", "side", F.col("level").cast("bigint").alias("level"), *[F.col(f"x.{f}").alias(f) for f in fields]
        )
        for side, name in enumerate(("b", "a"))
    ]
    return sides[0].unionByName(sides[1])


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Levels of (gzipped) JSON lines. A payload that differs from its hash, an unknown type, a missing field or a malformed level is an error.

    event_index counts the lines from 0, in the order of file names and lines.
    """
    lines = placed(spark.read.text(path), "event_index")
    e = lines.select("event_index", F.from_json("value", ENVELOPE, {"mode": "FAILFAST"}).alias("e")).select("event_index", "e.*")
    refuse = lambda ok, what: F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(what)).cast("boolean"))
    e = e.where(refuse(F.coalesce(F.sha2("raw_payload", 256) == F.col("payload_sha256"), F.lit(False)), "payload hash mismatch"))
    p = e.select("event_index", "receipt_utc_ns", F.from_json("raw_payload", PAYLOAD, {"mode": "FAILFAST"}).alias("p"))
    p = p.where(refuse(F.coalesce(F.col("p.type").isin("delta", "snapshot"), F.lit(False)), "unknown event type"))
    whole = F.lit(True)
    for c in ("receipt_utc_ns", "p.ts", "p.cts", "p.data.s", "p.data.u", "p.data.seq", "p.data.b", "p.data.a"):
        whole = whole & F.col(c).isNotNull()
    p = p.where(refuse(whole, "missing field"))
    lists = {}
    for name in ("b", "a"):
        pairs = F.col(f"p.data.{name}")
        lists[name] = F.transform(pairs, lambda x: F.struct(exact.decimal_e8(F.get(x, F.lit(0))).alias("price_e8"), exact.decimal_e8(F.get(x, F.lit(1))).alias("quantity_e8")))
        p = p.where(refuse(F.forall(pairs, lambda x: (F.size(x) == 2) & exact.decimal_e8(F.get(x, F.lit(0))).isNotNull() & exact.decimal_e8(F.get(x, F.lit(1))).isNotNull()), "invalid level"))
    head = {
        "receipt_ns": "receipt_utc_ns", "exchange_ms": "p.ts", "cts_ms": "p.cts", "update_id": "p.data.u", "sequence": "p.data.seq", "symbol": "p.data.s",
    }
    event = F.struct(F.col("event_index"), *[F.col(v).alias(k) for k, v in head.items()], (F.col("p.type") == "snapshot").cast("bigint").alias("snapshot"))
    levels = explode_levels(p.select(event.alias("event"), lists["b"].alias("b"), lists["a"].alias("a")), ["price_e8", "quantity_e8"])
    e = lambda f: F.col(f"event.{f}")
    return levels.select(e("event_index"), *[e(k) for k in list(head)[:5]], "side", F.col("level").alias("level_index"), "price_e8", "quantity_e8", e("snapshot"), e("symbol"))


def limit_events(counts: DataFrame, limit: int) -> DataFrame:
    """Whole events until ``limit`` levels are reached: those whose predecessors have fewer in sum. counts: event, levels.

    Running sums are taken in spans of events and over the spans' totals, so that no task sorts all events.
    """
    spanned = counts.withColumn("span", F.floor(F.col("event") / SPAN))
    line = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    earlier = spanned.groupBy("span").agg(F.sum("levels").alias("n")).select("span", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("span").orderBy("event").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("earlier") + F.coalesce(F.sum("levels").over(inside), F.lit(0))
    return spanned.join(earlier, "span").withColumn("before", before).where(F.col("before") < limit).select("event", "levels")


def best_levels(levels: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The n best bids (highest price) and asks (lowest) of each book; ties by level."""
    rank = F.when(F.col("side") == 0, -F.col("price")).otherwise(F.col("price"))
    return levels.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "side").orderBy(rank, "level"))).where(F.col("_at") <= n).drop("_at")
