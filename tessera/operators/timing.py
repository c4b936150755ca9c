"""Clock evidence: how well a timestamp is known, and whether an event was knowable by a cutoff. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import MAX_LONG, MIN_LONG, wide

#: Outcomes of an assessment, in the order in which they are tested.
OUTCOMES = ("InvalidReading", "MissingEvidence", "InvalidEvidence", "DifferentDomain", "FutureEvidence", "ExpiredEvidence", "Unsynchronized", "MissingGrowthModel", "ArithmeticOverflow", "Estimated")


def domain_ok(session: Column, epoch: Column) -> Column:
    return (F.length(session) > 0) & ~F.hex(session).rlike("^0*$") & (epoch != 0)


def _ceil_div(p: Column) -> Column:
    """ceil(p / 1e9) of a decimal; null where p is null or the quotient is no long (an overflow either way)."""
    e9 = F.lit("1000000000").cast("decimal(38,0)")
    low = F.pmod(p, e9)
    return wide(F.try_divide(p - low, e9)) + F.when(low > 0, wide(F.lit(1))).otherwise(wide(F.lit(0)))


def assess(df: DataFrame, reading: str = "reading", state: str = "state") -> DataFrame:
    """Adds quality, clock_state_id, error_ns, earliest_ns, latest_ns. The first test that applies wins.

    reading: session, epoch, utc_ns, monotonic_ns, read_span_ns; state (or null): session, epoch, id, collection_started_mono_ns,
    published_mono_ns, valid_until_mono_ns, synchronized, base_error_ns, growth_allowance_ppb (or null).
    error = base + ceil(age * ppb / 1e9) + span, age from the start of collection.
    """
    r, s = (lambda f: F.col(f"{reading}.{f}")), (lambda f: F.col(f"{state}.{f}"))
    mono, span = wide(r("monotonic_ns")), wide(r("read_span_ns"))
    reading_ok = domain_ok(r("session"), r("epoch")) & (mono >= 0) & (span >= 0) & (span <= mono)
    state_ok = (
        domain_ok(s("session"), s("epoch")) & (s("id") != 0) & (s("collection_started_mono_ns") >= 0)
        & (s("published_mono_ns") >= s("collection_started_mono_ns")) & (s("valid_until_mono_ns") > s("published_mono_ns")) & (s("base_error_ns") > 0)
    )
    age = mono - wide(s("collection_started_mono_ns"))
    grown = F.try_multiply(age, wide(s("growth_allowance_ppb")))
    error = wide(s("base_error_ns")) + F.expr("cast(0 as decimal(38,0))") + _ceil_div(grown) + span
    utc = wide(r("utc_ns"))
    fits = (error <= MAX_LONG) & (utc - error >= MIN_LONG) & (utc + error <= MAX_LONG)
    quality = (
        F.when(~F.coalesce(reading_ok, F.lit(False)), "InvalidReading")
        .when(F.col(state).isNull(), "MissingEvidence")
        .when(~F.coalesce(state_ok, F.lit(False)), "InvalidEvidence")
        .when((s("session") != r("session")) | (s("epoch") != r("epoch")), "DifferentDomain")
        .when(wide(s("published_mono_ns")) > mono - span, "FutureEvidence")
        .when(mono > wide(s("valid_until_mono_ns")), "ExpiredEvidence")
        .when(~s("synchronized"), "Unsynchronized")
        .when(s("growth_allowance_ppb").isNull(), "MissingGrowthModel")
        .when(~F.coalesce(fits, F.lit(False)), "ArithmeticOverflow")
        .otherwise("Estimated")
    )
    known = F.col("quality") == "Estimated"
    return (
        df.withColumn("quality", quality)
        .withColumn("clock_state_id", F.when(F.col("quality").isin(*OUTCOMES[5:]), s("id")))
        .withColumn("error_ns", F.when(known, error.cast("bigint")))
        .withColumn("earliest_ns", F.when(known, (utc - error).cast("bigint")))
        .withColumn("latest_ns", F.when(known, (utc + error).cast("bigint")))
    )


def available_by(latest: Column, cutoff: int) -> Column:
    """Whether the event was available by the cutoff even at the late end of its interval; false without an interval."""
    return F.coalesce(latest <= cutoff, F.lit(False))


def timing_error(source_resolution: Column, sequence: Column, received: str, available: str) -> Column:
    """Name of the first broken ordering rule of an event's readings, or null."""
    a, b = (lambda f: F.col(f"{received}.{f}")), (lambda f: F.col(f"{available}.{f}"))
    return (
        F.when(source_resolution.isNotNull() & (source_resolution <= 0), "InvalidSourceResolution")
        .when(sequence <= 0, "InvalidSequence")
        .when(a("session") != b("session"), "DifferentSession")
        .when(b("monotonic_ns") < a("monotonic_ns"), "MonotonicRegression")
        .when(b("epoch") < a("epoch"), "EpochRegression")
        .when((a("epoch") == b("epoch")) & (b("utc_ns") < a("utc_ns")), "WallClockRegression")
    )


def latest_state(readings: DataFrame, states: DataFrame, keys: list[str], at: str, published: str, value: str, spans: int = 64) -> DataFrame:
    """As-of: to every reading the value of the latest state of its keys published at or before it (the largest value of those published at once).

    Time is cut into ``spans`` equal spans. A task sorts one key's rows of one span; what earlier spans hand on is the last state of each, a small aggregate. A hot
    key is thus dealt to as many tasks as there are spans."""
    low, high = states.agg(F.min(published), F.max(published)).first()
    width = 1 if low is None else max(1, -(-(int(high) - int(low) + 1) // spans))
    start = 0 if low is None else int(low)
    span = lambda c: F.greatest(F.lit(0), F.least(F.lit(spans), F.floor((c - start) / width).cast("int")))
    kind = states.schema[value].dataType
    left = readings.withColumn("_at", F.col(at)).withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(kind)).withColumn("_span", span(F.col(at)))
    right = states.select(*keys, F.col(published).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value")).withColumn("_span", span(F.col("_at")))
    last = right.groupBy(*keys, "_span").agg(F.max(F.struct("_at", "_value")).alias("last"))
    earlier = last.withColumn("_to", F.explode(F.sequence(F.col("_span") + 1, F.lit(spans + 1)))).groupBy(*keys, "_to").agg(F.max("last").alias("last"))
    carried = earlier.select(*keys, F.col("last._at").alias("_at"), F.lit(-1).alias("_side"), F.col("last._value").alias("_value"), F.col("_to").alias("_span"))
    line = Window.partitionBy(*keys, "_span").orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True).withColumn("as_of", F.last("_value", ignorenulls=True).over(line))
    return both.where("_side = 1").select(*readings.columns, "as_of")
