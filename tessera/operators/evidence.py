"""Benchmark evidence: medians, paired block bootstrap, verdicts, gates, Pareto frontiers, interference flags."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the band of no difference by kind of metric; block length, draws and seed of the bootstrap.
BANDS = {"bytes": 0.02, "time": 0.05, "rss": 0.10, "cpu": 0.05}
BLOCK, DRAWS, SEED = 3, 10_000, 20_261_017


def group_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, median (mean of the middle two), minimum, maximum of each group."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"))


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median and the unscaled median of absolute deviations from it, of each group."""
    middle = df.groupBy(*keys).agg(F.median(value).alias("median"))
    return df.join(middle, keys).groupBy(*keys).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def upper_median_p95(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The upper median, sorted[n div 2], and the nearest-rank 95th percentile, sorted[ceil(0.95 n) - 1]; by rank, no list in memory."""
    own = Window.partitionBy(*keys)
    ranked = df.withColumn("_at", F.row_number().over(own.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(own))
    late = F.ceil(F.col("_n") * 95 / 100) - 1
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_at") == F.floor(F.col("_n") / 2), F.col(value))).alias("upper_median"), F.max(F.when(F.col("_at") == late, F.col(value))).alias("p95")
    )


def pareto(df: DataFrame, keys: list[str], name: str, axes: list[str]) -> DataFrame:
    """Variants of each case that no other dominates (as low on every axis, lower on one)."""
    a, b = df.alias("a"), df.alias("b")
    at = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    no_worse = [F.col(f"b.{x}") <= F.col(f"a.{x}") for x in axes]
    better = F.lit(False)
    for x in axes:
        better = better | (F.col(f"b.{x}") < F.col(f"a.{x}"))
    on = better & (F.col(f"a.{name}") != F.col(f"b.{name}"))
    for c in at + no_worse:
        on = on & c
    return a.join(b, on, "left_anti")


def compare(df: DataFrame, keys: list[str], name: str, axes: list[str]) -> DataFrame:
    """Each candidate against each other variant of its case: keys, candidate, baseline, the ratio on each axis."""
    a, b = df.alias("a"), df.alias("b")
    on = F.col(f"a.{name}") != F.col(f"b.{name}")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, on).select(
        *[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{name}").alias("candidate"), F.col(f"b.{name}").alias("baseline"),
        *[(F.col(f"a.{x}") / F.col(f"b.{x}")).alias(f"{x}_ratio") for x in axes],
    )


def gates(compared: DataFrame, axes: list[str]) -> DataFrame:
    """candidate, wins (baselines beaten on all axes), all_won of each candidate."""
    won = F.lit(True)
    for x in axes:
        won = won & (F.col(f"{x}_ratio") < 1)
    return compared.groupBy("candidate").agg(F.count_if(won).alias("wins"), F.every(won).alias("all_won"))


def verdict(ratio: Column, low: Column, high: Column, band: float) -> Column:
    """BETTER, WORSE, EQUIVALENT or INCONCLUSIVE from a ratio and its interval; tested in this order."""
    return (
        F.when((high < 1) & (ratio <= 1 - band), "BETTER")
        .when((low > 1) & (ratio >= 1 + band), "WORSE")
        .when((low >= 1 - band) & (high <= 1 + band), "EQUIVALENT")
        .otherwise("INCONCLUSIVE")
    )


def flags(failed: Column, busy: Column, wall: Column, cpu_ratio: Column, warm_read_ms: Column) -> Column:
    """Interference flags of a sample as an array: process_failed, sibling_busy, low_cpu_ratio."""
    found = F.array(
        F.when(failed, F.lit("process_failed")),
        F.when(busy > F.greatest(F.lit(5), wall * 0.10), F.lit("sibling_busy")),
        F.when((cpu_ratio < 0.85) & (warm_read_ms >= 100), F.lit("low_cpu_ratio")),
    )
    return F.filter(found, lambda x: x.isNotNull())


def valid_rounds(samples: DataFrame, flagged: DataFrame, keys: list[str]) -> DataFrame:
    return samples.join(flagged.select(*keys).distinct(), keys, "left_anti")


class _Stream:
    """random.Random(seed).randrange(n), many at a time."""

    def __init__(self, seed: int, n: int):
        state = random.Random(seed).getstate()[1]
        raw = np.random.MT19937()
        raw.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
        if n >= 2**32:
            raise ValueError("fewer than 2**32 rounds")
        self.raw, self.n, self.shift, self.rest = np.random.RandomState(raw), n, np.uint32(32 - n.bit_length()), np.zeros(0, np.uint32)

    def take(self, count: int) -> np.ndarray:
        while len(self.rest) < count:
            most = (1 << 32 - int(self.shift)) / self.n  # numbers from n on are drawn again
            drawn = self.raw.randint(0, 2**32, int(1.01 * most * (count - len(self.rest))) + 64, np.uint32) >> self.shift
            drawn = drawn.compress(drawn < self.n)
            self.rest = np.concatenate((self.rest, drawn)) if len(self.rest) else drawn
        taken, self.rest = self.rest[:count], self.rest[count:]
        return taken


def _drawn_blocks(n: int, size: int, draws: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """How many blocks of each draw (rows) begin at each round, and where the last one begins; as many draws at a time as have about 2**17 counts, or one."""
    stream, blocks, step = _Stream(seed, n - size + 1), -(-n // size), max(1, (1 << 17) // n)
    for at in range(0, draws, step):
        rows = min(step, draws - at)
        starts = stream.take(rows * blocks).reshape(rows, blocks)
        yield np.array([np.bincount(x, minlength=n) for x in starts]), starts[:, -1].astype(np.int64)


def _resampled_medians(series: list[np.ndarray], block: int, draws: int, seed: int, sigmas: int = 6) -> np.ndarray:
    """Medians of each series (rows) over the rounds of each draw. A draw's median lies among the ranks about the middle: the rounds below these are counted by one
    product for all series, only those among them by rank. Where it lies elsewhere the draw is counted by all ranks."""
    n = len(series[0])
    size = min(block, n)
    orders = [np.argsort(s, kind="stable") for s in series]
    values = [s[o] for s, o in zip(series, orders, strict=True)]
    wanted = ((n - 1) // 2, n // 2)
    reach = int(sigmas * math.sqrt(n) / 2) + 1
    first, end = max(0, wanted[0] - reach), min(n, wanted[1] + reach + 1)
    low = np.zeros((len(series), n + size - 1), bool)
    for i, order in enumerate(orders):
        low[i, order[:first]] = True
    exact = np.float32 if n < 2**23 else np.float64  # sums of counts are whole numbers, n + size at the most
    low_in_block = sum(low[:, k : k + n].astype(exact) for k in range(size))
    cut = range(n - (-(-n // size) - 1) * size, size)  # rounds of the last block that are beyond the draw

    def counted(begun: np.ndarray, last: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """How often each of some rounds is in each draw."""
        out = np.take(begun, rounds, axis=1)
        for k in range(1, size):
            out += np.take(begun, rounds - k, axis=1)  # no block begins at the last rounds, which are read for rounds before the first
        for k in cut:
            out -= rounds == last[:, None] + k
        return out

    found, at = np.empty((len(series), draws)), 0
    for begun, last in _drawn_blocks(n, size, draws, seed):
        before = np.array([low_in_block @ x for x in begun.astype(exact)]).astype(np.int64)
        for k in cut:
            before -= low[:, last + k].T
        for i, (order, value) in enumerate(zip(orders, values, strict=True)):
            upto = np.cumsum(counted(begun, last, order[first:end]), axis=1)
            upto += before[:, i, None]
            lower, upper = (np.count_nonzero(upto <= w, axis=1) + first for w in wanted)
            for d in np.flatnonzero((before[:, i] > wanted[0]) | (upto[:, -1] <= wanted[1])):
                whole = np.cumsum(counted(begun[d : d + 1], last[d : d + 1], order)[0])
                lower[d], upper[d] = np.searchsorted(whole, wanted, side="right")
            found[i, at : at + len(last)] = (value[lower] + value[upper]) / 2
        at += len(last)
    return found


def _interval(above: np.ndarray, below: np.ndarray) -> tuple[float, float]:
    draws = len(above)
    ratios = np.sort(np.where(below == 0, np.inf, above / np.where(below == 0, 1, below)))
    return float(ratios[int(0.025 * draws)]), float(ratios[min(draws - 1, math.ceil(0.975 * draws) - 1)])


def _ratio(a: np.ndarray, b: np.ndarray) -> float:
    base = float(np.median(b))
    return float(np.median(a)) / base if base else float("inf")


def bootstrap(a: np.ndarray, b: np.ndarray, block: int = BLOCK, draws: int = DRAWS, seed: int = SEED) -> tuple[float, float, float]:
    """Ratio of medians of paired series and its 95 % interval by moving blocks."""
    if len(a) < 2 or len(a) != len(b):
        raise ValueError("paired series of two or more rounds")
    return _ratio(a, b), *_interval(*_resampled_medians([a, b], block, draws, seed))


def bootstrap_both(a: np.ndarray, b: np.ndarray, draws: int = DRAWS, seed: int = SEED) -> list[tuple[float, ...]]:
    """Ratio, interval by moving blocks and interval by single rounds (the sensitivity result), of a to b and of b to a over the same draws."""
    if len(a) < 2 or len(a) != len(b):
        raise ValueError("paired series of two or more rounds")
    (x, y), (u, v) = (_resampled_medians([a, b], size, draws, seed) for size in (BLOCK, 1))
    return [(_ratio(a, b), *_interval(x, y), *_interval(u, v)), (_ratio(b, a), *_interval(y, x), *_interval(v, u))]


def bootstrap_against(base: np.ndarray, others: list[np.ndarray], block: int, draws: int = DRAWS, seed: int = SEED) -> list[tuple[float, ...]]:
    """For each other series, cut to the length of ``base``: ratio and interval of base to it, then of it to base. All share the draws."""
    n = len(base)
    if n < 2 or any(len(x) < n for x in others):
        raise ValueError("paired series of two or more rounds")
    x, *rest = _resampled_medians([base, *[o[:n] for o in others]], block, draws, seed)
    return [(_ratio(base, o[:n]), *_interval(x, y), _ratio(o[:n], base), *_interval(y, x)) for o, y in zip(others, rest, strict=True)]


#: Measured rounds of a full cell, largest share of a cold file that may be resident.
MEASURED_ROUNDS, COLD_LIMIT = 15, 0.10


def first_match(samples: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first sample of each key tuple."""
    rest = F.struct(*[c for c in samples.columns if c not in keys])
    return samples.groupBy(*keys).agg(F.min_by(rest, order).alias("s")).select(*keys, "s.*")


def measured(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of measured rounds in which no sample of the cell is flagged."""
    flagged = samples.where(F.size("flags") > 0).select(*keys, "round").distinct()
    return samples.where(F.col("role") == "measured").join(flagged, [*keys, "round"], "left_anti")


def cell_summary(samples: DataFrame, keys: list[str], rounds: int = MEASURED_ROUNDS) -> DataFrame:
    """Of each cell: attempted, valid and flagged measured rounds, and whether these are too few. Partial aggregation by round, then by cell."""
    by_round = samples.groupBy(*keys, "round").agg(F.bool_or(F.col("role") == "measured").alias("measured"), F.bool_or(F.size("flags") > 0).alias("flagged"))
    counted = by_round.groupBy(*keys).agg(
        F.count_if("measured").alias("attempted"), F.count_if(F.col("measured") & ~F.col("flagged")).alias("valid"), F.count_if(F.col("measured") & F.col("flagged")).alias("flagged")
    )
    return counted.withColumn("underpowered", F.col("valid") < rounds)


def candidate_summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Of each candidate of a cell: exact (all digests right; null without one), cold_comparable (half of the cold reads at most COLD_LIMIT resident; null without one)."""
    cold = F.median(F.when(F.col("cache") == "cold", F.col("resident")))
    return samples.groupBy(*keys, "candidate").agg(F.every("digest_ok").alias("exact"), (cold <= COLD_LIMIT).alias("cold_comparable"))


def round_metrics(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Of each candidate and round: bytes, operation and end-to-end times by phase and cache, memory and CPU above the empty process (0 at least). One aggregation."""

    def one(value: str, phase: str, cache: str | None = None) -> Column:
        at = F.col("phase") == phase
        return F.min_by(F.when(at & (F.col("cache") == cache) if cache else at, F.col(value)), F.when(at & (F.col("cache") == cache) if cache else at, F.col("place")))

    def above(value: str, phase: str, cache: str | None = None) -> Column:
        """Null unless both are there."""
        over = one(value, phase, cache) - one(value, "noop")
        return F.when(over.isNotNull(), F.greatest(over, F.lit(0)))

    return samples.groupBy(*keys, "candidate", "round").agg(
        one("bytes", "write").alias("bytes"), one("op_ns", "write").alias("write_op"), one("e2e_ns", "write").alias("write_e2e"),
        one("op_ns", "read-full", "warm").alias("read_full_warm_op"), one("op_ns", "read-full", "cold").alias("read_full_cold_op"),
        one("op_ns", "read-range", "warm").alias("read_range_warm_op"), one("op_ns", "read-range", "cold").alias("read_range_cold_op"),
        above("rss_kb", "write").alias("rss_write"), above("rss_kb", "read-full", "warm").alias("rss_full"),
        above("cpu_ns", "write").alias("cpu_write"), above("cpu_ns", "read-full", "warm").alias("cpu_full"),
    )


def savings(df: DataFrame, name: str, base: str, axes: list[str], warmup: int) -> DataFrame:
    """Medians of each mode without the warm-up round, what each saves against ``base`` in percent, and on how many axes it is below all others."""
    middle = df.where(F.col("round") != warmup).groupBy(name).agg(*[F.median(x).alias(x) for x in axes])
    own = middle.select(F.lit(1).alias("_one"), "*")
    best = middle.where(F.col(name) == base).select(F.lit(1).alias("_one"), *[F.col(x).alias(f"base_{x}") for x in axes])
    a, b = middle.alias("a"), middle.alias("b")
    beaten = [F.col(f"b.{x}") <= F.col(f"a.{x}") for x in axes]  # one row a mode
    won = a.join(b, F.col(f"a.{name}") != F.col(f"b.{name}")).groupBy(F.col(f"a.{name}").alias(name)).agg(sum((F.coalesce((~F.bool_or(x)).cast("int"), F.lit(0)) for x in beaten), F.lit(0)).alias("best_on"))
    saved = [(F.lit(100.0) * (F.lit(1.0) - F.col(x) / F.col(f"base_{x}"))).alias(f"saved_{x}") for x in axes]
    return own.join(best, "_one").join(won, name, "left").select(name, *axes, *saved, F.coalesce("best_on", F.lit(len(axes))).alias("best_on"))


def rotated(candidates: DataFrame, rounds: int) -> DataFrame:
    """round, place, name: in round r the list begins at its r-th name, and is turned round in odd rounds. candidates: i (from 0), name."""
    n = candidates.count()
    every = candidates.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    place = F.pmod(F.col("i") - F.col("round"), F.lit(n))
    return every.select("round", F.when(F.col("round") % 2 == 1, F.lit(n - 1) - place).otherwise(place).cast("long").alias("place"), "name")


def plan_matrix(cells: DataFrame, warmups: int, rounds: int, extra: int) -> DataFrame:
    """Of each cell (dataset, variant, candidates): processes a round (six phases of each candidate, one read of the source, one normalisation of a v2), fewest and most of all rounds."""
    each = F.col("candidates") * 6 + 1 + F.when(F.col("variant") == "v2", 1).otherwise(0)
    return cells.select("dataset", "variant", each.alias("per_round"), (each * (warmups + rounds)).alias("fewest"), (each * (warmups + rounds + extra)).alias("most"))


def receipts(recorded: DataFrame, actual: DataFrame, redactions: DataFrame) -> DataFrame:
    """path, status of each recorded file: 'original bytes', 'redacted copy', 'MISMATCH' (also where the file is gone). recorded: path, sha256; actual: path, sha256;
    redactions: path, original_sha256, public_sha256."""
    met = recorded.join(actual.withColumnRenamed("sha256", "now"), "path", "left").join(redactions, "path", "left")
    redacted = (F.col("original_sha256") == F.col("sha256")) & (F.col("public_sha256") == F.col("now"))
    return met.select("path", F.when(F.col("now") == F.col("sha256"), "original bytes").when(redacted, "redacted copy").otherwise("MISMATCH").alias("status"))


def stale(redactions: DataFrame, actual: DataFrame) -> DataFrame:
    """path of redactions whose public copy is not what they say."""
    met = redactions.join(actual.withColumnRenamed("sha256", "now"), "path", "left")
    return met.where(~F.coalesce(F.col("now") == F.col("public_sha256"), F.lit(False))).select("path")


def manifest_difference(listed: DataFrame, tracked: DataFrame) -> DataFrame:
    """path, problem: tracked files that the manifest lacks, and listed ones that are not tracked."""
    lacking = tracked.join(listed, "path", "left_anti").select("path", F.lit("not listed").alias("problem"))
    return lacking.unionByName(listed.join(tracked, "path", "left_anti").select("path", F.lit("not tracked").alias("problem")))


def evidence_problems(required: list[str], files: DataFrame, recorded: DataFrame, texts: DataFrame) -> DataFrame:
    """path, problem of an evidence folder: required files that are missing, recorded hashes that differ or have no file, texts that leak. files: path, sha256;
    recorded: path, sha256; texts: path, text. Empty: verified."""
    from ..functions.exact import leaks

    wanted = files.sparkSession.createDataFrame([(x,) for x in required], "path string")
    missing = wanted.join(files, "path", "left_anti").select("path", F.lit("missing").alias("problem"))
    met = recorded.join(files.withColumnRenamed("sha256", "now"), "path", "left").where(~F.coalesce(F.col("now") == F.col("sha256"), F.lit(False)))
    return missing.unionByName(met.select("path", F.lit("hash").alias("problem"))).unionByName(texts.where(leaks(F.col("text"))).select("path", F.lit("leak").alias("problem")))


def resumed(lines: DataFrame, schema: str) -> DataFrame:
    """Records of an append-only file of JSON lines (column value); torn lines of a crash and empty ones are left out, their rounds are run again."""
    parsed = F.from_json("value", f"{schema}, _torn string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"})
    return lines.where(F.length(F.trim("value")) > 0).select(parsed.alias("r")).where(F.col("r._torn").isNull()).select("r.*").drop("_torn")


def sanitised(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """A struct column without the fields that must not be published; fields that it does not have are left out."""
    return df.withColumn(column, F.col(column).dropFields(*fields))


def append_line(path: str, record: dict) -> None:
    """One JSON line at the end of a checkpoint file on the driver's disk, synced; a torn last line of a crash is ended first."""
    import json
    import os

    with open(path, "ab+") as f:
        size = f.seek(0, os.SEEK_END)
        if size:
            f.seek(-1, os.SEEK_END)
            if f.read(1) != b"\n":
                f.write(b"\n")
        f.write(json.dumps(record, sort_keys=True).encode() + b"\n")
        f.flush()
        os.fsync(f.fileno())


def sealed(files: DataFrame) -> DataFrame:
    """One receipt of a folder: files, and the SHA-256 over their sorted names and hashes. files: path, sha256. The list of a folder's files is small, its contents need not be."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws("  ", "sha256", "path"))), "\n")
    return files.agg(F.count(F.lit(1)).alias("files"), F.sha2(lines, 256).alias("seal"))
