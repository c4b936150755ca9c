"""Mixing sources to target weights by Sainte-Laguë apportionment (native: DataFrame functions only).

1. Targets. Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share
   ``share`` times all words; a target stops at ``ceiling`` times its source's words and
   the excess goes to the others by weight. The level where this ends is found in
   closed form from running sums over the sources.
2. Blocks. Each source is dealt into about 2 * sqrt(documents) shards by a seeded hash, so that
   neither a shard nor the list of shards of one source grows with the whole source. A shard is a
   line of words (its documents in seeded order) cut into equal blocks of ``block`` words; what does
   not fill half a block lengthens the last one. By default a block is
   max(1, floor(sqrt(all words) / 512)) words.
3. Quotas. Blocks go to sources, and a source's blocks to its shards, by highest quotients
   weight / (2k + 1). Seats that are certain are counted at once; only as many quotients as there
   are parties, times a small factor, compete in a sort.
4. Selection. Every block of a shard is taken floor(quota / blocks) times, and what is left of the quota goes to neighbouring blocks from a
   seeded offset on (round the end). Documents lie in seeded order, so these are random documents, and at most two of a shard
   are cut. Counts before any word position are in closed form, so no block becomes a row.

Defined cases: null text has 0 words and takes 0; a null source is one source, last in order; a source without
words has target 0; repeated rows are separate documents; rows without doc_id are dealt by their text; texts of any length are counted whole; an empty table gives an empty
result; other columns, of any name, are ignored by mix() and kept by apply_mix(). Ties in quotients go to the earlier source or shard, those in the order of a shard to the
doc_id, the size and a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, key_of

SEED = "mix-1"
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Words become one letter each and white space goes: the length is the count, without an array of all words."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), "\x20\x09\x0a\x0b\x0c\x0d", "")), F.lit(0)).cast("long")


def seeded(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *parts))


def hex_long(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame, share: float = 1.5, ceiling: int = 2) -> DataFrame:
    """key, source, source_size, n_docs, pos, target, total: one row for each source."""
    stats = sized.groupBy("key").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    line = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = stats.withColumn("pos", F.row_number().over(line)).withColumn("total", F.sum("source_size").over(every))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("pos") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight.cast("long")).withColumn("full", F.lit(ceiling) * F.col("source_size") / F.col("w"))
    fill = Window.orderBy("full", "pos").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.lit(ceiling) * F.col("source_size")).over(fill), F.lit(0))
    gone = F.coalesce(F.sum("w").over(fill), F.lit(0))
    level = (F.lit(share) * F.col("total") - spent) / (F.sum("w").over(every) - gone)
    ranked = ranked.withColumn("level", level).withColumn("at", F.row_number().over(Window.orderBy("full", "pos")))
    found = F.min(F.when(F.col("level") <= F.col("full"), F.struct("at", "level"))).over(every)
    return (
        ranked.withColumn("found", found)
        .withColumn("target", F.least((F.lit(ceiling) * F.col("source_size")).cast("double"), F.coalesce(F.col("found.level") * F.col("w"), F.lit(float("inf")))))
        .select("key", "source", "source_size", "n_docs", "pos", "target", "total")
    )


def apportion(parties: DataFrame, group: list[str], order: str, weight: str, seats: str) -> DataFrame:
    """Adds ``quota``: seats of each party of a group by highest quotients weight / (2k + 1).

    A divisor so large that rounding cannot give too many seats gives those that are certain; one so
    small that rounding cannot give too few bounds the quotients that compete for the rest.
    """
    own = Window.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(own), F.sum(weight).over(own)
    share = F.when(total > 0, F.col(weight) / total).otherwise(F.lit(0.0))
    bounded = (
        parties.withColumn("_n", n)
        .withColumn("_share", share)
        .withColumn("_base", F.floor(F.greatest(F.lit(0.0), F.col("_share") * (F.col(seats) - F.col("_n") / 2)) + F.lit(0.5)).cast("long"))
        .withColumn("_base", F.when(F.col(seats) > F.col("_n") / 2, F.col("_base")).otherwise(F.lit(0)))
        .withColumn("_top", F.floor(F.col("_share") * (F.col(seats) + F.col("_n") / 2) + F.lit(0.5)).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_base").over(own))
    )
    keys = [*group, order]
    race = (
        bounded.where(F.col("_share") > 0)
        .select(*keys, weight, "_open", F.explode(F.sequence(F.col("_base"), F.col("_top"))).alias("_k"))
        .withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc(), order)))
        .where(F.col("_at") <= F.col("_open"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    return (
        bounded.join(race, keys, "left")
        .withColumn("quota", F.col("_base") + F.coalesce(F.col("_won"), F.lit(0)))
        .drop("_n", "_share", "_base", "_top", "_open", "_won")
    )


def taken_before(x: Column) -> Column:
    """Words that the mix takes of the first x words of a shard."""
    b, m, q, u = (F.col(c) for c in ("block", "blocks", "quota", "offset"))
    each, extra = F.floor(q / m), F.pmod(q, m)

    def chosen(y: Column) -> Column:
        """Blocks before the y-th that get one more time, the offset being block 0."""
        return F.floor(y / m) * extra + F.least(F.pmod(y, m), extra)

    j = F.least(F.floor(x / b), m - 1)
    before = j * each + chosen(j - u + m) - chosen(m - u)
    times = each + F.when(F.pmod(j - u + m, m) < extra, F.lit(1)).otherwise(F.lit(0))
    return F.when(m > 0, b * before + times * (x - j * b)).otherwise(F.lit(0))


def _sized(docs: DataFrame, *carry: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        key_of("source").alias("key"),
        word_count(F.col("text").cast("string")).alias("size"),
        seeded(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce(F.md5(F.col("text").cast("string")), F.lit(""))))).alias("h"),
        F.xxhash64(F.col("text").cast("string")).alias("tie"),
        *carry,
    )


def place(docs: DataFrame, share: float = 1.5, ceiling: int = 2, block: int | None = None, carry: bool = False) -> DataFrame:
    """doc_id, size, source, source_size, target, taken of every row and, if asked for, the whole row as ``row``."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.table(_sized(docs), "sized")
    length = F.greatest(F.lit(1), F.floor(F.sqrt(F.col("total")) / 512)).cast("long") if block is None else F.lit(block).cast("long")
    targets = source_targets(sized, share, ceiling).withColumn("block", length).withColumn("shards", F.ceil(2 * F.sqrt("n_docs")).cast("long"))
    targets = scratch.table(targets, "targets").drop("source")

    def deal(rows: DataFrame) -> DataFrame:
        return rows.join(targets, "key").withColumn("shard", F.pmod(hex_long(F.col("h")), F.col("shards")))

    words = deal(sized).groupBy("key", "shard").agg(
        F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("pos", "target", "total", "block")]
    )
    blocks = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.floor((2 * F.col("words") + F.col("block")) / (2 * F.col("block"))))).otherwise(F.lit(0)).cast("long")
    shards = scratch.table(words.withColumn("blocks", blocks), "shards")

    sources = shards.groupBy("key").agg(F.sum("blocks").alias("all_blocks"), *[F.first(c).alias(c) for c in ("pos", "target", "total", "block")])
    sources = sources.withColumn("one", F.lit(1)).withColumn("seats", F.floor(share * F.col("total") / F.col("block")).cast("long"))
    sources = apportion(sources, ["one"], "pos", "target", "seats").select("key", F.least("quota", ceiling * F.col("all_blocks")).alias("seats"))
    quotas = apportion(shards.join(sources, "key"), ["key"], "shard", "blocks", "seats").select(
        "key", "shard", "blocks", "quota",
        F.when(F.col("blocks") > 0, F.pmod(hex_long(seeded(F.col("key"), F.col("shard").cast("string"))), F.col("blocks"))).otherwise(F.lit(0)).alias("offset"),
    )
    quotas = scratch.table(quotas, "quotas")

    line = Window.partitionBy("key", "shard").orderBy("h", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    dealt = deal(_sized(docs, F.struct(*docs.columns).alias("row")) if carry else sized)
    placed = dealt.withColumn("end", F.sum("size").over(line)).join(quotas, ["key", "shard"])
    return placed.select(
        "doc_id", "size", "source", "source_size", "target",
        (taken_before(F.col("end")) - taken_before(F.col("end") - F.col("size"))).cast("long").alias("taken"),
        *(["row"] if carry else []),
    )


def mix(docs: DataFrame, share: float = 1.5, ceiling: int = 2, block: int | None = None) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, taken (words, repeats counted)."""
    return place(docs, share, ceiling, block)


def apply_mix(docs: DataFrame, share: float = 1.5, ceiling: int = 2) -> DataFrame:
    """The mix as documents, all columns kept: a whole copy for each full time a document is taken, and its first words (joined by one
    space) for what is left; n_chars, where there is one, follows the text."""
    placed = place(docs, share, ceiling, carry=True).where("taken > 0")
    copies = placed.select("row", "size", "taken", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("copy"))
    part = F.col("copy") * F.col("size") > F.col("taken")
    whole = F.col("row.text").cast("string")
    first = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), F.lit(1), F.pmod("taken", "size").cast("int")), " ")
    values = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.when(part, first).otherwise(whole)}
    if "n_chars" in values:
        values["n_chars"] = F.length(values["text"]).cast(docs.schema["n_chars"].dataType)
    return copies.select(*[values[c].alias(c) for c in docs.columns])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null:' || coalesce(md5(text), ''))) AS h
  FROM documents),
stats AS (SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY key),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS pos, sum(source_size) OVER ()::BIGINT AS total FROM stats),
weighed AS (SELECT *, [3, 1, 2][((pos - 1) % 3 + 1)::INT]::BIGINT AS w FROM ranked),
filled AS (SELECT *, (2 * source_size)::DOUBLE / w AS cap FROM weighed),
levels AS (
  SELECT *, row_number() OVER (ORDER BY cap, pos) AS step,
    (1.5::DOUBLE * total - coalesce(sum(2 * source_size) OVER (ORDER BY cap, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM filled),
pick AS (SELECT arg_min(level, step) AS level FROM levels WHERE level <= cap),
targets AS (
  SELECT key, source_size, n_docs, pos, total, least((2 * source_size)::DOUBLE, pick.level * w) AS target,
    greatest(1, floor(sqrt(total::DOUBLE) / 512))::BIGINT AS block, ceil(2 * sqrt(n_docs::DOUBLE))::BIGINT AS shards
  FROM levels, pick),
dealt AS (
  SELECT s.doc_id, s.size, s.h, s.key, t.source_size, t.target, t.pos, t.total, t.block,
    (('0x' || substr(s.h, 1, 8))::BIGINT % t.shards) AS shard
  FROM sized s JOIN targets t USING (key)),
shards AS (
  SELECT key, shard, sum(size)::BIGINT AS words, any_value(pos) AS pos, any_value(target) AS target, any_value(total) AS total, any_value(block) AS block
  FROM dealt GROUP BY key, shard),
cut AS (SELECT *, CASE WHEN words > 0 THEN greatest(1, (2 * words + block) // (2 * block)) ELSE 0 END AS blocks FROM shards),
src AS (
  SELECT key, sum(blocks)::BIGINT AS all_blocks, any_value(pos) AS pos, any_value(target) AS target,
    floor(1.5 * any_value(total) / any_value(block))::BIGINT AS seats
  FROM cut GROUP BY key),
src_seats AS (
  SELECT key, least(q, 2 * all_blocks) AS seats FROM (
    SELECT s.key, s.all_blocks, count(r.k) AS q FROM src s LEFT JOIN (
      SELECT key, k FROM (
        SELECT key, k, seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, pos) AS place
        FROM (SELECT key, pos, target, seats, unnest(range(0, 2 * all_blocks + 2)) AS k FROM src WHERE target > 0))
      WHERE place <= seats) r ON r.key = s.key
    GROUP BY s.key, s.all_blocks)),
quotas AS (
  SELECT c.key, c.shard, c.blocks, count(r.k) AS quota,
    CASE WHEN c.blocks > 0 THEN ('0x' || substr(md5('mix-1:' || c.key || ':' || c.shard), 1, 8))::BIGINT % c.blocks ELSE 0 END AS shift
  FROM cut c LEFT JOIN (
    SELECT key, shard, k FROM (
      SELECT key, shard, k, seats, row_number() OVER (PARTITION BY key ORDER BY blocks::DOUBLE / (2 * k + 1) DESC, shard) AS place
      FROM (SELECT c.key, c.shard, c.blocks, s.seats, unnest(range(0, 2 * c.blocks + 2)) AS k FROM cut c JOIN src_seats s USING (key) WHERE c.blocks > 0))
    WHERE place <= seats) r ON r.key = c.key AND r.shard = c.shard
  GROUP BY c.key, c.shard, c.blocks),
placed AS (
  SELECT d.*, q.blocks AS m, q.quota AS q, q.shift AS u,
    sum(size) OVER (PARTITION BY d.key, d.shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS e
  FROM dealt d JOIN quotas q ON q.key = d.key AND q.shard = d.shard),
spots AS (
  SELECT *, e - size AS s, q // m AS c, q % m AS r, least(e // block, m - 1) AS je, least((e - size) // block, m - 1) AS js FROM placed WHERE m > 0),
counts AS (
  SELECT *, je * c + ((je - u + m) // m) * r + least((je - u + m) % m, r) AS be, c + CASE WHEN (je - u + m) % m < r THEN 1 ELSE 0 END AS te,
    js * c + ((js - u + m) // m) * r + least((js - u + m) % m, r) AS bs, c + CASE WHEN (js - u + m) % m < r THEN 1 ELSE 0 END AS ts
  FROM spots)
SELECT p.doc_id, p.size, x.source, p.source_size, p.target,
  ((block * be + te * (e - je * block)) - (block * bs + ts * (s - js * block)))::BIGINT AS taken
FROM counts p JOIN stats x USING (key)
UNION ALL
SELECT p.doc_id, p.size, x.source, p.source_size, p.target, 0 FROM placed p JOIN stats x USING (key) WHERE m = 0
"""
