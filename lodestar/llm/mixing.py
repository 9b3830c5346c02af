"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule, piecewise linear over training time 0..1. Its integral is the source's
share of the token budget. Shares above ``max_epochs`` times the source's own size are cut to that, and the
excess goes to the others by weight (water filling, in closed form over the sources sorted by cap/weight).
Inside a source documents are taken in the order of a seeded hash; a copy at token offset ``o`` of the
source's target ``T`` is trained on at the time at which the schedule's integral reaches ``o/T`` of its total.

Scale: documents are never gathered by source. The hash range is cut into ``2**BUCKET_BITS`` buckets; sums per
(source, bucket) give each bucket's start offset, and exact offsets need only a window inside a bucket, so a
source with a third of all rows is spread over all tasks.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last; documents of size 0
are never taken; rows that agree in key and size are ordered by their text's hash and are otherwise
interchangeable; an empty table gives an empty table. Other columns pass through, whatever their names, except
those that the operator adds (prefix ``mix_``), which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.runtime import Scratch

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_BITS = 12
HASH_BITS = 60

Schedule = Sequence[tuple[float, float]]


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _integral(knots: Schedule) -> list[float]:
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    return out


def flat(*weights: float) -> list[Schedule]:
    """Schedules that hold each weight throughout."""
    return [[(0.0, float(w)), (1.0, float(w))] for w in weights]


def source_targets(sizes: DataFrame, schedules: Sequence[Schedule], max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """One row per source: mix_source_size, mix_target and its schedule, from (source, size) rows.

    Sources by code point, null last, take the schedules in turn, repeating them.
    """
    totals = [_integral(s)[-1] for s in schedules]
    if min(totals) <= 0:
        raise ValueError("every schedule must have a positive integral")
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("mix_source_size"))
    ranked = by_source.withColumn("mix_k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    k = F.col("mix_k") % len(schedules)
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (k + 1).cast("int"))
    ranked = ranked.withColumn("mix_weight", pick(totals, "double")).withColumn("mix_cap", F.lit(max_epochs) * F.col("mix_source_size"))
    order = W.orderBy(F.col("mix_cap") / F.col("mix_weight"), "mix_k")
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0))
    filled = (
        ranked.withColumn("budget", F.sum("mix_source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_w", F.sum("mix_weight").over(everything))
        .withColumn("rest", F.col("budget") - zero(F.sum("mix_cap").over(before)))
        .withColumn("rest_w", F.col("all_w") - zero(F.sum("mix_weight").over(before)))
        .withColumn("full", F.col("rest") * F.col("mix_weight") > F.col("mix_cap") * F.col("rest_w"))
        .withColumn("free_rest", F.max(F.when(~F.col("full"), F.struct(F.col("rest_w"), F.col("rest")))).over(everything))
    )
    target = F.when(F.col("full") | F.col("free_rest").isNull(), F.col("mix_cap").cast("double")).otherwise(
        F.col("mix_weight") * F.col("free_rest.rest") / F.col("free_rest.rest_w")
    )
    table = lambda values: F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in values]), (k + 1).cast("int"))
    return filled.select(
        "source", "mix_source_size", target.alias("mix_target"),
        table([[t for t, _ in s] for s in schedules]).alias("mix_ts"),
        table([[w for _, w in s] for s in schedules]).alias("mix_ws"),
        table([_integral(s) for s in schedules]).alias("mix_cs"),
    )


def _invert(fraction: Column) -> Column:
    """Training time at which the schedule's integral reaches ``fraction`` of its total."""
    y = fraction * F.element_at("mix_cs", -1)
    j = F.greatest(F.lit(1), F.least(F.size(F.filter("mix_cs", lambda c: c <= y)), F.size("mix_cs") - 1))
    at = lambda name, i: F.element_at(name, i.cast("int"))
    t0, t1, w0, w1 = at("mix_ts", j), at("mix_ts", j + 1), at("mix_ws", j), at("mix_ws", j + 1)
    r = y - at("mix_cs", j)
    root = F.sqrt(F.greatest(w0 * w0 + 2 * ((w1 - w0) / (t1 - t0)) * r, F.lit(0.0)))
    return t0 + F.when(r <= 0, F.lit(0.0)).otherwise(2 * r / (w0 + root))


def mix(docs: DataFrame, schedules: Sequence[Schedule], *, max_epochs: int = 3, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """``docs`` (doc_id, source, and text or, without one, ``mix_size``) with the mix's columns.

    mix_size, mix_source_size, mix_target, mix_offset (tokens of the source before it), mix_copies (how often
    it is taken, at most ``max_epochs``), mix_taken (= copies x size) and mix_position (time of the first copy,
    null if not taken).
    """
    sized = "text" not in docs.columns
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_") and not (sized and c == "mix_size")])
    if not sized:
        docs = docs.withColumn("mix_size", n_words(F.col("text")))
    tie = F.lit(0).cast("long") if sized else F.xxhash64("text")
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    h = F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long")
    docs = docs.withColumn("mix_h", h).withColumn("mix_tie", tie).withColumn("mix_bucket", F.shiftright("mix_h", HASH_BITS - BUCKET_BITS))
    sums = docs.groupBy("source", "mix_bucket").agg(F.sum("mix_size").alias("size"))
    starts = sums.select(
        "source", "mix_bucket",
        F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("mix_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("mix_start"),
    )
    targets = source_targets(sums, schedules, max_epochs, share)
    plan = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", *[f"t.{c}" for c in targets.columns if c != "source"])
    inside = W.partitionBy("source", "mix_bucket").orderBy("mix_h", "doc_id", "mix_size", "mix_tie").rowsBetween(W.unboundedPreceding, -1)
    local = docs.withColumn("mix_in", F.coalesce(F.sum("mix_size").over(inside), F.lit(0)))
    on = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.mix_bucket") == F.col("p.mix_bucket"))
    out = local.alias("d").join(plan.alias("p"), on).select("d.*", *[f"p.{c}" for c in plan.columns if c not in ("source", "mix_bucket")])
    out = out.withColumn("mix_offset", F.col("mix_start") + F.col("mix_in"))
    fits = [((e * F.col("mix_source_size") + F.col("mix_offset") + F.col("mix_size") / 2) <= F.col("mix_target")).cast("int") for e in range(max_epochs)]
    out = out.withColumn("mix_copies", F.when(F.col("mix_size") > 0, sum(fits[1:], fits[0])).otherwise(0))
    first = F.when(F.col("mix_copies") > 0, _invert(F.col("mix_offset") / F.col("mix_target")))
    return out.withColumn("mix_taken", F.col("mix_copies") * F.col("mix_size")).withColumn("mix_position", first).drop("mix_h", "mix_tie", "mix_bucket", "mix_in", "mix_start")


_PLAN = ("mix_ts", "mix_ws", "mix_cs")

#: The query's schedules: integrals 5, 2 and 1, the first source fading out while the others come in.
FADING: list[Schedule] = [[(0.0, 8.0), (1.0, 2.0)], [(0.0, 1.0), (1.0, 3.0)], [(0.0, 0.0), (0.5, 1.0), (1.0, 2.0)]]


def curriculum(mixed: DataFrame) -> DataFrame:
    """The rows that training reads, one per copy, range-sorted by training time (``mix_position``)."""
    copies = mixed.filter("mix_copies > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    at = _invert((F.col("mix_epoch") * F.col("mix_source_size") + F.col("mix_offset")) / F.col("mix_target"))
    return copies.withColumn("mix_position", at).drop(*_PLAN).orderBy("mix_position", "doc_id", "mix_epoch")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", n_words(F.col("text")).alias("mix_size"))
    scratch = Scratch(spark, "mix")
    mixed = scratch.write(mix(docs, FADING), "mixed")
    # written, for a sort below an aggregate would be optimized away
    rows = scratch.write(curriculum(mixed).select("source", "mix_offset", "mix_position"), "curriculum")
    # rows that are taken have words, so a source and an offset are one of them
    read = rows.groupBy(F.col("source").alias("from"), F.col("mix_offset").alias("at")).agg(F.count("*").alias("n"), F.min("mix_position").alias("first_position"))
    on = F.col("source").eqNullSafe(F.col("from")) & (F.col("mix_offset") == F.col("at")) & (F.col("mix_size") > 0)
    return mixed.join(read, on, "left").select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.coalesce("n", F.lit(0)) * F.col("mix_size")).cast("long").alias("taken"), "first_position",
    ).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 3 * source_size AS cap FROM k),
f AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(cap) OVER o AS DOUBLE), 0) AS rest,
         CAST(sum(w) OVER () AS DOUBLE) - coalesce(sum(w) OVER o, 0) AS rest_w
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, rest * w > cap * rest_w AS filled FROM f),
free AS (SELECT rest, rest_w FROM g WHERE NOT filled ORDER BY rest_w DESC LIMIT 1),
t AS (SELECT g.source, g.source_size, g.w, CASE WHEN g.filled OR free.rest IS NULL THEN CAST(g.cap AS DOUBLE) ELSE g.w * free.rest / free.rest_w END AS target
      FROM g LEFT JOIN free ON true),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.w,
         coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CASE WHEN size > 0 THEN
       CAST(off + size / 2.0::DOUBLE <= target AS INT) + CAST(source_size + off + size / 2.0::DOUBLE <= target AS INT)
     + CAST(2 * source_size + off + size / 2.0::DOUBLE <= target AS INT) ELSE 0 END AS copies
  FROM o),
v AS (  -- the piece of the schedule in which the integral reaches off / target of its total: knots t0, t1, weights w0, w1, r beyond t0
  SELECT *, off / target * w AS y FROM c WHERE copies > 0),
p AS (
  SELECT doc_id, size, source_size, target, copies,
         CASE w WHEN 1 THEN CASE WHEN y >= 0.25 THEN 0.5 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS t0, CASE w WHEN 1 THEN CASE WHEN y >= 0.25 THEN 1.0 ELSE 0.5 END ELSE 1.0 END::DOUBLE AS t1,
         CASE w WHEN 5 THEN 8.0 WHEN 2 THEN 1.0 ELSE CASE WHEN y >= 0.25 THEN 1.0 ELSE 0.0 END END::DOUBLE AS w0,
         CASE w WHEN 5 THEN 2.0 WHEN 2 THEN 3.0 ELSE CASE WHEN y >= 0.25 THEN 2.0 ELSE 1.0 END END::DOUBLE AS w1,
         y - CASE WHEN w = 1 AND y >= 0.25 THEN 0.25 ELSE 0.0 END::DOUBLE AS r
  FROM v)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
       CASE WHEN r <= 0 THEN t0 ELSE t0 + 2 * r / (w0 + sqrt(greatest(w0 * w0 + 2 * ((w1 - w0) / (t1 - t0)) * r, 0.0::DOUBLE))) END AS first_position
FROM p
UNION ALL SELECT doc_id, size, source_size, target, 0, NULL FROM c WHERE copies = 0
"""
