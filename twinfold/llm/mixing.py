"""Mixing sources to target weights: capped water-filling and seeded repetition. DataFrame functions only.

A source's target is ``min(cap, weight * level)``: the level at which the targets use up the
budget. Sources at their cap (``max_epochs`` times their size) are clamped and their excess is
shared by weight among the rest. The level is found in closed form over the table of sources,
sorted by cap / weight: the clamped ones are a prefix.

A target of ``whole + fraction`` epochs repeats every document ``whole`` times and a seeded
random prefix of the source once more: documents are ordered by a keyed hash, and one is in
while the middle of its words lies below the fraction's words. So a source misses its
target by less than one document. The prefix sum is in two levels, over hash buckets first, and
only the bucket where the target is met is summed by document; no source meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, stage, table

#: Rows of the source table up to which it is broadcast; beyond it is joined by a shuffle.
MAX_BROADCAST_SOURCES = 10_000
#: The mix's own columns.
COLUMNS = ("doc_id", "source", "size", "source_size", "target", "epochs", "taken")
#: Documents to a hash bucket, about.
BUCKET_ROWS = 256


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Weights repeat over the sources in code point order, null last. The budget is share times all
    sizes, and no more than max_epochs times them. An empty source has target 0.
    """
    one = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int"))
    t = sizes.select("source", "source_size", w.alias("w")).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    below, rest = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    t = t.withColumn("budget", F.least(F.sum("source_size").over(everything) * F.lit(float(share)), F.sum("cap").over(everything)))
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(rest))
    # the first source, by ratio, that the level leaves below its cap fixes the level of all
    t = t.withColumn("free", F.when(F.col("cap") / F.col("w") > F.col("level"), F.col("level")))
    level = F.first("free", ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return t.withColumn("at", level).select("source", "source_size", F.coalesce(F.least("cap", F.col("w") * F.col("at")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, taken, and the columns in keep.

    epochs is how often the mix repeats the document, taken is epochs times size in words. Null text
    has size 0 and takes nothing; null sources form one source; the hash is of id and text, so rows with
    equal or no ids are told apart by their texts, and equal rows are alike. No document is repeated more than max_epochs
    times. An empty table gives an empty mix. Only doc_id, text, source and the columns in keep are read.
    """
    spark = docs.sparkSession
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit("")))), 1, 15), 16, 10).cast("long")
    size = n_words(F.col("text"))
    sized = stage(docs.select("doc_id", "source", size.alias("size"), h.alias("h")), "sized")
    bits = max(0, min(20, math.ceil(math.log2(max(1, sized.count()) / BUCKET_ROWS))))
    sized = sized.withColumn("bucket", F.shiftright("h", 60 - bits))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    plan = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("long")).withColumn("more", F.col("target") - F.col("whole") * F.col("source_size"))
    up_to = W.partitionBy("source").orderBy("bucket")
    sums = buckets.withColumn("before", F.sum("words").over(up_to) - F.col("words")).withColumnRenamed("source", "s")
    edge = sums.join(plan.select(F.col("source").alias("s2"), "more"), F.col("s").eqNullSafe(F.col("s2"))).filter(F.col("before") + F.col("words") > F.col("more"))
    edge = edge.groupBy(F.col("s").alias("es")).agg(F.min(F.struct("bucket", "before")).alias("e"))
    plan = plan.join(edge, F.col("source").eqNullSafe(F.col("es")), "left").select(F.col("source").alias("ps"), "source_size", "target", "whole", "more", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before"))
    plan = stage(plan, "mixplan")
    few = plan.count() <= MAX_BROADCAST_SOURCES
    if keep:  # from the documents again, so that texts are not written twice
        sized = docs.select("doc_id", "source", *[F.col(c).alias(f"kept_{c}") for c in keep], size.alias("size"), h.alias("h")).withColumn("bucket", F.shiftright("h", 60 - bits))
    each = sized.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("ps")))
    at_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    sure = each.filter(~at_edge).withColumn("again", F.when(F.col("more") > 0, F.coalesce((F.col("bucket") < F.col("edge")).cast("long"), F.lit(1))).otherwise(0))
    run = W.partitionBy("source").orderBy("h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(run) - F.col("size") / 2.0
    tried = each.filter(at_edge).withColumn("again", ((middle <= F.col("more")) & (F.col("more") > 0)).cast("long"))
    out = sure.unionByName(tried).withColumn("epochs", F.col("whole") + F.col("again"))
    return out.select("doc_id", "source", *[F.col(f"kept_{c}").alias(c) for c in keep], "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, source_size * 2.0::DOUBLE AS cap, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s),
r AS (SELECT *, least(sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE, sum(cap) OVER ()) AS budget,
        coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
        sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT min_by((budget - clamped) / rest, cap / w) AS level FROM r WHERE cap / w > (budget - clamped) / rest),
p AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT level FROM l)), cap) AS target FROM w),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM p),
m AS (SELECT d.*, q.source_size, q.target, q.whole,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0 AS middle
      FROM sized d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN middle <= target - whole * source_size AND target > whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM m
"""
