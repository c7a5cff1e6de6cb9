"""Mixing sources to target weights by Efraimidis-Spirakis sampling (native).

Every row gets an exponential key with its quality weight as rate.  Within a source the
rows are ordered by key and their sizes prefix-summed up to the source's token budget;
whole epochs of the source come first, the sampled part last.

Defined results: a null text has size 0 and is never taken; null sources are one source,
ordered last; a key is drawn from id and text, so rows without an id or with that of others
have keys of their own; equal keys are ordered by id, then size; repeated rows count as rows
of their own; an empty table gives an empty mix; weights that are null count as 1; other
columns are ignored.

The prefix sum never needs a source in one task: keys are uniform after their
distribution function, so (source, bucket of keys) groups are small and even, the sums of
the buckets are added up per source, and each bucket continues from its predecessor's sum.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, cut, row_key


def word_count(text: Column) -> Column:
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPACE_WORD), F.lit(0))
    return F.size(words).cast("long")


def exponential_key(lots: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of the row's lot: reruns agree."""
    bits = F.shiftrightunsigned(F.xxhash64(lots, F.lit(seed)), 11)
    u = (bits.cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(u) / weight


def water_fill(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets of (source, source_size): shares of the total by weight, capped at most * source_size.

    Sources are a row of some 100 bytes each, ordered in one task; millions of them fit there.
    The excess of capped sources goes to the others by weight until none is above.  That is
    one level L with target = min(cap, L * weight): with sources in order of cap / weight,
    all before the first whose cap / weight reaches the level of the rest are capped.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("total", F.lit(share) * F.sum("source_size").over(every))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here))
    s = s.withColumn("fits", F.col("cap") / F.col("weight") >= F.col("level"))
    level = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level")))).over(every)["level"]
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def mix(
    rows: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """(id, lot, source, size, quality) to (id, source, size, source_size, target, taken).

    lot is a number that the row's key is drawn from, the same whenever it is read.
    A column row, a key of the row itself, is carried through where rows has one.
    taken is a whole multiple of size: the epochs of the source, plus one for rows within
    the rest of the budget.  The row at the edge is taken if more than half of it fits, so
    a source misses its target by half a row at most.
    """
    weight = F.greatest(F.coalesce(F.col("quality"), F.lit(1.0)).cast("double"), F.lit(1e-6))
    key = exponential_key(F.col("lot"), weight, seed)
    own = ["row"] if "row" in rows.columns else []
    rows = cut(rows.select("id", "source", "size", "lot", *own, key.alias("key")))
    # as many buckets as a bucket has rows, so neither grows with all rows; the result does not depend on it
    buckets = max(1, isqrt(rows.count()))
    # 1 - exp(-key) is uniform for weight 1 and monotone for all
    bucket = F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = water_fill(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(so_far), F.lit(0)).alias("bucket_from"))
    sums = sums.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "t.source_size", "t.target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "lot", *own).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.alias("r").join(sums.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    more = (F.col("bucket_from") + F.col("before") + F.col("r.size") / 2.0 < rest).cast("long")
    taken = ((epochs + more) * F.col("r.size")).cast("long")
    return joined.select("id", *own, F.col("r.source").alias("source"), F.col("r.size").alias("size"), "source_size", "target", taken.alias("taken"))


def quality_of(labels: DataFrame) -> DataFrame:
    """Weights of labelled documents: good ones twice, bad ones half as likely to come early."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.when(F.max("quality") > 0, 2.0).otherwise(0.5).alias("quality"))


def mix_documents(docs: DataFrame, labels: DataFrame, row: str | None = None, **how) -> DataFrame:
    """mix() of a documents table, weighted by labels.quality where a row has one; row names a column that tells rows apart."""
    own = [F.col(row).alias("row")] if row else []
    d = docs.select(F.col("doc_id").alias("id"), row_key("doc_id", "text").alias("lot"), "source", *own, word_count(F.col("text")).alias("size"))
    d = d.join(quality_of(labels).withColumnRenamed("doc_id", "id"), "id", "left")
    return mix(d, **how)
