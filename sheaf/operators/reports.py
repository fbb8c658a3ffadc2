"""Aggregated reports: features, losses, outcomes, usage, coverage and scores.

All aggregates combine partially before their shuffle; the first message and the first
locations come from ordered structs, not from whole groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators import numbering

#: Statuses by rising severity.
STATUSES = ("supported", "ignored", "partial", "unsupported", "error")
MOST_COUNT = 4294967295
LOCATIONS = 8


def feature_report(events: DataFrame, *, feature: str, rank: str, ord_: str, message: str, location: str) -> DataFrame:
    """Per feature: count, worst rank, first message, and up to eight locations as first seen."""
    firsts = events.groupBy(feature, location).agg(F.min(ord_).alias("_first"))
    by_first = Window.partitionBy(feature).orderBy("_first")
    places = firsts.filter(F.col(location).isNotNull()).withColumn("_place", F.row_number().over(by_first)).filter(F.col("_place") <= LOCATIONS)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", location))), lambda x: x[location].cast("string")), ",")
    places = places.groupBy(feature).agg(joined.alias("locations"))
    counts = events.groupBy(feature).agg(F.least(F.count(F.lit(1)), F.lit(MOST_COUNT)).alias("count"), F.max(rank).alias("worst"), F.min_by(message, F.when(F.col(message).isNotNull(), F.col(ord_))).alias("message"))
    return counts.join(places, feature, "left")


def status_counts(rows: DataFrame, status: str, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(status) == s).alias(s) for s in statuses])


def overall(rank: Column) -> Column:
    """The worst rank as an overall answer."""
    worst = F.max(rank)
    return F.when(worst >= 3, "unsupported").when(worst == 2, "partial").otherwise("supported")


def merged_losses(losses: DataFrame, keys: list[str], count: str, ord_: str, first: str) -> DataFrame:
    """Saturating sums by key, with the first value of one column."""
    return losses.groupBy(*keys).agg(F.least(F.sum(count), F.lit(MOST_COUNT)).alias("count"), F.min_by(first, ord_).alias(first))


def usage(files: DataFrame, is_dir: Column, size: str, *keys: str) -> DataFrame:
    return files.groupBy(*keys).agg(F.count_if(~is_dir).alias("files"), F.count_if(is_dir).alias("folders"), F.coalesce(F.sum(F.when(~is_dir, F.col(size))), F.lit(0)).alias("bytes"))


def coverage_ratio(supported: Column, partial: Column, unsupported: Column) -> Column:
    """Per cent supported or partial; 100 where nothing counts."""
    return F.coalesce(F.try_divide((supported + partial) * 100.0, supported + partial + unsupported), F.lit(100.0))


def mode_largest(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """The most frequent value; the larger one on a tie."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", value)).alias("_best")).select(*keys, F.col(f"_best.{value}").alias("mode"), F.col("_best.n").alias("n"))


def mode_first(rows: DataFrame, value: str, ord_: str, *keys: str) -> DataFrame:
    """The most frequent value; the one seen first on a tie."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(ord_).alias("_first"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("_first")).alias("_late"), value)).alias("_best")).select(*keys, F.col(f"_best.{value}").alias("mode"), F.col("_best.n").alias("n"))


def upper_median(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """The element at n/2 of the sorted values, never a mean of two."""
    ranked = numbering.numbered_within(rows.filter(F.col(value).isNotNull()).select(*keys, value), list(keys), [F.col(value)], "_at")
    counts = ranked.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) / 2).alias("_at"))
    return ranked.join(counts, [*keys, "_at"]).select(*keys, F.col(value).alias("median"))


def weighted_score(parts: dict[str, float]) -> Column:
    """100 times the weighted mean of the parts that are not null."""
    total = sum((F.when(F.col(c).isNotNull(), F.col(c) * w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    return F.try_divide(total * 100, weight)


def otsu(rows: DataFrame, value: str) -> DataFrame:
    """The threshold that best splits the values in two; the first maximum wins."""
    steps = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    total = steps.agg(F.sum("n").alias("all_n"), F.sum(F.col("n") * F.col(value)).alias("all_s"))
    sums = steps.select(value, F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col(value)).over(upto).alias("s0")).filter("n0 is not null")
    spread = sums.crossJoin(F.broadcast(total)).withColumn("m0", F.col("s0") / F.col("n0")).withColumn("m1", (F.col("all_s") - F.col("s0")) / (F.col("all_n") - F.col("n0")))
    spread = spread.withColumn("spread", F.col("n0") * (F.col("all_n") - F.col("n0")) * F.pow(F.col("m1") - F.col("m0"), 2.0))
    return spread.agg(F.max(F.struct("spread", (-F.col(value)).alias("_low"))).alias("b")).select((-F.col("b._low")).alias("threshold"))
