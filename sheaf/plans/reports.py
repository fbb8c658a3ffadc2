"""Report queries: features, losses, usage, coverage, grades and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import numbers
from sheaf.operators import reports
from sheaf.plans.registry import query
from sheaf.session import table

RANK_SQL = "CASE WHEN value >= 90 THEN 3 WHEN value >= 60 THEN 2 WHEN value >= 30 THEN 1 ELSE 0 END"


def _rank() -> Column:
    """A status rank from the band of an event's value."""
    v = F.col("value")
    return F.when(v >= 90, 3).when(v >= 60, 2).when(v >= 30, 1).otherwise(0)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("rank", _rank())


@query(
    "feature_report",
    f"""
WITH e AS (SELECT *, {RANK_SQL} AS rank FROM events),
p AS (SELECT event_type, user_id, min(event_id) AS f FROM e WHERE user_id IS NOT NULL GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY f) AS k FROM p)
SELECT c.*, l.locations FROM (
  SELECT event_type, least(count(*), 4294967295)::BIGINT AS count, max(rank)::INTEGER AS worst, arg_min(props, event_id) FILTER (WHERE value >= 50) AS message
  FROM e GROUP BY event_type) c
LEFT JOIN (SELECT event_type, string_agg(user_id::VARCHAR, ',' ORDER BY k) AS locations FROM q WHERE k <= 8 GROUP BY event_type) l USING (event_type)
""",
)
def feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a low value have no message; the first that has one gives it."""
    events = _events(spark, sf_dir).withColumn("message", F.when(F.col("value") >= 50, F.col("props")))
    return reports.feature_report(events, feature="event_type", rank="rank", ord_="event_id", message="message", location="user_id")


@query(
    "status_summary",
    f"""SELECT count_if(r = 0)::BIGINT AS supported, count_if(r = 1)::BIGINT AS ignored, count_if(r = 2)::BIGINT AS partial,
count_if(r = 3)::BIGINT AS unsupported, 0::BIGINT AS error FROM (SELECT {RANK_SQL} AS r FROM events)""",
)
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _events(spark, sf_dir).withColumn("status", F.element_at(F.array(*map(F.lit, reports.STATUSES)), F.col("rank") + 1))
    return reports.status_counts(named, "status")


@query(
    "overall_status",
    f"""SELECT event_type, CASE WHEN max(r) >= 3 THEN 'unsupported' WHEN max(r) = 2 THEN 'partial' ELSE 'supported' END AS overall
FROM (SELECT event_type, {RANK_SQL} AS r FROM events) GROUP BY event_type""",
)
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(reports.overall(F.col("rank")).alias("overall"))


@query(
    "loss_merge",
    """SELECT l_returnflag, l_linestatus, least(sum(l_quantity::BIGINT), 4294967295)::BIGINT AS count, arg_min(l_partkey, l_orderkey * 10 + l_linenumber) AS l_partkey
FROM lineitem GROUP BY ALL""",
)
def loss_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_quantity").cast("long")).withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return reports.merged_losses(rows, ["l_returnflag", "l_linestatus"], "n", "ord", "l_partkey")


@query("severity_histogram", f"SELECT r AS severity, count(*)::BIGINT AS n FROM (SELECT {RANK_SQL} AS r FROM events) GROUP BY r")
def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(F.col("rank").alias("severity")).agg(F.count(F.lit(1)).alias("n")).orderBy("severity")


@query(
    "balance_check",
    """SELECT o_orderstatus, count(*)::BIGINT AS orders, sum(n)::BIGINT AS lines, (sum(n) - sum(n2))::BIGINT AS difference
FROM orders JOIN (SELECT l_orderkey, count(*) AS n, count(l_quantity) AS n2 FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""",
)
def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was counted against what was reported; the difference must be 0."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count("l_quantity").alias("n2"))
    both = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.sum("n").alias("lines"), (F.sum("n") - F.sum("n2")).alias("difference"))


@query("folder_usage", "SELECT source, count(*)::BIGINT AS files, 0::BIGINT AS folders, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source")
def folder_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.usage(table(spark, sf_dir, "documents").select("source", "n_chars"), F.lit(False), "n_chars", "source")


@query(
    "coverage_ratio",
    """SELECT d.source, round(coalesce(sum(q) * 100.0 / nullif(count(q), 0), 100.0), 6)::DOUBLE AS ratio, count(q)::BIGINT AS counted
FROM documents d LEFT JOIN (SELECT doc_id, quality AS q FROM labels) USING (doc_id) GROUP BY d.source""",
)
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source")
    counted = rows.agg(F.count_if(F.col("quality") == 1).alias("s"), F.count_if(F.col("quality") == 0).alias("u"))
    ratio = F.round(reports.coverage_ratio(F.col("s"), F.lit(0), F.col("u")), 6)
    return counted.select("source", ratio.alias("ratio"), (F.col("s") + F.col("u")).alias("counted"))


_SCORE = "(doc_id * 37 % 101)"
_GRADE = f"CASE WHEN {_SCORE} >= 90 THEN 'A' WHEN {_SCORE} >= 75 THEN 'B' WHEN {_SCORE} >= 50 THEN 'C' ELSE 'D' END"


@query(
    "group_grades_rollup",
    f"""SELECT coalesce(lang, '(all)') AS lang, count(*)::BIGINT AS documents, round(avg({_SCORE}), 3)::DOUBLE AS mean,
count_if(g = 'A')::BIGINT AS a, count_if(g = 'B')::BIGINT AS b, count_if(g = 'C')::BIGINT AS c, count_if(g = 'D')::BIGINT AS d
FROM (SELECT lang, doc_id, {_GRADE} AS g FROM documents) GROUP BY ROLLUP (lang)""",
)
def group_grades_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("doc_id") * 37 % 101
    rows = table(spark, sf_dir, "documents").select("lang", score.alias("score"), numbers.grade(score).alias("g"))
    counted = rows.rollup("lang").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("score"), 3).alias("mean"), *[F.count_if(F.col("g") == x).alias(x.lower()) for x in "ABCD"])
    return counted.withColumn("lang", F.coalesce("lang", F.lit("(all)")))


@query("grade_pivot", f"PIVOT (SELECT lang, {_GRADE} AS g FROM documents) ON g IN ('A', 'B', 'C', 'D') USING count(*) GROUP BY lang")
def grade_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", numbers.grade(F.col("doc_id") * 37 % 101).alias("g"))
    return rows.groupBy("lang").pivot("g", ["A", "B", "C", "D"]).count().fillna(0)


@query(
    "modal_value",
    """SELECT l_returnflag, arg_max(q, (n, q)) AS mode, max(n)::BIGINT AS n FROM (
SELECT l_returnflag, l_quantity::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""",
)
def modal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("q"))
    return reports.mode_largest(rows, "q", "l_returnflag")


@query(
    "modal_first_seen",
    """SELECT l_linestatus, arg_max(q, (n, -f)) AS mode, max(n)::BIGINT AS n FROM (
SELECT l_linestatus, l_quantity::BIGINT AS q, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY ALL) GROUP BY l_linestatus""",
)
def modal_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_quantity").cast("long").alias("q"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return reports.mode_first(rows, "q", "ord", "l_linestatus")


@query(
    "upper_median",
    """SELECT c_mktsegment, c_acctbal AS median FROM (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 AS k,
count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE k = n // 2""",
)
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.upper_median(table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment")


@query(
    "otsu_threshold",
    """WITH v AS (SELECT p_size::DOUBLE AS v, count(*)::DOUBLE AS n FROM part GROUP BY 1),
t AS (SELECT sum(n) AS an, sum(n * v) AS al FROM v),
s AS (SELECT v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0 FROM v WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT arg_max(v, (n0 * (an - n0) * pow((al - s0) / (an - n0) - s0 / n0, 2), -v))::DOUBLE AS threshold FROM s, t WHERE n0 IS NOT NULL""",
)
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.otsu(table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("v")), "v")


@query(
    "weighted_score",
    """SELECT doc_id, round((coalesce(quality * 3.0, 0) + coalesce(toxic * 1.0, 0) + coalesce(least(n_chars, 1000) / 1000.0 * 2.0, 0)) * 100
/ nullif((CASE WHEN quality IS NULL THEN 0 ELSE 3.0 END) + (CASE WHEN toxic IS NULL THEN 0 ELSE 1.0 END) + (CASE WHEN n_chars IS NULL THEN 0 ELSE 2.0 END), 0), 6)::DOUBLE AS score
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.least("n_chars", F.lit(1000)) / 1000.0).alias("size")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.round(reports.weighted_score({"quality": 3.0, "toxic": 1.0, "size": 2.0}), 6).alias("score"))


@query("null_skipping_mean", "SELECT d.source, round(avg(quality), 3)::DOUBLE AS mean FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY d.source")
def null_skipping_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.round(F.avg("quality"), 3).alias("mean"))


@query(
    "worst_pages_topk",
    "SELECT l_suppkey, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS total FROM lineitem GROUP BY 1 ORDER BY total DESC, l_suppkey LIMIT 10",
)
def worst_pages_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.floor("l_extendedprice").cast("long")).alias("total"))
    return sums.orderBy(F.desc("total"), "l_suppkey").limit(10)


@query("element_frequency", "SELECT event_type AS name, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY n DESC, name")
def element_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name")
