"""Boxes and segments made from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import geometry
from sheaf.plans.registry import query
from sheaf.session import table

_BOXES = """b AS (SELECT l_suppkey AS page, l_orderkey * 8 + l_linenumber AS box, l_partkey % 200 AS x0, l_partkey % 200 + 5 + l_linenumber AS x1,
l_orderkey % 300 AS y0, l_orderkey % 300 + l_quantity::BIGINT % 20 + 1 AS y1 FROM lineitem)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") % 200, F.col("l_orderkey") % 300
    return rows.select(
        F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("box"), x.alias("x0"), (x + 5 + F.col("l_linenumber")).alias("x1"),
        y.alias("y0"), (y + F.col("l_quantity").cast("long") % 20 + 1).alias("y1"),
    ).distinct()


@query(
    "overlap_join",
    f"""WITH {_BOXES}, d AS (SELECT DISTINCT * FROM b) SELECT a.page, a.box AS a, c.box AS b, ((least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)))::DOUBLE AS area
FROM d a JOIN d c ON a.page = c.page AND a.box < c.box AND a.x0 < c.x1 AND c.x0 < a.x1 AND a.y0 < c.y1 AND c.y0 < a.y1""",
)
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.overlapping(_boxes(spark, sf_dir), page="page", box="box", cell=25.0).drop("smaller")


@query(
    "legibility_sweep",
    f"""WITH {_BOXES}, d AS (SELECT DISTINCT * FROM b), o AS (SELECT a.page, a.box AS a, c.box AS b, (least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS area,
least((a.x1 - a.x0) * (a.y1 - a.y0), (c.x1 - c.x0) * (c.y1 - c.y0)) AS smaller FROM d a JOIN d c ON a.page = c.page AND a.box < c.box AND a.x0 < c.x1 AND c.x0 < a.x1 AND a.y0 < c.y1 AND c.y0 < a.y1)
SELECT page, count(DISTINCT box)::BIGINT AS illegible FROM (SELECT page, a AS box FROM o WHERE area >= 0.3 * smaller UNION SELECT page, b FROM o WHERE area >= 0.3 * smaller) GROUP BY page""",
)
def legibility_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that share at least 0.3 of the smaller of two areas, per page."""
    pairs = geometry.overlapping(_boxes(spark, sf_dir), page="page", box="box", cell=25.0)
    bad = pairs.filter(F.col("area") >= 0.3 * F.col("smaller"))
    both = bad.select("page", F.explode(F.array("a", "b")).alias("box"))
    return both.groupBy("page").agg(F.count_distinct("box").alias("illegible"))


@query(
    "crossing_join",
    """WITH h AS (SELECT l_suppkey AS page, l_orderkey AS h, l_orderkey % 100 AS y, l_partkey % 100 AS x0, l_partkey % 100 + 10 AS x1 FROM lineitem WHERE l_linenumber % 2 = 1),
v AS (SELECT l_suppkey AS page, l_orderkey AS v, l_partkey % 100 AS x, l_orderkey % 100 AS y0, l_orderkey % 100 + 15 AS y1 FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT h.page, h, v FROM h JOIN v ON h.page = v.page AND x BETWEEN x0 - 1 AND x1 + 1 AND y BETWEEN y0 - 1 AND y1 + 1""",
)
def crossing_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd lines are horizontal, even ones vertical: every row takes part."""
    rows = table(spark, sf_dir, "lineitem")
    page, x, y = F.col("l_suppkey").alias("page"), F.col("l_partkey") % 100, F.col("l_orderkey") % 100
    h = rows.filter("l_linenumber % 2 = 1").select(page, F.col("l_orderkey").alias("h"), y.alias("y"), x.alias("x0"), (x + 10).alias("x1"))
    v = rows.filter("l_linenumber % 2 = 0").select(page, F.col("l_orderkey").alias("v"), x.alias("x"), y.alias("y0"), (y + 15).alias("y1"))
    return geometry.crossing(h, v, page="page", cell=20.0, tolerance=1.0)


@query(
    "covered_area",
    f"""WITH {_BOXES}, d AS (SELECT page, box, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM b WHERE box % 2 = 1 GROUP BY ALL), z AS (SELECT page, x0, x1, y0, y1 FROM b WHERE box % 2 = 0)
SELECT d.page, d.box, round(least(1, coalesce(sum(greatest(0, least(d.x1, z.x1) - greatest(d.x0, z.x0)) * greatest(0, least(d.y1, z.y1) - greatest(d.y0, z.y0))), 0) / any_value((d.x1 - d.x0) * (d.y1 - d.y0))), 9)::DOUBLE AS share
FROM d LEFT JOIN (SELECT DISTINCT * FROM z) z ON d.page = z.page GROUP BY d.page, d.box""",
)
def covered_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each odd line's box the even lines' boxes cover."""
    every = _boxes(spark, sf_dir)
    boxes = every.filter("box % 2 = 1").groupBy("page", "box").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    zones = every.filter("box % 2 = 0").select("page", "x0", "x1", "y0", "y1").distinct()
    return geometry.covered_share(boxes, zones, page="page", box="box", cell=25.0).withColumn("share", F.round("share", 9))


@query(
    "column_order",
    """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY band, s DESC, c, o_orderkey)::INTEGER AS place FROM (
SELECT *, sum(s) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS band FROM (SELECT o_custkey, o_orderkey, (o_orderstatus = 'P')::INTEGER AS s, o_orderkey % 2 AS c FROM orders))""",
)
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending orders span; even keys are the left column."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 2).alias("c"), (F.col("o_orderstatus") == "P").alias("s"))
    return geometry.reading_order(rows, page="o_custkey", line="o_orderkey", top="o_orderkey", column="c", spanning=F.col("s"))
