"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.plans.registry import query
from sheaf.session import table
from sheaf.sources import html


@query("html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.text(table(spark, sf_dir, "pages"))


@query("html_links", r"SELECT page_id AS page, count(*)::BIGINT AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=')) FROM pages) GROUP BY page_id")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(table(spark, sf_dir, "pages")).groupBy("page").agg(F.count(F.lit(1)).alias("links"))


@query("html_outline")
def html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.outline(table(spark, sf_dir, "pages"))


@query(
    "html_table_grid",
    """SELECT page_id AS page, 0 AS "table", r AS "row", c AS "column", s AS colspan, CASE WHEN t = 'key' THEN page_id::VARCHAR ELSE t END AS text
FROM pages, (VALUES (0, 0, 1, 'one & two'), (0, 1, 2, 'key'), (1, 0, 1, ''), (1, 1, 1, 'b'), (1, 2, 1, 'c')) x(r, c, s, t)""",
)
def html_table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a table put before every page, as the supplied pages have none."""
    before = F.concat(F.lit("<table><tr><th>one &amp; <b>two</b><td colspan='2'>"), F.col("page_id").cast("string"), F.lit("</tr><tr><td></td><td>b</td><td>c</table>"))
    return html.grids(table(spark, sf_dir, "pages").select("page_id", F.concat(before, F.col("html")).alias("html")))


@query("html_elements")
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each element occurs, most frequent first."""
    return html.nodes(table(spark, sf_dir, "pages")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name")
