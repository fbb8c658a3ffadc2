"""Parent chains, closures, references and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import graph
from sheaf.plans.registry import query
from sheaf.session import table

#: suppliers as styles: each is based on its third; 1 and 2 form a cycle, every tenth has no parent row.
_PARENT = "CASE WHEN s_suppkey = 1 THEN 2 WHEN s_suppkey = 2 THEN 1 WHEN s_suppkey % 10 = 0 THEN -1 ELSE s_suppkey // 3 END"


def _styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    parent = F.when(k == 1, 2).when(k == 2, 1).when(k % 10 == 0, -1).otherwise(F.floor(k / 3))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), parent.cast("long").alias("parent"))


_CHAIN_SQL = f"""
WITH RECURSIVE s AS (SELECT s_suppkey AS id, ({_PARENT})::BIGINT AS parent FROM supplier),
c AS (SELECT id AS node, [id] AS chain, parent AS next, false AS cycle, false AS done FROM s
UNION ALL
SELECT c.node, CASE WHEN list_contains(c.chain, c.next) THEN c.chain ELSE list_append(c.chain, c.next) END, s.parent, list_contains(c.chain, c.next), list_contains(c.chain, c.next)
FROM c JOIN s ON s.id = c.next WHERE NOT c.done),
l AS (SELECT node, chain, cycle, row_number() OVER (PARTITION BY node ORDER BY cycle DESC, len(chain) DESC) AS k FROM c)
"""


@query("style_chain", _CHAIN_SQL + "SELECT node, array_to_string(chain, '>') AS chain FROM l WHERE k = 1")
def style_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chains(_styles(spark, sf_dir)).select("node", F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain"))


@query("chain_cycles", _CHAIN_SQL + "SELECT node FROM l WHERE k = 1 AND cycle")
def chain_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chains(_styles(spark, sf_dir)).filter("cycle").select("node")


@query(
    "reachable_bfs",
    """WITH RECURSIVE e AS (SELECT p_partkey AS s, p_partkey * 2 AS t FROM part UNION ALL SELECT p_partkey, p_partkey * 3 + 1 FROM part),
r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.t, r.depth + 1 FROM r JOIN e ON e.s = r.node WHERE r.depth < 20)
SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY node""",
)
def reachable_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"))
    edges = part.select("source", F.explode(F.array(F.col("source") * 2, F.col("source") * 3 + 1)).alias("target"))
    return graph.reachable(edges, spark.createDataFrame([(1,)], "node long"))


@query("dangling_refs", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return graph.dangling(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey")


@query(
    "link_lookup",
    """SELECT s_suppkey, n_name, coalesce(r_name, 'missing') AS r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 0""",
)
def link_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two foreign keys in a row; the second may lead nowhere."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region").filter("r_regionkey <> 0")
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("s_suppkey", "n_name", F.coalesce("r_name", F.lit("missing")).alias("r_name"))


@query(
    "content_type_override",
    "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'override/' || page_id WHEN regexp_extract(url, '\\.([a-z]+)($|[?#/])', 1) = 'com' THEN 'default/com' WHEN regexp_extract(url, '\\.([a-z]+)($|[?#/])', 1) = 'org' THEN 'default/org' END AS content_type FROM pages",
)
def content_type_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An override by part name first, else the default of the extension, else none."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"\.([a-z]+)($|[?#/])", 1).alias("ext"))
    override = pages.filter("page_id % 5 = 0").select("page_id", F.concat(F.lit("override/"), F.col("page_id").cast("string")).alias("own"))
    default = spark.createDataFrame([("com", "default/com"), ("org", "default/org")], "ext string, usual string")
    return pages.join(override, "page_id", "left").join(F.broadcast(default), "ext", "left").select("page_id", F.coalesce("own", "usual").alias("content_type"))


@query(
    "components",
    """WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey + 3 AS b FROM customer WHERE c_custkey % 10 < 6),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node WHERE r.root < u.b)
SELECT node, min(root) AS root FROM r GROUP BY node""",
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_custkey % 10 < 6")
    return graph.components(c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 3).alias("b")))
