"""Ordered rows: islands, runs, numbering, bands, sections and carried values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.operators import sequences
from sheaf.plans.registry import query
from sheaf.session import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@query(
    "islands_lines",
    """SELECT event_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM (
SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
)
def islands_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new stretch of a user's events wherever more than a day passed."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", at.alias("us"))
    before = F.lag("us").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    found = sequences.islands(rows.withColumn("gap", F.col("us") - before), F.col("gap") > 86_400_000_000, ["user_id"], ["ts", "event_id"])
    return found.select("event_id", "island")


@query(
    "list_runs",
    """SELECT user_id, event_type, min(event_id) AS first, count(*)::BIGINT AS n FROM (
SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM (
SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, event_type, i HAVING count(*) >= 3""",
)
def list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least three events of one type in a row."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    runs = sequences.islands(rows.withColumn("before", before), F.col("before") != F.col("event_type"), ["user_id"], ["event_id"])
    grouped = runs.groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return grouped.filter("n >= 3").drop("island")


@query(
    "number_segments",
    """SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*)::BIGINT AS n FROM (
SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) GROUP BY l_orderkey, g""",
)
def number_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    cut = sequences.counting_segments(rows, "l_linenumber", ["l_orderkey"], ["l_linenumber"])
    return cut.groupBy("l_orderkey", "segment").agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"), F.count(F.lit(1)).alias("n")).drop("segment")


@query(
    "number_jumps",
    "SELECT l_orderkey, l_linenumber FROM (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE b + 1 <> l_linenumber",
)
def number_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    before = F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return rows.withColumn("b", before).filter("b + 1 <> l_linenumber").drop("b")


_HEADS_SQL = """WITH l AS (SELECT doc_id, source, trim(regexp_replace(string_split(text, chr(10))[-1], '[0-9]+', '#', 'g')) AS k FROM documents),
n AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1)
SELECT source, k AS masked, count(DISTINCT doc_id)::BIGINT AS pages FROM l JOIN n USING (source) GROUP BY source, k, n.pages
HAVING count(DISTINCT doc_id) >= greatest(2, ceil(n.pages / 20.0)) AND (n.pages < 4 OR count(DISTINCT doc_id % 2) = 2)"""


@query("running_heads", _HEADS_SQL)
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last lines, digits masked, that recur over a source's documents of both parities."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    last = F.element_at(F.split("text", "\n"), -1)
    lines = docs.select("doc_id", "source", F.trim(F.regexp_replace(last, "[0-9]+", "#")).alias("masked"))
    pages = docs.groupBy("source").agg(F.count(F.lit(1)).alias("all"))
    found = lines.groupBy("source", "masked").agg(F.count_distinct("doc_id").alias("pages"), F.count_distinct(F.col("doc_id") % 2).alias("parities")).join(pages, "source")
    return found.filter("pages >= greatest(2, ceil(all / 20.0)) and (all < 4 or parities = 2)").select("source", "masked", "pages")


@query("digit_behaviour", "SELECT user_id, CASE WHEN count(DISTINCT k) = 1 THEN 'fixed' WHEN count(DISTINCT k - n) = 1 THEN 'counting' ELSE 'varies' END AS kind FROM (SELECT user_id, json_extract_string(props, '$.k')::BIGINT % 3 AS k, event_id % 3 AS n FROM events) GROUP BY user_id")
def digit_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", (F.from_json("props", "k bigint")["k"] % 3).alias("k"), (F.col("event_id") % 3).alias("n"))
    kind = F.when(F.count_distinct("k") == 1, "fixed").when(F.count_distinct(F.col("k") - F.col("n")) == 1, "counting").otherwise("varies")
    return rows.groupBy("user_id").agg(kind.alias("kind"))


@query(
    "empty_collapse",
    """SELECT conv_id, turn FROM (SELECT conv_id, turn, turn % 4 <> 0 AS e, lag(turn % 4 <> 0) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE NOT (e AND coalesce(b, false))""",
)
def empty_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).withColumn("text", F.when(F.col("turn") % 4 == 0, F.col("text")).otherwise(" "))
    return sequences.without_repeated_empty(rows, "text", ["conv_id"], ["turn"]).select("conv_id", "turn")


@query(
    "join_eligible",
    r"""SELECT conv_id, turn FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE regexp_matches(rtrim(text), '[\p{L},]$') AND regexp_matches(n, '^\p{Ll}')""",
)
def join_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = _turns(spark, sf_dir).withColumn("n", after)
    return rows.filter(F.regexp_like(F.rtrim("text"), F.lit(r"[\p{L},]$")) & F.regexp_like("n", F.lit(r"^\p{Ll}"))).select("conv_id", "turn")


@query(
    "note_numbers_section",
    """SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY f, l_suppkey)::INTEGER AS number FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber * 100000 + l_partkey) AS f FROM lineitem GROUP BY ALL)""",
)
def note_numbers_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("at"))
    return sequences.numbered_first(rows, "l_suppkey", ["l_orderkey"], ["at"])


@query(
    "table_banding",
    """SELECT o_orderkey, (CASE WHEN k = 0 THEN 1 WHEN k = n - 1 THEN 2 WHEN (k - 1) // 2 % 2 = 0 THEN 4 ELSE 8 END)::BIGINT AS bands FROM (
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""",
)
def table_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sequences.banding(rows, ["o_custkey"], ["o_orderkey"], band=2).select("o_orderkey", "bands")


@query("section_ranges", "SELECT conv_id, section, min(turn) AS first, max(turn) AS last FROM (SELECT conv_id, turn, coalesce(sum((role = 'assistant')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS section FROM conversations) GROUP BY ALL")
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sequences.section_numbers(_turns(spark, sf_dir), F.col("role") == "assistant", ["conv_id"], ["turn"])
    return cut.groupBy("conv_id", "section").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))


@query("chapter_carry", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS chapter FROM events")
def chapter_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("heading"))
    return sequences.carried(rows, "heading", ["user_id"], ["event_id"], "chapter").select("event_id", "chapter")


@query(
    "line_pitch",
    """WITH l AS (SELECT l_orderkey AS page, l_linenumber AS ord, floor(l_extendedprice / 500) / 2 AS baseline, CASE WHEN l_tax < 0.06 THEN 10.0 WHEN l_tax < 0.07 THEN 10.4 ELSE 14.0 END AS size FROM lineitem),
m AS (SELECT page, size, count(*) AS n, min(ord) AS f FROM l GROUP BY ALL), body AS (SELECT page, arg_max(size, (n, -f, size)) AS body FROM m GROUP BY page),
d AS (SELECT DISTINCT page, body, baseline FROM l JOIN body USING (page) WHERE abs(size - body) <= body * 0.05),
g AS (SELECT page, body, baseline - lag(baseline) OVER (PARTITION BY page ORDER BY baseline) AS gap FROM d),
b AS (SELECT page, round(gap * 4)::BIGINT AS bucket, count(*) AS n, min(gap) AS least FROM g WHERE gap >= body * 0.8 GROUP BY ALL),
p AS (SELECT page, arg_min(x.least, x.bucket) AS pitch FROM b x LEFT JOIN b y USING (page) WHERE (y.bucket = x.bucket + 1 AND x.n + y.n >= 2) OR x.n >= 2 GROUP BY page)
SELECT page, coalesce(pitch, body * 1.2)::DOUBLE AS pitch FROM body LEFT JOIN p USING (page)""",
)
def line_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pitch of each page's body lines (orders stand for pages)."""
    tax = F.col("l_tax")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), (F.floor(F.col("l_extendedprice") / 500) / 2).alias("baseline"),
        F.when(tax < 0.06, 10.0).when(tax < 0.07, 10.4).otherwise(14.0).alias("size"),
    )
    return sequences.body_pitch(lines)


@query(
    "interval_merge",
    """WITH i AS (SELECT l_suppkey, l_orderkey AS a, l_orderkey + l_quantity::BIGINT AS z FROM lineitem),
m AS (SELECT *, max(z) OVER (PARTITION BY l_suppkey ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i),
s AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT l_suppkey, min(a) AS start, max(z) AS "end", count(*)::BIGINT AS n FROM s GROUP BY l_suppkey, g""",
)
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("z"))
    return sequences.merged_intervals(rows, "a", "z", ["l_suppkey"])


@query(
    "gutter_sweep",
    """WITH i AS (SELECT l_suppkey, l_orderkey % 500 AS a, l_orderkey % 500 + l_quantity::BIGINT AS z FROM lineitem),
e AS (SELECT l_suppkey, p, sum(d) AS d FROM (SELECT l_suppkey, a AS p, 1 AS d FROM i UNION ALL SELECT l_suppkey, z AS p, -1 AS d FROM i) GROUP BY ALL)
SELECT l_suppkey, p AS "at", depth FROM (SELECT l_suppkey, p, sum(d) OVER (PARTITION BY l_suppkey ORDER BY p)::BIGINT AS depth FROM e) WHERE depth <= 5""",
)
def gutter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places from which few intervals are open."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 500).alias("a"), (F.col("l_orderkey") % 500 + F.col("l_quantity").cast("long")).alias("z"))
    return sequences.coverage(rows, "a", "z", ["l_suppkey"]).filter("depth <= 5").select("l_suppkey", "at", "depth")


@query("tolerance_cluster")
def tolerance_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.round(F.col("l_extendedprice"), 0).alias("v"))
    return sequences.mean_clusters(rows, "v", "l_suppkey", 250.0)


@query("list_counters")
def list_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(1).alias("list"), (F.col("turn") % 3).cast("int").alias("level"))
    return sequences.list_counters(rows, "conv_id", "list", "level", "turn")


@query("grade_totals", "SELECT lang, max(n_chars) AS longest, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id FROM documents GROUP BY lang")
def grade_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("late"))).alias("b")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(best).select("lang", F.col("b.n_chars").alias("longest"), (-F.col("b.late")).alias("doc_id"))
