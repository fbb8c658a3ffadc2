"""Filters, searches, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import numbers, text
from sheaf.operators import numbering, search
from sheaf.plans.registry import query
from sheaf.session import table


@query("mask_filter", "SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'bolt') OR regexp_matches(lower(p_name), '^r.*t$')) AND NOT regexp_matches(lower(p_name), '^.lue.*$')")
def mask_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").filter(search.mask(F.col("p_name"), "bolt; R*t | ?lue*"))


@query("url_mask", r"SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '^.*\.html$') OR regexp_matches(lower(url), '^http.*/[^/]*1.*$')")
def url_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("url")
    hit = search.mask(name, "*.html") | F.regexp_like(F.lower(name), F.lit("^http.*/[^/]*1.*$"))
    return table(spark, sf_dir, "pages").select("page_id", "url").filter(hit)


@query("words_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'a') AND contains(lower(p_type), 'e')")
def words_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(search.has_words(F.col("p_type"), "A e")).select("p_partkey")


@query("content_search", "SELECT doc_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'license')")
def content_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(search.has_content(F.col("text"), "License")).select("doc_id")


@query("file_search", "SELECT doc_id, source, n_chars FROM documents WHERE contains(lower(source), '1') AND n_chars BETWEEN 200 AND 5000 AND contains(lower(text), 'the')")
def file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.file_search(table(spark, sf_dir, "documents"), name="source", size="n_chars", text="text", masks="1", min_size=200, max_size=5000, needle="the")
    return found.select("doc_id", "source", "n_chars")


@query("age_filter", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def age_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    cutoff = events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("cutoff"))
    return events.join(F.broadcast(cutoff), F.col("ts") >= F.col("cutoff")).select("event_id")


@query("find_all", "SELECT doc_id, unnest(range(1, n + 1))::INTEGER AS hit FROM (SELECT doc_id, len(regexp_extract_all(text, 'the')) AS n FROM documents) WHERE n > 0")
def find_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.occurrences(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "the").select("doc_id", "hit")


@query("tier_selection", "SELECT doc_id FROM documents WHERE list_contains([lang, source], 'de')")
def tier_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = F.array("lang", "source")
    return table(spark, sf_dir, "documents").select("doc_id", tiers.alias("tiers")).filter(F.array_contains("tiers", "de")).select("doc_id")


@query(
    "script_need",
    "SELECT lang, count(*)::BIGINT AS n, count_if(regexp_matches(text, '[\\x{900}-\\x{10FFFF}]'))::BIGINT AS beyond, count_if(regexp_matches(text, '[\\x{80}-\\x{8FF}]'))::BIGINT AS extended FROM documents GROUP BY lang",
)
def script_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda p: F.count_if(F.regexp_like("text", F.lit(p)))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), has(r"[\x{900}-\x{10FFFF}]").alias("beyond"), has(r"[\x{80}-\x{8FF}]").alias("extended"))


@query("paragraph_range", "SELECT conv_id, turn, text FROM conversations WHERE turn >= 1 AND turn < 4")
def paragraph_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter(F.col("turn").between(1, 3)).select("conv_id", "turn", "text")


@query(
    "document_projection",
    "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body, count(*)::BIGINT AS turns FROM conversations GROUP BY conv_id",
)
def document_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("lines"), F.count(F.lit(1)).alias("turns"))
    return grouped.select("conv_id", F.array_join(F.col("lines.line"), "\n").alias("body"), "turns")


@query(
    "entry_sort_topk",
    "SELECT p_partkey, p_name, p_size FROM part ORDER BY (p_size > 25) DESC, p_type, p_partkey LIMIT 100",
)
def entry_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders (large sizes) first, then by type and key, the first hundred."""
    ordered = table(spark, sf_dir, "part").orderBy((F.col("p_size") > 25).desc(), "p_type", "p_partkey")
    return ordered.select("p_partkey", "p_name", "p_size").limit(100)


@query(
    "natural_sort",
    "SELECT c_name, row_number() OVER (ORDER BY regexp_replace(c_name, '[0-9]+', ''), CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT), c_name)::INTEGER AS place FROM customer",
)
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name's place as people sort them."""
    keyed = table(spark, sf_dir, "customer").select("c_name", text.natural_key(F.col("c_name")).alias("k"))
    return numbering.numbered(keyed, [F.col("k"), F.col("c_name")], "at").select("c_name", (F.col("at") + 1).cast("int").alias("place"))


@query("issue_order", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY user_id NULLS FIRST, ts, event_id)::INTEGER AS place FROM events")
def issue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts")
    placed = numbering.numbered_within(rows, ["event_type"], [F.asc_nulls_first("user_id"), F.col("ts"), F.col("event_id")], "at")
    return placed.select("event_id", (F.col("at") + 1).cast("int").alias("place"))


@query("key_union", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, sf_dir, "customer").select("c_custkey")).distinct()


@query("multiset_difference", "SELECT l_partkey AS k FROM lineitem WHERE l_linenumber <= 2 EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_linenumber = 1")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_linenumber")
    return rows.filter("l_linenumber <= 2").select("k").exceptAll(rows.filter("l_linenumber = 1").select("k"))


@query("multiset_intersection", "SELECT l_suppkey AS k FROM lineitem WHERE l_linenumber = 1 INTERSECT ALL SELECT l_suppkey FROM lineitem WHERE l_linenumber = 2")
def multiset_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_linenumber")
    return rows.filter("l_linenumber = 1").select("k").intersectAll(rows.filter("l_linenumber = 2").select("k"))


@query("digest_dedup", "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY 1")
def digest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2("text", 256).alias("digest")
    return table(spark, sf_dir, "documents").select("doc_id", digest).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("claimed_names", "SELECT c_custkey, c_mktsegment, CASE WHEN k = 1 THEN c_mktsegment ELSE c_mktsegment || ' (' || k || ')' END AS target FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer)")
def claimed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first claimant keeps a name; later ones get a number."""
    rows = numbering.numbered_within(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], [F.col("c_custkey")], "at")
    rows = rows.withColumn("k", F.col("at") + 1)
    target = F.when(F.col("k") == 1, F.col("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(" ("), F.col("k").cast("string"), F.lit(")")))
    return rows.select("c_custkey", "c_mktsegment", target.alias("target"))


@query("top_regressions", "SELECT o_orderkey, round(o_totalprice - 150000, 1)::DOUBLE AS delta FROM orders WHERE round(o_totalprice - 150000, 1) < -20000 ORDER BY delta, o_orderkey LIMIT 50")
def top_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") - 150000, 1).alias("delta"))
    return rows.filter("delta < -20000").orderBy("delta", "o_orderkey").limit(50)


@query("size_human", "SELECT doc_id, CASE WHEN b >= 1099511627776 THEN printf('%.1f TB', b / 1099511627776.0) WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0) ELSE b || ' B' END AS size FROM (SELECT doc_id, n_chars * 997 AS b FROM documents)")
def size_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", numbers.human_size(F.col("n_chars") * 997).alias("size"))


@query("size_grouped", "SELECT o_orderkey, replace(format('{:,}', (o_totalprice * 1000)::BIGINT), ',', chr(8201)) AS size FROM orders")
def size_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.grouped(F.round(F.col("o_totalprice") * 1000).cast("long")).alias("size"))
