"""Comparing sides: differences, baselines, bags and unique pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions import text
from sheaf.operators import matching
from sheaf.plans.registry import query
from sheaf.session import table


@query(
    "diff_ids",
    """SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM
(SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 5 <> 0) a FULL JOIN
(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 7 <> 0) b ON a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v""",
)
def diff_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    edited = orders.filter("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return matching.changed_ids(orders.filter("o_orderkey % 5 <> 0"), edited, "o_orderkey", "o_orderstatus")


@query(
    "baseline_delta",
    """SELECT coalesce(a.k, b.k) AS c_custkey, a.v AS head, b.v AS base, round(a.v::DECIMAL(18, 2) - b.v::DECIMAL(18, 2), 1)::DOUBLE AS delta FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0) a
FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1) b ON a.k = b.k""",
)
def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select("c_custkey", F.col("c_acctbal").alias("v"))
    base = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    cents = lambda df: df.withColumn("v", F.col("v").cast("decimal(18,2)"))
    return matching.deltas(cents(head), cents(base), "c_custkey", "v").select("c_custkey", *[F.col(c).cast("double").alias(c) for c in ("head", "base", "delta")])


@query(
    "qa_left_joins",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'label-missing' WHEN b.item_id IS NULL THEN 'reference-missing' WHEN v.vec_id IS NULL THEN 'vector-missing' ELSE 'ok' END AS status
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id % 50 LEFT JOIN embeddings v ON v.vec_id = d.doc_id""",
)
def qa_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lit(1).alias("b"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("v"))
    rows = docs.join(labels, "doc_id", "left").join(items, F.col("doc_id") % 50 == F.col("item_id"), "left").join(vectors, "doc_id", "left")
    status = matching.first_status((F.col("l").isNull(), "label-missing"), (F.col("b").isNull(), "reference-missing"), (F.col("v").isNull(), "vector-missing"))
    return rows.select("doc_id", status.alias("status"))


_W = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+')"
_BAG_SQL = f"""WITH r AS (SELECT item_id AS k, w, count(*) AS r FROM (SELECT item_id, unnest({_W.format(t="text")}) AS w FROM benchmark) GROUP BY ALL),
g AS (SELECT doc_id AS k, w, count(*) AS g FROM (SELECT doc_id, unnest({_W.format(t="text")}) AS w FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)) GROUP BY ALL),
s AS (SELECT coalesce(r.k, g.k) AS item_id, sum(least(coalesce(r, 0), coalesce(g, 0))) AS shared, sum(coalesce(r, 0)) AS nr, sum(coalesce(g, 0)) AS ng FROM r FULL JOIN g ON r.k = g.k AND r.w = g.w GROUP BY 1),
x AS (SELECT item_id, CASE WHEN ng > 0 THEN shared / ng ELSE 0.0 END AS p, CASE WHEN nr > 0 THEN shared / nr ELSE 0.0 END AS c FROM s)
"""


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against the documents of the same number."""
    items = table(spark, sf_dir, "benchmark")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text").join(items.select("item_id"), "item_id", "left_semi")
    tokens = lambda df: df.select("item_id", F.explode(text.lower_words(F.col("text"))).alias("w"))
    return matching.bag_scores(tokens(items), tokens(docs), "item_id", "w")


@query("bag_f1", _BAG_SQL + "SELECT item_id, round(p, 9)::DOUBLE AS precision, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END, 9)::DOUBLE AS f1 FROM x")
def bag_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bags(spark, sf_dir).select("item_id", F.round("precision", 9).alias("precision"), F.round("f1", 9).alias("f1"))


@query("bag_recall", _BAG_SQL + "SELECT item_id, round(c, 9)::DOUBLE AS recall FROM x")
def bag_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bags(spark, sf_dir).select("item_id", F.round("recall", 9).alias("recall"))


@query(
    "unique_neighbour_match",
    """WITH p AS (SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(floor(c_acctbal) - floor(s_acctbal)) <= 50)
SELECT c_custkey, s_suppkey FROM p QUALIFY count(*) OVER (PARTITION BY c_custkey) = 1 AND count(*) OVER (PARTITION BY s_suppkey) = 1""",
)
def unique_neighbour_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near balances within a nation, where neither side has another partner."""
    a = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.floor("c_acctbal").alias("ca"))
    b = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), F.floor("s_acctbal").alias("sa"))
    # buckets of the tolerance's width: partners are in the same or a neighbouring one
    a = a.withColumn("bucket", F.floor(F.col("ca") / 50))
    b = b.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("sa") / 50) - 1, F.floor(F.col("sa") / 50) + 1)))
    return matching.unique_pairs(a.join(b, ["n", "bucket"]).filter("abs(ca - sa) <= 50").select("c_custkey", "s_suppkey"), "c_custkey", "s_suppkey")


_LEXICON = """w AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(replace(text, 'ß', 'ss')), '[\\p{L}\\p{N}_]+')) AS w FROM documents) GROUP BY ALL),
lex AS (SELECT form, max(n) AS frequency FROM (SELECT replace(replace(w, 'dj', 'đ'), 's', 'š') AS form, n FROM w WHERE lang = 'en' UNION ALL SELECT translate(w, 'cz', 'ćž'), n FROM w WHERE lang = 'de'
UNION ALL SELECT translate(w, 'c', 'č'), n FROM w WHERE lang = 'fr' UNION ALL SELECT w, n FROM w WHERE lang = 'es') GROUP BY form),
asked AS (SELECT DISTINCT CASE WHEN length(w) % 3 = 0 THEN upper(w) WHEN length(w) % 3 = 1 THEN upper(w[1]) || w[2:] ELSE w END AS word FROM w),
k AS (SELECT word, lower(word) AS l, translate(lower(word), 'čćšžđ', 'ccszd') AS key FROM asked UNION SELECT word, lower(word), translate(replace(lower(word), 'dj', 'đ'), 'čćšžđ', 'ccszd') FROM asked WHERE contains(lower(word), 'dj')),
f AS (SELECT DISTINCT word, form, frequency FROM k JOIN lex ON translate(form, 'čćšžđ', 'ccszd') = key WHERE form <> l AND length(word) >= 2 AND regexp_matches(l, '[cszdčć]') AND l NOT IN (SELECT form FROM lex)),
r AS (SELECT *, max(frequency) OVER (PARTITION BY word) AS m FROM f),
t AS (SELECT word, min(form) AS form FROM r WHERE frequency = m GROUP BY word HAVING count(*) = 1)"""


def _lexicon(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Forms with marks, made from the words of four languages, and all words in three patterns of case."""
    plain = F.replace("text", F.lit("ß"), F.lit("ss"))  # which has no single capital
    words = table(spark, sf_dir, "documents").select("lang", F.explode(text.lower_words(plain)).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    marked = (
        F.when(F.col("lang") == "en", F.replace(F.replace("w", F.lit("dj"), F.lit("đ")), F.lit("s"), F.lit("š")))
        .when(F.col("lang") == "de", F.translate("w", "cz", "ćž")).when(F.col("lang") == "fr", F.translate("w", "c", "č")).when(F.col("lang") == "es", F.col("w"))
    )
    lexicon = words.select(marked.alias("form"), "n").filter("form is not null").groupBy("form").agg(F.max("n").alias("frequency"))
    kind, first = F.length("w") % 3, F.concat(F.upper(F.substring("w", 1, 1)), F.substring("w", F.lit(2), F.length("w")))
    return lexicon, words.select(F.when(kind == 0, F.upper("w")).when(kind == 1, first).otherwise(F.col("w")).alias("word")).distinct()


@query(
    "lexicon_lookup",
    f"WITH {_LEXICON} SELECT word, CASE WHEN length(regexp_replace(word, '[^\\\\p{{L}}]', '', 'g')) > 1 AND regexp_matches(regexp_replace(word, '[^\\\\p{{L}}]', '', 'g'), '^\\\\p{{Lu}}+$') THEN upper(form) WHEN regexp_matches(word, '^\\\\p{{Lu}}') THEN upper(form[1]) || form[2:] ELSE form END AS found FROM t".replace("\\\\p", "\\p"),
)
def lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the lexicon lacks, with their marks restored; a tie in frequency gives none."""
    lexicon, words = _lexicon(spark, sf_dir)
    return matching.restored(words, lexicon)


@query(
    "restored_texts",
    "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'šđ, ' ELSE '' END || 'Đ-' || n_name AS body, CASE n_regionkey WHEN 0 THEN 2 ELSE 1 END::BIGINT AS fixed FROM nation",
)
def restored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose bare words get their marks back, case and all else kept."""
    lexicon = spark.createDataFrame([("šđ", 5), ("sd", 0), ("đ", 1), ("šd", 2)], "form string, frequency long").filter("frequency > 0")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.when(F.col("n_regionkey") == 0, "sd, ").otherwise(""), F.lit("Dj-"), "n_name").alias("body"))
    return matching.restored_text(rows, "n_nationkey", "body", lexicon)


@query("page_vote", "SELECT o_custkey, arg_max(o_orderpriority, (n, o_orderpriority)) AS o_orderpriority, max(n)::BIGINT AS votes FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey")
def page_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("o_custkey").agg(F.max(F.struct("n", "o_orderpriority")).alias("b"))
    return best.select("o_custkey", F.col("b.o_orderpriority").alias("o_orderpriority"), F.col("b.n").alias("votes"))


@query("membership", "SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id").join(english, "doc_id", "left_semi")


@query("note_sections", "SELECT e.event_id, o.o_orderkey FROM events e ASOF JOIN (SELECT o_orderkey, o_orderkey * 2 AS start FROM orders WHERE o_orderkey % 3 = 0) o ON e.event_id >= o.start")
def note_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note takes the last section that starts at or before it."""
    width = 4096  # places; a section start before the block is carried in from the blocks before
    notes = table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.col("event_id"), F.lit(None).cast("long").alias("section"))
    starts = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select((F.col("o_orderkey") * 2).alias("at"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderkey").alias("section"))
    block = F.floor(F.col("at") / width)
    last = starts.groupBy(block.alias("block")).agg(F.max_by("section", "at").alias("last"))
    blocks = notes.select(block.alias("block")).union(last.select("block")).distinct()
    # one row per block: the order of blocks is short
    carried = blocks.join(last, "block", "left").withColumn("before", F.last("last", True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("block", "before")
    both = notes.unionByName(starts).withColumn("block", block)
    w = Window.partitionBy("block").orderBy("at", F.col("section").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("o_orderkey", F.last("section", True).over(w)).filter("event_id is not null")
    found = within.join(carried, "block", "left").withColumn("o_orderkey", F.coalesce("o_orderkey", "before"))
    return found.filter("o_orderkey is not null").select("event_id", "o_orderkey")
