"""Document queries: cascades, alignment, revisions, queues, formulas, spelling, matches with places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions import spans, text
from sheaf.operators import documents
from sheaf.plans.registry import query
from sheaf.session import table


@query(
    "toggle_cascade",
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE CASE WHEN p_partkey % 4 = 0 THEN false WHEN p_partkey % 4 = 1 THEN true WHEN p_partkey % 4 = 2 THEN false ELSE true END END AS bold FROM part""",
)
def toggle_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On and on is off; off clears; a later on sets again; a direct state decides."""
    on, off, none = F.lit("on"), F.lit("off"), F.lit(None).cast("string")
    k = F.col("p_partkey") % 4
    states = F.when(k == 0, F.array(on, on)).when(k == 1, F.array(off, on)).when(k == 2, F.array(on, off, none)).otherwise(F.array(none, on, none))
    direct = F.when(F.col("p_size") % 3 == 0, "on").when(F.col("p_size") % 3 == 1, "off")
    return table(spark, sf_dir, "part").select("p_partkey", documents.toggled(states, direct).alias("bold"))


@query("style_overlay", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type ELSE p_brand END AS font, p_brand AS face, p_name AS size FROM part")
def style_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.create_map(F.lit("font"), F.col("p_brand"), F.lit("face"), F.col("p_brand"))
    own = F.create_map(F.lit("font"), F.when(F.col("p_size") > 25, F.col("p_type")), F.lit("size"), F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", documents.overlay(F.array(base, own)).alias("m"))
    return rows.select("p_partkey", *[F.col("m")[c].alias(c) for c in ("font", "face", "size")])


@query("theme_colours", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN (p_size * 5) * 191 // 255 ELSE 255 - (255 - p_size * 5) * (255 - 102) // 255 END::BIGINT AS channel FROM part")
def theme_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    shade, tint = F.when(F.col("p_size") % 2 == 0, 191), F.lit(102)
    return table(spark, sf_dir, "part").select("p_partkey", documents.tinted(F.col("p_size") * 5, shade, tint).alias("channel"))


@query("heading_levels", "SELECT p_partkey, CASE WHEN p_size / 20.0 >= 1.8 THEN 0 WHEN p_size / 20.0 >= 1.45 THEN 1 WHEN p_size / 20.0 > 1.15 THEN 2 END AS level FROM part")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", documents.heading_level(F.col("p_size"), F.lit(20.0)).alias("level"))


@query("fractional_boxes", "SELECT p_partkey, round(p_size / 1000.0, 9)::DOUBLE AS left, round(least(1, (p_size + p_retailprice) / CASE WHEN p_size + p_retailprice > 1000 THEN 2000 ELSE 1000 END), 9)::DOUBLE AS bottom FROM (SELECT *, 0 AS z FROM part) WHERE p_size + p_retailprice <= 1000 OR p_size IS NULL")
def fractional_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.col("p_size").cast("double"), F.col("p_retailprice")
    rows = table(spark, sf_dir, "part").filter(s + p <= 1000)
    box = documents.fractional_box(s, s, s + p, s + p, F.lit(2000.0), F.lit(2000.0))
    return rows.select("p_partkey", box.alias("b")).select("p_partkey", F.round(F.col("b")[0], 9).alias("left"), F.round(F.col("b")[3], 9).alias("bottom"))


_ATOMS = "a AS (SELECT p_partkey, unnest(['C', 'H', 'O', 'N']) AS symbol, unnest([p_size::BIGINT, p_size::BIGINT * 2 + 2, 1::BIGINT, (p_partkey % 3)::BIGINT]) AS n FROM part)"


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    formula = F.concat(F.lit("N"), F.col("p_partkey") % 3, F.lit("OC"), F.col("p_size"), F.lit("H"), F.col("p_size") * 2 + 2)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(documents.formula_atoms(formula)).alias("a")).select("p_partkey", "a.symbol", "a.n")


@query("element_totals", f"WITH {_ATOMS} SELECT symbol, sum(n)::BIGINT AS n FROM a GROUP BY symbol")
def element_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _atoms(spark, sf_dir).groupBy("symbol").agg(F.sum("n").alias("n"))


@query("molar_mass", f"WITH {_ATOMS} SELECT p_partkey, round(sum(n * CASE symbol WHEN 'C' THEN 12.011 WHEN 'H' THEN 1.008 WHEN 'O' THEN 15.999 WHEN 'N' THEN 14.007 END), 6)::DOUBLE AS mass FROM a GROUP BY p_partkey")
def molar_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    masses = spark.createDataFrame([("C", 12.011), ("H", 1.008), ("O", 15.999), ("N", 14.007)], "symbol string, mass double")  # fixed values: atomic masses
    return _atoms(spark, sf_dir).join(F.broadcast(masses), "symbol").groupBy("p_partkey").agg(F.round(F.sum(F.col("n") * F.col("mass")), 6).alias("mass"))


@query("hill_formula", "SELECT p_partkey, CASE p_size WHEN 0 THEN '' WHEN 1 THEN 'C' ELSE 'C' || p_size END || 'H' || (p_size * 2 + 2) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'N' ELSE 'N2' END || 'O' AS formula FROM part")
def hill_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.hill_order(_atoms(spark, sf_dir), "p_partkey")


@query("match_places", "SELECT doc_id, count(*)::BIGINT AS hits, min(strpos(text, 'tion') - 1)::BIGINT AS first FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, 'tion')) FROM documents) GROUP BY doc_id")
def match_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", spans.find(F.col("text"), "tion").alias("s")).filter(F.size("s") > 0)
    return found.select("doc_id", F.size("s").cast("long").alias("hits"), F.col("s")[0]["start"].alias("first"))


@query("spell_suggest")
def spell_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known words one edit away from rare ones."""
    words = table(spark, sf_dir, "conversations").select(F.explode(text.lower_words(F.col("text"))).alias("word")).filter(F.regexp_like("word", F.lit("^[a-z]{3,8}$")))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return documents.suggestions(counts.filter("n = 1"), counts.filter("n >= 3"))


@query("request_queue", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL ORDER BY event_id DESC, user_id, event_type LIMIT 512")
def request_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.newest_queue(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")


@query("document_cache", "SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC) AS used FROM documents WHERE n_chars <= 20000) WHERE used <= 20000")
def document_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of 20000 characters per source holds, newest first."""
    return documents.within_budget(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], "doc_id", "n_chars", 20000).select("doc_id")


@query("accept_revisions", "SELECT event_id FROM events WHERE event_type <> 'error'")
def accept_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert")
    return documents.accepted(table(spark, sf_dir, "events").select("event_id", kind.alias("kind")), "kind").select("event_id")


@query("cross_references", "SELECT event_id, coalesce(nullif(title, ''), '??') AS title FROM events LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS title FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = user_id")
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("title"))
    return documents.resolved_references(table(spark, sf_dir, "events").select("event_id", "user_id"), labels, "user_id", "title").select("event_id", "title")


@query(
    "rename_collisions",
    """SELECT p_partkey, CASE WHEN k = 0 THEN p_name ELSE p_name || ' (' || (k + 1) || ')' END AS target FROM (
SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 + CASE WHEN p_name LIKE '%bolt' THEN 1 ELSE 0 END AS k FROM part)""",
)
def rename_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return documents.free_names(part, part.filter("p_name like '%bolt'"), "p_name", "p_partkey").select("p_partkey", "target")


_INK = "ink AS (SELECT l_suppkey AS row, avg((l_quantity < 20)::INTEGER) AS share FROM lineitem GROUP BY 1)"


@query("ink_profile", f"WITH {_INK} SELECT row, round(share, 9)::DOUBLE AS share FROM ink")
def ink_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of dark pixels per row: quantities under 20 are dark."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row")).agg(F.round(F.avg((F.col("l_quantity") < 20).cast("int")), 9).alias("share"))


@query("ink_centroid", "SELECT l_returnflag, round(avg(l_suppkey), 6)::DOUBLE AS x, round(avg(l_partkey), 6)::DOUBLE AS y FROM lineitem WHERE l_quantity < 20 GROUP BY 1")
def ink_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_quantity < 20").groupBy("l_returnflag").agg(F.round(F.avg("l_suppkey"), 6).alias("x"), F.round(F.avg("l_partkey"), 6).alias("y"))


@query(
    "profile_shift",
    f"""WITH {_INK}, r AS (SELECT row + 3 AS i, share AS v FROM ink), s AS (SELECT unnest(range(-5, 6)) AS shift),
c AS (SELECT shift, round(corr(share, v), 9) AS r FROM ink JOIN s ON true JOIN r ON r.i + shift = ink.row GROUP BY shift) SELECT arg_max(shift, (r, -shift))::INTEGER AS shift, max(r)::DOUBLE AS r FROM c WHERE r IS NOT NULL""",
)
def profile_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile moved by three rows is found at minus three."""
    ink = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("i")).agg(F.avg((F.col("l_quantity") < 20).cast("int")).alias("v"))
    return documents.best_shift(ink, ink.withColumn("i", F.col("i") + 3), "i", "v", 5).select("shift", "r")


@query(
    "break_agreement",
    """SELECT count_if(a AND b)::BIGINT AS tp, count_if(NOT a AND b)::BIGINT AS fp, count_if(a AND NOT b)::BIGINT AS fn FROM (
SELECT lag(event_type) OVER w <> event_type AS a, floor(lag(value) OVER w / 20) <> floor(value / 20) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def break_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks of two segmentations of the same rows: both, only the second, only the first."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select((F.lag("event_type").over(w) != F.col("event_type")).alias("a"), (F.floor(F.lag("value").over(w) / 20) != F.floor(F.col("value") / 20)).alias("b"))
    both = rows.filter("a is not null and b is not null")
    return both.agg(F.count_if(F.col("a") & F.col("b")).alias("tp"), F.count_if(~F.col("a") & F.col("b")).alias("fp"), F.count_if(F.col("a") & ~F.col("b")).alias("fn"))


@query("tool_calls", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN event_type ELSE 'payload' END AS name, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 3 > 0")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that are JSON as a whole, under either pair of names; other text gives none."""
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.concat(F.lit("call: "), "props")).when(k == 1, F.concat(F.lit('{"tool": "'), "event_type", F.lit('", "arguments": '), "props", F.lit("}"))).otherwise(F.concat(F.lit('{"name": "payload", "payload": '), "props", F.lit("}")))
    v = F.try_parse_json("said")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    rows = table(spark, sf_dir, "events").select("event_id", said.alias("said")).select("event_id", v.alias("v")).filter("v is not null")
    return rows.select("event_id", F.coalesce(get("$.tool", "string"), get("$.name", "string")).alias("name"), F.coalesce(get("$.arguments.k", "long"), get("$.payload.k", "long")).alias("k"))


@query("folded_words", "SELECT lang, count(DISTINCT f)::BIGINT AS n, max(f) AS last FROM (SELECT lang, 'fia' || replace(lower(w), 'ß', 'ss') AS f FROM (SELECT lang, unnest(regexp_extract_all(text, '[\\p{L}]+')) AS w FROM documents)) GROUP BY lang")
def folded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words behind a ligature and a wide capital, which fold to plain letters."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("w")).distinct()
    folded = words.select("lang", documents.folded(F.concat(F.lit("\ufb01\uff21"), "w")).alias("w"))
    return folded.groupBy("lang").agg(F.count_distinct("w").alias("n"), F.max("w").alias("last"))


@query("lcs_diff")
def lcs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations against a version without every fifth turn."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return documents.story_diff(rows, rows.filter("turn % 5 <> 4"), "conv_id", "turn", "text")


@query("box_clusters")
def box_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") % 1000, F.col("l_orderkey") % 1000
    return documents.grown_clusters(rows.select(F.col("l_suppkey").alias("page"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 10).alias("y1")), "page", 20.0)


@query("conformance_policy", """SELECT mode, normalizer, kind, CASE WHEN mode = 'strict' THEN kind = 'Strict' WHEN normalizer THEN true WHEN mode = 'normalize' THEN kind = 'Strict' ELSE kind IN ('Strict', 'Unknown') END AS opens
FROM (SELECT unnest(['strict', 'normalize', 'permissive']) AS mode), (SELECT unnest([true, false]) AS normalizer), (SELECT unnest(['Strict', 'Transitional', 'Unknown']) AS kind)""")
def conformance_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds of package each mode opens: 18 fixed cases."""
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, ("strict", "normalize", "permissive")))).alias("mode"))
    every = one.select("mode", F.explode(F.array(F.lit(True), F.lit(False))).alias("normalizer")).select("*", F.explode(F.array(*map(F.lit, ("Strict", "Transitional", "Unknown")))).alias("kind"))
    strict = F.col("kind") == "Strict"
    opens = F.when(F.col("mode") == "strict", strict).when(F.col("normalizer"), True).when(F.col("mode") == "normalize", strict).otherwise(F.col("kind").isin("Strict", "Unknown"))
    return every.withColumn("opens", opens)


@query(
    "name_templates",
    "SELECT p_partkey, p_brand || '_' || lpad(p_size::VARCHAR, 4, '0') || '_{unknown}' AS target FROM part",
)
def name_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = documents.from_template("{folder}_{n:4}_{unknown}", {"folder": F.col("p_brand")}, F.col("p_size"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", target.alias("target"))


_ONE_WORD = "(SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)"


@query(
    "affix_forms",
    f"SELECT w, w AS form FROM {_ONE_WORD} UNION SELECT w, w || 's' FROM {_ONE_WORD} WHERE regexp_matches(w, '[^s]$') UNION SELECT w, left(w, -1) || 'ing' FROM {_ONE_WORD} WHERE regexp_matches(w, 'e$') UNION SELECT w, w || 'ing' FROM {_ONE_WORD} WHERE regexp_matches(w, '[^e]$')",
)
def affix_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    rules = spark.createDataFrame([("", "s", "[^s]"), ("e", "ing", "e"), ("", "ing", "[^e]")], "strip string, add string, condition string")
    return documents.affixed(words, rules, "w")


@query(
    "outline_targets",
    """SELECT event_id, CASE WHEN t < 1 OR t > 1000 THEN NULL ELSE t END::BIGINT AS page FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 1200 WHEN 1 THEN user_id + 7 ELSE event_id % 50 END AS t FROM events)""",
)
def outline_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``#page=N``, an offset from the current page, or a bare number; beyond 1000 pages nothing."""
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.format_string("#page=%d", F.col("event_id") % 1200)).when(k == 1, "#+7").otherwise(F.format_string("#%d", F.col("event_id") % 50))
    number = lambda p: F.regexp_extract("said", p, 1).try_cast("long")
    target = F.coalesce(number(r"^#page=([0-9]+)$"), F.col("user_id") + number(r"^#([+-][0-9]+)$"), number(r"^#([0-9]+)$"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", said.alias("said")).select("event_id", target.alias("t"))
    return rows.select("event_id", F.when(F.col("t").between(1, 1000), F.col("t")).alias("page"))
