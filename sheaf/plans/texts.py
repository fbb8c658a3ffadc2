"""Text functions over whole columns, and the language vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import spans, text
from sheaf.plans.registry import query
from sheaf.session import table

#: Words and letters that speak for a language, and spellings that speak for British English.
PROBE_WORDS = {
    "en": "the and of to in is that for with on was are this from have they their not you we",
    "de": "der die das und den dem des ein eine nicht ist von mit auf für sich auch oder nach bei aus dass wir",
    "fr": "les des une est pas qui dans pour sur avec sont cette aux nous vous elle mais leur plus",
    "es": "los las una por con para del está están también porque cuando sobre entre hay muy esto pero como sus",
    "ru": "не что это как все она его для если или уже только когда чтобы можно был была они этот есть",
    "uk": "що як це від але або вже їх також між під його цей якщо немає які який вони була тільки",
}
PROBE_LETTERS = {"de": "äöüß", "fr": "çœàèêëâîïôùûÿ", "es": "ñáíóú¿¡", "ru": "ыэё", "uk": "іїєґ"}
BRITISH = "colour colours favour honour organise organised organisation whilst amongst centre theatre grey defence practise"
FIRST_WORDS, WORD_POINTS, LETTER_POINTS = 400, 2, 3


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


@query("digit_mask", "SELECT doc_id, md5(regexp_replace(trim(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')), '[0-9]+', '#', 'g')) AS masked, len(regexp_extract_all(text, '[0-9]+'))::INTEGER AS runs FROM documents")
def digit_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.digit_mask(F.col("text"))).alias("masked"), F.size(text.digit_runs(F.col("text"))).alias("runs"))


@query("collapse_ws", "SELECT doc_id, md5(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')) AS plain FROM documents")
def collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.collapse_spaces(F.col("text"))).alias("plain"))


@query(
    "clean_text",
    r"""SELECT conv_id, turn, p[1] || regexp_replace(substr(s, length(p[1]) + 1), '([ \t])[ \t]+', '\1', 'g') AS cleaned FROM (
SELECT *, regexp_extract_all(s, '^[ \t]*') AS p FROM (SELECT conv_id, turn,
regexp_replace(regexp_replace(regexp_replace('   ' || replace(replace(text, chr(10), '  '), ',', ' ,') || '  ', '[ \t]+$', ''), '^ {2,}', chr(9)), ' +([,.;:!?)\]])', '\1', 'g') AS s FROM conversations))""",
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    untidy = F.concat(F.lit("   "), F.replace(F.replace("text", F.lit("\n"), F.lit("  ")), F.lit(","), F.lit(" ,")), F.lit("  "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.cleaned(untidy).alias("cleaned"))


@query(
    "split_paragraphs",
    r"SELECT doc_id, len(p)::INTEGER AS n, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(replace(x, chr(9), ' '), '[\x00-\x1f\x7f]', '', 'g'))), lambda x: x <> '') AS p FROM documents)",
)
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = text.paragraphs(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", p.alias("p")).select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


@query(
    "tokenize_words",
    r"SELECT lang, count(*)::BIGINT AS words, count(DISTINCT w)::BIGINT AS distinct_words FROM (SELECT lang, unnest(regexp_extract_all(replace(text, '’', ''''), '[\p{L}\p{M}0-9]+(?:''[\p{L}\p{M}0-9]+)*')) AS w FROM documents) WHERE length(w) > 1 AND NOT regexp_matches(w, '[0-9]') AND w <> upper(w) GROUP BY lang",
)
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _docs(spark, sf_dir).select("lang", F.explode(text.word_tokens(F.col("text"))).alias("w"))
    return words.groupBy("lang").agg(F.count(F.lit(1)).alias("words"), F.count_distinct("w").alias("distinct_words"))


@query("replace_whole_word", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(^|[^\p{L}\p{N}])the([^\p{L}\p{N}]|$)', '\1THE\2', 'g'), '(^|[^\p{L}\p{N}])the([^\p{L}\p{N}]|$)', '\1THE\2', 'g')) AS changed FROM documents")
def replace_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.replace_word(F.col("text"), "the", "THE")).alias("changed"))


def _scores(words: Column) -> Column:
    """(score, minus the place in the list, code) of each language: the greatest comes first, then the earlier."""

    def score(place: int, code: str) -> Column:
        points = F.size(F.filter(words, lambda w: w.isin(PROBE_WORDS[code].split()))) * WORD_POINTS
        if code in PROBE_LETTERS:
            points = points + F.size(F.filter(words, lambda w: F.regexp_like(w, F.lit(f"[{PROBE_LETTERS[code]}]")))) * LETTER_POINTS
        return F.struct(points.alias("score"), F.lit(-place).alias("place"), F.lit(code).alias("code"))

    return F.sort_array(F.array(*[score(i, c) for i, c in enumerate(PROBE_WORDS)]), asc=False)


def _language(spark: SparkSession, sf_dir: str, least: int, lead: int) -> DataFrame:
    """A vote of the first words (that is its definition), within the row: nothing is exploded or shuffled."""
    head = F.regexp_extract("text", rf"^(?:[^\p{{L}}\p{{N}}_]*[\p{{L}}\p{{N}}_]+){{0,{FIRST_WORDS}}}", 0)

    def vote(words: Column) -> Column:
        british = F.size(F.filter(words, lambda w: w.isin(BRITISH.split())))

        def pick(scores: Column) -> Column:
            best, second = scores[0], scores[1]["score"]
            code = F.when((best["code"] == "en") & (british >= 2), "en-GB").otherwise(best["code"])
            sure = (best["score"] >= least) & (best["score"] >= second + lead)
            return F.struct(F.when(sure, code).alias("lang"), best["score"].alias("best"))

        return spans.let(_scores(words), pick)

    planted = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("The colour of the theatre is grey. "), "text")).otherwise(F.col("text"))
    rows = _docs(spark, sf_dir).select("doc_id", planted.alias("text"))
    return rows.select("doc_id", spans.let(text.lower_words(head), vote).alias("v")).select("doc_id", "v.lang", "v.best")


_VOTES_SQL = "WITH w AS (SELECT doc_id, regexp_extract_all(lower(CASE WHEN doc_id % 4 = 0 THEN 'The colour of the theatre is grey. ' ELSE '' END || text), '[\\p{L}\\p{N}_]+')[1:400] AS ws FROM documents), v AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS code, {i} AS place, len(list_filter(ws, lambda x: list_contains({BRITISH.split()}, x))) AS british, (len(list_filter(ws, lambda x: list_contains({PROBE_WORDS[c].split()}, x))) * 2"
    + (f" + len(list_filter(ws, lambda x: regexp_matches(x, '[{PROBE_LETTERS[c]}]'))) * 3" if c in PROBE_LETTERS else "")
    + ")::INTEGER AS score FROM w"
    for i, c in enumerate(PROBE_WORDS)
) + "), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS k, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS second FROM v) SELECT doc_id, CASE WHEN score >= {least} AND score >= second + {lead} THEN CASE WHEN code = 'en' AND british >= 2 THEN 'en-GB' ELSE code END END AS lang, score AS best FROM r WHERE k = 1"


@query("lang_detect", _VOTES_SQL.replace("{least}", "6").replace("{lead}", "4"))
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language(spark, sf_dir, 6, 4)


@query("lang_hint", _VOTES_SQL.replace("{least}", "2").replace("{lead}", "1"))
def lang_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language(spark, sf_dir, 2, 1)


@query("word_scripts", r"SELECT script, count(*)::BIGINT AS n FROM (SELECT CASE WHEN regexp_matches(w, '^[A-Za-zÀ-ɏ]+$') THEN 'latin' WHEN regexp_matches(w, '^[Ѐ-ӿ]+$') THEN 'cyrillic' END AS script FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents)) GROUP BY script")
def word_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _docs(spark, sf_dir).select(F.explode(text.lower_words(F.col("text"))).alias("w"))
    return words.groupBy(text.script_of(F.col("w")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query("xml_escape", "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(13), '&#13;')) AS escaped, length(html)::INTEGER AS n FROM pages")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.xml_escaped(F.col("html"))).alias("escaped"), F.length("html").alias("n"))


@query("file_names", r"""SELECT page_id, CASE WHEN regexp_matches(upper(n), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\.|$)') THEN '_' || n ELSE n END AS name FROM (
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[. ]+', ''), '[. ]+$', '') AS n FROM pages)""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.safe_file_name(F.col("url")).alias("name"))


@query("url_paths", r"SELECT page_id, '/' || array_to_string(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda x: x NOT IN ('', '.')), '/') AS path FROM pages")
def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of each address with empty and dot segments resolved."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(text.resolved_path(path), F.lit("/")).alias("path"))


@query("word_skeletons", "SELECT source, count(DISTINCT translate(w, 'čćšžđ', 'ccszd'))::BIGINT AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents) GROUP BY source")
def word_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("source", F.explode(text.lower_words(F.col("text"))).alias("w"))
    return words.groupBy("source").agg(F.count_distinct(text.skeleton(F.col("w"))).alias("n"))


@query("event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))
