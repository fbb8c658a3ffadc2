"""Forms of text and bytes, small tables and cells.  Inputs plant the marks that the supplied tables lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import forms
from sheaf.operators import grids, numbering
from sheaf.plans.registry import query
from sheaf.session import table


def _bytes(name: str) -> Column:
    return F.col(name).cast("binary")


def _raw(digits: str) -> Column:
    return F.unhex(F.lit(digits))


@query(
    "text_or_binary",
    """SELECT doc_id, starts_with(h, 'EFBBBF') OR starts_with(h, 'FFFE') OR starts_with(h, 'FEFF') OR NOT regexp_matches(left(h, 16384), '^(?:..)*00') AS is_text
FROM (SELECT doc_id, CASE lang WHEN 'de' THEN hex(encode(text)) || '00' WHEN 'fr' THEN 'FFFE' || hex(encode(text)) || '00' ELSE hex(encode(text)) END AS h FROM documents)""",
)
def text_or_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _bytes("text")
    content = F.when(F.col("lang") == "de", F.concat(own, _raw("00"))).when(F.col("lang") == "fr", F.concat(_raw("FFFE"), own, _raw("00"))).otherwise(own)
    return table(spark, sf_dir, "documents").select("doc_id", forms.looks_like_text(content).alias("is_text"))


@query(
    "decoded_text",
    """SELECT doc_id, md5(CASE lang WHEN 'es' THEN 'Привет' || regexp_replace(text, '[^\\x00-\\x7f]', '', 'g') ELSE text END) AS digest,
CASE lang WHEN 'de' THEN 'UTF-16LE' WHEN 'fr' THEN 'UTF-16BE' WHEN 'es' THEN 'Windows-1251' ELSE 'UTF-8' END AS encoding FROM documents""",
)
def decoded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files of four encodings, read back; one in four ends within a character."""
    lang, cyrillic = F.col("lang"), _raw("CFF0E8E2E5F2")
    content = (
        F.when(lang == "de", F.concat(_raw("FFFE"), F.encode("text", "UTF-16LE"))).when(lang == "fr", F.concat(_raw("FEFF"), F.encode("text", "UTF-16BE")))
        .when(lang == "es", F.concat(cyrillic, F.regexp_replace("text", "[^\\x00-\\x7f]", "").cast("binary"))).otherwise(F.concat(_bytes("text"), _raw("E282")))
    )
    found = table(spark, sf_dir, "documents").select("doc_id", forms.decoded(content).alias("d"))
    return found.select("doc_id", F.md5("d.text").alias("digest"), F.col("d.encoding").alias("encoding"))


@query(
    "page_charsets",
    """SELECT page_id, md5(CASE page_id % 3 WHEN 0 THEN '<meta charset="iso-8859-1">é€' || url WHEN 1 THEN '<META http-equiv=x content="text/html; charset = utf-8">é' || url END) AS digest FROM pages""",
)
def page_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under two declared charsets, and under one that their bytes don't fit."""
    kind = F.col("page_id") % 3
    content = (
        F.when(kind == 0, F.concat(F.lit('<meta charset="iso-8859-1">').cast("binary"), _raw("E980"), _bytes("url")))
        .when(kind == 1, F.concat(F.lit('<META http-equiv=x content="text/html; charset = utf-8">é').cast("binary"), _bytes("url")))
        .otherwise(F.concat(F.lit("<meta charset=utf-8>").cast("binary"), _raw("E9"), _bytes("url")))
    )
    return table(spark, sf_dir, "pages").select("page_id", F.md5(forms.page_text(content)).alias("digest"))


@query(
    "hex_dump",
    """SELECT page_id, string_agg(upper(printf('%08x', r * 16)) || '  ' || rpad(substr(p, 1, 24), 24, ' ') || ' ' || rpad(substr(p, 25, 24), 24, ' ') || ' ' || a, chr(10) ORDER BY r) AS dump FROM (
SELECT page_id, r, regexp_replace(substr(h, r * 32 + 1, 32), '(..)', '\\1 ', 'g') AS p,
array_to_string(list_transform(regexp_extract_all(substr(h, r * 32 + 1, 32), '..'), lambda x: CASE WHEN x BETWEEN '20' AND '7E' THEN chr(CAST('0x' || x AS INTEGER)) ELSE '.' END), '') AS a
FROM (SELECT page_id, h, unnest(range((len(h) + 31) // 32)) AS r FROM (SELECT page_id, hex(encode(url || chr(9) || 'é')) AS h FROM pages))) GROUP BY page_id""",
)
def hex_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat("url", F.lit("\té")).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(forms.hex_lines(content), "\n").alias("dump"))


_MARKDOWN = """SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN s_name || chr(10) || '| a | b |' WHEN 1 THEN '| only |' || chr(10) || '|---|' || chr(10) || '| ' || s_name || ' |'
ELSE '| key | ' || s_suppkey || ' |' || chr(10) || chr(10) || '|:---|---:|' || chr(10) || ' | ' || s_name || '| x || y |' || chr(10) END AS t FROM supplier"""


@query(
    "markdown_tables",
    f"""SELECT s_suppkey, CASE WHEN len(lines) >= 2 AND len(list_filter(lines, lambda x: NOT starts_with(x, '|'))) = 0 AND len(rows) >= 2 AND len(list_filter(rows, lambda r: len(r) >= 2)) > 0
THEN array_to_string(list_transform(rows, lambda r: array_to_string(r, ';')), '/') END AS told FROM (
SELECT *, list_filter(list_transform(lines, lambda x: list_transform(string_split(regexp_replace(x, '^\\|+|\\|+$', '', 'g'), '|'), lambda c: trim(c))), lambda r: len(list_filter(r, lambda c: NOT regexp_matches(c, '^[-: ]+$'))) > 0) AS rows FROM (
SELECT s_suppkey, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM ({_MARKDOWN})))""",
)
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, a table of one column, and a text that is none."""
    key = F.col("s_suppkey").cast("string")
    text = (
        F.when(F.col("s_nationkey") % 4 == 0, F.concat("s_name", F.lit("\n| a | b |"))).when(F.col("s_nationkey") % 4 == 1, F.concat(F.lit("| only |\n|---|\n| "), "s_name", F.lit(" |")))
        .otherwise(F.concat(F.lit("| key | "), key, F.lit(" |\n\n|:---|---:|\n | "), "s_name", F.lit("| x || y |\n")))
    )
    rows = forms.markdown_table(text)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.transform(rows, lambda r: F.array_join(r, ";")), "/").alias("told"))


@query(
    "terminal_texts",
    r"SELECT page_id, '\u{1b}[31m' || url || '\u{9b}\u{7}' || chr(9) || chr(10) || '\u{d}\u{7f}' AS shown FROM pages",
)
def terminal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", forms.terminal_safe(F.concat(F.lit("\x1b[31m"), "url", F.lit("\x9b\x07\t\n\r\x7f"))).alias("shown"))


@query(
    "emphasis_runs",
    r"""SELECT conv_id, turn, string_agg(w || ':' || CASE b % 2 WHEN 1 THEN 'b' ELSE '' END || CASE i % 2 WHEN 1 THEN 'i' ELSE '' END, '/' ORDER BY k) AS runs FROM (
SELECT conv_id, turn, k, w, sum((w = '**')::INT) OVER o AS b, sum((w = '*')::INT) OVER o AS i FROM (
SELECT conv_id, turn, unnest(t) AS w, generate_subscripts(t, 1) AS k FROM (SELECT conv_id, turn, regexp_extract_all('plain **bold *both*** ' || role || ' *' || left(text, 20) || '** end', '\*\*|\*|[^*]+') AS t FROM conversations))
WINDOW o AS (PARTITION BY conv_id, turn ORDER BY k)) WHERE w NOT IN ('*', '**') GROUP BY ALL""",
)
def emphasis_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("plain **bold *both*** "), "role", F.lit(" *"), F.substring("text", 1, 20), F.lit("** end"))
    said = F.transform(forms.emphasis(text), lambda r: F.concat(r["text"], F.lit(":"), F.when(r["bold"], "b").otherwise(""), F.when(r["italic"], "i").otherwise("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(said, "/").alias("runs"))


@query(
    "join_decisions",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE array_to_string(list_filter([1, o_orderkey % 50, 48, 90], lambda i: i >= 2 AND i + 1 < 50), ',') END AS places FROM orders""",
)
def join_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in a code fence, bare, and one that is no list of numbers."""
    key = F.col("o_orderkey")
    listed = F.concat(F.lit("[1, "), (key % 50).cast("string"), F.lit(",48, 90]"))
    answer = F.when(key % 3 == 0, F.lit("[1, \"two\"]")).when(key % 3 == 1, F.concat(F.lit("```json\n"), listed, F.lit("\n```"))).otherwise(listed)
    places = forms.join_places(answer, F.lit(2), F.lit(50))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(places.isNotNull(), F.array_join(places.cast("array<string>"), ",")).alias("places"))


@query("clipped_texts", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS shown FROM documents")
def clipped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", forms.clipped(F.col("text"), 80).alias("shown"))


@query(
    "text_places",
    """SELECT part.p_partkey, CASE WHEN p_size = 2 OR p_size > length(p_name) + 2 THEN NULL WHEN p_size <= 1 THEN p_size ELSE p_size - 1 END::INTEGER AS scalar,
CASE WHEN p_size > length(p_name) + 1 THEN NULL WHEN p_size <= 1 THEN p_size ELSE p_size + 1 END::INTEGER AS utf16 FROM part""",
)
def text_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in UTF-16 units and code points of names that hold a character beyond the first plane."""
    text, at = F.concat(F.substring("p_name", 1, 1), F.lit("😀"), F.substring("p_name", F.lit(2), F.length("p_name"))), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", forms.scalar_of_utf16(text, at).alias("scalar"), forms.utf16_of_scalar(text, at).alias("utf16"))


@query(
    "grapheme_steps",
    "SELECT n_nationkey, length(left_grapheme(t, 1))::INTEGER AS one, (length(left_grapheme(t, 1)) + length(left_grapheme(substr(t, length(left_grapheme(t, 1)) + 1), 1)))::INTEGER AS two FROM (SELECT n_nationkey, CASE n_regionkey % 2 WHEN 0 THEN 'e' || chr(769) || '👨' || chr(8205) || '👩' || n_name ELSE n_name || 'é' END AS t FROM nation)",
)
def grapheme_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit("é👨‍👩"), "n_name")).otherwise(F.concat("n_name", F.lit("é")))
    told = table(spark, sf_dir, "nation").select("n_nationkey", text.alias("t")).select("n_nationkey", "t", forms.next_boundary(F.col("t"), F.lit(0)).alias("one"))
    return told.select("n_nationkey", "one", forms.next_boundary(F.col("t"), F.col("one")).alias("two"))


@query("base64_texts", "SELECT doc_id, md5(to_base64(encode(text))) AS digest FROM documents")
def base64_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(forms.base64_text(_bytes("text"))).alias("digest"))


@query(
    "fnv_hashes",
    """SELECT p_partkey, printf('%016x', CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(p_name, ''), lambda c: unicode(c)::HUGEINT)),
lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT)) AS hash FROM part""",
)
def fnv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", forms.fnv1a(_bytes("p_name")).alias("hash"))


#: Attribute values that the strict form renames, as (element, attribute, old, new).
RENAMED = (
    ("jc", "val", "left", "start"), ("jc", "val", "right", "end"), ("tab", "val", "left", "start"), ("tab", "val", "right", "end"),
    ("lvlJc", "val", "left", "start"), ("lvlJc", "val", "right", "end"), ("textDirection", "val", "lrTb", "tb"), ("textDirection", "val", "tbRl", "rl"),
)


@query(
    "value_map",
    "SELECT n.n_nationkey, n.element, n.value, r.renamed FROM (SELECT n_nationkey, ['jc', 'tab', 'ind', 'textDirection'][n_nationkey % 4 + 1] AS element, ['left', 'right', 'center', 'tbRl', 'lrTb'][n_regionkey + 1] AS value FROM nation) n LEFT JOIN (VALUES "
    + ", ".join(f"('{e}', '{o}', '{n}')" for e, _, o, n in RENAMED)
    + ") r(element, value, renamed) USING (element, value)",
)
def value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values renamed by an exact (element, attribute, value); null where there is none."""
    rows = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.element_at(F.array(*map(F.lit, ("jc", "tab", "ind", "textDirection"))), F.col("n_nationkey") % 4 + 1).alias("element"),
        F.lit("val").alias("attribute"), F.element_at(F.array(*map(F.lit, ("left", "right", "center", "tbRl", "lrTb"))), F.col("n_regionkey") + 1).alias("value"),
    )
    names = spark.createDataFrame(RENAMED, "element string, attribute string, value string, renamed string")
    return rows.join(F.broadcast(names), ["element", "attribute", "value"], "left").select("n_nationkey", "element", "value", "renamed")


#: Families whose namespaces have a strict and a transitional form.
FAMILIES = (
    "wordprocessingml/main", "spreadsheetml/main", "presentationml/main", "drawingml/main", "drawingml/chart", "drawingml/diagram", "drawingml/wordprocessingDrawing",
    "drawingml/spreadsheetDrawing", "drawingml/chartDrawing", "officeDocument/relationships", "officeDocument/math", "officeDocument/bibliography", "officeDocument/customXml",
)


def namespaces(family: str) -> tuple[str, str]:
    """(strict, transitional) namespace of a family."""
    area, part = family.split("/")
    return f"http://purl.oclc.org/ooxml/{family}", f"http://schemas.openxmlformats.org/{area}/2006/{part}"


@query(
    "namespace_forms",
    f"""SELECT p_partkey, uri, CASE WHEN uri IN ({', '.join(repr(namespaces(f)[0]) for f in FAMILIES)}) THEN 'strict' WHEN uri IN ({', '.join(repr(namespaces(f)[1]) for f in FAMILIES)}) THEN 'transitional' END AS conformance FROM (
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'http://purl.oclc.org/ooxml/' || f WHEN 1 THEN 'http://schemas.openxmlformats.org/' || replace(f, '/', '/2006/') ELSE 'urn:other:' || f END AS uri
FROM (SELECT p_partkey, p_size, {list(FAMILIES)!r}[p_partkey % {len(FAMILIES)} + 1] AS f FROM part))""",
)
def namespace_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("p_partkey") % len(FAMILIES) + 1).cast("int"))
    kind = F.col("p_size") % 3
    uri = F.when(kind == 0, F.concat(F.lit("http://purl.oclc.org/ooxml/"), family)).when(kind == 1, F.concat(F.lit("http://schemas.openxmlformats.org/"), F.replace(family, F.lit("/"), F.lit("/2006/"))))
    rows = table(spark, sf_dir, "part").select("p_partkey", uri.otherwise(F.concat(F.lit("urn:other:"), family)).alias("uri"))
    known = spark.createDataFrame([(u, c) for f in FAMILIES for u, c in zip(namespaces(f), ("strict", "transitional"), strict=True)], "uri string, conformance string")
    return rows.join(F.broadcast(known), "uri", "left").select("p_partkey", "uri", "conformance")


@query("interned_types", "SELECT p_partkey, p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS number FROM part")
def interned_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.interned(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "number")


@query(
    "border_merge",
    "SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'double' ELSE 'single' END AS top, CASE WHEN s_nationkey % 3 = 0 THEN 'dotted' ELSE 'thick' END AS bottom, CASE WHEN s_nationkey % 3 = 0 THEN 'none' END AS left_side FROM supplier",
)
def border_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer's sides over a table's own; sides that the layer leaves open stay."""
    nation = F.col("s_nationkey")
    own = F.create_map(F.lit("top"), F.lit("single"), F.lit("bottom"), F.lit("thick"))
    layer = F.create_map(
        F.lit("top"), F.when(nation % 2 == 0, "double"), F.lit("bottom"), F.when(nation % 3 == 0, "dotted"), F.lit("left"), F.when(nation % 3 == 0, "none"),
    )
    merged = forms.merged_sides(own, layer)
    return table(spark, sf_dir, "supplier").select("s_suppkey", merged["top"].alias("top"), merged["bottom"].alias("bottom"), merged["left"].alias("left_side"))


@query("feature_ids", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN n_name ELSE 'w:' || n_name END AS feature FROM nation")
def feature_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    namespace = F.when(F.col("n_regionkey") == 0, "").otherwise("urn:x")
    return table(spark, sf_dir, "nation").select("n_nationkey", forms.feature_id(namespace, F.col("n_name")).alias("feature"))


@query("recipe_round_trip", "SELECT event_id, json(props)::VARCHAR AS recipe FROM events")
def recipe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.from_json("props", "k bigint")).alias("recipe"))


@query(
    "table_rows",
    "SELECT l_orderkey, string_agg(l_returnflag || ';' || l_linestatus || ';' || l_quantity::BIGINT, '/' ORDER BY l_linenumber, l_partkey, l_quantity) AS told FROM lineitem GROUP BY l_orderkey",
)
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as rows of cell text."""
    cells = F.array("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").cast("string"))
    return grids.rows_of_text(table(spark, sf_dir, "lineitem").withColumn("cells", cells), table="l_orderkey", order=["l_linenumber", "l_partkey", "l_quantity"], cells="cells", name="told")


#: Text rendering modes that paint nothing.
HIDDEN_MODES = (3, 7)


@query(
    "painted_glyphs",
    "SELECT l_orderkey, count(*)::BIGINT AS glyphs, string_agg(l_linestatus, '' ORDER BY l_linenumber, l_partkey, l_linestatus) AS line FROM lineitem WHERE l_linenumber NOT IN (3, 7) GROUP BY l_orderkey",
)
def painted_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the glyphs that are painted (line numbers stand for rendering modes)."""
    painted = table(spark, sf_dir, "lineitem").filter(~F.col("l_linenumber").isin(*HIDDEN_MODES))
    glyphs = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_linestatus")))
    return painted.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("glyphs"), F.array_join(F.transform(glyphs, lambda g: g["l_linestatus"]), "").alias("line"))


_CELLS = "SELECT c_custkey AS grid, r AS row, c AS col, 1 AS height, CASE WHEN r = 0 AND c = 0 AND c_nationkey % 5 = 0 THEN 2 ELSE 1 END AS width, c_name || r || c AS text FROM customer, range(3) a(r), range(3) b(c) WHERE NOT (r = 0 AND c = 1 AND c_nationkey % 5 = 0)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three by three grid for each customer; in some, the first cell spans two columns."""
    wide = F.col("c_nationkey") % 5 == 0
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("grid"), "c_name", wide.alias("wide"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    rows = rows.select("grid", F.floor(F.col("k") / 3).cast("int").alias("row"), (F.col("k") % 3).alias("col"), F.lit(1).alias("height"), "c_name", "wide")
    rows = rows.filter(~((F.col("row") == 0) & (F.col("col") == 1) & F.col("wide")))
    width = F.when((F.col("row") == 0) & (F.col("col") == 0) & F.col("wide"), 2).otherwise(1)
    return rows.select("grid", "row", "col", "height", width.alias("width"), F.concat("c_name", F.col("row").cast("string"), F.col("col").cast("string")).alias("text"))


@query(
    "cell_merge",
    f"""WITH c AS ({_CELLS}), o AS (SELECT *, row < 2 AND 0 < row + height AND col < 3 AND 1 < col + width AS hit, row >= 0 AND row + height <= 2 AND col >= 1 AND col + width <= 3 AS inside FROM c),
g AS (SELECT grid, bool_and(inside) AND sum(height * width) = 4 AS good FROM o WHERE hit GROUP BY grid)
SELECT grid, row::INTEGER AS row, col::INTEGER AS col, height, width, text FROM o LEFT JOIN g USING (grid) WHERE NOT (hit AND coalesce(good, false))
UNION ALL SELECT grid, 0, 1, 2, 2, string_agg(text, chr(10) ORDER BY row, col) FROM o JOIN g USING (grid) WHERE hit AND good GROUP BY grid""",
)
def cell_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of rows 0 and 1, columns 1 and 2 become one, unless a cell sticks out."""
    rects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("grid"), F.lit(0).alias("top"), F.lit(2).alias("bottom"), F.lit(1).alias("left"), F.lit(3).alias("right"))
    return grids.merged(_grid(spark, sf_dir), rects)


@query(
    "cell_split",
    f"""WITH c AS ({_CELLS}) SELECT grid, row::INTEGER AS row, col::INTEGER AS col, height, width, text FROM c WHERE NOT (row = 0 AND col = 0 AND width = 2)
UNION ALL SELECT grid, 0, k::INTEGER, 1, 1, CASE WHEN k = 0 THEN text ELSE '' END FROM c, range(2) x(k) WHERE row = 0 AND col = 0 AND width = 2""",
)
def cell_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two columns become two; the first keeps the text."""
    return grids.split(_grid(spark, sf_dir))


@query("joined_fragments")
def joined_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments on one baseline joined to lines; orders stand for pages, so every row takes part."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), (F.col("l_quantity") * 4).alias("x"), F.floor(F.col("l_tax") * 25).alias("baseline"),
        F.lit(10.0).alias("size"), F.lit(12.0).alias("width"), F.col("l_returnflag").alias("text"),
    )
    return grids.joined_fragments(rows.withColumn("baseline", F.col("baseline") * 12.0))
