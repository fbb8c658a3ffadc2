"""Edge literals of the functions and small operators."""

import pytest
from pyspark.sql import functions as F

from sheaf.functions import numbers, text
from sheaf.operators import graph, reports, search, sequences


def value(spark, column, **row):
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kind(v)}" for k, v in row.items()))
    return frame.select(column.alias("x")).first()[0]


def kind(v):
    return "string" if v is None or isinstance(v, str) else "double" if isinstance(v, float) else "long"


@pytest.mark.parametrize(
    ("mask", "name", "hit"),
    [("*.jpg; *.PNG | thumb*", "a.png", True), ("*.jpg; *.PNG | thumb*", "thumb1.jpg", False), ("readme.*", "README", True), ("", "x", True), ("*.*", "noext", True), ("oo", "Foo", True), ("a?c", "abc", True), ("a?c", "ac", False), ("| *.tmp", "x.tmp", False)],
)
def test_mask(spark, mask, name, hit):
    assert value(spark, search.mask(F.col("n"), mask), n=name) is hit


def test_natural_order(spark):
    names = ["img10.png", "img02.png", "IMG2.png", "img1.png", "a.png"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in frame.orderBy(text.natural_key(F.col("n")), "n").collect()] == ["a.png", "img1.png", "IMG2.png", "img02.png", "img10.png"]


@pytest.mark.parametrize(("n", "roman", "letters"), [(0, "0", "0"), (4, "IV", "D"), (26, "XXVI", "Z"), (27, "XXVII", "AA"), (702, "DCCII", "ZZ"), (703, "DCCIII", "AAA"), (3999, "MMMCMXCIX", "EWU"), (4000, "4000", "EWV")])
def test_numerals(spark, n, roman, letters):
    assert value(spark, numbers.roman(F.col("n")), n=n) == roman
    assert value(spark, numbers.letters(F.col("n")), n=n) == letters


@pytest.mark.parametrize(("n", "said"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (255232, "249.2 KB"), (255744, "249.8 KB"), (5 * 1024**4, "5.0 TB")])
def test_human_size(spark, n, said):
    assert value(spark, numbers.human_size(F.col("n")), n=n) == said


def test_grouped(spark):
    assert value(spark, numbers.grouped(F.col("n")), n=1234567) == "1\u2009234\u2009567"
    assert value(spark, numbers.grouped(F.col("n")), n=123) == "123"


@pytest.mark.parametrize(("raw", "colour"), [("#abc", "aabbcc"), ("#A1B2C3", "A1B2C3"), ("rgb(1, 2,255)", "0102FF"), ("rgb(1,2)", None), ("rgb(1,2,256)", None), ("green", "008000"), ("teal", None), (None, None)])
def test_css_colour(spark, raw, colour):
    assert value(spark, numbers.css_colour(F.col("v")), v=raw) == colour


@pytest.mark.parametrize(("raw", "points"), [("12pt", 12.0), ("16px", 12.0), ("2.54cm", 72.0), ("1em", None), ("pt", None)])
def test_css_points(spark, raw, points):
    assert value(spark, numbers.css_points(F.col("v")), v=raw) == (pytest.approx(points) if points is not None else None)


def test_text(spark):
    assert value(spark, text.digit_mask(F.col("t")), t=" Page 12  of 30 ") == "Page # of #"
    assert value(spark, text.collapse_spaces(F.col("t")), t="a \t\n b\u00a0 c") == "a b\u00a0 c"
    assert value(spark, text.cleaned(F.col("t")), t="   a\u00adb  , c  ") == "\tab, c"
    assert value(spark, text.paragraphs(F.col("t")), t="a\tb\n\n \n c") == ["a b", "c"]
    assert value(spark, text.replace_word(F.col("t"), "cat", "$1"), t="cat cats cat_ cat") == "$1 cats $1_ $1"
    assert value(spark, text.percent_decoded(F.col("t")), t="a%20b+c") == "a b+c"
    assert value(spark, text.percent_decoded(F.col("t")), t="%zz") is None
    assert value(spark, text.resolved_path(F.col("t")), t="word/../a/./b.xml") == "/a/b.xml"
    assert value(spark, text.resolved_path(F.col("t")), t="../a") is None
    assert value(spark, text.safe_file_name(F.col("t")), t="con.txt") == "_con.txt"
    assert value(spark, text.safe_file_name(F.col("t")), t=" a:b?. ") == "a_b_"
    assert value(spark, text.xml_escaped(F.col("t")), t="a<b>&\r\x01") == "a&lt;b&gt;&amp;&#13;"
    assert value(spark, text.case_like(F.col("t"), F.lit("wORD")), t="ABC") == "WORD"
    assert value(spark, text.case_like(F.col("t"), F.lit("wORD")), t="Abc") == "Word"
    assert value(spark, text.list_marker(F.col("t")), t="iv.") is True
    assert value(spark, text.list_marker(F.col("t")), t="1234.") is False


def test_numbers(spark):
    assert value(spark, numbers.twips_measure(F.col("t")), t="-25") == "-1.25pt"
    assert value(spark, numbers.twips_measure(F.col("t")), t="20pt") is None
    assert value(spark, numbers.nice_step(F.col("x")), x=0.03) == pytest.approx(0.05)
    assert value(spark, numbers.nice_step(F.col("x")), x=0.0) == 1.0
    scale = value(spark, numbers.nice_scale(F.col("x"), F.lit(97.0)), x=3.0)
    assert (scale.lo, scale.hi, scale.step) == (0.0, 100.0, 20.0)
    assert value(spark, numbers.civil_stamp(F.col("t")), t="2024:02:31 10:20") == "2024-02-31 10:20:00"
    assert value(spark, numbers.civil_stamp(F.col("t")), t="2024:13:01") is None
    assert value(spark, numbers.is_dark(F.col("t")), t="7f7f7f") is True


@pytest.mark.parametrize(("colour", "dark"), [("26b656", False), ("66889b", False), ("fb4d44", False), ("808080", False), ("26b655", True), ("66879b", True), ("000000", True), ("ffffff", False), (None, None)])
def test_dark_at_its_limit(spark, colour, dark):
    assert value(spark, numbers.is_dark(F.col("t")), t=colour) is dark  # the first four are 128 exactly


def test_chains(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("z", "gone")], "id string, parent string")
    got = {r.node: (r.chain, r.cycle) for r in graph.chains(rows).collect()}
    assert got == {"a": (["a", "b", "c"], False), "b": (["b", "c"], False), "c": (["c"], False), "x": (["x", "y"], True), "y": (["y", "x"], True), "z": (["z"], False)}


def test_components_and_reach(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {r.root for r in graph.components(edges).collect()} == {1, 100}
    reach = graph.reachable(edges, spark.createDataFrame([(38,)], "node long"), source="a", target="b")
    assert sorted(map(tuple, reach.collect())) == [(38, 0), (39, 1), (40, 2)]


def test_clusters_follow_the_running_mean(spark):
    rows = spark.createDataFrame([("k", v) for v in (1.0, 1.5, 2.0, 9.0, None)], "k string, v double")
    got = sorted((r.centre, r.n) for r in sequences.mean_clusters(rows, "v", "k", 0.8).collect())
    assert got == [(1.5, 3), (9.0, 1)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "k string, v long, o long")
    assert reports.mode_largest(none, "v", "k").count() == 0
    assert sequences.islands(none, F.col("v") > 1, ["k"], ["o"]).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(ValueError):
        search.capped(spark.range(5), 4)


def test_document_operators(spark):
    from sheaf.functions import spans
    from sheaf.operators import documents

    a, b = "the quick brown fox jumps".split(), "a quick red fox jumps over".split()
    assert documents.aligned(a, b) == [(1, 1), (3, 3), (4, 4)]
    assert documents.aligned([], b) == [] and documents.aligned(a, a) == [(i, i) for i in range(5)]
    assert documents.rising([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    found = value(spark, documents.edits(F.col("w"), "ab"), w="ab")
    assert found[0] == "ba" and "ab" not in found and {"b", "a", "aab", "abb", "bb", "aa"} <= set(found)
    assert value(spark, documents.edits(F.col("w"), "ab"), w="") == ["a", "b"]
    places = value(spark, spans.find(F.col("t"), "[0-9]+"), t="é1 22 333" + " 4" * 500)
    assert [(s.start, s.end) for s in places[:3]] == [(1, 2), (3, 5), (6, 9)] and len(places) == 503 and places[-1].end == 9 + 1000
    words = spark.createDataFrame([("thw",)], "word string")
    known = spark.createDataFrame([("the",), ("thaw",), ("zzz",)], "word string")
    assert [r.suggestion for r in documents.suggestions(words, known).orderBy("place").collect()] == ["the", "thaw"]


def test_diff_of_empty_sides(spark):
    from sheaf.operators import documents

    left = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "k long, o long, t string")
    right = spark.createDataFrame([(1, 0, "x"), (3, 0, "z")], "k long, o long, t string")
    got = sorted(tuple(r) for r in documents.story_diff(left, right, "k", "o", "t").select("k", "change").collect())
    assert got == [(2, "removed"), (3, "added")]
