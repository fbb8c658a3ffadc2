"""The queries that SQL can't express, on small fixtures with known answers or against a plain walk."""

import itertools

import pytest
from pyspark.sql import functions as F

from sheaf.functions import forms
from sheaf.operators import documents, grids, matching, numbering, reports, sequences
from sheaf.sources import html

PAGE = """<html><body><h1>One <b>bold</b> title</h1><p>Text &amp; more</p><h3>Deeper</h3><script>no()</script>
<table><tr><td>a<td colspan=2>b c</tr><tr><th>d<td>e<td><table><tr><td>inner</table></table></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, PAGE), (2, "plain"), (3, "")], "page_id long, html string")


def test_html_outline(pages):
    got = sorted((r.page, r.level, r.title) for r in html.outline(pages).collect())
    assert got == [(1, 1, "One bold title"), (1, 3, "Deeper")]


def test_html_grid(pages):
    got = sorted((r.table, r.row, r.column, r.colspan, r.text) for r in html.grids(pages).collect())
    assert [g for g in got if g[0] == 0 and g[4] != "inner"][:4] == [(0, 0, 0, 1, "a"), (0, 0, 1, 2, "b c"), (0, 1, 0, 1, "d"), (0, 1, 1, 1, "e")]
    assert any(g[4] == "inner" for g in got)


def test_html_text_and_elements(pages):
    said = {r.page_id: r.text for r in html.text(pages).collect()}
    assert "Text & more" in said[1] and "no()" not in said[1] and said[2].strip() == "plain" and said[3].strip() == ""
    counts = {r.name: r["count"] for r in html.nodes(pages).groupBy("name").count().collect()}
    assert counts["table"] == 2 and counts["h1"] == counts["h3"] == 1 and counts["b"] == 1


def test_tolerance_cluster_matches_a_walk(spark, sf_dir):
    rows = [(k % 3, v) for k, v in enumerate([1.0, 1.0, 1.0, 1.4, 1.8, 5.0, 5.1, 5.1, 9.0, 2.0, 2.1, None])]
    got = {(r.k, round(r.centre, 9), r.n) for r in sequences.mean_clusters(spark.createDataFrame(rows, "k int, v double"), "v", "k", 0.5).collect()}
    want = set()
    for k, group in itertools.groupby(sorted((r for r in rows if r[1] is not None)), key=lambda r: r[0]):
        clusters = []
        for _, v in group:
            if clusters and v - sum(clusters[-1]) / len(clusters[-1]) <= 0.5:
                clusters[-1].append(v)
            else:
                clusters.append([v])
        want |= {(k, round(sum(c) / len(c), 9), len(c)) for c in clusters}
    assert got == want


def test_list_counters(spark):
    rows = [(1, 0, 0, 7), (1, 1, 1, 7), (1, 2, 1, 7), (1, 3, 0, 7), (1, 4, 1, 7), (1, 5, 0, 8), (2, 0, 2, 7)]
    got = sequences.list_counters(spark.createDataFrame(rows, "d int, o int, level int, l int"), "d", "l", "level", "o")
    assert [r.label for r in got.orderBy("d", "o").collect()] == ["1", "1.1", "1.2", "2", "2.1", "1", "1.1.1"]


def test_suggestions_are_one_edit_away(spark):
    frame = lambda rows: spark.createDataFrame(rows, "word string, n long")
    got = documents.suggestions(frame([("wrod", 1), ("zzzz", 1)]), frame([("word", 9), ("wood", 3), ("rod", 5)])).collect()
    assert {r.word for r in got} == {"wrod"}
    assert "word" in str(got[0]) and "wood" not in str(got[0])


def test_story_diff_keeps_common_turns(spark):
    left = [(1, k, t) for k, t in enumerate("abcdef")]
    right = [(1, k, t) for k, t in enumerate("abxdfg")]
    schema = "c long, t long, text string"
    got = documents.story_diff(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "c", "t", "text").collect()
    assert {(r.before, r.after, r.change) for r in got} == {(2, None, "removed"), (4, None, "removed"), (None, 2, "added"), (None, 5, "added")}


def test_box_clusters_grow_to_a_fixed_point(spark):
    boxes = [(1, 0, 0, 10, 10), (1, 25, 0, 35, 10), (1, 50, 0, 60, 10), (1, 200, 0, 210, 10), (2, 0, 0, 1, 1)]
    got = documents.grown_clusters(spark.createDataFrame(boxes, "page long, x0 long, y0 long, x1 long, y1 long"), "page", 20.0).collect()
    assert sorted((r.page, r.x0, r.x1) for r in got) == [(1, 0, 60), (1, 200, 210), (2, 0, 1)]


def test_fragments_join_on_a_baseline(spark):
    rows = [
        (1, 0, 0.0, 100.0, 10.0, 20.0, "One"), (1, 1, 23.0, 100.5, 10.0, 20.0, "line"), (1, 2, 100.0, 100.0, 10.0, 9.0, "tab"),
        (1, 3, 0.0, 88.0, 10.0, 5.0, "1."), (1, 4, 11.0, 88.0, 10.0, 5.0, " "), (1, 5, 18.0, 88.0, 10.0, 30.0, "item"), (1, 6, 46.0, 100.0, 10.0, 9.0, "late "), (1, 7, 56.0, 100.0, 10.0, 9.0, "word"),
        (2, 0, 0.0, 0.0, 8.0, 4.0, "big"), (2, 1, 5.0, 0.0, 12.0, 4.0, "other size"),
    ]
    got = grids.joined_fragments(spark.createDataFrame(rows, "page long, ord int, x double, baseline double, size double, width double, text string"))
    said = [(r.page, r.line, r.text) for r in got.orderBy("page", "line").collect()]
    assert said == [(1, 0, "One line late word"), (1, 1, "tab"), (1, 2, "1."), (1, 3, "item"), (2, 0, "big"), (2, 1, "other size")]


def test_fragments_of_many_pages_join_whatever_order_they_come_in(spark):
    schema = "page long, ord int, x double, baseline double, size double, width double, text string"
    rows = [(1, 0, 30.0, 5.0, 10.0, 9.0, "c"), (1, 0, 0.0, 90.0, 10.0, 9.0, "z"), (1, 0, 10.0, 5.0, 10.0, 9.0, "a"), (1, 0, 20.0, 5.0, 10.0, 9.0, "b "), (2, 0, 0.0, 5.0, 10.0, 9.0, "x"), (2, 1, 11.0, 5.0, 10.0, 9.0, None)]
    rows += [(3, k, 0.0, 40.0 * k, 10.0, 9.0, str(k)) for k in range(5)] + [(3, 5, 20.0, 40.0, 10.0, 9.0, "near"), (3, 6, 20.0, 0.0, 10.0, 9.0, "far"), (None, 0, 0.0, 0.0, 10.0, 9.0, "no page")]
    want = [(None, 0, "no page"), (1, 0, "z"), (1, 1, "a b c"), (2, 0, "x "), (3, 0, "0"), (3, 1, "1 near"), *((3, k, str(k)) for k in (2, 3, 4)), (3, 5, "far")]
    for some in (rows, rows[::-1]):
        got = grids.joined_fragments(spark.createDataFrame(some, schema).coalesce(1))
        assert [(r.page, r.line, r.text) for r in got.orderBy("page", "line").collect()] == want
    many = spark.range(60000).selectExpr("id div 2 AS page", "CAST(id % 2 AS int) AS ord", "id % 2 * 11D AS x", "0D AS baseline", "10D AS size", "9D AS width", "CAST(id AS string) AS text")
    got = grids.joined_fragments(many)
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()  # a call for each page takes 2 ms
    assert got.filter("line = 0 AND text = concat(page * 2, ' ', page * 2 + 1)").count() == got.count() == 30000


def test_restored_words(spark):
    lexicon = spark.createDataFrame([("čaša", 5), ("časa", 5), ("šuma", 9), ("žuma", 1), ("đak", 2), ("sat", 7)], "form string, frequency long")
    words = spark.createDataFrame([(w,) for w in ("casa", "Suma", "SUMA", "djak", "sat", "x", "Sata", "S1UMA")], "word string")
    assert {r.word: r.found for r in matching.restored(words, lexicon).collect()} == {"Suma": "Šuma", "SUMA": "ŠUMA", "djak": "đak"}


def test_places_and_sums_of_hot_keys(spark):
    rows = spark.createDataFrame([("hot" if k % 10 else None, k, k % 7) for k in range(500)], "key string, id long, v long")
    placed = {(r.key, r.id): r.at for r in numbering.numbered_within(rows, ["key"], [F.desc("id")], "at").collect()}
    sums = {r.id: r.total for r in numbering.running_sum(rows.filter("key is not null"), ["key"], [F.col("id")], "v", "total", block=16).collect()}
    total = 0
    for key in ("hot", None):
        ids = sorted((k for k in range(500) if (k % 10 != 0) == (key == "hot")), reverse=True)
        assert [placed[key, k] for k in ids] == list(range(len(ids)))
    for k in range(500):
        if k % 10:
            total += k % 7
            assert sums[k] == total
    assert reports.upper_median(rows, "id", "key").filter("key = 'hot'").first().median == [k for k in range(500) if k % 10][225]


def test_first_message_skips_rows_without_one(spark):
    rows = spark.createDataFrame([("f", 1, 0, None, "p"), ("f", 2, 3, "second", "q"), ("f", 3, 1, "third", "p")], "f string, o long, r int, m string, l string")
    got = reports.feature_report(rows, feature="f", rank="r", ord_="o", message="m", location="l").first()
    assert (got["message"], got.worst, got["count"], got.locations) == ("second", 3, 3, "p,q")


def test_decoding(spark):
    rows = [(0, "plain é".encode()), (1, "cut é".encode()[:-1]), (2, b"\xcf\xf0\x98"), (3, b"\xff\xfea\x00"), (4, None), (5, b"")]
    got = {r.i: tuple(r.d) for r in spark.createDataFrame(rows, "i int, b binary").select("i", forms.decoded("b").alias("d")).collect() if r.d}
    assert got[0] == ("plain é", "UTF-8") and got[1] == ("cut ", "UTF-8") and got[2] == ("Пр\x98", "Windows-1251") and got[3] == ("a", "UTF-16LE") and got[5] == ("", "UTF-8")
