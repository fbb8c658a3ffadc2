"""Sources and streams on files made here."""

import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheaf.sources import html, packages
from sheaf.streaming import reports

PAGE = "<html><head><title>T</title><style>p{}</style></head><body><h1>One <b>two</b></h1><p>a<p>b<br>c<ul><li>x<li>y</ul><script>no()</script><a href='/z'>z</a><table><tr><td colspan=2>1<td>2<tr><td>3<table><tr><td>in</table></table></body></html>"


def pages(spark):
    return spark.createDataFrame([(1, PAGE), (2, ""), (3, None)], "page_id long, html string")


def test_html_text(spark):
    got = {r.page_id: r.text for r in html.text(pages(spark)).collect()}
    assert got[1].split("\n")[:6] == ["One two", "a", "b", "c", "x", "y"]
    assert got[2] == got[3] == "" and "no()" not in got[1]


def test_html_projections(spark):
    assert [tuple(r) for r in html.links(pages(spark)).select("page", "href").collect()] == [(1, "/z")]
    assert [tuple(r) for r in html.outline(pages(spark)).select("level", "title").collect()] == [(1, "One two")]
    cells = sorted(tuple(r)[1:] for r in html.grids(pages(spark)).collect())
    assert cells == [(0, 0, 0, 2, "1"), (0, 0, 2, 1, "2"), (0, 1, 0, 1, "3"), (1, 0, 0, 1, "in")]


def test_implied_ends(spark):
    names = [(n[2], n[1]) for n in html.parse("<ul><li>a<li>b</ul>")]
    assert names == [("ul", -1), ("li", 0), ("#text", 1), ("li", 0), ("#text", 3)]


DOCUMENT = """<w:document xmlns:w="http://purl.oclc.org/ooxml/wordprocessingml/main"><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>
<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r></w:p></w:body></w:document>"""
RELS = """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
<Relationship Id="r1" Type="t" Target="styles.xml"/><Relationship Id="r2" Type="t" Target="http://x" TargetMode="External"/></Relationships>"""


@pytest.fixture
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", DOCUMENT)
        z.writestr("word/_rels/document.xml.rels", RELS)
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7")
    return str(tmp_path)


def test_packages(spark, folder):
    found = packages.parts(spark, folder, "*.docx").cache()
    assert sorted(r.part for r in found.collect()) == ["/word/_rels/document.xml.rels", "/word/document.xml"]
    assert [(r.ord, r.style, r.text) for r in packages.paragraphs(found).orderBy("ord").collect()] == [(0, "Heading1", "Title"), (1, None, "a\tb\n")]
    rels = {r.rel_id: (r.source, r.external) for r in packages.relationships(found).collect()}
    assert rels == {"r1": ("/word/document.xml", False), "r2": ("/word/document.xml", True)}
    again = packages.packed(found, "path").first()
    with zipfile.ZipFile(io.BytesIO(again.content)) as z:
        assert z.read("word/document.xml").decode() == DOCUMENT


def test_listing_and_formats(spark, folder):
    assert sorted(r.name for r in packages.listing(spark, folder).collect()) == ["a.docx", "b.pdf"]
    files = spark.read.format("binaryFile").load(folder)
    assert sorted(r[0] for r in files.select(packages.sniffed(F.col("content"))).collect()) == ["pdf", "zip"]
    odd = spark.createDataFrame([(b"", "x.TXT"), (b"<?xml version='1.0'?><svg/>", "y")], "content binary, name string")
    assert sorted(r[0] for r in odd.select(packages.sniffed(F.col("content"), F.col("name"))).collect()) == ["svg", "txt"]


def test_streams_drain_what_is_there(spark, tmp_path):
    at = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"ts": [at, at, at + pd.Timedelta("3 days")], "k": ["a", "a", "b"], "v": [1.0, 2.0, 3.0]})
    rows.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "in.parquet")
    like = spark.read.parquet(str(tmp_path / "in.parquet"))
    stream = lambda: reports.arriving(spark, f"{tmp_path}/in.parquet*", like)
    closed = reports.drained(reports.report(stream(), ts="ts", key="k", value="v"), f"file://{tmp_path}/state")
    assert [(r.k, r.n, r.most) for r in closed.collect()] == [("a", 2, 2.0)]
    once = reports.drained(reports.dedupe(stream(), ts="ts", keys=["k"]).select("k"), f"file://{tmp_path}/state2")
    assert sorted(r.k for r in once.collect()) == ["a", "b"]


def test_changed_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, body string")
    seen = rows.filter("id < 3").withColumn("digest", F.sha2(F.when(F.col("id") == 2, "old").otherwise(F.col("body")), 256))
    assert sorted(r.id for r in reports.changed(rows, seen, "id", "body").collect()) == [2, 3]


def rows_of(spark, content, parse, columns):
    from sheaf.sources import formats

    files = spark.createDataFrame([("f", bytearray(content))], "path string, content binary")
    return [tuple(r)[1:] for r in formats.each(files, parse, columns).collect()]


def test_xml_events(spark):
    from sheaf.sources import formats as f

    got = rows_of(spark, b'<a xmlns="u" k="1">x<b/>\n</a>', f.xml_events, f.XML_EVENTS)
    assert [(r[2], r[3], r[1]) for r in got] == [("start", "{u}a", 1), ("text", None, 1), ("start", "{u}b", 2), ("end", "{u}b", 2), ("text", None, 1), ("end", "{u}a", 1)]
    assert got[0][4] == {"k": "1"} and got[-1][6] == 2
    with pytest.raises(Exception, match="document type"):
        f.xml_events(b"<!DOCTYPE a><a/>")


def test_chart_points(spark):
    from sheaf.sources import formats as f

    xml = b"<c><ser><tx><pt idx='0'><v>S</v></pt></tx><cat><pt idx='0'><v>a</v></pt><pt idx='2'><v>c</v></pt></cat><val><pt idx='0'><v>1.5</v></pt><pt idx='1'><v>x</v></pt></val></ser></c>"
    assert rows_of(spark, xml, f.chart_points, f.CHART_POINTS) == [(0, "S", 0, "a", 1.5), (0, "S", 1, None, None), (0, "S", 2, "c", None)]


def test_rtf(spark):
    from sheaf.sources import formats as f

    rtf = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}Caf\'e9\tab a\{b\}\par {\b bold} \u8364?5\par}"
    assert rows_of(spark, rtf, f.rtf_paragraphs, f.RTF_PARAGRAPHS) == [(0, "Caf\u00e9\ta{b}"), (1, "bold \u20ac5")]
    with pytest.raises(ValueError):
        f.rtf_paragraphs(b"plain")


def test_headers_and_archives(spark):
    import struct
    import tarfile

    from sheaf.sources import formats as f

    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 7, 9)
    assert rows_of(spark, png, f.image_size, f.IMAGE_SIZE) == [("png", 7, 9)]
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 5, 6) + b"\0" * 9
    assert rows_of(spark, jpeg, f.image_size, f.IMAGE_SIZE) == [("jpeg", 6, 5)]
    assert f.image_size(b"") == []
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo("d/x.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    assert [r[:3] for r in rows_of(spark, out.getvalue(), f.tar_members, f.TAR_MEMBERS)] == [("d/x.txt", False, 3)]


def test_lock_and_marks(spark):
    from sheaf.sources import formats as f

    lock = b'schema = 1\n[[doc]]\nid = "a"\npath = "a.docx"\nbytes = 5\ntiers = ["t1"]\n'
    assert rows_of(spark, lock, f.corpus_lock, f.CORPUS_LOCK) == [("a", "a.docx", None, 5, None, None, ["t1"], [])]
    with pytest.raises(ValueError):
        f.corpus_lock(b"schema = 2")
    tex = rb"\section{One} % \label{no}" + b"\n" + rb"\label{s:1} see \ref{s:1}"
    assert rows_of(spark, tex, f.latex_marks, f.LATEX_MARKS) == [(0, "section", "One"), (1, "label", "s:1"), (2, "ref", "s:1")]


def test_sinks(spark, tmp_path):
    from sheaf.sources import sinks

    rels = spark.createDataFrame([("p", "r2", "t", 'a"b', True), ("p", "r1", "t", "x&y", False)], "part string, rel_id string, type string, target string, external boolean")
    xml = sinks.relationship_parts(rels, "part").first().xml
    files = spark.createDataFrame([("f", "/_rels/.rels", bytearray(xml.encode()))], "path string, part string, content binary")
    assert sorted((r.rel_id, r.target, r.external) for r in packages.relationships(files).collect()) == [("r1", "x&y", False), ("r2", 'a"b', True)]
    report = spark.createDataFrame([("b", "partial", 2, None), ("a", "supported", 1, "m")], "feature string, status string, n int, message string")
    assert [r.value for r in sinks.report_json(report, "feature").collect()][1] == '{"feature":"b","status":"partial","n":2,"message":null}'
    assert [r.value.split() for r in sinks.report_text(report, "feature", "status", "n", "message").collect()] == [["a", "supported", "1", "m"], ["b", "partial", "2"]]
    assert '"output_bytes":1' in sinks.sidecars(spark.createDataFrame([("f", "a", "b")], "path string, x string, y string"), "x", "y").first().sidecar
    sinks.qa_tables(report, f"file://{tmp_path}/qa", "feature")
    assert spark.read.json(f"file://{tmp_path}/qa/results.json").count() == 2
