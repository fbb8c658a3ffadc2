"""MathML, reactions, DjVu and camera data made here."""

import struct

import pytest

from sheaf.sources import djvu, formats, notations

MATHML = """x <math xmlns="http://www.w3.org/1998/Math/MathML"><mrow><mi> a </mi><mo>=</mo><mo>(</mo><mfrac><mn>1</mn><mrow><mi>b</mi><mo>&#x2062;</mo><msup><mi>c</mi><mn>2</mn></msup></mrow></mfrac><mo>)</mo>
<msqrt><mi>d</mi><mi>e</mi></msqrt><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr></mtable></mrow></math> y"""


def test_math():
    got = [r[1:5] for r in notations.math_nodes(MATHML)]
    assert got == [
        (-1, "root", "identifier", "a"), (-1, "root", "operator", "="), (-1, "root", "delimiter", "()"), (2, "element", "fraction", None),
        (3, "numerator", "number", "1"), (3, "denominator", "identifier", "b"), (3, "denominator", "operator", ""), (3, "denominator", "superscript", None),
        (7, "base", "identifier", "c"), (7, "upper", "number", "2"), (-1, "root", "radical", None), (10, "base", "identifier", "d"), (10, "base", "identifier", "e"),
        (-1, "root", "matrix", None), (13, "0,0", "number", "1"), (13, "0,1", "number", "2"),
    ]
    assert [r[5] for r in notations.math_nodes("none")] == ["no formula"] and next(notations.math_nodes("<math><mi></math>"))[5]


def test_atoms():
    assert notations.atoms("Ca(OH)2") == {"Ca": 1, "O": 2, "H": 2} and notations.atoms("CuSO_4*5H2O") == {"Cu": 1, "S": 1, "O": 9, "H": 10}
    for wrong in ("(H", "H)", "h2", "Na?"):
        with pytest.raises(ValueError):
            notations.atoms(wrong)


def test_reactions(spark):
    got = list(notations.reaction(r"\ce{ 2H2 + 1/2 O2(g) ->[heat][Pt] 2H2O(l) + CO2 ^ }"))
    assert [(r[0], r[2], r[3], r[5], r[6]) for r in got] == [("reactant", "2", "H2", None, None), ("reactant", "1/2", "O2", "g", None), ("product", "2", "H2O", "l", None), ("product", "1", "CO2", None, "gas")]
    assert got[0][8:11] == ("right", "heat", "Pt")
    ions = list(notations.reaction("Ag+ + SO4^{2-} <=> AgSO4- + Ca^2+"))
    assert [(r[3], r[4], r[8]) for r in ions] == [("Ag", 1, "equilibrium"), ("SO4", -2, "equilibrium"), ("AgSO4", -1, "equilibrium"), ("Ca", 2, "equilibrium")]
    files = spark.createDataFrame([("a", b"-> B"), ("b", b"A ->"), ("c", b"A B"), ("d", b"H2 -> H + H")], "path string, content binary")
    rows = formats.each(files, lambda c: notations.reaction(c.decode()), notations.REACTION).collect()
    assert {r.path: r.problem for r in rows if r.problem} == {"a": "no reactant", "b": "no product", "c": "no arrow"} and sum(r.path == "d" for r in rows) == 3


def zone(kind, x, y, w, h, start, length, *inner):
    head = struct.pack(">BHHHHH", kind, *(v + 0x8000 for v in (x, y, w, h, start))) + length.to_bytes(3, "big") + len(inner).to_bytes(3, "big")
    return head + b"".join(inner)


def chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack(">I", len(data)) + data + b"\0" * (len(data) % 2)


TEXT = "Hé you\nnext\n".encode()
ZONES = zone(1, 0, 0, 1000, 2000, 0, len(TEXT), zone(5, 100, 50, 300, 40, 0, 8, zone(6, 0, 0, 100, 40, 0, 3), zone(6, 20, 0, 80, 40, 1, 3)), zone(5, 0, 10, 200, 40, 0, 5))


def page(name: bytes = b"TXTa", layer: bytes = len(TEXT).to_bytes(3, "big") + TEXT + b"\1" + ZONES) -> bytes:
    return b"DJVU" + chunk(b"INFO", struct.pack(">HH", 1000, 2000) + b"\x18\0" + struct.pack("<H", 200) + b"\x16\1") + chunk(name, layer)


def test_djvu(spark):
    book = b"AT&T" + chunk(b"FORM", b"DJVM" + chunk(b"FORM", page()) + chunk(b"FORM", page(b"TXTz")) + chunk(b"FORM", page(layer=b"\0\0\1a")))
    got = list(djvu.zone_rows(book))
    assert [(r[0], r[2], r[4], r[5], r[6], r[9]) for r in got if not r[10]] == [
        (1, -1, "page", 0, 0, "Hé you\nnext"), (1, 0, "line", 100, 50, "Hé you"), (1, 1, "word", 100, 50, "Hé"), (1, 1, "word", 220, 50, "you"), (1, 0, "line", 100, 100, "next"),
    ]
    assert [(r[0], r[10]) for r in got if r[10]] == [(2, "packed text"), (3, "text has no zones")]
    files = spark.createDataFrame([("a", book), ("b", b"AT&T" + chunk(b"FORM", page())), ("c", b"no"), ("d", book[:60])], "path string, content binary")
    rows = formats.each(files, djvu.page_rows, djvu.PAGES).collect()
    assert sorted((r.path, r.page, r.width, r.height, r.dpi) for r in rows if r.page) == [("a", 1, 1000, 2000, 200), ("a", 2, 1000, 2000, 200), ("a", 3, 1000, 2000, 200), ("b", 1, 1000, 2000, 200)]
    assert {r.path for r in rows if r.problem} == {"c", "d"}


def directory(entries: list[tuple[int, int, bytes]], at: int, end: str) -> bytes:
    """A directory that starts ``at``, its long values behind it."""
    rows, tail = b"", b""
    for tag, kind, raw in entries:
        count = len(raw) // {2: 1, 3: 2, 4: 4, 5: 8}[kind]
        place = at + 6 + 12 * len(entries) + len(tail)
        rows += struct.pack(end + "HHI", tag, kind, count) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(end + "I", place))
        tail += raw if len(raw) > 4 else b""
    return struct.pack(end + "H", len(entries)) + rows + b"\0\0\0\0" + tail


@pytest.mark.parametrize("end", "<>")
def test_exif(spark, end):
    two = lambda a, b: struct.pack(end + "II", a, b)
    more = directory([(33434, 5, two(1, 125)), (33437, 5, two(28, 10)), (34855, 3, struct.pack(end + "H", 400)), (36867, 2, b"2024:05:06 07:08:09\0"), (37386, 5, two(35, 1)), (42036, 2, b"Lens 35\0")], 400, end)
    main = directory([(271, 2, b"Canon\0"), (272, 2, b"Canon R5\0"), (274, 3, struct.pack(end + "H", 6)), (306, 2, b"2025:01:01 00:00:00\0"), (34665, 4, struct.pack(end + "I", 400)), (34853, 4, b"\0\0\0\0")], 8, end)
    data = ((b"II*\0" if end == "<" else b"MM\0*") + struct.pack(end + "I", 8) + main).ljust(400, b"\0") + more
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + struct.pack(">H", len(data) + 8) + b"Exif\0\0" + data + b"\xff\xda"
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\1IHDRxCRC!" + struct.pack(">I", len(data)) + b"eXIf" + data + b"CRC!"
    want = ("Canon", "Canon R5", "Lens 35", "2024-05-06 07:08:09", "1/125 s", "f/2.8", 400, "35 mm", None, 6, True)
    assert formats.exif(data) == formats.exif(jpeg) == formats.exif(png) == [want]
    files = spark.createDataFrame([("a", jpeg), ("b", b"\xff\xd8\xff\xda"), ("c", data[:30]), ("d", b"")], "path string, content binary")
    assert [tuple(r) for r in formats.each(files, formats.exif, formats.EXIF).collect()] == [("a", *want)]
