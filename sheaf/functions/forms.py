"""Forms of text and bytes as column expressions: decoding, dumps, escapes, marks, boundaries and hashes."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Byte order marks and the encodings they announce.
MARKS = {"EFBBBF": "UTF-8", "FFFE": "UTF-16LE", "FEFF": "UTF-16BE"}
SNIFFED = 8192  # bytes that decide whether content is text
HEAD = 4096  # bytes of a page that may declare its charset
#: The offset basis and prime of 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_LOW = 0xFFFFFFFF


def looks_like_text(content: Column) -> Column:
    """A byte order mark, or no NUL among the first bytes."""
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.startswith(content, F.unhex(F.lit(mark)))
    return marked | ~F.contains(F.substring(content, 1, SNIFFED), F.unhex(F.lit("00")))


def _decoded(content: bytes) -> tuple[str, str]:
    for mark, name in MARKS.items():
        start = bytes.fromhex(mark)
        if content.startswith(start):
            return content[len(start) :].decode(name, "replace"), name
    try:
        return codecs.getincrementaldecoder("utf-8")().decode(content), "UTF-8"  # a character cut at the end is left out
    except UnicodeDecodeError:
        return content.decode("cp1251", "surrogateescape").replace("\udc98", "\x98"), "Windows-1251"


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType())]))
def decoded(content: pd.Series) -> pd.DataFrame:
    """Text and its encoding: by byte order mark, else UTF-8 where valid, else Windows-1251; null for null."""
    told = [_decoded(bytes(x)) if x is not None else (None, None) for x in content]
    return pd.DataFrame(told, columns=["text", "encoding"])


def _declared(content: bytes) -> str:
    head = content[:HEAD].decode("latin-1").lower()
    for tag in head.split("<meta")[1:]:
        found = re.search(r"charset\s*=\s*['\"]*([^'\";/ \t\r\n]*)", tag.split(">")[0])
        if found:
            try:
                name = codecs.lookup(found[1]).name
            except LookupError:
                continue
            return "cp1252" if name in ("iso8859-1", "ascii") else name  # as browsers read these labels
    return "utf-8"


def _page_text(content: bytes) -> str | None:
    for mark, name in MARKS.items():
        start = bytes.fromhex(mark)
        if content.startswith(start):
            content, encoding = content[len(start) :], name
            break
    else:
        encoding = _declared(content)
    try:
        return content.decode(encoding)
    except UnicodeDecodeError:
        return None


@F.pandas_udf(StringType())
def page_text(content: pd.Series) -> pd.Series:
    """A page's text by its byte order mark, else the charset its head declares, else UTF-8; null where bytes don't fit."""
    return pd.Series([_page_text(bytes(x)) if x is not None else None for x in content], dtype="object")


def hex_lines(content: Column) -> Column:
    """Lines of a dump: offset, sixteen bytes, and what of them prints."""

    def line(row: Column) -> Column:
        chunk = F.substring(content, row * 16 + 1, F.lit(16))
        pairs = F.regexp_replace(F.hex(chunk), "(..)", "$1 ")
        shown = F.regexp_replace(F.decode(chunk, "ISO-8859-1"), "(?s)[^\\x20-\\x7e]", ".")
        return F.concat(
            F.lpad(F.hex(row * 16), 8, "0"), F.lit("  "), F.rpad(F.substring(pairs, 1, 24), 24, " "), F.lit(" "),
            F.rpad(F.substring(pairs, F.lit(25), F.lit(24)), 24, " "), F.lit(" "), shown,
        )

    rows = F.ceil(F.length(content) / 16).cast("int")
    return F.when(rows == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), rows - 1), line))


def markdown_table(text: Column) -> Column:
    """The rows of cells of a table of pipes, rules left out; null unless two rows or more, one with two cells or more."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cells = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)))
    rows = F.filter(cells, lambda r: ~F.forall(r, lambda c: F.regexp_like(c, F.lit("^[-: ]+$"))))
    good = (F.size(lines) >= 2) & F.forall(lines, lambda x: F.startswith(x, F.lit("|"))) & (F.size(rows) >= 2) & F.exists(rows, lambda r: F.size(r) >= 2)
    return F.when(good, rows)


def terminal_safe(text: Column) -> Column:
    """Control characters other than newline and tab as ``\\u{hex}``."""
    control = r"[\x00-\x08\x0b-\x1f\x7f-\x{9f}]"

    def one(c: Column) -> Column:
        return F.when(F.regexp_like(c, F.lit(control)), F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))).otherwise(c)

    return F.when(F.regexp_like(text, F.lit(control)), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def emphasis(text: Column) -> Column:
    """Runs of (text, bold, italic): ``**`` turns bold on and off, ``*`` italic."""
    run = "array<struct<text:string,bold:boolean,italic:boolean>>"
    start = F.struct(F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.array().cast(run).alias("runs"))

    def step(acc: Column, part: Column) -> Column:
        own = F.array(F.struct(part.alias("text"), acc["bold"].alias("bold"), acc["italic"].alias("italic")))
        return F.struct(
            (acc["bold"] != (part == "**")).alias("bold"), (acc["italic"] != (part == "*")).alias("italic"),
            F.when(part.isin("*", "**"), acc["runs"]).otherwise(F.concat(acc["runs"], own)).alias("runs"),
        )

    return F.aggregate(F.regexp_extract_all(text, F.lit(r"\*\*|\*|[^*]+"), F.lit(0)), start, step, lambda acc: acc["runs"])


def join_places(answer: Column, start: Column, end: Column) -> Column:
    """The paragraph boundaries that a model's answer names, within ``start`` to ``end``; null for anything but a list of numbers."""
    plain = F.regexp_replace(answer, r"^\s*(?:```(?:json)?)?\s*|\s*(?:```)*\s*$", "")
    listed = F.when(F.regexp_like(plain, F.lit(r"^\[\s*(?:[0-9]+\s*(?:,\s*[0-9]+\s*)*)?\]$")), F.from_json(plain, "array<bigint>"))
    return F.filter(listed, lambda i: (i >= start) & (i + 1 < end))


def base64_text(content: Column) -> Column:
    """Base64 on one line."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def scalar_of_utf16(text: Column, offset: Column) -> Column:
    """The place in code points of a place in UTF-16 units; null beyond the text or between the halves of a pair."""
    units = F.encode(text, "UTF-16BE")
    inside = F.hex(F.substring(units, 2 * offset + 1, F.lit(2))).between("DC00", "DFFF")
    good = (offset >= 0) & (2 * offset <= F.length(units)) & ~inside
    return F.when(good, F.length(F.decode(F.substring(units, F.lit(1), 2 * offset), "UTF-16BE")))


def utf16_of_scalar(text: Column, offset: Column) -> Column:
    """The place in UTF-16 units of a place in code points; null beyond the text."""
    return F.when((offset >= 0) & (offset <= F.length(text)), F.floor(F.length(F.encode(F.substring(text, F.lit(1), offset), "UTF-16BE")) / 2).cast("int"))


def next_boundary(text: Column, offset: Column) -> Column:
    """The end of the grapheme cluster that begins at ``offset``."""
    return offset + F.length(F.regexp_extract(F.substring(text, offset + 1, F.length(text)), r"^\X", 0))


def fnv1a(content: Column) -> Column:
    """64-bit FNV-1a as a hexadecimal number, in two 32-bit halves, as sums of longs may not overflow."""
    start = F.struct(F.lit(FNV_BASIS >> 32).alias("high"), F.lit(FNV_BASIS & _LOW).alias("low"))
    small, shift = FNV_PRIME & _LOW, 8  # the prime is 2^40 and a small rest

    def step(acc: Column, pair: Column) -> Column:
        low = acc["low"].bitwiseXOR(F.conv(pair, 16, 10).cast("long"))
        product = low * small
        high = (acc["high"] * small + F.shiftright(product, 32) + F.shiftleft(low, shift)).bitwiseAND(F.lit(_LOW))
        return F.struct(high.alias("high"), product.bitwiseAND(F.lit(_LOW)).alias("low"))

    pairs = F.regexp_extract_all(F.hex(content), F.lit(".."), F.lit(0))
    return F.aggregate(pairs, start, step, lambda acc: F.lower(F.concat(F.lpad(F.hex(acc["high"]), 8, "0"), F.lpad(F.hex(acc["low"]), 8, "0"))))


def merged_sides(target: Column, layer: Column) -> Column:
    """Borders by side: the layer's where it has one."""
    return F.map_zip_with(target, layer, lambda side, old, new: F.coalesce(new, old))


def feature_id(namespace: Column, local: Column) -> Column:
    return F.when(namespace == "", local).otherwise(F.concat(F.lit("w:"), local))
