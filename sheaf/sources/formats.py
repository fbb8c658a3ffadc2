"""File formats as rows, each parsed from bytes under limits in the task that holds them.

Input is a frame with ``path`` and ``content`` (Spark's ``binaryFile`` reader, or parts of packages).
"""

from __future__ import annotations

import io
import itertools
import math
import re
import struct
import tarfile
import tomllib
from collections.abc import Callable, Iterable, Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame

MOST_EVENTS, MOST_DEPTH = 8_000_000, 256
MOST_SERIES, MOST_POINTS = 256, 4096
ROWS = 8192  # a frame, however many rows a file has


def each(files: DataFrame, parse: Callable[[bytes], Iterable[tuple]], columns: dict[str, str]) -> DataFrame:
    """path and the columns of every row that ``parse`` gives for a file."""
    names = ["path", *columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = ((path, content) for batch in batches for path, content in zip(batch["path"], batch["content"], strict=True))
        rows = ((path, *row) for path, content in files for row in parse(content))
        while some := list(itertools.islice(rows, ROWS)):
            yield pd.DataFrame(some, columns=names)

    return files.select("path", "content").mapInPandas(run, ", ".join(f"`{n}` {k}" for n, k in {"path": "string", **columns}.items()))


def xml_events(content: bytes) -> list[tuple]:
    """(ord, depth, kind, name, attrs, text, line, column): starts, ends and text; names as {namespace}local."""
    out: list[tuple] = []
    parser, depth = expat.ParserCreate(namespace_separator="}"), 0
    name_of = lambda n: "{" + n if "}" in n else n

    def put(kind: str, name: str | None, attrs: dict | None, text: str | None) -> None:
        if len(out) >= MOST_EVENTS or depth > MOST_DEPTH:
            raise ValueError("beyond the limits")
        out.append((len(out), depth, kind, name, attrs, text, parser.CurrentLineNumber, parser.CurrentColumnNumber + 1))

    def start(name, attrs):
        nonlocal depth
        depth += 1
        put("start", name_of(name), {name_of(k): v for k, v in attrs.items()}, None)

    def end(name):
        nonlocal depth
        put("end", name_of(name), None, None)
        depth -= 1

    def refuse(*_):
        raise ValueError("a document type is not allowed")

    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda t: put("text", None, None, t)
    parser.StartDoctypeDeclHandler = refuse
    parser.Parse(content, True)
    return out


XML_EVENTS = {"ord": "long", "depth": "int", "kind": "string", "name": "string", "attrs": "map<string,string>", "text": "string", "line": "int", "column": "int"}


def chart_points(content: bytes) -> list[tuple]:
    """(series, name, idx, category, value) of cached chart data; holes have no value."""
    from xml.etree import ElementTree

    local = lambda e: e.tag.rpartition("}")[2]

    def cached(e) -> dict[int, str]:
        found: dict[int, str] = {}
        for p in e.iter():
            if local(p) == "pt" and 0 <= int(p.get("idx", -1)) < MOST_POINTS:
                found.setdefault(int(p.get("idx")), next((v.text or "" for v in p if local(v) == "v"), ""))
        return found

    def number(text: str | None) -> float | None:
        try:
            value = float(text) if text is not None else None
        except ValueError:
            return None
        return value if value is None or abs(value) < float("inf") else None

    out = []
    series = [e for e in ElementTree.fromstring(content).iter() if local(e) == "ser"][:MOST_SERIES]
    for k, s in enumerate(series):
        parts = {local(c): c for c in s}
        name = " ".join(cached(parts["tx"]).values()) if "tx" in parts else None
        names, values = (cached(parts[p]) if p in parts else {} for p in ("cat", "val"))
        for i in range(max([*names, *values, -1]) + 1):
            out.append((k, name, i, names.get(i), number(values.get(i))))
    return out


CHART_POINTS = {"series": "int", "name": "string", "idx": "int", "category": "string", "value": "double"}

#: Destinations of the rich text format that hold no text of the document.
_RTF_SKIPPED = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr generator listtable listoverridetable themedata xmlnstbl".split())
_RTF_TEXT = {"par": "\n", "line": "\n", "tab": "\t", "cell": "\t", "row": "\n", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
_RTF_TOKEN = re.compile(rb"\\([a-z]{1,32})(-?[0-9]{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def rtf_paragraphs(content: bytes) -> list[tuple]:
    """(ord, text) of each paragraph; one byte characters are Windows 1252."""
    if not content.startswith(b"{\\rtf"):
        raise ValueError("not rich text")
    out, skip, unicode_skip, pending = [], [False], [1], 0
    for word, number, byte, mark, brace, plain in _RTF_TOKEN.findall(content):
        if brace == b"{":
            skip.append(skip[-1])
            unicode_skip.append(unicode_skip[-1])
        elif brace == b"}":
            if len(skip) > 1:
                skip.pop()
                unicode_skip.pop()
        elif word:
            name = word.decode()
            if name in _RTF_SKIPPED:
                skip[-1] = True
            elif name == "uc":
                unicode_skip[-1] = int(number or 1)
            elif name == "u" and number and not skip[-1]:
                out.append(chr(int(number) % 65536))
                pending = unicode_skip[-1]
            elif name in _RTF_TEXT and not skip[-1]:
                out.append(_RTF_TEXT[name])
        elif mark == b"*":
            skip[-1] = True
        elif not skip[-1]:
            text = bytes([int(byte, 16)]).decode("cp1252", "replace") if byte else "\u00a0" if mark == b"~" else mark.decode("latin-1") if mark in (b"\\", b"{", b"}") else plain.decode("cp1252", "replace")
            cut = min(pending, len(text))
            pending -= cut
            out.append(text[cut:])
    text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return [(k, p) for k, p in enumerate(x for x in text.split("\n") if x.strip())]


RTF_PARAGRAPHS = {"ord": "long", "text": "string"}


def image_size(content: bytes) -> list[tuple]:
    """(format, width, height) from the header alone; no row for other files."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return [("png", *struct.unpack(">II", content[16:24]))]
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return [("gif", *struct.unpack("<HH", content[6:10]))]
    if content[:2] == b"BM" and len(content) >= 26:
        return [("bmp", *map(abs, struct.unpack("<ii", content[18:26])))]
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content) and content[at] == 0xFF:
            kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", content[at + 5 : at + 9])
                return [("jpeg", width, height)]
            at += 2 + max(size, 2)
    return []


IMAGE_SIZE = {"format": "string", "width": "int", "height": "int"}


#: Tags of the camera's directories, and the sizes of their types.
_TAGS = {"make": 271, "model": 272, "software": 305, "changed": 306, "orientation": 274, "exif": 34665, "gps": 34853, "taken": 36867, "lens": 42036, "iso": 34855, "exposure": 33434, "aperture": 33437, "focal": 37386}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
_TAKEN = re.compile(r"([0-9]{4}):([0-9]{2}):([0-9]{2}) ([0-9]{2}:[0-9]{2}:[0-9]{2})")


def _tiff(content: bytes) -> bytes | None:
    """The directories of a picture: a TIFF file, or what a JPEG or PNG holds of one."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        return content
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(content):
            size = int.from_bytes(content[at : at + 4], "big")
            if content[at + 4 : at + 8] == b"eXIf":
                return content[at + 8 : at + 8 + size]
            at += size + 12
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return content[at + 10 : at + 2 + size]
        at += 2 + max(size, 2)
    return None


def exif(content: bytes) -> list[tuple]:
    """(make, model, lens, taken, exposure, aperture, iso, focal_length, software, orientation, has_gps); no row without
    directories that can be read."""
    data = _tiff(content)
    if data is None or data[:4] not in (b"II*\0", b"MM\0*"):
        return []
    end = "<" if data[:1] == b"I" else ">"

    def directory(at: int) -> dict[int, tuple[int, bytes]] | None:
        if at + 2 > len(data):
            return None
        found = {}
        for k in range(struct.unpack_from(end + "H", data, at)[0]):
            place = at + 2 + 12 * k
            if place + 12 > len(data):
                return None
            tag, kind, count = struct.unpack_from(end + "HHI", data, place)
            size = _SIZES.get(kind, 0) * count
            start = place + 8 if size <= 4 else struct.unpack_from(end + "I", data, place + 8)[0]
            if start + size <= len(data):
                found.setdefault(tag, (kind, data[start : start + size]))
        return found

    def text(entries: dict, name: str) -> str | None:
        kind, raw = entries.get(_TAGS[name], (0, b""))
        return (raw.split(b"\0")[0].decode("utf-8", "replace").strip() or None) if kind == 2 else None

    def number(entries: dict, name: str) -> int | None:
        kind, raw = entries.get(_TAGS[name], (0, b""))
        form = {1: "B", 3: "H", 4: "I"}.get(kind)
        return struct.unpack_from(end + form, raw)[0] if form and len(raw) >= _SIZES[kind] else None

    def ratio(entries: dict, name: str) -> tuple[int, int] | None:
        kind, raw = entries.get(_TAGS[name], (0, b""))
        return struct.unpack_from(end + ("ii" if kind == 10 else "II"), raw) if kind in (5, 10) and len(raw) >= 8 else None

    def short(value: float) -> str:
        return f"{value:.1f}".removesuffix(".0")

    def moment(said: str | None) -> str | None:
        m = _TAKEN.match(said or "")
        return f"{m[1]}-{m[2]}-{m[3]} {m[4]}" if m else None

    main = directory(struct.unpack_from(end + "I", data, 4)[0]) if len(data) >= 8 else None
    if main is None:
        return []
    at = number(main, "exif")
    more = (directory(at) if at is not None else None) or {}
    exposed, opened, focal = (ratio(more, n) for n in ("exposure", "aperture", "focal"))
    seconds = exposed[0] / exposed[1] if exposed and exposed[0] > 0 and exposed[1] > 0 else None
    turned = number(main, "orientation")
    return [(
        text(main, "make"), text(main, "model"), text(more, "lens"), moment(text(more, "taken")) or moment(text(main, "changed")),
        None if seconds is None else f"{short(seconds)} s" if seconds >= 1 else f"1/{short(math.floor(1 / seconds + 0.5))} s",
        f"f/{short(opened[0] / opened[1])}" if opened and opened[1] > 0 else None, number(more, "iso"),
        f"{short(focal[0] / focal[1])} mm" if focal and focal[1] > 0 else None, text(main, "software"),
        turned if turned is not None and 1 <= turned <= 8 else 1, _TAGS["gps"] in main,
    )]


EXIF = {"make": "string", "model": "string", "lens": "string", "taken": "string", "exposure": "string", "aperture": "string", "iso": "long", "focal_length": "string", "software": "string", "orientation": "int", "has_gps": "boolean"}


def tar_members(content: bytes) -> list[tuple]:
    """(name, is_dir, size, modified) of a tape archive, packed or not."""
    with tarfile.open(fileobj=io.BytesIO(content)) as t:
        return [(m.name.rstrip("/"), m.isdir(), m.size, pd.Timestamp(m.mtime, unit="s")) for m in t.getmembers()]


TAR_MEMBERS = {"name": "string", "is_dir": "boolean", "size": "long", "modified": "timestamp"}


def corpus_lock(content: bytes) -> list[tuple]:
    """(id, file, sha256, bytes, url, license, tiers, features) of a lock file of schema 1; an id twice is an error."""
    data = tomllib.loads(content.decode())
    if data.get("schema") != 1:
        raise ValueError(f"schema {data.get('schema')}")
    docs = data.get("doc", [])
    if len({d["id"] for d in docs}) < len(docs):
        raise ValueError("an id occurs twice")
    return [(d["id"], d.get("path"), d.get("sha256"), d.get("bytes"), d.get("url"), d.get("license"), d.get("tiers", []), d.get("features", [])) for d in docs]


CORPUS_LOCK = {"id": "string", "file": "string", "sha256": "string", "bytes": "long", "url": "string", "license": "string", "tiers": "array<string>", "features": "array<string>"}

_TEX = re.compile(r"\\(section|subsection|subsubsection|label|ref|pageref|cite)\*?\{([^{}]*)\}|(?<!\\)%[^\n]*")


def latex_marks(content: bytes) -> list[tuple]:
    """(ord, kind, text) of headings, labels, references and citations, comments left out."""
    found = [m.groups() for m in _TEX.finditer(content.decode("utf-8", "replace")) if m[1]]
    return [(k, kind, text.strip()) for k, (kind, text) in enumerate(found)]


LATEX_MARKS = {"ord": "long", "kind": "string", "text": "string"}
