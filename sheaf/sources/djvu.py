"""DjVu files as rows: pages and the zones of their text.  Packed chunks (text and outlines) are named, not unpacked."""

from __future__ import annotations

import struct
from collections.abc import Iterator

MOST_ZONES, MOST_DEPTH = 1 << 20, 32
#: Kinds of zones by their number.
KINDS = ("page", "column", "region", "paragraph", "line", "word", "character")
_STACKED = frozenset({1, 4, 5})  # kinds that follow one another down the page


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(id, start, end) of each chunk; an id of eight bytes is a form's."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
        start, stop = at + 8, at + 8 + size
        if stop > end:
            raise ValueError("a chunk beyond its form")
        if name == b"FORM":
            name, start = name + data[start : start + 4], start + 4
        yield name, start, stop
        at = stop + size % 2


def _zones(data: bytes, height: int) -> list[tuple]:
    """(ord, parent, depth, kind, x, top, width, height, text) of a text layer, parents first."""
    size = int.from_bytes(data[:3], "big")
    text, at = data[3 : 3 + size], 3 + size
    if len(text) < size:
        raise ValueError("text breaks off")
    if at == len(data):
        raise ValueError("text has no zones")
    if data[at] != 1:
        raise ValueError("zones of another version")
    out: list[tuple] = []
    at += 1

    def zone(parent: tuple | None, before: tuple | None, owner: int, depth: int) -> tuple:
        nonlocal at
        if depth > MOST_DEPTH or len(out) >= MOST_ZONES:
            raise ValueError("zones beyond the limits")
        if at + 17 > len(data):
            raise ValueError("zones break off")
        kind, x, y, wide, tall, start = struct.unpack(">BHHHHH", data[at : at + 11])
        x, y, wide, tall, start = (v - 0x8000 for v in (x, y, wide, tall, start))
        length, inner = int.from_bytes(data[at + 11 : at + 14], "big"), int.from_bytes(data[at + 14 : at + 17], "big")
        at += 17
        if not 1 <= kind <= len(KINDS):
            raise ValueError(f"a zone of kind {kind}")
        if before is not None:
            if kind in _STACKED:
                x, y = x + before[0], before[1] - (y + tall)
            else:
                x, y = x + before[0] + before[2], y + before[1]
            start += before[4] + before[5]
        elif parent is not None:
            x, y, start = x + parent[0], parent[1] + parent[3] - (y + tall), start + parent[4]
        if wide < 0 or tall < 0 or start < 0 or start + length > size:
            raise ValueError("a zone beyond its text")
        own, raw = len(out), (x, y, wide, tall, start, length)
        out.append((own, owner, depth, KINDS[kind - 1], x, height - y - tall, wide, tall, text[start : start + length].decode("utf-8", "replace").strip("\x0b\x1d\x1f\n ")))
        last = None
        for _ in range(inner):
            last = zone(raw, last, own, depth + 1)
        return raw

    zone(None, None, -1, 0)
    return out


def _pages(data: bytes) -> Iterator[tuple[int, int, int, int, list[tuple[bytes, int, int]]]]:
    if data[:8] != b"AT&TFORM":
        raise ValueError("not a DjVu file")
    name, start, end = next(chunks(data, 4, len(data)))
    forms = [(start, end)] if name == b"FORMDJVU" else [(a, b) for n, a, b in chunks(data, start, end) if n == b"FORMDJVU"]
    for number, (a, b) in enumerate(forms, 1):
        parts = list(chunks(data, a, b))
        info = next((data[s:e] for n, s, e in parts if n == b"INFO"), b"")
        wide, tall = struct.unpack(">HH", info[:4]) if len(info) >= 4 else (0, 0)
        dpi = struct.unpack("<H", info[6:8])[0] if len(info) >= 8 else 300
        yield number, wide, tall, dpi, parts


def page_rows(data: bytes) -> Iterator[tuple]:
    """(page, width, height, dpi, text_chunk, problem) of every page."""
    try:
        for number, wide, tall, dpi, parts in _pages(data):
            yield number, wide, tall, dpi, next((n.decode() for n, _, _ in parts if n in (b"TXTa", b"TXTz")), None), None
    except (ValueError, StopIteration, RuntimeError) as e:
        yield None, None, None, None, None, str(e)


PAGES = {"page": "int", "width": "int", "height": "int", "dpi": "int", "text_chunk": "string", "problem": "string"}


def zone_rows(data: bytes) -> Iterator[tuple]:
    """(page, ord, parent, depth, kind, x, top, width, height, text, problem) of every page's zones, in pixels from the top
    left; a text layer that can't be read is one row."""
    page = None
    try:
        for page, _, tall, _, parts in _pages(data):
            for name, start, end in parts:
                if name not in (b"TXTa", b"TXTz"):
                    continue
                try:
                    if name == b"TXTz":
                        raise ValueError("packed text")
                    rows = [(page, *z, None) for z in _zones(data[start:end], tall)]
                except ValueError as e:
                    rows = [(page, *[None] * 9, str(e))]
                yield from rows
    except (ValueError, StopIteration, RuntimeError) as e:
        yield (page, *[None] * 9, str(e))


ZONES = {"page": "int", "ord": "int", "parent": "int", "depth": "int", "kind": "string", "x": "int", "top": "int", "width": "int", "height": "int", "text": "string", "problem": "string"}
