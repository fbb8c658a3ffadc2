"""Tables as cells with spans, and fragments of text on a page's lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOK_BACK = 4  # lines that a fragment may still belong to
SAME_BASELINE, SAME_SIZE = 0.1, 0.2  # of the size
WIDEST_GAP, MARKER_GAP, OVERLAP = 2.5, 0.5, -0.5  # of the size, of the size, in points
LINES = pa.schema([("page", pa.int64()), ("line", pa.int32()), *((c, pa.float64()) for c in ("x", "baseline", "size", "width")), ("text", pa.string())])
_MARKER = re.compile(r"^(?:[•‣▪●◦–*-]|(?:[0-9]{1,3}|[A-Za-z]|[ivxlcdmIVXLCDM]{1,5})[.)])$")


def rows_of_text(rows: DataFrame, *, table: str, order: list[str], cells: str, name: str) -> DataFrame:
    """Each table as one text: cells by ``;``, rows by ``/``."""
    told = F.array_sort(F.collect_list(F.struct(*order, F.array_join(cells, ";").alias("_told"))))
    return rows.groupBy(table).agg(F.array_join(F.transform(told, lambda r: r["_told"]), "/").alias(name))


def merged(cells: DataFrame, rects: DataFrame) -> DataFrame:
    """``cells`` (grid, row, col, height, width, text) with those of each grid's rectangle (grid, top, bottom, left,
    right; ends exclusive) as one; a cell that sticks out or a gap refuses the merge.  Texts join in reading order."""
    both = cells.join(rects, "grid", "left")
    hit = (F.col("row") < F.col("bottom")) & (F.col("top") < F.col("row") + F.col("height")) & (F.col("col") < F.col("right")) & (F.col("left") < F.col("col") + F.col("width"))
    inside = (F.col("row") >= F.col("top")) & (F.col("row") + F.col("height") <= F.col("bottom")) & (F.col("col") >= F.col("left")) & (F.col("col") + F.col("width") <= F.col("right"))
    marked = both.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("inside", inside)
    parts = F.array_sort(F.collect_list(F.struct("row", "col", "text")))
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t != ""), "\n")
    whole = marked.filter("hit").groupBy("grid", "top", "bottom", "left", "right").agg(
        F.bool_and("inside").alias("_in"), F.sum(F.col("height") * F.col("width")).alias("_area"), joined.alias("text"),
    ).filter("_in AND _area = (bottom - top) * (right - left)")
    one = whole.select("grid", F.col("top").alias("row"), F.col("left").alias("col"), F.expr("bottom - top").alias("height"), F.expr("right - left").alias("width"), "text")
    gone = marked.filter("hit").join(whole.select("grid"), "grid", "left_semi").select("grid", "row", "col")
    return cells.join(gone, ["grid", "row", "col"], "left_anti").select("grid", "row", "col", "height", "width", "text").unionByName(one)


def split(cells: DataFrame) -> DataFrame:
    """Every cell with spans as cells of one row and column; the first keeps the text."""
    parts = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("_k"))
    down, along = F.floor(F.col("_k") / F.col("width")).cast("int"), (F.col("_k") % F.col("width")).cast("int")
    text: Column = F.when(F.col("_k") == 0, F.col("text")).otherwise("")
    return parts.select("grid", (F.col("row") + down).alias("row"), (F.col("col") + along).alias("col"), F.lit(1).alias("height"), F.lit(1).alias("width"), text.alias("text"))


def _row_lines(row: list[list]) -> Iterator[tuple]:
    """One row's fragments (x, baseline, size, width, text) as lines, from left to right; the row is the bound of what a task holds."""
    row.sort(key=lambda p: (p[0] != p[0], p[0]))
    begin, parts = None, []
    for x, baseline, size, width, text in row:
        if begin is not None:
            if marker and not text.strip():
                continue
            gap = x - (begin + reach)
            apart = marker and gap >= MARKER_GAP * first
            if not apart and OVERLAP < gap <= WIDEST_GAP * max(first, size):
                parts.append(text if spaced or text.startswith(" ") else " " + text)
                spaced = not parts[-1] or parts[-1].endswith(" ")
                reach, marker = max(x + width - begin, reach), False
                continue
            yield begin, level, first, reach, "".join(parts)
        begin, level, first, reach, parts = x, baseline, size, width, [text]
        spaced, marker = text.endswith(" "), bool(_MARKER.match(text))
    yield begin, level, first, reach, "".join(parts)


def _page_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments ordered by page and place as lines; only the last rows of one page stay open."""
    page, rows, number, out = None, [], 0, []

    def close(row: list[list]) -> None:
        nonlocal number
        for line in _row_lines(row):
            out.append((page, number, *line))
            number += 1

    def told() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * len(LINES)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, LINES, strict=True)], schema=LINES)

    for batch in batches:
        measures = [batch.column(k).to_numpy(zero_copy_only=False).tolist() for k in range(1, 5)]
        for at, *piece in zip(batch.column(0).to_pylist(), *measures, batch.column(5).to_pylist(), strict=True):
            if at != page:
                for row in rows:
                    close(row)
                page, rows, number = at, [], 0
            baseline, size = piece[1], piece[2]
            for row in reversed(rows):
                widest = max(row[0][2], size)
                if abs(row[0][1] - baseline) < SAME_BASELINE * widest and abs(row[0][2] - size) < SAME_SIZE * widest:
                    row.append(piece)
                    break
            else:
                rows.append([piece])
                if len(rows) > LOOK_BACK:
                    close(rows.pop(0))
        yield told()
        out.clear()
    for row in rows:
        close(row)
    yield told()


def joined_fragments(fragments: DataFrame) -> DataFrame:
    """(page, line, x, baseline, size, width, text) of ``fragments`` (page, ord, x, baseline, size, width, text; null text:
    empty): those on one baseline, of one size and not far apart are one line, with a space between; a list's marker stays
    its own.  Fragments of one ``ord`` go by their other columns.  A page passes through one task, which holds its last rows."""
    measures = [F.col(c).cast("double").alias(c) for c in ("x", "baseline", "size", "width")]
    pieces = fragments.select(F.col("page").cast("long").alias("page"), "ord", *measures, F.coalesce("text", F.lit("")).alias("text"))
    placed = pieces.repartition("page").sortWithinPartitions("page", F.asc_nulls_last("ord"), "x", "baseline", "size", "width", "text")
    return placed.drop("ord").mapInArrow(_page_lines, "page long, line int, x double, baseline double, size double, width double, text string")
