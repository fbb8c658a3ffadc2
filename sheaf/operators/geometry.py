"""Boxes and segments: bucketed overlap and crossing joins.

Boxes go to grid cells of their page, meet in a cell, and are compared exactly; a pair counts
in the cell that holds the larger of both left and top edges, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cells(boxes: DataFrame, cell: float) -> DataFrame:
    span = lambda a, z: F.sequence(F.floor(F.col(a) / cell).cast("long"), F.floor(F.col(z) / cell).cast("long"))
    return boxes.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))


def overlap_area(a: str, b: str) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")))
    return side("x0", "x1") * side("y0", "y1")


def area(box: str) -> Column:
    return (F.col(f"{box}.x1") - F.col(f"{box}.x0")) * (F.col(f"{box}.y1") - F.col(f"{box}.y0"))


def overlapping(boxes: DataFrame, *, page: str, box: str, cell: float) -> DataFrame:
    """Pairs (a < b) of boxes (page, box, x0, y0, x1, y1) of one page that share some area, and the smaller box's area."""
    cells = _cells(boxes, cell)
    a, b = cells.alias("a"), cells.alias("b")
    same = (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy")) & (F.col(f"a.{box}") < F.col(f"b.{box}"))
    own = (F.floor(F.greatest("a.x0", "b.x0") / cell) == F.col("a._cx")) & (F.floor(F.greatest("a.y0", "b.y0") / cell) == F.col("a._cy"))
    met = a.join(b, same).filter(own).select(F.col(f"a.{page}").alias(page), F.col(f"a.{box}").alias("a"), F.col(f"b.{box}").alias("b"), overlap_area("a", "b").alias("area"), F.least(area("a"), area("b")).alias("smaller"))
    return met.filter("area > 0")


def crossing(horizontal: DataFrame, vertical: DataFrame, *, page: str, cell: float, tolerance: float = 0.0) -> DataFrame:
    """Pairs of a horizontal (h, y, x0, x1) and a vertical (v, x, y0, y1) that meet within the tolerance."""
    strips = F.sequence(F.floor((F.col("x0") - tolerance) / cell).cast("long"), F.floor((F.col("x1") + tolerance) / cell).cast("long"))
    h = horizontal.withColumn("_strip", F.explode(strips))
    v = vertical.withColumn("_strip", F.floor(F.col("x") / cell).cast("long")).withColumnsRenamed({"y0": "vy0", "y1": "vy1"})
    met = h.join(v, [page, "_strip"])
    return met.filter(
        F.col("x").between(F.col("x0") - tolerance, F.col("x1") + tolerance) & F.col("y").between(F.col("vy0") - tolerance, F.col("vy1") + tolerance)
    ).select(page, "h", "v")


def covered_share(boxes: DataFrame, zones: DataFrame, *, page: str, box: str, cell: float) -> DataFrame:
    """page, box, share: a box's overlap with the zones of its page over its area, at most 1; an empty box is covered.

    Zones that overlap one another count twice.
    """
    size = F.greatest(F.col("x1") - F.col("x0"), F.lit(0)) * F.greatest(F.col("y1") - F.col("y0"), F.lit(0))
    sized = boxes.select(page, box, "x0", "y0", "x1", "y1", size.alias("_size"))
    a, b = _cells(sized.filter("_size > 0"), cell).alias("a"), _cells(zones, cell).alias("b")
    same = (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy"))
    own = (F.floor(F.greatest("a.x0", "b.x0") / cell) == F.col("a._cx")) & (F.floor(F.greatest("a.y0", "b.y0") / cell) == F.col("a._cy"))
    met = a.join(b, same).filter(own).select(F.col(f"a.{page}").alias(page), F.col(f"a.{box}").alias(box), overlap_area("a", "b").alias("_area"))
    sums = met.groupBy(page, box).agg(F.sum("_area").alias("_area"))
    share = F.when(F.col("_size") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("_area", F.lit(0.0)) / F.col("_size")))
    return sized.join(sums, [page, box], "left").select(page, box, share.alias("share"))


def reading_order(lines: DataFrame, *, page: str, line: str, top: str, column: str, spanning: Column) -> DataFrame:
    """page, line, place: a spanning line ends a band; in a band the left column comes before the right."""
    down = Window.partitionBy(page).orderBy(top, line).rowsBetween(Window.unboundedPreceding, 0)
    banded = lines.withColumn("_spans", spanning).withColumn("_band", F.sum(F.col("_spans").cast("int")).over(down))
    order = Window.partitionBy(page).orderBy("_band", F.col("_spans").desc(), column, top, line)
    return banded.withColumn("place", F.row_number().over(order)).select(page, line, "place")
