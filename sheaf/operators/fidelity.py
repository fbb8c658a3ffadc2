"""Image likeness and page geometry that compare two renderings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, SIGMA = 11, 1.5
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def _blurred(image: np.ndarray) -> np.ndarray:
    at = np.arange(SIDE) - SIDE // 2
    kernel = np.exp(-(at**2) / (2 * SIGMA**2))
    kernel /= kernel.sum()
    rows = np.apply_along_axis(np.convolve, 1, image, kernel, "valid")
    return np.apply_along_axis(np.convolve, 0, rows, kernel, "valid")


def structural_similarity(a: np.ndarray, b: np.ndarray) -> float | None:
    """Mean similarity over Gaussian windows of 11 by 11; none where the images differ in size or are smaller."""
    if a.shape != b.shape or min(a.shape, default=0) < SIDE:
        return None
    a, b = a.astype(float), b.astype(float)
    ma, mb = _blurred(a), _blurred(b)
    va, vb, both = _blurred(a * a) - ma * ma, _blurred(b * b) - mb * mb, _blurred(a * b) - ma * mb
    return float((((2 * ma * mb + C1) * (2 * both + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))).mean())


@F.pandas_udf(T.DoubleType())
def ssim(a: pd.Series, b: pd.Series, width: pd.Series) -> pd.Series:
    """Similarity of two gray images, each one byte a pixel, row by row."""

    def one(x, y, w):
        if x is None or y is None or not w or len(x) % w or len(x) != len(y):
            return None
        return structural_similarity(np.frombuffer(x, np.uint8).reshape(-1, int(w)), np.frombuffer(y, np.uint8).reshape(-1, int(w)))

    return pd.Series([one(*row) for row in zip(a, b, width, strict=True)], dtype="float64")


def short_lines(lines: DataFrame, keys: list[str], order: list[str], *, end: str, right: str, size: str, first_word: str) -> DataFrame:
    """``short``: whether the next line's first word would still have fitted on this one."""
    after = F.lead(first_word).over(Window.partitionBy(*keys).orderBy(*order))
    return lines.withColumn("short", F.coalesce(F.col(right) - F.col(end) > after + 1.5 * F.col(size), F.lit(False)))


def nearest_stop(stops: DataFrame, points: DataFrame, *, page: str, point: str) -> DataFrame:
    """page, point, stop: on the vertically nearest line (ties within 0.01), the last span that starts at or left of
    x + 0.5 (the first span, if none does), then its nearest stop.  stops: page, line_y, span_x, stop, stop_x; points: page, point, x, y."""
    both = points.join(stops, page)
    away = F.abs(F.col("line_y") - F.col("y"))
    own = Window.partitionBy(page, point)
    near = both.withColumn("_away", away).withColumn("_least", F.min("_away").over(own)).filter(F.col("_away") <= F.col("_least") + 0.01)
    left = F.max(F.when(F.col("span_x") <= F.col("x") + 0.5, F.col("span_x"))).over(own)
    spans = near.withColumn("_span", F.coalesce(left, F.min("span_x").over(own))).filter("span_x = _span")
    best = F.min(F.struct(F.abs(F.col("stop_x") - F.col("x")).alias("d"), "stop")).alias("b")
    return spans.groupBy(page, point).agg(best).select(page, point, F.col("b.stop").alias("stop"))


def luma(red: Column, green: Column, blue: Column) -> Column:
    return F.round(0.299 * red + 0.587 * green + 0.114 * blue).cast("int")
