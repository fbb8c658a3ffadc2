"""Likeness of images, short lines, caret stops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.operators import fidelity


def test_ssim(spark):
    rng = np.random.RandomState(0)
    a = rng.randint(0, 256, (20, 30)).astype(np.uint8)
    noisy = np.clip(a.astype(int) + rng.randint(-40, 40, a.shape), 0, 255).astype(np.uint8)
    rows = [(1, bytearray(a.tobytes()), bytearray(a.tobytes()), 30), (2, bytearray(a.tobytes()), bytearray(noisy.tobytes()), 30), (3, bytearray(b"12"), bytearray(b"12"), 2), (4, None, None, 2)]
    frame = spark.createDataFrame(rows, "k int, a binary, b binary, w int")
    got = {r.k: r.s for r in frame.select("k", fidelity.ssim("a", "b", "w").alias("s")).collect()}
    assert got[1] == pytest.approx(1.0) and 0.5 < got[2] < 1 and got[3] is None and got[4] is None


def test_short_lines(spark):
    rows = spark.createDataFrame([("p", 1, 80.0, 100.0, 10.0, 30.0), ("p", 2, 40.0, 100.0, 10.0, 20.0), ("p", 3, 99.0, 100.0, 10.0, 20.0)], "page string, n int, e double, r double, s double, w double")
    got = fidelity.short_lines(rows, ["page"], ["n"], end="e", right="r", size="s", first_word="w")
    assert [r.short for r in got.orderBy("n").collect()] == [False, True, False]


def test_nearest_stop(spark):
    stops = spark.createDataFrame([(1, 10.0, 0.0, 0, 0.0), (1, 10.0, 0.0, 1, 8.0), (1, 10.0, 20.0, 2, 20.0), (1, 10.0, 20.0, 3, 30.0), (1, 50.0, 0.0, 4, 0.0)], "page int, line_y double, span_x double, stop int, stop_x double")
    points = spark.createDataFrame([(1, "a", 5.0, 12.0), (1, "b", 26.0, 11.0), (1, "c", 3.0, 60.0), (1, "d", -9.0, 9.0)], "page int, point string, x double, y double")
    got = {r.point: r.stop for r in fidelity.nearest_stop(stops, points, page="page", point="point").collect()}
    assert got == {"a": 1, "b": 3, "c": 4, "d": 0}


def test_luma(spark):
    assert spark.range(1).select(fidelity.luma(F.lit(255), F.lit(0), F.lit(0))).first()[0] == 76
