"""Ordered rows: islands, runs, numbering, bands and carried values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators import reports


def islands(rows: DataFrame, starts: Column, keys: list[str], order: list[str], name: str = "island") -> DataFrame:
    """Number from 1 of the stretch that each row belongs to; ``starts`` marks first rows (null: no)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    begun = F.when(F.row_number().over(w) == 1, 1).otherwise(F.coalesce(starts, F.lit(False)).cast("int"))
    return rows.withColumn("_starts", begun).withColumn(name, F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def counting_segments(rows: DataFrame, value: str, keys: list[str], order: list[str], name: str = "segment") -> DataFrame:
    """Stretches in which the value goes up by one from row to row."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return islands(rows, before.isNull() | (F.col(value) != before + 1), keys, order, name)


def without_repeated_empty(rows: DataFrame, text: str, keys: list[str], order: list[str]) -> DataFrame:
    """Rows but for empty ones that follow an empty one."""
    empty = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    before = F.lag(empty).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_drop", empty & F.coalesce(before, F.lit(False))).filter(~F.col("_drop")).drop("_drop")


def numbered_first(rows: DataFrame, item: str, keys: list[str], order: list[str], start: int = 1) -> DataFrame:
    """First occurrence of each item, numbered from ``start`` within its section."""
    one = rows.groupBy(*keys, item).agg(F.min(F.struct(*order)).alias("_at"))
    return one.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("_at", item)) + (start - 1)).select(*keys, item, "number")


def banding(rows: DataFrame, keys: list[str], order: list[str], band: int = 1, header: bool = True, footer: bool = True) -> DataFrame:
    """Bit mask: 1 first row, 2 last row, 4 odd band, 8 even band (bands skip first and last rows)."""
    w, whole = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    at, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(whole)
    rows = rows.withColumn("_at", at).withColumn("_n", n)
    first = F.lit(header) & (F.col("_at") == 0)
    last = F.lit(footer) & (F.col("_at") == F.col("_n") - 1) & ~first
    inner = F.floor((F.col("_at") - int(header)) / band) % 2
    mask = F.when(first, 1).when(last, 2).when(inner == 0, 4).otherwise(8)
    return rows.withColumn("bands", mask.cast("long")).drop("_at", "_n")


def section_numbers(rows: DataFrame, is_break: Column, keys: list[str], order: list[str]) -> DataFrame:
    """A break ends its section: sections count the breaks before a row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("section", F.coalesce(F.sum(is_break.cast("int")).over(w), F.lit(0)).cast("long"))


def carried(rows: DataFrame, value: str, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def merged_intervals(rows: DataFrame, start: str, end: str, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """Intervals that touch or overlap as one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = islands(rows.withColumn("_reach", reach), F.col(start) > F.col("_reach") + tolerance, keys, [start, end])
    return grouped.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


def body_pitch(lines: DataFrame) -> DataFrame:
    """(page, pitch) of ``lines`` (page, ord, baseline, size): the least gap between body lines that repeats.

    Body lines are within a twentieth of the page's modal size; baselines within 0.1 of the one before are one;
    gaps under 0.8 of the size are none; gaps fall into buckets of a quarter, neighbours counting together.
    A page where none repeats has 1.2 of its size.
    """
    body = reports.mode_first(lines, "size", "ord", "page").select("page", F.col("mode").alias("body"))
    own = lines.join(body, "page").filter(F.abs(F.col("size") - F.col("body")) <= F.col("body") * 0.05)
    sorted_ = own.groupBy("page").agg(F.array_sort(F.collect_list("baseline")).alias("at"), F.first("body").alias("body"))  # the lines of one page

    def apart(acc: Column, y: Column) -> Column:
        return F.when(F.size(acc) == 0, F.array(y)).when(y - F.element_at(acc, -1) > 0.1, F.concat(acc, F.array(y))).otherwise(acc)

    kept = sorted_.select("page", "body", F.aggregate("at", F.array().cast("array<double>"), apart).alias("at"))
    gaps = kept.select("page", "body", F.explode(F.zip_with(F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", F.lit(1), F.greatest(F.size("at") - 1, F.lit(0))), lambda z, a: z - a)).alias("gap"))
    buckets = gaps.filter(F.col("gap") >= F.col("body") * 0.8).groupBy("page", F.round(F.col("gap") * 4).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("least"))
    after = buckets.select("page", (F.col("bucket") - 1).alias("bucket"), F.col("n").alias("more"))
    good = buckets.join(after, ["page", "bucket"], "left").filter("n + coalesce(more, 0) >= 2").groupBy("page").agg(F.min_by("least", "bucket").alias("pitch"))
    return body.join(good, "page", "left").select("page", F.coalesce("pitch", F.col("body") * 1.2).alias("pitch"))


def coverage(rows: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """(keys, at, depth): the number of open intervals from each place on."""
    opened = rows.select(*keys, F.col(start).alias("at"), F.lit(1).alias("d"))
    closed = rows.select(*keys, F.col(end).alias("at"), F.lit(-1).alias("d"))
    events = opened.unionByName(closed).groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return events.select(*keys, "at", F.sum("d").over(w).alias("depth"))


def mean_clusters(rows: DataFrame, value: str, key: str, tolerance: float) -> DataFrame:
    """Running means of sorted values: one joins the last cluster when at most ``tolerance`` above its mean.

    The mean depends on the order, so each key's values are walked in Python; repeated values are counted
    first, which bounds a key by its distinct values.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        out: list[list[float]] = []
        for v, n in group.sort_values(value)[[value, "n"]].itertuples(index=False):
            if out and v - out[-1][0] <= tolerance:  # then for its repeats too, as the mean only comes nearer
                mean, many = out[-1]
                out[-1] = [(mean * many + v * n) / (many + n), many + n]
            else:
                out.append([float(v), n])
        return pd.DataFrame({key: group[key].iloc[0], "centre": [m for m, _ in out], "n": [int(n) for _, n in out]})

    kind = rows.schema[key].dataType.simpleString()
    return counted.groupBy(key).applyInPandas(walk, f"{key} {kind}, centre double, n long")


def list_counters(rows: DataFrame, doc: str, list_id: str, level: str, order: str, levels: int = 9) -> DataFrame:
    """Label of each list item: its level's counter after those above; a level restarts once a shallower one counts."""

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        counters: dict[object, list[int]] = {}
        labels = []
        for one, depth in zip(group[list_id], group[level], strict=True):
            depth = min(max(int(depth), 0), levels - 1)
            own = counters.setdefault(one, [0] * levels)
            own[depth] += 1
            own[depth + 1 :] = [0] * (levels - depth - 1)
            labels.append(".".join(str(max(1, c)) for c in own[: depth + 1]))
        return group.assign(label=labels)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(doc).applyInPandas(walk, fields + ", label string")
