"""Mixing sources to target weights by the cube method (operator 3).

A document's size is its number of words.  Sources, by code point with null last, weigh
``WEIGHTS`` in turn and share all words; a source's target stops at ``MOST`` times its size and
the excess is shared again by weight, which ends at ``min(MOST * size, level * weight)`` for one
level.  A source's documents are each taken ``floor(target / size)`` times, and once more with
the remaining fraction as inclusion probability.

Flight: within a bucket of a source (hashed, about ``BUCKET`` documents), three documents at a
time move along the null space of the constraints (number and words of those taken) until one
is settled, so both totals stay as expected.  At most two documents of a bucket stay open; the
open ones of ``FAN`` buckets meet in the next level's bucket, and so on.  Landing: a source's
last two are settled so that its words come nearest to the target.

A long document stays open to the end and is then taken or left as a whole, so a landing can miss
by its size.  Each source that misses by more than ``NEAR`` of its target therefore flies
again: documents that could change sides, none longer than a ``FINER``-th of what is missing, do so
with the chance that makes up for it, again with words and number balanced.  A flight leaves at most
two open documents, so the miss shrinks by about ``FINER`` each time, until it is near enough or no
document is that short.  This is the same for every source at every size; a hot source merely has more
buckets.  All draws come from a hash of the bucket, so reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own; a source without
words has target 0 and none of its documents is taken; repeated rows are documents of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import random
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import free_names, scratch, stored, text_or_empty

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKET = 4096
FAN = 512
NEAR = 5e-4  # share of its target by which a source's words may miss
FINER = 4
SEED = 20240131
WORD = r"[^\x20\x09-\x0D]+"


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place (from 0) in the order: range partitions, then offsets, one per partition."""
    keyed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "numbered")
    counts = sorted(map(tuple, keyed.groupBy(F.shiftright(name, 33).alias("p")).count().collect()))
    offsets, total = [], 0
    for p, n in counts:
        offsets += [F.lit(p), F.lit(total)]
        total += n
    if not offsets:
        return keyed
    return keyed.withColumn(name, F.try_element_at(F.create_map(*offsets), F.shiftright(name, 33)) + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)))


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: tuple[Column, ...] = ()) -> DataFrame:
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *extra)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: number, source, source_size, documents, target, ratio, buckets."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    sources = numbered(sources, [F.col("source").asc_nulls_last()], "number")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("most", most * F.col("source_size"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        over = F.lit(level) * F.col("weight") > F.col("most")
        at_most, weights_left, n = sources.agg(F.sum(F.when(over, F.col("most")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if n == capped or not weights_left:
            break
        level, capped = (total - at_most) / weights_left, n
    target = F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight"))
    return sources.select(
        "number", "source", "source_size", "documents", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("ratio"),
        F.ceil(F.col("documents") / BUCKET).cast("long").alias("buckets"),
    )


def flight(sizes: list[float], chances: list[float], draw: random.Random) -> list[float]:
    """Chances moved to 0 or 1 with both totals kept; at most two stay between."""
    out, active = list(chances), []
    for k, chance in enumerate(chances):
        if 1e-9 < chance < 1 - 1e-9:
            active.append(k)
        else:
            out[k] = float(round(chance))
        while len(active) == 3:
            a, b, c = (sizes[i] for i in active)
            way = (b - c, c - a, a - b)
            if not any(way):
                way = (1.0, -1.0, 0.0)
            up = min(((1 - out[i]) / w if w > 0 else out[i] / -w) for i, w in zip(active, way, strict=True) if w)
            down = min((out[i] / w if w > 0 else (1 - out[i]) / -w) for i, w in zip(active, way, strict=True) if w)
            step = up if draw.random() * (up + down) < down else -down
            for i, w in zip(active, way, strict=True):
                out[i] = min(1.0, max(0.0, out[i] + step * w))
            for i in [i for i in active if not 1e-9 < out[i] < 1 - 1e-9]:
                out[i] = float(round(out[i]))
                active.remove(i)
    return out


def landing(sizes: list[float], chances: list[float]) -> list[float]:
    """The open ones settled so that words, then documents, come nearest to what is expected."""
    still = [k for k, c in enumerate(chances) if 0 < c < 1]
    words, many = sum(sizes[k] * chances[k] for k in still), sum(chances[k] for k in still)
    best = min(product((0.0, 1.0), repeat=len(still)), key=lambda xs: (abs(sum(sizes[k] * x for k, x in zip(still, xs, strict=True)) - words), abs(sum(xs) - many), xs))
    out = list(chances)
    for k, x in zip(still, best, strict=True):
        out[k] = x
    return out


def _settled(rows: DataFrame, last: bool) -> DataFrame:
    """One level: each bucket by itself, and at the last level each source's landing."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        return _settle(group, last)

    return rows.groupBy("number", "bucket").applyInPandas(one, rows.schema)


def _settle(rows: pd.DataFrame, last: bool) -> pd.DataFrame:
    rows = rows.sort_values([c for c in rows.columns if c not in ("bucket", "chance")], na_position="first", kind="stable").reset_index(drop=True)
    draw = random.Random(hash((SEED, int(rows["number"].iloc[0]), int(rows["bucket"].iloc[0]))))
    sizes = rows["size"].astype(float).tolist()
    chances = flight(sizes, rows["chance"].tolist(), draw)
    rows["chance"] = landing(sizes, chances) if last else chances
    return rows


def flown(rows: DataFrame, widest: int, label: str) -> DataFrame:
    """``rows`` (number, bucket, size, chance, other columns) with every chance settled at 0 or 1; ``widest``: the most buckets of a source."""
    out = None
    while True:
        rows = stored(_settled(rows, widest == 1), label)
        is_open = (F.col("chance") > 0) & (F.col("chance") < 1)
        done = rows if widest == 1 else rows.filter(~is_open)
        out = done if out is None else out.unionByName(done)
        if widest == 1:
            return out
        widest = math.ceil(widest / FAN)
        rows = rows.filter(is_open).withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))


def made_up(taken: DataFrame, aims: DataFrame, widest: int) -> DataFrame:
    """``taken`` (number, bucket, size, fraction, side, other columns) with sides changed until each source's words are near its target."""
    before = None
    while True:
        missing = taken.groupBy("number").agg(F.sum(F.col("size") * (F.col("fraction") - F.col("side"))).alias("missing"))
        far = missing.join(aims.select("number", "target"), "number").filter(F.abs("missing") > F.greatest(F.lit(1.0), NEAR * F.col("target")))
        can = taken.join(stored(far.select("number", "missing"), "far"), "number").filter(
            (F.col("fraction") > 1e-9) & (F.col("fraction") < 1 - 1e-9) & (F.col("size") > 0)
            & (F.col("side") == F.when(F.col("missing") > 0, 0).otherwise(1)) & (F.col("size") * FINER <= F.abs("missing"))
        )
        share = can.groupBy("number").agg(F.max(F.abs("missing")).alias("far"), F.sum("size").alias("room")).select("number", "far", F.least(F.lit(1.0), F.col("far") / F.col("room")).alias("chance"))
        share = stored(share, "missing")
        worst = share.agg(F.sum("far")).first()[0]
        if worst is None or (before is not None and worst >= before):
            return taken
        before = worst
        movers = can.drop("missing").join(share.select("number", "chance"), "number")
        moved = flown(movers, widest, "moved").filter("chance > 0").select(F.col("key").alias("_key"), F.lit(1).alias("_moved"))
        both = taken.join(moved, taken["key"] == F.col("_key"), "left")
        taken = stored(both.select(*[c for c in taken.columns if c != "side"], F.when(F.col("_moved") == 1, 1 - F.col("side")).otherwise(F.col("side")).alias("side")), "taken")


def mix(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, then source, copies and the other columns of ``sizes`` (doc_id, source, size, ...)."""
    with scratch(sizes.sparkSession):
        sizes = stored(sizes, "sizes")
        extra = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
        aims = stored(targets(sizes, weights, most), "targets")
        widest = aims.agg(F.max("buckets")).first()[0] or 1
        rows = sizes.join(aims.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
            "number", "doc_id", "size", *extra,
            F.floor("ratio").cast("long").alias("whole"),
            (F.col("ratio") - F.floor("ratio")).alias("fraction"),
            F.pmod(F.xxhash64("doc_id", "size", *extra), F.col("buckets")).alias("bucket"),
            (F.col("ratio") - F.floor("ratio")).alias("chance"),
        )
        settled = flown(rows, widest, "flight")
        settled = stored(settled.select("number", "bucket", "doc_id", "size", *extra, "whole", "fraction", F.col("chance").cast("int").alias("side"), F.monotonically_increasing_id().alias("key")), "settled")
        out = made_up(settled, aims, widest)
        copies = F.col("whole") + F.col("side")
        told = out.join(aims, "number").select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies.alias("copies"), *extra)
        return stored(told, "mixed", keep=True)


def mixed_documents(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; other columns unchanged.

    Rows of one id and text share what the mix takes of them as evenly as whole copies allow.
    """
    id_, text_, copies, alike, nth, own, copy = free_names(docs, "_id", "_text", "_copies", "_alike", "_nth", "_own", "_copy")
    known = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(id_)
    key = F.xxhash64(text_or_empty(text_col)).alias(text_)
    same = [id_, text_]
    taken = mix(sized(docs, text_col=text_col, extra=(key, known))).groupBy(*same).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(alike)).filter(F.col(copies) > 0)
    rows = docs.select("*", known, key).join(taken, same)
    place = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
    share = F.floor(F.col(copies) / F.col(alike)) + (F.col(nth) <= F.col(copies) % F.col(alike)).cast("int")
    rows = rows.withColumn(nth, place).withColumn(own, share.cast("int")).filter(F.col(own) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(own)))).select(*docs.columns)
