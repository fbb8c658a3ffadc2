"""Line dedup by distinct-site spread (operator 4).

A line's key is the MD5 of its text without surrounding blanks (spaces, tabs, carriage returns).  One aggregation per key merges
HyperLogLog sketches of the sites (sources) that show it.  Keys whose estimate is clearly over
``min_sites`` are boilerplate; those near it get an exact distinct count.  The first place of a
boilerplate line (least doc_id, then line) keeps it; every other place loses it.

Texts are read twice: for the narrow table of lines, which is written out, and for the
rewriting, where each document meets the list of its own lines to drop (one text shuffle).
Sketches merge before the shuffle, so a line that a third of all documents share is one row
per task; the joins on hot keys can be split.

Defined cases: a null text has no lines and stays null; a null source is the unnamed site, as
an empty one is; lines under ``min_chars`` characters stay; repeated rows (same doc_id and text)
are cleaned alike; an empty table gives no rows; columns that clash with ours are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import free_names, scratch, stored, text_or_empty

MIN_SITES = 5
MIN_CHARS = 12
BLANKS = " \t\r\x0b\x0c"
SKETCH_K = 8  # log2 of the sketch's buckets: a standard error of 6.5 %
BAND = 0.25  # relative distance from the threshold within which counts are made exact


def _text_key(text: str) -> Column:
    return F.xxhash64(text_or_empty(text))


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc, text_key, site, at, key: the lines that may count as boilerplate."""
    rows = docs.select(
        F.col(id_col).alias("doc"), _text_key(text_col).alias("text_key"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("at", "line"),
    )
    trimmed = rows.withColumn("line", F.trim("line", F.lit(BLANKS)))
    return trimmed.filter(F.length("line") >= min_chars).select("doc", "text_key", "site", "at", F.unhex(F.md5("line")).alias("key"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """key, first_doc, first_at of each line on at least ``min_sites`` sites."""
    spread = lines.groupBy("key").agg(
        F.count(F.lit(1)).alias("places"),
        F.hll_sketch_agg("site", F.lit(SKETCH_K)).alias("sketch"),
        F.min(F.struct(F.col("doc").isNotNull().alias("known"), "doc", "at")).alias("first"),
    )
    estimate = F.hll_sketch_estimate("sketch")
    spread = spread.filter(F.col("places") >= min_sites).select("key", estimate.alias("sites"), "first").filter(F.col("sites") >= min_sites * (1 - band))
    spread = stored(spread, "spread")
    near = spread.filter(F.col("sites") <= min_sites * (1 + band))
    sites = lines.select("key", "site").distinct()  # a hot line is one row per site before it meets the keys
    exact = sites.join(near.select("key"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("exact"))
    sure = spread.filter(F.col("sites") > min_sites * (1 + band))
    kept = near.join(exact.filter(F.col("exact") >= min_sites).select("key"), "key", "left_semi")
    return sure.unionByName(kept).select("key", F.col("first.doc").alias("first_doc"), F.col("first.at").alias("first_at"))


def dedup(docs: DataFrame, *, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines out of the text, and n_lines and n_removed."""
    doc_, key_, drop_ = free_names(docs, "_doc", "_key", "_drop")
    with scratch(docs.sparkSession):
        lines = stored(line_table(docs, min_chars, id_col=id_col, text_col=text_col, source_col=source_col), "lines")
        bad = stored(boilerplate(lines, min_sites), "boilerplate")
        first = F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("at") == F.col("first_at"))
        out = lines.join(bad, "key").filter(~first).groupBy("doc", "text_key").agg(F.collect_set("at").alias("drop"))
        out = out.select(F.col("doc").alias(doc_), F.col("text_key").alias(key_), F.col("drop").alias(drop_))
        out = stored(out, "dropped", keep=True)
    meets = F.col(id_col).eqNullSafe(F.col(doc_)) & (_text_key(text_col) == F.col(key_))
    both = docs.join(out.hint("shuffle_hash"), meets, "left")
    parts = F.split(F.col(text_col).cast("string"), "\n")
    drop = F.coalesce(drop_, F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), drop)
    text = F.when(F.size(drop) == 0, F.col(text_col).cast("string")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    return both.select(
        *others, text.alias(text_col),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.size(drop).cast("long").alias("n_removed"),
    )
