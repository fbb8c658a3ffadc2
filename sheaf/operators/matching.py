"""Comparing two sides: full outer differences, multisets, baselines and unique matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import text


def changed_ids(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key and change: added, removed or changed; equal rows (nulls equal nulls) are left out."""
    a = left.select(key, F.col(value).alias("_a"), F.lit(1).alias("_in_a"))
    b = right.select(key, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def bag(rows: DataFrame, doc: str, token: str, name: str) -> DataFrame:
    return rows.groupBy(doc, token).agg(F.count(F.lit(1)).alias(name))


def bag_scores(ref: DataFrame, got: DataFrame, doc: str, token: str) -> DataFrame:
    """Multiset precision, recall and F1 per document; both empty sides agree, one empty side scores 0."""
    both = bag(ref, doc, token, "r").join(bag(got, doc, token, "g"), [doc, token], "full_outer").fillna(0, ["r", "g"])
    sums = both.groupBy(doc).agg(F.sum(F.least("r", "g")).alias("shared"), F.sum("r").alias("n_ref"), F.sum("g").alias("n_got"))
    ratio = lambda of: F.when(F.col(of) > 0, F.col("shared") / F.col(of)).when(F.col("n_ref") + F.col("n_got") == 0, 1.0).otherwise(0.0)
    return sums.withColumn("precision", ratio("n_got")).withColumn("recall", ratio("n_ref")).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    )


def deltas(head: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """Every key of either side with head, base and their difference to one decimal."""
    a, b = head.select(key, F.col(value).alias("head")), base.select(key, F.col(value).alias("base"))
    return a.join(b, key, "full_outer").withColumn("delta", F.round(F.col("head") - F.col("base"), 1))


def restored(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, found) of each different ``word`` that is not in ``lexicon`` (form in lower case, frequency) but has the skeleton
    of exactly one form, or of one that is more frequent than the others; ``dj`` may stand for one letter."""
    lower = F.lower("word")
    plain = F.regexp_like(lower, F.lit("[cszdčć]")) & (F.length("word") >= 2)
    known = lexicon.select(F.col("form").alias("lower"))
    open_ = words.select("word").distinct().filter(plain).withColumn("lower", lower).join(known, "lower", "left_anti")
    keys = F.array(text.skeleton(F.col("lower")), F.when(F.contains("lower", F.lit("dj")), text.skeleton(F.replace("lower", F.lit("dj"), F.lit("đ")))))
    asked = open_.select("word", "lower", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))
    forms = lexicon.select("form", "frequency", text.skeleton(F.col("form")).alias("key"))
    found = asked.join(forms, "key").filter("form <> lower").select("word", "form", "frequency").distinct()
    best = found.groupBy("word").agg(F.max("frequency").alias("frequency"))
    top = found.join(best, ["word", "frequency"]).groupBy("word").agg(F.count(F.lit(1)).alias("many"), F.min("form").alias("form")).filter("many = 1")
    return top.select("word", text.case_like(F.col("word"), F.col("form")).alias("found"))


def restored_text(rows: DataFrame, key: str, body: str, lexicon: DataFrame) -> DataFrame:
    """(key, body, fixed) with every word of letters that ``restored`` can repair repaired, and how many were."""
    parts = rows.select(key, F.posexplode(F.regexp_extract_all(body, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))).alias("at", "word"))
    fixes = restored(parts.filter(F.regexp_like("word", F.lit(r"^\p{L}"))), lexicon)
    said = parts.join(fixes, "word", "left").groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("found", "word").alias("said")))), lambda p: p["said"]), "").alias(body),
        F.count("found").alias("fixed"),
    )
    return rows.select(key).join(said, key, "left").select(key, F.coalesce(body, F.lit("")).alias(body), F.coalesce("fixed", F.lit(0).cast("long")).alias("fixed"))


def unique_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose both members occur in one pair only."""
    alone = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c)) == 1
    return pairs.withColumn("_ok", alone(a) & alone(b)).filter("_ok").drop("_ok")


def first_status(*checks: tuple[Column, str]) -> Column:
    """The first check that fails names the status; else ok."""
    out = F.lit("ok")
    for missing, name in reversed(checks):
        out = F.when(missing, name).otherwise(out)
    return out
