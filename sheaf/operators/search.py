"""Filters: wildcard masks, word filters, content scans and hits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wildcard_regex(pattern: str) -> str:
    """A whole-name pattern: ``*`` any run, ``?`` one character."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def _one(name: Column, pattern: str) -> Column:
    if pattern in ("*", "*.*"):
        return F.lit(True)
    if not any(c in pattern for c in "*?."):
        return F.contains(name, F.lit(pattern))
    hit = F.regexp_like(name, F.lit(wildcard_regex(pattern)))
    if pattern.endswith(".*"):  # also a name without extension
        hit = hit | (~F.contains(name, F.lit(".")) & F.regexp_like(name, F.lit(wildcard_regex(pattern[:-2]))))
    return hit


def mask(name: Column, text: str) -> Column:
    """``a;b | c``: any of the first masks and none of those behind the bar, without case."""
    include, _, exclude = text.partition("|")
    split = lambda s: [p.strip().lower() for p in s.split(";") if p.strip()]
    lowered, hit = F.lower(name), F.lit(True)
    if wanted := split(include):
        hit = F.lit(False)
        for p in wanted:
            hit = hit | _one(lowered, p)
    for p in split(exclude):
        hit = hit & ~_one(lowered, p)
    return hit


def has_words(name: Column, words: str) -> Column:
    """Every blank-separated word occurs in the lowered name; no words match all."""
    hit = F.lit(True)
    for w in words.lower().split():
        hit = hit & F.contains(F.lower(name), F.lit(w))
    return hit


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def has_content(text: Column, needle: str) -> Column:
    """The needle is folded in full, the text for ASCII alone; an empty needle matches all."""
    return F.contains(ascii_lower(text), F.lit(needle.lower()))


def file_search(files: DataFrame, *, name: str, size: str | None = None, modified: str | None = None, text: str | None = None, masks: str = "", min_size: int | None = None, max_size: int | None = None, since=None, needle: str = "") -> DataFrame:
    """All given predicates; a null size or date fails its own test."""
    hit = mask(F.col(name), masks)
    if min_size is not None:
        hit = hit & (F.col(size) >= min_size)
    if max_size is not None:
        hit = hit & (F.col(size) <= max_size)
    if since is not None:
        hit = hit & (F.col(modified) >= F.lit(since))
    if needle:
        hit = hit & has_content(F.col(text), needle)
    return files.filter(hit)


def occurrences(rows: DataFrame, text: str, needle: str) -> DataFrame:
    """One row per non-overlapping occurrence, numbered from 1."""
    many = F.regexp_count(text, F.lit(re.escape(needle)))
    found = rows.withColumn("_many", many).filter("_many > 0")
    return found.withColumn("hit", F.explode(F.sequence(F.lit(1), F.col("_many")))).drop("_many")


def capped(rows: DataFrame, limit: int) -> DataFrame:
    """``rows``, or an error once more than ``limit`` of them exist."""
    if rows.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} results")
    return rows
