"""A training corpus from ``documents``: five stages, each over all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import lines, mixing, neardup, packing, quality
from sheaf.llm.common import scratch, stored
from sheaf.session import table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go.

    A null text is judged as an empty one; ids and sources play no part; repeated rows share their
    fate; without labels of both kinds all stay; an empty table stays empty; other columns pass through.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites show go, but for their first place; ``n_chars`` follows the text.

    Every row stays: null texts stay null, and ``n_chars`` changes only where a line went. A null source
    is a site of its own; repeated rows are cleaned alike; columns named as the operator's own pass through.
    """
    cleaned = lines.dedup(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the least id.

    Null and empty texts are one class; a class without ids keeps one row; of repeated rows one stays;
    rows that stay are unchanged, whatever columns they have.
    """
    return neardup.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until sources meet their target weights.

    Null and empty texts have no words and are left out where their source has none; a null source is a
    source; repeated rows are documents of their own; a row taken twice is there twice, unchanged.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences.

    A null or empty text is the separator alone; a null id stays null; repeated rows, also those that
    the mix repeats, are packed each on their own.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", reject_low_quality),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", keep_one_of_each_class),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # trained fields, sampling and tokens are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; of what they write, only the last's input stays until the session's folder goes."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for place, (name, stage) in enumerate(STAGES[:-1], 1):
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=place == len(STAGES) - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
