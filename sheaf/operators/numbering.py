"""Places in a total order without one task that holds everything."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import shared_dir


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place (from 0) in the order: range partitions, written once, then one offset per partition."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sheaf-numbered-{uuid.uuid4().hex}"
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    keyed = spark.read.parquet(path)
    counts = sorted(map(tuple, keyed.groupBy(F.shiftright(name, 33).alias("p")).count().collect()))
    offsets, total = [], 0
    for p, n in counts:
        offsets += [F.lit(p), F.lit(total)]
        total += n
    if not offsets:
        return keyed
    return keyed.withColumn(name, F.try_element_at(F.create_map(*offsets), F.shiftright(name, 33)) + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)))


def numbered_within(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place (from 0) among the rows of its keys; a hot key spans range partitions."""
    placed = numbered(df, [*map(F.col, keys), *order], name)
    first = placed.groupBy(*keys).agg(F.min(name).alias("_least"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = placed.join(first.select(*[F.col(k).alias(f"_{k}") for k in keys], "_least"), same)
    return both.select(*[c for c in placed.columns if c != name], (F.col(name) - F.col("_least")).alias(name))


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str, block: int = 4096) -> DataFrame:
    """``df`` with the sum of ``value`` up to each row of its keys: within blocks of ``block`` rows, and over the blocks' sums."""
    placed = numbered_within(df, keys, order, "_at").withColumn("_block", F.floor(F.col("_at") / block))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    upto = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumn("_own", F.sum(value).over(upto))
    return inner.join(sums, [*keys, "_block"]).withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)


def interned(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with each value's number in the pool of different values, in their order."""
    pool = numbered(df.select(value).filter(F.col(value).isNotNull()).distinct(), [F.col(value)], name)
    return df.join(pool, value, "left")
