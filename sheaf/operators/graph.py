"""Parent chains, reachability and components over edge tables.

Chains and closures advance a level at a time by equi joins; each level is written to the
shared checkpoint folder, so that lineage stays short and a lost executor repeats one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import shared_dir

MAX_CHAIN = 64


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def chains(nodes: DataFrame, *, node: str = "id", parent: str = "parent", bound: int = MAX_CHAIN) -> DataFrame:
    """node, chain (itself, then ancestors, nearest first) and cycle.

    A chain stops before the first repeated node; a repeat or ``bound`` members count as a cycle.
    A parent that does not exist ends the chain.
    """
    up = nodes.select(F.col(node).alias("_n"), F.col(parent).alias("_p"))
    open_ = nodes.select(F.col(node).alias("node"), F.array(node).alias("chain"), F.col(parent).alias("next"))
    done = None
    for _ in range(bound):
        known = open_.join(up.select(F.col("_n").alias("next"), F.col("_p").alias("after")), "next", "left_semi")
        ended = open_.join(up.select(F.col("_n").alias("next")), "next", "left_anti").select("node", "chain", F.lit(False).alias("cycle"))
        loop = F.array_contains("chain", F.col("next")) | (F.size("chain") >= bound)
        looped = known.filter(loop).select("node", "chain", F.lit(True).alias("cycle"))
        finished = ended.unionByName(looped)
        done = finished if done is None else done.unionByName(finished)
        open_ = known.filter(~loop).join(up.select(F.col("_n").alias("next"), F.col("_p").alias("after")), "next").select("node", F.concat("chain", F.array("next")).alias("chain"), F.col("after").alias("next"))
        open_ = _cut(open_)
        if open_.isEmpty():
            break
    return done


def reachable(edges: DataFrame, start: DataFrame, *, source: str = "source", target: str = "target", bound: int = 64) -> DataFrame:
    """(node, depth): breadth first from ``start`` (column node), each node at its least depth."""
    step = edges.select(F.col(source).alias("node"), F.col(target).alias("to")).distinct()
    seen = start.select("node", F.lit(0).alias("depth")).distinct()
    front = seen
    for depth in range(1, bound + 1):
        front = front.select("node").join(step, "node").select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth"))
        front = _cut(front)
        if front.isEmpty():
            return seen
        seen = _cut(seen.unionByName(front))
    raise ValueError(f"deeper than {bound}")


def components(edges: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): least node of each component, by least-label rounds with shortcuts."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).distinct()
    label = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")).select(F.col("x").alias("node"), "root")
    label = _cut(label)
    while True:
        near = both.join(label.select(F.col("node").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("seen"))
        new = label.join(near.select(F.col("x").alias("node"), "seen"), "node").select("node", F.least("root", "seen").alias("root"))
        up = new.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = _cut(new.join(up, "root").select("node", "top").withColumnRenamed("top", "root"))
        changed = new.join(label.select("node", F.col("root").alias("was")), "node").filter("root <> was").isEmpty()
        label = new
        if changed:
            return label


def dangling(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose non-null key has no row in ``keys``."""
    return rows.filter(F.col(on).isNotNull()).join(keys.select(on), on, "left_anti")
