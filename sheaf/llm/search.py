"""Exact top-k search by three-phase uniform threshold (operator 6).

Vectors are integers, floor(1024 * x).  A score is a sum over ``LISTS`` lists, the inner products
of as many groups of components; each task holds all lists of its rows.

1. For a block of queries, each task takes every list's best entries, resolves the sums of
   these rows alone and reports the best few of each query.  The k-th best report is a safe cutoff:
   the true k-th best score is no lower.
2. The cutoff goes to all tasks.  A row can reach it only if one of its list scores is at least
   cutoff / LISTS; the rows of such entries are collected, list by list.
3. Only for these are the lists summed; those that reach the cutoff, at most k of a task and
   query, meet in a final ranking.

Queries are written out once, in blocks of at most ``QUERY_BYTES``; a block is read by the driver, sent
to the tasks as a broadcast of that size at most, and costs two passes over the table.  Within a task
``QUERY_ROWS`` queries meet ``ROW_BLOCK`` rows at a time.  Candidates are never shuffled.  Block
results are written to the shared folder, so a lost executor repeats one block at most.

Products are formed in doubles where ``max|q| * max|r| * n < 2**53``, which keeps every partial sum
exact, and in Python integers elsewhere.

Defined cases: vectors that are null or hold null or non-finite components, and rows without
vec_id, take no part; a vector meets only those of its own number of components; equal scores rank by smaller
vec_id; a repeated row is a candidate of its own, and a repeated query id is one query (with the
least of its vectors); where fewer than k candidates exist, all are returned; an empty table gives
no rows; other columns are ignored.  Scores beyond 64 bits stop at its limits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import checkpoint_dir, gone_after, scratch, stored

K = 10
LISTS = 4
SCALE = 1024
QUERY_EVERY = 100
QUERY_BYTES = 16 << 20  # of a block's components, as doubles
QUERY_ROWS = 1024
ROW_BLOCK = 2048
EXACT = 2.0**53
LEAST, MOST = -(1 << 63), (1 << 63) - 1
RESULT = "query_id long, rank int, vec_id long, score long"


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles: as doubles, which hold them exactly, or as Python integers where one is beyond doubles."""
    with np.errstate(over="ignore"):
        whole = np.floor(SCALE * x.astype(np.float64))  # exact, as SCALE is a power of two
    if np.isfinite(whole).all():
        return whole
    return np.array([[int(SCALE) * int(v) if abs(v) > 2.0**900 else int(np.floor(SCALE * v)) for v in row] for row in x.tolist()], dtype=object)


def vectors(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, components) of usable rows, by number of components."""
    usable = np.asarray(ids.is_valid()) & np.asarray(lists.is_valid())
    lists = lists.cast(pa.large_list(pa.float64()))
    offsets = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    values = lists.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null reads as NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    usable &= bad[offsets[1:]] == bad[offsets[:-1]]
    many = np.diff(offsets)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(many[usable]):
        here = np.flatnonzero(usable & (many == n))
        for at in range(0, len(here), ROW_BLOCK):
            part = here[at : at + ROW_BLOCK]
            yield number[part], flat[offsets[part][:, None] + np.arange(n)]


def _python_integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def exact_together(q: np.ndarray, r: np.ndarray) -> bool:
    """Whether doubles hold every partial sum of the products of ``q`` and ``r``."""
    if q.dtype == object or r.dtype == object:
        return False
    return not q.size or not r.size or float(np.abs(q).max()) * float(np.abs(r).max()) * q.shape[1] < EXACT


def list_scores(queries: np.ndarray, rows: np.ndarray, lists: int = LISTS) -> list[np.ndarray]:
    """The inner products of each group of components, exact."""
    q, r = integers(queries), integers(rows)
    if not exact_together(q, r):
        q, r = _python_integers(q), _python_integers(r)
    edges = [q.shape[1] * i // lists for i in range(lists + 1)]
    return [q[:, a:z] @ r[:, a:z].T if z > a else np.zeros((len(q), len(r)), q.dtype) for a, z in zip(edges, edges[1:], strict=False)]


def reached(lists: list[np.ndarray], least: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places that have an entry of at least its list's ``least``, collected list by list."""
    places = np.unique(np.concatenate([np.flatnonzero((s >= bound).astype(bool)) for s, bound in zip(lists, least, strict=True)]))
    return np.divmod(places, lists[0].shape[1])


def share_of(cut: np.ndarray) -> np.ndarray:
    """The least list score that a sum of at least ``cut`` must hold; -inf where there is no cutoff."""
    none = cut == LEAST
    share = np.where(none, 0, cut // LISTS + (cut % LISTS != 0))
    if np.abs(share).max(initial=0) >= EXACT:
        return np.array([-np.inf if n else int(x) for n, x in zip(none, share, strict=True)], dtype=object)
    return np.where(none, -np.inf, share.astype(np.float64))


def resolved(lists: list[np.ndarray], qs: np.ndarray, rs: np.ndarray) -> np.ndarray:
    """The sums of the lists at the places, as 64-bit integers."""
    total = sum(s[qs, rs] for s in lists)
    if total.dtype == object:
        return np.array([min(MOST, max(LEAST, int(t))) for t in total], dtype=np.int64)
    return total.astype(np.int64)


def best_of(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best entries, ties to the smaller ``vec``."""
    order = np.lexsort((vec, ~score, query))
    query, score, vec = query[order], score[order], vec[order]
    nth = np.arange(len(query)) - np.searchsorted(query, query)
    keep = nth < k
    return query[keep], score[keep], vec[keep]


def _pass(sent, k: int, cutoff):
    """One pass over the rows: the reports of phase 1, or with cutoffs the entries of phases 2 and 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query = sent.value
        cut = cutoff.value if cutoff is not None else None
        none = np.zeros(0, np.int64)
        starts = range(0, len(query), QUERY_ROWS)
        best = {at: (none, none, none) for at in starts}
        for batch in batches:
            for ids, rows in vectors(batch.column(0), batch.column(1)):
                if rows.shape[1] != query.shape[1]:
                    continue
                for at in starts:
                    lists = list_scores(query[at : at + QUERY_ROWS], rows)
                    if cut is None:
                        few = min(k + 1, len(ids))  # one may be the query itself
                        if lists[0].dtype == object:
                            least = [np.sort(s, axis=1)[:, -few][:, None] for s in lists]
                        else:
                            least = [np.partition(s, len(ids) - few, axis=1)[:, len(ids) - few][:, None] for s in lists]
                    else:
                        least = [share_of(cut[at : at + QUERY_ROWS])[:, None]] * LISTS
                    qs, rs = reached(lists, least)
                    other = query_ids[at + qs] != ids[rs]
                    qs, rs = qs[other], rs[other]
                    found = resolved(lists, qs, rs)
                    if cut is not None:
                        enough = found >= cut[at + qs]
                        qs, rs, found = qs[enough], rs[enough], found[enough]
                    best[at] = best_of(*(np.concatenate(pair) for pair in zip(best[at], (at + qs, found, ids[rs]), strict=True)), k)
        for at in starts:
            qs, found, ids = best[at]
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[qs], pa.int64()), pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def _ranked(entries: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(table: DataFrame, *, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", every: int = QUERY_EVERY) -> DataFrame:
    """The k best candidates of each query (the rows whose id divides by ``every``)."""
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    queries = rows.filter((F.col("vec_id") % every == 0) & F.forall("vector", finite)).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    path = f"{checkpoint_dir(spark)}/sheaf-top-k-{uuid.uuid4().hex}"
    with scratch(spark):
        queries = stored(queries.select("vec_id", "vector", F.size("vector").alias("n")), "queries")
        sizes = sorted(map(tuple, queries.groupBy("n").count().collect()))
        blocks = {n: -(-many * 8 * max(n, 1) // QUERY_BYTES) for n, many in sizes}
        if max(blocks.values(), default=1) > 1:  # one folder for each block, so that a block reads its own rows
            each = F.create_map(*[F.lit(x) for n, b in blocks.items() for x in (n, b)])
            queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), each[F.col("n")]))
            held = gone_after(f"{checkpoint_dir(spark)}/sheaf-query-blocks-{uuid.uuid4().hex}")
            queries.repartition("n", "block").write.partitionBy("n", "block").parquet(held)
            queries = spark.read.schema("vec_id long, vector array<double>, n int, block long").parquet(held)
        else:
            queries = queries.withColumn("block", F.lit(0).cast("long"))
        schema = "query_id long, vec_id long, score long"
        wrote = False
        for n, many in blocks.items():
            for block in range(many or 1):
                own = queries.filter((F.col("n") == n) & (F.col("block") == block)).select("vec_id", "vector").orderBy("vec_id").toArrow()
                if not own.num_rows:
                    continue
                ids = own.column(0).to_numpy()
                query = own.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), n)
                sent = spark.sparkContext.broadcast((ids, query))
                kth = _ranked(rows.mapInArrow(_pass(sent, k, None), schema), k).groupBy("query_id").agg(F.min("score"), F.count(F.lit(1))).collect()
                cut = np.full(len(ids), LEAST, np.int64)
                safe = {q: s for q, s, found in kth if found >= k}
                for at, q in enumerate(ids.tolist()):
                    cut[at] = safe.get(q, LEAST)
                cutoff = spark.sparkContext.broadcast(cut)
                found = _ranked(rows.mapInArrow(_pass(sent, k, cutoff), schema), k)
                found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(path)
                wrote = True
                sent.unpersist()
                cutoff.unpersist()
    if not wrote:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(path)
