"""Near-duplicates by ProbMinHash, banding and verification (operator 1).

A text's shingles are runs of five words (all words, where there are fewer), weighted by how often
they occur.  Each shingle starts a Poisson process of rate its weight; every arrival falls on
one of ``SLOTS`` slots, which keeps its first.  A shingle stops once its time is beyond all
slots' times, so most stop after a few arrivals.  Two texts agree on a slot with the probability
Jaccard similarity of their weighted shingles.  A second signature, of rates 1, agrees with the
plain Jaccard similarity; it differs only where a text repeats a shingle, and such a text is in the
buckets of both.  The larger of the two shares of agreeing slots counts.

Equal texts are one node (a 64-bit hash of the text).  Nodes that agree on all slots of a band share a bucket;
20 or so bands of five make a pair of similarity 0.8 meet with probability over 0.9999.  A bucket
of up to ``ALL_PAIRS`` nodes proposes all its pairs.  A larger one proposes, for each node, the pair
with the bucket's least node and with the least by a hash of the band, so that different bands
bring different partners.  Pairs whose signatures agree on too few
slots go; the others are verified on their whole shingle multisets: probability Jaccard, or
the plain Jaccard of the sets, of at least ``SIMILARITY``.  Components of the verified links,
by alternating large and small stars, are the classes.

Large buckets whose members are not all of one component by then are searched in whole.  A bucket
meets in cells of two blocks of up to about ``BLOCK`` nodes, which hold signatures and shingles: each
node's partners of other components that agree on enough slots are verified, best first, until one
joins them.  Pairs within a component cannot change it, and a pair that shares several buckets is
verified in that of the least key.  A bucket's largest component is never compared with itself, so
the work of a group of near copies grows with its size times the strangers in its bucket.

Groups of any size stay distributed: aggregates are partial before the shuffle, and joins on hot
buckets, hubs and roots have one row a key on the other side and a plain table on either, so
that skewed keys can be split.  Each step between jobs is a table in the shared folder.

Defined cases: a null text is empty; empty texts are copies of one another and near no other
text; repeated rows are copies; a class's id is its least doc_id (null if all are null); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import free_names, scratch, stored, text_or_empty
from sheaf.llm.quality import chunks

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
ESTIMATE = 0.6  # share of agreeing slots that a pair needs to be verified: over five standard errors below 0.8
ALL_PAIRS = 8
BLOCK = 1024  # nodes of a large bucket that meet in one task
BROADCAST_NODES = 1_000_000  # node ids that are sent to all tasks; beyond, a join

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_BYTE = np.random.RandomState(1).randint(1, 2**63 - 1, 256).astype(_U)
_PLACE = np.random.RandomState(2).randint(1, 2**63 - 1, WORDS).astype(_U) | _U(1)
_BAND = np.random.RandomState(3).randint(1, 2**63 - 1, (BANDS, ROWS)).astype(_U) | _U(1)
_ODD, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(n, _U(base))
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=_U)
    return _powers[0], _powers[1]


def shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle, by document and then place."""
    solid = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], solid.view(np.int8), [0]))))
    a, z = edge[::2], edge[1::2]
    # a run of bytes may span two documents, which have no space between them
    inner = starts[1:]
    inside = np.searchsorted(a, inner, side="right") - 1
    crossing = inner[(inside >= 0) & (inner > a[np.maximum(inside, 0)]) & (inner < z[np.maximum(inside, 0)])] if len(a) else inner[:0]
    if len(crossing):
        crossing = np.unique(crossing)
        a, z = np.sort(np.concatenate([a, crossing])), np.sort(np.concatenate([z, crossing]))
    up, down = _power_tables(len(data) + 1)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[data] * up[: len(data)], dtype=_U)))
    word = _mixed((sums[z] - sums[a]) * down[a])
    first, last = np.searchsorted(a, starts), np.searchsorted(a, ends)
    doc = np.repeat(np.arange(len(starts)), last - first)
    stop = last[doc]
    at = np.arange(len(word))
    begins = at <= np.maximum(stop - WORDS, first[doc])
    at, doc, stop = at[begins], doc[begins], stop[begins]
    total = np.zeros(len(at), _U)
    for k in range(WORDS):
        has = at + k < stop
        total[has] += word[at[has] + k] * _PLACE[k]
    return doc, _mixed(total)


def signatures(doc: np.ndarray, element: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """Each document's kept element per slot (0 for a document without elements)."""
    order = np.lexsort((element, doc))
    doc, element = doc[order], element[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(doc))).astype(float)
    doc, element = doc[at], element[at]
    time = np.zeros(len(doc))
    first = np.full(n_docs * slots, np.inf)
    kept = np.zeros(n_docs * slots, _U)
    turn = 0
    while len(doc):
        turn += 1
        draw = _mixed(element + _U(turn * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> _U(11)).astype(float) + 1) / 2.0**53) / weight
        place = doc * slots + (_mixed(draw) % _U(slots)).astype(np.int64)
        sooner = time < first[place]
        np.minimum.at(first, place[sooner], time[sooner])
        won = sooner & (time == first[place])
        kept[place[won]] = element[won]
        latest = first.reshape(n_docs, slots).max(axis=1)
        going = time < latest[doc]
        doc, element, weight, time = doc[going], element[going], weight[going], time[going]
    return kept.reshape(n_docs, slots)


def plain_signatures(doc: np.ndarray, element: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The signatures ``kept`` with those of each document that repeats a shingle taken anew from its set."""
    order = np.lexsort((element, doc))
    doc, element = doc[order], element[order]
    again = np.zeros(len(doc), bool)
    again[1:] = (doc[1:] == doc[:-1]) & (element[1:] == element[:-1])
    repeats = np.unique(doc[again])
    if not len(repeats):
        return kept
    of = np.isin(doc, repeats) & ~again
    plain = kept.copy()
    plain[repeats] = signatures(np.searchsorted(repeats, doc[of]), element[of], len(repeats), kept.shape[1])
    return plain


def band_keys(kept: np.ndarray) -> np.ndarray:
    parts = kept.reshape(len(kept), BANDS, ROWS)
    with np.errstate(over="ignore"):
        return _mixed((parts * _BAND).sum(axis=2, dtype=_U) + np.arange(1, BANDS + 1, dtype=_U)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The larger of probability Jaccard and plain Jaccard of two sorted multisets."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    if not len(x) or not len(y):
        return 0.0
    every = np.union1d(x, y)
    wx, wy = np.zeros(len(every)), np.zeros(len(every))
    wx[np.searchsorted(every, x)], wy[np.searchsorted(every, y)] = nx, ny
    both = (wx > 0) & (wy > 0)
    plain = both.sum() / len(every)
    if plain >= SIMILARITY or (nx.max() == 1 and ny.max() == 1):
        return float(plain)
    pairs, many = np.unique(np.stack([wx[both], wy[both]], axis=1), axis=0, return_counts=True)
    weighted = sum(n / np.maximum(wx / p, wy / q).sum() for (p, q), n in zip(pairs, many, strict=True))
    return float(max(plain, weighted))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, bands, agree): band keys, and one byte of each slot of both signatures."""
    for batch in batches:
        for i, j, data, starts, ends in chunks(batch.column(1)):
            doc, element = shingles(data, starts, ends)
            kept = signatures(doc, element, j - i)
            plain = plain_signatures(doc, element, kept)
            full = np.bincount(doc, minlength=j - i) > 0
            keys = [np.unique(x) for x in np.concatenate([band_keys(kept), band_keys(plain)], axis=1)[full]]
            agree = np.concatenate([kept, plain], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j].filter(pa.array(full)), pa.array(keys, pa.list_(pa.int64())), pa.array([x.tobytes() for x in agree[full]], pa.binary())],
                names=["node", "bands", "agree"],
            )


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, elements): the sorted 32-bit hashes of all shingles."""
    for batch in batches:
        for i, j, data, starts, ends in chunks(batch.column(1)):
            doc, element = shingles(data, starts, ends)
            element = (element >> _U(32)).astype(np.uint32)
            order = np.lexsort((element, doc))
            per = np.split(element[order], np.cumsum(np.bincount(doc, minlength=j - i))[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([x.tobytes() for x in per], pa.binary())], names=["node", "elements"])


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of slots on which the rows agree, of the weighted signatures or of the plain ones."""
    same = a == b
    return np.maximum(same[:, :SLOTS].mean(axis=1), same[:, SLOTS:].mean(axis=1))


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, 2 * SLOTS) for k in (2, 3))
        keep = pa.array(agreement(a, b) >= ESTIMATE)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        value = [similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in sides]
        keep = pa.array([v >= SIMILARITY for v in value], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(value, pa.float64()).filter(keep)], names=["a", "b", "similarity"])


def nodes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("node"), text_or_empty(text_col).alias("text"))


def bucketed(signed: DataFrame) -> DataFrame:
    """(band, many, hub, other) of the buckets of two nodes or more."""
    members = signed.select("node", F.explode("bands").alias("band"))
    mark = F.xxhash64("node", "band")
    buckets = members.groupBy("band").agg(
        F.count(F.lit(1)).alias("many"), F.min("node").alias("hub"), F.min(F.struct(mark.alias("mark"), "node")).alias("other"),
    ).filter("many > 1").select("band", "many", "hub", F.col("other.node").alias("other"))
    return stored(buckets, "buckets")


def proposals(signed: DataFrame, buckets: DataFrame) -> DataFrame:
    """Pairs (a < b) of nodes that share a bucket, as the module says."""
    in_one = signed.select("node", F.explode("bands").alias("band")).join(buckets, "band")
    large = in_one.filter(F.col("many") > ALL_PAIRS).select("node", F.explode(F.array("hub", "other")).alias("to"))
    small = in_one.filter(F.col("many") <= ALL_PAIRS).repartition("band").groupBy("band").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    firsts = small.select(F.posexplode("nodes").alias("at", "node"), "nodes")
    paired = firsts.select("node", F.explode(F.slice("nodes", F.col("at") + 2, F.lit(ALL_PAIRS))).alias("to"))
    pairs = large.unionByName(paired).filter("node <> to")
    return pairs.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()


def _crossing(cell: pa.Table) -> pa.Table:
    """Verified pairs (a < b) of one node of either block that join all components which any such pair joins."""
    cell = cell.sort_by("node")
    node, root, own = (cell.column(k).to_numpy() for k in ("node", "root", "own"))
    root = root.copy()
    agree = np.frombuffer(b"".join(cell.column("agree").to_pylist()), np.uint8).reshape(len(node), -1)
    keys = [np.array(x, np.int64) for x in cell.column("keys").to_pylist()]
    elements = [np.frombuffer(x, np.uint32) for x in cell.column("elements").to_pylist()]
    band, first, last = (cell.column(k)[0].as_py() for k in ("band", "first", "last"))
    left, right = np.flatnonzero(own == first), np.flatnonzero(own == last)
    # every node's different shingles as places in the cell's list of them, with their share of the node's weight
    sets, counts = zip(*(np.unique(x, return_counts=True) for x in elements), strict=True)
    sizes = np.array([len(x) for x in sets])
    repeats = sizes < np.array([len(x) for x in elements])
    every, places = np.unique(np.concatenate(sets), return_inverse=True)
    places = np.split(places, np.cumsum(sizes)[:-1])
    weights = [n / n.sum() for n in counts]
    weight = np.zeros(len(every))
    found = []
    for k in left:
        to = right[(root[right] != root[k]) & ((right > k) | (first != last))]
        shares = agreement(agree[to], agree[k])
        to = to[np.argsort(-shares, kind="stable")][: int((shares >= ESTIMATE).sum())]
        if not len(to):
            continue
        weight[places[k]] = weights[k]
        met, starts = weight[np.concatenate([places[j] for j in to])], np.cumsum(sizes[to]) - sizes[to]
        weight[places[k]] = 0
        shared = np.add.reduceat(met > 0, starts, dtype=np.int64)
        plain = shared / (sizes[k] + sizes[to] - shared)
        # probability Jaccard is at most the overlap of the weights, and plain Jaccard where no shingle repeats
        most = np.add.reduceat(np.minimum(met, np.concatenate([weights[j] for j in to])), starts) + 1e-9
        may = (plain >= SIMILARITY) | ((repeats[k] | repeats[to]) & (most >= SIMILARITY))
        for j in to[may]:
            if root[j] == root[k] or np.intersect1d(keys[k], keys[j], assume_unique=True)[0] != band:
                continue
            value = similarity(elements[k], elements[j])
            if value >= SIMILARITY:
                found.append((int(node[k]), int(node[j]), value) if node[k] < node[j] else (int(node[j]), int(node[k]), value))
                root[root == root[j]] = root[k]
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["a", "b", "similarity"])


def crossing(rows: DataFrame, signed: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """(a < b, similarity): links that join what pairs of different components within buckets of ``members`` (band, node) join."""
    rooted = members.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    per = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    blocks = per.groupBy("band").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("many")).filter("many > main.n").select(
        "band", F.col("main.root").alias("main"),
        F.ceil((F.col("many") - F.col("main.n")) / BLOCK).alias("others"), F.ceil(F.col("main.n") / BLOCK).alias("mains"),
    )
    rooted = stored(rooted.join(stored(blocks, "blocks"), "band"), "rooted")
    held = signed.withColumnRenamed("bands", "keys").join(elements(rows, rooted.select("node")), "node")
    is_main, mark = F.col("root") == F.col("main"), F.xxhash64("node", "band")
    rooted = rooted.withColumn("own", F.when(is_main, F.col("others") + F.pmod(mark, "mains")).otherwise(F.pmod(mark, "others")))
    meets = F.sequence(F.lit(0).cast("long"), F.when(is_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1))
    cells = rooted.join(held, "node").select("band", "node", "root", "own", "agree", "keys", "elements", F.explode(meets).alias("with"))
    cells = cells.withColumns({"first": F.least("own", "with"), "last": F.greatest("own", "with")}).drop("with")
    return cells.groupBy("band", "first", "last").applyInArrow(_crossing, "a long, b long, similarity double")


def elements(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, elements) of the ``nodes``, one row each."""
    wanted = stored(nodes.distinct(), "wanted")
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    sets = rows.select("node", "text").join(wanted, "node", "left_semi").mapInArrow(_shingled, "node long, elements binary").dropDuplicates(["node"])
    return stored(sets, "elements")


def verified(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of the ``pairs`` whose shingles are alike."""
    sets = elements(rows, pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    sides = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
    return sides.select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long, similarity double")


def links(rows: DataFrame) -> DataFrame:
    """Verified pairs (a < b, similarity) of nodes of ``rows`` (node, text), enough to join all that a chain of them joins."""
    signed = rows.select("node", "text").mapInArrow(_signed, "node long, bands array<long>, agree binary").dropDuplicates(["node"])
    signed = stored(signed, "signatures")
    buckets = bucketed(signed)
    pairs = stored(proposals(signed, buckets), "proposals")
    agree = signed.select("node", "agree")
    sides = pairs.join(agree.select(F.col("node").alias("a"), F.col("agree").alias("x")), "a").join(agree.select(F.col("node").alias("b"), F.col("agree").alias("y")), "b")
    pairs = stored(sides.select("a", "b", "x", "y").mapInArrow(_agreeing, "a long, b long"), "agreeing")
    found = stored(verified(rows, pairs), "links")
    large = buckets.filter(F.col("many") > ALL_PAIRS).select("band")
    if large.isEmpty():
        return found
    members = stored(signed.select("node", F.explode("bands").alias("band")).join(large, "band"), "members")
    return found.unionByName(stored(crossing(rows, signed, members, components(found)), "links"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node that occurs in ``pairs`` (a, b): root is its component's least node."""
    edges = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = stored(both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")), "near")
        # done once every node that has a lesser neighbour has no other
        if near.filter("low < u AND low < high").isEmpty():
            return near.select(F.col("u").alias("node"), F.least("u", "low").alias("root"))
        least = near.select(F.col("u").alias("v"), F.least("u", "low").alias("m"))
        large = stored(edges.join(least, "v").select("u", F.col("m").alias("v")).distinct(), "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct(), "small")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, node, copy_of (least doc_id of its text) and class_id (least of its class)."""
    rows = nodes_of(docs, id_col, text_col)
    with scratch(docs.sparkSession):
        roots = stored(components(links(rows)), "roots")
        texts = stored(rows.groupBy("node").agg(F.min("doc_id").alias("copy_of")), "texts")
        in_class = texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        heads = stored(in_class.groupBy("root").agg(F.min("copy_of").alias("class_id")), "heads")
        told = stored(in_class.join(heads, "root").select("node", "copy_of", "class_id"), "classes", keep=True)
    return rows.select("doc_id", "node").join(told, "node").select("doc_id", "node", "copy_of", "class_id")


def _known(doc_id: Column) -> Column:
    """An id that equals itself when null."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def first_of_each(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class (its least doc_id), one for each; columns unchanged."""
    kept = classes(docs, text_col=text_col).filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("copy_of").eqNullSafe(F.col("class_id")))
    kept = kept.groupBy("class_id", "node").count().groupBy("class_id").agg(F.min("node").alias("node"))
    id_, text_, nth = free_names(docs, "_id", "_text", "_nth")
    kept = kept.select(_known(F.col("class_id")).alias(id_), F.col("node").alias(text_))
    rows = docs.withColumns({id_: _known(F.col("doc_id")), text_: F.xxhash64(text_or_empty(text_col))})
    met = rows.join(kept, [id_, text_], "left_semi")
    return met.withColumn(nth, F.row_number().over(Window.partitionBy(id_, text_).orderBy(F.lit(0)))).filter(F.col(nth) == 1).select(*docs.columns)
