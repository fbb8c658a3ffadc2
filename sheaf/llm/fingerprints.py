"""SimHash fingerprints (operator 10), from built-in functions alone.

Terms are pairs of neighbouring words; each occurrence votes with a weight of 1 to 4 that
grows with its length.  A bit of the fingerprint is set where the weights of the terms whose
hash has that bit exceed half of all weights.  Votes of two bits share one 64-bit sum (32 bits
each, enough for any text that a string can hold), so a word costs 32 additions.

``edited`` needs each document's successor by (doc_id, text).  Rows go to blocks of neighbours in that
order: the bounds are pairs of an id and the beginning of a text, from a sample of ``SAMPLE`` rows a
block, so a null or repeated id is split by its texts as ids are among themselves.  The sample
moves bounds only, never results.  The first rows of a block also go to the block before it.  There
are at most ``MAX_BLOCKS`` blocks, so that their bounds stay some megabytes; beyond ``MAX_BLOCKS *
ROWS_PER_BLOCK`` rows the blocks grow, and sort on disk (at 5 * 10^10 rows one holds 3 * 10^6).  Only rows alike in
id and in the first ``HEAD`` characters stay together.  Texts are shuffled once, by block; window, votes and
the comparison with the successor then reuse that partitioning.

``links`` finds all pairs of different fingerprints within a Hamming radius by permuted block
tables: 64 bits in ``blocks`` blocks, one table for each choice of ``blocks - radius`` blocks,
as two prints that differ in at most ``radius`` bits agree on some such choice.

Defined cases: a null text is empty; an empty text's fingerprint is 0; repeated rows and null
ids follow one another by (doc_id, text), nulls first; a lone row is its own successor; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import text_or_empty

ROWS_PER_BLOCK = 32
MAX_BLOCKS = 16384
SAMPLE = 8
HEAD = 64
BITS = 64
_SPACE = r"[\x20\x09-\x0D]+"
_PAIR = 0x0000000100000001
_LOW = 0xFFFFFFFF


def _place() -> Column:
    """A row's place in the order; structs compare field by field, nulls first."""
    return F.struct(F.col("doc_id"), F.substring("text", 1, HEAD).alias("head"))


def _bounds(found: list[tuple[int | None, str]]) -> Column:
    told = json.dumps([{"doc_id": i, "head": h} for i, h in found])
    return F.from_json(F.lit(told), "array<struct<doc_id:bigint,head:string>>")


def _reached(bounds: list[tuple[int | None, str]], value: Column) -> Column:
    """How many of the ascending bounds are at most ``value``, by binary search."""
    array, steps = _bounds(bounds), [1 << b for b in range(max(1, len(bounds)).bit_length() - 1, -1, -1)]
    at_most = lambda at: F.when(at <= len(bounds), F.try_element_at(array, at) <= value).otherwise(F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda acc, s: F.when(at_most(acc + s), acc + s).otherwise(acc))


def _ordered(found: list) -> list[tuple[int | None, str]]:
    return sorted({tuple(r) for r in found}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) with their block; the first of each block again, as a guest of the block before."""
    many = rows.count()
    n = max(1, min(MAX_BLOCKS, many // ROWS_PER_BLOCK))
    cuts = []
    if n > 1:
        drawn = rows.sample(min(1.0, n * SAMPLE / many), 1).select(_place().alias("p")).select("p.*").collect()
        drawn.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        cuts = _ordered([drawn[len(drawn) * i // n] for i in range(1, n)]) if drawn else []
    heads = _ordered(rows.groupBy(_reached(cuts, _place()).alias("b")).agg(F.min(_place()).alias("m")).select("m.*").collect())
    last = max(0, len(heads) - 1)
    with_block = rows.withColumn("block", _reached(heads[1:], _place()))
    first = F.coalesce(F.try_element_at(_bounds(heads), F.col("block") + 1) == _place(), F.lit(False))
    before = F.when(F.col("block") == 0, F.lit(last)).otherwise(F.col("block") - 1)
    place = lambda b, guest: F.struct(b.cast("int").alias("block"), F.lit(guest).alias("guest"))
    places = F.when(first, F.array(place(F.col("block"), False), place(before, True))).otherwise(F.array(place(F.col("block"), False)))
    return with_block.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.block", "p.guest")


def _bit_sums(hash_: str, weight: str) -> list[Column]:
    pair = F.lit(_PAIR)
    return [F.sum(F.shiftrightunsigned(hash_, j).bitwiseAND(pair) * F.col(weight)).alias(f"s{j}") for j in range(BITS // 2)] + [F.sum(weight).alias("w")]


def _assembled() -> Column:
    """The fingerprint as a long, from the packed sums."""
    out = F.lit(0).cast("long")
    for j in range(BITS // 2):
        low, high = F.col(f"s{j}").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(f"s{j}", 32)
        for at, total in ((j, low), (j + BITS // 2, high)):
            out = out.bitwiseOR(F.when(2 * total > F.col("w"), F.lit(1 << at if at < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return out


def simhash(bodies: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """keys and ``print`` (long): the fingerprint of ``body``.  Groups by all of ``keys``."""
    words = bodies.select(*keys, F.split(body, _SPACE).alias("words"))
    pairs = words.select(*keys, F.explode(F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.size("words")).alias("b"))).alias("t"))
    length = F.length("t.a") + F.coalesce(F.length("t.b"), F.lit(0))
    weight = F.when(length == 0, 0).otherwise(F.least(F.lit(4), 1 + F.floor(length / 5))).cast("long")
    voted = pairs.select(*keys, F.xxhash64("t.a", "t.b").alias("h"), weight.alias("weight"))
    return voted.groupBy(*keys).agg(*_bit_sums("h", "weight")).select(*keys, _assembled().alias("print"))


def hexed(print_: Column) -> Column:
    return F.lpad(F.lower(F.hex(print_)), BITS // 4, "0")


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def compared(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against its edited text's and its successor's."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    order = Window.partitionBy("block").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    follow = blocks(rows).select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    side = lambda which, body, sha: F.struct(F.lit(which).alias("side"), body.alias("body"), sha.alias("sha"))
    plain = side(0, F.col("text"), F.lit(None).cast("binary"))
    sides = F.when(F.col("guest"), F.array(plain)).otherwise(F.array(plain, side(1, F.col("edited"), F.unhex(F.sha2("edited", 256)))))
    bodies = (
        follow.select("block", "place", "guest", "doc_id", "text", n.alias("n_chars"), F.when(~F.col("guest"), edited).alias("edited"))
        .select("block", "place", "guest", "doc_id", "n_chars", F.explode(sides).alias("s"))
        .select("block", "place", "guest", "doc_id", "n_chars", "s.side", "s.sha", F.col("s.body").alias("body"))
    )
    prints = simhash(bodies, ["block", "place", "guest", "doc_id", "n_chars", "side", "sha"])
    line = Window.partitionBy("block").orderBy("place", "side")  # own, edited, the successor's own
    lead = lambda c, k: F.lead(c, k).over(line)
    return (
        prints.select("*", lead("print", 1).alias("edited_print"), lead("sha", 1).alias("edited_sha"), lead("print", 2).alias("next_print"))
        .filter((F.col("side") == 0) & ~F.col("guest"))
        .select(
            "doc_id",
            F.col("n_chars").cast("long").alias("n_chars"),
            F.lower(F.hex("edited_sha")).alias("edited_sha256"),
            hexed(F.col("print")).alias("fingerprint"),
            hexed(F.col("edited_print")).alias("edited_fingerprint"),
            likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
            likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        )
    )


def block_tables(radius: int, n_blocks: int) -> list[int]:
    """Masks of the blocks that each table keys on."""
    edges = [BITS * i // n_blocks for i in range(n_blocks + 1)]
    block = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(n_blocks)]
    return [sum(block[i] for i in kept) for kept in combinations(range(n_blocks), n_blocks - radius)]


def links(prints: DataFrame, *, radius: int = 3, n_blocks: int = 6, col: str = "print") -> DataFrame:
    """All pairs (a, b, distance) of different fingerprints, a < b, at most ``radius`` bits apart."""
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    masks = [signed(m) for m in block_tables(radius, n_blocks)]
    each = prints.select(F.col(col).alias("p")).filter("p is not null").distinct()
    keyed = each.select("p", F.posexplode(F.array(*[F.col("p").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("table", "key"))
    a, b = keyed.withColumnRenamed("p", "a"), keyed.withColumnRenamed("p", "b")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return a.join(b, ["table", "key"]).filter(F.col("a") < F.col("b")).select("a", "b", apart.alias("distance")).filter(F.col("distance") <= radius).distinct()
