"""Cost-balanced packing of token sequences (operator 5).

A document's tokens (its ids, then the separator id) are cut into full sequences and one
remainder.  Remainders are packed a window at a time inside the task that tokenised them, so
no token crosses the network: the window's sequences are opened first (one per ``capacity``
tokens; the tail in powers of two, which need no padding) and the remainders, longest first,
each go to the sequence of lowest estimated attention cost that has token room left.  What
does not fit is cut off and goes on as a shorter piece.

Cost of a piece of n tokens: ``linear * n + quadratic * n * n / capacity``.

Defined cases: a null or empty text is the separator alone; repeated rows are packed each on
their own; an empty table gives no rows; other columns are ignored; a very long text is held
by the one task that reads its row.  A retried task packs alike, as a window holds the rows
in the order of the scan and sorts ties by doc_id and start.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import text_or_empty

CAPACITY = 1024
SEPARATOR = 0
WINDOW = 8192  # remainders held by a task at once; at most 4 KB of ids each
CACHE_ENTRIES = 200_000  # of space-separated chunks kept per Python worker
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Latin text with plain spaces and newlines: both libraries split it alike.
_PLAIN = re.compile("[\n\x20-\x7e¡-ɏ]*")
_ENCODERS: dict[tuple[str, str], Callable[[str], bytes]] = {}


def encoder(vocabulary: str, ranks: str) -> Callable[[str], bytes]:
    """text -> little-endian unsigned 32-bit ids, as ``tokenizers`` gives for ``vocabulary``.

    ``ranks`` holds the same vocabulary for ``tiktoken``, which encodes several times faster.
    It serves plain Latin text, a chunk between spaces at a time, as a token never spans the
    place before a space that a non-space follows.  All other text goes to ``tokenizers``.
    """
    if (vocabulary, ranks) in _ENCODERS:
        return _ENCODERS[vocabulary, ranks]
    import base64

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    exact: list[Tokenizer] = []  # loaded with the first text that needs it
    with open(P.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    class Chunks(dict):
        def __missing__(self, chunk: str) -> bytes:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = ids = array("I", encode(" " + chunk)).tobytes()
            return ids

    chunks = Chunks()

    def run(text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            if not exact:
                exact.append(Tokenizer.from_file(P.path(vocabulary)))
            return array("I", exact[0].encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        if "" in rest or "\n" in rest:
            return array("I", encode(text)).tobytes()
        return array("I", encode(first)).tobytes() + b"".join([chunks[x] for x in rest])

    _ENCODERS[vocabulary, ranks] = run
    return run


def sequence_sizes(total: int, capacity: int) -> list[int]:
    """Sizes that hold ``total`` tokens exactly: full ones, then falling powers of two."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def balance(pieces: list[tuple[int, int]], sizes: list[int], linear: float, quadratic: float, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Place (length, index) pieces, longest first, on the cheapest sequence with room.

    Returns (index, start in the piece, length, sequence, offset).  ``sizes`` must hold all tokens.
    """
    queue = sorted((-n, i, 0) for n, i in pieces)
    heap = [(0.0, j) for j in range(len(sizes))]
    used, at, out = [0] * len(sizes), 0, []
    while at < len(queue):
        less, i, start = queue[at]
        at += 1
        cost, j = heapq.heappop(heap)
        n = min(-less, sizes[j] - used[j])
        out.append((i, start, n, j, used[j]))
        used[j] += n
        if used[j] < sizes[j]:
            heapq.heappush(heap, (cost + linear * n + quadratic * n * n / capacity, j))
        if n < -less:
            insort(queue, (less + n, i, start + n), lo=at)
            if at > 4096:
                del queue[:at]
                at = 0
    return out


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
    capacity: int = CAPACITY,
    separator: int = SEPARATOR,
    window: int = WINDOW,
    linear: float = 1.0,
    quadratic: float = 1.0,
) -> DataFrame:
    """One row per piece: its document, place there, ids' CRC and place in a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(vocabulary, ranks)
        end = array("I", [separator]).tobytes()
        sequence = TaskContext.get().partitionId() << 33
        wide = 4 * capacity
        held: list[tuple[int, int, bytes, int]] = []  # doc_id, start, ids, document's tokens
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        out: list[list] = [[] for _ in names]

        def put(*row) -> None:
            for column, value in zip(out, row, strict=True):
                column.append(value)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=list(names))
            for x in out:
                x.clear()
            return batch

        def settle(last: bool) -> None:
            """Pack what is held; but for the last window, the shortest wait until sequences are full."""
            nonlocal sequence, held
            held.sort(key=lambda x: (-len(x[2]), x[0] is not None, x[0] or 0, x[1]))
            total, waiting = sum(len(x[2]) for x in held) // 4, []
            while not last and total % capacity and held:
                over = total % capacity
                doc_id, start, ids, tokens = held.pop()
                n = len(ids) // 4
                if n > over:  # only its end waits
                    held.append((doc_id, start, ids[: 4 * (n - over)], tokens))
                    waiting.append((doc_id, start + n - over, ids[4 * (n - over) :], tokens))
                    total -= over
                else:
                    waiting.append((doc_id, start, ids, tokens))
                    total -= n
            sizes = sequence_sizes(total, capacity)
            for i, start, n, j, offset in balance([(len(x[2]) // 4, i) for i, x in enumerate(held)], sizes, linear, quadratic, capacity):
                doc_id, base, ids, tokens = held[i]
                put(doc_id, base + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), tokens, sequence + j, offset)
            sequence += len(sizes)
            held = waiting

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                tokens = len(ids) // 4
                full = len(ids) - len(ids) % wide
                for k in range(0, full, wide):
                    put(doc_id, k // 4, capacity, zlib.crc32(ids[k : k + wide]), tokens, sequence, 0)
                    sequence += 1
                if full < len(ids):
                    held.append((doc_id, full // 4, ids[full:], tokens))
                    if len(held) >= window:
                        settle(False)
            if len(out[0]) >= 10_000:
                yield flush()
        settle(True)
        yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
