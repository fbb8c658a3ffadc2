"""Quality by a linear-chain conditional random field over lines (operator 9).

Each line is good or bad.  Its features (shares of symbols, capitals, digits and so on, repeats
of words, and the same of the lines before and after) score "good"; a 2 x 2 matrix scores
neighbouring labels.  Forward-backward gives each line's marginal; a document's value is their
mean, weighted by length, and a logistic curve fitted on the labels makes it a probability.

The field is trained on a sample of at most ``SAMPLE`` labelled documents (least hash of the
id first), lines taking the document's label; after a first fit, lines of bad documents that
look good are taken as good where another line of the document stays bad, and it is fitted
again.  Scoring covers every whole text, in the task that reads it; nothing is shuffled.

Defined cases: a null text is empty, and an empty text is one empty line; a document with
several labels counts as good if one says so, and null labels do not count; without labels of
both kinds every score is 1; a null id is not held out; repeated rows score alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import text_or_empty

SAMPLE = 4000
FOLDS, HELD = 5, 0
THRESHOLD = 0.3
CHUNK = 1 << 20  # bytes of text whose features are made at once
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 space, 2 lower, 3 capital, 4 digit, 5 plain mark, 6 symbol, 7 "!", 8 beyond ASCII
_CLASS[list(b" \t\n\r\x0b\x0c")] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[list(b".,;:'\"()-?")] = 5
_CLASS[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = 6
_CLASS[ord("!")] = 7
_CLASS[128:] = 8
_SPREAD = np.random.RandomState(9).randint(1, 2**63 - 1, 256).astype(np.uint64)
N_OWN = 17
N_FEATURES = 3 * N_OWN + 4


def held_out(id_col: str, folds: int = FOLDS, held: int = HELD) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held, F.lit(False))


def line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the documents data[starts:ends], their lengths, and lines per document."""
    breaks = np.flatnonzero(data == 10)
    per = np.searchsorted(breaks, ends) - np.searchsorted(breaks, starts) + 1
    n = int(per.sum())
    first = np.cumsum(per) - per
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    is_first[first], is_last[first + per - 1] = True, True
    a, z = np.empty(n, np.int64), np.empty(n, np.int64)
    a[is_first], a[~is_first] = starts, breaks + 1
    z[is_last], z[~is_last] = ends, breaks
    length = z - a
    size = np.maximum(length, 1)
    classes = _CLASS[data]

    def share(c: int) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(classes == c, dtype=np.int32)))
        return (total[z] - total[a]) / size

    space, lower, upper, digit, plain, symbol, bang, beyond = (share(c) for c in range(1, 9))
    letters = np.maximum(lower + upper, 1e-9)
    # words: runs without spaces, known by a sum over their bytes
    solid = np.concatenate(([0], (classes != 1).astype(np.int8), [0]))
    edge = np.diff(solid)
    word_a, word_z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    own = np.searchsorted(a, word_a, side="right") - 1
    inside = word_a < z[own] if len(word_a) else np.zeros(0, bool)
    word_a, word_z, own = word_a[inside], word_z[inside], own[inside]
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_SPREAD[data], dtype=np.uint64)))
    word = sums[word_z] - sums[word_a]
    words = np.bincount(own, minlength=n)
    many = np.maximum(words, 1)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (own[1:] == own[:-1])
    repeats = np.bincount(own[again], minlength=n) / many
    order = np.lexsort((word, own))
    new = np.ones(len(word), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (own[order][1:] != own[order][:-1])
    distinct = np.where(words > 0, np.bincount(own[order][new], minlength=n) / many, 1.0)
    crowded = (distinct < 0.5) & (words >= 8)
    feats = np.stack(
        [symbol, symbol > 0.02, symbol > 0.08, bang, bang > 0.03, upper / letters, (upper / letters > 0.5) & (lower + upper > 0.2), digit, space, plain, beyond,
         np.log1p(length) / 8, np.minimum((size - space * size) / many, 40) / 20, repeats, repeats > 0.3, 1 - distinct, crowded], axis=1,
    ).astype(np.float32)
    before, after = np.zeros_like(feats), np.zeros_like(feats)
    before[1:], after[:-1] = feats[:-1], feats[1:]
    before[is_first], after[is_last] = 0, 0
    same = np.zeros(n, bool)
    line = sums[z] - sums[a]
    same[1:] = (line[1:] == line[:-1]) & ~is_first[1:] & (length[1:] > 0)
    rest = np.stack([np.ones(n), is_first, length == 0, same], axis=1).astype(np.float32)
    return np.concatenate([feats, before, after, rest], axis=1), length, per


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts, ends) of runs of rows of about ``CHUNK`` bytes."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        base = offsets[i]
        yield i, j, data[base : offsets[j]], offsets[i:j] - base, offsets[i + 1 : j + 1] - base
        i = j


def forward_backward(good: np.ndarray, per: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected count of each pair of neighbouring labels.

    good: log odds of each line by itself; per: lines per document; pair: scores of neighbouring labels.
    """
    order = np.argsort(-per, kind="stable")
    start = (np.cumsum(per) - per)[order]
    longest = int(per.max(initial=0))
    live = np.searchsorted(-per[order], -np.arange(longest), side="left")  # documents with more than t lines
    ahead = np.zeros((len(good), 2))
    for t in range(longest):
        at = start[: live[t]] + t
        ahead[at, 1] = good[at]
        if t:
            was = ahead[at - 1]
            ahead[at] += np.logaddexp(was[:, :1] + pair[0], was[:, 1:] + pair[1])
    behind = np.zeros((len(good), 2))
    counts = np.zeros((2, 2))
    total = np.empty(len(per))
    last = start + per[order] - 1
    total = np.logaddexp(ahead[last, 0], ahead[last, 1])
    for t in range(longest - 2, -1, -1):
        n = live[t + 1]
        at = start[:n] + t
        then = behind[at + 1].copy()
        then[:, 1] += good[at + 1]
        behind[at] = np.logaddexp(pair[:, 0] + then[:, :1], pair[:, 1] + then[:, 1:])
        counts += np.exp(ahead[at][:, :, None] + pair + then[:, None, :] - total[:n, None, None]).sum(axis=0)
    both = ahead + behind
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), counts


@dataclass
class Field:
    weights: np.ndarray
    pair: np.ndarray
    curve: tuple[float, float]

    def value(self, feats: np.ndarray, length: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Each document's length-weighted mean marginal."""
        marginal, _ = forward_backward(feats @ self.weights, per, self.pair)
        weight = np.maximum(length, 1).astype(float)
        first = np.cumsum(per) - per
        return np.add.reduceat(marginal * weight, first) / np.add.reduceat(weight, first)

    def score(self, feats: np.ndarray, length: np.ndarray, per: np.ndarray) -> np.ndarray:
        value = np.clip(self.value(feats, length, per), 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * np.log(value / (1 - value)))))


def _fit_field(feats: np.ndarray, per: np.ndarray, labels: np.ndarray, weights: np.ndarray, pair: np.ndarray, steps: int = 100, rate: float = 0.15, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the mean log likelihood of the lines' labels."""
    doc_end = np.cumsum(per) - 1
    inner = np.ones(len(labels), bool)
    inner[doc_end] = False
    seen = np.zeros((2, 2))
    here = np.flatnonzero(inner)
    np.add.at(seen, (labels[here], labels[here + 1]), 1)
    params = np.concatenate([weights, pair.ravel()])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for k in range(1, steps + 1):
        p, counts = forward_backward(feats @ params[:-4], per, params[-4:].reshape(2, 2))
        grad = np.concatenate([feats.T @ (labels - p), (seen - counts).ravel()]) / len(labels) - decay * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params = params + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return params[:-4], params[-4:].reshape(2, 2)


def _fit_curve(value: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the value's log odds, by damped Newton steps."""
    value = np.clip(value, 1e-4, 1 - 1e-4)
    x = np.stack([np.ones(len(value)), np.log(value / (1 - value))], axis=1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (label - p) - 0.1 * w)
    return float(w[0]), float(w[1])


def fit(feats: np.ndarray, length: np.ndarray, per: np.ndarray, label: np.ndarray) -> Field | None:
    """The field for documents with labels 0 or 1; None unless both occur."""
    if len(set(label.tolist())) < 2:
        return None
    labels = np.repeat(label, per)
    weights, pair = _fit_field(feats, per, labels, np.zeros(feats.shape[1]), np.zeros((2, 2)))
    p, _ = forward_backward(feats @ weights, per, pair)
    doc = np.repeat(np.arange(len(per)), per)
    fair = (labels == 0) & (p > 0.5)
    some_bad = np.bincount(doc, weights=(labels == 0) & ~fair, minlength=len(per)) > 0
    labels = np.where(fair & some_bad[doc], 1, labels)
    weights, pair = _fit_field(feats, per, labels, weights, pair, steps=60)
    field = Field(weights, pair, (0.0, 1.0))
    field.curve = _fit_curve(field.value(feats, length, per), label)
    return field


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held: int, bound: int) -> DataFrame:
    """doc_id, text, label of at most ``bound`` labelled documents outside the held-out fold, one row for each id and text."""
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, held))
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id")  # at most ``bound`` rows


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Field | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, starts, ends in chunks(batch.column(1)):
                feats, length, per = line_features(data, starts, ends)
                cut = np.cumsum(per)[:-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(2)[i:j],
                     pa.array([x.tobytes() for x in np.split(feats, cut)], pa.binary()), pa.array([x.tobytes() for x in np.split(length, cut)], pa.binary())],
                    names=["doc_id", "label", "feats", "length"],
                )

    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD, bound)
    rows = sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, feats binary, length binary").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["doc_id", "length", "feats"]).reset_index(drop=True)
    feats = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for x in rows["feats"]]
    length = np.concatenate([np.frombuffer(x, np.int64) for x in rows["length"]])
    return fit(np.concatenate(feats).astype(np.float64), length, np.array([len(x) for x in feats]), rows["label"].to_numpy())


def score(docs: DataFrame, field: Field | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.ones(batch.num_rows)
            if field is not None:
                for i, j, data, starts, ends in chunks(batch.column(2)):
                    found[i:j] = field.score(*line_features(data, starts, ends))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, field: Field | None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns unchanged."""
    if field is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.ones(batch.num_rows)
            texts = batch.column(at)
            for i, j, data, starts, ends in chunks(texts.fill_null("")):
                found[i:j] = field.score(*line_features(data, starts, ends))
            yield batch.filter(pa.array(found >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
