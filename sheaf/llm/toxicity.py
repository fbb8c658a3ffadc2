"""Toxicity by weak supervision (operator 8).

From a sample of at most ``SAMPLE`` labelled documents (least hash of the id first):

1. Words and beginnings of words that occur almost only in toxic documents make a lexicon.
   Support counts different documents, told apart by their least word hash, so that copies of
   one document don't make its own words look toxic.
2. Voters: the lexicon's entries that cover the sample best, each voting "toxic"; a list of
   plain insults; patterns (shouting, calls); "no lexicon entry" voting "clean"; and the label
   itself as one more voter that may err.
3. A generative model (latent class, by expectation maximisation) estimates each voter's rate of
   each vote in both classes, then the correlation of each pair of voters beyond the classes;
   a voter's evidence is divided by the correlation that it shares, and the classes are
   estimated again.
4. A logistic classifier on the entries' presence and the patterns is trained on the posteriors.

Scoring is linear in what a text holds and runs over every whole text in the task that reads it;
a word's entries are looked up once per worker.

The sample and the model are bounded, whatever the size of the corpus: ``ENTRIES`` weights (some 30 KB sent
to each task), and ``VOTERS`` lexicon voters, as the label model's correlations grow with their square and
add little beyond those that cover the sample.  Every entry, voter or not, has a weight in the classifier.

Defined cases: a null text is empty, and an empty text scores as one without entries; several
labels count as toxic if one says so, null labels do not count; without labels of both kinds
every score is 0; a null id is not held out; repeated rows score alike; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import text_or_empty
from sheaf.llm.quality import held_out, labelled_sample

SAMPLE = 5000
FOLDS, HELD = 4, 2
THRESHOLD = 0.3
ENTRIES = 1000
VOTERS = 40
BEGINNINGS = range(3, 7)  # lengths of word beginnings that may enter the lexicon
PRECISION, SUPPORT = 0.8, 3
CACHE_ENTRIES = 400_000
_WORD = re.compile(r"\w+")
#: Plain insults, as one voter.
INSULTS = frozenset("idiot moron stupid loser scum trash pathetic worthless disgusting dumb fool".split())
_CALLS = re.compile(r"\b(?:you are|you're|shut up|go away|hate you)\b")


def keys_of(word: str) -> list[str]:
    """The word itself, and its beginnings marked by ``^``."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


def patterns(text: str) -> tuple[float, float]:
    """Whether the text shouts, and whether it calls someone something."""
    capitals = sum(map(str.isupper, text[:])) if text.count("!") > 2 else 0
    return float(capitals > 0.3 * len(text)), float(_CALLS.search(text.lower()) is not None)


def lexicon(docs: list[tuple[set[str], int]]) -> list[str]:
    """Entries that are precise for label 1 and supported by different documents, strongest first."""
    toxic, every, support = Counter(), Counter(), defaultdict(set)
    for words, label in docs:
        keys = {k for w in words for k in keys_of(w)}
        every.update(keys)
        if label:
            toxic.update(keys)
            least = min(zlib.crc32(w.encode()) for w in words) if words else 0
            for k in keys:
                support[k].add(least)
    found = [(len(support[k]) * toxic[k] / (every[k] + 1), k) for k in toxic if len(support[k]) >= SUPPORT and toxic[k] >= PRECISION * every[k]]
    return [k for _, k in sorted(found, key=lambda x: (-x[0], x[1]))[:ENTRIES]]


def covering(present: np.ndarray, label: np.ndarray, most: int) -> list[int]:
    """Entries, one by one, that reach the most labelled documents that few others reached."""
    need, chosen = label.astype(float), []
    for _ in range(min(most, present.shape[1])):
        gain = present.T @ need
        gain[chosen] = -1
        best = int(np.argmax(gain))
        if gain[best] <= 1e-6:
            break
        chosen.append(best)
        need = need * np.where(present[:, best] > 0, 0.5, 1.0)
    return chosen


def label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """votes: -1 abstains, 0 clean, 1 toxic.  Posterior of each row, rates [voter, class, vote], correlations."""
    n, m = votes.shape
    cast = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    post = np.clip((votes == 1).sum(axis=1) / np.maximum((votes >= 0).sum(axis=1), 1), 0.02, 0.98)
    share, shared = np.ones(m), np.zeros((m, m))
    for turn in range(2):
        for _ in range(rounds):
            classes = np.stack([1 - post, post], axis=1)
            rates = np.einsum("nc,nmv->mcv", classes, cast) + 0.1
            rates /= rates.sum(axis=2, keepdims=True)
            prior = float(np.clip(post.mean(), 0.01, 0.99))
            evidence = np.einsum("nmv,mv->nm", cast, np.log(rates[:, 1] / rates[:, 0])) @ (1 / share)
            post = 1 / (1 + np.exp(-np.clip(evidence + np.log(prior / (1 - prior)), -30, 30)))
        if turn == 0:  # what the classes leave unexplained
            value = votes.astype(float)
            classes = np.stack([1 - post, post], axis=1)
            mean = (classes.T @ value) / classes.sum(axis=0)[:, None]
            rest = value - classes @ mean
            spread = np.sqrt((rest**2).mean(axis=0)) + 1e-6
            shared = np.abs((rest / spread).T @ (rest / spread) / n)
            np.fill_diagonal(shared, 0)
            share = 1 + np.where(shared > 0.2, shared, 0).sum(axis=1)
    return post, rates, shared


def logistic(x: np.ndarray, target: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights (last: the constant) by Adam on the cross-entropy with soft targets."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    w[-1] = -2.0
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) / len(x) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


@dataclass
class Model:
    entries: dict[str, int]
    weights: np.ndarray  # entries, then the two patterns, then the constant
    rates: np.ndarray
    shared: np.ndarray

    def scorer(self):
        """text -> score, with a cache of words."""
        entries, weights = self.entries, self.weights.tolist()
        tail = len(entries)

        class Words(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                if len(self) >= CACHE_ENTRIES:
                    self.clear()
                self[word] = found = tuple(entries[k] for k in keys_of(word) if k in entries)
                return found

        words = Words()

        def score(text: str) -> float:
            held = {i for found in map(words.__getitem__, set(_WORD.findall(text.lower()))) if found for i in found}
            shout, call = patterns(text)
            total = sum(weights[i] for i in held) + weights[tail] * shout + weights[tail + 1] * call + weights[-1]
            return float(1 / (1 + np.exp(-min(30.0, max(-30.0, total)))))

        return score


def fit(texts: list[str], labels: list[int], marks: np.ndarray) -> Model | None:
    """``texts`` may be the words alone; ``marks`` are the patterns of the whole texts."""
    if len(set(labels)) < 2:
        return None
    docs = [(set(_WORD.findall(t.lower())), y) for t, y in zip(texts, labels, strict=True)]
    entries = {k: i for i, k in enumerate(lexicon(docs))}
    present = np.zeros((len(docs), len(entries)), np.float32)
    for row, (words, _) in zip(present, docs, strict=True):
        row[[entries[k] for w in words for k in keys_of(w) if k in entries]] = 1
    y = np.array(labels)
    insult = np.array([bool(words & INSULTS) for words, _ in docs])
    columns = [np.where(present[:, j] > 0, 1, -1) for j in covering(present, y, VOTERS)]
    columns += [np.where(insult, 1, -1), np.where(marks[:, 0] > 0, 1, -1), np.where(marks[:, 1] > 0, 1, -1)]
    columns += [np.where(present.any(axis=1) | insult, -1, 0), y]
    post, rates, shared = label_model(np.stack(columns, axis=1), float(y.mean()))
    weights = logistic(np.concatenate([present, marks], axis=1), post)
    return Model(entries, weights, rates, shared)


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model | None:
    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD, bound)
    words = F.array_join(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))), " ")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [patterns(t.as_py()) for t in batch.column(3)]
            shout, call = (pa.array([m[k] for m in marks], pa.float64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), shout, call], names=["doc_id", "label", "words", "shout", "call"])

    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label", words.alias("words"), "text")
    rows = rows.mapInArrow(marked, "doc_id long, label int, words string, shout double, call double").orderBy("doc_id", "words", "shout", "call").toPandas()
    return fit(rows["words"].tolist(), rows["label"].tolist(), rows[["shout", "call"]].to_numpy()) if len(rows) else None


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = model.scorer() if model is not None else lambda text: 0.0
        for batch in batches:
            found = np.array([one(t.as_py()) for t in batch.column(2)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, FOLDS, HELD).alias("held_out"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
