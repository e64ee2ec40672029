"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; each model sees the presence of selected words and word beginnings
(of ``PREFIXES`` bytes, for languages that inflect) and the
probabilities of the categories before it, and the last link is the label ``toxic`` itself. In training those earlier
probabilities are out-of-fold: words are selected and models fitted without the row they are asked for. The labels have one toxic mark only, so
the earlier categories are kinds of toxic texts learned from the toxic rows: clusters by the marked words that they use.

Training takes at most ``PER_CLASS`` labelled ids of each class, one text of each, as sets of hashed words and up to ``MOST_PIECES`` of them;
words are selected by chi-square and models fitted by Newton steps in numpy, in one task. A category without positives in the sample predicts its prior.

Nulls: a null text counts as empty. Rows without a usable label do not train. Ids may be of any type. Every row is scored by
itself: repeated rows and null ids keep their own results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, slices, table
from tidemark.llm.quality import held_out, in_one_task, lists, training_rows
from tidemark.llm.words import Words

LOG2, PER_CLASS, SELECT, FOLDS, RIDGE, THRESHOLD, KINDS, MOST_PIECES = 20, 3000, 600, 5, 0.1, 0.5, 3, 8_000_000
PREFIXES = (4, 5, 6, 7, 8)
CHAIN = [*(f"kind_{i + 1}" for i in range(KINDS)), "toxicity"]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - LOG2)).astype(np.int64)


def _pieces(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and of its beginnings; those are told apart from whole words."""
    docs, buckets = [words.doc], [_bucket(words.hash)]
    size = words.end - words.start
    for n in PREFIXES:
        own = np.flatnonzero(size > n)
        h = np.full(len(own), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + words.data[words.start[own] + j]
        docs.append(words.doc[own])
        buckets.append(_bucket(mix(h)))
    return np.concatenate(docs), np.concatenate(buckets)


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias (last) of a ridge logistic regression, by Newton's method."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return np.concatenate([np.zeros(x.shape[1]), [np.log(rate / (1 - rate))]])
    a = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(a.shape[1]), np.full(a.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _prob(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """select: bucket to feature, -1 for none; links: weights of features, then of earlier categories, then bias."""

    def __init__(self, buckets: np.ndarray, links: list[np.ndarray]):
        self.buckets, self.links = buckets, links

    def predict(self, col: pa.Array) -> np.ndarray:
        words, n = Words(col), len(col)
        k = len(self.buckets)
        text, b = _pieces(words)
        at = np.minimum(np.searchsorted(self.buckets, b), max(k - 1, 0))
        hit = self.buckets[at] == b if k else np.zeros(len(b), bool)
        pairs = np.unique(text[hit].astype(np.int64) * max(k, 1) + at[hit])
        doc, feature = pairs // max(k, 1), pairs % max(k, 1)
        out = np.zeros((n, len(self.links)))
        for j, w in enumerate(self.links):
            z = np.bincount(doc, weights=w[:k][feature], minlength=n) if k else np.zeros(n)
            z = z + out[:, :j] @ w[k : k + j] + w[-1]
            out[:, j] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def _select(at: np.ndarray, doc: np.ndarray, toxic: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Buckets (as indices below ``size``) that tell the toxic among ``rows`` (a mask) best, in order."""
    own = rows[doc]
    both = np.bincount(at[own], minlength=size).astype(float)
    pos = np.bincount(at[own], weights=toxic[doc[own]], minlength=size)
    n, n1 = rows.sum(), toxic[rows].sum()
    expect = both * n1 / max(n, 1)
    chi2 = np.where((both >= 4) & (pos > expect), (pos - expect) ** 2 / np.maximum(expect * (1 - n1 / max(n, 1)) * (1 - both / max(n, 1)), 1e-9), 0)
    best = np.sort(np.argsort(-chi2, kind="stable")[:SELECT])
    return best[chi2[best] > 10]


def _matrix(at: np.ndarray, doc: np.ndarray, chosen: np.ndarray, n: int, size: int) -> np.ndarray:
    where = np.full(size, -1)
    where[chosen] = np.arange(len(chosen))
    keep = where[at] >= 0
    x = np.zeros((n, len(chosen)))
    x[doc[keep], where[at[keep]]] = 1
    return x


def _kinds(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Cluster of each toxic row by cosine k-means from rows far apart, -1 for others."""
    out, own = np.full(len(x), -1), np.flatnonzero((toxic == 1) & x.any(axis=1))
    if not len(own):
        return out
    unit = x[own] / np.linalg.norm(x[own], axis=1, keepdims=True)
    centers = unit[:1]
    while len(centers) < min(KINDS, len(own)):
        centers = np.vstack([centers, unit[[(unit @ centers.T).max(axis=1).argmin()]]])
    for _ in range(20):
        kind = (unit @ centers.T).argmax(axis=1)
        sums = np.stack([unit[kind == k].sum(axis=0) if (kind == k).any() else centers[k] for k in range(len(centers))])
        centers = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    out[own] = kind
    return out


def train(rows: list[np.ndarray], toxic: np.ndarray) -> Chain:
    """rows: distinct buckets of each text; toxic: 0 or 1."""
    if not len(rows):
        return Chain(np.empty(0, np.int64), [np.concatenate([np.zeros(j), [-5.0]]) for j in range(len(CHAIN))])
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    bucket, at = np.unique(np.concatenate(rows), return_inverse=True)
    n, size = len(rows), len(bucket)
    best = _select(at, doc, toxic, np.ones(n, bool), size)
    x = _matrix(at, doc, best, n, size)
    kinds = _kinds(x, toxic)
    fold = np.arange(n) % FOLDS
    apart = [_matrix(at, doc, _select(at, doc, toxic, fold != f, size), n, size) for f in range(FOLDS)]
    links, earlier = [], np.zeros((n, 0))
    for j, category in enumerate(CHAIN):
        y = (toxic if category == CHAIN[-1] else kinds == j).astype(float)
        links.append(_fit(np.hstack([x, earlier]), y))
        if category == CHAIN[-1]:
            break
        own = np.zeros(n)
        for f in range(FOLDS):
            a = np.hstack([apart[f], earlier])
            own[fold == f] = _prob(a[fold == f], _fit(a[fold != f], y[fold != f]))
        earlier = np.hstack([earlier, own[:, None]])
    return Chain(bucket[best], links)


def fit(docs: DataFrame, labels: DataFrame, keep=None, per_class: int = PER_CLASS) -> Chain:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in slices(batches):
            words = Words(col)
            text, b = _pieces(words)
            pairs = np.unique(text.astype(np.int64) << LOG2 | b)
            cuts = np.searchsorted(pairs >> LOG2, np.arange(1, len(col)))
            found = np.split((pairs & ((1 << LOG2) - 1)).astype(np.int32), cuts)
            yield pa.record_batch({"nth": batch.column("nth"), "y": batch.column("y").cast(pa.int32()), "b": pa.array(found, pa.list_(pa.int32()))})

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y, pieces = [], [], 0
        for batch in batches:
            for own, label in zip(lists(batch.column("b")), batch.column("y").to_pylist(), strict=True):
                pieces += len(own)
                if pieces <= MOST_PIECES:
                    rows.append(own.astype(np.int64))
                    y.append(label)
        chain = train(rows, np.array(y, np.int64))
        parts = [chain.buckets.astype("<i8").tobytes(), *(w.astype("<f8").tobytes() for w in chain.links)]
        yield pa.record_batch({"parts": pa.array([parts], pa.list_(pa.binary()))})

    rows = training_rows(docs, labels, "toxic", per_class, keep).mapInArrow(counted, "nth long, y int, b array<int>")
    found = in_one_task(rows, trained, "parts array<binary>")
    if not found:
        return train([], np.empty(0))
    buckets, *links = found[0].parts
    return Chain(np.frombuffer(buckets, "<i8"), [np.frombuffer(w, "<f8") for w in links])


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, a probability for each category of the chain, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, chain.predict(col).T.copy())], ["doc_id", *CHAIN])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in CHAIN))
    return out.withColumn("toxic", (F.col("toxicity") >= THRESHOLD).cast("int"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"), ~held_out()))
