"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed pieces: byte n-grams of 2 to 4, words, word pairs,
and whether a word repeats the one before it. A softmax layer on that mean gives the class; vectors and layer are trained together
by plain stochastic gradient descent in numpy. Since the layer is linear, scoring needs one number per
bucket, the bucket's vector times the difference of the class weights.

Training takes at most ``PER_CLASS`` labelled ids of each class, those that hash lowest, one text of each (of least hash), and stops
at ``MOST_PIECES`` counts, so the choice does not depend on the partitions. Texts become counts over ``1 << LOG2`` buckets
where they are; one task takes them in the order of the hashes and trains, and the driver gets the score of each bucket.

Nulls: a null text counts as empty; an empty text has no pieces and gets the layer's bias alone. Rows without a
usable label do not train. Repeated rows are scored alike. Ids, of any type, and other columns are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_rows, mix, slices, text_buffers
from tidemark.llm.words import Words

LOG2, DIM, PER_CLASS, EPOCHS, RATE, MOST_PIECES = 15, 8, 1500, 6, 0.5, 16_000_000
THRESHOLD = 0.3
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def _pieces(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(buckets, starts of each text's own) for one family of features after another."""
    raw, off = text_buffers(col)
    n, wide = len(raw), raw.astype(np.uint32) + np.uint32(1)
    shift = np.uint32(32 - LOG2)
    h = wide * _MUL[0]
    for size in (2, 3, 4):
        if n < size:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MUL[1] + wide[size - 1 :] * _MUL[size - 1]
        buckets = (h * _MUL[3]) >> shift
        # n-grams that reach into the next text count for none
        yield buckets, np.minimum(off[:-1], n - size + 1), np.clip(off[1:] - size + 1, off[:-1], n - size + 1)
    words = Words(col)
    if len(words.start):
        for gram in (1, 2):
            h = words.grams(gram)
            if gram == 2:
                same = np.zeros(len(h), bool)
                same[:-1] = words.hash[:-1] == words.hash[1:]
                h = np.where(same, np.uint64(1) << np.uint64(63), h)
            yield (h >> np.uint64(64 - LOG2)).astype(np.int64), words.first[:-1], np.maximum(words.first[:-1], words.first[1:] - gram + 1)


def _sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[end] - total[start]


def features(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, counts) of each text."""
    out = [np.zeros(0, np.int64)] * len(col)
    parts: list[list[np.ndarray]] = [[] for _ in out]
    for buckets, start, end in _pieces(col):
        for i, (s, e) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            if e > s:
                parts[i].append(buckets[s:e].astype(np.int64))
    return [np.unique(np.concatenate(p), return_counts=True) if p else (out[0], out[0]) for p in parts]


class Model:
    """score: one number per bucket; bias: log odds of label 1 for a text without pieces."""

    def __init__(self, score: np.ndarray, bias: float):
        self.score, self.bias = score, bias

    def predict(self, col: pa.Array) -> np.ndarray:
        total, pieces = np.zeros(len(col)), np.zeros(len(col))
        for buckets, start, end in _pieces(col):
            total += _sums(self.score[buckets], start, end)
            pieces += end - start
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(pieces, 1) + self.bias, -30, 30)))


def _hash_order():
    return [F.xxhash64(F.col("doc_id"), F.lit(7)), F.col("doc_id")]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, keep=None) -> DataFrame:
    """(nth, text, y): one text of at most ``per_class`` labelled ids of each class; only these ids are broadcast. nth: a hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if keep is not None:
        known = known.where(keep)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(*_hash_order()).limit(per_class) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    text = F.coalesce("text", F.lit(""))
    # rows of one id meet as one row of each task
    one = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select(_hash_order()[0].alias("nth"), F.col("t.text").alias("text"), "y")


def in_one_task(rows: DataFrame, work, schema: str) -> list:
    """What ``work`` makes of the rows (nth, y, ...), in their order, in one task; for samples of bounded size. Nothing of no rows."""
    return rows.repartition(1).sortWithinPartitions(*rows.columns[:2]).mapInArrow(work, schema).collect()


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", keep=None, per_class: int = PER_CLASS, seed: int = 1) -> Model:
    """Train on a bounded sample; without rows of both classes the score is a constant."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in slices(batches):
            found = features(col)
            yield pa.record_batch(
                {
                    "nth": batch.column("nth"),
                    "y": batch.column("y").cast(pa.int32()),
                    "f": pa.array([f.astype(np.int32) for f, _ in found], pa.list_(pa.int32())),
                    "n": pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32())),
                }
            )

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y, pieces = [], [], 0
        for batch in batches:
            f, n = (lists(batch.column(batch.schema.get_field_index(x))) for x in "fn")
            for own, counts, label in zip(f, n, batch.column("y").to_pylist(), strict=True):
                pieces += len(own)
                if pieces <= MOST_PIECES:
                    rows.append((own, counts))
                    y.append(label)
        model = train(rows, np.array(y, np.int64), seed)
        yield pa.record_batch({"score": pa.array([model.score.astype("<f8").tobytes()], pa.binary()), "bias": pa.array([model.bias])})

    rows = training_rows(docs, labels, label, per_class, keep).mapInArrow(counted, "nth long, y int, f array<int>, n array<int>")
    found = in_one_task(rows, trained, "score binary, bias double")
    return Model(np.frombuffer(found[0].score, "<f8"), found[0].bias) if found else train([], np.empty(0), seed)


def lists(col: pa.Array) -> list[np.ndarray]:
    """Copies of a list column's rows, so that their batch can go."""
    at, values = col.offsets.to_numpy(), col.values.to_numpy()
    return [values[a:b].copy() for a, b in zip(at, at[1:])]  # noqa: B905


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 1) -> Model:
    """Stochastic gradient descent over documents, one at a time, with a rate that falls to zero."""
    rng = np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << LOG2), 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    emb = (rng.random((1 << LOG2, DIM), dtype=np.float32) - np.float32(0.5)) / np.float32(DIM)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    share = np.bincount(y, minlength=2) / len(y)
    step, steps = 0, EPOCHS * len(y)
    weights = [(c / max(1, c.sum())).astype(np.float32) for _, c in rows]
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            buckets, w = rows[i][0], weights[i]
            if not len(buckets):
                continue
            hidden = w @ emb[buckets]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= np.float32(0.5 / share[y[i]])
            back = layer @ p
            layer -= rate * np.outer(hidden, p)
            bias -= rate * p
            emb[buckets] -= (rate * len(buckets) ** 0.5 * w)[:, None] * back[None, :]
    # classes are weighted alike in training, and so in the score
    return Model((emb @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as one more column; the name must not be one of its own."""
    if name in docs.columns:
        raise ValueError(f"column {name} exists")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.predict(col))], [*batch.schema.names, name])

    return map_rows(docs, scored, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """Rows that never train: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9(spark, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), "quality", ~held_out())
    # only what the result needs comes back from Python
    scored = _scores(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _scores(docs: DataFrame, model: Model) -> DataFrame:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.predict(col))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose score reaches the threshold, with their columns as they were."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in slices(batches):
            yield batch.filter(pa.array(model.predict(col) >= threshold))

    return map_rows(docs, kept, docs.schema)
