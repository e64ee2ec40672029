"""Language by prediction by partial matching over bytes.

For each language a context tree holds, for contexts of up to ``ORDER`` bytes, how often each byte came next. The
statistics are frozen after training, so the code length of a text in a language is a plain sum over its bytes: a byte
that its longest known context has seen c times costs -log2(c / (T + D)) bits, T being what followed the context and D
how many different bytes did; else the escape costs -log2(D / (T + D)) and the next shorter context decides; below the
empty context all 256 bytes are alike. A context that a language never met costs it nothing. The language with the
shortest code wins, ties go to the lesser name, and the score is its share of 2**-bits over the languages.

All languages share one tree of contexts, kept by how often they occur in training. What each known (context, byte)
costs each language, its escapes included, is worked out once, in whole units of 2**-``UNIT`` bits; scoring walks the
contexts of all bytes of a slice at once and adds integers, so a text gets the same lengths in any company.

Training takes a hash sample of each language: about ``PER_LANG`` texts or ``LANG_BYTES`` bytes, whichever is less, of
the ``MOST_LANGS`` most frequent languages; the tree keeps ``NODES`` contexts and ``MOST_COSTS`` costs at most, the
most frequent first. Those bounds are of the model alone: every text is scored whole. A-Z is lower-cased first.

Nulls: a null text, one without a letter, or any text where nothing could be learned is ``und`` with score 0. Rows
without lang, id or letters do not train. Repeated rows are scored alike; ids, lang and other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table, text_buffers

ORDER, PER_LANG, LANG_BYTES, MOST_LANGS = 4, 2000, 8 << 20, 256
NODES, MOST_COSTS, UNIT = 32768, 8_000_000, 16
BLOCK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def padded(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with ``ORDER`` line feeds before each text, and where each text's own bytes begin and end (n, 2)."""
    raw, off = text_buffers(col)
    shift = ORDER * np.arange(1, len(col) + 1)
    out = np.full(len(raw) + ORDER * len(col), 10, np.uint8)
    where = np.arange(len(raw)) + np.repeat(shift, np.diff(off))
    out[where] = _LOWER[raw]
    return out, np.stack([off[:-1] + shift, off[1:] + shift], axis=1)


def grams(data: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For every byte of the texts, its ``ORDER`` bytes before and itself, as one number."""
    at = own_places(spans)
    key = np.zeros(len(at), np.int64)
    for back in range(ORDER, -1, -1):
        key = (key << 8) | data[at - back]
    return key


def own_places(spans: np.ndarray) -> np.ndarray:
    size = spans[:, 1] - spans[:, 0]
    return np.arange(int(size.sum())) + np.repeat(spans[:, 0] - (np.cumsum(size) - size), size)


class Model:
    """langs; child: a context with one older byte; edge: a context's byte to its row of ``cost``; escape: by context."""

    def __init__(self, langs: list[str], child: np.ndarray, edge: np.ndarray, cost: np.ndarray, escape: np.ndarray):
        self.langs, self.child, self.edge, self.cost, self.escape = langs, child, edge, cost, escape

    def lengths(self, col: pa.Array) -> np.ndarray:
        """(texts, languages): code lengths in units of 2**-UNIT bits."""
        data, spans = padded(col)
        total = np.zeros((len(col), len(self.langs)), np.int64)
        size = spans[:, 1] - spans[:, 0]
        first = np.cumsum(size) - size
        places = own_places(spans)
        block = max(4096, BLOCK // max(1, len(self.langs)) * 4)
        for lo in range(0, len(places), block):
            at = places[lo : lo + block]
            bits = self._bits(data, at)
            inside = np.flatnonzero((first < lo + len(at)) & (first + size > lo) & (size > 0))
            total[inside] += np.add.reduceat(bits, np.maximum(first[inside] - lo, 0), axis=0, dtype=np.int64)
        return total

    def _bits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        node = np.zeros(len(at), np.int32)
        path = [node]
        for back in range(1, ORDER + 1):
            # 0 is the empty context, so as a child it says that there is none; a missing context has no children
            node = self.child[node, data[at - back]].astype(np.int32) * ((node > 0) | (back == 1))
            path.append(node)
        deepest = path[0].copy()
        depth = np.zeros(len(at), np.int8)
        for k, found in enumerate(path[1:], 1):
            np.copyto(deepest, found, where=found > 0)
            depth += found > 0
        symbol = data[at]
        row = self.edge[deepest, symbol]
        out = self.cost[row]  # row 0 costs nothing: those below are still to be paid
        left = np.flatnonzero(row == 0)
        while len(left):
            out[left] += self.escape[deepest[left]]
            ended = depth[left] == 0
            out[left[ended]] += 8 << UNIT
            left = left[~ended]
            depth[left] -= 1
            deepest[left] = np.choose(depth[left], [p[left] for p in path])
            row = self.edge[deepest[left], symbol[left]]
            out[left] += self.cost[row]
            left = left[row == 0]
        return out

    def predict(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score)."""
        bits = self.lengths(col)
        best = bits.argmin(axis=1)
        behind = (bits - bits.min(axis=1, keepdims=True)) / float(1 << UNIT)
        return best, 1 / np.exp2(-np.minimum(behind, 1000)).sum(axis=1)


def build(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, nodes: int = NODES, most_costs: int = MOST_COSTS) -> Model:
    """The frozen trees of counted (language, ORDER bytes and the next, n)."""
    width = len(langs)
    by_depth = []  # (context, byte, counts by language) of each order
    for k in range(ORDER + 1):
        keys, inverse = np.unique(gram & ((1 << (8 * (k + 1))) - 1), return_inverse=True)
        counts = np.zeros((len(keys), width), np.int64)
        np.add.at(counts, (inverse, lang), n)
        by_depth.append((keys >> 8, keys & 255, counts))
    # contexts by falling count; a shorter one is at least as frequent as those that end in it, and comes first
    tops, where, depths = [], [], []
    for k, (context, _, counts) in enumerate(by_depth):
        distinct, first, edges = np.unique(context, return_index=True, return_counts=True)
        tops.append(np.add.reduceat(counts.sum(axis=1), first) if len(first) else np.zeros(0, np.int64))
        where.append(np.stack([first, edges], axis=1))
        depths.append(np.stack([np.full(len(distinct), k), distinct], axis=1))
    top, spans, names = np.concatenate(tops), np.concatenate(where), np.concatenate(depths)
    order = np.lexsort((names[:, 1], names[:, 0], -top))[:nodes]
    rows_kept = np.cumsum(spans[order, 1])
    order = order[: max(1, int(np.searchsorted(rows_kept, most_costs // max(1, width), side="right")))]
    order = order[np.argsort(names[order, 0], kind="stable")]

    size, rows = len(order), int(spans[order, 1].sum())
    child, edge = np.zeros((size, 256), np.int32 if size > 65535 else np.uint16), np.zeros((size, 256), np.int32)
    cost, escape = np.zeros((rows + 1, width), np.int32), np.zeros((size, width), np.int32)
    number = {(int(k), int(c)): i for i, (k, c) in enumerate(names[order])}
    lengths = lambda share: np.rint(-np.log2(share) * (1 << UNIT)).astype(np.int32)
    at = 1
    for i, (k, context) in enumerate(names[order].tolist()):
        first, edges = spans[order[i]]
        seen = by_depth[k][2][first : first + edges]
        symbols = by_depth[k][1][first : first + edges]
        followed, kinds = seen.sum(axis=0), (seen > 0).sum(axis=0)
        all_ = np.maximum(followed + kinds, 1)
        escape[i] = np.where(followed > 0, lengths(np.where(followed > 0, kinds, 1) / np.where(followed > 0, all_, 1)), 0)
        if k:
            parent = number[k - 1, context & ((1 << (8 * (k - 1))) - 1)]
            child[parent, context >> (8 * (k - 1))] = i
            below = cost[edge[parent, symbols]]
        else:
            below = np.full((edges, width), 8 << UNIT, np.int32)
        cost[at : at + edges] = np.where(seen > 0, lengths(np.where(seen > 0, seen, 1) / np.where(seen > 0, all_, 1)), escape[i] + below)
        edge[i, symbols] = np.arange(at, at + edges)
        at += edges
    return Model(langs, child, edge, cost, escape)


def has_letter(text: str = "text") -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that never train: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, col in slices(batches):
        lang = np.asarray(batch.column("nth"))
        data, spans = padded(col)
        for one in np.unique(lang).tolist():
            found, n = np.unique(grams(data, spans[lang == one]), return_counts=True)
            yield pa.record_batch({"nth": pa.array(np.full(len(found), one, np.int32)), "gram": pa.array(found), "n": pa.array(n.astype(np.int64))})


def fit(docs: DataFrame, keep: Column | None = None, per_lang: int = PER_LANG, lang_bytes: int = LANG_BYTES) -> Model | None:
    """Train on a bounded hash sample of the rows that ``keep`` allows; None where nothing can be learned."""
    spark = docs.sparkSession
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if keep is None else keep) & has_letter()).select("doc_id", "lang", "text")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    if not sizes:
        return None
    sizes = sorted(sizes, key=lambda r: r.lang)
    share = [min(1.0, per_lang / r.n, lang_bytes / max(1, r.b)) for r in sizes]
    below = [(i, r.lang, 2**63 - 1 if s == 1 else int(2.0**64 * s) - 2**63) for i, (r, s) in enumerate(zip(sizes, share, strict=True))]
    # as many rows as there are languages, MOST_LANGS at most
    taken = F.broadcast(spark.createDataFrame(below, "nth int, lang string, below long"))
    sample = usable.join(taken, "lang").where(F.xxhash64("doc_id", F.lit(11)) <= F.col("below")).select("nth", "text")
    counts = sample.mapInArrow(_counted, "nth int, gram long, n long").groupBy("nth", "gram").agg(F.sum("n").alias("n"))
    langs = [r.lang for r in sizes]

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [tuple(np.asarray(b.column(c)) for c in ("nth", "gram", "n")) for b in batches]
        lang, gram, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        model = build(langs, lang, gram, n)
        parts = {"child": model.child, "edge": model.edge, "cost": model.cost, "escape": model.escape}
        for name, part in parts.items():
            yield pa.record_batch({"name": pa.array([name]), "kind": pa.array([part.dtype.str]), "width": pa.array([part.shape[1]], pa.int32()), "bytes": pa.array([part.tobytes()], pa.binary())})

    parts = {r.name: np.frombuffer(r.bytes, r.kind).reshape(-1, r.width) for r in counts.repartition(1).mapInArrow(trained, "name string, kind string, width int, bytes binary").collect()}
    return Model(langs, **parts)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    known = docs.select("doc_id", has_letter().alias("letters"), F.coalesce("text", F.lit("")).alias("text"))
    if model is None:
        return known.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    names = np.array([*model.langs, "und"], object)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in slices(batches):
            best, score = shared.value.predict(col)
            letters = np.asarray(batch.column("letters"))
            lang = names[np.where(letters, best, len(names) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0))], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return known.mapInArrow(scored, f"doc_id {kind}, lang_pred string, score double")


def op11(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
