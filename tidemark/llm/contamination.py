"""Benchmark decontamination by winnowing.

Every text is fingerprinted: of the k-grams of ``K`` words, the least hash of each window of ``W`` of them is
kept, so two texts that share ``SPAN = K + W - 1`` words in a row keep a common fingerprint. Training and
test fingerprints are joined, and each meeting is extended to the whole test windows around it, compared
word by word: the result is exact, hashes only find candidates.

The test side first fills a bitmap of fixed size, and training fingerprints that it does not hold never
leave the scan. Those that pass carry the words around them, so no text is read or shuffled again.

An item of fewer than ``SPAN`` words, but not none, is one window; its hash stands for itself.

Nulls: null texts have no words. Rows of a null item id hit words but are not listed. Rows with equal id and
text get the same result, one for each row; equal ids with other texts are told apart. Empty tables give no
rows, or rows without hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Bitmap, free_name, own_columns, row_key, slices, stage, table
from tidemark.llm.words import Words

K, W = 6, 5
SPAN = K + W - 1
_CANDS = "array<struct<fp:long,at:long,lo:long,words:string>>"


def winnow(words: Words, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window of SPAN words, the k-gram it keeps: the least hash, the last of equals)."""
    start = np.flatnonzero(words.fits(SPAN))
    best = start + (W - 1)
    low = grams[best] if len(start) else np.empty(0, np.uint64)
    for j in range(W - 2, -1, -1):
        other = grams[start + j]
        less = other < low
        best = np.where(less, start + j, best)
        low = np.where(less, other, low)
    return start, best


def _test_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, col in slices(batches):
        words = Words(col)
        start, best = winnow(words, grams := words.grams(K))
        n = np.full(len(start), SPAN)
        fp = grams[best]
        for size in sorted(set(words.count[(words.count > 0) & (words.count < SPAN)].tolist())):
            own = words.first[:-1][words.count == size]
            start, best, n = np.concatenate([start, own]), np.concatenate([best, own]), np.concatenate([n, np.full(len(own), size)])
            fp = np.concatenate([fp, words.grams(size)[own]])
        yield pa.record_batch(
            {
                "item_id": batch.column("item_id").take(pa.array(words.doc[start])).cast(pa.string()),
                "fp": pa.array(fp.view(np.int64)),
                "off": pa.array(best - start),
                "n": pa.array(n),
                "win": pa.array([words.text(s, s + k).decode() for s, k in zip(start.tolist(), n.tolist(), strict=True)], pa.string()),
            }
        )


def test_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, fp, off, n, win): each window of each item, the fingerprint it keeps and where in it."""
    return benchmark.select("item_id", "text").mapInArrow(_test_windows, "item_id string, fp long, off long, n long, win string")


def _candidates(bitmap: Bitmap, short: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in slices(batches):
            words = Words(col)
            grams = words.grams(K)
            at = np.unique(winnow(words, grams)[1])
            at = at[bitmap.has(grams[at])] if len(at) else at
            found = [(at, grams[at], np.maximum(at - (W - 1), words.first[words.doc[at]]), np.minimum(at + SPAN, words.first[words.doc[at] + 1]))]
            for size in short:
                own = np.flatnonzero(words.fits(size))
                h = words.grams(size)[own]
                keep = bitmap.has(h) if len(h) else np.zeros(0, bool)
                found.append((own[keep], h[keep], own[keep], own[keep] + size))
            at, fp, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(at, kind="stable")
            at, fp, lo, hi = at[order], fp[order], lo[order], hi[order]
            base = words.first[words.doc[at]]
            rows = pa.StructArray.from_arrays(
                [
                    pa.array(fp.view(np.int64)),
                    pa.array(at - base),
                    pa.array(lo - base),
                    pa.array([words.text(a, b).decode() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.string()),
                ],
                ["fp", "at", "lo", "words"],
            )
            bounds = np.searchsorted(words.doc[at], np.arange(len(col) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), pa.array(words.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), rows)],
                ["key", "doc_id", "n_words", "cands"],
            )

    return run


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: key, doc_id, n_words), (spans: key, at, n), (pairs: key, item_id), all staged or small."""
    tests = stage(test_windows(benchmark), "test-windows")
    short = sorted(r.n for r in tests.where(F.col("n") < SPAN).select("n").distinct().collect())  # nine values at most
    keyed = docs.select(row_key("doc_id").alias("key"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    bitmap = Bitmap.build(tests, "fp")
    rows = stage(keyed.mapInArrow(_candidates(bitmap, short), f"key string, doc_id {kind}, n_words long, cands {_CANDS}"), "fingerprints")
    cands = rows.where(F.size("cands") > 0).select("key", F.inline("cands")).distinct()
    wins = tests.select("fp", "off", "n", "win").distinct()
    begin = F.col("at") - F.col("off")
    spans = (
        cands.join(wins, "fp")
        .where((begin >= F.col("lo")) & (F.array_join(F.slice(F.split("words", " "), (begin - F.col("lo") + 1).cast("int"), F.col("n").cast("int")), " ") == F.col("win")))
        .select("key", begin.alias("at"), "n", "win")
        .distinct()
    )
    spans = stage(spans, "spans")
    pairs = spans.select("key", "win").distinct().join(tests.where(F.col("item_id").isNotNull()).select("win", "item_id").distinct(), "win").select("key", "item_id").distinct()
    return rows.select("key", "doc_id", "n_words"), spans.select("key", "at", "n"), pairs


def covered(spans: DataFrame) -> DataFrame:
    """(key, n_hit): words in the union of a document's spans."""
    by = Window.partitionBy("key").orderBy("at", "n")
    before = F.coalesce(F.max(F.col("at") + F.col("n")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = F.col("at") + F.col("n")
    return spans.distinct().select("key", F.greatest(F.lit(0), end - F.greatest("at", before)).alias("new")).groupBy("key").agg(F.sum("new").alias("n_hit"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, spans, pairs = hits(docs, benchmark)
    items = pairs.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = covered(spans).join(items, "key", "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, "key", "left").select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any test window, with their columns as they were."""
    _, spans, _ = hits(docs, benchmark)
    key = free_name("_key", docs.columns)
    bad = spans.select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_key("doc_id")).join(bad, key, "left_anti").select(*own_columns(docs))


def op3(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
with d as (select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bp as (select item_id, w, len(w) as len, unnest(range(1, greatest(len(w) - 8, 2))) as i from b where len(w) > 0),
bw as (select distinct item_id, least(len, 10) as n, array_to_string(w[i:i + 9], ' ') as win from bp),
ns as (select distinct n from bw),
dp as (select k, doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
dw as (select k, i, list(word) over (partition by k order by i rows between current row and 9 following) as ten from dp),
hit as (select distinct dw.k, dw.i, ns.n, bw.item_id from dw, ns join bw on bw.n = ns.n where len(dw.ten) >= ns.n and array_to_string(dw.ten[1:ns.n], ' ') = bw.win),
word_hits as (select k, count(distinct p) as n_hit from (select k, unnest(range(i, i + n)) as p from hit) group by k),
item_hits as (select k, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct k, cast(item_id as varchar) as item from hit) group by k)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join word_hits using (k) left join item_hits using (k)
"""
