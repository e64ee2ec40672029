"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last ``WINDOW`` lines ends a chunk where it divides by ``EVERY``; so a
passage is cut in the same places wherever it stands, whatever lines come before it. A chunk is taken with the
``MIN_LINES - 1`` lines behind it, so that each window of ``MIN_LINES`` lines lies in just one. Chunks that occur
again are removed whole, but for the first (least doc_id, then place). Of the first places of all chunks, the rolling
hash of every window and of every line of ``MIN_WORDS`` words is grouped too, each with its own first place: so every run
of at least ``MIN_LINES`` lines, or line of ``MIN_WORDS`` words, that stands at a lesser place is found, wherever chunks end. (The
first place of a window is in the first place of its chunk; other places of the chunk are removed with it.) What has
the hash of a first place is compared with it byte by byte. What is removed is always kept at a lesser
place, so no line is lost; a short line that many texts share stays.

Only hashes are grouped over the whole corpus. Texts of chunks and windows move only for hashes that occur twice, found in
a bitmap of fixed size that may let others pass; a join then drops those.

Nulls: a null text has no lines and stays null; a null doc_id sorts first. Rows of equal id and text are one document and are
treated alike. Empty tables stay empty. Other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Bitmap, free_name, quoted, row_key, slices, stage, table

WINDOW, EVERY, MAX_LINES, MIN_LINES, MIN_WORDS = 1, 2, 32, 2, 50
_M64 = (1 << 64) - 1
#: log2 of the bits of the bitmap: windows are more than chunks.
BITS = 26


def _roll(hashes: list[int], i: int, window: int = WINDOW) -> int:
    out = 0
    for h in hashes[max(0, i - window + 1) : i + 1]:
        out = (out * 0x9E3779B97F4A7C15 + h) & _M64
    return (out ^ (out >> 29)) * 0xBF58476D1CE4E5B9 & _M64


def _split(text: bytes) -> tuple[list[bytes], list[int], list[tuple[int, int]]]:
    """Lines, their hashes, and (first line, line behind the last) of each chunk."""
    lines = text.split(b"\n")
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    out, begin = [], 0
    for i in range(len(lines)):
        if _roll(hashes, i) >> 32 & (EVERY - 1) == 0 or i - begin + 1 == MAX_LINES or i + 1 == len(lines):
            out.append((begin, i + 1))
            begin = i + 1
    return lines, hashes, out


def chunks(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first line, number of lines, bytes) of each chunk; a chunk also ends after ``MAX_LINES``."""
    lines, _, parts = _split(text)
    return [(a, b - a, b"\n".join(lines[a:b])) for a, b in parts]


def anchors(text: bytes) -> tuple[list[bytes], list[list[tuple[int, int, int]]]]:
    """Lines, and by chunk (first line, number of lines, hash): first of the chunk with the lines behind it, then of each
    window that begins in it and of its long lines. Chunks without any window or long line are left out."""
    lines, hashes, parts = _split(text)
    out = []
    for a, b in parts:
        to = min(b + MIN_LINES - 1, len(lines))
        inner = [(j, MIN_LINES, _roll(hashes, j + MIN_LINES - 1, MIN_LINES)) for j in range(a, to - MIN_LINES + 1)]
        # so many words have at least so many bytes
        inner += [(j, 1, _roll(hashes, j, 1)) for j in range(a, b) if len(lines[j]) >= 2 * MIN_WORDS - 1 and len(lines[j].split()) >= MIN_WORDS]
        if inner:
            out.append([(a, to - a, xxhash.xxh3_64_intdigest(b"\n".join(lines[a:to]))), *inner])
    return lines, out


def _texts(col: pa.Array) -> Iterator[bytes]:
    return (x.as_py() for x in col.cast(pa.large_binary()))


def _longs(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, np.uint64).view(np.int64))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, col in slices(batches):
        n, at, whole, inner = [0], [0], [], []
        for text in _texts(col):
            for (_, _, h), *rest in anchors(text)[1] if text else []:
                whole.append(h)
                inner += [x for _, _, x in rest]
                at.append(len(inner))
            n.append(len(whole))
        found = pa.StructArray.from_arrays([_longs(whole), pa.ListArray.from_arrays(pa.array(at, pa.int32()), _longs(inner))], ["h", "inner"])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.ListArray.from_arrays(pa.array(n, pa.int32()), found)], ["id", "key", "chunks"])


def _repeated(bitmap: Bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in slices(batches):
            rows: list[tuple] = []
            for i, text in enumerate(_texts(col)):
                if not text:
                    continue
                lines, own = anchors(text)
                all_ = [(place, nth - 1, *x) for place, c in enumerate(own) for nth, x in enumerate(c)]
                h = np.array([x[-1] for x in all_], np.uint64)
                for j in np.flatnonzero(bitmap.has(h)).tolist():
                    place, nth, line, n, _ = all_[j]
                    rows.append((i, place, nth, int(h[j].view(np.int64)), line, n, b"\n".join(lines[line : line + n])))
            at, place, nth, h, line, n, text = zip(*rows, strict=True) if rows else ((),) * 7
            take = pa.array(at, pa.int32())
            text = pa.array(text, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("key").take(take), *(pa.array(x, pa.int32()) for x in (place, nth)), pa.array(h, pa.int64()), *(pa.array(x, pa.int32()) for x in (line, n)), text],
                ["id", "key", "place", "nth", "h", "line", "n", "lines"],
            )

    return run


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(key, line, n): runs of lines to remove, staged; those that touch are one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), row_key("doc_id").alias("key"), "text")
    hashed = keyed.mapInArrow(_hashes, f"id {kind}, key string, chunks array<struct<h: long, inner: array<long>>>")
    hashed = hashed.select("id", "key", F.posexplode("chunks").alias("place", "c")).select("id", "key", "place", F.lit(-1).alias("nth"), "c.h", "c.inner")
    # rows that repeat share a key and are one place
    place = F.struct("id", "key", "place", "nth")
    least, greatest = F.min(place).alias("first"), F.max(place).alias("last")
    whole = stage(hashed.groupBy("h").agg(F.min(F.struct("id", "key", "place", "nth", "inner")).alias("least"), greatest), "chunks")
    whole = whole.select("h", F.struct("least.id", "least.key", "least.place", "least.nth").alias("first"), "last", F.col("least.inner").alias("inner"))
    inner = whole.select("first.id", "first.key", "first.place", F.posexplode("inner").alias("nth", "h")).groupBy("h").agg(least, greatest)
    many = whole.drop("inner").unionByName(inner).where(F.col("first") != F.col("last"))
    many = stage(many.select("h", (F.col("first.nth") < 0).alias("whole"), "first"), "repeated")
    bitmap = Bitmap.build(many, "h", BITS)
    fields = f"id {kind}, key string, place int, nth int, h long, line int, n int, lines string"
    found = stage(keyed.mapInArrow(_repeated(bitmap), fields).withColumn("whole", F.col("nth") < 0).join(many, ["h", "whole"]), "texts")
    is_first = place.eqNullSafe(F.col("first"))
    model = found.where(is_first).groupBy("h", "whole").agg(F.first("lines").alias("lines_1"))
    rest = found.where(~is_first).join(model, ["h", "whole"]).where(F.col("lines") == F.col("lines_1"))
    run = rest.select("key", "line", (F.col("line") + F.col("n")).alias("end"))
    before = Window.partitionBy("key").orderBy("line", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = run.withColumn("opens", F.coalesce(F.max("end").over(before) < F.col("line"), F.lit(True)).cast("int"))
    nth_run = F.sum("opens").over(Window.partitionBy("key").orderBy("line", "end").rowsBetween(Window.unboundedPreceding, 0))
    joined = opens.withColumn("run", nth_run).groupBy("key", "run").agg(F.min("line").alias("line"), F.max("end").alias("end"))
    return stage(joined.select("key", "line", (F.col("end") - F.col("line")).alias("n")), "runs")


def dedup(docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` without the repeated runs; with ``counts`` also _lines and _removed, with a number where a column has such a name. A text that loses every line becomes empty."""
    key, own = free_name("_key", docs.columns), free_name("_runs", docs.columns)
    runs = repeated_runs(docs).groupBy(F.col("key").alias(key)).agg(F.collect_set(F.struct("line", "n")).alias(own))
    lines = F.split("text", "\n", -1)
    gone = lambda i: F.exists(own, lambda r: (i >= r["line"]) & (i < r["line"] + r["n"]))
    kept = F.filter(lines, lambda _, i: ~gone(i))
    # runs grow with the corpus: the plan is the same shuffle at every size
    joined = docs.withColumn(key, row_key("doc_id")).join(runs.hint("merge"), key, "left")
    text = F.when(F.col(own).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    more = []
    if counts:
        before = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(lines)).cast("long")
        gone_n = F.when(F.col(own).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
        more = [before.alias(free_name("_lines", docs.columns)), gone_n.alias(free_name("_removed", docs.columns))]
    return joined.select(*[text.alias("text") if c == "text" else F.col(quoted(c)) for c in docs.columns], *more)


def op1(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.octet_length(kept).cast("long").alias("kept_bytes"), F.sha2(kept, 256).alias("kept_sha256"))
