"""Near-duplicate classes by DartMinHash.

A text is the multiset of its shingles of ``SHINGLE`` words (all its words, if fewer), weighted by how often each
stands in it. Over each unit of an element's weight hashed darts fall as a Poisson process along a rank axis;
each dart names one of ``BANDS * ROWS`` coordinates, and a coordinate keeps its dart of least rank. Darts come from
the element, the unit and the rank region alone, so texts that share weight share darts, and two texts agree in a
coordinate with the probability of their weighted Jaccard similarity. Ranks are thrown up to about ``k ln k + k`` darts
a text; a text with an empty coordinate is thrown again up to twice the rank.

Texts of equal words are one node from the start, however many there are. Nodes that agree in all
rows of a band share a bucket; there everyone is compared with one leader, the member whose own buckets are the fullest: a text
at the middle of its group, if there is one. Similarities are of whole sets, whose cells are told apart by 32 bits of their hashes. Components of the links
found are joined by large and small stars.

Buckets that still hold several components are looked at again, by an exact prefix filter over the texts in them. Cells are ordered:
first those of one component alone, which no pair of two components shares, then by how many of these texts have them. Two
texts that can be similar have a number of cells in common that follows from their sizes, so they share one of the few first cells of
each. Texts of different components meet on such cells only, and those of the component that has most texts of a cell do not
meet each other. So a group of n near
copies costs about n comparisons a band, and no link between members of a bucket that could change a class is skipped.

Nulls: null and empty texts have no words and are copies of each other. A null doc_id is a row like any other. Rows that
repeat fall into one class. Class ids are the least doc_id of the class, null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Bitmap, free_name, mix, own_columns, row_key, slices, stage, table
from tidemark.llm.words import Words

SHINGLE, BANDS, ROWS, SIMILAR = 5, 20, 4, 0.8
_K = BANDS * ROWS
_LEAST = 6  # the lowest rank region is [0, 2**-_LEAST)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_REGION, _COUNT = np.array([0xA24BAED4963EE407], np.uint64), np.array([0x9FB21C651E98DF25], np.uint64)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _darts(cell: np.ndarray, room: np.ndarray | None, region: np.ndarray | int, low: np.ndarray | float, length: float):
    """(index of the cell, rank, hash) of the darts that fall into a rank region of the cells; room: the share of a cell that its weight fills."""
    seed = mix(cell + _REGION * np.asarray(region, np.uint64))
    u, p, total = _unit(seed), np.exp(-length), np.exp(-length)
    at, out, count = np.flatnonzero(u > total), [], 1
    while len(at):
        h = mix(seed[at] + _COUNT * np.uint64(count))
        out.append((at, h))
        p *= length / count
        total += p
        count += 1
        at = at[u[at] > total]
        if count > 40:
            break
    if not out:
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint64)
    at, h = (np.concatenate(x) for x in zip(*out, strict=True))
    rank = (low if np.isscalar(low) else low[at]) + length * _unit(mix(h + np.uint64(1)))
    if room is not None:
        fits = _unit(mix(h + np.uint64(2))) <= room[at]
        at, rank, h = at[fits], rank[fits], h[fits]
    return at, rank, h


def dart_minhash(doc: np.ndarray, cell: np.ndarray, n: int, k: int = _K, room: np.ndarray | None = None) -> np.ndarray:
    """(n, k) signatures; ``cell`` holds one hash for each unit of weight of each element, ``doc`` its text in order.

    ``room`` below 1 marks a unit that the element's weight fills only in part, so weights need not be whole.
    """
    sig = np.full(n * k, _EMPTY)
    weight = np.bincount(doc, weights=room, minlength=n).astype(float)
    reach = np.zeros(n)
    np.divide(k * np.log(k) + k, weight, out=reach, where=weight > 0)
    todo = weight > 0
    while todo.any():
        mine = np.flatnonzero(todo[doc])
        own_doc, own, own_room = doc[mine], cell[mine], None if room is None else room[mine]
        parts = []
        top = reach[own_doc]
        for level in range(_LEAST + 1):
            low = 0.0 if level == 0 else 2.0 ** (level - 1 - _LEAST)
            length = 2.0**-_LEAST if level == 0 else low
            active = np.flatnonzero(top > low)
            if not len(active):
                break
            at, rank, h = _darts(own[active], None if own_room is None else own_room[active], level, low, length)
            parts.append((own_doc[active[at]], rank, h))
        units = np.maximum(np.ceil(top) - 1, 0).astype(np.int64)
        if units.any():
            who = np.repeat(np.arange(len(own)), units)
            step = np.arange(len(who)) - np.repeat(np.cumsum(units) - units, units) + 1
            at, rank, h = _darts(own[who], None if own_room is None else own_room[who], step + _LEAST, step.astype(float), 1.0)
            parts.append((own_doc[who[at]], rank, h))
        for d, rank, h in parts:
            value = np.minimum(rank * 2.0**40, 2.0**63).astype(np.uint64) & ~np.uint64(0xFFFF) | h >> np.uint64(48)
            np.minimum.at(sig, d * k + ((h & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64), value)
        todo &= (sig.reshape(n, k) == _EMPTY).any(axis=1)
        reach[todo] *= 2
    return sig.reshape(n, k)


def _digest(words: Words, n: int) -> list[bytes]:
    """Sixteen bytes that tell word sequences apart."""
    out = np.zeros((n, 2), np.uint64)
    some = np.flatnonzero(words.count)
    place = (np.arange(len(words.start)) - words.first[words.doc]).astype(np.uint64)
    for j, odd in enumerate((np.uint64(0xD6E8FEB86659FD93), np.uint64(0xCA5A826395121157))):
        if len(some):
            out[some, j] = mix(np.add.reduceat(mix(words.hash * odd + place), words.first[some]) + words.count[some].astype(np.uint64))
    return [x.tobytes() for x in out]


def _cells(words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every occurrence of a shingle, the second of a shingle apart from the first."""
    at = np.flatnonzero(words.fits(SHINGLE))
    doc, h = words.doc[at], words.grams(SHINGLE)[at]
    for size in range(1, SHINGLE):
        own = np.flatnonzero(words.count == size)
        if len(own):
            doc, h = np.concatenate([doc, own]), np.concatenate([h, words.grams(size)[words.first[own]]])
    if keep is not None:
        doc, h = doc[keep[doc]], h[keep[doc]]
    with_doc = mix(h + doc.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    order = np.argsort(with_doc, kind="stable")
    doc, h, s = doc[order], h[order], with_doc[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    cell = mix(h + nth.astype(np.uint64) * np.uint64(0x589965CC75374CC3))
    order = np.argsort(doc, kind="stable")
    return doc[order], cell[order]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)[:ROWS]
    for batch, col in slices(batches):
        words, n = Words(col), len(col)
        sig = dart_minhash(*_cells(words), n).reshape(n, BANDS, ROWS)
        bands = mix((sig * odd).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)
        has = words.count > 0
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)), pa.array(bands[has].ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(_digest(words, n), pa.binary()), lists], ["key", "doc_id", "node", "bands"])


def _sets(bitmap: Bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, col in slices(batches):
            words, n = Words(col), len(col)
            nodes = _digest(words, n)
            keep = bitmap.has(np.array([int.from_bytes(x[:8], "little") for x in nodes], np.uint64))
            seen: set[bytes] = set()
            for i in np.flatnonzero(keep).tolist():  # copies within a slice: once
                keep[i] = nodes[i] not in seen
                seen.add(nodes[i])
            doc, cell = _cells(words, keep)
            bounds = np.searchsorted(doc, np.arange(n + 1))
            own = [np.unique((cell[a:b] >> np.uint64(32)).astype(np.uint32)).view(np.int32) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if b > a]
            picked = [nodes[i] for i in range(n) if bounds[i + 1] > bounds[i]]
            yield pa.record_batch({"node": pa.array(picked, pa.binary()), "cells": pa.array(own, pa.list_(pa.int32()))})

    return run


def _star(edges: DataFrame) -> DataFrame:
    """One turn of large and small stars over edges (u, v), u > v; what was connected stays so, and nothing else gets so."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
    return stage(small.where("u <> v").distinct(), "stars")


def _edges(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of links (a, b), by alternating large and small stars; roots are left out."""
    edges, before = _edges(links), None
    while True:
        edges = _star(edges)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with their similarity."""
    a, b = (sets.select(F.col("node").alias(x), F.col("cells").alias(f"cells_{x}")) for x in "ab")
    both = F.size(F.array_intersect("cells_a", "cells_b"))
    return pairs.join(b, "b").join(a, "a").select(*pairs.columns, (both / (F.size("cells_a") + F.size("cells_b") - both)).alias("sim"))


def _rooted(rows: DataFrame, roots: DataFrame, at: str, name: str) -> DataFrame:
    """``rows`` with the root of node ``at`` as ``name``; a node that is not in ``roots`` is its own."""
    found = roots.select(F.col("node").alias(at), F.col("root").alias("_root"))
    return rows.join(found, at, "left").withColumn(name, F.coalesce("_root", at)).drop("_root")


def _late_links(grouped: DataFrame, roots: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(a, b): similar texts of different components that are both in buckets of several components."""
    placed = _rooted(grouped.select("bucket", "b"), roots, "b", "root")
    torn = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    texts = stage(placed.join(torn, "bucket", "left_semi").groupBy("b").agg(F.first("root").alias("root")), "torn")
    cells = texts.join(sets.withColumnRenamed("node", "b"), "b").select("b", "root", F.explode("cells").alias("cell"))
    often = cells.groupBy("cell").agg(F.count("*").alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    often = often.select("cell", F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.col("k")).alias("k"))
    # a list is as long as its text
    ordered = cells.join(often, "cell").groupBy("b").agg(F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("k", "cell"))).alias("cells"))
    n = F.size("cells")
    ahead = F.least(n, n - F.ceil(n * similar - 1e-6).cast("int") + 1)
    heads = ordered.select("b", "root", n.alias("n"), F.posexplode(F.slice("cells", 1, ahead)).alias("at", "c")).where("c.k > 0").select("b", "root", "n", "at", "c.cell")
    heads = stage(heads, "heads")
    each = heads.groupBy("cell", "root").agg(F.count("*").alias("k"))
    main = each.groupBy("cell").agg(F.max(F.struct("k", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("cell", F.col("m.root").alias("main"))
    heads = stage(heads.join(main, "cell"), "heads-main")
    x, y = (heads.select("cell", "main", *[F.col(c).alias(f"{c}_{s}") for c in ("b", "root", "n", "at")]) for s in "xy")
    once = (F.col("root_x") != F.col("root_y")) & ((F.col("root_y") == F.col("main")) | (F.col("b_x") < F.col("b_y")))
    least = F.ceil((F.col("n_x") + F.col("n_y")) * (similar / (1 + similar)) - 1e-6)  # cells that both must have
    early = (F.col("at_x") <= F.col("n_x") - least) & (F.col("at_y") <= F.col("n_y") - least)
    met = x.where("root_x <> main").join(y.drop("main"), "cell").where(once & early)
    pairs = met.select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")).distinct()
    return stage(_compared(pairs, sets).where(F.col("sim") >= similar).select("a", "b"), "late-links")


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(key, doc_id, class_key, class_id) of every row; ``class_key`` is the key of the row that stands for the class."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(row_key("doc_id").alias("key"), "doc_id", "text")
    signed = stage(keyed.mapInArrow(_signed, f"key string, doc_id {kind}, node binary, bands array<long>"), "signatures")
    nodes = signed.where(F.size("bands") > 0).groupBy("node").agg(F.first("bands").alias("bands"))
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(members.join(shared, "bucket").select("bucket", F.col("node").alias("b"), "n"), "shared-buckets")
    # rows of a node are as many as bands, at most
    fullness = shared.groupBy("b").agg(F.sum("n").alias("fullness"))
    ranked = shared.select("bucket", "b").join(fullness, "b")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("fullness", "b")).alias("lead")).select("bucket", F.col("lead.b").alias("a"))
    grouped = stage(ranked.join(leaders, "bucket").select("bucket", "a", "b"), "buckets")
    bitmap = Bitmap.build(grouped.select(_head("b").alias("h")), "h")
    sets = stage(keyed.mapInArrow(_sets(bitmap), "node binary, cells array<int>").groupBy("node").agg(F.first("cells").alias("cells")), "sets")
    pairs = grouped.where("a <> b").select("a", "b").distinct()
    led = stage(_compared(pairs, sets).where(F.col("sim") >= similar).select("a", "b"), "led")
    stars = _star(_star(_edges(led)))
    connected = stars.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    late = _late_links(grouped, connected, sets, similar)
    roots = components(stars.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(late))
    # texts that repeat meet by node first, so that only one row of each node goes on
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")  # nulls last: a class is named by an id if it has one
    named = _rooted(signed.groupBy("node").agg(F.min(row).alias("f")), roots, "node", "root")
    named = stage(named, "named")
    first = stage(named.groupBy("root").agg(F.min("f").alias("f")), "first")
    named = named.select("node", "root").join(first, "root")
    return signed.select("key", "doc_id", "node").join(named, "node").select("key", "doc_id", F.col("f.key").alias("class_key"), F.col("f.doc_id").alias("class_id"))


def _head(node: str):
    """The first eight bytes of a node as the little-endian number that Python makes of them."""
    return F.expr(f"cast(conv(concat({', '.join(f'hex(substring({node}, {i}, 1))' for i in range(8, 0, -1))}), 16, -10) as bigint)")


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each class, of least doc_id; of rows of equal id and text, any one."""
    key = free_name("_key", docs.columns)
    kept = classes(docs, similar).select(F.col("class_key").alias(key)).distinct()
    # rows that repeat are dropped before the shuffle as well as behind it
    once = docs.withColumn(key, row_key("doc_id")).dropDuplicates([key])
    return once.join(kept, key, "left_semi").select(*own_columns(docs))


def op6(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("key") == F.col("class_key")).alias("kept"))
