"""How the tokens of two tokenizers lie on the same bytes.

A is byte-level BPE over a blank and the text; B is piece BPE, which adds that blank itself. Where a token of A and one
of B end at the same byte, the text is cut into groups; every A and B token whose bytes overlap are linked.

Texts are first cut at places where both vocabularies must end a token: A's pattern ends there, and no piece of B has
the two characters around the place side by side (``Cuts`` asks the vocabulary itself). Nothing crosses such a place,
so tokens, groups and links of a text are those of its units in order, and each distinct unit of the corpus is encoded
and aligned once. The alignment is relational: tokens are posexploded, windowed sums of their lengths give ends, an
equi-join on (unit, end) gives cuts, running counts of cuts give group ids, and a range join by group and cells of
``CELL`` bytes gives links, however long a unit is. A pair's count weighs each link by how often its unit occurs.

Units of a task's texts (``SLICE_BYTES`` at most, or one text if that is longer) share a dictionary. Texts are kept as
codes of it; what the alignment says of each dictionary entry meets the codes by a cogroup of the slice, which adds up
numbers and joins group strings. So rows that shuffle are distinct words of a slice, not tokens.

Nulls: a null or empty text has no tokens, and so has a text whose tokens do not give its bytes back: one that holds
U+2581, or any other whose units fail the same check. Such texts count for no pair. Ids may be null or repeat; every
row gives one row. Columns beside doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stage, table, unstage

SLICE_BYTES, LONG, CELL, BATCH = 64 << 20, 1 << 22, 32, 2000
BLANK = "▁"
#: Letters whose runs are words for both, and marks that may stand between them; an apostrophe never does.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", '.,;:!?|"$%&*#()[]{}<>=+/@^~'
_TOKENS = "array<struct<id:int,len:int>>"
STATS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes each byte as one visible character: itself if it is one, else the next from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both encoders, over units; files of the formats of ``tokenizers`` and ``sentencepiece``."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte_of = _byte_of()
        self.a_bytes = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        by_word = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        pieces = [self.b.id_to_piece(i) for i in range(n) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        # a line feed before a unit is a token of its own in B, if no piece holds one; else texts stay whole
        self.cuts = cuts(pieces) if by_word and not any("\n" in p for p in pieces) else re.compile(r"(?s).+")

    def units(self, text: str) -> Iterator[list[str]]:
        """The units of a blank and ``text``, some at a time."""
        if len(text) < LONG:
            yield self.cuts.findall(" " + text)
            return
        found = (m.group() for m in self.cuts.finditer(" " + text))
        while part := list(islice(found, LONG // 8)):
            yield part

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        # B adds a blank: in place of the unit's own, or before a line feed that is dropped with it; of nothing it makes nothing
        led = [len(u) > 1 and u[0] == " " for u in units]
        found = self.b.encode([u[1:] if x else "\n" + u for u, x in zip(units, led, strict=True)], num_threads=1)
        return a, [ids if x else ids[2:] for ids, x in zip(found, led, strict=True)]


def cuts(pieces: list[str]) -> re.Pattern:
    """The units: words, runs of marks and single line feeds, where the pieces allow it, else up to the next blank. No piece holds a line feed."""
    pairs = {x for p in pieces for x in zip(p, p[1:])}  # noqa: B905
    if any(b == BLANK and a != BLANK for a, b in pairs):
        return re.compile(r"(?s).+")
    letter = re.compile(f"[{LETTERS}]")
    tied = {m for a, b in pairs for m, other in ((a, b), (b, a)) if m in MARKS and letter.match(other)}
    marks = re.escape("".join(m for m in MARKS if m not in tied))
    kinds = [rf" ?[{LETTERS}]++(?=[ \n{marks}]|\Z)", rf" ?[{marks}]++(?=[ \n{LETTERS}]|\Z)" if marks else "", r"\n(?=\S)", r"(?s:.+?\S(?=[ \n]|\Z)|.+)"]
    return re.compile("|".join(k for k in kinds if k))


_loaded: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
    return _loaded[a_path, b_path]


def _dictionaries(a_path: str, b_path: str, kind: pa.DataType, sift: bool):
    """Rows of texts (slice, row, doc_id, codes) and of their slice's dictionary (slice, code, unit, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both = _tokenizers(a_path, b_path)
        names = ["slice", "row", "doc_id", "codes", "code", "unit", "n"]
        types = [pa.int64(), pa.int64(), kind, pa.list_(pa.int32()), pa.int32(), pa.string(), pa.int64()]
        task, nth, row, size = TaskContext.get().partitionId(), 0, 0, 0
        known: defaultdict[str, int] = defaultdict()
        known.default_factory = known.__len__
        count = np.zeros(0, np.int64)

        def entries() -> Iterator[pa.RecordBatch]:
            units = list(known)
            for at in range(0, len(units), 100_000):
                part = units[at : at + 100_000]
                own = {"slice": [task << 32 | nth] * len(part), "code": np.arange(at, at + len(part), dtype=np.int32), "unit": part, "n": count[at : at + len(part)]}
                yield pa.RecordBatch.from_arrays([pa.array(own[c], t) if c in own else pa.nulls(len(part), t) for c, t in zip(names, types, strict=True)], names)

        for batch, col in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            codes = []
            for text in col.to_pylist():
                mine = [np.fromiter(map(known.__getitem__, part), np.int32, len(part)) for part in both.units(text)] if text and not (sift and BLANK in text) else []
                codes.append(np.concatenate(mine) if mine else np.zeros(0, np.int32))
            size += sum(len(c) for c in codes) * 5
            count = np.concatenate([count, np.zeros(len(known) - len(count), np.int64)])
            count += np.bincount(np.concatenate(codes), minlength=len(known))
            own = {"slice": [task << 32 | nth] * len(ids), "row": np.arange(row, row + len(ids)), "doc_id": ids, "codes": codes}
            row += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(own[c], t) if c in own else pa.nulls(len(ids), t) for c, t in zip(names, types, strict=True)], names)
            if size >= SLICE_BYTES:
                yield from entries()
                nth, size = nth + 1, 0
                known.clear()
                count = np.zeros(0, np.int64)
        yield from entries()

    return run


def _encoded(a_path: str, b_path: str):
    def lists(found: list[list[int]], lengths) -> pa.Array:
        off = np.cumsum([0, *map(len, found)])
        flat = [i for ids in found for i in ids]
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays([pa.array(flat, pa.int32()), pa.array([lengths[i] for i in flat], pa.int32())], ["id", "len"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(a_path, b_path)
        a_len, b_len = {i: len(x) for i, x in both.a_bytes.items()}, [len(x) for x in both.b_bytes]
        for batch, col in slices(batches, "unit"):
            for at in range(0, batch.num_rows, BATCH):
                part, units = batch.slice(at, BATCH), col.slice(at, BATCH).to_pylist()
                a, b = both.encode(units)
                same = [b"".join(map(both.a_bytes.__getitem__, x)) == (u8 := u.encode()) == b"".join(map(both.b_bytes.__getitem__, y)) for u, x, y in zip(units, a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(same), lists(a, a_len), lists(b, b_len)], [*part.schema.names, "same", "a", "b"])

    return run


@contextmanager
def dealt_by_less(spark: SparkSession) -> Iterator[None]:
    """Within, a join takes rows as they are dealt if both sides are dealt alike by some of its keys."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tokens(units: DataFrame, side: str) -> DataFrame:
    """(uid, pos, id, begin, end) of one side's tokens, posexploded; bytes by windowed sums of lengths."""
    each = units.select("uid", F.posexplode(side).alias("pos", "t")).select("uid", "pos", "t.id", "t.len")
    end = F.sum("len").over(Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("end", end).select("uid", "pos", "id", (F.col("end") - F.col("len")).alias("begin"), "end")


def grouped(mine: DataFrame, other: DataFrame) -> DataFrame:
    """``mine`` with the number of its group: how many cuts, ends of both sides, lie before it."""
    cut = mine.join(other.select("uid", "end", F.lit(1).alias("cut")), ["uid", "end"], "left")
    before = Window.partitionBy("uid").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("group", F.coalesce(F.sum(F.coalesce("cut", F.lit(0))).over(before), F.lit(0)).cast("int")).drop("cut")


def links(a: DataFrame, b: DataFrame) -> DataFrame:
    """(uid, a_id, b_id): each pair of tokens of a group whose bytes overlap, met in the cell where the overlap begins."""

    def in_cells(side: DataFrame, name: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col("begin") / CELL), F.floor((F.col("end") - 1) / CELL))
        cols = [F.col(c).alias(f"{name}_{c}") for c in ("id", "begin", "end")]
        return side.select("uid", "group", *cols, F.explode(cells).alias("cell"))

    met = in_cells(a, "a").join(in_cells(b, "b"), ["uid", "group", "cell"])
    begin = F.greatest("a_begin", "b_begin")
    return met.where((begin < F.least("a_end", "b_end")) & (F.floor(begin / CELL) == F.col("cell"))).select("uid", "a_id", "b_id")


def strings(a: DataFrame, b: DataFrame) -> DataFrame:
    """(uid, n_a, n_b, n_groups, groups): ``a1,a2|b1;a3|b2,b3`` of each unit."""
    both = a.select("uid", F.lit(0).alias("side"), "group", "pos", "id").unionByName(b.select("uid", F.lit(1).alias("side"), "group", "pos", "id"))
    rows = both.groupBy("uid").agg(
        F.count_if(F.col("side") == 0).alias("n_a"), F.count_if(F.col("side") == 1).alias("n_b"), (F.max("group") + 1).cast("long").alias("n_groups"), F.array_sort(F.collect_list(F.struct("group", "side", "pos", "id"))).alias("t")
    )
    mark = "case when i = 0 then '' when x.group != t[i - 1].group then ';' when x.side != t[i - 1].side then '|' else ',' end"
    return rows.select("uid", "n_a", "n_b", "n_groups", F.expr(f"array_join(transform(t, (x, i) -> concat({mark}, x.id)), '')").alias("groups"))


def pair_counts(linked: DataFrame) -> DataFrame:
    """(a_id, b_id, pairs, best): how many links of the corpus hold the pair, and whether that is the most of its B id."""
    counts = linked.groupBy("a_id", "b_id").agg(F.sum("n").alias("pairs"))
    return counts.withColumn("best", F.col("pairs") == F.max("pairs").over(Window.partitionBy("b_id")))


def aligned(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unit, its numbers and group string), and the pair counts, of encoded units (uid, unit, n, a, b); both staged."""
    dealt = units.repartition("uid")
    a, b = tokens(dealt, "a"), tokens(dealt, "b")
    a, b = grouped(a, b), grouped(b, a)
    met = links(a, b).groupBy("uid").agg(F.collect_list(F.struct("a_id", "b_id")).alias("links"))
    with dealt_by_less(units.sparkSession):  # by uid, once
        rows = stage(dealt.select("uid", "unit", "n").join(strings(a, b), "uid").join(met, "uid"), "token-alignments", "zstd")
    unstage(units)
    linked = rows.select("uid", "n", F.inline("links"))
    pairs = stage(pair_counts(linked), "token-pairs")
    sums = linked.join(pairs, ["a_id", "b_id"]).groupBy("uid").agg(F.count("*").alias("n_links"), F.count_if("best").alias("n_best"), F.sum("pairs").alias("count_sum"))
    found = stage(rows.join(sums, "uid").select("unit", *STATS, "groups"), "token-found", "zstd")
    unstage(rows)
    return found, pairs


def _assembled(kind: pa.DataType):
    names = ["doc_id", *STATS, "groups_sha256"]
    types = [kind, *[pa.int64()] * len(STATS), pa.string()]

    def run(docs: pa.Table, entries: pa.Table) -> pa.Table:
        order = np.asarray(entries.column("code"))
        stats = np.zeros((len(STATS), int(order.max()) + 1 if len(order) else 0), np.int64)
        for i, name in enumerate(STATS):
            stats[i, order] = np.asarray(entries.column(name))
        said: list[str] = [""] * stats.shape[1]
        for code, text in zip(order.tolist(), entries.column("groups").to_pylist(), strict=True):
            said[code] = text
        sums, digests = np.zeros((len(STATS), docs.num_rows), np.int64), []
        row = 0
        for chunk in docs.column("codes").chunks:
            at, flat = chunk.offsets.to_numpy(), chunk.values.to_numpy()
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                codes = flat[lo:hi]
                sums[:, row] = stats[:, codes].sum(axis=1)
                digest = hashlib.sha256()
                for part in range(0, len(codes), LONG):
                    digest.update((";" * (part > 0) + ";".join(map(said.__getitem__, codes[part : part + LONG].tolist()))).encode())
                digests.append(digest.hexdigest() if len(codes) else "")
                row += 1
        return pa.table([docs.column("doc_id").cast(kind), *[pa.array(s) for s in sums], pa.array(digests, pa.string())], schema=pa.schema(list(zip(names, types, strict=True))))

    return run


def align(docs: DataFrame, a_path: str, b_path: str, sift: bool = True) -> tuple[DataFrame, DataFrame]:
    """One row per document (doc_id, the numbers, groups_sha256), and the pair counts (a_id, b_id, pairs, best).

    ``sift`` skips texts with U+2581 before they are encoded; without it the check of bytes finds them.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    arrow, name = to_arrow_type(kind), kind.simpleString()
    schema = f"slice long, row long, doc_id {name}, codes array<int>, code int, unit string, n long"
    coded = stage(docs.select("doc_id", "text").mapInArrow(_dictionaries(a_path, b_path, arrow, sift), schema), "token-slices", "zstd")
    rows, entries = coded.where(F.col("unit").isNull()).select("slice", "row", "doc_id", "codes"), coded.where(F.col("unit").isNotNull()).select("slice", "code", "unit", "n")

    def encoded(entries: DataFrame) -> DataFrame:
        units = entries.groupBy("unit").agg(F.sum("n").alias("n")).select(F.monotonically_increasing_id().alias("uid"), "unit", "n")
        return stage(units.mapInArrow(_encoded(a_path, b_path), f"uid long, unit string, n long, same boolean, a {_TOKENS}, b {_TOKENS}"), "token-units", "zstd")

    units = encoded(entries)
    if not units.where(~F.col("same")).isEmpty():
        # texts that hold such a unit have no tokens, so what is left is counted anew
        bad = entries.join(units.where(~F.col("same")).select("unit"), "unit").select("slice", "code")
        hit = rows.select("slice", "row", F.explode("codes").alias("code")).join(bad, ["slice", "code"], "left_semi").select("slice", "row", F.lit(True).alias("hit")).distinct()
        rows = stage(rows.join(hit, ["slice", "row"], "left").select("slice", "row", "doc_id", F.when(F.col("hit"), F.array().cast("array<int>")).otherwise(F.col("codes")).alias("codes")), "token-rows")
        counts = rows.select("slice", F.explode("codes").alias("code")).groupBy("slice", "code").agg(F.count("*").alias("n"))
        entries = stage(entries.drop("n").join(counts, ["slice", "code"]), "token-entries")
        units = encoded(entries)
    found, pairs = aligned(units)
    unstage()
    told = entries.select(F.col("slice").alias("of"), "code", "unit").join(found, "unit").drop("unit")
    out = rows.select("slice", "doc_id", "codes").groupBy("slice").cogroup(told.groupBy("of")).applyInArrow(_assembled(arrow), f"doc_id {name}, {', '.join(f'{s} long' for s in STATS)}, groups_sha256 string")
    return out, pairs


def op13(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
