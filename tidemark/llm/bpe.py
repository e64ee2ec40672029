"""Byte-level BPE, encoded and decoded by DuckDB inside each task.

Spark deals out the documents; a task splits its texts by the tokenizer's pattern and hands the distinct
new words to a recursive DuckDB query. Its rows are (word and position, token, next position): every step joins neighbours
to the merge table and contracts each word's leftmost pair of least rank, until no word has a pair left. An ordered aggregation over (document, position) puts the tokens' bytes together again.

The merge table holds every split of a ranked piece into two ranked pieces, with the piece's rank. A token is a ranked piece that stands in the word,
so words of over ``CUT`` bytes are first parted at each place that no such piece spans: merges never cross it. In parts that are still longer,
a step also contracts the other places of the pair, from left to right, if no ranked piece that begins or ends with the new token has
a lesser rank: then those places are next, whatever stands beside them. Words are kept per Python worker, ``KEEP_WORDS`` at most; that saves work and changes nothing. DuckDB spills nowhere: a query takes words of ``STEP_BYTES``, or one part if
that is longer.

Nulls: a null text counts as empty and has no tokens. Rows are taken one by one: repeated rows and null ids keep
their own results, and other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import free_name, map_rows, slices, table, tune

KEEP_WORDS, CUT, STEP_BYTES, MEMORY_MB = 400_000, 32, 250_000, 250
#: One place a word and step; shifted by 32 bits, the word's number stands before the place in k.
_ENCODE = """
with recursive state(k, id, nk, live) as (
    select k, id, k + 1, true from fresh
    union all
    select s.k, case when s.k = b.k then b.m else s.id end, case when s.k = b.k then b.after else s.nk end, b.k is not null
    from state s
    left join (
        select x.k >> 32 as w, min(m) as m, arg_min(x.k, (m << 32) + (x.k & 4294967295)) as k, arg_min(y.k, (m << 32) + (x.k & 4294967295)) as gone, arg_min(y.nk, (m << 32) + (x.k & 4294967295)) as after
        from state x join state y on y.k = x.nk join merges on merges.l = x.id and merges.r = y.id
        where x.live and y.live
        group by 1
    ) b on b.w = s.k >> 32
    where s.live and (b.gone is null or s.k <> b.gone)
)
select k >> 32 as w, list(id order by k) as ids from state where not live group by 1 order by 1
"""
#: All places of the pair; of a token beside its like, every other one.
_ENCODE_LONG = """
with recursive state(k, id, nk, live) as (
    select k, id, k + 1, true from fresh
    union all (
        with pairs as materialized (
            select x.k, y.k as gone, y.nk as after, m, all_places, x.id = y.id as twins
            from state x join state y on y.k = x.nk join merges on merges.l = x.id and merges.r = y.id
            where x.live and y.live
        ),
        best as materialized (select k >> 32 as w, min(m) as m, arg_min(k, (m << 32) + (k & 4294967295)) as k from pairs group by 1),
        least as materialized (
            select p.k, gone, after, p.m, twins from pairs p join best b on b.w = p.k >> 32 and b.m = p.m where all_places or p.k = b.k
        ),
        runs as (select *, k - (gone - k) * row_number() over (partition by k >> 32 order by k) as run from least where twins),
        hits as materialized (
            select k, gone, after, m from least where not twins
            union all
            select k, gone, after, m from runs qualify row_number() over (partition by k >> 32, run order by k) % 2 = 1
        ),
        changes as (select k, m, after from hits union all select gone, null, null from hits)
        select s.k, coalesce(c.m, s.id), coalesce(c.after, s.nk), b.w is not null
        from state s left join changes c on c.k = s.k left join best b on b.w = s.k >> 32
        where s.live and (c.k is null or c.m is not null)
    )
)
select k >> 32 as w, list(id order by k) as ids from state where not live group by 1 order by 1
"""
_DECODE = "select doc, array_to_string(list(piece order by pos), '') as text from tokens join vocab using (id) group by doc"


class Bpe:
    """A rank file's merges and vocabulary in a DuckDB of this worker's own, in memory."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        rows = [(self.ranks[b[:i]], self.ranks[b[i:]], r) for b, r in self.ranks.items() for i in range(1, len(b)) if b[:i] in self.ranks and b[i:] in self.ranks]
        l, r, m = zip(*rows, strict=True)
        least = np.full(max(m) + 1, max(m))  # of the pieces that begin or end with a token
        for part in (l, r):
            inside = np.array(part) < len(least)
            np.minimum.at(least, np.array(part)[inside], np.array(m)[inside])
        merges = pa.table({"l": pa.array(l, pa.int32()), "r": pa.array(r, pa.int32()), "m": pa.array(m, pa.int64()), "all_places": pa.array(least[np.array(m)] >= np.array(m))})
        vocab = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "piece": [b.decode("latin-1") for b in self.ranks]})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        self.db.register("merges_in", merges)
        self.db.register("vocab_in", vocab)
        self.db.execute("create table merges as select * from merges_in")
        self.db.execute("create table vocab as select * from vocab_in")
        self.words: dict[str, bytes] = {}
        sizes = sorted({len(b) for b in self.ranks if len(b) > 1})
        by = {n: b"".join(b for b in self.ranks if len(b) == n) for n in sizes}
        self.pieces = {n: np.sort(self._window_hashes(np.frombuffer(x, np.uint8), n)[::n]) for n, x in by.items()}

    @staticmethod
    def _window_hashes(data: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n bytes from each place on, the last n - 1 left out."""
        out = np.zeros(len(data) - n + 1, np.uint64)
        for j in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + data[j : j + len(out)] + np.uint64(1)
        return out

    def _parts(self, words: list[bytes]) -> list[list[bytes]]:
        """Each word parted at the places that no ranked piece in it spans; a hash that meets another's only spares a cut."""
        blob = b"".join(words)
        data = np.frombuffer(blob, np.uint8)
        spans, cut = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, bool)
        cut[ends := np.cumsum([0, *map(len, words)])] = True
        for n, known in self.pieces.items():
            if n > len(data):
                break
            h = self._window_hashes(data, n)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
            spans[at + 1] += 1
            spans[at + n] -= 1
        cut[1:-1] |= np.cumsum(spans)[1:-1] == 0
        out = []
        for a, b in zip(ends.tolist(), ends[1:].tolist()):  # noqa: B905
            at = (np.flatnonzero(cut[a : b + 1]) + a).tolist()
            out.append([blob[i:j] for i, j in zip(at, at[1:])])  # noqa: B905
        return out

    def _merge(self, fresh: list[bytes], query: str = _ENCODE) -> list[bytes]:
        size = np.array([len(w) for w in fresh])
        begin = np.cumsum(size) - size
        rows = pa.table(
            {
                "k": pa.array((np.repeat(np.arange(len(fresh)), size) << 32) + np.arange(int(size.sum())) - np.repeat(begin, size)),
                "id": pa.array(self.byte[np.frombuffer(b"".join(fresh), np.uint8)]),
            }
        )
        if int(size.sum()) > STEP_BYTES:  # one part alone: a row of a step takes some hundred bytes
            self.db.execute(f"set memory_limit = '{MEMORY_MB + int(size.sum()) // 1000}MB'")
        self.db.register("fresh", rows)
        ids = self.db.sql(query).to_arrow_table()["ids"].combine_chunks()
        self.db.unregister("fresh")
        if int(size.sum()) > STEP_BYTES:
            self.db.execute(f"set memory_limit = '{MEMORY_MB}MB'")
        values, offsets = ids.values.to_numpy().astype("<u4").tobytes(), (ids.offsets.to_numpy() * 4).tolist()
        return [values[a:b] for a, b in zip(offsets, offsets[1:])]  # noqa: B905

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(x) for x in texts]
        if len(self.words) > KEEP_WORDS:
            self.words = dict(list(self.words.items())[KEEP_WORDS // 2 :])  # the newest stay
        fresh = sorted(set().union(*split).difference(self.words)) if split else []
        data = [w.encode() for w in fresh]
        long = [i for i, b in enumerate(data) if len(b) > CUT]
        parts = dict(zip(long, self._parts([data[i] for i in long]), strict=True)) if long else {}
        done: dict[bytes, bytes] = {}
        for size, query in ((lambda n: n <= CUT, _ENCODE), (lambda n: n > CUT, _ENCODE_LONG)):
            todo = sorted({p for i, b in enumerate(data) for p in parts.get(i, [b]) if size(len(p))})
            before, at = np.cumsum([0, *map(len, todo)]), 0
            while at < len(todo):
                to = max(at + 1, int(np.searchsorted(before, before[at] + STEP_BYTES, side="right")) - 1)
                done.update(zip(todo[at:to], self._merge(todo[at:to], query), strict=True))
                at = to
        for i, word in enumerate(fresh):
            self.words[word] = b"".join(done[p] for p in parts[i]) if i in parts else done[data[i]]
        get = self.words.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each text."""
        size = np.array([len(x) // 4 for x in ids], np.int64)
        out = [b""] * len(ids)
        if size.sum():
            begin = np.cumsum(size) - size
            rows = pa.table(
                {
                    "doc": pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), size)),
                    "pos": pa.array((np.arange(int(size.sum())) - np.repeat(begin, size)).astype(np.int32)),
                    "id": pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)),
                }
            )
            self.db.register("tokens", rows)
            found = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("tokens")
            for doc, text in zip(found["doc"].to_pylist(), found["text"].to_pylist(), strict=True):
                out[doc] = text.encode("latin-1")
        return out


_loaded: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(path, pattern)
    return _loaded[path, pattern]


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


#: What ``encode`` adds.
COLUMNS = ("n_tokens", "token_ids", "round_trip")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with n_tokens, token_ids, and whether decoding them gives the text's bytes back (round_trip); a name that is taken gets a number."""
    names: list[str] = []
    for name in COLUMNS:
        names.append(free_name(name, [*docs.columns, *names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch, col in slices(batches, most=1 << 20):
            texts = col.to_pylist()
            ids = bpe.encode(texts)
            back = bpe.decode(ids)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array([a.encode() == b for a, b in zip(texts, back, strict=True)], pa.bool_())],
                [*batch.schema.names, *names],
            )

    tune(docs.sparkSession)
    more = [T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.ArrayType(T.IntegerType()), T.BooleanType()), strict=True)]
    return map_rows(docs, run, T.StructType([*docs.schema.fields, *more]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids and of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch, col in slices(batches, most=1 << 20):
            ids = bpe.encode(col.to_pylist())
            back = bpe.decode(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *default_files())
