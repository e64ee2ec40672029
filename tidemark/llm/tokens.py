"""Token counts behind a digest cache.

A text's key is the SHA-256 of its normalised content and of the tokenizer's version: of its file and its
library. Normalised means what the tokenizer takes as input: UTF-8, null as empty. Counts known to the
cache are joined; of the rest one row per digest is encoded, and those counts are appended to the cache.
A group of copies costs one encoding, and digests, not texts, meet in the join; adaptive execution splits
a digest that many rows share.

Inside a task the pattern's words are counted once per worker (``KEEP_WORDS`` at most) where the tokenizer's
file says that words are encoded separately; else, and for texts with a special token's string, the library
encodes the text whole. Both give the library's counts.

Nulls: a null text counts as empty: 0 bytes, 0 tokens. Every input row gives one output row, repeated or
not, with a null id or not.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_path, slices, stage, table

LIMIT, KEEP_WORDS = 1024, 400_000


def version_digest(path: str) -> str:
    import tokenizers

    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()


class Counter:
    """Counts as the library gives them, without added special tokens, truncation or padding."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.pattern = regex.compile(pattern)
        self.words: dict[str, int] = {}

    def _library(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def counts(self, texts: list[str]) -> list[int]:
        whole = [i for i, x in enumerate(texts) if not self.by_word or any(s in x for s in self.special)]
        out = dict(zip(whole, self._library([texts[i] for i in whole]), strict=True))
        split = {i: self.pattern.findall(x) for i, x in enumerate(texts) if i not in out}
        if len(self.words) > KEEP_WORDS:
            self.words.clear()
        fresh = list(set().union(*split.values()).difference(self.words)) if split else []
        self.words.update(zip(fresh, self._library(fresh), strict=True))
        get = self.words.__getitem__
        out |= {i: sum(map(get, x)) for i, x in split.items()}
        return [out[i] for i in range(len(texts))]


_loaded: dict[tuple[str, str], Counter] = {}


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = Counter(path, pattern)
        last = None
        for batch, col in slices(batches):
            # rows come sorted by digest: of rows that repeat, one is encoded
            digests = batch.column("digest").to_pylist()
            new = pa.array([d != e for d, e in zip(digests, [last, *digests[:-1]], strict=True)], pa.bool_())
            last, batch, col = digests[-1], batch.filter(new), col.filter(new)
            yield pa.record_batch({"digest": batch.column("digest"), "n_tokens": pa.array(_loaded[path, pattern].counts(col.to_pylist()), pa.int64())})

    return run


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def token_counts(docs: DataFrame, cache: str, path: str, pattern: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; ``cache`` is a Parquet table that every executor can reach."""
    spark, version = docs.sparkSession, version_digest(path)
    content = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(content, 256))
    keyed = stage(docs.select("doc_id", F.octet_length(content).cast("long").alias("n_bytes"), digest.alias("digest")), "digests")
    # one row of each digest: the least id; ids may be null or repeat
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("∅"))
    wanted = keyed.groupBy("digest").agg(F.min(ids).alias("rep"))
    if _exists(spark, cache):
        known = spark.read.parquet(cache).where(F.col("version") == version).select("digest")
        wanted = wanted.join(known, "digest", "left_anti")
    texts = docs.select(digest.alias("digest"), ids.alias("rep"), "text")
    counted = texts.join(wanted.hint("merge"), ["digest", "rep"], "left_semi").select("digest", "text").mapInArrow(_encode(path, pattern), "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def op2(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cache = shared_path(spark, "token-counts")
    counts = token_counts(table(spark, sf_dir, "documents"), cache, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
