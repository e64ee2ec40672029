"""Shared plumbing of the text operators: reading, staging in the shared folder, Arrow batches, bitmaps.

Nothing here holds more than one slice of a batch in Python; a slice has at most
``SLICE_BYTES`` of text, or one text if that is longer.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of text handled at once; a longer text makes a slice of its own.
SLICE_BYTES = 2 << 20
#: Arrow batches between the JVM and Python: rows of text are long, so fewer at a time than the defaults.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def tune(spark: SparkSession) -> None:
    """Bound the batches, unless the session has its own setting."""
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a folder of this machine, in local mode only."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    tune(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*staged: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more, and let go of the shuffle files of what is done.

    Spark deletes shuffle files when the JVM's collector finds that no plan refers to them; here it is asked to look.
    """
    for df in staged:
        spark = df.sparkSession
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    gc.collect()
    SparkSession.active().sparkContext._jvm.System.gc()


def row_key(*cols: str, text: str = "text"):
    """A null-safe key of a row: its id columns and a hash of its text. Rows that repeat share it."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in cols]
    return F.concat_ws("|", *parts, F.hex(F.xxhash64(F.coalesce(F.col(text), F.lit("")))))


def free_name(name: str, columns: list[str]) -> str:
    """``name``, or the first of name_2, name_3 ... that no column has; Spark does not tell case apart."""
    taken = {c.lower() for c in columns}
    names = (name if i == 1 else f"{name}_{i}" for i in range(1, len(taken) + 2))
    return next(n for n in names if n.lower() not in taken)


def own_columns(docs: DataFrame) -> list:
    """The columns of ``docs`` by their whole names, which may hold dots."""
    return [F.col(quoted(c)) for c in docs.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def map_rows(docs: DataFrame, work, schema: T.StructType) -> DataFrame:
    """``docs.mapInArrow``, which does not take names with dots: ``work`` sees them as _column_0, _column_1 ..."""
    odd: dict[str, str] = {}
    for c in schema.names:
        if "." in c or "`" in c:
            odd[c] = free_name(f"_column_{len(odd)}", [*schema.names, *odd.values()])
    if not odd:
        return docs.mapInArrow(work, schema)
    plain = T.StructType([T.StructField(odd.get(f.name, f.name), f.dataType) for f in schema])
    return docs.toDF(*[odd.get(c, c) for c in docs.columns]).mapInArrow(work, plain).toDF(*schema.names)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as large_string without nulls (null: empty)."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a large_string array and the n+1 offsets into them, from 0."""
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col) or off[-1] == off[0]:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(col.buffers()[2], dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = SLICE_BYTES):
    """(slice of the batch, its text column) pairs of bounded size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = text_column(batch, name)
        _, off = text_buffers(col)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at), col.slice(at, to - at)
            at = to


#: A 64-bit mixing step: every input bit moves every output bit.
def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Bitmap:
    """A fixed number of bits that holds hashes of a set: misses are certain, hits are to be confirmed.

    Its size never depends on the data, so it is safe to broadcast. When the set outgrows it, more rows
    pass, and the join behind it does more of the work; results do not change.
    """

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.log2 = bits, log2

    @classmethod
    def build(cls, hashes: DataFrame, column: str, log2: int = 24) -> Bitmap:
        """OR the hashes of a column on the executors; blocks of 2**15 bits come to the driver, 2**log2 bits at most."""
        bit = F.shiftrightunsigned(F.col(column), 64 - log2)
        rows = (
            hashes.select(bit.alias("bit"))
            .groupBy(F.shiftright("bit", 15).cast("int").alias("block"))
            .agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
            .collect()
        )
        bits = np.zeros(1 << (log2 - 3), np.uint8)
        for row in rows:
            bits[row.block * 4096 : row.block * 4096 + 4096] = np.frombuffer(row.bits, np.uint8)
        return cls(bits, log2)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) >> np.uint64(64 - self.log2)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
