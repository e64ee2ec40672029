"""Scans, listings, plans of work, and sinks."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import degraded
from tidemark.operators.joins import lookup


def read_columns(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """Only these columns, cast; one that the files lack is NULL. Pruning reaches the scan."""
    df = spark.read.parquet(path)
    have = set(df.columns)
    return df.select(*[(F.col(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in columns.items()])


def schema_frame(spark: SparkSession, path: str) -> DataFrame:
    """(position, name) of the columns; only footers are read."""
    return spark.createDataFrame([(i, f.name) for i, f in enumerate(spark.read.parquet(path).schema)], "position int, name string")


def list_files(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """(path, stem) of files under a folder; contents stay unread. Files of a table that is a folder itself have the folder's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root).select("path", "length")
    table = F.nullif(F.regexp_extract("path", r"([^/]+)\.([a-z]+)/[^/]+\.\2$", 1), F.lit(""))
    return files.withColumn("stem", F.coalesce(table, F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1)))


def market_years(listing: DataFrame) -> DataFrame:
    """(market, year) of paths like market/year.parquet; stems that are no year are left out."""
    m = F.regexp_extract("path", r"([^/]+)/(\d+)\.parquet$", 1)
    y = F.regexp_extract("path", r"([^/]+)/(\d+)\.parquet$", 2)
    return listing.select(m.alias("market"), y.try_cast("int").alias("year")).where("market <> '' and year is not null")


def archive_names(paths: DataFrame, column: str = "path") -> DataFrame:
    """(product, year) of archive paths: product/year/…, or the older product_year…"""
    new = r"/([A-Z0-9]+)/(\d{4})/[^/]+\.dbn(?:\.zst)?$"
    old = r"/([A-Z0-9]+)_(\d{4})[^/]*\.dbn(?:\.zst)?$"
    pick = lambda g: F.coalesce(F.nullif(F.regexp_extract(column, new, g), F.lit("")), F.nullif(F.regexp_extract(column, old, g), F.lit("")))
    return paths.select(column, pick(1).alias("product"), pick(2).try_cast("int").alias("year"))


def resolve_alias(name: str, aliases: Mapping[str, str], strict: bool = True) -> str:
    """Follow aliases to a profile; a cycle raises, or stops where it is seen."""
    seen = {name}
    while name in aliases:
        name = aliases[name]
        if name in seen:
            if strict:
                raise ValueError(f"alias cycle at {name}")
            return name
        seen.add(name)
    return name


def profile_inputs(spark: SparkSession, profiles: Mapping[str, Mapping[str, Sequence]], aliases: Mapping[str, str], name: str) -> DataFrame:
    """(market, year) that a profile asks for."""
    p = profiles[resolve_alias(name, aliases)]
    rows = [(m, int(y)) for m in p["markets"] for y in p["years"]]
    return spark.createDataFrame(rows, "market string, year int")


def shard(df: DataFrame, order: Sequence[str], index: int, count: int) -> DataFrame:
    """The index-th (from 1) of ``count`` round-robin shards of a small plan."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.orderBy(*order)) - 1
    return df.withColumn("_n", nth).where(F.col("_n") % count == index - 1).drop("_n")


def chunk_ranges(df: DataFrame, start: str, end: str, unit: str) -> DataFrame:
    """[start, end) cut at the beginnings of days, months or years; ``none`` leaves it whole."""
    if unit == "none":
        return df.select("*", F.col(start).alias("chunk_start"), F.col(end).alias("chunk_end"))
    step = {"day": "interval 1 day", "month": "interval 1 month", "year": "interval 1 year"}[unit]
    cuts = F.expr(f"sequence(date_trunc('{unit}', cast({start} as timestamp)), cast({end} as timestamp), {step})")
    cut = F.col("_cut").cast("date")
    upper = F.expr(f"cast(_cut + {step} as date)")
    out = df.withColumn("_cut", F.explode(cuts)).select(*df.columns, F.greatest(F.col(start), cut).alias("chunk_start"), F.least(F.col(end), upper).alias("chunk_end"))
    return out.where("chunk_start < chunk_end")


def task_plan(products: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every product with every chunk, from the day the product is available; a plan is as long as that, and Spark picks the side to send."""
    out = products.crossJoin(chunks).withColumn("chunk_start", F.greatest("chunk_start", "available_start"))
    return out.where("chunk_start < chunk_end")


def with_quality(bars: DataFrame, conditions: DataFrame, ts: str = "ts") -> DataFrame:
    """Status of the bar's UTC date, available where none is stated, and whether it counts as degraded."""
    day = conditions.select(F.col("date").alias("_date"), F.col("status").alias("_status"))
    out = lookup(bars.withColumn("_date", F.to_date(ts)), day, "_date")
    out = out.withColumn("data_quality_status", F.coalesce("_status", F.lit("available"))).drop("_date", "_status")
    return out.withColumn("data_quality_degraded", degraded("data_quality_status"))


def settings(path: str) -> dict:
    """A mapping from a JSON or YAML file, empty if there is none."""
    try:
        with open(path, encoding="utf-8") as file:
            text = file.read()
    except FileNotFoundError:
        return {}
    if path.endswith(".json"):
        return json.loads(text) or {}
    import yaml

    return yaml.safe_load(text) or {}


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ("market",)) -> None:
    """Replace the partitions that ``df`` has; the committer makes each write all or nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def publish(df: DataFrame, path: str, bad_rows: Column | None = None) -> None:
    """Replace the table at ``path`` as a whole, or leave it as it is.

    Rows are written beside it, in a hidden folder of the same store, and checked as they were written; only then does the old table
    step aside and the new one take its name, by two renames of the store. If the second fails, the old table gets its name back. A
    name that begins with a dot is no part of any table to Spark, so what a lost driver leaves there is never read.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    new, old = (jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}-{kind}-{mark}") for kind in ("new", "old"))
    try:
        df.write.parquet(new.toString())
        written = spark.read.schema(df.schema).parquet(new.toString())
        if bad_rows is not None and not written.where(bad_rows).isEmpty():
            raise ValueError("rows break the contract; nothing was published")
        had = store.exists(place)
        if had and not store.rename(place, old):
            raise OSError(f"{path} cannot be moved aside")
        if not store.rename(new, place):
            if had:
                store.rename(old, place)
            raise OSError(f"{path} cannot be published")
        if had:
            store.delete(old, True)
    finally:
        store.delete(new, True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A table of a small report; one of more than ``most`` rows is no report."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


#: Files up to this size are hashed as a row; larger ones in pieces.
WHOLE, PIECE = 1 << 28, 1 << 23


def _hash_in_pieces(batches):
    """Digests of files too large for a row, read through Arrow's file systems, ``PIECE`` bytes at a time."""
    from pyarrow import fs

    for batch in batches:
        for path in batch["path"]:
            store, name = fs.FileSystem.from_uri(path)
            digest, n = hashlib.sha256(), 0
            with store.open_input_stream(name) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
                    n += len(piece)
            yield pd.DataFrame({"path": [path], "sha256": [digest.hexdigest()], "bytes": [n]})


def file_hashes(spark: SparkSession, root: str, glob: str = "*", whole: int = WHOLE) -> DataFrame:
    """(path, sha256, bytes) of each file of a folder, of any size.

    The size decides on the way, and is pushed to the scan, so neither reads the files of the other. What is larger than ``whole`` must
    be on a store that Arrow opens; a task holds one piece of it. Files without bytes are no rows of a scan and have none here.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(root)
    small = files.where(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    large = files.where(F.col("length") > whole).select("path").repartition("path")
    return small.unionByName(large.mapInPandas(_hash_in_pieces, "path string, sha256 string, bytes long"))


def file_stem(path: str = "path") -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[a-z]+$", 1)


def hash_map(expected: DataFrame, hashes: DataFrame, name: str = "name") -> DataFrame:
    """Each expected file with its hash, or ``MISSING`` if it is absent or has no bytes; ``name`` is how a path ends."""
    found = hashes.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("_name"), "sha256", "bytes")
    out = expected.join(found, F.col(name) == F.col("_name"), "left").drop("_name")
    return out.withColumn("sha256", F.coalesce("sha256", F.lit("MISSING")))


def canonical_sha256(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


MANIFEST = T.StructType([T.StructField(n, t) for n, t in (("product", T.StringType()), ("year", T.IntegerType()), ("sha256", T.StringType()), ("bytes", T.LongType()), ("rows", T.LongType()))])


def manifest_problems(manifest: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Each manifest row with the names of the rules it breaks."""
    from tidemark.functions.scalars import blank, reasons

    return manifest.withColumn(
        "problems",
        reasons(
            (blank("product"), "product_missing"),
            (~F.coalesce(F.col("year").between(*years), F.lit(False)), "year_out_of_range"),
            (~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad_checksum"),
            (~F.coalesce(F.col("bytes") > 0, F.lit(False)), "empty_file"),
            (F.col("rows").isNull(), "rows_missing"),
        ),
    )


def migration_plan(files: DataFrame) -> DataFrame:
    """Target of each file, and whether several files claim it with the same or with other contents."""
    out = files.withColumn("target", F.concat_ws("/", "product", F.col("year").cast("string"), "name"))
    claims = out.groupBy("target").agg(F.count("*").alias("claims"), F.count_distinct("sha256").alias("contents"))
    state = F.when(F.col("claims") == 1, "move").when(F.col("contents") == 1, "duplicate").otherwise("conflict")
    return out.join(claims, "target").withColumn("action", state)
