"""What the corpus operators share: scratch tables, bounded samples, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many narrow rows may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of a batch of texts on the way to a Python worker.
BATCH_ROWS = 1_000

_local_root: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share.

    Where it is unset, a temporary folder stands in, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="pathloom-"))
        atexit.register(shutil.rmtree, _local_root[0], ignore_errors=True)
    return f"file://{_local_root[0]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, written as Parquet in the shared folder and read again: it cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `limit` rows by count, else df as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def sampled(rows: DataFrame, n: int, *key: Column) -> DataFrame:
    """At most n rows, those with the smallest hash of the key: the same ones on every run."""
    return rows.orderBy(F.xxhash64(*key), *key).limit(n)


def texts_of(docs: DataFrame, chosen: DataFrame, on: list[str], longest: int | None = None) -> DataFrame:
    """The columns of `chosen` (a sample of bounded size) and a text for each of its rows: that of the row of docs with equal
    columns `on`, of several the smallest. Null texts and those of over `longest` bytes are passed over."""
    rows = docs.select(*on, "text").filter(F.col("text").isNotNull() if longest is None else F.octet_length("text") <= longest)
    return rows.join(F.broadcast(chosen), on).groupBy(*chosen.columns).agg(F.min("text").alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many more underscores before it as no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def crc_of_id(col: str | Column = "doc_id") -> Column:
    """Unsigned crc32 of the id written as text."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


def by_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of at most BATCH_ROWS rows: those of Spark's default would hold tens of MB of texts,
    once in the JVM beside its heap and once in the worker. A session that sets another size than the default keeps it."""
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if df.sparkSession.conf.get(key) == default:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, in pieces of at most `rows` rows and about `size` bytes of text (a longer text is alone)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        at = total = 0
        for i, n in enumerate(lengths):
            if i > at and (total + n > size or i - at >= rows):
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < len(lengths):
            yield batch.slice(at)
