"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and text bytes that a Python worker handles at once.
BATCH_ROWS = 2048
SLICE_BYTES = 4 << 20
#: Parts of a group that get their numbers side by side; numbers do not depend on partitions.
NUMBER_BLOCKS = 512
#: A key of more than one row in so many counts as hot.
HOT = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds, by rows and, where Spark knows the setting, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 * SLICE_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session has an own
    one, and a cluster none: its executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or _own_dir()).rstrip("/")


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="netdrift-shared-")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut of lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Written steps of one job, which removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *steps: DataFrame) -> None:
        for step in steps:
            path, _ = self.paths.pop(id(step))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

    def release(self) -> None:
        """Let Spark remove the shuffle files of plans that are done: they go when the plans are collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def keep(self, last: DataFrame) -> DataFrame:
        """``last``, a written step, with all others dropped."""
        self.drop(*[step for _, step in list(self.paths.values()) if step is not last])
        return last


def fresh(df: DataFrame, *names: str, also: Iterable[str] = ()) -> list[str]:
    """Each of ``names``, or with underscores before it until no column of ``df``, and none of ``also``, has that name."""
    taken, out = {c.lower() for c in (*df.columns, *also)}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def content_key(*columns: Column) -> Column:
    """128 bits of the values given, as a struct of two longs."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(7), *columns, F.lit(11)).alias("b"))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[str]]:
    """The texts of an Arrow array in order, in lists of about ``limit`` characters; nulls become ''."""
    part, held = [], 0
    for text in texts:
        text = text.as_py() or ""
        part.append(text)
        held += len(text)
        if held >= limit:
            yield part
            part, held = [], 0
    if part:
        yield part


def trim() -> None:
    """Give memory that a task has freed back to the system; workers live on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """``run``, a generator over batches, with trim() at the end of its task."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def join_sized(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each key and ``n``, how many of the ``total`` rows have it.

    Keys of over one row in ``HOT`` are broadcast, since fewer than ``HOT`` of them can exist; the others are
    shuffled. ``rows`` must be cheap to read twice.
    """
    hot = table.where(F.col("n") > total // HOT).drop("n")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col("n") <= total // HOT).drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, spread: list[str]) -> DataFrame:
    """Add ``name``: gapless numbers from 0 within ``group``, without one task per group.

    Rows of a group are spread over ``NUMBER_BLOCKS`` blocks by a hash of ``spread``; block counts (as many rows as
    groups times blocks) become offsets, and row_number runs inside a block. ``df`` must be cheap to read twice.
    """
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*spread), F.lit(NUMBER_BLOCKS)).cast("int"))
    counts = dealt.groupBy(*group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy(*group, "_block").orderBy(*order)
    return (
        dealt.withColumn("_at", F.row_number().over(inside) - 1)
        .join(offsets, [*group, "_block"])
        .withColumn(name, (F.col("_from") + F.col("_at")).cast("long"))
        .drop("_block", "_at", "_from")
    )
