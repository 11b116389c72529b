"""Sharding by longest-processing-time scheduling.

Rows with equal text form a group that stays together. Groups are sorted by size, and each goes to the
least-loaded bin through a heap. That runs in two levels, so that no task and not the driver holds all groups:

1. Groups are dealt to ``BLOCKS`` blocks by a hash of their text. A task streams one block's groups after
   another, largest first, and puts each into the least loaded of the block's bins, one for each shard (a heap of
   their loads is all it holds).
2. The bins themselves, ``BLOCKS`` times the number of shards at most, whatever the number of groups or partitions,
   are scheduled in the same way over the shards on the driver.

A group larger than a bin's fair share ends up alone in its bin, and that bin is placed first in level 2, as
in plain LPT. The shards differ by at most about one bin, or by the largest group where that is larger.

Defined cases: a null text counts as empty (size 1) and groups with empty texts; repeated rows are rows of
their own in the same group; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_key, join_sized, n_partitions, numbered, written

#: Blocks of level 1: the result depends on this number alone, not on partitions.
BLOCKS = 1024


def lpt(sizes: Iterable[tuple[int, object]], n: int) -> dict[object, int]:
    """LPT over (size, key) pairs: key -> bin. Ties go to the smaller key and the smaller bin."""
    heap = [(0, i) for i in range(n)]
    placed = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, i = heap[0]
        placed[key] = i
        heapq.heapreplace(heap, (load + size, i))
    return placed


def _bin_stream(bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap, block = [], None
        for batch in batches:
            out = []
            for b, size in zip(batch.column("block").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if b != block:
                    heap, block = [(0, i) for i in range(bins)], b
                load, i = heap[0]
                out.append(i)
                heapq.heapreplace(heap, (load + size, i))
            yield batch.append_column("bin", pa.array(out, pa.int32()))

    return run


def assign_groups(groups: DataFrame, n_shards: int) -> DataFrame:
    """``groups`` (key, bytes, n) -> key, n, shard. Bin loads alone reach the driver."""
    spark = groups.sparkSession
    dealt = (
        groups.select("key", "bytes", "n", F.pmod(F.xxhash64("key"), F.lit(BLOCKS)).cast("int").alias("block"))
        .repartition(n_partitions(spark), "block")
        .sortWithinPartitions("block", F.desc("bytes"), "key")
    )
    kind = "key struct<a: bigint, b: bigint>, bytes bigint, n bigint, block int, bin int"
    binned = written(dealt.mapInArrow(_bin_stream(n_shards), kind), "shard-bins")
    loads = binned.groupBy("block", "bin").agg(F.sum("bytes").alias("bytes")).collect()  # BLOCKS x n_shards rows at most
    placed = lpt([(r["bytes"], (r["block"], r["bin"])) for r in loads], n_shards)
    where = spark.createDataFrame([(b, i, s) for (b, i), s in placed.items()] or [], "block int, bin int, shard int")
    return binned.join(F.broadcast(where), ["block", "bin"]).select("key", "n", "shard")


def shard_documents(docs: DataFrame, n_shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot (gapless in the shard)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        content_key(text).alias("key"),
    )
    rows = written(rows, "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    where = written(assign_groups(groups, n_shards), "shard-groups")
    placed = join_sized(rows, where, "key", rows.count()).drop("key")
    return numbered(written(placed, "shard-placed"), ["shard"], ["doc_id", "text_crc32"], "slot", ["doc_id", "text_crc32"])
