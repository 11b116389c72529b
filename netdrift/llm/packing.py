"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document's ids, with the end id after them, are cut into pieces whose lengths are the most sequences of
``longest`` (a power of two) and then the powers of two of the rest, largest first. Every piece is a sequence of
its own, of a power-of-two length, and so needs no padding. Sequences are numbered from 0 bucket by bucket, the
longest pieces first, so that a batch of one bucket holds rows of equal length.

Defined cases: a null text is empty and gives the end id alone; repeated rows give repeated pieces, each its own
sequence; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ROWS, TEXT_BYTES, codec, default_json
from .common import NUMBER_BLOCKS, arrow_batches, slices, trimmed, written

LONGEST = 2048
END_ID = 1


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """``longest`` as often as it goes, then the powers of two of the rest, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(path: str, longest: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, special=True)
        for batch in batches:
            keys = iter(batch.column("doc_id"))
            for texts in slices(batch.column("text"), TEXT_BYTES):
                rows = []
                for ids in c.encode(texts):
                    key, start = next(keys).as_py(), 0
                    ids = np.r_[ids, np.uint32(end_id)].astype("<u4")
                    for size in piece_lengths(len(ids), longest):
                        piece = ids[start : start + size].tobytes()
                        rows.append((key, start, size, zlib.crc32(piece), len(ids), piece if with_ids else None))
                        start += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), *[pa.int64()] * 4, pa.binary()), strict=True)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    return run


def pack(docs: DataFrame, path: str | None = None, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids (little-endian uint32), sequence_id, offset.

    A sequence's row count, its bucket, is its length. Numbers need two steps, so that a bucket is no single task:
    counts of (bucket, block) become offsets, and row_number runs inside a block.
    """
    spark = docs.sparkSession
    arrow_batches(spark, ROWS)
    kind = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    pieces = rows.mapInArrow(trimmed(_pieces(path or default_json(), longest, end_id, with_ids)), kind)
    pieces = written(pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(NUMBER_BLOCKS)).cast("int")), "pack-pieces")
    counts = pieces.groupBy("length", "_block").agg(F.count("*").alias("_n"))  # 12 lengths times blocks
    before = Window.orderBy(F.desc("length"), "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("length", "_block").orderBy("doc_id", "start", "ids_crc32")
    return (
        pieces.withColumn("_at", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "_block"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", (F.col("_from") + F.col("_at")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
