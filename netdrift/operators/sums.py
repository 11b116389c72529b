"""Sums of arrays by key, and rows packed into blocks by key: what jobs on small matrices and many rows are made of."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of sums that a task holds before it tells them.
HELD = 32 << 20
BLOCK_ROWS = 4096


def array_sums(rows: DataFrame, by: str | list[str], sums: Callable[[pd.DataFrame], np.ndarray], kind: str = "double", held: int = HELD) -> DataFrame:
    """``by``, s: the total of ``sums``, an array of a fixed length that is taken of the rows of a key that a batch holds.

    A task adds up its batches and tells each key once, or, where the sums of very many keys take over ``held``
    bytes, tells what it has and goes on. Spark then adds partials cell by cell, with partial aggregation: a row of that
    shuffle is a (key, place), so neither many tasks nor many rows of a key meet in one group. Only the cells of a
    finished array come together.
    """
    by = [by] if isinstance(by, str) else list(by)
    dtype = np.int64 if kind == "bigint" else np.float64

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        size = 0

        def told() -> pd.DataFrame:
            return pd.DataFrame({**{c: [key[i] for key in total] for i, c in enumerate(by)}, "s": list(total.values())})

        for batch in batches:
            for key, own in batch.groupby(by, sort=False, dropna=False):
                part = np.asarray(sums(own), dtype).ravel()
                if key in total:
                    total[key] += part
                else:
                    total[key] = part.copy()
                    size += part.nbytes
            if size > held:
                yield told()
                total, size = {}, 0
        if total:
            yield told()

    keys = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in by)
    cells = rows.mapInPandas(partial, f"{keys}, s array<{kind}>").select(*by, F.posexplode("s").alias("_i", "_v"))
    added = cells.groupBy(*by, "_i").agg(F.sum("_v").alias("_v"))
    return added.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("s"))


def blocks_of(rows: DataFrame, by: str, size: int = BLOCK_ROWS) -> DataFrame:
    """``by``, rows: blocks of up to ``size`` rows of one key, each row a struct of all its columns. No shuffle: a block
    holds rows that one Arrow batch held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(by).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            batch, codes = batch.take(pa.array(order)), codes[order]
            new = np.r_[True, codes[1:] != codes[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
            starts = np.flatnonzero((np.arange(len(codes)) - first) % size == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(codes)], pa.int32()), pa.StructArray.from_arrays(batch.columns, names=batch.schema.names))
            yield pa.RecordBatch.from_arrays([batch.column(by).take(pa.array(starts)), lists], names=[by, "rows"])

    return rows.mapInArrow(run, T.StructType([rows.schema[by], T.StructField("rows", T.ArrayType(rows.schema, False))]))


def on_blocks(rows: DataFrame, by: str, table: DataFrame, column: str, vector: str, name: str, apply: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``rows`` with ``name``: ``apply`` of a block's vectors, one a row, and of the array that ``table`` (by, ``column``) has
    for the block's key. The array travels once a block, not once a row; rows of keys that ``table`` lacks go."""
    plain = blocks_of(rows, by).join(table.select(by, F.col(column).alias("_array")), by).select("rows", "_array")
    names = [*rows.columns, name]
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                part = batch.column("rows")[at].values
                vectors = part.field(vector)
                there = vectors.is_valid().to_numpy(zero_copy_only=False)
                n = int(there.sum())
                out: list[np.ndarray | None] = [None] * len(part)
                if n:
                    found = apply(vectors.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(n, -1), batch.column("_array")[at].values.to_numpy(zero_copy_only=False))
                    for i, row in zip(np.flatnonzero(there).tolist(), found, strict=True):
                        out[i] = row
                yield pa.RecordBatch.from_arrays([*part.flatten(), pa.array(out, pa.list_(pa.float64()))], names=names)

    return plain.mapInArrow(run, schema)
