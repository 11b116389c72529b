"""Line deduplication by range-partitioned hashes, giving a compressed keep bitmap per document.

A line's key is the line without blanks ([\\x20\\x09-\\x0D]) at both ends and with A-Z lower-cased. A key of at
least ``min_chars`` code points that is found in at least ``min_docs`` documents keeps its lines in one document
only, the one with the largest id; its lines in other documents are dropped.

Every line with a long enough key gives an entry (key hash, id, row, position). Entries are range-partitioned by
hash and id and sorted inside a partition by hash, id from the largest on, and position, so that a task streams
the occurrences of a key in order and holds one Arrow batch and one open key: the first document keeps its lines,
the others lose theirs once ``min_docs`` are seen. A key that many documents share spans several partitions. So
the first and the last key of a partition, and any key of over ``LONG`` entries, is told as held-back entries plus
partial counts, and the sums of these few counts decide them.

What is kept is told as a zlib-compressed bitmap for each document that loses lines, one bit per line, the most
significant bit first; documents without one keep all.

Defined cases: a null or empty text is one empty line; rows with equal ids count as one document; rows that
repeat id and text get the same answer; a null id is a document below all others; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, fresh, n_partitions, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: Entries of one key that a task holds before it leaves the decision to the partial counts.
LONG = 1 << 18
SALTS = 64
NO_ID = -(1 << 63)
DROP, HELD, COUNT = 0, 1, 2
STREAMED = "kind tinyint, a bigint, b bigint, doc bigint, row bigint, position int, n bigint"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.col(id_column), text).alias("row"),
        text.alias("text"),
    )


def _entries(rows: DataFrame, min_chars: int) -> DataFrame:
    lines = rows.select("doc", "row", F.posexplode(F.split("text", "\n", -1)).alias("position", "line"))
    keys = lines.select("doc", "row", "position", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("a"), F.xxhash64(F.lit(7), "key", F.lit(11)).alias("b"), "doc", "row", "position")


def _stream(min_docs: int, long: int = LONG):
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("position", pa.int32()), ("n", pa.int64())])

    def told(kind: int, x: np.ndarray, n: int = 0) -> pa.RecordBatch:
        counts = np.full(len(x), n, np.int64)
        return pa.record_batch([pa.array(np.full(len(x), kind, np.int8)), *(pa.array(x[c]) for c in ("a", "b", "doc", "row", "position")), pa.array(counts)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("a", "i8"), ("b", "i8"), ("doc", "i8"), ("row", "i8"), ("position", "i4")])
        carry = np.empty(0, kind)  # the open key's entries
        held: tuple | None = None  # key and last document of what was held back last
        at_edge = True  # the open key is the partition's first

        def hold(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal held
            n = 1 + int((x["doc"][1:] != x["doc"][:-1]).sum()) - (held == (x["a"][0], x["b"][0], x["doc"][0]))
            held = (x["a"][-1], x["b"][-1], x["doc"][-1])
            yield told(HELD, x)
            yield told(COUNT, x[:1], n)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.empty(batch.num_rows, kind)
            for c in kind.names:
                new[c] = batch.column(c).to_numpy(zero_copy_only=False)
            x = np.concatenate([carry, new])
            starts = np.flatnonzero(np.r_[True, (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1])])
            if len(starts) > 1:
                begin = 0
                if at_edge or (held and held[:2] == (x["a"][0], x["b"][0])):
                    yield from hold(x[: starts[1]])
                    begin = 1
                at_edge = False
                inner, edges = x[starts[begin] : starts[-1]], starts[begin:-1] - starts[begin]
                if len(inner):
                    fresh = np.r_[True, inner["doc"][1:] != inner["doc"][:-1]]
                    fresh[edges] = True
                    sizes = np.diff(np.r_[edges, len(inner)])
                    docs = np.repeat(np.add.reduceat(fresh.astype(np.int64), edges), sizes)
                    lose = (docs >= min_docs) & (inner["doc"] != np.repeat(inner["doc"][edges], sizes))
                    if lose.any():
                        yield told(DROP, inner[lose])
            carry = x[starts[-1] :]
            if len(carry) > long:
                yield from hold(carry)
                carry = carry[:0]
        if len(carry):
            yield from hold(carry)

    return run


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc, row, position of every line to drop."""
    spark = docs.sparkSession
    arrow_batches(spark)
    entries = written(_entries(_rows(docs, id_column, text_column), min_chars), "line-entries")
    ordered = entries.repartitionByRange(n_partitions(spark), "a", "b", F.desc("doc")).sortWithinPartitions("a", "b", F.desc("doc"), "row", "position")
    told = written(ordered.mapInArrow(_stream(min_docs), STREAMED), "line-stream")
    counts = told.where(F.col("kind") == COUNT).groupBy("a", "b").agg(F.sum("n").alias("docs"), F.max("doc").alias("top"))
    # two keys for a partition, and those of over LONG entries; a long key's entries are dealt over SALTS
    decided = counts.where(F.col("docs") >= min_docs).select("a", "b", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    held = told.where(F.col("kind") == HELD).withColumn("salt", F.pmod(F.xxhash64("doc", "row", "position"), F.lit(SALTS)).cast("int"))
    late = held.join(decided, ["a", "b", "salt"]).where(F.col("doc") != F.col("top"))
    return told.where(F.col("kind") == DROP).select("doc", "row", "position").unionByName(late.select("doc", "row", "position"))


def _bitmap(n_lines: pa.Array, positions: pa.Array) -> pa.Array:
    out = []
    for n, lost in zip(n_lines.to_pylist(), positions, strict=True):
        keep = np.ones(n, np.uint8)
        keep[lost.values.to_numpy()] = 0
        out.append(zlib.compress(np.packbits(keep).tobytes()))
    return pa.array(out, pa.binary())


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    """The booleans of a keep bitmap."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _kept(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    out = []
    for t, b in zip(text.to_pylist(), bitmap.to_pylist(), strict=True):
        if b is None:
            out.append(None)
            continue
        lines = t.split("\n")
        out.append("\n".join(x for x, keep in zip(lines, unpack(b, len(lines)), strict=True) if keep))
    return pa.array(out, pa.string())


def with_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_column: str = "doc_id", text_column: str = "text", names: tuple[str, str, str, str] = ("n_lines", "n_dropped", "bitmap", "kept_text")) -> DataFrame:
    """``docs`` with all its columns, and under ``names`` the lines, those dropped, the bitmap (null: all is kept) and the
    text, null being empty, still with all its lines. ``names`` must not be among the columns."""
    n_lines, n_dropped, bitmap, text_as = names
    if {c.lower() for c in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"{names}: docs has a column of that name")
    lost = dropped_lines(docs, min_chars, min_docs, id_column, text_column)
    doc, row, positions = fresh(docs, "_doc", "_row", "_lost", also=names)
    lost = lost.groupBy(F.col("doc").alias(doc), F.col("row").alias(row)).agg(F.array_distinct(F.collect_list("position")).alias(positions))
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.withColumns({
        doc: F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)), row: F.xxhash64(F.col(id_column), text),
        text_as: text, n_lines: (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long"),
    })
    found = rows.join(lost, [doc, row], "left").drop(doc, row)
    found = found.withColumn(n_dropped, F.coalesce(F.size(positions), F.lit(0)).cast("long"))
    packed = F.arrow_udf(_bitmap, "binary")(F.col(n_lines), F.coalesce(positions, F.array().cast("array<int>")))
    return found.withColumn(bitmap, F.when(F.col(positions).isNotNull(), packed)).drop(positions)


def apply_bitmaps(found: DataFrame, text: str = "kept_text", bitmap: str = "bitmap") -> DataFrame:
    """The result of with_bitmaps with its text cut down to the lines kept. Only texts that lose lines go to Python."""
    loses = F.col(bitmap).isNotNull()
    return found.withColumn(text, F.coalesce(F.arrow_udf(_kept, "string")(F.when(loses, F.col(text)), F.col(bitmap)), F.col(text)))


def without_repeats(docs: DataFrame, text_column: str = "text", length_column: str = "n_chars", **options) -> DataFrame:
    """``docs``, the same columns, with each text cut down to the lines kept; the length follows where there is such a column."""
    names = fresh(docs, "n_lines", "n_dropped", "bitmap", "kept_text")
    kept = apply_bitmaps(with_bitmaps(docs, text_column=text_column, names=tuple(names), **options), names[3], names[2])
    kept = kept.withColumn(text_column, F.col(names[3]))
    if length_column in docs.columns:
        kept = kept.withColumn(length_column, F.length(text_column).cast(docs.schema[length_column].dataType))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def line_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each document."""
    kept = apply_bitmaps(with_bitmaps(docs.select("doc_id", "text"), **options))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
