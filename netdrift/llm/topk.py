"""Exact top-k by inner product, pruned by segment statistics from coarse to fine.

A vector is cut into equal segments, and each segment is told by its mean m and deviation s (population). For
two vectors of n components in g segments the squared distance is at least

    sum over segments of n/g * ((m1 - m2)^2 + (s1 - s2)^2)

and with the squared lengths known, the inner product is at most sum of n/g * (m1 m2 + s1 s2). With 1, 4, 16, ...
and at last half as many segments as components the bounds get tighter. A candidate is dropped for a query as soon
as its bound is below the query's k-th best score so far; survivors get the exact integer score.

Vectors are packed into blocks of bounded size, and blocks into groups: about ``QUERY_GROUP`` blocks of queries and
up to ``CANDIDATE_GROUP`` of candidates each. Every pair of a query group and a candidate group is a cell, the key of the
one shuffle: a query block goes to all cells of its group's row and a candidate block to all of its column. A task
streams its cells, the queries of a cell first, and keeps the k best of each query, so that its bounds tighten as it goes;
what the cells keep is ranked by query. The plan is the same at all sizes.

Defined cases: vectors that are null, or hold a null or a non-finite component, and rows without an id take no
part; vectors of different lengths never meet; rows with the query's own id are no candidates of it; rows that repeat are
candidates each, with ranks of their own; a query id
that repeats is answered once, from its first vector by value; fewer than k candidates give fewer rows; ties go
to the smaller id. Scores are exact while |score| < 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, written

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
QUERY_GROUP = 16
CANDIDATE_GROUP = 16
#: Numbers that the vectors of pairs handled at once hold, whatever the vectors' length.
CELLS = 1 << 22
FOUND = "query_id bigint, vec_id bigint, score bigint, exact bigint, cell int"


def _segments(x: np.ndarray, g: int) -> np.ndarray:
    """Means and deviations of ``g`` segments, scaled so that a dot product of two results is the bound."""
    n, d = x.shape
    edges = np.linspace(0, d, g + 1).astype(int)
    edges = edges[:-1][np.diff(edges) > 0], np.diff(edges)[np.diff(edges) > 0]
    if not len(edges[0]):
        return np.zeros((n, 1))
    size = edges[1].astype(np.float64)
    mean = np.add.reduceat(x, edges[0], axis=1) / size
    square = np.add.reduceat(x * x, edges[0], axis=1) / size
    dev = np.sqrt(np.maximum(square - mean * mean, 0.0))
    return np.hstack([mean * np.sqrt(size), dev * np.sqrt(size)])


def levels(dim: int) -> list[int]:
    """Numbers of segments, from coarse to fine: 1, 4, 16, ... and last segments of two components."""
    found, g = [1], 4
    while g * 2 < dim:
        found.append(g)
        g *= 4
    return found + [dim // 2] if dim // 2 > found[-1] else found


def _cuts(pairs: int, width: int) -> list[slice]:
    """Parts of ``pairs`` whose vectors of ``width`` numbers hold about CELLS; one empty part of none."""
    step = max(1, CELLS // max(width, 1))
    return [slice(at, at + step) for at in range(0, max(pairs, 1), step)]


class BestK:
    """The k best (score, id) of each query of one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x.astype(np.float64), k
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.stats = [_segments(self.x, g) for g in levels(x.shape[1])]
        self.exact = np.zeros(len(ids), np.int64)  # candidates that needed their exact score

    def meet(self, ids: np.ndarray, x: np.ndarray, stats: list[np.ndarray]) -> None:
        """Candidates in parts that grow, so that the first tighten the bound for the others."""
        at, size = 0, max(64, 4 * self.k)
        while at < len(ids):
            part = slice(at, at + size)
            self._part(ids[part], x[part], [s[part] for s in stats])
            at, size = at + size, min(2 * size, 1024)

    def _part(self, ids: np.ndarray, x: np.ndarray, stats: list[np.ndarray]) -> None:
        if np.isinf(self.scores[:, -1]).any():  # no bound yet
            self._score(np.arange(len(self.ids)).repeat(len(ids)), np.tile(np.arange(len(ids)), len(self.ids)), ids, x)
            return
        slack = 1e-9 * (1 + np.abs(self.stats[0]).max(initial=0) * np.abs(stats[0]).max(initial=0) * self.x.shape[1]) + 1e-6
        least = self.scores[:, -1] - slack
        q, c = np.nonzero(self.stats[0] @ stats[0].T >= least[:, None])
        for mine, other in zip(self.stats[1:], stats[1:], strict=True):
            if len(q) * 4 > len(self.ids) * len(ids):  # still dense: one product for all
                dense = np.zeros((len(self.ids), len(ids)), bool)
                dense[q, c] = True
                q, c = np.nonzero(dense & (mine @ other.T >= least[:, None]))
            else:
                alive = np.concatenate([np.einsum("ij,ij->i", mine[q[p]], other[c[p]]) >= least[q[p]] for p in _cuts(len(q), mine.shape[1])])
                q, c = q[alive], c[alive]
        self._score(q, c, ids, x)

    def _score(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        for part in _cuts(len(q), x.shape[1]):
            self._score_part(q[part], c[part], ids, x)

    def _score_part(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        own = self.ids[q] != ids[c]
        q, c = q[own], c[own]
        self.exact += np.bincount(q, minlength=len(self.exact))
        score = np.einsum("ij,ij->i", self.x[q], x[c])
        good = score >= self.scores[q, -1]
        q, score, cand = q[good], score[good], ids[c[good]]
        for i in np.unique(q):
            at = q == i
            s, v = np.r_[self.scores[i], score[at]], np.r_[self.found[i], cand[at]]
            order = np.lexsort((v, -s))[: self.k]
            self.scores[i], self.found[i] = s[order], v[order]

    def rows(self, cell: int) -> pa.RecordBatch:
        real = np.isfinite(self.scores)
        ids, exact = (np.broadcast_to(x[:, None], real.shape)[real] for x in (self.ids, self.exact))
        return pa.record_batch([pa.array(ids), pa.array(self.found[real]), pa.array(self.scores[real].astype(np.int64)), pa.array(exact), pa.array(np.full(len(ids), cell, np.int32))], names=["query_id", "vec_id", "score", "exact", "cell"])


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, v, dim) -> blocks of at most ``size`` rows of one length: dim, ids, values (int64 bytes)."""
    held: dict[int, list] = {}
    kind = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])

    def block(dim: int) -> pa.RecordBatch:
        ids, data = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
        return pa.record_batch([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], schema=kind)

    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            ids = part.column("id").to_numpy()
            data = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
            for at in range(0, len(ids), size):
                held.setdefault(dim, []).append((ids[at : at + size], data[at : at + size]))
                if sum(len(x[0]) for x in held[dim]) >= size:
                    yield block(dim)
    for dim in list(held):
        yield block(dim)


def _search(k: int):
    """Blocks ordered by cell, queries before candidates -> the k best of each query in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[BestK] = []
        cell = None
        for batch in batches:
            for row in batch.to_pylist():
                if (here := (row["dim"], row["g"], row["h"])) != cell:
                    yield from (b.rows(cell[2]) for b in best)
                    best, cell = [], here
                ids = np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["data"], np.int64).reshape(len(ids), row["dim"]).astype(np.float64)
                if not row["kind"]:
                    best.append(BestK(ids, x, k))
                elif best:
                    stats = [_segments(x, g) for g in levels(row["dim"])]
                    for b in best:
                        b.meet(ids, x, stats)
        yield from (b.rows(cell[2]) for b in best)

    return run


def quantized(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component as longs; null where the vector takes no part."""
    double = F.transform(vector, lambda x: x.cast("double"))
    good = vector.isNotNull() & ~F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(good, F.transform(double, lambda x: F.floor(x * scale).cast("long")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", counts: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest integer inner product for each query row.

    With ``counts`` also exact: how many of the query's candidates the bounds left for exact scores.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), quantized(F.col(vector_column)).alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn("dim", F.size("v").cast("int"))
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v").cast("int"))

    def blocks(of: DataFrame, size: int, label: str) -> tuple[DataFrame, int]:
        packed = of.select("id", "v", "dim").mapInArrow(lambda b: _pack(b, size), "dim int, ids binary, data binary")
        packed = written(packed.withColumn("block", F.monotonically_increasing_id()), label)
        return packed, packed.count()

    queries, n_queries = blocks(asked, QUERY_BLOCK, "topk-queries")
    candidates, n_candidates = blocks(rows, CANDIDATE_BLOCK, "topk-candidates")
    across = max(1, -(-n_queries // QUERY_GROUP))
    down = max(1, min(n_candidates, max(n_candidates // CANDIDATE_GROUP, 4 * n_partitions(spark))))
    row, column = F.pmod(F.xxhash64("block"), F.lit(across)).cast("int"), F.pmod(F.xxhash64("block"), F.lit(down)).cast("int")
    asks = queries.select("dim", row.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("h"), F.lit(False).alias("kind"), "block", "ids", "data")
    offers = candidates.select("dim", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("g"), column.alias("h"), F.lit(True).alias("kind"), "block", "ids", "data")
    cells = asks.unionByName(offers).repartition(n_partitions(spark), "dim", "g", "h").sortWithinPartitions("dim", "g", "h", "kind", "block")
    found = written(cells.drop("block").mapInArrow(_search(k), FOUND), "topk-found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    if not counts:
        return best
    # a query's count stands on each row that a cell keeps of it; cells differ in what they keep
    seen = found.groupBy("query_id", "cell").agg(F.max("exact").alias("exact")).groupBy("query_id").agg(F.sum("exact").alias("exact"))
    return best.join(seen, "query_id")


def top_k_brute(ids: np.ndarray, x: np.ndarray, asks: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """The same by plain products, for tests on small inputs."""
    out = []
    for i in np.flatnonzero(asks):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), int(score[j])) for r, j in enumerate(order)]
    return sorted(out)


