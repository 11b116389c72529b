"""Exact ranked lexical search by dual trees: every document against every item, whole batches pruned at once.

Terms are the maximal runs of digits, letters and all that is not ASCII, with A-Z lower-cased. One pass over the texts
keeps, for each document, its number of terms and how often it has each term of the items; document frequencies, the number of
documents and the number of terms are sums over that table. A document is then a sparse vector of saturated
frequencies, an item one of weights, all whole numbers and none below 0, and a score is their inner product.

Items and documents are put in trees whose nodes hold the largest value of each coordinate: items, ordered by their rarest
terms, in nodes of 8; a task's documents in leaves of 4 and nodes of 256, ordered by their rarest terms so that those
that share them lie together. The inner product of two nodes' maxima is at least every score between them;
where it does not reach the weakest k-th score of the node's items so far, or 0, the whole pair of nodes is done. Pairs of
nodes that are left go on to their leaves, pairs of leaves to exact scores. The k-th scores begin with those of a
first search over about ``SEED_DOCS`` documents, which every task is given. Each task tells the k best of each item, and these
are ranked.

Items are taken in parts of at most ``PART_CELLS`` items times distinct terms (an item of more is a part of its own), so that
what is sent to every task is bounded; each part is searched in all documents.

Defined cases: a null text has no terms; documents without terms count nowhere; documents without an id count in the
statistics but cannot be told; rows that repeat are documents each. An item id that repeats, the null one included, is one item, with the
least of its texts; items without terms, and documents of score 0, give no rows. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, arrow_batches, slices

#: What stands for a term's bytes: themselves, a-z for A-Z, and a blank for all that ends a term.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
PART_CELLS = 1 << 23
SEED_DOCS = 8192
LEAF_ITEMS, NODE_ITEMS = 1, 8  # items a leaf, leaves a node
LEAF_DOCS, NODE_DOCS = 4, 256
#: Cells of a node's dense block.
CELLS = 1 << 23
BUFFER = 1 << 14  # documents that are ordered together
#: bytes of term counts in a buffer
BUFFER_BYTES = 32 << 20
VECTORS = "doc_id bigint, n bigint, terms array<int>, tf array<bigint>"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order; lone surrogates count as what is not ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES).split(b" ") if text else []


def counted(text: str | None) -> tuple[int, Counter[bytes]]:
    counts = Counter(terms_of(text))
    del counts[b""]
    return counts.total(), counts


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def saturated(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L, in whole numbers."""
    if 25 * n_docs * int(n.max(initial=0)) < 1 << 62:
        m = 75 + 25 * n * n_docs // n_terms
    else:
        m = np.array([75 + 25 * int(v) * n_docs // n_terms for v in n], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _vectors(vocabulary):
    """Batches of doc_id and text -> VECTORS, documents without terms left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                ids, sizes, terms, tfs, ends = [], [], [], [], [0]
                for i, text in enumerate(part):
                    n, counts = counted(text)
                    if n:
                        found = sorted((number[t], c) for t, c in counts.items() if t in number)
                        ids.append(at + i)
                        sizes.append(n)
                        terms += [t for t, _ in found]
                        tfs += [c for _, c in found]
                        ends.append(len(terms))
                at += len(part)
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))],
                    names=["doc_id", "n", "terms", "tf"])

    return run


class ItemTree:
    """Items as rows of weights over the part's terms, ordered by rarest terms, with the maxima of leaves and nodes."""

    def __init__(self, counts: list[dict[int, int]], weights: np.ndarray, k: int):
        rarest = [tuple(sorted(c, key=lambda t: (-weights[t], t))[:4]) for c in counts]
        self.order = sorted(range(len(counts)), key=lambda i: rarest[i])  # place in the tree -> item
        self.k, size = k, LEAF_ITEMS * NODE_ITEMS
        self.rows = np.zeros((-(-len(counts) // size) * size, len(weights)))
        for place, item in enumerate(self.order):
            for t, c in counts[item].items():
                self.rows[place, t] = c * weights[t]
        self.leaves = self.rows.reshape(-1, LEAF_ITEMS, len(weights)).max(axis=1)
        self.nodes = self.leaves.reshape(-1, NODE_ITEMS, len(weights)).max(axis=1)
        self.exact = float(self.rows.sum(axis=1).max(initial=0)) * 1e6 < 2**53  # products of floats are whole
        self.scores = np.zeros((len(self.rows), k), np.int64)
        self.ids = np.full((len(self.rows), k), np.iinfo(np.int64).max)
        self.least = np.full(len(self.rows), np.iinfo(np.int64).max)  # places without an item prune all
        self.least[: len(counts)] = 1
        self.met = 0  # exact scores

    def start(self, least: np.ndarray) -> None:
        """Scores that the k-th ones are known to reach, by item."""
        self.least[: len(self.order)] = np.maximum(least[self.order], 1)

    def _bound(self, items: np.ndarray, docs: np.ndarray) -> np.ndarray:
        bound = items @ docs.T
        return bound if self.exact else bound * (1 + 1e-9)

    def search(self, ids: np.ndarray, docs: np.ndarray) -> None:
        """Documents of one node: a dense block of saturated frequencies, leaf after leaf."""
        starts = np.arange(0, len(docs), LEAF_DOCS)
        leaves = np.maximum.reduceat(docs, starts, axis=0).astype(float)
        weakest = self.least.reshape(-1, LEAF_ITEMS).min(axis=1)
        alive = self._bound(self.nodes, leaves.max(axis=0)[None])[:, 0] >= weakest.reshape(-1, NODE_ITEMS).min(axis=1)
        at = np.flatnonzero(alive.repeat(NODE_ITEMS))
        if not len(at):
            return
        bounds = self._bound(self.leaves[at], leaves)
        meets = bounds >= weakest[at, None]
        # leaves of high bounds first: they raise the k-th scores
        for j in np.argsort(-np.where(meets, bounds, -1).max(axis=0), kind="stable").tolist():
            mine = at[meets[:, j]]
            if not len(mine):
                break
            mine = mine[bounds[meets[:, j], j] >= self.least.reshape(-1, LEAF_ITEMS)[mine].min(axis=1)]
            if len(mine):
                part = slice(starts[j], starts[j] + LEAF_DOCS)
                self._score((mine[:, None] * LEAF_ITEMS + np.arange(LEAF_ITEMS)).ravel(), ids[part], docs[part])

    def _score(self, places: np.ndarray, ids: np.ndarray, docs: np.ndarray) -> None:
        rows = self.rows[places]
        used = np.flatnonzero(rows.any(axis=0))
        if self.exact:
            scores = (rows[:, used] @ docs[:, used].T.astype(float)).astype(np.int64)
        else:
            scores = rows[:, used].astype(np.int64) @ docs[:, used].T.astype(np.int64)
        self.met += scores.size
        for i in np.flatnonzero((scores >= self.least[places, None]).any(axis=1)):
            place, good = places[i], scores[i] >= self.least[places[i]]
            s, v = np.r_[self.scores[place], scores[i, good]], np.r_[self.ids[place], ids[good]]
            best = np.lexsort((v, -s))[: self.k]
            self.scores[place], self.ids[place] = s[best], v[best]
            self.least[place] = max(self.least[place], self.scores[place, -1])

    def best(self) -> Iterator[tuple[int, int, int]]:
        for place, item in enumerate(self.order):
            for s, v in zip(self.scores[place].tolist(), self.ids[place].tolist(), strict=True):
                if s > 0:
                    yield item, v, s


def _search(shared):
    """Batches of VECTORS -> item, doc_id, score: the k best of each item among a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights, n_docs, n_terms, k, least = shared.value
        tree = ItemTree(counts, weights, k)
        if least is not None:
            tree.start(least)
        size = max(LEAF_DOCS, min(NODE_DOCS, CELLS // max(len(weights), 1)) // LEAF_DOCS * LEAF_DOCS)
        held, rows, held_bytes = [], 0, 0

        def meet() -> None:
            batch = pa.Table.from_batches(held).combine_chunks()
            lengths = np.diff(batch["terms"].combine_chunks().offsets.to_numpy())
            terms = batch["terms"].combine_chunks().flatten().to_numpy()
            tf, n = batch["tf"].combine_chunks().flatten().to_numpy(), batch["n"].to_numpy()
            value = saturated(tf, np.repeat(n, lengths), n_docs, n_terms)
            ids, ends = batch["doc_id"].to_numpy(), np.r_[0, np.cumsum(lengths)]
            # rarest terms of each document, then documents by these
            owner = np.repeat(np.arange(len(ids)), lengths)
            rare = np.lexsort((terms, -weights[terms], owner))
            first = np.full((len(ids), 3), -1)
            place = np.arange(len(terms)) - ends[owner]
            for j in range(3):
                at = place == j
                first[owner[at], j] = terms[rare][at]
            order = np.lexsort((first[:, 2], first[:, 1], first[:, 0]))
            for start in range(0, len(order), size):
                mine = order[start : start + size]
                block = np.zeros((len(mine), len(weights)), np.float32)  # values are at most 10^6: exact
                where = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in mine]) if len(mine) else np.zeros(0, int)
                block[np.repeat(np.arange(len(mine)), lengths[mine]), terms[where]] = value[where]
                tree.search(ids[mine], block)

        for batch in batches:
            held.append(batch)
            rows, held_bytes = rows + batch.num_rows, held_bytes + batch.nbytes
            if rows >= BUFFER or held_bytes >= BUFFER_BYTES:
                meet()
                held, rows, held_bytes = [], 0, 0
        if rows:
            meet()
        found = list(tree.best())
        columns = list(zip(*found, strict=True)) if found else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array([tree.met] * len(found), pa.int64())], names=["item", "doc_id", "score", "met"])

    return run


def _parts(items: DataFrame, item_column: str, text_column: str) -> Iterator[list[tuple]]:
    """(item id, counts of its terms), in lists of at most PART_CELLS items times terms; items come to the driver one part at a time."""
    single = items.groupBy(F.col(item_column).alias("item")).agg(F.min(text_column).alias("text")).orderBy("item")
    part, known = [], set()
    for row in single.toLocalIterator():
        n, counts = counted(row["text"])
        if not n:
            continue
        if part and (len(part) + 1) * len(known | counts.keys()) > PART_CELLS:
            yield part
            part, known = [], set()
        part.append((row["item"], counts))
        known |= counts.keys()
    if part:
        yield part


def search(documents: DataFrame, items: DataFrame, k: int = 20, doc_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", counts: bool = False) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents of highest score above 0 for each item.

    With ``counts`` also met: how many exact scores the tasks that found an item's documents took in all.
    """
    spark = documents.sparkSession
    arrow_batches(spark)
    context, steps, found = spark.sparkContext, Steps(spark), []
    rows = documents.select(F.col(doc_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    kind = items.select(F.col(item_column)).dtypes[0][1]
    for part in _parts(items, item_column, item_text):
        number = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in part))))}
        vocabulary = context.broadcast(number)
        vectors = steps(rows.mapInArrow(_vectors(vocabulary), VECTORS), "lexical-vectors")
        n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(number), np.int64)  # as many as the part has terms
        for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[r["t"]] = r["count"]
        weights = np.array([weight(n_docs, d) for d in df.tolist()], np.int64)
        wanted = [{number[t]: c for t, c in own.items()} for _, own in part]
        told = vectors.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0))
        out = "item int, doc_id bigint, score bigint, met bigint"

        def ranked(of: DataFrame, least: np.ndarray | None) -> DataFrame:
            best = of.mapInArrow(_search(context.broadcast((wanted, weights, n_docs, n_terms, k, least))), out)  # noqa: B023
            order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
            return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        # a document in so many, by its id: the k-th scores among these are reached among all
        seed = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_docs // SEED_DOCS))) == 0)
        least = np.zeros(len(part), np.int64)
        for r in ranked(seed, None).where(F.col("rank") == k).select("item", "score").toLocalIterator():
            least[r["item"]] = r["score"]
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(part)], f"item int, item_id {kind}")
        found.append(steps(ranked(told, least).join(F.broadcast(names), "item").select(F.col("item_id").alias(item_column), "rank", "doc_id", "score", "met"), "lexical-found"))
        steps.drop(vectors)
    if not found:
        return spark.createDataFrame([], f"`{item_column}` {kind}, rank int, doc_id bigint, score bigint" + (", met bigint" if counts else ""))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole if counts else whole.drop("met")


def search_brute(documents: list[tuple[int, str]], items: list[tuple[int, str]], k: int = 20) -> list[tuple[int, int, int, int]]:
    """The same by plain loops, for tests."""
    docs = [(i, *counted(t)) for i, t in documents]
    docs = [d for d in docs if d[1]]
    n_docs, n_terms = len(docs), sum(d[1] for d in docs)
    out = []
    for item, text in items:
        best = []
        for i, n, own in docs:
            m = 75 + 25 * n * n_docs // n_terms
            score = 0
            for t in terms_of(text):
                if t and own[t]:
                    score += weight(n_docs, sum(t in d[2] for d in docs)) * (1_000_000_000 * own[t] // (1000 * own[t] + 12 * m))
            if score > 0 and i is not None:
                best.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(best)[:k])]
    return sorted(out)
