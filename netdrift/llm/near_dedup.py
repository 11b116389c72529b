"""Near-duplicate documents by order MinHash, verified by banded alignment.

Text is lower-cased and read as words. Texts of equal words form one text first, by a hash of the words, so that
exact copies meet nothing but their representative.

1. Sketch. A text's k-mers (``K`` = 3 consecutive words) are labelled with which occurrence of the k-mer they are.
   For each of ``SKETCHES`` hash functions the ``L`` = 2 labelled k-mers of least hash are taken and put in the order
   in which they stand in the text (order MinHash; Marcais and others 2019). Two texts get the same sketch with a
   probability that falls with their edit distance, not only their overlap. Texts of ``LEAST`` to ``SHORT`` words
   also have each of their k-mers as a sketch.
2. Candidates. Texts with an equal sketch share a bucket. A first round links each text with the smallest that it meets.
   Of the buckets whose members are then in several classes, members of one of up to ``FEW`` are all candidates of
   each other. The texts of larger ones (hot: a template, a long passage) meet by an exact filter, so that no pair is lost:
   texts with a similarity of ``SIMILARITY`` have so many k-mers in common that the rarest three fifths of each (and
   ``COMMON`` more) hold ``COMMON`` of them (prefix filter). Texts that share so many there are candidates where up to ``COLD``
   texts have each; those with a k-mer there that more texts of several classes have go through the same filter by runs of
   two words (the rarest two fifths), then by words (the rarest fifth), and those that are left after that (texts of nothing
   but shared passages) are compared all with all, by blocks. Which k-mers are rare is told by exact counts.
   Texts of up to 9 words may differ by one edit. They meet, whatever a bucket's size, by what is left without one
   word and by the gap where it stood: all texts with an equal one are links of each other (see ``variants``).
3. Verification. The similarity is 1 - (edit distance of the words) / (words of the longer text), and a candidate
   is a link at ``SIMILARITY`` or more. Lengths and shared words bound it first; then a bit-parallel alignment in
   the band of diagonals that such a similarity allows (Hyyro 2003) gives the distance.
4. Classes are the connected components of the links, by repeated steps to the smallest neighbour, each step
   written to the shared folder. A class is named by its smallest document id.

Recall: for two texts whose k-mers overlap by J a sketch agrees with probability of about J^2. Edits at random
places leave J = 0.34 at a similarity of 0.80, and one of 64 sketches agrees with probability 0.9997. Texts of 10
to 50 words at 0.80 have 2 k-mers in common at least, whatever the edits' places; of 5 to 9 words none is lost.
A pair that shares a bucket, of whatever size, is always compared, unless its texts are in one class by then; what may
be lost is a pair without any sketch in common. The texts left to blocks cost time with the square of their number.

Defined cases: null and empty texts, and texts without words, are copies only of texts that are equal to them;
rows with a null id take no part; rows that repeat an id give one row for each text (of equal words), and each
text has a class of its own links; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, arrow_batches, fresh, join_sized, slices, trim, trimmed, written

K = 3
L = 2
SKETCHES = 64
#: Words of the texts whose every k-mer is a sketch; members of a bucket in which all meet.
LEAST, SHORT = 8, 50
FEW = 8
#: Words of the grams of the exact filter, one round each; rare grams that a pair must have in common; texts with a gram in common
#: that all meet.
GRAMS = (3, 2, 1)
COMMON = 2
COLD = 32
#: Texts and words of a block of those that meet all others, and the bins of a text's words there, few for all and more for those left.
BLOCK, BLOCK_WORDS, BINS, FINE = 512, 1 << 18, 64, 512
#: Shelves of blocks at least, where there are so many blocks, the blocks of a shelf where there are more, and the bytes that a run of
#: shelves may move at least.
SHELVES, SHELF, ROOM = 24, 16, 1 << 28
#: Texts that a task remembers in order to sketch copies once.
KNOWN = 500_000
#: Pairs of one text that stay together, and parts over which those of a text with more are dealt.
MANY = 1_000
SALTS = 64
#: Edges that a task of a step of components() writes, and the tasks of a smaller one.
EDGES, FEW_TASKS = 20_000, 8
SIMILARITY = 0.8
CACHE_WORDS = 200_000
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_hashes(found: list[str], table: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each word; ``table`` keeps those met so far."""
    import xxhash

    for w in set(found).difference(table):
        table[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) >> 1
    return np.fromiter(map(table.__getitem__, found), np.int64, len(found)).view(np.uint64)


_MIX = np.random.default_rng(20190709).integers(1, 1 << 62, (3, 64), dtype=np.uint64) | np.uint64(1)


def kmer_hashes(w: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each run of k words, and of the whole where it is shorter."""
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ w[i : len(w) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 / golden ratio
            h ^= h >> np.uint64(29)
    return h


def occurrences(h: np.ndarray) -> np.ndarray:
    """For each item, how many equal ones stand before it."""
    order = np.argsort(h, kind="stable")
    fresh = np.r_[True, h[order][1:] != h[order][:-1]]
    at = np.arange(len(h))
    out = np.empty(len(h), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return out


def labelled(w: np.ndarray, k: int = K) -> np.ndarray:
    """The hashes of a text's k-mers with which occurrence each is."""
    h = kmer_hashes(w, k)
    with np.errstate(over="ignore"):
        return h + occurrences(h).astype(np.uint64) * _MIX[2, 0] if len(h) else h


def order_minhash(w: np.ndarray, n: int = SKETCHES, k: int = K) -> np.ndarray:
    """``n`` sketches: a hash of the two least labelled k-mers in text order."""
    h = labelled(w, k)
    if not len(h):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = _MIX[0, :n, None] * h
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX[1, :n, None]
        rows = np.arange(n)
        a = mixed.argmin(axis=1)
        one = mixed[rows, a]
        if len(h) == 1:
            return one.view(np.int64)
        mixed[rows, a] = np.uint64(0xFFFFFFFFFFFFFFFF)
        b = mixed.argmin(axis=1)
        two = mixed[rows, b]
        first, second = np.where(a < b, one, two), np.where(a < b, two, one)
        return ((first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + (first >> np.uint64(17)))).view(np.int64)


def buckets(w: np.ndarray) -> np.ndarray:
    """The buckets of a text: its sketches, and each k-mer of a short one."""
    if len(w) < LEAST:
        return np.zeros(0, np.int64)
    found = order_minhash(w)
    return np.r_[found, labelled(w).view(np.int64)] if len(w) <= SHORT else found


def most_edits(n: int, least: float) -> int:
    """The edits that a similarity of ``least`` allows where the longer text has ``n`` words."""
    return int((1 - least) * n + 1e-9)


@functools.lru_cache(1 << 16)
def rare_grams(n: int, k: int, least: float) -> int:
    """How many of the rarest labelled k-mers of a text of ``n`` words hold ``COMMON`` that any similar text has among its own.

    An edit changes at most k of them, so a text of m >= n words has m - k + 1 - k * edits of them in common with this one.
    """
    m = np.arange(n, int(n / least) + 2)
    edits = np.floor((1 - least) * m + 1e-9).astype(np.int64)
    return int((n - m + k * edits)[m - edits <= n].max()) + COMMON


def filters(k: int, least: float) -> bool:
    """Whether texts of ``LEAST`` words or more with that similarity have ``COMMON`` k-mers in common for certain."""
    return all(n - k + 1 - k * most_edits(n, least) >= COMMON for n in range(LEAST, 1000))


def variants(w: np.ndarray) -> list[int]:
    """Keys that texts of 4 to 9 words share where one edit makes them equal; none for others.

    A key is some words and a gap among them. The text of these words has it for every gap; a text with one word
    more has it for the gap of that word. Any two of those are one edit apart, which is a link where the longer
    has 5 words or more; the lowest bit says whether this text is so long.
    """
    import xxhash

    n = len(w)
    if not 4 <= n <= 9:
        return []
    rest = [(w, g) for g in range(n + 1)] + [(np.delete(w, i), i) for i in range(n)]
    return [xxhash.xxh64_intdigest(x.tobytes(), seed=g) >> 2 << 1 | (n >= 5) for x, g in rest]


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most`` + 1.

    Bit-parallel in a band (Hyyro 2003): the longer sequence is the pattern; one integer holds the vertical
    differences of 2 * most + 2 rows and slides one row down with each item of the other. The distance is followed
    down the lowest diagonal to the pattern's end, then along its last row.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    if not m:
        return n
    band = min(most, n)
    width = 2 * band + 2
    full, lowest, row = (1 << width) - 1, width - 1, width - 2
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    up, down = full ^ ((1 << (width - band - 1)) - 1), 0
    shift, distance = band + 1 - width, band
    spare = most + m - (n - band)  # the last row can win back one for each item
    for j, x in enumerate(b):
        mask = places.get(x, 0)
        match = (mask >> shift if shift >= 0 else mask << -shift) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right_up = down | (full & ~(diagonal | up))
        right_down = diagonal & up
        if j < n - band:
            distance += not diagonal >> lowest & 1
            if distance > spare:
                return most + 1
        else:
            distance += (right_up >> row & 1) - (right_down >> row & 1)
            row -= 1
            if distance - (m - 1 - j) > most:
                return most + 1
        diagonal >>= 1
        up = (right_down | (full & ~(diagonal | right_up))) & full
        down = diagonal & right_up
        shift += 1
    return distance if distance <= most else most + 1


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length is at least ``least``, by bounds first and then by alignment."""
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    most = most_edits(longer, least)
    if longer - shorter > most:
        return False
    differ = np.flatnonzero(a[:shorter] != b[:shorter])
    if not len(differ):
        return True  # one begins the other
    low = int(differ[0])
    back = np.flatnonzero(a[::-1][: shorter - low] != b[::-1][: shorter - low])
    tail = int(back[0]) if len(back) else shorter - low
    a, b = a[low : len(a) - tail], b[low : len(b) - tail]
    values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    if len(a) and len(b):
        own = np.bincount(np.searchsorted(values, a), minlength=len(values))
        if max(len(a), len(b)) - int(np.minimum(own, counts - own).sum()) > most:
            return False
    return banded_distance(a.tolist(), b.tolist(), most) <= most


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
    table: dict[str, int] = {}
    known: set[bytes] = set()
    for batch in batches:
        at = 0
        for texts in slices(batch.column("text")):
            if len(table) > CACHE_WORDS:
                table.clear()
            rows = []
            for text in texts:
                w = word_hashes(words(text), table)
                key = xxhash.xxh128_digest(w.tobytes() if len(w) else b"\0" + text.encode("utf-8", "replace"))
                name = int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), len(w)
                if key in known:  # a copy of a text that this task has told
                    rows.append((*name, None, None, None))
                    continue
                if len(known) > KNOWN:
                    known.clear()
                known.add(key)
                rows.append((*name, buckets(w), variants(w), (w >> np.uint64(20)).astype(np.uint32).tobytes()))
            same = batch.select(["doc_id", "text_hash"]).slice(at, len(rows)).columns
            at += len(rows)
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "text_hash", "a", "b", "size", "buckets", "variants", "tokens"])


def _grams(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    return [labelled(np.frombuffer(x.as_py(), np.uint32).astype(np.uint64), k) for x in batch.column("tokens")]


def _all_grams(k: int):
    """node, root (null where it is the node), bucket: every labelled k-mer of each text."""

    def run(batches):
        for batch in batches:
            found = _grams(batch, k)
            if not found:
                continue
            times = [len(x) for x in found]
            node, root = (np.repeat(np.array(batch.column(c), np.int64), times) for c in ("node", "root"))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root, mask=root == node), pa.array(np.concatenate(found).view(np.int64))], ["node", "root", "bucket"])

    return run


def _needed(k: int, least: float):
    """``rare_grams`` of a number of words."""
    def run(size: pa.Array) -> pa.Array:
        return pa.array([rare_grams(n, k, least) for n in size.to_pylist()], pa.int64())

    run.__annotations__ = {"size": pa.Array, "return": pa.Array}
    return run


def _blocks(batches):
    """Texts, which come by their number of words, in blocks."""
    names = ["low", "high", "root", "nodes", "roots", "texts"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()))

    def block(held):
        nodes, roots, texts = zip(*held, strict=True)
        sizes = [len(x) // 4 for x in texts]
        row = min(sizes), max(sizes), roots[0] if len(set(roots)) == 1 else None, nodes, roots, texts
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    held, held_words = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("node", "root", "tokens")), strict=True):
            held.append(row)
            held_words += len(row[2]) // 4
            if len(held) >= BLOCK or held_words >= BLOCK_WORDS:
                yield block(held)
                held, held_words = [], 0
    if held:
        yield block(held)


def _binned(texts: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    return np.array([np.minimum(np.bincount(w % bins, minlength=bins), 255) for w in texts], np.int16)


def _within(counted: np.ndarray, bins: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which rows of ``bins`` differ from ``counted`` by at most as many words, of either, as ``most`` allows."""
    apart = counted - bins
    return np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1)) <= most


def _reach(low, high, least: float):
    """Whether a text of at least ``low`` words may be similar to one of at most ``high``."""
    return low - int((1 - least) * low + 1e-9) <= high


def _compared(least: float):
    """u, v: links between the texts of two shelves of blocks. Of texts that links, or classes given, already join none is compared."""

    def run(cell: pa.Table) -> pa.Table:
        blocks = cell.sort_by("block").to_pylist()
        parent = {r: r for block in blocks for r in block["roots"]}
        for block in blocks:
            block["texts"] = [np.frombuffer(t, np.uint32) for t in block["texts"]]
            block["bins"], block["fine"] = _binned(block["texts"]), _binned(block["texts"], FINE)
            block["sizes"], block["roots"] = np.array([len(w) for w in block["texts"]]), np.array(block["roots"])

        def root(r):
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        links = []
        for a, x in enumerate(blocks):
            for b, y in enumerate(blocks):
                # blocks of two shelves meet here, those of one where the shelf meets itself
                if b < a or (x["shelf"] == y["shelf"]) != (x["a"] == x["b"]) or not (_reach(x["low"], y["high"], least) and _reach(y["low"], x["high"], least)):
                    continue
                if x["root"] is not None and x["root"] == y["root"]:
                    continue
                for i, (w, counted) in enumerate(zip(x["texts"], x["bins"], strict=True)):
                    longer = np.maximum(y["sizes"], len(w))
                    most = np.floor((1 - least) * longer + 1e-9)
                    near = (longer - np.minimum(y["sizes"], len(w)) <= most) & (y["roots"] != x["roots"][i])
                    if a == b:
                        near[: i + 1] = False
                    at = np.flatnonzero(near)
                    at = at[_within(counted, y["bins"][at], most[at])]
                    at = at[_within(x["fine"][i], y["fine"][at], most[at])]
                    for j in at.tolist():
                        one, two = root(x["roots"][i].item()), root(y["roots"][j].item())
                        if one != two and similar(w, y["texts"][j], least):
                            parent[max(one, two)] = min(one, two)
                            links.append((x["nodes"][i], y["nodes"][j]))
        u, v = zip(*links, strict=True) if links else ((), ())
        out = pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        del blocks, parent, cell
        trim()
        return out

    return run


def _verify(least: float):
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([similar(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), least) for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())

    run.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return run


def components(edges: DataFrame, label: str = "near-edges", steps: Steps | None = None) -> DataFrame:
    """node, root (the smallest node of its component) of every node of ``edges`` (u, v).

    Large-star and small-star steps (Kiveris and others 2014), each written to the shared folder by as many tasks as its
    edges need, until all edges are stars: no node has two edges to smaller ones, or one and one to a larger. A step
    that has been taken is removed.
    """
    steps = steps or Steps(edges.sparkSession)
    edges = steps(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), label)
    while True:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select("v", F.lit(0), F.lit(1)).toDF("node", "down", "up"))
        nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        n, stars = nodes.agg(F.sum("down"), F.min(F.col("down") + F.when(F.col("down") > 0, F.col("up")).otherwise(0) <= 1)).first()
        if stars is None or stars:
            break
        put = lambda rows, n=n: steps(rows.coalesce(max(FEW_TASKS, n // EDGES)), label)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = put(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = put(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        steps.drop(edges, least)
        least = put(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = put(joined.where("u <> v").distinct())
        steps.drop(large, least)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _links(pairs: DataFrame, tokens: DataFrame, least: float, steps: Steps) -> DataFrame:
    """The pairs (x, y) whose texts are similar. A text with over ``MANY`` pairs is dealt, with them, over ``SALTS``.

    Such texts are broadcast, since there is less than one for ``MANY`` pairs, so that the tokens are not moved to meet them.
    """
    hot = F.broadcast(pairs.groupBy("x").count().where(F.col("count") > MANY).select("x", F.lit(SALTS).alias("salts")))
    dealt = pairs.join(hot, "x", "left").select("x", "y", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("y"), "salts")).otherwise(0).cast("int").alias("salt"))
    of_x = tokens.withColumnsRenamed({"node": "x", "tokens": "tx"}).join(hot, "x", "left")
    of_x = of_x.select("x", "tx", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    both = dealt.join(of_x.hint("merge"), ["x", "salt"]).join(tokens.withColumnsRenamed({"node": "y", "tokens": "ty"}).hint("merge"), "y")
    return steps(both.where(F.arrow_udf(_verify(least), "boolean")("tx", "ty")).select(F.col("x").alias("u"), F.col("y").alias("v")), "near-links")


def _shared(members: DataFrame, steps: Steps, label: str) -> DataFrame:
    """``members`` (node, bucket) of buckets that two texts or more share, with the bucket's smallest node, low, and n.

    By a window, which moves each row once; a bucket's rows, of two numbers, meet in one task, as they would to be sorted.
    """
    whole = Window.partitionBy("bucket")
    return steps(members.withColumns({"low": F.min("node").over(whole), "n": F.count("*").over(whole)}).where("n > 1"), label)


def _of_several(shared: DataFrame, roots: DataFrame, steps: Steps, label: str) -> DataFrame:
    """node, bucket, n of ``shared`` without the buckets whose members are all in one component (``roots``: node, root) already."""
    known = shared.select("node", "bucket", "n").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return steps(_mixed(known).drop("root"), label)


def _mixed(members: DataFrame) -> DataFrame:
    """``members`` of the buckets that hold several roots."""
    whole = Window.partitionBy("bucket")
    ends = members.withColumns({"_a": F.min("root").over(whole), "_b": F.max("root").over(whole)})
    return ends.where("_a < _b").drop("_a", "_b")


def _candidates(shared: DataFrame) -> DataFrame:
    """node, other: members of a bucket with each other."""
    all_ = shared.groupBy("bucket").agg(F.collect_set("node").alias("all"))
    return all_.select(F.explode("all").alias("node"), "all").select("node", F.explode("all").alias("other")).where("node < other")


def _rare_pairs(texts: DataFrame, k: int, least: float, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """Pairs (x, y) of ``texts`` (node, root, tokens) with ``COMMON`` rare k-mers in common, and the texts (node) with one that too many have.

    Every pair that is similar and of two roots is among the former, or both its texts are among the latter. A text's
    k-mers that no other class has come first, then the others by how many texts have them.
    """
    members = texts.select("node", "root", "tokens").mapInArrow(trimmed(_all_grams(k)), "node bigint, root bigint, bucket bigint")
    counted = members.withColumns({"n": F.count("*").over(Window.partitionBy("bucket")), "root": F.coalesce("root", "node")})
    shared = steps(_mixed(counted).drop("root"), "near-rare-shared")
    size = (F.length("tokens") / 4).cast("bigint")
    told = texts.select("node", "root", size.alias("size"))
    # what is left of the rare k-mers of a text when those that it shares with no other class are taken
    own = Window.partitionBy("node")
    ranked = shared.withColumns({"at": F.row_number().over(own.orderBy("n", "bucket")), "of": F.count("*").over(own)}).join(told.hint("merge"), "node")
    rare = ranked.where(F.col("at") <= F.arrow_udf(_needed(k, least), "bigint")("size") - (F.col("size") - (k - 1) - F.col("of")))
    rare = steps(rare.select("node", "size", "root", "bucket", "n"), "near-rare")
    steps.drop(shared)
    cold = rare.where(F.col("n") <= COLD).groupBy("bucket").agg(F.collect_list(F.struct("node", "size", "root")).alias("all"))

    def other(one, o):
        longer = F.greatest(one["size"], o["size"])
        return (o["node"] > one["node"]) & (o["root"] != one["root"]) & (longer - F.least(one["size"], o["size"]) <= F.floor((1 - least) * longer + 1e-9))

    met = cold.select(F.explode("all").alias("one"), "all").select("one.node", F.explode(F.filter("all", lambda o: other(F.col("one"), o))).alias("o"))
    pairs = met.groupBy(F.col("node").alias("x"), F.col("o.node").alias("y")).count().where(F.col("count") >= COMMON)
    pairs = steps(pairs.select("x", "y"), "near-rare-pairs")
    rest = steps(rare.where(F.col("n") > COLD).select("node").distinct(), "near-rest")
    steps.drop(rare)
    return pairs, rest


def _all_links(texts: DataFrame, least: float, steps: Steps, room: int = 0) -> DataFrame:
    """Links (u, v) between ``texts`` (node, root, tokens) of different roots, each compared with all of about its length, block by block.

    Blocks of about one length form a shelf, and a shelf meets another in one task, so that a block is moved once for each shelf that its own
    meets, not for each block. What that moves is dealt over as many runs as keep each within about ``room`` bytes, or ``ROOM`` where that is less.
    """
    ordered = texts.select("node", "root", "tokens").repartitionByRange(F.length("tokens"), "node").sortWithinPartitions(F.length("tokens"))
    ordered = ordered.coalesce(texts.count() // BLOCK + 1)  # else a block is as small as a partition, and their pairs grow with the square of the partitions
    kind = "low bigint, high bigint, root bigint, nodes array<bigint>, roots array<bigint>, texts array<binary>"
    blocks = steps(ordered.mapInArrow(trimmed(_blocks), kind).withColumn("block", F.monotonically_increasing_id()), "near-blocks")
    n = blocks.count()
    bytes_ = F.aggregate("texts", F.lit(0).cast("bigint"), lambda all_, t: all_ + F.length(t))
    ends = blocks.select("block", "low", "high", bytes_.alias("bytes"))
    ends = steps(ends.withColumn("shelf", F.ntile(min(n, max(SHELVES, n // SHELF + 1))).over(Window.orderBy("low", "block"))), "near-shelves")
    shelves = ends.groupBy("shelf").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("bytes").alias("bytes"))
    side = lambda x: shelves.select(*(F.col(c).alias(f"{c}_{x}") for c in shelves.columns))
    reach = lambda x, y: F.col(f"low_{x}") - F.floor((1 - least) * F.col(f"low_{x}") + 1e-9) <= F.col(f"high_{y}")
    met = side("a").join(side("b"), (F.col("shelf_a") <= F.col("shelf_b")) & reach("a", "b") & reach("b", "a"))
    cells = steps(met.select(F.col("shelf_a").alias("a"), F.col("shelf_b").alias("b"), (F.col("bytes_a") + F.col("bytes_b")).alias("bytes")), "near-cells")
    runs = cells.agg(F.sum("bytes")).first()[0] // max(ROOM, room) + 1
    whole = blocks.join(F.broadcast(ends.select("block", "shelf")), "block")
    links = None
    for run in range(runs):
        of_run = cells.where(F.pmod(F.xxhash64("a", "b"), F.lit(runs)) == run).select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("shelf"))
        found = whole.join(F.broadcast(of_run), "shelf").groupBy("a", "b").applyInArrow(_compared(least), "u bigint, v bigint")
        found = steps(found, "near-block-links")
        links = found if links is None else links.unionByName(found)
        steps.release()
    steps.drop(blocks, ends, cells)
    return links


def _classes(docs: DataFrame, least: float, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text_hash, node, root: every row with its text (by its words) and the name of its class of texts.

    A text's node is the number of a row that holds it, given where the rows are written: ids of a task's rows lie side by side,
    which packs what is shuffled, and no two texts share one. Joins of tables that grow with the documents are merged at any
    size, so that a small run moves what a large one does. Links
    are verified in two rounds: first each text with the smallest text that it shares a bucket with, which joins a
    large group by about one alignment for each member; then the candidates of buckets whose members are in several
    components yet, in the larger ones by an exact filter. The texts that it leaves are compared by blocks.
    """
    arrow_batches(docs.sparkSession)
    steps = Steps(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text")).where(F.col("doc_id").isNotNull())
    kind = "doc_id bigint, text_hash bigint, a bigint, b bigint, size bigint, buckets array<bigint>, variants array<bigint>, tokens binary"
    sketched = steps(rows.mapInArrow(trimmed(_sketches), kind).withColumn("node", F.monotonically_increasing_id()), "near-sketches")
    named = steps(sketched.select("doc_id", "text_hash", "a", "b"), "near-rows")
    told = sketched.where(F.col("tokens").isNotNull())
    first = told.groupBy("a", "b").agg(F.min(F.struct("node", "size")).alias("one"))
    texts = steps(first.select("a", "b", "one.node", "one.size"), "near-texts")
    sketches = steps(told.select("node", "buckets", "variants").join(texts.select("node").hint("merge"), "node", "left_semi"), "near-buckets")
    steps.release()

    shared = _shared(sketches.select("node", F.explode("buckets").alias("bucket")), steps, "near-shared")
    keys = sketches.select("node", F.explode("variants").alias("key")).select("node", F.shiftright("key", 1).alias("bucket"), (F.col("key") % 2 == 1).alias("hub"))
    hubs = keys.groupBy("bucket").agg(F.min(F.when(F.col("hub"), F.col("node"))).alias("other"), F.count("*").alias("n")).where("n > 1 AND other IS NOT NULL")
    close = steps(keys.join(hubs, "bucket").select("node", "other").where("node <> other"), "near-close")
    steps.drop(sketches)
    steps.release()
    # candidates are a share of all documents: merged at any size, never broadcast
    some = shared.select("node").unionByName(close.select(F.explode(F.array("node", "other")).alias("node"))).distinct()
    tokens = steps(told.select("node", "tokens").join(some.hint("merge"), "node", "left_semi"), "near-tokens")
    steps.drop(sketched)
    steps.release()

    def like(pairs: DataFrame, label: str) -> DataFrame:
        """The distinct pairs (x, y) of node, other whose lengths allow the similarity."""
        pairs = pairs.select(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y")).where("x <> y").distinct()
        for end in "xy":
            pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("size").alias(f"s{end}")).hint("merge"), end)
        longer = F.greatest("sx", "sy")
        return steps(pairs.where(longer - F.least("sx", "sy") <= F.floor((1 - least) * longer + 1e-9)).select("x", "y"), label)

    nearest = shared.select("node", F.col("low").alias("other")).where("node <> other").unionByName(close).groupBy("node").agg(F.min("other").alias("other"))
    links = _links(like(nearest, "near-first-pairs"), tokens, least, steps)
    steps.release()
    roots = steps(components(links, steps=steps), "near-first")
    steps.release()

    mixed = _of_several(shared, roots, steps, "near-mixed")
    pairs = like(_candidates(mixed.where(F.col("n") <= FEW)).unionByName(close), "near-pairs")
    known = pairs.join(roots.withColumnsRenamed({"node": "x", "root": "rx"}), "x", "left").join(roots.withColumnsRenamed({"node": "y", "root": "ry"}), "y", "left")
    apart = known.where(F.coalesce("rx", "x") != F.coalesce("ry", "y")).select("x", "y")
    hot = steps(mixed.where(F.col("n") > FEW).select("node").distinct(), "near-hot")
    steps.drop(shared, mixed, close)
    steps.release()

    # the texts of hot buckets, with the classes of the first round, are taken from all tokens once; each round leaves some of them
    held = tokens.join(hot.hint("merge"), "node", "left_semi").join(roots.hint("merge"), "node", "left")
    held = steps(held.select("node", F.coalesce("root", "node").alias("root"), "tokens"), "near-hot-texts")
    for k in GRAMS:
        if filters(k, least) and not held.isEmpty():
            met, rest = _rare_pairs(held, k, least, steps)
            apart = apart.unionByName(met)
            before, held = held, steps(held.join(rest.hint("merge"), "node", "left_semi"), "near-rest-texts")
            steps.drop(before, rest)
            steps.release()
    late = _links(steps(apart.distinct(), "near-apart"), tokens, least, steps)
    steps.release()
    if not held.isEmpty():
        late = late.unionByName(_all_links(held, least, steps, room=4 * texts.agg(F.sum("size")).first()[0]))
    first = roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    root = steps(components(first.unionByName(late), steps=steps), "near-roots")
    steps.drop(tokens)
    steps.release()

    classes = texts.join(root.hint("merge"), "node", "left").select("a", "b", "node", F.coalesce("root", "node").alias("root"))
    return steps.keep(steps(named.join(classes, ["a", "b"]).select("doc_id", "text_hash", "node", "root"), "near-classes"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, class_id: every document, once for each text of its id, with the smallest id of its class of near-duplicates."""
    rows = _classes(docs, least, id_column, text_column)
    names = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    return join_sized(rows, names, "root", rows.count()).select("doc_id", "node", "class_id").distinct().select("doc_id", "class_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", least: float = SIMILARITY, text_column: str = "text") -> DataFrame:
    """``docs``, all columns, with one row for each class of texts; rows with a null id stay.

    Of rows that repeat id and text the one whose columns are the largest as JSON is kept.
    """
    rows = _classes(docs, least, id_column, text_column)
    sizes = rows.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = sizes.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("k"))
    key, same, n = fresh(docs, "_key", "_hash", "_n")
    kept = written(kept.select(F.col("k.doc_id").alias(key), F.col("k.text_hash").alias(same), F.col("k.n").alias(n)), "near-kept")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.withColumns({key: docs[id_column].cast("long"), same: F.xxhash64(docs[text_column])})
    found = named.join(kept.where(F.col(n) == 1), [key, same], "left_semi").select(*columns).unionByName(docs.where(F.col(id_column).isNull()))
    repeats = kept.where(F.col(n) > 1)
    if repeats.isEmpty():
        return found
    whole = F.struct(*columns)
    one = named.join(repeats, [key, same], "left_semi").groupBy(key, same).agg(F.max_by(whole, F.to_json(whole)).alias(n))
    return found.unionByName(one.select(f"{n}.*"))
