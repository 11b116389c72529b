"""Toxic passages by maximum-scoring segments over token log-odds, with extreme-value calibration.

Fit, on labelled rows (at most about ``SAMPLE_ROWS``, chosen by a hash of the id), dealt to ``FOLDS`` folds by a
hash of their text, so that copies share one:

1. Units are lower-cased words and their beginnings of 4 to 8 characters (told with ``*``). Spark counts in how
   many toxic and clean documents of each fold each occurs. Units whose log-odds, with a Dirichlet prior from both
   classes together, differ from 0 by ``Z`` standard errors are kept. Their scores are log-odds with hierarchical
   Dirichlet priors: a unit's prior is its longest kept beginning, and that of the shortest is the share of toxic
   documents. There is one table of scores from all folds, and one for each fold from the others.
2. A word scores by its own unit, else its longest kept beginning, else ``NEUTRAL`` (a small loss, so that the
   expected score is negative). Counts are of documents, so a word right after itself scores NEUTRAL.
3. Extreme values, on each fold by the table that has not seen it: segments of score x and more occur by chance
   K n exp(-lambda x) times in n clean words. Among clean documents the scores over ``LEAST`` give lambda (one over
   their mean excess) and, with the number of words, K; documents without any such segment count by their words
   alone. ``PRIOR_EXCESS`` is the mean excess of one segment taken as seen besides.
4. A logistic function of the evidence, below, fitted on the same unseen scores, gives a probability.

Score: one linear scan over a text's scores gives all maximal segments (Ruzzo and Tompa's). A segment of score s
in n words has the normalized score s' = lambda s - ln(K n): exp(-s') like it are expected by chance. It is a
passage where that is at most ``EXPECTED``. A document's evidence is -ln of the chance of its r best segments, for
the best r: 1 - exp(-exp(-s')) for r = 1, else Karlin and Altschul's sum statistic exp(-T) T^(r-1) / (r! (r-1)!)
with T the sum of the s', times 2^(r-1) for the choice of r. Without a segment it is 0, whatever the length.

Defined cases: null labels are no training rows; labels that repeat an id count as toxic if one of them is; with
no labels of both kinds no unit is kept and all scores are 0; a null or empty text has no segment and gets the
score of none; repeated rows give repeated rows; other columns are kept or ignored as told at each function.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import hinted
from .common import arrow_batches, fresh, id_remainder, slices, trimmed, written

SAMPLE_ROWS = 16_000
FOLDS = 4
MIN_DOCS = 4
Z = 3.0
NEUTRAL = -0.1
LEAST = 2.0
PRIOR_EXCESS = 2.0
EXPECTED = 0.05
STEMS = (8, 7, 6, 5, 4)
PRIOR_DOCS = 4.0
CACHE_WORDS = 200_000
THRESHOLD = 0.7
WORD = re.compile(r"\w+")


def units(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments (start, stop, score) of positive score, in order; linear in the scores.

    Only positive scores begin or end a segment, so the scan steps over them alone, with running sums.
    """
    total = np.cumsum(scores)
    found: list[list] = []  # start, stop, sum before, sum through
    for i in np.flatnonzero(scores > 0).tolist():
        low, high, start = float(total[i] - scores[i]), float(total[i]), i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([start, i + 1, low, high, j])
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0  # lambda
    log_k: float = 0.0
    logistic: tuple[float, float] | None = None

    def words(self) -> dict[str, float]:
        """A dictionary that scores words as they are met."""
        weights = self.weights

        class Scores(dict):
            def __missing__(self, word: str) -> float:
                score = weights.get(word)
                for n in STEMS if score is None else ():
                    score = weights.get(word[:n] + "*") if len(word) > n else None
                    if score is not None:
                        break
                self[word] = score = NEUTRAL if score is None else score
                return score

        return Scores()

    def normalized(self, scores: list[float], n: int) -> list[float]:
        base = self.log_k + math.log(max(n, 1))
        return [self.scale * s - base for s in scores]

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        best, total, logs = 0.0, 0.0, 0.0
        for r, s in enumerate(sorted(self.normalized([s for *_, s in segments], n), reverse=True), 1):
            total += s
            if r == 1:
                best = s if s > 30 else -math.log(-math.expm1(-math.exp(-max(s, -6.0))))
                continue
            logs += math.log(r) + math.log(r - 1)
            if s <= 0:
                break
            best = max(best, total - (r - 1) * math.log(2 * max(total, 1.0)) + logs)
        return min(best, 60.0)

    def probability(self, segments: list[tuple[int, int, float]], n: int) -> float:
        if self.logistic is None:
            return 0.0
        a, b = self.logistic
        return 1 / (1 + math.exp(-min(max(a + b * self.evidence(segments, n), -30.0), 30.0)))


def word_scores(table: dict[str, float], words: list[str]) -> np.ndarray:
    scores = np.fromiter(map(table.__getitem__, words), float, len(words))
    for i in np.flatnonzero(scores > 0).tolist():
        if i and words[i] == words[i - 1]:
            scores[i] = NEUTRAL
    return scores


def hierarchical(counts: dict[str, tuple[int, int]], rate: float) -> dict[str, float]:
    """Log-odds of units against ``rate``, the share of toxic documents; a unit's prior is its longest beginning."""
    shares: dict[str, float] = {}
    for unit in sorted(counts, key=lambda u: (len(u.rstrip("*")), u[-1] != "*")):
        core = unit.rstrip("*")
        prior = next((shares[core[:n] + "*"] for n in STEMS if (n < len(core) or n == len(core) and unit != core + "*") and core[:n] + "*" in shares), rate)
        t, c = counts[unit]
        shares[unit] = (t + PRIOR_DOCS * prior) / (t + c + PRIOR_DOCS)
    return {u: float(np.clip(math.log(p / (1 - p)) - math.log(rate / (1 - rate)), -1.0, 10.0)) for u, p in shares.items()}


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = iter(zip(batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), strict=True))
        for texts in slices(batch.column("text")):
            counts: dict[tuple[int, int], Counter] = {}
            for text in texts:
                counts.setdefault(next(kinds), Counter()).update(units(text))
            for (toxic, fold), found in counts.items():
                same = [np.full(len(found), x, np.int64) for x in (toxic, fold)]
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *map(pa.array, same), pa.array(list(found.values()), pa.int64())], ["unit", "toxic", "fold", "n"])


def _sample(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """text, toxic, fold of about SAMPLE_ROWS labelled rows at most; their ids are few enough to broadcast."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    share = min(1.0, SAMPLE_ROWS / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))
    fold = F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(FOLDS))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", fold.alias("fold"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _told_apart(t: Column, c: Column, n1: int, n0: int) -> Column:
    """Whether a unit in ``t`` toxic and ``c`` clean documents tells the classes apart."""
    prior = 0.5 + 0.01 * (t + c)
    delta = F.log((t + prior) / (n1 - t + prior)) - F.log((c + prior) / (n0 - c + prior))
    return (t + c >= MIN_DOCS) & (F.abs(delta) / F.sqrt(1 / (t + prior) + 1 / (c + prior)) >= Z)


def _tables(counts: DataFrame, rate: float) -> list[dict[str, float]]:
    """Scores of units, from all folds but one each, and last from all. ``counts`` has t0, c0, ... for each unit."""
    every = range(FOLDS)
    held = [[f for f in every if f != out] for out in (*every, None)]
    sums = counts.agg(*[F.sum(f"{k}{f}").alias(f"{k}{f}") for k in "tc" for f in every]).first()
    columns, totals = [], []
    for i, folds in enumerate(held):
        t, c = (sum(F.col(f"{k}{f}") for f in folds) for k in "tc")
        totals.append([sum(sums[f"{k}{f}"] or 0 for f in folds) for k in "tc"])
        columns += [t.alias(f"a{i}"), c.alias(f"b{i}"), _told_apart(t, c, *totals[-1]).alias(f"kept{i}")]
    # each unit kept stands in MIN_DOCS sampled rows at least
    kept = counts.select("unit", *columns).where(" OR ".join(f"kept{i}" for i in range(len(held)))).collect()
    out = []
    for i, (n1, n0) in enumerate(totals):
        found = {r["unit"]: (r[f"a{i}"], r[f"b{i}"]) for r in kept if r[f"kept{i}"]} if n1 and n0 else {}
        out.append({u: s if s >= LEAST else min(s, NEUTRAL) for u, s in hierarchical(found, rate).items()})  # weak evidence is none
    return out


def _segments(tables: list[dict[str, float]]):
    """text, toxic, fold -> toxic, n, segments, each by the table that has not seen the row's fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [Model(t).words() for t in tables]
        for batch in batches:
            kinds = iter(zip(batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), strict=True))
            for texts in slices(batch.column("text")):
                rows = []
                for text in texts:
                    toxic, fold = next(kinds)
                    scores = word_scores(words[fold], WORD.findall(text.lower()))
                    rows.append((toxic, len(scores), [s for *_, s in maximal_segments(scores)]))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["toxic", "n", "segments"])

    return run


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [model.evidence([(0, 0, s) for s in x], n) for x, n in zip(batch.column("segments").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(told, pa.float64())], ["toxic", "evidence"])

    return run


def calibrated(seen: DataFrame) -> tuple[float, float]:
    """lambda and ln K from the segments over LEAST of clean rows (toxic, n, segments)."""
    over = F.filter("segments", lambda x: x >= LEAST)
    excess = F.aggregate(over, F.lit(0.0), lambda a, x: a + x - LEAST)
    words, many, total = seen.where("toxic = 0").agg(F.sum(F.greatest("n", F.lit(1))), F.sum(F.size(over)), F.sum(excess)).first()
    scale = ((many or 0) + 1) / ((total or 0.0) + PRIOR_EXCESS)
    return scale, math.log(((many or 0) + 1) / max(words or 1, 1)) + scale * LEAST


def unseen(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> tuple[dict[str, float], DataFrame | None]:
    """The table of scores from all folds, and toxic, n, segments of the sampled rows by the tables of the other folds."""
    arrow_batches(docs.sparkSession)
    sample = written(_sample(docs, labels, F.lit(True) if learn is None else learn), "toxic-sample")
    counts = sample.mapInArrow(trimmed(_count_units), "unit string, toxic bigint, fold bigint, n bigint").groupBy("unit")
    counts = counts.agg(*[F.sum(F.when((F.col("toxic") == k) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"{'ct'[k]}{f}") for k in (0, 1) for f in range(FOLDS)])
    counts = written(counts, "toxic-units")
    rate = sample.agg(F.avg("toxic")).first()[0]
    if not rate or rate == 1:
        return {}, None
    *tables, whole = _tables(counts, rate)
    return whole, written(sample.mapInArrow(trimmed(_segments(tables)), "toxic bigint, n bigint, segments array<double>"), "toxic-segments")


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Model:
    """A model from labelled rows of ``docs``; ``learn`` says which label rows may be learned from (all by default)."""
    weights, seen = unseen(docs, labels, learn)
    if not weights:
        return Model()
    model = Model(weights, *calibrated(seen))
    rows = seen.mapInArrow(trimmed(_evidence(model)), "toxic bigint, evidence double").collect()  # two numbers a sampled row
    x = np.array([[1.0, r["evidence"]] for r in rows])
    model.logistic = tuple(_logistic(x, np.array([r["toxic"] for r in rows], float)).tolist())
    return model


PASSAGE = "struct<start:int,stop:int,score:double,expected:double>"


def score_column(model: Model, text: Column) -> Column:
    """struct(score, passages): passages are the significant segments as character spans of the lower-cased text."""
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])
    kind = pa.struct([("score", pa.float64()), ("passages", pa.list_(span))])

    def run(batches):
        table = model.words()
        for batch in batches:
            out = []
            for texts in slices(batch):
                if len(table) > CACHE_WORDS:
                    table.clear()
                for text in texts:
                    text = text.lower()
                    words = WORD.findall(text)
                    scores = word_scores(table, words)
                    segments, passages = maximal_segments(scores) if len(scores) and scores.max() > 0 else [], []
                    chance = [math.exp(-x) for x in model.normalized([s for *_, s in segments], len(words))]
                    if any(x <= EXPECTED for x in chance):
                        spans = [m.span() for m in WORD.finditer(text)]
                        passages = [{"start": spans[a][0], "stop": spans[b - 1][1], "score": s, "expected": x} for (a, b, s), x in zip(segments, chance, strict=True) if x <= EXPECTED]
                    out.append({"score": model.probability(segments, len(words)), "passages": passages})
            yield pa.array(out, kind)

    return F.arrow_udf(hinted(trimmed(run)), f"score double, passages array<{PASSAGE}>")(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages; learned from ids with crc32 mod 3 other than 1."""
    model = fit(docs, labels, id_remainder("doc_id", 3) != 1)
    scored = docs.select("doc_id", score_column(model, F.col("text")).alias("_t"))
    return scored.select(
        "doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), F.col("_t.score").alias("score"),
        (F.col("_t.score") >= THRESHOLD).cast("int").alias("predicted"), F.size("_t.passages").alias("n_passages"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that are predicted to be toxic."""
    model = fit(docs, labels, id_remainder("doc_id", 3) != 1)
    (told,) = fresh(docs, "_toxic")
    return docs.withColumn(told, score_column(model, F.col("text"))).where(F.col(told)["score"] < THRESHOLD).drop(told)
