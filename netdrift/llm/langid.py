"""Language identification by a bidirectional gated recurrent network over bytes.

Text is lower-cased and read as UTF-8 in windows of ``WINDOW`` bytes, one after another through the whole text. The
network reads a window in both directions and gives every byte position, whatever stands there, probabilities of
the learned languages; its states start anew with each window. A document's probabilities pool all its positions:
the mean log-probability of a window's positions, times ``SHARP``, is its vote, and votes add up over the windows,
weighted by their positions; a softmax follows.

A cell is a gated recurrent unit with hard sigmoids (slope 0.2) for its gates and x / (1 + |x|) for its candidate.

Fit, by backpropagation through time in numpy on the driver, on a bounded sample: about ``SAMPLE_ROWS`` labelled
documents at most, chosen by a hash of the id, the same number for each language; and of their windows about
``SAMPLE_WINDOWS`` at most, chosen by a hash, again the same number for each language. All of these are learned
from, each language weighing the same.

Defined cases: documents with a null language are no training rows; a null text and a text without letters get
``und`` and score 0; with nothing to learn from all get ``und``; with one language that is the answer for all with
letters; repeated rows give repeated rows; texts of any length are read whole, a few windows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import hinted
from .common import arrow_batches, fresh, id_remainder, slices, trimmed, written

SAMPLE_ROWS = 4096
SAMPLE_WINDOWS = 8192
WINDOW = 64
HIDDEN = 16
#: How far positions of a window count as evidence of their own.
SHARP = 8.0
UNKNOWN = "und"
#: Windows that pass through the network at once.
CHUNK = 1024


def windows(raws: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of texts (positions, windows), padded with zeros; the bytes in each; and each text's number of windows."""
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    counts = -(-sizes // width)
    flat = np.zeros(int(counts.sum()) * width, np.uint8)
    filled = np.full(int(counts.sum()), width, np.int64)
    for raw, n, size, at in zip(raws, counts.tolist(), sizes.tolist(), (np.cumsum(counts) - counts).tolist(), strict=True):
        flat[at * width : at * width + size] = np.frombuffer(raw, np.uint8)
        if n:
            filled[at + n - 1] = size - (n - 1) * width
    return flat.reshape(-1, width).T, filled, counts


def as_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


@dataclass
class Network:
    """Weights of both directions (forth, back) and of the output layer.

    x: (direction, part, byte, H) and u: (direction, part, H, H) for the parts update, reset, candidate;
    v: (direction, H, language) and c: (language).
    """

    langs: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)

        def draw(scale: float, *shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        return cls(langs, {"x": draw(0.5, 2, 3, 256, hidden), "u": draw(hidden**-0.5, 2, 3, hidden, hidden), "v": draw((2 * hidden) ** -0.5, 2, hidden, len(langs)), "c": np.zeros(len(langs), np.float32)})

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(positions, direction, windows, H) for bytes ``x`` (positions, windows); all blocks in memory are whole."""
        wx, u = self.weights["x"], self.weights["u"]
        x, size, h = x.astype(np.intp), x.shape[1], u.shape[-1]
        state = np.zeros((2, 1, size, h), wx.dtype)
        g, a = np.empty((2, 3, size, h), wx.dtype), np.empty((2, 3, size, h), wx.dtype)
        out = np.empty((len(x), 2, size, h), wx.dtype)
        for t in range(len(x)):
            for way, row in enumerate((x[t], x[-1 - t])):
                for part in range(3):
                    np.take(wx[way, part], row, axis=0, out=g[way, part], mode="clip")
            np.matmul(state, u, out=a)
            before = state if keep is None else state.copy()
            for way in range(2):
                gates, n, now = g[way, :2], g[way, 2], state[way, 0]
                gates += a[way, :2]
                gates *= 0.2
                gates += 0.5
                np.clip(gates, 0, 1, out=gates)
                n += gates[1] * a[way, 2]
                n /= 1 + np.abs(n)
                now -= n
                now *= gates[0]
                now += n
                out[-1 - t if way else t, way] = now
            if keep is not None:
                keep.append((before, g.copy(), a[:, 2].copy()))
        return out

    def log_probabilities(self, states: np.ndarray) -> np.ndarray:
        """(languages, positions, windows)."""
        v = self.weights["v"]
        scores = states[:, 0] @ v[0]
        scores += states[:, 1] @ v[1]
        scores += self.weights["c"]
        scores = np.ascontiguousarray(np.moveaxis(scores, 2, 0))
        scores -= scores.max(axis=0)
        scores -= np.log(np.exp(scores).sum(axis=0))
        return scores

    def step(self, x: np.ndarray, filled: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the weighted mean cross-entropy at all positions that are filled, and the loss; ``target`` is (windows, languages)."""
        kept: list = []
        both = self.states(x, kept)
        log_p = np.moveaxis(self.log_probabilities(both), 0, 2)
        share = (np.arange(len(x))[:, None] < filled) * weight
        share = (share / share.sum())[:, :, None].astype(both.dtype)
        d = share * (np.exp(log_p) - target)
        grads = {"v": np.einsum("pdwh,pwl->dhl", both, d, optimize=True), "c": d.sum(axis=(0, 1))}
        u, v = self.weights["u"], self.weights["v"]
        h = u.shape[-1]
        grads["u"] = np.zeros_like(u)
        d_parts = np.empty((2, len(x), 3, x.shape[1], h), u.dtype)  # by position
        d_state = np.zeros((2, x.shape[1], h), u.dtype)
        for t in range(len(x) - 1, -1, -1):
            before, parts, a_n = kept[t]
            z, r, n = parts[:, 0], parts[:, 1], parts[:, 2]
            d_state = d_state + np.stack([d[t] @ v[0].T, d[-1 - t] @ v[1].T])
            d_n = d_state * (1 - z) * (1 - np.abs(n)) ** 2
            d_z = 0.2 * d_state * (before[:, 0] - n) * ((z > 0) & (z < 1))
            d_r = 0.2 * d_n * a_n * ((r > 0) & (r < 1))
            for way, at in enumerate((t, len(x) - 1 - t)):
                d_parts[way, at] = d_z[way], d_r[way], d_n[way]
            d_a = np.stack([d_z, d_r, d_n * r], axis=1)
            grads["u"] += np.swapaxes(before, 2, 3) @ d_a
            d_state = d_state * z + (d_a @ np.swapaxes(u, 2, 3)).sum(axis=1)
        flat = x.ravel()
        order = np.argsort(flat, kind="stable")
        values, begin = np.unique(flat[order], return_index=True)
        grads["x"] = np.zeros_like(self.weights["x"])
        for way in range(2):
            for part in range(3):
                grads["x"][way, part, values] = np.add.reduceat(d_parts[way, :, part].reshape(-1, h)[order], begin)
        return grads, -float((share * target * log_p).sum())

    def votes(self, x: np.ndarray, filled: np.ndarray) -> np.ndarray:
        """(windows, languages): sums of log-probabilities over each window's positions."""
        out = np.zeros((x.shape[1], len(self.langs)))
        for at in range(0, x.shape[1], CHUNK):
            log_p = self.log_probabilities(self.states(x[:, at : at + CHUNK]))
            short = filled[at : at + CHUNK] < len(x)
            log_p[:, :, short] *= np.arange(len(x))[:, None] < filled[at : at + CHUNK][short]
            out[at : at + CHUNK] = log_p.sum(axis=1).T
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text."""
        x, filled, counts = windows([as_bytes(t) for t in texts])
        total = np.zeros((len(texts), len(self.langs)))
        has = np.flatnonzero(counts)
        if len(has):
            total[has] = np.add.reduceat(self.votes(x, filled), (np.cumsum(counts) - counts)[has], axis=0)
        total *= SHARP / WINDOW
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        letters = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, p.max(axis=1), 0.0)

    def position_labels(self, text: str) -> np.ndarray:
        """The label of every byte of the lower-cased text, as an index into ``langs``."""
        x, filled, _ = windows([as_bytes(text)])
        labels = [self.log_probabilities(self.states(x[:, at : at + CHUNK])).argmax(axis=0).T.ravel() for at in range(0, x.shape[1], CHUNK)]
        return np.concatenate(labels)[: filled.sum()] if labels else np.zeros(0, np.int64)


def train(langs: list[str], x: np.ndarray, filled: np.ndarray, lang: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam over batches of windows, in an order drawn from ``seed``; ``lang`` is the index of each window's language."""
    net, rng = Network.new(langs, seed=seed), np.random.default_rng(seed)
    target = np.eye(len(langs), dtype=np.float32)[lang]
    sizes = np.bincount(lang, weights=filled, minlength=len(langs))
    weight = (1 / np.maximum(sizes, 1))[lang]
    first = {k: np.zeros_like(w) for k, w in net.weights.items()}
    second = {k: np.zeros_like(w) for k, w in net.weights.items()}
    parts, step = max(1, len(lang) // batch), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(lang)), parts):
            grads, _ = net.step(x[:, part], filled[part], target[part], weight[part])
            step += 1
            now = rate * (1 - (step - 1) / (epochs * parts)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net.weights[k] -= (now * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return net


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, window, order (a hash of the window's bytes and place) of all windows."""
    import xxhash

    for batch in batches:
        langs = iter(batch.column("lang").to_pylist())
        for texts in slices(batch.column("text")):
            rows = []
            for text in texts:
                lang, raw = next(langs), as_bytes(text)
                rows += [(lang, raw[at : at + WINDOW], xxhash.xxh64_intdigest(raw[at : at + WINDOW], seed=at) >> 1) for at in range(0, len(raw), WINDOW)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], ["lang", "window", "order"])


def _even_shares(rows: DataFrame, order: Column, most: int) -> tuple[list[str], DataFrame]:
    """The values of ``lang``, and the rows with about most / (their number) of each at most, by a hash below a bound."""
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return [], rows
    each = most / len(sizes)
    bound = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, each / n) * (1 << 20)))])
    return sorted(sizes), rows.where(F.pmod(order, F.lit(1 << 20)) < bound[F.col("lang")])


def fit(docs: DataFrame, learn: Column | None = None) -> Network | None:
    """A network from labelled documents that ``learn`` lets in (all by default); None if there are none."""
    arrow_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known if learn is None else known.where(learn)
    _, sample = _even_shares(known, F.xxhash64("doc_id", F.lit("sample")), SAMPLE_ROWS)
    cut = written(sample.select("lang", "text").mapInArrow(trimmed(_cut), "lang string, window binary, order bigint"), "lang-windows")
    langs, chosen = _even_shares(cut, F.col("order"), SAMPLE_WINDOWS)
    if not langs:
        return None
    rows = sorted((r["lang"], bytes(r["window"])) for r in chosen.select("lang", "window").collect())
    x, filled, _ = windows([w for _, w in rows])
    place = {lang: i for i, lang in enumerate(langs)}
    return train(langs, x, filled, np.array([place[lang] for lang, _ in rows]))


def predict_column(net: Network | None, text: Column) -> Column:
    """struct(lang, score) of a text."""
    if net is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))

    def run(batches):
        for batch in batches:
            langs, scores = [], []
            for texts in slices(batch):
                a, b = net.predict(texts)
                langs += a
                scores += b.tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return F.arrow_udf(hinted(trimmed(run)), "lang string, score double")(text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from ids with crc32 mod 4 other than 2."""
    net = fit(docs, id_remainder("doc_id", 4) != 2)
    found = docs.select("doc_id", predict_column(net, F.col("text")).alias("_l"))
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), F.col("_l.lang").alias("lang_pred"), F.col("_l.score").alias("score"))


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs``, all columns, without texts that have no letters or whose language scores below ``least``."""
    net = fit(docs, id_remainder("doc_id", 4) != 2)
    (told,) = fresh(docs, "_lang")
    found = docs.withColumn(told, predict_column(net, F.col("text")))
    return found.where((F.col(told)["lang"] != UNKNOWN) & (F.col(told)["score"] >= least)).drop(told)
