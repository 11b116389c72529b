"""The numpy and text kernels against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netdrift.llm import bpe, langid, license_scan, media, near_dedup, packing, sharding, topk, toxicity


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


words = st.lists(st.integers(0, 3), max_size=14)


@settings(max_examples=500, deadline=None)
@given(words, words, st.integers(0, 9))
def test_banded_distance(a, b, most):
    true = levenshtein(a, b)
    assert near_dedup.banded_distance(a, b, most) == (true if true <= most else most + 1)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_similar(a, b):
    longer = max(len(a), len(b))
    expected = longer == 0 or levenshtein(a, b) <= 0.2 * longer + 1e-9
    assert near_dedup.similar(np.array(a, np.uint32), np.array(b, np.uint32)) == expected


def test_order_minhash_tells_order():
    table = {}
    text = [f"w{i}" for i in range(200)]
    same = near_dedup.order_minhash(near_dedup.word_hashes(text, table))
    edited = text.copy()
    edited[50] = edited[150] = "other"
    swapped = text[100:] + text[:100]
    near = near_dedup.order_minhash(near_dedup.word_hashes(edited, table))
    moved = near_dedup.order_minhash(near_dedup.word_hashes(swapped, table))
    assert (same == near).mean() > 0.6
    assert (same == moved).mean() < (same == near).mean()
    assert len(near_dedup.order_minhash(near_dedup.word_hashes([], table))) == 0
    assert len(near_dedup.order_minhash(near_dedup.word_hashes(["one"], table))) == near_dedup.SKETCHES


def maximal_brute(scores):
    """Recursively the best segment, the least and shortest of equals, then its two sides."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 0 and (best is None or s > best[2] or (s == best[2] and j - i < best[1] - best[0])):
                best = (i, j, s)
    if best is None:
        return []
    i, j, _ = best
    return maximal_brute(scores[:i]) + [best] + [(a + j, b + j, s) for a, b, s in maximal_brute(scores[j:])]


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 64 for _ in range(rng.randint(0, 12))]
        found = toxicity.maximal_segments(np.array(scores))
        expected = maximal_brute(scores)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in expected]
        assert np.allclose([s for *_, s in found], [s for *_, s in expected])


def test_lpt():
    placed = sharding.lpt([(9, "a"), (5, "b"), (5, "c"), (4, "d"), (3, "e")], 2)
    loads = [0, 0]
    for size, key in [(9, "a"), (5, "b"), (5, "c"), (4, "d"), (3, "e")]:
        loads[placed[key]] += size
    assert sorted(loads) == [13, 13] and sharding.lpt([], 3) == {}


def test_packing_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 10_000):
        pieces = packing.piece_lengths(n)
        assert sum(pieces) == n and all(p & (p - 1) == 0 and p <= 2048 for p in pieces) and pieces == sorted(pieces, reverse=True)


TEXTS = ["", " ", "  a  b", "Hello world", "it's we'll\n\nnew  line \n x", "é漢字😀 mixed 123abc!!", "tab\there\x85nbsp\xa0thin x", "<|endoftext|> is text", "x" * 3000, "A.\nB, c; d!? (e)", "\x1c\x1d a"]


def test_bpe_equals_tiktoken_and_round_trips():
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(bpe.default_json())
    rng = random.Random(1)
    alphabet = ["a", "Bc", "é", "漢", "😀", " ", "  ", "\n", "\t", "'s", "'ll", "1", "!!", ",", ".", "\xa0", "_"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == other.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
        starts, ends, split = codec.offsets(ids)
        for i, a, b, inside in zip(ids, starts, ends, split, strict=True):
            if not inside:
                assert codec.table[i].decode("utf-8", "ignore") in text[a:b]
    assert sorted(bpe.byte_characters().values()) == list(range(256))


@pytest.mark.parametrize("order", [1, -1])
def test_bpe_texts_with_nuls_next_to_marks(order):
    plain = bpe.Codec(bpe.default_json())
    texts = ["one word. and more, here!", "a \0. b \0, c \0! d\0. \0", "another word. other, there!"][::order]
    for parts in ([texts], [[t] for t in texts]):
        codec = bpe.Codec(bpe.default_json())
        found = [ids.tolist() for part in parts for ids in codec.encode(part)]
        assert found == [plain.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_media_round_trips(monkeypatch):
    rng = np.random.default_rng(0)
    for height, width in ((1, 1), (3, 5), (8, 9), (17, 4)):
        image = rng.integers(0, 256, (height, width, 3), dtype=np.uint8)
        assert (media.read_netpbm(media.write_netpbm(image)) == image).all()
        assert (media.read_bmp(media.write_bmp(image)) == image).all()
        assert (media.read_image(media.write_netpbm(image[:, :, :1])) == image[:, :, :1]).all()
        fine = image.astype(float).repeat(6, axis=0).repeat(6, axis=1)  # brute force: means of whole cells
        expected = fine.reshape(2, 3 * height, 3, 2 * width, 3).mean(axis=(1, 3))
        for band in (1 << 18, 3 * width, 7 * width):  # whole, and bands of one and two rows
            monkeypatch.setattr(media, "BAND", band)
            assert np.allclose(media.area_resize(image, 2, 3), expected)
    assert (media.read_netpbm(b"P2\n# note\n2 1\n255\n7 9\n")[:, :, 0] == [[7, 9]]).all()
    assert (media.read_netpbm(b"P2 3 1 15 0 7 15")[:, :, 0] == [[0, 119, 255]]).all() and (media.read_netpbm(b"P5 2 1 1\n\0\1")[:, :, 0] == [[0, 255]]).all()
    for bad in (b"P2 1 1 15 16", b"P5 1 1 3\n\4", b"P2 2 1 255 7"):
        with pytest.raises(ValueError):
            media.read_netpbm(bad)
    payload, n = media.text_payload("")
    assert (payload, n) == (b" " * 192, 0) and len(media.text_payload("a" * 192)[0]) == 192 and len(media.text_payload("a" * 193)[0]) == 384
    with pytest.raises(ValueError):
        media.read_image(b"GIF89a")


def test_license_scan():
    scanner = license_scan.Scanner()
    plain = b" ".join(scanner.words("The GNU General-Public\nLicense; xmit license; MIT  License, CC BY"))
    assert sorted(scanner.base_places(plain)) == [("cc-by", 9), ("gpl", 1), ("mit", 7)]
    typo = b" ".join(scanner.words("relased under the mlt license and the Mozila Public License"))
    assert {x[0] for x in scanner.fuzzy_spans(typo)} == {"mit", "mpl"}
    assert scanner.fuzzy_spans(b"released under no terms at all") == []
    assert scanner.words("KK İx") == ["kK".encode(), "İx".encode()]


def test_fuzzy_search_equals_scan_of_all_places():
    import regex

    scanner = license_scan.Scanner()
    rng = random.Random(2)
    for label, notice, edits in license_scan.NOTICES:
        for _ in range(20):
            text = list(notice)
            for _ in range(rng.randint(0, edits + 2)):
                text[rng.randrange(len(text))] = rng.choice("abcxyz ")
            plain = ("some words " + " ".join("".join(text).split()) + " more words").encode()
            expected = regex.search(rb"(?b)(?:" + regex.escape(notice).encode() + rb"){e<=%d}" % edits, plain) is not None
            assert (label in {x[0] for x in scanner.fuzzy_spans(plain) if x[4] == len(notice)}) == expected


def test_gru_gradients():
    rng = np.random.default_rng(3)
    net = langid.Network.new(["a", "b", "c"], hidden=4)
    net.weights = {k: w.astype(np.float64) for k, w in net.weights.items()}
    x = rng.integers(97, 100, (6, 5)).astype(np.uint8)
    filled = np.array([6, 3, 6, 1, 5])
    target, weight = rng.dirichlet(np.ones(3), 5), rng.random(5) + 0.5
    grads, _ = net.step(x, filled, target, weight)
    assert set(grads) == set(net.weights)
    for name, g in grads.items():
        for at in np.argsort(-np.abs(g).ravel())[:5]:
            at = np.unravel_index(at, g.shape)
            kept, eps = net.weights[name][at], 1e-5
            net.weights[name][at] = kept + eps
            high = net.step(x, filled, target, weight)[1]
            net.weights[name][at] = kept - eps
            low = net.step(x, filled, target, weight)[1]
            net.weights[name][at] = kept
            assert abs((high - low) / (2 * eps) - g[at]) < 1e-5 * max(1, abs(g[at]))


def plain_gru(net, raw):
    """Log-probabilities of every byte of a window, one scalar step after another."""
    w = net.weights
    h = w["u"].shape[-1]
    states = np.zeros((2, len(raw), h))
    for way in range(2):
        s = np.zeros(h)
        for t in range(len(raw)) if way == 0 else reversed(range(len(raw))):
            z, r = (np.clip(0.2 * (w["x"][way, i, raw[t]] + s @ w["u"][way, i]) + 0.5, 0, 1) for i in (0, 1))
            n = w["x"][way, 2, raw[t]] + r * (s @ w["u"][way, 2])
            n = n / (1 + np.abs(n))
            s = (1 - z) * n + z * s
            states[way, t] = s
    scores = states[0] @ w["v"][0] + states[1] @ w["v"][1] + w["c"]
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def test_language_of_whole_texts_equals_a_plain_loop():
    net = langid.Network.new(["aa", "bb", "cc"])
    texts = ["Short one.", "", "12 34", "é漢字 " * 50, "a long Text, over many windows; 1234 " * 200, "x" * 64, "y" * 65]
    langs, scores = net.predict(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        raw = text.lower().encode()
        votes, labels = np.zeros(3), []
        for at in range(0, len(raw), langid.WINDOW):
            part = raw[at : at + langid.WINDOW]
            log_p = plain_gru(net, np.frombuffer(part.ljust(langid.WINDOW, b"\0"), np.uint8))[: len(part)]
            votes += log_p.sum(axis=0)
            labels += log_p.argmax(axis=1).tolist()
        assert net.position_labels(text).tolist() == labels and len(labels) == len(raw)
        p = np.exp((votes - votes.max()) * langid.SHARP / langid.WINDOW)
        p /= p.sum()
        assert (lang, score) == ("und", 0.0) if not any(map(str.isalpha, text)) else lang == net.langs[p.argmax()] and abs(score - p.max()) < 1e-3


def test_top_k_bounds_hold():
    rng = np.random.default_rng(5)
    for dim in (1, 2, 7, 64):
        x, y = rng.integers(-90, 90, (20, dim)).astype(float), rng.integers(-90, 90, (30, dim)).astype(float)
        exact = x @ y.T
        bounds = [topk._segments(x, g) @ topk._segments(y, g).T for g in topk.levels(dim)]
        for b in bounds:
            assert (b >= exact - 1e-6).all()
        assert all((a.mean() >= b.mean() - 1e-6) for a, b in zip(bounds, bounds[1:], strict=False))
