"""The operators and the pipeline on awkward rows and on the given small tables, against brute force."""

import hashlib
import io
import json
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from netdrift.llm import bpe, common, langid, license_scan, line_dedup, media, near_dedup, packing, queries, sharding, topk, toxicity

SF = "/root/testdata/sf0.001"
LINE = "this line stands in many documents"
BODY = " ".join(f"word{i} and{i % 7}" for i in range(60))
NEAR = BODY.replace("word30", "changed").replace("word44", "other")
ROWS = [
    (1, f"{LINE}\nfirst text here"), (2, f"  {LINE.upper()}\t\nsecond"), (3, f"{LINE}\n{LINE}"), (4, None), (5, ""), (6, "\n\n"),
    (7, BODY), (8, NEAR), (9, BODY), (9, BODY), (None, "a row without an id"), (10, "x" * 200_000), (11, "y " * 60_000), (12, "12 34 !!"), (13, "Released under the MIT License."),
]
#: Every name that the code gives a column, and the private ones with one underscore more.
CODE = "".join(Path(m.__file__).read_text() for m in (bpe, common, langid, license_scan, line_dedup, media, near_dedup, packing, sharding, topk, toxicity))
GIVEN = {x for call in re.findall(r"(?:alias|withColumns?|withColumnsRenamed|withColumnRenamed|fresh)\(([^()]*)", CODE) for x in re.findall(r"[\"'](\w+)[\"']", call)}
CLASHING = sorted({x.lower() for g in GIVEN for x in (g, "_" + g if g.startswith("_") else g)} - {"doc_id", "text", "lang", "source", "n_chars"})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i is None or i % 2 else None, "s", 0, {"a": i}, *["clash"] * len(CLASHING)) for i, t in ROWS]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, meta map<string,long>, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, kinds).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 0), (3, None, None), (7, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")


def table(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def line_truth(rows, min_chars=20, min_docs=3):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(-(1 << 63) if i is None else i)
    top = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if top.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark, docs):
    found = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in table(line_dedup.line_digests(docs))), key=str)
    assert found == line_truth(ROWS)
    bitmaps = {r["doc_id"]: r for r in table(line_dedup.with_bitmaps(docs, names=("my lines", "my lost", "my bitmap", "my text")).select("doc_id", "my bitmap", "score"))}
    assert line_dedup.unpack(bitmaps[1]["my bitmap"], 2).tolist() == [False, True] and bitmaps[3]["my bitmap"] is None and bitmaps[1]["score"] == "clash"
    with pytest.raises(ValueError, match="has a column"):
        line_dedup.with_bitmaps(docs)
    assert line_dedup.line_digests(docs.limit(0)).count() == 0


def test_line_dedup_hot_keys_over_edges(spark):
    """Keys that span partitions, and long ones held back in pieces, get the same answer."""
    rows = [(i, "\n".join([LINE, f"only in document number {i:05d}", f"shared by two or three {i // 3:05d}"][: 1 + i % 3] * (1 + i % 2))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept, line_dedup.LONG = line_dedup.LONG, 50
    stream = line_dedup._stream
    line_dedup._stream = lambda m: stream(m, 50)
    try:
        found = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in table(line_dedup.line_digests(docs))), key=str)
    finally:
        line_dedup.LONG, line_dedup._stream = kept, stream
    assert found == line_truth(rows)


def test_sharding(spark, docs):
    rows = table(sharding.shard_documents(docs, 4))
    assert len(rows) == len(ROWS)
    by_text, loads, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    truth = defaultdict(list)
    for i, t in ROWS:
        truth[i].append((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    for r in rows:
        assert (r["size"], r["text_crc32"]) in truth[r["doc_id"]]
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(docs.limit(0), 4).count() == 0
    given = table(sharding.shard_documents(spark.read.parquet(f"{SF}/documents.parquet"), 16))
    loads = defaultdict(int)
    for r in given:
        loads[r["shard"]] += r["size"]
    assert len(loads) == 16 and max(loads.values()) - min(loads.values()) <= max(r["size"] for r in given)


def test_packing(spark, docs):
    rows = table(packing.pack(docs, longest=64))
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    codec = bpe.Codec(bpe.default_json())
    for i, t in ROWS:
        if sum(x == i for x, _ in ROWS) > 1:
            continue
        ids = np.r_[codec.encode([t or ""])[0], 1].astype("<u4")
        pieces = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert b"".join(p["ids"] for p in pieces) == ids.tobytes() and all(p["doc_tokens"] == len(ids) for p in pieces)
        assert all(p["length"] & (p["length"] - 1) == 0 and zlib.crc32(p["ids"]) == p["ids_crc32"] and p["offset"] == 0 for p in pieces)
    ordered = sorted(rows, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in ordered] == sorted((r["length"] for r in rows), reverse=True)
    assert packing.pack(docs.limit(0)).count() == 0


def test_bpe(spark, docs):
    rows = table(bpe.token_digests(docs))
    codec = bpe.Codec(bpe.default_json())
    truth = sorted(
        ((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS for ids in [codec.encode([t or ""])[0].tolist()]), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows), key=str) == truth
    both = bpe.decoded(bpe.encoded(docs.where("doc_id = 7"), ids_as="tokens", offsets=True), ids_column="tokens").first()
    assert both["decoded"].decode() == BODY and len(both["tokens"]) == len(both["tokens_starts"]) and both["tokens_ends"][-1] == len(BODY)
    assert bpe.token_digests(docs.limit(0)).count() == 0


def test_media(spark, docs):
    rows = table(media.text_media(docs))
    truth = {}
    for i, t in ROWS:
        raw, n = media.text_payload(t or "")
        truth[i] = (n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
    assert len(rows) == len(ROWS) and all((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == truth[r["doc_id"]] for r in rows)
    assert media.text_media(docs.limit(0)).count() == 0
    images = spark.createDataFrame([(1, bytearray(media.write_bmp(np.full((4, 4, 3), 7, np.uint8)))), (2, bytearray(b"nonsense")), (3, None)], "id int, media binary")
    found = {r["id"]: r["x"] for r in images.select("id", media.decode_column(F.col("media")).alias("x")).collect()}
    assert found[1]["height"] == 4 and found[1]["dhash"] == "0" * 16 and found[2] is None and found[3] is None


def test_license(spark, docs):
    rows = {r["doc_id"]: r for r in table(license_scan.scan_licenses(docs))}
    assert rows[13]["base_labels"] == "mit" and rows[13]["score"] == 1.0 and rows[13]["first_word"] == rows[13]["last_word"] == 3
    assert rows[4]["n_words"] == 0 and rows[4]["labels"] == "" and rows[4]["first_word"] is None
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def plain_license(text):
    """n_words, base places and labels by comparing words one by one, and by the edit distance to all substrings."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    base = sorted((i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split())
    labels, raw = {label for _, label in base}, " ".join(found).encode()
    for label, notice, edits in license_scan.NOTICES:
        row = list(range(len(notice) + 1))
        least = row[-1]
        for c in raw:
            new = [0]
            for j, n in enumerate(notice.encode(), 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != n)))
            row = new
            least = min(least, row[-1])
        if least <= edits:
            labels.add(label)
    at = [i for i, _ in base]
    return len(found), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels))


def test_license_equals_brute_force(spark):
    given = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 250").orderBy("doc_id").limit(25).collect()]
    odd = ["Apache  License,\nCC-BY cc by CC BY", "relased undr the mit licence", "Mozila Publik License x", "MIT License mit license\x00MIT\tLICENSE", "permision is hereby grantd free of charge, to any persn obtaining a copy", "ÄPACHE license", None, "", "cc by " * 30]
    texts = given + odd + odd[:2]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in table(license_scan.scan_licenses(rows))}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        r = found[i]
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")) == plain_license(text), text
        assert (r["score"] == 1.0) == (r["n_base"] > 0) and (r["score"] > 0) == bool(r["labels"])
    assert found[len(given) + 2]["labels"] == "mpl" and [s["edits"] for s in found[len(given) + 2]["spans"]] == [2]


def test_media_features_equal_brute_force(spark):
    """Tiles and hashes by repeating pixels until the target's cells are whole."""
    texts = [t for _, t in ROWS if len(t or "") < 5000] + ["é漢字😀 " * 40, "a" * 192, "b" * 193]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = set()
    for r in table(media.text_media(rows)):
        payload, _ = media.text_payload(texts[r["doc_id"]] or "")
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).astype(float)
        small = image.repeat(8, axis=0).repeat(9, axis=1).reshape(8, len(image), 9, 64, 3).mean(axis=(1, 3))
        grey = np.round(small @ media.GREY, 6)
        bits = "".join("1" if b else "0" for b in (grey[:, 1:] > grey[:, :-1]).ravel())
        tile = np.load(io.BytesIO(r["tile"]))
        assert tile.shape == (8, 9, 3) and tile.dtype == np.uint8 and np.abs(tile - small).max() <= 0.5 + 1e-9
        assert r["feature"] == f"dhash:{int(bits, 2):016x};tile:{hashlib.sha256(r['tile']).hexdigest()[:16]}"
        assert r["format"] == ("bmp" if len(image) % 2 else "ppm") and r["media_bytes"] == len(payload) + (54 if r["format"] == "bmp" else len(f"P6\n64 {len(image)}\n255\n"))
        kinds.add(r["format"])
    assert kinds == {"bmp", "ppm"}


def test_top_k(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).integers(-3, 4, 5)]) for i in range(0, 120)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 5), (None, [1.0] * 5), (203, [1.0, 2.0]), (204, []), (250, [float("inf")] * 5), (300, [0.5, 0.25])]
    vectors = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], "vec_id long, embedding array<float>, v string, dim string")
    kept = [(i, v) for i, v in rows if i is not None and v is not None and len(v) == 5 and all(x is not None and np.isfinite(x) for x in v)]
    ids, x = np.array([i for i, _ in kept]), np.floor(256 * np.array([v for _, v in kept])).astype(np.int64)
    expected = topk.top_k_brute(ids, x, ids % 50 == 0, 5) + [(300, 1, 203, 128 * 256 + 64 * 512)]
    for group in (16, 1):
        kept = topk.QUERY_BLOCK, topk.CANDIDATE_BLOCK, topk.QUERY_GROUP
        topk.QUERY_BLOCK, topk.CANDIDATE_BLOCK, topk.QUERY_GROUP = (1, 7, 1) if group == 1 else kept
        found = table(topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5, counts=True))
        topk.QUERY_BLOCK, topk.CANDIDATE_BLOCK, topk.QUERY_GROUP = kept
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == expected
        assert all(5 <= r["exact"] <= 119 for r in found if r["query_id"] < 200)
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_top_k_counts_rows_that_repeat(spark):
    rng = np.random.default_rng(3)
    ids, x = np.repeat(np.arange(40), 5), np.repeat(rng.integers(-9, 9, (40, 8)), 5, axis=0)
    rows = [(int(i), (v / 256).tolist()) for i, v in zip(ids, x, strict=True)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 10 == 0, 5)
    brute = [topk.top_k_brute(np.r_[i, ids[ids != i]], np.vstack([x[ids == i][:1], x[ids != i]]), np.r_[True, np.zeros(195, bool)], 5) for i in (0, 10, 20, 30)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in table(found)) == sum(brute, [])


def test_near_dedup(spark, docs):
    found = {r["doc_id"]: r["class_id"] for r in table(near_dedup.near_duplicates(docs))}
    assert found[7] == found[8] == found[9] == 7 and found[4] == found[5] == 4 and found[6] == 6 and found[10] == 10 and None not in found
    assert set(found) == {i for i, _ in ROWS if i is not None}
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in table(kept)) == sorted(["None", "1", "10", "11", "12", "13", "2", "3", "4", "6", "7"])
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_dedup_misses_no_link(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], near_dedup.words(r["text"] or "")) for r in docs.collect()]
    found = {r["doc_id"]: r["class_id"] for r in table(near_dedup.near_duplicates(docs))}
    table_, by_gram = {}, defaultdict(set)
    hashed = {i: near_dedup.word_hashes(w, table_).astype(np.uint32) for i, w in rows}
    for i, w in hashed.items():
        for g in set(near_dedup.kmer_hashes(w, 3).tolist()):
            by_gram[g].add(i)
    tried, links, parent = set(), 0, {i: i for i in hashed}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for group in by_gram.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in tried:
                    tried.add((a, b))
                    if near_dedup.similar(hashed[a], hashed[b]):
                        links += 1
                        assert found[a] == found[b]
                        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert links > 50
    assert all(found[i] == root(i) for i in hashed if len(hashed[i]) > 4)


def _classes(spark, rows):
    found = near_dedup.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"))
    return {r["doc_id"]: r["class_id"] for r in table(found)}


def _edited(rng, words, places, n):
    words = list(words)
    for at in rng.choice(places, n, replace=False):
        words[at] = f"e{rng.integers(1 << 40)}"
    return words


def test_near_dedup_pairs_in_hot_buckets(spark):
    """Pairs of near copies among thousands of strangers that share a template."""
    rng = np.random.default_rng(5)
    template = [f"t{i}" for i in range(100)]
    rows = [(i, template + [f"u{x}" for x in rng.integers(1 << 40, size=50)]) for i in range(3000)]
    order = rng.permutation(3000)[:200].tolist()
    rows += [(3000 + i, _edited(rng, rows[i][1], np.arange(100, 150), 15)) for i in order]
    found = _classes(spark, rows)
    assert all(found[3000 + i] == i for i in order) and all(found[i] == i for i in range(3000))


def _passages(rng, n, own, same):
    """``n`` strangers that share a passage, and copies of each tenth with ``same`` of its own words kept, no two side by side."""
    template, fresh = [f"t{i}" for i in range(100 - own)], lambda k: [f"u{x}" for x in rng.integers(1 << 40, size=k)]
    rows = [(i, template + fresh(own)) for i in range(n)]
    for i in range(0, n, 10):
        words = template + fresh(own)
        for at in range(101 - own, 101 - own + 2 * same, 2):
            words[at] = rows[i][1][at]
        rows.append((n + i, words))
    return rows


@pytest.mark.parametrize(("own", "same"), [(21, 2), (38, 18)])
def test_near_dedup_pairs_that_meet_in_hot_buckets_alone(spark, own, same):
    """Texts whose runs of three words in common are those of all: by rare words, and by blocks where these are too few."""
    rows = _passages(np.random.default_rng(own), 200, own, same)
    assert _classes(spark, rows) == {i: i - 200 * (i >= 200) for i, _ in rows}


def test_rare_grams_hold_what_similar_texts_share():
    """Whatever the order of the grams, two similar texts have ``COMMON`` of those that come first in common."""
    rng, tried = np.random.default_rng(8), 0
    for n in [*range(8, 40)] * 12:
        a = rng.integers(0, 12 + n // 2, n).astype(np.uint64)
        b = a.tolist()
        for _ in range(int(rng.integers(1, n // 4 + 2))):
            at = int(rng.integers(len(b)))
            b[at : at + int(rng.integers(2))] = rng.integers(1 << 30, size=int(rng.integers(2))).tolist()
        b = np.array(b, np.uint64)
        if len(b) < near_dedup.LEAST or not near_dedup.similar(a.astype(np.uint32), b.astype(np.uint32)):
            continue
        tried += 1
        for k in near_dedup.GRAMS:
            assert near_dedup.filters(k, near_dedup.SIMILARITY)
            order = lambda w: set(sorted(near_dedup.labelled(w, k).tolist(), key=lambda h: h * 0x9E3779B97F4A7C15 % (1 << 64))[: near_dedup.rare_grams(len(w), k, near_dedup.SIMILARITY)])  # noqa: B023, E731
            assert len(order(a) & order(b)) >= near_dedup.COMMON
    assert tried > 100


def test_near_dedup_recall_at_the_threshold(spark):
    """Scattered edits at a similarity of just 0.8 or more, in texts of 5 words and more."""
    rng = np.random.default_rng(6)
    rows, n = [], 0
    for length in [*range(5, 13)] * 25 + [15, 20, 50, 51, 60, 100, 300] * 40:
        base = [f"w{x}" for x in rng.integers(1 << 40, size=length)]
        other = _edited(rng, base, length, length // 5) if n % 4 else [*base[: length // 2], "one", *base[length // 2 :]]
        rows += [(2 * n, base), (2 * n + 1, other)]
        n += 1
    found = _classes(spark, rows)
    lost = [len(rows[2 * i][1]) for i in range(n) if found[2 * i + 1] != 2 * i]
    assert not [x for x in lost if x <= 50] and len(lost) <= 0.005 * n


def test_near_dedup_short_templates(spark):
    """Short texts one word apart, with thousands of strangers of equal words but two."""
    rows = [(i, ["your", "order", f"a{i}", "was", "sent", f"b{i}"]) for i in range(3000)]
    rows += [(3000 + i, ["your", "order", f"a{i}", "was", "sent", f"c{i}"]) for i in range(0, 3000, 7)]
    found = _classes(spark, rows)
    assert all(found[i] == i - 3000 * (i >= 3000) for i in found)


def test_near_dedup_texts_that_share_an_id(spark):
    """A text is not lost with its id: each has a class of its own."""
    other = " ".join(f"else{i}" for i in range(40))
    third = " ".join(f"third{i}" for i in range(40))
    docs = spark.createDataFrame([(1, BODY), (2, NEAR), (2, other), (3, third), (3, BODY.upper()), (3, other), (3, other), (4, third)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["class_id"]) for r in table(near_dedup.near_duplicates(docs))) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (4, 3)]
    assert sorted((r["doc_id"], r["text"]) for r in table(near_dedup.keep_one(docs))) == sorted([(1, BODY), (2, other), (3, third)])


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    found = {r["node"]: r["root"] for r in table(near_dedup.components(spark.createDataFrame(chain, "u long, v long")))}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_toxicity(spark, docs, labels):
    rows = table(toxicity.score_documents(docs, labels))
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    none = table(toxicity.score_documents(docs, labels.limit(0)))
    assert all(r["score"] == 0 for r in none)
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def plain_score(model, text):
    """A document's score by trying all segments, and its passages' expected numbers."""
    import math
    import re

    found = re.findall(r"\w+", text.lower())
    scores = []
    for i, w in enumerate(found):
        beginnings = [w] + [w[:n] + "*" for n in (8, 7, 6, 5, 4) if len(w) > n]
        s = next((model.weights[u] for u in beginnings if u in model.weights), toxicity.NEUTRAL)
        scores.append(toxicity.NEUTRAL if s > 0 and i and found[i - 1] == w else s)

    def maximal(low, high):
        best = max(((sum(scores[i:j]), i - j, i, j) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0,))
        return [] if best[0] <= 1e-12 else [*maximal(low, best[2]), best[0], *maximal(best[3], high)]

    normal = sorted((model.scale * s - model.log_k - math.log(max(len(found), 1)) for s in maximal(0, len(found))), reverse=True)
    told = [0.0] + [-math.log(1 - math.exp(-math.exp(-max(s, -6)))) if s <= 30 else s for s in normal[:1]]
    for r in range(2, len(normal) + 1):
        if normal[r - 1] <= 0:
            break
        total = sum(normal[:r])
        told.append(total - (r - 1) * math.log(2 * max(total, 1)) + math.log(math.factorial(r) * math.factorial(r - 1)))
    return 1 / (1 + math.exp(-min(model.logistic[0] + model.logistic[1] * min(max(told), 60.0), 30.0))), [math.exp(-s) for s in normal]


def test_toxicity_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, toxicity.id_remainder("doc_id", 3) != 1)
    rows = docs.where("length(text) < 700 OR text IS NULL")
    texts = defaultdict(list)
    for r in rows.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    whole = {r["doc_id"]: r for r in table(toxicity.score_documents(docs, labels)) if len(texts[r["doc_id"]]) == 1}
    assert len(whole) > 100
    for i, r in whole.items():
        score, expected = plain_score(model, texts[i][0])
        assert abs(r["score"] - score) < 1e-6 and r["predicted"] == int(score >= 0.7)
        assert r["n_passages"] == sum(x <= toxicity.EXPECTED for x in expected) and r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert any(r["predicted"] for r in whole.values())


def test_toxicity_without_evidence_does_not_score_by_length(spark, docs):
    given, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(given, labels)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "zq", "zq zw " * 40, "zq zw " * 30_000, "zq"])], "i int, text string")
    assert len({r["s"]["score"] for r in rows.select(toxicity.score_column(model, F.col("text")).alias("s")).collect()}) == 1


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = [r for r in table(toxicity.score_documents(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id")) if r["held_out"]]
    toxic, clean = ([r for r in rows if r["toxic"] == x] for x in (1, 0))
    assert np.mean([r["predicted"] for r in toxic]) > 0.8 and np.mean([r["predicted"] for r in clean]) < 0.01
    # calibration: passages that chance would bring, on clean documents that nothing was learned from
    assert sum(r["n_passages"] for r in clean) <= 1.5 * toxicity.EXPECTED * len(clean)


def test_langid(spark, docs):
    rows = {r["doc_id"]: r for r in table(langid.identify(docs))}
    assert rows[4]["lang_pred"] == rows[5]["lang_pred"] == rows[12]["lang_pred"] == "und" and rows[7]["lang_pred"] == "en"
    assert all(r["lang_pred"] == "und" for r in table(langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))))
    assert langid.identify(docs.limit(0)).count() == 0
    assert langid.keep_known(docs).columns == docs.columns


def test_langid_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs, langid.id_remainder("doc_id", 4) != 2)
    rows = table(docs.select("doc_id", "lang", langid.predict_column(net, F.col("text")).alias("p")).where(langid.id_remainder("doc_id", 4) == 2))
    assert np.mean([r["lang"] == r["p"]["lang"] for r in rows]) > 0.97
    assert len(net.position_labels("the in ünd, 12")) == len("the in ünd, 12".encode())


def test_langid_with_one_language_and_repeats(spark):
    rows = [(i, t, "xx" if i % 3 else None) for i, t in enumerate(["one two three", "one two three", "12", None, "", "ÄÖ ß", "one two three"])]
    found = table(langid.identify(spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string")))
    assert sorted((r["doc_id"], r["lang_pred"]) for r in found) == [(0, "xx"), (0, "xx"), (1, "xx"), (2, "und"), (3, "und"), (4, "und"), (5, "xx"), (6, "xx")]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, SF).persist()
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before), name
        if name == "line_dedup":
            truth = {i: h for i, _, _, h in line_truth([(r["doc_id"], r["text"]) for r in before.values()])}
            assert all(hashlib.sha256(r["text"].encode()).hexdigest() == truth[i] and r["n_chars"] == len(r["text"]) for i, r in after.items())
        else:
            assert all(after[i] == before[i] for i in after)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    whole = corpus_pipeline.run(spark, SF)
    digest = [sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in x.collect()) for x in (pieces, whole)]
    assert digest[0] == digest[1] and {i for i, *_ in digest[0]} == set(after)


def test_pipeline_on_awkward_rows(spark, docs):
    import corpus_pipeline

    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF)
            assert rows.columns == docs.columns
        assert all(r[c] == "clash" for r in rows.collect() for c in CLASHING)
        corpus_pipeline.STAGES[-1][1](spark, rows, SF).count()


def test_queries_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        found = queries.QUERIES[name](spark, SF)
        rel = con.sql(sql)
        order = list(rel.columns)
        assert sorted(order) == sorted(found.columns)
        assert json.dumps(sorted(map(list, found.select(*order).collect()))) == json.dumps(sorted(map(list, rel.fetchall()))), name


def test_components_steps_follow_the_edges(spark, monkeypatch):
    """Stars take no step but their own, and a step of few edges is written by few tasks, whatever the shuffle partitions."""
    taken = []
    put = common.Steps.__call__

    def call(self, df, label):
        out = put(self, df, label)
        taken.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(common.Steps, "__call__", call)
    stars = [(10 * a + b, 10 * a) for a in range(5) for b in range(1, 4)]
    found = {r["node"]: r["root"] for r in table(near_dedup.components(spark.createDataFrame(stars, "u long, v long")))}
    assert found == {n: n // 10 * 10 for a in range(5) for n in range(10 * a, 10 * a + 4)} and len(taken) == 1
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        taken.clear()
        found = table(near_dedup.components(spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")))
        assert {(r["node"], r["root"]) for r in found} == {(i, 0) for i in range(61)} and len(taken) > 1
        assert max(taken[1:]) <= near_dedup.FEW_TASKS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was[1])
