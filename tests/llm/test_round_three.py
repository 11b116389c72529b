"""Lexical search, HTML extraction and whitening: awkward rows and the given small tables, against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netdrift.llm import bpe, html_text, lexical, packing, queries, sharding, topk, whitening

SF = "/root/testdata/sf0.001"
EXTRA = ("item", "n", "terms", "tf", "rank", "score", "rows", "x", "dim", "n_chars", "id", "w", "sums", "_i", "_v", "s", "held")


def clashing(spark, rows, names, kinds):
    """``rows`` with further columns named as the code names its own."""
    more = [c for c in EXTRA if c not in names]
    return spark.createDataFrame([(*r, *["clash"] * len(more)) for r in rows], f"{kinds}, " + ", ".join(f"`{c}` string" for c in more))


# ranked lexical search
DOCS = [
    (1, "The cat, the CAT and a dog."), (2, "cat " * 40), (3, None), (4, ""), (5, "... !!"), (6, "dog dog dog"), (6, "dog dog dog"), (7, "Ünïcode cat-dog ÜNÏCODE"),
    (None, "cat cat"), (8, "the " * 5000 + "zebra"), (9, "the cat the CAT and a dog"), (10, "x" * 100_000 + " dog"), (11, "cat\x00dog\x7fdog_cat"),
]
ITEMS = [(1, "The cat dog"), (2, None), (3, "dog dog dog zebra"), (3, "zzz not the least"), (4, "absent words only here"), (None, "ünïcode"), (5, "!!"), (6, "cat")]


def shown(found):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=repr)


def test_lexical_awkward_rows(spark):
    docs = clashing(spark, DOCS, ("doc_id", "text"), "doc_id long, text string").repartition(3)
    items = clashing(spark, ITEMS, ("item_id", "text"), "item_id long, text string")
    single = [(i, min(t for j, t in ITEMS if j == i and t is not None)) for i in {i for i, t in ITEMS if t is not None}]
    for k in (1, 3, 20):
        assert shown(lexical.search(docs, items, k)) == sorted(lexical.search_brute(DOCS, single, k), key=repr)
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items.limit(0), counts=True).columns == ["item_id", "rank", "doc_id", "score", "met"]


def test_lexical_given_tables_in_parts(spark, monkeypatch):
    """The registered query on the given tables; with items in many parts, small buffers and tight thresholds the same."""
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(lexical.search_brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()]), key=repr)
    assert shown(queries.QUERIES["op11_lexical"](spark, SF)) == want
    monkeypatch.setattr(lexical, "PART_CELLS", 4000)
    monkeypatch.setattr(lexical, "SEED_DOCS", 50)
    assert shown(lexical.search(docs.repartition(5), items)) == want


class Shared:
    def __init__(self, value):
        self.value = value


def test_lexical_prunes_whole_batches():
    """Items of rare words each find the documents that have them, and few others need an exact score."""
    rng = np.random.default_rng(3)
    import pyarrow as pa

    texts = [" ".join(["common", *(f"w{w}" for w in rng.integers(0, 4000, 30)), *(["topic"] * 3 + [f"topic{d % 50}"] * 4 if d % 2 else [])]) for d in range(8000)]
    items = [f"topic{i} topic common" for i in range(50)]
    number = {t: i for i, t in enumerate(sorted({t for x in items for t in lexical.terms_of(x)}))}
    batch = pa.record_batch([pa.array(range(8000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    vectors = list(lexical._vectors(Shared(number))([batch]))
    df = np.bincount(np.concatenate([v.column("terms").flatten().to_numpy() for v in vectors]), minlength=len(number))
    weights = np.array([lexical.weight(8000, int(d)) for d in df], np.int64)
    wanted = [{number[t]: n for t, n in lexical.counted(x)[1].items()} for x in items]
    n_terms = sum(sum(v.column("n").to_pylist()) for v in vectors)
    out = next(iter(lexical._search(Shared((wanted, weights, 8000, n_terms, 20, None)))(iter(vectors))))
    assert out.num_rows == 50 * 20 and out.column("met")[0].as_py() < 0.4 * 8000 * 50
    assert all(d % 50 == i and d % 2 or i % 2 == 0 for i, d in zip(out.column("item").to_pylist(), out.column("doc_id").to_pylist(), strict=True))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10**9), st.integers(1, 10**12)), min_size=1, max_size=20), st.integers(1, 10**9), st.integers(1, 10**12))
def test_saturation_is_whole(pairs, n_docs, n_terms):
    tf, n = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    want = [10**9 * int(t) // (1000 * int(t) + 12 * (75 + 25 * int(m) * n_docs // n_terms)) for t, m in pairs if 75 + 25 * int(m) * n_docs // n_terms < 2**58]
    if len(want) == len(pairs):
        assert lexical.saturated(tf, n, n_docs, n_terms).tolist() == want


# HTML extraction
PAGES = {
    "article": ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=a>Home</a></nav><div class='ad'>Buy this now, it is cheap.</div><article><h1>A  title</h1><p><b>One &amp;\n two&nbsp;three<br><p>Yes.</p>"
                "<aside>By the way</aside><p>Five<script>var t='</p>';</script> six.</p></article><footer>&copy; all</footer>", "A title\nOne & two three\nYes.\nFive six."),
    "soup": ("<div id=header><a href=1>In</a></div><div class=content><h2>What happened then</h2><p>It was a long story that nobody wanted to tell, though many people knew it.</p><p>So it goes.</p><p>Then there came "
             "another day with a few more words of <a href=2>the story</a> that stayed untold.</p></div><div class=sidebar><p>More stories for you to read today.</p></div><div id=comments><p>I liked this story a lot, and "
             "will come back for more of them.</p></div>", "What happened then\nIt was a long story that nobody wanted to tell, though many people knew it.\nSo it goes.\nThen there came another day with a few more words of the story that stayed untold."),
    "comments": ("<main><p>Text.</p><section class='user-comments'><article class='comment'>I do not agree.</article></section><form><p>Write to us</p></form><p hidden>x</p><p style='display: none'>y</p><!-- <p>z</p> --></main>", "Text."),
    "broken": ("<article><p title='a > b'>one</p><p class=\"two>three</p><p>four &lt;five&gt; &nosuch; &#x41;&#66;<", "one\nthree\nfour <five> &nosuch; AB<"),
    "empty": ("<html><body></body></html>", ""), "plain": ("", ""), "links": ("<ul><li><a href=a>a b</a></li><li><a href=b>c d</a></li></ul>", ""),
    "end tags left out": ("<article><ul><li>one<li class=ad>two<li>three</ul><table><tr><td>four<td>five</table>", "one\nthree\nfour\nfive"),
    "raw end": ("<article><p>kept</p><script>never closed <p>lost</p>", "kept"),
}


def test_html_pages(spark):
    rows = [(i, f"u{i}", page) for i, (page, _) in enumerate(PAGES.values())] + [(None, None, None), (0, "u0", PAGES["article"][0]), (99, "long", "<article>" + "<p>word one</p>" * 50_000)]
    pages = clashing(spark, rows, ("page_id", "url", "html"), "page_id long, url string, html string").repartition(2)
    found = html_text.extract(pages).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) and r["rank"] == "clash" for r in found)
    texts = {}
    for r in found:
        texts.setdefault(r["page_id"], set()).add(r["text"])
    for i, (name, (_, want)) in enumerate(PAGES.items()):
        assert texts[i] == {want}, name
    assert texts[None] == {""} and texts[99] == {"\n".join(["word one"] * 50_000)}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_given_pages(spark):
    """The given pages have one article each: its blocks, by a plain reading of this known form."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = queries.QUERIES["op12_html"](spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_html_tree():
    """The tree tells nearly all of its table; what it says of articles and of what is around them does not hang on lengths."""
    x, y = html_text.labelled_table()
    tree = html_text.tree()
    assert (html_text.classified(x, tree) == y).mean() > 0.98 and 0.3 < y.mean() < 0.7
    rng = np.random.default_rng(2)
    any_block = np.column_stack([rng.integers(1, 90, 2000), rng.random(2000), rng.integers(0, 90, 2000), rng.random(2000), rng.integers(0, 90, 2000), rng.random(2000), rng.integers(0, 2, (2000, 2))])
    assert html_text.classified(np.column_stack([any_block, np.ones(2000)]), tree).all()
    assert not html_text.classified(np.column_stack([any_block, -np.ones(2000)]), tree).any()
    left = [i for i in range(len(html_text.LABELLED)) if i % 4 == 0]  # grown without every fourth page
    sizes = [len(line.split()) for line in html_text.LABELLED]
    page = np.repeat(np.arange(len(sizes)), sizes)
    held = np.isin(page, left)
    assert (html_text.classified(x[held], html_text.grown(x[~held], y[~held])) == y[held]).mean() > 0.85


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/!-\"'= apdivscrt&;#\n", max_size=120))
def test_html_reads_anything(page):
    assert html_text.main_text(page) == "\n".join(" ".join(b.split()) for b in html_text.main_text(page).split("\n")) if page else True


# whitening
VECTORS = [(1, [1.0, 2.0, 3.0]), (2, [2.0, -1.0, 0.5]), (3, None), (4, [1.0, None, 2.0]), (5, [math.nan, 0.0, 0.0]), (6, [math.inf, 0.0, 0.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [0.25, 0.5, -4.0]),
           (9, [3.0, 1.0]), (10, [1.0, 1.5]), (11, [0.0, 4.0]), (12, [7.0]), (13, [-2.0, 5.0, 1.0]), (13, [0.0, 0.0, 0.125])]


def whole(rows):
    return np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in rows], np.int64)


def equal(found, x, components):
    """Rows of the job, ordered like ``x``, against a dense decomposition; signs are free but the same for all rows."""
    n, deviation, white, explained = whitening.whiten_brute(x, components)
    k = len(explained)
    w = np.array([r["whitened"] for r in found]).reshape(-1, k)
    assert {r["n"] for r in found} == {n} and [r["deviation"] for r in found[::k]] == deviation and [r["component"] for r in found[:k]] == list(range(1, k + 1))
    assert np.allclose(w * np.sign((w * white).sum(axis=0)), white, atol=1e-8) and np.allclose([r["explained"] for r in found[:k]], explained, rtol=1e-9)
    assert max(r["identity_error"] for r in found) < 1e-9


def test_whitening_awkward_rows(spark):
    rows = clashing(spark, VECTORS, ("vec_id", "embedding"), "vec_id long, embedding array<float>").repartition(3)
    found = sorted(whitening.whiten(rows).collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["deviation"], r["component"]))
    three = [(i, v) for i, v in VECTORS if v is not None and len(v) == 3 and all(c is not None and math.isfinite(c) for c in v)]
    n, deviation, *_ = whitening.whiten_brute(whole([v for _, v in three]), 16)
    three = [v for _, v in sorted(zip(deviation, three, strict=True), key=lambda p: (p[1][0] is None, p[1][0] or 0, p[0]))]
    ids = {i for i, _ in three}
    equal([r for r in found if r["vec_id"] in ids], whole([v for _, v in three]), 16)
    equal([r for r in found if r["vec_id"] in (9, 10, 11)], whole([v for i, v in VECTORS if i in (9, 10, 11)]), 16)
    assert not [r for r in found if r["vec_id"] in (3, 4, 5, 6, 7, 12)]
    assert whitening.whiten(rows.limit(0)).count() == 0


def test_whitening_given_vectors(spark):
    found = sorted(queries.QUERIES["op13_whitening"](spark, SF).collect(), key=lambda r: (r["vec_id"], r["component"]))
    given = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    equal(found, whole([[float(c) for c in r["embedding"]] for r in given]), 16)


@pytest.mark.parametrize("kind", ["random", "equal values", "low rank", "clusters", "integers", "diagonal", "one"])
def test_eigenpairs(kind):
    rng = np.random.default_rng(11)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    cov = {
        "random": np.cov(rng.normal(size=(200, 40)).T), "equal values": np.eye(40) * 3.0, "low rank": np.cov(rng.normal(size=(7, 40)).T),
        "clusters": q @ np.diag(np.r_[np.ones(9), np.full(9, 1 - 1e-10), np.linspace(0.5, 0, 22)]) @ q.T, "integers": np.cov(rng.integers(-2, 3, (9, 12)).astype(float).T),
        "diagonal": np.diag(np.r_[np.full(10, 5.0), np.ones(20)]), "one": np.array([[2.5]]),
    }[kind]
    values, vectors = whitening.eigenpairs((cov + cov.T) / 2, 16)
    want = np.sort(np.linalg.eigvalsh(cov))[::-1][:16]
    want = want[want > 1e-11 * want[0]]
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-9)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12) and np.allclose(cov @ vectors.T, vectors.T * values, atol=1e-12 * want[0])
    assert whitening.eigenpairs(np.zeros((3, 3)), 2)[0].size == 0


def test_deviations_are_exact():
    x = np.array([[2**40, 5], [-(2**40), 7], [3, 9]], np.int64)
    assert whitening.deviations(x, 3, x.sum(axis=0)) == [None, None, (9 - 3) ** 2 + (27 - 21) ** 2]
    small = np.array([[1, 2], [4, 4]], np.int64)
    assert whitening.deviations(small, 2, small.sum(axis=0)) == [9 + 4, 9 + 4]


def test_packing_has_the_ids_of_the_library(spark):
    """Texts that spell a special token get its id, as by the library's plain call on the file."""
    from tokenizers import Tokenizer

    path = bpe.default_json()
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain words\nand <|endof text|> none", "x<|endoftext|>\n\n  y's 12345 ß", "<|endoftext|><|endoftext|> tail."]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    plain = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])])
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, packing.END_ID]
    assert bpe.codec(path).encode(["<|endoftext|>"])[0].tolist() != plain.encode("<|endoftext|>", add_special_tokens=False).ids


def test_shards_are_as_even_as_plain_lpt(spark):
    """Two levels of heaps against one heap over all groups of equal texts, largest first."""
    import heapq
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = Counter()
    for r in docs.collect():
        sizes[r["text"] or ""] += len((r["text"] or "").encode()) + 1
    heap = [(0, s) for s in range(16)]
    for size in sorted(sizes.values(), reverse=True):
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, shard))
    loads = Counter()
    for r in sharding.shard_documents(docs, 16).collect():
        loads[r["shard"]] += r["size"]
    best = max(load for load, _ in heap)
    assert sum(loads.values()) == sum(sizes.values()) and max(loads.values()) <= best + max(sizes.values())


def test_a_block_of_long_vectors_is_cut_by_numbers():
    """A block of 512 queries against 4,096 candidates of 768 components stays under 500 MB, and is right."""
    import tracemalloc

    rng = np.random.default_rng(1)
    x = rng.integers(-256, 256, (4096, 768)).astype(float)
    ids = np.arange(4096)
    tracemalloc.start()
    best = topk.BestK(ids[:512], x[:512], 5)
    best.meet(ids, x, [topk._segments(x, g) for g in topk.levels(768)])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 500 << 20
    score = x[:512] @ x.T
    score[np.arange(512), np.arange(512)] = -np.inf
    assert np.array_equal(best.scores, -np.sort(-score, axis=1)[:, :5])
