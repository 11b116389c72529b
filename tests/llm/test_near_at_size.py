"""What the near-duplicate filter leaves and moves where texts are many or long."""

import numpy as np

from netdrift.llm import common, near_dedup

KIND = "node long, root long, tokens binary"


def written_bytes(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_with_a_hot_passage_are_settled_by_their_rare_runs(spark):
    """A passage that all texts have, among far more words of their own, leaves none to blocks, however many those are."""
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 1 << 30, 1000, np.uint32)
    own = [rng.integers(0, 1 << 30, 20_000, np.uint32) for _ in range(39)]
    own.append(np.where(rng.random(20_000) < 0.05, rng.integers(0, 1 << 30, 20_000, np.uint32), own[0]))
    texts = spark.createDataFrame([(i, i, np.r_[passage, w].astype(np.uint32).tobytes()) for i, w in enumerate(own)], KIND)
    pairs, rest = near_dedup._rare_pairs(texts, 3, near_dedup.SIMILARITY, common.Steps(spark))
    assert [tuple(r) for r in pairs.collect()] == [(0, 39)]
    assert rest.count() == 0


def test_blocks_move_no_more_than_their_room_at_once(spark, monkeypatch):
    """Blocks all meet, in as many runs as keep each within its room; every link is found."""
    rng = np.random.default_rng(6)
    n, room, moved = 1 << 17, 24 << 20, []
    monkeypatch.setattr(near_dedup, "ROOM", room, raising=False)
    texts = [rng.integers(0, 1 << 30, n, np.uint32) for _ in range(20)]
    for a, b in ((3, 17), (8, 9)):
        texts[b] = np.where(rng.random(n) < 0.002, rng.integers(0, 1 << 30, n, np.uint32), texts[a])
    whole = common.Steps.__call__

    def step(self, df, label):
        before = written_bytes(spark)
        out = whole(self, df, label)
        if label == "near-block-links":
            moved.append(written_bytes(spark) - before)
        return out

    monkeypatch.setattr(common.Steps, "__call__", step)
    df = spark.createDataFrame([(i, i, w.astype(np.uint32).tobytes()) for i, w in enumerate(texts)], KIND)
    links = near_dedup._all_links(df, near_dedup.SIMILARITY, common.Steps(spark))
    assert sorted((min(r), max(r)) for r in links.collect()) == [(3, 17), (8, 9)]
    assert max(moved) <= 2 * room
