"""The context tree spread over tasks against the whole tree in memory."""

import tracemalloc
import zlib

import numpy as np

from sightline.llm import ctw

FOLDER = "/root/testdata/sf0.001"


def test_chances_near_one_leave_finite_scores():
    # after n sights of one byte the chance of another is about 1 / 2n: no single-precision number tells it from none
    model = ctw.Model([(np.array([0xC3], dtype=np.uint64), np.array([10**9]))])
    scores = model.scores(np.array([0xC3, 0xC2, 0x41], dtype=np.uint64))
    assert np.isfinite(scores).all() and abs(scores[1] + np.log10(2e9)) < 1e-3


def test_subtrees_give_the_scores_of_the_whole_tree(spark, monkeypatch):
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 30_000)
    monkeypatch.setattr(ctw, "SLICE_BYTES", 7_000)
    monkeypatch.setattr(ctw, "CHUNKS_A_TASK", 2)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()[:60]]
    rows += [(9001, None), (9002, ""), (9003, "一二 zq~"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    learned = spark.createDataFrame([(t,) for i, t in rows if not held(i)], "text string")
    for depth in (1, 5, 6):
        model = ctw.fit(ctw.corpus_counts(learned, depth), depth, 1 << 40)
        want = []
        for i, t in rows:
            data = np.frombuffer((t or "").encode(), np.uint8)
            want.append((-1 if i is None else i, len(data), float(model.scores(ctw._windows(data, np.array([0, len(data)]), depth)[0]).sum())))
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.score) for r in ctw.score(docs, depth).collect())
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
        assert np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], rtol=1e-5)


def test_contexts_beyond_any_bound_are_kept(spark):
    texts = [f"{zlib.crc32(str(k).encode()):08x}{zlib.crc32(str(-k).encode()):08x}" for k in range(30_000)]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = ctw.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    learned = [t for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    grams = np.unique(np.concatenate([ctw._windows(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), ctw.DEPTH)[0] for t in learned]))
    assert len(grams) > 1 << 18
    trees = ctw.subtrees(ctw.cut(spark.createDataFrame([(k, False, t) for k, t in enumerate(learned)], "doc_id long, held_out boolean, text string")).where("kind = 1"), 1)
    kept = np.concatenate([ctw._unpacked_grams(r.block) for r in trees.select("block").collect()])
    assert np.array_equal(np.sort(kept), grams)
    assert got.where("score >= 0 or score is null or isnan(score)").count() == 0


def test_a_group_of_subtrees_is_asked_without_keeping_its_nodes():
    rng = np.random.default_rng(5)
    kept, counts = np.unique(rng.integers(97, 104, (200_000, 7)) @ (1 << (8 * np.arange(7))), return_counts=True)
    levels = ctw._levels(kept.astype(np.uint64), counts, 6, 2)
    new = (rng.integers(97, 105, (50_000, 7)) @ (1 << (8 * np.arange(7)))).astype(np.uint64)
    roots = [ctw._Weighed(levels, 2, k).root for k in range(8)]
    above = ctw.top(roots, 2)

    def peak(asked):
        tracemalloc.start()
        model = ctw.Model(levels, 2, above, asked)
        scores = model.scores(new)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return scores, most

    (whole, before), (scores, most) = peak(None), peak([new[:20_000], new[20_000:]])
    assert np.array_equal(whole, scores)
    assert most < 0.8 * before
