"""Quality classifier by co-training of two views.

One view is the text's content (hashed byte trigrams, repetition), the other its metadata and layout (language, source,
length, lines, share of kinds of characters). Each has a logistic classifier. Over rounds, the documents of an unlabelled
pool on which one view is confident become pseudo-labels for the other. Both are calibrated on labelled documents kept
aside, and a combination of the calibrated views scores every document.

Training uses a bounded sample: at most ``labelled`` documents with labels and ``pool`` without, drawn by a hash of their
ids. Scoring covers all documents and whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import byte_slices, drawn, mixed_bits, word_hashes

LABELLED, POOL = 6000, 6000
ROUNDS, CONFIDENT, EACH_ROUND = 3, 0.98, 600
TRIGRAMS, LANGS, SOURCES = 512, 16, 64
SURE = 0.5  # a document goes only if its chance of being good is below this
L2 = 0.05
#: Kinds of bytes: lower, upper, digit, space, line end, common punctuation, brackets and rules, other ASCII, beyond ASCII.
KINDS = 9
_KIND = np.full(256, 7, dtype=np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 8
_KIND[[9, 32]], _KIND[[10, 11, 12, 13]] = 3, 4
_KIND[[ord(c) for c in ".,;:'\"-?"]] = 5
_KIND[[ord(c) for c in "|[]{}<>_=/"]] = 6
CONTENT = TRIGRAMS + 5
LAYOUT = LANGS + SOURCES + KINDS + 7


def features(langs: list, sources: list, lengths: list, texts: pa.Array) -> Iterator[np.ndarray]:
    """Rows of both views side by side (content, then layout), a run of documents at a time."""
    for first, data, offsets in byte_slices(texts):
        count = len(offsets) - 1
        sizes = np.diff(offsets)
        out = np.zeros((count, CONTENT + LAYOUT), dtype=np.float32)
        hashes, starts, ends, firsts = word_hashes(data, offsets)
        wide = data.astype(np.uint64)
        grams = np.zeros(len(data), dtype=np.int64)
        if len(data) > 2:
            grams[2:] = (mixed_bits(wide[2:] | wide[1:-1] << np.uint64(8) | wide[:-2] << np.uint64(16)) >> np.uint64(55)).astype(np.int64)
        kind = _KIND[data]
        repeat = np.zeros(len(hashes), dtype=bool)
        repeat[1:] = hashes[1:] == hashes[:-1]
        word_bytes = ends - starts
        for k in range(count):
            a, b = int(offsets[k]), int(offsets[k + 1])
            u, v = int(firsts[k]), int(firsts[k + 1])
            row = out[k]
            if b - a > 2:
                counts = np.sqrt(np.bincount(grams[a + 2 : b], minlength=TRIGRAMS))
                row[:TRIGRAMS] = counts / np.sqrt((counts * counts).sum())
            words = v - u
            if words:
                distinct = len(np.unique(hashes[u:v]))
                row[TRIGRAMS : TRIGRAMS + 5] = (
                    distinct / words, repeat[u + 1 : v].mean() if words > 1 else 0.0, np.log1p(words) / 10, word_bytes[u:v].mean() / 10, min(1.0, np.log1p(words / distinct) / 3)
                )
            kinds = np.bincount(kind[a:b], minlength=KINDS)
            at = CONTENT
            row[at + zlib.crc32((langs[first + k] or "").encode()) % LANGS] = 1
            at += LANGS
            row[at + zlib.crc32((sources[first + k] or "").encode()) % SOURCES] = 1
            at += SOURCES
            row[at : at + KINDS] = kinds / max(1, b - a)
            at += KINDS
            lines = kinds[4] + 1
            stated = lengths[first + k]
            row[at : at + 7] = (
                np.log1p(max(0, stated or 0)) / 10, np.log1p(sizes[k]) / 10, np.log1p(lines) / 5, np.log1p(sizes[k] / lines) / 10,
                np.log1p(kinds[7] + kinds[6]) / 5, kinds[1] / max(1, kinds[0] + kinds[1]), 1.0 if sizes[k] == 0 else 0.0,
            )
        yield out


class Logistic:
    """L2-regularised logistic regression by Newton steps, each shortened until the penalised loss falls."""

    def __init__(self, l2: float = L2):
        self.l2, self.weights = l2, None

    def fit(self, x: np.ndarray, y: np.ndarray, importance: np.ndarray | None = None, steps: int = 8) -> Logistic:
        x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
        importance = np.ones(len(x)) if importance is None else importance
        w = np.zeros(x.shape[1]) if self.weights is None else self.weights
        ridge = np.full(x.shape[1], self.l2)
        ridge[-1] = 1e-6

        def loss(w: np.ndarray) -> float:
            z = x @ w
            return float((importance * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * w * w).sum())

        now = loss(w)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = np.maximum(p * (1 - p), 1e-6) * importance
            step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(ridge), x.T @ ((p - y) * importance) + ridge * w)
            size = 1.0
            while (after := loss(w - size * step)) > now and size > 1e-4:
                size /= 2
            if after > now:
                break
            w, gained, now = w - size * step, now - after, after
            if gained < 1e-6 * len(x):
                break
        self.weights = w
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)


def _chance(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logits))


def _cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The threshold that errs least often on ``scores`` with labels ``y``, ``SURE`` at most: the middle, in logits, of the
    first gap between scores at which this is so. A few wrong labels among many right ones do not move it."""
    order = np.argsort(scores, kind="stable")
    scores, gains = scores[order], np.cumsum(1 - 2 * y[order])  # bad documents less good ones among those rejected
    ends = np.flatnonzero(np.r_[scores[1:] > scores[:-1], True])  # equal scores go together
    if not len(ends) or gains[ends].max() <= 0:
        return 0.0
    end = ends[np.argmax(gains[ends])]
    if end + 1 == len(scores):
        return SURE
    a, b = np.log(scores[end : end + 2] / (1 - scores[end : end + 2]))
    return min(SURE, float(_chance((a + b) / 2)))


class CoTrained:
    """Two views that label for each other, and their calibrated combination."""

    def __init__(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray, pool: np.ndarray, rounds: int = ROUNDS, confident: float = CONFIDENT, each: int = EACH_ROUND):
        cut = [slice(0, CONTENT), slice(CONTENT, CONTENT + LAYOUT)]
        train = ~aside
        self.views = [Logistic().fit(x[train, c], y[train]) for c in cut]
        given = [np.zeros(len(pool)), np.zeros(len(pool))]  # pseudo-labels for each view: 0 none, 1 good, -1 bad
        self.exchanged = [0, 0]
        for _ in range(rounds if len(pool) else 0):
            for teacher, pupil in ((0, 1), (1, 0)):
                p = _chance(self.views[teacher].logits(pool[:, cut[teacher]]))
                for label, sure in ((1, p), (-1, 1 - p)):
                    order = np.argsort(-sure, kind="stable")
                    order = order[(sure[order] >= confident) & (given[pupil][order] == 0)][:each]
                    given[pupil][order] = label
            for k in (0, 1):
                some = given[k] != 0
                self.exchanged[k] = int(some.sum())
                both_x = np.vstack([x[train, cut[k]], pool[some, cut[k]]])
                both_y = np.concatenate([y[train], given[k][some] > 0])
                self.views[k].fit(both_x, both_y, np.concatenate([np.ones(train.sum()), np.full(some.sum(), 0.5)]), steps=4)
        self.cut = cut
        z = self._view_logits(x[aside])
        self.scales = [Logistic(0.1).fit(z[:, [k]], y[aside]) for k in (0, 1)]
        self.joint = Logistic(0.1).fit(self._calibrated(z), y[aside])
        self.threshold = _cut(self.scores(x[aside]), y[aside])

    def _view_logits(self, x: np.ndarray) -> np.ndarray:
        return np.stack([v.logits(x[:, c]) for v, c in zip(self.views, self.cut)], axis=1)

    def _calibrated(self, z: np.ndarray) -> np.ndarray:
        return np.stack([s.logits(z[:, [k]]) for k, s in enumerate(self.scales)], axis=1)

    def view_scores(self, x: np.ndarray) -> np.ndarray:
        return _chance(self._calibrated(self._view_logits(x)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _chance(self.joint.logits(self._calibrated(self._view_logits(x))))


def _columns(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> CoTrained | None:
    """The classifier for ``labels`` (doc_id, quality): null qualities are left out, repeated ones averaged.

    None if the labelled sample holds less than two documents of either class: there is nothing to learn from.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    chosen = drawn(known.join(ids, "doc_id"), "doc_id", "quality", labelled).withColumn("aside", F.pmod(F.xxhash64(F.lit("aside"), F.col("doc_id")), F.lit(3)) == 0)
    free = drawn(ids.join(known, "doc_id", "left_anti"), "doc_id", "quality", pool)
    sample = chosen.unionByName(free.withColumn("quality", F.lit(-1)).withColumn("aside", F.lit(False)))
    sample = sample.select(F.col("doc_id").alias("chosen_id"), "quality", "aside")
    rows = _columns(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("chosen_id"))  # at most labelled + pool rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources, lengths = (batch.column(k).to_pylist() for k in (2, 3, 4))
            parts = [f.astype(np.float16) for f in features(langs, sources, lengths, batch.column(1))]
            packed = [r.tobytes() for part in parts for r in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), batch.column(6), pa.array(packed, pa.binary())], names=["doc_id", "quality", "aside", "row"])

    found = rows.select("doc_id", "text", "lang", "source", "n_chars", "quality", "aside").mapInArrow(run, "doc_id long, quality int, aside boolean, row binary")
    # of several rows under one id the one with the least features teaches, so no more rows meet than ids were drawn
    found = found.groupBy("doc_id").agg(F.min(F.struct("row", "quality", "aside")).alias("least")).select("doc_id", "least.*").toArrow()
    found = found.sort_by([("doc_id", "ascending")])
    if not found.num_rows:
        return None
    x = np.frombuffer(b"".join(found.column("row").to_pylist()), dtype=np.float16).reshape(found.num_rows, -1).astype(np.float32)
    quality, aside = found.column("quality").to_numpy(), found.column("aside").to_numpy(zero_copy_only=False)
    is_known = quality >= 0
    y, aside = quality[is_known].astype(float), aside[is_known]
    if min(y.sum(), len(y) - y.sum()) < 2:
        return None
    if min(y[aside].sum(), (1 - y[aside]).sum()) < 1 or min(y[~aside].sum(), (1 - y[~aside]).sum()) < 1:
        # too few labels for chance to serve both parts: every second document of each class goes aside
        aside = np.zeros(len(y), dtype=bool)
        for label in (0.0, 1.0):
            aside[np.flatnonzero(y == label)[::2]] = True
    return CoTrained(x[is_known], y, aside, x[~is_known])


def score(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    """One row per document: doc_id, content_score, layout_score, score, keep.

    Scores are probabilities of good quality; ``keep`` is score >= the classifier's threshold, which errs least often
    on the documents kept aside and rejects none whose chance of being good is ``SURE`` or more. Null texts are empty
    texts and null metadata a value of its own. Without enough labels every score is 1 and every document is kept.
    """
    model = fit(docs, labels, labelled, pool)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights
    names = ["doc_id", "content_score", "layout_score", "score", "keep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, sources, lengths = (batch.column(k).to_pylist() for k in (2, 3, 4))
            if model is None:
                ones = np.ones(batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(ones)] * 3, pa.array(ones > 0)], names=names)
                continue
            at = 0
            for x in features(langs, sources, lengths, batch.column(1)):
                views, joint = model.view_scores(x), model.scores(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), *[pa.array(c.astype(float)) for c in (views[:, 0], views[:, 1], joint)], pa.array(joint >= model.threshold)], names=names)
                at += len(x)

    return _columns(docs).mapInArrow(run, "doc_id long, content_score double, layout_score double, score double, keep boolean")


def accepted(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    """``docs`` without the documents that the classifier rejects, all columns as they are."""
    model = fit(docs, labels, labelled, pool)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights
    columns, text = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view = {c: batch.column(columns.index(c)).to_pylist() if c in columns else [None] * batch.num_rows for c in ("lang", "source", "n_chars")}
            scores = [shared.value.scores(x) for x in features(view["lang"], view["source"], view["n_chars"], batch.column(text))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= shared.value.threshold))

    return docs.mapInArrow(run, docs.schema)
