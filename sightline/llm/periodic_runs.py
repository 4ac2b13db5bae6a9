"""Periodic runs in word sequences by descending-LCP Kruskal.

Adjacent suffixes of the sorted suffixes of a text are edges weighted by their longest common prefix (LCP). Taking the
edges by descending weight, a union-find over ordered position sets unites the classes of suffixes that share so many
words. Two positions that become neighbours in their set at weight l, at a distance d of l at most, bound a stretch of
d + l words with smallest period d; it is a run if the word before it breaks the period. Every run shows up this way:
its first position and the one a period later share exactly its length less the period, and no position of their class
can lie between them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import mixed_bits

LEAST_WORDS, LEAST_EXPONENT = 6, 4
BLOCK = 1024


class Positions:
    """An ordered set of positions in sorted blocks, so that adding one moves a block at most."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, first: int):
        self.blocks, self.tops, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def around(self, x: int) -> tuple[int, int]:
        """The nearest members below and above ``x``, which is no member; -1 where there is none."""
        k = bisect_left(self.tops, x)
        if k == len(self.blocks):
            return self.tops[-1], -1
        block = self.blocks[k]
        p = bisect_left(block, x)
        return (block[p - 1] if p else self.tops[k - 1] if k else -1), block[p]

    def add(self, x: int) -> None:
        k = min(bisect_left(self.tops, x), len(self.blocks) - 1)
        block = self.blocks[k]
        insort(block, x)
        if len(block) > BLOCK:
            self.blocks[k : k + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]
            self.tops[k : k + 1] = [block[BLOCK // 2 - 1], block[-1]]
        else:
            self.tops[k] = block[-1]
        self.size += 1


def least_common(least: int, exponent: int) -> int:
    """The fewest words that the two suffixes at the start of a run and a period later can share."""
    return min(max(least - q, (exponent - 1) * q) for q in range(1, max(least, 2)))


def repeated(ids: np.ndarray, width: int) -> bool:
    """Whether some ``width`` words may occur twice (equal stretches always hash alike)."""
    mixed = mixed_bits(ids.astype(np.uint64) + np.uint64(1))
    count = len(ids) - width + 1
    sums = np.zeros(count, dtype=np.uint64)
    for k in range(width):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + count]
    sums.sort()
    return bool((sums[1:] == sums[:-1]).any())


def suffix_edges(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the sorted suffixes that share ``width`` words or more, and how many they share.

    Ranks of stretches double in width until all suffixes differ; the common prefixes are then read off the ranks from
    the widest stretch to the narrowest. Memory is words times the number of doublings.
    """
    n = len(ids)
    rank = ids = np.unique(ids, return_inverse=True)[1]
    padded = np.concatenate([ids + 1, np.zeros(width, ids.dtype)])
    for k in range(1, width):
        rank = np.unique(rank * (n + 2) + padded[k : k + n], return_inverse=True)[1]
    levels, span = [], width
    while True:
        levels.append(rank.astype(np.int32))
        if int(rank.max()) == n - 1:
            break
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - span)] = rank[span:] + 1
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1]
        span *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    same = levels[0][a] == levels[0][b]
    a, b = a[same], b[same]
    common = np.zeros(len(a), dtype=np.int64)
    for level in reversed(levels):
        inside = np.maximum(a, b) + common < n
        equal = inside & (level[np.minimum(a + common, n - 1)] == level[np.minimum(b + common, n - 1)])
        common[equal] += span
        span //= 2
    for _ in range(width - 1):
        inside = np.maximum(a, b) + common < n
        equal = inside & (ids[np.minimum(a + common, n - 1)] == ids[np.minimum(b + common, n - 1)])
        common[equal] += 1
    return a, b, common


def find_runs(ids: np.ndarray, least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence, by start and period: stretches whose smallest period is q, of
    ``least`` words and ``exponent`` (2 or more) periods at least, that no neighbouring word extends."""
    width = least_common(least, exponent)
    if len(ids) < least or not repeated(ids, width):
        return []
    a, b, common = suffix_edges(ids, width)
    if not len(a):
        return []
    order = np.argsort(-common, kind="stable")
    words = ids.tolist()
    home: dict[int, Positions] = {}
    runs = []

    def seed(i: int, j: int, shared: int) -> None:
        d = j - i
        if shared >= (exponent - 1) * d and shared + d >= least and (i == 0 or words[i - 1] != words[j - 1]):
            runs.append((i, d + shared, d))

    for i, j, shared in zip(a[order].tolist(), b[order].tolist(), common[order].tolist()):
        large = home.get(i) or home.setdefault(i, Positions(i))
        small = home.get(j) or home.setdefault(j, Positions(j))
        if large.size < small.size:
            large, small = small, large
        joining, before = list(small), -1
        for k, x in enumerate(joining):
            below, above = large.around(x)
            following = joining[k + 1] if k + 1 < len(joining) else -1
            if below > before:
                seed(below, x, shared)
            if above >= 0 and (following < 0 or above < following):
                seed(x, above, shared)
            before = x
        for x in joining:
            large.add(x)
            home[x] = large
    runs.sort(key=lambda r: (r[0], r[2]))
    return runs


def kept_words(count: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run is cut to its first period: True for a word in no run after that period."""
    steps = np.zeros(count + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten made periodic from a place that its id decides; null ids are left alone."""
    n = len(words)
    drawn = crc32(b"%d" % doc_id) if doc_id is not None else 1
    if drawn % 10 or not n:
        return words
    g = drawn // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    stretch = words[first : first + period]
    times = -(-(n - first) // period)
    return words[:first] + (stretch * times)[: n - first]


def annotate(
    docs: DataFrame, least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Rows doc_id, n_words, runs (array of start, length, period), collapsed: one for each row of ``docs``.

    Words are separated by the six ASCII white-space characters and numbered from 0; a null text has none. ``rewrite``
    may change the words first. ``collapsed`` is the words outside repeated periods, joined by one space (empty without
    words). Runs of one text may overlap. Equal rows each give a row, an empty table none; other columns are not read.
    Whole texts are searched in their task, without a shuffle; a task holds one text at a time beside its batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            counts, all_runs, collapsed = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").split()
                if rewrite:
                    words = rewrite(doc_id, words)
                numbers: dict[bytes, int] = {}
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                runs = find_runs(ids, least, exponent)
                if runs:
                    stay = kept_words(len(words), runs)
                    words = [words[k] for k in np.flatnonzero(stay).tolist()]
                counts.append(len(ids))
                all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                collapsed.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(all_runs, kind), pa.array(collapsed, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: str) -> F.Column:
    """Of an array of runs the one with the greatest exact length / period; ties: smallest start, then period.

    Runs are in the order of start and period, so a later one must be greater to replace an earlier one; quotients are
    compared as products of whole numbers.
    """
    return F.aggregate(
        F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(F.col(runs), F.lit(0)),
        lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best),
    )


def digests(annotated: DataFrame) -> DataFrame:
    """Rows of :func:`annotate` as n_runs, the strongest run, and SHA-256 of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = annotated.withColumn("best", strongest("runs"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
