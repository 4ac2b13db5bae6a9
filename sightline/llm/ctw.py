"""Language-model scoring by context-tree weighting over bytes.

A byte is coded as eight binary decisions. For every decision (the bits of the byte seen so far) there is one context
tree over the preceding bytes; each node holds the zeros and ones counted in the training documents, estimates them by
Krichevsky and Trofimov, and weighs its own estimate against the product of its children's, at all depths. With the
counts of the whole training set the weights are fixed, and the code length of a byte is one walk down the tree.

Nothing of the tree is left out, and no task holds all of it. The documents are cut into chunks; each chunk gives its
distinct n-grams with their training counts, in blocks by the two bytes before the last one. All contexts that end in
the same two bytes form a subtree, so a group of subtrees is weighed in one task from the blocks of all chunks, up to its
roots; only the nodes above and at the roots meet on the driver (65,536 contexts at most). Then each group of subtrees
scores the n-grams of all chunks, and a chunk's scores meet its texts again. :func:`fit` gives a bounded tree in memory.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import LOWER, MIX_2, byte_slices, grouped_in_arrow, saved

#: Seven bytes before the coded one are the most that a 64-bit n-gram holds, six that `fit` takes.
DEPTH = 6
GRAMS = 1 << 19
HOT_WORDS = 1 << 18
#: No byte of UTF-8 text has this value: it ends a text and stands for what precedes one.
END = 255
END_WORD = b""
SLICE_BYTES = 1 << 20
CHUNK_BYTES = 16 << 20
#: Depth of the subtrees' roots, groups of subtrees, and the most chunks that one task takes of a group.
ROOT = 2
GROUPS = 128
CHUNKS_A_TASK = 512


def held_out(doc_id: Column) -> Column:
    """The documents kept from training: crc32 of the id as text leaves 2 over 7. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _windows(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row its bytes and an end, each with the ``depth`` bytes before it, as integers; the rows' first places."""
    lengths = np.diff(offsets)
    line = np.full(8 + len(data) + depth * (len(lengths) + 1), END, dtype=np.uint8)
    at = np.arange(len(data)) + depth * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    line[8 + at] = data
    scored = np.zeros(len(line), dtype=bool)
    scored[8 + at] = True
    scored[8 + offsets[1:] + depth * np.arange(1, len(lengths) + 1)] = True
    del at
    places = np.flatnonzero(scored)
    wide = np.ndarray((len(line) - 7,), dtype=">u8", buffer=line.tobytes(), strides=(1,))
    grams = wide[places - 7].astype(np.uint64) & np.uint64((1 << (8 * (depth + 1))) - 1)
    return grams, offsets[:-1] + np.arange(len(lengths))


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, sorted, and the sums of their counts; the list of runs is emptied."""
    grams = np.concatenate([np.zeros(0, np.uint64), *[g for g, _ in runs]])
    counts = np.concatenate([np.zeros(0, np.int64), *[c for _, c in runs]])
    runs.clear()
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    del order
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
    return grams[starts], np.add.reduceat(counts, starts) if len(grams) else counts


def _distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.r_[True, ordered[1:] != ordered[:-1]]] if len(ordered) else ordered


class _GramCounts:
    """Counts of n-grams that are added in runs; the runs are merged into one when there are half as many as in it."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting = 0

    @property
    def merged(self) -> int:
        return len(self.keys)

    def add(self, grams: np.ndarray, learned: bool = True) -> None:
        if learned:
            self.put(*np.unique(grams, return_counts=True))
        else:
            keys = _distinct(np.sort(grams))
            self.put(keys, np.zeros(len(keys), np.int64))

    def put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.runs.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(1 << 19, self.merged // 2):
            self.read()

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams, sorted, and the sums of their counts. Only new ones move those already merged."""
        keys, counts = _merged(self.runs)
        self.waiting = 0
        if not self.merged:
            self.keys, self.counts = keys, counts
            return keys, counts
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, self.merged - 1)] == keys
        self.counts[at[known]] += counts[known]
        at, keys, counts = at[~known], keys[~known], counts[~known]
        self.keys = np.insert(self.keys, at, keys)
        self.counts = np.insert(self.counts, at, counts)
        return self.keys, self.counts


def _packed(words: np.ndarray) -> bytes:
    """Numbers as their bytes by significance, compressed."""
    return zlib.compress(words.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(block), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)


def _packed_grams(grams: np.ndarray) -> bytes:
    """Sorted n-grams as steps."""
    return _packed(np.diff(grams, prepend=np.uint64(0)))


def _unpacked_grams(block: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(block), dtype=np.uint64)


def _group(grams: np.ndarray) -> np.ndarray:
    """The group of subtrees of each n-gram: a hash of the two bytes before the last one."""
    roots = (np.arange(1 << 16, dtype=np.uint64) * MIX_2) >> np.uint64(32)
    return (roots % np.uint64(GROUPS)).astype(np.uint8)[((grams >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)]


def corpus_counts(training: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Counts over whole texts of all ``training`` rows: (word, gram, n), with one of word and gram null."""
    schema = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams = _GramCounts()

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal words, grams
            if len(words) > least:
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], schema=schema)
                words = Counter()
            if grams.merged + grams.waiting > 8 * least:
                keys, counts = grams.read()
                yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys.astype(np.int64)), pa.array(counts)], schema=schema)
                grams = _GramCounts()

        for batch in batches:
            for _, data, offsets in byte_slices(batch.column(0), SLICE_BYTES):
                lowered = LOWER[data].tobytes()
                cuts = offsets.tolist()
                for a, b in zip(cuts, cuts[1:]):
                    words.update(lowered[a:b].split())
                words[END_WORD] += len(cuts) - 1
                grams.add(_windows(data, offsets, depth)[0])
                yield from flush(500_000)
        yield from flush(0)

    parts = training.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, gram long, n long")
    return parts.groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0, by Stirling's series after a shift by eight."""
    y = x + 8
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def _log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted number among sorted ``keys``, -1 for those not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _bytes_mask(count: int) -> np.uint64:
    return np.uint64((1 << (8 * count)) - 1)


def _bit_nodes(grams: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nodes with ``k`` bits seen of sorted n-grams: keys (context bytes, then the bits behind a leading one), zeros,
    ones and the place of their first n-gram."""
    byte = grams & np.uint64(255)
    key = (grams & ~np.uint64(255)) | np.uint64(1 << k) | (byte >> np.uint64(8 - k))
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    bit = _next_bits(grams, k)
    zeros, ones = [np.add.reduceat(c, starts) if len(key) else c for c in (counts * (1 - bit), counts * bit)]
    return key[starts], zeros, ones, starts


def _next_bits(grams: np.ndarray, k: int) -> np.ndarray:
    return ((grams >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)


class _Weighed:
    """The nodes with ``k`` bits seen of all depths, weighed from the deepest up: for each depth ``keys``, ``zeros``,
    ``ones``, first n-grams, parents and, but at the deepest, the node's own weight and the probability of a one in
    contexts that are not kept; ``root`` holds keys, zeros, ones and weighted logarithms of the first depth."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], root: int, k: int):
        last = len(levels) - 1
        self.keys, zeros, ones, starts = zip(*[_bit_nodes(grams, counts, k) for grams, counts in levels])
        self.starts = [s.astype(np.int32) for s in starts]
        del starts
        self.zeros, self.ones = zeros, ones
        self.parent = [None] + [np.searchsorted(self.keys[d - 1], self.keys[d] & _bytes_mask(root + d)).astype(np.int32) for d in range(1, last + 1)]
        self.rest, self.weight = [None] * (last + 1), [None] * (last + 1)
        total = _log_estimate(zeros[last].astype(float), ones[last].astype(float))
        for d in range(last - 1, -1, -1):
            size, parent = len(self.keys[d]), self.parent[d + 1]
            own = _log_estimate(zeros[d].astype(float), ones[d].astype(float))
            left = [c[d] - np.bincount(parent, weights=c[d + 1], minlength=size) for c in (zeros, ones)]
            below = np.bincount(parent, weights=total, minlength=size) + _log_estimate(*left)
            self.rest[d] = (left[1] + 0.5) / (left[0] + left[1] + 1)
            self.weight[d] = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
            total = np.logaddexp(own, below) - math.log(2)
        self.root = (self.keys[0], zeros[0], ones[0], total)

    def probabilities(self, entry: tuple | None) -> Iterator[np.ndarray]:
        """For each depth the probability of a one in each node if it is the deepest on the path. ``entry``: sorted keys
        at the first depth, the probability that the nodes above them give, and the weight left (:func:`top`)."""
        last = len(self.keys) - 1
        mixed, remaining = np.zeros(len(self.keys[0])), np.ones(len(self.keys[0]))
        if entry:
            at = np.searchsorted(entry[0], self.keys[0])
            mixed, remaining = entry[1][at], entry[2][at]
        for d in range(last + 1):
            here = (self.ones[d] + 0.5) / (self.zeros[d] + self.ones[d] + 1)
            if d == last:
                yield mixed + remaining * here
                return
            after, still = mixed + remaining * self.weight[d] * here, remaining * (1 - self.weight[d])
            yield after + still * self.rest[d]
            mixed, remaining = after[self.parent[d + 1]], still[self.parent[d + 1]]


def _levels(grams: np.ndarray, counts: np.ndarray, depth: int, root: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """n-grams and counts of the depths from ``root`` to ``depth``, from those of the greatest depth."""
    levels = [(grams, counts)]
    for d in range(depth - 1, root - 1, -1):
        levels.append(_merged([(levels[-1][0] & _bytes_mask(d + 1), levels[-1][1])]))
    return levels[::-1]


class Model:
    """The weighted trees, or the subtrees below depth ``root``, as sorted arrays.

    ``levels[d]`` = (n-grams, counts) kept at depth root + d, sorted. For each depth and each number of bits seen,
    ``nodes`` holds the sorted node keys and the probability of a one if that node is the deepest on the path;
    ``scores_of`` holds the log10 probability of each kept n-gram's last byte if no longer context is kept, so most bytes
    need one look-up and only bytes new to their context need the walk. Subtrees take from ``above`` (:func:`top`) what
    the nodes above them give.

    Where all that will be asked is known, ``asked`` gives it, one array of n-grams after another: their walks are taken
    while the nodes of one number of bits are at hand, and ``nodes`` keeps none.
    """

    def __init__(
        self, levels: list[tuple[np.ndarray, np.ndarray]], root: int = 0, above: tuple | None = None,
        asked: Iterable[np.ndarray] | None = None,
    ):
        self.root, self.depth = root, root + len(levels) - 1
        self.nodes: list[list[tuple[np.ndarray, np.ndarray]]] | None = None if asked is not None else [[] for _ in range(self.depth + 1)]
        self.grams = [grams for grams, _ in levels]
        self.contexts = [_distinct(grams >> np.uint64(8)) for grams in self.grams]
        if asked is not None:
            walks = _GramCounts()
            for grams in asked:
                walks.add(grams[self._found(grams)[1]])
            self.asked = walks.read()[0]
            self.walked = np.zeros(len(self.asked))
            del walks
        whole = [np.zeros(len(grams)) for grams in self.grams]
        for k in range(8):
            weighed = _Weighed(levels, root, k)
            nodes = [above[0][d][k] for d in range(root)] if above else [(np.zeros(0, np.uint64), np.zeros(0))] * root
            for d, one in enumerate(weighed.probabilities(above and above[1][k])):
                nodes.append((weighed.keys[d], one))
                if len(one):
                    here = np.repeat(one, np.diff(np.r_[weighed.starts[d], len(self.grams[d])]))
                    whole[d] += np.log10(np.where(_next_bits(self.grams[d], k) == 1, here, 1 - here))
            if self.nodes is None:
                self.walked += _walk_step(nodes, self.asked, k)
            else:
                for kept, node in zip(self.nodes, nodes):
                    kept.append(node)
        self.scores_of = whole

    def _found(self, grams: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
        """The n-grams that are kept whole, as (depth, which of ``grams``, place there), and those that need the walk."""
        left, hits, slow = np.arange(len(grams)), [], []
        for d in range(self.depth, self.root - 1, -1):
            here = grams[left] & _bytes_mask(d + 1)
            place = _place(self.grams[d - self.root], here)
            hit = place >= 0
            hits.append((d - self.root, left[hit], place[hit]))
            left, here = left[~hit], here[~hit]
            known = _place(self.contexts[d - self.root], here >> np.uint64(8)) >= 0 if d else np.ones(len(left), dtype=bool)
            slow.append(left[known])
            left = left[~known]
        return hits, np.concatenate([*slow, left])

    def scores(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each n-gram given those before it."""
        out = np.zeros(len(grams))
        hits, slow = self._found(grams)
        for d, which, place in hits:
            out[which] = self.scores_of[d][place]
        if len(slow):
            out[slow] = self._walk(grams[slow])
        return out

    def _walk(self, grams: np.ndarray) -> np.ndarray:
        """As :meth:`scores`, from the deepest node that each path has."""
        if self.nodes is None:
            place = _place(self.asked, grams)
            if (place < 0).any():
                raise ValueError("the model was not asked for these n-grams")
            return self.walked[place]
        unique, number = np.unique(grams, return_inverse=True)
        score = np.zeros(len(unique))
        for k in range(8):
            score += _walk_step([node[k] for node in self.nodes], unique, k)
        return score[number]


def _walk_step(nodes: list[tuple[np.ndarray, np.ndarray]], grams: np.ndarray, k: int) -> np.ndarray:
    """log10 probability of the bit behind ``k`` bits of each n-gram's last byte, from the deepest of ``nodes`` (keys and
    probabilities of a one, by depth) on its path."""
    byte = grams & np.uint64(255)
    prefix = np.uint64(1 << k) | (byte >> np.uint64(8 - k))
    one = np.full(len(grams), 0.5)
    left = np.arange(len(grams))
    for d in range(len(nodes) - 1, -1, -1):
        keys, ones = nodes[d]
        place = _place(keys, (grams[left] & _bytes_mask(d + 1) & ~np.uint64(255)) | prefix[left])
        hit = place >= 0
        one[left[hit]] = ones[place[hit]]
        left = left[~hit]
    return np.log10(np.where(_next_bits(grams, k) == 1, one, 1 - one))


def top(roots: list[tuple[np.ndarray, ...]], root: int) -> tuple[list, list]:
    """The nodes above the roots of all subtrees, as in ``Model.nodes``, and for each number of bits seen the roots' sorted
    keys, the probability of a one that the nodes above them give, and the weight left to the subtree.

    ``roots``: for each number of bits seen the sorted keys, zeros, ones and weighted logarithms at depth ``root``.
    """
    nodes: list[list] = [[] for _ in range(root)]
    entry = []
    for k in range(8):
        key, zeros, ones, total = roots[k]
        above = []
        for d in range(root - 1, -1, -1):
            upper, parent = np.unique(key & _bytes_mask(d + 1), return_inverse=True)
            zeros, ones, below = [np.bincount(parent, weights=x, minlength=len(upper)) for x in (zeros, ones, total)]
            own = _log_estimate(zeros, ones)
            above.append((upper, parent, (ones + 0.5) / (zeros + ones + 1), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))))
            key, total = upper, np.logaddexp(own, below) - math.log(2)
        mixed, remaining = np.zeros(len(key)), np.ones(len(key))
        for d, (upper, parent, here, weight) in enumerate(above[::-1]):
            mixed, remaining = mixed + remaining * weight * here, remaining * (1 - weight)
            nodes[d].append((upper, mixed + remaining * 0.5))
            mixed, remaining = mixed[parent], remaining[parent]
        entry.append((roots[k][0], mixed, remaining))
    return nodes, entry


def fit(counts: DataFrame, depth: int = DEPTH, grams: int = GRAMS) -> Model:
    """A bounded tree in memory from :func:`corpus_counts`. At most ``grams`` n-grams of each depth reach the driver.

    Of each depth, contexts are kept down to a count at which their n-grams would be more than ``grams``, found from
    sums by count in sixteenths of a power of two, and never below the least count of the depth before.
    The contexts it does not keep share one further child of their parent, so that no count is lost. :func:`score` needs
    no such bound.
    """
    found = counts.where("gram is not null").select("gram", "n")
    depths = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col("gram").bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1)).alias("g")) for d in range(depth + 1)]))
    followed = found.select("n", depths.alias("x")).groupBy("x.d", "x.g").agg(F.sum("n").alias("n"))
    contexts = followed.groupBy("d", F.shiftright("g", 8).alias("context")).agg(F.sum("n").alias("seen"), F.collect_list(F.struct("g", "n")).alias("next"))  # 256 at most
    contexts = saved(contexts.withColumn("size", F.floor(F.log2("seen") * 16).cast("int")), "contexts")
    least = [0] * (depth + 1)
    sizes = contexts.groupBy("d", "size").agg(F.sum(F.size("next")).alias("grams")).collect()  # a few hundred sizes a depth
    for d in range(depth + 1):
        total = 0
        for row in sorted((r for r in sizes if r.d == d), key=lambda r: -r["size"]):
            total += row.grams
            if total > grams:
                least[d] = row["size"] + 1
                break
        least[d] = max(least[d], least[d - 1] if d else 0)
    bound = F.array(*[F.lit(x) for x in least])
    rows = contexts.where(F.col("size") >= F.element_at(bound, F.col("d") + 1)).select("d", F.explode("next").alias("x")).select("d", "x.g", "x.n").toArrow()
    d, g, n = (rows.column(c).to_numpy() for c in ("d", "g", "n"))
    levels = []
    for k in range(depth + 1):
        here = np.flatnonzero(d == k)
        here = here[np.argsort(g[here], kind="stable")]
        levels.append((g[here].astype(np.uint64), n[here].astype(np.int64)))
    return Model(levels)


def most_frequent(vocabulary: DataFrame, most: int) -> DataFrame:
    """The words counted most often, ``most`` of them at most: all down to a count found from numbers of words by count,
    in sixteenths of a power of two, so nothing is sorted."""
    sized = vocabulary.withColumn("size", F.floor(F.log2("n") * 16).cast("int"))
    total, least = 0, 0
    for row in sorted(sized.groupBy("size").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["size"]):
        total += row.words
        if total > most:
            least = row["size"] + 1
            break
    return sized.where(F.col("size") >= least).drop("size")


CUT = "kind int, chunk long, bucket int, uid long, doc_ids array<long>, held array<boolean>, lengths array<long>, block binary, counts binary, word binary, n long"
TEXTS, GRAM_BLOCK, WORD = 0, 1, 2


def cut(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The documents (doc_id, held_out, text) in chunks, some megabytes of texts to a row, each chunk's distinct n-grams
    with their counts in its training documents, in blocks by group of subtrees, and the counts of training words."""
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    schema = pa.schema([(name, types[kind]) for name, kind in (part.split() for part in CUT.split(", "))])

    def batch_of(count: int, **columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = uid = TaskContext.get().partitionId() << 40
        words: Counter = Counter()
        grams, size = _GramCounts(), 0

        def blocks() -> pa.RecordBatch:
            keys, counts = grams.read()
            groups = _group(keys)
            order = np.argsort(groups, kind="stable")
            cuts = np.searchsorted(groups[order], np.arange(GROUPS + 1))
            used = [g for g in range(GROUPS) if cuts[g] < cuts[g + 1]]
            parts = [order[cuts[g] : cuts[g + 1]] for g in used]
            return batch_of(len(used), kind=[GRAM_BLOCK] * len(used), chunk=[chunk] * len(used), bucket=used, block=[_packed_grams(keys[p]) for p in parts], counts=[_packed(counts[p]) for p in parts])

        def counted() -> pa.RecordBatch:
            return batch_of(len(words), kind=[WORD] * len(words), word=list(words), n=list(words.values()))

        for batch in batches:
            for first, data, offsets in byte_slices(batch.column(2), SLICE_BYTES):
                count = len(offsets) - 1
                part = batch.slice(first, count)
                held = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                found, _ = _windows(data, offsets, depth)
                learned = np.repeat(~held, np.diff(offsets) + 1)
                grams.add(found[learned])
                grams.add(found[~learned], learned=False)
                size += len(found)
                lowered = LOWER[data].tobytes()
                cuts = offsets.tolist()
                for row in np.flatnonzero(~held).tolist():
                    words.update(lowered[cuts[row] : cuts[row + 1]].split())
                    words[END_WORD] += 1
                lists = {"doc_ids": [part.column(0).to_pylist()], "held": [held.tolist()], "lengths": [np.diff(offsets)]}
                yield batch_of(1, kind=[TEXTS], chunk=[chunk], bucket=[GROUPS], uid=[uid], block=[zlib.compress(data, 1)], **lists)
                uid += count
                if size >= CHUNK_BYTES:
                    yield blocks()
                    grams, size, chunk = _GramCounts(), 0, chunk + 1
                if len(words) > 250_000:
                    yield counted()
                    words = Counter()
        if size:
            yield blocks()
        yield counted()

    return saved(rows.select("doc_id", "held_out", "text").mapInArrow(run, CUT), "chunks", "zstd")


def _of_training(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    merged = _GramCounts()
    for block, seen in zip(table.column("block"), table.column("counts")):
        keys, counts = _unpacked_grams(block.as_py()), _unpacked(seen.as_py()).astype(np.int64)
        merged.put(keys[counts > 0], counts[counts > 0])
    return merged.read()


def _bucket_rows(table: pa.Table, schema: pa.Schema, **columns: list) -> pa.RecordBatch:
    bucket = [table.column("bucket")[0].as_py()]
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, bucket), f.type) for f in schema], schema=schema)


def subtrees(blocks: DataFrame, chunks: int, depth: int = DEPTH) -> DataFrame:
    """For each group of subtrees the training counts of all n-grams in it, as one block, and its root nodes.

    A group's blocks are merged in parts of some hundred chunks first, where there are more.
    """
    root = min(ROOT, depth)
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.binary()), ("counts", pa.binary())])
    rows = blocks.select("bucket", "chunk", "block", "counts")
    parts = -(-chunks // CHUNKS_A_TASK)
    if parts > 1:
        some = rows.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int"))

        def merge(table: pa.Table) -> pa.RecordBatch:
            grams, counts = _of_training(table)
            return _bucket_rows(table, schema, block=[_packed_grams(grams)], counts=[_packed(counts)])

        rows = grouped_in_arrow(some, ["bucket", "part"], [], merge, "bucket int, block binary, counts binary")

    out = pa.schema([*schema, ("roots", pa.list_(pa.binary()))])

    def weigh(table: pa.Table) -> pa.RecordBatch:
        grams, counts = _of_training(table)
        levels = _levels(grams, counts, depth, root)
        roots = [_Weighed(levels, root, k).root for k in range(8)]
        packed = [a.astype(kind).tobytes() for node in roots for a, kind in zip(node, ("<u8", "<i8", "<i8", "<f8"))]
        return _bucket_rows(table, out, block=[_packed_grams(grams)], counts=[_packed(counts)], roots=[packed])

    return saved(grouped_in_arrow(rows, ["bucket"], [], weigh, "bucket int, block binary, counts binary, roots array<binary>"), "subtrees")


def chunk_scores(blocks: DataFrame, trees: DataFrame, chunks: int, depth: int = DEPTH) -> DataFrame:
    """For each chunk and group of subtrees the log10 probabilities of the n-grams of its block, in their order."""
    root = min(ROOT, depth)
    found = trees.select("roots").collect()  # the nodes at depth two: 65,536 contexts at most
    roots = []
    for k in range(8):
        columns = [np.concatenate([np.zeros(0, kind), *[np.frombuffer(r.roots[4 * k + n], kind) for r in found]]) for n, kind in enumerate(("<u8", "<i8", "<i8", "<f8"))]
        order = np.argsort(columns[0])
        roots.append(tuple(c[order] for c in columns))
    above = blocks.sparkSession.sparkContext.broadcast(top(roots, root))
    parts = max(1, -(-chunks // CHUNKS_A_TASK))
    models = trees.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(-1).cast("long").alias("chunk"), "block", "counts")
    rows = blocks.select("bucket", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int").alias("part"), "chunk", "block").unionByName(models, allowMissingColumns=True)
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("block", pa.binary())])

    def judge(table: pa.Table) -> pa.RecordBatch | None:
        chunk, block = table.column("chunk").to_pylist(), table.column("block")
        if len(chunk) == 1:
            return None
        counts = _unpacked(table.column("counts")[0].as_py()).astype(np.int64)
        levels = _levels(_unpacked_grams(block[0].as_py()), counts, depth, root)
        model = Model(levels, root, above.value, asked=(_unpacked_grams(b.as_py()) for b in block.slice(1)))
        del levels, counts
        scores = [model.scores(_unpacked_grams(b.as_py())).astype("<f4").tobytes() for b in block.slice(1)]
        return pa.RecordBatch.from_arrays([pa.array(chunk[1:], pa.int64()), table.column("bucket").slice(1).combine_chunks(), pa.array(scores, pa.binary())], schema=schema)

    return grouped_in_arrow(rows, ["bucket", "part"], ["chunk"], judge, "chunk long, bucket int, block binary")


def score(docs: DataFrame, depth: int = DEPTH, hot_words: int = HOT_WORDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes.

    The model learns from the documents that are not held out and scores all: ``score`` is the log10 probability of the
    text's bytes and an end. ``base_score`` is that of an add-one unigram model over lower-cased words and an end.
    A null text is an empty text. Equal rows are documents of their own. Without training documents every bit has
    probability one half. Only the most frequent words, ``hot_words`` at most, are broadcast; counts of all others are joined.
    ``depth`` is 7 at most.
    """
    if not 0 <= depth <= 7:
        raise ValueError("depth must be 0 to 7: an n-gram is one 64-bit number")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    cuts = cut(rows, depth)
    vocabulary = saved(cuts.where(F.col("kind") == WORD).groupBy("word").agg(F.sum("n").alias("n")), "words", "zstd")
    totals = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    hot = most_frequent(vocabulary, hot_words).toArrow()
    known = dict(zip(hot.column("word").to_pylist(), np.log10(hot.column("n").to_numpy() + 1.0).tolist()))
    shared = spark.sparkContext.broadcast(known)  # bounded by hot_words
    blocks = cuts.where(F.col("kind") == GRAM_BLOCK)
    chunks = blocks.select("chunk").distinct().count()
    scores = chunk_scores(blocks, subtrees(blocks, chunks, depth), chunks, depth)
    columns = ["chunk", "bucket", "uid", "doc_ids", "held", "lengths", "block"]
    met = cuts.where(F.col("kind") == TEXTS).select(*columns).unionByName(scores, allowMissingColumns=True)
    fields = [("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_hot", pa.int64()), ("hot_sum", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))]

    def judge(table: pa.Table) -> pa.RecordBatch:
        weights = shared.value
        first = int((table.column("bucket").to_numpy() < GROUPS).sum())
        by_gram = np.concatenate([np.zeros(0, "<f4"), *[np.frombuffer(b.as_py(), "<f4") for b in table.column("block").slice(0, first)]])
        docs = table.slice(first).select(["uid", "doc_ids", "held", "lengths", "block"]).to_pylist()

        def slices() -> Iterator[tuple]:
            for row in docs:
                data = np.frombuffer(zlib.decompress(row["block"]), np.uint8)
                offsets = np.cumsum([0, *row["lengths"]])
                yield data, offsets, *_windows(data, offsets, depth)

        merged = _GramCounts()
        for _, _, found, _ in slices():
            merged.add(found, learned=False)
        grams = merged.read()[0]
        if len(grams) != len(by_gram):
            raise ValueError("a chunk's scores do not belong to its texts")
        score_of = np.empty(len(grams))
        score_of[np.argsort(_group(grams), kind="stable")] = by_gram
        scores, out = [], []
        for data, offsets, found, places in slices():
            keys, number = np.unique(found, return_inverse=True)
            scores.append(np.add.reduceat(score_of[np.searchsorted(grams, keys)][number], places))
            lowered = LOWER[data].tobytes()
            cuts = offsets.tolist()
            for a, b in zip(cuts, cuts[1:]):
                tokens = lowered[a:b].split()
                times = Counter(tokens)
                times[END_WORD] += 1
                rare, rare_times, hot, total = [], [], 0, 0.0
                for word, n in times.items():
                    weight = weights.get(word)
                    if weight is None:
                        rare.append(word)
                        rare_times.append(n)
                    else:
                        hot += n
                        total += weight * n
                out.append((len(tokens) + 1, hot, total, rare, rare_times))
        ids = [uid for row in docs for uid in range(row["uid"], row["uid"] + len(row["lengths"]))]
        given = [[x for row in docs for x in row[name]] for name in ("doc_ids", "held", "lengths")]
        columns = [ids, *given, *list(zip(*out))[:3], np.concatenate(scores), *list(zip(*out))[3:]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    schema = "uid long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_hot long, hot_sum double, score double, words array<binary>, times array<int>"
    scored = saved(grouped_in_arrow(met, ["chunk"], ["bucket"], judge, schema), "scored", "zstd")
    pairs = scored.select("uid", F.explode(F.arrays_zip("words", "times")).alias("p")).select("uid", F.col("p.words").alias("word"), F.col("p.times").alias("times"))
    rare = pairs.join(vocabulary, "word").groupBy("uid").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_sum"))
    size = math.log10(totals["n"] + totals["v"] + 1)
    joined = scored.drop("words", "times").join(rare, "uid", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"), F.lit(totals["n"]).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(size)).alias("base_score"), "score", "n_bytes",
        (-F.col("score") * F.lit(math.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
