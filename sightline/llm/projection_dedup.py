"""Near-duplicate embeddings by sorted projection passes.

Each pass orders the vectors lexicographically by the concatenated signs of random projections and compares every vector
with its next neighbours in that order. The links verified in all passes are united into components. Inside each
component, all pairs are then counted exactly, block by block.

The first passes follow from the number of vectors, the window and a target recall at the threshold, as if directions
were spread evenly. How crowded a vector's surroundings are is then measured in every pass, by the signs it shares with
the rows at its window's ends; its distances from the planes of those signs give the chance that a vector at the threshold,
in any direction from it, shares them too. Vectors that this leaves below the target recall go on to further passes, as many as there
were before, until none is left or ``QUIET`` rounds on end, each with as many passes as all before it, tie no two
components that were apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sightline.llm.common import block_pairs, components, grouped_in_arrow, local_roots, saved
from sightline.scale import SLICE, sliced

THRESHOLD, WINDOW, RECALL = 0.9, 512, 0.999
QUIET = 2
BITS = 62
PASSES_AT_ONCE = 16
SLICE_ROWS, BLOCK_ROWS = 4096, 512
CHUNK = 2048


def usable(embedding: Column) -> Column:
    """Whether a vector can link: not null, every component finite, not all zero."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & ~odd & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def choose_passes(count: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which a pair at the threshold has met with the target recall if directions are spread evenly: two
    vectors are near in a pass if the first log2(count / window) signs agree, each with probability 1 - angle / pi."""
    agree = _agreement(threshold) ** max(0.0, math.log2(max(1, count) / window))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(agree, 0.999))))


def _agreement(threshold: float) -> float:
    """The chance that the sign of a random projection is the same for two vectors at the threshold."""
    return 1 - math.acos(threshold) / math.pi


def _planes(dim: int, turn: int) -> np.ndarray:
    return np.random.default_rng([29, dim, turn]).standard_normal((dim, BITS))


def _keys(vectors: DataFrame, start: int, passes: int) -> DataFrame:
    """pass, key, node of ``vectors`` (node, dim, embedding) in the passes from ``start`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))[:, None]
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                vectors = unit(matrix(rows.column(2)))
                for first in range(start, start + passes, PASSES_AT_ONCE):
                    turns = np.arange(first, min(first + PASSES_AT_ONCE, start + passes), dtype=np.int32)
                    if (dim, first) not in planes:
                        planes[dim, first] = np.hstack([_planes(dim, t) for t in turns.tolist()])
                    signs = vectors @ planes[dim, first] > 0
                    keys = (signs.reshape(len(rows), len(turns), BITS) @ weights).reshape(-1)
                    node = np.repeat(rows.column(0).to_numpy(), len(turns))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), dim, dtype=np.int32)), pa.array(np.tile(turns, len(rows))), pa.array(keys), pa.array(node)],
                        names=["dim", "pass", "key", "node"],
                    )

    return vectors.select("node", "dim", "embedding").mapInArrow(run, "dim int, pass int, key long, node long")


def _shared_signs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of leading signs that keys have in common."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def _chances(vectors: np.ndarray, planes: np.ndarray, needed: np.ndarray, threshold: float) -> np.ndarray:
    """For each vector the chance that another at the threshold from it, in a random direction, has the same first
    ``needed`` signs: given its own projection z on a plane, the other's is normal about threshold * z."""
    z = np.abs(vectors @ planes) * (threshold / math.sqrt(max(1e-12, 1 - threshold * threshold)))
    z = np.minimum(z, 8.0)
    same = -np.log1p(np.exp(-1.5976 * z - 0.07056 * z**3))  # logarithm of the normal distribution function
    sums = np.hstack([np.zeros((len(vectors), 1)), np.cumsum(same, axis=1)])
    return np.exp(sums[np.arange(len(vectors)), needed])


def _windows(threshold: float, window: int):
    """Judges one slice of the order: links each vector to the least one it reaches inside the slice (a, b), and gives
    for the slice's own rows of each vector (a, dim) the logarithm of the chance that they all miss a pair at the threshold.

    A row compares with all rows that share more signs with it than the rows ``window`` places before and after do.
    """

    def judge(group: pa.Table) -> pa.RecordBatch | None:
        order = np.lexsort([group.column(c).to_numpy() for c in ("node", "key", "pass", "dim")])
        node, turn, dims, key = (group.column(c).to_numpy()[order] for c in ("node", "pass", "dim", "key"))
        own = group.column("own").to_numpy(zero_copy_only=False)[order]
        needed = np.zeros(len(node), dtype=np.int64)  # signs that have to agree; none where the order ends before the window
        together = (turn[:-window] == turn[window:]) & (dims[:-window] == dims[window:])
        at = np.flatnonzero(together)
        signs = np.minimum(BITS, _shared_signs(key[at], key[at + window]) + 1)
        needed[at] = signs
        needed[at + window] = np.maximum(needed[at + window], signs)
        a, b = [], []
        chance = np.ones(len(node))
        for dim in np.unique(dims).tolist():
            here = np.flatnonzero(dims == dim)
            vectors = unit(matrix(group.column("embedding").take(pa.array(order[here]))))
            for t in np.unique(turn[here]).tolist():
                mine = np.flatnonzero(turn[here] == t)
                chance[here[mine]] = _chances(vectors[mine], _planes(dim, t), needed[here[mine]], threshold)
            for first in range(0, len(here), BLOCK_ROWS):
                last = min(first + BLOCK_ROWS, len(here))
                row, place = np.nonzero(vectors[first:last] @ vectors[first : last + window].T >= threshold)
                row, place = here[first + row], here[first + place]
                # the window holds the rows of one pass up to ``window`` places further on
                near = (place > row) & (place - row <= window) & (turn[row] == turn[place])
                a.append(row[near])
                b.append(place[near])
        a, b = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (a, b))
        distinct, number = np.unique(node, return_inverse=True)
        root = distinct[local_roots(len(distinct), number[a], number[b])]
        some = root != distinct
        missed = np.log1p(-np.minimum(chance[own], 1 - 1e-9))
        pairs, place = np.unique(np.stack([node[own], dims[own].astype(np.int64)]), axis=1, return_inverse=True)
        missed = np.bincount(place.reshape(-1), weights=missed, minlength=pairs.shape[1])
        ties, rows = int(some.sum()), pairs.shape[1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([distinct[some], pairs[0]])), pa.concat_arrays([pa.array(root[some]), pa.nulls(rows, pa.int64())]),
                pa.concat_arrays([pa.nulls(ties, pa.int32()), pa.array(pairs[1].astype(np.int32))]), pa.concat_arrays([pa.nulls(ties, pa.float64()), pa.array(missed)]),
            ],
            names=["a", "b", "dim", "missed"],
        )

    return judge


def _round(vectors: DataFrame, count: int, start: int, passes: int, threshold: float, window: int) -> DataFrame:
    """Ties (a, b) and chances of a miss (a, dim, missed) of ``vectors`` from the passes ``start`` to ``start + passes``."""
    keys = _keys(vectors, start, passes)
    parts = max(1, math.ceil(count * passes / SLICE_ROWS))
    cut = sliced(keys, ["dim", "pass", "key", "node"], parts)
    rank = F.row_number().over(W.partitionBy(SLICE).orderBy("dim", "pass", "key", "node"))
    halo = cut.withColumn("rank", rank).withColumn(
        "slice", F.explode(F.when((F.col("rank") <= window) & (F.col(SLICE) > 0), F.array(F.col(SLICE), F.col(SLICE) - 1)).otherwise(F.array(F.col(SLICE))))
    )
    halo = halo.select("slice", "dim", "pass", "key", "node", (F.col("slice") == F.col(SLICE)).alias("own"))
    placed = halo.join(vectors.select("node", "embedding", F.col("dim").alias("d")), "node").where("dim = d").drop("d")
    return saved(grouped_in_arrow(placed, ["slice"], [], _windows(threshold, window), "a long, b long, dim int, missed double"), "ties")


def _candidates(classes: DataFrame, threshold: float, window: int, recall: float) -> DataFrame:
    """node, root: the connected sets of the links that the passes over ``classes`` (node, dim, embedding) find."""
    todo, left, start = classes.select("node", "dim", "embedding"), classes.count(), 0
    passes = choose_passes(left, threshold, window, recall)
    found, missed, quiet = None, None, 0
    while True:
        out = _round(todo, left, start, passes, threshold, window)
        ties = out.where("b is not null").select("a", "b")
        if found is not None:
            ties = ties.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        # each merge of two components takes one root away, each new node of a component adds one to the nodes
        before = found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("root").alias("r")).first() if found is not None else None
        found = saved(components(ties), "components")
        after = found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("root").alias("r")).first()
        chances = out.where("b is null").select(F.col("a").alias("node"), "dim", "missed")
        chances = chances if missed is None else chances.unionByName(missed)
        missed = saved(chances.groupBy("node", "dim").agg(F.sum("missed").alias("missed")).where(F.col("missed") > math.log(1 - recall)), "missed")
        left = missed.count()
        start, passes = start + passes, start + passes
        quiet = quiet + 1 if before == after else 0
        if left < 2 or quiet == QUIET:
            return found
        todo = saved(classes.select("node", "dim", "embedding").join(missed.select("node", "dim"), ["node", "dim"], "left_semi"), "todo")


def _counter(threshold: float):
    """Judges one pair of chunks of a component: the copies each node is linked to, and the least node it reaches."""

    def judge(group: pa.Table) -> pa.RecordBatch | None:
        first, node, copies = (group.column(c).to_numpy(zero_copy_only=False) for c in ("first", "node", "copies"))
        same = group.column("c1")[0].as_py() == group.column("c2")[0].as_py()
        left = np.flatnonzero(first)
        right = left if same else np.flatnonzero(~first)
        if not len(left) or not len(right) or (same and len(left) < 2):
            return None
        vectors = unit(matrix(group.column("embedding")))
        linked = vectors[left] @ vectors[right].T >= threshold
        if same:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(node), dtype=np.int64)
        links[left] += linked @ copies[right]
        if not same:
            links[right] += linked.T @ copies[left]
        if not links.any():
            return None
        i, j = np.nonzero(linked)
        ranked = np.argsort(node, kind="stable")
        position = np.empty(len(node), dtype=np.int64)
        position[ranked] = np.arange(len(node))
        root = node[ranked][local_roots(len(node), position[left[i]], position[right[j]])][position]
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(root[some])], names=["node", "links", "root"])

    return judge


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL, chunk: int = CHUNK
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared by cosine in double precision. Those that are null, empty, zero or hold a null or non-finite
    component link with nothing, and vectors of different lengths do not link. Equal vectors are one node that carries
    its number of copies, so a group of copies costs no comparisons. Rows without vec_id link with nothing; rows of one
    vec_id are one vector for links. ``kept`` is whether vec_id equals component_id.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.withColumn("usable", usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    classes = saved(
        rows.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("embedding")), "vectors"
    )
    found = _candidates(classes, threshold, window, recall).select("node", F.col("root").alias("cluster"))
    sized = found.join(found.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")), "cluster")
    # vectors of several lengths can meet in a component only through a repeated vec_id
    members = sized.join(classes, "node").select((F.col("cluster") * 1).alias("cluster"), F.col("dim").cast("long").alias("dim"), "members", "node", "copies", "embedding")
    pairs = block_pairs(members, "cluster", "node", "members", chunk)
    judged = saved(grouped_in_arrow(pairs, ["cluster", "dim", "c1", "c2"], [], _counter(threshold), "node long, links long, root long"), "links")
    links = judged.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select(F.col("embedding").alias("vector"), "node", "copies").join(links, "node", "left").join(found, "node", "left")
    named = named.select("vector", F.coalesce("cluster", "node").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    matched = rows.join(named, F.when(F.col("usable"), F.col("embedding")) == F.col("vector"), "left")
    component = F.coalesce("component", "vec_id")
    return matched.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
