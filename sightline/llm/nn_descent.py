"""Approximate nearest neighbours by NN-descent and greedy graph search.

The neighbour graph starts from comparisons inside slices of a few sorted projection orders and is improved by rounds of
Spark joins in which the neighbours of a node (forward and reverse) are introduced to each other, until few lists
change. Vectors are cut into bands of norms no more than a factor ``BAND`` apart, each with a graph of its own, so vectors of
any length leave the others' graph as it is. Inside a band, largest inner products are turned into nearest directions by
one further component, sqrt(M^2 - |x|^2) with M the band's largest norm. A query walks its own band's graph greedily from
its own node and every other band's from the nodes it meets as a guest in that band's slices. Final scores are inner
products of the original vectors. Equal vectors are one node that lists its smallest ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sightline.llm.common import grouped_in_arrow, saved
from sightline.llm.projection_dedup import BITS, matrix, unit, usable
from sightline.scale import SLICE, sliced

NEIGHBOURS = 32
SAMPLE = 16
ORDERS, ORDERS_ROWS = 12, 1 << 16  # one order more for every doubling beyond so many nodes
SLICE_ROWS, BLOCK_ROWS = 4096, 1024
ENOUGH = 0.02
BEAM = 48
BAND = 4.0


def _floats(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of half-precision numbers kept as bytes, in single precision."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype=np.float16).reshape(len(parts), -1).astype(np.float32)


def _banded(nodes: DataFrame) -> DataFrame:
    """``nodes`` (embedding, dim) with norm, band and most, the largest norm of the band among vectors of that length.

    Norms are taken of vectors divided by their largest component, so none overflows or vanishes; ``norm`` and ``most``
    are logarithms.
    """
    top = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    scaled = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x / F.col("top")) * (x / F.col("top")), lambda a: F.log(a) / 2)
    sized = nodes.withColumn("top", top).withColumn("norm", F.log("top") + scaled).drop("top")
    longest = sized.groupBy("dim").agg(F.max("norm").alias("longest"))
    # a hair's breadth more, so that vectors of one norm share a band whatever their rounding
    band = F.floor((F.col("longest") - F.col("norm")) / F.lit(math.log(BAND)) + 1e-9).cast("int")
    banded = sized.join(longest, "dim").withColumn("band", band).drop("longest")
    return banded.join(banded.groupBy("dim", "band").agg(F.max("norm").alias("most")), ["dim", "band"])


def _directions(vectors: DataFrame) -> DataFrame:
    """node, dim, band, direction: the vector over its band's largest norm and the further component, as half-precision bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                x = unit(matrix(rows.column(3))) * np.exp(rows.column(4).to_numpy() - rows.column(5).to_numpy())[:, None]
                further = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))
                packed = np.hstack([x, further]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array([p.tobytes() for p in packed], pa.binary())], names=["node", "dim", "band", "direction"])

    return vectors.select("node", "dim", "band", "embedding", "norm", "most").mapInArrow(run, "node long, dim int, band int, direction binary")


def _orders(directions: DataFrame, orders: int) -> DataFrame:
    """dim, band, turn, key, node, guest: each direction's place in each of the projection orders of a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))[:, None]
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                planes = np.random.default_rng([31, dim]).standard_normal((dim, orders * BITS)).astype(np.float32)
                # signs of the vector itself, so nodes of one direction meet whatever their norms
                signs = _floats(rows.column(3))[:, :dim] @ planes > 0
                keys = (signs.reshape(len(rows), orders, BITS) @ weights).reshape(-1)
                node, band, guest = (pa.array(np.repeat(rows.column(c).to_numpy(), orders)) for c in (0, 2, 4))
                turn = pa.array(np.tile(np.arange(orders, dtype=np.int32), len(rows)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), dim, dtype=np.int32)), band, turn, pa.array(keys), node, guest], names=["dim", "band", "turn", "key", "node", "guest"]
                )

    return directions.select("node", "dim", "band", "direction", "guest").mapInArrow(run, "dim int, band int, turn int, key long, node long, guest int")


def _best(similar: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``count`` largest entries of each row, -inf left out."""
    count = min(count, similar.shape[1])
    column = np.argpartition(-similar, count - 1, axis=1)[:, :count]
    row = np.repeat(np.arange(len(similar)), count)
    column = column.reshape(-1)
    real = np.isfinite(similar[row, column])
    return row[real], column[real]


def _slice_neighbours(count: int):
    """Judges one slice of the orders: the nearest of the same band for every node, and the nodes of largest inner product
    for every guest."""

    def judge(group: pa.Table) -> pa.RecordBatch | None:
        node, dims, bands, guest = (group.column(c).to_numpy() for c in ("node", "dim", "band", "guest"))
        found = []
        for dim, band in np.unique(np.stack([dims, bands]), axis=1).T.tolist():
            here = np.flatnonzero((dims == dim) & (bands == band))
            home, visiting = here[guest[here] == 0], here[guest[here] == 1]
            home, visiting = (part[np.unique(node[part], return_index=True)[1]] for part in (home, visiting))
            if not len(home):
                continue
            x = _floats(group.column("direction").take(pa.array(home)))
            for start in range(0, len(home) if len(home) > 1 else 0, BLOCK_ROWS):
                similar = x[start : start + BLOCK_ROWS] @ x.T
                similar[np.arange(len(similar)), start + np.arange(len(similar))] = -np.inf
                row, column = _best(similar, count)
                found.append((node[home[start + row]], node[home[column]], similar[row, column], np.zeros(len(row), np.int32)))
            for start in range(0, len(visiting), BLOCK_ROWS):
                some = visiting[start : start + BLOCK_ROWS]
                similar = _floats(group.column("direction").take(pa.array(some)))[:, :-1] @ x[:, :-1].T
                row, column = _best(similar, count)
                found.append((node[some[row]], node[home[column]], similar[row, column], np.ones(len(row), np.int32)))
        if not found:
            return None
        u, v, s, guest = (np.concatenate(c) for c in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s.astype(np.float32)), pa.array(guest)], names=["u", "v", "s", "guest"])

    return judge


def _introductions(count: int):
    """Judges the neighbours of one node: proposes to each the nearest of the others, if nearer than its worst so far.
    Two neighbours that were both there in the round before have met already."""

    def judge(group: pa.Table) -> pa.RecordBatch | None:
        node, fresh = group.column("v").to_numpy(), group.column("fresh").to_numpy(zero_copy_only=False)
        worst = group.column("worst").to_numpy()
        node, one = np.unique(node, return_index=True)
        fresh, worst = fresh[one], worst[one]
        if len(node) < 2 or not fresh.any():
            return None
        x = _floats(group.column("direction").take(pa.array(one)))
        similar = x @ x.T
        np.fill_diagonal(similar, -np.inf)
        similar[~(fresh[:, None] | fresh[None, :])] = -np.inf
        similar[similar <= worst[:, None]] = -np.inf
        row, column = _best(similar, count)
        if not len(row):
            return None
        return pa.RecordBatch.from_arrays([pa.array(node[row]), pa.array(node[column]), pa.array(similar[row, column].astype(np.float32))], names=["u", "v", "s"])

    return judge


def _top(rows: DataFrame, key: str | list[str], order: list, count: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= count)


def neighbour_graph(directions: DataFrame, guests: DataFrame, neighbours: int = NEIGHBOURS, sample: int = SAMPLE, orders: int | None = None) -> tuple[DataFrame, DataFrame]:
    """u, v, s, rank: the nearest ``neighbours`` found for every node in its band; and q, v: the nodes that ``guests``
    (node, band: a band they visit) meet there.

    Rounds go on until one changes few of the lists; lists only ever improve, so there is a last round.
    """
    count = directions.count()
    placed = directions.withColumn("guest", F.lit(0)).unionByName(
        guests.join(directions.drop("band"), "node").select("node", "dim", "band", "direction").withColumn("guest", F.lit(1))
    )
    if orders is None:
        orders = ORDERS + max(0, math.ceil(math.log2(max(1, count) / ORDERS_ROWS)))
    parts = max(1, math.ceil((count + guests.count()) * orders / SLICE_ROWS))
    cut = sliced(_orders(placed, orders), ["dim", "band", "turn", "key", "node", "guest"], parts)
    met = cut.select(F.col(SLICE).cast("long").alias("slice"), "node", "band", "guest").join(directions.drop("band"), "node")
    first = saved(grouped_in_arrow(met, ["slice"], [], _slice_neighbours(neighbours // 2), "u long, v long, s float, guest int"), "slices")
    visits = first.where("guest = 1").select(F.col("u").alias("q"), "v").distinct()
    nearest = [F.col("s").desc(), F.col("v")]
    graph = first.where("guest = 0").groupBy("u", "v").agg(F.max("s").alias("s"))
    graph = saved(_top(graph, "u", nearest, neighbours).withColumn("fresh", F.lit(True)), "graph")
    while True:
        lists = graph.where(F.col("rank") <= sample).select("u", "v", "s", "fresh")
        back = _top(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s", "fresh"), "u", nearest, sample).select("u", "v", "s", "fresh")
        worst = graph.groupBy("u").agg(F.min("s").alias("least"), F.count(F.lit(1)).alias("n"))
        worst = worst.select(F.col("u").alias("v"), F.when(F.col("n") >= neighbours, F.col("least")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        met = lists.unionByName(back).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
        met = met.join(worst, "v").join(directions.select(F.col("node").alias("v"), "direction"), "v")
        proposed = grouped_in_arrow(met, ["u"], [], _introductions(neighbours // 2), "u long, v long, s float")
        known = graph.select("u", "v", "s", F.lit(False).alias("fresh"))
        merged = known.unionByName(proposed.withColumn("fresh", F.lit(True))).groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
        graph = saved(_top(merged, "u", nearest, neighbours), "graph")
        if graph.where("fresh").count() <= ENOUGH * neighbours * count:
            break
    return graph.select("u", "v", "s", "rank"), visits


def _products() -> object:
    """Inner products of queries and nodes: without the further component, which only nodes have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = pc.binary_length(batch.column(2)).to_numpy()
            s = np.zeros(batch.num_rows, dtype=np.float32)
            for dim in np.unique(dims).tolist():
                here = pa.array(np.flatnonzero(dims == dim))
                asked, met = (_floats(batch.column(k).take(here)) for k in (2, 3))
                s[here.to_numpy()] = (asked[:, :-1] * met[:, :-1]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s.astype(np.float32)), batch.column(4)], names=["q", "v", "s", "band"])

    return run


def walk(graph: DataFrame, directions: DataFrame, queries: DataFrame, visits: DataFrame, entries: list[int], beam: int = BEAM) -> DataFrame:
    """q, v, s: the ``beam`` nearest nodes of each band that a greedy walk finds for each query.

    A walk starts from the neighbours of the query's own node, the nodes that it met as a guest (``visits``) and, where
    norms differ, the ``entries``. In each step every node of the beam that was not expanded yet offers its neighbours,
    forward and reverse; the walk ends when no new node enters any beam, as it must: a beam only improves.
    """
    nearest = [F.col("s").desc(), F.col("v")]
    back = _top(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s"), "u", nearest, NEIGHBOURS)
    links = saved(graph.select("u", "v").unionByName(back.select("u", "v")).distinct().select(F.col("u").alias("from"), F.col("v").alias("to")), "links")
    asked = directions.join(queries.select(F.col("q").alias("node")), "node").select(F.col("node").alias("q"), F.col("direction").alias("asked"))

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(asked, "q").join(directions.select(F.col("node").alias("v"), "band", "direction"), "v").where("length(asked) = length(direction)")
        both = both.select("q", "v", "asked", "direction", "band")
        return both.mapInArrow(_products(), "q long, v long, s float, band int").withColumn("done", F.lit(False))

    columns = ["q", "v", "s", "band", "done"]
    starts = graph.join(queries, F.col("u") == F.col("q")).where(F.col("rank") <= beam).select("q", "v").unionByName(visits.where("q != v"))
    if entries:
        starts = starts.unionByName(queries.select("q", F.explode(F.array(*map(F.lit, entries))).alias("v")).where("q != v"))
    beams = saved(_top(scored(starts.distinct()), ["q", "band"], nearest, beam).select(*columns), "beams")
    while True:
        offered = beams.where("not done").join(links, F.col("v") == F.col("from")).select("q", F.col("to").alias("v")).where("q != v").distinct()
        new = offered.join(beams.select("q", "v"), ["q", "v"], "left_anti")
        every = beams.withColumn("done", F.lit(True)).unionByName(scored(new).select(*columns))
        beams = saved(_top(every, ["q", "band"], nearest, beam).select(*columns), "beams")
        if not beams.where("not done").limit(1).count():
            return beams.select("q", "v", "s")


def _exact() -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(batch.column(2).offsets.to_numpy())
            s = np.zeros(batch.num_rows)
            for dim in np.unique(dims).tolist():
                here = np.flatnonzero(dims == dim)
                a, b = (matrix(batch.column(k).take(pa.array(here))) for k in (2, 3))
                s[here] = (a * b).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["q", "v", "score"])

    return run


def search(embeddings: DataFrame, every: int = 20, count: int = 20, **options: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``count`` vectors of largest inner product found for each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all other rows. Ties go to the smaller
    vec_id. Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows without
    vec_id; vectors of other lengths are no candidates. Fewer candidates give fewer rows. Work grows with the number of norm
    bands, one for every factor ``BAND`` between the longest and the shortest vector that some vector lies in.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    # a node needs its smallest ids only: no answer is longer than count, and one id may be the query's own
    least = rows.withColumn("rank", F.dense_rank().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("rank") <= count + 1)
    nodes = least.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    nodes = saved(nodes.withColumn("dim", F.size("embedding")), "nodes")
    banded = saved(_banded(nodes), "banded")
    norms = banded.agg(F.max("norm").alias("most"), F.min("norm").alias("least")).first()
    entries = []
    if norms["most"] is not None and norms["least"] < norms["most"] + math.log(0.99):
        entries = [r.node for r in banded.orderBy(F.col("norm").desc(), "node").limit(BEAM).select("node").collect()]
    directions = saved(_directions(banded), "directions")
    asking = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    asking = saved(asking.join(nodes.select("embedding", F.col("node").alias("q")), F.col("vector") == F.col("embedding")).select("query_id", "q"), "queries")
    queries = saved(asking.select("q").distinct(), "queries")
    # a query visits every other band of its length; one band, no guests
    bands = directions.select("dim", F.col("band").alias("other")).distinct()
    own = queries.join(directions.select(F.col("node").alias("q"), "dim", "band"), "q")
    guests = saved(own.join(bands, "dim").where("other != band").select(F.col("q").alias("node"), F.col("other").alias("band")), "guests")
    graph, visits = neighbour_graph(directions, guests, **options)
    found = walk(graph, directions, queries, visits, entries)
    found = found.select("q", "v").unionByName(asking.select("q", F.col("q").alias("v")).distinct())
    left = nodes.select(F.col("node").alias("q"), F.col("embedding").alias("a"))
    right = nodes.select(F.col("node").alias("v"), F.col("embedding").alias("b"))
    exact = found.join(left, "q").join(right, "v").select("q", "v", "a", "b").mapInArrow(_exact(), "q long, v long, score double")
    # nodes beyond the best count of them cannot matter: each holds at least one id besides the query's own
    kept = _top(exact, "q", [F.col("score").desc(), F.col("v")], count + 1).drop("rank")
    listed = kept.join(nodes.select(F.col("node").alias("v"), "ids"), "v").select("q", "score", F.explode("ids").alias("vec_id"))
    answers = asking.join(listed, "q").where("query_id != vec_id")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")
