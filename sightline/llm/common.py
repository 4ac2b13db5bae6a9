"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import checkpoint_root

#: A word is a run of characters other than these six; both forms name the same set.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the checkpoint folder, which the driver and all executors share."""
    return f"{checkpoint_root(spark)}/{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame, kind: str = "table", compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: the lineage ends there."""
    folder = shared_folder(df.sparkSession, kind)
    df.write.parquet(folder, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drawn(rows: DataFrame, key: str, seed: str, most: int) -> DataFrame:
    """A repeatable sample of ``most`` rows at most: those with the smallest hashes of ``key``.

    Rows beyond twice the share that is wanted drop out where they are read, so few rows meet to be sorted.
    """
    count = rows.count()
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 1) / F.lit(float(1 << 63))
    share = min(1.0, 2.0 * most / max(1, count) + 1e-12) if count > 4 * most else 1.0
    return rows.withColumn("__place", place).where(F.col("__place") <= share).orderBy("__place", key).limit(most).drop("__place")


def utf8(text: str | Column) -> Column:
    """UTF-8 bytes of a text; a null text has none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).cast("binary")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, root), root the smallest node reachable.

    Alternates the large-star and small-star steps until the links no longer change. Minima are pre-aggregated,
    written and joined back, so no neighbour list is ever gathered in one place and Spark can split the rows of a hub in
    both joins; the number of rounds grows with the logarithm of the longest chain. Self links and repeated links are
    harmless; no links give no rows.
    """
    links = saved(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v"))
        large = saved(large.distinct(), "large")
        smallest = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(smallest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = saved(smallest.select("u", F.col("m").alias("v")).unionByName(small).distinct(), "links")
        now = links.agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("d"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == state or now["n"] == 0:
            break
        state = now
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )


def block_pairs(nodes: DataFrame, cluster: str, node: str, size: str, chunk: int) -> DataFrame:
    """Rows of ``nodes`` for every pair of chunks of their cluster in which they take part.

    A cluster of ``size`` nodes is cut into chunks of about ``chunk`` by a hash of the node; the columns ``c1 <= c2``
    name a pair of chunks and ``first`` tells whether the row lies in ``c1``. Each two nodes of a cluster meet in
    exactly one pair of chunks, and a group of rows with equal (cluster, c1, c2) has about two chunks at most.
    """
    chunks = F.ceil(F.col(size) / F.lit(chunk)).cast("int")
    rows = nodes.withColumn("chunk", F.pmod(F.xxhash64(node), chunks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return rows.select(
        F.col(cluster), F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"),
        (F.col("chunk") <= F.col("other")).alias("first"), *[c for c in nodes.columns if c != cluster],
    )


def in_groups(judge: Callable[[pa.Table], pa.RecordBatch | None], keys: int) -> Callable:
    """A function for ``mapInArrow`` over rows sorted by their first ``keys`` integer columns: calls ``judge`` with the
    rows of one group at a time, so a task holds one group and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
            changed = np.zeros(batch.num_rows - 1, dtype=bool)
            for c in columns:
                changed |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                now = tuple(c[start] for c in columns)
                if held and now != key:
                    out = judge(pa.Table.from_batches(held))
                    held = []
                    if out is not None:
                        yield out
                key = now
                held.append(batch.slice(start, stop - start))
        if held:
            out = judge(pa.Table.from_batches(held))
            if out is not None:
                yield out

    return run


def grouped_in_arrow(rows: DataFrame, keys: list[str], order: list[str], judge: Callable, schema: str) -> DataFrame:
    """``judge`` applied to each group of rows with equal ``keys`` (integers, not null), in ``order`` inside a group."""
    columns = [*keys, *[c for c in rows.columns if c not in keys]]
    # a stated number of partitions: few bytes can be much work, so tasks are not to be merged by size
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*columns).repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(in_groups(judge, len(keys)), schema)


def local_roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to ``count``, the smallest node reachable over the links ``a``-``b``."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if np.array_equal(after, root):
            return root
        root = after


def byte_slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The UTF-8 bytes of a string column in runs of rows of about ``most`` bytes (one row may be longer).

    Yields the first row, the bytes of the run and the rows' offsets into them; nulls are empty.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        stop = min(stop, len(texts))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(33))) * MIX_1
    x = (x ^ (x >> np.uint64(33))) * MIX_2
    return x ^ (x >> np.uint64(33))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < count:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(count, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows of one :func:`byte_slices` run, A-Z lower-cased: their 64-bit hashes, starts and ends, and the
    place of each row's first word (one more entry than rows). The hash is polynomial over the bytes, then mixed."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    space = IS_SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    up, down = _powers(max(len(data) + 1, 1 << 21))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed_bits((sums[ends] - sums[starts]) * down[starts]), starts, ends, np.searchsorted(starts, offsets)
