"""N-gram Jaccard self-join by MinHash banding.

Every document gets a MinHash signature over its word n-grams, cut into bands. Rows are shuffled on band hashes;
documents that share a band hash are tied to the least document of that bucket, which needs one link a row, not one a
pair. The connected sets of these ties are the candidate sets. Inside each, all pairs are verified on their full n-gram
sets, block by block, so a set of any size is spread over tasks of bounded size and only counts and one link to a block's
least document leave a task. Documents with equal n-gram sets are one node that carries its number of copies.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import block_pairs, byte_slices, components, grouped_in_arrow, local_roots, mixed_bits, saved, word_hashes

WORDS, THRESHOLD = 5, 0.8
RECALL, MOST_HASHES = 0.9999, 288
CHUNK = 1024
COLUMNS_AT_ONCE = 4096


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest rows for which ``most`` hashes find a pair at the threshold with the target recall."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _ngrams(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each row. A text of fewer words is one n-gram of all of them."""
    hashes, _, _, firsts = word_hashes(data, offsets)
    odd = mixed_bits(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    count = max(0, len(hashes) - words + 1)
    grams = np.zeros(count, dtype=np.uint64)
    for k in range(words):
        grams += hashes[k : k + count] * odd[k]
    grams = mixed_bits(grams)
    rows = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= words:
            rows.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            short = (hashes[a:b] * odd[: b - a]).sum(dtype=np.uint64)
            rows.append(mixed_bits(np.array([short + np.uint64(b - a)], dtype=np.uint64)))
        else:
            rows.append(np.zeros(0, dtype=np.uint64))
    return rows


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, digest of the n-gram set (null for a text without words), band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mixed_bits(np.arange(11, 11 + 2 * bands * rows, dtype=np.uint64)).astype(np.uint32)
        factors, shifts = (seeds[0::2] | np.uint32(1))[:, None], seeds[1::2][:, None]
        odd = mixed_bits(np.arange(7000, 7000 + rows, dtype=np.uint64)) | np.uint64(1)
        salt = mixed_bits(np.arange(9000, 9000 + bands, dtype=np.uint64))
        for batch in batches:
            digests: list[bytes | None] = []
            found: list[np.ndarray | None] = []
            for _, data, offsets in byte_slices(batch.column(1)):
                for grams in _ngrams(data, offsets, words):
                    if not len(grams):
                        digests.append(None)
                        found.append(None)
                        continue
                    digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                    low = (grams >> np.uint64(32)).astype(np.uint32)
                    least = np.full(bands * rows, 0xFFFFFFFF, dtype=np.uint32)
                    for k in range(0, len(low), 2048):
                        np.minimum(least, (low[k : k + 2048] * factors + shifts).min(axis=1), out=least)
                    sums = (least.astype(np.uint64).reshape(bands, rows) * odd).sum(axis=1, dtype=np.uint64)
                    found.append(mixed_bits(sums ^ salt).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "digest", "bands"]
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, digest binary, bands array<long>")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """cluster, members, node, copies, grams (the full n-gram set as 64-bit hashes) of rows with those and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for first, data, offsets in byte_slices(batch.column(4)):
                sets = [g.tobytes() for g in _ngrams(data, offsets, words)]
                part = batch.slice(first, len(sets))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sets, pa.binary())], names=["cluster", "members", "node", "copies", "grams"])
                at += len(sets)

    return rows.select("cluster", "members", "node", "copies", "text").mapInArrow(run, "cluster long, members long, node long, copies long, grams binary")


def _verifier(threshold: float):
    """Judges one pair of chunks: for each node the copies it is linked to, and a link to the least node it reaches."""
    exact = Fraction(str(threshold)).limit_denominator(1_000_000)
    p, q = exact.numerator, exact.denominator

    def judge(group: pa.Table) -> pa.RecordBatch | None:
        first = group.column("first").to_numpy()
        node = group.column("node").to_numpy()
        copies = group.column("copies").to_numpy()
        sets = [np.frombuffer(g, dtype=np.uint64) for g in group.column("grams").to_pylist()]
        same = group.column("c1")[0].as_py() == group.column("c2")[0].as_py()
        sizes = np.array([len(s) for s in sets])
        left = np.flatnonzero(first)
        right = left if same else np.flatnonzero(~first)
        if not len(left) or not len(right) or (same and len(left) < 2):
            return None
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(column, minlength=len(values)) > 1  # an n-gram of one document meets nothing
        number = np.cumsum(shared) - 1
        keep = shared[column]
        row, column = row[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(left), len(right)))  # whole numbers, exact to 2^53
        place = np.empty(len(sets), dtype=np.int64)
        for start in range(0, int(shared.sum()), COLUMNS_AT_ONCE):
            a, b = np.searchsorted(column, [start, start + COLUMNS_AT_ONCE])
            present = np.zeros((len(sets), min(COLUMNS_AT_ONCE, int(shared.sum()) - start)), dtype=np.float32)
            present[row[a:b], column[a:b] - start] = 1
            common += present[left] @ present[right].T
        del place
        total = sizes[left][:, None] + sizes[right][None, :]
        # inter / (total - inter) >= p / q in whole numbers, so a pair at the threshold itself is linked
        linked = common * (p + q) >= p * total
        if same:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(sets), dtype=np.int64)
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


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, class_id, copy_of, n_links, kept.

    Two documents are linked if the Jaccard similarity of their word n-gram sets is at least ``threshold``. Words are
    runs of non-space characters, A-Z lower-cased. ``n_links`` counts the other documents linked directly, equal sets
    included; ``class_id`` is the least doc_id reachable over links, ``copy_of`` the least of those with an equal set,
    and ``kept`` marks the one document of its class that stays. A null or blank text has no n-grams and links with
    nothing. Rows of one doc_id are one document; rows without doc_id link with nothing, have null ids and are kept.
    """
    bands, rows = choose_bands(threshold, recall)
    signed = saved(signatures(docs, words, bands, rows), "signatures")
    known = signed.where("digest is not null and doc_id is not null")
    classes = saved(known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "classes")
    rows_of = classes.select("node", F.explode("bands").alias("bucket"))
    least = rows_of.groupBy("bucket").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ties = rows_of.join(least, "bucket").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    clusters = saved(components(ties).select("node", F.col("root").alias("cluster")), "clusters")
    sized = clusters.join(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")), "cluster")
    # a doc_id with several texts has several sets; each of them is compared
    nodes = sized.join(classes.groupBy("node").agg(F.sum("copies").alias("copies")), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("text_id"), F.col("text").cast("string").alias("text"))
    sets = _sets(texts.join(nodes, F.col("text_id") == F.col("node")), words).where("length(grams) > 0").distinct()
    judged = grouped_in_arrow(
        block_pairs(sets, "cluster", "node", "members", chunk), ["cluster", "c1", "c2"], ["first", "node"], _verifier(threshold), "node long, links long, root long"
    )
    judged = saved(judged, "verified")
    roots = components(judged.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = judged.groupBy("node").agg(F.sum("links").alias("links"))
    judged_classes = (
        classes.select("digest", "node", "copies").join(links, "node", "left").join(roots, "node", "left")
        .select("digest", F.col("node").alias("copy_of"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("class_id"))
    )
    matched = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(judged_classes, "digest", "left")
    return matched.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def deduplicated(docs: DataFrame, **options: float) -> DataFrame:
    """``docs`` with one document of each class. Columns are those of ``docs``, whatever their names.

    A document is a doc_id with its text. Different texts under one doc_id are judged each on its own, so a copy of one
    elsewhere does not take the other along; of rows alike in both the one with the least hash of all columns stays. Rows
    without doc_id all stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.md5(text).alias("content"), F.struct(*docs.columns).alias("row"))
    known = rows.where("id is not null")
    several = known.groupBy("id").agg(F.min("content").alias("first"), F.max("content").alias("last")).where("first != last").select(F.col("id").alias("shared_id"), "first")
    rows = known.join(several, F.col("id") == F.col("shared_id"), "left")
    # a further text under one id gets a number of its own, above all ids, so it never stands for others
    own = F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64("id", "content"), 2))
    rows = rows.select(F.when(F.col("first").isNull() | (F.col("content") == F.col("first")), F.col("id")).otherwise(own).alias("node"), "row")
    rows = saved(rows, "texts")
    gone = join(rows.select(F.col("node").alias("doc_id"), F.col("row.text").alias("text")), **options).where("not kept")
    stay = rows.join(gone.select(F.col("doc_id").alias("node")).distinct(), "node", "left_anti")
    stay = stay.groupBy("node").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return stay.select("row.*").unionByName(docs.where(F.col("doc_id").cast("long").isNull()))
