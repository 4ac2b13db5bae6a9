"""Order-preserving packing of token streams into fixed windows by dynamic programming.

The documents of a partition form one token stream in their order. Windows are cut at document ends (free), sentence
ends (a small penalty) or, where neither is near, at forced places (a larger one), minimising padding plus penalties.
With g(j) = cost of the best cut ending at j plus its position, g(j) = penalty(j) + capacity + min g(i) over the cuts i
at most one capacity before j: a sliding minimum kept in a monotone queue, a constant number of steps per cut.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

CAPACITY = 2048
END_ID = 1
SENTENCE_PENALTY, FORCED_PENALTY = 8, 48
FORCED_PARTS = 16  # forced cuts lie a sixteenth of the capacity apart
CACHE_ENTRIES = 300_000


class Encoder:
    """Ids of the byte-level vocabulary, equal to those of the tokenizers library.

    A space between two non-space characters always starts a new pre-token, so such texts are encoded word by word
    through a bounded cache with the rank file of the same vocabulary; texts with other white space, or with the
    special token's string, go whole to the plain encoders.
    """

    SPECIAL = "<|endoftext|>"
    ODD_SPACE = re.compile(r"\s | \s|\A | \Z")

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        with open(ranks, "rb") as lines:
            pairs = [line.split() for line in lines]
        merges = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.plain = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.vocabulary, self.tokenizer, self.cache = vocabulary, None, {}
        self.sentence_end = np.zeros(max(merges.values()) + 2, dtype=bool)
        for token, rank in merges.items():
            self.sentence_end[rank] = token[-1:] in (b".", b"!", b"?", b"\n")

    def encode(self, text: str) -> np.ndarray:
        if self.SPECIAL in text:
            if self.tokenizer is None:
                self.tokenizer = Tokenizer.from_file(self.vocabulary)
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if not text or self.ODD_SPACE.search(text):
            return np.array(self.plain.encode_ordinary(text), dtype="<u4")
        words = text.split(" ")
        cache, encode = self.cache, self.plain.encode_ordinary
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        parts = [np.array(encode(words[0]), dtype="<u4").tobytes()]
        for word in words[1:]:
            ids = cache.get(word)
            if ids is None:
                ids = np.array(encode(" " + word), dtype="<u4").tobytes()
                if len(word) < 64:
                    cache[word] = ids
            parts.append(ids)
        return np.frombuffer(b"".join(parts), dtype="<u4")


class Packer:
    """The dynamic programme over one stream; finished windows leave as soon as all live paths agree on them."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.step = capacity, max(1, capacity // FORCED_PARTS)
        self.places, self.costs, self.parents = [0], [0], [-1]
        self.queue: deque[int] = deque([0])
        self.docs: deque[tuple] = deque()  # (first place, ids, doc_id)
        self.end, self.sequence = 0, 0

    def feed(self, doc_id: int | None, ids: np.ndarray, sentence_ends: np.ndarray) -> None:
        base, count = self.end, len(ids)
        self.docs.append((base, ids, doc_id))
        cuts = sentence_ends.tolist()
        cuts.append(count)
        before, last = 0, len(cuts) - 1
        for k, cut in enumerate(cuts):
            while cut - before > self.step:
                before += self.step
                self._cut(base + before, FORCED_PENALTY)
            if cut > before:
                self._cut(base + cut, 0 if k == last else SENTENCE_PENALTY)
                before = cut
        self.end += count

    def _cut(self, place: int, penalty: int) -> None:
        places, costs, queue = self.places, self.costs, self.queue
        while place - places[queue[0]] > self.capacity:
            queue.popleft()
        best = queue[0]
        cost = penalty + self.capacity + costs[best]
        k = len(places)
        places.append(place)
        costs.append(cost)
        self.parents.append(best)
        while queue and costs[queue[-1]] > cost:
            queue.pop()
        queue.append(k)

    def settled(self, final: bool = False) -> Iterator[tuple]:
        """Pieces of the windows on which every path that can still win agrees; all of them at the end."""
        if final:
            common = len(self.places) - 1
        else:
            live = set(self.queue)
            while len(live) > 1:
                latest = max(live)
                live.discard(latest)
                live.add(self.parents[latest])
            common = live.pop()
        if common <= 0:
            return
        path = []
        k = common
        while k > 0:
            path.append(self.places[k])
            k = self.parents[k]
        begin = self.places[0]
        for stop in reversed(path):
            yield from self._window(begin, stop)
            begin = stop
        floor = self.costs[common]
        self.places, self.parents = self.places[common:], [max(p - common, -1) for p in self.parents[common:]]
        self.costs = [c - floor for c in self.costs[common:]]
        self.parents[0] = -1
        self.queue = deque(k - common for k in self.queue)

    def _window(self, begin: int, stop: int) -> Iterator[tuple]:
        offset = 0
        while self.docs and begin < stop:
            first, ids, doc_id = self.docs[0]
            start, length = begin - first, min(stop, first + len(ids)) - begin
            piece = ids[start : start + length]
            yield doc_id, start, length, zlib.crc32(piece.tobytes()), len(ids), self.sequence, offset, piece
            offset += length
            begin += length
            if start + length == len(ids):
                self.docs.popleft()
        self.sequence += 1


def pack(
    docs: DataFrame, vocabulary: str, ranks: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = True
) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``vocabulary`` and ``ranks`` are the two files of one byte-level vocabulary, ``pattern`` its pre-token pattern; a
    document is its ids and then ``END_ID``. A null or empty text is that one id. Every id lies in exactly one piece;
    equal rows are documents of their own. Partitions are packed on their own, in their order and without a shuffle, and
    only the last window of a partition can be left largely empty. A task holds one document and a few windows.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        schema += ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(vocabulary, ranks, pattern), Packer(capacity)
        first_sequence = TaskContext.get().partitionId() << 40
        end = np.array([END_ID], dtype="<u4")

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces))
            columns[5] = [first_sequence + s for s in columns[5]]
            columns[7] = [ids.astype(np.int32) for ids in columns[7]] if with_ids else None
            arrays = [pa.array(c, type=t) for c, (_, t) in zip(columns, fields)]
            return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])

        pieces: list[tuple] = []
        fed = 0
        for rows in batches:
            for k in range(rows.num_rows):
                ids = np.concatenate([encoder.encode(rows.column(1)[k].as_py() or ""), end])
                ends = np.flatnonzero(encoder.sentence_end[np.minimum(ids[:-1], len(encoder.sentence_end) - 1)]) + 1
                packer.feed(rows.column(0)[k].as_py(), ids, ends[ends < len(ids)])
                fed += len(ids)
                if fed > 64 * capacity:
                    fed = 0
                    pieces.extend(packer.settled())
                    if len(pieces) > 4096 or with_ids:
                        if pieces:
                            yield batch(pieces)
                        pieces = []
        pieces.extend(packer.settled(final=True))
        if pieces:
            yield batch(pieces)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)
