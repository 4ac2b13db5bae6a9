"""Secret scan: fixed patterns and a linear-chain conditional random field.

The patterns give the base spans. The field tags the tokens of a text as the beginning of a secret, its inside or
outside, from their shape, the words beside them and features of the file, and is decoded by Viterbi; it is trained on
the base spans of a bounded sample of excerpts and adds spans that the patterns miss. Whole texts are scanned.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import drawn, mixed_bits, saved

# The patterns of the base spans, in the order of their kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 8, "access": 16, "hex": 32, "model": 8}
LIKELY = {
    KEYWORDS: r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}",
    ("akia",): r"AKIA[A-Z0-9]{12}",
}

SAMPLE_DOCUMENTS = 400
EXCERPT, EXCERPTS = 8192, 2  # characters of a part, parts of a text
SAMPLE_CHUNKS, CHUNK_TOKENS = 1500, 48
ROUNDS = 60
MARGIN = 1.0
TAGS = 3  # outside, begin, inside

# Bits of a character: what kind of token character it is, or what it says in a gap between tokens.
HEX_LOWER, LOWER, HEX_UPPER, UPPER, DIGIT, JOINER, OTHER_LETTER = 1, 2, 4, 8, 16, 32, 64
ASSIGNS, QUOTE, LINE, MARK = 128, 256, 512, 1024
TOKEN_BITS = 127
_KIND = np.full(128, MARK, dtype=np.uint16)
_KIND[[ord(c) for c in "abcdef"]] = HEX_LOWER
_KIND[[ord(c) for c in "ghijklmnopqrstuvwxyz"]] = LOWER
_KIND[[ord(c) for c in "ABCDEF"]] = HEX_UPPER
_KIND[[ord(c) for c in "GHIJKLMNOPQRSTUVWXYZ"]] = UPPER
_KIND[[ord(c) for c in "0123456789"]] = DIGIT
_KIND[[ord(c) for c in "+/_-"]] = JOINER
_KIND[[ord(c) for c in "=:"]] = ASSIGNS
_KIND[[ord(c) for c in "\"'`"]] = QUOTE
_KIND[[ord(c) for c in "\n\r"]] = LINE
_KIND[[ord(c) for c in " \t\x0b\x0c"]] = 0

SHAPES = 128 * 8 * 4
GAPS = 16 * 16
WORDS = 1024
FILES = 8 * 4
MIXTURES, SIZES = 16 * 2, 8 * 4
OFFSETS = np.cumsum([0, SHAPES, GAPS, WORDS, WORDS, FILES, MIXTURES])
GROUPS = len(OFFSETS)
FEATURES = int(OFFSETS[-1]) + SIZES


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the base spans, by start and kind."""
    spans = []
    lowered = text.lower()
    if any(word in lowered for word in KEYWORDS):
        spans += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a run of 32 or more is found whether or not shorter runs are matched and dropped
    spans += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(spans)


class Tokens:
    """Tokens of several texts and their feature numbers, one column for each group of features."""

    def __init__(self, texts: list[str]):
        code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.text_starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        kind = np.where(code < 128, _KIND[np.minimum(code, 127)], OTHER_LETTER).astype(np.uint16)
        inside = (kind & TOKEN_BITS) > 0
        if not len(code) or not inside.any():
            self.starts = self.ends = np.zeros(0, np.int64)
            self.features, self.firsts = np.zeros((0, GROUPS), np.int64), np.zeros(len(texts) + 1, np.int64)
            return
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edges = np.concatenate([[0] if inside[0] else [], change, [len(code)] if inside[-1] else []]).astype(np.int64)
        starts, ends = edges[0::2], edges[1::2]
        bits = np.bitwise_or.reduceat(kind, starts)
        digit = kind == DIGIT
        turns = np.zeros(len(code), dtype=np.uint8)
        turns[1:] = (digit[1:] != digit[:-1]) & inside[1:] & inside[:-1]
        switches = np.add.reduceat(turns, starts, dtype=np.int64)
        sizes = ends - starts
        length = np.searchsorted([4, 8, 12, 16, 20, 32, 40], sizes, "right")
        variety = np.searchsorted([1, 3, 7], switches, "right")
        shape = ((bits & TOKEN_BITS).astype(np.int64) * 8 + length) * 4 + variety
        self.starts, self.ends = starts, ends
        self.firsts = np.searchsorted(starts, np.concatenate([self.text_starts, [len(code) + 1]]))
        gap = ((bits >> 7) & 15).astype(np.int64)
        lowered = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint64)
        place = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code)))) if starts[0] == 0 else None
        if place is None:
            place = np.zeros(len(code), dtype=np.int64)
            place[starts[0] :] = np.arange(starts[0], len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
        letters = mixed_bits(lowered * np.uint64(1 << 20) + place.astype(np.uint64) + np.uint64(1))
        letters[~inside] = 0
        word = (mixed_bits(np.add.reduceat(letters, starts)) % np.uint64(WORDS - 1)).astype(np.int64) + 1
        count = len(starts)
        before_gap, before_word, after_word, second_gap = (np.zeros(count, np.int64) for _ in range(4))
        before_gap[1:], before_word[1:], after_word[:-1] = gap[:-1], word[:-1], word[1:]
        second_gap[2:] = gap[:-2]
        firsts = self.firsts[:-1][np.diff(self.firsts) > 0]
        before_gap[firsts] = before_word[firsts] = second_gap[firsts] = 0
        after_word[self.firsts[1:][np.diff(self.firsts) > 0] - 1] = 0
        digits = np.add.reduceat(digit, starts, dtype=np.int64)
        per_text = np.diff(self.firsts)
        owner = np.repeat(np.arange(len(texts)), per_text)
        share = np.bincount(owner, weights=digits, minlength=len(texts)) / np.maximum(lengths, 1)
        assigns = np.bincount(owner, weights=(gap & 1), minlength=len(texts))
        of_file = np.searchsorted([0.0001, 0.001, 0.005, 0.02, 0.05, 0.1, 0.3], share, "right") * 4 + np.searchsorted([1, 3, 10], assigns, "right")
        lower, upper = (bits & (HEX_LOWER | LOWER)) > 0, (bits & (HEX_UPPER | UPPER)) > 0
        mixture = lower + 2 * upper + 4 * ((bits & DIGIT) > 0) + 8 * ((bits & OTHER_LETTER) > 0) + 16 * ((bits & JOINER) > 0)
        columns = [shape, before_gap * 16 + second_gap, before_word, after_word, of_file[owner], mixture, length * 4 + variety]
        self.features = np.stack([c + offset for c, offset in zip(columns, OFFSETS)], axis=1)


class Field:
    """Weights of the conditional random field: ``emit`` (feature, tag), ``move`` (tag, tag) and ``begin`` (tag)."""

    FORBIDDEN = -1e4

    def __init__(self, emit: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.emit, self.move, self.begin = emit, move, begin

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = self.emit[features[:, 0]].copy()
        for k in range(1, features.shape[1]):
            out += self.emit[features[:, k]]
        return out

    @staticmethod
    def train(features: np.ndarray, tags: np.ndarray, mask: np.ndarray, rounds: int = ROUNDS, l2: float = 1e-5) -> Field:
        """Maximum conditional likelihood of chunks (chunk, token) by Adam; gradients by forward and backward sums."""
        chunks, steps, groups = features.shape
        emit, move, begin = np.zeros((FEATURES, TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS)
        allowed = np.zeros((TAGS, TAGS))
        allowed[0, 2] = Field.FORBIDDEN
        start_allowed = np.array([0.0, 0.0, Field.FORBIDDEN])
        flat = features.reshape(-1, groups)
        present = mask.reshape(-1)
        target = np.zeros((chunks, steps, TAGS))
        np.put_along_axis(target, tags[..., None], 1.0, axis=2)
        target *= mask[..., None]
        moved = np.zeros((TAGS, TAGS))
        np.add.at(moved, (tags[:, :-1][mask[:, 1:]], tags[:, 1:][mask[:, 1:]]), 1.0)
        started = target[:, 0].sum(axis=0)
        slow, fast = [np.zeros_like(w) for w in (emit, move, begin)], [np.zeros_like(w) for w in (emit, move, begin)]

        def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        for turn in range(1, rounds + 1):
            e = np.zeros((chunks * steps, TAGS))
            for k in range(groups):
                e += emit[flat[:, k]]
            e = e.reshape(chunks, steps, TAGS)
            m = move + allowed
            ahead, back = np.empty_like(e), np.zeros_like(e)
            ahead[:, 0] = begin + start_allowed + e[:, 0]
            for t in range(1, steps):
                now = log_sum(ahead[:, t - 1][:, :, None] + m[None], 1) + e[:, t]
                ahead[:, t] = np.where(mask[:, t, None], now, ahead[:, t - 1])
            for t in range(steps - 2, -1, -1):
                now = log_sum(m[None] + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
                back[:, t] = np.where(mask[:, t + 1, None], now, 0.0)
            whole = log_sum(ahead[:, -1], 1)
            chance = np.exp(ahead + back - whole[:, None, None]) * mask[..., None]
            pair = np.zeros((TAGS, TAGS))
            for t in range(1, steps):
                joint = ahead[:, t - 1][:, :, None] + m[None] + (e[:, t] + back[:, t])[:, None, :] - whole[:, None, None]
                pair += np.exp(np.minimum(joint, 0.0))[mask[:, t]].sum(axis=0)
            gap = (chance - target).reshape(-1, TAGS)[present]
            step = np.zeros_like(emit)
            for k in range(groups):
                for tag in range(TAGS):
                    step[:, tag] += np.bincount(flat[present, k], weights=gap[:, tag], minlength=FEATURES)
            grads = [step / chunks + l2 * emit, (pair - moved) / chunks + l2 * move, (chance[:, 0].sum(axis=0) - started) / chunks + l2 * begin]
            for k, (weight, grad) in enumerate(zip((emit, move, begin), grads)):
                slow[k] = 0.9 * slow[k] + 0.1 * grad
                fast[k] = 0.99 * fast[k] + 0.01 * grad * grad
                weight -= 0.2 * (slow[k] / (1 - 0.9**turn)) / (np.sqrt(fast[k] / (1 - 0.99**turn)) + 1e-8)
        return Field(emit, move + allowed, begin + start_allowed)

    def decode(self, features: np.ndarray, firsts: np.ndarray, margin: float = MARGIN) -> list[tuple[int, int]]:
        """(first, last) tokens of the spans on the best path of each text.

        A run of secret tokens gains, against all of them being outside, at most the sum of its tokens' ``gain`` and one
        more move. A token in no run for which this is positive is outside on every best path, so only the other tokens
        go through Viterbi. A run that beats being outside by less than ``margin`` is left out.
        """
        if not len(features):
            return []
        e = self.emissions(features)
        moves = np.append(self.move.reshape(-1)[1:], self.begin[1:] - self.begin[0] + self.move[0, 0]) - self.move[0, 0]
        most = max(0.0, float(moves.max()))
        gain = np.maximum(e[:, 1], e[:, 2]) - e[:, 0] + most
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        before = sums[:-1] - np.minimum.accumulate(sums[:-1])
        after = np.maximum.accumulate(sums[::-1])[::-1][1:] - sums[1:]
        maybe = np.flatnonzero(before + gain + after + most > 0)
        if not len(maybe):
            return []
        starting = set(firsts.tolist())
        joined = np.ones(len(maybe), dtype=bool)
        joined[1:] = (np.diff(maybe) != 1) | np.isin(maybe[1:], firsts)
        cuts = [*np.flatnonzero(joined).tolist(), len(maybe)]
        spans = []
        m = self.move
        for a, b in zip(cuts, cuts[1:]):
            run = maybe[a:b]
            at_start = int(run[0]) in starting
            first = self.begin if at_start else m[0]
            ends_text = int(run[-1]) + 1 in starting or int(run[-1]) + 1 == len(e)
            best = first + e[run[0]]
            plain = best[0]
            path = []
            for t in run[1:]:
                options = best[:, None] + m
                path.append(options.argmax(axis=0))
                best = options.max(axis=0) + e[t]
                plain += m[0, 0] + e[t][0]
            last = np.zeros(TAGS) if ends_text else m[:, 0]
            tag = int((best + last).argmax())
            if (best + last)[tag] - (plain + last[0]) < margin:
                continue
            tags = [tag]
            for back in reversed(path):
                tag = int(back[tag])
                tags.append(tag)
            tags.reverse()
            k = 0
            while k < len(tags):
                if tags[k]:
                    stop = k
                    while stop + 1 < len(tags) and tags[stop + 1] == 2:
                        stop += 1
                    spans.append((int(run[k]), int(run[stop])))
                    k = stop
                k += 1
        return spans


def _excerpts(text: str) -> list[str]:
    """At most ``EXCERPTS`` parts of ``EXCERPT`` characters of a text of any length: first parts around base spans, then
    others, each drawn by a hash; a text no longer than one part is that part."""
    if len(text) <= EXCERPT:
        return [text]
    digest = lambda place: hashlib.sha256(f"{len(text)}:{place}".encode()).digest()
    around = sorted({max(0, min(s[0] - EXCERPT // 2, len(text) - EXCERPT)) for s in base_spans(text)}, key=digest)
    others = sorted(range(0, len(text), EXCERPT), key=digest)
    kept: list[int] = []
    for place in itertools.chain(around, others):
        if len(kept) < EXCERPTS and all(abs(place - k) >= EXCERPT for k in kept):
            kept.append(place)
    return [text[k : k + EXCERPT] for k in kept]


def fit(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Field | None:
    """The field, trained on excerpts of ``sample`` documents likely to hold base spans and of as many others, drawn by a
    hash of their id; of many texts under one id, some are drawn by a hash of the text.

    None if no document has a base span: then there is nothing to learn from.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lowered, likely = F.lower("text"), F.lit(False)
    for words, pattern in LIKELY.items():
        some = F.lit(False)
        for word in words:
            some = some | F.contains(lowered, F.lit(word))
        likely = likely | (some & F.col("text").rlike(pattern))  # the pattern is tried on texts with its words only
    known = saved(rows.select("doc_id", likely.alias("likely")), "likely")
    chosen = None
    for kind in (True, False):
        part = drawn(known.where(F.col("likely") == kind), "doc_id", "crf", sample).select(F.col("doc_id").alias("chosen_id"))
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = F.broadcast(chosen.distinct())  # twice the sample at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [part for text in batch.column(0).to_pylist() for part in _excerpts(text)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], names=["text"])

    excerpts = saved(rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen_id"))).select("text").mapInArrow(cut, "text string").distinct(), "excerpts")
    texts = sorted(r.text for r in drawn(excerpts, "text", "crf", 2 * EXCERPTS * sample).select("text").collect())
    tokens = Tokens(texts)
    tags = np.zeros(len(tokens.starts), dtype=np.int64)
    for k, text in enumerate(texts):
        base = tokens.text_starts[k]
        here = slice(tokens.firsts[k], tokens.firsts[k + 1])
        starts, ends = tokens.starts[here], tokens.ends[here]
        for _, _, stop, secret in base_spans(text):
            inside = np.flatnonzero((starts >= base + secret) & (ends <= base + stop)) + tokens.firsts[k]
            if len(inside) and not tags[inside].any():
                tags[inside[0]], tags[inside[1:]] = 1, 2
    if not tags.any():
        return None
    pieces = []
    for a, b in zip(tokens.firsts[:-1].tolist(), tokens.firsts[1:].tolist()):
        pieces += [(c, min(b, c + CHUNK_TOKENS)) for c in range(a, b, CHUNK_TOKENS)]
    pieces.sort(key=lambda p: (not tags[p[0] : p[1]].any(), hash(p)))
    pieces = pieces[:SAMPLE_CHUNKS]
    features = np.zeros((len(pieces), CHUNK_TOKENS, tokens.features.shape[1]), dtype=np.int64)
    chosen = np.zeros((len(pieces), CHUNK_TOKENS), dtype=np.int64)
    mask = np.zeros((len(pieces), CHUNK_TOKENS), dtype=bool)
    for row, (a, b) in enumerate(pieces):
        features[row, : b - a], chosen[row, : b - a], mask[row, : b - a] = tokens.features[a:b], tags[a:b], True
    chosen[:, 0][chosen[:, 0] == 2] = 1  # a chunk may begin inside a secret
    return Field.train(features, chosen, mask)


def find(texts: list[str], field: Field | None) -> list[list[tuple[int, int, int, int]]]:
    """For each text (start, kind, end, start of the secret itself), by start and kind. Spans of the field that touch a
    base span add nothing and are left out, as are those too short."""
    found = [base_spans(text) for text in texts]
    if field is None:
        return found
    tokens = Tokens(texts)
    for first, last in field.decode(tokens.features, tokens.firsts):
        k = int(np.searchsorted(tokens.text_starts, tokens.starts[first], "right")) - 1
        start, stop = int(tokens.starts[first] - tokens.text_starts[k]), int(tokens.ends[last] - tokens.text_starts[k])
        if stop - start >= LEAST["model"] and not any(start < s[2] and s[0] < stop for s in found[k]):
            found[k].append((start, 3, stop, start))
    return [sorted(spans) for spans in found]


def _runs(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, texts[first:]


def scan(docs: DataFrame, field: Field | None = None, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans.

    ``spans`` lists all spans as kind:start:end in code points, by start and kind, the base spans and those the field
    adds; ``base_sha256`` digests the list of base spans. A null text is empty; rows stand for themselves.
    """
    field = field or fit(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # one weight for each feature and tag
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = []
            for _, part in _runs(texts):
                for spans in find(part, shared.value):
                    named = [f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans]
                    base = ",".join(name for name, s in zip(named, spans) if s[1] < 3)
                    out.append((*(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), ",".join(named)))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types[1:])]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redacted(docs: DataFrame, mark: str = "[SECRET]", sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` (of an assignment, its value) and ``n_chars``, if
    there is one, set to the new length of changed texts. Other rows and columns stay as they are."""
    field = fit(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # one weight for each feature and tag
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str, spans: list[tuple[int, int, int, int]]) -> str:
        parts, place = [], 0
        for start, stop in sorted((s[3], s[2]) for s in spans):
            if stop <= place:
                continue
            if start >= place:
                parts += [text[place:start], mark]
            place = stop
        return "".join(parts) + text[place:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            texts = [t or "" for t in old]
            new = list(old)
            for first, part in _runs(texts):
                for k, spans in enumerate(find(part, shared.value)):
                    if spans:
                        new[first + k] = clean(part[k], spans)
            columns = list(batch.columns)
            if size is not None:
                counts = batch.column(size).to_pylist()
                columns[size] = pa.array([c if a == b else len(b) for c, a, b in zip(counts, old, new)], type=batch.schema.field(size).type)
            columns[at] = pa.array(new, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
