"""Main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf blocks. Each block is a vector of its tag path (hashed names of elements, classes and
ids), its hashed words and a few plain figures; a bidirectional LSTM in numpy reads the whole sequence and tells for every
block whether it is main text. The network is trained here, on a bounded sample of the pages: their prose set into drawn
layouts with known labels, and the sampled pages themselves where their own elements say what is main text.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import drawn, word_hashes
from sightline.llm.html_blocks import PATH_BUCKETS, Block, blocks, bucket
from sightline.llm.page_layouts import Layouts

SAMPLE_PAGES, DRAWN_PAGES = 300, 3600
WORD_BUCKETS = 8192
PATH_SIZE, WORD_SIZE, HIDDEN = 24, 12, 28
FIGURES = 14
EPOCHS, BATCH, RATE = 7, 64, 8e-3
NAME_DECAY, WORDLESS = 0.5, 0.3  # shrinks what few pages teach about a name or word; share of blocks read without words
TRAINED_BLOCKS = 300  # sampled pages with more blocks are not trained on; all pages are labelled whole
CALL_BLOCKS, CALL_CHARS = 20_000, 8_000_000

MAIN = frozenset([bucket("<article"), bucket("<main")])
ASIDE = frozenset(bucket(f"<{t}") for t in ("nav", "footer", "aside", "form", "header"))


class Features:
    """Inputs of a run of pages: ragged path buckets and words of all blocks, figures, and where each page begins."""

    def __init__(self, pages: list[list[Block]]):
        flat = [b for page in pages for b in page]
        self.sizes = np.array([len(p) for p in pages], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        count = len(flat)
        paths = [sorted(b.path) for b in flat]
        self.path_ends = np.cumsum([0, *map(len, paths)])
        self.path = np.fromiter((k for p in paths for k in p), np.int64, self.path_ends[-1])
        raw = [b.text.encode("utf-8", "surrogatepass") for b in flat]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        hashes, _, _, firsts = word_hashes(data, offsets)
        self.words, self.word_ends = (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), np.asarray(firsts, dtype=np.int64)
        self.figures = self._figures(flat, data, offsets, sizes, np.diff(self.word_ends)) if count else np.zeros((0, FIGURES), np.float32)

    def _figures(self, flat: list[Block], data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
        def counted(marks: bytes) -> np.ndarray:
            table = np.zeros(256, dtype=bool)
            table[list(marks)] = True
            upto = np.concatenate([[0], np.cumsum(table[data])])
            return upto[offsets[1:]] - upto[offsets[:-1]]

        out = np.zeros((len(flat), FIGURES), dtype=np.float32)
        page = np.repeat(np.arange(len(self.sizes)), self.sizes)
        place = np.arange(len(flat)) - self.starts[page]
        total = np.add.reduceat(sizes, self.starts[:-1][self.sizes > 0])
        share = sizes / np.repeat(total, self.sizes[self.sizes > 0])
        linked = np.array([b.linked for b in flat]) / np.array([len(b.text) for b in flat])
        paths = np.array([hash(b.path) for b in flat])
        same = np.zeros(len(flat), dtype=bool)
        same[1:] = (paths[1:] == paths[:-1]) & (page[1:] == page[:-1])
        out[:, 0] = np.log1p(sizes) / 5
        out[:, 1] = np.log1p(words) / 4
        out[:, 2] = linked
        out[:, 3] = np.isin(data[offsets[1:] - 1], list(b".!?"))
        out[:, 4] = np.minimum(1, 8 * counted(b",;") / np.maximum(1, words))
        out[:, 5] = np.minimum(1, 8 * counted(b"0123456789") / sizes)
        out[:, 6] = np.minimum(1, 4 * counted(bytes(range(65, 91))) / sizes)
        out[:, 7] = place / self.sizes[page]
        out[:, 8] = np.log(share) / 5
        out[:, 9] = same
        out[:-1, 10] = same[1:]
        out[:, 11] = np.minimum(2, np.array([b.depth for b in flat]) / 8)
        out[:, 12] = place == 0
        out[:, 13] = np.log1p(self.sizes[page]) / 5
        return out


def summed(rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows, run k being ``ends[k]`` to ``ends[k + 1]``; empty runs give zeros."""
    full = np.flatnonzero(np.diff(ends))
    out = np.zeros((len(ends) - 1, rows.shape[1]), dtype=rows.dtype)
    if len(full):
        out[full] = np.add.reduceat(rows, ends[full], axis=0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    """Embeddings, one LSTM a direction, and a logistic output on both directions' states."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        width = PATH_SIZE + WORD_SIZE + FIGURES
        self.weights = {
            "path": draw.normal(0, 0.01, (PATH_BUCKETS, PATH_SIZE)), "word": draw.normal(0, 0.01, (WORD_BUCKETS, WORD_SIZE)),
            "bias": np.zeros(1),
        }
        for way in ("ahead", "back"):
            self.weights[f"{way}_in"] = draw.normal(0, width**-0.5, (width, 4 * HIDDEN))
            self.weights[f"{way}_state"] = draw.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            start = np.zeros(4 * HIDDEN)
            start[HIDDEN : 2 * HIDDEN] = 1.0  # keep what was read
            self.weights[f"{way}_bias"] = start
            self.weights[f"{way}_out"] = draw.normal(0, HIDDEN**-0.5, HIDDEN)
        self.weights = {k: w.astype(np.float32) for k, w in self.weights.items()}

    def inputs(self, f: Features) -> np.ndarray:
        w = self.weights
        paths = summed(w["path"][f.path], f.path_ends)
        words = np.zeros((len(f.figures), WORD_SIZE), dtype=np.float32)
        first = 0
        while first < len(words):  # some hundred thousand words at once
            stop = max(first + 1, int(np.searchsorted(f.word_ends, f.word_ends[first] + 300_000, "right")) - 1)
            a, b = f.word_ends[first], f.word_ends[stop]
            words[first:stop] = summed(w["word"][f.words[a:b]], f.word_ends[first : stop + 1] - a)
            first = stop
        return np.concatenate([paths, words / self.scale(f)[:, None], f.figures], axis=1)

    @staticmethod
    def scale(f: Features) -> np.ndarray:
        return np.maximum(1, np.diff(f.word_ends)).astype(np.float32)

    @staticmethod
    def steps(f: Features, way: str) -> list[np.ndarray]:
        """Block numbers of each step: pages by descending length, so the pages still running are always the first."""
        order = np.argsort(-f.sizes, kind="stable")
        sizes, starts = f.sizes[order], f.starts[:-1][order]
        running = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right") if len(sizes) else []
        if way == "ahead":
            return [starts[:n] + t for t, n in enumerate(running)]
        return [starts[:n] + sizes[:n] - 1 - t for t, n in enumerate(running)]

    def read(self, x: np.ndarray, f: Features, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """What one direction adds to each block's score, and the states of every step if they are to be kept."""
        w = self.weights
        state_in, out = w[f"{way}_state"], w[f"{way}_out"]
        gates_in = x @ w[f"{way}_in"] + w[f"{way}_bias"]
        score = np.zeros(len(x), dtype=np.float32)
        h = c = np.zeros((len(f.sizes), HIDDEN), dtype=np.float32)
        kept = []
        for rows in self.steps(f, way):
            h0, c0 = h[: len(rows)], c[: len(rows)]
            gates = gates_in[rows] + h0 @ state_in
            ifo = sigmoid(gates[:, : 3 * HIDDEN])
            g = np.tanh(gates[:, 3 * HIDDEN :])
            i, keep_gate, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
            c = keep_gate * c0 + i * g
            squashed = np.tanh(c)
            h = o * squashed
            score[rows] = h @ out
            if keep:
                kept.append((rows, h0, c0, i, keep_gate, o, g, squashed, h))
        return score, kept

    def scores(self, f: Features) -> np.ndarray:
        """The score of every block; main text is above 0."""
        x = self.inputs(f)
        return self.read(x, f, "ahead", False)[0] + self.read(x, f, "back", False)[0] + self.weights["bias"][0]

    def gradient(self, f: Features, labels: np.ndarray, worded: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean logistic loss over the blocks, back through time; blocks not ``worded`` are read without words."""
        w = self.weights
        x = self.inputs(f)
        x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] *= worded[:, None]
        ways = {way: self.read(x, f, way, True) for way in ("ahead", "back")}
        score = ways["ahead"][0] + ways["back"][0] + w["bias"][0]
        error = (sigmoid(score) - labels).astype(np.float32) / len(labels)
        grads = {"bias": error.sum(keepdims=True)}
        dx = np.zeros_like(x)
        for way, (_, kept) in ways.items():
            out, state_in = w[f"{way}_out"], w[f"{way}_state"]
            d_gates = np.zeros((len(x), 4 * HIDDEN), dtype=np.float32)
            d_state, d_out = np.zeros_like(state_in), np.zeros_like(out)
            dh = dc = np.zeros((0, HIDDEN), dtype=np.float32)
            for rows, h0, c0, i, keep_gate, o, g, squashed, h in reversed(kept):
                d_out += error[rows] @ h
                here = error[rows][:, None] * out
                here[: len(dh)] += dh
                back = here * o * (1 - squashed * squashed)
                back[: len(dc)] += dc
                gates = np.concatenate(
                    [back * g * i * (1 - i), back * c0 * keep_gate * (1 - keep_gate), here * squashed * o * (1 - o), back * i * (1 - g * g)], axis=1
                )
                d_gates[rows] = gates
                d_state += h0.T @ gates
                dh, dc = gates @ state_in.T, back * keep_gate
            grads[f"{way}_out"], grads[f"{way}_state"] = d_out, d_state
            grads[f"{way}_in"], grads[f"{way}_bias"] = x.T @ d_gates, d_gates.sum(axis=0)
            dx += d_gates @ w[f"{way}_in"].T
        d_words = dx[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] * (worded / self.scale(f))[:, None]
        grads["path"] = spread(f.path, np.repeat(dx[:, :PATH_SIZE], np.diff(f.path_ends), axis=0), PATH_BUCKETS)
        grads["word"] = spread(f.words, np.repeat(d_words, np.diff(f.word_ends), axis=0), WORD_BUCKETS)
        return grads


def spread(buckets: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Rows summed by bucket."""
    return np.stack([np.bincount(buckets, rows[:, k], count) for k in range(rows.shape[1])], axis=1).astype(np.float32)


def by_elements(page: list[Block]) -> list[int] | None:
    """Labels that a page's own elements give; None where no element marks main text."""
    labels = [int(bool(b.path & MAIN) and not b.path & ASIDE) for b in page]
    return labels if any(labels) else None


def reworded(page: list[Block], labels: list[int], layouts: Layouts) -> tuple[list[Block], list[int]]:
    """A page's own blocks in another number and with other texts."""
    draw = layouts.draw
    out, kept = [], []
    refrain = layouts.text(1, 4) if draw.random() < 0.15 else ""
    for block, label in zip(page, labels):
        for _ in range(draw.choice([0, 1, 1, 1, 2])):
            text = unescape(layouts.text(1, draw.choice([1, 4, 30, 120]) if label else draw.choice([2, 6, 20])))
            text = refrain if refrain and label and draw.random() < 0.8 else text
            out.append(Block(text, block.path, block.depth, len(text) if 2 * block.linked > len(block.text) else 0))
            kept.append(label)
    return out, kept


def lessons(sample: list[str], count: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """Training pages: the sampled pages with telling elements, such pages with other texts (a sixth of ``count``), and
    ``count`` drawn layouts of the sample's prose."""
    known, prose, short = [], [], []
    for page in map(blocks, sample):
        labels = by_elements(page)
        for block, label in zip(page, labels or [1] * len(page)):
            (prose if label and block.text.count(" ") > 6 else short).append(block.text)
        if labels and len(page) <= TRAINED_BLOCKS:
            known.append((page, labels))
    layouts = Layouts(prose, short, seed)
    made = [reworded(*layouts.draw.choice(known), layouts) for _ in range(count // 6)] if known else []
    for _ in range(count):
        text, labels = layouts.page()
        page = blocks(text)
        if len(page) == len(labels):  # else an unclosed paragraph took in what follows
            made.append((page, labels))
    return known + made


def train(sample: list[str], count: int = DRAWN_PAGES, epochs: int = EPOCHS, seed: int = 11) -> Labeller:
    """A labeller trained on the lessons of ``sample`` (empty: made-up words alone) by Adam; equal input, equal weights."""
    taught = lessons(sample, count, seed)
    order = sorted(range(len(taught)), key=lambda k: len(taught[k][0]))
    batches = []
    for k in range(0, len(order), BATCH):  # pages of like length share a batch
        chosen = [taught[j] for j in order[k : k + BATCH]]
        batches.append((Features([p for p, _ in chosen]), np.array([x for _, y in chosen for x in y], dtype=np.float32)))
    model, draw = Labeller(seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(w) for k, w in model.weights.items()}
    spread_ = {k: np.zeros_like(w) for k, w in model.weights.items()}
    step, steps = 0, epochs * len(batches)
    for _ in range(epochs):
        for k in draw.permutation(len(batches)):
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            worded = (draw.random(len(batches[k][1])) >= WORDLESS).astype(np.float32)
            grads = model.gradient(*batches[k], worded)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for name, g in grads.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                mean[name] += 0.1 * (g - mean[name])
                spread_[name] += 0.01 * (g * g - spread_[name])
                if name in ("path", "word"):
                    model.weights[name] *= 1 - rate * NAME_DECAY
                up = mean[name] / (1 - 0.9**step)
                model.weights[name] -= rate * up / (np.sqrt(spread_[name] / (1 - 0.99**step)) + 1e-8)
    return model


def sampled_model(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Labeller:
    """A labeller taught from at most ``sample`` pages, drawn by a hash of their content, so reruns agree."""
    rows = pages.select(F.col("html").cast("string").alias("html")).where(F.col("html").isNotNull())
    rows = rows.withColumn("key", F.xxhash64("html"))
    chosen = drawn(rows, "key", "layouts", sample).select("html").collect()  # at most ``sample`` rows
    return train(sorted(r["html"] for r in chosen))


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """Rows page_id, url, text, n_chars, n_blocks, n_main: one for each row of ``pages``.

    Whole pages are read; null or empty html, or a page without main text, gives an empty text. Blocks judged main text
    are joined in page order by a blank line. Equal rows each give a row, an empty table none; other columns are not
    read. Nothing is shuffled; a task works on about 8 MB of pages (or one larger page) at once.
    """
    model = model or sampled_model(pages)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights, about 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, parsed, count, chars = 0, [], 0, 0
            for k, page in enumerate(batch.column(2)):
                text = page.as_py() or ""
                parsed.append(blocks(text))
                count, chars = count + len(parsed[-1]), chars + len(text)
                if count >= CALL_BLOCKS or chars >= CALL_CHARS or k + 1 == batch.num_rows:
                    yield labelled(batch.slice(first, k + 1 - first), parsed, shared.value)
                    first, parsed, count, chars = k + 1, [], 0, 0

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")


def labelled(rows: pa.RecordBatch, pages: list[list[Block]], model: Labeller) -> pa.RecordBatch:
    features = Features(pages)
    main = model.scores(features) > 0 if len(features.figures) else np.zeros(0, dtype=bool)
    texts, kept = [], []
    for page, start in zip(pages, features.starts.tolist()):
        chosen = [b.text for k, b in enumerate(page, start) if main[k]]
        texts.append("\n\n".join(chosen))
        kept.append(len(chosen))
    columns = [
        rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array(features.sizes), pa.array(kept, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])
