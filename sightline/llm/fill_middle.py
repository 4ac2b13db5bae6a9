"""Fill-in-the-middle transformation by displacement scatter.

The texts of a batch are one run of bytes. A scan finds the units (runs of letters, single other code points) and the
two cuts of every text; each segment between cuts moves by one displacement. Displacements are written as differences
at the segments' first bytes, so one cumulative sum gives every byte its shift and one scatter builds all outputs. The
inverse reads the markers in the outputs, gives every restored byte its source in the same way, and gathers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import byte_slices

# The markers of prefix, suffix and middle, and the shares of the forms in hundredths.
PREFIX, SUFFIX, MIDDLE = (np.frombuffer(m, np.uint8) for m in (b"<P>", b"<S>", b"<M>"))
MARK = 3
TRANSFORMED, SUFFIX_FIRST = 90, 20

PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"], dtype=object)
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True


def marker_places(data: np.ndarray, marker: np.ndarray) -> np.ndarray:
    """Places in ``data`` at which ``marker`` stands."""
    if len(data) < MARK:
        return np.zeros(0, np.int64)
    places = np.flatnonzero(data[: len(data) - 2] == marker[0])
    return places[(data[places + 1] == marker[1]) & (data[places + 2] == marker[2])]


def rows_of(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row in which each place lies; -1 for a marker that two rows only form together."""
    row = np.searchsorted(offsets, places, "right") - 1
    return np.where(places + MARK <= offsets[row + 1], row, -1) if len(places) else row


def shifts(places: np.ndarray, values: np.ndarray, length: int) -> np.ndarray:
    """For ``length`` bytes the value of the last segment that begins at or before each: the cumulative sum of a
    difference array. ``places`` ascend; of segments that begin together the last one counts."""
    steps = np.zeros(length + 1, dtype=np.int64)
    np.add.at(steps, places, np.diff(values, prepend=0))
    return np.cumsum(steps[:-1])


def cut(data: np.ndarray, offsets: np.ndarray, draws: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Units, form, code points of prefix and middle, and the places of both cuts for each row of a run of bytes."""
    lead = (data & 0xC0) != 0x80
    letter = LETTER[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = letter[:-1]
    inner = offsets[:-1]
    before[inner[inner < len(data)]] = False
    units = np.append(np.flatnonzero(lead & ~(letter & before)), len(data))
    first = np.searchsorted(units, offsets)
    first = np.minimum(first, len(units) - 1)
    n = np.diff(first)
    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    low, high = units[first[:-1] + np.minimum(one, two)], units[first[:-1] + np.maximum(one, two)]
    form = np.where(draws[3] % 100 < SUFFIX_FIRST, SPM, PSM)
    form[(draws[2] % 100 >= TRANSFORMED) | (n == 0)] = PLAIN
    for marker in (PREFIX, SUFFIX, MIDDLE):
        row = rows_of(marker_places(data, marker), offsets)
        form[row[row >= 0]] = PLAIN
    upto = np.concatenate([[0], np.cumsum(lead)])
    return n, form, upto[low] - upto[offsets[:-1]], upto[high] - upto[low], low, high


def scatter(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of a run of rows, and their offsets."""
    begin, end = offsets[:-1], offsets[1:]
    out_offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) + 3 * MARK * (form != PLAIN))])
    base = out_offsets[:-1] - begin
    head, middle, tail = low - begin, high - low, end - high
    psm, spm = form == PSM, form == SPM
    moves = np.zeros((len(form), 3), dtype=np.int64)  # of prefix, middle, suffix
    moves[:, 0] = np.where(psm, MARK, np.where(spm, 2 * MARK + tail, 0))
    moves[:, 1] = np.where(form != PLAIN, 3 * MARK + tail, 0)
    moves[:, 2] = np.where(psm, 2 * MARK - middle, np.where(spm, MARK - head - middle, 0))
    places = np.stack([begin, low, high], axis=1).ravel()
    out = np.empty(out_offsets[-1], dtype=np.uint8)
    out[np.arange(len(data)) + shifts(places, (moves + base[:, None]).ravel(), len(data))] = data
    at = out_offsets[:-1]
    for marker, place in (
        (PREFIX, np.where(psm, at, at + MARK + tail)),
        (SUFFIX, np.where(psm, at + MARK + head, at)),
        (MIDDLE, at + 2 * MARK + head + tail),
    ):
        out[place[form != PLAIN][:, None] + np.arange(MARK)] = marker
    return out, out_offsets


def restore(out: np.ndarray, out_offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts rebuilt from outputs and forms alone, and their offsets."""
    changed = form != PLAIN
    found = {}
    for name, marker in (("prefix", PREFIX), ("suffix", SUFFIX), ("middle", MIDDLE)):
        places = marker_places(out, marker)
        row = rows_of(places, out_offsets)
        inside = (row >= 0) & changed[row]
        where = np.zeros(len(form), dtype=np.int64)
        where[row[inside]] = places[inside]
        found[name] = where
    begin, end = out_offsets[:-1], out_offsets[1:]
    psm = form == PSM
    starts = np.stack([found["prefix"], found["middle"], found["suffix"]], axis=1) + MARK
    stops = np.stack([np.where(psm, found["suffix"], found["middle"]), end, np.where(psm, found["middle"], found["prefix"])], axis=1)
    starts[~changed], stops[~changed] = end[~changed, None], end[~changed, None]
    starts[~changed, 0] = begin[~changed]
    sizes = stops - starts
    offsets = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])
    places = offsets[:-1, None] + np.concatenate([np.zeros((len(form), 1), np.int64), np.cumsum(sizes[:, :2], axis=1)], axis=1)
    source = shifts(places.ravel(), (starts - places).ravel(), offsets[-1])
    return out[np.arange(offsets[-1]) + source], offsets


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def transform(docs: DataFrame) -> DataFrame:
    """Rows doc_id, n, form, prefix_chars, middle_chars, output, restored, one for each row of ``docs``.

    The units of a text are runs of the letters A-Z in either case and all other single code points; ``n`` counts them.
    Cuts and form follow from the SHA-256 of ``1:`` and the decimal doc_id (nothing for a null one), so equal ids draw
    alike and reruns agree. A null text is empty; an empty text, or one that holds a marker, stays plain, and lengths of
    plain rows are null. ``restored`` is rebuilt from ``output`` and ``form`` alone. Equal rows each give a row, an
    empty table none; other columns are not read. A task holds an Arrow batch and works on about 2 MB of texts (or one
    longer text) at once; nothing is shuffled.
    """
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.select("doc_id", "text", *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in byte_slices(batch.column(1)):
                part = batch.slice(row, len(offsets) - 1)
                drawn = [part.column(2 + k).to_numpy(zero_copy_only=False) for k in range(4)]
                n, form, head, middle, low, high = cut(data, offsets, drawn)
                out, out_offsets = scatter(data, offsets, form, low, high)
                again, again_offsets = restore(out, out_offsets, form)
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(n.astype(np.int64)), pa.array(FORMS[form], pa.string()),
                        pa.array(head.astype(np.int64), mask=plain), pa.array(middle.astype(np.int64), mask=plain),
                        strings(out, out_offsets), strings(again, again_offsets),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"],
                )

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")
