"""Scans with rule tables of any size, through an inverted index of the text that rules need.

A literal scan names every rule in the plan, which suits a catalogue. A table of thousands of rules is joined instead:
each rule gives the literals one of which its matches must hold, each literal its stretch of characters (eight, or five or
three of shorter literals) that is rarest in the corpus, and a file meets only the rules whose stretches it holds. A file's
stretches are looked up in a bitmap of those that announce rules, of bounded size, before any of them leaves its task: the
rest is neither joined nor written. Candidates are then judged by literal and pattern inside the JVM; a pattern whose
matches surely lie in one line reads only the lines that hold its stretch, so a long file is not read whole for each of its
rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sightline.functions.binding import let
from sightline.functions.literals import required_literals, within_line
from sightline.functions.spans import MARK, clean_mark, first_matches, marked_first, matched_lines
from sightline.functions.text import C_FAMILY, has_comments, without_comments
from sightline.operators.detect import APPLE_SYMBOL_RULES, _with_apple, admitted, line_findings
from sightline.session import cut_lineage

RULES_A_ROW = 500  # candidates of one file that share a row; further ones take further rows
WIDTHS = (8, 5, 3)  # lengths of stretches; eight ASCII characters fill a bigint
BITS_A_KEY, MOST_BITS = 64, 27  # of the bitmap; at 2^27 it takes 16 MB, and beyond two million stretches lets more through
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SLICE_BYTES = 1 << 22  # of text that is looked up at once; a longer text is a slice of its own
DEFAULTS = {
    "severity": "'medium'", "suffixes": "array()", "platform": "null", "requires": "null", "case_sensitive": "false",
    "once_per_file": "false", "masvs": "''",
}
FIELDS = "rule_id string, pattern string, severity string, suffixes array<string>, platform string, requires string, once_per_file boolean, masvs string, literal string, earlier array<string>, in_line array<string>"


def stretches(literal: str) -> list[int]:
    """The distinct stretches of a literal as numbers, of the largest width that it holds."""
    width = next(w for w in WIDTHS if len(literal) >= w)
    return sorted({int.from_bytes(literal[k : k + width].encode(), "little") for k in range(len(literal) - width + 1)})


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of the keys in a bitmap of 2^bits."""
    return [(keys * np.uint64(f)) >> np.uint64(64 - bits) for f in FACTORS]


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of distinct bigint keys, in words of 64 bits; its size is bounded whatever their number."""
    bits = min(MOST_BITS, max(10, (BITS_A_KEY * keys.count()).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.concatenate(_places(batch.column(0).to_numpy().astype(np.uint64), bits))
            flags = np.left_shift(np.uint64(1), places & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int32)), pa.array(flags)], ["word", "flags"])

    found = keys.mapInArrow(words, "word int, flags bigint").groupBy("word").agg(F.bit_or("flags").alias("flags")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found["word"].to_numpy()] = found["flags"].to_numpy().view(np.uint64)
    return table


def _marked(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The places of the keys that the bitmap may hold."""
    at, bits = np.arange(len(keys)), len(table).bit_length() + 5
    for factor in FACTORS:
        place = (keys[at] * np.uint64(factor)) >> np.uint64(64 - bits)
        at = at[(table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
    return at


def _held(data: np.ndarray, ends: np.ndarray, widths: list[int], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, stretch, line) of the stretches in texts of these ends that the bitmap may hold, in order and without repeats."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data), "<u8", padded, 0, (1,)).copy()
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1]])
    texts, keys, lines = [], [], []
    for width in widths:
        own = eight & np.uint64((1 << (8 * width)) - 1)
        at = _marked(own, table)
        text = np.searchsorted(ends, at, "right")
        inside = at + width <= ends[text]
        at, text = at[inside], text[inside]
        texts.append(text)
        keys.append(own[at])
        lines.append(np.searchsorted(breaks, at) - np.searchsorted(breaks, starts[text]) + 1)
    text, key, line = (np.concatenate(x) for x in (texts, keys, lines))
    order = np.lexsort((line, key, text))
    text, key, line = text[order], key[order], line[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    return text[new], key[new], line[new]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(files, bytes, ends) of a batch of (file, text) rows, a few MB of text at a time."""
    files, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(files):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield files[first:last], data[offsets[first] : offsets[last]], offsets[first + 1 : last + 1] - offsets[first]
        first = last


def _looked_up(widths: list[int], shared) -> tuple[Callable, Callable]:
    """Functions over Arrow batches of (file, text) rows: rows (file, gram, lines), and counts (gram, files)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files, data, ends in (x for b in batches if b.num_rows for x in _slices(b)):
            text, key, line = _held(data, ends, widths, shared.value)
            first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])[: len(text)])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(text)).astype(np.int32)), pa.array(line.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(files[text[first]]), pa.array(key[first].view(np.int64)), lists], ["file", "gram", "lines"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, ends in (x for b in batches if b.num_rows for x in _slices(b)):
            text, key, _ = _held(data, ends, widths, shared.value)
            new = np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])[: len(text)]
            grams, files = np.unique(key[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(files.astype(np.int64))], ["gram", "files"])

    return rows, counts


def _literal_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [part.split()[0] for part in FIELDS.split(", ")]
    for batch in batches:
        found = [required_literals(p) for p in batch["pattern"]]
        needed = [required_literals(p) for p in batch["requires"]]
        best = [max(pair, key=lambda s: min(map(len, s), default=0)) for pair in zip(found, needed)]
        batch["in_line"] = [f if within_line(p) else [] for f, p in zip(found, batch["pattern"])]
        batch["literal"] = [[(x, b[:k]) for k, x in enumerate(b)] or [(None, [])] for b in best]
        rows = batch.explode("literal", ignore_index=True)
        rows["earlier"] = [pair[1] for pair in rows["literal"]]
        rows["literal"] = [pair[0] for pair in rows["literal"]]
        rows["in_line"] = rows["in_line"].where(rows["in_line"].map(bool), None)
        rows["grams"] = [stretches(x) if x else [] for x in rows["literal"]]
        yield rows[[*columns, "grams"]]


def literal_rules(rules: DataFrame) -> DataFrame:
    """Rules with defaults filled in, one row for each literal that can announce them, with the literals ``earlier`` in
    their order; a null literal where none is required. ``in_line``: literals one of which every line with a match holds,
    where matches lie in one line; else null. ``grams``: the stretches of the literal.

    Rules without an id or a pattern are left out; of repeated rows one counts.
    """
    filled = rules
    for name, default in DEFAULTS.items():
        filled = filled.withColumn(name, F.coalesce(F.col(name), F.expr(default)) if name in rules.columns else F.expr(default))
    pattern = F.when(F.col("case_sensitive"), F.col("pattern")).otherwise(F.concat(F.lit("(?i)"), "pattern"))
    columns = [p.rsplit(" ", 1) for p in FIELDS.split(", ")[:-3]]
    typed = filled.where("rule_id IS NOT NULL AND pattern IS NOT NULL").withColumn("pattern", pattern)
    typed = typed.select(*[F.col(n).cast(t).alias(n) for n, t in columns]).distinct()
    tasks = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much Python work
    return cut_lineage(typed.repartition(tasks, "rule_id", "pattern").mapInPandas(_literal_rows, f"{FIELDS}, grams array<bigint>"))


def rarest_stretches(texts: DataFrame, rules: DataFrame, widths: list[int]) -> DataFrame:
    """``rules`` that have a literal, with ``gram``, the stretch of it that the fewest texts hold.

    A literal of one stretch needs no counts; those of the others are summed in every task first.
    """
    named = rules.where("literal IS NOT NULL")
    several = named.where(F.size("grams") > 1).select("literal", F.explode("grams").alias("gram")).distinct()
    used = several.select("gram").distinct()
    if used.isEmpty():
        return named.withColumn("gram", F.col("grams")[0])
    _, counts = _looked_up(widths, rules.sparkSession.sparkContext.broadcast(bitmap(used)))
    spread = texts.mapInArrow(counts, "gram bigint, files bigint").groupBy("gram").agg(F.sum("files").alias("files"))
    rank = F.struct(F.coalesce("files", F.lit(0)), "gram")
    index = several.join(spread, "gram", "left").groupBy("literal").agg(F.min_by("gram", rank).alias("__rarest"))
    return named.join(index, "literal", "left").withColumn("gram", F.coalesce("__rarest", F.col("grams")[0])).drop("__rarest")


def candidates(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, rules) rows: the rules of :func:`literal_rules` whose literals a file may hold, some hundred a row. A rule that
    needs one literal in the line of its matches also has the ``lines`` that may hold it; others have null.

    ``sources``: file, text. Only stretches that announce a rule leave the texts. ``file`` is a digest; files that share one
    meet the union of their rules, which the patterns sort out.
    """
    context = rules.sparkSession.sparkContext
    tasks = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes are much work when rules are judged
    columns = [part.split()[0] for part in FIELDS.split(", ")]
    lengths = rules.agg(*[F.count_if(c).alias(f"w{w}") for w, c in _of_width(F.length("literal"))]).first()
    widths = [w for w in WIDTHS if lengths[f"w{w}"]]
    struct = lambda lines: F.array(F.struct(*columns, lines.cast("array<int>").alias("lines"))).alias("rules")
    sets = []
    if widths:
        texts = sources.where("text IS NOT NULL").select("file", F.lower("text").alias("text"))
        announced = cut_lineage(rarest_stretches(texts, rules, widths))
        rows, _ = _looked_up(widths, context.broadcast(bitmap(announced.select("gram").distinct())))
        held = texts.mapInArrow(rows, "file bigint, gram bigint, lines array<int>")
        alone = (F.size("in_line") == 1) & (F.col("in_line")[0] == F.col("literal"))
        sets.append(held.join(announced, "gram").select("file", struct(F.when(alone, F.col("lines")))))
    # rules without a literal are a stated set that every file meets, in blocks
    open_rules = rules.where("literal IS NULL")
    number = open_rules.count()
    if number or not sets:
        blocks = -(-number // RULES_A_ROW) or 1
        whole = open_rules.select(F.pmod(F.xxhash64("rule_id", "pattern"), F.lit(blocks)).alias("block"), struct(F.lit(None)))
        whole = whole.groupBy("block").agg(F.flatten(F.collect_list("rules")).alias("rules"))
        every = sources.select("file").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
        sets.append(every.join(whole, "block").select("file", "rules"))
    # dealt out once, by file, as the texts are that they meet; a row is as full as its file's own rules make it
    dealt = sets[0] if len(sets) == 1 else sets[0].unionByName(sets[1])
    upto = F.sum(F.size("rules")).over(W.partitionBy("file").orderBy(F.col("rules")[0]["rule_id"]).rowsBetween(W.unboundedPreceding, 0))
    filled = dealt.repartition(tasks, "file").withColumn("part", F.floor((upto - 1) / RULES_A_ROW))
    return filled.groupBy("file", "part").agg(F.flatten(F.collect_list("rules")).alias("rules")).drop("part")


def _of_width(length: Column) -> list[tuple[int, Column]]:
    """Whether the stretches of a literal of this length have a width, for every width."""
    above = [F.lit(True), *[length < w for w in WIDTHS]]
    return [(w, (length >= w) & over) for w, over in zip(WIDTHS, above)]


def scan_table(sources: DataFrame, rules: DataFrame, match_cap: int | None = None) -> DataFrame:
    """The rows of :func:`sightline.operators.detect.scan` for a rule table of any size.

    ``rules``: rule_id, pattern and any other fields of ``Rule``; missing or null ones take their defaults. Nothing of it
    comes to the driver but counts, which comment syntaxes its suffixes need, and bitmaps of bounded size.
    """
    rules = literal_rules(rules)
    syntaxes = [*C_FAMILY, ".xml"]
    named = rules.agg(*[F.bool_or(F.array_contains("suffixes", s)).alias(f"s{k}") for k, s in enumerate(syntaxes)]).first()
    commented = {s for k, s in enumerate(syntaxes) if named[k]}
    files = admitted(_with_apple(sources, APPLE_SYMBOL_RULES)).withColumn("text", clean_mark(F.col("text")))
    files = files.where("app_id IS NOT NULL AND path IS NOT NULL").withColumn("file", F.xxhash64("app_id", "path", "text"))
    # few bytes are much work here, so the join's tasks are not to be merged by size
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = files.repartition(tasks, "file").join(candidates(files, rules), "file")
    if commented:
        suffix = F.when(F.col("suffix").isin(*commented), F.col("suffix")).otherwise("")
        cleaned = F.coalesce(without_comments(F.when(has_comments(F.col("text"), suffix), F.col("text")), suffix), F.col("text"))
    else:
        cleaned = F.col("text")
    read = read.withColumn("cleaned", cleaned).withColumn("__lower", F.lower("text"))
    platforms = F.col("platforms") if "platforms" in sources.columns else None

    def applies(r: Column) -> Column:
        listed = (F.size(r["suffixes"]) == 0) | F.array_contains(r["suffixes"], F.col("suffix"))
        markup = (F.col("suffix") != ".xml") | ~F.array_contains(r["suffixes"], ".xml") | F.col("text").rlike(r"^[﻿ \t\r\n]*<")
        ok = listed & markup
        if platforms is not None:
            apple = r["rule_id"].isin(*APPLE_SYMBOL_RULES) & F.col("__apple")
            ok = ok & (r["platform"].isNull() | F.array_contains(platforms, r["platform"]) | apple)
        return ok

    def holds(r: Column) -> Column:
        # the lines tell whether the only literal of a rule is there; nothing else has to search the text for it
        announced = r["literal"].isNull() | F.coalesce(F.size(r["in_line"]) == 1, F.lit(False)) | F.contains(F.col("__lower"), r["literal"])
        needed = r["requires"].isNull() | F.rlike(F.col("cleaned"), r["requires"])
        met = r["in_line"].isNotNull() | F.rlike(F.col("cleaned"), r["pattern"])  # those in a line are judged by their lines
        return F.coalesce(announced & applies(r) & needed & met, F.lit(False))

    def whole_rows(r: Column) -> Column:
        every = F.regexp_replace(F.col("cleaned"), r["pattern"], F.lit(MARK + "$0"))
        return matched_lines(F.when(r["once_per_file"], marked_first(F.col("cleaned"), r["pattern"])).otherwise(every), F.col("text"))

    def line_rows(r: Column, lines: Column) -> Column:
        near = F.transform(F.filter(r["lines"], lambda n: n <= F.size(lines)), lambda n: F.element_at(lines, n))
        held = F.filter(F.coalesce(near, lines), lambda x: F.exists(r["in_line"], lambda e: F.contains(x["lower"], e)))
        counted = F.transform(held, lambda x: F.struct(x["line"].alias("line"), F.regexp_count(x["cleaned"], r["pattern"]).alias("matches"), x["content"].alias("content")))
        found = F.filter(counted, lambda x: x["matches"] > 0)
        once = F.transform(F.slice(found, 1, 1), lambda x: F.struct(x["line"].alias("line"), F.lit(1).alias("matches"), x["content"].alias("content")))
        return F.when(r["once_per_file"], once).otherwise(found)

    def hit(r: Column, lines: Column) -> Column:
        rows = F.when(r["in_line"].isNotNull(), line_rows(r, lines)).otherwise(whole_rows(r))
        return let(rows, lambda rows: F.struct(
            r["rule_id"].alias("rule_id"), r["severity"].alias("severity"), r["masvs"].alias("masvs"),
            F.aggregate(rows, F.lit(0), lambda n, x: n + x["matches"]).alias("file_matches"), first_matches(rows, match_cap).alias("rows"),
        ))

    # a rule with several literals in a file is judged by the first of them that the file holds
    def first(r: Column) -> Column:
        return ~F.exists(r["earlier"], lambda e: F.contains(F.col("__lower"), e))

    both = F.arrays_zip(F.split("cleaned", "\n").alias("c"), F.split("text", "\n").alias("o"))
    lines = F.transform(both, lambda x, i: F.struct((i + 1).alias("line"), x["c"].alias("cleaned"), F.lower(x["c"]).alias("lower"), x["o"].alias("content")))
    judged = F.filter("rules", lambda r: holds(r) & first(r))
    hits = let(lines, lambda lines: F.transform(judged, lambda r: hit(r, lines)))
    found = read.select("app_id", "path", F.explode(hits).alias("hit"))
    rows = found.select("app_id", "path", "hit.rule_id", "hit.severity", "hit.masvs", "hit.file_matches", F.explode("hit.rows").alias("m"))
    return line_findings(rows, match_cap)
