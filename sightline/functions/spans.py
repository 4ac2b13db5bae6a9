"""Match rows over text without leaving the JVM.

A match is marked in place by ``regexp_replace``; the marked text is then cut into lines or pieces, so one
linear pass gives every match its line and offset whatever lines it spans.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\x01"


def clean_mark(text: Column) -> Column:
    """Text in which the marker cannot occur (same length)."""
    return F.translate(text, MARK, " ")


def marked(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, MARK + "$0")


def marked_first(text: Column, pattern: str | Column) -> Column:
    at = F.regexp_instr(text, F.lit(pattern) if isinstance(pattern, str) else pattern)
    return F.when(
        at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit(MARK), F.substr(text, at))
    ).otherwise(text)


def matched_lines(marked_text: Column, original: Column, cap: int | None = None) -> Column:
    """``array<struct<line, matches, content>>`` of the lines on which matches start.

    With ``cap``, only the lines of the first ``cap`` matches.
    """
    lines = F.arrays_zip(F.split(marked_text, "\n").alias("m"), F.split(original, "\n").alias("o"))
    rows = F.transform(
        lines,
        lambda x, i: F.struct(
            (i + 1).alias("line"),
            (F.length(x["m"]) - F.length(F.replace(x["m"], F.lit(MARK), F.lit("")))).alias("matches"),
            x["o"].alias("content"),
        ),
    )
    return first_matches(F.filter(rows, lambda r: r["matches"] > 0), cap)


def first_matches(hits: Column, cap: int | None) -> Column:
    """The lines of the first ``cap`` matches of ``array<struct<line, matches, content>>`` in order; all without a cap."""
    if cap is None:
        return hits
    start = F.struct(F.lit(0).alias("seen"), F.array().cast("array<struct<line:int,matches:int,content:string>>").alias("rows"))
    folded = F.aggregate(
        F.slice(hits, 1, cap),
        start,
        lambda acc, r: F.struct(
            (acc["seen"] + r["matches"]).alias("seen"),
            F.when(acc["seen"] < cap, F.concat(acc["rows"], F.array(r))).otherwise(acc["rows"]).alias("rows"),
        ),
    )
    return folded["rows"]


def matches_with_offsets(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<line, offset, value>>`` of every match; offsets are 0-based characters."""
    pieces = F.split(marked(text, pattern), MARK)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # Piece i ends where match i starts; its length and line breaks accumulate.
    zipped = F.arrays_zip(pieces.alias("p"), values.alias("v"))
    start = F.struct(
        F.lit(0).alias("offset"),
        F.lit(1).alias("line"),
        F.array().cast("array<struct<line:int,offset:int,value:string>>").alias("rows"),
    )

    def step(acc: Column, item: Column) -> Column:
        offset = acc["offset"] + F.length(item["p"])
        line = acc["line"] + F.length(item["p"]) - F.length(F.replace(item["p"], F.lit("\n"), F.lit("")))
        row = F.struct(line.alias("line"), offset.alias("offset"), item["v"].alias("value"))
        return F.struct(
            offset.alias("offset"),
            line.alias("line"),
            F.when(item["v"].isNotNull(), F.concat(acc["rows"], F.array(row))).otherwise(acc["rows"]).alias("rows"),
        )

    return F.aggregate(zipped, start, step)["rows"]
