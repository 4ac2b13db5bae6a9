"""Balanced spans that regular expressions cannot delimit: call arguments and function bodies.

Small per-file helpers used inside Arrow batches; files are screened by regex in the JVM first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd

from sightline.functions.text import blank_comments

_OPEN = {"(": ")", "[": "]", "{": "}"}
_CLOSE = {v: k for k, v in _OPEN.items()}
_STEP = re.compile(r'"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`|[()\[\]{},]|["\'`]', re.S)


@lru_cache(maxsize=64)
def _compiled(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern)


def argument_spans(text: str, opening: int) -> tuple[list[tuple[int, int]], int, bool]:
    """Top-level argument spans after the bracket at ``opening``, the end offset, and whether it closed."""
    depth, cursor, start = 0, opening, opening + 1
    spans: list[tuple[int, int]] = []
    while True:
        found = _STEP.search(text, cursor)
        if found is None:
            return spans + [(start, len(text))], len(text), False
        token, cursor = found.group(), found.end()
        if token == '"""':
            close = text.find('"""', cursor)
            if close < 0:
                return spans + [(start, len(text))], len(text), False
            cursor = close + 3
        elif token in _OPEN:
            depth += 1
        elif token in _CLOSE:
            depth -= 1
            if depth == 0:
                if text[start : found.start()].strip() or spans:
                    spans.append((start, found.start()))
                return spans, cursor, True
        elif token == "," and depth == 1:
            spans.append((start, found.start()))
            start = cursor
        elif token in "\"'`":
            # An unclosed literal: the boundary cannot be trusted past this line.
            line_end = text.find("\n", cursor)
            stop = len(text) if line_end < 0 else line_end
            return spans + [(start, stop)], stop, False


_DECLARED = re.compile(
    r"\b(\w+)\s*:\s*([A-Z]\w+)|\b([A-Z]\w+)\s+(\w+)\s*[=;,)]|\b(\w+)\s*=\s*(?:new\s+)?([A-Z]\w+)\s*(?:\.\s*Builder\s*)?\("
)


def declared_types(text: str) -> dict[str, str]:
    """Variable name to the class it is declared as, built with, or typed as in this file."""
    types: dict[str, str] = {}
    for a, b, c, d, e, f in _DECLARED.findall(text):
        name, kind = (a, b) if a else (d, c) if d else (e, f)
        types.setdefault(name, kind)
    return types


_HEAD = re.compile(r"(\w{1,200}|\))\s*\??\s*\.?\s*$")
CALL_SCHEMA = (
    "app_id string, path string, call string, receiver string, receiver_type string, line int, offset int, "
    "byte_offset int, args array<string>, argument_text string, closed boolean"
)


def call_batches(batches: Iterator[pd.DataFrame], pattern: str) -> Iterator[pd.DataFrame]:
    """Calls matching ``pattern`` (which ends with the opening bracket) with their argument texts."""
    columns = [part.split()[0] for part in CALL_SCHEMA.split(", ")]
    find = _compiled(pattern)
    for batch in batches:
        rows = []
        for app, path, raw, suffix in zip(batch["app_id"], batch["path"], batch["text"], batch["suffix"]):
            text = blank_comments(raw, suffix in (".js", ".jsx", ".ts", ".tsx"))
            types: dict[str, str] | None = None
            for match in find.finditer(text):
                spans, end, closed = argument_spans(text, match.end() - 1)
                before = text[max(0, match.start() - 220) : match.start()]
                head = _HEAD.search(before)
                receiver = head.group(1) if head else ""
                if types is None:
                    types = declared_types(text)
                kind = types.get(receiver, "")
                if receiver == ")":
                    window = text[max(0, match.start() - 600) : match.start()]
                    chain = re.findall(r"\b([A-Z]\w+)\s*(?:\.\s*Builder\s*)?\(", window)
                    kind = chain[-1] if chain else ""
                rows.append(
                    (
                        app, path, match.group().rstrip("(").strip(), receiver, kind,
                        text.count("\n", 0, match.start()) + 1, match.start(),
                        len(raw[: match.start()].encode()),
                        [text[a:b].strip() for a, b in spans], text[match.end() : end], closed,
                    )
                )
        yield pd.DataFrame(rows, columns=columns)


_FUNCTION = re.compile(r"\bfunc\s+(\w+)|\binit\s*[?!]?\s*(?=\()")
_STRING = re.compile(r'"""(?:.*?)"""|"(?:\\.|[^"\\\n])*"', re.S)
BODY_SCHEMA = "app_id string, path string, function string, line int, offset int, body string"


def body_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Swift function bodies, braces matched outside comments and strings."""
    columns = [part.split()[0] for part in BODY_SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for app, path, raw in zip(batch["app_id"], batch["path"], batch["text"]):
            text = blank_comments(raw)
            shape = _STRING.sub(lambda m: " " * len(m.group()), text)
            for match in _FUNCTION.finditer(shape):
                opening = shape.find("{", match.end())
                if opening < 0:
                    break
                _, end, closed = argument_spans(shape, opening)
                if closed:
                    rows.append(
                        (app, path, match.group(1) or "init", text.count("\n", 0, opening) + 1, opening, text[opening + 1 : end - 1])
                    )
        yield pd.DataFrame(rows, columns=columns)
