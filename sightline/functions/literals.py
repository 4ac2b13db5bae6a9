"""Literals that every match of a regular expression holds, for indexing rules by the text they need."""

from __future__ import annotations

import re

LEAST = 3
_UNICODE_FLAG = re.compile(r"\(\?[a-zA-Z-]*[uU]")  # letters beyond ASCII may then stand for ASCII ones
_CLASSES = "dDwWsSbBAzZGvVhHRpPxXuckQE0123456789nrtfae"


def _skip_class(pattern: str, at: int) -> int:
    """The place after the character class that opens at ``at``; classes may nest."""
    depth, k = 0, at
    while k < len(pattern):
        if pattern[k] == "\\":
            k += 1
        elif pattern[k] == "[":
            depth += 1
            k += pattern.startswith("^", k + 1)
            k += pattern.startswith("]", k + 1)
        elif pattern[k] == "]":
            depth -= 1
            if depth == 0:
                return k + 1
        k += 1
    return k


def _skip_group(pattern: str, at: int) -> int:
    """The place after the group that opens at ``at``."""
    depth, k = 0, at
    while k < len(pattern):
        if pattern[k] == "\\":
            k += 1
        elif pattern[k] == "[":
            k = _skip_class(pattern, k)
            continue
        elif pattern[k] == "(":
            depth += 1
        elif pattern[k] == ")":
            depth -= 1
            if depth == 0:
                return k + 1
        k += 1
    return k


def _alternatives(pattern: str) -> list[str]:
    parts, start, k = [], 0, 0
    while k < len(pattern):
        if pattern[k] == "\\":
            k += 2
        elif pattern[k] == "[":
            k = _skip_class(pattern, k)
        elif pattern[k] == "(":
            k = _skip_group(pattern, k)
        elif pattern[k] == "|":
            parts.append(pattern[start:k])
            start = k = k + 1
        else:
            k += 1
    return [*parts, pattern[start:]]


def _best(sets: list[list[str]]) -> list[str]:
    """The set whose shortest literal is longest; an empty list if none is long enough."""
    usable = [s for s in sets if s and min(map(len, s)) >= LEAST]
    return max(usable, key=lambda s: (min(map(len, s)), -len(s)), default=[])


def required_literals(pattern: str | None) -> list[str]:
    """Lower-case literals of three characters or more, at least one of which every match holds whatever its case.

    An empty list says that no such set was found, as for patterns of classes alone, with quoting,
    octal escapes, Unicode case or free spacing.
    Letters whose case folding is not one to one (beyond ASCII) end a literal.
    """
    if not pattern or "\\Q" in pattern or "\\0" in pattern or "(?x" in pattern or _UNICODE_FLAG.search(pattern):
        return []
    branches = _alternatives(pattern)
    if len(branches) > 1:
        found = [required_literals(b) for b in branches]
        return sorted({x for f in found for x in f}) if all(found) else []
    sets: list[list[str]] = []
    run: list[str] = []

    def close() -> None:
        if run:
            sets.append(["".join(run)])
            run.clear()

    k = 0
    while k < len(pattern):
        char, group = pattern[k], None
        literal = None
        if char == "\\":
            following = pattern[k + 1 : k + 2]
            if following and following not in _CLASSES:
                literal = following
            k += 2
            if following in "pPxuck":  # an escape with an argument: nothing after it is taken for granted
                close()
                return _best(sets)
        elif char == "[":
            k = _skip_class(pattern, k)
        elif char == "(":
            end = _skip_group(pattern, k)
            body = pattern[k + 1 : end - 1]
            k = end
            if not body.startswith("?"):
                group = body
            elif body.startswith(("?:", "?>", "?i:")):
                group = body[body.index(":" if ":" in body[:3] else ">") + 1 :]
            elif "x" in body[1 : body.find(":") if ":" in body[:8] else None][:6]:
                return []
        else:
            if char not in ".^$*+?{|)":
                literal = char
            k += 1
        quantified = pattern[k : k + 1]
        optional = quantified in ("?", "*") and quantified != "" or quantified == "{" and not pattern[k + 1 : k + 2].isdigit() or pattern.startswith("{0", k)
        if literal is not None and literal.isascii() and not optional:
            run.append(literal.lower())
            if quantified in ("+", "{") and quantified:
                close()
        else:
            close()
            if group is not None and not optional:
                sets.append(required_literals(group))
        if quantified and quantified in "?*+{":
            if quantified == "{":
                stop = pattern.find("}", k)
                k = stop + 1 if stop > 0 else k + 1
            else:
                k += 1
            while pattern[k : k + 1] in ("?", "+") and pattern[k : k + 1]:
                k += 1
    close()
    return _best(sets)


# Plain characters, escapes, classes and lookarounds that no line break can take part in; no anchors, no negated classes.
_WITHIN_LINE = re.compile(
    r"(?:\(\?i\))?(?:[^\x00-\x1f\\\[\](){}*+?^$|]|\\[^A-Za-z0-9\x00-\x1f]|\\[bdwS]"
    r"|\[(?!\^)(?:[^\x00-\x1f\\\[\]&^]|\\[^A-Za-z0-9\x00-\x1f]|\\[dw])+\]"
    r"|\((?!\?)|\(\?(?::|=|!|<=|<!)|\)|[*+?|]|\{\d+(?:,\d*)?\})*"
)


def within_line(pattern: str | None) -> bool:
    """Whether matches surely lie in one line and depend on nothing outside it; false where in doubt."""
    return pattern is not None and _WITHIN_LINE.fullmatch(pattern) is not None
