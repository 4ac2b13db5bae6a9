"""Rule-table scans over text corpora.

The rule table is configuration: it is read once, checked to be small and turned into literal patterns, so a
scan is one narrow pass over the corpus without any join or shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from importlib.resources import files
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.binding import let
from sightline.functions.canonical import finding_identity
from sightline.functions.literals import required_literals
from sightline.functions.spans import MARK, clean_mark, marked, marked_first, matched_lines
from sightline.functions.text import C_FAMILY, code_excerpt, has_comments, without_comments
from sightline.scale import bounded_rows

MATCH_CAP = 30  # the per-file match budget a report may ask for
# Rules about Apple interfaces that any Apple source file can show.
APPLE_SYMBOL_RULES = (
    "IOS-KEYCHAIN-ACCESS",
    "IOS-CRYPTO-WEAK-CIPHER",
    "IOS-ATS-BYPASS-API",
    "IOS-INSECURE-UNARCHIVE",
    "IOS-UIWEBVIEW",
)
APPLE_SUFFIXES = (".swift", ".m", ".mm")
# What a compiled package can hold as source, and the bundle names that are text by convention.
COMPILED_KINDS = ("apk", "ipa")
PACKAGED_SUFFIXES = (".js", ".jsx", ".jsbundle", ".bundle", ".ts", ".tsx", ".dart")
TEXT_BUNDLE_NAMES = ("index.android.bundle", "index.ios.bundle", "main.bundle")
# A module definition or start call of a bundler, and what must be left out before looking for one.
BUNDLE_CALL = r"(?<![\w$.])__[dr]\s*\("
LITERAL_OR_COMMENT = (
    r"""\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`|//[^\n]*+|/\*[\s\S]*?\*/"""
)
CONTROL_BYTES = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


@dataclass(frozen=True)
class Rule:
    """One row of a rule table."""

    rule_id: str
    pattern: str
    severity: str = "medium"
    suffixes: tuple[str, ...] = ()
    platform: str | None = None
    requires: str | None = None
    argument_pattern: str | None = None
    case_sensitive: bool = False
    once_per_file: bool = False
    masvs: str = ""
    maswe: tuple[str, ...] = field(default=())

    @property
    def java_pattern(self) -> str:
        return self.pattern if self.case_sensitive else f"(?i){self.pattern}"


def catalogue() -> list[Rule]:
    """The published source rules."""
    rows = json.loads(files("sightline").joinpath("data", "rules.json").read_text())["rules"]
    return [_rule({**r, "rule_id": r["id"]}) for r in rows]


def _rule(row: dict) -> Rule:
    return Rule(
        rule_id=row["rule_id"],
        pattern=row["pattern"],
        severity=row.get("severity") or "medium",
        suffixes=tuple(row.get("suffixes") or ()),
        platform=row.get("platform") or None,
        requires=row.get("requires") or None,
        argument_pattern=row.get("argument_pattern") or None,
        case_sensitive=bool(row.get("case_sensitive")),
        once_per_file=bool(row.get("once_per_file")),
        masvs=row.get("masvs") or "",
        maswe=tuple(row.get("maswe") or ()),
    )


def rules_from(table: DataFrame) -> list[Rule]:
    """User rules as configuration: a DataFrame with the fields of ``Rule`` (missing ones take their defaults).

    Larger tables are scanned through an index: :func:`sightline.operators.rule_index.scan_table`.
    """
    return [_rule(r.asDict(recursive=True)) for r in bounded_rows(table, "rule table", 1000)]


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    schema = (
        "rule_id string, pattern string, severity string, suffixes array<string>, platform string, requires string, "
        "argument_pattern string, case_sensitive boolean, once_per_file boolean, masvs string, maswe array<string>"
    )
    rows = [
        (r.rule_id, r.pattern, r.severity, list(r.suffixes), r.platform, r.requires, r.argument_pattern,
         r.case_sensitive, r.once_per_file, r.masvs, list(r.maswe))
        for r in rules
    ]
    return spark.createDataFrame(rows, schema)


def admitted_bundle(path: Column, text: Column) -> Column:
    """Whether a ``.bundle`` file is source: text under a conventional name, or with a bundler's module call in its code."""
    named = F.element_at(F.split(path, "/"), -1).isin(*TEXT_BUNDLE_NAMES)
    coded = text.rlike(BUNDLE_CALL) & F.regexp_replace(text, LITERAL_OR_COMMENT, " ").rlike(BUNDLE_CALL)
    return ~text.rlike(CONTROL_BYTES) & (named | coded)


def admitted(sources: DataFrame) -> DataFrame:
    """Files that source rules may read: recognized bundles, and in a compiled package (an ``input_kind`` of apk or ipa)
    hybrid sources only. A null kind is a source tree."""
    kept = sources.where((F.col("suffix") != ".bundle") | admitted_bundle(F.col("path"), F.col("text")))
    if "input_kind" in sources.columns:
        compiled = F.coalesce(F.col("input_kind").isin(*COMPILED_KINDS), F.lit(False))
        kept = kept.where(~compiled | F.col("suffix").isin(*PACKAGED_SUFFIXES))
    return kept


def excluded_spans(exclusions: DataFrame) -> DataFrame:
    """``exclusions`` (app_id, path, rule_id, start, end; UTF-8 bytes) with the greatest end per start, one row a file.

    A file's spans are pre-aggregated per start and gathered beside its text, which is one row as well.
    """
    spans = exclusions.groupBy("app_id", "path", "rule_id", "start").agg(F.max("end").alias("end"))
    return spans.groupBy("app_id", "path").agg(F.collect_list(F.struct("rule_id", "start", "end")).alias("__spans"))


def _own_spans(rule_id: str) -> Column:
    return F.filter("__spans", lambda s: s["rule_id"] == rule_id)


def _character(text: Column, place: Column) -> Column:
    """Characters before a byte offset; null inside a character or beyond the text."""
    before = F.substring(text.cast("binary"), F.lit(1), place.cast("int")).cast("string")
    whole = (F.octet_length(F.substr(text, F.lit(1), F.length(before))) == place) & (place <= F.octet_length(text))
    return F.when(whole, F.length(before))


def _without_excluded(marked_text: Column, values: Column, spans: Column, cap: int | None) -> Column:
    """``marked_text`` less the marks of matches that begin where a span does and end within it.

    One fold over the pieces between marks finds the excluded matches by running length, so the cost is linear in the
    matches for each span. With ``cap`` only the first matches keep their marks, excluded ones counted.
    """
    pieces = F.split(marked_text, MARK)
    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(pieces) - 1).alias("p"), F.slice(values, 1, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("v"))
    start = F.struct(F.lit(0).alias("offset"), F.lit(0).alias("index"), F.array().cast("array<int>").alias("dropped"))

    def step(acc: Column, item: Column) -> Column:
        offset = acc["offset"] + F.length(item["p"])
        inside = F.exists(spans, lambda s: (s["start"] == offset) & (offset + F.length(item["v"]) <= s["end"]))
        index = acc["index"] + 1
        dropped = F.when(inside, F.concat(acc["dropped"], F.array(index))).otherwise(acc["dropped"])
        return F.struct(offset.alias("offset"), index.alias("index"), dropped.alias("dropped"))

    dropped = F.aggregate(zipped, start, step)["dropped"]

    def rebuilt(out: Column) -> Column:
        keep = lambda i: (i > 0) & ~F.array_contains(out, i) & (F.lit(True) if cap is None else i <= cap)
        return F.array_join(F.transform(pieces, lambda p, i: F.concat(F.when(keep(i), MARK).otherwise(""), p)), "")

    return let(dropped, rebuilt)


def _applies(rule: Rule, suffix: Column, platforms: Column | None) -> Column:
    ok = suffix.isin(*rule.suffixes) if rule.suffixes else F.lit(True)
    if rule.platform and platforms is not None:
        wanted = F.array_contains(platforms, rule.platform)
        if rule.rule_id in APPLE_SYMBOL_RULES:
            wanted = wanted | F.col("__apple")
        ok = ok & wanted
    if rule.rule_id and ".xml" in rule.suffixes:
        ok = ok & ((suffix != ".xml") | F.col("text").rlike(r"^[﻿ \t\r\n]*<"))
    return ok


def _may_match(rule: Rule, lowered: Column) -> Column:
    """Whether the lower-cased text holds literals that a match of the rule needs; texts without them need no pattern."""
    needed = [literals for literals in map(required_literals, (rule.pattern, rule.requires)) if literals]
    held = [reduce(or_, [F.contains(lowered, F.lit(x)) for x in literals]) for literals in needed]
    return reduce(and_, held, F.lit(True))


def _with_apple(sources: DataFrame, rules: Sequence[Rule] | Sequence[str]) -> DataFrame:
    """Adds ``__apple``, whether the app has an Apple source, where a rule (or rule id) asks for it: headers beside such a
    source count."""
    asked = any(r in APPLE_SYMBOL_RULES if isinstance(r, str) else r.platform and r.rule_id in APPLE_SYMBOL_RULES for r in rules)
    if "platforms" not in sources.columns or not asked:
        return sources.withColumn("__apple", F.lit(False))
    apple = sources.where(F.col("suffix").isin(*APPLE_SUFFIXES))
    if "input_kind" in sources.columns:  # a compiled package holds no Apple sources
        apple = apple.where(~F.coalesce(F.col("input_kind").isin(*COMPILED_KINDS), F.lit(False)))
    apps = apple.select(F.col("app_id").alias("__apple_app")).distinct()
    joined = sources.join(apps, F.col("app_id") == F.col("__apple_app"), "left")
    return joined.withColumn("__apple", F.col("__apple_app").isNotNull()).drop("__apple_app")


def cleaned_corpus(sources: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Files some rule applies to, with ``cleaned`` text; only files that hold comments visit Python."""
    sources = admitted(_with_apple(sources, rules))
    text, suffix = clean_mark(F.col("text")), F.col("suffix")
    platforms = F.col("platforms") if "platforms" in sources.columns else None
    wanted = F.lit(False)
    for rule in rules:
        ok = _applies(rule, suffix, platforms)
        wanted = wanted | ((ok & F.col("text").rlike(rule.requires)) if rule.requires else ok)
    kept = sources.where(wanted).withColumn("text", text)
    suffixes = {s for r in rules for s in r.suffixes}
    if not suffixes & {*C_FAMILY, ".xml"}:
        return kept.withColumn("cleaned", F.col("text"))
    blanked = without_comments(F.when(has_comments(F.col("text"), suffix), F.col("text")), suffix)
    return kept.withColumn("cleaned", F.coalesce(blanked, F.col("text")))


def scan(sources: DataFrame, rules: Sequence[Rule], match_cap: int | None = None, exclusions: DataFrame | None = None) -> DataFrame:
    """One row per (file, rule, line) on which matches start.

    ``sources``: app_id, path, suffix, text and optionally platforms and input_kind. All matches are kept unless a
    ``match_cap`` per (file, rule) is asked for; ``file_matches`` always holds the full count.

    ``exclusions`` (app_id, path, rule_id, start, end; UTF-8 bytes of the text) leave out the matches of that rule that
    begin at ``start`` and end at ``end`` or before, for instance calls that another analysis has judged; they still count
    in ``file_matches`` and against the cap, and of a rule reported once per file only the first match is looked at. A span
    that begins inside a character excludes nothing. In files with spans for a rule ``matches`` counts within the cap.
    """
    suffix = F.col("suffix")
    platforms = F.col("platforms") if "platforms" in sources.columns else None
    corpus = cleaned_corpus(sources, rules)
    if exclusions is not None:
        joined = corpus.join(excluded_spans(exclusions), ["app_id", "path"], "left")
        ascii_only = F.octet_length("text") == F.length("text")
        place = lambda b: F.when(ascii_only, b).otherwise(_character(F.col("text"), b))
        spans = F.transform("__spans", lambda s: F.struct(s["rule_id"].alias("rule_id"), place(s["start"]).alias("start"), place(s["end"]).alias("end")))
        corpus = joined.withColumn("__spans", F.when(F.col("__spans").isNotNull(), spans))
    corpus = corpus.withColumn("__lower", F.lower("cleaned"))
    hits = []
    for rule in rules:
        here = _applies(rule, suffix, platforms) & _may_match(rule, F.col("__lower"))
        if rule.requires:
            here = here & F.col("cleaned").rlike(rule.requires)
        here = here & F.col("cleaned").rlike(rule.java_pattern)
        mark = marked_first if rule.once_per_file else marked
        text_marked = mark(F.col("cleaned"), rule.java_pattern)
        if exclusions is not None:
            own = _own_spans(rule.rule_id)
            values = F.regexp_extract_all("cleaned", F.lit(rule.java_pattern), F.lit(0))
            cut = _without_excluded(text_marked, values, own, match_cap)
            text_marked = F.when(F.coalesce(F.size(own), F.lit(0)) > 0, cut).otherwise(text_marked)
        hits.append(
            F.when(
                here,
                F.struct(
                    F.lit(rule.rule_id).alias("rule_id"),
                    F.lit(rule.severity).alias("severity"),
                    F.lit(rule.masvs).alias("masvs"),
                    text_marked.alias("marked"),
                    (F.lit(1) if rule.once_per_file else F.regexp_count("cleaned", F.lit(rule.java_pattern))).alias(
                        "file_matches"
                    ),
                ),
            )
        )
    return finding_rows(corpus.select("app_id", "path", "text", F.explode(F.array_compact(F.array(*hits))).alias("hit")), match_cap)


def finding_rows(found: DataFrame, match_cap: int | None) -> DataFrame:
    """Findings of (app_id, path, text, hit) rows; ``hit`` holds the rule's fields, its marked text and its match count."""
    rows = found.select(
        "app_id", "path", "hit.rule_id", "hit.severity", "hit.masvs", "hit.file_matches",
        F.explode(matched_lines(F.col("hit.marked"), F.col("text"), match_cap)).alias("m"),
    )
    return line_findings(rows, match_cap)


def line_findings(rows: DataFrame, match_cap: int | None) -> DataFrame:
    """Findings of (app_id, path, rule_id, severity, masvs, file_matches, m) rows, ``m`` a line, its matches and content."""
    line = F.col("m.line")
    evidence = F.array(F.struct(line.alias("line"), F.col("path").alias("path")))
    return rows.select(
        "app_id", "path", "rule_id", "severity", F.lit("candidate").alias("status"), "masvs",
        line.alias("line"), F.col("m.matches").alias("matches"), "file_matches",
        (F.lit(False) if match_cap is None else F.col("file_matches") > match_cap).alias("truncated"),
        code_excerpt(F.col("m.content")).alias("excerpt"),
        finding_identity(F.col("rule_id"), evidence, ("line", "path")).alias("id"),
    )


def scan_coverage(sources: DataFrame, rules: Sequence[Rule], findings: DataFrame | None = None) -> DataFrame:
    """State of every rule for every app: not-applicable, not-run, checked or partial (a capped file)."""
    has_platforms = "platforms" in sources.columns
    sources = _with_apple(sources, rules)
    readable = admitted(sources)  # files that are no source still name their app
    if ".bundle" in {s for r in rules for s in r.suffixes} or "input_kind" in sources.columns:
        columns = ["app_id", "__apple", *(["platforms"] if has_platforms else [])]
        apps = sources.select(*columns, F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("int").alias("__file")).distinct()
        sources = readable.select(*columns, "suffix", F.lit(1).alias("__file")).unionByName(apps)
    else:
        sources = sources.withColumn("__file", F.lit(1))
    kinds = sorted({r.platform for r in rules if r.platform})
    # The union of the platforms of an app's files of one suffix, over the platforms that some rule names.
    listed = [F.bool_or(F.coalesce(F.array_contains("platforms", k), F.lit(False))).alias(f"__on_{n}") for n, k in enumerate(kinds)] if has_platforms else []
    by_suffix = sources.groupBy("app_id", "suffix", "__apple").agg(F.count("__file").alias("files"), *listed)
    if has_platforms:
        named = F.array_compact(F.array(*[F.when(F.col(f"__on_{n}"), F.lit(k)) for n, k in enumerate(kinds)])) if kinds else F.array().cast("array<string>")
        by_suffix = by_suffix.withColumn("platforms", named)
    suffix = F.col("suffix")
    platforms = F.col("platforms") if has_platforms else None
    items = []
    for rule in rules:
        suffix_ok = suffix.isin(*rule.suffixes) if rule.suffixes else F.lit(True)
        platform_ok = F.lit(True)
        if rule.platform and platforms is not None:
            platform_ok = F.array_contains(platforms, rule.platform)
            if rule.rule_id in APPLE_SYMBOL_RULES:
                platform_ok = platform_ok | F.col("__apple")
        items.append(
            F.struct(
                F.lit(rule.rule_id).alias("rule_id"),
                platform_ok.alias("applicable"),
                F.when(suffix_ok & platform_ok, F.col("files")).otherwise(F.lit(0)).alias("files"),
            )
        )
    per_rule = by_suffix.select("app_id", F.explode(F.array(*items)).alias("r")).groupBy("app_id", "r.rule_id").agg(
        F.bool_or("r.applicable").alias("applicable"), F.sum("r.files").alias("files")
    )
    if findings is not None:
        cut = findings.groupBy("app_id", "rule_id").agg(F.bool_or("truncated").alias("truncated"))
        per_rule = per_rule.join(cut, ["app_id", "rule_id"], "left")
    else:
        per_rule = per_rule.withColumn("truncated", F.lit(False))
    truncated = F.coalesce(F.col("truncated"), F.lit(False))
    state = (
        F.when(~F.col("applicable"), "not-applicable").when(F.col("files") == 0, "not-run")
        .when(truncated, "partial").otherwise("checked")
    )
    return per_rule.select(
        "app_id", "rule_id", state.alias("state"), F.lit("source-pattern").alias("method"), "files",
        truncated.alias("truncated"),
    )


def union_detectors(parts: dict[str, DataFrame]) -> DataFrame:
    """Detector outputs as one table, each row tagged with its origin."""
    out = None
    for origin, frame in parts.items():
        tagged = frame.withColumn("origin", F.lit(origin))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
