"""Filters, projections and validity splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import ranks
from sightline.functions.packages import advisory_package_name
from sightline.scale import bounded_rows

# Words of the predicates below.
MOBILE_VENDORS = ("apple", "android", "chromium", "qualcomm", "pixel", "webkit")
UNSHIPPED_WORDS = ("test", "debug", "benchmark", "nonminified", "lint", "kapt", "ksp", "annotationprocessor")
CHIP_VENDORS = ("qualcomm", "mediatek", "arm", "imagination", "unisoc", "nvidia", "broadcom")


def select_findings(findings: DataFrame, severity: str | None = None, status: str | None = None) -> DataFrame:
    """Findings of one severity and/or status; unknown names are refused."""
    if severity is not None and severity not in ranks.SEVERITIES:
        raise ValueError(f"unknown severity {severity}")
    if status is not None and status not in ranks.STATUSES:
        raise ValueError(f"unknown status {status}")
    out = findings
    if severity:
        out = out.where(F.col("severity") == severity)
    if status:
        out = out.where(F.col("status") == status)
    return out


def section_counts(sections: dict[str, DataFrame], key: str = "report_id") -> DataFrame:
    """Rows per report and report section."""
    out = None
    for name, frame in sections.items():
        part = frame.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).withColumn("section", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def state_histogram(coverage: DataFrame, key: str = "report_id") -> DataFrame:
    return coverage.groupBy(key, "state").agg(F.count(F.lit(1)).alias("entries"))


def search_newest(records: DataFrame, columns: Sequence[str], needle: str, limit: int) -> DataFrame:
    """Newest records that contain the literal text (case-insensitively) in any of the columns."""
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.contains(F.lower(F.col(column)), F.lower(F.lit(needle)))
    return records.where(hit).orderBy(F.col("modified").desc(), F.col("id")).limit(limit)


def without_excerpts(findings: DataFrame, evidence: str = "evidence", fields: Sequence[str] = ("excerpt",)) -> DataFrame:
    """Evidence rows without the named fields, at the top level and in nested traces."""

    def drop(row: Column) -> Column:
        return row.dropFields(*fields)

    return findings.withColumn(evidence, F.transform(F.col(evidence), drop))


def sanitized(findings: DataFrame) -> DataFrame:
    """Identity, rating and bare locations of findings."""
    return findings.select(
        "report_id", "id", "rule_id", "severity", "status",
        F.transform("evidence", lambda e: F.struct(e["path"].alias("path"), e["line"].alias("line"))).alias("locations"),
    )


def mobile_exploited(vendor: Column, product: Column) -> Column:
    """Known-exploited entry of a mobile platform or browser engine vendor."""
    text = F.lower(F.concat_ws(" ", F.coalesce(vendor, F.lit("")), F.coalesce(product, F.lit(""))))
    return text.rlike("|".join(MOBILE_VENDORS))


def relevant_record(state: Column, body: Column, words: Sequence[str]) -> Column:
    """A rejected record, or one that mentions a platform word."""
    return (state == "REJECTED") | F.lower(body).rlike("|".join(words))


def shipped_configuration(name: Column) -> Column:
    """A build configuration whose classpath ships."""
    lowered = F.lower(name)
    return lowered.endswith("runtimeclasspath") & ~lowered.rlike("|".join(UNSHIPPED_WORDS))


def vendor_scope(component: Column) -> Column:
    """Chipset vendor a component names, else kernel or platform."""
    lowered = F.lower(F.coalesce(component, F.lit("")))
    scope = F.when(lowered.rlike(r"\bkernel\b"), "kernel").otherwise("platform")
    for vendor in reversed(CHIP_VENDORS):
        scope = F.when(lowered.rlike(rf"\b{vendor}\b"), vendor).otherwise(scope)
    return scope


def glob_to_regex(pattern: str) -> str:
    """Anchored Java expression of a shell pattern."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        close = pattern.find("]", i + 2) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[" and close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body.replace("^", "\\^", 1) if body[0] == "^" else body) + "]")
            i = close
        else:
            out.append("\\" + char if not char.isalnum() and char != "_" and char.isascii() else char)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def transmittable(deps: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Dependencies no exclusion covers.

    ``exclusions``: (kind, pattern) with kind ecosystem, name or coordinate. The patterns are configuration; they
    become one literal expression per kind instead of a join.
    """
    patterns: dict[str, list[str]] = {"ecosystem": [], "name": [], "coordinate": []}
    for row in bounded_rows(exclusions, "transmission exclusions", 768):
        if row["kind"] not in patterns or not row["pattern"]:
            raise ValueError("an exclusion needs a known kind and a pattern")
        patterns[row["kind"]].append(glob_to_regex(row["pattern"]))
    names = F.array_distinct(F.array_compact(F.array(F.col("name"), advisory_package_name(F.col("ecosystem"), F.col("name")))))
    out = F.lit(False)
    for regex in patterns["ecosystem"]:
        out = out | F.col("ecosystem").rlike(regex)
    for kind, prefix in (("name", None), ("coordinate", "ecosystem")):
        for regex in patterns[kind]:
            out = out | _any_matches(names, regex, prefix)
    if patterns["name"] or patterns["coordinate"]:
        # An identity that cannot be resolved never bypasses an active name policy.
        unresolved = (F.col("ecosystem") == "SwiftURL") & advisory_package_name(F.col("ecosystem"), F.col("name")).isNull()
        out = out | unresolved
    return deps.where(~out)


def _any_matches(names: Column, regex: str, prefix: str | None) -> Column:
    if prefix is None:
        return F.exists(names, lambda n: n.rlike(regex))
    return F.exists(names, lambda n: F.concat(F.col(prefix), F.lit(":"), n).rlike(regex))


def without_overridden_cleartext(findings: DataFrame, parsed_configs: DataFrame, min_sdk: DataFrame) -> DataFrame:
    """Manifest cleartext rows dropped where a parsed network configuration decides (minSdk 24 and later)."""
    decided = parsed_configs.join(min_sdk.where(F.col("min_sdk") >= 24).select("app_id"), "app_id", "left_semi")
    manifest = (F.col("rule_id") == "ANDROID-CLEARTEXT") & F.col("from_manifest")
    kept = findings.where(~manifest)
    return kept.unionByName(
        findings.where(manifest).join(decided.select("app_id", "path").distinct(), ["app_id", "path"], "left_anti")
    )


def demote_ambiguous(findings: DataFrame, ambiguous: Column) -> DataFrame:
    """Configuration-confirmed rows become candidates where the configuration is ambiguous."""
    status = F.when(ambiguous & (F.col("status") == "configuration-confirmed"), "candidate").otherwise(F.col("status"))
    return findings.withColumn("status", status)


def demote_unfingerprinted(coverage: DataFrame, inventory: DataFrame) -> DataFrame:
    """Examined coverage becomes partial where the input fingerprint is incomplete."""
    rows = coverage.join(inventory.select("report_id", "fingerprint_complete"), "report_id", "left")
    short = ~F.coalesce(F.col("fingerprint_complete"), F.lit(True))
    state = F.when(short & F.col("state").isin("checked", "limited"), "partial").otherwise(F.col("state"))
    return rows.withColumn("state", state).drop("fingerprint_complete")


def without_intelligence(findings: DataFrame) -> DataFrame:
    """Findings that survive a reassessment: everything not derived from intelligence."""
    return findings.where(
        ~((F.coalesce("origin", F.lit("builtin")) == "intelligence") | F.col("rule_id").rlike("^(?:CVE-|GHSA-|OSV-|OS-CVE-)"))
    )


def split_valid(findings: DataFrame, key: str = "report_id") -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): rejects carry ``invalid-finding`` or ``duplicate-finding-id``.

    Of several valid rows with one id the least row (by all columns) is kept; the others are duplicates.
    """
    text = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    ok = (
        text("id") & text("rule_id")
        & F.coalesce(F.col("severity").isin(*ranks.SEVERITIES), F.lit(False))
        & F.coalesce(F.col("status").isin(*ranks.STATUSES), F.lit(False))
    )
    columns = findings.columns
    good = findings.where(ok)
    order = F.struct(*columns)
    first = good.groupBy(key, "id").agg(F.min_by(F.struct(*columns), order).alias("r"), F.count(F.lit(1)).alias("n"))
    valid = first.select("r.*")
    invalid = findings.where(~ok).groupBy(key).agg(F.count(F.lit(1)).alias("rows")).withColumn("code", F.lit("invalid-finding"))
    twice = first.where("n > 1").groupBy(key).agg(F.sum(F.col("n") - 1).alias("rows")).withColumn("code", F.lit("duplicate-finding-id"))
    return valid, invalid.unionByName(twice)


def under_roots(reports: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Reports whose target is one of the roots or lies below one."""
    ok = F.lit(False)
    for root in roots:
        ok = ok | (F.col("target") == root) | F.col("target").startswith(root.rstrip("/") + "/")
    return reports.where(ok)


def link_candidates(links: DataFrame, cap: int | None = None, length: int | None = None) -> DataFrame:
    """Deep-link addresses worth a runtime step in declaration order; ``cap`` per app and ``length`` limit them where asked for."""
    from sightline.scale import top_k

    usable = (
        (F.coalesce("bundle_role", F.lit("")) != "embedded") & (F.coalesce("scheme", F.lit("")) != "")
        & ~F.contains(F.coalesce("host", F.lit("")), F.lit("*"))
        & F.coalesce("path_kind", F.lit("")).isin("", "path", "pathPrefix")
    )
    port = F.when(F.coalesce("port", F.lit("")) != "", F.concat(F.lit(":"), "port")).otherwise("")
    pick = lambda c, default: F.when(F.coalesce(c, F.lit("")) == "", default).otherwise(F.col(c))
    url = F.concat("scheme", F.lit("://"), pick("host", "test"), port, pick("path", "/"))
    rows = links.where(usable).withColumn("url", url)
    if length is not None:
        rows = rows.where(F.length("url") <= length)
    return top_k(rows, ["app_id"], [F.col("position")], cap).select("app_id", "rank", "url")

