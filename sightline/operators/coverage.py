"""Coverage: state lattices, weakness matrix, checklists, summaries and export groups.

States are folded as bit masks, so every roll-up is a mergeable aggregate whatever the group size.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import ranks
from sightline.scale import bounded_rows, top_k

PARTIAL, LIMITED, CHECKED, NOT_RUN, NOT_APPLICABLE = 1, 2, 4, 8, 16
# Identifiers whose findings are correlated intelligence, and the rule they share.
ADVISORY_PREFIXES = ("CVE-", "GHSA-", "OSV-")
ADVISORY_RULE = "DEPENDENCY-CVE"


def weaknesses(spark: SparkSession) -> DataFrame:
    """Weakness taxonomy: id, title, platform, masvs, cwe, beta."""
    rows = json.loads(files("sightline").joinpath("data", "weaknesses.json").read_text())["weaknesses"]
    schema = "id string, title string, platform array<string>, masvs array<string>, cwe array<string>, beta array<string>"
    return spark.createDataFrame([tuple(r.get(k) for k in ("id", "title", "platform", "masvs", "cwe", "beta")) for r in rows], schema)


def rule_weaknesses(spark: SparkSession) -> DataFrame:
    """Bridge (rule_id, weakness_id)."""
    mapping = json.loads(files("sightline").joinpath("data", "rule_weaknesses.json").read_text())["rules"]
    return spark.createDataFrame([(r, w) for r, ws in mapping.items() for w in ws], "rule_id string, weakness_id string")


def state_bit(state: Column) -> Column:
    return (
        F.when(state == "partial", PARTIAL).when(state == "limited", LIMITED).when(state == "checked", CHECKED)
        .when(state == "not-applicable", NOT_APPLICABLE).otherwise(NOT_RUN)
    )


def state_mask(state: Column) -> Column:
    """Aggregate: the set of states as bits."""
    return F.bit_or(state_bit(state))


def rule_state(mask: Column) -> Column:
    """State of one rule from its entries; not-applicable entries are neutral."""
    effective = mask.bitwiseAND(F.lit(15))
    examined = effective.bitwiseAND(F.lit(LIMITED | CHECKED)) != 0
    unexamined = effective.bitwiseAND(F.lit(NOT_RUN)) != 0
    return (
        F.when(mask.isNull() | (mask == 0), "not-run")
        .when(effective == 0, "not-applicable")
        .when((effective.bitwiseAND(F.lit(PARTIAL)) != 0) | (examined & unexamined), "partial")
        .when(effective == CHECKED, "checked")
        .when(~unexamined, "limited")
        .otherwise("not-run")
    )


def aggregate_state(mask: Column) -> Column:
    """State across related rules, from the set of their rule states."""
    effective = mask.bitwiseAND(F.lit(15))
    examined = LIMITED | CHECKED
    return (
        F.when(mask.isNull() | (mask == 0), "not-run")
        .when(effective == 0, "not-applicable")
        .when(effective == CHECKED, "checked")
        .when(effective.bitwiseAND(F.lit(PARTIAL | NOT_RUN)) == 0, "limited")
        .when(effective.bitwiseAND(F.lit(examined | PARTIAL)) != 0, "partial")
        .otherwise("not-run")
    )


def rule_states(coverage: DataFrame, keys: Sequence[str] = ("report_id",)) -> DataFrame:
    """One state per (keys, rule)."""
    return coverage.groupBy(*keys, "rule_id").agg(state_mask(F.col("state")).alias("mask")).select(
        *keys, "rule_id", rule_state(F.col("mask")).alias("state")
    )


def severity_summary(findings: DataFrame) -> DataFrame:
    """Findings, matches and files per rule and severity."""
    return findings.groupBy("rule_id", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.sum("matches").alias("matches"),
        F.count_distinct("path").alias("files"),
    )


def summarize(findings: DataFrame, coverage: DataFrame, key: str = "report_id") -> DataFrame:
    """Report summary counts; a report without rows on one side counts zero there."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    left = findings.groupBy(key).agg(
        F.count(F.lit(1)).alias("findings"),
        one(F.col("status").isin("runtime-confirmed", "configuration-confirmed")).alias("confirmed"),
        one(F.col("status") == "candidate").alias("candidates"),
        one(F.col("status") == "version-affected").alias("version_affected"),
    )
    right = coverage.groupBy(key).agg(
        one(F.col("state") == "not-run").alias("not_run"),
        one(F.col("state") == "partial").alias("partial"),
        F.bool_or(F.col("state") == "partial").alias("incomplete"),
        F.bool_or(F.col("state") == "limited").alias("limited"),
    )
    counts = ["findings", "confirmed", "candidates", "version_affected", "not_run", "partial"]
    joined = left.join(right, key, "full_outer")
    return joined.select(
        key, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
        *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("incomplete", "limited")],
    )


def finding_weaknesses(findings: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row per (finding, weakness): the finding's own mapping, else its rule's; advisories share one rule."""
    columns = findings.columns
    origin = F.col("origin") if "origin" in columns else F.lit("builtin")
    scope = F.col("scope") if "scope" in columns else F.lit("app")
    advisory = (origin == "intelligence") | F.col("rule_id").rlike("^(?:" + "|".join(ADVISORY_PREFIXES) + ")")
    mapped = F.coalesce(F.col("maswe"), F.array().cast("array<string>")) if "maswe" in columns else F.array().cast("array<string>")
    rows = findings.where(~((origin == "intelligence") & (scope == "environment"))).withColumn(
        "__rule", F.when(advisory, ADVISORY_RULE).otherwise(F.col("rule_id"))
    )
    own = rows.where(F.size(mapped) > 0).select(*columns, F.explode(mapped).alias("weakness_id"))
    by_rule = rows.where(F.size(mapped) == 0).join(
        bridge.select(F.col("rule_id").alias("__rule"), "weakness_id"), "__rule"
    ).select(*columns, "weakness_id")
    return own.unionByName(by_rule)


def coverage_matrix(
    reports: DataFrame, coverage: DataFrame, findings: DataFrame, taxonomy: DataFrame, bridge: DataFrame,
    samples: int,
) -> DataFrame:
    """Per report and weakness: related checks, state, finding count and the first finding ids.

    ``reports``: report_id and optionally ``platforms``. ``samples`` says how many ids are listed; counts are exact.
    """
    checks = bridge.groupBy("weakness_id").agg(F.count(F.lit(1)).alias("checks"))
    entries = taxonomy.join(checks, taxonomy["id"] == checks["weakness_id"], "left").select(
        taxonomy["id"].alias("weakness_id"), F.col("platform"), F.coalesce("checks", F.lit(0)).alias("checks")
    )
    fixed = bounded_rows(entries, "weakness taxonomy")
    listed = F.array(
        *[
            F.struct(F.lit(r["weakness_id"]).alias("weakness_id"), F.array(*[F.lit(p) for p in r["platform"] or []]).cast("array<string>").alias("platform"),
                     F.lit(r["checks"]).cast("bigint").alias("checks"))
            for r in fixed
        ]
    )
    platforms = F.col("platforms") if "platforms" in reports.columns else F.array().cast("array<string>")
    grid = reports.select("report_id", platforms.alias("platforms"), F.explode(listed).alias("w")).select(
        "report_id", "platforms", "w.weakness_id", "w.platform", "w.checks"
    )
    covered = (
        rule_states(coverage).join(bridge, "rule_id").groupBy("report_id", "weakness_id")
        .agg(F.count(F.lit(1)).alias("checks_with_coverage"), state_mask(F.col("state")).alias("mask"))
    )
    mapped = finding_weaknesses(findings, bridge)
    external = (F.col("origin") == "external") if "origin" in findings.columns else F.lit(False)
    ids = mapped.groupBy("report_id", "weakness_id", "id").agg(F.bool_or(~external).alias("native"))
    found = ids.groupBy("report_id", "weakness_id").agg(
        F.count(F.lit(1)).alias("finding_count"), F.bool_or("native").alias("native")
    )
    sample = (
        top_k(ids.select("report_id", "weakness_id", "id"), ["report_id", "weakness_id"], [F.col("id")], samples, "__rank")
        .groupBy("report_id", "weakness_id").agg(F.array_sort(F.collect_list("id")).alias("findings"))
    )
    keys = ["report_id", "weakness_id"]
    rows = grid.join(covered, keys, "left").join(found, keys, "left").join(sample, keys, "left")
    state = aggregate_state(F.col("mask"))
    native = F.coalesce(F.col("native"), F.lit(False))
    lifted = F.when(native & state.isin("not-run", "not-applicable"), "partial").otherwise(state)
    return rows.select(
        *keys, "checks", F.coalesce("checks_with_coverage", F.lit(0)).alias("checks_with_coverage"),
        F.when((F.size("platforms") > 0) & ~F.arrays_overlap("platforms", "platform"), "not-applicable")
        .when(F.col("checks") == 0, "not-assessed").otherwise(lifted).alias("state"),
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
        F.coalesce("findings", F.array().cast("array<string>")).alias("findings"),
    )


def builtin_checklist(taxonomy: DataFrame) -> DataFrame:
    """Items of the control standard: one per MASVS control, through its weaknesses."""
    return (
        taxonomy.select(F.col("id").alias("weakness_id"), F.explode("masvs").alias("item_id"))
        .groupBy("item_id").agg(F.array_sort(F.collect_set("weakness_id")).alias("weaknesses"))
        .select("item_id", "weaknesses", F.array().cast("array<string>").alias("rules"))
    )


def checklist_view(
    matrix: DataFrame, coverage: DataFrame, findings: DataFrame, items: DataFrame, bridge: DataFrame
) -> DataFrame:
    """Status of each checklist item (item_id, weaknesses, rules) for each report of the matrix."""
    reports = matrix.select("report_id").distinct()
    fixed = bounded_rows(items, "checklist", 500)
    of_rule: dict[str, list[str]] = {}
    for r in bounded_rows(bridge, "rule to weakness table"):
        of_rule.setdefault(r["weakness_id"], []).append(r["rule_id"])
    spark = matrix.sparkSession
    item_rules = [
        (i["item_id"], rule, rule in (i["rules"] or []))
        for i in fixed
        for rule in sorted({c for w in i["weaknesses"] or [] for c in of_rule.get(w, [])} | set(i["rules"] or []))
    ]
    item_weak = [(i["item_id"], w) for i in fixed for w in i["weaknesses"] or []]
    checks = spark.createDataFrame(item_rules, "item_id string, rule_id string, explicit boolean")
    weak = spark.createDataFrame(item_weak, "item_id string, weakness_id string")
    # The output grid: every report with each of the (at most 500) configured items.
    listed = [F.struct(F.lit(i["item_id"]).alias("item_id"), F.lit(len(i["rules"] or [])).alias("explicit_rules")) for i in fixed]
    grid = reports.select("report_id", F.explode(F.array(*listed)).alias("i")).select("report_id", "i.*")
    states = rule_states(coverage)
    # Derived checks count when they reported; explicit checks always count.
    derived = states.join(checks, "rule_id").select("report_id", "item_id", "state")
    asked = [F.struct(F.lit(i).alias("item_id"), F.lit(r).alias("rule_id")) for i, r, own in item_rules if own]
    none = F.array().cast("array<struct<item_id:string,rule_id:string>>")
    explicit = (
        reports.select("report_id", F.explode(F.array(*asked) if asked else none).alias("c")).select("report_id", "c.*")
        .join(states.select("report_id", "rule_id"), ["report_id", "rule_id"], "left_anti")
        .select("report_id", "item_id", F.lit("not-run").alias("state"))
    )
    folded = derived.unionByName(explicit).groupBy("report_id", "item_id").agg(state_mask(F.col("state")).alias("mask"))
    by_weakness = (
        finding_weaknesses(findings, bridge).join(weak, "weakness_id").select("report_id", "item_id", "id")
    )
    by_rule = findings.join(checks.where("explicit"), "rule_id").select("report_id", "item_id", "id")
    found = by_weakness.unionByName(by_rule).distinct().groupBy("report_id", "item_id").agg(
        F.count(F.lit(1)).alias("finding_count")
    )
    excluded = matrix.join(weak, "weakness_id").groupBy("report_id", "item_id").agg(
        F.every(F.col("state") == "not-applicable").alias("all_excluded")
    )
    related = checks.groupBy("item_id").agg(F.count(F.lit(1)).alias("checks"))
    keys = ["report_id", "item_id"]
    rows = grid.join(related, "item_id", "left").join(folded, keys, "left").join(found, keys, "left").join(excluded, keys, "left")
    state = aggregate_state(F.col("mask"))
    count, total = F.coalesce("finding_count", F.lit(0)), F.coalesce("checks", F.lit(0))
    status = (
        F.when(count > 0, "findings").when(total == 0, "not-assessed")
        .when((F.col("explicit_rules") == 0) & F.coalesce("all_excluded", F.lit(False)), "not-applicable")
        .when(state == "checked", "no-findings-in-checked-scope").when(state.isin("limited", "partial"), state)
        .otherwise("not-run")
    )
    return rows.select(*keys, total.alias("checks"), status.alias("status"), count.alias("finding_count"))


def incomplete_flag(strict: bool, coverage_mask: Column, *flags: Column) -> Column:
    """Whether explicit evidence says a report's scope was not fully examined."""
    wanted = PARTIAL | (LIMITED if strict else 0)
    out = F.coalesce(coverage_mask.bitwiseAND(F.lit(wanted)) != 0, F.lit(False))
    for flag in flags:
        out = out | F.coalesce(flag, F.lit(False))
    return out


def report_completeness(reports: DataFrame, coverage: DataFrame, files_table: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(report_id, incomplete, limited): execution gaps, and precision limits beside them.

    Optional report columns: partial, fingerprint_complete, snapshot_partial, app_scope_complete, runtime_partial,
    online_errors. ``files_table`` holds analyzed files (report_id, state).
    """
    mask = coverage.groupBy("report_id").agg(state_mask(F.col("state")).alias("mask"))
    rows = reports.join(mask, "report_id", "left")
    bad_files, limited_files = F.lit(False), F.lit(False)
    if files_table is not None:
        judged = files_table.groupBy("report_id").agg(
            F.bool_or(F.col("state").isin(*(["partial", "skipped"] + (["limited"] if strict else [])))).alias("__bad"),
            F.bool_or(F.col("state") == "limited").alias("__lim"),
        )
        rows = rows.join(judged, "report_id", "left")
        bad_files, limited_files = F.col("__bad"), F.col("__lim")
    have = set(reports.columns)
    flags = [F.col(c) for c in ("partial", "snapshot_partial", "runtime_partial", "online_errors") if c in have]
    flags += [~F.col(c) for c in ("fingerprint_complete", "app_scope_complete") if c in have]
    limited = F.coalesce(F.col("mask").bitwiseAND(F.lit(LIMITED)) != 0, F.lit(False)) | F.coalesce(limited_files, F.lit(False))
    return rows.select(
        "report_id", incomplete_flag(strict, F.col("mask"), bad_files, *flags).alias("incomplete"), limited.alias("limited")
    )


def export_rules(findings: DataFrame) -> DataFrame:
    """Code-scanning rule descriptors; candidates have a descriptor of their own."""
    candidate = F.col("status") == "candidate"
    named = findings.withColumn(
        "export_rule", F.when(candidate, F.concat("rule_id", F.lit("/candidate"))).otherwise(F.col("rule_id"))
    )
    order = ["candidate", "version-affected", "configuration-confirmed", "runtime-confirmed"]
    weakest = F.min(ranks.rank_of(F.col("status"), tuple(order), 0))
    grouped = named.groupBy("report_id", "export_rule", "rule_id").agg(
        F.max(ranks.severity_rank(F.col("severity"))).alias("top"),
        F.max(F.when(~candidate, ranks.severity_rank(F.col("severity")))).alias("rated"),
        weakest.alias("weakest"),
        F.count(F.lit(1)).alias("results"),
    )
    severity = ranks.name_of(F.col("top"), ranks.SEVERITIES)
    rated = ranks.name_of(F.col("rated"), ranks.SEVERITIES)
    return grouped.select(
        "report_id", "export_rule", "rule_id", "results",
        F.when(F.col("rated").isNotNull(), ranks.severity_level(rated))
        .otherwise(ranks.result_level(severity, F.lit("candidate"))).alias("level"),
        ranks.precision(ranks.name_of(F.col("weakest"), ranks.STATUSES)).alias("precision"),
        F.coalesce(ranks.security_score(rated), F.lit("")).alias("security_severity"),
        F.col("rated").isNull().alias("candidate_only"),
    )


def coverage_notifications(coverage: DataFrame, limit: int | None = None) -> DataFrame:
    """Groups of shortfalls per report in (rule, state) order; ``omitted`` counts those past a limit."""
    short = coverage.where(F.col("state").isin("partial", "limited", "not-run"))
    note = F.col("note") if "note" in coverage.columns else F.lit("")
    grouped = short.groupBy("report_id", "rule_id", "state").agg(
        F.count(F.lit(1)).alias("entries"), F.min(F.when(note != "", note)).alias("note")
    )
    totals = grouped.groupBy("report_id").agg(F.count(F.lit(1)).alias("groups"))
    first = top_k(grouped, ["report_id"], [F.col("rule_id"), F.col("state")], limit, "position")
    return first.join(totals, "report_id").select(
        "report_id", "position", "rule_id", "state", "entries", F.coalesce("note", F.lit("")).alias("note"),
        F.when(F.col("state") == "partial", "warning").otherwise("note").alias("level"),
        (F.lit(0).cast("bigint") if limit is None else F.greatest(F.col("groups") - limit, F.lit(0))).alias("omitted"),
    )


def feed_coverage(environments: DataFrame, advisories: DataFrame, feeds: DataFrame) -> DataFrame:
    """Platform advisory coverage per device: partial with any usable evidence, else not-run."""
    source = F.when(F.col("platform") == "android", "android").when(F.col("platform") == "ios", "apple")
    seen = advisories.select("platform").distinct().withColumn("observed", F.lit(True))
    health = feeds.select(F.col("source").alias("feed"), F.col("status").alias("feed_status"), "stale")
    rows = environments.withColumn("feed", source).join(seen, "platform", "left").join(health, "feed", "left")
    usable = F.coalesce((F.col("feed_status") == "ok") & ~F.col("stale"), F.lit(False))
    return rows.select(
        "device_id", F.lit("OS-CVE").alias("rule_id"),
        F.when(F.col("platform").isNotNull() & (F.coalesce("observed", F.lit(False)) | usable), "partial")
        .otherwise("not-run").alias("state"),
        F.coalesce("feed_status", F.lit("unavailable")).alias("feed_status"),
    )


def dependency_coverage(deps: DataFrame, health: DataFrame) -> DataFrame:
    """Coverage state per dependency from its query state and feed health (keyed by ``source``).

    Optional dependency columns: superseded, query_checked, query_state.
    """
    have = set(deps.columns)
    superseded = F.coalesce(F.col("superseded"), F.lit(False)) if "superseded" in have else F.lit(False)
    checked = F.col("query_checked") if "query_checked" in have else F.lit(None).cast("boolean")
    query_state = F.col("query_state") if "query_state" in have else F.lit(None).cast("string")
    rows = deps.withColumn(
        "source", F.concat(F.lit("osv:"), "ecosystem", F.lit(":"), "name", F.lit(":"), "version")
    ).join(health.select("source", F.col("status").alias("feed_status"), "stale"), "source", "left")
    usable = F.coalesce((F.col("feed_status") == "ok") & ~F.col("stale"), F.lit(False))
    state = (
        F.when(superseded, "not-applicable")
        .when(checked.isNotNull() & ~checked, F.when(query_state.isin("partial", "error"), "partial").otherwise("not-run"))
        .when((F.col("confidence") != "unknown") & usable, "checked")
        .otherwise("not-run")
    )
    return rows.withColumn("state", state).drop("feed_status", "stale", "source")
