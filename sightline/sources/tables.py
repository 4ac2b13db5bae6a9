"""Saved reports and validated user tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import ranks
from sightline.operators.policy import DEFAULT_THRESHOLDS, Policy
from sightline.scale import bounded_rows, latest


def report_by_id(reports: DataFrame, report_id: str) -> DataFrame:
    return reports.where(F.col("report_id") == report_id)


def latest_reports(reports: DataFrame) -> DataFrame:
    """The newest report per target."""
    return latest(reports, ["target"], ["created", "report_id"])


def target_reports(reports: DataFrame, target: str, until=None, limit: int | None = None) -> DataFrame:
    """Reports of one target, not after ``until``; with a ``limit``, the newest ones."""
    rows = reports.where(F.col("target") == target)
    if until is not None:
        rows = rows.where(F.col("created") <= F.lit(until))
    return rows if limit is None else rows.orderBy(F.col("created").desc(), F.col("report_id").desc()).limit(limit)


# Vocabularies of labelled cases.
VARIANTS = ("vulnerable", "fixed", "irrelevant")
KINDS = ("source", "binary")


def labelled_cases(cases: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of case manifests (case_id, kind, path, variant, pair, expected ARRAY<STRUCT<rule_id, status>>).

    Vulnerable cases need expected candidate labels of listed rules, other variants none; ids are unique.
    """
    text = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    expected = F.coalesce("expected", F.array().cast("array<struct<rule_id:string,status:string>>"))
    shape = text("case_id") & text("path") & text("pair") & F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)) & F.coalesce(
        F.col("variant").isin(*VARIANTS), F.lit(False)
    )
    labelled = (F.size(expected) > 0) == (F.col("variant") == "vulnerable")
    candidates = F.forall(expected, lambda e: e["status"] == "candidate")
    listed = cases.select("case_id", F.explode(expected).alias("e")).join(
        rules.select(F.col("rule_id").alias("known")), F.col("e.rule_id") == F.col("known"), "left_anti"
    ).select("case_id").distinct().withColumn("unlisted", F.lit(True))
    twice = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    rows = cases.join(listed, "case_id", "left").join(twice, "case_id")
    code = (
        F.when(~shape, "incomplete-case").when(F.col("n") > 1, "duplicate-id").when(~labelled, "label-variant-mismatch")
        .when(~candidates, "status-not-candidate").when(F.coalesce("unlisted", F.lit(False)), "unlisted-rule")
    )
    rows = rows.withColumn("code", code)
    return rows.where("code IS NULL").select(*cases.columns), rows.where("code IS NOT NULL").select("case_id", "code")


def policy_from(table: DataFrame) -> Policy:
    """Policy of a (key, value) table; unknown and repeated keys are refused."""
    rows = bounded_rows(table, "policy table", 100)
    seen: dict[str, str] = {}
    for row in rows:
        if row["key"] in seen:
            raise ValueError(f"policy key {row['key']} is given twice")
        seen[row["key"]] = row["value"]
    known = {*(f"thresholds.{s}" for s in DEFAULT_THRESHOLDS), "allowed_statuses", "only_new", "fail_on_partial", "strict_coverage", "required_rules",
             "required_feeds", "intel_max_age_hours", "intel_max_pending"}
    unknown = set(seen) - known
    if unknown:
        raise ValueError(f"unknown policy keys: {', '.join(sorted(unknown))}")
    options: dict = {"thresholds": {k.split(".")[1]: int(v) for k, v in seen.items() if k.startswith("thresholds.")}}
    for key in ("only_new", "fail_on_partial", "strict_coverage"):
        if key in seen:
            if seen[key] not in ("true", "false"):
                raise ValueError(f"{key} must be true or false")
            options[key] = seen[key] == "true"
    for key in ("allowed_statuses", "required_rules", "required_feeds"):
        if key in seen:
            options[key] = tuple(v.strip() for v in seen[key].split(",") if v.strip())
    for key in ("intel_max_age_hours", "intel_max_pending"):
        if key in seen:
            options[key] = int(seen[key])
    return Policy(**options)


def valid_waivers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(waivers, rejects) of (finding_id, reason, expires, severity, known_exploited) text rows; ids are unique."""
    day = F.when(F.col("expires").rlike(r"^\d{4}-\d\d-\d\d$"), F.col("expires").try_cast("date"))
    counts = rows.groupBy("finding_id").agg(F.count(F.lit(1)).alias("n"))
    joined = rows.join(counts, "finding_id", "left")
    code = (
        F.when(F.coalesce("finding_id", F.lit("")) == "", "missing-id").when(F.trim(F.coalesce("reason", F.lit(""))) == "", "missing-reason")
        .when(day.isNull(), "invalid-expiry").when(F.col("severity").isNotNull() & ~F.col("severity").isin(*ranks.SEVERITIES), "unknown-severity")
        .when(F.col("n") > 1, "duplicate-waiver")
    )
    marked = joined.withColumn("code", code).withColumn("expires", day)
    return marked.where("code IS NULL").select("finding_id", "reason", "expires", "severity", "known_exploited"), marked.where("code IS NOT NULL").select("finding_id", "code")


def checklist_problems(items: DataFrame, known_weaknesses: DataFrame, known_rules: DataFrame) -> DataFrame:
    """(item_id, code) of checklist rows with a bad or repeated id, or unknown weakness or rule ids."""
    bad = items.where(~F.coalesce(F.col("item_id").rlike(r"^[\w.-]{1,40}$"), F.lit(False))).select("item_id", F.lit("invalid-id").alias("code"))
    twice = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("item_id", F.lit("duplicate-id").alias("code"))
    weak = items.select("item_id", F.explode("weaknesses").alias("id")).join(known_weaknesses.select("id"), "id", "left_anti")
    rule = items.select("item_id", F.explode("rules").alias("rule_id")).join(known_rules.select("rule_id"), "rule_id", "left_anti")
    return (
        bad.unionByName(twice).unionByName(weak.select("item_id", F.lit("unknown-weakness").alias("code")).distinct())
        .unionByName(rule.select("item_id", F.lit("unknown-rule").alias("code")).distinct())
    )


def as_of(text: str) -> dt.datetime:
    """A time that names its offset, in UTC without one; operators take their clock from here."""
    value = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    if value.tzinfo is None:
        raise ValueError("the evaluation time needs an offset")
    return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
