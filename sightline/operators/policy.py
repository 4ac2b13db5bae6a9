"""Policy gates: budgets, waivers, baselines, required coverage and feed freshness, for all reports at once."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import ranks
from sightline.operators.coverage import LIMITED, PARTIAL, state_mask
from sightline.operators.identity import match_identities

# Default budgets (-1 = no budget) and gate exit codes.
DEFAULT_THRESHOLDS = {"critical": 0, "high": 0, "medium": -1, "low": -1, "info": -1}
EXIT_CODES = {"passed": 0, "failed": 4, "incomplete": 3}
CLOCK_SKEW = dt.timedelta(minutes=5)


@dataclass(frozen=True)
class Policy:
    """Gate configuration."""

    thresholds: dict[str, int] = field(default_factory=lambda: dict(DEFAULT_THRESHOLDS))
    allowed_statuses: tuple[str, ...] = ranks.STATUSES[1:]
    only_new: bool = False
    fail_on_partial: bool = True
    strict_coverage: bool = False
    required_rules: tuple[str, ...] = ()
    required_feeds: tuple[str, ...] = ()
    intel_max_age_hours: int = 24
    intel_max_pending: int = 0

    def __post_init__(self) -> None:
        unknown = set(self.thresholds) - set(ranks.SEVERITIES)
        if unknown or any(type(v) is not int or v < -1 for v in self.thresholds.values()):
            raise ValueError("thresholds map severities to -1 or a count")
        if not self.allowed_statuses or set(self.allowed_statuses) - set(ranks.STATUSES):
            raise ValueError("allowed_statuses must name finding statuses")
        object.__setattr__(self, "thresholds", {**DEFAULT_THRESHOLDS, **self.thresholds})


def _has_identities(frame: DataFrame) -> bool:
    return {"own", "every"} <= set(frame.columns)


def by_identity(findings: DataFrame, entries: DataFrame, entry_id: str, keys: tuple[str, ...]) -> DataFrame:
    """``entries`` under ``keys`` and the ``id`` of the findings they match through an identity.

    ``findings``: keys, id, ``own`` and ``every`` identities. An entry names one identity: a finding's own one matches,
    an alias only where it is the single option of both.
    """
    named = findings.select(*keys, F.explode(F.array_union("own", "every")).alias("id")).join(
        entries.select(F.col(entry_id).alias("id")).distinct().hint("merge"), "id"
    ).distinct()
    previous = named.withColumn("own", F.array("id")).withColumn("every", F.array("id"))
    pairs = match_identities(findings.select(*keys, "id", "own", "every").distinct(), previous, keys)
    return pairs.select(*keys, F.col("current_id").alias("id"), F.col("previous_id").alias(entry_id)).join(entries.hint("merge"), entry_id)


def waiver_state(
    findings: DataFrame, waivers: DataFrame, as_of: dt.date, id_column: str = "id", keys: tuple[str, ...] = ("report_id",)
) -> DataFrame:
    """Adds ``waived``, ``reopened`` and ``suppressed`` to findings.

    Findings with ``own`` and ``every`` identities meet waivers through them within ``keys``, others by id.

    ``waivers``: finding_id, expires and, when recorded, severity and known_exploited. They are folded to one row
    per finding id first, so the join adds no rows. Expiry is inclusive; an escalated waiver reopens its finding
    even when another active one matches.
    """
    active = waivers.where(F.col("expires") >= F.lit(as_of))
    recorded = F.col("severity").isNotNull()
    on = [id_column]
    if _has_identities(findings):
        active, on = by_identity(findings, active, "finding_id", keys).withColumnRenamed("id", id_column), [*keys, id_column]
    else:
        active = active.withColumn(id_column, F.col("finding_id"))
    folded = active.groupBy(*on).agg(
        F.lit(True).alias("waived"),
        F.min(F.when(recorded, ranks.severity_rank(F.col("severity")))).alias("__rank"),
        F.bool_or(recorded & ~F.coalesce("known_exploited", F.lit(False))).alias("__unexploited"),
    )
    rows = findings.join(folded.hint("merge"), on, "left")
    exploited = F.coalesce("known_exploited", F.lit(False)) if "known_exploited" in findings.columns else F.lit(False)
    reopened = F.coalesce(ranks.severity_rank(F.col("severity")) > F.col("__rank"), F.lit(False)) | (
        exploited & F.coalesce("__unexploited", F.lit(False))
    )
    waived = F.coalesce("waived", F.lit(False))
    return (
        rows.withColumn("waived", waived).withColumn("reopened", F.col("waived") & reopened)
        .withColumn("suppressed", F.col("waived") & ~F.col("reopened")).drop("__rank", "__unexploited")
    )


def waiver_report(findings: DataFrame, waivers: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per waiver: expired or active, matched findings, escalations and the notice it raises."""
    matched = findings.join(
        waivers.select(F.col("finding_id").alias("id"), F.col("expires").alias("w_expires"),
                       F.col("severity").alias("w_severity"), F.col("known_exploited").alias("w_exploited")),
        "id",
    )
    worse = F.coalesce(
        (ranks.severity_rank(F.col("severity")) > ranks.severity_rank(F.col("w_severity")))
        | (F.coalesce("known_exploited", F.lit(False)) & ~F.coalesce("w_exploited", F.lit(False))),
        F.lit(False),
    ) & F.col("w_severity").isNotNull()
    per = matched.groupBy("id", "w_expires", "w_severity", "w_exploited").agg(
        F.count(F.lit(1)).alias("matched"), F.sum(worse.cast("bigint")).alias("escalated"),
        F.max(F.when(worse, ranks.severity_rank(F.col("severity")))).alias("current_rank"),
    )
    same = (
        (F.col("finding_id") == F.col("id")) & F.col("expires").eqNullSafe(F.col("w_expires"))
        & F.col("severity").eqNullSafe(F.col("w_severity")) & F.col("known_exploited").eqNullSafe(F.col("w_exploited"))
    )
    rows = waivers.join(per, same, "left")
    expired = F.col("expires") < F.lit(as_of)
    escalated = F.when(expired, F.lit(0)).otherwise(F.coalesce("escalated", F.lit(0)))
    notice = (
        F.when(expired, "expired-waiver").when(escalated > 0, "waiver-severity-escalated")
        .when(F.col("severity").isNull(), "waiver-severity-unrecorded").otherwise("")
    )
    return rows.select(
        "finding_id", "expires", expired.alias("expired"), F.coalesce("matched", F.lit(0)).alias("matched"),
        escalated.alias("escalated"),
        F.when(escalated > 0, ranks.name_of(F.col("current_rank"), ranks.SEVERITIES)).otherwise("").alias("current_severity"),
        notice.alias("notice"),
    )


def baseline_state(findings: DataFrame, baseline: DataFrame, keys: tuple[str, ...] = ("report_id", "id")) -> DataFrame:
    """Adds ``baseline``: existing (covered in severity and status), escalated, or new.

    ``baseline`` holds the prior rows under the keys of the report they are the baseline of. Where both sides have
    ``own`` and ``every`` identities, findings are matched through them, so a renamed advisory stays covered.
    """
    if _has_identities(findings) and _has_identities(baseline):
        *scope, name = keys
        side = lambda frame: frame.select(*scope, F.col(name).alias("id"), "own", "every").distinct()
        pairs = match_identities(side(findings), side(baseline), scope)
        pairs = pairs.select(*scope, F.col("current_id").alias("__current"), F.col("previous_id").alias(name))
        baseline = baseline.join(pairs.hint("merge"), list(keys)).withColumn(name, F.col("__current"))
    prior = baseline.groupBy(*keys).agg(
        F.collect_set(
            F.struct(ranks.severity_rank(F.col("severity")).alias("s"), ranks.status_rank(F.col("status")).alias("t"))
        ).alias("__prior")  # at most severities x statuses values
    )
    rows = findings.join(prior.hint("merge"), list(keys), "left")
    covered = F.exists(
        F.col("__prior"),
        lambda p: (p["s"] >= ranks.severity_rank(F.col("severity"))) & (p["t"] >= ranks.status_rank(F.col("status"))),
    )
    state = F.when(F.col("__prior").isNull(), "new").when(covered, "existing").otherwise("escalated")
    return rows.withColumn("baseline", state).drop("__prior")


def baseline_problem(report_id: Column, baseline_id: Column, created: Column, baseline_created: Column,
                     subject: Column, baseline_subject: Column) -> Column:
    """Why a baseline cannot be compared; empty when it can."""
    return (
        F.when(baseline_id.isNull(), "baseline-required")
        .when(report_id == baseline_id, "baseline-is-report")
        .when(baseline_created > created, "baseline-not-earlier")
        .when(~subject.eqNullSafe(baseline_subject), "baseline-target-mismatch")
        .otherwise("")
    )


def required_rules(reports: DataFrame, coverage: DataFrame, rules: tuple[str, ...], strict: bool = False) -> DataFrame:
    """(report_id, rule_id, complete) for every report and required rule."""
    satisfied = ["checked", "not-applicable"] + ([] if strict else ["limited"])
    done = coverage.where(F.col("rule_id").isin(*rules)).groupBy("report_id", "rule_id").agg(
        F.every(F.col("state").isin(*satisfied)).alias("complete")
    )
    wanted = reports.select("report_id", F.explode(F.array(*[F.lit(r) for r in rules])).alias("rule_id"))
    return wanted.join(done, ["report_id", "rule_id"], "left").select(
        "report_id", "rule_id", F.coalesce("complete", F.lit(False)).alias("complete")
    )


def fresh_feeds(feeds: DataFrame, required: tuple[str, ...], as_of: dt.datetime, max_age_hours: int = 24,
                max_pending: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, source, fresh) for every required feed.

    ``feeds``: source, status, succeeded, stale and for the record feed fetched_ok, pending, retrying. A feed that
    is missing, listed twice, failed or too old is not fresh; a bounded healthy backlog is allowed there.
    """
    now = F.lit(as_of).cast("timestamp")
    rows = feeds.where(F.col("source").isin(*required))
    have = set(feeds.columns)
    col = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    is_record_feed = F.col("source") == "cve"
    succeeded = F.when(is_record_feed, F.coalesce(col("fetched_ok", "timestamp"), F.col("succeeded"))).otherwise(F.col("succeeded"))
    in_time = (succeeded <= now + F.expr("INTERVAL 5 MINUTES")) & (
        succeeded >= now - F.make_interval(hours=F.lit(max_age_hours))
    )
    backlog = (
        is_record_feed & (F.col("status") == "partial") & (col("pending", "bigint") > 0)
        & (col("pending", "bigint") <= max_pending) & (col("retrying", "bigint") == 0)
    )
    fresh = F.coalesce(in_time & ((F.col("status") == "ok") | backlog) & F.col("stale").isNotNull(), F.lit(False))
    per = rows.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("n"), F.every(fresh).alias("ok"))
    names = F.explode(F.array(*[F.lit(s) for s in required])).alias("source")
    subjects = feeds.select(*keys).distinct().select(*keys, names) if keys else feeds.sparkSession.range(1).select(names)
    return subjects.join(per, [*keys, "source"], "left").select(
        *keys, "source", F.coalesce((F.col("n") == 1) & F.col("ok"), F.lit(False)).alias("fresh")
    )


def evaluate(
    findings: DataFrame,
    coverage: DataFrame,
    policy: Policy,
    as_of: dt.datetime,
    waivers: DataFrame | None = None,
    baseline: DataFrame | None = None,
    baseline_problems: DataFrame | None = None,
    feeds: DataFrame | None = None,
    completeness: DataFrame | None = None,
) -> DataFrame:
    """Gate decision per report.

    ``baseline``: prior findings keyed by the current report_id; ``baseline_problems``: (report_id, problem), a
    non-empty problem discards the baseline; ``completeness``: (report_id, incomplete).
    """
    reports = findings.select("report_id").unionByName(coverage.select("report_id")).distinct()
    rows = findings.withColumn("eligible", F.col("status").isin(*policy.allowed_statuses))
    if waivers is not None:
        rows = waiver_state(rows, waivers, as_of.date())
    else:
        rows = rows.withColumn("suppressed", F.lit(False))
    if policy.only_new and baseline is not None:
        usable = baseline
        if baseline_problems is not None:
            usable = baseline.join(baseline_problems.where("problem <> ''").select("report_id"), "report_id", "left_anti")
        rows = baseline_state(rows, usable)
    else:
        rows = rows.withColumn("baseline", F.lit("new"))
    eligible = F.col("eligible")
    open_ = eligible & (F.col("baseline") != "existing")
    gated = open_ & ~F.col("suppressed")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    counted = rows.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("total"),
        one(~eligible).alias("status_excluded"),
        one(eligible & (F.col("baseline") == "existing")).alias("baseline_existing"),
        one(eligible & (F.col("baseline") == "escalated")).alias("escalated"),
        one(open_ & F.col("suppressed")).alias("waived"),
        one(gated).alias("considered"),
        *[one(gated & (F.col("severity") == s)).alias(f"n_{s}") for s in ranks.SEVERITIES],
    )
    names = [c for c in counted.columns if c != "report_id"]
    out = reports.join(counted, "report_id", "left").select(
        "report_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names]
    )
    reasons: list[Column] = []
    if policy.only_new and baseline is None:
        reasons.append(F.lit("baseline-required"))
    if policy.only_new and baseline_problems is not None:
        out = out.join(baseline_problems.select("report_id", "problem"), "report_id", "left")
        reasons.append(F.when(F.coalesce("problem", F.lit("")) != "", F.col("problem")))
    if waivers is not None:
        expired = bool(waivers.where(F.col("expires") < F.lit(as_of.date())).limit(1).count())
        if expired:
            reasons.append(F.lit("expired-waiver"))
    if policy.fail_on_partial:
        wanted = PARTIAL | (LIMITED if policy.strict_coverage else 0)
        masks = coverage.groupBy("report_id").agg(state_mask(F.col("state")).alias("mask"))
        out = out.join(masks, "report_id", "left")
        partial = F.coalesce(F.col("mask").bitwiseAND(F.lit(wanted)) != 0, F.lit(False))
        if completeness is not None:
            out = out.join(completeness.select("report_id", F.col("incomplete").alias("__inc")), "report_id", "left")
            partial = partial | F.coalesce("__inc", F.lit(False))
        reasons.append(F.when(partial, "partial-audit"))
    if policy.required_rules:
        missing = required_rules(reports, coverage, policy.required_rules, policy.strict_coverage)
        missing = missing.groupBy("report_id").agg(F.bool_or(~F.col("complete")).alias("rules_missing"))
        out = out.join(missing, "report_id", "left")
        reasons.append(F.when(F.col("rules_missing"), "required-rule-incomplete"))
    if policy.required_feeds and feeds is not None:
        judged = fresh_feeds(feeds, policy.required_feeds, as_of, policy.intel_max_age_hours, policy.intel_max_pending)
        stale = bool(judged.where(~F.col("fresh")).limit(1).count())  # at most one row per required feed
        if stale:
            reasons.append(F.lit("required-intelligence-unavailable"))
    over = [
        F.when(F.col(f"n_{s}") > policy.thresholds[s], F.lit(f"severity-threshold:{s}"))
        for s in reversed(ranks.SEVERITIES)
        if policy.thresholds[s] >= 0
    ]
    nothing = F.lit(None).cast("string")
    incomplete = F.array_compact(F.array(*reasons, nothing))
    failures = F.array_compact(F.array(*over, nothing))
    state = F.when(F.size(failures) > 0, "failed").when(F.size(incomplete) > 0, "incomplete").otherwise("passed")
    code = F.when(state == "failed", EXIT_CODES["failed"]).when(state == "incomplete", EXIT_CODES["incomplete"]).otherwise(0)
    return out.select(
        "report_id", *names, state.alias("state"), code.alias("exit_code"),
        F.concat_ws(",", F.concat(incomplete, failures)).alias("reasons"),
    )
