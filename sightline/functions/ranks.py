"""Ordered vocabularies: severity, status, confidence and their export levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies whose order is semantic.
SEVERITIES = ("info", "low", "medium", "high", "critical")
STATUSES = ("candidate", "version-affected", "configuration-confirmed", "runtime-confirmed")
CONFIDENCES = ("unknown", "declared", "exact")
COVERAGE_STATES = ("checked", "limited", "partial", "not-run", "not-applicable")
LINT_SEVERITIES = ("HIGH", "MEDIUM", "LOW", "INFO")
SECURITY_SEVERITY = {"critical": "9.5", "high": "8.0", "medium": "5.5", "low": "3.0"}
PRECISION = {
    "runtime-confirmed": "very-high",
    "configuration-confirmed": "high",
    "version-affected": "high",
    "candidate": "medium",
}


def rank_of(value: Column, order: tuple[str, ...], unknown: int) -> Column:
    """Position of ``value`` in ``order``; ``unknown`` for any other value."""
    position = F.array_position(F.array(*[F.lit(o) for o in order]), value)
    return F.when(position > 0, position.cast("int") - 1).otherwise(F.lit(unknown))


def name_of(rank: Column, order: tuple[str, ...]) -> Column:
    """Name at a rank; null for a null rank."""
    return F.when(rank.isNotNull(), F.get(F.array(*[F.lit(o) for o in order]), rank.cast("int")))


def severity_rank(value: Column) -> Column:
    return rank_of(value, SEVERITIES, 0)


def status_rank(value: Column) -> Column:
    return rank_of(value, STATUSES, -1)


def confidence_rank(value: Column) -> Column:
    return rank_of(value, CONFIDENCES, 0)


def severity_level(severity: Column) -> Column:
    """Code-scanning level of a severity."""
    return (
        F.when(severity.isin("high", "critical"), "error").when(severity == "medium", "warning").otherwise("note")
    )


def result_level(severity: Column, status: Column) -> Column:
    """Candidates stay below error."""
    level = severity_level(severity)
    return F.when((level == "error") & (status == "candidate"), "warning").otherwise(level)


def security_score(severity: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, score in SECURITY_SEVERITY.items():
        out = F.when(severity == name, score).otherwise(out)
    return out


def precision(status: Column) -> Column:
    out = F.lit("medium")
    for name, value in PRECISION.items():
        out = F.when(status == name, value).otherwise(out)
    return out


def score_severity(score: Column) -> Column:
    """Severity of an imported 0-10 score; null for anything else."""
    value = score.try_cast("double")
    ok = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value <= 10)
    return F.when(
        ok,
        F.when(value >= 9, "critical").when(value >= 7, "high").when(value >= 4, "medium").otherwise("low"),
    )


def imported_severity(score: Column, level: Column, default_level: Column) -> Column:
    """A valid score decides; otherwise the result's or rule's level does."""
    chosen = F.coalesce(F.nullif(level, F.lit("")), F.nullif(default_level, F.lit("")), F.lit("warning"))
    by_level = F.when(chosen == "error", "medium").when(chosen == "warning", "low").otherwise("info")
    return F.coalesce(score_severity(score), by_level)


def target_sdk_severity(level: Column) -> Column:
    """Severity tier of an outdated target level."""
    return F.when(level < 23, "high").when(level < 29, "medium").otherwise("low")
