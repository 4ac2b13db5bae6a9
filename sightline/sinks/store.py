"""Report store: immutable appends, content digests, integrity checks and approved baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.canonical import digest
from sightline.scale import numbered

CHUNK = 1000


def content_digests(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, content_hash): digest of each key's rows in order, whatever their number.

    Row digests are combined by thousands, level by level, so a group never holds more than a thousand of them. The
    number of levels follows from the measured largest group, and every key passes through all of them.
    """
    keys = list(keys)
    hashed = rows.select(*keys, *order, digest(F.to_json(F.struct(*sorted(columns)))).alias("__h"))
    placed = numbered(hashed, keys, order, "__p").select(*keys, "__p", "__h")
    level = placed.withColumn("__p", F.col("__p") - 1)
    largest = level.agg(F.max("__p")).first()[0]
    rounds = 1
    while largest is not None and largest >= CHUNK**rounds:
        rounds += 1
    for _ in range(rounds):
        level = level.groupBy(*keys, F.floor(F.col("__p") / CHUNK).alias("__c")).agg(
            digest(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("__p", "__h"))), lambda x: x["__h"]))).alias("__h")
        ).withColumnRenamed("__c", "__p")
    return level.select(*keys, F.col("__h").alias("content_hash"))


def plan_append(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, identical, conflicts) of incoming report headers (report_id, body_hash) against the stored ones.

    Saved reports are immutable: the same body again is accepted, another body under the same id is a conflict.
    """
    known = stored.select("report_id", F.col("body_hash").alias("__stored")).distinct()
    rows = incoming.join(known, "report_id", "left")
    return (
        rows.where("__stored IS NULL").drop("__stored"),
        rows.where("__stored = body_hash").drop("__stored"),
        rows.where("__stored <> body_hash").select("report_id", "body_hash", F.col("__stored").alias("stored_hash")),
    )


def append_reports(path: str, headers: DataFrame, new: DataFrame, rows: dict[str, DataFrame]) -> None:
    """Appends the row tables of new reports, then their headers, partitioned by target.

    A reader starts from the headers, so rows of an interrupted append are invisible.
    """
    accepted = new.select("report_id").distinct()
    for name, table in rows.items():
        table.join(accepted, "report_id", "left_semi").write.mode("append").partitionBy("target").parquet(f"{path}/{name}")
    headers.join(accepted, "report_id", "left_semi").write.mode("append").partitionBy("target").parquet(f"{path}/reports")


def verify_store(headers: DataFrame, recomputed: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """Integrity state per stored report: ok, body-mismatch, export-mismatch or missing-rows."""
    rows = headers.select("report_id", "body_hash").join(recomputed.select("report_id", F.col("content_hash").alias("__now")), "report_id", "left")
    exported = F.lit(True)
    if exports is not None:
        rows = rows.join(exports.select("report_id", F.col("body_hash").alias("__export")), "report_id", "left")
        exported = F.col("__export").isNull() | (F.col("__export") == F.col("body_hash"))
    state = (
        F.when(F.col("__now").isNull(), "missing-rows").when(F.col("__now") != F.col("body_hash"), "body-mismatch")
        .when(~exported, "export-mismatch").otherwise("ok")
    )
    return rows.select("report_id", state.alias("state"))


def approved_baselines(
    reports: DataFrame, findings: DataFrame, completeness: DataFrame, apps: DataFrame, approved_by: str, reference: str
) -> tuple[DataFrame, DataFrame]:
    """(artifacts, refusals): digests of reports fit to be a baseline, and why others are not.

    A baseline needs a complete audit, a complete input fingerprint and exactly one application identity.
    """
    if not approved_by.strip() or not reference.strip():
        raise ValueError("a baseline needs an approver and a reference")
    if len(approved_by) > 256 or len(reference) > 2048:
        raise ValueError("approval metadata is too long")
    one = apps.groupBy("report_id").agg(F.count_distinct("platform", "package").alias("identities"))
    rows = reports.join(completeness.select("report_id", "incomplete"), "report_id", "left").join(one, "report_id", "left")
    code = (
        F.when(F.coalesce("incomplete", F.lit(True)) | ~F.coalesce("fingerprint_complete", F.lit(False)), "incomplete-audit")
        .when(F.coalesce("identities", F.lit(0)) != 1, "ambiguous-application")
    )
    judged = rows.withColumn("code", code)
    fit = judged.where("code IS NULL").select("report_id")
    content = content_digests(findings.join(fit, "report_id", "left_semi"), ["report_id"], ["id"], ["id", "rule_id", "severity", "status"])
    artifacts = fit.join(content, "report_id", "left").select(
        "report_id", F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.lit(approved_by).alias("approved_by"), F.lit(reference).alias("reference")
    )
    return artifacts, judged.where("code IS NOT NULL").select("report_id", "code")
