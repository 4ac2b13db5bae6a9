"""Identities of findings and one-to-one matching of two finding sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.canonical import dependency_identity
from sightline.functions.packages import valid_advisory_id


def is_dependency_advisory(evidence: Column, scope: Column | None = None) -> Column:
    """Every evidence row locates a dependency and the finding is not about the environment."""
    located = F.coalesce(F.size(evidence) > 0, F.lit(False)) & F.forall(evidence, lambda e: e["dependency"].isNotNull())
    if scope is None:
        return located
    return located & (F.coalesce(scope, F.lit("app")) != "environment")


def advisory_ids(ids: Column) -> Column:
    """Valid, sorted equivalent advisory ids of a finding; all of them take part in matching."""
    return F.array_sort(F.array_distinct(F.filter(ids, valid_advisory_id)))


def with_dependency_identities(findings: DataFrame) -> DataFrame:
    """Adds ``own`` and ``every`` identity arrays to dependency findings (rule_id, ecosystem, name, path, advisory_ids)."""
    locate = lambda rule: dependency_identity(rule, F.col("ecosystem"), F.col("name"), F.col("path"))
    own = F.array_distinct(F.array(F.col("id"), locate(F.col("rule_id"))))
    aliases = F.transform(advisory_ids(F.col("advisory_ids")), locate)
    return findings.withColumn("own", own).withColumn("every", F.array_union("own", aliases))


def match_identities(current: DataFrame, previous: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs (keys, current_id, previous_id, basis) of entries that are the same finding.

    Both sides: keys, ``id`` (unique per keys), ``own`` and ``every``. A shared own identity matches; otherwise an
    alias counts only through one side's own identity and only when it is the single option of both endpoints.
    """
    keys = list(keys)

    def side(frame: DataFrame, name: str) -> DataFrame:
        tagged = F.transform(F.array_union("own", "every"), lambda i: F.struct(i.alias("identity"), F.array_contains("own", i).alias("mine")))
        return frame.select(*keys, F.col("id").alias(name), F.explode(tagged).alias("t")).select(
            *keys, name, "t.identity", F.col("t.mine").alias(f"{name}_own")
        )

    # Sizes are estimated before the arrays are exploded, so Spark would broadcast whole sides through the driver.
    now, old = side(current, "current_id"), side(previous, "previous_id")
    on = [*keys, "identity"]
    pair = [*keys, "current_id", "previous_id"]
    # At least one side's own identity takes part in every join, so entries that merely share a third alias never meet.
    edges = (
        now.join(old.where("previous_id_own").hint("merge"), on).select(*pair, F.col("current_id_own").alias("exact"))
        .unionByName(now.where("current_id_own").join(old.where("NOT previous_id_own").hint("merge"), on).select(*pair, F.lit(False).alias("exact")))
        .groupBy(*pair).agg(F.bool_or("exact").alias("exact"))
    )
    options = edges.groupBy(*keys, "current_id").agg(
        F.bool_or("exact").alias("has_exact"), F.sum((~F.col("exact")).cast("int")).alias("aliases")
    )
    claims = edges.groupBy(*keys, "previous_id").agg(F.count(F.lit(1)).alias("reached"))
    judged = edges.join(options.hint("merge"), [*keys, "current_id"]).join(claims.hint("merge"), [*keys, "previous_id"])
    accepted = F.col("exact") | (~F.col("has_exact") & (F.col("aliases") == 1) & (F.col("reached") == 1))
    return judged.where(accepted).select(
        *pair, F.when(F.col("exact"), "identity").otherwise("advisory-alias").alias("basis")
    )


def alias_pairs(current: DataFrame, previous: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs that are one dependency advisory under different display ids."""
    return match_identities(current, previous, keys).where(F.col("basis") == "advisory-alias").drop("basis")


def dedup_last(findings: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key; the last one wins."""
    from sightline.scale import latest

    return latest(findings, keys, order)


def dedup_strongest(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key; the most severe one wins, then the greatest row."""
    from sightline.functions.ranks import severity_rank
    from sightline.scale import latest

    return latest(findings, keys, [severity_rank(F.col("severity")).alias("r"), *findings.columns])
