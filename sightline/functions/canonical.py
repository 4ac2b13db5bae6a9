"""Canonical JSON, digests and the identities derived from them.

JSON is built from structs whose fields are listed in sorted order; a null field counts as absent.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Evidence fields that locate a finding, and their nested parts.
LOCATION_FIELDS = (
    "architecture",
    "class",
    "component",
    "function",
    "instruction_offset",
    "line",
    "method",
    "offset",
    "path",
    "platform",
    "scenario_identity",
    "sink",
    "slice",
    "source",
)
DEPENDENCY_FIELDS = ("ecosystem", "name", "path")
ASSERTION_FIELDS = ("baseline", "expected", "kind", "marker", "snapshot", "surface")
# Executable assertion fields and the value an absent one stands for.
ASSERTION_DEFAULTS = {
    "baseline": "",
    "snapshot": "",
    "marker": "",
    "surface": "storage",
    "expect": "absent",
    "purpose": "residual",
    "finding_id": "",
    "rule_id": "",
}
BRANCH_FIELDS = (
    "component",
    "fixed_patch_level",
    "fixed_release",
    "platform",
    "references",
    "source",
    "updated_aosp_versions",
)


def json_text(value: Column) -> Column:
    """One text value as a JSON string literal."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return wrapped.substr(F.lit(6), F.length(wrapped) - 6)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys; null fields are left out."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]))


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def short_digest(value: Column, length: int) -> Column:
    return F.substring(digest(value), 1, length)


def locations(evidence: Column, present: Iterable[str]) -> Column:
    """The locating part of each evidence row; ``present`` names the fields the rows have."""
    names = set(present)

    def one(row: Column) -> Column:
        fields = {name: row[name] for name in LOCATION_FIELDS if name in names}
        if "dependency" in names:
            dep = row["dependency"]
            fields["dependency"] = F.when(
                dep.isNotNull(),
                F.struct(*[F.coalesce(dep[n], F.lit("")).alias(n) for n in DEPENDENCY_FIELDS]),
            )
        if "assertion" in names:
            item = row["assertion"]
            fields["assertion"] = F.when(
                item.isNotNull(),
                F.struct(*[F.coalesce(item[n], F.lit("")).alias(n) for n in ASSERTION_FIELDS]),
            )
        return F.struct(*[fields[name].alias(name) for name in sorted(fields)])

    return F.transform(evidence, one)


def finding_identity(rule: Column, evidence: Column, present: Iterable[str], scope: Column | None = None) -> Column:
    """Stable finding id from rule, scope and evidence locations."""
    scope = F.lit("app") if scope is None else F.coalesce(scope, F.lit("app"))
    body = F.concat(
        F.lit("["), json_text(rule), F.lit(","), json_text(scope), F.lit(","),
        F.to_json(locations(evidence, present)), F.lit("]"),
    )
    return F.concat(F.lit("F-"), short_digest(body, 20))


def path_identity(rule: Column, path: Column) -> Column:
    """Identity of a finding located by one path."""
    return finding_identity(rule, F.array(F.struct(path.alias("path"))), ("path",))


def dependency_identity(rule: Column, ecosystem: Column, name: Column, path: Column) -> Column:
    """Identity of an advisory at one dependency location."""
    dep = F.struct(ecosystem.alias("ecosystem"), name.alias("name"), path.alias("path"))
    return finding_identity(rule, F.array(F.struct(dep.alias("dependency"))), ("dependency",))


def branch_key(
    source: Column, platform: Column, component: Column, fixed_release: Column,
    fixed_patch_level: Column, updated_aosp_versions: Column, references: Column,
) -> Column:
    """Key of one vendor bulletin branch; empty for sources without branches."""
    text = lambda c: F.coalesce(c, F.lit(""))
    body = F.to_json(
        F.struct(
            text(component).alias("component"),
            text(fixed_patch_level).alias("fixed_patch_level"),
            text(fixed_release).alias("fixed_release"),
            text(platform).alias("platform"),
            F.slice(F.coalesce(references, F.array().cast("array<string>")), 1, 1).alias("references"),
            text(source).alias("source"),
            text(updated_aosp_versions).alias("updated_aosp_versions"),
        )
    )
    return F.when(source.isin("apple", "android"), short_digest(body, 24)).otherwise(F.lit(""))


def assertion_identity(**fields: Column) -> Column:
    """Digest of an assertion's executable fields, defaults filled in."""
    filled = {n: F.coalesce(fields.get(n, F.lit(None)).cast("string"), F.lit(d)) for n, d in ASSERTION_DEFAULTS.items()}
    return digest(canonical_json(**filled))


def subject_key(apps: Column, target: Column, selection: Column) -> Column:
    """Comparable subject of a report: its apps (else target) and its source selection."""
    known = F.array_sort(
        F.array_distinct(
            F.filter(apps, lambda a: a["platform"].isNotNull() & a["package"].isNotNull() & (a["package"] != ""))
        )
    )
    subject = F.when(F.size(known) > 0, F.to_json(known)).otherwise(F.concat(F.lit("target:"), F.coalesce(target, F.lit(""))))
    return digest(F.concat_ws("|", subject, F.coalesce(selection, F.lit(""))))


def build_binding(platform: Column, package: Column, build: Column, strong_hash: Column) -> Column:
    """Identity and state of a build binding; bound only with a strong artifact hash."""
    body = F.to_json(F.struct(build.alias("build"), package.alias("package"), platform.alias("platform")))
    strong = strong_hash.isNotNull() & (strong_hash != "")
    return F.struct(
        digest(body).alias("identity"),
        F.when(strong, "bound").otherwise("unavailable").alias("state"),
    )


def revision_body(set_fields: dict[str, Column], ordered_fields: dict[str, Column]) -> Column:
    """Semantic digest of an advisory revision: set fields ignore order, other fields keep it."""
    fields = dict(ordered_fields)
    for name, value in set_fields.items():
        fields[name] = F.array_sort(F.array_distinct(value))
    return digest(canonical_json(**fields))
