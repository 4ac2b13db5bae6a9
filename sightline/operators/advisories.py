"""Advisories: ranges, correlation with dependencies and devices, equivalence, revisions and history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import ranks
from sightline.functions.binding import let
from sightline.functions.canonical import dependency_identity
from sightline.functions.packages import is_cve
from sightline.functions.versions import numeric_version, patch_date, version_key
from sightline.operators.filters import vendor_scope
from sightline.operators.ranges import counts_below
from sightline.scale import latest, salted_join, top_k, with_previous

# Chipset vendors by words in the reported manufacturer, in order.
SOC_VENDORS = (
    ("qualcomm", ("qualcomm", "qti", "snapdragon")),
    ("mediatek", ("mediatek", "mtk")),
    ("unisoc", ("unisoc", "spreadtrum")),
    ("nvidia", ("nvidia",)),
    ("google", ("google", "tensor")),
    ("samsung", ("samsung", "exynos")),
)
# The record assigner and product labels of one mobile OS vendor.
OS_CNA = "286789f9-fbc2-4510-9f9a-43facdede74c"
OS_PRODUCTS = {"ios": ("ios", "iphone os", "ios and ipados"), "ipados": ("ipados", "ios and ipados")}
OFFICIAL_HOST = "support.apple.com"
RANGE_TYPE = (
    "array<struct<version:string,status:string,versionType:string,lessThan:string,lessThanOrEqual:string,changes:boolean>>"
)


def keyed_ranges(ranges: Column) -> Column:
    """Comparable ranges (array of RANGE_TYPE structs) as ``array<struct<lo, hi, inclusive, affected>>`` of version keys.

    Unknown orderings, branches and unparseable bounds are left out: they decide nothing. Computed once per advisory,
    it serves every version compared with it.
    """

    def keyed(entry: Column) -> Column:
        upper = F.coalesce(F.nullif(entry["lessThan"], F.lit("")), F.nullif(entry["lessThanOrEqual"], F.lit("")))
        lower = F.coalesce(entry["version"], F.lit(""))
        comparable = (
            entry["status"].isin("affected", "unaffected")
            & ~lower.isin("unspecified", "n/a", "*") & ~F.coalesce(upper == "*", F.lit(False))
            & ~F.coalesce(entry["changes"], F.lit(False))
            & (upper.isNull() | F.coalesce(entry["versionType"], F.lit("semver")).isin("semver", "python", "version"))
        )
        bounds = F.struct(
            version_key(lower).alias("lo"), version_key(upper).alias("hi"),
            entry["lessThanOrEqual"].isNotNull().alias("inclusive"), (entry["status"] == "affected").alias("affected"),
            upper.isNull().alias("single"),
        )
        usable = lambda b: F.when(b["lo"].isNotNull() & (b["single"] | b["hi"].isNotNull()), b)
        return F.when(comparable, let(bounds, usable))

    return F.array_compact(F.transform(ranges, keyed))


def in_keyed_range(key: Column, keyed: Column) -> Column:
    """True/false when the ranges that hold the version key agree; null when none decides or they conflict."""

    def decide(k: Column, b: Column) -> Column:
        below = F.when(b["inclusive"], k <= b["hi"]).otherwise(k < b["hi"])
        return F.when(F.when(b["single"], k == b["lo"]).otherwise((k >= b["lo"]) & below), b["affected"])

    found = let(key, lambda k: F.array_distinct(F.array_compact(F.transform(keyed, lambda b: decide(k, b)))))
    return let(found, lambda d: F.when(F.size(d) == 1, F.get(d, F.lit(0))))


def in_published_range(version: Column, ranges: Column) -> Column:
    """``in_keyed_range`` for a version and unkeyed ranges of one row."""
    return let(
        F.struct(version_key(version).alias("v"), keyed_ranges(ranges).alias("r")), lambda s: in_keyed_range(s["v"], s["r"])
    )


def zero_based_boundaries(ranges: Column) -> Column:
    """Distinct upper bounds when every range is an affected zero-based custom one; null otherwise."""

    def bound(entry: Column) -> Column:
        ok = (
            (entry["version"] == "0") & (entry["versionType"] == "custom") & (entry["status"] == "affected")
            & ~F.coalesce(entry["changes"], F.lit(False)) & entry["lessThanOrEqual"].isNull()
        )
        return F.when(ok, numeric_version(entry["lessThan"]))

    bounds = F.transform(ranges, bound)
    whole = (F.size(bounds) > 0) & F.forall(bounds, lambda b: b.isNotNull())
    return F.when(whole, F.array_distinct(bounds))


def official_reference(url: Column) -> Column:
    return url.rlike(rf"^https://{OFFICIAL_HOST.replace('.', chr(92) + '.')}(?:/[^?#]*)?$")


def os_branch_decision(
    version: Column, vendor: Column, ranges: Column, assigner: Column, publisher: Column, record_references: Column,
    bulletin_source: Column, bulletin_references: Column, fixed_release: Column, os_product: str,
) -> Column:
    """Decision for one confirmed boundary in the observed major; null wherever the evidence does not agree."""
    current = numeric_version(version)
    shared = F.array_intersect(record_references, bulletin_references)
    bounds = F.filter(zero_based_boundaries(ranges), lambda b: F.get(b, F.lit(0)) == F.get(current, F.lit(0)))
    one = F.get(bounds, F.lit(0))
    label_ok = fixed_release.rlike(
        r"(?i)^(?:iOS|iPadOS)\s+[0-9]+(?:\.[0-9]+){1,3}(?:\s+and\s+(?:iOS|iPadOS)\s+[0-9]+(?:\.[0-9]+){1,3})?$"
    )
    released = F.transform(
        F.regexp_extract_all(fixed_release, F.lit(rf"(?i)\b{os_product}\s+(\d+(?:\.\d+){{1,3}})\b"), F.lit(1)), numeric_version
    )
    agrees = (
        current.isNotNull() & (assigner == OS_CNA) & (publisher == OS_CNA) & (F.lower(vendor) == "apple")
        & (bulletin_source == "apple") & F.exists(shared, official_reference) & (F.size(bounds) == 1) & label_ok
        & F.exists(released, lambda r: r == one)
    )
    return F.when(agrees, current < one)


def soc_vendor(manufacturer: Column) -> Column:
    """Chipset vendor named by the device; empty when none is recognized."""
    text, out = F.lower(F.coalesce(manufacturer, F.lit(""))), F.lit("")
    for vendor, words in reversed(SOC_VENDORS):
        out = F.when(text.rlike("|".join(words)), vendor).otherwise(out)
    return out


POSTURE = ("platform", "security_patch", "vendor_security_patch", "version", "soc_manufacturer", "simulator")


def posture_classes(devices: DataFrame) -> DataFrame:
    """Distinct device states with their device counts; everything an advisory decision can depend on."""
    return devices.groupBy(*POSTURE).agg(F.count(F.lit(1)).alias("devices"))


def patch_states(classes: DataFrame, advisories: DataFrame) -> DataFrame:
    """Patch-level state of every advisory for every device class of its platform.

    Decisions are made once per distinct device state, and the few hot platform keys are salted.
    ``advisories``: id, platform, component, vendor_scope, fixed_patch_level, updated_versions.
    """
    rows = salted_join(advisories, classes, ["platform"], "id")
    scope = F.coalesce(F.nullif("vendor_scope", F.lit("")), vendor_scope(F.col("component")))
    vendor_level = F.when(scope != "platform", patch_date(F.col("vendor_security_patch")))
    actual = F.least(patch_date(F.col("security_patch")), vendor_level)
    fixed = patch_date(F.col("fixed_patch_level"))
    release = F.split_part(F.col("version"), F.lit("."), F.lit(1))
    listed = F.array_contains(F.regexp_extract_all(F.coalesce("updated_versions", F.lit("")), F.lit(r"\b\d+\b"), F.lit(0)), release)
    state = (
        F.when(F.col("simulator"), "simulator-only")
        .when((F.col("platform") != "android") | (F.coalesce("fixed_patch_level", F.lit("")) == ""), "device-info-required")
        .when(actual.isNull() | fixed.isNull(), "device-info-required")
        .when(actual >= fixed, "vendor-patch-level-satisfied")
        .when((release != "") & listed, "potentially-affected")
        .otherwise("applicability-unknown")
    )
    observed = soc_vendor(F.col("soc_manufacturer"))
    chip = F.when(
        scope.isin(*[v for v, _ in SOC_VENDORS]) & (observed != "") & ~F.col("simulator")
        & (F.col("platform") == "android") & (F.coalesce("fixed_patch_level", F.lit("")) != ""),
        F.when(observed == scope, "match").otherwise("mismatch"),
    ).otherwise("unknown")
    return rows.select(
        "id", *POSTURE, "devices", scope.alias("scope"), state.alias("state"), chip.alias("chipset_vendor")
    )


def patch_state_counts(classes: DataFrame, advisories: DataFrame) -> DataFrame:
    """Devices in each patch-level state of every advisory: id, state, devices.

    The states of :func:`patch_states` summed by advisory without meeting every device: devices below a fixed level are
    counted by running sums over their patch days, per platform and release, so the rows are linear in device states and
    advisories. Advisories with several rows count each; states without devices are left out.
    """
    level = F.array(
        F.struct(F.lit(False).alias("own"), patch_date(F.col("security_patch")).alias("day")),
        F.struct(F.lit(True).alias("own"), F.least(patch_date(F.col("security_patch")), patch_date(F.col("vendor_security_patch"))).alias("day")),
    )
    release = F.coalesce(F.split_part(F.col("version"), F.lit("."), F.lit(1)), F.lit(""))
    real = ~F.coalesce(F.col("simulator"), F.lit(False))
    held = classes.select("platform", real.alias("real"), release.alias("release"), "devices", F.explode(level).alias("l")).select("platform", "real", "release", "devices", "l.*")
    # per platform and kind of level: simulators, real devices, and those without a day
    whole = held.groupBy("platform", "own").agg(
        F.sum(F.when(~F.col("real"), F.col("devices")).otherwise(0)).alias("simulated"), F.sum(F.when(F.col("real"), F.col("devices")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("real") & F.col("day").isNull(), F.col("devices")).otherwise(0)).alias("undated"),
    )
    dated = held.where("real AND day IS NOT NULL")
    points = dated.withColumn("release", F.explode(F.array(F.lit("*"), F.nullif("release", F.lit(""))))).where("release IS NOT NULL")
    own = F.coalesce(F.nullif("vendor_scope", F.lit("")), vendor_scope(F.col("component"))) != "platform"
    listed = F.array_distinct(F.regexp_extract_all(F.coalesce("updated_versions", F.lit("")), F.lit(r"\b\d+\b"), F.lit(0)))
    fixed = F.when((F.col("platform") == "android") & (F.coalesce("fixed_patch_level", F.lit("")) != ""), patch_date(F.col("fixed_patch_level")))
    rows = advisories.select("id", "platform", own.alias("own"), fixed.alias("day"), F.concat(F.array(F.lit("*")), listed).alias("releases"))
    rows = rows.groupBy("id", "platform", "own", "day", "releases").agg(F.count(F.lit(1)).alias("times"))
    keys = ["platform", "own", "release"]
    bounds = rows.select("platform", "own", "day", F.explode("releases").alias("release"), F.lit(False).alias("inclusive")).distinct()
    below = counts_below(points, bounds, keys, "day", ["devices"]).withColumnRenamed("devices", "below").drop("inclusive")
    met = rows.withColumn("release", F.explode("releases")).join(below, [*keys, "day"], "left")
    each = met.groupBy("id", "platform", "own", "day", "releases", "times").agg(
        F.sum(F.when(F.col("release") == "*", F.col("below"))).alias("older"), F.sum(F.when(F.col("release") != "*", F.col("below"))).alias("affected"),
    )
    each = each.join(whole, ["platform", "own"])  # a few rows
    older, affected = F.coalesce("older", F.lit(0)), F.coalesce("affected", F.lit(0))
    known = F.col("day").isNotNull()
    number = {
        "simulator-only": F.col("simulated"),
        "device-info-required": F.when(known, F.col("undated")).otherwise(F.col("n")),
        "vendor-patch-level-satisfied": F.when(known, F.col("n") - F.col("undated") - older).otherwise(0),
        "potentially-affected": F.when(known, affected).otherwise(0),
        "applicability-unknown": F.when(known, older - affected).otherwise(0),
    }
    states = F.array(*[F.struct(F.lit(s).alias("state"), (n * F.col("times")).alias("devices")) for s, n in number.items()])
    out = each.select("id", F.explode(states).alias("s")).select("id", "s.*").where("devices > 0")
    return out.groupBy("id", "state").agg(F.sum("devices").alias("devices"))


def os_version_state(decisions: Column) -> Column:
    """State of an OS advisory from its product decisions (null = unknown)."""
    return (
        F.when(F.exists(decisions, lambda d: F.coalesce(d, F.lit(False))), "version-affected")
        .when((F.size(decisions) > 0) & F.forall(decisions, lambda d: ~F.coalesce(d, F.lit(True))), "outside-published-affected-range")
        .otherwise("applicability-unknown")
    )


def identity_rows(records: DataFrame) -> DataFrame:
    """(key, identity) of every record: display id, upstream id and aliases."""
    every = F.array_union(F.array_compact(F.array("id", "osv_id")), F.coalesce("aliases", F.array().cast("array<string>")))
    return records.select("key", F.explode(every).alias("identity")).where("identity <> ''")


def known_exploited(records: DataFrame, exploited: DataFrame) -> DataFrame:
    """Records with ``known_exploited``: any of their identities is in the exploited catalogue (column id)."""
    hits = identity_rows(records).join(exploited.select(F.col("id").alias("identity")).distinct(), "identity", "left_semi")
    flagged = hits.select("key").distinct().withColumn("__hit", F.lit(True))
    return records.join(flagged, "key", "left").withColumn("known_exploited", F.coalesce("__hit", F.lit(False))).drop("__hit")


def without_rejected(records: DataFrame, rejected: DataFrame) -> DataFrame:
    """Records re-keyed away from rejected display ids; dropped only when the upstream id itself is rejected.

    Records without an upstream id are dropped when their id is rejected.
    """
    bad = rejected.select(F.col("id").alias("identity")).distinct().withColumn("__bad", F.lit(True))
    judged = identity_rows(records).join(bad, "identity", "left")
    alive = F.col("__bad").isNull()
    folded = judged.groupBy("key").agg(
        F.min(F.when(alive & is_cve(F.col("identity")), F.col("identity"))).alias("__next"),
        F.collect_set(F.when(~alive, F.col("identity"))).alias("__gone"),  # bounded by one record's own identities
    )
    rows = records.join(folded, "key", "left")
    gone = F.coalesce("__gone", F.array().cast("array<string>"))
    display_gone = F.array_contains(gone, F.col("id"))
    dropped = display_gone & (F.col("osv_id").isNull() | F.array_contains(gone, F.col("osv_id")))
    shown = F.when(display_gone, F.coalesce("__next", "osv_id")).otherwise(F.col("id"))
    return (
        rows.where(~F.coalesce(dropped, F.lit(False))).withColumn("id", shown).withColumn("rejected_ids", gone)
        .drop("__next", "__gone")
    )


def equivalent_ids(display: Column, member_ids: Column, aliases: Column, rejected: Column) -> Column:
    """Display id, active member ids and aliases, minus rejected ones."""
    from sightline.functions.packages import bounded_advisory_ids

    merged = F.array_union(F.array_union(F.array(display), member_ids), aliases)
    return bounded_advisory_ids(display, F.array_except(merged, rejected))


def is_malicious(members: Column) -> Column:
    """An active member reports known malicious code. ``members``: ``array<struct<ids, withdrawn>>``."""
    return F.exists(members, lambda m: ~m["withdrawn"] & F.exists(m["ids"], lambda i: i.startswith("MAL-")))


def correlate(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependency findings: exact (name, ecosystem, version) matches of active advisories.

    ``deps``: app_id, ecosystem, name, version, path, confidence (and optionally unresolved_usage, superseded).
    ``advisories``: id, ecosystem, name, version, severity, withdrawn, malicious, known_exploited, advisory_ids.
    """
    have = set(deps.columns)
    usable = deps
    for flag in ("unresolved_usage", "superseded"):
        if flag in have:
            usable = usable.where(~F.coalesce(F.col(flag), F.lit(False)))
    active = advisories.where(~F.coalesce("withdrawn", F.lit(False))).drop("confidence", "path", "app_id")
    rows = usable.join(active, ["name", "ecosystem", "version"])
    base = F.when(F.col("malicious"), "critical").otherwise(F.coalesce("severity", F.lit("medium")))
    lifted = F.greatest(ranks.severity_rank(base), F.when(F.col("known_exploited"), F.lit(3)).otherwise(F.lit(0)))
    return rows.select(
        "app_id", dependency_identity(F.col("id"), F.col("ecosystem"), F.col("name"), F.col("path")).alias("finding_id"),
        F.col("id").alias("rule_id"), "ecosystem", "name", "version", "path",
        ranks.name_of(lifted, ranks.SEVERITIES).alias("severity"),
        F.when(F.col("confidence") == "exact", "version-affected").otherwise("candidate").alias("status"),
        "known_exploited", "advisory_ids",
    )


def merge_dependency_findings(matches: DataFrame, keys: Sequence[str] = ("app_id", "finding_id")) -> DataFrame:
    """One finding per identity: strongest severity, confirmed if any match is, exact counts of versions.

    The matched versions are rows of :func:`finding_versions`; alias ids are merged.
    """
    merged = matches.groupBy(*keys, "rule_id", "ecosystem", "name", "path").agg(
        F.max(ranks.severity_rank(F.col("severity"))).alias("__rank"),
        F.bool_or(F.col("status") == "version-affected").alias("__affected"),
        F.bool_or("known_exploited").alias("known_exploited"),
        F.count_distinct("version").alias("versions"), F.min("version").alias("first_version"),
    )
    alias_rows = matches.select(*keys, F.explode("advisory_ids").alias("a")).distinct()
    display = matches.select(*keys, F.col("rule_id").alias("a")).distinct()
    others = alias_rows.join(display, [*keys, "a"], "left_anti")
    kept = others.groupBy(*keys).agg(F.collect_list("a").alias("__ids"))  # the aliases of one advisory
    rows = merged.join(kept, list(keys), "left")
    ids = F.array_sort(F.array_union(F.array("rule_id"), F.coalesce("__ids", F.array().cast("array<string>"))))
    return rows.select(
        *keys, "rule_id", "ecosystem", "name", "path", ranks.name_of(F.col("__rank"), ranks.SEVERITIES).alias("severity"),
        F.when(F.col("__affected"), "version-affected").otherwise("candidate").alias("status"),
        "known_exploited", "versions", "first_version", ids.alias("advisory_ids"),
    )


def finding_versions(matches: DataFrame, keys: Sequence[str] = ("app_id", "finding_id")) -> DataFrame:
    """The distinct matched versions of each merged finding, as rows."""
    return matches.select(*keys, "version").distinct()


BRANCH = ("id", "state", "platform", "component", "fixed_release", "fixed_patch_level", "updated_versions", "snapshot_hash")


def dedup_branches(entries: DataFrame, keys: Sequence[str] = BRANCH) -> tuple[DataFrame, DataFrame]:
    """(branches, references): one row per branch key, and the union of its references as rows."""
    keys = list(keys)
    refs = entries.select(*keys, F.explode("references").alias("reference")).distinct()
    counts = refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("reference_count"))
    branches = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries")).join(counts, keys, "left")
    return branches.withColumn("reference_count", F.coalesce("reference_count", F.lit(0))), refs


def os_finding_rows(findings: DataFrame, keys: Sequence[str] = ("finding_id",)) -> DataFrame:
    """The branches of each merged environment finding with the union of their references, as rows."""
    return findings.select(*keys, "branch", F.explode_outer("references").alias("reference")).distinct()


def merge_os_findings(findings: DataFrame, keys: Sequence[str] = ("finding_id",)) -> DataFrame:
    """One environment finding per identity with exact counts of its branches and references.

    ``findings``: keys, branch, references; the branch and reference rows themselves stay available there.
    """
    branches = findings.groupBy(*keys).agg(F.count_distinct("branch").alias("branches"), F.min("branch").alias("first_branch"))
    refs = findings.select(*keys, F.explode_outer("references").alias("r")).groupBy(*keys).agg(
        F.count_distinct("r").alias("references")
    )
    return branches.join(refs, list(keys))


def latest_members(members: DataFrame, keys: Sequence[str] = ("source", "osv_id")) -> tuple[DataFrame, DataFrame]:
    """(latest, conflicts): the newest revision per member; equal revisions must agree in ``body_hash``.

    Conflicts list the keys whose newest revision has more than one body; they are left out of ``latest``.
    """
    keys = list(keys)
    newest = members.groupBy(*keys).agg(F.max("modified").alias("modified"))
    at = members.join(newest, [*keys, "modified"])
    bodies = at.groupBy(*keys, "modified").agg(F.min("body_hash").alias("__lo"), F.max("body_hash").alias("__hi"))
    conflicts = bodies.where("__lo <> __hi").select(*keys, "modified")
    clean = latest(at, keys, ["body_hash"]).join(conflicts.select(*keys), keys, "left_anti")
    return clean, conflicts


def group_members(members: DataFrame, keys: Sequence[str] = ("source", "id")) -> DataFrame:
    """One advisory per display id: the strongest active member, withdrawn only when all members are.

    ``members``: keys, osv_id, severity, withdrawn (text or null), aliases. Of the alias union the row holds the size and
    the least member; :func:`member_unions` gives all of it, with references and affected ranges.
    """
    active = F.col("withdrawn").isNull()
    rank = F.struct(active.alias("a"), ranks.severity_rank(F.coalesce("severity", F.lit("medium"))).alias("r"), F.col("osv_id"))
    best = members.groupBy(*keys).agg(
        F.max_by(F.struct("osv_id", "severity"), rank).alias("best"), F.count(F.lit(1)).alias("members"),
        F.bool_or(active).alias("any_active"), F.max("withdrawn").alias("last_withdrawn"),
    )
    aliases = members.select(*keys, F.explode("aliases").alias("a")).distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("alias_count"), F.min("a").alias("first_alias")
    )
    rows = best.join(aliases, list(keys), "left")
    return rows.select(
        *keys, F.col("best.osv_id").alias("osv_id"), F.col("best.severity").alias("severity"), "members",
        F.when(F.col("any_active"), F.lit(None)).otherwise(F.col("last_withdrawn")).alias("withdrawn"),
        F.coalesce("alias_count", F.lit(0)).alias("alias_count"), F.coalesce("first_alias", F.lit("")).alias("first_alias"),
    )


def member_unions(members: DataFrame, keys: Sequence[str] = ("source", "id")) -> DataFrame:
    """What the members of a display id name together, one row a value: keys, kind (alias, reference or affected), value,
    members, first_member, active.

    ``members``: keys, osv_id, withdrawn, and arrays of text aliases, references and affected (ranges as canonical text;
    a null array is empty). ``members`` counts those that name the value, ``first_member`` is the least of them, active
    members before withdrawn ones, and ``active`` tells whether one of them is. Of several members only active ones give
    affected ranges; a member alone keeps its own. Values stay rows, so no list grows with a group.
    """
    keys = list(keys)
    kinds = {"alias": "aliases", "reference": "references", "affected": "affected"}
    lists = [
        F.transform(F.coalesce(c, F.array().cast("array<string>")), _named(kind)) for kind, c in kinds.items() if c in members.columns
    ]
    alive = F.col("withdrawn").isNull()
    named = members.select(*keys, "osv_id", alive.alias("alive"), F.explode(F.concat(*lists)).alias("n")).select(*keys, "osv_id", "alive", "n.*")
    named = named.where("value IS NOT NULL")
    sizes = members.groupBy(*keys).agg((F.countDistinct("osv_id") > 1).alias("several"))
    ranges = (F.col("kind") == "affected") & F.col("several") & ~F.col("alive")
    rows = named.join(sizes, keys).where(~ranges)
    rank = F.struct((~F.col("alive")).alias("gone"), "osv_id")
    return rows.groupBy(*keys, "kind", "value").agg(
        F.countDistinct("osv_id").alias("members"), F.min(rank)["osv_id"].alias("first_member"), F.bool_or("alive").alias("active")
    )


def _named(kind: str):
    return lambda value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def correlation_window(records: DataFrame, deps: DataFrame, limit: int) -> DataFrame:
    """Records relevant to the dependencies: the newest ``limit`` and, whatever their age, every exact package feed."""
    wanted = deps.select(F.concat_ws(":", F.lit("osv"), "ecosystem", "name", "version").alias("source")).distinct()
    exact = records.join(wanted, "source", "left_semi")
    recent = records.orderBy(F.col("modified").desc(), F.col("id"), F.col("source"), F.col("branch")).limit(limit)
    return exact.unionByName(recent).dropDuplicates(["id", "source", "branch"])


def latest_observations(observations: DataFrame, keys: Sequence[str] = ("id", "source", "branch")) -> DataFrame:
    """The last observation per branch."""
    return latest(observations, keys, ["sequence"])


def changes_only(observations: DataFrame, keys: Sequence[str] = ("id", "source", "branch")) -> DataFrame:
    """Observations whose content differs from the one before; a return to an earlier content counts."""
    rows = with_previous(observations, keys, ["sequence"], "snapshot_hash", "previous_hash")
    return rows.where(F.col("previous_hash").isNull() | (F.col("previous_hash") != F.col("snapshot_hash")))


def current_and_branches(current: DataFrame, branches: DataFrame) -> DataFrame:
    """Unbranched and branched advisories as one table."""
    return current.unionByName(branches, allowMissingColumns=True).fillna("", subset=["branch"])


def feed_health(feeds: DataFrame, required: Sequence[str], as_of) -> DataFrame:
    """Every required or observed feed with staleness (no success within a day) and the required flag."""
    spark = feeds.sparkSession
    names = spark.createDataFrame([(s,) for s in required], "source string").withColumn("required", F.lit(True))
    rows = names.join(feeds, "source", "full_outer")
    success = F.when(F.col("source") == "cve", F.col("fetched_ok")).otherwise(F.col("succeeded")) if "fetched_ok" in feeds.columns else F.col("succeeded")
    stale = F.coalesce(success < F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 1 DAY"), F.lit(True))
    return rows.select(
        "source", F.coalesce("required", F.lit(False)).alias("required"), F.coalesce("status", F.lit("never-synced")).alias("status"),
        stale.alias("stale"),
    )
