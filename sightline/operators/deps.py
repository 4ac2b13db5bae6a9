"""Dependencies: catalogue usage, resolved builds, selection, query order and bills of materials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import ranks
from sightline.functions.packages import package_url
from sightline.functions.paths import alias_key, parent
from sightline.scale import numbered, top_k

# Usage states of a catalogue alias, strongest first.
USAGE_ORDER = (
    "declared",
    "platform-only",
    "non-shipping-configuration",
    "non-shipping-module",
    "build-tooling",
    "referenced-unclassified",
)
QUERYABLE = ("Maven", "npm", "PyPI", "Go", "Pub", "SwiftURL", "CocoaPods")


def lockfile_module(path):
    """Module directory of a lockfile; per-configuration lock folders belong to the directory above."""
    directory = parent(path)
    nested = F.regexp_extract(directory, r"^(?:(.*)/)?gradle/dependency-locks$", 1)
    is_nested = directory.rlike(r"(?:^|/)gradle/dependency-locks$")
    return F.when(is_nested, F.when(nested == "", ".").otherwise(nested)).otherwise(directory)


def resolve_catalog_usage(catalog: DataFrame, references: DataFrame, roles: DataFrame, keep: int = 20) -> DataFrame:
    """Usage state, reference count, all declaring modules and a sample of ``keep`` references of every catalogue entry.

    The references themselves are rows of :func:`catalog_references`.
    """
    matched = catalog_references(catalog, references, roles)
    declared = F.col("ref_state") == "declared"
    folded = matched.groupBy("app_id", "entry_id").agg(
        F.max(ranks.rank_of(F.col("ref_state"), tuple(reversed(USAGE_ORDER)), -1)).alias("__state"),
        F.count(F.lit(1)).alias("reference_count"),
        F.sum(declared.cast("bigint")).alias("declared_references"),
        F.bool_or(declared & F.col("module").isNull()).alias("__shared"),
    )
    modules = matched.where(declared & F.col("module").isNotNull()).select("app_id", "entry_id", "module").distinct()
    declaring = modules.groupBy("app_id", "entry_id").agg(F.array_sort(F.collect_list("module")).alias("declaring_modules"))  # modules of one app
    listed = top_k(
        matched, ["app_id", "entry_id"], [(~declared).cast("int"), F.col("path"), F.col("line")], keep, "__n"
    ).groupBy("app_id", "entry_id").agg(
        F.array_sort(F.collect_list(F.struct((~declared).cast("int").alias("o"), "path", "line", F.col("ref_state").alias("state")))).alias("usage")
    )
    rows = catalog.join(folded, ["app_id", "entry_id"], "left").join(declaring, ["app_id", "entry_id"], "left").join(
        listed, ["app_id", "entry_id"], "left"
    )
    state = F.when(F.col("catalog").isNull(), "catalog-name-unresolved").otherwise(
        F.coalesce(ranks.name_of(F.col("__state"), tuple(reversed(USAGE_ORDER))), F.lit("no-reference-found"))
    )
    used = F.coalesce(state == "declared", F.lit(False))
    return rows.select(
        *[c for c in catalog.columns if c not in ("confidence",)],
        state.alias("usage_state"), F.coalesce("reference_count", F.lit(0)).alias("reference_count"),
        F.when(~F.coalesce("__shared", F.lit(False)), F.col("declaring_modules")).alias("declaring_modules"),
        F.when(used, "declared").otherwise(F.col("confidence")).alias("confidence"),
        F.when(used, "catalog-alias-declared").otherwise("catalog-declared-unresolved-usage").alias("version_source"),
        F.coalesce("usage", F.array().cast("array<struct<o:int,path:string,line:int,state:string>>")).alias("usage"),
    )


def catalog_references(catalog: DataFrame, references: DataFrame, roles: DataFrame) -> DataFrame:
    """Every reference of every catalogue entry, as rows: app_id, entry_id, path, line, module, ref_state.

    ``catalog``: app_id, entry_id, catalog, alias, bundles ARRAY, root, confidence. ``references``: app_id, catalog, kind
    (library or bundle), accessor, path, line, module (null for shared scripts), state. ``roles``: app_id, module, role.
    Entries meet references on (app, catalog, kind, normalized key); the root prefix is checked after.
    """
    unshipped = roles.where(F.col("role").isin("build-tooling", "non-shipping-module"))
    refs = references.join(unshipped, ["app_id", "module"], "left").select(
        "app_id", "catalog", "kind", alias_key(F.col("accessor")).alias("__key"), "path", "line", "module",
        F.when((F.col("state") == "declared") & F.col("role").isNotNull(), F.col("role")).otherwise(F.col("state")).alias("ref_state"),
    )
    wanted = F.concat(
        F.array(F.struct(F.lit("library").alias("kind"), alias_key(F.col("alias")).alias("k"))),
        F.transform(
            F.coalesce("bundles", F.array().cast("array<string>")),
            lambda b: F.struct(F.lit("bundle").alias("kind"), alias_key(b).alias("k")),
        ),
    )
    keyed = catalog.select("app_id", "entry_id", "catalog", "root", F.explode(F.array_distinct(wanted)).alias("w")).select(
        "app_id", "entry_id", "catalog", "root", F.col("w.kind").alias("kind"), F.col("w.k").alias("__key")
    )
    matched = keyed.join(refs, ["app_id", "catalog", "kind", "__key"]).where(
        (F.col("root") == ".") | F.col("path").startswith(F.concat("root", F.lit("/")))
    )
    return matched.select("app_id", "entry_id", "path", "line", "module", "ref_state")


def supersede(deps: DataFrame, roles: DataFrame, reach: DataFrame, keys: Sequence[str] = ("app_id",)) -> DataFrame:
    """Resolution state of declared Maven rows covered by the lockfiles of every application that ships them.

    ``deps``: keys, dep_id, ecosystem, name, version, path, confidence, version_source and ``declaring`` ARRAY (modules).
    ``reach``: keys, root, module. Coverage is relational division: the shipping roots of a declaration minus the
    applications that resolved the package must be empty.
    """
    keys = list(keys)
    locked = F.col("version_source") == "gradle-lockfile-resolved"
    applications = roles.where("role = 'application'").select(*keys, F.col("module").alias("app_module"))
    lock_rows = deps.where(locked).withColumn("app_module", lockfile_module(F.col("path")))
    own = lock_rows.join(applications, [*keys, "app_module"], "left_semi")
    other = lock_rows.join(applications, [*keys, "app_module"], "left_anti")
    resolved = own.select(*keys, "name", F.col("app_module").alias("root")).distinct()
    versions = own.select(*keys, "name", "version").distinct().groupBy(*keys, "name").agg(
        F.count(F.lit(1)).alias("resolved_versions")
    )
    declared = deps.where(~locked & (F.col("ecosystem") == "Maven") & (F.col("confidence") == "declared")).join(
        versions, [*keys, "name"]
    )
    shippers = (
        declared.select(*keys, "dep_id", "name", F.explode("declaring").alias("module"))
        .join(reach, [*keys, "module"]).select(*keys, "dep_id", "name", "root").distinct()
    )
    covered = shippers.join(resolved.withColumn("__ok", F.lit(True)), [*keys, "name", "root"], "left").groupBy(*keys, "dep_id").agg(
        F.every(F.coalesce("__ok", F.lit(False))).alias("covered")
    )
    judged = declared.join(covered, [*keys, "dep_id"], "left").select(
        *keys, "dep_id", "resolved_versions",
        F.when(F.coalesce("covered", F.lit(False)), "superseded-by-resolved-build").otherwise("resolved-in-other-module").alias("resolution"),
    )
    demoted = other.select(*keys, "dep_id").withColumn("__other", F.lit(True))
    rows = deps.join(judged, [*keys, "dep_id"], "left").join(demoted, [*keys, "dep_id"], "left")
    away = F.coalesce("__other", F.lit(False))
    return rows.select(
        *[c for c in deps.columns if c not in ("confidence", "version_source")],
        F.when(away, "declared").when(F.col("resolution") == "superseded-by-resolved-build", "unknown").otherwise(F.col("confidence")).alias("confidence"),
        F.when(away, "gradle-lockfile-non-application-module").otherwise(F.col("version_source")).alias("version_source"),
        F.coalesce("resolution", F.lit("")).alias("resolution"),
        F.coalesce("resolved_versions", F.lit(0)).alias("resolved_versions"),
    )


def select_evidence(
    deps: DataFrame, reach: DataFrame, selection: DataFrame, keys: Sequence[str] = ("app_id",)
) -> DataFrame:
    """Dependency rows that belong to the selected application module and runtime configuration.

    ``selection``: keys, application_module, runtime_configuration, complete (the module graph is whole and the module
    is an application). Packages selected in several versions are demoted.
    """
    keys = list(keys)
    lock = F.col("version_source").startswith("gradle-lockfile")
    rows = deps.join(selection, keys)
    available = reach.select(*keys, F.col("root").alias("application_module"), "module").distinct()
    locked = rows.where(
        lock & (lockfile_module(F.col("path")) == F.col("application_module"))
        & F.array_contains("configurations", F.col("runtime_configuration"))
    ).withColumn("selection", F.when(F.col("complete"), "selected").otherwise("partial"))
    several = locked.groupBy(*keys, "ecosystem", "name").agg(F.count_distinct("version").alias("__versions"))
    locked = locked.join(several, [*keys, "ecosystem", "name"])
    clash = (F.col("__versions") > 1) | ~F.col("complete")
    locked = locked.select(
        *[F.col(c) for c in deps.columns if c not in ("confidence", "version_source")],
        F.when(clash, "partial").otherwise(F.col("selection")).alias("selection"),
        F.when(clash, "declared").otherwise(F.col("confidence")).alias("confidence"),
        F.when(clash, "gradle-lockfile-selection-partial").otherwise(F.col("version_source")).alias("version_source"),
    )
    plain = rows.where(~lock)
    scoped = F.col("complete") & (F.col("ecosystem") == "Maven") & (F.size("declaring") > 0)
    inside = plain.where(scoped).withColumn("module", F.explode("declaring")).join(
        available, [*keys, "application_module", "module"], "left_semi"
    ).drop("module").dropDuplicates([*keys, "dep_id"])
    kept = plain.where(~F.coalesce(scoped, F.lit(False))).unionByName(inside)
    rest = kept.select(
        *[F.col(c) for c in deps.columns if c not in ("confidence", "version_source")],
        F.lit("").alias("selection"), "confidence", "version_source",
    )
    return locked.unionByName(rest)


def query_states(deps: DataFrame, health: DataFrame, attempted: DataFrame | None = None) -> DataFrame:
    """Query state per distinct coordinate, from its strongest confidence and its feed.

    ``health``: source, status, stale; ``attempted``: source.
    """
    superseded = F.coalesce("superseded", F.lit(False)) if "superseded" in deps.columns else F.lit(False)
    coords = deps.groupBy("ecosystem", "name", "version").agg(
        F.max(ranks.confidence_rank(F.col("confidence"))).alias("confidence_rank"), F.every(superseded).alias("superseded"),
        F.count(F.lit(1)).alias("rows"),
    ).withColumn("source", F.concat_ws(":", F.lit("osv"), "ecosystem", "name", "version"))
    rows = coords.join(health.select("source", "status", "stale"), "source", "left")
    tried = F.lit(False)
    if attempted is not None:
        rows = rows.join(attempted.select("source").distinct().withColumn("__tried", F.lit(True)), "source", "left")
        tried = F.coalesce("__tried", F.lit(False))
    ok = F.coalesce((F.col("status") == "ok") & ~F.col("stale"), F.lit(False))
    state = (
        F.when(F.col("superseded"), "superseded")
        .when(~F.col("ecosystem").isin(*QUERYABLE) | (F.col("confidence_rank") == 0) | (F.col("version") == ""), "unsupported")
        .when(ok, F.when(tried, "complete").otherwise("cached"))
        .when(tried & (F.col("status") == "partial"), "partial").when(tried & (F.col("status") == "error"), "error")
        .otherwise("not-checked")
    )
    return rows.select(
        "ecosystem", "name", "version", "rows", state.alias("state"), state.isin("complete", "cached").alias("checked"),
        tried.alias("transmitted"),
    )


def query_order(deps: DataFrame, fresh: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` coordinates to query first, with how many remain.

    Stale before fresh, declared in build files before lockfile-only, stronger confidence first.
    """
    direct = deps.groupBy("ecosystem", "name").agg(
        F.bool_or(~F.col("version_source").startswith("gradle-lockfile")).alias("direct")
    )
    coords = deps.groupBy("ecosystem", "name", "version").agg(F.max(ranks.confidence_rank(F.col("confidence"))).alias("c"))
    ready = coords.where((F.col("c") > 0) & (F.col("version") != "") & F.col("ecosystem").isin(*QUERYABLE))
    rows = ready.join(direct, ["ecosystem", "name"]).join(
        fresh.select("ecosystem", "name", "version").distinct().withColumn("fresh", F.lit(True)), ["ecosystem", "name", "version"], "left"
    ).withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    order = [F.col("fresh"), (~F.col("direct")).cast("int"), -F.col("c"), F.col("ecosystem"), F.col("name"), F.col("version")]
    first = rows.orderBy(*order).limit(cap).withColumn("confidence", ranks.name_of(F.col("c"), ranks.CONFIDENCES))
    remaining = ready.agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).cast("bigint").alias("remaining"))
    return first.join(F.broadcast(remaining)).select("ecosystem", "name", "version", "fresh", "direct", "confidence", "remaining")  # one row


def bom_components(deps: DataFrame, keys: Sequence[str] = ("app_id",), ordered: bool = False) -> DataFrame:
    """One component per (keys, ecosystem, name, version) with its package URL.

    ``ordered`` deals the rows out by keys and ``position``, the place in a document, before equal ones are gathered, so
    that one shuffle serves both; partitions then follow one another in that order.
    """
    names = ["ecosystem", "name", "version"]
    if ordered:
        position = F.concat_ws("|", *names)  # made again on the other side, so it is not shuffled beside its parts
        # few bytes become long lines, so the tasks are not to be merged by size
        tasks = int(deps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        deps = deps.repartitionByRange(tasks, *keys, position).withColumn("position", position)
        names = ["position", *names]
    unique = deps.groupBy(*keys, *names).agg(
        F.max(ranks.confidence_rank(F.col("confidence"))).alias("c"), F.min("path").alias("path"), F.count(F.lit(1)).alias("evidence")
    )
    purl = package_url(F.col("ecosystem"), F.col("name"), F.col("version"))
    return unique.select(
        *keys, *names, ranks.name_of(F.col("c"), ranks.CONFIDENCES).alias("confidence"), "path", "evidence",
        F.coalesce(purl, F.concat_ws(":", F.lit("dep"), "ecosystem", "name", "version")).alias("ref"), F.coalesce(purl, F.lit("")).alias("purl"),
    )


def bom_vulnerabilities(matches: DataFrame, components: DataFrame, keys: Sequence[str] = ("app_id",)) -> DataFrame:
    """(keys, vulnerability, ref): every component a vulnerability affects."""
    on = [*keys, "ecosystem", "name", "version"]
    return matches.join(components.select(*on, "ref"), on).select(*keys, F.col("rule_id").alias("vulnerability"), "severity", "ref").distinct()


def ordinal(deps: DataFrame, order: Sequence[str]) -> DataFrame:
    """Stable positions over all rows (used for bom references without a package URL)."""
    return numbered(deps, [], order, "position")
