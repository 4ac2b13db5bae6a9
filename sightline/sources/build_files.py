"""Dependency rows from build and lock files, given as (app_id, path, text) rows."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.paths import base_name
from sightline.operators.code_checks import with_cleaned
from sightline.operators.filters import shipped_configuration

FIELDS = ("app_id", "path", "ecosystem", "name", "version", "confidence", "version_source")
LOCK_LINE = r"^([^:=\s]+):([^:=\s]+):([^:=\s]+)(?:=([^=\s]*))?$"
DECLARATION = r"""\b(?:implementation|api|compileOnly|runtimeOnly)\s*\(?\s*(["'])([^"':\s]+:[^"':\s]+):([^"'\s]+)\1"""
# Package-URL type to ecosystem.
PURL_ECOSYSTEMS = {"maven": "Maven", "npm": "npm", "pypi": "PyPI", "golang": "Go", "pub": "Pub", "swift": "SwiftURL"}


def _rows(df: DataFrame, ecosystem, name, version, confidence, source) -> DataFrame:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(
        "app_id", "path", lit(ecosystem).alias("ecosystem"), name.alias("name"), version.alias("version"), lit(confidence).alias("confidence"),
        lit(source).alias("version_source"), *[c for c in df.columns if c.startswith("x_")],
    )


def lockfile_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dependencies, rejects) of resolved coordinates per configuration; only shipped ones become dependencies."""
    legacy = F.regexp_extract("path", r"(?:^|/)gradle/dependency-locks/([^/]+)\.lockfile$", 1)
    lines = files.select("app_id", "path", legacy.alias("legacy"), F.explode(F.split("text", r"\r?\n")).alias("line"))
    lines = lines.withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("empty="))
    good = lines.where(F.col("line").rlike(LOCK_LINE))
    part = lambda i: F.regexp_extract("line", LOCK_LINE, i)
    names = F.when(F.col("legacy") != "", F.array("legacy")).otherwise(F.split(part(4), ","))
    shipped = F.array_sort(F.filter(names, lambda c: (c != "") & shipped_configuration(c)))
    rows = good.withColumn("x_configurations", shipped).where(F.size("x_configurations") > 0)
    return (
        _rows(rows, "Maven", F.concat(part(1), F.lit(":"), part(2)), part(3), "exact", "gradle-lockfile-resolved"),
        lines.where(~F.col("line").rlike(LOCK_LINE)).select("app_id", "path", "line"),
    )


def declared_rows(files: DataFrame) -> DataFrame:
    """Literal build-script declarations outside comments; dynamic or qualified versions stay unknown."""
    text = with_cleaned(files.withColumn("suffix", F.lit(".gradle")))
    found = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(DECLARATION), F.lit(2)).alias("n"), F.regexp_extract_all("text", F.lit(DECLARATION), F.lit(3)).alias("v")
    )
    rows = text.select("app_id", "path", F.explode(found).alias("d"))
    version = F.col("d.v")
    exact = ~version.rlike(r"[$+\[\](),:@]") & (F.lower(version) != "latest.release")
    return _rows(rows, "Maven", F.col("d.n"), version, F.when(exact, "declared").otherwise("unknown"), "build-script")


CATALOG_SCHEMA = "app_id string, path string, kind string, alias string, module string, version string, ref string, member string"


def _catalog_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in CATALOG_SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for app, path, text in zip(batch["app_id"], batch["path"], batch["text"]):
            try:
                document = tomllib.loads(text)
            except ValueError:
                rows.append((app, path, "invalid", None, None, None, None, None))
                continue
            for alias, value in (document.get("versions") or {}).items():
                if isinstance(value, str):
                    rows.append((app, path, "version", alias, None, value, None, None))
            for alias, entry in (document.get("libraries") or {}).items():
                if isinstance(entry, str):
                    pieces = entry.split(":")
                    module, version, ref = ":".join(pieces[:2]), pieces[2] if len(pieces) == 3 else "", None
                    if len(pieces) not in (2, 3):
                        continue
                elif isinstance(entry, dict):
                    module = entry.get("module") or f"{entry.get('group', '')}:{entry.get('name', '')}"
                    stated = entry.get("version", "")
                    ref = stated.get("ref") if isinstance(stated, dict) else None
                    version = stated if isinstance(stated, str) else ""
                else:
                    continue
                rows.append((app, path, "library", alias, module, version, ref, None))
            for bundle, members in (document.get("bundles") or {}).items():
                if isinstance(members, list):
                    rows += [(app, path, "bundle", bundle, None, None, None, m) for m in members if isinstance(m, str)]
        yield pd.DataFrame(rows, columns=columns)


def catalog_entries(files: DataFrame) -> DataFrame:
    """Version-catalogue rows (versions, libraries, bundle members) of each file."""
    return files.select("app_id", "path", "text").mapInPandas(_catalog_batches, CATALOG_SCHEMA)


def catalog_rows(files: DataFrame) -> DataFrame:
    """Catalogue libraries with their version (references looked up in their file) and bundles; usage is not resolved yet."""
    fields = {"version": ("alias", "version"), "library": ("alias", "module", "version", "ref"), "bundle": ("alias", "member")}
    lists = [F.collect_list(F.when(F.col("kind") == kind, F.struct(*names))).alias(kind) for kind, names in fields.items()]
    # the entries of one file, so that every file is parsed and shuffled once; files without an app or a path look up nothing
    entries = catalog_entries(files).groupBy("app_id", "path").agg(*lists)
    named = F.col("app_id").isNotNull() & F.col("path").isNotNull()

    def resolved(item: Column) -> Column:
        versions = F.filter("version", lambda v: named & (v["alias"] == item["ref"]))
        bundles = F.filter("bundle", lambda b: named & (b["member"] == item["alias"]))
        return F.struct(
            item["alias"].alias("x_alias"), item["module"].alias("module"), item["version"].alias("version"),
            F.transform(versions, lambda v: v["version"]).alias("looked_up"), F.array_sort(F.array_distinct(F.transform(bundles, lambda b: b["alias"]))).alias("x_bundles"),
        )

    rows = entries.select("app_id", "path", F.explode(F.transform("library", resolved)).alias("l"))
    rows = rows.select("app_id", "path", "l.module", "l.version", F.explode_outer("l.looked_up").alias("looked_up"), "l.x_bundles", "l.x_alias")
    rows = rows.withColumn("resolved", F.coalesce("looked_up", "version")).where(F.coalesce("resolved", F.lit("")) != "")
    return _rows(rows, "Maven", F.col("module"), F.col("resolved"), "unknown", "catalog-declared-unresolved-usage")


PINS = "pins array<struct<identity:string,location:string,repositoryURL:string,state:struct<version:string>>>, object struct<pins:array<struct<identity:string,location:string,repositoryURL:string,state:struct<version:string>>>>"


def swift_pins(files: DataFrame) -> DataFrame:
    """Swift package pins, in either file layout."""
    parsed = files.select("app_id", "path", F.from_json("text", PINS).alias("j"))
    rows = parsed.select("app_id", "path", F.explode(F.coalesce("j.pins", "j.object.pins")).alias("p"))
    name = F.regexp_replace(F.coalesce("p.location", "p.repositoryURL", "p.identity"), r"\.git$", "")
    version = F.coalesce("p.state.version", F.lit(""))
    return _rows(rows, "SwiftURL", name, version, F.when(version != "", "exact").otherwise("unknown"), "package-resolved")


def pod_lock_rows(files: DataFrame) -> DataFrame:
    """Pods with their versions from the PODS section; subspecs count as their pod."""
    section = F.split_part(F.regexp_replace("text", r"(?s)^.*?PODS:", ""), F.lit("DEPENDENCIES:"), F.lit(1))
    pattern = r"(?m)^  - ([\w.+/-]+) \(([^)]+)\)"
    found = F.arrays_zip(
        F.regexp_extract_all(section, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(section, F.lit(pattern), F.lit(2)).alias("v")
    )
    rows = files.select("app_id", "path", F.explode(found).alias("p"))
    return _rows(rows, "CocoaPods", F.split_part("p.n", F.lit("/"), F.lit(1)), F.col("p.v"), "exact", "podfile-lock")


NPM = "packages map<string,struct<version:string>>, dependencies map<string,struct<version:string>>"


def npm_lock_rows(files: DataFrame) -> DataFrame:
    """npm lock packages of both layouts."""
    parsed = files.select("app_id", "path", F.from_json("text", NPM).alias("j"))
    new = parsed.select("app_id", "path", F.explode("j.packages").alias("k", "v")).where(F.contains("k", F.lit("node_modules/")))
    new = new.withColumn("k", F.regexp_extract("k", r"^.*node_modules/(.*)$", 1))
    old = parsed.select("app_id", "path", F.explode("j.dependencies").alias("k", "v"))
    rows = new.unionByName(old).where(F.coalesce("v.version", F.lit("")) != "")
    return _rows(rows, "npm", F.col("k"), F.col("v.version"), "exact", "npm-lock")


def bom_rows(files: DataFrame) -> DataFrame:
    """CycloneDX components that have a package URL of a known type."""
    parsed = files.select("app_id", "path", F.explode(F.from_json("text", "components array<struct<name:string,version:string,purl:string>>")["components"]).alias("c"))
    pattern = r"^pkg:(maven|npm|pypi|golang|pub|swift)/(.+?)@([^?]+)"
    rows = parsed.where(F.col("c.purl").rlike(pattern))
    kind = F.regexp_extract("c.purl", pattern, 1)
    # A literal plus sign is kept: only percent escapes are decoded.
    decode = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    name = decode(F.regexp_extract("c.purl", pattern, 2))
    ecosystem = F.lit(None).cast("string")
    for key, value in PURL_ECOSYSTEMS.items():
        ecosystem = F.when(kind == key, value).otherwise(ecosystem)
    name = F.when(kind == "maven", F.replace(name, F.lit("/"), F.lit(":"))).otherwise(name)
    return _rows(rows, ecosystem, name, decode(F.regexp_extract("c.purl", pattern, 3)), "exact", "sbom")


def dependency_rows(files: DataFrame) -> DataFrame:
    """Dependencies of every recognized build or lock file of a corpus, in one table."""
    name = base_name(F.col("path"))
    parts = [
        lockfile_rows(files.where((name == "gradle.lockfile") | F.col("path").rlike(r"(?:^|/)gradle/dependency-locks/[^/]+\.lockfile$")))[0],
        declared_rows(files.where(name.rlike(r"\.gradle(?:\.kts)?$"))),
        catalog_rows(files.where(name.endswith(".versions.toml"))),
        swift_pins(files.where(name == "Package.resolved")),
        pod_lock_rows(files.where(name == "Podfile.lock")),
        npm_lock_rows(files.where(name == "package-lock.json")),
        bom_rows(files.where(name.endswith(".cdx.json") | (name == "sbom.json"))),
    ]
    out = parts[0].select(*FIELDS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*FIELDS))
    return out
