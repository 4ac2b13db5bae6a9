"""Package coordinates and advisory identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.paths import quote

# Ecosystem name to package-URL type.
PURL_TYPES = {
    "Maven": "maven",
    "npm": "npm",
    "PyPI": "pypi",
    "Go": "golang",
    "Pub": "pub",
    "CocoaPods": "cocoapods",
}
CVE_ID = r"^CVE-\d{4}-\d{4,}$"
# Fixed value: the public record repository.
CVE_RECORDS = "https://raw.githubusercontent.com/CVEProject/cvelistV5/main/cves/"
MAX_ADVISORY_ID_LENGTH = 200


def package_url(ecosystem: Column, name: Column, version: Column) -> Column:
    """Package URL; null when the ecosystem or version cannot name one."""
    suffix = F.concat(F.lit("@"), quote(version))
    head = lambda sep: F.split_part(name, F.lit(sep), F.lit(1))
    tail = lambda sep: F.substr(name, F.instr(name, sep) + 1)
    maven = F.concat(F.lit("pkg:maven/"), quote(head(":"), "."), F.lit("/"), quote(tail(":"), "."), suffix)
    scoped = F.concat(F.lit("pkg:npm/"), quote(head("/")), F.lit("/"), quote(tail("/"), "."), suffix)
    location = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^https?://", ""), r"\.git$", ""), "^/+|/+$", "")
    swift_ok = F.size(F.split(location, "/")) >= 3
    swift = F.concat(
        F.lit("pkg:swift/"),
        quote(F.regexp_extract(location, r"^(.*)/[^/]*$", 1), "./"),
        F.lit("/"),
        quote(F.regexp_extract(location, r"([^/]*)$", 1), "."),
        suffix,
    )
    segments = lambda c: F.array_join(
        F.transform(F.filter(F.split(c, "/"), lambda p: p != ""), lambda p: quote(p, ".")), "/"
    )
    golang = F.concat(F.lit("pkg:golang/"), segments(name), suffix)
    subpath = segments(tail("/"))
    pod = F.concat(
        F.lit("pkg:cocoapods/"), quote(head("/"), "."), suffix,
        F.when(subpath != "", F.concat(F.lit("#"), subpath)).otherwise(F.lit("")),
    )
    kind = F.lit(None).cast("string")
    for eco, value in PURL_TYPES.items():
        kind = F.when(ecosystem == eco, value).otherwise(kind)
    plain = F.concat(F.lit("pkg:"), kind, F.lit("/"), quote(name, "."), suffix)
    return F.when(
        version != "",
        F.when((ecosystem == "Maven") & name.contains(":"), maven)
        .when((ecosystem == "npm") & name.startswith("@") & name.contains("/"), scoped)
        .when(ecosystem == "SwiftURL", F.when(swift_ok, swift))
        .when((ecosystem == "Go") & name.contains("/"), golang)
        .when((ecosystem == "CocoaPods") & name.contains("/"), pod)
        .otherwise(plain),
    )


def advisory_package_name(ecosystem: Column, name: Column) -> Column:
    """Name used for advisory lookups; Swift repositories are canonicalized, unsupported ones are null."""
    url = F.when(name.contains("://"), name).otherwise(F.concat(F.lit("https://"), name))
    pattern = r"^https://([A-Za-z0-9.-]+)(/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+?)(?:\.git)?/*$"
    host, path = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    bad = ~url.rlike(pattern) | path.rlike(r"/\.{1,2}(?:/|$)")
    return F.when(ecosystem != "SwiftURL", name).when(~bad, F.concat(F.lower(host), path))


def is_cve(identifier: Column) -> Column:
    return identifier.rlike(CVE_ID)


def cve_url(identifier: Column) -> Column:
    """Address of the public record; null for anything that is not a CVE id."""
    year, number = F.split_part(identifier, F.lit("-"), F.lit(2)), F.split_part(identifier, F.lit("-"), F.lit(3))
    bucket = F.substr(number, F.lit(1), F.length(number) - 3)
    return F.when(
        is_cve(identifier),
        F.concat(F.lit(CVE_RECORDS), year, F.lit("/"), bucket, F.lit("xxx/"), identifier, F.lit(".json")),
    )


def valid_advisory_id(value: Column) -> Column:
    return value.isNotNull() & (value != "") & (F.length(value) <= MAX_ADVISORY_ID_LENGTH) & ~value.rlike(r"\s")


def bounded_advisory_ids(display: Column, identifiers: Column, cap: int | None = None) -> Column:
    """Sorted valid ids, all unless a ``cap`` is asked for; the display id always keeps its place under the cap."""
    valid = F.array_sort(F.array_distinct(F.filter(identifiers, valid_advisory_id)))
    others = F.array_remove(valid, display)
    own = F.when(valid_advisory_id(display), F.array(display)).otherwise(F.array().cast("array<string>"))
    both = F.concat(own, others)
    return F.array_sort(both if cap is None else F.slice(both, 1, cap))


def display_id(upstream: Column, aliases: Column) -> Column:
    """Least CVE alias, else the upstream id."""
    return F.coalesce(F.array_min(F.filter(aliases, is_cve)), upstream)
