"""Path, module and location columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_suffix(path: Column) -> Column:
    """Text from the last dot on, or empty."""
    return F.regexp_extract(path, r"(\.[^.]*)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    """Directory of a relative path; ``.`` at the top."""
    directory = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(directory == "", ".").otherwise(directory)


def source_module(path: Column) -> Column:
    """Scheduling group inferred from a source layout path."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    marked = F.filter(
        F.transform(dirs, lambda x, i: F.struct(x.alias("p"), i.alias("i"))),
        lambda s: (s["p"] == "src") | (s["p"].isin("Sources", "Tests") & (s["i"] + 1 < F.size(dirs))),
    )
    first = F.get(marked, F.lit(0))
    upto = F.when(first["p"] == "src", first["i"]).otherwise(first["i"] + 2)
    head = F.get(dirs, F.lit(0))
    # A two-level layout counts only when a second directory exists below the container directory.
    wide = head.isin("android", "ios", "modules", "packages") & (F.size(dirs) >= 1)
    width = F.when(wide, F.lit(2)).otherwise(F.lit(1))
    length = F.when(first.isNotNull(), upto).otherwise(width)
    joined = F.array_join(F.slice(dirs, F.lit(1), F.greatest(length, F.lit(0)).cast("int")), "/")
    return F.when(joined == "", ".").otherwise(joined)


def relative_path(path: Column) -> Column:
    """Normalized relative POSIX path; null when absolute or leaving its root."""
    text = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(text, "/"), lambda p: ~p.isin("", "."))
    bad = (
        text.startswith("/")
        | text.rlike(r"^[A-Za-z]:")
        | text.contains("://")
        | F.array_contains(parts, "..")
        | (F.size(parts) == 0)
    )
    return F.when(~bad, F.array_join(parts, "/"))


def uri_path(path: Column) -> Column:
    """Percent-encoded path with its slashes kept."""
    return F.array_join(F.transform(F.split(path, "/"), lambda part: quote(part)), "/")


def quote(text: Column, safe: str = "") -> Column:
    """Percent-encoding with the unreserved characters and ``safe`` left as they are."""
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    encoded = F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    for char in safe:
        encoded = F.replace(encoded, F.lit(f"%{ord(char):02X}"), F.lit(char))
    return encoded


def same_or_suffix(observed: Column, expected: Column) -> Column:
    """Equal paths, or an observed path that ends with the expected one."""
    return (observed == expected) | F.endswith(observed, F.concat(F.lit("/"), expected))


def path_agrees(left: Column, right: Column) -> Column:
    """Either path equals the other or ends with it at a directory boundary."""
    return same_or_suffix(left, right) | same_or_suffix(right, left)


def module_root(manifest: Column) -> Column:
    """Module directory (with its slash) that a manifest belongs to."""
    flat = F.regexp_extract(manifest, r"^((?:[^/]+/)?)manifest/AndroidManifest\.xml$", 1)
    is_flat = manifest.rlike(r"^(?:[^/]+/)?manifest/AndroidManifest\.xml$")
    before = F.regexp_extract(F.concat(F.lit("/"), manifest), r"^(.*?)/src/", 1)
    in_src = F.concat(F.lit("/"), manifest).contains("/src/")
    trimmed = F.regexp_replace(before, "^/+", "")
    src_root = F.when(manifest.startswith("src/"), trimmed).otherwise(F.concat(trimmed, F.lit("/")))
    folder = F.regexp_extract(manifest, r"^(.*/)[^/]*$", 1)
    return F.when(is_flat, flat).when(in_src, src_root).otherwise(folder)


def project_key(parts: Column) -> Column:
    """Build-project key: non-empty parts, case and separators normalized."""
    cleaned = F.transform(F.filter(parts, lambda p: p != ""), alias_key)
    return F.array_join(cleaned, ":")


def alias_key(alias: Column) -> Column:
    """Catalogue alias and its accessor compare equal: separators dropped, lower case."""
    return F.lower(F.regexp_replace(alias, r"[-_.]", ""))


def safe_location(locations: Column, root: str = "") -> Column:
    """First location whose URI is relative and inside the target; null fields when there is none."""

    def usable(row: Column) -> Column:
        uri = F.coalesce(row["uri"], F.lit(""))
        return (
            (uri != "")
            & ~uri.contains("://")
            & ~uri.startswith("/")
            & ~F.array_contains(F.split(uri, "/"), "..")
        )

    chosen = F.get(F.filter(locations, usable), F.lit(0))
    uri = chosen["uri"]
    if root:
        uri = F.when(uri.startswith(root + "/"), F.substr(uri, F.lit(len(root) + 2))).otherwise(uri)
    line = F.when(chosen["line"] > 0, chosen["line"])
    return F.struct(uri.alias("path"), line.alias("line"))
