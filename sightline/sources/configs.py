"""Decoded configuration from text: manifests, network configurations, property lists, device dumps."""

from __future__ import annotations

import json
import plistlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTIONS = {"attributePrefix": "_", "valueTag": "_VALUE", "columnNameOfCorruptRecord": "_malformed"}
_NAMED = "array<struct<`_android:name`:string>>"
_DATA = (
    "array<struct<`_android:scheme`:string,`_android:host`:string,`_android:port`:string,`_android:path`:string,`_android:pathPrefix`:string,"
    "`_android:pathPattern`:string>>"
)
_FILTER = f"array<struct<`_android:autoVerify`:string,action:{_NAMED},category:{_NAMED},data:{_DATA}>>"
_COMPONENT = (
    "array<struct<`_android:name`:string,`_android:exported`:string,`_android:permission`:string,`_android:readPermission`:string,"
    f"`_android:writePermission`:string,`_android:grantUriPermissions`:string,`intent-filter`:{_FILTER}>>"
)
# Component elements of a manifest.
COMPONENTS = ("activity", "activity-alias", "service", "receiver", "provider")
MANIFEST = (
    "_package string, `uses-sdk` struct<`_android:minSdkVersion`:string,`_android:targetSdkVersion`:string>, "
    f"`uses-permission` {_NAMED}, permission array<struct<`_android:name`:string,`_android:protectionLevel`:string>>, "
    "application struct<`_android:debuggable`:string,`_android:usesCleartextTraffic`:string,`_android:networkSecurityConfig`:string,"
    "`_android:allowBackup`:string," + ",".join(f"`{c}`:{_COMPONENT}" for c in COMPONENTS) + ">"
)


def _attr(value: Column, name: str, default: str = "") -> Column:
    return F.coalesce(value[f"_android:{name}"], F.lit(default))


def parsed_manifests(files: DataFrame) -> DataFrame:
    """(app_id, path, m) of text manifests; ``m`` is null where the XML is malformed."""
    return _well_formed(files, MANIFEST, "m")


def _well_formed(files: DataFrame, schema: str, name: str) -> DataFrame:
    """Parsed XML as one struct column; null where the text is malformed."""
    # generated, so that no filter on what was parsed is moved below it, where every mention would parse the text again
    whole = F.from_xml(F.trim("text"), f"{schema}, _malformed string", OPTIONS)
    parsed = files.select("app_id", "path", F.explode(F.array(whole)).alias(name))
    return parsed.withColumn(name, F.when(F.col(name)["_malformed"].isNull(), F.col(name)))


def malformed(parsed: DataFrame, name: str = "m") -> DataFrame:
    """Files whose XML could not be read."""
    return parsed.where(F.col(name).isNull()).select("app_id", "path")


def manifest_configs(manifests: DataFrame) -> DataFrame:
    """Application flags and SDK levels."""
    app, sdk = F.col("m.application"), F.col("m.uses-sdk")
    return manifests.where("m IS NOT NULL").select(
        "app_id", "path", F.coalesce("m._package", F.lit("")).alias("package"), _attr(app, "debuggable", "false").alias("debuggable"),
        _attr(app, "usesCleartextTraffic", "unspecified").alias("cleartext"), _attr(app, "networkSecurityConfig").alias("network_security_config"),
        _attr(app, "allowBackup", "unspecified").alias("allow_backup"), sdk["_android:minSdkVersion"].try_cast("int").alias("min_sdk"),
        sdk["_android:targetSdkVersion"].try_cast("int").alias("target_sdk"),
    )


def _names(values: Column) -> Column:
    return F.coalesce(F.transform(values, lambda v: v["_android:name"]), F.array().cast("array<string>"))


def manifest_components(manifests: DataFrame) -> DataFrame:
    """Declared components with their protection and intent filters."""
    typed = [
        F.transform(
            F.coalesce(F.col("m.application")[kind], F.array().cast(_COMPONENT)),
            _tagged(kind),
        )
        for kind in COMPONENTS
    ]
    rows = manifests.where("m.application IS NOT NULL").select("app_id", "path", F.explode(F.concat(*typed)).alias("c"))
    c = F.col("c.c")
    filters = F.coalesce(c["intent-filter"], F.array().cast(_FILTER))
    launcher = F.exists(
        filters,
        lambda f: F.array_contains(_names(f["action"]), "android.intent.action.MAIN")
        & F.array_contains(_names(f["category"]), "android.intent.category.LAUNCHER"),
    )
    return rows.select(
        "app_id", "path", _attr(c, "name").alias("name"), F.col("c.type").alias("type"), _attr(c, "exported", "unspecified").alias("exported"),
        _attr(c, "permission").alias("permission"), _attr(c, "readPermission").alias("read_permission"), _attr(c, "writePermission").alias("write_permission"),
        (F.size(filters) > 0).alias("has_filters"), launcher.alias("launcher"), F.flatten(F.transform(filters, lambda f: _names(f["action"]))).alias("actions"),
        (_attr(c, "grantUriPermissions") == "true").alias("grant_uri"), filters.alias("filters"),
    )


def _tagged(kind: str):
    return lambda c: F.struct(F.lit(kind).alias("type"), c.alias("c"))


def deep_links(components: DataFrame) -> DataFrame:
    """Scheme, authority and path combinations of VIEW filters; paths count only with a host."""
    rows = components.select("app_id", "path", "name", F.explode("filters").alias("f")).where(
        F.array_contains(_names(F.col("f.action")), "android.intent.action.VIEW")
    )
    data = F.coalesce("f.data", F.array().cast(_DATA))
    schemes = F.array_distinct(F.filter(F.transform(data, lambda d: _attr(d, "scheme")), lambda s: s != ""))
    authorities = F.array_distinct(
        F.filter(F.transform(data, lambda d: F.struct(_attr(d, "host").alias("host"), _attr(d, "port").alias("port"))), lambda a: a["host"] != "")
    )
    kinds = lambda d: F.array(*[F.struct(F.lit(k).alias("kind"), _attr(d, k).alias("path")) for k in ("path", "pathPrefix", "pathPattern")])
    paths = F.array_distinct(F.filter(F.flatten(F.transform(data, kinds)), lambda p: p["path"] != ""))
    none_a = F.array(F.struct(F.lit("").alias("host"), F.lit("").alias("port")))
    none_p = F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("path")))
    wide = rows.select(
        "app_id", F.col("path").alias("origin"), F.col("name").alias("component"), _attr(F.col("f"), "autoVerify", "false").alias("auto_verify"),
        F.array_contains(_names(F.col("f.category")), "android.intent.category.BROWSABLE").alias("browsable"), schemes.alias("schemes"),
        F.when(F.size(authorities) > 0, authorities).otherwise(none_a).alias("authorities"),
        F.when((F.size(authorities) > 0) & (F.size(paths) > 0), paths).otherwise(none_p).alias("paths"),
    )
    return (
        wide.withColumn("scheme", F.explode("schemes")).withColumn("a", F.explode("authorities")).withColumn("p", F.explode("paths"))
        .select("app_id", "origin", "component", "auto_verify", "browsable", "scheme", "a.host", "a.port", "p.path", F.col("p.kind").alias("path_kind"))
    )


def manifest_permissions(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requested, declared) permissions."""
    asked = manifests.select("app_id", F.explode("m.uses-permission").alias("p")).select("app_id", F.col("p")["_android:name"].alias("permission"))
    own = manifests.select("app_id", F.explode("m.permission").alias("p")).select(
        "app_id", F.col("p")["_android:name"].alias("name"), F.col("p")["_android:protectionLevel"].alias("protection_level")
    )
    return asked, own


NETWORK_SCHEMA = "app_id string, path string, base_anchors boolean, scope string, cleartext_permitted boolean, domains array<string>, user_ca boolean"


def _network_rows(app: str, path: str, text: str) -> list[tuple]:
    """Entries of one configuration, nested domain entries at any depth after the entry that holds them."""
    try:
        root = ElementTree.fromstring(text.lstrip("\ufeff \t\r\n"))
    except (ElementTree.ParseError, ValueError):
        return []
    anchored = any(base.find("trust-anchors") is not None for base in root.findall("base-config"))
    rows = []
    # A stack instead of recursion: nesting is bounded by the document alone.
    pending = [(node, None) for node in reversed([*root.findall("base-config")[:1], *root.findall("domain-config")])]
    while pending:
        node, inherited = pending.pop()
        effective = node.get("cleartextTrafficPermitted", inherited)
        named = node.tag == "domain-config"
        domains = [(d.text or "").strip(" ") for d in node.findall("domain")] if named else []
        user = any(c.get("src") == "user" for anchors in node.findall("trust-anchors")[:1] for c in anchors.findall("certificates"))
        rows.append((app, path, anchored, node.tag, effective == "true", domains, user))
        if named:
            pending += [(child, effective) for child in reversed(node.findall("domain-config"))]
    return rows


def network_configs(files: DataFrame) -> DataFrame:
    """Base and domain entries of text network configurations; nested entries inherit an undeclared cleartext value.

    Debug overrides never count. Nesting is read at any depth, so the tree is walked in Arrow batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in NETWORK_SCHEMA.split(", ")]
        for batch in batches:
            rows = [row for app, path, text in zip(batch["app_id"], batch["path"], batch["text"]) if text is not None for row in _network_rows(app, path, text)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("app_id", "path", "text").mapInPandas(run, NETWORK_SCHEMA)


@F.pandas_udf(T.StringType())
def _plist_json(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        out = []
        for text in texts:
            try:
                out.append(json.dumps(plistlib.loads(text.encode(), fmt=plistlib.FMT_XML), default=str))
            except Exception:  # noqa: BLE001 - a malformed property list becomes a null row, never a failed job
                out.append(None)
        yield pd.Series(out, dtype=object)


_EXCEPTION = (
    "struct<NSExceptionAllowsInsecureHTTPLoads:boolean,NSThirdPartyExceptionAllowsInsecureHTTPLoads:boolean,NSExceptionMinimumTLSVersion:string,"
    "NSThirdPartyExceptionMinimumTLSVersion:string,NSExceptionRequiresForwardSecrecy:boolean,NSThirdPartyExceptionRequiresForwardSecrecy:boolean>"
)
PLIST = (
    "CFBundleIdentifier string, MinimumOSVersion string, UIFileSharingEnabled boolean, NSAppTransportSecurity struct<NSAllowsArbitraryLoads:boolean,"
    "NSAllowsArbitraryLoadsInWebContent:boolean,NSAllowsArbitraryLoadsForMedia:boolean,NSAllowsLocalNetworking:boolean,"
    f"NSExceptionDomains:map<string,{_EXCEPTION}>>, CFBundleURLTypes array<struct<CFBundleURLSchemes:array<string>>>"
)


def property_lists(files: DataFrame) -> DataFrame:
    """(app_id, path, p) of text property lists; nested dictionaries go through JSON, malformed ones are null."""
    return files.select("app_id", "path", F.from_json(_plist_json(F.col("text")), PLIST).alias("p"))


def plist_configs(plists: DataFrame) -> DataFrame:
    ats = F.col("p.NSAppTransportSecurity")
    yes = lambda c: F.coalesce(c, F.lit(False))
    extra = [yes(ats[k]).cast("int") for k in ("NSAllowsArbitraryLoadsInWebContent", "NSAllowsArbitraryLoadsForMedia", "NSAllowsLocalNetworking")]
    return plists.where("p IS NOT NULL").select(
        "app_id", "path", F.coalesce("p.CFBundleIdentifier", F.lit("")).alias("bundle_id"), yes(ats["NSAllowsArbitraryLoads"]).alias("ats_arbitrary_loads"),
        yes(ats["NSAllowsArbitraryLoadsInWebContent"]).alias("ats_arbitrary_web"), yes(ats["NSAllowsArbitraryLoads"]).alias("arbitrary_loads"),
        (extra[0] + extra[1] + extra[2]).alias("override_keys"), yes(F.col("p.UIFileSharingEnabled")).alias("file_sharing"), F.col("p.MinimumOSVersion").alias("minimum_os"),
    )


def plist_domains(plists: DataFrame) -> DataFrame:
    """Transport exception domains, and one media row where media loads are allowed."""
    rows = plists.where("p IS NOT NULL").select("app_id", "path", F.explode("p.NSAppTransportSecurity.NSExceptionDomains").alias("domain", "s"))
    named = rows.select(
        "app_id", "path", "domain", F.col("s.NSExceptionAllowsInsecureHTTPLoads").alias("insecure"), F.col("s.NSThirdPartyExceptionAllowsInsecureHTTPLoads").alias("third_party_insecure"),
        F.col("s.NSExceptionMinimumTLSVersion").alias("min_tls"), F.col("s.NSThirdPartyExceptionMinimumTLSVersion").alias("third_party_tls"),
        F.col("s.NSExceptionRequiresForwardSecrecy").alias("forward_secrecy"), F.col("s.NSThirdPartyExceptionRequiresForwardSecrecy").alias("third_party_secrecy"),
        F.lit(None).cast("boolean").alias("media"),
    )
    media = plists.where("p.NSAppTransportSecurity.NSAllowsArbitraryLoadsForMedia").select(
        "app_id", "path", F.lit("(media)").alias("domain"), F.lit(True).alias("media")
    )
    return named.unionByName(media, allowMissingColumns=True)


def plist_schemes(plists: DataFrame) -> DataFrame:
    rows = plists.select("app_id", F.explode("p.CFBundleURLTypes").alias("u"))
    return rows.select("app_id", F.explode("u.CFBundleURLSchemes").alias("scheme"))


PROPERTY_LINE = r"(?m)^\[([^\]]+)\]:\s*\[(.*)\]$"


def device_properties(dumps: DataFrame) -> DataFrame:
    """Property maps of ``[key]: [value]`` dumps (device_id, text); the last of repeated keys wins."""
    pairs = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(PROPERTY_LINE), F.lit(1)).alias("k"), F.regexp_extract_all("text", F.lit(PROPERTY_LINE), F.lit(2)).alias("v")
    )
    rows = dumps.select("device_id", F.posexplode(pairs).alias("i", "p"))
    last = rows.groupBy("device_id", F.col("p.k").alias("k")).agg(F.max_by(F.col("p.v"), F.col("i")).alias("v"))
    maps = last.groupBy("device_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("props"))  # keys of one dump
    return dumps.select("device_id").join(maps, "device_id", "left").select(
        "device_id", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props")
    )


def package_dumps(dumps: DataFrame) -> DataFrame:
    """Target level, debuggable flag and installer of package dumps (device_id, name, text)."""
    target = F.regexp_extract("text", r"targetSdk(?:Version)?=(\d{1,9})", 1).try_cast("int")
    flags = F.regexp_extract_all("text", F.lit(r"[Ff]lags=\[[^\]]*\]"), F.lit(0))
    installer = F.regexp_extract("text", r"installerPackageName=(\S+)", 1)
    return dumps.select(
        "device_id", "name", target.alias("target_sdk"), F.exists(flags, lambda f: f.contains("DEBUGGABLE")).alias("debuggable"),
        F.when(~installer.isin("", "null"), installer).alias("installer"), (installer != "").alias("installer_present"), F.lit(True).alias("readable"),
    )
