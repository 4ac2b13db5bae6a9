"""Configuration and fleet posture: predicates over decoded manifests, property lists, network configurations and devices."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import ranks
from sightline.functions.canonical import path_identity
from sightline.functions.paths import module_root
from sightline.functions.versions import months_between_days
from sightline.operators.code_checks import NON_RELEASE_SOURCE_SET
from sightline.scale import top_k

# Store requirement, component kinds, hosts, tiers and permission names.
STORE_TARGET_SDK = 36
COMPONENT_TYPES = ("activity", "activity-alias", "service", "receiver", "provider")
LOOPBACK = ("localhost", "127.0.0.1", "::1", "[::1]", "ip6-localhost")
LINT_TIERS = (23, 29, 30)
PATCH_FAIL_MONTHS, PATCH_WARN_MONTHS, MIN_RELEASE, MIN_IOS_MAJOR = 12, 6, 13, 15
DANGEROUS_PERMISSIONS = (
    "CAMERA",
    "RECORD_AUDIO",
    "ACCESS_FINE_LOCATION",
    "ACCESS_COARSE_LOCATION",
    "ACCESS_BACKGROUND_LOCATION",
    "READ_CONTACTS",
    "WRITE_CONTACTS",
    "READ_CALENDAR",
    "WRITE_CALENDAR",
    "READ_SMS",
    "SEND_SMS",
    "RECEIVE_SMS",
    "RECEIVE_MMS",
    "RECEIVE_WAP_PUSH",
    "READ_PHONE_STATE",
    "READ_PHONE_NUMBERS",
    "CALL_PHONE",
    "READ_CALL_LOG",
    "WRITE_CALL_LOG",
    "BODY_SENSORS",
    "BODY_SENSORS_BACKGROUND",
    "READ_EXTERNAL_STORAGE",
    "WRITE_EXTERNAL_STORAGE",
    "MANAGE_EXTERNAL_STORAGE",
    "SYSTEM_ALERT_WINDOW",
    "QUERY_ALL_PACKAGES",
    "REQUEST_INSTALL_PACKAGES",
    "ACCESS_MEDIA_LOCATION",
    "ACTIVITY_RECOGNITION",
    "POST_NOTIFICATIONS",
    "BLUETOOTH_SCAN",
    "BLUETOOTH_CONNECT",
    "BLUETOOTH_ADVERTISE",
    "READ_MEDIA_IMAGES",
    "READ_MEDIA_VIDEO",
    "READ_MEDIA_AUDIO",
    "GET_ACCOUNTS",
    "USE_BIOMETRIC",
)
PROTECTED_BROADCASTS = (
    "BOOT_COMPLETED",
    "LOCKED_BOOT_COMPLETED",
    "PACKAGE_ADDED",
    "PACKAGE_REMOVED",
    "PACKAGE_REPLACED",
    "PACKAGE_CHANGED",
    "PACKAGE_FULLY_REMOVED",
    "PACKAGE_RESTARTED",
    "PACKAGE_DATA_CLEARED",
    "PACKAGE_FIRST_LAUNCH",
    "TIME_TICK",
    "TIME_SET",
    "TIMEZONE_CHANGED",
    "LOCALE_CHANGED",
    "SCREEN_ON",
    "SCREEN_OFF",
    "BATTERY_CHANGED",
    "BATTERY_LOW",
    "BATTERY_OKAY",
    "CONFIGURATION_CHANGED",
    "UID_REMOVED",
    "USER_PRESENT",
    "INPUT_METHOD_CHANGED",
)


def blank(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def manifest_flags(configs: DataFrame) -> DataFrame:
    """Debuggable builds and explicit cleartext; cleartext is only a candidate beside a network configuration."""
    rows = F.array_compact(
        F.array(
            F.when(F.col("debuggable") == "true", _flag("ANDROID-DEBUG", F.lit("configuration-confirmed"))),
            F.when(
                F.col("cleartext") == "true",
                _flag(
                    "ANDROID-CLEARTEXT",
                    F.when(blank(F.col("network_security_config")), "configuration-confirmed").otherwise("candidate"),
                ),
            ),
        )
    )
    return configs.select("app_id", "path", F.explode(rows).alias("f")).select(
        "app_id", "path", "f.rule_id", F.lit("medium").alias("severity"), "f.status",
        path_identity(F.col("f.rule_id"), F.col("path")).alias("id"),
    )


def _flag(rule: str, status: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), status.alias("status"))


def broad_transport_exceptions(configs: DataFrame) -> DataFrame:
    """Property lists that allow arbitrary loads (also in web content)."""
    wide = F.coalesce("ats_arbitrary_loads", F.lit(False)) | F.coalesce("ats_arbitrary_web", F.lit(False))
    return configs.where(wide).select(
        "app_id", "path", F.lit("IOS-ATS").alias("rule_id"), F.lit("medium").alias("severity"), F.lit("configuration-confirmed").alias("status")
    )


def default_exported(kind: Column, has_filters: Column, target: Column) -> Column:
    """Whether the platform exports a component that does not say so; an unknown target counts."""
    return (has_filters & (target.isNull() | (target < 31))) | ((kind == "provider") & (target.isNull() | (target < 17)))


def exposed(components: DataFrame, targets: DataFrame) -> DataFrame:
    """Exported components without a permission, launchers excluded, implicit export by target level included."""
    rows = components.join(targets.select("app_id", "target_sdk"), "app_id", "left")
    unspecified = F.col("exported") == "unspecified"
    implicit = unspecified & default_exported(F.col("type"), F.col("has_filters"), F.col("target_sdk"))
    guarded = ~blank(F.col("permission")) | (~blank(F.col("read_permission")) & ~blank(F.col("write_permission")))
    open_ = ((F.col("exported") == "true") | implicit) & ~guarded & ~F.coalesce("launcher", F.lit(False))
    return rows.where(open_ & F.col("type").isin(*COMPONENT_TYPES)).select(
        "app_id", "path", F.col("name").alias("component"), "type", unspecified.alias("implicit"),
        F.when(F.col("type").isin("activity", "activity-alias"), "low").otherwise("medium").alias("severity"),
        F.lit("ANDROID-EXPORTED-COMPONENT").alias("rule_id"), F.lit("candidate").alias("status"),
    )


def allowed_backups(configs: DataFrame) -> DataFrame:
    return configs.where(F.col("allow_backup") == "true").select(
        "app_id", "path", F.lit("ANDROID-ALLOW-BACKUP").alias("rule_id"), F.lit("low").alias("severity"), F.lit("configuration-confirmed").alias("status")
    )


def target_levels(declared: DataFrame, literals: DataFrame) -> DataFrame:
    """Target level per app: the manifest's, else the least literal of its build scripts."""
    low = literals.groupBy("app_id").agg(F.min("level").alias("least"))
    return declared.select("app_id", "target_sdk").join(low, "app_id", "full_outer").select(
        "app_id", F.coalesce("target_sdk", "least").alias("target_sdk")
    )


def outdated_targets(declared: DataFrame, literals: DataFrame, required: int = STORE_TARGET_SDK) -> DataFrame:
    """Every declared or literal target level below the store requirement."""
    rows = declared.where("target_sdk IS NOT NULL").select("app_id", "path", F.lit(0).alias("line"), F.col("target_sdk").alias("level")).unionByName(
        literals.select("app_id", "path", "line", "level")
    ).distinct()
    return rows.where(F.col("level") < required).select(
        "app_id", "path", "line", "level", ranks.target_sdk_severity(F.col("level")).alias("severity"),
        F.lit("ANDROID-TARGET-SDK").alias("rule_id"), F.lit("configuration-confirmed").alias("status"),
    )


def transport_exceptions(domains: DataFrame) -> DataFrame:
    """One finding per property list, with the number of weakened domains and their reasons as rows beside it.

    ``domains``: app_id, path, domain, insecure, third_party_insecure, min_tls, third_party_tls, forward_secrecy,
    third_party_secrecy, media. Reasons stay rows, so a file with very many domains is never collected.
    """
    weak_tls = lambda c: F.coalesce(F.col(c).isin("TLSv1.0", "TLSv1.1"), F.lit(False))
    off = lambda c: F.coalesce(~F.col(c), F.lit(False))
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(on("media"), "NSAllowsArbitraryLoadsForMedia allows unencrypted media loads"),
            F.when(on("insecure"), "NSExceptionAllowsInsecureHTTPLoads permits HTTP"),
            F.when(weak_tls("min_tls"), F.concat(F.lit("NSExceptionMinimumTLSVersion "), "min_tls")),
            F.when(off("forward_secrecy"), "NSExceptionRequiresForwardSecrecy disabled"),
            F.when(on("third_party_insecure"), "NSThirdPartyExceptionAllowsInsecureHTTPLoads permits HTTP"),
            F.when(weak_tls("third_party_tls"), F.concat(F.lit("NSThirdPartyExceptionMinimumTLSVersion "), "third_party_tls")),
            F.when(off("third_party_secrecy"), "NSThirdPartyExceptionRequiresForwardSecrecy disabled"),
        )
    )
    return domains.select("app_id", "path", "domain", reasons.alias("reasons")).where(F.size("reasons") > 0)


def transport_exception_findings(domains: DataFrame) -> DataFrame:
    weakened = transport_exceptions(domains)
    return weakened.groupBy("app_id", "path").agg(F.count_distinct("domain").alias("domains")).select(
        "app_id", "path", "domains", F.lit("IOS-ATS-EXCEPTION").alias("rule_id"), F.lit("medium").alias("severity"),
        path_identity(F.lit("IOS-ATS-EXCEPTION"), F.col("path")).alias("id"),
    )


def network_references(configs: DataFrame) -> DataFrame:
    """Manifests that name a network configuration resource, with the module and resource name it resolves in."""
    value = F.col("network_security_config")
    return configs.where(~blank(value) & value.startswith("@xml/")).select(
        "app_id", F.col("path").alias("manifest"), module_root(F.col("path")).alias("module"),
        F.regexp_extract(value, r"([^/]*)$", 1).alias("resource"),
    )


def network_matches(references: DataFrame, files_table: DataFrame) -> DataFrame:
    """References joined to their module's configuration files, with the number of source-set variants.

    ``files_table``: app_id, path plus whatever was parsed from the file. The join key (module, resource) is taken
    from the file path, so no prefix matching over all pairs is needed.
    """
    pattern = r"^(.*?)(?:src/[^/]+/)?res/xml/([^/]+)\.xml$"
    files_table = files_table.where(F.col("path").rlike(r"(?:^|/)res/xml/") & ~F.col("path").rlike(NON_RELEASE_SOURCE_SET))
    keyed = files_table.withColumn("module", F.regexp_extract("path", pattern, 1)).withColumn("resource", F.regexp_extract("path", pattern, 2))
    joined = keyed.join(references, ["app_id", "module", "resource"])
    variants = joined.groupBy("app_id", "module", "resource").agg(F.count_distinct("path").alias("variants"))
    return joined.join(variants, ["app_id", "module", "resource"])


def user_trust(matches: DataFrame, configs: DataFrame, targets: DataFrame) -> DataFrame:
    """User certificate authorities trusted by a configuration, or by platform default up to target 23.

    ``matches``: network_matches of files with ``user_ca`` (line, scope) and ``base_anchors``.
    """
    status = F.when(F.col("variants") == 1, "configuration-confirmed").otherwise("candidate")
    stated = matches.where("user_ca").select("app_id", "path", F.col("scope").alias("scope"), status.alias("status")).distinct()
    silent = matches.where("NOT base_anchors").groupBy("app_id", "manifest").agg(F.min("path").alias("config_path"))
    old = configs.join(targets.where("target_sdk <= 23").select("app_id"), "app_id", "left_semi")
    default = (
        old.select("app_id", F.col("path").alias("manifest"), "network_security_config").join(silent, ["app_id", "manifest"], "left")
        .where(blank(F.col("network_security_config")) | F.col("config_path").isNotNull())
        .select("app_id", F.coalesce("config_path", "manifest").alias("path"), F.lit("platform-default").alias("scope"), F.lit("candidate").alias("status"))
    )
    return stated.unionByName(default).withColumn("rule_id", F.lit("ANDROID-NSC-USER-CA")).withColumn("severity", F.lit("medium"))


def config_cleartext(matches: DataFrame) -> DataFrame:
    """Cleartext permitted by a configuration; domain entries for loopback hosts only are left out."""
    local = (
        (F.col("scope") == "domain-config") & (F.size("domains") > 0)
        & F.forall("domains", lambda d: F.lower(d).isin(*LOOPBACK))
    )
    return matches.where(F.col("cleartext_permitted") & ~local).select(
        "app_id", "path", "scope", F.lit("ANDROID-CLEARTEXT").alias("rule_id"),
        F.when(F.col("scope") == "base-config", "medium").otherwise("low").alias("severity"),
        F.when(F.col("variants") == 1, "configuration-confirmed").otherwise("candidate").alias("status"),
    ).distinct()


def unverified_links(links: DataFrame, samples: int) -> DataFrame:
    """Web links without verification per (app, origin, component): exact host count and the first hosts."""
    open_ = links.where(
        F.col("scheme").isin("http", "https") & ~blank(F.col("host")) & F.col("browsable") & (F.coalesce("auto_verify", F.lit("")) != "true")
    )
    hosts = open_.select("app_id", "origin", "component", "host").distinct()
    keys = ["app_id", "origin", "component"]
    counts = hosts.groupBy(*keys).agg(F.count(F.lit(1)).alias("hosts"))
    first = top_k(hosts, keys, [F.col("host")], samples, "__n").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("host")), ",").alias("sample"))
    return counts.join(first, keys).withColumn("rule_id", F.lit("ANDROID-DEEPLINK-AUTOVERIFY"))


# --- lint checks: one row per subject and check ------------------------------------------------


def _check(keys: Sequence[str], check: str, status: Column, severity: Column, count: Column) -> list[Column]:
    return [*[F.col(k) for k in keys], F.lit(check).alias("check_id"), status.alias("status"), severity.alias("severity"), count.alias("items")]


def _tally(rows: DataFrame, condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def link_lint(components: DataFrame, filters: DataFrame) -> DataFrame:
    """Deep-link surface per app: custom schemes warn, unverified web links warn lower.

    ``filters``: app_id, component, browsable, schemes ARRAY, auto_verify.
    """
    browsable = filters.where("browsable")
    custom = (F.size("schemes") == 0) | F.exists("schemes", lambda s: ~s.isin("http", "https"))
    per = browsable.groupBy("app_id").agg(
        _tally(browsable, custom).alias("custom"), _tally(browsable, F.coalesce("auto_verify", F.lit("")) != "true").alias("unverified")
    )
    rows = components.select("app_id").distinct().join(per, "app_id", "left").fillna(0)
    warn = (F.col("custom") > 0) | (F.col("unverified") > 0)
    return rows.select(
        *_check(
            ["app_id"], "app-deeplink", F.when(warn, "warn").otherwise("pass"),
            F.when(F.col("custom") > 0, "MEDIUM").when(F.col("unverified") > 0, "LOW").otherwise(""),
            F.when(F.col("custom") > 0, F.col("custom")).otherwise(F.col("unverified")),
        )
    )


def provider_lint(components: DataFrame, targets: DataFrame, path_permissions: DataFrame) -> DataFrame:
    """Exported providers: URI grants, ineffective path permissions, and providers guarded by paths only.

    ``components`` also holds grant_uri (boolean); ``path_permissions``: app_id, component, guarded.
    """
    rows = components.where("type = 'provider'").join(targets.select("app_id", "target_sdk"), "app_id", "left")
    out = rows.where(
        (F.col("exported") == "true") | ((F.col("exported") == "unspecified") & default_exported(F.col("type"), F.col("has_filters"), F.col("target_sdk")))
    )
    paths = path_permissions.groupBy("app_id", F.col("component").alias("name")).agg(
        _tally(path_permissions, ~F.col("guarded")).alias("ineffective"), F.bool_or("guarded").alias("by_path")
    )
    open_ = blank(F.col("permission")) & blank(F.col("read_permission")) & blank(F.col("write_permission"))
    per = out.join(paths, ["app_id", "name"], "left").groupBy("app_id").agg(
        _tally(out, F.coalesce("grant_uri", F.lit(False))).alias("grants"), F.sum(F.coalesce("ineffective", F.lit(0))).cast("bigint").alias("ineffective"),
        _tally(out, open_ & F.coalesce("by_path", F.lit(False))).alias("partial"),
    )
    every = components.select("app_id").distinct().join(per, "app_id", "left").fillna(0)
    grants = every.select(
        *_check(["app_id"], "app-provider-grant", F.when(F.col("grants") > 0, "warn").otherwise("pass"), F.when(F.col("grants") > 0, "MEDIUM").otherwise(""), F.col("grants"))
    )
    n = F.when(F.col("ineffective") > 0, F.col("ineffective")).otherwise(F.col("partial"))
    by_path = every.select(*_check(["app_id"], "app-provider-paths", F.when(n > 0, "info").otherwise("pass"), F.when(n > 0, "INFO").otherwise(""), n))
    return grants.unionByName(by_path)


def permission_lint(permissions: DataFrame) -> DataFrame:
    """Dangerous permissions requested per app."""
    dangerous = F.col("permission").isin(*[f"android.permission.{p}" for p in DANGEROUS_PERMISSIONS])
    per = permissions.groupBy("app_id").agg(F.count_distinct(F.when(dangerous, F.col("permission"))).alias("n"))
    return per.select(*_check(["app_id"], "app-permissions-dangerous", F.when(F.col("n") > 0, "info").otherwise("pass"), F.when(F.col("n") > 0, "INFO").otherwise(""), F.col("n")))


def protection_rank(level: Column) -> Column:
    """0 normal, 1 dangerous, 2 signature, 3 signatureOrSystem; numbers count by their low bits, unknown is normal."""
    text = F.trim(F.coalesce(level, F.lit("")))
    number = F.when(text.rlike(r"^\d{1,9}$"), text.try_cast("int").bitwiseAND(F.lit(15)))
    named = F.when(text == "dangerous", 1).when(text == "signature", 2).when(text == "signatureOrSystem", 3).otherwise(0)
    return F.coalesce(number, named)


def custom_permission_lint(declared: DataFrame) -> DataFrame:
    loose = protection_rank(F.col("protection_level")).isin(0, 1)
    per = declared.groupBy("app_id").agg(_tally(declared, loose).alias("n"))
    return per.select(*_check(["app_id"], "app-custom-permissions", F.when(F.col("n") > 0, "info").otherwise("pass"), F.when(F.col("n") > 0, "INFO").otherwise(""), F.col("n")))


def exported_lint(components: DataFrame, targets: DataFrame) -> DataFrame:
    """Open components per app; launchers and receivers of protected system broadcasts only are normal.

    ``components`` also holds actions ARRAY. exported: true, false, unspecified, or anything else (unresolved).
    """
    rows = components.join(targets.select("app_id", "target_sdk"), "app_id", "left")
    protected = [f"android.intent.action.{a}" for a in PROTECTED_BROADCASTS]
    actions = F.coalesce("actions", F.array().cast("array<string>"))
    normal = F.coalesce("launcher", F.lit(False)) | (
        (F.col("type") == "receiver") & (F.size(actions) > 0) & F.forall(actions, lambda a: a.isin(*protected))
    )
    guarded = ~blank(F.col("permission")) | (
        (F.col("type") == "provider") & ~blank(F.col("read_permission")) & ~blank(F.col("write_permission"))
    )
    unspecified = F.col("exported") == "unspecified"
    by_default = unspecified & default_exported(F.col("type"), F.col("has_filters"), F.col("target_sdk"))
    unresolved = ~F.col("exported").isin("true", "false", "unspecified")
    open_ = ((F.col("exported") == "true") | by_default) & ~guarded
    reach = (unspecified & F.col("has_filters") & ~by_default & ~guarded & ~normal) | unresolved
    per = rows.groupBy("app_id").agg(_tally(rows, open_ & ~normal).alias("open"), _tally(rows, reach).alias("reach"))
    return per.select(
        *_check(
            ["app_id"], "app-exported", F.when(F.col("open") > 0, "warn").when(F.col("reach") > 0, "info").otherwise("pass"),
            F.when(F.col("open") > 0, "MEDIUM").when(F.col("reach") > 0, "INFO").otherwise(""),
            F.when(F.col("open") > 0, F.col("open")).otherwise(F.col("reach")),
        )
    )


def lint_target_tier(level: Column) -> Column:
    """Struct (status, severity) of a target level."""
    fail, warn, low = LINT_TIERS
    status = F.when(level.isNull(), "na").when(level < fail, "fail").when(level < low, "warn").otherwise("pass")
    severity = F.when(level < fail, "HIGH").when(level < warn, "MEDIUM").when(level < low, "LOW").otherwise("")
    return F.struct(status.alias("status"), F.coalesce(severity, F.lit("")).alias("severity"))


def target_lint(targets: DataFrame) -> DataFrame:
    tier = lint_target_tier(F.col("target_sdk"))
    return targets.select(*_check(["app_id"], "app-target-sdk", tier["status"], tier["severity"], F.lit(1).cast("bigint")))


def plist_lint(plists: DataFrame, domains: DataFrame, schemes: DataFrame) -> DataFrame:
    """Property-list checks per app: transport policy, domain exceptions, file sharing, URL schemes, minimum OS.

    ``plists``: app_id, arbitrary_loads, override_keys (count), file_sharing, minimum_os; ``domains`` as in
    transport_exceptions; ``schemes``: app_id, scheme (null marks a malformed declaration).
    """
    major = F.regexp_extract(F.coalesce("minimum_os", F.lit("")), r"^(\d+)(?:\.|$)", 1).try_cast("int")
    weak = transport_exceptions(domains).groupBy("app_id").agg(F.count_distinct("domain").alias("weak"))
    named = schemes.groupBy("app_id").agg(
        F.count_distinct("scheme").alias("named"), F.bool_or(F.col("scheme").isNull()).alias("malformed")
    )
    rows = plists.withColumn("major", major).join(weak, "app_id", "left").join(named, "app_id", "left")
    one = F.lit(1).cast("bigint")
    wide = F.coalesce("arbitrary_loads", F.lit(False))
    narrowed = wide & (F.col("major") >= 10) & (F.col("override_keys") > 0)
    weak_n, named_n = F.coalesce("weak", F.lit(0)), F.coalesce("named", F.lit(0))
    sharing = F.coalesce("file_sharing", F.lit(False))
    item = lambda check, status, severity, n: F.struct(
        F.lit(check).alias("check_id"), status.alias("status"), severity.alias("severity"), n.cast("bigint").alias("items")
    )
    checks = F.array(
        item("ipa-ats", F.when(wide, "warn").otherwise("pass"), F.when(F.coalesce(narrowed, F.lit(False)), "LOW").when(wide, "MEDIUM").otherwise(""), one),
        item("ipa-ats-domains", F.when(weak_n > 0, "warn").otherwise("pass"), F.when(weak_n > 0, "LOW").otherwise(""), weak_n),
        item("ipa-file-sharing", F.when(sharing, "info").otherwise("pass"), F.when(sharing, "INFO").otherwise(""), one),
        item(
            "ipa-url-schemes",
            F.when(named_n > 0, "info").when(F.coalesce("malformed", F.lit(False)), "na").otherwise("pass"),
            F.when(named_n > 0, "INFO").otherwise(""), named_n,
        ),
        item(
            "ipa-min-os", F.when(F.col("major").isNull(), "na").when(F.col("major") < MIN_IOS_MAJOR, "warn").otherwise("pass"),
            F.when(F.col("major") < MIN_IOS_MAJOR, "MEDIUM").otherwise(""), one,
        ),
    )
    return rows.select("app_id", F.explode(checks).alias("c")).select("app_id", "c.*")


# --- devices -------------------------------------------------------------------------------------


def patch_age(devices: DataFrame, today: dt.date) -> DataFrame:
    """Months since the security patch: over 12 fails, over 6 warns, the future says nothing."""
    raw = F.col("security_patch")
    day = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw.try_cast("date"))
    months = months_between_days(day, F.lit(today))
    status = (
        F.when(day.isNull(), "warn").when(months < 0, "na").when(months > PATCH_FAIL_MONTHS, "fail")
        .when(months > PATCH_WARN_MONTHS, "warn").otherwise("pass")
    )
    severity = F.when(status == "fail", "HIGH").when(status == "warn", "MEDIUM").otherwise("")
    return devices.select("device_id", F.lit("patch-level").alias("check_id"), status.alias("status"), severity.alias("severity"), F.coalesce(months, F.lit(-1)).alias("months"))


def _choice(value: Column, table: dict[str, tuple[str, str]], default: tuple[str, str]) -> Column:
    out = F.struct(F.lit(default[0]).alias("status"), F.lit(default[1]).alias("severity"))
    for key, (status, severity) in table.items():
        out = F.when(value == key, F.struct(F.lit(status).alias("status"), F.lit(severity).alias("severity"))).otherwise(out)
    return out


# Property or setting value to (status, severity); the last entry is any other value.
PROPERTY_CHECKS = {
    "encryption": ("ro.crypto.state", {"encrypted": ("pass", ""), "unsupported": ("fail", "HIGH"), "unencrypted": ("fail", "HIGH")}, ("na", "")),
    "selinux": ("selinux", {"Enforcing": ("pass", ""), "Permissive": ("warn", "MEDIUM"), "Disabled": ("fail", "HIGH")}, ("na", "")),
    "oem-unlock": ("sys.oem_unlock_allowed", {"0": ("pass", ""), "1": ("warn", "MEDIUM")}, ("na", "")),
    "bootloader-lock": ("ro.boot.flash.locked", {"1": ("pass", ""), "0": ("fail", "HIGH")}, ("na", "")),
}
SETTING_CHECKS = {
    "dev-options": ("development_settings_enabled", {"1": ("warn", "LOW")}, ("pass", "")),
    "usb-debugging": ("adb_enabled", {"1": ("info", "INFO")}, ("pass", "")),
    "wireless-debugging": ("adb_wifi_enabled", {"1": ("warn", "LOW")}, ("pass", "")),
    "app-verifier": ("package_verifier_enable", {"0": ("warn", "MEDIUM"), "1": ("pass", "")}, ("na", "")),
}


def _check_rows(devices: DataFrame, pairs: list[tuple[str, Column]]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("check_id"), s["status"].alias("status"), s["severity"].alias("severity")) for c, s in pairs])
    return devices.select("device_id", F.explode(items).alias("c")).select("device_id", "c.*")


def device_state_checks(devices: DataFrame) -> DataFrame:
    """OS release, storage encryption, SELinux, lock screen, OEM unlock and boot lock; ``props`` is a string map."""
    value = lambda key: F.col("props")[key]
    release = F.regexp_extract(F.coalesce(value("ro.build.version.release"), F.lit("")), r"(\d{1,9})", 1).try_cast("int")
    version = F.struct(
        F.when(release.isNull(), "na").when(release < MIN_RELEASE, "warn").otherwise("pass").alias("status"),
        F.when(release < MIN_RELEASE, "MEDIUM").otherwise("").alias("severity"),
    )
    disabled = F.regexp_extract(F.lower(F.coalesce(value("locksettings"), F.lit(""))), r"\b(true|false)\b", 1)
    lock = F.struct(F.when(disabled == "true", "fail").otherwise("na").alias("status"), F.when(disabled == "true", "HIGH").otherwise("").alias("severity"))
    pairs = [("android-version", version), ("lock-screen", lock)]
    pairs += [(check, _choice(value(key), table, default)) for check, (key, table, default) in PROPERTY_CHECKS.items()]
    return _check_rows(devices, pairs)


def device_setting_checks(devices: DataFrame) -> DataFrame:
    """Developer options, debugging, verifier, unknown installs and backup; ``settings`` is a string map."""
    value = lambda key: F.trim(F.coalesce(F.col("settings")[key], F.lit("")))
    installers = F.size(F.array_distinct(F.regexp_extract_all(value("install_allowed"), F.lit(r"\b[a-zA-Z]\w*(?:\.\w+)+\b"), F.lit(0))))
    unknown = F.struct(F.when(installers > 0, "info").otherwise("pass").alias("status"), F.when(installers > 0, "INFO").otherwise("").alias("severity"))
    text = value("bmgr")
    backup = F.struct(
        F.when(text.contains("disabled"), "pass").when(text.contains("enabled"), "warn").otherwise("na").alias("status"),
        F.when(~text.contains("disabled") & text.contains("enabled"), "LOW").otherwise("").alias("severity"),
    )
    pairs = [(check, _choice(value(key), table, default)) for check, (key, table, default) in SETTING_CHECKS.items()]
    return _check_rows(devices, [*pairs, ("install-unknown", unknown), ("backup", backup)])


def installed_apps(apps: DataFrame, names: int) -> DataFrame:
    """Fleet audit of installed apps per device: exact counts, worst tier, and the first names of each group.

    ``apps``: device_id, name, target_sdk, debuggable, installer, installer_present, readable.
    """
    tier = lint_target_tier(F.col("target_sdk"))
    ok = F.coalesce("readable", F.lit(True))
    flags = F.array_compact(
        F.array(
            F.when(ok & F.col("debuggable"), "apps-debuggable"),
            F.when(ok & tier["status"].isin("fail", "warn"), "apps-target-sdk"),
            F.when(ok & F.col("installer_present") & blank(F.col("installer")), "apps-sideloaded"),
            F.when(~ok, "apps-errors"),
        )
    )
    worst = F.when(tier["severity"] == "HIGH", 3).when(tier["severity"] == "MEDIUM", 2).when(tier["severity"] == "LOW", 1).otherwise(0)
    marked = apps.select("device_id", "name", worst.alias("worst"), F.explode(flags).alias("check_id"))
    counts = marked.groupBy("device_id", "check_id").agg(F.count(F.lit(1)).alias("items"), F.max("worst").alias("worst"))
    first = top_k(marked.select("device_id", "check_id", "name"), ["device_id", "check_id"], [F.col("name")], names, "__n").groupBy(
        "device_id", "check_id"
    ).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    wanted = F.explode(F.array(*[F.lit(c) for c in ("apps-debuggable", "apps-target-sdk", "apps-sideloaded", "apps-errors")])).alias("check_id")
    grid = apps.select("device_id").distinct().select("device_id", wanted)
    rows = grid.join(counts, ["device_id", "check_id"], "left").join(first, ["device_id", "check_id"], "left")
    n = F.coalesce("items", F.lit(0))
    sdk = F.when(F.col("worst") == 3, "fail").otherwise("warn")
    status = (
        F.when(n == 0, "pass").when(F.col("check_id") == "apps-debuggable", "fail").when(F.col("check_id") == "apps-target-sdk", sdk).otherwise("info")
    )
    severity = (
        F.when(n == 0, "").when(F.col("check_id") == "apps-debuggable", "HIGH")
        .when(F.col("check_id") == "apps-target-sdk", F.when(F.col("worst") == 3, "HIGH").when(F.col("worst") == 2, "MEDIUM").otherwise("LOW"))
        .otherwise("INFO")
    )
    return rows.where((F.col("check_id") != "apps-errors") | (n > 0)).select(
        "device_id", "check_id", status.alias("status"), severity.alias("severity"), n.alias("items"), F.coalesce("names", F.lit("")).alias("names")
    )


ISSUES = ("fail", "warn", "info")
CONFIGURATION_CHECKS = ("app-debuggable", "app-allowbackup", "ipa-file-sharing")


def normalize_lint(results: DataFrame, checks: Sequence[str], keys: Sequence[str] = ("app_id",), prefix: str = "LINT-") -> tuple[DataFrame, DataFrame]:
    """(findings, coverage) of lint rows (keys, check_id, status, severity, title): the worst issue per check is its finding.

    Coverage is partial after an error or when an undecided row stands beside others, not-run when nothing was decided.
    """
    keys = list(keys)
    status = F.col("status")
    severity = F.lower(F.coalesce(F.nullif(F.col("severity"), F.lit("")), F.lit("INFO")))
    issue = status.isin(*ISSUES)
    per = results.groupBy(*keys, "check_id").agg(
        F.bool_or(status == "error").alias("error"), F.bool_or(status == "na").alias("na"), F.bool_or(status != "na").alias("decided"),
        F.every(status.isin(*ISSUES, "pass")).alias("clean"),
        F.max_by(F.when(issue, F.struct(severity.alias("severity"), F.col("title").alias("title"))), F.when(issue, F.struct(ranks.severity_rank(severity).alias("r"), "title"))).alias("worst"),
    )
    listed = F.explode(F.array(*[F.lit(c) for c in checks])).alias("check_id")
    subjects = results.select(*keys).distinct().select(*keys, listed)
    rows = subjects.join(per, [*keys, "check_id"], "full_outer")
    rule = F.upper(F.concat(F.lit(prefix), "check_id"))
    state = (
        F.when(F.coalesce("error", F.lit(False)) | (F.coalesce("na", F.lit(False)) & F.coalesce("decided", F.lit(False))), "partial")
        .when(~F.coalesce("decided", F.lit(False)), "not-run").otherwise("checked")
    )
    coverage = rows.select(*keys, rule.alias("rule_id"), state.alias("state"))
    findings = rows.where("worst IS NOT NULL").select(
        *keys, rule.alias("rule_id"), F.col("worst.severity").alias("severity"), F.col("worst.title").alias("title"),
        F.when(F.col("check_id").isin(*CONFIGURATION_CHECKS) & F.col("clean"), "configuration-confirmed").otherwise("candidate").alias("status"),
    )
    return findings, coverage
