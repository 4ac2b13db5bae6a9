"""Posture queries: components from orders, apps and devices from customers, configuration files from parts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators import posture
from sightline.plans.registry import query
from sightline.plans.tables import Tables, joined, text

_TYPES = ("activity", "activity-alias", "service", "receiver", "provider", "meta-data")
_ACTIONS = ("android.intent.action.BOOT_COMPLETED", "android.intent.action.VIEW")


def pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def components(t: Tables) -> DataFrame:
    key, cust, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    return t.orders.select(
        joined("app-", text(cust % 200)).alias("app_id"), F.lit("app/src/main/AndroidManifest.xml").alias("path"),
        joined("com.x.C", text(key)).alias("name"), pick(_TYPES, key % 6).alias("type"),
        F.when(status == "F", "true").when(status == "O", "unspecified").otherwise("false").alias("exported"),
        F.when(cust % 6 == 0, "p").otherwise("").alias("permission"), F.when(key % 7 == 0, "r").alias("read_permission"),
        F.when(key % 3 == 0, "w").alias("write_permission"), (cust % 2 == 0).alias("has_filters"), (key % 13 == 0).alias("launcher"),
        F.array(pick(_ACTIONS, cust % 2)).alias("actions"), (key % 11 == 0).alias("grant_uri"),
    )


def targets(t: Tables) -> DataFrame:
    n = F.col("o_custkey") % 200
    return t.orders.select(n.alias("n")).distinct().select(
        joined("app-", text(F.col("n"))).alias("app_id"), F.when(F.col("n") % 10 != 0, (F.col("n") % 25 + 15).cast("int")).alias("target_sdk"),
        F.lit("app/src/main/AndroidManifest.xml").alias("path"),
    )


_COMP_SQL = """comp AS (SELECT 'app-' || (o_custkey % 200) AS app_id, 'com.x.C' || o_orderkey AS component, ['activity', 'activity-alias', 'service', 'receiver', 'provider', 'meta-data'][1 + o_orderkey % 6] AS type,
     CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'unspecified' ELSE 'false' END AS exported, o_custkey % 6 = 0 AS perm, o_orderkey % 7 = 0 AS rp, o_orderkey % 3 = 0 AS wp,
     o_custkey % 2 = 0 AS has_filters, o_orderkey % 13 = 0 AS launcher, o_custkey % 2 = 0 AS boot, o_orderkey % 11 = 0 AS grant_uri,
     CASE WHEN (o_custkey % 200) % 10 <> 0 THEN CAST((o_custkey % 200) % 25 + 15 AS INTEGER) END AS target FROM orders),
   cd AS (SELECT *, exported = 'unspecified' AND ((has_filters AND (target IS NULL OR target < 31)) OR (type = 'provider' AND (target IS NULL OR target < 17))) AS dflt FROM comp)"""


@query(
    "cfg_03_exported_components",
    f"""WITH {_COMP_SQL} SELECT app_id, component, type, exported = 'unspecified' AS implicit, CASE WHEN type IN ('activity', 'activity-alias') THEN 'low' ELSE 'medium' END AS severity
       FROM cd WHERE type <> 'meta-data' AND (exported = 'true' OR dflt) AND NOT (perm OR (rp AND wp)) AND NOT launcher""",
)
def _(t: Tables) -> DataFrame:
    return posture.exposed(components(t), targets(t)).select("app_id", "component", "type", "implicit", "severity")


@query(
    "cfg_14_exported_lint",
    f"""WITH {_COMP_SQL}, g AS (SELECT *, launcher OR (type = 'receiver' AND boot) AS normal, perm OR (type = 'provider' AND rp AND wp) AS guarded FROM cd),
         s AS (SELECT app_id, count(*) FILTER (WHERE (exported = 'true' OR dflt) AND NOT guarded AND NOT normal) AS open, count(*) FILTER (WHERE exported = 'unspecified' AND has_filters AND NOT dflt AND NOT guarded AND NOT normal) AS reach FROM g GROUP BY app_id)
       SELECT app_id, CASE WHEN open > 0 THEN 'warn' WHEN reach > 0 THEN 'info' ELSE 'pass' END AS status, CASE WHEN open > 0 THEN open ELSE reach END AS items FROM s""",
)
def _(t: Tables) -> DataFrame:
    return posture.exported_lint(components(t), targets(t)).select("app_id", "status", "items")


@query(
    "cfg_11_provider_lint",
    f"""WITH {_COMP_SQL}, pp AS (SELECT 'com.x.C' || o_orderkey AS component, count(*) FILTER (WHERE l_linenumber % 3 = 0) AS bad, count(*) FILTER (WHERE l_linenumber % 3 <> 0) > 0 AS by_path
            FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
         p AS (SELECT cd.*, coalesce(pp.bad, 0) AS bad, coalesce(pp.by_path, false) AS by_path FROM cd LEFT JOIN pp USING (component) WHERE type = 'provider' AND (exported = 'true' OR dflt)),
         s AS (SELECT app_id, count(*) FILTER (WHERE grant_uri) AS grants, CAST(sum(bad) AS BIGINT) AS bad, count(*) FILTER (WHERE NOT perm AND NOT rp AND NOT wp AND by_path) AS partial FROM p GROUP BY app_id),
         a AS (SELECT DISTINCT app_id FROM comp)
       SELECT a.app_id, 'app-provider-grant' AS check_id, CASE WHEN coalesce(grants, 0) > 0 THEN 'warn' ELSE 'pass' END AS status, coalesce(grants, 0) AS items FROM a LEFT JOIN s USING (app_id)
       UNION ALL SELECT a.app_id, 'app-provider-paths', CASE WHEN coalesce(bad, 0) > 0 OR coalesce(partial, 0) > 0 THEN 'info' ELSE 'pass' END, CASE WHEN coalesce(bad, 0) > 0 THEN bad ELSE coalesce(partial, 0) END FROM a LEFT JOIN s USING (app_id)""",
)
def _(t: Tables) -> DataFrame:
    paths = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(
        joined("app-", text(F.col("o_custkey") % 200)).alias("app_id"), joined("com.x.C", text(F.col("o_orderkey"))).alias("component"),
        (F.col("l_linenumber") % 3 != 0).alias("guarded"),
    )
    return posture.provider_lint(components(t), targets(t), paths).select("app_id", "check_id", "status", "items")


@query(
    "cfg_10_deep_link_lint",
    """WITH f AS (SELECT 'app-' || (o_custkey % 200) AS app_id, o_custkey % 9 = 0 AS browsable, CASE o_orderkey % 40 WHEN 0 THEN 'app' ELSE 'https' END AS scheme, o_orderkey % 3 = 0 AS verified FROM orders),
         s AS (SELECT app_id, count(*) FILTER (WHERE browsable AND scheme = 'app') AS custom, count(*) FILTER (WHERE browsable AND NOT verified) AS unverified FROM f GROUP BY app_id)
       SELECT app_id, CASE WHEN custom > 0 OR unverified > 0 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN custom > 0 THEN 'MEDIUM' WHEN unverified > 0 THEN 'LOW' ELSE '' END AS severity,
         CASE WHEN custom > 0 THEN custom ELSE unverified END AS items FROM s""",
)
def _(t: Tables) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = t.orders.select(
        joined("app-", text(cust % 200)).alias("app_id"), (cust % 9 == 0).alias("browsable"),
        F.array(F.when(key % 40 == 0, "app").otherwise("https"), F.lit("http")).alias("schemes"), F.when(key % 3 == 0, "true").alias("auto_verify"),
    )
    return posture.link_lint(components(t), rows).select("app_id", "status", "severity", "items")


@query(
    "cfg_09_unverified_web_links",
    """WITH h AS (SELECT DISTINCT 'app-' || (o_custkey % 200) AS app_id, 'C' || (o_orderkey % 3) AS component, 'h' || (o_custkey % 977) || '.example' AS host FROM orders WHERE o_orderkey % 4 <> 0 AND o_custkey % 5 <> 0),
         r AS (SELECT *, row_number() OVER (PARTITION BY app_id, component ORDER BY host) AS rn FROM h)
       SELECT app_id, component, count(*) AS hosts, string_agg(host, ',' ORDER BY host) FILTER (WHERE rn <= 4) AS sample FROM r GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    links = t.orders.select(
        joined("app-", text(cust % 200)).alias("app_id"), F.lit("m").alias("origin"), joined("C", text(key % 3)).alias("component"),
        F.when(key % 2 == 0, "http").otherwise("https").alias("scheme"), joined("h", text(cust % 977), ".example").alias("host"),
        (cust % 5 != 0).alias("browsable"), F.when(key % 4 == 0, "true").alias("auto_verify"),
    )
    return posture.unverified_links(links, 4).select("app_id", "component", "hosts", "sample")


def android_configs(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    return t.part.select(
        joined("app-", text(key)).alias("app_id"), F.concat(pick(("", "app/", "lib/x/"), key % 3), F.lit("src/main/AndroidManifest.xml")).alias("path"),
        F.when(key % 7 == 0, "true").otherwise("false").alias("debuggable"), F.when(key % 5 == 0, "true").alias("cleartext"),
        F.when(key % 4 == 0, "@xml/net").when(key % 4 == 1, "${cfg}").alias("network_security_config"), F.when(key % 3 == 0, "true").alias("allow_backup"),
    )


@query(
    "cfg_01_manifest_flags",
    """SELECT 'app-' || p_partkey AS app_id, 'ANDROID-DEBUG' AS rule_id, 'configuration-confirmed' AS status FROM part WHERE p_partkey % 7 = 0
       UNION ALL SELECT 'app-' || p_partkey, 'ANDROID-CLEARTEXT', CASE WHEN p_partkey % 4 IN (0, 1) THEN 'candidate' ELSE 'configuration-confirmed' END FROM part WHERE p_partkey % 5 = 0""",
)
def _(t: Tables) -> DataFrame:
    return posture.manifest_flags(android_configs(t)).select("app_id", "rule_id", "status")


@query("cfg_04_allowed_backups", "SELECT 'app-' || p_partkey AS app_id, 'low' AS severity FROM part WHERE p_partkey % 3 = 0")
def _(t: Tables) -> DataFrame:
    return posture.allowed_backups(android_configs(t)).select("app_id", "severity")


@query("cfg_02_broad_transport_exceptions", "SELECT p_partkey FROM part WHERE p_size % 4 = 0 OR p_partkey % 10 = 3")
def _(t: Tables) -> DataFrame:
    rows = t.part.select(
        F.col("p_partkey").alias("app_id"), F.lit("Info.plist").alias("path"), F.when(F.col("p_size") % 4 == 0, F.lit(True)).alias("ats_arbitrary_loads"),
        (F.col("p_partkey") % 10 == 3).alias("ats_arbitrary_web"),
    )
    return posture.broad_transport_exceptions(rows).select(F.col("app_id").alias("p_partkey"))


def build_literals(t: Tables) -> DataFrame:
    return t.lineitem.select(
        joined("app-", text(F.col("l_partkey"))).alias("app_id"), joined("mod", text(F.col("l_orderkey") % 2), "/build.gradle").alias("path"),
        F.col("l_linenumber").alias("line"), (F.col("l_quantity").cast("int") % 30 + 18).alias("level"),
    )


def declared_targets(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    return t.part.select(joined("app-", text(key)).alias("app_id"), F.lit("AndroidManifest.xml").alias("path"), F.when(key % 4 == 0, F.col("p_size")).alias("target_sdk"))


_LEVELS_SQL = """dec AS (SELECT 'app-' || p_partkey AS app_id, CASE WHEN p_partkey % 4 = 0 THEN p_size END AS target FROM part),
   lit AS (SELECT DISTINCT 'app-' || l_partkey AS app_id, 'mod' || (l_orderkey % 2) || '/build.gradle' AS path, l_linenumber AS line, CAST(l_quantity AS INTEGER) % 30 + 18 AS level FROM lineitem),
   least AS (SELECT app_id, min(level) AS least FROM lit GROUP BY app_id), lv AS (SELECT coalesce(dec.app_id, least.app_id) AS app_id, coalesce(target, least) AS target FROM dec FULL OUTER JOIN least ON dec.app_id = least.app_id)"""


@query(
    "cfg_05_outdated_targets",
    f"""WITH {_LEVELS_SQL}, x AS (SELECT app_id, 'AndroidManifest.xml' AS path, 0 AS line, target AS level FROM dec WHERE target IS NOT NULL UNION ALL SELECT * FROM lit)
       SELECT app_id, path, line, level, CASE WHEN level < 23 THEN 'high' WHEN level < 29 THEN 'medium' ELSE 'low' END AS severity FROM x WHERE level < 36""",
)
def _(t: Tables) -> DataFrame:
    return posture.outdated_targets(declared_targets(t), build_literals(t)).select("app_id", "path", "line", "level", "severity")


@query(
    "cfg_05_effective_target",
    f"WITH {_LEVELS_SQL} SELECT app_id, coalesce(target, -1) AS target_sdk FROM lv",
)
def _(t: Tables) -> DataFrame:
    out = posture.target_levels(declared_targets(t), build_literals(t))
    return out.select("app_id", F.coalesce("target_sdk", F.lit(-1)).alias("target_sdk"))


@query(
    "cfg_15_target_tiers",
    f"""WITH {_LEVELS_SQL} SELECT CASE WHEN target IS NULL THEN 'na' WHEN target < 23 THEN 'fail' WHEN target < 30 THEN 'warn' ELSE 'pass' END AS status,
         CASE WHEN target < 23 THEN 'HIGH' WHEN target < 29 THEN 'MEDIUM' WHEN target < 30 THEN 'LOW' ELSE '' END AS severity, count(*) AS apps FROM lv GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    levels = posture.target_levels(declared_targets(t), build_literals(t))
    return posture.target_lint(levels).groupBy("status", "severity").agg(F.count(F.lit(1)).alias("apps"))


def exception_domains(t: Tables) -> DataFrame:
    line, qty = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    return t.lineitem.select(
        joined("app-", text(F.col("l_partkey"))).alias("app_id"), F.lit("Info.plist").alias("path"), joined("d", text(F.col("l_suppkey")), ".example").alias("domain"),
        F.when(line == 1, F.lit(True)).alias("insecure"), (line == 8).alias("third_party_insecure"), pick(("TLSv1.0", "TLSv1.2", "TLSv1.1"), qty % 3).alias("min_tls"),
        F.lit(None).cast("string").alias("third_party_tls"), F.when(line == 2, F.lit(False)).alias("forward_secrecy"),
        F.lit(None).cast("boolean").alias("third_party_secrecy"), F.lit(None).cast("boolean").alias("media"),
    )


@query(
    "cfg_06_transport_exception_findings",
    """SELECT 'app-' || l_partkey AS app_id, count(DISTINCT l_suppkey) AS domains, 'F-' || substr(sha256('["IOS-ATS-EXCEPTION","app",[{"path":"Info.plist"}]]'), 1, 20) AS id
       FROM lineitem WHERE l_linenumber IN (1, 2) OR CAST(l_quantity AS INTEGER) % 3 IN (0, 2) GROUP BY l_partkey""",
)
def _(t: Tables) -> DataFrame:
    return posture.transport_exception_findings(exception_domains(t)).select("app_id", "domains", "id")


@query(
    "cfg_06_exception_reasons",
    """SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_linenumber = 1 THEN 'NSExceptionAllowsInsecureHTTPLoads permits HTTP' END,
         CASE CAST(l_quantity AS INTEGER) % 3 WHEN 0 THEN 'NSExceptionMinimumTLSVersion TLSv1.0' WHEN 2 THEN 'NSExceptionMinimumTLSVersion TLSv1.1' END,
         CASE WHEN l_linenumber = 2 THEN 'NSExceptionRequiresForwardSecrecy disabled' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem) GROUP BY reason""",
)
def _(t: Tables) -> DataFrame:
    rows = posture.transport_exceptions(exception_domains(t)).select(F.explode("reasons").alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def network_files(t: Tables) -> DataFrame:
    """One configuration file per app in its module, a second source set for every sixth, a test one for every fifth."""
    key = F.col("p_partkey")
    root = pick(("", "app/", "lib/x/"), key % 3)
    names = F.array(
        F.when(key % 2 == 0, F.concat(root, F.lit("src/main/res/xml/net.xml"))), F.when(key % 6 == 0, F.concat(root, F.lit("src/pro/res/xml/net.xml"))),
        F.when(key % 5 == 0, F.concat(root, F.lit("src/androidTest/res/xml/net.xml"))), F.lit("other/res/xml/net.xml"),
    )
    return t.part.select(
        joined("app-", text(key)).alias("app_id"), F.explode(F.array_compact(names)).alias("path"), (F.col("p_size") % 3 == 0).alias("user_ca"),
        F.when(F.col("p_size") % 2 == 0, "base-config").otherwise("domain-config").alias("scope"), (F.col("p_size") % 4 == 0).alias("base_anchors"),
        (F.col("p_size") % 5 != 0).alias("cleartext_permitted"),
        F.when(F.col("p_size") % 7 == 0, F.array(F.lit("localhost"), F.lit("127.0.0.1"))).when(F.col("p_size") % 7 == 1, F.array(F.lit("LOCALHOST"), F.lit("example.com")))
        .otherwise(F.array().cast("array<string>")).alias("domains"),
    )


_NSC_SQL = """f AS (SELECT p_partkey AS k, p_size AS s, ['', 'app/', 'lib/x/'][1 + p_partkey % 3] || 'src/main/res/xml/net.xml' AS path, CASE WHEN p_partkey % 6 = 0 THEN 2 ELSE 1 END AS variants FROM part WHERE p_partkey % 4 = 0
     UNION ALL SELECT p_partkey, p_size, ['', 'app/', 'lib/x/'][1 + p_partkey % 3] || 'src/pro/res/xml/net.xml', 2 FROM part WHERE p_partkey % 12 = 0)"""


@query(
    "cfg_07_user_certificate_trust",
    f"""WITH {_NSC_SQL} SELECT 'app-' || k AS app_id, path, CASE WHEN s % 2 = 0 THEN 'base-config' ELSE 'domain-config' END AS scope, CASE WHEN variants = 1 THEN 'configuration-confirmed' ELSE 'candidate' END AS status FROM f WHERE s % 3 = 0
       UNION ALL SELECT 'app-' || p_partkey, CASE WHEN p_partkey % 4 = 0 THEN ['', 'app/', 'lib/x/'][1 + p_partkey % 3] || 'src/main/res/xml/net.xml' ELSE ['', 'app/', 'lib/x/'][1 + p_partkey % 3] || 'src/main/AndroidManifest.xml' END, 'platform-default', 'candidate'
         FROM part WHERE p_size <= 23 AND (p_partkey % 4 IN (2, 3) OR (p_partkey % 4 = 0 AND p_size % 4 <> 0))""",
)
def _(t: Tables) -> DataFrame:
    configs = android_configs(t)
    matches = posture.network_matches(posture.network_references(configs), network_files(t))
    levels = t.part.select(joined("app-", text(F.col("p_partkey"))).alias("app_id"), F.col("p_size").alias("target_sdk"))
    return posture.user_trust(matches, configs, levels).select("app_id", "path", "scope", "status")


@query(
    "cfg_08_configured_cleartext",
    f"""WITH {_NSC_SQL} SELECT 'app-' || k AS app_id, path, CASE WHEN s % 2 = 0 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN variants = 1 THEN 'configuration-confirmed' ELSE 'candidate' END AS status
       FROM f WHERE s % 5 <> 0 AND NOT (s % 2 = 1 AND s % 7 = 0)""",
)
def _(t: Tables) -> DataFrame:
    matches = posture.network_matches(posture.network_references(android_configs(t)), network_files(t))
    return posture.config_cleartext(matches).select("app_id", "path", "severity", "status")


_PERMISSIONS = ("android.permission.CAMERA", "android.permission.INTERNET", "android.permission.READ_SMS", "com.x.PERM", "android.permission.GET_ACCOUNTS")


@query(
    "cfg_12_dangerous_permissions",
    """WITH p AS (SELECT DISTINCT 'app-' || l_partkey AS app_id, (l_suppkey + l_linenumber) % 5 AS i FROM lineitem)
       SELECT app_id, CASE WHEN count(*) FILTER (WHERE i IN (0, 2, 4)) > 0 THEN 'info' ELSE 'pass' END AS status, count(*) FILTER (WHERE i IN (0, 2, 4)) AS items FROM p GROUP BY app_id""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        joined("app-", text(F.col("l_partkey"))).alias("app_id"), pick(_PERMISSIONS, (F.col("l_suppkey") + F.col("l_linenumber")) % 5).alias("permission")
    )
    return posture.permission_lint(rows).select("app_id", "status", "items")


@query(
    "cfg_13_custom_permission_rank",
    """SELECT 'app-' || (p_partkey % 100) AS app_id, count(*) FILTER (WHERE p_partkey % 7 IN (0, 1, 4, 6)) AS items FROM part GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    level = pick(("normal", "dangerous", "signature", "signatureOrSystem", "16", "18", "odd"), F.col("p_partkey") % 7)
    rows = t.part.select(joined("app-", text(F.col("p_partkey") % 100)).alias("app_id"), level.alias("protection_level"))
    return posture.custom_permission_lint(rows).select("app_id", "items")


@query(
    "cfg_16_property_list_lint",
    """WITH w AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS weak FROM lineitem WHERE l_linenumber IN (1, 2) OR CAST(l_quantity AS INTEGER) % 3 IN (0, 2) GROUP BY l_partkey),
         p AS (SELECT p_partkey AS k, p_size AS s, coalesce(weak, 0) AS weak FROM part LEFT JOIN w ON l_partkey = p_partkey),
         r AS (SELECT k, unnest([{'c': 'ipa-ats', 'st': CASE WHEN s % 2 = 0 THEN 'warn' ELSE 'pass' END, 'n': 1}, {'c': 'ipa-ats-domains', 'st': CASE WHEN weak > 0 THEN 'warn' ELSE 'pass' END, 'n': weak},
            {'c': 'ipa-file-sharing', 'st': CASE WHEN s % 3 = 0 THEN 'info' ELSE 'pass' END, 'n': 1}, {'c': 'ipa-url-schemes', 'st': CASE WHEN k % 4 = 0 THEN 'info' WHEN k % 4 = 1 THEN 'na' ELSE 'pass' END, 'n': CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END},
            {'c': 'ipa-min-os', 'st': CASE WHEN k % 9 = 0 THEN 'na' WHEN s % 20 < 15 THEN 'warn' ELSE 'pass' END, 'n': 1}]) AS x FROM p)
       SELECT 'app-' || k AS app_id, x.c AS check_id, x.st AS status, CAST(x.n AS BIGINT) AS items FROM r""",
)
def _(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    app = joined("app-", text(key)).alias("app_id")
    plists = t.part.select(
        app, (size % 2 == 0).alias("arbitrary_loads"), (size % 5).alias("override_keys"), (size % 3 == 0).alias("file_sharing"),
        F.when(key % 9 != 0, joined(text(size % 20), ".1")).alias("minimum_os"),
    )
    schemes = t.part.where(key % 4 < 2).select(app, F.when(key % 4 == 0, joined("s", text(key))).alias("scheme"))
    return posture.plist_lint(plists, exception_domains(t), schemes).select("app_id", "check_id", "status", "items")


TODAY = dt.date(2025, 3, 15)


@query(
    "cfg_17_patch_age",
    """WITH d AS (SELECT device_id, TRY_CAST(security_patch AS DATE) AS p FROM devices), m AS (SELECT device_id, p, (2025 - year(p)) * 12 + 3 - month(p) AS months FROM d)
       SELECT device_id, CASE WHEN p IS NULL THEN 'warn' WHEN months < 0 THEN 'na' WHEN months > 12 THEN 'fail' WHEN months > 6 THEN 'warn' ELSE 'pass' END AS status, coalesce(CAST(months AS INTEGER), -1) AS months FROM m""",
    ("devices",),
)
def _(t: Tables) -> DataFrame:
    return posture.patch_age(t.devices, TODAY).select("device_id", "status", F.col("months").cast("int").alias("months"))


@query(
    "cfg_18_device_state",
    """SELECT x.c AS check_id, x.s AS status, count(*) AS devices FROM (SELECT unnest([{'c': 'android-version', 's': CASE WHEN n % 9 = 0 THEN 'na' WHEN 11 + n % 6 < 13 THEN 'warn' ELSE 'pass' END},
         {'c': 'lock-screen', 's': CASE WHEN n % 3 = 0 THEN 'fail' ELSE 'na' END}, {'c': 'encryption', 's': ['pass', 'fail', 'fail', 'na'][1 + n % 4]}, {'c': 'selinux', 's': ['pass', 'warn', 'fail', 'na'][1 + n % 4]},
         {'c': 'oem-unlock', 's': ['pass', 'warn', 'na'][1 + n % 3]}, {'c': 'bootloader-lock', 's': ['fail', 'pass', 'na'][1 + n % 3]}]) AS x FROM devices) GROUP BY ALL""",
    ("devices",),
)
def _(t: Tables) -> DataFrame:
    n = F.col("n")
    props = F.create_map(
        F.lit("ro.build.version.release"), F.when(n % 9 == 0, "").otherwise(F.col("version")), F.lit("locksettings"),
        pick(("true", "false", "?"), n % 3), F.lit("ro.crypto.state"), pick(("encrypted", "unencrypted", "unsupported", "x"), n % 4),
        F.lit("selinux"), pick(("Enforcing", "Permissive", "Disabled", ""), n % 4), F.lit("sys.oem_unlock_allowed"), pick(("0", "1", ""), n % 3),
        F.lit("ro.boot.flash.locked"), pick(("0", "1", ""), n % 3),
    )
    rows = posture.device_state_checks(t.devices.select("device_id", props.alias("props")))
    return rows.groupBy("check_id", "status").agg(F.count(F.lit(1)).alias("devices"))


@query(
    "cfg_19_device_settings",
    """SELECT x.c AS check_id, x.s AS status, count(*) AS devices FROM (SELECT unnest([{'c': 'dev-options', 's': CASE WHEN n % 2 = 1 THEN 'warn' ELSE 'pass' END}, {'c': 'usb-debugging', 's': CASE WHEN n % 3 = 1 THEN 'info' ELSE 'pass' END},
         {'c': 'wireless-debugging', 's': CASE WHEN n % 5 = 1 THEN 'warn' ELSE 'pass' END}, {'c': 'app-verifier', 's': ['warn', 'pass', 'na'][1 + n % 3]}, {'c': 'install-unknown', 's': CASE WHEN n % 4 = 0 THEN 'info' ELSE 'pass' END},
         {'c': 'backup', 's': ['warn', 'pass', 'na'][1 + n % 3]}]) AS x FROM devices) GROUP BY ALL""",
    ("devices",),
)
def _(t: Tables) -> DataFrame:
    n = F.col("n")
    settings = F.create_map(
        F.lit("development_settings_enabled"), text(n % 2), F.lit("adb_enabled"), text(n % 3), F.lit("adb_wifi_enabled"), text(n % 5),
        F.lit("package_verifier_enable"), text(n % 3), F.lit("install_allowed"), F.when(n % 4 == 0, "org.a.store").otherwise("none"),
        F.lit("bmgr"), pick(("Backup Manager currently enabled", "Backup Manager currently disabled", "?"), n % 3),
    )
    rows = posture.device_setting_checks(t.devices.select("device_id", settings.alias("settings")))
    return rows.groupBy("check_id", "status").agg(F.count(F.lit(1)).alias("devices"))


def installed(t: Tables) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        joined("dev-", text(cust)).alias("device_id"), joined("com.app", text(key)).alias("name"), F.when(key % 9 != 0, (key % 20 + 20).cast("int")).alias("target_sdk"),
        (key % 17 == 0).alias("debuggable"), F.when(key % 4 != 0, "store").alias("installer"), (key % 8 != 0).alias("installer_present"), (key % 23 != 0).alias("readable"),
    )


@query(
    "cfg_20_installed_apps",
    """WITH a AS (SELECT 'dev-' || o_custkey AS device_id, 'com.app' || o_orderkey AS name, o_orderkey AS k, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 20 + 20 END AS sdk FROM orders),
         m AS (SELECT device_id, name, CASE WHEN sdk < 23 THEN 3 WHEN sdk < 29 THEN 2 WHEN sdk < 30 THEN 1 ELSE 0 END AS worst, unnest(list_filter([CASE WHEN k % 23 <> 0 AND k % 17 = 0 THEN 'apps-debuggable' END,
            CASE WHEN k % 23 <> 0 AND sdk < 30 THEN 'apps-target-sdk' END, CASE WHEN k % 23 <> 0 AND k % 8 <> 0 AND k % 4 = 0 THEN 'apps-sideloaded' END, CASE WHEN k % 23 = 0 THEN 'apps-errors' END], lambda x: x IS NOT NULL)) AS check_id FROM a),
         r AS (SELECT *, row_number() OVER (PARTITION BY device_id, check_id ORDER BY name) AS rn FROM m),
         g AS (SELECT device_id, check_id, count(*) AS n, max(worst) AS worst, string_agg(name, ',' ORDER BY name) FILTER (WHERE rn <= 2) AS names FROM r GROUP BY ALL),
         grid AS (SELECT DISTINCT device_id, c.check_id FROM a, (SELECT unnest(['apps-debuggable', 'apps-target-sdk', 'apps-sideloaded', 'apps-errors']) AS check_id) c)
       SELECT grid.device_id, grid.check_id, coalesce(n, 0) AS items, coalesce(names, '') AS names, CASE WHEN coalesce(n, 0) = 0 THEN 'pass' WHEN grid.check_id = 'apps-debuggable' THEN 'fail' WHEN grid.check_id = 'apps-target-sdk' THEN
           CASE WHEN worst = 3 THEN 'fail' ELSE 'warn' END ELSE 'info' END AS status FROM grid LEFT JOIN g ON g.device_id = grid.device_id AND g.check_id = grid.check_id WHERE grid.check_id <> 'apps-errors' OR coalesce(n, 0) > 0""",
)
def _(t: Tables) -> DataFrame:
    return posture.installed_apps(installed(t), 2).select("device_id", "check_id", "items", "names", "status")


CHECKS = ("app-debuggable", "app-exported", "app-cert")


def lint_results(t: Tables) -> DataFrame:
    k = F.col("k")
    return t.events_k.select(
        joined("app-", text(F.col("user_id"))).alias("app_id"),
        F.when(F.col("event_type").isin("click", "view"), "app-debuggable").when(F.col("event_type") == "signup", "app-exported").otherwise("app-extra").alias("check_id"),
        pick(("fail", "warn", "info", "pass"), k % 4).alias("status"), pick(("HIGH", "MEDIUM", "LOW"), k % 3).alias("severity"), joined("title ", text(k)).alias("title"), "k",
    ).withColumn("status", F.when(F.col("k") == 0, "error").when(F.col("k") % 50 == 1, "na").otherwise(F.col("status")))


_LINT_SQL = """r AS (SELECT 'app-' || user_id AS app_id, CASE WHEN event_type IN ('click', 'view') THEN 'app-debuggable' WHEN event_type = 'signup' THEN 'app-exported' ELSE 'app-extra' END AS check_id,
     CASE WHEN k = 0 THEN 'error' WHEN k % 50 = 1 THEN 'na' ELSE ['fail', 'warn', 'info', 'pass'][1 + k % 4] END AS status, ['high', 'medium', 'low'][1 + k % 3] AS severity, 'title ' || k AS title, 3 - k % 3 AS rk FROM events_k),
   g AS (SELECT app_id, check_id, bool_or(status = 'error') AS err, bool_or(status = 'na') AS na, bool_or(status <> 'na') AS decided, bool_and(status IN ('fail', 'warn', 'info', 'pass')) AS clean,
     arg_max(severity, (rk, title)) FILTER (WHERE status IN ('fail', 'warn', 'info')) AS severity, arg_max(title, (rk, title)) FILTER (WHERE status IN ('fail', 'warn', 'info')) AS title FROM r GROUP BY ALL)"""


@query(
    "cfg_21_lint_findings",
    f"""WITH {_LINT_SQL} SELECT app_id, 'LINT-' || upper(check_id) AS rule_id, severity, title, CASE WHEN check_id = 'app-debuggable' AND clean THEN 'configuration-confirmed' ELSE 'candidate' END AS status FROM g WHERE severity IS NOT NULL""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    return posture.normalize_lint(lint_results(t), CHECKS)[0]


@query(
    "cfg_21_lint_coverage",
    f"""WITH {_LINT_SQL}, s AS (SELECT DISTINCT app_id, c.check_id FROM r, (SELECT unnest(['app-debuggable', 'app-exported', 'app-cert']) AS check_id) c UNION SELECT app_id, check_id FROM g)
       SELECT s.app_id, 'LINT-' || upper(s.check_id) AS rule_id, CASE WHEN coalesce(err, false) OR (coalesce(na, false) AND coalesce(decided, false)) THEN 'partial' WHEN NOT coalesce(decided, false) THEN 'not-run' ELSE 'checked' END AS state FROM s LEFT JOIN g USING (app_id, check_id)""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    return posture.normalize_lint(lint_results(t), CHECKS)[1]
