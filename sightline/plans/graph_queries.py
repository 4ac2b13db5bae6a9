"""Dependency, module graph, flow, call-site and budget queries over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators import advisories as adv
from sightline.operators import budgets, callsites, deps, graph
from sightline.plans.advisory_queries import _CORR_SQL, rated_advisories
from sightline.plans.registry import query
from sightline.plans.tables import Tables, joined, text

# --- dependencies ------------------------------------------------------------------------------

_PURL_SQL = """CASE ecosystem WHEN 'Maven' THEN 'pkg:maven/' || split_part(name, ':', 1) || '/' || split_part(name, ':', 2) WHEN 'npm' THEN 'pkg:npm/' || replace(name, ':', '%3A')
   WHEN 'PyPI' THEN 'pkg:pypi/' || replace(name, ':', '%3A') ELSE 'pkg:golang/' || replace(name, ':', '%3A') END || '@' || version"""


@query(
    "jon_15_bom_components",
    f"""SELECT app_id, {_PURL_SQL} AS purl, CASE max(CASE confidence WHEN 'exact' THEN 2 WHEN 'declared' THEN 1 ELSE 0 END) WHEN 2 THEN 'exact' WHEN 1 THEN 'declared' ELSE 'unknown' END AS confidence,
         count(*) AS evidence FROM deps GROUP BY app_id, ecosystem, name, version""",
    ("deps",),
)
def _(t: Tables) -> DataFrame:
    return deps.bom_components(t.deps).select("app_id", "purl", "confidence", "evidence")


@query(
    "jon_15_bom_vulnerabilities",
    f"WITH {_CORR_SQL} SELECT DISTINCT app_id, rule_id AS vulnerability, {_PURL_SQL} AS ref FROM m",
    ("deps", "advisories"),
)
def _(t: Tables) -> DataFrame:
    matches = adv.correlate(t.deps, rated_advisories(t))
    return deps.bom_vulnerabilities(matches, deps.bom_components(t.deps)).select("app_id", "vulnerability", "ref").distinct()


def build_rows(t: Tables) -> DataFrame:
    """Line items as dependency rows of module lockfiles (odd lines) and build scripts (even lines)."""
    lock = F.col("l_linenumber") % 2 == 1
    module = joined("mod", text(F.col("l_orderkey") % 5))
    part = F.col("l_partkey")
    return t.lineitem.select(
        joined("app-", text(F.col("l_suppkey") % 20)).alias("app_id"),
        F.concat_ws("-", *[text(F.col(c)) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]).alias("dep_id"),
        Tables.ecosystem(F.floor(part / 2)).alias("ecosystem"), joined("org:lib", text(part % 40)).alias("name"),
        text(F.col("l_quantity").cast("int") % 3).alias("version"),
        F.when(lock, F.concat(module, F.lit("/gradle.lockfile"))).otherwise(F.concat(module, F.lit("/build.gradle"))).alias("path"),
        F.when(lock, "exact").otherwise("declared").alias("confidence"),
        F.when(lock, "gradle-lockfile-resolved").otherwise("build").alias("version_source"),
        F.when(lock, F.array().cast("array<string>")).otherwise(F.array(module)).alias("declaring"),
        F.when(F.col("l_returnflag") == "A", F.array(F.lit("releaseRuntimeClasspath"))).otherwise(
            F.array(F.lit("releaseRuntimeClasspath"), F.lit("proRuntimeClasspath"))
        ).alias("configurations"),
    )


REACH = {"mod0": ("mod0", "mod2", "mod3"), "mod1": ("mod1", "mod3", "mod4")}


def module_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Roles and reach of every app's five modules (apps come from the suppliers)."""
    apps = t.lineitem.select(joined("app-", text(F.col("l_suppkey") % 20)).alias("app_id")).distinct()
    pairs = [(root, module) for root, modules in REACH.items() for module in modules]
    listed = F.array(*[F.struct(F.lit(r).alias("root"), F.lit(m).alias("module")) for r, m in pairs])
    reach = apps.select("app_id", F.explode(listed).alias("p")).select("app_id", "p.root", "p.module")
    roles = apps.select("app_id", F.explode(F.array(F.lit("mod0"), F.lit("mod1"))).alias("module")).withColumn("role", F.lit("application"))
    return roles, reach


_BUILD_SQL = """bd AS (SELECT 'app-' || (l_suppkey % 20) AS app_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS dep_id,
     CASE (l_partkey // 2) % 4 WHEN 0 THEN 'Maven' WHEN 1 THEN 'npm' WHEN 2 THEN 'PyPI' ELSE 'Go' END AS ecosystem, 'org:lib' || (l_partkey % 40) AS name,
     CAST(CAST(l_quantity AS INTEGER) % 3 AS VARCHAR) AS version, 'mod' || (l_orderkey % 5) AS module, l_linenumber % 2 = 1 AS locked, l_returnflag AS rf FROM lineitem),
   reach AS (SELECT unnest(['mod0','mod0','mod0','mod1','mod1','mod1']) AS root, unnest(['mod0','mod2','mod3','mod1','mod3','mod4']) AS module)"""


@query(
    "jon_16_superseded_declarations",
    f"""WITH {_BUILD_SQL}, res AS (SELECT DISTINCT app_id, name, module AS root FROM bd WHERE locked AND module IN ('mod0', 'mod1')),
         d AS (SELECT bd.* FROM bd WHERE NOT locked AND ecosystem = 'Maven' AND EXISTS (SELECT 1 FROM res WHERE res.app_id = bd.app_id AND res.name = bd.name)),
         j AS (SELECT d.dep_id, bool_and(res.root IS NOT NULL) AS covered FROM d JOIN reach ON reach.module = d.module LEFT JOIN res ON res.app_id = d.app_id AND res.name = d.name AND res.root = reach.root GROUP BY d.dep_id)
       SELECT bd.app_id, CASE WHEN d.dep_id IS NULL THEN '' WHEN coalesce(j.covered, false) THEN 'superseded-by-resolved-build' ELSE 'resolved-in-other-module' END AS resolution,
         CASE WHEN bd.locked AND bd.module NOT IN ('mod0', 'mod1') THEN 'declared' WHEN coalesce(j.covered, false) THEN 'unknown' WHEN bd.locked THEN 'exact' ELSE 'declared' END AS confidence, count(*) AS n
       FROM bd LEFT JOIN d USING (dep_id) LEFT JOIN j USING (dep_id) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    roles, reach = module_tables(t)
    out = deps.supersede(build_rows(t), roles, reach)
    return out.groupBy("app_id", "resolution", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(
    "jon_18_selected_evidence",
    f"""WITH {_BUILD_SQL}, locked AS (SELECT * FROM bd WHERE locked AND module = 'mod0' AND rf <> 'A'),
         v AS (SELECT app_id, ecosystem, name, count(DISTINCT version) AS n FROM locked GROUP BY ALL),
         plain AS (SELECT * FROM bd WHERE NOT locked AND (ecosystem <> 'Maven' OR module IN ('mod0', 'mod2', 'mod3')))
       SELECT app_id, selection, confidence, count(*) AS n FROM (SELECT l.app_id, CASE WHEN v.n > 1 THEN 'partial' ELSE 'selected' END AS selection, CASE WHEN v.n > 1 THEN 'declared' ELSE 'exact' END AS confidence
            FROM locked l JOIN v USING (app_id, ecosystem, name) UNION ALL SELECT app_id, '', 'declared' FROM plain) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    roles, reach = module_tables(t)
    selection = roles.where("module = 'mod0'").select(
        "app_id", F.lit("mod0").alias("application_module"), F.lit("proRuntimeClasspath").alias("runtime_configuration"), F.lit(True).alias("complete")
    )
    out = deps.select_evidence(build_rows(t), reach, selection)
    return out.groupBy("app_id", "selection", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(
    "jon_17_catalog_usage",
    """WITH e AS (SELECT 'app-' || (p_partkey % 10) AS app_id, p_partkey, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 'libs' END AS catalog, CASE WHEN p_partkey % 6 = 0 THEN 'mod1' ELSE '.' END AS root FROM part),
         r AS (SELECT 'app-' || (l_partkey % 10) AS app_id, l_partkey, 'mod' || (l_orderkey % 5) AS module, CASE WHEN l_linenumber = 7 THEN 'platform-only' WHEN l_returnflag = 'R' THEN 'non-shipping-configuration'
             WHEN l_orderkey % 5 = 4 THEN 'build-tooling' ELSE 'declared' END AS state FROM lineitem),
         m AS (SELECT e.p_partkey, r.* FROM e JOIN r ON r.app_id = e.app_id AND r.l_partkey = e.p_partkey AND e.catalog = 'libs' AND (e.root = '.' OR r.module = 'mod1')),
         g AS (SELECT p_partkey, count(*) AS n, max(CASE state WHEN 'declared' THEN 5 WHEN 'platform-only' THEN 4 WHEN 'non-shipping-configuration' THEN 3 WHEN 'build-tooling' THEN 1 END) AS best,
            string_agg(DISTINCT module, ',' ORDER BY module) FILTER (WHERE state = 'declared') AS mods FROM m GROUP BY p_partkey)
       SELECT e.p_partkey AS entry_id, CASE WHEN e.catalog IS NULL THEN 'catalog-name-unresolved' WHEN g.best IS NULL THEN 'no-reference-found' WHEN g.best = 5 THEN 'declared' WHEN g.best = 4 THEN 'platform-only'
           WHEN g.best = 3 THEN 'non-shipping-configuration' ELSE 'build-tooling' END AS usage_state, coalesce(g.n, 0) AS reference_count, coalesce(g.mods, '') AS declaring_modules,
         CASE WHEN g.best = 5 THEN 'catalog-alias-declared' ELSE 'catalog-declared-unresolved-usage' END AS version_source
       FROM e LEFT JOIN g USING (p_partkey)""",
)
def _(t: Tables) -> DataFrame:
    key, line = F.col("p_partkey"), F.col("l_partkey")
    catalog = t.part.select(
        joined("app-", text(key % 10)).alias("app_id"), key.alias("entry_id"), F.when(key % 17 != 0, "libs").alias("catalog"),
        joined("My-lib_", text(key)).alias("alias"), F.array(joined("bundle-", text(key))).alias("bundles"),
        F.when(key % 6 == 0, "mod1").otherwise(".").alias("root"), F.lit("unknown").alias("confidence"),
    )
    module = joined("mod", text(F.col("l_orderkey") % 5))
    refs = t.lineitem.select(
        joined("app-", text(line % 10)).alias("app_id"), F.lit("libs").alias("catalog"),
        F.when(F.col("l_linenumber") % 2 == 0, "bundle").otherwise("library").alias("kind"),
        F.when(F.col("l_linenumber") % 2 == 0, joined("bundle.", text(line))).otherwise(joined("my.lib.", text(line))).alias("accessor"),
        F.concat(module, F.lit("/build.gradle")).alias("path"), F.col("l_linenumber").alias("line"), module.alias("module"),
        F.when(F.col("l_linenumber") == 7, "platform-only").when(F.col("l_returnflag") == "R", "non-shipping-configuration")
        .otherwise("declared").alias("state"),
    )
    apps = t.part.select(joined("app-", text(key % 10)).alias("app_id")).distinct()
    roles = apps.select("app_id", F.lit("mod4").alias("module"), F.lit("build-tooling").alias("role"))
    out = deps.resolve_catalog_usage(catalog, refs, roles)
    return out.select(
        "entry_id", "usage_state", "reference_count", F.coalesce(F.array_join("declaring_modules", ","), F.lit("")).alias("declaring_modules"), "version_source"
    )


# --- module graph ------------------------------------------------------------------------------


@query(
    "jon_19_module_reach",
    """WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey % 4 = 0 AND p_partkey > 0),
         r AS (SELECT p_partkey AS root, p_partkey AS module FROM part UNION SELECT r.root, e.dst FROM r JOIN e ON e.src = r.module)
       SELECT root, count(*) AS modules, min(module) AS least FROM r GROUP BY root""",
)
def _(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    tree = t.part.where(key > 0).select(key.alias("src"), F.floor(key / 2).alias("dst"))
    extra = t.part.where((key > 0) & (key % 4 == 0)).select(key.alias("src"), F.floor(key / 3).alias("dst"))
    roots = t.part.select(key.alias("module"))
    out = graph.reachable(tree.unionByName(extra), roots)
    return out.groupBy("root").agg(F.count(F.lit(1)).alias("modules"), F.min("module").alias("least"))


def _roles_sql() -> str:
    rounds = ["d0 AS MATERIALIZED (SELECT m FROM nodes WHERE role IN ('build-tooling', 'non-shipping-module'))"]
    for i in range(1, 14):
        rounds.append(
            f"""d{i} AS MATERIALIZED (SELECT m FROM d{i - 1} UNION SELECT n.m FROM nodes n WHERE n.library AND coalesce(n.role, '') <> 'application' AND EXISTS (SELECT 1 FROM links l WHERE l.m = n.m)
              AND NOT EXISTS (SELECT 1 FROM links l WHERE l.m = n.m AND l.state NOT IN ('non-shipping-configuration', 'platform-only') AND l.consumer NOT IN (SELECT m FROM d{i - 1})))"""
        )
    return ",\n".join(rounds)


@query(
    "jon_19_shipping_roles",
    f"""WITH nodes AS (SELECT p_partkey AS m, p_partkey % 3 <> 0 AS library, CASE WHEN p_partkey % 41 = 0 THEN 'application' WHEN p_partkey % 5 = 0 THEN 'build-tooling' WHEN p_partkey % 7 = 0 THEN 'non-shipping-module' END AS role FROM part),
        links AS (SELECT DISTINCT p_partkey AS consumer, p_partkey // 2 AS m, CASE WHEN p_size % 3 = 0 THEN 'declared' WHEN p_size % 3 = 1 THEN 'platform-only' ELSE 'declared' END AS state FROM part WHERE p_partkey > 0),
        {_roles_sql()}
        SELECT coalesce(n.role, CASE WHEN d.m IS NOT NULL THEN 'non-shipping-module' ELSE '' END) AS role, count(*) AS modules, CAST(sum(n.m) AS BIGINT) AS checksum FROM nodes n LEFT JOIN d13 d ON d.m = n.m GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    role = F.when(key % 41 == 0, "application").when(key % 5 == 0, "build-tooling").when(key % 7 == 0, "non-shipping-module")
    modules = t.part.select(key.alias("module"), role.alias("role"), (key % 3 != 0).alias("library"))
    edges = t.part.where(key > 0).select(
        key.alias("consumer"), F.floor(key / 2).alias("module"), F.when(F.col("p_size") % 3 == 1, "platform-only").otherwise("declared").alias("state")
    )
    out = graph.shipping_roles(modules, edges)
    return out.groupBy(F.coalesce("role", F.lit("")).alias("role")).agg(F.count(F.lit(1)).alias("modules"), F.sum("module").alias("checksum"))


# --- flows and call sites ------------------------------------------------------------------------

METHODS = (
    ("WebView", "loadUrl"), ("SslErrorHandler", "proceed"), ("WebView", "addJavascriptInterface"), ("Cipher", "getInstance"),
    ("MessageDigest", "getInstance"), ("PendingIntent", "getActivity"), ("SQLiteDatabase", "rawQuery"), ("SecretKeySpec", "SecretKeySpec"),
    ("IvParameterSpec", "IvParameterSpec"), ("Context", "startActivity"), ("File", "FileOutputStream"), ("WKWebView", "loadRequest"),
    ("hybrid", "loadURL"), ("hybrid", "eval"), ("hybrid", "executeSql"), ("hybrid", "invokeMethod"), ("hybrid", "CC_MD5"),
    ("android.webkit.WebSettings", "setAllowFileAccessFromFileURLs"), ("android.content.SharedPreferences$Editor", "putString"),
    ("android.util.Log", "d"), ("dalvik.system.DexClassLoader", "<init>"), ("javax.crypto.Cipher", "getInstance"),
    ("android.webkit.WebSettings", "setSavePassword"),
)
KINDS = ("input", "literal", "nested-intent", "archive-entry")
GUARDS = ("url-guard", "weak-url-guard", "bound-parameter", "target-check", "canonical-path")
CONSTANTS = ("AES", "AES/ECB/PKCS5Padding", "AES/GCM/NoPadding", "DES/CBC/PKCS5Padding", "MD5", "SHA-256", "sha1", "user_token", "title", "true")


def call_sites(t: Tables) -> DataFrame:
    """Every event is one call site; its node is the event number."""
    n = F.col("event_id")
    k = F.col("k")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    return t.events_k.select(
        joined("app-", text(F.lit(0))).alias("app_id"), n.alias("node"), joined("f", text(F.floor(n / 16)), ".kt").alias("path"), (k + 1).alias("line"),
        pick([c for c, _ in METHODS], n % len(METHODS)).alias("cls"), pick([m for _, m in METHODS], n % len(METHODS)).alias("method"),
        joined("r", text(F.col("user_id") % 3)).alias("receiver"), F.when(k % 4 == 0, joined("pkg.T", text(k))).alias("target"),
        F.array(pick(CONSTANTS, k % len(CONSTANTS))).alias("args"), F.when(k % 3 != 0, F.lit(0x04000000) * (k % 2)).cast("bigint").alias("flags"),
        "event_type", "k",
    )


def flow_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges from each node to its half; facts and guards by event type and number."""
    n, k = F.col("event_id"), F.col("k")
    app = F.lit("app-0").alias("app_id")
    edges = t.events_k.where(n > 0).select(app, n.alias("src"), F.floor(n / 2).alias("dst"))
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    facts = t.events_k.where(k % 4 == 1).select(app, n.alias("node"), pick(KINDS, n % len(KINDS)).alias("kind"))
    guards = t.events_k.where(k % 6 == 0).select(app, n.alias("node"), pick(GUARDS, n % len(GUARDS)).alias("kind"))
    return edges, facts, guards


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


_CALLS_SQL = f"""cs AS (SELECT event_id AS node, 'f' || (event_id // 16) || '.kt' AS path, k + 1 AS line, {_list([c for c, _ in METHODS])}[1 + event_id % {len(METHODS)}] AS cls,
     {_list([m for _, m in METHODS])}[1 + event_id % {len(METHODS)}] AS method, 'r' || (user_id % 3) AS receiver, CASE WHEN k % 4 = 0 THEN 'pkg.T' || k END AS target,
     {_list(CONSTANTS)}[1 + k % {len(CONSTANTS)}] AS arg, CASE WHEN k % 3 <> 0 THEN 67108864 * (k % 2) END AS flags, k FROM events_k),
   facts AS (SELECT event_id AS node, {_list(KINDS)}[1 + event_id % {len(KINDS)}] AS kind FROM events_k WHERE k % 4 = 1),
   guards AS (SELECT event_id AS node, {_list(GUARDS)}[1 + event_id % {len(GUARDS)}] AS kind FROM events_k WHERE k % 6 = 0),
   steps AS (SELECT node AS origin, kind, d, CASE WHEN d = 0 THEN node ELSE node >> d END AS spot FROM facts, (SELECT unnest(range(0, 9)) AS d) WHERE d = 0 OR (node >> (d - 1)) > 0)"""


def _flow_sql(rule: callsites.FlowFamily, guards: tuple[str, ...]) -> str:
    method = "method IN (" + ", ".join(f"'{m}'" for m in rule.methods) + ")"
    if rule.classes:
        method += " AND cls IN (" + ", ".join(f"'{c}'" for c in rule.classes) + ")"
    kinds = ", ".join(f"'{k}'" for k in rule.kinds)
    blocked = ""
    if guards:
        listed = ", ".join(f"'{g}'" for g in guards)
        blocked = (
            f" AND NOT EXISTS (SELECT 1 FROM steps b JOIN guards g ON g.node = b.spot AND g.kind IN ({listed}) WHERE b.origin = s.origin AND b.d <= s.d)"
        )
    # Node 0 is its own half, so the first visit counts.
    return (
        f"SELECT s.origin, s.spot AS sink, CAST(min(s.d) AS INTEGER) AS steps FROM steps s JOIN cs ON cs.node = s.spot AND {method} WHERE s.kind IN ({kinds}){blocked} GROUP BY s.origin, s.spot"
    )


def _flow_query(name: str, rule_id: str) -> None:
    rule = callsites.family(rule_id)

    @query(name, f"WITH {_CALLS_SQL} {_flow_sql(rule, rule.guards)}", ("events_k",))
    def _(t: Tables) -> DataFrame:
        edges, facts, guards = flow_tables(t)
        return callsites.flow_findings(rule, call_sites(t), edges, facts, guards)[0].select("origin", "sink", "steps")


FLOW_QUERIES = {
    "det_44_untrusted_web_load": "AST-WEBVIEW-UNTRUSTED-URL",
    "det_51_sql_concatenation": "AST-SQL-CONCAT",
    "det_53_hardcoded_key": "AST-CRYPTO-HARDCODED-KEY",
    "det_54_static_iv": "AST-CRYPTO-STATIC-IV",
    "det_55_intent_redirection": "AST-INTENT-REDIRECTION",
    "det_57_path_traversal": "AST-PATH-TRAVERSAL",
    "det_58_objc_untrusted_request": "OBJC-WEBVIEW-UNTRUSTED-REQUEST",
    "det_59_hybrid_web_load": "HYBRID-UNTRUSTED-URL",
    "det_60_hybrid_script_execution": "HYBRID-JS-EVAL",
    "det_61_hybrid_sql": "HYBRID-SQL-INPUT",
    "det_62_hybrid_native_bridge": "HYBRID-NATIVE-BRIDGE",
}
for _name, _rule in FLOW_QUERIES.items():
    _flow_query(_name, _rule)

# Five apps, the first with half of the nodes; rings of eight calls, halvings inside a block of 64, and a hub an app that
# every fifth node calls and that calls into the app's first block.
_FIRST_BLOCKS = (0, 1, 2, 8, 4)
_APP_SQL = "CASE WHEN (node // 64) % 3 = 0 THEN 0 ELSE (node // 64) % 5 END"


def fleet_flow_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    n, k = F.col("event_id"), F.col("k")
    block = F.floor(n / 64)
    app = F.when(block % 3 == 0, F.lit(0)).otherwise(block % 5).cast("int")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    rows = t.events_k.withColumn("app_id", joined("app-", text(app))).withColumn("a", app)
    ring = rows.select("app_id", n.alias("src"), F.when(n % 8 == 7, n - 7).otherwise(n + 1).alias("dst"))
    halves = rows.where(n % 8 == 0).select("app_id", n.alias("src"), (block * 64 + F.floor((n - block * 64) / 2)).alias("dst"))
    hub_in = rows.where(n % 5 == 0).select("app_id", n.alias("src"), (-1 - F.col("a")).cast("bigint").alias("dst"))
    hub_out = rows.groupBy("app_id", "a").agg(F.count(F.lit(1))).select(
        "app_id", (-1 - F.col("a")).cast("bigint").alias("src"), (pick(_FIRST_BLOCKS, F.col("a")) * 64).cast("bigint").alias("dst")
    )
    edges = ring.unionByName(halves).unionByName(hub_in).unionByName(hub_out)
    facts = rows.where(k % 4 == 1).select("app_id", n.alias("node"), pick(KINDS, n % len(KINDS)).alias("kind"))
    guards = rows.where(k % 6 == 0).select("app_id", n.alias("node"), pick(GUARDS, n % len(GUARDS)).alias("kind"))
    sites = call_sites(t).drop("app_id").withColumn("__b", F.floor(F.col("node") / 64))
    app_of = F.when(F.col("__b") % 3 == 0, F.lit(0)).otherwise(F.col("__b") % 5).cast("int")
    return sites.withColumn("app_id", joined("app-", text(app_of))).drop("__b"), edges, facts, guards


def _family_rows() -> str:
    return ", ".join(
        f"{{'rule_id': '{r.rule_id}', 'kinds': {_list(r.kinds)}, 'methods': {_list(r.methods)}, 'guards': {_list(r.guards or ('-',))}, 'classes': {_list(r.classes or ('*',))}}}"
        for r in callsites.FAMILIES
    )


@query(
    "det_42_all_flow_families",
    f"""WITH RECURSIVE {_CALLS_SQL},
    rules AS (SELECT unnest([{_family_rows()}], recursive := true)),
    nodes AS (SELECT node, {_APP_SQL} AS app FROM cs),
    edges AS (SELECT app, node AS src, CASE WHEN node % 8 = 7 THEN node - 7 ELSE node + 1 END AS dst FROM nodes
      UNION SELECT app, node, (node // 64) * 64 + (node % 64) // 2 FROM nodes WHERE node % 8 = 0
      UNION SELECT app, node, -1 - app FROM nodes WHERE node % 5 = 0
      UNION SELECT DISTINCT app, -1 - app, [{', '.join(str(64 * b) for b in _FIRST_BLOCKS)}][app + 1] FROM nodes),
    shut AS (SELECT r.rule_id, n.app, n.node FROM guards g JOIN nodes n USING (node) JOIN rules r ON list_contains(r.guards, g.kind)),
    open_edges AS (SELECT r.rule_id, e.* FROM edges e CROSS JOIN rules r ANTI JOIN shut s ON s.rule_id = r.rule_id AND s.app = e.app AND s.node = e.dst),
    walk AS (
      SELECT r.rule_id, n.app, f.node AS origin, f.node AS node, 0 AS d FROM facts f JOIN nodes n USING (node) JOIN rules r ON list_contains(r.kinds, f.kind)
        ANTI JOIN shut s ON s.rule_id = r.rule_id AND s.app = n.app AND s.node = f.node
      UNION
      SELECT w.rule_id, w.app, w.origin, e.dst, w.d + 1 FROM walk w JOIN open_edges e ON e.rule_id = w.rule_id AND e.app = w.app AND e.src = w.node WHERE w.d < 8)
    SELECT w.rule_id, 'app-' || w.app AS app_id, w.origin, w.node AS sink, CAST(min(w.d) AS INTEGER) AS steps
    FROM walk w JOIN rules r USING (rule_id) JOIN cs ON cs.node = w.node AND list_contains(r.methods, cs.method)
      AND (list_contains(r.classes, '*') OR list_contains(r.classes, cs.cls))
    GROUP BY ALL""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    sites, edges, facts, guards = fleet_flow_tables(t)
    found, _ = callsites.all_flow_findings(callsites.FAMILIES, sites, edges, facts, guards)
    return found.select("rule_id", "app_id", "origin", "sink", "steps")


_LOAD = callsites.family("AST-WEBVIEW-UNTRUSTED-URL")


@query(
    "det_45_weak_host_allowlist",
    f"WITH {_CALLS_SQL}, sound AS ({_flow_sql(_LOAD, ('url-guard',))}), anyg AS ({_flow_sql(_LOAD, _LOAD.guards)}) SELECT sound.origin, sound.sink FROM sound ANTI JOIN anyg ON anyg.origin = sound.origin AND anyg.sink = sound.sink",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    edges, facts, guards = flow_tables(t)
    return callsites.weak_guard_findings(call_sites(t), edges, facts, guards).select("origin", "sink")


@query(
    "det_47_bridged_untrusted_view",
    f"""WITH {_CALLS_SQL}, loads AS ({_flow_sql(_LOAD, _LOAD.guards)}), lv AS (SELECT DISTINCT path, receiver FROM cs JOIN loads ON loads.sink = cs.node)
        SELECT node, line, cs.receiver FROM cs JOIN lv USING (path, receiver) WHERE method = 'addJavascriptInterface'""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    edges, facts, guards = flow_tables(t)
    sites = call_sites(t)
    loads, _ = callsites.flow_findings(_LOAD, sites, edges, facts, guards)
    return callsites.bridged_untrusted_views(sites, loads).select("node", "line", "receiver")


@query(
    "det_42_bounded_reachability",
    f"""WITH {_CALLS_SQL}, f AS (SELECT origin, count(DISTINCT spot) AS reached, max(d) AS depth FROM steps WHERE d <= 3 GROUP BY origin)
        SELECT origin, reached, (origin >> 3) > 0 AS cut FROM f""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    edges, facts, _ = flow_tables(t)
    starts = facts.select("app_id", "node", F.col("node").alias("origin"))
    everywhere = t.events_k.select(F.lit("app-0").alias("app_id"), F.col("event_id").alias("node"), F.lit("ANY").alias("rule_id"))
    found, cuts = graph.flow_paths(edges, starts, everywhere, ["app_id"], depth=3)
    per = found.groupBy("origin").agg(F.count(F.lit(1)).alias("reached"))
    ended = cuts.select("origin").distinct().withColumn("cut", F.lit(True))
    return per.join(ended, "origin", "left").select("origin", "reached", F.coalesce("cut", F.lit(False)).alias("cut"))


@query(
    "det_42_flow_paths",
    f"""WITH {_CALLS_SQL}, f AS ({_flow_sql(_LOAD, _LOAD.guards)}) SELECT origin, sink, list_aggregate(list_transform(range(0, steps + 1), lambda i: CAST(origin >> CAST(i AS BIGINT) AS VARCHAR)), 'string_agg', '>') AS path FROM f""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    edges, facts, guards = flow_tables(t)
    found, _ = callsites.flow_findings(_LOAD, call_sites(t), edges, facts, guards)
    return found.select("origin", "sink", F.concat_ws(">", F.transform("path", lambda p: p.cast("string"))).alias("path"))


def _user_spec(t: Tables) -> DataFrame:
    return t.local(
        [("s1", "source", "d", None, None), ("s2", "source", "putString", "r1", None), ("k1", "sink", "getActivity", None, "webview-load")],
        "id string, role string, method string, receiver string, kind string",
    )


_SPEC_SQL = f"""WITH {_CALLS_SQL}, src AS (SELECT node FROM cs WHERE method = 'd' OR (method = 'putString' AND receiver = 'r1')),
   st AS (SELECT node AS origin, d, node >> d AS spot FROM src, (SELECT unnest(range(0, 9)) AS d) WHERE d = 0 OR (node >> (d - 1)) > 0)"""


@query(
    "det_43_user_sources_and_sinks",
    f"{_SPEC_SQL} SELECT origin, spot AS sink, CAST(min(d) AS INTEGER) AS steps FROM st JOIN cs ON cs.node = st.spot AND method = 'getActivity' GROUP BY origin, spot",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    edges, _, guards = flow_tables(t)
    sites = call_sites(t)
    sources, sinks = callsites.user_specification(_user_spec(t))
    facts = callsites.specified_facts(sites, sources)
    return callsites.flow_findings(sinks[0], sites, edges, facts)[0].select("origin", "sink", "steps")


@query("udf_02_user_source_facts", f"{_SPEC_SQL} SELECT node FROM src", ("events_k",))
def _(t: Tables) -> DataFrame:
    sources, _ = callsites.user_specification(_user_spec(t))
    return callsites.specified_facts(call_sites(t), sources).select("node")


_SIMPLE_SQL = {
    "det_46_tls_error_proceeds": ("AST-WEBVIEW-SSL-BYPASS", "method = 'proceed'"),
    "det_48_ecb_transformation": ("AST-CRYPTO-ECB", "method = 'getInstance' AND cls LIKE '%Cipher' AND arg IN ('AES', 'AES/ECB/PKCS5Padding')"),
    "det_49_weak_digest": ("AST-CRYPTO-WEAK-HASH", "method = 'getInstance' AND cls = 'MessageDigest' AND upper(arg) IN ('MD5', 'SHA1')"),
    "det_50_mutable_pending_intent": ("AST-PENDINGINTENT-MUTABLE", "method = 'getActivity' AND flags = 0 AND target IS NULL"),
    "det_52_broken_cipher": ("AST-CRYPTO-WEAK-CIPHER", "method = 'getInstance' AND cls LIKE '%Cipher' AND arg LIKE 'DES/%'"),
    "det_56_implicit_intent": ("AST-IMPLICIT-INTENT", "method = 'startActivity' AND target IS NULL"),
    "det_58_objc_weak_digest": ("OBJC-CRYPTO-WEAK-HASH", "method = 'CC_MD5'"),
}


def _simple_query(name: str, rule_id: str, condition: str) -> None:
    @query(name, f"WITH {_CALLS_SQL} SELECT node, line FROM cs WHERE {condition}", ("events_k",))
    def _(t: Tables) -> DataFrame:
        return callsites.call_findings(call_sites(t), (rule_id,)).select("node", "line")


for _name, (_rule, _condition) in _SIMPLE_SQL.items():
    _simple_query(_name, _rule, _condition)


@query(
    "det_63_compiled_call_rules",
    f"""WITH {_CALLS_SQL} SELECT rule_id, count(*) AS findings FROM (
        SELECT 'BINARY-WEBVIEW-FILE-ACCESS' AS rule_id FROM cs WHERE method = 'setAllowFileAccessFromFileURLs' AND arg = 'true'
        UNION ALL SELECT 'BINARY-STORAGE-TOKEN-PREFS' FROM cs WHERE method = 'putString' AND arg = 'user_token'
        UNION ALL SELECT 'BINARY-STORAGE-SENSITIVE-LOG' FROM cs WHERE method = 'd' AND arg = 'user_token') GROUP BY rule_id""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    rules = tuple(r for r in callsites.simple_rules() if r.startswith("BINARY-"))
    return callsites.call_findings(call_sites(t), rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))


@query(
    "det_64_compiled_call_indicators",
    f"""WITH {_CALLS_SQL} SELECT "group", indicator, count(*) AS calls FROM (SELECT CASE WHEN cls = 'javax.crypto.Cipher' AND regexp_matches(arg, 'DES/|ECB|MD5|SHA1') THEN 'weak-crypto'
          WHEN method = 'setSavePassword' THEN 'webview' WHEN method = '<init>' THEN 'dynamic-code' END AS "group", CASE WHEN cls = 'javax.crypto.Cipher' THEN arg ELSE cls || '#' || method END AS indicator FROM cs)
        WHERE "group" IS NOT NULL GROUP BY ALL""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    return callsites.indicator_counts(call_sites(t)).select("group", "indicator", "calls")


# --- budgets -------------------------------------------------------------------------------------

_FILES_SQL = """files AS (SELECT 'app-' || (doc_id % 3) AS app_id, doc_id, n_chars AS bytes, ['src/main/', 'vendor/', 'res/values-fr/', 'src/test/', 'docs/', 'android/core/src/main/'][1 + doc_id % 6] || 'f' || doc_id
      || ['.kt', '.h', '.lock', '.md', '.js'][1 + doc_id % 5] AS path, doc_id % 6 AS a, doc_id % 5 AS b FROM documents),
   ranked AS (SELECT *, CASE WHEN a = 3 THEN 3 WHEN a = 2 THEN 2 WHEN b = 3 THEN 1 ELSE 0 END AS tier,
      CASE WHEN a IN (2, 3) OR b = 3 THEN 0 WHEN a = 1 THEN 5 WHEN b = 2 THEN 4 WHEN b = 1 THEN 3 WHEN b = 0 THEN 1 ELSE 2 END AS rank,
      CASE a WHEN 0 THEN '.' WHEN 1 THEN 'vendor' WHEN 2 THEN 'res' WHEN 3 THEN '.' WHEN 4 THEN 'docs' ELSE 'android/core' END AS module FROM files),
   turns AS (SELECT *, row_number() OVER (PARTITION BY app_id, tier, rank, module ORDER BY path) AS turn FROM ranked)"""


def staged_files(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    folder = pick(("src/main/", "vendor/", "res/values-fr/", "src/test/", "docs/", "android/core/src/main/"), doc % 6)
    return t.documents.select(
        joined("app-", text(doc % 3)).alias("app_id"), "doc_id", F.col("n_chars").alias("bytes"),
        F.concat(folder, F.lit("f"), text(doc), pick((".kt", ".h", ".lock", ".md", ".js"), doc % 5)).alias("path"),
    )


@query("srt_05_staging_rank", f"WITH {_FILES_SQL} SELECT doc_id, tier, rank FROM ranked")
def _(t: Tables) -> DataFrame:
    rank = budgets.staging_rank(F.col("path"))
    return staged_files(t).select("doc_id", rank["tier"].alias("tier"), rank["rank"].alias("rank"))


@query("win_03_round_robin_modules", f"WITH {_FILES_SQL} SELECT doc_id, tier, rank, module, turn FROM turns")
def _(t: Tables) -> DataFrame:
    return budgets.round_robin(staged_files(t)).select("doc_id", "tier", "rank", "module", "turn")


# Greedy admission in SQL: a recursive walk over each app's files in order.
_ADMIT_SQL = f"""WITH RECURSIVE {_FILES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY tier, rank, turn, module) AS p FROM turns),
   walk AS (SELECT app_id, p, CASE WHEN bytes <= 200000 THEN bytes ELSE 0 END AS used, bytes <= 200000 AS ok FROM o WHERE p = 1
     UNION ALL SELECT o.app_id, o.p, w.used + CASE WHEN w.used + o.bytes <= 200000 THEN o.bytes ELSE 0 END, w.used + o.bytes <= 200000 FROM walk w JOIN o ON o.app_id = w.app_id AND o.p = w.p + 1)"""


@query("win_04_budget_admission", f"{_ADMIT_SQL} SELECT o.doc_id, w.ok AS admitted FROM walk w JOIN o ON o.app_id = w.app_id AND o.p = w.p")
def _(t: Tables) -> DataFrame:
    turns = budgets.round_robin(staged_files(t))
    # A small group bound forces the distributed rounds first; the last rows finish in one pass.
    out = budgets.admit(turns, ["app_id"], ["tier", "rank", "turn", "module"], "bytes", 200_000)
    return out.select("doc_id", "admitted")


@query(
    "agg_24_omission_accounting",
    f"""{_ADMIT_SQL} SELECT o.app_id, ['code_and_config', 'other_text', 'localized_values', 'tests'][1 + tier] AS kind, module, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes
        FROM walk w JOIN o ON o.app_id = w.app_id AND o.p = w.p WHERE NOT w.ok GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    turns = budgets.round_robin(staged_files(t))
    return budgets.omissions(budgets.admit(turns, ["app_id"], ["tier", "rank", "turn", "module"], "bytes", 200_000))


QUEUE_AT = dt.datetime(2024, 1, 20)


def work_queue(t: Tables) -> DataFrame:
    k = F.col("k")
    return t.events_k.select(
        joined("CVE-", text(F.col("event_id"))).alias("id"), text(k).alias("revision"), (k % 2).alias("priority"),
        F.when(k % 5 == 0, "done").otherwise("pending").alias("state"),
        F.when(k % 3 == 0, F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("next_attempt"), F.col("ts").alias("queued_at"),
    )


@query(
    "win_07_two_lane_queue",
    """WITH due AS (SELECT event_id, k % 2 AS pr, ts FROM events_k WHERE k % 5 <> 0 AND (k % 3 <> 0 OR ts + INTERVAL 10 DAYS <= TIMESTAMP '2024-01-20')),
         a AS (SELECT event_id, ts, 'priority' AS lane FROM due WHERE pr = 0 ORDER BY ts LIMIT 26), b AS (SELECT event_id, ts, 'bulk' AS lane FROM due WHERE pr = 1 ORDER BY ts LIMIT 25)
       SELECT 'CVE-' || event_id AS id, lane FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    return budgets.two_lane_queue(work_queue(t), 51, QUEUE_AT).select("id", "lane")


@query(
    "win_07_unused_quota",
    """WITH due AS (SELECT event_id, CASE WHEN event_id % 2000 = 0 THEN 0 ELSE 1 END AS pr, ts FROM events_k WHERE k % 5 <> 0 AND (k % 3 <> 0 OR ts + INTERVAL 10 DAYS <= TIMESTAMP '2024-01-20')),
         a AS (SELECT event_id, ts, 'priority' AS lane FROM due WHERE pr = 0 ORDER BY ts LIMIT 20), b AS (SELECT event_id, ts, 'bulk' AS lane FROM due WHERE pr = 1 ORDER BY ts LIMIT 20),
         s AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT event_id, ts, 'fill' AS lane FROM due WHERE event_id NOT IN (SELECT event_id FROM s) ORDER BY ts LIMIT (SELECT 40 - count(*) FROM s))
       SELECT 'CVE-' || event_id AS id, lane FROM (SELECT * FROM s UNION ALL SELECT * FROM f)""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    number = F.substr("id", F.lit(5)).cast("bigint")
    queue = work_queue(t).withColumn("priority", F.when(number % 2000 == 0, 0).otherwise(1))
    return budgets.two_lane_queue(queue, 40, QUEUE_AT).select("id", "lane")


_PAGE_SQL = """r AS (SELECT report_id, id, strlen(path) + line * 20 AS size, row_number() OVER (PARTITION BY report_id ORDER BY id) - 1 AS position, count(*) OVER (PARTITION BY report_id) AS total FROM findings),
   c AS (SELECT * FROM r WHERE position >= 3 AND position < 13),
   h AS (SELECT *, min(CASE WHEN size <= 1500 THEN position END) OVER (PARTITION BY report_id) AS head FROM c),
   s AS (SELECT *, CASE WHEN head IS NULL OR position < head THEN 'oversized' WHEN sum(CASE WHEN position >= head THEN size ELSE 0 END) OVER (PARTITION BY report_id ORDER BY position) <= 1500 THEN 'shown' ELSE 'later' END AS page_state FROM h)"""


def paged_rows(t: Tables) -> DataFrame:
    return t.findings.select("report_id", "id", (F.length("path") + F.col("line") * 20).alias("size"))


@query("win_10_byte_budget_page", f"WITH {_PAGE_SQL} SELECT report_id, CAST(position AS INTEGER) AS position, page_state FROM s", ("findings",))
def _(t: Tables) -> DataFrame:
    return budgets.page(paged_rows(t), ["report_id"], ["id"], "size", 1500, limit=10, cursor=3).select("report_id", "position", "page_state")


@query(
    "win_10_next_cursors",
    f"""WITH {_PAGE_SQL}, e AS (SELECT report_id, max(position) + 1 AS e, count(*) FILTER (WHERE page_state = 'shown') AS shown, count(*) FILTER (WHERE page_state = 'oversized') AS oversized FROM s WHERE page_state <> 'later' GROUP BY report_id)
        SELECT report_id, CASE WHEN coalesce(e.e, 3) < t.total THEN CAST(coalesce(e.e, 3) AS INTEGER) ELSE -1 END AS next_cursor, coalesce(shown, 0) AS shown, coalesce(oversized, 0) AS oversized
        FROM (SELECT DISTINCT report_id, total FROM r) t LEFT JOIN e USING (report_id)""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    paged = budgets.page(paged_rows(t), ["report_id"], ["id"], "size", 1500, limit=10, cursor=3)
    totals = t.findings.groupBy("report_id").agg(F.count(F.lit(1)).alias("total"))
    return budgets.next_cursors(paged, totals, ["report_id"], cursor=3).drop("total")


_INTERLEAVE_SQL = """WITH RECURSIVE l AS (SELECT report_id, rule_id, id, line * 10 AS size, row_number() OVER (PARTITION BY report_id, rule_id ORDER BY id) AS turn FROM findings),
   o AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY turn, rule_id) AS p FROM l),
   walk AS (SELECT report_id, p, CASE WHEN size <= 4000 THEN size ELSE 0 END AS used, size <= 4000 AS ok FROM o WHERE p = 1
     UNION ALL SELECT o.report_id, o.p, w.used + CASE WHEN w.used + o.size <= 4000 THEN o.size ELSE 0 END, w.used + o.size <= 4000 FROM walk w JOIN o ON o.report_id = w.report_id AND o.p = w.p + 1)"""


@query(
    "win_11_fair_interleave",
    f"{_INTERLEAVE_SQL} SELECT o.report_id, o.rule_id, count(*) FILTER (WHERE w.ok) AS shown, count(*) FILTER (WHERE NOT w.ok) AS omitted FROM walk w JOIN o ON o.report_id = w.report_id AND o.p = w.p GROUP BY ALL",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    rows = t.findings.select("report_id", "rule_id", "id", (F.col("line") * 10).alias("size"))
    out = budgets.interleave(rows, ["report_id"], "rule_id", ["id"], "size", 4000)
    return budgets.omitted_counts(out, ["report_id"], "rule_id")
