"""Call-site rules and flow families over supplied call sites, edges and facts.

``call_sites``: app_id, node, path, line, cls, method, receiver, target, args ARRAY<STRING> (constant arguments, null
where unknown), flags BIGINT. ``edges``: app_id, src, dst. ``facts``: app_id, node, kind (what a node holds: input,
literal, nested-intent, archive-entry ...). ``guards``: app_id, node, kind.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.graph import MAX_CALL_DEPTH, flow_walk
from sightline.scale import bounded_rows

# Sink methods, launchers, cipher and digest names, flag bits.
SQL_METHODS = ("rawQuery", "execSQL", "rawQueryWithFactory", "compileStatement", "delete", "update", "query", "appendWhere")
WEBVIEW_LOADS = (
    "loadUrl",
    "loadData",
    "loadDataWithBaseURL",
    "evaluateJavascript",
    "evaluateJavaScript",
    "load",
    "loadHTMLString",
)
KEY_SINKS = ("SecretKeySpec", "DESKeySpec", "DESedeKeySpec", "PBEKeySpec", "SymmetricKey", "PrivateKey", "SecKeyCreateWithData")
IV_SINKS = ("IvParameterSpec", "GCMParameterSpec", "Nonce")
IMPLICIT_LAUNCHERS = (
    "startActivity",
    "startActivityForResult",
    "startActivityIfNeeded",
    "sendBroadcast",
    "sendOrderedBroadcast",
    "sendStickyBroadcast",
)
INTENT_LAUNCHERS = (
    "startActivity",
    "startActivityForResult",
    "startActivityIfNeeded",
    "startService",
    "startForegroundService",
    "bindService",
    "sendBroadcast",
    "sendOrderedBroadcast",
    "sendStickyBroadcast",
)
FILE_SINKS = ("File", "FileOutputStream", "FileInputStream", "FileWriter", "FileReader", "RandomAccessFile")
BROKEN_CIPHERS = ("DES", "DESEDE", "TRIPLEDES", "3DES", "RC4", "ARCFOUR", "RC2", "BLOWFISH")
WEAK_DIGESTS = ("MD5", "SHA1", "SHA-1")
IMMUTABLE_FLAG = 0x04000000
MUTABLE_FLAG = 0x02000000
PENDING_FACTORIES = ("getActivity", "getActivities", "getBroadcast", "getService", "getForegroundService")
NATIVE_BRIDGES = ("invokeMethod", "callHandler", "postMessage")
SENSITIVE_KEY = (
    r"(?i)(?:^|[_\s.-])(?:access[_-]?token|refresh[_-]?token|token|password|secret|authorization|session)(?:$|[_\s.-])"
)
CRYPTO_CLASSES = ("javax.crypto.Cipher", "java.security.MessageDigest")
WEBVIEW_APIS = (
    ("android.webkit.WebSettings", "setJavaScriptEnabled"),
    ("android.webkit.WebSettings", "setAllowFileAccess"),
    ("android.webkit.WebSettings", "setAllowUniversalAccessFromFileURLs"),
    ("android.webkit.WebSettings", "setSavePassword"),
    ("android.webkit.WebView", "addJavascriptInterface"),
)
DYNAMIC_APIS = (
    ("dalvik.system.DexClassLoader", "<init>"),
    ("dalvik.system.InMemoryDexClassLoader", "<init>"),
    ("java.lang.Runtime", "exec"),
    ("java.lang.System", "load"),
    ("java.lang.System", "loadLibrary"),
    ("java.lang.reflect.Method", "invoke"),
)
SPEC_SINKS = {"webview-load": "AST-WEBVIEW-UNTRUSTED-URL", "sql": "AST-SQL-CONCAT"}


@dataclass(frozen=True)
class FlowFamily:
    """Facts of some kinds that reach the methods of a sink, unless a guard of some kinds lies between."""

    rule_id: str
    severity: str
    kinds: tuple[str, ...]
    methods: tuple[str, ...]
    guards: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()


# Flow rules.
FAMILIES = (
    FlowFamily("AST-WEBVIEW-UNTRUSTED-URL", "high", ("input",), WEBVIEW_LOADS, ("url-guard", "weak-url-guard")),
    FlowFamily("AST-SQL-CONCAT", "high", ("input",), SQL_METHODS, ("bound-parameter",)),
    FlowFamily("AST-CRYPTO-HARDCODED-KEY", "high", ("literal",), KEY_SINKS),
    FlowFamily("AST-CRYPTO-STATIC-IV", "medium", ("literal",), IV_SINKS),
    FlowFamily("AST-INTENT-REDIRECTION", "high", ("nested-intent",), INTENT_LAUNCHERS, ("target-check",)),
    FlowFamily("AST-PATH-TRAVERSAL", "high", ("input", "archive-entry"), FILE_SINKS, ("canonical-path", "basename")),
    FlowFamily("OBJC-WEBVIEW-UNTRUSTED-REQUEST", "high", ("input",), ("loadRequest",), ("url-guard",)),
    FlowFamily("HYBRID-UNTRUSTED-URL", "high", ("input",), ("loadUrl", "loadRequest", "loadURL"), ("url-guard",), ("hybrid",)),
    FlowFamily("HYBRID-JS-EVAL", "high", ("input",), ("eval", "injectJavaScript", "evaluateJavascript", "evaluateJavaScript"), (), ("hybrid",)),
    FlowFamily("HYBRID-SQL-INPUT", "high", ("input",), ("executeSql", "rawQuery", "rawInsert", "rawUpdate", "rawDelete", "execute"), ("bound-parameter",), ("hybrid",)),
    FlowFamily("HYBRID-NATIVE-BRIDGE", "medium", ("input",), NATIVE_BRIDGES, (), ("hybrid",)),
)


def family(rule_id: str) -> FlowFamily:
    return next(f for f in FAMILIES if f.rule_id == rule_id)


FAMILIES_A_WALK = 60  # bits of a mask


def _kind_masks(table: DataFrame, kinds: dict[str, int]) -> DataFrame:
    """``table`` (kind) with the mask of the families that name its kind; rows of no family are left out."""
    mask = F.lit(0).cast("bigint")
    for kind, value in kinds.items():
        mask = F.when(F.col("kind") == kind, F.lit(value).cast("bigint")).otherwise(mask)
    return table.withColumn("mask", mask).where("mask <> 0")


def all_flow_findings(
    rules: Sequence[FlowFamily], call_sites: DataFrame, edges: DataFrame, facts: DataFrame, guards: DataFrame | None = None,
    depth: int = MAX_CALL_DEPTH,
) -> tuple[DataFrame, DataFrame]:
    """(findings, cuts) of many families in one walk: app_id, rule_id, severity, origin, sink, steps, path of a shortest
    path for each finding, and app_id, rule_id, origin, node where the depth ended a traversal.

    Families of one rule (as user specifications may give) count as one finding a place. Beyond 60 families a further
    walk is made.
    """
    parts = []
    for first in range(0, len(rules), FAMILIES_A_WALK):
        chosen = rules[first : first + FAMILIES_A_WALK]
        bits = {r: 1 << k for k, r in enumerate(chosen)}
        kinds = {k: sum(b for r, b in bits.items() if k in r.kinds) for k in sorted({k for r in chosen for k in r.kinds})}
        stopping = {k: sum(b for r, b in bits.items() if k in r.guards) for k in sorted({k for r in chosen for k in r.guards})}
        aim = F.lit(0).cast("bigint")
        for rule, bit in bits.items():
            at = F.col("method").isin(*rule.methods)
            at = at & F.col("cls").isin(*rule.classes) if rule.classes else at
            aim = aim.bitwiseOR(F.when(F.coalesce(at, F.lit(False)), F.lit(bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        sinks = call_sites.select("app_id", "node", aim.alias("mask")).where("mask <> 0")
        starts = _kind_masks(facts, kinds).select("app_id", "node", F.col("node").alias("origin"), "mask")
        stops = _kind_masks(guards, stopping).select("app_id", "node", "mask") if guards is not None and stopping else None
        names = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity")) for r in chosen])
        walked = [w.withColumn("__rule", F.get(names, F.col("family"))) for w in flow_walk(edges, starts, sinks, ["app_id"], depth, stops)]
        parts.append([w.select("app_id", "__rule.*", *[c for c in w.columns if c not in ("app_id", "family", "__rule")]) for w in walked])
    found, cuts = (reduce(DataFrame.unionByName, side) for side in zip(*parts))
    if len({r.rule_id for r in rules}) < len(rules):
        place = ["app_id", "rule_id", "severity", "origin", "sink"]
        found = found.groupBy(*place).agg(F.min(F.struct("steps", "path")).alias("r")).select(*place, "r.*")
    return found, cuts.drop("severity").distinct()


def flow_findings(
    rule: FlowFamily, call_sites: DataFrame, edges: DataFrame, facts: DataFrame, guards: DataFrame | None = None,
    depth: int = MAX_CALL_DEPTH,
) -> tuple[DataFrame, DataFrame]:
    """(findings, cuts) of one family; each finding keeps its shortest path, cuts are traversals ended by the depth."""
    return all_flow_findings([rule], call_sites, edges, facts, guards, depth)


def weak_guard_findings(call_sites: DataFrame, edges: DataFrame, facts: DataFrame, guards: DataFrame) -> DataFrame:
    """Loads that input reaches only past a partial host test: open to weak guards, closed to none; one walk for both."""
    base = family("AST-WEBVIEW-UNTRUSTED-URL")
    sound = FlowFamily("AST-WEBVIEW-HOST-ALLOWLIST", "high", base.kinds, base.methods, ("url-guard",))
    found, _ = all_flow_findings([sound, base], call_sites, edges, facts, guards)
    past_weak, unguarded = (found.where(F.col("rule_id") == r.rule_id) for r in (sound, base))
    pair = ["app_id", "origin", "sink"]
    return past_weak.join(unguarded.select(*pair), pair, "left_anti")


def user_specification(table: DataFrame) -> tuple[DataFrame, list[FlowFamily]]:
    """Validated user sources and sinks (id, role, method, receiver, kind) as (source selectors, families)."""
    rows = bounded_rows(table, "source and sink specification", 200)
    seen: set[str] = set()
    sinks = []
    for row in rows:
        if not row["id"] or row["id"] in seen:
            raise ValueError(f"duplicate or missing specification id {row['id']!r}")
        seen.add(row["id"])
        if row["role"] not in ("source", "sink") or not row["method"]:
            raise ValueError(f"specification {row['id']} needs a role and a method")
        if row["role"] == "sink":
            if row["kind"] not in SPEC_SINKS:
                raise ValueError(f"specification {row['id']}: unknown sink kind {row['kind']!r}")
            sinks.append(FlowFamily(SPEC_SINKS[row["kind"]], "high", ("input",), (row["method"],)))
    if not rows:
        raise ValueError("a specification declares at least one source or sink")
    return table.where("role = 'source'").select("method", F.coalesce("receiver", F.lit("")).alias("spec_receiver")), sinks


def specified_facts(call_sites: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts at the calls of user-declared sources (method, and receiver where one is named)."""
    hits = call_sites.join(sources, "method").where((F.col("spec_receiver") == "") | (F.col("spec_receiver") == F.col("receiver")))
    return hits.select("app_id", "node", F.lit("input").alias("kind")).distinct()


def _argument(index: int) -> Column:
    return F.coalesce(F.get("args", F.lit(index)), F.lit(""))


def _algorithm() -> Column:
    return F.upper(F.split_part(_argument(0), F.lit("/"), F.lit(1)))


def simple_rules() -> dict[str, tuple[str, Column]]:
    """Rule id to (severity, condition on one call site)."""
    method, cls = F.col("method"), F.col("cls")
    cipher = cls.isin("javax.crypto.Cipher", "Cipher") & (method == "getInstance")
    digest = cls.isin("java.security.MessageDigest", "MessageDigest") & (method == "getInstance")
    transformation = F.upper(_argument(0))
    flags = F.coalesce("flags", F.lit(0))
    immutable = flags.bitwiseAND(F.lit(IMMUTABLE_FLAG)) != 0
    log = cls.isin("android.util.Log", "Log") & method.isin("d", "i", "v", "e", "w", "wtf")
    sensitive_argument = F.exists(F.coalesce("args", F.array().cast("array<string>")), lambda a: F.coalesce(a.rlike(SENSITIVE_KEY), F.lit(False)))
    enabled = F.lower(_argument(0)).isin("true", "1")
    return {
        "AST-WEBVIEW-SSL-BYPASS": ("high", cls.isin("android.webkit.SslErrorHandler", "SslErrorHandler") & (method == "proceed")),
        "AST-CRYPTO-ECB": ("high", cipher & transformation.rlike(r"^AES(?:/ECB(?:/.*)?)?$")),
        "AST-CRYPTO-WEAK-HASH": ("medium", digest & transformation.isin(*WEAK_DIGESTS)),
        "OBJC-CRYPTO-WEAK-HASH": ("medium", method.isin("CC_MD5", "CC_SHA1", "CC_MD5_Init", "CC_SHA1_Init")),
        "AST-PENDINGINTENT-MUTABLE": (
            "medium",
            method.isin(*PENDING_FACTORIES) & cls.isin("android.app.PendingIntent", "PendingIntent") & F.col("flags").isNotNull()
            & ~immutable & F.col("target").isNull(),
        ),
        "AST-CRYPTO-WEAK-CIPHER": ("high", cipher & _algorithm().isin(*BROKEN_CIPHERS)),
        "AST-IMPLICIT-INTENT": ("medium", method.isin(*IMPLICIT_LAUNCHERS) & F.col("target").isNull() & (_argument(0) != "")),
        "BINARY-WEBVIEW-SSL-BYPASS": ("high", (cls == "android.webkit.SslErrorHandler") & (method == "proceed")),
        "BINARY-WEBVIEW-JS-BRIDGE": ("medium", (cls == "android.webkit.WebView") & (method == "addJavascriptInterface")),
        "BINARY-WEBVIEW-FILE-ACCESS": (
            "high",
            (cls == "android.webkit.WebSettings")
            & method.isin("setAllowFileAccessFromFileURLs", "setAllowUniversalAccessFromFileURLs") & enabled,
        ),
        "BINARY-WEBVIEW-DEBUGGING": ("medium", (cls == "android.webkit.WebView") & (method == "setWebContentsDebuggingEnabled") & enabled),
        "BINARY-STORAGE-TOKEN-PREFS": (
            "medium", (cls == "android.content.SharedPreferences$Editor") & (method == "putString") & _argument(0).rlike(SENSITIVE_KEY)
        ),
        "BINARY-STORAGE-SENSITIVE-LOG": ("high", log & sensitive_argument),
    }


def call_findings(call_sites: DataFrame, rule_ids: tuple[str, ...] | None = None) -> DataFrame:
    """One row per call site and rule it satisfies: one narrow pass, no join."""
    rules = simple_rules()
    wanted = rules if rule_ids is None else {r: rules[r] for r in rule_ids}
    hits = [
        F.when(condition, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity")))
        for rule, (severity, condition) in wanted.items()
    ]
    return call_sites.select("app_id", "node", "path", "line", F.explode(F.array_compact(F.array(*hits))).alias("r")).select(
        "app_id", "node", "path", "line", "r.rule_id", "r.severity"
    )


def bridged_untrusted_views(call_sites: DataFrame, loads: DataFrame) -> DataFrame:
    """Native bridges on receivers that also load untrusted content.

    ``loads``: findings of the load family (app_id, sink node). Receivers are reduced to the ones with such a load first.
    """
    loaded = call_sites.join(loads.select("app_id", F.col("sink").alias("node")).distinct(), ["app_id", "node"], "left_semi").select(
        "app_id", "path", "receiver"
    ).distinct()
    bridges = call_sites.where("method = 'addJavascriptInterface'")
    return bridges.join(loaded, ["app_id", "path", "receiver"], "left_semi").select(
        "app_id", "node", "path", "line", "receiver", F.lit("AST-WEBVIEW-JS-BRIDGE").alias("rule_id")
    )


def indicator_counts(call_sites: DataFrame) -> DataFrame:
    """Crypto, WebView and dynamic-code calls per app with counts."""
    pair = F.concat_ws("#", "cls", "method")
    named = lambda apis: pair.isin(*[f"{c}#{m}" for c, m in apis])
    value = F.trim(_argument(0))
    weak = value.isin("MD5", "SHA1", "SHA-1", "DES", "DESede", "RC4") | value.rlike("DES/|/DES|RC4|ECB|MD5|SHA1|SHA-1")
    group = (
        F.when(F.col("cls").isin(*CRYPTO_CLASSES) & (F.col("method") == "getInstance") & weak, "weak-crypto")
        .when(named(WEBVIEW_APIS), "webview").when(named(DYNAMIC_APIS), "dynamic-code")
    )
    label = F.when(group == "weak-crypto", value).otherwise(pair)
    return (
        call_sites.withColumn("group", group).where("group IS NOT NULL").groupBy("app_id", "group", label.alias("indicator"))
        .agg(F.count(F.lit(1)).alias("calls"))
    )
