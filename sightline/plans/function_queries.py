"""Function queries: each column function over a whole table, against plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import canonical, packages, paths, ranks, versions
from sightline.functions import text as txt
from sightline.functions.spans import clean_mark, matches_with_offsets
from sightline.plans.detect_queries import SNIPPET_LINE, code_sources
from sightline.plans.posture_queries import pick
from sightline.plans.registry import query
from sightline.plans.tables import Tables, joined, text


@query(
    "fn_01_canonical_json",
    """SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || p_name || '"' || CASE WHEN p_size % 3 = 0 THEN ',"size":' || p_size ELSE '' END || '}' AS body FROM part""",
)
def _(t: Tables) -> DataFrame:
    size = F.when(F.col("p_size") % 3 == 0, F.col("p_size"))
    return t.part.select("p_partkey", canonical.canonical_json(size=size, name=F.col("p_name"), brand=F.col("p_brand")).alias("body"))


@query("fn_02_text_digest", "SELECT doc_id, sha256(text) AS sha FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", canonical.digest(F.col("text")).alias("sha"))


@query(
    "fn_03_finding_identity",
    """SELECT event_id, 'F-' || substr(sha256('["R-' || event_type || '","' || CASE WHEN k % 2 = 0 THEN 'environment' ELSE 'app' END || '",[{"dependency":{"ecosystem":"npm","name":"n' || user_id || '","path":""},' ||
        CASE WHEN k % 3 = 0 THEN '"line":' || k || ',' ELSE '' END || '"path":"a \\"b\\"/' || user_id || '"}]]'), 1, 20) AS id FROM events_k""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    k = F.col("k")
    dep = F.struct(F.lit("npm").alias("ecosystem"), joined("n", text(F.col("user_id"))).alias("name"), F.lit(None).cast("string").alias("path"))
    row = F.struct(joined('a "b"/', text(F.col("user_id"))).alias("path"), F.when(k % 3 == 0, k).alias("line"), dep.alias("dependency"), F.lit("ignored").alias("excerpt"))
    scope = F.when(k % 2 == 0, "environment")
    identity = canonical.finding_identity(joined("R-", F.col("event_type")), F.array(row), ("path", "line", "dependency"), scope)
    return t.events_k.select("event_id", identity.alias("id"))


@query(
    "fn_04_ranks",
    """SELECT event_id, CASE WHEN value >= 100 THEN 4 WHEN value >= 50 THEN 3 WHEN value >= 20 THEN 2 WHEN value >= 5 THEN 1 ELSE 0 END AS severity, k % 4 AS status, k % 3 AS confidence FROM events_k""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    k = F.col("k")
    severity = F.when(F.col("value") >= 100, "critical").when(F.col("value") >= 50, "high").when(F.col("value") >= 20, "medium").when(F.col("value") >= 5, "low").otherwise("odd")
    return t.events_k.select(
        "event_id", ranks.severity_rank(severity).alias("severity"), ranks.status_rank(pick(ranks.STATUSES, k % 4)).alias("status"), ranks.confidence_rank(pick(ranks.CONFIDENCES, k % 3)).alias("confidence")
    )


@query(
    "fn_05_redaction",
    """SELECT doc_id, text || ' Authorization: Bearer [REDACTED] password=[REDACTED] ok [REDACTED] end' AS body FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'),
         '(?i)((?:api[_-]?key|password|secret|access[_-]?token|refresh[_-]?token)[ \\t\\n\\r]*[=:][ \\t\\n\\r]*)[^ \\t\\n\\r,;]+', '\\1[REDACTED]', 'g') AS text FROM documents)""",
)
def _(t: Tables) -> DataFrame:
    key = F.concat(F.lit(" Authorization: Bearer abc."), text(F.col("doc_id")), F.lit(" password=x"), text(F.col("doc_id")), F.lit(" ok "), F.lit("sk-"), F.lit("a" * 12), F.lit("\x07 end"))
    return t.documents.select("doc_id", txt.redact(F.concat("text", key)).alias("body"))


@query(
    "fn_06_code_excerpt",
    """SELECT p_partkey, 'call("…", "…", ' || p_partkey || ')' AS excerpt FROM part""",
)
def _(t: Tables) -> DataFrame:
    line = F.concat(F.lit('call("'), "p_name", F.lit('", \'it\\\'s "'), "p_brand", F.lit("\"', "), text(F.col("p_partkey")), F.lit(")"))
    return t.part.select("p_partkey", txt.code_excerpt(line).alias("excerpt"))


@query(
    "fn_07_comment_blanking",
    """SELECT doc_id, length(text) + 1 + 33 AS chars, CASE doc_id % 3 WHEN 0 THEN 'val u = "http://x" ' || repeat(' ', 14) WHEN 1 THEN 'val a = 1 ' || repeat(' ', 11) || ' val b = 22 ' ELSE 'val c = `${d ' || repeat(' ', 7) || '}`' || repeat(' ', 11) END AS tail
       FROM documents""",
)
def _(t: Tables) -> DataFrame:
    lines = (
        'val u = "http://x" // "comment"  ',
        "val a = 1 /* one \" */ val b = 22  ",
        "val c = `${d /* x */}` // kept     ",
    )
    doc = F.col("doc_id") % 3
    code = F.when(doc == 0, lines[0]).when(doc == 1, lines[1]).otherwise(lines[2])
    rows = t.documents.select(
        "doc_id", F.concat("text", F.lit("\n"), F.rpad(code, 33, " ")).alias("text"), F.when(doc == 2, ".js").otherwise(".kt").alias("suffix")
    )
    out = txt.without_comments(F.col("text"), F.col("suffix"))
    return rows.select("doc_id", F.length(out).cast("bigint").alias("chars"), F.right(out, F.lit(33)).alias("tail"))


@query(
    "fn_08_xml_comment_blanking",
    """SELECT page_id, length(html) + 28 AS chars, '<a/>' || repeat(' ', 16) || chr(10) || repeat(' ', 7) AS head FROM pages""",
)
def _(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.concat(F.lit("<a/><!-- <b secret> \nmore-->"), "html").alias("text"), F.lit(".xml").alias("suffix"))
    out = txt.without_comments(F.col("text"), F.col("suffix"))
    return rows.select("page_id", F.length(out).cast("bigint").alias("chars"), F.substr(out, F.lit(1), F.lit(28)).alias("head"))


@query("fn_09_line_of_offset", "SELECT doc_id, length(substr(text, 1, length(text) // 2)) - length(replace(substr(text, 1, length(text) // 2), chr(10), '')) + 1 AS line FROM documents")
def _(t: Tables) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    return t.documents.select("doc_id", txt.line_of(F.col("text"), half).cast("bigint").alias("line"))


@query("fn_10_byte_offset", "SELECT doc_id, strlen(substr(text, 1, length(text) // 3)) AS bytes FROM documents")
def _(t: Tables) -> DataFrame:
    third = F.floor(F.length("text") / 3).cast("int")
    return t.documents.select("doc_id", txt.byte_offset(F.col("text"), third).cast("bigint").alias("bytes"))


@query("fn_11_path_suffix", "SELECT app_id, suffix, count(*) AS files FROM documents_src GROUP BY ALL", ("documents_src",))
def _(t: Tables) -> DataFrame:
    rows = t.documents_src.select("app_id", paths.path_suffix(F.col("path")).alias("suffix"))
    return rows.groupBy("app_id", "suffix").agg(F.count(F.lit(1)).alias("files"))


_LAYOUTS = ("app/src/main/F.kt", "android/core/lib/F.kt", "Sources/Net/deep/F.swift", "F.kt", "libs/ui/F.kt", "a/b/src/src/F.kt")
_MODULES = ("app", "android/core", "Sources/Net", ".", "libs", "a/b")


@query("fn_12_source_module", f"SELECT doc_id, {list(_MODULES)!r}[1 + doc_id % 6] AS module FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", paths.source_module(pick(_LAYOUTS, F.col("doc_id") % 6)).alias("module"))


_RAW = ("./a//b/F k.kt", "a\\b\\c.kt", "/abs/x", "C:/x", "a/../b", "ok/é%.kt")
_URIS = ("a/b/F%20k.kt", "a/b/c.kt", "", "", "", "ok/%C3%A9%25.kt")


@query("fn_13_relative_uri", f"SELECT doc_id, {list(_URIS)!r}[1 + doc_id % 6] AS uri FROM documents")
def _(t: Tables) -> DataFrame:
    raw = pick(_RAW, F.col("doc_id") % 6)
    return t.documents.select("doc_id", F.coalesce(paths.uri_path(paths.relative_path(raw)), F.lit("")).alias("uri"))


_PURLS = (
    ("Maven", "org.a:lib", "pkg:maven/org.a/lib@"), ("npm", "@s/p", "pkg:npm/%40s/p@"), ("PyPI", "Some_pkg", "pkg:pypi/Some_pkg@"), ("Go", "github.com/o/m", "pkg:golang/github.com/o/m@"),
    ("SwiftURL", "https://github.com/O/R.git", "pkg:swift/github.com/O/R@"), ("CocoaPods", "Pod", "pkg:cocoapods/Pod@"), ("Odd", "x", ""),
)


@query("fn_14_package_urls", f"SELECT p_partkey, CASE WHEN p_partkey % 7 = 6 THEN '' ELSE {[p for _, _, p in _PURLS]!r}[1 + p_partkey % 7] || p_size || '.0%2Bb' END AS purl FROM part")
def _(t: Tables) -> DataFrame:
    index = F.col("p_partkey") % 7
    url = packages.package_url(pick([e for e, _, _ in _PURLS], index), pick([n for _, n, _ in _PURLS], index), joined(text(F.col("p_size")), ".0+b"))
    return t.part.select("p_partkey", F.coalesce(url, F.lit("")).alias("purl"))


_SWIFT = ("https://GitHub.com/O/R.git", "github.com/O/R/", "http://github.com/O/R", "https://u@github.com/O/R", "https://github.com/O/R?x=1", "https://github.com/O")
_SWIFT_NAMES = ("github.com/O/R", "github.com/O/R", "", "", "", "")


@query("fn_15_advisory_package_names", f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE {list(_SWIFT_NAMES)!r}[1 + p_partkey % 6] END AS name FROM part")
def _(t: Tables) -> DataFrame:
    swift = F.col("p_partkey") % 2 == 1
    name = packages.advisory_package_name(F.when(swift, "SwiftURL").otherwise("npm"), F.when(swift, pick(_SWIFT, F.col("p_partkey") % 6)).otherwise(F.col("p_name")))
    return t.part.select("p_partkey", F.coalesce(name, F.lit("")).alias("name"))


@query(
    "fn_16_numeric_versions",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '17.' || p_size || '.0.0' WHEN 1 THEN '17.' || p_size || '.1.0' ELSE '' END AS parts FROM part""",
)
def _(t: Tables) -> DataFrame:
    size = text(F.col("p_size"))
    raw = F.when(F.col("p_partkey") % 4 == 0, joined("17.", size)).when(F.col("p_partkey") % 4 == 1, joined("17.", size, ".1")).when(F.col("p_partkey") % 4 == 2, joined("017.", size)).otherwise("17")
    parts = F.transform(versions.numeric_version(raw), lambda p: p.cast("string"))
    return t.part.select("p_partkey", F.coalesce(F.array_join(parts, "."), F.lit("")).alias("parts"))


@query(
    "fn_17_patch_dates",
    """SELECT p_partkey, coalesce(strftime(TRY_CAST('2024-' || lpad(CAST(p_size % 15 AS VARCHAR), 2, '0') || '-' || lpad(CAST(p_partkey % 33 AS VARCHAR), 2, '0') AS DATE), '%Y-%m-%d'), '') AS day FROM part""",
)
def _(t: Tables) -> DataFrame:
    raw = joined("2024-", F.lpad(text(F.col("p_size") % 15), 2, "0"), "-", F.lpad(text(F.col("p_partkey") % 33), 2, "0"))
    return t.part.select("p_partkey", F.coalesce(F.date_format(versions.patch_date(raw), "yyyy-MM-dd"), F.lit("")).alias("day"))


@query(
    "fn_18_zoned_timestamps",
    """SELECT event_id, CASE k % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') ELSE '' END AS zoned, CASE WHEN k % 4 = 3 THEN '' WHEN k % 4 = 1 THEN strftime(ts - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created FROM events_k""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("k") % 4 == 0, F.concat(base, F.lit("Z"))).when(F.col("k") % 4 == 1, F.concat(base, F.lit("+09:00"))).when(F.col("k") % 4 == 2, base).otherwise("soon")
    show = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return t.events_k.select("event_id", show(versions.zoned_timestamp(raw)).alias("zoned"), show(versions.created_timestamp(raw)).alias("created"))


@query(
    "fn_20_branch_keys",
    """SELECT partkey, CASE WHEN partkey % 3 = 0 THEN '' ELSE substr(sha256('{"component":"' || brand || '","fixed_patch_level":"","fixed_release":"iOS ' || size || '","platform":"ios","references":["' || reference || '"],"source":"apple","updated_aosp_versions":""}'), 1, 24) END AS branch FROM advisories""",
    ("advisories",),
)
def _(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    key = canonical.branch_key(
        F.when(F.col("partkey") % 3 == 0, "cve").otherwise("apple"), F.lit("ios"), F.col("brand"), joined("iOS ", text(F.col("size"))), none, none, F.array("reference", F.lit("z"))
    )
    return t.advisories.select("partkey", key.alias("branch"))


@query(
    "fn_21_export_levels",
    """SELECT event_id, CASE WHEN value >= 50 THEN CASE WHEN k % 4 = 0 THEN 'warning' ELSE 'error' END WHEN value >= 20 THEN 'warning' ELSE 'note' END AS level, CASE WHEN value >= 100 THEN '9.5' WHEN value >= 50 THEN '8.0' WHEN value >= 20 THEN '5.5' WHEN value >= 5 THEN '3.0' ELSE '' END AS score,
        ['medium', 'high', 'high', 'very-high'][1 + k % 4] AS "precision" FROM events_k""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    from sightline.plans.tables import bands

    severity, status = bands(F.col("value")), pick(ranks.STATUSES, F.col("k") % 4)
    return t.events_k.select(
        "event_id", ranks.result_level(severity, status).alias("level"), F.coalesce(ranks.security_score(severity), F.lit("")).alias("score"), ranks.precision(status).alias("precision")
    )


@query(
    "fn_22_imported_severity",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size <= 20 THEN CASE WHEN p_size >= 18 THEN 'critical' WHEN p_size >= 14 THEN 'high' WHEN p_size >= 8 THEN 'medium' ELSE 'low' END WHEN p_partkey % 2 = 0 THEN 'medium' ELSE 'low' END AS severity FROM part""",
)
def _(t: Tables) -> DataFrame:
    score = F.when(F.col("p_partkey") % 3 == 0, text(F.col("p_size") / 2)).when(F.col("p_partkey") % 3 == 1, "NaN")
    level = F.when(F.col("p_partkey") % 2 == 0, "error").otherwise("")
    return t.part.select("p_partkey", ranks.imported_severity(score, level, F.lit("warning")).alias("severity"))


@query("fn_23_cwe_tags", "SELECT p_partkey, concat_ws(',', 'CWE-' || p_size, CASE WHEN p_size <> 79 THEN 'CWE-79' END) AS cwe FROM part")
def _(t: Tables) -> DataFrame:
    tags = F.array(joined("external/cwe/cwe-00", text(F.col("p_size"))), F.lit("CWE79"), F.lit("security"), F.lit("cwe/079"))
    ordered = F.array_sort(txt.cwe_ids(tags), lambda a, b: F.substr(a, F.lit(5)).cast("int") - F.substr(b, F.lit(5)).cast("int"))
    return t.part.select("p_partkey", F.array_join(ordered, ",").alias("cwe"))


@query("fn_24_slugs", "SELECT p_partkey, left('Brand-' || replace(p_name, ' ', '-') || '-' || p_partkey, 20) AS slug FROM part")
def _(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("  /Brand !"), "p_name", F.lit(" * "), text(F.col("p_partkey")), F.lit(" !"))
    return t.part.select("p_partkey", txt.slug(raw, 20).alias("slug"))


@query("fn_25_safe_locations", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'src/F' || p_partkey || '.kt' END AS path, CASE WHEN p_partkey % 3 = 0 OR p_size % 2 = 0 THEN 0 ELSE p_size END AS line FROM part")
def _(t: Tables) -> DataFrame:
    place = lambda uri, line: F.struct(uri.alias("uri"), line.cast("int").alias("line"))
    size = F.when(F.col("p_size") % 2 == 0, -1).otherwise(F.col("p_size"))
    own = F.when(F.col("p_partkey") % 3 == 0, F.lit("https://x/y")).otherwise(joined("app/src/F", text(F.col("p_partkey")), ".kt"))
    got = paths.safe_location(F.array(place(F.lit("/abs"), F.lit(1)), place(F.lit("../up"), F.lit(2)), place(own, size)), "app")
    return t.part.select("p_partkey", F.coalesce(got["path"], F.lit("")).alias("path"), F.coalesce(got["line"], F.lit(0)).alias("line"))


@query(
    "fn_26_record_addresses",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'https://raw.githubusercontent.com/CVEProject/cvelistV5/main/cves/2024/' || ((p_partkey + 10000) // 1000) || 'xxx/CVE-2024-' || (p_partkey + 10000) || '.json' END AS url FROM part""",
)
def _(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 4 == 0, "GHSA-1").otherwise(joined("CVE-2024-", text(F.col("p_partkey") + 10000)))
    return t.part.select("p_partkey", F.coalesce(packages.cve_url(name), F.lit("")).alias("url"))


@query("fn_27_retry_delays", "SELECT p_partkey, least(86400, greatest(60 * CAST(pow(2, least(p_size - 1, 11)) AS BIGINT), CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 100 ELSE 0 END)) AS seconds FROM part")
def _(t: Tables) -> DataFrame:
    after = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") * 100)
    return t.part.select("p_partkey", versions.retry_delay(F.col("p_size"), after).alias("seconds"))


@query(
    "fn_28_markdown_escaping",
    """SELECT p_partkey, '\\# a\\_b \\*' || p_name || '\\* &lt;i&gt; &amp; \\`x\\`' AS body, '```  a ``b' || p_partkey || ' ```' AS code, CASE WHEN p_partkey % 2 = 0 THEN '<https://e.example/"' || p_partkey || '">' ELSE 'https://e.example/' || p_partkey END AS reference FROM part""",
)
def _(t: Tables) -> DataFrame:
    body = F.concat(F.lit("# a_b *"), "p_name", F.lit("* <i> & `x`"))
    code = F.concat(F.lit(" a ``b"), text(F.col("p_partkey")))
    url = F.when(F.col("p_partkey") % 2 == 0, joined('https://e.example/"', text(F.col("p_partkey")), '"')).otherwise(joined("https://e.example/", text(F.col("p_partkey"))))
    return t.part.select("p_partkey", txt.markdown_text(body).alias("body"), txt.markdown_code(code).alias("code"), txt.markdown_reference(url).alias("reference"))


@query("fn_29_marker_scrubbing", "SELECT doc_id, text || ' [CANARY:long] and [CANARY:short].' AS body FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS text FROM documents)")
def _(t: Tables) -> DataFrame:
    markers = {"short": "zq7-canary", "long": "zq7-canary-account"}
    return t.documents.select("doc_id", txt.scrub(F.concat("text", F.lit(" zq7-canary-account and zq7-canary.")), markers).alias("body"))


@query(
    "fn_30_assertion_identity",
    """SELECT event_id, sha256('{"baseline":"b' || (k % 5) || '","expect":"' || CASE WHEN k % 2 = 0 THEN 'present' ELSE 'absent' END || '","finding_id":"","marker":"m","purpose":"residual","rule_id":"","snapshot":"","surface":"storage"}') AS identity FROM events_k""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    identity = canonical.assertion_identity(baseline=joined("b", text(F.col("k") % 5)), marker=F.lit("m"), expect=F.when(F.col("k") % 2 == 0, "present"))
    return t.events_k.select("event_id", identity.alias("identity"))


_NAMES = ("sessionToken", "HTTPServerKey", "user_id2", "MAX_LEN", "iv")
_WORDS = ("session,token", "http,server,key", "user,id,2", "max,len", "iv")


@query("fn_31_identifier_words", f"SELECT p_partkey, {list(_WORDS)!r}[1 + p_partkey % 5] AS words FROM part")
def _(t: Tables) -> DataFrame:
    # An upper-case run gives its last letter to the word it starts.
    return t.part.select("p_partkey", F.array_join(txt.identifier_words(pick(_NAMES, F.col("p_partkey") % 5)), ",").alias("words"))


@query("fn_32_project_and_alias_keys", "SELECT p_partkey, 'featurecore:lib' || p_partkey AS project, 'mylibcore' || p_partkey AS alias FROM part")
def _(t: Tables) -> DataFrame:
    parts = F.array(F.lit(""), F.lit("feature-Core"), joined("Lib", text(F.col("p_partkey"))))
    return t.part.select("p_partkey", paths.project_key(parts).alias("project"), paths.alias_key(joined("My-lib_Core.", text(F.col("p_partkey")))).alias("alias"))


_MANIFESTS = ("app/src/main/AndroidManifest.xml", "src/main/AndroidManifest.xml", "base/manifest/AndroidManifest.xml", "x/AndroidManifest.xml", "AndroidManifest.xml")
_ROOTS = ("app/", "", "base/", "x/", "")


@query("fn_33_module_roots", f"SELECT p_partkey, {list(_ROOTS)!r}[1 + p_partkey % 5] AS root FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", paths.module_root(pick(_MANIFESTS, F.col("p_partkey") % 5)).alias("root"))


@query(
    "fn_34_subject_keys",
    """SELECT p_partkey, sha256(CASE WHEN p_partkey % 2 = 0 THEN '[{"platform":"android","package":"a' || p_size || '"},{"platform":"ios","package":"a"}]' ELSE 'target:t' || p_size END || '|sel') AS subject FROM part""",
)
def _(t: Tables) -> DataFrame:
    app = lambda p, n: F.struct(F.lit(p).alias("platform"), n.alias("package"))
    size = text(F.col("p_size"))
    apps = F.when(F.col("p_partkey") % 2 == 0, F.array(app("ios", F.lit("a")), app("android", joined("a", size)), app("ios", F.lit("a")))).otherwise(F.array(app("ios", F.lit(""))))
    return t.part.select("p_partkey", canonical.subject_key(apps, joined("t", size), F.lit("sel")).alias("subject"))


@query("fn_35_path_agreement", "SELECT p_partkey, p_partkey % 3 <> 2 AS agrees FROM part")
def _(t: Tables) -> DataFrame:
    key = text(F.col("p_partkey"))
    observed = F.when(F.col("p_partkey") % 3 == 0, joined("a/F", key)).when(F.col("p_partkey") % 3 == 1, joined("root/a/F", key)).otherwise(joined("ba/F", key))
    return t.part.select("p_partkey", paths.same_or_suffix(observed, joined("a/F", key)).alias("agrees"))


@query(
    "fn_36_revision_bodies",
    """SELECT p_partkey, sha256('{"aliases":["A","B' || p_size || '"],"events":["' || p_name || '","0"],"title":"' || p_brand || '"}') AS body FROM part""",
)
def _(t: Tables) -> DataFrame:
    b = joined("B", text(F.col("p_size")))
    aliases = F.when(F.col("p_partkey") % 2 == 0, F.array(b, F.lit("A"))).otherwise(F.array(F.lit("A"), b, b))
    return t.part.select("p_partkey", canonical.revision_body({"aliases": aliases}, {"events": F.array("p_name", F.lit("0")), "title": F.col("p_brand")}).alias("body"))


@query(
    "fn_37_build_bindings",
    """SELECT p_partkey, sha256('{"build":{"apk_sha256":' || CASE WHEN p_partkey % 3 = 0 THEN '""' ELSE '"' || p_brand || '"' END || '},"package":"com.x' || p_size || '","platform":"android"}') AS identity, CASE WHEN p_partkey % 3 = 0 THEN 'unavailable' ELSE 'bound' END AS state FROM part""",
)
def _(t: Tables) -> DataFrame:
    strong = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand"))
    binding = canonical.build_binding(F.lit("android"), joined("com.x", text(F.col("p_size"))), F.struct(strong.alias("apk_sha256")), strong)
    return t.part.select("p_partkey", binding["identity"].alias("identity"), binding["state"].alias("state"))


@query(
    "udf_05_match_spans",
    f"""SELECT source || '/src/doc' || doc_id || '.kt' AS path, CAST({SNIPPET_LINE} AS INTEGER) AS line, CAST(length(text) + 1 + x.o AS INTEGER) AS "offset", x.v AS value FROM documents, (SELECT unnest([{{'o': 0, 'v': 'zz(a'}}, {{'o': 6, 'v': 'zz(bc'}}]) AS x)""",
)
def _(t: Tables) -> DataFrame:
    rows = code_sources(t, ".kt", "zz(a; zz(bc").withColumn("text", clean_mark(F.col("text")))
    return rows.select("path", F.explode(matches_with_offsets(F.col("text"), r"\bzz\(\w+")).alias("m")).select("path", "m.line", "m.offset", "m.value")
