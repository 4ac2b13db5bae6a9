"""Source queries: documents in feed, lock-file, manifest and page formats derived from the tables, parsed back.

The SQL states the expected rows straight from the tables, so each format is written and read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators import coverage, detect
from sightline.plans.evidence_queries import BRIDGE, dated_reports
from sightline.plans.posture_queries import pick
from sightline.plans.registry import query
from sightline.plans.tables import Tables, joined, text
from sightline.sources import build_files, configs, corpus, feeds, pages, sarif, tables


def per_order(t: Tables, line, suffix: str) -> DataFrame:
    """One file per order; an order holds a handful of lines."""
    rows = t.lineitem.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity", "l_suppkey", line.alias("x")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), suffix)
    return rows.groupBy("l_orderkey").agg(body.alias("body"))


def files_of(rows: DataFrame, path, text_column) -> DataFrame:
    return rows.select(joined("app-", text(F.col("l_orderkey") % 50)).alias("app_id"), path.alias("path"), text_column.alias("text"))


@query(
    "src_01_corpus_rows",
    """SELECT source AS app_id, 'src/f' || doc_id || ['.kt', '.java', '.xml', '.png', '.md'][1 + doc_id % 5] AS path, length(text) AS chars FROM documents
       WHERE doc_id % 5 < 3 AND doc_id % 7 <> 0""",
)
def _(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    folder = F.when(doc % 7 == 0, "/node_modules/").otherwise("/src/")
    path = F.concat(F.lit("file:/data/apps/"), "source", folder, F.lit("f"), text(doc), pick((".kt", ".java", ".xml", ".png", ".md"), doc % 5))
    files = t.documents.select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    return corpus.corpus_rows(files, "/data/apps").select("app_id", "path", F.length("text").cast("bigint").alias("chars"))


@query(
    "src_02_rules_with_weaknesses",
    """SELECT 'P-' || p_partkey AS rule_id, CASE WHEN p_partkey % 3 = 0 THEN 'MASWE-0090' WHEN p_partkey % 2 = 0 THEN 'B-' || (p_partkey % 4) ELSE '' END AS maswe FROM part WHERE p_partkey % 10 <> 0""",
)
def _(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    own = F.when(key % 3 == 0, F.array(F.lit("MASWE-0090")))
    rule = F.struct(
        F.when(key % 10 != 0, joined("P-", text(key))).alias("id"), F.lit("low").alias("severity"), F.array(F.lit(".kt")).alias("suffixes"), joined("x", text(key)).alias("pattern"), own.alias("maswe")
    )
    parsed = t.part.select(F.from_json(F.to_json(F.struct(F.array(rule).alias("rules"))), corpus.RULE_SCHEMA).alias("d")).select("d.rules")
    bridge = t.part.where(key % 2 == 0).select(joined("P-", text(key)).alias("rule_id"), joined("B-", text(key % 4)).alias("weakness_id"))
    return corpus.with_weaknesses(corpus.rule_rows(parsed), bridge).select("rule_id", F.array_join("maswe", ",").alias("maswe"))


@query(
    "src_03_taxonomy_bridges",
    """SELECT 'W-' || p_partkey AS weakness_id, kind, value FROM (SELECT p_partkey, 'platform' AS kind, unnest(['android', 'ios']) AS value FROM part UNION ALL SELECT p_partkey, 'cwe', 'CWE-' || p_size FROM part
        UNION ALL SELECT p_partkey, 'masvs', 'C-' || (p_partkey % 9) FROM part UNION ALL SELECT p_partkey, 'beta', 'W-' || (p_partkey + 1) FROM part WHERE p_partkey % 4 = 0)""",
)
def _(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    rows = t.part.select(
        joined("W-", text(key)).alias("id"), F.array(F.lit("android"), F.lit("ios")).alias("platform"), F.array(joined("C-", text(key % 9))).alias("masvs"),
        F.array(joined("CWE-", text(F.col("p_size")))).alias("cwe"), F.when(key % 4 == 0, F.array(joined("W-", text(key + 1)))).alias("beta"),
    )
    return corpus.taxonomy_bridges(rows)


def _lock_line():
    configs_text = F.when(F.col("l_returnflag") == "A", "debugRuntimeClasspath").when(F.col("l_returnflag") == "N", "releaseRuntimeClasspath,testRuntimeClasspath").otherwise("proRuntimeClasspath,releaseRuntimeClasspath")
    return joined("org.g:lib", text(F.col("l_partkey")), ":", text(F.col("l_quantity").cast("int")), "=", configs_text)


@query(
    "src_04_lockfile_coordinates",
    """SELECT 'app-' || (l_orderkey % 50) AS app_id, 'org.g:lib' || l_partkey AS name, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS version,
        CASE WHEN l_returnflag = 'N' THEN 'releaseRuntimeClasspath' ELSE 'proRuntimeClasspath,releaseRuntimeClasspath' END AS configurations, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    rows = per_order(t, _lock_line(), "\n")
    files = files_of(rows, joined("m", text(F.col("l_orderkey")), "/gradle.lockfile"), F.concat(F.lit("# generated\n"), "body", F.lit("\nempty=annotationProcessor\n")))
    out, _ = build_files.lockfile_rows(files)
    return out.groupBy("app_id", "name", "version", F.array_join("x_configurations", ",").alias("configurations")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_04_lockfile_rejects",
    "SELECT 'app-' || (l_orderkey % 50) AS app_id, count(*) AS n FROM lineitem WHERE l_linenumber = 3 GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    line = F.when(F.col("l_linenumber") == 3, "not a coordinate").otherwise(_lock_line())
    files = files_of(per_order(t, line, "\n"), joined("m", text(F.col("l_orderkey")), "/gradle.lockfile"), F.col("body"))
    return build_files.lockfile_rows(files)[1].groupBy("app_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_05_build_declarations",
    """SELECT 'app-' || (l_orderkey % 50) AS app_id, 'org.g:lib' || l_partkey AS name, CASE WHEN l_linenumber % 3 = 2 THEN '1.+' ELSE '1.' || l_linenumber END AS version, CASE WHEN l_linenumber % 3 = 2 THEN 'unknown' ELSE 'declared' END AS confidence, count(*) AS n
       FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    number = F.col("l_linenumber")
    coordinate = joined("org.g:lib", text(F.col("l_partkey")), ":", F.when(number % 3 == 2, "1.+").otherwise(joined("1.", text(number))))
    line = F.when(number % 3 == 0, F.concat(F.lit("// implementation('"), coordinate, F.lit("')"))).when(
        number % 2 == 0, F.concat(F.lit('    api "'), coordinate, F.lit('"'))
    ).otherwise(F.concat(F.lit("    implementation('"), coordinate, F.lit("')")))
    files = files_of(per_order(t, line, "\n"), joined("m", text(F.col("l_orderkey")), "/build.gradle"), F.concat(F.lit("dependencies {\n"), "body", F.lit("\n}\n")))
    return build_files.declared_rows(files).groupBy("app_id", "name", "version", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_06_version_catalogue",
    """SELECT 'app-' || (l_orderkey % 50) AS app_id, 'org.g:lib' || l_partkey AS name, CASE WHEN l_linenumber % 2 = 0 THEN '2.' || l_orderkey ELSE '1.' || l_linenumber END AS version, CASE WHEN l_linenumber % 4 = 1 THEN 'core' ELSE '' END AS bundles, count(*) AS n
       FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_suppkey) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    # One alias per order line; of repeated line numbers the least row is kept, as TOML keys must be unique.
    order = F.struct("l_partkey", "l_quantity", "l_suppkey")
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(order).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    number = F.col("l_linenumber")
    alias = joined("a", text(number))
    version = F.when(number % 2 == 0, '{ ref = "v" }').otherwise(joined('"1.', text(number), '"'))
    entry = F.concat(alias, F.lit(' = { module = "org.g:lib'), text(F.col("l_partkey")), F.lit('", version = '), version, F.lit(" }"))
    grouped = lines.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"), F.array_sort(F.collect_list(F.when(number % 4 == 1, F.concat(F.lit('"'), alias, F.lit('"'))))).alias("members")
    )
    body = F.concat(
        F.lit('[versions]\nv = "2.'), text(F.col("l_orderkey")), F.lit('"\n[libraries]\n'), F.array_join("entries", "\n"), F.lit("\n[bundles]\ncore = ["), F.array_join("members", ", "), F.lit("]\n")
    )
    files = files_of(grouped, joined("m", text(F.col("l_orderkey")), "/gradle/libs.versions.toml"), body)
    out = build_files.catalog_rows(files)
    return out.groupBy("app_id", "name", "version", F.array_join("x_bundles", ",").alias("bundles")).agg(F.count(F.lit(1)).alias("n"))


_PIN_SQL = """SELECT 'app-' || (l_orderkey % 50) AS app_id, 'https://git.example/o/lib' || l_partkey AS name, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '1.' || l_linenumber END AS version, CASE WHEN l_linenumber % 3 = 0 THEN 'unknown' ELSE 'exact' END AS confidence, count(*) AS n
  FROM lineitem GROUP BY ALL"""


@query("src_07_swift_pins", _PIN_SQL)
def _(t: Tables) -> DataFrame:
    number = F.col("l_linenumber")
    place = F.when(F.col("l_orderkey") % 2 == 0, "location").otherwise("repositoryURL")
    state = F.when(number % 3 == 0, '{"branch":"main"}').otherwise(joined('{"version":"1.', text(number), '"}'))
    pin = F.concat(F.lit('{"'), place, F.lit('":"https://git.example/o/lib'), text(F.col("l_partkey")), F.lit('.git","state":'), state, F.lit("}"))
    rows = per_order(t, pin, ",")
    body = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit('{"pins":['), "body", F.lit("]}"))).otherwise(F.concat(F.lit('{"object":{"pins":['), "body", F.lit("]}}")))
    files = files_of(rows, F.lit("Package.resolved"), body)
    return build_files.swift_pins(files).groupBy("app_id", "name", "version", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_08_pod_lock",
    """SELECT 'app-' || (l_orderkey % 50) AS app_id, 'Pod' || l_partkey AS name, '1.' || l_linenumber AS version, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    number = F.col("l_linenumber")
    line = F.concat(F.lit("  - Pod"), text(F.col("l_partkey")), F.when(number % 2 == 0, "/Core").otherwise(""), F.lit(" (1."), text(number), F.lit("):\n    - Nested (= 9)"))
    files = files_of(per_order(t, line, "\n"), F.lit("Podfile.lock"), F.concat(F.lit("PODS:\n"), "body", F.lit("\n\nDEPENDENCIES:\n  - Other (2.0)\n")))
    return build_files.pod_lock_rows(files).groupBy("app_id", "name", "version").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_09_npm_lock",
    """SELECT app_id, name, version, count(*) AS n FROM (SELECT DISTINCT l_orderkey, 'app-' || (l_orderkey % 50) AS app_id, '@s/p' || l_partkey AS name, '1.0.' || l_partkey AS version FROM lineitem) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    part = text(F.col("l_partkey"))
    old = F.col("l_orderkey") % 2 == 1
    entry = F.concat(F.when(old, '"@s/p').otherwise('"node_modules/x/node_modules/@s/p'), part, F.lit('":{"version":"1.0.'), part, F.lit('"}'))
    distinct = t.lineitem.select("l_orderkey", "l_partkey").distinct().groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("body"))
    text_column = F.concat(F.when(old, '{"dependencies":{').otherwise('{"packages":{"":{"version":"0"},'), "body", F.lit("}}"))
    return build_files.npm_lock_rows(files_of(distinct, F.lit("package-lock.json"), text_column)).groupBy("app_id", "name", "version").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_10_bom_components",
    """SELECT ['Maven', 'npm', 'PyPI'][1 + l_partkey % 3] AS ecosystem, CASE l_partkey % 3 WHEN 0 THEN 'org.g:lib' ELSE '@s/p' END || l_partkey AS name, '1.0+b' || l_linenumber AS version, count(*) AS n FROM lineitem WHERE l_partkey % 4 <> 3 GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    part = F.col("l_partkey")
    purl = F.when(part % 4 == 3, "pkg:deb/x@1").when(part % 3 == 0, joined("pkg:maven/org.g/lib", text(part), "@1.0+b", text(F.col("l_linenumber")))).when(
        part % 3 == 1, joined("pkg:npm/%40s/p", text(part), "@1.0%2Bb", text(F.col("l_linenumber")), "?arch=x")
    ).otherwise(joined("pkg:pypi/%40s%2Fp", text(part), "@1.0+b", text(F.col("l_linenumber"))))
    entry = F.concat(F.lit('{"type":"library","name":"n","purl":"'), purl, F.lit('"}'))
    files = files_of(per_order(t, entry, ","), F.lit("app.cdx.json"), F.concat(F.lit('{"bomFormat":"CycloneDX","components":['), "body", F.lit("]}")))
    return build_files.bom_rows(files).groupBy("ecosystem", "name", "version").agg(F.count(F.lit(1)).alias("n"))


# --- feeds ---------------------------------------------------------------------------------------


def exploited_documents(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    entry = F.struct(
        F.when(key % 9 == 0, "CVE-1").otherwise(joined("CVE-2024-", text(key + 1000))).alias("cveID"), F.col("p_name").alias("vulnerabilityName"),
        F.when(key % 8 == 0, " ").otherwise(F.col("p_brand")).alias("vendorProject"), F.col("p_type").alias("product"), F.lit("2024-01-01").alias("dateAdded"),
    )
    return t.part.select(F.to_json(F.struct(F.array(entry).alias("vulnerabilities"))).alias("body"))


@query(
    "src_11_known_exploited",
    """SELECT 'CVE-2024-' || (p_partkey + 1000) AS id, p_name AS title, p_brand AS vendor, true AS known_exploited FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 8 <> 0""",
)
def _(t: Tables) -> DataFrame:
    return feeds.exploited_records(exploited_documents(t))[0].select("id", "title", "vendor", "known_exploited")


@query(
    "src_11_known_exploited_rejects",
    "SELECT 'invalid-entry' AS code, count(*) AS n FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 8 = 0",
)
def _(t: Tables) -> DataFrame:
    return feeds.exploited_records(exploited_documents(t))[1].groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_12_cve_documents",
    """SELECT 'CVE-2024-' || (p_partkey + 10000) AS id, CASE WHEN p_partkey % 3 = 0 THEN 'CVE-2024-' || (p_partkey + 10000) ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'about ' || p_type END AS description,
        CASE WHEN p_partkey % 5 = 0 THEN 'REJECTED' ELSE 'PUBLISHED' END AS state, p_size || '.0' AS upper, 'https://r.example/' || p_partkey AS reference FROM part WHERE p_partkey % 10 <> 7""",
)
def _(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    lang = F.when(key % 4 == 0, "de").otherwise("en-US")
    version = F.struct(F.lit("0").alias("version"), F.lit("affected").alias("status"), joined(text(F.col("p_size")), ".0").alias("lessThan"))
    cna = F.struct(
        F.when(key % 3 != 0, F.col("p_name")).alias("title"),
        F.array(F.struct(F.lit("fr").alias("lang"), F.lit("non").alias("value")), F.struct(lang.alias("lang"), joined("about ", F.col("p_type")).alias("value"))).alias("descriptions"),
        F.array(F.struct(F.lit("v").alias("vendor"), F.lit("p").alias("product"), F.array(version).alias("versions"))).alias("affected"),
        F.array(F.struct(joined("https://r.example/", text(key)).alias("url"))).alias("references"),
    )
    meta = F.struct(F.when(key % 10 == 7, "bad").otherwise(joined("CVE-2024-", text(key + 10000))).alias("cveId"), F.when(key % 5 == 0, "REJECTED").alias("state"))
    docs = t.part.select(F.to_json(F.struct(meta.alias("cveMetadata"), F.struct(cna.alias("cna")).alias("containers"))).alias("body"))
    return feeds.cve_records(docs)[0].select(
        "id", "title", "description", "state", F.get(F.get("affected", F.lit(0))["versions"], F.lit(0))["lessThan"].alias("upper"), F.get("references", F.lit(0)).alias("reference")
    )


def delta_documents(t: Tables) -> DataFrame:
    n = F.col("event_id")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    item = F.struct(joined("CVE-2024-", text(n + 10000)).alias("cveId"), F.when(F.col("k") % 2 == 0, joined("rev-", text(F.col("k")))).alias("dateUpdated"))
    entry = F.struct(stamp.alias("fetchTime"), F.when(F.col("k") % 3 == 0, F.array(item)).alias("new"), F.when(F.col("k") % 3 != 0, F.array(item)).alias("updated"))
    return t.events_k.select(F.to_json(F.array(entry)).alias("body"))


@query(
    "src_13_delta_candidates",
    """SELECT 'CVE-2024-' || (event_id + 10000) AS id, CASE WHEN k % 2 = 0 THEN 'rev-' || k ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS revision FROM events_k WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-20 00:00:00'""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    return feeds.delta_candidates(delta_documents(t), "2024-01-20T00:00:00Z")[0].select("id", "revision")


@query(
    "src_13_delta_cursor",
    "SELECT strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') AS \"cursor\" FROM events_k",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    return feeds.delta_candidates(delta_documents(t), "2024-01-20T00:00:00Z")[1].select(F.date_format("cursor", "yyyy-MM-dd HH:mm:ss").alias("cursor"))


@query(
    "src_14_osv_records",
    """SELECT coalesce(cve_b, cve_a, osv_id) AS id, osv_id, 'osv:' || ecosystem || ':' || name || ':' || version AS source, CASE WHEN withdrawn THEN '2024' ELSE '' END AS withdrawn,
        CASE WHEN severity IS NULL THEN 'unknown' ELSE 'database_specific.severity' END AS severity_basis, coalesce(severity, '') AS severity FROM advisories WHERE partkey % 14 <> 0""",
    ("advisories",),
)
def _(t: Tables) -> DataFrame:
    document = F.struct(
        F.col("osv_id").alias("id"), F.when(F.col("partkey") % 14 == 0, F.array(F.lit("has space"))).otherwise(F.col("aliases")).alias("aliases"),
        F.when(F.col("withdrawn"), "2024").alias("withdrawn"), F.struct(F.when(F.col("severity") == "medium", "MODERATE").otherwise(F.upper("severity")).alias("severity")).alias("database_specific"),
    )
    docs = t.advisories.select("ecosystem", "name", "version", F.to_json(document).alias("body"))
    return feeds.osv_records(docs)[0].select(
        "id", "osv_id", "source", F.coalesce("withdrawn", F.lit("")).alias("withdrawn"), "severity_basis", F.coalesce("severity", F.lit("")).alias("severity")
    )


@query(
    "src_19_backfill_months",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, bool_or(o_orderkey % 700 = 0) AS ok, count(*) AS n FROM orders GROUP BY 1)
       SELECT strftime(d, '%Y-%m') AS month, CASE WHEN m.ok IS NULL THEN 'missing' WHEN m.ok THEN 'fetched' ELSE 'failed' END AS state, coalesce(m.n, 0) AS documents
       FROM (SELECT unnest(generate_series(DATE '2015-08-01', DATE '2026-07-01', INTERVAL 1 MONTH)) AS d) LEFT JOIN m ON m.month = strftime(d - INTERVAL 20 YEAR, '%Y-%m')""",
)
def _(t: Tables) -> DataFrame:
    month = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 20 YEARS"), "yyyy-MM")
    bulletins = t.orders.select(month.alias("month"), (F.col("o_orderkey") % 700 == 0).alias("ok"))
    return feeds.backfill_months(t.spark, "2015-08", "2026-07", bulletins)


# --- pages ---------------------------------------------------------------------------------------


def advisory_pages(t: Tables) -> DataFrame:
    """Every page with an advisory section before and one inside its article."""
    key = text(F.col("page_id"))
    section = F.concat(
        F.lit("<h2>WebKit "), key, F.lit("</h2><p>Impact: code execution. CVE-2024-"), text(F.col("page_id") + 10000), F.lit(" and CVE-2023-9999: <b>actively exploited</b></p><h3>Kernel</h3><ul><li>CVE-2024-"),
        text(F.col("page_id") + 10000), F.lit("</li></ul>"),
    )
    return t.pages.select("page_id", "url", F.concat(section, F.col("html")).alias("html"))


@query(
    "src_15_advisory_mentions",
    """SELECT CAST(page_id AS VARCHAR) AS page_id, 'CVE-2024-' || (page_id + 10000) AS id, 'WebKit ' || page_id AS component, true AS exploitation_reported FROM pages
       UNION ALL SELECT CAST(page_id AS VARCHAR), 'CVE-2023-9999', 'WebKit ' || page_id, true FROM pages UNION ALL SELECT CAST(page_id AS VARCHAR), 'CVE-2024-' || (page_id + 10000), 'Kernel', false FROM pages""",
)
def _(t: Tables) -> DataFrame:
    return pages.mentions(advisory_pages(t)).select("page_id", "id", "component", "exploitation_reported")


@query(
    "win_12_nearest_heading",
    """SELECT CAST(page_id AS VARCHAR) AS page_id, 'Kernel' AS heading, 1 AS items FROM pages""",
)
def _(t: Tables) -> DataFrame:
    nodes = pages.with_headings(pages.page_nodes(advisory_pages(t)))
    first = nodes.where("tag = 'li' AND text LIKE 'CVE-2024-%'")
    return first.groupBy("page_id", "heading").agg(F.count(F.lit(1)).cast("int").alias("items"))


def bulletin_pages(t: Tables) -> DataFrame:
    n = F.col("page_id")
    table = F.concat(
        F.lit("<h2>"), joined("2024-", F.lpad(text(n % 12 + 1), 2, "0"), "-05 security patch level"), F.lit("</h2><h3>"), pick(("Framework", "Kernel", "Qualcomm components"), n % 3),
        F.lit("</h3><table><tr><th>CVE</th><th>References</th><th>Severity</th><th>Updated AOSP versions</th></tr><tr><td>CVE-2024-"), text(n + 10000),
        F.lit(" CVE-2024-1</td><td><a href='/x'>A-1</a></td><td>High</td><td>"), pick(("13, 14", "14"), n % 2), F.lit("</td></tr><tr><td>note</td><td>CVE-2024-2</td></tr></table>"),
    )
    return t.pages.select("page_id", "url", F.concat(table, F.col("html")).alias("html"))


@query(
    "src_16_bulletin_rows",
    """SELECT CAST(page_id AS VARCHAR) AS page_id, x AS id, ['Framework', 'Kernel', 'Qualcomm components'][1 + page_id % 3] AS component, ['platform', 'kernel', 'qualcomm'][1 + page_id % 3] AS vendor_scope,
        '2024-' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '-05' AS fixed_patch_level, ['13, 14', '14'][1 + page_id % 2] AS updated_versions, 'high' AS severity
       FROM pages, (SELECT unnest(['a', 'b']) AS w) q, LATERAL (SELECT CASE w WHEN 'a' THEN 'CVE-2024-' || (page_id + 10000) ELSE 'CVE-2024-1' END AS x) WHERE w = 'a'""",
)
def _(t: Tables) -> DataFrame:
    return pages.bulletin_rows(bulletin_pages(t)).select("page_id", "id", "component", "vendor_scope", "fixed_patch_level", "updated_versions", "severity")


@query(
    "src_17_test_catalogue",
    """SELECT CAST(page_id AS VARCHAR) AS page_id, 'MASTG-TEST-0' || (100 + page_id % 900) AS id, ['deprecated', 'placeholder', 'current'][1 + page_id % 3] AS status FROM pages""",
)
def _(t: Tables) -> DataFrame:
    n = F.col("page_id")
    table = F.concat(F.lit("<table><tr><td><a href='/t'>MASTG-TEST-0"), text(n % 900 + 100), F.lit("</a></td><td>"), pick(("deprecated", "placeholder", "ok"), n % 3), F.lit("</td></tr><tr><td>none</td></tr></table>"))
    rows = t.pages.select("page_id", "url", F.concat(table, F.col("html")).alias("html"))
    return pages.catalogue_tests(rows)


@query(
    "src_18_discovered_links",
    """SELECT CAST(page_id AS VARCHAR) AS page_id, 'https://support.apple.com/en-us/' || (page_id * 10 + j) AS link, CAST(j + 1 AS INTEGER) AS rank FROM pages, (SELECT unnest(range(0, 3)) AS j)""",
)
def _(t: Tables) -> DataFrame:
    n = F.col("page_id")
    link = lambda j: F.concat(F.lit("<a href='https://support.apple.com/en-us/"), text(n * 10 + j), F.lit("#top'>x</a>"))
    index = F.concat(F.lit("<p>"), link(0), link(0), F.lit("<a href='https://other.example/en-us/5'>y</a><a href='https://support.apple.com/contact'>z</a>"), link(1), link(2), link(3), F.lit("</p>"))
    rows = t.pages.select("page_id", "url", F.concat(index, F.col("html")).alias("html"))
    return pages.discovered_links(rows, "support.apple.com", r"^/en-us/\d+$", 3)


# --- SARIF ---------------------------------------------------------------------------------------


def sarif_documents(t: Tables) -> DataFrame:
    """One document per order: a result per line, its rule given by id or by position."""

    def result(line: Column) -> Column:
        number, part = line["l_linenumber"], line["l_partkey"]
        uri = F.when(part % 10 == 0, "/abs/x.kt").when(part % 10 == 1, "../up.kt").otherwise(joined("app/src/F", text(part), ".kt"))
        by_index = number % 2 == 0
        return F.struct(
            F.when(~by_index, joined("R", text(part % 3))).alias("ruleId"), F.when(by_index, (part % 3).cast("int")).alias("ruleIndex"), F.when(number % 3 == 0, "error").alias("level"),
            F.struct(joined("found password=hunter", text(part), " here").alias("text")).alias("message"),
            F.array(
                F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct((number * 10).alias("startLine")).alias("region")).alias("physicalLocation"))
            ).alias("locations"),
        )

    # the lines of an order meet as four numbers; their results are built where they meet
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_suppkey")))
    grouped = t.lineitem.groupBy("l_orderkey").agg(lines.alias("lines")).select("l_orderkey", F.transform("lines", result).alias("results"))
    rules = F.array(
        *[
            F.struct(
                F.lit(f"R{i}").alias("id"),
                F.struct(F.lit(score).alias("security-severity"), F.array(F.lit(f"external/cwe/cwe-{cwe}")).alias("tags")).alias("properties"),
            )
            for i, (score, cwe) in enumerate((("9.1", "89"), ("5.0", "022"), ("x", "295")))
        ]
    )
    driver = F.struct(F.lit("Scanner").alias("name"), rules.alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results"))
    version = F.when(F.col("l_orderkey") % 20 == 0, "2.0.0").otherwise("2.1.0")
    return grouped.select(joined("rep-", text(F.col("l_orderkey"))).alias("report_id"), F.lit("scan ner").alias("tool"), F.to_json(F.struct(version.alias("version"), F.array(run).alias("runs"))).alias("body"))


_SARIF_SQL = """s AS (SELECT 'rep-' || l_orderkey AS report_id, l_partkey AS p, l_linenumber AS ln FROM lineitem WHERE l_orderkey % 20 <> 0 AND l_partkey % 10 > 1)"""


@query(
    "src_20_imported_results",
    f"""WITH {_SARIF_SQL} SELECT report_id, 'src/F' || p || '.kt' AS path, CAST(ln * 10 AS INTEGER) AS line, 'R' || (p % 3) AS external_rule, CASE p % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' ELSE CASE WHEN ln % 3 = 0 THEN 'medium' ELSE 'low' END END AS severity,
        ['CWE-89', 'CWE-22', 'CWE-295'][1 + p % 3] AS cwe, 'found password=[REDACTED] here' AS message FROM s""",
)
def _(t: Tables) -> DataFrame:
    found = sarif.external_findings(sarif.parsed_results(sarif_documents(t))[0], root="app")
    return found.select("report_id", "path", "line", "external_rule", "severity", F.array_join("cwe", ",").alias("cwe"), "message")


@query("src_20_import_rejects", "SELECT 'unsupported-version' AS code, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey % 20 = 0")
def _(t: Tables) -> DataFrame:
    return sarif.parsed_results(sarif_documents(t))[1].groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "jon_31_cwe_weaknesses",
    f"""WITH {_SARIF_SQL}, f AS (SELECT DISTINCT report_id, p, ln FROM s) SELECT ['W-SQL', 'W-PATH', 'W-TLS'][1 + p % 3] AS weakness_id, count(*) AS findings FROM f GROUP BY 1 UNION ALL SELECT 'W-ANY', count(*) FROM f WHERE p % 3 < 2""",
)
def _(t: Tables) -> DataFrame:
    taxonomy = t.local([("W-SQL", ["CWE-89"]), ("W-PATH", ["CWE-22", "CWE-23"]), ("W-TLS", ["CWE-295"]), ("W-ANY", ["CWE-89", "CWE-22"])], "id string, cwe array<string>")
    found = sarif.external_findings(sarif.parsed_results(sarif_documents(t))[0], root="app")
    return sarif.with_cwe_weaknesses(found, taxonomy).groupBy("weakness_id").agg(F.count(F.lit(1)).alias("findings"))


# --- configuration -------------------------------------------------------------------------------


def manifests(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    quoted = lambda name, value: F.concat(F.lit(f' android:{name}="'), value, F.lit('"'))
    body = F.concat(
        F.lit('<?xml version="1.0"?>\n<!-- <uses-permission android:name="commented"/> -->\n<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="com.x'), text(key), F.lit('">'),
        F.lit("<uses-sdk"), quoted("minSdkVersion", F.lit("21")), quoted("targetSdkVersion", text(size)), F.lit('/><uses-permission android:name="android.permission.CAMERA"/>'),
        F.when(key % 2 == 0, '<uses-permission android:name="android.permission.READ_SMS"/>').otherwise(""),
        F.lit('<permission android:name="own"'), quoted("protectionLevel", pick(("normal", "signature"), key % 2)), F.lit("/><application"), quoted("debuggable", F.when(key % 3 == 0, "true").otherwise("false")),
        F.lit('><activity android:name=".Main" android:exported="true"><intent-filter><action android:name="android.intent.action.MAIN"/><category android:name="android.intent.category.LAUNCHER"/></intent-filter></activity>'),
        F.lit('<activity android:name=".Link" android:exported="true"><intent-filter android:autoVerify="'), F.when(key % 4 == 0, "true").otherwise("false"),
        F.lit('"><action android:name="android.intent.action.VIEW"/><category android:name="android.intent.category.BROWSABLE"/><data android:scheme="https"/><data android:scheme="http"/><data android:host="h'), text(key),
        F.lit('.example" android:pathPrefix="/p"/></intent-filter></activity><provider android:name=".P"'), F.when(key % 5 == 0, quoted("readPermission", F.lit("r"))).otherwise(""), F.lit("/></application></manifest>"),
    )
    return t.part.select(joined("app-", text(key)).alias("app_id"), F.lit("AndroidManifest.xml").alias("path"), F.when(key % 50 == 49, "<manifest").otherwise(body).alias("text"))


_MANIFEST_SQL = "m AS (SELECT p_partkey AS k, p_size AS s FROM part WHERE p_partkey % 50 <> 49)"


@query(
    "src_21_manifest_configuration",
    f"WITH {_MANIFEST_SQL} SELECT 'app-' || k AS app_id, 'com.x' || k AS package, CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END AS debuggable, 21 AS min_sdk, s AS target_sdk FROM m",
)
def _(t: Tables) -> DataFrame:
    return configs.manifest_configs(configs.parsed_manifests(manifests(t))).select("app_id", "package", "debuggable", "min_sdk", "target_sdk")


@query("src_21_malformed_manifests", "SELECT 'app-' || p_partkey AS app_id FROM part WHERE p_partkey % 50 = 49")
def _(t: Tables) -> DataFrame:
    return configs.malformed(configs.parsed_manifests(manifests(t))).select("app_id")


@query(
    "src_21_manifest_components",
    f"""WITH {_MANIFEST_SQL} SELECT 'app-' || k AS app_id, x.n AS name, x.t AS type, x.e AS exported, x.l AS launcher, CASE WHEN x.n = '.P' AND k % 5 = 0 THEN 'r' ELSE '' END AS read_permission FROM m,
         (SELECT unnest([{{'n': '.Main', 't': 'activity', 'e': 'true', 'l': true}}, {{'n': '.Link', 't': 'activity', 'e': 'true', 'l': false}}, {{'n': '.P', 't': 'provider', 'e': 'unspecified', 'l': false}}]) AS x)""",
)
def _(t: Tables) -> DataFrame:
    return configs.manifest_components(configs.parsed_manifests(manifests(t))).select("app_id", "name", "type", "exported", "launcher", "read_permission")


@query(
    "src_21_manifest_deep_links",
    f"""WITH {_MANIFEST_SQL} SELECT 'app-' || k AS app_id, s2 AS scheme, 'h' || k || '.example' AS host, '/p' AS path, 'pathPrefix' AS path_kind, CASE WHEN k % 4 = 0 THEN 'true' ELSE 'false' END AS auto_verify, true AS browsable FROM m, (SELECT unnest(['https', 'http']) AS s2)""",
)
def _(t: Tables) -> DataFrame:
    links = configs.deep_links(configs.manifest_components(configs.parsed_manifests(manifests(t))))
    return links.select("app_id", "scheme", "host", "path", "path_kind", "auto_verify", "browsable")


@query(
    "src_21_manifest_permissions",
    f"""WITH {_MANIFEST_SQL} SELECT 'app-' || k AS app_id, 'android.permission.CAMERA' AS permission FROM m UNION ALL SELECT 'app-' || k, 'android.permission.READ_SMS' FROM m WHERE k % 2 = 0
        UNION ALL SELECT 'app-' || k, 'own:' || ['normal', 'signature'][1 + k % 2] FROM m""",
)
def _(t: Tables) -> DataFrame:
    asked, own = configs.manifest_permissions(configs.parsed_manifests(manifests(t)))
    return asked.unionByName(own.select("app_id", F.concat_ws(":", "name", "protection_level").alias("permission")))


@query(
    "src_22_network_configuration",
    """WITH p AS (SELECT p_partkey AS k, ['true', 'false'][1 + p_partkey % 2] AS parent, p_size AS s FROM part)
       SELECT 'app-' || k AS app_id, 'base-config' AS scope, s % 3 = 0 AS cleartext_permitted, '' AS domains, s % 2 = 0 AS user_ca FROM p
       UNION ALL SELECT 'app-' || k, 'domain-config', parent = 'true', 'a.example', false FROM p UNION ALL SELECT 'app-' || k, 'domain-config', parent = 'true', 'b' || k || '.example', false FROM p
       UNION ALL SELECT 'app-' || k, 'domain-config', false, 'c.example', true FROM p""",
)
def _(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    body = F.concat(
        F.lit('<network-security-config><base-config cleartextTrafficPermitted="'), F.when(size % 3 == 0, "true").otherwise("false"), F.lit('"><trust-anchors><certificates src="'),
        F.when(size % 2 == 0, "user").otherwise("system"), F.lit('"/></trust-anchors></base-config><domain-config cleartextTrafficPermitted="'), pick(("true", "false"), key % 2),
        F.lit('"><domain includeSubdomains="true"> a.example </domain><domain-config><domain>b'), text(key),
        F.lit('.example</domain></domain-config><domain-config cleartextTrafficPermitted="false"><domain>c.example</domain><trust-anchors><certificates src="user"/></trust-anchors></domain-config></domain-config>'),
        F.lit('<debug-overrides><trust-anchors><certificates src="user"/></trust-anchors></debug-overrides></network-security-config>'),
    )
    files = t.part.select(joined("app-", text(key)).alias("app_id"), F.lit("res/xml/net.xml").alias("path"), body.alias("text"))
    return configs.network_configs(files).select("app_id", "scope", "cleartext_permitted", F.array_join("domains", ",").alias("domains"), "user_ca")


def property_files(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    body = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><plist version="1.0"><dict><key>CFBundleIdentifier</key><string>com.x'), text(key), F.lit("</string><key>MinimumOSVersion</key><string>"), text(size),
        F.lit(".0</string><key>NSAppTransportSecurity</key><dict><key>NSAllowsArbitraryLoads</key><"), F.when(size % 2 == 0, "true").otherwise("false"), F.lit("/><key>NSExceptionDomains</key><dict><key>d"), text(key),
        F.lit(".example</key><dict><key>NSExceptionAllowsInsecureHTTPLoads</key><true/><key>NSExceptionMinimumTLSVersion</key><string>TLSv1.0</string></dict></dict></dict>"),
        F.lit("<key>CFBundleURLTypes</key><array><dict><key>CFBundleURLSchemes</key><array><string>app"), text(key), F.lit("</string><string>x</string></array></dict></array></dict></plist>"),
    )
    return t.part.select(joined("app-", text(key)).alias("app_id"), F.lit("Info.plist").alias("path"), F.when(key % 40 == 39, "<plist").otherwise(body).alias("text"))


@query(
    "src_23_property_lists",
    """SELECT 'app-' || p_partkey AS app_id, 'com.x' || p_partkey AS bundle_id, p_size % 2 = 0 AS ats_arbitrary_loads, p_size || '.0' AS minimum_os FROM part WHERE p_partkey % 40 <> 39""",
)
def _(t: Tables) -> DataFrame:
    return configs.plist_configs(configs.property_lists(property_files(t))).select("app_id", "bundle_id", "ats_arbitrary_loads", "minimum_os")


@query(
    "src_23_property_list_domains",
    """SELECT 'app-' || p_partkey AS app_id, 'd' || p_partkey || '.example' AS domain, true AS insecure, 'TLSv1.0' AS min_tls, 2 AS schemes FROM part WHERE p_partkey % 40 <> 39""",
)
def _(t: Tables) -> DataFrame:
    parsed = configs.property_lists(property_files(t))
    count = configs.plist_schemes(parsed).groupBy("app_id").agg(F.count(F.lit(1)).cast("int").alias("schemes"))
    return configs.plist_domains(parsed).select("app_id", "domain", "insecure", "min_tls").join(count, "app_id")


@query(
    "src_24_device_properties",
    """SELECT 'dev-' || c_custkey AS device_id, '2024-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '-05' AS patch, CAST(c_nationkey AS VARCHAR) AS release, 3 AS keys FROM customer""",
)
def _(t: Tables) -> DataFrame:
    body = F.concat(
        F.lit("[ro.build.version.release]: [0]\n[ro.build.version.security_patch]: [2024-"), F.lpad(text(F.col("c_custkey") % 12 + 1), 2, "0"), F.lit("-05]\nnoise\n[ro.build.version.release]: ["),
        text(F.col("c_nationkey")), F.lit("]\n[empty]: []"),
    )
    dumps = t.customer.select(joined("dev-", text(F.col("c_custkey"))).alias("device_id"), body.alias("text"))
    rows = configs.device_properties(dumps)
    return rows.select("device_id", F.col("props")["ro.build.version.security_patch"].alias("patch"), F.col("props")["ro.build.version.release"].alias("release"), F.size("props").alias("keys"))


@query(
    "src_25_package_dumps",
    """SELECT 'app' || o_orderkey AS name, CASE WHEN o_orderkey % 6 = 0 THEN -1 ELSE CAST(o_orderkey % 40 AS INTEGER) END AS target_sdk, o_orderkey % 5 = 0 AS debuggable, CASE WHEN o_orderkey % 3 = 0 THEN 'store' ELSE '' END AS installer, o_orderkey % 3 <> 2 AS installer_present FROM orders""",
)
def _(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    body = F.concat(
        F.when(key % 6 == 0, "").otherwise(joined("  versionCode=1 targetSdk=", text(key % 40), "\n")), F.lit("  flags=[ HAS_CODE "), F.when(key % 5 == 0, "DEBUGGABLE ").otherwise(""), F.lit("]\n"),
        F.when(key % 3 == 0, "  installerPackageName=store\n").when(key % 3 == 1, "  installerPackageName=null\n").otherwise(""),
    )
    dumps = t.orders.select(joined("dev-", text(F.col("o_custkey"))).alias("device_id"), joined("app", text(key)).alias("name"), body.alias("text"))
    return configs.package_dumps(dumps).select("name", F.coalesce("target_sdk", F.lit(-1)).alias("target_sdk"), "debuggable", F.coalesce("installer", F.lit("")).alias("installer"), "installer_present")


# --- saved tables --------------------------------------------------------------------------------


@query(
    "src_26_latest_report_per_target",
    "SELECT target, target || '@' || strftime(max(day), '%Y-%m-%d') AS report_id FROM reports GROUP BY target",
    ("reports",),
)
def _(t: Tables) -> DataFrame:
    return tables.latest_reports(dated_reports(t)).select("target", "report_id")


@query(
    "src_26_target_reports_until",
    "SELECT report_id FROM reports WHERE target = 'app-4' AND strftime(day, '%Y-%m-%d') <= '2024-01-18' ORDER BY day DESC LIMIT 10",
    ("reports",),
)
def _(t: Tables) -> DataFrame:
    return tables.target_reports(dated_reports(t), "app-4", "2024-01-18", 10).select("report_id")


@query("src_26_report_by_id", "SELECT report_id, target FROM reports WHERE report_id = 'app-5@2024-01-09'", ("reports",))
def _(t: Tables) -> DataFrame:
    return tables.report_by_id(dated_reports(t), "app-5@2024-01-09").select("report_id", "target")


def case_rows(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    label = F.struct(F.when(key % 11 == 0, "R-UNKNOWN").otherwise("R-A").alias("rule_id"), F.when(key % 13 == 0, "version-affected").otherwise("candidate").alias("status"))
    variant = F.when(key % 3 == 0, "vulnerable").when(key % 3 == 1, "fixed").otherwise("irrelevant")
    none = F.array().cast("array<struct<rule_id:string,status:string>>")
    return t.part.select(
        F.when(key % 100 < 2, joined("c", text(F.floor(key / 100)))).otherwise(joined("k", text(key))).alias("case_id"), F.when(key % 17 == 0, "blob").otherwise("source").alias("kind"),
        F.lit("p.kt").alias("path"), variant.alias("variant"), F.lit("pair").alias("pair"), F.when((key % 3 == 0) | (key % 19 == 0), F.array(label)).otherwise(none).alias("expected"),
    )


_CASES_SQL = """c AS (SELECT CASE WHEN p_partkey % 100 < 2 THEN 'c' || (p_partkey // 100) ELSE 'k' || p_partkey END AS case_id, CASE WHEN p_partkey % 17 = 0 THEN 'incomplete-case' WHEN p_partkey % 100 < 2 THEN 'duplicate-id'
     WHEN p_partkey % 3 <> 0 AND p_partkey % 19 = 0 THEN 'label-variant-mismatch' WHEN p_partkey % 3 = 0 AND p_partkey % 13 = 0 THEN 'status-not-candidate' WHEN p_partkey % 3 = 0 AND p_partkey % 11 = 0 THEN 'unlisted-rule' END AS code FROM part)"""


@query("src_27_labelled_cases", f"WITH {_CASES_SQL} SELECT case_id FROM c WHERE code IS NULL")
def _(t: Tables) -> DataFrame:
    return tables.labelled_cases(case_rows(t), t.local([("R-A",)], "rule_id string"))[0].select("case_id")


@query("src_27_case_rejects", f"WITH {_CASES_SQL} SELECT case_id, code FROM c WHERE code IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return tables.labelled_cases(case_rows(t), t.local([("R-A",)], "rule_id string"))[1]


def waiver_rows(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    return t.part.select(
        F.when(key % 50 < 2, joined("F-", text(F.floor(key / 50)))).otherwise(joined("G-", text(key))).alias("finding_id"), F.when(key % 9 == 0, " ").otherwise("agreed").alias("reason"),
        F.when(key % 7 == 0, "2024-02-30").otherwise("2024-02-20").alias("expires"), F.when(key % 8 == 0, "severe").when(key % 2 == 0, "high").alias("severity"), F.lit(None).cast("boolean").alias("known_exploited"),
    )


_WAIVER_SQL = """w AS (SELECT CASE WHEN p_partkey % 50 < 2 THEN 'F-' || (p_partkey // 50) ELSE 'G-' || p_partkey END AS finding_id, CASE WHEN p_partkey % 9 = 0 THEN 'missing-reason' WHEN p_partkey % 7 = 0 THEN 'invalid-expiry'
    WHEN p_partkey % 8 = 0 THEN 'unknown-severity' WHEN p_partkey % 50 < 2 THEN 'duplicate-waiver' END AS code FROM part)"""


@query("src_28_valid_waivers", f"WITH {_WAIVER_SQL} SELECT finding_id FROM w WHERE code IS NULL")
def _(t: Tables) -> DataFrame:
    return tables.valid_waivers(waiver_rows(t))[0].select("finding_id")


@query("src_28_waiver_rejects", f"WITH {_WAIVER_SQL} SELECT finding_id, code FROM w WHERE code IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return tables.valid_waivers(waiver_rows(t))[1]


@query(
    "src_28_checklist_problems",
    """SELECT item_id, code FROM (SELECT CASE WHEN p_partkey % 30 = 0 THEN 'bad id' || p_partkey ELSE 'I-' || (p_partkey // 2) END AS item_id, p_partkey AS k FROM part) x, LATERAL (SELECT unnest(list_filter([
         CASE WHEN item_id LIKE 'bad%' THEN 'invalid-id' END, CASE WHEN item_id NOT LIKE 'bad%' AND k % 2 = 0 AND (k + 1) % 30 <> 0 AND k + 1 < (SELECT count(*) FROM part) THEN 'duplicate-id' END,
         CASE WHEN k % 30 = 5 THEN 'unknown-weakness' END, CASE WHEN k % 30 = 8 THEN 'unknown-rule' END], lambda c: c IS NOT NULL)) AS code)""",
)
def _(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    items = t.part.select(
        F.when(key % 30 == 0, joined("bad id", text(key))).otherwise(joined("I-", text(F.floor(key / 2)))).alias("item_id"),
        F.array(F.when(key % 30 == 5, "MASWE-X").otherwise("MASWE-0001")).alias("weaknesses"), F.array(F.when(key % 30 == 8, "RULE-X").otherwise("RULE-CLICK")).alias("rules"),
    )
    known = t.local(BRIDGE, "rule_id string, weakness_id string")
    return tables.checklist_problems(items, coverage.weaknesses(t.spark), known)


@query(
    "src_29_canary_matches",
    """SELECT CAST(doc_id AS VARCHAR) AS path, x AS marker FROM documents, LATERAL (SELECT unnest(list_filter([CASE WHEN doc_id % 4 < 3 THEN 'account' END, CASE WHEN contains(text, 'license') THEN 'word' END], lambda v: v IS NOT NULL)) AS x)""",
)
def _(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    secret = F.lit("canary-7f3a")
    content = F.when(doc % 4 == 0, F.encode(F.concat("text", secret), "UTF-8")).when(doc % 4 == 1, F.concat(F.encode("text", "UTF-8"), F.encode(secret, "UTF-16LE"))).when(
        doc % 4 == 2, F.concat(F.encode("text", "UTF-8"), F.encode(secret, "UTF-16BE"))
    ).otherwise(F.encode("text", "UTF-8"))
    files = t.documents.select(F.lit("s").alias("scenario"), F.lit("a").alias("snapshot"), F.lit("storage").alias("surface"), text(doc).alias("path"), content.alias("content"))
    markers = t.local([("account", "canary-7f3a"), ("word", "license")], "label string, marker string")
    return corpus.canary_matches(files, markers).select("path", "marker")


@query(
    "src_01_build_file_dependencies",
    """SELECT ecosystem, count(*) AS n FROM (SELECT CASE l_orderkey % 3 WHEN 0 THEN 'Maven' WHEN 1 THEN 'SwiftURL' ELSE 'CocoaPods' END AS ecosystem FROM lineitem) GROUP BY ecosystem""",
)
def _(t: Tables) -> DataFrame:
    part = text(F.col("l_partkey"))
    kind = F.col("l_orderkey") % 3
    line = F.when(kind == 0, F.concat(F.lit("org.g:lib"), part, F.lit(":1=releaseRuntimeClasspath"))).when(
        kind == 1, F.concat(F.lit('{"location":"https://g.example/o/l'), part, F.lit('","state":{"version":"1"}}'))
    ).otherwise(F.concat(F.lit("  - Pod"), part, F.lit(" (1.0)")))
    rows = per_order(t, line, "\u0000").withColumn("body", F.translate("body", "\u0000", "\n"))
    name = F.when(kind == 0, "gradle.lockfile").when(kind == 1, "Package.resolved").otherwise("Podfile.lock")
    body = F.when(kind == 1, F.concat(F.lit('{"pins":['), F.replace(F.col("body"), F.lit("\n"), F.lit(",")), F.lit("]}"))).when(kind == 2, F.concat(F.lit("PODS:\n"), "body", F.lit("\nDEPENDENCIES:\n"))).otherwise(F.col("body"))
    files = files_of(rows, F.concat(F.lit("m/"), name), body)
    return build_files.dependency_rows(files).groupBy("ecosystem").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_02_catalogue_scan",
    """SELECT 'MASWE-0033' AS weakness_id, count(*) AS findings FROM documents WHERE doc_id % 2 = 0""",
)
def _(t: Tables) -> DataFrame:
    from sightline.plans.detect_queries import code_sources

    code = code_sources(t, ".kt", "view.addJavascriptInterface(api, name)", "val x = 1").withColumn("platforms", F.array(F.lit("android")))
    rules = corpus.with_weaknesses(detect.rule_table(t.spark, detect.catalogue()), coverage.rule_weaknesses(t.spark))
    found = detect.scan(code, detect.rules_from(rules))
    listed = rules.select("rule_id", F.explode("maswe").alias("weakness_id"))
    return found.join(listed, "rule_id").groupBy("weakness_id").agg(F.count(F.lit(1)).alias("findings"))
