"""Queries over findings, coverage and report histories derived from the whole event table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import ranks
from sightline.operators import compare, coverage, filters, identity, policy
from sightline.plans.registry import query
from sightline.plans.tables import Tables, joined, text

RANK_SQL = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
STATUS_SQL = (
    "CASE status WHEN 'candidate' THEN 0 WHEN 'version-affected' THEN 1 WHEN 'configuration-confirmed' THEN 2 ELSE 3 END"
)


def rank_sql(column: str) -> str:
    return RANK_SQL.replace("severity", column, 1)


def status_sql(column: str) -> str:
    return STATUS_SQL.replace("status", column, 1)


# Lattices in SQL over an aggregated group of states.
RULE_STATE_SQL = """CASE WHEN bool_and(state = 'not-applicable') THEN 'not-applicable'
  WHEN bool_or(state = 'partial') OR (bool_or(state IN ('checked', 'limited')) AND bool_or(state = 'not-run')) THEN 'partial'
  WHEN bool_and(state IN ('checked', 'not-applicable')) THEN 'checked'
  WHEN NOT bool_or(state = 'not-run') THEN 'limited' ELSE 'not-run' END"""
AGG_STATE_SQL = """CASE WHEN bool_and(state = 'not-applicable') THEN 'not-applicable'
  WHEN bool_and(state IN ('checked', 'not-applicable')) THEN 'checked'
  WHEN bool_and(state IN ('checked', 'limited', 'not-applicable')) THEN 'limited'
  WHEN bool_or(state IN ('checked', 'limited', 'partial')) THEN 'partial' ELSE 'not-run' END"""


# --- filters ---------------------------------------------------------------------------------


@query(
    "flt_01_filter_findings",
    "SELECT report_id, id, path, line FROM findings WHERE severity = 'high' AND status = 'candidate'",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    return filters.select_findings(t.findings, "high", "candidate").select("report_id", "id", "path", "line")


@query(
    "flt_01_section_counts",
    """SELECT report_id, 'findings' AS section, count(*) AS "rows" FROM findings GROUP BY report_id
       UNION ALL SELECT report_id, 'coverage', count(*) FROM coverage GROUP BY report_id""",
    ("findings", "coverage"),
)
def _(t: Tables) -> DataFrame:
    return filters.section_counts({"findings": t.findings, "coverage": t.coverage})


@query(
    "flt_01_state_histogram",
    "SELECT report_id, state, count(*) AS entries FROM coverage GROUP BY ALL",
    ("coverage",),
)
def _(t: Tables) -> DataFrame:
    return filters.state_histogram(t.coverage)


@query(
    "flt_02_search_newest",
    """SELECT id FROM (SELECT CAST(doc_id AS VARCHAR) AS id, n_chars AS modified FROM documents
        WHERE contains(lower(text), '100%') OR contains(lower(text), 'token') OR contains(lower(text), 'tion_') OR contains(lower(text), 'tion'))
       ORDER BY modified DESC, id LIMIT 50""",
)
def _(t: Tables) -> DataFrame:
    docs = t.documents.select(text(F.col("doc_id")).alias("id"), F.col("n_chars").alias("modified"), "text")
    return filters.search_newest(docs, ["text"], "TION", 50).select("id")


def evidence_rows(t: Tables) -> DataFrame:
    """Findings with a one-row evidence array (path, line, excerpt)."""
    row = F.struct("path", "line", F.concat(F.lit("token="), "rule_id").alias("excerpt"))
    return t.findings.withColumn("evidence", F.array(row))


@query(
    "flt_03_drop_excerpts",
    """SELECT report_id, id, '[{"path":"' || path || '","line":' || line || '}]' AS evidence FROM findings""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    return filters.without_excerpts(evidence_rows(t)).select("report_id", "id", F.to_json("evidence").alias("evidence"))


@query(
    "flt_04_sanitized_projection",
    "SELECT report_id, id, rule_id, severity, status, path AS location_path, line AS location_line FROM findings",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    rows = filters.sanitized(evidence_rows(t))
    return rows.select(
        "report_id", "id", "rule_id", "severity", "status", F.explode("locations").alias("l")
    ).select("report_id", "id", "rule_id", "severity", "status", F.col("l.path").alias("location_path"), F.col("l.line").alias("location_line"))


@query(
    "flt_05_mobile_exploited_vendors",
    """SELECT p_partkey, vendor FROM (SELECT p_partkey, ['Apple','Oracle','Google Android','Cisco','QUALCOMM','Adobe'][1 + p_partkey % 6] AS vendor FROM part)
       WHERE vendor IN ('Apple', 'Google Android', 'QUALCOMM')""",
)
def _(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(v) for v in ("Apple", "Oracle", "Google Android", "Cisco", "QUALCOMM", "Adobe")])
    rows = t.part.select("p_partkey", F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")).alias("vendor"), "p_name")
    return rows.where(filters.mobile_exploited(F.col("vendor"), F.col("p_name"))).select("p_partkey", "vendor")


@query(
    "flt_06_relevant_records",
    "SELECT doc_id FROM documents WHERE doc_id % 9 = 0 OR regexp_matches(lower(text), 'licen[sc]e|token')",
)
def _(t: Tables) -> DataFrame:
    state = F.when(F.col("doc_id") % 9 == 0, "REJECTED").otherwise("PUBLISHED")
    return t.documents.where(filters.relevant_record(state, F.col("text"), ["licen[sc]e", "token"])).select("doc_id")


_CONFIGS = ("releaseRuntimeClasspath", "debugRuntimeClasspath", "prodRuntimeClasspath", "releaseCompileClasspath", "kspReleaseRuntimeClasspath")


@query(
    "flt_07_shipped_configurations",
    f"""SELECT name, count(*) AS lines FROM (SELECT {list(_CONFIGS)!r}[1 + (l_orderkey + l_linenumber) % 5] AS name FROM lineitem)
       WHERE name IN ('releaseRuntimeClasspath', 'prodRuntimeClasspath') GROUP BY name""",
)
def _(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(c) for c in _CONFIGS])
    rows = t.lineitem.select(F.element_at(names, ((F.col("l_orderkey") + F.col("l_linenumber")) % 5 + 1).cast("int")).alias("name"))
    return rows.where(filters.shipped_configuration(F.col("name"))).groupBy("name").agg(F.count(F.lit(1)).alias("lines"))


_COMPONENTS = ("Qualcomm closed-source components", "Kernel components", "Framework", "MediaTek components", "Arm components", "System")
_SCOPES = ("qualcomm", "kernel", "platform", "mediatek", "arm", "platform")


@query(
    "flt_08_vendor_scope",
    f"""SELECT scope, count(*) AS parts FROM (SELECT {list(_SCOPES)!r}[1 + p_partkey % 6] AS scope FROM part) GROUP BY scope""",
)
def _(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(c) for c in _COMPONENTS])
    component = F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int"))
    return t.part.groupBy(filters.vendor_scope(component).alias("scope")).agg(F.count(F.lit(1)).alias("parts"))


@query(
    "flt_09_transmission_exclusions",
    """SELECT ecosystem, count(*) AS kept FROM deps WHERE ecosystem <> 'Go' AND NOT regexp_matches(name, '^org\\.g1[0-9]*:lib.*$')
       AND NOT regexp_matches(ecosystem || ':' || name, '^npm:.*[24]$') GROUP BY ecosystem""",
    ("deps",),
)
def _(t: Tables) -> DataFrame:
    rules = t.local(
        [("ecosystem", "Go"), ("name", "org.g1:lib*"), ("name", "org.g1?:lib*"), ("coordinate", "npm:*[24]")], "kind string, pattern string"
    )
    return filters.transmittable(t.deps, rules).groupBy("ecosystem").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "flt_10_dependency_advisory_rows",
    "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN k % 3 = 0 AND k % 5 <> 0 THEN 'dependency' ELSE 'other' END AS kind FROM findings) GROUP BY kind",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    dep = F.when(F.col("k") % 3 == 0, F.struct(F.col("rule_id").alias("name")))
    evidence = F.array(F.struct(F.col("path"), dep.alias("dependency")))
    scope = F.when(F.col("k") % 5 == 0, "environment")
    kind = F.when(identity.is_dependency_advisory(evidence, scope), "dependency").otherwise("other")
    return t.findings.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt_11_bounded_advisory_ids",
    """WITH ids AS (SELECT DISTINCT user_id, 'CVE-2024-' || (10000 + k) AS v FROM events_k),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v) AS rn FROM ids WHERE v <> 'CVE-2024-' || (10000 + user_id % 100))
       SELECT user_id, string_agg(v, ',' ORDER BY v) AS ids FROM (
         SELECT user_id, v FROM ranked WHERE rn <= 3 UNION ALL SELECT DISTINCT user_id, 'CVE-2024-' || (10000 + user_id % 100) FROM ids)
       GROUP BY user_id""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    from sightline.functions.packages import bounded_advisory_ids

    # Per user at most one hundred distinct ids exist (props.k is below 100).
    ids = t.events_k.groupBy("user_id").agg(F.collect_set(joined("CVE-2024-", text(F.col("k") + 10000))).alias("ids"))
    display = joined("CVE-2024-", text(F.col("user_id") % 100 + 10000))
    bad = F.concat("ids", F.array(F.lit("has space"), F.lit("")))
    return ids.select("user_id", F.array_join(bounded_advisory_ids(display, bad, 4), ",").alias("ids"))


@query(
    "flt_12_overridden_cleartext",
    """SELECT target AS app_id, count(*) AS kept FROM findings WHERE NOT (event_type = 'click' AND k % 2 = 0
         AND user_id % 10 >= 4 AND path IN (SELECT path FROM findings_raw WHERE event_type = 'view' AND (user_id % 10) = CAST(substr(target, 5) AS INTEGER)))
       GROUP BY target""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    rows = t.findings.withColumn("app_id", F.col("target"))
    rows = rows.withColumn("rule_id", F.when(F.col("event_type") == "click", "ANDROID-CLEARTEXT").otherwise(F.col("rule_id")))
    rows = rows.withColumn("from_manifest", F.col("k") % 2 == 0)
    parsed = t.findings_raw.where("event_type = 'view'").select(F.col("target").alias("app_id"), "path").distinct()
    levels = t.findings_raw.groupBy(F.col("target").alias("app_id")).agg(F.max(F.col("user_id") % 10 + 20).alias("min_sdk"))
    return filters.without_overridden_cleartext(rows, parsed, levels).groupBy("app_id").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "flt_13_demote_ambiguous",
    """SELECT CASE WHEN k % 6 = 0 AND status = 'configuration-confirmed' THEN 'candidate' ELSE status END AS status, count(*) AS n
       FROM findings GROUP BY 1""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    return filters.demote_ambiguous(t.findings, F.col("k") % 6 == 0).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt_14_demote_unfingerprinted",
    """SELECT report_id, rule_id, CASE WHEN day(day) % 4 = 0 AND state IN ('checked', 'limited') THEN 'partial' ELSE state END AS state FROM coverage""",
    ("coverage",),
)
def _(t: Tables) -> DataFrame:
    inventory = t.reports.select("report_id", (F.dayofmonth("day") % 4 != 0).alias("fingerprint_complete"))
    return filters.demote_unfingerprinted(t.coverage, inventory).select("report_id", "rule_id", "state")


@query(
    "flt_15_without_intelligence",
    "SELECT rule_id, count(*) AS n FROM findings WHERE event_type <> 'click' AND k % 7 <> 0 GROUP BY rule_id",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    rows = t.findings.withColumn("rule_id", F.when(F.col("event_type") == "click", "GHSA-1").otherwise(F.col("rule_id")))
    rows = rows.withColumn("origin", F.when(F.col("k") % 7 == 0, "intelligence").otherwise(F.col("origin")))
    return filters.without_intelligence(rows).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def suspect_findings(t: Tables) -> DataFrame:
    """Raw rows with some invalid severities; ids repeat within reports."""
    bad = F.when(F.col("k") % 13 == 0, "severe").otherwise(F.col("severity"))
    return t.findings_raw.withColumn("severity", bad).select("report_id", "id", "rule_id", "severity", "status", "event_id")


@query(
    "flt_16_invalid_findings",
    """WITH marked AS (SELECT report_id, id, k % 13 = 0 AS bad FROM findings_raw)
       SELECT report_id, 'invalid-finding' AS code, count(*) AS "rows" FROM marked WHERE bad GROUP BY report_id
       UNION ALL SELECT report_id, 'duplicate-finding-id', CAST(sum(n - 1) AS BIGINT) FROM
         (SELECT report_id, id, count(*) AS n FROM marked WHERE NOT bad GROUP BY ALL HAVING count(*) > 1) GROUP BY report_id""",
    ("findings_raw",),
)
def _(t: Tables) -> DataFrame:
    return filters.split_valid(suspect_findings(t))[1].select("report_id", "code", "rows")


@query(
    "flt_16_valid_findings",
    """SELECT report_id, id, arg_min(severity, (severity, status, event_id)) AS severity FROM findings_raw WHERE k % 13 <> 0 GROUP BY ALL""",
    ("findings_raw",),
)
def _(t: Tables) -> DataFrame:
    return filters.split_valid(suspect_findings(t))[0].select("report_id", "id", "severity")


@query(
    "flt_17_release_sources",
    "SELECT app_id, count(*) AS files FROM documents_src WHERE doc_id % 3 = 2 GROUP BY app_id",
    ("documents_src",),
)
def _(t: Tables) -> DataFrame:
    from sightline.operators.code_checks import release_sources

    doc = F.col("doc_id") % 3
    folder = F.when(doc == 0, "src/debug/").when(doc == 1, "app/src/androidTest/").otherwise("app/src/main/")
    return release_sources(t.documents_src.withColumn("path", F.concat(folder, "path"))).groupBy("app_id").agg(
        F.count(F.lit(1)).alias("files")
    )


_COMPLETE_SQL = """SELECT r.report_id, coalesce(c.partial, false) OR day(r.day) % 10 = 0 OR day(r.day) % 7 = 3 OR coalesce(f.bad, false) AS incomplete,
         coalesce(c.limited, false) OR coalesce(f.lim, false) AS limited
       FROM reports r LEFT JOIN (SELECT report_id, bool_or(state = 'partial') AS partial, bool_or(state = 'limited') AS limited FROM coverage GROUP BY report_id) c
         ON c.report_id = r.report_id
       LEFT JOIN (SELECT report_id, bool_or(k % 50 = 49) AS bad, bool_or(k % 50 = 48) AS lim FROM findings_raw GROUP BY report_id) f ON f.report_id = r.report_id"""


@query("flt_18_report_completeness", _COMPLETE_SQL, ("reports", "coverage"))
def _(t: Tables) -> DataFrame:
    day = F.dayofmonth("day")
    reports = t.reports.select(
        "report_id", (day % 10 == 0).alias("partial"), (day % 7 != 3).alias("fingerprint_complete")
    )
    k = F.col("k") % 50
    state = F.when(k == 49, "skipped").when(k == 48, "limited").otherwise("checked")
    return coverage.report_completeness(reports, t.coverage, t.findings_raw.select("report_id", state.alias("state")))


@query(
    "flt_18_strict_completeness",
    "SELECT report_id, bool_or(state IN ('partial', 'limited')) AS incomplete FROM coverage GROUP BY report_id",
    ("coverage",),
)
def _(t: Tables) -> DataFrame:
    return coverage.report_completeness(t.reports, t.coverage, strict=True).select("report_id", "incomplete")


@query(
    "flt_19_reports_under_roots",
    "SELECT report_id FROM reports WHERE target = 'app-3' OR target IN ('app-1', 'app-7')",
    ("reports",),
)
def _(t: Tables) -> DataFrame:
    # Targets become paths: apps 1 and 7 lie below the second root, app 17 would not.
    target = F.when(F.col("target").isin("app-1", "app-7"), F.concat(F.lit("/work/"), "target")).otherwise(F.col("target"))
    return filters.under_roots(t.reports.withColumn("target", target), ["app-3", "/work/"]).select("report_id")


@query(
    "flt_20_link_candidates",
    """WITH links AS (SELECT 'app-' || (o_custkey % 50) AS app_id, o_orderkey AS position,
          CASE WHEN o_custkey % 4 = 0 THEN 'https' ELSE 'app' END AS scheme,
          CASE o_orderkey % 6 WHEN 0 THEN '*.example.com' WHEN 1 THEN '' ELSE 'h' || (o_orderkey % 9) || '.example.com' END AS host,
          CASE WHEN o_orderkey % 5 = 0 THEN '8443' ELSE '' END AS port, o_orderkey % 11 = 0 AS embedded FROM orders),
        usable AS (SELECT app_id, position, scheme || '://' || CASE WHEN host = '' THEN 'test' ELSE host END || CASE WHEN port <> '' THEN ':' || port ELSE '' END || '/' AS url
          FROM links WHERE NOT embedded AND NOT contains(host, '*'))
        SELECT app_id, CAST(row_number() OVER (PARTITION BY app_id ORDER BY position) AS INTEGER) AS rank, url FROM usable""",
)
def _(t: Tables) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    links = t.orders.select(
        joined("app-", text(cust % 50)).alias("app_id"), key.alias("position"),
        F.when(cust % 4 == 0, "https").otherwise("app").alias("scheme"),
        F.when(key % 6 == 0, "*.example.com").when(key % 6 == 1, "").otherwise(joined("h", text(key % 9), ".example.com")).alias("host"),
        F.when(key % 5 == 0, "8443").otherwise("").alias("port"), F.lit(None).cast("string").alias("path"),
        F.lit("").alias("path_kind"), F.when(key % 11 == 0, "embedded").otherwise("app").alias("bundle_role"),
    )
    return filters.link_candidates(links)


# --- identity and matching ---------------------------------------------------------------------


@query(
    "agg_14_dedup_by_id",
    "SELECT report_id, id, severity, line FROM findings",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    return identity.dedup_last(t.findings_raw, ["report_id", "id"], ["event_id"]).select("report_id", "id", "severity", "line")


def advisory_side(t: Tables, parity: int) -> DataFrame:
    """Dependency findings of one side: part ``p`` shows advisory ``p // 3`` under a display id that depends on the side."""
    part = F.col("p_partkey")
    group = F.floor(part / 3)
    ghsa, cve = joined("GHSA-", text(group)), joined("CVE-2024-", text(group + 10000))
    shown = F.when((part + parity) % 4 == 0, ghsa).otherwise(cve) if parity else F.when(part % 5 == 0, ghsa).otherwise(cve)
    rows = t.part.where(part % (7 + parity) != 0).select(
        shown.alias("rule_id"), Tables.ecosystem(part).alias("ecosystem"), joined("org:lib", text(group)).alias("name"),
        joined("m", text(part % 3), "/pom.xml").alias("path"), F.array(ghsa, cve).alias("advisory_ids"), "p_size",
    )
    from sightline.functions.canonical import dependency_identity

    rows = rows.withColumn("id", dependency_identity(F.col("rule_id"), F.col("ecosystem"), F.col("name"), F.col("path")))
    return identity.with_dependency_identities(identity.dedup_last(rows, ["id"], ["p_size"]))


_SIDES_SQL = """base AS (SELECT p_partkey AS p, p_partkey // 3 AS g, CASE p_partkey % 4 WHEN 0 THEN 'Maven' WHEN 1 THEN 'npm' WHEN 2 THEN 'PyPI' ELSE 'Go' END AS e FROM part),
    cur AS (SELECT DISTINCT CASE WHEN p % 5 = 0 THEN 'GHSA-' || g ELSE 'CVE-2024-' || (g + 10000) END AS rule, e || '|org:lib' || g || '|m' || (p % 3) AS loc FROM base WHERE p % 7 <> 0),
    old AS (SELECT DISTINCT CASE WHEN (p + 1) % 4 = 0 THEN 'GHSA-' || g ELSE 'CVE-2024-' || (g + 10000) END AS rule, e || '|org:lib' || g || '|m' || (p % 3) AS loc FROM base WHERE p % 8 <> 0),
    edges AS (SELECT c.rule AS cr, o.rule AS orr, c.loc, c.rule = o.rule AS exact FROM cur c JOIN old o ON c.loc = o.loc),
    judged AS (SELECT *, bool_or(exact) OVER (PARTITION BY cr, loc) AS has_exact, count(*) FILTER (WHERE NOT exact) OVER (PARTITION BY cr, loc) AS aliases,
      count(*) OVER (PARTITION BY orr, loc) AS reached FROM edges),
    accepted AS (SELECT cr, orr, loc, CASE WHEN exact THEN 'identity' ELSE 'advisory-alias' END AS basis FROM judged
      WHERE exact OR (NOT has_exact AND aliases = 1 AND reached = 1))"""


@query(
    "jon_01_identity_match",
    f"WITH {_SIDES_SQL} SELECT cr AS current_rule, orr AS previous_rule, loc AS location, basis FROM accepted",
)
def _(t: Tables) -> DataFrame:
    current, previous = advisory_side(t, 0), advisory_side(t, 1)
    pairs = identity.match_identities(current, previous)
    place = F.concat_ws("|", "ecosystem", "name", F.regexp_replace("path", "/pom.xml", ""))
    left = current.select(F.col("id").alias("current_id"), F.col("rule_id").alias("current_rule"), place.alias("location"))
    right = previous.select(F.col("id").alias("previous_id"), F.col("rule_id").alias("previous_rule"))
    return pairs.join(left.hint("merge"), "current_id").join(right.hint("merge"), "previous_id").select("current_rule", "previous_rule", "location", "basis")


@query(
    "jon_02_advisory_rename_pairs",
    f"WITH {_SIDES_SQL} SELECT cr AS current_rule, orr AS previous_rule, count(*) AS locations FROM accepted WHERE basis = 'advisory-alias' GROUP BY ALL",
)
def _(t: Tables) -> DataFrame:
    current, previous = advisory_side(t, 0), advisory_side(t, 1)
    pairs = identity.alias_pairs(current, previous)
    left = current.select(F.col("id").alias("current_id"), F.col("rule_id").alias("current_rule"))
    right = previous.select(F.col("id").alias("previous_id"), F.col("rule_id").alias("previous_rule"))
    return pairs.join(left.hint("merge"), "current_id").join(right.hint("merge"), "previous_id").groupBy("current_rule", "previous_rule").agg(
        F.count(F.lit(1)).alias("locations")
    )


@query(
    "set_04_identity_union",
    "SELECT CAST(count(*) AS BIGINT) AS identities, count(DISTINCT id) AS distinct_ids FROM findings",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    every = F.array_union(F.array("id"), F.array("id", F.concat(F.lit("alias-"), "id")))
    rows = t.findings.select("report_id", F.explode(every).alias("v")).where(~F.col("v").startswith("alias-"))
    return rows.agg(F.count(F.lit(1)).alias("identities"), F.count_distinct("v").alias("distinct_ids"))


# --- comparison --------------------------------------------------------------------------------

_SIDES = """b AS (SELECT p.before_id, p.after_id, f.id, f.rule_id, f.severity, f.status, f.path FROM report_pairs p JOIN findings f ON f.report_id = p.before_id),
   a AS (SELECT p.before_id, p.after_id, f.id, f.rule_id, f.severity, f.status, f.path FROM report_pairs p JOIN findings f ON f.report_id = p.after_id)"""


@query(
    "jon_22_report_difference",
    f"""WITH {_SIDES} SELECT coalesce(a.before_id, b.before_id) AS before_id, coalesce(a.after_id, b.after_id) AS after_id, coalesce(a.id, b.id) AS id,
         CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'no-longer-observed' WHEN a.severity = b.severity AND a.status = b.status THEN 'unchanged' ELSE 'changed' END AS change,
         coalesce(b.severity, '') AS before_severity, coalesce(a.severity, '') AS after_severity
       FROM a FULL OUTER JOIN b ON a.before_id = b.before_id AND a.after_id = b.after_id AND a.id = b.id""",
    ("report_pairs", "findings"),
)
def _(t: Tables) -> DataFrame:
    return compare.difference(t.report_pairs, t.findings).select("before_id", "after_id", "id", "change", "before_severity", "after_severity")


def scopes(t: Tables) -> DataFrame:
    day = F.dayofmonth("day")
    return t.reports.select(
        "report_id", F.when(day % 9 != 0, F.concat("target", text(F.floor(day / 10)))).alias("scope_hash"),
        F.when(day % 6 != 0, F.concat("target", text(F.floor(day / 4)))).alias("fingerprint"),
    )


@query(
    "jon_21_report_pairing",
    f"""WITH {_SIDES}, s AS (SELECT report_id, CASE WHEN day(day) % 9 <> 0 THEN target || (day(day) // 10) END AS scope_hash,
            CASE WHEN day(day) % 6 <> 0 THEN target || (day(day) // 4) END AS fp FROM reports),
       o AS (SELECT coalesce(a.before_id, b.before_id) AS before_id, coalesce(a.after_id, b.after_id) AS after_id, coalesce(a.id, b.id) AS id,
         CASE WHEN b.id IS NULL THEN 'newly-observed' WHEN a.id IS NULL THEN 'no-longer-observed' ELSE 'still-observed' END AS observation
         FROM a FULL OUTER JOIN b ON a.before_id = b.before_id AND a.after_id = b.after_id AND a.id = b.id)
       SELECT o.*, CASE WHEN x.scope_hash IS NULL OR y.scope_hash IS NULL THEN 'unavailable' WHEN x.scope_hash = y.scope_hash THEN 'unchanged' ELSE 'changed' END AS scope_state,
         CASE WHEN x.fp IS NULL OR y.fp IS NULL THEN 'unavailable' WHEN x.fp = y.fp THEN 'same-build' ELSE 'different-builds' END AS build_state,
         CASE WHEN x.scope_hash = y.scope_hash THEN 'comparable-observation' ELSE 'inconclusive' END AS verification
       FROM o JOIN s x ON x.report_id = o.before_id JOIN s y ON y.report_id = o.after_id""",
    ("report_pairs", "findings", "reports"),
)
def _(t: Tables) -> DataFrame:
    return compare.observations(t.report_pairs, t.findings, scopes(t)).drop("before_status", "after_status")


@query(
    "jon_23_finding_follow_up",
    f"""WITH {_SIDES},
     st AS (SELECT report_id, rule_id, {RULE_STATE_SQL} AS state FROM coverage GROUP BY ALL),
     b2 AS (SELECT *, CASE WHEN substr(id, 3, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN path || '#fn' END AS anchor FROM b),
     a2 AS (SELECT *, CASE WHEN substr(id, 3, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN path || '#fn' END AS anchor FROM a),
     x AS (SELECT b2.before_id, b2.after_id, b2.id,
        EXISTS (SELECT 1 FROM a2 WHERE a2.after_id = b2.after_id AND a2.id = b2.id) AS exact,
        (SELECT count(DISTINCT a2.id) FROM a2 WHERE a2.after_id = b2.after_id AND a2.rule_id = b2.rule_id AND a2.path = b2.path AND a2.anchor = b2.anchor) AS anch,
        (SELECT count(DISTINCT a2.id) FROM a2 WHERE a2.after_id = b2.after_id AND a2.rule_id = b2.rule_id AND a2.path = b2.path AND a2.anchor IS NULL AND b2.anchor IS NULL) AS loose,
        (SELECT count(*) FROM a2 WHERE a2.after_id = b2.after_id AND a2.rule_id = b2.rule_id) AS total,
        coalesce(sa.state, 'not-run') <> 'checked' OR coalesce(sb.state, 'not-run') <> 'checked' AS uncovered
       FROM b2 LEFT JOIN st sa ON sa.report_id = b2.after_id AND sa.rule_id = b2.rule_id LEFT JOIN st sb ON sb.report_id = b2.before_id AND sb.rule_id = b2.rule_id)
     SELECT before_id, after_id, id, CASE WHEN exact THEN 'exact-id-observed' WHEN anch + loose > 0 THEN 'possible-continuation' WHEN total > 0 THEN 'same-rule-elsewhere' ELSE 'no-compatible-observation' END AS observation,
       concat_ws(',', CASE WHEN uncovered THEN 'rule-coverage-incomplete' END, CASE WHEN NOT exact AND anch + loose = 0 AND total > 0 THEN 'same-rule-elsewhere' END) AS blockers
     FROM x""",
    ("report_pairs", "findings", "coverage"),
)
def _(t: Tables) -> DataFrame:
    anchored = F.substring("id", 3, 1).isin(*"01234567")
    rows = t.findings.select(
        "report_id", "id", "rule_id", "path", F.when(anchored, F.concat("path", F.lit("#fn"))).alias("anchor")
    )
    chosen = t.report_pairs.select("before_id", "after_id").join(
        t.findings.select(F.col("report_id").alias("before_id"), "id"), "before_id"
    )
    whole = t.reports.select("report_id", F.lit(False).alias("incomplete"))
    return compare.follow_up(chosen, rows, rows, t.coverage, whole).select("before_id", "after_id", "id", "observation", "blockers")


@query(
    "jon_24_previous_runs",
    """WITH runs AS (SELECT 'run-' || event_id AS run_id, 'app-' || (user_id % 10) AS target, event_type AS scope, event_id AS seq,
         k % 5 <> 0 AS bound, k % 3 AS build, k % 2 AS scenario, k % 7 = 0 AS partial FROM events_k),
       p AS (SELECT *, lag({'id': run_id, 'bound': bound, 'build': build, 'scenario': scenario, 'partial': partial}) OVER (PARTITION BY target, scope ORDER BY seq) AS q FROM runs)
       SELECT run_id, coalesce(q.id, '') AS before_run_id,
         CASE WHEN q IS NOT NULL AND bound AND q.bound AND build = q.build THEN 'same-build' ELSE 'unavailable-or-different' END AS build_pairing,
         CASE WHEN q IS NOT NULL AND bound AND q.bound AND build = q.build AND scenario = q.scenario AND NOT partial AND NOT q.partial THEN 'comparable-observation' ELSE 'inconclusive' END AS verification
       FROM p""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    return compare.previous_runs(runtime_runs(t))


def runtime_runs(t: Tables) -> DataFrame:
    k = F.col("k")
    return t.events_k.select(
        joined("run-", text(F.col("event_id"))).alias("run_id"), joined("app-", text(F.col("user_id") % 10)).alias("target"),
        F.col("event_type").alias("scenario_scope"), F.col("event_id").alias("run_seq"),
        F.when(k % 5 != 0, "bound").otherwise("unavailable").alias("build_state"), text(k % 3).alias("build_identity"),
        text(k % 2).alias("scenario_identity"), (k % 7 == 0).alias("partial"),
        joined("app-", text(F.col("user_id") % 10), "@", F.date_format("day", "yyyy-MM-dd")).alias("report_id"),
    )


@query(
    "win_09_latest_run",
    """SELECT 'app-' || (user_id % 10) || '@' || strftime(day, '%Y-%m-%d') AS report_id, arg_max('run-' || event_id, event_id) AS run_id, arg_max(k % 7 = 0, event_id) AS partial
       FROM events_k GROUP BY 1""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    return compare.latest_runs(runtime_runs(t)).select("report_id", "run_id", "partial")


def dated_reports(t: Tables) -> DataFrame:
    day = F.dayofmonth("day")
    return t.reports.select(
        "report_id", "target", F.date_format("day", "yyyy-MM-dd").alias("created"), (day % 6 != 0).alias("complete"),
        text(F.floor(day / 8)).alias("signature"),
    )


@query(
    "agg_09_timeline",
    f"""WITH r AS (SELECT report_id, target, strftime(day, '%Y-%m-%d') AS created, day(day) % 6 <> 0 AS complete, CAST(day(day) // 8 AS VARCHAR) AS sig FROM reports),
      s AS (SELECT f.id, f.rule_id, r.* FROM findings f JOIN r ON r.report_id = f.report_id),
      e AS (SELECT target, id, min(created) AS first_seen, max(created) AS last_seen, arg_max(rule_id, created) AS rule_id, arg_max(sig, created) AS sig, count(*) AS observations FROM s GROUP BY target, id),
      able AS (SELECT r.target, c.rule_id, r.sig, r.created, r.report_id FROM (SELECT report_id, rule_id, {RULE_STATE_SQL} AS state FROM coverage GROUP BY ALL) c
        JOIN r ON r.report_id = c.report_id WHERE c.state = 'checked' AND r.complete),
      newest AS (SELECT target, max(created) AS created FROM r GROUP BY target)
      SELECT e.target, e.id, e.first_seen, e.last_seen, e.observations,
        coalesce((SELECT arg_min(a.report_id, a.created) FROM able a WHERE a.target = e.target AND a.rule_id = e.rule_id AND a.sig = e.sig AND a.created > e.last_seen), '') AS resolved_in,
        CASE WHEN NOT EXISTS (SELECT 1 FROM able a WHERE a.target = e.target AND a.rule_id = e.rule_id AND a.sig = e.sig AND a.created > e.last_seen) AND n.created > e.last_seen
             THEN e.target || '@' || n.created ELSE '' END AS inconclusive_in
      FROM e JOIN newest n ON n.target = e.target""",
    ("findings", "reports", "coverage"),
)
def _(t: Tables) -> DataFrame:
    rows = compare.timeline(t.findings.select("report_id", "id", "rule_id", "severity", "status"), dated_reports(t), t.coverage)
    return rows.select("target", "id", "first_seen", "last_seen", "observations", "resolved_in", "inconclusive_in")


@query(
    "agg_10_first_observed",
    """SELECT f.target, f.id, min(strftime(f.day, '%Y-%m-%d')) AS first_observed, any_value(r.n) AS reports, any_value(r.n) <= 29 AS complete
       FROM findings f JOIN (SELECT target, count(*) AS n FROM reports GROUP BY target) r ON r.target = f.target GROUP BY f.target, f.id""",
    ("findings", "reports"),
)
def _(t: Tables) -> DataFrame:
    return compare.first_observed(t.findings.select("report_id", "id"), dated_reports(t), limit=29)


def imported_and_native(t: Tables) -> tuple[DataFrame, DataFrame]:
    weakness = joined("W-", text(F.col("k") % 5))
    rows = t.findings.select(
        "report_id", "id", weakness.alias("weakness_id"), "origin",
        F.when(F.col("origin") == "external", F.concat(F.lit("repo/"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(F.col("k") % 10 != 0, F.col("line")).alias("line"),
    )
    return rows.where("origin = 'external'"), rows.where("origin = 'builtin'")


@query(
    "jon_14_corroboration",
    """WITH f AS (SELECT report_id, id, k % 5 AS w, origin, path, CASE WHEN k % 10 <> 0 THEN line END AS line FROM findings)
       SELECT x.report_id, x.id AS external_id, n.id AS native_id FROM f x JOIN f n ON x.report_id = n.report_id AND x.w = n.w AND x.path = n.path
       WHERE x.origin = 'external' AND n.origin = 'builtin' AND (x.line IS NULL OR n.line IS NULL OR abs(x.line - n.line) <= 20)""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    return compare.corroboration(*imported_and_native(t), line_window=20)


@query(
    "jon_14_corroboration_counts",
    """WITH f AS (SELECT report_id, id, k % 5 AS w, origin, path, CASE WHEN k % 10 <> 0 THEN line END AS line FROM findings),
       p AS (SELECT x.report_id, x.id AS external_id, n.id AS native_id FROM f x JOIN f n ON x.report_id = n.report_id AND x.w = n.w AND x.path = n.path
         WHERE x.origin = 'external' AND n.origin = 'builtin' AND (x.line IS NULL OR n.line IS NULL OR abs(x.line - n.line) <= 20)),
       c AS (SELECT 'external' AS side, report_id, external_id AS id, count(*) AS partners FROM p GROUP BY ALL
         UNION ALL SELECT 'native', report_id, native_id, count(*) FROM p GROUP BY ALL)
       SELECT CASE WHEN origin = 'external' THEN 'external' ELSE 'native' END AS side, f.report_id, f.id, coalesce(c.partners, 0) AS partners
       FROM f LEFT JOIN c ON c.report_id = f.report_id AND c.id = f.id AND c.side = CASE WHEN origin = 'external' THEN 'external' ELSE 'native' END""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    return compare.corroboration_counts(*imported_and_native(t), line_window=20).select("side", "report_id", "id", "partners")


@query(
    "jon_29_merge_engines",
    f"""WITH p AS (SELECT report_id, id, rule_id, severity, {RANK_SQL} AS r FROM findings WHERE origin = 'builtin'),
        x AS (SELECT report_id, id, 'LINT-' || upper(event_type) AS rule_id, severity, {RANK_SQL} AS r, 'RULE-' || upper(event_type) AS fact, event_type FROM findings WHERE origin = 'external'),
        one AS (SELECT report_id, rule_id, min(id) AS partner FROM p GROUP BY ALL HAVING count(*) = 1),
        placed AS (SELECT x.*, one.partner FROM x LEFT JOIN one ON one.report_id = x.report_id AND one.rule_id = x.fact AND x.event_type <> 'error'),
        s AS (SELECT report_id, partner, max(r) AS r FROM placed WHERE partner IS NOT NULL GROUP BY ALL)
        SELECT p.report_id, p.id, p.rule_id, CASE greatest(p.r, coalesce(s.r, 0)) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity,
          CASE WHEN s.r IS NULL THEN 'core' ELSE 'core,lint' END AS engines FROM p LEFT JOIN s ON s.report_id = p.report_id AND s.partner = p.id
        UNION ALL SELECT report_id, id, rule_id, severity, 'lint' FROM placed WHERE partner IS NULL""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    primary = t.findings.where("origin = 'builtin'").withColumn("engine", F.lit("core"))
    extra = t.findings.where("origin = 'external'").withColumn("engine", F.lit("lint")).withColumn(
        "check", F.col("event_type")
    ).withColumn("rule_id", joined("LINT-", F.upper("event_type")))
    overlap = t.local([(e, f"RULE-{e.upper()}") for e in ("click", "signup", "view", "purchase")], "check string, rule_id string")
    merged = compare.merge_engines(primary, extra, overlap)
    return merged.select("report_id", "id", "rule_id", "severity", F.concat_ws(",", "engines").alias("engines"))


@query(
    "jon_33_observation_merge",
    """SELECT coalesce(l.app_id, s.app_id) AS app_id, coalesce(l.path, s.path) AS path, coalesce(l.kind, s.kind) AS kind FROM
        (SELECT source AS app_id, 'f' || doc_id AS path, 'loader' AS kind FROM documents WHERE doc_id % 3 <> 0) l FULL OUTER JOIN
        (SELECT source AS app_id, 'f' || doc_id AS path, 'staged' AS kind FROM documents WHERE doc_id % 4 <> 0) s ON l.app_id = s.app_id AND l.path = s.path""",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("source").alias("app_id"), joined("f", text(F.col("doc_id"))).alias("path"), "doc_id")
    loader = rows.where("doc_id % 3 <> 0").select("app_id", "path", F.lit("loader").alias("kind"))
    staged = rows.where("doc_id % 4 <> 0").select("app_id", "path", F.lit("staged").alias("kind"))
    return compare.merge_observations(loader, staged)


@query(
    "set_06_replace_tool_results",
    """SELECT tool, origin, count(*) AS n FROM (SELECT 'tool-' || (k % 3) AS tool, origin FROM findings WHERE NOT (origin = 'external' AND k % 3 = 1)
        UNION ALL SELECT 'tool-1', 'external' FROM findings WHERE k % 20 = 0) GROUP BY ALL""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    rows = t.findings.select("report_id", "id", "origin", joined("tool-", text(F.col("k") % 3)).alias("tool"), "k")
    again = rows.where("k % 20 = 0").withColumn("tool", F.lit("tool-1")).withColumn("origin", F.lit("external"))
    out = compare.replace_tool_results(rows, again, t.local([("tool-1",)], "tool string"))
    return out.groupBy("tool", "origin").agg(F.count(F.lit(1)).alias("n"))


def claims(t: Tables) -> DataFrame:
    k = F.col("k")
    rows = t.findings_raw.select(
        joined("claim-", text(F.col("event_id"))).alias("claim_id"), "report_id",
        F.when(k % 3 != 0, F.col("path")).alias("path"), F.when(k % 3 == 1, F.col("line") + 2).alias("line"),
        F.when(k % 2 == 0, F.col("rule_id")).alias("rule_id"),
        F.when(k % 2 == 1, joined("W-", text(k % 4))).alias("weakness_id"),
    )
    return rows


CLAIM_BRIDGE = [("RULE-CLICK", "W-0"), ("RULE-VIEW", "W-1"), ("RULE-ERROR", "W-1"), ("RULE-SIGNUP", "W-3")]


@query(
    "jon_20_claim_verdicts",
    f"""WITH claims AS (SELECT 'claim-' || event_id AS claim_id, report_id, CASE WHEN k % 3 <> 0 THEN path END AS path, CASE WHEN k % 3 = 1 THEN line + 2 END AS line,
          CASE WHEN k % 2 = 0 THEN rule_id END AS rule_id, CASE WHEN k % 2 = 1 THEN 'W-' || (k % 4) END AS weakness_id FROM findings_raw),
        bridge AS (SELECT unnest(['RULE-CLICK', 'RULE-VIEW', 'RULE-ERROR', 'RULE-SIGNUP']) AS rule_id, unnest(['W-0', 'W-1', 'W-1', 'W-3']) AS weakness_id),
        checks AS (SELECT claim_id, report_id, rule_id FROM claims WHERE rule_id IS NOT NULL
          UNION ALL SELECT claim_id, report_id, b.rule_id FROM claims c JOIN bridge b ON b.weakness_id = c.weakness_id WHERE c.rule_id IS NULL),
        hits AS (SELECT c.claim_id, c2.path IS NULL OR f.path = c2.path AS in_file, c2.path IS NULL OR c2.line IS NULL OR abs(f.line - c2.line) <= 3 AS in_window
          FROM checks c JOIN findings f ON f.report_id = c.report_id AND f.rule_id = c.rule_id AND f.origin <> 'external' JOIN claims c2 ON c2.claim_id = c.claim_id),
        folded AS (SELECT claim_id, count(*) FILTER (WHERE in_file AND in_window) AS matches, count(*) FILTER (WHERE in_file AND NOT in_window) AS elsewhere FROM hits GROUP BY claim_id),
        rs AS (SELECT report_id, rule_id, {RULE_STATE_SQL} AS state FROM coverage GROUP BY ALL),
        obs AS (SELECT claim_id, {AGG_STATE_SQL} AS state FROM (SELECT c.claim_id, rs.state FROM checks c JOIN rs ON rs.report_id = c.report_id AND rs.rule_id = c.rule_id) GROUP BY claim_id),
        n AS (SELECT claim_id, count(*) AS checks FROM checks GROUP BY claim_id)
        SELECT c.claim_id, CASE WHEN coalesce(f.matches, 0) > 0 THEN 'corroborated' WHEN coalesce(n.checks, 0) = 0 THEN 'not-assessed' WHEN coalesce(f.elsewhere, 0) > 0 THEN 'same-file-other-location'
           WHEN c.path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM findings g WHERE g.report_id = c.report_id AND g.path = c.path) THEN 'file-not-analyzed'
           WHEN coalesce(o.state, 'not-run') IN ('partial', 'limited') THEN 'partial' WHEN o.state = 'checked' THEN 'not-observed' ELSE 'not-run' END AS verdict,
           coalesce(f.matches, 0) AS matches, coalesce(f.elsewhere, 0) AS elsewhere
        FROM claims c LEFT JOIN folded f ON f.claim_id = c.claim_id LEFT JOIN obs o ON o.claim_id = c.claim_id LEFT JOIN n ON n.claim_id = c.claim_id""",
    ("findings", "coverage"),
)
def _(t: Tables) -> DataFrame:
    bridge = t.local(CLAIM_BRIDGE, "rule_id string, weakness_id string")
    whole = t.reports.select("report_id", F.lit(False).alias("incomplete"))
    analyzed = t.findings.select("report_id", "path").distinct().withColumn("state", F.lit("checked"))
    out = compare.verify_claims(claims(t), t.findings, t.coverage, bridge, whole, analyzed)
    return out.select("claim_id", "verdict", "matches", "elsewhere")


@query(
    "set_02_changed_keys",
    f"""WITH {_SIDES} SELECT coalesce(a.after_id, b.after_id) AS after_id, coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS change
       FROM a FULL OUTER JOIN b ON a.after_id = b.after_id AND a.id = b.id WHERE a.severity || a.status IS DISTINCT FROM b.severity || b.status""",
    ("report_pairs", "findings"),
)
def _(t: Tables) -> DataFrame:
    rows = t.findings.withColumn("body", F.concat("severity", "status"))
    old, new = compare.paired_sides(t.report_pairs, rows)
    return compare.changed_keys(old, new, ["after_id", "id"])


@query(
    "set_03_expected_observed",
    """WITH e AS (SELECT DISTINCT report_id, rule_id FROM findings WHERE k % 3 < 2), o AS (SELECT DISTINCT report_id, rule_id FROM findings WHERE k % 3 > 0)
       SELECT coalesce(e.report_id, o.report_id) AS report_id, coalesce(e.rule_id, o.rule_id) AS rule_id,
         CASE WHEN o.report_id IS NULL THEN 'missing' WHEN e.report_id IS NULL THEN 'unexpected' ELSE 'matched' END AS label
       FROM e FULL OUTER JOIN o ON e.report_id = o.report_id AND e.rule_id = o.rule_id""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    return compare.expected_observed(t.findings.where("k % 3 < 2"), t.findings.where("k % 3 > 0"), ["report_id", "rule_id"])


@query(
    "agg_19_group_imported_results",
    f"""WITH r AS (SELECT id, severity, {RANK_SQL} AS r, status AS canonical, 'CWE-' || (k % 6) AS cwe, event_type || line AS obs FROM findings_raw)
        SELECT id, arg_min(severity, (-r, canonical)) AS severity, arg_min(canonical, (-r, canonical)) AS representative, count(*) AS observation_count,
          count(DISTINCT obs) > 5 AS truncated, (SELECT string_agg(o, ',' ORDER BY o) FROM (SELECT DISTINCT q.obs AS o FROM r q WHERE q.id = r.id ORDER BY o LIMIT 5)) AS observations,
          string_agg(DISTINCT cwe, ',' ORDER BY cwe) AS cwe FROM r GROUP BY id""",
    ("findings_raw",),
)
def _(t: Tables) -> DataFrame:
    rows = t.findings_raw.select(
        "id", "severity", F.col("status").alias("canonical"), F.array(joined("CWE-", text(F.col("k") % 6))).alias("cwe"),
        F.concat("event_type", text(F.col("line"))).alias("observation"),
    )
    out = compare.group_imported(rows, ["id"], keep=5)
    return out.select(
        "id", "severity", "representative", "observation_count", "truncated",
        F.array_join("observations", ",").alias("observations"), F.array_join("cwe", ",").alias("cwe"),
    )


# --- coverage ----------------------------------------------------------------------------------

BRIDGE = [("RULE-CLICK", "MASWE-0001"), ("RULE-CLICK", "MASWE-0005"), ("RULE-VIEW", "MASWE-0005"), ("RULE-ERROR", "MASWE-0007"),
          ("RULE-SIGNUP", "MASWE-0020"), ("RULE-PURCHASE", "MASWE-0007"), ("RULE-ABSENT", "MASWE-0029"), ("DEPENDENCY-CVE", "MASWE-0044")]
_BRIDGE_SQL = "bridge AS (SELECT unnest(%r) AS rule_id, unnest(%r) AS weakness_id)" % ([r for r, _ in BRIDGE], [w for _, w in BRIDGE])
TAXONOMY = [("MASWE-0001", ["android", "ios"], ["C-1"]), ("MASWE-0005", ["android"], ["C-1", "C-2"]), ("MASWE-0007", ["ios"], ["C-2"]),
            ("MASWE-0020", ["android", "ios"], ["C-3"]), ("MASWE-0029", ["android", "ios"], ["C-4"]), ("MASWE-0099", ["android"], ["C-5"])]


def bridge(t: Tables) -> DataFrame:
    return t.local(BRIDGE, "rule_id string, weakness_id string")


def taxonomy(t: Tables) -> DataFrame:
    return t.local([(w, p, m) for w, p, m in TAXONOMY], "id string, platform array<string>, masvs array<string>")


def platform_reports(t: Tables) -> DataFrame:
    return t.reports.select("report_id", F.array(F.when(F.dayofmonth("day") % 2 == 0, "android").otherwise("ios")).alias("platforms"))


@query(
    "agg_01_report_summary",
    """SELECT coalesce(f.report_id, c.report_id) AS report_id, coalesce(findings, 0) AS findings, coalesce(confirmed, 0) AS confirmed, coalesce(candidates, 0) AS candidates,
         coalesce(version_affected, 0) AS version_affected, coalesce(not_run, 0) AS not_run, coalesce(partial, 0) AS partial, coalesce(partial, 0) > 0 AS incomplete, coalesce(lim, 0) > 0 AS limited
       FROM (SELECT report_id, count(*) AS findings, count(*) FILTER (WHERE status IN ('runtime-confirmed', 'configuration-confirmed')) AS confirmed,
          count(*) FILTER (WHERE status = 'candidate') AS candidates, count(*) FILTER (WHERE status = 'version-affected') AS version_affected FROM findings GROUP BY report_id) f
       FULL OUTER JOIN (SELECT report_id, count(*) FILTER (WHERE state = 'not-run') AS not_run, count(*) FILTER (WHERE state = 'partial') AS partial,
          count(*) FILTER (WHERE state = 'limited') AS lim FROM coverage GROUP BY report_id) c ON f.report_id = c.report_id""",
    ("findings", "coverage"),
)
def _(t: Tables) -> DataFrame:
    return coverage.summarize(t.findings, t.coverage)


@query("agg_05_rule_state", f"SELECT report_id, rule_id, {RULE_STATE_SQL} AS state FROM coverage GROUP BY ALL", ("coverage",))
def _(t: Tables) -> DataFrame:
    return coverage.rule_states(t.coverage)


@query(
    "agg_06_aggregate_state",
    f"SELECT report_id, {AGG_STATE_SQL} AS state FROM (SELECT report_id, rule_id, {RULE_STATE_SQL} AS state FROM coverage GROUP BY ALL) GROUP BY report_id",
    ("coverage",),
)
def _(t: Tables) -> DataFrame:
    states = coverage.rule_states(t.coverage)
    return states.groupBy("report_id").agg(coverage.state_mask(F.col("state")).alias("m")).select(
        "report_id", coverage.aggregate_state(F.col("m")).alias("state")
    )


_TAXONOMY_SQL = "tax AS (SELECT unnest(%r) AS weakness_id, unnest(%r) AS plats)" % (
    [w for w, _, _ in TAXONOMY], [",".join(p) for _, p, _ in TAXONOMY]
)
_MATRIX_SQL = f"""{_BRIDGE_SQL}, {_TAXONOMY_SQL},
   rs AS (SELECT report_id, rule_id, {RULE_STATE_SQL} AS state FROM coverage GROUP BY ALL),
   cov AS (SELECT report_id, weakness_id, count(*) AS covered, {AGG_STATE_SQL} AS state FROM rs JOIN bridge USING (rule_id) GROUP BY report_id, weakness_id),
   fnd AS (SELECT report_id, weakness_id, count(DISTINCT id) AS n, bool_or(origin <> 'external') AS native FROM findings JOIN bridge USING (rule_id) GROUP BY report_id, weakness_id),
   chk AS (SELECT weakness_id, count(*) AS checks FROM bridge GROUP BY weakness_id),
   grid AS (SELECT r.report_id, CASE WHEN day(r.day) % 2 = 0 THEN 'android' ELSE 'ios' END AS plat, tax.weakness_id, tax.plats FROM reports r, tax),
   matrix AS (SELECT g.report_id, g.weakness_id, coalesce(chk.checks, 0) AS checks, coalesce(cov.covered, 0) AS checks_with_coverage,
     CASE WHEN NOT contains(g.plats, g.plat) THEN 'not-applicable' WHEN coalesce(chk.checks, 0) = 0 THEN 'not-assessed'
       WHEN coalesce(fnd.native, false) AND coalesce(cov.state, 'not-run') IN ('not-run', 'not-applicable') THEN 'partial' ELSE coalesce(cov.state, 'not-run') END AS state,
     coalesce(fnd.n, 0) AS finding_count FROM grid g LEFT JOIN chk USING (weakness_id) LEFT JOIN cov USING (report_id, weakness_id) LEFT JOIN fnd USING (report_id, weakness_id))"""


@query("agg_07_coverage_matrix", f"WITH {_MATRIX_SQL} SELECT * FROM matrix", ("findings", "coverage", "reports"))
def _(t: Tables) -> DataFrame:
    return coverage.coverage_matrix(platform_reports(t), t.coverage, t.findings, taxonomy(t), bridge(t), samples=50).drop("findings")


@query(
    "agg_07_matrix_state_histogram",
    f"WITH {_MATRIX_SQL} SELECT report_id, state, count(*) AS weaknesses FROM matrix GROUP BY ALL",
    ("findings", "coverage", "reports"),
)
def _(t: Tables) -> DataFrame:
    matrix = coverage.coverage_matrix(platform_reports(t), t.coverage, t.findings, taxonomy(t), bridge(t), samples=50)
    return matrix.groupBy("report_id", "state").agg(F.count(F.lit(1)).alias("weaknesses"))


@query(
    "srt_04_samples_per_weakness",
    f"""WITH {_BRIDGE_SQL}, d AS (SELECT DISTINCT report_id, weakness_id, id FROM findings JOIN bridge USING (rule_id) WHERE weakness_id <> 'MASWE-0044')
        SELECT report_id, weakness_id, string_agg(id, ',' ORDER BY id) AS samples FROM
         (SELECT *, row_number() OVER (PARTITION BY report_id, weakness_id ORDER BY id) AS rn FROM d) WHERE rn <= 3 GROUP BY ALL""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    matrix = coverage.coverage_matrix(t.reports.select("report_id"), t.coverage, t.findings, taxonomy(t), bridge(t), samples=3)
    return matrix.where("finding_count > 0").select("report_id", "weakness_id", F.array_join("findings", ",").alias("samples"))


@query(
    "agg_08_checklist_status",
    f"""WITH {_MATRIX_SQL},
      items AS (SELECT unnest(['I-1', 'I-2', 'I-3', 'I-4', 'I-5']) AS item_id),
      iw AS (SELECT unnest(['I-1', 'I-2', 'I-3', 'I-4']) AS item_id, unnest(['MASWE-0005', 'MASWE-0007', 'MASWE-0099', 'MASWE-0029']) AS weakness_id),
      ir AS (SELECT item_id, rule_id, false AS explicit FROM iw JOIN bridge USING (weakness_id) UNION ALL SELECT 'I-5', unnest(['RULE-SIGNUP', 'RULE-NEVER']), true),
      folded AS (SELECT report_id, item_id, {AGG_STATE_SQL} AS state FROM (
         SELECT rs.report_id, ir.item_id, rs.state FROM ir JOIN rs USING (rule_id)
         UNION ALL SELECT r.report_id, ir.item_id, 'not-run' FROM reports r, ir WHERE ir.explicit AND NOT EXISTS (SELECT 1 FROM rs WHERE rs.report_id = r.report_id AND rs.rule_id = ir.rule_id)) GROUP BY report_id, item_id),
      f AS (SELECT report_id, item_id, count(DISTINCT id) AS n FROM (SELECT report_id, item_id, id FROM findings JOIN bridge USING (rule_id) JOIN iw USING (weakness_id)
         UNION ALL SELECT report_id, item_id, id FROM findings JOIN ir USING (rule_id) WHERE ir.explicit) GROUP BY ALL),
      ex AS (SELECT report_id, item_id, bool_and(state = 'not-applicable') AS excluded FROM matrix JOIN iw USING (weakness_id) GROUP BY ALL),
      tot AS (SELECT item_id, count(*) AS checks FROM ir GROUP BY item_id)
      SELECT r.report_id, i.item_id, coalesce(tot.checks, 0) AS checks, coalesce(f.n, 0) AS finding_count,
        CASE WHEN coalesce(f.n, 0) > 0 THEN 'findings' WHEN coalesce(tot.checks, 0) = 0 THEN 'not-assessed' WHEN i.item_id <> 'I-5' AND coalesce(ex.excluded, false) THEN 'not-applicable'
          WHEN folded.state = 'checked' THEN 'no-findings-in-checked-scope' WHEN folded.state IN ('limited', 'partial') THEN folded.state ELSE 'not-run' END AS status
      FROM reports r CROSS JOIN items i LEFT JOIN tot USING (item_id) LEFT JOIN folded ON folded.report_id = r.report_id AND folded.item_id = i.item_id
      LEFT JOIN f ON f.report_id = r.report_id AND f.item_id = i.item_id LEFT JOIN ex ON ex.report_id = r.report_id AND ex.item_id = i.item_id""",
    ("findings", "coverage", "reports"),
)
def _(t: Tables) -> DataFrame:
    items = t.local(
        [("I-1", ["MASWE-0005"], []), ("I-2", ["MASWE-0007"], []), ("I-3", ["MASWE-0099"], []), ("I-4", ["MASWE-0029"], []),
         ("I-5", [], ["RULE-SIGNUP", "RULE-NEVER"])],
        "item_id string, weaknesses array<string>, rules array<string>",
    )
    matrix = coverage.coverage_matrix(platform_reports(t), t.coverage, t.findings, taxonomy(t), bridge(t), samples=50)
    return coverage.checklist_view(matrix, t.coverage, t.findings, items, bridge(t))


@query(
    "udf_03_custom_checklist",
    f"""WITH {_BRIDGE_SQL} SELECT report_id, 'C-1' AS item_id, count(DISTINCT id) AS finding_count FROM findings JOIN bridge USING (rule_id)
        WHERE weakness_id IN ('MASWE-0001', 'MASWE-0005') GROUP BY report_id""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    items = coverage.builtin_checklist(taxonomy(t))
    matrix = coverage.coverage_matrix(t.reports.select("report_id"), t.coverage, t.findings, taxonomy(t), bridge(t), samples=50)
    out = coverage.checklist_view(matrix, t.coverage, t.findings, items, bridge(t))
    return out.where("item_id = 'C-1' AND finding_count > 0").select("report_id", "item_id", "finding_count")


@query(
    "jon_30_finding_weaknesses",
    f"""WITH {_BRIDGE_SQL} SELECT weakness_id, count(*) AS n FROM (
          SELECT CASE WHEN k % 6 = 0 THEN 'MASWE-0090' ELSE weakness_id END AS weakness_id FROM findings f LEFT JOIN bridge b
            ON b.rule_id = CASE WHEN k % 5 = 0 THEN 'DEPENDENCY-CVE' ELSE f.rule_id END AND k % 6 <> 0 WHERE k % 6 = 0 OR weakness_id IS NOT NULL) GROUP BY weakness_id""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    rows = t.findings.withColumn("maswe", F.when(F.col("k") % 6 == 0, F.array(F.lit("MASWE-0090")))).withColumn(
        "origin", F.when(F.col("k") % 5 == 0, "intelligence").otherwise("builtin")
    )
    return coverage.finding_weaknesses(rows, bridge(t)).groupBy("weakness_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_20_export_rule_descriptors",
    f"""WITH f AS (SELECT report_id, rule_id, CASE WHEN status = 'candidate' THEN rule_id || '/candidate' ELSE rule_id END AS export_rule, status, {RANK_SQL} AS r, {STATUS_SQL} AS s FROM findings),
        g AS (SELECT report_id, export_rule, rule_id, count(*) AS results, max(r) AS top, max(r) FILTER (WHERE status <> 'candidate') AS rated, min(s) AS weakest FROM f GROUP BY ALL)
        SELECT report_id, export_rule, results, CASE WHEN rated >= 3 THEN 'error' WHEN rated = 2 THEN 'warning' WHEN rated IS NOT NULL THEN 'note' WHEN top >= 2 THEN 'warning' ELSE 'note' END AS level,
          CASE weakest WHEN 0 THEN 'medium' WHEN 3 THEN 'very-high' ELSE 'high' END AS precision,
          coalesce(CASE rated WHEN 4 THEN '9.5' WHEN 3 THEN '8.0' WHEN 2 THEN '5.5' WHEN 1 THEN '3.0' END, '') AS security_severity, rated IS NULL AS candidate_only FROM g""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    return coverage.export_rules(t.findings).drop("rule_id")


@query(
    "agg_21_coverage_notifications",
    """WITH g AS (SELECT report_id, rule_id, state, count(*) AS entries FROM (SELECT report_id, rule_id, CASE k % 12 WHEN 0 THEN 'not-run' WHEN 1 THEN 'partial' WHEN 2 THEN 'limited' END AS state FROM findings_raw)
          WHERE state IS NOT NULL GROUP BY ALL)
       SELECT report_id, CAST(row_number() OVER w AS INTEGER) AS position, rule_id, state, entries, CASE WHEN state = 'partial' THEN 'warning' ELSE 'note' END AS level,
         greatest(count(*) OVER (PARTITION BY report_id) - 4, 0) AS omitted FROM g WINDOW w AS (PARTITION BY report_id ORDER BY rule_id, state) QUALIFY row_number() OVER w <= 4""",
    ("findings_raw",),
)
def _(t: Tables) -> DataFrame:
    k = F.col("k") % 12
    state = F.when(k == 0, "not-run").when(k == 1, "partial").when(k == 2, "limited").otherwise("checked")
    return coverage.coverage_notifications(t.findings_raw.select("report_id", "rule_id", state.alias("state")), 4).drop("note")


# --- policy ------------------------------------------------------------------------------------

AS_OF = dt.datetime(2024, 1, 20, 12, 0, 0)


def waivers(t: Tables) -> DataFrame:
    """Waivers for the findings of every third user, expiring along January."""
    rows = t.findings_raw.where("user_id % 3 = 0").groupBy("id").agg(F.min("user_id").alias("u"))
    u = F.col("u")
    return rows.select(
        F.col("id").alias("finding_id"), F.date_add(F.lit(dt.date(2024, 1, 10)), (u % 20).cast("int")).alias("expires"),
        F.when(u % 4 == 0, F.lit(None)).when(u % 4 == 1, "low").otherwise("high").alias("severity"), (u % 5 == 0).alias("known_exploited"),
    )


_WAIVERS_SQL = """w AS (SELECT id AS finding_id, DATE '2024-01-10' + CAST(min(user_id) % 20 AS INTEGER) AS expires,
      CASE min(user_id) % 4 WHEN 0 THEN NULL WHEN 1 THEN 'low' ELSE 'high' END AS severity, min(user_id) % 5 = 0 AS ke FROM findings_raw WHERE user_id % 3 = 0 GROUP BY id)"""


@query(
    "jon_12_waived_findings",
    f"""WITH {_WAIVERS_SQL}, x AS (SELECT f.report_id, f.id, w.finding_id IS NOT NULL AS waived,
          coalesce({rank_sql('f.severity')} > {rank_sql('w.severity')} AND w.severity IS NOT NULL, false) OR (f.known_exploited AND w.severity IS NOT NULL AND NOT w.ke) AS worse
         FROM findings f LEFT JOIN w ON w.finding_id = f.id AND w.expires >= DATE '2024-01-20')
       SELECT report_id, id, waived, waived AND worse AS reopened, waived AND NOT worse AS suppressed FROM x""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    return policy.waiver_state(t.findings, waivers(t), AS_OF.date()).select("report_id", "id", "waived", "reopened", "suppressed")


_RENAMED_SQL = """f AS (SELECT p_partkey AS k, 'r' || (p_partkey % 5) AS report_id FROM part), s AS (SELECT report_id, k // 30 AS g, count(*) AS n FROM f WHERE k % 3 = 1 GROUP BY ALL)"""


def renamed_findings(t: Tables) -> DataFrame:
    """Findings with a location identity, and an alias of their own (k % 3 = 0) or one shared by thirty keys (k % 3 = 1)."""
    k = F.col("p_partkey")
    alias = F.when(k % 3 == 0, joined("A-", text(k))).when(k % 3 == 1, joined("S-", text(F.floor(k / 30))))
    own = F.array(joined("F-", text(k)), joined("L-", text(k)))
    return t.part.select(
        "p_partkey", joined("r", text(k % 5)).alias("report_id"), joined("F-", text(k)).alias("id"), F.lit("high").alias("severity"), F.lit("version-affected").alias("status"),
        F.lit(False).alias("known_exploited"), own.alias("own"), F.array_union(own, F.array_compact(F.array(alias))).alias("every"),
    )


@query(
    "jon_12_waivers_of_identities",
    f"""WITH {_RENAMED_SQL} SELECT f.report_id, 'F-' || k AS id, k % 4 = 0 OR (k % 3 = 1 AND coalesce(s.n, 0) = 1) AS waived FROM f LEFT JOIN s ON s.report_id = f.report_id AND s.g = f.k // 30""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    named = F.when(k % 12 == 0, joined("A-", text(k))).otherwise(joined("L-", text(k)))
    rows = t.part.where(k % 4 == 0).select(named.alias("finding_id")).unionByName(t.part.select(joined("S-", text(F.floor(k / 30))).alias("finding_id")).distinct())
    waived = rows.select("finding_id", F.lit(AS_OF.date()).alias("expires"), F.lit("high").alias("severity"), F.lit(False).alias("known_exploited"))
    return policy.waiver_state(renamed_findings(t), waived, AS_OF.date()).select("report_id", "id", "waived")


@query(
    "jon_13_baseline_of_renamed",
    """SELECT 'r' || (p_partkey % 5) AS report_id, 'F-' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'existing' ELSE 'new' END AS baseline FROM part""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    own = F.array(joined("P-", text(k)), joined("A-", text(k)))
    prior = t.part.where(k % 2 == 0).select(
        joined("r", text(k % 5)).alias("report_id"), joined("P-", text(k)).alias("id"), F.lit("high").alias("severity"), F.lit("version-affected").alias("status"), own.alias("own"), own.alias("every")
    )
    return policy.baseline_state(renamed_findings(t), prior).select("report_id", "id", "baseline")


@query(
    "jon_12_waiver_report",
    f"""WITH {_WAIVERS_SQL}, m AS (SELECT w.finding_id, count(f.id) AS matched,
          count(*) FILTER (WHERE w.severity IS NOT NULL AND ({rank_sql('f.severity')} > {rank_sql('w.severity')} OR (f.known_exploited AND NOT w.ke))) AS escalated FROM w LEFT JOIN findings f ON f.id = w.finding_id GROUP BY w.finding_id)
       SELECT w.finding_id, w.expires < DATE '2024-01-20' AS expired, m.matched, CASE WHEN w.expires < DATE '2024-01-20' THEN 0 ELSE m.escalated END AS escalated,
         CASE WHEN w.expires < DATE '2024-01-20' THEN 'expired-waiver' WHEN m.escalated > 0 THEN 'waiver-severity-escalated' WHEN w.severity IS NULL THEN 'waiver-severity-unrecorded' ELSE '' END AS notice
       FROM w JOIN m USING (finding_id)""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    return policy.waiver_report(t.findings, waivers(t), AS_OF.date()).select("finding_id", "expired", "matched", "escalated", "notice")


def baseline_rows(t: Tables) -> DataFrame:
    """The previous report's findings under the later report's id."""
    return t.report_pairs.select("before_id", "after_id").join(
        t.findings.select(F.col("report_id").alias("before_id"), "id", "severity", "status"), "before_id"
    ).select(F.col("after_id").alias("report_id"), "id", "severity", "status")


_BASE_SQL = f"""base AS (SELECT p.after_id AS report_id, f.id, {rank_sql('f.severity')} AS s, {status_sql('f.status')} AS t FROM report_pairs p JOIN findings f ON f.report_id = p.before_id),
     bl AS (SELECT f.*, CASE WHEN b.id IS NULL THEN 'new' WHEN b.s >= {rank_sql('f.severity')} AND b.t >= {status_sql('f.status')} THEN 'existing' ELSE 'escalated' END AS baseline
       FROM findings f LEFT JOIN base b ON b.report_id = f.report_id AND b.id = f.id)"""


@query("jon_13_baseline_cover", f"WITH {_BASE_SQL} SELECT report_id, id, baseline FROM bl", ("findings", "report_pairs"))
def _(t: Tables) -> DataFrame:
    return policy.baseline_state(t.findings, baseline_rows(t)).select("report_id", "id", "baseline")


@query(
    "jon_13_baseline_guards",
    """SELECT r.report_id, CASE WHEN day(r.day) % 5 = 0 THEN 'baseline-is-report' WHEN p.before_id IS NULL THEN 'baseline-required' WHEN day(r.day) % 4 = 0 THEN 'baseline-not-earlier'
         WHEN day(r.day) % 3 = 0 THEN 'baseline-target-mismatch' ELSE '' END AS problem FROM reports r LEFT JOIN report_pairs p ON p.after_id = r.report_id""",
    ("reports", "report_pairs"),
)
def _(t: Tables) -> DataFrame:
    rows = t.reports.join(t.report_pairs.select(F.col("after_id").alias("report_id"), "before_id"), "report_id", "left")
    day = F.dayofmonth("day")
    chosen = F.when(day % 5 == 0, F.col("report_id")).otherwise(F.col("before_id"))
    problem = policy.baseline_problem(
        F.col("report_id"), chosen, F.col("day"), F.when(day % 4 == 0, F.date_add("day", 1)).otherwise(F.date_sub("day", 1)),
        F.col("target"), F.when(day % 3 == 0, "other").otherwise(F.col("target")),
    )
    return rows.select("report_id", problem.alias("problem"))


@query(
    "agg_02_policy_gate",
    f"""WITH {_BASE_SQL}, {_WAIVERS_SQL},
       x AS (SELECT bl.*, bl.status <> 'candidate' AS eligible, coalesce(w.finding_id IS NOT NULL AND NOT (w.severity IS NOT NULL AND ({rank_sql('bl.severity')} > {rank_sql('w.severity')} OR (bl.known_exploited AND NOT w.ke))), false) AS suppressed
         FROM bl LEFT JOIN w ON w.finding_id = bl.id AND w.expires >= DATE '2024-01-20'),
       c AS (SELECT report_id, count(*) AS total, count(*) FILTER (WHERE NOT eligible) AS status_excluded, count(*) FILTER (WHERE eligible AND baseline = 'existing') AS baseline_existing,
          count(*) FILTER (WHERE eligible AND baseline = 'escalated') AS escalated, count(*) FILTER (WHERE eligible AND baseline <> 'existing' AND suppressed) AS waived,
          count(*) FILTER (WHERE eligible AND baseline <> 'existing' AND NOT suppressed) AS considered,
          count(*) FILTER (WHERE eligible AND baseline <> 'existing' AND NOT suppressed AND severity = 'critical') AS n_critical,
          count(*) FILTER (WHERE eligible AND baseline <> 'existing' AND NOT suppressed AND severity = 'high') AS n_high FROM x GROUP BY report_id),
       m AS (SELECT report_id, bool_or(state = 'partial') AS partial FROM coverage GROUP BY report_id),
       q AS (SELECT report_id, bool_and(state IN ('checked', 'not-applicable', 'limited')) AS ok FROM coverage WHERE rule_id = 'RULE-CLICK' GROUP BY report_id)
       SELECT c.*, CASE WHEN n_critical > 1 OR n_high > 3 THEN 'failed' ELSE 'incomplete' END AS state, CASE WHEN n_critical > 1 OR n_high > 3 THEN 4 ELSE 3 END AS exit_code,
         concat_ws(',', 'expired-waiver', CASE WHEN m.partial THEN 'partial-audit' END, CASE WHEN NOT coalesce(q.ok, false) THEN 'required-rule-incomplete' END,
           CASE WHEN n_critical > 1 THEN 'severity-threshold:critical' END, CASE WHEN n_high > 3 THEN 'severity-threshold:high' END) AS reasons
       FROM c LEFT JOIN m USING (report_id) LEFT JOIN q USING (report_id)""",
    ("findings", "coverage", "report_pairs"),
)
def _(t: Tables) -> DataFrame:
    rules = policy.Policy(thresholds={"critical": 1, "high": 3}, only_new=True, required_rules=("RULE-CLICK",))
    out = policy.evaluate(t.findings, t.coverage, rules, AS_OF, waivers(t), baseline_rows(t))
    return out.drop("n_medium", "n_low", "n_info")


@query(
    "udf_04_user_policy",
    """SELECT report_id, CASE WHEN n > 8 THEN 'failed' ELSE 'passed' END AS state FROM (SELECT report_id, count(*) FILTER (WHERE severity = 'low' AND status = 'candidate') AS n FROM findings GROUP BY report_id)""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    rules = policy.Policy(thresholds={"low": 1, "critical": -1, "high": -1}, allowed_statuses=("candidate",), fail_on_partial=False)
    rules.thresholds["low"] = 8
    return policy.evaluate(t.findings, t.coverage, rules, AS_OF).select("report_id", "state")


@query(
    "agg_03_required_rules",
    """SELECT r.report_id, q.rule_id, coalesce(c.ok, false) AS complete FROM reports r CROSS JOIN (SELECT unnest(['RULE-CLICK', 'RULE-NEVER']) AS rule_id) q
       LEFT JOIN (SELECT report_id, rule_id, bool_and(state IN ('checked', 'not-applicable')) AS ok FROM coverage GROUP BY ALL) c ON c.report_id = r.report_id AND c.rule_id = q.rule_id""",
    ("reports", "coverage"),
)
def _(t: Tables) -> DataFrame:
    return policy.required_rules(t.reports, t.coverage, ("RULE-CLICK", "RULE-NEVER"), strict=True)


def feeds(t: Tables) -> DataFrame:
    """One feed row per report and source, from the last event of each type."""
    k = F.col("at.k")
    return t.findings_raw.groupBy("report_id", "event_type").agg(F.max_by(F.struct("ts", "k", "day"), F.col("event_id")).alias("at")).select(
        "report_id", F.when(F.col("event_type") == "click", "cve").otherwise(F.col("event_type")).alias("source"),
        F.col("at.ts").alias("succeeded"), F.col("at.ts").alias("fetched_ok"),
        F.when(k % 4 == 0, "partial").when(k % 9 == 0, "error").otherwise("ok").alias("status"),
        (k % 6).cast("bigint").alias("pending"), (k % 2).cast("bigint").alias("retrying"), F.lit(False).alias("stale"), F.col("at.day").alias("day"),
    )


@query(
    "agg_04_feed_freshness",
    """WITH f AS (SELECT report_id, CASE WHEN event_type = 'click' THEN 'cve' ELSE event_type END AS source, arg_max(ts, event_id) AS ts, arg_max(k, event_id) AS k FROM findings_raw GROUP BY report_id, event_type)
       SELECT r.report_id, q.source, coalesce(f.ts <= TIMESTAMP '2024-01-20 12:05:00' AND f.ts >= TIMESTAMP '2024-01-15 12:00:00'
           AND (NOT (f.k % 4 = 0 OR f.k % 9 = 0) OR (q.source = 'cve' AND f.k % 4 = 0 AND f.k % 6 BETWEEN 1 AND 4 AND f.k % 2 = 0)), false) AS fresh
       FROM (SELECT DISTINCT report_id FROM f) r CROSS JOIN (SELECT unnest(['cve', 'view', 'absent']) AS source) q LEFT JOIN f ON f.report_id = r.report_id AND f.source = q.source""",
    ("findings_raw",),
)
def _(t: Tables) -> DataFrame:
    return policy.fresh_feeds(feeds(t), ("cve", "view", "absent"), AS_OF, 120, 4, keys=("report_id",))


@query(
    "srt_01_findings_by_severity",
    f"""SELECT report_id, id, CAST(row_number() OVER (ORDER BY {RANK_SQL} DESC, report_id, id) AS BIGINT) AS place FROM findings""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    from sightline.scale import numbered

    rows = t.findings.select("report_id", "id", (-ranks.severity_rank(F.col("severity"))).alias("weight"))
    return numbered(rows, [], ["weight", "report_id", "id"], "place").select("report_id", "id", "place")


@query(
    "srt_03_newest_reports",
    "SELECT report_id FROM reports ORDER BY day DESC, report_id DESC LIMIT 25",
    ("reports",),
)
def _(t: Tables) -> DataFrame:
    return t.reports.orderBy(F.col("day").desc(), F.col("report_id").desc()).limit(25).select("report_id")
