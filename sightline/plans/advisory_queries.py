"""Advisory queries: dependencies from line items, advisories and bulletins from parts, devices from customers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import cvss
from sightline.functions.versions import version_key
from sightline.operators import advisories as adv
from sightline.operators import coverage, deps
from sightline.plans.evidence_queries import rank_sql
from sightline.plans.registry import query
from sightline.plans.tables import Tables, joined, text


def rated_advisories(t: Tables) -> DataFrame:
    key = F.col("partkey")
    return t.advisories.withColumn("known_exploited", key % 21 == 0).withColumn(
        "advisory_ids", F.array_sort(F.array_distinct(F.concat(F.array("id", "osv_id"), "aliases")))
    )


_CORR_SQL = f"""m AS (SELECT d.app_id, a.id AS rule_id, d.ecosystem, d.name, d.version, d.path, d.confidence, a.partkey,
     CASE greatest(CASE WHEN a.malicious THEN 4 ELSE {rank_sql("coalesce(a.severity, 'medium')")} END, CASE WHEN a.partkey % 21 = 0 THEN 3 ELSE 0 END)
       WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity,
     CASE WHEN d.confidence = 'exact' THEN 'version-affected' ELSE 'candidate' END AS status, a.partkey % 21 = 0 AS known_exploited,
     'F-' || substr(sha256('["' || a.id || '","app",[{{"dependency":{{"ecosystem":"' || d.ecosystem || '","name":"' || d.name || '","path":"' || d.path || '"}}}}]]'), 1, 20) AS finding_id
   FROM deps d JOIN advisories a ON a.name = d.name AND a.ecosystem = d.ecosystem AND a.version = d.version WHERE NOT a.withdrawn)"""


@query(
    "jon_03_dependency_correlation",
    f"WITH {_CORR_SQL} SELECT app_id, finding_id, rule_id, version, severity, status, known_exploited FROM m",
    ("deps", "advisories"),
)
def _(t: Tables) -> DataFrame:
    return adv.correlate(t.deps, rated_advisories(t)).select(
        "app_id", "finding_id", "rule_id", "version", "severity", "status", "known_exploited"
    )


@query(
    "agg_11_merged_dependency_findings",
    f"""WITH {_CORR_SQL} SELECT app_id, finding_id, rule_id, CASE max({rank_sql('severity')}) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity,
         CASE WHEN bool_or(status = 'version-affected') THEN 'version-affected' ELSE 'candidate' END AS status, bool_or(known_exploited) AS known_exploited,
         count(DISTINCT version) AS versions, min(version) AS first_version,
         concat_ws(',', CASE WHEN any_value(partkey) % 5 = 0 THEN 'CVE-2023-' || (20000 + any_value(partkey)) END, CASE WHEN any_value(partkey) % 3 = 0 THEN 'CVE-2024-' || (10000 + any_value(partkey)) END, 'GHSA-' || any_value(partkey)) AS advisory_ids
       FROM m GROUP BY app_id, finding_id, rule_id""",
    ("deps", "advisories"),
)
def _(t: Tables) -> DataFrame:
    merged = adv.merge_dependency_findings(adv.correlate(t.deps, rated_advisories(t)))
    return merged.select(
        "app_id", "finding_id", "rule_id", "severity", "status", "known_exploited", "versions", "first_version",
        F.array_join("advisory_ids", ",").alias("advisory_ids"),
    )


def _entry(lower, upper=None, inclusive=None, status="affected", changes=None):
    none = F.lit(None).cast("string")
    lit = lambda v: v if v is not None and not isinstance(v, str) else F.lit(v).cast("string")
    return F.struct(
        lit(lower).alias("version"), (status if not isinstance(status, str) else F.lit(status)).alias("status"),
        none.alias("versionType"), lit(upper).alias("lessThan"), lit(inclusive).alias("lessThanOrEqual"),
        F.lit(changes).cast("boolean").alias("changes"),
    )


@query(
    "jon_04_version_ranges",
    """WITH x AS (SELECT DISTINCT d.partkey, d.version, CAST(split_part(d.version, '.', 1) AS INTEGER) * 100 + CAST(split_part(d.version, '.', 2) AS INTEGER) AS v, p_size AS s
         FROM deps d JOIN part ON p_partkey = d.partkey),
       y AS (SELECT partkey, version, list_filter([CASE WHEN v < (s % 5) * 100 + 4 THEN true END, CASE WHEN v >= (s % 5) * 100 + 4 AND v <= 900 THEN s % 3 <> 0 END,
           CASE WHEN s % 6 = 0 AND v >= 100 AND v < 300 THEN false END], lambda q: q IS NOT NULL) AS d FROM x)
       SELECT decision, count(*) AS versions FROM (SELECT CASE WHEN len(list_distinct(d)) <> 1 THEN 'unknown' WHEN d[1] THEN 'affected' ELSE 'unaffected' END AS decision FROM y) GROUP BY decision""",
    ("deps",),
)
def _(t: Tables) -> DataFrame:
    size = F.col("p_size")
    edge = joined(text(size % 5), ".4")
    ranges = F.array(
        _entry("0", upper=edge), _entry(edge, inclusive="9", status=F.when(size % 3 == 0, "unaffected").otherwise("affected")),
        _entry("1.0", upper="3.0", status=F.when(size % 6 == 0, "unaffected").otherwise("unknown")),
        _entry("n/a", upper="9"), _entry("not a version", upper="9"), _entry("0", upper="9", changes=True),
    ).cast(adv.RANGE_TYPE)
    keyed = t.part.select(F.col("p_partkey").alias("partkey"), adv.keyed_ranges(ranges).alias("ranges"))
    rows = t.deps.select("partkey", "version").distinct().join(keyed, "partkey")
    decided = adv.in_keyed_range(version_key(F.col("version")), F.col("ranges"))
    decision = F.when(decided.isNull(), "unknown").when(decided, "affected").otherwise("unaffected")
    return rows.groupBy(decision.alias("decision")).agg(F.count(F.lit(1)).alias("versions"))


@query(
    "jon_05_os_branch_ranges",
    """SELECT p_partkey, CASE WHEN p_size % 9 = 0 OR p_partkey % 8 = 0 OR p_size % 6 = 0 OR p_partkey % 10 = 0 THEN 'unknown'
          WHEN p_partkey % 6 < p_size % 6 THEN 'affected' ELSE 'outside' END AS decision FROM part""",
)
def _(t: Tables) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    custom = lambda upper: F.struct(
        F.lit("0").alias("version"), F.lit("affected").alias("status"), F.lit("custom").alias("versionType"),
        upper.alias("lessThan"), F.lit(None).cast("string").alias("lessThanOrEqual"), F.lit(None).cast("boolean").alias("changes"),
    )
    minor = text(size % 6)
    ranges = F.array(custom(joined("17.", minor)), custom(F.lit("16.7"))).cast(adv.RANGE_TYPE)
    # Part sizes that are multiples of six have the boundary 17.0 the label below does not name.
    label = F.when(size % 6 == 0, "iOS 17.9").otherwise(joined("iOS 17.", minor, " and iPadOS 17.", minor))
    assigner = F.when(size % 9 == 0, "other").otherwise(adv.OS_CNA)
    link = F.when(key % 8 == 0, "https://example.com/x").otherwise("https://support.apple.com/en-us/1")
    version = F.when(key % 10 == 0, "17.x").otherwise(joined("17.", text(key % 6)))
    decided = adv.os_branch_decision(
        version, F.lit("Apple"), ranges, assigner, F.lit(adv.OS_CNA), F.array(link, F.lit("https://a.example")),
        F.lit("apple"), F.array(link), label, "ios",
    )
    return t.part.select("p_partkey", F.when(decided.isNull(), "unknown").when(decided, "affected").otherwise("outside").alias("decision"))


_SCOPE_NAMES = ("Qualcomm components", "Kernel", "Framework", "MediaTek parts")


def bulletins(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    names = F.array(*[F.lit(n) for n in _SCOPE_NAMES])
    return t.part.select(
        joined("CVE-2024-", text(key + 30000)).alias("id"), F.when(key % 15 == 0, "ios").otherwise("android").alias("platform"),
        F.get(names, (key % 4).cast("int")).alias("component"), F.lit(None).cast("string").alias("vendor_scope"),
        joined("20", text(key % 3 + 23), "-", F.lpad(text(F.col("p_size") % 12 + 1), 2, "0"), "-05").alias("fixed_patch_level"),
        F.lit("12, 13, 14").alias("updated_versions"),
    )


_PATCH_SQL = """b AS (SELECT 'CVE-2024-' || (p_partkey + 30000) AS id, CASE WHEN p_partkey % 15 = 0 THEN 'ios' ELSE 'android' END AS platform,
     ['qualcomm', 'kernel', 'platform', 'mediatek'][1 + p_partkey % 4] AS scope, CAST('20' || (p_partkey % 3 + 23) || '-' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || '-05' AS DATE) AS fixed
     FROM part),
   d AS (SELECT *, CASE WHEN soc_manufacturer LIKE 'Qual%' THEN 'qualcomm' WHEN soc_manufacturer = 'MTK' THEN 'mediatek' WHEN soc_manufacturer LIKE 'Sam%' THEN 'samsung' ELSE '' END AS soc,
      TRY_CAST(security_patch AS DATE) AS sp, TRY_CAST(vendor_security_patch AS DATE) AS vp FROM devices),
   j AS (SELECT b.*, d.*, least(d.sp, CASE WHEN b.scope <> 'platform' THEN d.vp END) AS actual FROM b JOIN d ON b.platform = d.platform),
   s AS (SELECT *, CASE WHEN simulator THEN 'simulator-only' WHEN platform <> 'android' OR actual IS NULL THEN 'device-info-required' WHEN actual >= fixed THEN 'vendor-patch-level-satisfied'
      WHEN version IN ('12', '13', '14') THEN 'potentially-affected' ELSE 'applicability-unknown' END AS state,
      CASE WHEN scope IN ('qualcomm', 'mediatek') AND soc <> '' AND NOT simulator AND platform = 'android' THEN CASE WHEN soc = scope THEN 'match' ELSE 'mismatch' END ELSE 'unknown' END AS chipset_vendor FROM j)"""


@query(
    "jon_06_patch_level_states",
    f"WITH {_PATCH_SQL} SELECT id, state, count(*) AS devices FROM s GROUP BY ALL",
    ("devices",),
)
def _(t: Tables) -> DataFrame:
    return adv.patch_state_counts(adv.posture_classes(t.devices), bulletins(t))


@query(
    "jon_07_chipset_vendor_match",
    f"WITH {_PATCH_SQL} SELECT scope, chipset_vendor, count(*) AS pairs FROM s GROUP BY ALL",
    ("devices",),
)
def _(t: Tables) -> DataFrame:
    states = adv.patch_states(adv.posture_classes(t.devices), bulletins(t))
    return states.groupBy("scope", "chipset_vendor").agg(F.sum("devices").alias("pairs"))


def records(t: Tables) -> DataFrame:
    return t.advisories.withColumn("key", F.col("partkey"))


@query(
    "jon_08_known_exploited",
    """SELECT id, (partkey % 3 = 0 AND partkey % 7 = 0) OR (partkey % 5 = 0 AND partkey % 11 = 0) OR partkey % 26 = 0 AS known_exploited FROM advisories""",
    ("advisories",),
)
def _(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    listed = F.array_compact(
        F.array(
            F.when(key % 7 == 0, joined("CVE-2024-", text(key + 10000))), F.when(key % 11 == 0, joined("CVE-2023-", text(key + 20000))),
            F.when(key % 26 == 0, joined("GHSA-", text(key))),
        )
    )
    exploited = t.part.select(F.explode(listed).alias("id"))
    return adv.known_exploited(records(t), exploited).select("id", "known_exploited")


@query(
    "jon_09_rejected_display_ids",
    """WITH x AS (SELECT partkey, osv_id, CASE WHEN cve_a IS NOT NULL AND partkey % 9 <> 0 THEN cve_a END AS a, CASE WHEN cve_b IS NOT NULL AND partkey % 10 <> 0 THEN cve_b END AS b, id, cve_a, cve_b FROM advisories),
         y AS (SELECT *, CASE WHEN id = cve_b AND b IS NULL OR (id = cve_a AND a IS NULL) OR (id = osv_id AND partkey % 44 = 0) THEN true ELSE false END AS gone FROM x)
       SELECT partkey, CASE WHEN gone THEN coalesce(least(a, b), osv_id) ELSE id END AS id FROM y WHERE NOT (gone AND partkey % 44 = 0)""",
    ("advisories",),
)
def _(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    listed = F.array_compact(
        F.array(
            F.when(key % 9 == 0, joined("CVE-2024-", text(key + 10000))), F.when(key % 10 == 0, joined("CVE-2023-", text(key + 20000))),
            F.when(key % 44 == 0, joined("GHSA-", text(key))),
        )
    )
    return adv.without_rejected(records(t), t.part.select(F.explode(listed).alias("id"))).select("partkey", "id")


@query(
    "jon_10_equivalent_ids",
    """SELECT partkey, concat_ws(',', cve_b, CASE WHEN partkey % 9 <> 0 OR id = cve_a THEN cve_a END,
         CASE WHEN NOT withdrawn OR id = osv_id THEN osv_id END) AS ids FROM advisories""",
    ("advisories",),
)
def _(t: Tables) -> DataFrame:
    key = F.col("partkey")
    none = F.array().cast("array<string>")
    rejected = F.when((key % 9 == 0) & (F.col("id") != F.coalesce("cve_a", F.lit(""))), F.array_compact(F.array("cve_a"))).otherwise(none)
    members = F.when(F.col("withdrawn"), none).otherwise(F.array("osv_id"))
    ids = adv.equivalent_ids(F.col("id"), members, F.col("aliases"), rejected)
    return t.advisories.select("partkey", F.array_join(ids, ",").alias("ids"))


@query(
    "jon_11_exact_package_feeds",
    """WITH r AS (SELECT id, 'osv:' || ecosystem || ':' || name || ':' || version AS source, size AS modified FROM advisories),
         d AS (SELECT DISTINCT 'osv:' || ecosystem || ':' || name || ':' || version AS source FROM deps)
       SELECT id, source FROM r WHERE source IN (SELECT source FROM d) UNION SELECT id, source FROM (SELECT * FROM r ORDER BY modified DESC, id, source LIMIT 40)""",
    ("deps", "advisories"),
)
def _(t: Tables) -> DataFrame:
    rows = t.advisories.select(
        "id", F.concat_ws(":", F.lit("osv"), "ecosystem", "name", "version").alias("source"), F.col("size").alias("modified"), F.lit("").alias("branch")
    )
    return adv.correlation_window(rows, t.deps, 40).select("id", "source")


@query(
    "agg_12_os_finding_references",
    """SELECT DISTINCT 'OS-' || (partkey % 40) AS finding_id, brand AS branch, reference FROM advisories""",
    ("advisories",),
)
def _(t: Tables) -> DataFrame:
    rows = t.advisories.select(joined("OS-", text(F.col("partkey") % 40)).alias("finding_id"), F.col("brand").alias("branch"), F.array("reference").alias("references"))
    return adv.os_finding_rows(rows)


@query(
    "agg_12_os_finding_merge",
    """SELECT 'OS-' || (partkey % 40) AS finding_id, count(DISTINCT brand) AS branches, count(DISTINCT reference) AS "references" FROM advisories GROUP BY 1""",
    ("advisories",),
)
def _(t: Tables) -> DataFrame:
    rows = t.advisories.select(joined("OS-", text(F.col("partkey") % 40)).alias("finding_id"), F.col("brand").alias("branch"), F.array("reference").alias("references"))
    return adv.merge_os_findings(rows).select("finding_id", "branches", "references")


def branch_entries(t: Tables) -> DataFrame:
    return t.advisories.select(
        joined("CVE-", text(F.col("partkey") % 60)).alias("id"), F.col("kind").alias("state"), F.lit("android").alias("platform"),
        F.col("brand").alias("component"), F.lit("").alias("fixed_release"), F.lit("").alias("fixed_patch_level"), F.lit("").alias("updated_versions"),
        F.lit("h").alias("snapshot_hash"), F.array("reference", F.lit("https://a.example")).alias("references"),
    )


@query(
    "agg_13_advisory_branches",
    """SELECT 'CVE-' || (partkey % 60) AS id, kind AS state, brand AS component, count(*) AS entries, count(DISTINCT reference) + 1 AS reference_count FROM advisories GROUP BY ALL""",
    ("advisories",),
)
def _(t: Tables) -> DataFrame:
    return adv.dedup_branches(branch_entries(t))[0].select("id", "state", "component", "entries", "reference_count")


@query(
    "agg_13_branch_references",
    """SELECT DISTINCT 'CVE-' || (partkey % 60) AS id, kind AS state, brand AS component, unnest([reference, 'https://a.example']) AS reference FROM advisories""",
    ("advisories",),
)
def _(t: Tables) -> DataFrame:
    return adv.dedup_branches(branch_entries(t))[1].select("id", "state", "component", "reference")


def members(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        Tables.ecosystem(F.floor(key / 12)).alias("source"), joined("D-", text(F.floor(key / 6))).alias("id"), joined("M-", text(F.floor(key / 2))).alias("osv_id"),
        F.when(size % 5 == 0, F.lit(None)).when(size % 5 == 1, "critical").when(size % 5 == 2, "high").otherwise("low").alias("severity"),
        F.when(key % 3 == 0, joined("2024-01-", F.lpad(text(size % 28 + 1), 2, "0"))).alias("withdrawn"),
        joined("2024-", text(size % 3)).alias("modified"), F.col("p_brand").alias("body_hash"),
        F.array(joined("CVE-", text(key % 50)), joined("CVE-", text(size))).alias("aliases"),
    )


_MEMBERS_SQL = """mem AS (SELECT CASE (p_partkey // 12) % 4 WHEN 0 THEN 'Maven' WHEN 1 THEN 'npm' WHEN 2 THEN 'PyPI' ELSE 'Go' END AS source, 'D-' || (p_partkey // 6) AS id, 'M-' || (p_partkey // 2) AS osv_id,
     CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'critical' WHEN 2 THEN 'high' ELSE 'low' END AS severity,
     CASE WHEN p_partkey % 3 = 0 THEN '2024-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') END AS withdrawn, '2024-' || (p_size % 3) AS modified, p_brand AS body_hash,
     'CVE-' || (p_partkey % 50) AS al1, 'CVE-' || p_size AS al2 FROM part),
   newest AS (SELECT source, osv_id, max(modified) AS modified FROM mem GROUP BY ALL),
   bodies AS (SELECT m.source, m.osv_id, count(DISTINCT body_hash) AS n FROM mem m JOIN newest USING (source, osv_id, modified) GROUP BY ALL)"""


@query("agg_16_latest_member_revisions", f"WITH {_MEMBERS_SQL} SELECT m.source, m.osv_id, any_value(m.modified) AS modified, any_value(body_hash) AS body_hash FROM mem m JOIN newest USING (source, osv_id, modified) JOIN bodies b USING (source, osv_id) WHERE b.n = 1 GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return adv.latest_members(members(t))[0].select("source", "osv_id", "modified", "body_hash")


@query("agg_16_revision_conflicts", f"WITH {_MEMBERS_SQL} SELECT source, osv_id FROM bodies WHERE n > 1")
def _(t: Tables) -> DataFrame:
    return adv.latest_members(members(t))[1].select("source", "osv_id")


@query(
    "agg_15_advisories_by_display_id",
    f"""WITH {_MEMBERS_SQL}, r AS (SELECT *, withdrawn IS NULL AS act, {rank_sql("coalesce(severity, 'medium')")} AS r FROM mem),
         b AS (SELECT source, id, arg_max(osv_id, (act, r, osv_id)) AS osv_id, count(*) AS members, bool_or(act) AS any_act, max(withdrawn) AS w FROM r GROUP BY ALL),
         al AS (SELECT source, id, count(DISTINCT a) AS alias_count, min(a) AS first_alias FROM (SELECT source, id, unnest([al1, al2]) AS a FROM mem) GROUP BY ALL)
       SELECT source, id, osv_id, members, CASE WHEN any_act THEN '' ELSE w END AS withdrawn, alias_count, first_alias FROM b JOIN al USING (source, id)""",
)
def _(t: Tables) -> DataFrame:
    out = adv.group_members(members(t))
    return out.select("source", "id", "osv_id", "members", F.coalesce("withdrawn", F.lit("")).alias("withdrawn"), "alias_count", "first_alias")


@query(
    "agg_15_member_unions",
    f"""WITH {_MEMBERS_SQL}, several AS (SELECT source, id, count(DISTINCT osv_id) > 1 AS many FROM mem GROUP BY ALL),
       v AS (SELECT source, id, osv_id, withdrawn, 'alias' AS kind, unnest([al1, al2]) AS value FROM mem
         UNION ALL SELECT source, id, osv_id, withdrawn, 'reference', 'https://x.example/' || modified FROM mem
         UNION ALL SELECT m.source, m.id, osv_id, withdrawn, 'affected', '{{"fixed":"' || coalesce(severity, 'none') || '"}}' FROM mem m JOIN several s ON s.source = m.source AND s.id = m.id
           WHERE NOT (many AND withdrawn IS NOT NULL))
       SELECT source, id, kind, value, count(DISTINCT osv_id) AS members, coalesce(min(osv_id) FILTER (WHERE withdrawn IS NULL), min(osv_id)) AS first_member,
         bool_or(withdrawn IS NULL) AS active FROM v GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    rows = members(t).withColumn("references", F.array(joined("https://x.example/", F.col("modified"))))
    affected = F.array(joined('{"fixed":"', F.coalesce("severity", F.lit("none")), '"}'))
    return adv.member_unions(rows.withColumn("affected", affected))


_V3 = "'CVSS:3.1/AV:' || ['N','A','L','P'][1 + p_partkey % 4] || '/AC:' || ['L','H'][1 + p_size % 2] || '/PR:' || ['N','L','H'][1 + p_partkey % 3] || '/UI:' || ['N','R'][1 + p_partkey % 2] || '/S:' || ['U','C'][1 + (p_size // 2) % 2] || '/C:' || ['H','L','N'][1 + p_size % 3] || '/I:' || ['H','L','N'][1 + (p_size // 3) % 3] || '/A:' || ['H','L','N'][1 + (p_size // 9) % 3]"


@query(
    "agg_17_severity_from_vectors",
    """WITH w AS (SELECT p_partkey, p_size, [0.85, 0.62, 0.55, 0.2][1 + p_partkey % 4] AS av, [0.77, 0.44][1 + p_size % 2] AS ac, (p_size // 2) % 2 AS ch,
           CASE WHEN (p_size // 2) % 2 = 1 THEN [0.85, 0.68, 0.5][1 + p_partkey % 3] ELSE [0.85, 0.62, 0.27][1 + p_partkey % 3] END AS pr, [0.85, 0.62][1 + p_partkey % 2] AS ui,
           [0.56, 0.22, 0.0][1 + p_size % 3] AS c, [0.56, 0.22, 0.0][1 + (p_size // 3) % 3] AS i, [0.56, 0.22, 0.0][1 + (p_size // 9) % 3] AS a FROM part),
         x AS (SELECT *, CAST(1 - (1 - c) * (1 - i) * (1 - a) AS DOUBLE) AS iss, 8.22::DOUBLE * av * ac * pr * ui AS ex FROM w),
         y AS (SELECT *, CASE WHEN ch = 1 THEN 7.52::DOUBLE * (iss - 0.029) - 3.25 * pow(iss - 0.02, 15) ELSE 6.42::DOUBLE * iss END AS im FROM x),
         z AS (SELECT *, CAST(round(least(CASE WHEN ch = 1 THEN 1.08 * (im + ex) ELSE im + ex END, 10) * 100000) AS BIGINT) AS s FROM y),
         sc AS (SELECT p_partkey, p_size, CASE WHEN im <= 0 THEN 0 WHEN s % 10000 = 0 THEN s / 100000.0 ELSE ((s // 10000) + 1) / 10.0 END AS score FROM z),
         d AS (SELECT *, CASE p_partkey % 10 WHEN 0 THEN 10 WHEN 1 THEN 5 END AS ds FROM sc)
       SELECT p_partkey, CASE WHEN ds IS NOT NULL AND ds > score OR (ds = score AND p_partkey % 10 = 1 AND false) THEN CASE ds WHEN 10 THEN 'critical' ELSE 'medium' END
          WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'info' END AS severity FROM d""",
)
def _(t: Tables) -> DataFrame:
    pick = lambda values, index: F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    vector = joined(
        "CVSS:3.1/AV:", pick("NALP", key % 4), "/AC:", pick("LH", size % 2), "/PR:", pick("NLH", key % 3), "/UI:", pick("NR", key % 2),
        "/S:", pick("UC", F.floor(size / 2) % 2), "/C:", pick("HLN", size % 3), "/I:", pick("HLN", F.floor(size / 3) % 3),
        "/A:", pick("HLN", F.floor(size / 9) % 3),
    )
    metrics = F.array(
        F.struct(F.lit("CVSS_V3").alias("type"), vector.alias("score")), F.struct(F.lit("CVSS_V3").alias("type"), F.lit("broken").alias("score"))
    )
    declared = F.when(key % 10 == 0, "CRITICAL").when(key % 10 == 1, "moderate")
    return t.part.select("p_partkey", cvss.advisory_severity(metrics, declared)["severity"].alias("severity"))


@query("udf_06_version_sort_key", "SELECT l_partkey, min(l_linenumber * 1000 + CAST(l_quantity AS INTEGER)) AS least, max(l_linenumber * 1000 + CAST(l_quantity AS INTEGER)) AS greatest FROM lineitem GROUP BY l_partkey")
def _(t: Tables) -> DataFrame:
    # 1.2rc9 < 1.2rc10: the key must order numbers, not digits.
    version = joined(text(F.col("l_linenumber")), ".0rc", text(F.col("l_quantity").cast("int")))
    rows = t.lineitem.select("l_partkey", (F.col("l_linenumber") * 1000 + F.col("l_quantity").cast("int")).alias("n"), version_key(version).alias("k"))
    return rows.groupBy("l_partkey").agg(F.min_by("n", "k").alias("least"), F.max_by("n", "k").alias("greatest"))


@query(
    "agg_18_malicious_packages",
    "SELECT partkey, malicious AND NOT withdrawn AS malicious FROM advisories",
    ("advisories",),
)
def _(t: Tables) -> DataFrame:
    ids = F.array("id", F.when(F.col("malicious"), joined("MAL-", text(F.col("partkey")))).otherwise(F.col("osv_id")))
    members_col = F.array(F.struct(ids.alias("ids"), F.col("withdrawn").alias("withdrawn")))
    return t.advisories.select("partkey", adv.is_malicious(members_col).alias("malicious"))


AS_OF = dt.datetime(2024, 1, 25, 0, 0, 0)


def os_feeds(t: Tables) -> DataFrame:
    names = F.when(F.col("event_type") == "click", "android").when(F.col("event_type") == "view", "apple").otherwise(F.col("event_type"))
    last = t.events_k.groupBy(names.alias("source")).agg(F.max(F.when(F.col("k") % 2 == 0, F.col("ts"))).alias("succeeded"), F.max_by("k", "event_id").alias("k"))
    return last.select("source", "succeeded", F.when(F.col("k") % 2 == 0, "ok").otherwise("error").alias("status"), (F.col("k") % 3 == 0).alias("stale"))


_FEEDS_SQL = """feeds AS (SELECT CASE event_type WHEN 'click' THEN 'android' WHEN 'view' THEN 'apple' ELSE event_type END AS source, max(CASE WHEN k % 2 = 0 THEN ts END) AS succeeded, arg_max(k, event_id) AS k FROM events_k GROUP BY 1),
   fs AS (SELECT source, succeeded, CASE WHEN k % 2 = 0 THEN 'ok' ELSE 'error' END AS status, k % 3 = 0 AS stale FROM feeds)"""


@query(
    "agg_22_platform_coverage",
    f"""WITH {_FEEDS_SQL} SELECT d.device_id, 'OS-CVE' AS rule_id, CASE WHEN d.platform = 'ios' OR coalesce(fs.status = 'ok' AND NOT fs.stale, false) THEN 'partial' ELSE 'not-run' END AS state,
         coalesce(fs.status, 'unavailable') AS feed_status FROM devices d LEFT JOIN fs ON fs.source = CASE d.platform WHEN 'android' THEN 'android' ELSE 'apple' END""",
    ("devices", "events_k"),
)
def _(t: Tables) -> DataFrame:
    return coverage.feed_coverage(t.devices, bulletins(t).where("platform = 'ios'"), os_feeds(t))


def package_health(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    return t.part.select(
        joined("osv:", Tables.ecosystem(key), ":", joined("org.g", text(key % 13), ":lib", text(key)), ":", text(F.col("p_size") % 5), ".1").alias("source"),
        F.when(key % 3 == 0, "error").when(key % 3 == 1, "partial").otherwise("ok").alias("status"), (F.col("p_size") % 2 == 0).alias("stale"),
    )


_HEALTH_SQL = """health AS (SELECT 'osv:' || CASE p_partkey % 4 WHEN 0 THEN 'Maven' WHEN 1 THEN 'npm' WHEN 2 THEN 'PyPI' ELSE 'Go' END || ':org.g' || (p_partkey % 13) || ':lib' || p_partkey || ':' || (p_size % 5) || '.1' AS source,
     CASE p_partkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'partial' ELSE 'ok' END AS status, p_size % 2 = 0 AS stale FROM part)"""


@query(
    "agg_22_dependency_coverage",
    f"""WITH {_HEALTH_SQL} SELECT app_id, CASE WHEN d.partkey % 11 = 0 THEN 'not-applicable' WHEN d.confidence <> 'unknown' AND coalesce(h.status = 'ok' AND NOT h.stale, false) THEN 'checked' ELSE 'not-run' END AS state, count(*) AS n
       FROM deps d LEFT JOIN health h ON h.source = 'osv:' || d.ecosystem || ':' || d.name || ':' || d.version GROUP BY ALL""",
    ("deps",),
)
def _(t: Tables) -> DataFrame:
    rows = coverage.dependency_coverage(t.deps.withColumn("superseded", F.col("partkey") % 11 == 0), package_health(t))
    return rows.groupBy("app_id", "state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_23_query_states",
    f"""WITH {_HEALTH_SQL}, c AS (SELECT ecosystem, name, version, max(CASE confidence WHEN 'exact' THEN 2 WHEN 'declared' THEN 1 ELSE 0 END) AS r, count(*) AS n, any_value(partkey) AS pk FROM deps GROUP BY ecosystem, name, version)
       SELECT ecosystem, name, version, n AS "rows", CASE WHEN r = 0 THEN 'unsupported' WHEN coalesce(h.status = 'ok' AND NOT h.stale, false) THEN CASE WHEN pk % 2 = 0 THEN 'complete' ELSE 'cached' END
          WHEN pk % 2 = 0 AND h.status = 'partial' THEN 'partial' WHEN pk % 2 = 0 AND h.status = 'error' THEN 'error' ELSE 'not-checked' END AS state
       FROM c LEFT JOIN health h ON h.source = 'osv:' || c.ecosystem || ':' || c.name || ':' || c.version""",
    ("deps",),
)
def _(t: Tables) -> DataFrame:
    tried = t.deps.where("partkey % 2 = 0").select(F.concat_ws(":", F.lit("osv"), "ecosystem", "name", "version").alias("source"))
    return deps.query_states(t.deps, package_health(t), tried).select("ecosystem", "name", "version", "rows", "state")


@query(
    "win_08_query_order",
    """WITH d AS (SELECT *, CASE WHEN partkey % 3 = 0 THEN 'gradle-lockfile-resolved' ELSE 'build' END AS src FROM deps),
         dir AS (SELECT ecosystem, name, bool_or(src = 'build') AS direct FROM d GROUP BY ALL),
         c AS (SELECT ecosystem, name, version, max(CASE confidence WHEN 'exact' THEN 2 WHEN 'declared' THEN 1 ELSE 0 END) AS c FROM d GROUP BY ALL HAVING max(CASE confidence WHEN 'exact' THEN 2 WHEN 'declared' THEN 1 ELSE 0 END) > 0),
         f AS (SELECT DISTINCT ecosystem, name, version, true AS fresh FROM d WHERE partkey % 2 = 0),
         o AS (SELECT c.*, dir.direct, coalesce(f.fresh, false) AS fresh FROM c JOIN dir USING (ecosystem, name) LEFT JOIN f USING (ecosystem, name, version))
       SELECT ecosystem, name, version, fresh, direct, CASE c WHEN 2 THEN 'exact' ELSE 'declared' END AS confidence, (SELECT count(*) FROM o) - 100 AS remaining
       FROM o ORDER BY fresh, NOT direct, c DESC, ecosystem, name, version LIMIT 100""",
    ("deps",),
)
def _(t: Tables) -> DataFrame:
    rows = t.deps.withColumn("version_source", F.when(F.col("partkey") % 3 == 0, "gradle-lockfile-resolved").otherwise("build"))
    return deps.query_order(rows, rows.where("partkey % 2 = 0"), 100)


def observations(t: Tables) -> DataFrame:
    """One branch per user and event type; content follows ``k`` mod 2, so A, B, A histories occur."""
    return t.events_k.select(
        text(F.col("user_id")).alias("id"), F.lit("feed").alias("source"), F.col("event_type").alias("branch"),
        F.col("event_id").alias("sequence"), joined("h", text(F.col("k") % 2)).alias("snapshot_hash"),
    )


@query(
    "win_01_latest_observation",
    "SELECT CAST(user_id AS VARCHAR) AS id, event_type AS branch, max(event_id) AS sequence, 'h' || arg_max(k % 2, event_id) AS snapshot_hash FROM events_k GROUP BY ALL",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    return adv.latest_observations(observations(t)).select("id", "branch", "sequence", "snapshot_hash")


@query(
    "win_02_content_changes",
    """SELECT id, branch, sequence, snapshot_hash FROM (SELECT CAST(user_id AS VARCHAR) AS id, event_type AS branch, event_id AS sequence, 'h' || (k % 2) AS snapshot_hash,
         lag('h' || (k % 2)) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS prev FROM events_k) WHERE prev IS NULL OR prev <> snapshot_hash""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    return adv.changes_only(observations(t)).select("id", "branch", "sequence", "snapshot_hash")


@query(
    "set_01_current_and_branches",
    """SELECT id, branch, count(*) AS n FROM (SELECT id, '' AS branch FROM advisories UNION ALL SELECT 'CVE-' || (partkey % 60), brand FROM advisories) GROUP BY ALL""",
    ("advisories",),
)
def _(t: Tables) -> DataFrame:
    branched = t.advisories.select(joined("CVE-", text(F.col("partkey") % 60)).alias("id"), F.col("brand").alias("branch"))
    return adv.current_and_branches(t.advisories.select("id", F.lit("").alias("branch")), branched).groupBy("id", "branch").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_19_feed_health",
    f"""WITH {_FEEDS_SQL} SELECT coalesce(fs.source, q.source) AS source, q.source IS NOT NULL AS required, coalesce(fs.status, 'never-synced') AS status,
         coalesce(fs.succeeded < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 DAY, true) AS stale
       FROM (SELECT unnest(['android', 'kev']) AS source) q FULL OUTER JOIN fs ON fs.source = q.source""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    return adv.feed_health(os_feeds(t), ["android", "kev"], dt.datetime(2024, 1, 30, 12, 0, 0))
