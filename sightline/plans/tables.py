"""Evidence tables derived from the given tables, in Spark and (for the SQL check) in SQL.

Every derivation is a row-wise projection or a mergeable aggregate over a whole table.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.canonical import path_identity
from sightline.scale import latest

# ---------------------------------------------------------------------------------------------
# SQL twins. ``k`` is the number inside events.props.

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "events_k": (
        (),
        """SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type, value,
                  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events""",
    ),
    "findings_raw": (
        ("events_k",),
        """SELECT event_id, ts, day, k, value, user_id, event_type,
             'app-' || (user_id % 10) AS target,
             'app-' || (user_id % 10) || '@' || strftime(day, '%Y-%m-%d') AS report_id,
             'RULE-' || upper(event_type) AS rule_id,
             'mod' || (user_id % 7) || '/src/File' || user_id || '.kt' AS path,
             k + 1 AS line,
             CASE WHEN value >= 100 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 20 THEN 'medium'
                  WHEN value >= 5 THEN 'low' ELSE 'info' END AS severity,
             CASE k % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'version-affected'
                  WHEN 2 THEN 'configuration-confirmed' ELSE 'runtime-confirmed' END AS status,
             CASE WHEN k % 11 = 0 THEN 'external' ELSE 'builtin' END AS origin,
             k % 9 = 0 AS known_exploited,
             'F-' || substr(sha256('["RULE-' || upper(event_type) || '","app",[{"path":"mod' || (user_id % 7)
               || '/src/File' || user_id || '.kt"}]]'), 1, 20) AS id
           FROM events_k""",
    ),
    "findings": (
        ("findings_raw",),
        """SELECT * FROM findings_raw
           QUALIFY row_number() OVER (PARTITION BY report_id, id ORDER BY event_id DESC) = 1""",
    ),
    "coverage": (
        ("findings_raw",),
        """SELECT DISTINCT report_id, target, day, rule_id,
             CASE k % 12 WHEN 0 THEN 'not-run' WHEN 1 THEN 'partial' WHEN 2 THEN 'limited'
                  WHEN 3 THEN 'not-applicable' ELSE 'checked' END AS state
           FROM findings_raw""",
    ),
    "reports": (
        ("findings_raw",),
        "SELECT report_id, target, day, count(*) AS rows_seen FROM findings_raw GROUP BY ALL",
    ),
    "report_pairs": (
        ("reports",),
        """SELECT * FROM (SELECT report_id AS after_id, target, day,
             lag(report_id) OVER (PARTITION BY target ORDER BY day) AS before_id FROM reports)
           WHERE before_id IS NOT NULL""",
    ),
    "documents_src": (
        (),
        """SELECT doc_id, source AS app_id, source || '/src/doc' || doc_id || '.' || lang AS path,
                  '.' || lang AS suffix, text, n_chars FROM documents""",
    ),
    "deps": (
        (),
        """SELECT DISTINCT 'app-' || (l_suppkey % 20) AS app_id,
             CASE l_partkey % 4 WHEN 0 THEN 'Maven' WHEN 1 THEN 'npm' WHEN 2 THEN 'PyPI' ELSE 'Go' END AS ecosystem,
             'org.g' || (l_partkey % 13) || ':lib' || l_partkey AS name,
             (CAST(l_quantity AS INTEGER) % 5) || '.' || l_linenumber AS version,
             'mod' || (l_orderkey % 5) || '/build.gradle' AS path,
             CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'declared' ELSE 'unknown' END AS confidence,
             l_partkey AS partkey
           FROM lineitem""",
    ),
    "advisories": (
        (),
        """SELECT p_partkey AS partkey, 'GHSA-' || p_partkey AS osv_id,
             CASE WHEN p_partkey % 3 = 0 THEN 'CVE-2024-' || (10000 + p_partkey) END AS cve_a,
             CASE WHEN p_partkey % 5 = 0 THEN 'CVE-2023-' || (20000 + p_partkey) END AS cve_b,
             coalesce(CASE WHEN p_partkey % 5 = 0 THEN 'CVE-2023-' || (20000 + p_partkey) END,
                      CASE WHEN p_partkey % 3 = 0 THEN 'CVE-2024-' || (10000 + p_partkey) END,
                      'GHSA-' || p_partkey) AS id,
             CASE p_partkey % 4 WHEN 0 THEN 'Maven' WHEN 1 THEN 'npm' WHEN 2 THEN 'PyPI' ELSE 'Go' END AS ecosystem,
             'org.g' || (p_partkey % 13) || ':lib' || p_partkey AS name,
             (p_size % 5) || '.' || (p_partkey % 7 + 1) AS version,
             CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 4 = 0 THEN 'critical' WHEN p_size % 4 = 1 THEN 'high'
                  WHEN p_size % 4 = 2 THEN 'medium' ELSE 'low' END AS severity,
             p_partkey % 17 = 0 AS withdrawn, p_partkey % 19 = 0 AS malicious,
             'https://advisories.example/' || (p_partkey % 50) AS reference,
             p_brand AS brand, p_type AS kind, p_size AS size
           FROM part""",
    ),
    "devices": (
        (),
        """SELECT 'dev-' || c_custkey AS device_id, c_custkey AS n,
             CASE WHEN c_nationkey % 3 = 0 THEN 'ios' ELSE 'android' END AS platform,
             CASE WHEN c_custkey % 13 = 0 THEN 'unknown'
                  ELSE '20' || (22 + c_custkey % 4) || '-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '-05' END AS security_patch,
             CASE WHEN c_custkey % 5 = 0 THEN '20' || (21 + c_custkey % 5) || '-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '-01' END AS vendor_security_patch,
             CAST(11 + c_custkey % 6 AS VARCHAR) AS version,
             CASE c_custkey % 4 WHEN 0 THEN 'Qualcomm Inc' WHEN 1 THEN 'MTK' WHEN 2 THEN 'Samsung Exynos' ELSE '' END AS soc_manufacturer,
             c_custkey % 29 = 0 AS simulator
           FROM customer""",
    ),
}


# Text tables and their row keys.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def with_views(names: tuple[str, ...], sql: str) -> str:
    """``sql`` preceded by the derived tables it needs, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def text(value: Column) -> Column:
    return value.cast("string")


def joined(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def bands(value: Column) -> Column:
    return (
        F.when(value >= 100, "critical").when(value >= 50, "high").when(value >= 20, "medium")
        .when(value >= 5, "low").otherwise("info")
    )


class Tables:
    """The given tables and the evidence tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        table = self.spark.read.parquet(path)
        if name in TEXT_TABLES and os.path.isfile(path):
            # One local file with one row group would put all text work into one task; a real table has many files.
            return table.repartition(self.spark.sparkContext.defaultParallelism, TEXT_TABLES[name])
        return table

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    def local(self, rows: list, schema: str) -> DataFrame:
        """A configuration table (literal rows)."""
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def events_k(self) -> DataFrame:
        return self.read("events").select(
            "event_id", "ts", F.to_date("ts").alias("day"), "user_id", "event_type", "value",
            F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        )

    @cached_property
    def findings_raw(self) -> DataFrame:
        user, k = F.col("user_id"), F.col("k")
        target = joined("app-", text(user % 10))
        rule = joined("RULE-", F.upper("event_type"))
        path = joined("mod", text(user % 7), "/src/File", text(user), ".kt")
        return self.events_k.select(
            "event_id", "ts", "day", "k", "value", "user_id", "event_type",
            target.alias("target"),
            joined(target, "@", F.date_format("day", "yyyy-MM-dd")).alias("report_id"),
            rule.alias("rule_id"),
            path.alias("path"),
            (k + 1).alias("line"),
            bands(F.col("value")).alias("severity"),
            F.when(k % 4 == 0, "candidate").when(k % 4 == 1, "version-affected")
            .when(k % 4 == 2, "configuration-confirmed").otherwise("runtime-confirmed").alias("status"),
            F.when(k % 11 == 0, "external").otherwise("builtin").alias("origin"),
            (k % 9 == 0).alias("known_exploited"),
            path_identity(rule, path).alias("id"),
        )

    @cached_property
    def findings(self) -> DataFrame:
        return latest(self.findings_raw, ["report_id", "id"], ["event_id"])

    @cached_property
    def coverage(self) -> DataFrame:
        k = F.col("k") % 12
        state = (
            F.when(k == 0, "not-run").when(k == 1, "partial").when(k == 2, "limited")
            .when(k == 3, "not-applicable").otherwise("checked")
        )
        return self.findings_raw.select("report_id", "target", "day", "rule_id", state.alias("state")).distinct()

    @cached_property
    def reports(self) -> DataFrame:
        return self.findings_raw.groupBy("report_id", "target", "day").agg(F.count(F.lit(1)).alias("rows_seen"))

    @cached_property
    def report_pairs(self) -> DataFrame:
        from sightline.scale import with_previous

        pairs = with_previous(self.reports, ["target"], ["day"], "report_id", "before_id")
        return pairs.where("before_id IS NOT NULL").select(
            F.col("report_id").alias("after_id"), "target", "day", "before_id"
        )

    @cached_property
    def documents_src(self) -> DataFrame:
        return self.read("documents").select(
            "doc_id", F.col("source").alias("app_id"),
            joined(F.col("source"), "/src/doc", text(F.col("doc_id")), ".", F.col("lang")).alias("path"),
            joined(".", F.col("lang")).alias("suffix"), "text", "n_chars",
        )

    @staticmethod
    def ecosystem(key: Column) -> Column:
        return F.when(key % 4 == 0, "Maven").when(key % 4 == 1, "npm").when(key % 4 == 2, "PyPI").otherwise("Go")

    @cached_property
    def deps(self) -> DataFrame:
        return self.deps_rows.distinct()

    @cached_property
    def deps_rows(self) -> DataFrame:
        """The rows of :attr:`deps` with repeats, for readers that gather equal rows themselves."""
        part = F.col("l_partkey")
        flag = F.col("l_returnflag")
        return self.read("lineitem").select(
            joined("app-", text(F.col("l_suppkey") % 20)).alias("app_id"),
            self.ecosystem(part).alias("ecosystem"),
            joined("org.g", text(part % 13), ":lib", text(part)).alias("name"),
            joined(text(F.col("l_quantity").cast("int") % 5), ".", text(F.col("l_linenumber"))).alias("version"),
            joined("mod", text(F.col("l_orderkey") % 5), "/build.gradle").alias("path"),
            F.when(flag == "A", "exact").when(flag == "N", "declared").otherwise("unknown").alias("confidence"),
            part.alias("partkey"),
        )

    @cached_property
    def advisories(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        cve_a = F.when(key % 3 == 0, joined("CVE-2024-", text(key + 10000)))
        cve_b = F.when(key % 5 == 0, joined("CVE-2023-", text(key + 20000)))
        osv = joined("GHSA-", text(key))
        return self.read("part").select(
            key.alias("partkey"), osv.alias("osv_id"), cve_a.alias("cve_a"), cve_b.alias("cve_b"),
            F.array_compact(F.array(cve_a, cve_b)).alias("aliases"),
            F.coalesce(cve_b, cve_a, osv).alias("id"),
            self.ecosystem(key).alias("ecosystem"),
            joined("org.g", text(key % 13), ":lib", text(key)).alias("name"),
            joined(text(size % 5), ".", text(key % 7 + 1)).alias("version"),
            F.when(size % 10 == 0, F.lit(None)).when(size % 4 == 0, "critical").when(size % 4 == 1, "high")
            .when(size % 4 == 2, "medium").otherwise("low").alias("severity"),
            (key % 17 == 0).alias("withdrawn"), (key % 19 == 0).alias("malicious"),
            joined("https://advisories.example/", text(key % 50)).alias("reference"),
            F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), size.alias("size"),
        )

    @cached_property
    def devices(self) -> DataFrame:
        n = F.col("c_custkey")
        month = F.lpad(text(n % 12 + 1), 2, "0")
        return self.read("customer").select(
            joined("dev-", text(n)).alias("device_id"), n.alias("n"),
            F.when(F.col("c_nationkey") % 3 == 0, "ios").otherwise("android").alias("platform"),
            F.when(n % 13 == 0, "unknown").otherwise(joined("20", text(n % 4 + 22), "-", month, "-05")).alias("security_patch"),
            F.when(n % 5 == 0, joined("20", text(n % 5 + 21), "-", month, "-01")).alias("vendor_security_patch"),
            text(n % 6 + 11).alias("version"),
            F.when(n % 4 == 0, "Qualcomm Inc").when(n % 4 == 1, "MTK").when(n % 4 == 2, "Samsung Exynos")
            .otherwise("").alias("soc_manufacturer"),
            (n % 29 == 0).alias("simulator"),
        )
