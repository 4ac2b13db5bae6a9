"""Advisory feeds: raw JSON documents to normalized records, with invalid ones split off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.cvss import advisory_severity
from sightline.functions.packages import CVE_ID, display_id
from sightline.functions.versions import zoned_timestamp

# Document schemas of the public feeds.
KEV_SCHEMA = (
    "vulnerabilities array<struct<cveID:string,vulnerabilityName:string,vendorProject:string,product:string,shortDescription:string,"
    "dateAdded:string,requiredAction:string>>"
)
VERSION = "struct<version:string,status:string,versionType:string,lessThan:string,lessThanOrEqual:string,changes:array<struct<at:string,status:string>>>"
CVE_SCHEMA = (
    "cveMetadata struct<cveId:string,state:string,dateUpdated:string,assignerOrgId:string>, containers struct<cna:struct<title:string,"
    "descriptions:array<struct<lang:string,value:string>>,"
    f"affected:array<struct<vendor:string,product:string,defaultStatus:string,versions:array<{VERSION}>>>,"
    "references:array<struct<url:string>>,providerMetadata:struct<orgId:string>>>"
)
DELTA_SCHEMA = (
    "array<struct<fetchTime:string,new:array<struct<cveId:string,dateUpdated:string>>,updated:array<struct<cveId:string,dateUpdated:string>>>>"
)
OSV_SCHEMA = (
    "id string, aliases array<string>, summary string, details string, modified string, withdrawn string, references array<struct<url:string>>,"
    "severity array<struct<type:string,score:string>>, database_specific struct<severity:string>,"
    "affected array<struct<package:struct<name:string,ecosystem:string,purl:string>,versions:array<string>>>"
)
KEV_PAGE = "https://www.cisa.gov/known-exploited-vulnerabilities-catalog"


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def exploited_records(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of known-exploited catalogues; entries need a CVE id, a name, a vendor and a product."""
    rows = documents.select(F.explode(F.from_json("body", KEV_SCHEMA)["vulnerabilities"]).alias("v")).select("v.*")
    ok = (
        _text(F.col("cveID")).rlike(CVE_ID) & (_text(F.col("vulnerabilityName")) != "") & (F.trim(_text(F.col("vendorProject"))) != "")
        & (F.trim(_text(F.col("product"))) != "")
    )
    records = rows.where(ok).select(
        F.col("cveID").alias("id"), F.lit("kev").alias("source"), F.col("vulnerabilityName").alias("title"), _text(F.col("shortDescription")).alias("description"),
        F.col("vendorProject").alias("vendor"), "product", _text(F.col("dateAdded")).alias("modified"), F.lit(True).alias("known_exploited"),
        _text(F.col("requiredAction")).alias("required_action"), F.array(F.lit(KEV_PAGE)).alias("references"),
    )
    return records, rows.where(~ok).select(_text(F.col("cveID")).alias("id"), F.lit("invalid-entry").alias("code"))


def cve_records(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of CVE documents: first English description, affected ranges, reference addresses."""
    rows = documents.select(F.from_json("body", CVE_SCHEMA).alias("d"))
    meta, cna = F.col("d.cveMetadata"), F.col("d.containers.cna")
    ok = _text(meta["cveId"]).rlike(CVE_ID)
    english = F.get(F.filter(cna["descriptions"], lambda x: F.coalesce(x["lang"], F.lit("")).startswith("en")), F.lit(0))
    affected = F.transform(
        F.coalesce(cna["affected"], F.array().cast(f"array<struct<vendor:string,product:string,defaultStatus:string,versions:array<{VERSION}>>>")),
        lambda p: F.struct(
            _text(p["vendor"]).alias("vendor"), _text(p["product"]).alias("product"),
            F.transform(
                F.coalesce(p["versions"], F.array().cast(f"array<{VERSION}>")),
                lambda v: F.struct(
                    v["version"].alias("version"), F.coalesce(v["status"], F.lit("unknown")).alias("status"), v["versionType"].alias("versionType"),
                    v["lessThan"].alias("lessThan"), v["lessThanOrEqual"].alias("lessThanOrEqual"), (F.size(v["changes"]) > 0).alias("changes"),
                ),
            ).alias("versions"),
        ),
    )
    records = rows.where(ok).select(
        meta["cveId"].alias("id"), F.lit("cve").alias("source"), F.coalesce(cna["title"], meta["cveId"]).alias("title"), _text(english["value"]).alias("description"),
        _text(meta["dateUpdated"]).alias("modified"), F.coalesce(meta["state"], F.lit("PUBLISHED")).alias("state"), affected.alias("affected"),
        F.array_compact(F.transform(F.coalesce(cna["references"], F.array().cast("array<struct<url:string>>")), lambda r: r["url"])).alias("references"),
        _text(meta["assignerOrgId"]).alias("assigner_org_id"), _text(cna["providerMetadata"]["orgId"]).alias("cna_org_id"),
    )
    return records, rows.where(~F.coalesce(ok, F.lit(False))).select(_text(meta["cveId"]).alias("id"), F.lit("invalid-id").alias("code"))


def delta_candidates(documents: DataFrame, cursor: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, cursor) of delta logs: new and updated ids fetched at or after the cursor, and the new cursor.

    Entries at the cursor are read again (the queue is idempotent); the cursor never moves back.
    """
    entries = documents.select(F.explode(F.from_json("body", DELTA_SCHEMA)).alias("e")).select("e.*").withColumn(
        "fetched", zoned_timestamp(F.col("fetchTime"))
    ).where("fetched IS NOT NULL")
    cut = zoned_timestamp(F.lit(cursor))
    empty = F.array().cast("array<struct<cveId:string,dateUpdated:string>>")
    items = entries.where(F.col("fetched") >= cut).select(
        "fetchTime", F.explode(F.concat(F.coalesce("new", empty), F.coalesce("updated", empty))).alias("i")
    )
    revision = F.coalesce(F.nullif("i.dateUpdated", F.lit("")), F.col("fetchTime"))
    found = items.where(F.col("i.cveId").rlike(CVE_ID)).select(F.col("i.cveId").alias("id"), revision.alias("revision"), F.lit(1).alias("priority")).distinct()
    newest = entries.agg(F.greatest(F.max("fetched"), F.max(cut)).alias("cursor"))
    return found, newest


def osv_records(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of query responses (ecosystem, name, version, body): display id, aliases, severity."""
    rows = documents.select("ecosystem", "name", "version", F.from_json("body", OSV_SCHEMA).alias("v"))
    aliases = F.coalesce("v.aliases", F.array().cast("array<string>"))
    ok = (_text(F.col("v.id")) != "") & F.forall(aliases, lambda a: a.isNotNull() & (a != "") & ~a.rlike(r"\s"))
    ok = F.coalesce(ok, F.lit(False))
    shown = display_id(F.col("v.id"), aliases)
    rated = advisory_severity(F.col("v.severity"), F.col("v.database_specific.severity"))
    records = rows.where(ok).select(
        shown.alias("id"), F.concat_ws(":", F.lit("osv"), "ecosystem", "name", "version").alias("source"), F.coalesce("v.summary", shown).alias("title"),
        _text(F.col("v.details")).alias("description"), _text(F.col("v.modified")).alias("modified"), F.col("v.withdrawn").alias("withdrawn"),
        F.array_compact(F.transform(F.coalesce("v.references", F.array().cast("array<struct<url:string>>")), lambda r: r["url"])).alias("references"),
        "ecosystem", "name", "version", F.col("v.id").alias("osv_id"), aliases.alias("aliases"), rated["severity"].alias("severity"),
        rated["severity_basis"].alias("severity_basis"),
    )
    return records, rows.where(~ok).select("ecosystem", "name", "version", _text(F.col("v.id")).alias("id"))


def backfill_months(spark: SparkSession, since: str, until: str, bulletins: DataFrame, limit: int | None = None) -> DataFrame:
    """Every month of a range as fetched, failed or missing. ``bulletins``: month (YYYY-MM), ok. ``limit`` refuses longer ranges."""
    months = spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(since + "-01")), F.to_date(F.lit(until + "-01")), F.expr("INTERVAL 1 MONTH"))).alias("day")
    ).select(F.date_format("day", "yyyy-MM").alias("month"))
    if since > until or since < "2015-08":
        raise ValueError("the range must be ordered and start no earlier than 2015-08")
    count = (int(until[:4]) - int(since[:4])) * 12 + int(until[5:7]) - int(since[5:7]) + 1
    if limit is not None and count > limit:
        raise ValueError(f"a backfill covers at most {limit} months")
    seen = bulletins.groupBy("month").agg(F.bool_or("ok").alias("ok"), F.count(F.lit(1)).alias("documents"))
    return months.join(seen, "month", "left").select(
        "month", F.when(F.col("ok").isNull(), "missing").when(F.col("ok"), "fetched").otherwise("failed").alias("state"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
    )
