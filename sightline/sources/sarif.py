"""Imported SARIF 2.1.0 documents to external findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.canonical import digest, finding_identity
from sightline.functions.paths import safe_location
from sightline.functions.ranks import imported_severity
from sightline.functions.text import cwe_ids, redact, slug
from sightline.operators.coverage import weaknesses

RULE = (
    "struct<id:string,shortDescription:struct<text:string>,helpUri:string,defaultConfiguration:struct<level:string>,"
    "properties:struct<`security-severity`:string,tags:array<string>>>"
)
RESULT = (
    "struct<ruleId:string,ruleIndex:int,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<"
    "artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>"
)
SCHEMA = (
    f"version string, runs array<struct<tool:struct<driver:struct<name:string,version:string,rules:array<{RULE}>>>,results:array<{RESULT}>>>"
)
# Fixed value: credential-like assignments that are masked in imported texts.
CREDENTIAL = r"(?i)(?<![\w.-])(?=[\w.-]*?(?:token|secret|password|passwd|pwd|api[_-]?key|auth))([\w.-]*+\s*+[=:]\s*+)[^\s,;]++"
LITERAL = r"""(["'`])(?:\\.|(?!\1)[^\\\n])*(?:\1|\\\1)"""


def safe_text(value, limit: int | None = None):
    """Imported text on one line, without literal contents or credentials; cut only where a ``limit`` is asked for."""
    plain = F.regexp_replace(F.coalesce(value, F.lit("")), LITERAL, '"…"')
    line = F.replace(redact(F.regexp_replace(plain, CREDENTIAL, "$1[REDACTED]")), F.lit("\n"), F.lit(" "))
    return line if limit is None else F.left(line, F.lit(limit))


def parsed_results(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, rejects): one row per run and result with its rule, found by id or by index.

    ``documents``: report_id, tool, body. Documents of another version, and results whose id and index disagree, are rejects.
    """
    parsed = documents.withColumn("d", F.from_json("body", SCHEMA)).drop("body")
    valid = F.coalesce(F.col("d.version") == "2.1.0", F.lit(False))
    key = ["report_id", "tool", "run"]
    runs = parsed.where(valid).select("report_id", "tool", F.posexplode("d.runs").alias("run", "r"))
    named = documents.where("report_id IS NOT NULL AND tool IS NOT NULL").groupBy("report_id", "tool")
    repeated = not named.agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    rows = _joined_rules(runs, key) if repeated else _own_rules(runs, key)
    wanted = F.coalesce("res.ruleId", F.lit(""))
    clash = (wanted != "") & F.col("__at").isNotNull() & ~F.coalesce(F.col("__at.id") == wanted, F.lit(False))
    rows = rows.withColumn("clash", clash).withColumn("rule", F.when(wanted != "", F.col("__named")).otherwise(F.col("__at"))).withColumn(
        "rule_name", F.when(wanted != "", wanted).otherwise(F.coalesce("rule.id", F.lit("unknown")))
    )
    bad_documents = parsed.where(~valid).select("report_id", "tool", F.lit("unsupported-version").alias("code"))
    bad_results = rows.where("clash").select("report_id", "tool", F.lit("rule-disagreement").alias("code"))
    return rows.where("NOT clash").select(*key, "driver", "position", "res", "rule", "rule_name"), bad_documents.unionByName(bad_results)


def _own_rules(runs: DataFrame, key: list[str]) -> DataFrame:
    """Results with the rule at their index and the first rule of their id, looked up inside the run: no row moves."""
    rules = F.when(F.col("report_id").isNotNull() & F.col("tool").isNotNull(), F.col("r.tool.driver.rules"))

    def looked_up(res: Column) -> Column:
        place = F.array_position(rules["id"], F.nullif(res["ruleId"], F.lit(""))) - 1
        return F.struct(res.alias("res"), F.get(rules, res["ruleIndex"]).alias("__at"), F.get(rules, place.cast("int")).alias("__named"))

    driver = F.coalesce("r.tool.driver.name", F.lit("")).alias("driver")
    return runs.select(*key, driver, F.posexplode(F.transform("r.results", looked_up)).alias("position", "x")).select(*key, "driver", "position", "x.*")


def _joined_rules(runs: DataFrame, key: list[str]) -> DataFrame:
    """As :func:`_own_rules` where documents share a key: a result then meets the rules of all documents of its key."""
    driver = F.coalesce("r.tool.driver.name", F.lit("")).alias("driver")
    results = runs.select(*key, driver, F.posexplode("r.results").alias("position", "res"))
    # Rules are rows of their own: a document's rule list is never repeated per result.
    rules = runs.select(*key, F.posexplode("r.tool.driver.rules").alias("index", "rule"))
    by_index = rules.select(*key, F.col("index").alias("__index"), F.col("rule").alias("__at"))
    by_id = rules.groupBy(*key, F.col("rule.id").alias("__id")).agg(F.min_by("rule", "index").alias("__named"))
    rows = results.withColumn("__index", F.col("res.ruleIndex")).withColumn("__id", F.nullif(F.col("res.ruleId"), F.lit("")))
    return rows.join(by_index, [*key, "__index"], "left").join(by_id, [*key, "__id"], "left")


def external_findings(results: DataFrame, root: str = "") -> DataFrame:
    """Candidate findings of located results; results without a usable location are left out."""
    places = F.transform(
        F.coalesce("res.locations", F.array().cast("array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>")),
        lambda x: F.struct(x["physicalLocation"]["artifactLocation"]["uri"].alias("uri"), x["physicalLocation"]["region"]["startLine"].alias("line")),
    )
    rows = results.withColumn("place", safe_location(places, root)).where("place.path IS NOT NULL")
    key = digest(F.to_json(F.array(F.lit("named-rule-v1"), digest(F.col("tool")), digest(F.col("driver")), F.col("rule_name"))))
    rule_id = F.concat(F.lit("EXT-"), slug(F.col("tool"), 40), F.lit("-"), slug(F.col("rule_name")), F.lit("-"), key)
    rows = rows.withColumn("rule_id", rule_id)
    evidence = F.array(F.struct(F.col("place.line").alias("line"), F.col("place.path").alias("path")))
    tags = F.coalesce("rule.properties.tags", F.array().cast("array<string>"))
    return rows.select(
        "report_id", "tool", "run", finding_identity(F.col("rule_id"), evidence, ("line", "path")).alias("id"), "rule_id", safe_text(F.col("rule_name")).alias("external_rule"),
        imported_severity(
            F.col("rule.properties.security-severity"), F.coalesce("res.level", F.lit("")), F.coalesce("rule.defaultConfiguration.level", F.lit(""))
        ).alias("severity"),
        F.lit("candidate").alias("status"), F.col("place.path").alias("path"), F.col("place.line").alias("line"), safe_text(F.col("res.message.text")).alias("message"),
        cwe_ids(tags).alias("cwe"), F.lit("external").alias("origin"),
    )


def with_cwe_weaknesses(findings: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """One row per finding and weakness that lists one of its CWE ids."""
    taxonomy = weaknesses(findings.sparkSession) if taxonomy is None else taxonomy
    listed = taxonomy.select(F.col("id").alias("weakness_id"), F.explode("cwe").alias("cwe_id"))
    rows = findings.select("report_id", "id", F.explode("cwe").alias("cwe_id")).join(listed, "cwe_id")
    return rows.select("report_id", "id", "weakness_id").distinct()
