"""Exported documents as ordered lines.

A document is never built in one row: every operator returns (document, section, position, line) rows. Written in that
order, the part files of one document joined in name order are the document, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import ranks
from sightline.functions.paths import relative_path, uri_path
from sightline.functions.text import markdown_code, markdown_text
from sightline.scale import running_total

LINE_COLUMNS = ("document", "section", "position", "line")
# Fixed value: the published schema of the export format.
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
# A JSON text without escapes, which stands for the characters between its quotes.
BARE_TEXT = r'\A"[^"\\\x00-\x1f]*"\z'


def lines(df: DataFrame, document: Column, section: int, position: Column, line: Column) -> DataFrame:
    return df.select(document.alias("document"), F.lit(section).alias("section"), position.cast("string").alias("position"), line.alias("line"))


def comma_separated(rows: DataFrame) -> DataFrame:
    """Lines of a JSON list: every line but the first of its section starts with a comma."""
    keys = ["document", "section"]
    first = rows.groupBy(*keys).agg(F.min("position").alias("__first"))
    joined = first.join(rows, keys)  # the few first lines are there before the rows would be dealt out by document
    return joined.withColumn(
        "line", F.when(F.col("position") == F.col("__first"), F.col("line")).otherwise(F.concat(F.lit(","), "line"))
    ).select(*LINE_COLUMNS)


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_documents(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Text files partitioned by document; a large document spans several ordered part files."""
    order = ["document", "section", "position"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("document", F.col("line").alias("value")).write.mode(mode).partitionBy("document").text(path)


def _write_sections(rows: DataFrame, path: str, mode: str) -> None:
    """Compressed text files by document and section of rows that are in order by document, section and position."""
    ordered = rows.select("document", "section", F.col("line").alias("value"))
    ordered.write.mode(mode).partitionBy("document", "section").option("compression", "gzip").text(path)


def write_bom(parts: tuple[DataFrame, DataFrame, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """The documents of :func:`bom_parts`, as compressed part files by document and section that form a document when
    unpacked and joined in name order.

    The components are written where they lie: both lists of a partition are numbered, put in order as plain columns and
    only then turned into text, so no line of them is shuffled.
    """
    components, first, rest = parts
    order = ["document", "section", "position"]
    # one row for each document, as there are folders
    lists = components.join(F.broadcast(first), "document").withColumn("section", F.explode(F.array(F.lit(1), F.lit(3))))
    in_order = lists.sortWithinPartitions(*order)
    line = F.when(F.col("section") == 1, _component_json()).otherwise(_json_text(F.col("ref")))
    _write_sections(in_order.select("document", "section", F.concat(_comma(), line).alias("line")), path, mode)
    _write_sections(rest.repartitionByRange(*order).sortWithinPartitions(*order), path, "append")


def placed(rows: DataFrame) -> DataFrame:
    """Lines with their place in the whole document: ordinal (from 1), offset (bytes before the line) and bytes (with its
    line end), by running sums over ordered slices, so no document is ordered in one task."""
    size = (F.octet_length("line") + 1).cast("bigint")
    order = ["section", "position", "line"]
    out = running_total(rows, ["document"], order, {"ordinal": F.lit(1).cast("bigint"), "upto": size})
    return out.select(*LINE_COLUMNS, "ordinal", (F.col("upto") - size).alias("offset"), size.alias("bytes"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(document, line) of every part file below ``path``, read in parallel; the counterpart of :func:`write_documents` and
    :func:`write_bom`."""
    return spark.read.schema("value string, document string").text(path).select("document", F.col("value").alias("line"))


def _parsed(written: DataFrame, kinds: dict[str, tuple[str, str, list[str]]], plain: str | None = None) -> DataFrame:
    """document, kind, key of the items that lines hold: ``kinds`` maps a kind to the text its objects begin with (none of
    them the beginning of another), their schema and the columns of their key, in which the object goes by its kind. Lines
    that are a JSON text alone are of kind ``plain``. Frame lines hold no item.

    Every line is read once and parsed by the schema of its own kind only.
    """
    body, kind, key = F.col("body"), F.lit(None).cast("string"), F.lit(None).cast("string")
    objects = []
    for name, (begin, schema, columns) in kinds.items():
        kind = F.when(body.startswith(begin), name).otherwise(kind)
        objects.append(F.when(F.col("kind") == name, F.from_json(body, schema)).alias(name))
        own = F.concat_ws("|", *[F.coalesce(F.expr(c).cast("string"), F.lit("")) for c in columns])
        key = F.when(F.col("kind") == name, own).otherwise(key)
    if plain:
        kind = F.when(body.startswith('"'), plain).otherwise(kind)
        parsed = F.from_json(F.concat(F.lit('{"v":'), body, F.lit("}")), "v string")["v"]
        text = F.when(body.rlike(BARE_TEXT), F.substr(body, F.lit(2), F.length(body) - 2)).otherwise(parsed)
        objects.append(F.when(F.col("kind") == plain, text).alias(plain))
        key = F.when(F.col("kind") == plain, F.col(plain)).otherwise(key)
    whole = F.when(F.startswith("line", F.lit(",")), F.substr("line", F.lit(2))).otherwise(F.col("line"))
    items = written.select("document", whole.alias("body")).withColumn("kind", kind).where("kind IS NOT NULL")
    return items.select("document", "kind", *objects).select("document", "kind", key.alias("key"))


def parse_sarif(written: DataFrame) -> DataFrame:
    """Items of SARIF documents from their lines: rules, results and notifications."""
    place = "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>"
    return _parsed(written, {
        "rule": ('{"id":', "id string, defaultConfiguration struct<level:string>", ["rule.id", "rule.defaultConfiguration.level"]),
        "result": (
            '{"ruleId":', f"struct<ruleId:string,level:string,message:struct<text:string>,{place},properties:struct<status:string,severity:string,findingId:string>>",
            ["result.ruleId", "result.level", "result.message.text", "result.locations[0].physicalLocation.artifactLocation.uri", "result.locations[0].physicalLocation.region.startLine", "result.properties.status", "result.properties.severity", "result.properties.findingId"],
        ),
        "notification": ('{"level":', "level string, message struct<text:string>, associatedRule struct<id:string>", ["notification.associatedRule.id", "notification.message.text"]),
    })


def parse_bom(written: DataFrame) -> DataFrame:
    """Items of CycloneDX documents from their lines: components, dependencies and vulnerabilities."""
    return _parsed(written, {
        "component": ('{"type":', "struct<`bom-ref`:string,name:string,version:string,purl:string,properties:array<struct<name:string,value:string>>>", ["component.`bom-ref`", "component.name", "component.version", "component.properties[1].value"]),
        "vulnerability": ('{"bom-ref":', "id string, ratings array<struct<severity:string>>, affects array<struct<ref:string>>", ["vulnerability.id", "vulnerability.ratings[0].severity", "size(vulnerability.affects)"]),
    }, plain="dependency")


def sarif_lines(findings: DataFrame, descriptors: DataFrame, notifications: DataFrame, reports: DataFrame, root: str = "", tool: str = "sightline") -> DataFrame:
    """SARIF 2.1.0 per report: rule descriptors, results and coverage notifications.

    ``findings``: report_id, id, rule_id, severity, status, title, path, line; ``descriptors``: coverage.export_rules;
    ``notifications``: coverage.coverage_notifications; ``reports``: report_id, incomplete.
    """
    doc = F.col("report_id")
    head = F.concat(
        F.lit('{"version":"2.1.0","$schema":"' + SARIF_SCHEMA + '","runs":[{"tool":{"driver":{"name":"' + tool + '","rules":[')
    )
    rule = F.to_json(
        F.struct(
            F.col("export_rule").alias("id"), F.struct(F.col("level").alias("level")).alias("defaultConfiguration"),
            F.struct(
                "precision", F.nullif("security_severity", F.lit("")).alias("security-severity"),
                F.when(F.col("candidate_only"), F.array(F.lit("security"), F.lit("candidate"))).otherwise(F.array(F.lit("security"))).alias("tags"),
            ).alias("properties"),
        )
    )
    name = relative_path(F.col("path"))
    uri = uri_path(F.concat(F.lit(root + "/"), name)) if root else uri_path(name)
    line = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine")))
    place = F.when(
        name.isNotNull(), F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), line.alias("region")).alias("physicalLocation"))
    ).otherwise(
        F.struct(F.struct(F.struct(F.lit(root or ".").alias("uri")).alias("artifactLocation"), F.lit(None).cast("struct<startLine:int>").alias("region")).alias("physicalLocation"))
    )
    candidate = F.col("status") == "candidate"
    result = F.to_json(
        F.struct(
            F.when(candidate, F.concat("rule_id", F.lit("/candidate"))).otherwise(F.col("rule_id")).alias("ruleId"),
            ranks.result_level(F.col("severity"), F.col("status")).alias("level"),
            F.struct(F.concat("title", F.lit(" ["), "status", F.lit("].")).alias("text")).alias("message"), F.array(place).alias("locations"),
            F.struct(F.col("id").alias("findingIdentity/v1")).alias("partialFingerprints"),
            F.struct("status", "severity", F.col("id").alias("findingId")).alias("properties"),
        )
    )
    note = F.to_json(
        F.struct(
            "level", F.struct(F.concat("rule_id", F.lit(": "), "state", F.when(F.col("entries") > 1, F.concat(F.lit(" ("), F.col("entries").cast("string"), F.lit(" entries)"))).otherwise("")).alias("text")).alias("message"),
            F.struct(F.col("rule_id").alias("id")).alias("associatedRule"),
        )
    )
    middle = F.concat(F.lit(']}},"results":['))
    success = F.concat(F.lit('],"invocations":[{"executionSuccessful":'), F.when(F.col("incomplete"), "false").otherwise("true"), F.lit(',"toolExecutionNotifications":['))
    zero = F.lit("0")
    return union(
        lines(reports, doc, 0, zero, head),
        comma_separated(lines(descriptors, doc, 1, F.col("export_rule"), rule)),
        lines(reports, doc, 2, zero, middle),
        comma_separated(lines(findings, doc, 3, F.col("id"), result)),
        lines(reports, doc, 4, zero, success),
        comma_separated(lines(notifications, doc, 5, F.format_string("%08d", F.col("position")), note)),
        lines(reports, doc, 6, zero, F.concat(F.lit(']}],"properties":{"reportId":'), F.to_json(F.array(doc)).substr(F.lit(2), F.length(F.to_json(F.array(doc))) - 2), F.lit("}}]}"))),
    )


def lint_sarif_lines(lint: DataFrame, subject: str = "app_id") -> DataFrame:
    """SARIF results of lint rows (subject, check_id, status, detail): passing and undecided rows are left out."""
    shown = lint.where(F.col("status").isin("fail", "error", "warn", "info"))
    level = F.when(F.col("status").isin("fail", "error"), "error").when(F.col("status") == "warn", "warning").otherwise("note")
    result = F.to_json(
        F.struct(
            F.col("check_id").alias("ruleId"), F.lit("fail").alias("kind"), level.alias("level"), F.struct(F.col("detail").alias("text")).alias("message"),
            F.array(F.struct(F.struct(F.struct(F.col(subject).alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"),
        )
    )
    doc = F.col(subject)
    subjects = lint.select(subject).distinct()
    head = F.lit('{"version":"2.1.0","$schema":"' + SARIF_SCHEMA + '","runs":[{"tool":{"driver":{"name":"sightline-lint"}},"results":[')
    return union(
        lines(subjects, doc, 0, F.lit("0"), head),
        comma_separated(lines(shown, doc, 1, F.format_string("%020d", F.col("event_id")) if "event_id" in lint.columns else F.concat_ws("|", "check_id", "detail"), result)),
        lines(subjects, doc, 2, F.lit("0"), F.lit("]}]}")),
    )


def markdown_lines(findings: DataFrame, summaries: DataFrame) -> DataFrame:
    """Markdown per report: summary, then findings by severity with escaped cells."""
    doc = F.col("report_id")
    title = F.concat(F.lit("# Report "), markdown_code(doc))
    counts = F.concat(
        F.lit("Findings "), F.col("findings").cast("string"), F.lit(", confirmed "), F.col("confirmed").cast("string"), F.lit(", candidates "), F.col("candidates").cast("string"),
        F.lit(", partial checks "), F.col("partial").cast("string"), F.when(F.col("incomplete"), "; the audit is incomplete").otherwise(""),
    )
    place = F.concat("path", F.when(F.col("line") > 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""))
    row = F.concat(
        F.lit("| "), F.col("severity"), F.lit(" | "), F.col("status"), F.lit(" | "), F.replace(markdown_text(F.col("title")), F.lit("|"), F.lit("\\|")), F.lit(" | "), F.replace(markdown_code(place), F.lit("|"), F.lit("\\|")), F.lit(" |"),
    )
    order = F.concat((9 - ranks.severity_rank(F.col("severity"))).cast("string"), F.lit("|"), F.col("id"))
    return union(
        lines(summaries, doc, 0, F.lit("0"), title), lines(summaries, doc, 1, F.lit("0"), counts),
        lines(summaries, doc, 2, F.lit("0"), F.lit("| Severity | Status | Finding | Location |")), lines(summaries, doc, 2, F.lit("1"), F.lit("| --- | --- | --- | --- |")),
        lines(findings, doc, 3, order, row),
    )


def matrix_lines(matrix: DataFrame) -> DataFrame:
    """Coverage matrix per report as a Markdown table."""
    reports = matrix.select("report_id").distinct()
    doc = F.col("report_id")
    row = F.concat_ws(
        " | ", F.concat(F.lit("| "), "weakness_id"), "state", F.concat(F.col("checks_with_coverage").cast("string"), F.lit("/"), F.col("checks").cast("string")),
        F.concat(F.col("finding_count").cast("string"), F.lit(" |")),
    )
    return union(
        lines(reports, doc, 0, F.lit("0"), F.lit("| Weakness | State | Checks | Findings |")), lines(reports, doc, 0, F.lit("1"), F.lit("| --- | --- | --- | --- |")),
        lines(matrix, doc, 1, F.col("weakness_id"), row),
    )


def checklist_lines(view: DataFrame) -> DataFrame:
    """Checklist status per report as a Markdown table."""
    reports = view.select("report_id").distinct()
    doc = F.col("report_id")
    row = F.concat_ws(
        " | ", F.concat(F.lit("| "), F.replace(F.col("item_id"), F.lit("|"), F.lit("\\|"))), "status", F.col("checks").cast("string"), F.concat(F.col("finding_count").cast("string"), F.lit(" |"))
    )
    return union(
        lines(reports, doc, 0, F.lit("0"), F.lit("| Item | Status | Related checks | Findings |")), lines(reports, doc, 0, F.lit("1"), F.lit("| --- | --- | --- | --- |")),
        lines(view, doc, 1, F.col("item_id"), row),
    )


def _property(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"))


def _component_json() -> Column:
    return F.to_json(
        F.struct(
            F.lit("library").alias("type"), F.col("ref").alias("bom-ref"), "name", "version", F.nullif("purl", F.lit("")).alias("purl"),
            F.array(_property("ecosystem", F.col("ecosystem")), _property("confidence", F.col("confidence")), _property("evidence-path", F.col("path"))).alias("properties"),
        )
    )


def _comma() -> Column:
    return F.when(F.col("position") == F.col("__first"), "").otherwise(",")


def bom_lines(components: DataFrame, vulnerabilities: DataFrame, findings: DataFrame, key: str = "app_id") -> DataFrame:
    """CycloneDX 1.6 per application: components, the dependency list, and vulnerabilities with affected references.

    ``components``: deps.bom_components; ``vulnerabilities``: deps.bom_vulnerabilities; ``findings``: merged dependency
    findings with an optional first_observed. References of one vulnerability are the versions of its packages there.
    """
    placed, first, rest = bom_parts(components, vulnerabilities, findings, key)
    # The component list and the dependency list hold the same components in the same order, so one pass gives both.
    both = [F.struct(F.lit(n).alias("section"), F.concat(_comma(), x).alias("line")) for n, x in ((1, _component_json()), (3, _json_text(F.col("ref"))))]
    listed = first.join(placed, "document").select("document", "position", F.explode(F.array(*both)).alias("l"))
    return union(listed.select("document", "l.section", "position", "l.line"), rest)


def bom_parts(
    components: DataFrame, vulnerabilities: DataFrame, findings: DataFrame, key: str = "app_id", ordered: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the documents of :func:`bom_lines` are made of: components with document and position, the first position of
    every document, and the lines of all other sections.

    ``ordered``: the same components from deps.bom_components as ``ordered``, which are then the ones returned.
    """
    doc = F.col(key)
    apps = components.select(key).distinct()
    head = F.concat(
        F.lit('{"bomFormat":"CycloneDX","specVersion":"1.6","version":1,"metadata":{"component":{"type":"application","bom-ref":"app","name":'),
        _json_text(doc), F.lit('}},"components":['),
    )
    refs = vulnerabilities.groupBy(key, "vulnerability").agg(
        F.transform(F.array_sort(F.collect_set("ref")), lambda r: F.struct(r.alias("ref"))).alias("affects")
    )
    have = set(findings.columns)
    seen = F.min("first_observed") if "first_observed" in have else F.lit(None).cast("string")
    rated = findings.groupBy(key, F.col("rule_id").alias("vulnerability")).agg(
        F.max(ranks.severity_rank(F.col("severity"))).alias("__r"), F.bool_or("known_exploited").alias("known_exploited"), seen.alias("first_observed")
    )
    rows = refs.join(rated, [key, "vulnerability"])
    properties = F.array_compact(
        F.array(
            _property("known-exploited", F.when(F.col("known_exploited"), "true").otherwise("false")),
            F.when(F.col("first_observed").isNotNull(), _property("first-observed", F.col("first_observed"))),
        )
    )
    vulnerability = F.to_json(
        F.struct(
            F.concat(F.lit("vuln-"), "vulnerability").alias("bom-ref"), F.col("vulnerability").alias("id"),
            F.array(F.struct(ranks.name_of(F.col("__r"), ranks.SEVERITIES).alias("severity"))).alias("ratings"), "affects",
            F.struct(F.lit("in_triage").alias("state")).alias("analysis"), properties.alias("properties"),
        )
    )
    zero = F.lit("0")
    position = F.concat_ws("|", "ecosystem", "name", "version")
    first = components.select(doc.alias("document"), position.alias("position")).groupBy("document").agg(F.min("position").alias("__first"))
    placed = components.withColumns({"document": doc, "position": position}) if ordered is None else ordered.withColumn("document", doc)
    rest = union(
        lines(apps, doc, 0, zero, head),
        lines(apps, doc, 2, zero, F.lit('],"dependencies":[{"ref":"app","dependsOn":[')),
        lines(apps, doc, 4, zero, F.lit(']}],"vulnerabilities":[')),
        comma_separated(lines(rows, doc, 5, F.col("vulnerability"), vulnerability)),
        lines(apps, doc, 6, zero, F.lit("]}")),
    )
    return placed, first, rest


def _json_text(value: Column) -> Column:
    from sightline.functions.canonical import json_text

    return json_text(value)


# Display order of lint rows.
LINT_BUCKETS = {"fail": 0, "error": 0, "warn": 0, "info": 1, "na": 2, "pass": 3}


def lint_order() -> list[Column]:
    """Sort columns of lint rows: issues first, then by severity and check."""
    bucket = F.lit(2)
    for status, place in LINT_BUCKETS.items():
        bucket = F.when(F.col("status") == status, place).otherwise(bucket)
    severity = F.lit(9)
    for place, name in enumerate(ranks.LINT_SEVERITIES):
        severity = F.when(F.col("severity") == name, place).otherwise(severity)
    return [bucket, severity, F.col("check_id")]


def lint_text_lines(lint: DataFrame, subject: str = "app_id") -> DataFrame:
    """Plain lint report per subject: ordered rows and a closing line of counts. Control characters never reach a line."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"\x1b\[[0-9;]*[A-Za-z]", ""), r"[\x00-\x1f\x7f]", "")
    bucket, severity, check = lint_order()
    head = F.when(F.col("status").isin("pass", "na", "error"), F.concat(F.lit("["), "status", F.lit("] "))).otherwise(F.concat(F.lit("["), "severity", F.lit("/"), "status", F.lit("] ")))
    tie = F.format_string("%020d", F.col("event_id")) if "event_id" in lint.columns else F.lit("")
    position = F.concat(F.format_string("%d|%d|", bucket, severity), check, F.lit("|"), tie)
    counts = lint.groupBy(subject, "status").agg(F.count(F.lit(1)).alias("n"))
    summary = counts.groupBy(subject).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda x: F.concat(x["status"], F.lit(" "), x["n"].cast("string"))), ", ").alias("s")  # six statuses at most
    )
    return union(
        lines(lint, F.col(subject), 0, position, F.concat(head, clean(F.col("check_id")), F.lit(": "), clean(F.col("detail")))),
        lines(summary, F.col(subject), 1, F.lit("0"), F.concat(F.lit("Summary: "), F.col("s"))),
    )


def decisions(gate: DataFrame) -> DataFrame:
    """One JSON decision per evaluated report."""
    names = [c for c in gate.columns if c not in ("state", "exit_code", "reasons", "report_id")]
    body = F.to_json(
        F.struct(
            F.lit(1).alias("schema_version"), "report_id", "state", "exit_code", F.struct(*names).alias("counts"),
            F.filter(F.split("reasons", ","), lambda r: r != "").alias("reasons"),
        )
    )
    return gate.select("report_id", body.alias("decision"))


def run_summaries(findings: DataFrame, completeness: DataFrame, gate: DataFrame | None = None, fail_on: str = "high", strict: bool = False) -> DataFrame:
    """CI summary row per report: counts, whether a threshold was exceeded, and whether the audit is incomplete.

    With a gate every reason but partial-audit counts as exceeded; otherwise confirmed findings at or above ``fail_on``.
    """
    if fail_on not in ranks.SEVERITIES:
        raise ValueError(f"unsupported severity {fail_on}")
    level = ranks.SEVERITIES.index(fail_on)
    over = (F.col("status") != "candidate") & (ranks.severity_rank(F.col("severity")) >= level)
    per = findings.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("findings"), F.sum((F.col("status") == "candidate").cast("bigint")).alias("candidates"), F.bool_or(over).alias("__over")
    )
    rows = completeness.join(per, "report_id", "left")
    exceeded = F.coalesce("__over", F.lit(False))
    incomplete = F.col("incomplete") | (F.col("limited") if strict else F.lit(False))
    if gate is not None:
        rows = rows.join(gate.select("report_id", "reasons"), "report_id", "left")
        reasons = F.filter(F.split(F.coalesce("reasons", F.lit("")), ","), lambda r: (r != "") & (r != "partial-audit"))
        exceeded = F.size(reasons) > 0
        incomplete = incomplete | F.array_contains(F.split(F.coalesce("reasons", F.lit("")), ","), "partial-audit")
    return rows.select(
        "report_id", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("candidates", F.lit(0)).alias("candidates"),
        exceeded.alias("threshold_exceeded"), incomplete.alias("incomplete"),
    )


def line_counts(rows: DataFrame, keys: Sequence[str] = ("document",)) -> DataFrame:
    """Lines per document and section (a cheap check of an export)."""
    return rows.groupBy(*keys, "section").agg(F.count(F.lit(1)).alias("lines"))
