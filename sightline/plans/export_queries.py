"""Export queries: documents as ordered lines, store appends and integrity checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.canonical import digest
from sightline.operators import advisories as adv
from sightline.operators import coverage, deps, policy
from sightline.plans.advisory_queries import _CORR_SQL, rated_advisories
from sightline.plans.evidence_queries import AS_OF, RULE_STATE_SQL, _MATRIX_SQL, bridge, platform_reports, taxonomy
from sightline.plans.graph_queries import _PURL_SQL
from sightline.plans.registry import query
from sightline.plans.runtime_queries import _LINT_SQL, lint_rows
from sightline.plans.tables import Tables
from sightline.session import checkpoint_root
from sightline.sinks import documents, store

_FIRST = "CASE WHEN row_number() OVER (PARTITION BY report_id ORDER BY {o}) = 1 THEN '' ELSE ',' END"


def titled(t: Tables) -> DataFrame:
    return t.findings.withColumn("title", F.concat(F.lit("Use of *"), "event_type", F.lit("* <x>")))


def report_flags(t: Tables) -> DataFrame:
    return coverage.report_completeness(t.reports.select("report_id"), t.coverage)


def sarif_rows(t: Tables) -> DataFrame:
    return documents.sarif_lines(
        titled(t), coverage.export_rules(t.findings), coverage.coverage_notifications(t.coverage), report_flags(t), root="repo"
    )


@query(
    "snk_01_sarif_results",
    f"""SELECT report_id AS document, id AS position, {_FIRST.format(o='id')} || '{{"ruleId":"' || rule_id || CASE WHEN status = 'candidate' THEN '/candidate' ELSE '' END || '","level":"' ||
        CASE WHEN severity IN ('critical', 'high') THEN CASE WHEN status = 'candidate' THEN 'warning' ELSE 'error' END WHEN severity = 'medium' THEN 'warning' ELSE 'note' END || '","message":{{"text":"Use of *' || event_type || '* <x> [' || status ||
        ']."}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"repo/' || path || '"}},"region":{{"startLine":' || line || '}}}}}}],"partialFingerprints":{{"findingIdentity/v1":"' || id || '"}},"properties":{{"status":"' || status || '","severity":"' || severity || '","findingId":"' || id || '"}}}}' AS line
       FROM findings""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    return sarif_rows(t).where("section = 3").select("document", "position", "line")


@query(
    "snk_01_sarif_sections",
    f"""WITH c AS (SELECT report_id, count(*) AS n FROM findings GROUP BY report_id), r AS (SELECT report_id, count(DISTINCT rule_id || CASE WHEN status = 'candidate' THEN '/c' ELSE '' END) AS n FROM findings GROUP BY report_id),
         q AS (SELECT report_id, count(*) AS n FROM coverage WHERE state IN ('partial', 'limited', 'not-run') GROUP BY report_id)
       SELECT report_id AS document, 1 AS section, n AS lines FROM r UNION ALL SELECT report_id, 3, n FROM c UNION ALL SELECT report_id, 5, n FROM q UNION ALL SELECT report_id, unnest([0, 2, 4, 6]), 1 FROM c""",
    ("findings", "coverage"),
)
def _(t: Tables) -> DataFrame:
    return documents.line_counts(sarif_rows(t))


def document_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/documents-{uuid.uuid4().hex}"


def written_and_read(rows: DataFrame) -> DataFrame:
    """Whole documents written as part files to the shared folder and read back from there."""
    spark = rows.sparkSession
    path = document_folder(spark)
    documents.write_documents(rows, path)
    return documents.read_documents(spark, path)


_RULE_ID = "rule_id || CASE WHEN status = 'candidate' THEN '/candidate' ELSE '' END"
_LEVEL = "CASE WHEN severity IN ('critical', 'high') THEN CASE WHEN status = 'candidate' THEN 'warning' ELSE 'error' END WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"


@query(
    "snk_01_sarif_parsed",
    f"""SELECT report_id AS document, 'result' AS kind, {_RULE_ID} || '|' || {_LEVEL} || '|Use of *' || event_type || '* <x> [' || status || '].|repo/' || path || '|' || line || '|' || status || '|' || severity || '|' || id AS key FROM findings
       UNION ALL SELECT report_id, 'rule', r || '|' || ['note', 'warning', 'error'][1 + max(l)] FROM (SELECT report_id, {_RULE_ID} AS r, CASE {_LEVEL} WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END AS l FROM findings) GROUP BY report_id, r
       UNION ALL SELECT report_id, 'notification', rule_id || '|' || rule_id || ': ' || state FROM coverage WHERE state IN ('partial', 'limited', 'not-run')""",
    ("findings", "coverage"),
)
def _(t: Tables) -> DataFrame:
    return documents.parse_sarif(written_and_read(sarif_rows(t)))


@query(
    "snk_02_lint_sarif",
    f"""WITH {_LINT_SQL}, s AS (SELECT *, lpad(CAST(event_id AS VARCHAR), 20, '0') AS pos FROM ln WHERE status IN ('fail', 'error', 'warn', 'info'))
       SELECT app_id AS document, pos AS position, CASE WHEN row_number() OVER (PARTITION BY app_id ORDER BY pos) = 1 THEN '' ELSE ',' END || '{{"ruleId":"' || check_id || '","kind":"fail","level":"' || CASE WHEN status IN ('fail', 'error') THEN 'error' WHEN status = 'warn' THEN 'warning' ELSE 'note' END ||
         '","message":{{"text":"' || detail || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || app_id || '"}}}}}}]}}' AS line FROM s""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    return documents.lint_sarif_lines(lint_rows(t)).where("section = 1").select("document", "position", "line")


@query(
    "snk_03_markdown_report",
    """SELECT report_id AS document, (9 - CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) || '|' || id AS position,
        '| ' || severity || ' | ' || status || ' | Use of \\*' || event_type || '\\* &lt;x&gt; | `' || path || ':' || line || '` |' AS line FROM findings""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    rows = documents.markdown_lines(titled(t), coverage.summarize(t.findings, t.coverage))
    return rows.where("section = 3").select("document", "position", "line")


@query(
    "snk_04_bom_components",
    f"""WITH x AS (SELECT app_id, ecosystem, name, version, {_PURL_SQL} AS ref, CASE max(CASE confidence WHEN 'exact' THEN 2 WHEN 'declared' THEN 1 ELSE 0 END) WHEN 2 THEN 'exact' WHEN 1 THEN 'declared' ELSE 'unknown' END AS confidence, min(path) AS path FROM deps GROUP BY app_id, ecosystem, name, version)
       SELECT app_id AS document, ecosystem || '|' || name || '|' || version AS position, CASE WHEN row_number() OVER (PARTITION BY app_id ORDER BY ecosystem || '|' || name || '|' || version) = 1 THEN '' ELSE ',' END || '{{"type":"library","bom-ref":"' || ref || '","name":"' || name || '","version":"' || version || '","purl":"' || ref ||
         '","properties":[{{"name":"ecosystem","value":"' || ecosystem || '"}},{{"name":"confidence","value":"' || confidence || '"}},{{"name":"evidence-path","value":"' || path || '"}}]}}' AS line FROM x""",
    ("deps",),
)
def _(t: Tables) -> DataFrame:
    return bom_document(t).where("section = 1").select("document", "position", "line")


def bom_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    rated = rated_advisories(t)
    # Only packages that an advisory names meet advisories; Spark leaves the others out before it gathers equal rows.
    coordinate = ["name", "ecosystem", "version"]
    named = t.deps.join(rated.select(*coordinate).distinct(), coordinate, "left_semi").select(*t.deps.columns)
    matches = adv.correlate(named, rated)
    merged = adv.merge_dependency_findings(matches).withColumn("first_observed", F.lit("2024-01-01"))
    return deps.bom_components(t.deps), deps.bom_vulnerabilities(matches, deps.bom_components(named)), merged


def bom_document(t: Tables) -> DataFrame:
    return documents.bom_lines(*bom_tables(t))


@query(
    "snk_04_bom_vulnerabilities",
    f"""WITH {_CORR_SQL}, v AS (SELECT app_id, rule_id, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS r, bool_or(known_exploited) AS ke, list_sort(list(DISTINCT {_PURL_SQL})) AS refs FROM m GROUP BY app_id, rule_id)
       SELECT app_id AS document, rule_id AS position, CASE WHEN row_number() OVER (PARTITION BY app_id ORDER BY rule_id) = 1 THEN '' ELSE ',' END || '{{"bom-ref":"vuln-' || rule_id || '","id":"' || rule_id || '","ratings":[{{"severity":"' || ['info', 'low', 'medium', 'high', 'critical'][1 + r] ||
         '"}}],"affects":[' || array_to_string(list_transform(refs, lambda x: '{{"ref":"' || x || '"}}'), ',') || '],"analysis":{{"state":"in_triage"}},"properties":[{{"name":"known-exploited","value":"' || CASE WHEN ke THEN 'true' ELSE 'false' END || '"}},{{"name":"first-observed","value":"2024-01-01"}}]}}' AS line FROM v""",
    ("deps", "advisories"),
)
def _(t: Tables) -> DataFrame:
    return bom_document(t).where("section = 5").select("document", "position", "line")


@query(
    "snk_04_bom_parsed",
    f"""WITH {_CORR_SQL}, c AS (SELECT app_id, ecosystem, name, version, {_PURL_SQL} AS ref, max(CASE confidence WHEN 'exact' THEN 2 WHEN 'declared' THEN 1 ELSE 0 END) AS conf FROM deps GROUP BY app_id, ecosystem, name, version),
        v AS (SELECT app_id, rule_id, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS r, count(DISTINCT {_PURL_SQL}) AS refs FROM m GROUP BY app_id, rule_id)
       SELECT app_id AS document, 'component' AS kind, ref || '|' || name || '|' || version || '|' || ['unknown', 'declared', 'exact'][1 + conf] AS key FROM c
       UNION ALL SELECT app_id, 'dependency', ref FROM c
       UNION ALL SELECT app_id, 'vulnerability', rule_id || '|' || ['info', 'low', 'medium', 'high', 'critical'][1 + r] || '|' || refs FROM v""",
    ("deps", "advisories"),
)
def _(t: Tables) -> DataFrame:
    path = document_folder(t.spark)
    documents.write_bom(documents.bom_parts(*bom_tables(t), ordered=deps.bom_components(t.deps_rows, ordered=True)), path)
    return documents.parse_bom(documents.read_documents(t.spark, path))


@query(
    "snk_05_matrix_document",
    f"""WITH {_MATRIX_SQL}, l AS (SELECT report_id AS document, 1 AS section, weakness_id AS position, '| ' || weakness_id || ' | ' || state || ' | ' || checks_with_coverage || '/' || checks || ' | ' || finding_count || ' |' AS line FROM matrix
         UNION ALL SELECT report_id, 0, unnest(['0', '1']), unnest(['| Weakness | State | Checks | Findings |', '| --- | --- | --- | --- |']) FROM (SELECT DISTINCT report_id FROM matrix))
       SELECT document, row_number() OVER w AS ordinal, CAST(sum(strlen(line) + 1) OVER w - strlen(line) - 1 AS BIGINT) AS "offset", line FROM l
       WINDOW w AS (PARTITION BY document ORDER BY section, position ROWS UNBOUNDED PRECEDING)""",
    ("findings", "coverage", "reports"),
)
def _(t: Tables) -> DataFrame:
    matrix = coverage.coverage_matrix(platform_reports(t), t.coverage, t.findings, taxonomy(t), bridge(t), samples=50)
    return documents.placed(documents.matrix_lines(matrix)).select("document", "ordinal", "offset", "line")


@query(
    "snk_05_coverage_matrix_table",
    f"""WITH {_MATRIX_SQL} SELECT report_id AS document, weakness_id AS position, '| ' || weakness_id || ' | ' || state || ' | ' || checks_with_coverage || '/' || checks || ' | ' || finding_count || ' |' AS line FROM matrix""",
    ("findings", "coverage", "reports"),
)
def _(t: Tables) -> DataFrame:
    matrix = coverage.coverage_matrix(platform_reports(t), t.coverage, t.findings, taxonomy(t), bridge(t), samples=50)
    return documents.matrix_lines(matrix).where("section = 1").select("document", "position", "line")


@query(
    "snk_05_checklist_table",
    f"""WITH {_MATRIX_SQL}, fc AS (SELECT report_id, count(DISTINCT id) AS n FROM findings WHERE rule_id IN ('RULE-CLICK', 'RULE-VIEW') GROUP BY report_id)
       SELECT report_id AS document, 'C-1' AS position, '| C-1 | findings | 2 | ' || n || ' |' AS line FROM fc WHERE n > 0""",
    ("findings", "coverage", "reports"),
)
def _(t: Tables) -> DataFrame:
    items = coverage.builtin_checklist(taxonomy(t))
    matrix = coverage.coverage_matrix(t.reports.select("report_id"), t.coverage, t.findings, taxonomy(t), bridge(t), samples=50)
    view = coverage.checklist_view(matrix, t.coverage, t.findings, items, bridge(t))
    rows = documents.checklist_lines(view.where("status = 'findings'"))
    return rows.where("section = 1 AND position = 'C-1'").select("document", "position", "line")


def headers(t: Tables) -> DataFrame:
    return t.reports.select("report_id", "target", "day", digest(F.concat_ws("|", "report_id", F.col("rows_seen").cast("string"))).alias("body_hash"))


@query(
    "snk_06_append_plan",
    """SELECT report_id, CASE WHEN day(day) > 20 THEN 'new' WHEN day(day) % 5 = 0 THEN 'conflict' ELSE 'identical' END AS outcome FROM reports""",
    ("reports",),
)
def _(t: Tables) -> DataFrame:
    saved = headers(t).where(F.dayofmonth("day") <= 20)
    stored = saved.withColumn("body_hash", F.when(F.dayofmonth("day") % 5 == 0, F.lit("other")).otherwise(F.col("body_hash")))
    new, same, conflicts = store.plan_append(stored, headers(t))
    tag = lambda df, name: df.select("report_id", F.lit(name).alias("outcome"))
    return tag(new, "new").unionByName(tag(same, "identical")).unionByName(tag(conflicts, "conflict"))


@query(
    "agg_36_store_integrity",
    """SELECT CASE WHEN day(day) % 7 = 0 THEN 'body-mismatch' WHEN day(day) % 4 = 0 THEN 'export-mismatch' ELSE 'ok' END AS state, count(*) AS reports FROM reports GROUP BY 1""",
    ("reports",),
)
def _(t: Tables) -> DataFrame:
    columns = ["id", "rule_id", "severity", "status"]
    content = store.content_digests(t.findings, ["report_id"], ["id"], columns)
    day = F.dayofmonth(F.to_date(F.split_part(F.col("report_id"), F.lit("@"), F.lit(2))))
    saved = content.select("report_id", F.when(day % 7 == 0, F.reverse("content_hash")).otherwise(F.col("content_hash")).alias("body_hash"))
    exports = saved.where(day % 3 != 0).unionByName(saved.where(day % 3 == 0)).withColumn("body_hash", F.when(day % 4 == 0, F.lit("edited")).otherwise(F.col("body_hash")))
    return store.verify_store(saved, content, exports).groupBy("state").agg(F.count(F.lit(1)).alias("reports"))


@query(
    "snk_07_content_digests",
    """WITH h AS (SELECT report_id, id, sha256('{"id":"' || id || '","rule_id":"' || rule_id || '","severity":"' || severity || '","status":"' || status || '"}') AS h FROM findings)
       SELECT report_id, sha256(string_agg(h, '' ORDER BY id)) AS content_hash FROM h GROUP BY report_id""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    return store.content_digests(t.findings, ["report_id"], ["id"], ["id", "rule_id", "severity", "status"])


@query(
    "snk_07_approved_baselines",
    """SELECT r.report_id, CASE WHEN coalesce(c.partial, false) OR day(r.day) % 3 = 0 THEN 'incomplete-audit' WHEN day(r.day) % 4 = 0 THEN 'ambiguous-application' ELSE 'approved' END AS outcome
       FROM reports r LEFT JOIN (SELECT report_id, bool_or(state = 'partial') AS partial FROM coverage GROUP BY report_id) c USING (report_id)""",
    ("reports", "coverage"),
)
def _(t: Tables) -> DataFrame:
    day = F.dayofmonth("day")
    reports = t.reports.select("report_id", (day % 3 != 0).alias("fingerprint_complete"))
    packages = F.when(day % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    apps = t.reports.select("report_id", F.lit("android").alias("platform"), F.explode(packages).alias("package"))
    good, bad = store.approved_baselines(reports, t.findings, report_flags(t), apps, "reviewer", "ticket 1")
    return good.select("report_id", F.lit("approved").alias("outcome")).unionByName(bad.select("report_id", F.col("code").alias("outcome")))


@query(
    "snk_08_gate_decisions",
    """WITH c AS (SELECT report_id, count(*) AS total, count(*) FILTER (WHERE status = 'candidate') AS ex, count(*) FILTER (WHERE severity = 'critical' AND status <> 'candidate') AS n FROM findings GROUP BY report_id)
       SELECT report_id, '{"schema_version":1,"report_id":"' || report_id || '","state":"' || CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END || '","exit_code":' || CASE WHEN n > 0 THEN 4 ELSE 0 END || ',"counts":{"total":' || total || ',"status_excluded":' || ex ||
        '},"reasons":[' || CASE WHEN n > 0 THEN '"severity-threshold:critical"' ELSE '' END || ']}' AS decision FROM c""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    rules = policy.Policy(thresholds={"critical": 0, "high": -1}, fail_on_partial=False)
    gate = policy.evaluate(t.findings, t.coverage, rules, AS_OF)
    return documents.decisions(gate.select("report_id", "total", "status_excluded", "state", "exit_code", "reasons"))


@query(
    "snk_09_run_summaries",
    """SELECT r.report_id, f.n AS findings, f.c AS candidates, f.over AS threshold_exceeded, coalesce(c.partial, false) OR coalesce(c.lim, false) AS incomplete FROM reports r
       JOIN (SELECT report_id, count(*) AS n, count(*) FILTER (WHERE status = 'candidate') AS c, bool_or(status <> 'candidate' AND severity = 'critical') AS over FROM findings GROUP BY report_id) f USING (report_id)
       LEFT JOIN (SELECT report_id, bool_or(state = 'partial') AS partial, bool_or(state = 'limited') AS lim FROM coverage GROUP BY report_id) c USING (report_id)""",
    ("reports", "findings", "coverage"),
)
def _(t: Tables) -> DataFrame:
    return documents.run_summaries(t.findings, report_flags(t), fail_on="critical", strict=True)


@query(
    "snk_09_gated_summaries",
    f"""WITH s AS (SELECT report_id, rule_id, {RULE_STATE_SQL} AS state FROM coverage GROUP BY ALL), n AS (SELECT report_id, count(*) FILTER (WHERE severity = 'critical' AND status <> 'candidate') AS n FROM findings GROUP BY report_id),
         p AS (SELECT report_id, bool_or(state = 'partial') AS partial FROM coverage GROUP BY report_id) SELECT n.report_id, n.n > 0 AS threshold_exceeded, p.partial AS incomplete FROM n JOIN p USING (report_id)""",
    ("findings", "coverage"),
)
def _(t: Tables) -> DataFrame:
    gate = policy.evaluate(t.findings, t.coverage, policy.Policy(thresholds={"critical": 0, "high": -1}), AS_OF)
    return documents.run_summaries(t.findings, report_flags(t), gate).select("report_id", "threshold_exceeded", "incomplete")


@query(
    "snk_10_lint_report",
    f"""WITH {_LINT_SQL}, o AS (SELECT *, CASE status WHEN 'info' THEN 1 WHEN 'na' THEN 2 WHEN 'pass' THEN 3 ELSE 0 END AS b, CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END AS s FROM ln)
       SELECT app_id AS document, 0 AS section, b || '|' || s || '|' || check_id || '|' || lpad(CAST(event_id AS VARCHAR), 20, '0') AS position, CASE WHEN status IN ('pass', 'na', 'error') THEN '[' || status || '] ' ELSE '[' || severity || '/' || status || '] ' END || check_id || ': ' || detail AS line FROM o
       UNION ALL SELECT app_id, 1, '0', 'Summary: ' || string_agg(status || ' ' || n, ', ' ORDER BY status) FROM (SELECT app_id, status, count(*) AS n FROM ln GROUP BY ALL) GROUP BY app_id""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    return documents.lint_text_lines(lint_rows(t))


@query(
    "srt_02_lint_order",
    f"""WITH {_LINT_SQL}, o AS (SELECT *, CASE status WHEN 'info' THEN 1 WHEN 'na' THEN 2 WHEN 'pass' THEN 3 ELSE 0 END AS b, CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END AS s FROM ln)
       SELECT event_id, status, severity, check_id, row_number() OVER (ORDER BY b, s, check_id, event_id) AS place FROM o""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    from sightline.scale import numbered

    rows = lint_rows(t).select("event_id", "status", "severity", "check_id", *[c.alias(f"by_{k}") for k, c in enumerate(documents.lint_order())])
    return numbered(rows, [], ["by_0", "by_1", "by_2", "event_id"], "place").select("event_id", "status", "severity", "check_id", "place")
