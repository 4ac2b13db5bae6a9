"""Truth tables of the operators."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sightline.functions.canonical import dependency_identity
from sightline.operators import advisories, compare, coverage, credentials, detect, graph, identity, metrics, policy, runtime
from sightline.sinks import documents, store
from sightline.sources import build_files, corpus, tables


def test_rule_state_lattice(spark):
    cases = {
        ("checked",): "checked", ("checked", "not-applicable"): "checked", ("limited", "checked"): "limited", ("checked", "not-run"): "partial",
        ("partial", "checked"): "partial", ("not-run",): "not-run", ("not-applicable",): "not-applicable", ("limited",): "limited", ("not-run", "not-applicable"): "not-run",
    }
    data = [("r", f"case{i}", s) for i, states in enumerate(cases) for s in states]
    got = {r["rule_id"]: r["state"] for r in coverage.rule_states(spark.createDataFrame(data, "report_id string, rule_id string, state string")).collect()}
    assert [got[f"case{i}"] for i in range(len(cases))] == list(cases.values())


def test_aggregate_state_lattice(spark):
    cases = {
        ("checked", "not-applicable"): "checked", ("checked", "limited"): "limited", ("checked", "not-run"): "partial", ("partial",): "partial", ("not-run",): "not-run",
        ("not-applicable",): "not-applicable", ("limited", "not-run"): "partial",
    }
    for states, expected in cases.items():
        df = spark.createDataFrame([(s,) for s in states], "state string").agg(coverage.state_mask(F.col("state")).alias("m"))
        assert df.select(coverage.aggregate_state(F.col("m")).alias("s")).first()["s"] == expected


FINDINGS = "report_id string, id string, rule_id string, severity string, status string, known_exploited boolean"


def gate(spark, rows, waivers=None, **options):
    findings = spark.createDataFrame(rows, FINDINGS)
    cov = spark.createDataFrame([("r", "A", "checked")], "report_id string, rule_id string, state string")
    held = None if waivers is None else spark.createDataFrame(waivers, "finding_id string, expires date, severity string, known_exploited boolean")
    return policy.evaluate(findings, cov, policy.Policy(**options), dt.datetime(2026, 10, 4, 12), held).first()


def test_default_policy_gates_confirmed_evidence_only(spark):
    assert gate(spark, [("r", "1", "A", "critical", "candidate", False)])["state"] == "passed"
    failed = gate(spark, [("r", "1", "A", "high", "configuration-confirmed", False)])
    assert (failed["state"], failed["exit_code"], failed["reasons"]) == ("failed", 4, "severity-threshold:high")


def test_waiver_expiry_is_inclusive_and_escalation_reopens(spark):
    row = [("r", "1", "A", "high", "configuration-confirmed", False)]
    today = dt.date(2026, 10, 4)
    assert gate(spark, row, [("1", today, "high", None)])["state"] == "passed"
    assert gate(spark, row, [("1", today - dt.timedelta(1), "high", None)])["state"] == "failed"
    assert gate(spark, row, [("1", today, "medium", None)])["state"] == "failed"
    assert gate(spark, row, [("1", today, None, None)])["state"] == "passed"
    assert gate(spark, row, [("1", today, None, None), ("1", today, "low", None)])["state"] == "failed"
    exploited = [("r", "1", "A", "high", "configuration-confirmed", True)]
    assert gate(spark, exploited, [("1", today, "high", False)])["state"] == "failed"
    assert gate(spark, exploited, [("1", today, "high", True)])["state"] == "passed"


def sided(spark, rows):
    locate = lambda c: dependency_identity(c, F.lit("npm"), F.lit("p"), F.lit("x"))
    df = spark.createDataFrame(rows, "rule_id string, advisory_ids array<string>")
    df = df.select("rule_id", "advisory_ids", F.lit("npm").alias("ecosystem"), F.lit("p").alias("name"), F.lit("x").alias("path"), locate(F.col("rule_id")).alias("id"))
    return identity.with_dependency_identities(df)


@pytest.mark.parametrize(
    ("current", "previous", "expected"),
    [
        ([("CVE-1", ["CVE-1", "GHSA-1"])], [("GHSA-1", ["GHSA-1"])], {("CVE-1", "GHSA-1", "advisory-alias")}),
        ([("CVE-1", ["CVE-1", "X"])], [("CVE-2", ["CVE-2", "X"])], set()),
        ([("CVE-1", ["GHSA-1"]), ("CVE-2", ["GHSA-1"])], [("GHSA-1", [])], set()),
        ([("CVE-1", ["CVE-1", "GHSA-1"])], [("CVE-1", []), ("GHSA-1", [])], {("CVE-1", "CVE-1", "identity")}),
        ([("CVE-1", ["GHSA-1", "GHSA-2"])], [("GHSA-1", []), ("GHSA-2", [])], set()),
        ([("CVE-1", []), ("CVE-2", ["CVE-1"])], [("CVE-1", [])], {("CVE-1", "CVE-1", "identity")}),
    ],
)
def test_alias_matches_are_one_to_one(spark, current, previous, expected):
    now, old = sided(spark, current), sided(spark, previous)
    pairs = identity.match_identities(now, old)
    names = pairs.join(now.select(F.col("id").alias("current_id"), F.col("rule_id").alias("c")), "current_id").join(
        old.select(F.col("id").alias("previous_id"), F.col("rule_id").alias("p")), "previous_id"
    )
    assert {(r["c"], r["p"], r["basis"]) for r in names.collect()} == expected


def test_unfinished_risky_cases_stay_in_end_to_end_recall(spark):
    rows = [("t", "completed", True, True, 1.0), ("t", "failed", False, True, 3.0)]
    got = metrics.tool_scores(spark.createDataFrame(rows, "tool string, state string, detected boolean, risky boolean, seconds double")).first()
    assert (got["completed_recall"], got["end_to_end_recall"], got["median_seconds"]) == (1.0, 0.5, 2.0)


@pytest.mark.parametrize(
    ("expect", "before", "after", "state"),
    [("present", False, True, "passed"), ("present", True, True, "inconclusive"), ("present", False, False, "failed"),
     ("absent", True, True, "failed"), ("absent", True, False, "passed"), ("absent", False, False, "inconclusive")],
)
def test_canary_assertions(spark, expect, before, after, state):
    surfaces = spark.createDataFrame([("s", "a", "storage", "captured", ""), ("s", "b", "storage", "captured", "")], "scenario string, snapshot string, surface string, state string, acquisition string")
    seen = [("s", n, "storage", "m", "recorder") for n, hit in (("a", before), ("b", after)) if hit]
    matches = spark.createDataFrame(seen, "scenario string, snapshot string, surface string, marker string, origin string")
    asked = spark.createDataFrame([("s", 1, "a", "b", "m", None, expect)], "scenario string, assertion_id int, baseline string, snapshot string, marker string, surface string, expect string")
    assert runtime.evaluate_assertions(asked, surfaces, matches).first()["state"] == state


def test_range_conflicts_are_unknown(spark):
    def decide(version, *entries):
        cols = [F.struct(*[F.lit(e.get(k)).cast("boolean" if k == "changes" else "string").alias(k) for k in ("version", "status", "versionType", "lessThan", "lessThanOrEqual", "changes")]) for e in entries]
        return spark.range(1).select(advisories.in_published_range(F.lit(version), F.array(*cols).cast(advisories.RANGE_TYPE)).alias("v")).first()["v"]

    affected = {"version": "1.0", "status": "affected", "lessThan": "2.0"}
    assert decide("1.5", affected) is True
    assert decide("2.0", affected) is None
    assert decide("1.5", affected, {"version": "1.5", "status": "unaffected"}) is None
    assert decide("2.0", {"version": "1.0", "status": "unaffected", "lessThanOrEqual": "2.0"}) is False
    assert decide("1.5", {**affected, "versionType": "custom"}) is None
    assert decide("nonsense", affected) is None


def test_private_key_screening(spark):
    begin, end = "-----BEGIN " + "RSA PRIVATE KEY-----", "-----END " + "RSA PRIVATE KEY-----"
    body = "QUJD" * 16
    texts = {
        "whole": f"{begin}\n{body}\n{end}", "escaped": f'k = "{begin}\\n{body}\\n{end}"', "headers": f"{begin}\nProc-Type: 4,ENCRYPTED\n\n{body}\n{end}", "short": f"{begin}\nQUJD\n{end}",
        "footer": f"{begin}\n{body}\n-----END " + "EC PRIVATE KEY-----", "joined": f'"{begin}" +\n"{body}"', "bare": f"see {begin} here",
    }
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "name string, text string")
    rows = df.select("name", F.explode(credentials.private_keys(F.col("text"))).alias("k")).collect()
    valid = {r["name"] for r in rows if r["k"]["valid"]}
    assert valid == {"whole", "escaped", "headers"} and len(rows) == len(texts)


def test_catalogue_scan_reports_lines_and_ignores_comments(spark):
    code = "class A {\n  // handler.proceed()\n  fun onReceivedSslError(h: H) {\n    handler\n      .proceed()\n  }\n}"
    df = spark.createDataFrame([("app", "A.kt", ".kt", code)], "app_id string, path string, suffix string, text string").withColumn("platforms", F.array(F.lit("android")))
    rule = [r for r in detect.catalogue() if r.rule_id == "WEBVIEW-SSL-BYPASS"]
    got = detect.scan(df, rule).collect()
    assert [(r["line"], r["matches"]) for r in got] == [(4, 1)]
    states = {r["rule_id"]: r["state"] for r in detect.scan_coverage(df, detect.catalogue(), detect.scan(df, rule)).collect()}
    assert states["WEBVIEW-SSL-BYPASS"] == "checked" and states["IOS-UIWEBVIEW"] == "not-applicable"


def test_every_catalogue_pattern_compiles_in_both_engines(spark):
    import re

    for rule in detect.catalogue():
        re.compile(rule.pattern)
        spark.range(1).select(F.lit("x").rlike(rule.java_pattern)).collect()


def test_flow_paths_stop_at_guards_and_report_cuts(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(0, 5)], "src int, dst int")
    starts = spark.createDataFrame([(0, "o")], "node int, origin string")
    sinks = spark.createDataFrame([(3, "R"), (6, "R"), (12, "R")], "node int, rule_id string")
    found, cuts = graph.flow_paths(edges, starts, sinks, depth=4)
    assert {(r["sink"], r["steps"]) for r in found.collect()} == {(3, 3), (6, 2)}
    assert {r["node"] for r in cuts.collect()} == {8}
    guards = spark.createDataFrame([(5,), (2,)], "node int")
    assert graph.flow_paths(edges, starts, sinks, depth=4, guards=guards)[0].count() == 0


def test_cycles_settle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = graph.reachable(edges, spark.createDataFrame([("a",)], "module string"))
    assert {r["module"] for r in got.collect()} == {"a", "b", "c", "d"}


def test_claims_without_examination_are_not_run(spark):
    claims = spark.createDataFrame([("c", "r", None, None, None, "A")], "claim_id string, report_id string, path string, line int, weakness_id string, rule_id string")
    findings = spark.createDataFrame([], "report_id string, id string, rule_id string, origin string, path string, line int, status string")
    cov = spark.createDataFrame([("r", "A", "not-run")], "report_id string, rule_id string, state string")
    none = spark.createDataFrame([], "rule_id string, weakness_id string")
    done = spark.createDataFrame([("r", False)], "report_id string, incomplete boolean")
    files = spark.createDataFrame([], "report_id string, path string, state string")
    assert compare.verify_claims(claims, findings, cov, none, done, files).first()["verdict"] == "not-run"


def test_corpus_reader(spark, tmp_path):
    for name, text in {"app1/src/A.kt": "val a = 1", "app1/node_modules/B.js": "x", "app2/C.png": "p", "app2/res/D.xml": "﻿<a/>"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    rows = {(r["app_id"], r["path"], r["suffix"], r["text"]) for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert rows == {("app1", "src/A.kt", ".kt", "val a = 1"), ("app2", "res/D.xml", ".xml", "<a/>")}


def test_rule_file_reader(spark, tmp_path):
    from importlib.resources import files

    path = str(files("sightline").joinpath("data", "rules.json"))
    rules = detect.rules_from(corpus.read_rules(spark, path))
    assert {r.rule_id for r in rules} == {r.rule_id for r in detect.catalogue()}


def test_catalogue_references_and_bundles(spark):
    toml = '[versions]\nkt = "2.0"\n[libraries]\na = { module = "g:a", version.ref = "kt" }\nb = "g:b:1.0"\nc = { group = "g", name = "c" }\n[bundles]\nall = ["a", "b"]\n'
    df = spark.createDataFrame([("app", "gradle/libs.versions.toml", toml), ("app", "x.versions.toml", "= broken")], "app_id string, path string, text string")
    got = {(r["x_alias"], r["name"], r["version"], tuple(r["x_bundles"])) for r in build_files.catalog_rows(df).collect()}
    assert got == {("a", "g:a", "2.0", ("all",)), ("b", "g:b", "1.0", ("all",))}


def test_written_documents_are_valid_json(spark, tmp_path):
    findings = spark.createDataFrame([("r1", f"F-{i:03d}", "A", "high", "candidate" if i % 2 else "configuration-confirmed", "Ti\"tle", f"src/F{i}.kt", i) for i in range(50)],
                                     "report_id string, id string, rule_id string, severity string, status string, title string, path string, line int")
    cov = spark.createDataFrame([("r1", "A", "partial"), ("r1", "B", "checked")], "report_id string, rule_id string, state string")
    reports = coverage.report_completeness(findings.select("report_id").distinct(), cov)
    rows = documents.sarif_lines(findings, coverage.export_rules(findings), coverage.coverage_notifications(cov), reports)
    target = tmp_path / "out"
    documents.write_documents(rows, str(target))
    parts = sorted((target / "document=r1").glob("part-*"))
    body = json.loads("".join(p.read_text() for p in parts))
    run = body["runs"][0]
    assert len(run["results"]) == 50 and len(run["tool"]["driver"]["rules"]) == 2
    assert run["invocations"][0]["executionSuccessful"] is False and run["properties"]["reportId"] == "r1"


def test_store_appends_are_immutable(spark, tmp_path):
    headers = spark.createDataFrame([("r1", "t", "h1"), ("r2", "t", "h2")], "report_id string, target string, body_hash string")
    empty = headers.limit(0)
    new, same, conflicts = store.plan_append(empty, headers)
    rows = spark.createDataFrame([("r1", "t", "f1"), ("r2", "t", "f2")], "report_id string, target string, id string")
    store.append_reports(str(tmp_path / "store"), headers, new, {"findings": rows})
    saved = spark.read.parquet(str(tmp_path / "store" / "reports"))
    again = spark.createDataFrame([("r1", "t", "h1"), ("r2", "t", "other"), ("r3", "t", "h3")], "report_id string, target string, body_hash string")
    new, same, conflicts = store.plan_append(saved, again)
    names = lambda df: [r["report_id"] for r in df.collect()]
    assert (names(new), names(same), names(conflicts)) == (["r3"], ["r1"], ["r2"])


def test_content_digest_levels(spark, monkeypatch):
    rows = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 1)], "key string, n int")
    whole = {r["key"]: r["content_hash"] for r in store.content_digests(rows, ["key"], ["n"], ["n"]).collect()}
    monkeypatch.setattr(store, "CHUNK", 7)
    chunked = {r["key"]: r["content_hash"] for r in store.content_digests(rows.repartition(5), ["key"], ["n"], ["n"]).collect()}
    changed = {r["key"]: r["content_hash"] for r in store.content_digests(rows.where("n <> 50"), ["key"], ["n"], ["n"]).collect()}
    assert set(whole) == set(chunked) == {"a", "b"} and chunked["a"] != changed["a"]


def test_policy_tables_are_strict(spark):
    make = lambda rows: tables.policy_from(spark.createDataFrame(rows, "key string, value string"))
    assert make([("thresholds.high", "2"), ("only_new", "true")]).thresholds["high"] == 2
    for bad in ([("only_new", "maybe")], [("x", "1")], [("only_new", "true"), ("only_new", "true")], [("thresholds.high", "-2")], [("allowed_statuses", "proven")]):
        with pytest.raises(ValueError):
            make(bad)


def _sarif_document(report, results, rules):
    import json

    run = {"tool": {"driver": {"name": "Scanner", "rules": rules}}, "results": results}
    return (report, "scan", json.dumps({"version": "2.1.0", "runs": [run]}))


def test_sarif_rules_are_found_inside_the_run(spark):
    from sightline.sources import sarif

    rules = [{"id": "A", "helpUri": "a0"}, {"id": "B"}, {"id": "A", "helpUri": "a2"}, None, {"helpUri": "nameless"}]
    asked = [{"ruleId": "A"}, {"ruleIndex": 2}, {"ruleId": "A", "ruleIndex": 1}, {"ruleId": "B", "ruleIndex": 1}, {"ruleId": "Z"}, {"ruleIndex": 9}, {"ruleIndex": -1}, {"ruleId": "", "ruleIndex": 4}, {"ruleIndex": 3}, {}]
    rows = [_sarif_document("r1", asked, rules), _sarif_document("r2", asked[:2], []), _sarif_document(None, asked[:4], rules), ("r3", "scan", "{}")]
    schema = "report_id string, tool string, body string"

    def shown(documents):
        found, rejects = sarif.parsed_results(documents)
        key = lambda r: tuple(str(v) for v in r)
        return found, sorted(map(key, found.collect())), sorted(map(key, rejects.collect()))

    found, own, rejects = shown(spark.createDataFrame(rows, schema))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    # a document that shares the key of another one meets the rules of both, by joins
    twin = ("r4", "scan", rows[0][2])
    _, joined, more = shown(spark.createDataFrame([*rows, twin, twin], schema))
    assert own == [r for r in joined if r[0] != "r4"] and rejects == [r for r in more if r[0] != "r4"]
    assert len([r for r in joined if r[0] == "r4"]) > 2 * len([r for r in joined if r[0] == "r1"])


def test_a_manifest_is_parsed_once(spark):
    from sightline.sources import configs

    text = '<manifest package="p"><uses-permission android:name="x"/><permission android:name="own"/><application/></manifest>'
    files = spark.createDataFrame([("a", "m", text), ("b", "m", "<manifest"), ("c", "m", None)], "app_id string, path string, text string")
    parsed = configs.parsed_manifests(files)
    for rows in (*configs.manifest_permissions(parsed), configs.manifest_components(parsed)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1
    assert [tuple(r) for r in configs.manifest_permissions(parsed)[0].collect()] == [("a", "x")]
    assert sorted(r.app_id for r in configs.malformed(parsed).collect()) == ["b", "c"]


def test_reachability_broadcasts_no_round(spark, monkeypatch):
    from sightline.operators import graph

    plans, cut = [], graph.cut_lineage

    def recorded(df):
        written = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())  # the plan as it ran
        return written

    monkeypatch.setattr(graph, "cut_lineage", recorded)
    edges = spark.createDataFrame([(k, k // 2) for k in range(1, 40)], "src long, dst long")
    out = graph.reachable(edges, edges.selectExpr("src AS module"))
    assert out.where("root = 39").count() == 7
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
