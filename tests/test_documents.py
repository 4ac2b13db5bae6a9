"""Written documents: each line is read and parsed once, each component list is built once."""

import json

from sightline.sinks import documents

COMPONENT = "app_id string, ecosystem string, name string, version string, confidence string, path string, ref string, purl string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def written(spark, tmp_path, lines):
    (tmp_path / "d" / "document=a").mkdir(parents=True)
    (tmp_path / "d" / "document=a" / "part-0.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return documents.read_documents(spark, str(tmp_path / "d"))


def test_bill_lines_are_read_once(spark, tmp_path):
    properties = [{"name": "ecosystem", "value": "npm"}, {"name": "confidence", "value": "exact"}]
    component = {"type": "library", "bom-ref": "r|1", "name": 'n"é', "version": "1", "properties": properties}
    flaw = {"bom-ref": "vuln-V", "id": "V", "ratings": [{"severity": "high"}], "affects": [{"ref": "a"}, {"ref": "b"}]}
    lines = [
        '{"bomFormat":"CycloneDX"', json.dumps(component, separators=(",", ":"), ensure_ascii=False), ',{"type":"library","name":"bare"}', ',{"type":broken', '],"dependencies":[',
        '"pkg:npm/é@1"', ',"a\\"b\\\\c\\u00e9"', ',""', '"open', '"two" words"', "", ",", "," + json.dumps(flaw, separators=(",", ":")), ',{"bom-ref":"vuln-W","id":"W"}', "]}",
    ]
    parsed = documents.parse_bom(written(spark, tmp_path, lines))
    assert plan(parsed).count("Relation") == 1
    got = [(r.document, r.kind, r.key) for r in parsed.collect()]
    want = [("component", 'r|1|n"é|1|exact'), ("component", "|bare||"), ("component", "|||")]
    want += [("dependency", k) for k in ("pkg:npm/é@1", 'a"b\\cé', "", None, None)] + [("vulnerability", "V|high|2"), ("vulnerability", "W||")]
    assert sorted(map(repr, got)) == sorted(repr(("a", *w)) for w in want)


def test_report_lines_are_read_once(spark, tmp_path):
    place = [{"physicalLocation": {"artifactLocation": {"uri": "p"}, "region": {"startLine": 3}}}]
    result = {"ruleId": "R", "level": "error", "message": {"text": "t"}, "locations": place, "properties": {"status": "s", "severity": "high", "findingId": "F"}}
    lines = ['{"version":"2.1.0"', '{"id":"R","defaultConfiguration":{"level":"error"}}', json.dumps(result, separators=(",", ":")), ',{"level":"note","message":{"text":"m"},"associatedRule":{"id":"R"}}', '"text"']
    parsed = documents.parse_sarif(written(spark, tmp_path, lines))
    assert plan(parsed).count("Relation") == 1
    assert sorted((r.kind, r.key) for r in parsed.collect()) == [("notification", "R|m"), ("result", "R|error|t|p|3|s|high|F"), ("rule", "R|error")]


def test_components_are_listed_twice_from_one_pass(spark, tmp_path):
    rows = [(a, "npm", n, "1", "exact", "p", f"r{n}", f"r{n}") for a, n in (("a", "x"), ("a", "y"), ("b", "y"), (None, "z"))] + [("b", "npm", "y", "1", "exact", "q", "again", "")]
    spark.createDataFrame(rows, COMPONENT).write.parquet(str(tmp_path / "c"))
    components = spark.read.parquet(str(tmp_path / "c"))
    none = spark.createDataFrame([], "app_id string, vulnerability string, severity string, ref string")
    found = spark.createDataFrame([], "app_id string, rule_id string, severity string, known_exploited boolean")
    out = documents.bom_lines(components, none, found)
    assert plan(out).count("Relation") <= 6  # the applications' four frames, their first components, and the lists
    lists = [(r.document, r.section, r.position, r.line[0], r.line.lstrip(",")) for r in out.where("section in (1, 3)").collect()]
    assert sorted((d, p, c, x) for d, s, p, c, x in lists if s == 3) == [
        ("a", "npm|x|1", '"', '"rx"'), ("a", "npm|y|1", ",", '"ry"'), ("b", "npm|y|1", '"', '"again"'), ("b", "npm|y|1", '"', '"ry"'),
    ]
    refs = [(d, p, c, json.loads(x)["bom-ref"], json.loads(x).get("purl")) for d, s, p, c, x in lists if s == 1]
    assert sorted(refs, key=repr) == sorted([("a", "npm|x|1", "{", "rx", "rx"), ("a", "npm|y|1", ",", "ry", "ry"), ("b", "npm|y|1", "{", "again", None), ("b", "npm|y|1", "{", "ry", "ry")], key=repr)
