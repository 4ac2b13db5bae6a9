"""Written bills of materials: components go to their files in one shuffle, compressed, and read back as the same lines."""

import gzip
from pathlib import Path

from sightline.operators import deps
from sightline.sinks import documents

DEPS = "app_id string, ecosystem string, name string, version string, path string, confidence string"


def tables(spark):
    rows = [(f"app {k % 3}", "npm" if k % 2 else "Maven", f"g:n{k % 40}", f"{k % 7}.1", f"m{k % 5}/p", ("exact", "declared", "odd")[k % 3]) for k in range(400)]
    # names whose own order is not that of the joined position, and repeats, nulls and no application
    rows += [("app 0", "a", "b", "1", "p", "exact"), ("app 0", "ab", "b", "1", "p", "exact"), ("app 0", "a", "b!", "1", "p", "exact"), ("app 0", "a", "b", "1", "o", "declared")] * 3
    rows += [("lone", "npm", "x\"é", None, None, None), (None, "npm", "x", "1", "p", "exact"), ("lone", "npm", None, "2", "p", "exact")]
    found = [("app 0", "V1", "high", True), ("app 0", "V2", "low", False), ("lone", "V1", "high", True)]
    flaws = [("app 0", "V1", "high", "r1"), ("app 0", "V1", "high", "r2"), ("app 0", "V2", "low", "r1"), ("lone", "V1", "high", "r3")]
    return (
        spark.createDataFrame(rows, DEPS), spark.createDataFrame(flaws, "app_id string, vulnerability string, severity string, ref string"),
        spark.createDataFrame(found, "app_id string, rule_id string, severity string, known_exploited boolean"),
    )


def write(spark, path):
    rows, flaws, found = tables(spark)
    components = deps.bom_components(rows.distinct())
    parts = documents.bom_parts(components, flaws, found, ordered=deps.bom_components(rows, ordered=True))
    documents.write_bom(parts, path)
    return documents.bom_lines(components, flaws, found)


def test_files_joined_in_name_order_are_the_document(spark, tmp_path):
    want = write(spark, str(tmp_path / "d")).collect()
    for name, folder in (("app 0", "app 0"), ("app 1", "app 1"), ("lone", "lone"), (None, "__HIVE_DEFAULT_PARTITION__")):
        files = sorted(Path(tmp_path, "d", f"document={folder}").rglob("part-*.gz"))
        got = gzip.decompress(b"".join(f.read_bytes() for f in files)).decode().splitlines()
        own = sorted((r for r in want if r.document == name), key=lambda r: (r.section, r.position))
        assert got == [r.line for r in own] and got
    assert len(list(Path(tmp_path, "d", "document=app 1", "section=1").glob("part-*.gz"))) > 1
    assert not list(Path(tmp_path, "d").rglob("part-*.txt"))  # nothing uncompressed


def test_written_documents_read_back(spark, tmp_path):
    want = write(spark, str(tmp_path / "d"))
    back = documents.read_documents(spark, str(tmp_path / "d"))
    lines = lambda df: sorted(map(repr, df.select("document", "line").collect()))
    assert lines(back) == lines(want)
    assert sorted(map(repr, documents.parse_bom(back).collect())) == sorted(map(repr, documents.parse_bom(want).collect()))


def test_ordered_components_are_the_same_in_one_shuffle(spark, tmp_path):
    tables(spark)[0].write.parquet(str(tmp_path / "deps"))
    rows = spark.read.parquet(str(tmp_path / "deps"))
    ordered = deps.bom_components(rows, ordered=True)
    columns = ["app_id", "ecosystem", "name", "version", "confidence", "path", "evidence", "ref", "purl"]
    show = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert show(ordered) == show(deps.bom_components(rows))
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange rangepartitioning" in plan
