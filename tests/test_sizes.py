"""Joins that must not pass whole sides through the driver, meet in pairs, or hold a batch's nodes at once."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from sightline.operators import identity, metrics, policy
from sightline.sources import build_files, pages

SIDE = "report_id string, id string, severity string, status string, known_exploited boolean, own array<string>, every array<string>"


def side(spark, path, names):
    rows = [("r", f"{n}{k}", "high", "candidate", False, [f"{n}{k}"], [f"{n}{k}", f"A{k}"]) for n in names for k in range(20)]
    spark.createDataFrame(rows, SIDE).write.parquet(str(path))  # a small file: its size says nothing of the exploded rows
    return spark.read.parquet(str(path))


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_identities_are_matched_without_broadcasts(spark, tmp_path):
    now, old = side(spark, tmp_path / "now", "FG"), side(spark, tmp_path / "old", "AP")
    pairs = identity.match_identities(now, old, ["report_id"])
    assert broadcasts(pairs) == 0
    state = policy.baseline_state(now, old)
    assert broadcasts(state) == 0 and state.count() == 40
    waivers = now.select(F.col("id").alias("finding_id"), F.lit(dt.date(2024, 1, 1)).alias("expires"), "severity", "known_exploited").where("id like 'F%'")
    waived = policy.waiver_state(now, waivers, dt.date(2024, 1, 1))
    assert broadcasts(waived) == 0 and waived.where("waived").count() == 20


def test_configuration_labels_meet_by_whole_path(spark):
    labels = [(1, "a", "m/X.xml", "R", True), (2, "a", "X.xml", "R", True), (3, "a", "other/X.xml", "R", False), (4, "b", "m/X.xml", "R", True), (5, "a", None, "R", True), (6, "a", "", "R", True)]
    frame = spark.createDataFrame(labels, "label_id int, app_id string, path string, rule_id string, expected boolean")
    configs = spark.createDataFrame([("a", "root/m/X.xml"), ("a", "xm/X.xml"), ("a", None), ("a", "dir/")], "app_id string, path string")
    found = spark.createDataFrame([("a", "R", "m/X.xml"), ("a", "S", "other/X.xml")], "app_id string, rule_id string, path string")
    got = {r.label_id: (r.covered, r.matched) for r in metrics.configuration_labels(frame, configs, found).collect()}
    assert got == {1: (True, True), 2: (True, True), 3: (False, False), 4: (False, False), 5: (False, False), 6: (True, False)}
    plan = metrics.configuration_labels(frame, configs, found)._jdf.queryExecution().optimizedPlan().toString()
    assert "EndsWith" not in plan  # no files of one name meet in pairs


def test_nodes_of_a_batch_leave_in_parts():
    html = "<p>" + "<a href='/x'>y</a>" * 3000
    batch = pd.DataFrame({"page_id": [str(k) for k in range(30)], "url": "u", "html": html})
    parts = list(pages._node_batches(iter([batch])))
    assert sum(map(len, parts)) == 30 * 3001 and max(map(len, parts)) < pages.NODES_A_BATCH + 3001


def test_catalogues_are_parsed_once(spark):
    body = '[versions]\nv = "2.0"\n[libraries]\na = { module = "g:a", version.ref = "v" }\nb = "g:b:1.0"\nc = { module = "g:c", version.ref = "none" }\n[bundles]\nx = ["a", "b"]\ny = ["a"]\n'
    other = '[versions]\nv = "3.0"\n'
    files = spark.createDataFrame([("p", "one", body), ("p", "two", body), ("p", "two", other), ("p", None, body), ("p", "bad", "[")], "app_id string, path string, text string")
    rows = build_files.catalog_rows(files)
    got = sorted((r.path or "", r.name, r.version, tuple(r.x_bundles), r.x_alias) for r in rows.collect())
    one = [("g:a", "2.0", ("x", "y"), "a"), ("g:b", "1.0", ("x",), "b")]
    assert got == sorted([("one", *r) for r in one] + [("two", *r) for r in one] + [("two", "g:a", "3.0", ("x", "y"), "a"), ("", "g:b", "1.0", (), "b")])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
