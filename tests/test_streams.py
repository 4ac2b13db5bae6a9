"""Streaming queries at size: thirds that arrive in parallel, states folded without Python, one inventory for all batches."""

import datetime as dt
import os

from pyspark import StorageLevel
from pyspark.sql import functions as F

from sightline.operators import compare
from sightline.plans.stream_queries import Playground, _latest_states
from sightline.plans.tables import Tables
from sightline.streaming import jobs

SECONDS = dt.datetime(2024, 1, 1)


def at(seconds):
    return SECONDS + dt.timedelta(seconds=seconds)


def test_a_third_arrives_in_many_files_as_one_batch(spark):
    p = Playground(Tables(spark, "none"))
    rows = spark.range(0, 3000, 1, 6).withColumn("part", F.col("id") % 3)
    seen = []
    p.play(p.arrivals(rows, F.col("part")), lambda batch, n: seen.append((n, batch.select("part").distinct().collect(), batch.count())))
    assert [(n, [r.part for r in parts], count) for n, parts, count in seen] == [(0, [0], 1000), (1, [1], 1000), (2, [2], 1000)]
    folder = f"{p.root}/incoming".removeprefix("file:")
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) == 18  # no third passed through one task


def test_an_empty_third_is_a_batch(spark):
    p = Playground(Tables(spark, "none"))
    seen = []
    p.play(p.arrivals(spark.range(4).withColumn("part", F.lit(2)), F.col("part")), lambda batch, n: seen.append((n, batch.count())))
    assert seen == [(0, 0), (1, 0), (2, 4)]


def test_states_are_folded_without_python(spark):
    p = Playground(Tables(spark, "none"))
    rows = [
        ("a", "r", at(10), False, None, 0), ("a", "r", at(5), True, None, 0), ("a", "r", at(20), False, 9000, 1),  # three outcomes, two of one batch
        ("b", "r", at(50), False, None, 0), ("b", "r", at(1), True, None, 1),  # a late success still ends the job
        ("c", "r", at(1), True, None, 0), ("c", "r", at(9), None, 5, 2), ("d", "r", at(3), True, None, 2), ("e", "r", at(3), False, 999_999, 2), (None, "r", at(4), False, None, 0),
    ] + [("f", "r", at(100 + k), False, None, k % 3) for k in range(30)]
    table = spark.createDataFrame(rows, "id string, revision string, at timestamp, ok boolean, retry_after int, part int")
    stream = jobs.job_states(p.arrivals(table, F.col("part")), timers=False)
    assert "PandasWithState" not in stream._jdf.queryExecution().logical().toString()
    states = p.table("states", jobs.JOB_OUTPUT)
    p.play(stream, _latest_states(states), "update")
    got = {r.id: (r.state, r.attempts, r.next_attempt) for r in states.current(["id", "revision"]).collect()}
    assert got == {
        "a": ("pending", 3, at(20 + 9000)), "b": ("done", 2, None), "c": ("pending", 2, at(9 + 120)), "d": ("done", 1, None), "e": ("pending", 1, at(3 + 86_400)),
        None: ("pending", 1, at(4 + 60)), "f": ("pending", 30, at(129 + 86_400)),
    }


def test_an_inventory_kept_by_its_owner_serves_all_batches(spark):
    p = Playground(Tables(spark, "none"))
    saved = p.table("saved", jobs.ASSESSMENT_SCHEMA)
    kept = spark.createDataFrame([("t", "x", 1), ("t", "y", 2), ("u", "z", 3)], "target string, id string, k int").persist()
    find = lambda rows: rows.where("k < 3").withColumn("severity", F.lit("low")).withColumn("status", F.lit("candidate"))
    handle = jobs.reassess(saved, find, lambda _: kept)
    handle(spark.range(1), 0)
    assert kept.storageLevel != StorageLevel.NONE
    handle(spark.range(1), 1)
    assert sorted((r.target, r.findings, r.batch) for r in saved.read().collect()) == [("t", 2, 0), ("u", 0, 0)]
    kept.unpersist()


def test_corroborating_findings_are_built_once(spark):
    schema = "report_id string, id string, weakness_id string, path string, line int"
    left = spark.createDataFrame([("r", "x1", "w", "a/m/f.kt", 5), ("r", "x2", "w", "f.kt", None), ("r", "x3", "w", "b/g.kt", 5), ("r", "x4", "w", None, 1)], schema)
    right = spark.createDataFrame([("r", "n1", "w", "m/f.kt", 6), ("r", "n2", "w", "z/a/m/f.kt", 90), ("r", "n3", "w", "f.kt", None), ("r", "n4", "v", "a/m/f.kt", 5), ("r", "n5", "w", "xf.kt", 5)], schema)
    marked = left.withColumn("path", F.when(F.lit("built-again") != F.col("id"), F.col("path")))
    counts = compare.corroboration_counts(marked, right, 3)
    assert "built-again" not in counts._jdf.queryExecution().optimizedPlan().toString()
    pairs = compare.corroboration(left, right, 3).collect()
    want = {("external", f"x{k}"): sum(r.external_id == f"x{k}" for r in pairs) for k in (1, 2, 3)} | {("native", f"n{k}"): sum(r.native_id == f"n{k}" for r in pairs) for k in range(1, 6)}
    assert {(r.side, r.id): r.partners for r in counts.collect()} == want
