"""Skew-safe building blocks against brute force, with one key holding most rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from sightline import scale
from sightline.operators import budgets


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.randrange(50), rng.randrange(3)) for i in range(3000)]
    return data, spark.createDataFrame(data, "key string, n int, size int, h int").repartition(4).cache()


def grouped(data):
    out = {}
    for row in sorted(data, key=lambda r: (r[0], r[1])):
        out.setdefault(row[0], []).append(row)
    return out


def test_running_total(rows):
    data, df = rows
    got = {(r["key"], r["n"]): r["total"] for r in scale.running_total(df, ["key"], ["n"], {"total": F.col("size")}, parts=7).collect()}
    for key, group in grouped(data).items():
        total = 0
        for _, n, size, _ in group:
            total += size
            assert got[(key, n)] == total


def test_running_total_without_keys(rows):
    data, df = rows
    got = {r["n"]: r["position"] for r in scale.numbered(df, [], ["n"]).collect()}
    assert got == {n: i + 1 for i, n in enumerate(sorted(r[1] for r in data))}


def test_previous_value_crosses_slices(rows):
    data, df = rows
    got = {(r["key"], r["n"]): r["before"] for r in scale.with_previous(df, ["key"], ["n"], "h", "before", parts=9).collect()}
    for key, group in grouped(data).items():
        previous = None
        for _, n, _, h in group:
            assert got[(key, n)] == previous
            previous = h


def test_next_value_looks_past_nulls_and_slices(rows):
    data, df = rows
    marked = df.withColumn("mark", F.when(F.col("size") == 0, F.col("n")))
    got = {(r["key"], r["n"]): r["after"] for r in scale.with_next_value(marked, ["key"], ["n"], "mark", "after", parts=9).collect()}
    for key, group in grouped(data).items():
        upcoming = None
        for _, n, size, _ in reversed(group):
            assert got[(key, n)] == upcoming
            upcoming = n if size == 0 else upcoming


def test_exact_median(rows):
    data, df = rows
    got = {r["key"]: r["median"] for r in scale.exact_median(df, ["key"], "size").collect()}
    assert got == {k: statistics.median(r[2] for r in g) for k, g in grouped(data).items()}


@pytest.mark.parametrize("limit", [None, 25])
def test_admission_is_greedy_in_order(rows, limit):
    data, df = rows
    out = budgets.admit(df, ["key"], ["n"], "size", 700, limit)
    got = {(r["key"], r["n"]): r["admitted"] for r in out.collect()}
    assert len(got) == len(data)
    for key, group in grouped(data).items():
        used = taken = 0
        for _, n, size, _ in group:
            ok = used + size <= 700 and (limit is None or taken < limit)
            used, taken = used + size * ok, taken + ok
            assert got[(key, n)] is ok


def test_bounded_rows_refuses_large_tables(spark):
    with pytest.raises(ValueError):
        scale.bounded_rows(spark.range(11), "table", 10)


def test_salted_join_equals_join(rows, spark):
    _, df = rows
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3)], "key string, v int")
    plain = df.join(small, "key").count()
    assert scale.salted_join(df, small, ["key"], "n", 5).count() == plain


def test_top_k_is_pruned_before_the_shuffle(rows):
    _, df = rows
    plan = scale.top_k(df, ["key"], [F.col("n")], 3)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_null_order_values_are_admitted_first(spark):
    rows = spark.createDataFrame([("k", None, 6), ("k", "a", 3), ("k", "b", 2), ("k", "c", 4)], "key string, at string, size int")
    got = {r["at"]: r["admitted"] for r in budgets.admit(rows, ["key"], ["at"], "size", 8).collect()}
    assert got == {None: True, "a": False, "b": True, "c": False}
