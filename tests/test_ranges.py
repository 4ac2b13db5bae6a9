"""Counting joins against the pairs they replace."""

import random

from pyspark.sql import functions as F

from sightline.operators import advisories, compare
from sightline.operators.ranges import counts_below, nearby_counts, path_suffixes

PATHS = ["a/b/c.kt", "b/c.kt", "c.kt", "/a/b/c.kt", "a/bc.kt", "", "x/", None]


def agrees(a, b):
    one = lambda x, y: x == y or x.endswith("/" + y)
    return a is not None and b is not None and (one(a, b) or one(b, a))


def test_path_suffixes(spark):
    row = spark.range(1).select(path_suffixes(F.lit("/a/b.kt")).alias("s"), path_suffixes(F.lit("")).alias("e")).first()
    assert row.s == ["/a/b.kt", "a/b.kt", "b.kt"] and row.e == [""]


def test_counts_below(spark):
    points = spark.createDataFrame([("k", 1, 2), ("k", 3, 1), ("k", 3, 4), (None, 2, 5), ("k", None, 9)], "k string, v int, n int")
    bounds = spark.createDataFrame([("k", 3, False), ("k", 3, True), ("k", 0, True), (None, 2, True), ("z", 1, True), ("k", None, True)], "k string, v int, inclusive boolean")
    got = {(r.k, r.v, r.inclusive): r.n for r in counts_below(points, bounds, ["k"], "v", ["n"]).collect()}
    # a null key is a key, an unknown key has nothing below
    assert got == {("k", 3, False): 2, ("k", 3, True): 7, ("k", 0, True): 0, (None, 2, True): 5, ("z", 1, True): 0}


def test_nearby_counts_equal_pairs(spark):
    draw = random.Random(4)
    line = lambda: draw.choice([None, *range(1, 12)])
    points = [(draw.choice("rs"), draw.choice(PATHS), line(), draw.choice("uv")) for _ in range(300)]
    queries = [(q, draw.choice("rst"), draw.choice(PATHS), line()) for q in range(200)]
    got = nearby_counts(
        spark.createDataFrame(queries, "query int, k string, path string, line int"), spark.createDataFrame(points, "k string, path string, line int, tag string"),
        ["k"], ["u", "v"], 2,
    ).collect()
    assert len(got) == len(queries)
    by_query = {r.query: r for r in got}
    for q, k, path, at in queries:
        for n, tag in enumerate("uv"):
            own = [p for p in points if p[0] == k and p[3] == tag and (path is None or agrees(p[1], path))]
            row = by_query[q]
            assert row.bare[n] == sum(p[2] is None for p in own) and row.lined[n] == sum(p[2] is not None for p in own)
            if path is not None and at is not None:
                assert row.near[n] == sum(p[2] is not None and abs(p[2] - at) <= 2 for p in own)
    assert nearby_counts(spark.createDataFrame([], "query int, k string, path string, line int"), spark.createDataFrame(points, "k string, path string, line int, tag string"), ["k"], ["u"], 2).count() == 0


def test_corroboration_counts_equal_pairs(spark):
    draw = random.Random(8)
    make = lambda n: [("r", f"f{i}", draw.choice("wx"), draw.choice(PATHS), draw.choice([None, 1, 5, 7, 30])) for i in range(n)]
    schema = "report_id string, id string, weakness_id string, path string, line int"
    external, native = (spark.createDataFrame(make(60), schema) for _ in range(2))
    pairs = compare.corroboration(external, native).collect()
    got = compare.corroboration_counts(external, native).collect()
    assert pairs
    for side, column in (("external", "external_id"), ("native", "native_id")):
        want = {}
        for p in pairs:
            want[p[column]] = want.get(p[column], 0) + 1
        assert {r.id: r.partners for r in got if r.side == side and r.partners} == want


def test_patch_state_counts_equal_pairs(spark):
    draw = random.Random(2)
    day = lambda: draw.choice([None, "unknown", "2023-01-05", "2024-02-05", "2024-06-01"])
    devices = spark.createDataFrame(
        [(draw.choice(["android", "android", "ios"]), day(), day(), draw.choice(["12", "13.1", "", "14"]), draw.choice(["QTI", "", "mtk"]), draw.random() < 0.1) for _ in range(400)],
        "platform string, security_patch string, vendor_security_patch string, version string, soc_manufacturer string, simulator boolean",
    )
    rows = [(f"A{i}", draw.choice(["android", "android", "ios", "other"]), draw.choice(["Kernel", "Framework", "Qualcomm"]), draw.choice([None, "", "platform"]),
             draw.choice([None, "", "2024-02-05", "bad", "2024-07-01"]), draw.choice([None, "12, 13", "12 12", "14"])) for i in range(60)]
    rows += rows[:5]
    table = spark.createDataFrame(rows, "id string, platform string, component string, vendor_scope string, fixed_patch_level string, updated_versions string")
    classes = advisories.posture_classes(devices)
    want = advisories.patch_states(classes, table).groupBy("id", "state").agg(F.sum("devices").alias("devices"))
    got = advisories.patch_state_counts(classes, table)
    assert sorted(map(tuple, got.select("id", "state", "devices").collect())) == sorted(map(tuple, want.collect()))


def test_claims_equal_pairs(spark):
    draw = random.Random(6)
    line = lambda: draw.choice([None, *range(1, 12)])
    status = ["candidate", "version-affected", "runtime-confirmed", "odd"]
    found = [("r", draw.choice(["R1", "R2"]), draw.choice(PATHS), line(), draw.choice(status), draw.choice(["builtin", "external"])) for _ in range(150)]
    claims = [(f"c{i}", "r", draw.choice(PATHS), line(), *draw.choice([("R1", None), (None, "W1"), (None, "W9"), ("R3", None)])) for i in range(120)]
    bridge = [("R1", "W1"), ("R2", "W1")]
    got = compare.verify_claims(
        spark.createDataFrame(claims, "claim_id string, report_id string, path string, line int, rule_id string, weakness_id string"),
        spark.createDataFrame(found, "report_id string, rule_id string, path string, line int, status string, origin string"),
        spark.createDataFrame([("r", "R1", "checked")], "report_id string, rule_id string, state string"),
        spark.createDataFrame(bridge, "rule_id string, weakness_id string"), spark.createDataFrame([("r", False)], "report_id string, incomplete boolean"),
        spark.createDataFrame([("r", "c.kt", "checked")], "report_id string, path string, state string"),
    )
    rows = {r.claim_id: r for r in got.collect()}
    order = ["candidate", "version-affected", "configuration-confirmed", "runtime-confirmed"]
    for claim, _, path, at, rule, weakness in claims:
        rules = [rule] if rule else [r for r, w in bridge if w == weakness]
        own = [f for f in found if f[1] in rules and f[5] != "external" and (path is None or agrees(f[2], path))]
        free = path is None or at is None
        near = [f for f in own if free or f[3] is not None and abs(f[3] - at) <= 3]
        far = [f for f in own if not free and f[3] is not None and abs(f[3] - at) > 3]
        best = max((order.index(f[4]) if f[4] in order else -1 for f in near), default=-1)
        assert (rows[claim].matches, rows[claim].elsewhere) == (len(near), len(far))
        assert rows[claim].strongest_status == (order[best] if best >= 0 else "")
