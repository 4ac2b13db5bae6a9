"""Column functions against golden values."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sightline.functions import canonical, cvss, packages, ranks, versions
from sightline.functions import text as txt
from sightline.functions.calls import argument_spans, declared_types
from sightline.operators.filters import glob_to_regex


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def reference_identity(rule, locations, scope="app"):
    body = json.dumps([rule, scope, locations], sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return "F-" + hashlib.sha256(body.encode()).hexdigest()[:20]


def test_identity_hashes_only_present_location_fields(spark):
    row = F.struct(F.lit('a "q"\n\t/é.kt').alias("path"), F.lit(7).alias("line"), F.lit(None).cast("string").alias("sink"), F.lit("x").alias("excerpt"))
    got = one(spark, canonical.finding_identity(F.lit("R"), F.array(row), ("path", "line", "sink")))
    assert got == reference_identity("R", [{"path": 'a "q"\n\t/é.kt', "line": 7}])


def test_dependency_identity_fills_absent_parts(spark):
    got = one(spark, canonical.dependency_identity(F.lit("CVE-1"), F.lit("npm"), F.lit("p"), F.lit(None).cast("string")))
    assert got == reference_identity("CVE-1", [{"dependency": {"name": "p", "ecosystem": "npm", "path": ""}}])


ORDERED = ["1.dev1", "1.0a1.dev2", "1.0a1", "1.0a1.post1", "1b2", "1rc1", "1.0", "1.0+abc", "1.0+abc.5", "1.0+abc.12", "1.0.post0.dev3", "1.0.post1", "1.0.1", "1.9", "1.10", "1!0.1"]


def test_version_keys_follow_pep_440(spark):
    rows = spark.createDataFrame([(v,) for v in reversed(ORDERED)], "v string").withColumn("k", versions.version_key(F.col("v"))).orderBy("k").collect()
    assert [r["v"] for r in rows] == ORDERED
    same = spark.createDataFrame([("1.0",), ("1",), ("v1.0.0",), ("1-1",), ("1.post1",), ("x1",)], "v string").select(versions.version_key(F.col("v")).alias("k")).collect()
    keys = [r["k"] for r in same]
    assert keys[0] == keys[1] == keys[2] and keys[3] == keys[4] and keys[5] is None


@pytest.mark.parametrize(
    ("vector", "score"),
    [
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0),
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1), ("CVSS:3.0/AV:L/AC:H/PR:H/UI:N/S:U/C:L/I:N/A:N", 1.9),
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0), ("CVSS:3.1/AV:N", None),
    ],
)
def test_cvss_v3_scores(spark, vector, score):
    assert one(spark, cvss.v3_base(F.lit(vector))) == score


def test_cvss_v2_score_and_declared_rating(spark):
    assert one(spark, cvss.v2_base(F.lit("AV:N/AC:L/Au:N/C:P/I:P/A:P"))) == 7.5
    metrics = F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N").alias("score")))
    got = one(spark, cvss.advisory_severity(metrics, F.lit("CRITICAL")))
    assert (got["severity"], got["severity_basis"]) == ("critical", "database_specific.severity")
    none = one(spark, cvss.advisory_severity(F.lit(None).cast("array<struct<type:string,score:string>>"), F.lit(None).cast("string")))
    assert (none["severity"], none["severity_basis"]) == (None, "unknown")


def test_comment_blanking_keeps_offsets_and_literals():
    for source, expected in (
        ('a("//x") // y\nb', 'a("//x")     \nb'), ("a /* b\nc */ d", "a     \n     d"), ("x = 'it\\'s // no' // z", "x = 'it\\'s // no'     "),
        ("/* open", "/* open"), ('"""// raw""" // c', '"""// raw"""     '),
    ):
        assert txt.blank_comments(source) == expected
    assert txt.blank_comments("`${a /* c */}` // d", True) == "`${a        }`     "
    assert txt.blank_xml_comments("<a><!-- b\n--></a>") == "<a>      \n   </a>"


def test_argument_spans_and_types():
    text = 'log("a,(b", f(x, y), z) tail'
    spans, end, closed = argument_spans(text, 3)
    assert [text[a:b].strip() for a, b in spans] == ['"a,(b"', "f(x, y)", "z"] and closed and text[end:] == " tail"
    assert argument_spans("log(a", 3)[2] is False
    assert argument_spans("f()", 1)[0] == []
    assert declared_types("val p = BiometricPrompt(this)\nlateinit var q: Cipher")["p"] == "BiometricPrompt"


def test_globs():
    import re

    assert re.match(glob_to_regex("com.x:*[!0-9]"), "com.x:abc") and not re.match(glob_to_regex("com.x:*[!0-9]"), "com.x:ab1")
    assert re.match(glob_to_regex("a?c"), "abc") and not re.match(glob_to_regex("a.c"), "abc")


def test_bounded_ids_keep_the_display_id(spark):
    ids = F.array(*[F.lit(v) for v in ("B", "A", "bad id", "", "C", "A")])
    assert one(spark, packages.bounded_advisory_ids(F.lit("Z"), ids, 3)) == ["A", "B", "Z"]


def test_null_rank_has_no_name(spark):
    assert one(spark, ranks.name_of(F.lit(None).cast("int"), ranks.SEVERITIES)) is None


def test_markdown_is_inert(spark):
    assert one(spark, txt.markdown_text(F.lit("# <b>*x*</b>\n1. y"))) == "\\# &lt;b&gt;\\*x\\*&lt;/b&gt; 1. y"
    assert one(spark, txt.markdown_code(F.lit("a`b"))) == "``a`b``"


def test_long_version_numbers_stay_apart(spark):
    from sightline.functions import versions

    key = lambda v: one(spark, versions.version_key(F.lit(v)))
    assert key("1.1234567890123456779") < key("1.1234567890123456780") < key("1.12345678901234567800")
    assert key("1.2") == key("1.2.0") and key("2") > key("1.99") and key("1.0rc1") < key("1.0") < key("1.0.post1")


def test_severity_metrics_in_any_order(spark):
    from sightline.functions import cvss

    ordered = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
    mixed = "CVSS:3.1/AC:L/AV:N/A:H/PR:N/UI:N/I:H/S:U/C:H/E:P"
    assert one(spark, cvss.v3_base(F.lit(ordered))) == one(spark, cvss.v3_base(F.lit(mixed))) == 9.8
    assert one(spark, cvss.v3_base(F.lit(ordered + "/AV:L"))) is None
    assert one(spark, cvss.v3_base(F.lit(ordered.replace("/A:H", "")))) is None
    assert one(spark, cvss.v2_base(F.lit("AC:L/AV:N/Au:N/C:P/I:P/A:P"))) == 7.5


def test_unclosed_comments_and_regular_expressions_stay(spark):
    from sightline.functions.text import blank_comments

    assert blank_comments("a = x /* b\nhandler.proceed()") == "a = x /* b\nhandler.proceed()"
    assert blank_comments("a /* b */ c /* d") == "a         c /* d"
    assert blank_comments("x = /a\\/*b/; y() // z", True) == "x = /a\\/*b/; y()     "
    assert blank_comments("q = a / b; // c / d", True) == "q = a / b;         "


def test_network_configurations_nest_at_any_depth(spark):
    from sightline.sources import configs

    deep = "".join(f"<domain-config{' cleartextTrafficPermitted=\"true\"' if k == 4 else ''}><domain>d{k}</domain>" for k in range(6)) + "</domain-config>" * 6
    rows = spark.createDataFrame([("a", "p", f"<network-security-config>{deep}</network-security-config>"), ("a", "bad", "<x"), ("a", "none", None)], "app_id string, path string, text string")
    got = {tuple(r.domains): r.cleartext_permitted for r in configs.network_configs(rows).collect()}
    assert got == {(f"d{k}",): k >= 4 for k in range(6)}
