"""Scans: excluded matches, packaged sources, and rule tables of any size against literal scans."""

import re

from sightline.functions.literals import required_literals
from sightline.operators import detect
from sightline.operators.detect import Rule
from sightline.operators.rule_index import scan_table

SOURCES = "app_id string, path string, suffix string, text string, input_kind string, platforms array<string>"


def sources(spark, rows):
    return spark.createDataFrame([(a, p, p[p.rindex(".") :], t, k, ["android", "ios"]) for a, p, t, k in rows], SOURCES)


def found(df):
    return sorted((r.app_id, r.path, r.rule_id, r.line, r.matches, r.id) for r in df.collect())


def test_required_literals():
    cases = {
        "proceed": ["proceed"], "a|bcd": [], "(abc|Defg)+x": ["abc", "defg"], "ab?cdef": ["cdef"], "[abc]def": ["def"], "(?:foo){0,2}bar": ["bar"],
        r"\.readObject\s*\(": [".readobject"], "(?=foo)b": [], r"\Qabc\E": [], "": [], r"x\d{3}yzw?": [], "colou?rs": ["colo"], r"\x41bcd": [],
    }
    for pattern, want in cases.items():
        assert required_literals(pattern) == want, pattern
    for rule in detect.catalogue():
        assert required_literals(rule.pattern), rule.rule_id


def test_excluded_matches(spark):
    text = "é tag tag\ntag é tag\n// tag"
    table = sources(spark, [("a", "x.txt", text, None), ("a", "y.txt", text, None), ("b", "x.txt", text, None)])
    places = [len(text[: m.start()].encode()) for m in re.finditer("tag", text)]
    rows = [("a", "x.txt", "T", places[0], places[0] + 3), ("a", "x.txt", "T", places[2], places[2] + 2), ("a", "x.txt", "T", places[3], places[3] + 9)]
    rows += [("a", "x.txt", "OTHER", places[1], places[1] + 3), ("a", "x.txt", "T", 1, 4), ("a", "x.txt", "T", 900, 903), ("a", "x.txt", "T", places[3], 1)]
    spans = spark.createDataFrame(rows, "app_id string, path string, rule_id string, start long, end long")
    rules = [Rule("T", "tag"), Rule("ONCE", "tag", once_per_file=True)]
    got = {(r.app_id, r.path, r.rule_id, r.line): r.matches for r in detect.scan(table, rules, exclusions=spans).collect()}
    whole = {1: 2, 2: 2, 3: 1}
    for app, path in (("a", "y.txt"), ("b", "x.txt")):
        assert {line: n for (a, p, r, line), n in got.items() if (a, p, r) == (app, path, "T")} == whole
    # the second span ends too early, the one inside a character excludes nothing, of two at one start the longer counts
    assert {line: n for (a, p, r, line), n in got.items() if (a, p, r) == ("a", "x.txt", "T")} == {1: 1, 2: 1, 3: 1}
    first = spark.createDataFrame([("a", "x.txt", "ONCE", places[0], places[0] + 3)], spans.schema)
    once = detect.scan(table, rules[1:], exclusions=first).collect()
    assert sorted((r.app_id, r.path) for r in once) == [("a", "y.txt"), ("b", "x.txt")]
    assert found(detect.scan(table, rules, exclusions=spans.limit(0))) == found(detect.scan(table, rules))
    capped = detect.scan(table, rules[:1], match_cap=2, exclusions=spans).where("path = 'x.txt' AND app_id = 'a'").collect()
    assert [(r.line, r.matches, r.file_matches, r.truncated) for r in capped] == [(1, 1, 5, True)]


def test_packaged_sources_and_bundles(spark):
    rows = [
        ("a", "p/main.bundle", "tag", "apk"), ("a", "p/x.bundle", "tag __d(1)", "apk"), ("a", "p/y.bundle", "tag '__d(' // __r(1)", "ipa"),
        ("a", "p/z.bundle", "tag x.__d(1)", None), ("a", "p/index.ios.bundle", "tag \x02", None), ("a", "p/n.kt", "tag", "apk"), ("a", "p/t.kt", "tag", None),
        ("b", "p/q.swift", "kSecAttrAccessibleAlways", "ipa"),
    ]
    table = sources(spark, rows)
    rules = [Rule("T", "tag", suffixes=(".bundle", ".kt"))]
    assert [r.path for r in detect.scan(table, rules).orderBy("path").collect()] == ["p/main.bundle", "p/t.kt", "p/x.bundle"]
    states = {(r.app_id, r.rule_id): (r.state, r.files) for r in detect.scan_coverage(table, rules).collect()}
    assert states == {("a", "T"): ("checked", 3), ("b", "T"): ("not-run", 0)}


def test_rule_table_equals_literal_scan(spark):
    lines = [
        "fun onReceivedSslError() { handler.proceed() }", "view.addJavascriptInterface(api, name)", "// prefs.putString(KEY_TOKEN, value)",
        "prefs.putString(KEY_TOKEN, value)\nprefs.PUTSTRING(KEY_TOKEN, v)", "openFileOutput(n, MODE_WORLD_READABLE);", "val u = UIWebView(); UIWebView()", "", "ab ab cd\nab",
    ]
    rows = [(f"app{k % 3}", f"src/f{k}.{s}", f"int x;\n{line}\n", None) for k, line in enumerate(lines) for s in ("kt", "java", "swift", "xml")]
    table = sources(spark, rows)
    odd = [Rule("OPEN", "[a-b]{2}"), Rule("MANY", "ab|cd|tokens?"), Rule("CASE", "KEY_TOKEN", case_sensitive=True), Rule("NONE", "never-seen-anywhere"), Rule("ONE", "ab|cde", once_per_file=True)]
    rules = [*detect.catalogue(), *odd]
    rules = [r for r in rules if r.rule_id != "STORAGE-SENSITIVE-LOG"]
    as_table = detect.rule_table(spark, rules)
    want = found(detect.scan(table, rules))
    assert want and found(scan_table(table, as_table)) == want
    assert found(scan_table(table, as_table.unionByName(as_table))) == want  # repeated rows count once
    assert scan_table(table, as_table.limit(0)).count() == 0 and scan_table(table.limit(0), as_table).count() == 0
    bare = as_table.where("rule_id IN ('OPEN', 'MANY')").select("rule_id", "pattern")
    assert {r.severity for r in scan_table(table, bare).collect()} == {"medium"}


def test_rules_within_a_line_read_only_their_lines(spark):
    from sightline.functions.literals import within_line
    from sightline.operators.rule_index import literal_rules

    plain = [r"(?<![a-z])word7(?![a-z])", "(?i)licen[sc]e", r"foo\(bar.{1,3}", r"\bthe\b", "(?:abc|def)+"]
    broad = ["a\nb", r"a\sbcd", "^abc", "abc$", "abc[^x]", "(?s)abc.", "(?m:abc)", "(?<n>abc)", r"abc\Z", "[\n-a]bcd", "abc\\R", None]
    assert all(map(within_line, plain)) and not any(map(within_line, broad))
    text = "\n".join(f"word{k % 40} word{k} WORD{k % 7}\r" for k in range(400)) + "\nhead of\ntail word1"
    table = sources(spark, [("a", "long.txt", text, None), ("a", "none.txt", "word", None), ("b", "x.txt", "word3word3 alpha\n", None)])
    rules = [Rule(f"W{k}", f"(?<![a-z])word{k}(?![0-9])", case_sensitive=k % 2 == 0, once_per_file=k % 5 == 0, requires="tail" if k % 3 == 0 else None) for k in range(40)]
    rules += [Rule("TWO", "word17|alpha|word3"), Rule("SPAN", r"head of\stail"), Rule("END", r"word39\r"), Rule("LATE", "alpha$")]
    as_table = detect.rule_table(spark, rules)
    own = {r.rule_id: r.in_line for r in literal_rules(as_table).collect()}
    assert own["W3"] == ["word3"] and own["SPAN"] is None and own["LATE"] is None and len(own["TWO"]) == 3
    for cap in (None, 3):
        want = sorted(map(repr, detect.scan(table, rules, cap).select("app_id", "path", "rule_id", "line", "matches", "file_matches", "truncated", "excerpt", "id").collect()))
        got = scan_table(table, as_table, cap)
        assert want == sorted(map(repr, got.select("app_id", "path", "rule_id", "line", "matches", "file_matches", "truncated", "excerpt", "id").collect()))


def test_generator_far_behind_its_assignment(spark):
    from sightline.operators import code_checks

    far = "val sessionToken = " + "a + " * 200 + "Random().nextInt(); val other = 1"
    rows = [("a", "x.kt", far, None), ("a", "y.kt", "val sessionToken = 1; val b = Random().nextInt()", None), ("a", "z.swift", "let apiToken = f(rand(), 1)\nlet x = Random()", None)]
    got = {r.path: (r.variable, r.generator) for r in code_checks.insecure_random(sources(spark, rows)).collect()}
    assert got == {"x.kt": ("sessionToken", "Random"), "z.swift": ("apiToken", "rand")}
