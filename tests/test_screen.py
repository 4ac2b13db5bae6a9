"""Rule scans put a pattern only to texts that hold the literals its matches need, and lose no match by that."""

from sightline.functions.literals import required_literals
from sightline.operators import detect


def found(spark, texts, *rules):
    rows = [("a", f"f{k}", ".kt", x) for k, x in enumerate(texts)]
    sources = spark.createDataFrame(rows, "app_id string, path string, suffix string, text string")
    return sorted((r.path, r.rule_id, r.line, r.matches) for r in detect.scan(sources, rules).collect())


def test_patterns_are_not_put_to_texts_without_their_literals(spark):
    # on a long run of a and b this pattern exhausts the stack, so putting it to the first text fails the scan
    rule = detect.Rule("R", r"(?:a|b)*needle")
    needed = detect.Rule("S", r"(?:a|b)*c", requires="unusual")
    assert found(spark, ["ab" * 200_000, "x\nabNEEDLE needle"], rule, needed) == [("f1", "R", 2, 2)]


def test_the_screen_loses_no_match(spark):
    texts = ["TOKEN=1", "toKen", "İtoken İ", "", None, "a!b", "kelvin", "Requires Token", "requires token"]
    rules = [
        detect.Rule("any-case", "token"), detect.Rule("unicode", "(?iu)token"), detect.Rule("own-case", "Token", case_sensitive=True),
        detect.Rule("octal", r"a\041b"), detect.Rule("either", "kelvin|a.b"), detect.Rule("with", "token", requires="Requires"), detect.Rule("class", "[k]e"),
    ]
    assert found(spark, texts, *rules) == sorted(
        [(f"f{k}", "any-case", 1, 1) for k in (0, 2, 7, 8)] + [(f"f{k}", "unicode", 1, 1) for k in (0, 1, 2, 7, 8)]
        + [("f7", "own-case", 1, 1), ("f5", "octal", 1, 1), ("f5", "either", 1, 1), ("f6", "either", 1, 1), ("f7", "with", 1, 1)]
        + [(f"f{k}", "class", 1, 1) for k in (0, 2, 6, 7, 8)]
    )
    assert required_literals("(?iu)token") == [] and required_literals(r"a\041bcd") == []
