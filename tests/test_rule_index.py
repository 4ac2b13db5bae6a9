"""The rule index: only stretches that announce a rule leave the texts, and each candidate has the lines that may hold it."""

import random

import numpy as np
from pyspark.sql import functions as F

from sightline.operators import detect, rule_index
from sightline.operators.detect import Rule

SOURCES = "app_id string, path string, suffix string, text string, platforms array<string>"


def brute(texts, keys):
    found = set()
    for k, text in enumerate(texts):
        raw = text.encode()
        for at in range(len(raw)):
            for width in rule_index.WIDTHS:
                key = int.from_bytes(raw[at : at + width], "little")
                if at + width <= len(raw) and key in keys.get(width, ()):
                    found.add((k, key, raw[:at].count(b"\n") + 1))
    return sorted(found)


def test_stretches_of_texts(spark):
    draw = random.Random(5)
    texts = ["", "abc", "ab", "é abc\n\nabcdefgh abcde\n", "xabcdefghé\x00abc"] + ["".join(draw.choices("abcde\né ", k=draw.randint(0, 80))) for _ in range(60)]
    words = ["abc", "ecb", "abcde", "aaaba", "abcdefgh", "bcdefghij", "never-there"]
    keys = {}
    for word in words:
        keys.setdefault(next(w for w in rule_index.WIDTHS if len(word) >= w), set()).update(rule_index.stretches(word))
    table = rule_index.bitmap(spark.createDataFrame([(k,) for own in keys.values() for k in own], "gram bigint").distinct())
    raw = [t.encode() for t in texts]
    held = rule_index._held(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]), list(rule_index.WIDTHS), table)
    every = set().union(*keys.values())
    assert [(int(t), int(k), int(n)) for t, k, n in zip(*held) if int(k) in every] == brute(texts, keys)
    assert len(held[0]) < 2 * len(brute(texts, keys)) + 20  # few others pass


def test_rules_meet_the_texts_that_hold_their_stretches(spark):
    draw = random.Random(7)
    words = ["".join(draw.choices("abcdef", k=k)) for k in (3, 4, 5, 6, 7, 8, 9, 12) for _ in range(6)]
    body = ["\n".join(" ".join(draw.choices(words + ["x" * 9, "Éa", "q"], k=6)) for _ in range(draw.randint(1, 9))) for _ in range(30)]
    rows = [(f"a{k % 3}", f"f{k}.txt", ".txt", text, ["android"]) for k, text in enumerate(body)]
    rows += [("a0", "twin.txt", ".txt", f"{words[-1]} one\n{words[0]}", ["android"]), ("a0", "twin.txt", ".txt", f"two\n\n{words[-1]}", ["android"]), ("a0", "none.txt", ".txt", None, ["android"])]
    table = spark.createDataFrame(rows, SOURCES)
    rules = [Rule(f"W{k}", rf"(?<![a-z]){w}(?![a-z])", case_sensitive=True) for k, w in enumerate(words)]
    rules += [Rule(f"I{k}", w, requires=words[k - 1], once_per_file=k % 2 == 0) for k, w in enumerate(words[:9])] + [Rule("TWO", f"{words[3]}|{words[-2]}"), Rule("OPEN", "[aq]+")]
    show = lambda df: sorted(map(repr, df.select("app_id", "path", "rule_id", "line", "matches", "file_matches", "truncated", "id").collect()))
    want = show(detect.scan(table, rules))
    assert want and show(rule_index.scan_table(table, detect.rule_table(spark, rules))) == want


def test_only_announcing_stretches_leave_the_texts(spark):
    draw = random.Random(9)
    texts = [(k, " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(400)) + ("\nneedlework" if k == 3 else "")) for k in range(20)]
    sources = spark.createDataFrame(texts, "file bigint, text string")
    rules = rule_index.literal_rules(detect.rule_table(spark, [Rule("N", "needlework"), Rule("M", "missing-words")]))
    rows = rule_index.candidates(sources, rules).collect()
    assert [(r.file, [(x.rule_id, x.lines) for x in r.rules]) for r in rows] == [(3, [("N", [2])])]
    plan = rule_index.candidates(sources, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "Generate" not in plan  # no row for every stretch of a text


def test_a_row_is_as_full_as_its_files_rules_make_it(spark):
    sources = spark.createDataFrame([(1, "needlework"), (2, "needlework word")], "file bigint, text string")
    many = [Rule(f"N{k}", "needlework", requires=f"r{k}") for k in range(1200)] + [Rule(f"O{k}", f"[a-z]{{{k}}}") for k in range(3)]
    many += [Rule(f"X{k}", f"elsewhere{k}") for k in range(3000)]
    rows = rule_index.candidates(sources, rule_index.literal_rules(detect.rule_table(spark, many))).select("file", F.size("rules").alias("n")).collect()
    for file in (1, 2):
        sizes = [r.n for r in rows if r.file == file]
        assert sum(sizes) == 1203 and max(sizes) <= rule_index.RULES_A_ROW + 3 and len(sizes) <= 4
