"""Fill-in-the-middle and periodic runs against plain Python on small tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sightline.llm import fill_middle, periodic_runs, queries

FOLDER = "/root/testdata/sf0.001"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table_of(spark, texts, clash=False):
    schema = "doc_id long, text string"
    rows = list(texts)
    if clash:
        schema += ", n string, form string, output string, runs string, h1 string, digest string, rank int"
        rows = [(*r, "x", "y", "z", "r", "h", "d", 1) for r in rows]
    return spark.createDataFrame(rows, schema)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Fill-in-the-middle


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(p) for p in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def odd_texts():
    draw = random.Random(5)
    alphabet = ["a", "Zq", "é", "語", "😀", " ", "\n", "<", ">", "<P", "S>", "M", "́", "1"]
    rows = [(i, "".join(draw.choice(alphabet) for _ in range(draw.randrange(0, 40)))) for i in range(600)]
    rows += [(None, "no id at all"), (None, None), (1000, None), (1001, ""), (1002, "with <P> inside"), (1003, "<M>"), (1004, "a<S>b")]
    rows += [(1005, "long é " * 400_000), (1006, "x" * 3_000_000), (-7, "negative id text")]
    return rows + [(i, "same text for many") for i in range(2000, 2100)] + [(3000, "same row")] * 5 + [(k, "<") for k in range(4000, 4040)] + [(k, "P>") for k in range(5000, 5040)]


def test_fim_equals_brute_force(spark):
    rows = odd_texts()
    got = fill_middle.transform(table_of(spark, rows, clash=True)).collect()
    want = sorted((brute_fim(*r) for r in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_rebuilds_from_output_and_form_only():
    texts = [b"one two", b"", "é😀x".encode(), b"<<S", b"P>"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    draws = [np.array(d) for d in ([1, 0, 2, 3, 0], [3, 0, 1, 0, 0], [0] * 5, [99, 0, 0, 99, 0])]
    n, form, _, _, low, high = fill_middle.cut(data, offsets, draws)
    out, out_offsets = fill_middle.scatter(data, offsets, form, low, high)
    again, again_offsets = fill_middle.restore(out, out_offsets, form)
    assert [again[a:b].tobytes() for a, b in zip(again_offsets, again_offsets[1:])] == texts
    assert n.tolist() == [3, 0, 3, 3, 2]


def test_fim_of_empty_table(spark):
    assert fill_middle.transform(table_of(spark, [])).count() == 0


# Periodic runs


def brute_runs(words, least=6, exponent=4):
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            stop = i
            while stop + q < n and words[stop] == words[stop + q]:
                stop += 1
            stretch = words[i : stop + q]
            smaller = any(all(stretch[k] == stretch[k + p] for k in range(len(stretch) - p)) for p in range(1, q))
            if not smaller and len(stretch) >= max(least, exponent * q):
                found.append((i, len(stretch), q))
            i = stop
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_words(doc_id, text):
    words = re.findall(f"[^{SPACES}]+", text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def brute_digest(doc_id, text):
    words = brute_words(doc_id, text)
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    drop = {k for s, n, q in runs for k in range(s + q, s + n)}
    kept = " ".join(w for k, w in enumerate(words) if k not in drop)
    milli = 1000 * best[1] // best[2] if runs else None
    return doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept)


def test_runs_of_random_sequences():
    draw = random.Random(11)
    for _ in range(1500):
        kinds = draw.choice([1, 2, 2, 3, 8])
        words = []
        while len(words) < draw.randrange(0, 60):
            part = [draw.randrange(kinds) for _ in range(draw.randrange(1, 6))]
            words += part * draw.choice([1, 1, 2, 4, 5, 9])
        least, exponent = draw.choice([(6, 4), (6, 4), (2, 2), (9, 3)])
        assert periodic_runs.find_runs(np.array(words, dtype=np.int64), least, exponent) == brute_runs(words, least, exponent)


def test_long_runs():
    one = np.zeros(50_000, dtype=np.int64)
    assert periodic_runs.find_runs(one) == [(0, 50_000, 1)]
    period = np.arange(3_000, dtype=np.int64)
    words = np.concatenate([[9_999], np.tile(period, 5)[:-7], [8_888]])
    assert periodic_runs.find_runs(words) == [(1, 14_993, 3_000)]


def test_digests_equal_brute_force(spark):
    draw = random.Random(3)
    rows = []
    for i in range(700):
        text = " ".join(draw.choice(["la", "li", "lo", "é"]) for _ in range(draw.randrange(0, 50)))
        rows.append((i, text + draw.choice(["", " ding dong" * 6, "\x1c   " * 9, "\n\t\x0b\x0c\rx" * 7])))
    rows += [(None, "tick " * 9), (None, None), (900, None), (901, ""), (902, "  \n "), (903, "one two " * 3000), (904, "a b c a b c a b c a b c")]
    rows += [(905, "x x x x x x y x x x x x x")] * 4
    got = periodic_runs.digests(periodic_runs.annotate(table_of(spark, rows, clash=True), rewrite=periodic_runs.periodic_tail)).collect()
    short = [r for r in rows if r[0] != 903]
    assert sorted((tuple(r) for r in got if r.doc_id != 903), key=repr) == sorted((brute_digest(*r) for r in short), key=repr)
    long = next(r for r in got if r.doc_id == 903)
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 6000, 2, 3_000_000)
    assert long.collapsed_sha256 == sha("one two")


def test_runs_without_rewriting_and_empty(spark):
    row = periodic_runs.annotate(table_of(spark, [(1, "go " * 8 + "stop")])).first()
    assert row.n_words == 9 and [tuple(r) for r in row.runs] == [(0, 8, 1)] and row.collapsed == "go stop"
    assert periodic_runs.digests(periodic_runs.annotate(table_of(spark, []))).count() == 0


@pytest.mark.parametrize("name,brute", [("op12_periodic_runs", brute_digest)])
def test_query_on_the_smallest_tables(spark, name, brute):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    docs = [d for d in docs if len(d.text or "") < 4000]
    wanted = {d.doc_id for d in docs}
    got = [tuple(r) for r in queries.QUERIES[name](spark, FOLDER).collect() if r.doc_id in wanted]
    assert sorted(got, key=repr) == sorted((brute(d.doc_id, d.text) for d in docs), key=repr)
