"""Main text of pages: the block splitter, held-out accuracy of the labeller, and whole pages."""

import re

import numpy as np
import pytest

from sightline.llm import block_labeller, queries
from sightline.llm.html_blocks import blocks

FOLDER = "/root/testdata/sf0.001"
PROSE = "Ther onand the enre of ingly, with thea orat and he was. Nd the onti erth in."


@pytest.fixture(scope="module")
def model(spark):
    return block_labeller.sampled_model(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks_of_odd_markup():
    assert texts('<p>a &am b&nbsp;&lt;c<p>d <b>e</b>f<ul><li>x<li>y</ul>tail < 3 <unclosed') == ["a &am b <c", "d ef", "x", "y", "tail < 3"]
    assert texts("<div>x</div><!-- open <p>y") == ["x", "y"]
    assert texts('<script>var t="</p>";</script>z<SCRIPT>no</Script >w<style>p{}') == ["zw"]
    assert texts("<td>1<td>2<tr><td>3") == ["1", "2", "3"]
    assert texts('<a href="a>b">l</a> t<br>u') == ["l t u"]
    assert texts("<p x='>q</p> r<title>t</title><template><p>no</p></template>") == ["q", "r"]
    assert texts("") == texts("<p> \n</p>") == [] and texts("plain \n text") == ["plain text"]
    assert texts("<ul><li>a<ul><li>b</ul><li>c</ul></div></p>d") == ["a", "b", "c", "d"]


def test_blocks_of_long_odd_markup_are_quick():
    for part in ("<div>", '<a ="', "<p class=x>w", "</div>", "<!--", "<", "<li>a<div>", '<a x="<b y=\'>'):
        blocks(part * 100_000)


def test_gradient_is_the_slope_of_the_loss():
    pages = [blocks(f"<article><h1>a b</h1><p>{PROSE}</p></article><div class=ad>x y</div>"), [], blocks("<nav><a href=1>q</a></nav><p>r")]
    f = block_labeller.Features(pages)
    labels, worded = np.array([1, 1, 0, 0, 1], dtype=np.float32), np.ones(5, dtype=np.float32)
    model = block_labeller.Labeller(3)
    model.weights = {k: w.astype(np.float64) for k, w in model.weights.items()}
    grads = model.gradient(f, labels, worded)

    def loss():
        s = model.scores(f)
        return float(np.mean(np.log1p(np.exp(-np.where(labels > 0, s, -s)))))

    draw = np.random.default_rng(1)
    for name, g in grads.items():
        flat, where = model.weights[name].reshape(-1), np.argsort(-np.abs(g).ravel())[:40]
        k = int(draw.choice(where))
        held = flat[k]
        flat[k] = held + 1e-3
        up = loss()
        flat[k] = held - 1e-3
        down = loss()
        flat[k] = held
        assert abs((up - down) / 2e-3 - g.ravel()[k]) < 2e-3 * max(1.0, abs(g).max()), name


def test_held_out_layouts(spark, model):
    other = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").where("page_id >= 60").limit(150).collect()]
    lessons = block_labeller.lessons(other, 800, seed=77)
    lessons = lessons[-700:]  # drawn ones only
    f = block_labeller.Features([p for p, _ in lessons])
    labels = np.array([x for _, y in lessons for x in y])
    wrong = (model.scores(f) > 0) != labels
    assert wrong.mean() < 0.01
    given = [blocks(page) for page in other]  # pages whose own elements tell
    told = np.array([x for page in given for x in block_labeller.by_elements(page)])
    assert ((model.scores(block_labeller.Features(given)) > 0) == told).all()


def brute_given(page):
    """Main text of the given pages by their known layout."""
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    parts = re.split(r"<h1>|</h1>|<p>|</p>", inner)
    cleaned = [" ".join(re.sub(r"</?(b|br)>", " ", p).split()) for p in parts]
    import html

    return "\n\n".join(" ".join(html.unescape(p).split()) for p in cleaned if p)


def test_query_on_the_smallest_tables(spark):
    got = {r.page_id: r for r in queries.QUERIES["op11_block_labeller"](spark, FOLDER).collect()}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == brute_given(p.html) and got[p.page_id].n_chars == len(brute_given(p.html)) and got[p.page_id].url == p.url


def test_other_layouts_and_odd_rows(spark, model):
    page = (
        f"<body><div class=cookie-banner><p>We use cookies. {PROSE}</p></div><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>"
        f"<main><article><header><h1>Real title</h1></header><p>{PROSE} &lt;1&gt;</p><aside class=promo><p>{PROSE}</p></aside><p>Last\n one.</p>"
        f"<form><label>Email</label><input><button>Go</button></form></article><section class=reader-comments><p>{PROSE}</p></section></main>"
        f"<footer><p>{PROSE}</p></footer>"
    )
    long = "<article>" + f"<p>{PROSE}</p>" * 30_000 + "</article>"
    rows = [(1, "u", page, "a", 1), (2, None, None, "b", 2), (3, "v", "", None, 3), (None, "w", "<nav><ul><li><a href=1>Menu</a></ul></nav>", "c", 4), (5, "x", long, "d", 5)]
    rows += [(6, "y", page, "same", 6)] * 3
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = block_labeller.extract(table, model).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert by_id[1].text == by_id[6].text == f"Real title\n\n{PROSE} <1>\n\nLast one."
    assert [by_id[k].text for k in (2, 3, None)] == ["", "", ""] and by_id[2].n_chars == 0
    assert by_id[5].text == "\n\n".join([PROSE] * 30_000)
    assert block_labeller.extract(table.limit(0), model).count() == 0


def test_training_without_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert block_labeller.extract(empty).count() == 0
