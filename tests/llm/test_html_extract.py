"""Main text of pages: markup reading, minimum cuts against all labellings, whole pages, odd rows."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.llm.html_blocks import block_features, read_page
from trendloom.llm.html_extract import content_blocks, extract_main_text, fit, main_text, minimum_cut, page_graph, prior_model, train_block_model
from trendloom.llm.registered import ORACLES, QUERIES

SENTENCES = [
    "The river rose through the night and the lower fields stood under water by morning.", "Nobody had seen such a flood since the old bridge was built.",
    "Farmers moved their cattle to the hills while the council opened the school halls.", "By noon the rain had stopped, and the water began to fall again.",
]
PAGE = f"""<!DOCTYPE html><html><head><title>The flood - Valley News</title><style>p{{color:red}}</style></head><body class="has-sidebar">
<div id="cookie-notice"><p>We use cookies. By using this site you accept our policy on cookies and data.</p></div>
<header><div class="logo">Valley News</div><form><input name=q><button>Search</button></form></header>
<nav><ul><li><a href="/">Home</a><li><a href="/s">Sport</a><li><a href="/w">Weather</a></ul></nav>
<main><article><header><h1>The flood</h1></header><p>{SENTENCES[0]} <a href="x">{SENTENCES[1]}</a></p>
<div class="advert"><p>Buy two rain coats for the price of one. Only this week in our shop.</p></div>
<p>{SENTENCES[2]}<br>{SENTENCES[3]}</p><p>Yes.</p><ul><li>Water: 3&nbsp;m</li><li>Wind &amp; rain</li></ul>
<aside>Read more about floods of the past in this valley and of others.</aside>
<section class="comments"><h2>Comments</h2><div class="comment-body"><p>I was there, and it was much worse than what is written here. My cellar is full.</p></div></section></article></main>
<div class="sidebar"><p>Our reporters are out in every village of the valley. Write to them.</p></div>
<footer><p>&copy; Valley News. All rights reserved. Printed in the valley since 1901.</p></footer><script>var t = "</p><p>no</p>";</script></body></html>"""
EXPECTED = "\n".join(["The flood", f"{SENTENCES[0]} {SENTENCES[1]}", f"{SENTENCES[2]} {SENTENCES[3]}", "Yes.", "Water: 3 m", "Wind & rain"])


def test_whole_page():
    assert main_text(PAGE, prior_model()) == EXPECTED


def test_page_without_helpful_elements():
    page = PAGE
    for tag in ("main", "article", "header", "nav", "aside", "section", "footer"):
        page = re.sub(rf"<(/?){tag}\b", r"<\1div", page)
    text = main_text(page, prior_model())
    assert all(s in text for s in SENTENCES)
    assert not any(s in text for s in ("Sport", "Weather", "cookies", "rain coats", "My cellar"))


@pytest.mark.parametrize("source, texts", [
    ("<p>one<p>two<b>bold</b> three</p> tail", ["one", "twobold three", "tail"]),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", ["a", "b", "c", "d", "e"]),
    ("a &lt;b&gt; &amp;amp; &#65;&#x42; &copy 5 < 6 &unknown;", ["a <b> &amp; AB © 5 < 6 &unknown;"]),
    ("<p title=\"a > b\">x</p><!-- <p>no</p> --><p data-x='>'>y", ["x", "y"]),
    ("<script>if (a</b) '<p>no'</script ><p>yes</p><style>no", ["yes"]),
    ("<p>cut off <a href=\"/x", ["cut off"]), ("<div>x</span></p>y</div>", ["xy"]), ("<!-->a<!--->b<!-- c --!>d<!-- e", ["abd"]),
    ("<TITLE>t</TITLE><TEXTAREA><p>no</TEXTAREA><P>UP</P>", ["UP"]), ("", []), ("   \n ", []), ("plain", ["plain"]), ("<p>a  b\n\n c</p>", ["a b c"]),
    ("<p>a<br>b<hr>c</p>", ["a b", "c"]), ("<a>x<a>y</a>", ["xy"]), ("<", ["<"]), ("<p>1</p></article></div></p>2", ["1", "2"]), ("<noscript><p>no</noscript>k", ["k"]),
    ("<svg><text>no</text></svg>x<svg/>y", ["xy"]), ("<p>İ</p><script>x</script>z", ["İ", "z"]),
])
def test_markup(source, texts):
    assert [b.text for b in read_page(source).blocks] == texts


@pytest.mark.parametrize("source, kept", [
    ("<div class=comments><div class=content><p>no</p></div></div>", [-1]), ("<form><article><p>yes</p><form>no</form></article></form>", [1, -1]),
    ("<div class='no-sidebar content'><p>yes</p></div>", [1]), ("<aside><article><p>no</p></article></aside>", [-1]), ("<div class=sidebar><main><p>yes</p></main></div>", [1]),
    ("<article><footer>no</footer><p>yes</p></article><header>no</header>", [-1, 1, -1]), ("<article><p>a <span class=ad>no</span> b</p></article>", [1, -1, 1]),
    ("<div hidden><p>no</p></div><div style='display: none'>no</div><p>?</p>", [-1, -1, 0]), ("<div role=main>yes</div><div class=mainMenu>no</div>", [1, -1]),
])
def test_evidence(source, kept):
    assert [b.evidence for b in read_page(source).blocks] == kept


def cut_cost(side, sources, sinks, edges):
    return sum(t if s else f for s, f, t in zip(side, sources, sinks)) + sum(c for u, v, c in edges if side[u] != side[v])


def test_minimum_cut_against_all_labellings():
    draw = random.Random(5)
    for _ in range(300):
        n = draw.randint(1, 8)
        sources, sinks = ([draw.choice([0, 0, 1, 2, 5, 9]) for _ in range(n)] for _ in range(2))
        edges = [(u, v, draw.randint(0, 6)) for u in range(n) for v in range(u) if draw.random() < 0.5]
        best = min(cut_cost(side, sources, sinks, edges) for side in itertools.product([False, True], repeat=n))
        assert cut_cost(minimum_cut(sources, sinks, edges), sources, sinks, edges) == best


def test_page_labels_are_a_minimum_over_all_labellings():
    page = read_page("<div><p>" + SENTENCES[0] + "</p><li><a>x</a></li><p>Yes.</p></div><div class=ad>Buy this</div><p>" + SENTENCES[1])
    odds = prior_model().log_odds(block_features(page.blocks))
    sources, sinks, edges = page_graph(page, odds)
    best = min(cut_cost(side, sources, sinks, edges) for side in itertools.product([False, True], repeat=len(sources)))
    assert cut_cost(minimum_cut(sources, sinks, edges), sources, sinks, edges) == best


def test_smoothing_carries_an_undecided_block_with_its_neighbours():
    page = read_page("".join(f"<p>{s}</p>" for s in SENTENCES) + "<p>Ok</p>" + "".join(f"<p>{s}</p>" for s in SENTENCES))
    odds = np.full(len(page.blocks), 3.0)
    odds[4] = -1.0
    assert all(minimum_cut(*page_graph(page, odds))[:9])
    odds[4] = -4.0
    assert not minimum_cut(*page_graph(page, odds))[4]


def test_very_long_page_is_read_whole():
    source = "<article>" + "".join(f"<p>Paragraph {i} tells of the day.</p>" + ("<div class=ad>Buy</div>" if i % 3 == 0 else "") for i in range(20_000)) + "</article><footer>end</footer>"
    lines = main_text(source, prior_model()).split("\n")
    assert lines == [f"Paragraph {i} tells of the day." for i in range(20_000)]
    assert main_text("<div>" * 20_000 + "deep", prior_model()) in ("", "deep")


def test_fit_follows_labels_and_falls_back(spark):
    rows = np.random.default_rng(0).normal(size=(400, 14))
    labels = (rows[:, 0] - rows[:, 5] > 0).astype(float)
    assert ((fit(rows, labels).weights @ rows.T > 0) == labels).mean() > 0.9
    none = spark.createDataFrame([(1, "<p>x</p>"), (2, None)], "page_id long, html string")
    assert (train_block_model(none).weights == prior_model().weights).all()


def test_classifier_on_pages_without_evidence(spark, sf_dir):
    """Trained on one half of the pages, it finds the articles of the other half by text alone, with all names and elements hidden."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").cache()
    model = train_block_model(pages.where("page_id % 2 = 0"))
    right = total = 0
    for row in pages.where("page_id % 2 = 1").collect():
        page = read_page(row["html"])
        truth = [b.evidence > 0 for b in page.blocks]
        for block in page.blocks:
            block.evidence = 0
        right += sum(a == b for a, b in zip(truth, content_blocks(page, model)))
        total += len(truth)
    assert right / total > 0.95


def test_odd_rows(spark):
    rows = [(1, "u", None, "a"), (2, None, "", "b"), (2, None, "", "b"), (None, "u", PAGE, None), (3, "u", "<nav>x</nav>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    out = extract_main_text(pages, prior_model())
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    got = sorted(((r["page_id"] or 0), r["text"], r["n_chars"]) for r in out.collect())
    assert got == sorted([(1, "", 0), (2, "", 0), (2, "", 0), (0, EXPECTED, len(EXPECTED)), (3, "", 0)])
    assert extract_main_text(pages.where("false"), train_block_model(pages.where("false"))).count() == 0
    clash = pages.withColumn("text", F.lit("old")).withColumn("key", F.lit(1)).withColumn("features", F.lit(1))
    assert extract_main_text(clash, train_block_model(clash)).where("text = 'old'").count() == 0


def test_query_over_all_pages(spark, sf_dir):
    import duckdb

    rows = QUERIES["op11_html_extract"](spark, sf_dir).collect()
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    twin = duckdb.sql(ORACLES["op11_html_extract"])
    assert sorted(map(tuple, rows)) == sorted(tuple(r) for r in twin.select("page_id, url, text, n_chars").fetchall())
