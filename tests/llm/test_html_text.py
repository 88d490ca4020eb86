import html
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from glossaleaf.llm import html_text
from glossaleaf.llm.queries import op12_html_text

PRIOR = html_text.weights({})


def main_text(source):
    return html_text.Page(source).main_text(PRIOR)


def cost(labels, gains, edges):
    return sum(abs(g) for g, x in zip(gains, labels) if (g > 0) != x and g) + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_cut_against_all_labellings():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 9)
        gains = [rng.randrange(-30, 31) / 10 for _ in range(n)]
        edges = [(i, i + 1, rng.choice([0.3, 1.0])) for i in range(n - 1)]
        edges += [(i, j, 0.5) for i in range(n) for j in range(i + 2, n) if rng.random() < 0.3]
        labels = html_text.min_cut(gains, edges)
        costs = {x: round(cost(x, gains, edges), 6) for x in itertools.product([False, True], repeat=n)}
        least = min(costs.values())
        assert round(cost(labels, gains, edges), 6) == least
        # of several the one with the most content
        assert sum(labels) == max(sum(x) for x, c in costs.items() if c == least)


def test_cut_of_long_pages():
    rng = random.Random(5)
    n = 20_000
    gains = [rng.uniform(-1, 1) for _ in range(n)]
    edges = [(i, i + 1, 0.9) for i in range(n - 1)] + [(i, i + 2, 0.5) for i in range(n - 2)]
    assert len(html_text.min_cut(gains, edges)) == n
    assert html_text.min_cut([], []) == []


PARTS = {
    "nav": '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></ul></nav>',
    "header": "<header><h2>My site</h2><p>The best site, they say, of all the sites there are.</p></header>",
    "ad": '<div class="ad">Buy this wonderful thing, it is cheap and good for you.</div>',
    "side": '<aside class="sidebar"><h3>Related</h3><p>Another long story, which we also wrote, about other things.</p></aside>',
    "notice": '<div id="cookie-notice"><p>We use cookies, as you know, to make this site better for all of us.</p></div>',
    "form": '<form action="/s"><label>Your name, please.</label><input name=q><button>Send</button></form>',
    "comments": '<section class="comments"><h3>Comments</h3><article class="comment"><p>I liked it, and so did my dog, very much.</p></article></section>',
    "script": '<script>document.write("<p>not shown, though it looks like text.</p>")</script><style>p > a {}</style>',
    "footer": "<footer>&copy; 2024 Someone. All rights reserved, as ever, by the owner.</footer>",
    "markup": "<!-- <p>gone</p> --><template><p>Unseen text, quite long, in a template.</p></template><p hidden>Hidden.</p>",
}
ARTICLE = "<h1>A &amp; B</h1><p>First  <b>para</b>graph,\n of <a href='x'>some</a> length.<p>No.</p><ul><li>One item</li><li>Two</ul><br>"
WANT = "A & B\nFirst paragraph, of some length.\nNo.\nOne item\nTwo"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><article>{}</article></main>", '<div class="content">{}</div>', "<main>{}</main>"])
@pytest.mark.parametrize("order", range(4))
def test_parts_of_a_page(wrap, order):
    rng = random.Random(order)
    parts = list(PARTS.values())
    rng.shuffle(parts)
    at = rng.randrange(len(parts))
    page = "<!DOCTYPE html><html><head><title>A & B</title></head><body>" + "".join(parts[:at]) + wrap.format(ARTICLE) + "".join(parts[at:])
    assert main_text(page) == WANT
    assert main_text(page + "</body></html>") == WANT


def test_parts_inside_the_article():
    inside = ARTICLE + "".join(PARTS[x] for x in ("side", "form", "comments", "ad", "script", "markup"))
    assert main_text(f"<body><article>{inside}</article></body>") == WANT


def test_wrappers_named_like_boilerplate():
    assert main_text(f'<body class="no-sidebar"><div class="with-sidebar"><main>{ARTICLE}</main></div></body>') == WANT
    assert main_text(f'<form id="page"><div class="banner-layout"><article>{ARTICLE}</article></div></form>') == WANT


def test_pages_without_names():
    long = "<p>This is a long paragraph, with commas, that reads like a text and goes on for quite a while.</p>"
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(8))
    page = f"<body><ul>{links}</ul><div>{long}<p>Short.</p>{long}</div><ul>{links}</ul></body>"
    plain = html.unescape(re.sub("<[^>]+>", "", long))
    assert main_text(page) == f"{plain}\nShort.\n{plain}"


@pytest.mark.parametrize(
    "source, want",
    [
        ("", ""), ("   \n", ""), ("<", ""), ("<script>x", ""), ("<article>a &lt;b&gt; &#233;&nbsp;&eacute c</article>", "a <b> é é c"),
        ("<article><p>a<br>b</p>c<div>d</div>e</article>", "a b\nc\nd\ne"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
        ("<article><p title='a > b'>one < two</p></article>", "one < two"),
        ("<article><p>a</b></p></i>b</article></article>", "a\nb"), ("<ARTICLE><P CLASS=ad>x</P>y</ARTICLE>", "y"),
        ("<article><p>x<script>'</p>'</script>y<!-- no --> z</p></article>", "xy z"), ("<article><dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"),
    ],
)
def test_small_cases(source, want):
    assert main_text(source) == want


def test_deep_and_broken_pages_end():
    deep = "<div>" * 30_000 + "text, here." + "</span>" * 30_000 + "</div>" * 10
    assert html_text.Page(deep).texts == ["text, here."]
    assert html_text.Page("<p " * 3000).texts is not None
    assert len(html_text.Page("<p>a" * 30_000).texts) == 30_000


PAGES = [
    (1, "u1", f"<body>{PARTS['nav']}<article>{ARTICLE}</article>{PARTS['footer']}"), (2, None, None), (None, "u3", ""), (4, "", "no markup at all"),
    (5, "u5", "<article>" + "<p>Word, and more words.</p>" * 5000 + "</article>"), (5, "u5", "<article><p>again</p></article>"),
    (5, "u5", "<article><p>again</p></article>"),
]


def test_messy_table(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    df = df.withColumns({c: F.lit("own") for c in ("text", "n_chars", "kept_0", "feature", "side")})
    rows = [tuple(r) for r in html_text.extract(df).collect()]
    got = sorted([r for r in rows if r[0] not in (4, 5)], key=repr)
    assert got == sorted([(1, "u1", WANT, len(WANT)), (2, None, "", 0), (None, "u3", "", 0)], key=repr)
    long = "\n".join(["Word, and more words."] * 5000)
    assert sorted(r for r in rows if r[0] == 5) == [(5, "u5", long, len(long)), (5, "u5", "again", 5), (5, "u5", "again", 5)]
    assert len(rows) == len(PAGES)


def test_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_registered_query_against_the_pages_own_articles(spark, sf_dir):
    """In the given pages the main text is what lies in the article."""
    got = {r["page_id"]: r for r in op12_html_text(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        inside = re.search("<article>(.*)</article>", page["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        want = "\n".join(b for b in blocks if b)
        assert (got[page["page_id"]]["text"], got[page["page_id"]]["n_chars"]) == (want, len(want))
