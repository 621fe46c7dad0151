import re
from html import unescape

import numpy as np

from hopgraph.llm.html import extract, main_text, surges

ARTICLE = "<article><h1>Title</h1><p>Some <b>bold</b>\n text &amp; more&nbsp;here.</p><p>Be.</p><p>Second <a href='x'>link</a> part</p></article>"
WANT = "Title\n\nSome bold text & more here.\n\nBe.\n\nSecond link part"


def test_page_furniture_goes():
    furniture = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{a:'<p>'}</style></head><body>"
        "<script>var a = '<p>no</p>' + \"</nav>\";</script><!-- <p>no</p> --><header><h2>Site</h2></header>"
        "<nav><ul><li><a href=/a>One</a></li><li>Two</ul></nav><div class='cookie-notice'><div>We use</div> cookies</div>"
        "<form><input value='<p>'><button>Go</button>Name</form>%s"
        "<div id=comments><p>" + "A reader wrote very much here. " * 20 + "</p></div><div class=\"adBox ad\">Buy</div>"
        "<aside><article><p>Other story</p></article></aside><footer>&copy; us</footer></body></html>"
    )
    assert main_text(furniture % ARTICLE)[0] == WANT
    plain = "<div><p>" + "word " * 30 + "</p><p>short</p><p>" + "more " * 30 + "</p></div>"
    assert main_text(furniture % plain)[0] == "\n\n".join([("word " * 30).strip(), "short", ("more " * 30).strip()])


def test_articles_end_marked_wrappers():
    for page in (
        '<div class="page has-sidebar">%s</div>',
        '<div class="page with-sidebar"><div class="content-sidebar">%s</div></div>',
        '<div id="content" class="no-comments">%s</div>',
        '<div class="sidebar-layout"><div>%s</div></div>',
        '<main class="content-sidebar">%s</main>',
        '<nav><ul><li>Menu</li></ul><div>%s</div>',
    ):
        assert main_text(f"<html><body>{page % ARTICLE}</body></html>")[0] == WANT
    wide = "<p>" + "word " * 30 + "</p>"
    for name in ("page has-sidebar", "no-comments", "withoutAds"):
        assert main_text(f'<div class="{name}">{wide}</div>')[0] == ("word " * 30).strip()
    other = "<article><p>Another story or a reader's words</p></article>"
    for box in ('<div class="related">%s</div>', "<div id=comments><div>%s</div></div>", "<aside>%s</aside>"):
        assert main_text(f'<div class="has-sidebar">{ARTICLE}{box % other}</div>')[0] == WANT


def test_broken_and_empty_pages():
    for x in (None, "", "<", "<p", "<!--", "<script>", "</p>", "<nav>only a menu</nav>"):
        assert main_text(x)[0] == ""
    assert main_text("<article><p>One.<p>Two <b>&am")[0] == "One.\n\nTwo &am"
    assert main_text("<article><p>One &lt;b&gt; 3 < 4.</p><p>Two</p></artic")[0] == "One <b> 3 < 4.\n\nTwo"
    long = "<article>" + "<p>para</p>" * 20000
    assert main_text(long)[0] == "\n\n".join(["para"] * 20000)
    assert main_text("<div>" * 5000 + "x" * 100)[0] == "x" * 100


def test_surges_against_the_definition():
    rng = np.random.default_rng(1)
    for _ in range(300):
        w = rng.choice([0, 0, 0, 10, 50, 200], size=rng.integers(0, 25))
        sums = [w[i : i + 3].sum() for i in range(len(w))]
        want, i = [], 0
        while i < len(w):
            if w[i] and sums[i] >= 86:
                j = i
                while j < len(w) and sums[j] > 0:
                    j += 1
                want.append((i, j))
                i = j
            else:
                i += 1
        assert surges(w) == want


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        m = re.search(r"<article>(.*?)(</article>|<foote|\Z)", r.html, re.S)
        body = m[1] if m[2] else re.sub(r"<[^>]*\Z", "", m[1])
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split("<p>|</p>|<br>|<h1>|</h1>", body)]
        text = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text)


def test_tables(spark):
    rows = [(1, "u", ARTICLE), (1, "u", ARTICLE), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    assert sorted((str(r.page_id), r.text) for r in extract(pages).collect()) == [("1", WANT), ("1", WANT), ("2", ""), ("None", "")]
    assert extract(pages.filter("page_id = 7")).count() == 0
