import re

import pytest
from pyspark.sql import functions as F

from curvecal.llm import html_diff

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<div id="cookie-notice">We use cookies</div><article class="post"><header><h1>Head  &amp; line</h1></header>
<p><b>First  <i>para</i>graph.<br>next<br><p>Second &lt;x&gt; &#233;<div class="comments"><p>Nice!</p></div>
<aside>More</aside><form><input name=q>Search</form><p>Third</p></article><div class="sidebar">Side</div><footer>&copy; f</footer></body></html>"""


def text_of(source):
    return html_diff.main_text(html_diff.page_lines(source))


def test_article():
    assert text_of(PAGE) == "Head & line\nFirst paragraph. next\nSecond <x> é\nThird"


def test_odd_pages():
    assert text_of(None) == "" and text_of("") == "" and text_of("plain  text") == "plain text"
    assert text_of("<article><p>cut off in the mid") == "cut off in the mid"
    assert text_of("<article><p>a</p><p class=") == "a"
    assert text_of("<p>a</p></div></article><p>b") == "a\nb"
    assert text_of("<body><div hidden>no</div><p>yes &am") == "yes &am"


def test_common_lines():
    assert html_diff.common_lines([1, 2, 3, 4, 5], [9, 2, 4, 3, 5]) in ([1, 2, 4], [1, 3, 4])
    assert html_diff.common_lines([1, 1, 1], [1, 1]) in ([0, 1], [1, 2], [0, 2])
    assert html_diff.common_lines([], [1]) == [] == html_diff.common_lines([1], [])


def test_unmarked_pages_lose_what_the_nearest_page_shares(spark):
    def page(body):
        return f"<html><body><div>Top of all pages</div>{body}<div>Bottom of all pages</div></body></html>"

    rows = [(k, f"http://h.org/a/{k}", page(f"<p>Own text of the page with the number {k}, long enough.</p>"), "o") for k in range(6)]
    rows += [(10, "http://copy.org/1", page("<p>Same long text of two copies</p>"), "o"),
             (11, "http://copy.org/2", page("<p>Same long text of two copies</p>"), "o"),
             (20, "http://alone.org/", page("<p>Alone</p>"), "o"), (30, None, PAGE, "o"), (31, None, None, "o"), (32, "x", "", None), (32, "x", "", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(3)
    got = {r.page_id: r.text for r in html_diff.extract(df).collect()}
    for k in range(6):
        assert got[k] == f"Own text of the page with the number {k}, long enough."
    assert got[10] == got[11] == "Top of all pages\nSame long text of two copies\nBottom of all pages"
    assert got[20] == "Top of all pages\nAlone\nBottom of all pages"
    assert got[30].startswith("Head & line") and got[31] == "" and got[32] == ""
    assert html_diff.extract(df).count() == len(rows) and html_diff.extract(df.limit(0)).count() == 0


def test_articles_lose_what_the_nearest_page_shares(spark):
    def page(body, beside=""):
        return f"<html><body><nav>Menu</nav><div>Beside</div>{beside}<article><p>Share this text!</p>{body}<p>Notice of all</p></article></body></html>"

    rows = [(k, f"http://h.org/a/{k}", page(f"<h1>Head {k}</h1><p>Own text of the page with the number {k}, long enough.</p>",
                                             f"<aside><p>Head {k + 1}</p><p>Head {k - 1}</p></aside>")) for k in range(6)]
    rows += [(k, f"http://copy.org/{k}", page("<p>Same article, long enough to hold most of the text, on two pages</p>")) for k in (10, 11)]
    got = {r.page_id: r.text for r in html_diff.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(6):
        assert got[k] == f"Head {k}\nOwn text of the page with the number {k}, long enough."
    assert got[10] == got[11] == "Share this text!\nSame article, long enough to hold most of the text, on two pages\nNotice of all"


def test_short_texts_under_long_menus_and_copies_with_other_neighbours(spark):
    def page(body):
        menu = "".join(f"<div>Entry {i} of a menu</div>" for i in range(15))
        return f"<html><body>{menu}<div>{body}</div><div>Bottom of all pages, with a long line</div></body></html>"

    texts = [f"Own text {k}. " + f"word{k} " * 28 for k in range(5)]
    rows = [(k, f"http://h.org/{k}", page(x)) for k, x in enumerate(texts)]
    # twenty copies in a row, one other page behind them; articles likewise
    rows += [(100 + k, f"http://copy.org/{100 + k}", page(texts[0])) for k in range(20)] + [(120, "http://copy.org/120", page(texts[1]))]
    rows += [(200 + k, f"http://both.org/{200 + k}", f"<article><p>{texts[max(0, k - 18)]}</p><p>Notice</p></article>") for k in range(21)]
    # a host of copies only; a page of nothing but the menu; a copy cut off in the middle
    rows += [(300 + k, f"http://same.org/{300 + k}", page(texts[0])) for k in range(9)]
    rows += [(5, "http://h.org/5", page("")), (6, "http://h.org/6", page("<p>" + "</p><p>".join(texts * 3) + "</p>")),
             (7, "http://h.org/7", page("<p>" + "</p><p>".join(texts * 3))[:-80])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_diff.extract(df).collect()}
    assert {k: got[k] for k in range(5)} == {k: x.strip() for k, x in enumerate(texts)}
    assert {got[100 + k] for k in range(20)} == {texts[0].strip()} and got[120] == texts[1].strip()
    assert {got[300 + k] for k in range(9)} == {html_diff.main_text(html_diff.page_lines(rows[0][2]))} and got[5] == ""
    assert texts[3].strip() in got[6] and texts[3].strip() in got[7]
    assert {got[200 + k] for k in range(19)} == {texts[0].strip()} and got[219] == texts[1].strip() and got[220] == texts[2].strip()


def test_what_one_neighbour_happens_to_share_stays(spark):
    def page(*lines):
        return "<html><body><nav>Menu</nav><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article></body></html>"

    own = [f"Own text of the page with the number {k}, long enough." for k in range(8)]
    rows = [(k, f"http://h.org/a/{k}", page(f"Head {k // 2}", own[k], *(["A common sentence."] if k in (2, 3, 5) else []))) for k in range(8)]
    # two articles only: nothing tells a notice from a sentence; copies are one article however many there are
    rows += [(20 + k, f"http://two.org/{k}", page(own[k], "Shared")) for k in range(2)]
    rows += [(30 + k, f"http://copies.org/{k}", page(own[0], "More of it", "Shared")) for k in range(9)] + [(39, "http://copies.org/9", page(own[1], "Shared"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    df = df.withColumns({c: F.lit("x") for c in ("_key", "_text", "_deleted", "_html", "_0", "_1", "host", "n", "deleted", "TEXT2")})
    got = html_diff.extract(df)
    assert set(got.columns) == set(df.columns) - {"html"} | {"text"}
    assert {r.page_id: r.text for r in got.collect()} == {r[0]: text_of(r[2]) for r in rows}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_articles_of_the_test_pages(spark, folder):
    """Every page is its heading and the lines of its document, nothing less and nothing more."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    n = 0
    for r in html_diff.extract(pages).collect():
        number = int(re.search(r"/([0-9]+)[^/0-9]*/?$", re.match("[^?#]*", r.url)[0])[1])
        if number in docs:
            lines = [" ".join(x.split()) for x in docs[number].split("\n")]
            assert r.text.split("\n")[1:] == [x for x in lines if x], r.url
            n += 1
    assert n > 20
