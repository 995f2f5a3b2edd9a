import json
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from ledgerpulse.llm import html_extract as h
from ledgerpulse.llm.queries import QUERIES, table

PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a="</article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href='/b'>B</a></ul></nav>
<div id="cookie-notice">We use cookies</div><!-- <p>not me</p> --><main><div class="{wrap}"><header><h2>{title}</h2></header>{body}
<div class="ad ad-12">Buy!</div><form><input name=q><button>Go</button></form></div></main>
<section class="comments"><h3>Comments</h3><article class="comment"><p>First!</p></article></section>
<aside class="sidebar">Side</aside><footer>&copy; us</footer></body></html>"""


def read(html, others=()):
    wrapper = h.page_expression(html)
    for other in others:
        wrapper = h.aligned(wrapper, h.page_expression(other))
    return h.Reader(h.article_places(wrapper)).text(html)


@pytest.mark.parametrize("wrap", ["x", "post-content", "entry"])
def test_what_is_not_the_article(wrap):
    html = PAGE.format(wrap=wrap, title="A &amp; B", body="<p>One\n <b>bold</b>\ttext<p>Two<br>lines &nbsp;&#233;&lt;\n<ul><li>x<li>y</ul>tail")
    assert read(html) == "A & B\nOne bold text\nTwo lines é<\nx\ny\ntail"
    assert read(html.replace("<main>", "").replace("</main>", "").replace("header><h2", "div><h2").replace("h2></header", "h2></div")) == read(html)


def test_article_wins_over_other_text():
    html = "<body><p>teaser text here</p><div class=content><article><h1>T</h1><p>Own</div></article><p>after</p>"
    assert read(html) == "T\nOwn"
    assert read("<article>a</article><article>b</article>") == "a\nb"
    assert read("plain <i>te</i>xt") == "plain text"
    assert read("<p>a < b & c <3</p>") == "a < b & c <3"
    assert read("") == read("<script>x") == read("<!-- x") == ""


def test_template_text_goes_where_no_element_tells_the_article():
    pages = [f"<body><div>Welcome to us</div><div><a href=/>Home</a> <a href=/x>More</a></div><div><p>Story {i}</p><p>Text {i}</p></div>" for i in range(4)]
    assert read(pages[2], [p for p in pages if p != pages[2]]) == "Story 2\nText 2"


def test_alignment_makes_optional_and_repeated_parts():
    pages = ["<body><h1>Hi</h1><p>a</p>", "<body><h1>Hi</h1><div class=x>n</div><p>a</p><p>b</p><p>c</p>", "<body><h1>Hi</h1><hr><p>d</p>"]
    wrapper = h.page_expression(pages[0])
    for page in pages[1:]:
        wrapper = h.aligned(wrapper, h.page_expression(page))
    assert h.as_pattern(wrapper) == '<body><h1>"Hi"</> <div.x>"n"</>? <p>#text</>+</>'
    run = h.page_expression("<body>" + "<h2>a</h2><p>b</p>" * 5 + "<h2>c</h2>")
    assert h.as_pattern(run) == "<body>(<h2>\"a\"</> <p>\"b\"</>)+ <h2>\"c\"</></>"
    assert len(json.dumps(h.page_expression("<body>" + "".join(f"<x{i}>t</x{i}>" for i in "abcdefgh" * 60)))) < 3000


def test_deep_and_odd_pages():
    assert read("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert read("<article>" + "<p><b>x<i>y" * 400) == "\n".join(["xy"] * 400)
    assert read("<a href='x" * 500) == ""
    assert read("<article><table><tr><td>a<td>b<tr><td>c</table></article>") == "a\nb\nc"


def test_untidy_rows(spark):
    rows = [(1, "http://a.example.com/1", "<article>one</article>", "x"), (1, "http://a.example.com/1", "<article>one</article>", "x")]
    rows += [(2, None, "<p>two", "x"), (3, "odd", None, None), (None, "https://u@A.Example.com:80/q", "<article>three</article>", "x"), (5, "http://b", "", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, site string").withColumn("places", F.lit(1))
    found = h.extract_main_text(pages)
    assert found.columns == [*pages.columns, "main_text"]
    assert sorted((str(r.page_id), r.main_text) for r in found.collect()) == [("1", "one"), ("1", "one"), ("2", "two"), ("3", ""), ("5", ""), ("None", "three")]
    assert {r.site for r in h.infer_wrappers(pages).collect()} == {"a.example.com", "b", ""}
    assert h.extract_main_text(pages.limit(0)).count() == 0


def test_many_tasks_tell_the_same(spark, data):
    pages = table(spark, data, "pages")
    one = {r.page_id: r.main_text for r in h.extract_main_text(pages.coalesce(1)).collect()}
    many = {r.page_id: r.main_text for r in h.extract_main_text(pages.repartition(37)).collect()}
    assert one == many


class Plain(HTMLParser):
    """The article of the table's pages, read the plain way."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag not in ("b", "br"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_query_against_plain_reading(spark, data):
    want = {}
    for r in table(spark, data, "pages").collect():
        parser = Plain()
        parser.feed(r.html or "")
        parser.close()
        text = "\n".join(b for b in (" ".join(b.split()) for b in parser.blocks) if b)
        want[r.page_id] = (r.url, text, len(text))
    rows = QUERIES["op9_html_extraction"](spark, data).collect()
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in rows} == want
    assert all(v[2] for v in want.values())


def test_depth_changes_nothing():
    inner = "<nav>Menu</nav><article><h1>T</h1><div class=ad>Buy</div><p>Own</article><div class=comments>C</div>"
    for n in (10, 95, 96, 97, 150, 5000):
        assert read("<body>" + "<div>" * n + inner + "</div>" * n + "after") == "T\nOwn"
    for n in (10, 5000):
        assert read("<div class=content>" + "<div>" * n + "a" + "</div>" * n + "<p>b</p></div><p>c") == "a\nb"
        assert read("<article>" + "<b>" * n + "<div>a</div><nav>n</nav><p>b</article>") == "a\nb"
    assert len(read("<article>" + "<div>x<p>y" * 50_000).split("\n")) == 100_000


def test_content_that_is_not_html():
    assert read("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</article>") == "so x=1 holds"
    assert read("<article>a <svg viewBox='0'><path d='M0'/><title>t</title><text>label</text></svg> b</article>") == "a label b"
    assert read("<article>a <noscript>plain</noscript> b<xmp>&lt;<i></xmp></article>") == "a plain b\n&lt;<i>"
    for name in ("select", "textarea", "title", "iframe", "template"):
        assert read(f"<article><p>a</p><div><{name}>gone</div><p>b</article>") == "a\nb", name
        assert read(f"<article><p>a</p><div><{name}>gone</{name}></div><p>b</article>") == "a\nb", name
    for name in ("noscript", "svg", "math"):
        assert read(f"<article><p>a</p><div><{name}>c</div><p>b</article>") == "a\nc\nb", name


def test_texts_are_compared_whole():
    line = "The same long dateline and disclaimer. " * 8
    pages = [f"<body><div class=x>{line}</div><div>{line}Then story {i}.</div><p>We <b>use</b> {line}</p>" for i in range(4)]
    for i, page in enumerate(pages):
        assert read(page, [p for p in pages if p != page]) == f"{line}Then story {i}."
    assert len(json.dumps(h.page_expression("<p>" + line * 50))) < 400


def read_all(pages):
    return [read(page, pages[:i] + pages[i + 1 :]) for i, page in enumerate(pages)]


def test_a_teaser_does_not_hide_the_article():
    page = "<body><main><h1>Title {0}</h1><p>First {0} paragraph</p><p>Second</p><p>Third</p><article class=card>Read next</article></main>"
    assert read(page.format(1)) == "Title 1\nFirst 1 paragraph\nSecond\nThird"
    assert read_all([page.format(i) for i in range(3)]) == [f"Title {i}\nFirst {i} paragraph\nSecond\nThird" for i in range(3)]
    # an article element with most of the text still wins, and several articles are read as they were
    assert read("<main><p>Intro</p><article><h1>T</h1><p>A long enough text of its own</p></article></main>") == "T\nA long enough text of its own"


def test_everyday_words_in_classes_of_the_article():
    page = '<article><h1>News {0}</h1><p class="share-price">Shares rose {0}</p><div class="comment-on-law">Opinion {0}</div>{1}</article>'
    aside = '<div class="share-bar"><a href=/f>F</a><a href=/t>T</a></div><div class="comments-list">First!</div><div class="ad-for-you">Buy {0}</div>'
    want = [f"News {i}\nShares rose {i}\nOpinion {i}" for i in range(4)]
    assert [read(page.format(i, aside.format(i))) for i in range(4)] == want
    assert read_all([page.format(i, aside.format(i)) for i in range(4)]) == want
    links = '<div class="related-to-this"><a href=/1>One {0}</a> <a href=/2>Two {0}</a></div>'
    assert read_all([page.format(i, links.format(i)) for i in range(4)]) == want
    # the same text on all pages is no text of the article where only an everyday word keeps it
    same = '<div class="notice-to-readers">Prices may change.</div>'
    assert read_all([page.format(i, same) for i in range(4)]) == want


def test_menus_in_neutral_classes():
    page = "<body><div class=x><a href=/>Home</a><a href=/s>Shop</a></div><div class=y><h1>T{0}</h1><p>Body {0}</p></div><div class=z>(c) Corp</div>"
    for n in (2, 3, 4):
        assert read_all([page.format(i) for i in range(n)]) == [f"T{i}\nBody {i}" for i in range(n)]
    inside = page.replace("<body>", "<body><main>").replace("<div class=z>", "</main><div class=z>")
    for n in (2, 4):
        assert read_all([inside.format(i) for i in range(n)]) == [f"T{i}\nBody {i}" for i in range(n)]
    assert read(inside.format(1)) == "HomeShop\nT1\nBody 1"  # one page tells nothing of a menu


def test_pages_that_say_the_same():
    assert read_all(["<body><h1>T</h1><p>Body"] * 4) == ["T\nBody"] * 4  # one page at several addresses
    assert read_all([f"<body><div class=a><h1>Title {i}</h1><p>Body</p></div>" for i in range(4)]) == [f"Title {i}\nBody" for i in range(4)]
    lists = [f"<body><h1>Soup {i}</h1><ul><li>Salt<li>Salt<li>Salt</ul><p>Stir {i}" for i in range(4)]
    assert read_all(lists) == [f"Soup {i}\nSalt\nSalt\nSalt\nStir {i}" for i in range(4)]


def test_the_wrapper_decides_against_the_words():
    """A block that the word lists call the article is a menu, and one that they call aside is text."""
    page = '<body><main class=content><div class="post-content"><a href=/>All</a><a href=/n>New</a></div><h1>T {0}</h1><p class="alert-level">Level {0}</p></main>'
    assert read_all([page.format(i) for i in range(5)]) == [f"T {i}\nLevel {i}" for i in range(5)]


def test_ids_that_differ_by_page():
    def letters(i):
        return "".join(chr(97 + int(d)) for d in str(i))

    def page(i):
        return (
            f"<body><nav>Menu</nav><article id=post-{letters(i)}><h1 id=t-{letters(i)}>T {i}</h1>"
            f"<section class='s {letters(i)}x'><h2 id=how-to-{letters(i)}>How {i}</h2><p>P {i}</p></section>"
            f"<div class=ad id=ad-{letters(i)}>Buy</div></article><div id=foot-{letters(i)}>Corp</div>"
        )

    def wrapper(n):
        out = h.page_expression(page(0))
        for i in range(1, n):
            out = h.aligned(out, h.page_expression(page(i)))
        return out

    few, many = wrapper(500), wrapper(2000)
    assert len(json.dumps(many)) < 1.2 * len(json.dumps(few)) < 200_000
    reader = h.Reader(h.article_places(many))
    for i in (0, 7, 1999, 5000):
        assert reader.text(page(i)) == f"T {i}\nHow {i}\nP {i}"


def test_long_levels_do_not_depend_on_tasks(spark):
    pages = [(i, "http://a.b/", f"<body><article id=p-{'ab'[i % 2] * i}><h1>T {i}</h1><p>Own {i}</p></article><p>Foot") for i in range(300)]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    want = {i: f"T {i}\nOwn {i}" for i in range(300)}
    for n in (1, 7):
        assert {r.page_id: r.main_text for r in h.extract_main_text(table.repartition(n)).collect()} == want
