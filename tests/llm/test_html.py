"""Main text of pages: host consensus, what is left out, and odd markup."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from inkmill.llm import html_extract
from tests.llm.data import rows

PAGES = "page_id long, url string, html string"
CHROME = '<nav><a href="/">Home page of all things</a></nav><header class="top"><h2>Site name and slogan</h2></header><div class="cookie-notice">We use cookies, many of them, all the time.</div>'
TAIL = '<aside>Read this too, it is great</aside><div id="comments"><p>First comment, rather long and loud, with many many words in it, more than the article.</p></div><footer>Imprint and so on</footer>'


def page(body, cls="post"):
    return f"<!DOCTYPE html><html><head><title>t</title><script>var a = '<p>no</p>';</script><style>p{{}}</style></head><body>{CHROME}<div class='{cls}'>{body}</div>{TAIL}</body></html>"


def extract(spark, pages):
    return [r["text"] for r in sorted(rows(html_extract.extract(spark.createDataFrame(pages, PAGES))), key=lambda r: r["page_id"])]


def test_main_text(spark):
    texts = extract(spark, [(1, "http://a.example/1", page("<h1>Title&amp;</h1><p>One  two\n<b>three</b>&nbsp;four<p>Five<br>six<ul><li>x<li>y</ul><form><p>mail</p></form>"))])
    assert texts == ["Title&\nOne two three four\nFive six\nx\ny"]


def test_consensus_decides_a_doubtful_page(spark):
    rich = [(i, "http://b.example/x", page("<p>" + f"sentence number {i} of the text. " * 10 + "</p>", f"post post-{i}")) for i in range(8)]
    doubtful = page("<p>Short.</p>").replace("<aside>", '<div class="teasers"><p>' + "a long teaser text without any mark. " * 20 + "</p></div><aside>")
    got = extract(spark, [*rich, (9, "http://www.b.example/y", doubtful), (10, "http://c.example/", doubtful)])
    assert got[8] == "Short." and got[9].startswith("a long teaser")


def test_odd_pages(spark):
    got = extract(spark, [(1, None, None), (2, "x", ""), (3, "http://d/", "just text & more &lt;b&gt;"), (4, "http://e/", "<p>cut off <b>in the mid"), (5, "http://f/", "<div><p>a</div>b<table><tr><td>c<td>d</table>" + "<div>" * 3000 + "deep " * 20), (6, "http://g/", "<p>1 < 2 and <3</p><script>never closed <p>x"), (7, "http://h/", "<p>" + "word " * 100_000)])
    assert got[:4] == ["", "", "just text & more <b>", "cut off in the mid"]
    assert got[4] == " ".join(["deep"] * 20)
    assert got[5] == "1 < 2 and <3" and len(got[6]) == 499_999


def test_repeated_rows_clashing_columns_and_joined_hosts(spark):
    pages = spark.createDataFrame([(1, "http://a/", page("<p>text here</p>"))] * 2, PAGES).withColumn("text", F.lit("clash")).withColumn("winner", F.lit(0))
    for limit in (50_000, 0):
        assert [(r["text"], r["n_chars"]) for r in rows(html_extract.extract(pages, share_hosts=limit))] == [("text here", 9)] * 2
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_class_hints_on_wrappers_lose_nothing(spark):
    body = "<h1>Title</h1><p>The only paragraph of the article, and no short one.</p>"
    whole = "Title\nThe only paragraph of the article, and no short one."
    names = ["no-sidebar", "right-sidebar", "has-header", "comments-open", "elementor-widget", "with-left-sidebar", "modal-open"]
    wrapped = [f"<body><nav>Menu</nav><div class='{n}'>{body}<div class='sidebar'>Beside it</div></div><div class='footer'>Imprint</div></body>" for n in names]
    wrapped.append(f"<body><div class='footer'>Imprint</div><article class='commentary'>{body}</article><article class='comment'>I agree.</article></body>")
    wrapped.append(f"<body><div class='widget'><article>{body}</article></div><div class='footer'>Imprint</div></body>")
    wrapped.append(f"<body><div class='banner'>{body}</div></body>")  # all there is
    assert extract(spark, [(i, f"http://h{i}.example/", w) for i, w in enumerate(wrapped)]) == [whole] * len(wrapped)


def test_class_hints_still_leave_out_asides(spark):
    noise = "<div id='comments'>" + "<p>A comment that is far longer than what it is about.</p>" * 9 + "</div><div class='left-sidebar'>Beside it</div><div class='cookie-notice'>We use cookies, lots and lots and lots of them.</div>"
    assert extract(spark, [(1, "http://i.example/", f"<body><div><p>Short text.</p>{noise}</div></body>")]) == ["Short text."]


@pytest.mark.parametrize("body,want", [
    ("<article><header><h1>Head</h1></header><p>Text one.</p></article>", "Head\nText one."),
    ("<article><div class='article-header'><h1>Head</h1></div><p>Text one.</p></article>", "Head\nText one."),
    ("<article><h1>Head</h1><div class='market-share'><p>It has a third.</p></div><section class='related-work'><p>Others did.</p></section><p class='commentary'>We think.</p></article>", "Head\nIt has a third.\nOthers did.\nWe think."),
    ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, <label>named</label> <svg><text>drawn</text></svg> <object>shown</object>.</p></article>", "So x=1, named drawn shown."),
    ("<nav>" + "<i>" * 399 + "Menu</nav><article><p>Text one.</p></article>", "Text one."),
    ("<nav>" + "<i>" * 5000 + "Menu</nav><article><p>Text one.</p></article>", "Text one."),
    ("<table><tr><td>" + "<b>" * 1000 + "a<td>b<tr><td>c</table>", "a\nb\nc"),
])
def test_all_of_the_article_stays(spark, body, want):
    html = f"<body><nav>Menu</nav>{body}<footer>Imprint</footer></body>"
    assert extract(spark, [(1, "http://a.example/", html)]) == [want]


def test_parts_side_by_side_all_win(spark):
    part = lambda n, words: f"<div class='part-{n}'><p>" + f"part {n} says something. " * words + "</p></div>"
    html = "<body><nav>Menu</nav><div id='all'>" + part("one", 40) + part("two", 12) + "<div class='tag-line'><p>Bits.</p></div></div></body>"
    got = extract(spark, [(i, "http://b.example/", html) for i in range(3)])
    assert all("part one" in t and "part two" in t for t in got)


P = "The paragraph says what there is to say, and then some more of it. " * 3
LAYOUTS = {
    "title beside the body": ("<main><h1>Title</h1><div class='body'><p>{p}</p><p>Two.</p></div></main>", ["Title", "{p}", "Two."]),
    "title, lead and content": ("<article><h1>Title</h1><p class='lead'>Lead.</p><div class='entry-content'><p>{p}</p><p>Two.</p></div></article>", ["Title", "Lead.", "{p}", "Two."]),
    "figure and closing line": ("<article><h1>Title</h1><figure><img src='x'><figcaption>Caption.</figcaption></figure><div class='text'><p>{p}</p></div><p>Closing.</p></article>", ["Title", "Caption.", "{p}", "Closing."]),
    "long quotation": ("<div class='post'><p>Intro.</p><blockquote><p>{p}</p><p>{p}</p></blockquote><p>Closing.</p></div>", ["Intro.", "{p}", "{p}", "Closing."]),
    "long cell": ("<div class='post'><p>Intro.</p><table><tr><td>{p}</td><td>x</td></tr></table><p>Closing.</p></div>", ["Intro.", "{p}", "x", "Closing."]),
    "long item": ("<div class='post'><p>Intro.</p><ul><li>{p}</li><li>y</li></ul><p>Closing.</p></div>", ["Intro.", "{p}", "y", "Closing."]),
    "short section": ("<div class='page'><section><h1>Title</h1><p>{p}</p></section><section class='short'><p>Short.</p></section></div>", ["Title", "{p}", "Short."]),
    "nested wrappers": ("<article><h1>Title</h1><div class='wrap'><div class='entry'><p>{p}</p></div></div></article>", ["Title", "{p}"]),
    "title outside the article": ("<main><h1>Title</h1><article><p>{p}</p></article><div class='more'><p>Another text that stands beside it.</p></div></main>", ["Title", "{p}"]),
    "title in the body": ("<h1>Title</h1><div class='content'><p>{p}</p></div>", ["Title", "{p}"]),
}


def laid_out(name, i=0):
    body, want = LAYOUTS[name]
    p = " ".join((P + f"Page {i}.").split())
    chrome = "<nav><a href='/'>Home</a></nav><div class='ad'>Buy this.</div>"
    return f"<html><body>{chrome}{body.format(p=p)}<aside>Beside it</aside><footer>Imprint</footer></body></html>", "\n".join(want).format(p=p)


@pytest.mark.parametrize("n", [1, 3])
def test_whole_articles_in_real_layouts(spark, n):
    pages = [(f"http://l{h}.example/{i}", *laid_out(name, i)) for h, name in enumerate(LAYOUTS) for i in range(n)]
    got = extract(spark, [(i, url, html) for i, (url, html, _) in enumerate(pages)])
    assert dict(zip(((u, w) for u, _, w in pages), got)) == {(u, w): w for u, _, w in pages}


def test_one_host_with_mixed_layouts(spark):
    """Pages that lack the host's path, or add to it, are whole too.  (The host's element is main, so a page with
    an article and another text in its main would keep both.)"""
    names = ["title beside the body"] * 4 + [n for n in LAYOUTS if n != "title outside the article"]
    pages = [laid_out(name, i) for i, name in enumerate(names)]
    assert extract(spark, [(i, "http://mixed.example/", html) for i, (html, _) in enumerate(pages)]) == [want for _, want in pages]


def test_what_stands_around_an_article_stays_out(spark):
    html = "<body><div id='page'><div class='logo'>My site</div><div class='post'><h1>Title</h1><p>" + P + "</p></div><ul><li><a href='/1'>One linked thing</a></li><li><a href='/2'>Another linked thing</a></li></ul></div></body>"
    assert extract(spark, [(i, "http://o.example/", html) for i in range(3)]) == ["Title\n" + " ".join(P.split())] * 3


class Plain(HTMLParser):
    """A second version for pages of one article: its blocks, by the library's parser."""

    def __init__(self, source):
        super().__init__()
        self.within, self.blocks, self.now = False, [], ""
        self.feed(source)

    def flush(self):
        if text := " ".join(self.now.split()):
            self.blocks.append(text)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.within = True
        if tag in ("p", "h1"):
            self.flush()
        if tag == "br":
            self.now += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.flush()
        if tag == "article":
            self.within = False

    def handle_data(self, data):
        if self.within:
            self.now += data


def test_supplied_pages_equal_a_second_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r["page_id"]: "\n".join(Plain(r["html"]).blocks) for r in rows(pages)}
    got = {r["page_id"]: r["text"] for r in rows(html_extract.extract(pages))}
    assert got == want
