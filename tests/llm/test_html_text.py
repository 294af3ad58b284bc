import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import functions as F

from cvframe.llm import html_text
from cvframe.llm.html_text import main_text, regions

LONG = "long enough to be an article paragraph, with words in it that go on for a while " * 2


def text(page):
    return main_text(page)[0]


def test_article_without_furniture():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>"</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav><div class="ad box">Buy</div>
    <article><h1>Head &amp; line</h1><p>{LONG}</p><aside>Aside</aside><p>x</p><p><b>Bold.<br><p>a&nbsp;&nbsp;b \n c</p>
    <form><label>Mail</label><input name=q></form><section id="comments"><p>First! {LONG}</p></section></article>
    <div id="sidebar">{LONG}</div><div class="cookie-notice">{LONG}</div><footer>&copy; me</footer></body></html>"""
    assert text(page).split("\n") == ["Head & line", " ".join(LONG.split()), "x", "Bold.", "a b c"]


def test_page_without_article_element():
    page = f"<body><div class=menu><a href=a>A</a> <a href=b>B</a></div><div>{LONG}<p>short</p>{LONG}</div><ul>" + \
        "<li><a href=x>link</a></li>" * 9 + "</ul><div>tail</div></body>"
    assert text(page) == "\n".join([" ".join(LONG.split()), "short", " ".join(LONG.split())])
    assert text("<p>only a word</p>") == "only a word"


def test_cut_pages_and_odd_markup():
    assert text("<article><p>kept</p><p>also kept <a href=\"ht") == "kept\nalso kept"
    assert text("<article><p>kept</p><script>var x = '<p>no") == "kept"
    assert text("<article><p>kept<!-- never closed <p>no") == "kept"
    assert text("<article><p>a < b &lt;i&gt; &#233; &bogus; &amp;lt;</p></article>") == "a < b <i> é &bogus; &lt;"
    assert text("<article title='a > b'><p>x</p></article>") == "x"
    assert text("<div class=ad>never closed <article><p>x</p></article>") == "x"
    assert text("<ARTICLE><P>x<P hidden>y</P></ARTICLE>") == "x"


def test_empty():
    for page in (None, "", "   ", "<html></html>", "<script>x</script>", "<nav>menu</nav>"):
        assert text(page) == ""


def test_regions():
    w = np.array([0, 0, 5, 0, 90, 3, 0, 0, 0, 0, 7, 0], float)
    assert regions(w, 80) == [(2, 6)] and regions(w, 1) == [(2, 6), (10, 11)] and regions(w, 1000) == []


def test_long_page_is_read_whole():
    body = "".join(f"<p>p{i}</p>" for i in range(30_000))
    assert text(f"<article>{body}</article>").split("\n") == [f"p{i}" for i in range(30_000)]


def test_column(spark):
    rows = [(1, "u", "<article><p>a  b</p></article>"), (1, "u", "<article><p>a  b</p></article>"), (2, None, None), (None, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("taken"))
    got = df.select("page_id", html_text.extract(F.col("html")).alias("m")).collect()
    assert sorted(((r["page_id"], r["m"]["text"]) for r in got), key=str) == [(1, "a b"), (1, "a b"), (2, ""), (None, "")]
    assert df.limit(0).select(html_text.extract(F.col("html"))).collect() == []


def test_linked_lines_of_an_article_stay():
    links = "".join(f"<li><a href=r{i}>Reference {i}</a></li>" for i in range(5))
    page = f"<article><h1><a href=x>Title</a></h1><p>{LONG}</p><ul>{links}</ul><p>end</p><p>Source: <a href=y>the agency's page</a></p></article>"
    assert text(page).split("\n") == ["Title", " ".join(LONG.split()), *[f"Reference {i}" for i in range(5)], "end",
                                      "Source: the agency's page"]


def test_links_end():
    assert text(f"<body><a name=top><p>{LONG}</p><p>more</p></body>") == " ".join(LONG.split()) + "\nmore"
    assert text(f"<body><p><a href=x>go</p><p>{LONG}</p></body>").endswith(" ".join(LONG.split()))
    assert text(f"<body><p><a href=x>go<p>{LONG}<p>more</body>").endswith(" ".join(LONG.split()) + "\nmore")
    lines = html_text.lines_of("<a href=x><div><h3>Card</h3><p>teaser</p></div></a><p>free")
    assert [(x.text, x.linked > 0) for x in lines] == [("Card", True), ("teaser", True), ("free", False)]


def test_later_parts_count_whatever_the_longest_paragraph():
    part, long = " ".join(LONG.split()), " ".join((LONG * 40).split())
    box = "<div class=ad><p>Buy</p><p>this</p><p>now</p><p>!</p></div>"
    assert text(f"<body><p>{long}</p>{box}<p>{part}</p>{box}<p>short</p></body>").split("\n") == [long, part, "short"]


def test_an_article_with_little_of_the_text_does_not_hide_the_rest():
    part = " ".join((LONG * 3).split())
    page = f"<body><p>{part}</p><article><a href=t>Teaser</a></article><p>{part}</p></body>"
    assert text(page).split("\n") == [part, "Teaser", part]


def test_titles_in_an_article_are_no_hints():
    page = ("<article><h2 id=related-work>Related work</h2><section id=\"search-for-water\"><p>found</p></section>"
            "<div class='social-history'><p>kept</p></div><div class='share-buttons'>Tweet</div><div class='box ad'>Buy</div>"
            "<p aria-label='a social notice'>spoken</p><div id=related-posts><a href=x>Other</a></div></article>")
    assert text(page) == "Related work\nfound\nkept\nspoken"


def test_a_long_block_in_an_article_overrides_its_hint():
    body = " ".join((LONG * 3).split())
    page = f"<article><p>a</p><div class=notice><p>{body}</p><nav>menu</nav><div class=ad>Buy {body}</div><p>b</p></div><div class=comments>{body}</div></article>"
    assert text(page) == f"a\n{body}\nb"
    assert text(f"<article><p>a</p><div class=related><a href=x>{body}</a></div><div class=notice>short</div></article>") == "a"


PARTS = "A paragraph of some length that says a good deal about its matter and goes on for a while, as they do. " * 8


def test_wrappers_with_a_hint_in_their_name_keep_the_page():
    body = "".join(f"<p>{i} {PARTS}</p>" for i in range(3))
    want = "\n".join(f"{i} {PARTS}".strip() for i in range(3))
    for page in (f'<div class="layout has-sidebar">{body}</div>', f'<div id="page-form-wrapper">{body}</div>',
                 f'<form id="aspnetForm"><div class=menu><a href=x>a</a></div>{body}<footer>me</footer></form>'):
        assert text(f"<html><body>{page}</body></html>") == want
    assert text(f'<body><div class="section-header"><h2>Head</h2></div>{body}</body>') == "Head\n" + want
    # beside an article the same names stand for furniture
    assert text(f'<body><article>{body}</article><form id="form">Mail us</form></body>') == want


def test_windows_decide_what_no_name_tells():
    """No class, id or role: plain boxes beside an article go for want of a surge."""
    body = "".join(f"<p>{i} {PARTS}</p>" for i in range(3))
    want = "\n".join(f"{i} {PARTS}".strip() for i in range(3))
    page = f"<body><div>Buy this now, it is cheap.</div><article>{body}</article><div>All rights reserved, some time.</div></body>"
    assert text(page) == want
    assert text(page.replace("Buy this", "Buy " + PARTS)).startswith("Buy A paragraph")       # a surge of its own
    assert text(f"<body><nav><p>About our company</p></nav><article>{body}</article><footer>{PARTS[:200]}</footer></body>") == want


def test_without_windows_the_result_differs(monkeypatch):
    body = f"<p>{PARTS}</p>" * 3
    page = f"<body><div>Buy this now, it is cheap.</div><article>{body}</article><div>All rights reserved.</div></body>"
    with_windows = text(page)
    monkeypatch.setattr(html_text, "regions", lambda w, surge, window=3: [(0, len(w))])
    assert text(page) != with_windows


def _without_names(page):
    return re.sub(r"\s(?:class|id|role)=\"[^\"]*\"", "", page)


def test_whole_table_is_the_articles_of_its_pages(spark, sf_small):
    """Every page of the driver's table has its article between tags: brute
    force is what stands there, read by the standard library's parser."""
    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.blocks = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.blocks += [""] if tag in ("p", "h1", "article") else []
            self.blocks[-1] += " " if tag == "br" else ""

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.blocks += [""] if tag in ("p", "h1", "article") else []

        def handle_data(self, data):
            if self.depth:
                self.blocks[-1] += data

    pages = spark.read.parquet(f"{sf_small}/pages.parquet").select("html").collect()
    assert len(pages) > 20
    for (page,) in pages:
        parser = Article()
        parser.feed(page or "")
        want = "\n".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)
        assert text(page) == want and text(_without_names(page or "")) == want
