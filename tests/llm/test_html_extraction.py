from __future__ import annotations

import html
import re

from stagegraph.llm import html_extraction as h

PAGE = """<html><head><title>T</title></head><body><div id="cookie-notice">We use cookies, ok, yes.</div><header><h1>Site</h1></header>
<div class="menu"><ul><li><a href=x>Home</a><li><a>About</a></ul></div><div id=wrap><main><h1>The title</h1><div class="content">
<p>First paragraph, with some text, and commas &amp; more. It is long enough to count for something in scoring.<p>Second paragraph it's <b>bold</b>
 and <a href="x">linked</a>, fine.</p><ul><li>one item here</li><li>two item</li></ul><aside>side note</aside><form><input><label>Mail</label></form></div>
<div class="comments"><p>I disagree, really, I do, with everything.</p></div></main><div class="sidebar"><p>Popular, stuff, links</p></div></div>
<footer>(c)</footer><script>if (a<b) { x("<p>no</p>") }</script></body></html>"""


def test_article_without_furniture():
    assert h.main_text(PAGE).split("\n") == [
        "The title", "First paragraph, with some text, and commas & more. It is long enough to count for something in scoring.", "Second paragraph it's bold and linked, fine.", "one item here", "two item",
    ]


def test_odd_markup():
    assert [h.main_text(x) for x in ("", None, "plain text", "<p>a", "<div>a<div>b</div></div>", "<p>a&nbsp;&#233; &am", "<!-- x", "<script>x", "<p")] == ["", "", "plain text", "a", "a\nb", "a é &am", "", "", ""]
    assert h.main_text("<div>" * 5000 + "<p>deep text, here</p>") == "deep text, here"
    assert len(h.main_text("<article><p>" + "long text, " * 200_000 + "</p></article>")) > 2_000_000


def expected(page):
    body = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.DOTALL)
    marked = re.sub(r"<[^>]*(>|\Z)", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1|h2|ul|li|div|blockquote)>", "\x00", body[1]))) if body else ""
    return "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in marked.split("\x00")) if x)


def test_every_page_of_the_table(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = h.op3_html_extraction(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, expected(pages[r.page_id].html), len(r.text))


def test_odd_rows(spark):
    rows = [(None, None, None, "x"), (1, "u", "", "x"), (2, "u", PAGE, "x"), (2, "u", PAGE, "x")]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted(r.n_chars for r in got.collect())[:2] == [0, 0] and got.count() == 4
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


BODY = [f"Paragraph number {i} of the article, with a comma, and enough words to count as running text." for i in range(6)]
ARTICLE = "".join(f"<p>{x}</p>" for x in BODY)


def test_wrappers_that_are_named_like_furniture():
    for name in ("content has-sidebar", "no-sidebar", "with-sidebar", "sidebar-right layout", "side-by-side", "hidden-print", "article-share", "post comments-open", "col social", "sidebar", "menu-open", "search-results", "header-fixed wrap"):
        page = f'<body><nav><a href=x>Home</a></nav><div class="cookie-banner"><p>We use cookies, and more.</p></div><div class="{name}">{ARTICLE}<div class="share">Share this, now.</div></div><footer>c</footer></body>'
        assert h.main_text(page).split("\n") == BODY, name
    assert h.main_text(f'<body><form method=post action=x><input type=hidden name=state value=1><div>{ARTICLE}</div><label>Mail</label><input></form></body>').split("\n") == BODY
    assert h.main_text(f'<body><div class="content">{ARTICLE}</div><form><p>Subscribe to our letter, it is free.</p><input></form></body>').split("\n") == BODY


def test_furniture_beside_an_article_goes():
    long = "".join(f"<p>I disagree with all of this, number {i}, and write a long reply to say so at length.</p>" for i in range(30))
    for name in ("comments", "comment-list", "sidebar", "related-posts", "ads"):
        short = "".join(f"<p>{x}</p>" for x in BODY[:3]) if name in ("comment-list", "related-posts") else f"<p>{BODY[0]}</p><p>{BODY[1]}</p><p>{BODY[2]}</p>"
        some = long if name in ("comments", "sidebar", "ads") else long[: len(long) // 40]
        assert h.main_text(f'<body><div id="post">{short}</div><section class="{name}">{some}</section></body>').split("\n") == BODY[:3], name
    assert h.main_text('<body><nav>x</nav><div class="ad">Buy this, now, it is good.</div><footer>f</footer></body>') == ""


def test_quotes_that_do_not_balance():
    assert h.main_text("<body><p class=it's>First paragraph, of two.</p><p>Second don't you think, of two.</p></body>").split("\n") == ["First paragraph, of two.", "Second don't you think, of two."]
    assert h.main_text('<body><p class="a>First paragraph, of two.</p><p>Second, of two.</p></body>').split("\n") == ["First paragraph, of two.", "Second, of two."]
    assert h.main_text("<body><p title='a > b' data-x=\"it's\">One, two.</p><p a=b'c\">Three, four.</p></body>").split("\n") == ["One, two.", "Three, four."]


def test_split_sections_and_short_blocks():
    two, one = "".join(f"<p>{x}</p>" for x in BODY[:2]), f"<p>{BODY[2]}</p>"
    assert h.main_text(f"<article><section>{two}</section><section>{one}</section></article>").split("\n") == BODY[:3]
    assert h.main_text(f"<body><div id=a><section>{two}</section><section>{one}</section></div></body>").split("\n") == BODY[:3]
    assert h.main_text(f"<body><div><p>A short lead.</p></div><div>{ARTICLE}</div><div><p>A short end.</p></div></body>").split("\n") == ["A short lead.", *BODY, "A short end."]
    assert h.main_text(f"<body><p class=ad>Buy<p>{BODY[0]}<p>{BODY[1]}</body>").split("\n") == BODY[:2]


def test_lists_of_links_inside_an_article_stay_but_menus_at_its_ends_go():
    links = "<ul><li><a href=a>See the first source on this</a></li><li><a href=b>See the second source on this</a></li></ul>"
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>"
    sources = ["See the first source on this", "See the second source on this"]
    assert h.main_text(f"<article>{menu}<p>{BODY[0]}</p>{links}<p>{BODY[1]}</p>{menu}</article>").split("\n") == [BODY[0], *sources, BODY[1]]
    assert h.main_text(f"<article><p>{BODY[0]}</p><p>{BODY[1]}</p>{links}</article>").split("\n") == [*BODY[:2], *sources]
    assert h.main_text(f"<body><div>{menu}{ARTICLE}</div></body>").split("\n") == BODY


def test_inline_ends_do_not_close_blocks():
    assert h.main_text(f"<article><i><div><p>{BODY[0]}</p></i><p>{BODY[1]}</p></div><p>{BODY[2]}</p></article>").split("\n") == BODY[:3]
