"""Main text of pages: given pages, and pages with every kind of frame."""

import html
import re

from jobloom.llm import html_text
from jobloom.llm.queries import op4_main_text


def test_query(spark):
    """The given pages mark their article: heading and paragraphs, in order."""
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op4_main_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        plain = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in parts]
        assert r.text == "\n\n".join(filter(None, plain)) and r.n_chars == len(r.text)


PARAS = [f"Paragraph {i} has a few words of its own, enough of them to stand out from menus &amp; frames." for i in range(4)]
WANT = "\n\n".join(["Heading", *[p.replace("&amp;", "&") for p in PARAS]])
FRAME = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site <a href=/>home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div id="cookie-notice"><p>We use cookies on this site and many more words about that than you want to read today.</p></div>%s
<aside><p>A sidebar with a long text about other matters that nobody needs here at all, truly.</p></aside><form><label>Mail</label><input><button>Go</button></form>
<section class="comments"><h3>2 comments</h3><div class="comment"><p>First! This is a long comment by a reader who has much to say on this.</p></div></section>
<footer>&copy; Someone &middot; all about us and our terms of use and more</footer><script>var t = "</p>";</script></body></html>"""


def test_frames():
    body = "<h1>Heading</h1>" + "".join(f"<p>{p}</p>" for p in PARAS)
    for inner in (f"<article>{body}</article>", f"<main><div>{body}</div></main>", f"<div class='content'>{body}</div>", body, body.replace("</p>", ""), f"<article><header><h1>Heading</h1></header>{body[16:]}<div class=ad>Buy</div></article>"):
        assert "\n\n".join(html_text.blocks(FRAME % inner)) == WANT, inner
    assert html_text.blocks("<article><p>a<br>b\n  <b>c</b><!-- no --> &lt;d&gt;<p> e") == ["a b c <d>", "e"]
    assert html_text.blocks("plain &amp; simple") == ["plain & simple"]


def test_edge_cases(spark):
    long = "<article>" + "<p>word &eacute; more</p>" * 30_000
    htmls = [None, "", "<nav>only a menu</nav>", "<<<>>", "<p", "<!-- never closed", long, "<div>" * 3000 + "deep words" + "</div>" * 3000]
    pages = spark.createDataFrame([(i, f"u{i}", h, 7) for i, h in enumerate(htmls)], "page_id long, url string, html string, n_chars int")
    rows = {r.page_id: r for r in html_text.main_text(pages).collect()}
    assert [rows[i].text for i in (0, 1, 2, 7)] == ["", "", "", "deep words"] and rows[0].n_chars == 7
    assert rows[6].text == "\n\n".join(["word é more"] * 30_000)
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_omitted_end_tags_and_modifiers():
    body = "<h1>Heading</h1>" + "".join(f"<p>{p}</p>" for p in PARAS)
    rows = {"table": "<tr><td>cell<td>cell", "dl": "<dt>term<dd>what it is", "ul": "<li>entry <b>bold"}
    for tag, row in rows.items():
        many = f"<{tag}>" + row * 300 + f"</{tag}>"
        for page in (f"<aside>{many}</aside><article>{body}</article>", f"<article>{body}</article><aside>{many}</aside>"):
            assert "\n\n".join(html_text.blocks(f"<html><body>{page}</body></html>")) == WANT, tag
        inside = html_text.blocks(f"<article>{body}{many}</article><p>Not part of the article.")
        assert len(inside) > 300 and inside[-1] != "Not part of the article."
    deep = "<aside>" + "<i>" * 500 + "menu</aside>" + f"<article>{body}</article>"
    assert "\n\n".join(html_text.blocks(deep)) == WANT
    for name in ("has-sidebar", "no-sidebar", "layout with-nav", "hasSidebar"):
        assert "\n\n".join(html_text.blocks(f'<div class="{name}">{body}</div>')) == WANT, name


def test_open_head():
    body = "<h1>Heading</h1>" + "".join(f"<p>{p}</p>" for p in PARAS)
    for head in ("<head><title>T</title>", "<head><meta charset=utf-8><script>var a;</script>", "<head/>", ""):
        for start in ("<body>", ""):
            assert "\n\n".join(html_text.blocks(f"<html>{head}{start}<article>{body}</article></body></html>")) == WANT, head + start
    assert html_text.blocks("<head><noscript><p>Switch scripts on, please</p></noscript></head><body><p>words") == ["words"]


def test_marked_wrappers():
    """A wrapper whose name sounds like a frame keeps its article; frames inside or beside it stay frames."""
    body = "<h1>Heading</h1>" + "".join(f"<p>{p}</p>" for p in PARAS)
    frames = '<div class="sidebar"><p>A sidebar with a long text about other matters that nobody needs here.</p></div><div class="related-posts"><ul>' + '<li><a href="/x">Another story of the day</a>' * 20 + '</ul></div><div class="comments"><h3>Comments</h3><p>I have read all of this and I did not like a single word of what you say there.</p></div>'
    for name in ('class="container sidebar-right"', 'id="content-with-sidebar"', 'class="elementor-widget-container"', 'class="menu-open"', 'class="topic-social-science"', 'class="comments-open"'):
        for inner in (body, f"<article>{body}</article>", f"<div class='widget'>{body}</div>"):
            for page in (f"<div {name}>{inner}</div>", f"<div {name}>{inner}{frames}</div>", f"<div {name}>{inner}</div>{frames}"):
                if "comments-open" in name and page.endswith(frames):
                    continue  # beside so much other text a name that tells of comments stands
                assert "\n\n".join(html_text.blocks(f"<body>{page}</body>")) == WANT, page
    assert "\n\n".join(html_text.blocks(f'<article class="post share-on">{body}</article>{frames}')) == WANT


def test_long_comments_stay_out():
    said = "<p>This is a long comment by a reader who has much to say on this matter of ours.</p>"
    for tag in ("div", "section", "article"):
        page = f"<h1>Heading</h1><p>{PARAS[0]}</p><div class='comments'>" + f"<{tag} class='comment'>{said}</{tag}>" * 30 + "</div>"
        assert html_text.blocks(page) == ["Heading", PARAS[0].replace("&amp;", "&")], tag
    short = "<p>Short article.</p><div id='cookie-notice'>" + said + "</div>"
    assert html_text.blocks(f"<article>{short}</article>") == ["Short article."]
    for by in ("", "<p>By A. Writer</p>"):
        body = "".join(f"<p>{p}</p>" for p in PARAS)
        got = html_text.blocks(f"<article><h1>Heading</h1>{by}<div class='elementor-widget'>{body}</div></article>")
        assert "\n\n".join(x for x in got if x != "By A. Writer") == WANT
