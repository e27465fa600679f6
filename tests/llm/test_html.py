import html
import re
import time

import pytest

from twinweave.llm import html_text as H

BODY = "<p>First paragraph, with some words, and more of them than a menu has.</p><p>Second &amp; last one,\n  with&nbsp;space.</p>"
WANT = "First paragraph, with some words, and more of them than a menu has.\nSecond & last one, with space."
NOISE = (
    "<nav><ul><li><a href='/a'>Menu one</a></li><li><a href='/b'>Menu two</a></li></ul></nav>"
    "<div class='ad'>Buy this, buy that, buy it all, now, here, today, for you.</div>"
    "<div class='cookie-notice'>We use cookies, many of them, and more.</div>"
)


@pytest.mark.parametrize("box", ["article", "main", "div", "section"])
def test_article_is_found(box):
    page = f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{NOISE}<{box}>{BODY}</{box}><aside>Side, bar, text.</aside><footer>&copy; foot</footer></body></html>"
    assert H.main_text(page) == WANT


def test_comments_forms_and_hidden_parts_go():
    page = (
        f"<body class='has-sidebar'><header>Site</header><article>{BODY}<form>Send <input></form><p hidden>no</p></article>"
        "<section id='comments'><article class='comment'><p>A reader, who says much, and more, and even more than that.</p></article></section></body>"
    )
    assert H.main_text(page) == WANT


def test_broken_markup():
    page = "<body><article><h1>Title &am</h1><p><b>One text.<br><p>Two <i>text</i>.</article><footer>f</footer>"
    assert H.main_text(page) == "Title &am\nOne text.\nTwo text."
    assert H.main_text("") == "" and H.main_text("<") == "<" and H.main_text("just text") == "just text"
    assert H.main_text("<p>cut <a href='x") != "x"


def test_lists_and_tables_keep_their_items():
    page = "<article><p>Intro, which is long enough to count for something here.</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>"
    assert H.main_text(page).split("\n")[1:] == ["one", "two", "a", "b"]


def test_nothing_of_the_article_is_dropped_by_a_likely_name():
    parts = [
        "<div class='entry-header'><h1>Headline of it</h1></div>", "<p class='ad-hoc'>Ad hoc text.</p>", "<p class='text-alert'>Alert text.</p>",
        "<div class='social-history'>History text.</div>", "<p class='share'>Share text.</p>",
        "<ul><li><a href='1'>one</a></li><li><a href='2'>two</a></li><li><a href='3'>three</a></li></ul>", "<div>ten chars.</div>",
    ]
    texts = ["Headline of it", "Ad hoc text.", "Alert text.", "History text.", "Share text.", "one", "two", "three", "ten chars."]
    assert H.main_text(f"<body>{NOISE}<article>{parts[0]}{BODY}{''.join(parts[1:])}</article></body>").split("\n") == [texts[0], *WANT.split("\n"), *texts[1:]]
    page = f"<body>{NOISE}<div class='page'>{parts[0]}<div class='entry-content'>{BODY}</div>{parts[6]}</div><div class='site-footer'>foot</div></body>"
    assert H.main_text(page) == f"{texts[0]}\n{WANT}\n{texts[8]}"


@pytest.mark.parametrize("name", ["ad", "ads-box", "sponsored-links", "share-buttons", "post-comments", "related-posts", "site-header", "cookie-notice", "newsletterSignup", "main-nav", "sidebar"])
def test_names_of_other_parts(name):
    page = f"<body><div class='{name}'>Some words, that are no article, but many, many.</div><article>{BODY}<div id='{name}'>Some words, that are no article.</div></article></body>"
    assert H.main_text(page) == WANT


def test_time_grows_with_the_page_only():
    def took(make):
        began = time.perf_counter()
        H.main_text(make)
        return time.perf_counter() - began

    for make in (lambda n: "<div>word " * n, lambda n: "<ul><li>a" * n, lambda n: "<div>" * n + "</section>" * n, lambda n: "<b>" * n + "<p>x" * n, lambda n: "<div class='ad'>" * n + "<main>x", lambda n: "<b><div>" + "<i>" * n + "</b>" * n, lambda n: "<div>" + "<ul><li><a href=x>y</a></ul>" * n):
        small = min(took(make(1000)) for _ in range(3))
        assert took(make(8000)) < 8 * 4 * small + 0.2


def test_names_within_the_article():
    """Inside an article a word or a paragraph stays whatever it is called; readers' posts in containers go."""
    page = """<body><article><h1>T</h1><pre>x = 1 <span class="comment"># explain</span> y</pre><blockquote class="comment">quoted, twice</blockquote>
      <p class="reply">answered</p><p id="comments">noted</p><div class="comments"><p>first!</p></div><ul class="comment-list"><li>me too</ul></article></body>"""
    assert H.main_text(page) == "T\nx = 1 # explain y\nquoted, twice\nanswered\nnoted"


def test_end_tags_behind_a_block():
    assert H.main_text("<p>a <b>b<p>c</b> d</p>") == "a b\nc d"
    root = H.parse("<b><div><i>x</b>y</i>z</div>w</b>v")
    assert [x if isinstance(x, str) else x.tag for x in root.children] == ["b", "v"]


def plain_article(page):
    """The article of a page as the table's pages have it: an advert, then one article element."""
    own = page[page.index("<article>") + 9 : page.index("</article>")]
    own = re.sub(r"(?is)<(script|style)\b.*?</\1>", "", own)
    marked = re.sub(r"(?i)</?(?:p|h[1-6]|ul|ol|li|div|table|tr|td|th|blockquote|pre|section)\b[^>]*>", "\0", re.sub(r"(?i)<br\b[^>]*>", " ", own))
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in marked.split("\0"))
    return "\n".join(x for x in blocks if x)


def test_texts_of_the_table_s_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    known = [p.html for p in pages if p.html and p.html.count("<article>") == 1 and "</article>" in p.html]
    assert len(known) > len(pages) // 2
    for page in known:
        assert H.main_text(page) == plain_article(page)


def test_query(spark, sf):
    rows = H.query(spark, sf).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == H.main_text(pages[r.page_id] or "") and r.n_chars == len(r.text)
        assert "track(" not in r.text and "©" not in r.text


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, None, None, "c"), (None, "u", "<p>x y z", "c"), (2, "u", "<div>" * 3000 + "deep", "c"), (2, "u", "<div>" * 3000 + "deep", "c")]
    got = H.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.text for r in got), key=str) == ["", "deep", "deep", "x y z"]
    assert H.extract(spark.createDataFrame([], schema)).count() == 0
