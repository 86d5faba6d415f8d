"""Main text of pages: markup cases by hand, and the articles of the given pages."""

import html
import re

import pandas as pd

from ferrybook.llm import html_extraction
from ferrybook.llm.html_extraction import extract_main_text, main_text, second_pass

LONG = "This is the first sentence of a story that is long enough to stand on its own, as it has many words."


def test_surroundings_go_and_the_article_stays():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice">{LONG}</div><!-- <p>{LONG}</p> -->
    <article><header><h2>A &lt;title&gt;</h2></header><p>{LONG}<br>And   more&nbsp;of it.<p>Short.
    <div class="ad">Buy</div><form>Name <input></form><ul><li>One<li>T<b>w</b>o</ul>
    <section id=comments><p>{LONG}</p></section></article>
    <aside><p>{LONG}</p></aside><footer>Foot</footer><script>var a = "<p>x</p>";</script></body></html>"""
    assert main_text(page) == f"A <title> {LONG} And more of it. Short. One Two"


def test_without_an_article_blocks_decide():
    page = f"<div>menu</div><div><a href=x>{LONG}</a></div><p>{LONG}</p><p>Near.</p><p>{LONG}</p><div><a>all links</a></div>"
    assert main_text(page) == f"{LONG} Near. {LONG}"
    assert main_text("<p>only a few words</p>") == ""


def test_broken_and_empty_pages():
    assert main_text(None) == main_text("") == main_text("<<<>>> <a <b") == main_text("<script>x") == ""
    assert main_text("<article>a < b &amp; c &zzz; <p title='x>y'>d") == "a < b & c &zzz; d"
    assert main_text("<article>" + "<p>x" * 5000) == " ".join(["x"] * 5000)
    assert main_text("<article>" + "<a '" * 30000).count("<a") <= 30000
    assert main_text("<article><p>x</p></b></div></article></article>") == "x"


def test_second_pass_takes_the_nearest_label():
    assert second_pass([True, None, None, None, False], [False] * 5) == [True, True, False, False, False]
    assert second_pass([False, None], [False, True]) == [False, True]


def test_operator_keeps_every_row(spark):
    rows = [(1, "u", "<article>ä b</article>"), (1, "u", "<article>ä b</article>"), (None, None, None), (2, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as id", "2 as text")
    got = sorted(map(tuple, extract_main_text(df).collect()), key=str)
    assert got == sorted([(1, "u", "ä b", 3)] * 2 + [(None, None, "", 0), (2, "", "", 0)], key=str)
    assert extract_main_text(df.limit(0)).count() == 0


def wrapped(start, end):
    return f"""{start}<div class="ad">Buy it now, as it is the best of all.</div><article><h1>Title</h1>
    <p>{LONG}</p><p>End.</p></article><div class="sidebar"><p>{LONG}</p></div>{end}"""


def test_marks_on_containers_are_lifted():
    for start, end in [
        ('<body class="has-sidebar">', "</body>"),
        ('<body class="sidebar">', "</body>"),
        ('<body class="home no-sidebar">', "</body>"),
        ('<div class="header-fixed">', "</div>"),
        ('<div id="page" class="site widget">', "</div>"),
        ('<form method="post">', "</form>"),
        ('<form><div class="menu-open"><div class="comments-open">', "</div></div></form>"),
    ]:
        assert main_text(wrapped(start, end)) == f"Title {LONG} End.", start
    # Without an article a container is what holds most of the page.
    page = f"<nav><a>Home</a></nav><div class='header-fixed'><form><p>{LONG}</p><p>{LONG}</p></form></div>"
    assert main_text(page) == f"{LONG} {LONG}"
    assert main_text(f"<p>{LONG}</p><p>{LONG}</p><div class='promo'><p>{LONG}</p></div>") == f"{LONG} {LONG}"


def test_reader_comments_go():
    article = f"<article class='post comments-open'><p>{LONG}</p></article>"
    for comments in (
        f"<article class='comment'><p>{LONG}</p></article>",
        f"<ol class='commentlist'><li><p>{LONG}</p></ol>",
        f"<section id='comments'><article><p>{LONG}</p></article></section>",
        f"<li id='comment-17' class='depth-1'><article class='comment-body'>{LONG}</article>",
        f"<div id=disqus_thread>{LONG}</div>",
    ):
        assert main_text(article + comments) == main_text(f"{article[:-10]}{comments}</article>") == LONG, comments


def test_an_article_is_one_by_its_text():
    cards = "<article><h3>One card</h3></article><article><h3>Another</h3></article>"
    assert main_text(f"<p>{LONG}</p><p>{LONG}</p><ul><li><a>link</a></ul>{cards}") == f"{LONG} {LONG}"
    assert main_text(f"<p>{LONG}</p><article><p>{LONG} More.</p></article><p>{LONG}</p>") == f"{LONG} More."
    assert main_text("<article>Short.</article><p>Other.</p>") == "Short."
    assert main_text(f"<main><article><p>{LONG}</p></article><p>{LONG}</p></main>") == LONG
    assert main_text(f"<main><h1>Title</h1><p>{LONG}</p></main><p>Other text.</p>") == f"Title {LONG}"


def test_other_languages():
    for text in (
        "La casa era vuota e il vento entrava da una finestra che nessuno aveva chiuso per tutta la notte.",
        "Het huis was leeg en de wind kwam door een raam dat niemand in de hele nacht had dicht gedaan.",
        "Дом был пуст, и ветер шёл в окно, но до утра его так и не закрыл никто из тех, кто там жил.",
        "房子里空无一人，风从一扇整夜都没有人关上的窗户吹进来。" * 4,
        "その家には誰もいなかった。風は一晩中誰も閉めなかった窓から入ってきた。" * 4,
    ):
        assert main_text(f"<ul><li><a>Menu</a></ul><div>{text}</div>") == text


# Pages without an article or any mark, on which only the densities can decide.
TAGS = "Laptops Phones Tablets Cameras Printers Monitors Keyboards Speakers Headphones Routers Cables Batteries"
LINKS = "<a href=1>It is one of the best of all that we have read in the past year</a>, <a href=2>as it was in a book by one of us</a>"
UNMARKED = [
    f"<div>Home</div><div><a>Log in</a></div><div>{TAGS}</div><div><a>More</a></div><p>{LONG}</p>",
    f"<p>{LONG}</p><p>{LONG}</p><div>{LINKS}</div>",
    f"<p>{LONG}</p><div><a>Top</a></div><div>It is so as of now.</div><div><a>Bottom</a></div>",
]


def test_each_density_decides(monkeypatch):
    expected = [LONG, f"{LONG} {LONG}", LONG]
    assert [main_text(p) for p in UNMARKED] == expected
    for name, off, changed in (("STOP_SHARE", 0, 0), ("LINK_SHARE", 2, 1), ("LONG_BLOCK", 0, 2)):
        with monkeypatch.context() as m:
            m.setattr(html_extraction, name, off)
            assert main_text(UNMARKED[changed]) != expected[changed], name


def test_work_is_linear_on_hostile_pages():
    for page in ("<form class=ad>" * 20000, "<div class=comment>x" * 20000, "<article>" * 20000 + "x", "<p class=ad>x" * 20000):
        main_text(page)


def test_given_pages(sf_dir):
    for page in pd.read_parquet(f"{sf_dir}/pages.parquet").html:
        article = page[page.index("<article>") + 9 : page.index("</article>")]
        article = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", article))
        assert main_text(page) == " ".join(html.unescape(article).split())
