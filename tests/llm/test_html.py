"""HTML extraction: known articles out of pages with all kinds of furniture."""

import pytest

from keelson.llm import html_text
from tests.llm import helpers

PARAGRAPHS = [f"Paragraph {i} of the article has some words, a few more and &amp; an end." for i in range(4)]
ARTICLE = "<h1>The  title</h1>" + "".join(f"<p>{p}</p>\n" for p in PARAGRAPHS)
WANT = "\n".join(["The title", *(p.replace("&amp;", "&") for p in PARAGRAPHS)])
MENU = "<ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav>{MENU}</nav><article>{ARTICLE}</article><footer>&copy; us</footer></body>",
        f"<body><header><h1>Site</h1>{MENU}</header><main>{ARTICLE}</main><aside>Side</aside>",
        f"<div id=menu>{MENU}</div><div class='post has-sidebar'>{ARTICLE}</div><div class=sidebar>x</div>",
        f"<body><div>{ARTICLE}<div class='ad banner'>Buy</div><form>Mail <input></form></div>"
        "<section id='comments'><article class='comment'><p>Nice article, I read it twice.</p></article></section>",
        f"<article>{ARTICLE}<script>var t = '</p>';</script><style>p{{}}</style><!-- <p>no</p> --></article>",
        f"<div class='cookie-notice'>We use cookies</div><article>{ARTICLE}<p hidden>x</p>",
        f"<body><div>{ARTICLE}<div><a href=1>a link list</a> <a href=2>of more links</a></div></div>",
    ],
)
def test_the_article_and_nothing_else(page):
    assert html_text.main_text(page) == WANT


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain &lt;text&gt;  only", "plain <text> only"),
        ("<p><b>Bold<br>text<p>next", "Bold text\nnext"),
        ("<article><p>a&nbsp;b\t c</p><p></p><p>d</article>", "a b c\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<script>x", ""),
        ("<article><p title='a > b'>q</p", "q"),
        ("<nav>only a menu</nav>", ""),
        ("<ul><li>one<li>two<ul><li>three</ul><li>four</ul>", "one\ntwo\nthree\nfour"),
    ],
)
def test_small_pages(page, want):
    assert html_text.main_text(page) == want


LONG = [f"Part {i}: " + "word " * 19 + "end." for i in range(10)]
FIVE, MORE = ("".join(f"<p>{p}</p>" for p in part) for part in (LONG[:5], LONG[5:]))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><h1>Title</h1><div>{FIVE}</div></body>", ["Title", *LONG[:5]]),
        (f"<body><div><h1>Title</h1></div><p>By me</p><div>{FIVE}</div></body>", ["Title", *LONG[:5]]),
        (f"<body><div>{FIVE}</div><div>{MORE}</div></body>", LONG),
        (f"<body><div>{FIVE}</div><div><p>{LONG[5]}</p></div></body>", LONG[:6]),
        (f"<body><article>{FIVE}</article><article>{MORE}</article></body>", LONG),
        (f"<body><div><article>{FIVE}</article><div>Top</div><article>{MORE}</article></div>", LONG),
        (f"<body><h2>A</h2><div>{FIVE}</div><h2>B</h2><div>{MORE}</div>", ["A", *LONG[:5], "B", *LONG[5:]]),
        (f"<body><div>{FIVE}</div>{LONG[5]}<div>(c) us</div>", LONG[:6]),
        (f"<body><div>{FIVE}</div><h3>More</h3><ul><li><a href=1>Other news of today</a></ul>", LONG[:5]),
    ],
)
def test_text_beside_the_densest_container(page, want):
    assert html_text.main_text(page) == "\n".join(want)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><h2 id='related-work'>Related</h2>{FIVE}<h2 id=search>Search</h2>{MORE}</article>",
         ["Related", *LONG[:5], "Search", *LONG[5:]]),
        (f"<article>{FIVE}<p class='notice'>Take care.</p><p>A <span class=share>share</span> of it.</article>",
         [*LONG[:5], "Take care.", "A share of it."]),
        (f"<body><div class='layout-sidebar-left'>{FIVE}</div></body>", LONG[:5]),
        (f"<body><div class='page page-header-fixed'><article>{FIVE}</article></div></body>", LONG[:5]),
        (f"<body><div class=navigation><main>{FIVE}</main></div><div class=menu>Top</div></body>", LONG[:5]),
        (f"<article>{FIVE}<section id='comments'><h2>Comments</h2>{MORE}</section></article>",
         [*LONG[:5], "Comments", *LONG[5:]]),
        (f"<article>{FIVE}<div class='share-buttons'>Send it</div></article>", LONG[:5]),
        (f"<article>{FIVE}</article><div class='comments'>{MORE * 3}</div>", LONG[:5]),
        (f"<div class=post>{FIVE}</div><div class='related-posts'>{'<p>Short words here.</p>' * 9}</div>", LONG[:5]),
        (f"<body><div class='sidebar'>{FIVE}</div></body>", LONG[:5]),
    ],
)
def test_names_alone_drop_no_article_text(page, want):
    assert html_text.main_text(page) == "\n".join(want)


TWO = f"<p>{LONG[5]}</p><p>{LONG[6]}</p>"
REPLIES = "".join(f"<div class='reply'><b>user{i}</b><p>{p}</p></div>" for i, p in enumerate(LONG[5:]))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # Reader comments: by name and place, by name and shape, longer than the article.
        (f"<article>{FIVE}<section id='comments'>{MORE}</section></article>", LONG[:5]),
        (f"<article>{FIVE}<section id='comments'><h2>12 Comments</h2>{REPLIES}</section></article>", LONG[:5]),
        (f"<article>{FIVE}<section id='comments'><h2>Comments</h2>{REPLIES * 6}</section></article>", LONG[:5]),
        (f"<body><div>{FIVE}<div class='article-comments'>{REPLIES}</div></div></body>", LONG[:5]),
        (f"<body><article>{FIVE}</article><div class='user-comments'>{REPLIES * 9}</div></body>", LONG[:5]),
        (f"<article>{FIVE}<section id='comments'><ol><li class=c>{LONG[5]}<li class=c>{LONG[6]}</ol></section></article>", LONG[:5]),
        # Sidebars, notices, footers and adverts as dense as the article.
        (f"<body><article>{FIVE}</article><div class='sidebar-left widget-area'>{TWO}</div></body>", LONG[:5]),
        (f"<div class='wrap'><div class='sidebar-left widget-area'>{TWO}</div><div>{FIVE}</div></div>", LONG[:5]),
        (f"<body><div class='cookie-consent-bar'>{TWO}</div><article>{FIVE}</article></body>", LONG[:5]),
        (f"<body><article>{FIVE}</article><div class='site-info footer-widgets'>{TWO}</div></body>", LONG[:5]),
        (f"<body><div>{FIVE}<div class='newsletter-box'>{TWO}</div>{MORE}</div></body>", LONG),
        (f"<body><div>{FIVE}<div class='related-posts'>{TWO}</div></div></body>", LONG[:5]),
        (f"<body><div class='notice-bar'><p>{LONG[7]}</p></div><div>{FIVE}</div></body>", LONG[:5]),
    ],
)
def test_dense_furniture(page, want):
    assert html_text.main_text(page) == "\n".join(want)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div class='sidebar-left'><h1>T</h1>{FIVE}</div></body>", ["T", *LONG[:5]]),
        (f"<body><p>By me</p><div class='sidebar-left'>{FIVE}</div></body>", LONG[:5]),
        (f"<article>{FIVE}<section id='comments-on-the-bill'><h2>On the bill</h2>{MORE}</section></article>",
         [*LONG[:5], "On the bill", *LONG[5:]]),
        (f"<article>{FIVE}<section id='search'><h2>Search</h2>{MORE}</section></article>",
         [*LONG[:5], "Search", *LONG[5:]]),
        (f"<article>{FIVE}<div class='footer-notes'>{MORE}</div></article>", LONG),
        (f"<article>{FIVE}<div class='notice'><p>{LONG[5]}</p></div><p>{LONG[6]}</p></article>", LONG[:7]),
        (f"<article>{FIVE}<section id='comments'><h2>Remarks</h2>{MORE}</section>{FIVE}</article>",
         [*LONG[:5], "Remarks", *LONG[5:], *LONG[:5]]),
        (f"<div class='layout-sidebar-left'><div>{FIVE}</div><div>{MORE}</div></div>", LONG),
        (f"<body><div class='content sidebar-right'><article>{FIVE}</article></div></body>", LONG[:5]),
    ],
)
def test_articles_in_containers_with_such_names(page, want):
    assert html_text.main_text(page) == "\n".join(want)


def test_many_named_sections():
    page = "".join(f"<section id=comments><h2>Comments</h2><p>{LONG[0]}</p></section>" for _ in range(4_000))
    assert html_text.main_text(f"<article>{page}</article>").count("Comments") == 4_000


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 5_000 + "deep") == "deep"
    long = "<article>" + "<p>word word word</p>" * 20_000 + "</article>"
    assert html_text.main_text(long).count("\n") == 19_999


def test_table(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>"), (2, None, None), (3, "u", ""), (1, "u", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = helpers.with_clashes(pages, "text", "N_CHARS", "other")
    found = html_text.extract_text(pages)
    assert found.columns == ["page_id", "url", "html", "other", "text", "n_chars"]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in found.collect())
    assert got == sorted([(1, WANT, len(WANT)), (2, "", 0), (3, "", 0), (1, "é", 1)])
    assert html_text.extract_text(pages.limit(0)).collect() == []


@pytest.mark.parametrize(
    "tag", ["<p don't>", '<p "x>', "<p title=it's>", "<p a='b>c' d=\"e>f\">", "<p x = 'y' \">"]
)
def test_quotes_open_values_only(tag):
    page = f"<body><div>{tag}First paragraph of its own, long enough to stay.</p><p>Second paragraph, it's long too.</p></div></body>"
    assert html_text.main_text(page) == "First paragraph of its own, long enough to stay.\nSecond paragraph, it's long too."
