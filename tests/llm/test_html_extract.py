from html.parser import HTMLParser

import pytest

from lexmill.llm.html_extract import NAMES, blocks_of, extract_main_text, labelled_rows, main_text, train_tree
from lexmill.llm.queries import op4_html_text


@pytest.fixture(scope="module")
def tree(spark):
    return train_tree(spark)


LONG = "This paragraph is long enough to be the text of an article, with many words in one go and few links at all."
CASES = [
    ("", ""),
    ("plain words without markup " * 5, " ".join(("plain words without markup " * 5).split())),
    (f"<html><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class='ad'>Buy this now please.</div><article><h1>A title &amp; more</h1><p>{LONG}<p>Short.</article><footer>&copy; 2024 site</footer>", f"A title & more {LONG} Short."),
    (f"<article><h1>T</h1><p>{LONG}</p><div class='comments'><h3>Comments</h3><p>{LONG}</p></div></article>", f"T {LONG}"),
    (f"<header><h1>Site</h1></header><main><p>{LONG}</p><aside>Related story text</aside><form><label>Name</label><input value=x></form></main>", LONG),
    (f"<article><p>{LONG}<script>var t='</p>';</script><style>p{{}}</style><!-- gone <p> --></p></article>", LONG),
    (f"<article><p>a&nbsp;b &#233;&lt;tag&gt;\n\t x</p><p>{LONG}</p></article>", f"a b é<tag> x {LONG}"),
    (f"<div id='cookie-notice'>We use cookies on this site, accept them.</div><article><p>{LONG}</p></article>", LONG),
    (f"<article><p>One <b>bold<br>next</p><p>{LONG}</p></article>", f"One bold next {LONG}"),
    (f"<article><p>{LONG}</p><ul><li>first<li>second</ul><table><tr><td>cell<td>cell2</table></article>", f"{LONG} first second cell cell2"),
    (f"<article><p style='display:none'>hidden</p><p hidden>hidden</p><p>{LONG}</p>", LONG),
    (f"<div class=menu><a href=/>Home</a> <a href=/b>About us</a></div><div><p>{LONG}</p><p>{LONG}</p></div><div class=footer>All rights</div>", f"{LONG} {LONG}"),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_cases(tree, page, want):
    assert main_text(page, tree) == want


def test_tree_fits_its_table(tree):
    import numpy as np

    rows = labelled_rows()
    got = tree.predict(np.array([x for _, x in rows]))
    assert (got == np.array([y for y, _ in rows])).mean() > 0.95


def test_link_density_decides_without_hints(tree):
    menu = "".join(f"<div><a href=/{i}>Item {i}</a></div>" for i in range(5))
    assert main_text(f"{menu}<div>{LONG}</div><div>{LONG}</div>", tree) == f"{LONG} {LONG}"


def test_blocks():
    got = blocks_of("<p>a <a href='x>y'>b c</a> d<div>e</div>f</p>g<a>h<p>i</p></a>")
    assert [(b.text, b.words, b.linked) for b in got] == [("a b c d", 4, 2), ("e", 1, 0), ("f", 1, 0), ("gh", 1, 1), ("i", 1, 1)]
    assert [b.text for b in blocks_of("a < b <1> </ c> &amp;amp; <unclosed")] == ["a < b <1> &amp;"]


def test_operator(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "v", CASES[2][0]), (3, "v", CASES[2][0]), (None, "w", f"<article><p>{'word ' * 60000}</article>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = extract_main_text(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(len(r.text) for r in got.collect()) == [0, 0, len(CASES[2][1]), len(CASES[2][1]), 299999]
    assert extract_main_text(pages.limit(0)).collect() == []


LAYOUTS = [
    (f"<div class='nav'><a href=/>Home</a></div><div class='content no-sidebar'><h1>A title</h1><p>{LONG}</p></div><div class='footer'>All rights</div>", f"A title {LONG}"),
    (f"<div class='site-content has-sidebar'><div class='entry-header'><h1>A title</h1></div><p>{LONG}</p><div class='sidebar'><p>{LONG}</p></div></div>", f"A title {LONG}"),
    (f"<div class='post-content with-comments'><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></div>", LONG),
    (f"<div class='layout-without-sidebar'><div id='main' class='widget'><header class='post-header'><h2>A title</h2></header><p>{LONG}</p></div></div>", f"A title {LONG}"),
    (f"<div class='main-menu'>{LONG}</div><div class='sidebar-content'>{LONG}</div><div role='navigation' class='content'>{LONG}</div><div aria-label='Main menu'>{LONG}</div><article><p>{LONG}</p></article>", LONG),
]


MENU = "<ul class='nav-menu'><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>About us</a></li></ul>"
SEARCH = "<form action=/find><input name=q><button>Search</button><label>Search this site</label></form>"
#: Pages without an article element whose markup ends late, lies in forms, or is named by words of furniture.
LAYOUTS += [
    (f"<html><head><title>x</title><body><article><p>{LONG}</p></article>", LONG),
    (f"<head><meta charset=utf-8><title>x</title><link href=/s rel=stylesheet><p>{LONG}</p>", LONG),
    (f"<html><head><title>x</title>{LONG}", LONG),
    (f"<head><title>x</title><script>var a;</script><noscript><style>p</style></noscript><div class=page><h1>A title</h1><p>{LONG}</p></div>", f"A title {LONG}"),
    (f"<body><form method=post><article><p>{LONG}</p></article></form>", LONG),
    (f"<body><form method=post id=aspnetForm><input type=hidden name=state>{MENU}<div class=content><p>{LONG}</p><p>Short.</p></div></form>", f"{LONG} Short."),
    (f"<form method=post><input name=state>{MENU}<div><h1>A title</h1><p>{LONG}</p><p>{LONG}</p></div><div class=footer>All rights</div></form>", f"A title {LONG} {LONG}"),
    (f"<form method=post><table><tr><td>{MENU}</td><td><p>{LONG}</p><p>{LONG}</p></td></tr></table></form>", f"{LONG} {LONG}"),
    (f"<div>{SEARCH}</div><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG} {LONG}"),
    (f"<div class='search-result-page'><div class='story-text'><p>{LONG}</p></div></div>", LONG),
    (f"<div class='page-header-wrap'><div class='header'><a href=/>Site</a></div><div class='main-content'><h1>A title</h1><p>{LONG}</p></div></div>", f"A title {LONG}"),
    (f"<div class='modal-page'><div class='post-body'><p>{LONG}</p><div class='share'><a href=/s>Share</a></div></div></div>", LONG),
    (f"<div id='login-layout'><main><p>{LONG}</p></main></div>", LONG),
    (f"<div class='side-by-side'><div class='entry'><p>{LONG}</p></div><div class='sidebar'><div class='content'><p>{LONG}</p></div></div></div>", LONG),
    (f"<div class='alert-banner-page'><section class='article-text'><h2>A title</h2><p>{LONG}</p></section></div>", f"A title {LONG}"),
    (f"<header><div class='content'><h1>A title</h1><p>{LONG}</p></div></header>", f"A title {LONG}"),
    (f"<fieldset><div class='entry-content'><p>{LONG}</p></div></fieldset>", LONG),
    (f"<div class='comments'><article class='comment'><p>{LONG}</p></article><div class='text'>{LONG}</div></div><div class='post'><p>{LONG}</p></div>", LONG),
    (f"<nav><div class='content'><p>{LONG}</p></div></nav><div class='story'><p>{LONG}</p></div>", LONG),
    (f"<aside><article><p>{LONG}</p></article></aside><div id='main'><p>{LONG}</p></div>", LONG),
    (f"<div class='tags-layout'><div class='article-body'><p>{LONG}</p><div class='tags'><a href=/t>tag</a></div></div></div>", LONG),
    (f"<div><select><option>One<option>Two<p>{LONG}</p><p>{LONG}</p></div>", f"{LONG} {LONG}"),
    (f"<table><tr><td class='side'><a href=/a>Home</a></td><td class='content'><h1>A title</h1><p>{LONG}</p></td></tr></table>", f"A title {LONG}"),
    (f"<div class='main'><p>{LONG}</p><form class='comment-form'><p>{LONG}</p><textarea>x</textarea></form></div>", LONG),
    (f"<div class='main'><p>{LONG}</p><form><p>Leave your mail here</p><input name=mail></form></div>", LONG),
]


@pytest.mark.parametrize(("page", "want"), LAYOUTS)
def test_layouts_named_by_furniture(tree, page, want):
    assert main_text(page, tree) == want


def test_neighbours_are_in_the_tree(tree):
    used = {NAMES[i] for i in tree.feature if i >= 0}
    assert used & {"words_before", "words_after"} and used & {"link_density_before", "link_density_after"}
    menu = "<div><a href=/a>Item one</a></div>"
    text = main_text(f"{menu}<div>Contents</div>{menu}<div>{LONG}</div><div>Contents</div><div>{LONG}</div>", tree)
    assert main_text(f"{menu}<div>{LONG}</div>{menu}", tree) == LONG
    assert text == f"{LONG} Contents {LONG}"  # the same short line among links and between paragraphs


def test_a_stray_quote_stays_in_its_tag(tree):
    page = "<article><p>a <img alt=John's photo> first part</p><p class=x\">second don't part</p><p title='>' data-class=nav>third</p></article>"
    assert main_text(page, tree) == "a first part second don't part third"


def test_deep_nesting_takes_linear_time(tree):
    import time

    began = time.time()
    deep = "<div>" * 100_000 + LONG + "</div>" * 100_000
    assert main_text(deep, tree) == LONG
    assert main_text("<p><table><td>" + "<div>" * 50_000 + "<i>x</i></b>" * 20_000 + "</article>" * 20_000, tree).count("x") == 20_000
    assert time.time() - began < 20


class _Plain(HTMLParser):
    """An independent reading of the test tables' pages: text of the article element."""

    BLOCKS = {"p", "h1", "br", "article", "li", "div"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in self.BLOCKS:
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in self.BLOCKS:
            self.out.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.out.append(data)


def test_pages_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in op4_html_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        plain = _Plain()
        plain.feed(page.html)
        want = " ".join("".join(plain.out).split())
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want) and got[page.page_id].url == page.url
