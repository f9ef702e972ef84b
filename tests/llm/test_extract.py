import time

import pytest

from parcelforge.llm.extract import extract, main_blocks

CASES = {
    "plain": ("just text &amp; more", ["just text & more"]),
    "empty": ("", []),
    "article": ("<nav><a>n</a></nav><div class='ad'>Buy this, now, please.</div><article><h1>T</h1><p>One,\n two.<p><b>Three</b> &eacute;<br>four.</article><footer>f</footer>", ["T", "One, two.", "Three é four."]),
    "class words": ("<div id=main class='content with-sidebar'><h1>Title</h1><p>First paragraph, with commas, and enough text to count here.</p></div><div class=sidebar><p>Side text, which is long, but should not be there.</p></div><div class=comments><p>A reader, who comments, a lot, at length, about it all.</p></div>", ["Title", "First paragraph, with commas, and enough text to count here."]),
    "cookie notice": ("<div class='cookie-notice'>We use cookies, many, cookies, and more, accept them all now please.</div><main><p>Short.</p></main>", ["Short."]),
    "script": ("<article><script>var t='</p>';if(a<b){}</script><p>Text, here.</p><style>p{}</style><form><p>Mail</p></form></article>", ["Text, here."]),
    "lists and tables": ("<article><p>Intro, which is long enough to be a paragraph.</p><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul></article>", ["Intro, which is long enough to be a paragraph.", "a", "b", "1", "2", "x", "y", "z"]),
    "menu in article": ("<article><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul><p>Intro, which is long enough to be a paragraph.</p></article>", ["Intro, which is long enough to be a paragraph."]),
    "references": ("<article><p>Text is here, first.</p><h2>Refs</h2><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul></article>", ["Text is here, first.", "Refs", "x", "y", "z"]),
    "articles side by side": ("<main><article>A</article><article>B</article></main>", ["A", "B"]),
    "linked article beside": ("<main><article>A text, by itself.</article><article><a href=x>Read on</a></article></main>", ["A text, by itself."]),
    "apostrophe in unquoted value": ("<p title=Bob's>One is here.</p><p>It's two, here.</p>", ["One is here.", "It's two, here."]),
    "quote without an end": ('<p>T</p><a href="x>link', ["T", "link"]),
    "tag without an end": ("<p>T</p><a href=", ["T"]),
    "header in article": ("<header>Site</header><article><header><h1>T</h1></header><p>Body text.</p></article>", ["T", "Body text."]),
    "only boilerplate classes": ("<div class=widget><p>All there is.</p></div>", ["All there is."]),
    "comment": ("<!-- <p>no</p> --><article><p>Yes.</p><!-- unclosed", ["Yes."]),
    "hidden": ("<article><p>Seen.</p><p style='display: none'>Not.</p><p hidden>Nor.</p></article>", ["Seen."]),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    source, want = CASES[name]
    assert main_blocks(source) == want


LONG, SHORT = "word, " * 16 + "word " * 100, "Some more text, of a hundred characters or so, " + "with words " * 10
SECTIONS = {
    "beside": (f"<main><div><p>{LONG}</p></div><div><p>{SHORT}</p></div></main>", [LONG, SHORT]),
    "short ones": (f"<main><section><h2>A</h2><p>{LONG}</p></section><section><h2>B</h2><p>Short.</p></section></main>", ["A", LONG, "B", "Short."]),
    "in wrappers": (f"<main><div><div><p>{LONG}</p></div></div><div><div><p>{SHORT}</p></div></div></main>", [LONG, SHORT]),
    "but no links": (f"<main><div><p>{LONG}</p></div><div><p>{SHORT}</p></div><div><a href=x>More to read</a> <a href=y>Next page</a></div></main>", [LONG, SHORT]),
}


@pytest.mark.parametrize("name", SECTIONS)
def test_sections_side_by_side(name):
    source, want = SECTIONS[name]
    assert main_blocks(source) == [" ".join(x.split()) for x in want]


def test_deep_and_broken_markup():
    assert main_blocks("<div>" * 20_000 + "x" + "</div>" * 20_000) == ["x"]
    assert main_blocks("<p>a</b></i></p></div></article>b <<< 3 < 4 <") != []


HOSTILE = {
    "quotes": "<a '" * 250_000, "equals": "<a ='" * 200_000 + ">x", "open values": '<a href="x' * 90_000, "divs": "<p></p>" + "<div>" * 150_000, "inline": "<b>" * 80_000 + "<p>x</p>" * 80_000,
    "lists": "<ul><li>t" * 80_000, "table": "<p><table>" + "<b>" * 80_000 + "<div></div>" * 60_000, "brackets": "<" * 1_000_000, "comments": "<!--" * 250_000, "scripts": "<script>" * 120_000,
    "siblings": "<div><p>word, word</p>" * 40_000, "links": "<a href=x>y" * 80_000, "blanks": "<a =" + " " * 1_000_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_grows_in_proportion(name):
    began = time.process_time()
    main_blocks(HOSTILE[name])
    assert time.process_time() - began < 10  # about 2 s on the machine this was written on; a quadratic scan takes hours


def test_whole_pages(spark):
    df = spark.createDataFrame([(1, "u", None, 5), (2, None, "<article>" + "<p>word, word.</p>" * 5000, 6), (2, None, "x", 7)], "page_id long, url string, html string, n_chars int")
    got = {(r.page_id, r.n_chars): r.text for r in extract(df, keep=["page_id", "url", "n_chars"]).collect()}
    assert got[1, 5] == "" and got[2, 7] == "x" and got[2, 6].count("\n\n") == 4999
    assert extract(df.limit(0)).count() == 0


def test_doubtful_classes_inside_an_article():
    long = "Stock prices rose for the third day in a row, as investors judged the quarter's results, and banks led the gains."
    blocks = lambda html: main_blocks(html)
    assert blocks(f'<article><p class="share">{long}</p><p>{long}</p></article>') == [long, long]
    assert blocks(f'<article><section id="notice"><p>Legal {long}</p></section><p>{long}</p></article>') == ["Legal " + long, long]
    assert blocks(f'<article><p>{long}</p><div class="share">Share this</div><div class="cookie-notice">{long}</div><div class="related"><a href="x">{long}</a></div></article>') == [long]


def test_a_title_before_its_article():
    long = "Stock prices rose for the third day in a row, as investors judged the quarter's results, and banks led the gains."
    assert main_blocks(f"<div><h1>Title</h1></div><article><p>{long}</p></article>") == ["Title", long]
    assert main_blocks(f"<div><h1>Site</h1></div><article><h1>Own</h1><p>{long}</p></article>") == ["Own", long]
    assert main_blocks(f'<div class="masthead"><h1>Site</h1></div><article><p>{long}</p></article>') == [long]
