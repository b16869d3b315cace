import html
import itertools
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import html_extract as H

RICH = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x="<p>no</p>";</script></head>
<body class="comments-open"><header><a href="/">Site name</a></header><nav><ul><li><a>Home</a><li><a>News</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, accept them now please.</div>
<div id="content"><h1>Caf&eacute;  &#8217;s   day</h1><p>First <b>bold</b>
 words<br>of it &lt;here&gt;.<p>Second one runs on and on with words.<div class="ad">Buy this great thing now</div>
<form><input><label>Your mail</label></form><blockquote>Quoted words stay here too.</blockquote><ul><li>point one is long</li><li>point two is long</li></ul></div>
<aside>More stories to read</aside><section class="readerComments"><p>I disagree with all of this, says a reader at length.</p></section>
<footer>&copy; all rights</footer></body></html>"""


def test_rich_page_with_prior_weights_only():
    assert H.main_text(RICH, {}) == ("Café ’s day\n\nFirst bold words of it <here>.\n\nSecond one runs on and on with words.\n\n"
                                     "Quoted words stay here too.\n\npoint one is long\n\npoint two is long")


def test_empty_broken_and_long():
    assert H.main_text(None, {}) == "" == H.main_text("", {}) == H.main_text("<nav>menu only</nav>", {})
    assert H.main_text("<p>one two <b class='x", {}) == "one two"
    assert H.main_text("a < b and c", {}) == "a < b and c"
    long = "".join(f"<p>paragraph number {i} has words</p>" for i in range(20_000))
    assert H.main_text(long, {}).count("\n\n") == 19_999


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=30))
def test_region_is_the_best_of_all(scores):
    a, b = H.best_region(scores)
    best = max([0] + [sum(scores[i:j]) for i, j in itertools.combinations(range(len(scores) + 1), 2)])
    assert sum(scores[a:b]) == best


def article(page):
    """The blocks between the article tags of the table's pages, taken apart by their own markup."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return "\n\n".join(t for t in (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)) if t)


def test_table_against_its_markup(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = H.extract(pages).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


def test_weights_carry_over_to_pages_without_marks(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = H.train(pages)
    for r in pages.limit(60).collect():
        assert H.main_text(re.sub(r"</?article>", "", r.html), weights) == article(r.html)


def test_nulls_repeats_clashes_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", None, 5), (2, None, "<p>a b</p>", 6), (2, None, "<p>a b</p>", 6)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in H.extract(pages).collect()) == [(1, "", 0), (2, "a b", 3), (2, "a b", 3)]
    assert H.extract(pages.limit(0)).count() == 0


LAYOUTS = ["layout has-sidebar", "no-sidebar", "content-sidebar-wrap", "with-comments", "nav-open"]


def test_layout_wrappers_hide_nothing():
    body = "<h1>A title here</h1><p>One two three four five.</p><p>Six seven eight nine ten.</p>"
    want = "A title here\n\nOne two three four five.\n\nSix seven eight nine ten."
    side = '<div class="sidebar"><p>More stories</p></div>'
    for name in LAYOUTS:
        assert H.main_text(f'<body><div class="{name}"><article>{body}</article>{side}</div></body>', {}) == want
        assert H.main_text(f'<body><div class="{name}"><main><div class="{name}"><article>{body}</article></div></main>{side}</div></body>', {}) == want
        assert H.main_text(f'<body><div class="{name}">{body}{side}</div></body>', {}) == want


def test_sections_of_an_article_are_kept_unless_a_whole_name_is_boilerplate():
    for name in ("related-work", "share-price", "search-results"):
        page = f'<article><p>First words of it.</p><section class="{name}"><p>These words stay.</p></section><div class="share">Share it now</div><p>Last words of it end here.</p></article>'
        assert H.main_text(page, {}) == "First words of it.\n\nThese words stay.\n\nLast words of it end here."


def test_a_named_wrapper_around_the_whole_page_hides_nothing():
    paragraphs = [f"Paragraph number {i} has words." for i in range(30)]
    body = "".join(f"<p>{x}</p>" for x in paragraphs)
    for name in ("widget", "social", "search", "content", "nav-open"):
        page = f'<body><nav><a>Home</a></nav><div class="{name}"><h1>Title</h1>{body}</div><footer>Imprint</footer></body>'
        assert H.main_text(page, {}) == "\n\n".join(["Title", *paragraphs]), name


def test_comments_and_adverts_stay_out_however_long():
    article = "<p>One short article of a few words.</p><p>It ends here already.</p>"
    said = "".join(f"<p>Reader {i} says a lot about this.</p>" for i in range(200))
    want = "One short article of a few words.\n\nIt ends here already."
    assert H.main_text(f'<body>{article}<div class="comments">{said}</div></body>', {}) == want
    assert H.main_text(f'<body>{article}<div id="discussion">{said}</div></body>', {}) == want
    assert H.main_text(f'<body>{article}<div class="advert">{"buy now " * 60}</div></body>', {}) == want
