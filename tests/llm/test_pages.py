"""Main text: hand-made pages, malformed markup, and the supplied pages against their template."""

import html
import random
import re

import pytest

from plotmark.llm import pages
from plotmark.llm.queries import QUERIES


def slow_run(scores):
    return max((sum(scores[a:b]) for a in range(len(scores) + 1) for b in range(a, len(scores) + 1)), default=0)


def test_linear_scan_finds_the_best_run():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.randint(-5, 5) for _ in range(rng.randint(0, 14))]
        low, high = pages.best_run(scores)
        assert sum(scores[low:high]) == slow_run(scores)


CASES = {
    "": "",
    "just words": "just words",
    "<p>a &amp; b&nbsp;c &#233; &lt;i&gt;</p>": "a & b c é <i>",
    "<div>  one \n two<b> three</b>four </div><p></p><p>five<br>six": "one two threefour\nfive six",
    "<html><head><title>t t t t t t</title><style>p{}</style></head><body><nav><ul><li><a href=x>home</a></ul></nav>"
    "<header>site name</header><p>text one two three</p><!-- <p>hidden</p> --><aside>side</aside><p>more text"
    "<script>if (a<b) document.write('<p>x</p>')</script></p><form>name <input> <button>go</button></form>"
    "<section class='comments'><p>a reader says very much about all this</p></section><footer>end</footer>":
    "text one two three\nmore text",
    "<article><header><h1>Title</h1></header><div class='ad-box'>buy</div><p>body <span hidden>no</span>text</p>"
    "<div class='cookieNotice'>we use</div><footer>tags</footer></article><div class=sidebar><p>"
    + "other words " * 50 + "</p></div>": "Title\nbody text",
    "<p title=\"a>b\">quoted</p><p class='x>unclosed quote</p>": "quoted\nunclosed quote",
    "<p>open <b>bold<p>next</b></p></div></p> tail <unknown-tag>kept": "open bold\nnext\ntail kept",
    "<!-- never closed <p>x</p>": "",
    "<script>never closed <p>x</p>": "",
    "a < b and c > d &am &amp": "a < b and c > d &am &",
    "<ul><li>one two<li>three four</ul>": "one two\nthree four",
    "<table><tr><td>a b c</td><td>d e f</td></tr></table>": "a b c\nd e f",
    "<" * 5000: "<" * 5000,
}


@pytest.mark.parametrize("page", list(CASES), ids=range(len(CASES)))
def test_pages(page):
    assert pages.extract(page, {}) == CASES[page]


def test_long_and_deep_pages():
    page = "<div>" * 20_000 + "<p>" + "word " * 100_000 + "</p>"
    assert pages.extract(page, {}) == ("word " * 100_000).strip()


def template_text(page):
    """The supplied pages' article, cut at its tags by hand."""
    inner = re.search("<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub("</?b>", "", inner).replace("<br>", " ")
    assert not re.search(r"<(?!/?(?:p|h1)>)[a-z/]", inner)
    blocks = (" ".join(html.unescape(b).split()) for b in re.split("</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_query(spark, sf):
    source = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op2_main_text"](spark, sf).collect()
    assert len(rows) == len(source) > 0
    for r in rows:
        want = template_text(source[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (source[r.page_id].url, want, len(want))


def test_learned_weights_serve_pages_without_a_landmark(spark, sf):
    """Held out: the landmark's tags are removed from pages that did not teach."""
    df = spark.read.parquet(f"{sf}/pages.parquet")
    weights = pages.learn_weights(df.filter("page_id < 20"), "html", 15)
    for r in df.filter("page_id >= 20").collect():
        assert pages.extract(re.sub("</?article>", "", r.html), weights) == template_text(r.html)


def test_odd_rows(spark):
    rows = [(1, None, "u", "old"), (None, "<p>x y</p>", None, "old"), (2, "", "u", None), (2, "", "u", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    got = pages.main_text(df)
    assert got.columns == df.columns
    assert sorted((str(r.page_id), r.text) for r in got.collect()) == [("1", ""), ("2", ""), ("2", ""), ("None", "x y")]
    assert pages.main_text(df.limit(0)).count() == 0


BODY = "<p>" + "plain body words here " * 10 + "</p>"
COMMENT = "<article class=comment><p>" + "a reader says much about this " * 4 + "</p></article>"


@pytest.mark.parametrize(
    "page,landmark",
    [
        (f"<main>{BODY}</main><div>{COMMENT * 5}</div>", "main"),
        (f"<div class=post>{BODY}</div><div>{COMMENT * 5}</div>", None),
        (f"<div class=post>{BODY}</div><aside><article><p>some teaser</p></article></aside>", None),
        (f"<div class=post>{BODY}</div><script>x = '<article>'</script><!-- <main> -->", None),
        (f"<main>{BODY}</main><script>x = '<article>'</script>", "main"),
        (f"<main>{BODY}<article class=teaser><p>see that</p></article></main>", "main"),
        (f"<article>{BODY}</article><article class=comment><p>yes</p></article>", "article"),
    ],
)
def test_landmark_is_a_shown_element(page, landmark):
    items, found = pages.read_page(page)
    assert found == landmark
    assert all(inside == (landmark is not None) for f, n, t, inside in items if t and "plain body" in t)
    assert pages.extract(page, {"p|out": -4.0, "p|in": 4.0, "p": 1.0}) == ("plain body words here " * 10).strip()


def test_pages_without_a_landmark_do_not_teach(spark):
    template = f"<html><body><div class=post>{BODY}</div>{COMMENT * 3}<script>'<article>'</script></body></html>"
    df = spark.createDataFrame([(k, template.replace("plain", f"plain{k}")) for k in range(30)], "page_id long, html string")
    assert pages.learn_weights(df, "html", 20) == {}
    want = ("plain body words here " * 10).strip()
    assert {r.text for r in pages.main_text(df).collect()} == {want.replace("plain", f"plain{k}") for k in range(30)}


@pytest.mark.parametrize(
    "names",
    ["layout has-sidebar", "no-sidebar", "with-banner", "elementor-widget", "nav-open", "page-header-fixed", "hasSidebar"],
)
@pytest.mark.parametrize("tag", ["article", "main", "section"])
def test_names_never_drop_what_encloses_the_content(names, tag):
    page = f"<div class='{names}'><div class=sidebar><p>see also</p></div><{tag}>{BODY}</{tag}></div><p>end</p>"
    text = pages.extract(page, {})
    assert ("plain body words here " * 10).strip() in text
    # A side part in a wrapper stays left out.
    assert "see also" not in text


@pytest.mark.parametrize(
    "attrs,kept",
    [
        ("title='the hidden valley'", True), ('alt="hidden"', True), ("title=hidden", True), ("title = hidden", True),
        ("hidden", False), ("id=x hidden", False), ('hidden=""', False), ("HIDDEN class='a b'", False),
    ],
)
def test_hidden_is_an_attribute(attrs, kept):
    assert pages.extract(f"<p>one</p><p {attrs}>two</p>", {}) == ("one\ntwo" if kept else "one")


@pytest.mark.parametrize("weights", [
    {"p|in": 4.0, "h1|in": 4.0, "p|out": -4.0, "p": 1.0, "h1": 1.0},
    {"p|in": 4.0, "h1|in": 4.0, "p|out": -4.0, "|in": 4.0, "|out": -4.0, "<|in": -0.05, "<|out": -4.0},
    {},
])
@pytest.mark.parametrize(
    "inner,want",
    [
        ("<h1>T</h1><p>alpha beta gamma</p><ul><li><a>Reference one</a></li><li><a>Reference two</a></li></ul>", "T\nalpha beta gamma\nReference one\nReference two"),
        ("<p><a>Byline</a></p><h1>T</h1><p>alpha beta</p>", "Byline\nT\nalpha beta"),
        ("<h1>T</h1><table><tbody><tr><td>cell</td></tr></tbody></table>", "T\ncell"),
        ("<table><tr><td><a>one</a></td></tr></table><p>alpha</p><dl><dt>a</dt><dd><a>b</a></dd></dl>", "one\nalpha\na\nb"),
    ],
)
def test_no_part_of_a_marked_article_is_lost(inner, want, weights):
    page = f"<body><p><a>site link</a></p><article>{inner}</article><ul><li><a>more</a></li></ul></body>"
    text = pages.extract(page, weights)
    assert want in text
    if weights:
        assert text == want


def test_articles_with_kinds_of_blocks_that_no_label_had(spark):
    """Held-out template: labels have paragraphs only."""
    df = spark.createDataFrame(
        [(k, f"<body><p><a>site {k}</a></p><article><p>plain{k} text of it</p></article><ul><li>foot</li></ul></body>") for k in range(20)],
        "page_id long, html string",
    )
    weights = pages.learn_weights(df, "html", 20)
    page = "<p>site</p><article><blockquote><a>quoted</a></blockquote><p>text</p><pre>code</pre></article><dl><dd>foot</dd></dl>"
    assert pages.extract(page, weights) == "quoted\ntext\ncode"
