"""Main text of pages: the given pages against their article element, and other layouts."""

import html as htmllib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import html_text
from corpusloom.llm.html_text import extract

P = "A sentence of the article that is long enough to be dense, with words and words and more words in it."


def plain_article(page):
    """The template's article, split at its block tags: a plainer way that knows the template."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = (
        " ".join(htmllib.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", body)
    )
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    got = {r.page_id: r for r in html_text.op3_html_text(spark, "/root/testdata/sf0.01").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert r.text == plain_article(p.html) and r.n_chars == len(r.text) and r.url == p.url


SHELLS = [
    "<html><body><header><h1>Site</h1><a href=/>home</a></header><div id='content'>{}</div><footer>foot</footer></body></html>",
    "<body><div class='sidebar'><ul><li><a href=a>one</a><li><a href=b>two</a></ul></div><main>{}</main>"
    "<div class=comments><p>" + P * 3 + "</p></div></body>",
    "<div class='page has-sidebar'><div class='cookie-notice'>We use cookies.</div><form><input name=q><button>Go</button>"
    "</form><div class=entry>{}</div><aside>" + P + "</aside></div>",
    "<article>{}</article><section id='comments'><article class='comment'><p>" + P + "</p></article></section>",
    "<table><tr><td class='menu'><a href=1>a</a><a href=2>b</a><td>{}</table><div class='ad'>Buy " + P + "</div>",
]


@pytest.mark.parametrize("shell", SHELLS)
def test_layouts(shell):
    inner = f"<h2>Head &amp; more</h2><p>{P}<p>x &lt; y\n  and <b>bold</b> <a href='z>'>link</a>.</p><script>var a='<p>no</p>'</script><p>{P}</p>"
    want = "\n".join(["Head & more", P, "x < y and bold link.", P])
    assert extract(shell.format(inner)) == want


def test_odd_pages():
    assert extract("") == ""
    assert extract("just text, no markup") == "just text, no markup"
    assert extract("<p>a < b</p>") == "a < b"
    assert extract("<p>one<!-- two <p>three --> four</p>") == "one four"
    assert extract("<p>one<script>never closed") == "one"
    assert extract("<nav>only a menu</nav>") == ""
    assert extract(f"<p>{P}</p><!never closed") == P
    for bad in ("<!x" * 400_000, "<?x" * 200_000, "<a" * 50_000, "<p>" * 20_000, "<div>" * 20_000, "<!--" * 5000, '<p ="' * 20_000, "&amp" * 20_000):
        extract(bad)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article class='post comments-open'>{}</article>", "Title {}"),
        ("<main class='has-comments'>{}</main>", "Title {}"),
        ("<article class='post'><h1 class='comment-title'>Title</h1><p>{p}</p><p class='comment'>Comment.</p></article>", "Title|{p}|Comment."),
        ("<div class=top><h1>Title</h1></div><div class=body><p>{p}</p><p>{p}</p></div>", "Title|{p}|{p}"),
        ("<div class=logo><h1><a href=/>Site</a></h1></div><div class=body><p>{p}</p><p>{p}</p></div>", "{p}|{p}"),
        ("<article class='comment'>{}</article>", "Title {}"),
        ("<article>{}</article><div id=thread><article class='comment depth-1'><p>{p}</p><p>{p}</p></article></div>", "Title {}"),
        ("<div class='story'>{}</div><ol class='commentlist'><li><p>{p}</p><li><p>{p}</p></ol>", "Title {}"),
        ("<div id=page><div id=left><ul><li><a href=a>a</a><li><a href=b>b</a></ul></div><div id=right>{}</div></div>", "Title {}"),
        ("<table><tr><td><a href=1>x</a><td>{}<td><a href=2>y</a></table>", "Title {}"),
        ("<section><header><h1>Title</h1></header><p>{p}</p><p>{p}</p></section>", "{p}|{p}"),
        ("<dl class=menu><dt><a href=1>m</a></dl><blockquote><p>{p}</p><p>{p}</p></blockquote><div class=footer>f</div>", "{p}|{p}"),
    ],
)
def test_unlike_layouts(page, want):
    inner = f"<h1>Title</h1><p>{P}</p><p>{P}</p>"
    shown = page.replace("{p}", P).replace("{}", inner)
    expect = "|".join(["Title", P, P]) if want == "Title {}" else want.replace("{p}", P)
    assert extract(f"<html><head><title>T</title></head><body>{shown}</body></html>") == expect.replace("|", "\n")


def test_ties_go_to_an_article_then_to_page_order():
    box = f"<p>{P}</p><p>{P}</p>"
    for shell in ("<body><nav>menu</nav><div>{}</div></body>", "<body><article>{}</article></body>", "<body><div><div>{}</div></div></body>"):
        assert extract(shell.format(box)) == f"{P}\n{P}"
    assert extract(f"<body><div>{box}</div><article>{box}</article></body>").count(P) in (2, 4)
    one = extract(f"<body><div><p>A {P}</p></div><div><p>B {P}</p></div></body>")
    assert one.startswith("A ")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pb ad!-='\"&;é\n", max_size=80))
def test_any_text_is_parsed(text):
    got = extract(text)
    assert all(line and line == " ".join(line.split()) for line in got.split("\n")) or got == ""


def test_column(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "y")], "page_id long, html string, text string")
    assert [r[0] for r in df.select(html_text.main_text(df["html"])).collect()] == ["", "", ""]
    assert df.limit(0).select(html_text.main_text(df["html"])).count() == 0


def without_article(page):
    return page.replace("<article>", "<div>").replace("</article>", "</div>")


def given_pages():
    import pyarrow.dataset as ds

    return ds.dataset("/root/testdata/sf0.01/pages.parquet").to_table()["html"].to_pylist()


def test_given_pages_without_article_elements():
    for page in given_pages():
        assert extract(without_article(page)) == plain_article(page)


def test_density_decides(monkeypatch):
    """Unmarked boxes beside the article: only their density tells them apart."""
    links = "".join(f"<li><a href=/{i}>Some other story of the day, number {i}</a></li>" for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><h2>Title</h2><p>{P}</p><p>{P}</p></div><div><a href=/x>next page</a></div></body>"
    want = "\n".join(["Title", P, P])
    assert extract(page) == want
    whole = html_text._densities
    monkeypatch.setattr(html_text, "_densities", lambda page, out: ([0.0] * len(page.tag), [0.0] * len(page.tag)))
    assert extract(page) != want
    monkeypatch.setattr(html_text, "_densities", lambda page, out: tuple([-x for x in y] for y in whole(page, out)))
    assert extract(page) != want


ARTICLE = f"<h1>Title</h1><p>{P}</p>{{}}<p>{P}</p>"


@pytest.mark.parametrize("shell", ["<body><main>{}</main></body>", "<body><div>{}</div><div class=sidebar><p>x</p></div></body>"])
@pytest.mark.parametrize(
    "inner, kept",
    [
        ("<div class='section-header'><h2>Part two</h2></div>", "Part two"),
        ("<p class='share-price'>The share price rose.</p>", "The share price rose."),
        ("<p class='notice'>Take notice.</p>", "Take notice."),
        ("<h2 id='related-work'>Related work</h2>", "Related work"),
        ("<div class='menu-of-the-day'><p>Soup.</p></div>", "Soup."),
        ("<section class='modal-logic'><h3>Modal logic</h3></section>", "Modal logic"),
        ("<div class='ad'>Buy now</div>", None),
        ("<div class='related-posts'><h3>Related</h3><ul><li><a href=a>One</a></ul></div>", None),
        ("<div class='newsletter box'><p>Subscribe!</p><form><input></form></div>", None),
        ("<aside><p>Beside.</p></aside>", None),
        ("<div hidden><p>Unseen.</p></div>", None),
    ],
)
def test_class_words_within_the_article(shell, inner, kept):
    want = ["Title", P, *([kept] if kept else []), P]
    assert extract(shell.format(ARTICLE.format(inner))) == "\n".join(want)
