"""Tree scoring on whole pages: the article and nothing else."""

import html
import re

from formulake.llm import page_text as P
from formulake.llm.common import read

FILL = "Here are enough words, with a comma, to look like a paragraph of an article. " * 2


def page(body, head="<title>T</title><style>p{}</style><script>var a='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_article_without_what_surrounds_it():
    got = P.main_text(page(
        "<nav><ul><li><a href='/a'>Menu</a></li></ul></nav><header>Site</header>"
        "<div class='cookie-notice'>We use cookies, and more, and more.</div>"
        f"<article><h1>Title &amp; more</h1><p>{FILL}<b>bold</b>face<p>Second, un&#99;losed &nbsp; one.<br>line"
        "<ul><li>one<li>two</ul><div class=ad>Buy, buy, buy</div><form><p>Your name, please</p></form>"
        "<script>x < 1 && '<p>no</p>'</script><!-- <p>not this</p> --></article>"
        f"<section id='comments'><p>{FILL}</p></section><aside><p>{FILL}</p></aside><footer>&copy; x</footer>"
    ))
    assert got == f"Title & more {FILL}boldface Second, unclosed one. line one two".replace("  ", " ")


def test_no_article_element():
    links = "".join(f"<li><a href='{i}'>A linked title, number {i}, of a list</a></li>" for i in range(30))
    got = P.main_text(page(
        f"<div class='wrap with-sidebar'><div><p>{FILL}</p><p>{FILL}</p><p>Short one.</p></div>"
        f"<p>{FILL}and a sibling.</p><div class='sidebar'><p>{FILL}</p></div><ul>{links}</ul></div>"
    ))
    assert got == " ".join([FILL.strip()] * 2 + ["Short one."] + [FILL + "and a sibling."])
    assert P.main_text(page(f"<div>{FILL}<br><br>{FILL}</div><div><a href=x>links</a></div>")) == " ".join([FILL.strip()] * 2)


def test_sections_side_by_side_keep_headings_and_short_ends():
    def body(*sections, after=""):
        parts = "".join(f"<h2>{h}</h2><div class=s>{t}</div>" for h, t in sections)
        return page(f"<nav><a href=x>Menu</a></nav><div id=c><h1>Title</h1>{parts}{after}</div><footer>end</footer>")

    two = f"<p>{FILL}</p><p>{FILL}</p>"
    got = P.main_text(body(("Sub one", two), ("Sub two", "<p>Short end.</p>")))
    assert got == f"Title Sub one {FILL.strip()} {FILL.strip()} Sub two Short end."
    five = [(f"Part {k}", f"<p>{FILL}</p>" if k % 2 else "<p>Short one.</p>") for k in range(5)]
    links = "<h3>Read on</h3><ul>" + "".join(f"<li><a href={k}>Another title</a></li>" for k in range(5)) + "</ul>"
    got = P.main_text(body(("Sub one", two), ("Sub two", "<p>Short end.</p>"), after=links))
    assert got == f"Title Sub one {FILL.strip()} {FILL.strip()} Sub two Short end."
    got = P.main_text(body(*five))
    assert got == "Title " + " ".join(f"Part {k} {FILL.strip() if k % 2 else 'Short one.'}" for k in range(5))
    got = P.main_text(page(f"<div><h2>Alone</h2><div><p>{FILL}</p><p>{FILL}</p></div><div>Copyright holder</div></div>"))
    assert got == f"Alone {FILL.strip()} {FILL.strip()}"


def test_broken_and_odd_pages():
    assert P.main_text(None) == P.main_text("") == P.main_text("<p></p>") == P.main_text("<!-- x") == ""
    assert P.main_text("just text") == "just text"
    assert P.main_text("<head><title>x</title><p>In the body") == "In the body"
    assert P.main_text("<article><p>a < b and c > d <p>&lt;tag&gt; &#x41;") == "a < b and c > d <tag> A"
    assert P.main_text("<div>" * 5000 + f"<p>{FILL}</p>") == FILL.strip()
    assert P.main_text("<article><p class=x title=don't>It's <a href=/x/>one</a>.</p></article>") == "It's one."
    assert P.main_text("<article><p>One<p " + "a='" * 3000) != ""
    long = "word, " * 300_000
    assert P.main_text(f"<article><p>{long}</p></article>") == long.strip()
    assert P.main_text("<article><p title='a > b'>One</p><p>One</p></article>") == "One One"


def naive(text):
    """The one article of a generated page, its tags gone."""
    inside = re.search(r"<article>(.*?)</article>", text, re.S)[1]
    parts = re.split(r"</?(?:p|h1|h2|br|ul|li|div)\b[^>]*>", inside)
    clean = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in parts]
    return " ".join(x for x in clean if x)


def test_given_pages(spark):
    pages = read(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in P.extract(pages).collect()}
    given = pages.collect()
    assert len(got) == len(given)
    for r in given:
        assert got[r.page_id].text == naive(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_null_and_repeated_rows(spark):
    table = spark.createDataFrame(
        [(1, "u", None, 3), (1, "u", "<p>x</p>", 3), (1, "u", "<p>x</p>", 3), (None, None, "", 4)],
        "page_id bigint, url string, html string, n_chars int",
    )
    got = P.extract(table)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.text, r.n_chars) for r in got.collect()) == [("", 0), ("", 0), ("x", 1), ("x", 1)]
    assert P.extract(table.limit(0)).count() == 0


def test_frames_with_telling_names_keep_their_article():
    article = f"<h2>On it</h2><p>{FILL}</p><p>{FILL}</p>"
    expected = f"On it {FILL}{FILL}".strip()
    names = ["post commentary", "layout sidebar-left", "wrapper header-fixed",
             "entry category-social-science", "page navy-theme", "shared-column"]
    for name in names:
        side = f"<div class='sidebar'><p>{FILL[:60]}</p></div>"
        assert P.main_text(page(f"<div class='{name}'>{article}</div>{side}")) == expected, name
        assert P.main_text(page(f"<div class='{name}'><div>{article}</div>{side}</div>")) == expected, name
    assert P.main_text(page(f"<form action=x><div>{article}</div></form>")) == expected
    assert P.main_text(page(f"<div id='comments'>{article}</div>")) == expected  # nothing else is there


def test_long_talk_is_not_the_article():
    talk = "".join(f"<div class='comment'><p>{FILL}</p></div>" for _ in range(4))
    got = P.main_text(page(f"<article><p>{FILL}</p></article><section id='comments'>{talk}</section>"))
    assert got == FILL.strip()
