from __future__ import annotations

import html
import random
import re

import pytest

from machinepulse.llm import html_density, registry
from machinepulse.llm.html_density import Page, densities, extract, main_text
from tests.llm.rows import found, pages

ARTICLE = "<article><h1>Title</h1><p>First <b>bold</b>er text,\n\n  long enough.</p><p>Second.</p></article>"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body",
    [
        ARTICLE,
        f"<nav><ul><li><a href=/x>menu entry</a></li></ul></nav>{ARTICLE}<footer>&copy; foot</footer>",
        f"<header>Site name</header><div class='ad big'>Buy this now, it is long enough too.</div>{ARTICLE}",
        f"{ARTICLE}<div id='comments'><p>A reader writes a lot of words here, more than the article.</p></div>",
        f"<aside>side bar</aside><form>mail <input name=q></form>{ARTICLE}<script>var p = '<p>no</p>';</script>",
        f"<div role='dialog'>We use cookies.</div><!-- <p>comment</p> -->{ARTICLE}",
        f"<div class=cookie-notice>Cookies</div><div><div>{ARTICLE}</div></div><div hidden>x</div>",
        ARTICLE.replace("</p>", "").replace("</article>", ""),  # end tags left out
        ARTICLE.replace("article", "main"),
        f"<div class='cookiebar'>Cookies are used on this site.</div>{ARTICLE}",
        ARTICLE.replace("<h1>", "<div class='post-header'><h1 class=header>").replace("</h1>", "</h1></div>"),
    ],
)
def test_only_the_article_is_left(body):
    assert main_text(page(body)) == "Title First bolder text, long enough. Second."


def test_without_an_article_element_density_decides():
    links = "".join(f"<li><a href='/{k}'>link number {k}</a></li>" for k in range(40))
    text = "".join(f"<p>Paragraph {k} has quite a few words in it, as prose does.</p>" for k in range(6))
    body = f"<div><ul>{links}</ul></div><div><div>{text}</div></div>"
    got = main_text(page(body))
    assert got.startswith("Paragraph 0 has") and got.endswith("as prose does.")
    assert "link number" not in got and got.count("Paragraph") == 6


def paragraphs(first, last):
    return "".join(f"<p>{k}{'x' * 199}</p>" for k in range(first, last))


@pytest.mark.parametrize(
    "body",
    [
        f"<div id=content><div>{paragraphs(0, 3)}</div><div>{paragraphs(3, 5)}</div></div>",
        f"<div><div><div>{paragraphs(0, 1)}</div><div><div>{paragraphs(1, 4)}</div></div>"
        f"<div>{paragraphs(4, 5)}</div></div></div>",
        f"<section>{paragraphs(0, 2)}</section><section>{paragraphs(2, 5)}</section>",
    ],
)
def test_sibling_sections_without_an_article_element(body):
    links = "".join(f"<li><a href='/{k}'>link number {k}</a></li>" for k in range(9))
    expected = " ".join(f"{k}{'x' * 199}" for k in range(5))
    assert main_text(page(body)) == expected
    assert main_text(page(f"<div><ul>{links}</ul></div>{body}")) == expected


WRAPPERS = ["content no-sidebar", "has-sidebar", "layout-sidebar-right", "with-navbar", "widget-area-main"]


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("kind", ["class", "id"])
def test_wrappers_named_after_what_is_beside_them(name, kind):
    beside = "<div class=sidebar><p>Something else is said here.</p></div>"
    assert main_text(page(f"<div {kind}='{name}'>{ARTICLE}{beside}</div>")).startswith("Title First")
    plain = f"<div {kind}='{name}'><div>{paragraphs(0, 3)}</div><div>{paragraphs(3, 5)}</div></div>{beside}"
    assert main_text(page(plain)) == " ".join(f"{k}{'x' * 199}" for k in range(5))


@pytest.mark.parametrize(
    "attrs",
    [
        "class='share-price'", "class='social-policy'", "id=related-work", "title='the hidden story'",
        "class='a hidden b'", "data-x=hidden", "class=section-without-comments",
    ],
)
def test_sections_of_an_article_that_names_do_not_drop(attrs):
    body = f"<article><p>One.</p><div {attrs}><p>Two.</p></div><p>Three.</p></article>"
    assert main_text(page(body)) == "One. Two. Three."


@pytest.mark.parametrize(
    "attrs",
    [
        "hidden", "title='x' hidden", "hidden=''", "HIDDEN id=a", "class=share-buttons", "class='x social-links'",
        "id=related-posts", "class='left-sidebar no-border'", "class=cookie-notice", "class=comments-area",
    ],
)
def test_sections_of_an_article_that_are_dropped(attrs):
    body = f"<article><p>One.</p><div {attrs}><p>Two.</p></div><p>Three.</p></article>"
    assert main_text(page(body)) == "One. Three."


def test_references_and_white_space():
    assert main_text("<p>a&nbsp;&lt;b&gt; &amp;amp; &#228;&eacute; \t c<br>d</p>") == "a <b> &amp; äé c d"
    assert main_text("<p>one</p>two<div>three<span> four</span></div>") == "one two three four"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("<", ""), ("plain", "plain"), ("<p></p>", ""), ("<!-- x", ""),
        ("<script>x", ""), ("<p>cut <b", "cut"), ('<p title="a>b">q</p>', "q"), ("</p></div>z", "z"),
        ("<nav>only menu</nav>", ""), ("<P>Up</P>", "Up"), ("a < b", "a < b"),
    ],
)
def test_odd_pages(source, text):
    assert main_text(source) == text


def test_very_long_and_deep_pages():
    assert main_text("<div>" * 30_000 + "deep") == "deep"
    long = main_text("<article>" + "<p>word word</p>" * 50_000 + "</article>")
    assert long == " ".join(["word word"] * 50_000)


def test_links_lower_the_density():
    linked = Page("<body><p>some words of text here</p><p><a>some words of text here</a></p></body>")
    density, total, body = densities(linked)
    plain, full = (i for i, t in enumerate(linked.tags) if t == "p")
    assert density[plain] > density[full] >= 0 and total[body] == density[plain] + density[full]


def test_all_given_pages_against_a_plain_cut(spark):
    """The given pages have one article each, which regular expressions can cut out."""

    def cut(source):
        inside = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", source, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", inside).replace("<br>", " "))
        plain = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
        return " ".join(b for b in plain if b)

    sf = "/root/testdata/sf0.01"
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = registry.op1_html_density(spark, sf).collect()
    assert len(rows) == len(sources)
    for row in rows:
        assert row.text == cut(sources[row.page_id]) and row.n_chars == len(row.text)


def test_tables(spark):
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, None, None)]
    assert found(extract(pages(spark, *rows)), "page_id", "text") == [(None, ""), (1, "x"), (1, "x")]
    assert extract(pages(spark, *rows).limit(0)).collect() == []


def plain_densities(source: str):
    """Composite densities as the definition has them, every subtree walked anew."""
    import math

    page = html_density.Page(source)
    n = len(page.tags)
    body = page.tags.index("body") if "body" in page.tags else 0

    def below(node):
        out = [node]
        for child in range(node + 1, n):
            if page.parent[child] == node:
                out += below(child)
        return out

    def counts(node):
        nodes = set(below(node)) - {i for i in range(n) if page.noise[i]} | {node}
        size = lambda t: len(t) - t.count(" ")
        chars = sum(size(t) for o, t in page.events if t and o in nodes)
        links = [i for i in nodes if page.tags[i] == "a"]
        inside = {i for a in links for i in below(a)}
        link_chars = sum(size(t) for o, t in page.events if t and o in nodes & inside)
        return chars, len(nodes) - 1, link_chars, len([a for a in links if a != node])

    body_chars, _, body_links, _ = counts(body)
    density = [0.0] * n
    for node in range(n):
        if page.noise[node]:
            continue
        c, t, lc, lt = counts(node)
        if c:
            t = max(t, 1)
            base = math.log(c / max(c - lc, 1) * lc + body_links / max(body_chars, 1) * c + math.e)
            ratio = (c / max(lc, 1)) * (t / max(lt, 1))
            density[node] = c / t * math.log(1 + ratio) / math.log(1 + base)
    total = [sum(density[c] for c in range(1, n) if page.parent[c] == i) for i in range(n)]
    return page, density, total, body


def test_densities_are_those_of_walking_every_subtree():
    rng = random.Random(8)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(30)))
        tag = rng.choice(["div", "p", "a", "span", "ul", "section", "b"])
        inner = "".join(tree(depth - 1) for _ in range(rng.randrange(1, 4)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(60):
        source = f"<html><body>{tree(5)}{tree(4)}</body></html>"
        page, density, total, body = plain_densities(source)
        got_density, got_total, got_body = html_density.densities(page)
        assert got_body == body
        assert got_density == pytest.approx(density) and got_total == pytest.approx(total)


LONG = "A sentence of the article with quite some words in it. " * 8


def test_a_page_wrapped_in_one_form_keeps_its_text():
    page = (
        "<body><form id=aspnetForm action=/x><div class=content><p>" + LONG + "</p><p>" + LONG
        + "</p></div><div><input name=q><button>Go</button></div></form></body>"
    )
    assert html_density.main_text(page).count("A sentence") == 16
    search = f"<body><form>Search here <input></form><div><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert "Search" not in html_density.main_text(search)
    fieldset = f"<body><div><p>{LONG}</p><fieldset>Your vote</fieldset><p>{LONG}</p></div></body>"
    assert "vote" not in html_density.main_text(fieldset)


def test_lists_of_links_in_main_stay_out():
    links = "".join(f"<li><a href=/{i}>Another page of this site {i}</a></li>" for i in range(30))
    text = f"<div><h1>The title</h1><p>{LONG}</p><p>{LONG}</p></div>"
    for box in ("<div><ul>{}</ul></div>", "<ul>{}</ul>"):
        got = html_density.main_text(f"<body><main>{text}{box.format(links)}</main></body>")
        assert got.startswith("The title") and "Another page" not in got and got.count("A sentence") == 16
    article = f"<body><main><article>{text}<ul>{links}</ul></article></main></body>"
    assert html_density.main_text(article).count("A sentence") == 16
