"""Main text of pages and windows of texts, against goldens and plain loops."""

from __future__ import annotations

import random

import pytest

from offerscope.operators.chunk import text_windows
from offerscope.sources.html import html_to_text, main_text

PARAGRAPH = "A plain paragraph that says what the page is about, in so many words."
MENU = "<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul>"


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<header>{PARAGRAPH}</header>", PARAGRAPH),  # all text stands in a header
        (f"<nav>{MENU}<p>{PARAGRAPH}</p></nav><p>x</p>", f"One\nTwo\nThree\n{PARAGRAPH}\nx"),  # most text stands in a nav
        (f"<nav>{MENU}</nav><p>{PARAGRAPH}</p><footer>All rights</footer>", PARAGRAPH),
        (f"<form><nav>{MENU}</nav><p>{PARAGRAPH}</p></form>", PARAGRAPH),  # the whole page within a form
        (f"<div class='search-content'><p>{PARAGRAPH}</p></div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>", "\n".join([PARAGRAPH] * 3)),  # a frame's name, but plain text
        (f"<div class='main_menu'>{MENU}</div><p>{PARAGRAPH}</p>", PARAGRAPH),  # a frame's name and links
        (f"<main>{MENU}</main>", "One\nTwo\nThree"),  # a page that is a list of links
        ("<header><p>short one</p></header><nav><a>two</a></nav><footer>three and more words</footer>", "three and more words"),  # only frames, none with half of the text
        ("<script>x()</script><style>p{}</style><noscript>no</noscript>", ""),
        ("", ""), (None, ""), ("plain &amp; simple", "plain & simple"), ("<p>one<p>two</b></p></div>three", "one\ntwo\nthree"), ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"),
    ],
)
def test_main_text(page, text):
    assert main_text(page)[1] == text


@pytest.mark.parametrize(
    "page,title",
    [("<title>T</title><h1>H <b>one</b></h1>", "H one"), ("<title> T  t </title><p>x", "T t"), ("<meta property='og:title' content='O &amp; o'><title>T</title><h1>H</h1>", "O & o"), ("<meta property='og:title'><h1> </h1><title>T</title>", "T"), ("<p>x", "")],
)
def test_title(page, title):
    assert main_text(page)[0] == title


def test_no_page_with_text_comes_out_empty():
    rng = random.Random(4)
    tags = ["div", "nav", "header", "footer", "aside", "p", "a", "section", "form", "ul", "li", "div class='menu'", "div id='footer'"]
    for _ in range(600):
        page, stack, said = "", [], False
        for _ in range(rng.randint(1, 30)):
            kind = rng.random()
            if kind < 0.4:
                stack.append(rng.choice(tags))
                page += f"<{stack[-1]}>"
            elif kind < 0.6 and stack:
                page += f"</{stack.pop().split()[0]}>"
            else:
                said = True
                page += " ".join(rng.choices(["some", "words", "here"], k=rng.randint(1, 6))) + " "
        assert bool(main_text(page)[1]) == said, page


def test_pages_table(spark):
    rows = [(1, f"<title>T</title><nav>{MENU}</nav><p>{PARAGRAPH}"), (2, None), (None, "<p>x")]
    got = html_to_text(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert {(r.page_id, r.title, r.text) for r in got} == {(1, "T", PARAGRAPH), (2, "", ""), (None, "", "x")}
    assert html_to_text(spark.createDataFrame([], "page_id long, html string")).collect() == []


def plain_windows(text, size, overlap):
    """Character by character."""
    text, out, at = (text or "").strip(" \t\n\x0b\f\r"), [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            for p in range(end - 1, at + int(size * 0.65) - 1, -1):
                if text[p] == "\n" or (text[p : p + 2] in (". ", "; ") and p + 2 <= end):
                    end = p + 1
                    break
        end = min(end, len(text))
        if text[at:end].strip(" \t\n\x0b\f\r"):
            out.append(text[at:end].strip(" \t\n\x0b\f\r"))
        if end == len(text):
            break
        at = max(end - overlap, at + 1)
        for p in range(at, min(end + 1, len(text))):
            if text[p] == " ":
                at = p + 1
                break
    return out


@pytest.mark.parametrize("size,overlap", [(10, 3), (40, 0), (40, 39), (100, 20)])
def test_windows_equal_a_plain_loop(spark, size, overlap):
    rng = random.Random(size + overlap)
    texts = ["".join(rng.choices(["ab", "c", " ", ". ", "; ", "\n", "é", "😀", "wxyz", "."], k=rng.randint(0, 200))) for _ in range(80)] + [None, "", "  ", "x" * 500, " " * 300 + "y"]
    got = {}
    for r in text_windows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size, overlap).orderBy("doc_id", "chunk_index").collect():
        assert r.chunk_index == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append(r.chars)
    assert got == {i: w for i, w in ((i, plain_windows(t, size, overlap)) for i, t in enumerate(texts)) if w}


def test_windows_of_text_keys(spark):
    df = spark.createDataFrame([("k", "one two. three")], "key string, body string")
    assert [tuple(r) for r in text_windows(df, 9, 2, "key", "body").collect()] == [("k", 0, "one two."), ("k", 1, "three")]
    with pytest.raises(ValueError):
        text_windows(df, 5, 5, "key", "body")
