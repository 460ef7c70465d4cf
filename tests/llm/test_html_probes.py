"""Pages that broke or slowed the text extraction."""

from __future__ import annotations

import time

import pytest

from tessera.llm import html_text

TALK = "<p>A reader says something long that goes on and on.</p>" * 20


@pytest.mark.parametrize(("page", "text"), [
    ("<article><p title=don't>Hello there</p><p>more</p></article>", "Hello there more"),
    ("<article><p>See <a href=/it's>that</a> page.</p></article>", "See that page."),
    ('<article><p title = "a > b">Hello</p><p data-x=\'>\'>you</p></article>', "Hello you"),
    ("<article><p title=\"it's\" alt='say \"hi\"' x=y\"z>Hello</p></article>", "Hello"),
    ('<p>Open quote <b title="never closed>is read on</b> to the end.</p>', "Open quote is read on to the end."),
    (f'<article><p>The text.</p><div class="comments">{TALK}</div></article>', "The text."),
    (f'<div class="story"><p>The story is told here.</p></div><div class="comments">{TALK}</div>', "The story is told here."),
    (f'<div class="story"><p>The story is told here.</p></div><aside>{TALK}</aside><div id="cookie-notice">{TALK}</div>',
     "The story is told here."),
    (f'<form><p>{"The article in a form. " * 3}</p></form><div id=sidebar>{TALK}</div>', ("The article in a form. " * 3).strip()),
    (f'<div class="layout has-sidebar"><p>{"The page text. " * 9}</p></div>', ("The page text. " * 9).strip()),
    (f'<div id="notice-article"><p>{"The page text. " * 9}</p></div><div class="ads">{TALK}</div>', ("The page text. " * 9).strip()),
])
def test_probes(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "x", "</i><b>" * 100_000, "<p><button>" + "<div>" * 100_000, "<article>" * 100_000 + "x",
    "<div class=menu>" * 100_000 + "x" + "</div>" * 100_000, "<li>" * 100_000, "<table><tr><td>" * 40_000, "<form>" * 100_000 + "x",
    '<a b="' * 100_000, "<a href='x" * 100_000, "<!--" * 100_000, "<" * 100_000])
def test_nesting_takes_linear_time(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 5
