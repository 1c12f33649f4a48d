"""Line blocks of pages without telling tags or names, and articles that tags or names could hide."""

import pytest

from acadia.llm import html_extract

LONG = ["The first paragraph of the text says what it is about, at some length, and goes on for a while until it ends.",
        "A second one adds to it, with as many words as such a paragraph has in most texts of this kind, more or less."]


def _divs(*texts):
    return "".join(f"<div>{t}</div>" for t in texts)


def test_windows_decide_on_bare_divs(monkeypatch):
    menu, foot = ["Home", "News", "Sport", "Weather", "Jobs"], ["Imprint", "Contact", "Press", "Terms"]
    body = ["A title", LONG[0], "In short.", "Yes.", "No.", "Really?", LONG[1], "The end."]
    page = f"<body><div>{_divs(*menu)}</div><div><div>{_divs(*body)}</div></div><div>{_divs(*foot)}</div></body>"
    assert html_extract.main_text(page) == " ".join(body)
    flat = _divs(*menu, *LONG, *foot)
    assert html_extract.main_text(flat) == " ".join(LONG)
    monkeypatch.setattr(html_extract, "WINDOW", 1)
    assert html_extract.main_text(page) == " ".join(LONG)


def test_surge_follows_the_page():
    short = [f"line {i} of verse" for i in range(6)]
    assert html_extract.main_text(_divs(*short)) == " ".join(short)
    assert html_extract.main_text(_divs("x" * 5000, "", "", *LONG)) == " ".join(["x" * 5000, *LONG])


@pytest.mark.parametrize("page", [
    "<script>var s = '<main >';</script>" + _divs(*LONG), "<!-- <article> -->" + _divs(*LONG), '<div title="<article>">' + _divs(*LONG) + "</div>",
    _divs(*LONG) + "<article class='comment'>I agree.</article><article class='comment'>So do I.</article>",
    _divs(*LONG) + "<aside><article>A teaser</article></aside>", "<main></main>" + _divs(*LONG), "<article> </article>" + _divs(*LONG),
])
def test_a_named_article_without_the_text_hides_nothing(page):
    assert html_extract.main_text(page) == " ".join(LONG)


@pytest.mark.parametrize("tag", [
    'section id="discussion"', 'section id="legal"', 'h2 id="related-work"', 'div class="header"', 'ul class="tags"', 'p class="search"',
    'div class="side"', 'div class="replies"', 'h2 class="related"',
])
def test_names_inside_an_article_hide_no_text(tag):
    assert html_extract.main_text(f"<article><p>A</p><{tag}>B</{tag.split()[0]}><p>C</p></article>") == "A B C"


def test_teasers_do_not_stand_for_the_article():
    teasers = "".join(f"<article><p>More {i}</p></article>" for i in range(3))
    got = html_extract.main_text(_divs(*LONG) + "<div><div><div>" + teasers)
    assert got.startswith(" ".join(LONG))
    assert html_extract.main_text("<article><p>A</p><div class='newsletter'>no</div></article><p>out</p>") == "A"
