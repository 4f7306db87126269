"""Pages of layouts that aren't labelled, each with its main text."""

import pytest

from probewise.llm import html_text

LINE = "Long ago the river ran further to the north, and nobody knows why it moved."
OTHER = "Some say that the hills were raised, others that people dug a new bed for it."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">Books</a></li></ul></nav>'
FOOTER = "<footer><p>Copyright of this site.</p></footer>"

LAYOUTS = {
    "article in plain divs": (f"<html><body>{NAV}<div><div>{LINE}</div><div>{OTHER}</div></div>{FOOTER}</body></html>", [LINE, OTHER]),
    "form around the page": (
        f'<html><body><form id="form1" action="x">{NAV}<div><p>{LINE}</p><p>{OTHER}</p></div><div class="search">Find <input></div></form></body></html>',
        [LINE, OTHER],
    ),
    "short article, unlabelled comment": (
        f"<html><body>{NAV}<article><p>The river moved.</p><p>Nobody knows why.</p></article><div>I think I know very well.</div></body></html>",
        ["The river moved.", "Nobody knows why."],
    ),
    "short article, long unlabelled comments": (
        f"<html><body>{NAV}<article><h1>River</h1><p>The river moved.</p></article><div>{LINE} {OTHER}</div><div>{OTHER}</div></body></html>",
        ["River", "The river moved."],
    ),
    "unlabelled comments in main": (
        f"<html><body>{NAV}<main><article><h1>River</h1><p>{LINE}</p></article><div><p>{OTHER}</p></div></main>{FOOTER}</body></html>",
        ["River", LINE],
    ),
    "form around an article, another one in it": (
        f"<form>{NAV}<article><h1>River</h1><p>{LINE}</p><form class='newsletter'><p>Subscribe to all of our news now.</p></form><p>{OTHER}</p></article></form>",
        ["River", LINE, OTHER],
    ),
    "form that never ends": (f"<body><form><input name=q><article><p>{LINE}</p><p>{OTHER}</p></article></body>", [LINE, OTHER]),
    "comment form beside a short text": (
        "<article><p>The river moved.</p></article><form><p>Write what you think</p><select><option>one two three four<option>five six</select></form>",
        ["The river moved."],
    ),
    "cells of a table": (
        f'<table><tr><td class="menu"><a href="/">Home</a><br><a href="/b">Books</a></td><td>{LINE}<br><br>{OTHER}</td></tr></table>',
        [f"{LINE} {OTHER}"],
    ),
    "title outside the article": (
        f"<html><body>{NAV}<main><h1>How the river moved</h1><article><p>{LINE}</p></article></main>{FOOTER}</body></html>",
        ["How the river moved", LINE],
    ),
    "sections without classes": (f"<body>{NAV}<section><h2>River</h2><p>{LINE}</p></section><section><h2>Hills</h2><p>{OTHER}</p></section>{FOOTER}", ["River", LINE, "Hills", OTHER]),
    "divs of spans": (f"<div class='menu'><a href='/'>Home</a></div><div><div><span>{LINE}</span></div><div><span>{OTHER}</span></div></div>", [LINE, OTHER]),
    "text without any element": (f"{LINE} &lt;3", [f"{LINE} <3"]),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layout(name):
    page, blocks = LAYOUTS[name]
    assert html_text.main_blocks(page, html_text.fit()) == blocks


def test_forms_of_a_page():
    """Only the form that holds most words is the page's; the words of controls don't count."""

    def of(page):
        return html_text.outline(list(html_text.events(page)))

    assert of("<p>one two</p><form>three</form>") == (set(), frozenset())
    assert of("<form><p>one two</p></form>three")[0] == {0}
    assert of("one<form><select><option>two three four</select></form>")[0] == set()
    assert of("<form><form>a</form></form>")[0] == {0, 1}
    assert of("<main></main><article>a</article>")[1] == {html_text.BESIDE["article"]}
    assert of("</form></main><form>") == (set(), frozenset())
