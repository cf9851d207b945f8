"""Main text of small pages, told by hand."""

from __future__ import annotations

import pytest

from quern.llm import main_text

LONG = "A sentence, with commas, that goes on for quite a while so that it scores as a paragraph of prose."
PAGES = {
    "furniture": (f"<nav><a href=/>Home</a></nav><header>Site</header><article><p>{LONG}</p><p>Second.</p></article><aside>More</aside><footer>Foot</footer>", f"{LONG} Second."),
    "inline image": (f"<article><p>foo<img src=x>bar</p><p>{LONG}</p></article>", f"foobar {LONG}"),
    "references": (f"<article><p>a &amp; b &lt;c&gt; &#233; &amp;amp;</p><p>{LONG}</p></article>", f"a & b <c> é &amp; {LONG}"),
    "white space": (f"<article><p> a\n\t b&nbsp;c </p>\n<p>{LONG}</p></article>", f"a b c {LONG}"),
    "inline marks": (f"<article><p>one <b>two</b><i>three</i></p><p>{LONG}</p></article>", f"one twothree {LONG}"),
    "scripts": (f"<article><script>var a = '<p>no</p>';</script><style>p {{}}</style><p>{LONG}</p><form><p>Name</p></form></article>", LONG),
    "unclosed": (f"<article><p>{LONG}<p>Second.<ul><li>one<li>two</ul></article>", f"{LONG} Second. one two"),
    "comments": (f"<div class=content><p>{LONG}</p></div><div class=comments><p>{LONG}</p></div>", LONG),
    "links alone": (f"<div><p>{LONG}</p></div><div><ul><li><a href=a>{LONG}</a></ul></div>", LONG),
    "table": (f"<article><p>{LONG}</p><table><tr><td>a<td>b<tr><td>c</table></article>", f"{LONG} a b c"),
    "two columns": (f"<div class=col><p>{LONG}</p></div><div class=col><p>{LONG}</p></div>", f"{LONG} {LONG}"),
    "own title": (f"<header><h1>Site</h1></header><article><header><h1>The title</h1><p>By A. Writer</p></header><p>{LONG}</p></article>", f"The title {LONG}"),
    "post header": (f"<article><div class=post-header><h2>The title</h2><span>May 5</span></div><p>{LONG}</p></article>", f"The title {LONG}"),
    "hidden": (f"<article><p hidden>no</p><p style='color:red; display: none'>no</p><p aria-hidden=true>no</p><p class=hidden-gem>yes</p><p>{LONG}</p></article>", f"yes {LONG}"),
    "copyright": (f"<article><p>{LONG}</p><div class=copyright>(c) 2020</div><p class=byline>By B.</p></article>", LONG),
    "hidden title": (f"<article><header><h1 hidden>no</h1><h2>yes</h2></header><p>{LONG}</p></article>", f"yes {LONG}"),
    "menu alone": ("<nav><a href=/>Home</a></nav>", ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages_told_by_hand(name):
    source, text = PAGES[name]
    assert main_text.main_text(f"<html><head><title>T</title></head><body>{source}</body></html>") == text


def test_rows(spark):
    page = "<article>" + f"<p>{LONG}</p>" * 2000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", page), (3, "u", page), (None, "u", "<p>\U0001f600 short</p>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0), r["n_chars"]) for r in main_text.extract(pages).collect())
    assert got == [(0, 7), (1, 0), (2, 0), (3, 2000 * (len(LONG) + 1) - 1), (3, 2000 * (len(LONG) + 1) - 1)]
    assert main_text.extract(pages.limit(0)).count() == 0
