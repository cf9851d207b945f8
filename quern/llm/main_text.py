"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Each paragraph passes points for its length and commas to its
parent, half of them to the next ancestor and less beyond; an element's points are discounted by the
share of its characters that are links. The best element, or the article around it, is the container,
and siblings that score or read like it are kept with it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element kinds and the words by which page furniture names itself.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object svg math title select".split())
DROPPED = RAW | frozenset("head nav header footer aside form button menu dialog fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that stand inside a line and hold no text of their own.
IN_LINE = INLINE | frozenset("img embed input source track param area".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WALLS = frozenset("html body article main section div table ul ol dl td th blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|side-?bar|comments?|commentlist|respond|replies|disqus|shar(?:e|ing)|social|related|"
    r"recommend\w*|newsletter|subscri\w*|popup|modal|breadcrumbs?|pag(?:ination|er)|menu|nav|navbar|navigation|footer|header|masthead|widget|toolbar|login|signup|skip|copyright|by-?line)(?=$|[\s_-])"
)
PROSE = re.compile(r"(?:^|[\s_-])(?:article|content|main|body|post|entry|story|text|page)(?=$|[\s_-])")
ALWAYS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|cookies?|side-?bar|comments?|commentlist|disqus|promo\w*|copyright|by-?line)(?=$|[\s_-])")
HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)(?!\s*=\s*["']?until-found)|\baria-hidden\s*=\s*["']?true|\bstyle\s*=\s*(?:"[^"]*|'[^']*|\S*?)\b(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
#: Of a header inside an article its titles stay.
TITLES = frozenset("h1 h2 h3".split())
PRIOR = {"article": 25, "main": 25, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "form": -3, "th": -5}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/a-zA-Z][^>]*\Z""", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


class Page:
    """Elements as parallel lists (parent, name, dropped, prior) and runs (element, block, text) in page order."""

    def __init__(self, source: str):
        self.parent, self.name, self.dropped, self.prior = [-1], ["#root"], [False], [0]
        #: Whether an article holds the element; in an article's header, whether what is around that is dropped.
        self.article, self.around = [False], [None]
        self.runs: list[tuple[int, int, str]] = []
        self._block, self._open = 0, [0]
        at = 0
        while found := TAG.search(source, at):
            self._text(source[at : found.start()])
            at = found.end()
            end, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not name:
                continue
            name = name.lower()
            if name not in IN_LINE:
                self._block += 1
            if end:
                self._close(name)
                continue
            self._start(name, attributes)
            if name in RAW and not attributes.endswith("/"):
                shut = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = shut.end() if shut else len(source)
                self._close(name)
        self._text(source[at:])

    def _text(self, text: str) -> None:
        if text:
            self.runs.append((self._open[-1], self._block, html.unescape(text) if "&" in text else text))

    def _start(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._end_open(("p",), WALLS)
        elif name in ENDS:
            self._end_open(ENDS[name], {"ul", "ol", "dl", "table"})
        if name in VOID:
            return
        up = self._open[-1]
        named = {k.lower(): (a or b or c).lower() for k, a, b, c in NAMES.findall(attributes)} if attributes else {}
        words = f"{named.get('class', '')} {named.get('id', '')}"
        furniture = name not in ("html", "body", "article", "main") and bool(
            named.get("role") in ROLES or FURNITURE.search(words) and (ALWAYS.search(words) or not PROSE.search(words))
        )
        around, own = self.around[up], name in DROPPED or furniture or bool(attributes and HIDDEN.search(attributes))
        dropped = self.dropped[up] or own
        if around is not None and name in TITLES:
            around, dropped = None, around or own
        elif around is None and self.article[up] and (name == "header" or HEADER.search(words)):
            around, dropped = self.dropped[up], True
        self.parent.append(up)
        self.name.append(name)
        self.article.append(self.article[up] or name in ("article", "main"))
        self.around.append(around)
        self.dropped.append(dropped)
        self.prior.append(PRIOR.get(name, 0) + 25 * bool(PROSE.search(words)) + 25 * (named.get("role") == "main"))
        self._open.append(len(self.name) - 1)

    def _end_open(self, names: tuple[str, ...], walls) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self.name[self._open[k]] in names:
                del self._open[k:]
                return
            if self.name[self._open[k]] in walls:
                return

    def _close(self, name: str) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self.name[self._open[k]] == name:
                del self._open[k:]
                return
            if name in INLINE and self.name[self._open[k]] not in INLINE:
                return

    def blocks(self, keep: list[bool]) -> str:
        """The kept runs: white space made one space, blocks joined by one."""
        found: dict[int, list[str]] = {}
        for node, block, text in self.runs:
            if keep[node]:
                found.setdefault(block, []).append(text)
        return " ".join(x for x in (" ".join("".join(parts).split()) for parts in found.values()) if x)

    def container(self) -> list[int]:
        """The elements whose subtrees are the main text; none if no text is left outside page furniture."""
        n = len(self.name)
        chars, linked, points = [0] * n, [0] * n, [0.0] * n
        paragraphs: dict[int, list[int]] = {}
        for node, _, text in self.runs:
            size = len(text) - text.count(" ") if not self.dropped[node] else 0
            if not size or text.isspace():
                continue
            chars[node] += size
            holder, link = node, False
            while holder > 0 and self.name[holder] in INLINE:
                link |= self.name[holder] == "a"
                holder = self.parent[holder]
            linked[node] += size * link
            told = paragraphs.setdefault(holder, [0, 0])
            told[0] += size * (not link)
            told[1] += text.count(",") + text.count("，")
        if not paragraphs:
            return []
        for node, (size, commas) in paragraphs.items():
            given = 1 + commas + min(size / 100, 3 + commas)
            part, share = self.parent[node] if node else 0, 1.0
            points[node] += 0.5 * given
            for level in range(4):
                points[part] += given * share
                share = 0.5 if level == 0 else share / 2
                if part == 0:
                    break
                part = self.parent[part]
        for node in range(n - 1, 0, -1):  # children come after their parents
            chars[self.parent[node]] += chars[node]
            linked[self.parent[node]] += linked[node]
        density = [linked[i] / chars[i] if chars[i] else 1.0 for i in range(n)]
        score = [(points[i] + self.prior[i]) * (1 - density[i]) if points[i] and not self.dropped[i] else 0.0 for i in range(n)]
        best = max(range(n), key=lambda i: (score[i], -i))
        top = best
        while best > 0 and self.name[best] not in ("article", "main"):
            best = self.parent[best]
        best = best or top
        kept = [best]
        for node in range(1, n):
            if node != best and self.parent[node] == self.parent[best] and best and not self.dropped[node] and chars[node]:
                like = score[node] >= 0.2 * score[best] > 0
                prose = self.name[node] == "p" and density[node] < 0.25 and chars[node] > 80
                if (like and density[node] < 0.5) or prose:
                    kept.append(node)
        return kept


def main_text(source: str | None) -> str:
    """The main text of one page; null and empty pages, and pages of furniture alone, have an empty one."""
    if not source:
        return ""
    page = Page(source)
    inside = [False] * len(page.name)
    for node in page.container():
        inside[node] = True
    for node in range(1, len(inside)):
        inside[node] = inside[node] or inside[page.parent[node]]
    return page.blocks([a and not b for a, b in zip(inside, page.dropped, strict=True)])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html; others are not read): page_id, url, text, n_chars.

    The whole html is read, however long, character references are decoded once, and n_chars counts code points. Null and
    empty html and pages of furniture alone give an empty text; repeated rows are each told. An empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": [main_text(x) for x in part["html"]]})

    narrow = pages.select("page_id", "url", "html")
    schema = f"page_id {narrow.schema['page_id'].dataType.simpleString()}, url string, text string"
    return narrow.mapInPandas(run, schema).withColumn("n_chars", F.length("text").cast("bigint"))
