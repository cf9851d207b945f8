"""Column builders over crawled pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Element kinds that are dropped with what they hold, entities in the order of decoding, binary file endings.
DROPPED = ["script", "style", "noscript", "svg", "iframe", "nav", "footer", "header"]
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&mdash;", "—"), ("&ndash;", "–")]
BINARY = r"(?i)\.(png|jpg|jpeg|gif|webp|svg|pdf|zip|tar|gz|exe|dmg|mp4|mp3|avi|mov)$"


def clean_text(html: Column) -> Column:
    """A page as light markdown: furniture dropped, headings #, code, lists, entities decoded, blanks squeezed."""
    steps = [(rf"(?is)<{k}\b.*?</{k}>", " ") for k in DROPPED]
    steps += [(rf"(?is)<h{k}[^>]*>(.*?)</h{k}>", f"\n\n{'#' * k} $1\n\n") for k in (1, 2, 3, 4)]
    steps += [
        (r"(?is)<pre[^>]*><code[^>]*>(.*?)</code></pre>", "\n```\n$1\n```\n"), (r"(?is)<code[^>]*>(.*?)</code>", "`$1`"), (r"(?is)<li[^>]*>(.*?)</li>", "\n- $1"),
        (r"(?is)<p[^>]*>(.*?)</p>", "\n\n$1\n\n"), (r"(?i)<br\s*/?>", "\n"), (r"(?i)<hr\s*/?>", "\n---\n"), ("<[^>]+>", " "),
        *[(f"(?i){a}", b) for a, b in ENTITIES], (r"[ \t]+", " "), (r"\n\s*\n\s*\n+", "\n\n"), (r"^\s+|\s+$", ""),
    ]
    return reduce(lambda c, s: F.regexp_replace(c, *s), steps, F.coalesce(html, F.lit("")))


def title(html: Column, url: Column) -> Column:
    """The title element, else the first heading, else the last path part or host of the address."""
    inner = lambda tag: F.trim(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", ""))
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+/(?:[^?#]*/)?([^/?#]+)/*(?:[?#]|$)", 1)
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1)
    return F.coalesce(*[F.when(c != "", c) for c in (inner("title"), inner("h1"), path, host)], F.lit("Web Document"))


def internal_links(html: Column, url: Column) -> Column:
    """Distinct links to the page's own host, without query, fragment, trailing slash and binary files."""
    origin, host = F.regexp_extract(url, "^([a-z]+://[^/?#]+)", 1), F.regexp_extract(url, "^[a-z]+://([^/?#:]+)", 1)
    hrefs = F.transform(F.regexp_extract_all(html, F.lit("(?i)href=[\"']([^\"']+)[\"']"), F.lit(1)), F.trim)
    folder = F.regexp_replace(F.regexp_extract(url, "^([a-z]+://[^?#]*)", 1), "[^/]*$", "")

    def resolve(href: Column) -> Column:
        full = (
            F.when(href.rlike("^(javascript|mailto|tel):"), None)
            .when(href.rlike("^[a-z]+://"), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract(url, "^([a-z]+:)", 1), href))
            .when(href.startswith("/"), F.concat(origin, href))
            .otherwise(F.concat(folder, href))
        )
        return F.regexp_replace(F.regexp_replace(full, "[?#].*$", ""), "/+$", "")

    full = F.transform(hrefs, resolve)
    own = F.filter(full, lambda u: u.isNotNull() & (F.regexp_extract(u, "^[a-z]+://([^/?#:]+)", 1) == host) & ~u.rlike(BINARY))
    return F.array_distinct(own)
