"""HTML to Markdown, on the standard library's parser: headings, paragraphs, lists, links, emphasis, code, quotes, tables.
Relative links are resolved against the page's scheme and host. Markdown of other converters may differ in spacing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SKIP = {"script", "style", "noscript", "template", "head", "iframe", "svg"}
_APART = set("p div section article main header footer nav aside ul ol table blockquote figure figcaption form address dl dd dt h1 h2 h3 h4 h5 h6 pre hr".split())


class _Writer(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.skip, self.lists, self.links, self.pre, self.quote, self.row = base, [], 0, [], [], 0, 0, []

    def apart(self) -> None:
        self.out.append("\n\n")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        if self.skip:
            return
        if tag in _APART:
            self.apart() if not (tag in ("ul", "ol") and self.lists) else self.out.append("\n")
        if re.fullmatch("h[1-6]", tag):
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre += 1
            self.out.append("```\n")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("---\n\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * (len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "a":
            self.links.append(a.get("href"))
            self.out.append("[" if a.get("href") else "")
        elif tag == "img" and a.get("src"):
            self.out.append(f"![{a.get('alt') or ''}]({urljoin(self.base, a['src'])})")
        elif tag == "blockquote":
            self.out.append("> ")
        elif tag == "tr":
            self.row = []
            self.out.append("\n|")
        elif tag in ("td", "th"):
            self.out.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.out.append(f"]({urljoin(self.base, href)})" if href else "")
        elif tag in ("td", "th"):
            self.out.append(" |")
            self.row.append(tag)
        elif tag == "tr" and "th" in self.row:
            self.out.append("\n|" + " --- |" * len(self.row))
        if tag in _APART:
            self.apart()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def site_root(url: str) -> str:
    """scheme://host[:port] of a URL, empty where it has none."""
    parts = urlsplit(url or "")
    return f"{parts.scheme}://{parts.netloc.rpartition('@')[2]}" if parts.netloc else ""


def to_markdown(html: str, url: str = "") -> str:
    writer = _Writer(site_root(url))
    writer.feed(html or "")
    writer.close()
    text = "".join(writer.out)
    parts = re.split(r"(```\n.*?\n```)", text, flags=re.S)
    parts = [p if p.startswith("```\n") else re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *(?=\n)|\n +(?=[^-\d|])", "\n", re.sub(r"\n {1}(?=\S)", "\n", p))) for p in parts]
    return re.sub(r"\n{3,}", "\n\n", "".join(parts)).strip()


def html_to_markdown(pages: DataFrame) -> DataFrame:
    """pages (url, html, ...) with a column markdown; null pages are empty."""
    schema = ", ".join(f"`{c}` {t}" for c, t in pages.dtypes if c != "markdown") + ", markdown string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(markdown=[to_markdown(h, u) for h, u in zip(pdf.html, pdf.url, strict=True)])

    return pages.mapInPandas(run, schema)


def host(url: Column) -> Column:
    """The host with its port, without user and password."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("AUTHORITY")), "^.*@", "")
