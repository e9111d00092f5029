"""HTML pages to Markdown-like text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievelake.functions.text import clean_text
from sievelake.storage import ship_package

# --- Fixed values: what is boilerplate ---
DROPPED_TAGS = {"script", "style", "nav", "footer", "header", "form", "input", "button"}
DROPPED_CLASSES = {"sidebar", "nav", "footer", "header", "menu", "comments", "comment", "widget", "meta", "tags"}
DROPPED_IDS = {"comments"}
# --- End of fixed values ---

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "div", "section", "article", "main", "table", "ul", "ol", "blockquote", "figure", "dl", "body", "html", "tr"}
_MARK = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}


class _Reader(HTMLParser):
    """One pass over a page: what stands in dropped elements goes, headings, lists, emphasis and code are marked."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.stack: list[tuple[str, bool]] = []
        self.lists: list[list] = []
        self.pre = self.dropped = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        of = dict(attrs)
        drop = tag in DROPPED_TAGS or bool(DROPPED_CLASSES & set((of.get("class") or "").split())) or (of.get("id") or "") in DROPPED_IDS
        if tag in _VOID:
            if not self.dropped and not drop:
                self.out.append("\n" if tag == "br" else "\n\n---\n\n" if tag == "hr" else "")
            return
        self.stack.append((tag, drop))
        self.dropped += drop
        if self.dropped:
            return
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n\n" if len(self.lists) == 1 else "\n")
        elif tag == "li":
            self.out.append("\n" + "  " * (len(self.lists) - 1))
            if self.lists:
                self.lists[-1][1] += 1
            self.out.append(f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "* ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag in _BLOCK:
            self.out.append("\n\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in _MARK and not self.pre:
            self.out.append(_MARK[tag])

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            name, drop = self.stack.pop()
            was = self.dropped
            self.dropped -= drop
            if not was:
                self._close(name)
            if name == tag:
                return

    def _close(self, tag: str) -> None:
        if tag == "pre":
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n\n" if not self.lists else "\n")
        elif tag in _BLOCK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")
        elif tag in _MARK and not self.pre:
            self.out.append(_MARK[tag])

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.out.append(data if self.pre else re.sub(r"[ \t\r\n\f]+", " ", data))


def html_to_markdown(page: str | None) -> str:
    if not page or not page.strip():
        return ""
    reader = _Reader()
    reader.feed(page)
    reader.close()
    lines = "".join(reader.out).split("\n")
    return "\n".join(line.rstrip() if line.strip() else "" for line in lines)


def clean_html(html: Column) -> Column:
    """Parsing in Arrow batches, then the text rules in the JVM."""
    if spark := SparkSession.getActiveSession():
        ship_package(spark)

    @F.pandas_udf(StringType())
    def parse(pages: pd.Series) -> pd.Series:
        return pages.map(html_to_markdown)

    return clean_text(parse(html))
