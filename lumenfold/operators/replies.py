"""Replies of a rendered page, from its structure: who answers whom, with what.

A page is read once into element ranges over its strings and its links to accounts; what lies below an element is then
a slice. First come links that are mentions: the smallest element above one that holds another account's link and a reply
button is the reply. If none is found, list items (or divisions, without lists) with two account links of their own count.

Defined results: null and empty pages, and pages without a button, have no replies; a reply takes at most
400 characters of page text, answers somebody else, and stands once a page; without words of its own it is its button's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: addresses that are no accounts, the page's own words, and the limits
RESERVED = {
    "reels", "reel", "explore", "accounts", "direct", "stories", "tv", "p", "legal", "about", "developer", "challenge", "emails", "session",
    "graphql", "api", "directory", "hashtag", "location", "tags", "ads", "lite", "web", "settings", "create",
}
ACCOUNT = re.compile(r"/([A-Za-z0-9_.]{1,30})/")
BUTTON = re.compile(r"\b(?:Responder|Reply)\b")
STAMP = r"\d+\s*(?:sem|semanas?|w|d|días?|h|horas?|min)\b"
MARKS = r"(?:Me gusta|Like|Responder|Reply)\b"
LONGEST, CLIMB = 400, 10

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_UNSEEN = {"script", "style", "template"}


class _Element:
    """An element: its place, the one above, and the ranges of strings and account links below it."""

    def __init__(self, tag: str, place: int, up: _Element | None, strings: int, links: int, ahead: str = ""):
        self.tag, self.place, self.up, self.ahead, self.account = tag, place, up, ahead, None
        self.strings, self.links = [strings, None], [links, None]
        self.listed = place if tag in ("ul", "ol") else up.listed if up else -1


class _Page(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.strings, self.links, self.elements, self.text = [], [], [], ""
        self.open = [_Element("", -1, None, 0, 0)]
        self.feed(html)
        self.close()
        while self.open:
            self._end()
        self.buttons = [0, *accumulate(bool(BUTTON.search(s)) for s in self.strings)]

    def _end(self):
        e = self.open.pop()
        e.strings[1], e.links[1] = len(self.strings), len(self.links)

    def handle_starttag(self, tag, attrs):
        e = _Element(tag, len(self.elements), self.open[-1], len(self.strings), len(self.links), self.text)
        self.elements.append(e)
        self.open.append(e)
        self.text = ""
        m = ACCOUNT.fullmatch(dict(attrs).get("href") or "") if tag == "a" else None
        if m and m[1].lower() not in RESERVED:
            e.account = m[1]
            self.links.append(e)
        if tag in _VOID:
            self._end()

    def handle_endtag(self, tag):
        self.text = ""
        if any(e.tag == tag for e in self.open):
            while self.open[-1].tag != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        if self.open[-1].tag not in _UNSEEN:
            self.text = data
            if s := data.strip():
                self.strings.append(s)

    def below(self, e: _Element) -> str:
        return " ".join(self.strings[slice(*e.strings)])

    def button(self, e: _Element) -> bool:
        return self.buttons[e.strings[1]] > self.buttons[e.strings[0]]

    def other(self, e: _Element, account: str) -> str | None:
        """The first account linked below e that is not the given one."""
        return next((x.account for i in range(*e.links) if (x := self.links[i]).account != account), None)

    def mentioned(self) -> Iterator[tuple[str, str, _Element]]:
        for link in self.links:
            if not (self.below(link).startswith("@") or link.ahead.rstrip().endswith("@")):
                continue
            e = link.up
            for _ in range(CLIMB):
                if e is None:
                    break
                if self.button(e) and (who := self.other(e, link.account)):
                    yield who, link.account, e
                    break
                e = e.up

    def nested(self) -> Iterator[tuple[str, str, _Element]]:
        blocks = [e for e in self.elements if e.tag == "li"] or [e for e in self.elements if e.tag == "div"]
        for e in blocks:
            mine = []
            for i in range(*e.links):
                if self.links[i].listed < e.place:
                    mine.append(self.links[i].account)
                    if len(mine) == 2:
                        yield *mine, e
                        break


def _said(text: str, author: str, parent: str) -> str:
    """What a reply says: without its head (author, age, mention) and from its first button or age on."""
    for head in (re.escape(author), STAMP, f"@?{re.escape(parent)}"):
        text = re.sub(rf"^{head}\s*", "", text, count=1)
    text = re.sub(rf"\s+\d+\s+(?={MARKS})", " ", text.strip())
    return re.split(rf"\s+(?:{STAMP}|{MARKS})", text)[0].strip()


def replies_of(html: str | None) -> list[tuple[str, str, str]]:
    """(author, parent, text) of each reply of a page."""
    page = _Page(html or "")
    if not page.buttons[-1]:
        return []
    for way in (page.mentioned, page.nested):
        out = {}
        for author, parent, e in way():
            text = page.below(e)
            if author != parent and len(text) <= LONGEST and page.button(e) and (said := _said(text, author, parent)):
                out[author, parent, said] = None
        if out:
            return list(out)
    return []


def replies(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, author, parent, text) of the replies of each page, with Python's parser, page by page."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            rows = [(k, i, *r) for k, h in zip(g["key"], g["html"], strict=True) for i, r in enumerate(replies_of(h))]
            yield pd.DataFrame(rows, columns=["key", "place", "author", "parent", "text"])

    out = df.select(F.col(key).alias("key"), F.col(html).alias("html")).where("html is not null")
    return out.mapInPandas(run, f"key {kind}, place int, author string, parent string, text string").withColumnRenamed("key", key)
