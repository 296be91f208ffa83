"""Feed cards of saved result pages: what the card around each place link shows."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leadlake.sources.pages import _CUT, PLACE_LINK, _css_class, _Tag, _Tags, step

# What marks a card, its texts and a place page shown instead of a list.
_LINK = step("a", ("href", "*", PLACE_LINK))
_CONTAINER = step("*", ("jsaction", "?", ""))
_NAME = (_css_class("fontHeadlineSmall"), _css_class("qBF1Pd"))
_RATING = (_css_class("MW4etd"),)
_REVIEWS = (_css_class("UY7F9"),)
_LINES = _css_class("W4Efsd")
_LISTED = step("*", ("jsinstance", "?", ""))
_PLACE_NAME = _css_class("DUwDvf", "h1")
_CARD_FIELDS = ("name", "rating", "reviews", "category")


class _CardTags(_Tags):
    """Tags of result pages, with the bits of what the cards are read by."""

    def __init__(self) -> None:
        super().__init__([_LINK, _CONTAINER, *_NAME, *_RATING, *_REVIEWS, _LINES, _LISTED, _PLACE_NAME])
        self.link, self.container, self.lines, self.listed, self.place_name = (self.bits[s] for s in (_LINK, _CONTAINER, _LINES, _LISTED, _PLACE_NAME))
        self.texts = [sum(self.bits[s] for s in steps) for steps in (_NAME, _RATING, _REVIEWS)]


class _Page:
    """The elements of a page in order, each with its parent, its number among its siblings and where it ends."""

    def __init__(self, html: str, tags: _CardTags) -> None:
        self.tags = tags
        self.elements: list[_Tag] = []
        self.parent: list[int] = []
        self.number: list[int] = []
        self.text_from: list[int] = []
        self.text_to: list[int] = []
        self.end: list[int] = []
        # Children so far and the last of them, by parent; -1 is the page.
        self.children: dict[int, int] = {}
        self.last: dict[int, int] = {}
        self.texts: list[str] = []
        self._read(html)

    def _child(self, parent: int, element: int) -> int:
        self.children[parent] = self.children.get(parent, 0) + 1
        self.last[parent] = element
        return self.children[parent]

    def _read(self, html: str) -> None:
        opened: list[int] = []
        tags, elements = self.tags, self.elements
        cut = _CUT.split(html)

        def close_to(depth: int) -> None:
            for element in opened[depth:]:
                self.text_to[element], self.end[element] = len(self.texts), len(elements)
            del opened[depth:]

        for text, written in zip(cut[::2], cut[1::2]):
            if text:
                self.texts.append(unescape(text))
            tag = tags[written]
            if tag.name is None:
                if tag.script:
                    self._child(opened[-1] if opened else -1, -1)  # a script or style is a sibling too
                continue
            if tag.closes:
                depth = len(opened) - 1
                while depth >= 0 and elements[opened[depth]].name != tag.name:
                    depth -= 1
                if depth >= 0:
                    close_to(depth)
                continue
            if tag.self_closing and opened and elements[opened[-1]].name == tag.name:
                close_to(len(opened) - 1)
            parent = opened[-1] if opened else -1
            element = len(elements)
            elements.append(tag)
            self.parent.append(parent)
            self.number.append(self._child(parent, element))
            self.text_from.append(len(self.texts))
            self.text_to.append(0)
            self.end.append(0)
            opened.append(element)
            if tag.void:
                close_to(len(opened) - 1)
        if cut[-1]:
            self.texts.append(unescape(cut[-1]))
        close_to(0)

    def matching(self, bits: int) -> list[int]:
        return [i for i, element in enumerate(self.elements) if element.fitted & bits]

    def text(self, element: int) -> str:
        return "".join(self.texts[self.text_from[element] : self.text_to[element]]).strip()

    def above(self, element: int) -> Iterator[int]:
        """The elements around ``element``, innermost first."""
        while (element := self.parent[element]) >= 0:
            yield element

    def categories(self) -> tuple[list[int], list[int]]:
        """Where a category stands: in the second part of the last lines of a card, else in the lines of a listed element."""
        preferred, other = [], []
        lines, shown = self.tags.lines, self.tags.listed
        for line in self.matching(lines):
            around = list(self.above(line))
            closing = any(self.elements[e].fitted & lines and self.last[self.parent[e]] == e for e in around)
            listed = any(self.elements[e].fitted & shown for e in around)
            if not closing and not listed:
                continue
            for e in range(line + 1, self.end[line]):
                outer = self.parent[e]
                if outer > line and self.parent[outer] == line and self.elements[e].name == self.elements[outer].name == "span":
                    if closing and self.number[outer] == 2 and self.number[e] == 1:
                        preferred.append(e)
                    if listed:
                        other.append(e)
        return sorted(preferred), sorted(other)


def _read_cards(html: str, url: str | None, tags: _CardTags) -> list[tuple[str, str, str, str, str]]:
    """(link, name, rating, reviews, category) of the cards of one page, in document order."""
    page = _Page(html, tags)
    headings = page.matching(tags.place_name)
    if headings and url and PLACE_LINK in url:
        return [(url, page.text(headings[0]), "", "", "")]
    places = [(page.matching(bits),) for bits in tags.texts] + [page.categories()]
    cards = []
    for link in page.matching(tags.link):
        around = [link, *page.above(link)]
        container = next((e for e in around if page.elements[e].fitted & tags.container), page.parent[link])
        texts = [""] * len(places)
        if container >= 0:
            for field, preferences in enumerate(places):
                for found in preferences:
                    at = bisect_right(found, container)
                    if at < len(found) and found[at] < page.end[container]:
                        texts[field] = page.text(found[at])
                        break
        name, rating, reviews, category = texts
        cards.append((page.elements[link].attributes["href"], name, rating, re.sub(r"[^0-9]", "", reviews), re.sub(r"^·\s*", "", category)))
    return cards


def extract_feed_cards(pages: DataFrame, keep: Sequence[str] = ("url",), url: str | None = "url", html: str = "html") -> DataFrame:
    """(the ``keep`` columns, position, link, name, rating, reviews, category): one row per place link of a result page.

    The card is the nearest element around the link that reacts to clicks, else the link's parent; a text is the first of its kind in the card,
    empty where it has none. ``position`` counts the links from 0 in document order. A page that shows one place instead of a
    list (its address, ``url``, is a place link) is one card of that place. A null page has no cards.
    """
    needed = [*keep, *([url] if url and url not in keep else []), html]
    schema = T.StructType([
        *[pages.schema[c] for c in keep], T.StructField("position", T.LongType()), T.StructField("link", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in _CARD_FIELDS]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = _CardTags()
        for batch in batches:
            addresses = batch.column(needed.index(url)).to_pylist() if url else [None] * batch.num_rows
            found = [_read_cards(text or "", address, tags) for text, address in zip(batch.column(needed.index(html)).to_pylist(), addresses)]
            of = pa.array([i for i, cards in enumerate(found) for _ in cards], pa.int64())
            position = pa.array([n for cards in found for n in range(len(cards))], pa.int64())
            texts = [pa.array([card[i] for cards in found for card in cards], pa.string()) for i in range(5)]
            kept = [batch.column(i).take(of) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, position, *texts], [*keep, "position", "link", *_CARD_FIELDS])

    return pages.select(*needed).mapInArrow(read, schema)
