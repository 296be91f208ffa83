"""Captured pages: scans, place links of result pages, place fields by selector lists."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.functions.fields import first_external_href, first_non_empty_of, phone_from_label
from leadlake.schemas import CAPTURED_PAGE, PLACE_TEXTS

# Fixed value: what marks a link to a place.
PLACE_LINK = "/maps/place/"


def read_captured_pages(spark: SparkSession, path: str, stream: bool = False, schema: T.StructType = CAPTURED_PAGE) -> DataFrame:
    """Saved pages keyed by url, as a batch or as a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).parquet(path)


def extract_place_links(pages: DataFrame, key: str = "url", html: str = "html", pattern: str = PLACE_LINK) -> DataFrame:
    """One row per matching link of a result page, ``position`` counting them in document order."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit('href="([^"]+)"'), F.lit(1))
    links = F.filter(
        F.transform(hrefs, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&"))), lambda h: h.contains(pattern)
    )
    return pages.select(key, F.posexplode(links).alias("position", "link"))


# A selector is a tuple of alternative paths; a path is a tuple of steps from outer to
# inner; a step is (tag or "*", conditions). Condition operators: "=" equal, "^" prefix,
# "*" contains, "~" class token, "?" present.
def step(tag: str, *conditions: tuple[str, str, str]) -> tuple:
    return tag, conditions


def _css_class(name: str, tag: str = "*") -> tuple:
    return step(tag, ("class", "~", name))


_MAIN = step("div", ("role", "=", "main"))
_FEED = step("*", ("role", "=", "feed"))
_VALUE = _css_class("Io6YTe")
_RATING_BOX = _css_class("F7nice", "div")

# The selector lists of a place page, in order of preference.
PLACE_SELECTORS: dict[str, list] = {
    "name": [
        ((_css_class("DUwDvf", "h1"),),),
        ((step("h1", ("jstcache", "?", "")),),),
        ((_MAIN, step("h1")),),
    ],
    "address": [
        ((step("button", ("data-item-id", "=", "address")), _VALUE),),
        ((step("*", ("data-item-id", "=", "address")),),),
        ((step("button", ("aria-label", "*", "ndereço")),),),
    ],
    "phone": [
        ((step("button", ("data-item-id", "^", "phone:tel")), _VALUE),),
        ((step("button", ("aria-label", "*", "elefone")), _VALUE),),
        ((step("button", ("data-item-id", "^", "phone:")), _VALUE),),
        ((step("*", ("data-tooltip", "=", "Copiar número de telefone")),),),
    ],
    "phone_label": [((step("button", ("aria-label", "*", "hone")),),)],
    "site": [
        ((step("a", ("data-item-id", "=", "authority")),),),
        ((step("a", ("href", "*", "http"), ("aria-label", "*", "ite")),),),
    ],
    "instagram": [((_MAIN, step("a", ("href", "*", "instagram.com"))),)],
    "rating": [
        ((_RATING_BOX, step("span", ("aria-hidden", "=", "true"))),),
        ((_RATING_BOX, _css_class("MW4etd", "span")),),
        ((_css_class("ceNzKf", "span"),),),
        ((_css_class("fontDisplayLarge", "div"),),),
    ],
    "review_labels": [
        ((step("button", ("aria-label", "*", "avalia")),),),
        ((step("button", ("aria-label", "*", "eview")),),),
        ((step("a", ("aria-label", "*", "avalia")),),),
        ((step("a", ("aria-label", "*", "eview")),),),
    ],
    "rating_spans": [((_RATING_BOX, step("span", ("aria-hidden", "=", "true"))),)],
    "category": [
        ((_css_class("DkEaL", "button"),),),
        ((step("button", ("jsaction", "*", "category")),),),
        ((_css_class("YhemCb", "span"),),),
        ((_css_class("skqShb", "div"), step("button")),),
    ],
    "hours": [
        (
            (step("*", ("data-item-id", "=", "oh")), _VALUE),
            (_css_class("o0Svhf"),),
            (_css_class("ZDu9vd"), step("span")),
        ),
    ],
    "photos": [
        ((_css_class("RZ66Rb", "div"), step("img")),),
        ((step("div", ("jsaction", "*", "heroHeaderImage")), step("img")),),
        ((step("button", ("jsaction", "*", "heroHeaderImage")), step("img")),),
        ((step("img", ("src", "*", "googleusercontent")),),),
        ((step("img", ("src", "*", "ggpht")),),),
    ],
}
# Which attribute a field reads (text content otherwise), and which fields take every match.
_ATTRIBUTE = {"site": "href", "instagram": "href", "phone_label": "aria-label", "review_labels": "aria-label", "photos": "src"}
_EVERY_MATCH = {"instagram", "rating_spans", "photos"}
_SINGLE = {"phone_label", "hours"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SELF_CLOSING = {"p", "li", "tr", "td", "th", "option"}


# A page is read as a run of tags; comments, scripts and styles are skipped as a whole.
_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']++)*+)>",
    re.DOTALL | re.IGNORECASE,
)
# The same tags, for cutting a page into texts and tags that follow each other in turn.
_CUT = re.compile(
    r"(<(?:!--.*?(?:-->|$)|script\b[^>]*>.*?(?:</script\s*>|$)|style\b[^>]*>.*?(?:</style\s*>|$)"
    r"|/?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^>\"']++)*+>))",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE_TEXT = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
# Tags and moves that a worker remembers, and the longest text of a tag.
_TAGS_KNOWN, _MOVES_KNOWN, _TAG_LENGTH = 20_000, 50_000, 500


class _Tag:
    """One tag as it is written: what it opens or closes and, a bit each, which of the asked steps it fits.

    ``name`` is None for comments, scripts and styles. Attributes are parsed when first asked for.
    """

    __slots__ = ("name", "script", "closes", "void", "self_closing", "text", "fitted", "_attributes")

    def __init__(self, written: str) -> None:
        match = _TAG.match(written)
        self.script, self.closes, self.text = bool(match[1]), bool(match[2]), match[4]
        self.name = None if match[3] is None else match[3].lower()
        self.void, self.self_closing = self.name in _VOID, self.name in _SELF_CLOSING
        self.fitted, self._attributes = 0, None

    @property
    def attributes(self) -> dict[str, str]:
        if self._attributes is None:
            self._attributes = {
                m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE_TEXT.finditer(self.text)
            }
        return self._attributes

    def fits(self, wanted: tuple) -> bool:
        tag, conditions = wanted
        if tag != "*" and tag != self.name:
            return False
        for name, operator, value in conditions:
            # A plain text search rules most elements out before any parsing.
            if value not in self.text and "&" not in self.text:
                return False
            actual = self.attributes.get(name)
            if actual is None or not _OPERATORS[operator](actual, value):
                return False
        return True


_OPERATORS = {
    "?": lambda actual, value: True,
    "=": lambda actual, value: actual == value,
    "^": lambda actual, value: actual.startswith(value),
    "*": lambda actual, value: value in actual,
    "~": lambda actual, value: value in actual.split(),
}


class _Tags(dict):
    """Tags by their text, each judged once: pages of a service are written with the same tags again and again.

    Very long tags are not kept, and a full table starts afresh.
    """

    def __init__(self, steps: Iterable[tuple]) -> None:
        self.bits = {wanted: 1 << i for i, wanted in enumerate(dict.fromkeys(steps))}
        self.any_name = [(wanted, bit) for wanted, bit in self.bits.items() if wanted[0] == "*"]
        self.named: dict[str, list[tuple]] = {}
        for wanted, bit in self.bits.items():
            if wanted[0] != "*":
                self.named.setdefault(wanted[0], []).append((wanted, bit))

    def __missing__(self, written: str) -> _Tag:
        tag = _Tag(written)
        if tag.name is not None and not tag.closes:
            tag.fitted = sum(bit for wanted, bit in self.named.get(tag.name, []) + self.any_name if tag.fits(wanted))
        if len(written) <= _TAG_LENGTH:
            if len(self) >= _TAGS_KNOWN:
                self.clear()
            self[written] = tag
        return tag


class _Opened:
    """An open element inside all those around it: where a reader stands. ``moves`` has what the next tag leads to."""

    __slots__ = ("tag", "outer", "depth", "around", "moves")

    def __init__(self, tag: _Tag | None = None, outer: _Opened | None = None) -> None:
        self.tag, self.outer = tag, outer
        self.depth = outer.depth + 1 if outer else 0
        # The steps that this element or one around it fits.
        self.around = tag.fitted | outer.around if outer else 0
        self.moves: dict[str, tuple] = {}

    def enclosed(self, steps: tuple[int, ...]) -> bool:
        """Elements that fit the ``steps``, from inside to outside, enclose this one."""
        element = self.outer
        for bit in steps:
            if not element.around & bit:
                return False
            while not element.tag.fitted & bit:
                element = element.outer
            element = element.outer
        return True


class _PlaceTags(_Tags):
    """Tags of place pages and the moves between their open elements, each worked out once.

    A move is (the innermost element then open, the depth above which elements were closed, what is found): (place of the values or -1 for another
    main panel, whether it counts in the first panel only, whether every match counts, the attribute's text, depth of the element) each.
    """

    def __init__(self, selectors: dict[str, list]) -> None:
        # The places of the values: the fields in order, a field's selectors in order of preference.
        self.fields = [field for field, group in selectors.items() for _ in group]
        groups = [selector for group in selectors.values() for selector in group]
        paths = [(slot, path) for slot, selector in enumerate(groups) for path in selector]
        super().__init__([_MAIN, _FEED, *[wanted for _, path in paths for wanted in path]])
        self.paths = [(slot, self.fields[slot], self.bits[path[-1]], tuple(self.bits[wanted] for wanted in reversed(path[:-1]))) for slot, path in paths]
        self.page, self.moves = _Opened(), 0

    def start(self) -> _Opened:
        """Where a page starts."""
        if self.moves >= _MOVES_KNOWN:
            self.page, self.moves = _Opened(), 0
        return self.page

    def move(self, at: _Opened, written: str) -> tuple:
        tag = self[written]
        if tag.name is None:
            move = at, at.depth, ()
        elif tag.closes:
            closed = at
            while closed.outer and closed.tag.name != tag.name:
                closed = closed.outer
            after = closed.outer or at
            move = after, after.depth, ()
        else:
            outer = at.outer if tag.self_closing and at.outer and at.tag.name == tag.name else at
            element = _Opened(tag, outer)
            move = outer if tag.void else element, outer.depth, self._found(element) if tag.fitted else ()
        if len(written) <= _TAG_LENGTH:
            self.moves += 1
            at.moves[written] = move
        return move

    def _found(self, element: _Opened) -> list[tuple]:
        found = [(-1, False, True, None, 0)] if element.tag.fitted & self.bits[_MAIN] else []
        for slot, field, last, outer in self.paths:
            if element.tag.fitted & last and element.enclosed(outer) and not (field == "photos" and element.around & self.bits[_FEED]):
                attribute = _ATTRIBUTE.get(field)
                value = None if attribute is None else [element.tag.attributes.get(attribute, "")]
                found.append((slot, field == "instagram", field in _EVERY_MATCH, value, element.depth))
        return found


def _read_page(html: str, tags: _PlaceTags) -> list:
    """Values of all fields of one page, in the order of the field schema."""
    found: list[list] = [[] for _ in tags.fields]
    capturing: list[tuple[int, list[str]]] = []
    at, panels = tags.start(), 0
    cut = _CUT.split(html)

    for text, written in zip(cut[::2], cut[1::2]):
        if capturing and text:
            text = unescape(text)
            for _, parts in capturing:
                parts.append(text)
        at, depth, matches = at.moves.get(written) or tags.move(at, written)
        while capturing and capturing[-1][0] > depth:
            capturing.pop()
        for slot, first_panel, every, value, opened in matches:
            if slot < 0:
                panels += 1
                continue
            values = found[slot]
            if values and not every or first_panel and panels > 1:
                continue
            if value is None:
                value = []
                # An element that cannot hold text is closed already.
                if at.depth >= opened:
                    capturing.append((opened, value))
            values.append(value)

    texts: dict[str, list[str]] = {field: [] for field in PLACE_TEXTS.fieldNames()}
    for field, values in zip(tags.fields, found):
        for parts in values:
            texts[field].append("".join(parts))
    return [(values[0] if values else None) if field in _SINGLE else values for field, values in texts.items()]


def extract_place_fields(
    pages: DataFrame, selectors: dict[str, list] = PLACE_SELECTORS, html: str = "html"
) -> DataFrame:
    """Candidate texts per field of each page: one Arrow pass, the other columns pass through.

    Only finding elements needs the document tree; all cleaning happens in Spark
    expressions (:func:`place_raw`).
    """
    kept = [c for c in pages.columns if c != html]
    fields = PLACE_TEXTS.fieldNames()
    schema = T.StructType([*[pages.schema[c] for c in kept], *PLACE_TEXTS.fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = _PlaceTags(selectors)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(html)).to_pylist()
            columns = zip(*[_read_page(text or "", tags) for text in texts])
            found = [
                pa.array(values, pa.string() if field in _SINGLE else pa.list_(pa.string()))
                for field, values in zip(fields, columns)
            ]
            passed = [batch.column(batch.schema.get_field_index(name)) for name in kept]
            yield pa.RecordBatch.from_arrays([*passed, *found], [*kept, *fields])

    return pages.mapInArrow(read, schema)


def place_raw(texts: DataFrame) -> DataFrame:
    """One raw text per field: the preferred candidate of :func:`extract_place_fields`."""
    passed = [c for c in texts.columns if c not in PLACE_TEXTS.fieldNames()]
    phone = first_non_empty_of(F.col("phone"))
    return texts.select(
        *passed,
        first_non_empty_of(F.col("name")).alias("name"),
        first_non_empty_of(F.col("address")).alias("address"),
        phone_from_label(phone, F.col("phone_label")).alias("phone_raw"),
        first_external_href(F.col("site")).alias("site_href"),
        F.col("instagram").alias("instagram_links"),
        first_non_empty_of(F.col("rating")).alias("rating_raw"),
        "review_labels",
        "rating_spans",
        first_non_empty_of(F.col("category")).alias("category_raw"),
        F.col("hours").alias("hours_raw"),
        "photos",
    )
