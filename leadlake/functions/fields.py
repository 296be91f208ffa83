"""Field clean-up: raw texts of a captured place turned into typed lead fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.functions.text import (
    SPACE,
    SPACE_CHARS,
    absent_as_null,
    ascii_digits,
    ascii_fold,
    ascii_fold_inner,
    digits_only,
    present,
    title_case,
    trim_ws,
)

# The 27 Brazilian federative units.
BR_STATES = [
    "AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA",
    "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO",
]

# Fixed value: "<separator> City <separator> UF" inside an address.
_CITY_UF = (
    rf"[,\-\x{{2013}}]{SPACE}*"
    rf"([A-Za-z\x{{C0}}-\x{{FF}}][A-Za-z\x{{C0}}-\x{{FF}}{SPACE_CHARS}'\-.]{{1,38}}?)"
    rf"{SPACE}*[,\-\x{{2013}}]{SPACE}*([A-Z]{{2}})(?![\p{{L}}\p{{N}}_])"
)
# Fixed value: the first dash-delimited part of an address.
_NEIGHBORHOOD = rf"-{SPACE}*([^,\-]+)(?:,|{SPACE}*-)"
# Host prefix of internal links, home page of the social network, photo hosts and size.
_INTERNAL_PREFIX = "https://www.google"
_SOCIAL_HOST = "instagram.com"
_SOCIAL_HOME = "https://www.instagram.com"
_PHOTO_HOSTS = ("googleusercontent", "ggpht")
_PHOTO_SIZE = "=w400-h300-k-no"


def _first(array: Column) -> Column:
    """First element, or null; ``element_at`` would fail on an empty array under ANSI."""
    return F.try_element_at(array, F.lit(1))


def first_non_empty(*candidates: Column) -> Column:
    """First candidate text that is not blank, stripped; '' when there is none."""
    return F.coalesce(*[absent_as_null(trim_ws(c)) for c in candidates], F.lit(""))


def first_non_empty_of(texts: Column) -> Column:
    """:func:`first_non_empty` over an array of candidates."""
    return F.coalesce(_first(F.filter(F.transform(texts, trim_ws), present)), F.lit(""))


def phone_from_label(phone: Column, label: Column) -> Column:
    """The phone text, else what follows the last colon of an accessibility label."""
    from_label = trim_ws(F.element_at(F.split(label, ":"), -1))
    return F.when(present(phone), phone).when(present(label), from_label).otherwise("")


def first_external_href(hrefs: Column) -> Column:
    """First non-empty link that does not lead back to the map service, stripped; else ''."""
    outside = F.filter(hrefs, lambda h: present(h) & ~h.startswith(_INTERNAL_PREFIX))
    return F.coalesce(trim_ws(_first(outside)), F.lit(""))


def canonical_site(href: Column) -> Column:
    """Site without scheme, trailing slashes and query, cut in that order; '' gives null."""
    bare = F.regexp_replace(F.regexp_replace(href, "^https?://", ""), "/+$", "")
    return absent_as_null(F.split_part(bare, F.lit("?"), F.lit(1)))


def pick_instagram(links: Column) -> Column:
    """First profile link, without query and trailing slashes; null when there is none."""
    def is_profile(h: Column) -> Column:
        return F.coalesce(
            h.contains(_SOCIAL_HOST) & (F.regexp_replace(h, "/+$", "") != _SOCIAL_HOME), F.lit(False)
        )

    chosen = _first(F.filter(links, is_profile))
    return F.regexp_replace(F.split_part(chosen, F.lit("?"), F.lit(1)), "/+$", "")


def parse_rating(text: Column) -> Column:
    """First run of digits and commas as a decimal-comma number; null if unparsable or above 5."""
    run = absent_as_null(F.regexp_extract(text, r"([\p{Nd},]+)", 1))
    value = F.replace(ascii_digits(run), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value <= 5, value)


def _counts(texts: Column) -> Column:
    """Whole numbers of an array of digit texts; empty and unparsable ones become null.

    Empty texts are sorted out first: a failing cast costs far more than the test.
    """
    return F.transform(texts, lambda digits: F.when(digits != "", ascii_digits(digits).try_cast("int")))


def parse_review_count(labels: Column) -> Column:
    """Count named by the first label that carries one ("1.250 avaliações", "1,250 reviews"); else 0."""
    # The two ways a label names its count.
    portuguese, english = rf"([\p{{Nd}}.]+){SPACE}*avaliaç", rf"([\p{{Nd}},]+){SPACE}*review"

    def number(label: Column) -> Column:
        found = F.coalesce(
            absent_as_null(F.regexp_extract(label, portuguese, 1)), F.regexp_extract(label, english, 1)
        )
        return digits_only(found)

    counts = _counts(F.transform(F.transform(labels, F.lower), number))
    return F.coalesce(_first(F.filter(counts, lambda n: n.isNotNull())), F.lit(0))


def review_count_from_spans(labelled: Column, spans: Column) -> Column:
    """Fallback when the labels gave 0: first comma-free span with a positive number."""
    whole = F.filter(spans, lambda span: ~span.contains(","))
    counts = F.filter(_counts(F.transform(whole, digits_only)), lambda n: n > 0)
    return F.when(labelled != 0, labelled).otherwise(F.coalesce(_first(counts), F.lit(0)))


def category_or_keyword(category: Column, keyword: Column) -> Column:
    """The category, else the search keyword in title case."""
    return F.coalesce(absent_as_null(category), title_case(keyword))


def hours_first_line(text: Column) -> Column:
    """First line, at most 60 characters; '' gives null."""
    line = F.split_part(trim_ws(text), F.lit("\n"), F.lit(1))
    return absent_as_null(F.left(line, F.lit(60)))


def pick_photo(sources: Column) -> Column:
    """First hosted photo longer than 30 characters, re-sized to the delivery format; else null."""
    def hosted(src: Column) -> Column:
        on_host = src.contains(_PHOTO_HOSTS[0]) | src.contains(_PHOTO_HOSTS[1])
        return F.coalesce(on_host & (F.length(src) > 30), F.lit(False))

    chosen = _first(F.filter(F.transform(sources, trim_ws), hosted))
    return F.regexp_replace(chosen, r"=w\p{Nd}+.*$", _PHOTO_SIZE)


def address_places(address: Column, country: Column) -> Column:
    """Texts "- City - UF" of a Brazilian address that name a valid city and state; null elsewhere."""
    def valid(match: Column) -> Column:
        return F.right(match, F.lit(2)).isin(BR_STATES) & F.length(_city_in(match)).between(2, 40)

    found = F.filter(F.regexp_extract_all(address, F.lit(_CITY_UF), F.lit(0)), valid)
    return F.when(present(address) & (country == "BR"), found)


def _city_in(match: Column) -> Column:
    return trim_ws(F.regexp_extract(match, _CITY_UF, 1))


def city_state_of(places: Column, city: Column, state: Column, country: Column) -> Column:
    """struct(city, state): the last of :func:`address_places`, else what was searched for."""
    found = F.try_element_at(places, F.lit(-1))
    searched_state = F.coalesce(
        absent_as_null(state), F.when(country == "BR", F.lit("SP")).otherwise("")
    )
    return F.struct(
        F.coalesce(_city_in(found), city).alias("city"),
        F.coalesce(F.right(found, F.lit(2)), searched_state).alias("state"),
    )


def parse_city_state(address: Column, city: Column, state: Column, country: Column) -> Column:
    """struct(city, state): the last valid pair of the address, else what was searched for."""
    return city_state_of(address_places(address, country), city, state, country)


def parse_neighborhood(address: Column) -> Column:
    """First dash-delimited part of the address, stripped; null without one."""
    return F.when(address.rlike(_NEIGHBORHOOD), trim_ws(F.regexp_extract(address, _NEIGHBORHOOD, 1)))


def confirmed_by(places: Column, address: Column, city: Column, country: Column) -> Column:
    """:func:`city_confirmed` for known :func:`address_places`."""
    folded = ascii_fold_inner(address)
    mentioned = (folded != "") & folded.contains(ascii_fold(city))
    return (
        F.when(~present(address), True)
        .when(F.size(places) > 0, True)
        .when(country == "BR", mentioned)
        .otherwise(False)
    )


def city_confirmed(address: Column, city: Column, country: Column) -> Column:
    """Whether the address supports the searched city: no address, a valid pair, or the city's name in it.

    Outside Brazil an address never confirms anything.
    """
    return confirmed_by(address_places(address, country), address, city, country)
