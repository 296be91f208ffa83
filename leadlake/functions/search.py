"""Search and progress expressions: URLs, cache keys, blocked pages, progress texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.functions.text import absent_as_null, norm_text, present, trim_ws

# Search address, markers of a blocked page, length of a cache key.
SEARCH_URL = "https://www.google.com/maps/search/"
BLOCK_MARKERS = [
    "detected unusual traffic",
    "unusual traffic from your computer",
    "recaptcha",
    "rc-anchor",
]
KEY_LENGTH = 16


def search_query_url(keyword: Column, city: Column, state: Column) -> Column:
    """Search address for "keyword city [state]", form-encoded."""
    text = F.concat_ws(" ", keyword, city, absent_as_null(state))
    encoded = F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(SEARCH_URL), F.replace(encoded, F.lit("*"), F.lit("%2A")))


def classify_captcha(html: Column) -> Column:
    """True when the page carries a marker of a blocked request."""
    low = F.lower(html)
    found = F.lit(False)
    for marker in BLOCK_MARKERS:
        found = found | low.contains(marker)
    return F.coalesce(found, F.lit(False))


def _short_sha1(text: Column) -> Column:
    return F.left(F.sha1(F.encode(text, "UTF-8")), F.lit(KEY_LENGTH))


def place_key(url: Column) -> Column:
    """Cache key of a place address."""
    return _short_sha1(F.lower(trim_ws(url)))


def search_hash(keyword: Column, city: Column, state: Column, country: Column) -> Column:
    """Cache key of a search; differences in case, accents and outer blanks do not matter."""
    return _short_sha1(F.concat_ws("|", *[norm_text(c) for c in (keyword, city, state, country)]))


def _percent(n: Column, limit: Column) -> Column:
    return F.when(limit > 0, (n / limit * 100).cast("int")).otherwise(0)


def progress_pct(n: Column, limit: Column) -> Column:
    """Progress in per cent, capped at 99; 0 without a positive limit."""
    return F.least(F.lit(99), _percent(n, limit))


def stage_message(n: Column, limit: Column, phase: Column, name: Column) -> Column:
    """Progress text for a phase; an unknown phase is judged by the percentage."""
    brief = F.when(F.length(name) > 28, F.concat(F.left(name, F.lit(28)), F.lit("…"))).otherwise(name)
    percent = _percent(n, limit)
    # The message texts.
    finding, extracting = F.lit("Encontrando empresas…"), F.format_string("Extraindo contatos… (%d/%d)", n, limit)
    return (
        F.when(phase == "init", "Iniciando navegador…")
        .when(phase == "maps_load", "Carregando Google Maps…")
        .when((phase == "finding") & (n == 0), finding)
        .when(phase == "finding", F.format_string("Encontrando empresas… (%d locais encontrados)", n))
        .when((phase == "extracting") & present(name),
              F.format_string("Extraindo contatos: %s (%d/%d)", brief, n, limit))
        .when(phase == "extracting", extracting)
        .when(phase == "saving", F.format_string("Salvando resultados… (%d leads)", n))
        .when(phase == "done", F.format_string("Concluído — %d leads coletados", n))
        .when(percent < 10, finding)
        .when(percent < 85, extracting)
        .otherwise(F.format_string("Coletando locais… (%d encontrados)", n))
    )
