"""Digital-presence diagnosis of a lead: score, status, tags, needs, maturity, services."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.functions.text import present


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def _rated(rating: Column) -> Column:
    """A rating of 0.0 counts as none."""
    return _flag(rating != 0)


def _listed(*entries: tuple[Column, str]) -> Column:
    """Texts whose condition holds, in the given order."""
    texts = F.array(*[F.when(condition, text) for condition, text in entries])
    return F.filter(texts, lambda t: t.isNotNull())


def lead_score(site: Column, instagram: Column, phone: Column, rating: Column, reviews: Column) -> Column:
    """Sales potential, 50 to 99: rating adds up to 30, every gap in the presence adds more."""
    from_rating = F.when(_rated(rating), F.least(rating * 6, F.lit(30.0)).cast("int")).otherwise(0)
    gaps = (
        _points(~present(site), 12) + _points(~present(phone), 5)
        + _points(~present(instagram), 5) + _points(reviews < 20, 5)
    )
    return F.least(F.lit(99), F.lit(50) + from_rating + gaps)


def digital_status(site: Column, instagram: Column, phone: Column) -> Column:
    has_site, has_instagram = present(site), present(instagram)
    return (
        F.when(has_site & has_instagram, "excellent")
        .when(has_site | has_instagram, "good")
        .when(present(phone), "poor")
        .otherwise("none")
    )


def lead_tags(site: Column, instagram: Column, phone: Column, reviews: Column, score: Column) -> Column:
    # Tag texts and their order.
    return _listed(
        (~present(site), "sem site"),
        (~present(phone), "sem telefone"),
        (~present(instagram), "sem instagram"),
        (reviews < 20, "poucas avaliações"),
        (score >= 80, "alto potencial"),
    )


def need_flags(
    site: Column, instagram: Column, phone: Column, rating: Column, reviews: Column
) -> dict[str, Column]:
    """The seven needs; an unknown rating never triggers one."""
    has_site, has_instagram, has_phone = present(site), present(instagram), present(phone)
    return {
        "needs_website": ~has_site,
        "needs_seo": has_site & ((reviews < 20) | _flag(rating < 4.0)),
        "needs_social_media": ~has_instagram,
        "needs_google_business": (reviews < 10) | _flag(rating < 3.5),
        "needs_paid_traffic": has_site & (reviews < 15),
        "needs_redesign": has_site & ~has_instagram & (reviews < 10),
        "needs_automation": has_site & has_phone & (reviews >= 10),
    }


def digital_maturity(
    site: Column, instagram: Column, phone: Column, rating: Column, reviews: Column, hours: Column
) -> Column:
    """Maturity, 0 to 100."""
    from_reviews = F.when(reviews >= 20, 15).when(reviews >= 5, 8).otherwise(0)
    from_rating = F.when(_flag(rating >= 4.0), 10).when(_flag(rating >= 3.0), 5).otherwise(0)
    return F.least(
        F.lit(100),
        _points(present(site), 30) + _points(present(instagram), 20) + _points(present(phone), 15)
        + from_reviews + from_rating + _points(present(hours), 10),
    )


def suggested_services(
    site: Column, instagram: Column, phone: Column, rating: Column, reviews: Column
) -> Column:
    needs = need_flags(site, instagram, phone, rating, reviews)
    # Service names and their order.
    return _listed(
        (needs["needs_website"], "Criação de site"),
        (needs["needs_social_media"] & (present(site) | present(phone)), "Gestão de redes sociais"),
        (needs["needs_seo"], "SEO / Otimização para buscas"),
        (needs["needs_paid_traffic"], "Tráfego pago (Google Ads)"),
        (needs["needs_google_business"], "Google Meu Negócio"),
        (~present(phone), "WhatsApp Business"),
        (needs["needs_redesign"], "Redesign de site"),
        (needs["needs_automation"], "Automação de atendimento"),
        (reviews < 10, "Gestão de avaliações"),
    )


def digital_diagnosis(
    site: Column, instagram: Column, phone: Column, rating: Column, reviews: Column,
    hours: Column, tags: Column,
) -> Column:
    """All findings as one struct; ``issues`` repeats the tags."""
    needs = need_flags(site, instagram, phone, rating, reviews)
    return F.struct(
        *[flag.alias(name) for name, flag in needs.items()],
        digital_maturity(site, instagram, phone, rating, reviews, hours).alias("digital_maturity_score"),
        tags.alias("issues"),
        suggested_services(site, instagram, phone, rating, reviews).alias("suggested_services"),
    )
