"""Row filters of the extraction path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions.search import classify_captcha
from leadlake.functions.text import ascii_fold, present


def drop_captcha_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages that show a blocked request yield nothing."""
    return pages.where(~classify_captcha(F.col(html)))


def drop_nameless(df: DataFrame, name: str = "name") -> DataFrame:
    """A place without heading text is no lead."""
    return df.where(present(F.col(name)))


def city_matches(lead_city: Column, target_city: Column) -> Column:
    """True if either city is empty or one folded name contains the other."""
    lead, target = ascii_fold(lead_city), ascii_fold(target_city)
    unknown = ~present(lead_city) | ~present(target_city)
    return unknown | lead.contains(target) | target.contains(lead)


def keep_city_matches(df: DataFrame, lead_city: str = "city", target_city: str = "search_city") -> DataFrame:
    return df.where(city_matches(F.col(lead_city), F.col(target_city)))


def drop_unconfirmed(df: DataFrame, flag: str = "_city_confirmed") -> DataFrame:
    """Drop leads whose address does not support the searched city; a missing flag passes."""
    return df.where(F.coalesce(F.col(flag), F.lit(True)))


def valid_refresh_request(df: DataFrame) -> DataFrame:
    """Refresh requests need a keyword and a city."""
    return df.where(present(F.col("keyword")) & present(F.col("city")))
