"""Text and hash expressions; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Lower case, white space trimmed and collapsed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def padded_tokens(text: Column) -> Column:
    """Tokens as one string with a space on each side, for phrase tests."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def url_title(article: Column) -> Column:
    """Percent-decoded title with underscores as spaces; `+` stays, an undecodable title stays as it is."""
    return F.replace(F.coalesce(F.try_url_decode(F.replace(article, F.lit("+"), F.lit("%2B"))), article), F.lit("_"), F.lit(" "))


def source_ref(page_id: Column) -> Column:
    return F.concat(F.lit("wikipedia:"), page_id.cast("string"))


def month_window(end_month: Column, count: int) -> Column:
    """The `count` months (yyyy-MM) up to end_month, oldest first."""
    last = F.to_date(F.concat(end_month, F.lit("-01")))
    return F.transform(F.sequence(F.add_months(last, 1 - count), last, F.expr("INTERVAL 1 MONTH")), lambda d: F.date_format(d, "yyyy-MM"))


def latest_complete_month(day: Column) -> Column:
    """The month (yyyy-MM) before that of a day."""
    return F.date_format(F.add_months(day, -1), "yyyy-MM")
