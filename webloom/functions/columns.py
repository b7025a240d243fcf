"""Scalar expressions over columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
SKIPPED = ("#", "javascript:", "mailto:", "tel:")


def netloc(url: Column) -> Column:
    """The authority of a URL with port, user and case as they are; empty where there is none, null for null."""
    return F.regexp_extract(url, AUTHORITY, 1)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def is_valid_url(url: Column) -> Column:
    """An http or https URL with an authority; false for null."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).isin("http", "https") & (netloc(url) != ""), F.lit(False))


def path_tail(url: Column) -> Column:
    """What stands after the last slash of a URL; the whole text where there is none."""
    return F.element_at(F.split(url, "/"), -1)


def is_skipped_href(href: Column) -> Column:
    """Hrefs that are no link to a page; case-sensitive."""
    test = href == ""
    for prefix in SKIPPED:
        test = test | href.startswith(prefix)
    return test


def bucket_key(domain: Column, per_domain: bool = True) -> Column:
    """The rate-limit bucket of a domain, URL or null."""
    if not per_domain:
        return F.lit("_global")
    named = F.when(domain.contains("://"), netloc(domain)).otherwise(F.split_part(domain, F.lit("/"), F.lit(1)))
    return F.coalesce(F.nullif(named, F.lit("")), F.lit("_global"))


def falsy(value: Column, default: Column) -> Column:
    """``value or default`` for text: null and the empty string give the default."""
    return F.when(value.isNull() | (value == ""), default).otherwise(value)


def falsy_number(value: Column, default: Column) -> Column:
    """``value or default`` for numbers: null and zero give the default."""
    return F.when(value.isNull() | (value == 0), default).otherwise(value)


def strip(value: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def collapse(value: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(value, r"(?U)\s+", " "))


def content_type(value: Column) -> Column:
    """The media type before a semicolon; text/html where none is given."""
    return F.trim(F.split_part(falsy(value, F.lit("text/html")), F.lit(";"), F.lit(1)))


def http_status(error: Column) -> Column:
    """The status in an error text such as ``HTTP 404``, else null."""
    return F.nullif(F.regexp_extract(error, r"HTTP (\d+)", 1), F.lit("")).cast("int")


def error_label(error: Column) -> Column:
    """What stands before the first colon, or Unknown."""
    return F.when(error.isNull() | (error == ""), "Unknown").otherwise(F.trim(F.split_part(error, F.lit(":"), F.lit(1))))


def html_escape(value: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value


def shorten(value: Column, length: int, mark: str = "...") -> Column:
    """At most ``length`` characters, with a mark where something was cut."""
    return F.when(F.char_length(value) > length, F.concat(F.substring(value, 1, length), F.lit(mark))).otherwise(value)


def kilobytes(length: Column) -> Column:
    """Kilobytes with one decimal and no separators of thousands."""
    return F.concat(F.replace(F.format_number(length / 1024, 1), F.lit(","), F.lit("")), F.lit(" KB"))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)
