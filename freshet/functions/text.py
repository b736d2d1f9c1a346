"""Text, number and time formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from freshet.functions.urls import is_bad_netloc, let, netloc_of, path_of, scheme_of, split_url

# Whitespace as a browser's trim() sees it, and as str.strip() sees it (also the ASCII separators and NEL).
_UNICODE_SPACE = r"\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BROWSER_SPACE = rf"[\t-\r \x{{feff}}{_UNICODE_SPACE}]+"
_TEXT_SPACE = rf"[\t-\r\x1c-\x20\x85{_UNICODE_SPACE}]+"

# The texts readers see.
NO_TIME = "―"
NO_TITLE = "(タイトルなし)"
JUST_NOW = "たった今"
MINUTES_AGO = "分前"
HOURS_AGO = "時間前"
DAYS_AGO = "日前"


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def _trim(text: Column, space: str) -> Column:
    return F.regexp_replace(text, rf"^{space}|{space}\z", "")


def strip_text(text: Column) -> Column:
    return _trim(text, _TEXT_SPACE)


def clean_text(text: Column) -> Column:
    """Collapse each run of whitespace to one space and trim."""
    return F.trim(F.regexp_replace(text, _TEXT_SPACE, " "))


def slugify(name: Column) -> Column:
    """An identifier made of the ASCII letters and digits of a name."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), r"^-|-\z", "")
    return F.coalesce(blank_to_null(slug), F.lit("site"))


def display_title(title: Column, url: Column) -> Column:
    """The trimmed title, else the readable path of the URL, else the URL itself."""
    trimmed = _trim(F.coalesce(title, F.lit("")), _BROWSER_SPACE)
    return F.when(trimmed != "", trimmed).otherwise(_readable_path(url))


def _readable_path(url: Column) -> Column:
    def decoded(parts: Column) -> Column:
        path = F.when(path_of(parts) == "", F.lit("/")).otherwise(path_of(parts))
        # Escapes of reserved characters stay escaped: ; / ? : @ & = + $ , #
        kept = F.regexp_replace(path, r"(?i)%(2[346BCF]|3[ABDF]|40)", "%25$1")
        text = F.try_url_decode(F.replace(kept, F.lit("+"), F.lit("%2B")))
        usable = (
            scheme_of(parts).isin("http", "https")
            & ~is_bad_netloc(netloc_of(parts))
            & ~path.rlike("%(?![0-9A-Fa-f]{2})")
            & (text.contains("\ufffd") == path.rlike("(?i)\ufffd|%EF%BF%BD"))
        )
        return F.when(usable, text).otherwise(url)

    return let(split_url(url), decoded)


def search_key(query: str) -> str:
    """A search box's text as it is compared: trimmed, lower-case."""
    return query.strip().lower()


def matches_query(text: Column, query: str) -> Column:
    """Case-insensitive substring test; an empty query matches everything."""
    key = search_key(query)
    return F.lower(text).contains(key) if key else F.lit(True)


def absolute_time(ts: Column, timezone: str = "UTC") -> Column:
    """``yyyy/MM/dd HH:mm`` in the viewer's zone, for a session running in UTC."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), timezone), "yyyy/MM/dd HH:mm"), F.lit(NO_TIME))


def relative_age(ts: Column, as_of: Column, timezone: str = "UTC") -> Column:
    """Age in floored minutes, hours or days; from 30 days on the absolute time."""
    ts = ts.cast("timestamp")
    seconds = F.floor((F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(ts)) / 1000)

    def whole(unit: int, label: str) -> Column:
        return F.concat(F.floor(seconds / unit).cast("string"), F.lit(label))

    return (
        F.when(ts.isNull(), F.lit(NO_TIME))
        .when(seconds < 60, F.lit(JUST_NOW))
        .when(seconds < 3600, whole(60, MINUTES_AGO))
        .when(seconds < 86400, whole(3600, HOURS_AGO))
        .when(seconds < 86400 * 30, whole(86400, DAYS_AGO))
        .otherwise(absolute_time(ts, timezone))
    )
