"""The site table from raw settings: defaults, coercion, validation.

Raw settings are one JSON object per site, as text, in column ``entry`` with the order of listing in ``ord``. JSON
keeps apart what matters here: an absent key, a null, a scalar and a list.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.text import blank_to_null, slugify, strip_text
from freshet.schemas import SETTING_DEFAULTS, default_setting, known_limit

_LISTS = ["include", "exclude", "allow_hosts"]
_NUMBERS = ["min_title_length", "max_items", "timeout", "retries"]
_FLAGS = ["enabled", "allow_external", "use_default_exclude", "skip_navigation"]
_TEXTS = ["selector", "user_agent"]


#: Violations in an error's text; its rows have all.
SHOWN = 10


class InvalidSettings(ValueError):
    """Settings that cannot be used; ``rows`` has all violations, if there are some, and the text the first."""

    def __init__(self, text: str = "", rows: DataFrame | None = None):
        self.rows = rows
        shown = [] if rows is None else rows.take(SHOWN)
        super().__init__(text or "; ".join(f"sites[{w['ord']}]: {w['code']} {w['detail'] or ''}".strip() for w in shown))


def _value(entry: Column, key: str) -> Column:
    return F.try_variant_get(entry, f"$.{key}", "variant")


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _text(value: Column) -> Column:
    """A scalar as text; booleans and nulls inside lists keep their capitalised names."""
    kind = _kind(value)
    return (
        F.when(kind == "BOOLEAN", F.initcap(value.cast("string")))
        .when(kind == "VOID", F.lit("None"))
        .when(kind.isin("ARRAY", "OBJECT"), F.to_json(value))
        .otherwise(value.cast("string"))
    )


def _present(value: Column) -> Column:
    """The key exists and is not null."""
    return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False))


def _as_list(value: Column) -> Column:
    kind = _kind(value)
    return (
        F.when(kind == "VOID", F.array().cast("array<string>"))
        .when(kind == "STRING", F.array(value.cast("string")))
        .when(kind == "ARRAY", F.transform(F.try_variant_get(value, "$", "array<variant>"), _text))
    )


def _as_number(value: Column) -> Column:
    kind = _kind(value)
    digits = F.regexp_extract(strip_text(value.cast("string")), r"^([+-]?\d+(?:_\d+)*)\z", 1)
    return (
        F.when(kind == "STRING", F.replace(blank_to_null(digits), F.lit("_"), F.lit("")).try_cast("int"))
        .when(kind == "BOOLEAN", value.cast("boolean").cast("int"))
        .when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), value.cast("double").try_cast("int"))
    )


def _as_flag(value: Column) -> Column:
    kind = _kind(value)
    return (
        F.when(kind == "VOID", F.lit(False))
        .when(kind == "BOOLEAN", value.cast("boolean"))
        .when(kind == "STRING", value.cast("string") != "")
        .when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), value.cast("double") != 0)
        .otherwise(~F.to_json(value).isin("[]", "{}"))
    )


def _setting(key: str, value: Column) -> Column:
    """A key's value in its column type; NULL where the key is absent, inherits, or is unusable."""
    if key in _LISTS:
        return F.when(value.isNotNull(), _as_list(value))
    if key in _NUMBERS:
        return F.when(value.isNotNull(), _as_number(value))
    if key in _FLAGS:
        return F.when(value.isNotNull(), _as_flag(value))
    return F.when(_present(value), _text(value))


def _identity(raw: DataFrame) -> DataFrame:
    """Parsed entry with ``url``, ``name`` and ``site_id``."""

    def given(key: str) -> Column:
        value = _value(F.col("entry"), key)
        return F.when(_present(value) & _as_flag(value), _text(value))

    return (
        raw.withColumn("entry", F.try_parse_json(F.col("entry")))
        .withColumn("url", strip_text(F.coalesce(given("url"), F.lit(""))))
        .withColumn("name", strip_text(F.coalesce(given("name"), F.col("url"))))
        .withColumn("site_id", F.coalesce(blank_to_null(strip_text(F.coalesce(given("id"), F.lit("")))), slugify(F.col("name"))))
    )


def site_table(raw: DataFrame, defaults: dict | None = None) -> DataFrame:
    """The ``sites`` dimension: a site's own setting, else the common default, else the built-in one."""
    common = F.parse_json(F.lit(json.dumps(defaults or {}, ensure_ascii=False)))
    sites = _identity(raw).withColumn("_common", common)
    settings = [
        F.coalesce(
            _setting(key, _value(F.col("entry"), key)), _setting(key, _value(F.col("_common"), key)), default_setting(key)
        ).alias(key)
        for key in SETTING_DEFAULTS
    ]
    return sites.select("ord", "site_id", "name", "url", *settings).withColumn("known_limit", known_limit(F.col("max_items")))


def violations(raw: DataFrame) -> DataFrame:
    """Everything wrong with the entries: ord, code, detail. No row means all can be used."""
    sites = _identity(raw)
    usable = F.col("entry").isNotNull() & (_kind(F.col("entry")) == "OBJECT")
    nothing = F.lit(None).cast("string")

    def wrong(when: Column, code: str, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), detail.alias("detail")))

    found = [
        wrong(~usable, "not_an_object", nothing),
        wrong(usable & (F.col("url") == ""), "url_missing", nothing),
        wrong(usable & (F.col("url") != "") & ~F.col("url").rlike("^https?://"), "url_scheme", F.col("url")),
    ]
    for keys, code in ((_LISTS, "not_a_list"), (_NUMBERS, "not_a_number")):
        for key in keys:
            value = _value(F.col("entry"), key)
            found.append(wrong(value.isNotNull() & _setting(key, value).isNull(), code, F.lit(key)))
    per_entry = (
        sites.select("ord", F.explode(F.array_compact(F.array(*found))).alias("v"))
        .select("ord", "v.code", "v.detail")
    )
    with_id = sites.filter(usable & (F.col("url") != ""))
    first = with_id.groupBy("site_id").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1)
    repeated = (
        with_id.join(first, "site_id")
        .filter(F.col("ord") > F.col("first"))
        .select("ord", F.lit("duplicate_id").alias("code"), F.col("site_id").alias("detail"))
    )
    return per_entry.unionByName(repeated)


def require_valid(raw: DataFrame, defaults: object = None) -> None:
    """Raise unless there is at least one site and no violation, in the entries and in the defaults."""
    if defaults is not None and not isinstance(defaults, dict):
        raise InvalidSettings("defaults: not an object")
    if raw.isEmpty():
        raise InvalidSettings("sites: at least one is needed")
    spark = raw.sparkSession
    common = {**(defaults or {}), "url": "https://defaults.invalid/"}
    checked = violations(raw).unionByName(
        violations(spark.createDataFrame([(0, json.dumps(common))], "ord int, entry string"))
    )
    if not checked.isEmpty():
        raise InvalidSettings(rows=checked.orderBy("ord", "code"))
