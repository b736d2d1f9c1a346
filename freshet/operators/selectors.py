"""Selectors as Columns: tag, ``#id``, ``.class``, attributes, descendant, child and comma, held against an anchor's elements.

A selector is split into chains of compounds, outermost first; a path is the anchor's elements from the root to itself.
A chain is followed compound by compound through the places of the path at which it can stand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from freshet.functions.text import blank_to_null

_ATTRIBUTE = r"""\[[\w-]+(?:[~|^$*]?=(?:"[^"\s,>\]]*"|'[^'\s,>\]]*'|[^\s"',>\]]+))?\]"""
_COMPOUND = rf"(?:(?:\*|[A-Za-z][\w-]*)(?:[#.][\w-]+|{_ATTRIBUTE})*|(?:[#.][\w-]+|{_ATTRIBUTE})+)"
_CHAIN = rf"{_COMPOUND}(?:\s*>\s*{_COMPOUND}|\s+{_COMPOUND})*"
_VALID = rf"^\s*{_CHAIN}(?:\s*,\s*{_CHAIN})*\s*$"


def is_given(selector: Column) -> Column:
    return blank_to_null(F.coalesce(selector, F.lit(""))).isNotNull()


def is_unsupported(selector: Column) -> Column:
    """A selector outside the subset: it fails its pages rather than return wrong rows."""
    return is_given(selector) & ~selector.rlike(_VALID)


def chains(selector: Column) -> Column:
    """``array<array<struct<child, tag, ids, classes, tests>>>``; a test is name, operator and value of an attribute."""

    def test(inner: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(inner, r"^([\w-]+)", 1)).alias("name"),
            F.regexp_extract(inner, r"^[\w-]+([~|^$*]?=)?", 1).alias("op"),
            F.regexp_replace(inner, r"""^[\w-]+(?:[~|^$*]?=)?["']?|["']$""", "").alias("value"),
        )

    def compound(token: Column) -> Column:
        bare = F.regexp_replace(token, r"\[[^\]]*\]", "")
        return F.struct(
            token.startswith(">").alias("child"),
            F.lower(F.regexp_extract(token, r"^>?(\*|[A-Za-z][\w-]*)?", 1)).alias("tag"),
            F.regexp_extract_all(bare, F.lit(r"#([\w-]+)"), F.lit(1)).alias("ids"),
            F.regexp_extract_all(bare, F.lit(r"\.([\w-]+)"), F.lit(1)).alias("classes"),
            F.transform(F.regexp_extract_all(token, F.lit(r"\[([^\]]*)\]"), F.lit(1)), test).alias("tests"),
        )

    def chain(part: Column) -> Column:
        return F.transform(F.split(F.trim(F.regexp_replace(part, r"\s*>\s*", " >")), r"\s+"), compound)

    return F.transform(F.split(F.trim(selector), r"\s*,\s*"), chain)


def _passes(attributes: Column, test: Column) -> Column:
    have, op, want = F.try_element_at(attributes, test["name"]), test["op"], test["value"]
    passed = (
        F.when(op == "=", have == want)
        .when(op == "~=", F.array_contains(F.split(have, r"\s+"), want))
        .when(op == "|=", (have == want) | have.startswith(F.concat(want, F.lit("-"))))
        .when(want == "", op == "")
        .when(op == "^=", have.startswith(want))
        .when(op == "$=", have.endswith(want))
        .otherwise(have.contains(want))
    )
    return F.coalesce(have.isNotNull() & passed, F.lit(False))


def _fits(element: Column, compound: Column) -> Column:
    attributes = element["attributes"]
    classes = F.split(F.coalesce(F.try_element_at(attributes, F.lit("class")), F.lit("")), r"\s+")
    return (
        (compound["tag"].isin("", "*") | (compound["tag"] == element["tag"]))
        & F.forall(compound["ids"], lambda i: i.eqNullSafe(F.try_element_at(attributes, F.lit("id"))))
        & (F.size(F.array_except(compound["classes"], classes)) == 0)
        & F.forall(compound["tests"], lambda t: _passes(attributes, t))
    )


def is_selected(path: Column, selector_chains: Column) -> Column:
    """Whether the anchor, or an element around it, matches one of the chains."""

    def follow(places: Column, compound: Column) -> Column:
        def stands(place: Column) -> Column:
            before = F.when(compound["child"], F.array_contains(places, place - 1)).otherwise(F.coalesce(F.array_min(places) < place, F.lit(False)))
            return before & _fits(F.element_at(path, place), compound)

        return F.filter(F.sequence(F.lit(1), F.size(path)), stands)

    return F.exists(selector_chains, lambda chain: F.size(F.aggregate(chain, F.array(F.lit(0)), follow)) > 0)
