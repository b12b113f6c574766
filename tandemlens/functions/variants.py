"""JSON values of any shape, walked as variants: text of a value, and cuts by depth and length.

An object's keys come out in their sorted order, as a variant keeps them. JSON that does not parse counts as null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements of a list that are kept, and levels that are looked into.
ITEMS = 10
DEPTH = 10


def _object(v: Column) -> Column:
    """The members of an object; null for anything else."""
    return F.map_entries(F.try_variant_get(v, "$", "map<string, variant>"))


def _array(v: Column) -> Column:
    """The elements of an array; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _text(v: Column) -> Column:
    """A scalar as its text, anything else as its JSON; null is empty."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.nullif(F.to_json(v), F.lit("null")), F.lit(""))


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _bound(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def text_of(v: Column, items: int = ITEMS, depth: int = DEPTH) -> Column:
    """One text for a value of any shape.

    A scalar gives its text; an array its only element, or the first `items` joined by blanks; an object with a
    `text` what that gives, `depth` levels deep at most; any other object its JSON; null and nothing the empty text.
    """
    if depth == 0:
        return _text(v)

    def joined(elements: Column) -> Column:
        return F.array_join(F.transform(F.slice(elements, 1, items), _text), " ")

    def of(found: Column) -> Column:
        inner = F.try_variant_get(v, "$.text", "variant")
        has_text = F.exists(found["members"], lambda e: e["key"] == "text")
        return (
            F.when(found["members"].isNotNull() & has_text, text_of(inner, items, depth - 1))
            .when(found["elements"].isNotNull(), joined(found["elements"]))
            .otherwise(_text(v))
        )

    return _bound(F.struct(_object(v).alias("members"), _array(v).alias("elements")), of)


def capped_json(v: Column, items: int = ITEMS, depth: int = DEPTH) -> Column:
    """JSON of a value with every array cut to `items` elements; what lies more than `depth` levels down becomes a string.

    The value itself is level 0. A scalar there becomes its text, an object or array its JSON as a string; null stays
    null at any level. The expression grows with `depth` only, as members and elements are walked as one list.
    """
    if depth < 0:
        return F.when(v.isNull() | (F.to_json(v) == "null"), "null").otherwise(_quoted(_text(v)))
    nothing = F.lit("")

    def of(found: Column) -> Column:
        members = F.transform(
            found["members"], lambda e: F.struct(F.concat(_quoted(e["key"]), F.lit(":")).alias("name"), e["value"].alias("value"))
        )
        elements = F.transform(
            F.slice(found["elements"], 1, items), lambda x: F.struct(nothing.alias("name"), x.alias("value"))
        )
        parts = F.transform(
            F.coalesce(members, elements), lambda p: F.concat(p["name"], capped_json(p["value"], items, depth - 1))
        )
        is_object = found["members"].isNotNull()
        nested = F.concat(
            F.when(is_object, "{").otherwise("["), F.array_join(parts, ","), F.when(is_object, "}").otherwise("]")
        )  # written once, or the expression would double with each level
        whole = is_object | found["elements"].isNotNull()
        return F.when(whole, nested).otherwise(F.coalesce(F.to_json(v), F.lit("null")))

    return _bound(F.struct(_object(v).alias("members"), _array(v).alias("elements")), of)
