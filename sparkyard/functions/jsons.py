"""Tolerant JSON: strict acceptance of a text, salvage of a fragment, lax readers by JSON type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col, number, price_text, price_text_blank, repair_small, strip


#: The first bracketed group, up to the next closing bracket.
FIRST_BRACKETS = r"(?s)\[.*?\]"


def strict_json(text: Column | str) -> Column:
    """VARIANT of a text that is one JSON value and nothing more, else null.

    The parser alone would ignore what follows the first value. Wrapped as an array's and as an
    object's only value, such a text fails to parse in one of the two.
    """
    t = col(text)
    array = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    object_ = F.try_parse_json(F.concat(F.lit('{"x":'), t, F.lit("}")))
    value = F.try_variant_get(array, "$[0]", "variant")
    return F.when(value.isNotNull() & F.try_variant_get(array, "$[1]", "variant").isNull() & object_.isNotNull(), value)


def kind(v: Column) -> Column:
    """JSON type: STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID (null or missing), ARRAY, OBJECT."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit("VOID"))


def _kind(v: Column, k: Column | None) -> Column:
    """k, where the caller has the type as a column already."""
    return kind(v) if k is None else k


def array_of(text: Column | str) -> Column:
    """The text as a JSON array, else its first bracketed group (up to the next ]) as one, else null."""
    t = strip(text)
    whole, part = strict_json(t), strict_json(F.regexp_extract(t, FIRST_BRACKETS, 0))
    return F.coalesce(F.when(kind(whole) == "ARRAY", whole), F.when(kind(part) == "ARRAY", part))


def object_of(text: Column | str) -> Column:
    """What stands between the first { and the last }, as a JSON object, else null."""
    v = strict_json(F.regexp_extract(col(text), r"(?s)\{.*\}", 0))
    return F.when(kind(v) == "OBJECT", v)


def items(v: Column) -> Column:
    """A VARIANT array as an array of VARIANT."""
    return F.try_variant_get(v, "$", "array<variant>")


def field(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "variant")


def _as(v: Column, type_: str) -> Column:
    return F.try_variant_get(v, "$", type_)


def _numeric(k: Column) -> Column:
    return k.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def lax_int(v: Column, k: Column | None = None) -> Column:
    """Whole numbers, also as text or booleans; null is invalid."""
    k, n, s = _kind(v, k), _as(v, "double"), strip(_as(v, "string"))
    text = F.when(s.rlike(r"^[+-]?[0-9]+(_[0-9]+)*(\.0*)?$"), F.regexp_replace(F.regexp_replace(s, r"\..*$", ""), "_", "").try_cast("bigint"))
    return (
        F.when(k == "BIGINT", _as(v, "bigint"))
        .when(_numeric(k), F.when(n == F.floor(n), n.try_cast("bigint")))
        .when(k == "STRING", text)
        .when(k == "BOOLEAN", _as(v, "boolean").cast("bigint"))
    )


def lax_text(v: Column, k: Column | None = None) -> Column:
    """JSON strings as they are; null is invalid."""
    return F.when(_kind(v, k) == "STRING", _as(v, "string"))


def lax_bool(v: Column, k: Column | None = None) -> Column:
    """Booleans, 0 and 1, and their usual words; null is invalid."""
    k, n, s = _kind(v, k), _as(v, "double"), F.lower(_as(v, "string"))
    return (
        F.when(k == "BOOLEAN", _as(v, "boolean"))
        .when(_numeric(k), F.when(n == 1, True).when(n == 0, False))
        .when(k == "STRING", F.when(s.isin("1", "true", "t", "yes", "y", "on"), True).when(s.isin("0", "false", "f", "no", "n", "off"), False))
    )


def lax_price(v: Column, k: Column | None = None) -> Column:
    """Prices: numbers (small ones repaired), Brazilian text, booleans as 0 and 1."""
    k = _kind(v, k)
    return (
        F.when(_numeric(k), repair_small(_as(v, "double")))
        .when(k == "STRING", price_text(_as(v, "string")))
        .when(k == "BOOLEAN", repair_small(_as(v, "boolean").cast("int").cast("double")))
    )


def price_error(v: Column, k: Column | None = None) -> Column:
    """Whether a price is there but can't be read."""
    k = _kind(v, k)
    text = (k == "STRING") & ~price_text_blank(_as(v, "string")) & price_text(_as(v, "string")).isNull()
    return text | k.isin("ARRAY", "OBJECT")


def truthy(v: Column, k: Column | None = None) -> Column:
    """As a condition: false for null, false, zero, and empty text, lists and objects."""
    k, s = _kind(v, k), _as(v, "string")
    return (
        F.when(k == "BOOLEAN", _as(v, "boolean"))
        .when(_numeric(k), _as(v, "double") != 0)
        .when(k == "STRING", s != "")
        .when(k == "ARRAY", F.schema_of_variant(v) != "ARRAY<VOID>")
        .when(k == "OBJECT", F.schema_of_variant(v) != "OBJECT<>")
        .otherwise(False)
    )


__all__ = ["array_of", "field", "items", "kind", "lax_bool", "lax_int", "lax_price", "lax_text", "number", "object_of", "price_error", "strict_json", "truthy"]
