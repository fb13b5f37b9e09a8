"""Model responses to typed lots: tolerant JSON, lax validation by JSON type, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkyard.functions import jsons as J
from sparkyard.functions.scalars import repair_small, singular_category, strip

#: Fields of a lot in order, and whether they have to be there.
FIELDS = {
    "lot_number": True,
    "sex": True,
    "category": True,
    "num_animals": True,
    "breed": True,
    "age_months": False,
    "unit_price": False,
    "total_price": False,
    "sold": False,
    "timestamp_start": False,
    "notes": False,
}
_READ = {
    **dict.fromkeys(("lot_number", "num_animals", "age_months"), J.lax_int),
    **dict.fromkeys(("sex", "category", "breed", "timestamp_start", "notes"), J.lax_text),
    "sold": J.lax_bool,
    "unit_price": J.lax_price,
    "total_price": J.lax_price,
}


def _bad(name: str, v: Column, k: Column) -> Column:
    if name in ("unit_price", "total_price"):
        return J.price_error(v, k)
    unread = F.col(name).isNull() if name != "category" else J.lax_text(v, k).isNull()
    return unread if FIELDS[name] else unread & (k != "VOID")


def typed(rows: DataFrame, item: str) -> DataFrame:
    """rows with the lot's fields read from the VARIANT column `item`, and `errors`: the fields that are invalid.

    Fields, their JSON types and their values are columns of their own projections, so that each is
    worked out once.
    """
    v, k = (lambda n: F.col(f"__v_{n}")), (lambda n: F.col(f"__k_{n}"))
    shaped = rows.withColumn("__shape", J.kind(F.col(item)))
    fields = shaped.withColumns({f"__v_{n}": J.field(F.col(item), n) for n in FIELDS})
    kinds = fields.withColumns({f"__k_{n}": J.kind(v(n)) for n in FIELDS})
    read = {n: _READ[n](v(n), k(n)) for n in FIELDS}
    read["category"] = singular_category(read["category"])
    values = kinds.withColumns(read)
    wrong = F.filter(F.array(*(F.when(_bad(n, v(n), k(n)), F.lit(n)) for n in FIELDS)), lambda x: x.isNotNull())
    checked = values.withColumn("errors", F.when(F.col("__shape") == "OBJECT", wrong).otherwise(F.array(F.lit("shape"))))
    return checked.select(*rows.columns, *FIELDS, "errors")


def response_items(responses: DataFrame, text: str = "response") -> DataFrame:
    """responses without the text, with pos and item (VARIANT) for each element of its JSON array."""
    kept = [c for c in responses.columns if c != text]
    whole = responses.withColumn("__t", strip(text)).withColumn("__whole", J.strict_json("__t")).withColumn("__kw", J.kind(F.col("__whole")))
    # only what is no list as a whole is searched for one
    parted = whole.withColumn("__part", F.when(F.col("__kw") != "ARRAY", J.strict_json(F.regexp_extract("__t", J.FIRST_BRACKETS, 0)))).withColumn("__kp", J.kind(F.col("__part")))
    listed = parted.withColumn("__array", F.when(F.col("__kw") == "ARRAY", F.col("__whole")).when(F.col("__kp") == "ARRAY", F.col("__part")))
    return listed.select(*kept, F.posexplode(J.items(F.col("__array"))).alias("pos", "item"))


def read_lots(responses: DataFrame, text: str = "response") -> DataFrame:
    """Valid and invalid lots of all responses; `errors` is empty for the valid ones.

    A response that is no list, or none at all (a failed call), has no lots.
    """
    return typed(response_items(responses, text), "item")


def valid(lots: DataFrame) -> DataFrame:
    return lots.where(F.size("errors") == 0).drop("errors", "item")


def quarantine(lots: DataFrame) -> DataFrame:
    """The invalid ones as text, with what is wrong with them."""
    return lots.where(F.size("errors") > 0).withColumn("item", F.to_json("item"))


def rebuilt(lots: DataFrame) -> DataFrame:
    """Prices as a second construction of the record reads them: small ones repaired once more."""
    return lots.withColumns({c: repair_small(c) for c in ("unit_price", "total_price")})


def lots_of_text(rows: DataFrame, text: str = "value") -> DataFrame:
    """Lots of stored JSON arrays, strictly: a row that can't be read raises an error."""
    read = read_lots(rows.where(F.assert_true(J.kind(J.strict_json(text)) == "ARRAY", "not a JSON array").isNull()), text)
    checked = read.withColumn("errors", F.when(F.size("errors") == 0, F.col("errors")).otherwise(F.raise_error(F.concat(F.lit("invalid lot: "), F.array_join("errors", ",")))))
    return checked.where(F.size("errors") == 0).drop("errors", "item")
