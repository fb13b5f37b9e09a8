"""Summaries of auctions and batches, first-wins maxima, top categories, price statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkyard.functions.scalars import truthy_price

SEXES = ("macho", "fêmea", "misto")
# Categories by column of the display.
MALE = ("bezerro", "garrote", "novilho", "boi", "touro")
FEMALE = ("bezerra", "novilha", "vaca", "bezerra desmamada", "vaca parida", "vaca prenha", "vaca com bezerro")


def price_mean(price: str) -> Column:
    """Mean of the positive prices, 0 without any."""
    return F.coalesce(F.avg(F.when(F.col(price) > 0, F.col(price))), F.lit(0.0))


def outcome_counts(sold: str) -> dict[str, Column]:
    return {"sold": F.count_if(F.col(sold)).cast("bigint"), "not_sold": F.count_if(~F.col(sold)).cast("bigint")}


def group_summary(rows: DataFrame, group: Sequence[str], n: str, price: str, sold: str, more: Sequence[Column] = ()) -> DataFrame:
    """(group, total_lots, total_animals, avg_price, sold, not_sold), and further aggregates."""
    return rows.groupBy(*group).agg(
        F.count("*").cast("bigint").alias("total_lots"),
        F.sum(n).cast("bigint").alias("total_animals"),
        price_mean(price).alias("avg_price"),
        *(c.alias(name) for name, c in outcome_counts(sold).items()),
        *more,
    )


def category_summary(rows: DataFrame, group: Sequence[str], category: str, n: str, price: str, order: str) -> DataFrame:
    """(group, category, animals, price, first): weighted counts and mean positive prices; first: lowest `order`."""
    return rows.groupBy(*group, F.col(category).alias("category")).agg(
        F.sum(n).cast("bigint").alias("animals"),
        F.avg(F.when(F.col(price) > 0, F.col(price))).alias("price"),
        F.min(order).alias("first"),
    )


def ranked_categories(categories: DataFrame, group: Sequence[str]) -> DataFrame:
    """With rank 1, 2, ...: most animals first, ties by first appearance."""
    order = Window.partitionBy(*group).orderBy(F.desc("animals"), "first", "category")
    return categories.withColumn("rank", F.row_number().over(order))


def auction_summary(lots: DataFrame) -> DataFrame:
    """One row a video with lots: totals, sexes, categories, prices, outcomes."""
    sexes = F.map_filter(
        F.map_from_arrays(F.array(*map(F.lit, SEXES)), F.array(*(F.coalesce(F.sum(F.when(F.col("sex") == s, F.col("num_animals"))), F.lit(0)).cast("bigint") for s in SEXES))),
        lambda _, v: v > 0,
    )
    totals = group_summary(lots, ["video_id"], "num_animals", "unit_price", "sold")
    by_sex = lots.groupBy("video_id").agg(sexes.alias("sex_animals"))
    ranked = ranked_categories(category_summary(lots, ["video_id"], "category", "num_animals", "unit_price", "lot_number"), ["video_id"])
    listed = ranked.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("rank", "category", "animals", "price"))).alias("c"))
    categories = listed.select(
        "video_id",
        F.get("c", F.lit(0))["category"].alias("top_category"),
        F.transform("c", lambda x: F.struct(x["category"].alias("category"), x["animals"].alias("animals"))).alias("category_animals"),
        F.map_from_entries(F.transform(F.filter("c", lambda x: x["price"].isNotNull()), lambda x: F.struct(x["category"], x["price"]))).alias("category_prices"),
    )
    return totals.join(by_sex, "video_id").join(categories, "video_id")


def first_maximum(rows: DataFrame, value: str, order: str, keep: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The row of the largest value, of equal ones the first; no row for no rows."""
    best = F.max_by(F.struct(*keep, F.col(value).alias("value")), F.struct(F.col(value), -F.col(order)))
    grouped = rows.groupBy(*group).agg(best.alias("b")) if group else rows.agg(best.alias("b")).where("b is not null")
    return grouped.select(*group, "b.*")


def top_categories(categories: DataFrame, n: int = 3, item: str = "index") -> DataFrame:
    """(category, animals) of the largest totals over all items; ties by first appearance.

    categories: item order, rank inside the item, category, animals.
    """
    total = categories.groupBy("category").agg(F.sum("animals").cast("bigint").alias("animals"), F.min(F.struct(item, "rank")).alias("first"))
    return total.orderBy(F.desc("animals"), "first").limit(n).select("category", "animals")


def price_pivot(rows: DataFrame, group: str, category: str, price: str, categories: Sequence[str]) -> DataFrame:
    """Mean price by group (rows) and category (columns)."""
    return rows.groupBy(group).pivot(category, list(categories)).agg(F.avg(price))


def bucketed(category: Column | str) -> Column:
    """male, female or other, for display."""
    c = F.col(category) if isinstance(category, str) else category
    return F.when(c.isin(*MALE), "male").when(c.isin(*FEMALE), "female").otherwise("other")


def run_statistics(lots: DataFrame, group: Sequence[str]) -> DataFrame:
    """What a benchmark run reports: outcomes, prices, and how many lots have which field."""
    positive = F.col("unit_price") > 0
    count = lambda c: F.count_if(c).cast("bigint")
    return lots.groupBy(*group).agg(
        F.count("*").cast("bigint").alias("total_lots"),
        F.sum("num_animals").cast("bigint").alias("total_animals"),
        count(F.col("sold")).alias("sold"),
        count(~F.col("sold")).alias("unsold"),
        count(F.col("sold").isNull()).alias("unknown_sold"),
        count(positive).alias("lots_with_price"),
        (F.count("*") - count(positive)).cast("bigint").alias("lots_without_price"),
        F.round(price_mean("unit_price"), 2).alias("avg_unit_price"),
        count((F.col("breed") != "") & (F.col("breed") != "Sem Raça Definida")).alias("lots_with_breed"),
        count(F.col("age_months").isNotNull()).alias("lots_with_age"),
        count(F.col("timestamp_start").isNotNull()).alias("lots_with_timestamp"),
        F.sort_array(F.collect_list("lot_number")).alias("lot_numbers"),
    )


def run_summary(lots: DataFrame, calls: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, lot_count, lots_with_price, lots_without_price, llm_calls, input_tokens, output_tokens)."""
    priced = F.count_if(truthy_price("unit_price")).cast("bigint")
    found = lots.groupBy(*group).agg(F.count("*").cast("bigint").alias("lot_count"), priced.alias("lots_with_price"), (F.count("*") - priced).cast("bigint").alias("lots_without_price"))
    used = usage(calls, group)
    return used.join(found, list(group), "left").na.fill(0, ["lot_count", "lots_with_price", "lots_without_price"])


def usage(calls: DataFrame, group: Sequence[str]) -> DataFrame:
    """Calls that answered and their tokens."""
    answered = F.col("error").isNull() if "error" in calls.columns else F.lit(True)
    total = lambda c: F.coalesce(F.sum(F.when(answered, F.col(c))), F.lit(0)).cast("bigint")
    return calls.groupBy(*group).agg(F.count_if(answered).cast("bigint").alias("llm_calls"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"))


def price_statistics(lots: DataFrame, group: Sequence[str], price: str = "unit_price", sold: str = "sold") -> DataFrame:
    """(group, n, sold, mean, median, min, max) over prices that are there and not 0."""
    p = F.when(truthy_price(price), F.col(price))
    return lots.groupBy(*group).agg(F.count("*").cast("bigint").alias("n"), F.count_if(F.col(sold)).cast("bigint").alias("sold"), F.avg(p).alias("mean"), F.median(p).alias("median"), F.min(p).alias("min"), F.max(p).alias("max"))


def by_timestamp(lots: DataFrame) -> DataFrame:
    """Lots in order of appearance; those without a time last."""
    return lots.orderBy(F.nullif("timestamp_start", F.lit("")).asc_nulls_last(), "lot_number")
