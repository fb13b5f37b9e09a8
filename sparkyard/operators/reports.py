"""Batch items, batch reports, markdown and table views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkyard.functions.scalars import auction_name, auctioneer_name, dash, first_text, money, safe_folder, truthy_price

from .summaries import bucketed, by_timestamp, first_maximum

# Labels and headings of the report and its views.
LABELS = {"most_lots": "Most lots", "most_animals": "Most animals", "highest_avg_price": "Highest average price"}


def batch_items(urls: DataFrame, auctions: DataFrame, summary: DataFrame, failures: DataFrame, root: str = "output") -> DataFrame:
    """One row a URL: the auction's facts and summary, or the error.

    urls: ordinal, url, video_id. failures: ordinal, error. An auction without lots has zeros.
    """
    facts = auctions.withColumns({"auction_name": auction_name("auctioneer", "farm", "notes"), "auctioneer_display": auctioneer_name("auctioneer", "notes"), "output_dir": F.concat(F.lit(f"{root}/"), "video_id")})
    joined = urls.join(failures, "ordinal", "left").join(facts, "video_id", "left").join(summary, "video_id", "left")
    failed = F.col("error").isNotNull()
    zero = ("total_lots", "total_animals", "sold", "not_sold", "avg_price")
    counted = {c: F.when(~failed, F.coalesce(c, F.lit(0).cast(joined.schema[c].dataType))) for c in zero}
    joined = joined.withColumns({"status": F.when(failed, "failed").otherwise("success"), **counted})
    names = ("video_id", "output_dir", "date", "city", "auctioneer", "farm", "auction_type", "notes", "auction_name", "auctioneer_display")
    shown = [F.when(~failed, F.col(c)).alias(c) for c in names]
    rest = [F.when(~failed, F.col(c)).alias(c) for c in ("top_category", "category_animals", "category_prices")]
    return joined.select(F.col("ordinal").alias("index"), "status", "url", "error", *shown, *zero, *rest)


def batch_totals(items: DataFrame) -> DataFrame:
    """One row: attempted, successful and failed URLs, and sums over the successful ones."""
    good = F.col("status") == "success"
    total = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0)).cast("bigint")
    return items.agg(
        F.count("*").cast("bigint").alias("videos"),
        F.count_if(good).cast("bigint").alias("successful"),
        F.count_if(~good).cast("bigint").alias("failed"),
        total("total_lots").alias("lots"),
        total("total_animals").alias("animals"),
        total("sold").alias("sold"),
        total("not_sold").alias("not_sold"),
    )


def item_categories(items: DataFrame) -> DataFrame:
    """(index, rank, category, animals) of the successful items."""
    rows = items.where("status = 'success'").select("index", F.posexplode("category_animals").alias("rank", "c"))
    return rows.select("index", "rank", "c.category", "c.animals")


def comparison(items: DataFrame) -> DataFrame:
    """(measure, video_id, url, value) of the first maximum of each measure; none for no item."""
    good = items.where("status = 'success'")
    pick = lambda rows, name, c: first_maximum(rows.withColumn("v", F.col(c).cast("double")), "v", "index", ["video_id", "url"]).select(F.lit(name).alias("measure"), "*")
    parts = [pick(good, "most_lots", "total_lots"), pick(good, "most_animals", "total_animals"), pick(good.where(truthy_price("avg_price")), "highest_avg_price", "avg_price")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def batch_report(batch: str, items: DataFrame) -> DataFrame:
    """One row: batch, generated_at, totals, comparison, category totals, top categories, items."""
    totals = batch_totals(items).select(F.struct("*").alias("totals"))
    best = comparison(items).agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("video_id", "url", "value")))).alias("comparison"))
    ranked = item_categories(items).groupBy("category").agg(F.sum("animals").cast("bigint").alias("animals"), F.min(F.struct("index", "rank")).alias("first"))
    as_seen = F.transform(F.sort_array(F.collect_list(F.struct("first", "category", "animals"))), lambda x: F.struct(x["category"].alias("category"), x["animals"].alias("animals")))
    largest = F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("animals")).alias("less"), "first", "category"))), 1, 3), lambda x: x["category"])
    categories = ranked.agg(as_seen.alias("category_totals"), largest.alias("top_price_categories"))
    # maps can't be ordered, so prices are listed
    plain = items.withColumn("category_prices", F.map_entries("category_prices"))
    listed = plain.agg(F.sort_array(F.collect_list(F.struct(*plain.columns))).alias("items"))
    joined = totals.crossJoin(best).crossJoin(categories).crossJoin(listed)  # a single row each
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return joined.select(F.lit(batch).alias("batch"), now.alias("generated_at"), "totals", "comparison", "category_totals", "top_price_categories", "items")


def price_cell(prices: Column, category: Column) -> Column:
    """R$ cell of a category from an array of (key, value); - where there is none."""
    found = F.transform(F.filter(prices, lambda e: (e["key"] == category) & (e["value"] != 0)), lambda e: money(e["value"]))
    return F.coalesce(F.get(found, F.lit(0)), F.lit("-"))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown(report: DataFrame) -> DataFrame:
    """(batch, value): the report as markdown; lines are made row-wise, the items are those of one batch."""
    t = lambda c: F.col(f"totals.{c}").cast("string")
    head = [F.concat(F.lit("# Batch "), "batch"), F.lit(""), F.lit("## Summary"), F.lit("")]
    facts = {"Videos processed": "videos", "Successful": "successful", "Failed": "failed", "Lots": "lots", "Animals": "animals", "Sold": "sold", "Not sold": "not_sold"}
    head += [F.concat(F.lit(f"- {label}: "), t(c)) for label, c in facts.items()]
    best = lambda k: F.try_element_at("comparison", F.lit(k))
    whole = lambda k: F.when(F.lit(k) != "highest_avg_price", best(k)["value"].cast("bigint").cast("string")).otherwise(best(k)["value"].cast("string"))
    head += [F.lit(""), F.lit("## Comparison"), F.lit("")]
    head += [F.when(best(k).isNotNull(), F.concat(F.lit(f"- {label}: "), best(k)["video_id"], F.lit(" ("), whole(k), F.lit(")"))) for k, label in LABELS.items()]
    head += [F.lit(""), F.lit("## Videos"), F.lit(""), F.lit("| Status | Video | Data | Cidade | Leilão | Leiloeiro | Lots | Animals | Avg price |"), F.lit("|---|---|---|---|---|---|---:|---:|---:|")]
    good = lambda i: _row(
        F.lit("success"),
        i["video_id"],
        dash(i["date"]),
        dash(i["city"]),
        dash(first_text(i["auction_name"], i["farm"], i["auctioneer"])),
        dash(first_text(i["auctioneer_display"], i["auctioneer"])),
        i["total_lots"].cast("string"),
        i["total_animals"].cast("string"),
        F.replace(F.format_number(i["avg_price"], 2), F.lit(","), F.lit("")),
    )
    bad = lambda i: _row(F.lit("failed"), i["url"], *map(F.lit, ("-", "-", "-", "-", "0", "0", "0.00")))
    videos = F.transform("items", lambda i: F.when(i["status"] == "success", good(i)).otherwise(bad(i)))
    cats = F.col("top_price_categories")
    priced = F.transform(F.filter("items", lambda i: i["status"] == "success"), lambda i: F.concat(F.lit("| "), i["video_id"], F.lit(" | "), F.array_join(F.transform(cats, lambda c: price_cell(i["category_prices"], c)), " | "), F.lit(" |")))
    title = F.array(
        F.lit(""),
        F.lit("## Preço por Categoria"),
        F.lit(""),
        F.concat(F.lit("| Video | "), F.array_join(cats, " | "), F.lit(" |")),
        F.concat(F.lit("|---|"), F.array_join(F.transform(cats, lambda _: F.lit("---:")), "|"), F.lit("|")),
    )
    tail = F.when(F.size(cats) > 0, F.concat(title, priced)).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.filter(F.array(*head), lambda x: x.isNotNull()), videos, tail, F.array(F.lit("")))
    return report.select("batch", F.array_join(lines, "\n").alias("value"))


def report_folder(name: str | None, root: str = "output") -> Column:
    """<root>/batches/<safe name>; without a name one by the time."""
    named = F.lit(name) if name else F.date_format(F.current_timestamp(), "'batch_'yyyyMMdd_HHmmss")
    return F.concat(F.lit(f"{root}/batches/"), safe_folder(named))


def _priced_cell(c: str) -> Column:
    return F.when(F.coalesce(F.col(c) != 0, F.lit(False)), money(c)).otherwise("-")


def summary_view(summary: DataFrame) -> DataFrame:
    """A terminal view of auction summaries: animals and mean prices of the male, female and other categories."""
    in_bucket = lambda name: F.filter("category_animals", lambda x: bucketed(x["category"]) == name)
    heads = lambda name: F.array_join(F.transform(in_bucket(name), lambda x: F.concat(x["category"], F.lit(": "), x["animals"].cast("string"))), "  |  ")
    known = lambda name: F.filter(in_bucket(name), lambda x: F.map_contains_key("category_prices", x["category"]))
    prices = lambda name: F.array_join(F.transform(known(name), lambda x: F.concat(x["category"], F.lit(": "), money(F.try_element_at("category_prices", x["category"])))), "  |  ")
    parts = {f"{name}_{what}": made(name) for name in ("male", "female", "other") for what, made in (("animals", heads), ("prices", prices))}
    return summary.select("video_id", "total_lots", "total_animals", _priced_cell("avg_price").alias("avg_price"), *(c.alias(n) for n, c in parts.items()), "sold", "not_sold")


def batch_view(items: DataFrame) -> DataFrame:
    """A terminal view of batch items; failed ones show their URL."""
    good = F.col("status") == "success"
    cell = lambda c: F.when(good, dash(c)).otherwise("-")
    return items.orderBy("index").select(
        F.when(good, "OK").otherwise("FAIL").alias("status"),
        F.when(good, F.col("video_id")).otherwise(F.col("url")).alias("video"),
        cell("date").alias("date"),
        cell("city").alias("city"),
        cell(first_text("auction_name", "farm", "auctioneer")).alias("auction"),
        cell(first_text("auctioneer_display", "auctioneer")).alias("auctioneer"),
        cell("total_lots").alias("lots"),
        cell("total_animals").alias("animals"),
        F.when(good, _priced_cell("avg_price")).otherwise("-").alias("avg_price"),
    )


def price_view(items: DataFrame, categories: list[str]) -> DataFrame:
    """Mean prices of the named categories (columns) by successful item; - where there is none."""
    listed = F.map_entries("category_prices")
    return items.where("status = 'success'").orderBy("index").select("video_id", *(price_cell(listed, F.lit(c)).alias(c) for c in categories))


def lots_view(lots: DataFrame) -> DataFrame:
    """A terminal view of lots in order of appearance."""
    text = {c: dash(c) for c in ("age_months", "notes")} | {c: _priced_cell(c) for c in ("unit_price", "total_price")}
    sold = F.when(F.col("sold"), "yes").when(~F.col("sold"), "no").otherwise("-")
    return by_timestamp(lots).withColumns(text | {"sold": sold, "timestamp_start": dash("timestamp_start")})
