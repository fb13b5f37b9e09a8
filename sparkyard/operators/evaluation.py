"""Agreement of extracted lots with reference lots, run grids, totals and costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkyard.functions.scalars import token_cost, truthy_price


def last_by_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with the largest order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def matched(reference: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer match on keys, with in_ref and in_model; columns are prefixed r_ and m_."""
    tag = lambda df, p: df.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys), F.lit(True).alias(f"{p}_here"))
    joined = tag(reference, "r").join(tag(model, "m"), list(keys), "full_outer")
    return joined.withColumns({"in_ref": F.coalesce("r_here", F.lit(False)), "in_model": F.coalesce("m_here", F.lit(False))}).drop("r_here", "m_here")


def agreement(reference: DataFrame, model: DataFrame, keys: Sequence[str], group: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Counts, coverage, match rates and mean absolute price error of model against reference lots.

    Both need category, sex, num_animals and unit_price. Of repeated keys the last by `order` counts.
    """
    if order:
        reference, model = (last_by_key(x, keys, order) for x in (reference, model))
    rows = matched(reference, model, keys)
    both = F.col("in_ref") & F.col("in_model")
    count = lambda c: F.count_if(c).cast("bigint")
    same = lambda c: F.lower(F.coalesce(f"m_{c}", F.lit(""))) == F.lower(F.coalesce(f"r_{c}", F.lit("")))
    rate = lambda c, of: F.coalesce(F.count_if(c) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0))
    priced = both & truthy_price("r_unit_price") & truthy_price("m_unit_price")
    error = F.when(priced, F.abs(F.col("m_unit_price") - F.col("r_unit_price")) / F.when(priced, F.col("r_unit_price")))
    measures = [
        count(F.col("in_ref")).alias("ref_n"),
        count(F.col("in_model")).alias("model_n"),
        count(both).alias("matched"),
        count(F.col("in_ref") & ~F.col("in_model")).alias("missing"),
        count(~F.col("in_ref") & F.col("in_model")).alias("extra"),
        rate(both, F.col("in_ref")).alias("coverage"),
        rate(both & same("category"), both).alias("category_match"),
        rate(both & same("sex"), both).alias("sex_match"),
        rate(both & F.col("m_num_animals").eqNullSafe(F.col("r_num_animals")), both).alias("qty_match"),
        F.avg(error).alias("mape"),
        count(error < 0.05).alias("price_within_5pct"),
    ]
    return rows.groupBy(*group).agg(*measures) if group else rows.agg(*measures)


def grid(left: DataFrame, right: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every expected (left, right) pair with its result, if there is one. Both sides are lists of names, not data."""
    return left.crossJoin(right).join(results, list(keys), "left")


def set_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(matched, missing, extra) of two key sets."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    j = a.join(b, key, "full_outer")
    count = lambda c: F.count_if(c).cast("bigint")
    return j.agg(count(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"), count(F.col("r").isNull()).alias("missing"), count(F.col("l").isNull()).alias("extra"))


def totals(runs: DataFrame, prices: DataFrame, videos: int) -> DataFrame:
    """By model, over runs that ended well: lots, seconds, tokens, cost; averages are over all videos."""
    good = runs.where("status = 'ok'").join(prices, "model")
    cost = token_cost("input_tokens", "output_tokens", "input_price", "output_price")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return good.groupBy("model").agg(
        total("lot_count").cast("bigint").alias("lots"),
        total("elapsed_seconds").cast("double").alias("seconds"),
        total("input_tokens").cast("bigint").alias("input_tokens"),
        total("output_tokens").cast("bigint").alias("output_tokens"),
        total(cost).cast("double").alias("cost"),
        (total(cost) / videos).cast("double").alias("cost_per_video"),
    )


def by_metric(runs: DataFrame, model: str, metrics: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Metrics as rows, models as columns."""
    long = runs.select(model, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot([model], list(metrics), "metric", "value")
    return long.groupBy("metric").pivot(model, list(models)).agg(F.first("value"))
