"""Lots: invariant repair, burst guard, merge, outlier fence, verdicts, totals.

Operators take column names, so that they work on any table with such columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkyard.functions import jsons as J
from sparkyard.functions.scalars import evidenced_lots, has_evidence, hms_seconds_strict, money, repair_small

TOLERANCE, FENCE, BURST = 0.2, 1.5, 12
#: Groups up to which a row a group (some 100 bytes) travels to all tasks; more are joined by a shuffle.
GROUPS_SENT = 50_000


def repair(rows: DataFrame, unit: str = "unit_price", total: str = "total_price", n: str = "num_animals", lo: str | None = None, hi: str | None = None, rebuild: bool = True) -> DataFrame:
    """The four invariants in order, each on what the one before left; then prices are re-read.

    1 a unit price outside [lo, hi] goes; 2 a total that is off unit * n by over 20 % goes; 3 if the
    unit price is still above the total both go; 4 without a unit price, a total whose share a head
    is outside [lo, hi] goes.
    """
    u, t, k = F.col(unit), F.col(total), F.col(n)
    outside = lambda x: (x < F.col(lo)) | (x > F.col(hi))
    if lo and hi:
        rows = rows.withColumn(unit, F.when(u.isNotNull() & outside(u), None).otherwise(u))
    top = F.greatest(u * k, t)
    off = u.isNotNull() & t.isNotNull() & (k > 0) & (top > 0) & (F.abs(u * k - t) / F.when(top > 0, top) > TOLERANCE)
    rows = rows.withColumn(total, F.when(off, None).otherwise(t))
    above = F.coalesce(u > t, F.lit(False))
    rows = rows.withColumns({unit: F.when(above, None).otherwise(u), total: F.when(above, None).otherwise(t)})
    if lo and hi:
        each = u.isNull() & t.isNotNull() & (k > 0) & outside(t / F.when(k > 0, k))
        rows = rows.withColumn(total, F.when(each, None).otherwise(t))
    return rows.withColumns({unit: repair_small(u), total: repair_small(t)}) if rebuild else rows


def fill_total(rows: DataFrame, unit: str = "unit_price", total: str = "total_price", n: str = "num_animals") -> DataFrame:
    """A missing total as round(unit * n, 2), unless n is 0."""
    made = F.when(F.col(n) != 0, F.round(F.col(unit) * F.col(n), 2))
    return rows.withColumn(total, F.coalesce(F.col(total), repair_small(made)))


def burst_guard(rows: DataFrame, group: str, window: str, lot: str, supported: str, limit: int = BURST) -> DataFrame:
    """Without the lots of crowded windows that neither an earlier window kept nor their own text shows."""
    crowded = F.count("*").over(Window.partitionBy(group, window)) > limit
    first = F.min(F.when(~F.col("__crowded") | F.col(supported), F.col(window))).over(Window.partitionBy(group, lot))
    return rows.withColumn("__crowded", crowded).withColumn("__first", first).where(F.col(window) >= F.col("__first")).drop("__crowded", "__first")


def merge_records(rows: DataFrame, keys: Sequence[str], order: Sequence[str], first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """One row a key: of each column the first or the last value that is not null, by `order`.

    Partial aggregation keeps two values a column and task, whatever the size of a key's group.
    """
    at = F.struct(*order)
    known = lambda c: F.when(F.col(c).isNotNull(), at)
    return rows.groupBy(*keys).agg(*(F.min_by(c, known(c)).alias(c) for c in first), *(F.max_by(c, known(c)).alias(c) for c in last))


STABLE = ("sex", "category", "num_animals", "breed", "age_months", "timestamp_start", "notes")


def merge_lots(lots: DataFrame) -> DataFrame:
    """Lots by (video_id, lot_number): descriptions from the first mention, prices and outcome from the last."""
    return merge_records(lots, ("video_id", "lot_number"), ("window_idx", "pos"), STABLE, ("unit_price", "total_price", "sold"))


def _quartile(d: Column, i: int) -> Column:
    """Quartile i of a sorted array, exclusive method (position i * (n + 1) / 4)."""
    p = F.lit(i) * (F.size(d) + 1)
    at = F.floor(p / 4).cast("int")
    return (F.get(d, at - 1) * (4 - p % 4) + F.get(d, at) * (p % 4)) / 4


def _fence(q1: Column, q3: Column, n: Column, k: float, least: int) -> tuple[Column, Column]:
    lo = F.when(n < least, 0.0).otherwise(F.greatest(F.lit(0.0), q1 - k * (q3 - q1)))
    hi = F.when(n < least, float("inf")).otherwise(q3 + k * (q3 - q1))
    return lo, hi


def fences(rows: DataFrame, group: Sequence[str], value: str, k: float = FENCE, least: int = 5) -> DataFrame:
    """(group, n, q1, q3, lo, hi) of the positive values; for groups that fit an array (lots of a video)."""
    d = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.when(F.col(value) > 0, F.col(value)))).alias("d"))
    q = d.select(*group, F.size("d").cast("bigint").alias("n"), _quartile(F.col("d"), 1).alias("q1"), _quartile(F.col("d"), 3).alias("q3"))
    lo, hi = _fence(F.col("q1"), F.col("q3"), F.col("n"), k, least)
    return q.withColumns({"lo": lo, "hi": hi})


def fences_of_large_groups(rows: DataFrame, group: Sequence[str], value: str, k: float = FENCE, least: int = 5) -> DataFrame:
    """As `fences`, for groups of any size: no array, no task that holds a group, no shuffle of all rows.

    Approximate quantiles just below and above each quartile cut a group into five buckets. One more
    scan counts the outer buckets as wholes and the two narrow ones, a few in ten thousand rows, by
    value; running counts then give the exact neighbours of each quartile. Where an approximation is
    so far off that a neighbour lies in an outer bucket, that bucket is counted by value too; with
    none of these, that scan does not run. The groups' cuts are counted: up to GROUPS_SENT of them
    travel to all tasks, and the result is marked for such joins as well.
    """
    keys = [F.col(c) for c in group]
    given = F.when(F.col(value) > 0, F.col(value))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(given, [0.2497, 0.2503, 0.7497, 0.7503], 10_000).alias("cuts"), F.count(given).alias("n")).persist()
    sent = F.broadcast if cuts.count() <= GROUPS_SENT else lambda df: df
    v, c = F.col("v"), F.col("cuts")
    place = F.when(v < c[0], 0).when(v <= c[1], 1).when(v < c[2], 2).when(v <= c[3], 3).otherwise(4)
    named = cuts.select(*(F.col(x).alias(f"__{x}") for x in group), "cuts", "n")
    here = rows.where(F.col(value) > 0).select(*keys, F.col(value).alias("v"))
    placed = here.join(sent(named), [here[x].eqNullSafe(named[f"__{x}"]) for x in group]).select(*group, "v", "n", place.alias("b"))
    counted = placed.groupBy(*keys, "n", "b", F.when(F.col("b").isin(1, 3), v).alias("v")).agg(F.count("*").alias("t"))
    # 0-based ranks wanted: p // 4 - 1 and p // 4 for p = i * (n + 1)
    wanted = F.array(*(F.floor(F.lit(i) * (F.col("n") + 1) / 4) + s for i in (1, 3) for s in (-1, 0)))
    order = Window.partitionBy(*keys).orderBy("b", "v").rowsBetween(Window.unboundedPreceding, 0)
    ends = counted.withColumn("e", F.sum("t").over(order)).withColumns({"s": F.col("e") - F.col("t"), "w": wanted})
    ends = ends.where(F.exists("w", lambda x: (x >= F.col("s")) & (x < F.col("e")))).select(*group, "n", "b", "v", "s", "e", "w")
    outer = ends.where("v is null").select(*(F.col(x).alias(f"__{x}") for x in group), F.col("b").alias("__b"), "s", "w")
    near = placed.join(sent(outer), [*(placed[x].eqNullSafe(outer[f"__{x}"]) for x in group), placed["b"] == outer["__b"]])
    near = near.groupBy(*keys, "n", "b", "v", "s", "w").agg(F.count("*").alias("t"))
    upto = F.col("s") + F.sum("t").over(Window.partitionBy(*keys, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("e", upto).withColumn("s", F.col("e") - F.col("t")).select(*group, "n", "b", "v", "s", "e", "w")
    ranked = ends.where("v is not null").unionByName(near)
    value_at = lambda i: F.max(F.when((F.get("w", F.lit(i)) >= F.col("s")) & (F.get("w", F.lit(i)) < F.col("e")), v))
    four = ranked.groupBy(*keys).agg(*(value_at(i).alias(f"x{i}") for i in range(4)))
    four = four.select(*(F.col(x).alias(f"__{x}") for x in group), *(f"x{i}" for i in range(4)))
    # groups without a positive value have no neighbours
    found = cuts.select(*group, F.col("n").cast("bigint").alias("n")).join(sent(four), [F.col(x).eqNullSafe(F.col(f"__{x}")) for x in group], "left")
    p = lambda i: (F.lit(i) * (F.col("n") + 1)) % 4
    q1 = (F.col("x0") * (4 - p(1)) + F.col("x1") * p(1)) / 4
    q3 = (F.col("x2") * (4 - p(3)) + F.col("x3") * p(3)) / 4
    lo, hi = _fence(F.col("q1"), F.col("q3"), F.col("n"), k, least)
    return sent(found.select(*group, "n", q1.alias("q1"), q3.alias("q3")).withColumns({"lo": lo, "hi": hi}))


def flag_outliers(rows: DataFrame, bounds: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """rows with lo, hi and outlier: the value is there, the fence is finite, and it is outside."""
    joined = rows.join(bounds.select(*group, "lo", "hi"), list(group), "left")
    out = F.col(value).isNotNull() & (F.col("hi") < float("inf")) & ((F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi")))
    return joined.withColumn("outlier", F.coalesce(out, F.lit(False)))


def evidence_packets(flagged: DataFrame, windows: DataFrame, size: int, overlap: int) -> DataFrame:
    """(video_id, lot_number, packet): what a verifier is asked about each outlier that has a window."""
    from .timeline import first_cover

    placed = first_cover(flagged.where("outlier").withColumn("at", hms_seconds_strict("timestamp_start")), "at", None, size, overlap)
    joined = placed.join(windows.select("video_id", "window_idx", "label", "combined_text"), ["video_id", "window_idx"])
    line = lambda head, value: F.concat(F.lit(head), value.cast("string"))
    packet = F.concat_ws(
        "\n",
        F.lit("Lote a verificar:"),
        line("- Número: ", F.col("lot_number")),
        line("- Categoria: ", F.col("category")),
        line("- Sexo: ", F.col("sex")),
        line("- Quantidade: ", F.col("num_animals")),
        F.concat(F.lit("- Idade: "), F.col("age_months").cast("string"), F.lit(" meses")),
        line("- Raça: ", F.col("breed")),
        line("- Preço por cabeça extraído: ", money("unit_price")),
        line("- Timestamp: ", F.col("timestamp_start")),
        F.lit(""),
        F.concat(F.lit("Evidências da janela ["), "label", F.lit("]:")),
        F.lit(""),
        "combined_text",
    )
    return joined.select("video_id", "lot_number", packet.alias("packet"))


def with_verdicts(rows: DataFrame, response: str, unit: str) -> DataFrame:
    """rows with `verdict` (confirm, price, discard; null for an unreadable response) and `verdict_price`."""
    read = rows.withColumn("__v", J.object_of(response))
    said = read.withColumns({"__yes": J.field(F.col("__v"), "confirmed"), "__said": J.field(F.col("__v"), "correct_unit_price")})
    said = said.withColumns({"__ky": J.kind(F.col("__yes")), "__ks": J.kind(F.col("__said"))})
    said = said.withColumns({"__confirmed": F.coalesce(J.truthy(F.col("__yes"), F.col("__ky")), F.lit(False)), "__price": J.lax_price(F.col("__said"), F.col("__ks"))})
    price = F.col("__price")
    verdict = (
        F.when(F.col("__v").isNull(), None)
        .when(F.col("__confirmed"), "confirm")
        .when((F.col("__ks") == "VOID") | price.isNull(), "discard")
        .when(F.abs(price - F.col(unit)) < 0.01, "confirm")
        .otherwise("price")
    )
    judged = said.withColumn("verdict", verdict).withColumn("verdict_price", F.when(F.col("verdict") == "price", price))
    return judged.select(*rows.columns, "verdict", "verdict_price")


def apply_verdicts(flagged: DataFrame, responses: DataFrame | None) -> DataFrame:
    """Outliers as the verifier judged them; `trusted` marks those that stay outside the fence.

    flagged: lots with lo, hi and outlier. responses: (video_id, lot_number, response); an outlier
    without one, or with an unreadable one, loses both prices. None: there is no verifier, and all
    lots pass as they are.
    """
    if responses is None:
        return flagged.withColumn("trusted", F.lit(False))
    asked = responses.select("video_id", "lot_number", "response")
    rows = flagged.join(asked, ["video_id", "lot_number"], "left")
    # without a time of its own a lot has no window, and so no verdict
    heard = F.when(hms_seconds_strict("timestamp_start").isNotNull(), F.col("response"))
    rows = with_verdicts(rows.withColumn("response", heard), "response", "unit_price")
    inside = (F.col("verdict_price") >= F.col("lo")) & (F.col("verdict_price") <= F.col("hi"))
    keep = ~F.col("outlier") | F.coalesce(F.col("verdict") == "confirm", F.lit(False))
    unit = F.when(keep, F.col("unit_price")).when((F.col("verdict") == "price") & inside, repair_small(F.col("verdict_price")))
    total = F.when(keep, F.col("total_price"))
    rows = rows.withColumns({"unit_price": unit, "total_price": total}).drop("verdict", "verdict_price", "response")
    return rows.withColumn("trusted", F.coalesce((F.col("unit_price") < F.col("lo")) | (F.col("unit_price") > F.col("hi")), F.lit(False)))


def settle(judged: DataFrame) -> DataFrame:
    """Final repair inside the fence (trusted lots outside it), and totals."""
    rows = judged.withColumns({"__lo": F.when(F.col("trusted"), F.lit(float("-inf"))).otherwise(F.coalesce("lo", F.lit(0.0))), "__hi": F.when(F.col("trusted"), F.lit(float("inf"))).otherwise(F.coalesce("hi", F.lit(float("inf"))))})
    return fill_total(repair(rows, lo="__lo", hi="__hi")).drop("__lo", "__hi")


def with_support(lots: DataFrame, windows: DataFrame) -> DataFrame:
    """lots with `supported`: their window's text names the lot number."""
    seen = windows.select("video_id", "window_idx", evidenced_lots("combined_text").alias("__seen"))
    joined = lots.join(seen, ["video_id", "window_idx"], "left")
    return joined.withColumn("supported", F.coalesce(has_evidence("lot_number", "__seen"), F.lit(False))).drop("__seen")


def prior_lots(kept: DataFrame, windows: DataFrame) -> DataFrame:
    """(video_id, window_idx, prior): the ascending numbers of lots that the windows before each one kept; null for none.

    kept: video_id, window_idx, lot_number. A number counts from the first window that kept it.
    """
    first = kept.groupBy("video_id", "lot_number").agg(F.min("window_idx").alias("__first"))
    joined = windows.select("video_id", "window_idx").join(first, (windows["video_id"] == first["video_id"]) & (F.col("__first") < F.col("window_idx")), "left").select(windows["video_id"], "window_idx", "lot_number")
    listed = joined.groupBy("video_id", "window_idx").agg(F.sort_array(F.collect_set("lot_number")).alias("prior"))
    return listed.withColumn("prior", F.when(F.size("prior") > 0, F.col("prior")))
