"""Queries that run the engine's operators on the driver's tables, with their DuckDB equivalents.

Each query calls the operator; its SQL restates what the operator promises in plain terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkyard.functions import jsons as J
from sparkyard.functions import scalars as S
from sparkyard.operators import evaluation, lots, parsing, reports, summaries, timeline

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _all() -> None:
    from . import registry_stages  # noqa: F401  adds its queries


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as points and intervals on the user's own timeline, in seconds of the day."""
    e = _table(spark, sf_dir, "events")
    at = F.expr("extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts))").cast("double")
    return e.select("event_id", "user_id", "event_type", "value", at.alias("s"), (at + F.col("value")).alias("e"))


_AT = "(extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts)))::DOUBLE"


@_query(
    f"""WITH p AS (SELECT event_id, {_AT} AS s, {_AT} + value AS e FROM events),
    w AS (SELECT range AS k FROM range(0, 400))
    SELECT event_id, k::INTEGER AS window_idx FROM p, w WHERE e >= 540 * k AND s <= 540 * k + 600"""
)
def overlap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.assign(_seconds(spark, sf_dir), "s", "e").select("event_id", "window_idx")


@_query(
    f"""WITH p AS (SELECT user_id, {_AT} AS s FROM events), w AS (SELECT range AS k FROM range(0, 400))
    SELECT user_id, k::INTEGER AS window_idx, count(*)::BIGINT AS n FROM p, w WHERE s >= 540 * k AND s <= 540 * k + 600 GROUP BY 1, 2"""
)
def point_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.assign(_seconds(spark, sf_dir), "s", "s").groupBy("user_id", "window_idx").agg(F.count("*").alias("n"))


@_query(
    f"""WITH p AS (SELECT event_id, {_AT} AS s FROM events), w AS (SELECT range AS k FROM range(0, 400))
    SELECT event_id, min(k)::INTEGER AS window_idx FROM p, w WHERE s >= 540 * k AND s <= 540 * k + 600 GROUP BY 1"""
)
def first_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.first_cover(_seconds(spark, sf_dir), "s").select("event_id", "window_idx")


@_query(
    f"""WITH t AS (SELECT user_id, max({_AT})::INTEGER + 1 AS total FROM events GROUP BY 1), w AS (SELECT range AS k FROM range(0, 400))
    SELECT user_id, k::INTEGER AS window_idx, (540 * k)::INTEGER AS window_start, (540 * k + 600)::INTEGER AS window_end,
    printf('%02d:%02d:%02d', (540 * k) // 3600, (540 * k) % 3600 // 60, (540 * k) % 60) || ' - ' || printf('%02d:%02d:%02d', (540 * k + 600) // 3600, (540 * k + 600) % 3600 // 60, (540 * k + 600) % 60) AS label
    FROM t, w WHERE 540 * k < total"""
)
def window_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _seconds(spark, sf_dir).groupBy("user_id").agg((F.max("s").cast("int") + 1).alias("total"))
    return timeline.spine(total, "user_id", "total")


_LINES = """SELECT conv_id, k, string_agg('[' || printf('%02d:%02d:%02d', sec // 3600, sec % 3600 // 60, sec % 60) || '] ' || CASE WHEN role = 'user' THEN 'ÁUDIO: ' ELSE 'TELA: ' END || text,
    chr(10) ORDER BY sec, CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn) AS combined_text
    FROM (SELECT conv_id, turn, role, text, (turn * 270)::BIGINT AS sec FROM conversations), range(0, 400) w(k)
    WHERE sec >= 540 * k AND sec <= 540 * k + 600 GROUP BY 1, 2"""


def _conversation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("int").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") * 270).alias("sec"))
    speech = rows.where("role = 'user'").select("video_id", F.col("turn").alias("seg_idx"), F.col("sec").cast("double").alias("start"), F.col("sec").cast("double").alias("end"), "text")
    screen = rows.where("role <> 'user'").select("video_id", F.col("turn").alias("ocr_idx"), S.hms("sec").alias("ts"), F.array("text").alias("tokens"))
    return timeline.text_windows(speech, screen)


@_query(
    f"""WITH l AS ({_LINES}), t AS (SELECT conv_id, max(turn * 270) + 1 AS total FROM conversations GROUP BY 1),
    s AS (SELECT conv_id, k FROM t, range(0, 400) w(k) WHERE 540 * k < total)
    SELECT s.conv_id::VARCHAR AS video_id, s.k::INTEGER AS window_idx, coalesce(combined_text, '(sem conteúdo)') AS combined_text FROM s LEFT JOIN l USING (conv_id, k)"""
)
def assemble_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversation_windows(spark, sf_dir).select("video_id", "window_idx", "combined_text")


@_query(
    f"""WITH l AS ({_LINES}) SELECT conv_id::VARCHAR AS video_id,
    string_agg('[' || printf('%02d:%02d:%02d', (540 * k) // 3600, (540 * k) % 3600 // 60, (540 * k) % 60) || ' - ' || printf('%02d:%02d:%02d', (540 * k + 600) // 3600, (540 * k + 600) % 3600 // 60, (540 * k + 600) % 60) || ']' || chr(10) || combined_text, chr(10) || chr(10) ORDER BY k) AS context
    FROM l WHERE k < 3 AND 540 * k <= (SELECT max(turn * 270) FROM conversations c WHERE c.conv_id = l.conv_id) GROUP BY 1"""
)
def metadata_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.head_context(_conversation_windows(spark, sf_dir))


_FENCE = """d AS (SELECT l_returnflag AS g, list_sort(list(l_extendedprice)) AS d, count(*) AS n FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1),
    q AS (SELECT g, n::BIGINT AS n, (d[(n+1)//4]*(4-(n+1)%4) + d[(n+1)//4+1]*((n+1)%4))/4 AS q1, (d[3*(n+1)//4]*(4-3*(n+1)%4) + d[3*(n+1)//4+1]*(3*(n+1)%4))/4 AS q3 FROM d),
    f AS (SELECT g, n, q1, q3, greatest(0, q1 - 1.5*(q3-q1))::DOUBLE AS lo, (q3 + 1.5*(q3-q1))::DOUBLE AS hi FROM q)"""


@_query(f"WITH {_FENCE} SELECT g AS l_returnflag, n, round(q1, 4) AS q1, round(q3, 4) AS q3, round(lo, 4) AS lo, round(hi, 4) AS hi FROM f")
def tukey_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups hold the whole table, so the form without arrays."""
    found = lots.fences_of_large_groups(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return found.select("l_returnflag", "n", *(F.round(c, 4).alias(c) for c in ("q1", "q3", "lo", "hi")))


@_query(
    """WITH d AS (SELECT o_custkey AS g, list_sort(list(o_totalprice)) AS d, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1)
    SELECT g AS o_custkey, n::BIGINT AS n,
    round(CASE WHEN n < 5 THEN 0 ELSE greatest(0, (d[(n+1)//4]*(4-(n+1)%4) + d[(n+1)//4+1]*((n+1)%4))/4*2.5 - 1.5*(d[3*(n+1)//4]*(4-3*(n+1)%4) + d[3*(n+1)//4+1]*(3*(n+1)%4))/4) END::DOUBLE, 6) AS lo FROM d"""
)
def tukey_bounds_small_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lots.fences(_table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice")
    return found.select("o_custkey", "n", F.round("lo", 6).alias("lo"))


@_query(f"WITH {_FENCE} SELECT l_returnflag, count(*)::BIGINT AS n, count(*) FILTER (WHERE l_extendedprice < lo OR l_extendedprice > hi)::BIGINT AS outliers FROM lineitem JOIN f ON g = l_returnflag GROUP BY 1")
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    flagged = lots.flag_outliers(rows, lots.fences_of_large_groups(rows, ["l_returnflag"], "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return flagged.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if("outlier").alias("outliers"))


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as lots: unit price, a total that is off for some rows, a count of heads."""
    li = _table(spark, sf_dir, "lineitem")
    n = F.col("l_quantity").cast("bigint") % 7
    unit = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    total = F.round(unit * n * F.when(F.col("l_partkey") % 5 == 0, 0.5).when(F.col("l_partkey") % 5 == 1, 1.1).otherwise(1.0), 2)
    return li.select("l_returnflag", "l_linestatus", n.alias("n"), F.when(F.col("l_suppkey") % 11 == 0, None).otherwise(unit).alias("u"), F.when(F.col("l_suppkey") % 13 == 0, None).otherwise(total).alias("t"))


_BASE = """b AS (SELECT *, l_quantity::BIGINT % 7 AS n, round(l_extendedprice / l_quantity, 2) AS u0 FROM lineitem),
    p AS (SELECT l_returnflag, l_linestatus, n, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE u0 END AS u,
      CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE round(u0 * n * CASE WHEN l_partkey % 5 = 0 THEN 0.5::DOUBLE WHEN l_partkey % 5 = 1 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 2) END AS t FROM b)"""


def _steps(lo: str, hi: str, source: str = "p") -> str:
    """The invariants one after the other, within lo and hi, and prices read again."""
    return f"""s1 AS (SELECT * REPLACE (CASE WHEN u < {lo} OR u > {hi} THEN NULL ELSE u END AS u) FROM {source}),
    s2 AS (SELECT * REPLACE (CASE WHEN u IS NOT NULL AND t IS NOT NULL AND n > 0 AND greatest(u * n, t) > 0 AND abs(u * n - t) / greatest(u * n, t) > 0.2 THEN NULL ELSE t END AS t) FROM s1),
    s3 AS (SELECT * REPLACE (CASE WHEN u > t THEN NULL ELSE u END AS u, CASE WHEN u > t THEN NULL ELSE t END AS t) FROM s2),
    s4 AS (SELECT * REPLACE (CASE WHEN u IS NULL AND t IS NOT NULL AND n > 0 AND (t / n < {lo} OR t / n > {hi}) THEN NULL ELSE t END AS t) FROM s3),
    s5 AS (SELECT * REPLACE (CASE WHEN u > 0 AND u < 100 THEN u * 1000 ELSE u END AS u, CASE WHEN t > 0 AND t < 100 THEN t * 1000 ELSE t END AS t) FROM s4)"""


_PRICED = f"{_BASE}, {_steps('1000', '1900')}"


@_query(f"WITH {_PRICED} SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, count(u)::BIGINT AS with_unit, count(t)::BIGINT AS with_total, round(sum(u), 0) AS sum_unit, round(sum(t), 0) AS sum_total FROM s5 GROUP BY 1, 2")
def sanity_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = lots.repair(_priced(spark, sf_dir).withColumns({"lo": F.lit(1000.0), "hi": F.lit(1900.0)}), "u", "t", "n", "lo", "hi")
    return fixed.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count("u").alias("with_unit"), F.count("t").alias("with_total"), F.round(F.sum("u"), 0).alias("sum_unit"), F.round(F.sum("t"), 0).alias("sum_total"))


@_query(
    """SELECT l_returnflag, count(t)::BIGINT AS with_total, round(sum(t), 0) AS sum_total FROM (
    SELECT l_returnflag, CASE WHEN n <> 0 THEN CASE WHEN round(u * n, 2) > 0 AND round(u * n, 2) < 100 THEN round(u * n, 2) * 1000 ELSE round(u * n, 2) END END AS t
    FROM (SELECT l_returnflag, l_quantity::BIGINT % 7 AS n, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE round(l_extendedprice / l_quantity, 2) END AS u FROM lineitem)) GROUP BY 1"""
)
def fill_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = lots.fill_total(_priced(spark, sf_dir).withColumn("t", F.lit(None).cast("double")), "u", "t", "n")
    return filled.groupBy("l_returnflag").agg(F.count("t").alias("with_total"), F.round(F.sum("t"), 0).alias("sum_total"))


@_query(
    """SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) FILTER (WHERE value >= 20) AS first_value, arg_max(value, event_id) FILTER (WHERE value < 60) AS last_value
    FROM events GROUP BY 1"""
)
def merge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").withColumns({"first_value": F.expr("CASE WHEN value >= 20 THEN value END"), "last_value": F.expr("CASE WHEN value < 60 THEN value END")})
    return lots.merge_records(e, ["user_id"], ["event_id"], ["event_type", "first_value"], ["last_value"])


@_query(
    """WITH c AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey, l_linenumber) > 12 AS crowded, l_quantity > 40 AS supported FROM lineitem),
    k AS (SELECT *, min(CASE WHEN NOT crowded OR supported THEN l_linenumber END) OVER (PARTITION BY l_suppkey, l_partkey) AS fk FROM c)
    SELECT l_suppkey, l_linenumber, count(*)::BIGINT AS n FROM k WHERE l_linenumber >= fk GROUP BY 1, 2"""
)
def burst_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").withColumn("supported", F.col("l_quantity") > 40)
    kept = lots.burst_guard(rows, "l_suppkey", "l_linenumber", "l_partkey", "supported")
    return kept.groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))


@_query(
    """SELECT o_orderpriority, count(*)::BIGINT AS total_lots, sum(o_custkey % 10)::BIGINT AS total_animals, round(coalesce(avg(o_totalprice) FILTER (WHERE o_totalprice > 0), 0), 4) AS avg_price,
    count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS sold, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS not_sold FROM orders GROUP BY 1"""
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").withColumns({"heads": F.col("o_custkey") % 10, "sold": F.expr("CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END")})
    return summaries.group_summary(o, ["o_orderpriority"], "heads", "o_totalprice", "sold").withColumn("avg_price", F.round("avg_price", 4))


@_query(
    """SELECT o_orderpriority AS video_id, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_custkey % 10 END), 0)::BIGINT AS macho, coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN o_custkey % 10 END), 0)::BIGINT AS femea,
    coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_custkey % 10 END), 0)::BIGINT AS misto FROM orders GROUP BY 1"""
)
def sex_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("video_id"),
        F.col("o_orderkey").alias("lot_number"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'macho' WHEN 'O' THEN 'fêmea' ELSE 'misto' END").alias("sex"),
        F.lit("boi").alias("category"),
        (F.col("o_custkey") % 10).alias("num_animals"),
        F.col("o_totalprice").alias("unit_price"),
        F.lit(None).cast("boolean").alias("sold"),
    )
    s = summaries.auction_summary(o)
    count = lambda k: F.coalesce(F.try_element_at("sex_animals", F.lit(k)), F.lit(0)).cast("bigint")
    return s.select("video_id", count("macho").alias("macho"), count("fêmea").alias("femea"), count("misto").alias("misto"))


@_query("SELECT p_brand AS category, sum(p_size)::BIGINT AS animals, round(avg(p_retailprice) FILTER (WHERE p_retailprice > 0), 4) AS price, row_number() OVER (ORDER BY sum(p_size) DESC, min(p_partkey))::INTEGER AS rank FROM part GROUP BY 1")
def category_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").withColumn("all", F.lit(1))
    found = summaries.ranked_categories(summaries.category_summary(p, ["all"], "p_brand", "p_size", "p_retailprice", "p_partkey"), ["all"])
    return found.select("category", "animals", F.round("price", 4).alias("price"), "rank")


@_query("SELECT p_brand AS category, sum(p_size)::BIGINT AS animals FROM part GROUP BY 1 ORDER BY animals DESC, min(p_partkey) LIMIT 3")
def topk_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three, as the report has it."""
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("index"), F.lit(0).alias("rank"), F.col("p_brand").alias("category"), F.col("p_size").cast("bigint").alias("animals"))
    return summaries.top_categories(p)


@_query("SELECT c_nationkey, c_custkey, c_acctbal AS value FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def arg_max_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.first_maximum(_table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", ["c_custkey"], ["c_nationkey"])


@_query("SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS \"F\", round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS \"O\", round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS \"P\" FROM orders GROUP BY 1")
def pivot_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summaries.price_pivot(_table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O", "P"])
    return found.select("o_orderpriority", *(F.round(c, 4).alias(c) for c in ("F", "O", "P")))


@_query(
    """WITH m AS (SELECT CASE WHEN c_custkey % 10 = 1 THEN c_custkey + 100000000 ELSE c_custkey END AS k, upper(c_mktsegment) AS category, CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE c_name END AS sex,
      c_nationkey + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal * 1.1 ELSE c_acctbal END AS p FROM customer WHERE c_custkey % 7 <> 0),
    j AS (SELECT r.c_custkey AS rk, m.k AS mk, r.c_mktsegment AS rc, m.category AS mc, r.c_name AS rs, m.sex AS ms, r.c_nationkey AS rn, m.n AS mn, r.c_acctbal AS rp, m.p AS mp FROM customer r FULL JOIN m ON r.c_custkey = m.k)
    SELECT count(rk)::BIGINT AS ref_n, count(mk)::BIGINT AS model_n, count(*) FILTER (WHERE rk = mk)::BIGINT AS matched, count(*) FILTER (WHERE mk IS NULL)::BIGINT AS missing, count(*) FILTER (WHERE rk IS NULL)::BIGINT AS extra,
    round(count(*) FILTER (WHERE rk = mk) / count(rk), 8) AS coverage, round(count(*) FILTER (WHERE rk = mk AND lower(rc) = lower(mc)) / count(*) FILTER (WHERE rk = mk), 8) AS category_match,
    round(count(*) FILTER (WHERE rk = mk AND lower(rs) = lower(ms)) / count(*) FILTER (WHERE rk = mk), 8) AS sex_match, round(count(*) FILTER (WHERE rk = mk AND rn = mn) / count(*) FILTER (WHERE rk = mk), 8) AS qty_match,
    round(avg(abs(mp - rp) / rp) FILTER (WHERE rk = mk AND rp <> 0 AND mp <> 0), 8) AS mape, count(*) FILTER (WHERE rk = mk AND rp <> 0 AND mp <> 0 AND abs(mp - rp) / rp < 0.05)::BIGINT AS price_within_5pct FROM j"""
)
def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    ref = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("category"), F.col("c_name").alias("sex"), F.col("c_nationkey").alias("num_animals"), F.col("c_acctbal").alias("unit_price"))
    model = c.where("c_custkey % 7 <> 0").select(  # a second extraction that lacks some and differs in some
        F.expr("CASE WHEN c_custkey % 10 = 1 THEN c_custkey + 100000000 ELSE c_custkey END").alias("k"),
        F.upper("c_mktsegment").alias("category"),
        F.expr("CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE c_name END").alias("sex"),
        F.expr("c_nationkey + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END").alias("num_animals"),
        F.expr("CASE WHEN c_custkey % 5 = 0 THEN c_acctbal * 1.1D ELSE c_acctbal END").alias("unit_price"),
    )
    found = evaluation.agreement(ref, model, ["k"])
    return found.withColumns({c: F.round(c, 8) for c in ("coverage", "category_match", "sex_match", "qty_match", "mape")})


_BR = "'R$ ' || replace(replace(replace(printf('%,.2f', o_totalprice), ',', '#'), '.', ','), '#', '.')"


@_query(
    f"""SELECT o_orderkey, round(try_cast(nullif(trim(replace(replace(replace({_BR}, 'R$', ''), '.', ''), ',', '.')), '') AS DOUBLE), 2) AS price,
    round(CASE WHEN o_totalprice / 1000 > 0 AND o_totalprice / 1000 < 100 THEN o_totalprice / 1000 * 1000 ELSE o_totalprice / 1000 END, 6) AS repaired FROM orders"""
)
def price_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    text = F.concat(F.lit("R$ "), F.translate(F.format_number("o_totalprice", 2), ",.", ".,"))
    return o.select("o_orderkey", F.round(S.price_text(text), 2).alias("price"), F.round(S.repair_small(F.col("o_totalprice") / 1000), 6).alias("repaired"))


@_query("SELECT o_orderkey, 'R$ ' || printf('%,.2f', o_totalprice) AS shown FROM orders")
def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", S.money("o_totalprice").alias("shown"))


_PLURALS = ", ".join(f"('{k}', '{v}')" for k, v in S.SINGULAR.items())


@_query(
    f"""WITH m(k, v) AS (VALUES {_PLURALS}), w AS (SELECT list(k ORDER BY k) AS ks FROM m),
    p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '  ' || upper(ks[p_partkey % 11 + 1]) WHEN p_partkey % 3 = 1 THEN ks[p_partkey % 11 + 1] || ' ' ELSE p_type END AS c FROM part, w)
    SELECT p_partkey, coalesce(v, lower(trim(c))) AS category FROM p LEFT JOIN m ON k = lower(trim(c))"""
)
def normalize_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    names = F.array(*(F.lit(k) for k in sorted(S.SINGULAR)))
    word = F.get(names, (F.col("p_partkey") % 11).cast("int"))
    given = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.upper(word))).when(F.col("p_partkey") % 3 == 1, F.concat(word, F.lit(" "))).otherwise(F.col("p_type"))
    return p.select("p_partkey", S.singular_category(given).alias("category"))


@_query(
    f"""WITH t AS (SELECT event_id, [event_type, printf('%02d:%02d:%02d', x // 3600, x % 3600 // 60, x % 60), 'R$ ' || user_id, CASE WHEN event_id % 2 = 0 THEN '10:00:00' ELSE ' 10:00:00' END] AS l
      FROM (SELECT *, {_AT}::BIGINT AS x FROM events))
    SELECT event_id, list_aggregate(list_filter(l, lambda z: NOT regexp_full_match(z, '[0-9][0-9]:[0-9][0-9]:[0-9][0-9]')), 'string_agg', ' | ') AS line FROM t"""
)
def clock_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").join(_seconds(spark, sf_dir).select("event_id", "s"), "event_id")
    tokens = F.array("event_type", S.hms("s"), F.concat(F.lit("R$ "), "user_id"), F.when(F.col("event_id") % 2 == 0, "10:00:00").otherwise(" 10:00:00"))
    return e.select("event_id", timeline.screen_line(tokens).alias("line"))


@_query(f"SELECT event_id, printf('%02d:%02d:%02d', x // 3600, x % 3600 // 60, x % 60) AS ts FROM (SELECT event_id, {_AT}::BIGINT AS x FROM events)")
def hms_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seconds(spark, sf_dir).select("event_id", S.hms("s").alias("ts"))


@_query(f"SELECT event_id, {_AT}::BIGINT AS strict, CASE WHEN event_id % 2 = 0 THEN {_AT} END AS checked, {_AT} + 0.5 AS comma, {_AT} + 0.25 AS progress FROM events")
def hms_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _seconds(spark, sf_dir).withColumn("ts", S.hms("s"))
    odd = F.when(F.col("event_id") % 2 == 0, F.col("ts")).otherwise(F.concat("ts", F.lit(":00")))
    return e.select("event_id", S.hms_seconds("ts").alias("strict"), S.hms_seconds_strict(odd).cast("double").alias("checked"), S.comma_seconds(F.concat("ts", F.lit(",500"))).alias("comma"), S.progress_seconds(F.concat("ts", F.lit(".25"))).alias("progress"))


@_query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", J.lax_int(J.field(J.object_of(F.concat(F.lit("answer: "), "props", F.lit(" done"))), "k")).alias("k"))


@_query(
    """SELECT l_orderkey AS window, count(*)::BIGINT AS lots, sum(CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END)::BIGINT AS bad, sum(CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE l_quantity::BIGINT END)::BIGINT AS heads,
    round(sum(CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE l_extendedprice END), 2) AS prices FROM lineitem GROUP BY 1"""
)
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as model answers: every line item a lot, some with an unreadable price."""
    li = _table(spark, sf_dir, "lineitem")
    lot = F.struct(
        F.col("l_partkey").alias("lot_number"),
        F.lit("macho").alias("sex"),
        F.lit("Bois").alias("category"),
        F.col("l_quantity").cast("bigint").cast("string").alias("num_animals"),
        F.lit("Nelore").alias("breed"),
        F.when(F.col("l_partkey") % 9 == 0, "caro").otherwise(F.concat(F.lit("R$ "), F.translate(F.format_number("l_extendedprice", 2), ",.", ".,"))).alias("unit_price"),
    )
    answers = li.groupBy("l_orderkey").agg(F.concat(F.lit("Here: "), F.to_json(F.collect_list(lot)), F.lit(" .")).alias("response"))
    read = parsing.read_lots(answers)
    ok = F.size("errors") == 0
    return read.groupBy(F.col("l_orderkey").alias("window")).agg(F.count("*").alias("lots"), F.count_if(~ok).alias("bad"), F.sum(F.when(ok, F.col("num_animals")).otherwise(0)).alias("heads"), F.round(F.sum(F.when(ok, F.col("unit_price")).otherwise(0.0)), 2).alias("prices"))


@_query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'confirm' WHEN 1 THEN 'price' WHEN 2 THEN 'discard' WHEN 3 THEN NULL ELSE 'confirm' END AS verdict, CASE WHEN o_orderkey % 5 = 1 THEN 4321.5 END::DOUBLE AS price FROM orders"""
)
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    said = F.when(k == 0, '{"confirmed": true}').when(k == 1, 'no {"confirmed": false, "correct_unit_price": "R$ 4.321,50"}').when(k == 2, '{"confirmed": 0}').when(k == 3, "{").otherwise(F.concat(F.lit('{"confirmed": false, "correct_unit_price": '), F.col("o_totalprice") + 1000, F.lit("}")))
    asked = o.select("o_orderkey", said.alias("response"), (F.col("o_totalprice") + 1000).alias("unit"))
    return lots.with_verdicts(asked, "response", "unit").select("o_orderkey", "verdict", F.col("verdict_price").alias("price"))


@_query(
    r"""WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://www.youtube.com/watch?t=1&v=id' || page_id || '&x=2' WHEN page_id % 3 = 1 THEN 'https://youtu.be/s' || page_id || '?t=5' ELSE url END AS url FROM pages)
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'id' || page_id WHEN page_id % 3 = 1 THEN 's' || page_id END AS video_id, split_part(list_last(string_split(url, 'v=')), '&', 1) AS last_v FROM u"""
)
def url_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    k = F.col("page_id") % 3
    url = F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?t=1&v=id"), "page_id", F.lit("&x=2"))).when(k == 1, F.concat(F.lit("https://youtu.be/s"), "page_id", F.lit("?t=5"))).otherwise(F.col("url"))
    return p.select("page_id", S.video_id(url).alias("video_id"), S.last_v_id(url).alias("last_v"))


@_query(r"SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^\p{L}\p{N}._-]', '-', 'g'), '.-'), ''), 'batch') AS folder, replace(replace(url, '/', '_'), ':', '_') AS model_dir FROM pages")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", S.safe_folder("url").alias("folder"), S.model_folder("url").alias("model_dir"))


@_query(
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Fazenda' WHEN 1 THEN 'RS Leilões' WHEN 2 THEN c_name WHEN 3 THEN 'CAL LEILÕES' ELSE 'Ana' END AS auction, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 5 = 1 THEN 'RS Leilões' ELSE 'Ana' END AS auctioneer FROM customer"""
)
def notes_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 5
    notes = F.concat(
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("O leiloeiro mencionado é "), "c_name", F.lit(". "))).otherwise(""),
        F.when(k == 2, F.concat(F.lit("anunciado como '"), "c_name", F.lit("'"))).when(k == 3, F.lit("pela cal leilões")).otherwise(F.lit("sem nome")),
    )
    farm = F.when(k == 0, "Fazenda").otherwise("")
    who = F.when(k == 1, "RS Leilões").otherwise("Ana")
    return c.select("c_custkey", S.auction_name(who, farm, notes).alias("auction"), S.auctioneer_name(who, notes).alias("auctioneer"))


@_query(
    r"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 4 WHEN 0 THEN 'LOTE 0' || l_partkey || ' ok' WHEN 1 THEN 'x | 00' || l_partkey || ' | y' WHEN 2 THEN 'lote ' || l_partkey || '9' ELSE 'valote ' || l_partkey END AS t FROM lineitem)
    SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE regexp_matches(t, '(?i)\bLOTE\s*[:#-]?\s*0*' || l_partkey || '\b') OR regexp_matches(t, '\|\s*0*' || l_partkey || '\s*\|'))::BIGINT AS supported, l_partkey % 4 AS kind FROM t GROUP BY 3"""
)
def evidence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    k, p = F.col("l_partkey") % 4, F.col("l_partkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("LOTE 0"), p, F.lit(" ok"))).when(k == 1, F.concat(F.lit("x | 00"), p, F.lit(" | y"))).when(k == 2, F.concat(F.lit("lote "), p, F.lit("9"))).otherwise(F.concat(F.lit("valote "), p))
    return li.groupBy(k.alias("kind")).agg(F.count("*").alias("n"), F.count_if(S.has_evidence("l_partkey", S.evidenced_lots(text))).alias("supported"))


@_query(
    """WITH u AS (SELECT conv_id % 5 AS v, role AS model, sum(length(text)) FILTER (WHERE turn % 2 = 0) AS i, sum(length(text)) FILTER (WHERE turn % 2 = 1) AS o, count(*) AS n FROM conversations GROUP BY 1, 2),
    p(model, a, b) AS (VALUES ('user', 0.1::DOUBLE, 0.4::DOUBLE), ('assistant', 0.4::DOUBLE, 1.6::DOUBLE))
    SELECT model, sum(n)::BIGINT AS lots, sum(coalesce(i, 0))::BIGINT AS input_tokens, sum(coalesce(o, 0))::BIGINT AS output_tokens, round(sum(coalesce(i, 0) / 1e6 * a + coalesce(o, 0) / 1e6 * b), 8) AS cost FROM u JOIN p USING (model) GROUP BY 1"""
)
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    part = lambda k: F.coalesce(F.sum(F.when(F.col("turn") % 2 == k, F.length("text"))), F.lit(0))
    runs = c.groupBy((F.col("conv_id") % 5).alias("video_id"), F.col("role").alias("model")).agg(part(0).alias("input_tokens"), part(1).alias("output_tokens"), F.count("*").alias("lot_count"))
    runs = runs.withColumns({"status": F.lit("ok"), "elapsed_seconds": F.lit(1.0)})
    prices = spark.createDataFrame([("user", 0.1, 0.4), ("assistant", 0.4, 1.6)], "model string, input_price double, output_price double")
    return evaluation.totals(runs, prices, 5).select("model", "lots", "input_tokens", "output_tokens", F.round("cost", 8).alias("cost"))


@_query("SELECT c_custkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("c").alias("side"))
    return c.unionByName(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("s").alias("side")))


@_query("SELECT count(*) FILTER (WHERE a AND b)::BIGINT AS matched, count(*) FILTER (WHERE b IS NULL)::BIGINT AS missing, count(*) FILTER (WHERE a IS NULL)::BIGINT AS extra FROM (SELECT DISTINCT c_custkey AS k, true AS a FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS k, true AS b FROM orders) USING (k)")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.set_counts(_table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), _table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k"), "k")


@_query(
    """SELECT o_orderstatus, count(*)::BIGINT AS n, count(*) FILTER (WHERE o_custkey % 2 = 0)::BIGINT AS sold, round(avg(o_totalprice), 4) AS mean, median(o_totalprice) AS median, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders WHERE true GROUP BY 1"""
)
def price_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").withColumn("sold", F.col("o_custkey") % 2 == 0)
    return summaries.price_statistics(o, ["o_orderstatus"], "o_totalprice", "sold").withColumn("mean", F.round("mean", 4))


@_query(
    """SELECT o_orderpriority AS model, count(*)::BIGINT AS total_lots, sum(o_custkey % 10)::BIGINT AS total_animals, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS sold, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS unsold,
    count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS unknown_sold, count(*) FILTER (WHERE o_custkey % 3 <> 0)::BIGINT AS lots_with_price, count(*) FILTER (WHERE o_custkey % 3 = 0)::BIGINT AS lots_without_price,
    round(avg(o_totalprice) FILTER (WHERE o_custkey % 3 <> 0), 2) AS avg_unit_price, count(*) FILTER (WHERE o_custkey % 4 > 1)::BIGINT AS lots_with_breed, count(*) FILTER (WHERE o_custkey % 5 > 0)::BIGINT AS lots_with_age, 0::BIGINT AS lots_with_timestamp FROM orders GROUP BY 1"""
)
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("model"),
        F.col("o_orderkey").alias("lot_number"),
        (F.col("o_custkey") % 10).alias("num_animals"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END").alias("sold"),
        F.expr("CASE WHEN o_custkey % 6 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 0 ELSE o_totalprice END").alias("unit_price"),
        F.expr("CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Sem Raça Definida' ELSE 'Nelore' END").alias("breed"),
        F.expr("CASE WHEN o_custkey % 5 > 0 THEN 1 END").alias("age_months"),
        F.lit(None).cast("string").alias("timestamp_start"),
    )
    return summaries.run_statistics(o, ["model"]).drop("lot_numbers")


@_query(
    """WITH s AS (SELECT c_nationkey AS i, count(*) AS l, sum(c_custkey % 10) AS a, count(*) FILTER (WHERE c_custkey % 2 = 0) AS y FROM customer GROUP BY 1), o AS (SELECT * FROM s WHERE i % 6 <> 5)
    SELECT (SELECT count(*) FROM s)::BIGINT AS videos, count(*)::BIGINT AS successful, ((SELECT count(*) FROM s) - count(*))::BIGINT AS failed, sum(l)::BIGINT AS lots, sum(a)::BIGINT AS animals, sum(y)::BIGINT AS sold, sum(l - y)::BIGINT AS not_sold FROM o"""
)
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").withColumns({"heads": F.col("c_custkey") % 10, "sold": F.col("c_custkey") % 2 == 0})
    items = summaries.group_summary(c, ["c_nationkey"], "heads", "c_acctbal", "sold").withColumn("status", F.when(F.col("c_nationkey") % 6 == 5, "failed").otherwise("success"))
    return reports.batch_totals(items)


@_query(
    """WITH m AS (SELECT o_orderstatus AS model, count(*)::DOUBLE AS lots, round(sum(o_totalprice), 2) AS total, max(o_custkey)::DOUBLE AS top FROM orders GROUP BY 1), l AS (UNPIVOT m ON lots, total, top INTO NAME metric VALUE v)
    SELECT metric, max(v) FILTER (WHERE model = 'F') AS "F", max(v) FILTER (WHERE model = 'O') AS "O", max(v) FILTER (WHERE model = 'P') AS "P" FROM l GROUP BY 1"""
)
def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("model")).agg(F.count("*").alias("lots"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_custkey").alias("top"))
    return evaluation.by_metric(o, "model", ["lots", "total", "top"], ["F", "O", "P"])


@_query("SELECT n_name AS model, r_name AS video, count(c_custkey)::BIGINT AS customers FROM nation CROSS JOIN region LEFT JOIN customer ON c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY 1, 2")
def run_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    done = _table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers")).join(n, "n_nationkey").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"), "customers")
    found = evaluation.grid(n.select("n_nationkey", "n_name"), r, done, ["n_nationkey", "r_regionkey"])
    return found.select(F.col("n_name").alias("model"), F.col("r_name").alias("video"), F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers"))


@_query("SELECT CASE WHEN c IN ('boi', 'garrote') THEN 'male' WHEN c = 'vaca' THEN 'female' ELSE 'other' END AS bucket, count(*)::BIGINT AS n FROM (SELECT ['boi', 'vaca', 'potro', 'garrote'][p_partkey % 4 + 1] AS c FROM part) GROUP BY 1")
def category_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("boi", "vaca", "potro", "garrote")))
    return _table(spark, sf_dir, "part").groupBy(summaries.bucketed(F.get(names, (F.col("p_partkey") % 4).cast("int"))).alias("bucket")).agg(F.count("*").alias("n"))


@_query("SELECT doc_id, left(text, 400) AS error, length(left(text, 2000))::INTEGER AS kept, coalesce(nullif(left(text, 0), ''), '-') AS shown FROM documents")
def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", S.clip("text", 400).alias("error"), F.length(S.clip("text", 2000)).alias("kept"), S.dash(S.clip("text", 0)).alias("shown"))


@_query("SELECT e.event_id, list_filter([event_type, 'u' || user_id], lambda t, i: ([value / 100, 1 - value / 100])[i] >= 0.4) AS tokens FROM events e")
def confident_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array(F.struct(F.col("event_type").alias("text"), (F.col("value") / 100).alias("confidence")), F.struct(F.concat(F.lit("u"), "user_id").alias("text"), (1 - F.col("value") / 100).alias("confidence")))
    return _table(spark, sf_dir, "events").select("event_id", timeline.confident_text(found).alias("tokens"))


@_query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1")
def last_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.struct("l_extendedprice", "l_quantity").alias("order"))
    return evaluation.last_by_key(li, ["l_orderkey", "l_linenumber"], "order").drop("order")


@_query(
    f"""WITH {_BASE}, d AS (SELECT l_returnflag AS g, list_sort(list(u)) AS d, count(*) AS k FROM p WHERE u > 0 GROUP BY 1),
    q AS (SELECT g, (d[(k+1)//4]*(4-(k+1)%4) + d[(k+1)//4+1]*((k+1)%4))/4 AS q1, (d[3*(k+1)//4]*(4-3*(k+1)%4) + d[3*(k+1)//4+1]*(3*(k+1)%4))/4 AS q3 FROM d),
    f AS (SELECT p.*, greatest(0, q1 - 1.5*(q3-q1)) AS lo, q3 + 1.5*(q3-q1) AS hi, u < greatest(0, q1 - 1.5*(q3-q1)) OR u > q3 + 1.5*(q3-q1) AS outlier FROM p JOIN q ON g = l_returnflag),
    {_steps("lo", "hi", "f")}
    SELECT l_returnflag, count(*)::BIGINT AS total_lots, sum(n)::BIGINT AS total_animals, round(coalesce(avg(u) FILTER (WHERE u > 0), 0), 2) AS avg_price, count(*) FILTER (WHERE l_linestatus = 'F')::BIGINT AS sold,
    count(*) FILTER (WHERE l_linestatus <> 'F')::BIGINT AS not_sold, count(*) FILTER (WHERE outlier)::BIGINT AS outliers FROM s5 GROUP BY 1"""
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fence, outliers, repair and totals of priced rows, summed up by group."""
    priced = _priced(spark, sf_dir)
    flagged = lots.flag_outliers(priced, lots.fences_of_large_groups(priced, ["l_returnflag"], "u"), ["l_returnflag"], "u")
    settled = lots.fill_total(lots.repair(flagged, "u", "t", "n", "lo", "hi"), "u", "t", "n")
    done = summaries.group_summary(settled.withColumn("sold", F.col("l_linestatus") == "F"), ["l_returnflag"], "n", "u", "sold", [F.count_if("outlier").alias("outliers")])
    return done.withColumn("avg_price", F.round("avg_price", 2))
