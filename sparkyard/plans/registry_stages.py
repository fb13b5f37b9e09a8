"""Further queries of the registry: stage documents, evidence, verdicts, drivers, reports and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkyard.functions import jsons as J
from sparkyard.functions import scalars as S
from sparkyard.operators import lots, parsing, reports, summaries, timeline
from sparkyard.sources import readers, writers

from . import auctions, providers
from .registry import _AT, _conversation_windows, _query, _seconds, _table


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _sql_hms(x: str) -> str:
    return f"printf('%02d:%02d:%02d', ({x}) // 3600, ({x}) % 3600 // 60, ({x}) % 60)"


# Sources

@_query("""SELECT conv_id::VARCHAR AS video_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INTEGER AS seg_idx, (turn * 10)::DOUBLE AS start, (turn * 10 + 5.5)::DOUBLE AS "end", text FROM conversations""")
def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript documents, read again."""
    c = _table(spark, sf_dir, "conversations")
    e = F.struct((F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + 5.5).alias("end"), "text")
    docs = c.groupBy("conv_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text", e.alias("e")))), lambda x: x["e"])).alias("value"))
    return readers.segments_of(docs.select(_text("conv_id").alias("video_id"), "value"))


@_query(
    f"""WITH n AS (SELECT conv_id, turn, role, text, turn % 3 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r FROM conversations)
    SELECT conv_id::VARCHAR AS video_id, (min(r) - 1)::INTEGER AS ocr_idx, {_sql_hms("k * 30")} AS ts, arg_max(role, r) AS token, 2::INTEGER AS n FROM n GROUP BY conv_id, k"""
)
def ocr_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lists by time with repeated times, written as documents and read again."""
    c = _table(spark, sf_dir, "conversations").withColumn("ts", S.hms((F.col("turn") % 3) * 30))
    entry = F.concat(F.lit('"'), "ts", F.lit('":["'), "role", F.lit('","x"]'))
    docs = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text", entry.alias("e")))), lambda x: x["e"]).alias("l"))
    read = readers.ocr_of(docs.select(_text("conv_id").alias("video_id"), F.concat(F.lit("{"), F.array_join("l", ","), F.lit("}")).alias("value")))
    return read.select("video_id", "ocr_idx", "ts", F.get("tokens", F.lit(0)).alias("token"), F.size("tokens").alias("n"))


@_query(f"""SELECT user_id::VARCHAR AS video_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS frame_idx, ({_AT})::INTEGER AS seconds, {_sql_hms(f"({_AT})::BIGINT")} AS ts, 'f/' || event_id || '.jpg' AS path FROM events""")
def frame_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _seconds(spark, sf_dir)
    item = F.struct(F.col("s").cast("int").alias("seconds"), S.hms("s").alias("timestamp_str"), F.concat(F.lit("f/"), "event_id", F.lit(".jpg")).alias("path"))
    docs = e.groupBy("user_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("event_id", item.alias("e")))), lambda x: x["e"])).alias("value"))
    return readers.frames_of(docs.select(_text("user_id").alias("video_id"), "value"))


@_query(
    """SELECT p_brand AS video_id, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INTEGER AS pos, p_partkey AS lot_number, p_size::BIGINT AS num_animals, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice END AS unit_price,
    CASE WHEN p_size < 100 THEN p_size * 1000 ELSE p_size END::DOUBLE AS total_price FROM part WHERE p_size > 0"""
)
def stored_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stored lots, validated again, small prices read again."""
    p = _table(spark, sf_dir, "part").where("p_size > 0")
    item = F.struct(F.col("p_partkey").alias("lot_number"), F.lit("macho").alias("sex"), F.lit("boi").alias("category"), F.col("p_size").alias("num_animals"), F.lit("Nelore").alias("breed"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("unit_price"), F.col("p_size").alias("total_price"))
    docs = p.groupBy(F.col("p_brand").alias("video_id")).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", item.alias("e")))), lambda x: x["e"])).alias("value"))
    return parsing.lots_of_text(docs).select("video_id", "pos", "lot_number", "num_animals", "unit_price", "total_price")


@_query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_nationkey::VARCHAR END AS city, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment END AS farm, CASE WHEN c_custkey % 3 = 1 THEN 1 ELSE 0 END::INTEGER AS odd FROM customer""")
def metadata_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a response: as text, of another type, and none at all."""
    c, k = _table(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    said = F.when(k == 0, F.concat(F.lit("sure: "), F.to_json(F.struct(F.col("c_name").alias("city"), F.col("c_mktsegment").alias("farm"))))).when(k == 1, F.concat(F.lit('{"city": '), "c_nationkey", F.lit(', "farm": null}'))).otherwise(F.lit('{"city": "x"'))
    found = readers.metadata(c.select("c_custkey", said.alias("response")), "response")
    return found.select("c_custkey", "city", "farm", F.size("odd_fields").alias("odd"))


@_query("SELECT doc_id::VARCHAR AS video_id, coalesce(CASE WHEN doc_id % 5 > 0 THEN source END, '') AS title, left(coalesce(text, ''), 2000) AS description FROM documents")
def video_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions end at 2000 characters, as the operator has it."""
    d = _table(spark, sf_dir, "documents")
    return readers.video_info(d.select(_text("doc_id").alias("video_id"), F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("title"), F.col("text").alias("description")))


@_query("SELECT page_id, 2::INTEGER AS line, trim(url) AS url FROM pages UNION ALL SELECT page_id, 5, 'id' || page_id FROM pages")
def url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of URLs with comments and blank lines."""
    p = _table(spark, sf_dir, "pages")
    return readers.listed_urls(p.select("page_id", F.concat(F.lit("# list\r\n\t\n  "), "url", F.lit(" \n#"), "url", F.lit("\r\n\nid"), "page_id", F.lit("\n")).alias("value"))).select("page_id", "line", "url")


@_query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (props->>'$.k')::BIGINT END AS k FROM events UNION ALL SELECT event_id + 100000000, NULL FROM events")
def tolerant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents are cut short, and as many are missing."""
    e = _table(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.lit('{"k": 1')).alias("value"))
    expected = e.select("event_id").unionByName(e.select((F.col("event_id") + 100000000).alias("event_id")))
    return readers.tolerant(rows, expected, ["event_id"]).select("event_id", J.lax_int(J.field(F.col("document"), "k")).alias("k"))


@_query("SELECT o_custkey::VARCHAR AS video_id, min('d/audio_source_' || o_custkey || '.' || o_orderkey || '.m4a') AS path FROM orders WHERE o_orderkey % 3 > 0 GROUP BY o_custkey")
def audio_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    end = F.when(F.col("o_orderkey") % 3 > 0, ".m4a").otherwise(".part")
    return readers.audio_sources(o.select(F.concat(F.lit("d/audio_source_"), "o_custkey", F.lit("."), "o_orderkey", end).alias("path")))


@_query(
    f"""WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
    SELECT o_custkey::VARCHAR AS video_id, i::INTEGER AS frame_idx, (i * 20)::INTEGER AS seconds, {_sql_hms("i * 20")} AS ts, printf('f%012d', o_orderkey) AS path FROM n"""
)
def frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return readers.frame_index(o.select(_text("o_custkey").alias("video_id"), F.concat(F.lit("f"), F.lpad(_text("o_orderkey"), 12, "0")).alias("path")), 20)


@_query("SELECT o_orderkey, o_custkey + 0.5::DOUBLE AS audio, o_custkey + 0.25::DOUBLE AS video FROM orders")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    one = lambda kind, tail: F.concat(F.lit(f'{{"codec_type":"{kind}","duration":"'), "o_custkey", F.lit(f'{tail}"}}'))
    probe = F.concat(F.lit('{"streams":['), one("video", ".25"), F.lit(","), one("audio", ".5"), F.lit(","), one("audio", ".75"), F.lit("]}"))
    return o.select("o_orderkey", probe.alias("p")).select("o_orderkey", readers.duration(F.col("p"), "audio").alias("audio"), readers.duration(F.col("p"), "video").alias("video"))


@_query(
    """SELECT l_orderkey::VARCHAR AS video_id, CASE WHEN l_orderkey % 3 > 0 THEN count(*) END::BIGINT AS items, CASE WHEN l_orderkey % 3 > 0 THEN sum(l_quantity) END::DOUBLE AS seconds,
    CASE WHEN l_orderkey % 3 = 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'transcript: no such JSON' ELSE 'transcript: an item without its fields' END END AS error FROM lineitem GROUP BY l_orderkey"""
)
def unreadable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transcripts, a third of them cut short or without texts: those are failures, the others keep all rows."""
    li, broken = _table(spark, sf_dir, "lineitem"), F.col("l_orderkey") % 3 == 0
    item = F.struct(F.col("l_partkey").cast("double").alias("start"), (F.col("l_partkey") + F.col("l_quantity")).cast("double").alias("end"), F.when(~broken | (F.col("l_orderkey") % 2 == 0), F.col("l_returnflag")).alias("text"))
    docs = li.groupBy("l_orderkey").agg(F.to_json(F.collect_list(item)).alias("value"))
    cut = F.when(broken & (F.col("l_orderkey") % 2 == 0), F.expr("left(value, length(value) - 3)")).otherwise(F.col("value"))
    read = readers.checked_segments(docs.select(_text("l_orderkey").alias("video_id"), cut.alias("value")))
    good = read.rows.groupBy("video_id").agg(F.count("*").alias("items"), F.sum(F.col("end") - F.col("start")).alias("seconds"))
    return good.unionByName(read.failures, allowMissingColumns=True)


@_query(
    """WITH w AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
    f AS (SELECT o_custkey, l_partkey % 50 AS lot, min(i) AS first FROM w JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT w.o_custkey::VARCHAR AS video_id, w.i::INTEGER AS window_idx, 'Lotes já encontrados (não repetir): ' || coalesce('[' || string_agg(lot::VARCHAR, ', ' ORDER BY lot) || ']', 'nenhum ainda') AS question
    FROM w LEFT JOIN f ON f.o_custkey = w.o_custkey AND first < w.i GROUP BY w.o_custkey, w.i"""
)
def prior_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as windows, their parts as lots: what each window is told of those before it."""
    o, li = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    at = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("window_idx")
    windows = o.select(_text("o_custkey").alias("video_id"), at, "o_orderkey")
    kept = windows.join(li.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 50).alias("lot_number")), "o_orderkey").drop("o_orderkey")
    told = lots.prior_lots(kept, windows.drop("o_orderkey"))
    return told.select("video_id", "window_idx", providers.prior_question(F.col("prior")).alias("question"))


# Sinks

@_query(
    """WITH r AS (SELECT DISTINCT l_orderkey, l_partkey, CASE WHEN l_partkey % 5 > 0 THEN l_returnflag END AS f FROM lineitem)
    SELECT l_orderkey, '[' || string_agg('{"l_partkey":' || l_partkey || ',"f":' || coalesce('"' || f || '"', 'null') || ',"t":"ção"}', ',' ORDER BY l_partkey, f) || ']' AS value FROM r GROUP BY 1"""
)
def document_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays with nulls and letters beyond ASCII."""
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_partkey") % 5 > 0, F.col("l_returnflag")).alias("f"), F.lit("ção").alias("t"))
    return writers.document(li.distinct().withColumn("at", F.struct("l_partkey", "f")), ["l_orderkey"], "at", ["l_partkey", "f", "t"])


@_query(
    f"""WITH n AS (SELECT user_id, event_id, event_type, event_id % 4 AS k FROM events), g AS (SELECT user_id, k, min(event_id) AS i, arg_max(event_type, event_id) AS t FROM n GROUP BY 1, 2)
    SELECT user_id::VARCHAR AS video_id, '{{' || string_agg('"' || {_sql_hms("k * 30")} || '":["' || t || '"]', ',' ORDER BY i) || '}}' AS value FROM g GROUP BY 1"""
)
def ocr_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return writers.ocr_document(e.select(_text("user_id").alias("video_id"), F.col("event_id").alias("ocr_idx"), S.hms((F.col("event_id") % 4) * 30).alias("ts"), F.array("event_type").alias("tokens")))


@_query("""SELECT c_custkey::VARCHAR AS video_id, CASE WHEN c_custkey % 3 = 0 THEN '{}' WHEN c_custkey % 3 = 1 THEN '{"city":"' || c_name || '","farm":null}' ELSE '{"city":"' || c_name || '","farm":"' || c_mktsegment || '"}' END AS value FROM customer""")
def metadata_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their nulls, and an empty object where there are none."""
    c, k = _table(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    return writers.metadata_document(c.select(_text("c_custkey").alias("video_id"), F.when(k > 0, F.col("c_name")).alias("city"), F.when(k > 1, F.col("c_mktsegment")).alias("farm")), ["city", "farm"])


@_query(
    """WITH l AS (SELECT c_nationkey, count(*) AS n, string_agg('{"lot_number":' || c_custkey || ',"category":"' || c_mktsegment || '","sold":' || CASE c_custkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'true' ELSE 'false' END || '}', ',' ORDER BY c_custkey) AS t FROM customer WHERE c_nationkey % 5 > 0 GROUP BY 1)
    SELECT n_nationkey::VARCHAR AS video_id, '{"video_id":"' || n_nationkey || '","city":"' || n_name || '","farm":null,"total_lots":' || coalesce(n, 0) || ',"lots":[' || coalesce(t, '') || ']}' AS value FROM nation LEFT JOIN l ON c_nationkey = n_nationkey"""
)
def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _table(spark, sf_dir, "customer").where("c_nationkey % 5 > 0"), _table(spark, sf_dir, "nation")
    sold = F.when(F.col("c_custkey") % 3 == 1, True).when(F.col("c_custkey") % 3 == 2, False)
    found = c.select(_text("c_nationkey").alias("video_id"), F.col("c_custkey").alias("lot_number"), F.col("c_mktsegment").alias("category"), sold.alias("sold"))
    return writers.result_document(n.select(_text("n_nationkey").alias("video_id"), F.col("n_name").alias("city"), F.lit(None).cast("string").alias("farm")), found)


# Scalars

@_query("SELECT event_id, event_type || ' ' || user_id AS shown FROM events")
def trimmed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", S.strip(F.concat(F.lit(" \t "), "event_type", F.lit(" "), "user_id", F.lit("  \r\n"))).alias("shown"))


@_query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS shown FROM customer")
def display_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = _table(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    return c.select("c_custkey", S.first_text(F.when(k == 0, F.col("c_name")).when(k == 1, F.lit("")), F.when(k == 1, F.col("c_mktsegment")), F.lit(None).cast("string")).alias("shown"))


@_query("SELECT event_id, (value::BIGINT // 60)::BIGINT AS minutes, (floor(value)::BIGINT % 60)::BIGINT AS seconds FROM (SELECT event_id, floor(value * 10) AS value FROM events WHERE value >= 0)")
def elapsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").where("value >= 0")
    return e.select("event_id", S.elapsed(F.col("value") * 10).alias("e")).select("event_id", F.col("e.minutes").cast("bigint").alias("minutes"), F.col("e.seconds").cast("bigint").alias("seconds"))


# Transcripts and windows

@_query(
    """WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations)
    SELECT 'cpp' AS backend, conv_id::VARCHAR AS video_id, i::INTEGER AS seg_idx, (turn * 10 + 0.5)::DOUBLE AS start, (turn * 10 + 9.25)::DOUBLE AS "end", role AS text FROM c
    UNION ALL SELECT 'mlx', conv_id::VARCHAR, i::INTEGER, (turn * 10)::DOUBLE, (turn * 10 + 9)::DOUBLE, role FROM c
    UNION ALL SELECT 'groq', conv_id::VARCHAR, i::INTEGER, (turn * 900 + 0.5)::DOUBLE, (turn * 900 + 9.25)::DOUBLE, role FROM c"""
)
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording by three backends' own rows."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = _table(spark, sf_dir, "conversations").withColumn("idx", F.row_number().over(order) - 1).select(_text("conv_id").alias("video_id"), "turn", "idx", F.concat(F.lit(" "), "role", F.lit("\n")).alias("text"))
    at = F.col("turn") * 10
    cpp = c.select("video_id", "idx", F.concat(S.hms(at), F.lit(",500")).alias("from"), F.concat(S.hms(at + 9), F.lit(",250")).alias("to"), "text")
    mlx = c.select("video_id", "idx", at.alias("start"), (at + 9).alias("end"), "text")
    groq = c.select("video_id", F.col("turn").alias("chunk_idx"), "idx", F.lit(0.5).alias("start"), F.lit(9.25).alias("end"), "text")
    parts = [providers.transcript(rows, name).withColumn("backend", F.lit(name)) for rows, name in ((cpp, "cpp"), (mlx, "mlx"), (groq, "groq"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query(
    """WITH w AS (SELECT range AS k FROM range(0, 400)) SELECT conv_id::VARCHAR AS video_id, k::INTEGER AS window_idx, count(*)::BIGINT AS lines
    FROM conversations, w WHERE turn * 270 + 30 >= 540 * k AND turn * 270 <= 540 * k + 600 AND 540 * k < (SELECT max(turn * 270 + 30) + 1 FROM conversations c WHERE c.conv_id = conversations.conv_id) GROUP BY 1, 2"""
)
def unsorted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose numbers run against their times: none is lost."""
    c = _table(spark, sf_dir, "conversations")
    speech = c.select(_text("conv_id").alias("video_id"), (1000 - F.col("turn")).cast("int").alias("seg_idx"), (F.col("turn") * 270.0).alias("start"), (F.col("turn") * 270.0 + 30).alias("end"), F.lit("x").alias("text"))
    none = c.where("false").select(_text("conv_id").alias("video_id"), F.lit(0).alias("ocr_idx"), F.lit("").alias("ts"), F.array(F.lit("")).alias("tokens"))
    shown = timeline.text_windows(speech, none).where(F.col("combined_text") != timeline.NOTHING)
    return shown.select("video_id", "window_idx", F.size(F.split("combined_text", "\n")).cast("bigint").alias("lines"))


@_query("SELECT conv_id::VARCHAR AS video_id, 0::INTEGER AS window_idx, 'x' AS combined_text FROM conversations WHERE false")
def no_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without evidence there are no windows."""
    c = _table(spark, sf_dir, "conversations").where("turn < 0")
    speech = c.select(_text("conv_id").alias("video_id"), F.lit(0).alias("seg_idx"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), "text")
    screen = c.select(_text("conv_id").alias("video_id"), F.lit(0).alias("ocr_idx"), F.lit("00:00:00").alias("ts"), F.array("text").alias("tokens"))
    return timeline.text_windows(speech, screen).select("video_id", "window_idx", "combined_text")


@_query("SELECT conv_id::VARCHAR AS video_id, (max(turn * 270) // 540 + 1)::BIGINT AS windows, (max(turn * 270) // 540 * 540)::INTEGER AS last_start FROM conversations GROUP BY 1")
def recording_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later of the last segment's end and the last screen time bounds a recording's windows."""
    return _conversation_windows(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("windows"), F.max("window_start").alias("last_start"))


@_query(
    """SELECT o_orderkey, k::INTEGER AS chunk_idx, (k * 900)::INTEGER AS chunk_start, (k * 900 + 0.5)::DOUBLE AS moved FROM (SELECT o_orderkey, ceil((o_custkey % 4 * 900 + 1) / 900.0) AS n FROM orders), range(0, 8) r(k) WHERE k < n"""
)
def chunk_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4 * 900 + 1).alias("duration"))
    chunks = timeline.chunk_starts(o, "duration").withColumns({"start": F.lit(0.5), "end": F.lit(1.0)})
    return timeline.shift_chunks(chunks, "chunk_idx").select("o_orderkey", "chunk_idx", "chunk_start", F.col("start").alias("moved"))


# Lots

@_query("SELECT p_brand AS video_id, p_partkey AS lot_number, p_size::BIGINT AS num_animals, 'bezerra' AS category, 'fêmea' AS sex, 8::BIGINT AS age_months, 'NELORE' AS breed FROM part WHERE p_size > 0")
def overlay_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlay lines read by the offline extractor, an addition of ours."""
    p = _table(spark, sf_dir, "part").where("p_size > 0")
    line = F.concat(F.lit("[00:00:01] TELA: LOTE | Boa Vista | VALORPORANIMAL | 00"), "p_partkey", F.lit(" | R$ | 3.100 | "), "p_size", F.lit("BEZERRAS-08M-NELORE"))
    windows = p.select(F.col("p_brand").alias("video_id"), F.col("p_partkey").cast("int").alias("window_idx"), line.alias("combined_text"))
    read = parsing.valid(parsing.read_lots(providers.Overlay().extract(windows).select("video_id", "window_idx", "response")))
    return read.select("video_id", "lot_number", "num_animals", "category", "sex", "age_months", "breed")


@_query(
    """SELECT c_nationkey::VARCHAR AS video_id, c_custkey AS lot_number, c_custkey % 3 <> 2 AS supported FROM customer"""
)
def window_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a window's text names its lots."""
    c, k = _table(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    rows = c.select(_text("c_nationkey").alias("video_id"), F.col("c_custkey").cast("int").alias("window_idx"), F.col("c_custkey").alias("lot_number"))
    text = F.when(k == 0, F.concat(F.lit("lote: 0"), "c_custkey", F.lit("."))).when(k == 1, F.concat(F.lit("a | "), "c_custkey", F.lit(" | b"))).otherwise(F.concat(F.lit("lotes "), "c_custkey", F.lit("1")))
    windows = c.select(_text("c_nationkey").alias("video_id"), F.col("c_custkey").cast("int").alias("window_idx"), text.alias("combined_text"))
    return lots.with_support(rows, windows).select("video_id", "lot_number", "supported")


def _customer_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lots of their nation."""
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        _text("c_nationkey").alias("video_id"),
        k.alias("lot_number"),
        F.when(k % 2 == 0, "macho").otherwise("fêmea").alias("sex"),
        F.lower("c_mktsegment").alias("category"),
        (k % 10).alias("num_animals"),
        F.lit("Nelore").alias("breed"),
        (k % 30).alias("age_months"),
        F.when(k % 4 > 0, F.abs("c_acctbal") + 100).alias("unit_price"),
        F.lit(None).cast("double").alias("total_price"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("sold"),
        F.when(k % 5 > 0, S.hms(k % 1100)).when(k % 10 == 0, F.lit("")).alias("timestamp_start"),
        F.lit(None).cast("string").alias("notes"),
    )


_LOTS = f"""l AS (SELECT c_nationkey::VARCHAR AS video_id, c_custkey AS lot_number, CASE WHEN c_custkey % 2 = 0 THEN 'macho' ELSE 'fêmea' END AS sex, lower(c_mktsegment) AS category, c_custkey % 10 AS num_animals, c_custkey % 30 AS age_months,
    CASE WHEN c_custkey % 4 > 0 THEN abs(c_acctbal) + 100 END AS unit_price, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS sold, CASE WHEN c_custkey % 5 > 0 THEN {_sql_hms("c_custkey % 1100")} WHEN c_custkey % 10 = 0 THEN '' END AS timestamp_start FROM customer)"""


@_query(
    f"""WITH {_LOTS}, o AS (SELECT *, c_s // 1 AS s FROM (SELECT *, lot_number % 1100 AS c_s FROM l WHERE lot_number % 7 = 0 AND lot_number % 5 > 0 AND unit_price IS NOT NULL)),
    p AS (SELECT *, CASE WHEN s <= 600 THEN 0 ELSE 1 END AS k FROM o)
    SELECT video_id, lot_number, 'Lote a verificar:' || chr(10) || '- Número: ' || lot_number || chr(10) || '- Categoria: ' || category || chr(10) || '- Sexo: ' || sex || chr(10) || '- Quantidade: ' || num_animals || chr(10) || '- Idade: ' || age_months || ' meses' || chr(10) || '- Raça: Nelore' || chr(10)
    || '- Preço por cabeça extraído: R$ ' || printf('%,.2f', unit_price) || chr(10) || '- Timestamp: ' || timestamp_start || chr(10) || chr(10) || 'Evidências da janela [' || {_sql_hms("k * 540")} || ' - ' || {_sql_hms("k * 540 + 600")} || ']:' || chr(10) || chr(10) || 'texto ' || k AS packet FROM p"""
)
def evidence_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a verifier is asked about outliers that have a window."""
    flagged = _customer_lots(spark, sf_dir).withColumn("outlier", (F.col("lot_number") % 7 == 0) & F.col("unit_price").isNotNull())
    nations = _table(spark, sf_dir, "nation").select(_text("n_nationkey").alias("video_id"), F.lit(1100).alias("total"))
    windows = timeline.spine(nations, "video_id", "total").withColumn("combined_text", F.concat(F.lit("texto "), "window_idx"))
    return lots.evidence_packets(flagged, windows, timeline.SIZE, timeline.OVERLAP)


@_query(
    """WITH o AS (SELECT o_orderkey AS lot_number, o_totalprice AS u, o_totalprice * 2 AS t, o_totalprice < 20000 OR o_totalprice > 100000 AS outlier, o_orderkey % 5 AS k, o_orderkey % 7 = 0 AS timeless FROM orders),
    v AS (SELECT *, CASE WHEN NOT outlier THEN 'keep' WHEN timeless OR k = 4 THEN 'none' WHEN k = 0 THEN 'keep' WHEN k = 1 THEN 'inside' WHEN k = 2 THEN 'beyond' ELSE 'none' END AS what FROM o),
    a AS (SELECT lot_number, outlier AND what = 'keep' AS trusted, CASE what WHEN 'keep' THEN u WHEN 'inside' THEN 50000 END AS u, CASE what WHEN 'keep' THEN t END AS t FROM v)
    SELECT lot_number, trusted, round(u, 4)::DOUBLE AS unit_price, round(coalesce(t, round(u * 2, 2)), 4)::DOUBLE AS total_price FROM a"""
)
def verdict_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers confirmed, corrected inside and outside the fence, denied, unread; then the final check."""
    o, k = _table(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    flagged = o.select(
        F.lit("v").alias("video_id"),
        F.col("o_orderkey").alias("lot_number"),
        F.col("o_totalprice").alias("unit_price"),
        (F.col("o_totalprice") * 2).alias("total_price"),
        F.lit(2).cast("bigint").alias("num_animals"),
        F.lit(20000.0).alias("lo"),
        F.lit(100000.0).alias("hi"),
        ((F.col("o_totalprice") < 20000) | (F.col("o_totalprice") > 100000)).alias("outlier"),
        F.when(F.col("o_orderkey") % 7 > 0, "00:00:10").alias("timestamp_start"),
    )
    said = F.when(k == 0, '{"confirmed": true}').when(k == 1, '{"confirmed": false, "correct_unit_price": 50000}').when(k == 2, '{"confirmed": false, "correct_unit_price": 15000}').when(k == 3, '{"confirmed": false}').otherwise("?")
    responses = o.select(F.lit("v").alias("video_id"), F.col("o_orderkey").alias("lot_number"), said.alias("response"))
    done = lots.settle(lots.apply_verdicts(flagged, responses))
    return done.select("lot_number", "trusted", F.round("unit_price", 4).alias("unit_price"), F.round("total_price", 4).alias("total_price"))


_EXTRACTED = """m AS (SELECT c_nationkey, c_custkey, c_custkey % 20 AS k FROM customer UNION ALL SELECT c_nationkey, c_custkey, c_custkey % 20 + 1 FROM customer),
    r AS (SELECT * FROM m WHERE k % 5 > 0), f AS (SELECT c_nationkey, c_custkey, min(k) AS a, max(k) AS b FROM r GROUP BY 1, 2)"""


@_query(
    f"""WITH {_EXTRACTED} SELECT c_nationkey::VARCHAR AS video_id, c_custkey AS lot_number, 'b' || a AS breed, b % 2 = 0 AS sold, (c_nationkey + 1000)::DOUBLE AS unit_price, ((c_nationkey + 1000) * (c_custkey % 9 + 1))::DOUBLE AS total_price, (c_custkey % 9 + 1)::BIGINT AS num_animals FROM f"""
)
def extracted_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from windows and answers to final lots: lots met twice, crowded windows that name their lots, calls that failed."""
    c = _table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.explode(F.array(F.col("c_custkey") % 20, F.col("c_custkey") % 20 + 1)).alias("k"))
    lot = F.struct(
        F.col("c_custkey").alias("lot_number"),
        F.lit("macho").alias("sex"),
        F.lit("bois").alias("category"),
        (F.col("c_custkey") % 9 + 1).alias("num_animals"),
        F.concat(F.lit("b"), "k").alias("breed"),
        F.concat(F.lit("R$ "), F.translate(F.format_number(F.col("c_nationkey") + 1000, 2), ",.", ".,")).alias("unit_price"),
        (F.col("k") % 2 == 0).alias("sold"),
    )
    by = c.groupBy(_text("c_nationkey").alias("video_id"), F.col("k").cast("int").alias("window_idx"))
    made = by.agg(F.to_json(F.collect_list(lot)).alias("said"), F.array_join(F.collect_list(F.concat(F.lit("LOTE "), "c_custkey")), "\n").alias("combined_text"))
    failed = F.col("window_idx") % 5 == 0
    responses = made.select("video_id", "window_idx", F.when(~failed, F.concat(F.lit("Aqui: "), "said")).alias("response"), F.lit(1).cast("bigint").alias("input_tokens"), F.lit(1).cast("bigint").alias("output_tokens"), F.when(failed, "500").alias("error"))
    windows = made.select("video_id", "window_idx", (F.col("window_idx") * 540).alias("window_start"), (F.col("window_idx") * 540 + 600).alias("window_end"), F.lit("w").alias("label"), "combined_text")
    return auctions.extract(windows, providers.Recorded(responses)).select("video_id", "lot_number", "breed", "sold", "unit_price", "total_price", "num_animals")


@_query("""SELECT n_nationkey::VARCHAR AS video_id, 'u' || n_nationkey AS video_url, CASE n_nationkey % 3 WHEN 0 THEN n_name END AS city, '[00:00:00 - 00:10:00]' || chr(10) || 't0' || chr(10) || chr(10) || '[00:09:00 - 00:19:00]' || chr(10) || 't1' AS context FROM nation""")
def metadata_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts, answers that are read, cut short or missing, and facts by video."""
    n, k = _table(spark, sf_dir, "nation"), F.col("n_nationkey") % 3
    facts = n.where(k < 2).select(_text("n_nationkey").alias("video_id"), F.when(k == 0, F.concat(F.lit("ok "), F.to_json(F.struct(F.col("n_name").alias("city"))))).otherwise(F.lit('{"city": "')).alias("response"))
    windows = timeline.spine(n.select(_text("n_nationkey").alias("video_id"), F.lit(1000).alias("total")), "video_id", "total").withColumn("combined_text", F.concat(F.lit("t"), "window_idx"))
    contexts = timeline.head_context(windows)
    provider = providers.Recorded(windows.where("false"), None, facts)
    info = n.select(_text("n_nationkey").alias("video_id"), F.concat(F.lit("u"), "n_nationkey").alias("video_url"))
    return auctions.auctions(info, provider.metadata(contexts)).join(contexts, "video_id").select("video_id", "video_url", "city", "context")


# Summaries and reports

@_query(
    """SELECT c_nationkey::VARCHAR AS video_id, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS numbers FROM customer GROUP BY 1"""
)
def found_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summaries.run_statistics(_customer_lots(spark, sf_dir), ["video_id"])
    return found.select("video_id", F.array_join(F.transform("lot_numbers", lambda n: n.cast("string")), ",").alias("numbers"))


_CALLS = """c AS (SELECT (conv_id % 25)::VARCHAR AS video_id, count(*) FILTER (WHERE turn % 4 > 0)::BIGINT AS llm_calls, coalesce(sum(length(text)) FILTER (WHERE turn % 4 > 0), 0)::BIGINT AS input_tokens, coalesce(sum(turn) FILTER (WHERE turn % 4 > 0), 0)::BIGINT AS output_tokens FROM conversations GROUP BY 1)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as calls, every fourth one failed."""
    c = _table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") % 25).cast("string").alias("video_id"), F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"), F.when(F.col("turn") % 4 == 0, "failed").alias("error"))


@_query(f"WITH {_CALLS} SELECT * FROM c")
def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.usage(_calls(spark, sf_dir), ["video_id"])


@_query(
    f"""WITH {_CALLS}, {_LOTS}, s AS (SELECT video_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE unit_price <> 0)::BIGINT AS p FROM l GROUP BY 1)
    SELECT c.video_id, llm_calls, input_tokens, output_tokens, coalesce(n, 0)::BIGINT AS lot_count, coalesce(p, 0)::BIGINT AS lots_with_price, coalesce(n - p, 0)::BIGINT AS lots_without_price FROM c LEFT JOIN s USING (video_id)"""
)
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.run_summary(_customer_lots(spark, sf_dir), _calls(spark, sf_dir), ["video_id"])


@_query(f"""WITH {_LOTS} SELECT lot_number, row_number() OVER (ORDER BY nullif(timestamp_start, '') ASC NULLS LAST, lot_number)::INTEGER AS place FROM l""")
def appearance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the lots in the table view's order; a report's lots, not a corpus."""
    shown = summaries.by_timestamp(_customer_lots(spark, sf_dir)).select("lot_number", F.monotonically_increasing_id().alias("at"))
    return shown.select("lot_number", F.row_number().over(Window.orderBy("at")).alias("place"))


_ITEMS = f"""{_LOTS}, t AS (SELECT video_id, count(*) AS total_lots, sum(num_animals) AS total_animals, coalesce(avg(unit_price) FILTER (WHERE unit_price > 0), 0) AS avg_price, count(*) FILTER (WHERE sold) AS sold, count(*) FILTER (WHERE NOT sold) AS not_sold FROM l GROUP BY 1),
    g AS (SELECT video_id, category, sum(num_animals) AS animals, avg(unit_price) FILTER (WHERE unit_price > 0) AS price, row_number() OVER (PARTITION BY video_id ORDER BY sum(num_animals) DESC, min(lot_number)) AS rank FROM l GROUP BY 1, 2),
    i AS (SELECT n_nationkey + 1 AS idx, n_nationkey % 6 <> 5 AS good, 'u' || n_nationkey AS url, n_nationkey::VARCHAR AS video_id, n_name, n_nationkey FROM nation)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the URLs of a batch, every sixth one failed."""
    n, k = _table(spark, sf_dir, "nation"), F.col("n_nationkey")
    urls = n.select((k + 1).alias("ordinal"), F.concat(F.lit("u"), k).alias("url"), _text("n_nationkey").alias("video_id"))
    failures = n.where(k % 6 == 5).select((k + 1).alias("ordinal"), F.concat(F.lit("no video "), k).alias("error"))
    answers = n.select(_text("n_nationkey").alias("video_id"), F.to_json(F.struct(F.when(k % 2 == 0, F.col("n_name")).alias("farm"), F.lit("Ana").alias("auctioneer"), F.when(k % 4 == 1, F.lit("O leiloeiro é Bia.")).alias("notes"))).alias("response"))
    found = auctions.auctions(n.select(_text("n_nationkey").alias("video_id"), F.concat(F.lit("u"), k).alias("video_url")), answers)
    return auctions.batch(urls, found, _customer_lots(spark, sf_dir), failures)


def _steady(items: DataFrame) -> DataFrame:
    """Items with means of four digits: the last ones depend on the order of adding."""
    prices = F.transform_values("category_prices", lambda _, v: F.round(v, 4))
    return items.withColumns({"avg_price": F.round("avg_price", 4), "category_prices": prices})


def _sql_amount(x: str) -> str:
    """The same mean as text, with thousands commas."""
    return f"printf('%,.2f', round({x}, 4))"


@_query(
    f"""WITH {_ITEMS} SELECT idx::INTEGER AS index, CASE WHEN good THEN 'success' ELSE 'failed' END AS status, url, CASE WHEN NOT good THEN 'no video ' || n_nationkey END AS error, CASE WHEN good THEN i.video_id END AS video_id, CASE WHEN good THEN 'output/' || i.video_id END AS output_dir,
    CASE WHEN good THEN CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Ana' END END AS auction_name, CASE WHEN good THEN CASE WHEN n_nationkey % 4 = 1 THEN 'Bia' ELSE 'Ana' END END AS auctioneer_display, CASE WHEN good THEN coalesce(total_lots, 0) END::BIGINT AS total_lots,
    CASE WHEN good THEN coalesce(total_animals, 0) END::BIGINT AS total_animals, CASE WHEN good THEN round(coalesce(avg_price, 0), 4) END AS avg_price, CASE WHEN good THEN coalesce(sold, 0) END::BIGINT AS sold, CASE WHEN good THEN coalesce(not_sold, 0) END::BIGINT AS not_sold, CASE WHEN good THEN category END AS top_category
    FROM i LEFT JOIN t USING (video_id) LEFT JOIN g ON g.video_id = i.video_id AND rank = 1"""
)
def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("index", "status", "url", "error", "video_id", "output_dir", "auction_name", "auctioneer_display", "total_lots", "total_animals", "sold", "not_sold", "top_category")
    return _items(spark, sf_dir).select(*names, F.round("avg_price", 4).alias("avg_price"))


@_query(f"WITH {_ITEMS} SELECT category, sum(animals)::BIGINT AS animals FROM g JOIN i USING (video_id) WHERE good GROUP BY 1")
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.item_categories(_items(spark, sf_dir)).groupBy("category").agg(F.sum("animals").alias("animals"))


@_query(
    f"""WITH {_ITEMS}, j AS (SELECT * FROM i JOIN t USING (video_id) WHERE good)
    SELECT measure, video_id, url, round(value, 4) AS value FROM (SELECT 'most_lots' AS measure, video_id, url, total_lots::DOUBLE AS value, row_number() OVER (ORDER BY total_lots DESC, idx) AS r FROM j
    UNION ALL SELECT 'most_animals', video_id, url, total_animals::DOUBLE, row_number() OVER (ORDER BY total_animals DESC, idx) FROM j UNION ALL SELECT 'highest_avg_price', video_id, url, avg_price, row_number() OVER (ORDER BY avg_price DESC, idx) FROM j WHERE avg_price <> 0) WHERE r = 1"""
)
def batch_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.comparison(_items(spark, sf_dir)).withColumn("value", F.round("value", 4))


@_query(
    f"""WITH {_ITEMS} SELECT CASE WHEN good THEN 'OK' ELSE 'FAIL' END AS status, CASE WHEN good THEN i.video_id ELSE url END AS video, '-' AS date, '-' AS city, CASE WHEN NOT good THEN '-' WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Ana' END AS auction, CASE WHEN NOT good THEN '-' WHEN n_nationkey % 4 = 1 THEN 'Bia' ELSE 'Ana' END AS auctioneer,
    CASE WHEN good THEN coalesce(total_lots, 0)::VARCHAR ELSE '-' END AS lots, CASE WHEN good THEN coalesce(total_animals, 0)::VARCHAR ELSE '-' END AS animals,
    CASE WHEN good AND avg_price <> 0 THEN 'R$ ' || {_sql_amount("avg_price")} ELSE '-' END AS avg_price FROM i LEFT JOIN t USING (video_id)"""
)
def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terminal view of a batch."""
    return reports.batch_view(_steady(_items(spark, sf_dir)))


@_query(
    f"""WITH {_ITEMS}, w AS (SELECT video_id, max(price) FILTER (WHERE category = 'furniture') AS furniture, max(price) FILTER (WHERE category = 'machinery') AS machinery FROM g GROUP BY 1)
    SELECT video_id, CASE WHEN furniture > 0 THEN 'R$ ' || {_sql_amount("furniture")} ELSE '-' END AS furniture, CASE WHEN machinery > 0 THEN 'R$ ' || {_sql_amount("machinery")} ELSE '-' END AS machinery, '-' AS absent FROM i LEFT JOIN w USING (video_id) WHERE good"""
)
def price_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean prices of categories by item, as shown."""
    return reports.price_view(_steady(_items(spark, sf_dir)), ["furniture", "machinery", "absent"])


_BATCH = f"""{_ITEMS}, j AS (SELECT i.*, coalesce(total_lots, 0) AS n, coalesce(total_animals, 0) AS a, coalesce(avg_price, 0) AS m, coalesce(t.sold, 0) AS y, coalesce(t.not_sold, 0) AS x FROM i LEFT JOIN t USING (video_id)),
    s AS (SELECT count(*) AS v, count(*) FILTER (WHERE good) AS ok, count(*) FILTER (WHERE NOT good) AS bad, sum(n) FILTER (WHERE good) AS n, sum(a) FILTER (WHERE good) AS a, sum(y) FILTER (WHERE good) AS y, sum(x) FILTER (WHERE good) AS x FROM j),
    top AS (SELECT category, row_number() OVER (ORDER BY sum(animals) DESC, min(idx * 1000 + rank)) AS k FROM g JOIN i USING (video_id) WHERE good GROUP BY 1 QUALIFY k <= 3),
    best AS (SELECT arg_min(video_id, (-n, idx)) AS ln, max(n) AS n, arg_min(video_id, (-a, idx)) AS la, max(a) AS a, arg_min(video_id, (-m, idx)) FILTER (WHERE m <> 0) AS lm, max(round(m, 4)) FILTER (WHERE m <> 0) AS m FROM j WHERE good),
    cells AS (SELECT idx, video_id, string_agg(CASE WHEN price > 0 THEN 'R$ ' || {_sql_amount("price")} ELSE '-' END, ' | ' ORDER BY k) AS line FROM (SELECT idx, i.video_id, k, price FROM i CROSS JOIN top LEFT JOIN g ON g.video_id = i.video_id AND g.category = top.category WHERE good) GROUP BY 1, 2)"""


@_query(
    f"""WITH {_BATCH}, h(place, line) AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17]), unnest(['# Batch nations', '', '## Summary', '', '- Videos processed: ' || v, '- Successful: ' || ok, '- Failed: ' || bad, '- Lots: ' || s.n, '- Animals: ' || s.a, '- Sold: ' || y, '- Not sold: ' || x, '', '## Comparison', '',
    '- Most lots: ' || ln || ' (' || best.n || ')', '- Most animals: ' || la || ' (' || best.a || ')', '- Highest average price: ' || lm || ' (' || best.m || ')']) FROM s, best)
    SELECT place::INTEGER AS place, line FROM h WHERE line IS NOT NULL
    UNION ALL SELECT (999 + idx)::INTEGER, CASE WHEN good THEN '| success | ' || video_id || ' | - | - | ' || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Ana' END || ' | ' || CASE WHEN n_nationkey % 4 = 1 THEN 'Bia' ELSE 'Ana' END || ' | ' || n || ' | ' || a || ' | ' || printf('%.2f', round(m, 4)) || ' |' ELSE '| failed | ' || url || ' | - | - | - | - | 0 | 0 | 0.00 |' END FROM j
    UNION ALL SELECT 2000, '| Video | ' || string_agg(category, ' | ' ORDER BY k) || ' |' FROM top
    UNION ALL SELECT (2000 + row_number() OVER (ORDER BY idx))::INTEGER, '| ' || video_id || ' | ' || line || ' |' FROM cells"""
)
def batch_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report line by line: totals, comparison, the table of videos (from 1000), that of prices (from 2000)."""
    text = reports.markdown(reports.batch_report("nations", _steady(_items(spark, sf_dir))))
    lines = text.select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    one_report = Window.partitionBy(F.lit(1))  # its lines, some sixty
    starts = {n: F.max(F.when(F.col("line").startswith(mark), F.col("at"))).over(one_report) for n, mark in (("v", "## Videos"), ("p", "## Preço"))}
    marked = lines.withColumns(starts)
    at = lambda first, to, place: marked.where((F.col("at") >= first) & (F.col("at") < to) & ~F.col("line").startswith("|---")).select(place.alias("place"), "line")
    whole = at(F.lit(0), F.col("v") - 1, F.col("at") + 1)
    videos = at(F.col("v") + 4, F.col("p") - 1, F.col("at") - F.col("v") + 996)
    prices = at(F.col("p") + 2, F.lit(1 << 20), F.when(F.col("at") == F.col("p") + 2, 2000).otherwise(F.col("at") - F.col("p") + 1997))
    return whole.unionByName(videos).unionByName(prices.where("line <> ''"))
