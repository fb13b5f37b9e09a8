"""Whole plans: evidence to lots, batch reports, stage tables, sources, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from sparkyard import schemas
from sparkyard.operators import reports, summaries
from sparkyard.plans import auctions, providers
from sparkyard.sources import readers, writers
from sparkyard.streaming import windows as streaming


def lot(n, price, **more):
    return {"lot_number": n, "sex": "macho", "category": "garrotes", "num_animals": 10, "breed": "Nelore", "unit_price": price, "timestamp_start": "00:00:30"} | more


@pytest.fixture
def evidence(spark):
    segments = spark.createDataFrame([("v", 0, 0.0, 10.0, "boa noite"), ("v", 1, 1300.0, 1310.0, "fim"), ("u", 0, 0.0, 5.0, "oi")], schemas.SEGMENTS)
    ocr = spark.createDataFrame([("v", 0, "00:00:30", ["LOTE 01", "20:00:00"])], schemas.OCR)
    return auctions.windows(segments, ocr)


def test_extract_with_recorded_answers(spark, evidence):
    first = [lot(i, 3000.0 + 10 * i) for i in range(1, 11)] + [lot(11, 90000.0), lot(12, 80000.0), lot(13, "x")]
    second = [lot(1, 3500.0, breed="Angus", sold=False), lot(2, None, sold=True)]
    burst = [lot(i, 3000.0) for i in range(20, 34)]
    responses = [("v", 0, json.dumps(first)), ("v", 1, "ok " + json.dumps(second)), ("v", 2, json.dumps(burst)), ("u", 0, None)]
    r = spark.createDataFrame([(*x, 1, 1, None) for x in responses], schemas.RESPONSES)
    verdicts = spark.createDataFrame([("v", 11, '{"confirmed": true}'), ("v", 12, '{"confirmed": false, "correct_unit_price": 3100}')], schemas.VERDICTS)
    got = {x.lot_number: x for x in auctions.extract(evidence, providers.Recorded(r, verdicts)).collect()}
    assert set(got) == set(range(1, 13))
    assert (got[1].breed, got[1].unit_price, got[1].total_price, got[1].sold) == ("Nelore", 3500.0, 35000.0, False)
    assert (got[2].unit_price, got[2].sold) == (3020.0, True)
    assert (got[11].unit_price, got[11].total_price) == (90000.0, 900000.0) and got[12].unit_price == 3100.0
    plain = {x.lot_number: x.unit_price for x in auctions.extract(evidence, providers.Recorded(r)).collect()}
    assert plain[11] is None and plain[3] == 3030.0


def test_every_question_is_put_once(spark, evidence, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    listed = json.dumps([lot(i, 3000.0 + i) for i in range(1, 7)] + [lot(8, 90000.0)])

    def answer(prompt):
        import uuid

        (asked / uuid.uuid4().hex).write_text(prompt)
        if "fim" in prompt and len(list(asked.iterdir())) < 6:
            raise RuntimeError("boom")
        return listed if "LOTE 01" in prompt and "verify" not in prompt else "[]"

    provider = providers.Called(answer, "extract", "verify", "facts", store=f"{tmp_path}/answers")
    got = auctions.extract(evidence, provider)
    assert got.count() == 7 and {r.unit_price for r in got.where("lot_number = 8").collect()} == {None}
    # four windows, one of them failed, and one outlier
    prompts = [p.read_text() for p in asked.iterdir()]
    assert sum(p.startswith("extract") for p in prompts) == 4 and sum(p.startswith("verify") for p in prompts) == 1
    assert auctions.extract(evidence, provider).count() == 7
    # empty answers are answers; only the failed window is asked again
    assert len(list(asked.iterdir())) == 6
    info = spark.createDataFrame([("v", "url", "Leilão", None), ("u", None, None, None)], "video_id string, video_url string, title string, description string")
    for _ in range(2):
        found = {r.video_id: json.loads(r.value) for r in auctions.results(info, evidence, got, provider).collect()}
        assert found["v"]["total_lots"] == 7 and found["v"]["video_url"] == "url" and found["u"]["lots"] == [] and found["u"]["city"] is None
        assert len(list(asked.iterdir())) == 8


def loop(windows, say, prompt):
    """The questions of a plain loop over one video's windows, and the answers to them."""
    import re

    kept, asked = set(), []
    for w in windows:
        prior = str(sorted(kept)) if kept else "nenhum ainda"
        question = f"{prompt}\n\nLotes já encontrados (não repetir): {prior}\n\nSegmento [{w.label}]:\n\n{w.combined_text}"
        asked.append(question)
        try:
            found = [x["lot_number"] for x in json.loads(say(question)) if isinstance(x["num_animals"], int)]
        except Exception:
            continue
        if len(found) > 12:
            found = [n for n in found if n in kept or re.search(rf"LOTE 0*{n}\b", w.combined_text)]
        kept |= set(found)
    return asked


def test_windows_in_order(spark, tmp_path):
    """After any failures the questions are those of a plain loop, and known answers are not asked for again."""
    shown = [(v, i, f"{i:02d}:00:00", [f"LOTE {7 * i + k:02d}" for k in range(2)]) for v in "vw" for i in range(5)]
    ocr = spark.createDataFrame([(v, i, f"{i * 540 // 3600:02d}:{i * 540 % 3600 // 60:02d}:30", t) for v, i, _, t in shown], schemas.OCR)
    windows = auctions.windows(spark.createDataFrame([], schemas.SEGMENTS), ocr)
    asked = tmp_path / "asked"
    asked.mkdir()
    fails = tmp_path / "fails"
    one = lot(0, 3000.0)

    def say(question):
        import hashlib

        h = int(hashlib.md5(question.encode()).hexdigest(), 16)
        if fails.exists() and h % 2:
            raise RuntimeError("500")
        # bursts of invented lots, invalid ones, and lots that are known
        numbers = range(1, 31) if h % 3 == 0 else [h % 9, h % 40, 7]
        return json.dumps([one | {"lot_number": n, "num_animals": 5 if n % 4 else "many"} for n in numbers])

    def told(question):
        import uuid

        (asked / uuid.uuid4().hex).write_text(question)
        return say(question), 5, 1

    provider = providers.Called(told, "p", in_order=True, store=f"{tmp_path}/a")
    by_video = {v: windows.where(F.col("video_id") == v).orderBy("window_idx").collect() for v in "vw"}
    assert len(by_video["v"]) == 5
    before = set()
    for failing in (True, False):
        fails.touch() if failing else fails.unlink()
        rows = provider.extract(windows).collect()
        want = [q for v in "vw" for q in loop(by_video[v], say, "p")]
        new = {p.name: p.read_text() for p in asked.iterdir() if p.name not in before}
        assert set(new.values()) <= set(want) and set(want) <= {p.read_text() for p in asked.iterdir()}
        assert {(r.video_id, r.window_idx) for r in rows} == {(v, i) for v in "vw" for i in range(5)}
        assert all((r.error is None) == (r.response is not None) for r in rows)
        before |= set(new)
    # all is answered now: nothing is asked again
    assert {r.response for r in provider.extract(windows).collect()} == {r.response for r in rows} and len(list(asked.iterdir())) == len(before)
    with pytest.raises(ValueError):
        providers.Called(told, in_order=True).extract(windows)
    assert providers.Called(told, in_order=True, store=f"{tmp_path}/b").extract(windows.limit(0)).collect() == []


def test_other_words_are_another_question(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def answer(prompt):
        import uuid

        (asked / uuid.uuid4().hex).write_text(prompt)
        return prompt.rsplit("\n", 1)[1]

    window = lambda *texts: spark.createDataFrame([("v", i, 0, 600, "L", t) for i, t in enumerate(texts)], schemas.WINDOWS)
    said = lambda w, **more: [r.response for r in providers.Called(answer, "p", store=f"{tmp_path}/s", **more).extract(w).orderBy("window_idx").collect()]
    assert said(window("OLD")) == ["OLD"] and said(window("NEW")) == ["NEW"] and said(window("OLD", "NEW", "NEW")) == ["OLD", "NEW", "NEW"]
    assert len(list(asked.iterdir())) == 2
    assert said(window("OLD"), model="other") == ["OLD"] and len(list(asked.iterdir())) == 3
    store = writers.AnswerStore(spark, f"{tmp_path}/s")
    assert store.answers().count() == 3
    store.compact()
    assert store.answers().count() == 3 and len(list((tmp_path / "s" / "answers").iterdir())) == 1
    assert said(window("NEW")) == ["NEW"] and len(list(asked.iterdir())) == 3


def test_a_run_that_breaks_off_loses_one_batch(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def answer(rows):
        def run(batches):
            import uuid

            for pdf in batches:
                for t in pdf["body"]:
                    (asked / uuid.uuid4().hex).write_text(t)
                    if (asked.parent / "kill").exists() and len(list(asked.iterdir())) > 50:
                        raise SystemError("killed")
                yield pdf[["answer_key"]].assign(response=pdf["body"], input_tokens=1, output_tokens=1, error=None)

        return rows.coalesce(1).mapInPandas(run, "answer_key string, response string, input_tokens bigint, output_tokens bigint, error string")

    questions = spark.range(100).select(F.col("id").alias("n"), F.concat(F.lit("q"), "id").alias("body"))
    store = writers.AnswerStore(spark, f"{tmp_path}/s", batch=10)
    (tmp_path / "kill").touch()
    with pytest.raises(Exception, match="killed"):
        store.ask(questions, ["n"], "p", "body", answer)
    kept = store.answers().count()
    (tmp_path / "kill").unlink()
    tried = len(list(asked.iterdir()))
    largest = 30  # a batch of about ten, and the attempts of its task
    assert 0 < kept < 100 and tried - kept <= largest
    got = store.ask(questions, ["n"], "p", "body", answer)
    assert {(r.n, r.response) for r in got.collect()} == {(i, f"q{i}") for i in range(100)}
    assert len(list(asked.iterdir())) - tried == 100 - kept


def test_matrix(spark, tmp_path):
    import time

    from sparkyard.plans import matrix

    def slow(session):
        time.sleep(20)

    def broken(session):
        raise RuntimeError("no key")

    runs = matrix.run_all(spark, {"a/b": lambda session: session.range(3), "c": broken, "d": slow}, f"{tmp_path}/runs", timeout=6.0)
    assert {r.model: r.status for r in runs.collect()} == {"a/b": "ok", "c": "failed", "d": "timeout"}
    assert spark.read.parquet(f"{tmp_path}/runs/model_dir=a_b").count() == 3
    lots_ = spark.createDataFrame([("v", "a/b", 5.0), ("v", "a/b", None)], "video_id string, model string, unit_price double")
    calls = spark.createDataFrame([("v", "a/b", 7, 2)], "video_id string, model string, input_tokens bigint, output_tokens bigint")
    got = {(r.video_id, r.model): (r.status, r.lot_count, r.lots_with_price, r.llm_calls) for r in matrix.report(runs, lots_, calls, spark.createDataFrame([("v",), ("w",)], "video_id string")).collect()}
    assert len(got) == 6 and got["v", "a/b"] == ("ok", 2, 1, 1) and got["w", "a/b"] == ("ok", 0, 0, 0) and got["v", "c"] == ("failed", 0, 0, 0)


def test_runs_are_isolated(spark, tmp_path):
    """Settings and views are a run's own; of a run out of time nothing is left, and its earlier rows stay."""
    import time

    from sparkyard.plans import matrix

    path, before = f"{tmp_path}/runs", spark.conf.get("spark.sql.shuffle.partitions")
    seen = {}

    def reads(name):
        def run(session):
            session.range(5).createOrReplaceTempView("mine") if name == "a" else None
            session.conf.set("spark.sql.ansi.enabled", "true" if name == "a" else "false")
            time.sleep(2)  # both are at work by now
            seen[name] = (session.conf.get("spark.sql.shuffle.partitions"), session.conf.get("spark.sql.ansi.enabled"), session.catalog.tableExists("mine"))
            return session.range(3)

        return run

    runs = matrix.run_all(spark, {"a": reads("a"), "b": reads("b")}, path, settings={"a": {"spark.sql.shuffle.partitions": "3"}})
    assert {r.model: r.status for r in runs.collect()} == {"a": "ok", "b": "ok"}
    assert seen == {"a": ("3", "true", True), "b": (before, "false", False)}
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and not spark.catalog.tableExists("mine")

    def endless(batches):
        for b in batches:
            time.sleep(0.2)
            yield b

    # one whose job writes slowly, one that is outside Spark when its time ends, one that takes the place of its earlier rows
    job = lambda session: session.range(0, 200_000, 1, 4).mapInPandas(endless, "id bigint").where("id >= 0")
    late = lambda session: time.sleep(12) or session.range(9)
    session_conf = {"a": {"spark.sql.execution.arrow.maxRecordsPerBatch": "100"}}
    runs = matrix.run_all(spark, {"a": job, "b": late, "c": lambda session: session.range(4)}, path, timeout=8.0, settings=session_conf)
    assert {r.model: r.status for r in runs.collect()} == {"a": "timeout", "b": "timeout", "c": "ok"}
    time.sleep(10)
    assert {m: spark.read.parquet(f"{path}/model_dir={m}").count() for m in "abc"} == {"a": 3, "b": 3, "c": 4}
    assert sorted(p.name for p in (tmp_path / "runs").iterdir() if not p.name.endswith(".crc")) == ["model_dir=a", "model_dir=b", "model_dir=c"]
    runs = matrix.run_all(spark, {"a": lambda session: session.range(7)}, path)
    assert runs.first().status == "ok" and spark.read.parquet(path).groupBy("model_dir").count().orderBy("model_dir").first()["count"] == 7


def test_providers(spark, evidence):
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 4:
            raise RuntimeError("429 slow down")
        return "done"

    waits = []
    assert providers.with_retries(flaky, sleep=waits.append)("p") == "done" and waits == [5, 10, 20]
    with pytest.raises(RuntimeError):
        providers.with_retries(lambda p: (_ for _ in ()).throw(RuntimeError("500")), sleep=waits.append)("p")
    assert providers.default_model("openai") == "gpt-4.1-mini"
    with pytest.raises(ValueError):
        providers.default_model("nobody")

    one = json.dumps([lot(1, 3000.0)])

    def answer(prompt):
        if "fim" in prompt:
            raise RuntimeError("boom")
        return one

    rows = providers.Called(answer).extract(evidence).collect()
    assert {(r.video_id, r.window_idx, r.error) for r in rows} == {("v", 0, None), ("v", 1, None), ("v", 2, "boom"), ("u", 0, None)}
    assert auctions.extract(evidence, providers.Called(answer)).count() == 2
    counted = providers.Called(lambda p: ("[]", 7, 2), verify_prompt="v")
    used = summaries.usage(counted.extract(evidence), ["video_id"]).orderBy("video_id").collect()
    assert [tuple(r) for r in used] == [("u", 1, 7, 2), ("v", 3, 21, 6)]
    packets = spark.createDataFrame([("v", 1, "text")], "video_id string, lot_number bigint, packet string")
    assert tuple(counted.verify(packets).first()) == ("v", 1, "[]")
    shown = spark.createDataFrame([("w", 0, 0, 600, "L", "[00:00:01] TELA: LOTE | Boa Vista | VALORPORANIMAL | 04 | R$ | 3.100 | 26BEZERRAS-08M-NELORE")], schemas.WINDOWS)
    r = auctions.extract(shown, providers.Overlay()).first()
    assert (r.lot_number, r.category, r.sex, r.num_animals, r.age_months, r.breed, r.unit_price, r.total_price) == (4, "bezerra", "fêmea", 26, 8, "NELORE", 3100.0, 80600.0)
    frames = spark.createDataFrame([("v", 0, "00:00:00", b"x"), ("v", 1, "00:00:30", None)], "video_id string, frame_idx int, ts string, content binary")
    assert [r.tokens for r in providers.screen_text(frames, lambda b: [("hi", 0.9), ("lo", 0.1)]).orderBy("ocr_idx").collect()] == [["hi"], []]
    asr = spark.createDataFrame([("v", 0, 0, 1.0, 2.0, " a "), ("v", 1, 0, 1.0, 2.0, "b")], "video_id string, chunk_idx int, idx int, start double, end double, text string")
    assert [(r.seg_idx, r.start, r.text) for r in providers.transcript(asr, "groq").orderBy("seg_idx").collect()] == [(0, 1.0, "a"), (1, 901.0, "b")]
    cpp = asr.select("video_id", "idx", F.lit("00:00:01,500").alias("from"), F.lit("00:00:02,000").alias("to"), "text")
    assert providers.transcript(cpp, "cpp").first().start == 1.5
    with pytest.raises(ValueError):
        providers.transcript(asr, "none")


def test_settings():
    auctions.Settings()
    for bad in ({"overlap": 600}, {"frame_interval": 0}, {"video_height": 360}, {"provider": "x"}, {"transcriber": "x"}):
        with pytest.raises(ValueError):
            auctions.Settings(**bad)


def batch_of(spark, stop=False):
    urls = spark.createDataFrame([(1, "u1", "a"), (2, "u2", None), (3, "u3", "c"), (4, "u4", "d")], "ordinal int, url string, video_id string")
    answers = spark.createDataFrame([("a", '{"date": "01/02/2024", "farm": "Santa Rita", "notes": "O leiloeiro é João."}'), ("c", "broken"), ("d", '{"auctioneer": "Ana", "city": 5}')], "video_id string, response string")
    info = spark.createDataFrame([("a", "u1"), ("c", "u3"), ("d", "u4")], "video_id string, video_url string")
    lots_ = [("a", 1, "macho", "bezerro", 10, 3000.0, True), ("a", 2, "fêmea", "garrote", 8, 4000.0, None), ("c", 1, "macho", "bezerra", 10, None, False), ("c", 2, "macho", "bezerro", 7, 0.0, False), ("c", 3, "macho", "boi", 1, None, True)]
    lots = spark.createDataFrame([(v, n, s, c, k, "N", None, p, None, sold, None, None) for v, n, s, c, k, p, sold in lots_], schemas.LOTS)
    failures = spark.createDataFrame([(2, "no video")], "ordinal int, error string")
    return urls, auctions.auctions(info, answers), lots, failures, auctions.Settings(stop_on_error=stop)


def test_batch_report(spark):
    report, text = auctions.run_batch("today", *batch_of(spark))
    r = report.first()
    assert r.totals.asDict() == {"videos": 4, "successful": 3, "failed": 1, "lots": 5, "animals": 36, "sold": 2, "not_sold": 2}
    assert r.comparison["most_lots"].video_id == "c" and r.comparison["most_animals"].video_id == "a" and r.comparison["highest_avg_price"].value == 3500.0
    assert [tuple(x) for x in r.category_totals] == [("bezerro", 17), ("garrote", 8), ("bezerra", 10), ("boi", 1)]
    assert r.top_price_categories == ["bezerro", "bezerra", "garrote"]
    item = r["items"][0]
    assert (item.auction_name, item.auctioneer_display, item.output_dir, item.top_category) == ("Santa Rita", "João", "output/a", "bezerro")
    assert (r["items"][1].status, r["items"][1].error, r["items"][3].total_lots, r["items"][3].city) == ("failed", "no video", 0, "5")
    lines = text.first().value.split("\n")
    assert lines[0] == "# Batch today" and "- Most lots: c (3)" in lines and "- Highest average price: a (3500.0)" in lines
    assert "| success | a | 01/02/2024 | - | Santa Rita | João | 2 | 18 | 3500.00 |" in lines
    assert "| failed | u2 | - | - | - | - | 0 | 0 | 0.00 |" in lines
    assert "| a | R$ 3,000.00 | - | R$ 4,000.00 |" in lines and "| c | - | - | - |" in lines and lines[-1] == ""
    stopped = auctions.run_batch("x", *batch_of(spark, stop=True))[0].first()
    assert stopped.totals.videos == 2
    folder = spark.range(1).select(reports.report_folder("a b"), reports.report_folder(None)).first()
    assert folder[0] == "output/batches/a-b" and folder[1].startswith("output/batches/batch_2")


def test_empty_batch(spark):
    urls, a, lots, failures, s = batch_of(spark)
    r, text = auctions.run_batch("none", urls.limit(0), a, lots, failures, s)
    row = r.first()
    assert row.totals.videos == 0 and row.comparison == {} and row.top_price_categories == []
    assert "Preço" not in text.first().value


def test_views(spark):
    _, _, lots, _, _ = batch_of(spark)
    view = reports.summary_view(summaries.auction_summary(lots)).orderBy("video_id").first()
    assert (view.avg_price, view.male_animals, view.female_animals) == ("R$ 3,500.00", "bezerro: 10  |  garrote: 8", "")
    assert view.male_prices == "bezerro: R$ 3,000.00  |  garrote: R$ 4,000.00"
    urls, found, lots, failures, s = batch_of(spark)
    items = auctions.batch(urls, found, lots, failures, s)
    shown = [tuple(r) for r in reports.batch_view(items).collect()]
    assert shown[0] == ("OK", "a", "01/02/2024", "-", "Santa Rita", "João", "2", "18", "R$ 3,500.00") and shown[1] == ("FAIL", "u2", *"-------") and shown[3][8] == "-"
    assert [tuple(r) for r in reports.price_view(items, ["garrote"]).collect()] == [("a", "R$ 4,000.00"), ("c", "-"), ("d", "-")]
    assert [r.sold for r in reports.lots_view(lots.where("video_id = 'a'")).collect()] == ["yes", "-"]


def test_documents_round_trip(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "transcript_v1.json").write_text('[\n {"start": 0, "end": 1.5, "text": "olá"},\n {"start": 2, "end": 3, "text": "b"}]', encoding="utf-8")
    (tmp_path / "ocr_results_v1.json").write_text('{"00:00:30": ["a", "b"], "00:00:00": []}')
    (tmp_path / "lots_v1.json").write_text(json.dumps([lot(1, "50"), lot(2, 3000.0)]))
    (tmp_path / "screenshots_v1.json").write_text('[{"seconds": 30, "timestamp_str": "00:00:30", "path": "p"}]')
    seg = readers.segments(spark, f"{root}/transcript_*.json")
    assert [tuple(r) for r in seg.orderBy("seg_idx").collect()] == [("v1", 0, 0.0, 1.5, "olá"), ("v1", 1, 2.0, 3.0, "b")]
    o = readers.ocr(spark, f"{root}/ocr_results_*.json")
    assert [(r.ocr_idx, r.ts, r.tokens) for r in o.orderBy("ocr_idx").collect()] == [(0, "00:00:30", ["a", "b"]), (1, "00:00:00", [])]
    assert readers.frames(spark, f"{root}/screenshots_*.json").first().ts == "00:00:30"
    stored = readers.lots(spark, f"{root}/lots_*.json")
    assert {r.lot_number: r.unit_price for r in stored.collect()} == {1: 50.0, 2: 3000.0}
    doc = writers.document(seg, ["video_id"], "seg_idx", ["start", "end", "text"])
    assert json.loads(doc.first().value) == [{"start": 0.0, "end": 1.5, "text": "olá"}, {"start": 2.0, "end": 3.0, "text": "b"}]
    assert json.loads(writers.ocr_document(o).first().value) == {"00:00:30": ["a", "b"], "00:00:00": []}
    a = spark.createDataFrame([("v1", "u", None), ("v2", "w", "x")], "video_id string, video_url string, city string")
    out = {r.video_id: json.loads(r.value) for r in writers.result_document(a, stored).collect()}
    assert out["v1"]["total_lots"] == 2 and out["v1"]["city"] is None and out["v1"]["lots"][0]["lot_number"] == 1
    assert out["v2"]["total_lots"] == 0 and out["v2"]["lots"] == []
    wanted = spark.createDataFrame([("v1",), ("a/b ç",), ("none",)], "video_id string")
    whole = writers.document(seg, ["video_id"], "seg_idx", ["start", "end", "text"], wanted=wanted)
    writers.write_documents(whole, f"{root}/docs", "transcript")
    writers.write_documents(whole.where("video_id = 'v1'").withColumn("value", F.lit("[]")), f"{root}/docs", "transcript")
    back = {r.video_id: json.loads(r.value) for r in readers.stage_documents(spark, f"{root}/docs", "transcript").collect()}
    assert back == {"v1": [], "a/b ç": [], "none": []} and len(list((tmp_path / "docs").glob("*.json"))) == 3
    writers.write_documents(whole, f"{root}/docs", "transcript")
    assert readers.checked_segments(readers.stage_documents(spark, f"{root}/docs", "transcript", ["v1", "a/b ç"])).rows.count() == 2
    assert {r.video_id for r in readers.known_ids(spark, f"{root}/docs", "transcript", "lots").collect()} == set(back)
    writers.write_by_model(spark.createDataFrame([("a/b:c", 1)], "model string, n int"), f"{root}/models")
    assert (tmp_path / "models" / "model_dir=a_b_c").is_dir()


def test_corrupt_and_repeated(spark):
    rows = lambda *values: spark.createDataFrame([("v", v) for v in values], "video_id string, value string")
    for read, cut in ((readers.segments_of, '[{"start": 0, "end": 1, "te'), (readers.ocr_of, '{"00:00:00": ["a"'), (readers.frames_of, "x")):
        with pytest.raises(Exception):
            read(rows(cut)).collect()
    twice = readers.ocr_of(rows('{"00:00:00": ["a"], "00:00:30": ["b"], "00:00:00": ["c"]}')).orderBy("ocr_idx").collect()
    assert [(r.ts, r.tokens) for r in twice] == [("00:00:00", ["c"]), ("00:00:30", ["b"])]
    assert readers.segments_of(rows("[]")).count() == 0


def test_urls_and_listings(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# list\n\n https://youtu.be/b \nhttps://youtu.be/b\n#x\n")
    got = readers.batch_urls(spark, [" https://www.youtube.com/watch?v=a ", " "], f"{tmp_path}/urls.txt").orderBy("ordinal").collect()
    assert [(r.ordinal, r.video_id) for r in got] == [(1, "a"), (2, "b"), (3, "b")]
    listing = spark.createDataFrame([("d/audio_source_v.webm.part",), ("d/audio_source_v.webm",), ("d/audio_source_v.m4a",)], "path string")
    assert [tuple(r) for r in readers.audio_sources(listing).collect()] == [("v", "d/audio_source_v.m4a")]
    frames = readers.frame_index(spark.createDataFrame([("v", "b"), ("v", "a")], "video_id string, path string"), 20).orderBy("frame_idx").collect()
    assert [(r.seconds, r.ts, r.path) for r in frames] == [(0, "00:00:00", "a"), (20, "00:00:20", "b")]
    probe = '{"streams":[{"codec_type":"audio","duration":"3.5"},{"codec_type":"video","duration":"7.25"}]}'
    assert spark.range(1).select(readers.duration(F.lit(probe), "video")).first()[0] == 7.25
    with pytest.raises(Exception, match="no video stream"):
        spark.range(1).select(readers.duration(F.lit('{"streams":[]}'), "video")).collect()
    docs = spark.createDataFrame([("a", "m", '{"x":1}'), ("b", "m", "{")], "video_id string, model string, value string")
    wanted = spark.createDataFrame([(v, "m") for v in "abc"], "video_id string, model string")
    assert {r.video_id for r in readers.tolerant(docs, wanted, ["video_id", "model"]).where("document is not null").collect()} == {"a"}
    info = readers.video_info(spark.createDataFrame([("v", None, "d" * 3000)], schemas.VIDEO_INFO)).first()
    assert (info.title, len(info.description)) == ("", 2000)
    (tmp_path / "p.txt").write_text("a\nb")
    assert readers.prompt(spark, f"{tmp_path}/p.txt") == "a\nb"


def test_stage_table(spark, tmp_path):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "video_id string")
    made = []

    def make(keys):
        made.append(sorted(r.video_id for r in keys.collect()))
        return keys.withColumns({"n": F.length("video_id"), "error": F.when(F.col("video_id") == "b", "failed")})

    stage = writers.StageTable(spark, f"{tmp_path}/stage", size=600)
    assert stage.fill(wanted, make).count() == 2 and stage.fill(wanted, make).count() == 2
    assert made == [["a", "b", "c"], ["b"]]
    other = writers.StageTable(spark, f"{tmp_path}/stage", size=300)
    assert other.missing(wanted).count() == 3
    stage.clear(wanted.where("video_id = 'a'"))
    assert {r.video_id for r in stage.missing(wanted).collect()} == {"a", "b"}
    # keys without any result are completed as well
    none = writers.StageTable(spark, f"{tmp_path}/none")
    made.clear()
    for _ in range(2):
        assert none.fill(wanted, lambda keys: make(keys).where("n > 9")).count() == 0
    assert made == [["a", "b", "c"]]


def test_streaming_windows(spark, tmp_path):
    rows = spark.createDataFrame([("v", i * 100, f"l{i}") for i in range(10)], "video_id string, s int, line string")
    rows.select("video_id", F.timestamp_seconds("s").alias("at"), "line").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("video_id string, at timestamp, line string").parquet(f"{tmp_path}/in")
    q = streaming.windowed_lines(stream).writeStream.outputMode("complete").format("memory").queryName("lines").start()
    q.processAllAvailable()
    q.stop()
    got = {r.window_start.timestamp(): r.lines for r in spark.table("lines").collect()}
    assert got[0] == [f"l{i}" for i in range(6)] and got[540] == ["l6", "l7", "l8", "l9"]
    lots = spark.createDataFrame([("v", 0, 5.0, True), ("v", 60, 0.0, None)], "video_id string, s int, unit_price double, sold boolean").withColumn("at", F.timestamp_seconds("s"))
    r = streaming.running_prices(lots).first()
    assert (r.lots, r.avg_price, r.sold) == (2, 5.0, 1)


def names(folder):
    return sorted(p.name for p in folder.glob("*.json"))


def put_evidence(folder, *ids):
    folder.mkdir(exist_ok=True)
    for i in ids:
        (folder / f"transcript_{i}.json").write_text('[{"start": 0, "end": 1.5, "text": "olá"}]')
        (folder / f"ocr_results_{i}.json").write_text('{"00:00:01": ["LOTE", "Boa Vista", "VALORPORANIMAL", "04", "R$", "3.100", "26BEZERRAS-08M-NELORE"]}')


def test_documents_stay_and_failures_are_rows(spark, tmp_path, capsys):
    from sparkyard.plans import runs
    from sparkyard.plans.__main__ import main

    folder, out = tmp_path / "docs", tmp_path / "out"
    put_evidence(folder, "good", "two", "bad", "worse")
    (folder / "transcript_bad.json").write_text('[{"start": 0, "end": 1, "te')
    (folder / "ocr_results_worse.json").write_text('{"00:00:01": "no list"}')
    (folder / "transcript_silent.json").write_text("[]")
    (folder / "video_info_good.json").write_text('{"title": "Leilão", "description": null}')
    url = "https://youtu.be/"
    assert main(["run", str(folder), str(out), url + "good"]) == 0
    assert names(out) == ["lots_good.json", "metadata_good.json", "result_good.json"]
    result = json.loads((out / "result_good.json").read_text())
    assert result["total_lots"] == 1 and result["lots"][0]["total_price"] == 80600.0 and result["video_url"] == url + "good" and result["city"] is None
    first = (out / "result_good.json").stat().st_mtime_ns
    # ids that no URL holds come from a table
    (tmp_path / "lookup.json").write_text('{"url": "https://example.com/live", "video_id": "two"}\n')
    more = ["https://example.com/live", *(url + x for x in ("bad", "silent", "gone"))]
    assert main(["run", str(folder), str(out), *more, "https://example.com/", url + "worse", "--batch-name", "b 1", "--lookup", str(tmp_path / "lookup.json")]) == 1
    assert names(out) == [f"{s}_{v}.json" for s in ("lots", "metadata", "result") for v in ("good", "silent", "two")]
    assert (out / "result_good.json").stat().st_mtime_ns == first
    assert json.loads((out / "lots_silent.json").read_text()) == [] and json.loads((out / "metadata_silent.json").read_text()) == {}
    assert json.loads((out / "result_silent.json").read_text())["lots"] == []
    report = json.loads(spark.read.text(f"{out}/batches/b-1/batch_summary").first()[0])
    assert [(i["index"], i["status"], i["error"]) for i in report["items"]] == [
        (1, "success", None),
        (2, "failed", "transcript: no such JSON"),
        (3, "success", None),
        (4, "failed", "no transcript or screen text"),
        (5, "failed", "no video id in https://example.com/"),
        (6, "failed", "ocr_results: no such JSON"),
    ]
    assert report["totals"]["failed"] == 4 and report["totals"]["lots"] == 1
    assert "failed (2): transcript: no such JSON" in capsys.readouterr().err
    # the first failure ends the run before later stages
    urls = readers.batch_urls(spark, [url + "good", url + "bad", url + "two", "https://example.com/"])
    e = runs.evidence(spark, str(folder), f"{tmp_path}/work", urls, stop=True)
    assert [r.ordinal for r in e.urls.orderBy("ordinal").collect()] == [1, 2] and [r.ordinal for r in e.failures.collect()] == [2] and [r.video_id for r in e.keys.collect()] == ["good"]
    assert {r.video_id for r in runs.evidence(spark, str(folder), f"{tmp_path}/all", None).keys.collect()} == {"good", "two", "silent"}
    # what a run writes is what batch and evaluate read
    assert main(["batch", str(out), str(tmp_path / "report")]) == 2
    (tmp_path / "found").mkdir()
    (tmp_path / "found" / "lots_two.json").write_text((out / "lots_two.json").read_text())
    (out / "lots_two.json").write_text('[{"lot_number": 1}]')
    assert main(["batch", str(out), str(tmp_path / "report"), url + "two", url + "good", "--batch-name", "bad lot"]) == 1
    report = json.loads(spark.read.text(f"{tmp_path}/report/batches/bad-lot/batch_summary").first()[0])
    assert report["items"][0]["error"].startswith("lots: invalid ") and "sex" in report["items"][0]["error"] and report["totals"]["lots"] == 1
    assert main(["evaluate", str(out), str(tmp_path / "e"), str(tmp_path / "found")]) == 0
    assert {r.video_id: r.error for r in spark.read.json(f"{tmp_path}/e/unreadable").collect()}.keys() == {"two"}


def test_only_what_has_changed_is_made_anew(spark, tmp_path):
    from sparkyard.plans import runs

    folder, out, asked = tmp_path / "docs", tmp_path / "out", tmp_path / "asked"
    put_evidence(folder, "a", "b")
    (folder / "transcript_b.json").write_text('[{"start": 0, "end": 1.5, "text": "oi"}]')  # the same question would be put once
    asked.mkdir()
    listed = json.dumps([lot(1, 3000.0)])

    def answer(prompt):
        import uuid

        (asked / uuid.uuid4().hex).write_text(prompt)
        return listed if prompt.startswith("extract") else '{"city": "Goiânia", "farm": null}'

    def go(**more):
        outcome = runs.run(spark, str(folder), str(out), auctions.Settings(), providers.Called(answer, "extract", None, "facts"), **more)
        assert outcome.failures.count() == 0 and outcome.lots.count() == 2
        made = len(list(asked.iterdir()))
        return made, {p.name: p.stat().st_mtime_ns for p in out.glob("*.json")}

    made, first = go()
    assert made == 4 and len(first) == 6
    assert json.loads((out / "metadata_a.json").read_text())["farm"] is None and json.loads((out / "result_a.json").read_text())["city"] == "Goiânia"
    assert go() == (4, first)
    (folder / "transcript_a.json").write_text('[{"start": 0, "end": 1.5, "text": "outra"}]')
    made, second = go()
    assert made == 6 and {n for n in first if first[n] != second[n]} == {"lots_a.json", "metadata_a.json", "result_a.json"}
    # a title is asked about in the metadata only
    (folder / "video_info_b.json").write_text('{"title": "T", "description": "d"}')
    made, third = go()
    assert made == 7 and {n for n in first if third[n] != second[n]} == {"lots_b.json", "metadata_b.json", "result_b.json"}
    (out / "result_b.json").unlink()
    assert go()[0] == 7 and (out / "result_b.json").exists()
    # made anew from the answers that are there
    assert go(resume=False)[0] == 7


def test_files_of_others_are_not_opened(spark, tmp_path):
    put_evidence(tmp_path / "d", *"abcdef")
    found = readers.stage_documents(spark, str(tmp_path / "d"), "transcript", ["b", "e"])
    assert {r.video_id for r in found.collect()} == {"b", "e"}
    plan = found._jdf.queryExecution().executedPlan()
    plan.execute().count()
    assert plan.collectLeaves().apply(0).metrics().get("numFiles").get().value() == 2


def test_a_writer_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    rows = lambda *r: spark.createDataFrame(list(r), "video_id string, value string")
    writers.write_documents(rows(("a", "[1]"), ("b", None), ("a", "[0]")), str(tmp_path), "lots")
    assert names(tmp_path) == ["lots_a.json"] and (tmp_path / "lots_a.json").read_text().strip() == "[1]"
    with monkeypatch.context() as m:
        m.setattr(writers, "move", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            writers.write_documents(rows(("a", "[2]"), ("c", "[3]")), str(tmp_path), "lots")
    assert (tmp_path / "lots_a.json").read_text().strip() == "[1]"
    writers.write_documents(rows(("d", "[4]")), str(tmp_path), "lots")
    assert names(tmp_path) == ["lots_a.json", "lots_c.json", "lots_d.json"] and (tmp_path / "lots_a.json").read_text().strip() == "[2]"


def test_checked_documents(spark):
    rows = lambda *values: spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "video_id string, value string")
    bad = ["[1]", "{}", "", None, "x", "[] y", '[],"x":[]', '[{"start": 1, "end": 2}]', '[{"start": "s", "end": 2, "text": "t"}]', "null", "[null]"]
    read = readers.checked_segments(rows('[{"start": 0, "end": 1, "text": "a"}]', "[]", *bad))
    assert [tuple(r) for r in read.rows.collect()] == [("0", 0, 0.0, 1.0, "a")]
    assert {r.video_id for r in read.failures.collect()} == {str(i + 2) for i in range(len(bad))}
    o = readers.checked_ocr(rows('{"00:00:00": ["a"], "00:00:30": ["b"], "00:00:00": ["c"]}', "{}", '{"00:00:00": ["a"', '{"00:00:00": 5}', '{"00:00:00": null}', "[]"))
    assert [tuple(r) for r in o.rows.orderBy("ocr_idx").collect()] == [("0", 0, "00:00:00", ["c"]), ("0", 1, "00:00:30", ["b"])]
    assert {r.video_id for r in o.failures.collect()} == {"2", "3", "4", "5"}
    f = readers.checked_frames(rows('[{"seconds": 30, "timestamp_str": "00:00:30", "path": "p"}]', '[{"seconds": 30}]'))
    assert [tuple(r) for r in f.rows.collect()] == [("0", 0, 30, "00:00:30", "p")] and f.failures.count() == 1
    stored = readers.checked_lots(rows(json.dumps([lot(1, "50"), lot(2, None)]), "[]", json.dumps([lot(1, 5.0), lot("x", 5.0)]), "{", json.dumps([1])))
    assert [(r.video_id, r.pos, r.lot_number, r.unit_price) for r in stored.rows.orderBy("pos").collect()] == [("0", 0, 1, 50.0), ("0", 1, 2, None)]
    assert {r.video_id: r.error for r in stored.failures.collect()} == {"2": "lots: invalid lot_number", "3": "lots: no such JSON", "4": "lots: invalid shape"}


def test_endpoint(spark, tmp_path, monkeypatch):
    """A model over HTTP: answers, tokens, waits, a key that is missing."""
    import http.server
    import threading

    from sparkyard.plans import endpoint
    from sparkyard.plans.__main__ import main

    class Model(http.server.BaseHTTPRequestHandler):
        asked: list = []

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            Model.asked.append((self.path, self.headers["Authorization"], body))
            status = 429 if len(Model.asked) == 1 else 200
            said = {"choices": [{"message": {"content": json.dumps([lot(3, 2000.0)])}}], "usage": {"prompt_tokens": 11, "completion_tokens": 2}}
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(said if status == 200 else {"error": "slow down"}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    try:
        call = endpoint.endpoint("openai", url=url)
        waits = []
        assert providers.with_retries(call, sleep=waits.append)("hi") == (json.dumps([lot(3, 2000.0)]), 11, 2) and waits == [5]
        path, key, body = Model.asked[-1]
        assert (path, key, body["model"], body["messages"][0]["content"]) == ("/v1/chat/completions", "Bearer k", "gpt-4.1-mini", "hi")
        # the workers of this session were started without the key: every window fails, the video has no lots
        put_evidence(tmp_path / "docs", "a")
        (tmp_path / "p.txt").write_text("extract")
        assert main(["extract", str(tmp_path / "docs"), str(tmp_path / "out"), "--call", "--provider", "openai", "--endpoint", url, "--prompt", str(tmp_path / "p.txt")]) == 0
        assert names(tmp_path / "out") == ["lots_a.json"]
        errors = {r.error for r in writers.AnswerStore(spark, f"{tmp_path}/out/_stages/answers").answers().collect()}
        assert errors <= {None, "OPENAI_API_KEY is not set"}
        monkeypatch.delenv("OPENAI_API_KEY")
        with pytest.raises(RuntimeError, match="not set"):
            call("hi")
        with pytest.raises(ValueError):
            endpoint.endpoint("nobody")
    finally:
        server.shutdown()


def test_evaluation_of_models(spark, tmp_path):
    from sparkyard.plans.__main__ import main

    for name, lots_ in (("ref", [lot(1, 3000.0), lot(2, 4000.0)]), ("m/x", [lot(1, 3300.0), lot(5, 1.0)]), ("m/y", [lot(2, 4000.0, sex="fêmea")])):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "lots_v.json").write_text(json.dumps(lots_))
    (tmp_path / "m/y/lots_w.json").write_text("[")
    run = {"video_id": "v", "provider": "p", "status": "ok", "elapsed_seconds": 10.0, "llm_calls": 2, "lot_count": 2}
    (tmp_path / "runs.json").write_text("\n".join(json.dumps(run | {"model": m, "input_tokens": 1_000_000, "output_tokens": 500_000}) for m in "xy"))
    (tmp_path / "prices.json").write_text("\n".join(json.dumps({"model": m, "input_price": p, "output_price": 2.0}) for m, p in (("x", 1.0), ("y", 3.0))))
    assert main(["evaluate", str(tmp_path / "m"), str(tmp_path / "e"), str(tmp_path / "ref"), "--models", "x", "y", "--runs", str(tmp_path / "runs.json"), "--prices", str(tmp_path / "prices.json")]) == 0
    got = {r.model: r for r in spark.read.json(f"{tmp_path}/e/evaluation").collect()}
    assert (got["x"].matched, got["x"].missing, got["x"].extra, round(got["x"].mape, 6), got["y"].sex_match) == (1, 1, 1, 0.1, 0.0)
    assert {r.model: r.cost for r in spark.read.json(f"{tmp_path}/e/totals").collect()} == {"x": 2.0, "y": 4.0}
    side = {r.metric: (r.x, r.y) for r in spark.read.json(f"{tmp_path}/e/side_by_side").collect()}
    assert side["coverage"] == (0.5, 0.5) and side["cost"] == (2.0, 4.0)
    assert {r.model for r in spark.read.json(f"{tmp_path}/e/prices").collect()} == {"x", "y", "reference"}
    assert [(r.model, r.video_id) for r in spark.read.json(f"{tmp_path}/e/unreadable").collect()] == [("y", "w")]
    assert spark.read.json(f"{tmp_path}/e/runs").count() == 2


def test_run_tables(spark, tmp_path):
    assert writers.metadata_document(spark.createDataFrame([("a", None)], "video_id string, city string"), ["city"]).first().value == "{}"
    facts = spark.createDataFrame([("a", None, "x")], "video_id string, city string, farm string")
    assert writers.metadata_document(facts, ["city", "farm"]).first().value == '{"city":null,"farm":"x"}'
    runs = spark.createDataFrame([("a", "m", "x" * 900)], "video_id string, model string, error string")
    writers.append_run(runs, f"{tmp_path}/runs")
    writers.append_run(runs, f"{tmp_path}/runs")
    assert [len(r.error) for r in spark.read.parquet(f"{tmp_path}/runs").collect()] == [400, 400]
