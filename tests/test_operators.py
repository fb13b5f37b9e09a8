"""Operators against the worked cases and brute force."""

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sparkyard import schemas
from sparkyard.operators import evaluation, lots, parsing, summaries, timeline


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def windows_of(spark, segments, ocr, **kw):
    s = frame(spark, [("v", i, float(a), float(b), t) for i, (a, b, t) in enumerate(segments)], schemas.SEGMENTS)
    o = frame(spark, [("v", i, ts, tokens) for i, (ts, tokens) in enumerate(ocr)], schemas.OCR)
    return timeline.text_windows(s, o, **kw).orderBy("window_idx").collect()


def test_windows_cases(spark):
    assert windows_of(spark, [], []) == []
    rows = windows_of(spark, [], [("00:00:30", ["a", "20:05:08", "b"]), ("00:12:00", ["x"]), ("00:01:00", ["10:00:00"])])
    assert [(r.window_start, r.window_end, r.label, r.combined_text) for r in rows] == [(0, 600, "00:00:00 - 00:10:00", "[00:00:30] TELA: a | b"), (540, 1140, "00:09:00 - 00:19:00", "[00:12:00] TELA: x")]
    assert [r.window_start for r in windows_of(spark, [(0, 1199, "x")], [])] == [0, 540, 1080]
    rows = windows_of(spark, [(0, 1, "a"), (1800, 1801, "b")], [])
    assert rows[1].combined_text == timeline.NOTHING and len(rows) == 4
    rows = windows_of(spark, [(600, 601, "s"), (5, 6, "first")], [("00:10:00", ["o"]), ("00:09:00", ["p"])])
    assert rows[0].combined_text == "[00:00:05] ÁUDIO: first\n[00:09:00] TELA: p\n[00:10:00] ÁUDIO: s\n[00:10:00] TELA: o"
    assert rows[1].combined_text == "[00:09:00] TELA: p\n[00:10:00] ÁUDIO: s\n[00:10:00] TELA: o"
    with pytest.raises(ValueError):
        timeline.window_range("a", "b", 60, 60)


def test_assignment_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        a = rng.choice((rng.uniform(0, 5000), 540.0 * rng.randrange(8), 600.0 * rng.randrange(8), 540.0 * rng.randrange(8) + 600))
        rows.append((i, a, a + rng.choice((0.0, 0.5, 60.0, 1300.0))))
    df = frame(spark, rows, "i int, s double, e double")
    got = {(r.i, r.window_idx) for r in timeline.assign(df, "s", "e").collect()}
    assert got == {(i, k) for i, s, e in rows for k in range(40) if e >= 540 * k and s <= 540 * k + 600}
    cover = {r.i: r.window_idx for r in timeline.first_cover(df, "s").collect()}
    assert cover == {i: next(k for k in range(40) if 540 * k <= s <= 540 * k + 600) for i, s, _ in rows}


def test_first_cover_and_chunks(spark):
    df = frame(spark, [(560.0,), (0.0,), (601.0,), (1141.0,), (99999.0,), (None,), (-5.0,)], "at double")
    assert [r.window_idx for r in timeline.first_cover(df.withColumn("last", F.lit(2)), "at", "last").collect()] == [0, 0, 1, 2, None, None, None]
    chunks = timeline.chunk_starts(frame(spark, [(1801.0,), (0.0,)], "d double"), "d").collect()
    assert [(r.chunk_idx, r.chunk_start) for r in chunks] == [(0, 0), (1, 900), (2, 1800)]
    moved = timeline.shift_chunks(frame(spark, [(1, 2.0, 3.0)], "c int, start double, end double"), "c").first()
    assert (moved.start, moved.end) == (902.0, 903.0)
    df = frame(spark, [([("a", 0.4), ("b", 0.39), ("c", None)],)], "d array<struct<text:string,confidence:double>>")
    assert df.select(timeline.confident_text("d")).first()[0] == ["a"]


def test_head_context(spark):
    w = frame(spark, [("v", i, 0, 0, f"L{i}", f"t{i}") for i in (2, 0, 1, 3)] + [("u", 0, 0, 0, "L", "t")], schemas.WINDOWS)
    info = frame(spark, [("v", "T", "D"), ("u", "", None)], schemas.VIDEO_INFO)
    got = {r.video_id: r.context for r in timeline.head_context(w, info).collect()}
    assert got == {"v": "Título do vídeo: T\nDescrição do vídeo:\nD\n\n---\n\n[L0]\nt0\n\n[L1]\nt1\n\n[L2]\nt2", "u": "[L]\nt"}


GOOD = {"lot_number": 1, "sex": "macho", "category": "Garrotes", "num_animals": 10, "breed": "Nelore"}


def parsed(spark, responses):
    df = frame(spark, [("v", i, r, 1, 1, None) for i, r in enumerate(responses)], schemas.RESPONSES)
    return parsing.read_lots(df)


def test_parsing(spark):
    responses = [
        json.dumps([GOOD, GOOD | {"unit_price": "abc"}, GOOD | {"lot_number": "7", "unit_price": "3.100,00", "sold": "yes", "x": 1}, 5]),
        "Here: " + json.dumps([GOOD | {"unit_price": 5.16, "age_months": None}]) + " done",
        json.dumps({"lots": [GOOD]}),
        "nothing",
        None,
        json.dumps([{k: v for k, v in GOOD.items() if k != "breed"}, GOOD | {"breed": 5}, GOOD | {"age_months": "x"}, GOOD | {"sold": "sim"}, GOOD | {"total_price": ""}]),
    ]
    good = parsing.valid(parsed(spark, responses)).orderBy("window_idx", "pos").collect()
    assert [(r.window_idx, r.lot_number, r.category, r.unit_price, r.sold) for r in good] == [(0, 1, "garrote", None, None), (0, 7, "garrote", 3100.0, True), (1, 1, "garrote", 5160.0, None), (2, 1, "garrote", None, None), (5, 1, "garrote", None, None)]
    bad = {(r.window_idx, r.pos): r.errors for r in parsing.quarantine(parsed(spark, responses)).collect()}
    assert bad == {(0, 1): ["unit_price"], (0, 3): ["shape"], (5, 0): ["breed"], (5, 1): ["breed"], (5, 2): ["age_months"], (5, 3): ["sold"]}
    stored = frame(spark, [(json.dumps([GOOD | {"unit_price": "50"}]),)], "value string")
    row = parsing.rebuilt(parsing.lots_of_text(stored)).first()
    assert row.unit_price == 50000
    with pytest.raises(Exception, match="invalid lot"):
        parsing.lots_of_text(frame(spark, [(json.dumps([GOOD | {"sex": 1}]),)], "value string")).collect()


@pytest.mark.parametrize(
    "n,u,t,bounds,want",
    [
        (10, 3000.0, 500.0, None, (3000, None)),
        (10, 3000.0, 30000.0, None, (3000, 30000)),
        (10, 3000.0, 29500.0, None, (3000, 29500)),
        (1, 5000.0, 1000.0, None, (5000, None)),
        (1, 3000.0, 2800.0, None, (None, None)),
        (0, 3000.0, 2800.0, None, (None, None)),
        (1, 50.0, None, (500.0, 15000.0), (None, None)),
        (1, 30000.0, None, (500.0, 15000.0), (None, None)),
        (50, 50000.0, 2500.0, (500.0, 15000.0), (None, None)),
        (10, 50.0, None, None, (50000, None)),
        (None, 3000.0, 2800.0, None, (None, None)),
        (10, None, 30000.0, (500.0, 15000.0), (None, 30000)),
    ],
)
def test_repair(spark, n, u, t, bounds, want):
    lo, hi = bounds or (0.0, math.inf)
    df = frame(spark, [(n, u, t, lo, hi)], "num_animals bigint, unit_price double, total_price double, lo double, hi double")
    out = lots.repair(df, lo="lo", hi="hi").first() if bounds else lots.repair(df).first()
    assert (out.unit_price, out.total_price) == want


def test_fill_total(spark):
    df = frame(spark, [(10, 3000.5, None), (0, 5.0, None), (2, None, None), (2, 1.0, 7.0)], "num_animals bigint, unit_price double, total_price double")
    assert [r.total_price for r in lots.fill_total(df).collect()] == [30005.0, None, None, 7.0]


def test_merge(spark):
    rows = [("v", 1, 0, 0, "Nelore", 2600.0, True), ("v", 1, 1, 0, "Anelorado", 1900.0, False), ("v", 1, 1, 1, None, None, None), ("v", 2, 0, 1, None, 5.0, None), ("v", 2, 3, 0, "Angus", None, True)]
    df = frame(spark, rows, "video_id string, lot_number bigint, window_idx int, pos int, breed string, unit_price double, sold boolean")
    got = lots.merge_records(df, ("video_id", "lot_number"), ("window_idx", "pos"), ("breed",), ("unit_price", "sold")).orderBy("lot_number").collect()
    assert [(r.breed, r.unit_price, r.sold) for r in got] == [("Nelore", 1900.0, False), ("Angus", 5.0, True)]


def test_fences(spark):
    rng = random.Random(3)
    groups = {"a": [2000.0 + 500 * i for i in range(7)], "b": [3000.0, 4000.0], "c": [100.0, 200.0, 300.0, 400.0, 0.0, 0.0], "d": [rng.choice((5.0, rng.uniform(0, 99))) for _ in range(501)], "e": [7.0] * 40, "f": [None, -1.0]}
    df = frame(spark, [(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    for made in (lots.fences(df, ["g"], "v"), lots.fences_of_large_groups(df, ["g"], "v")):
        got = {r.g: r for r in made.collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            vs = [v for v in vs if v and v > 0]
            assert got[g].n == len(vs)
            if len(vs) < 5:
                assert (got[g].lo, got[g].hi) == (0, math.inf)
                continue
            q1, _, q3 = statistics.quantiles(vs, n=4)
            assert got[g].q1 == pytest.approx(q1) and got[g].q3 == pytest.approx(q3)
            assert got[g].lo == pytest.approx(max(0, q1 - 1.5 * (q3 - q1))) and got[g].hi == pytest.approx(q3 + 1.5 * (q3 - q1))
    flagged = lots.flag_outliers(frame(spark, [("a", 9000.0), ("a", 3000.0), ("a", None), ("b", 1e9)], "g string, v double"), lots.fences(df, ["g"], "v"), ["g"], "v")
    assert {(r.v, r.outlier) for r in flagged.collect()} == {(9000.0, True), (3000.0, False), (None, False), (1e9, False)}


def test_burst_guard_against_sequence(spark):
    rng = random.Random(2)
    rows = [("v%d" % v, w, rng.randrange(40), rng.random() < 0.3) for v in range(6) for w in range(6) for _ in range(rng.choice((3, 12, 13, 25)))]
    support = {}
    rows = [(v, w, n, support.setdefault((v, w, n), s)) for v, w, n, s in rows]
    kept, found = set(), []
    for v, w in sorted({r[:2] for r in rows}):
        here = [r for r in rows if r[:2] == (v, w)]
        stay = [r for r in here if len(here) <= 12 or (v, r[2]) in kept or r[3]]
        kept |= {(v, r[2]) for r in stay}
        found += stay
    df = frame(spark, rows, "video_id string, window_idx int, lot_number int, supported boolean")
    got = lots.burst_guard(df, "video_id", "window_idx", "lot_number", "supported")
    assert sorted(map(tuple, got.collect())) == sorted(found)


@pytest.mark.parametrize(
    "response,want",
    [
        ('{"confirmed": true}', ("confirm", None)),
        ('{"confirmed": "false"}', ("confirm", None)),
        ('x {"confirmed": false, "correct_unit_price": 5500} y', ("price", 5500.0)),
        ('{"confirmed": false, "correct_unit_price": "R$ 3.100,00"}', ("price", 3100.0)),
        ('{"confirmed": false, "correct_unit_price": 9000.001}', ("confirm", None)),
        ('{"confirmed": false, "correct_unit_price": null}', ("discard", None)),
        ('{"confirmed": false, "correct_unit_price": "many"}', ("discard", None)),
        ('{"correct_unit_price": []}', ("discard", None)),
        ("{}", ("discard", None)),
        ("garbage", (None, None)),
        ('{"confirmed":true} and {"x":1}', (None, None)),
        (None, (None, None)),
    ],
)
def test_verdicts(spark, response, want):
    df = frame(spark, [(response, 9000.0)], "r string, u double")
    v = lots.with_verdicts(df, "r", "u").first()
    assert (v.verdict, v.verdict_price) == want


def test_apply_verdicts_and_settle(spark):
    schema = "video_id string, lot_number bigint, num_animals bigint, unit_price double, total_price double, timestamp_start string, lo double, hi double, outlier boolean"
    rows = [("v", i, 2, u, t, ts, 500.0, 5000.0, u > 5000) for i, u, t, ts in ((1, 9000.0, None, "00:01:00"), (2, 9000.0, 18000.0, "00:01:00"), (3, 9000.0, 18000.0, "00:01:00"), (4, 9000.0, None, None), (5, 3000.0, None, None), (6, 9000.0, 18000.0, "00:01:00"))]
    said = [("v", 1, '{"confirmed": true}'), ("v", 2, '{"confirmed": false, "correct_unit_price": 4000}'), ("v", 3, '{"confirmed": false, "correct_unit_price": 8000}'), ("v", 4, '{"confirmed": true}')]
    judged = lots.apply_verdicts(frame(spark, rows, schema), frame(spark, said, schemas.VERDICTS))
    got = {r.lot_number: (r.unit_price, r.total_price, r.trusted) for r in lots.settle(judged).collect()}
    assert got == {1: (9000.0, 18000.0, True), 2: (4000.0, 8000.0, False), 3: (None, None, False), 4: (None, None, False), 5: (3000.0, 6000.0, False), 6: (None, None, False)}
    plain = {r.lot_number: r.unit_price for r in lots.settle(lots.apply_verdicts(frame(spark, rows, schema), None)).collect()}
    assert plain == {1: None, 2: None, 3: None, 4: None, 5: 3000.0, 6: None}


def lot_rows(spark, rows):
    full = [("v", i, s, c, n, "Nelore", None, p, None, sold, ts, None) for i, (s, c, n, p, sold, ts) in enumerate(rows, 1)]
    return frame(spark, full, schemas.LOTS)


def test_auction_summary(spark):
    df = lot_rows(spark, [("macho", "boi", 5, 3000.0, True, None), ("fêmea", "vaca", 7, 5000.0, True, ""), ("femea", "touro", 5, None, False, "00:02:00"), ("macho", "vaca", 1, 0.0, None, "00:01:00")])
    r = summaries.auction_summary(df).first()
    assert (r.total_lots, r.total_animals, r.avg_price, r.sold, r.not_sold) == (4, 18, 4000.0, 2, 1)
    assert r.sex_animals == {"macho": 6, "fêmea": 7}
    assert [tuple(x) for x in r.category_animals] == [("vaca", 8), ("boi", 5), ("touro", 5)] and r.top_category == "vaca"
    assert r.category_prices == {"boi": 3000.0, "vaca": 5000.0}
    assert [x.lot_number for x in summaries.by_timestamp(df).collect()] == [4, 3, 1, 2]
    assert summaries.auction_summary(df.limit(0)).count() == 0
    s = summaries.run_statistics(df, ["video_id"]).first()
    assert (s.unknown_sold, s.lots_with_price, s.lots_without_price, s.avg_unit_price, s.lots_with_breed, s.lots_with_timestamp, s.lot_numbers) == (1, 2, 2, 4000.0, 4, 3, [1, 2, 3, 4])
    p = summaries.price_statistics(df, ["video_id"]).first()
    assert (p.n, p.sold, p["mean"], p.median, p.min, p.max) == (4, 2, 4000.0, 4000.0, 3000.0, 5000.0)
    assert [r[0] for r in frame(spark, [("boi",), ("vaca",), ("x",)], "c string").select(summaries.bucketed("c")).collect()] == ["male", "female", "other"]


def test_first_maximum_and_top(spark):
    df = frame(spark, [(2, 5, "b"), (1, 5, "a"), (3, 4, "c")], "index int, lots int, id string")
    assert tuple(summaries.first_maximum(df, "lots", "index", ["id"]).first()) == ("a", 5)
    assert summaries.first_maximum(df.limit(0), "lots", "index", ["id"]).count() == 0
    cats = frame(spark, [(1, 1, "bezerro", 10), (1, 2, "garrote", 8), (2, 1, "bezerra", 10), (2, 2, "bezerro", 7), (2, 3, "garrote", 5), (2, 4, "boi", 10)], "index int, rank int, category string, animals bigint")
    assert [tuple(r) for r in summaries.top_categories(cats).collect()] == [("bezerro", 17), ("garrote", 13), ("bezerra", 10)]


def test_agreement(spark):
    schema = "lot_number int, category string, sex string, num_animals int, unit_price double, pos int"
    ref = frame(spark, [(1, "boi", "macho", 5, 100.0, 0), (2, "Vaca", None, None, 1000.0, 1), (3, "boi", "macho", 5, 0.0, 2), (3, "touro", "macho", 5, 200.0, 3)], schema)
    model = frame(spark, [(2, "vaca", "", None, 1100.0, 0), (3, "boi", "macho", 6, 200.0, 1), (4, "boi", "macho", 6, None, 2)], schema)
    r = evaluation.agreement(ref, model, ["lot_number"], order="pos").first()
    assert (r.ref_n, r.model_n, r.matched, r.missing, r.extra) == (3, 3, 2, 1, 1)
    assert r.coverage == pytest.approx(2 / 3) and (r.category_match, r.sex_match, r.qty_match) == (0.5, 1.0, 0.5)
    assert r.mape == pytest.approx(0.05) and r.price_within_5pct == 1
    none = evaluation.agreement(ref.limit(0), model.limit(0), ["lot_number"]).first()
    assert (none.coverage, none.mape) == (0.0, None)
    assert tuple(evaluation.set_counts(ref, model, "lot_number").first()) == (2, 1, 1)


def test_totals_and_pivot(spark):
    runs = frame(spark, [("a", "p", "m1", 2.0, 3, 2, 1, 4, 1_000_000, 0, "ok", None), ("b", "p", "m1", 3.0, 1, 0, 1, 1, 0, 1_000_000, "ok", None), ("c", "p", "m1", 9.0, None, None, None, None, None, None, "error", "x")], schemas.RUNS)
    prices = frame(spark, [("m1", 0.1, 0.4)], schemas.PRICES)
    r = evaluation.totals(runs, prices, 5).first()
    assert (r.lots, r.seconds) == (4, 5.0) and r.cost == pytest.approx(0.5) and r.cost_per_video == pytest.approx(0.1)
    by = {x.metric: x.m1 for x in evaluation.by_metric(runs.where("video_id = 'a'"), "model", ["lot_count", "elapsed_seconds"], ["m1"]).collect()}
    assert by == {"lot_count": 3.0, "elapsed_seconds": 2.0}
    grid = evaluation.grid(frame(spark, [("a",), ("z",)], "video_id string"), frame(spark, [("m1",)], "model string"), runs, ["video_id", "model"])
    assert {(g.video_id, g.status) for g in grid.collect()} == {("a", "ok"), ("z", None)}
