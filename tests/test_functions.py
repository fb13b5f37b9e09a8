"""Scalar and JSON column functions, case by case."""

import pytest
from pyspark.sql import functions as F

from sparkyard.functions import jsons as J
from sparkyard.functions import scalars as S


def values(spark, inputs, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", f(F.col("x"))).orderBy("i").collect()]


def json_values(spark, inputs, f):
    return values(spark, inputs, lambda c: f(F.try_parse_json(c)))


def test_price_text(spark):
    given = ["3.100", "3.100,00", "1.800,50", "1.234.567,89", "R$2.500", "R$ 3.100,00", "", "   ", None, "abc", "99,90", "5160.00", "1d", "1e3", "R$"]
    assert values(spark, given, S.price_text) == [3100, 3100, 1800.5, 1234567.89, 2500, 3100, None, None, None, None, 99.9, 516000, None, 1000, None]
    assert values(spark, ["", " ", "R$", "x", "0"], S.price_text_blank) == [True, True, True, False, False]


def test_repair_small(spark):
    assert values(spark, [5.16, 100.0, 0.0, -5.0, 3200.0, 0.05, None], S.repair_small, "double") == [5160, 100, 0, -5, 3200, 50, None]


def test_category(spark):
    given = ["garrotes", "  garrotes  ", "Garrotes", "tourinho", "FÊMEAS", " bois", None]
    assert values(spark, given, S.singular_category) == ["garrote", "garrote", "garrote", "tourinho", "fêmea", "boi", None]


def test_clock_times(spark):
    assert values(spark, [0, 3600, 3661, 7265, 360000], S.hms, "int") == ["00:00:00", "01:00:00", "01:01:01", "02:01:05", "100:00:00"]
    assert values(spark, ["00:00:30", "01:01:01", "x", "1:2", "1:2:3:4", None], S.hms_seconds) == [30, 3661, None, None, 3723, None]
    assert values(spark, ["01:01:01", "1:2:3:4", "1:2", "a:b:c"], S.hms_seconds_strict) == [3661, None, None, None]
    assert values(spark, ["00:01:02.5", "N/A", "", "1:2"], S.progress_seconds) == [62.5, 0, 0, 0]
    assert values(spark, ["00:01:02,250", "10:00:00,000"], S.comma_seconds) == [62.25, 36000]
    assert values(spark, ["20:05:08", "00", "R$ 1.900", " 20:05:08", "26BEZERROS-08M"], S.is_clock) == [True, False, False, False, False]


def test_display(spark):
    assert values(spark, [1234.5, 0.0, 2.675, None], S.money, "double")[:2] == ["R$ 1,234.50", "R$ 0.00"]
    assert values(spark, ["", None, "x"], S.dash) == ["-", "-", "x"]
    assert values(spark, ["á" * 3000, None], lambda c: S.clip(c, 2000)) == ["á" * 2000, ""]
    assert values(spark, [125.9], S.elapsed, "double")[0].asDict() == {"minutes": 2, "seconds": 5}
    assert values(spark, ["  a b  ", "\x1fz", None], S.strip) == ["a b", "z", None]


def test_names(spark):
    name = lambda a, f, n: spark.range(1).select(S.auction_name(*(F.lit(x).cast("string") for x in (a, f, n)))).first()[0]
    assert name("Ana", "Santa Rita", "x") == "Santa Rita"
    assert name("RS Leilões", "", "x") == "RS Leilões"
    assert name("Ana", None, "visto no Canal do Youtube 'Boi Gordo'") == "Boi Gordo"
    assert name("Ana", None, "o leilão 12º da casa") == "leilão 12º"
    assert name("Ana", None, "pela cal leilões") == "CAL LEILÕES"
    assert name("Ana", None, None) == "Ana" and name(None, None, None) is None
    caller = lambda a, n: spark.range(1).select(S.auctioneer_name(*(F.lit(x).cast("string") for x in (a, n)))).first()[0]
    assert caller("Ana", "O leiloeiro mencionado no áudio é João Silva. Fim") == "João Silva"
    assert caller("Ana", "leiloeiro: Zé") == "Zé" and caller("Ana", "nada") == "Ana"
    assert spark.range(1).select(S.first_text(F.lit(""), F.lit("b"), F.lit("c"))).first()[0] == "b"


def test_evidence(spark):
    for text, want in (("LOTE 04", True), ("lote: 004", True), ("x | 4 | y", True), ("| 3 | 4 | 5 |", True), ("LOTE 40", False), ("valote 4", False), ("LOTE 4a", False), ("LOTE | Farm | VALORPORANIMAL | 04", True), ("", False), (None, False)):
        df = spark.createDataFrame([(4, text)], "n int, t string")
        assert df.select(S.has_evidence("n", S.evidenced_lots("t"))).first()[0] is want, text
    df = spark.createDataFrame([(0, "LOTE 00")], "n int, t string")
    assert df.select(S.has_evidence("n", S.evidenced_lots("t"))).first()[0]


def test_urls_and_folders(spark):
    given = ["https://www.youtube.com/watch?v=abc&x=1", "https://youtu.be/xyz?t=3", "https://m.youtube.com/watch?x=1&v=a%2Db", "https://example.com/1", "https://www.youtube.com/live", None]
    assert values(spark, given, S.video_id) == ["abc", "xyz", "a-b", None, None, None]
    assert values(spark, given[:2], S.last_v_id) == ["abc", "https://youtu.be/xyz?t=3"]
    assert values(spark, ["a b/c", "..", "", "Leilão 1.", None], S.safe_folder) == ["a-b-c", "batch", "batch", "Leilão-1", "batch"]
    assert values(spark, ["a/b:c"], S.model_folder) == ["a_b_c"]


def test_strict_json(spark):
    given = ["[1]", " [1] ", "[1] x", "1,2", "1]", '1}, "y": {', "", None, "{", '"a"', "null", "[1", '{"a": 1} {"b": 2}', "tru", "{}"]
    good = [r is not None for r in values(spark, given, lambda c: J.strict_json(c).cast("string"))]
    kinds = json_values(spark, ["[1]", "1", "1.5", "1e3", '"a"', "true", "null", "{}"], J.kind)
    assert kinds == ["ARRAY", "BIGINT", "DECIMAL", "DOUBLE", "STRING", "BOOLEAN", "VOID", "OBJECT"]
    assert good == [True, True, False, False, False, False, False, False, False, True, False, False, False, False, True]


def test_array_and_object_of(spark):
    given = ["[1,2]", "text [1,2] more", '[{"n": "a]b"}]', 'x [{"n": "a]b"}]', "[note] then [1]", '{"lots":[1,2]}', "not json", "", None]
    got = values(spark, given, lambda c: F.size(J.items(J.array_of(c))))
    assert [None if x in (None, -1) else x for x in got] == [2, 2, 1, None, None, 2, None, None, None]
    assert [x is not None for x in values(spark, ['a {"x": 1} b', '{"a":1} and {"b":2}', "none", '{"a": {"b": 1}}'], lambda c: J.object_of(c).cast("string"))] == [True, False, False, True]


@pytest.mark.parametrize(
    "f,given,want",
    [
        (J.lax_int, ["12", "12.0", '"12"', '" 12 "', '"012"', '"12.0"', '"1_0"', "true", "12.5", '"12.5"', '"abc"', '""', "[]", "{}", "null"], [12, 12, 12, 12, 12, 12, 10, 1] + [None] * 7),
        (J.lax_text, ['"a"', '" b "', '""', "1", "true", "[]", "null"], ["a", " b ", "", None, None, None, None]),
        (J.lax_bool, ["true", "false", "0", "1", "1.0", '"1"', '"TRUE"', '"yes"', '"Off"', "2", '"sim"', '""', '"12"', "null"], [True, False, False, True, True, True, True, True, False] + [None] * 5),
        (J.lax_price, ["3200", "5.16", '"3.100,00"', "true", '"abc"', "[]", "null", '"50"', "0.05"], [3200, 5160, 3100, 1000, None, None, None, 50, 50]),
        (J.price_error, ['"abc"', "[]", "{}", "null", '""', "1", '"3.100"'], [True, True, True, False, False, False, False]),
        (J.truthy, ["true", "false", '"false"', '""', "0", "2", "null", "[]", "[1]", "{}"], [True, False, True, False, False, True, False, False, True, False]),
    ],
)
def test_lax_readers(spark, f, given, want):
    assert json_values(spark, given, f) == want


def test_token_cost(spark):
    df = spark.createDataFrame([(2_000_000, 500_000, 0.1, 0.4)], "i long, o long, pi double, po double")
    assert df.select(S.token_cost("i", "o", "pi", "po")).first()[0] == pytest.approx(0.4)
