import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import casts as K
from ledgerlens.functions import text as X

SAMPLES = [
    "", "  ", "TRASLACIÓN", " a  b﻿ c ", "O'HIGGINS DE LA CRUZ 2ND", "한글 abc",
    "PEÑA Y LILLO", "juan De La Torre", "A SENADORES", "DISEÑO Y DESARROLLO PAG. WEB",
    "ΑΣ ΣΑΣ", "é́x", "\x1c\x1dA\x85B", "ো a", "\U0001f600 á",
    "́", "Kelvin",
]


def squeeze(v):
    return " ".join(v.replace("﻿", "").split())


def no_marks(v):
    return "".join(
        ch for ch in unicodedata.normalize("NFD", squeeze(v)) if unicodedata.category(ch) != "Mn")


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x string")


def column(spark, values, expression):
    return [r[0] for r in frame(spark, values).coalesce(1).select(expression).collect()]


def test_cells_follow_unicode_rules(spark):
    assert column(spark, SAMPLES, X.clean_cell("x")) == [squeeze(v) for v in SAMPLES]
    assert column(spark, SAMPLES, X.normalize_ascii("x")) == [no_marks(v) for v in SAMPLES]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(
    codec="utf-8", exclude_categories=["Cs", "Cn", "Co"]), max_size=12), min_size=40, max_size=60))
def test_cells_on_random_text(spark, values):
    # Compared where this Python and the JVM know the same characters.
    values = [v for v in values if all(ord(ch) < 0x10000 for ch in v)]
    assert column(spark, values, X.clean_cell("x")) == [squeeze(v) for v in values]
    assert column(spark, values, X.normalize_ascii("x")) == [no_marks(v) for v in values]


def test_slug_key_and_names(spark):
    assert column(spark, ["Café / Té", "中文", ""], X.slugify("x")) == [
        "cafe_te", "sin_valor", "sin_valor"]
    assert column(spark, ["Diseño y desarrollo pag.web", "TRASLACION  SENADORES"],
                  X.category_key("x")) == ["DISENO Y DESARROLLO PAGINA WEB", "TRASLACION"]
    assert column(spark, ["O'HIGGINS DE LA CRUZ 2ND", "Ana De La Paz", "ana y eva"],
                  X.display_person_name("x")) == [
        "O'Higgins de la Cruz 2Nd", "Ana de la Paz", "ana y eva"]
    assert column(spark, ["ABC DEF"], X.sentence_case("x")) == ["Abc def"]


def test_amounts(spark):
    values = ["100", "-10", "", "1.000", "+5", " 7 ", "9223372036854775808", "٣", "5\n"]
    assert column(spark, values, X.parse_amount("x")) == [
        100, -10, None, None, None, 7, None, 3, 5]


def test_lenient_casts(spark):
    values = ["1", " 12 ", "1e3", "1.9", "-1.9", "nan", "inf", "1d", "0x10", "1_000", "", None]
    assert column(spark, values, K.lenient_int("x")) == [
        1, 12, 1000, 1, -1, None, None, None, None, 1000, None, None]
    assert column(spark, ["TRUE", " Si", "1", "yes", "no", None], K.lenient_bool("x")) == [
        True, True, True, True, False, False]


def test_average_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame(
        [(7, 2), (-7, 2), (5, 3), (-4, 3), (0, 4), (1, 0), (9223372036854775807, 2)],
        "s bigint, n bigint")
    assert [r[0] for r in df.coalesce(1).select(K.rounded_ratio("s", "n")).collect()] == [
        4, -4, 2, -1, 0, None, 4611686018427387904]


def test_search_keeps_wildcards(spark):
    values = ["Ana", "a%a", "ab", "x%", "50"]
    found = lambda q: [r.x for r in frame(spark, values).where(X.contains_ci("x", q)).collect()]
    assert found("ANA") == ["Ana"]
    assert sorted(found("a_a")) == ["Ana", "a%a"]
    assert found("a\\b") == ["ab"]
    assert found("x\\") == ["x%"]
    assert sorted(found("\\%")) == ["a%a", "x%"]


def test_manifest_paths(spark):
    df = frame(spark, ["data\\raw\\a.json", "file:///base/data/raw/a.json", "./data//raw/a.json"])
    assert {r[0] for r in df.select(X.manifest_path("x", "/base")).collect()} == {
        "data/raw/a.json"}


def test_full_name(spark):
    df = spark.createDataFrame([(" Ana ", "", None), ("Ana", "Paz", "Diaz ")], "a string, b string, c string")
    assert [r[0] for r in df.coalesce(1).select(X.full_name("a", "b", "c")).collect()] == [
        "Ana", "Ana Paz Diaz"]


def test_outlined_branches_use_no_python(spark):
    plan = frame(spark, ["a"]).select(X.category_key("x"), X.slugify("x")).select(F.lit(1))
    assert "Python" not in plan._jdf.queryExecution().toString()


def test_long_texts_are_whole(spark):
    n = 200_000
    df = spark.range(1).select(
        F.expr(f"repeat('ab ', {n})").alias("plain"), F.expr(f"repeat('ÁB ', {n})").alias("marked"))
    row = df.select(
        F.length(X.clean_cell("plain")), F.length(X.slugify("marked")),
        F.length(X.display_person_name("marked"))).first()
    assert tuple(row) == (3 * n - 1, 3 * n - 1, 3 * n - 1)
