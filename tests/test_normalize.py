import pytest
from pyspark.sql import functions as F

from ledgerlens import contract as C
from ledgerlens.operators import classify, quality, ranking
from ledgerlens.operators.numbering import number_rows, number_spread
from ledgerlens.plans.normalize import _numbered, normalize

LINES = """
    a1 | 2023-06 | 31 | Berta Soto | TELEFONIA FIJA  | 4000
    a2 | 2023-06 | 31 | Berta Soto | Telefonía fija  | 350
    a3 | 2023-06 | 31 | Berta Soto | TELEFONIA FIJA  | -1200
    a2 | 2023-06 | 31 | Berta Soto | Telefonía fija  | 350
    a4 | 2023-06 | 31 | Berta Soto | TELEFONIA FIJA  | no consta
    a5 | 2023-07 | 44 | Ciro Vega  | DIFUSION        | 0
    a6 | 2023-07 | 44 | Ciro Vega  | DIFUSION        | 90
    a7 | 2023-07 |    | Ciro Vega  |                 | 12"""


@pytest.fixture(scope="module")
def result(expenses):
    return normalize(expenses(LINES), order_by=["pos"], source_path="lines")


def test_spellings_meet_in_one_category(spark):
    cells = {"DIFUSION": "difusion", "Difusión ": "difusion", "SERVICIO NUBE O CLOUD": "servicio_nube_cloud",
             "SERVICIO DE NUBE O CLOUD": "servicio_nube_cloud", "  ": "sin_categoria", "̈": "sin_categoria"}
    df = spark.createDataFrame([(c,) for c in cells], "gastos_operacionales string")
    found = classify.with_category(df).select("categoria_id").collect()
    assert sorted(r[0] for r in found) == sorted(cells.values())


def test_first_matching_status_wins(spark):
    df = spark.sql("""SELECT * FROM VALUES
        (1, true, 'DIFUSION', 'DIFUSION', 8L, 'duplicado'), (2, true, 'NOTA: X', 'NOTA: X', NULL, 'duplicado'),
        (3, false, 'NOTA: X', 'NOTA: X', NULL, 'nota'), (4, false, '$ 20.000', '$ 20.000', NULL, 'monto_en_texto'),
        (5, false, '', '', 7L, 'sin_categoria'), (6, false, 'DIFUSION', 'DIFUSION', NULL, 'sin_monto'),
        (7, false, 'DIFUSION', 'DIFUSION', -1L, 'ajuste'), (8, false, 'DIFUSION', 'DIFUSION', 0L, 'ok'),
        (9, false, '$ 20.000', '$ 20.000', 6L, 'ok')
        t(k, is_duplicate, gastos_operacionales, categoria_key, monto, expected)""")
    found = df.select("k", "expected", classify.row_status().alias("status")).collect()
    assert [(r.k, r.status) for r in found] == [(r.k, r.expected) for r in found]


def test_ranking_counts_what_it_leaves_out(result):
    fixed = result.ranking.where("categoria_id = 'telefonia_fija'").first()
    assert (fixed.total_monto, fixed.registros, fixed["rank"]) == (4350, 2, 1)
    assert (fixed.total_ajustes, fixed.registros_ajuste) == (-1200, 1)
    assert (fixed.registros_sin_monto, fixed.registros_excluidos) == (1, 3)
    assert result.ranking.columns == C.RANKING_COLUMNS and result.clean.columns == C.CLEAN_COLUMNS


def test_report_of_all_parts(result):
    found = result.report.first()
    assert (found.source_rows, found.clean_rows, found.ranking_rows, found.category_rows) == (8, 8, 2, 3)
    assert found.row_status_counts == {
        "ok": 4, "ajuste": 1, "duplicado": 1, "sin_monto": 1, "sin_categoria": 1}
    assert (found.amounts.numeric_rows, found.amounts.zero_rows, found.amounts.negative_total) == (7, 1, -1200)
    assert found.amounts.positive_or_zero_total == 4802
    assert (found.identity.duplicate_source_id_groups, found.identity.missing_unidad_ejecutora_rows) == (1, 1)
    assert [e.source_id for e in found.problem_examples["ajuste"]] == ["a3"]
    assert C.WARN_DUPLICATES in found.warnings


def test_spellings_are_rows_by_count_then_first_seen(result):
    found = ranking.category_spellings(result.variants).where("categoria_id = 'telefonia_fija'")
    assert [(r.position, r.rendered) for r in found.orderBy("position").collect()] == [
        (1, "TELEFONIA FIJA (3)"), (2, "Telefonía fija (2)")]
    assert {r.categoria_id: r.raw_variant_count for r in result.categories.collect()} == {
        "telefonia_fija": 2, "difusion": 1, "sin_categoria": 1}


def test_category_keeps_its_first_name(expenses):
    rows = expenses("""
        x1 | 2022-01 | 5 | Uno | ASEO, Y ORNATO | 10
        x2 | 2022-01 | 6 | Dos | ASEO Y ORNATO  | 20
        x3 | 2022-04 | 5 | Uno | ASEO Y ORNATO  | 30""")
    names = {r.categoria_nombre for r in normalize(rows, order_by=["pos"]).ranking.collect()}
    assert len(names) == 1 and "," in names.pop()


def test_result_does_not_depend_on_partitioning(expenses):
    df = expenses("\n".join(
        f"k{i % 9} | 2022-{1 + i % 5:02d} | {i % 3} | P {i % 3} | Rubro {i % 4} | {i * 3}" for i in range(80)))

    def run(d):
        rows = classify.classify_rows(d, order_by=["pos"])
        return sorted(map(tuple, ranking.category_catalogue(rows, order_by=["pos"]).collect()))

    assert run(df) == run(df.repartition(7, F.rand(3)).sortWithinPartitions(F.desc("pos")))


def test_blank_ids_are_never_duplicates_and_hot_ids_are(expenses):
    df = expenses("\n".join(f"{'' if i % 2 else 'hot'} | 2022-01 | 1 | A | X | 1" for i in range(40)))
    rows = classify.mark_duplicates(df, order_by=["pos"]).collect()
    assert [r.pos for r in rows if not r.is_duplicate and r.source_id] == [1]
    assert sum(r.is_duplicate for r in rows) == 19


def test_names_prefer_mixed_case_then_frequency(spark):
    rows = spark.createDataFrame(
        [("7", "ANA DE LA PAZ")] * 3 + [("7", "Ana De La Paz"), ("8", "EVA"), ("", "José X"), ("9", " ")],
        "unidad_ejecutora string, nombre_completo string")
    names = {r[0]: r[1] for r in classify.name_catalogue(rows, rows.limit(0)).collect()}
    assert names == {
        "senado_unidad_7": "Ana de la Paz", "senado_unidad_8": "Eva", "nombre_jose_x": "José X"}


def test_numbers_match_a_window_with_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 11).cast("string")).alias("g"),
        F.pmod(F.hash("id"), F.lit(50)).alias("v"), "id")
    order = [F.desc("v"), F.asc("id")]
    got = number_rows(df, order, partition_by=["g"], name="n")
    expected = df.selectExpr("*", "row_number() OVER (PARTITION BY g ORDER BY v DESC, id) AS n")
    assert got.exceptAll(expected).isEmpty() and got.count() == 5000
    whole = number_rows(df, ["v", "id"], name="n")
    assert whole.exceptAll(df.selectExpr("*", "row_number() OVER (ORDER BY v, id) AS n")).isEmpty()
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


GOOD = dict(source_rows=70, clean_rows=70, included_in_ranking_rows=51, ranking_rows=9, category_rows=4,
            periods={"count": 6, "missing": []}, extra=0, conflicts=0, statuses={"ok": 51, "nota": 19})


def gate_input(spark, **changes):
    """A report with the fields that the gate reads."""
    v = {**GOOD, **changes}
    schema = (
        "source_rows bigint, clean_rows bigint, included_in_ranking_rows bigint, ranking_rows bigint, "
        "category_rows bigint, periods struct<count: bigint, missing_in_range: array<string>>, "
        "identity struct<duplicate_source_id_extra_rows: bigint, "
        "conflicting_duplicate_source_id_groups: bigint>, row_status_counts map<string, bigint>")
    row = [v[c] for c in list(GOOD)[:5]]
    row += [(v["periods"]["count"], v["periods"]["missing"]), (v["extra"], v["conflicts"]), v["statuses"]]
    return spark.createDataFrame([tuple(row)], schema)


def failures(df, **kw):
    return [r.failure for r in quality.gate_failures(df, **kw).orderBy("position").collect()]


def test_gate(spark):
    gaps = lambda *months: gate_input(spark, periods={"count": 6, "missing": list(months)})
    assert failures(gate_input(spark)) == []
    assert failures(gaps("2019-07")) == []  # before what is published
    assert failures(gaps("2019-07", "2023-02"))[0].endswith("2021-01: 2023-02.")
    assert failures(gaps(*[f"2022-{m:02d}" for m in range(1, 13)]))[0].endswith("2022-10 (+2 mas).")
    assert failures(gate_input(spark, extra=5)) == ["Hay 5 filas duplicadas por source_id."]
    assert "3 grupos" in failures(gate_input(spark, conflicts=3))[0]
    nothing = gate_input(spark, source_rows=0, clean_rows=0, included_in_ranking_rows=0, ranking_rows=0,
                         category_rows=0, periods={"count": 0, "missing": []}, statuses={"nota": 1})
    assert failures(nothing) == [
        C.GATE_NO_SOURCE, C.GATE_NO_INCLUDED, C.GATE_NO_RANKING, C.GATE_NO_CATEGORIES,
        C.GATE_NO_PERIODS, C.GATE_NO_OK]
    assert "2022-00" in failures(gate_input(spark), publication_from="2022-00")[0]
    with pytest.raises(quality.QualityGateError, match="duplicadas"):
        quality.enforce_gate(gate_input(spark, extra=5))
    quality.enforce_gate(gate_input(spark))


@pytest.mark.parametrize("hot_rows", [0, 3, 100])
def test_positions_within_groups(spark, hot_rows):
    from ledgerlens.operators.numbering import number_rows, number_spread

    rows = [(None if k % 9 == 0 else f"g{k % 4}", (k * 37) % 101, k) for k in range(90)]
    frame = spark.createDataFrame(rows, "g string, v int, k int")
    found = number_rows(frame, [F.desc("v"), "k"], partition_by=["g"], name="place", hot_rows=hot_rows)
    places = {}
    for group in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2]))
        places.update({r: n for n, r in enumerate(mine, 1)})
    assert {(r.g, r.v, r.k): r.place for r in found.collect()} == places
    assert found.columns == ["g", "v", "k", "place"]


@pytest.mark.parametrize("most", [0, 1000])
def test_duplicates_few_and_many(spark, most):
    rows = [(f"id{k % 13}" if k % 3 else "", None if k % 5 == 0 else "x", k // 7, -k) for k in range(60)]
    rows += [(f"alone{k}", "y", 1, 100 + k) for k in range(20)]
    frame = spark.createDataFrame(rows, "source_id string, cell string, a int, b int")
    found = {(r.a, r.b): r.dup for r in classify.mark_duplicates(
        frame, order_by=["a", "b"], flag="dup", most=most).collect()}
    seen, expected = set(), {}
    for source_id, _, a, b in sorted(rows, key=lambda r: (r[2], r[3])):
        expected[a, b] = source_id != "" and source_id in seen
        seen.add(source_id)
    assert found == expected and sum(expected.values()) > 20
    groups = {r.source_id: (r.registros, r.conflicting) for r in classify.id_groups(frame, signature=["cell"]).collect()}
    for source_id, (count, conflicting) in groups.items():
        mine = [cell for i, cell, _, _ in rows if i == source_id]
        assert (count, conflicting) == (len(mine), len(set(mine)) > 1)
    assert len(groups) == 13


def test_duplicates_need_no_sort(spark):
    frame = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "source_id string, cell string, k int")
    marked = classify.mark_duplicates(frame, order_by=["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in marked and "SortMergeJoin" not in marked
    groups = classify.id_groups(frame, signature=["cell"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in groups


def test_many_duplicates_take_one_shuffle_of_rows(spark):
    """Repeated ids too many to be broadcast: rows move once, hot and blank ids are dealt by their order."""
    rows = [(None if k % 17 == 0 else "" if k % 5 == 0 else "hot" if k % 2 else f"id{k % 23}", k // 3, -k, "x" * 20)
            for k in range(300)]
    frame = spark.createDataFrame(rows, "source_id string, a int, b int, cell string")
    for hot in (10, 1000):
        marked = classify.mark_duplicates(frame, order_by=["a", "b"], most=0, hot_rows=hot)
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "Aggregate" not in plan
        assert marked.columns == [*frame.columns, "is_duplicate"]
        seen, expected = set(), {}
        for source_id, a, b, _ in sorted(rows, key=lambda r: (r[1], r[2])):
            expected[a, b] = bool(source_id) and source_id in seen
            seen.add(source_id)
        assert {(r.a, r.b): r.is_duplicate for r in marked.collect()} == expected
    # rows whose order key is that of the first are no duplicates of it, on either way
    twice = frame.unionAll(frame)
    flags = [sorted((r.a, r.b, r.is_duplicate) for r in classify.mark_duplicates(
        twice, order_by=["a", "b"], most=most, hot_rows=hot).collect()) for most, hot in ((1000, 10), (0, 10), (0, 1000))]
    assert flags[0] == flags[1] == flags[2]


@pytest.mark.parametrize("hot", [10, 1000])
def test_many_duplicates_get_flags_without_a_shuffle_of_rows(spark, hot):
    """Rows that are numbered, or stored for the time, are flagged from a bitmap; the same rows as ever."""
    rows = [(None if k % 17 == 0 else "" if k % 5 == 0 else "hot" if k % 2 else f"id{k % 23}", None if k % 41 == 0 else k // 3,
             -k, "x" * 20, k * 40_000) for k in range(300)]
    rows += [(f"alone{k}", 1, 100 + k, "y", 1 + k) for k in range(20)]
    frame = spark.createDataFrame(rows, "source_id string, a int, b int, cell string, n bigint").repartition(3)
    shuffled = classify.mark_duplicates(frame, order_by=["a", "b"], most=0, hot_rows=hot)
    expected = sorted((r.b, r.is_duplicate) for r in shuffled.collect())
    assert sum(flag for _, flag in expected) > 100
    for options in ({"store": True}, {"row_id": "n"}):
        marked = classify.mark_duplicates(frame, order_by=["a", "b"], most=0, hot_rows=hot, **options)
        text = marked._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
        assert marked.columns == shuffled.columns
        assert sorted((r.b, r.is_duplicate) for r in marked.collect()) == expected


def test_groups_take_names_without_a_shuffle(spark, expenses):
    """Partial sums are the groups where no order decides; names of categories and entities come to them."""
    rows = classify.classify_rows(expenses(LINES), order_by=["pos"])
    groups = ranking.ranking_groups(rows, classify.name_catalogue(expenses(LINES)), order_by=["pos"])
    text = groups._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
    found = {(r.periodo, r.categoria_id, r.categoria_nombre, r.parlamentario_nombre, r.total_monto, r.registros)
             for r in groups.collect()}
    assert found == {("2023-06", "telefonia_fija", "Telefonia fija", "Berta Soto", 4350, 2),
                     ("2023-07", "difusion", "Difusion", "Ciro Vega", 90, 2)}


def test_cells_of_a_file_stay_behind_when_rows_are_numbered(spark, expenses):
    rows = expenses(LINES).withColumns({
        "fuente": F.when(F.col("pos") % 3 != 0, F.col("fuente")), "raw_file": F.lit(None).cast("string")})
    numbered = _numbered(rows.withColumn("more", F.lit(1)), ["pos"])
    cells = [c for c in rows.columns if c != "pos"]
    assert sorted(numbered.columns) == sorted([*cells, "row_number"])
    expected = [(k, *r) for k, r in enumerate(rows.orderBy("pos").select(*cells).collect(), 1)]
    assert [tuple(r) for r in numbered.orderBy("row_number").select("row_number", *cells).collect()] == expected
    stored = [f for f in numbered.inputFiles() if "/row_number-" in f]
    assert stored and "raw_body_sha256" not in spark.read.parquet(*stored).columns


def test_numbers_of_spread_groups_come_to_the_rows(spark):
    frame = spark.range(400).selectExpr("id % 3 AS g", "id AS v", "'x' AS cell", "-id AS o")
    found = number_spread(frame, ["o"], partition_by=["g"], name="n", keep=["v"])
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    places = {v: sum(1 for w in range(v, 400) if w % 3 == v % 3) for v in range(400)}
    assert found.columns == ["v", "n"] and {r.v: r.n for r in found.collect()} == places
    found = number_rows(frame, ["o"], partition_by=["g"], hot_rows=10, name="n", keep=["g", "v"])
    assert found.columns == ["g", "v", "n"] and {r.v: r.n for r in found.collect()} == places


def test_pages_are_read_once(spark):
    rows = spark.createDataFrame([("2020-01", "a", 1, 3), ("2020-01", "a", 1, 3), ("2020-01", "", 2, None)],
                                 "periodo string, source_id string, page_number int, declared_total int")
    checked = quality.page_reconciliation(rows)
    assert "LocalTableScan" not in checked._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in checked._jdf.queryExecution().executedPlan().toString()
    assert [(r.found_rows, r.blank_ids, r.repeated_ids, r.repeated_examples) for r in checked.collect()] == [(3, 1, 1, "a")]


def test_order_keys_only_where_the_order_decides(spark, expenses):
    """Sums by plain numbers alone, unless a month or a category is spelled in several ways."""
    plain = "a | 2022-01 | 1 | A | Agua | 5\nb | 2022-01 | 1 | A | Agua | 7\nc | 2022-02 | 2 | B | Luz | 1"
    for text, decides in ((plain, False), (plain + "\nd | 2022-01 | 1 | A | Agua. | 2", True)):
        rows = classify.classify_rows(expenses(text), order_by=["pos"])
        partials = ranking.monthly_partials(rows)
        assert ranking.order_decides(partials) == decides
        assert "SortAggregate" not in partials._jdf.queryExecution().executedPlan().toString()
        names = spark.createDataFrame([("senado_unidad_1", "A")], "parlamentario_id string, parlamentario_nombre string")
        found = {(r.periodo, r.categoria_id, r.total_monto, r.ano, r.mes, r.categoria_nombre)
                 for r in ranking.ranking_groups(rows, names, order_by=["pos"]).collect()}
        assert found == {("2022-01", "agua", 12 + 2 * decides, "2022", "1", "Agua"), ("2022-02", "luz", 1, "2022", "2", "Luz")}
    months = expenses(plain).withColumn("mes", F.when(F.col("pos") == 2, "01").otherwise(F.col("mes")))
    rows = classify.classify_rows(months, order_by=["pos"])
    found = ranking.ranking_groups(rows, names, order_by=["pos"]).where("categoria_id = 'agua'").collect()
    assert [(r.total_monto, r.mes) for r in found] == [(12, "01")]
    found = ranking.monthly_aggregate(rows, order_by=["pos"]).where("categoria_id = 'agua'").collect()
    assert [(r.total_monto, r.mes) for r in found] == [(12, "01")]


def test_scratch_goes_with_its_application(spark, monkeypatch):
    from pathlib import Path

    from ledgerlens import session

    monkeypatch.setattr(session, "_scratch_root", lambda spark_: f"{session.shared_root(spark_)}/ledgerlens/mine")
    kept = session.materialize(spark.range(3), "step")
    folder = Path(session.shared_root(spark), "ledgerlens/mine")
    assert kept.count() == 3 and len(list(folder.iterdir())) == 1
    session.drop_scratch(spark)
    assert not folder.exists() and folder.parent.exists()
