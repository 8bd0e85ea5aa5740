"""Registered queries against their SQL at the smallest scale, and plan checks."""

import duckdb
import pytest

from ledgerlens.operators import classify
from workload import facade as A
from workload.oracles import ORACLES
from workload import queries as Q
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    found = sql.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
    theirs = sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in found.fetchall())
    assert ours == theirs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_served_queries_prune_and_push(spark):
    """Months, categories and entities are filters of the scan, loads are pruned, nothing is joined twice."""
    expected = {
        "entity_ranking": ["GreaterThanOrEqual(periodo,1996-03)", "LessThanOrEqual(periodo,2000-10)",
                           "EqualTo(categoria_id,promo)"],
        "entity_lookup": ["EqualTo(parlamentario_id,senado_unidad_7)", "GreaterThanOrEqual(periodo,1996-01)"],
        "entity_categories": ["EqualTo(parlamentario_id,senado_unidad_7)", "LessThanOrEqual(periodo,2000-12)"],
        "entity_periods": ["EqualTo(parlamentario_id,senado_unidad_7)", "GreaterThanOrEqual(periodo,1996-05)"],
        "period_summary": ["GreaterThan(registros,0)"]}
    for name, filters in expected.items():
        text = QUERIES[name](spark, SF)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        scan = next(part for part in text.split("\n\n") if "/ranking" in part and "PushedFilters" in part)
        assert all(f in scan for f in filters), (name, scan)
        assert "PartitionFilters" in scan and "dynamicpruning" in scan
        assert text.count("/ranking]") <= 1


def test_orders_of_served_rows(spark, sql):
    """Row order itself, which the comparison by sorted rows does not see."""
    for name, order in (
            ("entity_ranking", "promedio_mensual DESC, parlamentario_nombre, parlamentario_id"),
            ("top_categories", "total_monto DESC, categoria_id"), ("newest_periods", "periodo DESC"),
            ("entity_categories", "total_monto DESC, categoria_id"), ("entity_periods", "periodo DESC")):
        df = QUERIES[name](spark, SF)
        columns = ", ".join(df.columns)
        theirs = sql.execute(f"SELECT {columns} FROM ({ORACLES[name]}) ORDER BY {order}").fetchall()
        assert [tuple(r) for r in df.collect()] == theirs, name


def test_plans(spark):
    search = plan(QUERIES["search_entities"](spark, SF))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in search
    assert "c_acctbal" not in search
    examples = plan(QUERIES["problem_examples"](spark, SF))
    assert "WindowGroupLimit" in examples
    latest = plan(QUERIES["latest_run"](spark, SF))
    assert "TakeOrderedAndProject" in latest and "PushedFilters" in latest
    for name in ("status_histogram", "run_upsert", "name_catalogue", "fact_rule_violations"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "Python" not in text
        assert "NestedLoop" not in text
    assert A.ORDER[0] in plan(QUERIES["row_numbers"](spark, SF))


def _twice_in_files(spark, folder):
    """Line items in several files, with ids, whole rows and parts that come more than once, and nulls."""
    lines = [
        "CAST(if(id % 31 = 0, null, id % 40) AS bigint) AS l_orderkey",
        "CAST(if(id % 37 = 0, null, id % 7) AS bigint) AS l_partkey", "CAST(id % 11 AS bigint) AS l_suppkey",
        "CAST(1 + id % 5 AS int) AS l_linenumber", "CAST(1 + id % 8 AS double) AS l_quantity",
        "CAST(if(id % 29 = 0, null, 100 - id % 90) AS double) AS l_extendedprice",
        "if(id % 3 = 0, 'R', 'N') AS l_returnflag",
        "timestamp'1996-01-01' + make_interval(0, 0, 0, int(id % 300)) AS l_shipdate"]
    rows = spark.range(400).selectExpr(*lines)
    rows.unionAll(rows.limit(60)).repartition(5).write.parquet(f"{folder}/lineitem.parquet")
    parts = spark.sql("SELECT * FROM VALUES (1L, 'SMALL'), (1L, 'LARGE'), (2L, 'PROMO') t(p_partkey, p_type)")
    parts.write.parquet(f"{folder}/part.parquet")
    spark.range(9).selectExpr("id AS s_suppkey", "concat('Supplier#', id) AS s_name").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def test_lines_have_numbers_of_their_own_at_every_reading(spark, tmp_path):
    lines = A.numbered_lines(spark, _twice_in_files(spark, tmp_path))
    assert sorted(r[0] for r in lines.select(A.LINE_ID).collect()) == list(range(460))
    first, again = ({r[A.LINE_ID]: tuple(r) for r in d.collect()} for d in (lines, lines.repartition(3)))
    assert first == again


@pytest.mark.parametrize("name", ["problem_examples", "classified_rows"])
def test_many_repeated_ids_are_flagged_without_storing_rows(spark, tmp_path, monkeypatch, name):
    """The rows are as where few ids repeat, are stored nowhere, and ids are read without the parts."""
    sf = _twice_in_files(spark, tmp_path)
    few = sorted(map(repr, QUERIES[name](spark, sf).collect()))
    kept, plans = classify.materialize, {}

    def seen(df, what="step"):
        plans[what] = plan(df)
        return kept(df, what)

    monkeypatch.setattr(classify, "materialize", seen)
    monkeypatch.setitem(classify.mark_duplicates.__kwdefaults__, "most", 0)
    many = sorted(map(repr, QUERIES[name](spark, sf).collect()))
    assert many == few and any("duplicado" in r for r in many)
    assert "rows" not in plans and "bits" in plans
    assert not any("p_partkey" in text for text in plans.values())


def test_landed_pages_are_packed(spark):
    """Pages name every field of every item: what lies on disk is a small part of their text."""
    landing = Q._land_envelopes(spark, SF)
    on_disk = spark.read.format("binaryFile").load(landing).selectExpr("sum(length) AS n").first().n
    text = spark.read.text(landing).selectExpr("sum(octet_length(value)) AS n").first().n
    assert 0 < on_disk < text / 4


def test_rule_counts_unfold_no_row(spark):
    """Rules of millions of rows are counted in one aggregate; what is unfolded is one row of counts."""
    text = plan(QUERIES["fact_rule_violations"](spark, SF))
    assert "Generate" in text and text.index("Generate") < text.index("HashAggregate")
    assert "Exchange hashpartitioning" not in text
