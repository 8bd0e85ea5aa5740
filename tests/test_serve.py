import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlens.functions.periods import usable_period_range
from ledgerlens.operators import digests, lineage, registry
from ledgerlens.operators.quality import QualityGateError
from ledgerlens.plans import normalize, publish, serve, store
from ledgerlens.session import materialize
from ledgerlens.sources import csv_files, shared_files
from workload import queries


@pytest.fixture(scope="module")
def ranking(spark):
    return spark.sql("""SELECT * FROM VALUES
        ('2024-01', '2024', '1', 'a', 'A', 'e1', 'Ñandu', 100L, 2L),
        ('2024-02', '2024', '2', 'a', 'A', 'e1', 'Ñandu', 51L, 1L),
        ('2024-02', '2024', '2', 'b', 'B', 'e1', 'Ñandu', 10L, 1L),
        ('2024-02', '2024', '2', 'a', 'Z', 'e2', 'Nora', 81L, 1L),
        ('2020-12', '2020', '12', 'a', 'A', 'e2', 'Nora', 5L, 1L),
        ('2024-03', '2024', '3', 'a', 'A', 'e3', 'Oto', 81L, 0L)
        r(periodo, ano, mes, categoria_id, categoria_nombre, parlamentario_id,
          parlamentario_nombre, total_monto, registros)""")


def test_summary_and_filters(ranking):
    view = serve.published(ranking)
    rows = {r.parlamentario_id: r for r in serve.entity_summary(view).collect()}
    assert set(rows) == {"e1", "e2"}
    assert (rows["e1"].total_monto, rows["e1"].meses_con_datos, rows["e1"].promedio_mensual) == (161, 2, 81)
    filtered = serve.filtered_entity_summary(
        view, category_id="a", period_from="", period_to=None, search="ñAN").collect()
    assert [(r.parlamentario_id, r.total_monto, r.promedio_mensual) for r in filtered] == [("e1", 151, 76)]


def test_order_uses_spanish_collation(ranking):
    s = serve.entity_summary(serve.published(ranking))
    assert [r.parlamentario_id for r in serve.sort_summaries(s).collect()] == ["e2", "e1"]
    assert [r.parlamentario_id for r in serve.sort_summaries(s, "nombre", "asc").collect()] == ["e2", "e1"]
    assert [r.parlamentario_id for r in serve.sort_summaries(s, "nombre", "desc").collect()] == ["e1", "e2"]
    placed = serve.summary_positions(s, "total_monto", "desc").orderBy("position").collect()
    assert [(r.position, r.parlamentario_id) for r in placed] == [(1, "e1"), (2, "e2")]


def test_small_reports(ranking):
    view = serve.published(ranking)
    assert tuple(serve.period_range(view).first()) == ("2024-01", "2024-02")
    assert tuple(serve.effective_range(view, "2023-01", None).first()) == ("2023-01", "2024-02")
    assert tuple(serve.effective_range(view.limit(0)).first()) == ("", "")
    top = serve.categories_by_total(view, 1).collect()
    assert [(r.categoria_id, r.categoria_nombre, r.parlamentarios) for r in top] == [("a", "A", 2)]
    assert [r.periodo for r in serve.newest_periods(view, 1).collect()] == ["2024-02"]
    assert [r.categorias for r in serve.entity_periods(view, "e1").collect()] == [2, 1]
    assert [r.categoria_id for r in serve.entity_categories(view, "e1").collect()] == ["a", "b"]
    totals = serve.headline_totals(serve.entity_summary(view)).first()
    assert tuple(totals) == (242, 5, 2)
    assert serve.headline_totals(serve.entity_summary(view.limit(0))).first().total_monto == 0
    shares = {r.parlamentario_id: r.share for r in serve.share_of_max(serve.entity_summary(view)).collect()}
    assert shares == {"e1": 100.0, "e2": 100.0}


def test_lookup(ranking):
    assert serve.entity_lookup(ranking, "none").count() == 0
    assert serve.entity_lookup(ranking, "e1").first().registros == 4
    two = ranking.withColumn("parlamentario_nombre", F.concat("parlamentario_nombre", "periodo"))
    with pytest.raises(PySparkException, match="more than one"):
        serve.entity_lookup(two, "e1").collect()


def test_period_bounds():
    assert usable_period_range("2024-05", "2023-01") == ("2023-01", "2024-05")
    assert usable_period_range("2024-13", "2023-01") == (None, "2023-01")


def test_latest_and_rollback(spark):
    runs = spark.sql("""SELECT * FROM VALUES
        (1L, 'd', 'r1', '2024-01-01', 'ok'), (2L, 'd', 'r2', '2024-02-01', 'ok'),
        (3L, 'd', 'r3', '2024-02-01', 'ok'), (4L, 'd', 'r4', '2024-03-01', 'error')
        t(id, dataset, run_id, generated_at_utc, status)""")
    assert registry.latest_run(runs, "d").first().run_id == "r3"
    assert registry.latest_runs(runs).first().run_id == "r3"
    offsets = spark.sql("""SELECT * FROM VALUES
        (1L, 'd', 'late', '2026-01-01T23:00:00-03:00', 'ok'), (2L, 'd', 'early', '2026-01-02T00:00:00+00:00', 'ok'),
        (3L, 'd', 'none', 'no time', 'ok') t(id, dataset, run_id, generated_at_utc, status)""")
    assert registry.latest_run(offsets, "d").first().run_id == "late"
    assert registry.latest_runs(offsets).first().run_id == "late"
    change = spark.sql("SELECT 'r3' run_id, 'error' status")
    assert registry.latest_run(registry.set_run_status(runs, change), "d").first().run_id == "r2"


def manifest(spark, run_id, rows):
    key = f"senado/gastos_operacionales/runs/{run_id}/pipeline_manifest.json"
    return spark.sql(f"""SELECT 'senado_gastos_operacionales' dataset, '{run_id}' run_id,
        '2026-01-0{run_id[-1]}T00:00:00+00:00' generated_at_utc, '2025-01' period_from, '2025-02' period_to,
        '{key}' r2_manifest_key, 'https://x.example/{key}' public_manifest_url,
        array(named_struct('name', 'clean', 'row_count', {rows}L),
              named_struct('name', 'ranking_mensual', 'row_count', 1L)) output_files""")


def two_runs(expenses):
    one = normalize.normalize(expenses("""
        1 | 2025-01 | 7 | Uno | TRASLACION | 100
        2 | 2025-02 | 8 | Dos | DIFUSION   | 40"""), order_by=["pos"])
    two = normalize.normalize(
        expenses("1 | 2025-01 | 7 | Uno | TRASLACION | 900"), order_by=["pos"])
    return one, two


def unharmed(spark):
    return spark.range(0).selectExpr("'' AS rule")


def served(version):
    view = serve.published(version.latest("ranking"))
    return {r.parlamentario_id: r.total_monto for r in serve.entity_summary(view).collect()}


def test_load_and_serve(spark, expenses, tmp_path):
    root = str(tmp_path / "store")
    one, two = two_runs(expenses)

    def load(run_id, rows, result):
        return publish.load_run(manifest(spark, run_id, rows), result.clean, result.ranking, unharmed(spark),
                                store=root, run_id=run_id)

    first = load("r1", 2, one)
    load("r2", 1, two)
    third = load("r1", 2, one)
    assert served(third) == {"senado_unidad_7": 900}
    assert served(first) == {"senado_unidad_7": 100, "senado_unidad_8": 40}  # an older version stays readable
    assert third.number == 3 and third.table("facts").count() == 3
    assert sorted(map(tuple, third.runs.select("id", "run_id").collect())) == [(1, "r1"), (2, "r2")]

    back = publish.change_status(spark, root, spark.sql("SELECT 'r2' run_id, 'error' status"))
    assert served(back) == {"senado_unidad_7": 100, "senado_unidad_8": 40}
    assert serve.latest_facts(back.table("facts"), back.runs).count() == 2
    plan = back.latest("ranking")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()

    broken = one.clean.withColumn("periodo", F.lit("2025-13"))
    with pytest.raises(publish.LoadError, match="period_format"):
        publish.load_run(manifest(spark, "r3", 2), broken, one.ranking, unharmed(spark), store=root, run_id="r3")
    changed = spark.sql("SELECT 'changed_part' AS rule")
    with pytest.raises(publish.LoadError, match="changed_part"):
        publish.load_run(manifest(spark, "r1", 2), one.clean, one.ranking, changed, store=root, run_id="r1")
    for run_id, frame, rule in (
            ("r9", manifest(spark, "r1", 2), "run_id_agreement"),
            ("r1", manifest(spark, "r1", 999), "row_count"),
            ("r1", manifest(spark, "r1", 2).withColumn("period_from", F.lit("2024-99")), "period_from")):
        with pytest.raises(publish.LoadError, match=rule):
            publish.load_run(frame, one.clean, one.ranking, unharmed(spark), store=root, run_id=run_id)
    assert store.read_version(spark, root).number == back.number  # refused loads make no version
    empty = publish.load_run(manifest(spark, "r1", 0), one.clean.limit(0), one.ranking.limit(0), unharmed(spark),
                             store=root, run_id="r1")
    assert empty.table("facts").where("run_id = 'r1'").count() == 0
    assert empty.table("facts").count() == 1


def some_runs(spark, *ids):
    rows = ", ".join(f"'{i}'" for i in ids)
    return spark.sql(f"SELECT CAST(null AS bigint) AS id, 'd' AS dataset, run_id, 'ok' AS status "
                     f"FROM (SELECT explode(array({rows})) AS run_id)")


def test_writers_at_one_time(spark, tmp_path, monkeypatch):
    """Another writer commits between a writer's last look and its own commit."""
    root = str(tmp_path / "store")

    def rows(run_id, amount):
        return {"facts": spark.createDataFrame([(run_id, "2025-01", amount)], "run_id string, periodo string, monto bigint")}

    def total(version):
        return {r.run_id: r.monto for r in version.table("facts").collect()}

    begun = store.read_version(spark, root)
    base = store.commit(begun, some_runs(spark, "a"), store.stage(rows("a", 1), root))
    with pytest.raises(store.LoadConflict, match="a"):  # a first load of the same run, begun before it was there
        store.commit(begun, some_runs(spark, "a"), store.stage(rows("a", 7), root))

    create, others = shared_files.create_new, [("b", 2), ("c", 3)]

    def late(spark_, address, text):
        if others and address.endswith(".json"):
            run_id, amount = others.pop()
            monkeypatch.setattr(shared_files, "create_new", create)
            store.commit(store.read_version(spark, root), some_runs(spark, run_id), store.stage(rows(run_id, amount), root))
            monkeypatch.setattr(shared_files, "create_new", late if others else create)
        return create(spark_, address, text)

    monkeypatch.setattr(shared_files, "create_new", late)
    mine = store.commit(base, some_runs(spark, "d"), store.stage(rows("d", 4), root))
    assert mine.number == 4 and total(mine) == {"a": 1, "b": 2, "c": 3, "d": 4}
    assert sorted(r.id for r in mine.runs.collect()) == [1, 2, 3, 4]

    new = store.commit(mine, some_runs(spark, "a"), store.stage(rows("a", 10), root))
    with pytest.raises(store.LoadConflict):
        store.commit(mine, some_runs(spark, "a", "e"), store.stage(rows("a", 99), root))
    assert total(store.read_version(spark, root)) == {"a": 10, "b": 2, "c": 3, "d": 4}
    assert total(mine)["a"] == 1

    assert store.drop_old(spark, root, ["facts"], grace_s=3600) == 0
    assert store.drop_old(spark, root, ["facts"], grace_s=-5) > 0
    assert len(list((tmp_path / "store/facts").iterdir())) == 4  # the loads of a, b, c and d
    assert total(store.read_version(spark, root)) == total(new)


def test_create_new(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    address = str(tmp_path / "deep/marker.json")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: shared_files.create_new(spark, address, f"writer {k}"), range(16)))
    assert won.count(True) == 1
    assert shared_files.read_text(spark, address) == f"writer {won.index(True)}"
    assert [e.name for e in shared_files.children(spark, str(tmp_path / "deep"))] == ["marker.json"]
    assert shared_files.children(spark, str(tmp_path / "none")) == []


def test_publish_and_load_from_files(spark, expenses, tmp_path):
    root, loaded = str(tmp_path / "pub"), str(tmp_path / "store")
    one, _ = two_runs(expenses)
    header = manifest(spark, "r1", 2).drop("output_files").first().asDict()
    inputs = spark.sql("SELECT 'in' AS name, 'in.csv' AS local_path")
    base = tmp_path / "pub/senado/gastos_operacionales"
    half = base / "runs/r1/attempt-half/processed/clean"
    half.mkdir(parents=True)  # of a publisher that died
    (half / "part.csv").write_text("junk\n")
    with pytest.raises(publish.LoadError, match="not published"):
        publish.load_published(spark, root, "r1", store=loaded)
    said = publish.publish(one, header, inputs, root=root, run_id="r1")
    assert {n: o["row_count"] for n, o in said["outputs"].items()} == {
        "clean": 2, "ranking_mensual": 2, "categorias": 2, "categorias_variantes": 2}
    files = {p: p.stat().st_mtime_ns for p in (base / "runs/r1").rglob("*") if p.is_file()}
    again = publish.publish(two_runs(expenses)[1], header, inputs, root=root, run_id="r1")
    assert again == said
    assert files == {p: p.stat().st_mtime_ns for p in (base / "runs/r1").rglob("*") if p.is_file()}
    assert csv_files.read_csv(spark, str(base / "latest/clean")).count() == 2
    assert spark.read.json(str(base / "latest/quality")).first().clean_rows == 2
    assert publish.drop_unfinished(spark, str(base / "runs/r1"), grace_s=-5) == 1 and not half.exists()

    assert served(publish.load_published(spark, root, "r1", store=loaded)) == {
        "senado_unidad_7": 100, "senado_unidad_8": 40}
    part = next(p for p in (base / "runs/r1").rglob("processed/clean/*.csv") if p.stat().st_size > 500)
    part.write_bytes(part.read_bytes().replace(b"TRASLACION", b"TRASLACIOM"))
    (part.parent / f".{part.name}.crc").unlink()  # the local file system's own check
    with pytest.raises(publish.LoadError, match="changed_part"):
        publish.load_published(spark, root, "r1", store=loaded)
    with pytest.raises(QualityGateError):
        publish.publish(normalize.normalize(expenses("1 | 2025-01 | 7 | Uno | NOTA: x | "), order_by=["pos"]),
                        header, inputs, root=root, run_id="r2")
    assert not (base / "runs/r2").exists()


def test_two_publishers(spark, tmp_path):
    """Whoever finishes first wins; the other's files go."""
    folder = str(tmp_path / "run")

    def slow(attempt):
        (tmp_path / "run").mkdir(exist_ok=True)
        publish.once(spark, folder, lambda a: write(a, "quick"))
        return write(attempt, "slow")

    def write(attempt, name):
        spark.range(1).write.parquet(f"{attempt}/rows")
        return {"by": name}

    assert publish.once(spark, folder, slow)["by"] == "quick"
    assert sorted(p.name[:8] for p in (tmp_path / "run").iterdir() if not p.name.startswith(".")) == ["attempt-", "finished"]


def test_archive_keeps_bytes(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    bodies = {"a.json": b'{"x": 1}\r\n\xef\xbb\xbf', "b c.bin": bytes(range(256)) * 9, "d.json": b"\n"}
    for name, data in bodies.items():
        (raw / name).write_bytes(data)
    records = lineage.file_fingerprints(spark, str(raw))
    records = spark.createDataFrame(records.collect(), records.schema)
    said = publish.archive_raw(spark, str(raw), records, str(tmp_path / "pub"), "r1")
    assert said["files"] == 3
    kept = spark.read.parquet(f"{said['folder']}/files")
    assert {r.raw_file.rsplit("/", 1)[1]: bytes(r.content) for r in kept.collect()} == bodies
    (raw / "a.json").write_bytes(b"changed")
    assert publish.archive_raw(spark, str(raw), records, str(tmp_path / "pub"), "r1") == said
    with pytest.raises(publish.PublishError, match="other_bytes"):
        publish.archive_raw(spark, str(raw), records, str(tmp_path / "pub"), "r2")
    (raw / "a.json").unlink()
    with pytest.raises(publish.PublishError, match="not_archived"):
        publish.archive_raw(spark, str(raw), records, str(tmp_path / "pub"), "r2")


def test_archived_files_are_read_few_at_a_time(spark, tmp_path, monkeypatch):
    """Row groups of an archive are bounded in bytes: a reader holds a whole one."""
    raw = tmp_path / "raw"
    raw.mkdir()
    draw = random.Random(1)
    for k in range(12):
        (raw / f"{k}.json").write_bytes(draw.randbytes(1 << 18))
    monkeypatch.setattr(publish, "ARCHIVE_GROUP_BYTES", 1 << 19)
    records = materialize(lineage.file_fingerprints(spark, str(raw)), "records")
    said = publish.archive_raw(spark, str(raw), records, str(tmp_path / "pub"), "r1")
    groups = []
    for part in Path(said["folder"], "files").glob("*.parquet"):
        kept = pq.ParquetFile(part).metadata
        groups += [kept.row_group(g).num_rows for g in range(kept.num_row_groups)]
    assert sum(groups) == said["files"] == 12 and max(groups) <= 2


def test_landed_pages_are_many_files(spark, monkeypatch):
    """API pages are landed in files of a bounded number of pages."""
    monkeypatch.setattr(queries, "LANDED_PAGES", 2)
    path = queries._land_envelopes(spark, "/root/testdata/sf0.001")
    pages = [r.n for r in spark.read.text(path).groupBy("_metadata.file_path").agg(F.count("*").alias("n")).collect()]
    assert sum(pages) > 80 and max(pages) <= 2


def test_digests_do_not_depend_on_files(spark):
    rows = [(k % 7, None if k % 5 == 0 else f"t{k % 11}", k / 2) for k in range(100)]
    frame = spark.createDataFrame(rows, "a int, b string, c double")
    one = digests.table_digest(frame).first()
    assert one.row_count == 100
    assert digests.table_digest(frame.repartition(7, "b").orderBy("c")).first() == one
    for other in (frame.limit(99), frame.unionAll(frame.limit(1)), frame.withColumn("b", F.coalesce("b", F.lit("")))):
        assert digests.table_digest(other).first().digest != one.digest
    shifted = spark.sql("SELECT 'x' AS a, cast(null AS string) AS b")
    assert digests.table_digest(shifted).first() != digests.table_digest(shifted.select(
        F.col("b").alias("a"), F.col("a").alias("b"))).first()
    assert digests.table_digest(frame.limit(0)).first().row_count == 0
    by_key = {r.a: r.digest for r in digests.table_digest(frame, "a").collect()}
    assert by_key[3] == digests.table_digest(frame.where("a = 3").drop("a")).first().digest
