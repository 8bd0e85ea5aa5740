"""CSV records found in blocks against a plain reader."""

import csv
import io
import random

import pytest

from ledgerlens.sources import csv_files, csv_split


@pytest.fixture()
def small_blocks(spark):
    """Blocks of a few bytes, so that records and quotes run over many of them."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {n: spark.conf.get(n, None) for n in names}

    def cut(size):
        for name, value in zip(names, (str(size), "1", "1"), strict=True):
            spark.conf.set(name, value)

    yield cut
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


CELLS = ["plain", "", "a,b", 'says "x"', "two\nlines", '"', '""', "\n", "\n\n", 'end"\n', " spaced ", "ñandú €", "x" * 90,
         "l1\nl2\nl3,\",\n", "\r\n", "tab\t"]


def written(rows, line_end="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=line_end, quoting=quoting).writerows(rows)
    return out.getvalue().encode()


def drawn(seed, n=60, width=3):
    draw = random.Random(seed)
    return [[f"{k}"] + [draw.choice(CELLS) for _ in range(width - 1)] for k in range(n)]


@pytest.mark.parametrize(("size", "line_end", "quoting"), [
    (7, "\n", csv.QUOTE_MINIMAL), (64, "\r\n", csv.QUOTE_MINIMAL), (100, "\n", csv.QUOTE_ALL), (1 << 20, "\n", csv.QUOTE_MINIMAL)])
def test_same_rows_as_a_plain_reader(spark, tmp_path, small_blocks, size, line_end, quoting):
    rows = drawn(size)
    data = b"\xef\xbb\xbf" + written([["id", "b \n c", "d"], *rows], line_end, quoting)
    (tmp_path / "f.csv").write_bytes(data)
    small_blocks(size)
    assert csv_split.file_lines(spark, str(tmp_path)).rdd.getNumPartitions() >= min(len(data) // size, 20)
    found = csv_files.read_csv(spark, str(tmp_path), with_order=True).orderBy(*csv_files.FILE_ORDER)
    assert found.columns[:3] == ["id", "b \n c", "d"]
    assert [list(r)[:3] for r in found.collect()] == rows


def test_headers_meet_by_name(spark, tmp_path, small_blocks):
    files = {
        "a.csv": [["uno", "dos"], ["1", "2"], ["3", "4\n4"]],
        "b.csv": [["dos", "tres", "uno"], ["b2", "b3", "b1"], ["solo"]],
        "c.csv": [["uno", "dos"], ["c1", "c2", "beyond"]],
        "d.csv": [["dos", "dos"], ["first", "last"]],
        "e.csv": [["uno", "dos"]],
    }
    for name, rows in files.items():
        (tmp_path / name).write_bytes(written(rows))
    (tmp_path / "f.csv").write_bytes(b"")
    small_blocks(9)
    found = csv_files.read_csv(spark, str(tmp_path))
    assert found.columns == ["uno", "dos", "tres"]
    assert sorted(tuple(r) for r in found.collect()) == sorted([
        ("1", "2", ""), ("3", "4\n4", ""), ("b1", "b2", "b3"), ("", "solo", ""), ("c1", "c2", ""), ("", "last", "")])
    counts = csv_files.csv_row_counts(spark, str(tmp_path)).collect()
    found = {r.path[-5:]: r.row_count for r in counts if r.path[-5:] != "f.csv"}
    assert found == {"a.csv": 2, "b.csv": 2, "c.csv": 1, "d.csv": 1, "e.csv": 0}


def test_quotes_that_open_nothing(spark, tmp_path, small_blocks):
    """A quote in the middle of a bare cell is a letter, as for Spark's own reader."""
    (tmp_path / "f.csv").write_text('a,b\n5" pipe,x\nsay ""hi"",y\n"q",z\n\n"un""closed\nstill"\n')
    small_blocks(5)
    rows = [tuple(r) for r in csv_files.read_csv(spark, str(tmp_path), with_order=True).orderBy("csv_row").select("a", "b").collect()]
    assert rows == [('5" pipe', "x"), ('say ""hi""', "y"), ("q", "z"), ('un"closed\nstill', "")]


def test_maps_of_lines(spark):
    def states(text):
        frame = spark.createDataFrame([(text,)], "text string")
        row = csv_split.with_maps(frame).first()
        return row.out, row.into

    assert states("plain, text") == (False, True)
    assert states('a,"open') == (True, False)
    assert states('"shut",b') == (False, False)
    assert states('in",then') == (False, False)
    assert states('in","again') == (True, True)
    assert states('""') == (False, True)
    assert states('a""') == (False, True)
    assert states('"a""') == (True, False)


@pytest.mark.parametrize("size", [40, 100_000])
def test_counts_of_records_move_no_text(spark, tmp_path, small_blocks, size):
    for seed, line_end in ((1, "\n"), (2, "\r\n"), (3, "\n\n")):
        (tmp_path / f"{seed}.csv").write_bytes(written(drawn(seed), line_end))
    (tmp_path / "open.csv").write_bytes(b'a,b\n1,"never closed\n\n2,x\n')
    (tmp_path / "empty.csv").write_bytes(b"\n\r\n\n")
    small_blocks(size)
    records = csv_split.csv_records(spark, str(tmp_path)).groupBy("file").count().collect()
    counted = csv_split.record_counts(spark, str(tmp_path))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert {(r.file, r.n) for r in counted.collect()} == {(r.file, r["count"]) for r in records}
    assert len(records) == 4
    exchanged = [line for line in plan.splitlines() if "Window" in line or "Sort " in line]
    assert exchanged and not any("text#" in line for line in exchanged)
    assert plan.count("Scan text") == 1


def test_rows_are_not_sorted_for_their_folders(spark, tmp_path):
    """Files of up to OPEN_FILES folders are written side by side; the setting is as before afterwards."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    rows = spark.range(500, numPartitions=2).selectExpr("cast(1990 + id % 100 AS string) AS ano", "id AS k")
    csv_files.write_csv_by_year(rows, str(tmp_path / "years"), ["ano", "k"])
    assert spark.conf.get(key) == before
    # the first folders' rows are as they came, one file for each task and folder
    names = sorted(p.parent.name for p in (tmp_path / "years").rglob("*.csv"))
    assert len(names) == 200 and len(set(names)) == 100
    found = csv_files.csv_row_counts(spark, str(tmp_path / "years")).where("path LIKE '%.csv'").collect()
    assert sum(r.row_count for r in found) == 500


@pytest.mark.parametrize("broken", [False, True])
def test_only_blocks_with_line_breaks_in_cells_are_put_in_order(spark, tmp_path, monkeypatch, broken):
    """Text of files without such breaks is neither stored nor shuffled; with one, its file's is."""
    rows = {name: [[f"{name}{k}", 'says "x"', "a,b"] for k in range(20)] for name in "ab"}
    if broken:
        rows["b"][7][1] = "two\nlines"
    for name, own in rows.items():
        (tmp_path / f"{name}.csv").write_bytes(b"\n" + written([["id", "t", "u"], *own]))
    kept, stored = csv_split.materialize, {}

    def seen(df, what="step"):
        stored[what] = kept(df, what)
        return stored[what]

    monkeypatch.setattr(csv_split, "materialize", seen)
    found = csv_files.read_csv(spark, str(tmp_path))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(list, found.collect())) == sorted(rows["a"] + rows["b"])
    assert "Exchange hashpartitioning" not in text
    assert ("records" in stored) == broken
    if broken:
        assert {r.file.rsplit("/", 1)[1] for r in stored["records"].collect()} == {"b.csv"}
