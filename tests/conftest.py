import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "tests", "4", partitions=4,
        **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


LINES = """
    row_number() OVER (ORDER BY line) AS pos, line.id AS source_id, 'senado' AS fuente,
    'gastos-operacionales-senadores' AS dataset, split(line.month, '-')[0] AS ano,
    CAST(CAST(split(line.month, '-')[1] AS int) AS string) AS mes, line.month AS periodo,
    line.unit AS unidad_ejecutora, line.person AS nombre_completo,
    line.category AS gastos_operacionales, line.amount AS monto,
    concat('https://fuente.test/', line.month) AS source_url,
    concat('raw/', line.month, '.json') AS raw_file, sha2(line.month, 256) AS raw_body_sha256,
    '2025-11-03T08:15:00+00:00' AS fecha_captura_utc"""


@pytest.fixture(scope="session")
def expenses(spark):
    """Expense rows from lines ``id | month | unit | person | category | amount``, in order of ``pos``."""

    def make(text):
        lines = [[cell.strip() for cell in line.split("|")] for line in text.strip().splitlines()]
        named = [(k, *line) for k, line in enumerate(lines)]
        frame = spark.createDataFrame(
            named, "k int, id string, month string, unit string, person string, category string, amount string")
        frame = frame.selectExpr("struct(k, id, month, unit, person, category, amount) AS line")
        return frame.selectExpr(*[c.strip() for c in _columns(LINES)])

    return make


def _columns(text):
    depth, start, out = 0, 0, []
    for at, letter in enumerate(text):
        depth += (letter == "(") - (letter == ")")
        if letter == "," and not depth:
            out.append(text[start:at])
            start = at + 1
    return [*out, text[start:]]
