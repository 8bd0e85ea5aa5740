"""The driver's tables shaped like the spending tables, for Spark and for SQL.

Expenses are line items: one row per line, order key over six columns, ids that
repeat by themselves.  Orders stand in for the run registry, suppliers for entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import contract as C
from ledgerlens.operators.numbering import number_by_file

ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
LINE_ID = "line_id"
_SOURCE_ID = """CASE WHEN l_orderkey % 97 = 0 THEN ''
            ELSE concat(l_orderkey, '-', l_linenumber) END AS source_id"""
PUBLISHED_FROM = "1996-01"
RAW_COLUMNS = [
    "source_id", "fuente", "dataset", "ano", "mes", "periodo", "unidad_ejecutora",
    "nombre_completo", "gastos_operacionales", "monto", "source_url", "raw_file",
    "raw_body_sha256", "fecha_captura_utc"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def year_month(c: str):
    """YYYY-MM of a date column, from its fields; much cheaper than date formatting."""
    return F.concat_ws(
        "-", F.year(c).cast("string"), F.lpad(F.month(c).cast("string"), 2, "0"))


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a number of their own, the same at every reading."""
    return number_by_file(table(spark, sf_dir, "lineitem"), LINE_ID)


def expense_ids(lines: DataFrame) -> DataFrame:
    """Id, order key and number of the expense rows of ``numbered_lines``, without any lookup."""
    return lines.selectExpr(LINE_ID, *ORDER, _SOURCE_ID)


def expenses(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Flat expense rows from line items, their part types and supplier names.

    Rows of ``numbered_lines`` keep their number.
    """
    number = [] if lines is None else [LINE_ID]
    lines = table(spark, sf_dir, "lineitem") if lines is None else lines
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    # Left joins: steps that need only ids drop them altogether.
    x = lines.join(
        part, F.col("l_partkey") == F.col("p_partkey"), "left").join(
        supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    kind, name = "coalesce(p_type, '')", "coalesce(s_name, '')"
    price, file = "cast(floor(l_extendedprice) AS string)", "cast(l_orderkey % 50 AS string)"
    return x.selectExpr(
        *number,
        *ORDER,
        _SOURCE_ID,
        "'lineitem' AS fuente",
        "'expenses' AS dataset",
        "cast(year(l_shipdate) AS string) AS ano",
        "cast(month(l_shipdate) AS string) AS mes",
        "concat(year(l_shipdate), '-', lpad(month(l_shipdate), 2, '0')) AS periodo",
        "CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE cast(l_suppkey AS string) END "
        "AS unidad_ejecutora",
        f"CASE WHEN l_linenumber % 2 = 0 THEN upper({name}) ELSE {name} END AS nombre_completo",
        f"""CASE WHEN l_quantity = 1 THEN concat('NOTA: ', {kind})
            WHEN l_quantity = 2 THEN '$ 1.379.565'
            WHEN l_quantity = 3 THEN ''
            WHEN l_linenumber = 2 THEN concat({kind}, ' SENADORES')
            WHEN l_linenumber = 3 THEN lower({kind})
            WHEN l_linenumber = 4 THEN replace({kind}, 'O', 'Ó')
            WHEN l_linenumber = 6 AND p_type = 'SMALL' THEN 'TRASLACIÓN SENADORES'
            WHEN l_linenumber = 6 AND p_type = 'MEDIUM' THEN 'Arriendo  oficinas'
            WHEN l_linenumber = 6 AND p_type = 'LARGE' THEN 'DISEÑO Y DESARROLLO PAG.WEB'
            ELSE {kind} END AS gastos_operacionales""",
        f"""CASE WHEN l_quantity IN (1, 2, 4) THEN ''
            WHEN l_quantity = 5 THEN '0'
            WHEN l_returnflag = 'R' AND l_linenumber = 5 THEN concat('-', {price})
            ELSE {price} END AS monto""",
        "concat('https://data.example/orders/', l_orderkey) AS source_url",
        f"concat('raw/', {file}, '.json') AS raw_file",
        f"sha2({file}, 256) AS raw_body_sha256",
        "'2026-01-01T00:00:00+00:00' AS fecha_captura_utc")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_suppkey") % 10 == 0, "").otherwise(
            F.col("s_suppkey").cast("string")).alias("unidad_ejecutora"),
        F.col("s_name").alias("nombre_completo"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as run registry, one dataset per customer."""
    key = F.col("o_orderkey").cast("string")
    month = year_month("o_orderdate")
    path = F.concat(
        F.lit("senado/gastos_operacionales/runs/"), key, F.lit("/pipeline_manifest.json"))
    priority = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").cast("string").alias("dataset"),
        key.alias("run_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("generated_at_utc"),
        F.when(priority == "3-MEDIUM", F.date_format("o_orderdate", "yyyy-M")).otherwise(month)
        .alias("period_from"),
        F.when(priority == "2-HIGH", "1997-06").otherwise(month).alias("period_to"),
        (F.floor("o_totalprice") - 5000).alias("row_count"),
        F.when(priority == "1-URGENT", "").otherwise(path).alias("manifest_r2_key"),
        F.concat(F.when(priority == "5-LOW", "http").otherwise("https"),
                 F.lit("://data.example/"), path).alias("public_manifest_url"),
        F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "error")
        .otherwise("partial").alias("status"))


def run_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as facts of the run of their order, with cells some rules reject."""
    q, line = F.col("l_quantity"), F.col("l_linenumber")
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        (line - 1).cast("bigint").alias("row_number"),
        F.concat(F.col("l_partkey").cast("string"), F.lit("-"), line.cast("string"))
        .alias("source_id"),
        F.when(q == 9, "otro").when(flag == "R", "ajuste").when(flag == "A", "ok")
        .otherwise(F.when(line > 3, "ok").otherwise("nota")).alias("row_status"),
        ((flag == "A") | (q == 8)).alias("include_in_ranking"),
        F.when(q == 10, F.lit("")).otherwise(year_month("l_shipdate"))
        .alias("periodo"),
        F.year("l_shipdate").cast("bigint").alias("ano"),
        (F.month("l_shipdate") + F.when(q == 50, 12).otherwise(0)).cast("bigint").alias("mes"),
        F.concat(F.lit("senado_unidad_"), F.col("l_suppkey").cast("string"))
        .alias("parlamentario_id"),
        F.when(q == 11, "").otherwise(F.concat(F.lit("cat_"), flag)).alias("categoria_id"),
        F.when(q == 12, F.lit(None)).otherwise(F.floor("l_extendedprice")).cast("bigint")
        .alias("monto"),
        F.when(q == 13, " ").otherwise("https://data.example").alias("source_url"),
        F.lit("raw.json").alias("raw_file"),
        F.lit("abc").alias("raw_body_sha256"),
        F.lit("2026-01-01").alias("fecha_captura_utc"))


def run_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ranking rows of the run of their order."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        year_month("l_shipdate").alias("periodo"),
        F.year("l_shipdate").cast("bigint").alias("ano"),
        (F.month("l_shipdate") + F.when(q == 50, 12).otherwise(0)).cast("bigint").alias("mes"),
        F.concat(F.lit("cat_"), F.col("l_returnflag")).alias("categoria_id"),
        F.concat(F.lit("Cat "), F.col("l_returnflag")).alias("categoria_nombre"),
        F.concat(F.lit("senado_unidad_"), (F.col("l_suppkey") % 5).cast("string"))
        .alias("parlamentario_id"),
        F.concat(F.lit("Unidad "), (F.col("l_suppkey") % 5).cast("string"))
        .alias("parlamentario_nombre"),
        (F.col("l_linenumber") - F.when(q == 9, 10).otherwise(0)).cast("bigint").alias("rank"),
        (F.floor("l_extendedprice") - F.when(q == 10, 200000).otherwise(0)).alias("total_monto"),
        (F.floor(q) - 11).cast("bigint").alias("registros"),
        F.when(q == 20, 5).otherwise(0).cast("bigint").alias("total_ajustes"),
        F.lit(0).cast("bigint").alias("registros_ajuste"),
        F.lit(0).cast("bigint").alias("registros_sin_monto"),
        F.lit(0).cast("bigint").alias("registros_excluidos"))


# --- the same shapes in SQL ---------------------------------------------------------

X = """
x AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
    CASE WHEN l_orderkey % 97 = 0 THEN '' ELSE l_orderkey || '-' || l_linenumber END AS source_id,
    'lineitem' AS fuente, 'expenses' AS dataset,
    CAST(year(l_shipdate) AS VARCHAR) AS ano, CAST(month(l_shipdate) AS VARCHAR) AS mes,
    strftime(l_shipdate, '%Y-%m') AS periodo,
    CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS unidad_ejecutora,
    CASE WHEN l_linenumber % 2 = 0 THEN upper(coalesce(s_name, '')) ELSE coalesce(s_name, '') END
      AS nombre_completo,
    CASE WHEN l_quantity = 1 THEN 'NOTA: ' || coalesce(p_type, '')
         WHEN l_quantity = 2 THEN '$ 1.379.565'
         WHEN l_quantity = 3 THEN ''
         WHEN l_linenumber = 2 THEN coalesce(p_type, '') || ' SENADORES'
         WHEN l_linenumber = 3 THEN lower(coalesce(p_type, ''))
         WHEN l_linenumber = 4 THEN replace(coalesce(p_type, ''), 'O', 'Ó')
         WHEN l_linenumber = 6 AND p_type = 'SMALL' THEN 'TRASLACIÓN SENADORES'
         WHEN l_linenumber = 6 AND p_type = 'MEDIUM' THEN 'Arriendo  oficinas'
         WHEN l_linenumber = 6 AND p_type = 'LARGE' THEN 'DISEÑO Y DESARROLLO PAG.WEB'
         ELSE coalesce(p_type, '') END AS gastos_operacionales,
    CASE WHEN l_quantity IN (1, 2, 4) THEN ''
         WHEN l_quantity = 5 THEN '0'
         WHEN l_returnflag = 'R' AND l_linenumber = 5
           THEN '-' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)
         ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) END AS monto,
    'https://data.example/orders/' || l_orderkey AS source_url,
    'raw/' || (l_orderkey % 50) || '.json' AS raw_file,
    sha256(CAST(l_orderkey % 50 AS VARCHAR)) AS raw_body_sha256,
    '2026-01-01T00:00:00+00:00' AS fecha_captura_utc,
    row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
                       l_extendedprice) AS o
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
                LEFT JOIN supplier ON l_suppkey = s_suppkey)"""

ENTITIES = """
e AS (
  SELECT CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE CAST(s_suppkey AS VARCHAR) END
           AS unidad_ejecutora, s_name AS nombre_completo FROM supplier)"""

RUNS = """
runs AS (
  SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS dataset,
    CAST(o_orderkey AS VARCHAR) AS run_id, strftime(o_orderdate, '%Y-%m-%d') AS generated_at_utc,
    CASE WHEN o_orderpriority = '3-MEDIUM' THEN year(o_orderdate) || '-' || month(o_orderdate)
         ELSE strftime(o_orderdate, '%Y-%m') END AS period_from,
    CASE WHEN o_orderpriority = '2-HIGH' THEN '1997-06'
         ELSE strftime(o_orderdate, '%Y-%m') END AS period_to,
    CAST(floor(o_totalprice) AS BIGINT) - 5000 AS row_count,
    CASE WHEN o_orderpriority = '1-URGENT' THEN ''
         ELSE 'senado/gastos_operacionales/runs/' || o_orderkey || '/pipeline_manifest.json' END
      AS manifest_r2_key,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'http' ELSE 'https' END
      || '://data.example/senado/gastos_operacionales/runs/' || o_orderkey
      || '/pipeline_manifest.json' AS public_manifest_url,
    CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'error' ELSE 'partial' END AS status
  FROM orders)"""

RUN_FACTS = """
facts AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS run_id, CAST(l_linenumber - 1 AS BIGINT) AS row_number,
    l_partkey || '-' || l_linenumber AS source_id,
    CASE WHEN l_quantity = 9 THEN 'otro' WHEN l_returnflag = 'R' THEN 'ajuste'
         WHEN l_returnflag = 'A' THEN 'ok' WHEN l_linenumber > 3 THEN 'ok' ELSE 'nota' END
      AS row_status,
    l_returnflag = 'A' OR l_quantity = 8 AS include_in_ranking,
    CASE WHEN l_quantity = 10 THEN '' ELSE strftime(l_shipdate, '%Y-%m') END AS periodo,
    CAST(year(l_shipdate) AS BIGINT) AS ano,
    CAST(month(l_shipdate) + CASE WHEN l_quantity = 50 THEN 12 ELSE 0 END AS BIGINT) AS mes,
    'senado_unidad_' || l_suppkey AS parlamentario_id,
    CASE WHEN l_quantity = 11 THEN '' ELSE 'cat_' || l_returnflag END AS categoria_id,
    CASE WHEN l_quantity = 12 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS monto,
    CASE WHEN l_quantity = 13 THEN ' ' ELSE 'https://data.example' END AS source_url,
    'raw.json' AS raw_file, 'abc' AS raw_body_sha256, '2026-01-01' AS fecha_captura_utc
  FROM lineitem)"""

RUN_RANKING = """
ranking AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS run_id, strftime(l_shipdate, '%Y-%m') AS periodo,
    CAST(year(l_shipdate) AS BIGINT) AS ano,
    CAST(month(l_shipdate) + CASE WHEN l_quantity = 50 THEN 12 ELSE 0 END AS BIGINT) AS mes,
    'cat_' || l_returnflag AS categoria_id, 'Cat ' || l_returnflag AS categoria_nombre,
    'senado_unidad_' || (l_suppkey % 5) AS parlamentario_id,
    'Unidad ' || (l_suppkey % 5) AS parlamentario_nombre,
    CAST(l_linenumber - CASE WHEN l_quantity = 9 THEN 10 ELSE 0 END AS BIGINT) AS rank,
    CAST(floor(l_extendedprice) AS BIGINT) - CASE WHEN l_quantity = 10 THEN 200000 ELSE 0 END
      AS total_monto,
    CAST(floor(l_quantity) AS BIGINT) - 11 AS registros,
    CAST(CASE WHEN l_quantity = 20 THEN 5 ELSE 0 END AS BIGINT) AS total_ajustes,
    CAST(0 AS BIGINT) AS registros_ajuste, CAST(0 AS BIGINT) AS registros_sin_monto,
    CAST(0 AS BIGINT) AS registros_excluidos
  FROM lineitem)"""


def sql_clean(c: str) -> str:
    """clean_cell in SQL."""
    return (f"trim(regexp_replace(replace(coalesce({c}, ''), chr(65279), ''), "
            r"'[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))")


def sql_slug(c: str) -> str:
    return (f"coalesce(nullif(trim(regexp_replace(lower(strip_accents({sql_clean(c)})), "
            "'[^a-z0-9]+', '_', 'g'), '_'), ''), 'sin_valor')")


def sql_category_key(c: str) -> str:
    key = f"upper(strip_accents({sql_clean(c)}))"
    for spelling, standard in C.CATEGORY_SPELLINGS:
        key = f"replace({key}, '{spelling}', '{standard}')"
    return f"trim(regexp_replace(trim(regexp_replace({key}, '\\s+', ' ', 'g')), ' SENADORES$', ''))"


_ALIASES = ", ".join(
    f"('{key}', '{target[0]}', '{target[1]}')" for key, target in C.CATEGORY_ALIASES.items())


def _entity(unit: str, name: str) -> str:
    return (f"CASE WHEN {sql_clean(unit)} <> '' THEN 'senado_unidad_' || {sql_clean(unit)} "
            f"ELSE 'nombre_' || {sql_slug(name)} END")


CLASSIFIED = X + f""",
alias(alias_key, alias_id, alias_name) AS (VALUES {_ALIASES}),
k AS (
  SELECT *, {sql_category_key('gastos_operacionales')} AS categoria_key,
    {sql_clean('gastos_operacionales')} AS categoria_raw,
    CASE WHEN regexp_full_match(monto, '-?[0-9]+') THEN CAST(monto AS BIGINT) END AS amount,
    source_id <> '' AND
      row_number() OVER (PARTITION BY source_id ORDER BY o) > 1 AS is_duplicate
  FROM x),
c AS (
  SELECT k.* EXCLUDE (monto), monto AS monto_raw, amount AS monto_num,
    CASE WHEN categoria_key = '' THEN 'sin_categoria'
         ELSE coalesce(alias_id, {sql_slug('categoria_key')}) END AS categoria_id,
    CASE WHEN categoria_key = '' THEN 'Sin categoria'
         ELSE coalesce(alias_name, upper(left(categoria_key, 1)) || lower(substr(categoria_key, 2)))
         END AS categoria_nombre,
    {_entity('unidad_ejecutora', 'nombre_completo')} AS parlamentario_id,
    CASE WHEN unidad_ejecutora <> '' THEN 'unidad_ejecutora' ELSE 'nombre_completo' END
      AS parlamentario_id_source,
    CASE WHEN is_duplicate THEN 'duplicado'
         WHEN categoria_raw = '' THEN 'sin_categoria'
         WHEN starts_with(categoria_key, 'NOTA') THEN 'nota'
         WHEN amount IS NULL AND regexp_full_match(categoria_raw, '-?\\s*\\$\\s*[0-9.\\s-]+')
           THEN 'monto_en_texto'
         WHEN amount IS NULL THEN 'sin_monto'
         WHEN amount < 0 THEN 'ajuste' ELSE 'ok' END AS row_status
  FROM k LEFT JOIN alias ON categoria_key = alias_key)"""

NAMES = ENTITIES + f""",
n0 AS (
  SELECT {_entity('unidad_ejecutora', 'nombre_completo')} AS parlamentario_id,
    {sql_clean('nombre_completo')} AS name
  FROM (SELECT unidad_ejecutora, nombre_completo FROM x
        UNION ALL SELECT unidad_ejecutora, nombre_completo FROM e)),
n1 AS (
  SELECT parlamentario_id, name, count(*) AS n FROM n0 WHERE name <> '' GROUP BY 1, 2),
n2 AS (
  SELECT *, row_number() OVER (PARTITION BY parlamentario_id ORDER BY
    regexp_matches(name, '[a-z]') DESC, (upper(name) = name AND lower(name) <> name), n DESC,
    name DESC) AS i FROM n1),
names AS (
  SELECT parlamentario_id, CASE WHEN upper(name) = name AND lower(name) <> name
    THEN upper(left(name, 1)) || lower(substr(name, 2)) ELSE name END AS parlamentario_nombre
  FROM n2 WHERE i = 1)"""

AGGREGATE = """
catname AS (
  SELECT categoria_id, arg_min(categoria_nombre, o) AS categoria_nombre FROM c GROUP BY 1),
a AS (
  SELECT periodo, categoria_id, parlamentario_id, arg_max(ano, o) AS ano, arg_max(mes, o) AS mes,
    CAST(coalesce(sum(monto_num) FILTER (row_status = 'ok'), 0) AS BIGINT) AS total_monto,
    count(*) FILTER (row_status = 'ok') AS registros,
    CAST(coalesce(sum(monto_num) FILTER (row_status = 'ajuste'), 0) AS BIGINT) AS total_ajustes,
    count(*) FILTER (row_status = 'ajuste') AS registros_ajuste,
    count(*) FILTER (row_status IN ('sin_monto', 'monto_en_texto')) AS registros_sin_monto,
    count(*) FILTER (row_status <> 'ok') AS registros_excluidos
  FROM c GROUP BY 1, 2, 3),
r AS (
  SELECT a.*, coalesce(parlamentario_nombre, '') AS parlamentario_nombre, categoria_nombre
  FROM a LEFT JOIN names USING (parlamentario_id) LEFT JOIN catname USING (categoria_id)
  WHERE registros > 0)"""

RANKING = f"{CLASSIFIED},{NAMES},{AGGREGATE}"
PUBLISHED = f"{RANKING},\nv AS (SELECT * FROM r WHERE periodo >= '{PUBLISHED_FROM}')"
