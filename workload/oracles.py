"""SQL with the same results, over the same tables."""

from __future__ import annotations

from ledgerlens import contract as C
from workload import facade as A

_COLUMNS = ", ".join(
    c for c in C.CLEAN_COLUMNS if c not in ("row_number", "monto", "parlamentario_nombre",
                                            "include_in_ranking", "exclusion_reason",
                                            "nombre_completo_raw"))
_CLEAN = f"""
clean AS (
  SELECT {_COLUMNS}, o, monto_num AS monto, row_status = 'ok' AS include_in_ranking,
    CASE WHEN row_status = 'ok' THEN '' ELSE row_status END AS exclusion_reason,
    nombre_completo AS nombre_completo_raw,
    coalesce(parlamentario_nombre, '') AS parlamentario_nombre
  FROM c LEFT JOIN names USING (parlamentario_id))"""
_CLEANED = f"WITH {A.CLASSIFIED},{A.NAMES},{_CLEAN}"

_SUMMARY = """
  SELECT parlamentario_id, parlamentario_nombre, CAST(sum(total_monto) AS BIGINT) AS total_monto,
    CAST(sum(registros) AS BIGINT) AS registros, count(DISTINCT periodo) AS meses_con_datos,
    CAST((2 * sum(total_monto) + count(DISTINCT periodo)) // (2 * count(DISTINCT periodo))
         AS BIGINT) AS promedio_mensual
  FROM v WHERE {where} GROUP BY 1, 2"""
_FILTERS = ("categoria_id = 'promo' AND periodo >= '1996-03' AND periodo <= '2000-10' "
            "AND parlamentario_nombre ILIKE '%r#00%'")
_VIEW = f"WITH {A.PUBLISHED}"

_MODE = """
m AS (
  SELECT categoria_id, categoria_nombre FROM (
    SELECT categoria_id, categoria_nombre, row_number() OVER (
      PARTITION BY categoria_id ORDER BY count(*) DESC, categoria_nombre) AS i
    FROM v WHERE {where} GROUP BY 1, 2) WHERE i = 1)"""
_CATEGORIES = """
  SELECT v.categoria_id, any_value(m.categoria_nombre) AS categoria_nombre,
    CAST(sum(total_monto) AS BIGINT) AS total_monto, CAST(sum(registros) AS BIGINT) AS registros,
    count(DISTINCT periodo) AS meses_con_datos{extra}
  FROM v JOIN m USING (categoria_id) WHERE {where} GROUP BY 1"""
_ENTITIES = ", count(DISTINCT parlamentario_id) AS parlamentarios"
_PERIODS = """
  SELECT periodo, ano, mes, CAST(sum(total_monto) AS BIGINT) AS total_monto,
    CAST(sum(registros) AS BIGINT) AS registros, count(DISTINCT {what}) AS {name}
  FROM v WHERE {where} GROUP BY 1, 2, 3"""
_ONE_ENTITY = "parlamentario_id = 'senado_unidad_7' AND periodo BETWEEN '1996-05' AND '2000-12'"

_AMOUNTS = """
    count(monto_num) AS numeric_rows, count(*) - count(monto_num) AS empty_or_invalid_rows,
    count(*) FILTER (monto_num = 0) AS zero_rows, count(*) FILTER (monto_num < 0) AS negative_rows,
    CAST(coalesce(sum(monto_num) FILTER (monto_num >= 0), 0) AS BIGINT) AS positive_or_zero_total,
    CAST(coalesce(sum(monto_num) FILTER (monto_num < 0), 0) AS BIGINT) AS negative_total"""
_IDS = """
ids AS (
  SELECT source_id, count(*) AS registros, count(DISTINCT (periodo, unidad_ejecutora,
    nombre_completo, categoria_raw, monto_raw)) > 1 AS conflicting
  FROM c WHERE source_id <> '' GROUP BY 1 HAVING count(*) > 1)"""
_GAPS = """
have AS ({source}),
idx AS (SELECT DISTINCT CAST(left(periodo, 4) AS INT) * 12 + CAST(right(periodo, 2) AS INT) - 1 AS i
        FROM have),
gaps AS (
  SELECT lpad(CAST(i // 12 AS VARCHAR), 4, '0') || '-' ||
         lpad(CAST(i % 12 + 1 AS VARCHAR), 2, '0') AS periodo
  FROM (SELECT unnest(generate_series((SELECT min(i) FROM idx), (SELECT max(i) FROM idx))) AS i)
  WHERE i NOT IN (SELECT i FROM idx))"""
_KEPT_MONTHS = ("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS periodo FROM orders "
          "WHERE (year(o_orderdate) * 12 + month(o_orderdate)) % 5 <> 0")

_P = "'^[0-9]{4}-(0[1-9]|1[0-2])$'"
_RUN_RULES = {
    "dataset_not_blank": "trim(dataset) <> ''",
    "run_id_not_blank": "trim(run_id) <> ''",
    "period_format": f"regexp_matches(period_from, {_P}) AND regexp_matches(period_to, {_P})",
    "period_order": "period_from <= period_to",
    "row_count_non_negative": "row_count >= 0",
    "status_allowed": "status IN ('ok', 'error', 'partial')",
    "ok_manifest_public": (
        "status <> 'ok' OR (regexp_matches(trim(manifest_r2_key), "
        "'^senado/gastos_operacionales/runs/[^/]+/pipeline_manifest[.]json$') AND "
        "regexp_matches(trim(public_manifest_url), '^https://[^[:space:]]+/senado/"
        "gastos_operacionales/runs/[^/]+/pipeline_manifest[.]json$'))"),
}
_YM = "periodo = ano || '-' || lpad(CAST(mes AS VARCHAR), 2, '0')"
_STATUSES = ", ".join(f"'{s}'" for s in C.ROW_STATUSES)
_FACT_RULES = {
    "period_format": f"periodo IS NULL OR periodo = '' OR regexp_matches(periodo, {_P})",
    "month_range": "mes IS NULL OR mes BETWEEN 1 AND 12",
    "period_consistency": (
        f"periodo IS NULL OR periodo = '' OR ano IS NULL OR mes IS NULL OR {_YM}"),
    "row_number_positive": "row_number IS NULL OR row_number > 0",
    "row_status_allowed": f"row_status IS NOT NULL AND row_status IN ({_STATUSES})",
    "include_status_consistency": (
        "(include_in_ranking AND row_status = 'ok') OR "
        "(NOT include_in_ranking AND row_status <> 'ok')"),
    "ranked_fields_present": (
        "NOT include_in_ranking OR (periodo <> '' AND parlamentario_id <> '' AND "
        "categoria_id <> '' AND monto IS NOT NULL)"),
    "traceability_present": (
        "trim(source_url) <> '' AND trim(raw_file) <> '' AND trim(raw_body_sha256) <> '' AND "
        "trim(fecha_captura_utc) <> ''"),
}
_RANKING_RULES = {
    "period_format": f"regexp_matches(periodo, {_P})",
    "month_range": "mes BETWEEN 1 AND 12",
    "period_consistency": _YM,
    "rank_positive": "rank > 0",
    "totals_consistent": (
        "total_monto >= 0 AND registros > 0 AND total_ajustes <= 0 AND registros_ajuste >= 0 "
        "AND registros_sin_monto >= 0 AND registros_excluidos >= 0"),
}


def _failed(table: str, rules: dict[str, str], select: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {select}'{name}' AS rule FROM {table} WHERE NOT coalesce(({test}), true)"
        for name, test in rules.items())


def _failed_counts(table: str, rules: dict[str, str]) -> str:
    return (f"SELECT rule, count(*) AS rows FROM ({_failed(table, rules, '')}) GROUP BY 1")


_LATEST = """
latest AS (
  SELECT * EXCLUDE (i) FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY generated_at_utc DESC, id DESC) AS i
    FROM runs WHERE status = 'ok') WHERE i = 1)"""
_LATEST_COLUMNS = ("id, dataset, run_id, generated_at_utc, period_from, period_to, row_count, "
                   "public_manifest_url, status")

_REPORT = f"""WITH {A.RANKING},{_IDS},{_GAPS.format(source='SELECT DISTINCT periodo FROM x')},
s AS (SELECT row_status, count(*) AS n FROM c GROUP BY 1),
d AS (SELECT count(*) AS groups, CAST(coalesce(sum(registros - 1), 0) AS BIGINT) AS extra,
        count(*) FILTER (conflicting) AS conflicts FROM ids)"""
_MISSING = "(SELECT coalesce(string_agg(periodo, ', ' ORDER BY periodo), '') FROM gaps)"

_PAGED = f"""WITH {A.X},
p AS (
  SELECT *, (row_number() OVER (PARTITION BY periodo ORDER BY o) - 1) // 500 + 1 AS page,
    count(*) OVER (PARTITION BY periodo) AS total FROM x)"""

ORACLES = {
    "classified_rows": _CLEANED + " SELECT * EXCLUDE (o) FROM clean",
    "status_histogram":
        f"WITH {A.CLASSIFIED} SELECT row_status, count(*) AS rows FROM c GROUP BY 1",
    "name_catalogue": f"WITH {A.X},{A.NAMES} SELECT * FROM names",
    "duplicate_profile": f"""WITH {A.CLASSIFIED},{_IDS}
  SELECT count(*) AS duplicate_source_id_groups,
    CAST(sum(registros - 1) AS BIGINT) AS duplicate_source_id_extra_rows,
    count(*) FILTER (conflicting) AS conflicting_duplicate_source_id_groups FROM ids""",
    "conflicting_ids":
        f"WITH {A.CLASSIFIED},{_IDS} SELECT source_id, registros FROM ids WHERE conflicting",
    "amount_profile": f"WITH {A.CLASSIFIED} SELECT {_AMOUNTS} FROM c",
    "missing_units": f"""WITH {A.CLASSIFIED} SELECT count(*) AS missing_unidad_ejecutora_rows
  FROM c WHERE parlamentario_id_source = 'nombre_completo'""",
    "problem_examples": _CLEANED + """
  SELECT row_status, CAST(position AS INTEGER) AS position, source_id, periodo,
    parlamentario_nombre, categoria_raw, monto_raw, raw_file
  FROM (SELECT *, row_number() OVER (PARTITION BY row_status ORDER BY o) AS position
        FROM clean WHERE row_status <> 'ok') WHERE position <= 10""",
    "row_numbers": """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)
    AS row_number FROM lineitem""",
    "monthly_aggregate": f"WITH {A.RANKING} SELECT * FROM a",
    "monthly_ranking": f"""WITH {A.RANKING} SELECT *, row_number() OVER (
    PARTITION BY periodo, categoria_id
    ORDER BY total_monto DESC, parlamentario_nombre, parlamentario_id) AS rank FROM r""",
    "category_catalogue": f"""WITH {A.CLASSIFIED}
  SELECT categoria_id, arg_min(categoria_nombre, o) AS categoria_nombre,
    arg_min(categoria_key, o) AS categoria_key, count(*) AS rows,
    count(*) FILTER (row_status = 'ok') AS included_rows,
    count(*) FILTER (row_status <> 'ok') AS excluded_rows,
    CAST(coalesce(sum(monto_num) FILTER (row_status = 'ok'), 0) AS BIGINT) AS total_monto,
    count(DISTINCT categoria_raw) AS raw_variant_count
  FROM c GROUP BY 1""",
    "category_spellings": f"""WITH {A.CLASSIFIED},
w AS (SELECT categoria_id, categoria_raw, count(*) AS rows, min(o) AS first FROM c GROUP BY 1, 2)
  SELECT categoria_id, categoria_raw, rows, categoria_raw || ' (' || rows || ')' AS rendered,
    row_number() OVER (PARTITION BY categoria_id ORDER BY rows DESC, first) AS position
  FROM w""",
    "category_variants": f"""WITH {A.CLASSIFIED}
  SELECT categoria_id, categoria_nombre, categoria_key, categoria_raw, count(*) AS rows,
    count(*) FILTER (row_status = 'ok') AS included_rows,
    CAST(coalesce(sum(monto_num) FILTER (row_status = 'ok'), 0) AS BIGINT) AS total_monto
  FROM c GROUP BY 1, 2, 3, 4""",
    "period_profile": f"""WITH {_GAPS.format(source='''
    SELECT strftime(l_shipdate, '%Y-%m') AS periodo FROM lineitem
    UNION SELECT strftime(o_orderdate, '%Y-%m') FROM orders''')}
  SELECT (SELECT count(*) FROM have) AS count, (SELECT min(periodo) FROM have) AS min,
    (SELECT max(periodo) FROM have) AS max, {_MISSING} AS missing_in_range""",
    "missing_periods": f"WITH {_GAPS.format(source=_KEPT_MONTHS)} SELECT periodo FROM gaps",
    "public_missing_periods":
        f"WITH {_GAPS.format(source=_KEPT_MONTHS)} SELECT periodo FROM gaps WHERE periodo >= '1998-06'",
    "selected_periods": """
  SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS periodo FROM lineitem
  WHERE year(l_shipdate) = 1999 AND strftime(l_shipdate, '%Y-%m') BETWEEN '1999-03' AND '2000-02'
  ORDER BY 1 LIMIT 6""",
    "period_indexes": """
  SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS periodo,
    CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS month_index,
    strftime(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH, '%Y-%m') AS next_period
  FROM lineitem""",
    "entity_ranking": _VIEW + _SUMMARY.format(where=_FILTERS),
    "entity_summary": _VIEW + _SUMMARY.format(where="true"),
    "entity_lookup": _VIEW + _SUMMARY.format(where="parlamentario_id = 'senado_unidad_7'"),
    "category_summary": _VIEW + "," + _MODE.format(where="true")
        + _CATEGORIES.format(where="true", extra=_ENTITIES),
    "top_categories": _VIEW + "," + _MODE.format(where="true")
        + _CATEGORIES.format(where="true", extra=_ENTITIES)
        + " ORDER BY total_monto DESC, categoria_id LIMIT 8",
    "period_summary": _VIEW + _PERIODS.format(
        what="parlamentario_id", name="parlamentarios", where="true"),
    "newest_periods": _VIEW + _PERIODS.format(
        what="parlamentario_id", name="parlamentarios", where="true")
        + " ORDER BY periodo DESC LIMIT 8",
    "period_range":
        _VIEW + " SELECT min(periodo) AS period_from, max(periodo) AS period_to FROM v",
    "effective_range":
        _VIEW + " SELECT min(periodo) AS period_from, '1999-05' AS period_to FROM v",
    "entity_categories": _VIEW + "," + _MODE.format(where=_ONE_ENTITY)
        + _CATEGORIES.format(where=_ONE_ENTITY, extra=""),
    "entity_periods": _VIEW + _PERIODS.format(
        what="categoria_id", name="categorias", where=_ONE_ENTITY),
    "headline_totals": _VIEW + f""" SELECT CAST(coalesce(sum(total_monto), 0) AS BIGINT)
    AS total_monto, CAST(coalesce(sum(registros), 0) AS BIGINT) AS registros,
    count(*) AS parlamentarios FROM ({_SUMMARY.format(where=_FILTERS)})""",
    "share_of_max": _VIEW + f""", su AS ({_SUMMARY.format(where="periodo >= '1999-01'")})
  SELECT parlamentario_id, promedio_mensual, round(greatest(promedio_mensual * 1.0 /
    greatest((SELECT max(promedio_mensual) FROM su), 1) * 100, 4.0), 6) AS share FROM su""",
    "summary_positions": _VIEW + f""", su AS (
    {_SUMMARY.format(where="periodo BETWEEN '1998-02' AND '2000-06'")})
  SELECT row_number() OVER (ORDER BY registros, parlamentario_nombre, parlamentario_id)
    AS position, parlamentario_id, registros FROM su""",
    "search_entities":
        "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%MER#0000_1%'",
    "latest_run": f"""WITH {A.RUNS} SELECT * REPLACE ('orders' AS dataset) FROM (
    SELECT {_LATEST_COLUMNS} FROM runs WHERE status = 'ok'
    ORDER BY generated_at_utc DESC, id DESC LIMIT 1)""",
    "latest_runs": f"WITH {A.RUNS},{_LATEST} SELECT {_LATEST_COLUMNS} FROM latest",
    "latest_facts": f"""WITH {A.RUNS},{A.RUN_FACTS},{_LATEST}
  SELECT facts.* EXCLUDE (row_status, include_in_ranking) FROM facts
  JOIN latest USING (run_id) WHERE include_in_ranking AND periodo >= '1996-01'""",
    "latest_ranking": f"""WITH {A.RUNS},{A.RUN_RANKING},{_LATEST}
  SELECT ranking.* EXCLUDE (rank) FROM ranking JOIN latest USING (run_id)
  WHERE periodo >= '1996-01' AND registros > 0""",
    "rollback_latest": f"""WITH {A.RUNS.replace('runs AS', 'runs0 AS')},
runs AS (SELECT runs0.* REPLACE (CASE WHEN o_orderpriority = '1-URGENT' THEN 'error' ELSE status
         END AS status) FROM runs0 JOIN orders ON id = o_orderkey),{_LATEST}
  SELECT dataset, run_id, generated_at_utc FROM latest""",
    "run_upsert": f"""WITH {A.RUNS},
cur AS (SELECT * FROM runs WHERE generated_at_utc < '1999-01-01'),
inc AS (SELECT * REPLACE (id + 1000000000 AS id, row_count * 2 AS row_count, 'ok' AS status)
        FROM runs WHERE generated_at_utc >= '1998-01-01')
  SELECT coalesce(cur.id, inc.id) AS id, coalesce(cur.dataset, inc.dataset) AS dataset,
    coalesce(cur.run_id, inc.run_id) AS run_id,
    coalesce(inc.generated_at_utc, cur.generated_at_utc) AS generated_at_utc,
    coalesce(inc.period_from, cur.period_from) AS period_from,
    coalesce(inc.period_to, cur.period_to) AS period_to,
    coalesce(inc.row_count, cur.row_count) AS row_count,
    coalesce(inc.manifest_r2_key, cur.manifest_r2_key) AS manifest_r2_key,
    coalesce(inc.public_manifest_url, cur.public_manifest_url) AS public_manifest_url,
    coalesce(inc.status, cur.status) AS status
  FROM cur FULL JOIN inc ON cur.run_id = inc.run_id""",
    "deleted_runs": f"""WITH {A.RUNS},{A.RUN_FACTS}
  SELECT periodo, count(*) AS rows FROM facts
  WHERE run_id NOT IN (SELECT run_id FROM runs WHERE status = 'error') GROUP BY 1""",
    "orphan_facts": f"""WITH {A.RUNS},{A.RUN_FACTS}
  SELECT run_id, count(*) AS rows FROM facts
  WHERE run_id NOT IN (SELECT run_id FROM runs WHERE status <> 'partial') GROUP BY 1""",
    "typed_load": """
WITH t AS (
  SELECT *, CASE l_linenumber
      WHEN 1 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)
      WHEN 2 THEN CAST(floor(l_extendedprice) AS BIGINT) || '.75'
      WHEN 3 THEN 'n/a' WHEN 4 THEN '' WHEN 5 THEN '1e3'
      WHEN 6 THEN ' -' || CAST(floor(l_extendedprice) AS BIGINT) || '.9 ' END AS amount,
    ['TRUE', '1', ' yes', 'Si', 'no', '', '0'][l_linenumber] AS flag FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents,
    coalesce(amount, '') AS amount_text,
    CAST(trunc(TRY_CAST(trim(amount) AS DOUBLE)) AS BIGINT) AS amount,
    lower(trim(flag)) IN ('true', '1', 'yes', 'si') AS flag FROM t""",
    "run_rule_violations":
        f"WITH {A.RUNS} {_failed('runs', _RUN_RULES, 'run_id, ')}",
    "fact_rule_violations":
        f"WITH {A.RUN_FACTS} {_failed_counts('facts', _FACT_RULES)}",
    "ranking_rule_violations":
        f"WITH {A.RUN_RANKING} {_failed_counts('ranking', _RANKING_RULES)}",
    "manifest_rule_violations": f"""WITH {A.RUNS},
mf AS (SELECT *, CASE WHEN status = 'error' THEN '' ELSE run_id END AS requested,
    CASE WHEN status = 'ok' THEN run_id ELSE substr(run_id, 2) END AS downloaded FROM runs)
""" + _failed("mf", {
        "r2_manifest_key": "trim(manifest_r2_key) <> ''",
        "public_manifest_url": "trim(public_manifest_url) <> ''",
        "public_manifest_https": "starts_with(public_manifest_url, 'https://')",
        "run_id_agreement": "requested = '' OR downloaded = '' OR requested = downloaded",
        "download_run_id": "downloaded <> ''",
        "download_r2_manifest_key": "trim(manifest_r2_key) <> ''",
    }, "run_id, "),
    "fact_unique_violations": f"""WITH {A.RUN_FACTS}
  SELECT 'run_row_number' AS rule, run_id, CAST(row_number AS VARCHAR) AS key, count(*) AS rows
  FROM facts GROUP BY run_id, row_number HAVING count(*) > 1
  UNION ALL
  SELECT 'ranked_source', run_id, source_id, count(*) FROM facts
  WHERE include_in_ranking AND source_id <> '' GROUP BY run_id, source_id HAVING count(*) > 1""",
    "ranking_unique_violations": f"""WITH {A.RUN_RANKING}
  SELECT 'identity' AS rule, run_id, periodo || '|' || categoria_id || '|' || parlamentario_id
    AS key, count(*) AS rows FROM ranking
  GROUP BY run_id, periodo, categoria_id, parlamentario_id HAVING count(*) > 1
  UNION ALL
  SELECT 'rank', run_id, periodo || '|' || categoria_id || '|' || rank, count(*) FROM ranking
  GROUP BY run_id, periodo, categoria_id, rank HAVING count(*) > 1""",
    "run_unique_violations": f"""WITH {A.RUNS}
  SELECT dataset || '-' || period_from AS run_id, count(*) AS rows, 'run_id' AS rule FROM runs
  GROUP BY 1 HAVING count(*) > 1""",
    "quality_report": _REPORT + f"""
  SELECT 'lineitem' AS source_path, (SELECT count(*) FROM x) AS source_rows,
    (SELECT count(*) FROM c) AS clean_rows,
    (SELECT count(*) FROM c WHERE row_status = 'ok') AS included_in_ranking_rows,
    (SELECT count(*) FROM r) AS ranking_rows,
    (SELECT count(DISTINCT categoria_id) FROM c) AS category_rows,
    (SELECT count(DISTINCT periodo) FROM x) AS period_count,
    (SELECT min(periodo) FROM x) AS period_min, (SELECT max(periodo) FROM x) AS period_max,
    {_MISSING} AS missing_in_range, am.*,
    (SELECT count(*) FROM c WHERE parlamentario_id_source = 'nombre_completo')
      AS missing_unidad_ejecutora_rows,
    groups AS duplicate_source_id_groups, extra AS duplicate_source_id_extra_rows,
    conflicts AS conflicting_duplicate_source_id_groups,
    (SELECT coalesce(string_agg(source_id, ', ' ORDER BY source_id), '') FROM (
       SELECT source_id FROM ids WHERE conflicting ORDER BY source_id LIMIT 10))
      AS conflict_examples,
    (SELECT string_agg(row_status || '=' || n, ', ' ORDER BY row_status) FROM s) AS status_counts,
    (SELECT CAST(sum(least(n, 10)) AS BIGINT) FROM s WHERE row_status <> 'ok') AS examples,
    concat_ws(' / ', CASE WHEN extra > 0 THEN '{C.WARN_DUPLICATES}' END,
      CASE WHEN conflicts > 0 THEN '{C.WARN_CONFLICTS}' END,
      CASE WHEN (SELECT count(*) FROM gaps) > 0 THEN '{C.WARN_MISSING}' END) AS warnings
  FROM d, (SELECT {_AMOUNTS} FROM c) am""",
    "publication_gate": _REPORT + """,
f AS (
  SELECT 7 AS i, 'Hay periodos faltantes en el rango publico desde 1998-01: ' ||
    array_to_string(list(periodo ORDER BY periodo)[1:10], ', ') ||
    CASE WHEN count(*) > 10 THEN ' (+' || (count(*) - 10) || ' mas)' ELSE '' END || '.' AS failure
  FROM gaps WHERE periodo >= '1998-01' HAVING count(*) > 0
  UNION ALL SELECT 8, 'Hay ' || extra || ' filas duplicadas por source_id.' FROM d WHERE extra > 0
  UNION ALL SELECT 9, 'Hay ' || conflicts || ' grupos source_id duplicados con contenido distinto.'
    FROM d WHERE conflicts > 0
  UNION ALL SELECT 10, 'No hay filas con row_status ok.'
    WHERE (SELECT count(*) FROM c WHERE row_status = 'ok') = 0)
  SELECT row_number() OVER (ORDER BY i) AS position, failure FROM f""",
    "normalized_clean": _CLEANED + """
  SELECT o AS row_number, source_id, row_status, parlamentario_nombre, categoria_id, monto
  FROM clean""",
    "page_reconciliation": """
WITH t AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS periodo,
    CASE WHEN l_quantity = 3 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END AS source_id,
    CASE WHEN o_orderpriority <> '5-LOW' THEN 4 END AS declared
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
dup AS (
  SELECT periodo, count(*) AS repeated_ids,
    array_to_string(list(source_id ORDER BY source_id)[1:5], ', ') AS repeated_examples
  FROM (SELECT periodo, source_id FROM t WHERE source_id <> '' GROUP BY 1, 2 HAVING count(*) > 1)
  GROUP BY 1),
g AS (
  SELECT periodo, count(*) AS found_rows, CAST(max(declared) AS BIGINT) AS declared_rows,
    count(*) FILTER (source_id = '') AS blank_ids,
    count(DISTINCT source_id) FILTER (source_id <> '') AS distinct_ids
  FROM t GROUP BY 1)
  SELECT g.*, coalesce(repeated_ids, 0) AS repeated_ids,
    coalesce(repeated_examples, '') AS repeated_examples,
    CASE WHEN found_rows <> declared_rows THEN 'row_count' WHEN blank_ids > 0 THEN 'blank_id'
         WHEN repeated_ids > 0 THEN 'repeated_id' WHEN distinct_ids <> declared_rows
         THEN 'id_count' END AS failed_rule
  FROM g LEFT JOIN dup USING (periodo)""",
    "lineage_check": r"""
WITH t AS (
  SELECT l_orderkey % 50 AS b, CASE WHEN l_quantity = 7 THEN '' ELSE 'raw\' || (l_orderkey % 50)
    || '.json' END AS raw_file, CASE WHEN l_linenumber = 7 THEN 'stale'
    ELSE sha256(CAST(l_orderkey % 50 AS VARCHAR)) END AS raw_body_sha256 FROM lineitem),
u AS (
  SELECT raw_file, raw_body_sha256, CASE WHEN raw_file = '' THEN 'blank_file'
    WHEN b < 5 THEN 'uncovered_file' WHEN raw_body_sha256 = 'stale' THEN 'hash_mismatch' END AS rule
  FROM t)
  SELECT raw_file, raw_body_sha256, rule, count(*) AS rows FROM u WHERE rule IS NOT NULL
  GROUP BY 1, 2, 3""",
    "file_suffixes": """
WITH t AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS lo, o_orderpriority = '5-LOW' AS low,
             o_orderpriority FROM orders)
  SELECT 'data/processed/senado_gastos_operacionales_' || lo ||
      CASE WHEN low THEN '' ELSE '_2001-12' END || '.csv' AS path,
    lo || CASE WHEN low THEN '' ELSE '_2001-12' END AS suffix, lo AS period_from,
    CASE WHEN low THEN lo ELSE '2001-12' END AS period_to FROM t""",
    "raw_ingest": _PAGED + """
  SELECT 'senado' AS fuente, 'gastos-operacionales-senadores' AS dataset, source_id, ano, mes,
    periodo, unidad_ejecutora, nombre_completo AS nombre, '' AS appaterno, '' AS apmaterno,
    nombre_completo, gastos_operacionales, monto, '' AS "createdAt", '' AS "updatedAt",
    '' AS "publishedAt", 'https://data.example/expenses/' || periodo || '/' || page AS source_url,
    fecha_captura_utc,
    sha256('https://data.example/expenses/' || periodo || '/' || page) AS raw_body_sha256,
    'ok' AS api_status,
    CAST(count(*) OVER (PARTITION BY periodo, page) AS VARCHAR) AS api_results,
    CAST(page AS VARCHAR) AS api_page, '500' AS api_page_size,
    CAST((total + 499) // 500 AS VARCHAR) AS api_page_count, CAST(total AS VARCHAR) AS api_total
  FROM p""",
    "ingest_reconciliation": f"""WITH {A.X},
dup AS (
  SELECT periodo, count(*) AS repeated_ids,
    array_to_string(list(source_id ORDER BY source_id)[1:5], ', ') AS repeated_examples
  FROM (SELECT periodo, source_id FROM x WHERE source_id <> '' GROUP BY 1, 2 HAVING count(*) > 1)
  GROUP BY 1),
g AS (
  SELECT periodo, count(*) AS found_rows, count(*) AS declared_rows,
    count(*) FILTER (source_id = '') AS blank_ids,
    count(DISTINCT source_id) FILTER (source_id <> '') AS distinct_ids FROM x GROUP BY 1)
  SELECT g.*, coalesce(repeated_ids, 0) AS repeated_ids,
    coalesce(repeated_examples, '') AS repeated_examples,
    CASE WHEN blank_ids > 0 THEN 'blank_id' WHEN repeated_ids > 0 THEN 'repeated_id' END
      AS failed_rule
  FROM g LEFT JOIN dup USING (periodo)""",
    "entity_ingest": """
  SELECT DISTINCT 'senado' AS fuente, 'gastos-operacionales-senadores' AS dataset,
    CAST(year(l_shipdate) AS VARCHAR) AS ano, CAST(month(l_shipdate) AS VARCHAR) AS mes,
    strftime(l_shipdate, '%Y-%m') AS periodo, CAST(s_suppkey AS VARCHAR) AS unidad_ejecutora,
    ' ' || s_name || ' ' AS nombre, 'De' AS appaterno, '' AS apmaterno,
    s_name || ' De' AS nombre_completo, 'https://data.example/entities' AS source_url,
    '2026-01-01' AS fecha_captura_utc, 'abc' AS raw_body_sha256, 'entities.json' AS raw_file,
    'ok' AS api_status, '1' AS api_results
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "available_periods": """
WITH s AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS periodo FROM lineitem
           WHERE strftime(l_shipdate, '%Y-%m') BETWEEN '1997-01' AND '2000-06')
  SELECT DISTINCT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS VARCHAR) AS source_id,
    CAST(year(o_orderdate) AS VARCHAR) AS ano, CAST(month(o_orderdate) AS VARCHAR) AS mes,
    strftime(o_orderdate, '%Y-%m') AS periodo, 'e' AS endpoint, CAST(NULL AS VARCHAR) AS url,
    strftime(o_orderdate, '%Y-%m') IN (SELECT periodo FROM s) AS selected, 'u' AS source_url
  FROM orders""",
    "json_attributes": r"""
  SELECT CAST(event_id AS VARCHAR) AS source_id, json_extract_string(props, '$.k') AS k,
    '{"event": "' || event_type || '", "z": ["a:b,\"c\"", 1]}' AS item_kind, 'True' AS item_seen,
    CAST(NULL AS VARCHAR) AS item_gone FROM events""",
    "attribute_keys": """
  SELECT key, count(*) AS rows FROM (SELECT unnest(json_keys(props)) AS key FROM events)
  GROUP BY 1""",
    "envelope_checks": """
  SELECT CAST(o_orderkey AS VARCHAR) AS raw_file, CASE WHEN o_orderpriority = '5-LOW'
    THEN 'body_not_object' ELSE 'api_status' END AS rule
  FROM orders WHERE o_orderpriority = '5-LOW' OR o_orderstatus = 'O'""",
    "slugify_docs": f"SELECT doc_id, {A.sql_slug('text')} AS slug FROM documents",
    "clean_text": f"""SELECT page_id, length({A.sql_clean('html')}) AS length,
    md5({A.sql_clean('html')}) AS digest FROM pages""",
    "document_duplicates": """
  SELECT doc_id, sha256(text) AS source_id,
    row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate FROM documents""",
    "document_conflicts": """
  SELECT sha256(text) AS source_id, count(*) AS registros,
    count(DISTINCT (lang, source)) > 1 AS conflicting
  FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "csv_roundtrip": """
  SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text
  FROM conversations""",
    "csv_by_year": """
  SELECT CAST(year(l_shipdate) AS VARCHAR) AS year, count(*) AS rows FROM lineitem GROUP BY 1""",
    "file_manifest": """
  SELECT 'ok' AS rule, count(*) AS responses, count(DISTINCT sha256(html)) AS bodies FROM pages""",
    "load_idempotent": f"""WITH {A.RUN_FACTS}
  SELECT 'run-' || ano AS run_id, count(*) AS rows, CAST(sum(monto) AS BIGINT) AS total
  FROM facts GROUP BY 1""",
    "publish_roundtrip": _VIEW + _SUMMARY.format(where="true"),
    "csv_mixed_headers": """
  SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn,
    CASE WHEN conv_id % 3 = 0 THEN role ELSE '' END AS role,
    role || ' "' || (turn % 3) || '",' || chr(10) || text AS text,
    CASE WHEN conv_id % 3 = 2 THEN 'e' || chr(10) || turn ELSE '' END AS extra
  FROM conversations""",
    "ranking_orders": _VIEW + f""", su AS ({_SUMMARY.format(where="periodo >= '1997-01'")})"""
        + " UNION ALL ".join(f"""
  SELECT '{key}' AS sort, '{direction}' AS direction, row_number() OVER (ORDER BY {column} {direction},
    parlamentario_nombre, parlamentario_id) AS position, parlamentario_id FROM su"""
        for key, column in C.SORT_KEYS.items() for direction in ("asc", "desc")),
    "latest_snapshot": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer",
    "publish_run": (_VIEW + _SUMMARY.format(where="true")).replace(
        "CASE WHEN l_orderkey % 97 = 0 THEN '' ELSE l_orderkey || '-' || l_linenumber END AS source_id",
        "'' AS source_id"),
    "load_atomic": f"""WITH {A.RUN_FACTS},
  seen AS (
    SELECT 'before' AS reader, 'run-' || ano AS run_id, monto FROM facts
    UNION ALL
    SELECT 'after', 'run-' || ano, CASE WHEN ano >= 1998 THEN 2 * monto ELSE monto END FROM facts
    UNION ALL
    SELECT 'after', 'other', monto FROM facts WHERE ano = 1997)
  SELECT reader, run_id, count(*) AS rows, CAST(sum(monto) AS BIGINT) AS total, 'refused' AS late_writer
  FROM seen GROUP BY 1, 2""",
    "load_refusals": """
  SELECT run, rule, 0 AS version FROM (VALUES
    ('blank_run', 'run_id'), ('other_run', 'run_id_agreement'), ('no_key', 'r2_manifest_key'),
    ('no_url', 'public_manifest_url'), ('plain_url', 'public_manifest_https'),
    ('odd_start', 'period_from'), ('odd_end', 'period_to'), ('backwards', 'period_order'),
    ('no_clean', 'clean_output'), ('no_ranking', 'ranking_output'), ('other_count', 'row_count'),
    ('changed_file', 'changed_part'), ('odd_status', 'row_status_allowed'), ('repeated_rank', 'rank'))
    t(run, rule)
  WHERE (SELECT count(*) FROM lineitem) > 0""",
    "output_record_check": """
  WITH named AS (
    SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'intact' WHEN '2-HIGH' THEN 'missing'
        WHEN '3-MEDIUM' THEN 'changed' WHEN '4-NOT SPECIFIED' THEN 'added' ELSE 'longer' END AS name,
      CAST(o_orderkey AS VARCHAR) AS a, CAST(o_custkey AS VARCHAR) AS b, o_orderstatus AS c,
      '"' || (o_orderkey % 7) || ' ' || chr(10) || ',á' AS d
    FROM orders),
  hashed AS (
    SELECT name, sha256(length(a) || ':' || a || length(b) || ':' || b || length(c) || ':' || c
      || length(d) || ':' || d) AS h FROM named),
  summed AS (
    SELECT name, count(*) AS n,
      sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS s0, sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS s1,
      sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)) AS s2, sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)) AS s3
    FROM hashed GROUP BY 1)
  SELECT name, '' AS rule, n, sha256(n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) AS digest FROM summed
  UNION ALL
  SELECT * FROM (VALUES ('missing', 'missing_part', 1, ''), ('changed', 'changed_part', 1, ''),
    ('added', 'added_part', 1, ''), ('longer', 'added_part', 1, ''), ('longer', 'row_count', 1, ''))""",
    "archive_check": f"""WITH {A.X}
  SELECT 'kept' AS state, 'pages' AS rule, CAST(sum(pages) AS BIGINT) AS n FROM (
    SELECT CAST(ceil(count(*) / {C.PAGE_SIZE}) AS BIGINT) AS pages FROM x GROUP BY periodo)
  UNION ALL SELECT 'longer', 'other_bytes', 1 UNION ALL SELECT 'fewer', 'not_archived', 1""",
    "file_verdicts": """
  SELECT CAST(page_id % 8 AS VARCHAR) AS bucket, CASE page_id % 8 WHEN 2 THEN 'no_sha256'
      WHEN 3 THEN 'changed_file' WHEN 5 THEN 'missing_file' ELSE 'ok' END AS rule,
    CASE WHEN page_id % 8 IN (2, 3, 5) THEN 0 ELSE count(DISTINCT sha256(html)) END AS bodies
  FROM pages GROUP BY page_id % 8""",
}
