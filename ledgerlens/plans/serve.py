"""Serving queries over the latest valid run.

Each function returns one lazy DataFrame; only predicates whose parameter is set are
built, so all of them can reach the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import contract as C
from ledgerlens.functions.casts import rounded_ratio
from ledgerlens.functions.text import contains_ci
from ledgerlens.operators.numbering import number_rows
from ledgerlens.operators.registry import latest_run, latest_runs
from ledgerlens.session import materialize

FACT_COLUMNS = (
    "run_id source_id row_number periodo ano mes parlamentario_id parlamentario_nombre "
    "categoria_id categoria_nombre categoria_key categoria_raw monto source_url raw_file "
    "raw_body_sha256 fecha_captura_utc").split()
RANKING_VIEW_COLUMNS = (
    "run_id periodo ano mes categoria_id categoria_nombre parlamentario_id "
    "parlamentario_nombre total_monto registros total_ajustes registros_ajuste "
    "registros_sin_monto registros_excluidos").split()


def latest_facts(
    facts: DataFrame, runs: DataFrame, *, dataset: str | None = C.DATASET_NAME,
    published_from: str = C.PUBLICATION_FROM,
) -> DataFrame:
    """Ranked facts of the latest run of a dataset, or of every dataset for None."""
    kept = facts.where(F.col("include_in_ranking") & (F.col("periodo") >= published_from))
    return kept.join(_latest_ids(runs, dataset), "run_id").select(
        *[c for c in FACT_COLUMNS if c in facts.columns])


def latest_ranking(
    ranking: DataFrame, runs: DataFrame, *, dataset: str | None = C.DATASET_NAME,
    published_from: str = C.PUBLICATION_FROM,
) -> DataFrame:
    """Ranking of the latest run without its rank column; run_id partitions are pruned."""
    return published(ranking, published_from).join(_latest_ids(runs, dataset), "run_id").select(
        *[c for c in RANKING_VIEW_COLUMNS if c in ranking.columns])


def _latest_ids(runs: DataFrame, dataset: str | None) -> DataFrame:
    if dataset is None:
        return latest_runs(runs).select("run_id")  # grows with datasets: no broadcast hint
    return F.broadcast(latest_run(runs, dataset).select("run_id"))  # one row by its limit


def published(ranking: DataFrame, published_from: str = C.PUBLICATION_FROM) -> DataFrame:
    return ranking.where((F.col("periodo") >= published_from) & (F.col("registros") > 0))


def period_range(ranking: DataFrame) -> DataFrame:
    return ranking.agg(F.min("periodo").alias("period_from"), F.max("periodo").alias("period_to"))


def effective_range(
    ranking: DataFrame, period_from: str | None = None, period_to: str | None = None
) -> DataFrame:
    """Filter bounds if set, else the data's range, else ''."""
    pick = lambda p, c: F.coalesce(F.nullif(F.lit(p or ""), F.lit("")), F.col(c), F.lit(""))
    return period_range(ranking).select(
        pick(period_from, "period_from").alias("period_from"),
        pick(period_to, "period_to").alias("period_to"))


def ranking_filter(
    ranking: DataFrame,
    *,
    category_id: str | None = None,
    period_from: str | None = C.PUBLICATION_FROM,
    period_to: str | None = None,
    search: str | None = None,
    entity_id: str | None = None,
) -> DataFrame:
    """Optional predicates; null and '' leave one out."""
    out = ranking
    if entity_id is not None:
        out = out.where(F.col("parlamentario_id") == entity_id)
    if category_id:
        out = out.where(F.col("categoria_id") == category_id)
    if period_from:
        out = out.where(F.col("periodo") >= period_from)
    if period_to:
        out = out.where(F.col("periodo") <= period_to)
    if search:
        out = out.where(contains_ci("parlamentario_nombre", search))
    return out


def _totals() -> list[Column]:
    return [F.sum("total_monto").alias("total_monto"), F.sum("registros").alias("registros")]


def _months() -> Column:
    return F.count_distinct("periodo").alias("meses_con_datos")


def _category_name() -> Column:
    # Most frequent, lowest on ties; a run has one name per category, so little is held.
    return F.mode("categoria_nombre", deterministic=True).alias("categoria_nombre")


def entity_summary(ranking: DataFrame) -> DataFrame:
    """Totals, active months and monthly average per entity."""
    sums = ranking.groupBy("parlamentario_id", "parlamentario_nombre").agg(*_totals(), _months())
    return sums.withColumn("promedio_mensual", rounded_ratio("total_monto", "meses_con_datos"))


def filtered_entity_summary(ranking: DataFrame, **filters) -> DataFrame:
    return entity_summary(ranking_filter(ranking, **filters))


def entity_lookup(ranking: DataFrame, entity_id: str) -> DataFrame:
    """Summary of one entity: no row if unknown, an error if it is ambiguous."""
    summary = entity_summary(ranking.where(F.col("parlamentario_id") == entity_id))
    found = summary.limit(2).agg(F.collect_list(F.struct(*summary.columns)).alias("found"))
    one = F.when(F.size("found") <= 1, F.col("found")).otherwise(
        F.raise_error(F.lit(f"more than one summary for {entity_id}")))
    return with_zeroes(found.select(F.inline(one)))


def with_zeroes(summary: DataFrame) -> DataFrame:
    """Null measures become 0, as they are shown."""
    measures = [c for c in summary.columns if c in {
        "total_monto", "registros", "meses_con_datos", "promedio_mensual", "parlamentarios",
        "categorias"}]
    return summary.withColumns({c: F.coalesce(c, F.lit(0)) for c in measures})


def category_summary(ranking: DataFrame) -> DataFrame:
    return ranking.groupBy("categoria_id").agg(
        _category_name(), *_totals(), _months(),
        F.count_distinct("parlamentario_id").alias("parlamentarios"))


def categories_by_total(ranking: DataFrame, limit: int | None = None) -> DataFrame:
    """Largest categories first; ties by id so that a limit is reproducible."""
    out = with_zeroes(category_summary(ranking)).orderBy(
        F.desc("total_monto"), F.asc("categoria_id"))
    return out.limit(limit) if limit is not None else out


def period_summary(ranking: DataFrame) -> DataFrame:
    return ranking.groupBy("periodo", "ano", "mes").agg(
        *_totals(), F.count_distinct("parlamentario_id").alias("parlamentarios"))


def newest_periods(ranking: DataFrame, limit: int = 8) -> DataFrame:
    return with_zeroes(period_summary(ranking)).orderBy(F.desc("periodo")).limit(limit)


def entity_categories(
    ranking: DataFrame, entity_id: str, *, period_from: str | None = C.PUBLICATION_FROM,
    period_to: str | None = None,
) -> DataFrame:
    """One entity's categories, largest first."""
    rows = ranking_filter(
        ranking, entity_id=entity_id, period_from=period_from, period_to=period_to)
    return with_zeroes(rows.groupBy("categoria_id").agg(_category_name(), *_totals(), _months())
                       ).orderBy(F.desc("total_monto"), F.asc("categoria_id"))


def entity_periods(
    ranking: DataFrame, entity_id: str, *, period_from: str | None = C.PUBLICATION_FROM,
    period_to: str | None = None,
) -> DataFrame:
    """One entity's months, newest first."""
    rows = ranking_filter(
        ranking, entity_id=entity_id, period_from=period_from, period_to=period_to)
    return with_zeroes(rows.groupBy("periodo", "ano", "mes").agg(
        *_totals(), F.count_distinct("categoria_id").alias("categorias"))
    ).orderBy(F.desc("periodo"))


def summary_order(sort: str = "promedio_mensual", direction: str = "desc") -> list[Column]:
    """Sort key in its direction, then name ascending by Spanish collation, then id."""
    name = F.collate(F.col("parlamentario_nombre"), C.NAME_COLLATION)
    key = name if sort == "nombre" else F.col(C.SORT_KEYS.get(sort, "promedio_mensual"))
    first = key.asc() if direction == "asc" else key.desc()
    return [first, name.asc(), F.asc("parlamentario_id")]


def sort_summaries(summary: DataFrame, sort: str = "promedio_mensual", direction: str = "desc"):
    return summary.orderBy(*summary_order(sort, direction))


def summary_positions(
    summary: DataFrame, sort: str = "promedio_mensual", direction: str = "desc"
) -> DataFrame:
    """Summaries with their place in the sorted list, without a one-task window."""
    return number_rows(summary, summary_order(sort, direction), name="position")


def all_positions(summary: DataFrame) -> DataFrame:
    """sort, direction, position, parlamentario_id of every order that the ranking page offers."""
    summary = materialize(summary, "summary")
    orders = [
        summary_positions(summary, sort, direction).select(
            F.lit(sort).alias("sort"), F.lit(direction).alias("direction"), "position", "parlamentario_id")
        for sort in C.SORT_KEYS for direction in ("asc", "desc")]
    return reduce(DataFrame.unionByName, orders)


def headline_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.coalesce(F.sum("total_monto"), F.lit(0)).alias("total_monto"),
        F.coalesce(F.sum("registros"), F.lit(0)).alias("registros"),
        F.count(F.lit(1)).alias("parlamentarios"))


def share_of_max(summary: DataFrame, value: str = "promedio_mensual") -> DataFrame:
    """Bar length in percent of the largest value, at least 4; the summary is stored and read twice."""
    summary = materialize(summary, "summary")
    top = F.greatest(summary.agg(F.max(value)).scalar(), F.lit(1))
    return summary.withColumn(
        "share", F.greatest(F.col(value) / top * 100, F.lit(4.0)).cast("double"))
