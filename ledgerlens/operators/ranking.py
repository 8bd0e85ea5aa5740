"""Monthly aggregates, ranking and category catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import contract as C
from ledgerlens.operators.classify import order_key, with_entity_name
from ledgerlens.operators.numbering import number_rows
from ledgerlens.session import broadcast_if_small, materialize

GRAIN = ["periodo", "categoria_id", "parlamentario_id"]
MEASURES = [
    "total_monto", "registros", "total_ajustes", "registros_ajuste", "registros_sin_monto",
    "registros_excluidos",
]


def _sums() -> list[Column]:
    sums = {
        "total_monto": f"coalesce(sum(monto) FILTER (WHERE row_status = '{C.STATUS_OK}'), 0)",
        "registros": f"count_if(row_status = '{C.STATUS_OK}')",
        "total_ajustes":
            f"coalesce(sum(monto) FILTER (WHERE row_status = '{C.STATUS_ADJUSTMENT}'), 0)",
        "registros_ajuste": f"count_if(row_status = '{C.STATUS_ADJUSTMENT}')",
        "registros_sin_monto":
            f"count_if(row_status IN ('{C.STATUS_NO_AMOUNT}', '{C.STATUS_AMOUNT_IN_TEXT}'))",
        "registros_excluidos": f"count_if(row_status <> '{C.STATUS_OK}')",
    }
    return [F.expr(sums[m]).alias(m) for m in MEASURES]


def monthly_partials(
    classified: DataFrame, *, order_by: Sequence[str] | None = None
) -> DataFrame:
    """One pass over the rows: sums by period, category, entity and the cells that may vary
    within those, with the first and last order key of each group if ``order_by`` is given.

    What follows, the groups with their last year and month and the category names with
    their first spelling, only merges these few rows.
    """
    seen = [] if order_by is None else [
        F.min(order_key(order_by)).alias("first_seen"), F.max(order_key(order_by)).alias("last_seen")]
    return classified.groupBy(*GRAIN, "ano", "mes", "categoria_nombre").agg(*_sums(), *seen)


def order_decides(partials: DataFrame) -> bool:
    """Whether some period has several year and month cells, or some category several names."""
    varied = [
        partials.select(key, *cells).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        .select("n") for key, cells in (("periodo", ["ano", "mes"]), ("categoria_id", ["categoria_nombre"]))]
    return not varied[0].unionAll(varied[1]).isEmpty()


def merge_partials(partials: DataFrame) -> DataFrame:
    """Totals per period, category and entity; year and month are the last row's."""
    sums = [F.sum(m).alias(m) for m in MEASURES]
    merged = partials.groupBy(*GRAIN).agg(F.expr("max_by(struct(ano, mes), last_seen)").alias("__when"), *sums)
    return merged.selectExpr(*GRAIN, "__when.ano AS ano", "__when.mes AS mes", *MEASURES)


def category_names(partials: DataFrame) -> DataFrame:
    """Name of every category: the spelling of its first row."""
    return partials.groupBy("categoria_id").agg(
        F.expr("min_by(categoria_nombre, first_seen)").alias("categoria_nombre"))


def monthly_aggregate(classified: DataFrame, *, order_by: Sequence[str]) -> DataFrame:
    """Totals per period, category and entity in one aggregate; year and month are the last row's."""
    last = F.max_by(F.struct("ano", "mes"), order_key(order_by)).alias("__when")
    totals = classified.groupBy(*GRAIN).agg(last, *_sums())
    return totals.selectExpr(*GRAIN, "__when.ano AS ano", "__when.mes AS mes", *MEASURES)


def category_variants(classified: DataFrame, *, order_by: Sequence[str]) -> DataFrame:
    """Every raw spelling of a category with its counts and first position.

    The category is a function of the raw cell, so this one aggregate over the rows
    feeds the whole catalogue.
    """
    return classified.groupBy(
        "categoria_id", "categoria_nombre", "categoria_key", "categoria_raw"
    ).agg(
        F.expr("count(*) AS rows"),
        F.expr("count_if(include_in_ranking) AS included_rows"),
        F.expr("coalesce(sum(monto) FILTER (WHERE include_in_ranking), 0) AS total_monto"),
        F.min(order_key(order_by)).alias("first_seen"))


def category_stats(variants: DataFrame) -> DataFrame:
    """Counts per category; name and key are those of its first row."""
    stats = variants.groupBy("categoria_id").agg(
        F.expr("min_by(struct(categoria_nombre, categoria_key), first_seen) AS __first"),
        F.expr("sum(rows) AS rows"),
        F.expr("sum(included_rows) AS included_rows"),
        F.expr("sum(total_monto) AS total_monto"),
        F.expr("count(*) AS raw_variant_count"))
    return stats.selectExpr(
        "categoria_id", "__first.categoria_nombre AS categoria_nombre",
        "__first.categoria_key AS categoria_key", "rows", "included_rows",
        "rows - included_rows AS excluded_rows", "total_monto", "raw_variant_count")


def category_catalogue(
    classified: DataFrame,
    *,
    order_by: Sequence[str],
    variants: DataFrame | None = None,
) -> DataFrame:
    """Category table; the spellings of a category are rows of ``category_spellings``."""
    if variants is None:
        variants = category_variants(classified, order_by=order_by)
    return category_stats(variants).select(*C.CATEGORY_COLUMNS)


def category_spellings(variants: DataFrame) -> DataFrame:
    """Every spelling of every category with its position, most frequent first."""
    placed = number_rows(
        variants.select("categoria_id", "categoria_raw", "rows", "first_seen"),
        [F.desc("rows"), F.asc("first_seen")], partition_by=["categoria_id"], name="position")
    rendered = F.concat("categoria_raw", F.lit(" ("), F.col("rows"), F.lit(")"))
    return placed.withColumn("rendered", rendered).select(*C.SPELLING_COLUMNS)


def ranking_groups(
    classified: DataFrame, entity_names: DataFrame, *, order_by: Sequence[str]
) -> DataFrame:
    """Ranked groups with their names; groups without ranked rows are dropped.

    The partial sums are stored once and used twice.  They hold plain numbers, a hash aggregate;
    order keys are taken too, in a second pass, only where the stored sums show that the order decides
    a year, month or name.  Names are stored before they join, so that their size is known and no group
    is shuffled for the sake of a few names.
    """
    partials = materialize(monthly_partials(classified), "partials")
    names = broadcast_if_small(materialize(entity_names, "names"))
    if order_decides(partials):
        partials = materialize(monthly_partials(classified, order_by=order_by), "partials")
        groups, categories = merge_partials(partials), materialize(category_names(partials), "category-names")
        named = with_entity_name(groups.where("registros > 0"), names, raw_name=None)
        return named.join(broadcast_if_small(categories), "categoria_id", "left")
    # one year and month per period and one name per category: the partial sums are the groups
    category = F.when(F.col("categoria_id").isNotNull(), F.col("categoria_nombre")).alias("categoria_nombre")
    groups = partials.select(*GRAIN, "ano", "mes", *MEASURES, category)
    return with_entity_name(groups.where("registros > 0"), names, raw_name=None)


def monthly_ranking(
    classified: DataFrame, entity_names: DataFrame, *, order_by: Sequence[str]
) -> DataFrame:
    """Rank in period and category by total, then name, then id."""
    ranked = number_rows(
        ranking_groups(classified, entity_names, order_by=order_by),
        [F.desc("total_monto"), F.asc("parlamentario_nombre"), F.asc("parlamentario_id")],
        partition_by=["periodo", "categoria_id"],
        name="rank")
    return ranked.select(*C.RANKING_COLUMNS)
