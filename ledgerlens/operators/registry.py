"""Run registry: latest run, upsert, status change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import contract as C

UPDATED = [
    "generated_at_utc", "period_from", "period_to", "row_count", "manifest_r2_key",
    "public_manifest_url", "status",
]
LATEST_COLUMNS = [
    "id", "dataset", "run_id", "generated_at_utc", "period_from", "period_to", "row_count",
    "public_manifest_url", "status",
]


def generated_at() -> Column:
    """Moment of a run: texts with different offsets compare by time, what is no time is null."""
    return F.col("generated_at_utc").try_cast("timestamp")


def latest_run(runs: DataFrame, dataset: str = C.DATASET_NAME) -> DataFrame:
    """Newest ok run of a dataset, in at most one row."""
    kept = [c for c in LATEST_COLUMNS if c in runs.columns]
    return runs.where((F.col("dataset") == dataset) & (F.col("status") == C.STATUS_OK)).orderBy(
        generated_at().desc_nulls_last(), F.desc("id")).limit(1).select(*kept)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest ok run of every dataset, by a map-side maximum instead of a sort per dataset."""
    kept = [c for c in LATEST_COLUMNS if c in runs.columns and c != "dataset"]
    newest = runs.where(F.col("status") == C.STATUS_OK).groupBy("dataset").agg(
        F.max_by(F.struct(*kept), F.struct(generated_at().alias("at"), "id")).alias("__run"))
    return newest.select("dataset", "__run.*")


def upsert_runs(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert new runs; on a known run id replace seven columns and keep the rest."""
    new = incoming.select(
        F.col("run_id").alias("__run_id"), F.lit(True).alias("__new"),
        *[F.col(c).alias(f"__{c}") for c in current.columns if c != "run_id"])
    joined = current.withColumn("__known", F.lit(True)).join(
        new, F.col("run_id") == F.col("__run_id"), "full")
    out = []
    for c in current.columns:
        if c == "run_id":
            value = F.coalesce("run_id", "__run_id")
        elif c in UPDATED:
            value = F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c))
        else:
            value = F.when(F.col("__known"), F.col(c)).otherwise(F.col(f"__{c}"))
        out.append(value.alias(c))
    return joined.select(*out)


def set_run_status(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (run_id, status) changes; readers then fall back to the previous ok run."""
    new = changes.select("run_id", F.col("status").alias("__status"))
    return runs.join(new, "run_id", "left").withColumn(
        "status", F.coalesce("__status", "status")).select(*runs.columns)


def delete_runs(facts: DataFrame, deleted: DataFrame) -> DataFrame:
    """Facts without those of deleted runs, the cascade of a registry delete."""
    return facts.join(deleted.select("run_id").distinct(), "run_id", "left_anti")
