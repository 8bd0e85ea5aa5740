"""A store of loaded runs in versions: a load is seen whole or not at all.

``<store>/<table>/load=<id>`` holds the rows that one load brought, written once and never changed.
``<store>/registry/<id>`` holds the registered runs and, for each, the load that its rows are in.
``<store>/log/<version>.json`` names a registry; creating the next one commits a load.  Readers take
the newest version and see the rows of its loads alone, so what a load has written before its commit,
or failed to commit, is seen by nobody, and a reader who has begun goes on with the version it took.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens import contract as C
from ledgerlens.operators.registry import latest_run, upsert_runs
from ledgerlens.sources import shared_files as S

#: How often a commit is tried again behind commits of other runs.
ATTEMPTS = 50


class LoadConflict(RuntimeError):
    """Another writer has loaded one of the same runs in the meantime."""


@dataclass(frozen=True)
class Version:
    """What readers of one version see; number 0 is a store without a load."""

    spark: SparkSession
    store: str
    number: int
    registry: str | None

    @property
    def runs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.store}/registry/{self.registry}/runs")

    @property
    def loads(self) -> DataFrame:
        """run_id and the load that holds its rows."""
        return self.spark.read.parquet(f"{self.store}/registry/{self.registry}/loads")

    def table(self, name: str, of: DataFrame | None = None) -> DataFrame:
        """Rows of a table, of all runs or of those ``of`` names; other loads are pruned before the scan."""
        loads = self.loads if of is None else self.loads.join(of.select("run_id"), "run_id", "left_semi")
        rows = self.spark.read.parquet(f"{self.store}/{name}")
        return rows.join(loads, ["load", "run_id"], "left_semi").drop("load")

    def latest(self, name: str, dataset: str = C.DATASET_NAME) -> DataFrame:
        """Rows of a dataset's newest ok run."""
        return self.table(name, latest_run(self.runs, dataset))


def _entry(number: int) -> str:
    return f"{number:012d}.json"


def versions(spark: SparkSession, store: str) -> list[int]:
    names = [e.name for e in S.children(spark, f"{store}/log")]
    return [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]


def read_version(spark: SparkSession, store: str, number: int | None = None) -> Version:
    """The newest version, or the one asked for."""
    if number is None:
        number = max(versions(spark, store), default=0)
    if not number:
        return Version(spark, store, 0, None)
    entry = json.loads(S.read_text(spark, f"{store}/log/{_entry(number)}"))
    return Version(spark, store, number, entry["registry"])


def stage(tables: Mapping[str, DataFrame], store: str) -> str:
    """Write the rows of a load and return its id; nobody sees them before the commit.

    Rows are range-partitioned by what queries filter on, so a file holds a narrow range of months
    and entities and its statistics prune; a hot month is split by the further keys.
    """
    load = f"load-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        wanted = ["run_id", "periodo", "categoria_id", "parlamentario_id", "row_number", "rank"]
        keys = [c for c in wanted if c in rows.columns]
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{store}/{name}/load={load}")
    return load


def commit(based_on: Version, incoming: DataFrame, load: str | None = None) -> Version:
    """Register ``incoming`` runs, their rows being in ``load``, as the next version.

    Without a load the runs' rows stay where they are, as for a change of status.  New runs get the
    next free ids.  If other writers have committed since ``based_on``, the commit is made behind
    theirs; if one of them loaded or changed a run of ``incoming``, LoadConflict is raised and
    nothing changes.
    """
    spark, store = based_on.spark, based_on.store
    for _ in range(ATTEMPTS):
        now = read_version(spark, store)
        if now.number != based_on.number:
            _refuse_conflicts(based_on, now, incoming)
        registry = uuid.uuid4().hex
        runs, loads = _registered(now, incoming, load)
        # one row per run
        runs.coalesce(1).write.parquet(f"{store}/registry/{registry}/runs")
        loads.coalesce(1).write.parquet(f"{store}/registry/{registry}/loads")
        entry = json.dumps({"version": now.number + 1, "registry": registry})
        if S.create_new(spark, f"{store}/log/{_entry(now.number + 1)}", entry):
            return Version(spark, store, now.number + 1, registry)
    raise LoadConflict(f"{ATTEMPTS} commits came in between")


def _refuse_conflicts(based_on: Version, now: Version, incoming: DataFrame) -> None:
    """Runs of ``incoming`` that are not as they were in ``based_on``."""
    mine = incoming.select("run_id").distinct()
    state = now.runs.join(now.loads, "run_id", "left")
    if based_on.number:
        state = state.exceptAll(based_on.runs.join(based_on.loads, "run_id", "left").select(*state.columns))
    changed = [r.run_id for r in state.join(mine, "run_id", "left_semi").select("run_id").limit(10).collect()]
    if changed:
        raise LoadConflict(", ".join(sorted(changed)))


def _registered(now: Version, incoming: DataFrame, load: str | None) -> tuple[DataFrame, DataFrame]:
    loads = incoming.select("run_id", F.lit(load).alias("load")) if load else None
    if not now.number:
        return _with_ids(incoming, F.lit(0)), loads
    top = F.coalesce(now.runs.agg(F.max("id")).scalar(), F.lit(0))
    runs = upsert_runs(now.runs, _with_ids(incoming, top))
    if loads is None:
        return runs, now.loads
    return runs, now.loads.join(loads, "run_id", "left_anti").unionByName(loads)


def _with_ids(incoming: DataFrame, top) -> DataFrame:
    """Runs without an id get the next ones; a load brings few runs."""
    nth = F.row_number().over(W.orderBy("run_id"))
    return incoming.withColumn("id", F.coalesce(F.col("id"), (top + nth).cast("bigint")))


def drop_old(spark: SparkSession, store: str, tables: list[str], *, keep: int = 1, grace_s: float = 86_400) -> int:
    """Delete registries and loads that none of the newest ``keep`` versions refers to.

    What is younger than ``grace_s`` stays: a writer may be about to commit it, a reader may still
    read it.  Returns the number of folders deleted.
    """
    kept = [read_version(spark, store, n) for n in sorted(versions(spark, store))[-keep:]]
    registries = {v.registry for v in kept}
    loads = {f"load={r.load}" for v in kept for r in v.loads.select("load").distinct().collect()}
    limit, dropped = (time.time() - grace_s) * 1000, 0
    for folder, alive in [(f"{store}/registry", registries), *[(f"{store}/{t}", loads) for t in tables]]:
        for entry in S.children(spark, folder):
            if entry.name not in alive and entry.modified_ms < limit:
                S.delete(spark, f"{folder}/{entry.name}")
                dropped += 1
    return dropped
