"""Row numbers that do not funnel a group, or the table, through one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.session import broadcast_if_small, materialize

_SLOT, _PART = "__slot", "__part"
_LOW_BITS = 33  # monotonically_increasing_id keeps the in-partition index in these bits


#: A group of more rows than this is spread over several tasks.
HOT_ROWS = 100_000


def number_by_file(files: DataFrame, name: str) -> DataFrame:
    """Rows as read from Parquet files, each with a bigint of its own: 0-based, by file and place in it.

    The numbers are the same at every reading, so that rows need not be stored to keep them.  What
    one task adds up is a row for each file.
    """
    path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    counts = materialize(files.groupBy(path.alias("__file")).agg(F.count(F.lit(1)).alias("__n")), "files")
    before = F.sum("__n").over(W.orderBy("__file")) - F.col("__n")
    starts = broadcast_if_small(materialize(counts.select("__file", before.alias("__start")), "starts"))
    placed = files.select("*", path.alias("__path"), place.alias("__place"))
    joined = placed.join(starts, F.col("__path") == F.col("__file"))
    return joined.select(*files.columns, (F.col("__start") + F.col("__place")).alias(name))


def number_rows(
    df: DataFrame,
    order_by: Sequence[str | Column],
    *,
    partition_by: Sequence[str] = (),
    name: str = "row_number",
    hot_rows: int = HOT_ROWS,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """1-based position by ``order_by``, over the table or within ``partition_by``.

    Groups are counted first, map-side.  Those of at most ``hot_rows`` rows are sorted by a window,
    one shuffle and no copy; rows of larger ones are spread and numbered with offsets, see
    ``number_spread``.  ``order_by`` with the group must be a total order for the result to be
    reproducible.  ``keep`` names the columns of the result, if not all are wanted.
    """
    if not partition_by:
        return number_spread(df, order_by, name=name, keep=keep)
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    number = F.row_number().over(W.partitionBy(*partition_by).orderBy(*order)).cast("bigint")
    kept = _kept(df, name, keep)
    groups = {c: f"__g{i}" for i, c in enumerate(partition_by)}
    hot = df.groupBy(*[F.col(c).alias(g) for c, g in groups.items()]).agg(
        F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > hot_rows).drop("__rows")
    hot = materialize(hot, "hot-groups")
    if hot.isEmpty():
        return df.select(*kept, number.alias(name))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(g)) for c, g in groups.items()])
    small = df.join(hot, same, "left_anti").select(*kept, number.alias(name))
    great = number_spread(df.join(hot, same, "left_semi"), order_by, partition_by=partition_by, name=name, keep=keep)
    return small.unionByName(great)


def _kept(df: DataFrame, name: str, keep: Sequence[str] | None) -> list[str]:
    return [c for c in (df.columns if keep is None else keep) if c != name]


def number_spread(
    df: DataFrame,
    order_by: Sequence[str | Column],
    *,
    partition_by: Sequence[str] = (),
    name: str = "row_number",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Positions without a group, or the table, in one task.

    The rows are range-partitioned on group and order key together, so a group that
    holds a third of the table spreads over a third of the partitions.  The sorted
    rows are written once; after that a row's place is its index in its partition
    plus the group's row counts in earlier partitions.
    """
    keys = [F.col(c) for c in partition_by]
    order = [*keys, *[F.col(c) if isinstance(c, str) else c for c in order_by]]
    kept = _kept(df, name, keep)
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*dict.fromkeys([*kept, *partition_by]), F.monotonically_increasing_id().alias(_SLOT)),
        name,
    ).withColumn(_PART, F.shiftright(_SLOT, _LOW_BITS))

    if not partition_by:
        # One row per partition, so this table is bounded by the partition count.
        sizes = placed.groupBy(_PART).agg(
            F.count(F.lit(1)).alias("__n"), F.min(_SLOT).alias("__first"))
        before = F.coalesce(
            F.sum("__n").over(W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        starts = F.broadcast(
            sizes.select(_PART, (before - F.col("__first") + 1).alias("__shift")))
        joined = placed.join(starts, _PART)
    else:
        # At most one row per group and partition; joined on both, so no key is hot.
        renamed = [f"__g{i}" for i in range(len(partition_by))]
        sizes = placed.groupBy(_PART, *[F.col(c).alias(r) for c, r in zip(partition_by, renamed)])
        sizes = sizes.agg(F.count(F.lit(1)).alias("__n"), F.min(_SLOT).alias("__first"))
        within = W.partitionBy(*renamed).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
        starts = sizes.select(
            F.col(_PART).alias("__p"), *renamed,
            (F.coalesce(F.sum("__n").over(within), F.lit(0)) - F.col("__first") + 1)
            .alias("__shift"))
        # stored, so that its size is known and the rows are not shuffled for it
        starts = broadcast_if_small(materialize(starts, "starts"))
        same = F.col(_PART) == F.col("__p")
        for c, r in zip(partition_by, renamed):
            same = same & F.col(c).eqNullSafe(F.col(r))
        joined = placed.join(starts, same)
    number = (F.col(_SLOT) + F.col("__shift")).cast("bigint")
    return joined.select(*kept, number.alias(name))
