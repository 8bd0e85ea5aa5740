"""Flat CSV files: read as text, written with a fixed or a preferred column order."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import contract as C
from ledgerlens.functions.text import BOM
from ledgerlens.session import setting
from ledgerlens.sources.csv_split import read_files, record_counts
from ledgerlens.sources.shared_files import exists

#: Files that a task holds open while it writes a folder for each value of a column.
OPEN_FILES = 64
FILE_ORDER = ["csv_file", "csv_block", "csv_row"]


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    multi_line: bool = True,
    with_order: bool = False,
) -> DataFrame:
    """All columns as text, missing cells as ''; columns of several files meet by name.

    Line breaks inside quotes are cells' own; large files are read in many tasks all the same, see
    ``csv_split``.  Without ``multi_line`` every line is a row and Spark's reader does it alone: faster
    for files known to have no such breaks, but their headers must be the same or it fails.
    ``with_order`` adds FILE_ORDER: file, block and row order, a total order key.
    """
    if multi_line:
        rows = read_files(spark, path)
        names = [c for c in rows.columns if c not in ("__file", "__record")]
        order = [F.col("__file").alias("csv_file"), F.lit(0).cast("bigint").alias("csv_block"),
                 F.col("__record").alias("csv_row")]
        return rows.select(*[F.col(f"`{c}`") for c in names], *(order if with_order else []))
    frame = (
        spark.read.option("header", True)
        .option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("recursiveFileLookup", True).option("enforceSchema", False)
        .csv(path if isinstance(path, str) else list(path)))
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.removeprefix(BOM))
             for c in frame.columns]
    if not with_order:
        return frame.select(*cells)
    return frame.select(
        *cells,
        F.col("_metadata.file_path").alias("csv_file"),
        F.col("_metadata.file_block_start").alias("csv_block"),
        F.monotonically_increasing_id().alias("csv_row"))


def csv_columns(columns: Sequence[str], preferred: Sequence[str], *, empty: bool = False):
    """Preferred columns that are present (all of them when there are no rows), then
    the others by name."""
    first = [c for c in preferred if empty or c in columns]
    return [*first, *sorted(set(columns) - set(first))]


def _as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = [
        F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in df.columns
        else F.lit("").alias(c) for c in columns]
    return df.select(*cells)


def write_csv(
    df: DataFrame, path: str, columns: Sequence[str], *, mode: str = "overwrite", bom: bool = True,
    partition_by: Sequence[str] = (),
) -> None:
    """Exactly ``columns``, extra ones left out; files start with a BOM like the published ones."""
    text = _as_text(df, [*columns, *[c for c in partition_by if c not in columns]])
    if bom:
        text = text.withColumnRenamed(columns[0], BOM + columns[0])
    writer = (text.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
              .option("emptyValue", "").option("nullValue", "").option("lineSep", "\n")
              .option("ignoreLeadingWhiteSpace", False)
              .option("ignoreTrailingWhiteSpace", False).partitionBy(*partition_by))
    # a task keeps so many folders' files open at a time; only rows of further folders are sorted
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", OPEN_FILES):
        writer.csv(path)


def write_source_csv(df: DataFrame, path: str, preferred: Sequence[str], **options) -> None:
    """Preferred columns first, then whatever else the source delivered."""
    write_csv(df, path, csv_columns(df.columns, preferred), **options)


def write_csv_by_year(
    df: DataFrame, path: str, preferred: Sequence[str], *, year: str = "ano", **options
) -> None:
    """One folder per year; the year also stays in the rows."""
    dated = df.withColumn("year", F.col(year).cast("int"))
    write_csv(
        dated, path, csv_columns(df.columns, preferred), partition_by=["year"], **options)


def csv_row_counts(spark: SparkSession, path: str) -> DataFrame:
    """Data rows per file, header excluded; files without rows count 0."""
    counted = record_counts(spark, path).select(F.col("file").alias("path"), (F.col("n") - 1).alias("row_count"))
    return list_files(spark, path, "*").select("path").join(counted, "path", "left").select(
        "path", F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"))


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Path, time and size of files; the content column is never read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True).load(path)
        .select("path", "modificationTime", F.col("length").alias("size_bytes")))


def snapshots(spark: SparkSession, directory: str, prefix: str = C.EXPENSE_FILE_PREFIX) -> DataFrame:
    """snapshot, modified, in_folder of source files and folders of files with the prefix.

    The files of a folder, at any depth, are one snapshot, as new as its newest file.  Derived outputs
    are no sources.
    """
    place = re.sub("^[a-z0-9]+:(//[^/]*)?", "", directory).strip("/")
    here = rf"^((?:[a-z0-9]+:(?://[^/]*)?)?/\Q{place}\E/[^/]+)"
    files = list_files(spark, directory, "*.csv").withColumn("snapshot", F.regexp_extract("path", here, 1))
    files = files.withColumn("name", F.element_at(F.split("snapshot", "/"), -1))
    source = F.startswith("name", F.lit(prefix)) & ~F.contains("name", F.lit("_por_ano"))
    source = source & ~F.regexp_like("name", F.lit(r"periodos(\.csv)?\z"))
    for derived in ("clean", "ranking", "categorias"):
        source = source & ~F.contains("name", F.lit(derived))
    if prefix == C.EXPENSE_FILE_PREFIX:
        source = source & ~F.contains("name", F.lit("parlamentarios"))
    return files.where(source).groupBy("snapshot").agg(
        F.max("modificationTime").alias("modified"), F.bool_or(F.col("path") != F.col("snapshot")).alias("in_folder"))


def latest_snapshot(
    spark: SparkSession, directory: str, prefix: str = C.EXPENSE_FILE_PREFIX
) -> str | None:
    """Newest source file or finished folder with the prefix.

    A folder counts once its writer has left the marker ``_SUCCESS``; newer ones without it are passed
    over.
    """
    newest = snapshots(spark, directory, prefix).orderBy(F.desc("modified"), F.asc("snapshot"))
    for row in newest.toLocalIterator():  # as a rule the first one
        if not row.in_folder or exists(spark, f"{row.snapshot}/_SUCCESS"):
            return row.snapshot
    return None


def require_latest_snapshot(spark: SparkSession, directory: str, prefix: str) -> str:
    path = latest_snapshot(spark, directory, prefix)
    if path is None:
        raise FileNotFoundError(f"{directory}: ninguna fuente {prefix}*.csv")
    return path


def file_suffix(name, prefix: str = C.EXPENSE_FILE_PREFIX):
    """Part of a file name between prefix and extension, e.g. ``2012-01_2026-02``."""
    stem = F.regexp_replace(F.element_at(F.split(F.col(name) if isinstance(name, str) else name,
                                                 "/"), -1), r"(?<=.)\.[^.]*\z", "")
    return F.regexp_replace(stem, f"^{prefix}", "")


def suffix_period_from(suffix):
    return F.element_at(F.split(suffix, "_"), 1)


def suffix_period_to(suffix):
    parts = F.split(suffix, "_")
    return F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise(suffix)
