"""Hashed features of distinct words, and bounded samples of labelled documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .arrow_text import MIX, mixed, raw, string_hashes

#: Bytes in a character feature, the marks around a word included.
GRAMS = (3, 4, 5)


def word_features(vocabulary: pa.Array, word_bits: int, gram_bits: int):
    """Of every word: its bucket; its character grams' buckets, and where each word's grams begin.

    A gram is GRAMS bytes of the word between two marks. A word of one byte has one gram.
    """
    hashes = mixed(string_hashes(vocabulary))
    buckets = (hashes >> np.uint64(64 - word_bits)).astype(np.int32)
    data, offsets = raw(vocabulary.cast(pa.large_string()))
    n, sizes = len(offsets) - 1, np.diff(offsets)
    marked = np.full(int(sizes.sum()) + 2 * n, 1, np.uint64)  # a mark before, a mark after
    begin = offsets[:-1] - offsets[0] + 2 * np.arange(n)
    inside = np.ones(len(marked), bool)
    inside[begin] = inside[begin + sizes + 1] = False
    marked[inside] = data[offsets[0]:offsets[-1]]
    marked[begin + sizes + 1] = 2
    owner = np.repeat(np.arange(n), sizes + 2)
    left = np.repeat(begin + sizes + 2, sizes + 2) - np.arange(len(marked))  # bytes to the end
    found, of = [], []
    rolled = np.zeros(len(marked), np.uint64)
    for size in range(1, max(GRAMS) + 1):
        shifted = marked[size - 1:]
        rolled = rolled[:len(shifted)] * MIX + shifted
        if size in GRAMS:
            whole = np.flatnonzero(left[:len(shifted)] >= size)
            found.append((mixed(rolled[whole] + np.uint64(size)) >> np.uint64(64 - gram_bits)).astype(np.int32))
            of.append(owner[whole])
    grams, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return buckets, grams[order], np.searchsorted(of[order], np.arange(n + 1))


def gram_means(table: np.ndarray, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of each word's rows of ``table``; words have at least one gram."""
    out = np.empty((len(bounds) - 1, *table.shape[1:]), table.dtype)
    for a in range(0, len(out), 16384):
        b = min(len(out), a + 16384)
        rows = table[grams[bounds[a]:bounds[b]]]
        out[a:b] = np.add.reduceat(rows, bounds[a:b] - bounds[a], axis=0)
    sizes = np.diff(bounds)
    return out / (sizes[:, None] if table.ndim > 1 else sizes)


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``; null for null."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: Column, limits: dict[int, int], most_bytes: int,
) -> DataFrame:
    """doc_id, text, label of at most limits[label] doc_ids of each label and ``most_bytes`` of text.

    Whole texts, taken by the hash of their doc_id, so the sample is the same in every run; a text of
    over an eighth of ``most_bytes`` is not learnt from. A doc_id counts once: of its labels the
    greatest, of its texts the least. Null labels and doc_ids are left out.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), label.cast("int").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = [known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
             for value, n in limits.items()]
    sample = parts[0]
    for part in parts[1:]:
        sample = sample.unionAll(part)
    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "coalesce(CAST(text AS string), '') AS text")
    rows = rows.where(F.octet_length("text") <= most_bytes // 8)
    rows = rows.join(F.broadcast(sample), "doc_id")  # of the size given by the limits
    rows = materialize(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over no more rows than the limits give
    sizes = rows.select("doc_id", F.octet_length("text").alias("size")).withColumn("total", F.sum("size").over(order))
    return rows.join(F.broadcast(sizes.where(F.col("total") <= most_bytes).select("doc_id")), "doc_id")
