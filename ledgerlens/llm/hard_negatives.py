"""Operator 13: hard negatives by coordinate pruning over length buckets (as in LEMP).

Components become integers, floor(scale * x). Vectors are ordered by label and length and cut into
buckets of equal size, so a bucket holds few labels and similar lengths. A search asks for the rows of
a bucket whose inner product with an anchor reaches a threshold. Divided by the anchor's length and the
greatest length in the bucket this is a bound on the cosine: the bucket is skipped if it is over 1.
Otherwise the directions that reach it are a cap around the anchor's direction, and in every
coordinate the cap spans a range of values. For the anchor's FOCUS greatest coordinates, the bucket's
sorted lists give the rows whose value lies in that range; rows in all of them are candidates, and
these alone are verified by exact integer products.

Two searches: positives, the best rows of the anchor's label, whose threshold starts at the kth best
in the anchor's own bucket; then negatives, rows of other labels between two shares of a positive's
score. Anchors come in blocks; each pair of a block and a bucket that a search needs is one row of a
shuffled table, of bounded size, so the work is dealt over all tasks, nothing passes through the
driver and no block waits for another one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..session import materialize

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative scores between these hundredths of a positive's score.
LOW, HIGH = 50, 95
#: Vectors in a bucket, anchors in a block, focus coordinates of an anchor.
BUCKET, BLOCK, FOCUS = 8192, 2048, 4
#: Products of whole numbers below this are exact in doubles.
EXACT = 2.0 ** 53
#: A cap is widened by this, far above rounding errors of a cosine.
SLACK = 1e-9


def whole_vectors(rows: DataFrame, label: Column, scale: int) -> DataFrame:
    """vec_id, label, vector of whole numbers (as doubles), its length; rows that take part alone."""
    whole = ("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, "
             "x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    cast = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
                       F.col("embedding").cast("array<double>").alias("embedding"))
    scaled = f"transform(embedding, x -> CAST(floor({scale} * x) AS double)) AS vector"
    return cast.where(whole).selectExpr("vec_id", "label", scaled).withColumns({
        "dimensions": F.size("vector"), "length": F.sqrt(F.expr("aggregate(vector, 0D, (n, x) -> n + x * x)"))})


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    flat = pa.chunked_array(table.column("vector")).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return (*(table.column(c).to_numpy().astype(np.int64) for c in ("number", "vec_id", "label")),
            flat.reshape(table.num_rows, -1))


PACKED = ("dimensions int, low_label bigint, high_label bigint, numbers binary, ids binary, labels binary, "
          "vectors binary, floors binary")


def pack(group: str, has_floors: bool):
    """Arrays of the rows of one bucket (or block) and dimension; small components take two bytes."""

    def run(table: pa.Table) -> pa.Table:
        numbers, ids, labels, vectors = _arrays(table)
        small = not vectors.size or np.abs(vectors).max() < 2 ** 15
        floors = table.column("floor").to_numpy().astype(np.float64) if has_floors else np.zeros(0)
        blobs = {"numbers": numbers, "ids": ids, "labels": labels,
                 "vectors": vectors.astype(np.int16) if small else vectors, "floors": floors}
        return pa.table({
            group: table.column(group).slice(0, 1), "dimensions": pa.array([vectors.shape[1]], pa.int32()),
            "low_label": pa.array([labels.min()]), "high_label": pa.array([labels.max()]),
            **{name: pa.array([values.tobytes()], pa.binary()) for name, values in blobs.items()}})

    return run


def unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    numbers, ids, labels = (np.frombuffer(row[prefix + c], np.int64) for c in ("numbers", "ids", "labels"))
    blob = row[prefix + "vectors"]
    kind = np.int16 if len(blob) == 2 * len(ids) * row["dimensions"] else np.float64
    return numbers, ids, labels, np.frombuffer(blob, kind).reshape(len(ids), row["dimensions"]).astype(np.float64)


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; those beyond 64 bits become the nearest value that has 64."""
    if not vectors.size:
        return np.zeros(len(vectors), np.int64)
    bound = float(np.abs(vectors).max()) * float(np.abs(query).sum())
    if bound < EXACT:
        return (vectors @ query).astype(np.int64)
    whole = [int(x) for x in query.tolist()]
    exact = (sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in vectors.tolist())
    return np.array([max(-2**63, min(2**63 - 1, score)) for score in exact], np.int64)


class Bucket:
    """Vectors with the sorted list of every coordinate of their directions."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.numbers, self.ids, self.labels, self.vectors = numbers, ids, labels, vectors
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        self.longest = float(lengths.max()) if len(ids) else 0.0
        self.directions = vectors / np.maximum(lengths, 1e-300)[:, None]
        self.order: dict[int, np.ndarray] = {}
        self.sorted: dict[int, np.ndarray] = {}

    def coordinate(self, axis: int) -> tuple[np.ndarray, np.ndarray]:
        if axis not in self.order:
            self.order[axis] = np.argsort(self.directions[:, axis], kind="stable")
            self.sorted[axis] = self.directions[self.order[axis], axis]
        return self.order[axis], self.sorted[axis]

    def candidates(self, query: np.ndarray, threshold: float, focus: int = FOCUS) -> np.ndarray:
        """Places of rows that can reach the threshold, and of some that do not."""
        everything = np.arange(len(self.ids))
        length = float(np.sqrt((query * query).sum()))
        if threshold <= 0:  # shorter rows reach what is not above 0 in any direction
            return everything
        reach = length * self.longest
        if reach == 0 or threshold / reach > 1 + SLACK:
            return everything[:0]
        # the cap of directions around the anchor's, as an angle
        cap = math.acos(min(1.0, threshold / reach)) + math.sqrt(SLACK)
        axes = np.argsort(-np.abs(query), kind="stable")[:focus].tolist()
        spans = []
        for axis in axes:
            angle = math.acos(max(-1.0, min(1.0, query[axis] / length)))
            low = -2.0 if angle + cap >= math.pi else math.cos(angle + cap) - SLACK
            high = 2.0 if angle <= cap else math.cos(angle - cap) + SLACK
            _, values = self.coordinate(axis)
            begin, end = np.searchsorted(values, low), np.searchsorted(values, high, side="right")
            spans.append((end - begin, axis, begin, end, low, high))
        spans.sort()
        size, axis, begin, end, _, _ = spans[0]
        if size == len(self.ids):
            return everything
        found = self.coordinate(axis)[0][begin:end]
        for size, axis, _, _, low, high in spans[1:]:
            if size < len(self.ids):
                values = self.directions[found, axis]
                found = found[(values >= low) & (values <= high)]
        return found


def best(ids: np.ndarray, numbers: np.ndarray, scores: np.ndarray, k: int) -> list[int]:
    """Places of the k highest scores, ties to the smaller id, then by number."""
    kept = np.arange(len(ids))
    if len(ids) > 4 * k:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    # ~ reverses the order of 64-bit numbers without leaving their range
    return kept[np.lexsort((numbers[kept], ids[kept], ~scores[kept]))][:k].tolist()


ANCHORS = "number bigint, vec_id bigint, label bigint, dimensions int, vector array<double>, floor double"


def add_floors(k: int):
    """Anchors of a bucket with the kth best score among the rows of their label and bucket."""

    def run(table: pa.Table) -> pa.Table:
        _, ids, labels, vectors = _arrays(table)
        anchors = np.flatnonzero(table.column("is_anchor").to_numpy())
        floors = []
        for at in anchors.tolist():
            scores = products(vectors[(labels == labels[at]) & (ids != ids[at])], vectors[at])
            enough = len(scores) >= k
            floors.append(below(np.partition(scores, len(scores) - k)[len(scores) - k]) if enough else -np.inf)
        kept = table.take(pa.array(anchors)).select(["number", "vec_id", "label", "dimensions", "vector"])
        return kept.append_column("floor", pa.array(floors, pa.float64()))

    return run


def below(score) -> float:
    """A double under a whole number, so that no tie is lost."""
    return float(np.nextafter(float(score), -np.inf))


def cells(buckets: DataFrame, blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each (bucket, block) of ``pairs`` with the arrays of both, dealt over all tasks."""
    spark = buckets.sparkSession
    pairs = materialize(pairs, "cells")
    # at most 32 cells, some 40 MB, in a task
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs.count() / 32))
    keys = ["bucket", "block"]
    left = buckets.drop("floors", "low_label", "high_label").join(pairs, "bucket").repartition(n, *keys)
    named = {c: f"a_{c}" for c in ("numbers", "ids", "labels", "vectors")}
    right = blocks.drop("low_label", "high_label").withColumnsRenamed({**named, "dimensions": "width"}).join(
        pairs, "block").repartition(n, *keys)
    return left.hint("merge").join(right, keys).where("width = dimensions").drop("width")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _found(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


POSITIVE = "anchor bigint, anchor_id bigint, positive bigint, positive_id bigint, positive_score bigint"
NEGATIVE = ("anchor bigint, anchor_id bigint, positive bigint, positive_id bigint, positive_score bigint, "
            "negative bigint, negative_id bigint, negative_score bigint")


def find_positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            bucket, floors = Bucket(*unpacked(row)), np.frombuffer(row["floors"])
            out = []
            for at, (number, anchor, label, vector) in enumerate(zip(*unpacked(row, "a_"), strict=True)):
                place = bucket.candidates(vector, floors[at])
                place = place[(bucket.labels[place] == label) & (bucket.ids[place] != anchor)]
                scores = products(bucket.vectors[place], vector)
                for i in best(bucket.ids[place], bucket.numbers[place], scores, k):
                    out.append((number, anchor, bucket.numbers[place[i]], bucket.ids[place[i]], scores[i]))
            yield _found(out, POSITIVE)

    return run


def find_negatives(k: int, low: int, high: int):
    """For every positive of an anchor the k best of a bucket within its range of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            bucket = Bucket(*unpacked(row))
            wanted = {w["anchor"]: w["positives"] for w in row["wanted"]}
            out = []
            for number, anchor, label, vector in zip(*unpacked(row, "a_"), strict=True):
                # of a positive with a score below 0 the range is empty
                positives = [p for p in wanted.get(int(number), []) if p["positive_score"] >= 0]
                if not positives:
                    continue
                ranges = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in positives]
                place = bucket.candidates(vector, below(min(least for least, _ in ranges)))
                place = place[bucket.labels[place] != label]
                scores = products(bucket.vectors[place], vector)
                for p, (least, most) in zip(positives, ranges, strict=True):
                    fit = np.flatnonzero((scores >= least) & (scores <= most))
                    for i in fit[best(bucket.ids[place[fit]], bucket.numbers[place[fit]], scores[fit], k)]:
                        out.append((number, anchor, p["positive"], p["positive_id"], p["positive_score"],
                                    bucket.numbers[place[i]], bucket.ids[place[i]], scores[i]))
            yield _found(out, NEGATIVE)

    return run


def hard_negatives(
    rows: DataFrame, is_anchor: Column, label: Column | None = None, *, scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    bucket: int = BUCKET, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of every anchor's ``positives`` best rows of its label, the ``negatives`` best rows of other labels
    that score between ``low`` and ``high`` hundredths of the positive's score. Higher scores come
    first, ties by the smaller vec_id. Rows with a null vec_id, label or vector, or with null or
    non-finite components take no part; vectors of another length than the anchor's are no
    candidates, nor are rows with its vec_id. Repeated rows are anchors, positives and negatives of
    their own. A positive without a row in its range gives none, as does an empty table. Components
    and scores beyond 64 bits count as the nearest number of 64 bits. Only vec_id, embedding and
    label are read.
    """
    vectors = whole_vectors(rows, F.col("label") if label is None else label, scale)
    placed = number_rows(vectors, ["label", F.desc("length"), "vec_id", "vector"], name="number")
    placed = placed.withColumns({
        "bucket": F.expr(f"(number - 1) div {bucket}"), "is_anchor": is_anchor})
    placed = materialize(placed, "vectors")
    grouped = placed.groupBy("bucket", "dimensions")
    buckets = materialize(grouped.applyInArrow(pack("bucket", False), f"bucket bigint, {PACKED}"), "buckets")
    anchors = number_rows(grouped.applyInArrow(add_floors(positives), ANCHORS), ["number"], name="nth")
    anchors = materialize(anchors.withColumn("block", F.expr(f"(nth - 1) div {block}")), "anchors")
    blocks = materialize(anchors.groupBy("block", "dimensions").applyInArrow(
        pack("block", True), f"block bigint, {PACKED}"), "blocks")

    same = placed.select("label", "bucket").distinct().join(
        anchors.select("label", "block").distinct(), "label").select("bucket", "block").distinct()
    found = cells(buckets, blocks, same).mapInArrow(find_positives(positives), POSITIVE)
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    wanted = found.groupBy("anchor").agg(
        F.collect_list(F.struct("positive", "positive_id", "positive_score")).alias("positives"))
    # of a block's anchors, each with its few positives
    wanted = anchors.select("block", F.col("number").alias("anchor")).join(wanted, "anchor").groupBy("block").agg(
        F.collect_list(F.struct("anchor", "positives")).alias("wanted"))

    last = blocks.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0]
    all_blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))) if last >= 0 else F.explode(
        F.array().cast("array<bigint>"))
    spans = ["low_label", "high_label"]
    near = buckets.select("bucket", *spans).withColumn("block", all_blocks).join(
        blocks.select("block", *[F.col(c).alias(f"a_{c}") for c in spans]), "block")
    one = "low_label = high_label AND a_low_label = a_high_label AND low_label = a_low_label"
    other = near.where(f"NOT ({one})").select("bucket", "block").distinct()
    given = materialize(blocks.join(wanted, "block"), "wanted")
    found = cells(buckets, given, other).mapInArrow(find_negatives(negatives, low, high), NEGATIVE)
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id", "negative")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
