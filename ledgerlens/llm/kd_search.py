"""Operator 5: exact top-k by inner product with a KD-tree per shard.

Components are turned into integers, floor(scale * x). A shard of vectors is split at medians of
its widest axis into leaves; every node keeps the tight box around its vectors and the smallest
vec_id in it. The most a query can score in a box is the sum over the axes of the larger product
with the box's two sides. A query visits a tree best first, by this bound, until no box can beat its
kth best score so far; the kth score goes on from tree to tree, and all trees begin with the kth
score of a first shard, so most boxes fall at once.

Trees are stored once in the shared folder. Queries come in blocks of bounded size, each a pass over
the trees; of a query every task returns k rows for each tree at most.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SCALE, K = 1024, 10
#: Vectors in a leaf, vectors in a shard, queries in a block.
LEAF, SHARD, BLOCK = 64, 16384, 4096
SMALLEST = np.iinfo(np.int64).min


class Tree:
    """Vectors (n, dimensions) of integers with their vec_ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.begin, self.end, self.children = [], [], []
        pending = [(0, len(ids), -1)]
        while pending:
            begin, end, parent = pending.pop()
            node = len(self.begin)
            self.begin.append(begin)
            self.end.append(end)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if end - begin > leaf and vectors.shape[1]:  # vectors of length 0 are one leaf
                own = vectors[order[begin:end]]
                axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                half = (end - begin) // 2
                # ties at the median are split by vec_id, so equal vectors part into id ranges
                sorted_ = np.lexsort((ids[order[begin:end]], own[:, axis]))
                order[begin:end] = order[begin:end][sorted_]
                pending += [(begin + half, end, node), (begin, begin + half, node)]
        self.ids, self.vectors = ids[order], vectors[order]
        spans = list(zip(self.begin, self.end, strict=True))
        self.low = np.array([self.vectors[a:b].min(axis=0) for a, b in spans])
        self.high = np.array([self.vectors[a:b].max(axis=0) for a, b in spans])
        self.least = np.array([self.ids[a:b].min() for a, b in spans])

    def search(self, query_id: int, query: np.ndarray, k: int, best: list[tuple[int, int]]) -> None:
        """Update ``best``, a heap of (score, -vec_id) with the k best so far."""
        bounds = np.maximum(self.low * query, self.high * query).sum(axis=1).tolist()
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if len(best) == k:
                score, other = best[0]
                if -bound < score:
                    return
                if -bound == score and self.least[node] > -other:
                    continue
            if self.children[node]:
                for child in self.children[node]:
                    if len(best) < k or bounds[child] >= best[0][0]:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            a, b = self.begin[node], self.end[node]
            scores = self.vectors[a:b] @ query
            keep = np.arange(b - a)
            if len(best) == k:
                keep = np.flatnonzero(scores >= best[0][0])
            for i in keep.tolist():
                found = (int(scores[i]), -int(self.ids[a + i]))
                if -found[1] == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, vector (array of bigint) of rows whose vector is whole: not null, all finite."""
    whole = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) " \
            "AND abs(x) < double('infinity'))"
    rows = rows.selectExpr("CAST(vec_id AS bigint) AS vec_id", "CAST(embedding AS array<double>) AS embedding")
    return rows.where("vec_id IS NOT NULL").where(whole).selectExpr(
        "vec_id", f"transform(embedding, x -> CAST(floor({scale} * x) AS bigint)) AS vector")


TREES = "shard bigint, dimensions int, ids binary, vectors binary"


def shards(vectors: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard and dimension: its vectors in the order of a tree's leaves."""

    def pack(table: pa.Table) -> pa.Table:
        dimensions = table.column("dimensions")[0].as_py()
        ids = table.column("vec_id").to_numpy()
        flat = pa.chunked_array(table.column("vector")).combine_chunks().flatten().to_numpy()
        tree = Tree(ids, flat.reshape(len(ids), dimensions))
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()),
            "dimensions": pa.array([dimensions], pa.int32()),
            "ids": pa.array([tree.ids.tobytes()], pa.binary()),
            "vectors": pa.array([tree.vectors.tobytes()], pa.binary())})

    keyed = vectors.select("vec_id", "vector", F.size("vector").alias("dimensions"),
                           F.pmod(F.monotonically_increasing_id(), F.lit(n_shards)).alias("shard"))
    return keyed.groupBy("shard", "dimensions").applyInArrow(pack, TREES)


#: query: its number in the block.
RESULT = "query int, query_id bigint, vec_id bigint, score bigint"

KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int64())


def _search(shared, k: int, leaf: int):
    """Search a task's trees one after the other; every query's best goes on to the next tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}
        queries = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                dimensions = row["dimensions"]
                ids = np.frombuffer(row["ids"], np.int64)
                tree = Tree(ids, np.frombuffer(row["vectors"], np.int64).reshape(len(ids), dimensions), leaf)
                for at, (query_id, query, floor) in enumerate(queries):
                    if len(query) != dimensions:
                        continue
                    heap = best.setdefault(at, [])
                    if not heap and floor is not None:
                        # stand-ins at the known kth score lose every tie and are taken out below
                        heap += [(floor, SMALLEST + i) for i in range(k)]
                    tree.search(query_id, query, k, heap)
        found = [(at, queries[at][0], -other, score) for at, heap in best.items()
                 for score, other in heap if other > SMALLEST + k]
        columns = list(zip(*found, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], ["query", "query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, is_query, k: int = K, scale: int = SCALE, shard: int = SHARD,
          block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row that ``is_query`` holds for.

    Ties go to the smaller vec_id; a query's own vec_id is no candidate. Rows with a null vec_id,
    a null vector, or null or non-finite components take no part; vectors of another length than
    the query's are no candidates. Fewer candidates give fewer rows; an empty table gives none.
    Repeated rows are candidates, or queries, of their own. Scores that do not fit
    64 bits are not defined; vectors of length 0 score 0 among each other. Only vec_id and embedding are read.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, scale)
    total = vectors.count()
    n_shards = max(1, math.ceil(total / shard))
    trees = materialize(shards(vectors, n_shards), "kd-shards")
    queries = vectors.where(is_query)
    n_blocks = max(1, math.ceil(queries.count() / block))
    queries = materialize(queries, "kd-queries")
    found = []
    for b in range(n_blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)) == b).collect()
        plain = [(r.vec_id, np.array(r.vector, np.int64), None) for r in mine]
        first = trees.where("shard = 0").mapInArrow(_search(spark.sparkContext.broadcast(plain), k, leaf), RESULT)
        floors = _kth(first, k)
        bounded = [(i, v, floors.get(at)) for at, (i, v, _) in enumerate(plain)]
        shared = spark.sparkContext.broadcast(bounded)
        spread = trees.repartition(n_shards, "shard")
        found.append(spread.mapInArrow(_search(shared, k, leaf), RESULT).withColumn("block", F.lit(b)))
    scores = reduce(DataFrame.unionAll, found)
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _kth(found: DataFrame, k: int) -> dict[int, int]:
    """The kth score of queries that have k: a block of queries has a bounded number of rows."""
    kept: dict[int, list[int]] = {}
    for row in found.collect():
        kept.setdefault(row.query, []).append(row.score)
    return {at: sorted(s)[-k] for at, s in kept.items() if len(s) >= k}
