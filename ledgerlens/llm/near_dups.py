"""Operator 7: near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

1. Every text becomes a set of word shingles and HASHES minima. Bands of ROWS minima make candidate
   keys; of each minimum the low BITS bits are kept, packed into 64-bit words.
2. Equal sets are one node. In each band bucket all nodes are candidates of one pivot only, so a
   bucket of any size gives a pair per member. Packed signatures of the pair are compared by bit
   counts, corrected for the chance that differing minima agree in their low bits. Pairs that
   could be near the threshold tie nodes into families. Nodes far from their pivot meet again in
   buckets of two bands: two sets of similarity 0.8 share about 90 of these, others of 0.5 one. Bands
   whose nodes all have the same near pivot are left out of these.
3. Members of a family are compared on their full sets: whatever lies within the threshold is
   linked, not just with the pivot. Families are dealt in blocks of bounded size, each pair of
   blocks to one task; inside, nodes close to a well connected one are linked first, and the rest
   is found by a prefix filter: two sets that are similar enough share one of their rarest shingles.
4. Components of the links are found on Spark by contraction.

With ROWS = 5 and 220 minima two sets of similarity 0.8 miss each other in all bands with
probability (1 - 0.8**5)**44 = 2.6e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .arrow_text import chunks, mixed, shingle_hashes, string_hashes, words
from .components import components

BITS, ROWS, BANDS = 2, 5, 44
HASHES = ROWS * BANDS
SIGNATURE_WORDS = -(-HASHES * BITS // 64)
#: Families are made of pairs whose estimate is at most this far under the threshold: 7.8 standard
#: deviations of the estimate at 0.8.
MARGIN = 0.25
#: Nodes of a bucket that make few finer keys, whether or not they are near each other.
FEW = 2
#: Bytes of text taken at a time.
TEXT_BYTES = 8 << 20
#: Nodes and bytes of sets in a block of a family.
BLOCK_NODES, BLOCK_BYTES = 2048, 8 << 20

_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, (2, HASHES), np.uint64)
MULTIPLIERS, ADDENDS = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]


def shingle_sets(text: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; a shorter text is one shingle."""
    found = words(text)
    hashes = string_hashes(found.vocabulary)[found.index]
    shingles = shingle_hashes(hashes, size)
    out = []
    for begin, end in zip(found.offsets[:-1], found.offsets[1:], strict=True):
        if end - begin >= size:
            out.append(np.unique(shingles[begin:end - size + 1]))
        else:
            out.append(shingle_hashes(hashes[begin:end], int(end - begin))[:1])
    return [s if len(s) else np.zeros(0, np.uint64) for s in out]


def minima(shingles: np.ndarray) -> np.ndarray:
    """Minima of HASHES hash functions over a set that is not empty."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(shingles), 512):
        x = shingles[begin:begin + 512, None] * MULTIPLIERS + ADDENDS
        x ^= x >> np.uint64(32)
        out = np.minimum(out, x.min(axis=0))
    return out


def packed(values: np.ndarray) -> np.ndarray:
    """Low bits of minima, 64 // BITS of them in a word."""
    low = np.zeros(SIGNATURE_WORDS * (64 // BITS), np.uint64)
    low[:HASHES] = mixed(values) & np.uint64((1 << BITS) - 1)
    shifts = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(SIGNATURE_WORDS, -1) << shifts, axis=1)


def band_keys(values: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for row in values.reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def set_key(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _lists(values: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (the set's hash; null for no words), bands, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=TEXT_BYTES):
            nodes, bands, packs, sizes = [], [], [], []
            for s in shingle_sets(chunk.column("text"), shingle):
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None)
                    bands.append(s)
                    packs.append(s)
                    continue
                least = minima(s)
                nodes.append(set_key(s))
                bands.append(band_keys(least))
                packs.append(packed(least))
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"), "text_key": chunk.column("text_key"),
                "n_shingles": pa.array(sizes, pa.int64()),
                "node": pa.array(nodes, pa.int64()), "bands": _lists(bands),
                "signature": _lists(packs)})

    return docs.mapInArrow(run, "doc_id bigint, text_key bigint, n_shingles bigint, node bigint, "
                                "bands array<bigint>, signature array<bigint>")


def estimate(left: str, right: str):
    """Similarity by bit counts of two packed signatures, corrected for chance agreement."""
    ones = int("01" * (64 // BITS), 2) if BITS == 2 else None
    differ = " + ".join(
        f"bit_count(({x} | shiftrightunsigned({x}, 1)) & {ones}L)"
        for x in (f"({left}[{k}] ^ {right}[{k}])" for k in range(SIGNATURE_WORDS)))
    chance = 1 / (1 << BITS)
    return F.expr(f"((1 - ({differ}) / {HASHES}D) - {chance}D) / {1 - chance}D")


def buckets(keyed: DataFrame) -> DataFrame:
    """node, key and pivot, the smallest node of the key, of the keys that two nodes or more have."""
    pivots = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
    return keyed.join(pivots.where("pivot <> last").select("key", "pivot"), "key")


def near_pivots(met: DataFrame, nodes: DataFrame, floor: float) -> DataFrame:
    """node, pivot, near of the pairs of a node and the pivot of one of its buckets."""
    pairs = met.where("node <> pivot").select("node", "pivot").distinct()
    left = nodes.select("node", F.col("signature").alias("x"))
    right = nodes.select(F.col("node").alias("pivot"), F.col("signature").alias("y"))
    both = pairs.join(left, "node").join(right, "pivot")
    return materialize(both.select("node", "pivot", (estimate("x", "y") >= floor).alias("near")), "pivots")


def open_keys(met: DataFrame, judged: DataFrame) -> DataFrame:
    """Keys (``key``) of the buckets that may hold nodes of different families.

    A bucket all of whose nodes have the same least near pivot, or are that one, lies in one family, and
    members of a family are compared with each other anyway. Buckets of FEW nodes are taken unseen.
    """
    homes = judged.where("near").groupBy("node").agg(F.min("pivot").alias("home"))
    home = F.coalesce("home", "node")
    keys = met.join(homes, "node", "left").groupBy("key").agg(
        F.min(home).alias("low"), F.max(home).alias("high"), F.count(F.lit(1)).alias("n"))
    return keys.where((F.col("low") != F.col("high")) | (F.col("n") <= FEW)).select("key")


def families(nodes: DataFrame, floor: float) -> DataFrame:
    """node and family of nodes that may be near another one. ``nodes``: node, bands, signature.

    Nodes far from a bucket's pivot may be near each other: they meet again in finer buckets, by
    the shared key together with each other band, each two bands once. Bands that ``open_keys`` leaves
    out bring nobody together who is not yet, alone or with another one.
    """
    met = materialize(buckets(nodes.select("node", F.explode("bands").alias("key"))), "buckets")
    judged = near_pivots(met, nodes, floor)
    common = met.join(open_keys(met, judged), "key").groupBy("node").agg(
        F.collect_set("key").alias("bands"))  # at most BANDS of a node
    far = judged.where("NOT near").join(common, "node").join(
        common.select(F.col("node").alias("pivot"), F.col("bands").alias("pivot_bands")), "pivot")
    far = far.groupBy("node", "bands").agg(F.array_distinct(F.flatten(F.collect_list(
        F.array_intersect("bands", "pivot_bands")))).alias("shared"))
    finer = materialize(far.select("node", F.explode(F.expr(
        "flatten(transform(shared, s -> transform("
        "filter(bands, b -> s < b OR NOT array_contains(shared, b)), b -> b ^ s)))")).alias("key")), "finer")
    near = reduce(DataFrame.unionAll, [
        found.where("near").selectExpr("node AS a", "pivot AS b")
        for found in (judged, near_pivots(buckets(finer), nodes, floor))])
    return components(near).withColumnRenamed("label", "family")


class Forest:
    """Union of nodes by index."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links 100 * |A & B| >= percent * |A | B| between all the sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    begin = np.concatenate(([0], np.cumsum(count)))
    postings = owner[order]
    first = np.concatenate(([0], np.cumsum(sizes)))
    forest, links = Forest(n), []

    def shared_with(x: int) -> np.ndarray:
        codes = code[first[x]:first[x + 1]]
        hit = np.concatenate([postings[begin[c]:begin[c + 1]] for c in codes])
        return np.bincount(hit, minlength=n)

    def near(x: int) -> np.ndarray:
        both = shared_with(x)
        return np.flatnonzero(100 * both >= percent * (sizes[x] + sizes - both))

    # nodes whose shingles are the most common draw the greatest stars
    weight = np.bincount(owner, weights=count[code], minlength=n) / sizes
    alone = np.ones(n, bool)
    for x in np.argsort(-weight, kind="stable").tolist():
        if not alone[x]:
            continue
        star = near(x)
        links += [(x, int(y)) for y in star if y != x and forest.join(x, int(y))]
        alone[star] = False
        if len(star) < 8:  # nothing left that gathers many
            break
    # the rest: rarest shingles first; sets that are similar enough share one within their prefix
    rank = np.argsort(np.argsort(count, kind="stable"), kind="stable")[code]
    by_rank = np.lexsort((rank, owner))
    place = np.arange(len(flat)) - first[owner]
    prefix = sizes - -(-percent * sizes // 100) + 1
    keep = by_rank[place < prefix[owner]]
    lists: dict[int, list[int]] = {}
    for c, x in zip(code[keep].tolist(), owner[keep].tolist(), strict=True):
        lists.setdefault(c, []).append(x)
    tried = set()
    for members in lists.values():
        if len(members) < 2:
            continue
        by_root: dict[int, list[int]] = {}
        for x in members:
            by_root.setdefault(forest.find(x), []).append(x)
        groups = sorted(by_root.values(), key=len)
        # all pairs of members that are in different groups, the largest group's own left out
        for g, group in enumerate(groups[:-1]):
            for x in group:
                for other in groups[g + 1:]:
                    for y in other:
                        if forest.find(x) == forest.find(y):
                            break
                        pair = (x, y) if x < y else (y, x)
                        small, large = sorted((int(sizes[x]), int(sizes[y])))
                        if pair in tried or 100 * small < percent * large:
                            continue
                        tried.add(pair)
                        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if 100 * both >= percent * (small + large - both):
                            forest.join(x, y)
                            links.append(pair)
    return links


def confirmed(members: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes, by full sets.

    ``members``: node, family, and of one row with that set ``of``: its doc_id and text_key.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=TEXT_BYTES):
            found = shingle_sets(chunk.column("text"), shingle)
            yield pa.RecordBatch.from_pydict({
                "node": chunk.column("node"), "family": chunk.column("family"),
                "shingles": pa.array([s.tobytes() for s in found], pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        _, once = np.unique(nodes, return_index=True)
        blobs = table.column("shingles").take(pa.array(once)).to_pylist()
        nodes = nodes[once]
        links = linked([np.frombuffer(b, np.uint64) for b in blobs], percent) if len(nodes) > 1 else []
        at = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(nodes[at[:, 0]]), "b": pa.array(nodes[at[:, 1]])})

    members = members.select("node", "family", F.col("of.text_key").alias("text_key"),
                             F.col("of.doc_id").alias("of_doc"))
    same = (docs["text_key"] == members["text_key"]) & docs["doc_id"].eqNullSafe(members["of_doc"])
    of_texts = docs.join(members, same).select("node", "family", "text")
    stored = materialize(of_texts.mapInArrow(sets, "node bigint, family bigint, shingles binary"), "sets")
    size = stored.groupBy("family").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum(F.octet_length("shingles")) / BLOCK_BYTES),
                   F.lit(1)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = stored.join(size, "family").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "shingles", "family", F.least("own", "other").alias("i"),
                         F.greatest("own", "other").alias("j"))
    return dealt.groupBy("family", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key for every row.

    Rows are linked if 100 times the number of their common shingles is at least ``percent`` times
    that of all their shingles; a text of fewer words than a shingle is one shingle. Texts without
    words, empty and null ones are linked with nothing and all kept under their own doc_id.
    component_id is the smallest doc_id reachable (null where no row has one), and the row that
    bears it is kept; rows without a doc_id come last, by text_key, a hash of the text. Repeated
    rows have one component and are kept, or not, together. Only doc_id and text are read.
    """
    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS string) AS text")
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    signed = materialize(signatures(rows, shingle), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min(row).alias("of"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    nodes = materialize(nodes, "nodes")
    grouped = families(nodes.select("node", "bands", "signature"), percent / 100 - MARGIN)
    members = nodes.select("node", "of").join(grouped, "node")
    labels = components(confirmed(members, rows, shingle, percent))
    known = nodes.select("node", "of").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    roots = known.groupBy("label").agg(F.min("of").alias("root"))
    known = known.join(roots, "label").select("node", "root")
    out = signed.select("doc_id", "text_key", "n_shingles", "node").join(known, "node", "left")
    single = F.col("node").isNull()
    is_root = F.col("doc_id").eqNullSafe(F.col("root.doc_id")) & (F.col("text_key") == F.col("root.text_key"))
    return out.select(
        "doc_id", "n_shingles", F.when(single, F.col("doc_id")).otherwise(F.col("root.doc_id")).alias("component_id"),
        (single | is_root).alias("kept"), "text_key")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, with all columns, of which one stays for each group of near duplicates.

    Of rows with the same doc_id and text one stays, unless they have no words.
    """
    found = near_duplicates(docs, shingle, percent).where("kept")
    keys = {"__near_text_key": F.col("text_key"), "__near_no_id": F.col("doc_id").isNull(),
            "__near_id": F.coalesce("doc_id", F.lit(0))}
    kept = found.groupBy([c.alias(k) for k, c in keys.items()]).agg(
        F.min("n_shingles").alias("__near_size"))
    docs_keys = {"__near_text_key": F.xxhash64(F.col("text").cast("string")), "__near_no_id": F.col("doc_id").isNull(),
                 "__near_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))}
    rows = docs.withColumns(docs_keys).join(kept, list(keys))
    # each wordless row has a number of its own; equal rows with words share one
    rows = rows.withColumn("__near_row", F.when(F.col("__near_size") == 0, F.monotonically_increasing_id()).otherwise(-1))
    return rows.dropDuplicates([*keys, "__near_row"]).select(*docs.columns)
