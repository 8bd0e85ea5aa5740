"""Operator 12: SimHash near-duplicate groups by covering with anchor points.

A text's fingerprint has 64 bits: a bit is 1 where over half of its shingles' hashes have it. It is
cut into three parts. Two fingerprints that differ in at most 4 bits differ in at most 2 bits of some
two parts together, so each pair of parts has anchors of its own: pairs of words of the binary Golay
code in 23 bits, whose covering radius is 3 and which is perfect, one word within that radius of any
23 bits. A fingerprint is at home at the anchor within radius 3 in both parts, and visits every anchor
within 3 + 2 in one, or 3 + 1 in both, on average 61 of the 2**24. Whoever differs from it in 2 bits of
those parts visits its home, so residents of an anchor are compared with its visitors, all 64 bits,
and nothing else is.

Of two fingerprints one visit is enough: only anchors of a greater number than one's own home are
visited. Visits to anchors where nobody lives are dropped by a bitmap of all anchors, six megabytes at
any corpus size. Visitors of a crowded anchor are dealt over several tasks, each with all residents; the
residents are at most RESIDENTS. Anchors with more (a great family of close copies) take an exact way
without pairs: two fingerprints differ in at most 4 bits if and only if some point is within 2 bits of
both, so all visitors of such anchors are sent to the 2081 points around them and neighbours at one
point are linked, a chain and not all pairs. Components of the links are found by contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .arrow_text import chunks, raw, words
from .components import components

SHINGLE, SEED, BITS = 4, 42, 64
#: Differing bits of linked fingerprints, and the least of them in two of three parts.
DISTANCE, PAIR_DISTANCE = 4, 2
#: Bytes of text and number of shingles taken at a time.
TEXT_BYTES, SHINGLES = 4 << 20, 1 << 18
#: Generator polynomial, length, check bits and covering radius of the Golay code.
GENERATOR, LENGTH, CHECK, RADIUS = 0b101011100011, 23, 11, 3
INFORMATION = LENGTH - CHECK
#: Bits of a fingerprint where its parts begin and end, and the pairs of parts.
PARTS, PAIRS = (0, 22, 43, 64), ((0, 1), (0, 2), (1, 2))
#: Residents of an anchor that are compared, and its visitors in one task.
RESIDENTS, CROWD = 2048, 1 << 16

#: In byte k of entry b, bit k of b: sums of entries count bits.
LANES = np.array([sum((b >> k & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each run, begun at ``starts``, have each bit."""
    # runs of 255 at most, so that no byte overflows
    cuts = np.unique(np.concatenate([starts, np.arange(0, len(hashes), 255)]))
    sums = np.add.reduceat(LANES[hashes.view(np.uint8).reshape(-1, 8)], cuts, axis=0)
    counts = sums.view(np.uint8).reshape(len(cuts), BITS).astype(np.int64)
    return np.add.reduceat(counts, np.searchsorted(cuts, starts), axis=0)


def fingerprints_of(text: pa.Array) -> np.ndarray:
    """Unsigned fingerprints of texts; 0 for texts without words."""
    found = words(text)
    nothing, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    spaced = pc.binary_join_element_wise(found.vocabulary.cast(pa.large_string()), nothing, space)
    data, at = raw(spaced.take(pa.array(found.index)))
    buffer = data.tobytes()
    first, last = found.offsets[:-1], found.offsets[1:]
    size = last - first
    n_shingles = np.where(size > 0, np.maximum(size - SHINGLE + 1, 1), 0)
    ends = np.cumsum(n_shingles)
    total = int(ends[-1]) if len(ends) else 0
    counts = np.zeros((len(size), BITS), np.int64)
    for begin in range(0, total, SHINGLES):
        number = np.arange(begin, min(total, begin + SHINGLES))
        owner = np.searchsorted(ends, number, side="right")
        word = first[owner] + number - (ends[owner] - n_shingles[owner])
        stop = at[np.minimum(word + SHINGLE, last[owner])] - 1  # less the space behind it
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(buffer[a:b], SEED) for a, b in zip(at[word].tolist(), stop.tolist(), strict=True)),
                             np.uint64, len(number))
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        counts[owner[starts]] += bit_counts(hashes, starts)
    bits = (2 * counts > n_shingles[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed bigint) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=TEXT_BYTES):
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"),
                "fingerprint": pa.array(fingerprints_of(chunk.column("text")).view(np.int64))})

    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS string) AS text")
    return rows.mapInArrow(run, "doc_id bigint, fingerprint bigint")


class Covering(NamedTuple):
    remainder: np.ndarray  # of a word of LENGTH bits, what identifies its coset
    #: Flips that lead from a coset's words to code words within RADIUS, and to those one and two
    #: bits further off: where each coset's begin, and the flips of all cosets.
    rings: list[tuple[np.ndarray, np.ndarray]]


def flips_of(n_bits: int, weight: int) -> np.ndarray:
    """All words with ``weight`` of ``n_bits`` bits set."""
    return np.array([sum(1 << k for k in c) for c in combinations(range(n_bits), weight)], np.uint32)


@lru_cache(1)
def covering() -> Covering:
    remainder = np.arange(1 << LENGTH, dtype=np.uint32)
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        remainder ^= (remainder >> np.uint32(bit) & np.uint32(1)) * np.uint32(GENERATOR << (bit - CHECK))
    near = [np.concatenate([flips_of(LENGTH, weight) for weight in range(RADIUS + 1)])]
    near += [flips_of(LENGTH, RADIUS + k) for k in range(1, PAIR_DISTANCE + 1)]
    rings = []
    for flips in near:
        order = np.argsort(remainder[flips], kind="stable")
        rings.append((np.searchsorted(remainder[flips][order], np.arange((1 << CHECK) + 1)), flips[order]))
    return Covering(remainder.astype(np.uint16), rings)


def parts_of(prints: np.ndarray) -> list[np.ndarray]:
    return [(prints >> np.uint64(a) & np.uint64((1 << b - a) - 1)).astype(np.uint32)
            for a, b in zip(PARTS[:-1], PARTS[1:], strict=True)]


def anchor_number(pair: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of an anchor: the pair of parts and its code words without their check bits."""
    left, right = ((code >> np.uint32(CHECK)).astype(np.int64) for code in (left, right))
    return (pair << INFORMATION | left) << INFORMATION | right


def homes(prints: np.ndarray) -> list[np.ndarray]:
    """Home anchors of fingerprints for each pair of parts."""
    cover = covering()
    codes = [x ^ cover.rings[0][1][cover.remainder[x]] for x in parts_of(prints)]  # one flip a coset
    return [anchor_number(pair, codes[i], codes[j]) for pair, (i, j) in enumerate(PAIRS)]


def visits(prints: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pairs of parts, places of fingerprints in ``prints``, and the anchors that they visit there."""
    cover = covering()
    parts = parts_of(prints)
    cosets = [cover.remainder[x].astype(np.int64) for x in parts]
    for pair, (i, j) in enumerate(PAIRS):
        for a in range(PAIR_DISTANCE + 1):
            for b in range(PAIR_DISTANCE + 1 - a):
                (left, left_flips), (right, right_flips) = cover.rings[a], cover.rings[b]
                many = np.diff(right)[cosets[j]]
                count = np.diff(left)[cosets[i]] * many
                place = np.repeat(np.arange(len(prints)), count)
                step = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
                x = parts[i][place] ^ left_flips[left[cosets[i]][place] + step // many[place]]
                y = parts[j][place] ^ right_flips[right[cosets[j]][place] + step % many[place]]
                yield pair, place, anchor_number(pair, x, y)


def _bitmap(anchors: DataFrame) -> np.ndarray:
    """One bit per anchor, of a fixed size: Spark's bitmaps of 2**15 bits, put side by side."""
    place = F.col("anchor") + 1
    rows = anchors.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(len(PAIRS) << 2 * INFORMATION - 3, np.uint8)
    for row in rows:
        begin = (row.bucket - 1) << 12
        out[begin:begin + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _has(bitmap: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    return bitmap[anchors >> 3] >> (anchors & 7).astype(np.uint8) & 1 == 1


def home_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.concatenate(homes(_unsigned(batch.column("fingerprint"))))
        yield pa.RecordBatch.from_pydict({"anchor": pa.array(found)})


def visit_rows(maps):
    """Visits to anchors with residents; anchor -1 for who visits one with too many of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lived, hot = maps.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                prints = _unsigned(batch.column("fingerprint").slice(begin, 4096))
                own = homes(prints)
                great = np.zeros(len(prints), bool)
                for pair, place, anchors in visits(prints):
                    # of two fingerprints, the one whose home has the smaller number visits the other
                    ahead = anchors >= own[pair][place]
                    place, anchors = place[ahead], anchors[ahead]
                    packed = _has(hot, anchors)
                    great[place[packed]] = True
                    kept = _has(lived, anchors) & ~packed
                    place, anchors = place[kept], anchors[kept]
                    yield _visits(anchors, prints[place], anchors == own[pair][place])
                yield _visits(np.full(int(great.sum()), -1), prints[great], np.zeros(int(great.sum()), bool))

    return run


def _visits(anchors: np.ndarray, prints: np.ndarray, resident: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "anchor": pa.array(anchors, pa.int64()), "fingerprint": pa.array(prints.view(np.int64)),
        "resident": pa.array(resident)})


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


NO_PRINTS = np.zeros(0, np.uint64)


def compare(distance: int):
    """Links between an anchor's residents, which come first, and its visitors.

    A visitor is linked with the first resident near it; residents that share a visitor are linked
    with that first one. So links are no more than rows, and connect whatever pairs would.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, living = None, NO_PRINTS
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, part = (batch.column(c).to_numpy() for c in ("anchor", "part"))
            prints = _unsigned(batch.column("fingerprint"))
            resident = batch.column("resident").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            left, right = [NO_PRINTS], [NO_PRINTS]
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(anchor)], strict=True):
                if key != (anchor[begin], part[begin]):
                    key, living = (anchor[begin], part[begin]), NO_PRINTS
                own = prints[begin:end][resident[begin:end]]
                living = np.concatenate((living, own)) if len(own) else living
                guests = prints[begin:end]  # residents are guests of each other
                first = np.full(len(guests), -1)
                for k, x in enumerate(living):
                    near = np.flatnonzero(np.bitwise_count(guests ^ x) <= distance)
                    shared = np.unique(first[near])
                    left += [guests[near[first[near] < 0]], living[shared[shared >= 0]]]
                    right += [np.full(len(left[-2]), x), np.full(len(left[-1]), x)]
                    first[near[first[near] < 0]] = k
            a, b = np.concatenate(left), np.concatenate(right)
            yield _edges(a[a != b], b[a != b])

    return run


def around(distance: int):
    """The points within half the distance of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = np.array([sum(1 << k for k in c) for weight in range(distance // 2 + 1)
                          for c in combinations(range(BITS), weight)], np.uint64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                prints = _unsigned(batch.column("fingerprint").slice(begin, 256))
                points = (prints[:, None] ^ moves).reshape(-1)
                yield pa.RecordBatch.from_pydict({
                    "point": pa.array(points.view(np.int64)),
                    "fingerprint": pa.array(np.repeat(prints, len(moves)).view(np.int64))})

    return run


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between neighbouring rows of one point in a sorted stream."""
    point = prints = np.zeros(0, np.int64)
    for batch in batches:
        point = np.concatenate((point[-1:], batch.column("point").to_numpy()))
        prints = np.concatenate((prints[-1:], batch.column("fingerprint").to_numpy()))
        same = np.flatnonzero(point[1:] == point[:-1])
        pairs = np.unique(np.stack((prints[same], prints[same + 1]), axis=1), axis=0)
        yield _edges(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))


def links(prints: DataFrame, residents: int = RESIDENTS, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all that differ in DISTANCE bits or fewer."""
    spark = prints.sparkSession
    lived = materialize(prints.mapInArrow(home_rows, "anchor bigint").groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n")), "homes")
    maps = spark.sparkContext.broadcast((_bitmap(lived), _bitmap(lived.where(F.col("n") > residents))))
    rows = materialize(prints.mapInArrow(
        visit_rows(maps), "anchor bigint, fingerprint bigint, resident boolean"), "visits")
    plain = rows.where("anchor >= 0")
    crowded = plain.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select(
        "anchor", F.ceil(F.col("n") / crowd).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = plain.join(crowded, "anchor", "left").withColumn("part", F.explode(
        F.when(F.col("resident"), F.sequence(F.lit(0), parts - 1)).otherwise(
            F.array(F.pmod(F.xxhash64("fingerprint"), parts).cast("int")))))
    dealt = dealt.select("anchor", "part", "resident", "fingerprint").repartition("anchor", "part")
    dealt = dealt.sortWithinPartitions("anchor", "part", F.desc("resident"))
    found = dealt.mapInArrow(compare(DISTANCE), "a bigint, b bigint")
    great = rows.where("anchor < 0").select("fingerprint").distinct()
    points = great.mapInArrow(around(DISTANCE), "point bigint, fingerprint bigint")
    chains = points.repartition("point").sortWithinPartitions("point", "fingerprint").mapInArrow(
        neighbours, "a bigint, b bigint")
    return found.unionAll(chains)


def near_duplicates(docs: DataFrame, residents: int = RESIDENTS, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable, of every row.

    Null and empty texts and those without words have the fingerprint 0 and are linked like any
    other; a text of fewer words than a shingle is one shingle. Rows without a doc_id get the
    component of their group, null where no row of it has one. Repeated rows stay, with one
    component. An empty table gives none. Only doc_id and text are read.
    """
    signed = materialize(fingerprints(docs), "fingerprints")
    prints = materialize(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "prints")
    labels = components(links(prints.select("fingerprint"), residents, crowd))
    known = prints.join(labels, prints["fingerprint"] == labels["node"], "left").withColumn(
        "label", F.coalesce("label", "fingerprint"))
    roots = known.groupBy("label").agg(F.min("least").alias("component_id"))
    known = known.join(roots, "label").select("fingerprint", "component_id")
    return signed.join(known, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
