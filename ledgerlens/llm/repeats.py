"""Operator 9: removal of repeated byte strings by blockwise suffix sorting.

Every string of LENGTH bytes that also starts elsewhere goes. All suffixes of the corpus can't be
shuffled within a few times its size, so suffixes meet in buckets in which all their repeats lie:

1. The bucket of a LENGTH-byte window is its smallest GRAM-byte string by hash. Equal windows have
   equal buckets and hold the gram at the same offset. Neighbouring windows mostly have the same
   gram, so a text is a sequence of runs of about 90 windows: (bucket, content hash, place).
2. Runs whose bucket has one run have no repeat. Runs with equal content are repeats as a whole.
3. Runs of one bucket with different content may share some windows. The text of each such run is
   taken once, and the suffixes that start in it are sorted blockwise: the ranks of the positions
   of a difference cover are computed first; then one block of suffixes at a time is sorted by its
   first PERIOD bytes, and longer ties are resolved by the ranks of the next cover positions.
   Equal windows are then neighbours. Runs are laid out with their grams at multiples of PERIOD, so
   ties almost always have one cover position in common and are resolved by a single key.
   Buckets with more than BUCKET_RUNS such runs go another way: one row per window hash, counted.

Rows are counted before they meet, so a passage in a third of all texts is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key, lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .arrow_text import MIX, chunks, mixed, raw

LENGTH, GRAM, PERIOD = 200, 40, 32
#: Runs of different content in a bucket that one task sorts; beyond it windows are counted.
BUCKET_RUNS = 8192
#: Bytes of runs that are laid out and sorted together, whole buckets at a time.
SORT_BYTES = 2 << 20
#: Share of the counted rows beyond which a key is hot.
HEAVY = 1 / 2000
#: Bytes of text hashed together.
TEXT_BYTES = 8 << 20


@lru_cache(maxsize=4)
def difference_cover(period: int) -> np.ndarray:
    """A set of residues such that every difference mod ``period`` occurs, chosen greedily."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gain = [len(missing & {s * (d - c) % period for c in cover for s in (1, -1)})
                for d in range(period)]
        best = int(np.argmax(gain))
        missing -= {s * (best - c) % period for c in cover for s in (1, -1)}
        cover.append(best)
    return np.array(sorted(cover))


def _names(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows of keys, equal for equal rows."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class SuffixSorter:
    """Sorts suffixes of ``text`` by their first ``depth`` bytes, a block at a time.

    Suffixes are taken to go on with zero bytes after the end.
    """

    def __init__(self, text: np.ndarray, depth: int = LENGTH, period: int = PERIOD):
        self.depth, self.period, self.cover = depth, period, difference_cover(period)
        n = len(text)
        padded = np.concatenate((text, np.zeros(depth + 4 * period, np.uint8)))
        word = np.zeros(len(padded) - 8, np.uint64)  # eight bytes from each place, big-endian
        for k in range(8):
            word = (word << np.uint64(8)) | padded[k:k + len(word)]
        self.word = word
        # distance from each residue to the next cover position, and for each pair of residues to
        # the next place where both are in the cover
        inside = np.zeros(2 * period, bool)
        inside[self.cover] = inside[self.cover + period] = True
        self.next = np.array([int(np.argmax(inside[r:])) for r in range(period)])
        self.common = np.array([[next(d for d in range(period) if inside[a + d] and inside[b + d])
                                 for b in range(period)] for a in range(period)])
        self._rank_cover(n)

    def _rank_cover(self, n: int) -> None:
        period = self.period
        laps = n // period + 2
        places = (np.arange(laps)[:, None] * period + self.cover).ravel()
        places = places[places < n + period]
        words = [self.word[places + k] for k in range(0, period, 8)]
        rank = _names(*words)
        size = period
        self.rank = np.zeros(laps * period + self.depth + 2 * period, np.int64)
        while size < self.depth and rank.max(initial=0) < len(rank) - 1:
            self.rank[places] = rank + 1
            rank = _names(rank, self.rank[places + size])
            size *= 2
        self.rank[places] = rank + 1

    def sort(self, block: np.ndarray) -> np.ndarray:
        """The suffixes of a block in order."""
        words = [self.word[block + k] for k in range(0, self.period, 8)]
        tie = _names(*words)
        residue = block % self.period
        order = np.lexsort((self.rank[block + self.next[residue]], residue, tie))
        # within a tie, suffixes of one residue are now in order; ties of several are merged
        t, r = tie[order], residue[order]
        several = np.unique(t[1:][(t[1:] == t[:-1]) & (r[1:] != r[:-1])])
        for key in several:
            a, b = np.searchsorted(t, [key, key + 1])
            order[a:b] = sorted(order[a:b], key=cmp_to_key(lambda x, y: self._compare(block[x], block[y])))
        return block[order]

    def _compare(self, x: int, y: int) -> int:
        d = self.common[x % self.period, y % self.period]
        return int(self.rank[x + d]) - int(self.rank[y + d])

    def blocks(self, starts: np.ndarray, size: int = 1 << 17) -> Iterator[np.ndarray]:
        """Suffixes in order, in blocks between splitters of their first eight bytes."""
        head = self.word[starts]
        splitters = np.unique(np.sort(head)[size::size])
        block = np.searchsorted(splitters, head, side="right")
        for k in range(len(splitters) + 1):
            mine = starts[block == k]
            if len(mine):
                yield self.sort(mine)

    def repeated(self, starts: np.ndarray) -> np.ndarray:
        """Those of ``starts`` whose first ``depth`` bytes also start at another of them."""
        out = []
        for ordered in self.blocks(starts):
            same = np.ones(len(ordered) - 1, bool)
            for k in range(0, self.depth, 8):
                k = min(k, self.depth - 8)
                live = np.flatnonzero(same)
                same[live] = self.word[ordered[live] + k] == self.word[ordered[live + 1] + k]
            hit = np.zeros(len(ordered), bool)
            hit[1:] |= same
            hit[:-1] |= same
            out.append(ordered[hit])
        return np.concatenate(out) if out else starts[:0]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place, by doubling."""
    out, have, done = None, (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03), 0
    width = 1

    def joined(a: np.ndarray, b: np.ndarray, b_size: int, gap: int) -> np.ndarray:
        n = len(b) - gap
        return a[:n] * np.uint64(pow(int(MIX), b_size, 1 << 64)) + b[gap:gap + n]

    while True:
        if size & width:
            out = have if out is None else joined(out, have, width, done)
            done += width
        if done == size:
            return mixed(out)
        have = joined(have, have, width, width)
        width *= 2


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def text_runs(data: np.ndarray, offsets: np.ndarray):
    """Runs of windows with one gram: text, start in it, number of windows, bucket, gram's offset."""
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - LENGTH + 1, 0)
    if not counts.sum():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64), empty
    grams = gram_hashes(data, GRAM)
    least = window_minima(grams, LENGTH - GRAM + 1)
    row = np.repeat(np.arange(len(sizes)), counts)
    begin = np.cumsum(counts) - counts
    place = np.arange(counts.sum()) - np.repeat(begin - offsets[:-1], counts)
    key = least[place]
    new = np.ones(len(place), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, len(place)))
    place, row, key = place[first], row[first], key[first]
    at = np.empty(len(place), np.int64)  # the gram's first place in the first window
    reach = np.arange(LENGTH - GRAM + 1)
    for a in range(0, len(place), 4096):
        near = grams[np.minimum(place[a:a + 4096, None] + reach, len(grams) - 1)]
        at[a:a + 4096] = np.argmax(near == key[a:a + 4096, None], axis=1)
    # a run that goes on beyond its gram holds the gram again: it falls apart at each copy
    long = np.flatnonzero(number > at + 1)
    if len(long):
        spread = number[long] + LENGTH - GRAM
        which = np.repeat(long, spread)
        spot = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread - place[long], spread)
        hit = grams[np.minimum(spot, len(grams) - 1)] == key[which]
        which, spot = which[hit], spot[hit]
        begin = np.where(np.append(True, which[1:] != which[:-1]), place[which], np.append(0, spot[:-1]) + 1)
        last = place[which] + number[which] - 1
        some = begin <= last
        which, spot, begin, last = which[some], spot[some], begin[some], last[some]
        rest = np.ones(len(place), bool)
        rest[long] = False
        row, key = np.append(row[rest], row[which]), np.append(key[rest], key[which])
        place, number = np.append(place[rest], begin), np.append(number[rest], np.minimum(spot, last) - begin + 1)
        at = np.append(at[rest], spot - begin)
    return row, place - offsets[row], number, key, at


def _row_key(doc_id, text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text, seed=0 if doc_id is None else doc_id & (1 << 64) - 1) - (1 << 63)


def _texts(chunk: pa.RecordBatch):
    data, offsets = raw(chunk.column("text"))
    whole = data[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    view = memoryview(whole)
    keys = [_row_key(d, view[a:b]) for d, a, b in
            zip(chunk.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True)]
    return whole, offsets, view, keys


RUNS = "doc_id bigint, row_key bigint, bucket bigint, content bigint, start int, windows int, at int"


def runs(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=TEXT_BYTES):
            data, offsets, view, keys = _texts(chunk)
            row, start, number, bucket, at = text_runs(data, offsets)
            begin = offsets[row] + start
            digest = xxhash.xxh3_64_intdigest
            content = np.array([digest(view[a:b]) for a, b in
                                zip(begin.tolist(), (begin + number + LENGTH - 1).tolist(), strict=True)],
                               np.uint64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id").take(pa.array(row)),
                "row_key": pa.array(np.array(keys, np.int64)[row]),
                "bucket": pa.array(bucket.view(np.int64)), "content": pa.array(content.view(np.int64)),
                "start": pa.array(start.astype(np.int32)), "windows": pa.array(number.astype(np.int32)),
                "at": pa.array(at.astype(np.int32))})

    return docs.mapInArrow(run, RUNS)


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and the text compressed, so that joins move less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for chunk in chunks(batches, limit=TEXT_BYTES):
            _, offsets, view, keys = _texts(chunk)
            blobs = [compress(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"), "row_key": pa.array(keys, pa.int64()),
                "packed": pa.array(blobs, pa.binary())})

    return docs.mapInArrow(run, "doc_id bigint, row_key bigint, packed binary")


def _unpacked(blob) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(blob) if len(blob) else b""


SPANS = "doc_id bigint, row_key bigint, span_start int, span_end int"


def contested_texts(contested: DataFrame, texts: DataFrame) -> DataFrame:
    """The bytes of each contested run, with where it is from."""
    fields = ["bucket", "start", "windows", "at", "big"]
    per_row = contested.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct(*fields)).alias("runs"))
    both = _same_rows(texts, per_row, "inner")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = _unpacked(batch.column("packed")[row].as_py())
                found = batch.column("runs")[row].as_py()
                n = len(found)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([batch.column("doc_id")[row].as_py()] * n, pa.int64()),
                    "row_key": pa.array([batch.column("row_key")[row].as_py()] * n, pa.int64()),
                    "bucket": pa.array([x["bucket"] for x in found], pa.int64()),
                    "start": pa.array([x["start"] for x in found], pa.int32()),
                    "at": pa.array([x["at"] for x in found], pa.int32()),
                    "big": pa.array([x["big"] for x in found], pa.bool_()),
                    "bytes": pa.array([text[x["start"]:x["start"] + x["windows"] + LENGTH - 1]
                                       for x in found], pa.binary())})

    return both.mapInArrow(cut, "doc_id bigint, row_key bigint, bucket bigint, start int, at int, "
                                "big boolean, bytes binary")


def _same_rows(texts: DataFrame, other: DataFrame, how: str) -> DataFrame:
    other = other.select(F.col("doc_id").alias("other_id"), F.col("row_key").alias("other_key"),
                         *[c for c in other.columns if c not in ("doc_id", "row_key")])
    on = (F.col("row_key") == F.col("other_key")) & F.col("doc_id").eqNullSafe(F.col("other_id"))
    return texts.join(other, on, how).drop("other_id", "other_key")


def _spans(doc_ids: list, keys: list, starts: np.ndarray, pieces: list[np.ndarray]) -> pa.RecordBatch:
    """Covered spans of sorted repeated window starts of each run."""
    out: list[tuple] = []
    for doc_id, key, start, found in zip(doc_ids, keys, starts, pieces, strict=True):
        if len(found):
            breaks = np.flatnonzero(np.diff(found) > LENGTH)
            for a, b in zip(np.append(0, breaks + 1), np.append(breaks, len(found) - 1), strict=True):
                out.append((doc_id, key, int(start + found[a]), int(start + found[b] + LENGTH)))
    columns = list(zip(*out, strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      ["doc_id", "row_key", "span_start", "span_end"])


def _sorted_group(group: list[dict]) -> pa.RecordBatch:
    """Repeated windows within some whole buckets."""
    texts, begins, at = [], [], 0
    for run in group:
        at += -(at + run["at"]) % PERIOD  # the gram comes to a multiple of the period
        begins.append(at)
        at += len(run["bytes"])
    text = np.zeros(at, np.uint8)
    for run, begin in zip(group, begins, strict=True):
        text[begin:begin + len(run["bytes"])] = np.frombuffer(run["bytes"], np.uint8)
    counts = np.array([len(r["bytes"]) - LENGTH + 1 for r in group])
    begins = np.array(begins)
    starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    hits = np.sort(SuffixSorter(text).repeated(starts))
    edges = np.searchsorted(hits, np.append(begins, at))
    texts = [hits[a:b] - begin for a, b, begin in zip(edges[:-1], edges[1:], begins, strict=True)]
    return _spans([r["doc_id"] for r in group], [r["row_key"] for r in group],
                  np.array([r["start"] for r in group]), texts)


def sorted_spans(cut: DataFrame) -> DataFrame:
    """Repeats among the contested runs of buckets of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= SORT_BYTES and row["bucket"] != group[-1]["bucket"]:
                    yield _sorted_group(group)
                    group, size = [], 0
                group.append(row)
                size += len(row["bytes"])
        if group:
            yield _sorted_group(group)

    ordered = cut.where("NOT big").drop("big").repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, SPANS)


def counted_spans(cut: DataFrame) -> DataFrame:
    """Repeats in buckets of any size: windows meet by two hashes, counted before the shuffle."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = row["bytes"]
                n = len(data) - LENGTH + 1
                digests = [xxhash.xxh3_128_intdigest(data[k:k + LENGTH]) for k in range(n)]
                mask, half = (1 << 64) - 1, 1 << 63
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([row["doc_id"]] * n, pa.int64()),
                    "row_key": pa.array([row["row_key"]] * n, pa.int64()),
                    "high": pa.array([(d >> 64) - half for d in digests], pa.int64()),
                    "low": pa.array([(d & mask) - half for d in digests], pa.int64()),
                    "span_start": pa.array(range(row["start"], row["start"] + n), pa.int32())})

    rows = cut.where("big").mapInArrow(
        windows, "doc_id bigint, row_key bigint, high bigint, low bigint, span_start int")
    often = rows.groupBy("high", "low").count().where("count > 1").select("high", "low")
    hits = rows.join(often, ["high", "low"], "left_semi")
    return hits.select("doc_id", "row_key", "span_start", (F.col("span_start") + LENGTH).alias("span_end"))


def counted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among ``keys``, which are distinct, with the n rows that each key has.

    Keys of more than a HEAVY part of all rows are at most 1 / HEAVY: they are broadcast, and their
    rows stay where they are. The rest meets in a shuffle, in which no key is hot.
    """
    least = (keys.agg(F.sum("n")).first()[0] or 0) * HEAVY
    heavy = F.broadcast(keys.where(F.col("n") > least))
    light = keys.where(F.col("n") <= least)
    return rows.join(heavy, on).unionByName(rows.join(heavy, on, "left_anti").join(light, on))


def repeated_spans(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, row_key, span_start, span_end of byte spans that are covered by repeats."""
    found = materialize(runs(docs), "runs")
    often = found.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(counted(found, materialize(often, "buckets"), ["bucket"]).drop("n"), "shared-runs")
    place = F.struct("doc_id", "row_key", "start", "windows", "at")
    contents = shared.groupBy("bucket", "content").agg(F.count("*").alias("runs"), F.min(place).alias("one"))
    contents = materialize(contents, "contents")
    copied = contents.where("runs > 1").select("bucket", "content", F.col("runs").alias("n"))
    whole = counted(shared, copied, ["bucket", "content"])
    whole = whole.select("doc_id", "row_key", F.col("start").alias("span_start"),
                         (F.col("start") + F.col("windows") + LENGTH - 1).alias("span_end"))
    several = contents.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    contested = counted(contents, materialize(several, "several"), ["bucket"]).select(
        "one.*", "bucket", (F.col("n") > BUCKET_RUNS).alias("big"))
    cut = materialize(contested_texts(contested, texts), "contested")
    return reduce(DataFrame.unionAll, [whole, sorted_spans(cut), counted_spans(cut)])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; the kept bytes on demand.

    Null and empty texts have no bytes and nothing removed; texts below LENGTH bytes stay whole.
    Repeated rows remove each other. Only doc_id and text are read.
    """
    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS string) AS text")
    texts = packed_texts(rows)
    spans = repeated_spans(rows, texts)
    per_row = spans.groupBy("doc_id", "row_key").agg(
        F.collect_set(F.struct("span_start", "span_end")).alias("spans"))
    both = _same_rows(texts, per_row, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for blob, found in zip(batch.column("packed"), batch.column("spans").to_pylist(), strict=True):
                text = _unpacked(blob.as_py())
                spans_ = merged([(s["span_start"], s["span_end"]) for s in found or []])
                ends = [0, *(e for _, e in spans_)]
                begins = [*(s for s, _ in spans_), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(ends, begins, strict=True))
                for k, v in (("n_bytes", len(text)), ("n_removed", len(text) - len(kept)),
                             ("n_spans", len(spans_)), ("kept_sha256", hashlib.sha256(kept).hexdigest()),
                             ("kept", kept)):
                    out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)}
            if not keep_text:
                del columns["kept"]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **columns})

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return both.mapInArrow(cut, schema + (", kept binary" if keep_text else ""))
