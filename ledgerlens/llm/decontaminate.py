"""Operator 1: benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document if the document has at least the given share of the item's
word shingles. Items are partitioned by size: class k holds items of 2**k to 2**(k+1)-1 shingles.
The MinHash sketch of an item of class k keeps its ``floor((1 - share) * (2**(k+1) - 1)) + 1``
smallest shingle hashes. A document that lacks all of them lacks more shingles than the share
allows, so looking up sketches finds every contained item, however long the document. Documents
that hold a sketch hash are then held against all shingles of the item, word by word.

Items go to the tasks in blocks of bounded size, one pass over the documents for each block;
documents are never shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import chunks, kept_rows, shingle_hashes, string_hashes, words

SHINGLE, SHARE = 5, 0.8
#: Bytes of item texts in a block; an item beyond it has a block of its own.
BLOCK_BYTES = 4 << 20
#: Characters around words that do not count, so that a passage is found next to other punctuation.
EDGES = b".,;:!?\"'()[]"
EMPTY = string_hashes(pa.array([""]))[0]


def sketch_size(n_shingles: int, share: float) -> int:
    upper = 2 ** n_shingles.bit_length() - 1
    return math.floor((1 - share) * upper + 1e-9) + 1


class Items:
    """Sketches and shingles of a block of items."""

    def __init__(self, rows: list[tuple], size: int, share: float):
        self.share, self.words = share, {}
        self.sizes: dict[int, list[tuple[int, set]]] = defaultdict(list)  # by words in a shingle
        sketches: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in rows:
            text_words = normal_words(text)
            if not text_words:
                continue
            length = min(size, len(text_words))
            shingles = {tuple(text_words[i:i + length]) for i in range(len(text_words) - length + 1)}
            at = len(self.sizes[length])
            self.sizes[length].append((item_id, shingles))
            hashes = string_hashes(pa.array([w for s in shingles for w in s]))
            keys = np.array([shingle_hashes(hashes[i:i + length], length)[0]
                             for i in range(0, len(hashes), length)])
            for key in np.sort(keys)[:sketch_size(len(shingles), share)].tolist():
                sketches[length][key].append(at)
        self.sketches = {length: (np.array(sorted(found), np.uint64), dict(found))
                         for length, found in sketches.items()}

    def contained(self, length: int, candidates: set[int], text_words: list[bytes]) -> Iterator[tuple]:
        """item_id, shingles of the item, shared ones: of candidates that are contained."""
        wanted = set().union(*(self.sizes[length][c][1] for c in candidates))
        found = {s for s in zip(*(text_words[k:] for k in range(length)), strict=False) if s in wanted}
        for c in candidates:
            item_id, shingles = self.sizes[length][c]
            shared = len(shingles & found)
            if shared >= self.share * len(shingles) - 1e-9:
                yield item_id, len(shingles), shared


def normal_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, without punctuation at their ends."""
    return [w for w in (x.strip(EDGES) for x in (text or "").encode().lower().split()) if w]


def _word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normal words of a chunk; offsets of its texts."""
    found = words(text)
    hashes = string_hashes(pc.ascii_trim(found.vocabulary, characters=EDGES.decode()))
    real = (hashes != EMPTY)[found.index] if len(hashes) else np.zeros(0, bool)
    offsets = np.concatenate(([0], np.cumsum(real)))[found.offsets]
    return hashes[found.index[real]], offsets


def contaminated(docs: DataFrame, items: DataFrame, size: int = SHINGLE, share: float = SHARE,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and contained item: doc_id, item_id, n_shingles, n_shared, containment.

    An item of fewer words than a shingle is one shingle; null, empty and word-less items are
    contained in nothing. Documents that are null or empty contain nothing. Repeated documents and
    items give repeated rows. Only doc_id, text, item_id and text are read. A text of any length is
    searched as a whole.
    """
    spark = docs.sparkSession
    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS string) AS text")
    found = [rows.mapInArrow(_search(block), RESULT)
             for block in _blocks(spark, items, size, share, block_bytes)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], RESULT)


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = SHINGLE, share: float = SHARE,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs``, with all columns, whose text contains no item."""
    for block in _blocks(docs.sparkSession, items, size, share, block_bytes):
        docs = docs.mapInArrow(_without(block), docs.schema)
    return docs


def _blocks(spark, items: DataFrame, size: int, share: float, block_bytes: int) -> Iterator:
    """Broadcast blocks of items, of about ``block_bytes`` of text each."""
    tests = items.selectExpr("CAST(item_id AS bigint) AS item_id", "CAST(text AS string) AS text")
    tests = tests.where("text IS NOT NULL AND text <> ''")
    volume = tests.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(volume / block_bytes))
    for k in range(n_blocks):
        block = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        if block:
            yield spark.sparkContext.broadcast(Items([tuple(r) for r in block], size, share))


RESULT = "doc_id bigint, item_id bigint, n_shingles int, n_shared int, containment double"


def _hits(items: Items, text: pa.Array) -> list[tuple]:
    """(row, item_id, shingles of the item, shared ones) of contained items."""
    hashes, offsets = _word_hashes(text)
    out = []
    for length, (keys, by_key) in items.sketches.items():
        shingles = shingle_hashes(hashes, length)
        if not len(shingles):
            continue
        at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        hits = np.flatnonzero(keys[at] == shingles)
        row = np.searchsorted(offsets, hits, side="right") - 1
        inside = hits + length <= offsets[row + 1]
        candidates: dict[int, set[int]] = defaultdict(set)
        for r, key in zip(row[inside].tolist(), shingles[hits[inside]].tolist(), strict=True):
            candidates[r].update(by_key[key])
        for r, which in candidates.items():
            out += [(r, *found) for found in items.contained(length, which, normal_words(text[r].as_py()))]
    return out


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found = _hits(shared.value, chunk.column("text"))
            row, item, n, n_shared = (list(c) for c in zip(*found, strict=True)) if found else ([],) * 4
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id").take(pa.array(row, pa.int64())),
                "item_id": pa.array(item, pa.int64()), "n_shingles": pa.array(n, pa.int32()),
                "n_shared": pa.array(n_shared, pa.int32()),
                "containment": pa.array([a / b for a, b in zip(n_shared, n, strict=True)], pa.float64())})

    return run


def _without(shared):
    def contained(text: pa.Array) -> np.ndarray:
        gone = np.zeros(len(text), bool)
        gone[[found[0] for found in _hits(shared.value, text)]] = True
        return gone

    return lambda batches: kept_rows(batches, contained)
