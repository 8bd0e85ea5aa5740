"""Operator 4: token ids in files of Simple-8b blocks.

A file is a Parquet file of extents. An extent is one binary value that holds whole documents in
ascending doc_id order (all numbers little-endian):

    magic "S8B2", uint32 documents, uint32 blocks, uint32 block size, uint64 ids, uint64 words
    int64 doc_id per document, uint8 per document: 1 if the doc_id is null
    uint64 number of ids per document, uint64 first word of every block and one past the last
    uint64 words

A word has a selector in its 4 high bits and 60 bits of payload: selector s packs COUNTS[s] ids of
WIDTHS[s] bits. An id of more than 60 bits is an escape: a word of selector 0 with its high 32
bits, then one of selector 15 with its low 32 bits. Every word names its own selector, so all
words of an extent decode at once, by selector, without following a chain.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..session import scratch_path
from .arrow_text import Remembered, chunks, raw, segments, take_lists

COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
ESCAPE, ESCAPE_LOW = 0, 15
#: An id needs selector s or a wider one if it reaches LIMITS[s - 1].
LIMITS = np.array([1 << w for w in range(1, 9)] + [1 << w for w in (10, 12, 15, 20, 30, 60)], np.uint64)
BLOCK = 1024
#: Bytes of text that a task encodes at a time, and whose ids are one extent.
CHUNK_BYTES = 8 << 20
MAGIC = b"S8B2"
HEADER = np.dtype([("magic", "S4"), ("docs", "<u4"), ("blocks", "<u4"), ("block", "<u4"),
                   ("ids", "<u8"), ("words", "<u8")])


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of every block (one more at the end)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    need = np.searchsorted(LIMITS, ids, side="right")  # the first selector by width that holds it
    padded = np.concatenate((need, np.zeros(60, need.dtype)))
    # every block follows its own chain of words; all blocks step together
    at = np.arange(0, n, block)
    live, ends = at, np.minimum(at + block, n)
    starts, kinds = [], []
    while len(live):
        widest = padded[live]
        chosen = np.where(widest < 14, 14, ESCAPE)
        going = np.flatnonzero(widest < 14)
        for s in range(13, 0, -1):  # ever more ids of ever fewer bits
            begin = live[going]
            for k in range(COUNTS[s + 1], COUNTS[s]):
                widest[going] = np.maximum(widest[going], padded[begin + k])
            going = going[(widest[going] < s) & (begin + COUNTS[s] <= ends[going])]
            if not len(going):
                break
            chosen[going] = s
        starts.append(live)
        kinds.append(chosen)
        live = live + COUNTS[chosen]
        keep = live < ends
        live, ends = live[keep], ends[keep]
    starts, kinds = np.concatenate(starts), np.concatenate(kinds)
    order = np.argsort(starts, kind="stable")
    starts, kinds = starts[order], kinds[order]
    words = np.zeros(len(starts), np.uint64)
    for s in np.unique(kinds):
        rows = kinds == s
        begin = starts[rows]
        if s == ESCAPE:
            words[rows] = ids[begin] >> np.uint64(32)
            continue
        value = np.full(len(begin), np.uint64(s) << np.uint64(60))
        for k in range(COUNTS[s]):
            value |= ids[begin + k] << np.uint64(k * WIDTHS[s])
        words[rows] = value
    first = np.searchsorted(starts, np.append(at, n))
    escapes = np.flatnonzero(kinds == ESCAPE)
    if len(escapes):
        low = ids[starts[escapes]] & np.uint64(0xFFFFFFFF) | np.uint64(ESCAPE_LOW) << np.uint64(60)
        words = np.insert(words, escapes + 1, low)
        first = first + np.searchsorted(escapes, first)
    return words, first.astype(np.uint64)


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks."""
    kinds = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[kinds]
    begin = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(kinds):
        rows = np.flatnonzero(kinds == s)
        if s == ESCAPE:
            low = words[rows + 1] & np.uint64(0xFFFFFFFF)
            out[begin[rows]] = (words[rows] << np.uint64(32)) | low
        elif s != ESCAPE_LOW:
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for k in range(COUNTS[s]):
                out[begin[rows] + k] = words[rows] >> np.uint64(k * WIDTHS[s]) & mask
    return out


def write_extent(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    words, first = pack(ids, block)
    head = np.array([(MAGIC, len(doc_ids), len(first) - 1, block, len(ids), len(words))], HEADER)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    parts = (head, known, null, np.asarray(lengths, "<u8"), first.astype("<u8"), words.astype("<u8"))
    return b"".join(p.tobytes() for p in parts)


def read_extent(payload: bytes, block: int | None = None):
    """doc_ids, numbers of ids, ids; of one block only its ids, found by its offset."""
    head = np.frombuffer(payload, HEADER, 1)[0]
    if head["magic"] != MAGIC:
        raise ValueError("not a token extent")
    at = HEADER.itemsize

    def field(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, int(n), at)
        at += out.nbytes
        return out

    known, null = field("<i8", head["docs"]), field("u1", head["docs"])
    lengths, first = field("<u8", head["docs"]), field("<u8", head["blocks"] + 1)
    words = field("<u8", head["words"])
    if block is not None:
        return unpack(words[int(first[block]):int(first[block + 1])])
    doc_ids = [None if gone else int(d) for d, gone in zip(known, null, strict=True)]
    return doc_ids, lengths.astype(np.int64), unpack(words)


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct segment encoded once a chunk.

    The byte-level pattern never joins a non-space with white space after it, so texts can be cut
    before a space that follows a visible byte. Where the byte may end a wide Unicode space there
    is no cut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = Remembered()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a letter of a byte-level token stands for one byte
            self.sizes[i] = len(token)

    @staticmethod
    def _closed(data: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether a cut may come after the byte at each place of ``last``."""
        b0 = data[last]
        b1 = data[np.maximum(last - 1, 0)]
        b2 = data[np.maximum(last - 2, 0)]
        wide = (b1 == 0xC2) & ((b0 == 0x85) | (b0 == 0xA0))
        wide |= (b0 >= 0x80) & (b2 >= 0xE1) & (b2 <= 0xE3)
        return (b0 > 0x20) & (b0 != 0x7F) & ~wide

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        data, offsets = raw(text)
        cut = np.zeros(len(data) + 1, bool)
        spaces = np.flatnonzero(data == 0x20)
        spaces = spaces[spaces > 0]
        cut[spaces[self._closed(data, spaces - 1)]] = True
        array, first = segments(data, offsets, cut)
        if not len(array):
            return np.zeros(0, np.int64), np.zeros(len(text), np.int64)
        coded = array.dictionary_encode()
        bounds, ids = self.remembered.lists(coded.dictionary, self._distinct)
        index = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(np.diff(bounds)[index])))
        return take_lists(bounds, ids, index), np.diff(ends[first])

    def _distinct(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct segments: those that bear a neighbour are encoded many to a call."""
        data, offsets = raw(distinct)
        sizes = np.diff(offsets)
        joins = (data[offsets[:-1]] == 0x20) & self._closed(data, offsets[1:] - 1) & (sizes > 3)
        order = np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins)))
        n_joined = int(joins.sum())
        values = distinct.take(pa.array(order)).to_pylist()
        calls = [b"".join(values[i:min(i + 256, n_joined)]).decode()
                 for i in range(0, n_joined, 256)]
        calls += [v.decode() for v in values[n_joined:]]
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        found: list[np.ndarray] = []
        for i in range(0, len(calls), 64):
            found += [np.array(e.ids, np.int64) for e in run(calls[i:i + 64], add_special_tokens=False)]
        ids = np.concatenate(found)
        ends = np.cumsum(self.sizes[ids])
        bytes_end = np.cumsum(sizes[order])
        upto = np.searchsorted(ends, bytes_end) + 1
        if ends[-1] != bytes_end[-1] or (ends[upto - 1] != bytes_end).any():
            raise ValueError("token and segment bounds differ")
        counts = np.diff(np.concatenate(([0], upto)))
        back = np.empty(len(order), np.int64)  # from the order of encoding to that of the segments
        back[order] = np.arange(len(order))
        bounds = np.concatenate(([0], np.cumsum(counts[back])))
        return bounds, take_lists(np.concatenate(([0], upto)), ids, back)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write ids of all texts under ``path`` in ascending doc_id order, ``end_id`` after each text.

    Null texts are empty and null doc_ids come first; rows with one doc_id are ordered by text.
    Other columns are not read. File k comes before file k + 1; each task writes one file.
    """

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before, part = TaskContext.get().partitionId(), 0, 0
        for chunk in chunks(batches, limit=CHUNK_BYTES):
            ids, lengths = encoder(tokenizer).encode(chunk.column("text"))
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, end_id)
            payload = write_extent(chunk.column("doc_id").to_pylist(), lengths + 1, ids)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()),
                "first_id": pa.array([before], pa.int64()),
                "n_ids": pa.array([len(ids)], pa.int64()), "extent": pa.array([payload], pa.binary())})
            before, part = before + len(ids), part + 1

    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS string) AS text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(
        extents, "shard int, part int, first_id bigint, n_ids bigint, extent binary")
    files.write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    totals = files.groupBy("shard").sum("n_ids").collect()  # one number for each file
    starts, total = {}, 0
    for shard, n in sorted(map(tuple, totals)):
        starts[shard], total = total, total + n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, lengths, ids = read_extent(batch.column("extent")[row].as_buffer())
                begin = np.cumsum(lengths) - lengths
                base = starts[batch.column("shard")[row].as_py()] + batch.column("first_id")[row].as_py()
                ids = ids.astype("<u4")
                crc = [zlib.crc32(ids[b:b + n].tobytes()) for b, n in zip(begin, lengths, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(begin + base),
                    "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())})

    return files.select("shard", "first_id", "extent").mapInArrow(
        documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and return what reading them back gives.

    Empty and null texts have the end id alone; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path)
