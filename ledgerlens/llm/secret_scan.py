"""Operator 3: secret scans by patterns and by dictionary-primed zstandard novelty.

Three patterns find secrets of known shape. For everything else a candidate is a long string in a
sensitive context, and its novelty is what it adds to a compressed frame: the compressor is primed
with a dictionary of identifiers and English and code words, given the text around the candidate,
and asked for the size with and without the candidate. Names, words, paths, repeated and counted
strings add few bytes; random keys add nearly all of theirs and are reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .arrow_text import chunks

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
SENSITIVE = re.compile(
    r"(?:secret|token|passw|passphrase|credential|auth|bearer|private|api.?key|access.?key|"
    r"signing|encrypt|session|cookie|connection.?string)[^\n]{0,40}$", re.IGNORECASE | re.ASCII)
#: Characters before and after a candidate that make its context.
AROUND = 256
#: Least share of a candidate's size that it must add to the frame.
NOVELTY = 0.85

IDENTIFIERS = (
    "get set put post delete update create read write open close load save send receive request "
    "response client server service handler manager factory builder provider context config "
    "settings options params arguments value values key keys name names type types index count "
    "size length user account session login logout auth token secret password credential bearer "
    "authorization header cookie private public certificate signature encrypt decrypt hash salt "
    "access api endpoint https://www.example.com http://localhost:8080/ /usr/local/lib/ /var/log/ "
    "self.assertEqual import from return function const static void string integer boolean null "
    "None True False class interface extends implements package com.example.project org.apache. "
    "document element window event listener callback promise async await exception error warning "
    "message default property attribute parent child table column database query result select "
    "insert where environment variable production development test example placeholder changeme "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 xxxxxxxxxxxxxxxx "
    "0000000000000000 ################ ---------------- ================ ________________ "
    "the of and to in is that for it was on are as with his they at be this have or one had by "
    "but not what all were when we there can an your which their said if do will each about how "
    "ing tion ment able ness less ence ance ated ized ally ious")


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(
        IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(
        level=9, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(before: str, candidate: str, after: str) -> float:
    """Bytes that ``candidate`` adds to the compressed context, as a share of its size."""
    compress = _compressor().compress
    context = (before + after).encode()
    whole = context + candidate.encode()
    return (len(compress(whole)) - len(compress(context))) / max(1, len(candidate.encode()))


def _varied(candidate: str) -> bool:
    kinds = (any(c.isdigit() for c in candidate), any(c.islower() for c in candidate),
             any(c.isupper() for c in candidate))
    return kinds[0] and sum(kinds) >= 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches; leftmost and non-overlapping for each kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further strings in a sensitive context that do not compress; none overlaps a known span."""
    out = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if not _varied(m[0]) or not SENSITIVE.search(text, max(0, start - 64), start):
            continue
        if any(s < end and start < e for s, _, e in known):
            continue
        before, after = text[max(0, start - AROUND):start], text[end:end + AROUND]
        if novelty(before, m[0], after) >= NOVELTY:
            out.append((start, 3, end))
    return out


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def spans_of(text: str) -> tuple[list, list]:
    """Spans of the patterns, and all spans, by start and kind."""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base))


def scan(docs: DataFrame) -> DataFrame:
    """Counts and spans per row: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    Positions are code points, ends exclusive. Null and empty texts have no spans (the hash of an
    empty string, empty spans). Every row stays, repeated ones too; only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            counts, digests, spans = [[], [], [], []], [], []
            for text in chunk.column("text"):
                base, found = spans_of(text.as_py())
                for k in range(4):
                    counts[k].append(sum(kind == k for _, kind, _ in found))
                digests.append(hashlib.sha256(as_text(base).encode()).hexdigest())
                spans.append(as_text(found))
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"),
                **{f"n_{kind}": pa.array(c, pa.int64()) for kind, c in zip(KINDS, counts, strict=True)},
                "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())})

    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS string) AS text")
    return rows.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, "
                                "n_novel bigint, base_sha256 string, spans string")


def masked(text: str, mark: str) -> str:
    """``text`` with every secret replaced; overlapping spans become one mark."""
    out, at = [], 0
    for start, _, end in spans_of(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with secrets in text replaced and n_chars, if there, counted again.

    All rows and columns stay; texts without a secret, empty and null ones stay as they are.
    """
    schema, names = docs.schema, docs.columns
    at, counted = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [None if t is None else masked(t, mark) for t in old]
            fresh = {at: new}
            if counted is not None:
                fresh[counted] = [n if a == b else len(b) for n, a, b in
                                  zip(batch.column(counted).to_pylist(), old, new, strict=True)]
            for k, values in fresh.items():
                field = batch.schema.field(k)
                batch = batch.set_column(k, field, pa.array(values, field.type))
            yield batch

    return docs.mapInArrow(run, schema)
