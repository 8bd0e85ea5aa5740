"""Decontamination, pieces, secrets and token files against brute force and libraries."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from ledgerlens.llm import decontaminate, pieces, secret_scan, token_files

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, lang string, score double, kept boolean, batch int, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 1.0, None, 3, len(t or "")) for i, t in rows], DOCS)


EDGES = [
    (5, None), (4, ""), (3, "   \n"), (2, "one"), (2, "one"), (None, "no id é à b"), (9, "word " * 30_000),
    (8, "x" * 50_000), (7, "a 漢字　wide space\tend "), (6, "tie tie tie")]


# --- token files ------------------------------------------------------------------------------


def test_packed_ids_round_trip():
    draw = random.Random(3)
    kinds = [0, 1, 3, 200, 2**14, 2**20, 2**31, 2**60 - 1, 2**60, 2**64 - 1]
    for n in (0, 1, 59, 60, 61, 1000):
        ids = np.array([draw.choice(kinds) for _ in range(n)], np.uint64)
        words, first = token_files.pack(ids, 64)
        assert (token_files.unpack(words) == ids).all()
        extent = token_files.write_extent([1, None], np.array([n, 0]), ids, 64)
        assert (token_files.read_extent(extent)[2] == ids).all()
        if n > 64:
            assert (token_files.read_extent(extent, 1) == ids[64:128]).all()
        assert len(first) == -(-n // 64) + 1


def test_small_ids_share_words():
    words, _ = token_files.pack(np.ones(600, np.uint64), 600)
    assert len(words) == 10


def test_segments_do_not_change_ids():
    from tokenizers import Tokenizer

    plain, draw = Tokenizer.from_file(BPE), random.Random(1)
    parts = [" ", "  ", "a", "b'", "'s", "é", "à", "\n", " ", " ", "　", "1", ".", "漢",
             "\x1d", "\x85", "<|endoftext|>", "﻿", "​"]
    texts = ["".join(draw.choices(parts, k=20)) for _ in range(400)] + [t or "" for _, t in EDGES]
    ids, lengths = token_files.encoder(BPE).encode(pa.array(texts, pa.large_string()))
    ends = np.cumsum(lengths)
    for text, end, n in zip(texts, ends, lengths, strict=True):
        assert ids[end - n:end].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_token_files_take_some_text_at_a_time(spark, tmp_path, monkeypatch):
    """Extents are cut by bytes of text, and give what one extent gives."""
    rows = [(k, f"text number {k} " * 9) for k in range(60)]
    whole = token_files.token_files(frame(spark, rows), BPE, 2, str(tmp_path / "one")).collect()
    assert token_files.CHUNK_BYTES <= 8 << 20
    monkeypatch.setattr(token_files, "CHUNK_BYTES", 1000)
    cut = token_files.token_files(frame(spark, rows), BPE, 2, str(tmp_path / "many")).collect()
    assert sorted(cut) == sorted(whole)
    extents = [spark.read.parquet(str(tmp_path / name)).count() for name in ("one", "many")]
    assert extents[1] > 5 and extents[1] > extents[0]


def test_token_files(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    found = token_files.token_files(frame(spark, EDGES), BPE, 2).collect()
    rows = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, expected = 0, []
    for doc_id, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected


def test_token_files_of_nothing(spark):
    assert token_files.token_files(frame(spark, []), BPE, 2).collect() == []


# --- pieces -----------------------------------------------------------------------------------


def best_score(vocabulary, text):
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - vocabulary.longest), end):
            i = vocabulary.ids.get(text[begin:end])
            if i is not None:
                best[end] = max(best[end], best[begin] + vocabulary.scores[i])
        if text[end - 1] not in vocabulary.ids:
            best[end] = max(best[end], best[end - 1] + vocabulary.unknown)
    return best[-1]


def test_stream_finds_the_best_way_and_commits():
    vocabulary, draw = pieces.pieces(MODEL), random.Random(5)
    for alphabet in ("abcdefgh", "aaaab", "the and ing", "漢é_=12x"):
        text = "".join(draw.choices(alphabet.replace(" ", ""), k=2000))
        runs = list(vocabulary.stream(text))
        ids = [i for run in runs for i in run]
        assert len(runs) > 5
        if all(c in vocabulary.ids for c in alphabet.replace(" ", "")):
            assert sum(vocabulary.scores[i] for i in ids) == pytest.approx(best_score(vocabulary, text))
        assert vocabulary.decode(np.array(ids), np.array([len(ids)]))[0].as_py().decode() == text[1:]


def test_encode_and_decode(spark):
    rows = [*EDGES, (11, "Hello  world\n\tfoo é \U0001f600"), (12, "mark ▁ inside")]
    encoded = pieces.encode_texts(frame(spark, rows), MODEL)
    found = encoded.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i, _ in rows)
    assert {r.doc_id for r in found if not r.round_trip} == {12}
    assert all(r.n_tokens == len(r.ids) for r in found)
    texts = {r.doc_id: r.text for r in pieces.decode_ids(encoded, MODEL).collect()}
    assert texts == {i: (t or "").replace("▁", " ") for i, t in rows}
    assert pieces.encode_texts(frame(spark, []), MODEL).collect() == []


# --- secrets ----------------------------------------------------------------------------------


def brute_spans(text):
    """The patterns as plainly as they are given."""
    kinds = (
        (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", lambda m: len(m[0]) >= 24))
    found = [(m.start(), k, m.end()) for k, (p, keep) in enumerate(kinds)
             for m in re.finditer(p, text) if keep(m)]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_spans(spark):
    draw = random.Random(2)
    parts = ["password", "PassWD", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abc", "0123456789abcdef",
             "AKIA", "ABCDEFGH12345678", "é", "\n", "secret", "K", "s", "/x.", "ſecret"]
    texts = ["".join(draw.choices(parts, k=14)) for _ in range(300)]
    rows = list(enumerate(texts, 100)) + EDGES
    found = secret_scan.scan(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for doc_id, text in rows:
        base = brute_spans(text or "")
        assert by_id[doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        own = [s for s in by_id[doc_id].spans.split(",") if s and not s.startswith("novel")]
        assert ",".join(own) == base
    assert secret_scan.scan(frame(spark, [])).collect() == []


def test_novel_strings_need_context_and_must_not_compress():
    key = "q7Rk2ZpX9vLw4TnB8sYc1MdE"
    assert secret_scan.novel_spans(f"the bearer is {key} here", [])
    assert not secret_scan.novel_spans(f"the colour is {key} here", [])
    assert not secret_scan.novel_spans("the bearer is getUserAccountSession1 here", [])
    assert not secret_scan.novel_spans(f"see {key} again: bearer {key} here", [])
    assert not secret_scan.novel_spans("the bearer is 0123456789abcdefABCDEF1 here", [])


def test_masking_keeps_rows_and_columns(spark):
    text = 'é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'
    docs = frame(spark, [*EDGES, (20, text)])
    masked = secret_scan.mask_secrets(docs)
    assert masked.columns == docs.columns
    found = {r.doc_id: r for r in masked.collect()}
    assert found[20].text == 'é [secret]" end' and found[20].n_chars == len('é [secret]" end')
    assert all(found[i].text == t for i, t in EDGES)


# --- decontamination --------------------------------------------------------------------------


def test_contained_items(spark):
    draw = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(draw.choices(vocabulary, k=n))) for k, n in enumerate([1, 3, 5, 9, 14, 40, 300])]
    items += [(50, None), (51, ""), (52, " ,. "), (4, items[4][1])]
    docs = []
    for doc_id in range(100, 300):
        words = draw.choices(vocabulary, k=draw.choice([0, 4, 80, 900]))
        if doc_id % 3 == 0:
            _, passage = draw.choice(items[:7])
            part = passage.split()[draw.choice([0, 0, 1, 3]):]
            if draw.random() < 0.3 and len(part) > 8:
                part[len(part) // 2] = "changed"
            at = draw.randrange(len(words) + 1)
            words[at:at] = ["(" + part[0].upper(), *part[1:-1], part[-1] + ".)"] if len(part) > 1 else part
        docs.append((doc_id, " ".join(words)))
    docs += EDGES

    def shingles(text, n):
        words = decontaminate.normal_words(text)
        return {tuple(words[k:k + n]) for k in range(len(words) - n + 1)}

    expected = []
    for doc_id, text in docs:
        for item_id, passage in items:
            n = min(5, len(decontaminate.normal_words(passage)))
            wanted = shingles(passage, n) if n else set()
            shared = len(wanted & shingles(text, n)) if n else 0
            if wanted and shared >= 0.8 * len(wanted):
                expected.append((doc_id, item_id, len(wanted), shared))
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    order = lambda rows: sorted((r[0] is None, *r[:4]) for r in rows)
    for size in (4 << 20, 300):  # one block, and several
        found = decontaminate.contaminated(frame(spark, docs), tests, block_bytes=size).collect()
        assert order(map(tuple, found)) == order(expected)
    gone = {r[0] for r in expected}
    assert 20 < len(gone) < 100
    left = decontaminate.drop_contaminated(frame(spark, docs), tests)
    assert left.columns == frame(spark, []).columns
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(
        str(i) for i, _ in docs if i not in gone)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(frame(spark, docs), none).collect() == []
    assert decontaminate.contaminated(frame(spark, []), tests).collect() == []
