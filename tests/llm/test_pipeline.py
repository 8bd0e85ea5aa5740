"""The corpus pipeline against what plain code keeps, on documents with planted cases."""

import random
import re

import public_tokenizers
import pytest

import corpus_pipeline
from ledgerlens.llm import pieces
from ledgerlens.llm.queries import PIECE_MODEL

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, score double, label int"
ITEM = "which of these seven planets turns around its own axis the fastest of all"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    words = words_of(text)
    size = min(5, len(words))
    return frozenset(tuple(words[k:k + size]) for k in range(len(words) - size + 1)) if words else frozenset()


def corpus(seed):
    draw = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("mal", "ter", "pon", "sil") for b in ("o", "an", "ir") for c in ("s", "ta", "un", "el")]
    rows, toxic = [], set()
    for k in range(100, 500):
        text = draw.choices(plain, k=draw.choice([20, 60, 200]))
        if k % 4 == 0:
            toxic.add(k)
            for _ in range(3):
                text.insert(draw.randrange(len(text)), "grobn" + draw.choice(["a", "ul", "ix", "eth", "ond"]))
        rows.append((k, " ".join(text)))
    base = draw.choices(plain, k=120)
    near = list(base)
    near[60] = "changed"
    rows += [(5003, " ".join(base)), (5001, " ".join(near)), (5002, " ".join(base)), (5002, " ".join(base))]
    rows += [(6000, " ".join(draw.choices(plain, k=90)) + " " + ITEM + ". " + " ".join(draw.choices(plain, k=90)))]
    rows += [(7000, " ".join(draw.choices(plain, k=30)) + " password = hunter2hunter2 " + " ".join(draw.choices(plain, k=9)))]
    rows += [(8000, None), (8001, ""), (8002, " \n "), (8003, "one"), (8004, "one"), (None, "nobody has this number")]
    rows += [(9000, " ".join(draw.choices(plain, k=6000)))]
    return rows, toxic


@pytest.fixture(scope="module")
def outcome(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows, toxic = corpus(3)
    spark.createDataFrame(
        [(i, t, "xx", "s", len(t or ""), 1, 0.5, 7) for i, t in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows if i is not None and i < 5000],
                          "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id bigint, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(folder))
    model = public_tokenizers.path(PIECE_MODEL)
    texts = {}
    for r in pieces.decode_ids(found, model).collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    return rows, toxic, found.collect(), texts


def test_keeps_what_plain_code_keeps(outcome):
    rows, toxic, found, _ = outcome
    clean = [(i, t) for i, t in rows if i not in toxic]
    sets = [shingles(t) for _, t in clean]
    label = list(range(len(clean)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(clean)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    order = lambda k: (clean[k][0] is None, clean[k][0] or 0)
    groups = {}
    for k in range(len(clean)):
        groups.setdefault(find(k), []).append(k)
    kept = [clean[k] for members in groups.values() for k in ([min(members, key=order)] if sets[members[0]] else members)]
    kept = [i for i, t in kept if " ".join(words_of(ITEM)) not in " ".join(words_of((t or "").replace(".", "")))]
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(map(str, kept))
    assert {5001, 8000, 8001, 8002, 8003, 9000} <= set(kept) and not {5002, 5003, 6000, 8004} & set(kept)


def test_texts_come_back_without_secrets(outcome):
    rows, _, found, texts = outcome
    given = {i: t or "" for i, t in rows}
    assert all(r.round_trip for r in found)
    for doc_id, back in texts.items():
        expected = given[doc_id].replace("password = hunter2hunter2", "[secret]")
        assert back == [expected] or "hunter2" not in back[0] and back[0].startswith(expected[:40])


def test_stages_and_empty_tables(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "secrets", "sentencepiece"]
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
