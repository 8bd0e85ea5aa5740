"""SimHash groups against plain fingerprints and all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ledgerlens.llm import simhash as S
from ledgerlens.llm.components import components

DOCS = "doc_id bigint, text string, fingerprint string, anchor int, part int, label string, a bigint"


def slow_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 4]).encode(), 42)
              for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return [find(k) for k in range(len(prints))]


def texts(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)] + ["Ärger", "ß", "Word", "word"]
    out = [None, "", " \n\t", "One", "one two", "a b  c\nD", "a b c d", "zero " * 5000]
    for _ in range(15):
        base = draw.choices(vocabulary, k=draw.choice([4, 30, 300]))
        for _ in range(draw.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 2])):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            out.append(draw.choice([" ", "\n", "  "]).join(copy))
    return out


@pytest.mark.parametrize("shingles", [7, 1 << 18])
def test_fingerprints(monkeypatch, shingles):
    monkeypatch.setattr(S, "SHINGLES", shingles)
    given = texts(1)
    found = S.fingerprints_of(pa.array([t or "" for t in given], pa.large_string()))
    assert found.tolist() == [slow_fingerprint(t) for t in given]


def test_fingerprint_is_the_engines_own_hash(spark):
    hashed = spark.sql("SELECT xxhash64('a b c d') AS h").first().h
    assert hashed % 2**64 == slow_fingerprint("A b\tc d")


def test_golay_code_is_perfect():
    rings = S.covering().rings
    assert (np.diff(rings[0][0]) == 1).all()  # one code word within the radius of any word
    draw = np.random.default_rng(1).integers(0, 2**63, 2000, np.uint64)
    assert sum(len(place) for _, place, _ in S.visits(draw)) / 2000 / 3 == pytest.approx(61, abs=2)


@pytest.mark.parametrize("distance", range(5))
def test_visits_reach_the_home_of_whatever_is_near(distance):
    draw = random.Random(distance)
    prints = np.array([draw.getrandbits(64) for _ in range(400)], np.uint64)
    moved = prints ^ np.array([sum(1 << b for b in draw.sample(range(64), distance)) for _ in prints], np.uint64)
    met = np.zeros(len(prints), bool)
    own = S.homes(prints)
    for pair, place, anchors in S.visits(moved):
        met[place[anchors == own[pair][place]]] = True
    assert met.all()


@pytest.mark.parametrize(("residents", "crowd"), [(2048, 1 << 16), (2048, 3), (2, 3)])
def test_links_connect_what_all_pairs_connect(spark, residents, crowd):
    draw = random.Random(residents + crowd)
    prints = {0}
    for _ in range(12):
        center = draw.getrandbits(64)
        for _ in range(draw.choice([1, 2, 25])):
            moved = center
            for bit in draw.sample(range(64), draw.choice([0, 2, 3, 5, 9])):
                moved ^= 1 << bit
            prints.add(moved)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")
    labels = {r.node: r.label for r in components(S.links(frame, residents, crowd)).collect()}
    groups = {}
    for mine, slow in zip([labels.get(p, p) for p in signed], slow_groups(prints), strict=True):
        groups.setdefault(slow, set()).add(mine)
    assert all(len(found) == 1 for found in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


@pytest.mark.parametrize("residents", [2048, 1])
def test_documents(spark, residents):
    given = texts(5)
    draw = random.Random(9)
    ids = draw.sample(range(10_000), len(given))
    rows = [*zip(ids, given, strict=True), (None, "no id"), (None, given[-1]), (ids[-1], given[-1]), (ids[9], given[9])]
    frame = spark.createDataFrame([(i, t, "f", 1, 2, "l", 0) for i, t in rows], DOCS)
    prints = [slow_fingerprint(t) for _, t in rows]
    least = {}
    for (doc, _), group in zip(rows, slow_groups(prints), strict=True):
        if doc is not None:
            least[group] = min(doc, least.get(group, doc))
    expected = sorted(
        (repr(d), f"{p:016x}", repr(least.get(g))) for (d, _), p, g in zip(rows, prints, slow_groups(prints), strict=True))
    found = S.near_duplicates(frame, residents).collect()
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in found) == expected


def test_table_without_rows(spark):
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
