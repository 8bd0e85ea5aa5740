"""Near duplicates, repeats, top-k, language model and classifiers against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import components, kd_search, near_dups, ngram_lm, quality, repeats, toxicity
from ledgerlens.llm.elias_fano import EliasFano
from ledgerlens.llm.word_features import labelled_sample

DOCS = "doc_id bigint, text string, lang string, node bigint, score double, kept boolean, row_key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 1, 1.0, None, "k") for i, t in rows], DOCS)


EDGES = [(5, None), (4, ""), (3, "   \n"), (2, "one"), (12, "ONE "), (None, "no id here"), (6, "tie tie tie")]


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


# --- near duplicates --------------------------------------------------------------------------


def shingle_set(text, size):
    words = words_of(text)
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[k:k + size]) for k in range(len(words) - size + 1))


def brute_components(rows, size):
    sets = [shingle_set(t, size) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return [(d, len(sets[k]), least.get(find(k)) if sets[k] else d) for k, (d, _) in enumerate(rows)]


def near_rows(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for family in range(12):
        base = draw.choices(vocabulary, k=draw.choice([6, 40, 120]))
        for _ in range(draw.choice([1, 2, 25])):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4, 9])):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            rows.append((1000 + len(rows) * 7 % 997, " ".join(text)))
    return rows + EDGES


@pytest.mark.parametrize("size", [2, 5])
def test_components_match_all_pairs(spark, size):
    rows = near_rows(size)
    found = near_dups.near_duplicates(frame(spark, rows), size).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r)[:3] for r in found), key=key) == sorted(brute_components(rows, size), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)


def test_blocks_of_a_family_link_across(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_NODES", 4)
    rows = near_rows(9)
    found = near_dups.near_duplicates(frame(spark, rows), 2).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r)[:3] for r in found), key=key) == sorted(brute_components(rows, 2), key=key)


def test_nodes_far_from_their_pivot_meet_again(spark):
    near, far = [0] * near_dups.SIGNATURE_WORDS, [-1] * near_dups.SIGNATURE_WORDS
    nodes = spark.createDataFrame(
        [(1, [11, 12, 13], far), (2, [11, 12, 20], near), (3, [11, 12, 30], near), (4, [40], near), (5, [13], near)],
        "node bigint, bands array<bigint>, signature array<bigint>")
    assert {tuple(r) for r in near_dups.families(nodes, 0.55).collect()} == {(2, 2), (3, 2)}


def test_linked_is_complete():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**60, 60).astype(np.uint64)
    sets = []
    for _ in range(80):
        own = base.copy()
        at = draw.choice(60, draw.integers(0, 12), replace=False)
        own[at] = draw.integers(0, 2**60, len(at)).astype(np.uint64)
        sets.append(np.unique(own))

    def roots(links):
        forest = near_dups.Forest(len(sets))
        for a, b in links:
            forest.join(a, b)
        return [forest.find(k) for k in range(len(sets))]

    pairs = []
    for a in range(80):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                pairs.append((b, a))
    assert roots(near_dups.linked(sets, 80)) == roots(pairs)


def test_estimate_is_close(spark):
    draw = np.random.default_rng(2)
    rows, real = [], []
    for share in (0.3, 0.6, 0.9):
        common = draw.integers(0, 2**62, int(2000 * share)).astype(np.uint64)
        a, b = (np.append(common, draw.integers(0, 2**62, 1000).astype(np.uint64)) for _ in range(2))
        rows.append([near_dups.packed(near_dups.minima(s)).view(np.int64).tolist() for s in (a, b)])
        real.append(len(common) / (len(common) + 2000))
    pairs = spark.createDataFrame(rows, "x array<bigint>, y array<bigint>")
    found = [r.e for r in pairs.select(near_dups.estimate("x", "y").alias("e")).collect()]
    assert found == pytest.approx(real, abs=0.13)


def test_one_of_each_group_stays(spark):
    text = "a b c d e f g h i j k l m n o p"
    rows = [(9, text), (3, text), (3, text), (None, text), (None, "all alone with no id at all"), (7, "other words")]
    docs = frame(spark, rows + EDGES[:3] + EDGES[:1])
    left = near_dups.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    expected = [(3, text), (None, "all alone with no id at all"), (7, "other words"), *EDGES[:3], EDGES[0]]
    assert found == sorted(expected, key=str)
    assert near_dups.drop_near_duplicates(frame(spark, [])).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3)]
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(41)} | {(k, 100) for k in range(100, 130)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# --- repeats ----------------------------------------------------------------------------------


def brute_repeats(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[k:k + 200] for _, b in texts for k in range(len(b) - 199))
    out = []
    for doc_id, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k:k + 200]] > 1:
                gone[k:k + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("most", "heavy"), [(8192, 1 / 2000), (2, 0.1)])
def test_repeats_match_brute_force(spark, monkeypatch, most, heavy):
    monkeypatch.setattr(repeats, "BUCKET_RUNS", most)
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    draw = random.Random(3)
    passage = "".join(draw.choices("abcdefgh é", k=420))
    rows = [(1, "a" * 700), (2, "ab" * 260), (3, "x" * 199), (4, "é" * 150), (4, "é" * 150), (None, passage)]
    for k in range(5, 30):
        text = "".join(draw.choices("abcdefgh é", k=draw.choice([150, 600])))
        part = list(passage[draw.randrange(100):])
        if draw.random() < 0.7:
            part[draw.randrange(len(part))] = "#"
        rows.append((k, text + "".join(part) if draw.random() < 0.8 else text))
    rows += EDGES
    found = repeats.remove_repeats(frame(spark, rows)).collect()
    assert sorted(map(tuple, found), key=str) == brute_repeats(rows)
    assert repeats.remove_repeats(frame(spark, [])).collect() == []


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_suffix_sorter(letters):
    draw = np.random.default_rng(letters)
    text = draw.integers(97, 97 + letters, 1500).astype(np.uint8)
    text[900:1300] = text[100:500]
    starts, whole = np.arange(1301), text.tobytes()
    sorter = repeats.SuffixSorter(text)
    ordered = np.concatenate(list(sorter.blocks(starts, 300))).tolist()
    windows = [whole[k:k + 200] for k in ordered]
    assert windows == sorted(windows)
    count = Counter(windows)
    assert sorted(sorter.repeated(starts).tolist()) == [k for k in starts if count[whole[k:k + 200]] > 1]


def test_cover_meets_every_difference():
    for period in (8, 32, 64):
        cover = repeats.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


# --- top k ------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k(spark, block):
    draw = random.Random(6)
    rows = [(k, [draw.uniform(-1, 1) for _ in range(5)], k) for k in range(300)]
    rows += [(k, [0.5] * 5, k) for k in range(300, 420)]  # ties
    rows += [(1000, None, 0), (1020, [None] * 5, 0), (1040, [float("nan")] * 5, 0), (1060, [1.0, float("inf")] * 2, 0),
             (None, [0.1] * 5, 0), (1080, [0.25, 0.5], 0), (1100, [0.5, 0.25], 0), (1121, [], 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    whole = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v, _ in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    expected = []
    for q in (i for i in whole if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i)
                        for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        expected += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:10], 1)]
    found = kd_search.top_k(table, "vec_id % 20 = 0", shard=64, block=block, leaf=8).collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    assert kd_search.top_k(table.where("vec_id < 0"), "vec_id % 20 = 0").collect() == []


# --- language model ---------------------------------------------------------------------------


def test_elias_fano():
    draw = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 5), (1000, 10**3), (3000, 2**62), (2000, 4000)):
        values = np.sort(draw.integers(0, top, n).astype(np.uint64))
        coded = EliasFano.encode(values)
        assert (coded.get(np.arange(n)) == values).all()
        wanted = draw.integers(0, top, 300).astype(np.uint64)
        assert (coded.find(wanted, np.zeros(300), np.full(300, n)) == np.searchsorted(values, wanted)).all()


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 700)
    draw = random.Random(8)
    rows = [(k, " ".join(draw.choices("The the of and a ran dog cat sat on mat".split() + [f"w{k % 50}"],
                                      k=draw.choice([1, 30, 200])))) for k in range(100, 160)]
    rows += EDGES + EDGES[3:4]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    single, pair, kept, rest = Counter(), Counter(), Counter(), Counter()
    for i, text in rows:
        if i is not None and not held[i]:
            tokens = [*words_of(text), "\n"]
            single.update(tokens)
            pair.update(zip(["\n", *tokens], tokens, strict=False))
    for (v, _), n in pair.items():
        kept[v] += n > 1
        rest[v] += n if n == 1 else 0
    total, distinct = sum(single.values()), len(single)

    def probability(v, w):
        p = (single[w] + 1) / (total + distinct + 1)
        if not single[v]:
            return p
        return max(pair[v, w] - 0.75, 0) * (pair[v, w] > 1) / single[v] + (0.75 * kept[v] + rest[v]) / single[v] * p

    found = ngram_lm.held_out_scores(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        tokens = [*words_of(texts[r.doc_id]), "\n"]
        base = sum(math.log10((single[w] + 1) / (total + distinct + 1)) for w in tokens)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(tokens), total)
        assert r.n_known == sum(single[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        exact = sum(math.log10(probability(v, w)) for v, w in zip(["\n", *tokens], tokens, strict=False))
        assert r.score == pytest.approx(exact, rel=0.03, abs=0.05)  # codes of 8 bits
    assert ngram_lm.held_out_scores(frame(spark, [])).collect() == []


@pytest.mark.parametrize("prune", [0, 1])
def test_language_model_of_three_words(spark, monkeypatch, prune):
    """Tries of three levels, with chunks and shards so small that contexts meet from many chunks."""
    monkeypatch.setattr(ngram_lm, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 700)
    draw = random.Random(9)
    rows = [(k, " ".join(draw.choices("The the of and a ran dog cat sat on mat".split() + [f"w{k % 50}"],
                                      k=draw.choice([1, 30, 200])))) for k in range(100, 150)]
    rows += EDGES + EDGES[3:4]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    single, pair, triple = Counter(), Counter(), Counter()
    for i, text in rows:
        if i is not None and not held[i]:
            tokens = [*words_of(text), "\n"]
            single.update(tokens)
            pair.update(zip(["\n", *tokens], tokens, strict=False))
            triple.update(zip(["\n", "\n", *tokens], ["\n", *tokens], tokens, strict=False))
    total, distinct = sum(single.values()), len(single)

    def discounted(counts, context, w, lower):
        seen = {g[-1]: n for g, n in counts.items() if g[:-1] == context}
        if not seen:
            return lower
        kept = {x: n for x, n in seen.items() if n > prune}
        mass = (0.75 * len(kept) + sum(seen.values()) - sum(kept.values())) / sum(seen.values())
        return max(kept.get(w, 0) - 0.75, 0) / sum(seen.values()) + mass * lower

    known = {}

    def probability(u, v, w):
        if (u, v, w) not in known:
            lower = discounted(pair, (v,), w, (single[w] + 1) / (total + distinct + 1))
            known[u, v, w] = discounted(triple, (u, v), w, lower)
        return known[u, v, w]

    found = ngram_lm.held_out_scores(frame(spark, rows), order=3, prune=prune).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        tokens = [*words_of(texts[r.doc_id]), "\n"]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(tokens), total)
        exact = sum(math.log10(probability(*g)) for g in zip(["\n", "\n", *tokens], ["\n", *tokens], tokens, strict=False))
        assert r.score == pytest.approx(exact, rel=0.03, abs=0.05)  # codes of 8 bits
    assert ngram_lm.held_out_scores(frame(spark, []), order=3, prune=prune).collect() == []
    none = ngram_lm.score_texts(frame(spark, rows[:3]), F.lit(False), 3, prune).collect()  # nothing learnt
    assert all(r.score == r.base_score == 0 for r in none)


# --- classifiers ------------------------------------------------------------------------------


def labelled(seed, n):
    draw = random.Random(seed)
    plain = [f"{a}{b}" for a in ("mal", "ter", "pon", "sil", "var") for b in ("o", "an", "ir", "es", "um")]
    rows = []
    for k in range(100, 100 + n):
        text = draw.choices(plain, k=draw.choice([5, 60, 300]))
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                text.insert(draw.randrange(len(text)), "grobn" + draw.choice(["a", "ul", "ix", "eth", "ond"]))
        rows.append((k, " ".join(text), int(bad)))
    return rows


def test_toxicity_on_held_out_documents(spark):
    rows = labelled(1, 600)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + EDGES + EDGES[3:4])
    labels = spark.createDataFrame([(i, b, 1) for i, _, b in rows] + [(None, 1, 1), (100, None, 1)],
                                   "doc_id bigint, toxic int, quality int")
    network = toxicity.fit(docs, labels)
    found = {r.doc_id: r for r in toxicity.score_texts(docs, network).collect()}
    held = [(found[i], b) for i, _, b in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in held) and not found[None].held_out
    assert sum(r.predicted == b for r, b in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())
    left = toxicity.drop_toxic(docs, network)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, r in found.items() if not r.predicted}
    assert toxicity.score_texts(frame(spark, []), network).collect() == []


def test_gradients_match_differences():
    network = toxicity.Network(2)
    found = toxicity.words(pa.array(["some words are here", "and others there now"], pa.large_string()))
    windows, _ = toxicity.windows_of(found.index, found.offsets)
    features = toxicity.word_features(found.vocabulary, toxicity.WORD_BITS, toxicity.GRAM_BITS)
    for name, value in network.weights.items():
        network.weights[name] = value.astype(np.float64)
    target = np.array([1.0, 0.0])
    gradients = network.learn(features, windows.T, target)

    def loss():
        odds = network.scores(features, windows).astype(np.float64)
        return np.mean(np.log1p(np.exp(-odds)) * target + np.log1p(np.exp(odds)) * (1 - target))

    for name, g in gradients.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        step = 1e-3
        network.weights[name][at] += step
        up = loss()
        network.weights[name][at] -= 2 * step
        assert (up - loss()) / (2 * step) == pytest.approx(g[at], rel=0.05, abs=1e-4), name
        network.weights[name][at] += step


def test_windows_cover_texts():
    for n in (0, 1, 31, 32, 33, 57, 500):
        starts = toxicity.window_starts(n)
        covered = {k for s in starts for k in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n))


def test_quality_grades(spark):
    rows = [(i, t + " ### ***" * (20 if b else 0), b) for i, t, b in labelled(2, 240)]
    rows = [(i, t, 0 if b else 1 + i % 2) for i, t, b in rows]
    rows = [(i, t + (" lorem" * 9 if g == 2 else ""), g) for i, t, g in rows]
    docs = frame(spark, [(i, t) for i, t, _ in rows] + EDGES)
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows] + [(101, None)], "doc_id bigint, grade int")
    model = quality.fit(docs, ratings, ratings["grade"], 3)
    assert (np.diff(model.thresholds) > 0).all()
    found = {r.doc_id: r for r in quality.grade_texts(docs, model, 1).collect()}
    assert len(found) == len(rows) + len(EDGES)
    assert sum(found[i].selected == (g > 0) for i, _, g in rows) >= 0.97 * len(rows)
    means = [np.mean([found[i].expected_grade for i, _, g in rows if g == k]) for k in range(3)]
    assert means == sorted(means)
    assert not found[5].selected and not found[3].selected
    assert quality.grade_texts(frame(spark, []), model, 1).collect() == []


def test_samples_are_bounded(spark):
    docs = frame(spark, [(1, "repeated row")] * 50 + [(2, "x" * 900), (3, "short"), (4, None), (5, "five five")])
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4, 5, 5)] + [(None, 1)], "doc_id bigint, toxic int")
    found = labelled_sample(docs, labels, F.col("toxic"), {1: 10, 0: 10}, 4000).collect()
    assert sorted((r.doc_id, r.text) for r in found) == [(1, "repeated row"), (3, "short"), (4, ""), (5, "five five")]
    few = labelled_sample(docs, labels, F.col("toxic"), {1: 10, 0: 10}, 120).collect()
    assert 0 < sum(len(r.text) for r in few) <= 120


def test_toxicity_learns_from_whole_long_texts(spark):
    """Texts of over 60 windows, toxic for a stretch in some place."""
    draw = random.Random(4)
    rows, labels = [], []
    for doc in range(150):
        text = draw.choices([f"w{k}" for k in range(50)], k=1500)
        labels.append((doc, doc % 2))
        if doc % 2:
            at = draw.randrange(len(text) - 300)
            text[at:at + 300] = draw.choices(["vile", "words", "w1", "w2"], k=300)
        rows.append((doc, " ".join(text)))
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    found = toxicity.score_texts(frame(spark, rows), toxicity.fit(frame(spark, rows), table)).collect()
    right = [(r.score >= 0.5) == (r.doc_id % 2 == 1) for r in found if r.held_out]
    assert sum(right) / len(right) >= 0.9


def test_quality_without_ratings_selects_nothing(spark):
    docs = frame(spark, [(1, "some words"), (2, "")])
    model = quality.fit(docs, spark.createDataFrame([], "doc_id bigint, grade int"), F.col("grade"), 3)
    found = quality.grade_texts(docs, model, 1).collect()
    assert [(r.expected_grade, r.selected) for r in found] == [(0.0, False)] * 2


def test_remembered_segments_are_bounded():
    from ledgerlens.llm.arrow_text import RememberedInBytes

    kept = RememberedInBytes(limit=2000)
    for begin in range(0, 60, 7):
        values = pa.array([f"segment {k}".encode() for k in range(begin, begin + 9)], pa.large_binary())
        bounds, numbers = kept.lists(values, lambda new: (
            np.arange(len(new) + 1) * 2, np.repeat([int(v.split()[1]) for v in new.to_pylist()], 2)))
        assert numbers.tolist() == [k for k in range(begin, begin + 9) for _ in range(2)]
        assert bounds.tolist() == list(range(0, 19, 2))
        assert kept.held <= 2000


def test_many_vectors_without_components(spark):
    rows = [(k, []) for k in range(90)] + [(1000, [1.0]), (1001, [2.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = kd_search.top_k(table, F.col("vec_id") % 50 == 0, k=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == [
        (0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 3, 0), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0),
        (1000, 1, 1001, 2 << 20)]


def test_kept_goes_by_the_id(spark, tmp_path):
    """Two rows of one doc_id, with texts that are near but not the same."""
    from ledgerlens.llm.queries import op7_near_dedup

    base = [f"w{k}" for k in range(60)]
    rows = [(3, " ".join(base)), (3, " ".join([*base, "more"])), (9, " ".join(base)), (None, "alone here"), (4, "")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = op7_near_dedup(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found) == [
        (0, 0, True), (3, 3, True), (3, 3, True), (4, 4, True), (9, 3, False)]


@pytest.mark.parametrize("last", ["end ", " ", "\n end\t"])
def test_white_space_at_the_end_of_a_chunk(last):
    """An empty piece is no word, also where it is the last new one."""
    from ledgerlens.llm.arrow_text import words

    texts = pa.array(["some words", "", last], pa.large_string())
    found = words(texts)
    assert [found.vocabulary[int(k)].as_py() for k in found.index] == ["some", "words", *last.split()]
    assert "" not in found.vocabulary.to_pylist() and found.offsets.tolist() == [0, 2, 2, 2 + len(last.split())]
    scores = toxicity._scores(toxicity.Network(2), texts)
    assert np.isfinite(scores).all()


def test_finer_buckets_take_bands_that_others_have(spark):
    """Nodes far from their pivot go to finer buckets by common bands alone, and still meet there."""
    rng = np.random.Generator(np.random.PCG64(5))
    apart = [rng.integers(0, 2**62, near_dups.SIGNATURE_WORDS).tolist() for _ in range(40)]
    rows = [(k, [7, *range(1000 * k + 100, 1000 * k + 143)], apart[k]) for k in range(40)]
    rows += [(50 + k, [7, 8, 9, *range(90_000 + 100 * k, 90_000 + 100 * k + 41)], apart[1]) for k in range(2)]
    nodes = spark.createDataFrame(rows, "node bigint, bands array<bigint>, signature array<bigint>")
    sizes, plain = [], near_dups.buckets

    def counted(keyed):
        sizes.append(keyed.count())
        return plain(keyed)

    near_dups.buckets = counted
    try:
        found = {tuple(r) for r in near_dups.families(nodes, 0.55).collect()}
    finally:
        near_dups.buckets = plain
    assert found == {(50, 50), (51, 50)} and sizes == [42 * 44, 2 * 2]


def finer_keys(spark, rows, monkeypatch):
    """Families of nodes, and the keys of their finer buckets as they come."""
    nodes = spark.createDataFrame(rows, "node bigint, bands array<bigint>, signature array<bigint>")
    keyed, plain = [], near_dups.buckets

    def kept(frame):
        keyed.append([tuple(r) for r in frame.collect()])
        return plain(frame)

    monkeypatch.setattr(near_dups, "buckets", kept)
    found = dict(tuple(r) for r in near_dups.families(nodes, 0.55).collect())
    return found, keyed[1]


def test_nodes_of_one_family_make_no_finer_keys(spark, monkeypatch):
    """A large group of near copies that shares a line with others, and two unlike groups in its buckets."""
    rng = np.random.Generator(np.random.PCG64(6))
    apart = [rng.integers(0, 2**62, near_dups.SIGNATURE_WORDS).tolist() for _ in range(5)]
    own = list(range(100, 142))
    rows = [(1, [7, 8, *range(1000, 1042)], apart[0])]
    rows += [(k, [7, 8, *own], apart[1]) for k in range(10, 60)]
    rows += [(k, [7, 9, *range(3000 + 100 * k, 3042 + 100 * k)], apart[2]) for k in (70, 71, 72)]
    rows += [(2, [9, *range(2000, 2043)], apart[3])]
    found, keyed = finer_keys(spark, rows, monkeypatch)
    # all but the pivots 1 and 2 meet again by their common bands, and nobody by a band of one family alone
    assert sorted(keyed) == sorted([(k, 7 ^ 8) for k in range(10, 60)] + [(k, 7 ^ 9) for k in (70, 71, 72)])
    assert found == {**dict.fromkeys(range(10, 60), 10), **dict.fromkeys((70, 71, 72), 70)}


def test_finer_keys_come_once(spark, monkeypatch):
    """Two bands make one key of a node, however many far pivots have brought it there."""
    rng = np.random.Generator(np.random.PCG64(7))
    apart = [rng.integers(0, 2**62, near_dups.SIGNATURE_WORDS).tolist() for _ in range(4)]
    rows = [(1, [11, 12, 13], apart[0]), (2, [11, 14, 21], apart[1]), (3, [12, 14, 31], apart[2])]
    rows += [(k, [11, 12, 13, 14], apart[3]) for k in (50, 51, 52)]
    found, keyed = finer_keys(spark, rows, monkeypatch)
    assert len(keyed) == len(set(keyed)) and {k for k in keyed if k[0] == 50} == {
        (50, a ^ b) for a, b in ((11, 12), (11, 13), (11, 14), (12, 13), (12, 14), (13, 14))}
    assert found == dict.fromkeys((50, 51, 52), 50)


def test_many_places_are_read_in_one_pass(monkeypatch):
    """Few places and many give the same values; many take no search step by step."""
    draw = np.random.default_rng(11)
    for top in (3, 5000, 2**62):
        values = np.sort(draw.integers(0, top, 2000).astype(np.uint64))
        coded = EliasFano.encode(values)
        index = draw.integers(0, 2000, 900)
        wanted = draw.integers(0, top, 900).astype(np.uint64)
        begin = draw.integers(0, 2000, 900)
        end = np.maximum(begin, draw.integers(0, 2001, 900))
        few = [np.concatenate([f(slice(k, k + 90)) for k in range(0, 900, 90)]) for f in (
            lambda k: coded.get(index[k]), lambda k: coded.find(wanted[k], begin[k], end[k]))]
        brute = [b + np.searchsorted(values[b:e], w) for b, e, w in zip(begin, end, wanted, strict=True)]
        assert (few[0] == values[index]).all() and (few[1] == brute).all()
        assert (coded.all() == values).all() and (coded.get(index) == values[index]).all()
        with monkeypatch.context() as steps:
            steps.setattr(EliasFano, "get", lambda *_: pytest.fail("searched step by step"))
            assert (coded.find(wanted, begin, end) == brute).all()
    none = EliasFano.encode(np.zeros(0, np.uint64))
    assert none.find(np.ones(3, np.uint64), np.zeros(3), np.zeros(3)).tolist() == [0, 0, 0] and len(none.all()) == 0
