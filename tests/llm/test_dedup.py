import collections
import hashlib
import random

import numpy as np
import pytest

from krigmesh.llm import common
from krigmesh.llm.embedding_dedup import bucket_keys, collision, expected_recall, link_counts, plan
from krigmesh.llm.ngram_join import keep_one, ngram_components
from krigmesh.llm.suffix_dedup import COVER, PERIOD, drop_repeats, repeat_digests


def texts_with_copies(seed=5, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    shared = " ".join(word() for _ in range(70))
    out = [None, "", "  \t\n", "one", "one two", "ONE two", "one two", "é" * 300, "x" * 900]
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 120))]
        out.append(" ".join(w))
        for _ in range(rng.randint(0, 4)):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = word()
            out.append(" ".join(v))
        if i % 4 == 0:
            out.append(" ".join(w[:30]) + " " + shared + " " + " ".join(w[30:]))
    base = [word() for _ in range(150)]
    for i in range(80):
        v = list(base)
        for _ in range(i % 5):
            v[rng.randrange(len(v))] = word()
        out.append(" ".join(v))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, i, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, n int, shingle string")


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return [len(s) for s in sets], roots(len(sets), links)


@pytest.mark.parametrize("k, num, how", [(3, 90, {}), (5, 80, {}), (3, 90, {"few": 0, "order_entries": 3}), (3, 90, {"star_rounds": 0}), (3, 70, {"tile": 5, "block": 3}), (3, 90, {"star_rounds": 0, "tile": 4, "order_entries": 0})])
def test_ngram_join_equals_brute_force(spark, k, num, how):
    texts = texts_with_copies()
    n, root = brute_components(texts, k, num, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(spark, frame(spark, texts), k, num, 100, **how).collect()}
    assert got == {i: (n[i], root[i]) for i in range(len(texts))}
    assert len(set(root)) < len(texts) - 50


def test_ngram_join_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_components(spark, empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "A b  c d")], "doc_id bigint, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.component_id) for r in ngram_components(spark, rows).collect()))
    assert got == [(False, 2, 2), (False, 4, 2), (False, 4, 2), (True, 0, None)]
    assert sorted(r.doc_id or 0 for r in keep_one(spark, rows).collect()) == [0, 2]


def test_ngram_join_ties_rows_that_share_a_key(spark):
    a, b, c = "a b c d e", "p q r s t", "x y z"
    rows = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (8, c), (8, None), (6, c), (1, "k")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(spark, rows).collect())
    assert got == [(1, 1, 1), (3, 3, 3), (5, 3, 3), (5, 3, 3), (6, 1, 6), (7, 3, 3), (8, 0, 6), (8, 1, 6)]
    assert sorted(r.doc_id for r in keep_one(spark, rows).collect()) == [1, 3, 6]


def test_ngram_join_of_very_long_texts(spark):
    rng = random.Random(8)
    w = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    rows = spark.createDataFrame([(9, " ".join(w)), (4, " ".join([*w[:70_000], "one", "two", *w[70_000:]])), (2, " ".join(w[:100_000]))], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in ngram_components(spark, rows).collect()} == {9: 4, 4: 4, 2: 2}


@pytest.mark.parametrize("forest_edges", [10**6, 0])
def test_components(spark, forest_edges):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 450)] + [(500, 500)]
    want = roots(600, links)
    edges = spark.createDataFrame(links, "a bigint, b bigint").repartition(3)
    got = {r.node: r.comp for r in common.components(common.Scratch(spark, "t"), edges, forest_edges=forest_edges).collect()}
    for i in range(600):
        assert got.get(i, i) == want[i]


def brute_repeats(texts, length):
    body = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in body for i in range(len(b) - length + 1))
    out = []
    for b in body:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, how", [(400, {}), (200, {}), (64, {}), (200, {"block_bytes": 2000, "bucket_suffixes": 50}), (200, {"hot_contexts": 1}), (100, {"hot_contexts": 3})])
def test_suffix_dedup_equals_brute_force(spark, length, how):
    texts = texts_with_copies()
    texts += [texts[20] * 3, (texts[25] or "")[:150] + texts[30] + (texts[25] or "")[150:]]
    want = brute_repeats(texts, length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_digests(spark, frame(spark, texts), length=length, **how).collect()}
    assert got == dict(enumerate(want))
    assert sum(0 < w[1] < w[0] for w in want) > 3


@pytest.mark.parametrize("how", [{}, {"block_bytes": 2000, "bucket_suffixes": 50}, {"hot_contexts": 1}, {"hot_contexts": 2}])
def test_two_lengths_in_one_sort(spark, how):
    texts = texts_with_copies()
    texts += [texts[20] * 3, (texts[25] or "")[:150] + texts[30] + (texts[25] or "")[150:], texts[12][:260], texts[12][:205], texts[12][5:300]]
    want, passage = brute_repeats(texts, 250), brute_repeats(texts, 140)
    got = {r.doc_id: r for r in repeat_digests(spark, frame(spark, texts), length=250, passage=140, **how).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == dict(enumerate(want))
    assert {i: (r.passage_bytes, r.passage_spans, r.repeats_passage) for i, r in got.items()} == {i: (w[1], w[2], w[1] > 0) for i, w in enumerate(passage)}
    assert sum(w[1] < p[1] for w, p in zip(want, passage)) > 3


def test_suffix_dedup_of_texts_longer_than_a_piece(spark):
    rng = random.Random(6)
    long_ = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    part = long_[1 << 19 : (1 << 19) + 3000]
    texts = [long_, "x" + part[:700] + "y", long_[:1000] + "z", part * 2]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_digests(spark, frame(spark, texts), length=400).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 400)))


def test_suffix_dedup_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeat_digests(spark, empty).count() == 0
    text = "".join(chr(97 + i * i % 23) for i in range(500))
    rows = spark.createDataFrame([(None, text, "a"), (1, text, "b"), (1, None, "c"), (2, "é" * 150 + "z", "d")], "doc_id bigint, text string, runs string")
    got = drop_repeats(spark, rows, length=400)
    assert got.columns == rows.columns
    assert sorted((r.runs, r.text) for r in got.collect()) == [("a", ""), ("b", ""), ("c", None), ("d", "é" * 150 + "z")]


def test_the_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def brute_links(vectors, cosine):
    ok = [v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v, float)) for v in vectors]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if k else None for v, k in zip(vectors, ok)]
    links = [(i, j) for i in range(len(unit)) for j in range(i) if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine]
    n = collections.Counter(x for p in links for x in p)
    return [n[i] for i in range(len(unit))], roots(len(unit), links)


@pytest.mark.parametrize("tile", [512, 7])
def test_embedding_links_equal_brute_force(spark, tile):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 32))
    v = [*base, *(base[rng.integers(0, 40, 60)] + 0.03 * rng.standard_normal((60, 32))), *(base[0] + 0.02 * rng.standard_normal((30, 32)))]
    vectors = [x.astype(np.float32).tolist() for x in v] + [base[3].astype(np.float32).tolist()] * 3 + [None, [0.0] * 32, [float("nan")] * 32, [None] * 32, [1.0, 2.0], [1.0, 2.0], [float("inf")] * 32, []]
    n, root = brute_links(vectors, 0.95)
    rows = spark.createDataFrame([(i, x, 1, "k") for i, x in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int, keys string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_counts(spark, rows, tile=tile).collect()}
    assert got == {i: (n[i], root[i], root[i] == i) for i in range(len(vectors))}
    assert link_counts(spark, rows.limit(0)).count() == 0


def test_embedding_edges(spark):
    rows = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [2.0, 0.0]), (9, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in link_counts(spark, rows).collect()))
    assert got == [(0, 0, 0, False)] * 2 + [(2, 1, 2, True)] + [(4, 1, 2, False)] * 2 + [(9, 0, 9, True)]


def test_plan_of_tables():
    apart, before = collision(2**0.5, 2.0), None
    for n in (1_000, 50_000, 10**6, 10**8, 10**10):
        tables, projections = plan(n, 0.95)
        assert expected_recall(0.95, tables, projections) >= 0.995 and expected_recall(0.98, tables, projections) > 0.999
        pairs = n * n * tables * apart**projections
        if before:
            assert np.log(pairs / before[1]) / np.log(n / before[0]) < 1.3
        before = n, pairs


@pytest.mark.parametrize("n", [2_000, 20_000_000])
def test_embedding_recall(n):
    tables, projections = plan(n, 0.95)
    rng = np.random.default_rng(9)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    g = rng.standard_normal((4000, 64))
    g -= (g * a).sum(1)[:, None] * a
    b = 0.951 * a + (1 - 0.951**2) ** 0.5 * g / np.linalg.norm(g, axis=1)[:, None]
    ka, kb = (bucket_keys(x, tables, projections, 2.0, 7) for x in (a, b))
    assert (ka == kb).any(1).mean() >= 0.99
