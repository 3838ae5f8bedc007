import random

import numpy as np
import pytest

from foldwise.llm import components, minhash


def brute(docs):
    """(id, n_shingles, component, kept) from all pairs of full sets."""
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def corpus(seed, groups=6, hot=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    docs = []
    for g in range(groups):
        base = [word() for _ in range(r.choice([8, 60, 150]))]
        for _ in range(hot if g == 0 else r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = word()
            docs.append(" ".join(w))
    docs += [" ".join(word() for _ in range(r.randint(1, 80))) for _ in range(40)]
    docs += ["", " \n", "One Two", "one two", "one two three four five", "ONE two three four five"]
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)    # buckets of many blocks
    docs = corpus(seed)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, got.collect())) == brute(docs)


def test_estimate_is_corrected_for_chance():
    r = np.random.default_rng(2)
    for share in (0.0, 0.5, 0.9):
        found = []
        for _ in range(60):
            both = r.integers(0, 2 ** 63, int(400 * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, r.integers(0, 2 ** 63, 400 - len(both), dtype=np.uint64)])) for _ in "ab")
            found.append(minhash.estimate(minhash.signature(minhash.minima(a)), minhash.signature(minhash.minima(b))))
        true = 400 * share / (800 - 400 * share)
        assert abs(np.mean(found) - true) < 0.03


def test_linked_is_exact_at_the_edge():
    a = np.arange(100, dtype=np.uint64)
    assert minhash.linked(a, a[:85]) and not minhash.linked(a, a[:84])
    assert minhash.linked(a[:1], a[:1]) and not minhash.linked(a[:1], a[1:2])


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (300, 200)] * 2
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 300: 200}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_nulls_repeats_empty_table_and_clashing_names(spark):
    t = "a b c d e f g h"
    rows = [(3, t, 1), (3, t, 1), (None, t, 1), (2, t + " ", 1), (None, "alone in here", 1), (5, None, 1), (6, "x y", 1), (6, "z", 1)]
    d = spark.createDataFrame(rows, "id int, text string, node int")
    got = sorted(map(str, map(tuple, minhash.near_duplicates(d, id_col="id").collect())))
    assert got == sorted(map(str, [(3, 4, 2, False), (3, 4, 2, False), (None, 4, 2, False), (2, 4, 2, True),
                                   (None, 1, None, True), (5, 0, 5, True), (6, 1, 6, True), (6, 1, 6, True)]))
    assert minhash.near_duplicates(d.limit(0), id_col="id").count() == 0


def test_very_long_text(spark):
    t = " ".join(f"w{i % 5000}x{i // 7}" for i in range(200_000))
    got = minhash.near_duplicates(spark.createDataFrame([(1, t), (2, t + " end"), (3, "short")], "doc_id int, text string"))
    assert [r["component_id"] for r in got.orderBy("doc_id").collect()] == [1, 1, 3]
