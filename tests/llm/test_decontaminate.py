import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import decontaminate as D
from foldwise.llm.fm_index import FmIndex, suffix_order
from foldwise.llm.queries import QUERIES
from foldwise.session import read_table

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, items, window=10):
    """(n_words, hit words, ids of items) of each text, window by window."""
    found = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[k:k + window]), set()).add(i)
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for size in {len(x) for x in found}:
            for k in range(len(w) - size + 1):
                if (s := found.get(tuple(w[k:k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    ids |= s
        out.append((len(w), hit, ids - {None}))
    return out


@pytest.mark.parametrize("n, most", [(1, 1), (2, 1), (40, 1), (60, 3), (60, 30), (3000, 2), (3000, 200)])
def test_index_equals_a_scan(n, most):
    rng = np.random.default_rng(n + most)
    c = rng.integers(0, most + 1, n)
    c[-1] = 0
    if n == 3000:
        c[1000:1900] = c[:900]      # a copy
    order = suffix_order(c)
    if n <= 60:
        assert order.tolist() == sorted(range(n), key=lambda s: [(int(x > 0), x or i) for i, x in enumerate(c[s:].tolist(), s)])
    index = FmIndex(c, most + 1, sample=3)
    assert (index.locate(np.arange(n)) == order).all()
    for size in (1, 2, 5):
        phrases = rng.integers(1, most + 1, (20, size))
        for p, a, b in zip(phrases, *index.search(phrases, np.full(20, size)), strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - size + 1) if (c[i:i + size] == p).all()]


def test_search_of_phrases_of_several_sizes():
    index = FmIndex(np.array([1, 2, 1, 2, 3, 0, 2, 1, 0]), 5)
    low, high = index.search(np.array([[1, 2, 0], [1, 2, 3], [4, 0, 0], [2, 1, 2], [0, 0, 0]]), np.array([2, 3, 1, 3, 0]))
    assert (high - low).tolist() == [2, 1, 0, 1, 0]


@pytest.mark.parametrize("shard_words", [3, 12, 50, 10_000])
def test_find_equals_brute_force(shard_words):
    r = random.Random(shard_words)
    w = lambda n, v: " ".join(r.choice("abcdefgh"[:v]) for _ in range(n))
    items = [(str(i), w(r.choice([0, 1, 2, 5, 9, 10, 11, 14]), 4)) for i in range(40)] + [(None, w(4, 4)), ("x", None), ("39", w(3, 4))]
    texts = [w(r.choice([0, 1, 5, 30, 200]), 6) for _ in range(60)] + [None, "", ". . ."]
    texts += [t for _, t in items] * 2
    for window in (3, 10):
        got = D.find(D.Phrases(items, window), texts, max(shard_words, window))
        for (n, spans, ids), (m, hit, want) in zip(got, brute(texts, items, window), strict=True):
            assert n == m and ids == want
            assert {k for a, b in spans for k in range(a, b)} == hit
            assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_spans_and_cleaned_text(spark):
    item = "Uno dos TRES cuatro cinco seis siete ocho nueve diez"
    rows = [(1, f"aé {item}, fin", "p"), (1, f"aé {item}, fin", "p"), (2, None, None), (3, "", "q"), (None, item.lower(), "q"),
            (4, item.replace(" ", "-.\n") + " " + item, "z"), (5, item[5:], "z"), (6, f"x {item} y {item} ", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string")
    bench = spark.createDataFrame([(7, item, "t"), (7, item, "t"), (None, "fin", "t"), (8, None, "t"), (9, "", "t")],
                                  "item_id long, text string, n_words string")
    got = D.decontaminate(docs, bench, cleaned_col="cleaned")
    assert got.columns == ["doc_id", "text", "n_words", "n_hit", "items", "spans", "cleaned"]
    out = got.collect()
    assert [r["n_hit"] for r in out] == [11, 11, 0, 0, 10, 20, 0, 20]
    assert [r["items"] for r in out] == [["7"], ["7"], [], [], ["7"], ["7"], [], ["7"]]
    for r in out:
        spans = [tuple(s) for s in r["spans"]]
        left, at = "", 0
        for a, b in spans:
            assert D.WORD.fullmatch(r["text"][a]) and D.WORD.fullmatch(r["text"][b - 1])
            left, at = left + r["text"][at:a], b
        assert r["cleaned"] == (r["text"] if r["text"] is None else left + r["text"][at:])
    assert out[0]["cleaned"] == "aé " and out[7]["cleaned"] == "x  y  "


def test_parts_of_the_benchmark_and_empty_tables(spark):
    docs, bench = read_table(spark, SF, "documents").select("doc_id", "text").limit(300), read_table(spark, SF, "benchmark")
    whole = sorted(map(str, D.decontaminate(docs, bench).drop("text").collect()))
    assert whole == sorted(map(str, D.decontaminate(docs, bench, part_bytes=4000).drop("text").collect()))
    assert whole == sorted(map(str, D.decontaminate(docs, bench, shard_words=1000).drop("text").collect()))
    none = D.decontaminate(docs, bench.limit(0)).collect()
    assert len(none) == 300 and all(r["n_hit"] == 0 and not r["items"] and not r["spans"] for r in none)
    assert D.decontaminate(docs.limit(0), bench).count() == 0


def test_query_equals_brute_force(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text").collect()
    items = [(str(r["item_id"]), r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    want = {r["doc_id"]: x for r, x in zip(docs, brute([r["text"] for r in docs], items), strict=True)}
    got = QUERIES["op12_decontaminate"](spark, SF)
    from hashlib import sha256
    assert got.schema["n_items"].dataType.typeName() == "long"
    rows = got.collect()
    assert len(rows) == len(docs) and any(r["contaminated"] for r in rows)
    for r in rows:
        n, hit, ids = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, len(hit), len(ids))
        assert r["items_sha256"] == sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert r["contaminated"] == bool(hit)
