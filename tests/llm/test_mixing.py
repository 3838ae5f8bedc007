import random

import pytest
from pyspark.sql import functions as F

from foldwise.llm import mixing


def plain_targets(sizes):
    """Targets by resharing the excess until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken_words(spark, seed):
    r = random.Random(seed)
    names = ["a", "B", "é", "zz", "c1", None, "d", "e"][:r.randint(2, 8)]
    rows = [(i, r.choice(names) if r.random() < 0.6 else names[0], " w" * int(r.expovariate(0.02))) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken = plain_targets(sizes), {}
    for g in got:
        assert g["source_size"] == sizes[g["source"]] and g["target"] == pytest.approx(want[g["source"]])
        assert 0 <= g["taken"] <= 3 * g["size"]
        taken[g["source"]] = taken.get(g["source"], 0) + g["taken"]
    largest = max(len(t.split()) for _, _, t in rows)
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in taken)


def test_refines_until_one_hash(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BITS_PER_LEVEL", 2)
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"),
                                   F.when(F.col("id") < 300, "a").otherwise("b").alias("source"))
    got = mixing.mix(rows).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 0.5 for r in got)


def test_take_repeats_rows_and_reruns_agree(spark):
    rows = [(i, "w " * (i % 7), "abc"[i % 3] if i % 10 else None, "copies") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    got = mixing.take(d)
    assert got.columns == d.columns
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {r["doc_id"]: r["copies"] for r in mixing.mix(d.repartition(7)).collect() if r["copies"]}
    assert max(counts.values()) <= 3


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, None, None), (2, "a b", None), (3, "  x  ", "s"), (3, "  x  ", "s"), (None, "", "t"), (5, " y z\n", "u")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(d).collect()
    assert len(got) == 6
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == [(0, 0), (1, 0), (2, 2), (3, 1), (3, 1), (5, 2)]
    assert [r["target"] for r in got if r["source"] == "t"] == [0.0]
    assert mixing.mix(d.limit(0)).count() == 0


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), (" \n", 0), ("a", 1), (" a\x0bb\u00a0c ", 2), ("a  b\t", 2)])
def test_word_count(spark, text, n):
    d = spark.createDataFrame([(text,)], "t string")
    assert d.select(mixing.word_count(d["t"])).first()[0] == n
