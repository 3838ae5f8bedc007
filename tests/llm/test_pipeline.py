import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from foldwise.llm import minhash, mixing, pii, quality_bayes

SF = "/root/testdata/sf0.001"
LIB = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))


def test_pipeline_equals_its_stages_by_hand(spark):
    """Each decision recomputed plainly from the operators' verdicts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = P.run(spark, SF).collect()
    kept = [r for r in quality_bayes.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["kept"]]
    sets = {r["doc_id"]: set(minhash.shingles(r["text"]).tolist()) for r in kept}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            n = len(sets[a] & sets[b])
            if sets[a] and 100 * n >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {r["doc_id"]: r for r in kept if find(r["doc_id"]) == r["doc_id"]}
    anchors = pii.automaton()
    want = {i: pii.mask(r["text"], pii.find(r["text"], anchors)) for i, r in kept.items()}
    table = spark.createDataFrame([(i, t, kept[i]["source"]) for i, t in want.items()], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(table).collect()}
    seen = {}
    for r in got:
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
        assert np.frombuffer(r["ids"], "<u4").tolist() == LIB.encode(want[r["doc_id"]], add_special_tokens=False).ids
    assert seen == {i: c for i, c in copies.items() if c}


def test_stages_keep_the_columns_and_take_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (1, None, None, None, None), (None, "a@b.co " * 9, "en", "s", 3), (2, "", "en", None, 0),
         (3, "some words that go on and on until there are enough of them", "en", "s", 5)],
        "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.dtypes == docs.dtypes, name
            out.collect()
        assert P.STAGES[-1][1](spark, table, SF).count() == table.count()


def test_near_dedup_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(5, text), (4, text), (9, text + " tail"), (7, "other words"), (8, None), (6, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in P.near_dedup(spark, docs, SF).collect()) == [4, 6, 7, 8]


def test_near_dedup_stage_decides_by_row(spark):
    """Repeated and null ids: exactly one row of each group, and no unique text lost."""
    text = " ".join(f"w{i}" for i in range(60))
    other, third = text.replace("w", "x"), text.replace("w", "y")
    rows = [(1, text), (2, text), (2, other), (3, third), (3, third), (None, third), (None, "alone " + other[::-1]),
            (None, "lost id"), (None, "lost id"), (None, None), (4, ""), (4, ""), (-5, text + " tail"), (None, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n_chars long").repartition(3)
    got = P.near_dedup(spark, docs, SF)
    assert got.dtypes == docs.dtypes
    assert sorted((r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"] is not None) == [
        (-5, text + " tail"), (2, other), (3, third), (4, "")]
    assert sorted(r["text"] or "" for r in got.collect() if r["doc_id"] is None) == ["", "", "alone " + other[::-1], "lost id"]


def test_last_stage_decodes_the_ids(spark):
    import hashlib
    texts = {1: "end.\n\nNext é 中 <|endoftext|>", 2: "", 3: None}
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string")
    for r in P.STAGES[-1][1](spark, docs, SF).collect():
        assert r["same_text"] and r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


@pytest.mark.parametrize("i", range(5))
def test_stage_names_are_short(i):
    assert len(P.STAGES[i][0]) <= 40
