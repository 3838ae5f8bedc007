import zlib

import numpy as np

from foldwise.llm import langid
from foldwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_calibration(spark):
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_language_id"](spark, SF).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]["lang"]]
    right = np.array([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held])
    assert right.mean() >= 0.97
    assert abs(np.mean([r["score"] for r in held]) - right.mean()) < 0.1


def test_chunks_equal_the_whole(monkeypatch):
    text = "Où est-ce  que l'été,  1234 vás à la plage?? Über alles; " * 7 + "x"
    whole = np.bincount(np.concatenate(list(langid.chunks(text))), minlength=1 << langid.BITS)
    for size in (5, 17, 64):
        monkeypatch.setattr(langid, "CHUNK", size)
        assert (np.bincount(np.concatenate(list(langid.chunks(text))), minlength=1 << langid.BITS) == whole).all()


def test_nulls_no_letters_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, None, "en"),
                               (4, " 123 !", None), (None, "the dog", "en"), (5, "", "de"), (1, "the cat sat on the mat", "en")],
                              "key int, text string, lang string")
    model = langid.fit(d)
    got = langid.predict(d.withColumn("score", d["text"]), model)
    assert got.columns == ["key", "text", "lang", "lang_pred", "score"]
    assert [r["lang_pred"] for r in got.collect()] == ["en", "de", "und", "und", "en", "und", "en"]
    none = langid.fit(d.limit(0))
    assert {tuple(r) for r in langid.predict(d, none).select("lang_pred", "score").collect()} == {("und", 0.0)}
