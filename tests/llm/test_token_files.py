import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foldwise.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def ids_of(t):
    return LIB.encode(t or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2 ** 32, n, dtype=np.uint32)
    parts = tf.to_planes(ids, planes)
    assert len(parts) == (32 if planes == "bit" else 4)
    assert (tf.from_planes(parts, n, planes) == ids).all()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files_round_trip_over_block_edges(tmpdir_path, planes):
    w = tf.PlaneWriter(tmpdir_path, "x.planes", planes, block_ids=64)
    ids = np.arange(1000, dtype="<u4") * 77
    for a, b in [(0, 10), (10, 200), (200, 200), (200, 1000)]:
        w.add(ids[a:b])
    w.close()
    r = tf.PlaneReader(tmpdir_path, "x.planes")
    assert r.n_ids == 1000 and len(r.chunks) == 16
    for a, n in [(0, 1000), (63, 2), (999, 1), (128, 64), (500, 0)]:
        assert (r.read(a, n) == ids[a:a + n]).all()


def test_query_equals_the_library(spark):
    from foldwise.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op6_token_files"](spark, sf).collect()}
    at = 0
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = ids_of(r["text"])
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("t", ["a\n\nb", "end.\n\nNext", "end.\n\n\n\nNext", "\n\nx", " w\n\nx", "\nx", "a \n\nb", "a\r\n\r\nb"])
def test_blank_lines_before_a_word(t):
    assert np.frombuffer(tf.library_cache(PATH)([t])[0], "<u4").tolist() == ids_of(t)[:-1]


def test_nulls_repeats_empty_table_and_extra_columns(spark, tmpdir_path):
    d = spark.createDataFrame([(2, "b c", 1), (None, None, 2), (2, "a", 3), (2, "b c", 4), (1, "", 5)],
                              "doc_id int, text string, shard int")
    tf.write(d, f"{tmpdir_path}/a", PATH, files=3, block_ids=2)
    got = sorted(tf.read(spark, f"{tmpdir_path}/a").collect(), key=lambda r: r["start"])
    assert [r["id"] for r in got] == [None, 1, 2, 2, 2]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [ids_of(t) for t in (None, "", "a", "b c", "b c")]
    tf.write(d.limit(0), f"{tmpdir_path}/b", PATH)
    assert tf.read(spark, f"{tmpdir_path}/b").count() == 0
