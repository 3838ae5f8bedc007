import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foldwise.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
SMALL = bpe.TreeBpe(PATH, leaf=5)
CACHE = bpe.PieceCache(bpe.TreeBpe(PATH).pieces, most=40)


def lib(t):
    return LIB.encode(t, add_special_tokens=False).ids


def ids_of(b):
    return np.frombuffer(b, "<u4").tolist()


TEXT = st.text(st.one_of(st.sampled_from("abcde the'sll 019.,\n\t  é中<|endoftext|>"), st.characters(codec="utf-8")))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_tree_and_cache_equal_the_library(t):
    assert SMALL.piece(t) == lib(t)
    assert ids_of(CACHE([t])[0]) == lib(t)


@pytest.mark.parametrize("seed", range(12))
def test_long_unsplit_text(seed):
    r = random.Random(seed)
    alphabet = ["ab", "etaoinshr", "aaaaaaab", "é中абв", "=-"][seed % 5]
    t = "".join(r.choice(alphabet) for _ in range(4000 + seed))
    assert bpe.TreeBpe(PATH).piece(t) == lib(t)
    assert SMALL.piece(t) == lib(t)


@pytest.mark.parametrize("t", ["a" * 3001, " " * 1000, "\n" * 777, "x<|endoftext|>y <|endoftext|>", " a  b \n c ", "a \x1c b\x85 c", ""])
def test_edge_texts(t):
    assert SMALL.piece(t) == lib(t)
    assert ids_of(CACHE([t])[0]) == lib(t)


@pytest.mark.parametrize("t", ["a\n\nb", "end.\n\nNext", "end.\n\n\n\nNext", "\n\nx", " w\n\nx", "\nx", "a\nb", "a \n\nb", "a\n \nb", "a\x1c\nb",
                               "\n\n\nx y\r\n\nz", "1\n\n2", "<|endoftext|>\n\nx", "a\x85\nb"])
def test_blank_lines_before_a_word(t):
    assert SMALL.piece(t) == lib(t)
    cache = bpe.PieceCache(bpe.TreeBpe(PATH).pieces)
    assert ids_of(cache([t])[0]) == ids_of(cache([t])[0]) == lib(t)
    assert ids_of(bpe.tree_encoder(PATH)[1]([t])[0]) == lib(t)


def test_heap_equals_plain_merge():
    r = random.Random(3)
    for _ in range(200):
        start = [SMALL.start[c] for c in r.choices(bpe.byte_alphabet()[97:110], k=r.randint(0, 60))]
        assert SMALL.merge_long(start) == SMALL.merge(start)


def test_query_equals_the_library(spark):
    from foldwise.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in QUERIES["op9_bpe_round_trip"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = lib(r["text"] or "")
        got = rows[r["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_and_clashing_names(spark):
    d = spark.createDataFrame([(1, None, "x"), (1, "a b", None), (1, "a b", None), (None, "", "y")],
                              "doc_id int, text string, ids string")
    got = bpe.decode(bpe.encode(d, PATH), PATH)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted(r["decoded"] for r in got.collect()) == ["", "", "a b", "a b"]
    assert bpe.encode(d.limit(0), PATH).count() == 0


def test_encode_with_decoded_equals_two_passes(spark):
    df = spark.createDataFrame([(1, "a b  c\n\nd é", "x"), (2, None, None), (None, "", "y"), (3, "<|endoftext|>z", "z")],
                               "doc_id long, text string, decoded string")
    one = bpe.encode(df, PATH, decoded="decoded").select("doc_id", "text", "ids", "decoded").collect()
    two = bpe.decode(bpe.encode(df, PATH), PATH).select("doc_id", "text", "ids", "decoded").collect()
    assert one == two
