import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from foldwise.llm import align as L
from foldwise.llm.queries import QUERIES
from foldwise.session import read_table

SF = "/root/testdata/sf0.01"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return L.PairEncoder(A, B)


def direct(encoder, text):
    """Ids of the whole text by both libraries; none where their bytes differ from the text's."""
    if not text:
        return [], []
    a = encoder.a.encode(" " + text, add_special_tokens=False).ids
    b = encoder.b.encode(text)
    want = (" " + text).encode()
    if b"".join(encoder.bytes_a[i] for i in a) != want or b"".join(encoder.bytes_b[i] for i in b) != want:
        return [], []
    return a, b


def brute(encoder, texts):
    """(ids a, ids b, links, groups) of each text, with byte ranges compared one by one."""
    out = []
    for t in texts:
        a, b = direct(encoder, t)
        ends = lambda ids, of: np.cumsum([len(of[i]) for i in ids]).tolist()
        ea, eb = ends(a, encoder.bytes_a), ends(b, encoder.bytes_b)
        links, j = [], 0
        for i, e in enumerate(ea):
            begin = ea[i - 1] if i else 0
            while j and (eb[j - 1] > begin):
                j -= 1
            while j < len(b) and (eb[j - 1] if j else 0) < e:
                if eb[j] > begin:
                    links.append((i, j))
                j += 1
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            k, m = ea.index(e, i) + 1, eb.index(e, j) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        out.append((a, b, links, ";".join(groups)))
    return out


def results(found):
    """The result columns of every text, counts over all of them."""
    count = Counter((a[i], b[j]) for a, b, links, _ in found for i, j in links)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(len(a), len(b), g.count(";") + 1 if g else 0, len(links),
             sum(count[a[i], b[j]] == best[b[j]] for i, j in links), sum(count[a[i], b[j]] for i, j in links), g)
            for a, b, links, g in found]


def random_texts(n):
    r = random.Random(7)
    signs = "ab zé.\n\t▁　\x00<s>|endoftext|{};\r  日本\U0001f6001'"
    return ["".join(r.choice(signs) for _ in range(r.choice([1, 2, 3, 5, 9, 30]))) for _ in range(n)] + [
        None, "", " ", "  ", "a ", " a", "\n", "a" * 5000, "<|endoftext|>", "x <s> </s> <unk> <0x41>", "日本 " * 700, "word " * 2000]


def test_encoding_equals_the_libraries(encoder):
    texts = random_texts(4000)
    small = L.PairEncoder(A, B, cache_bytes=20_000)     # the cache turns over
    whole = L.PairEncoder(A, B)
    whole.whole = True
    for t, *found in zip(texts, encoder(texts), [x for i in range(0, len(texts), 50) for x in small(texts[i:i + 50])], whole(texts), strict=True):
        want = tuple(np.array(x, "<u2").tobytes() for x in direct(encoder, t))
        assert all(f == want for f in found), t


@pytest.mark.parametrize("lane", [1, 2, 7, 512])
def test_lockstep_equals_brute_force(encoder, lane, monkeypatch):
    monkeypatch.setattr(L.lockstep, "__defaults__", (lane,))
    texts = random_texts(400)
    want = brute(encoder, texts)
    got = L.Aligned(encoder(texts), encoder)
    first_a, first_b = np.cumsum(got.n_a) - got.n_a, np.cumsum(got.n_b) - got.n_b
    links = list(zip(got.doc.tolist(), (got.link_a - first_a[got.doc]).tolist(), (got.link_b - first_b[got.doc]).tolist()))
    assert links == [(d, i, j) for d, (_, _, ls, _) in enumerate(want) for i, j in ls]
    assert got.groups() == [g for *_, g in want]


@pytest.mark.parametrize("broadcast_pairs", [L.BROADCAST_PAIRS, 0])
def test_columns_on_a_fixture(spark, encoder, broadcast_pairs):
    texts = random_texts(300) + ["a", "a", None, ""]
    docs = spark.createDataFrame([(i // 2, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, n_a string, row long").repartition(5)
    got = L.align(docs, A, B, broadcast_pairs=broadcast_pairs)
    assert got.columns == ["doc_id", "row", *L.RESULTS]
    want = results(brute(encoder, texts))
    rows = {r["row"]: tuple(r[c] for c in L.RESULTS) for r in got.collect()}
    assert rows == dict(enumerate(want))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.align(docs, A, B).count() == 0
    assert L.align(docs, A, B, broadcast_pairs=0).count() == 0


def test_query_equals_brute_force(spark, encoder):
    docs = read_table(spark, SF, "documents").select("doc_id", "text").collect()
    want = results(brute(encoder, [r["text"] for r in docs]))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_align_tokenizers"](spark, SF).collect()}
    assert got == {r["doc_id"]: (*w[:-1], sha256(w[-1].encode()).hexdigest() if w[-1] else "") for r, w in zip(docs, want, strict=True)}
