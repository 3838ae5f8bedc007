"""Alignment of two tokenizers' tokens over the same bytes, by lockstep merging.

Each text is encoded by a byte-level BPE file (A, from a space and the text)
and by a sentencepiece model (B, which adds the space itself).  A's and B's
tokens then cover the same bytes.  All documents of a batch advance at once:
one NumPy state vector holds for every lane the A and B token it stands on and
the bytes left of each; a step emits a link for every lane, marks a cut where
both tokens end, advances whichever ends first and compacts finished lanes.  A
lane is a document, or a stretch of at most ``LANE`` A tokens of a long one: it
begins where an A token begins, inside whatever B token covers that byte, so
no link is lost or doubled and a long document does not run on alone.

Ids are kept in a checkpoint; a first pass over it counts the links of each
(A id, B id) pair, added up by Spark, a second looks the counts up.  The pair
table is counted: up to ``broadcast_pairs`` pairs it is broadcast as two
arrays, beyond that each document's distinct pairs are joined with it over
salted keys.  The best count of a B id is broadcast: at most one for every id
of B's vocabulary.

Defined cases: null and empty texts, and texts whose joined tokens differ from
a space and the text (such as those with U+2581), have no tokens, zeros and an
empty string of groups; strings of special tokens are plain text; repeated
rows get a result each and count each; an empty table gives no rows; columns
beside the text pass through (columns named like a result are replaced).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.bpe import WORD, byte_alphabet
from foldwise.llm.common import join_by_group, require
from foldwise.session import cut_lineage

LANE = 512                  # A tokens that a lane advances over
SLICE_ROWS = 256            # documents of a batch
SLICE_BYTES = 4 << 20       # text of a batch, unless one document has more
CACHE_BYTES = 192 << 20     # of pieces and their ids in a worker
PAIRS_HELD = 1 << 20        # distinct pairs a task holds before it hands their counts on
BROADCAST_PAIRS = 1 << 20   # 16 MB as arrays
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
# A single space between two other characters; Python's white space includes all of the tokenizers'.
TWO_SPACES = re.compile(r"\s\s")
CUT = re.compile(r"(?<=\S) (?=\S)")
_EDGE = "▁"            # sentencepiece writes a space so


class PairEncoder:
    """Ids of texts by both tokenizers, through a bounded cache of the pieces between single spaces."""

    def __init__(self, path_a: str, path_b: str, cache_bytes: int = CACHE_BYTES):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        back = {c: bytes([k]) for k, c in enumerate(byte_alphabet())}
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes_a[i] = b"".join(back.get(c, c.encode()) for c in t)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_EDGE, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int32) for t in (self.bytes_a, self.bytes_b))
        # B can be cut before a word's space only if no piece reaches over it
        self.whole = any(re.search(f"[^{_EDGE}]{_EDGE}", p) for p in pieces)
        self.pack_a, self.pack_b = kind(len(self.bytes_a)), kind(len(self.bytes_b))
        self.letters = dict(enumerate(byte_alphabet()))
        self.most, self.used, self.known, self.older = cache_bytes // 2, 0, {}, {}

    def cut(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        if TWO_SPACES.search(text) or text[0].isspace() or text[-1].isspace():
            return CUT.split(text)
        return text.split(" ")

    def _ids_a(self, pieces: list[str]) -> list[list[int]]:
        tokenize = self.a.model.tokenize
        out = [[t.id for t in tokenize((" " + p).encode().decode("latin-1").translate(self.letters))] if WORD.match(p) else None
               for p in pieces]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.a.encode_batch_fast([" " + pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Encode unknown pieces; one whose bytes differ from the piece's is noted as such."""
        for p, a, b in zip(pieces, self._ids_a(pieces), self.b.encode(pieces, num_threads=1), strict=True):
            want = b" " + p.encode()
            same = b"".join([self.bytes_a[i] for i in a]) == want == b"".join([self.bytes_b[i] for i in b])
            ids = (np.array(a, self.pack_a).tobytes(), np.array(b, self.pack_b).tobytes()) if same else (None, None)
            self.known[p] = ids
            self.used += 350 + len(want) + len(a) * 2 + len(b) * 2    # objects and their places included

    def __call__(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        if self.used > self.most:
            self.older, self.known, self.used = self.known, {}, 0
        cut = [self.cut(t) if t else [] for t in texts]
        new = []
        for p in dict.fromkeys(x for c in cut for x in c):
            if p not in self.known:
                if (ids := self.older.get(p)) is None:
                    new.append(p)
                else:
                    self.known[p] = ids
                    self.used += 350 + len(p) + len(ids[0] or b"") + len(ids[1] or b"")
        if new:
            self._learn(new)
        out, get = [], self.known.__getitem__
        for c in cut:
            a, b = zip(*map(get, c)) if c else ((), ())
            out.append((b"", b"") if None in a else (b"".join(a), b"".join(b)))
        return out


def kind(size: int) -> str:
    """Type of stored ids: two bytes where the vocabulary allows."""
    return "<u2" if size <= 1 << 16 else "<u4"


_WORKER: dict = {}


def pair_encoder(path_a: str, path_b: str) -> PairEncoder:
    if (path_a, path_b) not in _WORKER:
        _WORKER[path_a, path_b] = PairEncoder(path_a, path_b)
    return _WORKER[path_a, path_b]


def lockstep(size_a: np.ndarray, size_b: np.ndarray, n_a: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, cut) of every link of a batch, in order.

    ``size_a`` and ``size_b`` hold the bytes (at least one) of all tokens, document after
    document; ``n_a`` the A tokens of each document, whose A and B tokens cover as many bytes."""
    end_a, end_b = np.cumsum(size_a, dtype=np.int64), np.cumsum(size_b, dtype=np.int64)
    first = np.cumsum(n_a) - n_a
    lanes = -(-n_a // lane)
    nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    a = np.repeat(first, lanes) + nth * lane
    stop = np.minimum(a + lane, np.repeat(first + n_a, lanes))
    begin = end_a[a] - size_a[a]
    b = np.searchsorted(end_b, begin, side="right")
    left_a, left_b = size_a[a].astype(np.int64), end_b[b] - begin
    room = stop - a + np.searchsorted(end_b, end_a[stop - 1], side="left") - b
    at = np.cumsum(room) - room
    link_a, link_b = np.full(room.sum(), -1, np.int64), np.empty(room.sum(), np.int64)
    cut = np.zeros(room.sum(), bool)
    while len(a):
        link_a[at], link_b[at] = a, b
        more = left_a - left_b
        ends_a, ends_b = more <= 0, more >= 0
        cut[at] = ends_a & ends_b
        a, b, at = a + ends_a, b + ends_b, at + 1
        on = a < stop
        if not on.all():
            a, b, at, stop, more, ends_a, ends_b, left_a, left_b = (x[on] for x in (a, b, at, stop, more, ends_a, ends_b, left_a, left_b))
        left_a, left_b = np.where(ends_a, size_a[a], more), np.where(ends_b, size_b[b], -more)
    used = link_a >= 0
    return link_a[used], link_b[used], cut[used]


class Aligned:
    """Links and groups of a batch of documents given as packed ids."""

    def __init__(self, ids: list[tuple[bytes, bytes]], encoder: PairEncoder):
        self.a, self.b = (np.frombuffer(b"".join([x[k] for x in ids]), t).astype(np.int64)
                          for k, t in enumerate((encoder.pack_a, encoder.pack_b)))
        self.n_a, self.n_b = (np.array([len(x[k]) for x in ids], np.int64) // int(t[2]) for k, t in
                              enumerate((encoder.pack_a, encoder.pack_b)))
        self.encoder = encoder
        self.link_a, self.link_b, self.cut = lockstep(encoder.length_a[self.a], encoder.length_b[self.b], self.n_a)
        self.doc = np.repeat(np.arange(len(ids)), self.n_a)[self.link_a]     # of each link
        self.pair = self.a[self.link_a] * len(encoder.bytes_b) + self.b[self.link_b]

    def per_doc(self, values: np.ndarray | None = None) -> np.ndarray:
        """Links, or the sum of their integer values, of each document."""
        if values is None:
            return np.bincount(self.doc, minlength=len(self.n_a))
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        end = np.cumsum(np.bincount(self.doc, minlength=len(self.n_a)))
        return total[end] - total[np.concatenate([[0], end[:-1]])]

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        group = np.cumsum(self.cut) - self.cut
        of_a, of_b = np.empty(len(self.a), np.int64), np.empty(len(self.b), np.int64)
        of_a[self.link_a], of_b[self.link_b] = group, group
        va, vb = len(self.encoder.bytes_a), len(self.encoder.bytes_b)
        out = np.empty(len(self.a) + len(self.b), np.int64)
        last = lambda of: np.append(of[1:] != of[:-1], True) if len(of) else np.empty(0, bool)
        out[np.arange(len(self.a)) + np.searchsorted(of_b, of_a, side="left")] = self.a + va * last(of_a)
        out[np.arange(len(self.b)) + np.searchsorted(of_a, of_b, side="right")] = 2 * va + self.b + vb * last(of_b)
        if (names := _WORKER.get("names")) is None or len(names) != 2 * (va + vb):
            names = [f"{i}{mark}" for n, marks in ((va, ",|"), (vb, ",;")) for mark in marks for i in range(n)]
            _WORKER["names"] = names
        text = list(map(names.__getitem__, out.tolist()))
        end = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(text[i:j])[:-1] for i, j in zip([0, *end], end)]


def _encode(docs: DataFrame, text_col: str, path_a: str, path_b: str) -> DataFrame:
    """The columns of ``docs`` (without the text) as c_0, c_1, .., a row number, and the packed ids."""
    import pyarrow as pa
    rest = [c for c in docs.columns if c != text_col and c not in RESULTS]
    src = docs.select(docs[text_col].alias("text"), F.monotonically_increasing_id().alias("row"),
                      *[docs[c].alias(f"c_{i}") for i, c in enumerate(rest)])

    def run(batches):
        encode = pair_encoder(path_a, path_b)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                ids = encode(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *[pa.array([x[k] for x in ids], pa.binary()) for k in (0, 1)]],
                                                 [*part.schema.names[1:], "ids_a", "ids_b"])

    schema = T.StructType([*src.schema.fields[1:], T.StructField("ids_a", T.BinaryType()), T.StructField("ids_b", T.BinaryType())])
    return src.mapInArrow(run, schema)


def _slices(batches):
    """Batches of bounded rows and bytes, whose last two columns are the packed ids."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(SLICE_ROWS, batch.num_rows - at)
            while n > 1 and sum(batch.column(k).slice(at, n).nbytes for k in (-1, -2)) > SLICE_BYTES:
                n = (n + 1) // 2
            yield batch.slice(at, n)
            at += n


def _aligned(part, encoder: PairEncoder) -> Aligned:
    return Aligned(list(zip(part.column(-2).to_pylist(), part.column(-1).to_pylist(), strict=True)), encoder)


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by pair."""
    pair, at = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
    return pair, np.bincount(at, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def pair_counts(encoded: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, n, best): links that hold each id pair, and whether no pair of its B id has more."""
    import pyarrow as pa

    def run(batches):
        encoder, found = pair_encoder(path_a, path_b), []

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _added(found)], ["pair", "n"])

        for part in _slices(batches):
            found.append(np.unique(_aligned(part, encoder).pair, return_counts=True))
            if sum(len(p) for p, _ in found) > PAIRS_HELD:
                found = [_added(found)]
                if len(found[0][0]) > PAIRS_HELD // 2:
                    yield rows()
                    found = []
        if found:
            yield rows()

    counts = cut_lineage(encoded.select("ids_a", "ids_b").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.pmod("pair", F.lit(len(pair_encoder(path_a, path_b).bytes_b)))
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"))     # one row for an id of the vocabulary at most
    return counts.join(F.broadcast(top), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The other columns of ``docs`` with n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair has its B id's
    highest count), count_sum (over links) and groups (``a1,a2|b1;..``) of each document."""
    import pyarrow as pa
    require(docs, text_col)
    encoded = cut_lineage(_encode(docs, text_col, path_a, path_b))
    counts = cut_lineage(pair_counts(encoded, path_a, path_b))
    rest = [c for c in docs.columns if c != text_col and c not in RESULTS]
    looked_up = counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs
    shared = None
    if looked_up:
        table = counts.orderBy("pair").toArrow()
        arrays = tuple(table.column(k).to_numpy() for k in range(3))
        shared = docs.sparkSession.sparkContext.broadcast(arrays)

    def run(batches):
        encoder = pair_encoder(path_a, path_b)
        for part in _slices(batches):
            found = _aligned(part, encoder)
            sums = [found.per_doc(), None, None]
            if looked_up:
                pair, n, best = shared.value
                at = np.searchsorted(pair, found.pair)
                sums[1:] = found.per_doc(best[at]), found.per_doc(n[at])
            n_groups = found.per_doc(found.cut)
            numbers = [found.n_a, found.n_b, n_groups, *sums]
            nulls = [None] * part.num_rows
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-2], *[pa.array(nulls if x is None else x, pa.int64()) for x in numbers], pa.array(found.groups(), pa.string())],
                [*part.schema.names[:-2], *RESULTS])

    schema = T.StructType([*encoded.schema.fields[:-2], *[T.StructField(c, T.LongType()) for c in RESULTS[:-1]],
                           T.StructField("groups", T.StringType())])
    out = encoded.mapInArrow(run, schema)
    if not looked_up:
        out = out.drop("n_best", "count_sum").join(_sums_by_join(encoded, counts, path_a, path_b), "row")
    return out.select(*[out[f"c_{i}"].alias(c) for i, c in enumerate(rest)], *[out[c] for c in RESULTS])


def _sums_by_join(encoded: DataFrame, counts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(row, n_best, count_sum) by a join of each document's distinct pairs with the pair table."""
    import pyarrow as pa

    def run(batches):
        encoder = pair_encoder(path_a, path_b)
        for part in _slices(batches):
            found = _aligned(part, encoder)
            row = part.column(0).to_numpy()
            both, m = np.unique(np.stack([found.doc, found.pair]), axis=1, return_counts=True)
            idle = np.flatnonzero(found.n_a == 0)   # no links, but a row of sums
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([row[both[0]], row[idle]])),
                                              pa.array([*both[1].tolist(), *[None] * len(idle)], pa.int64()),
                                              pa.array(np.concatenate([m, np.zeros(len(idle), np.int64)]))], ["row", "pair", "m"])

    pairs = encoded.select("row", "ids_a", "ids_b").mapInArrow(run, "row bigint, pair bigint, m bigint")
    joined = join_by_group(pairs, counts, ["pair"], F.col("row"))
    best = F.when(F.col("best"), F.col("m")).otherwise(0)
    return joined.groupBy("row").agg(F.sum(best).alias("n_best"), F.sum(F.col("m") * F.coalesce("n", F.lit(0))).alias("count_sum"))
