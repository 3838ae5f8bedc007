"""Byte-level BPE encoding by tree concatenation, and decoding.

A text is cut where no merge can cross (before a single space between two
words); each distinct piece is encoded once per worker and looked up after
that.  A long piece without such a place is encoded as a balanced tree: its
leaves are encoded on their own, and two neighbours are joined by re-encoding
a window around the join that grows until its first and last ids agree with
the two sides.  All neighbouring ids are then pairs that BPE itself leaves
unmerged, and the encoding whose neighbours are all such pairs is unique, so
the result equals that of encoding the whole at once.

Spark spreads documents over tasks; a worker holds a slice of a batch of
texts and a bounded cache.

Defined cases: null and empty texts have no ids and decode to the empty text;
texts of any length are encoded whole; equal texts get equal ids; strings of
special tokens in a text become their ids, as in the tokenizer file; extra
columns pass through (columns named like a result are replaced).
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import struct
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foldwise.llm.common import require

LEAF = 128          # bytes in a leaf of the tree; pieces up to this size are encoded directly
CACHE_BYTES = 144 << 20   # of pieces and their ids in a worker; results do not depend on it
TREE_CACHE_BYTES = 56 << 20     # the same beside the tables of the tree encoder
PIECE_BYTES = 190   # of a piece and its ids as Python objects, beside their characters and bytes
SLICE_ROWS = 1024   # texts of a batch that are held as Python objects at once,
SLICE_BYTES = 2 << 20   # of so many bytes together, unless one has more
# Letters whose class no Unicode version changes; between them (or digits) and these marks, and around
# line ends that touch them, the tokenizer's pattern always cuts.  Of several white-space characters before
# a letter the pattern leaves the last one out (\s+(?!\S)), so a line end there is cut on both sides.
_SURE = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\p{Z}"      # all of the tokenizer's white space is among it
MARK = "\0"         # put where a text is cut
CUTS = [(rf"([0-9{_SURE}])([.,;:!?\n])", rf"\1{MARK}\2"), (r"([.,;:!?])(\n)", rf"\1{MARK}\2"),
        (rf"\n([{_SURE}])", f"\n{MARK}\\1"), (rf"([{_SPACE}])\n\x00", f"\\1{MARK}\n{MARK}")]
# A single space between two other characters; twice, for words of one character.
SINGLE = (rf"([^{_SPACE}]) ([^{_SPACE}])", rf"\1{MARK} \2")
WORD = re.compile(rf" ?[{_SURE}]+\Z")   # one word: the pattern takes it whole


def byte_alphabet() -> list[str]:
    """Byte -> the printable character that stands for it in a byte-level vocabulary:
    printable Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class TreeBpe:
    """Encoder and decoder of a tokenizer file (byte-level BPE)."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer
        self.leaf = max(2, leaf)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.start = {c: vocab[c] for c in byte_alphabet()}
        self.start_of_byte = [vocab[c] for c in byte_alphabet()]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pre_split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.letters = {i: [self.start[c] for c in t] for t, i in vocab.items() if all(c in self.start for c in t)}
        back = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        self.bytes_of = {i: b"".join(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}

    def merge(self, ids: list[int]) -> list[int]:
        """Plain BPE of a short piece: merge the pair of lowest rank, leftmost first, until none is left."""
        ids = list(ids)
        rank, none = self.merges.get, (1 << 60, 0)
        found = [rank(p, none) for p in zip(ids, ids[1:])]
        while found and (best := min(found)) is not none:
            i = found.index(best)
            ids[i:i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i + 1 < len(ids):
                found[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for windows that have grown large."""
        ids, n = list(ids), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.merges.get
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, new, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j], k = new, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if r := rank((new, ids[k])):
                    heapq.heappush(heap, (*r, i, new, ids[k]))
            if (h := before[i]) >= 0 and (r := rank((ids[h], new))):
                heapq.heappush(heap, (*r, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def direct(self, start: list[int]) -> list[int]:
        return self.merge(start) if len(start) <= LEAF else self.merge_long(start)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two neighbours from theirs: the window around the join grows until both sides agree."""
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            window = self.direct([x for i in a + b for x in self.letters[i]])
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[:len(left) - len(a)] + window + right[len(b):]
            k *= 2

    def tree(self, start: list[int]) -> list[int]:
        """Encoding of the ids of single bytes; many of them as a balanced tree."""
        if len(start) <= self.leaf:
            return self.direct(start)
        level = [self.direct(start[i:i + self.leaf]) for i in range(0, len(start), self.leaf)]
        while len(level) > 1:
            level = [self.join(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def piece(self, text: str) -> list[int]:
        """Ids of a piece that the cache does not hold."""
        if WORD.match(text):
            return self.tree([self.start_of_byte[b] for b in text.encode()])
        out: list[int] = []
        for part in (self.at_special.split(text) if self.at_special else [text]):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for token, _ in self.pre_split(part):
                    out += self.tree([self.start[c] for c in token])
        return out

    def pieces(self, texts: list[str]) -> list[bytes]:
        return [pack_ids(self.piece(t)) for t in texts]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


def cut(texts):
    """Lists of the pieces of Arrow texts, none of which holds ``MARK``."""
    import pyarrow.compute as pc
    two = pc.match_substring_regex(texts, f"[{_SPACE}][{_SPACE}]")
    cut = pc.replace_substring(texts, " ", f"{MARK} ")
    if pc.any(two).as_py():
        other = texts.filter(two)
        for _ in range(2):
            other = pc.replace_substring_regex(other, *SINGLE)
        cut = pc.replace_with_mask(cut, two, other)
    for pattern, new in CUTS:
        cut = pc.replace_substring_regex(cut, pattern, new)
    return pc.split_pattern(cut, MARK)


class PieceCache:
    """Ids of whole texts from the ids of their pieces.

    Texts are cut, by Arrow's kernels, before single spaces between two other
    characters (a piece keeps its space), and around punctuation and line ends
    where no merge crosses either, so that a word is encoded once whatever
    follows it.  The distinct pieces of a slice of texts are looked up, unknown
    ones encoded in one call, and the ids dealt to all their places in one
    gather.  The cache has two generations of about half of ``most_bytes`` each
    (or ``most`` pieces, if given): when the young one is full it becomes the
    old one, and pieces still in use move back."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most_bytes: int = CACHE_BYTES, most: int | None = None):
        self.encode, self.most_bytes, self.most = encode, most_bytes, most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        was_on = gc.isenabled()
        gc.disable()    # many short strings, no cycles: collections would only walk the cache
        try:
            return self._encode(texts)
        finally:
            if was_on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa
        if self.size > self.most_bytes // 2 or self.most and len(self.known) > self.most:
            self.older, self.known, self.size = self.known, {}, 0       # two generations, no more
        out: list[bytes] = [b""] * len(texts)
        marked = [i for i, t in enumerate(texts) if MARK in t]
        for i, ids in zip(marked, self.encode([texts[i] for i in marked]), strict=True):
            out[i] = ids
        plain = [i for i, t in enumerate(texts) if t and MARK not in t]
        if plain:
            for i, ids in zip(plain, self._join(cut(pa.array([texts[i] for i in plain], pa.large_string()))), strict=True):
                out[i] = ids
        return out

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            old = list(map(self.older.get, [pieces[i] for i in new]))
            unknown = [pieces[i] for i, x in zip(new, old, strict=True) if x is None]
            ids = iter(self.encode(unknown))
            for i, x in zip(new, old, strict=True):
                x = next(ids) if x is None else x
                found[i] = self.known[pieces[i]] = x
                self.size += PIECE_BYTES + len(pieces[i]) + len(x)
        return found

    def _join(self, lists) -> list[bytes]:
        """Ids of texts given as lists of their pieces."""
        values = lists.flatten().dictionary_encode()
        place = values.indices.to_numpy()
        ids = self._look_up(values.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        flat, count = np.frombuffer(b"".join(ids), "<u4"), size[place]
        end = np.cumsum(count)
        spread = np.repeat(start[place] - (end - count), count)
        spread += np.arange(len(spread))
        out = flat[spread].tobytes()
        last = np.concatenate([[0], end])[np.asarray(lists.offsets)[1:]] * 4
        return [out[i:j] for i, j in zip([0, *last.tolist()], last.tolist())]


_WORKER: dict = {}   # per Python worker: encoder and cache by (kind, path)


def tree_encoder(path: str) -> tuple[TreeBpe, PieceCache]:
    if ("tree", path) not in _WORKER:
        bpe = TreeBpe(path)
        _WORKER["tree", path] = (bpe, PieceCache(bpe.pieces, TREE_CACHE_BYTES))
    return _WORKER["tree", path]


def slices(batch, column: str, most_bytes: int = SLICE_BYTES):
    """Slices of an Arrow batch of bounded rows and bytes of ``column``."""
    i = 0
    while i < batch.num_rows:
        n = min(SLICE_ROWS, batch.num_rows - i)
        while n > 1 and batch.column(batch.schema.get_field_index(column)).slice(i, n).nbytes > most_bytes:
            n = (n + 1) // 2
        yield batch.slice(i, n)
        i += n


def map_column(df: DataFrame, col: str, outs: dict[str, T.DataType], fn) -> DataFrame:
    """Columns of ``df`` (less ``outs``) plus ``outs`` = fn(list of values), a list for each, by slices of Arrow batches."""
    import pyarrow as pa
    require(df, col)
    keep = [c for c in df.columns if c not in outs or c == col]
    src = df.select(*[df[c].alias(f"c_{i}") for i, c in enumerate(keep)])
    at, arrow = f"c_{keep.index(col)}", [{"binary": pa.binary(), "string": pa.string()}[t.typeName()] for t in outs.values()]
    new = [f"n_{i}" for i in range(len(outs))]

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                values = fn(part.column(part.schema.get_field_index(at)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(v, t) for v, t in zip(values, arrow, strict=True)]],
                                                 [*part.schema.names, *new])
                pa.default_memory_pool().release_unused()

    schema = T.StructType([*src.schema.fields, *[T.StructField(n, t) for n, t in zip(new, outs.values(), strict=True)]])
    done = src.mapInArrow(run, schema)
    return done.select(*[done[f"c_{i}"].alias(c) for i, c in enumerate(keep) if c not in outs],
                       *[done[n].alias(c) for n, c in zip(new, outs, strict=True)])


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the ids of every text as binary: little-endian unsigned 32-bit integers.  With ``decoded``, also the text
    that these ids decode to, in the same pass."""
    def ids(texts):
        bpe, cache = tree_encoder(tokenizer_path)
        found = cache([t or "" for t in texts])
        return [found] if decoded is None else [found, [bpe.decode(np.frombuffer(v, "<u4")) for v in found]]
    outs = {out: T.BinaryType()} | ({} if decoded is None else {decoded: T.StringType()})
    return map_column(df, text_col, outs, ids)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of the ids in ``ids_col`` (as ``encode`` writes them); null gives the empty text."""
    def text(values):
        bpe = tree_encoder(tokenizer_path)[0]
        return [[bpe.decode(np.frombuffer(v or b"", "<u4")) for v in values]]
    return map_column(df, ids_col, {out: T.StringType()}, text)
