"""Benchmark decontamination: an FM-index over each shard of the training documents.

Texts become lower-case words (A-Z only) of ASCII digits, letters and
characters beyond ASCII.  A benchmark item is searched for by its windows of
ten consecutive words; an item of fewer words is one window.  Each task cuts
its documents into shards of a bounded number of words, builds the index of a
shard (``fm_index``), finds all windows by backward search, locates every
occurrence by sampled positions and merges the occurrences of a document into
removal spans.  Words that no window holds end a run: nothing that matches
holds one.  A text longer than a shard is cut with an overlap of a window less
one word, so no occurrence is lost.

Nothing is shuffled.  The windows are broadcast; the benchmark is measured
first and taken in parts of about ``part_bytes``, one pass over the documents
each, so no broadcast outgrows that size (a single item is never cut).

Defined cases: null texts, and texts without such words, have no words, no
hits and no spans; repeated rows of documents get a result each; repeated
items count once; items without id are searched too and their hits count, but
they are neither counted nor named; an empty benchmark hits nothing; extra
columns pass through (columns named like a result are replaced).
"""

from __future__ import annotations

import json
import re
import uuid
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import require
from foldwise.llm.fm_index import FmIndex

WINDOW = 10
SHARD_WORDS = 1 << 19
PART_BYTES = 4 << 20
SLICE_ROWS = 256
LOCATE_ROWS = 1 << 20
TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
RESULTS = ("n_words", "n_hit", "items", "spans")


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class Phrases:
    """The windows of a part of the benchmark as rows of word codes (from 1 on)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.codes: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            w = [self.codes.setdefault(x, len(self.codes) + 1) for x in words(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[i:i + window]), set()).add(item)
        self.items = [{x for x in s if x is not None} for s in found.values()]
        self.sizes = np.array([len(w) for w in found], np.int64)
        self.longest = int(self.sizes.max(initial=1))
        self.rows = np.zeros((len(found), self.longest), np.int32)
        for i, w in enumerate(found):
            self.rows[i, :len(w)] = w

    def occurrences(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of every occurrence in a shard of documents
        that begin at ``starts`` of ``codes``; codes ends with 0."""
        unknown = codes == 0
        keep = ~unknown
        keep[1:] |= ~unknown[:-1]       # one end after each run
        at = np.flatnonzero(keep)
        if not len(at) or not len(self.rows):
            return (np.empty(0, np.int64),) * 3
        text = codes[at]
        if text[-1]:
            text, at = np.append(text, 0), np.append(at, len(codes))
        index = FmIndex(text, len(self.codes) + 1)
        low, high = index.search(self.rows, self.sizes)
        n = high - low
        hit = np.flatnonzero(n)
        out, block = [], np.cumsum(n[hit]) // LOCATE_ROWS
        for part in np.split(hit, np.flatnonzero(np.diff(block)) + 1) if len(hit) else []:
            window = np.repeat(part, n[part])
            first = np.cumsum(n[part]) - n[part]
            rows = np.arange(len(window)) - np.repeat(first - low[part], n[part])
            word = at[index.locate(rows)]
            doc = np.searchsorted(starts, word, side="right") - 1
            out.append((doc, word - starts[doc], window))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans; those that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(phrases: Phrases, texts: list[str | None], shard_words: int = SHARD_WORDS) -> list[tuple]:
    """(number of words, spans of words, items) of each text."""
    n_words, pieces, spans, items = [], [], [[] for _ in texts], [set() for _ in texts]
    step = max(1, shard_words - phrases.longest + 1)
    for k, text in enumerate(texts):
        w = words(text)
        n_words.append(len(w))
        c = np.fromiter(map(phrases.codes.get, w, repeat(0)), np.int32, len(w))
        pieces += [(k, i, c[i:i + shard_words]) for i in range(0, max(1, len(w) - phrases.longest + 1) if w else 0, step)]
    while pieces:
        size, n = 0, 0
        while n < len(pieces) and (not n or size + len(pieces[n][2]) <= shard_words):
            size, n = size + len(pieces[n][2]) + 1, n + 1
        shard, pieces = pieces[:n], pieces[n:]
        codes = np.concatenate([x for _, _, c in shard for x in (c, np.zeros(1, np.int32))])
        starts = np.cumsum([0] + [len(c) + 1 for _, _, c in shard])[:-1]
        doc, word, window = phrases.occurrences(codes, starts)
        for d, w in np.unique(np.stack([doc, window], axis=1), axis=0).tolist() if len(doc) else []:
            items[shard[d][0]] |= phrases.items[w]
        for d, a, b in runs(doc, word, phrases.sizes[window]):
            spans[shard[d][0]].append((a + shard[d][1], b + shard[d][1]))
    return [(n, merged(s), i) for n, s, i in zip(n_words, spans, items, strict=True)]


def runs(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, start, end) of the unions of overlapping or touching occurrences."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + size)[order]
    if not len(doc):
        return []
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(doc * wide + end)
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] * wide + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return list(zip(doc[first].tolist(), start[first].tolist(), (reach[last] - doc[last] * wide).tolist()))


def in_characters(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of code points, end exclusive."""
    if not spans:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def without(text: Column, spans: Column) -> Column:
    """The text with the spans of code points cut out."""
    n = F.size(spans)

    def piece(i):
        start = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
        end = F.when(i == n, F.length(text)).otherwise(F.get(spans, i)["start"])
        return F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))

    return F.when(n == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n), piece), ""))


_WORKER: dict = {}


def _phrases(key: str, blob, window: int) -> Phrases:
    if key not in _WORKER:
        if len(_WORKER) > 1:
            _WORKER.clear()
        _WORKER[key] = Phrases(json.loads(blob.value), window)
    return _WORKER[key]


def _parts(benchmark: DataFrame, id_col: str, text_col: str, part_bytes: int):
    """The distinct items in parts of about ``part_bytes``, one after the other."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text")).distinct()
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = max(1, -(-size // part_bytes))
    for k in range(n):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield json.dumps([tuple(r) for r in mine.collect()])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                  benchmark_text_col: str = "text", window: int = WINDOW, cleaned_col: str | None = None,
                  shard_words: int = SHARD_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Add n_words, n_hit (words inside occurrences), items (ids found, as sorted strings)
    and spans (code points to remove) to each document; with ``cleaned_col`` also the text
    without the spans."""
    require(docs, text_col)
    require(benchmark, id_col, benchmark_text_col)
    import pyarrow as pa
    spark = docs.sparkSession
    taken = {*RESULTS, cleaned_col} - {text_col}
    out = docs.select(*[docs[c] for c in docs.columns if c not in taken])
    keep = out.columns
    out = out.select(*[out[c].alias(f"c_{i}") for i, c in enumerate(keep)])
    text_at = keep.index(text_col)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    added = [T.StructField("n_words", T.LongType()), T.StructField("words_hit", T.ArrayType(span)),
             T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span))]
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def tuples(spans):
        return [(s["start"], s["end"]) for s in spans]

    def step(blob, earlier: bool):
        key = uuid.uuid4().hex

        def run(batches):
            phrases = _phrases(key, blob, window)
            for part, texts in groups(batches, text_at, shard_words):
                found = find(phrases, texts, shard_words)
                spans = [s for _, s, _ in found]
                items = [i for *_, i in found]
                if earlier:     # what the parts of the benchmark before this one found
                    spans = [merged(s + tuples(e)) for s, e in zip(spans, part.column("words_hit").to_pylist(), strict=True)]
                    items = [i.union(e) for i, e in zip(items, part.column("items").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:len(keep)], pa.array([n for n, *_ in found], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pairs),
                    pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                    pa.array([[{"start": a, "end": b} for a, b in in_characters(t or "", s)]
                              for t, s in zip(texts, spans, strict=True)], pairs)],
                    [*[f"c_{i}" for i in range(len(keep))], *[f.name for f in added]])
        return run

    schema = T.StructType([*out.schema.fields, *added])
    for k, blob in enumerate(_parts(benchmark, id_col, benchmark_text_col, part_bytes)):
        out = out.mapInArrow(step(spark.sparkContext.broadcast(blob), k > 0), schema)
    n_hit = F.aggregate("words_hit", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    columns = [out[f"c_{i}"].alias(c) for i, c in enumerate(keep)]
    columns += [out["n_words"], n_hit.alias("n_hit"), out["items"], out["spans"]]
    if cleaned_col:
        columns.append(without(out[f"c_{text_at}"], out["spans"]).alias(cleaned_col))
    return out.select(*columns)


def groups(batches, text_at: int, shard_words: int):
    """(rows, texts) in groups of about a shard's words, in the order of the rows."""
    import pyarrow as pa
    held, size = [], 0

    def flush():
        part = pa.concat_batches(held) if len(held) > 1 else held[0]
        return part, part.column(text_at).to_pylist()

    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(i, SLICE_ROWS)
            held.append(part)
            size += part.column(text_at).nbytes // 6    # bytes of a word, about
            if size >= shard_words:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


ORACLE_SQL = r"""
WITH cut AS (SELECT 'd' AS kind, row_number() OVER () AS rid, doc_id::VARCHAR AS id, text FROM documents
  UNION ALL SELECT 'b', 0, item_id::VARCHAR, text FROM benchmark),
w AS (SELECT kind, rid, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM cut),
win AS (SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM w WHERE kind = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT rid, i, d.n, win.id AS item FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, sizes
  WHERE kind = 'd' AND len(w) >= n) d JOIN win ON win.n = d.n AND win.s = array_to_string(w[i:i + d.n - 1], ' ')),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM occ) GROUP BY rid),
itm AS (SELECT rid, count(DISTINCT item) AS n_items, sha256(coalesce(array_to_string(list_sort(list(DISTINCT item)), ','), '')) AS h
  FROM occ GROUP BY rid)
SELECT id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (rid) LEFT JOIN itm USING (rid) WHERE kind = 'd'"""
