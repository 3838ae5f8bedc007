"""Near-duplicate groups by b-bit MinHash.

A document's set holds its distinct five-word shingles as 64-bit hashes.
Documents with equal sets are one class from the start, before anything is
done by band.  Minima of ``BANDS *
ROWS`` hash functions give band keys (candidates) and, of each minimum, its
low four bits, packed.  Two candidates are compared by the bit count of their
packed signatures, corrected for the 1/16 of unequal minima that agree by
chance; what passes with a margin is confirmed on the full sets.

Only classes that share a band key with another go on.  First each is compared
with the least class of its bucket (a star, linear in the bucket), and links
become components.  Buckets that lie in one component are done: that closes
groups of near copies without looking at their pairs.  In what is left, the
classes outside the bucket's largest component are compared with all others
of a different component, in blocks of bounded size that Spark spreads over
tasks: signatures first, then the full sets of those in question.  A block
task keeps a local forest, so it confirms and returns at most one link per
pair of components.  No bucket is capped and no candidate lost.

Defined cases: null texts and texts without words have an empty set and stay
alone; shorter texts than five words are one shingle; rows of equal id and
text are copies of each other; rows of one id and different texts are grouped
by their own texts; a row without id is grouped with copies only, and is
kept only where its group has no id at all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import require
from foldwise.llm.components import compact, components
from foldwise.session import cut_lineage

WORDS = 5
PERCENT = 85            # link: 100 * intersection >= PERCENT * union
BANDS, ROWS, BITS = 24, 6, 4
MARGIN = 0.13           # four standard errors of the estimate
BLOCK_ROWS, BLOCK_BYTES = 128, 4 << 20
CHUNK = 4096            # shingles hashed at once
PACK_WEIGHT = 20        # a packed class weighs as so many rows
BROADCAST_ROWS = 500_000    # keys of 16 bytes
_U = np.uint64
_RNG = np.random.default_rng(20_240_607)
_A = _RNG.integers(0, 2 ** 63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)
_B = _RNG.integers(0, 2 ** 63, BANDS * ROWS, dtype=np.uint64)
_NIBBLES = _U(0x1111111111111111)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of 64-bit hashes."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; A-Z lower-cased, words
    cut at ASCII white space (what bytes.lower and bytes.split do)."""
    from xxhash import xxh3_64_intdigest
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    if len(h) < WORDS:
        h, n = h.reshape(1, -1), len(h)
        s = np.full(1, n, np.uint64)
        for k in range(n):
            s = _mix(s) + h[:, k]
    else:
        s = np.full(len(h) - WORDS + 1, WORDS, np.uint64)
        for k in range(WORDS):
            s = _mix(s) + h[k:len(h) - WORDS + 1 + k]
    return np.unique(_mix(s))


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(len(_A), 2 ** 32 - 1, np.uint64)
    for i in range(0, len(s), CHUNK):
        out = np.minimum(out, ((s[None, i:i + CHUNK] * _A[:, None] + _B[:, None]) >> _U(32)).min(axis=1))
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, its number included."""
    k = np.arange(BANDS, dtype=np.uint64)
    for row in m.reshape(BANDS, ROWS).T:
        k = _mix(k + _U(0x9E3779B97F4A7C15)) + row
    return _mix(k).view(np.int64)


def signature(m: np.ndarray) -> np.ndarray:
    """The low four bits of the minima, packed into 64-bit words."""
    low = (m & _U(15)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).view(np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (last axis), corrected for chance agreement."""
    d = a ^ b
    d = d | (d >> _U(1))
    d = (d | (d >> _U(2))) & _NIBBLES
    same = 1 - np.bitwise_count(d).sum(axis=-1) / (BANDS * ROWS)
    chance = 1 / 2 ** BITS
    return (same - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted distinct sets are similar enough, exactly."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    n = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * n >= percent * (len(a) + len(b) - n)


def _digest(s: np.ndarray) -> int:
    """64-bit name of a set, as a signed number."""
    from xxhash import xxh3_64_intdigest
    return int(np.uint64(xxh3_64_intdigest(s.tobytes())).astype(np.int64))


SIG_BYTES = BANDS * ROWS * BITS // 8
HEAD = BANDS * 8 + SIG_BYTES


def _pack(s: np.ndarray) -> bytes:
    m = minima(s)
    return band_keys(m).tobytes() + signature(m).tobytes() + s.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band keys, signature, set) of a packed class."""
    return (np.frombuffer(data, np.int64, BANDS), np.frombuffer(data, np.uint64, SIG_BYTES // 8, BANDS * 8),
            np.frombuffer(data, np.uint64, offset=HEAD))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, node, bands) per row: node is a 64-bit hash of the set, null for an empty one."""
    import pyarrow as pa
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([band_keys(minima(s)) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                    ["id", "n_shingles", "node", "bands"])

    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("n_shingles", T.LongType()),
                           T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return src.mapInArrow(run, schema)


def _packed_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, data) of the wanted classes, made again from the text of one document of each."""
    import pyarrow as pa
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")) \
              .join(wanted.select(F.col("id").alias("w"), "node"), F.col("id") == F.col("w")).select("node", "text")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = []
                for node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingles(text)
                    if len(s) and _digest(s) == node:   # else another text of the same id
                        rows.append((node, _pack(s)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                                  pa.array([r[1] for r in rows], pa.binary())], ["node", "data"])

    return src.mapInArrow(run, "node bigint, data binary").dropDuplicates(["node"])


def _confirm_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the rows (a, b, da, db) whose sets are linked."""
    import pyarrow as pa
    least = percent / 100 - MARGIN

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = batch.slice(i, 64).to_pylist()
                out = []
                for r in rows:
                    _, ga, sa = _unpack(r["da"])
                    _, gb, sb = _unpack(r["db"])
                    if estimate(ga, gb) >= least and linked(sa, sb, percent):
                        out.append((r["a"], r["b"]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _compare_blocks(blocks: DataFrame, percent: int, confirm: bool) -> DataFrame:
    """Comparisons inside the rows (key, some, every) of ``_blocks``; a pair is looked
    at under its first common key only.

    Screening gives (key, node) of all whose estimate passes with another;
    confirming gives links (a, b) between components."""
    import pyarrow as pa
    least = percent / 100 - MARGIN

    def candidates(key, some, every):
        """(x, y) as places in the two lists."""
        ys = [_unpack(r["data"]) for r in every]
        yk, yg = np.stack([y[0] for y in ys]), np.stack([y[1] for y in ys])
        comp, node = np.array([y["comp"] for y in every]), np.array([y["node"] for y in every])
        major = np.array([y["major"] for y in every])
        for i, x in enumerate(some):
            xk, xg, _ = _unpack(x["data"])
            shared = yk == xk
            ok = shared.any(axis=1) & (xk[shared.argmax(axis=1)] == key) & (comp != x["comp"])
            ok &= major | (node > x["node"])    # two of the list of some meet once
            ok[ok] = estimate(yg[ok], xg) >= least
            yield from ((i, j) for j in np.flatnonzero(ok))

    def screen(key, some, every):
        return {(key, n) for i, j in candidates(key, some, every) for n in (some[i]["node"], every[j]["node"])}

    def links(key, some, every):
        root: dict[int, int] = {}

        def find(c):
            while (p := root.get(c, c)) != c:
                root[c] = root.get(p, p)
                c = p
            return c

        for i, j in candidates(key, some, every):
            a, b = find(some[i]["comp"]), find(every[j]["comp"])
            if a != b and linked(_unpack(some[i]["data"])[2], _unpack(every[j]["data"])[2], percent):
                root[max(a, b)] = min(a, b)
                yield some[i]["comp"], every[j]["comp"]

    def run(batches):
        names, look = (["a", "b"], links) if confirm else (["key", "node"], screen)
        for batch in batches:
            for i in range(batch.num_rows):
                out = [p for r in batch.slice(i, 1).to_pylist() for p in look(r["key"], r["some"], r["every"])]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names)

    return blocks.mapInArrow(run, "a bigint, b bigint" if confirm else "key bigint, node bigint")


def _blocks(left: DataFrame) -> DataFrame:
    """(key, some, every): for each bucket, blocks of its classes outside the largest
    component against blocks of all its classes, from rows (key, node, comp, major, data)."""
    size = lambda c: F.greatest(F.ceil(F.count(c) / BLOCK_ROWS), F.ceil(F.sum(F.when(c, F.length("data"))) / BLOCK_BYTES),
                                F.lit(1)).cast("bigint")
    minor = F.when(~F.col("major"), True)
    plan = left.groupBy("key").agg(size(F.lit(True)).alias("n_every"), size(minor).alias("n_some"))
    entry = F.collect_list(F.struct("node", "comp", "major", "data"))
    placed = left.join(plan, "key").withColumn("h", F.xxhash64("node"))
    every = placed.groupBy("key", F.pmod("h", "n_every").alias("e")).agg(entry.alias("every"))
    some = placed.where("not major").groupBy("key", F.pmod("h", "n_some").alias("s")).agg(entry.alias("some"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    pairs = plan.select("key", upto("n_every").alias("e"), "n_some").select("key", "e", upto("n_some").alias("s"))
    return every.join(pairs, ["key", "e"]).join(some, ["key", "s"]).select("key", "some", "every")


def _open_links(members: DataFrame, packed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket, from rows (key, node, comp).
    Sets are sent only for classes that the signatures leave in question."""
    spans = members.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("key")
    left = members.join(spans, "key")
    majors = left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "comp"))["comp"].alias("top"))
    left = cut_lineage(left.join(majors, "key").select("key", "node", "comp", (F.col("comp") == F.col("top")).alias("major")))
    heads = left.join(packed.select("node", F.substring("data", 1, HEAD).alias("data")), "node")
    open_ = _compare_blocks(_blocks(heads), percent, confirm=False).distinct()
    left = cut_lineage(left.join(open_, ["key", "node"]))
    return _compare_blocks(_blocks(left.join(packed, "node")), percent, confirm=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``: component_id is the
    least id that links reach, kept marks its document."""
    require(docs, id_col, text_col)
    rows = cut_lineage(sketches(docs, id_col, text_col))
    # copies are one class before anything is done by band
    classes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    classes = cut_lineage(classes)
    keys = classes.select("node", F.explode("bands").alias("key")).repartition("key")
    shared = keys.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead != last")
    members = cut_lineage(keys.join(shared.select("key", "lead"), "key").distinct())
    members = compact(members, members.count())

    wanted = classes.select("node", "id").join(members.select("node").distinct(), "node")
    packed = cut_lineage(_packed_sets(docs, wanted, id_col, text_col))
    packed = compact(packed, PACK_WEIGHT * packed.count())

    star = members.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(packed.toDF("b", "db"), "b").join(packed.toDF("a", "da"), "a")
    first = cut_lineage(components(_confirm_pairs(star, percent), "a", "b"))

    members = members.drop("lead").join(first, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    members = cut_lineage(members)
    second = components(_open_links(members, packed, percent), "a", "b")

    # names of the components, from classes; then one join of the rows, whose hot classes adaptive execution splits
    named = classes.select("node", "id").join(first, "node", "left").withColumn("c1", F.coalesce("root", "node")).drop("root")
    named = named.join(second.toDF("c1", "root"), "c1", "left").select("node", "id", F.coalesce("root", "c1").alias("comp"))
    named = cut_lineage(named)
    least = cut_lineage(named.groupBy("comp").agg(F.min("id").alias("component_id")))
    named = cut_lineage(named.join(least, "comp").select("node", "component_id"))
    rows = rows.select("id", "n_shingles", "node").join(named, "node", "left").withColumn(
        "component_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return rows.select(F.col("id").alias(id_col), "n_shingles", "component_id",
                       F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def least_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group, that of the least id.  Rows of equal id and text are copies
    whatever the text; rows without id and without words stay.

    Groups are decided on a key of 16 bytes a row, the id and a hash of the text.  The keys that go are counted: up to
    ``broadcast_rows`` they are broadcast, so no text moves; beyond that rows meet them in a shuffled anti-join.
    Only rows that repeat another are sent by key, to keep one of them."""
    # ids in order, rows without id last, then the text
    keyed = docs.withColumn("__row", F.struct(F.col(f"`{id_col}`").isNull().alias("no_id"), F.col(f"`{id_col}`").alias("id"),
                                              F.xxhash64(F.col(f"`{text_col}`")).alias("text")))
    found = near_duplicates(keyed, id_col="__row", text_col=text_col, percent=percent)
    groups = found.groupBy("__row").agg(F.min("kept").alias("kept"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows"))
    repeated = (F.col("rows") > 1) & ~(F.col("__row.no_id") & (F.col("n") == 0))
    marked = cut_lineage(groups.where(~F.col("kept") | repeated).select(F.col("__row").alias("__marked"), "kept"))
    twice = marked.where("kept")
    if marked.limit(broadcast_rows + 1).count() <= broadcast_rows:
        marked, twice = F.broadcast(marked), F.broadcast(twice)
    same = F.col("__row") == F.col("__marked")
    out = keyed.join(marked, same, "left_anti")
    if twice.limit(1).count():
        out = out.unionByName(keyed.join(twice, same, "left_semi").dropDuplicates(["__row"]))
    return out.select(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, n, sh, row_number() OVER (PARTITION BY doc_id ORDER BY c, sh) AS r
      FROM s JOIN (SELECT sh, count(*) AS c FROM s GROUP BY sh) USING (sh) JOIN n USING (doc_id)),
f AS (SELECT * FROM k WHERE r <= n - ceil(0.85 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.sh = b.sh AND a.doc_id < b.doc_id
      WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
i AS (SELECT a, b, count(*) AS m FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.sh = y.sh GROUP BY a, b),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 85 * (na.n + nb.n - m)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
t AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT g.b, t.root FROM t JOIN g ON g.a = t.doc_id),
o AS (SELECT doc_id, min(root) AS component_id FROM t GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM o LEFT JOIN n USING (doc_id)"""
