"""Nearest neighbours by inner product: hierarchical k-means tree, best-bin-first.

Largest inner product becomes smallest distance by one more coordinate: with M
the largest norm, x turns into (x, sqrt(M^2 - |x|^2)) / M and a query into
(q, 0) / |q|.  The tree is fitted on a bounded sample (``fit_rows`` rows with
the smallest hash of the id); every row is indexed under the leaf it descends
to.  A query pops nodes from a priority queue by distance to their centre and
visits leaves until as many as calibration asks for, and until they hold
enough rows.  Calibration widens the number of visits on held sample queries
until brute force over the sample finds the wanted share of neighbours in
them.  Leaves are cut into blocks of bounded size, queries too, and each
(leaf block, query block) is scored in double precision on the original
vectors; a leaf of any size, as one of many copies, is spread over tasks.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those of another length than most have; a null
id takes no part; ties go to the smaller id; rows of equal id are candidates
each; an empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import order_hash, require
from foldwise.session import cut_lineage

FIT_ROWS = 20_000
BRANCHES, LEAF_ROWS, ROUNDS = 8, 256, 8
CALIBRATION_QUERIES = 200
RECALL = 0.97
BLOCK_ROWS, QUERY_ROWS, SCORE_ROWS, HELD = 2048, 256, 32, 1_000_000


def usable(vector: Column, size: int | None = None) -> Column:
    """Whether a vector takes part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ok = vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok if size is None else ok & (F.size(vector) == size), F.lit(False))


@dataclass
class Tree:
    """Nodes by number: centre, children (empty for a leaf) and the leaf's number."""

    centres: np.ndarray
    children: list[list[int]]
    leaf_of: list[int]
    leaves: int
    largest_norm: float
    visits: int = 1
    counts: dict[int, int] = field(default_factory=dict)   # indexed rows by leaf

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rows with the extra coordinate that makes inner products distances."""
        rest = np.sqrt(np.maximum(0.0, self.largest_norm ** 2 - (x * x).sum(axis=1)))
        return np.concatenate([x, rest[:, None]], axis=1) / self.largest_norm

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each lifted row."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf_of[node]
            elif len(rows):
                near = _nearest(x[rows], self.centres[kids])
                todo += [(kid, rows[near == k]) for k, kid in enumerate(kids)]
        return out

    def best_first(self, q: np.ndarray):
        """Leaf numbers for a query, best bin first."""
        q = np.append(q / np.linalg.norm(q), 0.0)
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if not (kids := self.children[node]):
                yield self.leaf_of[node]
                continue
            d = self.centres[kids] - q
            for far, kid in zip((d * d).sum(axis=1).tolist(), kids, strict=True):
                heapq.heappush(heap, (far, kid))

    def leaves_for(self, q: np.ndarray, least_rows: int) -> list[int]:
        """The filled leaves a query visits: ``visits`` of them, more if they hold too few rows."""
        out, rows = [], 0
        for leaf in self.best_first(q):
            if n := self.counts.get(leaf, 0):
                out.append(leaf)
                rows += n
                if len(out) >= self.visits and rows >= least_rows:
                    break
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def _k_means(x: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        centres = np.stack([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres, _nearest(x, centres)


def build(sample: np.ndarray, largest_norm: float, seed: int = 5) -> Tree:
    """Tree over the rows of a sample of vectors."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((1, sample.shape[1] + 1)), [[]], [-1], 0, largest_norm)
    x, centres = tree.lift(sample), [np.zeros(sample.shape[1] + 1)]
    todo = [(0, x)]
    while todo:
        node, rows = todo.pop()
        split = len(rows) > LEAF_ROWS and (np.ptp(rows, axis=0) > 1e-12).any()
        if split:
            found, near = _k_means(rows, BRANCHES, rng)
            parts = [(c, rows[near == k]) for k, c in enumerate(found) if (near == k).any()]
            split = len(parts) > 1
        if not split:
            tree.leaf_of[node], tree.leaves = tree.leaves, tree.leaves + 1
            continue
        for c, part in parts:
            tree.children[node].append(len(centres))
            todo.append((len(centres), part))
            centres.append(c)
            tree.children.append([])
            tree.leaf_of.append(-1)
    tree.centres = np.stack(centres)
    return tree


def calibrate(tree: Tree, sample: np.ndarray, top: int, recall: float = RECALL, queries: int = CALIBRATION_QUERIES) -> int:
    """Fewest leaf visits at which the mean recall over sample queries reaches ``recall``."""
    leaf = tree.descend(tree.lift(sample))
    found = np.zeros(tree.leaves + 1)
    chosen = np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)
    for i in chosen:
        scores = sample @ sample[i]
        scores[i] = -np.inf
        best = np.argsort(-scores, kind="stable")[:min(top, len(sample) - 1)]
        place = {b: k for k, b in enumerate(tree.best_first(sample[i]))}
        np.add.at(found, [place[b] + 1 for b in leaf[best]], 1 / max(1, len(best)) / len(chosen))
    return max(1, int(np.searchsorted(np.cumsum(found), recall - 1e-9)))


def fit(vectors: DataFrame, top: int, fit_rows: int = FIT_ROWS, recall: float = RECALL) -> Tree | None:
    """Tree fitted and calibrated on a bounded sample of the rows (id, v); None without rows."""
    row = vectors.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).alias("norm")).first()
    if not row["n"]:
        return None
    sample = vectors
    if row["n"] > fit_rows:
        sample = sample.where(order_hash(F.col("id")) < int(fit_rows / row["n"] * 2 ** 60))
    rows = sample.select("id", "v").toPandas().sort_values("id", kind="stable")   # about fit_rows rows
    x = np.stack(rows["v"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((1, 1))
    tree = build(x, float(row["norm"]))
    tree.visits = calibrate(tree, x, top, recall)
    return tree


def _matrix(arrow) -> np.ndarray:
    """Rows of an Arrow list column without nulls as doubles."""
    flat = arrow.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(arrow), -1)


def _index(vectors: DataFrame, tree: Tree) -> DataFrame:
    """(id, v, leaf)"""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            if b.num_rows:
                leaf = tree.descend(tree.lift(_matrix(b.column(1))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], ["id", "v", "leaf"])

    return vectors.select("id", "v").mapInArrow(run, T.StructType([*vectors.select("id", "v").schema.fields,
                                                                  T.StructField("leaf", T.LongType())]))


def _visits(queries: DataFrame, tree: Tree, top: int) -> DataFrame:
    """(id, v, leaf) for every leaf a query visits."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                found = [tree.leaves_for(q, top + 1) for q in _matrix(part.column(1))]
                at = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at),
                                                  pa.array([x for f in found for x in f], pa.int64())], ["id", "v", "leaf"])

    return queries.select("id", "v").mapInArrow(run, T.StructType([*queries.select("id", "v").schema.fields,
                                                                  T.StructField("leaf", T.LongType())]))


def _in_blocks(rows: DataFrame, block_rows: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(leaf, name, ids, vs): blocks of about ``block_rows`` rows; and (leaf, n_name)."""
    plan = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("bigint").alias(f"n_{name}"))
    placed = rows.join(plan, "leaf").withColumn(name, F.pmod(F.xxhash64("id"), F.col(f"n_{name}")))
    packed = placed.groupBy("leaf", name).agg(F.collect_list(F.struct("id", "v")).alias("r"))
    return packed.select("leaf", name, F.col("r.id").alias(f"{name}_ids"), F.col("r.v").alias(f"{name}_vs")), plan


def best_of_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, top: int):
    """(query id, id, score) arrays: the best ``top`` of the rows for each query, ties to the smaller id.

    A matrix product finds all that may be among the best, however sums were
    rounded; their scores are then summed row by row in one way, so that equal
    vectors tie exactly."""
    out = []
    largest = np.abs(x).max(axis=0)
    for i in range(0, len(q), SCORE_ROWS):
        part = q[i:i + SCORE_ROWS]
        rough = part @ x.T
        rough[query_ids[i:i + SCORE_ROWS, None] == ids[None, :]] = -np.inf
        least = np.full(len(part), -np.inf)
        if len(ids) > top:
            least = np.partition(rough, -top, axis=1)[:, -top] - 1e-9 * (np.abs(part) @ largest)
        at, row = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
        score = (x[row] * part[at]).sum(axis=1)
        order = np.lexsort((ids[row], -score, at))
        at, row, score = at[order], row[order], score[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < top
        out.append((query_ids[i + at[keep]], ids[row[keep]], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _first_of_each(query: np.ndarray, ids: np.ndarray, score: np.ndarray, top: int):
    """The best ``top`` entries of every query, in order of (query, score, id)."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < top
    return query[keep], ids[keep], score[keep]


def _score(blocks: DataFrame, top: int, id_type: T.DataType) -> DataFrame:
    """(query_id, best): for the queries of a task their best ``top`` in its blocks, best an
    array of (less = -score, id).  A task holds at most about ``HELD`` entries."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    kind = to_arrow_type(id_type)

    def batch_of(query, ids, score):
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
        entries = pa.StructArray.from_arrays([pa.array(-score, pa.float64()), pa.array(ids, kind)], ["less", "id"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(query)], pa.int32()), entries)
        return pa.RecordBatch.from_arrays([pa.array(query[starts], kind), lists], ["query_id", "best"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.slice(i, 1).column(c) for c in ("e_ids", "e_vs", "s_ids", "s_vs")}
                ids, queries = (r[c].flatten().to_numpy(zero_copy_only=False) for c in ("e_ids", "s_ids"))
                held.append(best_of_block(ids, _matrix(r["e_vs"].flatten()), queries, _matrix(r["s_vs"].flatten()), top))
                n += len(held[-1][0])
                if n > HELD:
                    held = [_first_of_each(*map(np.concatenate, zip(*held, strict=True)), top)]
                    n = len(held[0][0])
                    if n > HELD // 2:
                        yield batch_of(*held.pop())
                        n = 0
        if held:
            yield batch_of(*_first_of_each(*map(np.concatenate, zip(*held, strict=True)), top))

    entry = T.StructType([T.StructField("less", T.DoubleType()), T.StructField("id", id_type)])
    return blocks.mapInArrow(run, T.StructType([T.StructField("query_id", id_type), T.StructField("best", T.ArrayType(entry))]))


def search(vectors: DataFrame, is_query: Column, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           fit_rows: int = FIT_ROWS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for every row where ``is_query``."""
    require(vectors, id_col, vector_col)
    v = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")) \
        .where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    size = sizes.agg(F.max(F.struct("n", "d"))["d"]).first()[0]
    rows = cut_lineage(rows.where(F.size("v") == (size or 0)))
    id_type = rows.schema["id"].dataType
    tree = fit(rows, top, fit_rows, recall)
    if tree is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"),
                           F.lit(0.0).alias("score"))
    indexed = cut_lineage(_index(rows, tree))
    tree.counts = {r["leaf"]: r["n"] for r in indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # leaves are bounded
    visits = _visits(rows.where("query"), tree, top)
    every, n_every = _in_blocks(indexed, BLOCK_ROWS, "e")
    some, n_some = _in_blocks(cut_lineage(visits), QUERY_ROWS, "s")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    pairs = n_every.join(n_some, "leaf").select("leaf", upto("n_e").alias("e"), "n_s").select("leaf", "e", upto("n_s").alias("s"))
    found = _score(every.join(pairs, ["leaf", "e"]).join(some, ["leaf", "s"]), top, id_type)
    # a query has at most a row for each leaf it visits
    best = F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, top)
    return found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "b")) \
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.less")).alias("score"))
