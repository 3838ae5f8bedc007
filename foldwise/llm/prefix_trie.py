"""Prefix trie of conversations, with subtree totals by time-forward processing.

Turns are numbered over range-partitioned rows.  One pass over the sorted
turns gives each (conversation, depth) the 127-bit hash of its prefix; what a
range leaves open (count and hash of its last conversation) goes on as one row
a range, so a conversation may be longer than any task should hold.  Grouping
by hash gives the nodes; a node is named by its least member and its depth.

Totals: nodes are dealt to shards of bounded size and sorted there in reverse
level order.  A node sends its total to its parent through a priority queue,
which spills sorted runs to the shared folder; messages whose parent is not in
the shard leave it, added up by parent.  The shard roots that share such a
parent become one node of a smaller tree, whose parent is the group of roots
above it in the parent's shard.  That tree is solved in the same way (its
shards join children with parents by a coin, so every round shrinks it), its
totals are sent to the parents they belong to, and a second pass inside the
shards finishes all nodes.

Conversation ids of a node's ends are packed into strings range by range, in
order; the digest of a node reads packed strings only.

Defined cases: turns without conv_id take no part; null role or text is empty;
turns come in order of turn (null first), equal ones by the MD5 digest of role
and text, so rows that are equal are interchangeable and all count; an empty
table gives no nodes; columns other than the four named are ignored.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import require, words
from foldwise.operators.cumulative import in_ranges, running_sums
from foldwise.session import cut_lineage, ensure_checkpoint_dir

SHARD_NODES = 100_000
RANGE_ROWS = 200_000
QUEUE_ITEMS = 200_000
PACK_BYTES = 64 << 10
PRIME = (1 << 127) - 1
STEP = 0x5DEECE66D_1B873593_CC9E2D51_A5A5B7C3 % PRIME
EMPTY = 0x9E3779B97F4A7C15      # hash of no turns
EMPTY_SHA = sha256(b"").hexdigest()


def ranges(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def number_turns(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, k, digest, words): every turn with its number in its conversation, from 1."""
    require(conversations, conv_col, "turn", "role", "text")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col("turn"),
        F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary")).alias("digest"),
        F.size(words(text)).cast("bigint").alias("words")).where("conv is not null")
    # the number of a row in its input task keeps equal rows apart, so that they can lie in several ranges
    turns = turns.select("conv", F.struct("turn", "digest", F.monotonically_increasing_id().alias("tie")).alias("at"),
                         "words", F.lit(1).cast("bigint").alias("one"))
    return running_sums(turns, ["conv"], "at", ["one"]).select(
        "conv", F.col("cum_one").alias("k"), F.col("at.digest").alias("digest"), "words")


def share_heads(turns: DataFrame, block: int, heads: Column) -> DataFrame:
    """Rebuild every conversation c: the first ``heads`` (a count from its ``conv``) turns of conversation
    c - c % block, then its own turns after its first ``heads``.  (conv, part, k, ..): part 0 holds turns of
    the other conversation, part 1 its own, and a row of part -1 stands for the conversation."""
    empty = turns.where("k = 1").select("conv", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("k"),
                                        F.lit("").alias("digest"), F.lit(0).cast("bigint").alias("words"))
    own = turns.where(F.col("k") > heads).select("conv", F.lit(1).alias("part"), "k", "digest", "words")
    wants = empty.select("conv", (F.col("conv") - F.col("conv") % block).alias("of"), heads.cast("bigint").alias("upto")).where("upto > 0")
    most = wants.agg(F.max("upto")).first()[0] or 0
    first = turns.where((F.col("k") <= most) & (F.col("conv") % block == 0)).select(F.col("conv").alias("of"), "k", "digest", "words")
    lent = wants.join(first, "of").where("k <= upto").select("conv", F.lit(0).alias("part"), "k", "digest", "words")
    return empty.unionByName(own).unionByName(lent)


# ---- prefixes -------------------------------------------------------------------------------------------------------

def _halves(h: int) -> tuple[int, int]:
    return h >> 64, (h & (1 << 64) - 1) - (1 << 63)


def _turn_rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _tails(placed: DataFrame) -> list[dict]:
    """One row a range: its first and last conversation, and for the last one how many turns the range holds of it
    (-1 more if it begins here), and hash as h -> h * mul + add."""

    def run(batches):
        from pyspark import TaskContext
        first = last = None
        n, mul, add, begins = 0, 1, 0, False
        for conv, part, digest, _ in _turn_rows(batches):
            if conv != last:
                first = conv if first is None else first
                last, n, mul, add, begins = conv, 0, 1, 0, False
            if part < 0:
                begins = True
            else:
                n, mul, add = n + 1, mul * STEP % PRIME, (add * STEP + int(digest, 16)) % PRIME
        if last is not None:
            yield pa.RecordBatch.from_pydict({"at": [TaskContext.get().partitionId()], "first": [first], "last": [last], "n": [n],
                                              "mul": [str(mul)], "add": [str(add)], "begins": [begins]})

    schema = "at bigint, first bigint, last bigint, n bigint, mul string, add string, begins boolean"
    return sorted((r.asDict() for r in placed.mapInArrow(run, schema).collect()), key=lambda r: r["at"])


def _openings(tails: list[dict]) -> dict[int, tuple]:
    """Range -> (depth and hash of the prefix that its first conversation brings, first conversation of the next range)."""
    out, conv, depth, h = {}, None, 0, EMPTY
    for i, t in enumerate(tails):
        after = tails[i + 1]["first"] if i + 1 < len(tails) else None
        out[t["at"]] = (depth if t["first"] == conv else 0, h if t["first"] == conv else EMPTY, after)
        goes_on = t["last"] == conv and not t["begins"]
        depth, h = (depth, h) if goes_on else (0, EMPTY)
        conv, depth, h = t["last"], depth + t["n"], (h * int(t["mul"]) + int(t["add"])) % PRIME
    return out


def prefixes(turns: DataFrame, rows: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(conv, depth, a, b, pa, pb, words, ends) for every prefix of every conversation: its hash in two halves,
    that of the prefix before, the words of its last turn, and 1 where the conversation ends."""
    order = ["conv", "part", "k"]
    placed = turns.repartitionByRange(ranges(rows, range_rows), *order).sortWithinPartitions(*order)
    placed = cut_lineage(placed.select("conv", "part", "digest", "words"))
    openings = placed.sparkSession.sparkContext.broadcast(_openings(_tails(placed)))    # a row a range
    names = ["conv", "depth", "a", "b", "pa", "pb", "words", "ends"]

    def run(batches):
        from pyspark import TaskContext
        depth, h, after = openings.value.get(TaskContext.get().partitionId(), (0, EMPTY, None))
        conv, held, out = None, None, []
        for c, part, digest, n in _turn_rows(batches):
            if held:
                out.append((*held, int(c != conv)))
            if conv is not None and c != conv:
                depth, h = 0, EMPTY
            conv = c
            if part < 0:
                depth, h = 0, EMPTY
                held = (c, 0, *_halves(h), 0, 0, 0)
            else:
                before, h, depth = h, (h * STEP + int(digest, 16)) % PRIME, depth + 1
                held = (c, depth, *_halves(h), *_halves(before), n)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names)
                out = []
        if held:
            out.append((*held, int(after != conv)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names)

    return placed.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


# ---- totals ---------------------------------------------------------------------------------------------------------

class SpillingQueue:
    """Priority queue of tuples; beyond ``most`` items in memory, sorted runs go to files in the shared folder."""

    def __init__(self, folder: str, most: int = QUEUE_ITEMS, block: int = 4096):
        self.folder, self.most, self.block = folder, most, block
        self.heap, self.heads, self.files = [], [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/queue-{uuid.uuid4().hex}"
        self.files.append((store, path))
        self.heap.sort()
        with store.open_output_stream(path) as f:
            for i in range(0, len(self.heap), self.block):
                pickle.dump(self.heap[i:i + self.block], f)
        self.heap = []
        self._next(self._items(store, path))

    @staticmethod
    def _items(store, path) -> Iterator[tuple]:
        with store.open_input_stream(path) as f:
            while True:
                try:
                    yield from pickle.load(f)
                except EOFError:
                    return

    def _next(self, run: Iterator[tuple]) -> None:
        if (item := next(run, None)) is not None:
            heapq.heappush(self.heads, (item, len(self.files), id(run), run))

    def least(self) -> tuple | None:
        """The least item, left where it is."""
        spilled = self.heads[0][0] if self.heads else None
        own = self.heap[0] if self.heap else None
        return own if spilled is None or own is not None and own <= spilled else spilled

    def pop(self) -> tuple:
        if self.heads and self.least() is self.heads[0][0]:
            item, _, _, run = heapq.heappop(self.heads)
            self._next(run)
            return item
        return heapq.heappop(self.heap)

    def close(self) -> None:
        for _, _, _, run in self.heads:
            run.close()
        for store, path in self.files:
            store.delete_file(path)
        self.heap, self.heads, self.files = [], [], []


def forward(rows: Iterator[tuple], queue: SpillingQueue) -> Iterator[tuple]:
    """Totals of the rows (depth, conv, kind, parent depth, parent conv, leaves, saved, children) of one shard in
    reverse level order.  Kind 0 is what other shards send to a node, before the node itself, kind 1.

    Yields (1, depth, conv, None, None, leaves, saved, children) for a node, and (0, depth and conv of the highest root,
    depth and conv of the parent, leaves, saved, roots) for all roots that share a parent beyond the shard."""

    def leave(upto):
        while (item := queue.least()) is not None and (upto is None or item[:2] < upto):
            queue.pop()
            to, root, total = item[:2], item[2:4], list(item[4:])
            while (item := queue.least()) is not None and item[:2] == to:
                queue.pop()
                root, total = min(root, item[2:4]), [x + y for x, y in zip(total, item[4:], strict=True)]
            yield (0, *root, -to[0], to[1], *total)

    sent = None     # what has arrived for the node at hand
    for depth, conv, kind, p_depth, p_conv, leaves, saved, children in rows:
        here = (-depth, conv)
        if kind == 0:
            sent = (here, leaves, saved, children)
            continue
        yield from leave(here)
        if sent and sent[0] == here:
            leaves, saved, children = leaves + sent[1], saved + sent[2], children + sent[3]
        while (item := queue.least()) is not None and item[:2] == here:
            queue.pop()
            leaves, saved, children = leaves + item[4], saved + item[5], children + item[6]
        yield (1, depth, conv, None, None, leaves, saved, children)
        if p_conv is not None:
            queue.push((-p_depth, p_conv, depth, conv, leaves, saved, 1))
    yield from leave(None)


def groups_of_roots(rows: list[tuple]) -> list[tuple]:
    """(depth, conv, depth and conv of its group) for the nodes of a shard, given as in ``forward``: the group of a
    root is named by the highest (then least) root with its parent, so it lies above all that send to it; that of
    other nodes is their parent's."""
    here = {r[:2] for r in rows}
    name: dict[tuple, tuple] = {}
    for depth, conv, _, p_depth, p_conv, *_ in rows:
        if (p_depth, p_conv) not in here:
            own = (depth, conv)
            name[p_depth, p_conv] = min(name.get((p_depth, p_conv), own), own)
    group: dict[tuple, tuple] = {}
    for depth, conv, _, p_depth, p_conv, *_ in reversed(rows):
        group[depth, conv] = group[p_depth, p_conv] if (p_depth, p_conv) in here else name[p_depth, p_conv]
    return [(*node, *g) for node, g in group.items()]


def _by_shard(batches) -> Iterator[Iterator[tuple]]:
    from itertools import groupby
    for _, rows in groupby(_turn_rows(batches), key=lambda r: r[0]):
        yield (r[1:] for r in rows)


NODE = ["depth", "conv", "kind", "p_depth", "p_conv", "leaves", "saved", "children"]


def _run_forward(placed: DataFrame, folder: str, queue_items: int) -> DataFrame:
    """``forward`` over each shard of rows (shard, *NODE), sorted by shard and reverse level order."""
    names = ["shard", "is_node", "depth", "conv", "p_depth", "p_conv", "leaves", "saved", "children"]

    def run(batches):
        out = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names)
        from itertools import groupby
        for shard, rows in groupby(_turn_rows(batches), key=lambda r: r[0]):
            queue = SpillingQueue(folder, queue_items)
            try:
                for row in forward((r[1:] for r in rows), queue):
                    out.append((shard, *row))
                    if len(out) >= 10_000:
                        yield batch()
                        out.clear()
            finally:
                queue.close()
        if out:
            yield batch()

    return placed.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _run_groups(placed: DataFrame) -> DataFrame:
    """(shard, depth, conv, g_depth, g_conv) of all nodes; a task holds one shard."""
    names = ["shard", "depth", "conv", "g_depth", "g_conv"]

    def run(batches):
        from itertools import groupby
        for shard, rows in groupby(_turn_rows(batches), key=lambda r: r[0]):
            found = groups_of_roots([r[1:] for r in rows])
            for i in range(0, len(found), 10_000):
                part = found[i:i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(part), pa.int64()), *[pa.array(x, pa.int64()) for x in zip(*part)]], names)

    return placed.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _deal(rows: DataFrame, shards: int) -> DataFrame:
    """Rows (shard, *NODE) with every shard in one task, in reverse level order."""
    return rows.select("shard", *NODE).repartition(shards, "shard").sortWithinPartitions("shard", F.desc("depth"), "conv", "kind")


def subtree_totals(nodes: DataFrame, shard_nodes: int = SHARD_NODES, queue_items: int = QUEUE_ITEMS, turn: int = 0) -> DataFrame:
    """(depth, conv, leaves, saved, children) of every node: sums over its subtree, and the number of its children.
    ``nodes``: (depth, conv, p_depth, p_conv, leaves, saved), named by depth and conv, a parent's depth being less."""
    spark = nodes.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trie-queues"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    nodes = cut_lineage(nodes)
    shards = ranges(nodes.count(), shard_nodes)
    own = F.struct("depth", "conv")
    near = F.struct("conv", "depth")
    if turn:    # a child whose coin is tails goes where its parent is, if that one's is heads
        coin = lambda *c: F.xxhash64(F.lit(turn), *c) % 2 == 0
        near = F.when(F.col("p_conv").isNotNull() & ~coin("conv", "depth") & coin("p_conv", "p_depth"),
                      F.struct(F.col("p_conv").alias("conv"), F.col("p_depth").alias("depth"))).otherwise(near)
    placed = nodes.withColumns({"kind": F.lit(1).cast("bigint"), "children": F.lit(0).cast("bigint")})
    if shards > 1:
        placed = placed.repartitionByRange(shards, near, own)
    placed = cut_lineage(placed.withColumn("shard", F.spark_partition_id().cast("bigint") if shards > 1 else F.lit(0).cast("bigint")))
    dealt = _deal(placed, shards)
    totals = ["depth", "conv", "leaves", "saved", "children"]
    if shards == 1:
        return _run_forward(dealt, folder, queue_items).where("is_node = 1").select(*totals)

    roots = cut_lineage(_run_forward(dealt, folder, queue_items).where("is_node = 0"))
    groups = cut_lineage(_run_groups(dealt))
    # a group's parent is the group that holds the node above it; the groups with one node above are at most one a shard
    above = groups.select(F.col("depth").alias("p_depth"), F.col("conv").alias("p_conv"), F.col("shard").alias("p_shard"), "g_depth", "g_conv")
    roots = cut_lineage(roots.join(above, ["p_depth", "p_conv"]))
    top = groups.where((F.col("depth") == F.col("g_depth")) & (F.col("conv") == F.col("g_conv"))) \
                .join(roots.select("depth", "conv"), ["depth", "conv"], "left_anti")
    # groups that send nothing hold a root of the whole tree: no total of theirs is asked for, but they are parents
    small = roots.select("depth", "conv", F.col("g_depth").alias("p_depth"), F.col("g_conv").alias("p_conv"), "leaves", "saved")
    none = F.lit(None).cast("bigint")
    small = small.unionByName(top.select("depth", "conv", none.alias("p_depth"), none.alias("p_conv"),
                                         F.lit(0).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved")))
    solved = subtree_totals(small, shard_nodes, queue_items, turn + 1).select("depth", "conv", "leaves", "saved")
    sent = roots.drop("leaves", "saved").join(solved, ["depth", "conv"])
    sent = sent.groupBy(F.col("p_shard").alias("shard"), F.col("p_depth").alias("depth"), F.col("p_conv").alias("conv")) \
               .agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "children")])
    sent = sent.withColumns({"kind": F.lit(0).cast("bigint"), "p_depth": none, "p_conv": none})
    both = placed.select("shard", *NODE).unionByName(sent.select("shard", *NODE))
    return _run_forward(_deal(both, shards), folder, queue_items).where("is_node = 1").select(*totals)


# ---- nodes ----------------------------------------------------------------------------------------------------------

def _parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with p_conv, the parent's least member: a node follows its parent in the order of the parent's hash,
    and the last parent of a range goes on to the next, so many children of one node lie in many ranges."""
    asks = nodes.where("depth > 0").select((F.col("depth") - 1).alias("at"), F.col("pa").alias("x"), F.col("pb").alias("y"), "conv", "depth")
    gives = nodes.select(F.col("depth").alias("at"), F.col("a").alias("x"), F.col("b").alias("y"), "conv", F.lit(-1).cast("bigint").alias("depth"))
    order = [F.col(c) for c in ("at", "x", "y", "depth", "conv")]
    placed = in_ranges(gives.unionByName(asks), order, "__rb").withColumn("giver", F.when(F.col("depth") < 0, F.col("conv")))
    key = F.struct(*order)
    last = placed.where("giver is not null").groupBy("__rb").agg(F.max_by("giver", key).alias("last"))
    every = placed.groupBy("__rb").agg(F.count(F.lit(1)).alias("n")).join(last, "__rb", "left")
    before = Window.orderBy("__rb").rowsBetween(Window.unboundedPreceding, -1)      # a row a range
    brought = every.select("__rb", F.last("last", ignorenulls=True).over(before).alias("brought"))
    inside = Window.partitionBy("__rb").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed.withColumn("own", F.last("giver", ignorenulls=True).over(inside)).where("depth > 0").join(brought, "__rb")
    return nodes.join(found.select("depth", "conv", F.coalesce("own", "brought").alias("p_conv")), ["depth", "conv"], "left")


def _end_digests(members: DataFrame, rows: int, range_rows: int) -> DataFrame:
    """(a, b, ends_sha256): digest of the ids of the conversations that end at a node, ascending, joined by commas."""
    ends = members.where("ends = 1").select("a", "b", "conv")
    ends = ends.repartitionByRange(ranges(rows, range_rows), "a", "b", "conv").sortWithinPartitions("a", "b", "conv")

    def pack(batches):
        node, first, text, size, out = None, 0, [], 0, []
        rows_of = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["a", "b", "first", "ids"])
        for a, b, conv in _turn_rows(batches):
            if text and ((a, b) != node or size > PACK_BYTES):
                out.append((*node, first, ",".join(text)))
                text, size = [], 0
                if len(out) >= 1000:
                    yield rows_of()
                    out.clear()
            if not text:
                node, first = (a, b), conv
            text.append(str(conv))
            size += len(text[-1]) + 1
        if text:
            out.append((*node, first, ",".join(text)))
            yield rows_of()

    packed = ends.mapInArrow(pack, "a bigint, b bigint, first bigint, ids string")
    packed = packed.repartition("a", "b").sortWithinPartitions("a", "b", "first")

    def digest(batches):
        node, h, out = None, None, []
        rows_of = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["a", "b", "ends_sha256"])
        for a, b, _, ids in _turn_rows(batches):
            if (a, b) != node:
                if h:
                    out.append((*node, h.hexdigest()))
                    if len(out) >= 10_000:
                        yield rows_of()
                        out.clear()
                node, h = (a, b), sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if h:
            out.append((*node, h.hexdigest()))
            yield rows_of()

    return packed.mapInArrow(digest, "a bigint, b bigint, ends_sha256 string")


def trie(turns: DataFrame, shard_nodes: int = SHARD_NODES, range_rows: int = RANGE_ROWS, queue_items: int = QUEUE_ITEMS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the
    conversations ``turns``, as ``share_heads`` gives them (or with every turn in part 1 beside the rows of part -1)."""
    turns = cut_lineage(turns)
    rows = turns.count()
    members = cut_lineage(prefixes(turns, rows, range_rows))
    nodes = members.groupBy("depth", "a", "b").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.sum("ends").alias("n_ends"),
        F.max("words").alias("words"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    nodes = cut_lineage(_parents(cut_lineage(nodes)))
    valued = nodes.select("depth", "conv", F.when(F.col("p_conv").isNotNull(), F.col("depth") - 1).alias("p_depth"), "p_conv",
                          (F.col("n_ends") == F.col("n_convs")).cast("bigint").alias("leaves"),
                          ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = subtree_totals(valued, shard_nodes, queue_items)
    out = nodes.join(totals, ["depth", "conv"]).join(_end_digests(members, rows, range_rows), ["a", "b"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("p_conv").alias("parent_conv_id"), "n_convs",
                      F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS k,
  length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || ':' || coalesce(text, '') AS s,
  len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS w
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, c - c % 20 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda r, byte: list_reduce(
    list_prepend(xor(r, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END))) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c.c, 0 AS part, t.k, t.s, t.w FROM c JOIN t ON t.c = c.base AND t.k <= c.h
  UNION ALL SELECT c.c, 1, t.k, t.s, t.w FROM c JOIN t ON t.c = c.c AND t.k > c.h),
l AS (SELECT c.c, coalesce(list(r.s ORDER BY part, k) FILTER (WHERE r.s IS NOT NULL), []) AS p,
    coalesce(list(r.w ORDER BY part, k) FILTER (WHERE r.s IS NOT NULL), []) AS w FROM c LEFT JOIN r USING (c) GROUP BY c.c),
m AS (SELECT c, d, p[1:d] AS p, len(p) = d AS ends, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w
  FROM (SELECT c, p, w, unnest(range(0, len(p) + 1)) AS d FROM l)),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c)
    FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY p, d),
k AS (SELECT n.p, n.d, count(x.p) AS n_children FROM n LEFT JOIN n x ON x.d = n.d + 1 AND x.p[1:n.d] = n.p GROUP BY n.p, n.d),
u AS (SELECT n.p, n.d, unnest(range(0, n.d + 1)) AS e, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * w AS saved FROM n JOIN k USING (p, d)),
s AS (SELECT p[1:e] AS p, e AS d, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN k USING (p, d) JOIN s USING (p, d) LEFT JOIN n q ON q.d = n.d - 1 AND q.p = n.p[1:n.d - 1]"""
