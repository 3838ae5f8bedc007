import random
import re
import zlib
from collections import defaultdict
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from foldwise.llm import prefix_trie as P
from foldwise.llm.queries import QUERIES
from foldwise.session import read_table

SF = "/root/testdata/sf0.01"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows, block=20):
    """conv -> its rebuilt (role, text) turns."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            turns[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t for *_, t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % block) * (1 if c > 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute(convs):
    """All columns of every node, from the members of every prefix."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    count = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text))
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, cs in members.items():
        own = (len(cs) - 1) * count(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += p not in children
    rows = set()
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(p))))
        rows.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p],
                  sha256(ends.encode()).hexdigest()))
    assert len(rows) == len(members)
    return rows


def run(spark, rows, **limits):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    got = P.trie(P.share_heads(P.number_turns(df), 20, heads), **limits)
    assert got.columns == NAMES
    found = [tuple(r) for r in got.collect()]
    assert len(set(found)) == len(found)
    return set(found)


def test_hostile_rows(spark):
    r = random.Random(3)
    text = lambda: r.choice(["a", "a b", "", None, "x\ty  z", "long " * 2000])
    rows = [(r.choice([0, 1, 2, 3, 20, 21, 25, -1, -3, -21, 40, 41, 47, None]), r.choice([None, 0, 1, 2, 3]), r.choice(["u", None, "1:"]), text())
            for _ in range(150)]
    rows += rows[:20] + [(60 + i, 0, "u", "one turn") for i in range(19)]      # repeats, turnless ones
    want = brute(rebuilt(rows))
    assert run(spark, rows) == want
    assert run(spark, rows, shard_nodes=40, range_rows=25, queue_items=3) == want


def test_long_chain_and_many_children(spark):
    rows = [(1, i, "u", f"t{i}") for i in range(300)]                              # one conversation of a third of all turns
    rows += [(2000 + 20 * i, k, "u", f"t{k}" if k < i % 5 else f"{i} {k}") for i in range(120) for k in range(3)]   # branches at the top
    rows += [(8000 + 20 * i, k, "u", f"t{k}") for i in range(60) for k in range(4)]  # equal conversations
    want = brute(rebuilt(rows))
    assert run(spark, rows, shard_nodes=60, range_rows=100, queue_items=5) == want


@pytest.mark.parametrize("shard_nodes", [7, 100])
def test_totals_of_random_trees(spark, shard_nodes):
    r = random.Random(shard_nodes)
    nodes = {(0, 0): None}
    for i in range(1, 250):     # chains that mix with each other, a caterpillar, a star
        d, c = r.choice([max(nodes), r.choice(sorted(nodes)), (0, 0)])
        nodes[d + r.choice([1, 1, 3]), r.randrange(10 ** 6)] = (d, c)
    value = {n: r.randrange(5) for n in nodes}
    total, kids = dict(value), defaultdict(int)
    for n in sorted(nodes, reverse=True):
        if (p := nodes[n]) is not None:
            total[p] += total[n]
            kids[p] += 1
    df = spark.createDataFrame([(*n, *(p or (None, None)), value[n], 10 * value[n]) for n, p in nodes.items()],
                               "depth long, conv long, p_depth long, p_conv long, leaves long, saved long")
    got = P.subtree_totals(df, shard_nodes=shard_nodes, queue_items=4)
    assert {tuple(x) for x in got.collect()} == {(*n, total[n], 10 * total[n], kids[n]) for n in nodes}


def test_queue_spills(tmp_path):
    r = random.Random(1)
    queue = P.SpillingQueue(f"file://{tmp_path}", most=5, block=3)
    held, out = [], []
    for _ in range(400):
        if held and r.random() < 0.45:
            assert queue.least() == min(held)
            out.append(queue.pop())
            held.remove(out[-1])
        else:
            item = (r.randrange(40), r.randrange(3))
            queue.push(item)
            held.append(item)
    assert queue.files
    assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.least() is None
    queue.close()
    assert not list(tmp_path.iterdir())


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_prefix_trie"](spark, SF)
    assert {tuple(r) for r in got.select(*NAMES).collect()} == brute(rebuilt(rows))
