import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from newsflow.llm import prefix_trie, queries
from newsflow.llm.prefix_trie import Parentheses, Trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(told)] for c, told in own.items()}
    made = {}
    for c, told in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + told[h:]
    nodes = defaultdict(list)
    for c, told in made.items():
        for d in range(len(told) + 1):
            nodes[tuple(told[:d])].append(c)
    children = defaultdict(int)
    for n in nodes:
        if n:
            children[n[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(members) - 1) * (len(n[-1][1]) if n else 0)
    ends = {n: ",".join(str(c) for c in sorted(m) if len(made[c]) == len(n)) for n, m in nodes.items()}
    return sorted(
        (min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest())
        for n, m in nodes.items()
    )


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: r[:2] + r[3:])


def test_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    got = queries.QUERIES["op13_prefix_trie"](spark, folder)
    want = con.sql(queries.SQL["op13_prefix_trie"])
    assert got.columns == want.columns
    assert in_order(got.collect()) == in_order(want.fetchall())


@pytest.mark.parametrize("options", [Trie(), Trie(shard_nodes=30, layer_factor=3), Trie(shard_nodes=1, layer_factor=2)])
def test_equals_brute_force_on_odd_rows(spark, options):
    rng = random.Random(4)
    rows = []
    for c in [*range(-30, 60), *range(95, 260), 1000, 1001, 10_000_000_003, 500]:
        if c == 100:
            continue
        for t in range(rng.choice([1, 2, 3, 3, 7])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "é😀", "user"])))
    rows += [(7000 + i, t, "user", f"same {t}") for i in range(60) for t in range(9)]  # copies
    rows += [(8001, t, "user", f"turn {t}") for t in range(700)]  # one long conversation
    rows += [(8002, t, "user", f"turn {t}" * (1 + (t == 650) * 5000)) for t in range(700)]
    rows += rows[:40] + [(None, 0, "user", "nobody")] * 3 + [(9001, None, None, None)] * 4
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = prefix_trie.trie(table.repartition(5), options).collect()
    assert in_order(got) == brute(rows)


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(none).count() == 0
    # crc32("3") % 6 leaves nothing of one turn if it is not 0, so the root is all there is.
    c = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 6)
    rows = [(c, 0, "user", "gone", "x", 1)]
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r)[:7] for r in got] == [(c, 0, None, 1, 0, 1, 0)] and got[0]["ends_sha256"] == hashlib.sha256(str(c).encode()).hexdigest()


@pytest.mark.parametrize("shape", ["random", "chain", "star", "lone"])
def test_findclose_and_ranks(shape):
    rng = random.Random(1)
    n = 1 if shape == "lone" else 3000
    parent = np.array([-1] + [{"chain": i - 1, "star": 0, "random": rng.randrange(max(-1, i - 40), i)}[shape] for i in range(1, n)])
    opens, order = prefix_trie.encoded(parent)
    tree = Parentheses(opens)
    stack, close = [], {}
    for i, o in enumerate(opens):
        if o:
            stack.append(i)
        else:
            close[stack.pop()] = i
    start = np.flatnonzero(opens)
    assert not stack and sorted(order) == list(range(n))
    assert tree.findclose(start).tolist() == [close[i] for i in start.tolist()]
    own = np.arange(n) + 1
    leaves, saved = prefix_trie.subtree_sums(parent, own, own, True)
    want_saved, want_leaves = own.copy(), np.array([int(i not in set(parent.tolist())) for i in range(n)])
    for i in range(n - 1, 0, -1):
        if parent[i] >= 0:
            want_saved[parent[i]] += want_saved[i]
            want_leaves[parent[i]] += want_leaves[i]
    assert leaves.tolist() == want_leaves.tolist() and saved.tolist() == want_saved.tolist()
