"""The conversation trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from lumenfold.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, depth int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in own.items()}
    nodes, ends, last = defaultdict(list), defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - c % 20, [])[:h] + own[c][h:]
        key = ("root",)
        names = [key]
        for t in path:
            key = (hash((key, t)), t)
            names.append(key)
        for d, key in enumerate(names):
            nodes[d, key].append(c)
            last[d, key] = (path[d - 1] if d else ("", ""), names[d - 1] if d else None)
        ends[len(path), key].append(c)
    children = defaultdict(list)
    for (d, key), (_, parent) in last.items():
        if d:
            children[d - 1, parent].append((d, key))
    leaves, saved, out = {}, {}, []
    for d, key in sorted(nodes, key=lambda n: -n[0]):
        under = children[d, key]
        leaves[d, key] = sum(leaves[c] for c in under) if under else 1
        words = len(re.findall("[^\x20\x09-\x0d]+", last[d, key][0][1]))
        saved[d, key] = sum(saved[c] for c in under) + (len(nodes[d, key]) - 1) * words
    for (d, key), members in nodes.items():
        parent = min(nodes[d - 1, last[d, key][1]]) if d else None
        ids = ",".join(map(str, sorted(ends[d, key])))
        out.append((min(members), d, parent, len(members), len(children[d, key]), leaves[d, key], saved[d, key], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, bound):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, trie.prefix_trie(table, bound).collect()), key=repr)


def test_shared_prefixes_nulls_and_repeats(spark):
    rng = random.Random(3)
    rows = []
    for c in range(0, 130):
        if c in (20, 41):  # absent bases and members
            continue
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, rng.choice(["user", "system", None]), rng.choice(["a b", "c", None, "", "d e  f"])))
    rows += [(5, 2, "user", "tie"), (5, 2, "user", "tie"), (5, 2, None, "tie"), (7, None, "system", "first of all"), (None, 0, "user", "x"), (300, 0, None, None)]
    rows += [(60, 1, "user", "repeated")] * 30
    wanted = brute(rows)
    for bound in (1, 40, trie.BOUND):
        assert found(spark, rows, bound) == wanted


def test_deep_conversation_over_many_ranges(spark):
    rows = [(20, i, "user", f"turn {i}") for i in range(400)] + [(c, i, "user", f"turn {i}") for c in (21, 22, 23, 44) for i in range(100 + c)]
    assert found(spark, rows, 60) == brute(rows)


def test_many_equal_conversations_and_first_turns(spark):
    rows = [(c, i, "user", f"t{i if c % 3 else c}") for c in range(600) for i in range(3)]
    assert found(spark, rows, 500) == brute(rows)


def test_empty_and_textless(spark):
    assert found(spark, [], trie.BOUND) == []
    assert found(spark, [(None, 1, "user", "x")], trie.BOUND) == []
    short = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(short, 0, "user", "gone")]
    assert found(spark, rows, trie.BOUND) == brute(rows) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_long_text(spark):
    rows = [(c, 0, "user", "word " * 200_000) for c in range(3)]
    assert found(spark, rows, trie.BOUND) == brute(rows)


def test_decompose_equals_plain_sums():
    rng = random.Random(1)
    for n in (1, 2, 3, 50, 400):
        parents = [-1] + [rng.randint(max(0, i - 5), i - 1) for i in range(1, n)]
        order = sorted(range(n), key=lambda v: depth_of(parents, v))
        place = {v: i for i, v in enumerate(order)}
        parents = [place.get(parents[v], -1) for v in order]
        values = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)]
        own, weights, sums = [rng.randint(1, 4) for _ in range(n)], None, [list(v) for v in values]
        weights = list(own)
        for v in range(n - 1, 0, -1):
            weights[parents[v]] += weights[v]
            sums[parents[v]][0] += sums[v][0]
            sums[parents[v]][1] += sums[v][1]
        assert trie.decompose(parents, weights, values) == [tuple(s) for s in sums]


def depth_of(parents, v):
    return 0 if parents[v] < 0 else 1 + depth_of(parents, parents[v])
