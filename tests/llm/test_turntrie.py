"""The trie of conversation prefixes against one built of Python tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lakeops.llm import turntrie

CONVS = "conv_id long, turn long, role string, text string, k string, pos int, depth int, d0 string, `a.b` int"


def convs_of(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, "d", 3) for r in rows], CONVS)


def own_turns(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [r[2:] for r in sorted(found)] for c, found in turns.items()}


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def by_hand(turns):
    if not turns:
        return []
    members = defaultdict(list)
    for c, path in turns.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = kids[path]
        leaves[path] = sum(leaves[b] for b in below) if below else 1
        saved[path] = sum(saved[b] for b in below) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    return [
        (
            min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids[path]), leaves[path], saved[path],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(turns[c]) == len(path)).encode()).hexdigest(),
        )
        for path, m in members.items()
    ]


def same(found, want):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {f.dataType.simpleString() for f in found.schema.fields if f.name != "ends_sha256"} == {"bigint"}
    got = [tuple(r) for r in found.select(columns).collect()]

    def order(r):
        return (r[1], r[0], r[7], r)

    assert sorted(got, key=order) == sorted(want, key=order)


HARD = [
    *[(c, t, "user" if t % 2 else None, f"turn {min(t, c % 4)}") for c in (0, 1, 2, 7, 100, 101, 203, -5, -100) for t in range(c % 13)],
    (300, None, None, None), (300, None, None, None), (300, 0, "user", ""), (301, 5, "a", "Ünï"), (301, 5, "a", "Unï"), (301, 5, "A", "x"),
    (400, 1, "user", "alone"), (499, 1, "user", "alone"), (None, 1, "user", "no conversation"), (None, None, None, None),
    *[(500, t, "user", f"long {t}") for t in range(37)], *[(501, t, "user", f"long {t}" if t != 20 else "other") for t in range(37)], *[(502, t, "user", f"long {t}") for t in range(16)],
    *[(c, t, "user", "the same") for c in range(600, 690) for t in range(9)],
]


@pytest.mark.parametrize("block", [1, 4])
def test_tree_like_by_hand(spark, block):
    same(turntrie.tree(convs_of(spark, HARD), block), by_hand(own_turns(HARD)))


def test_rebuilt_tree_like_by_hand(spark):
    dice = random.Random(11)
    rows = HARD + [(c, t, "u", dice.choice("abc")) for c in range(1000, 1400) for t in range(dice.randint(1, 11))]
    same(turntrie.rebuilt_tree(convs_of(spark, rows)), by_hand(rebuilt(own_turns(rows))))


def test_blocks_are_refined_only_where_siblings_diverge(spark):
    rows = [(c, t, "u", f"{t}" if t < 8 or c == 1 else f"{t} of {c}") for c in (1, 2, 3) for t in range(12)]
    turns = turntrie.hashed(turntrie.turns_of(convs_of(spark, rows)))
    blocks = turntrie.blocks_of(turns, 4)
    groups = blocks.groupBy("k").agg(F.countDistinct(*turntrie.DIGEST).alias("n"))
    assert {r["k"]: r["n"] for r in groups.collect()} == {0: 1, 1: 1, 2: 3}
    same(turntrie.tree(convs_of(spark, rows)), by_hand(own_turns(rows)))


def test_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "PIECE", 7)
    rows = [(c, 1, "u", "the same") for c in range(5, 120)] + [(1000 + c, 1, "u", f"{c % 30}") for c in range(60)]
    same(turntrie.tree(convs_of(spark, rows)), by_hand(own_turns(rows)))


def test_no_rows(spark):
    assert turntrie.tree(convs_of(spark, [])).count() == 0
    assert turntrie.rebuilt_tree(convs_of(spark, [(None, 1, "u", "x")])).count() == 0
