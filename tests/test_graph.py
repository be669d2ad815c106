"""Graph jobs against the published values of the 34-member club graph (Zachary 1977)."""

import glob
import itertools
import os
import random
import tempfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeops.operators import graph as g
from lakeops.operators import moves, walks
from lakeops.session import CLEANUP, settle, shared_dir

# The 78 friendships, vertex -> higher neighbours.
CLUB = {
    0: [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31],
    1: [2, 3, 7, 13, 17, 19, 21, 30],
    2: [3, 7, 8, 9, 13, 27, 28, 32],
    3: [7, 12, 13],
    4: [6, 10],
    5: [6, 10, 16],
    6: [16],
    8: [30, 32, 33],
    9: [33],
    13: [33],
    14: [32, 33],
    15: [32, 33],
    18: [32, 33],
    19: [33],
    20: [32, 33],
    22: [32, 33],
    23: [25, 27, 29, 32, 33],
    24: [25, 27, 31],
    25: [31],
    26: [29, 33],
    27: [33],
    28: [31, 33],
    29: [32, 33],
    30: [32, 33],
    31: [32, 33],
    32: [33],
}


@pytest.fixture(scope="module")
def club(spark):
    pairs = [(a, b, 1.0) for a, bs in CLUB.items() for b in bs]
    assert len(pairs) == 78
    edges = spark.createDataFrame(pairs, "src long, dst long, weight double")
    return g.Graph(spark.range(34), edges, directed=False)


def by_id(df, value):
    return {r["id"]: r[value] for r in df.collect()}


def test_components_and_spanning_tree(club):
    assert set(by_id(g.connected_components(club.vertices, club.edges), "component").values()) == {0}
    tree = g.spanning_forest(club.vertices, club.edges).collect()
    assert len(tree) == 33 and sum(r["weight"] for r in tree) == 33


def test_pagerank(club):
    scores = by_id(g.pagerank(club.vertices, club.hops(), 0.85, 30), "score")
    assert round(scores[33], 4) == 0.1009 and round(scores[0], 4) == 0.0970
    assert abs(sum(scores.values()) - 1) < 1e-9


def test_betweenness_and_closeness(club, spark):
    b = by_id(g.betweenness(club.vertices, club.hops()), "score")
    assert [round(b[i], 4) for i in (0, 33, 32)] == [0.4376, 0.3041, 0.1452]
    assert by_id(g.betweenness(club.vertices, club.hops(), lanes=3, at_once=7), "score") == pytest.approx(b)
    c = by_id(g.closeness(club.hops(), spark.range(34).withColumnRenamed("id", "source"), 34), "closeness")
    assert [round(c[i], 4) for i in (0, 2, 33)] == [0.5690, 0.5593, 0.5500]
    assert by_id(g.all_closeness(club.vertices, club.hops(), words=1), "closeness") == pytest.approx(c)


def test_closeness_of_every_vertex(spark, random_graph):
    """Directed, several batches, vertices without edges and out of reach."""
    pairs = [(a, b) for a, b in random_graph] + [(100 + i, 101 + i) for i in range(6)]
    ids = [*range(30), *range(100, 140), 500]
    far = {}
    for v in ids:
        depth, edge = {v: 0}, [v]
        while edge:
            edge = list({b for a, b in pairs if a in edge and b not in depth})
            depth |= {b: 1 + min(depth[a] for a, c in pairs if c == b and a in depth) for b in edge}
        far[v] = [d for u, d in depth.items() if u != v]
    want = {v: len(d) / sum(d) * (len(d) / (len(ids) - 1)) if d else 0.0 for v, d in far.items()}
    vertices = spark.createDataFrame([(v,) for v in ids], "id long")
    got = by_id(g.all_closeness(vertices, spark.createDataFrame(pairs, "src long, dst long"), words=1), "closeness")
    assert got == pytest.approx(want)


def test_strong_components_of_a_chain_take_few_turns(spark, monkeypatch):
    turns = []

    class Counted(g.Rounds):
        def put(self, df):
            turns.append(self.name)
            return super().put(df)

    monkeypatch.setattr(g, "Rounds", Counted)
    # 12 pairs, each both ways, joined to a chain.
    pairs = [e for i in range(12) for e in ((2 * i, 2 * i + 1), (2 * i + 1, 2 * i), (2 * i + 1, 2 * i + 2))]
    found = by_id(g.strongly_connected(spark.range(26), spark.createDataFrame(pairs, "src long, dst long").coalesce(2)), "component")
    assert found == {v: v // 2 * 2 if v < 24 else v for v in range(26)}
    assert turns.count("scc-state") - 1 <= 8  # 2 log2 of 12 pairs


def test_bfs_and_paths(club, spark):
    sources = spark.createDataFrame([(0,)], "source long")
    depths = g.bfs(club.hops(), sources).groupBy("depth").count().orderBy("depth").collect()
    assert [r["count"] for r in depths] == [1, 16, 9, 8]
    reach = g.bfs(club.hops(), sources, max_depth=2).where("depth > 0").count()
    assert reach == 25
    path = g.shortest_path(club.hops(), 0, 33).orderBy("step").collect()
    assert [r["id"] for r in path] == [0, 8, 33] and path[-1]["distance"] == 2
    line = spark.createDataFrame([(i, i + 1, 1.0) for i in range(11)], "src long, dst long, weight double")
    walk = g.shortest_path(line, 2, 9).orderBy("step").collect()
    assert [tuple(r) for r in walk] == [(i, 2 + i, float(i)) for i in range(8)]
    assert g.shortest_path(line, 9, 2).count() == 0 and [tuple(r) for r in g.shortest_path(line, 4, 4).collect()] == [(0, 4, 0.0)]


def test_triangles_and_similarity(club, spark):
    t = by_id(g.triangle_counts(club.vertices, club.edges), "triangle_count")
    assert (sum(t.values()) // 3, t[0], t[33]) == (45, 18, 15)
    pairs = spark.createDataFrame([(0, 1), (0, 33)], "a long, b long")
    s = {r["b"]: round(r["similarity"], 4) for r in g.pair_similarity(club.edges, pairs).collect()}
    assert s == {1: 0.3889, 33: 0.1379}
    near = g.nearest(club.edges, 0, 5).orderBy("rank").collect()
    assert [r["neighbor_id"] for r in near] == [1, 3, 2, 7, 13]


def test_communities_raise_modularity(club):
    groups = g.communities(club.vertices, club.edges)
    row = g.modularity(club.edges, groups).first()
    assert row["members"] == 34 and 2 <= row["groups"] <= 8 and row["modularity"] > 0.3


def plain_communities(links, ids, halves, resolution, least_gain):
    """The rule of ``communities`` row by row; ``links`` has both directions, ``halves`` the half of (vertex, turn)."""
    m2, assigned, reached = sum(links.values()), {v: v for v in ids}, None

    def shares(c, k):
        tot = defaultdict(float)
        for v in k:
            tot[c[v]] += k[v]
        return tot

    while True:
        k = defaultdict(float)
        for (a, _), w in links.items():
            k[a] += w

        def quality(c):
            inside = sum(w for (a, b), w in links.items() if c[a] == c[b])
            return inside / m2 - resolution * sum((t / m2) ** 2 for t in shares(c, k).values())

        c = {v: v for v in k}
        at, turn = quality(c), 0
        while True:
            moved = dict(c)
            for half in (0, 1):
                now, tot = dict(moved), shares(moved, k)
                for v in (v for v in k if halves[v, turn] == half):
                    w = defaultdict(float, {now[v]: 0.0})
                    for (a, b), x in links.items():
                        if a == v != b:
                            w[now[b]] += x
                    gain = {o: round(w[o] - resolution * k[v] * (tot[o] - (k[v] if o == now[v] else 0.0)) / m2, 9) for o in w}
                    best = max(w, key=lambda o: (gain[o], -o))
                    if gain[best] > gain[now[v]]:
                        moved[v] = best
            new = quality(moved)
            c = moved if new > at else c
            if new < at + least_gain:
                break
            at, turn = new, turn + 1
        if reached is not None and at < reached + least_gain:
            return assigned
        reached = at
        assigned = {v: c.get(g, g) for v, g in assigned.items()}
        merged = defaultdict(float)
        for (a, b), w in links.items():
            merged[c[a], c[b]] += w
        links = merged


def test_communities_follow_the_rule_and_leave_one_table(spark):
    rnd = random.Random(11)
    # Two crowds with a hub each, a few links between them, a pair apart and a vertex without edges.
    pairs = {(a, b) for n in (0, 12) for a in range(n, n + 12) for b in range(a + 1, n + 12) if a == n or rnd.random() < 0.2}
    pairs |= {tuple(sorted(rnd.sample(range(24), 2))) for _ in range(6)} | {(70, 71)}
    edges = [(a, b, float(rnd.randrange(1, 9))) for a, b in sorted(pairs)]
    ids = [*range(24), 70, 71, 80]
    picked = spark.createDataFrame([(v, t) for v in ids for t in range(40)], "id long, turn int").select("id", "turn", F.pmod(F.xxhash64("id", "turn"), F.lit(2)).alias("half"))
    halves = {(r["id"], r["turn"]): r["half"] for r in picked.collect()}
    both = {(x, y): w for a, b, w in edges for x, y in ((a, b), (b, a))}
    vertices, table = spark.createDataFrame([(v,) for v in ids], "id long"), spark.createDataFrame(edges, "src long, dst long, weight double")
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = by_id(g.communities(vertices, table, 1.0, 0.005), "community")
    assert found == plain_communities(both, ids, halves, 1.0, 0.005) and len(set(found.values())) >= 4
    # States and edges of past turns and levels are gone (each turn left two tables before).
    assert len(set(os.listdir(folder)) - before) == 1


def shortest_ways(pairs, ids):
    """(distance, number of shortest paths) by (from, to), and betweenness by its definition."""
    out, far = defaultdict(set), {}
    for a, b in pairs:
        out[a].add(b)
    for s in ids:
        level, far[s, s] = {s: 1}, (0, 1)
        while level:
            new = defaultdict(int)
            for v, k in level.items():
                for w in out[v]:
                    if (s, w) not in far:
                        new[w] += k
            depth = far[s, next(iter(level))][0] + 1
            far |= {(s, w): (depth, k) for w, k in new.items()}
            level = new
    score = dict.fromkeys(ids, 0.0)
    for (s, e), (d, k) in far.items():
        for v in ids:
            if v not in (s, e) and (s, v) in far and (v, e) in far and far[s, v][0] + far[v, e][0] == d:
                score[v] += far[s, v][1] * far[v, e][1] / k
    n = len(ids)
    return far, {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


@pytest.fixture(scope="module")
def parted(spark):
    """Directed graph of several parts, with a hub, a loop, repeats and a vertex without edges."""
    rnd = random.Random(8)
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(110)] + [(50, v) for v in range(51, 75)] + [(v, 50) for v in range(51, 75, 2)]
    pairs += [(51, 52), (90, 91), (91, 90), (91, 91), (91, 90)] + [(i, i + 1) for i in range(100, 104)]
    ids = [*range(40), *range(50, 75), 90, 91, *range(100, 105), 500]
    return pairs, ids, spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(v,) for v in ids], "id long")


@pytest.mark.parametrize("held", [g.HELD, 0])
def test_walks_in_tasks_and_by_tables_agree_with_the_definition(spark, parted, held):
    pairs, ids, hops, vertices = parted
    far, between = shortest_ways(pairs, ids)
    assert by_id(g.betweenness(vertices, hops, lanes=10, at_once=80, held=held), "score") == pytest.approx(between)
    dist = {v: [d for (s, e), (d, _) in far.items() if s == v != e] for v in ids}
    close = {v: len(d) / sum(d) * (len(d) / (len(ids) - 1)) if d else 0.0 for v, d in dist.items()}
    assert by_id(g.all_closeness(vertices, hops, words=2, held=held), "closeness") == pytest.approx(close)


def test_small_buffers_give_the_same_walks(parted, monkeypatch):
    """Hubs with more neighbours than a buffer has room for, levels that are sent and levels that are fetched."""
    pairs, ids, _, _ = parted
    edges = sorted({(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in pairs if a != b})
    degree = defaultdict(int, Counter(a for a, _ in edges))
    order = sorted({a for a, _ in edges}, key=lambda v: (-degree[v], v))
    near = [sorted(order.index(b) for a, b in edges if a == v) for v in order]
    net = walks.Net.of(walks.Lists.of(np.array([len(x) for x in near]), np.array(sum(near, []), np.int32)))
    assert net.ins is net.outs and len(set(net.part)) == 4
    far, between = shortest_ways(edges, order)
    n = len(order)
    for words, most, send in ((1, 1, 1), (2, 8, 0), (64, 1 << 17, 1 << 30)):
        monkeypatch.setattr(walks, "WORDS", most)
        monkeypatch.setattr(walks, "EDGES", max(4, most))
        monkeypatch.setattr(walks, "SEND", send)
        r, s = walks.distance_sums(net, np.arange(min(n, 64)), words)
        assert [*r] == [sum(a == order[v] != b and order.index(b) < 64 for a, b in far) for v in range(n)]
        assert [*s] == [sum(d for (a, b), (d, _) in far.items() if a == order[v] and order.index(b) < 64) for v in range(n)]
        found = walks.dependencies(net, np.arange(n)) / ((n - 1) * (n - 2))
        assert [*found] == pytest.approx([between[v] for v in order])


def test_walks_in_tasks_shuffle_no_state(club, monkeypatch):
    """All sources' states were written and shuffled every round."""
    monkeypatch.setattr(g.Rounds, "put", None)
    assert round(by_id(g.all_closeness(club.vertices, club.hops()), "closeness")[0], 4) == 0.5690
    assert round(by_id(g.betweenness(club.vertices, club.hops()), "score")[0], 4) == 0.4376


def test_states_of_walks_by_tables_are_bounded_by_the_graph(spark, monkeypatch):
    """The state grew with sources times vertices."""
    rows, n = [], 70

    class Counted(g.Rounds):
        def put(self, df):
            out = super().put(df)
            rows.append((self.name, out.count()))
            return out

    monkeypatch.setattr(g, "Rounds", Counted)
    vertices = spark.range(n)
    hops = g.both_ways(spark.createDataFrame([(v, v % 3) for v in range(3, n)] + [(0, 1), (1, 2)], "src long, dst long"))
    g.betweenness(vertices, hops, lanes=35, held=0)
    g.all_closeness(vertices, hops, words=1, held=0)
    states = [k for name, k in rows if name.endswith("-round")]
    assert len(states) > 12 and max(states) <= n


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        return {f for d in spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir()).split(",") for f in glob.glob(f"{d}/blockmgr-*/*/shuffle_*.data")}

    before, conf = files(), spark.conf.get(CLEANUP)
    table = settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    left = files() - before
    assert table.count() == 7 and files() - before and not left and spark.conf.get(CLEANUP) == conf


@pytest.mark.parametrize("kind", ["long", "int"])
def test_communities_in_arrays_equal_those_by_tables_and_turns_write_none(spark, monkeypatch, kind):
    """Each half turn wrote a table."""
    rnd = random.Random(4)
    edges = [(a, b, None if rnd.random() < 0.1 else rnd.randrange(-1, 12) / 2) for a, b in (rnd.sample(range(-15, 15), 2) for _ in range(110))]
    edges += [(40, 41, None), (41, 42, None), (40, 42, 0.0), (7, 7, 3.0), (None, 3, 1.0)]
    table = spark.createDataFrame(edges, f"src {kind}, dst {kind}, weight double")
    vertices = spark.createDataFrame([(v,) for v in [*range(-15, 14), 13, 40, 41, 42, 77, None]], f"id {kind}")
    want = Counter(g.communities(vertices, table, 1.0, 0.001, numbered=0).collect())
    puts = []

    class Counted(g.Rounds):
        def put(self, df):
            puts.append(self.name)
            return super().put(df)

    monkeypatch.setattr(g, "Rounds", Counted)
    found = g.communities(vertices, table, 1.0, 0.001)
    assert found.schema["community"].dataType == found.schema["id"].dataType
    assert Counter(found.collect()) == want and len({c for _, c in want}) >= 5
    assert set(puts) == {"community-edges", "community-blocks", "community-groups"} and len(puts) <= 9


def test_halves_and_rounding_are_those_of_spark(spark):
    rnd = random.Random(6)
    ids = np.array([rnd.randrange(-(2**31), 2**31) for _ in range(300)])
    rows = spark.createDataFrame([(int(v), int(v)) for v in ids], "wide long, narrow int")
    turn = F.lit(7).cast("int")
    half = rows.select(F.pmod(F.xxhash64("wide", turn), F.lit(2)), F.pmod(F.xxhash64("narrow", turn), F.lit(2))).collect()
    assert [tuple(r) for r in half] == [*zip(moves.halves(ids, True, 7), moves.halves(ids, False, 7))]
    x = [rnd.uniform(-1, 1) * 10.0 ** rnd.randrange(-12, 13) for _ in range(3000)]
    x += [round(rnd.uniform(-50, 50), 8) + s * 5e-10 for _ in range(1000) for s in (-1, 1)] + [rnd.randrange(1 << 40) / 2**20 for _ in range(500)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select(F.round("x", 9)).collect()]
    assert [*moves.rounded(np.array(x))] == want


@pytest.fixture(scope="module")
def random_graph():
    rnd = random.Random(5)
    pairs = {(rnd.randrange(30), rnd.randrange(30)) for _ in range(55)}
    return sorted((a, b) for a, b in pairs if a != b)


def reach(pairs, n):
    out = {v: {v} for v in range(n)}
    for _ in range(n):
        for a, b in pairs:
            for v in out:
                if a in out[v]:
                    out[v].add(b)
    return out


def test_strongly_connected(spark, random_graph):
    edges = spark.createDataFrame(random_graph, "src long, dst long")
    r = reach(random_graph, 30)
    want = {v: min(u for u in r[v] if v in r[u]) for v in range(30)}
    assert by_id(g.strongly_connected(spark.range(30), edges), "component") == want


def test_directed_triangles(spark, random_graph):
    extra = random_graph + [(29, 0), (0, 28), (28, 29), (5, 6), (6, 7), (7, 5)]
    pairs = set(extra)
    want = {
        (a, b, c)
        for a, b, c in itertools.permutations(range(30), 3)
        if a < b and a < c and {(a, b), (b, c), (c, a)} <= pairs
    }
    got = g.directed_triangles(spark.createDataFrame(sorted(pairs), "src long, dst long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_spanning_forest_weight(spark):
    rnd = random.Random(9)
    pairs = {}
    for _ in range(80):
        a, b = rnd.sample(range(25), 2)
        pairs[min(a, b), max(a, b)] = float(rnd.randrange(1, 20))
    rows = [(a, b, w) for (a, b), w in pairs.items()]
    parent = list(range(25))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = 0.0
    for a, b, w in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want += w
    got = g.spanning_forest(spark.range(25), spark.createDataFrame(rows, "src long, dst long, weight double"))
    assert got.agg(F.sum("weight")).first()[0] == want


def test_weighted_distances(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(20), rnd.randrange(20), float(rnd.randrange(1, 9))) for _ in range(60)]
    dist = {0: 0.0}
    for _ in range(20):
        for a, b, w in rows:
            if a in dist and dist[a] + w < dist.get(b, 1e9):
                dist[b] = dist[a] + w
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    assert by_id(g.distances(edges, 0), "distance") == dist


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch, tmp_path):
    puts = []

    class Counted(g.Rounds):
        def put(self, df):
            puts.append(self.name)
            return super().put(df)

    monkeypatch.setattr(g, "Rounds", Counted)
    ids = list(range(4096))
    random.Random(5).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long").coalesce(4)
    labels = by_id(g.connected_components(spark.range(4097), edges), "component")
    assert set(labels[i] for i in range(4096)) == {0} and labels[4096] == 4096
    assert len(puts) <= 24


def test_only_the_last_round_is_kept(spark):
    import os

    from lakeops.session import Rounds, shared_dir

    rounds = Rounds(spark, "kept-test")
    for i in range(3):
        df = rounds.put(spark.range(i + 1))
    folder = shared_dir(spark).removeprefix("file:")
    assert df.count() == 3 and sum(n.startswith("kept-test-") for n in os.listdir(folder)) == 1


def test_similarity_by_lists_and_by_looking_up_hubs(spark, random_graph):
    pairs = [(a, b) for a, b in itertools.combinations(range(30), 2)] + [(0, 999), (None, 1)]
    rnd = random.Random(5)
    edges = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(120)]
    near = {v: {b for a, b in edges if a == v} | {a for a, b in edges if b == v} for v in range(30)}
    for v in near:
        near[v].discard(v)
    df = spark.createDataFrame(edges, "src long, dst long")
    for most in (0, 7, 8192):
        found = g.pair_similarity(df, spark.createDataFrame(pairs, "a long, b long"), listed=most).collect()
        assert len(found) == len(pairs)
        for r in found:
            x, y = near.get(r["a"], set()), near.get(r["b"], set())
            assert r["common"] == len(x & y) and r["similarity"] == pytest.approx(len(x & y) / len(x | y) if x | y else 0.0)


@pytest.mark.parametrize("most", [5, 8192])
def test_similarity_in_slices_keeps_one_slice_on_its_way(spark, random_graph, monkeypatch, most):
    """All pairs' lists were shuffled at once."""
    written = []
    monkeypatch.setattr(g, "settle", lambda df, name="settled": (written.append(name), settle(df, name))[1])
    pairs = [(a, b) for a, b in itertools.combinations(range(30), 2)] + [(0, 999), (None, 1), (3, None), (4, 4)]
    df, wanted = spark.createDataFrame(random_graph, "src long, dst long"), spark.createDataFrame(pairs, "a long, b long")
    whole = Counter(g.pair_similarity(df, wanted, listed=most).collect())
    assert "similar" not in written and len(whole) == len(pairs)
    load = sum(min(sum(v in e for e in {frozenset(e) for e in random_graph}) for v in p) for p in pairs)
    found = g.pair_similarity(df, wanted, listed=most, carried=-(-load // 3))
    assert Counter(found.collect()) == whole and 3 <= written.count("similar") <= 15


def test_landmarks_share_a_row_of_bits(spark, monkeypatch):
    rnd = random.Random(3)
    edges = sorted({tuple(sorted(rnd.sample(range(60), 2))) for _ in range(90)})
    hops = g.both_ways(spark.createDataFrame(edges, "src long, dst long"))
    marks = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "source long")
    far = g.bfs(hops, marks).where("depth > 0").groupBy("id").agg(F.count("*").alias("r"), F.sum("depth").alias("s")).collect()
    want = {x["id"]: x["r"] / x["s"] * min(1.0, x["r"] * 60 / 20 / 59) for x in far}
    monkeypatch.setattr(g, "bfs", None)  # no row per vertex and landmark
    got = {x["id"]: x["closeness"] for x in g.closeness_by_landmarks(hops, marks, 60).collect()}
    assert got == pytest.approx(want)


def test_triangles_of_a_random_graph_ship_shortened_lists(spark):
    rnd = random.Random(9)
    edges = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(300)}
    both = {(a, b) for a, b in edges if a != b} | {(b, a) for a, b in edges if a != b}
    want = {frozenset(t) for t in itertools.combinations(range(40), 3) if all(p in both for p in itertools.combinations(t, 2))}
    df = g.triangles(spark.createDataFrame(sorted(edges), "src long, dst long"))
    assert "slice(" in df._jdf.queryExecution().analyzed().toString()
    got = [frozenset((r["u"], r["v"], r["w"])) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want
