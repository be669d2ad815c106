"""Graph jobs over two DataFrames: vertices (id, ...) and edges (src, dst, weight, ...).

Every round is a join of a small state table with the edges and an aggregate with
map-side combine, so a hub vertex is one aggregated row per task, and its edges are the
skewed side of a join that AQE may split.  The state is cut from its lineage each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.operators import moves, walks
from lakeops.operators.ordered import default_slices, rank_columns, row_numbers
from lakeops.session import Rounds, cut_lineage, settle, shuffle_tasks


@dataclass(frozen=True)
class Graph:
    """A property graph: a vertex table with ``id`` and an edge table with ``src`` and ``dst``."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    def hops(self) -> DataFrame:
        """Edges in the directions they may be walked."""
        return self.edges if self.directed else both_ways(self.edges)

    def triples(self, edges: DataFrame | None = None) -> DataFrame:
        """(a)-[r]->(b): edge columns with both ends' properties as structs ``a`` and ``b``."""
        v = F.struct(*self.vertices.columns)
        a = self.vertices.select(F.col("id").alias("src"), v.alias("a"))
        b = self.vertices.select(F.col("id").alias("dst"), v.alias("b"))
        return (self.hops() if edges is None else edges).join(a, "src").join(b, "dst")

    def without_out(self) -> DataFrame:
        return self.vertices.join(self.edges, F.col("id") == F.col("src"), "left_anti")

    def without_in(self) -> DataFrame:
        return self.vertices.join(self.edges, F.col("id") == F.col("dst"), "left_anti")


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected view: each edge and its reverse, without loops or repeats of a pair."""
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *cols)
    if "weight" in cols:
        pairs = pairs.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    else:
        pairs = pairs.select("src", "dst").distinct()
    rest = [c for c in pairs.columns if c not in ("src", "dst")]
    ends = F.array(
        F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    return pairs.select(F.explode(ends).alias("e"), *rest).select("e.src", "e.dst", *rest)


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """In, out and total degree of every vertex, zero included."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    ins = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    all_ = vertices.select("id").join(out, "id", "left").join(ins, "id", "left").fillna(0, ["out_degree", "in_degree"])
    return all_.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def count_paths(vertices: DataFrame, steps: Sequence[DataFrame], label: str) -> DataFrame:
    """How many paths along the given edge tables lead from one vertex label to another.

    Counts per (start label, vertex) are carried along, so paths are never listed.
    """
    labels = vertices.select("id", F.col(label).alias("_l"))
    state = labels.select("id", F.col("_l").alias("start_label"), F.lit(1).cast("long").alias("n"))
    for edges in steps:
        state = (
            state.join(edges.select("src", "dst"), F.col("id") == F.col("src"))
            .groupBy("start_label", F.col("dst").alias("id"))
            .agg(F.sum("n").alias("n"))
        )
    return (
        state.join(labels, "id").groupBy("start_label", F.col("_l").alias("end_label")).agg(F.sum("n").alias("n_paths"))
    )


def _ranked(edges: DataFrame) -> DataFrame:
    """(src, dst, d): undirected pairs oriented from the lower to the higher (degree, id), with the degree of ``dst``.

    No vertex keeps more than sqrt(2 * edges) outgoing pairs, whatever its degree.
    """
    plain = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = plain.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    da = degree.select(F.col("id").alias("a"), F.col("d").alias("da"))
    db = degree.select(F.col("id").alias("b"), F.col("d").alias("db"))
    full = plain.join(da, "a").join(db, "b")
    low, high = F.struct(F.col("da").alias("d"), F.col("a").alias("id")), F.struct(F.col("db").alias("d"), F.col("b").alias("id"))
    ends = F.struct(F.least(low, high).alias("l"), F.greatest(low, high).alias("h"))
    return full.select(F.inline(F.array(ends))).select(F.col("l.id").alias("src"), F.col("h.id").alias("dst"), F.col("h.d").alias("d"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles (u, v, w), each once, in the order of (degree, id).

    For every oriented pair (u, v) the neighbours of u that rank after v are intersected with the
    out-list of v; a hub has many incoming but few outgoing pairs, so lists stay below sqrt(2 * edges).
    """
    outs = F.array_sort(F.collect_list(F.struct("d", "dst")))["dst"]
    lists = settle(_ranked(edges).groupBy("src").agg(outs.alias("outs")), "oriented")
    each = lists.select(F.col("src").alias("u"), "outs", F.posexplode("outs").alias("i", "v")).where(F.col("i") + 1 < F.size("outs"))
    later = each.select("u", "v", F.slice("outs", F.col("i") + 2, F.size("outs")).alias("later"))
    # Lists of one vertex are alike and shrink in the shuffle; by its size alone tasks would be merged to too few.
    met = later.repartition(shuffle_tasks(edges.sparkSession), "v").join(lists.select(F.col("src").alias("v"), F.col("outs").alias("ov")), "v")
    return met.select("u", "v", F.explode(F.array_intersect("later", "ov")).alias("w"))


def triangle_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    corners = triangles(edges).select(F.explode(F.array("u", "v", "w")).alias("id"))
    per = corners.groupBy("id").agg(F.count("*").alias("triangle_count"))
    return vertices.select("id").join(per, "id", "left").fillna(0, ["triangle_count"])


def directed_triangles(edges: DataFrame) -> DataFrame:
    """Directed 3-cycles a -> b -> c -> a, each once, with ``a`` the smallest id.

    Cycles are looked for at their vertex of lowest degree only.
    """
    plain = settle(edges.where("src <> dst").select("src", "dst").distinct(), "cycle-edges")
    ends = plain.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    a = ends.select(F.col("id").alias("src"), F.struct("d", "id").alias("ra"))
    b = ends.select(F.col("id").alias("dst"), F.struct("d", "id").alias("rb"))
    full = plain.join(a, "src").join(b, "dst")
    into = full.where("rb < ra").select(F.col("src").alias("x"), F.col("dst").alias("p"))
    out = full.where("ra < rb").select(F.col("src").alias("p"), F.col("dst").alias("y"))
    closing = plain.select(F.col("src").alias("y"), F.col("dst").alias("x"))
    found = into.join(out, "p").where("x <> y").join(closing, ["x", "y"], "left_semi")
    # The cycle is p -> y -> x -> p; turn it so that its smallest vertex comes first.
    low = F.least("p", "y", "x")
    turn = (
        F.when(low == F.col("p"), F.array("p", "y", "x")).when(low == F.col("y"), F.array("y", "x", "p")).otherwise(F.array("x", "p", "y"))
    )
    return found.select(turn.alias("c")).select(F.col("c")[0].alias("a"), F.col("c")[1].alias("b"), F.col("c")[2].alias("c"))


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """(id, score); scores sum to 1, the score of vertices without out-edges is spread evenly.

    The edges are dealt by source once and kept, so a round shuffles the shares and what
    comes in, not the edges; a lost executor deals its part anew from the written table.
    """
    spark = edges.sparkSession
    hops = settle(edges.select("src", "dst"), "pagerank-edges")
    out = hops.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outs"))
    base = settle(vertices.select("id").join(out, "id", "left").fillna(0, ["outs"]), "pagerank-vertices")
    n = base.count()
    dealt = hops.repartition("src").persist()
    rounds = Rounds(spark, "pagerank-round")
    state = base.withColumn("score", F.lit(1.0 / n))
    for _ in range(iterations):
        dangling = state.agg(F.coalesce(F.sum(F.when(F.col("outs") == 0, F.col("score"))), F.lit(0.0))).scalar()
        shares = state.where("outs > 0").select(F.col("id").alias("src"), (F.col("score") / F.col("outs")).alias("share"))
        got = dealt.join(shares, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        score = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + dangling / n)
        state = rounds.put(state.join(got, "id", "left").select("id", "outs", score.alias("score")))
    dealt.unpersist()
    return state.select("id", "score")


def ranked_scores(scores: DataFrame, digits: int = 9) -> DataFrame:
    """Scores with a place, highest first; equal rounded scores go by id."""
    rounded = settle(scores.select("id", F.round("score", digits).alias("score")), "scores")
    return row_numbers(rounded, [], ["-score", "id"], "place")


def component_stars(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex that has an edge to another one.

    Large-star and small-star passes: each vertex ties its larger neighbours, then its
    smaller ones, to the smallest vertex it knows, until the edges are stars around the
    smallest id of each component.  The rounds grow with the logarithm of the vertices, and
    of the rounds' tables only the last one is kept.
    """
    high, low = F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")
    state = Rounds(edges.sparkSession, "component-round")
    now = state.put(edges.where("src <> dst").select(high, low).distinct())
    seen = None
    while True:
        marks = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if marks == seen or not marks["n"]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        seen = marks
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ties = F.array(F.struct(F.col("a").alias("a")), F.struct(F.col("b").alias("a")))
        small = large.join(least, "a").select(F.explode(ties).alias("t"), "m").select("t.a", F.col("m").alias("b"))
        now = state.put(small.where("a <> b").distinct())


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of the component; edge direction is ignored."""
    found = component_stars(edges)
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def strongly_connected(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of the strongly connected component.

    Vertices without an in- or out-edge are components of their own.  Of the rest, every vertex gets
    the colour of the vertex that reaches it and comes first in an order by hash, which is another one
    in each turn; of each colour, the vertices that reach back to that first one inside the colour are
    a component, and edges between colours go.  As the first ones are random, a chain falls into parts
    of falling size, and the turns grow with the logarithm of its length, not with its length.  All
    state is in three tables, each replaced by the next one.
    """
    spark = edges.sparkSession
    tables = {name: Rounds(spark, f"scc-{name}") for name in ("state", "edges", "colour")}
    state = tables["state"].put(vertices.select("id", F.lit(None).cast("long").alias("root")))
    hops = tables["edges"].put(edges.where("src <> dst").select("src", "dst").distinct())
    turn = 0
    while not hops.isEmpty():
        # A vertex that lacks edges of one kind is alone; it keeps its own id as root.
        outs = hops.select(F.col("src").alias("id")).distinct()
        live = outs.join(hops.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        place = F.xxhash64("id", F.lit(turn))
        colour = tables["colour"].put(live.select("id", F.struct(place.alias("place"), F.col("id").alias("first")).alias("label"), F.lit(True).alias("moved")))
        while not colour.where("moved").isEmpty():
            told = colour.where("moved").select(F.col("id").alias("src"), "label").join(hops, "src").select(F.col("dst").alias("id"), "label")
            both = colour.select("id", "label", F.lit(True).alias("own")).unionByName(told.withColumn("own", F.lit(False)))
            least = both.groupBy("id").agg(F.min("label").alias("label"), F.min(F.when(F.col("own"), F.col("label"))).alias("old")).where("old IS NOT NULL")
            colour = tables["colour"].put(least.select("id", "label", (F.col("label") < F.col("old")).alias("moved")))
        a = colour.select(F.col("id").alias("src"), F.col("label.first").alias("la"))
        b = colour.select(F.col("id").alias("dst"), F.col("label.first").alias("lb"))
        hops = tables["edges"].put(hops.join(a, "src").join(b, "dst").where("la = lb").select("src", "dst"))
        # Backwards from the first one of each colour; ``far`` is what the last step has found.
        found = tables["colour"].put(colour.select("id", F.col("label.first").alias("first"), (F.col("label.first") == F.col("id")).alias("far"), (F.col("label.first") == F.col("id")).alias("in")))
        while not found.where("far").isEmpty():
            back = found.where("far").select(F.col("id").alias("dst")).join(hops, "dst").select(F.col("src").alias("id")).distinct()
            step = found.join(back.withColumn("met", F.lit(True)), "id", "left")
            fresh = F.col("met").isNotNull() & ~F.col("in")
            found = tables["colour"].put(step.select("id", "first", fresh.alias("far"), (F.col("in") | fresh).alias("in")))
        done = found.where("in").select("id", "first")
        state = tables["state"].put(state.join(done, "id", "left").select("id", F.coalesce("root", "first").alias("root")))
        ends = done.select("id")
        open_ = hops.join(ends.withColumnRenamed("id", "src"), "src", "left_anti").join(ends.withColumnRenamed("id", "dst"), "dst", "left_anti")
        hops = tables["edges"].put(open_)
        turn += 1
    for name in ("edges", "colour"):
        tables[name].drop()
    rooted = state.select("id", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    return rooted.join(least, "root").select("id", "component")


def bfs(hops: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(source, id, depth, parent) from every row of ``sources`` (one column ``source``).

    The parent is the smallest id one step nearer; a source has none.  The state is one table,
    written anew each round; the vertices of the last depth are the frontier.
    """
    hops = settle(hops.where("src <> dst").select("src", "dst"), "bfs-edges")
    start = sources.select("source", F.col("source").alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"))
    rounds, depth = Rounds(hops.sparkSession, "bfs-round"), 0
    state = rounds.put(start)
    while max_depth is None or depth < max_depth:
        step = state.where(F.col("depth") == depth).select("source", F.col("id").alias("src")).join(hops, "src")
        depth += 1
        reached = step.groupBy("source", F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        fresh = reached.join(state.select("source", "id"), ["source", "id"], "left_anti")
        state = rounds.put(state.unionByName(fresh.select("source", "id", F.lit(depth).alias("depth"), "parent")))
        if state.where(F.col("depth") == depth).isEmpty():
            break
    return state


def distances(hops: DataFrame, source: int) -> DataFrame:
    """(id, distance) by total weight from one source; only improved vertices go on."""
    hops = settle(hops.select("src", "dst", "weight"), "path-edges")
    best = hops.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(0.0).alias("distance"))
    frontier, rounds = best, Rounds(hops.sparkSession, "path-round")
    while True:
        step = frontier.select(F.col("id").alias("src"), "distance").join(hops, "src")
        offers = step.groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("offer"))
        merged = best.join(offers, "id", "full")
        better = F.col("distance").isNull() | (F.col("offer") < F.col("distance"))
        state = rounds.put(
            merged.select("id", F.when(better, F.col("offer")).otherwise(F.col("distance")).alias("distance"), better.alias("better"))
        )
        frontier = state.where("better").select("id", "distance")
        best = state.select("id", "distance")
        if frontier.isEmpty():
            return best


def shortest_path(hops: DataFrame, source: int, target: int, best: DataFrame | None = None) -> DataFrame:
    """(step, id, distance) along one shortest path; among equals the smallest parent.  Weights are positive.

    The way back is marked by pointer doubling: a table of jumps by 1, 2, 4, .. steps towards the
    source for all vertices, then from the target by each of them, the widest first.  Rounds grow
    with the logarithm of the path's steps, and no vertex comes to the driver.  ``best`` may hand
    over known distances from the source.
    """
    best = distances(hops, source) if best is None else best
    a = best.select(F.col("id").alias("src"), F.col("distance").alias("da"))
    b = best.select(F.col("id").alias("dst"), F.col("distance").alias("db"))
    tight = hops.join(a, "src").join(b, "dst").where(((F.col("da") + F.col("weight")) == F.col("db")) & (F.col("da") < F.col("db")))
    jump = settle(tight.groupBy(F.col("dst").alias("id")).agg(F.min_by("src", F.struct("da", "src")).alias("to")), "path-jumps")
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        jump = settle(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("on")), "to").select("id", F.col("on").alias("to")), "path-jumps")
    marked = hops.sparkSession.range(1).select(F.lit(target).cast("long").alias("id"), F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(jumps))):
        moved = marked.join(jumps[k], "id").select(F.col("to").alias("id"), (F.col("back") + 2**k).alias("back"))
        marked = settle(marked.unionByName(moved), "path-marks")
    steps = marked.where(F.col("id") == source).agg(F.max("back").alias("steps"))
    known = marked.join(best, "id").join(F.broadcast(steps), F.col("back") <= F.col("steps"))  # one row
    return known.select((F.col("steps") - F.col("back")).cast("int").alias("step"), "id", "distance")


def closeness(hops: DataFrame, sources: DataFrame, n_vertices: int) -> DataFrame:
    """Closeness of the given vertices: (reached / sum of distances) * (reached / (n - 1))."""
    far = bfs(hops, sources).where("depth > 0").groupBy("source").agg(F.count("*").alias("r"), F.sum("depth").alias("s"))
    r = F.col("r").cast("double")
    return far.select(F.col("source").alias("id"), (r / F.col("s") * (r / (n_vertices - 1))).alias("closeness"))


def hash_sample(vertices: DataFrame, k: int) -> DataFrame:
    """``k`` vertices by the order of the md5 of their id, as ``source``: a repeatable random sample."""
    return vertices.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(k).select(F.col("id").alias("source"))


def closeness_by_landmarks(hops: DataFrame, landmarks: DataFrame, n_vertices: int) -> DataFrame:
    """Closeness of every vertex, estimated from its distances to a random sample of landmarks.

    Undirected ``hops``.  Work is linear in the edges for each landmark, while the exact
    form of all vertices is O(vertices * edges).  64 landmarks share a row of the state.
    """
    landmarks = settle(landmarks, "landmarks")
    k = landmarks.count()
    found = sums_of_distances(landmarks, hops.select(F.col("src").alias("id"), F.col("dst").alias("to")), max(1, min(8, -(-k // 64))))
    r = F.col("r")
    return found.select("id", (r / F.col("s") * F.least(F.lit(1.0), r * n_vertices / k / (n_vertices - 1))).alias("closeness"))


def numbered_sources(sources: DataFrame, width: int) -> DataFrame:
    """(source, batch, lane): sources dealt to batches of ``width``."""
    numbered = row_numbers(sources.select("source").distinct(), [], ["source"], "_rn")
    at = F.col("_rn") - 1
    return settle(numbered.select("source", F.floor(at / width).alias("batch"), (at % width).cast("int").alias("lane")), "sources")


#: Most edges of a graph that is handed to every task, as neighbour lists of 4 bytes an edge; larger graphs stay tables.
HELD = 1 << 24

#: A loop's state has at most one row for so many edges, beyond the rows of one batch of sources.
EDGES_A_ROW = 32


def held_net(hops: DataFrame) -> tuple[DataFrame, walks.Net]:
    """(id, no) of the vertices with edges, numbered from 0 by falling degree, and their lists of neighbours."""
    degree = hops.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    numbers = settle(row_numbers(degree, [], ["-d", "id"], "_rn").select("id", (F.col("_rn") - 1).cast("int").alias("no")), "numbers")
    ends = hops.join(numbers.select(F.col("id").alias("src"), F.col("no").alias("u")), "src").join(numbers.select(F.col("id").alias("dst"), F.col("no").alias("v")), "dst")
    lists = ends.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("to")).orderBy("u").toArrow()
    sizes = np.zeros(numbers.count(), np.int64)
    for u, to in zip(lists["u"].chunks, lists["to"].chunks):
        sizes[u.to_numpy()] = to.value_lengths().to_numpy()
    flat = [to.flatten().to_numpy() for to in lists["to"].chunks]
    return numbers, walks.Net.of(walks.Lists.of(sizes, np.concatenate([np.zeros(0, np.int32), *flat])))


def walk_in_tasks(numbers: DataFrame, net: walks.Net, lots: list[np.ndarray], walk: Callable[..., Sequence[np.ndarray]], names: Sequence[str], kind: str) -> DataFrame:
    """(id, ``names``): sums over all ``lots`` of sources of what ``walk(net, lot)`` gives for each vertex.

    Each lot is a task's work; the lists are sent to every executor once.
    """
    spark = numbers.sparkSession
    sent = spark.sparkContext.broadcast((net, lots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, all_lots = sent.value
        for lot in (i for batch in batches for i in batch.column(0).to_pylist()):
            columns = walk(held, all_lots[lot])
            rows = np.flatnonzero(columns[0])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows.astype(np.int32), *(c[rows] for c in columns))], names=["no", *names])

    found = spark.range(0, len(lots), 1, max(1, len(lots))).mapInArrow(run, ", ".join(["no int", *(f"{x} {kind}" for x in names)]))
    sums = settle(found.groupBy("no").agg(*[F.sum(x).alias(x) for x in names]).join(numbers, "no").select("id", *names), "walked")
    sent.destroy()
    return sums


def by_part(numbers: DataFrame, net: walks.Net, vertices: DataFrame) -> np.ndarray:
    """Numbers of the ``vertices`` with edges, those that hang together side by side."""
    rows = numbers.join(vertices.select("id"), "id", "left_semi").select("no").toArrow()["no"].to_numpy()
    return rows[np.lexsort((rows, net.part[rows]))]


def sums_of_distances(sources: DataFrame, steps: DataFrame, words: int, at_once: int | None = None) -> DataFrame:
    """(id, r, s): from how many other ``sources`` a vertex is reached over ``steps`` (id, to), and the sum of their distances.

    Breadth-first search from all sources at once, 64 of them in the bits of a word and ``words``
    words in a row: the state has one row per vertex and batch of 64 * ``words`` sources, with the
    sources that have been seen there and those new in the last round.  A round moves the new bits
    over the steps and puts them together by ``bit_or`` before they meet the state, and adds the
    number of bits that are new, times the depth, to the vertex's sum.  ``at_once`` batches are worked
    on together, by default as many as keep the state small beside the edges.
    """
    steps = settle(steps.where("id <> to").select("id", "to").distinct(), "closeness-edges")
    seen, new, got = ([f"{x}{w}" for w in range(words)] for x in ("seen", "new", "got"))
    none = F.lit(0).cast("long")
    at = numbered_sources(sources, 64 * words)
    k = at.count()
    at_once = at_once or max(1, steps.count() // (EDGES_A_ROW * max(1, k)))
    bit = F.expr("shiftleft(1L, lane % 64)")
    own = [F.when(F.expr(f"lane DIV 64 = {w}"), bit).otherwise(none) for w in range(words)]
    first = [F.bit_or(c).alias(x) for x, c in zip(seen, own)]
    rounds, total = Rounds(steps.sparkSession, "closeness-round"), Rounds(steps.sparkSession, "closeness-total")
    sums = None
    for batch in range(0, max(1, -(-k // (64 * words))), at_once):
        depth, some = 0, at.where((F.col("batch") >= batch) & (F.col("batch") < batch + at_once))
        start = some.groupBy("batch", F.col("source").alias("id")).agg(*first)
        state = rounds.put(start.select("batch", "id", *seen, *[F.col(x).alias(y) for x, y in zip(seen, new)], none.alias("reached"), none.alias("total")))
        while True:
            depth += 1
            moving = state.where(" OR ".join(f"{x} <> 0" for x in new)).select("batch", "id", *[F.col(x).alias(y) for x, y in zip(new, got)])
            came = moving.join(steps, "id").groupBy("batch", F.col("to").alias("id")).agg(*[F.bit_or(x).alias(x) for x in got])
            met = state.drop(*new).join(came, ["batch", "id"], "full").fillna(0, [*seen, *got, "reached", "total"])
            fresh = [F.col(x).bitwiseAND(F.bitwise_not(F.col(y))) for x, y in zip(got, seen)]
            met = met.select("batch", "id", *[F.col(x).bitwiseOR(F.col(y)).alias(y) for x, y in zip(got, seen)], *[f.alias(x) for f, x in zip(fresh, new)], "reached", "total")
            count = reduce(lambda x, y: x + y, [F.bit_count(x) for x in new]).cast("long")
            state = rounds.put(met.withColumns({"reached": F.col("reached") + count, "total": F.col("total") + count * depth}))
            if state.where(" OR ".join(f"{x} <> 0" for x in new)).isEmpty():
                break
        part = state.groupBy("id").agg(F.sum("reached").alias("r"), F.sum("total").alias("s")).where("r > 0")
        sums = total.put(part if sums is None else sums.unionByName(part).groupBy("id").agg(F.sum("r").alias("r"), F.sum("s").alias("s")))
    rounds.drop()
    return sums.select("id", F.col("r").cast("double").alias("r"), F.col("s").cast("double").alias("s"))


def all_closeness(vertices: DataFrame, hops: DataFrame, words: int = 8, held: int = HELD) -> DataFrame:
    """(id, closeness) of every vertex, from its exact distances: (reached / sum) * (reached / (n - 1)).

    Bits go against the edges, so they count the ways from the vertex.  Vertices that reach no
    other have closeness 0.  A graph of up to ``held`` edges is walked inside of tasks, each for
    some of the vertices, so no state is shuffled; a larger one by tables.
    """
    n = vertices.count()
    hops = settle(hops.where("src <> dst").select("src", "dst").distinct(), "closeness-hops")
    if 0 < hops.count() <= held:
        numbers, net = held_net(hops)
        picked = by_part(numbers, net, vertices)
        width = 64 * walks.words_for(net.outs.n, len(picked), 4 * hops.sparkSession.sparkContext.defaultParallelism)
        lots = [picked[i : i + width] for i in range(0, len(picked), width)]
        sums = walk_in_tasks(numbers, net, lots, lambda net, lot: walks.distance_sums(net, lot, width // 64), ["r", "s"], "long")
    else:
        sums = sums_of_distances(vertices.select(F.col("id").alias("source")), hops.select(F.col("dst").alias("id"), F.col("src").alias("to")), words)
    r = F.col("r").cast("double")
    found = vertices.select("id").join(sums, "id", "left")
    return found.select("id", F.coalesce(r / F.col("s") * (r / (n - 1)), F.lit(0.0)).alias("closeness"))


def betweenness(vertices: DataFrame, hops: DataFrame, sources: DataFrame | None = None, lanes: int = 8, at_once: int | None = None, held: int = HELD) -> DataFrame:
    """Normalised betweenness: shortest-path counts forward, dependencies backward.

    Of every vertex, in a graph of up to ``held`` edges: each task has the graph as lists and walks
    from some of the vertices, so nothing but sums per vertex is shuffled.

    Else by tables: a row of the state is a vertex and a batch of ``lanes`` sources, each with its depth, number of
    shortest paths and dependency; a round is one join with the edges and one aggregate for all of
    them.  The state is one table that each round replaces, so no level is kept; ``at_once`` sources
    are worked on together, which bounds it (by default as many as keep it small beside the edges).  With
    ``sources`` (a sample) the sum is scaled up to all vertices.
    """
    spark = hops.sparkSession
    n = vertices.count()
    hops = settle(hops.where("src <> dst").select("src", "dst").distinct(), "between-edges")
    zero = F.lit(0.0)
    if sources is None and 0 < hops.count() <= held:
        numbers, net = held_net(hops)
        picked = by_part(numbers, net, vertices)
        tasks = min(len(picked), max(shuffle_tasks(spark), 8 * spark.sparkContext.defaultParallelism))
        lots = [picked[i::tasks] for i in range(tasks)]
        sums = walk_in_tasks(numbers, net, lots, lambda net, lot: [walks.dependencies(net, lot)], ["dep"], "double")
        k = vertices.select("id").distinct().count()
    else:
        sums, k = betweenness_by_tables(vertices, hops, vertices.select(F.col("id").alias("source")) if sources is None else sources, lanes, at_once)
    # Undirected runs count every pair from both ends; (n-1)(n-2) ordered pairs normalise both cases.
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 and k else 0.0
    return vertices.select("id").join(sums, "id", "left").select("id", (F.coalesce("dep", zero) * scale).alias("score"))


def betweenness_by_tables(vertices: DataFrame, hops: DataFrame, sources: DataFrame, lanes: int, at_once: int | None) -> tuple[DataFrame, int]:
    """(id, dep) and the number of sources."""
    at = numbered_sources(sources, lanes)
    k = at.count()
    at_once = at_once or lanes * max(1, hops.count() // (EDGES_A_ROW * max(1, k)))
    lane = range(lanes)
    d, p, g, dep = ([f"{c}{j}" for j in lane] for c in ("d", "p", "g", "dep"))
    zero = F.lit(0.0)
    total, rounds = Rounds(hops.sparkSession, "between-total"), Rounds(hops.sparkSession, "between-round")
    sums = total.put(vertices.select("id", zero.alias("dep")))

    def at_depth(depth: int) -> str:
        return " OR ".join(f"{x} = {depth}" for x in d)

    def moved(state: DataFrame, sent: DataFrame) -> DataFrame:
        """The state with ``g``, the sums of what the edges have brought."""
        # Summed up before they meet the state, so that the wide rows are not aggregated.
        came = sent.groupBy("batch", "id").agg(*[F.sum(x).alias(x) for x in g])
        return state.join(came, ["batch", "id"], "full").fillna(0.0, [*p, *dep, *g])

    for first in range(0, -(-k // lanes), max(1, at_once // lanes)):
        own = at.where((F.col("batch") >= first) & (F.col("batch") < first + max(1, at_once // lanes)))
        start = [F.when(F.col("lane") == j, 0).cast("int").alias(d[j]) for j in lane] + [F.when(F.col("lane") == j, 1.0).otherwise(0.0).alias(p[j]) for j in lane]
        state = rounds.put(own.select("batch", F.col("source").alias("id"), *start, *[zero.alias(x) for x in dep]))
        depth = 0
        while not state.where(at_depth(depth)).isEmpty():
            out = state.where(at_depth(depth)).select("batch", F.col("id").alias("src"), *[F.when(F.col(x) == depth, F.col(y)).otherwise(zero).alias(z) for x, y, z in zip(d, p, g)])
            met = moved(state, out.join(hops, "src").withColumnRenamed("dst", "id"))
            fresh = [F.col(x).isNull() & (F.col(z) > 0) for x, z in zip(d, g)]
            depth += 1
            state = rounds.put(
                met.select("batch", "id", *[F.when(f, depth).otherwise(F.col(x)).alias(x) for f, x in zip(fresh, d)], *[F.when(f, F.col(z)).otherwise(F.col(y)).alias(y) for f, y, z in zip(fresh, p, g)], *dep)
            )
        for level in range(depth - 1, 0, -1):
            out = state.where(at_depth(level)).select("batch", F.col("id").alias("dst"), *[F.when(F.col(x) == level, (1 + F.col(w)) / F.col(y)).otherwise(zero).alias(z) for x, y, w, z in zip(d, p, dep, g)])
            met = moved(state, out.join(hops, "dst").withColumnRenamed("src", "id"))
            gain = [F.when(F.col(x) == level - 1, F.col(y) * F.col(z)).otherwise(F.col(w)).alias(w) for x, y, w, z in zip(d, p, dep, g)]
            state = rounds.put(met.select("batch", "id", *d, *p, *gain))
        part = reduce(lambda x, y: x + y, [F.when(F.col(x) > 0, F.col(w)).otherwise(zero) for x, w in zip(d, dep)])
        sums = total.put(sums.unionByName(state.select("id", part.alias("dep"))).groupBy("id").agg(F.sum("dep").alias("dep")))
    rounds.drop()
    return sums, k


def spanning_forest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Minimum spanning forest (src < dst, weight); ties go to the smaller pair.

    Each round every component takes its lightest outgoing edge, and the components so
    joined become one.
    """
    pairs = both_ways(edges.select("src", "dst", "weight")).where("src < dst")
    live = cut_lineage(pairs.select("src", "dst", "weight", F.col("src").alias("ca"), F.col("dst").alias("cb")))
    chosen: list[DataFrame] = []
    while not live.isEmpty():
        row = F.struct("weight", "src", "dst", "ca", "cb")
        per = live.select(F.explode(F.array("ca", "cb")).alias("c"), row.alias("e")).groupBy("c").agg(F.min("e").alias("e"))
        other = F.when(F.col("e.ca") == F.col("c"), F.col("e.cb")).otherwise(F.col("e.ca"))
        picks = cut_lineage(per.select("c", "e", other.alias("to")))
        chosen.append(picks.select("e.src", "e.dst", "e.weight"))
        # Components point along their edge.  The order of edges is total, so the only loops
        # are pairs that chose the same edge; the smaller one becomes the root.
        back = picks.select(F.col("c").alias("to"), F.col("to").alias("back"))
        root = (F.col("back") == F.col("c")) & (F.col("c") < F.col("to"))
        tops = cut_lineage(picks.join(back, "to").select("c", F.when(root, F.col("c")).otherwise(F.col("to")).alias("to")))
        while True:
            jump = tops.select(F.col("c").alias("to"), F.col("to").alias("top"))
            new = cut_lineage(tops.join(jump, "to").select("c", F.col("to").alias("old"), F.col("top").alias("to")))
            tops = new.select("c", "to")
            if new.where("old <> to").isEmpty():
                break
        a = tops.select(F.col("c").alias("ca"), F.col("to").alias("na"))
        b = tops.select(F.col("c").alias("cb"), F.col("to").alias("nb"))
        moved = live.join(a, "ca").join(b, "cb").where("na <> nb")
        live = cut_lineage(moved.select("src", "dst", "weight", F.col("na").alias("ca"), F.col("nb").alias("cb")))
    if not chosen:
        return pairs
    return reduce(lambda x, y: x.unionByName(y), chosen).distinct()


#: Most neighbours of a vertex that are kept in one list.
LISTED = 1 << 13


#: Neighbours of low ends that are carried to the other ends at a time, at least; also so many times the edges.
CARRIED, CARRIED_EDGES = 1 << 26, 2


def pair_similarity(edges: DataFrame, pairs: DataFrame, listed: int = LISTED, carried: int | None = None) -> DataFrame:
    """Jaccard similarity of the neighbour sets of given pairs (a, b).

    The neighbour list of the end with the lower degree goes to the other end's list, as one row per
    pair.  Where the other end is a hub of more than ``listed`` neighbours, they are looked up one by
    one instead, so no list is longer than that and a hub's neighbours are not expanded for its pairs.

    All lists on their way are many times the edges.  So with more than ``carried`` neighbours on their way (by
    default twice the edges) the pairs are worked on in slices, one after the other, and only one slice's shuffle files are on disk.
    """
    spark = edges.sparkSession
    kept = Rounds(spark, "similar-edges")
    both = kept.put(both_ways(edges.select("src", "dst")))
    degree = settle(both.groupBy("src").agg(F.count("*").alias("d")), "similar-degrees")
    da = degree.select(F.col("src").alias("a"), F.col("d").alias("da"))
    db = degree.select(F.col("src").alias("b"), F.col("d").alias("db"))
    sized = settle(pairs.select("a", "b").distinct().join(da, "a", "left").join(db, "b", "left").fillna(0, ["da", "db"]), "similar-pairs")
    small_a = F.col("da") <= F.col("db")
    ends = sized.select("*", F.when(small_a, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(small_a, F.col("b")).otherwise(F.col("a")).alias("hi"))
    # All lists and the hubs' edges are written once, as every slice reads them; the edges themselves go then.
    short = settle(both.join(degree.where(F.col("d") <= listed), "src", "left_semi").groupBy("src").agg(F.collect_list("dst").alias("l")), "similar-lists")
    long_ = settle(both.join(degree.where(F.col("d") > listed), "src", "left_semi").select("src", "dst"), "similar-hubs")
    hub = F.greatest("da", "db") > listed
    # A neighbour that is looked up crosses tasks with its pair, about five times the bytes of one in a list.
    load = F.sum(F.least("da", "db") * F.when(hub, 5).otherwise(1))
    way = sized.agg(load.alias("way"), F.bool_or(hub).alias("hubs")).crossJoin(degree.agg(F.sum("d").alias("edges"))).first()
    kept.drop()
    slices = -(-(way["way"] or 0) // (carried or max(CARRIED, CARRIED_EDGES * (way["edges"] or 0))))
    found = [
        similarity_slice(ends.where(~hub), ends.where(hub) if way["hubs"] else None, short, long_, k, slices) for k in range(max(1, slices))
    ]
    if slices <= 1:
        return found[0]
    return reduce(lambda x, y: x.unionByName(y), [settle(f, "similar") for f in found])


def similarity_slice(lists: DataFrame, hubs: DataFrame | None, short: DataFrame, long_: DataFrame, k: int, slices: int) -> DataFrame:
    """Similarity of the pairs of slice ``k``: those by lists go by their high end, those of hubs by both ends."""

    def in_slice(df: DataFrame, *keys: str) -> DataFrame:
        return df.where(F.pmod(F.xxhash64(*keys), F.lit(slices)) == k) if slices > 1 else df

    lows, highs = short.select(F.col("src").alias("lo"), F.col("l").alias("ll")), in_slice(short, "src").select(F.col("src").alias("hi"), F.col("l").alias("lh"))
    carried = in_slice(lists, "hi").join(lows, "lo", "left").repartition(shuffle_tasks(short.sparkSession), "hi")
    by_list = carried.join(highs, "hi", "left")
    counted = by_list.select("a", "b", "da", "db", F.coalesce(F.size(F.array_intersect("lh", "ll")).cast("long"), F.lit(0)).alias("common"))
    if hubs is not None:
        of_hubs = in_slice(hubs, "a", "b")
        both = long_.unionByName(short.select("src", F.explode("l").alias("dst")))
        looked = of_hubs.select("a", "b", "lo", "hi").join(both.select(F.col("src").alias("lo"), F.col("dst").alias("x")), "lo")
        common = looked.join(long_.select(F.col("src").alias("hi"), F.col("dst").alias("x")), ["hi", "x"], "left_semi")
        counts = common.groupBy("a", "b").agg(F.count("*").alias("common"))
        counted = counted.unionByName(of_hubs.select("a", "b", "da", "db").join(counts, ["a", "b"], "left").fillna(0, ["common"]))
    union = F.col("da") + F.col("db") - F.col("common")
    return counted.select("a", "b", "common", F.when(union > 0, F.col("common") / union).otherwise(0.0).alias("similarity"))


def nearest(edges: DataFrame, node: int, k: int) -> DataFrame:
    """The k vertices most similar to one vertex (Jaccard of neighbour sets).  Work is linear
    in the edges: common neighbours are counted in one pass over the node's neighbours."""
    both = settle(both_ways(edges.select("src", "dst")), "nearest-edges")
    own = both.where(F.col("src") == node).select("dst")
    n = own.count()
    common = both.join(own, "dst", "left_semi").where(F.col("src") != node).groupBy("src").agg(F.count("*").alias("common"))
    degree = both.groupBy("src").agg(F.count("*").alias("d"))
    score = F.col("common") / (F.col("d") + n - F.col("common"))
    found = common.join(degree, "src").select(F.col("src").alias("neighbor_id"), score.alias("similarity"))
    best = found.orderBy(F.col("similarity").desc(), "neighbor_id").limit(k)
    return rank_columns(best, [], ["-similarity", "neighbor_id"], {"rank": "rank"}, slices=8)


def modularity(edges: DataFrame, groups: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(groups, members, modularity) of a partition (id, community) of an undirected graph."""
    hops = both_ways(edges)
    a = groups.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = groups.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    per = (
        hops.join(a, "src")
        .join(b, "dst")
        .groupBy("ca")
        .agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    )
    m2 = hops.agg(F.sum("weight")).scalar()
    q = F.sum(F.col("inside") / m2 - resolution * (F.col("k") / m2) * (F.col("k") / m2))
    sizes = groups.agg(F.countDistinct("community").alias("groups"), F.count("*").alias("members"))
    return sizes.withColumn("modularity", per.agg(q).scalar())


#: Most vertices whose communities are kept in arrays by the driver and sent to every task (12 bytes a vertex in each half turn).
NUMBERED = 1 << 22

#: Edges of one block of neighbour lists, about; a block has whole lists, so a hub may make it larger.
BLOCK = 1 << 20


def communities(vertices: DataFrame, edges: DataFrame, resolution: float = 1.0, least_gain: float = 1e-6, numbered: int = NUMBERED) -> DataFrame:
    """(id, community): local moves that raise modularity, then the same on merged vertices.

    In a round only one half of the vertices, picked by a hash of id and round, may move,
    so two neighbours seldom swap.  Equal gains go to the smaller community id.  Rounds end
    when a full turn (both halves) raises modularity by less than ``least_gain``, and levels
    when merging no longer helps; a turn that lowers it is not taken.

    The edges are dealt to tasks as blocks of neighbour lists.  A half turn is one pass over them: tasks get the
    communities of all vertices as an array and give back who moves.  With more than ``numbered`` vertices
    or ids that are no whole numbers, communities are tables as well.
    """
    spark = vertices.sparkSession
    merging, blocks = Rounds(spark, "community-edges"), Rounds(spark, "community-blocks")
    hops = merging.put(both_ways(edges.select("src", "dst", "weight")))
    m2 = hops.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()["w"]
    if not m2:
        merging.drop()
        return Rounds(spark, "community-groups").put(vertices.select("id", F.col("id").alias("community")))
    kind, ends = vertices.schema["id"].dataType.simpleString(), {hops.schema[x].dataType.simpleString() for x in ("src", "dst")}
    if ends | {kind} not in ({"bigint"}, {"int"}) or hops.select("src").distinct().count() > numbered:
        return communities_by_tables(vertices, merging, hops, m2, resolution, least_gain)
    m2, reached, first, found = float(m2), None, None, None
    while True:
        ids, k, dealt = listed_edges(hops, blocks)
        if first is None:
            first, found = ids, ids
        c, at = settle_down(dealt, ids, k, kind == "bigint", m2, resolution, least_gain)
        if reached is not None and at < reached + least_gain:
            break
        reached = at
        found = ids[c[np.searchsorted(ids, found)]]
        hops = merging.put(merged_edges(dealt, ids, c, hops.schema["src"].dataType.simpleString()))
    for rounds in (merging, blocks):
        rounds.drop()
    of = spark.createDataFrame(pa.table({"id": first, "_c": found})).select(F.col("id").cast(kind).alias("id"), F.col("_c").cast(kind).alias("_c"))
    rows = vertices.select("id").join(of, "id", "left").select("id", F.coalesce("_c", "id").alias("community"))
    return Rounds(spark, "community-groups").put(rows)


def listed_edges(hops: DataFrame, blocks: Rounds) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Sorted ids of the vertices, the sums of their weights, and blocks of their neighbour lists by numbers in that order."""
    spark = hops.sparkSession
    sums = hops.groupBy(F.col("src").cast("long").alias("id")).agg(F.sum(F.col("weight").cast("double")).alias("k")).toArrow()
    ids, k = sums["id"].to_numpy(), sums["k"].to_pandas().to_numpy(np.float64)
    order = np.argsort(ids)
    ids, k = ids[order], k[order]
    sent = spark.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers take half the room of ids, so each batch is turned into them at once.
        found = [(np.searchsorted(sent.value, b.column(0)).astype(np.int32), np.searchsorted(sent.value, b.column(1)).astype(np.int32), b.column(2).to_pandas().to_numpy(np.float64)) for b in batches]
        if found:
            src, to, w = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(src, kind="stable")
            src, to, w = src[order], to[order], w[order]
            rows, sizes = np.unique(src, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (rows, sizes.astype(np.int32), to, w)], names=["rows", "sizes", "to", "weights"])

    parts = max(2 * spark.sparkContext.defaultParallelism, -(-hops.count() // BLOCK))
    lists = hops.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double")).repartition(parts, "src")
    dealt = blocks.put(lists.mapInArrow(run, "rows binary, sizes binary, to binary, weights binary"))
    sent.destroy()
    return ids, k, dealt


def block_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, sizes, to, weights) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in enumerate((np.int32, np.int32, np.int32, np.float64)))


def settle_down(dealt: DataFrame, ids: np.ndarray, k: np.ndarray, wide: bool, m2: float, resolution: float, least_gain: float) -> tuple[np.ndarray, float]:
    """Communities by number after the turns of one level, and the modularity that ended them."""
    context = dealt.sparkSession.sparkContext
    fixed = context.broadcast((ids, k))

    def half_turn(c: np.ndarray, r: int) -> tuple[np.ndarray, float]:
        """The communities after a half turn, and the modularity before it."""
        tot = moves.totals(c, k)
        sent = context.broadcast((c, tot))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (ids, k), (c, tot), weight = fixed.value, sent.value, 0.0
            for rows, sizes, to, weights in block_arrays(batches):
                # Both halves are picked by the hash of the same number, so each vertex has one turn.
                may = moves.halves(ids[rows], wide, r // 2) == r % 2
                weight += moves.inside(rows, sizes, to, weights, c) if r % 2 == 0 else 0.0
                who, where = moves.moves(rows, sizes, to, weights, may, c, k, tot, m2, resolution)
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(where), pa.nulls(len(who), pa.float64())], names=["no", "c", "inside"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([weight])], names=["no", "c", "inside"])

        told = dealt.mapInArrow(run, "no int, c int, inside double").toArrow()
        sent.destroy()
        who, where = told["no"].to_numpy(), told["c"].to_numpy()
        new = c.copy()
        new[who[who >= 0]] = where[who >= 0]
        share = tot / m2
        return new, float(np.nansum(told["inside"].to_pandas())) / m2 - resolution * float(np.nansum(share * share))

    state, turn = np.arange(len(ids), dtype=np.int32), 0
    first, at = half_turn(state, 0)
    while True:
        moved, _ = half_turn(first, 2 * turn + 1)
        # The pass that tells how good the turn was also makes the next one's first half.
        first, now = half_turn(moved, 2 * turn + 2)
        if now > at:
            state = moved
        if now < at + least_gain:
            fixed.destroy()
            return state, at
        at, turn = now, turn + 1


def merged_edges(dealt: DataFrame, ids: np.ndarray, c: np.ndarray, kind: str) -> DataFrame:
    """Edges between communities, those inside of one as a loop."""
    sent = dealt.sparkSession.sparkContext.broadcast((ids, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = sent.value
        for block in block_arrays(batches):
            a, b, w = moves.between(*block, c)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(w, from_pandas=True)], names=["src", "dst", "weight"])

    found = dealt.mapInArrow(run, "src long, dst long, weight double").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return found.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), "weight")


def communities_by_tables(vertices: DataFrame, merging: Rounds, hops: DataFrame, m2: float, resolution: float, least_gain: float) -> DataFrame:
    """The same where the communities of the vertices do not fit into a task.

    Only edges of the half that may move are walked.  They lie in ranges of their start, so that
    its links to one community are mostly summed before they cross tasks; a hub spans several ranges.
    """
    spark = vertices.sparkSession
    ranged, half, taken, tried, groups = (Rounds(spark, f"community-{n}") for n in ("ranges", "half", "taken", "tried", "groups"))
    assigned = groups.put(vertices.select("id", F.col("id").alias("community")))
    reached = None

    def quality(hops: DataFrame, state: DataFrame) -> float:
        a = state.select(F.col("id").alias("src"), F.col("c").alias("ca"))
        b = state.select(F.col("id").alias("dst"), F.col("c").alias("cb"))
        inside = hops.join(a, "src").join(b, "dst").where("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inside"))
        share = F.col("tot") / m2
        spread = state.groupBy("c").agg(F.sum("k").alias("tot")).agg(F.sum(share * share).alias("spread"))
        return inside.crossJoin(spread).select(F.col("inside") / m2 - resolution * F.col("spread")).first()[0]

    def half_turn(hops: DataFrame, state: DataFrame, r: int) -> DataFrame:
        # The turn's number is a row and not a literal, or every turn would compile its own code.
        turn = F.broadcast(spark.range(r // 2, r // 2 + 1, 1, 1).select(F.col("id").cast("int").alias("turn")))
        in_turn = F.pmod(F.xxhash64("id", "turn"), F.lit(2)) == r % 2
        totals = state.groupBy("c").agg(F.sum("k").alias("tot"))
        near = hops.where("src <> dst").withColumnRenamed("src", "id").join(turn, in_turn).join(state.select(F.col("id").alias("dst"), "c"), "dst")
        stay = state.join(turn, in_turn).select("id", "c", F.lit(0.0).alias("weight"), "k", F.lit(True).alias("own"))
        links = near.select("id", "c", "weight", "k", F.lit(False).alias("own")).unionByName(stay)
        options = links.groupBy("id", "c").agg(F.sum("weight").alias("w"), F.max("k").alias("k"), F.max("own").alias("own")).join(totals, "c")
        others = F.col("tot") - F.when(F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("k") * others / m2, 9)
        best = options.withColumn("g", gain).groupBy("id").agg(
            F.max(F.struct("g", (-F.col("c")).alias("nc"))).alias("b"),
            F.max(F.when(F.col("own"), F.col("g"))).alias("g0"),
            F.max(F.when(F.col("own"), F.col("c"))).alias("old"),
            F.max("k").alias("k"),
        )
        moved = best.select("id", "k", F.when(F.col("b.g") > F.col("g0"), -F.col("b.nc")).otherwise(F.col("old")).alias("c"))
        return moved.unionByName(state.join(turn, ~in_turn).select("id", "k", "c"))

    while True:
        state = taken.put(hops.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")).withColumn("c", F.col("id")))
        of_start = hops.join(state.select(F.col("id").alias("src"), "k"), "src")
        dealt = ranged.put(of_start.repartitionByRange(default_slices(hops), "src", "dst"))
        at, turn = quality(dealt, state), 0
        while True:
            # Both halves are picked by the hash of the same number, so each vertex has one turn.
            first = half.put(half_turn(dealt, state, 2 * turn))
            moved = tried.put(half_turn(dealt, first, 2 * turn + 1))
            now = quality(dealt, moved)
            if now > at:
                state, taken, tried = moved, tried, taken
            if now < at + least_gain:
                break
            at, turn = now, turn + 1
        if reached is not None and at < reached + least_gain:
            break
        reached = at
        merged = state.select(F.col("id").alias("community"), F.col("c").alias("new"))
        assigned = groups.put(
            assigned.join(merged, "community", "left").select("id", F.coalesce("new", "community").alias("community"))
        )
        a = state.select(F.col("id").alias("src"), F.col("c").alias("ca"))
        b = state.select(F.col("id").alias("dst"), F.col("c").alias("cb"))
        grouped = dealt.join(a, "src").join(b, "dst").groupBy(F.col("ca").alias("src"), F.col("cb").alias("dst"))
        hops = merging.put(grouped.agg(F.sum("weight").alias("weight")))
    for rounds in (merging, ranged, half, taken, tried):
        rounds.drop()
    return assigned
