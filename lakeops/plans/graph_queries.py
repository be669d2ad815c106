"""Graph queries.

``trade``: who bought from whom (customer -> supplier; both are parties with one id
space), weighted by quantity.  ``typed``: trade by return flag.  ``supply``: supplier and part, two-sided.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.functions.common import total
from lakeops.operators import graph as g
from lakeops.operators.changes import Branch, merge
from lakeops.plans.registry import query
from lakeops.plans.relational import dsum
from lakeops.session import settle


def parties(t):
    sold = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit(True).alias("sells"))
    rows = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")
    )
    return rows.join(sold, "id", "left").fillna(False, ["sells"])


def trade(t, where: str = "true", *more):
    joined = t.lineitem.where(where).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    src, dst = F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")
    rows = joined.where("o_custkey <> l_suppkey").groupBy(src, dst, *more)
    return settle(rows.agg(F.sum("l_quantity").alias("weight"), F.count("*").alias("n")), "trade")


def graph(t, where: str = "true", directed: bool = True):
    return g.Graph(parties(t), trade(t, where), directed)


V = """v AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation, s_suppkey IS NOT NULL AS sells
  FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey)"""


def e_sql(where: str = "true", name: str = "e", extra: str = "") -> str:
    return f"""{name} AS MATERIALIZED (SELECT o_custkey AS src, l_suppkey AS dst{extra}, SUM(l_quantity) AS weight, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE o_custkey <> l_suppkey AND {where} GROUP BY ALL)"""


def und_sql(name: str = "u", edges: str = "e") -> str:
    return f"""{name} AS MATERIALIZED (SELECT src, dst, MIN(weight) AS weight FROM (SELECT src, dst, weight FROM {edges} UNION ALL SELECT dst, src, weight FROM {edges}) GROUP BY 1, 2)"""


VE = f"WITH RECURSIVE {V}, {e_sql()}"
VEU = f"{VE}, {und_sql()}"
HUB = "(SELECT src FROM u GROUP BY src ORDER BY COUNT(*) DESC, src LIMIT 1)"


def hub(hops):
    """The vertex with most neighbours (smallest id among equals)."""
    return hops.groupBy("src").agg(F.count("*").alias("d")).orderBy(F.col("d").desc(), "src").first()["src"]


def one(t, node: int):
    return t.spark.range(1).select(F.lit(node).cast("long").alias("source"))


@query(
    "graph_vertex_match",
    "N01 N02",
    f"WITH {V} SELECT id, name, segment FROM v WHERE sells AND segment <> 'MACHINERY' AND nation >= 5",
)
def _(t):
    return g.Graph(parties(t), None).vertices.where("sells AND segment <> 'MACHINERY' AND nation >= 5").select("id", "name", "segment")


@query(
    "graph_edge_match",
    "N03",
    f"{VE} SELECT a.name AS buyer, b.name AS seller, b.segment AS seller_segment, weight FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE a.nation = b.nation",
)
def _(t):
    rows = graph(t).triples().where("a.nation = b.nation")
    return rows.select(F.col("a.name").alias("buyer"), F.col("b.name").alias("seller"), F.col("b.segment").alias("seller_segment"), "weight")


TYPED = e_sql(name="e", extra=", l_returnflag AS kind")


@query(
    "graph_multi_hop_typed",
    "N04",
    f"""WITH {V}, {TYPED} SELECT a.segment AS start_label, c.segment AS end_label, COUNT(*) AS n_paths FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src
        JOIN v a ON a.id = x.src JOIN v c ON c.id = z.dst WHERE x.kind = 'R' AND y.kind = 'A' AND z.kind = 'N' GROUP BY 1, 2""",
)
def _(t):
    typed = trade(t, "true", F.col("l_returnflag").alias("kind"))
    steps = [typed.where(F.col("kind") == k) for k in ("R", "A", "N")]
    return g.count_paths(parties(t), steps, "segment")


@query(
    "graph_closed_cycles",
    "N05",
    f"""{VE} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src
        WHERE x.src < x.dst AND x.src < y.dst AND x.weight >= 0""",
)
def _(t):
    return g.directed_triangles(trade(t))


@query(
    "graph_conjunctive_patterns",
    "N06",
    f"""WITH {V}, {TYPED} SELECT r.src, r.dst, r.weight AS returned, k.weight AS kept FROM e r JOIN e k ON r.src = k.src AND r.dst = k.dst
        JOIN v b ON b.id = r.dst WHERE r.kind = 'R' AND k.kind = 'A' AND r.weight > k.weight AND b.segment = 'BUILDING'""",
)
def _(t):
    typed = trade(t, "true", F.col("l_returnflag").alias("kind"))
    r = typed.where("kind = 'R'").select("src", "dst", F.col("weight").alias("returned"))
    k = typed.where("kind = 'A'").select("src", "dst", F.col("weight").alias("kept"))
    sellers = parties(t).where("segment = 'BUILDING'").select(F.col("id").alias("dst"))
    return r.join(k, ["src", "dst"]).where("returned > kept").join(sellers, "dst").select("src", "dst", "returned", "kept")


@query(
    "graph_negative_pattern",
    "N07",
    f"""{VE} SELECT id, 'no_out' AS missing FROM v WHERE id NOT IN (SELECT src FROM e)
        UNION ALL SELECT id, 'no_in' FROM v WHERE id NOT IN (SELECT dst FROM e)""",
)
def _(t):
    net = graph(t)
    a = net.without_out().select("id", F.lit("no_out").alias("missing"))
    return a.unionByName(net.without_in().select("id", F.lit("no_in").alias("missing")))


@query(
    "graph_variable_length",
    "N08 N29",
    f"""{VEU}, h AS (SELECT {HUB} AS s), one AS (SELECT DISTINCT dst FROM u, h WHERE src = s), two AS (SELECT DISTINCT u.dst FROM u JOIN one ON u.src = one.dst)
        SELECT dst AS id FROM (SELECT dst FROM one UNION SELECT dst FROM two), h WHERE dst <> s""",
)
def _(t):
    hops = graph(t, directed=False).hops()
    return g.bfs(hops, one(t, hub(hops)), max_depth=2).where("depth > 0").select("id")


SUPPLY = "s AS (SELECT l_suppkey AS supp, l_partkey AS part, SUM(l_quantity) AS weight FROM lineitem GROUP BY 1, 2), top AS (SELECT part FROM s GROUP BY part ORDER BY COUNT(*) DESC, part LIMIT 1)"


def supply(t):
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("part"))
    return settle(rows.agg(F.sum("l_quantity").alias("weight")), "supply")


@query(
    "graph_co_neighbours",
    "N09 D18",
    f"""WITH {SUPPLY} SELECT b.part AS other_part, COUNT(DISTINCT b.supp) AS shared, SUM(b.weight) / COUNT(*) AS mean_weight
        FROM s a JOIN top ON a.part = top.part JOIN s b ON a.supp = b.supp AND b.part <> a.part GROUP BY 1""",
)
def _(t):
    s = supply(t)
    top = s.groupBy("part").agg(F.count("*").alias("d")).orderBy(F.col("d").desc(), "part").first()["part"]
    sellers = s.where(F.col("part") == top).select("supp")
    rows = s.join(sellers, "supp", "left_semi").where(F.col("part") != top)
    return rows.groupBy(F.col("part").alias("other_part")).agg(
        F.count("*").alias("shared"), (F.sum("weight") / F.count("*")).alias("mean_weight")
    )


@query(
    "graph_reciprocal",
    "N10",
    f"{VE} SELECT x.src, x.dst, x.weight AS there, y.weight AS back FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst",
)
def _(t):
    e = trade(t)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("back"))
    return e.where("src < dst").join(back, ["src", "dst"]).select("src", "dst", F.col("weight").alias("there"), "back")


@query(
    "graph_hub_then_neighbours",
    "N11",
    f"""{VE}, h AS (SELECT dst AS s FROM e GROUP BY dst ORDER BY COUNT(*) DESC, dst LIMIT 1)
        SELECT src AS buyer, name, weight FROM e JOIN h ON dst = s JOIN v ON v.id = src""",
)
def _(t):
    e = trade(t)
    top = e.groupBy("dst").agg(F.count("*").alias("d")).orderBy(F.col("d").desc(), "dst").limit(1).select("dst")
    rows = e.join(top, "dst", "left_semi")
    return rows.join(parties(t), F.col("src") == F.col("id")).select(F.col("src").alias("buyer"), "name", "weight")


DEGREE = """SELECT v.id, COALESCE(i.n, 0) AS in_degree, COALESCE(o.n, 0) AS out_degree, COALESCE(i.n, 0) + COALESCE(o.n, 0) AS degree FROM v
  LEFT JOIN (SELECT dst, COUNT(*) AS n FROM e GROUP BY 1) i ON i.dst = v.id LEFT JOIN (SELECT src, COUNT(*) AS n FROM e GROUP BY 1) o ON o.src = v.id"""


@query("graph_degree", "N12", f"{VE} {DEGREE}")
def _(t):
    return g.degrees(parties(t), trade(t))


def pagerank_sql(rounds: int) -> str:
    parts = [
        V,
        e_sql(),
        "o AS MATERIALIZED (SELECT v.id, COUNT(e.src) AS outs FROM v LEFT JOIN e ON e.src = v.id GROUP BY 1)",
        "c AS MATERIALIZED (SELECT COUNT(*)::DOUBLE AS n FROM v)",
        "r0 AS MATERIALIZED (SELECT o.id, outs, 1.0::DOUBLE / n AS score FROM o, c)",
    ]
    for i in range(rounds):
        parts.append(
            f"""r{i + 1} AS MATERIALIZED (SELECT r.id, r.outs, 0.15::DOUBLE / n + 0.85::DOUBLE * (COALESCE(q.got, 0) + (SELECT COALESCE(SUM(score), 0) FROM r{i} WHERE outs = 0) / n) AS score
            FROM r{i} r CROSS JOIN c LEFT JOIN (SELECT dst, SUM(score / outs) AS got FROM e JOIN r{i} ON src = id GROUP BY 1) q ON q.dst = r.id)"""
        )
    return "WITH " + ",\n".join(parts)


ROUNDS = 20


@query(
    "graph_pagerank",
    "N13",
    pagerank_sql(ROUNDS)
    + f" SELECT id, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS place FROM r{ROUNDS}",
)
def _(t):
    return g.ranked_scores(g.pagerank(parties(t), trade(t), 0.85, ROUNDS))


def components_sql(rounds: int, tail: str) -> str:
    parts = [f"{VEU}", "l0 AS MATERIALIZED (SELECT id, id AS label FROM v)"]
    for i in range(rounds):
        parts.append(
            f"l{i + 1} AS MATERIALIZED (SELECT l.id, LEAST(l.label, COALESCE(MIN(n.label), l.label)) AS label FROM l{i} l LEFT JOIN u ON u.src = l.id LEFT JOIN l{i} n ON n.id = u.dst GROUP BY l.id, l.label)"
        )
    return ",\n".join(parts) + tail.format(last=f"l{rounds}")


@query("graph_connected_components", "N14", components_sql(14, " SELECT id, label AS component FROM {last}"))
def _(t):
    return g.connected_components(parties(t), trade(t))


@query(
    "graph_strong_components",
    "N15",
    f"""{VE}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)
        SELECT v.id, LEAST(v.id, COALESCE(MIN(f.b), v.id)) AS component FROM v LEFT JOIN (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) f ON f.a = v.id GROUP BY v.id""",
)
def _(t):
    return g.strongly_connected(parties(t), trade(t))


@query(
    "graph_triangle_count",
    "N16",
    f"""{VE}, {und_sql()}, c AS MATERIALIZED (SELECT src, dst FROM u WHERE src < dst),
        tri AS MATERIALIZED (SELECT x.src AS a, x.dst AS b, y.dst AS d FROM c x JOIN c y ON x.dst = y.src JOIN c z ON z.src = x.src AND z.dst = y.dst)
        SELECT v.id, COUNT(p.k) AS triangle_count FROM v LEFT JOIN (SELECT a AS k FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT d FROM tri) p ON p.k = v.id GROUP BY 1""",
)
def _(t):
    return g.triangle_counts(parties(t), trade(t))


SAMPLED = "p AS MATERIALIZED (SELECT id AS s FROM v ORDER BY md5(id::VARCHAR), id LIMIT 16)"


EVERY = "p AS MATERIALIZED (SELECT id AS s FROM v)"


def betweenness_sql(depth: int, sources: str = SAMPLED) -> str:
    """Path counts level by level from each source, then dependencies level by level back."""
    parts = [VEU, sources, "l0 AS MATERIALIZED (SELECT s, s AS id, 1.0::DOUBLE AS paths FROM p)", "seen0 AS MATERIALIZED (SELECT s, id FROM l0)"]
    for i in range(depth):
        parts.append(
            f"""l{i + 1} AS MATERIALIZED (SELECT l.s, u.dst AS id, SUM(paths) AS paths FROM l{i} l JOIN u ON u.src = l.id
            WHERE NOT EXISTS (SELECT 1 FROM seen{i} x WHERE x.s = l.s AND x.id = u.dst) GROUP BY 1, 2)"""
        )
        parts.append(f"seen{i + 1} AS MATERIALIZED (SELECT * FROM seen{i} UNION ALL SELECT s, id FROM l{i + 1})")
    parts.append(f"d{depth} AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS dep FROM l{depth})")
    for i in reversed(range(depth)):
        parts.append(
            f"""d{i} AS MATERIALIZED (SELECT l.s, l.id, l.paths, l.paths * COALESCE(g.pull, 0) AS dep FROM l{i} l LEFT JOIN
            (SELECT b.s, u.src AS id, SUM((1 + b.dep) / b.paths) AS pull FROM d{i + 1} b JOIN u ON u.dst = b.id GROUP BY 1, 2) g ON g.s = l.s AND g.id = l.id)"""
        )
    every = " UNION ALL ".join(f"SELECT s, id, dep FROM d{i}" for i in range(1, depth + 1))
    return (
        ",\n".join(parts)
        + f""", c AS (SELECT COUNT(*)::DOUBLE AS n, (SELECT COUNT(*) FROM p)::DOUBLE AS k FROM v), t AS (SELECT id, SUM(dep) AS dep FROM ({every}) GROUP BY 1)
        SELECT v.id, round(COALESCE(dep, 0) * (n / k) / ((n - 1) * (n - 2)), 9) AS score FROM v CROSS JOIN c LEFT JOIN t ON t.id = v.id"""
    )


@query("graph_betweenness_sampled", "N17", betweenness_sql(8))
def _(t):
    # The sampled form: exact betweenness of every vertex is O(vertices * edges).
    v = parties(t)
    return g.betweenness(v, graph(t, directed=False).hops(), g.hash_sample(v, 16)).select("id", F.round("score", 9).alias("score"))


@query("graph_betweenness", "N17", betweenness_sql(6, EVERY))
def _(t):
    return g.betweenness(parties(t), graph(t, directed=False).hops()).select("id", F.round("score", 9).alias("score"))


@query(
    "graph_closeness_sampled",
    "N18",
    f"""{VEU}, {SAMPLED}, b(s, id, d) AS (SELECT s, s, 0 FROM p UNION SELECT b.s, u.dst, b.d + 1 FROM b JOIN u ON u.src = b.id WHERE b.d < 8),
        m AS (SELECT s, id, MIN(d) AS d FROM b GROUP BY 1, 2), q AS (SELECT id, COUNT(*)::DOUBLE AS r, SUM(d)::DOUBLE AS total FROM m WHERE d > 0 GROUP BY 1),
        c AS (SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM p) AS k FROM v)
        SELECT v.id, coalesce((r / total) * least(1.0::DOUBLE, r * n / k / (n - 1)), 0) AS closeness FROM v CROSS JOIN c LEFT JOIN q ON q.id = v.id""",
)
def _(t):
    v = parties(t)
    found = g.closeness_by_landmarks(graph(t, directed=False).hops(), g.hash_sample(v, 16), t.customer.count())
    return v.select("id").join(found, "id", "left").fillna(0.0, ["closeness"])


def closeness_sql(depth: int) -> str:
    """Pairs level by level: the first two by walking on, the others only for pairs not met so far."""
    parts = [VEU, "k AS MATERIALIZED (SELECT DISTINCT src AS id FROM u)", "l0 AS MATERIALIZED (SELECT id AS s, id FROM k)", "s0 AS MATERIALIZED (SELECT * FROM l0)"]
    for i in range(depth):
        step = f"SELECT DISTINCT l.s, u.dst AS id FROM l{i} l JOIN u ON u.src = l.id" if i < 2 else (
            f"SELECT DISTINCT o.s, o.id FROM (SELECT a.id AS s, b.id FROM k a CROSS JOIN k b ANTI JOIN s{i} x ON x.s = a.id AND x.id = b.id) o JOIN u ON u.dst = o.id JOIN l{i} l ON l.s = o.s AND l.id = u.src"
        )
        parts.append(f"l{i + 1} AS MATERIALIZED (SELECT n.* FROM ({step}) n ANTI JOIN s{i} x ON x.s = n.s AND x.id = n.id)")
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT * FROM s{i} UNION ALL SELECT * FROM l{i + 1})")
    every = " UNION ALL ".join(f"SELECT s, {i} AS d FROM l{i}" for i in range(1, depth + 1))
    return (
        ",\n".join(parts)
        + f""", q AS (SELECT s, COUNT(*)::DOUBLE AS r, SUM(d)::DOUBLE AS total FROM ({every}) GROUP BY 1)
        SELECT v.id, coalesce((r / total) * (r / ((SELECT COUNT(*) FROM v) - 1)), 0) AS closeness FROM v LEFT JOIN q ON q.s = v.id"""
    )


@query("graph_closeness", "N18", closeness_sql(6))
def _(t):
    return g.all_closeness(parties(t), graph(t, directed=False).hops())


@query("graph_communities", "N19")
def _(t):
    return g.communities(parties(t), trade(t))


def bellman_sql(rounds: int) -> str:
    parts = [VEU, f"d0 AS MATERIALIZED (SELECT {HUB} AS id, 0.0::DOUBLE AS distance)"]
    for i in range(rounds):
        parts.append(
            f"d{i + 1} AS MATERIALIZED (SELECT id, MIN(distance) AS distance FROM (SELECT * FROM d{i} UNION ALL SELECT u.dst, distance + weight FROM d{i} JOIN u ON u.src = id) GROUP BY id)"
        )
    return ",\n".join(parts)


@query("graph_all_distances", "N22", bellman_sql(14) + " SELECT id, distance FROM d14")
def _(t):
    hops = graph(t, directed=False).hops()
    return g.distances(hops, hub(hops))


@query(
    "graph_shortest_path",
    "N20",
    bellman_sql(14)
    + """, goal AS (SELECT id FROM d14 ORDER BY distance DESC, id LIMIT 1),
        par AS MATERIALIZED (SELECT u.dst AS id, arg_min(a.id, (a.distance, a.id)) AS p, any_value(b.distance) AS distance FROM u JOIN d14 a ON a.id = u.src JOIN d14 b ON b.id = u.dst
                WHERE a.distance + u.weight = b.distance GROUP BY 1),
        w(k, id) AS (SELECT 0, id FROM goal UNION ALL SELECT k + 1, p FROM w JOIN par ON par.id = w.id WHERE w.id <> """
    + HUB
    + """) SELECT CAST((SELECT MAX(k) FROM w) - k AS INTEGER) AS step, w.id, d14.distance FROM w JOIN d14 ON d14.id = w.id""",
)
def _(t):
    hops = graph(t, directed=False).hops()
    start = hub(hops)
    best = g.distances(hops, start)
    goal = best.orderBy(F.col("distance").desc(), "id").first()["id"]
    return g.shortest_path(hops, start, goal, best)


@query(
    "graph_bfs",
    "N21",
    f"""{VEU}, b(id, d) AS (SELECT {HUB}, 0 UNION SELECT u.dst, d + 1 FROM b JOIN u ON u.src = b.id WHERE d < 12), m AS (SELECT id, MIN(d) AS d FROM b GROUP BY 1)
        SELECT m.id, m.d AS depth, (SELECT MIN(u.src) FROM u JOIN m x ON x.id = u.src WHERE u.dst = m.id AND x.d = m.d - 1) AS parent FROM m""",
)
def _(t):
    hops = graph(t, directed=False).hops()
    return g.bfs(hops, one(t, hub(hops))).select("id", "depth", "parent")


def boruvka_sql(rounds: int) -> str:
    """Each round every component takes its least edge; ``rounds`` pointer jumps find the new roots."""
    parts = [f"{VEU}", "c0 AS MATERIALIZED (SELECT id, id AS c FROM v)"]
    for i in range(rounds):
        parts.append(
            f"""x{i} AS MATERIALIZED (SELECT weight, src, dst, a.c AS ca, b.c AS cb FROM u JOIN c{i} a ON a.id = src JOIN c{i} b ON b.id = dst WHERE src < dst AND a.c <> b.c)"""
        )
        parts.append(
            f"""m{i} AS MATERIALIZED (SELECT c, arg_min({{'src': src, 'dst': dst, 'weight': weight, 'to': o}}, (weight, src, dst)) AS e
            FROM (SELECT ca AS c, cb AS o, weight, src, dst FROM x{i} UNION ALL SELECT cb, ca, weight, src, dst FROM x{i}) GROUP BY c)"""
        )
        parts.append(
            f"t{i}_0 AS MATERIALIZED (SELECT a.c, CASE WHEN b.e['to'] = a.c AND a.c < a.e['to'] THEN a.c ELSE a.e['to'] END AS r FROM m{i} a JOIN m{i} b ON b.c = a.e['to'])"
        )
        for j in range(rounds):
            parts.append(f"t{i}_{j + 1} AS MATERIALIZED (SELECT a.c, b.r FROM t{i}_{j} a JOIN t{i}_{j} b ON b.c = a.r)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT id, COALESCE(r, k.c) AS c FROM c{i} k LEFT JOIN t{i}_{rounds} t ON t.c = k.c)")
    picks = " UNION ".join(f"SELECT e['src'] AS src, e['dst'] AS dst, e['weight'] AS weight FROM m{i}" for i in range(rounds))
    return ",\n".join(parts) + f" {picks}"


@query("graph_spanning_forest", "N23", boruvka_sql(11))
def _(t):
    return g.spanning_forest(parties(t), trade(t))


JACCARD = f"""{VE}, {und_sql()}, dg AS MATERIALIZED (SELECT src, COUNT(*) AS d FROM u GROUP BY 1)"""


@query(
    "graph_nearest_by_jaccard",
    "N24",
    JACCARD
    + f""", own AS (SELECT dst FROM u WHERE src = {HUB}), c AS (SELECT src, COUNT(*) AS common FROM u WHERE dst IN (SELECT dst FROM own) AND src <> {HUB} GROUP BY 1),
        s AS (SELECT c.src AS neighbor_id, CAST(common AS DOUBLE) / (d + (SELECT COUNT(*) FROM own) - common) AS similarity FROM c JOIN dg ON dg.src = c.src)
        SELECT *, row_number() OVER (ORDER BY similarity DESC, neighbor_id) AS rank FROM s ORDER BY rank LIMIT 10""",
)
def _(t):
    e = trade(t)
    return g.nearest(e, hub(g.both_ways(e)), 10)


@query(
    "graph_pair_similarity",
    "N25",
    f"""{VE}, {und_sql()}, dg AS MATERIALIZED (SELECT src, COUNT(*) AS d FROM u GROUP BY 1)
        SELECT p.src AS a, p.dst AS b, COUNT(y.src) AS common, CAST(COUNT(y.src) AS DOUBLE) / (any_value(da.d) + any_value(db.d) - COUNT(y.src)) AS similarity
        FROM (SELECT src, dst FROM u WHERE src < dst) p JOIN dg da ON da.src = p.src JOIN dg db ON db.src = p.dst
        LEFT JOIN u x ON x.src = p.src LEFT JOIN u y ON y.src = p.dst AND y.dst = x.dst GROUP BY 1, 2""",
)
def _(t):
    e = trade(t)
    pairs = g.both_ways(e).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return g.pair_similarity(e, pairs)


@query(
    "graph_result_joined_to_tables",
    "N26",
    f"""{VE}, d AS ({DEGREE}) SELECT n_name, COUNT(*) AS parties, CAST(SUM(d.degree) AS BIGINT) AS links, {dsum('c_acctbal')} AS balance
        FROM d JOIN customer ON c_custkey = d.id JOIN nation ON n_nationkey = c_nationkey WHERE d.degree > 20 GROUP BY 1""",
)
def _(t):
    d = g.degrees(parties(t), trade(t)).where("degree > 20")
    rows = d.join(t.customer, F.col("id") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(
        F.count("*").alias("parties"), F.sum("degree").alias("links"), total("c_acctbal").alias("balance")
    )


#: The state before the mutation: heavy returned lines.
SENT_BACK = "l_returnflag = 'R' AND l_quantity >= 45"


@query(
    "graph_after_mutation",
    "N27",
    f"""WITH {V}, {e_sql(SENT_BACK, 'old')}, {e_sql("l_returnflag = 'A' AND l_quantity >= 48", 'new')},
        e AS (SELECT COALESCE(o.src, n.src) AS src, COALESCE(o.dst, n.dst) AS dst FROM old o FULL JOIN new n ON o.src = n.src AND o.dst = n.dst
              WHERE NOT (o.src IS NOT NULL AND n.src IS NULL AND o.weight >= 50)) {DEGREE}""",
)
def _(t):
    old, new = trade(t, SENT_BACK), trade(t, "l_returnflag = 'A' AND l_quantity >= 48")
    values = {c: F.col(f"s.{c}") for c in ("src", "dst", "weight", "n")}
    edges = merge(
        old,
        new,
        ["src", "dst"],
        [Branch("update", None, {"weight": F.col("s.weight")})],
        [Branch("insert", None, values)],
        [Branch("delete", F.col("t.weight") >= 50)],
    )
    return g.degrees(parties(t), settle(edges))


@query(
    "graph_group_matrix",
    "N28",
    f"""{VE} SELECT a.segment AS from_segment, b.segment AS to_segment, COUNT(*) AS edges, CAST(SUM(n) AS BIGINT) AS n_lines
        FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst GROUP BY 1, 2""",
)
def _(t):
    rows = graph(t).triples()
    return rows.groupBy(F.col("a.segment").alias("from_segment"), F.col("b.segment").alias("to_segment")).agg(
        F.count("*").alias("edges"), F.sum("n").alias("n_lines")
    )


@query(
    "graph_weighted_influence",
    "D17",
    pagerank_sql(ROUNDS)
    + f""", spend AS (SELECT o_custkey, {dsum('o_totalprice')} AS revenue FROM orders GROUP BY 1)
        SELECT segment, round(SUM(score * revenue) * 1000, 3) AS influence, COUNT(*) AS parties FROM r{ROUNDS} r JOIN spend ON o_custkey = r.id JOIN v ON v.id = r.id GROUP BY 1""",
)
def _(t):
    scores = g.pagerank(parties(t), trade(t), 0.85, ROUNDS)
    spend = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(total("o_totalprice").alias("revenue"))
    rows = scores.join(spend, "id").join(parties(t), "id")
    return rows.groupBy("segment").agg(
        F.round(F.sum(F.col("score") * F.col("revenue")) * 1000, 3).alias("influence"), F.count("*").alias("parties")
    )
