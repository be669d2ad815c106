"""Projection, filter, conversion, join and aggregation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeops.functions.common import day, mean, micros, money, net, occurrences, total
from lakeops.operators.joins import as_of_join, overlap_join
from lakeops.plans.registry import query

NET = "CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(4,2)))"


def dsum(c: str) -> str:
    """Exact sum of an amount in oracle SQL."""
    return f"CAST(SUM(CAST({c} AS DECIMAL(14,2))) AS DOUBLE)"


# --- projection, filter, conversion -------------------------------------------------


@query(
    "project_computed_columns",
    "P01",
    """SELECT p_partkey, upper(p_name) AS name_upper, p_retailprice * p_size AS shelf_value,
              p_retailprice - 900 AS over_base FROM part""",
)
def _(t):
    return t.part.select(
        "p_partkey",
        F.upper("p_name").alias("name_upper"),
        (F.col("p_retailprice") * F.col("p_size")).alias("shelf_value"),
        (F.col("p_retailprice") - 900).alias("over_base"),
    )


@query(
    "filter_boolean_logic",
    "P02",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
       WHERE (o_orderstatus = 'F' AND o_totalprice < 20000) OR (o_orderstatus <> 'F' AND NOT o_totalprice <= 480000)""",
)
def _(t):
    done, price = F.col("o_orderstatus") == "F", F.col("o_totalprice")
    return t.orders.where((done & (price < 20000)) | (~done & ~(price <= 480000))).select(
        "o_orderkey", "o_orderstatus", "o_totalprice"
    )


@query(
    "filter_between",
    "P03",
    "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 910 AND 960",
)
def _(t):
    return t.part.where(F.col("p_size").between(10, 20) & F.col("p_retailprice").between(910, 960)).select(
        "p_partkey", "p_size", "p_retailprice"
    )


@query(
    "filter_in_list",
    "P04",
    """SELECT p_partkey, p_brand, p_type FROM part
       WHERE p_brand IN ('Brand#1','Brand#4','Brand#7') AND p_type NOT IN ('SMALL','LARGE')""",
)
def _(t):
    return t.part.where(
        F.col("p_brand").isin("Brand#1", "Brand#4", "Brand#7") & ~F.col("p_type").isin("SMALL", "LARGE")
    ).select("p_partkey", "p_brand", "p_type")


@query(
    "filter_like_json_text",
    "P05",
    """SELECT event_type, COUNT(*) AS n FROM events
       WHERE props LIKE '%"k": 6%' AND event_type NOT LIKE 's%' GROUP BY event_type""",
)
def _(t):
    return (
        t.events.where(F.col("props").like('%"k": 6%') & ~F.col("event_type").like("s%"))
        .groupBy("event_type")
        .agg(F.count("*").alias("n"))
    )


@query(
    "filter_null_tests",
    "P06",
    """SELECT CASE WHEN l.quality IS NULL THEN 'unlabelled' ELSE 'labelled' END AS state, COUNT(*) AS docs
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       WHERE d.text IS NOT NULL GROUP BY 1""",
)
def _(t):
    joined = t.documents.where(F.col("text").isNotNull()).select("doc_id").join(t.labels, "doc_id", "left")
    state = F.when(F.col("quality").isNull(), "unlabelled").otherwise("labelled").alias("state")
    return joined.groupBy(state).agg(F.count("*").alias("docs"))


@query(
    "filter_null_safe_equality",
    "P07",
    """SELECT COUNT(*) FILTER (WHERE a.q IS NOT DISTINCT FROM a.x) AS same,
              COUNT(*) FILTER (WHERE a.q IS DISTINCT FROM a.x) AS differ, COUNT(*) FILTER (WHERE a.q = a.x) AS plain_equal
       FROM (SELECT l.quality AS q, nullif(l.toxic, 1) AS x FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) a""",
)
def _(t):
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    q, x = F.col("quality"), F.nullif(F.col("toxic"), F.lit(1))
    return rows.agg(
        F.count_if(q.eqNullSafe(x)).alias("same"),
        F.count_if(~q.eqNullSafe(x)).alias("differ"),
        F.count_if(q == x).alias("plain_equal"),
    )


@query(
    "case_tiers",
    "P08",
    f"""SELECT CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'large' END AS tier,
              CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'pending' END AS state,
              COUNT(*) AS n, {dsum('o_totalprice')} AS value FROM orders GROUP BY 1, 2""",
)
def _(t):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    tier = F.when(price < 100000, "small").when(price < 300000, "medium").otherwise("large")
    state = F.when(status == "F", "done").when(status == "O", "open").otherwise("pending")
    return t.orders.groupBy(tier.alias("tier"), state.alias("state")).agg(
        F.count("*").alias("n"), total("o_totalprice").alias("value")
    )


@query(
    "cast_types",
    "P09",
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_text, CAST(o_orderdate AS DATE)::VARCHAR AS order_day,
              CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS priority, CAST(o_totalprice AS DECIMAL(12,1))::DOUBLE AS price_1 FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("key_text"),
        day("o_orderdate").alias("order_day"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("o_totalprice").cast("decimal(12,1)").cast("double").alias("price_1"),
    )


@query(
    "nested_build_and_access",
    "P10 P11 P12 P14",
    """SELECT p_partkey, p_size AS dim_size, p_retailprice AS dim_price, p_name AS name_en, CAST(NULL AS VARCHAR) AS name_fr,
              split_part(p_name, ' ', 1) AS first_word, split_part(p_name, ' ', 2) AS last_word, 2 AS words FROM part""",
)
def _(t):
    nested = t.part.select(
        "p_partkey",
        F.struct(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")).alias("dim"),
        F.create_map(F.lit("en"), F.col("p_name")).alias("names"),
        F.split("p_name", " ").alias("words"),
    )
    return nested.select(
        "p_partkey",
        F.col("dim.size").alias("dim_size"),
        F.col("dim.price").alias("dim_price"),
        F.col("names")["en"].alias("name_en"),
        F.try_element_at("names", F.lit("fr")).alias("name_fr"),
        F.element_at("words", 1).alias("first_word"),
        F.element_at("words", -1).alias("last_word"),
        F.size("words").alias("words"),
    )


@query(
    "unnest_elements",
    "P13",
    """SELECT word, COUNT(*) AS parts, COUNT(DISTINCT p_brand) AS brands
       FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word""",
)
def _(t):
    words = t.part.select("p_brand", F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("parts"), F.countDistinct("p_brand").alias("brands"))


@query(
    "decimal_drift",
    "P15",
    """SELECT l_returnflag, COUNT(*) FILTER (WHERE drift <> 0) AS drifted, CAST(SUM(drift) AS DOUBLE) AS total_drift FROM (
         SELECT l_returnflag, CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(16,2)) AS DECIMAL(18,4))
                - CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS drift
         FROM lineitem) GROUP BY l_returnflag""",
)
def _(t):
    exact = net("l_extendedprice", "l_discount").cast("decimal(18,4)")
    stored = exact.cast("decimal(16,2)").cast("decimal(18,4)")
    return (
        t.lineitem.withColumn("drift", stored - exact)
        .groupBy("l_returnflag")
        .agg(F.count_if(F.col("drift") != 0).alias("drifted"), F.sum("drift").cast("double").alias("total_drift"))
    )


@query(
    "text_occurrences",
    "P16",
    """SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS the_count,
              length(text) - length(replace(text, chr(10), '')) AS line_breaks FROM documents""",
)
def _(t):
    return t.documents.select(
        "doc_id", occurrences("text", "the").alias("the_count"), occurrences("text", "\n").alias("line_breaks")
    )


# --- joins --------------------------------------------------------------------------


def star(t):
    """lineitem with its order, customer, nation and region (only the needed columns)."""
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


STAR_SQL = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query(
    "join_star_chain",
    "J01",
    f"""SELECT r_name, c_mktsegment, COUNT(*) AS lines, CAST(SUM({NET}) AS DOUBLE) AS revenue
        FROM {STAR_SQL} GROUP BY r_name, c_mktsegment""",
)
def _(t):
    return star(t).groupBy("r_name", "c_mktsegment").agg(
        F.count("*").alias("lines"), F.sum(net("l_extendedprice", "l_discount")).cast("double").alias("revenue")
    )


@query(
    "revenue_rollup_ranked",
    "J01 A03 A10 W02 O01",
    f"""WITH r AS (SELECT n_name, CAST(extract(year FROM o_orderdate) AS INTEGER) AS order_year, CAST(SUM({NET}) AS DOUBLE) AS revenue,
              COUNT(*) AS lines FROM {STAR_SQL} GROUP BY ROLLUP (n_name, order_year))
        SELECT *, CAST(RANK() OVER (PARTITION BY order_year ORDER BY revenue DESC) AS BIGINT) AS place FROM r""",
)
def _(t):
    # Nation by year: a window partition holds at most one row per nation, plus the subtotal.
    # Lines are summed by the finest keys first, so the rollup expands a few hundred rows; decimals keep it exact.
    fine = star(t).groupBy("n_name", F.year("o_orderdate").alias("order_year"))
    fine = fine.agg(F.sum(net("l_extendedprice", "l_discount")).alias("revenue"), F.count("*").alias("lines"))
    per = fine.rollup("n_name", "order_year").agg(F.sum("revenue").cast("double").alias("revenue"), F.sum("lines").alias("lines"))
    place = F.rank().over(Window.partitionBy("order_year").orderBy(F.col("revenue").desc()))
    return per.withColumn("place", place.cast("long"))


@query(
    "join_left_outer",
    "J02",
    """SELECT c_custkey, COUNT(o_orderkey) AS urgent_orders FROM customer
       LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey""",
)
def _(t):
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT")
    per = urgent.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return (
        t.customer.select("c_custkey")
        .join(per, "c_custkey", "left")
        .select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("urgent_orders"))
    )


@query(
    "join_full_outer",
    "J03",
    """SELECT COALESCE(a.k, b.k) AS party, COALESCE(bought, 0) AS bought, COALESCE(sold, 0) AS sold
       FROM (SELECT o_custkey AS k, COUNT(*) AS bought FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
       FULL JOIN (SELECT l_suppkey AS k, COUNT(*) AS sold FROM lineitem GROUP BY 1) b ON a.k = b.k""",
)
def _(t):
    a = t.orders.where(F.col("o_orderstatus") == "F").groupBy(F.col("o_custkey").alias("party"))
    b = t.lineitem.groupBy(F.col("l_suppkey").alias("party"))
    both = a.agg(F.count("*").alias("bought")).join(b.agg(F.count("*").alias("sold")), "party", "full")
    return both.fillna(0, ["bought", "sold"])


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "OTHER")


@query(
    "join_cross_bounded",
    "J04",
    """SELECT n_name, p.seg, CAST(COALESCE(c.n, 0) AS BIGINT) AS customers
       FROM nation CROSS JOIN (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY'), ('OTHER')) p(seg)
       LEFT JOIN (SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1, 2) c
         ON c.c_nationkey = n_nationkey AND c.c_mktsegment = p.seg""",
)
def _(t):
    # The second side is a closed code list, so each row is expanded in place.
    grid = t.nation.select("n_nationkey", "n_name", F.explode(F.array(*[F.lit(c) for c in SEGMENTS])).alias("seg"))
    counts = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg")).agg(
        F.count("*").alias("customers")
    )
    return grid.join(counts, ["n_nationkey", "seg"], "left").fillna(0, ["customers"]).drop("n_nationkey")


OVERLAP_SQL = """WITH v AS (SELECT event_id, user_id, event_type, ts AS s, ts + to_microseconds(CAST(value * 60000000 AS BIGINT)) AS e FROM events)
  SELECT a.event_id AS first_id, b.event_id AS second_id, a.user_id FROM v a JOIN v b
  ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.s < b.e AND b.s < a.e AND a.event_id < b.event_id"""


def bookings(t):
    """Events as intervals: ``value`` minutes long, from ``ts``."""
    start = micros("ts")
    return t.events.select(
        "event_id",
        "user_id",
        "event_type",
        start.alias("s"),
        (start + F.round(F.col("value") * 60_000_000).cast("long")).alias("e"),
    )


@query("join_interval_overlap", "J05", OVERLAP_SQL)
def _(t):
    # Half-open intervals: equal ends do not overlap.
    pairs = overlap_join(bookings(t), ["user_id", "event_type"], "event_id", "s", "e")
    return pairs.select("first_id", "second_id", "user_id")


@query(
    "join_inequality_pairs",
    "J06",
    """SELECT a.n_name AS first_name, b.n_name AS second_name, r_name
       FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
       JOIN region ON a.n_regionkey = r_regionkey""",
)
def _(t):
    # Dimension tables: 25 nations in 5 regions, so the pairs are bounded by the dimension.
    a = t.nation.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("first_name"), "n_regionkey")
    b = t.nation.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("second_name"), "n_regionkey")
    pairs = a.join(b, "n_regionkey").where(F.col("ka") < F.col("kb"))
    return pairs.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("first_name", "second_name", "r_name")


@query(
    "join_semi",
    "J07",
    """SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)
       AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def _(t):
    big = t.orders.where(F.col("o_totalprice") > 450000)
    pending = t.orders.where(F.col("o_orderstatus") == "P")
    c = t.customer.join(big, F.col("c_custkey") == big["o_custkey"], "left_semi")
    return c.join(pending, F.col("c_custkey") == pending["o_custkey"], "left_semi").select("c_custkey", "c_name")


@query(
    "join_anti",
    "J08",
    "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
)
def _(t):
    big = t.orders.where(F.col("o_totalprice") > 400000)
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    "join_not_in_null_aware",
    "J09",
    """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
       UNION ALL SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT nullif(doc_id, 0) FROM labels)""",
)
def _(t):
    def not_in(df, values):
        """Null-aware: a NULL among the values leaves no row.

        The anti join stays a hash join; the NULL test is one aggregate, not a
        null-aware join that must broadcast the value side.
        """
        any_null = values.agg(F.coalesce(F.bool_or(F.col("v").isNull()), F.lit(False)).alias("x"))
        kept = df.join(values, F.col("doc_id") == F.col("v"), "left_anti")
        return kept.where(F.col("doc_id").isNotNull() & ~any_null.scalar())

    docs = t.documents.select("doc_id")
    plain = not_in(docs, t.labels.select(F.col("doc_id").alias("v")))
    return plain.unionByName(not_in(docs, t.labels.select(F.nullif("doc_id", F.lit(0)).alias("v"))))


@query(
    "join_self_roles",
    "J10",
    """SELECT v.user_id, v.t AS first_view, c.t AS first_click, p.t AS first_purchase FROM
       (SELECT user_id, epoch_us(min(ts)) AS t FROM events WHERE event_type = 'view' GROUP BY 1) v
       JOIN (SELECT user_id, epoch_us(min(ts)) AS t FROM events WHERE event_type = 'click' GROUP BY 1) c ON c.user_id = v.user_id
       JOIN (SELECT user_id, epoch_us(min(ts)) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1) p ON p.user_id = v.user_id
       WHERE v.t < c.t AND c.t < p.t""",
)
def _(t):
    # One pass instead of a self-join per role: each role is a conditional minimum.
    firsts = t.events.groupBy("user_id").agg(
        *[
            F.min(F.when(F.col("event_type") == kind, micros("ts"))).alias(f"first_{kind}")
            for kind in ("view", "click", "purchase")
        ]
    )
    return firsts.where("first_view < first_click AND first_click < first_purchase")


RATE_SQL = """WITH r AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'signup'),
  q AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase')
  SELECT q.event_id, q.user_id, q.value, r.value AS rate FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.ts >= r.ts"""


@query("join_point_in_time", "J11", RATE_SQL)
def _(t):
    rates = t.events.where("event_type = 'signup'").select("user_id", "ts", F.col("value").alias("rate"))
    trades = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    return as_of_join(trades, rates, ["user_id"], "ts", ["rate"], "event_id").drop("ts")


@query(
    "join_request_response",
    "J16",
    """SELECT q.event_id AS request_id, COUNT(r.event_id) AS responses FROM
       (SELECT event_id, user_id, json_extract_string(props, '$.k') AS trace FROM events WHERE event_type = 'click') q
       LEFT JOIN (SELECT event_id, user_id, json_extract_string(props, '$.k') AS trace FROM events WHERE event_type = 'view') r
       ON q.user_id = r.user_id AND q.trace = r.trace GROUP BY 1""",
)
def _(t):
    keyed = t.events.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("trace"))
    # Responses are counted per key before the join, so a hot key is one row there.
    answers = keyed.where("event_type = 'view'").groupBy("user_id", "trace").agg(F.count("*").alias("responses"))
    return (
        keyed.where("event_type = 'click'")
        .join(answers, ["user_id", "trace"], "left")
        .select(F.col("event_id").alias("request_id"), F.coalesce("responses", F.lit(0)).cast("long").alias("responses"))
    )


# --- aggregation --------------------------------------------------------------------


@query(
    "agg_counts_and_nulls",
    "A01 A16",
    """SELECT COUNT(*) AS docs, COUNT(l.quality) AS labelled, COUNT(nullif(l.toxic, 0)) AS toxic
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").agg(
        F.count("*").alias("docs"),
        F.count("quality").alias("labelled"),
        F.count(F.nullif("toxic", F.lit(0))).alias("toxic"),
    )


@query(
    "agg_count_distinct",
    "A02",
    """SELECT l_returnflag, COUNT(DISTINCT l_orderkey) AS orders, COUNT(DISTINCT l_partkey) AS parts,
              COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag""",
)
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.countDistinct("l_orderkey").alias("orders"),
        F.countDistinct("l_partkey").alias("parts"),
        F.countDistinct("l_suppkey").alias("suppliers"),
    )


@query(
    "agg_plain_average",
    "A03",
    """SELECT l_returnflag, l_linestatus, round(AVG(l_extendedprice), 4) AS mean_price, round(AVG(l_discount), 6) AS mean_discount,
       round(AVG(l_extendedprice * (1 - l_discount)), 4) AS mean_net FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.avg(price), 4).alias("mean_price"),
        F.round(F.avg(discount), 6).alias("mean_discount"),
        F.round(F.avg(price * (1 - discount)), 4).alias("mean_net"),
    )


@query(
    "agg_pricing_summary",
    "A03",
    f"""SELECT l_returnflag, l_linestatus, {dsum('l_quantity')} AS sum_qty, {dsum('l_extendedprice')} AS sum_price,
              CAST(SUM({NET}) AS DOUBLE) AS sum_net, {dsum('l_quantity')} / COUNT(*) AS avg_qty,
              MIN(l_extendedprice) AS min_price, MAX(l_extendedprice) AS max_price, COUNT(*) AS n
       FROM lineitem WHERE l_shipdate <= DATE '2001-09-02' GROUP BY 1, 2""",
)
def _(t):
    return (
        t.lineitem.where("l_shipdate <= DATE '2001-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            total("l_quantity").alias("sum_qty"),
            total("l_extendedprice").alias("sum_price"),
            F.sum(net("l_extendedprice", "l_discount")).cast("double").alias("sum_net"),
            mean("l_quantity").alias("avg_qty"),
            F.min("l_extendedprice").alias("min_price"),
            F.max("l_extendedprice").alias("max_price"),
            F.count("*").alias("n"),
        )
    )


@query(
    "agg_filter_clause",
    "A04",
    f"""SELECT l_suppkey, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returned,
              COALESCE(CAST(SUM(CAST(l_extendedprice AS DECIMAL(14,2))) FILTER (WHERE l_linestatus = 'O') AS DOUBLE), 0) AS open_value,
              MAX(l_quantity) FILTER (WHERE l_discount > 0.05) AS top_discounted_qty FROM lineitem GROUP BY l_suppkey""",
)
def _(t):
    open_price = F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.coalesce(total(open_price), F.lit(0.0)).alias("open_value"),
        F.max(F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))).alias("top_discounted_qty"),
    )


@query(
    "agg_conditional_pivot",
    "A05",
    """SELECT o_orderpriority, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f,
              SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o,
              SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS p FROM orders GROUP BY 1""",
)
def _(t):
    status = F.col("o_orderstatus")
    return t.orders.groupBy("o_orderpriority").agg(
        *[F.sum(F.when(status == s, 1).otherwise(0)).alias(s.lower()) for s in ("F", "O", "P")]
    )


@query(
    "agg_share_of_total",
    "A06",
    f"""SELECT n_name, {dsum('o_totalprice')} AS value, 100.0::DOUBLE * {dsum('o_totalprice')}
              / (SELECT {dsum('o_totalprice')} FROM orders) AS share
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def _(t):
    whole = t.orders.agg(total("o_totalprice").alias("x")).scalar()
    per = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(total("o_totalprice").alias("value"))
    )
    return per.withColumn("share", F.lit(100.0) * F.col("value") / whole)


@query(
    "agg_group_by_expression",
    "A07",
    f"""SELECT CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, CAST(extract(month FROM o_orderdate) AS INTEGER) AS m,
              COUNT(*) AS n, {dsum('o_totalprice')} AS value FROM orders GROUP BY 1, 2""",
)
def _(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(
        F.count("*").alias("n"), total("o_totalprice").alias("value")
    )


@query(
    "agg_having",
    "A08",
    f"""SELECT o_custkey, COUNT(*) AS n, {dsum('o_totalprice')} AS value FROM orders
       GROUP BY o_custkey HAVING COUNT(*) >= 12 AND {dsum('o_totalprice')} > 2000000""",
)
def _(t):
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), total("o_totalprice").alias("value"))
    return per.where("n >= 12 AND value > 2000000")


SEGMENT_ORDERS = "orders JOIN customer ON o_custkey = c_custkey"


def segment_orders(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))


def finest(df, *keys):
    """Rows and exact value by the finest keys, so that sets of keys expand groups and not rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).alias("value"))


def from_finest():
    """The same, of groups of finest keys."""
    return F.sum("n").alias("n"), F.sum("value").cast("double").alias("value")


@query(
    "agg_grouping_sets",
    "A09",
    f"""SELECT c_mktsegment, o_orderstatus, COUNT(*) AS n, {dsum('o_totalprice')} AS value FROM {SEGMENT_ORDERS}
       GROUP BY GROUPING SETS ((c_mktsegment, o_orderstatus), (c_mktsegment), (o_orderstatus), ())""",
)
def _(t):
    seg, status = F.col("c_mktsegment"), F.col("o_orderstatus")
    fine = finest(segment_orders(t), "c_mktsegment", "o_orderstatus")
    return fine.groupingSets([[seg, status], [seg], [status], []], seg, status).agg(*from_finest())


@query(
    "agg_rollup",
    "A10",
    f"""SELECT c_mktsegment, o_orderpriority, COUNT(*) AS n, {dsum('o_totalprice')} AS value FROM {SEGMENT_ORDERS}
       GROUP BY ROLLUP (c_mktsegment, o_orderpriority)""",
)
def _(t):
    return finest(segment_orders(t), "c_mktsegment", "o_orderpriority").rollup("c_mktsegment", "o_orderpriority").agg(*from_finest())


@query(
    "agg_cube",
    "A11",
    "SELECT l_returnflag, l_linestatus, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)",
)
def _(t):
    keys = ("l_returnflag", "l_linestatus", "l_linenumber")
    return t.lineitem.groupBy(*keys).count().cube(*keys).agg(F.sum("count").alias("n"))


@query(
    "agg_grouping_labels",
    "A12",
    f"""SELECT CASE WHEN GROUPING(c_mktsegment) = 1 THEN 'ALL' ELSE c_mktsegment END AS segment,
              CASE WHEN GROUPING(o_orderstatus) = 1 THEN 'ALL' ELSE o_orderstatus END AS status, COUNT(*) AS n
       FROM {SEGMENT_ORDERS} GROUP BY CUBE (c_mktsegment, o_orderstatus)
       HAVING GROUPING(c_mktsegment) = 1 OR GROUPING(o_orderstatus) = 1""",
)
def _(t):
    cubed = (
        finest(segment_orders(t), "c_mktsegment", "o_orderstatus")
        .cube("c_mktsegment", "o_orderstatus")
        .agg(F.grouping("c_mktsegment").alias("gs"), F.grouping("o_orderstatus").alias("gt"), F.sum("n").alias("n"))
    )
    return cubed.where("gs = 1 OR gt = 1").select(
        F.when(F.col("gs") == 1, "ALL").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("gt") == 1, "ALL").otherwise(F.col("o_orderstatus")).alias("status"),
        "n",
    )


@query(
    "agg_string_list_distinct",
    "A13",
    """SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS statuses,
              string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey""",
)
def _(t):
    # collect_set merges map-side; a group holds the distinct codes, not the rows.
    def codes(c):
        return F.array_join(F.array_sort(F.collect_set(c)), ", ")

    return t.orders.groupBy("o_custkey").agg(
        codes("o_orderstatus").alias("statuses"), codes("o_orderpriority").alias("priorities")
    )


@query(
    "agg_correlation",
    "A14",
    "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag",
)
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query(
    "agg_collect_members",
    "A15",
    "SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_nationkey), '|') AS members FROM nation GROUP BY n_regionkey",
)
def _(t):
    # Members of a region: a dimension of 25 rows.
    pairs = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return t.nation.groupBy("n_regionkey").agg(F.array_join(pairs["n_name"], "|").alias("members"))


@query(
    "agg_of_aggregate",
    "A17",
    f"""SELECT CASE WHEN top < 300000 THEN 'low' WHEN top < 450000 THEN 'mid' ELSE 'high' END AS tier, COUNT(*) AS customers,
              {dsum('top')} AS top_total FROM (SELECT o_custkey, MAX(o_totalprice) AS top FROM orders GROUP BY 1) GROUP BY 1""",
)
def _(t):
    tier = F.when(F.col("top") < 300000, "low").when(F.col("top") < 450000, "mid").otherwise("high")
    per = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return per.groupBy(tier.alias("tier")).agg(F.count("*").alias("customers"), total("top").alias("top_total"))


@query(
    "agg_open_high_low_close",
    "A18",
    """SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_min(value, ts) AS open, MAX(value) AS high,
              MIN(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY 1, 2""",
)
def _(t):
    at = F.struct("ts", "event_id")
    return t.events.groupBy("event_type", day("ts").alias("day")).agg(
        F.min_by("value", at).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", at).alias("close"),
    )


@query(
    "agg_histogram_bins",
    "A19",
    """SELECT LEAST(CAST(floor((o_totalprice - lo) / ((hi - lo) / 8)) AS BIGINT) + 1, 8) AS bin, COUNT(*) AS n
       FROM orders, (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders) GROUP BY 1""",
)
def _(t):
    ends = t.orders.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    # The top edge belongs to the last bin.
    raw = F.floor((F.col("o_totalprice") - lo) / ((hi - lo) / 8)) + 1
    return t.orders.groupBy(F.least(raw, F.lit(8).cast("long")).alias("bin")).agg(F.count("*").alias("n"))


@query(
    "agg_two_way_matrix",
    "A20",
    f"""SELECT c_mktsegment, {', '.join(f"COALESCE(CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) FILTER (WHERE o_orderstatus = '{s}') AS DOUBLE), 0) AS {s}" for s in 'FOP')}
       FROM {SEGMENT_ORDERS} GROUP BY c_mktsegment""",
)
def _(t):
    pivoted = segment_orders(t).groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"])
    return pivoted.agg(total("o_totalprice")).fillna(0.0, ["F", "O", "P"])


@query(
    "agg_kpi_unpivot",
    "A21",
    """SELECT r.r_name, k.kpi, k.score FROM (SELECT r_name, COUNT(*) AS customers, COUNT(DISTINCT c_nationkey) AS nations,
          COUNT(*) FILTER (WHERE c_acctbal < 0) AS in_debt FROM customer JOIN nation ON c_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey GROUP BY 1) r,
       LATERAL (VALUES ('customers', r.customers), ('nations', r.nations), ('in_debt', r.in_debt)) k(kpi, score)""",
)
def _(t):
    per = (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name")
        .agg(
            F.count("*").alias("customers"),
            F.countDistinct("c_nationkey").alias("nations"),
            F.count_if(F.col("c_acctbal") < 0).alias("in_debt"),
        )
    )
    return per.unpivot(["r_name"], ["customers", "nations", "in_debt"], "kpi", "score")


@query(
    "agg_window_percent",
    "A23",
    f"""SELECT c_mktsegment, {dsum('o_totalprice')} AS value,
              100.0::DOUBLE * {dsum('o_totalprice')} / CAST(SUM(SUM(CAST(o_totalprice AS DECIMAL(14,2)))) OVER () AS DOUBLE) AS pct
       FROM {SEGMENT_ORDERS} GROUP BY c_mktsegment""",
)
def _(t):
    per = segment_orders(t).groupBy("c_mktsegment").agg(F.sum(money("o_totalprice")).alias("v"))
    whole = per.agg(F.sum("v").cast("double").alias("x")).scalar()
    value = F.col("v").cast("double")
    return per.select("c_mktsegment", value.alias("value"), (F.lit(100.0) * value / whole).alias("pct"))
