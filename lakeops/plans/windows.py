"""Window, sort, top-k, set and subquery queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeops.functions.common import day, mean, micros, total
from lakeops.operators import ordered as o
from lakeops.plans.registry import query
from lakeops.plans.relational import SEGMENT_ORDERS, dsum, segment_orders

# --- windows ------------------------------------------------------------------------


def keyed_events(t):
    return t.events.select("event_id", "ts", "user_id", "event_type", "value")


@query(
    "window_row_number",
    "W01",
    """SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events""",
)
def _(t):
    rows = t.events.select("event_id", "event_type", "ts")
    return o.row_numbers(rows, ["event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "window_rank_dense",
    "W02 W03",
    """SELECT p_partkey, p_type, p_size, rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) AS rnk,
              dense_rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) AS dense FROM part""",
)
def _(t):
    rows = t.part.select("p_partkey", "p_type", "p_size")
    return o.rank_columns(rows, ["p_type"], ["-p_size"], {"rnk": "rank", "dense": "dense_rank"})


@query(
    "window_ntile_over_aggregate",
    "W04",
    f"""SELECT o_custkey, {dsum('o_totalprice')} AS value, ntile(4) OVER (ORDER BY SUM(CAST(o_totalprice AS DECIMAL(14,2))) DESC, o_custkey) AS tile
       FROM orders GROUP BY o_custkey""",
)
def _(t):
    per = t.orders.groupBy("o_custkey").agg(total("o_totalprice").alias("value"))
    return o.ntile(per, [], ["-value", "o_custkey"], 4, settle_input=True)


@query(
    "window_percent_rank_cume_dist",
    "W05 W06",
    """SELECT c_custkey, c_mktsegment, percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS pr,
              cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS cd FROM customer""",
)
def _(t):
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return o.rank_columns(rows, ["c_mktsegment"], ["c_acctbal"], {"pr": "percent_rank", "cd": "cume_dist"}).drop("c_acctbal")


@query(
    "window_lag_lead",
    "W07 W08",
    """SELECT event_id, lag(value) OVER w AS before_value, lead(value) OVER w AS after_value,
              epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
)
def _(t):
    rows = keyed_events(t).withColumn("us", micros("ts"))

    def build(frame, w):
        return {
            "before_value": F.lag("value").over(w),
            "after_value": F.lead("value").over(w),
            "gap_us": F.col("us") - F.lag("us").over(w),
        }

    framed = o.row_frames(rows, ["event_type"], ["ts", "event_id"], 1, 1, build)
    return framed.select("event_id", "before_value", "after_value", "gap_us")


@query(
    "window_first_last_value",
    "W09 W10",
    """SELECT event_id, first_value(value) OVER w AS first_value, last_value(value) OVER w AS last_value FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def _(t):
    outs = {"first_value": ("first", "value"), "last_value": ("last", "value")}
    return o.first_last(keyed_events(t), ["user_id"], ["ts", "event_id"], outs).select(
        "event_id", "first_value", "last_value"
    )


@query(
    "window_moving_average",
    "W11",
    """SELECT event_id, CAST(SUM(CAST(value AS DECIMAL(14,2))) OVER w AS DOUBLE) / COUNT(*) OVER w AS moving_avg FROM events
       WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def _(t):
    rows = keyed_events(t).withColumn("value", F.col("value").cast("decimal(14,2)"))

    def build(frame, w):
        return {"moving_avg": F.sum("value").over(frame).cast("double") / F.count("value").over(frame)}

    framed = o.row_frames(rows, ["event_type"], ["ts", "event_id"], 2, 0, build)
    return framed.select("event_id", "moving_avg")


@query(
    "window_running_total",
    "W12 W13",
    """SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) OVER w AS DOUBLE) AS running_value,
              COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS running_count
       FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    sums = {"running_value": F.col("o_totalprice").cast("decimal(14,2)"), "running_count": F.lit(1).cast("long")}
    out = o.running(rows, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], sums)
    return out.select("o_orderkey", F.col("running_value").cast("double").alias("running_value"), "running_count")


@query(
    "window_partition_total",
    "W14",
    """SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS orders_of_customer,
              MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS largest FROM orders""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    outs = {"orders_of_customer": F.count("*"), "largest": F.max("o_totalprice")}
    return o.key_totals(rows, ["o_custkey"], outs).drop("o_custkey", "o_totalprice")


@query(
    "window_rank_over_aggregate",
    "W15",
    f"""SELECT l_suppkey, {dsum('l_quantity')} AS qty, rank() OVER (ORDER BY SUM(CAST(l_quantity AS DECIMAL(14,2))) DESC) AS place
       FROM lineitem GROUP BY l_suppkey""",
)
def _(t):
    per = t.lineitem.groupBy("l_suppkey").agg(total("l_quantity").alias("qty"))
    return o.rank_columns(per, [], ["-qty"], {"place": "rank"})


@query(
    "agg_stacked_series",
    "A22",
    """SELECT event_type, day, n, CAST(SUM(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS stacked
       FROM (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(*) AS n FROM events GROUP BY 1, 2)""",
)
def _(t):
    per = t.events.groupBy("event_type", day("ts").alias("day")).agg(F.count("*").alias("n"))
    return o.running(per, ["event_type"], ["day"], {"stacked": F.col("n")}, settle_input=True)


# --- sort and top-k -----------------------------------------------------------------


@query(
    "sort_multi_key",
    "O01",
    f"""SELECT o_orderstatus, o_orderpriority, {dsum('o_totalprice')} AS value FROM orders
       GROUP BY 1, 2 ORDER BY o_orderstatus ASC, value DESC""",
)
def _(t):
    per = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(total("o_totalprice").alias("value"))
    return per.orderBy(F.col("o_orderstatus").asc(), F.col("value").desc())


@query(
    "sort_nulls_last_top",
    "O02",
    """SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       ORDER BY l.quality ASC NULLS LAST, d.doc_id DESC LIMIT 500""",
)
def _(t):
    rows = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.orderBy(F.col("quality").asc_nulls_last(), F.col("doc_id").desc()).limit(500)


@query(
    "sort_by_case",
    "O03",
    """SELECT o_orderkey, o_orderstatus FROM orders
       ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 300""",
)
def _(t):
    status = F.col("o_orderstatus")
    place = F.when(status == "P", 0).when(status == "O", 1).otherwise(2)
    return (
        t.orders.orderBy(place, F.col("o_totalprice").desc(), "o_orderkey").limit(300).select("o_orderkey", "o_orderstatus")
    )


@query(
    "limit_top_n",
    "O04",
    f"""SELECT o_custkey, {dsum('o_totalprice')} AS value FROM orders GROUP BY o_custkey ORDER BY value DESC, o_custkey LIMIT 10""",
)
def _(t):
    per = t.orders.groupBy("o_custkey").agg(total("o_totalprice").alias("value"))
    return per.orderBy(F.col("value").desc(), "o_custkey").limit(10)


@query(
    "top_k_per_group",
    "O05",
    """SELECT * FROM (SELECT l_suppkey, l_partkey, qty, row_number() OVER (PARTITION BY l_suppkey ORDER BY qty DESC, l_partkey) AS rn
         FROM (SELECT l_suppkey, l_partkey, CAST(SUM(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY 1, 2)) WHERE rn <= 3""",
)
def _(t):
    per = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(total("l_quantity").alias("qty"))
    out = o.top_k(per, ["l_suppkey"], ["-qty", "l_partkey"], 3)
    return out.withColumn("rn", F.col("rn").cast("long"))


@query(
    "sort_key_column",
    "O06",
    """SELECT sort_key, COUNT(*) AS docs, MIN(doc_id) AS first_doc FROM (
         SELECT doc_id, lower(translate(lang || '/' || source, 'SRC', 'src')) AS sort_key FROM documents) GROUP BY sort_key ORDER BY sort_key""",
)
def _(t):
    key = F.lower(F.translate(F.concat_ws("/", "lang", "source"), "SRC", "src"))
    return (
        t.documents.select("doc_id", key.alias("sort_key"))
        .groupBy("sort_key")
        .agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
        .orderBy("sort_key")
    )


# --- set operations, subqueries, views ----------------------------------------------


@query(
    "set_union_all",
    "U01",
    """SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""",
)
def _(t):
    c = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s)


def buyers_sellers(t):
    return (
        t.orders.select(F.col("o_custkey").alias("party")),
        t.lineitem.select(F.col("l_suppkey").alias("party")),
    )


@query("set_union_distinct", "U02", "SELECT o_custkey AS party FROM orders UNION SELECT l_suppkey FROM lineitem")
def _(t):
    a, b = buyers_sellers(t)
    return a.union(b).distinct()


@query("set_intersect", "U03", "SELECT o_custkey AS party FROM orders INTERSECT SELECT l_suppkey FROM lineitem")
def _(t):
    a, b = buyers_sellers(t)
    return a.intersect(b)


@query("set_except", "U04", "SELECT o_custkey AS party FROM orders EXCEPT SELECT l_suppkey FROM lineitem")
def _(t):
    a, b = buyers_sellers(t)
    return a.subtract(b)


@query("select_distinct", "U05", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query(
    "subquery_correlated",
    "U06",
    """SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders,
              (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest FROM customer""",
)
def _(t):
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"), F.max("o_totalprice").alias("largest")
    )
    return t.customer.select("c_custkey").join(per, "c_custkey", "left").fillna(0, ["n_orders"])


@query(
    "subquery_scalars_side_by_side",
    "U07",
    """SELECT (SELECT COUNT(*) FROM orders) AS orders, (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F') AS done,
              (SELECT MAX(o_totalprice) FROM orders) AS largest, (SELECT COUNT(DISTINCT o_custkey) FROM orders) AS buyers""",
)
def _(t):
    # All four scalars read one table, so one aggregate replaces four scans.
    return t.orders.agg(
        F.count("*").alias("orders"),
        F.count_if(F.col("o_orderstatus") == "F").alias("done"),
        F.max("o_totalprice").alias("largest"),
        F.countDistinct("o_custkey").alias("buyers"),
    )


@query(
    "cte_chain",
    "U08",
    f"""WITH per AS (SELECT o_custkey, {dsum('o_totalprice')} AS value, COUNT(*) AS n FROM orders GROUP BY 1),
             big AS (SELECT * FROM per WHERE value > 1500000), named AS (SELECT c_mktsegment, value, n FROM big JOIN customer ON o_custkey = c_custkey)
        SELECT c_mktsegment, COUNT(*) AS customers, {dsum('value')} AS value, CAST(SUM(n) AS BIGINT) AS orders FROM named GROUP BY 1""",
)
def _(t):
    per = t.orders.groupBy("o_custkey").agg(total("o_totalprice").alias("value"), F.count("*").alias("n"))
    big = per.where("value > 1500000")
    named = big.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return named.groupBy("c_mktsegment").agg(
        F.count("*").alias("customers"), total("value").alias("value"), F.sum("n").alias("orders")
    )


@query(
    "view_plain",
    "U09",
    f"""WITH segment_value AS (SELECT c_mktsegment, o_orderstatus, o_totalprice FROM {SEGMENT_ORDERS})
        SELECT c_mktsegment, COUNT(*) AS n, {dsum('o_totalprice')} / COUNT(*) AS mean_value FROM segment_value WHERE o_orderstatus = 'O' GROUP BY 1""",
)
def _(t):
    view = f"segment_value_{uuid.uuid4().hex}"  # two runs in one session have a view each
    segment_orders(t).select("c_mktsegment", "o_orderstatus", "o_totalprice").createTempView(view)
    return (
        t.spark.table(view)
        .where("o_orderstatus = 'O'")
        .groupBy("c_mktsegment")
        .agg(F.count("*").alias("n"), mean("o_totalprice").alias("mean_value"))
    )
