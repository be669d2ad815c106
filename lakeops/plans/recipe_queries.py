"""Domain recipes: compositions of the other operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.functions.common import day, day_of_week, ieee_divide, micros, money, net, total
from lakeops.operators import ordered as o
from lakeops.operators.changes import Branch, merge
from lakeops.operators.joins import overlap_counts
from lakeops.plans.message_queries import s
from lakeops.plans.registry import query
from lakeops.plans.relational import NET, OVERLAP_SQL, bookings, dsum, overlap_join
from lakeops.plans.source_queries import RESOURCE, bundles
from lakeops.sources import segments as sg
from lakeops.sources.flatten import unbundle

STAGES = ("signup", "view", "click", "purchase")


@query(
    "recipe_funnel",
    "D01",
    """WITH u AS (SELECT user_id, user_id % 3 AS channel, bool_or(event_type = 'signup') AS a, bool_or(event_type = 'view' AND value > 50) AS b,
            bool_or(event_type = 'click' AND value > 100) AS c, bool_or(event_type = 'purchase' AND value > 150) AS d FROM events GROUP BY 1)
       SELECT channel, COUNT(*) FILTER (WHERE a) AS signup, COUNT(*) FILTER (WHERE a AND b) AS view, COUNT(*) FILTER (WHERE a AND b AND c) AS click,
              COUNT(*) FILTER (WHERE a AND b AND c AND d) AS purchase FROM u GROUP BY 1""",
)
def _(t):
    level = {"signup": 0, "view": 50, "click": 100, "purchase": 150}
    flags = [F.bool_or((F.col("event_type") == x) & (F.col("value") > level[x])).alias(f"is_{x}") for x in STAGES]
    per = t.events.groupBy("user_id", F.pmod("user_id", F.lit(3)).alias("channel")).agg(*flags)
    out, passed = [], F.lit(True)
    for x in STAGES:
        passed = passed & F.col(f"is_{x}")
        out.append(F.count_if(passed).alias(x))
    return per.groupBy("channel").agg(*out)


@query(
    "recipe_churn_relabel",
    "D02",
    """WITH b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 200)
       SELECT event_type, CASE WHEN event_type = 'click' AND user_id NOT IN (SELECT user_id FROM b) THEN 'churned' ELSE 'active' END AS label, COUNT(*) AS n FROM events GROUP BY ALL""",
)
def _(t):
    buyers = t.events.where("event_type = 'purchase' AND value > 200").select("user_id").distinct()
    users = t.events.select("user_id").distinct().join(buyers, "user_id", "left_anti")
    rows = t.events.select("event_id", "user_id", "event_type", F.lit("active").alias("label"))
    churned = Branch("update", F.col("t.event_type") == "click", {"label": F.lit("churned")})
    return merge(rows, users, ["user_id"], [churned]).groupBy("event_type", "label").agg(F.count("*").alias("n"))


@query(
    "recipe_current_state",
    "D03",
    "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, epoch_us(MAX(ts)) AS since_us FROM events GROUP BY 1",
)
def _(t):
    at = F.struct("ts", "event_id")
    return t.events.groupBy("user_id").agg(F.max_by("event_type", at).alias("state"), micros(F.max("ts")).alias("since_us"))


@query(
    "recipe_case_steps",
    "D04",
    """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, COUNT(*) OVER (PARTITION BY user_id) AS steps FROM events""",
)
def _(t):
    rows = t.events.select("event_id", "user_id", "ts")
    return o.row_numbers(rows, ["user_id"], ["ts", "event_id"], "step", total="steps").drop("ts")


@query(
    "recipe_payload_breakdown",
    "D05",
    f"""SELECT json_extract_string(props, '$.k') AS reason, event_type, COUNT(*) AS n, {dsum('value')} AS amount FROM events GROUP BY 1, 2""",
)
def _(t):
    reason = F.get_json_object("props", "$.k").alias("reason")
    return t.events.groupBy(reason, "event_type").agg(F.count("*").alias("n"), total("value").alias("amount"))


@query(
    "recipe_room_conflicts",
    "D06",
    f"SELECT user_id, COUNT(*) AS conflicts, COUNT(DISTINCT first_id) AS meetings FROM ({OVERLAP_SQL}) GROUP BY 1",
)
def _(t):
    pairs = overlap_join(bookings(t), ["user_id", "event_type"], "event_id", "s", "e")
    return pairs.groupBy("user_id").agg(F.count("*").alias("conflicts"), F.countDistinct("first_id").alias("meetings"))


@query(
    "recipe_room_load",
    "D06",
    f"""WITH p AS ({OVERLAP_SQL}), m AS (SELECT first_id AS event_id FROM p UNION ALL SELECT second_id FROM p),
             c AS (SELECT event_id, COUNT(*) AS n FROM m GROUP BY 1)
        SELECT user_id, COUNT(*) AS bookings, COUNT(n) AS in_conflict, CAST(COALESCE(SUM(n), 0) AS BIGINT) // 2 AS conflicts, COALESCE(MAX(n), 0) AS most
        FROM events LEFT JOIN c USING (event_id) GROUP BY 1""",
)
def _(t):
    # Counted by a sweep: no pair is listed.
    per = overlap_counts(bookings(t), ["user_id", "event_type"], "event_id", "s", "e")
    n = F.col("overlaps")
    return per.groupBy("user_id").agg(
        F.count("*").alias("bookings"), F.count_if(n > 0).alias("in_conflict"), F.floor(F.sum(n) / 2).alias("conflicts"), F.max(n).alias("most")
    )


@query(
    "recipe_durations",
    "D07",
    """SELECT event_type, CASE WHEN CAST(ts AS DATE) = CAST(ts + to_microseconds(CAST(value * 60000000 AS BIGINT)) AS DATE) THEN 'same day' ELSE 'overnight' END AS kind,
              COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(14,2))) AS DOUBLE) AS minutes FROM events GROUP BY ALL""",
)
def _(t):
    end = F.timestamp_micros(micros("ts") + F.round(F.col("value") * 60_000_000).cast("long"))
    kind = F.when(F.to_date("ts") == F.to_date(end), "same day").otherwise("overnight")
    return t.events.groupBy("event_type", kind.alias("kind")).agg(F.count("*").alias("n"), total("value").alias("minutes"))


@query(
    "recipe_attendance",
    "D08",
    """SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, CAST(month(ts) AS INTEGER) AS month, CAST(dayofweek(ts) AS INTEGER) AS dow,
              CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS band,
              COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM events GROUP BY ALL""",
)
def _(t):
    h = F.hour("ts")
    band = F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")
    return t.events.groupBy(
        day(F.date_trunc("week", "ts")).alias("week"), F.month("ts").alias("month"), day_of_week("ts").alias("dow"), band.alias("band")
    ).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    "recipe_return_and_range",
    "D09",
    """SELECT user_id, arg_min(value, (ts, event_id)) AS first_close, arg_max(value, (ts, event_id)) AS last_close,
              (arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))) * 100 / arg_min(value, (ts, event_id)) AS return_pct,
              (MAX(value) - MIN(value)) * 100 / MIN(value) AS range_pct FROM events GROUP BY 1""",
)
def _(t):
    at = F.struct("ts", "event_id")
    per = t.events.groupBy("user_id").agg(
        F.min_by("value", at).alias("first_close"),
        F.max_by("value", at).alias("last_close"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )
    first, last, lo, hi = (F.col(c) for c in ("first_close", "last_close", "lo", "hi"))
    # A first or lowest value of 0 gives an infinity or NaN, as in the SQL.
    return per.withColumns({"return_pct": ieee_divide((last - first) * 100, first), "range_pct": ieee_divide((hi - lo) * 100, lo)}).drop("lo", "hi")


PAID = "CAST(CAST(o_totalprice AS DECIMAL(14,2)) * CASE o_orderstatus WHEN 'F' THEN CAST(1 AS DECIMAL(3,2)) WHEN 'P' THEN CAST(0.8 AS DECIMAL(3,2)) ELSE CAST(0.5 AS DECIMAL(3,2)) END AS DECIMAL(14,2))"


def claims(t):
    """A claim (837) and its payment (835) per order, as one interchange."""
    share = F.when(F.col("o_orderstatus") == "F", F.lit("1.00")).when(F.col("o_orderstatus") == "P", F.lit("0.80")).otherwise(F.lit("0.50"))
    paid = (money("o_totalprice") * share.cast("decimal(3,2)")).cast("decimal(14,2)")
    body = F.concat(
        F.lit("ISA*00*  *00*  *ZZ*PAYER*ZZ*CLINIC*980601*1200*U*00401*"), s("o_orderkey"), F.lit("*0*P*:~GS*HC*A*B*1*1*1*X*1~ST*837*1~CLM*C"), s("o_orderkey"),
        F.lit("*"), money("o_totalprice").cast("string"), F.lit("~REF*PR*"), s("o_orderpriority"), F.lit("~SE*3*1~ST*835*2~CLP*C"), s("o_orderkey"),
        F.lit("*1*"), money("o_totalprice").cast("string"), F.lit("*"), paid.cast("string"), F.lit("~SE*3*2~GE*2*1~IEA*1*1~"),
    )
    rows = sg.parse_messages(t.orders.select(body.alias("body")), "body", sg.X12)
    flat = sg.materialize(rows, ["clm_1", "clm_2", "ref_2", "clp_1", "clp_4"], sg.X12)
    # Claims are parsed once; a claim and its payment meet in one aggregate.
    amount = "decimal(14,2)"
    per = flat.groupBy(F.coalesce("clm_1", "clp_1").alias("claim")).agg(
        F.max(F.col("clm_2").try_cast(amount)).alias("charged"),
        F.max("ref_2").alias("priority"),
        F.max(F.col("clp_4").try_cast(amount)).alias("paid"),
        F.count("clm_1").alias("claims"),
    )
    return per.where("claims > 0").drop("claims")


@query(
    "recipe_claim_vs_payment",
    "D10",
    f"SELECT 'C' || o_orderkey AS claim, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS charged, CAST({PAID} AS DOUBLE) AS paid, {PAID} >= CAST(o_totalprice AS DECIMAL(14,2)) AS settled FROM orders",
)
def _(t):
    return claims(t).select(
        "claim", F.col("charged").cast("double").alias("charged"), F.col("paid").cast("double").alias("paid"), (F.col("paid") >= F.col("charged")).alias("settled")
    )


@query(
    "recipe_write_off_rate",
    "D22",
    f"""SELECT o_orderpriority AS priority, COUNT(*) AS claims, (CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) - CAST(SUM({PAID}) AS DOUBLE)) / CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS write_off
        FROM orders GROUP BY 1""",
)
def _(t):
    charged, paid = F.sum("charged").cast("double"), F.sum("paid").cast("double")
    return claims(t).groupBy("priority").agg(F.count("*").alias("claims"), ((charged - paid) / charged).alias("write_off"))


def stages(t):
    """(order, customer, stage, date) by document type; a stage has one date per order."""
    ship = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_shipdate").alias("shipped"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("returned")
    )
    return t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("ordered")).join(ship, "o_orderkey", "left")


STAGE_SQL = """SELECT o_orderkey, o_custkey, o_orderdate AS ordered, shipped, returned FROM orders LEFT JOIN
  (SELECT l_orderkey, MIN(l_shipdate) AS shipped, MAX(l_shipdate) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""


@query(
    "recipe_document_timeline",
    "D11",
    f"""SELECT o_orderkey, CAST(CAST(coalesce(returned, shipped, ordered) AS DATE) AS VARCHAR) AS last_document,
               CASE WHEN returned IS NOT NULL THEN 'return' WHEN shipped IS NOT NULL THEN 'shipment' ELSE 'order' END AS stage FROM ({STAGE_SQL})""",
)
def _(t):
    stage = F.when(F.col("returned").isNotNull(), "return").when(F.col("shipped").isNotNull(), "shipment").otherwise("order")
    return stages(t).select("o_orderkey", day(F.coalesce("returned", "shipped", "ordered")).alias("last_document"), stage.alias("stage"))


@query(
    "recipe_partner_stages",
    "D12",
    f"""WITH s AS ({STAGE_SQL}), u AS (SELECT o_custkey, 'ordered' AS stage FROM s UNION ALL SELECT o_custkey, 'shipped' FROM s WHERE shipped IS NOT NULL UNION ALL SELECT o_custkey, 'returned' FROM s WHERE returned IS NOT NULL)
        SELECT o_custkey, string_agg(DISTINCT stage, ', ' ORDER BY stage) AS stages, COUNT(*) AS documents FROM u GROUP BY 1""",
)
def _(t):
    long = stages(t).unpivot(["o_orderkey", "o_custkey"], ["ordered", "shipped", "returned"], "stage", "at").where("at IS NOT NULL")
    return long.groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_set("stage")), ", ").alias("stages"), F.count("*").alias("documents")
    )


@query(
    "recipe_invoice_reconciliation",
    "D13",
    """SELECT CAST(o_orderkey AS VARCHAR) AS document, o_totalprice AS ordered, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 WHEN o_orderstatus = 'F' THEN o_totalprice END AS invoiced,
              CASE o_orderstatus WHEN 'P' THEN 'differs' WHEN 'F' THEN 'matched' ELSE 'no invoice' END AS verdict FROM orders""",
)
def _(t):
    key, price = s("o_orderkey"), F.col("o_totalprice")
    order = F.concat(F.lit("UNB+UNOA:2+B+S+1:1+1'UNH+1+ORDERS:D:96A:UN'BGM+220+"), key, F.lit("+9'MOA+86:"), price.cast("string"), F.lit("'UNT+4+1'"))
    billed = F.when(F.col("o_orderstatus") == "P", price + 1).otherwise(price).cast("string")
    invoice = F.concat(F.lit("UNH+2+INVOIC:D:96A:UN'BGM+380+"), key, F.lit("+9'MOA+77:"), billed, F.lit("'UNT+4+2'"))
    body = F.concat(order, F.when(F.col("o_orderstatus") != "O", invoice).otherwise(F.lit("")), F.lit("UNZ+1+1'"))
    rows = sg.parse_messages(t.orders.select(body.alias("body")), "body", sg.EDIFACT)
    flat = sg.materialize(rows, ["bgm_2", "moa_1"], sg.EDIFACT).select(
        F.get(sg.components(sg.header_column("UNH", 2)), F.lit(0)).alias("kind"),
        F.col("bgm_2").alias("document"),
        F.split_part("moa_1", F.lit(":"), F.lit(2)).try_cast("double").alias("amount"),
    )
    # Documents are parsed once; an order and its invoice meet in one aggregate.
    per = flat.groupBy("document").agg(
        F.max(F.when(F.col("kind") == "ORDERS", F.col("amount"))).alias("ordered"),
        F.max(F.when(F.col("kind") == "INVOIC", F.col("amount"))).alias("invoiced"),
        F.count_if(F.col("kind") == "ORDERS").alias("orders"),
    )
    verdict = F.when(F.col("invoiced").isNull(), "no invoice").when(F.col("invoiced") == F.col("ordered"), "matched").otherwise("differs")
    return per.where("orders > 0").drop("orders").withColumn("verdict", verdict)


@query(
    "recipe_observations_per_day",
    "D16",
    f"""SELECT 'urn:uuid:p' || o_custkey AS patient, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS on_day, COUNT(*) AS observations, {dsum('o_totalprice')} AS value FROM orders GROUP BY 1, 2""",
)
def _(t):
    obs = unbundle(bundles(t), "body", RESOURCE, ("Observation",))
    return obs.groupBy(F.col("resource.subject.reference").alias("patient"), F.substring("bundle_timestamp", 1, 10).alias("on_day")).agg(
        F.count("*").alias("observations"), total("resource.valueQuantity.value").alias("value")
    )


@query(
    "recipe_reorder_worklist",
    "D19",
    """SELECT p_partkey, p_name, p_size AS stock, CAST(COALESCE(q, 0) / 40 AS DOUBLE) AS reorder_level FROM part LEFT JOIN (SELECT l_partkey, SUM(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
       WHERE p_size < COALESCE(q, 0) / 40 ORDER BY p_size, p_partkey""",
)
def _(t):
    sold = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(total("l_quantity").alias("q"))
    level = F.coalesce("q", F.lit(0.0)) / 40
    rows = t.part.join(sold, "p_partkey", "left").select("p_partkey", "p_name", F.col("p_size").alias("stock"), level.alias("reorder_level"))
    return rows.where("stock < reorder_level").orderBy("stock", "p_partkey")


@query(
    "recipe_time_report",
    "D20",
    f"""WITH m AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(month(o_orderdate) AS INTEGER) AS m, SUM({NET}) AS v, COUNT(*) AS n
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)
        SELECT y, q, m, CAST(v AS DOUBLE) AS revenue, n, CAST(SUM(v) OVER (PARTITION BY y ORDER BY m) AS DOUBLE) AS year_to_date FROM m""",
)
def _(t):
    per = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.month("o_orderdate").alias("m"))
        .agg(F.sum(net("l_extendedprice", "l_discount")).alias("v"), F.count("*").alias("n"))
    )
    out = o.running(per, ["y"], ["m"], {"ytd": F.col("v")}, settle_input=True)
    return out.select("y", "q", "m", F.col("v").cast("double").alias("revenue"), "n", F.col("ytd").cast("double").alias("year_to_date"))
