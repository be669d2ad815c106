"""MERGE, UPDATE, DELETE and history queries.

Targets and feeds come from lineitem: what an order had shipped before the cut-over day
is the target, what shipped after is the feed.  Some orders are in both, some in one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.functions.common import day, micros, total
from lakeops.operators import changes as c
from lakeops.operators import snapshots as s
from lakeops.operators.ordered import latest, row_frames
from lakeops.plans.registry import query
from lakeops.session import scratch_path

CUT = "1998-06-01"


def shipped(t, before: bool, keys=("l_orderkey",)):
    side = F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")
    per = t.lineitem.where(side if before else ~side).groupBy(*keys)
    return per.agg(
        F.count("*").alias("lines"), total("l_quantity").alias("qty"), F.max(day("l_shipdate")).alias("last_ship")
    ).withColumn("state", F.lit("new"))


def shipped_sql(before: bool, keys="l_orderkey") -> str:
    return f"""SELECT {keys}, COUNT(*) AS lines, CAST(SUM(CAST(l_quantity AS DECIMAL(14,2))) AS DOUBLE) AS qty,
      MAX(CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS last_ship, 'new' AS state FROM lineitem
      WHERE l_shipdate {'<' if before else '>='} TIMESTAMP '{CUT}' GROUP BY {keys}"""


TS = f"WITH t AS ({shipped_sql(True)}), s AS ({shipped_sql(False)}) "
JOINED = "t FULL JOIN s ON t.l_orderkey = s.l_orderkey"


def src(name: str):
    """A column of the merge source."""
    return F.col(f"s.{name}")


def src_row(**changed):
    """All columns of a feed row, some replaced."""
    return {k: src(k) for k in ("l_orderkey", "lines", "qty", "last_ship", "state")} | changed


@query(
    "update_expressions",
    "M01",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
              CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS o_orderpriority,
              CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_totalprice > 300000 THEN 'X' ELSE 'Y' END ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)
def _(t):
    df = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    values = {
        "o_totalprice": F.col("o_totalprice") * 2,
        "o_orderpriority": F.lit(None),
        "o_orderstatus": F.when(F.col("o_totalprice") > 300000, "X").otherwise("Y"),
    }
    return c.update(df, F.col("o_orderstatus") == "O", values)


@query(
    "delete_null_safe",
    "M02",
    """SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(l.quality = 0, false)""",
)
def _(t):
    rows = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return c.delete(rows, F.col("quality") == 0)


@query(
    "merge_upsert",
    "M03",
    TS
    + f"""SELECT coalesce(s.l_orderkey, t.l_orderkey) AS l_orderkey, coalesce(s.lines, t.lines) AS lines, coalesce(s.qty, t.qty) AS qty,
          coalesce(s.last_ship, t.last_ship) AS last_ship, coalesce(s.state, t.state) AS state FROM {JOINED}""",
)
def _(t):
    return c.upsert(shipped(t, True), shipped(t, False), ["l_orderkey"])


def branches():
    """Update large feeds, delete when the feed ships nothing much, else keep; insert small ones as 'late'."""
    matched = [
        c.Branch("update", F.col("s.qty") > 60, {"qty": src("qty"), "state": F.lit("big")}),
        c.Branch("delete", F.col("s.lines") == 1),
        c.Branch("update", F.col("s.qty") > 40, {"state": F.lit("mid")}),
    ]
    fresh = [c.Branch("insert", F.col("s.lines") >= 2, src_row(state=F.lit("late")))]
    return matched, fresh


@query(
    "merge_conditional_branches",
    "M04",
    TS
    + f"""SELECT coalesce(t.l_orderkey, s.l_orderkey) AS l_orderkey, coalesce(t.lines, s.lines) AS lines,
          CASE WHEN t.l_orderkey IS NULL OR s.qty > 60 THEN s.qty ELSE t.qty END AS qty, coalesce(t.last_ship, s.last_ship) AS last_ship,
          CASE WHEN t.l_orderkey IS NULL THEN 'late' WHEN s.qty > 60 THEN 'big' WHEN s.qty > 40 THEN 'mid' ELSE t.state END AS state
        FROM {JOINED} WHERE CASE WHEN t.l_orderkey IS NULL THEN s.lines >= 2 WHEN s.l_orderkey IS NULL THEN true
          WHEN s.qty > 60 THEN true WHEN s.lines = 1 THEN false ELSE true END""",
)
def _(t):
    return c.merge(shipped(t, True), shipped(t, False), ["l_orderkey"], *branches())


@query(
    "merge_not_matched_by_source",
    "M05 M20",
    TS
    + f"""SELECT coalesce(t.l_orderkey, s.l_orderkey) AS l_orderkey, CASE WHEN t.l_orderkey IS NULL THEN s.lines ELSE t.lines END AS lines,
          CASE WHEN s.l_orderkey IS NULL THEN t.qty ELSE s.qty END AS qty, coalesce(t.last_ship, s.last_ship) AS last_ship,
          CASE WHEN s.l_orderkey IS NULL THEN 'inactive' ELSE 'active' END AS state FROM {JOINED}
          WHERE NOT (s.l_orderkey IS NULL AND t.last_ship < '1995-06-01')""",
)
def _(t):
    return c.merge(
        shipped(t, True),
        shipped(t, False),
        ["l_orderkey"],
        [c.Branch("update", None, {"qty": src("qty"), "state": F.lit("active")})],
        [c.Branch("insert", None, src_row(state=F.lit("active")))],
        [
            c.Branch("delete", F.col("t.last_ship") < "1995-06-01"),
            c.Branch("update", None, {"state": F.lit("inactive")}),
        ],
    )


@query(
    "merge_affected_rows",
    "M21",
    TS
    + f"""SELECT action, COUNT(*) AS n_rows FROM (SELECT CASE WHEN t.l_orderkey IS NULL THEN CASE WHEN s.lines >= 2 THEN 'insert' END
          WHEN s.l_orderkey IS NULL THEN NULL WHEN s.qty > 60 THEN 'update' WHEN s.lines = 1 THEN 'delete' WHEN s.qty > 40 THEN 'update' END AS action
          FROM {JOINED}) WHERE action IS NOT NULL GROUP BY action""",
)
def _(t):
    return c.affected(c.merge_actions(shipped(t, True), shipped(t, False), ["l_orderkey"], *branches()))


LAST_ORDER_SQL = """SELECT o_custkey AS custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority,
  CAST(CAST(MAX(o_orderdate) AS DATE) AS VARCHAR) AS d FROM orders WHERE o_orderdate {} TIMESTAMP '1998-06-01' GROUP BY 1"""


def last_orders(t, before: bool):
    side = F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz")
    rows = t.orders.where(side if before else ~side).select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"), "o_orderdate", "o_orderkey"
    )
    return latest(rows, ["custkey"], ["o_orderdate", "o_orderkey"]).select("custkey", "priority", day("o_orderdate").alias("d"))


@query(
    "scd_type2_merge",
    "M06",
    f"""WITH dim AS ({LAST_ORDER_SQL.format('<')}), ch AS ({LAST_ORDER_SQL.format('>=')}),
          news AS (SELECT ch.* FROM ch LEFT JOIN dim USING (custkey) WHERE ch.priority IS DISTINCT FROM dim.priority)
        SELECT dim.custkey, dim.priority, dim.d AS valid_from, news.d AS valid_to, CASE WHEN news.d IS NULL THEN 1 ELSE 0 END AS is_current
          FROM dim LEFT JOIN news USING (custkey)
        UNION ALL SELECT custkey, priority, d, NULL, 1 FROM news""",
)
def _(t):
    dim = last_orders(t, True).select(
        "custkey",
        "priority",
        F.col("d").alias("valid_from"),
        F.lit(None).cast("string").alias("valid_to"),
        F.lit(1).alias("is_current"),
    )
    return c.scd2(dim, last_orders(t, False), "custkey", ["priority"], "d")


@query(
    "scd_type2_history",
    "M06",
    """SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS valid_from, epoch_us(lead(o_orderdate) OVER w) AS valid_to,
              CASE WHEN lead(o_orderkey) OVER w IS NULL THEN 1 ELSE 0 END AS is_current
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", micros("o_orderdate").alias("valid_from"))

    def build(frame, w):
        return {
            "valid_to": F.lead("valid_from").over(w),
            "is_current": F.when(F.lead("o_orderkey").over(w).isNull(), 1).otherwise(0),
        }

    return row_frames(rows, ["o_custkey"], ["valid_from", "o_orderkey"], 0, 1, build)


EV_SQL = """SELECT user_id, event_type, arg_max(value, event_id) AS value, MAX(event_id) AS event_id FROM events
  WHERE ts {} TIMESTAMP '2024-01-20' GROUP BY 1, 2"""


@query(
    "merge_after_dedup",
    "M07",
    f"""WITH t AS ({EV_SQL.format('<')}), s AS ({EV_SQL.format('>=')})
        SELECT coalesce(s.user_id, t.user_id) AS user_id, coalesce(s.event_type, t.event_type) AS event_type,
               coalesce(s.value, t.value) AS value, coalesce(s.event_id, t.event_id) AS event_id
        FROM t FULL JOIN s ON t.user_id = s.user_id AND t.event_type = s.event_type""",
)
def _(t):
    early = F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    cols = ["user_id", "event_type", "value", "event_id"]
    target = latest(t.events.where(early).select(*cols), ["user_id", "event_type"], ["event_id"])
    return c.dedup_then_upsert(target, t.events.where(~early).select(*cols), ["user_id", "event_type"], ["event_id"])


@query(
    "merge_idempotent_replay",
    "M08",
    TS + f"SELECT 0::BIGINT AS missing, 0::BIGINT AS extra, (SELECT COUNT(*) FROM {JOINED}) AS n_rows",
)
def _(t):
    feed = shipped(t, False)
    once = c.upsert(shipped(t, True), feed, ["l_orderkey"])
    twice = c.upsert(once, feed, ["l_orderkey"])
    n = twice.agg(F.count("*").alias("n_rows"))
    missing = once.exceptAll(twice).agg(F.count("*").alias("x")).scalar()
    extra = twice.exceptAll(once).agg(F.count("*").alias("x")).scalar()
    return n.select(missing.alias("missing"), extra.alias("extra"), "n_rows")


@query(
    "merge_composite_key",
    "M09",
    f"""WITH t AS ({shipped_sql(True, 'l_partkey, l_suppkey')}), s AS ({shipped_sql(False, 'l_partkey, l_suppkey')})
        SELECT coalesce(s.l_partkey, t.l_partkey) AS l_partkey, coalesce(s.l_suppkey, t.l_suppkey) AS l_suppkey, coalesce(s.lines, t.lines) AS lines,
          coalesce(s.qty, t.qty) AS qty, coalesce(s.last_ship, t.last_ship) AS last_ship, 'new' AS state
        FROM t FULL JOIN s ON t.l_partkey = s.l_partkey AND t.l_suppkey = s.l_suppkey""",
)
def _(t):
    keys = ("l_partkey", "l_suppkey")
    return c.upsert(shipped(t, True, keys), shipped(t, False, keys), list(keys))


@query(
    "merge_three_feeds",
    "M10",
    """WITH sh AS (SELECT l_orderkey AS k, CAST(CAST(MAX(l_shipdate) AS DATE) AS VARCHAR) AS d FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
            pay AS (SELECT l_orderkey AS k, CAST(SUM(CAST(l_quantity AS DECIMAL(14,2))) AS DOUBLE) AS q FROM lineitem WHERE l_discount >= 0.08 GROUP BY 1),
            ret AS (SELECT l_orderkey AS k, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
       SELECT o_orderkey, coalesce('shipped ' || sh.d, 'waiting') AS shipping, coalesce(pay.q, 0) AS discounted_qty,
              CASE WHEN ret.n > 2 THEN 'many' WHEN ret.n > 0 THEN 'some' ELSE 'none' END AS returns
       FROM orders LEFT JOIN sh ON sh.k = o_orderkey LEFT JOIN pay ON pay.k = o_orderkey LEFT JOIN ret ON ret.k = o_orderkey""",
)
def _(t):
    target = t.orders.select(
        "o_orderkey",
        F.lit("waiting").alias("shipping"),
        F.lit(0.0).alias("discounted_qty"),
        F.lit("none").alias("returns"),
    )
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    feeds = [
        (lines.where("l_linestatus = 'F'").groupBy("o_orderkey").agg(day(F.max("l_shipdate")).alias("d")),
         {"shipping": F.concat(F.lit("shipped "), F.col("s.d"))}),
        (lines.where("l_discount >= 0.08").groupBy("o_orderkey").agg(total("l_quantity").alias("q")),
         {"discounted_qty": F.col("s.q")}),
        (lines.where("l_returnflag = 'R'").groupBy("o_orderkey").agg(F.count("*").alias("n")),
         {"returns": F.when(F.col("s.n") > 2, "many").otherwise("some")}),
    ]
    for feed, values in feeds:
        target = c.merge(target, feed, ["o_orderkey"], [c.Branch("update", None, values)])
    return target


@query(
    "merge_additive_from_subquery",
    "M11",
    TS
    + f"""SELECT coalesce(t.l_orderkey, s.l_orderkey) AS l_orderkey, coalesce(t.lines, 0) + coalesce(s.lines, 0) AS lines,
          coalesce(t.qty, 0) + coalesce(s.qty, 0) AS qty, coalesce(s.last_ship, t.last_ship) AS last_ship,
          coalesce(t.state, 'new') AS state FROM {JOINED}""",
)
def _(t):
    add = {x: F.col(f"t.{x}") + F.col(f"s.{x}") for x in ("lines", "qty")}
    matched = [c.Branch("update", None, {**add, "last_ship": src("last_ship")})]
    return c.merge(shipped(t, True), shipped(t, False), ["l_orderkey"], matched, [c.Branch("insert", None, src_row())])


@query(
    "merge_computed_columns",
    "M12",
    TS
    + f"""SELECT coalesce(t.l_orderkey, s.l_orderkey) AS l_orderkey, coalesce(s.lines, t.lines) AS lines, coalesce(s.qty, t.qty) AS qty,
          coalesce(s.last_ship, t.last_ship) AS last_ship,
          CASE WHEN s.l_orderkey IS NULL THEN t.state WHEN t.l_orderkey IS NULL THEN CASE WHEN s.qty > 100 THEN 'insert-large' ELSE 'insert-small' END
               WHEN s.qty >= t.qty THEN 'grew' ELSE 'shrank' END AS state FROM {JOINED}""",
)
def _(t):
    grew = F.when(F.col("s.qty") >= F.col("t.qty"), "grew").otherwise("shrank")
    size = F.when(F.col("s.qty") > 100, "insert-large").otherwise("insert-small")
    return c.merge(
        shipped(t, True),
        shipped(t, False),
        ["l_orderkey"],
        [c.Branch("update", None, {"lines": src("lines"), "qty": src("qty"), "last_ship": src("last_ship"), "state": grew})],
        [c.Branch("insert", None, src_row(state=size))],
    )


@query(
    "merge_partition_scoped",
    "M13",
    """WITH t AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, o_totalprice AS price FROM orders),
            s AS (SELECT o_orderkey, y, price * 2 AS price FROM t WHERE y >= 2000 AND price > 250000)
       SELECT t.y, COUNT(*) AS n_rows, COUNT(s.o_orderkey) AS updated, CAST(SUM(CAST(coalesce(s.price, t.price) AS DECIMAL(14,2))) AS DOUBLE) AS value,
              t.y >= 2000 AS rewritten FROM t LEFT JOIN s ON t.o_orderkey = s.o_orderkey GROUP BY t.y""",
)
def _(t):
    base = t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("price"), F.lit(0).alias("hit"))
    feed = base.where("y >= 2000 AND price > 250000").withColumns({"price": F.col("price") * 2, "hit": F.lit(1)})
    rewritten, untouched = c.merge_partitions(base, feed, ["o_orderkey"], "y")
    both = rewritten.withColumn("rewritten", F.lit(True)).unionByName(untouched.withColumn("rewritten", F.lit(False)))
    return both.groupBy("y", "rewritten").agg(
        F.count("*").alias("n_rows"), F.sum("hit").alias("updated"), total("price").alias("value")
    )


@query(
    "update_multi_pass_cleansing",
    "M14",
    """SELECT doc_id, CASE WHEN lower(trim('  ' || upper(lang) || ' ')) = 'de' THEN 'ger' ELSE lower(trim('  ' || upper(lang) || ' ')) END AS lang,
              replace(lpad(substr(source, 4), 4, '0'), '00', 'S') AS source FROM documents""",
)
def _(t):
    messy = t.documents.select("doc_id", F.concat(F.lit("  "), F.upper("lang"), F.lit(" ")).alias("lang"), F.substr("source", F.lit(4)).alias("source"))
    every = F.lit(True)
    return c.update_passes(
        messy,
        [
            (every, {"lang": F.trim("lang")}),
            (every, {"lang": F.lower("lang")}),
            (F.col("lang") == "de", {"lang": F.lit("ger")}),
            (every, {"source": F.lpad("source", 4, "0")}),
            (every, {"source": F.replace("source", F.lit("00"), F.lit("S"))}),
        ],
    )


@query(
    "update_sentinel_then_backfill",
    "M15",
    """SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END, 0) AS balance,
              coalesce(nullif(c_mktsegment, 'MACHINERY'), 'UNKNOWN') AS segment FROM customer""",
)
def _(t):
    rows = t.customer.select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, -999.0).otherwise(F.col("c_acctbal")).alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    every = F.lit(True)
    return c.update_passes(
        rows,
        [
            (every, {"balance": F.nullif("balance", F.lit(-999.0)), "segment": F.nullif("segment", F.lit("MACHINERY"))}),
            (F.col("balance").isNull(), {"balance": F.lit(0.0)}),
            (F.col("segment").isNull(), {"segment": F.lit("UNKNOWN")}),
        ],
    )


@query(
    "erase_personal_data",
    "M16",
    """WITH gone AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 495000)
       SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN c_name END AS c_name, CASE WHEN o_custkey IS NULL THEN c_mktsegment ELSE '[ERASED]' END AS c_mktsegment,
              c_acctbal, o_custkey IS NOT NULL AS still_in_old_version FROM customer LEFT JOIN gone ON c_custkey = o_custkey""",
)
def _(t):
    gone = t.orders.where("o_totalprice > 495000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    old = t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    erase = [c.Branch("update", None, {"c_name": F.lit(None), "c_mktsegment": F.lit("[ERASED]")})]
    new = c.merge(old, gone, ["c_custkey"], erase)
    exposed = old.select("c_custkey", F.col("c_name").alias("_old"))
    return new.join(exposed, "c_custkey").select(
        *new.columns, (F.col("_old").isNotNull() & F.col("c_name").isNull()).alias("still_in_old_version")
    )


@query(
    "append_only_guard",
    "M17",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice < 30000 THEN 'deleted' ELSE 'updated' END AS violation FROM orders
       WHERE (o_orderstatus = 'F' AND o_totalprice < 30000) OR (o_orderstatus = 'P' AND o_totalprice > 480000)""",
)
def _(t):
    old = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    pending = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 480000)
    new = c.update(old, pending, {"o_orderstatus": F.lit("F")})
    new = c.delete(new, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 30000))
    return c.append_only_violations(old, new, ["o_orderkey"])


@query(
    "deletes_by_equality",
    "M18",
    """SELECT l_suppkey, COUNT(*) AS kept FROM lineitem WHERE (l_orderkey, l_suppkey) NOT IN
       (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) GROUP BY 1""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_suppkey")
    doomed = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 45").select("l_orderkey", "l_suppkey")
    return c.equality_deletes(rows, doomed).groupBy("l_suppkey").agg(F.count("*").alias("kept"))


@query(
    "deletes_by_position",
    "M19",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'F')",
)
def _(t):
    rows = t.orders.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))
    doomed = rows.where("o_orderpriority = '5-LOW' AND o_orderstatus = 'F'").select("file_name", "row_index")
    return c.position_deletes(rows, doomed).select("o_orderkey", "o_totalprice")


@query(
    "update_across_partitions",
    "M22",
    """SELECT r_name, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE c_acctbal > 9000) AS updated,
              CAST(SUM(CAST(CASE WHEN c_acctbal > 9000 THEN 9000 ELSE c_acctbal END AS DECIMAL(14,2))) AS DOUBLE) AS balance
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def _(t):
    rows = (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("r_name", "c_acctbal", F.lit(0).alias("hit"))
    )
    new = c.update(rows, F.col("c_acctbal") > 9000, {"c_acctbal": F.lit(9000.0), "hit": F.lit(1)})
    return new.groupBy("r_name").agg(
        F.count("*").alias("n_rows"), F.sum("hit").alias("updated"), total("c_acctbal").alias("balance")
    )


@query("reload_table", "M23", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal >= 0")
def _(t):
    path = scratch_path(t.spark, "reload")
    t.supplier.write.mode("overwrite").parquet(path)
    t.supplier.where("s_acctbal >= 0").write.mode("overwrite").parquet(path)
    return t.spark.read.parquet(path)


@query(
    "promote_json_attribute",
    "M24",
    """SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
              CASE WHEN event_type = 'purchase' THEN value END AS paid FROM events""",
)
def _(t):
    raw = t.events.select(
        "event_id",
        "event_type",
        F.to_json(
            F.struct(F.get_json_object("props", "$.k").alias("k"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"))
        ).alias("metadata"),
    )
    return raw.select(
        "event_id",
        "event_type",
        F.get_json_object("metadata", "$.k").cast("int").alias("k"),
        F.get_json_object("metadata", "$.paid").cast("double").alias("paid"),
    )


# --- history ------------------------------------------------------------------------

KEYS = ["user_id"]


def change_log(t):
    """Events as a change log: a key per user, a version per day since the first event; an error deletes the key."""
    return t.events.select(
        "user_id",
        "event_type",
        "value",
        (F.datediff(F.to_date("ts"), t.events.agg(F.min(F.to_date("ts"))).scalar()) + 1).alias("version"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        F.col("ts").cast("timestamp").alias("commit_ts"),
    )


LOG = """log AS (SELECT user_id, event_type, value, CAST(date_diff('day', (SELECT MIN(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) + 1 AS INTEGER) AS version, event_id AS seq,
  CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, ts FROM events)"""


def state_sql(where: str) -> str:
    return f"""SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY version DESC, seq DESC) AS rn
      FROM log WHERE {where}) WHERE rn = 1 AND op <> 'delete'"""


V10V20 = f"WITH {LOG}, a AS ({state_sql('version <= 10')}), b AS ({state_sql('version <= 20')}) "


@query("history_as_of_version", "T01", f"WITH {LOG} {state_sql('version <= 10')}")
def _(t):
    return s.as_of_version(change_log(t), KEYS, 10)


@query("history_as_of_time", "T02", f"WITH {LOG} " + state_sql("ts <= TIMESTAMP '2024-01-12 08:30:00'"))
def _(t):
    return s.as_of_time(change_log(t), KEYS, F.lit("2024-01-12 08:30:00").cast("timestamp"))


@query(
    "history_diff_modified",
    "T03",
    V10V20
    + """SELECT a.user_id, a.event_type AS old_event_type, a.value AS old_value, b.event_type AS new_event_type, b.value AS new_value
         FROM a JOIN b ON a.user_id = b.user_id WHERE a.event_type <> b.event_type OR a.value <> b.value""",
)
def _(t):
    log = change_log(t)
    return s.modified(s.as_of_version(log, KEYS, 10), s.as_of_version(log, KEYS, 20), KEYS)


@query(
    "history_diff_deleted_inserted",
    "T04",
    V10V20
    + """SELECT 'deleted' AS change, user_id FROM a WHERE user_id NOT IN (SELECT user_id FROM b)
         UNION ALL SELECT 'inserted', user_id FROM b WHERE user_id NOT IN (SELECT user_id FROM a)""",
)
def _(t):
    log = change_log(t)
    a, b = s.as_of_version(log, KEYS, 10), s.as_of_version(log, KEYS, 20)
    lost = a.join(b, KEYS, "left_anti").select(F.lit("deleted").alias("change"), "user_id")
    return lost.unionByName(b.join(a, KEYS, "left_anti").select(F.lit("inserted").alias("change"), "user_id"))


@query(
    "history_change_feed",
    "T05",
    V10V20
    + """SELECT user_id, 'delete' AS change_type, event_type, value FROM a WHERE user_id NOT IN (SELECT user_id FROM b)
         UNION ALL SELECT user_id, 'insert', event_type, value FROM b WHERE user_id NOT IN (SELECT user_id FROM a)
         UNION ALL SELECT a.user_id, 'update_preimage', a.event_type, a.value FROM a JOIN b USING (user_id) WHERE a.event_type <> b.event_type OR a.value <> b.value
         UNION ALL SELECT b.user_id, 'update_postimage', b.event_type, b.value FROM a JOIN b USING (user_id) WHERE a.event_type <> b.event_type OR a.value <> b.value""",
)
def _(t):
    log = change_log(t)
    return s.change_feed(s.as_of_version(log, KEYS, 10), s.as_of_version(log, KEYS, 20), KEYS)


def restore_sql(where: str) -> str:
    return f"""WITH {LOG}, o AS (SELECT * FROM ({state_sql('version <= 15')}) WHERE {where}), n AS (SELECT * FROM ({state_sql('true')}) WHERE {where})
      SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type) AS event_type, coalesce(o.value, n.value) AS value,
             31 AS version, CASE WHEN o.user_id IS NULL THEN 'delete' ELSE 'upsert' END AS op
      FROM o FULL JOIN n ON o.user_id = n.user_id WHERE o.value IS DISTINCT FROM n.value OR o.event_type IS DISTINCT FROM n.event_type"""


@query("history_restore", "T06", restore_sql("true"))
def _(t):
    return s.restore(change_log(t), KEYS, 15, 31)


@query("history_restore_selected", "T06", restore_sql("event_type IN ('click', 'view')"))
def _(t):
    return s.restore(change_log(t), KEYS, 15, 31, F.col("event_type").isin("click", "view"))


@query(
    "history_report",
    "T07",
    f"""WITH {LOG} SELECT version, epoch_us(MAX(ts)) AS commit_us, COUNT(*) FILTER (WHERE op <> 'delete') AS upserts,
         COUNT(*) FILTER (WHERE op = 'delete') AS deletes FROM log GROUP BY version""",
)
def _(t):
    return s.history(change_log(t)).select("version", micros("commit_ts").alias("commit_us"), "upserts", "deletes")


@query(
    "history_metric_across_versions",
    "T08",
    V10V20
    + """SELECT (SELECT CAST(SUM(CAST(value AS DECIMAL(14,2))) AS DOUBLE) FROM a) AS value_then,
         (SELECT CAST(SUM(CAST(value AS DECIMAL(14,2))) AS DOUBLE) FROM b) AS value_now, (SELECT COUNT(*) FROM a) AS rows_then, (SELECT COUNT(*) FROM b) AS rows_now""",
)
def _(t):
    log = change_log(t)
    then = s.as_of_version(log, KEYS, 10).withColumn("at", F.lit("then"))
    now = s.as_of_version(log, KEYS, 20).withColumn("at", F.lit("now"))

    def at(x):
        return F.when(F.col("at") == x, F.col("value"))

    return then.unionByName(now).agg(
        total(at("then")).alias("value_then"),
        total(at("now")).alias("value_now"),
        F.count(at("then")).alias("rows_then"),
        F.count(at("now")).alias("rows_now"),
    )


@query(
    "history_rows_per_version",
    "T09",
    f"""WITH {LOG}, v AS (SELECT DISTINCT version AS vv FROM log), fin AS (SELECT vv, user_id, arg_max(op, seq) AS op FROM log JOIN v ON version <= vv GROUP BY 1, 2)
        SELECT vv AS version, COUNT(*) FILTER (WHERE op <> 'delete') AS n_rows FROM fin GROUP BY 1""",
)
def _(t):
    return s.rows_per_version(change_log(t), KEYS)


@query(
    "history_retention_report",
    "T10",
    f"""WITH {LOG}, n AS (SELECT version, lead(version) OVER (PARTITION BY user_id ORDER BY version, seq) AS nv FROM log)
        SELECT version, COUNT(*) AS log_rows, COUNT(nv) AS superseded, COUNT(*) FILTER (WHERE nv <= 23) AS removable, version < 23 AS outside_window
        FROM n GROUP BY version""",
)
def _(t):
    return s.retention(change_log(t), KEYS, 23)


@query(
    "history_audit_trail",
    "T11",
    f"""WITH {LOG} SELECT user_id, version, COUNT(*) AS changes, COUNT(*) FILTER (WHERE op = 'delete') AS removals FROM log
        WHERE user_id NOT IN (SELECT user_id FROM ({state_sql('true')})) GROUP BY 1, 2""",
)
def _(t):
    log = change_log(t)
    gone = log.join(s._state(log, KEYS), KEYS, "left_anti")
    return gone.groupBy("user_id", "version").agg(
        F.count("*").alias("changes"), F.count_if(F.col("op") == "delete").alias("removals")
    )


@query(
    "history_row_lineage",
    "T12",
    f"""WITH {LOG} SELECT user_id, version, seq, op, row_number() OVER (PARTITION BY user_id ORDER BY version, seq) AS change_no,
         COUNT(*) OVER (PARTITION BY user_id) AS changes FROM log""",
)
def _(t):
    return s.lineage(change_log(t).select("user_id", "version", "seq", "op"), KEYS)


@query(
    "history_bad_change",
    "T13",
    f"""WITH {LOG}, a AS ({state_sql('version <= 14')}), b AS ({state_sql('true')}), k AS (SELECT DISTINCT user_id FROM log WHERE version = 15)
        SELECT k.user_id, a.value AS good_value, b.value AS now_value FROM k LEFT JOIN a ON a.user_id = k.user_id LEFT JOIN b ON b.user_id = k.user_id
        WHERE a.value IS DISTINCT FROM b.value OR a.event_type IS DISTINCT FROM b.event_type""",
)
def _(t):
    out = s.compare_to_good(change_log(t), KEYS, 15)
    return out.select("user_id", F.col("before.value").alias("good_value"), F.col("after.value").alias("now_value"))
