"""Sink, generator and file layout queries.  Files go to new folders under the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.functions.common import day, micros, total
from lakeops.operators import layout as lay
from lakeops.plans.registry import query
from lakeops.plans.relational import dsum
from lakeops.sources.generate import day_spine, generate_table, series
from lakeops.session import scratch_path


@query(
    "inline_rows",
    "S41",
    """SELECT v.code, v.label, COUNT(o_orderkey) AS n FROM (VALUES ('F', 'finished'), ('O', 'open'), ('X', 'unused')) v(code, label)
       LEFT JOIN orders ON o_orderstatus = v.code GROUP BY 1, 2""",
)
def _(t):
    codes = t.spark.sql("SELECT * FROM VALUES ('F', 'finished'), ('O', 'open'), ('X', 'unused') AS v(code, label)")
    per = t.orders.groupBy(F.col("o_orderstatus").alias("code")).agg(F.count("*").alias("n"))
    return codes.join(per, "code", "left").fillna(0, ["n"])


@query(
    "generate_day_series",
    "S42",
    """SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, COUNT(o_orderkey) AS orders FROM
       (SELECT unnest(generate_series(MIN(o_orderdate), MAX(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders) s
       LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY 1""",
)
def _(t):
    per = t.orders.groupBy(day("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))
    spine = day_spine(t.orders, "o_orderdate").select(F.col("day").cast("string").alias("day"))
    return spine.join(per, "day", "left").fillna(0, ["orders"])


@query(
    "generate_integer_series",
    "S42",
    """SELECT v AS linenumber, COUNT(l_orderkey) AS n FROM (SELECT unnest(generate_series(1, CAST((SELECT MAX(l_linenumber) FROM lineitem) AS BIGINT) + 3)) AS v)
       LEFT JOIN lineitem ON l_linenumber = v GROUP BY 1""",
)
def _(t):
    last = t.lineitem.agg(F.max("l_linenumber")).first()[0]
    per = t.lineitem.groupBy(F.col("l_linenumber").cast("long").alias("linenumber")).agg(F.count("*").alias("n"))
    return series(t.spark, 1, last + 3, "linenumber").join(per, "linenumber", "left").fillna(0, ["n"])


RULES = [
    {"type": "row_index", "name": "line", "start": 500},
    {"type": "id_sequence", "name": "ticket", "prefix": "T/", "pad": 10, "start": 42},
    {"type": "cyclic_lookup", "name": "lane", "values": ["north", "east", "south", "west"]},
    {"type": "cyclic_lookup", "name": "grade", "values": ["low", "mid", "high"], "offset_multiplier": 5},
    {"type": "padded_hash", "name": "locker", "multiplier": 271, "pad": 5, "modulo": 8191},
    {"type": "arithmetic", "name": "crates", "multiplier": 17, "modulo": 613, "offset": 9},
    {"type": "double", "name": "ph", "min": 3.5, "modulo": 701, "divisor": 64.0},
    {"type": "date", "name": "inspected", "base": "2007-03-18", "multiplier": 29, "modulo": 4093},
    {"type": "timestamp", "name": "weighed", "base_micros": 1193875200000000, "step_micros": 2500000},
    {"type": "boolean_cond", "name": "sealed", "modulo": 7, "eq": 3},
]


@query(
    "generate_rule_table",
    "S43",
    """SELECT i + 500 AS line, 'T/' || lpad(CAST(i + 42 AS VARCHAR), 10, '0') AS ticket, ['north','east','south','west'][i % 4 + 1] AS lane,
              ['low','mid','high'][i * 5 % 3 + 1] AS grade, lpad(CAST(i * 271 % 8191 AS VARCHAR), 5, '0') AS locker, i * 17 % 613 + 9 AS crates,
              3.5::DOUBLE + (i % 701) / 64.0::DOUBLE AS ph, CAST(DATE '2007-03-18' + CAST(i * 29 % 4093 AS INTEGER) AS VARCHAR) AS inspected,
              1193875200000000 + i * 2500000 AS weighed, i % 7 = 3 AS sealed FROM (SELECT unnest(range((SELECT COUNT(*) FROM orders))) AS i)""",
)
def _(t):
    made = generate_table(t.spark, t.orders.count(), RULES)
    return made.withColumns({"inspected": F.col("inspected").cast("string"), "weighed": micros("weighed")})


@query(
    "sink_append",
    "S44",
    "SELECT s_suppkey AS id, s_name AS name, 'supplier' AS kind FROM supplier UNION ALL SELECT c_custkey, c_name, 'customer' FROM customer",
)
def _(t):
    path = scratch_path(t.spark, "append")
    t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind")).write.parquet(path)
    more = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    more.write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


def order_parts(t):
    return t.orders.select(
        "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("status")
    )


@query(
    "sink_partitioned",
    "S45 L06",
    f"SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus AS status, COUNT(*) AS n, {dsum('o_totalprice')} AS value FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY 1, 2",
)
def _(t):
    path = scratch_path(t.spark, "parts")
    lay.write_partitioned(order_parts(t), path, ["y", "status"])
    # Partition pruning: only folders of 1997 and later are listed.
    back = t.spark.read.parquet(path).where("y >= 1997")
    return back.groupBy("y", "status").agg(F.count("*").alias("n"), total("o_totalprice").alias("value"))


@query(
    "sink_partition_replace",
    "S46",
    f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS y, COUNT(*) AS n, CAST(SUM(CAST(CASE WHEN year(o_orderdate) = 1998 THEN o_totalprice * 2 ELSE o_totalprice END AS DECIMAL(14,2))) AS DOUBLE) AS value
       FROM orders WHERE NOT (year(o_orderdate) = 1998 AND o_orderstatus = 'P') GROUP BY 1""",
)
def _(t):
    path = scratch_path(t.spark, "replace")
    lay.write_partitioned(order_parts(t), path, ["y"])
    new = order_parts(t).where("y = 1998 AND status <> 'P'").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    lay.replace_partitions(new, path, ["y"])
    return t.spark.read.parquet(path).groupBy("y").agg(F.count("*").alias("n"), total("o_totalprice").alias("value"))


@query(
    "create_table_as_select",
    "S50",
    "SELECT event_id, CAST(value AS DECIMAL(10,1))::DOUBLE AS value_1, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
)
def _(t):
    path = scratch_path(t.spark, "ctas")
    raw = t.events.select(
        "event_id",
        F.col("value").cast("decimal(10,1)").cast("double").alias("value_1"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    raw.write.parquet(path)
    return t.spark.read.parquet(path)


@query(
    "layout_compact_partition",
    "L01",
    f"SELECT o_orderstatus AS status, COUNT(*) AS n, {dsum('o_totalprice')} AS value, o_orderstatus = 'F' AS fewer_files FROM orders GROUP BY 1",
)
def _(t):
    small, packed = scratch_path(t.spark, "small"), scratch_path(t.spark, "packed")
    # Many small files per partition: rows arrive scattered over tasks.
    order_parts(t).repartition(16).write.partitionBy("status").parquet(small)
    lay.compact(t.spark, small, packed, ["status"], F.col("status") == "F")
    files = F.countDistinct(F.col("_metadata.file_path"))
    before = t.spark.read.parquet(small).groupBy("status").agg(files.alias("before"))
    done = t.spark.read.parquet(packed)
    rest = t.spark.read.parquet(small).where("status <> 'F'")
    after = done.groupBy("status").agg(F.count("*").alias("n"), total("o_totalprice").alias("value"), files.alias("after"))
    kept = rest.groupBy("status").agg(F.count("*").alias("n"), total("o_totalprice").alias("value"), files.alias("after"))
    both = after.unionByName(kept).join(before, "status")
    return both.select("status", "n", "value", (F.col("after") < F.col("before")).alias("fewer_files"))


@query(
    "layout_z_order",
    "L02",
    f"SELECT o_orderpriority, COUNT(*) AS n, {dsum('o_totalprice')} AS value FROM orders WHERE o_totalprice > 400000 AND o_custkey < 100 GROUP BY 1",
)
def _(t):
    path = scratch_path(t.spark, "zorder")
    lay.z_order(t.orders, ["o_totalprice", "o_custkey", "o_orderdate"]).write.parquet(path)
    hit = t.spark.read.parquet(path).where("o_totalprice > 400000 AND o_custkey < 100")
    return hit.groupBy("o_orderpriority").agg(F.count("*").alias("n"), total("o_totalprice").alias("value"))


@query(
    "layout_overlap_report",
    "L03",
    """WITH s AS (SELECT strftime(o_orderdate, '%Y-%m') AS batch, COUNT(*) AS n_rows, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, 0::BIGINT AS nulls FROM orders GROUP BY 1)
       SELECT s.*, (SELECT COUNT(*) FROM s o WHERE o.batch <> s.batch AND o.lo <= s.hi AND s.lo <= o.hi) AS overlaps FROM s""",
)
def _(t):
    stats = lay.group_stats(t.orders, F.date_format("o_orderdate", "yyyy-MM").alias("batch"), "o_totalprice")
    return stats.join(lay.overlap_counts(stats, "batch"), "batch")


@query(
    "layout_bloom_lookup",
    "L04",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)",
)
def _(t):
    path = scratch_path(t.spark, "bloom")
    t.orders.write.options(**lay.bloom_options(t.orders, ["o_custkey"])).parquet(path)
    best = t.orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").first()["o_custkey"]
    return t.spark.read.parquet(path).where(F.col("o_custkey") == best).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "layout_partition_transforms",
    "L05",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month, user_id % 8 AS bucket,
              substr(event_type, 1, 2) AS prefix, COUNT(*) AS n FROM events GROUP BY ALL""",
)
def _(t):
    return t.events.groupBy(
        day("ts").alias("day"),
        day(F.date_trunc("month", "ts")).alias("month"),
        F.pmod("user_id", F.lit(8)).alias("bucket"),
        F.substring("event_type", 1, 2).alias("prefix"),
    ).agg(F.count("*").alias("n"))


@query(
    "layout_transformed_partitions",
    "L05 S45",
    """SELECT CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month, CAST(user_id % 8 AS INTEGER) AS bucket, COUNT(*) AS n, MIN(event_id) AS first_event
       FROM events WHERE user_id % 8 IN (1, 5) GROUP BY ALL""",
)
def _(t):
    path = scratch_path(t.spark, "transforms")
    parts = {"month": day(F.date_trunc("month", "ts")), "bucket": F.pmod("user_id", F.lit(8)).cast("int")}
    lay.write_partitioned(t.events.withColumns(parts), path, ["month", "bucket"])
    # The filter names a partition column, so only the folders of two buckets are read.
    hit = t.spark.read.parquet(path).where(F.col("bucket").isin(1, 5))
    return hit.groupBy(F.col("month").cast("string").alias("month"), "bucket").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(
    "layout_partition_skew",
    "L07",
    """SELECT *, CASE WHEN share < 0.01 THEN 'tiny' WHEN share > 0.05 THEN 'hot' ELSE 'ok' END AS flag FROM
       (SELECT source, lang, COUNT(*) AS n_rows, COUNT(*) / CAST((SELECT COUNT(*) FROM documents) AS DOUBLE) AS share FROM documents GROUP BY 1, 2)""",
)
def _(t):
    return lay.partition_skew(t.documents, ["source", "lang"], 0.01, 0.05)
