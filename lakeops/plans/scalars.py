"""Scalar functions: each query runs a family of functions over a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeops.functions.common import day, day_of_week, micros, microseconds_of_day, seconds_between
from lakeops.functions.texts import json_type
from lakeops.plans.registry import query
from lakeops.session import scratch_path


@query(
    "functions_string",
    "FN-string",
    """SELECT doc_id, concat(lang, '-', source) AS joined, lang || ':' || source AS infix, length(text) AS chars, octet_length(encode(text)) AS bytes,
              lower(lang) AS lo, upper(source) AS up, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS padded, md5(text) AS digest,
              regexp_replace(source, '[0-9]+', '#', 'g') AS masked, repeat(lang, 3) AS tripled, replace(text, ' ', '') = text AS no_space,
              substr(text, 2, 5) AS part_a, substring(text, 1, 4) AS part_b, trim('  ' || source || ' ') AS trimmed FROM documents""",
)
def _(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id",
        F.concat("lang", F.lit("-"), "source").alias("joined"),
        F.concat("lang", F.lit(":"), "source").alias("infix"),
        F.length(text).cast("long").alias("chars"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.lower("lang").alias("lo"),
        F.upper("source").alias("up"),
        F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("padded"),
        F.md5(text.cast("binary")).alias("digest"),
        F.regexp_replace("source", "[0-9]+", "#").alias("masked"),
        F.repeat("lang", 3).alias("tripled"),
        (F.replace(text, F.lit(" "), F.lit("")) == text).alias("no_space"),
        F.substr(text, F.lit(2), F.lit(5)).alias("part_a"),
        F.substring(text, 1, 4).alias("part_b"),
        F.trim(F.concat(F.lit("  "), "source", F.lit(" "))).alias("trimmed"),
    )


@query(
    "functions_math",
    "FN-math",
    """SELECT event_id, abs(value - 100) AS gap, round(cos(radians(value)), 6) AS cosine, round(ln(value), 6) AS logn,
              round(power(value, 2), 4) AS squared, round(sqrt(value), 6) AS root, round(radians(value), 6) AS rad, round(value, 1) AS one_digit FROM events""",
)
def _(t):
    v = F.col("value")
    return t.events.select(
        "event_id",
        F.abs(v - 100).alias("gap"),
        F.round(F.cos(F.radians(v)), 6).alias("cosine"),
        F.round(F.ln(v), 6).alias("logn"),
        F.round(F.pow(v, F.lit(2)), 4).alias("squared"),
        F.round(F.sqrt(v), 6).alias("root"),
        F.round(F.radians(v), 6).alias("rad"),
        F.round(v, 1).alias("one_digit"),
    )


@query(
    "functions_date",
    "FN-date",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS formatted, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month_start,
              CAST(day(o_orderdate) AS INTEGER) AS dom, CAST(dayofweek(o_orderdate) AS INTEGER) AS dow, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
              CAST(extract(hour FROM o_orderdate) AS INTEGER) AS hh, CAST(last_day(o_orderdate) AS VARCHAR) AS month_end,
              CAST(month(o_orderdate) AS INTEGER) AS mm, CAST(quarter(o_orderdate) AS INTEGER) AS qq, CAST(weekofyear(o_orderdate) AS INTEGER) AS ww,
              CAST(year(o_orderdate) AS INTEGER) AS yy, CAST(epoch(o_orderdate) AS BIGINT) AS secs, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week_start
       FROM orders""",
)
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        F.date_format(d, "yyyy/MM/dd").alias("formatted"),
        day(F.date_trunc("month", d)).alias("month_start"),
        F.dayofmonth(d).alias("dom"),
        day_of_week(d).alias("dow"),
        F.dayofyear(d).alias("doy"),
        F.extract(F.lit("HOUR"), d).cast("int").alias("hh"),
        F.last_day(d).cast("string").alias("month_end"),
        F.month(d).alias("mm"),
        F.quarter(d).alias("qq"),
        F.weekofyear(d).alias("ww"),
        F.year(d).alias("yy"),
        F.unix_timestamp(d.cast("timestamp")).alias("secs"),
        day(F.date_trunc("week", d)).alias("week_start"),
    )


@query(
    "functions_make_time",
    "FN-date",
    """SELECT event_id, epoch_us(make_timestamp(year(ts), month(ts), day(ts), hour(ts), minute(ts), 0.0)) AS minute_us,
              CAST((hour(ts) * 60 + minute(ts)) * 60000000 AS BIGINT) AS time_us, epoch_us(ts + INTERVAL 1 HOUR) AS later_us FROM events""",
)
def _(t):
    ts = F.col("ts").cast("timestamp")
    built = F.make_timestamp(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.lit(0).cast("decimal(8,6)"))
    return t.events.select(
        "event_id",
        micros(built).alias("minute_us"),
        microseconds_of_day(F.hour(ts), F.minute(ts), F.lit(0)).alias("time_us"),
        micros(ts + F.expr("INTERVAL 1 HOUR")).alias("later_us"),
    )


@query(
    "functions_json",
    "FN-json",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(doc, '$.inner.type') AS kind,
              CAST(json_array_length(list) AS INTEGER) AS items, json_type(list) = 'ARRAY' AS is_array, json_type(props) = 'OBJECT' AS is_object
       FROM (SELECT event_id, props, json_object('inner', json_object('type', event_type)) AS doc, to_json([user_id, event_id]) AS list FROM events)""",
)
def _(t):
    inner = F.struct(F.struct(F.col("event_type").alias("type")).alias("inner"))
    rows = t.events.select(
        "event_id", "props", F.to_json(inner).alias("doc"), F.to_json(F.array("user_id", "event_id")).alias("list")
    )
    return rows.select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.get_json_object("doc", "$.inner.type").alias("kind"),
        F.json_array_length("list").alias("items"),
        (json_type("list") == "array").alias("is_array"),
        (json_type("props") == "object").alias("is_object"),
    )


@query(
    "functions_nested",
    "FN-nested",
    """SELECT p_partkey, len(words) AS n_words, list_contains(words, 'ring') AS has_ring, words[1] AS head, p_size AS size_field, p_brand AS tag_brand, 2 AS tags
       FROM (SELECT *, string_split(p_name, ' ') AS words FROM part)""",
)
def _(t):
    rows = t.part.select(
        "p_partkey",
        F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("words"),
        F.named_struct(F.lit("size"), "p_size", F.lit("price"), "p_retailprice").alias("dims"),
        F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type").alias("tags"),
    )
    return rows.select(
        "p_partkey",
        F.size("words").cast("long").alias("n_words"),
        F.array_contains("words", "ring").alias("has_ring"),
        F.element_at("words", 1).alias("head"),
        F.col("dims.size").alias("size_field"),
        F.col("tags")["brand"].alias("tag_brand"),
        F.size("tags").alias("tags"),
    )


@query(
    "functions_null_and_cast",
    "FN-null FN-type",
    """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, nullif(d.lang, 'en') AS other_lang, try_cast(substr(d.source, 4) AS INTEGER) AS source_no,
              try_cast(d.source AS INTEGER) AS not_a_number, CAST(d.n_chars AS DECIMAL(12,2))::VARCHAR AS chars_text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    rows = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")
    return rows.select(
        "doc_id",
        F.coalesce("quality", F.lit(-1)).alias("quality"),
        F.nullif("lang", F.lit("en")).alias("other_lang"),
        F.substr("source", F.lit(4)).try_cast("int").alias("source_no"),
        F.col("source").try_cast("int").alias("not_a_number"),
        F.col("n_chars").cast("decimal(12,2)").cast("string").alias("chars_text"),
    )


@query(
    "functions_time_gap",
    "FN-date",
    """SELECT l_returnflag, MIN(CAST(epoch(l_shipdate) - epoch(o_orderdate) AS BIGINT)) AS min_gap, MAX(CAST(epoch(l_shipdate) - epoch(o_orderdate) AS BIGINT)) AS max_gap
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(t):
    gap = seconds_between(F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp"))
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_returnflag")
        .agg(F.min(gap).alias("min_gap"), F.max(gap).alias("max_gap"))
    )


@query(
    "functions_char_varchar",
    "FN-type",
    """SELECT c_custkey, rpad(c_mktsegment, 12, ' ') AS fixed, length(rpad(c_mktsegment, 12, ' '))::INTEGER AS fixed_length, c_mktsegment AS bounded,
       length(c_mktsegment)::INTEGER AS bounded_length FROM customer""",
)
def _(t):
    # CHAR(n) is padded, VARCHAR(n) is not; both refuse longer values on write.
    name, path = f"typed_{uuid.uuid4().hex}", scratch_path(t.spark, "typed")
    t.spark.sql(f"CREATE TABLE {name} (c_custkey BIGINT, fixed CHAR(12), bounded VARCHAR(12)) USING parquet LOCATION '{path}'")
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("fixed"), F.col("c_mktsegment").alias("bounded"))
    rows.write.insertInto(name)
    return t.spark.table(name).select(
        "c_custkey", "fixed", F.length("fixed").alias("fixed_length"), "bounded", F.length("bounded").alias("bounded_length")
    )
