"""Schema change, rule, statistics and data-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.functions.common import total
from lakeops.operators import checks as k
from lakeops.operators import schema as c
from lakeops.plans.registry import query
from lakeops.plans.relational import dsum


@query(
    "schema_add_column",
    "C01",
    """SELECT s_suppkey, s_name, NULL::VARCHAR AS phone, NULL::DOUBLE AS score FROM supplier
       UNION ALL SELECT c_custkey, c_name, 'n/a', c_acctbal FROM customer""",
)
def _(t):
    old = c.add_columns(t.supplier.select("s_suppkey", "s_name"), {"phone": "string", "score": "double"})
    new = t.customer.select(
        F.col("c_custkey").alias("s_suppkey"),
        F.col("c_name").alias("s_name"),
        F.lit("n/a").alias("phone"),
        F.col("c_acctbal").alias("score"),
    )
    return old.unionByName(new)


@query("schema_rename_drop", "C02 C03", "SELECT s_suppkey AS supplier_id, s_name AS supplier_name, s_acctbal FROM supplier")
def _(t):
    return t.supplier.withColumnsRenamed({"s_suppkey": "supplier_id", "s_name": "supplier_name"}).drop("s_nationkey")


@query("schema_reorder", "C04", "SELECT s_acctbal, s_suppkey, s_nationkey, s_name FROM supplier")
def _(t):
    return c.reorder(c.reorder(t.supplier, "s_acctbal"), "s_nationkey", after="s_suppkey")


@query(
    "schema_widen_type",
    "C05",
    "SELECT p_partkey, CAST(p_size AS BIGINT) * 3000000000 AS big_size, CAST(CAST(p_size AS FLOAT) AS DOUBLE) AS size_double FROM part",
)
def _(t):
    rows = t.part.select("p_partkey", "p_size", F.col("p_size").cast("float").alias("size_double"))
    wide = c.widen(rows, {"p_size": "bigint", "size_double": "double"})
    return wide.select("p_partkey", (F.col("p_size") * 3_000_000_000).alias("big_size"), "size_double")


@query(
    "schema_widest_union",
    "C06",
    """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS DOUBLE) AS amount, NULL::VARCHAR AS segment FROM nation
       UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer
       UNION ALL SELECT s_suppkey, s_name, CAST(s_nationkey AS DOUBLE), NULL FROM supplier""",
)
def _(t):
    return c.widest_union(
        [
            t.nation.toDF("id", "name", "amount"),
            t.customer.select(
                F.col("c_custkey").alias("id"),
                F.col("c_name").alias("name"),
                F.col("c_acctbal").alias("amount"),
                F.col("c_mktsegment").alias("segment"),
            ),
            t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("amount")),
        ]
    )


@query("schema_column_mapping", "C07", "SELECT c_custkey AS customer_id, c_name AS full_name, c_acctbal AS balance FROM customer")
def _(t):
    physical = t.customer.toDF("col_1", "col_2", "col_3", "col_4", "col_5")
    return c.map_columns(physical, {"col_1": "customer_id", "col_2": "full_name", "col_4": "balance"})


def order_rules():
    return {
        "price_positive": F.col("o_totalprice") > 5000,
        "status_known": F.col("o_orderstatus").isin("F", "O"),
        "priority_set": F.col("o_orderpriority").isNotNull() & (F.col("o_orderpriority") != "4-NOT SPECIFIED"),
    }


RULES_SQL = {
    "price_positive": "o_totalprice > 5000",
    "status_known": "o_orderstatus IN ('F','O')",
    "priority_set": "o_orderpriority IS NOT NULL AND o_orderpriority <> '4-NOT SPECIFIED'",
}


@query(
    "constraint_split_rejected",
    "C08",
    "SELECT * FROM (SELECT o_orderkey, concat_ws(',', "
    + ", ".join(f"CASE WHEN NOT ({p}) THEN '{n}' END" for n, p in RULES_SQL.items())
    + ") AS broken FROM orders) WHERE broken <> ''",
)
def _(t):
    _, rejected = c.split_valid(t.orders, order_rules())
    return rejected.select("o_orderkey", F.array_join("violations", ",").alias("broken"))


@query(
    "constraint_violation_counts",
    "C16",
    " UNION ALL ".join(
        f"SELECT '{n}' AS rule, COUNT(*) FILTER (WHERE NOT ({p})) AS violations, COUNT(*) AS n_rows FROM orders" for n, p in RULES_SQL.items()
    ),
)
def _(t):
    return c.violation_counts(t.orders, order_rules())


@query(
    "default_values",
    "C09",
    """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic,
              coalesce(nullif(d.lang, 'es'), 'system') AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    rows = t.documents.select("doc_id", F.nullif("lang", F.lit("es")).alias("lang")).join(t.labels, "doc_id", "left")
    return c.with_defaults(rows, {"quality": F.lit(-1), "toxic": F.lit(0), "lang": F.lit("system")})


@query(
    "computed_columns",
    "C10",
    """SELECT o_orderkey, o_totalprice, o_totalprice / 2 AS half, o_totalprice / 2 + 10 AS half_plus,
              CAST(year(o_orderdate) AS INTEGER) AS order_year FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey", "o_totalprice", (F.col("o_totalprice") / 2).alias("half"), F.year("o_orderdate").alias("order_year")
    ).withColumns({"half_plus": F.col("half") + 10})


@query(
    "overflow_watch",
    "C11",
    """SELECT column_name, largest, largest * 100.0::DOUBLE / 2147483647 AS pct_of_limit,
              CASE WHEN largest * 100.0::DOUBLE / 2147483647 >= 80 THEN 'critical' WHEN largest * 100.0::DOUBLE / 2147483647 >= 50 THEN 'warning' ELSE 'safe' END AS risk
       FROM (SELECT 'okey' AS column_name, MAX(CAST(l_orderkey AS DOUBLE)) * 10000 AS largest FROM lineitem
             UNION ALL SELECT 'cents', MAX(CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * 100 AS DOUBLE)) FROM lineitem
             UNION ALL SELECT 'milli', MAX(CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * 10000 AS DOUBLE)) FROM lineitem)""",
)
def _(t):
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    rows = t.lineitem.select(
        (F.col("l_orderkey").cast("double") * 10000).alias("okey"), (price * 100).alias("cents"), (price * 10000).alias("milli")
    )
    return c.overflow_watch(rows, ["okey", "cents", "milli"])


@query(
    "stats_per_batch",
    "C12",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS batch, 'o_totalprice' AS column_name, COUNT(*) AS n_rows, 0::BIGINT AS nulls,
              CAST(MIN(o_totalprice) AS VARCHAR) AS min_value, CAST(MAX(o_totalprice) AS VARCHAR) AS max_value FROM orders GROUP BY 1
       UNION ALL SELECT CAST(year(o_orderdate) AS INTEGER), 'o_custkey', COUNT(*), 0, CAST(MIN(o_custkey) AS VARCHAR), CAST(MAX(o_custkey) AS VARCHAR) FROM orders GROUP BY 1""",
)
def _(t):
    rows = t.orders.select(F.year("o_orderdate").alias("batch"), "o_totalprice", "o_custkey")
    return c.column_profile(rows, ["o_totalprice", "o_custkey"], distinct=False, by=["batch"])


LABELLED = "(SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def labelled(t):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")


@query(
    "stats_null_profile",
    "C13",
    " UNION ALL ".join(
        f"SELECT '{x}' AS column_name, COUNT(*) - COUNT({x}) AS nulls, CAST(COUNT({x}) AS DOUBLE) / COUNT(*) AS fill_rate FROM {LABELLED}"
        for x in ("lang", "quality", "toxic")
    ),
)
def _(t):
    return c.null_profile(labelled(t), ["lang", "quality", "toxic"])


CUST = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query(
    "stats_column_profile",
    "C14",
    " UNION ALL ".join(
        f"""SELECT '{x}' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT({x}) AS nulls, COUNT(DISTINCT {x}) AS distinct_values,
        CAST(MIN({x}) AS VARCHAR) AS min_value, CAST(MAX({x}) AS VARCHAR) AS max_value FROM customer"""
        for x in CUST
    ),
)
def _(t):
    return c.column_profile(t.customer, CUST)


KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")


@query(
    "stats_distinct_sketches",
    "C14",
    " UNION ALL ".join(f"SELECT '{x}' AS column_name, COUNT(DISTINCT {x}) AS distinct_values, true AS near FROM lineitem" for x in KEYS),
)
def _(t):
    # Sketches are kept per file and merged; the exact counts beside them show the error.
    per_file = c.distinct_sketches(t.lineitem.select(*KEYS, F.col("_metadata.file_path").alias("path")), KEYS, ["path"])
    told = c.distinct_of_sketches(per_file, KEYS).withColumnRenamed("distinct_values", "told")
    both = c.distinct_exact(t.lineitem, KEYS).join(told, "column_name")
    near = F.abs(F.col("told") - F.col("distinct_values")) <= 0.04 * F.col("distinct_values")
    return both.select("column_name", "distinct_values", near.alias("near"))


@query(
    "stats_text_profile",
    "C15",
    " UNION ALL ".join(
        f"""SELECT '{x}' AS column_name, MIN(length({x})) AS min_length, MAX(length({x})) AS max_length,
        COUNT(*) FILTER (WHERE length({x}) > 32) AS long_values, COUNT(DISTINCT substr({x}, 1, 4)) AS prefixes FROM documents"""
        for x in ("text", "source", "lang")
    ),
)
def _(t):
    return c.text_profile(t.documents, ["text", "source", "lang"])


CATALOG = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "labels": "doc_id bigint, quality int, toxic int",
}


@query(
    "schema_column_catalog",
    "C17",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {i + 1} AS position, '{x.split()[0]}' AS column_name, '{x.split()[1]}' AS data_type, COUNT({x.split()[0]}) AS filled FROM {name}"
        for name, cols in CATALOG.items()
        for i, x in enumerate(cols.split(", "))
    ),
)
def _(t):
    return c.column_catalog({name: getattr(t, name) for name in CATALOG})


# --- checks -------------------------------------------------------------------------


@query(
    "check_row_counts_severity",
    "K01 K03",
    """SELECT u.* FROM (SELECT COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS d FROM orders) q, LATERAL (VALUES
         ('exact', 'error', q.n::DOUBLE, q.n::DOUBLE, 'PASS'), ('at_least', 'error', 100::DOUBLE, q.n::DOUBLE, CASE WHEN q.n >= 100 THEN 'PASS' ELSE 'FAIL' END),
         ('at_most', 'warning', 10::DOUBLE, q.d::DOUBLE, CASE WHEN q.d <= 10 THEN 'PASS' ELSE 'WARN' END)) u(check_name, severity, expected, actual, result)""",
)
def _(t):
    return k.run_checks(
        t.orders,
        [
            k.Check("exact", F.count("*"), "=", F.count("o_orderkey")),
            k.Check("at_least", F.count("*"), ">=", 100),
            k.Check("at_most", F.countDistinct("o_custkey"), "<=", 10, severity="warning"),
        ],
    )


@query(
    "check_value_where",
    "K02 K08",
    """SELECT u.* FROM (SELECT MAX(CASE WHEN r_name = 'ASIA' THEN r_regionkey END) AS a, (SELECT MAX(o_totalprice) FROM orders) AS m FROM region) q,
        LATERAL (VALUES ('asia_key', 'error', 2::DOUBLE, q.a::DOUBLE, CASE WHEN q.a = 2 THEN 'PASS' ELSE 'FAIL' END),
          ('largest', 'error', 499978.6::DOUBLE, q.m::DOUBLE, CASE WHEN abs(q.m - 499978.6) <= 0.011 THEN 'PASS' ELSE 'FAIL' END)) u(check_name, severity, expected, actual, result)""",
)
def _(t):
    a = k.run_checks(t.region, [k.Check("asia_key", k.value_where("r_regionkey", F.col("r_name") == "ASIA"), "=", 2)])
    largest = F.max(k.number(F.format_number("o_totalprice", 2)))
    b = k.run_checks(t.orders, [k.Check("largest", largest, "=", 499978.60, tolerance=0.011)])
    return a.unionByName(b)


@query(
    "check_result_includes",
    "K04",
    """SELECT * FROM (SELECT 'AFRICA' AS r_name, 5::BIGINT AS nations UNION ALL SELECT 'ATLANTIS', 5 UNION ALL SELECT 'ASIA', 4)
       WHERE (r_name, nations) NOT IN (SELECT r_name, COUNT(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)""",
)
def _(t):
    per = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("nations"))
    wanted = t.spark.sql("SELECT * FROM VALUES ('AFRICA', 5L), ('ATLANTIS', 5L), ('ASIA', 4L) AS v(r_name, nations)")
    return k.missing_rows(per, wanted)


@query(
    "check_column_relation",
    "K05",
    "SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE l_shipdate < o_orderdate) AS shipped_early FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def _(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.agg(F.count("*").alias("n_rows"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("shipped_early"))


@query(
    "check_failures_only",
    "K06",
    """SELECT 'too_few' AS check_name, 'error' AS severity, 1e12::DOUBLE AS expected, COUNT(*)::DOUBLE AS actual, 'FAIL' AS result FROM orders
       UNION ALL SELECT 'no_debt', 'error', 0, COUNT(*) FILTER (WHERE c_acctbal < 0)::DOUBLE, 'FAIL' FROM customer HAVING COUNT(*) FILTER (WHERE c_acctbal < 0) > 0""",
)
def _(t):
    a = k.run_checks(t.orders, [k.Check("too_few", F.count("*"), ">=", 1e12), k.Check("some", F.count("*"), ">=", 1)])
    b = k.run_checks(t.customer, [k.Check("no_debt", F.count_if(F.col("c_acctbal") < 0), "=", 0)])
    return k.failures([a, b])


@query(
    "check_column_statistics",
    "K07",
    f"""SELECT {dsum('l_quantity')} AS total, {dsum('l_quantity')} / COUNT(l_quantity) AS mean, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi,
              COUNT(DISTINCT l_quantity) AS distinct_values, COUNT(*) - COUNT(l_quantity) AS nulls, COUNT(*) FILTER (WHERE l_quantity > 25) AS over_25 FROM lineitem""",
)
def _(t):
    q = F.col("l_quantity")
    return t.lineitem.agg(
        total(q).alias("total"),
        (total(q) / F.count(q)).alias("mean"),
        F.min(q).alias("lo"),
        F.max(q).alias("hi"),
        F.countDistinct(q).alias("distinct_values"),
        F.count_if(q.isNull()).alias("nulls"),
        F.count_if(q > 25).alias("over_25"),
    )


@query(
    "check_referential_integrity",
    "K09",
    """SELECT 'labels' AS child, COUNT(*) AS orphans FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
       UNION ALL SELECT 'events', COUNT(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)
       UNION ALL SELECT 'orders', COUNT(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def _(t):
    def count(name, df):
        return df.agg(F.lit(name).alias("child"), F.count("*").alias("orphans"))

    a = count("labels", k.orphans(t.labels, t.documents, "doc_id", "doc_id"))
    b = count("events", k.orphans(t.events, t.customer, "user_id", "c_custkey"))
    d = count("orders", k.orphans(t.orders, t.lineitem, "o_orderkey", "l_orderkey"))
    return a.unionByName(b).unionByName(d)


@query(
    "check_reported_counts",
    "K10",
    """SELECT o_orderkey, MAX(stated) AS stated, COUNT(l_orderkey) AS found, COUNT(l_orderkey) = MAX(stated) AS agrees
       FROM (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS stated FROM orders) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def _(t):
    found = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("found"))
    stated = t.orders.select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("stated"))
    both = stated.join(found, "o_orderkey", "left").fillna(0, ["found"])
    return both.withColumn("agrees", F.col("found") == F.col("stated"))
