"""File scan and flatten queries.

Each one writes a table in some file form to a new folder and reads it back with the
option under test, so the answer is known from the table itself.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lakeops.functions.common import day, total
from lakeops.plans.registry import query
from lakeops.plans.relational import dsum
from lakeops.session import scratch_path
from lakeops.sources import files as fs
from lakeops.sources.flatten import Flatten, flatten, resolve_references, unbundle

PART_DDL = "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double"
PART_COLS = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]


def write_lines(lines, path, head: list[str] | None = None, tail: list[str] | None = None):
    """One text line per row; ``head`` lines start and ``tail`` lines end every file."""
    if head or tail:

        def framed(batches):
            yield pd.DataFrame({"value": head or []}, dtype="object")
            yield from batches
            yield pd.DataFrame({"value": tail or []}, dtype="object")

        lines = lines.mapInPandas(framed, "value string")
    lines.write.mode("append").text(path)


def text_line(sep: str, *cols):
    return F.concat_ws(sep, *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]).alias("value")


@query("scan_delimited_quoted", "S01", f"SELECT {', '.join(PART_COLS)} FROM part")
def _(t):
    path = scratch_path(t.spark, "csv")
    # Names hold the delimiter, so quoting has to work.
    named = t.part.select(*PART_COLS).withColumn("p_name", F.replace("p_name", F.lit(" "), F.lit("; ")))
    named.write.option("sep", ";").option("header", "true").csv(path)
    back = fs.read_delimited(t.spark, path, PART_DDL, delimiter=";")
    return back.withColumn("p_name", F.replace("p_name", F.lit("; "), F.lit(" ")))


@query(
    "scan_null_marker",
    "S02",
    "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def _(t):
    path = scratch_path(t.spark, "nulls")
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")

    def marked(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("N/A"))

    write_lines(rows.select(text_line(",", "doc_id", marked("quality"), marked("toxic"))), path)
    return fs.read_delimited(t.spark, path, "doc_id bigint, quality int, toxic int", has_header=False, null_value="N/A")


@query("scan_comment_lines", "S03", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal >= 0")
def _(t):
    path = scratch_path(t.spark, "comments")
    line = F.concat(F.when(F.col("s_acctbal") < 0, "# ").otherwise(""), text_line("|", "s_suppkey", "s_name", "s_acctbal"))
    write_lines(t.supplier.select(line.alias("value")), path)
    ddl = "s_suppkey bigint, s_name string, s_acctbal double"
    return fs.read_delimited(t.spark, path, ddl, has_header=False, delimiter="|", comment_char="#")


@query("scan_skip_preamble", "S04", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(t):
    path = scratch_path(t.spark, "preamble")
    rows = t.supplier.select(text_line(",", "s_suppkey", "s_name", "s_nationkey")).repartition(4)
    write_lines(rows, path, ["Report: suppliers", "drawn up, by hand", "s_suppkey,s_name,s_nationkey"])
    return fs.read_delimited(t.spark, path, "s_suppkey bigint, s_name string, s_nationkey int", skip_starting_rows=2)


@query(
    "scan_row_cap_per_file",
    "S05",
    f"SELECT COUNT(*) AS n, {dsum('o_totalprice')} AS value FROM (SELECT * FROM orders LIMIT 1000)",
)
def _(t):
    capped = fs.read_parquet(t.spark, t.path("orders"), max_rows=1000)
    return capped.agg(F.count("*").alias("n"), total("o_totalprice").alias("value"))


@query("scan_trim_whitespace", "S06", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT c_custkey, c_name FROM customer")
def _(t):
    path = scratch_path(t.spark, "trim")
    a = t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v"))
    both = a.unionByName(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")))
    write_lines(both.select(F.concat(F.lit("  "), "k", F.lit("  ,   "), "v", F.lit("  ")).alias("value")), path)
    return fs.read_delimited(t.spark, path, "n_nationkey bigint, n_name string", has_header=False, trim_whitespace=True)


@query(
    "scan_file_selection",
    "S07",
    "SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
)
def _(t):
    path = scratch_path(t.spark, "tree")
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    for status, folder, form in (("F", "a/one", "csv"), ("O", "b", "csv"), ("P", "b/deep", "json")):
        part = rows.where(F.col("status") == status)
        part.write.format(form).save(f"{path}/{folder}/{status}")
    back = fs.read_delimited(t.spark, path, "k bigint, status string", has_header=False, file_filter="*.csv", recursive=True)
    return back.groupBy("status").agg(F.count("*").alias("n"))


@query(
    "scan_lineage_columns",
    "S08",
    """SELECT o_orderkey, row_number() OVER () AS df_row_number, 'orders.parquet' AS df_file_name, 'orders' AS df_dataset, true AS dated FROM orders""",
)
def _(t):
    out = fs.with_lineage(t.orders, "orders")
    return out.select(
        "o_orderkey", "df_row_number", "df_file_name", "df_dataset", F.col("df_file_modified").isNotNull().alias("dated")
    )


@query(
    "scan_schema_drift_union",
    "S09",
    """SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier
       UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer""",
)
def _(t):
    path = scratch_path(t.spark, "drift")
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    for df in (s, c):
        df.write.mode("append").option("header", "true").csv(path)
    return fs.typed(fs.union_by_header(t.spark, path), {"id": "bigint", "balance": "double"}).select(
        "id", "name", "balance", "segment"
    )


@query(
    "scan_parquet_row_group_filter",
    "S10",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 250000 AND 260000",
)
def _(t):
    path = scratch_path(t.spark, "sorted")
    # Files sorted by the filter column have narrow row-group ranges.
    t.orders.repartitionByRange(4, "o_totalprice").sortWithinPartitions("o_totalprice").write.parquet(path)
    hit = fs.read_parquet(t.spark, path).where(F.col("o_totalprice").between(250000, 260000))
    return hit.select("o_orderkey", "o_totalprice")


@query(
    "scan_orc_two_versions",
    "S11",
    "SELECT p_partkey, p_name, NULL::INTEGER AS p_size FROM part WHERE p_type = 'SMALL' UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_type <> 'SMALL'",
)
def _(t):
    path = scratch_path(t.spark, "orc")
    t.part.where("p_type = 'SMALL'").select("p_partkey", "p_name").write.orc(path)
    t.part.where("p_type <> 'SMALL'").select("p_partkey", "p_name", "p_size").write.mode("append").orc(path)
    return fs.read_orc(t.spark, path).select("p_partkey", "p_name", "p_size")


def order_documents(t):
    """Orders as nested JSON text, one document per line, in a new folder."""
    path = scratch_path(t.spark, "json")
    words = F.split("o_orderpriority", "-")
    lines = F.array(
        F.struct(F.lit(1).alias("no"), F.col("o_totalprice").alias("price")),
        F.struct(F.lit(2).alias("no"), F.col("o_custkey").cast("double").alias("price")),
    )
    doc = F.struct(
        F.struct(
            F.col("o_orderkey").alias("id"),
            F.struct(F.col("o_custkey").alias("key"), F.struct(day("o_orderdate").alias("on")).alias("seen")).alias("customer"),
            F.col("o_orderstatus").alias("status"),
            words.alias("tags"),
            lines.alias("lines"),
        ).alias("order"),
        F.struct(F.lit("x").alias("secret")).alias("internal"),
    )
    made = t.orders.select(doc.alias("doc"))
    made.select(F.to_json("doc").alias("value")).write.text(path)
    return t.spark.read.schema(made.select("doc.*").schema).json(path)


TAGS = "split_part(o_orderpriority, '-', 1), split_part(o_orderpriority, '-', 2)"


@query(
    "flatten_json_paths",
    "S12 S13 S16",
    f"""SELECT o_orderkey AS order_no, o_custkey AS customer_key, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS customer_seen_on,
              '["' || split_part(o_orderpriority, '-', 1) || '","' || split_part(o_orderpriority, '-', 2) || '"]' AS tags FROM orders""",
)
def _(t):
    cfg = Flatten(
        root_path="order",
        include_paths=("id", "customer", "tags", "status"),
        exclude_paths=("status",),
        column_mappings={"id": "order_no"},
    )
    return flatten(order_documents(t), cfg)


@query(
    "flatten_json_exclude",
    "S13",
    """SELECT o_orderkey AS "order.id", o_orderstatus AS "order.status", 2::BIGINT AS "order.lines" FROM orders""",
)
def _(t):
    cfg = Flatten(exclude_paths=("internal", "order.customer", "order.tags"), arrays="count", separator=".")
    return flatten(order_documents(t), cfg)


@query(
    "flatten_json_subtree",
    "S14",
    """SELECT o_orderkey AS order_id, '{"key":' || o_custkey || ',"seen":{"on":"' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '"}}' AS order_customer FROM orders""",
)
def _(t):
    cfg = Flatten(include_paths=("order.id", "order.customer"), text_paths=("order.customer",))
    return flatten(order_documents(t), cfg)


@query(
    "flatten_json_explode",
    "S15",
    """SELECT o_orderkey AS order_id, 1::BIGINT AS order_lines_no, o_totalprice AS order_lines_price FROM orders
       UNION ALL SELECT o_orderkey, 2, CAST(o_custkey AS DOUBLE) FROM orders""",
)
def _(t):
    cfg = Flatten(include_paths=("order.id", "order.lines"), explode_paths=("order.lines",))
    return flatten(order_documents(t), cfg)


@query(
    "flatten_json_array_count",
    "S17 S18",
    f"SELECT o_orderkey AS id, 2::BIGINT AS n_lines, concat_ws(',', {TAGS}) AS tags FROM orders",
)
def _(t):
    docs = order_documents(t)
    counted = flatten(docs, Flatten(root_path="order", include_paths=("id", "lines"), arrays="count", column_mappings={"lines": "n_lines"}))
    joined = flatten(docs, Flatten(root_path="order", include_paths=("id", "tags"), arrays="join_comma"))
    return counted.join(joined, "id")


def part_xml(t):
    """Parts as XML elements with attributes, a namespace prefix and repeated children."""
    path = scratch_path(t.spark, "xml")

    def esc(c):
        return F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    words = F.split("p_name", " ")
    xml = F.concat(
        F.lit('<x:part id="'), F.col("p_partkey").cast("string"),
        F.lit('"><x:brand code="'), F.length("p_brand").cast("string"), F.lit('">'), esc("p_brand"),
        F.lit("</x:brand><x:word>"), words[0], F.lit("</x:word><x:word>"), words[1],
        F.lit("</x:word><x:spec><x:size>"), F.col("p_size").cast("string"), F.lit("</x:size><x:type>"), esc("p_type"),
        F.lit("</x:type></x:spec></x:part>"),
    )
    write_lines(t.part.select(xml.alias("value")), path, ['<x:parts xmlns:x="urn:parts">'], ["</x:parts>"])
    ddl = "attr_id bigint, brand struct<_VALUE: string, attr_code: bigint>, word array<string>, spec struct<size: int, type: string>"
    return fs.read_xml(t.spark, path, "part", schema=ddl)


@query(
    "scan_xml_flatten",
    "S19 S18",
    """SELECT p_partkey AS part_attr_id, p_brand AS brand, length(p_brand) AS brand_attr_code, replace(p_name, ' ', ',') AS word, p_size AS spec_size FROM part""",
)
def _(t):
    cfg = Flatten(
        exclude_paths=("spec.type",), arrays="join_comma", column_mappings={"brand._VALUE": "brand", "attr_id": "part_attr_id"}
    )
    return flatten(part_xml(t), cfg)


@query(
    "scan_xml_explode",
    "S20",
    """SELECT p_partkey AS attr_id, unnest(string_split(p_name, ' ')) AS word FROM part""",
)
def _(t):
    return flatten(part_xml(t), Flatten(include_paths=("attr_id", "word"), explode_paths=("word",)))


@query(
    "scan_xml_subtree_text",
    "S21",
    """SELECT p_partkey AS attr_id, '<spec><size>' || p_size || '</size><type>' || p_type || '</type></spec>' AS as_xml,
              '{"size":' || p_size || ',"type":"' || p_type || '"}' AS as_json FROM part""",
)
def _(t):
    xml = F.regexp_replace(F.to_xml("spec", {"rowTag": "spec"}), ">\\s+<", "><")
    return part_xml(t).select("attr_id", F.trim(xml).alias("as_xml"), F.to_json("spec").alias("as_json"))


@query(
    "bronze_to_silver_typing",
    "S22",
    """SELECT event_id, try_cast(CASE WHEN value > 300 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value,
              CASE WHEN event_type = 'error' THEN NULL ELSE epoch_us(ts) END AS ts_us FROM events""",
)
def _(t):
    bronze = t.events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("value") > 300, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_type") == "error", "yesterday").otherwise(F.col("ts").cast("string")).alias("ts"),
    )
    silver = fs.typed(bronze, {"event_id": "bigint", "value": "double", "ts": "timestamp"})
    return silver.select("event_id", "value", F.unix_micros("ts").alias("ts_us"))


@query(
    "infer_column_types",
    "S23",
    """SELECT o_orderkey AS k, o_totalprice AS price, epoch_us(o_orderdate) AS on_us, o_orderpriority AS note, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS level FROM orders""",
)
def _(t):
    text = t.orders.select(
        F.col("o_orderkey").cast("string").alias("k"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_orderdate").cast("string").alias("on"),
        F.col("o_orderpriority").alias("note"),
        F.substring("o_orderpriority", 1, 1).alias("level"),
    )
    typed = fs.typed(text, fs.infer_types(text, text.columns))
    return typed.select("k", "price", F.unix_micros("on").alias("on_us"), "note", "level")


# --- FHIR ---------------------------------------------------------------------------


def bundles(t):
    """One bundle per order: the customer as Patient, the order as Observation."""
    who = F.concat(F.lit("urn:uuid:p"), F.col("o_custkey").cast("string"))
    patient = F.struct(
        who.alias("fullUrl"),
        F.struct(
            F.lit("Patient").alias("resourceType"),
            F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("id"),
            F.col("o_orderstatus").alias("gender"),
            F.lit(None).cast("struct<reference:string>").alias("subject"),
            F.lit(None).cast("struct<coding:array<struct<code:string,display:string>>>").alias("code"),
            F.lit(None).cast("struct<value:double,unit:string>").alias("valueQuantity"),
        ).alias("resource"),
    )
    coding = F.array(F.struct(F.substring("o_orderpriority", 1, 1).alias("code"), F.col("o_orderpriority").alias("display")))
    observation = F.struct(
        F.concat(F.lit("urn:uuid:o"), F.col("o_orderkey").cast("string")).alias("fullUrl"),
        F.struct(
            F.lit("Observation").alias("resourceType"),
            F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"),
            F.lit(None).cast("string").alias("gender"),
            F.struct(who.alias("reference")).alias("subject"),
            F.struct(coding.alias("coding")).alias("code"),
            F.struct(F.col("o_totalprice").alias("value"), F.lit("USD").alias("unit")).alias("valueQuantity"),
        ).alias("resource"),
    )
    other = F.struct(F.lit("urn:uuid:x").alias("fullUrl"), observation["resource"].withField("resourceType", F.lit("Basic")).alias("resource"))
    bundle = F.struct(
        F.lit("Bundle").alias("resourceType"),
        F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("id"),
        F.lit("collection").alias("type"),
        day("o_orderdate").alias("timestamp"),
        F.lit(3).cast("long").alias("total"),
        F.array(patient, observation, other).alias("entry"),
    )
    return t.orders.select(F.to_json(bundle).alias("body"))


RESOURCE = """id string, gender string, subject struct<reference: string>,
  code struct<coding: array<struct<code: string, display: string>>>, valueQuantity struct<value: double, unit: string>"""


@query(
    "fhir_unbundle",
    "S33",
    """SELECT 'b' || o_orderkey AS bundle_id, 'collection' AS bundle_type, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS bundle_timestamp, 3::BIGINT AS bundle_total,
              'urn:uuid:p' || o_custkey AS df_full_url, 'Patient' AS resourcetype, 'p' || o_custkey AS id FROM orders
       UNION ALL SELECT 'b' || o_orderkey, 'collection', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 3, 'urn:uuid:o' || o_orderkey, 'Observation', 'o' || o_orderkey FROM orders""",
)
def _(t):
    rows = unbundle(bundles(t), "body", RESOURCE, ("Patient", "Observation"))
    return rows.withColumn("id", F.col("resource.id")).drop("resource")


@query(
    "fhir_resource_flatten",
    "S34",
    """SELECT 'urn:uuid:o' || o_orderkey AS df_full_url, 'o' || o_orderkey AS id, 'urn:uuid:p' || o_custkey AS subject_reference,
              '{"coding":[{"code":"' || substr(o_orderpriority, 1, 1) || '","display":"' || o_orderpriority || '"}]}' AS code,
              o_totalprice AS valueQuantity_value, 'USD' AS valueQuantity_unit FROM orders""",
)
def _(t):
    rows = unbundle(bundles(t), "body", RESOURCE, ("Observation",)).select("df_full_url", "resource.*")
    cfg = Flatten(text_paths=("code",), exclude_paths=("resourceType", "gender"))
    return flatten(rows, cfg, keep=("df_full_url",))


@query(
    "fhir_reference_join",
    "S35",
    """SELECT 'urn:uuid:o' || o_orderkey AS observation, 'p' || o_custkey AS patient_id, o_orderstatus AS gender, o_totalprice AS value FROM orders""",
)
def _(t):
    # A reference is resolved inside its own bundle.
    rows = resolve_references(bundles(t), "body", RESOURCE, "Observation", "subject.reference", "Patient").where("target IS NOT NULL")
    return rows.select(
        F.col("df_full_url").alias("observation"),
        F.col("target.id").alias("patient_id"),
        F.col("target.gender").alias("gender"),
        F.col("resource.valueQuantity.value").alias("value"),
    )


# --- landing and incremental loads ---------------------------------------------------


@query(
    "landed_pages_to_table",
    "S36",
    "SELECT n_name AS country, r_name AS region_name, n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def _(t):
    path = scratch_path(t.spark, "landing")
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    item = F.struct(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("country"), F.struct(F.col("r_name").alias("name")).alias("region")
    )
    # A page per region; regions of a dimension table bound the page size.
    pages = rows.groupBy("r_name").agg(F.collect_list(item).alias("items"))
    pages.select("r_name", F.to_json(F.struct("items")).alias("value")).write.partitionBy("r_name").text(path)
    ddl = "items array<struct<id: int, country: string, region: struct<name: string>>>"
    landed = t.spark.read.option("recursiveFileLookup", "true").schema(ddl).json(path)
    return flatten(landed, Flatten(root_path="items"))


@query(
    "landed_xml_pages_to_table",
    "S36",
    """SELECT o_orderkey AS attr_id, o_orderstatus AS status, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS placed, o_totalprice AS price,
              CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'USD' END AS price_attr_currency FROM orders""",
)
def _(t):
    """Orders as an API that answers in XML lands them: one page of items per customer."""
    path = scratch_path(t.spark, "landing-xml")
    currency = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.lit(' currency="USD"'))
    item = F.concat(
        F.lit('<order id="'), F.col("o_orderkey").cast("string"), F.lit('"><status>'), F.col("o_orderstatus"),
        F.lit("</status><placed>"), day("o_orderdate"), F.lit("</placed><price"), currency, F.lit(">"),
        F.col("o_totalprice").cast("string"), F.lit("</price></order>"),
    )
    rows = t.orders.select("o_custkey", item.alias("item"))
    pages = rows.groupBy("o_custkey").agg(F.array_join(F.collect_list("item"), "").alias("items"))
    page = F.concat(F.lit('<page customer="'), F.col("o_custkey").cast("string"), F.lit('"><orders>'), F.col("items"), F.lit("</orders></page>"))
    write_lines(pages.select(page.alias("value")), path, ["<pages>"], ["</pages>"])
    ddl = "attr_id bigint, status string, placed string, price struct<_VALUE: double, attr_currency: string>"
    return flatten(fs.read_xml(t.spark, path, "order", schema=ddl), Flatten(column_mappings={"price._VALUE": "price"}))


LOADED = "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'"


@query(
    "load_incremental",
    "S37",
    f"SELECT o_orderstatus, COUNT(*) AS n, {dsum('o_totalprice')} AS value FROM orders GROUP BY 1",
)
def _(t):
    path = scratch_path(t.spark, "silver")
    t.orders.where("o_orderdate < TIMESTAMP_NTZ '1999-01-01'").write.parquet(path)
    for _ in range(2):  # the replay adds nothing
        silver = t.spark.read.parquet(path)
        fs.not_loaded(t.orders, silver, ["o_orderkey"]).write.mode("append").parquet(path)
    back = t.spark.read.parquet(path)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), total("o_totalprice").alias("value"))


@query(
    "load_missing_keys",
    "S38",
    """SELECT c.c_nationkey, y.y FROM (SELECT DISTINCT c_nationkey FROM customer) c,
       (SELECT CAST(unnest(range(MIN(year(o_orderdate)), MAX(year(o_orderdate)) + 1)) AS INTEGER) AS y FROM orders) y
       WHERE (c.c_nationkey, y.y) NOT IN (SELECT c_nationkey, CAST(year(o_orderdate) AS INTEGER) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 499000)""",
)
def _(t):
    ends = t.orders.agg(F.sequence(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate")))).scalar()
    wanted = t.customer.select("c_nationkey").distinct().select("c_nationkey", F.explode(ends).alias("y"))
    loaded = (
        t.orders.where("o_totalprice > 499000")
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("c_nationkey", F.year("o_orderdate").alias("y"))
    )
    return fs.not_loaded(wanted, loaded, ["c_nationkey", "y"])


@query(
    "load_next_batch",
    "S39",
    "SELECT COALESCE(MAX(CAST(year(o_orderdate) AS INTEGER)), 2024) + 1 AS next_year, (SELECT COALESCE(MAX(year(o_orderdate)), 2024)::INTEGER + 1 FROM orders WHERE o_totalprice < 0) AS first_year FROM orders",
)
def _(t):
    year = F.year("o_orderdate")
    none = F.when(F.col("o_totalprice") < 0, year)
    return t.orders.agg(
        (F.coalesce(F.max(year), F.lit(2024)) + 1).alias("next_year"), (F.coalesce(F.max(none), F.lit(2024)) + 1).alias("first_year")
    )


@query(
    "detect_schema",
    "S40",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{ty}' AS data_type, COUNT(*) - COUNT({c}) AS nulls, COUNT(DISTINCT {c}) AS distinct_values FROM part"
        for c, ty in (("p_partkey", "int"), ("p_name", "string"), ("p_brand", "string"), ("p_size", "int"), ("p_retailprice", "double"))
    ),
)
def _(t):
    path = scratch_path(t.spark, "detect")
    t.part.select(*PART_COLS).write.option("header", "true").csv(path)
    return fs.detect_schema(t.spark.read.option("header", "true").option("inferSchema", "true").csv(path))


@query(
    "join_across_formats",
    "S48",
    f"SELECT n_name, COUNT(*) AS customers, {dsum('c_acctbal')} AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def _(t):
    path = scratch_path(t.spark, "dim")
    t.nation.select("n_nationkey", "n_name").write.option("header", "true").csv(path)
    dim = fs.read_delimited(t.spark, path, "n_nationkey int, n_name string")
    joined = t.customer.join(dim, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("customers"), total("c_acctbal").alias("balance"))


@query("compare_formats", "S49", "SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b, COUNT(*) AS n_rows FROM customer")
def _(t):
    a, b = scratch_path(t.spark, "as-parquet"), scratch_path(t.spark, "as-orc")
    t.customer.write.parquet(a)
    t.customer.write.orc(b)
    one, two = t.spark.read.parquet(a), t.spark.read.orc(b)
    return fs.same_rows(one, two).withColumn("n_rows", one.agg(F.count("*")).scalar())
