"""Segment message queries.  Every order becomes a message, which is then parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.functions.common import day
from lakeops.plans.registry import query
from lakeops.session import scratch_path
from lakeops.sources import segments as sg


def s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c


def x12_text(t):
    """An interchange per order: a purchase order with three REF segments and an acknowledgment."""
    key = s("o_orderkey")
    isa = F.concat(
        F.lit("ISA*00*          *00*          *ZZ*CUST"), F.lpad(s("o_custkey"), 11, "0"),
        F.lit("*ZZ*LAKEOPS        *980601*1200*U*00401*"), F.lpad(key, 9, "0"), F.lit("*0*P*:~\n"),
    )
    order = F.concat(
        F.lit("GS*PO*C*S*19980601*1200*1*X*004010~\nST*850*0001~\nBEG*00*NE*PO"), key, F.lit("**"), day("o_orderdate"), F.lit("~\n"),
        F.lit("REF*ST*"), s("o_orderstatus"), F.lit("~\nREF*PR*"), s("o_orderpriority"), F.lit("~\nREF*CU*"), s("o_custkey"),
        F.lit("~\nAMT*TT*"), s("o_totalprice"), F.lit("~\nSE*7*0001~\n"),
    )
    ack = F.concat(F.lit("ST*997*0002~\nAK1*PO*"), key, F.lit("~\nAK9*"), F.when(F.col("o_orderstatus") == "P", "R").otherwise("A"), F.lit("*1*1*1~\nSE*4*0002~\n"))
    return t.orders.select(F.concat(isa, order, ack, F.lit("GE*2*1~\nIEA*1*"), F.lpad(key, 9, "0"), F.lit("~")).alias("body"))


def x12(t):
    return sg.parse_messages(x12_text(t), "body", sg.X12)


ENVELOPE = {"isa_6": ("ISA", 6), "isa_13": ("ISA", 13), "gs_1": ("GS", 1), "st_1": ("ST", 1)}
ENVELOPE_SQL = "'CUST' || lpad(CAST(o_custkey AS VARCHAR), 11, '0') AS isa_6, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS isa_13, 'PO' AS gs_1"
X12_SQL = f"""SELECT {ENVELOPE_SQL}, '850' AS st_1, 'PO' || o_orderkey AS beg_3, o_totalprice AS amount, 5 AS body_segments FROM orders
  UNION ALL SELECT {ENVELOPE_SQL}, '997', NULL, NULL, 2 FROM orders"""


def envelope(df):
    return df.withColumns({k: sg.header_column(*v) for k, v in ENVELOPE.items()})


def x12_columns(df):
    out = sg.materialize(envelope(df), ["beg_3", "amt_2"], sg.X12)
    return out.select(
        *ENVELOPE, "beg_3", F.col("amt_2").try_cast("double").alias("amount"), F.size("segments").alias("body_segments")
    )


@query("messages_x12", "S24 S28", X12_SQL)
def _(t):
    return x12_columns(x12(t))


@query("messages_x12_files", "S24", X12_SQL)
def _(t):
    path = scratch_path(t.spark, "x12")
    x12_text(t).write.text(path)
    return x12_columns(sg.read_x12_files(t.spark, path))


@query(
    "messages_x12_document",
    "S24 D15",
    """SELECT 'PO' || o_orderkey AS po, 'BEG' AS first_segment, 5 AS body_segments, 'simple' AS class, 64 AS id_length FROM orders""",
)
def _(t):
    docs = sg.with_document(x12(t), sg.X12).withColumn("json", F.col("df_transaction_json"))
    n = F.json_array_length("json")
    rows = docs.select(
        F.get_json_object("json", "$[0].elements[2].value").alias("po"),
        F.get_json_object("json", "$[0].segment").alias("first_segment"),
        n.alias("body_segments"),
        F.when(n < 15, "simple").when(n <= 35, "medium").otherwise("complex").alias("class"),
        F.length("df_transaction_id").alias("id_length"),
        sg.header_column("ST", 1).alias("kind"),
    )
    return rows.where("kind = '850'").drop("kind")


def refs(t, mode, **kw):
    orders = x12(t).where(sg.header_column("ST", 1) == "850")
    return sg.materialize(orders, ["beg_3", "ref_2"], sg.X12, mode=mode, **kw)


@query(
    "messages_repeat_indexed",
    "S29",
    """SELECT 'PO' || o_orderkey AS beg_1_3, o_orderstatus AS ref_1_2, o_orderpriority AS ref_2_2, CAST(o_custkey AS VARCHAR) AS ref_3_2, NULL::VARCHAR AS ref_4_2 FROM orders""",
)
def _(t):
    return refs(t, "indexed", max_repeating=4).select("beg_1_3", "ref_1_2", "ref_2_2", "ref_3_2", "ref_4_2")


@query(
    "messages_repeat_concatenate",
    "S30",
    "SELECT 'PO' || o_orderkey AS beg_3, concat_ws('|', o_orderstatus, o_orderpriority, o_custkey) AS ref_2 FROM orders",
)
def _(t):
    return refs(t, "concatenate").select("beg_3", "ref_2")


@query(
    "messages_repeat_json",
    "S31",
    """SELECT '["PO' || o_orderkey || '"]' AS beg_3, '["' || o_orderstatus || '","' || o_orderpriority || '","' || o_custkey || '"]' AS ref_2 FROM orders""",
)
def _(t):
    return refs(t, "to_json").select("beg_3", "ref_2")


@query(
    "messages_friendly_aliases",
    "S32",
    "SELECT 'PO' || o_orderkey AS purchaseordernumber_beg_3, o_orderstatus AS referenceidentification_ref_2 FROM orders",
)
def _(t):
    names = {"beg_3": "purchaseordernumber", "ref_2": "referenceidentification"}
    out = refs(t, "first", names=names)
    return out.select("purchaseordernumber_beg_3", "referenceidentification_ref_2")


def edifact_text(t):
    key = s("o_orderkey")
    body = F.concat(
        F.lit("UNA:+.? 'UNB+UNOA:2+BUYER"), s("o_custkey"), F.lit("+SELLER+980601:1200+"), key, F.lit("'\n"),
        F.lit("UNH+1+ORDERS:D:96A:UN'BGM+220+"), key, F.lit("+9'FTX+AAI+++it?'s ?+"), s("o_orderpriority"), F.lit("??'MOA+86:"), s("o_totalprice"),
        F.lit("'UNT+5+1'\nUNH+2+INVOIC:D:96A:UN'BGM+380+"), key, F.lit("'UNT+3+2'UNZ+2+"), key, F.lit("'"),
    )
    return t.orders.select(body.alias("body"))


EDIFACT_SQL = """SELECT 'BUYER' || o_custkey AS unb_2, 'ORDERS' AS kind, CAST(o_orderkey AS VARCHAR) AS bgm_2, 'it''s +' || o_orderpriority || '?' AS ftx_4, o_totalprice AS amount FROM orders
       UNION ALL SELECT 'BUYER' || o_custkey, 'INVOIC', CAST(o_orderkey AS VARCHAR), NULL, NULL FROM orders"""


def edifact_columns(rows):
    out = sg.materialize(rows, ["bgm_2", "ftx_4", "moa_1"], sg.EDIFACT)
    return out.select(
        sg.header_column("UNB", 2).alias("unb_2"),
        F.get(sg.components(sg.header_column("UNH", 2)), F.lit(0)).alias("kind"),
        "bgm_2",
        "ftx_4",
        F.get(F.split("moa_1", ":"), F.lit(1)).try_cast("double").alias("amount"),
    )


@query("messages_edifact", "S25 S51", EDIFACT_SQL)
def _(t):
    return edifact_columns(sg.parse_messages(edifact_text(t), "body", sg.EDIFACT))


@query("messages_edifact_files", "S25 S51", EDIFACT_SQL)
def _(t):
    path = scratch_path(t.spark, "edifact")
    edifact_text(t).write.text(path)
    return edifact_columns(sg.read_edifact_files(t.spark, path))


def tradacoms_text(t):
    """Two messages: an invoice with net, tax and gross amounts in pence, and a trailer."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    tax = F.floor(cents / 10)
    body = F.concat(
        F.lit("STX=ANA:1+5000:Buyer "), s("o_custkey"), F.lit("+SELL+980601'\nMHD=1+INVFIL:9'TYP=0700+INVOICES'"),
        F.lit("SDT=5010:"), s("o_orderkey"), F.lit("+A?+B?'s'"), F.lit("VLR="), cents.cast("string"), F.lit("+"), tax.cast("string"), F.lit("+"),
        (cents + tax + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).cast("string"), F.lit("'MTR=5'\nMHD=2+INVTLR:9'VTS=1'MTR=3'END=2'"),
    )
    return t.orders.select(body.alias("body"))


TRADACOMS_SQL = """SELECT 'Buyer ' || o_custkey AS sender, 'INVFIL' AS kind, '5010:' || o_orderkey AS sdt_1, 'A+B''s' AS sdt_2 FROM orders
       UNION ALL SELECT 'Buyer ' || o_custkey, 'INVTLR', NULL, NULL FROM orders"""


def tradacoms_columns(rows):
    out = sg.materialize(rows, ["sdt_1", "sdt_2"], sg.TRADACOMS)
    return out.select(
        F.get(sg.components(sg.header_column("STX", 2)), F.lit(1)).alias("sender"),
        F.get(sg.components(sg.header_column("MHD", 2)), F.lit(0)).alias("kind"),
        "sdt_1",
        "sdt_2",
    )


@query("messages_tradacoms", "S26 S51", TRADACOMS_SQL)
def _(t):
    return tradacoms_columns(sg.parse_messages(tradacoms_text(t), "body", sg.TRADACOMS))


@query("messages_tradacoms_files", "S26 S51", TRADACOMS_SQL)
def _(t):
    path = scratch_path(t.spark, "tradacoms")
    tradacoms_text(t).write.text(path)
    return tradacoms_columns(sg.read_tradacoms_files(t.spark, path))


def hl7_text(t):
    """A lab result per order: two observations; the name needs escapes."""
    seg = [
        F.concat(F.lit("MSH|^~\\&|LAB|SITE"), s("o_custkey"), F.lit("|EHR|MAIN|19980601||ORU^R01|"), s("o_orderkey"), F.lit("|P|2.3")),
        F.concat(F.lit("PID|1||P"), s("o_custkey"), F.lit("||DOE\\T\\SON^J\\S\\N^\\F\\\\E\\")),
        F.concat(F.lit("OBX|1|NM|PRICE||"), s("o_totalprice"), F.lit("|USD||H")),
        F.concat(F.lit("OBX|2|ST|NOTE||"), s("o_orderpriority"), F.lit("||")),
    ]
    return t.orders.select(F.concat_ws("\r", *seg).alias("body"))


HL7_SQL = """SELECT 'SITE' || o_custkey AS msh_4, 'ORU^R01' AS msh_9, CAST(o_orderkey AS VARCHAR) AS msh_10, '|' AS msh_1, 'P' || o_custkey AS pid_3,
  'DOE&SON^J^N^|' || chr(92) AS pid_5, o_totalprice AS obx_5, 'PRICE|NOTE' AS obx_3 FROM orders"""


def hl7_columns(rows):
    out = sg.materialize(rows, ["msh_1", "msh_4", "msh_9", "msh_10", "pid_3", "pid_5", "obx_5"], sg.HL7)
    out = sg.materialize(out, ["obx_3"], sg.HL7, mode="concatenate")
    return out.select("msh_1", "msh_4", "msh_9", "msh_10", "pid_3", "pid_5", F.col("obx_5").try_cast("double").alias("obx_5"), "obx_3")


@query("messages_hl7", "S27 S51", HL7_SQL)
def _(t):
    return hl7_columns(sg.parse_messages(hl7_text(t), "body", sg.HL7))


@query("messages_hl7_files", "S27", HL7_SQL)
def _(t):
    path = scratch_path(t.spark, "hl7")
    hl7_text(t).write.text(path)
    return hl7_columns(sg.read_hl7_files(t.spark, path))


@query(
    "messages_control_totals",
    "D21",
    """SELECT 'ANA' AS standard, COUNT(*) AS invoices, COUNT(*) FILTER (WHERE o_orderstatus <> 'P') AS agree, CAST(SUM(CAST(o_totalprice * 100 AS DECIMAL(18,0))) AS DOUBLE) AS net_pence FROM orders""",
)
def _(t):
    rows = sg.parse_messages(tradacoms_text(t), "body", sg.TRADACOMS)
    out = sg.materialize(rows, ["vlr_1", "vlr_2", "vlr_3"], sg.TRADACOMS).where("vlr_1 IS NOT NULL")
    net, tax, gross = (F.col(f"vlr_{i}").try_cast("bigint") for i in (1, 2, 3))
    kind = F.get(sg.components(sg.header_column("STX", 1)), F.lit(0))
    return out.groupBy(kind.alias("standard")).agg(
        F.count("*").alias("invoices"), F.count_if(net + tax == gross).alias("agree"), F.sum(net).cast("double").alias("net_pence")
    )


@query(
    "messages_acknowledgments",
    "D14",
    "SELECT CASE WHEN o_orderstatus = 'P' THEN 'rejected' ELSE 'accepted' END AS outcome, COUNT(*) AS n FROM orders GROUP BY 1",
)
def _(t):
    acks = sg.materialize(x12(t), ["ak9_1"], sg.X12).where("ak9_1 IS NOT NULL")
    outcome = F.when(F.col("ak9_1") == "A", "accepted").when(F.col("ak9_1") == "R", "rejected").otherwise("partial")
    return acks.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
