"""Pseudonymisation queries.  Customers get an e-mail and phone derived from their key."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.functions.common import total
from lakeops.operators import privacy as p
from lakeops.operators.privacy import Rule
from lakeops.plans.registry import query
from lakeops.plans.relational import dsum

KEY = "0123456789abcdef0123456789abcdef"
PEOPLE = """(SELECT c_custkey, c_name, 'c' || c_custkey || '@shop' || c_nationkey || '.example.com' AS email,
  '555-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone, lpad(CAST(c_custkey AS VARCHAR), 16, '4') AS card_no,
  'Street ' || c_nationkey AS address_line, c_mktsegment AS address_city, c_acctbal, c_mktsegment FROM customer)"""


def people(t):
    key = F.col("c_custkey").cast("string")
    return t.customer.select(
        "c_custkey",
        "c_name",
        F.concat(F.lit("c"), key, F.lit("@shop"), F.col("c_nationkey").cast("string"), F.lit(".example.com")).alias("email"),
        F.concat(F.lit("555-"), F.lpad(key, 7, "0")).alias("phone"),
        F.lpad(key, 16, "4").alias("card_no"),
        F.concat(F.lit("Street "), F.col("c_nationkey").cast("string")).alias("address_line"),
        F.col("c_mktsegment").alias("address_city"),
        "c_acctbal",
        "c_mktsegment",
    )


@query(
    "mask_redact_modes",
    "R01",
    f"""SELECT c_custkey, '***-**-****' AS c_name, substr(email, 1, 1) || '****@' || split_part(email, '@', 2) AS email,
              '****' || right(phone, 4) AS phone, '****-****-****-' || right(card_no, 4) AS card_no FROM {PEOPLE}""",
)
def _(t):
    rules = [
        Rule("c_name", "redact", {"mask": "***-**-****"}),
        Rule("email", "redact", {"mode": "email"}),
        Rule("phone", "redact", {"mode": "phone"}),
        Rule("card_no", "redact", {"mode": "card"}),
    ]
    return p.apply_rules(people(t).select("c_custkey", "c_name", "email", "phone", "card_no"), rules)


@query(
    "mask_partial",
    "R02",
    f"SELECT c_custkey, repeat('*', greatest(length(phone) - 5, 0)) || right(phone, 5) AS phone, repeat('*', length(c_name) - 2) || right(c_name, 2) AS c_name FROM {PEOPLE}",
)
def _(t):
    rules = [Rule("phone", "mask", {"show": 5}), Rule("c_name", "mask", {"show": 2})]
    return p.apply_rules(people(t).select("c_custkey", "phone", "c_name"), rules)


@query("mask_hash", "R03", "SELECT doc_id, sha256(text) AS text, sha256(source) AS source FROM documents")
def _(t):
    return p.apply_rules(t.documents.select("doc_id", "text", "source"), [Rule("text", "hash"), Rule("source", "hash")])


@query(
    "mask_keyed_hash",
    "R04",
    "SELECT c_custkey, sha256('name_salt|person|' || c_name) AS c_name, sha256('name_salt|order|' || c_mktsegment) AS c_mktsegment FROM customer",
)
def _(t):
    rules = [
        Rule("c_name", "keyed_hash", {"salt": "name_salt"}, scope="person"),
        Rule("c_mktsegment", "keyed_hash", {"salt": "name_salt"}, scope="order"),
    ]
    return p.apply_rules(t.customer.select("c_custkey", "c_name", "c_mktsegment"), rules)


@query(
    "mask_tokenize",
    "R05",
    "SELECT event_id, 'TOK_' || substr(sha256('tok||' || CAST(user_id AS VARCHAR)), 1, 24) AS user_id FROM events",
)
def _(t):
    rules = [Rule("user_id", "tokenize", {"salt": "tok"})]
    return p.apply_rules(t.events.select("event_id", "user_id"), rules)


@query(
    "mask_tokens_across_loads",
    "R05",
    """SELECT 'TOK_' || substr(sha256('tok||' || CAST(user_id AS VARCHAR)), 1, 24) AS token, COUNT(*) FILTER (WHERE event_id % 2 = 0) AS first_load,
       COUNT(*) FILTER (WHERE event_id % 2 = 1) AS second_load FROM events GROUP BY 1""",
)
def _(t):
    # Two loads tokenised apart: equal values meet under equal tokens.
    rules = [Rule("user_id", "tokenize", {"salt": "tok"})]
    first, second = (p.apply_rules(t.events.where(F.col("event_id") % 2 == k).select("user_id"), rules).withColumn("load", F.lit(k)) for k in (0, 1))
    both = first.unionByName(second).groupBy(F.col("user_id").alias("token"))
    return both.agg(F.count_if(F.col("load") == 0).alias("first_load"), F.count_if(F.col("load") == 1).alias("second_load"))


@query(
    "mask_encrypt_round_trip",
    "R06",
    "SELECT COUNT(*) AS n, COUNT(*) AS restored, 0::BIGINT AS readable FROM customer",
)
def _(t):
    sealed = t.customer.select("c_name", p.encrypt("c_name", KEY).alias("sealed"))
    return sealed.agg(
        F.count("*").alias("n"),
        F.count_if(p.decrypt("sealed", KEY) == F.col("c_name")).alias("restored"),
        F.count_if(F.col("sealed").contains("Customer")).alias("readable"),
    )


@query(
    "mask_generalize",
    "R07",
    """SELECT o_orderkey, CAST(floor(o_totalprice / 10000) * 10000 AS BIGINT) AS price_band, CAST(year(o_orderdate) AS VARCHAR) AS y,
              year(o_orderdate) || 'Q' || quarter(o_orderdate) AS q, (year(o_orderdate) // 10 * 10) || 's' AS d, strftime(o_orderdate, '%Y-%m') AS m FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        p.generalize_number("o_totalprice", 10000).alias("price_band"),
        p.generalize_date("o_orderdate", "year").alias("y"),
        p.generalize_date("o_orderdate", "quarter").alias("q"),
        p.generalize_date("o_orderdate", "decade").alias("d"),
        p.generalize_date("o_orderdate", "month").alias("m"),
    )


RULES = [
    Rule("address_*", "hash", priority=1),
    Rule("*_name", "keyed_hash", {"salt": "s1"}, scope="person", priority=3),
    Rule("address_city", "redact", {"mask": "[CITY]"}, priority=5),
    Rule("email", "redact", {"mode": "email"}, exempt_roles=frozenset({"support", "auditor"})),
    Rule("phone", "mask", {"show": 4}, exempt_users=frozenset({"dora"})),
    Rule("c_acctbal", "generalize", {"range": 1000}, exempt_roles=frozenset({"auditor", "analyst"})),
]
RULE_COLS = ["c_custkey", "c_name", "email", "phone", "address_line", "address_city"]
MASKED = {
    "c_name": "sha256('s1|person|' || c_name)",
    "email": "substr(email, 1, 1) || '****@' || split_part(email, '@', 2)",
    "phone": "repeat('*', length(phone) - 4) || right(phone, 4)",
    "address_line": "sha256(address_line)",
    "address_city": "'[CITY]'",
}


def masked_sql(clear=()) -> str:
    cols = [c if c in clear or c not in MASKED else f"{MASKED[c]} AS {c}" for c in RULE_COLS]
    return f"SELECT {', '.join(cols)} FROM {PEOPLE}"


@query("mask_rule_set", "R08", masked_sql())
def _(t):
    return p.apply_rules(people(t).select(*RULE_COLS), RULES)


@query("mask_exempt_reader", "R09", masked_sql(clear=("email", "phone")))
def _(t):
    return p.apply_rules(people(t).select(*RULE_COLS), RULES, role="support", user="dora")


@query(
    "mask_aggregates_stay_true",
    "R10",
    f"SELECT c_mktsegment, COUNT(*) AS n, COUNT(DISTINCT c_name) AS people, {dsum('c_acctbal')} AS balance FROM customer GROUP BY 1",
)
def _(t):
    safe = [r for r in RULES if r.pattern != "c_acctbal"]
    masked = p.apply_rules(people(t), safe)
    return masked.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.countDistinct("c_name").alias("people"), total("c_acctbal").alias("balance")
    )


@query(
    "mask_linkage",
    "R11",
    f"""SELECT sha256('link|person|' || c_custkey) AS person, COUNT(*) AS orders, {dsum('o_totalprice')} AS value
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def _(t):
    rule = {"salt": "link"}
    a = p.apply_rules(t.customer.select(F.col("c_custkey").alias("person")), [Rule("person", "keyed_hash", rule, scope="person")])
    b = p.apply_rules(
        t.orders.select(F.col("o_custkey").alias("person"), "o_totalprice"), [Rule("person", "keyed_hash", rule, scope="person")]
    )
    return b.join(a, "person").groupBy("person").agg(F.count("*").alias("orders"), total("o_totalprice").alias("value"))


@query(
    "mask_role_views",
    "R12",
    f"""SELECT 'analyst' AS role, COUNT(DISTINCT sha256('s1|person|' || c_name)) AS names, COUNT(DISTINCT c_acctbal) AS balances, MIN({MASKED['email']}) AS first_email FROM {PEOPLE}
        UNION ALL SELECT 'support', COUNT(DISTINCT c_name), COUNT(DISTINCT floor(c_acctbal / 1000)), MIN(email) FROM {PEOPLE}
        UNION ALL SELECT 'executive', COUNT(DISTINCT c_name), COUNT(DISTINCT floor(c_acctbal / 1000)), MIN({MASKED['email']}) FROM {PEOPLE}""",
)
def _(t):
    parts = []
    for role in ("analyst", "support", "executive"):
        view = p.apply_rules(people(t), RULES, role=role)
        parts.append(
            view.agg(
                F.lit(role).alias("role"),
                F.countDistinct("c_name").alias("names"),
                F.countDistinct("c_acctbal").alias("balances"),
                F.min("email").alias("first_email"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
