"""Lookups, filters, joins and store semantics over the driver tables, with their oracles.

customers stand for companies, nations for exchanges, orders for earnings reports (customer key for ticker, order
date for report time, total price for the figure), suppliers for a second source of companies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, validate
from ..operators import dedup, predicates, store

DAY = "1995-03-15"


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def q1_list_companies(s, d):
    return t(s, d, "customer").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").limit(50)


def q2_calendar_day(s, d):
    node = {"operator": "and", "operands": [
        {"operator": "gte", "operands": ["o_orderdate", f"{DAY} 00:00:00"]}, {"operator": "lt", "operands": ["o_orderdate", "1995-04-15 00:00:00"]},
        {"operator": "or", "operands": [{"operator": "eq", "operands": ["o_orderpriority", "1-URGENT"]}, {"operator": "eq", "operands": ["o_orderpriority", "2-HIGH"]}]}]}
    return t(s, d, "orders").where(predicates.tree(node)).select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice").orderBy("o_custkey", "o_orderkey")


def q3_estimate_present(s, d):
    e = t(s, d, "events").withColumn("estimate", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 != 0, F.col("value")))
    return e.where(validate.present(F.col("estimate"))).select("event_id", F.round("estimate", 4).alias("estimate"))


def q4_in_list(s, d):
    return t(s, d, "orders").where(F.col("o_custkey").isin([1, 2, 4, 7, 11, 17, 40]) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_custkey", "o_totalprice")


def q5_history(s, d):
    return t(s, d, "orders").where("o_custkey = 7").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey")


def q6_keys_in_range(s, d):
    return t(s, d, "orders").where(f"o_orderdate >= timestamp_ntz'{DAY}' and o_orderdate < timestamp_ntz'1995-03-20'").select("o_custkey").distinct()


def q7_resume_from(s, d):
    c = t(s, d, "customer")
    return c.where(F.upper("c_name") >= F.upper(F.lit("customer#000000100"))).select("c_custkey", "c_name").orderBy("c_name")


def q8_calendar_spine(s, d):
    days = s.range(1).select(F.explode(dates.days_between(F.lit("1995-03-31").cast("date"), F.lit("1995-03-01").cast("date"))).alias("day"))
    counted = t(s, d, "orders").where("o_orderdate >= timestamp_ntz'1995-03-01' and o_orderdate < timestamp_ntz'1995-04-01'").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(days).join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def q9_surprise(s, d):
    li, p = t(s, d, "lineitem"), t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    actual = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.floor(F.col("l_extendedprice") / F.col("l_quantity")))
    x = validate.surprise(actual, F.when(F.col("p_retailprice") > 910, F.col("p_retailprice")))
    return li.join(p, "l_partkey").select("l_orderkey", "l_linenumber", F.round(x, 2).alias("surprise"))


def q10_ranked_scan(s, d):
    criteria = [("p_retailprice", "gte", 905.0), ("p_retailprice", "lte", None), ("p_size", "gte", 5), ("p_size", "lte", 40), ("p_brand", "in", None)]
    return predicates.scan(t(s, d, "part"), criteria, "p_retailprice", 250, "p_partkey").select("rank", "p_partkey", "p_retailprice")


def q11_executions(s, d):
    criteria = [("l_suppkey", "eq", None), ("l_returnflag", "eq", "R"), ("l_linestatus", "eq", None), ("l_quantity", "gte", 45.0), ("l_linenumber", "in", [1, 2])]
    return t(s, d, "lineitem").where(predicates.optional(criteria)).select("l_orderkey", "l_linenumber", "l_quantity")


def q12_conditions(s, d):
    chain = [("l_quantity", True, 49.0, True), ("l_discount", True, 0.05, False), ("l_extendedprice", False, 1000.0, True), ("l_tax", False, 0.04, True)]
    return t(s, d, "lineitem").where(predicates.conditions(chain)).select("l_orderkey", "l_linenumber")


def q14_company_profile(s, d):
    n = t(s, d, "nation")
    firms = t(s, d, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_name").alias("company_name"))
    # A company is listed at its nation and, every third one, at the nation after it.
    c = t(s, d, "customer")
    bridge = c.select(F.col("c_custkey").alias("company_ticker"), F.explode(F.when(F.col("c_custkey") % 3 == 0, F.array("c_nationkey", (F.col("c_nationkey") + 1) % 25)).when(F.col("c_custkey") % 3 == 1, F.array("c_nationkey"))).alias("exchange_id"))
    return store.company_profile(firms, bridge, F.broadcast(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))))  # nations: 25


def q15_scalar_subquery(s, d):
    t(s, d, "customer").createOrReplaceTempView("q15_customer")
    t(s, d, "nation").createOrReplaceTempView("q15_nation")
    return s.sql("SELECT c_custkey, (SELECT max(n_name) FROM q15_nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey < 3) AS nation FROM q15_customer c")


def q16_seen_ids(s, d):
    e = t(s, d, "events")
    seen = e.where("event_type = 'error'").select("user_id").distinct()
    return dedup.unseen(e.where("event_type = 'purchase'"), "user_id", "ts", "event_id", seen=seen.where("user_id % 2 = 0")).select("user_id", "event_id")


def q20_insert_or_ignore(s, d):
    c = t(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    base = c.where("c_custkey % 2 = 0")
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("NEW "), "c_name")).alias("c_name"), "c_mktsegment", F.lit(1).alias("seq"))
    again = new.withColumns({"seq": F.lit(2), "c_mktsegment": F.lit("LATER")})
    return store.insert_or_ignore(base, new.unionByName(again), ["c_custkey"], "seq", ["c_name"])


def q21_upsert(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    base = o.where("o_orderkey % 2 = 0")
    new = o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") + 1, 2).alias("o_totalprice"), F.lit(1).alias("seq"))
    last = o.where("o_orderkey % 6 = 0").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") + 2, 2).alias("o_totalprice"), F.lit(2).alias("seq"))
    return store.upsert(base, new.unionByName(last), ["o_orderkey"], "seq")


def q22_upsert_validated(s, d):
    o = t(s, d, "orders")
    ticker = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("much-too-long-"), F.col("o_custkey"))).when(F.col("o_orderkey") % 13 == 0, "$$").otherwise(F.concat(F.lit("c!"), F.col("o_custkey")))
    new = o.select(ticker.alias("company_ticker"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate")).alias("report_datetime"), F.when(F.col("o_orderkey") % 19 == 0, "  ").otherwise(F.concat(F.lit(" Firm "), F.col("o_custkey"))).alias("company_name"), F.when(F.col("o_orderkey") % 23 == 0, F.lit(2e12)).otherwise(F.col("o_totalprice")).alias("market_cap"), F.col("o_orderkey").alias("seq"))
    return store.upsert_earnings(new.drop("seq").limit(0), new, "seq")


def q23_upsert_referring(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    parents = t(s, d, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey")
    # Each order also moves to the customer after its own, where that one exists; the table has all orders.
    new = o.select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), "o_orderstatus", F.lit(1).alias("seq"))
    new = new.unionByName(o.select("o_orderkey", (F.col("o_custkey") + 2).alias("o_custkey"), "o_orderstatus", F.lit(2).alias("seq")))
    return store.upsert_referring(o, new, ["o_orderkey"], "seq", parents, "c_custkey", "o_custkey")


def q24_coalesce_update(s, d):
    base = t(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("sector"), "c_name")
    changes = t(s, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("sector"))
    return store.coalesce_update(base, changes, ["c_custkey"], ["sector"])


def q25_cascade_delete(s, d):
    left = t(s, d, "customer").where("c_acctbal >= 0")
    return store.cascade_delete(t(s, d, "orders").select("o_orderkey", "o_custkey"), left, "c_custkey", "o_custkey")


def q26_success_counts(s, d):
    joined = t(s, d, "documents").select("doc_id", "lang").join(t(s, d, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("succeeded"), F.count_if(F.col("quality") == 0).alias("failed"), F.count_if(F.col("quality").isNull()).alias("pending"))


def q45_validators(s, d):
    c = t(s, d, "customer")
    raw = F.concat(F.when(F.col("c_custkey") % 4 == 0, " a$b.").when(F.col("c_custkey") % 4 == 1, "x-").otherwise("tick#"), F.col("c_custkey").cast("string"))
    name = F.when(F.col("c_custkey") % 9 == 0, "   ").when(F.col("c_custkey") % 10 == 0, F.repeat(F.lit("n"), 201)).otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    number = F.when(F.col("c_custkey") % 6 == 0, "n/a").when(F.col("c_custkey") % 6 == 1, "3e12").otherwise(F.col("c_acctbal").cast("string"))
    return c.select("c_custkey", validate.ticker(raw).alias("ticker"), validate.company_name(name).alias("company_name"), F.round(validate.numeric(number), 2).alias("amount"))


def q47_eastern_to_utc(s, d):
    return t(s, d, "orders").select("o_orderkey", dates.eastern_to_utc(F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz").alias("utc"))


QUERIES = [q1_list_companies, q2_calendar_day, q3_estimate_present, q4_in_list, q5_history, q6_keys_in_range, q7_resume_from, q8_calendar_spine, q9_surprise, q10_ranked_scan, q11_executions, q12_conditions, q14_company_profile, q15_scalar_subquery, q16_seen_ids, q20_insert_or_ignore, q21_upsert, q22_upsert_validated, q23_upsert_referring, q24_coalesce_update, q25_cascade_delete, q26_success_counts, q45_validators, q47_eastern_to_utc]

ORACLES = {
    "q1_list_companies": "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 50",
    "q2_calendar_day": f"SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '{DAY}' AND o_orderdate < TIMESTAMP '1995-04-15' AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "q3_estimate_present": "SELECT event_id, round(value, 4) AS estimate FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0 AND value IS NOT NULL AND NOT isnan(value)",
    "q4_in_list": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (1, 2, 4, 7, 11, 17, 40) AND o_orderstatus = 'F'",
    "q5_history": "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_custkey = 7",
    "q6_keys_in_range": f"SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{DAY}' AND o_orderdate < TIMESTAMP '1995-03-20'",
    "q7_resume_from": "SELECT c_custkey, c_name FROM customer WHERE upper(c_name) >= 'CUSTOMER#000000100'",
    "q8_calendar_spine": "SELECT CAST(g AS DATE) AS day, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) = CAST(g AS DATE)) AS n FROM generate_series(DATE '1995-03-01', DATE '1995-03-31', INTERVAL 1 DAY) AS r(g)",
    "q9_surprise": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 OR NOT p_retailprice > 910 THEN 'nan'::DOUBLE ELSE round(floor(l_extendedprice / l_quantity) - p_retailprice, 2) END AS surprise FROM lineitem JOIN part ON l_partkey = p_partkey",
    "q10_ranked_scan": "SELECT CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS INTEGER) AS rank, p_partkey, p_retailprice FROM part WHERE p_retailprice >= 905 AND p_size BETWEEN 5 AND 40 QUALIFY rank < 250",
    "q11_executions": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 AND l_linenumber IN (1, 2)",
    "q12_conditions": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE ((l_quantity >= 49 AND l_discount >= 0.05) OR l_extendedprice <= 1000) AND l_tax <= 0.04",
    "q14_company_profile": """
        SELECT c_custkey AS ticker, c_name AS company_name,
               (SELECT string_agg(n_name, ', ' ORDER BY n_name) FROM nation
                WHERE (c_custkey % 3 IN (0, 1) AND n_nationkey = c_nationkey) OR (c_custkey % 3 = 0 AND n_nationkey = (c_nationkey + 1) % 25)) AS exchanges
        FROM customer""",
    "q15_scalar_subquery": "SELECT c_custkey, (SELECT max(n_name) FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey < 3) AS nation FROM customer c",
    "q16_seen_ids": "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id % 2 = 0) GROUP BY user_id",
    "q20_insert_or_ignore": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'NEW ' || c_name, c_mktsegment FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0 AND c_custkey % 5 <> 0",
    "q21_upsert": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 6 = 0 THEN round(o_totalprice + 2, 2) WHEN o_orderkey % 3 = 0 THEN round(o_totalprice + 1, 2) ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
    "q22_upsert_validated": """
        SELECT company_ticker, report_datetime, company_name, market_cap FROM (
          SELECT 'C' || o_custkey AS company_ticker, o_orderdate AS report_datetime, 'Firm ' || o_custkey AS company_name,
                 CASE WHEN o_orderkey % 23 <> 0 THEN o_totalprice END AS market_cap,
                 row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS n
          FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0) WHERE n = 1""",
    "q23_upsert_referring": """
        WITH parent AS (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
        SELECT o_orderkey, CASE WHEN o_custkey + 2 IN (SELECT c_custkey FROM parent) THEN o_custkey + 2 WHEN o_custkey + 1 IN (SELECT c_custkey FROM parent) THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus
        FROM orders""",
    "q24_coalesce_update": "SELECT c_custkey, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_name END, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END) AS sector, c_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
    "q25_cascade_delete": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
    "q26_success_counts": "SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS succeeded, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (quality IS NULL) AS pending FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "q45_validators": """
        SELECT c_custkey,
          CASE WHEN length(raw) <= 10 THEN nullif(upper(regexp_replace(raw, '[^a-zA-Z0-9.-]', '', 'g')), '') END AS ticker,
          CASE WHEN c_custkey % 9 <> 0 AND c_custkey % 10 <> 0 THEN c_name END AS company_name,
          CASE WHEN c_custkey % 6 > 1 THEN round(c_acctbal, 2) END AS amount
        FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN ' a$b.' WHEN 1 THEN 'x-' ELSE 'tick#' END || c_custkey AS raw FROM customer)""",
    "q47_eastern_to_utc": "SELECT o_orderkey, timezone('UTC', timezone('America/New_York', o_orderdate)) AS utc FROM orders",
}
