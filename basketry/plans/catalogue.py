"""Named queries over the driver's tables, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import analytics as A
from ..operators import history as H
from ..operators import quality as Q
from ..sources import tables as T
from ..sources.tables import parquet
from ..streaming import events as E
from . import models as M
from . import warehouse

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


DAY = lambda c: F.to_date(c)
REV = lambda: (X.money("l_extendedprice") * (F.lit(1).cast("decimal(18,4)") - X.money("l_discount"))).cast("decimal(28,4)")
REV_SQL = "CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4))) AS DECIMAL(28,4))"


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_shipdate AS DATE) AS ship_date FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS n FROM lineitem) WHERE n = 1""")
def stg_dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("l_shipdate"), *map(F.col, ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"))]
    keep = {c: F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")} | {"ship_date": DAY("l_shipdate")}
    return H.stage(parquet(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order, keep)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS order_id, lower(trim(o_orderstatus)) AS status, nullif(trim(o_orderpriority), '4-NOT SPECIFIED') AS priority,
  coalesce(nullif(lower(trim(c_mktsegment)), ''), 'unknown') AS segment, c_custkey IS NULL AS is_missing_customer, o_totalprice < 0 AS is_negative_total,
  c_name LIKE 'Customer#%' AS is_valid_name, o_totalprice BETWEEN 1000 AND 100000 AS is_usual FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def stg_flags_defaults(spark: SparkSession, d: str) -> DataFrame:
    j = parquet(spark, d, "orders").join(parquet(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select(
        F.col("o_orderkey").cast("string").alias("order_id"), X.clean("o_orderstatus", lower=True).alias("status"), F.nullif(F.trim("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("priority"),
        X.clean("c_mktsegment", lower=True, default="unknown").alias("segment"), F.col("c_custkey").isNull().alias("is_missing_customer"), (F.col("o_totalprice") < 0).alias("is_negative_total"),
        F.col("c_name").like("Customer#%").alias("is_valid_name"), F.col("o_totalprice").between(1000, 100000).alias("is_usual"))


@query(f"""SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum({REV_SQL}) AS DOUBLE) AS net, CAST(round(sum({REV_SQL}), 2) AS DOUBLE) AS net_rounded FROM lineitem GROUP BY ALL""")
def line_total(spark: SparkSession, d: str) -> DataFrame:
    g = parquet(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n_lines"), F.sum(REV()).alias("net"))
    return g.select("l_returnflag", "l_linestatus", "n_lines", F.col("net").cast("double").alias("net"), F.round("net", 2).cast("double").alias("net_rounded"))



@query("""SELECT s_suppkey, s_name, CASE WHEN s_acctbal <= 1000 THEN 'fast' WHEN s_acctbal <= 4000 THEN 'standard' WHEN s_acctbal <= 7000 THEN 'slow' ELSE 'very_slow' END AS tier FROM supplier""")
def dim_supplier_tier(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "supplier").select("s_suppkey", "s_name", X.ladder(F.col("s_acctbal"), [(1000, "fast"), (4000, "standard"), (7000, "slow")], "very_slow").alias("tier"))


@query(f"""SELECT c_custkey, md5(coalesce(CAST(c_custkey AS VARCHAR), '{X.NULL_KEY}') || '-' || coalesce(nullif(c_mktsegment, 'BUILDING'), '{X.NULL_KEY}')) AS customer_key FROM customer""")
def surrogate_keys(spark: SparkSession, d: str) -> DataFrame:
    c = parquet(spark, d, "customer").withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return c.select("c_custkey", X.surrogate_key("c_custkey", "seg").alias("customer_key"))


PERIODS_SQL = """price_steps AS (SELECT l_partkey AS part, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS start, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) * 100 AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE)) / 100 AS p FROM lineitem GROUP BY ALL),
periods AS (SELECT part, start AS valid_from, coalesce(CAST(lead(start) OVER (PARTITION BY part ORDER BY start) - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS valid_to, p AS price, lead(start) OVER (PARTITION BY part ORDER BY start) IS NULL AS is_current FROM price_steps)"""


def _periods(spark: SparkSession, d: str) -> DataFrame:
    li = parquet(spark, d, "lineitem")
    p = li.groupBy(F.col("l_partkey").alias("part"), F.trunc(DAY("l_shipdate"), "quarter").alias("start")).agg(X.mean(F.sum(X.money("l_extendedprice")), F.sum(X.money("l_quantity")).cast("double")).alias("p"))
    return H.periods(p, "part", "start").select("part", "valid_from", "valid_to", F.col("p").alias("price"), "is_current")


@query(f"WITH {PERIODS_SQL} SELECT part, valid_from, valid_to, price, is_current FROM periods")
def price_periods(spark: SparkSession, d: str) -> DataFrame:
    return _periods(spark, d)


@query(f"""WITH {PERIODS_SQL} SELECT year(o_orderdate)::INT AS year, valid_from, count(*)::BIGINT AS n_lines, count(DISTINCT part)::BIGINT AS n_parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN periods ON l_partkey = part AND CAST(o_orderdate AS DATE) BETWEEN valid_from AND valid_to GROUP BY ALL""")
def fact_asof_join(spark: SparkSession, d: str) -> DataFrame:
    o = parquet(spark, d, "orders").select("o_orderkey", DAY("o_orderdate").alias("order_date"))
    lines = parquet(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    f = H.as_of_join(lines, _periods(spark, d), "part", "order_date")
    return f.groupBy(F.year("order_date").alias("year"), "valid_from").agg(F.count("*").alias("n_lines"), F.count_distinct("part").alias("n_parts"))


@query(f"""WITH {PERIODS_SQL} SELECT l_partkey, price, sum(l_quantity) AS on_hand, CASE WHEN sum(l_quantity) <= 0 THEN 'out' WHEN sum(l_quantity) <= 500 THEN 'critical' WHEN sum(l_quantity) <= 900 THEN 'low' ELSE 'ok' END AS stock_status,
  round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0) * 100, 2) AS reservation_rate_pct FROM lineitem JOIN periods ON l_partkey = part AND is_current GROUP BY l_partkey, price""")
def fact_current_join(spark: SparkSession, d: str) -> DataFrame:
    p = _periods(spark, d).filter("is_current").select("part", "price")
    g = parquet(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("part")).groupBy("l_partkey", "price").agg(F.sum("l_quantity").alias("on_hand"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).alias("r"))
    rate = F.round(F.try_divide(F.col("r"), F.col("on_hand")) * 100, 2).alias("reservation_rate_pct")
    return g.select("l_partkey", "price", "on_hand", X.ladder(F.col("on_hand"), [(0, "out"), (500, "critical"), (900, "low")], "ok").alias("stock_status"), rate)


@query("""WITH m AS (SELECT CAST(max(o_orderdate) AS DATE) AS d FROM orders) SELECT order_date, n + CASE WHEN order_date >= m.d - 3 THEN 0 ELSE 1000 END AS n_orders, order_date >= m.d - 3 AS is_fresh
  FROM (SELECT CAST(o_orderdate AS DATE) AS order_date, count(*)::BIGINT AS n FROM orders GROUP BY ALL), m""")
def fact_incremental_window(spark: SparkSession, d: str) -> DataFrame:
    o = parquet(spark, d, "orders").select(DAY("o_orderdate").alias("order_date"))
    last = F.lit(o.agg(F.max("order_date")).first()[0])
    by_day = o.groupBy("order_date").agg(F.count("*").alias("n_orders"))
    return H.replace_recent(by_day.withColumns({"n_orders": F.col("n_orders") + 1000, "is_fresh": F.lit(False)}), by_day.withColumn("is_fresh", F.lit(True)), "order_date", last)


RFM_SQL = """rfm AS (SELECT o_custkey AS customer, CAST(max(o_orderdate) AS DATE) AS last_order, count(DISTINCT o_orderkey)::BIGINT AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS spent FROM orders GROUP BY o_custkey),
scored AS (SELECT *, CAST(ntile(5) OVER (ORDER BY last_order DESC, customer) AS INT) AS r, CAST(ntile(5) OVER (ORDER BY orders, customer) AS INT) AS f, CAST(ntile(5) OVER (ORDER BY spent, customer) AS INT) AS m FROM rfm)"""
SEGMENT_SQL = M.SEGMENTS_QUERY


def _rfm(spark: SparkSession, d: str) -> DataFrame:
    g = parquet(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(DAY(F.max("o_orderdate")).alias("last_order"), F.count_distinct("o_orderkey").alias("orders"), F.sum(X.money("o_totalprice")).cast("double").alias("spent"))
    s = A.quantile_scores(g, {"r": [("last_order", False), ("customer", True)], "f": [("orders", True), ("customer", True)], "m": [("spent", True), ("customer", True)]})
    return s.withColumn("segment", F.expr(SEGMENT_SQL))


@query(f"WITH {RFM_SQL} SELECT customer, last_order, orders, spent, r, f, m, CAST(r AS VARCHAR) || CAST(f AS VARCHAR) || CAST(m AS VARCHAR) AS rfm, {SEGMENT_SQL} AS segment FROM scored")
def rfm_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rfm(spark, d).select("customer", "last_order", "orders", "spent", "r", "f", "m", F.concat(*(F.col(c).cast("string") for c in "rfm")).alias("rfm"), "segment")


@query(f"WITH {RFM_SQL} SELECT {SEGMENT_SQL} AS segment, count(*)::BIGINT AS customers, round(avg(orders), 2) AS avg_orders, min(CAST(r AS VARCHAR) || CAST(f AS VARCHAR)) AS lowest, max(CAST(r AS VARCHAR) || CAST(f AS VARCHAR)) AS highest FROM scored GROUP BY ALL")
def rfm_segments(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.col("r").cast("string"), F.col("f").cast("string"))
    return _rfm(spark, d).groupBy("segment").agg(F.count("*").alias("customers"), F.round(F.avg("orders"), 2).alias("avg_orders"), F.min(code).alias("lowest"), F.max(code).alias("highest"))


@query(f"""WITH r AS (SELECT p_brand, CAST(o_orderdate AS DATE) AS day, sum({REV_SQL}) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT p_brand, day, CAST(revenue AS DOUBLE) AS revenue, CAST(sum(revenue) OVER w AS DOUBLE) AS rolling_sum, round(CAST(sum(revenue) OVER w * 100 AS DOUBLE) / count(*) OVER w) / 100 AS rolling_avg, CAST(count(*) OVER w AS BIGINT) AS days FROM r WINDOW w AS (PARTITION BY p_brand ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling_revenue(spark: SparkSession, d: str) -> DataFrame:
    o = parquet(spark, d, "orders").select("o_orderkey", DAY("o_orderdate").alias("day"))
    p = parquet(spark, d, "part").select("p_partkey", "p_brand")
    li = parquet(spark, d, "lineitem").select("l_orderkey", "l_partkey", REV().alias("rev"))
    g = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "day").agg(F.sum("rev").alias("revenue"))
    w = Window.partitionBy("p_brand").orderBy("day").rowsBetween(-6, 0)
    return g.select("p_brand", "day", F.col("revenue").cast("double").alias("revenue"), F.sum("revenue").over(w).cast("double").alias("rolling_sum"), X.mean(F.sum("revenue").over(w), F.count("*").over(w)).alias("rolling_avg"), F.count("*").over(w).alias("days")).orderBy("p_brand", "day")


@query("""WITH c AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders GROUP BY o_custkey),
a AS (SELECT c.o_custkey, CAST(date_trunc('month', first_day) AS DATE) AS cohort, date_diff('day', first_day, CAST(o_orderdate AS DATE)) AS days FROM c LEFT JOIN orders USING (o_custkey))
SELECT strftime(cohort, '%Y-%m') AS cohort_month, count(DISTINCT o_custkey)::BIGINT AS cohort_size, """ + ", ".join(
    f"round(count(DISTINCT CASE WHEN days BETWEEN 1 AND {n} THEN o_custkey END) / count(DISTINCT o_custkey) * 100, 1) AS pct_{n}d" for n in (30, 60, 90, 180)) + " FROM a GROUP BY cohort")
def cohort_retention(spark: SparkSession, d: str) -> DataFrame:
    o = parquet(spark, d, "orders").select("o_custkey", DAY("o_orderdate").alias("day"))
    a = o.groupBy("o_custkey").agg(F.min("day").alias("first_day")).join(o, "o_custkey", "left").select("o_custkey", F.trunc("first_day", "month").alias("cohort"), F.datediff("day", "first_day").alias("days"))
    n = F.count_distinct("o_custkey")
    pct = [F.round(F.count_distinct(F.when(F.col("days").between(1, k), F.col("o_custkey"))) / n * 100, 1).alias(f"pct_{k}d") for k in (30, 60, 90, 180)]
    return a.groupBy("cohort").agg(n.alias("cohort_size"), *pct).select(F.date_format("cohort", "yyyy-MM").alias("cohort_month"), "cohort_size", *(f"pct_{k}d" for k in (30, 60, 90, 180)))


@query("""WITH q AS (SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL),
c AS (SELECT *, qty - lag(qty) OVER (PARTITION BY l_partkey ORDER BY day) AS change FROM q), z AS (SELECT *, (change - avg(change) OVER w) / nullif(stddev_samp(change) OVER w, 0) AS z FROM c WINDOW w AS (PARTITION BY l_partkey))
SELECT l_partkey, day, qty, change, round(z, 4) AS z FROM z WHERE abs(z) > 2 ORDER BY abs(round(z, 4)) DESC, l_partkey, day LIMIT 15""")
def inventory_anomaly(spark: SparkSession, d: str) -> DataFrame:
    q = parquet(spark, d, "lineitem").groupBy("l_partkey", DAY("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("qty"))
    c = q.withColumn("change", F.col("qty") - F.lag("qty").over(Window.partitionBy("l_partkey").orderBy("day")))
    z = A.z_scores(c, ["l_partkey"], "change").filter(F.abs("z") > 2).select("l_partkey", "day", "qty", "change", F.round("z", 4).alias("z"))
    return z.orderBy(F.desc(F.abs("z")), "l_partkey", "day").limit(15)


@query("""WITH s AS (SELECT p_partkey, p_size + 1 AS p_size FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey + 1000000, p_size FROM part WHERE p_partkey % 50 = 0)
SELECT coalesce(p.p_partkey, s.p_partkey) AS p_partkey, p.p_brand, CAST(coalesce(s.p_size, p.p_size) AS INT) AS p_size FROM part p FULL OUTER JOIN s ON p.p_partkey = s.p_partkey""")
def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    t = parquet(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    s = t.filter("p_partkey % 10 = 0").select("p_partkey", (F.col("p_size") + 1).alias("p_size")).unionByName(t.filter("p_partkey % 50 = 0").select((F.col("p_partkey") + 1000000).alias("p_partkey"), "p_size"))
    return H.merge_upsert(t, s, ["p_partkey"], ["p_size"], outer=True)  # beyond 1,000,000 the added keys are those of other parts too


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 2 UNION ALL SELECT o_orderkey + 100000000, 'N' FROM orders WHERE o_orderkey % 7 = 3""")
def cdc_apply(spark: SparkSession, d: str) -> DataFrame:
    t = parquet(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    change = lambda cond, key, status, op, seq: t.filter(cond).select(F.expr(key).alias("o_orderkey"), F.lit(status).alias("o_orderstatus"), F.lit(op).alias("op"), F.lit(seq).alias("seq"))
    c = change("o_orderkey % 7 IN (1, 2)", "o_orderkey", "Y", "U", 1).unionByName(change("o_orderkey % 7 = 1", "o_orderkey", "X", "U", 2)).unionByName(change("o_orderkey % 7 = 2", "o_orderkey", None, "D", 2)).unionByName(change("o_orderkey % 7 = 3", "o_orderkey + 100000000", "N", "I", 3))
    return H.apply_changes(t, c, ["o_orderkey"])


@query("""SELECT c_custkey, c_mktsegment, TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN c_custkey % 5 IN (0, 1) THEN TIMESTAMP '2024-02-01' END AS valid_to FROM customer
UNION ALL SELECT c_custkey, 'MOVED', TIMESTAMP '2024-02-01', NULL FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey + 1000000, c_mktsegment, TIMESTAMP '2024-02-01', NULL FROM customer WHERE c_custkey % 5 = 2""")
def scd2_snapshot(spark: SparkSession, d: str) -> DataFrame:
    c = parquet(spark, d, "customer").select("c_custkey", "c_mktsegment")
    at = lambda x: F.to_timestamp_ntz(F.lit(x))
    first = H.snapshot(None, c, "c_custkey", ["c_mktsegment"], at("2024-01-01 00:00:00")).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    now = c.filter("c_custkey % 5 <> 1").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "MOVED").otherwise(F.col("c_mktsegment"))).unionByName(c.filter("c_custkey % 5 = 2").withColumn("c_custkey", F.col("c_custkey") + 1000000))
    return H.snapshot(first, now, "c_custkey", ["c_mktsegment"], at("2024-02-01 00:00:00")).withColumn("valid_to", F.col("valid_to").cast("timestamp_ntz"))


SESS_SQL = """g AS (SELECT *, date_sub('minute', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR gap > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_number FROM g),
s AS (SELECT md5(CAST(user_id AS VARCHAR) || '-' || CAST(session_number AS VARCHAR)) AS session_id, user_id, min(ts) AS started, max(ts) AS ended, date_sub('minute', min(ts), max(ts)) AS minutes, count(*)::BIGINT AS events,
  count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS purchases, count(*) FILTER (WHERE event_type = 'view') > 0 AND count(*) FILTER (WHERE event_type = 'purchase') = 0 AS is_abandoned, greatest(count(DISTINCT event_type) - 1, 0)::BIGINT AS further_types FROM n GROUP BY user_id, session_number)"""


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    e = A.sessions(parquet(spark, d, "events"), "user_id", "ts", "event_id")
    kind = lambda k: F.count_if(F.col("event_type") == k)
    g = e.groupBy("user_id", "session_number").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"), kind("purchase").alias("purchases"), ((kind("view") > 0) & (kind("purchase") == 0)).alias("is_abandoned"),
        F.greatest(F.count_distinct("event_type") - 1, F.lit(0)).cast("long").alias("further_types"))
    key = F.md5(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("session_number").cast("string"))).alias("session_id")
    return g.select(key, "user_id", "started", "ended", F.expr("timestampdiff(MINUTE, started, ended)").alias("minutes"), "events", "purchases", "is_abandoned", "further_types")


@query(f"WITH {SESS_SQL} SELECT * FROM s")
def sessions_gap(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d)


@query(f"""WITH {SESS_SQL}, t AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY user_id, event_type)
SELECT s.user_id, count(*)::BIGINT AS sessions, sum(events)::BIGINT AS events, round(avg(minutes), 2) AS avg_minutes, round(count(*) FILTER (WHERE purchases > 0) * 100.0 / nullif(count(*), 0), 2) AS conversion_pct, any_value(t.event_type) AS top_type FROM s JOIN t ON s.user_id = t.user_id AND k = 1 GROUP BY s.user_id""")
def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = _sessions(spark, d).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"), F.round(F.avg("minutes"), 2).alias("avg_minutes"), X.ratio_pct(F.count_if(F.col("purchases") > 0), F.count("*")).alias("conversion_pct"))
    return g.join(A.most_frequent(parquet(spark, d, "events"), ["user_id"], "event_type").withColumnRenamed("event_type", "top_type"), "user_id")


METRIC_SQL = """o AS (SELECT o_custkey, o_orderkey, any_value(o_orderstatus) AS st, CAST(any_value(o_orderdate) AS DATE) AS day, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS amount FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey),
om AS (SELECT o_custkey AS customer, count(*)::BIGINT AS orders, count(*) FILTER (WHERE st = 'F')::BIGINT AS delivered, count(*) FILTER (WHERE st = 'P')::BIGINT AS cancelled, CAST(sum(CASE WHEN st = 'F' THEN amount ELSE 0 END) AS DOUBLE) AS delivered_amount,
  CAST(max(CASE WHEN st = 'F' THEN amount END) AS DOUBLE) AS largest, date_diff('day', max(day), DATE '2025-01-01')::INT AS days_since, round(count(*) FILTER (WHERE st = 'F') * 100.0 / nullif(count(*), 0), 2) AS delivered_pct FROM o GROUP BY o_custkey)"""


def _metrics(spark: SparkSession, d: str, as_of: str = "2025-01-01") -> DataFrame:
    li = parquet(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(X.money("l_extendedprice")).alias("amount"))
    o = parquet(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("st"), DAY("o_orderdate").alias("day"), "amount")
    f = F.col("st") == "F"
    return o.groupBy("customer").agg(
        F.count("*").alias("orders"), F.count_if(f).alias("delivered"), F.count_if(F.col("st") == "P").alias("cancelled"), F.sum(F.when(f, F.col("amount")).otherwise(0)).cast("double").alias("delivered_amount"),
        F.max(F.when(f, F.col("amount"))).cast("double").alias("largest"), F.datediff(F.to_date(F.lit(as_of)), F.max("day")).alias("days_since"), X.ratio_pct(F.count_if(f), F.count("*")).alias("delivered_pct"))


@query(f"WITH {METRIC_SQL} SELECT * FROM om")
def order_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d)


SAT_SQL = """sat AS (SELECT user_id, count(*)::BIGINT AS events, round(CAST(sum(CAST(value AS DECIMAL(18,4))) * 10000 AS DOUBLE) / count(value)) / 10000 AS avg_value, CASE WHEN count(*) FILTER (WHERE event_type = 'error') * 1.0 / nullif(count(*), 0) <= 0.15 THEN 'promoter'
  WHEN count(*) FILTER (WHERE event_type = 'error') * 1.0 / nullif(count(*), 0) <= 0.22 THEN 'passive' ELSE 'detractor' END AS bucket FROM events GROUP BY user_id)"""


def _satisfaction(spark: SparkSession, d: str) -> DataFrame:
    share = F.try_divide(F.count_if(F.col("event_type") == "error"), F.count("*"))
    return parquet(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("events"), X.mean(F.sum(X.money("value")), F.count("value"), 4).alias("avg_value"), X.ladder(share, [(0.15, "promoter"), (0.22, "passive")], "detractor").alias("bucket"))


@query(f"WITH {SAT_SQL} SELECT user_id, events, avg_value, bucket FROM sat")
def satisfaction(spark: SparkSession, d: str) -> DataFrame:
    return _satisfaction(spark, d)



COUNTS = ("customer", "orders", "part", "supplier")


@query("SELECT " + ", ".join(f"(SELECT count(*) FROM {t})::BIGINT AS n_{t}" for t in COUNTS) + ", (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) AS last_order")
def scalar_summary(spark: SparkSession, d: str) -> DataFrame:
    said = "SELECT " + ", ".join(f"(SELECT count(*) FROM {{{t}}}) AS n_{t}" for t in COUNTS) + ", (SELECT CAST(max(o_orderdate) AS DATE) FROM {orders}) AS last_order"
    return spark.sql(said, **{t: parquet(spark, d, t) for t in COUNTS})


@query("SELECT t AS table_name, n::BIGINT AS n_rows, n > 0 AS ok, min(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER () = 1 AS gate FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in COUNTS) + ")")
def row_count_gate(spark: SparkSession, d: str) -> DataFrame:
    parts = [parquet(spark, d, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in COUNTS]
    all_of = parts[0]
    for p in parts[1:]:
        all_of = all_of.unionByName(p)
    return all_of.orderBy("table_name").select("table_name", "n_rows", (F.col("n_rows") > 0).alias("ok"), (F.min(F.when(F.col("n_rows") > 0, 1).otherwise(0)).over(Window.partitionBy(F.lit(1))) == 1).alias("gate"))


@query("""SELECT 'orders_unique' AS test, count(*)::BIGINT AS failures FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'lines_unique', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'status_accepted', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'orphan_customers', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'nation_not_null', count(*) FROM nation WHERE n_name IS NULL""")
def dq_not_null_unique_accepted(spark: SparkSession, d: str) -> DataFrame:
    o, c = parquet(spark, d, "orders"), parquet(spark, d, "customer")
    tests = {
        "orders_unique": Q.duplicates(o, "o_orderkey"), "lines_unique": Q.duplicates(parquet(spark, d, "lineitem"), "l_orderkey", "l_linenumber"), "status_accepted": o.filter("o_orderstatus NOT IN ('F', 'O')"),
        "orphan_customers": Q.orphans(o, "o_custkey", c, "c_custkey"), "nation_not_null": parquet(spark, d, "nation").filter("n_name IS NULL")}
    out = None
    for name, failing in tests.items():
        one = failing.agg(F.count("*").alias("failures")).select(F.lit(name).alias("test"), "failures")
        out = one if out is None else out.unionByName(one)
    return out


RULES = [
    Q.Rule("quantity_positive", "VALIDITY", "l_quantity > 0"), Q.Rule("discount_range", "VALIDITY", "l_discount BETWEEN 0 AND 0.05", threshold=0.5), Q.Rule("price_positive", "VALIDITY", "l_extendedprice > 0"),
    Q.Rule("tax_range", "VALIDITY", "l_tax < 0.07"), Q.not_null("l_orderkey"), Q.not_null("l_partkey"), Q.accepted("l_returnflag", "A", "N", "R"), Q.accepted("l_linestatus", "O"), Q.Rule("order_unique", "UNIQUENESS", unique="l_orderkey"), Q.Rule("ship_known", "COMPLETENESS", "l_shipdate IS NOT NULL", severity="warn"),
]


def _rule_sql(r: Q.Rule) -> str:
    passes = r.passes if r.among is None else f"{r.among[0]} IS NULL OR {r.among[0]} IN ({', '.join(map(repr, r.among[1]))})"
    p = f"(SELECT count(*) FILTER (WHERE {r.unique} IS NULL OR k = 1) FROM (SELECT {r.unique}, count(*) OVER (PARTITION BY {r.unique}) AS k FROM lineitem))" if r.unique else f"count(*) FILTER (WHERE {passes})"
    return f"SELECT '{r.name}' AS rule, '{r.dimension}' AS dimension, '{r.severity}' AS severity, count(*)::BIGINT AS evaluated, ({p})::BIGINT AS passed, (count(*) - {p})::BIGINT AS failed, round(({p}) / count(*) * 100, 2) AS pass_pct, ({p}) / count(*) >= {r.threshold} AS ok FROM lineitem"


@query(" UNION ALL ".join(map(_rule_sql, RULES)))
def dq_rule_scan(spark: SparkSession, d: str) -> DataFrame:
    return Q.scan(parquet(spark, d, "lineitem"), RULES)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, json_keys(props)[1] AS first_key FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.json_object_keys("props")[0].alias("first_key"))


@query("SELECT split_part(event_type || ':' || CAST(user_id AS VARCHAR), ':', 1) AS category, CAST(ts AS DATE) AS day, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def split_category(spark: SparkSession, d: str) -> DataFrame:
    e = parquet(spark, d, "events").withColumn("reason", F.concat_ws(":", "event_type", F.col("user_id").cast("string")))
    return e.groupBy(X.category("reason").alias("category"), DAY("ts").alias("day")).agg(F.count("*").alias("n"))


HOUR = "date_trunc('hour', ts)"


@query(f"SELECT {HOUR} AS window_start, {HOUR} + INTERVAL 1 HOUR AS window_end, event_type, count(DISTINCT (user_id, ts))::BIGINT AS order_count FROM events GROUP BY ALL")
def stream_orders_per_minute(spark: SparkSession, d: str) -> DataFrame:
    return E.distinct_count(parquet(spark, d, "events"), "ts", "event_type", ["user_id", "ts"], "1 hour")


@query(f"""WITH o AS (SELECT {HOUR} AS w, user_id, event_type, ts, min(CAST(value AS DECIMAL(18,4))) AS v FROM events GROUP BY ALL) SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, user_id, event_type, CAST(sum(v) AS DOUBLE) AS net FROM o GROUP BY ALL""")
def stream_inventory_velocity(spark: SparkSession, d: str) -> DataFrame:
    e = parquet(spark, d, "events").withColumn("v", X.money("value"))
    out = E.distinct_sum(e, "ts", ["user_id", "event_type"], ["user_id", "event_type", "ts"], "v", "1 hour", "net")
    return out.withColumn("net", F.col("net").cast("double"))


@query(f"""WITH l AS (SELECT {HOUR} AS w, user_id, arg_max(event_type, (ts, event_id)) AS k FROM events GROUP BY ALL) SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*)::BIGINT AS active_delivery_count FROM l WHERE k <> 'purchase' GROUP BY w""")
def stream_active(spark: SparkSession, d: str) -> DataFrame:
    return E.active(parquet(spark, d, "events"), "ts", "user_id", "event_type", "purchase", "1 hour", tie="event_id")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), n AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
p AS (SELECT user_id, s, min(ts) FILTER (WHERE event_type = 'view') AS a, min(ts) FILTER (WHERE event_type = 'purchase') AS z FROM n GROUP BY user_id, s), q AS (SELECT z, epoch(z) - epoch(a) AS sec FROM p WHERE epoch(z) - epoch(a) >= 0)
SELECT date_trunc('hour', z) AS window_start, date_trunc('hour', z) + INTERVAL 1 HOUR AS window_end, round(avg(sec), 3) AS avg_pick_time_seconds, count(*)::BIGINT AS sample_count FROM q GROUP BY ALL""")
def stream_pick_time(spark: SparkSession, d: str) -> DataFrame:
    out = E.mean_times(E.pair_times(parquet(spark, d, "events"), "ts", "user_id", "event_type", "view", "purchase", "6 hours"), "1 hour")
    return out.withColumn("avg_pick_time_seconds", F.round("avg_pick_time_seconds", 3))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'not json' WHEN event_id % 10 = 1 THEN '{"id": 1}' WHEN event_id % 10 = 2 THEN 't' ELSE '' END AS kind FROM events)
SELECT CASE kind WHEN 'not json' THEN 'invalid_json' WHEN '{"id": 1}' THEN 'missing_fields' WHEN 't' THEN 'invalid_timestamp' ELSE 'valid' END AS category, count(*)::BIGINT AS n FROM r GROUP BY ALL""")
def stream_dead_letter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 10
    text = F.when(k == 0, "{not json").when(k == 1, '{"id": 1}').when(k == 2, '{"id": 1, "timestamp": "soon"}').otherwise('{"id": 1, "timestamp": "2024-01-01T00:00:00Z"}')
    c = E.classify(parquet(spark, d, "events").select(text.alias("value")), ["id", "timestamp"], "id long, timestamp string")
    return c.groupBy(F.coalesce(X.category("error_reason"), F.lit("valid")).alias("category")).agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT {HOUR} AS h, event_type, count(*) AS n, avg(user_id) AS a FROM events GROUP BY ALL) SELECT CAST(h AS DATE) AS rollup_date, event_type, sum(n)::BIGINT AS total, max(n)::BIGINT AS most, count(*)::BIGINT AS windows, round(sum(a * n) / sum(n), 6) AS mean FROM w GROUP BY ALL""")
def refire_dedup_rollup(spark: SparkSession, d: str) -> DataFrame:
    w = parquet(spark, d, "events").groupBy(F.window("ts", "1 hour").start.alias("window_start"), "event_type").agg(F.count("*").alias("n"), F.avg("user_id").alias("a"))
    refired = w.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("pipeline_processed_at")).withColumn("n", F.when(F.col("pipeline_processed_at") == 3, F.col("n")).otherwise(F.col("n") - 1))
    last = E.latest_per_window(refired, ["window_start", "event_type"])
    return E.daily(last, ["event_type"], [F.sum("n").alias("total"), F.max("n").alias("most"), F.count("*").alias("windows"), F.round(E.weighted_mean("a", "n"), 6).alias("mean")])


FEATURE_SQL = """d AS (SELECT l_suppkey AS product, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS qty, max(CASE WHEN l_quantity >= 49 THEN 1 ELSE 0 END)::INT AS flag FROM lineitem GROUP BY ALL),
f AS (SELECT *, max(flag) OVER (PARTITION BY product ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS label, max(day) OVER (PARTITION BY product) AS last FROM d)"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    g = parquet(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("product"), DAY("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("qty"), F.max(F.when(F.col("l_quantity") >= 49, 1).otherwise(0)).alias("flag"))
    return A.forward_label(g, "product", "day", "flag")


@query(f"WITH {FEATURE_SQL} SELECT product, day, qty, flag, label FROM f WHERE day <= last - 7")
def features_forward_label(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d)


@query(f"""SELECT count(*)::BIGINT AS rules, count(*) FILTER (WHERE NOT ok AND severity = 'error')::BIGINT AS errors, count(*) FILTER (WHERE NOT ok AND severity = 'warn')::BIGINT AS warnings, count(*) FILTER (WHERE NOT ok AND severity = 'error') = 0 AS passed
  FROM ({" UNION ALL ".join(map(_rule_sql, RULES))})""")
def dq_overall(spark: SparkSession, d: str) -> DataFrame:
    return Q.overall(Q.scan(parquet(spark, d, "lineitem"), RULES))


@query("SELECT count(*)::BIGINT AS n, count(*) BETWEEN 900 AND 1100 AS ok FROM orders WHERE o_orderdate >= TIMESTAMP '2001-03-01'")
def dq_count_gate(spark: SparkSession, d: str) -> DataFrame:
    return Q.count_gate(parquet(spark, d, "orders"), 900, 1100, "o_orderdate", F.to_timestamp_ntz(F.lit("2001-03-01 00:00:00")))


@query("SELECT p_brand, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE i = n // 2 + 1")
def upper_median_price(spark: SparkSession, d: str) -> DataFrame:
    return A.upper_median(parquet(spark, d, "part"), ["p_brand"], "p_retailprice")


@query("SELECT o_orderpriority, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS rate FROM orders GROUP BY ALL")
def finished_rate(spark: SparkSession, d: str) -> DataFrame:
    return A.rate(parquet(spark, d, "orders").withColumn("done", F.col("o_orderstatus") == "F"), ["o_orderpriority"], "done")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 10")
def latest_events(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(10).select("event_id", "ts", "event_type")


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06' GROUP BY ALL")
def events_of_a_day(spark: SparkSession, d: str) -> DataFrame:
    return T.on_day(parquet(spark, d, "events"), "ts", "2024-01-05").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS n, count(*) BETWEEN 1 AND 100000 AS ok FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 48 HOUR")
def recent_events_gate(spark: SparkSession, d: str) -> DataFrame:
    since = F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")) - F.expr("INTERVAL 48 HOURS")
    return Q.count_gate(parquet(spark, d, "events"), 1, 100_000, "ts", since)


@query("SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def one_line_of_an_order(spark: SparkSession, d: str) -> DataFrame:
    li = parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return H.latest_per_key(li, ["l_orderkey"], [F.col("l_linenumber")])


QUERIES |= warehouse.QUERIES
ORACLES |= warehouse.ORACLES
