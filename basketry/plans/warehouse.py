"""The named models over the driver's tables: bronze tables made of them by expressions that Spark and DuckDB share, and for each model its query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions import columns as X
from ..operators import analytics as A
from ..operators import quality as Q
from ..sources.tables import parquet
from . import learning
from . import models as M

AS_OF, CHANGED, FIRST, LAST = "2002-01-01", "1998-06-01", "1995-01-01", "2002-12-31"
LOADED = "TIMESTAMP_NTZ '2002-01-01 00:00:00'"
ORDER_DAY = "CAST(o_orderdate AS DATE)"

#: name -> (driver's table, column -> expression), or a list of such parts.
BRONZE: dict[str, list[tuple[str, dict[str, str]]]] = {
    "customers": [("customer", {
        "customer_id": "c_custkey", "name": "concat(' ', c_name)", "email": "CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN c_name ELSE concat(' ', c_name, '@Mail.COM ') END", "city": "concat('City ', CAST(c_nationkey AS STRING), ' ')",
        "state": "CASE WHEN c_custkey % 100 = 1 THEN NULL ELSE concat('S', CAST(c_nationkey % 7 AS STRING)) END", "signup_date": "DATE '1995-01-01' + CAST(c_custkey % 1000 AS INT)", "segment": "CASE WHEN c_custkey % 20 = 3 THEN NULL ELSE concat(c_mktsegment, ' ') END", "_loaded_at": LOADED,
    })],
    "orders": [("orders", {
        "order_id": "o_orderkey", "customer_id": "CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE o_custkey END", "order_date": ORDER_DAY, "delivery_date": f"{ORDER_DAY} + CAST(o_orderkey % 9 - 1 AS INT)",
        "status": "concat(' ', CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'P' THEN 'Cancelled' ELSE 'Placed' END)", "total_amount": "CAST(o_totalprice AS DECIMAL(18,2))", "_loaded_at": LOADED,
    })],
    "order_items": [("lineitem", {
        "order_item_id": "l_orderkey * 8 + l_linenumber", "order_id": "l_orderkey", "product_id": "l_partkey", "quantity": "CAST(CASE WHEN l_orderkey % 200 = 7 THEN -l_quantity ELSE l_quantity END AS INT)", "unit_price": "CAST(l_extendedprice AS DECIMAL(12,2))",
        "discount": "CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_discount AS DECIMAL(4,2)) END", "_loaded_at": "l_shipdate",
    })],
    "products": [("part", {
        "product_id": "p_partkey", "name": "concat(p_name, ' ')", "category": "CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_brand END", "subcategory": "p_type", "price": "CAST(p_retailprice AS DECIMAL(12,2))", "supplier_id": "p_partkey % 100 + 1",
        "is_active": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size > 5 END", "_loaded_at": LOADED,
    })],
    "suppliers": [("supplier", {
        "supplier_id": "s_suppkey", "name": "concat(' ', s_name)", "region": "CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE concat('R', CAST(s_nationkey AS STRING)) END", "lead_time_days": "CAST(s_suppkey % 20 AS INT)", "is_active": "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal > 0 END",
        "_loaded_at": LOADED,
    })],
    "inventory_snapshots": [("lineitem", {
        "snapshot_id": "l_orderkey * 8 + l_linenumber", "warehouse_id": "concat('W', CAST(l_suppkey % 3 AS STRING))", "product_id": "l_partkey % 100", "snapshot_date": "CAST(l_shipdate AS DATE)", "qty_on_hand": "CAST(l_quantity AS INT)",
        "qty_reserved": "CAST(l_linenumber * 6 - 6 AS INT)", "_loaded_at": "l_shipdate",
    })],
    "product_price_history": [("part", {
        "price_id": f"p_partkey * 3 + {i}", "product_id": "p_partkey", "price": f"CAST(p_retailprice AS DECIMAL(12,2)) + {i}", "effective_date": a, "end_date": b, "change_reason": f"CASE WHEN p_partkey % 5 = {i} THEN NULL ELSE ' promo ' END", "_loaded_at": LOADED,
    }) for i, (a, b) in enumerate([("DATE '1995-01-01'", "DATE '1996-12-31'"), ("DATE '1997-01-01'", "DATE '1999-06-30'"), ("DATE '1999-07-01'", "CAST(NULL AS DATE)")])],
    "customer_profiles": [("customer", {
        "customer_id": "CAST(c_custkey AS STRING)", "full_name": "c_name", "email": "CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN c_name ELSE concat(c_name, '@Mail.com') END", "city": "concat('City ', CAST(c_nationkey AS STRING))",
        "state": "concat('S', CAST(c_nationkey % 7 AS STRING))", "signup_date": "DATE '2001-12-31' - CAST(c_custkey % 900 AS INT)", "preferred_delivery_window": "CASE WHEN c_custkey % 2 = 0 THEN 'am' ELSE 'pm' END", "dietary_preferences": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'none' END",
        "is_active": "c_acctbal > 0", "_loaded_at": LOADED,
    })],
    "order_history": [("lineitem JOIN orders ON l_orderkey = o_orderkey", {
        "order_item_id": "CAST(l_orderkey * 8 + l_linenumber AS STRING)", "order_id": "CAST(l_orderkey AS STRING)", "customer_id": "CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END", "product_id": "CAST(l_partkey AS STRING)",
        "order_date": ORDER_DAY, "delivery_date": f"{ORDER_DAY} + CAST(o_orderkey % 9 - 1 AS INT)", "order_status": "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'cancelled' ELSE 'placed' END", "quantity": "CAST(l_quantity AS INT)",
        "unit_price": "CAST(l_extendedprice AS DECIMAL(12,2))", "discount": "CAST(l_discount AS DECIMAL(4,2))", "delivery_rating": "CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_orderkey % 6 AS INT) END", "_loaded_at": "l_shipdate",
    })],
    "clickstream_events": [("events", {
        "event_id": "CAST(event_id AS STRING)", "customer_id": "CASE WHEN event_id % 20 = 0 THEN NULL ELSE CAST(user_id AS STRING) END", "session_id": "CAST(user_id % 7 AS STRING)",
        "event_type": "CASE event_type WHEN 'view' THEN 'product_view' WHEN 'click' THEN 'page_view' WHEN 'signup' THEN 'add_to_cart' WHEN 'error' THEN 'search' ELSE event_type END", "product_id": "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id % 50 AS STRING) END",
        "page_url": "concat('/p/', CAST(event_id % 50 AS STRING))", "search_query": "CASE WHEN event_type = 'error' THEN 'q' END", "event_timestamp": "ts", "device_type": "CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END", "_loaded_at": LOADED,
    })],
    "delivery_feedback": [("orders", {
        "feedback_id": "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END", "order_id": "CAST(o_orderkey AS STRING)", "customer_id": "CAST(o_custkey AS STRING)", "delivery_date": f"{ORDER_DAY} + CAST(3 AS INT)", "driver_rating": "CAST(o_orderkey % 6 AS INT)",
        "delivery_rating": "CAST(o_orderkey % 5 + 1 AS INT)", "comment": "CASE WHEN o_orderkey % 11 < 3 THEN NULL ELSE o_orderpriority END", "issue_type": "CASE o_orderkey % 5 WHEN 0 THEN 'late' WHEN 1 THEN 'damaged' WHEN 2 THEN 'none' WHEN 3 THEN 'wrong_items' ELSE 'missing_items' END",
        "would_recommend": "o_orderkey % 4 > 0", "_loaded_at": LOADED,
    })],
}


def bronze(spark: SparkSession, d: str, name: str) -> DataFrame:
    out = None
    for source, columns in BRONZE[name]:
        if " JOIN " in source:
            df = parquet(spark, d, "lineitem").join(parquet(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        else:
            df = parquet(spark, d, source)
        part = df.selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))
        out = part if out is None else out.unionByName(part)
    return out


def _bronze_sql(name: str) -> str:
    return " UNION ALL ".join(f"SELECT {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {source}" for source, cols in BRONZE[name]).replace("TIMESTAMP_NTZ ", "TIMESTAMP ")


def _latest_sql(name: str, key: str, select: str, also: str = "") -> str:
    others = ", ".join(f"{c} ASC NULLS FIRST" for c in BRONZE[name][0][1] if c not in (key, "_loaded_at"))
    return f"SELECT {select}, _loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY _loaded_at DESC, {others}) AS row_num FROM bronze_{name}) WHERE row_num = 1 AND {key} IS NOT NULL{also}"


def _key_sql(*cols: str) -> str:
    return "md5(" + " || '-' || ".join(f"coalesce(CAST({c} AS VARCHAR), '{X.NULL_KEY}')" for c in cols) + ")"


def _mean(total: str, n: str) -> str:
    return f"round(CAST({total} * 100 AS DOUBLE) / nullif({n}, 0)) / 100"


def _cast(kind: str, *cols: str) -> str:
    return ", ".join(f"CAST({c} AS {kind}) AS {c}" for c in cols)


LINE = "CAST(quantity AS DECIMAL(10,0)) * CAST(unit_price AS DECIMAL(12,4)) * (1 - CAST({} AS DECIMAL(6,4)))"
#: SQL of the models, in an order in which each only names what stands before it.
SQL: dict[str, str] = {f"bronze_{n}": _bronze_sql(n) for n in BRONZE} | {
    "stg_customers": _latest_sql("customers", "customer_id", f"""CAST(customer_id AS VARCHAR) AS customer_id, trim(name) AS customer_name, lower(trim(email)) AS email, trim(city) AS city, trim(state) AS state, CAST(signup_date AS DATE) AS signup_date,
        coalesce(trim(segment), 'unknown') AS segment, email LIKE '%@%.%' AS is_valid_email, signup_date <= DATE '{AS_OF}' AS is_valid_signup_date, customer_id IS NOT NULL AS has_customer_id"""),
    "stg_orders": _latest_sql("orders", "order_id", """CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id, CAST(order_date AS DATE) AS order_date, CAST(delivery_date AS DATE) AS delivery_date, lower(trim(status)) AS status,
        CAST(total_amount AS DECIMAL(18,4)) AS total_amount, CAST(date_diff('day', order_date, delivery_date) AS INT) AS delivery_days, order_id IS NOT NULL AS has_order_id, customer_id IS NOT NULL AS has_customer_id, total_amount > 0 AS is_positive_amount, delivery_date >= order_date AS is_valid_delivery_date"""),
    "stg_order_items": _latest_sql("order_items", "order_item_id", f"""{_cast('VARCHAR', 'order_item_id', 'order_id', 'product_id')}, CAST(quantity AS INT) AS quantity, CAST(unit_price AS DECIMAL(18,4)) AS unit_price, coalesce(CAST(discount AS DECIMAL(18,4)), 0) AS discount,
        {LINE.format('coalesce(discount, 0)')} AS line_total, order_item_id IS NOT NULL AS has_order_item_id, quantity > 0 AS is_positive_quantity, unit_price > 0 AS is_positive_price, discount >= 0 AND discount <= 1 AS is_valid_discount"""),
    "stg_products": _latest_sql("products", "product_id", """CAST(product_id AS VARCHAR) AS product_id, CAST(supplier_id AS VARCHAR) AS supplier_id, trim(name) AS product_name, coalesce(trim(category), 'uncategorized') AS category, coalesce(trim(subcategory), 'uncategorized') AS subcategory,
        CAST(price AS DECIMAL(18,4)) AS price, coalesce(is_active, false) AS is_active, product_id IS NOT NULL AS has_product_id, price > 0 AS is_positive_price"""),
    "stg_suppliers": _latest_sql("suppliers", "supplier_id", """CAST(supplier_id AS VARCHAR) AS supplier_id, trim(name) AS supplier_name, coalesce(trim(region), 'unknown') AS region, CAST(lead_time_days AS INT) AS lead_time_days, coalesce(is_active, false) AS is_active,
        supplier_id IS NOT NULL AS has_supplier_id, lead_time_days > 0 AS is_positive_lead_time"""),
    "stg_inventory_snapshots": _latest_sql("inventory_snapshots", "snapshot_id", f"""{_cast('VARCHAR', 'snapshot_id', 'warehouse_id', 'product_id')}, CAST(snapshot_date AS DATE) AS snapshot_date, {_cast('INT', 'qty_on_hand', 'qty_reserved')}, CAST(qty_on_hand - qty_reserved AS INT) AS qty_available,
        snapshot_id IS NOT NULL AS has_snapshot_id, qty_on_hand >= 0 AS is_non_negative_qty, qty_reserved >= 0 AS is_non_negative_reserved, qty_reserved <= qty_on_hand AS is_valid_reservation"""),
    "stg_product_price_history": _latest_sql("product_price_history", "price_id", f"""{_cast('VARCHAR', 'price_id', 'product_id')}, CAST(price AS DECIMAL(18,4)) AS price, coalesce(trim(change_reason), 'unknown') AS change_reason, CAST(effective_date AS DATE) AS valid_from,
        CAST(coalesce(end_date, DATE '{X.FOREVER}') AS DATE) AS valid_to, end_date IS NULL AS is_current, price_id IS NOT NULL AS has_price_id, product_id IS NOT NULL AS has_product_id, price > 0 AS is_positive_price, effective_date IS NOT NULL AS has_valid_from""", " AND product_id IS NOT NULL"),
    "stg_customer_profiles": _latest_sql("customer_profiles", "customer_id", f"""customer_id, full_name, lower(trim(email)) AS email, city, state, CAST(signup_date AS DATE) AS signup_date, preferred_delivery_window, dietary_preferences, CAST(is_active AS BOOLEAN) AS is_active,
        email IS NOT NULL AND lower(trim(email)) LIKE '%@%.%' AS is_valid_email, signup_date <= DATE '{AS_OF}' AS is_valid_signup_date"""),
    "stg_order_history": _latest_sql("order_history", "order_item_id", f"""order_item_id, order_id, customer_id, product_id, order_date, delivery_date, order_status, quantity, {_cast('DECIMAL(18,4)', 'unit_price', 'discount')}, delivery_rating,
        CAST(date_diff('day', order_date, delivery_date) AS INT) AS delivery_days, round({LINE.format('discount')}, 2) AS line_total, delivery_date >= order_date AS is_valid_delivery_date, quantity > 0 AS is_positive_quantity, unit_price > 0 AS is_positive_price""", " AND customer_id IS NOT NULL"),
    "stg_clickstream_events": _latest_sql("clickstream_events", "event_id", f"""event_id, customer_id, session_id, event_type, product_id, page_url, search_query, event_timestamp, device_type, CAST(event_timestamp AS DATE) AS event_date, CAST(hour(event_timestamp) AS INT) AS event_hour,
        customer_id IS NOT NULL AS is_known_customer, event_type IN {M.EVENT_TYPES} AS is_valid_event_type"""),
    "stg_delivery_feedback": _latest_sql("delivery_feedback", "feedback_id", """feedback_id, order_id, customer_id, delivery_date, driver_rating, delivery_rating, comment, issue_type, would_recommend, (driver_rating + delivery_rating) / 2.0 AS overall_rating, comment IS NOT NULL AS has_comment, issue_type <> 'none' AS has_issue,
        driver_rating BETWEEN 1 AND 5 AS is_valid_driver_rating, delivery_rating BETWEEN 1 AND 5 AS is_valid_delivery_rating""", " AND customer_id IS NOT NULL"),
    "dim_dates": f"""SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_id, CAST(d AS DATE) AS date, CAST(dayofweek(d) + 1 AS INT) AS day_of_week_number, strftime(d, '%A') AS day_of_week_name, CAST(day(d) AS INT) AS day_of_month, CAST(weekofyear(d) AS INT) AS week_of_year,
        CAST(date_trunc('week', d) AS DATE) AS week_start_date, CAST(month(d) AS INT) AS month_number, strftime(d, '%B') AS month_name, strftime(d, '%b') AS month_short_name, CAST(date_trunc('month', d) AS DATE) AS month_start_date, CAST(quarter(d) AS INT) AS calendar_quarter,
        CAST(date_trunc('quarter', d) AS DATE) AS quarter_start_date, CAST(year(d) AS INT) AS calendar_year, dayofweek(d) IN (0, 6) AS is_weekend, dayofweek(d) NOT IN (0, 6) AS is_weekday, CAST(CASE WHEN month(d) >= 2 THEN year(d) ELSE year(d) - 1 END AS INT) AS fiscal_year,
        CAST((month(d) + 10) % 12 // 3 + 1 AS INT) AS fiscal_quarter FROM (SELECT unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS d)""",
    "dim_suppliers": "SELECT supplier_id, supplier_name, region, lead_time_days, is_active, CASE WHEN lead_time_days <= 3 THEN 'fast' WHEN lead_time_days <= 7 THEN 'standard' WHEN lead_time_days <= 14 THEN 'slow' ELSE 'very_slow' END AS lead_time_tier, _loaded_at FROM stg_suppliers",
    "dim_products": f"""SELECT {_key_sql('p.product_id', 'h.valid_from')} AS product_surrogate_key, p.product_id, product_name, category, subcategory, supplier_id, is_active, h.price, change_reason AS price_change_reason, valid_from, valid_to, is_current, p._loaded_at
        FROM stg_products p JOIN stg_product_price_history h ON p.product_id = h.product_id""",
    "snap_customers": f"""SELECT * REPLACE (segment AS segment), DATE '{FIRST}' AS valid_from, CASE WHEN CAST(customer_id AS BIGINT) % 5 = 0 OR CAST(customer_id AS BIGINT) % 13 = 1 THEN DATE '{CHANGED}' END AS valid_to FROM stg_customers
        UNION ALL SELECT * REPLACE ('MOVED' AS segment), DATE '{CHANGED}', NULL FROM stg_customers WHERE CAST(customer_id AS BIGINT) % 5 = 0 AND CAST(customer_id AS BIGINT) % 13 <> 1""",
    "dim_customers": f"""SELECT {_key_sql('customer_id', 'valid_from')} AS customer_surrogate_key, customer_id, customer_name, email, city, state, signup_date, segment, is_valid_email, is_valid_signup_date, valid_from, coalesce(valid_to, DATE '{X.FOREVER}') AS valid_to, valid_to IS NULL AS is_current FROM snap_customers""",
    "fact_orders": f"""SELECT {_key_sql('oi.order_item_id')} AS order_item_surrogate_key, oi.order_item_id, oi.order_id, c.customer_surrogate_key, p.product_surrogate_key, d.date_id AS order_date_id, oi.product_id, o.customer_id, o.order_date, o.delivery_date, o.status AS order_status, o.delivery_days, oi.quantity,
        oi.unit_price, oi.discount, oi.line_total, p.price AS current_price, oi.unit_price AS price_at_purchase, round(p.price - oi.unit_price, 2) AS price_variance, oi._loaded_at FROM stg_order_items oi JOIN stg_orders o ON oi.order_id = o.order_id
        JOIN dim_customers c ON o.customer_id = c.customer_id AND o.order_date >= c.valid_from AND o.order_date < c.valid_to JOIN dim_products p ON oi.product_id = p.product_id AND o.order_date BETWEEN p.valid_from AND p.valid_to JOIN dim_dates d ON o.order_date = d.date""",
    "fact_daily_inventory": f"""SELECT {_key_sql('i.snapshot_id')} AS inventory_surrogate_key, i.snapshot_id, p.product_surrogate_key, d.date_id AS snapshot_date_id, i.product_id, i.warehouse_id, i.snapshot_date, p.product_name, p.category, p.subcategory, i.qty_on_hand, i.qty_reserved, i.qty_available,
        CASE WHEN i.qty_available <= 0 THEN 'out_of_stock' WHEN i.qty_available <= 10 THEN 'critical' WHEN i.qty_available <= 50 THEN 'low' ELSE 'adequate' END AS stock_status, round(i.qty_reserved / nullif(i.qty_on_hand, 0) * 100, 2) AS reservation_rate_pct, i._loaded_at
        FROM stg_inventory_snapshots i JOIN dim_products p ON i.product_id = p.product_id AND p.is_current JOIN dim_dates d ON i.snapshot_date = d.date""",
    "_events": "SELECT *, date_sub('minute', lag(event_timestamp) OVER w, event_timestamp) AS gap, lag(event_timestamp) OVER w AS before FROM stg_clickstream_events WHERE customer_id IS NOT NULL WINDOW w AS (PARTITION BY customer_id ORDER BY event_timestamp, event_id)",
    "_numbered": "SELECT *, md5(customer_id || '-' || CAST(sum(CASE WHEN before IS NULL OR gap > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY event_timestamp, event_id ROWS UNBOUNDED PRECEDING) AS VARCHAR)) AS true_session_id FROM _events",
    "_devices": "SELECT true_session_id, device_type, row_number() OVER (PARTITION BY true_session_id ORDER BY count(*) DESC, device_type) AS k FROM _numbered WHERE device_type IS NOT NULL GROUP BY true_session_id, device_type",
    "int_clickstream_sessions": """SELECT n.true_session_id, n.customer_id, min(event_timestamp) AS session_start_time, max(event_timestamp) AS session_end_time, count(*) AS total_events, count(*) FILTER (WHERE event_type = 'page_view') AS page_views, count(*) FILTER (WHERE event_type = 'product_view') AS product_views,
        count(*) FILTER (WHERE event_type = 'add_to_cart') AS add_to_cart_count, count(*) FILTER (WHERE event_type = 'search') AS search_count, count(*) FILTER (WHERE event_type = 'purchase') AS purchase_count, greatest(count(DISTINCT product_id) - 1, 0)::BIGINT AS unique_products_viewed,
        date_sub('minute', min(event_timestamp), max(event_timestamp)) AS session_duration_mins, count(*) FILTER (WHERE event_type = 'purchase') > 0 AS did_purchase,
        count(*) FILTER (WHERE event_type = 'add_to_cart') > 0 AND count(*) FILTER (WHERE event_type = 'purchase') = 0 AS cart_abandoned, any_value(v.device_type) AS device_type FROM _numbered n LEFT JOIN _devices v ON n.true_session_id = v.true_session_id AND k = 1 GROUP BY n.true_session_id, n.customer_id""",
    "_order_level": "SELECT order_id, customer_id, order_date, order_status, sum(line_total) AS order_total FROM stg_order_history GROUP BY ALL",
    "int_customer_order_metrics": f"""SELECT customer_id, count(DISTINCT order_id) AS total_orders, count(*) FILTER (WHERE order_status = 'delivered') AS delivered_orders, count(*) FILTER (WHERE order_status = 'cancelled') AS cancelled_orders,
        round(sum(CASE WHEN order_status = 'delivered' THEN order_total ELSE 0 END), 2) AS total_spend, {_mean("sum(order_total) FILTER (WHERE order_status = 'delivered')", "count(*) FILTER (WHERE order_status = 'delivered')")} AS avg_order_value,
        round(max(order_total) FILTER (WHERE order_status = 'delivered'), 2) AS max_order_value, min(order_date) AS first_order_date, max(order_date) AS last_order_date, CAST(date_diff('day', max(order_date), DATE '{AS_OF}') AS INT) AS days_since_last_order,
        round(count(*) FILTER (WHERE order_status = 'cancelled') / nullif(count(DISTINCT order_id), 0) * 100, 1) AS cancellation_rate_pct FROM _order_level GROUP BY customer_id""",
    "int_customer_satisfaction": f"""SELECT customer_id, count(*) AS total_feedback_count, count(*) FILTER (WHERE has_issue) AS total_issues_reported, count(*) FILTER (WHERE would_recommend) AS would_recommend_count, {_mean('sum(overall_rating)', 'count(overall_rating)')} AS avg_overall_rating,
        {_mean('sum(driver_rating)', 'count(driver_rating)')} AS avg_driver_rating, {_mean('sum(delivery_rating)', 'count(delivery_rating)')} AS avg_delivery_rating, min(overall_rating) AS min_overall_rating,
        round(count(*) FILTER (WHERE would_recommend) / count(*) * 100, 1) AS recommendation_rate_pct, count(*) FILTER (WHERE issue_type = 'late') AS late_delivery_count, count(*) FILTER (WHERE issue_type = 'damaged') AS damaged_count, count(*) FILTER (WHERE issue_type = 'wrong_items') AS wrong_items_count,
        count(*) FILTER (WHERE issue_type = 'missing_items') AS missing_items_count, CASE WHEN count(*) FILTER (WHERE would_recommend) / count(*) >= 0.8 THEN 'promoter' WHEN count(*) FILTER (WHERE would_recommend) / count(*) >= 0.6 THEN 'passive' ELSE 'detractor' END AS nps_bucket,
        false AS has_no_feedback FROM stg_delivery_feedback GROUP BY customer_id""",
    "_device_top": "SELECT customer_id, device_type, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, device_type) AS k FROM int_clickstream_sessions WHERE device_type IS NOT NULL GROUP BY customer_id, device_type",
    "_session_metrics": """SELECT customer_id, count(*) AS total_sessions, round(avg(session_duration_mins), 1) AS avg_session_duration_mins, round(avg(total_events), 1) AS avg_events_per_session, round(avg(page_views), 1) AS avg_page_views_per_session, round(avg(product_views), 1) AS avg_product_views_per_session,
        CAST(sum(add_to_cart_count) AS BIGINT) AS total_add_to_cart, count(*) FILTER (WHERE did_purchase) AS sessions_with_purchase, count(*) FILTER (WHERE cart_abandoned) AS sessions_with_abandonment, round(count(*) FILTER (WHERE cart_abandoned) / count(*) * 100, 1) AS cart_abandonment_rate_pct
        FROM int_clickstream_sessions GROUP BY customer_id""",
    "_rfm": """SELECT customer_id, CAST(ntile(5) OVER (ORDER BY days_since_last_order, customer_id) AS INT) AS r, CAST(ntile(5) OVER (ORDER BY total_orders, customer_id) AS INT) AS f, CAST(ntile(5) OVER (ORDER BY total_spend, customer_id) AS INT) AS m FROM int_customer_order_metrics""",
    "customer_360": f"""SELECT c.customer_id, full_name, email, city, state, signup_date, preferred_delivery_window, dietary_preferences, is_active, is_valid_email, CAST(date_diff('day', signup_date, DATE '{AS_OF}') AS INT) AS days_since_signup,
        CASE WHEN date_diff('day', signup_date, DATE '{AS_OF}') <= 90 THEN 'new' WHEN date_diff('day', signup_date, DATE '{AS_OF}') <= 365 THEN 'established' ELSE 'veteran' END AS customer_cohort, coalesce(total_orders, 0) AS total_orders, coalesce(delivered_orders, 0) AS delivered_orders,
        coalesce(cancelled_orders, 0) AS cancelled_orders, coalesce(total_spend, 0) AS total_spend, avg_order_value, max_order_value, first_order_date, last_order_date, days_since_last_order, coalesce(cancellation_rate_pct, 0) AS cancellation_rate_pct, r AS recency_score, f AS frequency_score, m AS monetary_score,
        CAST(r AS VARCHAR) || CAST(f AS VARCHAR) || CAST(m AS VARCHAR) AS rfm_score, CASE WHEN r IS NOT NULL THEN {M.SEGMENTS_360} END AS rfm_segment, coalesce(total_sessions, 0) AS total_sessions, avg_session_duration_mins, avg_events_per_session, avg_page_views_per_session, avg_product_views_per_session,
        coalesce(total_add_to_cart, 0) AS total_add_to_cart, coalesce(sessions_with_purchase, 0) AS sessions_with_purchase, coalesce(sessions_with_abandonment, 0) AS sessions_with_abandonment, cart_abandonment_rate_pct, v.device_type AS preferred_device, total_feedback_count, avg_overall_rating,
        avg_driver_rating, avg_delivery_rating, recommendation_rate_pct, nps_bucket, total_issues_reported, t.customer_id IS NULL AS has_no_feedback FROM stg_customer_profiles c LEFT JOIN int_customer_order_metrics o ON c.customer_id = o.customer_id LEFT JOIN _rfm x ON c.customer_id = x.customer_id
        LEFT JOIN _session_metrics s ON c.customer_id = s.customer_id LEFT JOIN _device_top v ON c.customer_id = v.customer_id AND v.k = 1 LEFT JOIN int_customer_satisfaction t ON c.customer_id = t.customer_id""",
    "customer_360_summary": f"SELECT count(*) AS total_customers, count(*) FILTER (WHERE rfm_segment = 'champion') AS champions, count(*) FILTER (WHERE rfm_segment = 'at_risk') AS at_risk, count(*) FILTER (WHERE has_no_feedback) AS no_feedback, {_mean('sum(total_spend)', 'count(*)')} AS avg_spend FROM customer_360",
    "_spent": "SELECT customer_id, max(order_date) AS last_order_date, count(DISTINCT order_id) AS order_count, sum(line_total) AS total_spend FROM fact_orders GROUP BY customer_id",
    "_scored": f"SELECT *, CAST(r AS VARCHAR) || CAST(f AS VARCHAR) || CAST(m AS VARCHAR) AS rfm_score, {M.SEGMENTS_QUERY} AS segment FROM (SELECT *, ntile(5) OVER (ORDER BY last_order_date DESC, customer_id) AS r, ntile(5) OVER (ORDER BY order_count, customer_id) AS f, ntile(5) OVER (ORDER BY total_spend, customer_id) AS m FROM _spent)",
    "rfm_segmentation": f"SELECT segment, count(*) AS customer_count, {_mean('sum(round(total_spend, 2))', 'count(*)')} AS avg_spend, round(avg(order_count), 1) AS avg_orders, min(rfm_score) AS min_rfm, max(rfm_score) AS max_rfm FROM _scored GROUP BY segment ORDER BY avg_spend DESC, segment",
    "_daily": "SELECT p.category, f.order_date, d.month_name, sum(f.line_total) AS daily_revenue FROM fact_orders f JOIN dim_products p ON f.product_surrogate_key = p.product_surrogate_key JOIN dim_dates d ON f.order_date = d.date GROUP BY ALL",
    "rolling_category_revenue": f"""SELECT category, order_date, month_name, round(daily_revenue, 2) AS daily_revenue, {_mean('sum(daily_revenue) OVER w', 'count(*) OVER w')} AS revenue_7d_rolling_avg, round(sum(daily_revenue) OVER w, 2) AS revenue_7d_rolling_sum FROM _daily
        WINDOW w AS (PARTITION BY category ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "rolling_one_category": "SELECT * FROM rolling_category_revenue WHERE category = 'Brand#11' ORDER BY order_date LIMIT 15",
    "_activity": "SELECT c.customer_id, CAST(date_trunc('month', signup_date) AS DATE) AS cohort, date_diff('day', signup_date, f.order_date) AS days FROM dim_customers c LEFT JOIN fact_orders f ON c.customer_id = f.customer_id WHERE c.is_current",
    "cohort_by_signup": "SELECT strftime(cohort, '%Y-%m') AS cohort_month, count(DISTINCT customer_id) AS cohort_size, count(DISTINCT CASE WHEN days BETWEEN 0 AND 30 THEN customer_id END) AS retained_30d, " + ", ".join(
        f"round(count(DISTINCT CASE WHEN days BETWEEN 0 AND {n} THEN customer_id END) / count(DISTINCT customer_id) * 100, 1) AS retention_{n}d_pct" for n in (30, 60, 90, 180)) + " FROM _activity GROUP BY cohort ORDER BY cohort LIMIT 12",
    "_changes": "SELECT *, lag(qty_on_hand) OVER (PARTITION BY product_id, warehouse_id ORDER BY snapshot_date, snapshot_id) AS prev_qty_on_hand, qty_on_hand - lag(qty_on_hand) OVER (PARTITION BY product_id, warehouse_id ORDER BY snapshot_date, snapshot_id) AS qty_change FROM fact_daily_inventory",
    "_z": "SELECT *, round((qty_change - avg(qty_change) OVER w) / nullif(stddev_samp(qty_change) OVER w, 0), 2) AS z_score FROM _changes WHERE qty_change IS NOT NULL WINDOW w AS (PARTITION BY product_id, warehouse_id)",
    "inventory_anomalies": "SELECT product_id, product_name, category, warehouse_id, snapshot_date, prev_qty_on_hand, qty_on_hand, qty_change, z_score FROM _z WHERE abs(z_score) > 2 ORDER BY abs(z_score) DESC, product_id, warehouse_id, snapshot_date, snapshot_id LIMIT 15",
    "_late": """SELECT snapshot_id, product_id, warehouse_id, snapshot_date, CAST(qty_on_hand + CASE WHEN CAST(snapshot_id AS BIGINT) % 10 = 0 THEN 5 ELSE 0 END AS INT) AS qty_on_hand, qty_reserved FROM stg_inventory_snapshots WHERE CAST(snapshot_id AS BIGINT) % 4 = 0
        UNION ALL SELECT concat('late', snapshot_id), product_id, warehouse_id, snapshot_date, qty_on_hand, qty_reserved FROM stg_inventory_snapshots WHERE CAST(snapshot_id AS BIGINT) % 50 = 1""",
    "merge_late_inventory": """SELECT t.inventory_surrogate_key, coalesce(t.snapshot_id, s.snapshot_id) AS snapshot_id, coalesce(t.product_id, s.product_id) AS product_id, coalesce(t.warehouse_id, s.warehouse_id) AS warehouse_id, t.stock_status, coalesce(s.qty_on_hand, t.qty_on_hand) AS qty_on_hand,
        coalesce(s.qty_reserved, t.qty_reserved) AS qty_reserved, CASE WHEN s.snapshot_id IS NULL THEN t.qty_available ELSE s.qty_on_hand - s.qty_reserved END AS qty_available FROM fact_daily_inventory t FULL OUTER JOIN _late s ON t.snapshot_id = s.snapshot_id""",
    "_stock": f"SELECT CAST(l_suppkey AS VARCHAR) AS product_id, CAST(l_shipdate AS DATE) AS date, 'W1' AS warehouse_id, CAST(sum(l_quantity) AS INT) AS qty_on_hand, max(CASE WHEN l_quantity >= 49 THEN 1 ELSE 0 END) AS stockout_flag FROM lineitem GROUP BY ALL",
    "_ahead": """SELECT *, round(avg(qty_on_hand) OVER (PARTITION BY product_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolling_7d_avg_demand, max(stockout_flag) OVER (PARTITION BY product_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS stockout_next_7d,
        max(date) OVER (PARTITION BY product_id) AS last FROM _stock""",
    "stockout_risk_features": "SELECT a.product_id, a.date, a.warehouse_id, a.qty_on_hand, a.rolling_7d_avg_demand, s.lead_time_days, a.stockout_next_7d, s.region AS category, CAST(s.lead_time_days * 10 + 1 AS DOUBLE) AS price FROM _ahead a JOIN stg_suppliers s ON a.product_id = s.supplier_id WHERE a.date <= a.last - 7",
    "ml_split": "SELECT date < DATE '2000-07-01' AS early, stockout_next_7d, count(*) AS n FROM stockout_risk_features WHERE stockout_next_7d IS NOT NULL GROUP BY ALL",
    "_w": "SELECT date_trunc('hour', ts) AS window_start, CAST(user_id % 4 AS VARCHAR) AS zone, event_type, count(*) AS n, avg(value) AS a FROM events GROUP BY ALL",
    "orders_daily": "SELECT CAST(window_start AS DATE) AS rollup_date, zone AS warehouse_zone, CAST(sum(n) AS BIGINT) AS total_orders FROM (SELECT window_start, zone, sum(n) AS n FROM _w GROUP BY ALL) GROUP BY ALL",
    "inventory_velocity_daily": "SELECT CAST(window_start AS DATE) AS rollup_date, zone AS warehouse_id, event_type AS product_id, CAST(sum(n) AS BIGINT) AS net_quantity_change FROM _w GROUP BY ALL",
    "active_deliveries_daily": "SELECT CAST(window_start AS DATE) AS rollup_date, round(avg(n), 6) AS avg_active_deliveries, CAST(max(n) AS BIGINT) AS max_active_deliveries, count(*) AS windows_observed FROM (SELECT window_start, sum(n) AS n FROM _w GROUP BY ALL) GROUP BY ALL",
    "avg_pick_time_daily": "SELECT CAST(window_start AS DATE) AS rollup_date, round(sum(a * n) / sum(n), 6) AS avg_pick_time_seconds, CAST(sum(n) AS BIGINT) AS total_samples FROM (SELECT date_trunc('hour', ts) AS window_start, count(*) - 1 AS n, round(avg(value), 4) AS a FROM events GROUP BY ALL) WHERE n > 0 GROUP BY ALL",
    "malformed_events_daily": "SELECT CAST(ts AS DATE) AS rollup_date, 'sub' || CAST(user_id % 3 AS VARCHAR) AS source_subscription, event_type AS error_category, count(*) AS event_count FROM events GROUP BY ALL",
    "rollup_summary": """SELECT CAST(coalesce((SELECT sum(total_orders) FROM orders_daily WHERE rollup_date = DATE '2024-01-05'), 0) AS BIGINT) AS total_orders, (SELECT round(avg_active_deliveries, 2) FROM active_deliveries_daily WHERE rollup_date = DATE '2024-01-05') AS avg_active_deliveries,
        (SELECT round(avg_pick_time_seconds, 2) FROM avg_pick_time_daily WHERE rollup_date = DATE '2024-01-05') AS avg_pick_time_seconds, CAST(coalesce((SELECT sum(event_count) FROM malformed_events_daily WHERE rollup_date = DATE '2024-01-05'), 0) AS BIGINT) AS malformed_events""",
}
#: Columns that are decimals in either engine, and double in what is compared.
DECIMALS = {
    "stg_orders": ["total_amount"], "stg_order_items": ["unit_price", "discount", "line_total"], "stg_products": ["price"], "stg_product_price_history": ["price"], "stg_order_history": ["unit_price", "discount", "line_total"], "stg_delivery_feedback": ["overall_rating"],
    "dim_products": ["price"], "fact_orders": ["unit_price", "discount", "line_total", "current_price", "price_at_purchase", "price_variance"], "int_customer_order_metrics": ["total_spend", "max_order_value"], "int_customer_satisfaction": ["min_overall_rating"],
    "customer_360": ["total_spend", "max_order_value"], "rolling_category_revenue": ["daily_revenue", "revenue_7d_rolling_sum"], "rolling_one_category": ["daily_revenue", "revenue_7d_rolling_sum"],
}
HIDDEN = tuple(f"bronze_{n}" for n in BRONZE)


def oracle(name: str) -> str:
    last = "".join(f", CAST({c} AS DOUBLE) AS {c}" for c in DECIMALS.get(name, ()))
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in SQL.items()) + f" SELECT * {'REPLACE (' + last[2:] + ')' if last else ''} FROM {name}"


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles."""
    return df.select(*(F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name) for f in df.schema))


class Warehouse:
    """The models over one folder of driver's tables, each made of the ones it needs."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d, self.as_of = spark, d, F.to_date(F.lit(AS_OF))

    def stg(self, name: str) -> DataFrame:
        make = getattr(M, f"stg_{name}")
        b = bronze(self.spark, self.d, name)
        return make(b, self.as_of) if name in ("customers", "customer_profiles") else make(b)

    def dim_dates(self) -> DataFrame:
        return M.dim_dates(self.spark, FIRST, LAST)

    def dim_products(self) -> DataFrame:
        return M.dim_products(self.stg("products"), self.stg("product_price_history"))

    def snap_customers(self) -> DataFrame:
        """Two runs of the snapshot: the first one's versions start on FIRST; by CHANGED some customers have moved and some are gone."""
        at = lambda x: F.to_date(F.lit(x))
        c, k = self.stg("customers"), F.col("customer_id").cast("long")
        first = M.snap_customers(None, c, at(CHANGED), at(FIRST)).withColumn("valid_to", F.lit(None).cast("date"))
        now = c.filter(k % 13 != 1).withColumn("segment", F.when(k % 5 == 0, "MOVED").otherwise(F.col("segment")))
        out = M.snap_customers(first, now, at(CHANGED))
        return out.withColumns({"valid_from": F.col("valid_from").cast("date"), "valid_to": F.col("valid_to").cast("date")})

    def dim_customers(self) -> DataFrame:
        return M.dim_customers(self.snap_customers())

    def fact_orders(self) -> DataFrame:
        return M.fact_orders(self.stg("order_items"), self.stg("orders"), self.dim_customers(), self.dim_products(), self.dim_dates())

    def fact_daily_inventory(self) -> DataFrame:
        return M.fact_daily_inventory(self.stg("inventory_snapshots"), self.dim_products(), self.dim_dates())

    def sessions(self) -> DataFrame:
        return M.int_clickstream_sessions(self.stg("clickstream_events"))

    def order_metrics(self) -> DataFrame:
        return M.int_customer_order_metrics(self.stg("order_history"), self.as_of)

    def satisfaction(self) -> DataFrame:
        return M.int_customer_satisfaction(self.stg("delivery_feedback"))

    def customer_360(self) -> DataFrame:
        return M.customer_360(self.stg("customer_profiles"), self.order_metrics(), self.sessions(), self.satisfaction(), self.as_of)

    def late(self) -> DataFrame:
        s, k = self.stg("inventory_snapshots").select("snapshot_id", "product_id", "warehouse_id", "snapshot_date", "qty_on_hand", "qty_reserved"), F.col("snapshot_id").cast("long")
        more = F.when(k % 10 == 0, 5).otherwise(0)
        return s.filter(k % 4 == 0).withColumn("qty_on_hand", F.col("qty_on_hand") + more).unionByName(s.filter(k % 50 == 1).withColumn("snapshot_id", F.concat(F.lit("late"), F.col("snapshot_id"))))

    def merged(self) -> DataFrame:
        out = M.merge_late_inventory(self.fact_daily_inventory(), self.late())
        return out.select("inventory_surrogate_key", "snapshot_id", "product_id", "warehouse_id", "stock_status", "qty_on_hand", "qty_reserved", "qty_available")

    def features(self) -> DataFrame:
        li = parquet(self.spark, self.d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("product_id"), F.to_date("l_shipdate").alias("date"))
        stock = li.agg(F.lit("W1").alias("warehouse_id"), F.sum("l_quantity").cast("int").alias("qty_on_hand"), F.max(F.when(F.col("l_quantity") >= 49, 1).otherwise(0)).alias("stockout_flag"))
        stock = A.rolling(stock, ["product_id"], "date", "qty_on_hand", digits=4).withColumnRenamed("rolling_avg", "rolling_7d_avg_demand")
        s = self.stg("suppliers").select(F.col("supplier_id").alias("product_id"), "lead_time_days", F.col("region").alias("category"), (F.col("lead_time_days") * 10 + 1).cast("double").alias("price"))
        return M.stockout_risk_features(stock.join(s.select("product_id", "lead_time_days"), "product_id"), s)

    def windows(self, *by, refired: bool = True) -> DataFrame:
        """Counts by hour, each window fired three times, only the last time with the right number."""
        e = parquet(self.spark, self.d, "events").withColumns({"zone": (F.col("user_id") % 4).cast("string")})
        w = e.groupBy(F.window("ts", "1 hour").start.alias("window_start"), *by).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("a"))
        fired = w.withColumn("pipeline_processed_at", F.explode(F.sequence(F.lit(1), F.lit(3))))
        return fired.withColumn("n", F.when(F.col("pipeline_processed_at") == 3, F.col("n")).otherwise(F.col("n") + 100))

    def orders_daily(self) -> DataFrame:
        return M.orders_daily(self.windows("zone").withColumnsRenamed({"zone": "warehouse_zone", "n": "order_count"}))

    def active_deliveries_daily(self) -> DataFrame:
        return M.active_deliveries_daily(self.windows().withColumnRenamed("n", "active_delivery_count")).withColumn("avg_active_deliveries", F.round("avg_active_deliveries", 6))

    def avg_pick_time_daily(self) -> DataFrame:
        w = self.windows().withColumnsRenamed({"a": "avg_pick_time_seconds", "n": "sample_count"}).withColumn("sample_count", F.col("sample_count") - 1)
        return M.avg_pick_time_daily(w).withColumn("avg_pick_time_seconds", F.round("avg_pick_time_seconds", 6))

    def malformed_events_daily(self) -> DataFrame:
        e = parquet(self.spark, self.d, "events").select(F.col("ts").alias("processing_time"), F.concat(F.lit("sub"), (F.col("user_id") % 3).cast("string")).alias("source_subscription"), F.concat_ws(": ", "event_type", "props").alias("error_reason"))
        return M.malformed_events_daily(e)

    def model(self) -> DataFrame:
        """The regression over the five features, trained before a day and evaluated from it on: its figures, and whether it may be promoted."""
        f = self.features().filter("stockout_next_7d IS NOT NULL").cache()
        early = F.col("date") < F.to_date(F.lit("2000-07-01"))
        model = learning.train(f.filter(early), ["qty_on_hand", "rolling_7d_avg_demand", "lead_time_days", "price"], ["category"], "stockout_next_7d")
        m = learning.evaluate(model.transform(f.filter(~early)), "stockout_next_7d")
        f.unpersist()
        return self.spark.createDataFrame([(m["roc_auc"], m["accuracy"], m["f1"], learning.passes(m))], "roc_auc double, accuracy double, f1 double, promoted boolean")


def _queries() -> dict:
    by = {f"stg_{n}": lambda w, n=n: w.stg(n) for n in BRONZE} | {n: getattr(Warehouse, n) for n in ("dim_dates", "dim_products", "snap_customers", "dim_customers", "fact_orders", "fact_daily_inventory", "customer_360", "orders_daily", "active_deliveries_daily", "avg_pick_time_daily", "malformed_events_daily")}
    by |= {
        "dim_suppliers": lambda w: M.dim_suppliers(w.stg("suppliers")), "int_clickstream_sessions": Warehouse.sessions, "int_customer_order_metrics": Warehouse.order_metrics, "int_customer_satisfaction": Warehouse.satisfaction,
        "customer_360_summary": lambda w: M.customer_360_summary(w.customer_360()), "rfm_segmentation": lambda w: M.rfm_segmentation(w.fact_orders()), "merge_late_inventory": Warehouse.merged, "stockout_risk_features": Warehouse.features,
        "rolling_category_revenue": lambda w: M.rolling_category_revenue(w.fact_orders(), w.dim_products(), w.dim_dates()), "rolling_one_category": lambda w: M.rolling_category_revenue(w.fact_orders(), w.dim_products(), w.dim_dates(), "Brand#11", 15),
        "cohort_by_signup": lambda w: M.cohort_retention(w.dim_customers(), w.fact_orders()), "inventory_anomalies": lambda w: M.inventory_anomalies(w.fact_daily_inventory()),
        "inventory_velocity_daily": lambda w: M.inventory_velocity_daily(w.windows("zone", "event_type").withColumnsRenamed({"zone": "warehouse_id", "event_type": "product_id", "n": "net_quantity_change"})),
        "rollup_summary": lambda w: M.rollup_summary(w.orders_daily(), w.active_deliveries_daily(), w.avg_pick_time_daily(), w.malformed_events_daily(), F.to_date(F.lit("2024-01-05"))),
        "ml_split": lambda w: w.features().filter("stockout_next_7d IS NOT NULL").groupBy((F.col("date") < F.to_date(F.lit("2000-07-01"))).alias("early"), "stockout_next_7d").agg(F.count("*").alias("n")), "ml_logreg_gate": Warehouse.model,
    }
    return {n: (lambda spark, d, f=f: plain(f(Warehouse(spark, d)))) for n, f in by.items()}


QUERIES = _queries()
ORACLES = {n: oracle(n) for n in QUERIES if n in SQL}
