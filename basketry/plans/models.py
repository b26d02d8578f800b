"""The warehouse's named models, each a function from its inputs to its rows. Clocks are arguments (as_of), and every choice among rows has a unique order.

Flags keep three-valued logic: a flag over a null is null, except where a model says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import analytics as A
from ..operators import history as H
from ..sources.tables import dates

META = ("_loaded_at", "_source_file")


def _stage(bronze: DataFrame, key: str, columns: dict[str, Column], also: tuple[str, ...] = ()) -> DataFrame:
    """The row of each key that was loaded last; of rows loaded together the smallest in the order of their columns."""
    order = [F.desc("_loaded_at"), *(F.asc_nulls_first(c) for c in bronze.columns if c not in (key, "_loaded_at"))]
    rows = H.latest_per_key(bronze, [key], order).filter(" AND ".join(f"{c} IS NOT NULL" for c in (key, *also)))
    return rows.select(*(c.alias(n) for n, c in columns.items()), *(F.col(m) for m in META if m in bronze.columns))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _int(c: str) -> Column:
    return F.col(c).cast("int")


def _day(c: str) -> Column:
    return F.col(c).cast("date")


def _total(discount: Column) -> Column:
    return F.col("quantity").cast("decimal(10,0)") * X.money("unit_price") * (F.lit(1).cast("decimal(9,4)") - discount.cast("decimal(9,4)"))


# staging


def stg_customers(bronze: DataFrame, as_of: Column) -> DataFrame:
    return _stage(bronze, "customer_id", {
        "customer_id": _text("customer_id"), "customer_name": F.trim("name"), "email": F.lower(F.trim("email")), "city": F.trim("city"), "state": F.trim("state"), "signup_date": _day("signup_date"),
        "segment": F.coalesce(F.trim("segment"), F.lit("unknown")), "is_valid_email": F.col("email").like("%@%.%"), "is_valid_signup_date": F.col("signup_date") <= as_of, "has_customer_id": F.col("customer_id").isNotNull(),
    })


def stg_orders(bronze: DataFrame) -> DataFrame:
    return _stage(bronze, "order_id", {
        "order_id": _text("order_id"), "customer_id": _text("customer_id"), "order_date": _day("order_date"), "delivery_date": _day("delivery_date"), "status": F.lower(F.trim("status")), "total_amount": X.money("total_amount"),
        "delivery_days": F.datediff("delivery_date", "order_date"), "has_order_id": F.col("order_id").isNotNull(), "has_customer_id": F.col("customer_id").isNotNull(), "is_positive_amount": F.col("total_amount") > 0,
        "is_valid_delivery_date": F.col("delivery_date") >= F.col("order_date"),
    })


def stg_order_items(bronze: DataFrame) -> DataFrame:
    """line_total is not rounded here; stg_order_history rounds it."""
    zero = F.coalesce(X.money("discount"), F.lit(0))
    return _stage(bronze, "order_item_id", {
        "order_item_id": _text("order_item_id"), "order_id": _text("order_id"), "product_id": _text("product_id"), "quantity": _int("quantity"), "unit_price": X.money("unit_price"), "discount": zero, "line_total": _total(zero),
        "has_order_item_id": F.col("order_item_id").isNotNull(), "is_positive_quantity": F.col("quantity") > 0, "is_positive_price": F.col("unit_price") > 0, "is_valid_discount": (F.col("discount") >= 0) & (F.col("discount") <= 1),
    })


def stg_products(bronze: DataFrame) -> DataFrame:
    named = lambda c: F.coalesce(F.trim(c), F.lit("uncategorized"))
    return _stage(bronze, "product_id", {
        "product_id": _text("product_id"), "supplier_id": _text("supplier_id"), "product_name": F.trim("name"), "category": named("category"), "subcategory": named("subcategory"), "price": X.money("price"),
        "is_active": F.coalesce("is_active", F.lit(False)), "has_product_id": F.col("product_id").isNotNull(), "is_positive_price": F.col("price") > 0,
    })


def stg_suppliers(bronze: DataFrame) -> DataFrame:
    return _stage(bronze, "supplier_id", {
        "supplier_id": _text("supplier_id"), "supplier_name": F.trim("name"), "region": F.coalesce(F.trim("region"), F.lit("unknown")), "lead_time_days": _int("lead_time_days"), "is_active": F.coalesce("is_active", F.lit(False)),
        "has_supplier_id": F.col("supplier_id").isNotNull(), "is_positive_lead_time": F.col("lead_time_days") > 0,
    })


def stg_inventory_snapshots(bronze: DataFrame) -> DataFrame:
    hand, held = _int("qty_on_hand"), _int("qty_reserved")
    return _stage(bronze, "snapshot_id", {
        "snapshot_id": _text("snapshot_id"), "warehouse_id": _text("warehouse_id"), "product_id": _text("product_id"), "snapshot_date": _day("snapshot_date"), "qty_on_hand": hand, "qty_reserved": held, "qty_available": hand - held,
        "has_snapshot_id": F.col("snapshot_id").isNotNull(), "is_non_negative_qty": hand >= 0, "is_non_negative_reserved": held >= 0, "is_valid_reservation": held <= hand,
    })


def stg_product_price_history(bronze: DataFrame) -> DataFrame:
    return _stage(bronze, "price_id", {
        "price_id": _text("price_id"), "product_id": _text("product_id"), "price": X.money("price"), "change_reason": F.coalesce(F.trim("change_reason"), F.lit("unknown")), "valid_from": _day("effective_date"),
        "valid_to": F.coalesce(_day("end_date"), F.to_date(F.lit(X.FOREVER))), "is_current": F.col("end_date").isNull(), "has_price_id": F.col("price_id").isNotNull(), "has_product_id": F.col("product_id").isNotNull(),
        "is_positive_price": F.col("price") > 0, "has_valid_from": F.col("effective_date").isNotNull(),
    }, also=("product_id",))


def stg_customer_profiles(bronze: DataFrame, as_of: Column) -> DataFrame:
    """A null e-mail is not valid here."""
    email = F.lower(F.trim("email"))
    return _stage(bronze, "customer_id", {
        **{c: _text(c) for c in ("customer_id", "full_name")}, "email": email, **{c: _text(c) for c in ("city", "state")}, "signup_date": _day("signup_date"), **{c: _text(c) for c in ("preferred_delivery_window", "dietary_preferences")},
        "is_active": F.col("is_active").cast("boolean"), "is_valid_email": F.col("email").isNotNull() & email.like("%@%.%"), "is_valid_signup_date": F.col("signup_date") <= as_of,
    })


def stg_order_history(bronze: DataFrame) -> DataFrame:
    return _stage(bronze, "order_item_id", {
        **{c: _text(c) for c in ("order_item_id", "order_id", "customer_id", "product_id")}, "order_date": _day("order_date"), "delivery_date": _day("delivery_date"), "order_status": _text("order_status"), "quantity": _int("quantity"),
        "unit_price": X.money("unit_price"), "discount": X.money("discount"), "delivery_rating": _int("delivery_rating"), "delivery_days": F.datediff("delivery_date", "order_date"), "line_total": F.round(_total(F.col("discount")), 2),
        "is_valid_delivery_date": F.col("delivery_date") >= F.col("order_date"), "is_positive_quantity": F.col("quantity") > 0, "is_positive_price": F.col("unit_price") > 0,
    }, also=("customer_id",))


#: Kinds of click-stream events; fixed values of the source.
EVENT_TYPES = ("page_view", "product_view", "add_to_cart", "search", "purchase", "remove_from_cart")


def stg_clickstream_events(bronze: DataFrame) -> DataFrame:
    return _stage(bronze, "event_id", {
        **{c: _text(c) for c in ("event_id", "customer_id", "session_id", "event_type", "product_id", "page_url", "search_query")}, "event_timestamp": F.col("event_timestamp"), "device_type": _text("device_type"),
        "event_date": F.to_date("event_timestamp"), "event_hour": F.hour("event_timestamp"), "is_known_customer": F.col("customer_id").isNotNull(), "is_valid_event_type": F.col("event_type").isin(*EVENT_TYPES),
    })


def stg_delivery_feedback(bronze: DataFrame) -> DataFrame:
    rating = lambda c: F.col(c).between(1, 5)
    return _stage(bronze, "feedback_id", {
        **{c: _text(c) for c in ("feedback_id", "order_id", "customer_id")}, "delivery_date": _day("delivery_date"), "driver_rating": _int("driver_rating"), "delivery_rating": _int("delivery_rating"), "comment": _text("comment"),
        "issue_type": _text("issue_type"), "would_recommend": F.col("would_recommend").cast("boolean"),
        "overall_rating": F.round((F.col("driver_rating").cast("decimal(9,1)") + F.col("delivery_rating").cast("decimal(9,1)")) / F.lit(2).cast("decimal(1,0)"), 1), "has_comment": F.col("comment").isNotNull(),
        "has_issue": F.col("issue_type") != "none", "is_valid_driver_rating": rating("driver_rating"), "is_valid_delivery_rating": rating("delivery_rating"),
    }, also=("customer_id",))


# dimensions


def dim_dates(spark: SparkSession, first: str = "2024-01-01", last: str = "2027-12-31") -> DataFrame:
    c, shown = F.col("date"), lambda p: F.date_format("date", p)
    return dates(spark, first, last).select(
        shown("yyyyMMdd").cast("int").alias("date_id"), c, F.dayofweek(c).alias("day_of_week_number"), shown("EEEE").alias("day_of_week_name"), F.day(c).alias("day_of_month"), F.weekofyear(c).alias("week_of_year"),
        F.trunc(c, "week").alias("week_start_date"), F.month(c).alias("month_number"), shown("MMMM").alias("month_name"), shown("MMM").alias("month_short_name"), F.trunc(c, "month").alias("month_start_date"),
        F.quarter(c).alias("calendar_quarter"), F.trunc(c, "quarter").alias("quarter_start_date"), F.year(c).alias("calendar_year"), F.dayofweek(c).isin(1, 7).alias("is_weekend"), (~F.dayofweek(c).isin(1, 7)).alias("is_weekday"),
        X.fiscal_year(c).alias("fiscal_year"), X.fiscal_quarter(c).alias("fiscal_quarter"),
    )


#: Days of lead time up to which a supplier has a tier, and the tier beyond; fixed values of the model.
LEAD_TIERS, SLOWEST = [(3, "fast"), (7, "standard"), (14, "slow")], "very_slow"


def dim_suppliers(suppliers: DataFrame) -> DataFrame:
    tier = X.ladder(F.col("lead_time_days"), LEAD_TIERS, SLOWEST).alias("lead_time_tier")
    return suppliers.select("supplier_id", "supplier_name", "region", "lead_time_days", "is_active", tier, "_loaded_at")


def dim_products(products: DataFrame, prices: DataFrame) -> DataFrame:
    """One row for each price period of a product."""
    p = products.select("product_id", "product_name", "category", "subcategory", "supplier_id", "is_active", "_loaded_at")
    h = prices.select("product_id", "price", F.col("change_reason").alias("price_change_reason"), "valid_from", "valid_to", "is_current")
    return p.join(h, "product_id").select(
        X.surrogate_key("product_id", "valid_from").alias("product_surrogate_key"), "product_id", "product_name", "category", "subcategory", "supplier_id", "is_active", "price", "price_change_reason", "valid_from", "valid_to", "is_current", "_loaded_at"
    )


#: Columns whose change opens a new version of a customer; fixed values of the model.
TRACKED = ["segment", "city", "state"]


def snap_customers(history: DataFrame | None, customers: DataFrame, as_of: Column, initial: Column | None = None) -> DataFrame:
    return H.snapshot(history, customers, "customer_id", TRACKED, as_of, initial)


def dim_customers(snapshot: DataFrame) -> DataFrame:
    """One row for each version of a customer, from a snapshot with valid_from and valid_to."""
    s = snapshot.withColumns({"is_current": F.col("valid_to").isNull(), "valid_from": _day("valid_from"), "valid_to": F.coalesce(_day("valid_to"), F.to_date(F.lit(X.FOREVER)))})
    return s.select(
        X.surrogate_key("customer_id", "valid_from").alias("customer_surrogate_key"), "customer_id", "customer_name", "email", "city", "state", "signup_date", "segment", "is_valid_email", "is_valid_signup_date", "valid_from", "valid_to", "is_current"
    )


# facts


def fact_orders(items: DataFrame, orders: DataFrame, customers: DataFrame, products: DataFrame, calendar: DataFrame, half_open: bool = True) -> DataFrame:
    """Order items with the customer's version and the price of the order's day. current_price is the price on that day.

    half_open: a customer's version ends before its last day, on which the next one starts; the price periods never share a day.
    """
    o = orders.select("order_id", "customer_id", "order_date", "delivery_date", F.col("status").alias("order_status"), "delivery_days")
    f = items.select("order_item_id", "order_id", "product_id", "quantity", "unit_price", "discount", "line_total", "_loaded_at").join(o, "order_id")
    f = H.as_of_join(f, customers.select("customer_id", "customer_surrogate_key", "valid_from", "valid_to"), "customer_id", "order_date", half_open).drop("valid_from", "valid_to")
    f = H.as_of_join(f, products.select("product_id", "product_surrogate_key", F.col("price").alias("current_price"), "valid_from", "valid_to"), "product_id", "order_date").drop("valid_from", "valid_to")
    f = f.join(F.broadcast(calendar.select(F.col("date").alias("order_date"), F.col("date_id").alias("order_date_id"))), "order_date")  # a row for each day
    return f.select(
        X.surrogate_key("order_item_id").alias("order_item_surrogate_key"), "order_item_id", "order_id", "customer_surrogate_key", "product_surrogate_key", "order_date_id", "product_id", "customer_id", "order_date", "delivery_date", "order_status",
        "delivery_days", "quantity", "unit_price", "discount", "line_total", "current_price", F.col("unit_price").alias("price_at_purchase"), F.round(F.col("current_price") - F.col("unit_price"), 2).alias("price_variance"), "_loaded_at",
    )


#: Available pieces up to which stock has a status, and the status beyond; fixed values of the model.
STOCK, ENOUGH = [(0, "out_of_stock"), (10, "critical"), (50, "low")], "adequate"


def fact_daily_inventory(inventory: DataFrame, products: DataFrame, calendar: DataFrame) -> DataFrame:
    """Snapshots of products that have a current version."""
    p = products.filter("is_current").select("product_id", "product_surrogate_key", "product_name", "category", "subcategory")
    f = inventory.join(p, "product_id").join(F.broadcast(calendar.select(F.col("date").alias("snapshot_date"), F.col("date_id").alias("snapshot_date_id"))), "snapshot_date")
    return f.select(
        X.surrogate_key("snapshot_id").alias("inventory_surrogate_key"), "snapshot_id", "product_surrogate_key", "snapshot_date_id", "product_id", "warehouse_id", "snapshot_date", "product_name", "category", "subcategory", "qty_on_hand",
        "qty_reserved", "qty_available", X.ladder(F.col("qty_available"), STOCK, ENOUGH).alias("stock_status"), F.round(F.try_divide(F.col("qty_reserved"), F.col("qty_on_hand")) * 100, 2).alias("reservation_rate_pct"), "_loaded_at",
    )


# customer 360


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole) * 100, 1)


def _is(c: str, value: str) -> Column:
    return F.count_if(F.col(c) == value)


def int_clickstream_sessions(events: DataFrame) -> DataFrame:
    """Sessions of known customers. unique_products_viewed is one less than the distinct products, 0 at least, as the model has it."""
    e = A.sessions(events.filter("customer_id IS NOT NULL"), "customer_id", "event_timestamp", "event_id")
    by = ["true_session_id", "customer_id"]
    e = e.withColumn("true_session_id", F.md5(F.concat_ws("-", "customer_id", F.col("session_number").cast("string"))))
    s = e.groupBy(*by).agg(
        F.min("event_timestamp").alias("session_start_time"), F.max("event_timestamp").alias("session_end_time"), F.count("*").alias("total_events"), _is("event_type", "page_view").alias("page_views"),
        _is("event_type", "product_view").alias("product_views"), _is("event_type", "add_to_cart").alias("add_to_cart_count"), _is("event_type", "search").alias("search_count"), _is("event_type", "purchase").alias("purchase_count"),
        F.greatest(F.count_distinct("product_id") - 1, F.lit(0)).alias("unique_products_viewed"),
    )
    s = s.withColumns({
        "session_duration_mins": F.expr("timestampdiff(MINUTE, session_start_time, session_end_time)"), "did_purchase": F.col("purchase_count") > 0, "cart_abandoned": (F.col("add_to_cart_count") > 0) & (F.col("purchase_count") == 0),
    })
    return s.join(A.most_frequent(e, by, "device_type"), by, "left")


def int_customer_order_metrics(items: DataFrame, as_of: Column) -> DataFrame:
    """Orders first, then customers, so that an order counts once."""
    order = items.groupBy("order_id", "customer_id", "order_date", "order_status").agg(F.sum("line_total").alias("order_total"))
    done = F.when(F.col("order_status") == "delivered", F.col("order_total"))
    orders, lost = F.count_distinct("order_id"), _is("order_status", "cancelled")
    return order.groupBy("customer_id").agg(
        orders.alias("total_orders"), _is("order_status", "delivered").alias("delivered_orders"), lost.alias("cancelled_orders"), F.round(F.sum(F.coalesce(done, F.lit(0))), 2).alias("total_spend"),
        X.mean(F.sum(done), F.count(done)).alias("avg_order_value"), F.round(F.max(done), 2).alias("max_order_value"), F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"),
        F.datediff(as_of, F.max("order_date")).alias("days_since_last_order"), _share(lost, orders).alias("cancellation_rate_pct"),
    )


def int_customer_satisfaction(feedback: DataFrame) -> DataFrame:
    n, would = F.count("*"), F.count_if(F.col("would_recommend"))
    mean = lambda c: X.mean(F.sum(c), F.count(c)).alias(f"avg_{c}")
    rate = F.try_divide(would, n)
    return feedback.groupBy("customer_id").agg(
        n.alias("total_feedback_count"), F.count_if(F.col("has_issue")).alias("total_issues_reported"), would.alias("would_recommend_count"), mean("overall_rating"), mean("driver_rating"), mean("delivery_rating"),
        F.min("overall_rating").alias("min_overall_rating"), _share(would, n).alias("recommendation_rate_pct"), _is("issue_type", "late").alias("late_delivery_count"), _is("issue_type", "damaged").alias("damaged_count"),
        _is("issue_type", "wrong_items").alias("wrong_items_count"), _is("issue_type", "missing_items").alias("missing_items_count"),
        F.when(rate >= 0.8, "promoter").when(rate >= 0.6, "passive").otherwise("detractor").alias("nps_bucket"), F.lit(False).alias("has_no_feedback"),
    )


#: Segments of scores r, f and m; fixed values, one ladder for each of the two places that have one.
SEGMENTS_QUERY = """CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'champions' WHEN r >= 3 AND f >= 3 THEN 'loyal' WHEN r >= 4 AND f <= 2 THEN 'new_customer' WHEN r <= 2 AND f >= 3 THEN 'at_risk' WHEN r = 1 AND f = 1 THEN 'lost' ELSE 'potential' END"""
SEGMENTS_360 = """CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'champion' WHEN r >= 3 AND f >= 3 THEN 'loyal' WHEN r >= 4 AND f <= 2 THEN 'new_customer' WHEN r <= 2 AND f >= 3 THEN 'at_risk' WHEN r <= 2 AND f <= 2 THEN 'lost' ELSE 'potential' END"""


def rfm(metrics: DataFrame, key: str, recency: tuple[str, bool], frequency: str, monetary: str, ladder: str, recency_best_high: bool = False) -> DataFrame:
    """Adds r, f, m, rfm_score and segment. recency: a column, and whether it ascends. The newest customers get 1, as the published SQL has it, unless recency_best_high."""
    scored = A.quantile_scores(metrics, {"r": [recency, (key, True)], "f": [(frequency, True), (key, True)], "m": [(monetary, True), (key, True)]})
    if recency_best_high:
        scored = scored.withColumn("r", 6 - F.col("r"))
    return scored.withColumns({"rfm_score": F.concat(*(F.col(c).cast("string") for c in "rfm")), "segment": F.expr(ladder)})


def customer_360(customers: DataFrame, orders: DataFrame, sessions: DataFrame, satisfaction: DataFrame, as_of: Column) -> DataFrame:
    """One row for each customer, whatever is known of them. Inputs: stg_customer_profiles and the three int_ models."""
    mean = lambda c, n: F.round(F.avg(c), 1).alias(n)
    left = F.count_if(F.col("cart_abandoned"))
    s = sessions.groupBy("customer_id").agg(
        F.count("*").alias("total_sessions"), mean("session_duration_mins", "avg_session_duration_mins"), mean("total_events", "avg_events_per_session"), mean("page_views", "avg_page_views_per_session"),
        mean("product_views", "avg_product_views_per_session"), F.sum("add_to_cart_count").alias("total_add_to_cart"), F.count_if(F.col("did_purchase")).alias("sessions_with_purchase"), left.alias("sessions_with_abandonment"),
        _share(left, F.count("*")).alias("cart_abandonment_rate_pct"),
    )
    s = s.join(A.most_frequent(sessions, ["customer_id"], "device_type").withColumnRenamed("device_type", "preferred_device"), "customer_id", "left")
    r = rfm(orders, "customer_id", ("days_since_last_order", True), "total_orders", "total_spend", SEGMENTS_360)
    r = r.select("customer_id", F.col("r").alias("recency_score"), F.col("f").alias("frequency_score"), F.col("m").alias("monetary_score"), "rfm_score", F.col("segment").alias("rfm_segment"))
    known = satisfaction.select(
        "customer_id", "total_feedback_count", "avg_overall_rating", "avg_driver_rating", "avg_delivery_rating", "recommendation_rate_pct", "nps_bucket", "total_issues_reported", F.lit(True).alias("_known")
    )
    days = F.datediff(as_of, "signup_date")
    c = customers.select(
        "customer_id", "full_name", "email", "city", "state", "signup_date", "preferred_delivery_window", "dietary_preferences", "is_active", "is_valid_email", days.alias("days_since_signup"),
        X.ladder(days, [(90, "new"), (365, "established")], "veteran").alias("customer_cohort"),
    )
    for other in (orders, r, s, known):
        c = c.join(other, "customer_id", "left")
    zero = ("total_orders", "delivered_orders", "cancelled_orders", "total_spend", "cancellation_rate_pct", "total_sessions", "total_add_to_cart", "sessions_with_purchase", "sessions_with_abandonment")
    return c.withColumns({n: F.coalesce(n, F.lit(0)) for n in zero} | {"has_no_feedback": F.col("_known").isNull()}).drop("_known")


def customer_360_summary(c: DataFrame) -> DataFrame:
    """The run's summary, one row."""
    return c.agg(
        F.count("*").alias("total_customers"), _is("rfm_segment", "champion").alias("champions"), _is("rfm_segment", "at_risk").alias("at_risk"), F.count_if(F.col("has_no_feedback")).alias("no_feedback"),
        X.mean(F.sum("total_spend"), F.count("total_spend")).alias("avg_spend"),
    )


# analytic queries


def rfm_segmentation(facts: DataFrame) -> DataFrame:
    """Segments by mean spending, the largest first."""
    g = facts.groupBy("customer_id").agg(F.max("order_date").alias("last_order_date"), F.count_distinct("order_id").alias("order_count"), F.sum("line_total").alias("total_spend"))
    s = rfm(g, "customer_id", ("last_order_date", False), "order_count", "total_spend", SEGMENTS_QUERY)
    out = s.groupBy("segment").agg(
        F.count("*").alias("customer_count"), X.mean(F.sum(F.round("total_spend", 2)), F.count("*")).alias("avg_spend"), F.round(F.avg("order_count"), 1).alias("avg_orders"), F.min("rfm_score").alias("min_rfm"), F.max("rfm_score").alias("max_rfm")
    )
    return out.orderBy(F.desc("avg_spend"), "segment")


def rolling_category_revenue(facts: DataFrame, products: DataFrame, calendar: DataFrame, category: str | None = None, most: int | None = None) -> DataFrame:
    """Daily revenue of a category with its mean and sum over seven rows, in order of the day; all categories without one."""
    p = products.select("product_surrogate_key", "category")
    p = p.filter(F.col("category") == category) if category is not None else p
    d = F.broadcast(calendar.select(F.col("date").alias("order_date"), "month_name"))
    g = facts.join(p, "product_surrogate_key").join(d, "order_date").groupBy("category", "order_date", "month_name").agg(F.sum("line_total").alias("daily_revenue"))
    w = Window.partitionBy("category").orderBy("order_date").rowsBetween(-6, 0)
    total = F.sum("daily_revenue").over(w)
    out = g.select(
        "category", "order_date", "month_name", F.round("daily_revenue", 2).alias("daily_revenue"), X.mean(total, F.count("*").over(w)).alias("revenue_7d_rolling_avg"), F.round(total, 2).alias("revenue_7d_rolling_sum")
    ).orderBy("category", "order_date")
    return out.limit(most) if most is not None else out


def cohort_retention(customers: DataFrame, facts: DataFrame, most: int | None = 12) -> DataFrame:
    """Months of sign-up with the share of customers that ordered within so many days; customers without orders count too."""
    c = customers.filter("is_current").select("customer_id", "signup_date", F.trunc("signup_date", "month").alias("cohort"))
    a = c.join(facts.select("customer_id", "order_date"), "customer_id", "left").withColumn("days", F.datediff("order_date", "signup_date"))
    size = F.count_distinct("customer_id")
    within = {n: F.count_distinct(F.when(F.col("days").between(0, n), F.col("customer_id"))) for n in (30, 60, 90, 180)}
    out = a.groupBy("cohort").agg(size.alias("cohort_size"), within[30].alias("retained_30d"), *(F.round(k / size * 100, 1).alias(f"retention_{n}d_pct") for n, k in within.items())).orderBy("cohort")
    out = out.limit(most) if most is not None else out
    return out.select(F.date_format("cohort", "yyyy-MM").alias("cohort_month"), *(x for x in out.columns if x != "cohort"))


def inventory_anomalies(facts: DataFrame, bar: float = 2.0, most: int = 15) -> DataFrame:
    """The changes of stock that lie furthest from their product's and warehouse's mean."""
    by = ["product_id", "warehouse_id"]
    before = F.lag("qty_on_hand").over(Window.partitionBy(*by).orderBy("snapshot_date", "snapshot_id"))
    c = facts.withColumn("prev_qty_on_hand", before).withColumn("qty_change", F.col("qty_on_hand") - F.col("prev_qty_on_hand")).filter("qty_change IS NOT NULL")
    z = A.z_scores(c, by, "qty_change").filter("sd > 0").withColumn("z_score", F.round("z", 2)).filter(F.abs("z_score") > bar)
    z = z.orderBy(F.desc(F.abs("z_score")), "product_id", "warehouse_id", "snapshot_date", "snapshot_id").limit(most)
    return z.select("product_id", "product_name", "category", "warehouse_id", "snapshot_date", "prev_qty_on_hand", "qty_on_hand", "qty_change", "z_score")


def merge_late_inventory(facts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """fact_daily_inventory after late snapshots: quantities that differ are replaced, unknown snapshots added without keys and status."""
    s = snapshots.select("snapshot_id", "product_id", "warehouse_id", "snapshot_date", "qty_on_hand", "qty_reserved", (F.col("qty_on_hand") - F.col("qty_reserved")).alias("qty_available"))
    return H.merge_upsert(facts, s, ["snapshot_id"], ["qty_on_hand", "qty_reserved"], follow=["qty_available"])


def stockout_risk_features(inventory: DataFrame, products: DataFrame, days: int = 7) -> DataFrame:
    """Features of a product's day, with whether it runs out within the next days; days without that many ahead of them are left out."""
    f = A.forward_label(inventory, "product_id", "date", "stockout_flag", days, "stockout_next_7d")
    f = f.select("product_id", "date", "warehouse_id", "qty_on_hand", "rolling_7d_avg_demand", "lead_time_days", "stockout_next_7d")
    return f.join(products.select("product_id", "category", "price"), "product_id")


# daily roll-ups of streamed windows, all over the last result of each window


def orders_daily(windows: DataFrame) -> DataFrame:
    last = H.latest_per_key(windows, ["window_start", "warehouse_zone"], [F.desc("pipeline_processed_at")])
    return last.groupBy(F.to_date("window_start").alias("rollup_date"), "warehouse_zone").agg(F.sum("order_count").alias("total_orders"))


def inventory_velocity_daily(windows: DataFrame) -> DataFrame:
    by = ["warehouse_id", "product_id"]
    last = H.latest_per_key(windows, ["window_start", *by], [F.desc("pipeline_processed_at")])
    return last.groupBy(F.to_date("window_start").alias("rollup_date"), *by).agg(F.sum("net_quantity_change").alias("net_quantity_change"))


def active_deliveries_daily(windows: DataFrame) -> DataFrame:
    last = H.latest_per_key(windows, ["window_start"], [F.desc("pipeline_processed_at")])
    n = F.col("active_delivery_count")
    return last.groupBy(F.to_date("window_start").alias("rollup_date")).agg(F.avg(n).alias("avg_active_deliveries"), F.max(n).alias("max_active_deliveries"), F.count("*").alias("windows_observed"))


def avg_pick_time_daily(windows: DataFrame) -> DataFrame:
    """Each window's mean counts by its samples."""
    last = H.latest_per_key(windows, ["window_start"], [F.desc("pipeline_processed_at")]).filter("sample_count > 0")
    mean = F.sum(F.col("avg_pick_time_seconds") * F.col("sample_count")) / F.sum("sample_count")
    return last.groupBy(F.to_date("window_start").alias("rollup_date")).agg(mean.alias("avg_pick_time_seconds"), F.sum("sample_count").alias("total_samples"))


def malformed_events_daily(malformed: DataFrame) -> DataFrame:
    return malformed.groupBy(F.to_date("processing_time").alias("rollup_date"), "source_subscription", X.category("error_reason").alias("error_category")).agg(F.count("*").alias("event_count"))


def rollup_summary(orders: DataFrame, deliveries: DataFrame, picks: DataFrame, malformed: DataFrame, day: Column) -> DataFrame:
    """One row for a day; what has no roll-up that day is 0 events, or null."""
    said = [
        orders.filter(F.col("rollup_date") == day).agg(F.coalesce(F.sum("total_orders"), F.lit(0)).alias("total_orders")), deliveries.filter(F.col("rollup_date") == day).agg(F.round(F.max("avg_active_deliveries"), 2).alias("avg_active_deliveries")),
        picks.filter(F.col("rollup_date") == day).agg(F.round(F.max("avg_pick_time_seconds"), 2).alias("avg_pick_time_seconds")), malformed.filter(F.col("rollup_date") == day).agg(F.coalesce(F.sum("event_count"), F.lit(0)).alias("malformed_events")),
    ]
    out = said[0].withColumn("_", F.lit(1))
    for other in said[1:]:
        out = out.join(other.withColumn("_", F.lit(1)), "_")
    return out.drop("_")
