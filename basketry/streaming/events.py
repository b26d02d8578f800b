"""Event-time metrics over validated events. Each works on a batch and on a stream; on a stream give a watermark.

In update mode a stream emits the running result of a window again and again; latest_per_window takes the last of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.history import latest_per_key

#: The shape of a time, which is in UTC whatever the session's zone.
TIME, TIME_SHAPE = "yyyy-MM-dd'T'HH:mm:ssX", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
WATERMARK = "5 minutes"


def classify(raw: DataFrame, required: list[str], schema: str, column: str = "value", source: str = "stream") -> DataFrame:
    """Adds event, event_time and error_reason: broken JSON, then missing fields, then a bad time; null if the event is good."""
    text = F.col(column).cast("string")
    # the whole text must be one object: readers stop behind the first value, so what follows it must break both an array and an object around it
    whole = (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1) & F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()
    keys = F.when(whole, F.json_object_keys(text))
    missing = F.array_except(F.array(*map(F.lit, required)), F.coalesce(keys, F.array().cast("array<string>")))
    out = raw.withColumns({"event": F.from_json(text, schema), "_missing": missing, "_keys": keys})
    out = out.withColumn("event_time", F.when(F.col("event.timestamp").rlike(TIME_SHAPE), F.try_to_timestamp(F.col("event.timestamp"), F.lit(TIME))))
    reason = (
        F.when(F.col("_keys").isNull(), F.lit("invalid_json: not an object"))
        .when(F.size("_missing") > 0, F.concat(F.lit("missing_fields: "), F.array_join("_missing", ",")))
        .when(F.col("event_time").isNull(), F.concat(F.lit("invalid_timestamp: "), F.coalesce(F.col("event.timestamp"), F.lit(""))))
    )
    return out.withColumns({"error_reason": reason, "source_subscription": F.lit(source)}).drop("_missing", "_keys")


def good(classified: DataFrame) -> DataFrame:
    return classified.filter("error_reason IS NULL").select("event.*", "event_time")


def malformed(classified: DataFrame, column: str = "value") -> DataFrame:
    return classified.filter("error_reason IS NOT NULL").select(F.col(column).cast("string").alias("raw_payload"), "error_reason", "source_subscription", F.current_timestamp().alias("processing_time"))


def dead_letters(*classified: DataFrame) -> DataFrame:
    """The malformed events of all streams in one."""
    parts = [malformed(c) for c in classified]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_zone(events: DataFrame, zone: str = "warehouse_zone", unknown: str = "unknown_zone") -> DataFrame:
    return events.withColumn(zone, F.coalesce(zone, F.lit(unknown)))


def _window(at: str, length: str) -> Column:
    return F.window(at, length)


def _edges(df: DataFrame, *cols) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *cols)


def distinct_count(events: DataFrame, at: str, by: str, key: list[str], length: str = "1 minute", name: str = "order_count") -> DataFrame:
    """Distinct events per window and group, so that a late event only corrects the count. On a stream they are counted in one aggregate, as no exact distinct count
    runs there; a batch counts in two steps and holds no set."""
    n = F.size(F.collect_set(F.struct(*key))).cast("long") if events.isStreaming else F.count_distinct(F.struct(*key))
    g = events.groupBy(_window(at, length), by).agg(n.alias(name))
    return _edges(g, by, name)


def distinct_sum(events: DataFrame, at: str, by: list[str], key: list[str], value: str, length: str = "1 minute", name: str = "net_quantity_change") -> DataFrame:
    """The sum per window and group over events with distinct keys; of equal keys the smallest value counts."""
    one = events.groupBy(_window(at, length), *by, *(k for k in key if k not in by)).agg(F.min(value).alias("_v"))
    return _edges(one.groupBy("window", *by).agg(F.sum("_v").alias(name)), *by, name)


def active(events: DataFrame, at: str, key: str, kind: str, done: str, length: str = "1 minute", tie: str | None = None) -> DataFrame:
    """Keys whose last event in the window is not the final one; a window without any has no row."""
    last = events.groupBy(_window(at, length), key).agg(F.max_by(kind, F.struct(at, tie) if tie else F.col(at)).alias("_kind"))
    return _edges(last.filter(F.col("_kind") != done).groupBy("window").agg(F.count("*").alias("active_delivery_count")), "active_delivery_count")


def pair_times(events: DataFrame, at: str, key: str, kind: str, first: str, second: str, gap: str = "90 seconds") -> DataFrame:
    """(key, started, ended, seconds) for each session that has both events in this order; sessions end after the gap."""
    g = events.groupBy(F.session_window(at, gap), key).agg(F.min(F.when(F.col(kind) == first, F.col(at))).alias("started"), F.min(F.when(F.col(kind) == second, F.col(at))).alias("ended"))
    seconds = (F.col("ended").cast("timestamp").cast("double") - F.col("started").cast("timestamp").cast("double")).alias("seconds")
    return g.select(key, "started", "ended", seconds).filter("seconds >= 0")


def pair_times_stream(events: DataFrame, at: str, key: str, kind: str, first: str, second: str, bound: str = "90 seconds", watermark: str = WATERMARK) -> DataFrame:
    """The streaming form, a join of both events within the bound: session windows cannot be windowed again on a stream."""
    side = lambda k, n: events.filter(F.col(kind) == k).select(F.col(key).alias(f"{n}_{key}"), F.col(at).alias(n)).withWatermark(n, watermark).dropDuplicates([f"{n}_{key}", n])
    a, b = side(first, "started"), side(second, "ended")
    on = F.expr(f"started_{key} = ended_{key} AND ended >= started AND ended <= started + INTERVAL {bound}")
    return a.join(b, on).select(F.col(f"started_{key}").alias(key), "started", "ended", (F.col("ended").cast("double") - F.col("started").cast("double")).alias("seconds"))


def mean_times(pairs: DataFrame, length: str = "1 minute") -> DataFrame:
    g = pairs.groupBy(_window("ended", length)).agg(F.avg("seconds").alias("avg_pick_time_seconds"), F.count("*").alias("sample_count"))
    return _edges(g, "avg_pick_time_seconds", "sample_count")


def latest_per_window(emitted: DataFrame, keys: list[str], at: str = "pipeline_processed_at") -> DataFrame:
    return latest_per_key(emitted, keys, [F.desc(at)])


def daily(latest: DataFrame, by: list[str], aggregates: list[Column], at: str = "window_start") -> DataFrame:
    return latest.groupBy(F.to_date(at).alias("rollup_date"), *by).agg(*aggregates)


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.when(F.col(weight) > 0, F.col(value) * F.col(weight))), F.sum(F.when(F.col(weight) > 0, F.col(weight))))
