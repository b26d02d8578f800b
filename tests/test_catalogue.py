"""Every query with SQL agrees with DuckDB on the smallest tables, and operators do what their fixtures say."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from basketry.operators import history as H
from basketry.operators import quality as Q
from basketry.plans import catalogue
from basketry.sources import tables as T
from basketry.streaming import events as E


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_agrees_with_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = catalogue.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[k]) for k in cols) for r in df.collect()), key=repr)
    r = c.execute(catalogue.ORACLES[name])
    names = [x[0] for x in r.description]
    want = sorted((tuple(plain(dict(zip(names, x))[k]) for k in cols) for x in r.fetchall()), key=repr)
    assert sorted(names) == cols and got == want


EVENT = "order_id string, customer_id string, event_type string, timestamp string, warehouse_zone string"
NEEDED = ["order_id", "customer_id", "event_type", "timestamp", "warehouse_zone"]
GOOD = '{"order_id":"O1","customer_id":"C1","event_type":"placed","timestamp":"2024-01-01T00:00:00Z","warehouse_zone":"A"}'


@pytest.mark.parametrize(
    "text, category",
    [(GOOD, None), (GOOD.replace(',"warehouse_zone":"A"', ""), "missing_fields"), ("{broken", "invalid_json"), ("3", "invalid_json"), (None, "invalid_json"), (GOOD.replace("2024-01-01T00:00:00Z", "not-a-timestamp"), "invalid_timestamp")],
)
def test_classify(spark, text, category):
    r = E.classify(spark.createDataFrame([(text,)], "value string"), NEEDED, EVENT).first()
    assert (r["error_reason"].split(":")[0] if r["error_reason"] else None) == category


def at(second):
    return datetime.datetime(2024, 1, 1, 0, 0, second)


def test_velocity_counts_a_repeated_event_once(spark):
    rows = [("W", "P1000", "picked", at(1), 10), ("W", "P1000", "picked", at(1), 10), ("W", "P1000", "picked", at(2), -3), ("W", "P2000", "received", at(3), 100)]
    e = spark.createDataFrame(rows, "w string, p string, k string, ts timestamp, q long")
    got = E.distinct_sum(e, "ts", ["w", "p"], ["w", "p", "k", "ts"], "q").collect()
    assert {r["p"]: r["net_quantity_change"] for r in got} == {"P1000": 7, "P2000": 100}


def test_active_deliveries(spark):
    rows = [("D1", "departed", at(1)), ("D1", "in_transit", at(2)), ("D2", "completed", at(3)), ("D3", "arrived", at(4)), ("D3", "arrived", at(4))]
    assert E.active(spark.createDataFrame(rows, "d string, k string, ts timestamp"), "ts", "d", "k", "completed").first()["active_delivery_count"] == 2


def test_pick_times(spark):
    rows = [("O1", "placed", at(0)), ("O1", "picked", at(10)), ("O2", "placed", at(0)), ("O2", "picked", at(30)), ("O3", "placed", at(5)), ("O4", "picked", at(1)), ("O4", "placed", at(9))]
    r = E.mean_times(E.pair_times(spark.createDataFrame(rows, "o string, k string, ts timestamp"), "ts", "o", "k", "placed", "picked")).first()
    assert (r["avg_pick_time_seconds"], r["sample_count"]) == (20.0, 2)


def test_stream_counts_like_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join([GOOD, GOOD, GOOD.replace("O1", "O2"), "{broken"]))
    raw = T.text_stream(spark, str(tmp_path / "in"))
    live = E.good(E.classify(raw, NEEDED, EVENT)).withWatermark("event_time", E.WATERMARK)
    counts = E.distinct_count(live, "event_time", "warehouse_zone", ["order_id", "event_type", "timestamp"])
    T.append_stream(counts, str(tmp_path / "out"), str(tmp_path / "ck"), "update").trigger(availableNow=True).start().awaitTermination(120)
    assert [r["order_count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_stream_pairs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    later = GOOD.replace("placed", "picked").replace("00:00:00Z", "00:00:30Z")
    (tmp_path / "in" / "a.txt").write_text("\n".join([GOOD, GOOD, later]))
    live = E.good(E.classify(T.text_stream(spark, str(tmp_path / "in")), NEEDED, EVENT))
    pairs = E.pair_times_stream(live, "event_time", "order_id", "event_type", "placed", "picked")
    T.append_stream(pairs, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r["seconds"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [30.0]


def test_merge_keeps_nulls_unless_asked(spark):
    t = spark.createDataFrame([(1, None), (2, 5)], "k int, q int")
    s = spark.createDataFrame([(1, 7), (2, 6), (3, 1)], "k int, q int")
    assert {tuple(r) for r in H.merge_upsert(t, s, ["k"], ["q"]).collect()} == {(1, None), (2, 6), (3, 1)}
    assert {tuple(r) for r in H.merge_upsert(t, s, ["k"], ["q"], null_safe=True).collect()} == {(1, 7), (2, 6), (3, 1)}


def test_merge_query_where_added_keys_exist(spark, tmp_path):
    keys = [50, 60, 61, 1000050, 1000050, 1000060, 1000061, None]
    rows = [(k, f"B{i}", s) for i, k in enumerate(keys) for s in ((i, None) if k in (50, 1000050) else (i,))]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = catalogue.merge_upsert(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet/*.parquet'")
        want = db.sql(catalogue.ORACLES["merge_upsert"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


def test_snapshot_runs_again_without_change(spark):
    c = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    first = H.snapshot(None, c, "k", ["s"], F.lit("2024-01-01").cast("timestamp"))
    again = H.snapshot(first, c, "k", ["s"], F.lit("2024-02-01").cast("timestamp"))
    assert again.count() == 2 and again.filter("valid_to IS NOT NULL").count() == 0


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "2024-01-01"), (2, None, "2024-01-02")], "k int, s string, d string")
    T.export_csv(df, str(tmp_path / "csv"))
    back = T.csv(spark, str(tmp_path / "csv"), "k int, s string, d string")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    assert {"_loaded_at", "_source_file"} <= {*T.with_load_metadata(back).columns}
    for _ in range(2):
        T.replace_partitions(df, str(tmp_path / "t"), "d")
    T.replace_partitions(df.filter("k = 2"), str(tmp_path / "t"), "d")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert T.jdbc_options("u", "t", "a", "b", column="id", bounds=(1, 9), parts=4)["numPartitions"] == "4"


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "c")], "k int, s string")
    got = {r["rule"]: (r["passed"], r["failed"], r["ok"]) for r in Q.scan(df, [Q.not_null("k"), Q.accepted("s", "a"), Q.Rule("u", "UNIQUENESS", unique="k", threshold=0.3)]).collect()}
    assert got == {"k_not_null": (2, 1, False), "s_accepted": (2, 1, False), "u": (1, 2, True)}
    t = df.withColumn("_loaded_at", F.lit("2024-01-01").cast("timestamp"))
    assert Q.freshness(t, "_loaded_at", F.lit("2024-01-02 06:00:00").cast("timestamp")).first()["status"] == "warn"
    assert Q.report(Q.scan(df, [Q.not_null("k")])).first()["line"].startswith("FAIL k_not_null")


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
