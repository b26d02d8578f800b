"""Streams, sinks, merges, ranks, quality and models on small tables with known results."""

import datetime
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from basketry.operators import analytics as A
from basketry.operators import history as H
from basketry.operators import quality as Q
from basketry.plans import learning, models
from basketry.sources import generate
from basketry.sources import tables as T
from basketry.streaming import events as E

EVENT = "order_id string, customer_id string, event_type string, timestamp string, warehouse_zone string"
NEEDED = ["order_id", "customer_id", "event_type", "timestamp", "warehouse_zone"]


def order(i, minute, second=0, kind="placed", zone="A"):
    return json.dumps({"order_id": f"O{i}", "customer_id": "C1", "event_type": kind, "timestamp": f"2024-01-01T00:{minute:02}:{second:02}Z", "warehouse_zone": zone})


def day(n):
    return datetime.date(2024, 1, n)


@pytest.mark.parametrize("n", [0, 1, 4, 5, 7, 23, 5_000])
def test_tiles_equal_ntile(spark, n):
    r = random.Random(n)
    rows = [(i, r.choice([None, 1, 1, 1, 2, 5, r.randint(0, 10**6)]), float(r.randint(0, 9))) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, a int, b double").repartition(3)
    orders = {"x": [("a", True), ("id", True)], "y": [("b", False), ("id", True)], "z": [("a", False), ("id", True)]}
    got = {r["id"]: (r["x"], r["y"], r["z"]) for r in A.quantile_scores(df, orders, parts=8).collect()}
    null = lambda v: (v is not None, v or 0)
    want = {}
    for k, by in enumerate((lambda r: (null(r[1]), r[0]), lambda r: (-r[2], r[0]), lambda r: (r[1] is None, -(r[1] or 0), r[0]))):
        for i, row in enumerate(sorted(rows, key=by)):
            q, more = divmod(n, 5)
            tile = i // (q + 1) + 1 if i < more * (q + 1) else more + (i - more * (q + 1)) // q + 1
            want.setdefault(row[0], []).append(tile)
    assert got == {i: tuple(t) for i, t in want.items()}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_event_times_are_in_utc_whatever_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = E.classify(spark.createDataFrame([(order(1, 5),)], "value string"), NEEDED, EVENT).select(F.unix_timestamp("event_time")).first()[0]
        assert got == 1704067500
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize(
    "text, reason",
    [(order(1, 1) + " junk", "invalid_json"), (order(1, 1) + "} junk", "invalid_json"), (order(1, 1) + "] junk", "invalid_json"), (order(1, 1) + ", 1", "invalid_json"), (" " + order(1, 1) + " ", None), ("[1]", "invalid_json"), ('"x"', "invalid_json"), (order(1, 1).replace("00Z", "00+01:00"), "invalid_timestamp"), (order(1, 1).replace('"2024-01-01T00:01:00Z"', "5"), "invalid_timestamp"), (order(1, 1), None)],
)
def test_what_is_malformed(spark, text, reason):
    got = E.classify(spark.createDataFrame([(text,)], "value string"), NEEDED, EVENT).first()["error_reason"]
    assert (got and got.split(":")[0]) == reason


def test_dead_letters_of_three_streams(spark):
    made = [E.classify(spark.createDataFrame([("{",), (order(1, 1),)], "value string"), NEEDED, EVENT, source=s) for s in ("orders", "deliveries", "inventory")]
    assert sorted(r["source_subscription"] for r in E.dead_letters(*made).collect()) == ["deliveries", "inventory", "orders"]
    day_of = models.malformed_events_daily(E.dead_letters(*made))
    assert {(r["source_subscription"], r["error_category"], r["event_count"]) for r in day_of.collect()} == {(s, "invalid_json", 1) for s in ("orders", "deliveries", "inventory")}


def test_unknown_zone(spark):
    df = spark.createDataFrame([("A",), (None,)], "warehouse_zone string")
    assert {r[0] for r in E.with_zone(df).collect()} == {"A", "unknown_zone"}


def feed(folder, name, lines):
    (folder / name).write_text("\n".join(lines))


def test_late_events_fire_a_window_again_and_very_late_ones_do_not(spark, tmp_path):
    """One file a batch: minute 0 fires, a late event corrects it, and one that comes after watermark and lateness is dropped; the last result of each window is the batch's."""
    (tmp_path / "in").mkdir()
    batches = [[order(1, 0), order(2, 0), order(2, 0)], [order(3, 3)], [order(4, 0, 30)], [order(5, 20)], [order(6, 21)], [order(7, 0, 40)]]
    raw = T.text_stream(spark, str(tmp_path / "in"), 1)
    live = E.good(E.classify(raw, NEEDED, EVENT)).withWatermark("event_time", E.WATERMARK)
    counts = E.distinct_count(live, "event_time", "warehouse_zone", ["order_id", "event_type", "timestamp"]).withColumn("pipeline_processed_at", F.current_timestamp())
    for i, lines in enumerate(batches):
        feed(tmp_path / "in", f"{i}.txt", lines)
        T.append_stream(counts, str(tmp_path / "out"), str(tmp_path / "ck"), "update").trigger(availableNow=True).start().awaitTermination(120)
    fired = spark.read.parquet(str(tmp_path / "out"))
    first = fired.filter(F.minute("window_start") == 0)
    assert sorted(r["order_count"] for r in first.collect()) == [2, 3]  # fired twice; event 7 is dropped
    last = E.latest_per_window(fired, ["window_start", "warehouse_zone"])
    assert {r["window_start"].minute: r["order_count"] for r in last.collect()} == {0: 3, 3: 1, 20: 1, 21: 1}
    assert models.orders_daily(fired).first()["total_orders"] == 6


def test_velocity_and_deliveries_on_streams_equal_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"w": "W", "p": f"P{i % 2}", "k": "picked", "q": i, "d": f"D{i % 3}", "timestamp": f"2024-01-01T00:0{i // 4}:{i:02}Z"} for i in range(16)]
    feed(tmp_path / "in", "a.txt", [json.dumps(r) for r in [*rows, rows[0], rows[5]]])
    feed(tmp_path / "in", "b.txt", [json.dumps(rows[0] | {"timestamp": "2024-01-01T01:00:00Z"})])
    shape = "w string, p string, k string, q long, d string, timestamp string"
    metrics = {"velocity": lambda e: E.distinct_sum(e, "event_time", ["w", "p"], ["w", "p", "k", "timestamp"], "q"), "active": lambda e: E.active(e, "event_time", "d", "k", "completed")}
    for name, f in metrics.items():
        live = E.good(E.classify(T.text_stream(spark, str(tmp_path / "in"), 1), ["w", "timestamp"], shape)).withWatermark("event_time", E.WATERMARK)
        T.append_stream(f(live), str(tmp_path / name), str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start().awaitTermination(120)
        batch = f(E.good(E.classify(spark.read.text(str(tmp_path / "in")), ["w", "timestamp"], shape)))
        got = spark.read.parquet(str(tmp_path / name)).select(*batch.columns)
        assert sorted(map(str, got.filter("window_start < '2024-01-01 01:00:00'").collect())) == sorted(map(str, batch.filter("window_start < '2024-01-01 01:00:00'").collect()))


def test_merge_never_multiplies_rows(spark):
    t = spark.createDataFrame([(1, 1, 0)], "k int, q int, a int")
    s = spark.createDataFrame([(1, 2, 5), (1, 3, 6)], "k int, q int, a int")
    with pytest.raises(PySparkException):
        H.merge_upsert(t, s, ["k"], ["q"]).collect()
    assert [tuple(r) for r in H.merge_upsert(t, s, ["k"], ["q"], follow=["a"], order=[F.desc("q")]).collect()] == [(1, 3, 6)]


def test_merge_into_a_table_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    T.replace(spark.createDataFrame([(1, 1), (2, 2)], "k int, q int"), path)
    s = spark.createDataFrame([(2, 5), (3, 3)], "k int, q int")
    for _ in range(2):
        T.merge_into(spark, path, s, ["k"], ["q"])
        assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, 1), (2, 5), (3, 3)}


def test_replica_follows_a_stream_of_changes(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "op string, seq long, k int, q int"
    T.replace(spark.createDataFrame([(1, 1), (2, 2)], "k int, q int"), path)
    (tmp_path / "in").mkdir()
    feed(tmp_path / "in", "a.json", ['{"op":"U","seq":1,"k":1,"q":7}', '{"op":"I","seq":2,"k":3,"q":3}'])
    feed(tmp_path / "in", "b.json", ['{"op":"D","seq":3,"k":2}', '{"op":"U","seq":4,"k":3,"q":4}', '{"op":"U","seq":5,"k":3,"q":5}'])
    T.replicate(T.change_stream(spark, str(tmp_path / "in"), shape), path, str(tmp_path / "ck"), ["k"]).trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, 7), (3, 5)}


def test_made_changes_apply(spark):
    t = spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("s"))
    c = generate.changes(spark, t, "k", {"s": "y"})
    out = H.apply_changes(t, c, ["k"])
    assert out.count() == 100 - c.filter("op = 'D'").count() and out.filter("s = 'y'").count() == c.filter("op = 'U'").count() > 0


def test_loads(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, s string")
    T.export_csv(df, str(tmp_path / "csv"))
    assert T.load(spark, str(tmp_path / "csv"), "k int, s string", str(tmp_path / "t"), expected=2) == 2
    assert {"_loaded_at", "_source_file"} <= {*spark.read.parquet(str(tmp_path / "t")).columns}
    with pytest.raises(ValueError):
        T.load(spark, str(tmp_path / "csv"), "k int, s string", str(tmp_path / "t"), expected=3)
    assert {f.dataType.simpleString() for f in T.csv(spark, str(tmp_path / "csv"), None).schema} == {"int", "string"}
    assert T.migrate(spark, ["a", "b"], str(tmp_path / "m"), read=lambda t: df) == {"a": 2, "b": 2}
    assert T.kafka_options("h:1", "t")["subscribe"] == "t"
    T.swap(spark.read.parquet(str(tmp_path / "t")).filter("k = 1"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_console(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feed(tmp_path / "in", "a.txt", ["x"])
    T.console(T.text_stream(spark, str(tmp_path / "in"))).trigger(availableNow=True).start().awaitTermination(60)


def test_backdated_history(spark):
    at = lambda x: F.lit(x).cast("timestamp")
    c = spark.createDataFrame([("1", "a", "c", "s"), ("2", "b", "c", "s")], "customer_id string, segment string, city string, state string")
    first = models.snap_customers(None, c, at("2024-02-01"), at("1990-01-01"))
    later = models.snap_customers(first, c.filter("customer_id = '1'").withColumn("segment", F.lit("z")), at("2024-03-01"))
    assert first.filter("valid_from = '1990-01-01'").count() == 2
    assert later.count() == 3 and later.filter("valid_to IS NULL").select("segment").first()[0] == "z"


def test_versions_share_no_day(spark):
    facts = spark.createDataFrame([("1", day(5)), ("1", day(9))], "c string, d date")
    v = spark.createDataFrame([("1", "a", day(1), day(5)), ("1", "b", day(5), datetime.date(9999, 12, 31))], "c string, s string, valid_from date, valid_to date")
    assert sorted(r["s"] for r in H.as_of_join(facts, v, "c", "d", half_open=True).collect()) == ["b", "b"]
    assert H.as_of_join(facts, v, "c", "d").count() == 3  # inclusive ends match a change day twice


def test_price_periods(spark):
    p = spark.createDataFrame([("1", day(1), day(5)), ("1", day(5), day(9)), ("1", day(10), day(10)), ("2", day(1), day(3))], "product_id string, valid_from date, valid_to date")
    assert Q.price_period_violations(p).count() == 1 and Q.price_period_overlaps(p).count() == 1
    out = {r["test"]: (r["failures"], r["ok"]) for r in Q.failing({"order": (Q.price_period_violations(p), "error"), "overlap": (Q.price_period_overlaps(p), "warn")}).collect()}
    assert out == {"order": (1, False), "overlap": (1, True)}


def test_scan_severity_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (None, "it's"), (None, "b")], "k int, s string")
    s = Q.scan(df, [Q.Rule("u", "UNIQUENESS", unique="k"), Q.accepted("s", "a", "it's"), Q.Rule("w", "VALIDITY", "k > 5", severity="warn")])
    assert {r["rule"]: (r["passed"], r["ok"]) for r in s.collect()} == {"u": (3, True), "s_accepted": (2, False), "w": (0, False)}
    assert tuple(Q.overall(s).first()) == (3, 1, 1, False)
    assert Q.overall(Q.scan(df.filter("false"), [Q.not_null("k"), Q.Rule("u", "UNIQUENESS", unique="k")])).first()["passed"]
    assert [Q.count_gate(df, a, b).first()["ok"] for a, b in ((1, 3), (4, 9))] == [True, False]


def test_upper_median_and_rate(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("a", 9), ("b", 4)], "g string, v int")
    assert {tuple(r) for r in A.upper_median(df, ["g"], "v").collect()} == {("a", 3), ("b", 4)}
    assert A.rate(df.withColumn("f", F.col("v") > 2), [], "f").first()[0] == 0.6


def test_rolling(spark):
    df = spark.createDataFrame([("a", i, 10 * i) for i in range(1, 10)], "g string, i int, v int")
    got = {r["i"]: (r["rolling_avg"], r["rolling_sum"]) for r in A.rolling(df, ["g"], "i", "v").collect()}
    assert got[1] == (10.0, 10) and got[7] == (40.0, 280) and got[9] == (60.0, 420)


def test_segments_of_both_ladders(spark):
    s = spark.createDataFrame([(4, 4, 4), (3, 3, 1), (5, 2, 5), (1, 3, 1), (1, 1, 1), (2, 2, 2), (3, 1, 1)], "r int, f int, m int")
    got = [tuple(r) for r in s.select(F.expr(models.SEGMENTS_QUERY), F.expr(models.SEGMENTS_360)).collect()]
    assert got == [("champions", "champion"), ("loyal", "loyal"), ("new_customer", "new_customer"), ("at_risk", "at_risk"), ("lost", "lost"), ("potential", "lost"), ("potential", "potential")]


def test_learning(spark, tmp_path):
    r = random.Random(1)
    rows = [(float(r.random()), float(r.random()), r.choice("xy")) for _ in range(400)]
    df = spark.createDataFrame([(a, b, c, int(a + 0.05 * r.random() > 0.7)) for a, b, c in rows], "a double, b double, c string, label int")
    model = learning.train(df, ["a", "b"], ["c"], "label")
    m = learning.evaluate(model.transform(df), "label")
    assert m["roc_auc"] > 0.95 and learning.weights(model, df).first()["feature"] == "a"
    s = learning.score(model, df.drop("label"))
    assert s.columns == ["a", "b", "c", "probability", "predicted"] and s.filter("probability BETWEEN 0 AND 1").count() == 400
    assert learning.promote(model, m, str(tmp_path / "m")) and len(PipelineModel.load(str(tmp_path / "m")).stages) == len(model.stages)
    assert not learning.promote(model, m | {"roc_auc": 0.79}, str(tmp_path / "n")) and not (tmp_path / "n").exists()


def test_drift(spark):
    a = spark.createDataFrame([(float(i % 10), "x") for i in range(100)] + [(None, "y")], "n double, s string")
    moved = a.withColumn("n", F.col("n") / 3)
    got = {r["feature"]: (r["distance"], r["drifted"]) for r in learning.drift(a, moved, ["n", "s"]).collect()}
    assert got["n"][1] and got["s"] == (0.0, False)
    assert {r["distance"] for r in learning.drift(a, a.filter("false"), ["n", "s"]).collect()} == {None}
    assert {r["distance"] for r in learning.drift(a.filter("false"), a, ["n", "s"]).collect()} == {None}


def test_generators(spark):
    lines = generate.order_events(500)
    assert lines == generate.order_events(500) and len(lines) > len({*lines}) > 490
    bad = E.classify(spark.createDataFrame([(x,) for x in lines], "value string"), NEEDED, EVENT).filter("error_reason IS NOT NULL").count()
    assert bad == 0
    p = spark.createDataFrame([("1", 2), ("2", 14)], "product_id string, lead_time_days int")
    s = generate.simulate(p, days=60)
    assert s.count() == 120 and s.filter("qty_on_hand < 0").count() == 0
    f = models.stockout_risk_features(s, p.withColumns({"category": F.lit("c"), "price": F.lit(1.0)}))
    assert f.count() == 2 * 53 and f.filter("stockout_next_7d IS NULL").count() == 0


def test_rollups_take_the_last_firing(spark):
    at = lambda m, s=0: datetime.datetime(2024, 1, 1, 0, m, s)
    w = spark.createDataFrame([(at(0), "A", 1, at(1)), (at(0), "A", 3, at(2)), (at(1), "A", 2, at(2))], "window_start timestamp, warehouse_zone string, order_count long, pipeline_processed_at timestamp")
    assert models.orders_daily(w).first()["total_orders"] == 5
    p = spark.createDataFrame([(at(0), 10.0, 1, at(1)), (at(0), 20.0, 3, at(2)), (at(1), 40.0, 1, at(2)), (at(2), 9.0, 0, at(2))], "window_start timestamp, avg_pick_time_seconds double, sample_count long, pipeline_processed_at timestamp")
    assert tuple(models.avg_pick_time_daily(p).first())[1:] == (25.0, 4)
