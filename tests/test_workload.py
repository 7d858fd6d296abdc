"""Workload rules, hysteresis and streams."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.operators import catalog, space, workload
from lattica.streaming.workload_stream import stream_decisions, stream_modes

T0 = dt.datetime(2024, 1, 1)


def events(spark, ops, step=1.0, size=1024):
    rows = [("k", i, T0 + dt.timedelta(seconds=i * step), {"D": "Delete", "W": "Write", "R": "Read"}[o], size) for i, o in enumerate(ops)]
    return spark.createDataFrame(rows, "key string, seq long, ts timestamp, op string, file_size long")


def last(spark, ops, **kw):
    d = workload.decide(workload.sliding_features(events(spark, ops, **kw)))
    return d.orderBy(F.desc("seq")).first()


def test_features(spark):
    e = events(spark, "DDDDDDWWWR").withColumn("file_size", F.when(F.col("op") == "Delete", 1024).when(F.col("op") == "Write", 2048).otherwise(3072))
    f = workload.sliding_features(e).orderBy(F.desc("seq")).first()
    assert (f["delete_ratio"], f["write_ratio"], f["read_ratio"], f["last_size"]) == (0.6, 0.3, 0.1, 3072)


def test_window_forgets(spark):
    a = events(spark, "DDDDD")
    b = events(spark, "WWW").withColumn("ts", F.col("ts") + F.expr("interval 7 minutes")).withColumn("seq", F.col("seq") + 5)
    f = workload.sliding_features(a.union(b)).orderBy(F.desc("seq")).first()
    assert (f["n"], f["write_ratio"]) == (3, 1.0)


@pytest.mark.parametrize(("ops", "step", "want"), [("DDDDDDDWWR", 1, "BatchDeletion"), ("WWWWWWWRRD", 10, "FrequentWrites"), ("W" * 10, 1, "AppendOnly"), ("R" * 8 + "WD", 1, "ReadHeavy"), ("RRRRRWWWWD", 1, "MixedRW"), ("DDDDDWWWWR", 20, "Unknown"), ("WWW", 1, "Unknown")])
def test_classes(spark, ops, step, want):
    assert last(spark, ops, step=step)["workload"] == want


def test_decisions(spark):
    big, small = 600 << 20, 1 << 20
    assert last(spark, "RRRRRWWWWD" * 20, size=big)["mode"] == "incremental"
    assert last(spark, "RRRRRWWWWD" * 20, size=small)["mode"] == "lazy"
    few = last(spark, "DDDDDDDWWR")
    assert (few["rule_mode"], few["mode"]) == ("lazy", "none") and few["confidence"] == pytest.approx(0.65)


def test_fold():
    us = [s * 1_000_000 for s in (0, 10, 20, 29, 31, 65)]
    modes, state = workload.fold_modes(us, ["lazy", "incremental", "lazy", "none", "incremental", "incremental"], [0.9, 0.9, 0.9, 0.1, 0.9, 0.9])
    # Every accepted decision starts the time anew.
    assert modes == ["lazy", "lazy", "lazy", "none", "lazy", "incremental"] and state == (65_000_000, "incremental")


def test_hysteresis_by_key(spark):
    rows = [("a", 1, T0, "lazy", 0.9), ("a", 2, T0 + dt.timedelta(seconds=5), "incremental", 0.9), ("b", 1, T0, "incremental", 0.9)]
    d = spark.createDataFrame(rows, "key string, seq long, ts timestamp, rule_mode string, confidence double")
    m = workload.hysteresis(d)
    assert {(r["key"], r["seq"]): r["mode"] for r in m.collect()} == {("a", 1): "lazy", ("a", 2): "lazy", ("b", 1): "incremental"}
    assert {r["key"]: r["mode_changes"] for r in workload.mode_changes(m).collect()} == {"a": 1, "b": 1}


def test_streams(spark, tmp_path):
    e = events(spark, "RRRRRWWWWD" * 100, step=2.0, size=600 << 20)
    e.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = stream_decisions(stream).writeStream.format("memory").queryName("decided").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("decided")
    want = workload.decide(workload.tumbling_features(e))
    keys = ["key", "window_start", "n", "deletes", "workload", "mode"]
    assert got.select(keys).exceptAll(want.select(keys)).count() == 0 and got.count() == want.count()
    rows = pd.DataFrame({"key": ["a"] * 3 + ["b"], "us": [0, 10_000_000, 60_000_000, 0], "rule_mode": ["lazy", "incremental", "incremental", "lazy"], "confidence": [0.9, 0.9, 0.9, 0.2]})
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "d"))
    d = spark.readStream.schema("key string, us long, rule_mode string, confidence double").parquet(str(tmp_path / "d"))
    q = stream_modes(d).writeStream.format("memory").queryName("modes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["key"], r["us"], r["mode"]) for r in spark.table("modes").collect()) == [("a", 0, "lazy"), ("a", 10_000_000, "lazy"), ("a", 60_000_000, "incremental"), ("b", 0, "none")]


def test_catalog_refusals(spark):
    a = spark.createDataFrame([(1, "x", "v")], "object long, name string, value string")
    with pytest.raises(KeyError):
        catalog.delete_attributes(a, spark.createDataFrame([(1, "y")], "object long, name string"))
    links = spark.createDataFrame([(0, "a", "hard", 1)], "parent long, name string, link_type string, target long")
    paths = spark.createDataFrame([("/a", 1)], "path string, address long")
    with pytest.raises(Exception, match="no such object"):
        catalog.add_hard_links(links, spark.createDataFrame([(0, "b", "/none")], "parent long, name string, target_path string"), paths).collect()


def test_best_fit(spark):
    free = spark.createDataFrame([(0, 10), (100, 64), (200, 64), (300, 500)], "at long, size long")
    want = spark.createDataFrame([(1, 10), (2, 11), (3, 64), (4, 65), (5, 501), (6, 1)], "id long, size long")
    got = {r["id"]: r["at"] for r in space.best_fit(want, free).collect()}
    assert got == {1: 0, 2: 100, 3: 100, 4: 300, 5: None, 6: 0}


def test_late_events_are_dropped(spark, tmp_path):
    """Events behind the watermark don't count: a window that was given stays as it was."""
    from lattica.streaming.workload_stream import stream_features

    minute = lambda k: T0 + dt.timedelta(minutes=k)
    schema = "key string, seq long, ts timestamp, op string, file_size long"
    for k, rows in enumerate([[("a", 1, minute(1), "Read", 1), ("a", 2, minute(2), "Write", 1)], [("a", 3, minute(60), "Read", 1)], [("a", 4, minute(3), "Delete", 1), ("a", 5, minute(61), "Read", 1)], [("a", 6, minute(200), "Read", 1)], [("a", 7, minute(201), "Read", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream_features(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r["window_start"]: (r["n"], r["deletes"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {T0: (2, 0), minute(60): (2, 0)}


def test_monitor(spark, tmp_path):
    """Recording, evaluating, holding a mode, telling of changes, starting again, and what the metrics say."""
    from dataclasses import replace

    from lattica.streaming.monitor import Monitor

    config = replace(workload.DEFAULT, min_confidence=0.5)
    now, told = [0], []
    schema = "key string, seq long, ts timestamp, op string, file_size long"
    at = lambda e: int((e - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)

    def feed(ops, second, key="k"):
        rows = [(key, k, T0 + dt.timedelta(seconds=second + k * 0.01), {"D": "Delete", "W": "Write", "R": "Read"}[o], 600 << 20) for k, o in enumerate(ops)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        now[0] = at(T0 + dt.timedelta(seconds=second + 3))

    def run(m):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        m.start(stream, interval=None).awaitTermination()
        return {r["key"]: r["mode"] for r in m.modes().collect()}

    make = lambda: Monitor(spark, str(tmp_path / "state"), config, clock=lambda: now[0], on_change=lambda d: told.append(sorted((r["key"], r["mode"]) for r in d.collect())))
    m = make()
    assert m.modes().count() == 0 and m.metrics().first()["evaluations"] == 0 and not m.stats()["running"]
    m.stop()
    feed("D" * 30, 0)
    assert run(m) == {"k": "lazy"}
    feed("W" * 5 + "R" * 50, 10)
    assert run(m) == {"k": "lazy"}  # the rules say incremental, too soon after the last decision
    m = make()
    feed("R" * 100 + "W" * 80, 60)
    assert run(m) == {"k": "incremental"}
    feed("R", 1000)
    assert run(m) == {"k": "none"}  # one event in the window: not sure enough
    assert told == [[("k", "lazy")], [("k", "incremental")], [("k", "none")]]
    row = m.metrics().first()
    assert (row["evaluations"], row["errors"], row["error_rate"], row["mode_changes"]) == (4, 0, 0.0, 3) and 0 < row["min_milliseconds"] <= row["avg_milliseconds"] <= row["max_milliseconds"]
    s = m.stats()
    assert (s["evaluations"], s["events"], s["events_in_window"], s["running"]) == (4, 30 + 55 + 180 + 1, 1, False)
    m.on_change = lambda d: 1 / 0
    feed("D" * 40, 2000)
    with pytest.raises(Exception, match="ZeroDivisionError|division"):
        run(m)
    assert make().metrics().first()["errors"] >= 1


def test_modes_by_step_are_those_of_the_fold(spark):
    import random

    from lattica.streaming.monitor import MODES, step_modes

    rng = random.Random(4)
    modes = spark.createDataFrame([], MODES)
    state, us = (None, "none"), 0
    for _ in range(12):
        us += rng.choice([5, 20, 40]) * 1_000_000
        mode, sure = rng.choice(["lazy", "incremental", "none"]), rng.choice([0.2, 0.9])
        want, state = workload.fold_modes([us], [mode], [sure], state)
        d = spark.createDataFrame([("k", mode, "MixedRW", sure)], "key string, rule_mode string, workload string, confidence double")
        modes = spark.createDataFrame(step_modes(d, modes, us).collect(), MODES + ", changed boolean").drop("changed")
        assert modes.first()["mode"] == want[0]


def test_flushes(spark, tmp_path):
    from lattica.streaming.workload_stream import stream_flushes

    schema = "key string, ts timestamp, underflow long, total long"
    second = lambda s: T0 + dt.timedelta(seconds=s)
    for rows in ([("a", second(0), 1, 100), ("a", second(5), 1, 0), ("b", second(0), 1, 100)], [("a", second(9), 4, 0)], [("c", second(400), 1, 1000)], [("c", second(401), 1, 0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = stream_flushes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r["key"], r["us"] - int((T0 - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000, r["reason"], r["underflow"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 9_000_000, "threshold", 6, 100), ("b", 300_000_000, "timeout", 1, 100)]
    with pytest.raises(ValueError):
        stream_flushes(None, threshold=0)


def test_configurations_are_checked():
    for bad in ({"window_seconds": 0}, {"min_samples": 0}, {"capacity": 0}, {"min_confidence": 1.5}, {"allowed": ("eager",)}):
        with pytest.raises(ValueError):
            workload.WorkloadConfig(**bad)
    for bad in ((0, 300), (1.5, 300), (0.05, 0)):
        with pytest.raises(ValueError):
            workload.check_lazy(*bad)
    with pytest.raises(ValueError):
        workload.incremental_eta(F.lit(1), F.lit(1), session_ms=0)


def test_sizes_round_ties_to_even(spark):
    from lattica.functions.strings import format_bytes

    want = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1792: "1.8 KB", 1 << 20: "1.0 MB", (1 << 30) + (1 << 27): "1.12 GB", (1 << 30) + 3 * (1 << 27): "1.38 GB", (1 << 20) - 1: "1024.0 KB", (1 << 62): "4294967296.00 GB"}
    got = spark.createDataFrame([(n,) for n in want], "n long").select("n", format_bytes(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == want


def test_walk_refuses_deeper_trees(spark):
    links = spark.createDataFrame([(k, f"g{k}", "hard", k + 1) for k in range(6)], "parent long, name string, link_type string, target long")
    kinds = spark.createDataFrame([(k, "group") for k in range(7)], "address long, kind string")
    assert catalog.walk(links, kinds, 0, most_levels=6).count() == 6
    with pytest.raises(ValueError, match="levels"):
        catalog.walk(links, kinds, 0, most_levels=5)


def ops_of(spark, path, rows):
    """A folder with a table of events (user, type, microseconds, value)."""
    at = lambda us: None if us is None else T0 + dt.timedelta(microseconds=us)
    table = [(k, at(us), user, kind, float(v), "{}") for k, (user, kind, us, v) in enumerate(rows)]
    spark.createDataFrame(table, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def same_as_sql(spark, path, name):
    import duckdb

    from lattica.plans import registry, workload_queries  # noqa: F401

    con = duckdb.connect()
    con.sql(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, path)
    want = con.sql(registry.ORACLES[name]).select(*df.columns).fetchall()
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["wl_features_sliding", "wl_classify", "wl_decide", "wl_metrics_snapshot", "wl_ring_capacity"])
def test_windows_with_ties(spark, tmp_path, name):
    """Events of one instant all count at each of them, also at a window's two ends; some have no time."""
    import random

    pick, hours6 = random.Random(7), 21_600_000_000
    kinds = ["view", "click", "signup", "purchase", "error"]
    times = [pick.choice([pick.randrange(6 * hours6), pick.randrange(24) * hours6 // 4, pick.randrange(24) * hours6 // 4 + 1]) for _ in range(3_000)]
    rows = [(pick.randrange(4), pick.choice(kinds), us, pick.randrange(10, 100)) for us in times]
    same_as_sql(spark, ops_of(spark, tmp_path, rows + ([(1, "error", None, 5)] * 12 if name == "wl_features_sliding" else [])), name)


@pytest.mark.parametrize("name", ["wl_features_sliding", "wl_classify", "wl_decide", "wl_evaluate_now", "wl_hysteresis", "wl_mode_changes", "wl_metrics_snapshot"])
def test_windows_of_many_events(spark, tmp_path, name):
    """Over ten thousand events in a window: all of them count."""
    rows = [(4, "error" if k < 1_500 or k % 11 == 0 else "view" if k % 2 else "signup", k * 1_000_000, 90) for k in range(10_900)]
    rows.append((4, "view", 18_100_000_000, 90))  # later than the least time of a mode
    same_as_sql(spark, ops_of(spark, tmp_path, rows), name)


def test_confidences_are_hundredths(spark):
    """0.9 and 0.05 are 0.95, not the next number."""
    d = spark.createDataFrame([(2_000, 0.2, True)], "n long, d double, burst boolean")
    assert d.select(workload.confidence(F.col("n"), F.col("d"), F.col("burst"))).first()[0] == 0.95
