"""A monitor of operations on a stream: records events, evaluates at each trigger, and keeps the modes in force.

Events are kept in the folder by micro-batch, so that a batch that is run again replaces itself. An evaluation
takes the events of the trailing window, and with the modes in force before gives those after, a row for each
key. Modes are written to a new folder each time; the last one is read back when a monitor starts again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lattica.operators.workload import DEFAULT, NONE, WorkloadConfig, decide, finish_features

EVENTS = "key string, seq bigint, ts timestamp, op string, file_size bigint"
MODES = "key string, mode string, accepted string, accepted_us bigint, workload string, confidence double"
RUNS = "run bigint, at_us bigint, keys bigint, changed bigint, milliseconds double, error string"


def trailing_features(events: DataFrame, now_us: int, config: WorkloadConfig = DEFAULT) -> DataFrame:
    """Features of each key's events within the window that ends now, its last ``capacity`` ones at most (None: all)."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    inside = events.withColumn("us", us).where((F.col("us") >= now_us - config.window_seconds * 1_000_000) & (F.col("us") <= now_us))
    if config.capacity is not None:
        # The ring holds the last ones: where a key has more, those before its capacity-th last are cut off by their place.
        inside = inside.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("us"), F.desc("seq")))).where(F.col("rank") <= config.capacity)
    grouped = inside.groupBy("key").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("op") == op).alias(name) for op, name in (("Delete", "deletes"), ("Write", "writes"), ("Read", "reads"))],
        F.max("us").alias("us"),
        F.min("us").alias("first_us"),
        F.max_by("file_size", F.struct("us", "seq")).alias("last_size"),
    )
    return finish_features(grouped, config)


def step_modes(decisions: DataFrame, before: DataFrame, now_us: int, config: WorkloadConfig = DEFAULT) -> DataFrame:
    """The modes in force after one evaluation (columns of MODES and ``changed``); keys without a decision keep theirs."""
    b = before.select(F.col("key").alias("k"), F.col("mode").alias("old"), F.col("accepted").alias("old_accepted"), "accepted_us")
    j = decisions.select("key", "rule_mode", "workload", "confidence").join(b, F.col("key") == F.col("k"), "full_outer").withColumn("key", F.coalesce("key", "k"))
    allowed = (F.col("confidence") >= config.min_confidence) & F.col("rule_mode").isin(*config.allowed)
    held = F.col("accepted_us").isNotNull() & (F.col("rule_mode") != F.col("old_accepted")) & (F.lit(now_us) - F.col("accepted_us") < config.min_mode_seconds * 1_000_000)
    mode = F.when(F.col("rule_mode").isNull(), F.col("old")).when(~allowed, NONE).when(held, F.col("old_accepted")).otherwise(F.col("rule_mode"))
    accepts = F.coalesce(allowed & ~held, F.lit(False))
    out = j.select(
        "key", mode.alias("mode"), F.when(accepts, F.col("rule_mode")).otherwise(F.col("old_accepted")).alias("accepted"),
        F.when(accepts, F.lit(now_us).cast("long")).otherwise(F.col("accepted_us")).alias("accepted_us"), "workload", "confidence", F.coalesce("old", F.lit(NONE)).alias("old"),
    )
    return out.withColumn("changed", F.col("mode") != F.col("old")).drop("old")


class Monitor:
    """Start it on a stream of events (columns of EVENTS); ``folder`` is one that driver and executors share.

    clock gives the time of an evaluation in microseconds. on_change gets a DataFrame of the keys whose mode changed.
    """

    def __init__(self, spark: SparkSession, folder: str, config: WorkloadConfig = DEFAULT, clock: Callable[[], int] | None = None, on_change: Callable[[DataFrame], None] | None = None):
        self.spark, self.folder, self.config, self.on_change = spark, folder, config, on_change
        self.clock = clock or (lambda: int(time.time() * 1e6))
        self.query: StreamingQuery | None = None
        runs = self.runs().agg(F.max("run").alias("n")).first()["n"]
        self.last = runs or 0

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def events(self) -> DataFrame:
        return self._table("events", EVENTS)

    def modes(self) -> DataFrame:
        """The modes in force after the last evaluation."""
        return self._table(f"modes/run={self.last}", MODES)

    def runs(self) -> DataFrame:
        return self._table("runs", RUNS)

    def start(self, stream: DataFrame, interval: str | None = "5 minutes") -> StreamingQuery:
        """Record and evaluate every interval; without one, until all input at hand is read."""
        if self.query is not None and self.query.isActive:
            raise RuntimeError("the monitor runs already")
        write = stream.select("key", "seq", "ts", "op", "file_size").writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/checkpoint")
        self.query = (write.trigger(processingTime=interval) if interval else write.trigger(availableNow=True)).start()
        return self.query

    def stop(self) -> None:
        """Stopping twice, or what never started, does nothing."""
        if self.query is not None:
            self.query.stop()

    def _batch(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/events/batch={number}")
        self.evaluate()

    def evaluate(self) -> int:
        """One evaluation now; gives its number. An error is recorded and raised."""
        began, now, run = time.perf_counter(), self.clock(), self.last + 1
        keys = changed = 0
        error = None
        try:
            decisions = decide(trailing_features(self.events(), now, self.config), self.config)
            path = f"{self.folder}/modes/run={run}"
            step_modes(decisions, self.modes(), now, self.config).write.mode("overwrite").parquet(path)
            written = self.spark.read.parquet(path)
            counts = written.agg(F.count("*").alias("n"), F.count_if("changed").alias("c")).first()
            keys, changed = counts["n"], counts["c"]
            if changed and self.on_change:
                self.on_change(written.where("changed").drop("changed"))
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:500]
            raise
        finally:
            row = (run, now, keys, changed, (time.perf_counter() - began) * 1000, error)
            self.spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")
            if error is None:
                self.last = run
        return run

    def stats(self) -> dict:
        """Whether it runs, its evaluations, events in all and in the window, and what the stream says of its last batch."""
        us = F.unix_micros("ts")
        e = self.events().agg(F.count("*").alias("n"), F.count_if(us >= self.clock() - self.config.window_seconds * 1_000_000).alias("w")).first()
        progress = self.query.lastProgress if self.query is not None else None
        return {"running": self.query is not None and self.query.isActive, "evaluations": self.runs().count(), "events": e["n"], "events_in_window": e["w"], "last_progress": progress}

    def metrics(self) -> DataFrame:
        """One row: evaluations, errors and their rate, mode changes, least, mean and greatest time of an evaluation."""
        return self.runs().agg(
            F.count("*").alias("evaluations"),
            F.count("error").alias("errors"),
            F.coalesce(F.count("error") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("error_rate"),
            F.coalesce(F.sum("changed"), F.lit(0)).alias("mode_changes"),
            *[F.coalesce(f("milliseconds"), F.lit(0.0)).alias(f"{n}_milliseconds") for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))],
        )
