"""Workload analytics over operation events: features of a trailing window, classes, decisions, metrics.

Events have a key (what is observed), ``seq`` (insertion order), ``ts`` (timestamp), ``op`` (Read, Write or
Delete) and ``file_size``. The same expressions serve batch windows and streaming aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIB = 1 << 20
UNKNOWN, BATCH_DELETION, APPEND_ONLY, FREQUENT_WRITES, READ_HEAVY, MIXED = "Unknown", "BatchDeletion", "AppendOnly", "FrequentWrites", "ReadHeavy", "MixedRW"
NONE, LAZY, INCREMENTAL = "none", "lazy", "incremental"


@dataclass(frozen=True)
class WorkloadConfig:
    """Window, samples needed, ring capacity (None: no ring, all of a window counts), and the bounds of the rules."""

    window_seconds: int = 300
    min_samples: int = 10
    capacity: int | None = 10_000
    min_confidence: float = 0.7
    min_mode_seconds: int = 30
    allowed: tuple[str, ...] = (NONE, LAZY, INCREMENTAL)
    large_file: int = 500 * MIB

    def __post_init__(self) -> None:
        if self.window_seconds <= 0 or self.min_samples < 1 or self.capacity is not None and self.capacity < 1 or self.min_mode_seconds < 0 or self.large_file < 0:
            raise ValueError("window, samples, capacity, time and size are positive")
        if not 0 <= self.min_confidence <= 1 or not set(self.allowed) <= {NONE, LAZY, INCREMENTAL}:
            raise ValueError("a confidence from 0 to 1 and known modes are asked for")


DEFAULT = WorkloadConfig()


def ratios(n: Column, deletes: Column, writes: Column, reads: Column) -> dict[str, Column]:
    share = lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))
    return {"delete_ratio": share(deletes), "write_ratio": share(writes), "read_ratio": share(reads)}


def sliding_features(events: DataFrame, key: str = "key", config: WorkloadConfig = DEFAULT) -> DataFrame:
    """At each event, the features of the events of its key within the trailing window (its start included) and the ring's capacity.

    With a ring, events of the same instant count in their insertion order; without one, all of them count at each.
    A trailing window lies in the event's own stretch of the window's length and the one before. So each event is dealt to its stretch
    and to the next one, and stretches are worked on apart: a key with most of the events is many of them. In the next stretch an event
    stands where it leaves the windows. So what a window holds are the events of its stretch up to its end, and those of the stretch
    before that leave after it: running counts from the stretch's end, whatever a window's size.
    """
    micros, length = F.unix_micros(F.col("ts").cast("timestamp")), config.window_seconds * 1_000_000
    stretch = F.floor(F.col("us") / F.lit(length)).cast("long")
    own, next_ = F.struct(stretch.alias("part"), F.lit(True).alias("own"), F.col("us").alias("mark")), F.struct((stretch + 1).alias("part"), F.lit(False).alias("own"), (F.col("us") + length).alias("mark"))
    e = events.withColumn("us", micros).withColumn("at_", F.explode(F.array(own, next_)))
    e = e.withColumns({c: F.col(f"at_.{c}") for c in ("part", "own", "mark")}).drop("at_")
    here = Window.partitionBy(key, "part")
    if config.capacity is None:
        # One order serves all: marks at the event's time or later come first. Those of the same time leave later: they are still inside.
        back = here.orderBy((-F.col("mark")).alias("back"))
        whole, later = back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), back.rangeBetween(Window.unboundedPreceding, -1)
        inside = back.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        counts = {}
        for name, hit in {"n": F.lit(True), "deletes": F.col("op") == "Delete", "writes": F.col("op") == "Write", "reads": F.col("op") == "Read"}.items():
            one = F.coalesce(hit.cast("long"), F.lit(0))
            mine, old = F.when(F.col("own"), one).otherwise(0), F.when(F.col("own"), 0).otherwise(one)
            till = F.sum(mine).over(whole) - F.coalesce(F.sum(mine).over(later), F.lit(0)) + F.sum(old).over(inside)
            counts[name] = F.when(F.col("mark").isNull(), F.sum(mine).over(whole)).otherwise(till)  # those without a time are together
        first_us = F.least(F.min(F.when(F.col("own"), F.col("us"))).over(whole), F.min(F.when(~F.col("own"), F.col("us"))).over(inside))
        j = e.select("*", *[c.alias(n) for n, c in counts.items()], first_us.alias("first_us")).where("own")
        return finish_features(j.select(*events.columns, *counts, "us", "first_us", F.col("file_size").alias("last_size")), config)
    e = e.withColumn("rn", F.row_number().over(here.orderBy("ts", "seq")))
    back = here.orderBy((-F.col("mark")).alias("back")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # The events of the stretch before come first by time; those that have left by then are counted off.
    old, gone = F.sum(F.when(F.col("own"), 0).otherwise(1)), F.col("old") - F.col("left")
    e = e.withColumn("old", old.over(here)).withColumn("left", old.over(back)).withColumn("n", F.least(F.col("rn") - gone, F.lit(config.capacity)))
    running = here.orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for op, name in (("Delete", "d"), ("Write", "w"), ("Read", "r")):
        e = e.withColumn(f"cum_{name}", F.sum((F.col("op") == op).cast("long")).over(running))
    start = e.select(F.col(key).alias("k2"), F.col("part").alias("part2"), F.col("rn").alias("rn2"), *[F.col(f"cum_{c}").alias(f"at_{c}") for c in "dwr"], F.col("us").alias("first_us"), F.col("op").alias("first_op"))
    # Counts of the frame are differences of running counts at its ends: one join on (key, stretch, row number), whatever the frame's size.
    e = e.where("own").withColumn("rn_from", F.col("rn") - F.col("n") + 1)
    j = e.join(start, (e[key].eqNullSafe(start["k2"])) & (e["part"] == start["part2"]) & (e["rn_from"] == start["rn2"]))
    count = lambda c, op: F.col(f"cum_{c}") - F.col(f"at_{c}") + (F.col("first_op") == op).cast("long")
    j = j.select(*[e[c] for c in events.columns], "n", count("d", "Delete").alias("deletes"), count("w", "Write").alias("writes"), count("r", "Read").alias("reads"), "us", "first_us", F.col("file_size").alias("last_size"))
    return finish_features(j, config)


def finish_features(df: DataFrame, config: WorkloadConfig = DEFAULT) -> DataFrame:
    """Ratios, rate and burst of counts n, deletes, writes, reads between first_us and us."""
    n, span = F.col("n"), (F.col("us") - F.col("first_us")) / 1e6
    r = ratios(n, F.col("deletes"), F.col("writes"), F.col("reads"))
    rate = F.when(span > 0, n / span).otherwise(F.lit(0.0))
    burst = (n >= config.min_samples) & (span < config.window_seconds / 5)
    return df.withColumns(r | {"op_rate": rate, "burst": burst}).drop("us", "first_us")


def tumbling_features(events: DataFrame, key: str = "key", config: WorkloadConfig = DEFAULT) -> DataFrame:
    """Features of fixed windows: one partial aggregation by key and window."""
    ts = F.col("ts").cast("timestamp")
    grouped = events.groupBy(key, F.window(ts, f"{config.window_seconds} seconds").alias("win")).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("op") == op).alias(name) for op, name in (("Delete", "deletes"), ("Write", "writes"), ("Read", "reads"))],
        F.max(F.unix_micros(ts)).alias("us"),
        F.min(F.unix_micros(ts)).alias("first_us"),
        F.max_by("file_size", F.struct(ts, "seq")).alias("last_size"),
    )
    return finish_features(grouped.withColumn("window_start", F.col("win.start")).drop("win"), config)


def classify(config: WorkloadConfig = DEFAULT) -> Column:
    """The first rule that holds."""
    d, w, r, burst = (F.col(c) for c in ("delete_ratio", "write_ratio", "read_ratio", "burst"))
    return (
        F.when(F.col("n") < config.min_samples, UNKNOWN)
        .when((d > 0.6) & burst, BATCH_DELETION)
        .when((w > 0.5) & (d < 0.05), APPEND_ONLY)
        .when((w > 0.6) & ~burst, FREQUENT_WRITES)
        .when(r > 0.7, READ_HEAVY)
        .when(d < 0.2, MIXED)
        .otherwise(UNKNOWN)
    )


def rule_mode(workload: Column, size: Column, config: WorkloadConfig = DEFAULT) -> Column:
    by_size = F.when(size > config.large_file, INCREMENTAL).otherwise(LAZY)
    return F.when(workload.isin(BATCH_DELETION, READ_HEAVY), LAZY).when(workload.isin(FREQUENT_WRITES, MIXED), by_size).otherwise(NONE)


def confidence(n: Column, delete_ratio: Column, burst: Column) -> Column:
    base = F.when(n == 0, 0.0).when(n >= 1000, 0.9).when(n >= 100, 0.75).when(n >= 50, 0.65).when(n >= 10, 0.5).otherwise(0.3)
    more = F.when((delete_ratio > 0.6) | (delete_ratio < 0.05), 0.1).otherwise(0.0) + F.when(burst, 0.05).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), base + more), 2))  # sums of hundredths, as these are


def decide(features: DataFrame, config: WorkloadConfig = DEFAULT) -> DataFrame:
    """Class, rule's mode, confidence, and the mode after the safety rules that need no state."""
    out = features.withColumn("workload", classify(config))
    out = out.withColumn("rule_mode", rule_mode(F.col("workload"), F.col("last_size"), config)).withColumn("confidence", confidence(F.col("n"), F.col("delete_ratio"), F.col("burst")))
    safe = (F.col("confidence") >= config.min_confidence) & F.col("rule_mode").isin(*config.allowed)
    return out.withColumn("mode", F.when(safe, F.col("rule_mode")).otherwise(NONE))


def fold_modes(us: Sequence[int], modes: Sequence[str], confidences: Sequence[float], state: tuple[int | None, str] = (None, NONE), config: WorkloadConfig = DEFAULT) -> tuple[list[str], tuple[int | None, str]]:
    """Modes in force after each decision, in time order; state: when a decision was last accepted, and its mode."""
    out = []
    at, current = state
    for t, mode, sure in zip(us, modes, confidences, strict=True):
        if sure < config.min_confidence or mode not in config.allowed:
            out.append(NONE)
            continue
        if at is not None and mode != current and t - at < config.min_mode_seconds * 1_000_000:
            out.append(current)
            continue
        at, current = t, mode
        out.append(mode)
    return out, (at, current)


def hysteresis(decisions: DataFrame, key: str = "key", config: WorkloadConfig = DEFAULT) -> DataFrame:
    """The mode in force at each decision of a key (columns ts, seq, rule_mode, confidence): an ordered fold, key by key.

    A key's decisions come sorted, in batches; the fold's state goes from one batch to the next, so memory is that of a batch.
    """
    kind = decisions.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, (None, NONE)
        for batch in batches:
            modes: list[str] = []
            for k, part in batch.groupby(key, sort=False, dropna=False):  # keys stand together, in the order of the batch
                k = None if pd.isna(k) else k
                if modes or k != at:
                    state = (None, NONE)
                at = k
                own, state = fold_modes(part["us"].tolist(), part["rule_mode"].tolist(), part["confidence"].tolist(), state, config)
                modes += own
            yield pd.DataFrame({key: batch[key], "seq": batch["seq"], "mode": modes})

    rows = decisions.select(key, "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "rule_mode", "confidence")
    return rows.repartition(key).sortWithinPartitions(key, "us", "seq").mapInPandas(fold, f"{key} {kind}, seq bigint, mode string")


def mode_changes(modes: DataFrame, key: str = "key") -> DataFrame:
    """How often the mode of each key changed, counting from none."""
    before = F.coalesce(F.lag("mode").over(Window.partitionBy(key).orderBy("seq")), F.lit(NONE))
    return modes.withColumn("changed", (F.col("mode") != before).cast("long")).groupBy(key).agg(F.sum("changed").alias("mode_changes"), F.count("*").alias("evaluations"))


def size_bucket(size: Column) -> Column:
    return F.when(size < 100 * MIB, "small").when(size < 500 * MIB, "medium").otherwise("large")


def size_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy(size_bucket(F.col("file_size")).alias("bucket")).agg(F.count("*").alias("n"))


def metrics_snapshot(decisions: DataFrame) -> DataFrame:
    """One row of totals over evaluations: counts, confidences, errors, rate; zero where there is nothing to divide."""
    span = (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))) / 1e6
    return decisions.agg(
        F.count("*").alias("evaluations"),
        F.count_if(F.col("mode") == LAZY).alias("lazy"),
        F.count_if(F.col("mode") == INCREMENTAL).alias("incremental"),
        F.count_if(F.col("mode") == NONE).alias("none"),
        F.coalesce(F.min("confidence"), F.lit(0.0)).alias("min_confidence"),
        F.coalesce(F.max("confidence"), F.lit(0.0)).alias("max_confidence"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("avg_confidence"),
        F.round(F.coalesce(F.count("*") / F.nullif(span, F.lit(0.0)), F.lit(0.0)), 6).alias("per_second"),
        F.round(F.coalesce(F.count_if(F.col("workload") == UNKNOWN) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("unknown_rate"),
    )


#: Fixed values: (x, y) corners of the two normalisers; flat beyond the last.
SIZE_CORNERS = [(0, 0.0), (100 * MIB, 0.3), (500 * MIB, 0.6), (1024 * MIB, 0.8), (2048 * MIB, 1.0)]
RATE_CORNERS = [(0, 0.0), (10, 0.3), (100, 0.7), (200, 1.0)]


def piecewise(x: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Linear between corners, flat outside."""
    out = F.lit(float(corners[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(corners, corners[1:]))):
        out = F.when(x < x1, F.lit(float(y0)) + (x - x0) / F.lit(float(x1 - x0)) * F.lit(float(y1 - y0))).otherwise(out)
    return F.when(x <= corners[0][0], F.lit(float(corners[0][1]))).otherwise(out)


def normalised_size(size: Column) -> Column:
    return piecewise(size, SIZE_CORNERS)


def normalised_rate(rate: Column) -> Column:
    return piecewise(rate, RATE_CORNERS)


def lazy_trigger(underflow: Column, total: Column, seconds: Column, threshold: float = 0.05, most_seconds: int = 300) -> Column:
    """Whether batched maintenance is due: a share of nodes underfull, or too long since the last time."""
    check_lazy(threshold, most_seconds)
    return F.coalesce((total > 0) & (underflow / F.nullif(total, F.lit(0)) >= threshold), F.lit(False)) | (seconds >= most_seconds)


def incremental_eta(left: Column, per_session: Column, session_ms: int = 100, interval_ms: int = 5000) -> Column:
    """Milliseconds until all is done, at so many nodes a session."""
    check_incremental(session_ms, interval_ms)
    return F.when(per_session > 0, F.ceil(left / F.nullif(per_session, F.lit(0))) * (session_ms + interval_ms)).otherwise(F.lit(None).cast("long"))


def running_average(evaluations: DataFrame, value: str, key: str = "key") -> DataFrame:
    """The mean of a value over all evaluations of a key so far."""
    so_far = Window.partitionBy(key).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return evaluations.withColumn("average", F.avg(value).over(so_far))


def detector_stats(events: DataFrame, key: str = "key", config: WorkloadConfig = DEFAULT) -> DataFrame:
    """All events of a key, and those within the window that ends at its last one."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = events.groupBy(F.col(key).alias("k2")).agg(F.max(us).alias("end"))
    joined = events.join(ends, events[key].eqNullSafe(ends["k2"]))
    return joined.groupBy(key).agg(F.count("*").alias("total"), F.count_if(us >= F.col("end") - config.window_seconds * 1_000_000).alias("in_window"))


def as_json(metrics: DataFrame) -> DataFrame:
    """Each row of metrics as one JSON text."""
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("json"))


def check_lazy(threshold: float, most_seconds: float, batch: int = 100) -> None:
    """The bounds of a batched configuration, or an error."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is over 0 and at most 1")
    if most_seconds <= 0 or batch < 1:
        raise ValueError("delay and batch size are positive")


def check_incremental(budget_ms: float, interval_ms: float) -> None:
    if budget_ms <= 0 or interval_ms <= 0:
        raise ValueError("budget and interval are positive")
