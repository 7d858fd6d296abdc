"""Workload analytics on streams: the batch expressions over watermarked windows, and the stateful mode."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lattica.operators.workload import DEFAULT, NONE, WorkloadConfig, check_lazy, decide, finish_features, fold_modes

#: Flushes of batched maintenance: when, why (threshold or timeout), and how much was due.
FLUSH_SCHEMA = "key string, us bigint, reason string, underflow bigint, total bigint"
MODE_SCHEMA = "key string, us bigint, rule_mode string, mode string"
_STATE = "us bigint, mode string"


def stream_features(events: DataFrame, config: WorkloadConfig = DEFAULT, slide_seconds: int | None = None, late: str = "10 minutes") -> DataFrame:
    """Features of (sliding) event-time windows; events later than the watermark are dropped."""
    ts = F.col("ts").cast("timestamp")
    e = events.withColumn("ts", ts).withWatermark("ts", late)
    slide = f"{slide_seconds or config.window_seconds} seconds"
    micros = F.unix_micros("ts")
    grouped = e.groupBy("key", F.window("ts", f"{config.window_seconds} seconds", slide).alias("win")).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("op") == op).alias(name) for op, name in (("Delete", "deletes"), ("Write", "writes"), ("Read", "reads"))],
        F.max(micros).alias("us"),
        F.min(micros).alias("first_us"),
        F.max_by("file_size", F.struct("ts", "seq")).alias("last_size"),
    )
    ends = grouped.withColumn("window_end", F.col("win.end")).withColumn("window_start", F.col("win.start")).drop("win")
    return finish_features(ends, config)


def stream_decisions(events: DataFrame, config: WorkloadConfig = DEFAULT, slide_seconds: int | None = None, late: str = "10 minutes") -> DataFrame:
    return decide(stream_features(events, config, slide_seconds, late), config)


def stream_modes(decisions: DataFrame, config: WorkloadConfig = DEFAULT) -> DataFrame:
    """The mode in force after each decision (key, us, rule_mode, confidence), with the last accepted one as state."""

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("us")
        before = state.get if state.exists else (None, NONE)
        before = (None if before[0] is None or before[0] < 0 else before[0], before[1])
        modes, after = fold_modes(rows["us"].tolist(), rows["rule_mode"].tolist(), rows["confidence"].tolist(), before, config)
        state.update((-1 if after[0] is None else after[0], after[1]))
        yield pd.DataFrame({"key": [str(key[0])] * len(rows), "us": rows["us"].tolist(), "rule_mode": rows["rule_mode"].tolist(), "mode": modes})

    return decisions.groupBy("key").applyInPandasWithState(step, MODE_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)


def stream_flushes(changes: DataFrame, threshold: float = 0.05, most_seconds: int = 300, late: str = "0 seconds") -> DataFrame:
    """When batched maintenance of a key runs, from changes (key, ts, underflow, total: what each adds to the nodes underfull and to all).

    A flush is due when the share of underfull nodes reaches the threshold, or when the time since the last flush (the first
    change) has passed by the watermark; the underfull nodes are none after it.
    """
    check_lazy(threshold, most_seconds)
    micros = most_seconds * 1_000_000

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        underflow, total, since = state.get if state.exists else (0, 0, -1)
        out = []
        if state.hasTimedOut:
            if underflow:
                out.append((since + micros, "timeout", underflow, total))
            underflow, since = 0, since + micros
        else:
            for row in pd.concat(list(parts)).sort_values("us").itertuples():
                since = row.us if since < 0 else since
                underflow, total = underflow + int(row.underflow), total + int(row.total)
                late_ = row.us - since >= micros
                if underflow and total and (underflow / total >= threshold or late_):
                    out.append((int(row.us), "timeout" if late_ and underflow / total < threshold else "threshold", underflow, total))
                    underflow, since = 0, int(row.us)
        state.update((underflow, total, since))
        state.setTimeoutTimestamp(max((since + micros) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(str(key[0]), *x) for x in out], columns=["key", "us", "reason", "underflow", "total"])

    rows = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("key").applyInPandasWithState(step, FLUSH_SCHEMA, "underflow bigint, total bigint, since bigint", "append", GroupStateTimeout.EventTimeTimeout)
