"""Job events as a stream (EVT-1, EVT-3, EVT-9)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.operators.jobs import JOB_KEY, STALE_MINUTES

EVENT_SCHEMA = "job_kind string, job_id bigint, event_id bigint, created_at timestamp, stage_code string, progress_percent int"
STALE_SCHEMA = "job_kind string, job_id bigint, last_progress_at timestamp"


def deduped(events: DataFrame) -> DataFrame:
    """EVT-1: keep an event only if it differs from the previous one of its job.

    The state of a job is its last event; a micro-batch is sorted in the task
    before it is compared.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["created_at", "event_id"])
        # Compare every row with the one above it, the first one with the state.
        same = (rows["stage_code"].shift() == rows["stage_code"]) & (rows["progress_percent"].shift() == rows["progress_percent"])
        if last is not None:
            same.iloc[0] = last == (rows["stage_code"].iloc[0], int(rows["progress_percent"].iloc[0]))
        state.update((rows["stage_code"].iloc[-1], int(rows["progress_percent"].iloc[-1])))
        yield rows[~same][[c.split()[0] for c in EVENT_SCHEMA.split(", ")]]

    return events.groupBy(*JOB_KEY).applyInPandasWithState(
        step, EVENT_SCHEMA, "stage_code string, progress_percent int", "append", GroupStateTimeout.NoTimeout
    )


def stale_jobs(events: DataFrame, minutes: int = STALE_MINUTES, lateness: str = "1 day") -> DataFrame:
    """EVT-3: a row for every silence of half an hour after a job's last event, in event time.

    Events up to ``lateness`` behind the newest one still count; a silence is reported when
    that much event time has passed after it.  Later events are dropped by the watermark.
    """
    quiet = F.session_window("created_at", f"{minutes} minutes")
    return (
        events.withWatermark("created_at", lateness).groupBy(*JOB_KEY, quiet.alias("busy"))
        .agg(F.max("created_at").alias("last_progress_at"), F.count("*").alias("events"))
        .select(*JOB_KEY, "last_progress_at", "events", F.col("busy.end").alias("stale_at"))
    )


def live_snapshots(events: DataFrame) -> DataFrame:
    """EVT-9: newest stage, progress and event count per job, for update mode."""
    order = F.struct("created_at", "event_id")
    return events.groupBy(*JOB_KEY).agg(
        F.count("*").alias("events"), F.max_by("stage_code", order).alias("stage_code"), F.max_by("progress_percent", order).alias("progress_percent")
    )


def run_to_table(rows: DataFrame, table: str, checkpoint: str, mode: str = "append"):
    """Run a stream over what has arrived and keep its rows as parquet."""
    if mode == "append":
        return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
