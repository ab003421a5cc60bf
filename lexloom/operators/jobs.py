"""Job and event log in batch (EVT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KINDS = ("ingestion", "reference_import", "reference_matching", "morphology", "nayiri_trusted_lookup", "discovery_build")
ACTIVE = ("queued", "running")
JOB_KEY = ["job_kind", "job_id"]
STALE_MINUTES = 30
AUTO_RETRY_LIMIT = 1
MAX_ACTIVE_PER_USER, MAX_ACTIVE_OCR, MAX_ACTIVE_EXTERNAL = 3, 1, 1
EVENT_VALUES = ("stage_code", "progress_percent")


def kind_of(job_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), (job_id % len(KINDS) + 1).cast("int"))


def with_hour(events: DataFrame) -> DataFrame:
    return events.withColumn("hour", F.date_trunc("hour", F.col("created_at")))


def dedupe_events(events: DataFrame, values: tuple[str, ...] = EVENT_VALUES) -> DataFrame:
    """EVT-1: drop an event that equals the one before it in the same job.

    One job may hold a large part of the log, so rows are compared inside hours;
    only the last event of each hour is carried over to the next one.
    """
    rows = with_hour(events)
    value = F.struct(*values)
    order = F.struct("created_at", "event_id")
    tails = rows.groupBy(*JOB_KEY, "hour").agg(F.max_by(value, order).alias("tail"))
    carried = tails.withColumn("carried", F.lag("tail").over(Window.partitionBy(*JOB_KEY).orderBy("hour"))).drop("tail")
    inside = Window.partitionBy(*JOB_KEY, "hour").orderBy("created_at", "event_id")
    marked = rows.withColumn("before", F.lag(value).over(inside)).join(carried, [*JOB_KEY, "hour"])
    before = F.coalesce("before", "carried")
    return marked.where(before.isNull() | ~before.eqNullSafe(value)).drop("before", "carried", "hour")


def numbered(rows: DataFrame, key: list[str], part: str, order: list[str], name: str) -> DataFrame:
    """Position of each row in its group, counted inside parts first.

    Parts (hours, pages) keep a hot group from being sorted in one task; the
    sizes of the parts before give the offset.
    """
    sizes = rows.groupBy(*key, part).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*key, part).orderBy(*order))
    return rows.withColumn("_place", place).join(offsets, [*key, part]).withColumn(
        name, (F.col("_place") + F.col("_before")).cast("bigint")
    ).drop("_place", "_before")


def events_in_order(events: DataFrame) -> DataFrame:
    """EVT-2: events of every job with their place."""
    return numbered(with_hour(events), JOB_KEY, "hour", ["created_at", "event_id"], "place").drop("hour")


def last_progress(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """EVT-3: newest of the job's update and its last event, else its creation."""
    last = events.groupBy(*JOB_KEY).agg(F.max("created_at").alias("last_event_at"))
    return jobs.join(last, JOB_KEY, "left").withColumn(
        "last_progress_at", F.coalesce(F.greatest("updated_at", "last_event_at"), F.col("created_at"))
    )


def with_staleness(jobs: DataFrame, events: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """EVT-3: an active job without progress for half an hour is stale."""
    quiet = F.col("last_progress_at") + F.make_interval(mins=F.lit(minutes)) <= now
    return last_progress(jobs, events).withColumn("is_stale", F.col("status").isin(*ACTIVE) & quiet)


def sweep(jobs: DataFrame, events: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """EVT-4: stale active jobs with the retries they had and whether one more is allowed."""
    active = with_staleness(jobs, events, now).where(F.col("status").isin(*ACTIVE))
    if limit is not None:
        active = active.orderBy(F.asc_nulls_first("updated_at"), "job_id").limit(limit)
    retries = jobs.where(F.col("retry_of_job_id").isNotNull()).groupBy(F.col("retry_of_job_id").alias("job_id")).agg(F.count("*").alias("retries"))
    n = F.coalesce("retries", F.lit(0).cast("bigint"))
    retriable = F.col("job_kind").isin("ingestion", "reference_import", "reference_matching")
    return active.where("is_stale").join(retries, "job_id", "left").withColumns({
        "auto_retries": n, "may_retry": retriable & (n < AUTO_RETRY_LIMIT),
    }).drop("retries")


def sweep_summary(jobs: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """EVT-4: scanned, recovered and retried jobs per kind."""
    stale = sweep(jobs, events, now).select(*JOB_KEY, "auto_retries").withColumn("_s", F.lit(True))
    return jobs.where(F.col("status").isin(*ACTIVE)).join(stale, JOB_KEY, "left").groupBy("job_kind").agg(
        F.count("*").alias("scanned"), F.count_if(F.col("_s").isNotNull()).alias("recovered"), F.count_if(F.col("auto_retries") > 0).alias("auto_retried")
    )


def union_kinds(tables: dict[str, DataFrame]) -> DataFrame:
    """EVT-5: one job table out of one per kind."""
    out = None
    for kind, rows in tables.items():
        part = rows.withColumn("job_kind", F.lit(kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def list_jobs(jobs: DataFrame, limit: int, offset: int = 0, kind: str | None = None, status: str | None = None, owner_id: str | None = None) -> DataFrame:
    """EVT-5: newest first."""
    out = jobs
    for column, value in (("job_kind", kind), ("status", status), ("owner_id", owner_id)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy(F.desc("created_at"), F.desc("job_id")).offset(offset).limit(limit)


def active_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """EVT-6: newest active jobs per owner, first per kind and then over all kinds."""
    active = jobs.where(F.col("status").isin(*ACTIVE))
    newest = [F.desc("created_at"), F.desc("job_id")]
    per_kind = active.withColumn("_k", F.row_number().over(Window.partitionBy("owner_id", "job_kind").orderBy(*newest))).where(F.col("_k") <= limit)
    return per_kind.withColumn("_k", F.row_number().over(Window.partitionBy("owner_id").orderBy(*newest))).where(F.col("_k") <= limit).drop("_k")


def active_counts(jobs: DataFrame) -> DataFrame:
    """EVT-7: active jobs per owner and whether another may start."""
    active = jobs.where(F.col("status").isin(*ACTIVE)).groupBy("owner_id").agg(F.count("*").alias("active_jobs"))
    return active.withColumn("has_capacity", F.col("active_jobs") < MAX_ACTIVE_PER_USER)


def global_capacity(jobs: DataFrame) -> DataFrame:
    """EVT-7: room for page recognition and for external lookups."""
    active = F.col("status").isin(*ACTIVE)
    return jobs.agg(
        F.count_if(active & (F.col("job_kind") == "ingestion")).alias("active_ocr"),
        F.count_if(active & (F.col("job_kind") == "nayiri_trusted_lookup")).alias("active_external"),
    ).select(
        "active_ocr", "active_external", (F.col("active_ocr") < MAX_ACTIVE_OCR).alias("ocr_capacity"),
        (F.col("active_external") < MAX_ACTIVE_EXTERNAL).alias("external_capacity"),
    )


def preferred_jobs(jobs: DataFrame) -> DataFrame:
    """EVT-8: a document's active job, else its newest."""
    order = F.struct(F.col("status").isin(*ACTIVE).alias("a"), "created_at", "job_id")
    return jobs.groupBy("document_id").agg(F.max_by(F.struct("job_id", "status"), order).alias("j")).select(
        "document_id", F.col("j.job_id").alias("job_id"), F.col("j.status").alias("status")
    )


def snapshots(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """EVT-9 in batch: last stage, progress and number of events per job."""
    last = events.groupBy(*JOB_KEY).agg(
        F.count("*").alias("events"), F.max_by(F.struct("stage_code", "progress_percent"), F.struct("created_at", "event_id")).alias("e")
    )
    return jobs.join(last, JOB_KEY, "left").select(
        *JOB_KEY, "status", F.coalesce("events", F.lit(0).cast("bigint")).alias("events"), F.col("e.stage_code").alias("stage_code"), F.col("e.progress_percent").alias("progress_percent")
    )


def lineage(jobs: DataFrame, stale: DataFrame) -> DataFrame:
    """EVT-12: latest retry and resume of every job, and the page a resume would start from.

    ``stale``: job key and is_stale.
    """
    def latest(column: str, name: str) -> DataFrame:
        order = F.struct("created_at", "job_id")
        return jobs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("job_id")).agg(
            F.max_by("job_id", order).alias(f"latest_{name}_job_id"), F.max_by("status", order).alias(f"latest_{name}_status")
        )

    busy = jobs.where(F.col("status").isin(*ACTIVE)).groupBy("document_id", "owner_id").agg(F.count("*").alias("_busy"))
    page = F.when(F.col("items_processed") >= 1, F.greatest(F.lit(1), F.col("items_processed")))
    others = F.coalesce("_busy", F.lit(0)) - F.when(F.col("status").isin(*ACTIVE), 1).otherwise(0)
    ready = (F.col("status") == "failed") | ((F.col("status") == "running") & F.coalesce("is_stale", F.lit(False)))
    return (
        jobs.join(latest("retry_of_job_id", "retry"), "job_id", "left").join(latest("resume_of_job_id", "resume"), "job_id", "left")
        .join(stale.select(*JOB_KEY, "is_stale"), JOB_KEY, "left").join(busy, ["document_id", "owner_id"], "left")
        .withColumn("can_resume", page.isNotNull() & ready & (others == 0))
        .withColumn("resume_from_page", page)
        .drop("_busy")
    )
