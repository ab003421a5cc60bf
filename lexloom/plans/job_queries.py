"""Queries on the job log, in batch and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexloom import session
from lexloom.operators import jobs as jb, lexicon as lx
from lexloom.plans.index_queries import _long
from lexloom.plans.registry import query
from lexloom.streaming import compaction as sc, index as si, jobs as sj


def _epoch(name):
    return F.unix_micros(name).alias(name)


DEDUPED = """(SELECT * FROM (SELECT *, lag(stage_code) OVER w ps, lag(progress_percent) OVER w pp FROM ev WINDOW w AS (PARTITION BY job_id ORDER BY created_at, event_id))
   WHERE ps IS NULL OR ps<>stage_code OR pp<>progress_percent)"""


@query("EVT-1", f"SELECT job_id, job_kind, event_id, stage_code, progress_percent::BIGINT progress_percent FROM {DEDUPED}")
def event_dedupe(w):
    return jb.dedupe_events(w.job_events).select("job_id", "job_kind", "event_id", "stage_code", *_long("progress_percent"))


@query("EVT-2", "SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY created_at, event_id) place FROM ev")
def events_in_order(w):
    return jb.events_in_order(w.job_events).select("job_id", "event_id", "place")


@query("EVT-3", "SELECT job_id, status, is_stale, epoch_us(last_progress_at) last_progress_at FROM jbstale")
def stale_jobs(w):
    return jb.with_staleness(w.jobs, w.job_events, w.job_now).select("job_id", "status", "is_stale", _epoch("last_progress_at"))


@query("EVT-4", """SELECT j.job_id, coalesce(r.n,0) auto_retries, j.job_kind IN ('ingestion','reference_import','reference_matching') AND coalesce(r.n,0)<1 may_retry FROM jbstale j
   LEFT JOIN (SELECT retry_of job_id, count(*) n FROM jb WHERE retry_of IS NOT NULL GROUP BY 1) r USING (job_id) WHERE is_stale""")
def stale_sweep(w):
    return jb.sweep(w.jobs, w.job_events, w.job_now).select("job_id", "auto_retries", "may_retry")


@query("EVT-4", """SELECT job_kind, count(*) scanned, count(*) FILTER (is_stale) recovered, count(*) FILTER (is_stale AND job_id IN (SELECT retry_of FROM jb WHERE retry_of IS NOT NULL)) auto_retried
   FROM jbstale WHERE status IN ('queued','running') GROUP BY 1""")
def stale_sweep_summary(w):
    return jb.sweep_summary(w.jobs, w.job_events, w.job_now)


@query("EVT-5", "SELECT job_id, job_kind, status FROM jb ORDER BY created_at DESC, job_id DESC LIMIT 40")
def job_listing(w):
    """One table per kind, listed together."""
    kinds = {k: w.jobs.where(F.col("job_kind") == k).drop("job_kind") for k in jb.KINDS}
    return jb.list_jobs(jb.union_kinds(kinds), 40).select("job_id", "job_kind", "status")


@query("EVT-6", """SELECT owner_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, job_id DESC) k FROM
   (SELECT *, row_number() OVER (PARTITION BY owner_id, job_kind ORDER BY created_at DESC, job_id DESC) z FROM jb WHERE status IN ('queued','running')) WHERE z<=5) WHERE k<=5""")
def active_jobs(w):
    return jb.active_jobs(w.jobs, 5).select("owner_id", "job_id")


@query("EVT-7", "SELECT owner_id, count(*) active_jobs, count(*)<3 has_capacity FROM jb WHERE status IN ('queued','running') GROUP BY 1")
def active_job_counts(w):
    return jb.active_counts(w.jobs)


@query("EVT-7", """SELECT count(*) FILTER (job_kind='ingestion') active_ocr, count(*) FILTER (job_kind='nayiri_trusted_lookup') active_external, count(*) FILTER (job_kind='ingestion')<1 ocr_capacity,
   count(*) FILTER (job_kind='nayiri_trusted_lookup')<1 external_capacity FROM jb WHERE status IN ('queued','running')""")
def capacity_checks(w):
    return jb.global_capacity(w.jobs)


@query("EVT-8", "SELECT document_id, arg_max(job_id, (status IN ('queued','running'), created_at, job_id)) job_id, arg_max(status, (status IN ('queued','running'), created_at, job_id)) status FROM jb GROUP BY 1")
def preferred_jobs(w):
    return jb.preferred_jobs(w.jobs)


SNAP = """SELECT j.job_id, j.status, count(*) events, arg_max(e.stage_code, (e.created_at, e.event_id)) stage_code, arg_max(e.progress_percent, (e.created_at, e.event_id))::BIGINT progress_percent
   FROM jb j JOIN ev e USING (job_id) GROUP BY 1,2"""


@query("EVT-9", SNAP)
def job_snapshots(w):
    return jb.snapshots(w.jobs, w.job_events).select("job_id", "status", "events", "stage_code", *_long("progress_percent"))


@query("EVT-12", """SELECT j.job_id, r.jid latest_retry_job_id, s.jid latest_resume_job_id, greatest(1, items_processed)::BIGINT resume_from_page,
   (j.status='failed' OR (j.status='running' AND j.is_stale)) AND NOT EXISTS (SELECT 1 FROM jb o WHERE o.document_id=j.document_id AND o.owner_id=j.owner_id AND o.job_id<>j.job_id AND o.status IN ('queued','running')) can_resume
   FROM jbstale j LEFT JOIN (SELECT retry_of job_id, arg_max(job_id, (created_at, job_id)) jid FROM jb WHERE retry_of IS NOT NULL GROUP BY 1) r USING (job_id)
   LEFT JOIN (SELECT resume_of job_id, arg_max(job_id, (created_at, job_id)) jid FROM jb WHERE resume_of IS NOT NULL GROUP BY 1) s USING (job_id)""")
def job_lineage(w):
    rows = jb.lineage(w.jobs, jb.with_staleness(w.jobs, w.job_events, w.job_now))
    return rows.select("job_id", "latest_retry_job_id", "latest_resume_job_id", *_long("resume_from_page"), "can_resume")


@query("SCL-23", "SELECT job_id, (20 + floor(62 * least(items_processed/200.0, 1)))::BIGINT progress FROM jb")
def ranged_progress(w):
    from lexloom.functions import text as tx

    p = tx.ranged_progress(F.col("items_processed"), F.lit(200), F.lit(20), F.lit(82))
    return w.jobs.select("job_id", p.cast("bigint").alias("progress"))


# Streams ----------------------------------------------------------------------------


def _stream_folder(w, name):
    return f"{session.shared_dir(w.spark)}/lexloom/{name}-{uuid.uuid4().hex[:12]}"


def _event_stream(w, steps=4, files=4):
    """The event table as a stream that arrives in order of time, a few files per step.

    A stream takes files by age, so the steps are written one after another.
    """
    folder = _stream_folder(w, "events_in")
    at = F.unix_micros("created_at")
    cuts = w.job_events.agg(F.percentile_approx(at, [i / steps for i in range(1, steps)], 10000).alias("c")).first()["c"]
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        part = w.job_events if low is None else w.job_events.where(at > low)
        part = part if high is None else part.where(at <= high)
        part.repartition(files).write.mode("append").parquet(folder)
    return w.spark.readStream.schema(w.job_events.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query("EVT-10 LEX-6 SNK-1", """SELECT owner_id, normalized_form, document_id, occurrence_count, page_count, n_armenian, n_digit_mixed, n_latin, n_mixed, n_other FROM slice""")
def stream_index(w):
    """Index built page by page from a stream; must equal the batch index."""
    pages, table, check = (_stream_folder(w, n) for n in ("pages_in", "page_counts", "pages_cp"))
    w.pages.repartition(8, "document_id").write.parquet(pages)
    stream = w.spark.readStream.schema(w.pages.schema).option("maxFilesPerTrigger", 4).parquet(pages)
    si.start(stream, table, check).awaitTermination()
    return si.slices(si.current_counts(w.spark, table))


@query("EVT-10 LEX-6", """SELECT owner_id, normalized_form, document_id, occurrence_count, page_count, n_armenian, n_digit_mixed, n_latin, n_mixed, n_other FROM slice""")
def stream_index_compacted(w):
    """Index from a stream whose pages all come twice, first with their text reversed; old batches are folded into a base."""
    pages, table, check = (_stream_folder(w, n) for n in ("pages_in", "page_counts", "pages_cp"))
    first = w.pages.withColumn("page_text", F.reverse("page_text"))
    for version in (first, w.pages):  # a restart takes up the files that came since
        version.repartition(6, "document_id").write.mode("append").parquet(pages)
        stream = w.spark.readStream.schema(w.pages.schema).option("maxFilesPerTrigger", 2).parquet(pages)
        sc.start(stream, table, check).awaitTermination()
    return sc.CompactedIndex(w.spark, table).slices()


@query("EVT-1", f"SELECT job_id, job_kind, event_id, stage_code, progress_percent::BIGINT progress_percent FROM {DEDUPED}")
def stream_event_dedupe(w):
    """Duplicate suppression with one small state per job; equals the batch result when files arrive in order."""
    table, check = _stream_folder(w, "events_out"), _stream_folder(w, "events_cp")
    sj.run_to_table(sj.deduped(_event_stream(w)), table, check).awaitTermination()
    return w.spark.read.schema(sj.EVENT_SCHEMA).parquet(table).select("job_id", "job_kind", "event_id", "stage_code", *_long("progress_percent"))


@query("EVT-9", "SELECT job_id, count(*) events, arg_max(stage_code, (created_at, event_id)) stage_code, arg_max(progress_percent, (created_at, event_id))::BIGINT progress_percent FROM ev GROUP BY 1")
def stream_snapshots(w):
    """Live snapshot of every job; the newest batch of a job wins."""
    table, check = _stream_folder(w, "snap_out"), _stream_folder(w, "snap_cp")
    rows = sj.live_snapshots(_event_stream(w))
    sj.run_to_table(rows, table, check, "update").awaitTermination()
    stored = w.spark.read.schema("job_kind string, job_id bigint, events bigint, stage_code string, progress_percent int, batch bigint").parquet(table)
    newest = stored.groupBy("job_id").agg(F.max_by(F.struct("events", "stage_code", "progress_percent"), "batch").alias("s"))
    return newest.select("job_id", F.col("s.events").alias("events"), F.col("s.stage_code").alias("stage_code"), F.col("s.progress_percent").cast("bigint").alias("progress_percent"))


@query("EVT-3", """WITH g AS (SELECT *, coalesce(created_at - lag(created_at) OVER w >= INTERVAL 30 MINUTE, true) fresh FROM ev WINDOW w AS (PARTITION BY job_id ORDER BY created_at, event_id)),
   s AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY job_id ORDER BY created_at, event_id) z FROM g),
   t AS (SELECT job_id, z, max(created_at) m, count(*) n FROM s GROUP BY 1,2)
   SELECT job_id, epoch_us(m) last_progress_at, n events FROM t WHERE m + INTERVAL 30 MINUTE <= (SELECT max(created_at) FROM ev) - INTERVAL 1 MINUTE""")
def stream_staleness(w):
    """Silences of half an hour, found with session windows and a watermark."""
    table, check = _stream_folder(w, "stale_out"), _stream_folder(w, "stale_cp")
    sj.run_to_table(sj.stale_jobs(_event_stream(w), lateness="1 minute"), table, check).awaitTermination()
    rows = w.spark.read.schema("job_kind string, job_id bigint, last_progress_at timestamp, events bigint, stale_at timestamp").parquet(table)
    return rows.select("job_id", _epoch("last_progress_at"), "events")
