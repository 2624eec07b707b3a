"""Queries that run the streams over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.plans import corpus
from evidentia.plans.registry import Registry
from evidentia.streaming import jobs

R = Registry()


@R.query("stream_ingest_chunks", corpus.R.sql["build_chunks"])
def stream_ingest_chunks(spark, d):
    made = jobs.run_available(jobs.ingest_chunks(spark, f"{d}/documents.parquet"), "ingest")
    fields = ("section", "line_start", "line_end", "char_start", "char_end", "title")
    return made.select("doc_id", "chunk_id", "text", *[F.col(f"metadata.{c}").alias(c) for c in fields])


_MEMORY = """with e as (select run_id, coalesce(strftime(cast(try_cast(ts as timestamptz) as timestamp), '%Y-%m-%d %H:%M:%S.%f'), '') as seen, coalesce(event, '') as event from log_events where run_id is not null),
n as (select *, row_number() over (partition by run_id order by seen desc, event desc) as age from e)
select run_id, count(*) as n_events, count(*) filter (event = 'error') as n_errors, string_agg(event, '>' order by seen, event) filter (age <= 12) as last_events from n group by 1"""


@R.query("stream_session_memory", _MEMORY)
def stream_session_memory(spark, d):
    """The last state of each run; a run that several batches touched has one row a batch."""
    rows = jobs.run_available(jobs.run_memory(spark, f"{d}/log_events.parquet"), "memory")
    return rows.groupBy("run_id").agg(F.max_by(F.struct("n_events", "n_errors", "last_events"), "n_events").alias("m")).select("run_id", "m.*")


@R.query("stream_event_windows", "select date_trunc('hour', ts) as begins, event_type, count(*) as n, round(sum(value), 4) as value from events where ts is not null group by 1, 2")
def stream_event_windows(spark, d):
    return jobs.window_counts(spark, f"{d}/events.parquet")


_DISTINCT = """with o as (select distinct run_id, epoch_us(try_cast(ts as timestamptz)) as at_us, event, stage, attrs from log_events where run_id is not null and ts is not null)
select run_id, at_us, event, stage, case when json_valid(attrs) then try_cast(attrs ->> '$.latency_ms' as bigint) end as latency_ms from o
"""


@R.query("stream_distinct_events", _DISTINCT)
def stream_distinct_events(spark, d):
    rows = jobs.distinct_events(spark, f"{d}/log_events.parquet")
    return rows.select("run_id", F.unix_micros("at").alias("at_us"), "event", "stage", "latency_ms")
