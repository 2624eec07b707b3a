"""Queries of records: missing keys, fields under other names, last versions, ranges of lines, run records."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import chunking, records, runs
from evidentia.plans.base import sql_lines, sql_strip
from evidentia.plans.logs import _EV, events
from evidentia.plans.registry import Registry
from evidentia.sources.tables import table

R = Registry()

_KEYS = {"fusion_results": ("query_id", "chunk_id", "doc_id"), "lf_examples": ("query_id", "chunk_id", "doc_id"), "corpus_chunks": ("chunk_id", "doc_id"), "chunk_vectors": ("chunk_id", "doc_id")}


@R.query("missing_keys", " union all ".join(f"select '{t}' as of_table, '{k}' as key, count(*) as n_rows, count(*) filter ({k} is null or {k} = '') as n_missing from {t}" for t, keys in _KEYS.items() for k in keys))
def missing_keys(spark, d):
    """How many rows of each table lack a key; one scan a table reads its keys only."""
    out = None
    for name, keys in _KEYS.items():
        missing = [F.struct(F.lit(k).alias("key"), F.count_if(F.col(k).isNull() | (F.col(k) == "")).alias("n_missing")) for k in keys]
        counted = table(spark, d, name).agg(F.count("*").alias("n_rows"), F.array(*missing).alias("k")).select(F.lit(name).alias("of_table"), "n_rows", F.explode("k").alias("k"))
        counted = counted.select("of_table", "k.key", "n_rows", "k.n_missing")
        out = counted if out is None else out.unionByName(counted)
    return out


def _filled(c: str) -> str:
    return f"nullif({sql_strip(c)}, '')"


_GROUP = f"coalesce({_filled('doc_id')}, {_filled('source')}, {_filled('meta.source_path')}, 'UNKNOWN_DOC')"


@R.query("alias_fields", f"""with a as (select coalesce({_filled('chunk_id')}, {_GROUP} || '::#' || md5('')) as uid, {_GROUP} as grp from lf_examples)
    select grp as group_key, count(*) as n_rows, count(distinct uid) as n_records from a group by 1""")
def alias_fields(spark, d):
    """Examples by the field that says what they belong to, under whichever name they carry it."""
    found = records.aliased(table(spark, d, "lf_examples"))
    return found.groupBy(F.col("group").alias("group_key")).agg(F.count("*").alias("n_rows"), F.countDistinct("uid").alias("n_records"))


@R.query("latest_documents", """select source_path, doc_id, lang, cast(length(text) as integer) as n_text from (select *, row_number() over (partition by source_path order by fetched_at desc nulls last, doc_id desc) as nth from documents where source_path is not null) where nth = 1""")
def latest_documents(spark, d):
    """The last fetch of each path."""
    last = records.last_wins(table(spark, d, "documents"), "source_path", ["fetched_at"], "doc_id")
    return last.select("source_path", "doc_id", "lang", F.length("text").alias("n_text"))


@R.query("open_line_ranges", f"""with t as (select doc_id, {sql_lines("text")} as lines from documents where text is not null),
    q as (select doc_id, lines, part, cast(part * len(lines) // 4 + 1 as integer) as line_start, cast(least(greatest(part * len(lines) // 4 + 1, (part + 1) * len(lines) // 4 + 3), len(lines)) as integer) as line_end from t, range(0, 5) r(part)),
    b as (select *, {sql_strip("coalesce(array_to_string(lines[line_start:line_end], chr(10)), '')")} as body from q)
    select doc_id, line_start, line_end, count(*) as n, min(case when length(body) > 4000 then substr(body, 1, 4000) || chr(10) || '...[truncated]' else body end) as content from b group by 1, 2, 3""")
def open_line_ranges(spark, d):
    """Every document in four ranges that overlap by three lines, and a fifth past its end."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("source_path"), "text")
    n = F.size(chunking.X.lines(F.col("text")))
    parts = docs.select("source_path", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("part"))
    asked = parts.select("source_path", F.expr("int(part * n div 4) + 1").alias("line_start"), F.expr("int((part + 1) * n div 4) + 3").alias("line_end"))
    read = chunking.read_lines(docs, asked)
    return read.groupBy(F.col("source_path").cast("long").alias("doc_id"), "line_start", "line_end").agg(F.count("*").alias("n"), F.min("content").alias("content"))


# ---------------------------------------------------------------- run records

_RECORDS = f"""{_EV}, tx as (select run_id, coalesce(string_agg(md, '' order by seq), '') as answer, count(md) as n_deltas from sq group by 1),
pt as (select run_id, string_agg(coalesce(event, ''), '>' order by seq) as path from (select *, min(case when event = 'answer.end' then seq end) over (partition by run_id) as stop_at from sq) where stop_at is null or seq <= stop_at group by 1),
tm as (select run_id, count(*) as n_events, count(*) filter (event = 'error') as n_errors, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 as elapsed_ms, cast(coalesce(sum(latency_ms), 0) as bigint) as busy_ms from ev group by 1),
rc as (select run_id, answer, n_deltas, n_events, n_errors, elapsed_ms, busy_ms, path from tm join tx using (run_id) join pt using (run_id))"""


@R.query("run_records", f"with {_RECORDS} select * from rc")
def run_records(spark, d):
    """One record a run, as they are appended to a file of runs."""
    return runs.run_records(events(spark, d))


@R.query("run_summary", f"with {_RECORDS} select run_id, substr(answer, 1, 400) as answer_preview, n_events, n_errors = 0 as ok, split_part(path, '>', 1) as first_event from rc")
def run_summary(spark, d):
    return runs.summarized(runs.run_records(events(spark, d)))
