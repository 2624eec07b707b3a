"""Queries of run logs and of scored, cited and listed records."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import context, runs
from evidentia.plans import search
from evidentia.plans.base import SP
from evidentia.plans.registry import Registry
from evidentia.sources.tables import table

R = Registry()

_EV = """lg as (select distinct * from log_events where run_id is not null),
ev as (select run_id, cast(try_cast(ts as timestamptz) as timestamp) as ts, event, stage, case when json_valid(attrs) then try_cast(attrs ->> '$.latency_ms' as bigint) end as latency_ms,
       case when json_valid(attrs) then attrs ->> '$.md' end as md, case when json_valid(attrs) then try_cast(attrs ->> '$.chunks' as bigint) end as n_chunks,
       case when attrs is null then 'missing' when json_valid(attrs) then 'ok' else 'broken' end as attrs_state from lg),
sq as (select *, cast(row_number() over (partition by run_id order by ts nulls last, event nulls last, stage nulls last, latency_ms nulls last, md nulls last, n_chunks nulls last, attrs_state) as integer) as seq from ev)"""


def events(spark, d):
    return runs.parse_log(table(spark, d, "log_events"))


@R.query("log_parse", f"with {_EV} select run_id, epoch_us(ts) as ts_us, event, stage, latency_ms, md, n_chunks, attrs_state from ev")
def log_parse(spark, d):
    return events(spark, d).select("run_id", F.unix_micros("ts").alias("ts_us"), "event", "stage", "latency_ms", "md", "n_chunks", "attrs_state")


@R.query("run_latency", f"with {_EV} select run_id, count(*) as n_events, count(*) filter (event = 'error') as n_errors, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 as elapsed_ms, cast(coalesce(sum(latency_ms), 0) as bigint) as busy_ms from ev group by 1")
def run_latency(spark, d):
    return runs.run_times(events(spark, d))


@R.query("stage_latency", f"with {_EV} select coalesce(stage, 'none') as stage, event, count(*) as n, count(latency_ms) as n_timed, round(avg(latency_ms), 6) as mean_ms, min(latency_ms) as least_ms, max(latency_ms) as most_ms from ev group by 1, 2")
def stage_latency(spark, d):
    return runs.stage_times(events(spark, d))


@R.query("fold_event_stream", f"""with {_EV}, st as (select *, min(case when event = 'answer.end' then seq end) over (partition by run_id) as stop_at from sq)
    select run_id, count(*) as n_events, arg_max(event, seq) as last_event, string_agg(coalesce(event, ''), '>' order by seq) as path from st where stop_at is null or seq <= stop_at group by 1""")
def fold_event_stream(spark, d):
    return runs.fold(events(spark, d))


@R.query("memory_window", f"with {_EV}, ag as (select *, row_number() over (partition by run_id order by seq desc) as age from sq) select run_id, seq, cast(age as integer) as age, event, latency_ms from ag where age <= 12")
def memory_window(spark, d):
    return runs.last_events(events(spark, d)).select("run_id", "seq", "age", "event", "latency_ms")


_KINDS = ("retrieve.start", "retrieve.end", "fusion.lr", "rerank.end", "answer.end", "error")


@R.query("trace_compact", f"with {_EV}, k as (select *, row_number() over (partition by run_id order by seq) as nth from sq where event in {_KINDS}) select run_id, cast(nth as integer) as nth, event, stage, latency_ms from k where nth <= 40")
def trace_compact(spark, d):
    return runs.compact(events(spark, d), _KINDS).select("run_id", "nth", "event", "stage", "latency_ms")


@R.query("trace_pairs", f"""with {_EV}, n as (select run_id, event, lead(event) over (partition by run_id order by seq) as next_event from sq) select event, next_event, count(*) as n from n where next_event is not null group by 1, 2""")
def trace_pairs(spark, d):
    """How often one event follows another within a run."""
    return runs.followed(events(spark, d)).where("next_event is not null").groupBy("event", "next_event").agg(F.count("*").alias("n"))


@R.query("fold_deltas", f"""with {_EV} select run_id, count(md) as n_deltas, coalesce(string_agg(md, '' order by seq), '') as text, arg_max(n_chunks, seq) filter (n_chunks is not null) as last_n_chunks from sq
    where md is not null or n_chunks is not null group by 1""")
def fold_deltas(spark, d):
    """The text that a run's events carry, put together in order."""
    return runs.fold_text(events(spark, d))


@R.query("sse_encode", f"""with {_EV} select run_id, seq, 'event: ' || coalesce(event, 'message') || chr(10) || 'data: ' || coalesce('{{"latency_ms":' || latency_ms || '}}', '{{}}') || chr(10) || chr(10) as message from sq""")
def sse_encode(spark, d):
    payload = F.to_json(F.struct("latency_ms"))
    return runs.sequenced(events(spark, d)).select("run_id", "seq", runs.sse_encode(F.col("event"), payload).alias("message"))


@R.query("sse_decode", f"""with {_EV} select run_id, seq, coalesce(event, 'message') as type, latency_ms from sq""")
def sse_decode(spark, d):
    """The encoded stream read again: equal to the events."""
    decoded = sse_encode(spark, d).select("run_id", "seq", F.explode(runs.sse_decode(F.col("message"))).alias("e"))
    return decoded.select("run_id", "seq", F.col("e.type"), F.try_variant_get(F.try_parse_json("e.data"), "$.latency_ms", "long").alias("latency_ms"))


@R.query("parse_llm_json", """with a as (select distinct attrs from log_events where attrs is not null), w as (select attrs, '```json' || chr(10) || attrs || chr(10) || '```' as fenced, 'The answer is ' || attrs || ' as asked.' as framed from a)
    select attrs, json_valid(attrs) as parsed, case when json_valid(attrs) then try_cast(attrs ->> '$.latency_ms' as bigint) end as fenced_ms, case when json_valid(attrs) then try_cast(attrs ->> '$.latency_ms' as bigint) end as framed_ms from w""")
def parse_llm_json(spark, d):
    """Logged attributes as a model might write them: bare, fenced, and within a sentence."""
    attrs = table(spark, d, "log_events").where("attrs is not null").select("attrs").distinct()
    fenced = X.tolerant_json(F.concat(F.lit("```json\n"), "attrs", F.lit("\n```")))
    framed = X.tolerant_json(F.concat(F.lit("The answer is "), "attrs", F.lit(" as asked.")))
    ms = lambda j: F.get_json_object(j, "$.latency_ms").cast("long")
    return attrs.select("attrs", X.tolerant_json(F.col("attrs")).isNotNull().alias("parsed"), ms(fenced).alias("fenced_ms"), ms(framed).alias("framed_ms"))


# ---------------------------------------------------------------- citations, scores, buckets

_CITED = f"""{search._BLOCKS}, an as (select query_id, string_agg('[' || pos || ']', ' ' order by pos) as answer from hh where pos <= 6 group by 1),
ct as (select query_id, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d{{1,3}})\\]', 1), lambda x: cast(x as integer)))) as used,
       list_sort(list_distinct(list_transform(regexp_extract_all(context, '(?m)^\\[(\\d{{1,3}})\\]\\s', 1), lambda x: cast(x as integer)))) as available from an join cx using (query_id))"""


def _cited(spark, d):
    """Answers that cite their first hits by position, against the blocks of their contexts."""
    cited = F.array_sort(F.collect_list(F.struct("pos")))
    hits = search._hits(spark, d)
    answers = hits.where("pos <= 6").groupBy("query_id").agg(F.array_join(F.transform(cited, lambda p: F.concat(F.lit("["), p["pos"].cast("string"), F.lit("]"))), " ").alias("answer"))
    both = answers.join(search.contexts(spark, d, hits), "query_id")
    return both.select("query_id", X.numbers(F.col("answer"), X.CITATION).alias("used"), X.numbers(F.col("context"), X.BLOCK).alias("available"))


@R.query("extract_citations", f"with {_CITED} select query_id, array_to_string(used, ',') as used, array_to_string(available, ',') as available from ct")
def extract_citations(spark, d):
    return _cited(spark, d).select("query_id", F.array_join("used", ",").alias("used"), F.array_join("available", ",").alias("available"))


@R.query("citations_ok", f"with {_CITED} select query_id, len(used) > 0 and len(list_filter(used, lambda x: not list_contains(available, x))) = 0 as ok from ct")
def citations_ok(spark, d):
    return _cited(spark, d).select("query_id", runs.citations_ok(F.col("used"), F.col("available")).alias("ok"))


_METRIC = """me as (select query_id, chunk_id, case when payload.bm25_rank is not null or payload.semantic_rank is not null then
    0.7 * coalesce(case when not isnan(score) then greatest(0, least(1, score)) end, 0) + 0.3 * case when payload.semantic_rank is null then 0 else greatest(0, least(1, 1.0 / payload.semantic_rank)) end else 0.0 end as metric from fusion_results where query_id is not null)"""


def metrics(spark, d):
    """A metric for each recorded result: its score as correctness, the reciprocal semantic rank as groundedness, no rank at all as invalid."""
    rows = table(spark, d, "fusion_results").where("query_id is not null")
    valid = F.col("payload.bm25_rank").isNotNull() | F.col("payload.semantic_rank").isNotNull()
    return rows.select("query_id", "chunk_id", runs.combined_metric(F.col("score"), F.try_divide(F.lit(1.0), F.col("payload.semantic_rank")), valid).alias("metric"))


@R.query("combine_metrics", f"with {_METRIC} select query_id, count(*) as n, round(sum(metric), 4) as total_metric, round(max(metric), 4) as best_metric from me group by 1")
def combine_metrics(spark, d):
    return metrics(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("metric"), 4).alias("total_metric"), F.round(F.max("metric"), 4).alias("best_metric"))


_BUCKET = "case when round(metric, 6) >= 0.7 then 'positive' when round(metric, 6) <= 0.2 then 'negative' else 'neutral' end"


@R.query("bucket_runs", f"with {_METRIC} select query_id, {_BUCKET} as bucket, count(*) as n from me group by 1, 2")
def bucket_runs(spark, d):
    return metrics(spark, d).groupBy("query_id", runs.bucket(F.round("metric", 6)).alias("bucket")).agg(F.count("*").alias("n"))


@R.query("run_bucket_counts", f"with {_METRIC}, b as (select {_BUCKET} as bucket from me) select count(*) filter (bucket = 'positive') as positive, count(*) filter (bucket = 'neutral') as neutral, count(*) filter (bucket = 'negative') as negative from b")
def run_bucket_counts(spark, d):
    bucket = runs.bucket(F.round("metric", 6))
    return metrics(spark, d).agg(*[F.count_if(bucket == b).alias(b) for b in ("positive", "neutral", "negative")])


# ---------------------------------------------------------------- lists of queries


@R.query("chat_titles", rf"""with q as (select distinct query_id, query from lf_examples where query_id is not null and query is not null), t as (select query_id, trim(regexp_replace(query, '{SP}+', ' ', 'g')) as t from q)
    select query_id, case when length(t) > 30 then substr(t, 1, 30) || '…' else t end as title from t""")
def chat_titles(spark, d):
    rows = table(spark, d, "lf_examples").where("query_id is not null and query is not null").select("query_id", "query").distinct()
    return rows.select("query_id", X.shorten(X.one_line(F.col("query")), 30, "…").alias("title"))


@R.query("chat_search", "select query_id, query, count(*) as n_rows from lf_examples where contains(lower(query), 'exam') group by all")
def chat_search(spark, d):
    return table(spark, d, "lf_examples").where(F.contains(F.lower("query"), F.lit("exam"))).groupBy("query_id", "query").agg(F.count("*").alias("n_rows"))


@R.query("render_prompt", f"with q as (select distinct query_id, query, target_doc_id from lf_examples where query_id is not null and query is not null) select query_id, 'Answer the question from the context and cite its blocks as [n]. Say so if the context has no answer.' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(target_doc_id, '') || chr(10) || chr(10) || 'Question: ' || query || chr(10) || 'Answer:' as prompt from q")
def render_prompt(spark, d):
    asked = table(spark, d, "lf_examples").where("query_id is not null and query is not null").select("query_id", "query", "target_doc_id").distinct()
    return asked.select("query_id", context.prompt(F.col("target_doc_id"), F.col("query")).alias("prompt"))
