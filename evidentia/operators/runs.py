"""Run logs: parsing, folding, windows, encoding; citations, scores and buckets of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import text as X
from evidentia.session import cut


def parse_log(rows: DataFrame) -> DataFrame:
    """(run_id, ts, event, stage, latency_ms, md, n_chunks, attrs_state): distinct events, times in UTC.

    Attributes that don't parse are `broken`, missing ones `missing`; their
    fields are null. Rows without a run are left out.
    """
    once = rows.where("run_id is not null").distinct()
    parsed = once.withColumn("json", F.try_parse_json("attrs"))
    state = F.when(F.col("attrs").isNull(), "missing").when(F.col("json").isNull(), "broken").otherwise("ok")
    get = lambda path, kind: F.try_variant_get("json", path, kind)
    return parsed.select(
        "run_id", F.try_to_timestamp("ts").alias("ts"), "event", "stage", get("$.latency_ms", "long").alias("latency_ms"), get("$.md", "string").alias("md"), get("$.chunks", "long").alias("n_chunks"), state.alias("attrs_state")
    )


ORDER = ("ts", "event", "stage", "latency_ms", "md", "n_chunks", "attrs_state")


def sequenced(events: DataFrame) -> DataFrame:
    """events with seq from 1 within the run, by time and then by all fields; events without a time come last.

    Runs are sorted over range partitions, so a run of any length is spread over
    several: a number is the place in the partition and what earlier ones hold of
    the run.
    """
    order = ["run_id", *[F.asc_nulls_last(c) for c in ORDER]]
    placed = events.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "sequenced")
    parts = placed.groupBy("run_id", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("run_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("run_id", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_start"))
    return placed.join(starts, ["run_id", "_part"]).select(*events.columns, (F.col("_at") + F.col("_start")).cast("int").alias("seq"))


def run_times(events: DataFrame) -> DataFrame:
    """(run_id, n_events, n_errors, elapsed_ms, busy_ms): elapsed between first and last event, busy by the reported latencies."""
    millis = F.unix_millis("ts")
    return events.groupBy("run_id").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("event") == "error").alias("n_errors"), (F.max(millis) - F.min(millis)).alias("elapsed_ms"), F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("busy_ms")
    )


def stage_times(events: DataFrame) -> DataFrame:
    """(stage, event, n, n_timed, mean_ms, least_ms, most_ms)."""
    return events.groupBy(F.coalesce("stage", F.lit("none")).alias("stage"), "event").agg(
        F.count("*").alias("n"), F.count("latency_ms").alias("n_timed"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.min("latency_ms").alias("least_ms"), F.max("latency_ms").alias("most_ms")
    )


def fold(events: DataFrame, stop: str = "answer.end") -> DataFrame:
    """(run_id, n_events, last_event, path): the events of a run up to and including the first `stop`, joined by `>`."""
    numbered = cut(sequenced(events), "numbered")
    stops = numbered.where(F.col("event") == stop).groupBy("run_id").agg(F.min("seq").alias("stop_at"))
    kept = numbered.join(stops, "run_id", "left").where("stop_at is null or seq <= stop_at")
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("event", F.lit("")).alias("event"))))
    return kept.groupBy("run_id").agg(F.count("*").alias("n_events"), F.max_by("event", "seq").alias("last_event"), F.array_join(F.transform(parts, lambda p: p["event"]), ">").alias("path"))


def fold_text(events: DataFrame) -> DataFrame:
    """(run_id, n_deltas, text, last_n_chunks): the texts of a run's events in order as one, and the last number of chunks that an event names."""
    numbered = sequenced(events).where("md is not null or n_chunks is not null")
    parts = F.array_sort(F.collect_list(F.when(F.col("md").isNotNull(), F.struct("seq", "md"))))
    last = F.max_by("n_chunks", F.when(F.col("n_chunks").isNotNull(), F.col("seq")))
    return numbered.groupBy("run_id").agg(F.count("md").alias("n_deltas"), F.array_join(F.transform(parts, lambda p: p["md"]), "").alias("text"), last.alias("last_n_chunks"))


def run_records(events: DataFrame) -> DataFrame:
    """One record a run: its answer (the texts of its events in order), its path up to the answer's end, its counts and times."""
    events = cut(events, "events")
    texts = fold_text(events).select("run_id", F.col("text").alias("answer"), "n_deltas")
    paths = fold(events).select("run_id", "path")
    made = run_times(events).join(texts, "run_id", "left").join(paths, "run_id", "left")
    return made.select("run_id", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("n_deltas", F.lit(0)).alias("n_deltas"), "n_events", "n_errors", "elapsed_ms", "busy_ms", F.coalesce("path", F.lit("")).alias("path"))


def summarized(records: DataFrame, preview: int = 400) -> DataFrame:
    """(run_id, answer_preview, n_events, ok, first_event): what a comparison of runs reads of each record."""
    return records.select("run_id", F.substring("answer", 1, preview).alias("answer_preview"), "n_events", (F.col("n_errors") == 0).alias("ok"), F.substring_index("path", ">", 1).alias("first_event"))


def followed(events: DataFrame) -> DataFrame:
    """(run_id, event, next_event) for every event that another of its run follows."""
    numbered = cut(sequenced(events).select("run_id", "seq", "event"), "numbered")
    after = numbered.select("run_id", (F.col("seq") - 1).alias("seq"), F.col("event").alias("next_event"))
    return numbered.join(after, ["run_id", "seq"]).select("run_id", "event", "next_event")


def last_events(events: DataFrame, n: int = 12) -> DataFrame:
    """The last n events of each run, with seq and numbered from the newest; only they leave their partitions."""
    newest = Window.partitionBy("run_id").orderBy(*[F.desc_nulls_first(c) for c in ORDER])
    sizes = events.groupBy("run_id").agg(F.count("*").alias("_n"))
    last = events.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= n)
    return last.join(sizes, "run_id").withColumn("seq", (F.col("_n") - F.col("age") + 1).cast("int")).drop("_n")


def compact(events: DataFrame, kinds: tuple[str, ...], most: int = 40) -> DataFrame:
    """The first `most` events of the wanted kinds of each run."""
    order = Window.partitionBy("run_id").orderBy(*[F.asc_nulls_last(c) for c in ORDER])
    return events.where(F.col("event").isin(*kinds)).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def sse_encode(kind: Column, payload: Column) -> Column:
    """One server-sent event: kind, data, blank line; an unknown kind is a `message`."""
    return F.concat(F.lit("event: "), F.coalesce(kind, F.lit("message")), F.lit("\ndata: "), payload, F.lit("\n\n"))


def sse_decode(stream: Column) -> Column:
    """The events (type, data) of an encoded stream, in order; blank pieces are none, a piece without a type is a `message`."""
    pieces = F.filter(F.split(stream, "\n\n"), lambda p: F.length(X.strip(p)) > 0)
    kind = lambda p: F.nullif(F.regexp_extract(p, r"(?m)^event: ?(.*)$", 1), F.lit(""))
    return F.transform(pieces, lambda p: F.struct(F.coalesce(kind(p), F.lit("message")).alias("type"), F.regexp_extract(p, r"(?m)^data: ?(.*)$", 1).alias("data")))


def citations_ok(used: Column, available: Column) -> Column:
    """At least one citation, and none that isn't available."""
    return (F.size(used) > 0) & (F.size(F.array_except(used, available)) == 0)


def clamp(x: Column) -> Column:
    """Between 0 and 1; what isn't a number is null, as is null."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


#: What correctness and groundedness count.
WEIGHTS = (0.7, 0.3)


def combined_metric(correctness: Column, groundedness: Column, valid: Column) -> Column:
    """0.7 of correctness and 0.3 of groundedness, both clamped; 0 where citations are invalid or a part is missing."""
    value = WEIGHTS[0] * F.coalesce(clamp(correctness), F.lit(0.0)) + WEIGHTS[1] * F.coalesce(clamp(groundedness), F.lit(0.0))
    return F.when(F.coalesce(valid, F.lit(False)), value).otherwise(F.lit(0.0))


def bucket(metric: Column, low: float = 0.2, high: float = 0.7) -> Column:
    value = F.coalesce(F.when(~F.isnan(metric), metric), F.lit(0.0))
    return F.when(value >= high, "positive").when(value <= low, "negative").otherwise("neutral")
