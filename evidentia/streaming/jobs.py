"""Streams over growing tables: ingest to chunks, memory of runs, counts by time window.

The batch operators do the work; a stream reads what is there, keeps its state
in the checkpoint folder, and stops (`availableNow`) or goes on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.operators import chunking
from evidentia.session import scratch_dir


def read_table(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """A stream of a table's files, each once; new files follow.

    A table may be one file or a folder. A stream takes a single file only by a
    pattern, so the path's last letter is written as one.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Write what is there to a folder of the scratch space, exactly once, and read it back."""
    at = f"{scratch_dir(stream.sparkSession)}/{label}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def run_partials(stream: DataFrame, label: str, partial: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `partial` makes of each batch of what is there, to be put together by the caller; a batch that is done again replaces its rows."""
    spark = stream.sparkSession
    at = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = partial(stream).schema
    spark.createDataFrame([], schema).write.parquet(f"{at}/out/none")  # for a table without files
    write = lambda batch, k: partial(batch).write.mode("overwrite").parquet(f"{at}/out/{k}")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out/*")


def ingest_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of the documents of a table as they arrive."""
    return chunking.build_chunks(read_table(spark, path))


_MEMORY = "run_id string, n_events long, n_errors long, last_events string"


def _remember(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, forget_after: int | None = None) -> Iterator[pd.DataFrame]:
    """Counts of a run and its twelve newest events; the state of a run is these, whatever its length, and ends when no event comes for `forget_after` milliseconds."""
    if state.hasTimedOut:
        state.remove()
        return
    n, errors, newest = state.get if state.exists else (0, 0, [])
    newest = [tuple(x.split("\t", 1)) for x in newest]
    for batch in batches:
        n += len(batch)
        errors += int((batch["event"] == "error").sum())
        newest += list(zip(batch["at"], batch["event"]))
        newest = sorted(newest)[-12:]
    state.update((n, errors, ["\t".join(x) for x in newest]))
    if forget_after is not None:
        state.setTimeoutDuration(forget_after)
    yield pd.DataFrame({"run_id": [key[0]], "n_events": [n], "n_errors": [errors], "last_events": [">".join(x[1] for x in newest)]})


def run_memory(spark: SparkSession, path: str, forget_after: int | None = None, files_a_batch: int = 64) -> DataFrame:
    """For each run, after each batch with events of it: how many rows of events and errors so far (repeated rows count), and the newest twelve.

    With `forget_after` a run that has no event for so many milliseconds is
    forgotten; if it goes on later, it begins anew. This is for streams that go
    on; one that stops when all is read (`run_available`) never ends with it,
    as Spark keeps on looking for runs to forget.
    """
    rows = read_table(spark, path, files_a_batch).where("run_id is not null")
    at = F.coalesce(F.date_format(F.try_to_timestamp("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))
    events = rows.select("run_id", at.alias("at"), F.coalesce("event", F.lit("")).alias("event"))
    remember = lambda key, batches, state: _remember(key, batches, state, forget_after)
    return events.groupBy("run_id").applyInPandasWithState(remember, _MEMORY, "n long, errors long, newest array<string>", "append", GroupStateTimeout.NoTimeout if forget_after is None else GroupStateTimeout.ProcessingTimeTimeout)


def window_counts(spark: SparkSession, path: str, width: str = "1 hour") -> DataFrame:
    """Events by window and type: counts of each batch, summed per window. Every event with a time counts, however late it comes."""
    rows = read_table(spark, path).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    count = lambda batch: batch.groupBy(F.window("ts", width).alias("at"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    counted = run_partials(rows, "windows", count).groupBy("at", "event_type").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("at.start").alias("begins"), "event_type", "n", F.round("value", 4).alias("value"))


def distinct_events(spark: SparkSession, path: str) -> DataFrame:
    """Parsed log events, each once: those of each batch, then once over all batches, however late they come."""
    rows = read_table(spark, path).where("run_id is not null").withColumn("at", F.try_to_timestamp("ts")).where("at is not null")
    once = run_partials(rows.select("run_id", "at", "event", "stage", "attrs"), "distinct", lambda batch: batch.distinct()).distinct()
    return once.select("run_id", "at", "event", "stage", F.try_variant_get(F.try_parse_json("attrs"), "$.latency_ms", "long").alias("latency_ms"))
