"""Readers and writers of text, JSON lines and indexes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import lexical
from evidentia.operators.fusion import FEATURES
from evidentia.operators.learning import FusionModel
from evidentia.session import hadoop_path

CHUNK_SCHEMA = (
    "doc_id string, chunk_id string, text string, metadata struct<title: string, section: string, source_path: string, line_start: int, line_end: int, char_start: int, char_end: int>"
)
EXAMPLE_SCHEMA = (
    "query_id string, query string, target_doc_id string, chunk_id string, doc_id string, label int, features struct<bm25_score: double, bm25_rank: double, bm25_present: double, bm25_rrf: double, "
    "semantic_score: double, semantic_rank: double, semantic_present: double, semantic_rrf: double, best_rank: double, best_rrf: double>, meta struct<title: string, source_path: string, text_preview: string>"
)
INDEX_SCHEMAS = {
    "postings": "term string, chunk_id string, tf long, dl int, bucket int", "terms": "term string, df long, idf double", "lengths": "chunk_id string, dl int", "stats": "n_chunks long, n_tokens long, avgdl double",
}
RUN_SCHEMA = "run_id string, answer string, n_deltas long, n_events long, n_errors long, elapsed_ms long, busy_ms long, path string"
MODEL_SCHEMA = "part string, name string, coefficient double, mean double, scale double"
LOG_SCHEMA = "ts string, run_id string, event string, stage string, attrs string"


def read_markdown(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(source_path, title, text) of all files below a folder; line breaks are unified."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("source_path"), X.unify_breaks(F.col("value")).alias("text"))
    return named.select("source_path", X.basename(F.col("source_path")).alias("title"), "text")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are none, a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query) of a list: from `.jsonl` the first of query, q and text that isn't empty, else each line; stripped, empty ones left out."""
    if path.endswith(".jsonl"):
        rows = spark.read.schema("query string, q string, text string").json(path)
        found = F.coalesce(*[F.nullif(X.strip(F.col(c)), F.lit("")) for c in ("query", "q", "text")])
        return rows.select(found.alias("query")).where("query is not null")
    return spark.read.text(path).select(X.strip(F.col("value")).alias("query")).where("query <> ''")


def write_corpus(chunks: DataFrame, path: str) -> None:
    chunks.select("doc_id", "chunk_id", "text", "metadata").write.mode("overwrite").json(path)


def append_log(events: DataFrame, path: str) -> None:
    """Log events go to a folder of their own, never among the runs."""
    events.write.mode("append").json(path)


def write_split(examples: DataFrame, path: str) -> None:
    examples.write.mode("overwrite").partitionBy("split").parquet(path)


def append_runs(records: DataFrame, path: str) -> None:
    records.select(*[part.split()[0] for part in RUN_SCHEMA.split(", ")]).write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records; log events that were written among them (a record always has n_events, an event never) and rows without a run are none."""
    rows = spark.read.schema(RUN_SCHEMA).option("mode", "FAILFAST").json(path)
    return rows.where("n_events is not null and run_id is not null")


def save_model(spark: SparkSession, model: FusionModel, path: str) -> None:
    """A table of the model's numbers: a row a feature, one for the intercept, and its meta data."""
    rows = [("feature", f, w, model.means[f], model.scales[f]) for f, w in model.coefficients.items()]
    rows += [("intercept", "intercept", model.intercept, None, None), *[("meta", k, float(v), None, None) for k, v in model.meta.items()]]
    spark.createDataFrame(rows, MODEL_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def load_model(spark: SparkSession, path: str) -> FusionModel:
    """A saved model; one of other features than FEATURES, or without an intercept, is an error."""
    if not _written(spark, path):
        raise FileNotFoundError(f"no model at {path}")
    rows = spark.read.schema(MODEL_SCHEMA).option("mode", "FAILFAST").json(path).limit(1000).collect()
    of = {r.name: r for r in rows if r.part == "feature"}
    intercepts = [r.coefficient for r in rows if r.part == "intercept"]
    if set(of) != set(FEATURES) or len(intercepts) != 1:
        raise ValueError(f"{path} isn't a model of the fusion's features")
    each = lambda c: {f: of[f][c] for f in FEATURES}
    return FusionModel(each("coefficient"), intercepts[0], each("mean"), each("scale"), {r.name: r.coefficient for r in rows if r.part == "meta"})


def load_or_build_vectors(rows: DataFrame, at: str, dim: int, metric: str = "cosine") -> dict[str, DataFrame]:
    """The vector index at a place (vectors: the rows with column `v`; config: dim, metric, n_vectors), built only where it isn't there yet. One of another dimension or metric is an error."""
    spark = rows.sparkSession
    vectors = load_or_write(rows, f"{at}/vectors")
    counted = vectors.agg(F.count("*").alias("n_vectors")).select(F.lit(dim).alias("dim"), F.lit(metric).alias("metric"), "n_vectors")
    config = load_or_write(counted, f"{at}/config")
    found = config.first()
    if (found.dim, found.metric) != (dim, metric):
        raise ValueError(f"the index at {at} is of {found.dim} values by {found.metric}")
    return {"vectors": vectors, "config": config}


def fingerprint(df: DataFrame) -> str:
    """A short text that changes with the rows, whatever their order."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{row[0]}:{row[1]}:{df.schema.simpleString()}".encode()).hexdigest()[:16]


def _written(spark: SparkSession, path: str) -> bool:
    files, at = hadoop_path(spark, f"{path}/_SUCCESS")
    return files.exists(at)


def stamp(spark: SparkSession, path: str) -> str:
    """A short text that changes when a file of a table is added, removed or rewritten; no row is read."""
    files, at = hadoop_path(spark, path)
    found, names = files.listFiles(at, True), []
    while found.hasNext():
        one = found.next()
        names.append(f"{one.getPath()}:{one.getLen()}:{one.getModificationTime()}")
    return hashlib.sha256("\n".join([path, *sorted(names)]).encode()).hexdigest()[:16]


def load_or_write(df: DataFrame, at: str, *partitions: str) -> DataFrame:
    """The table at a place, written only where it isn't there yet."""
    spark = df.sparkSession
    if not _written(spark, at):
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partitions).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def load_or_build_index(chunks: DataFrame, folder: str, name: str | None = None) -> dict[str, DataFrame]:
    """The lexical index (postings, terms, lengths, stats) of these chunks, built only where it isn't there yet.

    The folder's name holds a fingerprint of the chunks (or the given `name`, which
    must change with them), so an index never outlives its corpus. Postings lie in
    a folder for each of BUCKETS hashes of their terms and are sorted by term
    within files: a few terms read few folders and row groups.
    """
    spark = chunks.sparkSession
    at = f"{folder}/{name or fingerprint(chunks.select('chunk_id', 'text'))}"
    if _written(spark, f"{at}/terms"):  # the last to be written
        return {part: spark.read.schema(schema).parquet(f"{at}/{part}") for part, schema in INDEX_SCHEMAS.items()}
    tokens = load_or_write(lexical.tokenized(chunks), f"{at}/tokens")
    lengths = load_or_write(tokens.select("chunk_id", F.size("tokens").alias("dl")), f"{at}/lengths")
    words = tokens.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    postings = words.select("term", "chunk_id", "tf", "dl", lexical.bucket(F.col("term")).alias("bucket")).repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term", "chunk_id")
    index = {"lengths": lengths, "postings": load_or_write(postings, f"{at}/postings", "bucket")}
    index["stats"] = load_or_write(lexical.corpus_stats(tokens), f"{at}/stats")
    index["terms"] = load_or_write(lexical.idf(tokens, index["stats"], index["postings"].groupBy("term").agg(F.count("*").alias("df"))), f"{at}/terms")
    return index
