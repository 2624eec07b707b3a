"""The views that several queries read, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.session import scratch_dir
from evidentia.sources import files
from evidentia.sources.tables import table

#: The pattern of white space, for the SQL.
SP = X.SPACE


def _once_per_chunk(rows: DataFrame) -> DataFrame:
    fields = {"doc_id": "doc_id", "text": "text", "section": "metadata.section", "title": "metadata.title", "source_path": "metadata.source_path"}
    once = rows.where("chunk_id is not null").groupBy("chunk_id").agg(*[F.min(path).alias(name) for name, path in fields.items()])
    return once.withColumn("chunk_idx", X.chunk_index(F.col("chunk_id")))


def place(spark: SparkSession, d: str, name: str, label: str) -> str:
    """Where something made of a table is kept, for this state of the table."""
    return f"{scratch_dir(spark)}/{name}-{files.stamp(spark, f'{d}/{name}.parquet')}/{label}"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk_id of the corpus; what one row lacks another may have. Written once for each state of the table."""
    return files.load_or_write(_once_per_chunk(table(spark, d, "corpus_chunks")), place(spark, d, "corpus_chunks", "chunks"))


def index(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The lexical index of the corpus, built once for each state of the table."""
    return files.load_or_build_index(chunks(spark, d), place(spark, d, "corpus_chunks", "lexical"), "index")


CHUNKS = r"""ch as (
  select chunk_id, min(doc_id) as doc_id, min(text) as text, min(metadata.section) as section, min(metadata.title) as title,
         min(metadata.source_path) as source_path, try_cast(nullif(regexp_extract(chunk_id, '::c(\d+)$', 1), '') as integer) as chunk_idx
  from corpus_chunks where chunk_id is not null group by chunk_id)"""


def query_list(spark: SparkSession, d: str) -> DataFrame:
    """The standing queries; their number is fixed."""
    return table(spark, d, "query_list").where("query_id is not null and query is not null")


def sql_tokens(text: str) -> str:
    base = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"
    mixed = rf"list_filter({base}, lambda w: regexp_matches(w, '\p{{L}}') and regexp_matches(w, '\p{{Nd}}'))"
    return rf"list_concat({base}, flatten(list_transform({mixed}, lambda w: regexp_extract_all(w, '\p{{Nd}}+'))))"


def sql_strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{SP}+', ''), '{SP}+$', '')"


def sql_lines(text: str) -> str:
    parts = f"string_split(regexp_replace({text}, '\\r\\n?', chr(10), 'g'), chr(10))"
    return f"case when {parts}[-1] = '' then {parts}[:-2] else {parts} end"
