"""BM25 over exploded words: statistics, idf with a floor, and top-k for many queries in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import text as X
from evidentia.session import cut

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Folders of an index over which its terms are spread.
BUCKETS = 32


def tokenized(chunks: DataFrame) -> DataFrame:
    """(chunk_id, tokens) of chunks with a text; tokens that are there already are taken."""
    if "tokens" in chunks.columns:
        return chunks.select("chunk_id", "tokens")
    return chunks.where("text is not null").select("chunk_id", X.tokenize(F.col("text")).alias("tokens"))


def term_frequency(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term, tf). The count is combined before the shuffle, as a chunk's words are in one row."""
    return tokenized(chunks).select("chunk_id", F.explode("tokens").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def document_frequency(chunks: DataFrame) -> DataFrame:
    """(term, df): distinct words are exploded, so only partial counts are shuffled."""
    return tokenized(chunks).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: (n_chunks, n_tokens, avgdl)."""
    return tokenized(chunks).agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("n_tokens"), F.avg(F.size("tokens")).alias("avgdl"))


def idf(chunks: DataFrame, stats: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(term, df, idf); an idf below zero becomes EPSILON times the mean idf of the vocabulary. Statistics and counts of terms that are there already are taken."""
    stats = (corpus_stats(chunks) if stats is None else stats).select("n_chunks")
    counted = (document_frequency(chunks) if counts is None else counts).crossJoin(F.broadcast(stats))  # one row
    raw = cut(counted.withColumn("raw", F.ln(F.col("n_chunks") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)), "idf")
    mean = raw.agg(F.avg("raw").alias("mean"))
    floored = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", floored.alias("idf"))


def bucket(term: Column) -> Column:
    """The folder of the index that holds a term's postings."""
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def ranked(score: Column, *ties: str, by: tuple[str, ...] = ("query_id",)) -> Column:
    """Positions from 1 by score from high to low, then by the ties."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(score.desc(), *ties))


def bm25(index: dict[str, DataFrame], queries: DataFrame, k: int, fill: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of each query (query_id, query) by an index of postings, terms, lengths and stats.

    Only postings of the queries' words are read: their folders are chosen by the
    words' hashes. A repeated word of a query counts as often. Scores are rounded
    to 6 decimals before ranking; ties are in order of chunk_id. Chunks that share
    no word with the query are left out, or with `fill` follow in order of
    chunk_id with score 0 until there are k. `queries` must be a bounded list, as
    its words are broadcast.
    """
    asked = queries.select("query_id", F.explode(X.tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    weighed = cut(index["terms"].join(F.broadcast(asked), "term").select("query_id", "term", "qn", "idf", bucket(F.col("term")).alias("bucket")), "asked")
    avgdl = index["stats"].first().avgdl or 1.0
    hits = index["postings"].join(F.broadcast(weighed), ["bucket", "term"])
    length = K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl)))
    part = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + length)
    scored = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))
    found = scored.withColumn("rank", ranked(F.col("score"), "chunk_id")).where(F.col("rank") <= k)
    if not fill:
        return found
    # Of the other chunks at most k can follow, and of the first k + k by id at least k weren't found.
    found = cut(found, "found")
    first = index["lengths"].select("chunk_id").orderBy("chunk_id").limit(2 * k)
    others = queries.select("query_id").crossJoin(F.broadcast(first)).join(found, ["query_id", "chunk_id"], "left_anti")  # a bounded list and 2 k rows
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    others = others.join(counts, "query_id", "left").withColumn("rank", ranked(F.lit(0), "chunk_id") + F.coalesce("n", F.lit(0)).cast("int"))
    return found.unionByName(others.where(F.col("rank") <= k).select("query_id", "chunk_id", F.lit(0.0).alias("score"), "rank"))
