"""Late-interaction reranking, head and tail, and relative-score thresholds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from evidentia.functions import text as X
from evidentia.functions import vectors as V
from evidentia.functions.binding import bind

DIM = 16
#: Token vectors that a task keeps.
MOST_KNOWN = 1_000_000


def token_vector(token: Column) -> Column:
    """A unit vector of 16 values made of the token's MD5 bytes: the same in every engine, for use without a model."""
    raw = bind(F.md5(token), lambda h: F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 127.5))
    return bind(raw, lambda r: bind(V.norm(r), lambda n: F.transform(r, lambda x: x / n)))


def _token_vectors(tokens: list[str], known: dict[str, np.ndarray]) -> np.ndarray:
    """`token_vector` for a list of tokens; `known` keeps what is made."""
    if len(known) > MOST_KNOWN:
        known.clear()
    for token in tokens:
        if token not in known:
            raw = np.frombuffer(hashlib.md5(token.encode()).digest(), np.uint8) - 127.5
            known[token] = raw / np.sqrt(raw @ raw)
    return np.array([known[t] for t in tokens]).reshape(-1, DIM)


def maxsim(hits: DataFrame, queries: DataFrame, texts: DataFrame, *, query_tokens: int | None = None, text_tokens: int | None = None) -> DataFrame:
    """hits (query_id, chunk_id, ...) with colbert_score: the sum over query tokens of the best inner product with a token of the text.

    Only the texts of hits are read; the tokens of a hit's query and text are
    multiplied as matrices in Arrow batches. Without tokens on a side, and for a
    hit without query or text, the score is minus infinity. Queries and texts are
    read whole unless a number of first tokens is given; `queries` has a row a
    query_id and `texts` one a chunk_id.
    """
    first = lambda tokens, most: tokens if most is None else F.slice(tokens, 1, most)
    q = queries.select("query_id", first(X.tokenize(F.col("query")), query_tokens).alias("_q"))
    wanted = texts.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    t = wanted.select("chunk_id", F.array_distinct(first(X.tokenize(F.col("text")), text_tokens)).alias("_t"))
    kept = hits.columns

    def score(batches):
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            scores = []
            for asked, tokens in zip(batch.column("_q").to_pylist(), batch.column("_t").to_pylist()):
                scores.append(float((_token_vectors(asked, known) @ _token_vectors(tokens, known).T).max(1).sum()) if asked and tokens else float("-inf"))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(np.round(scores, 6) + 0.0, pa.float64())], [*kept, "colbert_score"])

    schema = StructType([*hits.schema.fields, StructField("colbert_score", DoubleType())])
    return hits.join(q, "query_id", "left").join(t, "chunk_id", "left").select(*kept, "_q", "_t").mapInArrow(score, schema)


def rerank_head(hits: DataFrame, depth: int) -> DataFrame:
    """hits with new_pos: the first `depth` by colbert_score, then fused_score; the others after them, unchanged."""
    head = F.col("pos") <= depth
    order = Window.partitionBy("query_id").orderBy(
        F.when(head, 0).otherwise(1), F.when(head, F.col("colbert_score")).desc_nulls_last(), F.when(head, F.col("fused_score")).desc_nulls_last(), "pos"
    )
    return hits.withColumn("new_pos", F.row_number().over(order))


def pick_score(*columns: str) -> Column:
    """The first score that is there, else minus infinity."""
    return F.coalesce(*[F.col(c) for c in columns], F.lit(float("-inf")))


def score_threshold(hits: DataFrame, score: str = "score", *, ratio: Column | float = 0.65, floor: float = float("-inf"), min_keep: Column | int = 5, max_keep: Column | int = 12) -> DataFrame:
    """hits (query_id, pos, score) that reach the larger of `ratio` times the best score and `floor`.

    Where fewer than `min_keep` do, the first `min_keep` in list order stay
    instead. At most `max_keep` stay if it is above 0.
    """
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    ratio, min_keep, max_keep = as_column(ratio), as_column(min_keep), as_column(max_keep)
    each = Window.partitionBy("query_id")
    passes = hits.withColumn("passes", F.col(score) >= F.greatest(F.max(score).over(each) * ratio, F.lit(floor)))
    counted = passes.withColumn("n_pass", F.count_if("passes").over(each)).withColumn("nth", F.count_if("passes").over(each.orderBy("pos")))
    most = F.when(max_keep > 0, max_keep).otherwise(F.lit(1 << 30))
    keep = F.when(F.col("n_pass") >= min_keep, F.col("passes") & (F.col("nth") <= most)).otherwise(F.col("pos") <= F.least(min_keep, most))
    return counted.where(keep).drop("passes", "n_pass", "nth")
