"""Fusing ranked runs: reciprocal ranks, the ten features, and a learned logistic score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.lexical import ranked

#: The features of the learned fusion, in the order in which models expect them.
FEATURES = ("bm25_score", "bm25_rank", "bm25_present", "bm25_rrf", "semantic_score", "semantic_rank", "semantic_present", "semantic_rrf", "best_rank", "best_rrf")
#: Fixed value: the rank of what a run doesn't have.
ABSENT_RANK = 9999


def rrf(runs: DataFrame, weights: dict[str, float] | None = None, rrf_k: int = 60, top_k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, fused_score, best_rank, ranks, rrf, pos) of runs (run, query_id, chunk_id, rank).

    Any number of runs is one union and one grouping. An id that a run lists
    twice keeps its first rank. Runs without a weight have weight 1. Order: score,
    best rank, chunk_id.
    """
    weight = F.lit(1.0)
    for run, w in (weights or {}).items():
        weight = F.when(F.col("run") == run, F.lit(float(w))).otherwise(weight)
    first = runs.groupBy("query_id", "chunk_id", "run").agg(F.min("rank").alias("rank")).withColumn("part", weight / (rrf_k + F.col("rank")))
    fused = first.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("part"), 6).alias("fused_score"),
        F.min("rank").alias("best_rank"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("run", "rank")))).alias("ranks"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("run", "part")))).alias("rrf"),
    )
    fused = fused.withColumn("pos", ranked(F.col("fused_score"), "best_rank", "chunk_id"))
    return fused if top_k is None else fused.where(F.col("pos") <= top_k)


def features(lexical: DataFrame, semantic: DataFrame, rrf_k: int = 60) -> DataFrame:
    """(query_id, chunk_id, features) of two runs (query_id, chunk_id, score, rank); a side without the chunk has rank 9999 and zeros."""
    one = lambda df, name: df.groupBy("query_id", "chunk_id").agg(F.min_by("score", "rank").alias(f"{name}_score"), F.min("rank").alias(f"{name}_rank"))
    both = one(lexical, "bm25").join(one(semantic, "semantic"), ["query_id", "chunk_id"], "full_outer")

    def side(name: str) -> dict[str, Column]:
        rank = F.col(f"{name}_rank")
        return {
            f"{name}_score": F.coalesce(F.col(f"{name}_score"), F.lit(0.0)),
            f"{name}_rank": F.coalesce(rank, F.lit(ABSENT_RANK)).cast("double"),
            f"{name}_present": F.when(rank.isNotNull(), 1.0).otherwise(0.0),
            f"{name}_rrf": F.coalesce(1.0 / (rrf_k + rank), F.lit(0.0)),
        }

    made = side("bm25") | side("semantic")
    made["best_rank"] = F.least(made["bm25_rank"], made["semantic_rank"])
    made["best_rrf"] = F.greatest(made["bm25_rrf"], made["semantic_rrf"])
    return both.select("query_id", "chunk_id", *[made[f].alias(f) for f in FEATURES])


def logistic(coefficients: dict[str, float], intercept: float, means: dict[str, float] | None = None, scales: dict[str, float] | None = None) -> Column:
    """The probability of a logistic model of (standardised) features; absent features are 0."""
    z = F.lit(float(intercept))
    for name, w in coefficients.items():
        x = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        z = z + F.lit(float(w)) * (x - F.lit((means or {}).get(name, 0.0))) / F.lit((scales or {}).get(name, 1.0))
    return 1.0 / (1.0 + F.exp(-z))


def lr_rank(scored: DataFrame, top_k: int | None = None) -> DataFrame:
    """Positions by probability (column lf_score), then lexical rank, semantic rank and chunk_id."""
    out = scored.withColumn("pos", ranked(F.col("lf_score"), "bm25_rank", "semantic_rank", "chunk_id"))
    return out if top_k is None else out.where(F.col("pos") <= top_k)
