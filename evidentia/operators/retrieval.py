"""Hybrid search with retrievers as parameters, fused by ranks or by a trained model."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import dense, encode, fusion, learning, lexical
from evidentia.operators.records import required
from evidentia.session import cut

#: Queries (query_id, query) and k give (query_id, chunk_id, score, rank).
Retriever = Callable[[DataFrame, int], DataFrame]


def by_words(index: dict[str, DataFrame]) -> Retriever:
    return lambda queries, k: lexical.bm25(index, queries, k)


def by_vectors(items: DataFrame, encoder: encode.Encoder | None = None) -> Retriever:
    """Nearest of items (chunk_id, v) to the vectors of the queries' texts; a chunk stands where its best vector does."""
    encoder = encoder or encode.HashEncoder()

    def retrieve(queries: DataFrame, k: int) -> DataFrame:
        asked = encode.encode(queries, "query_id", "query", encoder).withColumnRenamed("query_id", "id")
        rows = items.select(encode.item_id(F.col("chunk_id")).alias("id"), "v", F.col("chunk_id").alias("label"))
        near = dense.knn(rows, asked, k, dim=encoder.dim, bounded=True)
        return near.select(F.col("query").alias("query_id"), F.col("label").alias("chunk_id"), "score", "rank")

    return retrieve


def runs_of(queries: DataFrame, retrievers: dict[str, Retriever], k: int = 20) -> DataFrame:
    """(run, query_id, chunk_id, score, rank) of all retrievers. A hit without a chunk_id is an error."""
    out = None
    for name, retrieve in retrievers.items():
        run = retrieve(queries, k).select(F.lit(name).alias("run"), "query_id", "chunk_id", F.col("score").cast("double").alias("score"), "rank")
        out = run if out is None else out.unionByName(run)
    if out is None:
        raise ValueError("a search needs a retriever")
    return required(out, "chunk_id")


def fuse(runs: DataFrame, mode: str = "rrf", *, model: learning.FusionModel | Callable[[], learning.FusionModel] | None = None, weights: dict[str, float] | None = None, top_k: int = 20) -> DataFrame:
    """(query_id, chunk_id, fused_score, ranks, fusion, pos) of runs.

    With `mode` "lr" the runs `bm25` and `semantic` are ranked by a trained model,
    given as such or as what loads it. Where there is none, or loading fails,
    reciprocal ranks take its place, with a warning. Another mode is "rrf".
    """
    if (mode or "rrf").strip().lower() == "lr":
        try:
            model = model() if callable(model) else model
            if model is None:
                raise ValueError("no model")
        except Exception as error:  # whatever a loader raises, the search goes on
            warnings.warn(f"fusing by ranks, as the model can't be loaded: {error}", RuntimeWarning, stacklevel=2)
        else:
            side = lambda run: runs.where(F.col("run") == run).select("query_id", "chunk_id", "score", "rank")
            made = fusion.features(side("bm25"), side("semantic")).withColumn("lf_score", F.round(model.probability(), 6))
            ranks = F.create_map(*[x for run in ("bm25", "semantic") for x in (F.lit(run), F.col(f"{run}_rank").cast("int"))])
            return fusion.lr_rank(made, top_k).select("query_id", "chunk_id", F.col("lf_score").alias("fused_score"), ranks.alias("ranks"), F.lit("lr").alias("fusion"), "pos")
    fused = fusion.rrf(runs, weights=weights, top_k=top_k)
    return fused.select("query_id", "chunk_id", "fused_score", "ranks", F.lit("rrf").alias("fusion"), "pos")


def with_tops(fused: DataFrame, runs: DataFrame, n: int = 5) -> DataFrame:
    """fused with `tops`: for each run of the query, its first n chunk_ids in order."""
    first = runs.where(F.col("rank") <= n).groupBy("query_id", "run").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("l"))
    ids = F.transform("l", lambda x: x["chunk_id"])
    tops = first.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("run", ids.alias("ids"))))).alias("tops"))
    return fused.join(tops, "query_id", "left")


def with_fallback(asked: DataFrame, retrieve: Retriever, k: int = 20) -> DataFrame:
    """(query_id, chunk_id, score, rank, found_by) for (query_id, query, rewritten): the rewritten query is searched first, and where it finds nothing the question as it was asked."""
    first = retrieve(asked.where("rewritten <> ''").select("query_id", F.col("rewritten").alias("query")), k)
    first = cut(first.withColumn("found_by", F.lit("rewritten")), "first")
    left = asked.join(first.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "query")
    return first.unionByName(retrieve(left, k).withColumn("found_by", F.lit("question")))
