"""Exact nearest vectors of a stated set of queries, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import vectors as V

#: Items and queries of one block.
ITEMS, BLOCK = 8192, 2048
#: The longest list of queries that may be broadcast.
MOST_BROADCAST = 16_384


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _usable(x: np.ndarray, *columns):
    """The rows whose values are all finite and not all zero."""
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    if good.all():
        return x, *columns
    return x[good], *[c[good] if isinstance(c, np.ndarray) else c.filter(pa.array(good)) for c in columns]


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """(query, item) numbers of which the least are the nearest: minus the cosine, or the squared distance."""
    if metric == "cosine":
        return -(np.round((q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1), 6) + 0.0)
    if len(q) * len(x) < 200_000:
        return np.round(((q[:, None, :] - x[None, :, :]) ** 2).sum(2), 6)
    return np.round((q * q).sum(1)[:, None] - 2 * (q @ x.T) + (x * x).sum(1), 6) + 0.0


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, item) of the k least of each row, ties by id, without sorting the rows."""
    k = min(k, score.shape[1])
    kth = np.partition(score, k - 1, axis=1)[:, k - 1]
    i, j = np.nonzero((score <= kth[:, None]) & np.isfinite(score))
    order = np.lexsort((ids[j], score[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first]


def _best_by_label(score: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As `_best`, with the nearest item of each label only."""
    order = np.lexsort((ids, labels))
    score, starts = score[:, order], np.flatnonzero(np.concatenate(([True], labels[order][1:] != labels[order][:-1])))
    least = np.minimum.reduceat(score, starts, axis=1)
    kth = np.partition(least, min(k, len(starts)) - 1, axis=1)[:, min(k, len(starts)) - 1]
    i, at = np.nonzero((least <= kth[:, None]) & np.isfinite(least))
    ends = np.append(starts[1:], len(order))
    j = np.array([starts[a] + int(np.argmin(score[q, starts[a] : ends[a]])) for q, a in zip(i, at)], np.int64)
    rank = np.lexsort((ids[order][j], score[i, j], i)) if len(i) else np.zeros(0, np.int64)
    i, j = i[rank], j[rank]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], order[j[first]]


def knn(items: DataFrame, queries: DataFrame, k: int, *, dim: int, metric: str = "cosine", not_self: bool = False, bounded: bool = False) -> DataFrame:
    """(query, item, score, rank) of items (id, v) for queries (id, v); with a column `label` of items also label, and each label once.

    The score is the cosine (greatest first) or the squared distance (least
    first), rounded to 6 decimals; ties are in order of id. Rows whose vector
    isn't usable, and null ids, take no part. Blocks of items meet blocks of
    queries; each two give at most k rows a query. `bounded` says that the
    queries are a list that doesn't grow with the data: they are broadcast, and
    the items are scanned without a shuffle. A list beyond MOST_BROADCAST is an
    error. `not_self` leaves out an item with the query's own id.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("metric is cosine or l2")
    sign = -1.0 if metric == "cosine" else 1.0
    labelled = "label" in items.columns
    label = F.col("label") if labelled else F.lit(None).cast("string").alias("label")
    # What the values are is seen in the blocks.
    items = items.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), label).where(F.col("id").isNotNull() & (F.size("v") == dim))
    if labelled:
        items = items.where("label is not null")
    queries = queries.select("id", F.col("v").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & V.usable(F.col("v"), dim))
    kind = queries.schema["id"].dataType.simpleString()
    schema = f"query {kind}, item long, label string, score double"

    def met(names, q, ids, labels, x) -> list[pa.Array]:
        (q, names), (x, ids, labels) = _usable(q, names), _usable(x, ids, labels)
        if not len(q) or not len(x):
            return [names.slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.float64())]
        score = _distances(q, x, metric)
        if not_self:
            score[names.to_numpy(zero_copy_only=False)[:, None] == ids[None, :]] = np.inf
        at, to = _best_by_label(score, ids, labels.to_numpy(zero_copy_only=False).astype(str), k) if labelled else _best(score, ids, k)
        return [names.take(pa.array(at)), pa.array(ids[to]), labels.take(pa.array(to)), pa.array(score[at, to] * sign + 0.0)]

    columns = ["query", "item", "label", "score"]
    if bounded:
        asked = queries.limit(MOST_BROADCAST + 1).toArrow()
        if asked.num_rows > MOST_BROADCAST:
            raise ValueError(f"more than {MOST_BROADCAST} queries aren't a bounded list")
        shared = items.sparkSession.sparkContext.broadcast((asked.column("id").combine_chunks(), _matrix(asked.column("v")).reshape(asked.num_rows, dim)))

        def scan(batches):
            names, q = shared.value
            for batch in batches:
                if batch.num_rows and len(names):
                    yield pa.RecordBatch.from_arrays(met(names, q, batch.column("id").to_numpy(), batch.column("label"), _matrix(batch.column("v"))), columns)

        near = items.mapInArrow(scan, schema)
    else:
        n_items, n_queries = (F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int") for size in (ITEMS, BLOCK))
        blocks = F.broadcast(items.agg(n_items.alias("n")).crossJoin(queries.agg(n_queries.alias("m"))))  # one row
        left = items.crossJoin(blocks).select(F.pmod(F.xxhash64("id"), "n").alias("a"), F.explode(F.expr("sequence(0L, m - 1L)")).alias("b"), "id", "v", "label")
        right = queries.crossJoin(blocks).select(F.explode(F.expr("sequence(0L, n - 1L)")).alias("a"), F.pmod(F.xxhash64("id"), "m").alias("b"), "id", "v")

        def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"query": right.column("id").slice(0, 0), "item": pa.array([], pa.int64()), "label": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
            names, labels = right.column("id").combine_chunks(), left.column("label").combine_chunks()
            return pa.table(dict(zip(columns, met(names, _matrix(right.column("v")), left.column("id").to_numpy(), labels, _matrix(left.column("v"))))))

        near = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(meet, schema)
    order = [F.desc("score") if metric == "cosine" else F.asc("score"), "item"]
    if labelled:
        nearest = F.min(F.struct((F.col("score") * sign).alias("s"), "item")).alias("m")
        near = near.groupBy("query", "label").agg(nearest).select("query", F.col("m.item").alias("item"), "label", (F.col("m.s") * sign + 0.0).alias("score"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return ranked if labelled else ranked.drop("label")
