"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.session import cut


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reached.

    Alternates the large-star and small-star steps (Kiveris et al., 2014), each
    a group minimum joined back on the node, until the edges stop changing.
    Each round is written to the scratch folder, so lineage doesn't grow. A
    node with very many neighbours is split by the partial aggregation of the
    minimum and by AQE's skew join. Self-links and repeated links are allowed;
    links with a null end are ignored. Rounds grow with the logarithm of the
    longest chain; running out of them is an error, never a result.
    """
    links = edges.where("a is not null and b is not null")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    now = cut(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = cut(moved.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"the components haven't converged after {max_rounds} rounds")
    return nodes.join(now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
