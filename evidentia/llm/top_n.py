"""Top N items within every group by a global range-partitioned sort.

All rows are sorted by group, score (high to low) and identifier over range
partitions, so a group of any size is spread over as many partitions as its
rows need. Each partition numbers its rows within each group and keeps numbers
up to N; a row beyond N in its partition can't be among the first N overall.
Only a group that runs on from one partition to the next needs more: the counts
of each partition's first and last group, at most two rows a partition, are
prefix-summed in partition order and added. Nothing is shuffled after the sort.

Defined cases: rows with a null group, identifier or score, or a score that is
not a number, don't count. An identifier that occurs again in a group counts
once, with its highest score. Equal scores are ordered by identifier, by code
point. Negative zero equals zero. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.session import cut


_KEPT = "part int, g string, i string, s double, pos long, opening boolean, total long"


def _numbered(n: int):
    """Number sorted rows within their group in this partition; add a row for its first and its last group."""

    def rows(batch, at, pos, opening):
        take = pa.array(at)
        columns = [batch.column(c).take(take) for c in ("part", "g", "i", "s")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(pos, pa.int64()), pa.array(opening), pa.nulls(len(at), pa.int64())], ["part", "g", "i", "s", "pos", "opening", "total"])

    def edge(part, group, opening, total):
        columns = [pa.array([part], pa.int32()), pa.array([group], pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([opening]), pa.array([total], pa.int64())], ["part", "g", "i", "s", "pos", "opening", "total"])

    def run(batches):
        first = last = part = None
        total, first_total, group_no = 0, 0, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            group, part = batch.column("g"), batch.column("part")[0].as_py()
            new = np.ones(len(group), bool)
            new[1:] = pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False)
            new[0] = group_no < 0 or group[0].as_py() != last
            at = np.arange(len(group))
            start = np.maximum.accumulate(np.where(new, at, -total))
            pos = at - start + 1
            opening = group_no + np.cumsum(new) == 0
            if opening.any():
                first, first_total = group[0].as_py(), int(pos[opening].max())
            keep = np.flatnonzero(pos <= n)
            yield rows(batch, keep, pos[keep], opening[keep])
            last, total, group_no = group[len(group) - 1].as_py(), int(pos[-1]), group_no + int(new.sum())
        if group_no >= 0:
            yield edge(part, first, True, first_total)
            if group_no > 0:
                yield edge(part, last, False, total)

    return run


def top_n_per_group(df: DataFrame, group: str, score: str, ident: str, n: int) -> DataFrame:
    """(group, ident, pos): the first n identifiers of each group, pos from 1."""
    value = F.col(score).cast("double")
    usable = df.select(F.col(group).cast("string").alias("g"), F.col(ident).cast("string").alias("i"), (value + 0.0).alias("s"))
    usable = usable.where("g is not null and i is not null and s is not null and not isnan(s)")
    once = usable.groupBy("g", "i").agg(F.max("s").alias("s"))
    order = [F.asc("g"), F.desc("s"), F.asc("i")]
    spread = once.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = cut(spread.select(F.spark_partition_id().alias("part"), "g", "i", "s").mapInArrow(_numbered(n), _KEPT), "top-n")
    # Rows of a group before a partition: the sum over the ends of earlier partitions with the same group.
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edges = kept.where("total is not null").groupBy("g", "part").agg(F.max("total").alias("total"))
    # At most two rows a partition: small enough to broadcast whatever the data.
    before = edges.select("g", "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before")).where("before > 0")
    placed = kept.where("total is null").join(F.broadcast(before), ["g", "part"], "left")
    pos = F.col("pos") + F.coalesce("before", F.lit(0))
    return placed.select(F.col("g").alias(group), F.col("i").alias(ident), pos.cast("int").alias("pos")).where(F.col("pos") <= n)
