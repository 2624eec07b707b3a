"""Seeded choices by MD5: the same in every engine and at every number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def first_by_hash(df: DataFrame, key: str, n: Column | int, seed: int = 7) -> DataFrame:
    """df with `chosen`: whether the row is among the first n in the order of its key's hash; keys must be distinct.

    Nothing is sorted as a whole: rows are counted by the first three digits of
    the hash, and only the bucket in which the n-th falls is put in order. `n`
    may be a Column of constants or of `total`, the number of rows.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    hashed = df.withColumn("_h", seeded(seed, F.col(key).cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_b").agg(F.count("*").alias("_n"))  # 4,096 rows at most
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = counts.select("_b", "_n", F.sum("_n").over(upto).alias("_to"), F.sum("_n").over(whole).alias("total")).withColumn("_want", n)
    joined = hashed.join(F.broadcast(placed), "_b")
    inside = joined.where("_to <= _want").withColumn("chosen", F.lit(True))
    beyond = joined.where("_to - _n >= _want").withColumn("chosen", F.lit(False))
    cut = joined.where("_to > _want and _to - _n < _want")
    nth = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    cut = cut.withColumn("chosen", nth <= F.col("_want") - (F.col("_to") - F.col("_n")))
    keep = [*df.columns, "chosen"]
    return inside.select(*keep).unionAll(beyond.select(*keep)).unionAll(cut.select(*keep))


def first_per_group(df: DataFrame, group: list[str], key: Column, n: int) -> DataFrame:
    """The first n rows of each group by a key."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*group).orderBy(key))).where(F.col("_nth") <= n).drop("_nth")
