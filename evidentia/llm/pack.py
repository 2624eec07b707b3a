"""Filling containers of fixed capacity by bounded-space online packing.

Each partition keeps a fixed number of open containers. An item goes into the
open container that it fills best; when it fits in none, and all places are
taken, the fullest one is emitted and a new one opened. What a partition still
has open at its end are leftovers: they are packed into each other, as items,
in rounds of fewer and fewer partitions, so that no task sees more than the
leftovers of `FAN_IN` partitions.

An item larger than the capacity, and only such an item, is split: into pieces
that fill whole containers and a rest that is packed like any item. Items
arrive in the order of a hash of their id, as a mix of sizes packs best.

Defined cases: items with a null id or size, or a size below one, are in no
container. Equal sizes and repeated sizes are ordinary; ids must be unique (the
sizes of `token_sizes` are). An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.session import cut

FAN_IN = 64
_PLACED = "item string, container string, filled long, open boolean"


def _packed(capacity: int, windows: int, round_no: int, largest_first: bool):
    """Place (item, size) rows; then a row without item for every container, telling its filling."""

    def run(batches):
        prefix = f"{round_no}-{TaskContext.get().partitionId()}-"
        free: list[tuple[int, int]] = []  # (room, number) of the open containers, by room
        made = 0

        def batch_of(rows):
            types = [pa.string(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["item", "container", "filled", "open"])

        def sized():
            for batch in batches:
                yield zip(batch.column("item").to_pylist(), batch.column("size").to_pylist())

        chunks = sized()
        if largest_first:  # a round of leftovers: at most FAN_IN times the windows
            chunks = [sorted((x for chunk in chunks for x in chunk), key=lambda x: (-x[1], x[0]))]
        for chunk in chunks:
            rows = []
            for item, size in chunk:
                at = bisect_left(free, (size, -1))
                if at < len(free):
                    room, number = free.pop(at)
                else:
                    if len(free) >= windows:
                        room, number = free.pop(0)
                        rows.append((None, prefix + str(number), capacity - room, False))
                    room, number, made = capacity, made, made + 1
                rows.append((item, prefix + str(number), None, None))
                if room > size:
                    insort(free, (room - size, number))
                else:
                    rows.append((None, prefix + str(number), capacity, False))
            if rows:
                yield batch_of(rows)
        if free:
            yield batch_of([(None, prefix + str(number), capacity - room, True) for room, number in free])

    return run


def pack(sizes: DataFrame, id_col: str, size_col: str, *, capacity: int, windows: int = 256) -> DataFrame:
    """(id, piece_no, container, begin, end): where the units begin..end of each item go."""
    if capacity < 1 or windows < 1:
        raise ValueError("capacity and windows must be positive")
    items = sizes.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("size")).where("id is not null and size >= 1")
    full = items.where(F.col("size") >= capacity).select("id", F.posexplode(F.expr(f"sequence(1L, size div {capacity})")).alias("piece_no", "nth"))
    full = full.select("id", "piece_no", F.concat_ws("-", F.lit("full"), F.col("id").cast("string"), "piece_no").alias("container"), ((F.col("nth") - 1) * capacity).alias("begin"), (F.col("nth") * capacity).alias("end"))
    whole = (F.col("size") / capacity).cast("int")
    rest = items.withColumn("whole", F.floor(F.col("size") / capacity)).withColumn("part", F.col("size") - F.col("whole") * capacity).where("part > 0")

    # A mix of sizes in every partition, whatever the order of the table.
    n_parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = rest.select(F.col("id").cast("string").alias("item"), F.col("part").alias("size")).repartition(n_parts, F.xxhash64("item")).sortWithinPartitions(F.xxhash64("item", F.lit(1)), "item")
    placed = cut(mixed.mapInArrow(_packed(capacity, windows, 0, False), _PLACED), "packed")
    inside = placed.where("item is not null").select("item", "container")
    moves, round_no = None, 0
    while True:
        round_no += 1
        n_parts = -(-n_parts // FAN_IN)
        leftovers = placed.where("item is null and open").select(F.col("container").alias("item"), F.col("filled").alias("size"))
        most = windows if n_parts > 1 else 1 << 30
        placed = cut(leftovers.repartition(n_parts, F.xxhash64("item")).mapInArrow(_packed(capacity, most, round_no, True), _PLACED), "packed")
        step = placed.where("item is not null").select(F.col("item").alias("container"), F.col("container").alias("target"))
        moves = step if moves is None else moves.unionAll(step)
        inside = inside.join(step, "container", "left").select("item", F.coalesce("target", "container").alias("container"))
        if n_parts == 1:
            break
    rest = rest.select("id", F.col("id").cast("string").alias("item"), whole.alias("piece_no"), (F.col("whole") * capacity).alias("begin"), F.col("size").alias("end"))
    return full.unionByName(rest.join(inside, "item").select("id", "piece_no", "container", "begin", "end"))


def pack_summary(packed: DataFrame, capacity: int) -> DataFrame:
    """(n_items, n_pieces, n_containers, units, unused_share) of one packing."""
    each = packed.groupBy("container").agg(F.sum(F.col("end") - F.col("begin")).alias("filled"), F.count("*").alias("n"))
    whole = each.agg(F.sum("n").alias("n_pieces"), F.count("*").alias("n_containers"), F.sum("filled").alias("units"), F.max("filled").alias("fullest"))
    return whole.withColumn("unused_share", 1 - F.col("units") / (F.col("n_containers") * capacity))
