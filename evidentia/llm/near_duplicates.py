"""Near-duplicate records with small edits: a blocked sparse product of documents by word runs.

The incidence matrix has a row for each distinct set of word runs (copies
share a row, their *class*) and a column for each run of `width` words. Its
product with its own transpose counts the runs that two classes share. Three
bounds that follow from the sizes of the two sets keep the product sparse:

* columns are put in one global order, rarest first; two sets that reach the similarity must share `least` columns near
  their front (how near depends on both sizes), so only the front is
  multiplied;
* a product of two entries is dropped when their positions leave too few
  columns for the overlap that the sizes demand;
* pairs whose accumulated products stay below `least` are discarded.

The order of columns affects the work only, never the result. It comes from a
table of 2**`sketch_bits` counters, each the sum over the columns that share it.
A counter adds one in so many of all entries to a column's own count on average,
so columns are told apart by the share of entries they hold, and a column with
several such shares is known to be frequent at any size of the corpus. What is
left is checked exactly on the whole sets. The matrix travels as packed blocks
of columns, a partition for about each block, so that tasks keep their size
while the corpus grows. A column that may be longer than `HOT_COLUMN` is cut
into bands; each pair of bands goes to a block of its own.

A class is known by 128 bits of its set's hashes. Half of them travel with the
entries; the exact check joins by all of them.

Defined cases: null, empty and short texts (fewer than `min_words` words) are
in no pair and no class. A repeated id counts once, with its greatest class id
if its texts differ. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import _text
from evidentia.llm.graph import connected_components
from evidentia.session import cut

#: Entries of one column that a single block multiplies with each other.
HOT_COLUMN = 4096
#: Bits of the filter for classes that are checked, for each of them and at most: it only saves sending sets that nobody needs.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28
#: A column is told from the others of its block by 32 bits; should two agree, a pair may be checked in vain.
_ENTRY = np.dtype([("column", "<u4"), ("cls", "<i8"), ("size", "<i4"), ("place", "<i4"), ("band", "<u4"), ("side", "<u4")])
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("products", "<u4")])


def _pack(rows: np.ndarray) -> bytes:
    """The rows byte by byte, all first bytes of a field together: the many zero bytes compress well."""
    return b"".join(np.ascontiguousarray(rows[f]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for f in rows.dtype.names)


def _unpack(payloads: list[bytes], dtype: np.dtype) -> np.ndarray:
    sizes = [len(x) // dtype.itemsize for x in payloads]
    out, done = np.zeros(sum(sizes), dtype), 0
    for payload, n in zip(payloads, sizes):
        data, at = np.frombuffer(payload, np.uint8), 0
        for f in dtype.names:
            width = dtype[f].itemsize
            out[f][done : done + n] = np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T).view(dtype[f]).ravel()
            at += n * width
        done += n
    return out


def _packed_by(block: np.ndarray, rows: np.ndarray) -> list[pa.Array]:
    """Rows of each block as one payload; rows must be in the order wanted within a block."""
    order = np.argsort(block, kind="stable")
    block, rows = block[order], rows[order]
    edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(block) else np.zeros(1, np.int64)
    return [pa.array(block[edges[:-1]], pa.int32()), pa.array([_pack(rows[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary())]


def _classes(texts: list[str | None], width: int, min_words: int):
    """Per row of a batch: is it long enough, the two halves of its class, and set size; and all its runs, sorted."""
    rows, hashes = _text.words(texts)
    long = np.bincount(rows, minlength=len(texts)) >= max(min_words, width)
    keep = long[rows] if len(rows) else np.zeros(0, bool)
    rows, runs = _text.shingles(rows[keep], hashes[keep], width)
    sizes = np.bincount(rows, minlength=len(texts)).astype(np.int64)
    ids, checks = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    if len(rows):
        starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        spread = _text.mix(runs ^ np.uint64(0x5851F42D4C957F2D))
        value = np.add.reduceat(spread, starts) ^ _text.mix(np.bitwise_xor.reduceat(_text.mix(spread), starts) + sizes[rows[starts]].astype(np.uint64))
        ids[rows[starts]] = _text.mix(value)
        checks[rows[starts]] = np.add.reduceat(_text.mix(spread ^ np.uint64(0x2545F4914F6CDD1D)), starts)
    return long, ids.view(np.int64), checks.view(np.int64), sizes, rows, runs


class _Once:
    """Which rows of each batch have a class that no row before had."""

    def __init__(self):
        self.done = set()

    def __call__(self, ids: np.ndarray, checks: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        new = np.zeros(len(ids), bool)
        for i in np.flatnonzero(wanted):
            if (key := (int(ids[i]), int(checks[i]))) not in self.done:
                self.done.add(key)
                new[i] = True
        return new


def _whole(cls: str = "cls", check: str = "check") -> Column:
    """All 128 bits of a class, as text."""
    return F.concat(F.lpad(F.hex(cls), 16, "0"), F.lpad(F.hex(check), 16, "0"))


def _text_batches(batches, text: str):
    for batch in batches:
        texts = batch.column(text).to_pylist()
        for a, b in _text.slices(texts):
            yield batch.slice(a, b - a), texts[a:b]


def signatures(df: DataFrame, id_col: str, text_col: str, width: int, min_words: int, sketch_bits: int) -> DataFrame:
    """(id, cls, check, size) of each long enough row, and the blocks of each partition's count table, in which copies count once."""

    def run(batches):
        counts, once = _text.CountTable(sketch_bits), _Once()
        for batch, texts in _text_batches(batches, "text"):
            long, ids, checks, sizes, rows, runs = _classes(texts, width, min_words)
            counts.add(runs[once(ids, checks, sizes > 0)[rows]])
            at = np.flatnonzero(long)
            none = pa.nulls(len(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at)), pa.array(ids[at]), pa.array(checks[at]), pa.array(sizes[at].astype(np.int32)), none.cast(pa.int32()), none.cast(pa.binary())],
                ["id", "cls", "check", "size", "block", "payload"],
            )
        for k, payload in counts.blocks():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([k], pa.int32()), pa.array([payload], pa.binary())],
                ["id", "cls", "check", "size", "block", "payload"],
            )

    source = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return source.mapInArrow(run, "id string, cls long, check long, size int, block int, payload binary")


def _front(df: DataFrame, text_col: str, counts, n_blocks: int, width: int, min_words: int, similarity: float, least: int) -> DataFrame:
    """The entries near the front of every set, packed by block of columns."""

    def run(batches):
        table, once = counts.value, _Once()
        mask = np.uint64(len(table) - 1)
        waiting, held = [], 0

        def packed():
            entries, block = np.concatenate([x for x, _ in waiting]), np.concatenate([x for _, x in waiting])
            order = np.argsort(entries["column"], kind="stable")
            return pa.RecordBatch.from_arrays(_packed_by(block[order], entries[order]), ["block", "payload"])

        def place_in(part, column):
            spread = column + (part["band"].astype(np.uint64) * np.uint64(1 << 32) + part["side"]) * np.uint64(0x9E3779B97F4A7C15)
            waiting.append((part, (_text.mix(spread) % np.uint64(n_blocks)).astype(np.int32)))

        for _, texts in _text_batches(batches, "text"):
            _, ids, checks, sizes, rows, runs = _classes(texts, width, min_words)
            keep = once(ids, checks, sizes > 0)[rows]  # copies within a partition send their entries once
            rows, runs = rows[keep], runs[keep]
            seen = table[(runs & mask).astype(np.int64)]
            order = np.lexsort((runs, seen, rows))
            rows, runs, seen = rows[order], runs[order], seen[order]
            first = np.searchsorted(rows, rows, side="left")
            place = np.arange(len(rows)) - first
            size = sizes[rows]
            # A count of one is exact: no other set has the run.
            front = (place <= size - np.ceil(similarity * size - 1e-9) + least - 1) & (seen > 1)
            entries = np.zeros(int(front.sum()), _ENTRY)
            column = runs[front]
            entries["column"] = (column >> np.uint64(32)).astype(np.uint32)
            entries["cls"], entries["size"], entries["place"] = ids[rows[front]], size[front], place[front]
            bands = np.maximum(1, -(-seen[front].astype(np.int64) // HOT_COLUMN))
            place_in(entries[bands == 1], column[bands == 1])
            held += len(entries)
            for n in np.unique(bands[bands > 1]):
                hot = entries[bands == n]
                own = (_text.mix(hot["cls"].view(np.uint64)) % np.uint64(n)).astype(np.int32)
                for other in range(int(n)):
                    copy = hot.copy()
                    copy["band"], copy["side"] = np.minimum(own, other) + 1, np.maximum(own, other) + 1
                    # The sign tells the sides of a pair of bands apart.
                    copy["place"] = np.where(own > other, -copy["place"] - 1, copy["place"])
                    place_in(copy, column[bands == n])
                    held += len(copy)
                    if held > 150_000:
                        yield packed()
                        waiting, held = [], 0
            if held > 150_000:
                yield packed()
                waiting, held = [], 0
        if held:
            yield packed()

    source = df.select(F.col(text_col).alias("text")).where("text is not null")
    return source.mapInArrow(run, "block int, payload binary")


def _product(similarity: float, least: int, n_blocks: int):
    """Multiply one block of columns: the pairs of classes in it and their kept products, packed by block of pairs."""
    share = similarity / (1 + similarity)

    def run(table: pa.Table) -> pa.Table:
        e = _unpack(table.column("payload").to_pylist(), _ENTRY)
        bands = e["band"].astype(np.uint64) * np.uint64(1 << 32) + e["side"]
        column = e["column"].astype(np.uint64) | (np.unique(bands, return_inverse=True)[1].astype(np.uint64) << np.uint64(32))
        order = np.lexsort((e["cls"], e["size"], column))
        e, column = e[order], column[order]
        new = np.concatenate(([True], (column[1:] != column[:-1]) | (e["cls"][1:] != e["cls"][:-1])))
        e, column = e[new], column[new]
        size, cls = e["size"].astype(np.int64), e["cls"]
        flipped, place = e["place"] < 0, np.where(e["place"] < 0, -e["place"].astype(np.int64) - 1, e["place"])
        across = e["band"] != e["side"]
        found = []
        at, step = np.arange(len(e)), 0
        while len(at):
            step += 1
            at = at[at + step < len(e)]
            # Entries of a column are sorted by size: beyond the ratio no later one fits.
            at = at[(column[at] == column[at + step]) & (size[at] >= similarity * size[at + step] - 1e-9)]
            to = at + step
            need = np.ceil(share * (size[at] + size[to]) - 1e-9).astype(np.int64)
            p, q, m, n = place[at], place[to], size[at], size[to]
            good = (p <= m - need + least - 1) & (q <= n - need + least - 1)
            good &= np.minimum(p, q) + np.minimum(m - p, n - q) >= need
            good &= ~across[at] | (flipped[at] != flipped[to])
            i, j = at[good], to[good]
            if len(i):
                # Where fewer than `least` shared columns may do, each counts for more.
                weight = -(-least // np.minimum(least, np.maximum(1, need[good])))
                found.append((np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), weight))
        pairs = np.zeros(sum(len(x) for x, _, _ in found), _PAIR)
        if len(pairs):
            pairs["a"], pairs["b"], pairs["products"] = (np.concatenate(x) for x in zip(*found))
            pairs = _summed(pairs)
        block = (_text.mix(pairs["a"].view(np.uint64) ^ _text.mix(pairs["b"].view(np.uint64))) % np.uint64(n_blocks)).astype(np.int32)
        return pa.table(dict(zip(("block", "payload"), _packed_by(block, pairs))))

    return run


def _summed(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    starts = np.flatnonzero(np.concatenate(([True], (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1]))))
    out = pairs[starts]
    out["products"] = np.add.reduceat(pairs["products"], starts)
    return out


def _likely(least: int):
    """The pairs of one block of pairs whose products reach the bound."""

    def run(table: pa.Table) -> pa.Table:
        pairs = _summed(_unpack(table.column("payload").to_pylist(), _PAIR))
        pairs = pairs[pairs["products"] >= least]
        return pa.table({"a": np.ascontiguousarray(pairs["a"]), "b": np.ascontiguousarray(pairs["b"])})

    return run


def _sets(df: DataFrame, text_col: str, wanted, width: int, min_words: int) -> DataFrame:
    """(cls, check, runs) of the classes whose bit in the filter `wanted` is set, once per partition."""

    def run(batches):
        bits, once = wanted.value, _Once()
        n_bits = np.uint64(len(bits) * 8)
        for _, texts in _text_batches(batches, "text"):
            _, ids, checks, sizes, rows, runs = _classes(texts, width, min_words)
            at = (ids.view(np.uint64) & np.uint64((1 << 63) - 1)) % n_bits
            set_ = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            some = np.flatnonzero(once(ids, checks, (sizes > 0) & (set_ > 0)))
            if len(some):
                a, b = np.searchsorted(rows, some), np.searchsorted(rows, some, side="right")
                values = np.concatenate([runs[x:y] for x, y in zip(a, b)]).view(np.int64)
                offsets = np.concatenate(([0], np.cumsum(b - a))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(checks[some]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["cls", "check", "runs"])

    return df.select(F.col(text_col).alias("text")).where("text is not null").mapInArrow(run, "cls long, check long, runs array<long>")


def _filter(likely: DataFrame) -> np.ndarray:
    """The bits of the classes in the pairs (a, b): FILTER_BITS a class of room, MOST_FILTER_BITS (32 MB) at most."""
    n = likely.count()
    n_bits = 1 << 15
    while n_bits < min(2 * n * FILTER_BITS, MOST_FILTER_BITS):
        n_bits *= 2
    at = F.expr(f"(cls & {(1 << 63) - 1}) % {n_bits}").alias("at")
    ones = likely.select(F.explode(F.array("a", "b")).alias("cls")).select(at)
    # Functions of bitmaps count from 1 in positions of 32,768 bits.
    made = ones.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))
    out = np.zeros(n_bits // 8, np.uint8)
    for row in made.toLocalIterator():
        out[(row.k - 1) * 4096 : row.k * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def similar_classes(
    df: DataFrame, id_col: str, text_col: str, *, width: int = 5, similarity: float = 0.8, min_words: int = 0, least: int = 4, sketch_bits: int = 22, block_entries: int = 200_000
) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (id, cls), one row per id; pairs (cls_a, cls_b, n_shared, n_either).

    Texts in one class have equal sets of word runs; pairs are of different
    classes whose shared runs are at least `similarity` of the runs of either.
    """
    spark = df.sparkSession
    signed = cut(signatures(df, id_col, text_col, width, min_words, sketch_bits), "signatures")
    members = signed.where("id is not null").groupBy("id").agg(F.max(_whole()).alias("cls"))
    counts = spark.sparkContext.broadcast(_text.merged_counts(signed.where("block is not null").select("block", "payload"), sketch_bits))
    total = signed.agg(F.sum((F.col("size") * (1 - similarity)).cast("long") + least).alias("n")).first().n or 0
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_entries))
    entries = _front(df, text_col, counts, n_blocks, width, min_words, similarity, least).repartition(n_blocks, "block")
    products = entries.groupBy("block").applyInArrow(_product(similarity, least, n_blocks), "block int, payload binary").repartition(n_blocks, "block")
    likely = cut(products.groupBy("block").applyInArrow(_likely(least), "a long, b long"), "likely")
    wanted = spark.sparkContext.broadcast(_filter(likely))
    sets = _sets(df, text_col, wanted, width, min_words).repartition(n_blocks, "cls").groupBy("cls", "check").agg(F.first("runs").alias("runs"))
    left = sets.select(F.col("cls").alias("a"), _whole().alias("cls_a"), F.col("runs").alias("runs_a"))
    right = sets.select(F.col("cls").alias("b"), _whole().alias("cls_b"), F.col("runs").alias("runs_b"))
    both = likely.join(left, "a").join(right, "b").withColumn("n_shared", F.size(F.array_intersect("runs_a", "runs_b")))
    pairs = both.select("cls_a", "cls_b", "n_shared", (F.size("runs_a") + F.size("runs_b") - F.col("n_shared")).alias("n_either"))
    return members, pairs.where(F.col("n_shared") >= similarity * F.col("n_either") - 1e-9)


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(id_lo, id_hi), each pair of different ids whose texts are similar enough, copies included."""
    members, pairs = similar_classes(df, id_col, text_col, **options)
    members = cut(members, "members")
    twice = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))
    left = members.select(F.col("id").alias("x"), F.col("cls").alias("cls_a"))
    right = members.select(F.col("id").alias("y"), F.col("cls").alias("cls_b"))
    joined = pairs.select("cls_a", "cls_b").unionAll(twice).join(left, "cls_a").join(right, "cls_b")
    return joined.where("cls_a <> cls_b or x < y").select(F.least("x", "y").alias("id_lo"), F.greatest("x", "y").alias("id_hi"))


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(id, cls, group_id, n_links): one row per id in any link; linked ids share a group_id.

    group_id is the smallest class id of the group; n_links counts the other
    ids, copies included, that the id is directly linked to.
    """
    members, pairs = similar_classes(df, id_col, text_col, **options)
    members, pairs = cut(members, "members"), cut(pairs.select("cls_a", "cls_b"), "pairs")
    sizes = members.groupBy("cls").agg(F.count("*").alias("n"))
    ends = pairs.unionAll(pairs.select(F.col("cls_b").alias("cls_a"), F.col("cls_a").alias("cls_b")))
    around = ends.join(sizes.select(F.col("cls").alias("cls_b"), "n"), "cls_b").groupBy(F.col("cls_a").alias("cls")).agg(F.sum("n").alias("near"))
    groups = connected_components(pairs.toDF("a", "b"))
    linked = sizes.join(around, "cls", "left").join(groups.select(F.col("node").alias("cls"), "component"), "cls", "left")
    linked = linked.select("cls", F.coalesce("component", "cls").alias("group_id"), (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")).where("n_links > 0")
    return members.join(linked, "cls").select("id", "cls", "group_id", "n_links")
