"""Most similar vectors for every vector by additive quantisation.

A unit vector is written as the sum of a list's centre and one entry of each
full-dimensional residual codebook. Codes are found by beam search over the
codebooks; with them the norm of the sum and the length of what it misses are
stored. A query's score of a vector is its product with that sum; the sums of a
block are made once, and a list is scored for all its queries by one matrix
product. What the scores let through is reranked by the vectors, and finally by
the exact cosine in double.

With a least cosine, both cuts are proven and nothing at or above it is lost.
A vector is in the list of its nearest centre, so a list can hold only vectors on
its side of the plane midway between its centre and the query's own; a list
whose plane is farther from the query than the least cosine allows isn't scanned.
Within a list, an inner product differs from its score by at most the stored
miss. When every vector is a query, a pair is sought from one side only, which
the two lists' numbers tell. Without a least cosine, a query's best `depth` scores
in each of its `probes` nearest lists go on. For a stated set of queries `exact`
takes the cosines of what the nearest lists gave as each query's least cosine.

The number of lists grows with the square root of the vectors up to MOST_LISTS,
as the centres are fitted on the driver from a bounded sample; beyond some 67
million vectors lists grow instead, and a query's work with them.

Vectors of equal direction form one class, represented by its smallest id. A
class of any size is one entry of the index; of its members only the first
k + 1, in the order of ties, can be among anybody's k, and every member
receives its own result. Groups of lists and query sets larger than `BLOCK` are cut into
blocks, so no task holds a whole list; within a task `SLICE` vectors of a list are
scored at once.

Defined cases: vectors that are null, of another dimension, with a value that
is null or not finite, or all zero take part in nothing; null ids neither; a
repeated id counts once, with one of its vectors, the same in every run. Cosines are rounded to 6
decimals; equal ones are ordered by id. An empty table gives no rows. The index
is fitted on at most `SAMPLE_PER_LIST` vectors a list; every vector is indexed.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import vectors as V
from evidentia.session import cut

#: The bound of the sample that the centres and codebooks are fitted on.
SAMPLE_PER_LIST, LEAST_SAMPLE, MOST_LISTS = 24, 8192, 1 << 14
BLOCK, SLICE, LISTS_A_GROUP = 1 << 16, 8192, 32
#: Products of vectors and centres are made for so many pairs at once: whatever the number of lists, they take some MB.
CELLS = 1 << 21
#: Queries are searched in as many passes as keep the rows that one sends to groups of lists below the larger of so many and so many a vector.
ROWS_A_PASS, ROWS_A_VECTOR = 1 << 21, 2
#: Reranking uses vectors of 16-bit floats; an inner product of theirs is off by less than this.
HALF_MARGIN = 2e-3


class Quantiser:
    """Centres of lists and residual codebooks; fitted on a bounded sample, small enough to broadcast."""

    def __init__(self, sample: np.ndarray, n_lists: int, books: int, entries: int, beam: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.beam = beam
        sample = sample.astype(np.float32, copy=False)
        self.centres = self._fit(sample, n_lists, rng, 8)
        # Lists whose centres are near each other form a group: most of a query's lists are in a few groups.
        self.group = self._closest(self.centres, self._fit(self.centres, max(1, len(self.centres) // LISTS_A_GROUP), rng, 8)).astype(np.int32)
        left = sample.copy()
        self._subtract(left, self.centres)
        self.books = []
        for _ in range(books):
            book = self._fit(left, entries, rng, 6)
            self.books.append(book)
            self._subtract(left, book)

    @staticmethod
    def _scored(x: np.ndarray, book: np.ndarray):
        """(row, scores) of as many rows at once as CELLS allows; the nearest entry has the highest score."""
        half, step = (book * book).sum(1) / 2, max(1, min(8192, CELLS // len(book)))
        for i in range(0, len(x), step):
            score = x[i : i + step] @ book.T
            score -= half
            yield i, score

    @staticmethod
    def _closest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        own = np.empty(len(x), np.int64)
        for i, score in Quantiser._scored(x, book):
            own[i : i + len(score)] = np.argmax(score, axis=1)
        return own

    @staticmethod
    def _subtract(x: np.ndarray, book: np.ndarray) -> None:
        """Take from each row, in place, the entry nearest to it."""
        own = Quantiser._closest(x, book)
        for i in range(0, len(x), 8192):
            x[i : i + 8192] -= book[own[i : i + 8192]]

    def _fit(self, x: np.ndarray, k: int, rng, rounds: int) -> np.ndarray:
        k = min(k, len(x))
        book = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(rounds):
            own = self._closest(x, book)
            sums = np.zeros(book.shape)
            for i in range(0, len(x), 8192):
                part = own[i : i + 8192]
                order = np.argsort(part, kind="stable")
                there, starts = np.unique(part[order], return_index=True)
                sums[there] += np.add.reduceat(x[i : i + 8192][order], starts, axis=0)
            count = np.bincount(own, minlength=k)
            there = np.flatnonzero(count)
            book[there] = sums[there] / count[there][:, None]
        return book

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, nearest first."""
        n = min(n, len(self.centres))
        if n == 1:
            return self._closest(x, self.centres)[:, None].astype(np.int32)
        out = np.empty((len(x), n), np.int32)
        for i, score in self._scored(x, self.centres):
            np.negative(score, out=score)
            top = np.argpartition(score, n - 1, axis=1)[:, :n]
            out[i : i + len(score)] = np.take_along_axis(top, np.argsort(np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)
        return out

    def reached(self, x: np.ndarray, own: np.ndarray, radius: np.ndarray, one_way: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for every list that may hold a vector within the row's radius; `own` is the row's list.

        A vector of another list scores it at least as high as the own centre. From
        here to there the difference of the scores changes by at most the distance
        of the centres times the distance gone. `one_way` keeps one of the two
        directions between any two lists, groups first.
        """
        square = (self.centres.astype(np.float64) ** 2).sum(1)
        score = x @ self.centres.T - (square / 2).astype(np.float32)
        there, at = np.unique(own, return_inverse=True)
        apart = np.sqrt(np.maximum(square[there][:, None] + square - 2 * (self.centres[there].astype(np.float64) @ self.centres.T), 0.0)).astype(np.float32)
        mine, reach = score[np.arange(len(x)), own], apart[at]
        reach *= (radius + HALF_MARGIN)[:, None].astype(np.float32)
        reach += score
        row, which = np.nonzero(reach >= (mine - np.float32(1e-4))[:, None])
        if one_way:
            mine, yours = self.group[own[row]], self.group[which]
            same = mine == yours
            mine, yours = np.where(same, own[row], mine), np.where(same, which, yours)
            good = (mine == yours) | ((mine < yours) == ((mine + yours) % 2 == 0))
            row, which = row[good], which[good]
        return row, which.astype(np.int32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, norm of the sum, length of the miss) by beam search."""
        lists = self.nearest(x, 1)[:, 0]
        left = (x - self.centres[lists])[:, None, :]
        codes = np.zeros((len(x), 1, 0), np.uint8)
        rows = np.arange(len(x))[:, None]
        for book in self.books:
            n, width, k = len(x), left.shape[1], len(book)
            cost = ((left * left).sum(2)[:, :, None] - 2 * (left @ book.T) + (book * book).sum(1)).reshape(n, width * k)
            best = np.empty((n, min(self.beam, width * k)), np.int64)
            for b in range(best.shape[1]):
                best[:, b] = np.argmin(cost, axis=1)
                cost[rows[:, 0], best[:, b]] = np.inf
            parent, entry = best // k, best % k
            left = left[rows, parent] - book[entry]
            codes = np.concatenate((codes[rows, parent], entry[:, :, None].astype(np.uint8)), axis=2)
        miss = (left * left).sum(2)
        pick = np.argmin(miss, axis=1)
        at = rows[:, 0]
        return lists, codes[at, pick], np.linalg.norm(x - left[at, pick], axis=1), np.sqrt(miss[at, pick])

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The sums that the codes stand for: their products with a query are the sums of its products with centre and entries."""
        out = self.centres[lists]
        for m, book in enumerate(self.books):
            out += book[codes[:, m]]
        return out

    def scores(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """(vector, query) products of the coded vectors of one list with the queries."""
        total = np.repeat((self.centres[which] @ queries.T)[None, :], len(codes), axis=0)
        for m, book in enumerate(self.books):
            total += (book @ queries.T)[codes[:, m]]
        return total


def _cut(df: DataFrame, label: str) -> DataFrame:
    """`cut`, after which the plan's shuffles are removed, as nothing else reads them: they hold the vectors many times over."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return cut(df, label)
    finally:
        spark.conf.set(key, before)


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _binary(column, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _directions(unit: np.ndarray) -> pa.Array:
    """128 bits of each unit vector's rounded values: equal for vectors of equal direction."""
    return pa.array([hashlib.md5(r.tobytes()).digest() for r in np.round(unit, 10) + 0.0], pa.binary())


def fit(usable: DataFrame, dim: int, n_lists: int | None, books: int, entries: int, beam: int, seed: int) -> Quantiser | None:
    n = usable.count()
    if not n:
        return None
    if n_lists is None:
        n_lists = 1 << math.ceil(math.log2(2 * math.sqrt(n)))
    n_lists = max(1, min(n_lists, MOST_LISTS, n))
    bound = max(LEAST_SAMPLE, SAMPLE_PER_LIST * n_lists)
    # Chosen by a hash of the id, about 1.1 times the bound at most; the rest is cut off at the bound.
    chosen = usable.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, 1.1 * bound / n) * (1 << 30))).select("v").limit(bound)
    if bound > LEAST_SAMPLE:  # the limit's one partition would pass through the driver's heap as a whole
        chosen = chosen.repartition(math.ceil(bound / LEAST_SAMPLE))
    return Quantiser(_unit_sample(chosen.toArrow(), dim), n_lists, books, entries, beam, seed)


def _unit_sample(table: pa.Table, dim: int) -> np.ndarray:
    """The unit vectors of column v as 32-bit floats; beside them only a block is held in double."""
    sample, at = np.empty((table.num_rows, dim), np.float32), 0
    for batch in table.to_batches(max_chunksize=8192):
        sample[at : at + batch.num_rows] = _units(_matrix(batch.column("v"), dim))
        at += batch.num_rows
    return sample


class Index:
    """Classes of equal direction with their codes, and the members of each class."""

    def __init__(self, df: DataFrame, id_col: str, vec_col: str, *, dim: int, k: int = 10, n_lists: int | None = None, probes: int = 8, books: int = 8, entries: int = 256, beam: int = 3, seed: int = 0):
        self.spark, self.dim, self.k, self.probes = df.sparkSession, dim, k, probes
        self.usable = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & V.usable(F.col("v"), dim))
        quantiser = fit(self.usable, dim, n_lists, books, entries, beam, seed)
        self.quantiser = self.spark.sparkContext.broadcast(quantiser)
        shared = self.quantiser

        def encode(batches):
            q = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    unit = _units(_matrix(batch.column("v").slice(at, 2048), dim))
                    x = unit.astype(np.float32)
                    lists, codes, size, miss = q.encode(x)
                    columns = [
                        _directions(unit), pa.array(lists), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()),
                        pa.array(size.astype(np.float32)), pa.array(miss.astype(np.float32)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["direction", "list", "codes", "half", "norm", "miss"])

        # An id that comes with several vectors keeps the one of the smallest direction.
        once = _cut(self._directed(self.usable).groupBy("id").agg(F.min("direction").alias("direction")), "directions")
        self.reps = _cut(once.groupBy("direction").agg(F.min("id").alias("cls")), "reps")
        self.members = _cut(once.join(self.reps, "direction").select("id", "cls"), "members")
        coded = self.usable.select("v").mapInArrow(encode, "direction binary, list int, codes binary, half binary, norm float, miss float")
        first = coded.groupBy("direction").agg(F.first(F.struct("list", "codes", "half", "norm", "miss")).alias("c"))
        # In order of lists, as what `reached` computes for a batch is for each list in it.
        self.classes = _cut(first.join(self.reps, "direction").select("cls", "c.*").sortWithinPartitions("list"), "classes")
        nth = F.row_number().over(Window.partitionBy("cls").orderBy("id"))
        self.heads = self.members.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("cls", "id")

    def _directed(self, vectors: DataFrame) -> DataFrame:
        """vectors (id, v) with their direction."""
        dim = self.dim

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 8192):
                    part = batch.slice(at, 8192)
                    yield pa.RecordBatch.from_arrays([*part.columns, _directions(_units(_matrix(part.column("v"), dim)))], [*part.schema.names, "direction"])

        return vectors.mapInArrow(run, "id long, v array<float>, direction binary")

    def _searched(self, queries: DataFrame, bounded: bool, one_way: bool) -> DataFrame:
        """(query, qhalf, floor, group, lists): a row for each group of lists that has one of the query's."""
        shared, dim, probes = self.quantiser, self.dim, self.probes

        def run(batches):
            q = shared.value
            for batch in batches:
                step = max(1, min(512, CELLS // len(q.centres)))
                for at in range(0, batch.num_rows, step):
                    yield groups_of(q, batch.slice(at, step))

        def groups_of(q, batch):
            x = _binary(batch.column("half"), np.float16, dim).astype(np.float32)
            if bounded:  # half a unit of the last decimal, as the cosine is rounded
                radius = np.sqrt(np.maximum(2.0 - 2.0 * (batch.column("floor").to_numpy().astype(np.float64) - 1e-6), 0.0))
                row, lists = q.reached(x, batch.column("list").to_numpy(), radius, one_way)
            else:
                near = q.nearest(x, probes)
                row, lists = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
            group = q.group[lists]
            order = np.lexsort((lists, group, row))
            row, lists, group = row[order], lists[order], group[order]
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (group[1:] != group[:-1]))))
            ends = pa.array(np.append(new, len(row)).astype(np.int32))
            at = pa.array(row[new])
            return pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("cls", "half", "floor")] + [pa.array(group[new].astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(lists))], ["query", "qhalf", "floor", "group", "lists"])

        return queries.mapInArrow(run, "query long, qhalf binary, floor float, group int, lists array<int>")

    def near_classes(self, queries: DataFrame | None = None, *, least: float | None = None, depth: int = 64) -> DataFrame:
        """(cls, other, cosine in double) of different classes; `queries` names the classes to search for (cls), and may give a least cosine of each (floor)."""
        own_floor = queries is not None and "floor" in queries.columns
        floor = F.lit(least if least is not None else 0.0).cast("float").alias("floor")
        if queries is None:
            searched = self.classes.select("cls", "half", "list", floor)
        elif own_floor:
            searched = self.classes.select("cls", "half", "list").join(queries.groupBy("cls").agg(F.min("floor").cast("float").alias("floor")), "cls")
        else:
            searched = self.classes.join(queries.select("cls").distinct(), "cls", "left_semi").select("cls", "half", "list", floor)
        bounded = least is not None or own_floor
        searched = searched.select("cls", "half", "list", "floor")
        reached = lambda some: self._searched(some, bounded, queries is None)
        groups = [] if self.quantiser.value is None else self.quantiser.value.group.tolist()
        # One row a group of lists: fewer than the quantiser, which is broadcast as well, has centres.
        named = self.spark.createDataFrame(list(enumerate(groups)), "list int, group int")
        items = self.classes.select("list", "cls", "codes", "half", "norm", "miss").join(F.broadcast(named), "list")
        counted = lambda df, name: df.groupBy("group").agg(F.count("*").alias(name))
        counts = _cut(counted(items, "items").join(counted(reached(searched), "rows"), "group"), "blocks")
        total = counts.agg(F.sum("items").alias("items"), F.sum("rows").alias("rows")).first()
        passes = max(1, math.ceil((total["rows"] or 0) / max(ROWS_A_PASS, ROWS_A_VECTOR * (total["items"] or 0))))
        blocks = F.broadcast(counts.select("group", F.ceil(F.col("items") / BLOCK).cast("int").alias("n"), F.ceil(F.col("rows") / (BLOCK * passes)).cast("int").alias("m")))
        items = items.join(blocks, "group").select("group", F.pmod(F.xxhash64("cls"), "n").alias("a"), F.explode(F.expr("sequence(0L, m - 1L)")).alias("b"), "list", "cls", "codes", "half", "norm", "miss")
        shared, dim, k = self.quantiser, self.dim, self.k
        keep = k + 4

        def score(key, left, right):
            q = shared.value
            order = np.argsort(left.column("list").to_numpy(), kind="stable")
            left = left.take(pa.array(order))
            lists, cls, size, miss = (left.column(c).to_numpy() for c in ("list", "cls", "norm", "miss"))
            half = _binary(left.column("half"), np.float16, dim).astype(np.float32)
            coded = q.decode(lists, _binary(left.column("codes"), np.uint8, len(q.books)))
            found = []
            for at in range(0, right.num_rows, 1024):
                part = right.slice(at, 1024)
                mine, x, low = part.column("query").to_numpy(), _binary(part.column("qhalf"), np.float16, dim).astype(np.float32), part.column("floor").to_numpy()
                asked = part.column("lists").combine_chunks()
                whose, which = np.repeat(np.arange(len(mine)), np.diff(asked.offsets.to_numpy())), asked.flatten().to_numpy()
                i, j, product = [], [], []
                for one in np.unique(which):
                    first, end = np.searchsorted(lists, one), np.searchsorted(lists, one, side="right")
                    at_list = whose[which == one]
                    asking, least_of = x[at_list].T, low[at_list] - np.float32(HALF_MARGIN)
                    for a in range(first, end, SLICE):
                        b = min(a + SLICE, end)
                        total = coded[a:b] @ asking
                        if bounded:
                            total += miss[a:b, None]
                            p, r = np.nonzero(total >= least_of)
                        else:
                            total /= np.maximum(size[a:b], 1e-6)[:, None]
                            top = np.argpartition(-total, min(depth, b - a) - 1, axis=0)[: min(depth, b - a)]
                            p, r = top.ravel(), np.tile(np.arange(len(at_list)), len(top))
                        p, r = p + a, at_list[r]
                        for c in range(0, len(p), 1 << 17):
                            pp, rr = p[c : c + (1 << 17)], r[c : c + (1 << 17)]
                            value = np.einsum("nd,nd->n", half[pp], x[rr])
                            if bounded:
                                high = value >= low[rr] - HALF_MARGIN
                                pp, rr, value = pp[high], rr[high], value[high]
                            i.append(pp)
                            j.append(rr)
                            product.append(value)
                if not i:
                    continue
                i, j, product = np.concatenate(i), np.concatenate(j), np.concatenate(product)
                good = np.ones(len(i), bool)
                if not bounded:  # the best of each query in this block
                    order = np.lexsort((-product, j))
                    i, j, product = i[order], j[order], product[order]
                    good = np.arange(len(j)) - np.searchsorted(j, j) < keep + 1
                good &= cls[i] != mine[j]
                found.append((mine[j[good]], cls[i[good]], product[good]))
            if not found:
                return _NO_PAIRS
            return pa.table(dict(zip(("cls", "other", "product"), (np.concatenate(c) for c in zip(*found)))))

        def passed(number):
            """The pairs of one pass, which has all that is found for its queries."""
            some = searched.where(F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(passes)) == number) if passes > 1 else searched
            rows = reached(some).join(blocks, "group").select("group", F.explode(F.expr("sequence(0L, n - 1L)")).alias("a"), F.pmod(F.xxhash64("query"), "m").alias("b"), "query", "qhalf", "floor", "lists")
            pairs = items.groupBy("group", "a", "b").cogroup(rows.groupBy("group", "a", "b")).applyInArrow(_both(score), "cls long, other long, product float")
            if not bounded:
                nth = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("product"), "other"))
                pairs = pairs.withColumn("nth", nth).where(F.col("nth") <= keep)
            elif queries is None:  # found from either side
                pairs = pairs.select(F.least("cls", "other").alias("cls"), F.greatest("cls", "other").alias("other")).distinct()
            return _cut(pairs.select("cls", "other"), "pairs")

        pairs = reduce(DataFrame.unionByName, [passed(number) for number in range(passes)])
        exact = self._exact(pairs.distinct() if passes > 1 else pairs)
        if least is None:
            return exact
        exact = _cut(exact.where(F.round("cosine", 6) >= least), "near")
        return exact if queries is not None else exact.unionByName(exact.select(F.col("other").alias("cls"), F.col("cls").alias("other"), "cosine"))

    def _exact(self, pairs: DataFrame) -> DataFrame:
        """(cls, other, cosine in double): vectors are read only for the classes that are in a pair."""
        # Written first, so that its size decides how the vectors are joined with it.
        wanted = _cut(pairs.select(F.explode(F.array("cls", "other")).alias("cls")).distinct().join(self.reps, "cls").select(F.col("cls").alias("id"), "direction"), "wanted")
        there = self.usable.join(wanted.select("id"), "id", "left_semi")
        vectors = _cut(self._directed(there).join(wanted, ["id", "direction"]).groupBy("id").agg(F.first("v").alias("v")), "vectors")
        own, other = vectors.select(F.col("id").alias("cls"), F.col("v").alias("x")), vectors.select(F.col("id").alias("other"), F.col("v").alias("y"))
        dim = self.dim

        def cosines(batches):
            for batch in batches:
                x, y = (_matrix(batch.column(c), dim).astype(np.float64) for c in ("x", "y"))
                x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
                cosine = np.einsum("nd,nd->n", x, y) / np.sqrt(np.einsum("nd,nd->n", x, x) * np.einsum("nd,nd->n", y, y))
                yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("other"), pa.array(cosine)], ["cls", "other", "cosine"])

        return pairs.join(own, "cls").join(other, "other").select("cls", "other", "x", "y").mapInArrow(cosines, "cls long, other long, cosine double")

    def neighbours(self, queries: DataFrame | None = None, *, least: float | None = None, depth: int = 64, exact: bool = False) -> DataFrame:
        """(id, other, cosine, pos): up to k others of each id of `queries` (column id), or of every id.

        `exact` is for a stated set of queries: what a search of the nearest lists
        finds gives each query a least cosine, and with that every list that may hold more.
        """
        asked = self.members if queries is None else self.members.join(queries.select("id").distinct(), "id", "left_semi")
        if not exact:
            return self._ranked(asked, self.near_classes(None if queries is None else asked, least=least, depth=depth))
        asked = _cut(asked, "asked")
        first = self._ranked(asked, self.near_classes(asked, depth=depth)).groupBy("id").agg(F.min("cosine").alias("c"), F.count("*").alias("n"))
        # Half a unit of the last decimal, as the cosine is rounded; a query with too few others takes all.
        floor = F.when(F.col("n") == self.k, F.col("c") - 1e-6).otherwise(-2.0)
        floors = _cut(asked.join(first, "id", "left").select("cls", F.coalesce(floor, F.lit(-2.0)).alias("floor")), "floors")
        return self._ranked(asked, self.near_classes(floors))

    def _ranked(self, asked: DataFrame, near: DataFrame) -> DataFrame:
        own = asked.select("cls").distinct().select("cls", F.col("cls").alias("other"), F.lit(1.0).alias("cosine"))
        options = near.unionByName(own).join(self.heads.toDF("other", "oid"), "other")
        options = options.select("cls", F.struct((-F.round("cosine", 6)).alias("minus"), F.col("oid").alias("id")).alias("o"))
        # Each class has at most k + 1 options: any member takes the first k that aren't itself.
        nth = F.row_number().over(Window.partitionBy("cls").orderBy("o"))
        ranked = options.withColumn("nth", nth).where(F.col("nth") <= self.k + 1).groupBy("cls").agg(F.array_sort(F.collect_list("o")).alias("best"))
        chosen = asked.join(ranked, "cls").select("id", F.slice(F.filter("best", lambda o: o.id != F.col("id")), 1, self.k).alias("best"))
        out = chosen.select("id", F.posexplode("best").alias("pos", "o"))
        return out.select("id", F.col("o.id").alias("other"), (-F.col("o.minus")).alias("cosine"), (F.col("pos") + 1).alias("pos"))


_NO_PAIRS = pa.table({"cls": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "product": pa.array([], pa.float32())})


def _both(score):
    """Only blocks with vectors on both sides have anything to score."""
    none = _NO_PAIRS

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return score(key, left, right) if left.num_rows and right.num_rows else none

    return run


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, *, dim: int, least: float, k: int = 10, **options) -> DataFrame:
    """(lo, hi): pairs at or above the least cosine where one is among the k most similar of the other."""
    found = Index(df, id_col, vec_col, dim=dim, k=k, **options).neighbours(least=least)
    return found.where(F.col("cosine") >= least).select(F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi")).distinct()
