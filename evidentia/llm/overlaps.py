"""Same or near-same records across splits by a suffix array of their words.

A record is its key (the wanted answer) and the distinct words of its text.
Words are put in one global order, rarest first by their counts over all
records, which makes records canonical texts: equal word sets are equal texts,
and similar ones share spans. The suffixes of these texts that may start a
needed span are sorted over range partitions by their first `DEPTH` words. A
pass over each partition compares adjacent suffixes: where their common prefix
is shorter than a needed span, a run ends; runs of one split only are dropped;
in the others every two suffixes of different splits give the span that they
share, from where the words before it differ. Runs that reach a partition's edge
or hold too many suffixes leave the pass as they are and are joined. The spans
of two records are merged into the words covered; what is left is counted
exactly on the whole word sets.

Why this finds all pairs: of two sets of m and n words that reach the similarity,
at least c = ceil(t / (1 + t) * (m + n)) words are shared, and at most
d = m + n - 2c are not. The words that aren't shared cut the first
k = (L - 1)(d + 1) + 1 shared ones into at most d + 1 spans, so one of them has
L words; it starts at place m - c + k - L or before, which is never beyond
L (1 - t) m. `needed_span` is the largest L up to `SPAN` with k <= c for all sizes.

Equal records form one class; only classes are sorted and joined, so a group of
copies of any size is one entry. Defined cases: records with a null id, key,
text or split, and texts without words, overlap nothing; keys compare after
trimming and lower-casing; a repeated id counts once, with its smallest text,
key and split; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.session import cut

#: Words of a suffix that are compared, words that a span must have where sizes allow, and suffixes of a run that one task pairs.
DEPTH, SPAN, MOST_SUFFIXES = 8, 2, 512
_SPANS = "k long, s array<long>, cls binary, size int, place int, before long, trained boolean, tested boolean, train_cls binary, test_cls binary, length int"


def word_set(text: Column) -> Column:
    """The distinct words of a text, by code point."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))))


def records(df: DataFrame, id_col: str, text_col: str, key_col: str, split_col: str, train: str) -> DataFrame:
    """(id, key, words, split, trained, cls): one row per usable id."""
    once = df.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.lower(F.trim(F.col(key_col).cast("string"))).alias("key"), F.col(split_col).alias("split")
    ).groupBy("id").agg(*[F.min(c).alias(c) for c in ("text", "key", "split")])
    usable = once.where("id is not null and key is not null and split is not null").select("id", "key", "split", word_set(F.col("text")).alias("words")).where("size(words) > 0")
    return usable.select("*", (F.col("split") == train).alias("trained"), F.unhex(F.md5(F.concat_ws("\x1f", "key", F.array_join("words", " ")))).alias("cls"))


def needed_span(similarity: float) -> int:
    """Words of the longest span that two different similar sets of any sizes share for certain, SPAN at most."""
    least = SPAN
    for m in range(1, 200):
        for n in range(m, math.floor(m / similarity + 1e-9) + 1):
            c = math.ceil(similarity / (1 + similarity) * (m + n) - 1e-9)
            if (d := m + n - 2 * c) > 0:
                least = min(least, (c - 1) // (d + 1) + 1)
    return least


def _canonical(classes: DataFrame) -> DataFrame:
    """(cls, k, trained, tested, size, words): hashes of each class's words, rarest first, with zeros behind them."""
    exploded = classes.select("cls", F.xxhash64("key").alias("k"), "trained", "tested", F.explode(F.transform("words", lambda w: F.xxhash64(w))).alias("word"))
    counts = exploded.groupBy("word").agg(F.count("*").alias("n"))
    parts = exploded.join(counts, "word").groupBy("cls", "k", "trained", "tested").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("words"))
    words = F.concat(F.transform("words", lambda x: x["word"]), F.array_repeat(F.lit(0).cast("long"), DEPTH))
    return parts.select("cls", "k", "trained", "tested", F.size("words").alias("size"), words.alias("words"))


def _suffixes(canonical: DataFrame, similarity: float, span: int) -> DataFrame:
    """The suffixes that may start a needed span: their first DEPTH words, their place, and the word before."""
    last = F.least(F.floor(span * (1 - similarity) * F.col("size") + 1e-9).cast("int"), F.col("size") - span)
    word = F.col("words")
    suffix = lambda p: F.struct(p.alias("place"), F.slice(word, p + 1, F.lit(DEPTH)).alias("s"), F.when(p > 0, F.get(word, p - 1)).alias("before"))
    made = canonical.where(F.col("size") >= span).select("cls", "k", "trained", "tested", "size", F.explode(F.transform(F.sequence(F.lit(0), last), suffix)).alias("x"))
    return made.select("k", "x.s", "cls", "size", "x.place", "x.before", "trained", "tested")


def _wanted(m, n, p, q, similarity: float):
    """Whether two suffixes at these places leave as many words to share as the sizes demand."""
    return np.minimum(p, q) + np.minimum(m - p, n - q) >= np.ceil(similarity / (1 + similarity) * (m + n) - 1e-9)


def _spans(similarity: float, span: int):
    """The pass over a sorted partition: the spans of complete runs, and the suffixes of the others as they are."""
    fields = _SPANS.split(", ")
    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}[f.split()[1]]) for f in fields])

    def rows(part: pa.Table, **more) -> list[pa.RecordBatch]:
        columns = {c: part.column(c) for c in part.column_names} | more
        n = part.num_rows if part.num_columns else len(next(iter(more.values())))
        return pa.table([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema).to_batches()

    def pairs(part: pa.Table, words: np.ndarray, run: np.ndarray):
        """All two suffixes of a run where one is of train and the other isn't."""
        trained, tested = (part.column(c).to_numpy(zero_copy_only=False) for c in ("trained", "tested"))
        a, b = np.flatnonzero(trained), np.flatnonzero(tested)
        begin, end = np.searchsorted(run[b], run[a], "left"), np.searchsorted(run[b], run[a], "right")
        i = np.repeat(a, end - begin)
        j = b[np.arange(len(i)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin, end - begin)]
        size, place, before = (part.column(c).to_numpy(zero_copy_only=False) for c in ("size", "place", "before"))
        # A span begins where the words before it differ; the others are parts of it.
        good = (i != j) & _wanted(size[i], size[j], place[i], place[j], similarity) & ((place[i] == 0) | (place[j] == 0) | (before[i] != before[j]))
        i, j = i[good], j[good]
        common = np.cumprod((words[i] == words[j]) & (words[i] != 0), axis=1).sum(1)
        cls = part.column("cls").combine_chunks()
        return rows(pa.table({}), train_cls=cls.take(pa.array(i)), test_cls=cls.take(pa.array(j)), length=pa.array(common, pa.int32()))

    def done(part: pa.Table, first: bool, last: bool):
        """All runs of a sorted stretch; the first or the last may go on in another partition."""
        words = part.column("s").combine_chunks().flatten().to_numpy().reshape(-1, DEPTH)
        k = part.column("k").to_numpy()
        shared = np.cumprod((words[1:] == words[:-1]) & (words[1:] != 0), axis=1).sum(1) * (k[1:] == k[:-1])
        run = np.concatenate(([0], np.cumsum(shared < span)))
        n = run[-1] + 1
        size = np.bincount(run, minlength=n)
        trained, tested = (np.bincount(run, part.column(c).to_numpy(zero_copy_only=False), minlength=n) > 0 for c in ("trained", "tested"))
        is_open = size > MOST_SUFFIXES
        is_open[0] |= first
        is_open[-1] |= last
        left = is_open & ((trained & tested) | (np.arange(n) == 0) & first | (np.arange(n) == n - 1) & last)
        if left.any():
            yield from rows(part.filter(pa.array(left[run])))
        inside = ~is_open & trained & tested & (size > 1)
        if inside.any():
            keep = inside[run]
            yield from pairs(part.filter(pa.array(keep)), words[keep], run[keep])

    def go(batches):
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            part = part if held is None else pa.concat_tables([held, part])
            head = part.column("s").slice(part.num_rows - 1)[0].as_py()[:span], part.column("k")[part.num_rows - 1].as_py()
            at = part.num_rows - 1  # where the last run begins
            while at > 0 and (part.column("s")[at - 1].as_py()[:span], part.column("k")[at - 1].as_py()) == head and part.num_rows - at <= MOST_SUFFIXES:
                at -= 1
            if part.num_rows - at > MOST_SUFFIXES:  # too long to be held: it leaves as it is, and so does its rest
                yield from done(part, first, True)
                held, first = None, True
                continue
            if at:
                yield from done(part.slice(0, at), first, False)
                first = False
            held = part.slice(at)
        if held is not None:
            yield from done(held, first, True)

    return go


def overlapping_classes(recs: DataFrame, similarity: float) -> DataFrame:
    """(train_cls, test_cls, n_shared, n_either): classes of different word sets, one with a train record, one with another."""
    span = needed_span(similarity)
    classes = recs.groupBy("cls").agg(F.first("key").alias("key"), F.first("words").alias("words"), F.bool_or("trained").alias("trained"), F.bool_or(~F.col("trained")).alias("tested"))
    classes = cut(classes, "classes")
    order = ["k", "s", "cls"]
    array = _suffixes(cut(_canonical(classes), "canonical"), similarity, span).repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut(array.mapInArrow(_spans(similarity, span), _SPANS), "spans")
    spans = found.where("length is not null").select("train_cls", "test_cls", "length").unionByName(_joined(found.where("length is null"), similarity, span))
    # The spans of two records, merged: how many words they cover.
    pairs = spans.groupBy("train_cls", "test_cls").agg(F.sum("length").alias("covered")).where(F.col("covered") >= span)
    words = classes.select("cls", "words")
    both = pairs.join(words.toDF("train_cls", "train_words"), "train_cls").join(words.toDF("test_cls", "test_words"), "test_cls")
    both = both.withColumn("n_shared", F.size(F.array_intersect("train_words", "test_words")))
    both = both.withColumn("n_either", F.size("train_words") + F.size("test_words") - F.col("n_shared"))
    return both.where(F.col("n_shared") >= similarity * F.col("n_either") - 1e-9).select("train_cls", "test_cls", "n_shared", "n_either")


def _joined(left: DataFrame, similarity: float, span: int) -> DataFrame:
    """The spans of the suffixes of unfinished runs; a long run is a skewed key, which Spark splits."""
    left = left.withColumn("head", F.slice("s", 1, span))
    a = left.where("trained").select("k", "head", F.col("cls").alias("train_cls"), F.col("s").alias("x"), F.col("size").alias("m"), F.col("place").alias("p"), F.col("before").alias("u"))
    b = left.where("tested").select("k", "head", F.col("cls").alias("test_cls"), F.col("s").alias("y"), F.col("size").alias("n"), F.col("place").alias("q"), F.col("before").alias("v"))
    need = F.ceil((F.col("m") + F.col("n")) * (similarity / (1 + similarity)) - 1e-9)
    met = a.join(b, ["k", "head"]).where((F.col("train_cls") != F.col("test_cls")) & (F.least("p", "q") + F.least(F.col("m") - F.col("p"), F.col("n") - F.col("q")) >= need))
    met = met.where("p = 0 or q = 0 or u <> v")
    differ = F.array_position(F.zip_with("x", "y", lambda x, y: (x == y) & (x != 0)), False).cast("int")
    return met.select("train_cls", "test_cls", F.when(differ > 0, differ - 1).otherwise(DEPTH).alias("length"))


def overlap_pairs(df: DataFrame, id_col: str, text_col: str, key_col: str, split_col: str, *, train: str = "train", similarity: float = 0.8) -> DataFrame:
    """(id_lo, id_hi): every pair of a train record and another split's record that overlap."""
    recs = cut(records(df, id_col, text_col, key_col, split_col, train), "records")
    pairs = overlapping_classes(recs, similarity).select("train_cls", "test_cls")
    same = recs.groupBy("cls").agg(F.bool_or("trained").alias("x"), F.bool_or(~F.col("trained")).alias("y")).where("x and y").select(F.col("cls").alias("train_cls"), F.col("cls").alias("test_cls"))
    a = recs.where("trained").select(F.col("id").alias("a"), F.col("cls").alias("train_cls"))
    b = recs.where("not trained").select(F.col("id").alias("b"), F.col("cls").alias("test_cls"))
    found = pairs.unionAll(same).join(a, "train_cls").join(b, "test_cls")
    return found.select(F.least("a", "b").alias("id_lo"), F.greatest("a", "b").alias("id_hi"))


def overlap_report(df: DataFrame, id_col: str, text_col: str, key_col: str, split_col: str, source_col: str, *, train: str = "train", similarity: float = 0.8) -> DataFrame:
    """(split, source, n_records, n_same, n_near) of the splits other than train.

    n_same counts records whose words and key also occur in train, n_near those
    that only nearly do. A record counts for each source it is listed with;
    null sources are `(none)`.
    """
    recs = cut(records(df, id_col, text_col, key_col, split_col, train), "records")
    near = overlapping_classes(recs, similarity).select(F.col("test_cls").alias("cls"), F.lit(1).alias("near")).distinct()
    same = recs.where("trained").select("cls", F.lit(1).alias("same")).distinct()
    marked = recs.where("not trained").join(same, "cls", "left").join(near, "cls", "left").select("id", "split", "same", "near")
    sources = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(source_col), F.lit("(none)")).alias("source")).distinct()
    near_only = F.when(F.col("same").isNull() & F.col("near").isNotNull(), 1)
    return marked.join(sources, "id").groupBy("split", "source").agg(F.count("*").alias("n_records"), F.count("same").alias("n_same"), F.count(near_only).alias("n_near"))


def overlap_coverage(df: DataFrame, id_col: str, text_col: str, key_col: str, split_col: str, *, train: str = "train", similarity: float = 0.8) -> DataFrame:
    """(id, n_classes, covered): for each record of another split that overlaps train, how many different train records it does with, and the largest share of its words found in one of them."""
    recs = cut(records(df, id_col, text_col, key_col, split_col, train), "records")
    near = overlapping_classes(recs, similarity).select("train_cls", F.col("test_cls").alias("cls"), "n_shared")
    same = recs.groupBy("cls").agg(F.bool_or("trained").alias("x"), F.first(F.size("words")).alias("n_shared")).where("x").select(F.col("cls").alias("train_cls"), "cls", "n_shared")
    best = near.unionByName(same).groupBy("cls").agg(F.count("*").alias("n_classes"), F.max("n_shared").alias("most"))
    mine = recs.where("not trained").select("id", "cls", F.size("words").alias("size"))
    return mine.join(best, "cls").select("id", "n_classes", (F.col("most") / F.col("size")).alias("covered"))
