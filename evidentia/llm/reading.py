"""Reading level of each document by gradient-boosted regression trees.

Every sentence of prose gets a grade: the mean of the levels that its words make
likely. What words tell of levels is fitted to the sentences of the labelled
documents in rounds: counted first at the levels of the documents, then at the
likely levels of the sentences, as documents mix sentences of several levels.
A document is described by distributions: of the grades of its sentences
(cumulative shares), of sentence and word lengths, of marks (syntax), of its
vocabulary, and of the words that neighbouring sentences share (cohesion).
Boosted trees are trained on these.

Cross-validation is by source: the word levels and the trees that grade a
labelled document come from documents of other groups of sources (with labels
from fewer than three sources, of other ids, and a warning says so). Those
held-out predictions calibrate the grades: between two levels lies the cut that
parts the labels with the fewest errors, which a few wrong labels hardly move,
and grades are stretched so that the cuts are at 1.5, 2.5 and 3.5. Training takes at most `MOST_LABELS` labelled documents
(chosen by a hash of the id); word counts, features and predictions cover every
document, in full.

Prose is what is left without tags, headings, list items, tables, code, addresses and
lines without letters. A hyphen at a line's end is taken back. A sentence ends
at `.`, `!`, `?` or `;` before white space. In a text with hardly a mark,
sentences end at line breaks instead, and as lines may break them, each counts
by its words over the usual words of a sentence of its grade.

Defined cases: null ids, texts and (for labels) levels outside 1 to 4 don't
count; a repeated label counts once, unequal ones of a document by their mean;
a repeated document counts once, with its highest level; a document without
prose, or without a known word, has the usual shares of sentences and a mark that
it has none, and is graded by its other features; without any label no row is graded.
"""

from __future__ import annotations

import re
import warnings
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import _text
from evidentia.session import cut

MOST_LABELS, FOLDS, LEAST_DOCUMENTS = 20_000, 3, 3
#: How often the words' levels are fitted anew to the sentences, the first share of sentences at their document's level.
ROUNDS, OWN_SHARE = 3, 0.7
LEVELS, LEAST_WEIGHT, MOST_WORDS = 4, 0.05, 1000
#: Upper ends of the grade bins.
GRADES = np.arange(1.25, 4.0, 0.25)
BINS = len(GRADES) + 1
_HYPHEN = re.compile(r"(?<=[A-Za-z])-[ \t]*\n[ \t]*(?=[a-z])")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|&nbsp;")
_OTHER = re.compile(r"^(?:[ \t]*(?:[-*+•◦▪#|>~`<]|\d+[.)][ \t]|https?:).*|.*[\t|{}=<>].*|[^A-Za-z\n]*)$", re.M)
_LEVEL_SUMS = tuple(f"c{k + 1}" for k in range(LEVELS))
_OTHER_FEATURES = ("words", "letters_a_word", "long_words", "words_a_sentence", "words_90th", "commas_a_sentence", "distinct_share", "shared_next", "mean_grade", "known_share", "marked")


def prose(text: str) -> str:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _OTHER.sub("", _HYPHEN.sub("", text))


class Lexicon:
    """For words by their hash: the logarithm of how much likelier each level makes them, and the information they give."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, counts = hashes[order], counts[order]
        if not len(hashes):
            return
        share = (counts.sum(0) + 1) / (counts.sum() + LEVELS)
        # As if seen once more, at all levels alike.
        ratio = (counts + share) / (counts.sum(1, keepdims=True) * share + share)
        self.logs = np.clip(np.log(ratio), -3, 3)
        self.weight = (share * ratio * np.log(ratio)).sum(1)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros((len(hashes), LEVELS)), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        return np.where(hit[:, None], self.logs[at], 0.0), np.where(hit, self.weight[at], 0.0)


def _posterior(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _by_sentence(sid: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(sid, values[:, k], minlength=n) for k in range(values.shape[1])], 1)


def _ratio(a, b):
    return a / np.maximum(b, 1e-9)


class _Sentences:
    """The words of several texts' prose, the sentence of each, and the row of each sentence."""

    def __init__(self, texts: list[str]):
        n = len(texts)
        self.words = w = _text.Words([prose(t) for t in texts])
        codes, rows = w.codes, w.rows
        # Sentence ends; the dots of `e.g.` and the like don't count.
        after, before = np.append(codes[1:], 10), np.concatenate(([0, 0], codes[:-2]))[: len(codes)]
        mark = np.isin(codes, [46, 33, 63, 59]) & np.isin(after, [32, 10, 9]) & ~((codes == 46) & (before == 46))
        place = np.flatnonzero(mark)
        marks = np.bincount(np.searchsorted(w.bounds, place), minlength=n)[:n]
        self.n_words = np.bincount(rows, minlength=n)
        self.marked = marks * 60 >= self.n_words
        breaks = np.flatnonzero(codes == 10)
        row_of_break = np.minimum(np.searchsorted(w.bounds, breaks), n - 1)
        ends = np.sort(np.concatenate((place, breaks[~self.marked[row_of_break]])))
        sentence = np.searchsorted(ends, w.starts)
        new = np.concatenate(([True], (sentence[1:] != sentence[:-1]) | (rows[1:] != rows[:-1])))[: len(rows)]
        self.sid, self.of_row = np.cumsum(new) - 1, rows[new]


def _describe(texts: list[str], folds: list[int], lexicons: dict[int, Lexicon]):
    """Per text: sentences by grade bin, words by grade bin, and the other features."""
    n = len(texts)
    counts, sizes, other = np.zeros((n, BINS)), np.zeros((n, BINS)), np.zeros((n, len(_OTHER_FEATURES)))
    parts = _Sentences(texts)
    w, sid, of_row, marked, all_words = parts.words, parts.sid, parts.of_row, parts.marked, parts.n_words
    codes, rows = w.codes, w.rows
    if not len(w.starts):
        return counts, sizes, other
    logs, weight = np.zeros((len(rows), LEVELS)), np.zeros(len(rows))
    fold_of = np.asarray(folds)[rows]
    for k in np.unique(fold_of):
        mine = fold_of == k
        logs[mine], weight[mine] = lexicons[int(k)].of(w.hashes[mine])
    size, total = np.bincount(sid), np.bincount(sid, weight)
    grade = _posterior(_by_sentence(sid, len(size), logs)) @ np.arange(1, LEVELS + 1)
    real = (total >= LEAST_WEIGHT) & (size >= 2)
    bins = np.searchsorted(GRADES, grade)
    np.add.at(counts, (of_row[real], bins[real]), 1)
    np.add.at(sizes, (of_row[real], bins[real]), size[real])

    letters = (w.ends - w.starts).astype(float)
    sentences = np.bincount(of_row, minlength=n)
    order = np.lexsort((size, of_row))
    first = np.searchsorted(of_row[order], np.arange(n))
    ninetieth = size[order][np.minimum(first + (sentences * 9) // 10, len(order) - 1)]
    by_word = np.lexsort((w.hashes, rows))  # stable: sentences stay in order
    same = (w.hashes[by_word][1:] == w.hashes[by_word][:-1]) & (rows[by_word][1:] == rows[by_word][:-1])
    repeated = np.bincount(rows[by_word][1:][same], minlength=n)
    close = same & (np.diff(sid[by_word]) == 1)
    shared = np.bincount(rows[by_word][1:][close], minlength=n)
    commas = np.bincount(np.minimum(np.searchsorted(w.bounds, np.flatnonzero(codes == 44)), n - 1), minlength=n)
    known = np.bincount(rows, weight > LEAST_WEIGHT, minlength=n)
    mean_grade = _ratio(np.bincount(of_row[real], grade[real], minlength=n), np.bincount(of_row[real], minlength=n))
    # Counts are bounded and set against others, so that no length alone can tell a level.
    columns = (
        np.minimum(all_words, MOST_WORDS), _ratio(np.bincount(rows, letters, minlength=n), all_words), _ratio(np.bincount(rows, letters > 9, minlength=n), all_words), _ratio(all_words, sentences),
        np.where(sentences > 0, ninetieth, 0), _ratio(commas, sentences), np.log(np.maximum(all_words - repeated, 1)) / np.log(np.maximum(all_words, 2)), _ratio(shared, all_words),
        mean_grade, _ratio(known, all_words), marked,
    )
    return counts, sizes, np.stack([np.asarray(c, float) for c in columns], 1)


def _described(df: DataFrame, lexicons) -> DataFrame:
    """(id, n_words, counts, sizes, other and the other columns of df) for df (id, text, fold, ...)."""
    kept = [c for c in df.columns if c != "text"]

    def run(batches):
        for batch in batches:
            texts, folds = batch.column("text").to_pylist(), batch.column("fold").to_pylist()
            for a, b in _text.slices(texts):
                described = _describe(texts[a:b], folds[a:b], lexicons.value)
                whole = np.bincount(_text.words(texts[a:b])[0], minlength=b - a)
                arrays = [batch.column(c).slice(a, b - a) for c in kept] + [pa.array(whole, pa.int32())]
                for x in described:
                    offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                    arrays.append(pa.ListArray.from_arrays(offsets, pa.array(x.ravel())))
                yield pa.RecordBatch.from_arrays(arrays, [*kept, "n_words", "counts", "sizes", "other"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "text"]
    return df.mapInArrow(run, ", ".join([*fields, "n_words int", "counts array<double>", "sizes array<double>", "other array<double>"]))


def _features(usual: list[float], shares: list[float]) -> Column:
    """The cumulative shares of sentences by grade, their median, whether there are any, then the other features, as one vector.

    A text without graded sentences has the shares of the labelled documents.
    """
    marked = F.element_at("other", -1) > 0
    typical = F.array(*[F.lit(x) for x in usual])
    amount = F.when(marked, F.col("counts")).otherwise(F.zip_with("sizes", typical, lambda x, y: x / y))
    total = F.aggregate(amount, F.lit(0.0), lambda s, x: s + x)
    upto = [F.when(total > 0, F.aggregate(F.slice(amount, 1, k + 1), F.lit(0.0), lambda s, x: s + x) / total).otherwise(F.lit(shares[k])) for k in range(BINS - 1)]
    # The bin of the median sentence: where more than half are of one level, it is of that level.
    median = F.aggregate(F.array(*upto), F.lit(0.0), lambda s, x: s + F.when(x < 0.5, 1.0).otherwise(0.0))
    return array_to_vector(F.concat(F.array(*upto), F.array(median, (total > 0).cast("double")), F.col("other")))


def _sentence_words(labelled: DataFrame) -> DataFrame:
    """(fold, level, words, sentences): the words of each labelled document's prose and the sentence of each."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _text.slices(texts):
                parts = _Sentences(texts[a:b])
                ends = pa.array(np.concatenate(([0], np.cumsum(parts.n_words))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (parts.words.hashes.view(np.int64), parts.sid.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("fold").slice(a, b - a), batch.column("level").slice(a, b - a), *lists], ["fold", "level", "words", "sentences"])

    return labelled.select("text", "level", "fold").mapInArrow(run, "fold int, level double, words array<long>, sentences array<int>")


def _prior(level: np.ndarray) -> np.ndarray:
    """The share of each level in a document's sentences as its label has it; a label between two levels is split."""
    own = np.maximum(0, 1 - np.abs(level[:, None] - np.arange(1, LEVELS + 1)))
    return OWN_SHARE * own + (1 - OWN_SHARE) / (LEVELS - 1) * (1 - own)


def _counted(sentences: DataFrame, lexicons) -> DataFrame:
    """(word, without, docs, c1 to c4): documents with the word, and its occurrences by the level of their sentence, without each fold."""

    def run(batches):
        for batch in batches:
            words = batch.column("words")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))
            hashes, sid = words.flatten().to_numpy(), batch.column("sentences").flatten().to_numpy()
            if not len(hashes):
                continue
            new = np.concatenate(([True], (sid[1:] != sid[:-1]) | (doc[1:] != doc[:-1])))
            sid, of_doc = np.cumsum(new) - 1, doc[new]
            prior, fold = np.log(_prior(batch.column("level").to_numpy())), batch.column("fold").to_numpy()
            for k in range(-1, FOLDS):
                mine = fold[doc] != k
                if not mine.any():
                    continue
                logs = 0.0 if lexicons is None else _by_sentence(sid, len(of_doc), lexicons.value[k].of(hashes.view(np.uint64))[0])
                level = _posterior(prior[of_doc] + logs)[sid[mine]]
                kinds, at = np.unique(hashes[mine], return_inverse=True)
                docs = np.bincount(np.unique(at * np.int64(batch.num_rows) + doc[mine]) // batch.num_rows, minlength=len(kinds))
                sums = _by_sentence(at, len(kinds), level)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.full(len(kinds), k, np.int32)), pa.array(docs)] + [pa.array(sums[:, j]) for j in range(LEVELS)], ["word", "without", "docs", *_LEVEL_SUMS])

    return sentences.mapInArrow(run, "word long, without int, docs long, " + ", ".join(f"{c} double" for c in _LEVEL_SUMS))


def _lexicons(labelled: DataFrame):
    """What words tell of levels, without each fold, and (fold -1) of all labelled documents.

    A document of one level holds sentences of others: words are first counted at
    their documents' levels, then at the likely levels of their sentences.
    """
    spark = labelled.sparkSession
    sentences, lexicons = cut(_sentence_words(labelled), "sentences"), None
    for _ in range(1 + ROUNDS):
        sums = _counted(sentences, lexicons).groupBy("word", "without").agg(F.sum("docs").alias("docs"), *[F.sum(c).alias(c) for c in _LEVEL_SUMS])
        # At most as many rows as the bounded sample of labelled documents has common words, for each fold.
        table = sums.where(F.col("docs") >= LEAST_DOCUMENTS).toArrow()
        word, without = table.column("word").to_numpy().view(np.uint64), table.column("without").to_numpy()
        counts = np.stack([table.column(c).to_numpy() for c in _LEVEL_SUMS], 1)
        if lexicons is not None:
            lexicons.destroy()
        lexicons = spark.sparkContext.broadcast({k: Lexicon(word[without == k], counts[without == k]) for k in range(-1, FOLDS)})
    return lexicons


def _folds(labelled: DataFrame) -> DataFrame:
    """Labelled documents with a fold each: whole sources, the largest first, to the emptiest fold."""
    sizes = labelled.groupBy("source").count().orderBy(F.desc("count"), "source").collect()  # no more than labelled documents
    filled, fold_of = [0] * FOLDS, {}
    for row in sizes:
        k = min(range(FOLDS), key=lambda i: filled[i])
        fold_of[row.source], filled[k] = k, filled[k] + row["count"]
    if len(fold_of) < FOLDS:
        warnings.warn(f"{len(fold_of)} sources have labels: documents are held out by their ids instead of by source", stacklevel=2)
        return labelled.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int"))
    plan = labelled.sparkSession.createDataFrame(list(fold_of.items()), "source string, fold int")
    return labelled.join(F.broadcast(plan), "source")


def _cuts(held) -> list[float]:
    """Between each two levels the cut with the fewest held-out errors, the one nearest the middle if several."""
    level, grade = np.round(held.column("level").to_numpy()), held.column("grade").to_numpy()
    options = np.unique(np.round(np.concatenate((grade, np.arange(1.5, 4))), 3))
    cuts = []
    for k in (1, 2, 3):
        below, above = np.sort(grade[level <= k]), np.sort(grade[level > k])
        errors = len(below) - np.searchsorted(below, options, "right") + np.searchsorted(above, options, "right")
        best = options[(errors == errors.min()) & (options > (cuts[-1] + 0.05 if cuts else -np.inf))]
        if not len(best):
            best = np.array([cuts[-1] + 1.0])
        cuts.append(float(best[np.argmin(np.abs(best - (k + 0.5)))]))
    return cuts


class ReadingModel:
    """Word levels, trees and calibration fitted on labelled documents; `held_out` has (id, source, level, grade)."""

    def __init__(self, df: DataFrame, labels: DataFrame, id_col: str, text_col: str, source_col: str, level_col: str, *, rounds: int = 12, depth: int = 3, seed: int = 0):
        spark = df.sparkSession
        documents = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.regexp_replace(F.lower(F.trim(source_col)), "-", "_"), F.lit("none")).alias("source"))
        rated = labels.select(F.col(id_col).alias("id"), F.col(level_col).cast("double").alias("level")).where("id is not null and level between 1 and 4").distinct()
        rated = rated.groupBy("id").agg(F.avg("level").alias("level")).orderBy(F.xxhash64("id"), "id").limit(MOST_LABELS)
        # At most MOST_LABELS rows are broadcast.
        labelled = documents.where("id is not null and text is not null").join(F.broadcast(rated), "id").dropDuplicates(["id"])
        labelled = cut(_folds(cut(labelled, "labelled")), "labelled")
        self.empty = labelled.isEmpty()
        if self.empty:
            return
        self.lexicons = _lexicons(labelled)
        described = cut(_described(labelled.select("id", "text", "source", "level", "fold"), self.lexicons), "described")
        sums = described.where(F.element_at("other", -1) > 0).agg(*[F.sum(F.element_at(c, k + 1)).alias(f"{c}{k}") for c in ("counts", "sizes") for k in range(BINS)]).first()
        whole = sum(sums[f"sizes{k}"] or 0 for k in range(BINS)) / max(1, sum(sums[f"counts{k}"] or 0 for k in range(BINS))) or 15.0
        self.usual = [((sums[f"sizes{k}"] or 0) + whole) / ((sums[f"counts{k}"] or 0) + 1) for k in range(BINS)]
        total = max(1.0, sum(sums[f"counts{k}"] or 0 for k in range(BINS)))
        self.shares = (np.cumsum([sums[f"counts{k}"] or 0 for k in range(BINS)]) / total).tolist()
        rows = described.select("id", "source", "level", "fold", _features(self.usual, self.shares).alias("features")).coalesce(4).cache()
        # A leaf of a few labels, some of which are wrong, says nothing.
        least = max(2, rows.count() // 32)
        trees = GBTRegressor(labelCol="level", predictionCol="grade", maxIter=rounds, maxDepth=depth, stepSize=0.2, maxBins=64, seed=seed, minInstancesPerNode=least)

        def fitted(k):
            part = rows if k < 0 else rows.where(F.col("fold") != k)
            return trees.fit(part) if k < 0 or not part.isEmpty() else None

        with ThreadPool(FOLDS + 1) as pool:
            models = pool.map(fitted, range(-1, FOLDS))
        self.trees, held = models[0], None
        for k, model in enumerate(models[1:]):
            part = (model or self.trees).transform(rows.where(F.col("fold") == k)).select("id", "source", "level", "grade")
            held = part if held is None else held.unionAll(part)
        held = cut(held, "held-out")
        rows.unpersist()
        self.cuts = _cuts(held.select("level", "grade").toArrow())  # at most MOST_LABELS rows
        self.held_out = self._calibrated(held)

    def _calibrated(self, df: DataFrame) -> DataFrame:
        a, b, c = self.cuts
        grade = F.col("grade")
        stretched = F.when(grade < b, 1.5 + (grade - a) / (b - a)).otherwise(2.5 + (grade - b) / (c - b))
        level = F.lit(1) + (grade > a).cast("int") + (grade > b).cast("int") + (grade > c).cast("int")
        return df.withColumns({"calibrated": F.greatest(F.lit(1.0), F.least(F.lit(4.0), stretched)), "reading_level": level})

    def grade(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, n_words, grade, reading_level), a row per id."""
        if self.empty:
            return df.sparkSession.createDataFrame([], "id long, n_words int, grade double, reading_level int")
        source = df.select(F.col(id_col).alias("id"), F.lit(-1).alias("fold"), F.col(text_col).alias("text")).where("id is not null and text is not null")
        described = _described(source, self.lexicons).select("id", "n_words", _features(self.usual, self.shares).alias("features"))
        graded = self._calibrated(self.trees.transform(described)).select("id", "n_words", F.col("calibrated").alias("grade"), "reading_level")
        return graded.groupBy("id").agg(F.max(F.struct("reading_level", "grade", "n_words")).alias("g")).select("id", "g.n_words", "g.grade", "g.reading_level")
