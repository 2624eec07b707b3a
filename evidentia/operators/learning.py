"""Learned fusion: weak labels, negatives, splits, standardised features, training and evaluation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.operators import sampling
from evidentia.operators.fusion import FEATURES, logistic


def weak_label(doc_id: Column, target: Column) -> Column:
    """1 where a candidate's document is the wanted one."""
    return F.coalesce((F.lower(F.trim(doc_id)) == F.lower(F.trim(target))).cast("int"), F.lit(0))


def sample_negatives(examples: DataFrame, per_positive: int = 6, seed: int = 7) -> DataFrame:
    """All positives, and for each query `per_positive` negatives a positive, chosen by hash; queries without positives drop out."""
    each = Window.partitionBy("query_id")
    counted = examples.withColumn("_pos", F.sum("label").over(each)).where("_pos > 0")
    order = sampling.seeded(seed, F.col("query_id"), F.col("chunk_id"))
    nth = F.row_number().over(Window.partitionBy("query_id", "label").orderBy(order, "chunk_id"))
    return counted.withColumn("_nth", nth).where((F.col("label") == 1) | (F.col("_nth") <= per_positive * F.col("_pos"))).drop("_pos", "_nth")


def test_count(total: Column, ratio: float) -> Column:
    """max(1, round(total * ratio)), halves to even."""
    return F.greatest(F.lit(1), F.bround(total * ratio, 0).cast("long"))


def split_documents(docs: DataFrame, doc: str, ratio: float = 0.25, seed: int = 7) -> DataFrame:
    """(doc, split): whole documents go to test or train."""
    chosen = sampling.first_by_hash(docs.select(doc).where(F.col(doc).isNotNull()).distinct(), doc, test_count(F.col("total"), ratio), seed)
    return chosen.select(doc, F.when(F.col("chosen"), "test").otherwise("train").alias("split"))


def feature_stats(examples: DataFrame) -> DataFrame:
    """(feature, mean, std) of the ten features, population deviation; absent values are 0, a deviation of 0 is 1."""
    value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    one = examples.agg(*[F.avg(value(f)).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(value(f)).alias(f"s_{f}") for f in FEATURES])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.when(F.col(f"s_{f}") == 0, 1.0).otherwise(F.col(f"s_{f}")).alias("std")) for f in FEATURES]))
    return one.select(rows.alias("r")).select("r.*")


def standardized(examples: DataFrame, stats: DataFrame) -> DataFrame:
    """The features less their mean, over their deviation; stats has ten rows."""
    means = {r.feature: (r["mean"] or 0.0, r["std"] or 1.0) for r in stats.collect()}
    scaled = {f: (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - means[f][0]) / means[f][1] for f in FEATURES}
    return examples.withColumns(scaled)


def train_logistic(train: DataFrame, c: float = 1.0, max_iter: int = 100):
    """A logistic model of standardised features with balanced class weights; `c` is the inverse of the ridge penalty."""
    sizes = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    if len(sizes) < 2:
        raise ValueError("training needs examples of both classes")
    total = sum(sizes.values())
    weight = F.when(F.col("label") == 1, total / (2 * sizes[1])).otherwise(total / (2 * sizes[0]))
    rows = train.select(array_to_vector(F.array(*FEATURES)).alias("features"), F.col("label").cast("double").alias("label"), weight.alias("weight"))
    return LogisticRegression(regParam=1 / (c * total), standardization=False, weightCol="weight", maxIter=max_iter, tol=1e-7).fit(rows)


@dataclass(frozen=True)
class FusionModel:
    """A trained logistic model of standardised features, as numbers: it is saved, loaded and scored without MLlib."""

    coefficients: dict[str, float]
    intercept: float
    means: dict[str, float]
    scales: dict[str, float]
    meta: dict[str, float] = field(default_factory=dict)

    def probability(self) -> Column:
        return logistic(self.coefficients, self.intercept, self.means, self.scales)


def fit_fusion(train: DataFrame, c: float = 1.0, max_iter: int = 100) -> FusionModel:
    """The model of `train_logistic` over the examples' own statistics."""
    stats = {r.feature: (r["mean"] or 0.0, r["std"] or 1.0) for r in feature_stats(train).collect()}  # ten rows
    scaled = {f: (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - m) / s for f, (m, s) in stats.items()}
    model = train_logistic(train.withColumns(scaled), c, max_iter)
    of = dict(zip(FEATURES, map(float, model.coefficients)))
    return FusionModel(of, float(model.intercept), {f: m for f, (m, _) in stats.items()}, {f: s for f, (_, s) in stats.items()}, {"c": c, "max_iter": float(max_iter)})


def predicted(model, examples: DataFrame) -> DataFrame:
    """examples with `p`, the probability of the positive class."""
    vectors = examples.withColumn("features_vector", array_to_vector(F.array(*FEATURES)))
    scored = model.setFeaturesCol("features_vector").transform(vectors)
    return scored.withColumn("p", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)).drop("features_vector", "rawPrediction", "probability", "prediction")


def confusion(scored: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """(by, tn, fp, fn, tp) of scored rows (label, p)."""
    said = F.col("p") >= threshold
    return scored.groupBy(*by).agg(
        F.count_if((F.col("label") == 0) & ~said).alias("tn"), F.count_if((F.col("label") == 0) & said).alias("fp"),
        F.count_if((F.col("label") == 1) & ~said).alias("fn"), F.count_if((F.col("label") == 1) & said).alias("tp"),
    )


def class_report(scored: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """(by, label, precision, recall, f1, support); a ratio over nothing is 0."""
    m = confusion(scored, by, threshold)
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)

    def row(label, hit, false, missed):
        return F.struct(F.lit(label).alias("label"), ratio(hit, hit + false).alias("precision"), ratio(hit, hit + missed).alias("recall"), ratio(2 * hit, 2 * hit + false + missed).alias("f1"), (hit + missed).alias("support"))

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return m.select(*by, F.explode(F.array(row(0, tn, fn, fp), row(1, tp, fp, fn))).alias("r")).select(*by, "r.*")


def _by_score(scored: DataFrame, by: list[str]) -> DataFrame:
    """Rows, positives and negatives by score; scores of 6 decimals are a million at most, however many rows there are."""
    return scored.groupBy(*by, F.round("p", 6).alias("p")).agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum(1 - F.col("label").cast("long")).alias("neg"))


def roc_auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, roc_auc): the share of (positive, negative) pairs in the right order, ties half; null with one class only."""
    below = Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counted = _by_score(scored, by).withColumn("lower", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    sums = counted.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("m"), F.sum("neg").alias("n"))
    return sums.select(*by, F.when((F.col("m") > 0) & (F.col("n") > 0), F.col("u") / (F.col("m") * F.col("n"))).alias("roc_auc"))


def average_precision(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, average_precision): precision at each distinct score, weighed by the recall it adds; null without positives."""
    down = Window.partitionBy(*by).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    counted = _by_score(scored, by).select(*by, "pos", F.sum("pos").over(down).alias("hit"), F.sum(F.col("pos") + F.col("neg")).over(down).alias("seen"))
    sums = counted.groupBy(*by).agg(F.sum(F.col("pos") * F.col("hit") / F.col("seen")).alias("s"), F.sum("pos").alias("m"))
    return sums.select(*by, F.when(F.col("m") > 0, F.col("s") / F.col("m")).alias("average_precision"))


def evaluated(scored: DataFrame, by: list[str], threshold: float = 0.5, eps: float = 1e-6) -> DataFrame:
    """(by, roc_auc, average_precision, log_loss, tn, fp, fn, tp) of scored rows (label, p of 6 decimals at most), from one count of the scores."""
    below = Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*by).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    counted = _by_score(scored, by).withColumns({"lower": F.coalesce(F.sum("neg").over(below), F.lit(0)), "hit": F.sum("pos").over(above), "seen": F.sum(F.col("pos") + F.col("neg")).over(above)})
    p, said = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("p"))), F.col("p") >= threshold
    count = lambda side, when: F.sum(F.when(when, F.col(side)).otherwise(0))
    m, n = F.sum("pos"), F.sum("neg")
    return counted.groupBy(*by).agg(
        F.when((m > 0) & (n > 0), F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2)) / (m * n)).alias("roc_auc"),
        F.when(m > 0, F.sum(F.col("pos") * F.col("hit") / F.col("seen")) / m).alias("average_precision"),
        (-F.sum(F.col("pos") * F.ln(p) + F.col("neg") * F.ln(1 - p)) / (m + n)).alias("log_loss"),
        count("neg", ~said).alias("tn"), count("neg", said).alias("fp"), count("pos", ~said).alias("fn"), count("pos", said).alias("tp"),
    )


def log_loss(scored: DataFrame, by: list[str], eps: float = 1e-6) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("p")))
    loss = -F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p))
    return scored.groupBy(*by).agg(F.avg(loss).alias("log_loss"))
