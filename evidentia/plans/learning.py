"""Queries of learned fusion: labels, samples, splits, statistics, training and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import fusion, learning, runs, sampling
from evidentia.operators.fusion import FEATURES
from evidentia.plans import search
from evidentia.plans.base import chunks, query_list
from evidentia.plans.registry import Registry
from evidentia.session import cut
from evidentia.sources.tables import table

R = Registry()

_EX = f"""ex as (select query_id, chunk_id, min(target_doc_id) as target_doc_id, min(doc_id) as doc_id, max(label) as label, min(split) as split, {', '.join(f'coalesce(max(features.{c}), 0.0) as {c}' for c in FEATURES)}
  from lf_examples where query_id is not null and chunk_id is not null group by 1, 2),
xf as (select * replace (coalesce(label, 0) as label) from ex)"""


def examples(spark, d):
    """One row per query and chunk; a missing label is 0, missing features are 0."""
    rows = table(spark, d, "lf_examples").where("query_id is not null and chunk_id is not null")
    values = [F.coalesce(F.max(f"features.{c}"), F.lit(0.0)).alias(c) for c in FEATURES]
    once = rows.groupBy("query_id", "chunk_id").agg(F.min("target_doc_id").alias("target_doc_id"), F.min("doc_id").alias("doc_id"), F.max("label").alias("label"), F.min("split").alias("split"), *values)
    return once.withColumn("label", F.coalesce("label", F.lit(0)))


@R.query("weak_labels", f"with {_EX}, w as (select coalesce(cast(lower(trim(doc_id)) = lower(trim(target_doc_id)) as integer), 0) as weak, label from xf) select weak, label, count(*) as n from w group by 1, 2")
def weak_labels(spark, d):
    """Weak labels against the recorded ones."""
    return examples(spark, d).groupBy(learning.weak_label(F.col("doc_id"), F.col("target_doc_id")).alias("weak"), "label").agg(F.count("*").alias("n"))


_NEG = f"""{_EX}, ps as (select *, sum(label) over (partition by query_id) as pos, row_number() over (partition by query_id, label order by md5(concat_ws(':', '7', query_id, chunk_id)), chunk_id) as nth from xf),
ng as (select * from ps where pos > 0 and (label = 1 or nth <= 6 * pos))"""


@R.query("negative_sampling", f"with {_NEG} select query_id, chunk_id, label from ng")
def negative_sampling(spark, d):
    return learning.sample_negatives(examples(spark, d)).select("query_id", "chunk_id", "label")


_SPLIT = """dc as (select distinct lower(trim(target_doc_id)) as doc from lf_examples where target_doc_id is not null),
sp as (select doc, case when row_number() over (order by md5('7:' || doc), doc) <= greatest(1, cast(round_even((select count(*) from dc) * 0.25, 0) as bigint)) then 'test' else 'train' end as split from dc)"""


def _documents(spark, d):
    return table(spark, d, "lf_examples").select(F.lower(F.trim("target_doc_id")).alias("doc"))


@R.query("doc_split", f"with {_SPLIT} select * from sp")
def doc_split(spark, d):
    return learning.split_documents(_documents(spark, d), "doc")


@R.query("lf_dataset", f"with {_NEG}, {_SPLIT} select query_id, chunk_id, label, sp.split, round(best_rrf, 6) as best_rrf from ng join sp on doc = lower(trim(target_doc_id))")
def lf_dataset(spark, d):
    """Sampled examples, split by whole target documents."""
    sampled = learning.sample_negatives(examples(spark, d)).withColumn("doc", F.lower(F.trim("target_doc_id"))).drop("split")
    return sampled.join(doc_split(spark, d), "doc").select("query_id", "chunk_id", "label", "split", F.round("best_rrf", 6).alias("best_rrf"))


@R.query("lf_dataset_summary", f"with {_NEG}, {_SPLIT} select sp.split, count(*) as n_rows, count(distinct query_id) as n_queries, count(distinct doc) as n_docs, cast(sum(label) as bigint) as n_positive, round(avg(label), 6) as positive_rate from ng join sp on doc = lower(trim(target_doc_id)) group by 1")
def lf_dataset_summary(spark, d):
    sampled = learning.sample_negatives(examples(spark, d)).withColumn("doc", F.lower(F.trim("target_doc_id"))).drop("split")
    return sampled.join(doc_split(spark, d), "doc").groupBy("split").agg(
        F.count("*").alias("n_rows"), F.countDistinct("query_id").alias("n_queries"), F.countDistinct("doc").alias("n_docs"), F.sum(F.col("label").cast("long")).alias("n_positive"), F.round(F.avg("label"), 6).alias("positive_rate")
    )


@R.query("lf_build", f"with {search._FEATURES} select query_id, chunk_id, coalesce(cast(lower(trim(ch.doc_id)) = lower(trim(target_doc_id)) as integer), 0) as label, round(cast(best_rrf as double), 6) as best_rrf, substr(text, 1, 160) as text_preview from fe join ch using (chunk_id) join ql using (query_id)")
def lf_build(spark, d):
    """Examples from scratch: candidates of both searches, features, weak labels and previews."""
    made = search._features(spark, d).select("query_id", "chunk_id", F.round("best_rrf", 6).alias("best_rrf"))
    joined = made.join(chunks(spark, d), "chunk_id").join(query_list(spark, d).select("query_id", "target_doc_id"), "query_id")
    return joined.select("query_id", "chunk_id", learning.weak_label(F.col("doc_id"), F.col("target_doc_id")).alias("label"), "best_rrf", F.substring("text", 1, 160).alias("text_preview"))


@R.query("feature_standardize", f"with {_EX}, " + "u as (" + " union all ".join(f"select '{c}' as feature, avg({c}) as m, stddev_pop({c}) as s from xf where split = 'train'" for c in FEATURES) + ") select feature, round(m, 6) as mean, round(case when s = 0 then 1.0 else s end, 6) as std from u")
def feature_standardize(spark, d):
    stats = learning.feature_stats(examples(spark, d).where("split = 'train'"))
    return stats.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_SCALED = ", ".join(f"round(avg({c}), 4) + 0.0 as mean_{c}, round(stddev_pop({c}), 4) as std_{c}" for c in ("bm25_score", "semantic_rank"))
_TRAIN = f"st as (select avg(bm25_score) as m1, stddev_pop(bm25_score) as s1, avg(semantic_rank) as m2, stddev_pop(semantic_rank) as s2 from xf where split = 'train'), z as (select split, (bm25_score - m1) / s1 as bm25_score, (semantic_rank - m2) / s2 as semantic_rank from xf, st)"


@R.query("standardized_by_split", f"with {_EX}, {_TRAIN} select split, {_SCALED} from z group by 1")
def standardized_by_split(spark, d):
    """Every split scaled by the statistics of train: how far its features are from train's."""
    rows = examples(spark, d)
    z = learning.standardized(rows, learning.feature_stats(rows.where("split = 'train'")))
    of = [f(c) for c in ("bm25_score", "semantic_rank") for f in (lambda c: (F.round(F.avg(c), 4) + 0.0).alias(f"mean_{c}"), lambda c: F.round(F.stddev_pop(c), 4).alias(f"std_{c}"))]
    return z.groupBy("split").agg(*of)


_SCORED = f"{_EX}, sc as (select split, query_id, chunk_id, label, round({search._LOGIT}, 6) as p from xf)"


def scored(spark, d):
    """All examples scored by one fixed model."""
    p = F.round(fusion.logistic(search._MODEL, -2.0), 6)
    return examples(spark, d).select("split", "query_id", "chunk_id", "label", p.alias("p"))


@R.query("confusion_matrix", f"with {_SCORED} select split, count(*) filter (label = 0 and p < 0.5) as tn, count(*) filter (label = 0 and p >= 0.5) as fp, count(*) filter (label = 1 and p < 0.5) as fn, count(*) filter (label = 1 and p >= 0.5) as tp from sc group by 1")
def confusion_matrix(spark, d):
    return learning.confusion(scored(spark, d), ["split"])


@R.query("classification_report", f"""with {_SCORED}, m as (select split, l as label, count(*) filter (label = l and (p >= 0.5) = (l = 1)) as hit, count(*) filter (label <> l and (p >= 0.5) = (l = 1)) as wrong,
    count(*) filter (label = l) as support from sc, (values (0), (1)) v(l) group by 1, 2)
    select split, label, round(case when hit + wrong = 0 then 0.0 else hit / (hit + wrong) end, 6) as precision, round(case when support = 0 then 0.0 else hit / support end, 6) as recall,
    round(case when hit + wrong + support = 0 then 0.0 else 2 * hit / (hit + wrong + support) end, 6) as f1, support from m""")
def classification_report(spark, d):
    report = learning.class_report(scored(spark, d), ["split"])
    return report.select("split", "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@R.query("roc_auc", f"""with {_SCORED}, b as (select split, p, sum(label) as pos, sum(1 - label) as neg from sc group by 1, 2), c as (select *, coalesce(sum(neg) over (partition by split order by p rows between unbounded preceding and 1 preceding), 0) as lower from b)
    select split, round(sum(pos * (lower + neg / 2.0)) / (sum(pos) * sum(neg)), 6) as roc_auc from c group by 1""")
def roc_auc(spark, d):
    return learning.roc_auc(scored(spark, d), ["split"]).withColumn("roc_auc", F.round("roc_auc", 6))


@R.query("average_precision", f"""with {_SCORED}, b as (select split, p, sum(label) as pos, count(*) as n from sc group by 1, 2), c as (select *, sum(pos) over w as hit, sum(n) over w as seen from b window w as (partition by split order by p desc rows unbounded preceding))
    select split, round(sum(pos * hit / seen) / sum(pos), 6) as average_precision from c group by 1""")
def average_precision(spark, d):
    return learning.average_precision(scored(spark, d), ["split"]).withColumn("average_precision", F.round("average_precision", 6))


@R.query("log_loss", f"with {_SCORED} select split, round(avg(-case when label = 1 then ln(greatest(1e-6, least(1 - 1e-6, p))) else ln(1 - greatest(1e-6, least(1 - 1e-6, p))) end), 6) as log_loss from sc group by 1")
def log_loss(spark, d):
    return learning.log_loss(scored(spark, d), ["split"]).withColumn("log_loss", F.round("log_loss", 6))


@R.query("lf_metrics")
def lf_metrics(spark, d):
    """A logistic model trained on train's standardised features, evaluated on each split."""
    rows = cut(examples(spark, d), "examples")
    z = learning.standardized(rows, learning.feature_stats(rows.where("split = 'train'")))
    p = learning.predicted(learning.train_logistic(z.where("split = 'train'")), z).select("split", "label", "p")
    out = learning.evaluated(p, ["split"])
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return out.withColumn("accuracy", (F.col("tp") + F.col("tn")) / n).withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


@R.query("minibatch_sample", f"""with {_SCORED}, b as (select query_id || '/' || chunk_id as id, case when p >= 0.7 then 'positive' when p <= 0.2 then 'negative' else 'neutral' end as bucket from sc),
    r as (select *, row_number() over (partition by bucket order by md5('7:' || id), id) as nth from b where bucket <> 'neutral') select id, bucket from r where nth <= 4""")
def minibatch_sample(spark, d):
    """Four examples of each extreme bucket by the order of a hash."""
    rows = scored(spark, d).select(F.concat_ws("/", "query_id", "chunk_id").alias("id"), runs.bucket(F.col("p")).alias("bucket")).where("bucket <> 'neutral'")
    return sampling.first_per_group(rows, ["bucket"], F.struct(sampling.seeded(7, F.col("id")), "id"), 4)
