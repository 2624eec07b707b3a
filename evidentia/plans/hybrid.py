"""Queries of hybrid search by the texts alone: encoded texts, retrievers as parameters, fusion by a trained model."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import encode, fusion, learning, retrieval
from evidentia.plans.base import CHUNKS, chunks, index, place, query_list, sql_tokens
from evidentia.plans.learning import examples
from evidentia.plans.registry import Registry
from evidentia.plans.search import _BM25, K
from evidentia.session import cut, scratch_dir
from evidentia.sources import files

R = Registry()
DIM = encode.DIM


def _sql_encoded(name: str, rows: str, key: str, text: str) -> str:
    """CTE `name` (key, v): the normalised mean of the tokens' unit vectors."""
    bytes_ = ", ".join(f"cast(('0x' || substr(md5(t), {2 * i + 1}, 2)) as integer) - 127.5" for i in range(DIM))
    means = ", ".join(f"avg(u[{i + 1}])" for i in range(DIM))
    return f"""{name}_t as (select {key}, unnest({sql_tokens(text)}) as t from {rows} where {text} is not null),
{name}_u as (select t, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) as u from (select t, cast([{bytes_}] as double[]) as raw from (select distinct t from {name}_t))),
{name}_m as (select {key}, [{means}] as m from {name}_t join {name}_u using (t) group by 1),
{name} as (select {key}, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) as v from {name}_m)"""


_SHOWN = ", ".join(f"round(v[{i}], 6) + 0.0 as v{i}" for i in (1, 8, 16))


def encoded_chunks(spark, d):
    """The vectors of all chunks' texts, made once for each state of the table."""
    made = encode.encode(chunks(spark, d), "chunk_id", "text")
    return files.load_or_build_vectors(made, place(spark, d, "corpus_chunks", "encoded"), DIM)


@R.query("encode_texts", f"with {CHUNKS}, {_sql_encoded('ev', 'ch', 'chunk_id', 'text')} select chunk_id, {_SHOWN} from ev")
def encode_texts(spark, d):
    v = encoded_chunks(spark, d)["vectors"]
    return v.select("chunk_id", *[(F.round(F.get("v", F.lit(i - 1)), 6) + 0.0).alias(f"v{i}") for i in (1, 8, 16)])


@R.query("vector_index_config", f"with {CHUNKS}, {_sql_encoded('ev', 'ch', 'chunk_id', 'text')} select {DIM} as dim, 'cosine' as metric, count(*) as n_vectors from ev")
def vector_index_config(spark, d):
    return encoded_chunks(spark, d)["config"]


_TEXT = f"""{_BM25}, {_sql_encoded('ev', 'ch', 'chunk_id', 'text')}, {_sql_encoded('qe', 'ql', 'query_id', 'query')},
es as (select query_id, chunk_id, round(list_cosine_similarity(qe.v, ev.v), 6) as score from qe, ev),
em as (select * from (select query_id, chunk_id, score, cast(row_number() over (partition by query_id order by score desc, cast(('0x' || substr(md5(chunk_id), 1, 15)) as bigint)) as integer) as rank from es) where rank <= {K})"""
_BOTH = f"""{_TEXT}, rn as (select 'bm25' as run, query_id, chunk_id, score, rank from bm union all select 'semantic', query_id, chunk_id, score, rank from em),
fu as (select query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) as fused_score, min(rank) as best_rank from rn group by 1, 2),
rf as (select *, cast(row_number() over (partition by query_id order by fused_score desc, best_rank, chunk_id) as integer) as pos from fu)"""


def _retrievers(spark, d):
    return {"bm25": retrieval.by_words(index(spark, d)), "semantic": retrieval.by_vectors(encoded_chunks(spark, d)["vectors"])}


def _runs(spark, d):
    """Both runs of every standing query; written, as several steps read them."""
    return cut(retrieval.runs_of(query_list(spark, d), _retrievers(spark, d), K), "runs")


@R.query("semantic_text_search", f"with {_TEXT} select * from em")
def semantic_text_search(spark, d):
    """The nearest texts to each query's own text."""
    return _retrievers(spark, d)["semantic"](query_list(spark, d), K)


@R.query("hybrid_text_search", f"with {_BOTH} select query_id, chunk_id, fused_score, pos from rf where pos <= {K}")
def hybrid_text_search(spark, d):
    """Words and encoded texts, fused by ranks; no label is read."""
    return retrieval.fuse(_runs(spark, d), top_k=K).select("query_id", "chunk_id", "fused_score", "pos")


@R.query("hybrid_tops", f"""with {_BOTH}, tp as (select query_id, string_agg(chunk_id, ',' order by rank) filter (run = 'bm25') as bm25_top, string_agg(chunk_id, ',' order by rank) filter (run = 'semantic') as semantic_top from rn where rank <= 5 group by 1)
    select query_id, chunk_id, pos, bm25_top, semantic_top from rf left join tp using (query_id) where pos <= 5""")
def hybrid_tops(spark, d):
    """Each fused hit with the first five of both runs."""
    runs = _runs(spark, d)
    shown = retrieval.with_tops(retrieval.fuse(runs, top_k=5), runs)
    top = lambda run: F.array_join(F.try_element_at("tops", F.lit(run)), ",").alias(f"{run}_top")
    return shown.select("query_id", "chunk_id", "pos", top("bm25"), top("semantic"))


@R.query("text_recall", f"""with {_BOTH}, t as (select query_id, target_doc_id from ql where target_doc_id is not null), f as (select query_id, min(pos) as pos from rf join ch using (chunk_id) join t using (query_id) where ch.doc_id = target_doc_id group by 1)
    select count(*) as n_queries, count(f.pos) as n_found, round(avg(coalesce(1.0 / f.pos, 0.0)), 6) as mrr, round(avg(case when f.pos <= 5 then 1.0 else 0.0 end), 6) as recall_at_5 from t left join f using (query_id)""")
def text_recall(spark, d):
    """How well the texts alone find the target documents: unlike `target_recall` no query knows its target's vector."""
    targets = query_list(spark, d).where("target_doc_id is not null").select("query_id", "target_doc_id")
    fused = retrieval.fuse(_runs(spark, d), top_k=2 * K).join(chunks(spark, d).select("chunk_id", "doc_id"), "chunk_id")
    found = fused.join(targets, "query_id").where("doc_id = target_doc_id").groupBy("query_id").agg(F.min("pos").alias("pos"))
    every = targets.join(found, "query_id", "left")
    return every.agg(
        F.count("*").alias("n_queries"), F.count("pos").alias("n_found"), F.round(F.avg(F.coalesce(1.0 / F.col("pos"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.when(F.col("pos") <= 5, 1.0).otherwise(0.0)), 6).alias("recall_at_5"),
    )


_SCORE = "round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / avgdl))), 6)"


@R.query("retrieve_rewritten", f"""with {_BM25}, rw as (select query_id, upper(regexp_extract(query, '(?i)\\bCOMP\\d{{4}}[A-Z]?\\b')) as query from ql),
    rt as (select query_id, term, count(*) as qn from (select query_id, unnest({sql_tokens('query')}) as term from rw) group by 1, 2),
    rs as (select query_id, chunk_id, {_SCORE} as score from rt join tf using (term) join idf using (term) join tok using (chunk_id), st group by 1, 2),
    rm as (select query_id, chunk_id, score, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank from rs)
    select *, 'rewritten' as found_by from rm where rank <= {K} union all select *, 'question' from bm where query_id not in (select query_id from rm)""")
def retrieve_rewritten(spark, d):
    """A query is rewritten to the course code it names and searched so; one without hits, or without a code, as it was asked."""
    asked = query_list(spark, d).select("query_id", "query", F.coalesce(X.course_code(F.col("query"), F.lit(None).cast("string")), F.lit("")).alias("rewritten"))
    return retrieval.with_fallback(asked, _retrievers(spark, d)["bm25"], K)


# ---------------------------------------------------------------- the trained model


def trained(spark, d):
    """The model of train's examples: trained once for each state of the table, then loaded."""
    at = place(spark, d, "lf_examples", "model")
    try:
        return files.load_model(spark, at)
    except FileNotFoundError:
        files.save_model(spark, learning.fit_fusion(cut(examples(spark, d).where("split = 'train'"), "train")), at)
        return files.load_model(spark, at)


@R.query("lf_model")
def lf_model(spark, d):
    """The saved model's numbers as they are read again."""
    trained(spark, d)
    return spark.read.schema(files.MODEL_SCHEMA).json(place(spark, d, "lf_examples", "model"))


@R.query("lf_rank_trained")
def lf_rank_trained(spark, d):
    """All examples' candidates ranked by the trained model, ten a query."""
    scored = examples(spark, d).withColumn("lf_score", F.round(trained(spark, d).probability(), 6))
    return fusion.lr_rank(scored, 10).select("query_id", "chunk_id", "split", "label", "lf_score", "pos")


@R.query("hybrid_search_trained")
def hybrid_search_trained(spark, d):
    """Words and encoded texts, fused by the trained model."""
    return retrieval.fuse(_runs(spark, d), "lr", model=lambda: trained(spark, d), top_k=5).select("query_id", "chunk_id", "fused_score", "fusion", "pos")


@R.query("hybrid_search_without_model", f"with {_BOTH} select query_id, chunk_id, fused_score, 'rrf' as fusion, pos from rf where pos <= 5")
def hybrid_search_without_model(spark, d):
    """Fusion by a model that isn't there falls back to ranks, with a warning."""
    return retrieval.fuse(_runs(spark, d), "lr", model=lambda: files.load_model(spark, f"{scratch_dir(spark)}/no-model"), top_k=5).select("query_id", "chunk_id", "fused_score", "fusion", "pos")
