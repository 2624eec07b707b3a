"""Queries of search: statistics, BM25, nearest vectors, fusion, reranking, thresholds, contexts, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import text as X
from evidentia.functions import vectors as V
from evidentia.operators import context, dense, fusion, lexical, rerank
from evidentia.plans.base import CHUNKS, chunks, index, place, query_list, sql_strip, sql_tokens
from evidentia.plans.registry import Registry
from evidentia.session import cut
from evidentia.sources import files
from evidentia.sources.tables import table

R = Registry()
K = 20

# ---------------------------------------------------------------- statistics and BM25

_TERMS = f"""{CHUNKS},
tok as (select chunk_id, {sql_tokens('text')} as tokens from ch where text is not null),
tf as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest(tokens) as term from tok) group by 1, 2),
df as (select term, count(*) as df from tf group by 1),
st as (select count(*) as n_chunks, cast(coalesce(sum(len(tokens)), 0) as bigint) as n_tokens, avg(len(tokens)) as avgdl from tok),
raw as (select term, df, ln(n_chunks - df + 0.5) - ln(df + 0.5) as raw from df, st),
idf as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw)"""


@R.query("term_frequency", f"with {_TERMS} select * from tf")
def term_frequency(spark, d):
    return lexical.term_frequency(chunks(spark, d))


@R.query("document_frequency", f"with {_TERMS} select * from df")
def document_frequency(spark, d):
    return lexical.document_frequency(chunks(spark, d))


@R.query("corpus_stats", f"with {_TERMS} select n_chunks, n_tokens, round(avgdl, 6) as avgdl from st")
def corpus_stats(spark, d):
    return lexical.corpus_stats(chunks(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


@R.query("bm25_idf", f"with {_TERMS} select term, df, round(idf, 6) as idf from idf")
def bm25_idf(spark, d):
    return lexical.idf(chunks(spark, d)).withColumn("idf", F.round("idf", 6))


_BM25 = f"""{_TERMS},
ql as (select query_id, query, target_doc_id from query_list where query_id is not null and query is not null),
qt as (select query_id, term, count(*) as qn from (select query_id, unnest({sql_tokens('query')}) as term from ql) group by 1, 2),
bs as (select query_id, chunk_id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / avgdl))), 6) as score
       from qt join tf using (term) join idf using (term) join tok using (chunk_id), st group by 1, 2),
bm as (select * from (select query_id, chunk_id, score, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank from bs) where rank <= {K})"""


@R.query("bm25_topk", f"with {_BM25} select * from bm")
def bm25_topk(spark, d):
    return lexical.bm25(index(spark, d), query_list(spark, d), K)


# ---------------------------------------------------------------- vectors

_USABLE = """us as (select vec_id, chunk_id, doc_id, cast(embedding as double[]) as v from chunk_vectors
  where vec_id is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0)"""


def usable_vectors(spark, d):
    """The vectors that can be searched; written once for each state of the table."""
    rows = table(spark, d, "chunk_vectors").where(F.col("vec_id").isNotNull() & V.usable(F.col("embedding"), 64))
    return files.load_or_write(rows.select("vec_id", "chunk_id", "doc_id", F.col("embedding").alias("v")), place(spark, d, "chunk_vectors", "usable"))


@R.query("l2_normalize", f"with {_USABLE}, n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from us) select vec_id, round(n, 6) as norm, round(v[1] / (n + 1e-12), 6) + 0.0 as first, round(list_sum(list_transform(v, lambda x: (x / (n + 1e-12)) * (x / (n + 1e-12)))), 6) as square from n")
def l2_normalize(spark, d):
    unit = usable_vectors(spark, d).select("vec_id", V.norm(F.col("v")).alias("n"), V.l2_normalize(F.col("v")).alias("u"))
    return unit.select("vec_id", F.round("n", 6).alias("norm"), (F.round(F.get("u", F.lit(0)), 6) + 0.0).alias("first"), F.round(V.dot(F.col("u"), F.col("u")), 6).alias("square"))


@R.query("vector_quality", """select case when embedding is null then 'missing' when len(embedding) <> 64 then 'wrong length' when len(list_filter(embedding, lambda x: x is not null and isfinite(x))) < 64 then 'not finite'
    when len(list_filter(embedding, lambda x: x <> 0)) = 0 then 'all zero' else 'usable' end as state, is_normalized, dim, count(*) as n from chunk_vectors group by all""")
def vector_quality(spark, d):
    """What the vectors are, against what their flags say."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    state = F.when(v.isNull(), "missing").when(F.size(v) != 64, "wrong length").when(~finite, "not finite").when(~F.exists(v, lambda x: x != 0), "all zero").otherwise("usable")
    return table(spark, d, "chunk_vectors").groupBy(state.alias("state"), "is_normalized", "dim").agg(F.count("*").alias("n"))


# All usable vectors are searched, and a chunk stands where its best one does; a query's vector is the first usable one of its target document.
_SEM = f"""{_USABLE},
qv as (select query_id, arg_min(v, vec_id) as q from query_list join us on doc_id = target_doc_id where query_id is not null and query is not null group by 1),
sv as (select query_id, chunk_id, vec_id, round(list_cosine_similarity(q, v), 6) as score from qv, us where chunk_id is not null),
ss as (select query_id, chunk_id, score, vec_id as best_id from (select *, row_number() over (partition by query_id, chunk_id order by score desc, vec_id) as nth from sv) where nth = 1),
sm as (select * from (select query_id, chunk_id, score, cast(row_number() over (partition by query_id order by score desc, best_id) as integer) as rank from ss) where rank <= {K})"""


def semantic_run(spark, d, k=K):
    vectors = usable_vectors(spark, d)
    asked = query_list(spark, d).join(vectors, F.col("doc_id") == F.col("target_doc_id")).groupBy("query_id").agg(F.min(F.struct("vec_id", "v")).alias("f"))
    items = vectors.where("chunk_id is not null").select(F.col("vec_id").alias("id"), "v", F.col("chunk_id").alias("label"))
    near = dense.knn(items, asked.select(F.col("query_id").alias("id"), F.col("f.v").alias("v")), k, dim=64, bounded=True)
    return near.select(F.col("query").alias("query_id"), F.col("label").alias("chunk_id"), "score", "rank")


@R.query("knn_cosine", f"with {_SEM} select * from sm")
def knn_cosine(spark, d):
    return semantic_run(spark, d)


@R.query("knn_l2", """with e as (select vec_id, cast(embedding as double[]) as v from embeddings), p as (select a.vec_id as vec_id, b.vec_id as other_id,
    round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) as distance from e a, e b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
    select * from (select vec_id, other_id, distance, cast(row_number() over (partition by vec_id order by distance, other_id) as integer) as pos from p) where pos <= 10""")
def knn_l2(spark, d):
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = dense.knn(items, items.where("id % 50 = 0"), 10, dim=64, metric="l2", not_self=True)
    return near.toDF("vec_id", "other_id", "distance", "pos")


# ---------------------------------------------------------------- fusion

_RUNS = f"""{_BM25}, {_SEM},
runs as (select 'bm25' as run, query_id, chunk_id, rank, 1.0 as w from bm union all select 'semantic', query_id, chunk_id, rank, 1.2 from sm),
fu as (select query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) as fused_score, min(rank) as best_rank from runs group by 1, 2),
rf as (select *, cast(row_number() over (partition by query_id order by fused_score desc, best_rank, chunk_id) as integer) as pos from fu)"""


def both_runs(spark, d):
    named = lambda df, run: df.select(F.lit(run).alias("run"), "query_id", "chunk_id", "score", "rank")
    return named(bm25_topk(spark, d), "bm25").unionByName(named(semantic_run(spark, d), "semantic"))


@R.query("rrf_fusion", f"with {_RUNS} select query_id, chunk_id, fused_score, best_rank, pos from rf")
def rrf_fusion(spark, d):
    return fusion.rrf(both_runs(spark, d)).select("query_id", "chunk_id", "fused_score", "best_rank", "pos")


@R.query("rrf_weighted", f"""with {_RUNS}, fw as (select query_id, chunk_id, round(sum(w / (60 + rank)), 6) as fused_score, min(rank) as best_rank,
    string_agg(run || '=' || rank, ',' order by run) as ranks from runs group by 1, 2),
    o as (select *, cast(row_number() over (partition by query_id order by fused_score desc, best_rank, chunk_id) as integer) as pos from fw) select * from o where pos <= 5""")
def rrf_weighted(spark, d):
    fused = fusion.rrf(both_runs(spark, d), weights={"semantic": 1.2}, top_k=5)
    ranks = F.array_join(F.transform(F.array_sort(F.map_entries("ranks")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return fused.select("query_id", "chunk_id", "fused_score", "best_rank", ranks.alias("ranks"), "pos")


@R.query("both_runs", f"with {_RUNS} select query_id, chunk_id from bm intersect select query_id, chunk_id from sm")
def runs_agree(spark, d):
    runs = cut(both_runs(spark, d), "runs")
    of = lambda run: runs.where(F.col("run") == run).select("query_id", "chunk_id")
    return of("bm25").intersect(of("semantic"))


# The documents that queries and runs of fusion_results stand for, grouped for the fused payload of large result sets.
@R.query("rrf_recorded_ranks", """with r as (select query_id, chunk_id, 'bm25' as run, min(payload.bm25_rank) as rank from fusion_results where query_id is not null and chunk_id is not null and payload.bm25_rank is not null group by all
    union all select query_id, chunk_id, 'semantic', min(payload.semantic_rank) from fusion_results where query_id is not null and chunk_id is not null and payload.semantic_rank is not null group by all),
    f as (select query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) as fused_score, min(rank) as best_rank from r group by 1, 2)
    select * from (select *, cast(row_number() over (partition by query_id order by fused_score desc, best_rank, chunk_id) as integer) as pos from f) where pos <= 5""")
def rrf_recorded_ranks(spark, d):
    """Reciprocal rank fusion of all recorded runs, five per query."""
    rows = table(spark, d, "fusion_results").where("query_id is not null and chunk_id is not null")
    ranks = F.explode(F.array(F.struct(F.lit("bm25").alias("run"), F.col("payload.bm25_rank").alias("rank")), F.struct(F.lit("semantic").alias("run"), F.col("payload.semantic_rank").alias("rank"))))
    runs = rows.select("query_id", "chunk_id", ranks.alias("r")).select("query_id", "chunk_id", "r.*").where("rank is not null")
    return fusion.rrf(runs, top_k=5).select("query_id", "chunk_id", "fused_score", "best_rank", "pos")


_FEATURES = f"""{_RUNS},
ft as (select query_id, chunk_id, coalesce(bm.score, 0.0) as bm25_score, cast(coalesce(bm.rank, 9999) as double) as bm25_rank, case when bm.rank is null then 0.0 else 1.0 end as bm25_present,
  coalesce(1.0 / (60 + bm.rank), 0.0) as bm25_rrf, coalesce(sm.score, 0.0) as semantic_score, cast(coalesce(sm.rank, 9999) as double) as semantic_rank,
  case when sm.rank is null then 0.0 else 1.0 end as semantic_present, coalesce(1.0 / (60 + sm.rank), 0.0) as semantic_rrf from bm full join sm using (query_id, chunk_id)),
fe as (select *, least(bm25_rank, semantic_rank) as best_rank, greatest(bm25_rrf, semantic_rrf) as best_rrf from ft)"""


def _features(spark, d):
    return fusion.features(bm25_topk(spark, d), semantic_run(spark, d))


@R.query("fusion_features", f"with {_FEATURES} select query_id, chunk_id, {', '.join(f'round(cast({c} as double), 6) as {c}' for c in fusion.FEATURES)} from fe")
def fusion_features(spark, d):
    return _features(spark, d).select("query_id", "chunk_id", *[F.round(c, 6).alias(c) for c in fusion.FEATURES])


#: A fixed model, for comparing the scoring itself.
_MODEL = {"bm25_score": 0.08, "bm25_rrf": 20.0, "semantic_score": 1.5, "semantic_rrf": 25.0, "bm25_present": -0.3, "best_rrf": 10.0}
_LOGIT = "1 / (1 + exp(-(-2.0 + " + " + ".join(f"{w} * {c}" for c, w in _MODEL.items()) + ")))"
_LR = f"""{_FEATURES}, lr as (select query_id, chunk_id, bm25_rank, semantic_rank, round({_LOGIT}, 6) as lf_score from fe),
lo as (select *, cast(row_number() over (partition by query_id order by lf_score desc, bm25_rank, semantic_rank, chunk_id) as integer) as pos from lr)"""


def _lr(spark, d):
    scored = _features(spark, d).withColumn("lf_score", F.round(fusion.logistic(_MODEL, -2.0), 6))
    return fusion.lr_rank(scored)


@R.query("lr_fusion", f"with {_LR} select query_id, chunk_id, lf_score, pos from lo where pos <= {K}")
def lr_fusion(spark, d):
    return _lr(spark, d).where(F.col("pos") <= K).select("query_id", "chunk_id", "lf_score", "pos")


@R.query("hybrid_search", f"with {_RUNS} select query_id, pos, rf.chunk_id, doc_id, title, section, fused_score, substr(replace(text, chr(10), ' '), 1, 240) as preview from rf join ch on ch.chunk_id = rf.chunk_id where pos <= 5")
def hybrid_search(spark, d):
    """Lexical and vector candidates of every standing query, fused; texts are joined last, to the ids that are left."""
    top = rrf_fusion(spark, d).where("pos <= 5").select("query_id", "chunk_id", "fused_score", "pos")
    preview = F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 240)
    return top.join(chunks(spark, d), "chunk_id").select("query_id", "pos", "chunk_id", "doc_id", "title", "section", "fused_score", preview.alias("preview"))


@R.query("retrieve_with_fallback", f"""with {_BM25}, empty as (select query_id from ql where query_id not in (select query_id from bm)),
    fb as (select query_id, chunk_id, cast(row_number() over (partition by query_id order by chunk_id) as integer) as rank from empty join ql using (query_id) join ch on ch.doc_id = ql.target_doc_id)
    select query_id, chunk_id, rank, 'query' as found_by from bm union all select query_id, chunk_id, rank, 'target' from fb where rank <= {K}""")
def retrieve_with_fallback(spark, d):
    """A query without any lexical hit is answered with the chunks of its target document."""
    found = bm25_topk(spark, d).select("query_id", "chunk_id", "rank", F.lit("query").alias("found_by"))
    left = query_list(spark, d).join(found.select("query_id").distinct(), "query_id", "left_anti")
    instead = left.join(chunks(spark, d).select("chunk_id", "doc_id"), F.col("doc_id") == F.col("target_doc_id"))
    rank = lexical.ranked(F.lit(0), "chunk_id")
    return found.unionByName(instead.select("query_id", "chunk_id", rank.alias("rank"), F.lit("target").alias("found_by")).where(F.col("rank") <= K))


# ---------------------------------------------------------------- reranking and thresholds


def _sql_threshold(source: str, score: str, ratio: str = "0.65", min_keep: str = "5", max_keep: str = "12") -> str:
    return f"""(select * from (select *, count_if(passes) over (partition by query_id) as n_pass, count_if(passes) over (partition by query_id order by pos) as nth from
      (select *, {score} >= max({score}) over (partition by query_id) * {ratio} as passes from {source}))
      where case when n_pass >= {min_keep} then passes and nth <= {max_keep} else pos <= least({min_keep}, {max_keep}) end)"""


@R.query("score_threshold", f"with {_RUNS} select query_id, chunk_id, fused_score, pos from {_sql_threshold('rf', 'fused_score')}")
def score_threshold(spark, d):
    return rerank.score_threshold(rrf_fusion(spark, d), "fused_score").select("query_id", "chunk_id", "fused_score", "pos")


@R.query("threshold_recorded", f"""with s as (select query_id, chunk_id, max(score) as score from fusion_results where query_id is not null and chunk_id is not null and score is not null and not isnan(score) group by all),
    p as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as pos from s)
    select query_id, count(*) as kept, min(score) as least_score from {_sql_threshold('p', 'score')} group by 1""")
def threshold_recorded(spark, d):
    """The threshold over all recorded results: how many each query keeps, and the least score kept."""
    rows = table(spark, d, "fusion_results").where("query_id is not null and chunk_id is not null and score is not null and not isnan(score)")
    best = rows.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    # At most max_keep rows of a query can stay, and the best score is the first: longer lists aren't needed.
    ranked = best.withColumn("pos", lexical.ranked(F.col("score"), "chunk_id")).where("pos <= 12")
    return rerank.score_threshold(ranked).groupBy("query_id").agg(F.count("*").alias("kept"), F.min("score").alias("least_score"))


_TOKEN_VECTOR = "list_transform(range(0, 16), lambda i: cast(('0x' || substr(md5({t}), i * 2 + 1, 2)) as integer) - 127.5)"
_MAXSIM = f"""{_RUNS},
hits as (select query_id, chunk_id, fused_score, pos from rf where pos <= 30),
mq as (select query_id, generate_subscripts(t, 1) as ta, unnest(t) as qt from (select query_id, {sql_tokens('query')}[:64] as t from ql)),
mt as (select chunk_id, unnest(list_distinct({sql_tokens('text')}[:256])) as tt from ch where chunk_id in (select chunk_id from hits)),
met as (select query_id, chunk_id, ta, qt, tt from hits join mq using (query_id) join mt using (chunk_id)),
vec as (select t, {_TOKEN_VECTOR.format(t='t')} as v from (select distinct qt as t from met union select distinct tt from met)),
sims as (select qt, tt, list_dot_product(cast(a.v as double[]), cast(b.v as double[])) / sqrt(list_dot_product(cast(a.v as double[]), cast(a.v as double[]))) / sqrt(list_dot_product(cast(b.v as double[]), cast(b.v as double[]))) as sim
         from (select distinct qt, tt from met) join vec a on a.t = qt join vec b on b.t = tt),
mx as (select query_id, chunk_id, round(sum(best), 6) as colbert_score from (select query_id, chunk_id, ta, max(sim) as best from met join sims using (qt, tt) group by 1, 2, 3) group by 1, 2),
rr as (select query_id, chunk_id, fused_score, pos, coalesce(colbert_score, cast('-infinity' as double)) as colbert_score from hits left join mx using (query_id, chunk_id))"""


#: The lengths that the SQL compares; the queries *_whole have none.
_LENGTHS = {"query_tokens": 64, "text_tokens": 256}


def _sql_whole(sql: str) -> str:
    for n in _LENGTHS.values():
        sql = sql.replace(f"[:{n}]", "")
    return sql


def _reranked(spark, d, **lengths):
    hits = cut(rrf_fusion(spark, d).where("pos <= 30").select("query_id", "chunk_id", "fused_score", "pos"), "hits")
    return rerank.maxsim(hits, query_list(spark, d), chunks(spark, d).select("chunk_id", "text"), **lengths)


def _maxsim_rerank(spark, d, **lengths):
    return rerank.rerank_head(_reranked(spark, d, **lengths), 30).select("query_id", "chunk_id", "colbert_score", F.col("new_pos").alias("pos"))


@R.query("maxsim_rerank", f"with {_MAXSIM} select query_id, chunk_id, colbert_score, cast(row_number() over (partition by query_id order by colbert_score desc, fused_score desc, pos) as integer) as pos from rr")
def maxsim_rerank(spark, d):
    return _maxsim_rerank(spark, d, **_LENGTHS)


@R.query("maxsim_rerank_whole", _sql_whole(R.sql["maxsim_rerank"]))
def maxsim_rerank_whole(spark, d):
    return _maxsim_rerank(spark, d)


_HEAD = "row_number() over (partition by query_id order by case when pos <= 10 then 0 else 1 end, case when pos <= 10 then colbert_score end desc nulls last, case when pos <= 10 then fused_score end desc nulls last, pos)"


def _rerank_head_tail(spark, d, **lengths):
    return rerank.rerank_head(_reranked(spark, d, **lengths), 10).select("query_id", "chunk_id", F.col("pos").alias("old_pos"), F.col("new_pos").alias("pos"))


@R.query("rerank_head_tail", f"with {_MAXSIM} select query_id, chunk_id, pos as old_pos, cast({_HEAD} as integer) as pos from rr")
def rerank_head_tail(spark, d):
    return _rerank_head_tail(spark, d, **_LENGTHS)


@R.query("rerank_head_tail_whole", _sql_whole(R.sql["rerank_head_tail"]))
def rerank_head_tail_whole(spark, d):
    return _rerank_head_tail(spark, d)


_ABOUT = r"(regexp_matches(query, '(?i)\bcomp\s*\d{4}\b') or regexp_matches(query, '\b\d{4}\b') or regexp_matches(query, '(?i)\bcourse(s)?\b'))"


def _routed(spark, d, hits, score):
    """Thresholds that depend on the query: queries about courses keep more."""
    about = query_list(spark, d).select("query_id", X.about_courses(F.col("query")).alias("about"))
    return rerank.score_threshold(hits.join(F.broadcast(about), "query_id"), score, ratio=F.when(F.col("about"), 0.55).otherwise(0.65), max_keep=F.when(F.col("about"), 40).otherwise(12))


def _sql_routed(source, score):
    joined = f"(select s.*, {_ABOUT} as about from {source} s join ql using (query_id))"
    return _sql_threshold(joined, score, "case when about then 0.55 else 0.65 end", "5", "case when about then 40 else 12 end")


@R.query("retrieve_rrf", f"with {_RUNS} select query_id, chunk_id, fused_score, pos from {_sql_routed('rf', 'fused_score')}")
def retrieve_rrf(spark, d):
    return _routed(spark, d, rrf_fusion(spark, d), "fused_score").select("query_id", "chunk_id", "fused_score", "pos")


@R.query("retrieve_lr", f"with {_LR} select query_id, chunk_id, lf_score, pos from {_sql_routed('lo', 'lf_score')}")
def retrieve_lr(spark, d):
    return _routed(spark, d, _lr(spark, d), "lf_score").select("query_id", "chunk_id", "lf_score", "pos")


def _retrieve_rerank(spark, d, **lengths):
    """Candidates, the first ten reranked, then the threshold on whichever score a hit has."""
    head = rerank.rerank_head(_reranked(spark, d, **lengths), 10)
    picked = head.withColumn("colbert_score", F.when(F.col("pos") <= 10, F.col("colbert_score"))).withColumn("score", rerank.pick_score("colbert_score", "fused_score"))
    return _routed(spark, d, picked.select("query_id", "chunk_id", "score", F.col("new_pos").alias("pos")), "score").select("query_id", "chunk_id", "score", "pos")


@R.query("retrieve_rerank", f"""with {_MAXSIM}, hd as (select query_id, chunk_id, case when pos <= 10 then colbert_score else fused_score end as score, cast({_HEAD} as integer) as new_pos from rr),
    hp as (select query_id, chunk_id, score, new_pos as pos from hd) select query_id, chunk_id, score, pos from {_sql_routed('hp', 'score')}""")
def retrieve_rerank(spark, d):
    return _retrieve_rerank(spark, d, **_LENGTHS)


@R.query("retrieve_rerank_whole", _sql_whole(R.sql["retrieve_rerank"]))
def retrieve_rerank_whole(spark, d):
    return _retrieve_rerank(spark, d)


# ---------------------------------------------------------------- contexts

_HITS = f"{_RUNS}, hh as (select query_id, chunk_id, fused_score as score, pos from {_sql_routed('rf', 'fused_score')}), sd as (select hh.*, doc_id, chunk_idx, section from hh join ch using (chunk_id))"
_NEIGHBOURS = "nb as (select distinct s.query_id, c.chunk_id from sd s join ch c on c.doc_id = s.doc_id and c.chunk_idx between s.chunk_idx - 1 and s.chunk_idx + 1)"
_SAME = "sc as (select distinct s.query_id, c.chunk_id from sd s join ch c on c.doc_id = s.doc_id and c.section = s.section where s.section <> '')"
_EXPANDED = f"""{_HITS}, {_NEIGHBOURS}, {_SAME},
kp as (select query_id, chunk_id from sd union select * from nb union select * from sc),
gp as (select query_id, doc_id, min(pos) as first_pos from sd group by 1, 2),
ex as (select kp.query_id, doc_id, chunk_id, chunk_idx, coalesce(hh.score, 0.0) as score,
       cast(row_number() over (partition by kp.query_id order by first_pos, chunk_idx nulls last, chunk_id) as integer) as pos
       from kp join ch using (chunk_id) join gp using (query_id, doc_id) left join hh using (query_id, chunk_id))"""


def _hits(spark, d):
    """A few hits for each standing query; written, as several steps that follow read them."""
    return cut(retrieve_rrf(spark, d).withColumnRenamed("fused_score", "score"), "hits")


def _seeds(spark, d):
    """Hits with their places in their documents."""
    return _hits(spark, d).join(chunks(spark, d).select("chunk_id", "doc_id", "chunk_idx", "section"), "chunk_id")


@R.query("expand_neighbors", f"with {_HITS}, {_NEIGHBOURS} select * from nb")
def expand_neighbors(spark, d):
    return context.neighbours(_seeds(spark, d), chunks(spark, d))


@R.query("expand_neighbors_window", """with s as (select distinct doc_id, try_cast(nullif(regexp_extract(chunk_id, '::c(\\d+)$', 1), '') as integer) as chunk_idx from lf_examples where label = 1 and chunk_id is not null),
    """ + CHUNKS + """ select distinct c.chunk_id from ch c join s on c.doc_id = s.doc_id and c.chunk_idx between s.chunk_idx - 1 and s.chunk_idx + 1""")
def expand_neighbors_window(spark, d):
    """Chunks next to any positive example: a range frame over the document instead of a join of neighbours."""
    seeds = table(spark, d, "lf_examples").where("label = 1 and chunk_id is not null and doc_id is not null").select("doc_id", X.chunk_index(F.col("chunk_id")).alias("chunk_idx"), F.lit(1).alias("seed")).distinct()
    marked = chunks(spark, d).where("chunk_idx is not null").select("chunk_id", "doc_id", "chunk_idx", F.lit(0).alias("seed"))
    both = marked.unionByName(seeds.where("chunk_idx is not null").withColumn("chunk_id", F.lit(None).cast("string")))
    near = F.max("seed").over(Window.partitionBy("doc_id").orderBy("chunk_idx").rangeBetween(-1, 1))
    return both.withColumn("near", near).where("near = 1 and chunk_id is not null").select("chunk_id").distinct()


@R.query("expand_section", f"with {_HITS}, {_SAME} select * from sc")
def expand_section(spark, d):
    return context.same_section(_seeds(spark, d), chunks(spark, d))


@R.query("expand_hits", f"with {_EXPANDED} select * from ex")
def expand_hits(spark, d):
    return context.expand(_hits(spark, d), chunks(spark, d))


@R.query("expand_regroup", f"""with {_HITS}, gp as (select query_id, doc_id, min(pos) as first_pos from sd group by 1, 2) select query_id, doc_id, chunk_id, chunk_idx, score,
    cast(row_number() over (partition by query_id order by first_pos, chunk_idx nulls last, chunk_id) as integer) as pos from sd join gp using (query_id, doc_id)""")
def expand_regroup(spark, d):
    return context.expand(_hits(spark, d), chunks(spark, d), compat=True)


_BLOCKS = f"""{_EXPANDED},
bk as (select query_id, pos, '[' || pos || '] ' || ch.doc_id || case when ch.chunk_idx is null then '' else ' (chunk=' || ch.chunk_idx || ')' end || chr(10) || {sql_strip('text')} as block
       from ex join ch using (chunk_id) where text is not null and text <> ''),
bd as (select *, sum(length(block)) over (partition by query_id order by pos) as total from bk),
fit as (select query_id, pos, block, total from bd where total <= 12000),
cx as (select query_id, count(*) as n_blocks, string_agg(block, chr(10) || chr(10) order by pos) as context from fit group by 1)"""


def _fitting(spark, d, hits):
    expanded = context.expand(hits, chunks(spark, d))
    return context.within_budget(context.blocks(expanded, chunks(spark, d)))


@R.query("context_budget", f"with {_BLOCKS} select query_id, pos, length(block) as n_chars, cast(total as bigint) as total from fit")
def context_budget(spark, d):
    return _fitting(spark, d, _hits(spark, d)).select("query_id", "pos", F.length("block").cast("long").alias("n_chars"), "total")


@R.query("build_context", f"with {_BLOCKS} select query_id, n_blocks, context from cx")
def build_context(spark, d):
    return contexts(spark, d, _hits(spark, d))


def contexts(spark, d, hits):
    """The context that hits expand to."""
    return context.assemble(_fitting(spark, d, hits))


@R.query("answer_prompt", f"with {_BLOCKS} select query_id, 'Answer the question from the context and cite its blocks as [n]. Say so if the context has no answer.' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || {sql_strip('query')} || chr(10) || 'Answer:' as prompt from ql left join cx using (query_id)")
def answer_prompt(spark, d):
    asked = query_list(spark, d).select("query_id", X.strip(F.col("query")).alias("query"))
    return asked.join(build_context(spark, d), "query_id", "left").select("query_id", context.prompt(F.col("context"), F.col("query")).alias("prompt"))


@R.query("turn_trace", f"""with {_BLOCKS}, h as (select query_id, count(*) as num_hits from hh group by 1)
    select query_id, coalesce(num_hits, 0) as num_hits, coalesce(n_blocks, 0) as n_blocks, coalesce(length(context), 0) as context_chars from ql left join h using (query_id) left join cx using (query_id)""")
def turn_trace(spark, d):
    """What a turn would log about each query's retrieval."""
    found = _hits(spark, d)
    hits = found.groupBy("query_id").agg(F.count("*").alias("num_hits"))
    made = contexts(spark, d, found).select("query_id", "n_blocks", F.length("context").cast("long").alias("context_chars"))
    joined = query_list(spark, d).select("query_id").join(hits, "query_id", "left").join(made, "query_id", "left")
    return joined.na.fill(0, ["num_hits", "n_blocks", "context_chars"])


@R.query("target_recall", f"""with {_RUNS}, t as (select query_id, target_doc_id from ql where target_doc_id is not null), f as (select query_id, min(pos) as pos from rf join ch using (chunk_id) join t using (query_id) where ch.doc_id = target_doc_id group by 1)
    select count(*) as n_queries, count(f.pos) as n_found, round(avg(coalesce(1.0 / f.pos, 0.0)), 6) as mrr, round(avg(case when f.pos <= 5 then 1.0 else 0.0 end), 6) as recall_at_5 from t left join f using (query_id)""")
def target_recall(spark, d):
    """How well fused results find the target documents."""
    targets = query_list(spark, d).where("target_doc_id is not null").select("query_id", "target_doc_id")
    where = chunks(spark, d).select("chunk_id", "doc_id")
    found = rrf_fusion(spark, d).join(where, "chunk_id").join(targets, "query_id").where("doc_id = target_doc_id").groupBy("query_id").agg(F.min("pos").alias("pos"))
    every = targets.join(found, "query_id", "left")
    return every.agg(
        F.count("*").alias("n_queries"), F.count("pos").alias("n_found"), F.round(F.avg(F.coalesce(1.0 / F.col("pos"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.when(F.col("pos") <= 5, 1.0).otherwise(0.0)), 6).alias("recall_at_5"),
    )
