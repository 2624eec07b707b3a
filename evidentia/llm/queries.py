"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.text import SPACE
from evidentia.llm import mix, near_duplicates, overlaps, pack, reading, similar, split, tokens, top_n
from evidentia.plans.registry import Registry
from evidentia.sources.tables import table

R = Registry()

# Problem 1: splitting at natural boundaries, by the `chunk` row of size_limits.
def _limit(spark, d, purpose):
    row = table(spark, d, "size_limits").where(F.col("purpose") == purpose).select("capacity", "overlap").first()
    return {"limit": int(row.capacity), "overlap": int(row.overlap)}


_P1_FOUND = rf"""
with t as (select chunk_id, min(text) as text from corpus_chunks where chunk_id is not null and length(text) > 1200 group by 1),
b as (select chunk_id, regexp_replace(regexp_replace(regexp_replace(text, '{SPACE}*[\n\r]{SPACE}*', chr(1), 'g'), '([.!?]){SPACE}+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g') as marked from t)
select chunk_id, cast(len(list_filter(string_split(marked, chr(1)), lambda s: length(s) > 1200)) as integer) as n_forced from b
"""


@R.query("p1_found", _P1_FOUND)
def p1_found(spark, d):
    limit = _limit(spark, d, "chunk")
    pieces = split.split_texts(table(spark, d, "corpus_chunks"), "chunk_id", "text", only_long=True, **limit)
    return split.forced_stretches(pieces, limit["limit"]).select(F.col("id").alias("chunk_id"), "n_forced")


@R.query("p1_pieces")
def p1_pieces(spark, d):
    """Every piece of every text that is too long, placed in the chunk by its metadata."""
    limit = _limit(spark, d, "chunk")
    pieces = split.split_texts(table(spark, d, "corpus_chunks"), "chunk_id", "text", only_long=True, keep=("doc_id", "metadata"), **limit)
    place = F.struct(F.col("metadata.title").alias("title"), F.col("metadata.section").alias("section"), F.col("metadata.source_path").alias("source_path"), "char_start", "char_end")
    return pieces.select("doc_id", F.col("id").alias("chunk_id"), "piece_no", "cut", "text", place.alias("metadata"))


# Problem 2: the ten most similar vectors.
_P2_FOUND = """
with u as (select vec_id, cast(embedding as double[]) as e from chunk_vectors
           where vec_id is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
             and len(list_filter(embedding, lambda x: x <> 0)) > 0),
c as (select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.e, b.e), 6) as c from u a join u b on a.vec_id <> b.vec_id),
t as (select a, b, c, row_number() over (partition by a order by c desc, b) as n from c)
select distinct least(a, b) as vec_lo, greatest(a, b) as vec_hi from t where n <= 10 and c >= 0.95
"""


@R.query("p2_found", _P2_FOUND)
def p2_found(spark, d):
    return similar.similar_pairs(table(spark, d, "chunk_vectors"), "vec_id", "embedding", dim=64, least=0.95).toDF("vec_lo", "vec_hi")


@R.query("p2_neighbours", _P2_FOUND.split("select distinct")[0] + "select a as vec_id, b as other_id, c as cosine, cast(n as integer) as pos from t where n <= 10 and a % 50 = 0")
def p2_neighbours(spark, d):
    """The stated queries are the ids divisible by 50; for them every list that may hold more is scanned, in blocks, with the least cosine that their nearest lists give."""
    vectors = table(spark, d, "chunk_vectors")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"))
    return similar.Index(vectors, "vec_id", "embedding", dim=64).neighbours(asked, exact=True).toDF("vec_id", "other_id", "cosine", "pos")


@R.query("p2_similar")
def p2_similar(spark, d):
    """The ten most similar of every usable vector, from its nearest lists."""
    return similar.Index(table(spark, d, "chunk_vectors"), "vec_id", "embedding", dim=64, probes=12).neighbours().toDF("vec_id", "other_id", "cosine", "pos")


# Problem 3: top N of every group.
_P3_FOUND = """
select query_id, chunk_id, pos from (
  select query_id, chunk_id, cast(row_number() over (partition by query_id order by s desc, chunk_id) as integer) as pos
  from (select query_id, chunk_id, max(score) as s from fusion_results
        where query_id is not null and chunk_id is not null and score is not null and not isnan(score) group by all)) where pos <= 10
"""


@R.query("p3_found", _P3_FOUND)
def p3_found(spark, d):
    return top_n.top_n_per_group(table(spark, d, "fusion_results"), "query_id", "score", "chunk_id", 10)


# Problem 4: near-duplicate records with small edits. The table's definition: three words, 0.6, thirty words.
_P4 = {"width": 3, "similarity": 0.6, "min_words": 30}

_P4_FOUND = r"""
with t as (select chunk_id, regexp_extract_all(lower(any_value(text)), '[\p{L}\p{N}]+') as w
           from corpus_chunks where chunk_id is not null and text is not null group by chunk_id),
long as (select chunk_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) as s
         from t where len(w) >= 30),
runs as (select chunk_id, len(s) as n, unnest(s) as g from long)
select a.chunk_id as chunk_lo, b.chunk_id as chunk_hi
from runs a join runs b on a.g = b.g and a.chunk_id < b.chunk_id
group by 1, 2, a.n, b.n having count(*) * 5 >= 3 * (a.n + b.n - count(*))
"""


@R.query("p4_found", _P4_FOUND)
def p4_found(spark, d):
    return near_duplicates.near_duplicate_pairs(table(spark, d, "corpus_chunks"), "chunk_id", "text", **_P4).toDF("chunk_lo", "chunk_hi")


@R.query("p4_groups")
def p4_groups(spark, d):
    return near_duplicates.near_duplicate_groups(table(spark, d, "corpus_chunks"), "chunk_id", "text", **_P4)


# Problem 5: overlaps of the evaluation splits with train, by the table's definition.
_P5 = {"id_col": "query_id", "text_col": "query", "key_col": "target_doc_id", "split_col": "split", "similarity": 0.75}

_P5_RECORDS = r"""
with r as (select query_id, list_distinct(regexp_extract_all(lower(min(query)), '[\p{L}\p{N}]+')) as w, min(split) as split, min(lower(trim(target_doc_id))) as k
           from lf_examples where query_id is not null group by query_id),
u as (select * from r where len(w) > 0 and k is not null and split is not null),
m as (select a.query_id as train_id, b.query_id as test_id, len(list_intersect(a.w, b.w)) as c, len(a.w) as m, len(b.w) as n
      from u a join u b on a.k = b.k where a.split = 'train' and b.split <> 'train'),
f as (select * from m where c * 4 >= 3 * (m + n - c))
"""


@R.query("p5_found", _P5_RECORDS + "select least(train_id, test_id) as query_lo, greatest(train_id, test_id) as query_hi from f")
def p5_found(spark, d):
    return overlaps.overlap_pairs(table(spark, d, "lf_examples"), **_P5).toDF("query_lo", "query_hi")


_P5_REPORT = """, b as (select test_id, bool_or(c = m and c = n) as same from f group by 1)
select u.split, s.source, count(*) as n_records, count(*) filter (b.same) as n_same, count(*) filter (not b.same) as n_near
from u join (select distinct query_id, coalesce(source, '(none)') as source from lf_examples) s using (query_id) left join b on b.test_id = u.query_id
where u.split <> 'train' group by 1, 2
"""


@R.query("p5_report", _P5_RECORDS + _P5_REPORT)
def p5_report(spark, d):
    return overlaps.overlap_report(table(spark, d, "lf_examples"), source_col="source", **_P5)


_P5_COVERAGE = """, c as (select test_id, list_sort(b.w) as train_words, max(c * 1.0 / n) as covered from f join u b on b.query_id = f.train_id group by 1, 2)
select test_id as query_id, count(*) as n_train, round(max(covered), 6) as covered from c group by 1
"""


@R.query("p5_coverage", _P5_RECORDS + _P5_COVERAGE)
def p5_coverage(spark, d):
    """Of every overlapping query: the different train queries it overlaps, and how much of it one of them holds."""
    found = overlaps.overlap_coverage(table(spark, d, "lf_examples"), **_P5)
    return found.select(F.col("id").alias("query_id"), F.col("n_classes").alias("n_train"), F.round("covered", 6).alias("covered"))


# Problem 6: packing whole documents, sized in tokens, into containers of each `pack_*` capacity.
def _packings(spark, d):
    sizes = tokens.token_sizes(table(spark, d, "documents"), "doc_id", "text")
    limits = table(spark, d, "size_limits").where("purpose like 'pack\\_%' and unit = 'tokens'").select("purpose", "capacity").orderBy("purpose")
    for row in limits.collect():  # a row for each purpose, three in all
        yield row.purpose, int(row.capacity), pack.pack(sizes, "id", "tokens", capacity=int(row.capacity))


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


@R.query("p6_pack")
def p6_pack(spark, d):
    parts = [p.select(F.lit(purpose).alias("purpose"), F.col("id").alias("doc_id"), "piece_no", "container", "begin", "end") for purpose, _, p in _packings(spark, d)]
    return _union(parts)


@R.query("p6_summary")
def p6_summary(spark, d):
    parts = [pack.pack_summary(p, n).select(F.lit(purpose).alias("purpose"), F.lit(n).alias("capacity"), "*") for purpose, n, p in _packings(spark, d)]
    return _union(parts)


# Problem 7: the mix of mix_targets over domain (letters of the course code), language and source.
def _mixed(spark, d):
    documents = table(spark, d, "documents")
    named = documents.select("doc_id", "text", "source", F.lower(F.trim("lang")).alias("lang"), F.nullif(F.regexp_extract("course_code", "^([A-Za-z]+)", 1), F.lit("")).alias("domain"))
    sizes = tokens.token_sizes(named, "doc_id", "text", keep=("domain", "lang", "source"))
    targets = table(spark, d, "mix_targets")
    return mix.mix(sizes, targets, total=mix.HELD), sizes, targets


@R.query("p7_mix")
def p7_mix(spark, d):
    return _mixed(spark, d)[0].withColumnRenamed("id", "doc_id")


@R.query("p7_report")
def p7_report(spark, d):
    return mix.mix_report(*_mixed(spark, d), total=mix.HELD)


# Problem 8: reading levels of English documents.
def _model(spark, d):
    return reading.ReadingModel(table(spark, d, "documents"), table(spark, d, "reading_labels"), "doc_id", "text", "source", "reading_level")


@R.query("p8_found")
def p8_found(spark, d):
    graded = _model(spark, d).grade(table(spark, d, "documents").where("lang = 'en'"), "doc_id", "text")
    return graded.where("n_words >= 80").select(F.col("id").alias("doc_id"), "reading_level")


@R.query("p8_profile")
def p8_profile(spark, d):
    """All English texts, however their language is spelled, profiled by source and level."""
    english = table(spark, d, "documents").where("lower(trim(lang)) = 'en'")
    graded = _model(spark, d).grade(english, "doc_id", "text")
    sources = english.select(F.col("doc_id").alias("id"), F.coalesce(mix.canonical(F.col("source")), F.lit("none")).alias("source"))
    by_level = graded.join(sources, "id").groupBy("source", "reading_level").agg(F.count("*").alias("n_documents"), F.sum("n_words").alias("n_words"), F.avg("grade").alias("mean_grade"))
    whole = Window.partitionBy("source")
    return by_level.withColumn("share", F.col("n_documents") / F.sum("n_documents").over(whole))


@R.query("p8_validation")
def p8_validation(spark, d):
    """Calibrated held-out predictions against the labels, by source."""
    held = _model(spark, d).held_out
    hit = (F.round("level") == F.col("reading_level")).cast("int")
    return held.groupBy("source").agg(F.count("*").alias("n_labelled"), F.avg(hit).alias("accuracy"), F.avg(F.abs(F.col("calibrated") - F.col("level"))).alias("mean_error"))


def queries():
    return R.queries


def oracle_sql():
    return R.sql
