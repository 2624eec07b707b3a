"""From hits to contexts: neighbours, sections, groups, budgets, numbered blocks, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import text as X


def neighbours(seeds: DataFrame, chunks: DataFrame, width: int = 1) -> DataFrame:
    """(query_id, chunk_id) within `width` numbers of a seed (query_id, doc_id, chunk_idx) in its document, seeds included.

    The range join is an equi-join: every seed names the numbers it wants.
    """
    at = F.col("chunk_idx")
    wanted = seeds.where("chunk_idx is not null").select("query_id", "doc_id", F.explode(F.sequence(F.greatest(F.lit(0), at - width), at + width)).alias("chunk_idx")).distinct()
    return wanted.join(chunks.select("doc_id", "chunk_idx", "chunk_id"), ["doc_id", "chunk_idx"]).select("query_id", "chunk_id").distinct()


def same_section(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of all chunks in the section and document of a seed (query_id, doc_id, section)."""
    wanted = seeds.where("section is not null and section <> ''").select("query_id", "doc_id", "section").distinct()
    return wanted.join(chunks.select("doc_id", "section", "chunk_id"), ["doc_id", "section"]).select("query_id", "chunk_id").distinct()


def expand(hits: DataFrame, chunks: DataFrame, *, width: int = 1, sections: bool = True, compat: bool = False) -> DataFrame:
    """(query_id, doc_id, chunk_id, chunk_idx, score, pos): hits (query_id, chunk_id, score, pos) and what belongs to them.

    Documents are in the order in which hits first name them, chunks in that of
    the document; chunks that weren't hits have score 0. With `compat`, hits are
    only regrouped.
    """
    places = chunks.select("chunk_id", "doc_id", "chunk_idx", "section")
    seeds = hits.select("query_id", "chunk_id", "score", "pos").join(places, "chunk_id")
    kept = seeds.select("query_id", "chunk_id")
    if not compat:
        kept = kept.unionByName(neighbours(seeds, chunks, width))
        if sections:
            kept = kept.unionByName(same_section(seeds, chunks))
    groups = seeds.groupBy("query_id", "doc_id").agg(F.min("pos").alias("first_pos"))
    scores = seeds.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    out = kept.distinct().join(places.drop("section"), "chunk_id").join(groups, ["query_id", "doc_id"]).join(scores, ["query_id", "chunk_id"], "left")
    order = Window.partitionBy("query_id").orderBy("first_pos", F.asc_nulls_last("chunk_idx"), "chunk_id")
    return out.select("query_id", "doc_id", "chunk_id", "chunk_idx", F.coalesce("score", F.lit(0.0)).alias("score"), F.row_number().over(order).alias("pos"))


def block(pos: Column, doc_id: Column, chunk_idx: Column, text: Column) -> Column:
    """`[pos] doc (chunk=n)`, a line break, and the stripped text."""
    number = F.when(chunk_idx.isNotNull(), F.concat(F.lit(" (chunk="), chunk_idx.cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("["), pos.cast("string"), F.lit("] "), doc_id, number, F.lit("\n"), X.strip(text))


def blocks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, pos, block); hits without text have no block, but their number is used up."""
    with_text = hits.select("query_id", "chunk_id", "pos").join(chunks.select("chunk_id", "doc_id", "chunk_idx", "text"), "chunk_id").where("text is not null and text <> ''")
    return with_text.select("query_id", "pos", block(F.col("pos"), F.coalesce("doc_id", F.lit("UNKNOWN_DOC")), F.col("chunk_idx"), F.col("text")).alias("block"))


def within_budget(made: DataFrame, most: int = 12000) -> DataFrame:
    """The blocks of each query before the first that would exceed the budget; the sum only grows, so it is a prefix."""
    upto = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return made.withColumn("total", F.sum(F.length("block")).over(upto)).where(F.col("total") <= most)


def assemble(made: DataFrame) -> DataFrame:
    """(query_id, n_blocks, context): the blocks in order with a blank line between; a budget bounds each group."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "block")))
    return made.groupBy("query_id").agg(F.count("*").alias("n_blocks"), F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n").alias("context"))


#: The frame of a prompt: instructions, context, question.
PROMPT = "Answer the question from the context and cite its blocks as [n]. Say so if the context has no answer.\n\nContext:\n%s\n\nQuestion: %s\nAnswer:"


def prompt(context: Column, question: Column) -> Column:
    return F.format_string(PROMPT, F.coalesce(context, F.lit("")), question)
