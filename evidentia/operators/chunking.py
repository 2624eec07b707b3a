"""Documents to sections, overlapping windows and chunks, row by row without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.functions.binding import bind

HEADING = r"(?s)^(#{1,6})\s+(.*?)\s*$"


def section_array(lines: Column) -> Column:
    """Sections as (section, line_start, line_end) of an array of lines, counted from 1; text before the first heading is none.

    Headings within code count. A text without headings is one section, `Document`.
    """

    def split_at(heads: Column) -> Column:
        def section(head: Column, i: Column) -> Column:
            title = F.concat_ws(" ", F.regexp_extract(head["line"], HEADING, 1), F.regexp_extract(head["line"], HEADING, 2))
            return F.struct(title.alias("section"), head["no"].alias("line_start"), F.coalesce(F.get(heads, i + 1)["no"] - 1, F.size(lines)).alias("line_end"))

        whole = F.array(F.struct(F.lit("Document").alias("section"), F.lit(1).alias("line_start"), F.size(lines).alias("line_end")))
        return F.when(F.size(heads) == 0, whole).otherwise(F.transform(heads, section))

    numbered = F.transform(lines, lambda line, i: F.struct((i + 1).alias("no"), line.alias("line")))
    return bind(F.filter(numbered, lambda h: h["line"].rlike(HEADING)), split_at)


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, sec_idx, section, line_start, line_end, sec_text) for docs (doc_id, text); blank sections are skipped."""
    found = docs.select("doc_id", X.lines(F.col("text")).alias("lines"))
    found = found.select("doc_id", "lines", F.posexplode(section_array(F.col("lines"))).alias("sec_idx", "s"))
    text = X.strip(F.array_join(F.slice("lines", F.col("s.line_start"), F.col("s.line_end") - F.col("s.line_start") + 1), "\n"))
    return found.select("doc_id", "sec_idx", "s.*", text.alias("sec_text")).where(F.col("sec_text") != "")


def window_array(text: Column, size: int, overlap: int) -> Column:
    """Windows (char_start, char_end, piece) of `size` characters, each begun `overlap` before the end of the last.

    Pieces are stripped, offsets aren't. A blank piece ends the sequence.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    step = size - overlap

    def of(text: Column, n: Column) -> Column:
        count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step).cast("int"))

        def window(i: Column) -> Column:
            start = i * step
            return F.struct(start.alias("char_start"), F.least(start + size, n).alias("char_end"), X.strip(F.substr(text, start + 1, F.lit(size))).alias("piece"))

        return F.transform(F.sequence(F.lit(0), count - 1), window)

    def before_blank(found: Column) -> Column:
        blank = F.array_position(F.transform(found, lambda w: w["piece"] == ""), True).cast("int")
        return F.when(blank > 0, F.slice(found, F.lit(1), blank - 1)).otherwise(found)

    return bind(text, lambda t: bind(F.length(t), lambda n: bind(of(t, n), before_blank)))


def windows(texts: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """(the columns but `text`, win_idx, char_start, char_end, piece) for each window of each text."""
    kept = [c for c in texts.columns if c != "text"]
    found = texts.where("text is not null").select(*kept, F.posexplode(window_array(F.col("text"), size, overlap)).alias("win_idx", "w"))
    return found.select(*kept, "win_idx", "w.*")


def build_chunks(docs: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Chunks of docs (source_path, text): ids, running numbers over the document, text and metadata."""
    named = docs.where("text is not null").select(X.stable_doc_id(F.col("source_path"), F.col("text")).alias("doc_id"), "source_path", "text")
    held = named.select("doc_id", "source_path", X.lines(F.col("text")).alias("lines"))
    held = held.select("*", section_array(F.col("lines")).alias("sections"))

    def of_section(s: Column) -> Column:
        body = X.strip(F.array_join(F.slice(F.col("lines"), s["line_start"], s["line_end"] - s["line_start"] + 1), "\n"))
        return F.transform(window_array(body, size, overlap), lambda w: F.struct(s["section"].alias("section"), s["line_start"].alias("line_start"), s["line_end"].alias("line_end"), w["char_start"].alias("char_start"), w["char_end"].alias("char_end"), w["piece"].alias("piece")))

    chunks = held.select("doc_id", "source_path", F.posexplode(F.flatten(F.transform("sections", of_section))).alias("chunk_idx", "c"))
    meta = F.struct(X.basename(F.col("source_path")).alias("title"), F.col("c.section"), F.col("source_path"), F.col("c.line_start"), F.col("c.line_end"), F.col("c.char_start"), F.col("c.char_end"))
    return chunks.select("doc_id", X.chunk_id(F.col("doc_id"), F.col("chunk_idx")).alias("chunk_id"), "chunk_idx", F.col("c.piece").alias("text"), meta.alias("metadata"))


def manifest(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(source_path, chars, chunks) of each document, those without chunks too."""
    counted = chunks.groupBy(F.col("metadata.source_path").alias("source_path")).agg(F.count("*").alias("chunks"))
    sizes = docs.groupBy("source_path").agg(F.sum(F.length("text")).alias("chars"))
    return sizes.join(counted, "source_path", "left").select("source_path", F.coalesce("chars", F.lit(0).cast("long")).alias("chars"), F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"))


def read_lines(docs: DataFrame, requests: DataFrame, most: int = 4000) -> DataFrame:
    """The lines asked for by requests (source_path, line_start, line_end) of docs (source_path, text).

    Bounds are moved into the document; a range past its end is empty. Only
    paths of the table can be read, with either slash.
    """
    texts = docs.select(X.slashes(F.col("source_path")).alias("source_path"), X.lines(F.col("text")).alias("lines"))
    asked = requests.select(X.slashes(F.col("source_path")).alias("source_path"), F.greatest(F.lit(1), F.col("line_start")).alias("line_start"), "line_end")
    n = F.size("lines")
    end = F.least(F.greatest(F.col("line_start"), F.col("line_end")), n)
    found = asked.join(texts, "source_path").withColumn("line_end", end)
    body = X.strip(F.array_join(F.slice("lines", F.col("line_start"), F.greatest(F.lit(0), F.col("line_end") - F.col("line_start") + 1)), "\n"))
    return found.select("source_path", "line_start", "line_end", X.shorten(body, most, "\n...[truncated]").alias("content"))
