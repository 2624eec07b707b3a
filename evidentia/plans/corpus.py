"""Queries of the corpus: words, ids, sections, windows, chunks, manifest, line ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import chunking
from evidentia.plans.base import CHUNKS, SP, chunks, sql_lines, sql_strip, sql_tokens
from evidentia.plans.registry import Registry
from evidentia.sources.tables import table

R = Registry()


@R.query("tokenize", f"with {CHUNKS} select chunk_id, len({sql_tokens('text')}) as n_tokens, md5(array_to_string({sql_tokens('text')}, ' ')) as tokens_md5 from ch where text is not null")
def tokenize(spark, d):
    tokens = chunks(spark, d).where("text is not null").select("chunk_id", X.tokenize(F.col("text")).alias("t"))
    return tokens.select("chunk_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@R.query("stable_doc_id", "select doc_id, substr(sha1(concat_ws('|', source_path, cast(length(text) as varchar))), 1, 16) as stable_id from documents where text is not null")
def stable_doc_id(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.stable_doc_id(F.col("source_path"), F.col("text")).alias("stable_id"))


_SECTIONS = rf"""
l as (select doc_id, lines, unnest(lines) as line, generate_subscripts(lines, 1) as no from (select doc_id, {sql_lines('text')} as lines from documents where text is not null)),
h as (select doc_id, len(lines) as n, lines, no, concat_ws(' ', regexp_extract(line, '^(#{{1,6}})\s+(.*?)\s*$', 1, 's'), regexp_extract(line, '^(#{{1,6}})\s+(.*?)\s*$', 2, 's')) as section
      from l where regexp_matches(line, '^(#{{1,6}})\s+(.*?)\s*$', 's')),
s as (select doc_id, lines, section, no as line_start, lead(no, 1, n + 1) over (partition by doc_id order by no) - 1 as line_end, row_number() over (partition by doc_id order by no) - 1 as sec_idx from h
      union all select doc_id, {sql_lines('text')}, 'Document', 1, len({sql_lines('text')}), 0 from documents where text is not null and doc_id not in (select doc_id from h)),
sections as (select doc_id, cast(sec_idx as integer) as sec_idx, section, cast(line_start as integer) as line_start, cast(line_end as integer) as line_end,
      {sql_strip("array_to_string(lines[line_start:line_end], chr(10))")} as sec_text from s)
"""


@R.query("md_sections", f"with {_SECTIONS} select * from sections where sec_text <> ''")
def md_sections(spark, d):
    return chunking.sections(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))


_WINDOWS = rf"""
w as (select *, unnest(range(0, case when length(sec_text) <= 1200 then 1 else cast(1 + ceil((length(sec_text) - 1200) / 1000) as bigint) end)) as win_idx from sections where sec_text <> ''),
p as (select *, win_idx * 1000 as char_start, least(win_idx * 1000 + 1200, length(sec_text)) as char_end, {sql_strip("substr(sec_text, win_idx * 1000 + 1, 1200)")} as piece from w),
b as (select *, min(case when piece = '' then win_idx end) over (partition by doc_id, sec_idx) as blank from p),
windows as (select * from b where blank is null or win_idx < blank)
"""


@R.query("chunk_windows", f"with {_SECTIONS}, {_WINDOWS} select doc_id, sec_idx, cast(win_idx as integer) as win_idx, cast(char_start as integer) as char_start, cast(char_end as integer) as char_end, piece from windows")
def chunk_windows(spark, d):
    return chunking.windows(md_sections(spark, d).select("doc_id", "sec_idx", F.col("sec_text").alias("text")))


_BUILT = rf"""{_SECTIONS}, {_WINDOWS},
built as (select substr(sha1(concat_ws('|', d.source_path, cast(length(d.text) as varchar))), 1, 16) as stable_id, d.source_path, w.*,
          row_number() over (partition by w.doc_id order by w.line_start, w.char_start) - 1 as chunk_idx from windows w join documents d using (doc_id))
"""


@R.query(
    "build_chunks",
    f"with {_BUILT} select stable_id as doc_id, stable_id || '::c' || lpad(cast(chunk_idx as varchar), 5, '0') as chunk_id, piece as text, section, line_start, line_end, cast(char_start as integer) as char_start, cast(char_end as integer) as char_end, string_split(replace(source_path, chr(92), '/'), '/')[-1] as title from built",
)
def build_chunks(spark, d):
    made = chunking.build_chunks(table(spark, d, "documents"))
    fields = ("section", "line_start", "line_end", "char_start", "char_end", "title")
    return made.select("doc_id", "chunk_id", "text", *[F.col(f"metadata.{c}").alias(c) for c in fields])


@R.query(
    "corpus_manifest",
    f"""with {_BUILT}, n as (select source_path, count(*) as chunks from built group by 1)
    select source_path, cast(coalesce(sum(length(text)), 0) as bigint) as chars, coalesce(any_value(n.chunks), 0) as chunks from documents left join n using (source_path) where source_path is not null group by 1""",
)
def corpus_manifest(spark, d):
    docs = table(spark, d, "documents").where("source_path is not null")
    return chunking.manifest(chunking.build_chunks(docs), docs)


@R.query(
    "corpus_totals",
    f"with {_BUILT} select (select count(*) from documents where text is not null) as n_documents, count(*) as n_chunks, cast(sum(length(piece)) as bigint) as n_chars, 1200 as chunk_size, 200 as overlap from built",
)
def corpus_totals(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    made = chunking.build_chunks(docs).agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))
    counted = docs.agg(F.count("*").alias("n_documents"))
    return counted.crossJoin(made).select("*", F.lit(1200).alias("chunk_size"), F.lit(200).alias("overlap"))  # one row each


@R.query(
    "normalize_records",
    f"""select chunk_id, coalesce(nullif({sql_strip("doc_id")}, ''), nullif(split_part(chunk_id, '::c', 1), ''), 'UNKNOWN_DOC') as group_key,
        try_cast(nullif(regexp_extract(chunk_id, '::c(\\d+)$', 1), '') as integer) as chunk_idx, coalesce(nullif({sql_strip("metadata.section")}, ''), 'Document') as section,
        replace(metadata.source_path, chr(92), '/') as source_path, coalesce(length(text), 0) as n_chars, count(*) as n_rows
        from corpus_chunks where chunk_id is not null group by all""",
)
def normalize_records(spark, d):
    """Records with missing or differently spelled fields, brought to one form, and how often each occurs."""
    filled = lambda c: F.nullif(X.strip(F.col(c)), F.lit(""))
    rows = table(spark, d, "corpus_chunks").where("chunk_id is not null").select(
        "chunk_id",
        F.coalesce(filled("doc_id"), F.nullif(F.substring_index("chunk_id", "::c", 1), F.lit("")), F.lit("UNKNOWN_DOC")).alias("group_key"),
        X.chunk_index(F.col("chunk_id")).alias("chunk_idx"),
        F.coalesce(filled("metadata.section"), F.lit("Document")).alias("section"),
        X.slashes(F.col("metadata.source_path")).alias("source_path"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n_rows"))


@R.query(
    "open_line_range",
    rf"""with r as (select distinct replace(metadata.source_path, chr(92), '/') as source_path, greatest(1, metadata.line_start) as line_start, metadata.line_end as line_end
               from corpus_chunks where metadata.source_path is not null and metadata.line_start is not null and metadata.line_end is not null),
    t as (select doc_id, replace(source_path, chr(92), '/') as source_path, {sql_lines("text")} as lines, substr(course_code, 1, 8) as code from documents where text is not null),
    q as (select doc_id, source_path, lines, 2 as line_start, least(greatest(2, 12), len(lines)) as line_end from t),
    b as (select *, {sql_strip("array_to_string(lines[line_start:line_end], chr(10))")} as body from q)
    select doc_id, line_start, cast(line_end as integer) as line_end, case when length(body) > 4000 then substr(body, 1, 4000) || chr(10) || '...[truncated]' else body end as content from b""",
)
def open_line_range(spark, d):
    """Lines 2 to 12 of every document."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("source_path"), "text")
    asked = docs.select("source_path", F.lit(2).alias("line_start"), F.lit(12).alias("line_end"))
    return chunking.read_lines(docs, asked).select(F.col("source_path").cast("long").alias("doc_id"), "line_start", "line_end", "content")


@R.query("query_routing", r"""select query_id, query, regexp_matches(query, '(?i)\bcomp\s*\d{4}\b') or regexp_matches(query, '\b\d{4}\b') or regexp_matches(query, '(?i)\bcourse(s)?\b') as about_courses
    from (select distinct query_id, query from lf_examples where query_id is not null and query is not null)""")
def query_routing(spark, d):
    queries = table(spark, d, "lf_examples").where("query_id is not null and query is not null").select("query_id", "query").distinct()
    return queries.select("query_id", "query", X.about_courses(F.col("query")).alias("about_courses"))


@R.query("extract_code", r"""with c as (select doc_id, regexp_extract(coalesce(text, ''), '(?i)\bCOMP\d{4}[A-Z]?\b') as a, regexp_extract(coalesce(title, ''), '(?i)\bCOMP\d{4}[A-Z]?\b') as b from documents)
    select doc_id, upper(coalesce(nullif(a, ''), nullif(b, ''))) as code from c""")
def extract_code(spark, d):
    return table(spark, d, "documents").select("doc_id", X.course_code(F.col("text"), F.col("title")).alias("code"))


#: What is asked about each course.
_TEMPLATES = ("{}", "{} assessment", "{} exam", "{} schedule")


@R.query("template_queries", r"""with c as (select doc_id, regexp_extract(coalesce(text, ''), '(?i)\bCOMP\d{4}[A-Z]?\b') as a, regexp_extract(coalesce(title, ''), '(?i)\bCOMP\d{4}[A-Z]?\b') as b from documents),
    u as (select distinct upper(coalesce(nullif(a, ''), nullif(b, ''))) as code from c)
    select code, cast(i as integer) as qi, code || ['', ' assessment', ' exam', ' schedule'][i + 1] as query from (select code, unnest(range(0, 4)) as i from u where code is not null)""")
def template_queries(spark, d):
    codes = extract_code(spark, d).where("code is not null").select("code").distinct()
    made = F.array(*[F.format_string(t.replace("{}", "%s"), F.col("code")) for t in _TEMPLATES])
    return codes.select("code", F.posexplode(made).alias("qi", "query"))


@R.query("small_talk_flag", """select query_id, query, list_contains(list_transform(['hello', 'hi', 'hey', 'thanks', 'thank you', 'good morning', 'how are you'], lambda p: contains(lower(query), p)), true) as within,
    regexp_matches(lower(query), '\\b(hello|hi|hey|thanks|thank you|good morning|how are you)\\b') as whole
    from (select distinct query_id, query from lf_examples where query_id is not null and query is not null)""")
def small_talk_flag(spark, d):
    """Greetings within words (as in `this`) and as whole words."""
    phrases = ("hello", "hi", "hey", "thanks", "thank you", "good morning", "how are you")
    lowered = F.lower("query")
    within = F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(lowered, p))
    queries = table(spark, d, "lf_examples").where("query_id is not null and query is not null").select("query_id", "query").distinct()
    return queries.select("query_id", "query", within.alias("within"), lowered.rlike(r"\b(" + "|".join(phrases) + r")\b").alias("whole"))


@R.query("page_text", rf"""select doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(text, '<(script|style)\b[^>]*>.*?</(script|style)\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '{SP}+', ' ', 'g')) as content from documents where contains(text, '<')""")
def page_text(spark, d):
    """Documents with markup, as the plain text that a page parser would give."""
    return table(spark, d, "documents").where("contains(text, '<')").select("doc_id", X.html_text(F.col("text")).alias("content"))
