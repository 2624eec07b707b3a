"""Text expressions; white space, words and digits are those of Unicode, positions are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, in a form that Java's and RE2's patterns both accept.
SPACE = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
WORD = r"[\p{L}\p{N}_]+"
#: The shape of course codes and the patterns that mark a query about courses.
CODE = r"(?i)\bCOMP\d{4}[A-Z]?\b"
COURSE_PATTERNS = (r"(?i)\bcomp\s*\d{4}\b", r"\b\d{4}\b", r"(?i)\bcourse(s)?\b")
#: The headings of answers' citations and of context blocks.
CITATION = r"\[(\d{1,3})\]"
BLOCK = r"(?m)^\[(\d{1,3})\]\s"


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokenize(text: Column) -> Column:
    """Lower-cased words; the digit runs of words that mix letters and digits are added at the end."""
    base = extract_all(F.lower(text), WORD)
    mixed = F.filter(base, lambda w: w.rlike(r"\p{L}") & w.rlike(r"\p{Nd}"))
    return F.concat(base, F.flatten(F.transform(mixed, lambda w: extract_all(w, r"\p{Nd}+"))))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE[1:]}")


def unify_breaks(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def lines(text: Column) -> Column:
    """The lines of a text; a last line break ends a line and begins none."""
    parts = F.split(unify_breaks(text), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def basename(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def stable_doc_id(path: Column, text: Column) -> Column:
    """Sixteen hexadecimal digits of the path and the text's length."""
    return F.substring(F.sha1(F.concat_ws("|", path, F.length(text).cast("string"))), 1, 16)


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat(doc_id, F.lit("::c"), F.lpad(index.cast("string"), 5, "0"))


def chunk_index(chunk: Column) -> Column:
    """The running number in a chunk id; null where there is none."""
    digits = F.regexp_extract(chunk, r"::c(\d+)$", 1)
    return F.when(digits != "", digits.cast("int"))


def course_code(text: Column, title: Column) -> Column:
    """The first course code of the text, else of the title, in capitals; null without any."""
    first = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), CODE, 0), F.lit(""))
    return F.upper(F.coalesce(first(text), first(title)))


def about_courses(query: Column) -> Column:
    found = query.rlike(COURSE_PATTERNS[0])
    for pattern in COURSE_PATTERNS[1:]:
        found = found | query.rlike(pattern)
    return F.coalesce(found, F.lit(False))


def numbers(text: Column, pattern: str) -> Column:
    """The distinct integers that a pattern's first group finds, in order."""
    return F.array_sort(F.array_distinct(F.transform(extract_all(text, pattern, 1), lambda x: x.cast("int"))))


def shorten(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def html_text(page: Column) -> Column:
    """The text of a page: no scripts, styles, comments or tags, the five common entities read."""
    for pattern in (r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        page = F.regexp_replace(page, pattern, " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        page = F.replace(page, F.lit(entity), F.lit(sign))
    return one_line(page)


def tolerant_json(answer: Column) -> Column:
    """The JSON object in a model's answer: fences are dropped, else the text from the first `{` to the last `}` counts; null if neither parses."""
    plain = strip(answer)
    plain = F.when(plain.startswith("```"), F.regexp_replace(F.regexp_replace(plain, "`", ""), r"^json\n", "")).otherwise(plain)
    inner = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    return F.coalesce(F.to_json(F.try_parse_json(plain)), F.to_json(F.try_parse_json(inner)))
