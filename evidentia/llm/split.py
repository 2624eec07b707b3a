"""Splitting oversized texts at natural boundaries by recursive bisection.

A text longer than `limit` characters is cut at its strongest boundary near
the midpoint, and each half again until it is no longer than `limit - overlap`;
then every piece but the first is extended backwards by exactly `overlap`
characters. So no piece exceeds the limit, consecutive pieces share `overlap`
characters, and the pieces without their overlaps join to the whole text.

Boundaries, strongest first: a line break with a blank line, a line break,
whitespace after `.`, `!` or `?` and the place after `。`, `！` or `？`. What
remains between boundaries is a *stretch*. Only inside a stretch longer than a
piece may be is a cut forced: at whitespace near the midpoint, else between two
characters. The stretch is reported with the piece, so that texts without
natural boundaries can be found.

Defined cases: a text of at most `limit` characters (empty ones too) is one
piece, uncut; null ids and null texts give no rows. A repeated id counts once,
with the smallest of its texts. Lengths and offsets count code points. Any
whitespace run with a line break is one boundary.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLANK = re.compile(r"\s+")
_SPACE = re.compile(r"\s+|[。！？]")
_BREAK = re.compile(r"\r\n|[\n\r\v\f\x1c-\x1e\x85  ]")
#: Kinds of cut by strength.
KINDS = ("start", "hard", "space", "sentence", "line", "paragraph")


def boundaries(text: str) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Stretches (start, end); and the places to cut, with their strengths."""
    stretches, places, strengths, begin = [], [], [], 0
    for m in _SPACE.finditer(text):
        a, b = m.span()
        if text[a] in "。！？":
            end, begin_next, strength = b, b, 3
        else:
            breaks = len(_BREAK.findall(text, a, b))
            if not breaks and (a == 0 or text[a - 1] not in ".!?"):
                continue
            end, begin_next, strength = a, b, 5 if breaks > 1 else 4 if breaks else 3
        if end > begin or not stretches:
            stretches.append((begin, end))
        begin = begin_next
        if 0 < end < len(text):
            if places and places[-1] == end:
                strengths[-1] = max(strengths[-1], strength)
            else:
                places.append(end)
                strengths.append(strength)
    if begin < len(text):
        stretches.append((begin, len(text)))
    return stretches, places, strengths


def cuts(text: str, most: int) -> list[tuple[int, int]]:
    """(place, strength) of each cut, in order, such that no part is longer than `most`."""
    _, places, strengths = boundaries(text)
    found, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            continue
        middle, quarter = (a + b) // 2, max(1, (b - a) // 4)
        # Places strictly inside; first those of the middle half, the strongest, then the nearest.
        lo, hi = bisect_left(places, max(a + 1, middle - quarter)), bisect_right(places, min(b - 1, middle + quarter))
        if lo >= hi:
            lo, hi = bisect_right(places, a), bisect_left(places, b)
        if lo < hi:
            k = max(range(lo, hi), key=lambda i: (strengths[i], -abs(places[i] - middle)))
            place, strength = places[k], strengths[k]
        else:
            left = max((m.end() for m in _BLANK.finditer(text, max(a, middle - quarter), middle)), default=0)
            place, strength = (left, 2) if a < left < b else (middle, 1)
        found.append((place, strength))
        todo += [(a, place), (place, b)]
    return sorted(found)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(start, end, strength of the cut at its front, start and length of the stretch cut there or -1, 0)."""
    if len(text) <= limit:
        return [(0, len(text), 0, -1, 0)]
    stretches, _, _ = boundaries(text)
    begins = [a for a, _ in stretches]
    found = [(0, 0), *cuts(text, limit - overlap)]
    ends = [place for place, _ in found[1:]] + [len(text)]
    out = []
    for (place, strength), end in zip(found, ends):
        at, chars = -1, 0
        if strength in (1, 2) and (k := bisect_right(begins, place) - 1) >= 0 and place < stretches[k][1]:
            at, chars = begins[k], stretches[k][1] - begins[k]
        out.append((max(0, place - overlap), end, strength, at, chars))
    return out


_PIECES = "id string, piece_no int, char_start int, char_end int, cut string, stretch_start int, stretch_chars int, text string"


def split_texts(df: DataFrame, id_col: str, text_col: str, *, limit: int, overlap: int, only_long: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: (id, piece_no from 0, char_start, char_end, cut, stretch_start, stretch_chars, text), then the columns `keep`.

    `only_long` leaves out texts that need no cut. Columns of `keep` (of kinds
    with an order) are the greatest of an id's rows, so nulls give way; one named like a column of the pieces gets `_kept` added.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    kept = [F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)]
    source = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), *kept).where("id is not null and text is not null")
    if only_long:
        source = source.where(F.length("text") > limit)
    source = source.groupBy("id").agg(F.min("text").alias("text"), *[F.max(f"kept_{k}").alias(f"kept_{k}") for k in range(len(keep))])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            rows, origin, size = [], [], 0
            for i, text in enumerate(texts):
                for k, (a, b, strength, at, chars) in enumerate(pieces(text, limit, overlap)):
                    rows.append((ids[i], k, a, b, KINDS[strength], at, chars, text[a:b]))
                    origin.append(i)
                    size += b - a
                if size > 4_000_000:
                    yield made(batch, rows, origin)
                    rows, origin, size = [], [], 0
            if rows:
                yield made(batch, rows, origin)

    def made(batch, rows, origin):
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] + [batch.column(f"kept_{k}").take(pa.array(origin)) for k in range(len(keep))]
        return pa.RecordBatch.from_arrays(columns, [*[c.split()[0] for c in _PIECES.split(", ")], *[f"kept_{k}" for k in range(len(keep))]])

    extra = "".join(f", kept_{k} {source.schema[f'kept_{k}'].dataType.simpleString()}" for k in range(len(keep)))
    taken = {f.split()[0] for f in _PIECES.split(", ")}
    names = {f"kept_{k}": c.split(".")[-1] for k, c in enumerate(keep)}
    return source.mapInArrow(run, _PIECES + extra).withColumnsRenamed({k: f"{c}_kept" if c in taken else c for k, c in names.items()})


def forced_stretches(split: DataFrame, limit: int) -> DataFrame:
    """(id, n_forced) of split texts: their stretches of more than `limit` characters, which only forced cuts divide."""
    long = F.when(F.col("stretch_chars") > limit, F.col("stretch_start"))
    return split.select("id", long.alias("stretch")).groupBy("id").agg(F.size(F.collect_set("stretch")).alias("n_forced"))
