import random
import re

import pytest

from evidentia.llm import split, top_n

PLAIN = re.compile(r"\s*[\n\r]\s*|(?<=[.!?])\s+|(?<=[。！？])")


@pytest.mark.parametrize("limit,overlap", [(20, 5), (30, 0), (50, 10), (12, 11)])
def test_pieces(limit, overlap):
    rng = random.Random(limit)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", " ", ". ", "。", "\n", "  \n ", "！ ", "x" * rng.randint(1, 60), "\t", ".", "\r\n", "\n\n"]) for _ in range(rng.randint(0, 80)))
        found = split.pieces(text, limit, overlap)
        if len(text) <= limit:
            assert found == [(0, len(text), 0, -1, 0)]
            continue
        assert all(0 < b - a <= limit for a, b, *_ in found)
        assert found[0][0] == 0 and found[-1][1] == len(text)
        assert all(y[0] == max(0, x[1] - overlap) for x, y in zip(found, found[1:]))
        assert "".join(text[(a if k == 0 else found[k - 1][1]) : b] for k, (a, b, *_) in enumerate(found)) == text
        assert len({x[3] for x in found if x[4] > limit}) == sum(len(s) > limit for s in PLAIN.split(text))


def test_strongest_boundary_near_the_midpoint():
    text = "aaaa aaaa.\nbbbb bbbb. bbbb bbb\n\ncccc cccc. cccc cccc"
    assert split.cuts(text, 30)[0] == (text.index("\n\n"), 5)
    assert all(text[p - 1] != "a" or text[p] != "a" for p, _ in split.cuts(text, 12))


def test_split_rows(spark):
    long = "Sentence one is here. " * 5000
    rows = [("a", "x" * 50, 1, None), ("a", "x" * 50, 1, None), ("b", "", 2, "m"), ("c", None, 3, "m"), (None, "y" * 50, 4, "m"), ("d", long, None, "m")]
    df = spark.createDataFrame(rows, "key string, text string, piece_no int, meta string")
    got = split.split_texts(df, "key", "text", limit=20, overlap=5, keep=("piece_no", "meta")).collect()
    assert {r.id for r in got} == {"a", "b", "d"} and [r.text for r in got if r.id == "b"] == [""]
    pieces = sorted((r for r in got if r.id == "d"), key=lambda r: r.piece_no)
    assert all(len(r.text) <= 20 and r.text == long[r.char_start : r.char_end] and r.meta == "m" and r.piece_no_kept is None for r in pieces)
    forced = {r.id: r.n_forced for r in split.forced_stretches(split.split_texts(df, "key", "text", limit=20, overlap=5, only_long=True), 20).collect()}
    assert forced == {"a": 1, "d": 5000}
    with pytest.raises(ValueError):
        split.split_texts(df, "key", "text", limit=5, overlap=5)


def test_split_nothing(spark):
    assert split.split_texts(spark.createDataFrame([], "id string, text string"), "id", "text", limit=10, overlap=2).count() == 0


@pytest.mark.parametrize("n", [1, 3, 5000])
def test_hot_group_and_ties(spark, n):
    rows = [("hot", f"c{k % 9000}", float(k % 7), k) for k in range(20_000)] + [("b", "x", 1.0, 0), ("b", "x", 2.0, 0), ("b", "y", 2.0, 0), ("b", "w", -0.0, 0), ("b", "v", 0.0, 0)]
    rows += [(None, "x", 1.0, 0), ("b", None, 9.0, 0), ("b", "z", None, 0), ("b", "u", float("nan"), 0)]
    df = spark.createDataFrame(rows, "q string, c string, s double, pos int")
    best = {}
    for q, c, s, _ in rows:
        if q and c and s is not None and s == s:
            best[q, c] = max(best.get((q, c), s), s)
    want = set()
    for q in ("hot", "b"):
        for k, (s, c) in enumerate(sorted((-s, c) for (g, c), s in best.items() if g == q)[:n]):
            want.add((q, c, k + 1))
    got = [tuple(r) for r in top_n.top_n_per_group(df, "q", "s", "c", n).collect()]
    assert len(got) == len(want) and set(got) == want


def test_top_n_of_nothing(spark):
    assert top_n.top_n_per_group(spark.createDataFrame([], "q string, s double, c string"), "q", "s", "c", 3).count() == 0
