import random
import re

import pytest

from evidentia.llm import overlaps as O

ARGS = ("qid", "query", "target", "split")
SCHEMA = "qid string, query string, target string, split string, source string, key string, cls string"


def brute(rows, similarity):
    once = {}
    for qid, query, target, part, *_ in rows:
        if qid and query and target and part:
            once[qid] = (part == "train", target.strip(" ").lower(), frozenset(re.findall(r"[^\W_]+", query.lower())))
    out = set()
    for a, (x, t, v) in once.items():
        for b, (y, u, w) in once.items():
            if x and not y and t == u and v and w and len(v & w) >= similarity * len(v | w) - 1e-9:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("similarity", [0.5, 0.75, 1.0])
def test_equals_brute_force(spark, similarity):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    rows = []
    for k in range(400):
        query = " ".join(rng.choices(words, k=rng.randint(1, 12))) if k % 3 else " ".join(rng.sample(rows[-1][1].split() + ["W1"], k=len(rows[-1][1].split())) if rows else ["w1"])
        rows.append((f"q{k:03d}", query, rng.choice(["t1", " T1 ", "t2"]), rng.choice(["train", "train", "dev", "test"]), rng.choice(["s", None]), "k", None))
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in O.overlap_pairs(df, *ARGS, similarity=similarity).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, similarity)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [("a", "one two", "t", "train"), ("a", "one two", "t", "train"), ("b", "two ONE", "T ", "dev"), ("c", "", "t", "dev"), ("d", None, "t", "dev"), ("e", "one two", None, "dev"), (None, "one two", "t", "dev"), ("f", "one two", "t", None), ("g", long, "t", "train"), ("h", long + " x", "t", "test")]
    df = spark.createDataFrame([(*r, "s", None, "z") for r in rows], SCHEMA)
    assert {tuple(r) for r in O.overlap_pairs(df, *ARGS, similarity=0.75).collect()} == {("a", "b"), ("g", "h")}
    report = {(r.split, r.source): (r.n_records, r.n_same, r.n_near) for r in O.overlap_report(df, *ARGS, "source", similarity=0.75).collect()}
    assert report == {("dev", "s"): (1, 1, 0), ("test", "s"): (1, 0, 1)}


def test_a_hot_group_of_copies(spark):
    rows = [(f"a{k}", "same words here", "t", "train", None, None, None) for k in range(300)] + [("b", "here same words", "t", "test", None, None, None)]
    assert O.overlap_pairs(spark.createDataFrame(rows, SCHEMA), *ARGS, similarity=0.75).count() == 300


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert O.overlap_pairs(df, *ARGS).count() == 0 and O.overlap_report(df, *ARGS, "source").count() == 0


def test_needed_span_is_shared_by_all_similar_sets():
    """For each pair of sizes, the worst way of cutting the shared words still leaves a span of that length."""
    for similarity in (0.5, 0.67, 0.75, 0.8, 0.9, 0.95):
        span = O.needed_span(similarity)
        assert 1 <= span <= O.SPAN
        for m in range(1, 60):
            for n in range(m, int(m / similarity + 1e-9) + 1):
                c = next(s for s in range(m + 1) if s >= similarity * (m + n - s) - 1e-9)
                d = m + n - 2 * c
                k = (span - 1) * (d + 1) + 1
                assert d == 0 or (k <= c and m - c + k - span <= span * (1 - similarity) * m + 1e-9 and n - c + k - span <= span * (1 - similarity) * n + 1e-9)


def test_the_pass_gives_the_spans_of_complete_runs():
    import pyarrow as pa

    depth = O.DEPTH
    rows = []
    for cls, words, trained in ((b"a", [5, 6, 7, 8], True), (b"b", [5, 6, 7, 9], False), (b"c", [5, 9, 9, 9], False), (b"d", [1, 2, 3, 4], True), (b"e", [8, 9, 1, 2], True)):
        rows.append((1, words + [0] * (depth - 4), cls, 4, 0, None, trained, not trained))
    rows.sort(key=lambda r: (r[0], r[1]))
    types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["k", "s", "cls", "size", "place", "before", "trained", "tested"])
    out = [r for b in O._spans(0.6, 2)(iter([batch.slice(0, 3), batch.slice(3)])) for r in b.to_pylist()]
    assert [(r["train_cls"], r["test_cls"], r["length"]) for r in out if r["length"]] == [(b"a", b"b", 3)]
    assert {r["cls"] for r in out if not r["length"]} == {b"d", b"e"}  # at the edges


def test_a_very_long_record_and_a_hot_run(spark):
    long = [f"w{k}" for k in range(100_000)]
    rows = [("g", " ".join(long), "t", "train"), ("h", " ".join(long[50:] + ["x"]), "t", "test")]
    rows += [(f"a{k:04d}", f"same start here {k % 700} end", "hot", "train") for k in range(900)] + [(f"b{k}", f"same start here {k} end too", "hot", "dev") for k in (3, 699)]
    df = spark.createDataFrame([(*r, "s", None, "z") for r in rows], SCHEMA)
    got = {tuple(r) for r in O.overlap_pairs(df, *ARGS, similarity=0.75).collect()}
    assert got == {("g", "h")} | brute(rows[2:], 0.75)
    covered = {r.id: (r.n_classes, r.covered) for r in O.overlap_coverage(df, *ARGS, similarity=0.75).collect()}
    assert covered["h"] == (1, 99_950 / 99_951) and covered["b3"] == (1, 5 / 6)
