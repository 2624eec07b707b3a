"""Encoded texts, retrievers as parameters, trained models, and records of unequal origin."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import encode, fusion, learning, records, retrieval, runs
from evidentia.sources import files


def hashed(tokens):
    raw = np.array([[b - 127.5 for b in hashlib.md5(t.encode()).digest()] for t in tokens])
    mean = (raw / np.sqrt((raw**2).sum(1))[:, None]).mean(0)
    return mean / np.sqrt(mean @ mean)


def test_encoded_texts(spark):
    texts = {"a": "one two two", "b": "one two two", "c": "", "d": None, "e": "?!", "f": "w " * 50_000 + "last", "g": "Éa x_y"}
    rows = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "k string, text string, v int")  # a clashing column
    got = {r.k: np.array(r.v) for r in encode.encode(rows, "k", "text").collect()}
    assert set(got) == {"a", "b", "f", "g"}
    for k, v in got.items():
        assert np.allclose(v, hashed(re.findall(r"\w+", texts[k].lower())), atol=1e-12)
    assert encode.encode(rows.limit(0), "k", "text").count() == 0


class Lengths:
    dim = 2

    def __call__(self, texts, tokens):
        return np.array([[len(t), 1.0] if t != "nothing" else [0.0, 0.0] for t in texts.to_pylist()])


def test_an_encoder_and_retrievers_are_parameters(spark):
    texts = spark.createDataFrame([("c1", "abcdefghij"), ("c2", "x"), ("c3", "y"), ("c4", "nothing")], "chunk_id string, text string")
    items = encode.encode(texts, "chunk_id", "text", Lengths())
    assert items.count() == 3
    queries = spark.createDataFrame([("q", "z")], "query_id string, query string")
    search = {"semantic": retrieval.by_vectors(items, Lengths()), "mine": lambda queries, k: queries.select("query_id", F.lit("c1").alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))}
    found = retrieval.runs_of(queries, search, 2)
    ties = sorted(["c2", "c3"], key=lambda c: int(hashlib.md5(c.encode()).hexdigest()[:15], 16))
    assert {(r.run, r.chunk_id, r["rank"]) for r in found.collect()} == {("mine", "c1", 1), ("semantic", ties[0], 1), ("semantic", ties[1], 2)}
    tops = retrieval.with_tops(retrieval.fuse(found, top_k=3), found, 1).collect()
    assert len(tops) == 3 and all(r.tops == {"mine": ["c1"], "semantic": [ties[0]]} for r in tops)
    broken = {"b": lambda queries, k: queries.select("query_id", F.lit("").alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))}
    with pytest.raises(Exception, match="missing chunk_id"):
        retrieval.runs_of(queries, broken).collect()
    with pytest.raises(ValueError):
        retrieval.runs_of(queries, {})


def test_fallback_asks_the_question_where_the_rewritten_query_finds_nothing(spark, tmp_path):
    texts = spark.createDataFrame([("c1", "comp1234 exam"), ("c2", "essay")], "chunk_id string, text string")
    search = retrieval.by_words(files.load_or_build_index(texts, str(tmp_path)))
    asked = spark.createDataFrame([("1", "the exam", "comp1234"), ("2", "my essay", "comp9999"), ("3", "essay", ""), ("4", "nobody", "none"), ("5", "exam", None)], "query_id string, query string, rewritten string")
    got = {(r.query_id, r.chunk_id, r.found_by) for r in retrieval.with_fallback(asked, search).collect()}
    assert got == {("1", "c1", "rewritten"), ("2", "c2", "question"), ("3", "c2", "question"), ("5", "c1", "question")}


def newton(x, y, c):
    """Ridge logistic regression with balanced weights, solved to the end in double."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    ridge = np.diag([1 / c] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (p - y)) + ridge @ w)
        w = w - step
        if abs(step).max() < 1e-12:
            break
    return w


def test_model_is_the_ridge_solution_and_survives_saving(spark, tmp_path):
    random.seed(5)
    rows = []
    for i in range(400):
        values = [random.gauss(0, 1 + j) for j in range(9)] + [3.0]  # the last doesn't vary
        rows.append((i % 50, *values, int(values[0] + values[3] / 4 + random.gauss(0, 1) > 0.7)))
    examples = spark.createDataFrame(rows, "query_id int, " + ", ".join(f"{f} double" for f in fusion.FEATURES) + ", label int")
    model = learning.fit_fusion(examples, c=0.5)
    raw, y = np.array([r[1:11] for r in rows]), np.array([r[11] for r in rows])
    scale = np.where(raw.std(0) == 0, 1.0, raw.std(0))
    want = newton((raw - raw.mean(0)) / scale, y, 0.5)
    assert np.allclose([*model.coefficients.values(), model.intercept], want, atol=2e-4)

    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        files.load_model(spark, path)
    files.save_model(spark, model, path)
    again = files.load_model(spark, path)
    assert again == model
    p = np.array([r.p for r in examples.select(again.probability().alias("p")).collect()])
    assert np.allclose(p, 1 / (1 + np.exp(-(((raw - raw.mean(0)) / scale) @ want[:10] + want[10]))), atol=2e-4)
    spark.createDataFrame([("feature", "other", 1.0, 0.0, 1.0)], files.MODEL_SCHEMA).write.json(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        files.load_model(spark, str(tmp_path / "other"))
    with pytest.raises(ValueError):
        learning.fit_fusion(examples.where("label = 1"))


def test_fusing_by_a_model_or_by_ranks(spark):
    found = spark.createDataFrame([("bm25", "q", "a", 9.0, 1), ("bm25", "q", "b", 1.0, 2), ("semantic", "q", "b", 0.9, 1)], "run string, query_id string, chunk_id string, score double, rank int")
    zero, one = dict.fromkeys(fusion.FEATURES, 0.0), dict.fromkeys(fusion.FEATURES, 1.0)
    model = learning.FusionModel(zero | {"bm25_score": 1.0}, 0.0, zero, one)
    by_model = retrieval.fuse(found, " LR ", model=model).orderBy("pos").collect()
    assert [(r.chunk_id, r.ranks, r.fusion) for r in by_model] == [("a", {"bm25": 1, "semantic": 9999}, "lr"), ("b", {"bm25": 2, "semantic": 1}, "lr")]

    def fails():
        raise FileNotFoundError("gone")

    for given in (None, fails):
        with pytest.warns(RuntimeWarning, match="by ranks"):
            fused = retrieval.fuse(found, "lr", model=given)
        assert [(r.chunk_id, r.fusion) for r in fused.orderBy("pos").collect()] == [("b", "rrf"), ("a", "rrf")]


def test_vector_index_is_kept_and_checked(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0])], "id string, v array<double>")
    made = files.load_or_build_vectors(rows, str(tmp_path / "i"), 2)
    assert made["config"].first().asDict() == {"dim": 2, "metric": "cosine", "n_vectors": 1}
    assert files.load_or_build_vectors(rows.limit(0), str(tmp_path / "i"), 2)["vectors"].count() == 1
    with pytest.raises(ValueError):
        files.load_or_build_vectors(rows, str(tmp_path / "i"), 3)


def test_fields_under_other_names(spark):
    rows = spark.createDataFrame(
        [(" u1 ", None, "x.md", "7", ("sec", "t1")), (None, " ", "x.md", "7", (None, "t2")), (None, None, None, "-1", None)],
        "id string, doc_id string, path string, idx string, meta struct<heading string, content string>",
    )
    got = [tuple(r) for r in records.aliased(rows).collect()]
    empty = hashlib.md5(b"").hexdigest()
    assert got == [("u1", "x.md", 7, "sec", "t1"), ("x.md::#7", "x.md", 7, None, "t2"), (f"UNKNOWN_DOC::#{empty}", "UNKNOWN_DOC", None, None, "")]
    bare = records.aliased(spark.createDataFrame([(1,)], "other int")).first()
    assert (bare.group, bare.text) == ("UNKNOWN_DOC", "")


def test_required_and_last_versions(spark):
    rows = spark.createDataFrame([(1, "k", 5), (2, "k", 7), (3, "k", 7), (4, "m", None), (5, None, 9), (6, "n", None), (7, "n", 1)], "id int, key string, at int")
    assert {r.id for r in records.last_wins(rows, "key", ["at"], "id").collect()} == {3, 4, 7}
    assert records.last_wins(rows.limit(0), "key", ["at"], "id").count() == 0
    assert records.required(rows, "id").count() == 7
    with pytest.raises(Exception, match="missing key"):
        records.required(rows, "key").collect()


def test_run_records_go_to_a_file_and_back(spark, tmp_path):
    log = [("2031-03-01T00:00:02Z", "r", "answer.delta", None, '{"md": "lo"}'), ("2031-03-01T00:00:01Z", "r", "answer.delta", None, '{"md": "hel", "latency_ms": 5}'), ("2031-03-01T00:00:03Z", "r", "error", None, "{oops"), (None, "s", None, None, None)]
    made = runs.run_records(runs.parse_log(spark.createDataFrame(log, files.LOG_SCHEMA)))
    path = str(tmp_path / "runs")
    files.append_runs(made, path)
    files.append_log(spark.createDataFrame(log, files.LOG_SCHEMA), path)  # never read as runs
    got = {r.run_id: r for r in files.read_runs(spark, path).collect()}
    assert set(got) == {"r", "s"}
    assert (got["r"].answer, got["r"].n_deltas, got["r"].n_events, got["r"].n_errors, got["r"].elapsed_ms, got["r"].busy_ms, got["r"].path) == ("hello", 2, 3, 1, 2000, 5, "answer.delta>answer.delta>error")
    assert (got["s"].answer, got["s"].n_events, got["s"].elapsed_ms, got["s"].path) == ("", 1, None, "")
    short = {r.run_id: r for r in runs.summarized(made, 3).collect()}
    assert (short["r"].answer_preview, short["r"].ok, short["r"].first_event) == ("hel", False, "answer.delta") and short["s"].ok
    assert runs.run_records(runs.parse_log(spark.createDataFrame([], files.LOG_SCHEMA))).count() == 0


def test_all_measures_from_one_count(spark):
    random.seed(3)
    rows = [(s, round(random.random(), 2), random.randint(0, 1) if s != "ones" else 1) for s in ("a", "b", "ones") for _ in range(200)]
    scored = spark.createDataFrame(rows, "split string, p double, label int")
    want = learning.roc_auc(scored, ["split"])
    for more in (learning.average_precision(scored, ["split"]), learning.log_loss(scored, ["split"]), learning.confusion(scored, ["split"])):
        want = want.join(more, "split")
    got = {r.split: r for r in learning.evaluated(scored, ["split"]).collect()}
    for r in want.collect():
        assert all(got[r.split][c] == (r[c] if r[c] is None else pytest.approx(r[c], abs=1e-9)) for c in want.columns[1:])
    assert got["ones"].roc_auc is None
    assert learning.evaluated(scored.limit(0), ["split"]).count() == 0


def test_memory_goes_on_from_file_to_file(spark, tmp_path):
    from evidentia.streaming import jobs

    at = str(tmp_path / "log.parquet")
    for k in range(2):
        spark.createDataFrame([(f"2031-03-01T00:00:0{k}Z", "r", "e", None, None)], files.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(at)
    assert sorted(r.n_events for r in jobs.run_available(jobs.run_memory(spark, at, files_a_batch=1), "memory").collect()) == [1, 2]


class State:
    """The state of one run, as the stream gives it."""

    def __init__(self, timed_out, kept=None):
        self.hasTimedOut, self.kept, self.after = timed_out, kept, None
        self.exists = kept is not None

    @property
    def get(self):
        return self.kept

    def update(self, value):
        self.kept = value

    def remove(self):
        self.kept = None

    def setTimeoutDuration(self, after):  # noqa: N802
        self.after = after


def test_a_silent_run_is_forgotten():
    import pandas as pd

    from evidentia.streaming import jobs

    state = State(False)
    rows = pd.DataFrame({"at": ["1", "2"], "event": ["a", "error"]})
    out = list(jobs._remember(("r",), iter([rows]), state, 99))
    assert out[0].iloc[0].tolist() == ["r", 2, 1, "a>error"] and state.after == 99 and state.kept is not None
    gone = State(True, state.kept)
    assert list(jobs._remember(("r",), iter([]), gone, 99)) == [] and gone.kept is None
