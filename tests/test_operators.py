"""Operators on small literal inputs with results worked out by hand, and against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.functions import vectors as V
from evidentia.operators import chunking, context, dense, fusion, learning, lexical, rerank, runs, sampling


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize("text,want", [("COMP7103A exam 2025", ["comp7103a", "exam", "2025", "7103"]), ("a1b22", ["a1b22", "1", "22"]), ("", []), ("x_y É", ["x_y", "é"])])
def test_tokenize(spark, text, want):
    assert one(spark, X.tokenize, text) == want


@pytest.mark.parametrize("query,want", [("COMP7107", True), ("comp 7107", True), ("7107", True), ("courses", True), ("COMP7103A", False), ("exam", False)])
def test_about_courses(spark, query, want):
    assert one(spark, X.about_courses, query) is want


@pytest.mark.parametrize("answer,want", [('```json\n{"tool":"x"}\n```', '{"tool":"x"}'), ("oops", None), ('Say {"a":1} now', '{"a":1}'), (None, None)])
def test_tolerant_json(spark, answer, want):
    assert one(spark, X.tolerant_json, answer) == want


def test_text_helpers(spark):
    assert one(spark, lambda c: X.numbers(c, X.CITATION), "see [1], [12], [1], [1234]") == [1, 12]
    assert one(spark, lambda c: X.numbers(c, X.BLOCK), "[1] a\nx [2] b\n[3] c") == [1, 3]
    assert one(spark, X.strip, "  a b　\n") == "a b"
    assert one(spark, X.html_text, "<p>a &amp; b</p><script>x<y</script><!-- c -->d") == "a & b d"
    assert one(spark, lambda c: X.shorten(X.one_line(c), 5, "…"), "a  b\nc d e") == "a b c…"
    assert one(spark, X.is_blank, " \t　\n") is True and one(spark, X.is_blank, " a ") is False
    assert one(spark, X.chunk_index, "d::c00012") == 12 and one(spark, X.chunk_index, "d") is None
    assert one(spark, X.basename, "a\\b/c.md") == "c.md"


def sections(spark, text):
    rows = chunking.sections(spark.createDataFrame([("d", text)], "doc_id string, text string")).collect()
    return [(r.section, r.line_start, r.line_end, r.sec_text) for r in sorted(rows, key=lambda r: r.sec_idx)]


def test_sections(spark):
    assert sections(spark, "intro\n# A\nx\n## B\ny") == [("# A", 2, 3, "# A\nx"), ("## B", 4, 5, "## B\ny")]
    assert [s[:3] for s in sections(spark, "#no\n####### seven\n # indented")] == [("Document", 1, 3)]
    assert sections(spark, "") == []


@pytest.mark.parametrize("n,want", [(2500, [(0, 1200), (1000, 2200), (2000, 2500)]), (1200, [(0, 1200)]), (1201, [(0, 1200), (1000, 1201)])])
def test_windows(spark, n, want):
    got = chunking.windows(spark.createDataFrame([("x" * n,)], "text string")).orderBy("win_idx").collect()
    assert [(r.char_start, r.char_end) for r in got] == want


def test_windows_equal_a_loop(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n") if k % 40 > 12 else " " for k in range(rng.randint(0, 300))).strip() for _ in range(40)]
    got = {}
    for r in chunking.windows(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 20, 5).collect():
        got.setdefault(r.id, []).append((r.char_start, r.char_end, r.piece))
    for k, text in enumerate(texts):
        want, start = [], 0
        while text:
            end = min(start + 20, len(text))
            if not text[start:end].strip():
                break
            want.append((start, end, text[start:end].strip()))
            if end == len(text):
                break
            start = end - 5
        assert sorted(got.get(k, [])) == want
    with pytest.raises(ValueError):
        chunking.window_array(F.lit("x"), 5, 5)


def test_chunks_of_a_document(spark):
    docs = spark.createDataFrame([("a\\b.md", "# T\n" + "x" * 30 + "\n## U\ny"), ("e.md", ""), ("n.md", None)], "source_path string, text string")
    got = sorted(chunking.build_chunks(docs, 20, 5).collect(), key=lambda r: r.chunk_idx)
    assert [r.chunk_id[-8:] for r in got] == ["::c0000" + str(k) for k in range(len(got))] and got[0].metadata.title == "b.md" and got[-1].text == "## U\ny"
    counted = {r.source_path: (r.chars, r.chunks) for r in chunking.manifest(chunking.build_chunks(docs, 20, 5), docs).collect()}
    assert counted["e.md"] == (0, 0) and counted["a\\b.md"][1] == len(got)


def test_line_ranges(spark):
    docs = spark.createDataFrame([("a/b", "one\ntwo\r\nthree\n")], "source_path string, text string")
    asked = spark.createDataFrame([("a\\b", 0, 99), ("a/b", 2, 1), ("a/b", 9, 9), ("../etc", 1, 2)], "source_path string, line_start int, line_end int")
    got = {(r.line_start, r.line_end): r.content for r in chunking.read_lines(docs, asked).collect()}
    assert got == {(1, 3): "one\ntwo\nthree", (2, 2): "two", (9, 3): ""}
    cut = chunking.read_lines(docs, asked.limit(1), most=5).first()
    assert cut.content == "one\nt\n...[truncated]"


def test_bm25(spark):
    chunks = spark.createDataFrame([("1", "a b"), ("2", "a c"), ("3", "a d d")], "chunk_id string, text string")
    idf = {r.term: round(r.idf, 6) for r in lexical.idf(chunks).collect()}
    assert idf == {"a": -0.02584, "b": 0.510826, "c": 0.510826, "d": 0.510826}
    from evidentia.session import scratch_dir
    from evidentia.sources import files

    index = files.load_or_build_index(chunks, scratch_dir(spark))
    queries = spark.createDataFrame([("q", "a d"), ("none", "zz")], "query_id string, query string")
    got = lexical.bm25(index, queries, 5).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == [("3", 0.645474), ("1", -0.027615), ("2", -0.027615)]
    filled = lexical.bm25(index, queries, 2, fill=True).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.rank) for r in filled] == [("none", "1", 1), ("none", "2", 2), ("q", "3", 1), ("q", "1", 2)]


def test_knn(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 2)
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0])]
    items = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in dense.knn(items, items, 2, dim=2, not_self=True).collect():
        got.setdefault(r.query, {})[r.rank] = (r.item, r.score)
    assert got == {1: {1: (4, 1.0), 2: (3, 0.707107)}, 2: {1: (3, 0.707107), 2: (1, 0.0)}, 3: {1: (1, 0.707107), 2: (2, 0.707107)}, 4: {1: (1, 1.0), 2: (3, 0.707107)}}
    near = dense.knn(items, items.where("id = 1"), 2, dim=2, metric="l2").orderBy("rank").collect()
    assert [(r.item, r.score) for r in near] == [(1, 0.0), (3, 1.0)]


def test_knn_in_blocks_and_by_label_equals_a_loop(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, [round(rng.uniform(-1, 1), 1) for _ in range(3)], f"c{k % 17}" if k % 11 else None) for k in range(120)]
    items = spark.createDataFrame(rows, "id long, v array<double>, label string")
    for bounded in (True, False):
        for label in (True, False):
            near = dense.knn(items if label else items.drop("label"), items.select("id", "v").where("id % 10 = 3"), 4, dim=3, bounded=bounded)
            for q, v, _ in rows:
                if q % 10 != 3:
                    continue
                cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b), 6)
                order = sorted((-cosine(v, w), k, c) for k, w, c in rows if math.hypot(*w) and (c or not label))
                want, seen = [], set()
                for s, k, c in order:
                    if not label or c not in seen:
                        want.append(k)
                        seen.add(c)
                if math.hypot(*v):
                    assert [r.item for r in near.where(F.col("query") == q).orderBy("rank").collect()] == want[:4]
    monkeypatch.setattr(dense, "MOST_BROADCAST", 5)
    with pytest.raises(ValueError):
        dense.knn(items, items, 2, dim=3, bounded=True)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(V.dot(F.col("a"), F.col("b")), V.norm(F.col("a")), V.squared_l2(F.col("a"), F.col("b")), V.l2_normalize(F.col("a"))).collect()
    assert got[0][0] == 24.0 and got[0][1] == 5.0 and got[0][2] == 2.0 and math.isclose(got[0][3][0], 0.6, abs_tol=1e-9) and got[1][3] == [0.0, 0.0]


RUNS = [("bm25", "q", "a", 1), ("bm25", "q", "b", 2), ("bm25", "q", "c", 3), ("semantic", "q", "c", 1), ("semantic", "q", "a", 2), ("semantic", "q", "d", 3)]
RUN_SCHEMA = "run string, query_id string, chunk_id string, rank int"


def test_rrf_whatever_the_order_of_runs(spark):
    for rows in (RUNS, RUNS[::-1], RUNS + RUNS[:2]):
        got = fusion.rrf(spark.createDataFrame(rows, RUN_SCHEMA)).orderBy("pos").collect()
        assert [(r.chunk_id, r.fused_score) for r in got] == [("a", 0.032522), ("c", 0.032266), ("b", 0.016129), ("d", 0.015873)]
        assert got[0].ranks == {"bm25": 1, "semantic": 2}


def test_features_and_logistic(spark):
    lexical_run = spark.createDataFrame([("q", "a", 3.0, 2)], "query_id string, chunk_id string, score double, rank int")
    empty = spark.createDataFrame([], "query_id string, chunk_id string, score double, rank int")
    row = fusion.features(lexical_run, empty).first()
    assert (row.semantic_score, row.semantic_rank, row.semantic_present, row.semantic_rrf, row.best_rank) == (0.0, 9999.0, 0.0, 0.0, 2.0) and math.isclose(row.best_rrf, 1 / 62)
    p = fusion.features(lexical_run, empty).select(fusion.logistic({"bm25_score": 2.0}, -5.0, {"bm25_score": 1.0}, {"bm25_score": 2.0}).alias("p")).first().p
    assert math.isclose(p, 1 / (1 + math.exp(3)))


def kept(spark, scores, **options):
    df = spark.createDataFrame([("q", k + 1, float(s)) for k, s in enumerate(scores)], "query_id string, pos int, score double")
    return sorted(r.pos for r in rerank.score_threshold(df, **options).collect())


def test_threshold(spark):
    scores = [0.032522, 0.032266, 0.016129, 0.015873]
    assert kept(spark, scores) == [1, 2, 3, 4] and kept(spark, scores, min_keep=1) == [1, 2]
    assert kept(spark, [-1, -2], min_keep=1) == [1] and kept(spark, [5, 5, 5, 5], max_keep=2, min_keep=1) == [1, 2]
    rng = random.Random(4)
    for _ in range(15):
        scores = [rng.choice([-2, -1, 0.5, 1, 2, 3]) for _ in range(rng.randint(1, 9))]
        bar = max(scores) * 0.65
        passing = [k + 1 for k, s in enumerate(scores) if s >= bar]
        want = passing if len(passing) >= 3 else [k + 1 for k in range(min(3, len(scores)))]
        assert kept(spark, scores, min_keep=3, max_keep=5) == want[:5]


def test_maxsim_scores_long_texts_and_queries_whole(spark):
    filler = " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300))
    hits = spark.createDataFrame([("a", "long"), ("a", "short"), ("b", "short")], "query_id string, chunk_id string")
    queries = spark.createDataFrame([("a", "zebra"), ("b", "zebra " * 70)], "query_id string, query string")
    texts = spark.createDataFrame([("long", f"{filler} zebra"), ("short", "zebra")], "chunk_id string, text string")
    scores = {(r.query_id, r.chunk_id): r.colbert_score for r in rerank.maxsim(hits, queries, texts).collect()}
    assert scores == {("a", "long"): 1.0, ("a", "short"): 1.0, ("b", "short"): 70.0}


def test_maxsim_and_head(spark):
    queries = spark.createDataFrame([("q", "alpha beta")], "query_id string, query string")
    texts = spark.createDataFrame([("a", "alpha"), ("b", "beta alpha x"), ("c", ""), ("d", "zeta")], "chunk_id string, text string")
    hits = spark.createDataFrame([("q", "a", 0.4, 1), ("q", "b", 0.3, 2), ("q", "c", 0.2, 3), ("q", "d", 0.1, 4)], "query_id string, chunk_id string, fused_score double, pos int")
    scored = rerank.maxsim(hits, queries, texts)
    score = {r.chunk_id: r.colbert_score for r in scored.collect()}
    assert score["b"] == 2.0 and score["c"] == float("-inf") and 0 < score["a"] < 2
    order = [r.chunk_id for r in rerank.rerank_head(scored, 3).orderBy("new_pos").collect()]
    assert order == ["b", "a", "c", "d"]


def test_context(spark):
    chunks = spark.createDataFrame([("d", f"d::c{k:05d}", k, "S" if k > 3 else "R", f"text {k}") for k in range(6)] + [("e", "e::c00000", 0, None, ""), ("e", "e::c00001", 1, None, " y ")], "doc_id string, chunk_id string, chunk_idx int, section string, text string")
    hits = spark.createDataFrame([("q", "e::c00000", 0.9, 1), ("q", "d::c00004", 0.5, 2)], "query_id string, chunk_id string, score double, pos int")
    got = context.expand(hits, chunks).orderBy("pos").collect()
    assert [(r.chunk_id[-1], r.doc_id, r.score) for r in got] == [("0", "e", 0.9), ("1", "e", 0.0), ("3", "d", 0.0), ("4", "d", 0.5), ("5", "d", 0.0)]
    assert context.expand(hits, chunks, compat=True).count() == 2
    made = context.assemble(context.within_budget(context.blocks(context.expand(hits, chunks), chunks), 45)).first()
    assert made.context == "[2] e (chunk=1)\ny\n\n[3] d (chunk=3)\ntext 3"


def test_budget_is_a_prefix(spark):
    rows = [("q", k + 1, "x" * n) for k, n in enumerate([5, 6, 20, 1])]
    got = context.within_budget(spark.createDataFrame(rows, "query_id string, pos int, block string"), 12).collect()
    assert sorted(r.pos for r in got) == [1, 2]


def test_first_by_hash(spark):
    import hashlib

    keys = [f"k{k}" for k in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    order = sorted(keys, key=lambda k: (hashlib.md5(f"7:{k}".encode()).hexdigest(), k))
    for n in (0, 1, 137, 500, 900):
        assert {r.k for r in sampling.first_by_hash(df, "k", n).where("chosen").collect()} == set(order[:n])
    assert sampling.first_by_hash(df, "k", 3).count() == 500


def test_split_documents(spark):
    got = learning.split_documents(spark.createDataFrame([(f"d{k}",) for k in range(10)] * 2, "d string"), "d").collect()
    assert len(got) == 10 and sum(r.split == "test" for r in got) == 2  # 2.5 rounds to even


def test_evaluation_equals_loops(spark):
    rng = random.Random(9)
    rows = [("x", rng.randint(0, 1), rng.choice([0.1, 0.3, 0.5, 0.7, rng.random()])) for _ in range(300)] + [("y", 1, 0.5)]
    df = spark.createDataFrame(rows, "part string, label int, p double")
    mine = [(label, round(p, 6)) for part, label, p in rows if part == "x"]
    pos, neg = [p for y, p in mine if y], [p for y, p in mine if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    got = {r.part: r.roc_auc for r in learning.roc_auc(df, ["part"]).collect()}
    assert math.isclose(got["x"], auc) and got["y"] is None
    ap = sum(sum(y for y, p in mine if p == s) * sum(y for y, p in mine if p >= s) / sum(p >= s for _, p in mine) for s in {p for _, p in mine}) / len(pos)
    assert math.isclose({r.part: r.average_precision for r in learning.average_precision(df, ["part"]).collect()}["x"], ap)
    m = learning.confusion(df, ["part"]).where("part = 'x'").first()
    assert m.tp + m.fp + m.tn + m.fn == 300 and m.tp == sum(y and p >= 0.5 for y, p in mine)


def test_run_helpers(spark):
    rows = [("r", "2031-03-01T00:00:02Z", "answer.end", None, '{"latency_ms": 5}'), ("r", "2031-03-01T00:00:01+00:00", "start", "s", '{"latency_ms": 7'), ("r", None, "late", None, None), ("r", "2031-03-01T00:00:02Z", "answer.end", None, '{"latency_ms": 5}'), (None, None, "x", None, None)]
    events = runs.parse_log(spark.createDataFrame(rows, "run_id string, ts string, event string, stage string, attrs string"))
    assert {(r.event, r.latency_ms, r.attrs_state) for r in events.collect()} == {("answer.end", 5, "ok"), ("start", None, "broken"), ("late", None, "missing")}
    folded = runs.fold(events).first()
    assert (folded.n_events, folded.last_event, folded.path) == (2, "answer.end", "start>answer.end")
    times = runs.run_times(events).first()
    assert (times.n_events, times.elapsed_ms, times.busy_ms) == (3, 1000, 5)
    message = one(spark, lambda c: runs.sse_encode(F.lit("delta"), c), '{"text":"x"}')
    assert message == 'event: delta\ndata: {"text":"x"}\n\n'
    assert [tuple(e) for e in one(spark, runs.sse_decode, message + "data: y\n\n")] == [("delta", '{"text":"x"}'), ("message", "y")]


@pytest.mark.parametrize("c,g,ok,want", [(0.8, 0.5, True, 0.71), (0.8, 0.5, False, 0.0), (2.0, -1.0, True, 0.7), (float("nan"), None, True, 0.0)])
def test_metric(spark, c, g, ok, want):
    row = spark.createDataFrame([(c, g, ok)], "c double, g double, ok boolean").select(runs.combined_metric(F.col("c"), F.col("g"), F.col("ok")).alias("m")).first()
    assert math.isclose(row.m, want, abs_tol=1e-9)


def test_buckets(spark):
    df = spark.createDataFrame([(None,), (0.2,), (0.5,), (0.7,), (float("nan"),)], "m double")
    assert [r[0] for r in df.select(runs.bucket(F.col("m"))).collect()] == ["negative", "negative", "neutral", "positive", "negative"]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from evidentia import session

    class Conf(dict):
        def get(self, name, default=None):
            return default

    far = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="far", master="spark://host:7077", getConf=lambda: Conf()), conf=Conf())
    with pytest.raises(ValueError):
        session.scratch_dir(far)
    kept = session.cut(spark.range(5), "kept")
    assert kept.count() == 5 and session.scratch_dir(spark).endswith(spark.sparkContext.applicationId)
