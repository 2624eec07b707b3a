import json

import pytest
from pyspark.sql import functions as F

from evidentia.operators import chunking
from evidentia.sources import files
from evidentia.streaming import jobs


def test_markdown_and_queries(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text("# A\r\nx\n")
    (tmp_path / "in/sub/b.md").write_text("b")
    (tmp_path / "in/c.txt").write_text("no")
    got = {r.title: r.text for r in files.read_markdown(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.md": "# A\nx\n", "b.md": "b"}
    (tmp_path / "q.txt").write_text(" one \n\ntwo\n")
    (tmp_path / "q.jsonl").write_text('{"query": " a "}\n\n{"q": "b", "query": ""}\n{"text": "c"}\n{"other": 1}\n')
    assert {r.query for r in files.read_queries(spark, str(tmp_path / "q.txt")).collect()} == {"one", "two"}
    assert {r.query for r in files.read_queries(spark, str(tmp_path / "q.jsonl")).collect()} == {"a", "b", "c"}


def test_corpus_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("p/a.md", "é " * 900)], "source_path string, text string")
    chunks = chunking.build_chunks(docs)
    files.write_corpus(chunks, str(tmp_path / "corpus"))
    again = files.read_jsonl(spark, str(tmp_path / "corpus"), files.CHUNK_SCHEMA)
    assert sorted(map(str, again.collect())) == sorted(map(str, chunks.select(*again.columns).collect()))
    files.append_log(spark.createDataFrame([("t", "r", "e", None, None)], files.LOG_SCHEMA), str(tmp_path / "log"))
    files.append_log(spark.createDataFrame([("t", "r", "f", None, None)], files.LOG_SCHEMA), str(tmp_path / "log"))
    assert files.read_jsonl(spark, str(tmp_path / "log"), files.LOG_SCHEMA).count() == 2
    (tmp_path / "broken.jsonl").write_text(json.dumps({"doc_id": "x"}) + "\n{oops\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "broken.jsonl"), files.CHUNK_SCHEMA).collect()


def test_index_is_built_once_per_corpus(spark, tmp_path):
    chunks = spark.createDataFrame([("1", "a b"), ("2", "a c c")], "chunk_id string, text string")
    index = files.load_or_build_index(chunks, str(tmp_path))
    assert {(r.chunk_id, r.term, r.tf) for r in index["postings"].collect()} == {("1", "a", 1), ("1", "b", 1), ("2", "a", 1), ("2", "c", 2)}
    files.load_or_build_index(chunks, str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 1
    files.load_or_build_index(chunks.union(chunks.limit(1)), str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 2


def test_memory_goes_on_over_batches(spark, tmp_path):
    rows = [(f"2031-03-01T00:00:{k:02d}Z", "r", "error" if k == 3 else f"e{k}", None, None) for k in range(30)]
    for part in (rows[10:20], rows[:10], rows[20:]):
        spark.createDataFrame(part, files.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log.parquet"))
    stream = jobs.run_memory(spark, str(tmp_path / "log.parquet"))
    last = jobs.run_available(stream, "memory").orderBy("n_events", ascending=False).first()
    assert (last.n_events, last.n_errors, last.last_events) == (30, 1, ">".join(f"e{k}" for k in range(18, 30)))


def test_streams_count_newest_and_late_rows_of_many_files(spark, tmp_path):
    from evidentia.plans.streams import R
    from tests.oracle import compare, connect

    hour = "timestamp_ntz'2031-03-01 00:30:00' + make_interval(0, 0, 0, 0, cast({} as int))"
    events, log = str(tmp_path / "events.parquet"), str(tmp_path / "log_events.parquet")
    # More files than a batch takes, newest first; then rows days late, among them copies of earlier ones.
    for at, files in (("id + 200", 70), ("id", 3)):
        rows = spark.range(140).withColumn("ts", F.expr(hour.format(at)))
        rows.selectExpr("ts", "if(id % 2 = 0, 'view', null) as event_type", "id * 0.5D as value").repartition(files).write.mode("append").parquet(events)
        logged = rows.selectExpr("concat('r', id % 7) as run_id", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as ts", "'hop' as event", "'s' as stage", "concat('{\"latency_ms\":', id, '}') as attrs")
        logged.repartition(files).write.mode("append").parquet(log)
    logged.repartition(2).write.mode("append").parquet(log)
    assert R.queries["stream_event_windows"](spark, str(tmp_path)).agg(F.sum("n")).first()[0] == 280
    assert R.queries["stream_distinct_events"](spark, str(tmp_path)).count() == 280
    for name in ("stream_event_windows", "stream_distinct_events"):
        compare(R.queries[name](spark, str(tmp_path)), connect(str(tmp_path)), R.sql[name])
