import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.llm import mix, pack, tokens


@pytest.mark.parametrize("capacity,windows", [(50, 4), (50, 64), (1, 3)])
def test_every_unit_is_packed_once(spark, capacity, windows):
    rng = random.Random(1)
    sizes = {k: rng.choice([rng.randint(1, 60), rng.randint(1, 10), 50, 100, 137]) for k in range(800)}
    rows = [(k, n, "x") for k, n in sizes.items()] + [(None, 5, "x"), (9001, None, "x"), (9002, 0, "x")]
    df = spark.createDataFrame(rows, "id long, tokens long, container string")
    got = pack.pack(df, "id", "tokens", capacity=capacity, windows=windows).collect()
    filled, spans = defaultdict(int), defaultdict(list)
    for r in got:
        filled[r.container] += r.end - r.begin
        spans[r.id].append((r.begin, r.end, r.piece_no))
    assert max(filled.values()) <= capacity
    for k, n in sizes.items():
        parts = sorted(spans[k])
        assert [p[0] for p in parts] == [0, *[p[1] for p in parts[:-1]]] and parts[-1][1] == n and [p[2] for p in parts] == list(range(len(parts)))
        assert len(parts) == -(-n // capacity)
    assert set(spans) == set(sizes)
    if windows == 64:
        assert len(filled) <= 1.03 * sum(sizes.values()) / capacity + 2


def test_pack_nothing(spark):
    df = spark.createDataFrame([], "id long, tokens long")
    assert pack.pack(df, "id", "tokens", capacity=10).count() == 0
    with pytest.raises(ValueError):
        pack.pack(df, "id", "tokens", capacity=0)


def test_leftovers_of_many_partitions_are_merged(spark, monkeypatch):
    monkeypatch.setattr(pack, "FAN_IN", 2)
    df = spark.range(40).select("id", F.lit(3).cast("long").alias("tokens"))
    got = pack.pack(df, "id", "tokens", capacity=12)
    assert got.count() == 40 and got.select("container").distinct().count() == 10


def test_token_sizes(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (4, "word " * 30_000, None)]
    got = {r.id: r for r in tokens.token_sizes(spark.createDataFrame(rows, "doc long, text string, tokens string"), "doc", "text", keep=("tokens",)).collect()}
    assert set(got) == {1, 4} and got[1].tokens == 2 and got[4].tokens >= 30_000 and got[1].tokens_kept == "x"


def test_budgets():
    leaves = {("d", "en", "a"): 100, ("d", "fr", "a"): 100, ("d", "en", "b"): 1000}
    given = mix.budgets(leaves, {"a": (0.5, 2), "b": (0.5, 1)})
    assert given == {("d", "en", "a"): 200, ("d", "fr", "a"): 200, ("d", "en", "b"): 400}
    short = mix.budgets(leaves, {"a": (0.5, 1), "b": (0.5, 1)}, total=600)
    assert short == {("d", "en", "a"): 100, ("d", "fr", "a"): 100, ("d", "en", "b"): 400}
    near = mix.budgets({("d", "en", "a"): 10, ("d", "en", "b"): 500, ("e", "en", "c"): 500}, {"a": (0.4, 1), "b": (0.3, 1), "c": (0.3, 1)}, total=100)
    assert near == {("d", "en", "a"): 10, ("d", "en", "b"): 60, ("e", "en", "c"): 30}  # the sibling takes the shortage


def test_mix(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(1, 400), rng.choice(["D", None]), rng.choice(["en", "fr", None]), rng.choice(["big", "Big ", "big", "small-one"] if k % 9 else ["small_one"]), 1) for k in range(600)]
    rows += [(9000, 10, "D", "en", None, 1), (None, 10, "D", "en", "big", 1), (9001, None, "D", "en", "big", 1), (9002, 10, "D", "en", "unwanted", 1)]
    sizes = spark.createDataFrame(rows, "id long, tokens long, domain string, lang string, source string, taken int")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small_one", 0.7, 4), ("absent", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = mix.mix(sizes, targets).collect()
    size = {r[0]: r[1] for r in rows}
    assert len({(r.id, r.epoch) for r in got}) == len(got) and all(0 < r.taken <= size[r.id] for r in got)
    share = defaultdict(int)
    for r in got:
        share[r.source] += r.taken
    total = sum(share.values())
    assert abs(share["big"] / total - 0.3) < 0.001 and max(r.epoch for r in got if r.source == "small_one") < 4 and max(r.epoch for r in got if r.source == "big") == 0
    whole = {r.id for r in got if r.source == "small_one" and r.epoch == 0}
    assert whole == {r[0] for r in rows if r[4] in ("small-one", "small_one")}  # earlier epochs are complete
    again = {(r.id, r.epoch, r.taken) for r in mix.mix(sizes.repartition(7), targets).collect()}
    assert again == {(r.id, r.epoch, r.taken) for r in got}
    report = {r.source: r for r in mix.mix_report(mix.mix(sizes, targets), sizes, targets).where("source is not null").collect()}
    assert report["absent"].taken == 0 and abs(report["big"].actual_share - 0.3) < 0.001


def test_mix_nothing(spark):
    sizes = spark.createDataFrame([], "id long, tokens long, domain string, lang string, source string")
    assert mix.mix(sizes, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")).count() == 0


def test_a_scarce_source_does_not_shrink_the_mix(spark):
    rows = [(k, 10, "D", "en", "big" if k % 2 else "other") for k in range(200)] + [(900, 30, "D", "en", "tiny"), (901, 10, "D", "en", "unwanted")]
    sizes = spark.createDataFrame(rows, "id long, tokens long, domain string, lang string, source string")
    targets = spark.createDataFrame([("big", 0.25, 2), ("other", 0.25, 1), ("tiny", 0.5, 2), ("absent", 0.1, 1)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mix.mix_report(mix.mix(sizes, targets, total=mix.HELD), sizes, targets, total=mix.HELD).collect()}
    got = {s: (r.held, r.wanted, r.taken, r.unused, r.repeats) for s, r in report.items()}
    assert got == {"big": (1000, 508, 985, 15, 1), "other": (1000, 508, 985, 15, 1), "tiny": (30, 1015, 60, 0, 2), "absent": (0, 0, 0, 0, 0)}
    assert report["tiny"].wanted_share == 0.5 and abs(report["tiny"].actual_share - 60 / 2030) < 1e-9


def test_the_registered_mix_is_as_large_as_its_sources(spark, folder):
    from evidentia.llm.queries import R

    rows = R.queries["p7_report"](spark, folder).where("target_share > 0").collect()
    assert sum(r.taken for r in rows) == sum(r.held for r in rows) > 0 and all(r.taken <= r.held * r.max_repeats for r in rows)


def test_the_last_epoch_is_a_prefix_of_its_order(spark):
    rows = [(k, 1 + k % 7, "D", "en", "a" if k % 3 else "b") for k in range(3000)]
    sizes = spark.createDataFrame(rows, "id long, tokens long, domain string, lang string, source string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 3)], "source string, target_share double, max_repeats int")
    unsigned = lambda x: x % (1 << 64)
    rest = {source: mix.mix(sizes, targets, total=9000).where(F.col("source") == source).collect() for source in ("a", "b")}
    for source, got in rest.items():
        last = max(r.epoch for r in got)
        mine = sorted(((unsigned(r.at), r.id, r.taken, r.tokens) for r in got if r.epoch == last))
        assert all(taken == tokens for _, _, taken, tokens in mine[:-1])
        everybody = [r[0] for r in rows if r[4] == source]
        order = spark.createDataFrame([(k, last) for k in everybody], "id long, epoch long").select("id", F.xxhash64("id", F.lit(0), "epoch").alias("at")).collect()
        assert [k for _, k, _, _ in mine] == [k for _, k in sorted((unsigned(r.at), r.id) for r in order)][: len(mine)]


def test_siblings_come_before_ancestors():
    leaves = {("d", "en", "a"): 10, ("d", "en", "b"): 500, ("d", "fr", "c"): 500, ("e", "en", "c"): 500}
    targets = {"a": (0.4, 1), "b": (0.3, 1), "c": (0.3, 1)}
    assert mix.budgets(leaves, targets, total=100) == {("d", "en", "a"): 10, ("d", "en", "b"): 60, ("d", "fr", "c"): 15, ("e", "en", "c"): 15}
    # Where the sibling can't take it all, the rest goes to the domain, then to all.
    leaves |= {("d", "en", "b"): 40, ("d", "fr", "c"): 30}
    assert mix.budgets(leaves, targets, total=100) == {("d", "en", "a"): 10, ("d", "en", "b"): 40, ("d", "fr", "c"): 22, ("e", "en", "c"): 28}
