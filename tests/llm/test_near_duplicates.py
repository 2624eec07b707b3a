import random
import re
from itertools import combinations

import pytest

from evidentia.llm import near_duplicates as N

SCHEMA = "cid string, text string, id long, cls long, a long, block int"


def brute(rows, width, similarity, min_words):
    sets = {}
    for cid, text in rows:
        words = re.findall(r"[^\W_]+", text.lower()) if cid and text else []
        if len(words) >= max(width, min_words):
            sets[cid] = frozenset(zip(*[words[k:] for k in range(width)]))
    return {tuple(sorted(p)) for p in combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) >= similarity * len(sets[p[0]] | sets[p[1]]) - 1e-9}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    stock = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(6)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 2))
            text = " ".join(words)
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.randint(3, 90)) + [rng.choice(stock)])
        rows.append((f"c{k:04d}", text))
    return rows


@pytest.mark.parametrize("width,similarity,min_words,hot", [(3, 0.6, 30, 4096), (5, 0.8, 0, 4096), (2, 0.5, 0, 4096), (3, 0.6, 0, 3)])
def test_equals_brute_force(spark, monkeypatch, width, similarity, min_words, hot):
    monkeypatch.setattr(N, "HOT_COLUMN", hot)
    rows = corpus(width, 150)
    # Hot columns reach the workers by the closure's module; the driver's value is what a fork sees.
    df = spark.createDataFrame([(c, t, 1, 2, 3, 4) for c, t in rows], SCHEMA)
    got = [tuple(r) for r in N.near_duplicate_pairs(df, "cid", "text", width=width, similarity=similarity, min_words=min_words).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, width, similarity, min_words)


def test_bands_of_a_hot_column_meet_once():
    import numpy as np
    import pyarrow as pa

    entries = np.zeros(6, N._ENTRY)
    entries["column"], entries["cls"], entries["size"], entries["place"] = 7, [1, 2, 3, 4, 5, 6], 10, 0
    plain = N._product(0.6, 1, 1)(pa.table({"block": [0], "payload": [N._pack(entries)]}))
    whole = {(int(p["a"]), int(p["b"])) for p in N._unpack(plain.column("payload").to_pylist(), N._PAIR)}
    halves = []
    own = np.array([0, 0, 0, 1, 1, 1])
    for other in (0, 1):
        part = entries.copy()
        part["band"], part["side"] = np.minimum(own, other) + 1, np.maximum(own, other) + 1
        part["place"] = np.where(own > other, -part["place"] - 1, part["place"])
        halves.append(part)
    banded = N._product(0.6, 1, 1)(pa.table({"block": [0, 0], "payload": [N._pack(x) for x in halves]}))
    found = N._unpack(banded.column("payload").to_pylist(), N._PAIR)
    assert {(int(p["a"]), int(p["b"])): int(p["products"]) for p in found} == dict.fromkeys(whole, 1)
    assert len(whole) == 15


def test_odd_rows_and_copies(spark):
    text = " ".join(f"word{k}" for k in range(40))
    long = " ".join(f"x{k % 5000}" for k in range(60_000))
    rows = [("a", text, None, 1, None, 1), ("a", text, 2, None, 3, 1), ("b", text.upper() + "!", 1, 1, 1, 1), ("c", "", 1, 1, 1, 1), ("d", None, 1, 1, 1, 1), (None, text, 1, 1, 1, 1), ("e", "short one", 1, 1, 1, 1), ("f", long, 1, 1, 1, 1), ("g", long, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in N.near_duplicate_pairs(df, "cid", "text", width=3, similarity=0.6, min_words=30).collect()}
    assert got == {("a", "b"), ("f", "g")}
    groups = {r.id: r for r in N.near_duplicate_groups(df, "cid", "text", width=3, similarity=0.6, min_words=30).collect()}
    assert set(groups) == {"a", "b", "f", "g"} and groups["a"].group_id == groups["b"].group_id and groups["a"].n_links == 1


def test_chains_form_one_group(spark):
    words = [f"word{k}" for k in range(120)]
    rows = [(f"c{k}", " ".join(words[k * 12 : k * 12 + 60])) for k in range(5)] + [("other", " ".join(f"y{k}" for k in range(50)))]
    df = spark.createDataFrame(rows, "cid string, text string")
    groups = {r.id: r for r in N.near_duplicate_groups(df, "cid", "text", width=3, similarity=0.6).collect()}
    assert set(groups) == {f"c{k}" for k in range(5)} and len({r.group_id for r in groups.values()}) == 1
    assert [groups[f"c{k}"].n_links for k in range(5)] == [1, 2, 2, 2, 1]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.near_duplicate_pairs(df, "cid", "text").count() == 0
    assert N.near_duplicate_groups(df, "cid", "text").count() == 0
