import random

from evidentia.llm import reading

WORDS = {1: ["cat", "sun", "play", "ball", "dog"], 2: ["lesson", "library", "printer", "notebook"], 3: ["methodology", "implementation", "evaluation", "architecture"], 4: ["epistemology", "incommensurability", "dimensionality", "semiparametric"]}


def document(rng, level, other=None):
    def sentence(k):
        return "The " + " ".join(rng.choices(WORDS[k], k=4 + 3 * k)) + " is so."

    own = [sentence(level) for _ in range(rng.randint(9, 14))]
    return " ".join(rng.sample(own + [sentence(other or level) for _ in range(4)], k=len(own) + 4))


def data(spark, n=480):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(n):
        level = k % 4 + 1
        rows.append((k, document(rng, level, rng.randint(1, 4)), rng.choice(["s1", "s2 ", "S-3", None]), 7))
        if k % 3:
            labels.append((k, level if rng.random() > 0.04 else 5 - level, "r"))
    rows += [(1000, "", "s1", 1), (1001, None, "s1", 1), (None, "The cat is so.", "s1", 1), (1002, "| a | b |\n- item\n# Head\n" * 50, "s1", 1), (1003, "The cat play ball is so. " * 8000, "s1", 1), (0, rows[0][1], "s1", 1)]
    labels += [(1, 2, "r"), (5000, 2, "r"), (None, 2, "r"), (3, None, "r"), (5, 9, "r")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, reading_level int"), spark.createDataFrame(labels, "doc_id long, reading_level int, rater string")


def test_levels(spark):
    docs, labels = data(spark)
    model = reading.ReadingModel(docs, labels, "doc_id", "text", "source", "reading_level")
    got = {r.id: r for r in model.grade(docs, "doc_id", "text").collect()}
    assert set(got) == {*range(480), 1000, 1002, 1003}
    assert sum(got[k].reading_level == k % 4 + 1 for k in range(480)) >= 432
    assert got[1003].reading_level == 1 and got[1003].n_words == 48_000 and all(1 <= r.reading_level <= 4 for r in got.values())
    held = model.held_out.collect()
    assert sum(round(r.level) == r.reading_level for r in held) >= 0.85 * len(held)


def test_no_labels_or_no_documents(spark):
    docs, labels = data(spark, 8)
    none = reading.ReadingModel(docs, labels.limit(0), "doc_id", "text", "source", "reading_level")
    assert none.grade(docs, "doc_id", "text").count() == 0
    few = reading.ReadingModel(docs, labels, "doc_id", "text", "source", "reading_level", rounds=3)
    assert few.grade(docs.limit(0), "doc_id", "text").count() == 0


def test_prose():
    text = "# Title\n\nOne long sen-\ntence here.\n- item one\n| a | b |\nhttps://x.example/y\n12 : 30\nAnd more."
    assert reading.prose("<p>One.</p><p class='x'>Two, i.e.</p><p>2.</p>").split() == ["One.", "Two,", "i.e.", "2."]
    kept = reading.prose(text)
    assert "sentence here." in kept and "And more." in kept and "item" not in kept and "Title" not in kept and "https" not in kept


def test_texts_of_one_level_at_any_length(spark):
    docs, labels = data(spark)
    model = reading.ReadingModel(docs, labels, "doc_id", "text", "source", "reading_level")
    texts = {}
    for level in (1, 2, 3, 4):
        sentence = "The " + " ".join(WORDS[level][:3]) + " is so. "
        for k, n_words in enumerate((10, 1000, 50_000)):
            texts[10 * level + k] = sentence * -(-n_words // 6)
    unknown = {90: "Qwe rty uio. Asd fgh jkl. " * 30}
    got = {r.id: r.reading_level for r in model.grade(spark.createDataFrame(list((texts | unknown).items()), "id long, text string"), "id", "text").collect()}
    assert {k: got[k] for k in texts} == {k: k // 10 for k in texts} and got[90] in (1, 2, 3, 4)


def test_words_of_mixed_documents_carry_weight(spark):
    docs, labels = data(spark)
    model = reading.ReadingModel(docs, labels, "doc_id", "text", "source", "reading_level")
    hashes = reading._text.words([" ".join(sum(WORDS.values(), []) + ["the", "is"])])[1]
    logs, weight = model.lexicons.value[-1].of(hashes)
    want = [level - 1 for level, words in WORDS.items() for _ in words]
    assert logs[: len(want)].argmax(1).tolist() == want and weight[: len(want)].min() > 0.5 > weight[len(want) :].max()
