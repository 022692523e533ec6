import numpy as np

from curvecal.llm import quality

FOLDER = "/root/testdata/sf0.01"


def test_agrees_with_the_labels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit(docs)
    rows = quality.classify(docs, model).join(labels, "doc_id").collect()
    clean = [r for r in rows if r.quality == 1]
    junk = [r for r in rows if r.quality == 0]
    assert sum(r.keep for r in clean) >= 0.99 * len(clean)
    assert sum(not r.keep for r in junk) >= 0.9 * len(junk)
    assert all(good > 0.9 for good, _ in model.report["accuracy"].values()) and 0.8 < model.report["prior"] < 0.95


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(0)
    n, m = 20_000, len(quality.LABELLERS)
    truth = rng.random(n) < 0.7
    right_good, right_bad = rng.uniform(0.85, 0.99, m), rng.uniform(0.5, 0.9, m)
    right = rng.random((n, m)) < np.where(truth[:, None], right_good, right_bad)
    vote = np.where(right == truth[:, None], 1, -1)
    vote[rng.random((n, m)) < 0.2] = 0
    patterns, counts = np.unique(vote, axis=0, return_counts=True)
    _, report = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(report["prior"] - 0.7) < 0.05
    for i, name in enumerate(quality.LABELLERS):
        good, bad = report["accuracy"][name]
        assert abs(good - right_good[i]) < 0.05 and abs(bad - right_bad[i]) < 0.08


def test_patterns_are_reversible():
    for p in range(0, 3 ** len(quality.LABELLERS), 7):
        assert quality.pattern(quality.unpattern(p)) == p


def test_odd_texts_and_empty_table(spark):
    rows = [(1, None, 0.5), (2, "", 0.5), (3, " \n ", 0.5), (4, "A normal line of words, with an end. " * 3000, 0.5), (5, "word " * 200, 0.5),
            (6, "😀 é", 0.5), (6, "😀 é", 0.5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality_score double")
    model = quality.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    got = {r.doc_id: r.keep for r in quality.classify(df, model).collect()}
    assert got[1] and got[2] and got[3] and got[4] and not got[5]
    empty = quality.fit(df.limit(0))
    assert quality.classify(df, empty).where("keep").count() == len(rows)
    assert quality.classify(df.limit(0), empty).count() == 0


def test_long_words_count_to_their_end():
    clean, junk = "a" * 64, "a" * 64 + "#$%&" * 5_000
    assert quality.shape(clean) == "a" and quality.shape(junk).endswith("#$%&") and junk not in quality._shapes
    a, b = (dict(zip(*map(list, quality.features(c, len(w), s)))) for w, c, s in map(quality.describe, (clean, junk)))
    assert a != b and max(b.values()) < 1.5
    assert quality.votes("word " * 99 + clean)[3] == quality.GOOD and quality.votes("word " * 99 + junk)[3] == quality.BAD
    text = " ".join(["a-b" * 8 + "."] * 5 + ["word"] * 95)
    no_ends = text.replace(".", "")
    at = quality.LABELLERS.index("sentence_ends")
    assert quality.votes(text)[at] == quality.GOOD and quality.votes(no_ends)[at] != quality.votes(text)[at]
    words, counts, same = quality.describe("Plain words, as they were.")
    assert quality.split_counts(counts) == (counts, 0)


def test_sample_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text")
    a, b = (quality.fit(docs.repartition(n), sample=40).scorer for n in (2, 7))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias
