import random

import pytest
from pyspark.sql import functions as F

from curvecal.llm import jaccard_join
from curvecal.llm.components import components


def brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and i * den >= num * (len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least[find(k)] if i is not None else None) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed, words=300, docs=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["The", "of", "É"]
    line = " ".join(rng.choice(vocabulary) for _ in range(12))
    rows = []
    for i in range(docs):
        if rows and rng.random() < 0.6:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " \t".join(w) if rng.random() < 0.3 else " ".join(w).upper()
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 9, 30, 45, 60, 120])))
            if rng.random() < 0.5:
                text += "\n" + line
        rows.append((docs - i, text))
    return rows + [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1004, "ONE"), (None, rows[0][1]), (1005, rows[0][1]), (1005, rows[0][1])]


@pytest.mark.parametrize("seed,n,num,few", [(1, 4, 85, 256), (2, 5, 80, 2), (3, 3, 70, 1)])
def test_equals_all_pairs(spark, monkeypatch, seed, n, num, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)  # small limits put shingles in all three classes
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, id string").repartition(4)
    got = sorted(((r.id, r.n_shingles, r.component) for r in jaccard_join.link_components(df, n=n, num=num, den=100).collect()), key=str)
    assert got == brute(rows, n, num, 100)


def test_empty_table(spark):
    assert jaccard_join.link_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a bigint, b bigint")
    found = {r.id: r.component for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_signature_guarantee():
    rng = random.Random(5)
    for _ in range(300):
        size = rng.randint(41, 130)
        universe = [rng.getrandbits(62) for _ in range(size + 40)]
        count = {h: rng.choice([2, 3, 300, 100_000]) for h in universe}
        a = set(universe[:size])
        b = set(a)
        while True:
            x = set(b)
            x.remove(rng.choice(sorted(x)))
            x.add(rng.choice(universe))
            if len(a & x) * 100 < 85 * len(a | x):
                break
            b = x
        codes = {h: int(jaccard_join.code(jaccard_join.np.array([count[h]]))[0]) for h in universe}
        out = []
        for s in (a, b):
            hashes = jaccard_join.np.array(sorted(s), jaccard_join.np.uint64)
            out.append(jaccard_join.signatures(hashes, jaccard_join.np.array([codes[int(h)] for h in hashes], jaccard_join.np.uint8), 85, 100))
        assert out[0] & out[1]


def test_codes_rise():
    counts = jaccard_join.np.arange(1, 200_000)
    codes = jaccard_join.code(counts).astype(int)
    assert (jaccard_join.np.diff(codes) >= 0).all() and codes[0] == 1 and codes[1] == 2 and codes.max() <= 255


def test_full_buckets_are_split(spark, monkeypatch):
    """300 sets share a signature: linked ones still meet, the others are dealt to buckets far smaller."""
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(20)]
    texts = []
    for _ in range(150):
        own = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randint(20, 40))]
        texts += [" ".join(passage + own), " ".join(passage + own[:-1])]
    monkeypatch.setattr(jaccard_join, "FULL", 256)
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    sets = jaccard_join.document_sets(docs, 4).drop("key")
    rows = sets.select(F.lit(7).cast("bigint").alias("signature"), "id", "size", F.col("id").alias("label"))
    split = jaccard_join.split_buckets(rows.join(sets.select("id", "bits"), "id"), 85, 100)
    most = max(r["count"] for r in split.groupBy("signature").count().collect())
    assert most < 100
    got = {tuple(r) for r in jaccard_join._open_pairs(rows, sets, 85, 100).collect()}
    assert got >= {(2 * k + 1, 2 * k) for k in range(150)}
    assert len(got) < 200


def test_split_buckets_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FULL", 1)  # every open bucket is split
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted(((r.id, r.n_shingles, r.component) for r in jaccard_join.link_components(df, n=4, num=85, den=100).collect()), key=str)
    assert got == brute(rows, 4, 85, 100)
