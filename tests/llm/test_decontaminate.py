import random

from curvecal.llm import decontaminate as d


def items(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)] + ["the", "of", "and"] * 60
    return [(k, ". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(4, 20))) for _ in range(rng.randint(1, 3))) + "?")
            for k in range(n)]


def test_search_equals_full_scoring():
    index = d.ItemIndex(items())
    rng = random.Random(2)
    for _ in range(400):
        terms = sorted({rng.randrange(len(index.words)) for _ in range(rng.randint(1, 60))})
        scores = {}
        for t in terms:
            for item, v in zip(index.lists[t], index.impacts[t]):
                scores[item] = scores.get(item, 0) + v
        limit = rng.choice([0.05, 0.2, 0.5])
        want = {i: v for i, v in scores.items() if v >= limit - 1e-9}
        got = dict(index.search(terms, limit))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_bound_drops_no_passage():
    tests = items(3)
    m = d.Matcher(tests, 0.5, 0.7, 0.5, 4)
    rng = random.Random(4)
    for _ in range(60):
        tokens = [w for _ in range(rng.randint(0, 8)) for w in rng.choice([d.words(rng.choice(tests)[1]), ["the"] * 9, ["x"] * 30])]
        known = d.np.array([m.index.words.get(t, -1) for t in tokens], d.np.int32)
        half = m.size // 2
        hopeful = set(m.hopeful(known, half).tolist())
        for k in range(max(1, (len(tokens) - 1) // half)):
            terms = sorted({int(t) for t in known[k * half:(k + 2) * half] if t >= 0})
            if m.index.search(terms, 0.5):
                assert k in hopeful


def test_planted_items_are_found_and_others_are_not(spark):
    tests = items(5)
    rng = random.Random(6)
    fill = lambda n: " ".join(f"z{rng.randrange(3000)}" if rng.random() < 0.6 else "the" for _ in range(n))
    rows, want = [], set()
    for i in range(80):
        text = fill(rng.randint(0, 400))
        if i % 2:
            k, item = rng.choice(tests)
            text = f"{text} {item.upper() if i % 4 == 1 else item}\n{fill(rng.randint(0, 300))}"
            want.add((i, k))
        rows.append((i, text, [0]))
    rows += [(500, None, None), (501, "", None), (1, rows[1][1], None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, hits array<int>")
    tests += [(900, None), (901, ""), (902, "?!")]
    found = d.contaminated(df, spark.createDataFrame(tests, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want) + 1
    assert all(r.question_overlap == 1 and r.answer_overlap == 1 and r.score > 0.99 for r in found)
    assert d.contaminated(df, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert d.with_hits(df.limit(0), spark.createDataFrame(tests, "item_id bigint, text string")).count() == 0


def test_question_without_the_answer_is_no_leak():
    m = d.Matcher([(1, "alpha beta gamma delta epsilon zeta eta theta. final answer words here")], 0.5, 0.7, 0.5, 4)
    assert m.document("alpha beta gamma delta epsilon zeta eta theta nothing else") == []
    assert m.document("alpha beta gamma delta epsilon zeta eta theta x final answer words here")
