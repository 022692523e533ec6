"""The pipeline against a plain version of its stages, and its odd inputs."""

import corpus_pipeline
from curvecal.llm import decontaminate, quality, secrets

FOLDER = "/root/testdata/sf0.001"


def words(t):
    return (t or "").encode().lower().split()


def shingles(t, n=5):
    w = words(t)
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def plain(rows, items, model):
    """doc_ids and texts that stay, stage by stage without Spark."""
    rows = [r for r in rows if model.scorer.score(r[1]) >= 0.5]
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)), key=lambda k: rows[k][0])
                group[y] = x
    rows = [r for k, r in enumerate(rows) if find(k) == k]
    matcher = decontaminate.Matcher(items, 0.5, 0.7, 0.5, 4)
    return [r for r in rows if not matcher.document(r[1])]


def test_whole_run_equals_the_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = plain(rows, items, quality.fit(docs))
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in want) and 0 < len(want) < len(rows)
    before = dict(rows)
    found = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    for r in got:
        assert (r.text == before[r.doc_id]) == (not found[r.doc_id])
        assert r.n_tokens == len(r.ids) and r.n_chars == len(r.text)
        assert not any(s.text in r.text for s in found[r.doc_id])


def test_stages_keep_columns_and_odd_rows(spark):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep string, hits int, component int, id int"
    normal = "This is a normal line of words, and it ends here. Another one follows it, with some more words. "
    rows = [(1, normal, None, None, 1, "k", 1, 1, 1), (1, normal, None, None, 1, "k", 1, 1, 1), (2, normal, "en", "s", None, None, None, None, None),
            (3, None, None, None, None, None, None, None, None), (4, "", None, None, 0, "", 0, 0, 0), (None, normal, None, None, 2, "n", 2, 2, 2),
            (5, normal * 4000, "en", "s", 3, "k", 3, 3, 3), (6, f"My password=b7db7aa4a5fcc78305 is here. {normal}", "en", "s", 4, "k", 4, 4, 4)]
    df = spark.createDataFrame(rows, kind)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, FOLDER)
        assert out.columns[: len(df.columns)] == df.columns
        kept[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
        assert stage(spark, df.limit(0), FOLDER).count() == 0
    assert kept["near duplicates"] == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert len(kept["secrets"]) == len(kept["encoding"]) == len(kept["decontamination"]) == len(rows)
    text = {r.doc_id: r.text for r in corpus_pipeline.without_secrets(spark, df, FOLDER).collect()}
    assert text[6] == f"My [secret] is here. {normal}" and text[3] is None


def test_stage_order():
    assert len(corpus_pipeline.STAGES) == 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)
