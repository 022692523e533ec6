import itertools

from curvecal.llm import language

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("held_out", language.held_out(language.F.col("doc_id")))
    codes = language.fit(docs.where("NOT held_out"))
    rows = language.predict(docs, codes).where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "x", None)],
                                  "doc_id bigint, text string, lang string")
    codes = language.fit(train)
    assert codes.languages == ["de", "en"]
    odd = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "123 !?", None), (4, "the dog " * 60000, "q"), (5, "der 😀", "q"), (5, "der 😀", "q"),
                                 (None, "𐐷", "q")], "doc_id bigint, text string, lang_pred string")
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in language.predict(odd, codes).collect())
    assert [g[1] for g in got] == ["und", "und", "und", "en", "de", "de", got[-1][1]] and got[-1][1] != "und"
    assert all(g[2] == 0 for g in got[:3])


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    codes = language.fit(empty)
    assert codes.languages == [] and language.predict(empty, codes).count() == 0
    one = spark.createDataFrame([(1, "a", "x")], "doc_id bigint, text string, lang string")
    assert language.predict(one, codes).first().lang_pred == "und"
    assert language.predict(one, language.fit(one)).first().lang_pred == "x"


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9, 30):
        words = language.codewords(n)
        assert all((a != b).any() for a, b in itertools.combinations(words, 2))
        assert ((words == 1).any(0) & (words == -1).any(0)).all()
