import random

import pytest

sp = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")

from curvecal.llm import piece_bpe  # noqa: E402
from curvecal.llm.queries import piece_model  # noqa: E402


@pytest.fixture(scope="module")
def both():
    return piece_bpe.load(piece_model()), sp.SentencePieceProcessor(model_file=piece_model())


TEXTS = ["", " ", "  x", "a▁b  c\n\n d \x00  😀", "Hello world.\nZweite Zeile", "漢字かな", "é" * 300, " " * 100 + "x" * 1000,
         "<0x0A><s></s><unk>", "tab\tand\r\nmore", "x" * 70 + " " * 70]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_library(both, text):
    ours, library = both
    ids = ours.encode(text)
    assert ids == library.encode(text)
    assert ours.decode(ids) == library.decode(ids)


def test_random_texts_and_ids(both):
    ours, library = both
    rng = random.Random(4)
    letters = "abcdefghij  tionTHE\n\t1234.,▁é漢字😀\x00ß<0xA>"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
        assert ours.encode(text) == library.encode(text)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(3, 32000), rng.randrange(3, 259), rng.randrange(0, 3), 29871, 259])
               for _ in range(rng.randint(0, 8))]
        assert ours.decode(ids) == library.decode(ids)


def test_bounded_cache_keeps_what_is_used():
    recent = piece_bpe.Recent(2)
    for k in "abcde":
        recent.put(k, k)
        assert recent.get("a") in ("a", None)
    assert len(recent.new) <= 2 and len(recent.old) <= 2


def test_operator_on_rows(spark, both):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a long text " * 5000, None), (3, "a long text " * 5000, None), (None, "😀 z", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = piece_bpe.decode(piece_bpe.encode(df, piece_model()), piece_model()).collect()
    assert [(r.doc_id, r.decoded) for r in out] == [(i, t or "") for i, t, _ in rows]
    assert [list(r.ids) for r in out] == [both[1].encode(t or "") for _, t, _ in rows]
    assert piece_bpe.encode(df.limit(0), piece_model()).count() == 0
