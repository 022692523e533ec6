import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curvecal.llm import queries, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\n\n", "a\n b", "a\n  b", "x   y", "!\x1c b\x1c  c", " 　 z", "don't  stop'll\t\tnow ", "日本 語",
       "<|endoftext|> and on", "a<|endoftext|>", "tail   ", "a" * 5000, "word " * 3000, "é" * 100, "  q \n\nq", "1 2 33  4!?\r\n -"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_any_text_equals_the_library(library):
    code = token_files.Coder(PATH)
    alphabet = list(" \n\t\r\x0b\x1c\x85   ab1!'s.") + ["the", "é"]
    rng = np.random.default_rng(5)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(4000)]
    flat, size = code.encode(texts)
    assert flat.tolist() == [i for t in texts for i in plain(library, t)]
    assert size.tolist() == [len(plain(library, t)) for t in texts]
    for text in texts:
        assert "".join(token_files.windows(text, 7)) == text
        assert [i for w in token_files.windows(text, 7) for i in plain(library, w)] == plain(library, text)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_equals_the_library(spark, library, folder):
    got = {r.doc_id: r for r in queries.QUERIES["op11_token_files"](spark, folder).collect()}
    start = 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = [*plain(library, d.text), 2]
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens) == (start, len(ids))
        assert got[d.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_nulls_repeats_long_texts_and_clashing_names(spark, library, monkeypatch):
    rows = [(i // 2 if i % 7 else None, t, i) for i, t in enumerate(ODD)] + [(1, "again", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id int, text string, place int").withColumns(
        {c: F.lit("x") for c in ("key", "hash", "file", "part", "width")})
    files = token_files.write(docs, PATH, end_id=2, parts=4)
    got = token_files.read(files).orderBy("place").collect()
    assert [r.place for r in got] == list(range(len(rows)))
    assert [r.key for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    start = 0
    for r in got:
        assert r.start == start and len(r.ids) == 4 * r.n_tokens
        start += r.n_tokens
    assert sorted((r.key is None, r.key or 0, bytes(r.ids)) for r in got) == sorted(
        (k is None, k or 0, np.array([*plain(library, t), 2], "<u4").tobytes()) for k, t, _ in rows)


def test_files_hold_ids_and_offsets(spark, library, tmp_path):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one"), ("c", "")], "name string, body string")
    token_files.write(docs, PATH, key="name", text="body", folder=str(tmp_path / "out"), parts=1)
    files = token_files.open_files(spark, str(tmp_path / "out"))
    assert files.bases.first().token_base == 0
    (path,) = {r.file for r in files.documents.collect()}
    ids = np.memmap(path.removeprefix("file:") + ".bin", "<u2", "r")
    index = np.memmap(path.removeprefix("file:") + ".idx", "<i8", "r")
    want = [plain(library, t) for t in ("one", "two words", "")]
    assert ids.tolist() == sum(want, []) and index.tolist() == np.cumsum([0, *map(len, want)]).tolist()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_files.read(token_files.write(docs, PATH)).collect() == []
