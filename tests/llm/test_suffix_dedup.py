import random
import tracemalloc

import numpy as np
import pytest

from curvecal.llm import suffix_dedup


def brute(rows, length=50):
    """Per row: bytes kept, by the definition."""
    texts = {i: (t or "").encode() for i, t in rows if i is not None}
    first: dict[bytes, int] = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - length + 1):
            first.setdefault(texts[i][k:k + length], i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        if i is not None:
            for k in range(len(raw) - length + 1):
                if first[raw[k:k + length]] < i:
                    gone[k:k + length] = [True] * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(20) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [say(rng.randint(1, 60))]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 1), rng.choice(shared))
        text = " ".join(parts)
        if rows and rng.random() < 0.3:
            old = rng.choice(rows)[1] or ""
            k = rng.randint(0, len(old))
            text = old[:k] + rng.choice("xyz ") + old[k + rng.randint(0, 3):]
        rows.append((i * 7 % 120, text))
    rows += [(500, "a" * 3000), (501, "a" * 2000 + "b" * 500), (502, rows[3][1]), (502, rows[3][1]), (503, None), (504, ""),
             (505, "x" * 49), (506, "x" * 50), (507, "x" * 51), (None, rows[3][1]), (-5, rows[9][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_definition(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1 << 12)
    monkeypatch.setattr(suffix_dedup, "HOT_SAMPLE", 60 * seed)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(((r.id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept))
                  for r in suffix_dedup.remove_repeats(df).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, part int, place string")
    assert suffix_dedup.remove_repeats(df).count() == 0


def test_suffix_classes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:2000] = data[:1000]
    data[3000:3300] = 97
    starts = np.arange(len(data) - 50 + 1)
    classes = suffix_dedup.suffix_classes(data, starts, 50)
    raw = data.tobytes()
    by_text = {}
    for s, c in zip(starts.tolist(), classes.tolist()):
        assert by_text.setdefault(raw[s:s + 50], c) == c
    assert len(set(by_text.values())) == len(by_text)


def test_packed_records():
    r = suffix_dedup.Records([-5, 1 << 40], [3, 70000], [1, 0xFFFFFFFF], [9, (1 << 64) - 1], [0, 7])
    again = suffix_dedup.Records.unpack(r.pack())
    assert all((a == b).all() for a, b in zip(r.columns, again.columns))


def test_hot_windows_have_two_hashes(monkeypatch):
    """Windows whose first hashes collide are not copies; they stay open for the suffix sort."""
    monkeypatch.setattr(suffix_dedup, "stretch_hashes", lambda prefix, start, end: np.full(len(start), 7, np.uint64))
    texts = [bytes(range(40, 100)), bytes(range(50, 110)), bytes(range(40, 100))]
    *_, single = suffix_dedup.records(texts, 50, 20)
    h, second = single((np.array([0, 1, 2, 0]), np.array([0, 0, 0, 10])))
    assert len(set(h.tolist())) == 1 and second[0] == second[2] != second[1] == second[3]
    copies, rest = suffix_dedup.split_copies(suffix_dedup.Records([0, 1, 2], [0, 0, 0], [1, 1, 1], h[:3], second[:3]))
    assert copies.doc.tolist() == [2] and sorted(rest.doc.tolist()) == [0, 1]


def test_memory_of_a_group():
    """Records of one part (about one per 16 bytes of text) are split within 40 MB beside the records themselves."""
    n = suffix_dedup.PART_BYTES // 16
    rng = np.random.default_rng(1)
    r = suffix_dedup.Records(np.arange(n) % 5000, np.arange(n), np.ones(n), rng.integers(0, n, n), rng.integers(0, 3, n))
    tracemalloc.start()
    copies, rest = suffix_dedup.split_copies(r)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(copies.doc) + len(rest.doc) == n and len(copies.doc)
    assert peak < 40e6
