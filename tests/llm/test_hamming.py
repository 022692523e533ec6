import random

import pytest

from curvecal.llm import hamming


def brute(rows, queries, k):
    out = []
    for qi, q in queries:
        near = sorted((bin((q ^ c) & (1 << 64) - 1).count("1"), i) for i, c in rows if i is not None and c is not None)[:k]
        out += [(qi, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("near,segments", [(True, 4), (False, 8)])
def test_equals_brute_force(spark, near, segments):
    rng = random.Random(1)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    centres = [rng.getrandbits(64) for _ in range(8)]
    codes = []
    for _ in range(300):
        c = rng.choice(centres) if near else rng.getrandbits(64)
        for _ in range(rng.randint(0, 6)):
            c ^= 1 << rng.randrange(64)
        codes.append(signed(c))
    rows = [(i, c) for i, c in enumerate(codes)] + [(1000 + i, codes[0]) for i in range(40)]
    queries = [(i, c) for i, c in rows if i % 20 == 0]
    df = spark.createDataFrame([*rows, (None, 1), (5000, None)], "id bigint, code bigint")
    got = hamming.top_k(df, spark.createDataFrame([*queries, (None, 3)], "id bigint, code bigint"), 10, segments).collect()
    assert sorted(map(tuple, got)) == brute(rows, queries, 10)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, 0), (2, -1), (2, -1)], "id bigint, code bigint")
    got = sorted(map(tuple, hamming.top_k(df, df.where("id = 1"), 5).collect()))
    assert got == [(1, 1, 1, 0), (1, 2, 2, 64), (1, 3, 2, 64)]
    assert hamming.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_sign_code(spark):
    vector = [1.0] + [-1.0] * 62 + [0.5]
    df = spark.createDataFrame([(vector,), ([0.0] * 64,), (None,)], "v array<double>")
    assert [r[0] for r in df.select(hamming.sign_code("v")).collect()] == [1 - (1 << 63), 0, None]


def test_bound_of_a_query_limits_its_search(spark):
    """Segments of 16 bits: 0xF is 4 bits away in the first, 0xF0001 is 4 in the second and 1 in the first."""
    index = [0xF, 0xF0001, 0xFF, 0x1F << 48, 1]
    df = spark.createDataFrame([(c, [c], s, (c >> 16 * s) & 0xFFFF) for c in index for s in range(4)],
                               "code bigint, ids array<bigint>, seg int, value bigint")

    def found(bound, radius):
        query = spark.createDataFrame([(0, bound)], "q bigint, bound int")
        return sorted((r.distance, r.id) for r in hamming.hits(query, df, radius, 4).collect())

    assert found(None, 0) == [(1, 1), (4, 0xF), (5, 0xF0001), (5, 0x1F << 48), (8, 0xFF)]
    assert found(4, 0) == [(1, 1), (4, 0xF)]
    assert found(0, 1) == []
    far = spark.createDataFrame([(c, [c], s, (c >> 16 * s) & 0xFFFF) for c in [0x0001_0001_0001_0003, 0x0001_0003_0003_0003]
                                 for s in range(4)], "code bigint, ids array<bigint>, seg int, value bigint")
    query = spark.createDataFrame([(0, 5)], "q bigint, bound int")
    assert [tuple(r) for r in hamming.hits(query, far, 1, 4).collect()] == [(0, 5, 0x0001_0001_0001_0003)]
