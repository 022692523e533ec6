import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from curvecal.llm import conversation_trie, queries

EMPTY = hashlib.sha256(b"").hexdigest()


def plain(convs):
    """Nodes of {conv_id: [(turn, size), ...]} by brute force over prefixes."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for prefix, inside in members.items():
        d = len(prefix)
        subtree = [p for p in members if p[:d] == prefix]
        parents = {p[:-1] for p in members if p}
        ends = sorted(c for c in inside if len(convs[c]) == d)
        out.add((min(inside), d, min(members[prefix[:-1]]) if d else None, len(inside),
                 sum(len(p) == d + 1 for p in subtree), sum(p not in parents for p in subtree),
                 sum((len(members[p]) - 1) * p[-1][1] for p in subtree if p),
                 hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(nodes):
    got = [tuple(r) for r in nodes.select(*COLUMNS).collect()]
    assert len(got) == len(set(got))
    return set(got)


def sequences_of(spark, convs):
    return spark.createDataFrame([(c, [t for t, _ in turns], [s for _, s in turns]) for c, turns in convs.items()],
                                 "conv_id bigint, ids array<bigint>, sizes array<bigint>")


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_tree_equals_brute_force(spark, shards):
    rng = random.Random(shards)
    sizes = [rng.randrange(20) for _ in range(6)]
    convs = {c: [(t, sizes[t]) for t in (rng.randrange(rng.choice([1, 3, 6])) for _ in range(rng.randrange(7)))]
             for c in rng.sample(range(-500, 5000), 300)}
    for c in range(6000, 6200):  # copies that fill several shards
        convs[c] = [(1, sizes[1]), (2, sizes[2])]
    assert rows_of(conversation_trie.build(sequences_of(spark, convs), shards)) == plain(convs)


def test_long_lists_of_members_go_on_over_shards(spark, monkeypatch):
    convs = {c: [(7, 3)] * (c % 2) for c in range(3000)}
    assert rows_of(conversation_trie.build(sequences_of(spark, convs), 5)) == plain(convs)


def test_deep_conversations(spark):
    convs = {1: [(i % 5, 2) for i in range(3000)], 2: [(i % 5, 2) for i in range(2999)] + [(9, 1)]}
    got = {(r.conv_id, r.depth): r for r in conversation_trie.build(sequences_of(spark, convs), 3).collect()}
    assert len(got) == 3002
    assert got[1, 0].saved_tokens == 2 * 2999 and got[1, 0].n_leaves == 2 and got[2, 3000].parent_conv_id == 1


def test_tree_is_balanced_by_medians():
    tree = conversation_trie.TernaryTree()
    ends = tree.insert_medians([([i], [1]) for i in range(1023)])
    assert [tree.key[e] for e in ends] == list(range(1023))
    depth = {tree.down[0]: 1}
    for node in range(1, 1024):
        for side in (tree.low[node], tree.high[node]):
            if side >= 0:
                depth[side] = depth[node] + 1
    assert max(depth.values()) == 10


def test_any_turns(spark):
    rows = [(c, None if t == 3 else t, None if (c + t) % 4 == 0 else "user", None if t == 2 else f"text {(c * t) % 3}" * (t % 3))
            for c in (0, 1, 7, 100, 101, 250, -3, -103) for t in range(c % 7)]
    rows += [(None, 1, "user", "lost"), (5, 1, "user", "twice"), (5, 1, "user", "twice"), (6, 0, "a", "b" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumns(
        {c: F.lit("x") for c in ("ids", "sizes", "digest", "n", "id", "base", "head", "shard")})
    sequences = conversation_trie.encode_turns(turns)
    rebuilt = conversation_trie.share_heads(
        sequences, F.expr("conv_id - conv_id % 100"), F.expr("crc32(CAST(conv_id AS string)) % 6"))
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(),
                                          ((role or "", text or ""), len(text or ""))))
    own = {c: [x[2] for x in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))] for c, v in own.items()}
    want = {}
    for c, turns in own.items():
        head = zlib.crc32(str(c).encode()) % 6
        want[c] = own.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:head] + turns[head:]
    assert rows_of(conversation_trie.build(rebuilt)) == plain(want)


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversation_trie.build(conversation_trie.encode_turns(turns)).collect() == []
