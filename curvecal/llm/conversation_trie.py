"""Prefix trie of conversations: what many conversations share from their first turn on.

Turns are replaced by ids of a dictionary of the different turns (role and text), so texts are
read once and never shuffled. Conversations are dealt to shards by ranges of their id
sequences. A shard puts its different sequences into a ternary search tree, the median
first and then the medians of both halves, so that the trees of siblings stay balanced, and
walks it without recursion to add up members, leaves and savings bottom-up.

Sequences are in order over the shards, so only prefixes of a shard's first and last sequence
can occur elsewhere. Those nodes are merged by a digest of their ids; all others are final in
their shard. A merged node's own leaf and savings count in its first shard; in each shard the
sums below a node follow the paths to the first and last sequence, so no pass over levels is
needed. Copies of one conversation may fill many shards: equal sequences are one sequence of
each, and the digest of a node's members is continued from shard to shard.

A conversation is its turns ordered by turn number, null first; turns of one number are ordered
by digest. Null roles and texts are empty ones. Rows without conv_id belong to no conversation.
Repeated rows are turns of their own. Other columns take no part. Ids of one conversation (16
bytes a turn) are held as one row; texts of any length are only hashed. An empty table has no
node, not even a root.
"""

import hashlib
import math
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from curvecal.session import attach, drop_table, materialize

SHARD_IDS = 500_000  # ids a shard's tree is built from
COMMON = 500         # a turn of more than this part of all rows is looked up in a broadcast table
CHUNK = 500          # member ids in one piece of a list that goes on in another shard

INTERIOR, EDGE, MEMBERS = 0, 1, 2
BOTH, FIRST, LAST = 0, 1, 2

SHARD = T.StructType([T.StructField(n, t) for n, t in [
    ("kind", T.IntegerType()), ("shard", T.IntegerType()), ("branch", T.IntegerType()), ("depth", T.LongType()),
    ("conv_id", T.LongType()), ("parent_conv_id", T.LongType()), ("parent_branch", T.IntegerType()), ("turn_id", T.LongType()),
    ("size", T.LongType()), ("n_convs", T.LongType()), ("n_children", T.LongType()), ("n_leaves", T.LongType()),
    ("saved", T.LongType()), ("digest", T.BinaryType()), ("parent_digest", T.BinaryType()), ("ends", T.StringType()),
    ("place", T.LongType()), ("members", T.StringType())]])


def encode_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): each conversation as dictionary ids of its turns and the code points of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = materialize(turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"),
        F.char_length(text).cast("bigint").alias("size")), "turns")
    entries = materialize(slim.groupBy("digest").agg(F.count("*").alias("n")).withColumn(
        "id", F.monotonically_increasing_id()), "turn-dictionary")
    total = entries.agg(F.sum("n")).first()[0] or 0
    is_common = F.col("n") * COMMON > total  # fewer than COMMON turns can be
    common = entries.where(is_common).select("digest", "id")
    looked_up = slim.join(F.broadcast(common), "digest", "left")
    coded = looked_up.where("id IS NOT NULL").unionByName(
        looked_up.where("id IS NULL").drop("id").join(entries.where(~is_common).select("digest", "id"), "digest"))
    sequences = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "size"))).alias("turns"))
    written = materialize(sequences.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.size").alias("sizes")), "sequences")
    drop_table(slim)
    drop_table(entries)
    return written


def share_heads(sequences: DataFrame, base: Column, head: Column) -> DataFrame:
    """Each conversation with its first ``head`` turns taken from conversation ``base`` (none if there is none)."""
    given = sequences.select(F.col("conv_id").alias("base"), F.col("ids").alias("base_ids"), F.col("sizes").alias("base_sizes"))
    both = sequences.withColumn("base", base).withColumn("head", head.cast("int")).join(given, "base", "left")

    def rebuilt(own, other):
        return F.expr(f"concat(slice(coalesce({other}, array()), 1, head), slice({own}, head + 1, greatest(size({own}), 1)))")

    return both.select("conv_id", rebuilt("ids", "base_ids").alias("ids"), rebuilt("sizes", "base_sizes").alias("sizes"))


class TernaryTree:
    """A trie whose children are binary search trees; node 0 is the root and holds no id."""

    def __init__(self):
        self.key, self.size, self.parent, self.depth = [0], [0], [-1], [0]
        self.low, self.high, self.down = [-1], [-1], [-1]

    def _new(self, key: int, size: int, parent: int) -> int:
        node = len(self.key)
        for column, value in ((self.key, key), (self.size, size), (self.parent, parent), (self.depth, self.depth[parent] + 1),
                              (self.low, -1), (self.high, -1), (self.down, -1)):
            column.append(value)
        return node

    def insert(self, ids, sizes) -> int:
        """The node at which a sequence ends."""
        node = 0
        for key, size in zip(ids, sizes):
            at = self.down[node]
            if at < 0:
                at = self.down[node] = self._new(key, size, node)
            while self.key[at] != key:
                side = self.low if key < self.key[at] else self.high
                if side[at] < 0:
                    side[at] = self._new(key, size, node)
                at = side[at]
            node = at
        return node

    def insert_medians(self, sequences: list) -> list[int]:
        """Insert sorted sequences, medians first; the node at which each ends."""
        ends, spans = [0] * len(sequences), [(0, len(sequences))]
        while spans:
            begin, end = spans.pop()
            if begin < end:
                middle = (begin + end) // 2
                ends[middle] = self.insert(*sequences[middle])
                spans += [(begin, middle), (middle + 1, end)]
        return ends

    def walk(self):
        """All nodes, each after its parent."""
        open_nodes = [0]
        while open_nodes:
            node = open_nodes.pop()
            yield node
            at = self.down[node]
            siblings = [at] if at >= 0 else []
            while siblings:
                at = siblings.pop()
                open_nodes.append(at)
                siblings += [side[at] for side in (self.low, self.high) if side[at] >= 0]

    def path(self, node: int) -> list[int]:
        nodes = [node]
        while node:
            node = self.parent[node]
            nodes.append(node)
        return nodes[::-1]


def _listed(members) -> str:
    return ",".join(map(str, members))


def shard_rows(shard: int, rows):
    """Rows of SHARD for the sorted (ids, sizes, conv_id) of one shard."""
    sequences, members = [], []  # members: ids at either end of the shard, else count, smallest id and digest
    for ids, sizes, conv_id in rows:
        if not sequences or ids != sequences[-1][0]:
            if len(members) > 1:
                members[-1] = (len(members[-1]), members[-1][0], hashlib.sha256(_listed(members[-1]).encode()).hexdigest())
            sequences.append((ids, sizes))
            members.append(array("q"))
        members[-1].append(conv_id)
    if not sequences:
        return
    tree = TernaryTree()
    ends = tree.insert_medians(sequences)
    n = len(tree.key)
    count, smallest, hashed = [0] * n, [None] * n, [None] * n
    open_lists = {}
    for node, held in zip(ends, members):
        if isinstance(held, tuple):
            count[node], smallest[node], hashed[node] = held
        else:
            count[node], smallest[node], open_lists[node] = len(held), held[0], held
    first, last = tree.path(ends[0]), tree.path(ends[-1])
    branch = dict.fromkeys(first, FIRST) | {node: LAST for node in last}
    branch |= {node: BOTH for node in set(first) & set(last)}

    children, leaves, saved = [0] * n, [0] * n, [0] * n
    order = list(tree.walk())
    for node in reversed(order):
        above = tree.parent[node]
        if node not in branch:
            leaves[node] += not children[node]
            saved[node] += (count[node] - 1) * tree.size[node]
            children[above] += 1
            leaves[above] += leaves[node]
            saved[above] += saved[node]
        if node:
            count[above] += count[node]
            if smallest[above] is None or smallest[node] < smallest[above]:
                smallest[above] = smallest[node]

    digest = {0: hashlib.sha256(b"").digest()}
    for node in first[1:] + last[1:]:
        if node not in digest:
            digest[node] = hashlib.sha256(digest[tree.parent[node]] + tree.key[node].to_bytes(8, "little", signed=True)).digest()
    for node in order:
        above, edge = tree.parent[node], branch.get(node)
        yield (INTERIOR if edge is None else EDGE, shard, edge, tree.depth[node], smallest[node],
               None if above < 0 or above in branch else smallest[above], branch.get(above), tree.key[node] if node else None,
               tree.size[node], count[node], children[node], leaves[node], saved[node], digest.get(node),
               None if edge is None else digest.get(above), hashed[node], None, None)
    for node, held in open_lists.items():
        for at in range(0, len(held), CHUNK):
            yield (MEMBERS, shard, *[None] * 11, digest[node], None, None, at, _listed(held[at:at + CHUNK]))


def _batches(rows, size: int = 20_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows):
    kinds = {"integer": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.typeName()]) for c, f in zip(zip(*rows), SHARD)],
                                      names=SHARD.names)


def _grow(batches):
    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("ids", "sizes", "conv_id")))

    yield from _batches(shard_rows(TaskContext.get().partitionId(), rows()))


def _hash_lists(batches):
    """One digest for each run of rows with the same node, whose pieces come in order."""
    node, state, first = None, None, True
    for b in batches:
        done = []
        for digest, piece in zip(b.column("digest").to_pylist(), b.column("members").to_pylist()):
            if digest != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state, first = digest, hashlib.sha256(), True
            state.update((piece if first else "," + piece).encode())
            first = False
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())],
                                         names=["digest", "list_hash"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "list_hash"])


def build(sequences: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of (conv_id, ids, sizes); conv_ids are unique.

    conv_id: smallest member; depth; turn_id: dictionary id of the last turn; parent_conv_id;
    n_convs: members; n_children; n_leaves: childless nodes in its subtree, itself included;
    saved_tokens: code points that members beyond the first repeat, over its subtree;
    ends_sha256: hash of the sorted, comma-joined ids of the conversations that end there.
    """
    spark = sequences.sparkSession
    if shards is None:
        total = sequences.agg(F.sum(F.size("ids"))).first()[0] or 0
        shards = max(math.ceil(total / SHARD_IDS), spark.sparkContext.defaultParallelism)
    dealt = sequences.repartitionByRange(shards, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    grown = materialize(dealt.select("conv_id", "ids", "sizes").mapInArrow(_grow, SHARD), "trie-shards")

    edges = grown.where(F.col("kind") == EDGE)
    lists = (grown.where(F.col("kind") == MEMBERS).select("digest", "shard", "place", "members")
             .repartition("digest").sortWithinPartitions("digest", "shard", "place").select("digest", "members")
             .mapInArrow(_hash_lists, "digest binary, list_hash string"))
    merged = edges.groupBy("digest").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("turn_id").alias("turn_id"),
        F.first("parent_digest").alias("parent_digest"), F.sum("n_convs").alias("n_convs"), F.first("size").alias("size"),
        F.sum("n_children").alias("own_children"), F.min("shard").alias("owner"), F.max("ends").alias("ends"))
    kids = merged.where("parent_digest IS NOT NULL").groupBy(F.col("parent_digest").alias("digest")).agg(F.count("*").alias("kids"))
    merged = materialize(merged.join(kids, "digest", "left").join(lists, "digest", "left").select(
        "digest", "parent_digest", "conv_id", "depth", "turn_id", "n_convs", "owner",
        (F.col("own_children") + F.coalesce("kids", F.lit(0))).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("own_saved"),
        F.coalesce("list_hash", "ends").alias("ends")), "trie-edges")

    own = merged.select("digest", F.col("conv_id").alias("node_conv"), "owner", "own_saved",
                        (F.col("n_children") == 0).cast("bigint").alias("own_leaf"))
    placed = edges.select("digest", "shard", "branch", "depth", "n_leaves", "saved").join(own, "digest")
    here = (F.col("shard") == F.col("owner")).cast("bigint")
    below = {BOTH: Window.partitionBy("shard"), FIRST: Window.partitionBy("shard", "branch")}
    below = {k: w.orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0) for k, w in below.items()}

    def subtree(inside, itself):
        amount = F.col(inside) + here * F.col(itself)
        return F.when(F.col("branch") == BOTH, F.sum(amount).over(below[BOTH])).otherwise(F.sum(amount).over(below[FIRST]))

    sums = placed.select("digest", subtree("n_leaves", "own_leaf").alias("leaves"), subtree("saved", "own_saved").alias("saved"))
    sums = sums.groupBy("digest").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = merged.select(F.col("digest").alias("parent_digest"), F.col("conv_id").alias("parent_conv_id"))
    ends = F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    columns = ["conv_id", "depth", "turn_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends]
    shared = merged.join(sums, "digest").join(above, "parent_digest", "left").select(*columns)

    inner = grown.where(F.col("kind") == INTERIOR).withColumnRenamed("saved", "saved_tokens")
    under_edge = attach(
        inner.where("parent_branch IS NOT NULL").drop("parent_conv_id").withColumn("parent_depth", F.col("depth") - 1),
        placed.select("shard", F.col("branch").alias("parent_branch"), F.col("depth").alias("parent_depth"),
                      F.col("node_conv").alias("parent_conv_id")),
        ["shard", "parent_branch", "parent_depth"], how="left")
    return (shared.unionByName(inner.where("parent_branch IS NULL").select(*columns))
            .unionByName(under_edge.select(*columns)))
