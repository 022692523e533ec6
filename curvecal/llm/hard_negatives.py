"""Hard negatives for anchors by the threshold algorithm over sorted lists of every dimension.

Rows stay where they lie: each task gathers its rows into blocks of bounded size and sorts every
dimension of a block. For an anchor, the lists are read from the end its component's sign asks
for, some ranks at a time. Rows met for the first time are looked up and scored in whole numbers.
No row not met yet can score more than the sum of the anchor's components times the values read
last; once that falls strictly below the k-th score of every window still open, the block is
done. A window keeps its k-th score from block to block. Strictly: equal scores are all met, and the smaller
id wins.

Anchors are broadcast in rounds of at most ``ROUND``, each round one pass over the rows, so what
a task holds besides its block does not grow with the data. The best of each task meet in a
ranking per window. A first pass finds each anchor's positives, a second one searches the
windows these set.

Rows with a null id, label or vector, or with a null or non-finite component take no part; the
rest of a row does not matter. Vectors of unequal length count as if filled up with zeros. Rows
of one id are separate candidates, none of them meets an anchor of its own id; of anchors of one
id the smallest (label, vector) is used. Scores are exact and must fit in 64 bits. Empty tables,
anchors without positives and windows without rows give no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvecal.session import materialize, new_path

ROUND = 16_384  # anchors broadcast at a time
BLOCK = 8_192   # rows sorted at a time
RANKS = 16      # ranks of every list read at first; then twice as many each time

FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor_id", "window", "id", "score")])


def scaled(vector: str, factor: int) -> Column:
    """Components times a factor, rounded down to whole numbers; null if any is null or not finite."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, whole)


NONE = np.iinfo(np.int64).min  # score of an empty place


class Block:
    """Rows with the sorted list of every dimension.

    Numbers are doubles where every sum of products with components up to ``largest`` is a whole
    number that a double holds, else Python's whole numbers.
    """

    def __init__(self, ids, labels, vectors, largest: int):
        own = max(-int(vectors.min(initial=0)), int(vectors.max(initial=0)))
        self.kind = float if own * largest * vectors.shape[1] < 1 << 53 else object
        self.ids, self.labels, self.vectors = ids, labels, vectors.astype(self.kind)
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)

    def search(self, anchor, eligible, best, a: int, low: list[int], high: list[int]) -> None:
        """Bring the best eligible rows with scores in [low, high] into the windows of anchor number ``a``."""
        anchor = anchor.astype(self.kind)
        rows, used = len(self.ids), np.flatnonzero(anchor)
        signed, down = anchor[used], anchor[used] > 0
        met = ~eligible  # rows that may not enter are as good as met
        left, at, step = int(eligible.sum()), 0, RANKS
        while left:
            to = min(at + step, rows)
            ranks = np.arange(at, to)[:, None]
            places = np.where(down, rows - 1 - ranks, ranks)
            # an anchor of zeros has no list to read: all rows score nought
            fresh = self.order[places, used].ravel() if len(used) else np.arange(rows)
            fresh = np.unique(fresh[~met[fresh]])
            met[fresh] = True
            left -= len(fresh)
            best.offer(a, self.ids[fresh], (self.vectors[fresh] @ anchor).astype(np.int64), low, high)
            bound = int((self.values[places[-1], used] * signed).sum())
            # open: a row not met could lie in the window and reach its k-th score
            if not any(bound >= lowest and bound >= kth for lowest, kth in zip(low, best.kth(a, len(low)))):
                return
            at, step = to, step * 2


class Best:
    """The k best (score, id) of every window of every anchor; equal scores are ordered by id."""

    def __init__(self, anchors: int, windows: int, k: int):
        self.score = np.full((anchors, windows, k), NONE, np.int64)
        self.ids = np.zeros((anchors, windows, k), np.int64)

    def kth(self, a: int, windows: int) -> list[int]:
        return self.score[a, :windows, -1].tolist()

    def offer(self, a: int, ids, score, low, high) -> None:
        for w, (lowest, highest) in enumerate(zip(low, high)):
            held = self.score[a, w]
            ok = (score >= max(lowest, int(held[-1]))) & (score <= highest)
            if ok.any():
                every, named = np.concatenate((held, score[ok])), np.concatenate((self.ids[a, w], ids[ok]))
                first = np.lexsort((named, -every, every == NONE))[:len(held)]
                self.score[a, w], self.ids[a, w] = every[first], named[first]

    def rows(self):
        a, w, k = np.nonzero(self.score != NONE)
        return a, w, self.ids[a, w, k], self.score[a, w, k]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, shorter ones filled up with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _blocks(batches, width: int, largest: int):
    held, count = [], 0

    def block():
        t = pa.Table.from_batches(held).combine_chunks()
        ids, labels, vectors = (t.column(c).combine_chunks() for c in ("id", "label", "vector"))
        return Block(ids.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False), _matrix(vectors, width), largest)

    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, BLOCK - count)
            held.append(part)
            at, count = at + part.num_rows, count + part.num_rows
            if count == BLOCK:
                yield block()
                held, count = [], 0
    if held:
        yield block()


def _searched(rows: DataFrame, anchors, windows, same: bool, k: int) -> DataFrame:
    """The k best rows of each window of each anchor, from one pass over the rows.

    ``anchors`` holds ids, labels and a matrix, ``windows`` a list of (key, low, high) for each anchor.
    """
    shared = rows.sparkSession.sparkContext.broadcast((anchors, windows))

    def run(batches):
        (ids, labels, vectors), windows = shared.value
        largest = max(-int(vectors.min(initial=0)), int(vectors.max(initial=0)))
        best = Best(len(ids), max(map(len, windows), default=0), k)
        for block in _blocks(batches, vectors.shape[1], largest):
            for a, mine in enumerate(windows):
                if mine:
                    eligible = ((block.labels == labels[a]) == same) & (block.ids != ids[a])
                    _, low, high = zip(*mine)
                    block.search(vectors[a], eligible, best, a, low, high)
        a, w, found, score = best.rows()
        for at in range(0, len(a), 100_000):
            part = slice(at, at + 100_000)
            keys = [windows[i][j][0] for i, j in zip(a[part].tolist(), w[part].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[part]], pa.int64()), pa.array(keys, pa.int64()),
                                              pa.array(found[part]), pa.array(score[part])], names=FOUND.names)

    each = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    return rows.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         den: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for tables of id, label, vector.

    Ids and components are whole numbers. An anchor's positives are the best other rows of its label; a
    positive's negatives the best rows of other labels whose score lies between ``low`` and ``high``
    parts in ``den`` of the positive's score.
    """
    spark = rows.sparkSession

    def whole(df):
        return df.select(F.col("id").cast("bigint").alias("id"), "label", F.col("vector").cast("array<bigint>").alias("vector")).where(
            "id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")

    rows = whole(rows)
    one_each = whole(anchors).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a")).select("id", "a.label", "a.vector")
    asked = materialize(one_each, "anchors")
    rounds = -(-asked.count() // ROUND)
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    path = new_path(spark, "hard-negatives")
    empty = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    empty.write.parquet(path)
    for r in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r).toArrow().combine_chunks()
        for at in range(0, part.num_rows, ROUND):  # hashed rounds are even, but only nearly
            ids, labels, vectors = (part.slice(at, ROUND).column(c).combine_chunks() for c in ("id", "label", "vector"))
            given = (ids.to_numpy(), labels.to_numpy(zero_copy_only=False), _matrix(vectors, width))
            everything = [[(0, NONE + 1, np.iinfo(np.int64).max)]] * len(ids)
            found = materialize(_searched(rows, given, everything, True, positives).select(
                "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
            bounds = {}
            for a, p in found.select("anchor_id", "positive_score").distinct().collect():  # of one round's anchors
                if -(-low * p // den) <= high * p // den:
                    bounds.setdefault(a, []).append((p, -(-low * p // den), high * p // den))
            wanted = _searched(rows, given, [bounds.get(a, []) for a in ids.to_pylist()], False, negatives)
            found.join(wanted.withColumnRenamed("window", "positive_score"), ["anchor_id", "positive_score"]).select(
                "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(empty.schema).parquet(path)
