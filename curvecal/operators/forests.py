"""Cross-validation of many forest settings from shared trees.

A tree's bag and its best splits depend neither on the depth limit nor on how many trees follow, so
trees grown once to the largest depth, as many as the largest forest has, serve every depth (cut at that
level) and every size (the first trees) of one leaf size. Blocks of trees are dealt over the tasks with
the training rows, packed there, and grown inside the JVM by ForestKernel.java; a second shuffle brings the
blocks of a setting together. ``grow`` is the kernel in NumPy, which tests hold it against.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvecal.constants import FOREST, SEED
from curvecal.functions.features import list_matrix
from curvecal.operators.gram import targets
from curvecal.session import java_function, materialize

BINS = 32  # as MLlib's maxBins, and as ForestKernel has room for
DEEPEST = 30  # as MLlib's limit
BLOCK = 20  # trees
TIE = 1e-9  # share of a gain below which cuts tie: the first feature and place win
#: Cells (rows x features) that one task may hold; more rows than that are left to MLlib, which deals them out.
TASK_CELLS = 2_000_000


def thresholds(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """At most ``bins`` - 1 cuts halfway between neighbouring values: all of them, or those nearest above even counts."""
    seen, counts = np.unique(values, return_counts=True)
    upto = np.arange(len(seen) - 1)
    if len(seen) > bins:
        upto = np.unique(np.searchsorted(counts.cumsum(), len(values) * np.arange(1, bins) / bins))
        upto = upto[upto < len(seen) - 1]
    return (seen[upto] + seen[upto + 1]) / 2


def grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, held: np.ndarray, depths: list[int], leaf: int) -> np.ndarray:
    """One regression tree on weighted rows, level by level; the held rows' predictions at each depth limit.

    ``bins`` and ``held`` are features x rows; ``depths`` ascend. Splits are those of least squared error that
    leave ``leaf`` draws or more on either side. ``order`` lists the rows node by node in the order of each
    feature's bins (as places in the flat table); a split keeps that order, so nothing is sorted again.
    """
    out, at = np.empty((len(depths), held.shape[1])), 0
    drawn = np.flatnonzero(weight)
    if not len(drawn):
        out[:] = y.mean()
        return out
    p, n = len(bins), len(drawn)
    bins, one_w = bins[:, drawn], weight[drawn].astype(float)
    middle = float(one_w @ y[drawn] / one_w.sum())
    off = y[drawn] - middle
    one_t, one_q = one_w * off, one_w * off * off
    flat, flat_w, flat_t = bins.ravel(), np.tile(one_w, p), np.tile(one_t, p)
    order = np.argsort(bins, axis=1, kind="stable") + np.arange(p)[:, None] * n
    sizes = np.array([n])
    node, guess = np.zeros(held.shape[1], np.int64), np.zeros(held.shape[1])
    for depth in range(depths[-1] + 1):
        starts = sizes.cumsum() - sizes
        first = order[0]
        own_w, own_t, own_q = (np.add.reduceat(v[first], starts) for v in (one_w, one_t, one_q))
        inside = np.flatnonzero(node >= 0)
        guess[inside] = (own_t / own_w)[node[inside]]
        if depth == depths[at]:
            out[at] = guess
            at += 1
            if at == len(depths):
                break
        alone = own_t ** 2 / own_w
        able = (sizes > 1) & (own_w >= 2 * leaf) & (own_q > alone * (1 + TIE) + TIE)
        if not able.any():
            break
        order = order[:, np.repeat(able, sizes)]
        sizes, own_w, own_t, alone = sizes[able], own_w[able], own_t[able], alone[able]
        starts, owner = sizes.cumsum() - sizes, np.repeat(np.arange(len(sizes)), sizes)
        # error taken away by a cut behind each place of each order
        bin_at = flat[order]
        left_w = flat_w[order].cumsum(axis=1)
        left_w -= (own_w.cumsum() - own_w)[owner]
        left_t = flat_t[order].cumsum(axis=1)
        left_t -= (own_t.cumsum() - own_t)[owner]
        right_w = own_w[owner] - left_w
        right_t = own_t[owner] - left_t
        fits = (left_w >= leaf) & (right_w >= leaf)
        fits[:, :-1] &= bin_at[:, :-1] != bin_at[:, 1:]
        np.maximum(right_w, 0.5, out=right_w)  # the last place of a node, which does not fit
        left_t *= left_t
        left_t /= left_w
        right_t *= right_t
        right_t /= right_w
        left_t += right_t
        left_t *= fits
        left_t -= ~fits
        gain = left_t  # -1 where nothing may be cut
        most = np.maximum.reduceat(gain, starts, axis=1)
        best = most.max(axis=0)
        near = best - TIE * np.abs(best)
        feature = (most >= near).argmax(axis=0)
        split = best > alone * (1 + TIE) + TIE
        if not split.any():
            break
        place = np.flatnonzero(gain[feature[owner], np.arange(len(owner))] >= near[owner])
        cut = bin_at[feature, place[np.searchsorted(place, starts)]]
        # the left children of all split nodes, then the right ones; rows of other nodes are done
        number = np.full(len(able), -1)
        number[np.flatnonzero(able)[split]] = np.arange(split.sum())
        stays = split[owner]
        owner = (split.cumsum() - 1)[owner[stays]]
        order = order[:, stays]
        feature, cut, sizes = feature[split], cut[split], sizes[split]
        members = order[0]
        lefts = np.zeros(n, bool)
        lefts[members] = flat[feature[owner] * n + members] <= cut[owner]
        left_sizes = np.add.reduceat(lefts[members].astype(np.int64), sizes.cumsum() - sizes)
        goes = np.tile(lefts, p)[order]
        order = np.concatenate([np.take(order, np.flatnonzero(side)).reshape(p, -1) for side in (goes, ~goes)], axis=1)
        sizes = np.concatenate([left_sizes, sizes - left_sizes])
        own = number[node[inside]]
        node[inside[own < 0]] = -1
        inside, own = inside[own >= 0], own[own >= 0]
        node[inside] = own + len(feature) * (held[feature[own], inside] > cut[own])
    out[at:] = guess
    return out + middle


def fold_data(fold: np.ndarray, x: np.ndarray, y: np.ndarray, g) -> tuple:
    """Binned training rows, their targets, and the binned rows of one fold (features x rows)."""
    inside = fold == g
    cuts = [thresholds(column) for column in x[~inside].T]
    bins = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T)]).astype(np.int16)
    return np.ascontiguousarray(bins[:, ~inside]), y[~inside], np.ascontiguousarray(bins[:, inside])


def tree_rows(table: pa.Table, width: int) -> tuple:
    """Folds, features and targets of a task's rows, in an order that does not depend on how they arrived."""
    table = table.combine_chunks()
    x = list_matrix(table.column("x").chunk(0), width)
    y, fold = targets(table.column("y")), table.column("fold").to_numpy()
    place = np.lexsort([y, *x.T[::-1], fold])
    return fold[place], x[place], y[place]


def place_keys(spark, count: int) -> list[int]:
    """One number for each of ``count`` hash partitions."""
    found = spark.range(40 * count).groupBy(F.pmod(F.hash("id"), F.lit(count)).alias("p")).agg(F.min("id").alias("id"))
    keys = [r["id"] for r in found.collect()]
    return sorted(keys + [40 * count + k for k in range(count - len(keys))])


def bags(first: int, last: int, n: int, seed: int) -> np.ndarray:
    """How often each of ``n`` rows is drawn for each tree from ``first`` to before ``last``."""
    return np.stack([np.random.default_rng([seed, tree]).poisson(1.0, n).astype(np.uint8) for tree in range(first, last)])


def packed(bins: np.ndarray, y: np.ndarray, held: np.ndarray, weights: np.ndarray, depths: list[int], leaves: list[int]) -> bytes:
    """What ForestKernel reads: sizes, settings and targets, then bins and held rows row by row, then each tree's weights."""
    head = np.array([*bins.shape, held.shape[1], len(weights), len(leaves), len(depths), *leaves, *depths], "<i4")
    return b"".join(part.tobytes() for part in (head, y.astype("<f8"), bins.T.astype(np.uint8), held.T.astype(np.uint8), weights))


def kernel(spark) -> str:
    """Name of the SQL function that grows a packed record's trees and sums their predictions, as ``grow`` makes them."""
    return java_function(spark, "curvecal.operators", "ForestKernel", "array<binary>")


def block_scores(rows: DataFrame, width: int, trees: int, marks: set[int], depths: list[int], leaves: list[int],
                 seed: int = SEED) -> DataFrame:
    """Sums of held-out predictions per block of trees: (fold, place, first, last, s, y).

    ``place`` counts the leaf sizes, and within them the depths. ``s`` and ``y`` are the bytes of doubles in
    the order of ``tree_rows``; only the first block carries ``y``.
    """
    edges = sorted(marks | set(range(0, trees, BLOCK)) | {trees})
    spans = list(zip(edges[:-1], edges[1:]))
    keys = place_keys(rows.sparkSession, len(spans))
    span_of = dict(zip(keys, spans))

    def run(key, table):
        first, last = span_of[key[0].as_py()]
        fold, x, y = tree_rows(table, width)
        lines = []
        for g in np.unique(fold):
            bins, known, held = fold_data(fold, x, y, g)
            if not len(known):
                raise ValueError("a forest needs rows outside the fold it is tested on")
            record = packed(bins, known, held, bags(first, last, len(known), seed), depths, leaves)
            lines.append([int(g), first, last, record, y[fold == g].tobytes() if first == 0 else None])
        return pa.table({f.name: pa.array(v, f.type) for f, v in zip(kinds, zip(*lines))})

    kinds = pa.schema([(n, pa.int32()) for n in ("fold", "first", "last")] + [(n, pa.binary()) for n in ("record", "y")])
    dealt = (rows.select(F.col("g").cast("int").alias("fold"), "y", "x", F.explode(F.lit(keys).cast("array<bigint>")).alias("block"))
             .repartition(len(keys), "block"))
    records = dealt.groupBy("block").applyInArrow(run, "fold int, first int, last int, record binary, y binary")
    return records.select("fold", "first", "last", "y", F.posexplode(F.call_function(kernel(rows.sparkSession), "record")).alias("place", "s"))


def forest_scores(rows: DataFrame, width: int, settings: list[tuple[int, int | None, int]]) -> dict[tuple, list[tuple]]:
    """(fold, n, rmse, mae, r2) of every (trees, depth, leaf), on rows (g = fold, y, x)."""
    wanted = [(trees, DEEPEST if depth is None else depth, leaf) for trees, depth, leaf in settings]
    marks = sorted({trees for trees, _, _ in wanted})
    depths, leaves = sorted({d for _, d, _ in wanted}), sorted({leaf for _, _, leaf in wanted})
    blocks = block_scores(rows, width, marks[-1], set(marks), depths, leaves)

    def run(key, table):
        table = table.sort_by("first")
        y = doubles(table.column("y")[0])
        spread = float(((y - y.mean()) ** 2).sum())
        total, lines = np.zeros(len(y)), []
        for last, part in zip(table.column("last").to_pylist(), table.column("s")):
            total += doubles(part)
            if last in marks:
                err = total / last - y
                sse = float((err ** 2).sum())
                lines.append([*(k.as_py() for k in key), last, len(y), (sse / len(y)) ** 0.5, float(np.abs(err).mean()),
                              1 - sse / spread if spread > 0 else None])
        return pa.table({f.name: pa.array(v, f.type) for f, v in zip(found_types, zip(*lines))})

    found_types = pa.schema([(n, pa.int32()) for n in ("fold", "place", "trees")] + [("n", pa.int64())]
                            + [(n, pa.float64()) for n in ("rmse", "mae", "r2")])
    scored = blocks.groupBy("fold", "place").applyInArrow(
        run, "fold int, place int, trees int, n bigint, rmse double, mae double, r2 double").collect()
    by = {}
    for r in sorted(scored, key=lambda r: r["fold"]):
        own = (r["trees"], depths[r["place"] % len(depths)], leaves[r["place"] // len(depths)])
        by.setdefault(own, []).append((r["fold"], r["n"], r["rmse"], r["mae"], r["r2"]))
    return {setting: by[want] for setting, want in zip(settings, wanted)}


def doubles(cell: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), "<f8")


def forest_predict(train: DataFrame, width: int, setting: tuple[int, int | None, int], rows: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` with ``y_pred``, the mean of trees grown on ``train`` (y, x); equal rows ``x`` are looked up once.

    Looked-up rows are dealt into parts that a task can hold; each part meets every block of trees.
    """
    trees, depth, leaf = setting
    asked = materialize(rows.select("x").distinct(), "forest-rows")
    parts = max(1, -(-asked.count() * width // TASK_CELLS))
    spans = [(first, min(first + BLOCK, trees)) for first in range(0, trees, BLOCK)]
    keys = place_keys(train.sparkSession, len(spans) * parts)
    work = {key: (*spans[k % len(spans)], k // len(spans)) for k, key in enumerate(keys)}
    blocks = F.lit(keys).cast("array<bigint>")

    def run(key, table):
        first, last, part = work[key[0].as_py()]
        fold, x, y = tree_rows(table, width)
        bins, known, held = fold_data(fold, x, y, 1)
        record = packed(bins, known, held, bags(first, last, len(known), seed), [DEEPEST if depth is None else depth], [leaf])
        line = [part, first, record, x[fold == 1].tobytes() if first == 0 else None]
        return pa.table({f.name: pa.array([v], f.type) for f, v in zip(kinds, line)})

    def add(key, table):
        table = table.sort_by("first")  # added up block by block: the same order each time
        cells, sums = doubles(table.column("x")[0]), sum(doubles(s) for s in table.column("s"))
        x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(cells) + 1, width, dtype=np.int32)), pa.array(cells))
        return pa.table({"x": x, "y_pred": pa.array(sums / trees)})

    kinds = pa.schema([(n, pa.int32()) for n in ("part", "first")] + [(n, pa.binary()) for n in ("record", "x")])
    by_part = F.lit([[key for key in keys if work[key][2] == part] for part in range(parts)]).cast("array<array<bigint>>")
    both = (train.select(F.lit(0).alias("fold"), "y", "x", F.explode(blocks).alias("block"))
            .unionByName(asked.select(F.lit(1).alias("fold"), F.lit(0.0).alias("y"), "x",
                                      F.explode(F.get(by_part, F.pmod(F.xxhash64("x"), F.lit(parts)).cast("int"))).alias("block"))))
    records = both.repartition(len(keys), "block").groupBy("block").applyInArrow(run, "part int, first int, record binary, x binary")
    sums = records.select("part", "first", "x", F.get(F.call_function(kernel(train.sparkSession), "record"), F.lit(0)).alias("s"))
    found = materialize(sums.groupBy("part").applyInArrow(add, "x array<double>, y_pred double"), "forest-predictions")
    return rows.join(found, "x").select(*rows.columns, "y_pred")


def setting(params: dict) -> tuple[int, int | None, int]:
    """(trees, depth, leaf) of a forest candidate's parameters."""
    whole = FOREST | params
    return whole["trees"], whole["depth"], whole["min_leaf"]
