"""Bootstrap of any model of the zoo: replicate weights, refits, and bands for predictions.

Rows are never copied per replicate. A row's Poisson weights come from the hexadecimal digits
of md5(seed:key:block), sixteen bits a replicate, so a rerun task, another partitioning or
another engine gives the same intervals. Linear and kernel-feature models are refitted from
weighted moments of one scan; trees are refitted by MLlib with the weights as a column.

Two bands come out of the refits. ``mean_band`` is the spread of the refits alone: where the
mean response may lie. ``prediction_band`` adds to each refit a residual, drawn from what rows
outside a replicate's sample showed as error, and is meant to hold a new observation.
"""

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvecal.functions import solvers as S
from curvecal.functions.features import list_matrix
from curvecal.operators.gram import matrix_schema, merge_moments, pack_moments, targets
from curvecal.operators.ranking import running_counts

REPLICATES = 100
TREE_REPLICATES = 20
TREE_FITS = 4     # tree replicates fitted at one time
RESIDUALS = 1000  # order statistics kept of the residuals
LEVEL = 0.95
CHUNK = 4096
#: A draw of at least the k-th entry counts at least k + 1: the Poisson(1) distribution in 65536ths.
LIMITS = [int(65536 * c) for c in np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(8)])]


def hashed(seed: int, key: Column, part: Column | str) -> Column:
    """md5 of seed, key and part as hexadecimal digits; a null key is the empty one."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), part.cast("string")))


def draw_bits(seed: int, key: Column, replicates: int) -> Column:
    """Sixteen random bits for each replicate, packed; eight replicates share one hash."""
    return F.concat(*[F.unhex(hashed(seed, key, str(block))) for block in range(-(-replicates // 8))])


def drawn(seed: int, key: Column, replicate: int) -> Column:
    """The sixteen bits of one replicate as a number."""
    return F.conv(F.substring(hashed(seed, key, str(replicate // 8)), replicate % 8 * 4 + 1, 4), 16, 10).cast("int")


def weight_column(seed: int, key: Column, replicate: int) -> Column:
    """Poisson weight of a row in one replicate."""
    u = drawn(seed, key, replicate)
    return sum((F.when(u >= limit, 1).otherwise(0) for limit in LIMITS), F.lit(0)).cast("double")


def weights_of(bits: pa.Array, replicates: int) -> np.ndarray:
    """Poisson weights, rows x replicates, of a column of ``draw_bits``."""
    raw = np.frombuffer(b"".join(bits.to_pylist()), ">u2").reshape(len(bits), -1)[:, :replicates]
    return np.searchsorted(LIMITS, raw, side="right").astype(float)


class Stack:
    """Weighted sums of all replicates about one fixed origin: whole blocks are added."""

    def __init__(self, origin: np.ndarray, replicates: int):
        size = len(origin)
        self.origin, self.upper = origin, np.triu_indices(size)
        self.n = np.zeros(replicates)
        self.first = np.zeros((replicates, size))
        self.second = np.zeros((replicates, len(self.upper[0])))

    def add(self, block: np.ndarray, weights: np.ndarray) -> None:
        dev = block - self.origin
        self.n += weights.sum(axis=0)
        self.first += weights.T @ dev
        self.second += weights.T @ (dev[:, self.upper[0]] * dev[:, self.upper[1]])

    def moments(self) -> list[S.Moments]:
        size = len(self.origin)
        out = []
        for count, lean, flat in zip(self.n, self.first, self.second):
            raw = np.zeros((size, size))
            raw[self.upper] = flat
            raw = raw + raw.T - np.diag(raw.diagonal())
            shift = lean / count if count else lean
            out.append(S.Moments(float(count), self.origin + shift, raw - np.outer(lean, shift)))
        return out


def weighted_moments(block: np.ndarray, weights: np.ndarray) -> list[S.Moments]:
    """Moments of one block of rows under each column of ``weights``."""
    stack = Stack(block.mean(axis=0), weights.shape[1])
    stack.add(block, weights)
    return stack.moments()


def bootstrap_moments(rows: DataFrame, key: str, width: int, replicates: int = REPLICATES,
                      seed: int = 42) -> list[S.Moments]:
    """Weighted moments per replicate from rows (key, y, x): one scan."""
    def accumulate(batches):
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            z = np.column_stack([list_matrix(batch.column(2), width), targets(batch.column(1))])
            if total is None:
                total = Stack(z.mean(axis=0), replicates)
            for at in range(0, len(z), CHUNK):
                total.add(z[at:at + CHUNK], weights_of(batch.column(0).slice(at, CHUNK), replicates))
        if total is not None:
            yield pack_moments({str(b): m for b, m in enumerate(total.moments())}, "g")

    drawn_rows = rows.select(draw_bits(seed, F.col(key), replicates).alias("bits"), "y", "x")
    merged = merge_moments(drawn_rows.mapInArrow(accumulate, matrix_schema("g")), width + 1, "g")
    found = {int(r["g"]): S.Moments.unpack(np.array(r["m"]), width + 1) for r in merged.collect()}
    return [found[b] for b in sorted(found)]


@dataclass
class Refits:
    """A model fitted to all rows and to each replicate; ``score`` adds ``y_pred`` and the array ``each``."""
    point: object
    width: int
    fits: list[S.LinearFit] | None = None
    kernel: object = None
    models: list | None = None

    def __len__(self):
        return len(self.fits or self.models)

    def score(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """Columns ``keep``, ``y_pred``, ``each`` of rows with array ``x``."""
        if self.models is not None:
            out = self.point.predict(rows.withColumn("y", F.col("y") if "y" in rows.columns else F.lit(0.0)))
            names = [f"__{b}" for b in range(len(self.models))]
            for model, name in zip(self.models, names):
                out = predict_tree(model, out, name)
            return out.select(*keep, "y_pred", F.array(*names).alias("each"))
        mapped = rows if self.kernel is None else self.kernel.apply(rows, keep)
        coef = np.column_stack([f.coef for f in [self.point.linear, *self.fits]])
        lead = np.array([f.intercept for f in [self.point.linear, *self.fits]])
        source = mapped.select(*keep, "x")
        schema = T.StructType([*source.drop("x").schema, T.StructField("y_pred", T.DoubleType()),
                               T.StructField("each", T.ArrayType(T.DoubleType()))])

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at, CHUNK)
                    z = list_matrix(part.column(len(keep)), len(coef)) @ coef + lead
                    each = pa.ListArray.from_arrays(pa.array(np.arange(0, z[:, 1:].size + 1, len(self), dtype=np.int32)),
                                                    pa.array(z[:, 1:].ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(z[:, 0]), each],
                                                     names=schema.names)
        return source.mapInArrow(run, schema)


def predict_tree(model, rows: DataFrame, name: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return model.transform(rows.withColumn("features", array_to_vector("x"))).drop("features").withColumnRenamed("prediction", name)


def refit(trainer, candidate, rows: DataFrame, key: str, replicates: int | None = None, seed: int = 42) -> Refits:
    """Fit a candidate to every replicate of rows (key, y, x); ``trainer`` holds the same rows.

    Trees take ``TREE_REPLICATES`` fits of MLlib, a few at one time; all others one scan of the rows.
    """
    point = trainer.refit(candidate)
    if candidate.kind in ("forest", "boosted"):
        def one(b):
            from curvecal.operators.ensembles import fit_trees

            drawn_rows = rows.select("y", "x", weight_column(seed, F.col(key), b).alias("w")).where("w > 0")
            return fit_trees(candidate.estimator().setWeightCol("w"), drawn_rows)

        with ThreadPoolExecutor(TREE_FITS) as pool:
            models = list(pool.map(one, range(replicates or TREE_REPLICATES)))
        return Refits(point, trainer.width, models=models)
    mapped, width = rows, trainer.width
    if point.kernel is not None:
        mapped, width = point.kernel.apply(rows, [key, "y"]), len(point.linear.coef)
    moments = bootstrap_moments(mapped, key, width, replicates or REPLICATES, seed)
    return Refits(point, width, [candidate.fit(m) for m in moments], point.kernel)


def residual_table(refits: Refits, rows: DataFrame, key: str, seed: int = 42, size: int = RESIDUALS) -> list[float]:
    """Order statistics of the rows' errors under the refits that did not see them.

    A row that every replicate drew has no such error and is left out. The i-th entry is the residual
    of rank floor((2 i + 1) n / (2 size)) of n; ``size`` numbers reach the driver.
    """
    count = len(refits)
    scored = refits.score(rows.select(draw_bits(seed, F.col(key), count).alias("bits"), "y", "x"), ["bits", "y"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                unseen = weights_of(part.column(0), count) == 0
                seen_by = unseen.sum(axis=1)
                ok = seen_by > 0
                means = (list_matrix(part.column(2), count) * unseen).sum(axis=1)[ok] / seen_by[ok]
                yield pa.RecordBatch.from_arrays([pa.array(targets(part.column(1))[ok] - means)], names=["e"])

    errors = scored.select("bits", "y", "each").mapInArrow(run, "e double")
    runs = running_counts(errors, "e")
    n, last = F.col("all_n"), F.col("cum_n")
    first = last - F.col("n")

    def upto(rank):  # how many of the wanted ranks lie below
        return F.expr(f"(2 * {size} * ({rank}) + all_n - 1) DIV (2 * all_n)")

    found = runs.select("e", upto("cum_n - n").alias("a"), (upto("cum_n") - 1).alias("b")).where("a <= b AND a < " + str(size)).select(
        "e", F.explode(F.sequence("a", F.least("b", F.lit(size - 1)))).alias("i"))
    return [r["e"] for r in found.orderBy("i").collect()]


def band(values: np.ndarray, level: float) -> np.ndarray:
    """Lower and upper quantile of each row by mid-positions: the k-th of n values stands at (k - 1/2) / n."""
    return np.quantile(values, [(1 - level) / 2, (1 + level) / 2], axis=1, method="hazen")


def stride(count: int) -> int:
    """A step that visits every one of ``count`` places, far from its neighbours."""
    step = max(1, round(0.618 * count))
    while math.gcd(step, count) > 1:
        step += 1
    return step


def prediction_band(refits: Refits, residuals: list[float], rows: DataFrame, key: str, keep: list[str], level: float = LEVEL,
                    seed: int = 42) -> DataFrame:
    """Prediction and band for single observations: each refit's value plus a residual drawn for it.

    The draws of one row are stratified: every replicate takes another part of the residuals' order,
    at a place the row's own hash shifts. Rows without residual statistics get the spread of the refits.
    """
    count, table = len(refits), np.array(residuals or [0.0])
    bits = F.unhex(hashed(seed, F.col(key), "draw")).alias("bits")
    scored = refits.score(rows.select(*keep, bits, *(["y"] if "y" in rows.columns and "y" not in keep else []), "x"), [*keep, "bits"])
    schema = T.StructType([*scored.drop("bits", "each").schema, T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])
    turn = np.arange(count) * stride(count)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                raw = np.frombuffer(b"".join(part.column("bits").to_pylist()), ">u2").reshape(-1, 8).astype(np.int64)
                stratum = (turn + raw[:, 1:2]) % count
                place = (stratum * 65536 + raw[:, :1]) * len(table) // (count * 65536)
                low, high = band(list_matrix(part.column("each"), count) + table[place], level)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in schema.names[:-2]), pa.array(low), pa.array(high)],
                                                 names=schema.names)
    return scored.mapInArrow(run, schema)


def mean_band(refits: Refits, rows: DataFrame, keep: list[str], level: float = LEVEL) -> DataFrame:
    """Prediction and percentile band of the refits: where the mean response may lie."""
    scored = refits.score(rows, keep)
    schema = T.StructType([*scored.drop("each").schema, T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                low, high = band(list_matrix(batch.column("each"), len(refits)), level)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-2]), pa.array(low), pa.array(high)],
                                                 names=schema.names)
    return scored.mapInArrow(run, schema)


def coverage(banded: DataFrame, y: str, by: list[str] = ()) -> DataFrame:
    """Share of observations inside their bands."""
    inside = (F.col(y) >= F.col("lower")) & (F.col(y) <= F.col("upper"))
    return banded.where(F.col(y).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(inside) / F.count(F.lit(1))).alias("coverage"),
        F.avg(F.col("upper") - F.col("lower")).alias("width"))
