"""Nonlinear regressors: kernel features on the shared moments, and MLlib trees."""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvecal.constants import BOOST, FOREST, SEED
from curvecal.functions import solvers as S
from curvecal.functions.features import list_matrix
from curvecal.session import ensure_checkpoint_dir


LANDMARKS = 96
CANDIDATES = 1024  # rows that landmarks are chosen from


def mapped(rows: DataFrame, keep: list[str], width: int, block) -> DataFrame:
    """Rows (keep, x) with ``x`` replaced by ``block`` of its matrix, one matrix per batch."""
    source = rows.select(*keep, "x")

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            z = block(list_matrix(batch.column(len(keep)), width))
            cells = pa.ListArray.from_arrays(
                pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [cells], names=list(keep) + ["x"])
    return source.mapInArrow(run, source.schema)


@dataclass
class FourierMap:
    """Seeded random cosine features approximating the kernel exp(-gamma d^2)."""
    weights: np.ndarray
    phase: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def apply(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        amp = math.sqrt(2.0 / len(self.phase))
        unit = self.weights / self.scale[:, None]
        start = self.phase - self.mean @ unit
        return mapped(rows, keep, len(self.mean), lambda x: np.cos(x @ unit + start) * amp)


def gaussian(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma d^2) of every row of ``a`` with every row of ``b``."""
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * a @ b.T
    return np.exp(-gamma * np.maximum(d2, 0.0))


@dataclass
class LandmarkMap:
    """Features whose products are the kernel exp(-gamma d^2), seen through some landmark rows (Nystroem).

    Products of two landmarks are exact. A row's squared length falls short of 1 by the part of it that
    no mix of landmarks reaches, which is what ``kernel_error`` averages.
    """
    landmarks: np.ndarray  # standardised
    gamma: float
    mean: np.ndarray
    scale: np.ndarray

    def __post_init__(self):
        values, vectors = np.linalg.eigh(gaussian(self.landmarks, self.landmarks, self.gamma))
        keep = values > S.EIGEN_CUT * max(values.max(initial=0.0), 0.0)
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    @property
    def size(self) -> int:
        return self.root.shape[1]

    def block(self, x: np.ndarray) -> np.ndarray:
        return gaussian((x - self.mean) / self.scale, self.landmarks, self.gamma) @ self.root

    def apply(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        return mapped(rows, keep, len(self.mean), self.block)


def kernel_width(mom: S.Moments, gamma) -> float:
    """'scale' = 1 / (p * variance over all standardised cells)."""
    if gamma != "scale":
        return float(gamma)
    sxx, _, _ = mom.centred()
    scale = S.population_scale(mom)
    cells = np.diag(sxx) / mom.n / scale ** 2
    whole = cells.mean()
    return 1.0 / (len(cells) * whole) if whole > 0 else 1.0


def fourier_map(mom: S.Moments, gamma="scale", size: int = 48, seed: int = SEED) -> FourierMap:
    rng = np.random.default_rng(seed)
    p = len(mom.mean) - 1
    width = kernel_width(mom, gamma)
    return FourierMap(rng.normal(0.0, math.sqrt(2.0 * width), (p, size)),
                      rng.uniform(0.0, 2.0 * math.pi, size), mom.mean[:-1], S.population_scale(mom))


def candidates(rows: DataFrame, count: int = CANDIDATES) -> np.ndarray:
    """Different rows ``x`` with the smallest hashes: an even choice that depends on the rows alone."""
    picked = rows.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(count).toArrow().column("x").combine_chunks()
    return picked.flatten().to_numpy(zero_copy_only=False).reshape(len(picked), -1).astype(float)


def leverage(kernel: np.ndarray, size: int) -> np.ndarray:
    """Ridge leverage of each row in its kernel matrix, at the penalty that leaves ``size`` degrees of freedom."""
    values, vectors = np.linalg.eigh(kernel)
    values = np.maximum(values, 0.0)
    low, high = 1e-12, max(float(values.sum()), 1.0)
    for _ in range(60):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if (values / (values + middle)).sum() > size else (low, middle)
    return (vectors ** 2) @ (values / (values + high))


def landmark_map(pool: np.ndarray, mom: S.Moments, gamma="scale", size: int = LANDMARKS, seed: int = SEED) -> LandmarkMap:
    """Map over ``size`` rows of the pool, drawn without return in proportion to their leverage."""
    mean, scale = mom.mean[:-1], S.population_scale(mom)
    unit, width = (pool - mean) / scale, kernel_width(mom, gamma)
    weight = np.maximum(leverage(gaussian(unit, unit, width), min(size, len(unit))), 1e-12)
    arrival = np.random.default_rng(seed).exponential(size=len(unit)) / weight
    return LandmarkMap(unit[np.sort(np.argsort(arrival, kind="stable")[:size])], width, mean, scale)


def kernel_error(kernel: LandmarkMap, rows: DataFrame) -> float:
    """Mean of what the map misses of the rows' own kernel value 1; bounds its mean error on any pair."""
    z = kernel.apply(rows, [])
    return float(z.agg(F.avg(1.0 - F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()[0])


def rbf_alpha(c: float) -> float:
    """Ridge penalty standing for cost ``c``."""
    return 1.0 / (2.0 * c)


def vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector("x")).withColumnRenamed("y", "label")


def forest(trees=FOREST["trees"], depth=FOREST["depth"], min_leaf=FOREST["min_leaf"], seed=SEED):
    """Random forest; depth None grows to the MLlib limit of 30."""
    return RandomForestRegressor(
        numTrees=trees, maxDepth=30 if depth is None else depth, minInstancesPerNode=min_leaf,
        featureSubsetStrategy="all", seed=seed, maxMemoryInMB=1024)


def boosted(rounds=BOOST["rounds"], depth=BOOST["depth"], rate=BOOST["rate"],
            subsample=BOOST["subsample"], colsample=BOOST["colsample"], seed=SEED):
    """Gradient boosting. Column sampling is drawn per node and leaves carry no L2 term."""
    return GBTRegressor(
        maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample,
        featureSubsetStrategy="all" if colsample >= 1.0 else str(colsample), seed=seed,
        maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10)


def fit_trees(estimator, rows: DataFrame):
    """Fit on rows (y, x); boosting checkpoints its running predictions every ten rounds."""
    ensure_checkpoint_dir(rows.sparkSession)
    return estimator.fit(vectors(rows))


def predict_trees(model, rows: DataFrame) -> DataFrame:
    out = model.transform(vectors(rows))
    return out.withColumnRenamed("prediction", "y_pred").withColumnRenamed("label", "y").drop("features")
