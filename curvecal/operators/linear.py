"""Linear predictors as Column expressions and the evaluation of many fits in one pass."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvecal.functions import solvers as S
from curvecal.functions.features import list_matrix
from curvecal.operators.gram import add, groups_of, zero_filled


def predict_column(fit: S.LinearFit, features: list[str] | str) -> Column:
    """intercept + coef . x, missing features read as 0."""
    if isinstance(features, str):
        terms = [zero_filled(F.get(features, F.lit(j))) for j in range(len(fit.coef))]
    else:
        terms = [zero_filled(F.col(c)) for c in features]
    out = F.lit(float(fit.intercept))
    for w, term in zip(fit.coef, terms):
        if w != 0.0:
            out = out + F.lit(float(w)) * term
    return out


def coefficient_table(spark, fits: list[S.LinearFit], names: list[str]) -> DataFrame:
    rows = []
    for fit in fits:
        rows.append((fit.name, "intercept", float(fit.intercept)))
        rows += [(fit.name, n, float(w)) for n, w in zip(names, fit.coef)]
    return spark.createDataFrame(rows, "model string, term string, coef double")


def train_moments(per_fold: dict[str, S.Moments]) -> dict[str, S.Moments]:
    """Moments of the rows outside each fold."""
    whole = add(per_fold.values())
    return {f: whole - m for f, m in per_fold.items()}


def score_folds(rows: DataFrame, width: int, fits: dict[str, dict[str, S.LinearFit]],
                group: str = "g", y0: float = 0.0) -> DataFrame:
    """Error sums of every candidate on every fold: (model, group, n, sae, sse, sst).

    ``fits[model][fold]`` is applied to the rows of that fold. One scan evaluates all
    candidates as a matrix product per batch and emits one line per task, model, fold.
    ``y0``, any value near the mean target, keeps the total sum of squares precise.
    """
    names = list(fits)
    keys = sorted({g for per in fits.values() for g in per})
    coef = {g: np.column_stack([fits[m][g].coef for m in names]) for g in keys}
    lead = {g: np.array([fits[m][g].intercept for m in names]) for g in keys}
    out = f"model string, {group} string, n bigint, sae double, sse double, sy double, syy double"

    def run(batches):
        sums = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = list_matrix(batch.column(2), width)
            for g, index in groups_of(batch.column(0)):
                if g not in coef:
                    continue
                err = x[index] @ coef[g] + lead[g] - y[index, None]
                part = np.concatenate([
                    [len(index), (y[index] - y0).sum(), ((y[index] - y0) ** 2).sum()],
                    np.abs(err).sum(axis=0), (err ** 2).sum(axis=0)])
                sums[g] = sums.get(g, 0.0) + part
        c = len(names)
        cols = [[], [], [], [], [], [], []]
        for g, s in sums.items():
            for j, m in enumerate(names):
                for col, v in zip(cols, [m, g, int(s[0]), s[3 + j], s[3 + c + j], s[1], s[2]]):
                    col.append(v)
        kinds = [pa.string(), pa.string(), pa.int64()] + [pa.float64()] * 4
        if cols[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(cols, kinds)],
                names=["model", group, "n", "sae", "sse", "sy", "syy"])

    parts = rows.select(F.col(group).cast("string").alias(group), "y", "x").mapInArrow(run, out)
    return parts.groupBy("model", group).agg(
        F.sum("n").alias("n"), F.sum("sae").alias("sae"), F.sum("sse").alias("sse"),
        (F.sum("syy") - F.sum("sy") * F.sum("sy") / F.sum("n")).alias("sst"))


def fold_metrics(scored: DataFrame, group: str = "g") -> DataFrame:
    """Per-fold RMSE, MAE and R2 from error sums."""
    return scored.select(
        "model", F.col(group).cast("int").alias("fold"), "n",
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (F.col("sae") / F.col("n")).alias("mae"),
        (1 - F.try_divide(F.col("sse"), F.col("sst"))).alias("r2"))


def cv_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and population deviation over folds."""
    out = []
    for m in ("rmse", "mae", "r2"):
        out += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return per_fold.groupBy("model").agg(F.count(F.lit(1)).alias("folds"), *out)
