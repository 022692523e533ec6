"""User-level jobs: from curves or feature rows to model comparison and decision tables.

Each study returns named DataFrames. Training data is read a fixed number of times:
split fitting, one moment pass, one scoring pass, plus whatever trees need.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvecal import constants as C
from curvecal.functions import solvers as S
from curvecal.functions.features import extract, extract_windows, with_flags
from curvecal.operators import latent, metrics, selection, strata
from curvecal.operators.baseline import baseline_subtract
from curvecal.operators.decision import model_summary
from curvecal.operators.gram import add, design, gram_by_group
from curvecal.operators.grids import grid_check, grid_fill, reference_grid
from curvecal.operators.linear import cv_summary, predict_column
from curvecal.operators.relational import feature_select
from curvecal.session import materialize
from curvecal.sources import scans
from curvecal.sources.tables import require

KEYS = ["sample_id", "dataset"]


@dataclass
class Prepared:
    """Design rows with their split; ``train`` has (g, y, x), ``hold`` (sample_id, y, x)."""
    split: strata.Split
    assigned: DataFrame
    width: int

    @property
    def train(self):
        return (self.assigned.where(F.col("part") == "train")
                .select(F.col("fold").cast("string").alias("g"), "y", "x"))

    @property
    def hold(self):
        return self.assigned.where(F.col("part") == "hold").select("sample_id", "y", "x")


def prepare(df: DataFrame, features: list[str] | str, width: int, y: str = C.TARGET) -> Prepared:
    rows = materialize(design(df, features, y, KEYS), "design")  # what makes df runs once
    split = strata.fit_split(rows, "y")
    return Prepared(split, split.assign(rows), width)


def feature_table(curves: DataFrame, grid: list[float], low=C.ROI_LOW_V, high=C.ROI_HIGH_V,
                  window=C.SMOOTH_WINDOW) -> DataFrame:
    """Baseline, features and flags, written once: the studies read it several times."""
    meta = KEYS + [C.TARGET]
    shapes = with_flags(extract(baseline_subtract(curves, grid), meta, grid, low, high, window), meta)
    return materialize(shapes, "features")


def curves_from_scans(spark, folders: dict[str, str], pattern: str = "*") -> tuple[DataFrame, list[float]]:
    """Curves of scan folders (dataset name -> folder) on one grid, and that grid.

    Raises if a scan's potentials differ from those of the first. The sample name holds the
    path below the folder, so that scans of one name in different folders stay apart.
    """
    parts = None
    for dataset, folder in folders.items():
        below = F.url_decode(F.expr(f"element_at(split(scan, {folder.rstrip('/').rpartition('/')[2]!r} || '/', 2), 2)"))
        curves = scans.replicates_to_curves(scans.read_traces(spark, folder, pattern)).withColumns({
            "dataset": F.lit(dataset), "sample_id": F.concat(F.lit(f"{dataset}:"), below, F.lit("#"), F.col("replicate").cast("string"))})
        parts = curves if parts is None else parts.unionByName(curves)
    curves = materialize(require(parts, ["pot", "cur", C.TARGET]), "scan-curves")
    grid_check(curves, strict=True)
    grid = reference_grid(curves)
    return grid_fill(curves, grid), grid


def study_from_scans(spark, folders: dict[str, str], pattern: str = "*") -> dict[str, DataFrame]:
    """Scan files to baseline comparison in one job."""
    curves, grid = curves_from_scans(spark, folders, pattern)
    return study_baselines(feature_table(curves, grid), baseline_subtract(curves, grid), grid)


def as_predictions(rows: DataFrame, model: str) -> DataFrame:
    return rows.select("sample_id", F.lit(model).alias("model"), F.col("y").alias("y_true"), "y_pred")


def holdout_tables(predictions: DataFrame, robust: bool) -> dict[str, DataFrame]:
    """Error tables of held-out predictions; ``robust`` drops the outlier label first."""
    kept = metrics.without_outliers(predictions) if robust else predictions
    return {
        "holdout": metrics.reg_metrics(kept, ["model"]),
        "removed": metrics.outlier_counts(predictions, ["model"]),
        "buckets": metrics.bucket_stats(kept, ["model"]),
        "ranges": metrics.range_errors(kept, ["model"]),
        "samples": metrics.per_sample_errors(kept, ["model", "sample_id"]),
        "predictions": kept,
    }


def choose_and_test(data: Prepared, zoo, grids, robust: bool, label: str | None = None):
    """Cross-validate, tune the winner, refit, and predict the holdout once."""
    trainer = selection.Trainer(data.train, data.width)
    winner, best, scores = trainer.choose(zoo, grids)
    held = trainer.refit(best).predict(data.hold)
    spark = held.sparkSession
    folds = selection.score_table(spark, scores)
    tables = holdout_tables(as_predictions(held, label or best.label()), robust)
    tables["folds"] = folds
    tables["cv"] = cv_summary(folds).withColumn("chosen", (F.col("model") == best.label()).cast("int"))
    tables["split"] = strata.split_report(data.assigned)
    return trainer, winner, best, tables


def study_features(features: DataFrame, columns: list[str] | None = None, robust: bool = False,
                   zoo=None, grids=selection.GRIDS, label: str | None = None) -> dict[str, DataFrame]:
    """Feature models: zoo, winner, grid, holdout."""
    columns = sorted(columns or feature_select(features))
    data = prepare(features, columns, len(columns))
    return choose_and_test(data, zoo or selection.feature_zoo(), grids, robust, label)[-1]


def study_spectrum(curves: DataFrame, grid: list[float], robust: bool = False, zoo=None,
                   grids=selection.GRIDS, label: str | None = None) -> dict[str, DataFrame]:
    """Whole-curve models: component correlations, PCR, PCR with penalty, PLS."""
    data = prepare(curves, "cur", len(grid))
    trainer, _, _, tables = choose_and_test(data, zoo or selection.spectrum_zoo(), grids, robust, label)
    pc = S.principal_components(trainer.whole, 3)
    tables["correlation"] = latent.component_correlation(curves.sparkSession, trainer.whole, pc)
    return tables


def study_baselines(features: DataFrame, curves: DataFrame, grid: list[float]) -> dict[str, DataFrame]:
    """Least squares on one feature, two features and all potentials, on one split."""
    both = features.select(*KEYS, C.TARGET, "Ip_corr", "Area_peak").join(
        curves.select("sample_id", "cur"), "sample_id")
    x = F.concat(F.array("Ip_corr", "Area_peak"), F.col("cur"))
    data = prepare(both.withColumn("all_x", x), "all_x", 2 + len(grid))
    whole = add(gram_by_group(data.train, data.width).values())
    members = {"Ip_corr": [0], "Ip_corr+Area_peak": [0, 1], "potentials": list(range(2, 2 + len(grid)))}
    guesses = []
    for name, picks in members.items():
        fit = S.ols(whole.pick(picks), name)
        wide = S.LinearFit(name, fit.intercept, spread(fit.coef, picks, data.width))
        guesses.append(F.struct(F.lit(name).alias("model"), predict_column(wide, "x").alias("y_pred")))
    held = data.hold.select("sample_id", F.col("y").alias("y_true"), F.inline(F.array(*guesses)))
    tables = holdout_tables(held.select("sample_id", "model", "y_true", "y_pred"), robust=True)
    tables["split"] = strata.split_report(data.assigned)
    return tables


def spread(coef: np.ndarray, picks: list[int], width: int) -> np.ndarray:
    """Coefficients put back at their places in the full design."""
    out = np.zeros(width)
    out[picks] = coef
    return out


def study_roi(curves: DataFrame, grid: list[float], windows=C.ROI_WINDOWS) -> dict[str, DataFrame]:
    """Lasso per potential window: one extraction pass, one moment pass for all windows."""
    meta = KEYS + [C.TARGET]
    shapes = with_flags(extract_windows(baseline_subtract(curves, grid), meta, grid, windows),
                        ["roi"] + meta)
    table = materialize(shapes, "roi-features")
    columns = sorted(feature_select(table, C.NOT_FEATURES))
    first = next(iter(windows))
    split = strata.fit_holdout(
        design(table.where(F.col("roi") == first), columns, C.TARGET, KEYS), "y")
    rows = split.assign(design(table, columns, C.TARGET, KEYS + ["roi"]))
    train = rows.where(F.col("part") == "train").select(F.col("roi").alias("g"), "y", "x")
    fits = {roi: S.lasso(m, C.LASSO_ALPHA) for roi, m in gram_by_group(train, len(columns)).items()}
    guess = F.lit(None).cast("double")
    for roi, fit in fits.items():
        guess = F.when(F.col("roi") == roi, predict_column(fit, "x")).otherwise(guess)
    held = rows.where(F.col("part") == "hold").select(
        "sample_id", F.col("roi").alias("model"), F.col("y").alias("y_true"), guess.alias("y_pred"))
    return holdout_tables(held, robust=True)


def study_decision(curves: DataFrame, features: DataFrame, grid: list[float],
                   feature_columns: list[str] | None = None, feature_zoo=None,
                   grids=selection.GRIDS) -> dict[str, DataFrame]:
    """Spectrum and feature pipelines side by side at the decision threshold."""
    a = study_spectrum(curves, grid, robust=True, grids=grids, label="spectrum")
    b = study_features(features, feature_columns, robust=True, zoo=feature_zoo, grids=grids, label="features")
    predictions = a["predictions"].unionByName(b["predictions"])
    return {"summary": model_summary(predictions), "predictions": predictions,
            "cv": a["cv"].unionByName(b["cv"])}


def study_pca(curves: DataFrame, grid: list[float], components: int = 5) -> dict[str, DataFrame]:
    """Exploratory components of all rows: scree, scores, loadings, link to the target."""
    spark = curves.sparkSession
    rows = design(curves, "cur", C.TARGET, KEYS).withColumn("g", F.lit("all"))
    whole = gram_by_group(rows, len(grid))["all"]
    pc = S.principal_components(whole, components)
    return {
        "scree": latent.pca_scree(latent.pca_variance(spark, pc)),
        "scores": latent.pca_scores(rows, pc, "x", KEYS + ["y"]),
        "loadings": latent.pca_loadings(spark, pc, grid),
        "correlation": latent.component_correlation(spark, whole, S.principal_components(whole, 1)),
    }
