"""Threshold decisions, ROC, intervals and residual tables over a prediction set."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvecal.constants import HIST_BINS, INTERVAL_SPREAD, INTERVAL_Z, THRESHOLD_PPB
from curvecal.operators.metrics import complete, mae, r2, rmse, y_pred, y_true
from curvecal.operators.ranking import exact_quantiles, running_counts
from curvecal.session import attach, join_groups


def cells(threshold: float = THRESHOLD_PPB) -> dict[str, Column]:
    """Four cells of the complete pairs, and the rows that lack a target or a prediction."""
    known = complete()
    true_high, pred_high = y_true() > threshold, y_pred() > threshold
    return {
        "tp": F.count_if(known & true_high & pred_high), "tn": F.count_if(known & ~true_high & ~pred_high),
        "fp": F.count_if(known & ~true_high & pred_high), "fn": F.count_if(known & true_high & ~pred_high),
        "undefined": F.count_if(~known),
    }


def ratios(df: DataFrame) -> DataFrame:
    def share(num, den):
        return F.coalesce(F.try_divide(num, den), F.lit(0.0))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    p, s = F.col("precision"), F.col("sensitivity")
    return (df.withColumn("sensitivity", share(tp, tp + fn)).withColumn("specificity", share(tn, tn + fp))
            .withColumn("precision", share(tp, tp + fp)).withColumn("f1", share(2 * p * s, p + s)))


def decision_metrics(df: DataFrame, by: list[str] = (), threshold: float = THRESHOLD_PPB) -> DataFrame:
    return ratios(df.groupBy(*by).agg(*[c.alias(n) for n, c in cells(threshold).items()]))


def confusion(df: DataFrame, by: list[str] = (), threshold: float = THRESHOLD_PPB) -> DataFrame:
    """Four cells per group, zeros included."""
    counts = df.groupBy(*by).agg(*[c.alias(n) for n, c in cells(threshold).items()])
    cell = F.inline(F.array(*[
        F.struct(F.lit(t).alias("true_high"), F.lit(p).alias("pred_high"), F.col(n).alias("n"))
        for t, p, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))]))
    return counts.select(*by, cell)


def score_runs(df: DataFrame, by: list[str], threshold: float) -> DataFrame:
    high = F.when(y_true() > threshold, 1).otherwise(0)
    return running_counts(df, "y_pred", by, {"pos": high})


def roc_points(df: DataFrame, by: list[str] = (), threshold: float = THRESHOLD_PPB) -> DataFrame:
    """One point per distinct score, counted at or above it; rates are null for one class."""
    runs = score_runs(df, by, threshold)
    tp = F.col("all_pos") - F.col("cum_pos") + F.col("pos")
    fp = (F.col("all_n") - F.col("all_pos")) - (F.col("cum_n") - F.col("cum_pos")) + (F.col("n") - F.col("pos"))
    return runs.select(
        *by, F.col("y_pred").alias("score"), tp.alias("tp"), fp.alias("fp"),
        F.try_divide(tp.cast("double"), F.col("all_pos")).alias("tpr"),
        F.try_divide(fp.cast("double"), F.col("all_n") - F.col("all_pos")).alias("fpr"))


def roc_auc(df: DataFrame, by: list[str] = (), threshold: float = THRESHOLD_PPB) -> DataFrame:
    """Share of (high, low) pairs ranked rightly, ties counting half; null for one class."""
    runs = score_runs(df, by, threshold)
    neg = F.col("n") - F.col("pos")
    neg_below = (F.col("cum_n") - F.col("cum_pos")) - neg
    won = F.sum(F.col("pos").cast("double") * (neg_below + neg / 2.0))
    pos_all, neg_all = F.max("all_pos").cast("double"), F.max(F.col("all_n") - F.col("all_pos")).cast("double")
    return runs.groupBy(*by).agg(F.try_divide(won, pos_all * neg_all).alias("roc_auc"))


def per_group(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates to rows without shuffling them when groups are few."""
    stats = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
    if not by:
        row = stats.first()
        return df.withColumns({n: F.lit(row[n]) for n in aggs})
    return attach(df, stats, list(by))


def prediction_interval(df: DataFrame, by: list[str] = (), z: float = INTERVAL_Z,
                        spread: float = INTERVAL_SPREAD) -> DataFrame:
    """Constant-width band from the spread of the predictions."""
    half = F.lit(z) * F.lit(spread) * F.col("pred_std")
    return (per_group(df, list(by), pred_std=F.stddev_pop("y_pred"))
            .withColumn("lower", y_pred() - half).withColumn("upper", y_pred() + half))


def residual_profile(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Residual, its population deviation, and whether it lies within two RMSE."""
    out = per_group(df, list(by), residual_std=F.stddev_pop(y_pred() - y_true()), rmse=rmse())
    return (out.withColumn("residual", y_pred() - y_true())
            .withColumn("within_band", (F.abs(y_pred() - y_true()) <= 2 * F.col("rmse")).cast("int")))


def error_hist(df: DataFrame, by: list[str] = (), bins: int = HIST_BINS) -> DataFrame:
    """Equal-width histogram of absolute errors between their extremes; last bin closed."""
    by = list(by)
    err = df.select(*by, F.abs(y_pred() - y_true()).alias("err"))
    out = per_group(err, by, err_min=F.min("err"), err_max=F.max("err"))
    step = (F.col("err_max") - F.col("err_min")) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col("err") - F.col("err_min"), step)), F.lit(0))
    return (out.withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
            .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.min("err_min").alias("err_min"),
                                     F.max("err_max").alias("err_max"))
            .select(*by, "bin", (F.col("err_min") + F.col("bin") * step).alias("bin_low"), "n"))


def error_centre(df: DataFrame, by: list[str]) -> DataFrame:
    """Exact median and mean of the absolute errors."""
    by = list(by)
    err = df.select(*by, F.abs(y_pred() - y_true()).alias("err"))
    means = err.groupBy(*by).agg(F.avg("err").alias("mean"))
    median = exact_quantiles(err, "err", [0.5], by).select(*by, F.col("q0").alias("median"))
    return join_groups(means, median, by, "left").select(*by, "median", "mean")


def pred_obs_limits(df: DataFrame, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.least(F.min("y_true"), F.min("y_pred")).alias("low"),
        F.greatest(F.max("y_true"), F.max("y_pred")).alias("high"))


def model_summary(df: DataFrame, by: list[str] = ("model",), threshold: float = THRESHOLD_PPB) -> DataFrame:
    """One row per model: errors, decision ratios and AUC."""
    by = list(by)
    base = ratios(df.groupBy(*by).agg(
        F.count_if(complete()).alias("n"), rmse().alias("rmse"), mae().alias("mae"), r2().alias("r2"),
        *[c.alias(n) for n, c in cells(threshold).items()]))
    return join_groups(base, roc_auc(df, by, threshold), by, "left")
