"""Registered queries: error tables, decisions, ROC, intervals over the prediction set."""

from pyspark.sql import functions as F

from curvecal.operators import decision, metrics
from curvecal.plans import sqltext as Q
from curvecal.plans.registry import query, r6
from curvecal.sources import adapters as AD

WITH = f"WITH {Q.SCORES}"
BY = ["model"]
RMSE = r6("sqrt(avg((y_pred - y_true) * (y_pred - y_true)))")
MAE = r6("avg(abs(y_pred - y_true))")
R2 = r6("1 - sum((y_pred - y_true) * (y_pred - y_true)) / (var_pop(y_true) * count(*))")
CLOSE = "CASE WHEN abs(y_pred - y_true) <= CAST(0.15 AS DOUBLE) * y_true THEN 1.0 ELSE 0.0 END"


@query("reg_metrics", WITH + f"""
SELECT model, count(*) AS n, {RMSE} AS rmse, {MAE} AS mae, {R2} AS r2 FROM s GROUP BY model""")
def reg_metrics(spark, folder):
    return metrics.reg_metrics(AD.scores(spark, folder), BY)


@query("coverage_pct", WITH + f"""
SELECT model, {r6(f'avg(CASE WHEN y_true > 0 THEN {CLOSE} END)')} AS coverage,
  count(*) FILTER (WHERE y_true > 0) AS n_used FROM s GROUP BY model""")
def coverage_pct(spark, folder):
    return metrics.coverage_pct(AD.scores(spark, folder), BY)


@query("bucket_stats", WITH + f""",
b AS (SELECT * FROM (VALUES ('0-5', 0.0, 5.0), ('5-10', 5.0, 10.0), ('10-15', 10.0, 15.0),
  ('15-25', 15.0, 25.0), ('>25', 25.0, CAST('inf' AS DOUBLE))) v(bucket, lo, hi))
SELECT m.model, b.bucket, count(s.y_true) AS n, {RMSE} AS rmse, {MAE} AS mae, {r6(f'avg(CASE WHEN y_true > 0 THEN {CLOSE} END)')} AS cov15,
  count(*) FILTER (WHERE y_true > 0) AS n_cov
FROM (SELECT DISTINCT model FROM s) m CROSS JOIN b
LEFT JOIN s ON s.model = m.model AND s.y_true > b.lo AND s.y_true <= b.hi GROUP BY m.model, b.bucket""")
def bucket_stats(spark, folder):
    return metrics.bucket_stats(AD.scores(spark, folder), BY)


@query("range_errors", WITH + f"""
SELECT model, CASE WHEN y_true <= 0 THEN 'zero' WHEN y_true <= 10 THEN 'low(0-10]' WHEN y_true <= 25
  THEN 'mid(10-25]' ELSE 'high(>25)' END AS range, count(*) AS n, {RMSE} AS rmse, {MAE} AS mae
FROM s GROUP BY ALL""")
def range_errors(spark, folder):
    return metrics.range_errors(AD.scores(spark, folder), BY)


@query("per_sample", WITH + f"""
SELECT model, sample_id, {r6('y_true')} AS y_true, {r6('y_pred')} AS y_pred FROM s ORDER BY y_true, model, sample_id""")
def per_sample(spark, folder):
    return metrics.per_sample(AD.scores(spark, folder), ["model", "sample_id"])


@query("per_sample_errors", WITH + f"""
SELECT model, sample_id, {r6('y_true')} AS y_true, {r6('y_pred')} AS y_pred, {r6('y_pred - y_true')} AS error,
  {r6('CASE WHEN y_true > 0 THEN (y_pred - y_true) / y_true * 100 END')} AS rel_error_pct FROM s""")
def per_sample_errors(spark, folder):
    return metrics.per_sample_errors(AD.scores(spark, folder), ["model", "sample_id"])


@query("rmse_delta", WITH + f"""
SELECT model, count(*) AS n, {RMSE} AS rmse, {MAE} AS mae, {R2} AS r2, CAST(3.873 AS DOUBLE) AS baseline_rmse,
  {r6('sqrt(avg((y_pred - y_true) * (y_pred - y_true))) - 3.873')} AS delta FROM s GROUP BY model""")
def rmse_delta(spark, folder):
    return metrics.rmse_delta(metrics.reg_metrics(AD.scores(spark, folder), BY), 3.873)


CELLS = """cells AS (SELECT model,
  count(*) FILTER (WHERE y_true > 15 AND y_pred > 15) AS tp, count(*) FILTER (WHERE y_true <= 15 AND y_pred <= 15) AS tn,
  count(*) FILTER (WHERE y_true <= 15 AND y_pred > 15) AS fp, count(*) FILTER (WHERE y_true > 15 AND y_pred <= 15) AS fn,
  count(*) FILTER (WHERE y_true IS NULL OR y_pred IS NULL) AS undefined FROM s GROUP BY model)"""
RATIOS = f"""{r6('coalesce(tp / nullif(tp + fn, 0), 0)')} AS sensitivity,
  {r6('coalesce(tn / nullif(tn + fp, 0), 0)')} AS specificity, {r6('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision,
  {r6('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1"""


@query("decision_metrics", WITH + f", {CELLS} SELECT model, tp, tn, fp, fn, undefined, {RATIOS} FROM cells")
def decision_metrics(spark, folder):
    return decision.decision_metrics(AD.scores(spark, folder), BY)


def with_holes(scores):
    """Some predictions missing (null or NaN), some models unnamed."""
    place = F.col("y_true") / 0.65
    return (scores.withColumn("y_pred", F.when(place % 7 < 0.5, F.lit(float("nan"))).when(place % 11 > 0.5, F.col("y_pred")))
            .withColumn("model", F.when(F.col("model") != "N", F.col("model"))))


HOLES = f"""WITH {Q.SCORES}, u AS (SELECT sample_id, CASE WHEN model <> 'N' THEN model END AS model, y_true,
  CASE WHEN fmod(y_true / 0.65, 7) < 0.5 THEN NULL WHEN fmod(y_true / 0.65, 11) > 0.5 THEN y_pred END AS y_pred FROM s),
k AS (SELECT * FROM u WHERE y_pred IS NOT NULL)"""


@query("reg_metrics_holes", HOLES + f" SELECT model, count(*) AS n, {RMSE} AS rmse, {MAE} AS mae, {R2} AS r2 FROM k GROUP BY model")
def reg_metrics_holes(spark, folder):
    """Missing predictions leave all terms; a null model is a group."""
    return metrics.reg_metrics(with_holes(AD.scores(spark, folder)), BY)


@query("decision_metrics_holes", HOLES + f", {CELLS.replace('FROM s', 'FROM u')} SELECT model, tp, tn, fp, fn, undefined, {RATIOS} FROM cells")
def decision_metrics_holes(spark, folder):
    return decision.decision_metrics(with_holes(AD.scores(spark, folder)), BY)


@query("interval_null_group", HOLES + f"""
SELECT model, sample_id, {r6('y_pred')} AS y_pred,
  {r6('y_pred - 1.96 * 0.2 * stddev_pop(y_pred) OVER (PARTITION BY model)')} AS lower,
  {r6('y_pred + 1.96 * 0.2 * stddev_pop(y_pred) OVER (PARTITION BY model)')} AS upper FROM k""")
def interval_null_group(spark, folder):
    rows = with_holes(AD.scores(spark, folder)).where("NOT isnan(y_pred) AND y_pred IS NOT NULL")
    return decision.prediction_interval(rows, BY).select("model", "sample_id", "y_pred", "lower", "upper")


@query("confusion", WITH + f""", {CELLS}
SELECT model, 0 AS true_high, 0 AS pred_high, tn AS n FROM cells UNION ALL SELECT model, 0, 1, fp FROM cells
UNION ALL SELECT model, 1, 0, fn FROM cells UNION ALL SELECT model, 1, 1, tp FROM cells""")
def confusion(spark, folder):
    return decision.confusion(AD.scores(spark, folder), BY)


# Scores that agree to nine digits are one score in both engines.
STEPS = """
p AS (SELECT model, round(y_pred, 9) AS score, sum(CASE WHEN y_true > 15 THEN 1 ELSE 0 END)::BIGINT AS pos,
  sum(CASE WHEN y_true > 15 THEN 0 ELSE 1 END)::BIGINT AS neg FROM s GROUP BY ALL),
roc AS (SELECT model, score, pos, neg,
  CAST(sum(pos) OVER d AS BIGINT) AS tp, CAST(sum(neg) OVER d AS BIGINT) AS fp,
  sum(pos) OVER m AS pa, sum(neg) OVER m AS na FROM p
  WINDOW d AS (PARTITION BY model ORDER BY score DESC), m AS (PARTITION BY model))"""
AUC = f"""auc AS (SELECT model, {r6('sum(pos * ((na - fp) + neg / 2.0)) / max(pa) / max(na)')} AS roc_auc
  FROM roc GROUP BY model)"""


def scored(spark, folder):
    return AD.scores(spark, folder).withColumn("y_pred", F.round("y_pred", 9))


@query("roc_points", WITH + f""", {STEPS}
SELECT model, {r6('score')} AS score, tp, fp, {r6('CAST(tp AS DOUBLE) / pa')} AS tpr,
  {r6('CAST(fp AS DOUBLE) / na')} AS fpr FROM roc""")
def roc_points(spark, folder):
    return decision.roc_points(scored(spark, folder), BY)


@query("roc_auc", WITH + f", {STEPS}, {AUC} SELECT model, roc_auc FROM auc")
def roc_auc(spark, folder):
    return decision.roc_auc(scored(spark, folder), BY)


@query("prediction_interval", WITH + f"""
SELECT model, sample_id, {r6('y_pred')} AS y_pred,
  {r6('y_pred - 1.96 * 0.2 * stddev_pop(y_pred) OVER (PARTITION BY model)')} AS lower,
  {r6('y_pred + 1.96 * 0.2 * stddev_pop(y_pred) OVER (PARTITION BY model)')} AS upper FROM s""")
def prediction_interval(spark, folder):
    return decision.prediction_interval(AD.scores(spark, folder), BY).select(
        "model", "sample_id", "y_pred", "lower", "upper")


@query("residual_profile", WITH + f""",
a AS (SELECT model, stddev_pop(y_pred - y_true) AS sd, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rm
  FROM s GROUP BY model)
SELECT model, sample_id, {r6('y_pred - y_true')} AS residual, {r6('sd')} AS residual_std,
  CASE WHEN abs(y_pred - y_true) <= 2 * rm THEN 1 ELSE 0 END AS within_band FROM s JOIN a USING (model)""")
def residual_profile(spark, folder):
    return decision.residual_profile(AD.scores(spark, folder), BY).select(
        "model", "sample_id", "residual", "residual_std", "within_band")


@query("error_hist", WITH + f""",
e AS (SELECT model, abs(y_pred - y_true) AS err, min(abs(y_pred - y_true)) OVER m AS lo,
  max(abs(y_pred - y_true)) OVER m AS hi FROM s WINDOW m AS (PARTITION BY model)),
h AS (SELECT model, lo, hi, least(CAST(floor((err - lo) / ((hi - lo) / 15)) AS INT), 14) AS bin FROM e)
SELECT model, bin, {r6('max(lo) + bin * ((max(hi) - max(lo)) / 15)')} AS bin_low, count(*) AS n FROM h GROUP BY model, bin""")
def error_hist(spark, folder):
    return decision.error_hist(AD.scores(spark, folder), BY)


@query("error_centre", WITH + f"""
SELECT model, {r6('median(abs(y_pred - y_true))')} AS median, {MAE} AS mean FROM s GROUP BY model""")
def error_centre(spark, folder):
    return decision.error_centre(AD.scores(spark, folder), BY)


@query("pred_obs_limits", WITH + f"""
SELECT model, {r6('least(min(y_true), min(y_pred))')} AS low, {r6('greatest(max(y_true), max(y_pred))')} AS high
FROM s GROUP BY model""")
def pred_obs_limits(spark, folder):
    return decision.pred_obs_limits(AD.scores(spark, folder), BY)


@query("model_summary", WITH + f""", {CELLS}, {STEPS}, {AUC},
m AS (SELECT model, count(*) AS n, {RMSE} AS rmse, {MAE} AS mae, {R2} AS r2 FROM s GROUP BY model)
SELECT model, n, rmse, mae, r2, tp, tn, fp, fn, undefined, {RATIOS}, roc_auc FROM m JOIN cells USING (model) JOIN auc USING (model)""")
def model_summary(spark, folder):
    return decision.model_summary(scored(spark, folder), BY)
