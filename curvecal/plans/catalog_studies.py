"""Registered queries: composite studies and streams."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvecal.constants import FEATURES, THRESHOLD_PPB
from curvecal.functions import solvers as S
from curvecal.functions.features import extract
from curvecal.operators import gram
from curvecal.operators.baseline import baseline_subtract
from curvecal.plans import sqltext as Q
from curvecal.plans import studies
from curvecal.plans.registry import query, r6
from curvecal.session import materialize, new_path
from curvecal.sources import adapters as AD
from curvecal.sources import scans
from curvecal.streaming import scoring

GRID = AD.GRID
PER_SCAN = 50
FOURTEEN = sorted(name for name in FEATURES if name != "FWHM")


def moved(spark, folder):
    return baseline_subtract(AD.curves(spark, folder), GRID)


def table(spark, folder):
    return studies.feature_table(AD.curves(spark, folder), GRID)


ERRORS = (f"count(*) AS n, {r6('sqrt(avg(pow(p - y, 2)))')} AS rmse, {r6('avg(abs(p - y))')} AS mae, "
          f"{r6('1 - sum(pow(p - y, 2)) / (var_pop(y) * count(*))')} AS r2")
SPLIT = f"""WITH {Q.CURVES}, {Q.window_points(-0.3078, -0.0629)}, {Q.features()},
y AS (SELECT sample_id, dataset, ppb AS y FROM c), {Q.holdout('y', 'h')},
d AS (SELECT h.sample_id, h.part, h.y, f."Ip_corr" AS x1, f."Area_peak" AS x2 FROM h JOIN f USING (sample_id)),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS s11, var_pop(x2) AS s22,
  covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM d WHERE part = 'train'),
e AS (SELECT 'Ip_corr' AS model, y, my + c1 / s11 * (x1 - m1) AS p FROM d, m WHERE part = 'hold'
  UNION ALL SELECT 'Ip_corr+Area_peak', y, my + (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) * (x1 - m1)
    + (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) * (x2 - m2) FROM d, m WHERE part = 'hold')
"""


# All potentials at once: normal equations of the training rows, solved by elimination.
# The baseline potential itself is zero after subtraction and carries no weight.
FULL = SPLIT + f""",
l AS (SELECT h.sample_id, h.part, h.y, p.k, p.i FROM h JOIN pts p USING (sample_id) WHERE p.k > 0),
mu AS (SELECT k, avg(i) AS m FROM l WHERE part = 'train' GROUP BY k),
yb AS (SELECT avg(y) AS my FROM h WHERE part = 'train'),
z AS (SELECT sample_id, k, i - m AS v, y - my AS t FROM l JOIN mu USING (k), yb WHERE part = 'train'),
s AS (SELECT a.k AS r, b.k AS c, sum(a.v * b.v) AS v FROM z a JOIN z b USING (sample_id) GROUP BY a.k, b.k
  UNION ALL SELECT k, 64, sum(v * t) FROM z GROUP BY k),
rw AS (SELECT r, list(v ORDER BY c) AS row FROM s GROUP BY r),
el AS (WITH RECURSIVE g(k, m) AS (SELECT 1, list(row ORDER BY r) FROM rw UNION ALL SELECT k + 1,
    list_transform(m, lambda a, i: CASE WHEN i = k THEN list_transform(a, lambda v: v / m[k][k])
      ELSE list_transform(a, lambda v, j: v - a[k] * m[k][j] / m[k][k]) END) FROM g WHERE k <= 63)
  SELECT m FROM g WHERE k = 64),
wt AS (SELECT r.r AS k, el.m[r.r][64] AS w FROM rw r, el),
f3 AS (SELECT 'potentials' AS model, any_value(l.y) AS y, any_value(my) + sum(wt.w * (l.i - mu.m)) AS p
  FROM l JOIN mu USING (k) JOIN wt USING (k), yb WHERE part = 'hold' GROUP BY sample_id),
e3 AS (SELECT model, y, p FROM e UNION ALL SELECT model, y, p FROM f3)
SELECT model, {ERRORS} FROM e3 WHERE NOT abs(y - 16.9) <= 16.9 * 0.01 GROUP BY model"""


@query("study_baselines", FULL)
def study_baselines(spark, folder):
    return studies.study_baselines(table(spark, folder), moved(spark, folder), GRID)["holdout"]


@query("study_baselines_features", SPLIT + f"""
SELECT model, {ERRORS} FROM e WHERE NOT abs(y - 16.9) <= 16.9 * 0.01 GROUP BY model""")
def study_baselines_features(spark, folder):
    """The two feature baselines, which SQL can fit in closed form."""
    tables = studies.study_baselines(table(spark, folder), moved(spark, folder), GRID)
    return tables["holdout"].where(F.col("model") != "potentials")


SCAN_CURVES = Q.CURVES.replace("c AS (", "c0 AS (").replace("g AS (", f"""c AS (SELECT vec_id, dataset || ':scan=part' || blk || ' Ac TW '
    || (blk % 7 * 5) || 'ppb.csv#' || row_number() OVER (PARTITION BY dataset, blk ORDER BY vec_id) AS sample_id, label,
    CAST(blk % 7 * 5 AS DOUBLE) AS ppb, dataset, raw FROM (SELECT *, vec_id // {PER_SCAN} AS blk FROM c0)),
g AS (""", 1)


@query("study_from_scans", FULL.replace(Q.CURVES, SCAN_CURVES))
def study_from_scans(spark, folder):
    """Scan files of two folders to the baseline comparison."""
    folders = {}
    for dataset in ("lab", "unseen"):
        folders[dataset] = new_path(spark, f"scans-{dataset}")
        block = F.floor(F.col("row_id") / PER_SCAN)
        named = AD.curves(spark, folder).where(F.col("dataset") == dataset).select(
            F.format_string("Ac TW %dppb.csv", block % 7 * 5).alias("scan"), "row_id", "cur")
        scans.write_traces(named, GRID, "scan", "row_id", folders[dataset], PER_SCAN)
    return studies.study_from_scans(spark, folders, "*.txt")["holdout"]


@query("study_features")
def study_features(spark, folder):
    return studies.study_features(table(spark, folder), FOURTEEN)["holdout"]


@query("study_features_robust")
def study_features_robust(spark, folder):
    return studies.study_features(table(spark, folder), FOURTEEN, robust=True)["buckets"]


@query("study_spectrum")
def study_spectrum(spark, folder):
    return studies.study_spectrum(moved(spark, folder), GRID)["cv"]


@query("study_spectrum_robust")
def study_spectrum_robust(spark, folder):
    return studies.study_spectrum(moved(spark, folder), GRID, robust=True)["holdout"]


@query("study_roi")
def study_roi(spark, folder):
    return studies.study_roi(AD.curves(spark, folder), GRID)["holdout"]


@query("study_decision")
def study_decision(spark, folder):
    """Both pipelines, each with all its models."""
    return studies.study_decision(moved(spark, folder), table(spark, folder), GRID, FOURTEEN)["summary"]


@query("study_pca")
def study_pca(spark, folder):
    return studies.study_pca(moved(spark, folder), GRID)["scree"]


@query("study_pca_scores")
def study_pca_scores(spark, folder):
    return studies.study_pca(moved(spark, folder), GRID)["scores"]


def peak_fit(spark, folder):
    """One-feature calibration on all curves."""
    shapes = extract(moved(spark, folder), ["concentration_ppb"], GRID)
    rows = gram.design(shapes.withColumn("g", F.lit("all")), ["Ip_corr"], "concentration_ppb", ["g"])
    return S.ols(gram.gram_by_group(rows, 1)["all"])


EMBEDDINGS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType())])
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


@query("stream_score", f"""
WITH {Q.CURVES}, {Q.window_points(-0.3078, -0.0629)}, {Q.features()},
m AS (SELECT regr_slope(ppb, "Ip_corr") AS b, regr_intercept(ppb, "Ip_corr") AS a FROM f)
SELECT sample_id, {r6('a + b * "Ip_corr"')} AS y_pred, CASE WHEN a + b * "Ip_corr" > 15 THEN 1 ELSE 0 END AS alert
FROM f, m""")
def stream_score(spark, folder):
    fit = peak_fit(spark, folder)
    stream = scoring.stream_parquet(spark, folder, "embeddings.parquet", EMBEDDINGS).select(
        F.col("vec_id").cast("string").alias("sample_id"), F.col("embedding").cast("array<double>").alias("cur"))
    return scoring.drain(scoring.score_curves(stream, GRID, fit, ["sample_id"], ["Ip_corr"]), "scores")


@query("stream_alerts", f"""
WITH {Q.CURVES}, {Q.window_points(-0.3078, -0.0629)}, {Q.features()},
m AS (SELECT regr_slope(ppb, "Ip_corr") AS b, regr_intercept(ppb, "Ip_corr") AS a FROM f),
r AS (SELECT date_trunc('hour', e.ts) AS w, a + b * "Ip_corr" AS p FROM events e JOIN f ON f.sample_id = CAST(e.user_id AS VARCHAR), m)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, count(*) FILTER (WHERE p > {THRESHOLD_PPB}) AS alerts
FROM r GROUP BY w""")
def stream_alerts(spark, folder):
    """Predictions above the threshold per hour: readings of a bounded stream meet the scores of their curves."""
    curves = AD.curves(spark, folder).select("sample_id", "cur")
    scored = materialize(scoring.score_curves(curves, GRID, peak_fit(spark, folder), ["sample_id"], ["Ip_corr"]), "scored")
    times = scoring.stream_parquet(spark, folder, "events.parquet", EVENTS).select(
        F.col("user_id").cast("string").alias("sample_id"), F.col("ts").cast("timestamp").alias("ts"))
    log = scoring.AlertLog(new_path(spark, "alerts"), new_path(spark, "alerts-progress"), value="y_pred")
    counts = log.run(scoring.timed_scores(times, scored), close=True)
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "alerts")
