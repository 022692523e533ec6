"""Registered queries: splits, preprocessing, linear and latent models, trees, selection."""

from pyspark.sql import functions as F

from curvecal.constants import FEATURES
from curvecal.functions import solvers as S
from curvecal.functions.features import extract, with_flags
from curvecal.operators import bootstrap, ensembles, gram, latent, linear, selection, strata
from curvecal.operators.baseline import baseline_subtract
from curvecal.plans import sqltext as Q
from curvecal.plans.registry import query, r6
from curvecal.session import materialize
from curvecal.sources import adapters as AD

GRID = AD.GRID
KEYS = ["sample_id", "dataset"]
PAIR = ["qty", "retail"]

# --- splits -----------------------------------------------------------------

POOL = f"WITH {Q.CURVES}, y AS (SELECT sample_id, dataset, ppb AS y FROM c)"
TPOOL = f"WITH {Q.TABULAR}"


def targets(spark, folder):
    return AD.curves(spark, folder).select(*KEYS, F.col("concentration_ppb").alias("y"))


@query("strat_bins", POOL + f""", u AS (SELECT * FROM y WHERE dataset = 'unseen'), {Q.bins('u', 'b')}
SELECT sample_id, {r6('y')} AS y, k, bin FROM b""")
def strat_bins(spark, folder):
    rows = targets(spark, folder).where("dataset = 'unseen'")
    fitted = strata.fit_bins(rows, "y")
    return rows.select("sample_id", "y", F.lit(fitted.k).alias("k"), fitted.column(F.col("y")).alias("bin"))


@query("strat_bins_continuous", TPOOL + f""", {Q.bins('t', 'b')}
SELECT k, bin, count(*) AS n, {r6('min(y)')} AS low, {r6('max(y)')} AS high FROM b GROUP BY k, bin""")
def strat_bins_continuous(spark, folder):
    """Quantile bins of a target with almost as many values as rows."""
    rows = AD.tabular(spark, folder)
    fitted = strata.fit_bins(rows, "y")
    return rows.select("y", F.lit(fitted.k).alias("k"), fitted.column(F.col("y")).alias("bin")).groupBy(
        "k", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), F.max("y").alias("high"))


@query("holdout_split", POOL + f", {Q.holdout('y', 'h')} SELECT sample_id, dataset, {r6('y')} AS y, part FROM h")
def holdout_split(spark, folder):
    rows = targets(spark, folder)
    return strata.fit_holdout(rows, "y").assign(rows).select("sample_id", "dataset", "y", "part")


@query("holdout_split_tabular", TPOOL + f", {Q.holdout('t', 'h')} SELECT sample_id, part FROM h")
def holdout_split_tabular(spark, folder):
    rows = AD.tabular(spark, folder).select(*KEYS, "y")
    return strata.fit_holdout(rows, "y").assign(rows).select("sample_id", "part")


FOLDED = f"{Q.holdout('y', 'h')}, {Q.folds('h', 'q')}"


@query("fold_count", POOL + f", {FOLDED} SELECT CAST(max(folds) AS INT) AS folds, count(*) AS n_train FROM q")
def fold_count(spark, folder):
    rows = targets(spark, folder)
    split = strata.fit_split(rows, "y")
    return split.assign(rows).where("part = 'train'").agg(
        F.lit(split.folds).cast("int").alias("folds"), F.count(F.lit(1)).alias("n_train"))


@query("kfold_assign", POOL + f", {FOLDED} SELECT sample_id, stratum, fold FROM q")
def kfold_assign(spark, folder):
    rows = targets(spark, folder)
    return strata.fit_split(rows, "y").assign(rows).where("part = 'train'").select("sample_id", "stratum", "fold")


@query("split_report", POOL + f""", {FOLDED}
SELECT 'train' AS part, stratum, count(*) AS n FROM q GROUP BY stratum
UNION ALL SELECT 'hold', bin, count(*) FROM h WHERE part = 'hold' GROUP BY bin""")
def split_report(spark, folder):
    rows = targets(spark, folder)
    return strata.split_report(strata.fit_split(rows, "y").assign(rows))


# --- preprocessing ----------------------------------------------------------

def holes(spark, folder):
    """Tabular rows in which some values are missing or NaN."""
    rows = AD.tabular(spark, folder)
    return rows.withColumns({
        "size": F.when(F.col("grp") == 1, F.lit(float("nan"))).otherwise(F.col("size")),
        "tax": F.when(F.col("grp") != 2, F.col("tax"))})


@query("impute_zero", TPOOL + f"""
SELECT sample_id, {r6("CASE WHEN grp = 1 THEN 0 ELSE size END")} AS size, {r6("CASE WHEN grp = 2 THEN 0 ELSE tax END")} AS tax
FROM t""")
def impute_zero(spark, folder):
    return gram.impute_zero(holes(spark, folder), ["size", "tax"]).select("sample_id", "size", "tax")


@query("standardize", TPOOL + ", a AS (SELECT sample_id, "
       + ", ".join(f"{r6(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()')} AS {c}" for c in AD.TABULAR)
       + " FROM t) SELECT * FROM a")
def standardize(spark, folder):
    rows = AD.tabular(spark, folder).select("sample_id", *AD.TABULAR)
    return gram.apply_scaler(rows, gram.scaler(rows, AD.TABULAR))


#: Keeps centred values off the midpoints of the sixth decimal, where two engines may round apart.
OFF_TIES = 0.7310585786


@query("center", TPOOL + ", a AS (SELECT sample_id, "
       + ", ".join(f"{r6(f'{c} * {OFF_TIES}::DOUBLE - avg({c} * {OFF_TIES}::DOUBLE) OVER ()')} AS {c}" for c in AD.TABULAR) + " FROM t) SELECT * FROM a")
def center(spark, folder):
    rows = AD.tabular(spark, folder).select("sample_id", *[(F.col(c) * OFF_TIES).alias(c) for c in AD.TABULAR])
    return gram.apply_scaler(rows, gram.scaler(rows, AD.TABULAR, with_std=False))


# --- moments and closed-form checks -------------------------------------------

AXES = ["1"] + AD.TABULAR + ["y"]


@query("gram_by_fold", TPOOL + f""",
m AS ("""
       + " UNION ALL ".join(f"SELECT CAST(grp AS VARCHAR) AS g, {i} AS i, {j} AS j, avg(CAST({a} AS DOUBLE) * {b}) AS v FROM t GROUP BY grp"
                            for i, a in enumerate(AXES) for j, b in enumerate(AXES))
       + f") SELECT g, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {r6('v')} AS v FROM m")
def gram_by_fold(spark, folder):
    """Mean cross products per group."""
    rows = gram.design(AD.tabular(spark, folder), AD.TABULAR, "y", ["grp"]).withColumnRenamed("grp", "g")
    return gram.gram_table(rows, len(AD.TABULAR), per_row=True)


def pair_moments(spark, folder, group=None):
    rows = AD.tabular(spark, folder).withColumn("g", F.lit("all") if group is None else group)
    return gram.gram_by_group(gram.design(rows, PAIR, "y", ["g"]), len(PAIR))


COV = """
v AS (SELECT count(*) AS n, avg(qty) AS m1, avg(retail) AS m2, avg(y) AS my, var_pop(qty) AS s11, var_pop(retail) AS s22,
  covar_pop(qty, retail) AS s12, covar_pop(qty, y) AS c1, covar_pop(retail, y) AS c2, var_pop(y) AS syy FROM t),
z AS (SELECT *, s12 / sqrt(s11 * s22) AS r, c1 / sqrt(s11) AS a, c2 / sqrt(s22) AS b FROM v)
"""


def terms_sql(model, w1, w2, source):
    """Intercept and coefficients from two weights on the raw features."""
    return f"""SELECT '{model}' AS model, unnest(['intercept', 'qty', 'retail']) AS term,
  unnest([{r6(f'my - ({w1}) * m1 - ({w2}) * m2')}, {r6(w1)}, {r6(w2)}]) AS coef FROM {source}"""


def fitted_terms(spark, folder, *fits):
    whole = pair_moments(spark, folder)["all"]
    return linear.coefficient_table(spark, [f(whole) for f in fits], PAIR)


OLS1, OLS2 = "(c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12)", "(c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12)"


@query("fit_ols", TPOOL + f", {COV} {terms_sql('ols', OLS1, OLS2, 'z')}")
def fit_ols(spark, folder):
    return fitted_terms(spark, folder, S.ols)


@query("fit_ridge", TPOOL + f""", {COV}, q AS (SELECT *, 1 + alpha / n AS d FROM z, (SELECT 500.0::DOUBLE AS alpha))
{terms_sql('ridge', '(a * d - b * r) / (d * d - r * r) / sqrt(s11)', '(b * d - a * r) / (d * d - r * r) / sqrt(s22)', 'q')}""")
def fit_ridge(spark, folder):
    return fitted_terms(spark, folder, lambda m: S.ridge(m, 500.0))


@query("fit_lasso", TPOOL + f""", {COV}, it AS (
  WITH RECURSIVE d(k, w1, w2, a, b, r) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, a, b, r FROM z
    UNION ALL SELECT k + 1, x1, sign(b - r * x1) * greatest(abs(b - r * x1) - 0.01, 0), a, b, r
    FROM (SELECT *, sign(a - r * w2) * greatest(abs(a - r * w2) - 0.01, 0) AS x1 FROM d) WHERE k < 60)
  SELECT w1, w2 FROM d WHERE k = 60), q AS (SELECT * FROM z, it)
{terms_sql('lasso', 'w1 / sqrt(s11)', 'w2 / sqrt(s22)', 'q')}""")
def fit_lasso(spark, folder):
    return fitted_terms(spark, folder, lambda m: S.lasso(m, 0.01))


EIGEN = """
ei AS (SELECT *, (s11 + s22) / 2 + sqrt(pow((s11 - s22) / 2, 2) + s12 * s12) AS l1,
  (s11 + s22) / 2 - sqrt(pow((s11 - s22) / 2, 2) + s12 * s12) AS l2 FROM z),
ev AS (SELECT *, (l1 - s22) / sqrt(pow(l1 - s22, 2) + s12 * s12) AS p1,
  s12 / sqrt(pow(l1 - s22, 2) + s12 * s12) AS p2 FROM ei)
"""


@query("fit_pcr", TPOOL + f""", {COV}, {EIGEN} {terms_sql('pcr1', 'p1 * (p1 * c1 + p2 * c2) / l1', 'p2 * (p1 * c1 + p2 * c2) / l1', 'ev')}
UNION ALL {terms_sql('pcr2', OLS1, OLS2, 'ev')}""")
def fit_pcr(spark, folder):
    return fitted_terms(spark, folder, lambda m: S.pcr(m, 1, name="pcr1"), lambda m: S.pcr(m, 2, name="pcr2"))


PCR_R = ["{p} * (p1 * c1 + p2 * c2) / (l1 + 500.0 / n)".format(p=p) for p in ("p1", "p2")]


@query("fit_pcr_ridge", TPOOL + f", {COV}, {EIGEN} {terms_sql('pcr_ridge', *PCR_R, 'ev')}")
def fit_pcr_ridge(spark, folder):
    return fitted_terms(spark, folder, lambda m: S.pcr(m, 1, 500.0, name="pcr_ridge"))


PLS_W = [f"{v} * (a * a + b * b) / (a * a + 2 * r * a * b + b * b) / sqrt({s})" for v, s in (("a", "s11"), ("b", "s22"))]


@query("fit_pls", TPOOL + f", {COV} {terms_sql('pls1', *PLS_W, 'z')} UNION ALL {terms_sql('pls2', OLS1, OLS2, 'z')}")
def fit_pls(spark, folder):
    return fitted_terms(spark, folder, lambda m: S.pls(m, 1, name="pls1"), lambda m: S.pls(m, 2, name="pls2"))


@query("predict", TPOOL + f", {COV} SELECT sample_id, {r6(f'my + ({OLS1}) * (qty - m1) + ({OLS2}) * (retail - m2)')} AS y_pred FROM t, z")
def predict(spark, folder):
    fit = S.ols(pair_moments(spark, folder)["all"])
    return AD.tabular(spark, folder).select("sample_id", linear.predict_column(fit, PAIR).alias("y_pred"))


def pair_components(spark, folder):
    return S.principal_components(pair_moments(spark, folder)["all"])


# Second axis: the first turned by 90 degrees, largest loading positive.
AXIS2 = ("CASE WHEN abs(p1) >= abs(p2) THEN -p2 ELSE p2 END", "CASE WHEN abs(p1) >= abs(p2) THEN p1 ELSE -p1 END")


@query("pca_fit", TPOOL + f""", {COV}, {EIGEN}
SELECT unnest([1, 2])::INT AS pc, unnest([{r6('l1 * n / (n - 1)')}, {r6('l2 * n / (n - 1)')}]) AS variance,
  unnest([{r6('p1')}, {r6(AXIS2[0])}]) AS qty, unnest([{r6('p2')}, {r6(AXIS2[1])}]) AS retail FROM ev""")
def pca_fit(spark, folder):
    pc = pair_components(spark, folder)
    rows = [(k + 1, float(pc.variance[k]), *map(float, pc.axes[:, k])) for k in range(2)]
    return spark.createDataFrame(rows, "pc int, variance double, qty double, retail double")


@query("pca_scores", TPOOL + f""", {COV}, {EIGEN}
SELECT sample_id, {r6('p1 * (qty - m1) + p2 * (retail - m2)')} AS "PC1",
  {r6(f'({AXIS2[0]}) * (qty - m1) + ({AXIS2[1]}) * (retail - m2)')} AS "PC2" FROM t, ev""")
def pca_scores(spark, folder):
    return latent.pca_scores(AD.tabular(spark, folder), pair_components(spark, folder), PAIR, ["sample_id"])


@query("pca_loadings", TPOOL + f""", {COV}, {EIGEN}
SELECT unnest([1, 1, 2, 2])::INT AS pc, unnest([0, 1, 0, 1])::INT AS position, unnest(['qty', 'retail', 'qty', 'retail']) AS label,
  unnest([{r6('p1')}, {r6('p2')}, {r6(AXIS2[0])}, {r6(AXIS2[1])}]) AS loading FROM ev""")
def pca_loadings(spark, folder):
    return latent.pca_loadings(spark, pair_components(spark, folder), PAIR).drop("potential")


@query("pca_variance", TPOOL + f""", {COV}, {EIGEN}
SELECT unnest([1, 2])::INT AS pc, unnest([{r6('l1 * n / (n - 1)')}, {r6('l2 * n / (n - 1)')}]) AS variance,
  unnest([{r6('l1 / (l1 + l2)')}, {r6('l2 / (l1 + l2)')}]) AS ratio FROM ev""")
def pca_variance(spark, folder):
    return latent.pca_variance(spark, pair_components(spark, folder))


@query("pca_scree", TPOOL + f""", {COV}, {EIGEN}
SELECT unnest([1, 2])::INT AS pc, unnest([{r6('l1 / (l1 + l2) * 100')}, {r6('l2 / (l1 + l2) * 100')}]) AS pct,
  unnest([{r6('l1 / (l1 + l2) * 100')}, {r6('CAST(100 AS DOUBLE)')}]) AS cum_pct FROM ev""")
def pca_scree(spark, folder):
    return latent.pca_scree(latent.pca_variance(spark, pair_components(spark, folder)))


# Two-sided p of a correlation: Student's distribution as its finite series in sin = |r| and cos2 = 1 - r2,
# one form for even and one for odd degrees of freedom.
PC_R = f"""WITH {Q.TABULAR}, {COV}, {EIGEN},
q AS (SELECT n, (p1 * c1 + p2 * c2) / sqrt(l1 * syy) AS r1,
  (({AXIS2[0]}) * c1 + ({AXIS2[1]}) * c2) / sqrt(l2 * syy) AS r2 FROM ev),
cr AS (SELECT 1 AS pc, n, r1 AS r FROM q UNION ALL SELECT 2, n, r2 FROM q),
ct AS (SELECT pc, n, r, j, exp(sum(CASE WHEN j = 0 THEN 0 WHEN n % 2 = 0 THEN ln((2 * j - 1) / (2.0::DOUBLE * j) * (1 - r * r))
    ELSE ln(2.0::DOUBLE * j / (2 * j + 1) * (1 - r * r)) END) OVER (PARTITION BY pc ORDER BY j)) AS term
  FROM cr, (SELECT unnest(range(0, (SELECT any_value(n) FROM cr) // 2)) AS j) WHERE j <= (n - 4 + n % 2) // 2),
cp AS (SELECT pc, any_value(n) AS n, any_value(r) AS r, CASE WHEN any_value(n) % 2 = 0 THEN 1 - abs(any_value(r)) * sum(term)
    ELSE 1 - 2 / pi() * (asin(abs(any_value(r))) + abs(any_value(r)) * sqrt(1 - pow(any_value(r), 2)) * sum(CASE WHEN j <= (n - 5) // 2 THEN term ELSE 0 END)) END AS p
  FROM ct GROUP BY pc)"""


@query("pc_correlation", f"""{PC_R} SELECT pc::INT AS pc, n, {r6('r')} AS r, {r6('r * r')} AS r2, {r6('p')} AS p FROM cp""")
def pc_correlation(spark, folder):
    """Components of two features against the target, with p-values."""
    whole = pair_moments(spark, folder)["all"]
    return latent.component_correlation(spark, whole, S.principal_components(whole))


def curve_rows(spark, folder):
    moved = baseline_subtract(AD.curves(spark, folder), GRID)
    return gram.design(moved, "cur", "concentration_ppb", KEYS)


@query("pc_correlation_p")
def pc_correlation_p(spark, folder):
    """First three components of whole training curves against the target, with p-values."""
    rows = curve_rows(spark, folder)
    train = strata.fit_holdout(rows, "y").assign(rows).where("part = 'train'").withColumn("g", F.lit("all"))
    whole = gram.gram_by_group(train, len(GRID))["all"]
    return latent.component_correlation(spark, whole, S.principal_components(whole, 3))


# --- cross-validation and selection ---------------------------------------------

TFOLDS = f"{Q.holdout('t', 'h')}, {Q.folds('h', 'q')}"


def folded(spark, folder, features):
    """Training rows of the tabular split as (g, y, x)."""
    rows = materialize(gram.design(AD.tabular(spark, folder), features, "y", KEYS), "design", row_group_mb=4)
    split = strata.fit_split(rows, "y")
    return split.assign(rows).where("part = 'train'").select(F.col("fold").cast("string").alias("g"), "y", "x")


ONE = """
o AS (SELECT DISTINCT fold FROM q),
st AS (SELECT o.fold, count(*) AS n, avg(qty) AS m, avg(y) AS my, stddev_pop(qty) AS sd, covar_pop(qty, y) / stddev_pop(qty) AS c
  FROM q JOIN o ON q.fold <> o.fold GROUP BY o.fold),
cand AS (SELECT fold, 'Linear Regression' AS model, 0 AS pos, m, my, c / sd AS w FROM st
  UNION ALL SELECT fold, 'Ridge[alpha=' || al || ']', 1 + ix, m, my, c / (1 + al / n) / sd FROM st,
    (SELECT unnest([0.1, 1.0, 5.0, 10.0])::DOUBLE AS al, unnest([0, 1, 2, 3]) AS ix)
  UNION ALL SELECT fold, 'Lasso[alpha=' || al || ']', 5 + ix, m, my, sign(c) * greatest(abs(c) - al, 0) / sd FROM st,
    (SELECT unnest([0.001, 0.01, 0.1, 1.0])::DOUBLE AS al, unnest([0, 1, 2, 3]) AS ix)),
sc AS (SELECT model, pos, q.fold, count(*) AS n, sqrt(avg(pow(my + w * (qty - m) - y, 2))) AS rmse,
  avg(abs(my + w * (qty - m) - y)) AS mae, 1 - avg(pow(my + w * (qty - m) - y, 2)) / var_pop(y) AS r2
  FROM q JOIN cand ON q.fold = cand.fold GROUP BY model, pos, q.fold),
cv AS (SELECT model, pos, count(*) AS folds, avg(rmse) AS rmse, stddev_pop(rmse) AS rmse_s, avg(mae) AS mae,
  stddev_pop(mae) AS mae_s, avg(r2) AS r2, stddev_pop(r2) AS r2_s FROM sc GROUP BY model, pos)
"""
CV_COLS = ", ".join(f"{r6(a)} AS {b}" for a, b in (
    ("rmse", "rmse_mean"), ("rmse_s", "rmse_std"), ("mae", "mae_mean"), ("mae_s", "mae_std"),
    ("r2", "r2_mean"), ("r2_s", "r2_std")))


@query("cv_evaluate", TPOOL + f""", {TFOLDS}, {ONE}
SELECT model, folds, {CV_COLS} FROM cv WHERE model IN ('Linear Regression', 'Ridge[alpha=1.0]', 'Lasso[alpha=0.01]')""")
def cv_evaluate(spark, folder):
    zoo = [selection.Candidate("Linear Regression", "ols"), selection.Candidate("Ridge", "ridge", {"alpha": 1.0}),
           selection.Candidate("Lasso", "lasso", {"alpha": 0.01})]
    scores = selection.Trainer(folded(spark, folder, ["qty"]), 1).cross_validate(zoo)
    return linear.cv_summary(selection.score_table(spark, scores))


@query("model_select", TPOOL + f""", {TFOLDS}, {ONE}
SELECT model, folds, {CV_COLS},
  CASE WHEN pos = (SELECT arg_min(pos, rmse) FROM cv WHERE pos BETWEEN 1 AND 4) THEN 1 ELSE 0 END AS chosen
FROM cv WHERE pos BETWEEN 1 AND 4""")
def model_select(spark, folder):
    """Grid search over one family: every setting, and the one with least mean fold RMSE."""
    trainer = selection.Trainer(folded(spark, folder, ["qty"]), 1)
    settings = selection.expand(selection.Candidate("Ridge", "ridge"))
    scores = trainer.cross_validate(settings)
    best = selection.best_by_rmse(settings, scores)
    table = linear.cv_summary(selection.score_table(spark, scores))
    return table.withColumn("chosen", (F.col("model") == best.label()).cast("int"))


# --- nonlinear ------------------------------------------------------------------

def shaped(spark, folder):
    """Design rows of the curve features."""
    meta = KEYS + ["concentration_ppb"]
    moved = baseline_subtract(AD.curves(spark, folder), GRID)
    return gram.design(with_flags(extract(moved, meta, GRID), meta), FEATURES, "concentration_ppb", KEYS)


def fitted_on_all(spark, folder, candidate):
    rows = shaped(spark, folder)
    trainer = selection.Trainer(rows.withColumn("g", F.lit("0")), len(FEATURES))
    return trainer.refit(candidate).predict(rows).select("sample_id", "y", "y_pred")


@query("fit_rbf")
def fit_rbf(spark, folder):
    return fitted_on_all(spark, folder, selection.Candidate("RBF", "rbf"))


@query("fit_forest")
def fit_forest(spark, folder):
    rows = shaped(spark, folder)
    model = ensembles.fit_trees(ensembles.forest(), rows)
    return ensembles.predict_trees(model, rows).select("sample_id", "y", "y_pred")


@query("fit_gbt")
def fit_gbt(spark, folder):
    rows = shaped(spark, folder)
    model = ensembles.fit_trees(ensembles.boosted(), rows)
    return ensembles.predict_trees(model, rows).select("sample_id", "y", "y_pred")


# --- bootstrap --------------------------------------------------------------------

def hex_number(digits):
    return f"CAST('0x' || {digits} AS INT)"


REPS, KEPT = bootstrap.REPLICATES, bootstrap.RESIDUALS
POISSON = " + ".join(f"(u >= {limit})::INT" for limit in bootstrap.LIMITS)
REFITS = TPOOL + f""",
l AS (SELECT * FROM t WHERE dataset = 'lab'),
hb AS (SELECT sample_id, blk, md5('42:' || sample_id || ':' || blk) AS h FROM l, (SELECT unnest(range({-(-REPS // 8)})) AS blk)),
w AS (SELECT sample_id, rep, CAST({POISSON} AS DOUBLE) AS w FROM (
  SELECT sample_id, blk * 8 + j AS rep, {hex_number("substr(h, CAST(1 + 4 * j AS INT), 4)")} AS u FROM hb, (SELECT unnest(range(8)) AS j)) WHERE rep < {REPS}),
mo AS (SELECT rep, sum(w) AS n, sum(w * qty) / sum(w) AS m1, sum(w * retail) / sum(w) AS m2, sum(w * y) / sum(w) AS my
  FROM w JOIN l USING (sample_id) GROUP BY rep),
co AS (SELECT rep, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my, sum(w * (qty - m1) * (qty - m1)) AS s11,
  sum(w * (retail - m2) * (retail - m2)) AS s22, sum(w * (qty - m1) * (retail - m2)) AS s12, sum(w * (qty - m1) * (y - my)) AS c1,
  sum(w * (retail - m2) * (y - my)) AS c2 FROM w JOIN l USING (sample_id) JOIN mo USING (rep) GROUP BY rep),
fb AS (SELECT rep, m1, m2, my, {OLS1} AS w1, {OLS2} AS w2 FROM co),
v AS (SELECT avg(qty) AS m1, avg(retail) AS m2, avg(y) AS my, var_pop(qty) AS s11, var_pop(retail) AS s22,
  covar_pop(qty, retail) AS s12, covar_pop(qty, y) AS c1, covar_pop(retail, y) AS c2 FROM l),
pf AS (SELECT m1, m2, my, {OLS1} AS w1, {OLS2} AS w2 FROM v)"""
FB = "fb.my + fb.w1 * (qty - fb.m1) + fb.w2 * (retail - fb.m2)"
EDGES = [round((1 - bootstrap.LEVEL) / 2 * REPS + 0.5), round((1 + bootstrap.LEVEL) / 2 * REPS + 0.5)]
BANDED = REFITS + f""",
e AS (SELECT sample_id, any_value(y) - avg({FB}) AS e FROM w JOIN l USING (sample_id) JOIN fb USING (rep) WHERE w = 0 GROUP BY sample_id),
er AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS r, count(*) OVER () AS n FROM e),
rt AS (SELECT list(e ORDER BY i) AS res FROM er JOIN (SELECT unnest(range({KEPT})) AS i) x ON r = (2 * i + 1) * n // (2 * {KEPT})),
dr AS (SELECT *, md5('42:' || sample_id || ':draw') AS h FROM t),
du AS (SELECT *, {hex_number("substr(h, 1, 4)")} AS u0, {hex_number("substr(h, 5, 4)")} AS turn FROM dr),
sp AS (SELECT sample_id, any_value(dataset) AS dataset, any_value(y) AS y, any_value(qty) AS qty, any_value(retail) AS retail,
  list_sort(list({FB} + res[CAST((((rep * {bootstrap.stride(REPS)} + turn) % {REPS}) * 65536 + u0) * {KEPT} // ({REPS} * 65536) + 1 AS INT)])) AS each
  FROM du, fb, rt GROUP BY sample_id),
ba AS (SELECT sample_id, dataset, y, my + w1 * (qty - m1) + w2 * (retail - m2) AS y_pred, each[{EDGES[0]}] AS lower, each[{EDGES[1]}] AS upper
  FROM sp, pf)"""


def pair_refits(spark, folder):
    """Least squares on two features, fitted to the lab rows and to their replicates; all rows."""
    rows = materialize(gram.design(AD.tabular(spark, folder), PAIR, "y", KEYS), "design", row_group_mb=4)
    lab = rows.where("dataset = 'lab'")
    trainer = selection.Trainer(lab.withColumn("g", F.lit("0")), len(PAIR))
    return bootstrap.refit(trainer, selection.Candidate("Linear Regression", "ols"), lab, "sample_id"), lab, rows


def banded(spark, folder):
    refits, lab, rows = pair_refits(spark, folder)
    residuals = bootstrap.residual_table(refits, lab, "sample_id")
    return bootstrap.prediction_band(refits, residuals, rows, "sample_id", [*KEYS, "y"])


@query("bootstrap_interval", BANDED + f" SELECT sample_id, {r6('y_pred')} AS y_pred, {r6('lower')} AS lower, {r6('upper')} AS upper FROM ba")
def bootstrap_interval(spark, folder):
    """95 % bands for new observations: refits of Poisson replicates plus out-of-sample residuals."""
    return banded(spark, folder).select("sample_id", "y_pred", "lower", "upper")


@query("bootstrap_coverage", BANDED + f""" SELECT dataset, count(*) AS n,
  {r6('CAST(count(*) FILTER (WHERE y >= lower AND y <= upper) AS DOUBLE) / count(*)')} AS coverage, {r6('avg(upper - lower)')} AS width FROM ba GROUP BY dataset""")
def bootstrap_coverage(spark, folder):
    """Share of observations inside their bands, for rows the model was fitted on and for others."""
    return bootstrap.coverage(banded(spark, folder), "y", ["dataset"])


@query("bootstrap_mean_band", REFITS + f""", sp AS (SELECT sample_id, any_value(qty) AS qty, any_value(retail) AS retail,
  list_sort(list({FB})) AS each FROM t, fb GROUP BY sample_id)
SELECT sample_id, {r6('my + w1 * (qty - m1) + w2 * (retail - m2)')} AS y_pred, {r6(f'each[{EDGES[0]}]')} AS lower,
  {r6(f'each[{EDGES[1]}]')} AS upper FROM sp, pf""")
def bootstrap_mean_band(spark, folder):
    """95 % bands of the refits alone."""
    refits, _, rows = pair_refits(spark, folder)
    return bootstrap.mean_band(refits, rows, ["sample_id"])
