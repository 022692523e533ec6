"""Registered queries: scans, tables, grids, projections and set operations."""

from pyspark.sql import functions as F

from curvecal.constants import FEATURES, FLAGGED
from curvecal.functions.features import extract, roi_cut, roi_cut_ragged, with_flags
from curvecal.operators import baseline, grids, metrics, relational
from curvecal.plans import sqltext as Q
from curvecal.plans.registry import query, r6
from curvecal.session import new_path
from curvecal.sources import adapters as AD
from curvecal.sources import scans, tables

GRID = AD.GRID
PER_SCAN = 50


def scan_folder(spark, folder):
    """Curves written out as scan files of at most ``PER_SCAN`` replicates."""
    path = new_path(spark, "scans")
    named = AD.curves(spark, folder).select(
        F.format_string("Ac TW %dppb.csv", F.floor(F.col("row_id") / PER_SCAN) % 7).alias("scan"), "row_id", "cur")
    scans.write_traces(named, GRID, "scan", "row_id", path, PER_SCAN)
    return path


SCANS = f"""
WITH {Q.CURVES},
sc AS (SELECT 'part' || (vec_id // {PER_SCAN}) || ' Ac TW ' || (vec_id // {PER_SCAN} % 7) || 'ppb.csv' AS source_file,
        vec_id // {PER_SCAN} % 7 AS n, row_number() OVER (PARTITION BY vec_id // {PER_SCAN}, k
        ORDER BY vec_id % {PER_SCAN}) AS replicate, k, e, i0 FROM pts)
"""


@query("src_scan_files", SCANS + "SELECT DISTINCT source_file FROM sc")
def src_scan_files(spark, folder):
    return scans.scan_files(spark, scan_folder(spark, folder), "*.txt").select("source_file").distinct()


@query("src_trace_matrix", SCANS + f"""
SELECT source_file, CAST(replicate AS INT) AS replicate, {r6('e')} AS e, {r6('i0')} AS i FROM sc""")
def src_trace_matrix(spark, folder):
    return scans.read_traces(spark, scan_folder(spark, folder), "*.txt").drop("scan")


@query("src_conc_from_name", """
SELECT p_partkey, 'Ac TW ' || p_size || 'ppb.csv' AS source_file, p_size AS ppb FROM part""")
def src_conc_from_name(spark, folder):
    name = F.format_string("Ac TW %dppb.csv", F.col("p_size"))
    return AD.table(spark, folder, "part").select("p_partkey", name.alias("source_file")).withColumn(
        "ppb", scans.concentration_from_name(F.col("source_file")))


@query("src_replicates_to_curves", SCANS + f"""
SELECT n || 'ppb_S' || replicate AS sample_id, CAST(n AS DOUBLE) AS concentration_ppb, source_file,
  CAST(replicate AS INT) AS replicate, CAST(count(*) AS INT) AS points, {r6('min(e)')} AS e_first,
  {r6('sum(i0 * (k + 1))')} AS weighted FROM sc GROUP BY ALL""")
def src_replicates_to_curves(spark, folder):
    curves = scans.replicates_to_curves(scans.read_traces(spark, scan_folder(spark, folder), "*.txt"))
    weighted = F.aggregate(F.transform("cur", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    return curves.select("sample_id", "concentration_ppb", "source_file", "replicate",
                         F.size("cur").alias("points"), F.get("pot", F.lit(0)).alias("e_first"),
                         weighted.alias("weighted"))


def uneven_curves(spark, folder):
    """Curves with grids that differ by label: shifted within tolerance, beyond it, or shorter."""
    label = F.round(F.col("concentration_ppb") / 3.38).cast("int")
    grid = F.lit(GRID)
    pot = (F.when(label == 6, F.transform(grid, lambda e: e + 5e-7))
           .when(label == 7, F.transform(grid, lambda e: e + 2e-6))
           .when(label == 8, F.slice(grid, 2, 60)).otherwise(grid))
    cur = F.when(label == 8, F.slice("cur", 2, 60)).otherwise(F.col("cur"))
    return AD.curves(spark, folder).withColumn("pot", pot).withColumn("cur", cur)


@query("grid_check", f"""
WITH {Q.CURVES}
SELECT 'Ac TW ' || label || 'ppb.csv' AS source_file, count(*) AS curves,
  sum(CASE WHEN label IN (7, 8) THEN 1 ELSE 0 END)::BIGINT AS mismatched FROM c GROUP BY label""")
def grid_check(spark, folder):
    return grids.grid_check(uneven_curves(spark, folder))


@query("grid_fill", f"""
WITH {Q.CURVES}
SELECT sample_id, CAST(k AS INT) AS k, {r6('e')} AS e,
  CASE WHEN NOT (label = 8 AND (k < 1 OR k > 60)) THEN {r6('i0')} END AS i FROM pts""")
def grid_fill(spark, folder):
    filled = grids.grid_fill(uneven_curves(spark, folder), GRID)
    return exploded(filled, ["sample_id"])


def exploded(df, keep, pot=None):
    """(k, e, i) rows of curve rows."""
    pairs = F.arrays_zip((F.col("pot") if pot is None else pot).alias("e"), F.col("cur").alias("i"))
    return df.select(*keep, F.posexplode(pairs).alias("k", "p")).select(*keep, "k", "p.e", "p.i")


@query("grid_names", f"""
WITH {Q.CURVES} SELECT printf('E_%.4f', e) AS name, count(*) AS n, {r6('avg(i0)')} AS mean FROM pts GROUP BY 1""")
def grid_names(spark, folder):
    rows = exploded(AD.with_pot(AD.curves(spark, folder)), [])
    return rows.groupBy(grids.grid_name_column(F.col("e")).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("i").alias("mean"))


def wide_sql(prefix, value="raw[{j}]"):
    return ", ".join(
        f"{r6(value.format(j=k + 1))} AS \"{grids.grid_name(e, prefix)}\"" for k, e in enumerate(GRID))


@query("curve_to_wide", f"""
WITH {Q.CURVES} SELECT sample_id, {r6('ppb')} AS concentration_ppb, {wide_sql('E')} FROM c""")
def curve_to_wide(spark, folder):
    return tables.curve_to_wide(AD.curves(spark, folder), GRID, ["sample_id", "concentration_ppb"])


@query("wide_to_curve", f"""
WITH {Q.CURVES} SELECT sample_id, CAST(k AS INT) AS k, {r6('e')} AS e, {r6('i0')} AS i FROM pts""")
def wide_to_curve(spark, folder):
    wide = tables.curve_to_wide(AD.curves(spark, folder), GRID, ["sample_id", "concentration_ppb"])
    curves, grid = tables.wide_to_curve(wide)
    return exploded(curves, ["sample_id"], F.lit(grid))


@query("src_csv", """
SELECT user_id, event_type, props, count(*) AS n, (round(sum(value), 6) + CAST(0 AS DOUBLE)) AS total
FROM events GROUP BY ALL""")
def src_csv(spark, folder):
    path = new_path(spark, "csv")
    tables.write_csv(AD.table(spark, folder, "events").select("user_id", "event_type", "props", "value"), path)
    rows = tables.read_csv(spark, path, "user_id bigint, event_type string, props string, value double")
    return rows.groupBy("user_id", "event_type", "props").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("sink_csv", f"""
WITH {Q.CURVES} SELECT sample_id, {r6('ppb')} AS concentration_ppb, {wide_sql('E')} FROM c""")
def sink_csv(spark, folder):
    path = new_path(spark, "csv")
    wide = tables.curve_to_wide(AD.curves(spark, folder), GRID, ["sample_id", "concentration_ppb"])
    tables.write_csv(wide, path)
    return tables.read_csv(spark, path, wide.schema)


@query("src_class_counts", f"""
WITH {Q.CURVES} SELECT {r6('ppb')} AS concentration_ppb, count(*) AS n FROM c GROUP BY ppb""")
def src_class_counts(spark, folder):
    return tables.class_counts(AD.curves(spark, folder))


@query("src_dataset_counts", f"WITH {Q.CURVES} SELECT dataset, count(*) AS n FROM c GROUP BY dataset")
def src_dataset_counts(spark, folder):
    return tables.dataset_counts(AD.curves(spark, folder))


@query("src_validate", f"""
WITH {Q.CURVES} SELECT count(*) AS n, count(*) FILTER (WHERE len(raw) <> 64) AS bad_width,
  count(*) FILTER (WHERE ppb IS NULL) AS no_target FROM c""")
def src_validate(spark, folder):
    curves = tables.require(AD.curves(spark, folder), ["sample_id", "concentration_ppb", "cur"])
    tables.require(tables.curve_to_wide(curves, GRID, ["concentration_ppb"], "V"), [], "V_")
    return tables.width_report(curves, GRID)


@query("src_preview", f"""
WITH {Q.CURVES} SELECT vec_id AS row_id, sample_id, {r6('ppb')} AS concentration_ppb, {r6('raw[1]')} AS first
FROM c ORDER BY vec_id LIMIT 5""")
def src_preview(spark, folder):
    return tables.preview(AD.curves(spark, folder), "row_id").select(
        "row_id", "sample_id", "concentration_ppb", F.get("cur", F.lit(0)).alias("first"))


@query("baseline_subtract", f"""
WITH {Q.CURVES} SELECT sample_id, CAST(k AS INT) AS k, {r6('i')} AS i FROM pts""")
def baseline_subtract(spark, folder):
    moved = baseline.baseline_subtract(AD.curves(spark, folder), GRID)
    return moved.select("sample_id", F.posexplode("cur").alias("k", "i"))


def describe_sql(source):
    return f"""SELECT stage, count(*) AS count, {r6('avg(v)')} AS mean, {r6('stddev_samp(v)')} AS std,
  {r6('min(v)')} AS min, {r6('max(v)')} AS max, {r6('quantile_cont(v, 0.25)')} AS q25,
  {r6('quantile_cont(v, 0.5)')} AS q50, {r6('quantile_cont(v, 0.75)')} AS q75 FROM {source} GROUP BY stage"""


@query("baseline_describe", f"""
WITH {Q.CURVES}, b AS (SELECT 'before' AS stage, i0 AS v FROM pts WHERE k = 0
  UNION ALL SELECT 'after', i FROM pts WHERE k = 0 UNION ALL SELECT 'last', i FROM pts WHERE k = 63)
{describe_sql('b')}""")
def baseline_describe(spark, folder):
    rows = baseline.baseline_subtract(AD.curves(spark, folder).withColumn("raw", F.col("cur")), GRID)
    at = F.lit(baseline.baseline_index(GRID))
    stages = F.explode(F.array(
        F.struct(F.lit("before").alias("stage"), F.get("raw", at).alias("v")),
        F.struct(F.lit("after").alias("stage"), F.get("cur", at).alias("v")),
        F.struct(F.lit("last").alias("stage"), F.get("cur", F.lit(len(GRID) - 1)).alias("v"))))
    return baseline.describe(rows.select(stages.alias("s")).select("s.stage", "s.v"), "v", ["stage"])


@query("roi_slice", f"""
WITH {Q.CURVES}, {Q.window_points(-0.3078, -0.0629, None)}
SELECT sample_id, CAST(j AS INT) AS j, {r6('e')} AS e, {r6('y')} AS i FROM w""")
def roi_slice(spark, folder):
    moved = baseline.baseline_subtract(AD.curves(spark, folder), GRID)
    pot, cur = roi_cut(F.col("cur"), GRID)
    return exploded(moved.withColumn("cur", cur), ["sample_id"], pot).withColumnRenamed("k", "j")


@query("roi_slice_ragged", f"""
WITH {Q.CURVES}
SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY k) - 1 AS INT) AS j,
  {r6('e + CASE label WHEN 6 THEN 5e-7 WHEN 7 THEN 2e-6 ELSE 0 END')} AS e, {r6('i0')} AS i FROM pts
WHERE e + CASE label WHEN 6 THEN 5e-7 WHEN 7 THEN 2e-6 ELSE 0 END BETWEEN -0.3078 AND -0.0629""")
def roi_slice_ragged(spark, folder):
    curves = uneven_curves(spark, folder)
    pot, cur = roi_cut_ragged(F.col("pot"), F.col("cur"))
    return exploded(curves.select("sample_id", pot.alias("pot"), cur.alias("cur")), ["sample_id"]
                    ).withColumnRenamed("k", "j")


@query("grid_normalize", f"""
WITH {Q.CURVES} SELECT {r6('ppb')} AS concentration_ppb, {wide_sql('V')} FROM c""")
def grid_normalize(spark, folder):
    return grids.normalize_columns(tables.curve_to_wide(AD.curves(spark, folder), GRID, ["concentration_ppb"]))


SHARED = list(range(3, 60))


def shared_sql(dataset):
    cols = ", ".join(f"{r6(f'raw[{k + 1}]')} AS \"{grids.grid_name(GRID[k], 'V')}\"" for k in SHARED)
    return f"SELECT {r6('ppb')} AS concentration_ppb, {cols}, dataset FROM c WHERE dataset = '{dataset}'"


@query("grid_align", f"WITH {Q.CURVES} {shared_sql('lab')} UNION ALL {shared_sql('unseen')}")
def grid_align(spark, folder):
    curves = AD.curves(spark, folder)

    def part(name, lo, hi):
        own = curves.where(F.col("dataset") == name).withColumn("cur", F.slice("cur", lo + 1, hi - lo))
        return grids.normalize_columns(tables.curve_to_wide(own, GRID[lo:hi], ["concentration_ppb"]))
    return relational.dataset_union(*grids.align_columns(part("lab", 3, 64), part("unseen", 0, 60)))


@query("dataset_union", f"""
WITH {Q.CURVES} SELECT sample_id, {r6('ppb')} AS concentration_ppb, {r6('raw[1]')} AS first, dataset FROM c""")
def dataset_union(spark, folder):
    curves = AD.curves(spark, folder)
    cut = ["sample_id", "concentration_ppb", F.get("cur", F.lit(0)).alias("first")]
    return relational.dataset_union(curves.where("dataset = 'lab'").select(*cut),
                                    curves.where("dataset = 'unseen'").select(*cut))


@query("feature_select", f"""
WITH {Q.TABULAR} SELECT {', '.join(f'{r6(f"avg({c})")} AS {c}' for c in ['qty', 'disc', 'tax', 'size', 'retail'])}
FROM t""")
def feature_select(spark, folder):
    rows = AD.tabular(spark, folder).drop("grp").withColumnRenamed("y", "concentration_ppb")
    return rows.agg(*[F.avg(c).alias(c) for c in relational.feature_select(rows)])


@query("feature_align", f"""
WITH {Q.TABULAR} SELECT dataset, {r6('avg(disc)')} AS disc, {r6('avg(qty)')} AS qty, {r6('avg(size)')} AS size
FROM t GROUP BY dataset""")
def feature_align(spark, folder):
    rows = AD.tabular(spark, folder).withColumnRenamed("y", "concentration_ppb").drop("grp")
    lab = rows.where("dataset = 'lab'").drop("tax", "dataset")
    unseen = rows.where("dataset = 'unseen'").drop("retail", "dataset")
    shared = relational.feature_align(lab, unseen)
    both = relational.dataset_union(lab.select(*shared), unseen.select(*shared))
    return both.groupBy("dataset").agg(*[F.avg(c).alias(c) for c in shared])


@query("outlier_filter", f"""
WITH {Q.SCORES} SELECT model, count(*) FILTER (WHERE NOT abs(y_true - 16.9) <= 16.9 * 0.01) AS kept,
  count(*) FILTER (WHERE abs(y_true - 16.9) <= 16.9 * 0.01) AS removed,
  {r6('sum(y_pred) FILTER (WHERE NOT abs(y_true - 16.9) <= 16.9 * 0.01)')} AS kept_pred
FROM s GROUP BY model""")
def outlier_filter(spark, folder):
    scores = AD.scores(spark, folder)
    kept = metrics.without_outliers(scores).groupBy("model").agg(F.sum("y_pred").alias("kept_pred"))
    return metrics.outlier_counts(scores, ["model"]).join(kept, "model")


@query("align_by_key", f"""
WITH {Q.CURVES}, {Q.window_points(-0.3078, -0.0629)}, {Q.features()}
SELECT c.sample_id, {r6('c.raw[1]')} AS first, {r6('"Ip_corr"')} AS "Ip_corr" FROM c JOIN f USING (sample_id)""")
def align_by_key(spark, folder):
    curves = AD.curves(spark, folder)
    shapes = extract(baseline.baseline_subtract(curves, GRID), ["sample_id"], GRID)
    raw = curves.select("sample_id", F.get("cur", F.lit(0)).alias("first"))
    return relational.align_by_key(raw, shapes.select("sample_id", "Ip_corr"))


def flagged_sql():
    cols = []
    for name in FEATURES:
        value = f'coalesce("{name}", 0)' if name in FLAGGED else f'"{name}"'
        cols.append(f'{r6(value)} AS "{name}"')
    cols += [f'CASE WHEN "{name}" IS NULL THEN 0 ELSE 1 END AS "{name}_valid"' for name in FLAGGED]
    return ", ".join(cols)


@query("feature_project", f"""
WITH {Q.CURVES}, {Q.window_points(-0.3078, -0.0629)}, {Q.features()}
SELECT sample_id, {r6('ppb')} AS concentration_ppb, {flagged_sql()} FROM f""")
def feature_project(spark, folder):
    meta = ["concentration_ppb", "sample_id"]
    shapes = extract(baseline.baseline_subtract(AD.curves(spark, folder), GRID), meta, GRID)
    return relational.feature_project(with_flags(shapes, meta))


@query("sample_pick", f"""
WITH {Q.CURVES}, tg AS (SELECT unnest(range(5)) AS slot, unnest([0, 10, 25, 35, 50]) AS target),
hit AS (SELECT slot, CAST(target AS DOUBLE) AS target, vec_id, sample_id, ppb,
    row_number() OVER (PARTITION BY slot ORDER BY vec_id) AS rn FROM c, tg
  WHERE CASE WHEN target = 0 THEN ppb = 0 ELSE ppb BETWEEN target - 3 AND target + 3 END)
SELECT CAST(slot AS INT) AS slot, target, vec_id AS picked_order, sample_id, {r6('ppb')} AS concentration_ppb
FROM hit WHERE rn = 1""")
def sample_pick(spark, folder):
    return relational.sample_pick(AD.curves(spark, folder), "row_id", ["sample_id", "concentration_ppb"])
