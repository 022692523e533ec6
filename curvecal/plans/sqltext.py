"""Shared SQL fragments of the check queries."""

CURVES = """
c AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS sample_id, label,
        label * CAST(3.38 AS DOUBLE) AS ppb,
        CASE WHEN vec_id % 5 < 3 THEN 'lab' ELSE 'unseen' END AS dataset,
        CAST(embedding AS DOUBLE[]) AS raw FROM embeddings),
g AS (SELECT k, round(CAST(-0.4507 AS DOUBLE) + CAST(0.0102042 AS DOUBLE) * k, 4) AS e
      FROM (SELECT unnest(range(64)) AS k)),
pts AS (SELECT c.vec_id, c.sample_id, c.label, c.ppb, c.dataset, g.k, g.e,
          c.raw[g.k + 1] AS i0, c.raw[g.k + 1] - c.raw[1] AS i FROM c, g)
"""


def window_points(low: float, high: float, width: int | None = 5, name: str = "w") -> str:
    """CTE ``name``: (sample_id, j, e, y) of the window, smoothed over ``width`` points."""
    value = "i" if width is None else (
        f"sum(i) OVER (PARTITION BY sample_id ORDER BY k ROWS BETWEEN {width // 2} PRECEDING "
        f"AND {width // 2} FOLLOWING) / CAST({width} AS DOUBLE)")
    return f"""
{name} AS (SELECT sample_id, ppb, dataset, row_number() OVER (PARTITION BY sample_id ORDER BY k) - 1 AS j, e,
        {value} AS y FROM pts WHERE e BETWEEN CAST({low} AS DOUBLE) AND CAST({high} AS DOUBLE))
"""


def features(source: str = "w", name: str = "f") -> str:
    """CTEs ending in ``name``: one row per sample with all features, undefined ones null."""
    return f"""
{name}_a AS (SELECT *, max(y) OVER p AS ip, count(*) OVER p AS n, avg(y) OVER p AS m,
        lag(y) OVER o AS y0, lead(y) OVER o AS y2, lag(e) OVER o AS e0, lead(e) OVER o AS e2
      FROM {source} WINDOW p AS (PARTITION BY sample_id), o AS (PARTITION BY sample_id ORDER BY j)),
{name}_b AS (SELECT *, min(CASE WHEN y = ip THEN j END) OVER (PARTITION BY sample_id) AS pk,
        CASE WHEN j = 0 THEN (y2 - y) / (e2 - e) WHEN j = n - 1 THEN (y - y0) / (e - e0)
        ELSE ((y - y0) * (e2 - e) / (e - e0) + (y2 - y) * (e - e0) / (e2 - e)) / (e2 - e0) END AS d1
      FROM {name}_a),
{name}_c AS (SELECT *, lag(d1) OVER o AS d0, lead(d1) OVER o AS d2,
        max(CASE WHEN j < pk AND y < ip / 2 THEN j END) OVER (PARTITION BY sample_id) AS lj,
        min(CASE WHEN j > pk AND y < ip / 2 THEN j END) OVER (PARTITION BY sample_id) AS rj
      FROM {name}_b WINDOW o AS (PARTITION BY sample_id ORDER BY j)),
{name}_d AS (SELECT *, CASE WHEN j = 0 THEN (d2 - d1) / (e2 - e) WHEN j = n - 1 THEN (d1 - d0) / (e - e0)
        ELSE ((d1 - d0) * (e2 - e) / (e - e0) + (d2 - d1) * (e - e0) / (e2 - e)) / (e2 - e0) END AS dd
      FROM {name}_c),
{name}_e AS (SELECT sample_id, any_value(ppb) AS ppb, any_value(dataset) AS dataset, any_value(n) AS n,
        any_value(ip) AS "Ip_corr", max(CASE WHEN j = pk THEN e END) AS "Ep",
        sum(CASE WHEN j > 0 THEN (e - e0) * (greatest(y, 0) + greatest(y0, 0)) / 2 END) AS "Area_peak",
        max(CASE WHEN j = lj THEN e + (ip / 2 - y) * (e2 - e) / (y2 - y) END) AS lx,
        max(CASE WHEN j = rj THEN e0 + (ip / 2 - y0) * (e - e0) / (y - y0) END) AS rx,
        avg(CASE WHEN j < greatest(5, CAST(floor(0.1 * n) AS INT)) THEN y END) AS bg,
        any_value(pk) AS pk,
        regr_slope(y, e) FILTER (WHERE j <= pk) AS rise, regr_slope(y, e) FILTER (WHERE j >= pk) AS fall,
        max(d1) AS "dIdE_max", max(dd) AS "d2IdE2_max", avg(y) AS "Mean",
        avg((y - m) * (y - m)) AS "Var", avg((y - m) * (y - m) * (y - m)) AS m3,
        avg((y - m) * (y - m) * (y - m) * (y - m)) AS m4, sum(y * y) AS "Energy"
      FROM {name}_d GROUP BY sample_id),
{name} AS (SELECT sample_id, ppb, dataset, "Ip_corr", "Ep", "Area_peak",
        CASE WHEN "Ip_corr" > 0 THEN abs(rx - lx) END AS "FWHM",
        CASE WHEN abs(bg) > 1e-12 THEN "Ip_corr" / bg END AS "Peak_to_bg",
        CASE WHEN pk >= 1 THEN rise END AS "Slope_rise", CASE WHEN pk < n - 1 THEN fall END AS "Slope_fall",
        CASE WHEN pk < n - 1 AND abs(fall) > 1e-12 THEN CASE WHEN pk >= 1 THEN rise END / fall END AS "Symmetry",
        "dIdE_max", "d2IdE2_max", "Mean", "Var",
        CASE WHEN "Var" > 0 THEN m3 / (pow("Var", 1.5) + 1e-12) END AS "Skew",
        CASE WHEN "Var" > 0 THEN m4 / ("Var" * "Var" + 1e-12) END AS "Kurtosis", "Energy"
      FROM {name}_e)
"""


KEY = ("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
       "CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT), "
       "date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)))")

SCORES = f"""
s AS (SELECT {KEY} AS sample_id, l_returnflag AS model, (l_quantity - 1) * CAST(0.65 AS DOUBLE) AS y_true,
        (l_quantity - 1) * CAST(0.65 AS DOUBLE) + CAST(40 AS DOUBLE) * (l_tax - l_discount) AS y_pred
      FROM lineitem)
"""

TABULAR = f"""
t AS (SELECT {KEY} AS sample_id, CASE WHEN l_linestatus = 'O' THEN 'unseen' ELSE 'lab' END AS dataset,
        l_extendedprice / CAST(1000 AS DOUBLE) AS y, l_quantity AS qty, l_discount AS disc, l_tax AS tax,
        CAST(p_size AS DOUBLE) AS size, p_retailprice / CAST(1000 AS DOUBLE) AS retail,
        l_linenumber % 5 AS grp
      FROM lineitem JOIN part ON l_partkey = p_partkey)
"""

TRACES = """
tr AS (SELECT user_id AS sample_id,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / CAST(1000000 AS DOUBLE) AS e,
         value AS i, event_id AS row_id FROM events)
"""


def bins(source: str, name: str, top: int = 6, least: int = 2) -> str:
    """CTEs ending in ``name``: rows of ``source`` (with y) plus ``bin`` and the chosen ``k``."""
    edges = " UNION ALL ".join(
        f"SELECT {k} AS k, list_sort(list_distinct(quantile_cont(y, ["
        + ", ".join(f"CAST({p!r} AS DOUBLE)" for p in [i * (1.0 / k) for i in range(k)] + [1.0])
        + f"]))) AS ed FROM {source} WHERE y <> 0" for k in range(1, top + 1))
    return f"""
{name}_e AS ({edges}),
{name}_a AS (SELECT s.*, q.k, CASE WHEN s.y = 0 THEN 0 ELSE
        1 + len(list_filter(q.ed[2:len(q.ed) - 1], lambda x: x < s.y)) END AS b
      FROM {source} s, {name}_e q WHERE len(q.ed) > 1),
{name}_n AS (SELECT k, b, count(*) AS n FROM {name}_a GROUP BY k, b),
{name}_k AS (SELECT coalesce(max(k), 0) AS k FROM
        (SELECT k FROM {name}_n GROUP BY k HAVING min(n) >= {least})),
{name} AS (SELECT a.* EXCLUDE (k, b), CAST(a.k AS INT) AS k, CAST(a.b AS INT) AS bin
        FROM {name}_a a, {name}_k z WHERE a.k = z.k
      UNION ALL BY NAME SELECT s.*, 0 AS k, 0 AS bin FROM {source} s, {name}_k z WHERE z.k = 0)
"""


def holdout(source: str, name: str, fraction: float = 0.5, seed: int = 42) -> str:
    """CTE ``name``: rows of ``source`` (sample_id, dataset, y) with ``part`` and held-out ``bin``."""
    return f"""
{name}_p AS (SELECT * FROM {source} WHERE dataset = 'unseen'),
{bins(name + '_p', name + '_b')},
{name}_c AS (SELECT bin, count(*) AS c, sum(count(*)) OVER () AS n FROM {name}_b GROUP BY bin),
{name}_x AS (SELECT bin, c, n - CAST(ceil({fraction} * n) AS BIGINT) AS keep,
        (n - CAST(ceil({fraction} * n) AS BIGINT)) * CAST(c AS DOUBLE) / n AS ex FROM {name}_c),
{name}_r AS (SELECT *, row_number() OVER (ORDER BY ex - floor(ex) DESC, bin) AS pos,
        keep - CAST(sum(floor(ex)) OVER () AS BIGINT) AS need FROM {name}_x),
{name}_q AS (SELECT bin, c - CAST(floor(ex) AS BIGINT) - CASE WHEN pos <= need THEN 1 ELSE 0 END AS quota
        FROM {name}_r),
{name}_h AS (SELECT b.sample_id, b.bin, CASE WHEN row_number() OVER (
        PARTITION BY b.bin ORDER BY md5('{seed}:' || b.sample_id)) <= q.quota THEN 'hold' ELSE 'train' END AS part
      FROM {name}_b b JOIN {name}_q q ON b.bin = q.bin),
{name} AS (SELECT s.*, coalesce(h.part, 'train') AS part, h.bin FROM {source} s
      LEFT JOIN {name}_h h ON s.sample_id = h.sample_id)
"""


def folds(source: str, name: str, most: int = 5, seed: int = 42) -> str:
    """CTE ``name``: training rows of ``source`` with ``stratum``, ``fold`` and ``folds``."""
    return f"""
{name}_t AS (SELECT * EXCLUDE (bin) FROM {source} WHERE part = 'train'),
{bins(name + '_t', name + '_b')},
{name}_c AS (SELECT bin, count(*) AS c, CAST(coalesce(sum(count(*)) OVER (ORDER BY bin
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o,
        least({most}, greatest(2, min(count(*)) OVER ())) AS kk FROM {name}_b GROUP BY bin),
{name}_f AS (SELECT bin, kk, f, c // kk + CASE WHEN ((f - o) % kk + kk) % kk < c % kk THEN 1 ELSE 0 END AS size
        FROM {name}_c, (SELECT unnest(range({most})) AS f) WHERE f < kk),
{name}_u AS (SELECT bin, f, kk, sum(size) OVER (PARTITION BY bin ORDER BY f) AS hi,
        sum(size) OVER (PARTITION BY bin ORDER BY f) - size AS lo FROM {name}_f),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('{seed}:' || sample_id)) AS rk
        FROM {name}_b),
{name} AS (SELECT r.* EXCLUDE (rk, bin, k), r.bin AS stratum, CAST(u.f AS INT) AS fold, CAST(u.kk AS INT) AS folds
      FROM {name}_r r JOIN {name}_u u ON r.bin = u.bin AND r.rk > u.lo AND r.rk <= u.hi)
"""
