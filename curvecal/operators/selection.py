"""Cross-validation, winner, grid search and refit over the model zoo.

Linear candidates share one moment pass and one scoring pass, whatever their number.
Kernel-feature candidates add one of each per kernel width. Forests share their trees, if a task
can hold the training rows; other trees are fitted by MLlib per fold.
"""

import itertools
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvecal import constants as C
from curvecal.functions import solvers as S
from curvecal.operators import ensembles as E
from curvecal.operators import forests
from curvecal.operators.gram import add, gram_by_group
from curvecal.operators.linear import fold_metrics, predict_column, score_folds, train_moments

#: Tree fits at one time.
TREE_FITS = 4
CV_SCHEMA = "model string, fold int, n bigint, rmse double, mae double, r2 double"


@dataclass
class Candidate:
    name: str
    family: str
    params: dict = field(default_factory=dict)

    @property
    def kind(self):
        return self.family if self.family in ("rbf", "forest", "boosted") else "linear"

    def label(self):
        if not self.params:
            return self.name
        return self.name + "[" + ",".join(f"{k}={v}" for k, v in self.params.items()) + "]"

    def fit(self, mom: S.Moments) -> S.LinearFit:
        p = self.params
        if self.family == "ols":
            return S.ols(mom)
        if self.family == "ridge":
            return S.ridge(mom, p.get("alpha", C.RIDGE_ALPHA))
        if self.family == "lasso":
            return S.lasso(mom, p.get("alpha", C.LASSO_ALPHA))
        if self.family == "pcr":
            return S.pcr(mom, p.get("components", C.LATENT_DEFAULT))
        if self.family == "pcr_ridge":
            return S.pcr(mom, p.get("components", C.LATENT_DEFAULT), p.get("alpha", C.RIDGE_ALPHA))
        if self.family == "pls":
            return S.pls(mom, p.get("components", C.LATENT_DEFAULT))
        if self.family == "rbf":
            return S.ridge(mom, E.rbf_alpha(p.get("c", C.RBF_C)), scaled=False)
        raise ValueError(f"no moment fit for {self.family}")

    def estimator(self):
        return E.forest(**self.params) if self.family == "forest" else E.boosted(**self.params)


def feature_zoo(boosting: bool = False) -> list[Candidate]:
    """The feature models; boosting is the optional member."""
    zoo = [Candidate("Linear Regression", "ols"), Candidate("Ridge", "ridge"),
           Candidate("Lasso", "lasso"), Candidate("RBF", "rbf"), Candidate("Random Forest", "forest")]
    return zoo + ([Candidate("Boosting", "boosted")] if boosting else [])


def spectrum_zoo() -> list[Candidate]:
    return [Candidate("PCR (Linear)", "pcr"), Candidate("PCR (Ridge)", "pcr_ridge"), Candidate("PLS", "pls")]


GRIDS = {
    "ridge": {"alpha": C.RIDGE_GRID},
    "lasso": {"alpha": C.LASSO_GRID},
    "rbf": {"c": C.RBF_C_GRID, "gamma": C.RBF_GAMMA_GRID},
    "forest": C.FOREST_GRID,
    "boosted": C.BOOST_GRID,
    "pcr": {"components": C.LATENT_GRID},
    "pcr_ridge": {"components": C.LATENT_GRID, "alpha": C.PCR_RIDGE_GRID},
    "pls": {"components": C.LATENT_GRID},
}


def expand(base: Candidate, grids: dict = GRIDS) -> list[Candidate]:
    """All settings of a candidate's grid, in grid order; none for plain least squares."""
    grid = grids.get(base.family)
    if not grid:
        return []
    return [Candidate(base.name, base.family, dict(zip(grid, values)))
            for values in itertools.product(*grid.values())]


@dataclass
class Predictor:
    """A fitted candidate; ``predict`` adds ``y_pred`` to rows with array ``x``."""
    candidate: Candidate
    linear: S.LinearFit | None = None
    kernel: E.LandmarkMap | None = None
    trees: object = None
    grown_on: tuple[DataFrame, int] | None = None  # training rows of a forest that tasks grow, and their width

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.grown_on is not None:
            return forests.forest_predict(*self.grown_on, forests.setting(self.candidate.params), rows)
        if self.trees is not None:
            return E.predict_trees(self.trees, rows)
        if self.kernel is not None:
            keep = [c for c in rows.columns if c != "x"]
            mapped = self.kernel.apply(rows, keep)
            return mapped.withColumn("y_pred", predict_column(self.linear, "x"))
        return rows.withColumn("y_pred", predict_column(self.linear, "x"))


class Trainer:
    """Evaluates and refits candidates on training rows (g = fold, y, x)."""

    def __init__(self, rows: DataFrame, width: int, moments: dict[str, S.Moments] | None = None):
        self.rows, self.width = rows, width
        self.moments = moments or gram_by_group(rows, width)
        self.whole = add(self.moments.values())
        self.y0 = float(self.whole.mean[-1])
        self.pool = None

    def kernel_rows(self, gamma):
        """The landmark map of a kernel width, the rows seen through it, and their length; all widths share the pool."""
        if self.pool is None:
            self.pool = E.candidates(self.rows)
        kernel = E.landmark_map(self.pool, self.whole, gamma)
        return kernel, kernel.apply(self.rows, ["g", "y"]), kernel.size

    def moment_scores(self, rows, width, moments, candidates) -> list[tuple]:
        trains = train_moments(moments)
        fits = {c.label(): {g: c.fit(m) for g, m in trains.items()} for c in candidates}
        scored = fold_metrics(score_folds(rows, width, fits, y0=self.y0))
        return [tuple(r) for r in scored.select("model", "fold", "n", "rmse", "mae", "r2").collect()]

    def tree_scores(self, candidate) -> list[tuple]:
        """Folds are independent fits of moderate size: a few run side by side."""
        def one(g):
            model = E.fit_trees(candidate.estimator(), self.rows.where(F.col("g") != g))
            held = E.predict_trees(model, self.rows.where(F.col("g") == g))
            err, y = F.col("y_pred") - F.col("y"), F.col("y")
            row = held.agg(F.count(y), F.sqrt(F.avg(err * err)), F.avg(F.abs(err)),
                           1 - F.try_divide(F.sum(err * err), F.var_pop(y) * F.count(y))).first()
            return candidate.label(), int(g), *row
        with ThreadPoolExecutor(TREE_FITS) as pool:
            return list(pool.map(one, sorted(self.moments, key=int)))

    def shares_trees(self, candidate) -> bool:
        """Whether tasks grow the forest: it has no settings of MLlib's own, and a task can hold the training rows."""
        return (candidate.kind == "forest" and candidate.params.keys() <= {"trees", "depth", "min_leaf"}
                and self.whole.n * self.width <= forests.TASK_CELLS)

    def forest_scores(self, candidates) -> list[tuple]:
        """All forest settings from one set of trees."""
        settings = {c.label(): forests.setting(c.params) for c in candidates}
        found = forests.forest_scores(self.rows, self.width, list(settings.values()))
        return [(label, *line) for label, own in settings.items() for line in found[own]]

    def cross_validate(self, candidates: list[Candidate]) -> list[tuple]:
        """(model, fold, n, rmse, mae, r2) for every candidate and fold."""
        out = []
        linear = [c for c in candidates if c.kind == "linear"]
        if linear:
            out += self.moment_scores(self.rows, self.width, self.moments, linear)
        gammas = {}
        for c in candidates:
            if c.kind == "rbf":
                gammas.setdefault(c.params.get("gamma", "scale"), []).append(c)
        for gamma, group in gammas.items():
            _, mapped, size = self.kernel_rows(gamma)
            out += self.moment_scores(mapped, size, gram_by_group(mapped, size), group)
        shared = [c for c in candidates if self.shares_trees(c)]
        if shared:
            out += self.forest_scores(shared)
        for c in candidates:
            if c.kind in ("forest", "boosted") and c not in shared:
                out += self.tree_scores(c)
        return out

    def refit(self, candidate: Candidate) -> Predictor:
        """Fit on all training rows."""
        if candidate.kind == "linear":
            return Predictor(candidate, candidate.fit(self.whole))
        if candidate.kind == "rbf":
            kernel, mapped, size = self.kernel_rows(candidate.params.get("gamma", "scale"))
            return Predictor(candidate, candidate.fit(add(gram_by_group(mapped, size).values())), kernel)
        if self.shares_trees(candidate):
            return Predictor(candidate, grown_on=(self.rows, self.width))
        return Predictor(candidate, trees=E.fit_trees(candidate.estimator(), self.rows))

    def choose(self, zoo: list[Candidate], grids: dict = GRIDS):
        """(winner of the zoo, best tuned setting, all fold scores)."""
        scores = self.cross_validate(zoo)
        winner = best_by_rmse(zoo, scores)
        tuned = expand(winner, grids)
        if not tuned:
            return winner, winner, scores
        more = self.cross_validate(tuned)
        return winner, best_by_rmse(tuned, more), scores + more


def mean_rmse(scores: list[tuple]) -> dict[str, float]:
    sums: dict[str, list[float]] = {}
    for model, _, _, rmse, _, _ in scores:
        sums.setdefault(model, []).append(rmse)
    return {m: float(np.mean(v)) for m, v in sums.items()}


def best_by_rmse(candidates: list[Candidate], scores: list[tuple]) -> Candidate:
    """Smallest mean fold RMSE; the first wins a tie."""
    table = mean_rmse(scores)
    return min(candidates, key=lambda c: table[c.label()])


def score_table(spark: SparkSession, scores: list[tuple]) -> DataFrame:
    return spark.createDataFrame(scores, CV_SCHEMA)
