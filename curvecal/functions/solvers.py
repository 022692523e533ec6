"""Dense solvers on p x p moments; everything here is bounded by the number of features.

All linear models are fitted from ``Moments``, so one distributed pass serves every
fold and candidate.
"""

from dataclasses import dataclass, field

import numpy as np

EIGEN_CUT = 1e-12


@dataclass
class Moments:
    """Count, means and centred cross products of rows (x..., y).

    Two sets of rows combine without ever forming large raw sums, so no common origin
    is needed and precision does not depend on where the data lies.
    """
    n: float
    centre: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray):
        centre = rows.mean(axis=0)
        dev = rows - centre
        return cls(float(len(rows)), centre, dev.T @ dev)

    @classmethod
    def unpack(cls, flat: np.ndarray, size: int):
        return cls(float(flat[0]), flat[1:size + 1], flat[size + 1:].reshape(size, size))

    def pack(self) -> np.ndarray:
        return np.concatenate([[self.n], self.centre, self.scatter.ravel()])

    def __add__(self, other):
        n = self.n + other.n
        if other.n == 0 or n == 0:
            return self
        gap = other.centre - self.centre
        return Moments(n, self.centre + gap * (other.n / n),
                       self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n))

    def __sub__(self, other):
        """Moments of the rows left when ``other`` (a part of these rows) is taken out."""
        n = self.n - other.n
        if n <= 0:
            return Moments(0.0, np.zeros_like(self.centre), np.zeros_like(self.scatter))
        centre = self.centre + (self.centre - other.centre) * (other.n / n)
        gap = other.centre - centre
        return Moments(n, centre, self.scatter - other.scatter - np.outer(gap, gap) * (n * other.n / self.n))

    @property
    def mean(self):
        return self.centre

    def centred(self):
        """(Sxx, Sxy, Syy) about the means."""
        s = self.scatter
        return s[:-1, :-1], s[:-1, -1], s[-1, -1]

    def pick(self, features: list[int]):
        """Moments of some features with the target."""
        at = list(features) + [len(self.centre) - 1]
        return Moments(self.n, self.centre[at], self.scatter[np.ix_(at, at)])


@dataclass
class LinearFit:
    """y = intercept + coef . x on raw (imputed) features."""
    name: str
    intercept: float
    coef: np.ndarray
    params: dict = field(default_factory=dict)


def pseudo_inverse(s: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(s)
    keep = values > EIGEN_CUT * max(values.max(initial=0.0), 0.0)
    if not keep.any():
        return np.zeros_like(s)
    v = vectors[:, keep]
    return (v / values[keep]) @ v.T


def spread(variance: np.ndarray, mean: np.ndarray, n: float) -> np.ndarray:
    """Standard deviation, 1 for a column whose variance is only rounding noise."""
    eps = np.finfo(float).eps
    noise = n * eps * variance + (n * mean * eps) ** 2
    return np.where(variance <= noise, 1.0, np.sqrt(np.maximum(variance, 0.0)))


def population_scale(mom: Moments) -> np.ndarray:
    sxx, _, _ = mom.centred()
    return spread(np.diag(sxx) / mom.n, mom.mean[:-1], mom.n)


def raw_fit(name, mom, weights, scale, **params) -> LinearFit:
    """Undo centring and scaling of the design."""
    coef = weights / scale
    mean = mom.mean
    return LinearFit(name, float(mean[-1] - coef @ mean[:-1]), coef, params)


def ols(mom: Moments, name="ols", scaled=True) -> LinearFit:
    """Least squares, minimum norm on a rank-deficient design."""
    sxx, sxy, _ = mom.centred()
    scale = population_scale(mom) if scaled else np.ones(len(sxy))
    return raw_fit(name, mom, pseudo_inverse(sxx / np.outer(scale, scale)) @ (sxy / scale), scale)


def ridge(mom: Moments, alpha: float, name="ridge", scaled=True) -> LinearFit:
    sxx, sxy, _ = mom.centred()
    scale = population_scale(mom) if scaled else np.ones(len(sxy))
    s = sxx / np.outer(scale, scale) + alpha * np.eye(len(sxy))
    return raw_fit(name, mom, np.linalg.solve(s, sxy / scale), scale, alpha=alpha)


def lasso(mom: Moments, alpha: float, name="lasso", sweeps=5000, tol=1e-10) -> LinearFit:
    """Cyclic coordinate descent on the standardised moments (objective per row)."""
    sxx, sxy, _ = mom.centred()
    scale = population_scale(mom)
    q = sxx / np.outer(scale, scale) / mom.n
    c = sxy / scale / mom.n
    w = np.zeros(len(c))
    for _ in range(sweeps):
        biggest = 0.0
        for j in np.flatnonzero(np.diag(q) > 0):
            pull = c[j] - q[j] @ w + q[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - alpha, 0.0) / q[j, j]
            biggest = max(biggest, abs(new - w[j]))
            w[j] = new
        if biggest <= tol * max(np.abs(w).max(initial=0.0), 1e-300):
            break
    return raw_fit(name, mom, w, scale, alpha=alpha)


@dataclass
class Components:
    """Principal axes in columns; the largest loading of each is positive."""
    mean: np.ndarray
    axes: np.ndarray
    variance: np.ndarray
    ratio: np.ndarray


def principal_components(mom: Moments, count: int | None = None) -> Components:
    sxx, _, _ = mom.centred()
    values, vectors = np.linalg.eigh(sxx)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(len(values))] < 0, -1.0, 1.0)
    whole = values.sum()
    ratio = values / whole if whole > 0 else np.zeros_like(values)
    keep = slice(0, len(values) if count is None else count)
    return Components(mom.mean[:-1], vectors[:, keep], values[keep] / max(mom.n - 1, 1), ratio[keep])


def usable_rank(values: np.ndarray) -> np.ndarray:
    return values > EIGEN_CUT * max(values.max(initial=0.0), 0.0)


def pcr(mom: Moments, components: int, alpha: float = 0.0, name="pcr") -> LinearFit:
    """Regression on leading centred scores, least squares or ridge."""
    pc = principal_components(mom, components)
    _, sxy, _ = mom.centred()
    values = pc.variance * max(mom.n - 1, 1)
    keep = usable_rank(values)
    axes = pc.axes[:, keep]
    coef = axes @ ((axes.T @ sxy) / (values[keep] + alpha))
    return raw_fit(name, mom, coef, np.ones(len(sxy)), components=components, alpha=alpha)


def pls(mom: Moments, components: int, name="pls") -> LinearFit:
    """Partial least squares for one response, kernel form (Dayal and MacGregor 1997).

    Columns and response are scaled by their sample standard deviation first.
    """
    sxx, sxy, syy = mom.centred()
    dof = max(mom.n - 1, 1)
    mean = mom.mean
    sx = spread(np.diag(sxx) / dof, mean[:-1], mom.n)
    sy = spread(np.array([syy / dof]), mean[-1:], mom.n)[0]
    kernel = sxx / np.outer(sx, sx)
    s = sxy / sx / sy
    p = len(s)
    start = np.linalg.norm(s)
    rotations, loadings, weights = [], [], np.zeros(p)
    for _ in range(min(components, p)):
        norm = np.linalg.norm(s)
        if norm <= 1e-13 * max(start, 1e-300):
            break
        r = s / norm
        for old_r, old_p in zip(rotations, loadings):
            r = r - (old_p @ (s / norm)) * old_r
        kr = kernel @ r
        tt = r @ kr
        if tt <= EIGEN_CUT * np.trace(kernel):
            break
        q = (r @ (sxy / sx / sy)) / tt
        load = kr / tt
        s = s - load * q * tt
        rotations.append(r)
        loadings.append(load)
        weights = weights + r * q
    return raw_fit(name, mom, weights * sy, sx, components=components)
