"""Stratification bins, hash-ordered holdout and balanced folds.

Fitting writes target, group and hash once, counts them in one table, and looks again only
at the rows next to a bin edge or a hash limit. It keeps edges, counts and limits, so a
fitted split is a projection of literals: assigning parts and folds shuffles nothing.
"""

import itertools
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvecal.constants import (
    HOLDOUT_FRACTION, MIN_PER_BIN, N_BINS, N_FOLDS, SEED,
)
from curvecal.operators.ranking import comparable
from curvecal.operators.tally import Rows, Tally, hash_limits, hash_number, interpolated, resolve, tally


@dataclass
class Bins:
    """Right-closed bins between ``edges``; with ``zero`` the value 0 is bin 0."""
    k: int
    edges: list[float]
    zero: bool
    counts: dict[int, int]

    def column(self, y: Column) -> Column:
        if self.k == 0:
            return F.lit(0)
        above = F.lit(0)
        for edge in self.edges[1:-1]:
            above = above + F.when(y > edge, 1).otherwise(0)
        if self.zero:
            above = F.when(y == 0.0, 0).otherwise(above + 1)
        return above.cast("int")

    def numbers(self, values: np.ndarray) -> np.ndarray:
        """``column`` for values on the driver."""
        if self.k == 0:
            return np.zeros(len(values), int)
        above = np.searchsorted(self.edges[1:-1], values, side="left")
        return np.where(values == 0.0, 0, above + 1) if self.zero else above


def even_probs(k: int) -> list[float]:
    """0, 1/k, ..., 1 as multiples of the step; a last-digit difference can move a tied value."""
    return [i * (1.0 / k) for i in range(k)] + [1.0]


def fit_bins(df: DataFrame, y: str, n_bins: int = N_BINS, min_per_bin: int = MIN_PER_BIN,
             zero_bin: bool = True) -> Bins:
    """Largest number of quantile bins whose smallest bin holds ``min_per_bin`` rows.

    Falls back to one bin (k = 0) when no number of bins satisfies that.
    """
    # any evenly spread number serves as hash: only the first cuts are taken by it
    spread = F.shiftrightunsigned(F.xxhash64(F.col(y), F.monotonically_increasing_id()), 4)
    rows = Rows.write(df, F.col(y), F.lit(False), spread)
    return bins_of(rows, tally(rows, 0), 0, n_bins, min_per_bin, zero_bin, 0)[0]


def bins_of(rows: Rows, table: Tally, group: int, n_bins: int, min_per_bin: int, zero_bin: bool, bits: int,
            within: Column | None = None) -> tuple[Bins, Tally]:
    """Bins of one group of a count table, and the table with slices that keep to one bin each."""
    top = max(1, n_bins - (1 if zero_bin else 0))
    probs = sorted({p for k in range(1, top + 1) for p in even_probs(k)})

    def spread_ranks(t: Tally):
        counts = np.where(t.low == 0.0, 0, t.counts(group)) if zero_bin else t.counts(group)
        n = int(counts.sum())
        return counts, np.unique([f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)]).astype(int) if n else np.zeros(0, int)

    table, found = resolve(rows, table, group, spread_ranks, bits, within)
    n_all, spread_n = int(table.counts(group).sum()), int(spread_ranks(table)[0].sum())
    zeros = n_all - spread_n
    at = interpolated(probs, spread_n, found) if spread_n else {}
    upto = {q: n for q, n in at.values()}
    chosen = Bins(0, [], zero_bin, {0: n_all})
    first = 1 if zero_bin else 0
    for k in range(top, 0, -1):
        edges = sorted({at[p][0] for p in even_probs(k)}) if at else []
        if len(edges) < 2:
            continue
        marks = [0] + [upto[e] for e in edges[1:-1]] + [spread_n]
        counts = {first + j: b - a for j, (a, b) in enumerate(zip(marks, marks[1:])) if b > a}
        if zeros:
            counts[0] = zeros
        if counts and min(counts.values()) >= min_per_bin:
            chosen = Bins(k, edges, zero_bin, dict(sorted(counts.items())))
            break
    return chosen, table.joined(chosen.numbers(table.low))


def holdout_quotas(counts: dict[int, int], fraction: float) -> dict[int, int]:
    """Held-out rows per stratum: the kept rows are shared out by largest remainder."""
    n = sum(counts.values())
    keep = n - math.ceil(fraction * n)
    exact = {s: keep * c / n for s, c in counts.items()}
    kept = {s: int(v) for s, v in exact.items()}
    order = sorted(counts, key=lambda s: (-(exact[s] - kept[s]), s))
    for s in order[:keep - sum(kept.values())]:
        kept[s] += 1
    return {s: counts[s] - kept[s] for s in counts}


def fold_count(counts: dict[int, int], folds: int = N_FOLDS) -> int:
    return int(min(folds, max(2, min(counts.values()))))


def fold_sizes(counts: dict[int, int], folds: int) -> dict[int, list[int]]:
    """Rows of each fold per stratum when positions are dealt out in stratum order."""
    out, offset = {}, 0
    for s in sorted(counts):
        sizes = [0] * folds
        base, extra = divmod(counts[s], folds)
        for f in range(folds):
            sizes[f] = base
        for j in range(extra):
            sizes[(offset + j) % folds] += 1
        out[s] = sizes
        offset += counts[s]
    return out


@dataclass
class Split:
    """Fitted split; ``assign`` adds ``part``, ``stratum`` and ``fold``."""
    y: str
    key: str
    group: str
    held_group: str
    seed: int
    held_bins: Bins | None = None
    quotas: dict[int, int] = field(default_factory=dict)
    hold_limits: dict[int, int] = field(default_factory=dict)
    train_bins: Bins | None = None
    folds: int = 0
    fold_limits: dict[int, list[int]] = field(default_factory=dict)

    def assign(self, df: DataFrame) -> DataFrame:
        """Add ``part``, ``stratum`` and, once folds are fitted, ``fold`` (null when held out)."""
        return self.place(df.withColumn("__h", hash_number(self.seed, F.col(self.key)))).drop("__h")

    def place(self, out: DataFrame) -> DataFrame:
        """``assign`` for rows that carry their hash as ``__h``."""
        y = F.col(self.y).cast("double")
        out = out.withColumn("__b", F.when(F.col(self.group) == self.held_group, self.held_bins.column(y)))
        held = F.coalesce(F.col("__h") <= per_stratum(self.hold_limits, F.col("__b")), F.lit(False))
        out = out.withColumn("part", F.when(comparable(y), F.when(held, "hold").otherwise("train")))
        if self.train_bins is None:
            return out.withColumnRenamed("__b", "stratum")
        out = out.withColumn("stratum", F.when(F.col("part") == "hold", F.col("__b"))
                             .otherwise(self.train_bins.column(y)))
        fold = F.lit(0)
        for j in range(self.folds - 1):
            limit = per_stratum({s: v[j] for s, v in self.fold_limits.items()}, F.col("stratum"))
            fold = fold + F.when(F.col("__h") > limit, 1).otherwise(0)
        return out.withColumn("fold", F.when(F.col("part") == "train", fold)).drop("__b")


def per_stratum(limits: dict[int, int], stratum: Column) -> Column:
    """The hash limit of a row's stratum; a stratum without one lies below every hash."""
    return F.get(F.array(*[F.lit(limits.get(s, -1)).cast("bigint") for s in range(max(limits) + 1)]), stratum)


def bits_of(table: Tally) -> int:
    return table.n.shape[2].bit_length() - 1


def hold_out(rows: Rows, table: Tally, split: Split, fraction: float, n_bins: int, min_per_bin: int,
             zero_bin: bool) -> Tally:
    """Bins, quotas and hash limits of the held group; the count table of the rows that train."""
    bits = bits_of(table)
    bins, table = bins_of(rows, table, 1, n_bins, min_per_bin, zero_bin, bits)
    split.held_bins, split.quotas = bins, holdout_quotas(bins.counts, fraction)
    stratum = bins.numbers(table.low)
    limits, above = hash_limits(rows, table, 1, stratum, bins.column(F.col("v")), {s: [q] for s, q in split.quotas.items()}, bits)
    split.hold_limits = {s: limits[s, q] for s, q in split.quotas.items()}
    kept = table.n[:, 1].copy()
    for s, q in split.quotas.items():
        if q > 0:
            prefix, rest = above[s, q]
            mine = stratum == s
            kept[mine, :prefix] = 0
            kept[mine, prefix] = rest[mine]
    return Tally(table.low, table.high, (table.n[:, 0] + kept)[:, None])


def fold_up(rows: Rows, table: Tally, split: Split, folds: int, n_bins: int, min_per_bin: int,
            zero_bin: bool) -> Split:
    """Balanced folds over the training rows: fold sizes per stratum become hash limits."""
    bits = bits_of(table)
    held = F.col("held") & F.coalesce(
        F.col("h") <= per_stratum(split.hold_limits, split.held_bins.column(F.col("v"))), F.lit(False))
    some = table.counts(0) > 0
    bins, table = bins_of(rows, Tally(table.low[some], table.high[some], table.n[some]), 0, n_bins, min_per_bin, zero_bin, bits, ~held)
    count = fold_count(bins.counts, folds)
    ranks = {s: list(itertools.accumulate(per_fold[:-1])) for s, per_fold in fold_sizes(bins.counts, count).items()}
    limits, _ = hash_limits(rows, table, 0, bins.numbers(table.low), bins.column(F.col("v")), ranks, bits, ~held)
    split.train_bins, split.folds = bins, count
    split.fold_limits = {s: [limits[s, r] for r in rs] for s, rs in ranks.items()}
    return split


def written(df: DataFrame, split: Split) -> Rows:
    return Rows.write(df, F.col(split.y), F.col(split.group) == split.held_group, hash_number(split.seed, F.col(split.key)))


def fit_holdout(df: DataFrame, y: str, key: str = "sample_id", group: str = "dataset",
                held_group: str = "unseen", fraction: float = HOLDOUT_FRACTION, n_bins: int = N_BINS,
                min_per_bin: int = MIN_PER_BIN, zero_bin: bool = True, seed: int = SEED) -> Split:
    """Stratified holdout drawn from one group only; every other row trains."""
    split = Split(y, key, group, held_group, seed)
    rows = written(df.where(F.col(group) == held_group), split)
    hold_out(rows, tally(rows), split, fraction, n_bins, min_per_bin, zero_bin)
    return split


def fit_split(df: DataFrame, y: str, key: str = "sample_id", group: str = "dataset",
              held_group: str = "unseen", fraction: float = HOLDOUT_FRACTION, folds: int = N_FOLDS,
              n_bins: int = N_BINS, min_per_bin: int = MIN_PER_BIN, zero_bin: bool = True,
              seed: int = SEED) -> Split:
    """Holdout, then balanced folds of the rest."""
    split = Split(y, key, group, held_group, seed)
    rows = written(df, split)
    train = hold_out(rows, tally(rows), split, fraction, n_bins, min_per_bin, zero_bin)
    return fold_up(rows, train, split, folds, n_bins, min_per_bin, zero_bin)


def split_report(assigned: DataFrame) -> DataFrame:
    return (assigned.groupBy("part", "stratum").agg(F.count(F.lit(1)).alias("n"))
            .orderBy("part", "stratum"))
