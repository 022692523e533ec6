"""One count table of (target slice, leading hash bits), from which splits are fitted.

Rows are written once as (held, v, h). Their counts per slice of v and prefix of h are bounded by
``CELLS`` numbers, whatever the rows, and tell how many rows lie below any slice end and any
prefix. An order statistic or a hash at a rank falls into one slice or one prefix; only
the rows of those few are looked at again, as values if they are few, else as a finer
table. So results are exact, and passes grow with the logarithm of the rows.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from curvecal.operators.ranking import comparable, lerp
from curvecal.session import materialize

HASH_BITS = 60
CELLS = 1 << 19    # numbers in one table
SLICES = 1024
SAMPLE = 16_384    # values that the first cuts are taken from; they only balance the work
FETCH = 50_000     # rows that may be looked at as values
NUMBERS = 1 << 24  # numbers in a table whose slices are values


def hash_number(seed: int, key: Column) -> Column:
    """The first 60 bits of md5(seed:key): orders rows as the hexadecimal text does."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("bigint")


@dataclass
class Rows:
    """Written rows (held, v, h) and their number."""
    table: DataFrame
    count: int

    @classmethod
    def write(cls, df: DataFrame, value: Column, held: Column, order: Column) -> "Rows":
        """Rows with a comparable value; the others have no part in a split."""
        seen = Observation()
        slim = df.select(F.coalesce(held, F.lit(False)).alias("held"), (value.cast("double") + F.lit(0.0)).alias("v"), order.alias("h"))
        slim = slim.where(comparable(F.col("v"))).observe(seen, F.count(F.lit(1)).alias("n"))
        return cls(materialize(slim, "split", row_group_mb=4), seen.get["n"])

    def sample(self, where: Column | None = None, rows: int | None = None) -> np.ndarray:
        """Values of the rows with the smallest hashes: about ``SAMPLE`` of ``rows``."""
        share = min(1.0, SAMPLE / max(rows or self.count, 1))
        picked = self.table.where(F.col("h") < F.lit(int(share * (1 << HASH_BITS))))
        picked = picked if where is None else picked.where(where)
        return picked.select("v").toArrow().column("v").to_numpy()


def cuts_of(values: np.ndarray, slices: int) -> list[float]:
    """Slice ends (a slice holds the values above the end before, up to its own); frequent values get a slice of their own."""
    distinct, count = np.unique(values, return_counts=True)
    if len(distinct) <= slices:
        alone = distinct
        ends = distinct
    else:
        ordered = np.sort(values)
        ends = np.unique(ordered[np.linspace(0, len(ordered) - 1, slices + 1).astype(int)[1:]])
        alone = distinct[count > 2 * len(values) / slices]
    alone = np.append(alone, 0.0)
    return np.unique(np.concatenate((ends, alone, np.nextafter(alone, -np.inf)))).tolist()


def counted(rows: DataFrame, cuts, bits: int):
    """Columns s, g, p, n, low, high: rows per (slice or value, group, hash prefix), counted in each task first."""
    ends = None if cuts is None else np.array(cuts, float)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            g, v, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("held", "v", "h"))
            s = v if ends is None else np.searchsorted(ends, v, side="left").astype(float)
            p = h >> HASH_BITS - bits
            order = np.lexsort((v, p, g, s))
            s, g, p, v = s[order], g[order].astype(np.int32), p[order], v[order]
            first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (g[1:] != g[:-1]) | (p[1:] != p[:-1])])
            n = np.diff(np.append(first, len(s)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (s[first], g[first], p[first], n.astype(np.int64), v[first], v[first + n - 1])],
                names=["s", "g", "p", "n", "low", "high"])

    parts = rows.select("held", "v", "h").mapInArrow(run, "s double, g int, p bigint, n bigint, low double, high double")
    whole = parts.groupBy("s", "g", "p").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    return tuple(whole.column(c).to_numpy() for c in ("s", "g", "p", "n", "low", "high"))


@dataclass
class Tally:
    """Counts n[slice, group, prefix] of slices that ascend without overlap; values span low to high in each."""
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, cuts: list[float] | None, bits: int, groups: int = 2) -> "Tally":
        """Slices between ``cuts``, or every value a slice of its own."""
        s, g, p, n, low, high = counted(rows, cuts, bits)
        _, at = np.unique(s, return_inverse=True)
        size = int(at.max(initial=-1)) + 1
        out = cls(np.full(size, np.inf), np.full(size, -np.inf), np.zeros((size, groups, 1 << bits), np.int64))
        np.minimum.at(out.low, at, low)
        np.maximum.at(out.high, at, high)
        np.add.at(out.n, (at, g, p), n)
        return out

    def replaced(self, gone: np.ndarray, by: "Tally") -> "Tally":
        keep = np.setdiff1d(np.arange(len(self.low)), gone)
        low = np.concatenate((self.low[keep], by.low))
        order = np.argsort(low, kind="stable")
        return Tally(low[order], np.concatenate((self.high[keep], by.high))[order], np.concatenate((self.n[keep], by.n))[order])

    def merged(self, label: np.ndarray) -> "Tally":
        """Neighbouring slices of one label become one slice."""
        first = np.flatnonzero(np.diff(label, prepend=label[:1] - 1)) if len(label) else np.zeros(0, int)
        if not len(first):
            return self
        return Tally(self.low[first], np.maximum.reduceat(self.high, first), np.add.reduceat(self.n, first))

    def joined(self, bins: np.ndarray) -> "Tally":
        """The same counts in fewer slices: single values of one bin become a slice; zero stays alone."""
        if len(self.low) <= 2 * SLICES:
            return self
        zero = self.low == 0.0
        return self.merged(np.cumsum((np.diff(bins, prepend=-1) != 0) | zero | np.roll(zero, 1) | (self.low < self.high)))

    def counts(self, group: int) -> np.ndarray:
        return self.n[:, group].sum(axis=1)


def tally(rows: Rows, bits: int | None = None) -> Tally:
    """The count table of all rows; ``bits`` leading hash bits (by the number of rows, if not given)."""
    if bits is None:
        bits = min(12, max(0, math.ceil(math.log2(max(rows.count, 1) / (FETCH / 4)))))
    slices = max(64, min(SLICES, CELLS >> bits + 1, rows.count >> bits + 3))
    return Tally.of(rows.table, cuts_of(rows.sample(), slices), bits)


def resolve(rows: Rows, table: Tally, group: int, ranks_of, bits: int, within: Column | None = None):
    """(tally, values and last ranks) such that every slice holding a wanted rank is a single value.

    ``ranks_of(total)`` gives the ranks among the group's counted rows; value zero can be left out by the
    caller through the counts it passes on. Returns the refined tally and a lookup of rank to
    (value, rows up to it).
    """
    while True:
        counts, ranks = ranks_of(table)
        upto = np.cumsum(counts)
        at = np.searchsorted(upto, ranks, side="right")
        open_slices = np.unique(at[table.low[at] < table.high[at]]) if len(ranks) else np.zeros(0, int)
        if not len(open_slices):
            return table, {r: (float(table.low[i]), int(upto[i])) for r, i in zip(ranks, at)}
        # slices next to each other are one range of values
        breaks = np.flatnonzero(np.diff(open_slices) > 1) + 1
        inside = F.lit(False)
        for run in np.split(open_slices, breaks):
            inside = inside | F.col("v").between(float(table.low[run[0]]), float(table.high[run[-1]]))
        inside = inside if within is None else inside & within
        held = int(table.n[open_slices].sum())
        part = rows.table.where(inside)
        if within is not None:
            part = part.withColumn("held", F.lit(False))
        if held <= min(FETCH, NUMBERS >> bits):
            cuts = None
        else:
            low, high = table.low[open_slices], table.high[open_slices]
            cuts = cuts_of(rows.sample(inside, held), max(64, min(SLICES, CELLS >> bits + 1)))
            # ends keep slices apart; smallest values and middles make every slice fall into smaller ones
            cuts = np.unique(np.concatenate((cuts, low, high, low / 2 + high / 2)))
        table = table.replaced(open_slices, Tally.of(part, cuts, bits, table.n.shape[1]))


def hash_limits(rows: Rows, table: Tally, group: int, stratum: np.ndarray, column: Column, wanted: dict[int, list[int]],
                bits: int, within: Column | None = None):
    """Hash at each wanted 1-based rank of each stratum, and the rows above it that share its prefix.

    ``stratum`` numbers the slices, ``column`` computes the same number from ``v``. Returns
    {(stratum, rank): limit} (-1 for rank 0) and {(stratum, rank): (prefix, rows above per slice)}.
    """
    limits = {(s, 0): -1 for s, ranks in wanted.items() if 0 in ranks}
    above = {}
    cells: dict[tuple[int, int], list] = {}  # (stratum, prefix) -> [(rank, rank within)]
    for s, ranks in wanted.items():
        upto = np.cumsum(table.n[stratum == s, group].sum(axis=0))
        for r in ranks:
            if r > 0:
                p = int(np.searchsorted(upto, r))
                cells.setdefault((s, p), []).append((r, r - (int(upto[p - 1]) if p else 0), p))
                above[s, r] = (p, np.zeros(len(table.low), np.int64))
    source = rows.table if within is None else rows.table.where(within).withColumn("held", F.lit(False))
    source = source.where(F.col("held") == F.lit(bool(group) and within is None)).withColumn("s", column)
    size = {c: int(table.n[stratum == c[0], group, c[1]].sum()) for c in cells}
    ends = table.high[:-1]
    while cells:
        named = F.concat_ws("/", "s", F.shiftright("h", HASH_BITS - bits).cast("string"))
        part = source.where(named.isin([f"{s}/{p}" for s, p in cells]))
        if sum(size.values()) <= FETCH or bits + 8 > HASH_BITS:
            got = part.select("v", "h").toArrow()
            v, h = (got.column(c).to_numpy() for c in ("v", "h"))
            at = np.searchsorted(ends, v, side="left")
            for (name, p), ranks in cells.items():
                mine = (stratum[at] == name) & (h >> HASH_BITS - bits == p)
                ordered = np.sort(h[mine])
                for r, k, _ in ranks:
                    limits[name, r] = limit = int(ordered[k - 1])
                    np.add.at(above[name, r][1], at[mine & (h > limit)], 1)
            break
        bits += 8
        at, _, p, n, _, _ = counted(part, ends, bits)
        at = at.astype(int)
        finer, size = {}, {}
        for (name, prefix), ranks in cells.items():
            mine = (stratum[at] == name) & (p >> 8 == prefix)
            seen = np.bincount(p[mine] & 255, weights=n[mine], minlength=256).astype(np.int64)
            upto = np.cumsum(seen)
            for r, k, first in ranks:
                sub = int(np.searchsorted(upto, k))
                finer.setdefault((name, prefix << 8 | sub), []).append((r, k - (int(upto[sub - 1]) if sub else 0), first))
                size[name, prefix << 8 | sub] = int(seen[sub])
                np.add.at(above[name, r][1], at[mine & (p & 255 > sub)], n[mine & (p & 255 > sub)])
        cells = finer
    return limits, above


def interpolated(probs: list[float], total: int, found: dict) -> dict[float, tuple[float, int]]:
    """Linearly interpolated quantiles and the rows not above each, from values at the ranks next to them."""
    out = {}
    for p in probs:
        r = p * (total - 1)
        (lo, lo_n), (hi, hi_n) = found[math.floor(r)], found[math.ceil(r)]
        q = lerp(lo, hi, r - math.floor(r))
        out[p] = (q, hi_n if q >= hi else lo_n)
    return out
