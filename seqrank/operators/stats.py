"""Scaling, imputation and summaries over whole tables or groups.

Statistics of any number of columns come from one aggregate of one row, which is joined to the table by broadcast; exact quantiles
from a few of them. There is no window without a partition or over a group, and no job per column.
"""

from __future__ import annotations

import bisect
import itertools
import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..session import stored


def _attach(df: DataFrame, stats: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(stats))  # one row


def zscore(df: DataFrame, columns: list[str], prefix: str = "z_", population: bool = False) -> DataFrame:
    """(x - mean) / sd, sd 1 where it isn't above 0; the sample's sd unless ``population``."""
    sd = F.stddev_pop if population else F.stddev_samp
    stats = df.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(sd(c).alias(f"__s_{c}") for c in columns))
    scaled = {f"{prefix}{c}": (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(F.lit(1.0)) for c in columns}
    return _attach(df, stats).withColumns(scaled).drop(*stats.columns)


#: Accuracy of the sketch that brackets a quantile, and the values that are looked at one by one once a bracket holds no more.
ACCURACY, FEW = 5_000, 2_000


@dataclass
class _Bracket:
    """Values from lo to hi, n of them, with ``below`` smaller ones; the quantile lies between the ranks first and last."""

    column: str
    rank: float
    lo: float
    hi: float
    below: int
    n: int

    @property
    def first(self) -> int:
        return math.floor(self.rank) - self.below

    @property
    def last(self) -> int:
        return math.ceil(self.rank) - self.below

    def between(self, low: float, high: float) -> float:
        share = self.rank - math.floor(self.rank)
        return low if low == high else (1 - share) * low + share * high


def _narrowed(rows: DataFrame, open_: list[_Bracket]) -> None:
    """One step for all brackets: a sketch of what they hold brackets the ranks closer, and a count shows that it does."""
    inner = [F.when(F.col(t.column).between(F.lit(t.lo), F.lit(t.hi)), F.col(t.column)) for t in open_]
    near = [[max(0.0, t.first / t.n - 2 / ACCURACY), min(1.0, (t.last + 1) / t.n + 2 / ACCURACY)] for t in open_]
    ends = rows.agg(*(F.percentile_approx(v, p, ACCURACY).alias(f"q{k}") for k, (v, p) in enumerate(zip(inner, near, strict=True)))).first()
    aggs = []
    for k, v in enumerate(inner):
        a, b = (F.lit(x) for x in ends[k])
        for name, x in (("under", v < a), ("low", v == a), ("mid", (v > a) & (v < b)), ("high", (v == b) & (v > a)), ("over", v > b)):
            aggs.append(F.count(F.when(x, 1)).alias(f"{name}{k}"))
        for name, f, x in (("under_last", F.max, v < a), ("mid_first", F.min, (v > a) & (v < b)), ("mid_last", F.max, (v > a) & (v < b)), ("over_first", F.min, v > b)):
            aggs.append(f(F.when(x, v)).alias(f"{name}{k}"))
    r = rows.agg(*aggs).first()
    for k, t in enumerate(open_):
        (a, b), at = ends[k], lambda name: r[f"{name}{k}"]  # noqa: B023
        parts = [(at("under"), t.lo, at("under_last")), (at("low"), a, a), (at("mid"), at("mid_first"), at("mid_last")), (at("high"), b, b), (at("over"), at("over_first"), t.hi)]
        parts = [p for p in parts if p[0]]
        ends_at = list(itertools.accumulate(p[0] for p in parts))
        i, j = (bisect.bisect_right(ends_at, x) for x in (t.first, t.last))
        if i == j:  # both ranks in one part: that is the bracket
            t.below, (t.n, t.lo, t.hi) = t.below + (ends_at[i - 1] if i else 0), parts[i]
        else:  # the last value of a part and the first of the next
            t.below, t.n, t.lo, t.hi = t.below + t.first, 2, parts[i][2], parts[j][1]


def exact_quantiles(df: DataFrame, columns: dict[str, Column], at: tuple[float, ...]) -> dict[str, list[float | None]]:
    """Exact quantiles (linear between two values) of any number of columns; nulls and NaN are left out, None without values.

    A mergeable sketch of bounded size brackets each quantile, a count confirms it, and so on with what is in the bracket until it holds
    FEW values. Each pass is one aggregate of one row for all columns and quantiles: no task holds a column, as with the built-in exact percentile.
    """
    rows = df.select(*(F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"v{i}") for i, c in enumerate(columns.values())))
    total = rows.agg(*(f(c).alias(f"{n}{c}") for c in rows.columns for f, n in ((F.count, "n"), (F.min, "lo"), (F.max, "hi")))).first()
    targets = {(c, q): _Bracket(c, (total[f"n{c}"] - 1) * q, total[f"lo{c}"], total[f"hi{c}"], 0, total[f"n{c}"]) for c in rows.columns for q in at if total[f"n{c}"]}
    while open_ := [t for t in targets.values() if t.n > FEW and t.lo < t.hi]:
        _narrowed(rows, open_)
    found = {key: t.between(t.lo, t.hi) for key, t in targets.items() if t.lo == t.hi or (t.n == 2 and t.first == 0 and t.last == 1)}
    left = [(k, t) for k, t in targets.items() if k not in found]
    if left:
        picked = [F.when(F.col(t.column).between(F.lit(t.lo), F.lit(t.hi)), F.struct(F.lit(k).alias("k"), F.col(t.column).alias("v"))) for k, (_, t) in enumerate(left)]
        counts = rows.select(F.explode(F.array_compact(F.array(*picked))).alias("p")).groupBy("p.k", "p.v").agg(F.count("*").alias("n"))
        by: dict[int, list[tuple[float, int]]] = {}
        for r in counts.collect():  # FEW for each target at most
            by.setdefault(r["k"], []).append((r["v"], r["n"]))
        for k, (key, t) in enumerate(left):
            values, counted = zip(*sorted(by[k]), strict=True)
            ends = list(itertools.accumulate(counted))
            found[key] = t.between(*(values[bisect.bisect_right(ends, x)] for x in (t.first, t.last)))
    return {name: [found.get((c, q)) for q in at] for name, c in zip(columns, rows.columns, strict=True)}


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, {c: F.col(c) for c in columns}, (0.5,)).items()}


def robust_z(df: DataFrame, columns: list[str], prefix: str = "g_") -> DataFrame:
    """(x - median) / (1.4826 (MAD + 1e-8)): exact medians, nulls skipped. The table is read for the statistics first."""
    middle = medians(df, columns)
    gaps = {c: F.abs(F.col(c) - F.lit(m)) for c, m in middle.items() if m is not None}
    spread = {c: v[0] for c, v in exact_quantiles(df, gaps, (0.5,)).items()} if gaps else {}
    scaled = {f"{prefix}{c}": (F.col(c) - F.lit(middle[c])) / F.lit(K.MAD_SCALE * (spread[c] + K.MAD_FLOOR)) if c in spread else F.lit(None).cast("double") for c in columns}
    return df.withColumns(scaled)


def centered(df: DataFrame, columns: list[str], group: str, prefix: str = "c_") -> DataFrame:
    """x - mean of x in its group. The means are aggregated and joined, so a group of any size is no task of its own."""
    means = df.groupBy(F.col(group).alias("__g")).agg(*(F.avg(c).alias(f"__m_{c}") for c in columns))
    joined = df.join(means, F.col(group).eqNullSafe(F.col("__g")), "left")
    return joined.withColumns({f"{prefix}{c}": F.col(c) - F.col(f"__m_{c}") for c in columns}).drop(*means.columns)


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians(df, columns).items()})


def clipped(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def finite_or(x: Column, nan: float = -10.0, high: float = 10.0, low: float = -10.0) -> Column:
    """Null and NaN, plus infinity and minus infinity replaced."""
    return F.when(x.isNull() | F.isnan(x), F.lit(nan)).when(x == float("inf"), F.lit(high)).when(x == float("-inf"), F.lit(low)).otherwise(x)


def mode_smallest(df: DataFrame, column: str, to: str = "mode") -> DataFrame:
    """The most frequent value, the smallest at a tie: one row."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    return counts.agg(F.min_by(column, F.struct(-F.col("__n"), F.col(column))).alias(to))


def mode_first_seen(df: DataFrame, column: str, order: str, group: list[str] | None = None, to: str = "mode") -> DataFrame:
    """The most frequent value of each group, that seen first (by ``order``) at a tie."""
    keys = group or []
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("__n"), F.min(order).alias("__o"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("__n"), F.col("__o"))).alias(to))


def top_frequencies(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def quantiles(df: DataFrame, column: str, at: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Exact quantiles with linear interpolation: q, value."""
    found = exact_quantiles(df, {column: F.col(column)}, at)[column]
    return df.sparkSession.createDataFrame(list(zip(at, found, strict=True)), "q double, value double")


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; null where a side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r: Pearson correlations of all pairs of columns from one aggregate."""
    names = [(a, b) for a in columns for b in columns]
    row = df.agg(*(safe_corr(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(names)))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(names)))
    return row.select(F.explode(cells).alias("c")).select("c.a", "c.b", "c.r")


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and for each column its nulls, whether there is any, and its distinct values."""
    out = [F.count("*").alias("n_rows")]
    for c in columns:
        isnull = F.col(c).isNull()
        out += [F.sum(isnull.cast("long")).alias(f"{c}_nulls"), F.bool_or(isnull).alias(f"{c}_any_null"), F.countDistinct(c).alias(f"{c}_distinct")]
    return df.agg(*out)


def first_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, combined in the map tasks (a window would gather a hot key's rows)."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__first"))
    return first.select(*keys, *(F.col(f"__first.{c}").alias(c) for c in rest)).select(df.columns)


def checked_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows as they are; the job fails at a value that is null, NaN or infinite."""
    for c in columns:
        ok = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
        df = df.withColumn(c, F.when(ok, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} isn't finite")).cast("double")))
    return df


def running_before(df: DataFrame, order: list[Column], value: Column, to: str) -> DataFrame:
    """The sum of ``value`` over all rows before a row in a total order, without any task that holds all rows.

    Rows are dealt by ranges of the order; a row's sum is that within its range plus the totals of the ranges before.
    """
    ranged = df.withColumn("__v", value).repartitionByRange(*order)
    placed = stored(ranged.withColumn("__part", F.spark_partition_id()), "ranged")  # the same ranges for both uses
    within = F.sum("__v").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    totals = placed.groupBy(F.col("__part").alias("__q")).agg(F.sum("__v").alias("__t"))
    later = totals.select(F.col("__q").alias("__r"))
    offsets = later.join(totals, F.col("__q") < F.col("__r"), "left").groupBy("__r").agg(F.coalesce(F.sum("__t"), F.lit(0)).alias("__o"))  # a row per range
    out = placed.withColumn("__w", F.coalesce(within, F.lit(0))).join(F.broadcast(offsets), F.col("__part") == F.col("__r"))
    return out.withColumn(to, F.col("__w") + F.col("__o")).drop("__v", "__part", "__w", "__r", "__o")


def running_within(df: DataFrame, keys: list[str], order: list[Column], value: Column, to: str) -> DataFrame:
    """The sum of ``value`` (not below 0) over the rows before a row in its group's total order; a group of any size spreads over ranges."""
    if not keys:
        return running_before(df, order, value, to)
    total = running_before(df, [*(F.col(c) for c in keys), *order], value, "__all")
    begins = total.groupBy(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys))).agg(F.min("__all").alias("__begin"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)))
    return total.join(begins, same).withColumn(to, F.col("__all") - F.col("__begin")).drop("__all", *begins.columns)


def rank_average(df: DataFrame, column: str, to: str, group: list[str] | None = None) -> DataFrame:
    """Average ranks (ties share theirs). Values are aggregated first, so what is ordered are distinct values, by ranges."""
    keys = group or []
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("__n"))
    counts = running_within(counts, keys, [F.col(column)], F.col("__n"), "__b")
    ranks = counts.withColumn(to, F.col("__b") + (F.col("__n") + 1) / 2).drop("__n", "__b")
    return df.join(ranks, [*keys, column])
