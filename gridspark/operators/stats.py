"""Paired tests, multiple testing, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _difference(a: str, b: str, decimals: int | None) -> Column:
    """b - a; rounded to ``decimals`` where equal values may differ by the order in which they were summed up."""
    d = F.col(b) - F.col(a)
    return d if decimals is None else F.round(d, decimals)


def _ranked(pairs: DataFrame, by: Sequence[str], a: str, b: str, decimals: int | None = None) -> DataFrame:
    """Differences b - a that are not 0, with average ranks of their sizes."""
    d = pairs.withColumn("_d", _difference(a, b, decimals)).where("_d <> 0").withColumn("_m", F.abs("_d"))
    ties = Window.partitionBy(*by, "_m")
    first = F.rank().over(Window.partitionBy(*by).orderBy("_m"))
    return d.withColumn("_rank", first + (F.count(F.lit(1)).over(ties) - 1) / 2)


def signed_rank_p(n: int, statistic: float, tie_sizes: Sequence[int], zeros: bool) -> float:
    """Two-sided p of a signed-rank statistic: exact for up to 50 pairs without ties or zeros, else normal."""
    if n == 0:
        return 1.0
    if n <= 50 and not zeros and all(t == 1 for t in tie_sizes):
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return float(min(1.0, 2 * ways[: int(math.floor(statistic)) + 1].sum() / 2.0**n))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - sum(t**3 - t for t in tie_sizes) / 48
    return 1.0 if var <= 0 else float(min(1.0, math.erfc(abs(statistic - mean) / math.sqrt(2 * var))))


def wilcoxon_paired(pairs: DataFrame, by: Sequence[str], a: str = "baseline", b: str = "value", decimals: int | None = None) -> DataFrame:
    """Signed-rank test of b - a per comparison: pairs, statistic, p, mean and median difference.

    Ranks and sums are windows and aggregates; only sums, counts and tie sizes of each comparison
    reach the small function that turns them into p. Comparisons of under 2 pairs are left out;
    if all differences are 0 the statistic is 0 and p 1. With ``decimals`` differences are rounded
    first: averages of doubles carry the rounding of their sums, which would break ties and zeros by chance.
    """
    d = _difference(a, b, decimals)
    base = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(d).alias("mean_difference"), F.percentile(d, F.lit(0.5)).alias("median_difference"), F.count_if(d == 0).alias("_zeros")).where("n_pairs >= 2")
    ranked = _ranked(pairs, by, a, b, decimals)
    sums = ranked.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_rank"))), F.lit(0.0)).alias("_up"), F.coalesce(F.sum(F.when(F.col("_d") < 0, F.col("_rank"))), F.lit(0.0)).alias("_down"), F.count(F.lit(1)).alias("_n"))
    ties = ranked.groupBy(*by, "_m").agg(F.count(F.lit(1)).alias("_t")).groupBy(*by, "_t").agg(F.count(F.lit(1)).alias("_k"))
    tied = ties.groupBy(*by).agg(F.sum(F.col("_k") * (F.col("_t") ** 3 - F.col("_t"))).alias("_cube"))
    on = list(by)
    joined = base.join(sums, on, "left").join(tied, on, "left").withColumn("statistic", F.coalesce(F.least("_up", "_down"), F.lit(0.0)))

    @F.pandas_udf("double")
    def p_value(n: pd.Series, w: pd.Series, cube: pd.Series, zeros: pd.Series) -> pd.Series:
        out = []
        for k, s, c, z in zip(n.fillna(0), w, cube.fillna(0), zeros, strict=True):
            k = int(k)
            if c:
                var = k * (k + 1) * (2 * k + 1) / 24 - c / 48
                out.append(1.0 if var <= 0 else min(1.0, math.erfc(abs(s - k * (k + 1) / 4) / math.sqrt(2 * var))))
            else:
                out.append(signed_rank_p(k, s, [1] * k if k <= 50 else [], bool(z)))
        return pd.Series(out)

    return joined.withColumn("p_value", p_value("_n", "statistic", "_cube", "_zeros")).select(*by, "n_pairs", "statistic", "p_value", "mean_difference", "median_difference")


def holm(tests: DataFrame, family: Sequence[str], p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p (running maximum, at most 1) and rejections within each family."""
    w = Window.partitionBy(*family).orderBy(p, *[c for c in tests.columns if c not in (*family, p)])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    m, k = F.count(F.lit(1)).over(Window.partitionBy(*family)), F.row_number().over(w)
    out = tests.withColumn("_a", F.least(F.lit(1.0), F.col(p) * (m - k + 1)))
    out = out.withColumn("p_holm", F.max("_a").over(upto))
    return out.withColumn("reject", F.col("p_holm") <= alpha).drop("_a")


def _hashed(parts: Sequence[Column]) -> Column:
    """The leading 32 bits of an MD5 of ``parts``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


#: Chances of at most 0, 1, 2, ... for a Poisson variable of mean 1, as far as 32 bits tell them from 1.
POISSON_STEPS = tuple(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(12))


def _small_and_large(rows: DataFrame, by: Sequence[str], exact_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups of up to ``exact_rows`` and of larger ones, each with the size ``_n`` of its group.

    There are at most rows / ``exact_rows`` large groups, so their list goes to the rows, which stay
    where they are; only rows of small groups are shuffled.
    """
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    many = F.broadcast(sizes.where(F.col("_n") > exact_rows))
    small = rows.join(many, list(by), "left_anti").join(sizes.where(F.col("_n") <= exact_rows), list(by))
    return small, rows.join(many, list(by))


def _spread(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """``rows`` over all cores before each gives many replicates: few and light as they are, they may lie in one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def _drawn(small: DataFrame, by: Sequence[str], order: str, n_boot: int, seed: int) -> DataFrame:
    """Replicates of small groups, row by row: as many hashed draws of row numbers as the group has rows."""
    numbered = small.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    draws = small.groupBy(*by).agg(F.max("_n").alias("_n")).withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    draws = draws.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    draws = draws.withColumn("_i", (_hashed([F.lit(seed), F.col("_b"), F.col("_k")]) % F.col("_n")).cast("int"))
    return draws.drop("_n").join(numbered, [*by, "_i"])


def _weighted(large: DataFrame, id_col: str, n_boot: int, seed: int) -> DataFrame:
    """Replicates of large groups: each row with each replicate and how often it has it, ``_w``, 0 too: a
    filter would be pushed below and hash once for every step.

    The weights are Poisson variables of mean 1 from hashes of replicate and id. Given their sum they
    are the counts of so many draws with replacement, and that sum differs from the size by a share
    of 1 / sqrt(size). No row needs to know another, so nothing is numbered, sorted or joined.
    """
    rows = large.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_b").cast("string"), F.col(id_col).cast("string"))), 1, 8)
    above = [math.ceil(step * (1 << 32)) for step in POISSON_STEPS]  # a hash of 8 hexadecimal digits, read as a share, is at least ``step``
    rows = rows.withColumn("_u", digits)
    return rows.withColumn("_w", sum((F.col("_u") >= f"{n:08x}").cast("int") for n in above if n < 1 << 32)).drop("_u")


def bootstrap_ci(pairs: DataFrame, by: Sequence[str], value: str, id_col: str, n_boot: int = 1000, seed: int = 0, low: float = 0.025, high: float = 0.975, exact_rows: int = 10_000) -> DataFrame:
    """Interval of the mean under resampling, by seeded hashes instead of a generator.

    In groups of up to ``exact_rows`` values are numbered and each of ``n_boot`` replicates draws as
    many as there are. Rows of larger groups get hashed Poisson weights instead, which are added up
    where the rows are: only ``n_boot`` sums a group and task are shuffled, and no group is ordered.
    There ``id_col`` must tell the rows of a group apart. Null values are drawn but count in no mean.
    """
    small, large = _small_and_large(pairs, by, exact_rows)
    means = _drawn(small, by, id_col, n_boot, seed).groupBy(*by, "_b").agg(F.avg(value).alias("_m"))
    sums = _weighted(_spread(large.select(*by, id_col, value), id_col), id_col, n_boot, seed).groupBy(*by, "_b").agg(F.sum(F.col("_w") * F.col(value)).alias("_s"), F.sum(F.when(F.col(value).isNotNull(), F.col("_w"))).alias("_n"))
    means = means.unionByName(sums.select(*by, "_b", F.try_divide("_s", "_n").alias("_m")))
    return means.groupBy(*by).agg(F.percentile("_m", F.lit(low)).alias("low"), F.percentile("_m", F.lit(high)).alias("high"))


#: Characters of a drawn subject that are drawn in one place.
STRETCH = 1000


def hierarchical_bootstrap(counts: DataFrame, by: Sequence[str], n_boot: int = 200, seed: int = 0, exact_rows: int = 10_000) -> DataFrame:
    """Interval of accuracy: resample subjects, then characters within each drawn subject.

    ``counts`` has (subject, correct, characters). A drawn subject's correct characters are that
    many hashed uniforms below its accuracy. Groups of over ``exact_rows`` subjects are drawn by
    hashed Poisson weights, as in ``bootstrap_ci``; each copy of a subject draws for itself. Characters
    are drawn a stretch at a time, and stretches go to all cores, however few the subjects are.
    """
    small, large = _small_and_large(counts, by, exact_rows)
    drawn = _drawn(small, by, "subject", n_boot, seed).withColumn("_k", F.col("_k").cast("string"))
    copies = F.when(F.col("_w") > 0, F.sequence(F.lit(1), F.col("_w")))
    copies = _weighted(_spread(large, "subject"), "subject", n_boot, seed).withColumn("_c", F.explode(copies))
    copies = copies.withColumn("_k", F.concat_ws(":", F.col("subject").cast("string"), F.col("_c").cast("string")))
    columns = [*by, "_b", "_k", "correct", "characters"]
    drawn = drawn.select(*columns).unionByName(copies.select(*columns))
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.col("characters"), F.lit(1)).cast("int"), F.lit(STRETCH)))
    parts = _spread(drawn.withColumn("_from", first), "_b", "_k", "_from")
    limit = F.lpad(F.lower(F.hex(F.least(F.ceil(F.try_divide("correct", "characters") * float(1 << 32)), F.lit((1 << 32) - 1)))), 8, "0")
    sure = F.col("correct") >= F.col("characters")
    parts = parts.withColumn("_limit", limit).withColumn("_sure", sure).withColumn("_to", F.least(F.col("_from") + STRETCH - 1, F.col("characters").cast("int")))
    each = parts.withColumn("_j", F.explode(F.when(F.col("_to") >= F.col("_from"), F.sequence("_from", "_to"))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_b").cast("string"), F.col("_k"), F.col("_j").cast("string"))), 1, 8)
    won = F.count_if(F.col("_sure") | (digits < F.col("_limit")))
    each = each.groupBy(*by, "_b").agg(F.try_divide(won, F.count(F.lit(1))).alias("_m"))
    return each.groupBy(*by).agg(F.avg("_m").alias("mean"), F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"))


def rank_biserial(pairs: DataFrame, by: Sequence[str], a: str = "baseline", b: str = "value") -> DataFrame:
    ranked = _ranked(pairs, by, a, b)
    return ranked.groupBy(*by).agg((F.sum(F.signum("_d") * F.col("_rank")) / F.sum("_rank")).alias("rank_biserial"))


def better_tied_worse(pairs: DataFrame, by: Sequence[str], a: str = "baseline", b: str = "value", decimals: int | None = None) -> DataFrame:
    """Pairs with b above, equal to and below a; with ``decimals``, by differences rounded so."""
    d = _difference(a, b, decimals)
    return pairs.groupBy(*by).agg(F.count_if(d > 0).alias("better"), F.count_if(d == 0).alias("tied"), F.count_if(d < 0).alias("worse"))


def ladder_tests(results: DataFrame, pairs: Sequence[tuple[str, str]] | None = None, decimals: int | None = None) -> DataFrame:
    """Wilcoxon tests of all pairs of methods (or a planned list), adjusted as one family.

    ``n_pairs`` counts all subjects with both methods, those without a difference too.
    """
    left, right = results.select("subject", F.col("method").alias("a"), F.col("metric").alias("baseline")), results.select("subject", F.col("method").alias("b"), F.col("metric").alias("value"))
    both = left.join(right, "subject")
    if pairs is None:
        both = both.where("a < b")
    else:
        plan = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")) for x, y in pairs])
        both = both.where(F.array_contains(plan, F.struct("a", "b")))
    return holm(wilcoxon_paired(both, ["a", "b"], decimals=decimals).withColumn("family", F.lit("all")), ["family"])
