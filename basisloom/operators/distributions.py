"""Distributions of groups: summaries, two-sample statistics and distance matrices, all on sorted windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def group_summaries(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, n_missing, mean, std (sample), min, max, quantiles (linear), skew and excess kurtosis (population)."""
    q = F.percentile(value, F.array(*(F.lit(x) for x in QUANTILES)))
    out = df.groupBy(group).agg(
        F.count(value).alias("n"), (F.count(F.lit(1)) - F.count(value)).alias("n_missing"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), q.alias("_q"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurtosis"),
    )
    return out.select(group, "n", "n_missing", "mean", "std", "min", "max", *(F.col("_q")[i].alias(f"q{round(x * 100):02d}") for i, x in enumerate(QUANTILES)), "skew", "kurtosis")


def _steps(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per pair of groups and distinct value: both empirical distribution functions, and the next value.

    Counts per value come first, so that what a pair is laid out over are distinct
    values and not rows.  The number of groups is small; pairs of groups are formed
    on the group table.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy("g").agg(F.sum("c").alias("n"))
    a, b = totals.select(F.col("g").alias("a"), F.col("n").alias("na")), totals.select(F.col("g").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    of_a = counts.join(F.broadcast(pairs), F.col("g") == F.col("a")).select("a", "b", "na", "nb", "x", F.col("c").alias("ca"), F.lit(0).alias("cb"))
    of_b = counts.join(F.broadcast(pairs), F.col("g") == F.col("b")).select("a", "b", "na", "nb", "x", F.lit(0).alias("ca"), F.col("c").alias("cb"))
    points = of_a.unionByName(of_b).groupBy("a", "b", "na", "nb", "x").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    w = Window.partitionBy("a", "b").orderBy("x")
    return points.select("a", "b", "na", "nb", "x", (F.sum("ca").over(w) / F.col("na")).alias("fa"), (F.sum("cb").over(w) / F.col("nb")).alias("fb"), F.lead("x").over(w).alias("next"))


def pairwise_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per unordered pair: KS statistic and asymptotic p-value, Wasserstein distance, differences of medians and of IQRs."""
    steps = _steps(df, group, value)
    gap = F.abs(F.col("fa") - F.col("fb"))
    stats = steps.groupBy("a", "b").agg(F.max(gap).alias("ks"), F.sum(F.coalesce(gap * (F.col("next") - F.col("x")), F.lit(0.0))).alias("wasserstein"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    lam = F.col("ks") * F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    stats = stats.withColumn("ks_pvalue", F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))))
    q = df.groupBy(F.col(group).alias("g")).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    stats = stats.join(F.broadcast(q.select(F.col("g").alias("a"), F.col("q").alias("qa"))), "a").join(F.broadcast(q.select(F.col("g").alias("b"), F.col("q").alias("qb"))), "b")
    iqr = (F.col("qa")[2] - F.col("qa")[0]) - (F.col("qb")[2] - F.col("qb")[0])
    return stats.select("a", "b", "na", "nb", "ks", "ks_pvalue", "wasserstein", (F.col("qa")[1] - F.col("qb")[1]).alias("median_diff"), iqr.alias("iqr_diff"))


def jensen_shannon(df: DataFrame, group: str, value: str, bins: int = 20, eps: float = 1e-10) -> DataFrame:
    """Per unordered pair: base-2 Jensen-Shannon divergence over ``bins`` equal cells of the common range."""
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull()).select(F.col(group).alias("g"), x.alias("x"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    cell = F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    hist = rows.join(F.broadcast(ends), F.lit(True)).select("g", F.coalesce(cell, F.lit(0)).cast("int").alias("cell")).groupBy("g", "cell").agg(F.count(F.lit(1)).alias("c"))
    grid = hist.select("g").distinct().select("g", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("cell"))
    w = Window.partitionBy("g")
    p = grid.join(hist, ["g", "cell"], "left").fillna(0, ["c"]).withColumn("p", F.col("c") / F.sum("c").over(w) + eps)
    p = p.withColumn("p", F.col("p") / F.sum("p").over(w)).select("g", "cell", "p")
    a, b = p.select(F.col("g").alias("a"), "cell", F.col("p").alias("pa")), p.select(F.col("g").alias("b"), "cell", F.col("p").alias("pb"))
    both = a.join(b, "cell").where("a < b")
    m = (F.col("pa") + F.col("pb")) / 2
    term = 0.5 * F.col("pa") * F.log2(F.col("pa") / m) + 0.5 * F.col("pb") * F.log2(F.col("pb") / m)
    return both.groupBy("a", "b").agg(F.sum(term).alias("js"))


def distance_matrix(df: DataFrame, group: str, value: str, metric: str = "wasserstein") -> DataFrame:
    """The distances as rows (a, b, distance), symmetric with a zero diagonal."""
    pairs = (jensen_shannon(df, group, value).withColumnRenamed("js", "distance") if metric == "js" else pairwise_stats(df, group, value).withColumnRenamed(metric, "distance")).select("a", "b", "distance")
    diagonal = df.select(F.col(group).alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(0.0).alias("distance"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).unionByName(diagonal)


def compare_groups(df: DataFrame, group: str, value: str, ts: str | None = None, start: str | None = None, end: str | None = None, groups: list | None = None, min_count: int = 0) -> dict[str, DataFrame]:
    """All of the above over a time window, chosen groups, and groups with enough values."""
    if ts and start:
        df = df.where(F.col(ts) >= F.lit(start))
    if ts and end:
        df = df.where(F.col(ts) <= F.lit(end))
    if groups is not None:
        df = df.where(F.col(group).isin(groups))
    if min_count:
        enough = df.groupBy(group).agg(F.count(value).alias("_n")).where(F.col("_n") >= min_count).select(group)
        df = df.join(enough, group, "left_semi")
    return {"summaries": group_summaries(df, group, value), "pairs": pairwise_stats(df, group, value), "js": jensen_shannon(df, group, value), "distances": distance_matrix(df, group, value)}
