"""Choosing and combining strategies: gates, redundancy, weights, and a rolling rebalance."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import metrics, portfolio


@dataclass(frozen=True)
class Selection:
    """Thresholds on metrics, then the best ``keep`` of each group of strategies with correlation >= ``threshold``."""

    least: Mapping[str, float] = field(default_factory=dict)
    most: Mapping[str, float] = field(default_factory=dict)
    threshold: float = 0.8
    keep: int = 1
    score: str = "sharpe"
    min_obs: int = 50
    year: float = 252


def clean_returns(df: DataFrame, ts: str, key: str, r: str, order: Sequence[str] = (), min_obs: int = 50, how: str = "inner") -> DataFrame:
    """One row per (date, strategy), the last by ``order``; short series out; with ``inner`` the common dates only."""
    w = Window.partitionBy(ts, key).orderBy(*(F.col(o).desc() for o in order)) if order else Window.partitionBy(ts, key).orderBy(F.col(r).desc())
    rows = df.where(F.col(r).isNotNull()).withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")
    enough = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_obs).select(key)
    rows = rows.join(enough, key, "left_semi")
    return portfolio.complete_dates(rows, ts, key, r) if how == "inner" else rows


def select_strategies(df: DataFrame, ts: str, key: str, r: str, rule: Selection = Selection()) -> tuple[DataFrame, DataFrame]:
    """(chosen strategies with cluster and metrics, metrics of all)."""
    rows = clean_returns(df, ts, key, r, min_obs=rule.min_obs, how="outer")
    stats = metrics.return_metrics(rows, [key], ts, r, rule.year).withColumnRenamed(key, "key")
    passed = portfolio.passes(stats, dict(rule.least), dict(rule.most))
    left = rows.join(passed.select(F.col("key").alias(key)), key, "left_semi")
    labels = portfolio.clusters(portfolio.pairwise(left, ts, key, r, min(rule.min_obs, 60)), rule.threshold)
    return portfolio.best_of_clusters(labels, passed, rule.score, rule.keep), stats


def select_at(df: DataFrame, asked: DataFrame, ts: str, key: str, r: str, rule: Selection = Selection(), lookback: int = 252, active: bool = True, overlap: int = 60) -> tuple[DataFrame, DataFrame]:
    """(chosen strategies, metrics of all that have enough rows) as of each date ``asof`` of ``asked``.

    A selection sees the ``lookback`` dates up to its own; with ``active`` a strategy
    must have a return on the last of them.  All dates are answered in one pass.
    """
    rows = df.where(F.col(r).isNotNull()).select(ts, key, r)
    days = rows.select(ts).distinct().withColumn("_i", F.row_number().over(Window.orderBy(ts)))  # one row per date
    last = days.join(asked.select("asof").distinct(), F.col(ts) <= F.col("asof")).groupBy("asof").agg(F.max("_i").alias("_last"))
    seen = days.join(last, (F.col("_i") <= F.col("_last")) & (F.col("_i") > F.col("_last") - lookback))
    window = rows.join(seen, ts)
    enough = window.groupBy("asof", key).agg(F.count(F.lit(1)).alias("_n"), F.max((F.col("_i") == F.col("_last")).cast("int")).alias("_now"))
    enough = enough.where((F.col("_n") >= rule.min_obs) & ((F.col("_now") == 1) if active else F.lit(True))).select("asof", key)
    window = window.join(enough, ["asof", key], "left_semi")
    stats = metrics.return_metrics(window, ["asof", key], ts, r, rule.year).withColumnRenamed(key, "key")
    passed = portfolio.passes(stats, dict(rule.least), dict(rule.most))
    left = window.join(passed.select("asof", F.col("key").alias(key)), ["asof", key], "left_semi")
    labels = portfolio.clusters(portfolio.pairwise(left, ts, key, r, min(rule.min_obs, overlap), ["asof"]), rule.threshold, ["asof"])
    return portfolio.best_of_clusters(labels, passed, rule.score, rule.keep, ["asof"]), stats


def ledoit_wolf(x: np.ndarray) -> np.ndarray:
    """Shrinkage to a scaled identity with the weight that minimises expected squared error."""
    n, p = x.shape
    x = x - x.mean(0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    gap = ((s - mu * np.eye(p)) ** 2).sum() / p
    noise = sum(((np.outer(row, row) - s) ** 2).sum() for row in x) / (n * n) / p
    alpha = min(1.0, noise / gap) if gap > 0 else 1.0
    return (1 - alpha) * s + alpha * mu * np.eye(p)


def scaled_to_vol(df: DataFrame, ts: str, key: str, r: str, target: float, year: float = 252, window: int | None = None) -> DataFrame:
    """Returns scaled to a target volatility, of the whole history or of the rows before."""
    part = Window.partitionBy(key)
    w = part if window is None else part.orderBy(ts).rowsBetween(-window, -1)
    scale = target / F.nullif(F.stddev_samp(r).over(w) * math.sqrt(year), F.lit(0.0))
    return df.withColumn("scale", scale).withColumn(r, F.col(r) * F.col("scale"))


def rolling_rebalance(df: DataFrame, ts: str, key: str, r: str, every: str = "month", lookback: int = 120, method: str = "risk_parity", cost: float = 0.0, min_overlap: int = 60) -> tuple[DataFrame, DataFrame]:
    """(portfolio returns, weights): weights are fitted on the rows before each period and held through it.

    Each period is a group of its own: its task gets the look-back rows of its
    strategies and solves one small matrix.
    """
    rows = df.where(F.col(r).isNotNull()).select(ts, key, r)
    periods = rows.select(F.date_trunc(every, F.col(ts)).alias("period")).distinct()
    dates = rows.select(ts).distinct().withColumn("_i", F.row_number().over(Window.orderBy(ts)))  # one row per date
    firsts = dates.withColumn("period", F.date_trunc(every, F.col(ts))).groupBy("period").agg(F.min("_i").alias("_at"))
    fit = rows.join(dates, ts).join(F.broadcast(firsts.join(periods, "period")), (F.col("_i") < F.col("_at")) & (F.col("_i") >= F.col("_at") - lookback))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot_table(index=ts, columns=key, values=r).dropna(axis=1, thresh=min_overlap)
        cov = wide.cov(min_periods=min_overlap).fillna(0.0).to_numpy()
        if not len(cov):
            return part[["period", key]].iloc[:0].rename(columns={key: "key"}).assign(weight=0.0)
        w = portfolio.risk_parity(portfolio.nearest_psd(cov)) if method == "risk_parity" else 1 / np.sqrt(np.maximum(np.diag(cov), 1e-18))
        return pd.DataFrame({"period": part["period"].iloc[0], "key": wide.columns, "weight": w / w.sum()})

    kinds = dict(rows.dtypes)
    weights = fit.select("period", ts, key, r).groupBy("period").applyInPandas(solve, f"period timestamp, key {kinds[key]}, weight double")
    order = Window.partitionBy("key").orderBy("period")
    turn = weights.withColumn("_d", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(order), F.lit(0.0)))).groupBy("period").agg(F.sum("_d").alias("_turn"))
    held = rows.withColumn("period", F.date_trunc(every, F.col(ts)).cast("timestamp")).withColumnRenamed(key, "key").join(weights, ["period", "key"])
    daily = held.groupBy("period", ts).agg(F.sum(F.col(r) * F.col("weight")).alias("ret"))
    first = F.row_number().over(Window.partitionBy("period").orderBy(ts)) == 1
    out = daily.join(turn, "period").withColumn("ret", F.col("ret") - F.when(first, F.col("_turn") * cost).otherwise(0.0))
    return out.select(ts, "ret"), weights
