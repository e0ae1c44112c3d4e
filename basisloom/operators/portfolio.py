"""Covariances, clusters, weights and targets of strategies.

Matrices over strategies are rows (a, b, value); what needs a whole matrix is done
in one task per group, as its size is the number of strategies squared.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def complete_dates(df: DataFrame, ts: str, key: str, r: str) -> DataFrame:
    """Rows of the dates on which every key has a value."""
    rows = df.where(F.col(r).isNotNull())
    keys = F.broadcast(rows.agg(F.countDistinct(key).alias("_k")))  # one row
    full = rows.groupBy(ts).agg(F.countDistinct(key).alias("_n")).join(keys, F.col("_n") == F.col("_k")).select(ts)
    return rows.join(full, ts, "left_semi")


def pairwise(df: DataFrame, ts: str, key: str, r: str, min_obs: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, n, corr, cov) over the dates that both have; null below ``min_obs``."""
    rows = df.where(F.col(r).isNotNull())
    a = rows.select(*by, ts, F.col(key).alias("a"), F.col(r).alias("_x"))
    b = rows.select(*by, ts, F.col(key).alias("b"), F.col(r).alias("_y"))
    out = a.join(b, [*by, ts]).groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("corr"), F.covar_samp("_x", "_y").alias("cov"))
    enough = F.col("n") >= min_obs
    return out.select(*by, "a", "b", "n", F.when(enough, F.col("corr")).alias("corr"), F.when(enough, F.col("cov")).alias("cov"))


def sample_cov(df: DataFrame, ts: str, key: str, r: str) -> DataFrame:
    return pairwise(complete_dates(df, ts, key, r), ts, key, r, 2).select("a", "b", F.col("cov").alias("value"))


def spearman(df: DataFrame, ts: str, key: str, r: str) -> DataFrame:
    """Rank correlation over complete dates."""
    rows = complete_dates(df, ts, key, r)
    rank = F.rank().over(Window.partitionBy(key).orderBy(r)) + (F.count(F.lit(1)).over(Window.partitionBy(key, r)) - 1) / 2
    return pairwise(rows.withColumn("_rank", rank), ts, key, "_rank", 2).select("a", "b", "corr")


def ewma_cov(df: DataFrame, ts: str, key: str, r: str, half_life: float = 40.0) -> DataFrame:
    """Covariance with weights that halve every ``half_life`` dates back from the last."""
    rows = complete_dates(df, ts, key, r)
    age = F.dense_rank().over(Window.partitionBy(key).orderBy(F.col(ts).desc())) - 1
    rows = rows.withColumn("_w", F.pow(F.lit(0.5), age / half_life))
    a = rows.select(ts, F.col(key).alias("a"), F.col(r).alias("_x"), "_w")
    b = rows.select(ts, F.col(key).alias("b"), F.col(r).alias("_y"))
    s = a.join(b, ts).groupBy("a", "b").agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_x")).alias("x"), F.sum(F.col("_w") * F.col("_y")).alias("y"), F.sum(F.col("_w") * F.col("_x") * F.col("_y")).alias("xy"))
    return s.select("a", "b", (F.col("xy") / F.col("w") - F.col("x") / F.col("w") * F.col("y") / F.col("w")).alias("value"))


def shrink_to_diagonal(cov: DataFrame, alpha: float = 0.1) -> DataFrame:
    return cov.select("a", "b", F.when(F.col("a") == F.col("b"), F.col("value")).otherwise(F.col("value") * (1 - alpha)).alias("value"))


def clusters(corr: DataFrame, threshold: float = 0.8, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, cluster): components over pairs with corr >= threshold, named by their smallest key.

    The links of one value of ``by`` are united in one task, whose size is the number
    of strategies squared as for all matrices here; nothing comes to the driver.
    """
    kinds = dict(corr.dtypes)
    kind = kinds["a"]

    def unite(rows: pd.DataFrame) -> pd.DataFrame:
        root = {k: k for k in sorted({*rows["a"], *rows["b"]})}

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for a, b in rows.loc[rows["linked"], ["a", "b"]].itertuples(index=False):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return pd.DataFrame({**{c: rows[c].iloc[0] for c in by}, "key": list(root), "cluster": [find(k) for k in root]})

    linked = F.coalesce(F.col("corr") >= threshold, F.lit(False)) & (F.col("a") != F.col("b"))
    rows = corr.select(*by, "a", "b", linked.alias("linked")).where("linked OR a = b")
    return rows.groupBy(*by).applyInPandas(unite, "".join(f"{c} {kinds[c]}, " for c in by) + f"key {kind}, cluster {kind}")


def best_of_clusters(labels: DataFrame, metrics: DataFrame, score: str, keep: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """The best keys of each cluster."""
    w = Window.partitionBy(*by, "cluster").orderBy(F.col(score).desc_nulls_last(), "key")
    return labels.join(metrics, [*by, "key"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def passes(metrics: DataFrame, least: dict[str, float] | None = None, most: dict[str, float] | None = None) -> DataFrame:
    """Rows that meet every threshold; a missing column or a null fails none and all, in that order."""
    for name, v in (least or {}).items():
        if name in metrics.columns:
            metrics = metrics.where(F.col(name) >= v)
    for name, v in (most or {}).items():
        if name in metrics.columns:
            metrics = metrics.where(F.col(name) <= v)
    return metrics


def inverse_vol(vols: DataFrame, key: str, vol: str, by: Sequence[str] = (), floor: float = 1e-6, gross: float = 1.0) -> DataFrame:
    """Weights proportional to 1 / max(vol, floor)."""
    inv = 1 / F.greatest(F.col(vol), F.lit(floor))
    return vols.withColumn("weight", gross * inv / F.sum(inv).over(Window.partitionBy(*by)))


def rolling_inverse_vol(df: DataFrame, ts: str, key: str, r: str, lookback: int = 20, floor: float = 1e-6) -> DataFrame:
    """Per date: equal weights until every strategy has ``lookback`` rows, then inverse volatility of the last ones."""
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(-(lookback - 1), 0)
    rows = df.withColumn("_n", F.count(r).over(w)).withColumn("_v", F.greatest(F.stddev_samp(r).over(w), F.lit(floor)))
    day = Window.partitionBy(ts)
    ready = F.min("_n").over(day) >= lookback
    inv = 1 / F.col("_v")
    return rows.select(ts, key, F.when(ready, inv / F.sum(inv).over(day)).otherwise(1 / F.count(F.lit(1)).over(day)).alias("weight"))


def capped_weights(w: np.ndarray, lo: float, hi: float, rounds: int = 10) -> np.ndarray:
    """Clamp and renormalise in turn; a bound that cannot hold with a sum of one is met as nearly as the rounds allow."""
    for _ in range(rounds):
        w = np.clip(w, lo, hi)
        total = w.sum()
        if total <= 0 or abs(total - 1) < 1e-12:
            break
        free = (w > lo) & (w < hi)
        if free.any() and w[free].sum() > 0:
            w[free] *= max(0.0, 1 - w[~free].sum()) / w[free].sum()
        else:
            w = w / total
    return w


def risk_parity(cov: np.ndarray, rounds: int = 5000, tol: float = 1e-10) -> np.ndarray:
    """Weights with equal risk shares: a damped multiplicative fixed point."""
    n = len(cov)
    w = 1 / np.sqrt(np.maximum(np.diag(cov), 1e-18))
    w /= w.sum()
    for _ in range(rounds):
        share = w * (cov @ w)
        total = share.sum()
        if total <= 0:
            break
        gap = share / total - 1 / n
        if np.abs(gap).max() < tol:
            break
        w = w * np.sqrt((1 / n) / np.maximum(share / total, 1e-18))
        w /= w.sum()
    return w


def mean_variance(cov: np.ndarray, mu: np.ndarray, aversion: float = 1.0, ridge: float = 1e-8, gross: float = 1.0) -> np.ndarray:
    w = np.linalg.solve(aversion * cov + ridge * np.eye(len(cov)), mu)
    total = np.abs(w).sum()
    return w * min(1.0, gross / total) if total > 0 else w


def nearest_psd(m: np.ndarray, eps: float = 1e-10) -> np.ndarray:
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors * np.maximum(values, eps)) @ vectors.T


def matrix_weights(cov: DataFrame, by: Sequence[str] = (), method: str = "risk_parity", mu: str | None = None, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(key, weight, risk_share) of one covariance matrix per group, given as rows (a, b, value)."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        m = rows.pivot(index="a", columns="b", values="value").sort_index().sort_index(axis=1)
        c = nearest_psd(m.to_numpy(float))
        if method == "equal":
            w = np.full(len(c), 1 / len(c))
        elif method == "inverse_vol":
            w = 1 / np.sqrt(np.maximum(np.diag(c), 1e-18))
            w /= w.sum()
        elif method == "mean_variance":
            w = mean_variance(c, rows.groupby("a")[mu].first().sort_index().to_numpy(float))
        else:
            w = risk_parity(c)
        if method != "mean_variance":
            w = capped_weights(w, lo, hi)
        var = w @ c @ w
        out = pd.DataFrame({"key": m.index, "weight": w, "risk_share": w * (c @ w) / var if var > 0 else 0.0})
        for b in by:
            out[b] = rows[b].iloc[0]
        return out

    kinds = dict(cov.dtypes)
    schema = ", ".join([f"key {kinds['a']}", "weight double", "risk_share double", *(f"{b} {kinds[b]}" for b in by)])
    return cov.groupBy(*by).applyInPandas(solve, schema)


def portfolio_variance(weights: DataFrame, cov: DataFrame, key: str = "key", weight: str = "weight") -> DataFrame:
    """One row: variance and volatility of the weighted whole."""
    a, b = weights.select(F.col(key).alias("a"), F.col(weight).alias("wa")), weights.select(F.col(key).alias("b"), F.col(weight).alias("wb"))
    out = cov.join(a, "a").join(b, "b").agg(F.sum(F.col("wa") * F.col("wb") * F.col("value")).alias("variance"))
    return out.withColumn("vol", F.sqrt(F.greatest("variance", F.lit(0.0))))


def no_trade_band(old: Column, new: Column, band: float) -> Column:
    return F.when(F.abs(new - F.coalesce(old, F.lit(0.0))) < band, F.coalesce(old, F.lit(0.0))).otherwise(new)


def portfolio_returns(df: DataFrame, weights: DataFrame, ts: str, key: str, r: str, cost: float = 0.0) -> DataFrame:
    """Weighted return per date; turnover from nothing is paid on the first."""
    total = F.broadcast(weights.agg(F.sum(F.abs(F.col("weight"))).alias("_g")))  # one row
    out = df.join(weights.select(key, "weight"), key).groupBy(ts).agg(F.sum(F.col(r) * F.col("weight")).alias("ret"))
    first = F.row_number().over(Window.orderBy(ts)) == 1  # one row per date
    return out.join(total, F.lit(True)).select(ts, (F.col("ret") - F.when(first, F.col("_g") * cost).otherwise(0.0)).alias("ret"))


def bond_targets(signals: DataFrame, ts: str = "timestamp", min_confidence: float = 0.0, max_bond: float | None = None, max_gross: float | None = None, net_zero: bool = False) -> DataFrame:
    """Nested signals to DV01 targets per bond: confidence filter, leg scaling, sum, cap, gross scale, net shift (in this order).

    signals: ts, strategy_id, legs array<struct<bond_id, weight>>, direction, target_gross_dv01, confidence.
    """
    rows = signals.where((F.col("confidence") >= min_confidence) & (F.col("direction") != 0))
    gross = F.aggregate("legs", F.lit(0.0), lambda a, x: a + F.abs(x["weight"]))
    rows = rows.withColumn("_g", gross).select(ts, "strategy_id", "direction", "target_gross_dv01", "_g", F.explode("legs").alias("l"))
    out = rows.groupBy(ts, F.col("l.bond_id").alias("bond_id")).agg(F.sum(F.col("l.weight") * F.col("direction") * F.col("target_gross_dv01") / F.nullif(F.col("_g"), F.lit(0.0))).alias("dv01"))
    if max_bond is not None:
        out = out.withColumn("dv01", F.greatest(F.lit(-max_bond), F.least(F.lit(max_bond), F.col("dv01"))))
    w = Window.partitionBy(ts)
    if max_gross is not None:
        total = F.sum(F.abs("dv01")).over(w)
        out = out.withColumn("dv01", F.col("dv01") * F.when(total > max_gross, max_gross / total).otherwise(1.0))
    return out.withColumn("dv01", F.col("dv01") - F.avg("dv01").over(w)) if net_zero else out


def target_changes(current: DataFrame, previous: DataFrame, key: str = "bond_id", value: str = "dv01") -> DataFrame:
    """Change per key over the union of both, null counting as nothing."""
    a, b = current.select(key, F.col(value).alias("new")), previous.select(key, F.col(value).alias("old"))
    out = a.join(b, key, "full").fillna(0.0, ["new", "old"])
    return out.withColumn("change", F.col("new") - F.col("old")).withColumn("pct", F.when(F.col("old") != 0, F.col("change") / F.abs("old")))


def strategy_signals(df: DataFrame, ts: str, ids: Sequence[str], weights: Sequence[float] = (1.0, -2.0, 1.0), signal: str = "signal", z: str = "zscore", strength: str | None = "strength", name: Column | None = None, gross: float | None = None) -> DataFrame:
    """Rows of a signal as nested strategy signals: timestamp, strategy_id, legs, direction, signal_value, target_gross_dv01, confidence.

    ids: columns with the legs' bonds; the name defaults to fly_<ids>.
    """
    legs = F.array(*(F.struct(F.col(i).cast("string").alias("bond_id"), F.lit(float(w)).alias("weight")) for i, w in zip(ids, weights, strict=True)))
    name = name if name is not None else F.concat_ws("_", F.lit("fly"), *(F.col(i).cast("string") for i in ids))
    confidence = F.col(strength).cast("double") if strength else F.lit(None).cast("double")
    return df.select(F.col(ts).alias("timestamp"), name.alias("strategy_id"), legs.alias("legs"), F.col(signal).cast("int").alias("direction"), F.col(z).cast("double").alias("signal_value"), F.lit(gross).cast("double").alias("target_gross_dv01"), confidence.alias("confidence"))


def chosen_signals(signals: DataFrame, strategies: Sequence[str] | None = None, direction: int | None = None, active: bool = False) -> DataFrame:
    """Signals of given strategies, of one direction, or those that are not flat."""
    if strategies is not None:
        signals = signals.where(F.col("strategy_id").isin(list(strategies)))
    if direction is not None:
        signals = signals.where(F.col("direction") == direction)
    return signals.where("direction <> 0") if active else signals


def cov_of_correlations(df: DataFrame, key: str, r: str, corr: DataFrame) -> DataFrame:
    """(a, b, value): pairwise correlations times each key's own deviation, on whatever dates it has."""
    std = df.groupBy(F.col(key).alias("_k")).agg(F.stddev_samp(r).alias("_s"))
    a, b = std.select(F.col("_k").alias("a"), F.col("_s").alias("_sa")), std.select(F.col("_k").alias("b"), F.col("_s").alias("_sb"))
    return corr.join(a, "a").join(b, "b").select("a", "b", (F.col("corr") * F.col("_sa") * F.col("_sb")).alias("value"))


def weight_faults(weights: DataFrame, by: Sequence[str] = (), weight: str = "weight", tolerance: float = 1e-6) -> DataFrame:
    """Per portfolio: missing and negative weights, their sum, and whether all is well."""
    w = F.col(weight)
    missing = F.coalesce(F.isnan(w) | w.isNull(), F.lit(True))
    out = weights.groupBy(*by).agg(F.sum(missing.cast("long")).alias("n_missing"), F.sum((~missing & (w < 0)).cast("long")).alias("n_negative"), F.coalesce(F.sum(F.when(~missing, w)), F.lit(0.0)).alias("total"))
    return out.withColumn("is_valid", (F.col("n_missing") == 0) & (F.col("n_negative") == 0) & (F.abs(F.col("total") - 1) <= tolerance))
