"""Seeded generators of research inputs: every draw is a hash of seed, series and step, so plans do not change rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import Axis
from .panels import time_grid


def uniform(seed: int, *keys: str | Column) -> Column:
    """A draw from (0, 1) that depends on the seed and the keys only."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *keys: str | Column) -> Column:
    """A standard normal draw by the polar formula on two uniforms."""
    return F.sqrt(-2 * F.log(uniform(2 * seed + 1, *keys))) * F.cos(2 * math.pi * uniform(2 * seed + 2, *keys))


def grid(spark: SparkSession, ids: Sequence[str], start: str, periods: int, step: str, key: str = "instrument_id") -> DataFrame:
    return time_grid(spark, start, periods, step).select("*", F.explode(F.array(*(F.lit(x) for x in ids))).alias(key))


def mid_prices(spark: SparkSession, ids: Sequence[str], start: str = "2024-01-01 09:00:00", periods: int = 1000, step: str = "5 minutes", seed: int = 7, base: float = 100.0, common: float = 0.01, own: float = 0.006) -> DataFrame:
    """Random walks with a common and an own part."""
    rows = grid(spark, ids, start, periods, step)
    w = Window.partitionBy("instrument_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    move = common * normal(seed, "i") + own * normal(seed + 1, "instrument_id", "i")
    return rows.select("i", "datetime", "instrument_id", (base + F.sum(move).over(w)).alias("mid_px"))


def books(mids: DataFrame, levels: int = 5, spread: float = 0.01, step: float = 0.005, size: float = 100.0, seed: int = 7) -> DataFrame:
    """Symmetric wide books around the mids with noisy sizes of at least one."""
    cols = []
    for k in range(levels):
        for side, sign in (("bid", -1), ("ask", 1)):
            cols.append((F.col("mid_px") + sign * (spread / 2 + k * step)).alias(f"{side}_px_l{k}"))
            cols.append(F.greatest(F.lit(1.0), F.bround(size * (1 + 0.3 * k) * (1 + 0.2 * normal(seed + 10 * k + sign + 3, "instrument_id", "i")), 0)).alias(f"{side}_sz_l{k}"))
    return mids.select("datetime", "instrument_id", *cols)


def market_sources(spark: SparkSession, folder: str, ids: Sequence[str], ref: str, periods: int = 1000, levels: int = 5, missing: float = 0.02, seed: int = 7) -> None:
    """The five sources of one reference (mid, dv01, book, signal, hedge_ratios) as Parquet, with rows left out at random."""
    mids = mid_prices(spark, ids, periods=periods, seed=seed)
    place = F.array_position(F.array(*(F.lit(x) for x in ids)), F.col("instrument_id")) - 1
    axis = Axis(("i",), ("instrument_id",))
    others = [x for x in ids if x != ref]
    tables = {
        "mid": mids.select("datetime", "instrument_id", "mid_px"),
        "dv01": mids.select("datetime", "instrument_id", F.greatest(F.lit(1e-6), 0.05 + 0.01 * place + 0.0005 * normal(seed + 40, "instrument_id", "i")).alias("dv01")),
        "book": books(mids, levels, seed=seed + 50),
        "signal": mids.where(F.col("instrument_id") == ref).select("datetime", "instrument_id", F.coalesce((F.col("mid_px") - axis.mean("mid_px", 50, 2, 0)) / axis.std("mid_px", 50, 2, 0), F.lit(0.0)).alias("zscore"), F.lit(2.0).alias("expected_yield_pnl_bps"), (100 - F.col("mid_px")).alias("package_yield_bps")),
        "hedge_ratios": mids.where(F.col("instrument_id") == ref).select("datetime", "instrument_id", F.array(*(F.lit(x) for x in others)).alias("hedge_instruments"), F.array(*(F.lit(-1.0 / len(others)) for _ in others)).alias("hedge_ratios")),
    }
    for k, (name, df) in enumerate(tables.items()):
        df.where(uniform(seed + 60 + k, "instrument_id", F.unix_micros("datetime")) >= missing).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def market_panel(spark: SparkSession, ids: Sequence[str], periods: int = 1000, step: str = "1 hour", seed: int = 42, vol: float = 0.02, flow_strength: float = 0.1, switch: float = 0.005) -> DataFrame:
    """close, volume and flow per asset: drift regimes, an AR(1) flow, and a flow effect a step later."""
    rows = grid(spark, ids, "2023-01-01 00:00:00", periods, step, "asset").select("i", "datetime", "asset", normal(seed, "asset", "i").alias("_e"), normal(seed + 1, "asset", "i").alias("_f"), uniform(seed + 2, "asset", "i").alias("_u"), uniform(seed + 3, "asset", "i").alias("_v"))

    def walk(x: pd.DataFrame) -> dict:
        n, drift, flow, price = len(x), 0.0, 0.0, 100.0
        close, flows = np.empty(n), np.empty(n)
        for t, (e, f, u) in enumerate(zip(x["_e"], x["_f"], x["_u"], strict=True)):
            if u < switch:
                drift = (u / switch - 0.5) * vol * 0.2
            price *= math.exp(drift + flow_strength * vol * flow + vol * e)
            flow = 0.7 * flow + 0.3 * f
            close[t], flows[t] = price, flow
        return {"close": close, "flow_imbalance": np.tanh(flows)}

    out = Axis(("i",), ("asset",)).fold(rows, walk, "close double, flow_imbalance double")
    return out.select("datetime", "asset", "close", (1000 + 4000 * F.col("_v")).alias("volume"), "flow_imbalance")


def planted_signal(spark: SparkSession, ids: Sequence[str], periods: int = 500, lag: int = 1, strength: float = 0.3, seed: int = 42) -> DataFrame:
    """A panel whose returns follow a signal ``lag`` steps ago with the given strength."""
    rows = grid(spark, ids, "2023-01-01 00:00:00", periods, "1 hour", "asset").withColumn("signal", normal(seed, "asset", "i"))
    axis = Axis(("i",), ("asset",))
    ret = 0.01 * (strength * F.coalesce(axis.lag("signal", lag), F.lit(0.0)) + math.sqrt(1 - strength**2) * normal(seed + 1, "asset", "i"))
    rows = rows.withColumn("_r", ret)
    return rows.select("datetime", "asset", "signal", (100 * F.exp(F.sum("_r").over(axis.frame(None)))).alias("close"))


def mean_reverting(spark: SparkSession, ids: Sequence[str], periods: int = 500, theta: float = 0.1, mu: float = 0.0, sigma: float = 1.0, seed: int = 1) -> DataFrame:
    """Mean-reverting paths x[t] = x[t-1] + theta (mu - x[t-1]) + sigma e."""
    rows = grid(spark, ids, "2023-01-01 00:00:00", periods, "1 hour", "series").withColumn("_e", normal(seed, "series", "i"))

    def walk(x: pd.DataFrame) -> dict:
        out, at = np.empty(len(x)), mu
        for t, e in enumerate(x["_e"]):
            at += theta * (mu - at) + sigma * e
            out[t] = at
        return {"value": out}

    return Axis(("i",), ("series",)).fold(rows, walk, "value double").select("datetime", "series", "value")


def drifting(spark: SparkSession, ids: Sequence[str], periods: int = 500, drift: float = 0.01, sigma: float = 1.0, seed: int = 1) -> DataFrame:
    """Random walks with drift: a running sum, no fold."""
    rows = grid(spark, ids, "2023-01-01 00:00:00", periods, "1 hour", "series")
    w = Window.partitionBy("series").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("datetime", "series", F.sum(drift + sigma * normal(seed, "series", "i")).over(w).alias("value"))
