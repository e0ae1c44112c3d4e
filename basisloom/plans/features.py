"""The feature registry: named builders that append columns to a panel, and a report on them."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import windows as win
from ..functions.windows import Axis, safe_divide

Builder = Callable[..., DataFrame]
FEATURES: dict[str, Builder] = {}


def feature(name: str):
    """Register a builder (df, axis, **parameters) -> df with new columns."""

    def add(fn: Builder) -> Builder:
        if name in FEATURES:
            raise ValueError(f"feature {name} exists")
        FEATURES[name] = fn
        return fn

    return add


def build(df: DataFrame, axis: Axis, specs: Sequence[tuple[str, dict]]) -> DataFrame:
    """All features of a list of (name, parameters); Catalyst merges windows with one frame."""
    for name, params in specs:
        if name not in FEATURES:
            raise KeyError(f"no feature {name}; there are {sorted(FEATURES)}")
        wanted = [v for k, v in params.items() if k in ("price", "volume", "buy", "sell", "value", "ts")]
        if missing := [c for c in wanted if c not in df.columns]:
            raise ValueError(f"feature {name} needs columns {missing}")
        df = FEATURES[name](df, axis, **params)
    return df


def report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: rows, share of nulls, mean, deviation and extremes, in one aggregation."""
    row = df.agg(*(F.struct(F.count(F.lit(1)).alias("n"), (1 - F.count(c) / F.count(F.lit(1))).alias("null_rate"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in columns))).alias("r")).select("r.feature", "r.s.*")


@feature("returns")
def _returns(df, axis, price="close", periods=1, shift=1, out=None):
    return df.withColumn(out or f"{price}_return_{periods}", axis.pct_change(price, periods, shift))


@feature("log_returns")
def _log_returns(df, axis, price="close", periods=1, shift=1, out=None):
    r = axis.ratio(price, periods, shift)
    return df.withColumn(out or f"{price}_log_return_{periods}", F.log(F.when(r > 0, r)))


@feature("momentum")
def _momentum(df, axis, price="close", window=20, shift=1, out=None):
    return df.withColumn(out or f"{price}_momentum_{window}", axis.pct_change(price, window, shift))


@feature("rolling_volatility")
def _volatility(df, axis, price="close", window=20, shift=1, annualize=False, year=252, out=None):
    rows = df.withColumn("_r", axis.pct_change(price, 1, 0))
    return rows.withColumn(out or f"{price}_volatility_{window}", axis.std("_r", window, shift=shift) * (math.sqrt(year) if annualize else 1.0)).drop("_r")


@feature("volume_shock")
def _shock(df, axis, volume="volume", window=20, shift=1, out=None):
    return df.withColumn(out or f"{volume}_shock_{window}", safe_divide(axis.lag(volume, 0, shift) - axis.mean(volume, window, shift=shift), axis.std(volume, window, shift=shift)))


@feature("rolling_volume")
def _rolling_volume(df, axis, volume="volume", window=20, shift=1, out=None):
    return df.withColumn(out or f"{volume}_mean_{window}", axis.mean(volume, window, shift=shift))


@feature("dollar_volume")
def _dollars(df, axis, price="close", volume="volume", window=20, shift=1, out=None):
    return df.withColumn(out or f"dollar_volume_{window}", axis.mean(F.col(price) * F.col(volume), window, shift=shift))


@feature("volume_ratio")
def _ratio(df, axis, volume="volume", short=5, long=20, shift=1, out=None):
    return df.withColumn(out or f"{volume}_ratio_{short}_{long}", safe_divide(axis.mean(volume, short, shift=shift), axis.mean(volume, long, shift=shift)))


@feature("flow_imbalance")
def _flow(df, axis, buy="buy_volume", sell="sell_volume", window=20, shift=1, out=None):
    b, s = axis.sum(buy, window, shift=shift), axis.sum(sell, window, shift=shift)
    return df.withColumn(out or f"flow_imbalance_{window}", safe_divide(b - s, b + s))


@feature("signed_volume")
def _signed(df, axis, price="close", volume="volume", window=20, shift=1, out=None):
    rows = df.withColumn("_s", F.signum(F.col(price) - axis.lag(price)) * F.col(volume))
    return rows.withColumn(out or f"signed_volume_{window}", axis.sum("_s", window, shift=shift)).drop("_s")


@feature("volume_imbalance")
def _imbalance(df, axis, price="close", volume="volume", window=20, shift=1, out=None):
    rows = df.withColumn("_d", F.col(price) - axis.lag(price))
    rows = rows.withColumn("_u", F.when(F.col("_d") > 0, F.col(volume)).when(F.col("_d") < 0, -F.col(volume)).otherwise(0.0))
    total = axis.sum(volume, window, shift=shift)
    return rows.withColumn(out or f"volume_imbalance_{window}", safe_divide(axis.sum("_u", window, shift=shift), total)).drop("_d", "_u")


@feature("cross_rank")
def _cross_rank(df, axis, value="close", ts="datetime", shift=1, pct=True, out=None):
    rows = df.withColumn("_v", axis.lag(value, 0, shift))
    return rows.withColumn(out or f"{value}_rank", win.cross_rank("_v", [ts], pct)).drop("_v")


@feature("cross_zscore")
def _cross_zscore(df, axis, value="close", ts="datetime", shift=1, out=None):
    rows = df.withColumn("_v", axis.lag(value, 0, shift))
    return rows.withColumn(out or f"{value}_zscore", win.cross_zscore("_v", [ts])).drop("_v")


@feature("cross_demean")
def _cross_demean(df, axis, value="close", ts="datetime", shift=1, out=None):
    rows = df.withColumn("_v", axis.lag(value, 0, shift))
    return rows.withColumn(out or f"{value}_demeaned", win.cross_demean("_v", [ts])).drop("_v")


@feature("calendar")
def _calendar(df, axis, ts="datetime", hour=False):
    return df.withColumns(cal.time_features(F.col(ts), hour))


@feature("cyclical")
def _cyclical(df, axis, ts="datetime", component="day_of_week"):
    return df.withColumns(cal.cyclical(F.col(ts), component))


@feature("ewma")
def _ewma(df, axis, value="close", span=20, shift=1, out=None):
    return win.ewma(axis, df, value, out or f"{value}_ewma_{span}", span=span, shift=shift)


def default_specs(price: str = "close", volume: str | None = None, windows: Sequence[int] = (5, 20, 60)) -> list[tuple[str, dict]]:
    """Returns, then momentum, volatility and volume features for each window."""
    specs: list[tuple[str, dict]] = [("returns", {"price": price}), ("log_returns", {"price": price})]
    for w in windows:
        specs += [("momentum", {"price": price, "window": w}), ("rolling_volatility", {"price": price, "window": w})]
        if volume:
            specs += [("volume_shock", {"volume": volume, "window": w}), ("rolling_volume", {"volume": volume, "window": w})]
    return specs


def supervised(df: DataFrame, axis: Axis, specs: Sequence[tuple[str, dict]], price: str, horizons: Sequence[int] = (1,), method: str = "log_return", dropna: bool = True) -> tuple[DataFrame, list[str], list[str]]:
    """Features and targets side by side: the table, its feature columns and its target columns."""
    before = set(df.columns)
    rows = build(df, axis, specs)
    made = [c for c in rows.columns if c not in before]
    targets = win.forward_targets(axis, price, horizons, method)
    rows = rows.withColumns(targets)
    return (rows.dropna(subset=[*made, *targets]) if dropna else rows), made, list(targets)
