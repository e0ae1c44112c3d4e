"""Return, risk and trade metrics as aggregates over series of any number of keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sharpe(r: Column, year: float = 252, floor: float = 1e-10) -> Column:
    """mean / sample std * sqrt(year), 0 where the deviation is below the floor."""
    std = F.stddev_samp(r)
    return F.when(std > floor, F.avg(r) / F.nullif(std, F.lit(0.0)) * math.sqrt(year)).otherwise(0.0)


def sortino(r: Column, year: float = 252, mar: float = 0.0) -> Column:
    """mean excess over the deviation of what falls short of it."""
    down = F.stddev_samp(F.least(r - mar, F.lit(0.0)))
    return (F.avg(r) - mar) / F.nullif(down, F.lit(0.0)) * math.sqrt(year)


def profit_factor(r: Column) -> Column:
    """Gains over losses; infinite without losses, 0 without either."""
    up, down = F.sum(F.greatest(r, F.lit(0.0))), F.sum(F.greatest(-r, F.lit(0.0)))
    return F.when(down > 0, up / F.nullif(down, F.lit(0.0))).when(up > 0, F.lit(math.inf)).otherwise(0.0)


def bias_corrected(n: Column, skew: Column, kurt: Column) -> tuple[Column, Column]:
    """Population skew and excess kurtosis with the usual small-sample corrections."""
    n = n.cast("double")
    s = F.when(n > 2, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * skew)
    k = F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * kurt + 6))
    return s, k


def return_metrics(df: DataFrame, by: Sequence[str], ts: str, r: str, year: float = 252, window: int = 21) -> DataFrame:
    """Per key: return, volatility, Sharpe, Sortino, hit rate, profit factor, wins and losses, tails, drawdown, worst window, turnover proxy."""
    order = Window.partitionBy(*by).orderBy(ts)
    x = F.col(r)
    grown = F.product(1 + x).over(order.rowsBetween(Window.unboundedPreceding, 0))
    frame = order.rowsBetween(-(window - 1), 0)
    rows = df.where(x.isNotNull()).select(*by, ts, r, grown.alias("_eq"), F.when(F.count(F.lit(1)).over(frame) >= window, F.product(1 + x).over(frame) - 1).alias("_w"), F.abs(x - F.lag(r).over(order)).alias("_d"))
    rows = rows.withColumn("_dd", F.col("_eq") / F.max("_eq").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    win, loss = F.when(x > 0, x), F.when(x < 0, x)
    skew, kurt = bias_corrected(F.count(r), F.skewness(r), F.kurtosis(r))
    out = rows.groupBy(*by).agg(
        F.count(r).alias("n"), (F.avg(r) * year).alias("annual_return"), (F.stddev_samp(r) * math.sqrt(year)).alias("annual_vol"), sharpe(x, year).alias("sharpe"),
        sortino(x, year).alias("sortino"), (F.stddev_samp(F.least(x, F.lit(0.0))) * math.sqrt(year)).alias("downside"), F.avg((x > 0).cast("double")).alias("hit_rate"),
        profit_factor(x).alias("profit_factor"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), skew.alias("skew"), kurt.alias("kurtosis"),
        F.percentile(r, F.lit(0.05)).alias("q05"), F.min("_dd").alias("max_drawdown"), F.min("_w").alias("worst_window"), F.avg("_d").alias("turnover_proxy"),
    )
    tail = rows.join(out.select(*by, "q05"), list(by)).where(x <= F.col("q05")).groupBy(*by).agg(F.avg(r).alias("cvar05"))
    return out.join(tail, list(by), "left")


def newey_west(df: DataFrame, by: Sequence[str], ts: str, r: str, lags: int = 5) -> DataFrame:
    """HAC t-statistic of the mean with Bartlett weights."""
    w = Window.partitionBy(*by)
    order = w.orderBy(ts)
    rows = df.where(F.col(r).isNotNull()).select(*by, ts, (F.col(r) - F.avg(r).over(w)).alias("_u"), F.avg(r).over(w).alias("_m"))
    rows = rows.select("*", *((F.col("_u") * F.lag("_u", k).over(order)).alias(f"_c{k}") for k in range(1, lags + 1)))
    n = F.count(F.lit(1))
    s = F.sum(F.col("_u") * F.col("_u")) / n
    for k in range(1, lags + 1):
        s = s + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"_c{k}"), F.lit(0.0)) / n
    return rows.groupBy(*by).agg(n.alias("n"), F.first("_m").alias("mean"), s.alias("_s")).select(*by, "n", "mean", F.when(F.col("_s") > 0, F.col("mean") / F.sqrt(F.col("_s") / F.col("n"))).alias("t_stat"))


def positive_years(df: DataFrame, by: Sequence[str], ts: str, r: str) -> DataFrame:
    """Share of calendar years with a positive compounded return."""
    years = df.where(F.col(r).isNotNull()).groupBy(*by, F.year(ts).alias("_y")).agg((F.product(1 + F.col(r)) - 1).alias("_g"))
    return years.groupBy(*by).agg(F.avg((F.col("_g") > 0).cast("double")).alias("positive_years"), F.count(F.lit(1)).alias("years"))


def drawdown(df: DataFrame, by: Sequence[str], ts: str, pnl: str) -> DataFrame:
    """Largest fall of cumulative P&L below its peak, in currency, and the longest run of rows below it."""
    order = Window.partitionBy(*by).orderBy(ts)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(*by, ts, F.sum(pnl).over(upto).alias("_cum"))
    rows = rows.withColumn("_dd", F.max("_cum").over(upto) - F.col("_cum"))
    rows = rows.withColumn("_run", F.sum((F.col("_dd") <= 0).cast("int")).over(upto))
    runs = rows.groupBy(*by, "_run").agg(F.sum((F.col("_dd") > 0).cast("long")).alias("_len"), F.max("_dd").alias("_dd"))
    return runs.groupBy(*by).agg(F.max("_dd").alias("max_drawdown"), F.max("_len").alias("longest_below"))


def position_runs(df: DataFrame, by: Sequence[str], ts: str, position: str) -> DataFrame:
    """Runs of one position: run, first and last stamp, rows."""
    order = Window.partitionBy(*by).orderBy(ts)
    rows = df.withColumn("_new", F.coalesce((F.col(position) != F.lag(position).over(order)).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "run").agg(F.first(position).alias("position"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("rows"))


def trade_metrics(df: DataFrame, by: Sequence[str], ts: str, position: str) -> DataFrame:
    """Number of position changes and the mean length of runs that hold something."""
    runs = position_runs(df, by, ts, position)
    return runs.groupBy(*by).agg((F.count(F.lit(1)) - 1).alias("n_changes"), F.avg(F.when(F.col("position") != 0, F.col("rows"))).alias("avg_holding"))


def annual_turnover(traded: Column, gross: Column, year: float = 252) -> Column:
    """Traded over mean positive gross, per year."""
    mean_gross = F.avg(F.when(gross > 0, gross))
    return F.coalesce(F.avg(traded) / F.nullif(mean_gross, F.lit(0.0)) * year, F.lit(0.0))


def bars_per_year(df: DataFrame, ts: str, days: int = 252) -> DataFrame:
    """Median bars of a day times the days of a year."""
    per_day = df.groupBy(F.to_date(ts).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    return per_day.agg((F.percentile("_n", F.lit(0.5)) * days).cast("long").alias("bars_per_year"))


def regime_diagnostics(df: DataFrame, by: Sequence[str], ts: str, regime: str, r: str, position: str, year: float = 252) -> DataFrame:
    """Per regime: share of rows, P&L, Sharpe, and entries (a move from flat to a position)."""
    order = Window.partitionBy(*by).orderBy(ts) if by else Window.orderBy(ts)
    rows = df.withColumn("_in", (F.col(position) != 0) & (F.coalesce(F.lag(position).over(order), F.lit(0)) == 0))
    out = rows.groupBy(regime).agg(F.count(F.lit(1)).alias("n"), F.sum(r).alias("pnl"), sharpe(F.col(r), year).alias("sharpe"), F.sum(F.col("_in").cast("long")).alias("entries"))
    total = F.broadcast(out.agg(F.sum("n").alias("_all")))  # one row
    return out.join(total, F.lit(True)).select(regime, "n", (F.col("n") / F.col("_all")).alias("share"), "pnl", "sharpe", "entries")
