"""Signals: mean reversion and momentum scores, position state machines, trades and regimes.

Recurrences with a closed form are windows; the others are ordered folds over one
series (the unit of work), written once as a step over plain values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import Axis, clipped, robust_zscore, safe_divide, zscore

#: Exit reasons.
NONE, EXIT, STOP, MAX_HOLD, BLOCKED = 0, 1, 2, 3, 4
MEAN_REVERT, TREND, UNCERTAIN = "mean_revert", "trend", "uncertain"


@dataclass(frozen=True)
class ReversionRule:
    """Enter long at z <= -entry and short at z >= entry; leave inside exit, beyond stop, or after max_hold rows."""

    entry: float = 2.0
    exit: float = 0.5
    stop: float | None = 4.0
    max_hold: int | None = None
    cooldown: int = 0
    cooldown_z: float | None = None


def reversion_step(state: int, age: int, wait: int, x: float, rule: ReversionRule) -> tuple[int, int, int, int]:
    """One row: (position, rows held, cooldown left, exit reason).  A missing score holds the state; the cooldown counts flat rows."""
    if math.isnan(x):
        return state, age + (state != 0), wait, NONE
    if state:
        age += 1
        why = NONE
        if state * x >= -rule.exit:
            why = EXIT
        elif rule.stop is not None and state * x <= -rule.stop:
            why = STOP
        elif rule.max_hold is not None and age >= rule.max_hold:
            why = MAX_HOLD
        return (0, 0, rule.cooldown, why) if why else (state, age, wait, NONE)
    if wait > 0:
        return 0, 0, 0 if rule.cooldown_z is not None and abs(x) <= rule.cooldown_z else wait - 1, NONE
    return (1 if x <= -rule.entry else -1 if x >= rule.entry else 0), 0, 0, NONE


#: Series of a batch from which on a row of all series is worked on at once.
MANY_SERIES = 32


def reversion_states(z: np.ndarray, rule: ReversionRule, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, exit reason and rows held of series that lie one after another between ``edges``.

    Few long series are walked row by row; of many series the first rows are done
    together, then the second ones, and so on.  Both give the same rows.
    """
    n = len(z)
    edges = np.array([0, n]) if edges is None else edges
    position, reason, held = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    if len(edges) - 1 < MANY_SERIES:
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            state = age = wait = 0
            for i, x in enumerate(z[a:b].tolist(), a):
                state, age, wait, reason[i] = reversion_step(state, age, wait, x, rule)
                position[i], held[i] = state, age
        return position, reason, held
    size = np.diff(edges)
    order = np.argsort(-size, kind="stable")
    start, size = edges[:-1][order], size[order]
    state, age, wait = (np.zeros(len(size), np.int64) for _ in range(3))
    stop, most, calm = (np.inf if v is None else v for v in (rule.stop, rule.max_hold, rule.cooldown_z))
    calm = -1.0 if rule.cooldown_z is None else calm
    for j in range(int(size[0])):
        m = int(np.searchsorted(-size, -j))  # the series that have a row j
        at, s, w = start[:m] + j, state[:m], wait[:m]
        x = z[at]
        seen, inside = ~np.isnan(x), s != 0
        age[:m] += inside
        lean = s * x
        out = inside & seen & (lean >= -rule.exit)
        lost = inside & seen & ~out & (lean <= -stop)
        late = inside & seen & ~out & ~lost & (age[:m] >= most)
        why = np.where(out, EXIT, np.where(lost, STOP, np.where(late, MAX_HOLD, NONE)))
        flat = ~inside & seen
        waits = flat & (w > 0)
        wait[:m] = np.where(why > 0, rule.cooldown, np.where(waits, np.where(np.abs(x) <= calm, 0, w - 1), w))
        enter = flat & ~waits
        state[:m] = np.where(why > 0, 0, np.where(enter, np.where(x <= -rule.entry, 1, np.where(x >= rule.entry, -1, 0)), s))
        age[:m][why > 0] = 0
        position[at], reason[at], held[at] = state[:m], why, age[:m]
    return position, reason, held


def mean_reversion_signal(df: DataFrame, axis: Axis, z: str, rule: ReversionRule = ReversionRule()) -> DataFrame:
    """``signal``, ``exit_reason`` and ``bars_held`` of the reversion state machine over each series."""

    def step(rows: pd.DataFrame, edges: np.ndarray) -> dict:
        p, r, h = reversion_states(rows[z].to_numpy(float, na_value=np.nan), rule, edges)
        return {"signal": p, "exit_reason": r, "bars_held": h}

    return axis.fold(df, step, "signal int, exit_reason int, bars_held int", together=True)


def gated_positions(df: DataFrame, axis: Axis, z: str, can_trade: str, rule: ReversionRule = ReversionRule()) -> DataFrame:
    """``position``: state changes only on tradeable rows; stop, exit and direct reversal."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        x, ok = rows[z].to_numpy(float, na_value=np.nan), rows[can_trade].fillna(False).to_numpy(bool)
        out, state = np.zeros(len(x), np.int32), 0
        for i in range(len(x)):
            if ok[i] and not math.isnan(x[i]):
                side = 1 if x[i] <= -rule.entry else -1 if x[i] >= rule.entry else 0
                stopped = rule.stop is not None and abs(x[i]) >= rule.stop
                if state == 0:
                    state = 0 if stopped else side
                elif stopped or (state > 0 and x[i] >= -rule.exit and side >= 0) or (state < 0 and x[i] <= rule.exit and side <= 0):
                    state = 0
                elif side == -state:
                    state = side
            out[i] = state
        return pd.DataFrame({"position": out})

    return axis.fold(df, step, "position int")


def regime_gate(df: DataFrame, axis: Axis, signal: str, regime: str, allowed: tuple[str, ...] = (MEAN_REVERT,), exit_on_change: bool = False) -> DataFrame:
    """``gated``: positions open only in allowed regimes; optionally closed when the regime leaves them."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        out, state = np.zeros(len(rows), np.int32), 0
        for i, (s, r) in enumerate(zip(rows[signal].fillna(0).astype(int), rows[regime], strict=True)):
            inside = r in allowed
            if s == 0:
                state = 0
            elif s != state:
                state = s if inside else (0 if state != s else state)
            elif exit_on_change and not inside:
                state = 0
            out[i] = state
        return pd.DataFrame({"gated": out})

    return axis.fold(df, step, "gated int")


def hysteresis(axis: Axis, score: Column, theta: float, allow_flat: bool = False) -> Column:
    """+1 above theta, -1 below -theta, in between the last one (or flat): a closed form, no fold."""
    side = F.when(score > theta, 1).when(score < -theta, -1)
    return F.coalesce(side, F.lit(0)) if allow_flat else F.coalesce(F.last(side, ignorenulls=True).over(axis.frame(None)), F.lit(0))


def confirmed(axis: Axis, flag: Column, n: int) -> Column:
    """Whether the last n rows all hold."""
    w = axis.frame(n)
    return (F.count(F.lit(1)).over(w) >= n) & (F.min(F.coalesce(flag, F.lit(False)).cast("int")).over(w) == 1)


def signal_strength(z: Column, signal: Column, most: float = 4.0) -> Column:
    return F.when((signal != 0) & z.isNotNull(), F.least(F.abs(z) / most, F.lit(1.0))).otherwise(0.0)


def threshold_position(score: Column, threshold: float = 0.0, clip: float | None = None, discrete: bool = True) -> Column:
    """-1, 0 or 1 beyond the threshold; or the score with its dead zone, clipped."""
    s = F.coalesce(score, F.lit(0.0))
    if discrete:
        return F.when(s > threshold, 1.0).when(s < -threshold, -1.0).otherwise(0.0)
    return clipped(F.when(F.abs(s) > threshold, s).otherwise(0.0), clip)


def combine(scores: list[Column], weights: list[float] | None = None, vote: bool = False) -> Column:
    """Weighted mean, or the sign of the sum of signs; missing scores count as 0."""
    parts = [F.coalesce(s, F.lit(0.0)) for s in scores]
    if vote:
        return F.signum(sum((F.signum(p) for p in parts), F.lit(0.0)))
    weights = weights or [1.0] * len(parts)
    return sum((p * w for p, w in zip(parts, weights, strict=True)), F.lit(0.0)) / sum(weights)


def momentum(axis: Axis, c: str, lookback: int, skip: int = 0, log: bool = False) -> Column:
    """Change (or log ratio) over ``lookback`` rows, ``skip`` rows ago."""
    now, then = axis.lag(c, skip), axis.lag(c, lookback + skip)
    return F.log(F.when((now > 0) & (then > 0), now / then)) if log else now - then


def breakout(axis: Axis, c: str, window: int) -> Column:
    """+1 above the maximum of the rows before, -1 below their minimum, else 0."""
    x = F.col(c)
    return F.when(x > axis.max(c, window, window, 1), 1).when(x < axis.min(c, window, window, 1), -1).otherwise(0)


def trend(df: DataFrame, axis: Axis, c: str, window: int) -> DataFrame:
    """Rolling regression on time: trend_slope, trend_r2, signed trend_strength; windows with a gap give null."""
    rows = df.withColumn("_i", F.row_number().over(axis.spec).cast("double"))
    w = axis.frame(window)
    full = F.count(c).over(w) == window
    rows = rows.withColumn("trend_slope", F.when(full, F.regr_slope(F.col(c), F.col("_i")).over(w)))
    rows = rows.withColumn("trend_r2", F.when(full, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.regr_r2(F.col(c), F.col("_i")).over(w)))))
    return rows.withColumn("trend_strength", F.signum("trend_slope") * F.col("trend_r2")).drop("_i")


def oscillators(df: DataFrame, axis: Axis, c: str, fast: int = 12, slow: int = 26, signal: int = 9, rsi: int = 14) -> DataFrame:
    """ema_fast, ema_slow, macd, macd_signal, macd_hist and rsi in one fold."""
    if fast >= slow:
        raise ValueError("the fast span must be shorter than the slow one")

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[c].astype(float)
        f, s = x.ewm(span=fast, adjust=False).mean(), x.ewm(span=slow, adjust=False).mean()
        line = f - s
        sig = line.ewm(span=signal, adjust=False).mean()
        d = x.diff()
        up, down = d.clip(lower=0).ewm(span=rsi, adjust=False).mean(), (-d.clip(upper=0)).ewm(span=rsi, adjust=False).mean()
        return pd.DataFrame({"ema_fast": f, "ema_slow": s, "macd": line, "macd_signal": sig, "macd_hist": line - sig, "rsi": 100 - 100 / (1 + up / down.where(down != 0))})

    return axis.fold(df, step, "ema_fast double, ema_slow double, macd double, macd_signal double, macd_hist double, rsi double")


def directional(df: DataFrame, axis: Axis, high: str, low: str, close: str, window: int = 14) -> DataFrame:
    """plus_di, minus_di and adx of a high/low/close series."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        h, lo, c = (rows[x].astype(float) for x in (high, low, close))
        before = c.shift()
        true_range = pd.concat([h - lo, (h - before).abs(), (lo - before).abs()], axis=1).max(axis=1)
        up, down = h.diff(), -lo.diff()
        smooth = lambda x: x.ewm(span=window, adjust=False).mean()
        atr = smooth(true_range)
        plus = 100 * smooth(up.where((up > down) & (up > 0), 0.0)) / atr.where(atr != 0)
        minus = 100 * smooth(down.where((down > up) & (down > 0), 0.0)) / atr.where(atr != 0)
        total = plus + minus
        return pd.DataFrame({"plus_di": plus, "minus_di": minus, "adx": smooth(100 * (plus - minus).abs() / total.where(total != 0))})

    return axis.fold(df, step, "plus_di double, minus_di double, adx double")


def ewma_zscore(df: DataFrame, axis: Axis, c: str, span: int, out: str = "z", clip: float | None = None, min_periods: int = 1, eps: float = 1e-12) -> DataFrame:
    """(x - EW mean) / EW deviation (bias-corrected), the deviation floored."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[c].astype(float)
        e = x.ewm(span=span, min_periods=min_periods)
        z = (x - e.mean()) / e.std().clip(lower=eps)
        return pd.DataFrame({out: z.clip(-clip, clip) if clip is not None else z})

    return axis.fold(df, step, f"`{out}` double")


def signal_frame(df: DataFrame, axis: Axis, c: str, window: int = 20, robust: bool = False, clip: float | None = 4.0, rule: ReversionRule = ReversionRule()) -> DataFrame:
    """z-score, reversion signal and strength of a value."""
    z = robust_zscore(axis, c, window, clip=clip) if robust else zscore(axis, c, window, clip=clip)
    out = mean_reversion_signal(df.withColumn("zscore", z), axis, "zscore", rule)
    return out.withColumn("strength", signal_strength(F.col("zscore"), F.col("signal")))


def signal_backtest(df: DataFrame, axis: Axis, signal: str, value: str, cost: float = 0.0) -> DataFrame:
    """position = the signal a row ago; pnl = position times the change of the value less cost per unit of change."""
    rows = df.withColumn("position", F.coalesce(axis.lag(signal), F.lit(0)).cast("double"))
    change = F.coalesce(F.col(value) - axis.lag(value), F.lit(0.0))
    rows = rows.withColumn("gross", F.col("position") * change)
    rows = rows.withColumn("cost", F.abs(F.col("position") - F.coalesce(axis.lag("position"), F.lit(0.0))) * cost)
    rows = rows.withColumn("pnl", F.col("gross") - F.col("cost"))
    return rows.withColumn("cum_pnl", F.sum("pnl").over(axis.frame(None)))


def trades(df: DataFrame, axis: Axis, signal: str, z: str, pnl: str | None = None, reason: str | None = None) -> DataFrame:
    """Runs of a non-zero signal as trades: entry and exit stamps, rows, pnl after the entry row, and why they ended.

    The row after a run is its exit; a run at the end of a series stays open.
    """
    ts = axis.order[0]
    rows = df.withColumn("_new", F.coalesce((F.col(signal) != axis.lag(signal)).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(axis.frame(None)))
    rows = rows.withColumn("_next", axis.lead(ts)).withColumn("_why", axis.lead(reason) if reason else F.lit(None).cast("int")).withColumn("_p", axis.lead(pnl) if pnl else F.lit(0.0))
    runs = rows.where(F.col(signal) != 0).groupBy(*axis.by, "_run").agg(
        F.first(signal).alias("side"), F.min(ts).alias("entry"), F.max("_next").alias("exit"), F.max(F.when(F.col("_next").isNull(), 1).otherwise(0)).alias("_open"),
        F.count(F.lit(1)).alias("bars"), F.min_by(z, F.struct(*axis.order)).alias("entry_z"), F.max_by("_why", F.struct(*axis.order)).alias("_why"), F.sum(F.coalesce("_p", F.lit(0.0))).alias("pnl"),
    )
    open_ = F.col("_open") == 1
    return runs.select(*axis.by, "side", "entry", F.when(~open_, F.col("exit")).alias("exit"), "bars", "entry_z", open_.alias("is_open"), F.when(~open_, F.coalesce("_why", F.lit(NONE))).otherwise(NONE).alias("exit_reason"), "pnl")


def trade_summary(blotter: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Trades, win rate, expectancy, profit factor, mean rows held."""
    p = F.col("pnl")
    gain, loss = F.sum(F.greatest(p, F.lit(0.0))), F.sum(F.greatest(-p, F.lit(0.0)))
    return blotter.groupBy(*by).agg(F.count(F.lit(1)).alias("n_trades"), F.avg((p > 0).cast("double")).alias("win_rate"), F.avg(p).alias("expectancy"), F.when(loss > 0, gain / F.nullif(loss, F.lit(0.0))).otherwise(F.lit(math.inf)).alias("profit_factor"), F.avg("bars").alias("avg_bars"))


def regime_features(df: DataFrame, axis: Axis, c: str, window: int = 60) -> DataFrame:
    """Rolling unit-root t-statistic and p-step, AR(1) half-life, and trend, then a label by majority.

    The p-value steps at the usual critical values of the constant-only test
    (fixed values); the first window-1 rows are uncertain.
    """
    rows = df.withColumn("_x", axis.lag(c)).withColumn("_d", F.col(c) - F.col("_x"))
    w = axis.frame(window - 1)  # differences inside the window
    full = F.count("_d").over(w) == window - 1
    sxx, sxy, syy = F.regr_sxx("_d", "_x").over(w), F.regr_sxy("_d", "_x").over(w), F.regr_syy("_d", "_x").over(w)
    g = safe_divide(sxy, sxx)
    se = F.sqrt(F.greatest(syy - g * sxy, F.lit(0.0)) / (window - 3) / F.nullif(sxx, F.lit(0.0)))
    rows = rows.withColumn("adf_t", F.when(full, g / F.nullif(se, F.lit(0.0))))
    t = F.col("adf_t")
    rows = rows.withColumn("adf_p", F.when(t.isNull(), None).when(t < -3.5, 0.01).when(t < -2.9, 0.05).when(t < -2.6, 0.10).when(t < -1.9, 0.30).otherwise(0.80))
    phi = F.when(full, 1 + g)
    rows = rows.withColumn("half_life", F.when((phi > 0) & (phi < 1), -F.log(F.lit(2.0)) / F.log(phi)))
    rows = trend(rows, axis, c, window)
    votes_mr = (F.col("adf_p") < 0.05).cast("int") + (F.col("half_life") < window / 2).cast("int") + (F.col("trend_r2") < 0.3).cast("int")
    votes_tr = (F.col("adf_p") >= 0.3).cast("int") + F.coalesce((F.col("half_life") >= window / 2), F.lit(True)).cast("int") + (F.col("trend_r2") > 0.6).cast("int")
    label = F.when(~full | F.col("adf_p").isNull(), UNCERTAIN).when(F.coalesce(votes_mr, F.lit(0)) >= 2, MEAN_REVERT).when(votes_tr >= 2, TREND).otherwise(UNCERTAIN)
    return rows.withColumn("regime", label).drop("_x", "_d")


def kpss(df: DataFrame, axis: Axis, c: str, out: str = "kpss") -> DataFrame:
    """Per series: level-stationarity statistic with the short-run variance."""
    rows = df.where(F.col(c).isNotNull()).withColumn("_e", F.col(c) - F.avg(c).over(Window.partitionBy(*axis.by)))
    rows = rows.withColumn("_s", F.sum("_e").over(axis.frame(None)))
    n = F.count(F.lit(1))
    return rows.groupBy(*axis.by).agg(n.alias("n"), (F.sum(F.col("_s") * F.col("_s")) / (n * n) / F.nullif(F.sum(F.col("_e") * F.col("_e")) / n, F.lit(0.0))).alias(out))


def rolling_kpss(axis: Axis, c: str, window: int = 60) -> tuple[Column, Column]:
    """(statistic, p-step) of level stationarity over each full frame, with the short-run variance.

    The p-value steps at the test's critical values (fixed values); frames of fewer
    than ten rows or without variance say 0.
    """
    w = axis.frame(window)
    full = F.count(c).over(w) == window
    mean = F.avg(c).over(w)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("ee"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["s"] + x
        return F.struct(s.alias("s"), (acc["ss"] + s * s).alias("ss"), (acc["ee"] + x * x).alias("ee"))

    sums = F.aggregate(F.transform(F.collect_list(c).over(w), lambda v: v - mean), start, add, lambda a: a["ss"] / window / F.nullif(a["ee"], F.lit(0.0)))
    stat = F.when(full, sums)
    p = F.when(stat > 0.739, 0.01).when(stat > 0.463, 0.05).when(stat > 0.347, 0.10).otherwise(0.50)
    return stat, F.when(full, F.when(stat.isNull() | F.lit(window < 10), 0.0).otherwise(p))


#: Response surfaces of the unit-root distribution (fixed values): the statistic's smallest and largest value, where the
#: tail polynomial takes over, polynomials of both parts, and critical values at 1, 5 and 10 % in powers of 1 / n.
UNIT_ROOT = {
    "n": (-19.04, 1.51, -1.04, (0.6344, 1.2378, 0.032496), (0.4797, 0.93557, -0.06999, 0.033066), ((-2.56574, -2.2358, -3.627, 0.0), (-1.94100, -0.2686, -3.365, 31.223), (-1.61682, 0.2656, -2.714, 25.364))),
    "c": (-18.83, 2.74, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0))),
    "ct": (-16.18, 0.7, -2.89, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285), ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.380))),
}


def unit_root_p(t: float, trend: str = "c") -> float:
    """p-value of the unit-root statistic."""
    least, most, join, tail, body, _ = UNIT_ROOT[trend]
    if not least < t <= most:
        return float(t > most)
    z = sum(b * t**i for i, b in enumerate(tail if t <= join else body))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _unit_root(x: np.ndarray, maxlag: int | None, criterion: str | None, trend: str) -> tuple[float, int, int]:
    """(statistic, lag, rows of the regression) of a series without gaps."""
    n, fixed = len(x), {"n": 0, "c": 1, "ct": 2}[trend]
    if maxlag is None:
        maxlag = math.ceil(12 * (n / 100) ** 0.25)
    maxlag = max(0, min(maxlag, n // 2 - fixed - 1))
    d = np.diff(x)

    def fit(lag: int, skip: int) -> tuple[float, float, float, int, int]:
        y = d[skip:]
        cols = [x[skip:-1], *(d[skip - j : len(d) - j] for j in range(1, lag + 1)), *([np.ones(len(y))] if fixed else []), *([np.arange(1.0, len(y) + 1)] if fixed > 1 else [])]
        a = np.column_stack(cols)
        q, r = np.linalg.qr(a)
        ri = np.linalg.pinv(r)
        b = ri @ (q.T @ y)
        ssr = float(((y - a @ b) ** 2).sum())
        se = np.sqrt(ssr / max(len(y) - a.shape[1], 1) * (ri**2).sum(axis=1))
        t = np.divide(b, se, out=np.full(len(b), -math.inf), where=se > 0)
        return ssr, float(t[0]), float(t[lag]), len(y), a.shape[1]

    lag = maxlag
    if criterion in ("aic", "bic"):
        made = [fit(k, maxlag) for k in range(maxlag + 1)]  # all on the rows that the longest has
        lag = min(range(maxlag + 1), key=lambda k: (made[k][3] * math.log(max(made[k][0], 1e-300) / made[k][3]) + made[k][4] * (2 if criterion == "aic" else math.log(made[k][3])), k))
    elif criterion == "t-stat":
        lag = next((k for k in range(maxlag, 0, -1) if abs(fit(k, maxlag)[2]) >= 1.6448536269514722), 0)
    elif criterion is not None:
        raise ValueError(f"no criterion {criterion}")
    _, t, _, rows, _ = fit(lag, lag)
    return t, lag, rows


def adf_test(df: DataFrame, axis: Axis, c: str, maxlag: int | None = None, criterion: str | None = "aic", trend: str = "c", min_obs: int = 30) -> DataFrame:
    """Per series the augmented unit-root test: n_obs, test_stat, used_lag, p_value, crit_1, crit_5, crit_10, reject.

    Nulls are left out; the lag is chosen by ``criterion`` (aic, bic, t-stat, or None for
    ``maxlag`` itself) on the rows that all candidates share.  Series shorter than
    ``min_obs`` have n_obs only; a constant one is rejected with an infinite statistic.
    """
    asymptotic = UNIT_ROOT[trend][5]
    names = ("test_stat", "used_lag", "p_value", "crit_1", "crit_5", "crit_10")

    def test(x: np.ndarray) -> tuple:
        if len(x) < min_obs:
            return (None,) * 6
        if x.std() < 1e-12:
            return -math.inf, 0, 0.0, *(a[0] for a in asymptotic)
        t, lag, rows = _unit_root(x, maxlag, criterion, trend)
        return t, lag, unit_root_p(t, trend), *(sum(b / rows**i for i, b in enumerate(a)) for a in asymptotic)

    def step(rows: pd.DataFrame) -> dict:
        # a value stands in the last row of its series
        head, found = [None] * (len(rows) - 1), test(rows[c].to_numpy(float))
        return {"n_obs": [len(rows)] * len(rows), "_end": [False] * len(head) + [True], **{k: np.array(head + [v], object) for k, v in zip(names, found, strict=True)}}

    rows = df.select(*axis.by, *axis.order, F.col(c).cast("double").alias(c)).where(F.col(c).isNotNull() & ~F.isnan(c))
    out = axis.fold(rows, step, "n_obs int, _end boolean, test_stat double, used_lag int, p_value double, crit_1 double, crit_5 double, crit_10 double").where("_end")
    return out.select(*axis.by, "n_obs", *names, (F.col("p_value") < 0.05).alias("reject"))
