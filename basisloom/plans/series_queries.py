"""Queries on series: features, targets, signals, trades, regimes, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar as cal
from ..functions import windows as win
from ..operators import metrics, signals, structures
from .registry import AXIS, DAILY, DAYS, PANEL, RETURNS, Tables, query

W = "WINDOW w AS (PARTITION BY k ORDER BY t, o, n)"


@query(f"WITH {PANEL} SELECT k, t, o, n, lag(x, 1) OVER w AS lag1, lag(x, 1) OVER w - lag(x, 3) OVER w AS delta2, lag(x, 1) OVER w / lag(x, 2) OVER w - 1 AS pct1, lead(x, 2) OVER w - x AS ahead2 FROM p {W}", "lag1 delta2 pct1 ahead2")
def feature_lags(t: Tables) -> DataFrame:
    """lag, delta, pct_change and a forward change per part."""
    return t.panel().select("k", "t", "o", "n", AXIS.lag("x").alias("lag1"), AXIS.delta("x", 2).alias("delta2"), AXIS.pct_change("x", 1).alias("pct1"), win.forward_targets(AXIS, "x", [2])["target_2"].alias("ahead2"))


_F5 = "OVER (PARTITION BY k ORDER BY t, o, n ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


@query(
    f"WITH {PANEL} SELECT k, t, o, n, " + ", ".join(f"CASE WHEN count(x) {_F5} >= 3 THEN {fn}(x) {_F5} END AS {name}" for fn, name in (("avg", "mean5"), ("stddev_samp", "std5"), ("sum", "sum5"), ("min", "min5"), ("max", "max5"))) + f", CASE WHEN count(x) {_F5} >= 3 THEN quantile_cont(x, 0.5) {_F5} END AS median5 FROM p",
    "mean5 std5 sum5 min5 max5 median5",
)
def feature_rolling(t: Tables) -> DataFrame:
    """Trailing mean, deviation, sum, extremes and median of five rows, a row ago, from three values on."""
    return t.panel().select("k", "t", "o", "n", *(getattr(AXIS, f)("x", 5, 3).alias(f"{f}5") for f in ("mean", "std", "sum", "min", "max", "median")))


@query(
    f"""WITH {PANEL}, a AS (SELECT k, t, o, n, x, x / lag(x) OVER w - 1 AS r1, lag(x, 1) OVER w / lag(x, 2) OVER w - 1 AS ret,
      ln(lag(x, 1) OVER w / lag(x, 2) OVER w) AS log_ret, lag(x, 1) OVER w / lag(x, 6) OVER w - 1 AS mom5 FROM p {W})
    SELECT k, t, o, n, ret, log_ret, mom5, CASE WHEN count(r1) OVER f >= 5 THEN stddev_samp(r1) OVER f * sqrt(252) END AS vol5 FROM a
    WINDOW f AS (PARTITION BY k ORDER BY t, o, n ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
    "ret log_ret mom5 vol5",
)
def feature_prices(t: Tables) -> DataFrame:
    """Returns, log returns, momentum and annualised volatility, leak-safe by a row."""
    from .features import build

    out = build(t.panel(), AXIS, [("returns", {"price": "x", "out": "ret"}), ("log_returns", {"price": "x", "out": "log_ret"}), ("momentum", {"price": "x", "window": 5, "out": "mom5"}), ("rolling_volatility", {"price": "x", "window": 5, "annualize": True, "out": "vol5"})])
    return out.select("k", "t", "o", "n", "ret", "log_ret", "mom5", "vol5")


@query(
    f"""WITH {PANEL} SELECT k, t, o, n, CASE WHEN count(v) OVER f >= 6 THEN (lag(v) OVER w - avg(v) OVER f) / nullif(stddev_samp(v) OVER f, 0) END AS shock,
      CASE WHEN count(v) OVER f >= 6 THEN avg(x * v) OVER f END AS dollars, CASE WHEN count(v) OVER f >= 6 THEN avg(v) OVER g / avg(v) OVER f END AS ratio, CASE WHEN count(v) OVER f >= 6 THEN avg(v) OVER f END AS mean_volume
    FROM p {W}, f AS (PARTITION BY k ORDER BY t, o, n ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), g AS (PARTITION BY k ORDER BY t, o, n ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
    "shock dollars ratio mean_volume",
)
def feature_volumes(t: Tables) -> DataFrame:
    """Volume shock, dollar volume and short-to-long volume ratio."""
    from .features import build

    out = build(t.panel(), AXIS, [("volume_shock", {"volume": "v", "window": 6, "out": "shock"}), ("dollar_volume", {"price": "x", "volume": "v", "window": 6, "out": "dollars"}), ("volume_ratio", {"volume": "v", "short": 3, "long": 6, "out": "ratio"}), ("rolling_volume", {"volume": "v", "window": 6, "out": "mean_volume"})])
    return out.select("k", "t", "o", "n", "shock", "dollars", "ratio", "mean_volume")


@query(
    f"""WITH {PANEL}, a AS (SELECT *, CASE WHEN f = 'A' THEN v ELSE 0 END AS buy, CASE WHEN f = 'R' THEN v ELSE 0 END AS sell, x - lag(x) OVER w AS dx FROM p {W})
    SELECT k, t, o, n, CASE WHEN count(v) OVER f >= 4 THEN (sum(buy) OVER f - sum(sell) OVER f) / nullif(sum(buy) OVER f + sum(sell) OVER f, 0) END AS flow,
      CASE WHEN count(sign(dx) * v) OVER f >= 4 THEN sum(sign(dx) * v) OVER f END AS signed,
      CASE WHEN count(v) OVER f >= 4 THEN (sum(CASE WHEN dx > 0 THEN v ELSE 0 END) OVER f - sum(CASE WHEN dx < 0 THEN v ELSE 0 END) OVER f) / nullif(sum(v) OVER f, 0) END AS imbalance
    FROM a WINDOW f AS (PARTITION BY k ORDER BY t, o, n ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""",
    "flow signed imbalance",
)
def feature_flows(t: Tables) -> DataFrame:
    """Flow imbalance, signed volume and volume imbalance."""
    from .features import build

    rows = t.panel().withColumn("buy", F.when(F.col("f") == "A", F.col("v")).otherwise(0.0)).withColumn("sell", F.when(F.col("f") == "R", F.col("v")).otherwise(0.0))
    out = build(rows, AXIS, [("flow_imbalance", {"buy": "buy", "sell": "sell", "window": 4, "out": "flow"}), ("signed_volume", {"price": "x", "volume": "v", "window": 4, "out": "signed"}), ("volume_imbalance", {"price": "x", "volume": "v", "window": 4, "out": "imbalance"})])
    return out.select("k", "t", "o", "n", "flow", "signed", "imbalance")


@query(
    f"""WITH {PANEL} SELECT k, t, o, n, lag(x) OVER w - lag(v) OVER w AS diff, lag(x) OVER w / (lag(v) OVER w + 1e-10) AS ratio, ln((lag(x) OVER w + 1e-10) / (lag(v) OVER w + 1e-10)) AS log_ratio,
      CASE WHEN count(x) OVER f >= 5 THEN avg(x) OVER f / nullif(avg(v) OVER f, 0) END AS relative_strength FROM p {W}, f AS (PARTITION BY k ORDER BY t, o, n ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
    "diff ratio log_ratio relative_strength",
)
def feature_pairs(t: Tables) -> DataFrame:
    """Two series against each other."""
    return t.panel().select("k", "t", "o", "n", *(c.alias(a) for a, c in win.pair_features(AXIS, "x", "v", 5).items()))


@query(
    f"""WITH {DAILY}, a AS (SELECT k, t, lag(x) OVER (PARTITION BY k ORDER BY t) AS y FROM q), b AS (SELECT *, rank() OVER (PARTITION BY t ORDER BY y NULLS LAST) + (count(*) OVER (PARTITION BY t, y) - 1) / 2.0 AS rk FROM a)
    SELECT k, t, CASE WHEN y IS NOT NULL THEN rk / count(y) OVER w END AS pct_rank, (y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0) AS zs, y - avg(y) OVER w AS demeaned FROM b WINDOW w AS (PARTITION BY t)""",
    "pct_rank zs demeaned",
)
def feature_cross_section(t: Tables) -> DataFrame:
    """Rank, z-score and demeaned value within a day, of yesterday's value."""
    rows = t.daily().withColumn("y", DAYS.lag("x"))
    return rows.select("k", "t", win.cross_rank("y", ["t"]).alias("pct_rank"), win.cross_zscore("y", ["t"]).alias("zs"), win.cross_demean("y", ["t"]).alias("demeaned"))


@query(
    """SELECT o_orderkey, (isodow(o_orderdate) - 1)::INT AS day_of_week, day(o_orderdate)::INT AS day_of_month, month(o_orderdate)::INT AS month, quarter(o_orderdate)::INT AS quarter, weekofyear(o_orderdate)::INT AS week_of_year,
      hour(o_orderdate)::INT AS hour, sin(2 * pi() * (month(o_orderdate) - 1) / 12) AS month_sin, cos(2 * pi() * (month(o_orderdate) - 1) / 12) AS month_cos FROM orders""",
    "month_sin month_cos",
)
def calendar_parts(t: Tables) -> DataFrame:
    """Calendar parts of order dates, and the month on a circle."""
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", *(c.cast("int").alias(n) for n, c in (cal.time_features(d, hour=True) | {}).items()), *(c.alias(n) for n, c in cal.cyclical(d, "month").items()))


@query(
    """WITH e AS (SELECT event_id, ts, (ts - date_trunc('day', ts)) BETWEEN INTERVAL '7 hours 30 minutes' AND INTERVAL '17 hours' AS s, ts::DATE AS d FROM events)
    SELECT event_id, s AS is_session, d AS trading_date, s AND row_number() OVER (PARTITION BY d, s ORDER BY ts, event_id) = 1 AS is_open_bar, s AND row_number() OVER (PARTITION BY d, s ORDER BY ts DESC, event_id) = 1 AS is_close_bar,
      s AND (row_number() OVER (PARTITION BY s ORDER BY ts, event_id) - 1) % 7 = 0 AS rebalance FROM e"""
)
def session_bars(t: Tables) -> DataFrame:
    """Session flags of events, and every seventh session bar."""
    rows = cal.session_flags(t.events, "ts", tie=("event_id",))
    rows = cal.rebalance_bar(rows, "every_n_bars", 7, "ts", ("event_id",))
    return rows.select("event_id", "is_session", "trading_date", "is_open_bar", "is_close_bar", "rebalance")


@query(
    """SELECT ts::DATE AS trading_date, min(ts)::VARCHAR AS session_open, max(ts)::VARCHAR AS session_close FROM events WHERE (ts - date_trunc('day', ts)) BETWEEN INTERVAL '7 hours 30 minutes' AND INTERVAL '17 hours' GROUP BY 1"""
)
def session_boundaries(t: Tables) -> DataFrame:
    """First and last session stamp of each day."""
    rows = cal.session_boundaries(t.events, "ts")
    return rows.select("trading_date", *(F.col(c).cast("string").alias(c) for c in ("session_open", "session_close")))


@query("SELECT event_id, CASE WHEN extract(hour FROM ts) * 60 + extract(minute FROM ts) < 450 THEN ts::DATE - 1 ELSE ts::DATE END AS trading_date FROM events")
def trading_dates(t: Tables) -> DataFrame:
    """The trading date of events: before 07:30 still the day before."""
    return t.events.select("event_id", cal.trading_date(F.col("ts")).alias("trading_date"))


@query(
    f"""WITH {PANEL}, a AS (SELECT *, avg(x) OVER f AS m, stddev_samp(x) OVER f AS s, count(x) OVER f AS c, quantile_cont(x, 0.5) OVER f AS md, mad(x) OVER f AS dev FROM p WINDOW f AS (PARTITION BY k ORDER BY t, o, n ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
    SELECT k, t, o, n, CASE WHEN c >= 8 THEN greatest(-4, least(4, (x - m) / greatest(s, 1e-12))) END AS z, CASE WHEN c >= 8 THEN greatest(-4, least(4, (x - md) / greatest(1.4826 * dev, 1e-12))) END AS robust_z FROM a""",
    "z robust_z",
)
def rolling_zscores(t: Tables) -> DataFrame:
    """Plain and robust rolling z-scores of eight rows, clipped at four."""
    return t.panel().select("k", "t", "o", "n", win.zscore(AXIS, "x", 8, clip=4.0).alias("z"), win.robust_zscore(AXIS, "x", 8, clip=4.0).alias("robust_z"))


@query(
    f"""WITH {PANEL}, a AS (SELECT k, t, o, n, lag(x) OVER w AS y, row_number() OVER w AS i FROM p {W})
    SELECT a.k, a.t, a.o, a.n, sum(b.y * pow(1 - 2.0 / 6, a.i - b.i)) / sum(CASE WHEN b.y IS NOT NULL THEN pow(1 - 2.0 / 6, a.i - b.i) END) AS ewma5 FROM a JOIN a b ON a.k = b.k AND b.i <= a.i GROUP BY ALL""",
    "ewma5",
)
def ewma_feature(t: Tables) -> DataFrame:
    """Exponentially weighted mean (span 5) of the shifted series."""
    return win.ewma(AXIS, t.panel().select("k", "t", "o", "n", "x"), "x", "ewma5", span=5).drop("x")


_SIG = f"""{DAILY}, z AS (SELECT k, t, x, row_number() OVER (PARTITION BY k ORDER BY t) AS i, CASE WHEN count(x) OVER f >= 5 THEN (x - avg(x) OVER f) / greatest(stddev_samp(x) OVER f, 1e-12) END AS z
  FROM q WINDOW f AS (PARTITION BY k ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
s AS (SELECT k, i, CASE WHEN z <= -1 THEN 1 WHEN z >= 1 THEN -1 ELSE 0 END AS pos, 0 AS why, 0 AS held FROM z WHERE i = 1
  UNION ALL SELECT z.k, z.i,
    CASE WHEN z.z IS NULL THEN s.pos WHEN s.pos = 0 THEN CASE WHEN z.z <= -1 THEN 1 WHEN z.z >= 1 THEN -1 ELSE 0 END WHEN s.pos * z.z >= -0.25 OR s.pos * z.z <= -1.7 OR s.held + 1 >= 4 THEN 0 ELSE s.pos END,
    CASE WHEN z.z IS NULL OR s.pos = 0 THEN 0 WHEN s.pos * z.z >= -0.25 THEN 1 WHEN s.pos * z.z <= -1.7 THEN 2 WHEN s.held + 1 >= 4 THEN 3 ELSE 0 END,
    CASE WHEN s.pos = 0 THEN 0 WHEN z.z IS NULL THEN s.held + 1 WHEN s.pos * z.z >= -0.25 OR s.pos * z.z <= -1.7 OR s.held + 1 >= 4 THEN 0 ELSE s.held + 1 END
  FROM s JOIN z ON z.k = s.k AND z.i = s.i + 1)"""
_RULE = signals.ReversionRule(entry=1.0, exit=0.25, stop=1.7, max_hold=4)


def _signals(t: Tables) -> DataFrame:
    rows = t.daily().select("k", "t", "x", win.zscore(DAYS, "x", 5).alias("z"))
    return signals.mean_reversion_signal(rows, DAYS, "z", _RULE)


@query(f"WITH RECURSIVE {_SIG} SELECT z.k, z.t, z.z AS zscore, s.pos::INT AS signal, s.why::INT AS exit_reason, s.held::INT AS bars_held FROM z JOIN s USING (k, i)", "zscore")
def mean_reversion_signals(t: Tables) -> DataFrame:
    """The reversion state machine over every part's daily prices."""
    return _signals(t).select("k", "t", F.col("z").alias("zscore"), "signal", "exit_reason", "bars_held")


@query(
    f"""WITH RECURSIVE {_SIG}, a AS (SELECT z.k, z.t, z.i, z.z, s.pos, s.why, x - lag(x) OVER w AS dx, lead(z.t) OVER w AS nt, lead(s.why) OVER w AS nw, lead(x) OVER w - x AS ndx, coalesce((pos <> lag(pos) OVER w)::INT, 1) AS nu FROM z JOIN s USING (k, i) WINDOW w AS (PARTITION BY z.k ORDER BY z.t)),
    b AS (SELECT *, sum(nu) OVER (PARTITION BY k ORDER BY t) AS run FROM a)
    SELECT k, first(pos)::INT AS side, min(t)::VARCHAR AS entry, (CASE WHEN bool_or(nt IS NULL) THEN NULL ELSE max(nt) END)::VARCHAR AS exit, count(*) AS bars, arg_min(z, t) AS entry_z, bool_or(nt IS NULL) AS is_open,
      (CASE WHEN bool_or(nt IS NULL) THEN 0 ELSE coalesce(arg_max(nw, t), 0) END)::INT AS exit_reason, sum(coalesce(pos * ndx, 0)) AS pnl FROM b WHERE pos <> 0 GROUP BY k, run""",
    "entry_z pnl",
)
def trade_blotter(t: Tables) -> DataFrame:
    """Trades of the reversion signal with their profit and exit reason."""
    rows = signals.signal_backtest(_signals(t), DAYS, "signal", "x")
    out = signals.trades(rows, DAYS, "signal", "z", "gross", "exit_reason")
    return out.withColumn("entry", F.col("entry").cast("string")).withColumn("exit", F.col("exit").cast("string"))


@query(
    f"""WITH RECURSIVE {_SIG}, a AS (SELECT z.k, z.t, x, coalesce(lag(s.pos) OVER w, 0)::DOUBLE AS position, x - lag(x) OVER w AS dx FROM z JOIN s USING (k, i) WINDOW w AS (PARTITION BY z.k ORDER BY z.t)),
    b AS (SELECT *, position * coalesce(dx, 0) - abs(position - coalesce(lag(position) OVER w, 0)) * 0.5 AS pnl FROM a WINDOW w AS (PARTITION BY k ORDER BY t))
    SELECT k, t, position, pnl, sum(pnl) OVER (PARTITION BY k ORDER BY t) AS cum_pnl FROM b""",
    "position pnl cum_pnl",
)
def signal_backtests(t: Tables) -> DataFrame:
    """The lagged signal's profit with costs."""
    return signals.signal_backtest(_signals(t), DAYS, "signal", "x", 0.5).select("k", "t", "position", "pnl", "cum_pnl")


@query(
    f"""WITH {DAILY}, a AS (SELECT k, t, x, lag(x, 1) OVER w - lag(x, 5) OVER w AS mom, CASE WHEN count(x) OVER b >= 4 THEN CASE WHEN x > max(x) OVER b THEN 1 WHEN x < min(x) OVER b THEN -1 ELSE 0 END ELSE 0 END AS breakout, row_number() OVER w AS i
      FROM q WINDOW w AS (PARTITION BY k ORDER BY t), b AS (PARTITION BY k ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, CASE WHEN mom > 20 THEN 1 WHEN mom < -20 THEN -1 END AS s, CASE WHEN count(x) OVER f = 6 THEN regr_slope(x, i) OVER f END AS slope, CASE WHEN count(x) OVER f = 6 THEN greatest(0, least(1, regr_r2(x, i) OVER f)) END AS r2 FROM a WINDOW f AS (PARTITION BY k ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
    SELECT k, t, mom, breakout::INT AS breakout, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY k ORDER BY t), 0)::INT AS position, slope, sign(slope) * r2 AS strength FROM c""",
    "mom slope strength",
)
def momentum_signals(t: Tables) -> DataFrame:
    """Momentum, breakout, hysteresis position and trend strength."""
    rows = t.daily().withColumn("mom", signals.momentum(DAYS, "x", 4, 1)).withColumn("breakout", signals.breakout(DAYS, "x", 4))
    rows = rows.withColumn("position", signals.hysteresis(DAYS, F.col("mom"), 20.0))
    rows = signals.trend(rows, DAYS, "x", 6)
    return rows.select("k", "t", "mom", "breakout", "position", F.col("trend_slope").alias("slope"), F.col("trend_strength").alias("strength"))


@query(
    f"""WITH RECURSIVE {DAILY}, a AS (SELECT k, t, x, x - lag(x) OVER w AS d, row_number() OVER w AS i FROM q WINDOW w AS (PARTITION BY k ORDER BY t)),
    e AS (SELECT k, i, x AS f, x AS s, 0::DOUBLE AS g, NULL::DOUBLE AS u, NULL::DOUBLE AS l FROM a WHERE i = 1 UNION ALL SELECT a.k, a.i, a.x * 0.5 + e.f * 0.5, a.x * 0.25 + e.s * 0.75, (a.x * 0.5 + e.f * 0.5 - a.x * 0.25 - e.s * 0.75) * 0.4 + e.g * 0.6,
      coalesce(greatest(d, 0) / 3 + e.u * 2 / 3, greatest(d, 0)), coalesce(greatest(-d, 0) / 3 + e.l * 2 / 3, greatest(-d, 0)) FROM e JOIN a ON a.k = e.k AND a.i = e.i + 1)
    SELECT a.k, a.t, f AS ema_fast, s AS ema_slow, f - s AS macd, g AS macd_signal, f - s - g AS macd_hist, CASE WHEN l <> 0 THEN 100 - 100 / (1 + u / l) END AS rsi FROM a JOIN e USING (k, i)""",
    "ema_fast ema_slow macd macd_signal macd_hist rsi",
)
def oscillator_signals(t: Tables) -> DataFrame:
    """Exponential means (spans 3 and 7), their difference and its mean (span 4)."""
    return signals.oscillators(t.daily(), DAYS, "x", 3, 7, 4, 5).select("k", "t", "ema_fast", "ema_slow", "macd", "macd_signal", "macd_hist", "rsi")


@query(
    f"""WITH {DAILY}, a AS (SELECT k, t, x, lag(x) OVER w AS y, x - lag(x) OVER w AS d FROM q WINDOW w AS (PARTITION BY k ORDER BY t)),
    b AS (SELECT *, count(d) OVER f AS c, regr_sxx(d, y) OVER f AS sxx, regr_sxy(d, y) OVER f AS sxy, regr_syy(d, y) OVER f AS syy FROM a WINDOW f AS (PARTITION BY k ORDER BY t ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)),
    g AS (SELECT *, CASE WHEN c = 11 AND sxx > 0 THEN sxy / sxx END AS g, CASE WHEN c = 11 AND sxx > 0 THEN sxy / sxx / sqrt((syy - sxy * sxy / sxx) / 9 / sxx) END AS tt FROM b),
    r AS (SELECT *, row_number() OVER w AS i FROM g WINDOW w AS (PARTITION BY k ORDER BY t)),
    s AS (SELECT *, CASE WHEN count(x) OVER f = 12 THEN regr_slope(x, i) OVER f END AS slope, CASE WHEN count(x) OVER f = 12 THEN greatest(0, least(1, regr_r2(x, i) OVER f)) END AS r2, CASE WHEN tt IS NULL THEN NULL WHEN tt < -3.5 THEN 0.01 WHEN tt < -2.9 THEN 0.05 WHEN tt < -2.6 THEN 0.10 WHEN tt < -1.9 THEN 0.30 ELSE 0.80 END AS p,
      CASE WHEN 1 + g > 0 AND 1 + g < 1 THEN -ln(2) / ln(1 + g) END AS h FROM r WINDOW f AS (PARTITION BY k ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
    SELECT k, t, tt AS adf_t, p AS adf_p, h AS half_life, slope AS trend_slope, r2 AS trend_r2, sign(slope) * r2 AS trend_strength,
      CASE WHEN p IS NULL THEN 'uncertain' WHEN coalesce((p < 0.05)::INT + (h < 6)::INT + (r2 < 0.3)::INT, 0) >= 2 THEN 'mean_revert' WHEN (p >= 0.3)::INT + coalesce(h >= 6, true)::INT + (r2 > 0.6)::INT >= 2 THEN 'trend' ELSE 'uncertain' END AS regime FROM s""",
    "adf_t adf_p half_life trend_slope trend_r2 trend_strength",
)
def regime_statistics(t: Tables) -> DataFrame:
    """Rolling unit-root statistic, p-step and half-life of twelve days."""
    return signals.regime_features(t.daily(), DAYS, "x", 12).select("k", "t", "adf_t", "adf_p", "half_life", "trend_slope", "trend_r2", "trend_strength", "regime")


@query(
    f"""WITH {RETURNS}, a AS (SELECT *, product(1 + r) OVER w AS eq, r - lag(r) OVER w AS dr, count(*) OVER f AS c, product(1 + r) OVER f - 1 AS wr FROM r WINDOW w AS (PARTITION BY s ORDER BY d), f AS (PARTITION BY s ORDER BY d ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
    b AS (SELECT *, eq / max(eq) OVER (PARTITION BY s ORDER BY d) - 1 AS dd, quantile_cont(r, 0.05) OVER (PARTITION BY s) AS q FROM a)
    SELECT s, count(r) AS n, avg(r) * 12 AS annual_return, stddev_samp(r) * sqrt(12) AS annual_vol, avg(r) / stddev_samp(r) * sqrt(12) AS sharpe, avg(r) / nullif(stddev_samp(least(r, 0)), 0) * sqrt(12) AS sortino, stddev_samp(least(r, 0)) * sqrt(12) AS downside, avg((r > 0)::INT::DOUBLE) AS hit_rate,
      sum(greatest(r, 0)) / sum(greatest(-r, 0)) AS profit_factor, avg(r) FILTER (r > 0) AS avg_win, avg(r) FILTER (r < 0) AS avg_loss, skewness(r) AS skew, kurtosis(r) AS kurtosis, min(q) AS q05, min(dd) AS max_drawdown, min(CASE WHEN c >= 6 THEN wr END) AS worst_window, avg(abs(dr)) AS turnover_proxy, avg(r) FILTER (r <= q) AS cvar05 FROM b GROUP BY s""",
    "annual_return annual_vol sharpe sortino downside hit_rate profit_factor avg_win avg_loss skew kurtosis q05 max_drawdown worst_window turnover_proxy cvar05",
)
def return_metrics(t: Tables) -> DataFrame:
    """Return and risk metrics of monthly order values per priority."""
    return metrics.return_metrics(t.returns(), ["s"], "d", "r", 12, 6)


@query(
    f"""WITH {RETURNS}, a AS (SELECT s, d, r - avg(r) OVER (PARTITION BY s) AS u, avg(r) OVER (PARTITION BY s) AS m FROM r), b AS (SELECT *, u * lag(u, 1) OVER w AS c1, u * lag(u, 2) OVER w AS c2, u * lag(u, 3) OVER w AS c3 FROM a WINDOW w AS (PARTITION BY s ORDER BY d))
    SELECT s, count(*) AS n, first(m) AS mean, first(m) / sqrt((sum(u * u) + 2 * (0.75 * sum(c1) + 0.5 * sum(c2) + 0.25 * sum(c3))) / count(*) / count(*)) AS t_stat FROM b GROUP BY s""",
    "mean t_stat",
)
def newey_west_tstats(t: Tables) -> DataFrame:
    """HAC t-statistics of the monthly returns with three lags."""
    return metrics.newey_west(t.returns(), ["s"], "d", "r", 3)


@query(f"WITH {RETURNS}, y AS (SELECT s, year(d) AS y, product(1 + r) - 1 AS g FROM r GROUP BY ALL) SELECT s, avg((g > 0)::INT::DOUBLE) AS positive_years, count(*) AS years FROM y GROUP BY s", "positive_years")
def positive_year_share(t: Tables) -> DataFrame:
    """Share of years with a positive compounded return."""
    return metrics.positive_years(t.returns(), ["s"], "d", "r")


@query(
    f"""WITH {RETURNS}, a AS (SELECT s, d, sum(r) OVER (PARTITION BY s ORDER BY d) AS c FROM r), b AS (SELECT *, max(c) OVER (PARTITION BY s ORDER BY d) - c AS dd FROM a), g AS (SELECT *, sum((dd <= 0)::INT) OVER (PARTITION BY s ORDER BY d) AS run FROM b),
    h AS (SELECT s, run, sum((dd > 0)::INT) AS len, max(dd) AS dd FROM g GROUP BY ALL) SELECT s, max(dd) AS max_drawdown, max(len)::BIGINT AS longest_below FROM h GROUP BY s""",
    "max_drawdown",
)
def currency_drawdowns(t: Tables) -> DataFrame:
    """Drawdown in currency and the longest run below the peak."""
    return metrics.drawdown(t.returns(), ["s"], "d", "r")


@query(
    f"""WITH RECURSIVE {_SIG}, a AS (SELECT k, i, pos, coalesce((pos <> lag(pos) OVER (PARTITION BY k ORDER BY i))::INT, 1) AS nu FROM s), b AS (SELECT *, sum(nu) OVER (PARTITION BY k ORDER BY i) AS run FROM a), g AS (SELECT k, run, first(pos) AS pos, count(*) AS len FROM b GROUP BY ALL)
    SELECT k, count(*) - 1 AS n_changes, avg(CASE WHEN pos <> 0 THEN len END) AS avg_holding FROM g GROUP BY k""",
    "avg_holding",
)
def holding_periods(t: Tables) -> DataFrame:
    """Position changes and mean length of held runs."""
    return metrics.trade_metrics(_signals(t), ["k"], "t", "signal")


@query(
    f"""WITH {DAILY}, a AS (SELECT k, t, x AS y, lag(x) OVER (PARTITION BY k ORDER BY t) AS x FROM q), b AS (SELECT k, count(*) AS n, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM a WHERE x IS NOT NULL GROUP BY k)
    SELECT k, n, CASE WHEN n >= 10 THEN a END AS a, CASE WHEN n >= 10 THEN b END AS b, CASE WHEN n >= 10 THEN b / sqrt((syy - b * sxy) / (n - 2) / sxx) END AS t_stat, CASE WHEN n >= 10 AND b > 1e-9 AND b < 1 THEN -ln(2) / ln(b) END AS half_life FROM b""",
    "a b t_stat half_life",
)
def ar1_fits(t: Tables) -> DataFrame:
    """AR(1) fits of daily prices."""
    return structures.ar1(t.daily(), DAYS, "x", 10)


@query(
    f"""WITH {DAILY}, a AS (SELECT k, t, x AS y, v AS b, lag(x) OVER (PARTITION BY k ORDER BY t) AS a FROM q), c AS (SELECT *, count(CASE WHEN a IS NOT NULL THEN y END) OVER f AS n, avg(CASE WHEN a IS NOT NULL THEN y END) OVER f AS my, avg(a) OVER f AS ma, avg(CASE WHEN a IS NOT NULL THEN b END) OVER f AS mb,
      covar_pop(a, a) OVER f AS caa, covar_pop(CASE WHEN a IS NOT NULL THEN b END, b) OVER f AS cbb, covar_pop(a, b) OVER f AS cab, covar_pop(a, y) OVER f AS cay, covar_pop(CASE WHEN a IS NOT NULL THEN b END, y) OVER f AS cby FROM a WINDOW f AS (PARTITION BY k ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
    d AS (SELECT *, CASE WHEN n >= 8 AND abs(caa * cbb - cab * cab) > 1e-14 THEN caa * cbb - cab * cab END AS det FROM c), e AS (SELECT *, (cay * cbb - cby * cab) / det AS beta_front, (cby * caa - cay * cab) / det AS beta_back FROM d)
    SELECT k, t, my - beta_front * ma - beta_back * mb AS alpha, beta_front, beta_back, y - (my - beta_front * ma - beta_back * mb) - beta_front * a - beta_back * b AS residual FROM e""",
    "alpha beta_front beta_back residual",
)
def three_leg_residuals(t: Tables) -> DataFrame:
    """Rolling regression of one series on two."""
    rows = t.daily().withColumn("a", DAYS.lag("x"))
    return structures.residual_three_legs(rows, DAYS, "a", "x", "v", 12, 8).select("k", "t", "alpha", "beta_front", "beta_back", "residual")


@query(
    f"""WITH {DAILY}, a AS (SELECT k, lag(x) OVER w AS x0, lag(v) OVER w AS x1, x AS y0, v AS y1 FROM q WINDOW w AS (PARTITION BY k ORDER BY t)), g AS (SELECT (-1 + i * 0.5) AS w FROM range(5) r(i)),
    b AS (SELECT k, w, count(*) AS n, regr_slope(w * y0 + y1, w * x0 + x1) AS b FROM a, g WHERE x0 IS NOT NULL GROUP BY ALL), c AS (SELECT k, w, CASE WHEN n >= 10 AND b > 1e-9 AND b < 1 THEN -ln(2) / ln(b) END AS h FROM b)
    SELECT k, min(h) AS half_life FROM c WHERE h IS NOT NULL GROUP BY k""",
    "half_life",
)
def stationarity_search(t: Tables) -> DataFrame:
    """The shortest half-life over a grid of leg weights, from sums over the legs."""
    rows = t.daily().withColumn("z", F.lit(0.0))
    out = structures.stationarity_grid(rows, DAYS, "x", "v", "z", (-1.0, 1.0), 5, 1.0, 10)
    return out.select("k", "half_life")


@query(
    f"""WITH {DAILY} SELECT k, t, CASE WHEN lead(x, 1) OVER w > x THEN 1 ELSE 0 END::INT AS up1, lead(x, 1) OVER w / x - 1 AS target_1, lead(x, 3) OVER w / x - 1 AS target_3 FROM q WINDOW w AS (PARTITION BY k ORDER BY t)""",
    "target_1 target_3",
)
def forward_targets(t: Tables) -> DataFrame:
    """Direction and returns ahead."""
    return t.daily().select("k", "t", win.forward_direction(DAYS, "x").alias("up1"), *(c.alias(n) for n, c in win.forward_targets(DAYS, "x", [1, 3], "return").items()))


@query(
    """WITH d AS (SELECT ts::DATE AS d, count(*) AS n FROM events GROUP BY 1) SELECT (quantile_cont(n::DOUBLE, 0.5) * 252)::BIGINT AS bars_per_year FROM d"""
)
def bars_per_year(t: Tables) -> DataFrame:
    """Bars of a median day times 252."""
    return metrics.bars_per_year(t.events, "ts")


@query(
    """WITH o AS (SELECT o_custkey AS k, date_trunc('quarter', o_orderdate) AS d, o_orderstatus AS g, o_totalprice / 1e6 - 0.1 AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) % 3 - 1 AS p, o_orderdate, o_orderkey FROM orders),
    a AS (SELECT *, p <> 0 AND coalesce(lag(p) OVER (PARTITION BY k ORDER BY o_orderdate, o_orderkey), 0) = 0 AS entry FROM o)
    SELECT g, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, sum(r) AS pnl, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, sum(entry::INT)::BIGINT AS entries FROM a GROUP BY g""",
    "share pnl sharpe",
)
def regime_diagnostics(t: Tables) -> DataFrame:
    """Time, profit and entries per regime."""
    order = F.struct("o_orderdate", "o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = t.orders.select(F.col("o_custkey").alias("k"), order.alias("at"), F.col("o_orderstatus").alias("g"), (F.col("o_totalprice") / 1e6 - 0.1).alias("r"), (F.row_number().over(w) % 3 - 1).alias("p"))
    return metrics.regime_diagnostics(rows, ["k"], "at", "g", "r", "p")
