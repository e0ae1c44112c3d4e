"""Queries on strategies and structures: gates, weights, residuals, universes, selections, books, funding, simulations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import execution as ex
from ..functions import windows as win
from ..functions.windows import Axis
from ..operators import backtest, distributions, learning, lifecycle, metrics, panel, portfolio, selection, signals, strategies, structures, sweeps
from .registry import DAILY, DAYS, PANEL, RETURNS, SQL, Tables, query
from .series_queries import _RULE, _SIG, _signals
from .table_queries import _CDF, _FULL, _LEGS, _structure

_Z = f"""{DAILY}, z AS (SELECT k, t, x, v, row_number() OVER (PARTITION BY k ORDER BY t) AS i, CASE WHEN count(x) OVER f >= 5 THEN (x - avg(x) OVER f) / greatest(stddev_samp(x) OVER f, 1e-12) END AS z
  FROM q WINDOW f AS (PARTITION BY k ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def _scores(t: Tables) -> DataFrame:
    return t.daily().withColumn("z", win.zscore(DAYS, "x", 5))


# -- signals -------------------------------------------------------------------


@query(
    f"""WITH {_Z}, a AS (SELECT *, x - lag(x, 3) OVER w AS mom, min(coalesce(z > 0, false)::INT) OVER c AS up, count(*) OVER c AS n FROM z WINDOW w AS (PARTITION BY k ORDER BY t), c AS (PARTITION BY k ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    b AS (SELECT *, coalesce(z, 0) AS s, coalesce(mom, 0) / 100 AS m FROM a)
    SELECT k, t, n >= 3 AND up = 1 AS confirmed, CASE WHEN s > 0.5 THEN 1.0 WHEN s < -0.5 THEN -1.0 ELSE 0.0 END::DOUBLE AS side, CASE WHEN abs(s) > 0.5 THEN greatest(-1.5, least(1.5, s)) ELSE 0 END AS size, (0.7 * s + 0.3 * m) / 1.0 AS mixed, sign(sign(s) + sign(m))::DOUBLE AS vote,
      CASE WHEN s <> 0 THEN least(abs(z) / 4, 1) ELSE 0 END AS strength FROM b""",
    "side size mixed vote strength",
)
def signal_rules(t: Tables) -> DataFrame:
    """Confirmation over three rows, thresholds, combinations and strength of scores."""
    rows = _scores(t).withColumn("mom", signals.momentum(DAYS, "x", 3) / 100)
    z, m = F.col("z"), F.col("mom")
    return rows.select(
        "k", "t", signals.confirmed(DAYS, z > 0, 3).alias("confirmed"), signals.threshold_position(z, 0.5).alias("side"), signals.threshold_position(z, 0.5, 1.5, discrete=False).alias("size"),
        signals.combine([z, m], [0.7, 0.3]).alias("mixed"), signals.combine([z, m], vote=True).alias("vote"), signals.signal_strength(z, F.signum(F.coalesce(z, F.lit(0.0)))).alias("strength"),
    )


@query(
    f"""WITH RECURSIVE {_Z}, y AS (SELECT *, v > 20 AND z IS NOT NULL AS ok, CASE WHEN z <= -1 THEN 1 WHEN z >= 1 THEN -1 ELSE 0 END AS side, abs(z) >= 1.7 AS far FROM z),
    s AS (SELECT k, i, CASE WHEN ok AND NOT far THEN side ELSE 0 END AS pos FROM y WHERE i = 1 UNION ALL
      SELECT y.k, y.i, CASE WHEN NOT ok THEN s.pos WHEN s.pos = 0 THEN CASE WHEN far THEN 0 ELSE side END WHEN far OR (s.pos > 0 AND z >= -0.25 AND side >= 0) OR (s.pos < 0 AND z <= 0.25 AND side <= 0) THEN 0 WHEN side = -s.pos THEN side ELSE s.pos END FROM s JOIN y ON y.k = s.k AND y.i = s.i + 1)
    SELECT z.k, z.t, s.pos::INT AS position FROM z JOIN s USING (k, i)""",
)
def gated_reversion(t: Tables) -> DataFrame:
    """Reversion positions that change on tradeable rows only, with direct reversals."""
    rows = _scores(t).withColumn("ok", F.col("v") > 20)
    return signals.gated_positions(rows, DAYS, "z", "ok", _RULE).select("k", "t", "position")


@query(
    f"""WITH RECURSIVE {_Z}, y AS (SELECT *, CASE WHEN z <= -1 THEN 1 WHEN z >= 1 THEN -1 ELSE 0 END AS sig, v > 25 AS inside FROM z),
    s AS (SELECT k, i, CASE WHEN inside THEN sig ELSE 0 END AS pos FROM y WHERE i = 1 UNION ALL
      SELECT y.k, y.i, CASE WHEN sig = 0 THEN 0 WHEN sig <> s.pos THEN CASE WHEN inside THEN sig ELSE 0 END WHEN NOT inside THEN 0 ELSE s.pos END FROM s JOIN y ON y.k = s.k AND y.i = s.i + 1)
    SELECT z.k, z.t, s.pos::INT AS gated FROM z JOIN s USING (k, i)""",
)
def regime_gates(t: Tables) -> DataFrame:
    """Signals that open in one regime only and close when it ends."""
    z = F.col("z")
    rows = _scores(t).withColumn("sig", F.when(z <= -1, 1).when(z >= 1, -1).otherwise(0)).withColumn("regime", F.when(F.col("v") > 25, signals.MEAN_REVERT).otherwise(signals.TREND))
    return signals.regime_gate(rows, DAYS, "sig", "regime", exit_on_change=True).select("k", "t", "gated")


@query(
    f"""WITH RECURSIVE {_Z}, y AS (SELECT *, CASE WHEN z <= -1 THEN 1 WHEN z >= 1 THEN -1 ELSE 0 END AS side FROM z),
    s AS (SELECT k, i, coalesce(side, 0) AS pos, 0 AS held, 0 AS why FROM y WHERE i = 1 UNION ALL
      SELECT y.k, y.i, CASE WHEN s.pos = 0 THEN coalesce(side, 0) WHEN z IS NULL OR s.held + 1 >= 4 OR -s.pos * z >= 1.7 OR -s.pos * z <= 0.25 THEN 0 ELSE s.pos END,
        CASE WHEN s.pos = 0 OR z IS NULL OR s.held + 1 >= 4 OR -s.pos * z >= 1.7 OR -s.pos * z <= 0.25 THEN 0 ELSE s.held + 1 END,
        CASE WHEN s.pos = 0 THEN 0 WHEN z IS NULL THEN 4 WHEN s.held + 1 >= 4 THEN 1 WHEN -s.pos * z >= 1.7 THEN 2 WHEN -s.pos * z <= 0.25 THEN 3 ELSE 0 END FROM s JOIN y ON y.k = s.k AND y.i = s.i + 1),
    m AS (SELECT k, i, coalesce(-side, 0) AS pos, 0 AS why FROM y WHERE i = 1 UNION ALL
      SELECT y.k, y.i, CASE WHEN m.pos = 0 THEN coalesce(-side, 0) WHEN z IS NULL OR m.pos * z < 0 OR m.pos * z <= 0.25 THEN 0 ELSE m.pos END, CASE WHEN m.pos = 0 THEN 0 WHEN z IS NULL THEN 4 WHEN m.pos * z < 0 THEN 5 WHEN m.pos * z <= 0.25 THEN 3 ELSE 0 END FROM m JOIN y ON y.k = m.k AND y.i = m.i + 1)
    SELECT z.k, z.t, s.pos::INT AS reverting, s.held::INT AS held, s.why::INT AS why, m.pos::INT AS following, m.why::INT AS why_following FROM z JOIN s USING (k, i) JOIN m USING (k, i)""",
)
def position_managers(t: Tables) -> DataFrame:
    """Positions against and with a score under their managers' rules."""
    rows = lifecycle.managed_positions(_scores(t), DAYS, "z", lifecycle.ManagerRule(1.0, 0.25, 1.7, 4)).withColumnsRenamed({"position": "reverting"})
    rows = lifecycle.managed_positions(rows.withColumnsRenamed({"held": "h", "why": "w"}), DAYS, "z", lifecycle.ManagerRule(1.0, 0.25, None, None, True))
    return rows.select("k", "t", "reverting", F.col("h").alias("held"), F.col("w").alias("why"), F.col("position").alias("following"), F.col("why").alias("why_following"))


@query(
    f"""WITH {DAILY}, a AS (SELECT k, t, x, row_number() OVER w AS i FROM q WINDOW w AS (PARTITION BY k ORDER BY t)), e AS (SELECT a.k, a.t, a.x, pow(1 - 2.0 / 7, a.i - b.i) AS w, b.x AS y FROM a JOIN a b ON a.k = b.k AND b.i <= a.i),
    g AS (SELECT k, t, first(x) AS x, count(*) AS n, sum(w) AS w, sum(w * w) AS ww, sum(w * y) / sum(w) AS m FROM e GROUP BY k, t), h AS (SELECT e.k, e.t, sum(e.w * (y - m) * (y - m)) AS ss FROM e JOIN g ON g.k = e.k AND g.t = e.t GROUP BY ALL)
    SELECT k, t, CASE WHEN n >= 3 THEN greatest(-3, least(3, (x - m) / greatest(sqrt(ss / w * w * w / (w * w - ww)), 1e-12))) END AS z FROM g JOIN h USING (k, t)""",
    "z",
)
def ewma_zscores(t: Tables) -> DataFrame:
    """Scores against exponentially weighted means and deviations."""
    return signals.ewma_zscore(t.daily(), DAYS, "x", 6, clip=3.0, min_periods=3).select("k", "t", "z")


@query(
    f"""WITH {DAILY}, a AS (SELECT k, t, x - avg(x) OVER (PARTITION BY k) AS e FROM q), b AS (SELECT k, e, sum(e) OVER (PARTITION BY k ORDER BY t) AS s FROM a)
    SELECT k, count(*) AS n, sum(s * s) / count(*) / count(*) / (sum(e * e) / count(*)) AS kpss FROM b GROUP BY k""",
    "kpss",
)
def level_stationarity(t: Tables) -> DataFrame:
    """Level-stationarity statistic of every part's daily prices."""
    return signals.kpss(t.daily(), DAYS, "x")


@query(
    f"""WITH b AS ({{blotter}}) SELECT k, count(*) AS n_trades, avg((pnl > 0)::INT::DOUBLE) AS win_rate, avg(pnl) AS expectancy, sum(greatest(pnl, 0)) / nullif(sum(greatest(-pnl, 0)), 0) AS profit_factor, avg(bars) AS avg_bars FROM b GROUP BY k""".replace("{blotter}", SQL["trade_blotter"]),
    "win_rate expectancy profit_factor avg_bars",
)
def trade_statistics(t: Tables) -> DataFrame:
    """Trades per part: hit rate, expectancy, profit factor, rows held."""
    from .registry import QUERIES

    blotter = QUERIES["trade_blotter"](t.spark, t.folder)
    return _finite(signals.trade_summary(blotter, ("k",)), "profit_factor")


def _finite(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(F.abs(F.col(c)) < 1e300, F.col(c)) for c in columns})


@query(
    f"""WITH f AS ({SQL["fifo_round_trips"]}) SELECT k, side, count(*) AS n_trips, sum(qty) AS qty, sum(pnl) AS pnl, avg((pnl > 0)::INT::DOUBLE) AS hit_rate, sum(greatest(pnl, 0)) / nullif(sum(greatest(-pnl, 0)), 0) AS profit_factor FROM f GROUP BY k, side""",
    "qty pnl hit_rate profit_factor",
)
def round_trip_statistics(t: Tables) -> DataFrame:
    """Round trips per part and side."""
    from .registry import QUERIES

    trips = QUERIES["fifo_round_trips"](t.spark, t.folder)
    return _finite(backtest.lot_stats(trips, ["k", "side"]), "profit_factor")


# -- structures ----------------------------------------------------------------

_DV = "l_quantity AS f, l_extendedprice / l_quantity / 100 AS b, l_discount * 100 + 1 AS k"


@query(
    f"""WITH d AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_shipdate AS t, {_DV} FROM lineitem)
    SELECT o, n, p, s, t, -(f + k) / b AS neutral_belly, b / (f + k) AS equal_wing, -(f - 2 * b) / k AS solved_back, f / (f + b + k) AS l1_front, b / sqrt(f * f + b * b + k * k) AS l2_belly, k / b AS fixed_back, f - 2 * b + k AS value FROM d""",
    "neutral_belly equal_wing solved_back l1_front l2_belly fixed_back value",
)
def leg_weights(t: Tables) -> DataFrame:
    """Neutral, equal-wing, solved and normalised weights of three legs, and a value of fixed ones."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_shipdate").alias("t"), F.col("l_quantity").alias("f"), (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("b"), (F.col("l_discount") * 100 + 1).alias("k"))
    legs = [F.col(c) for c in "fbk"]
    back = structures.neutral_wing({"front": F.lit(1.0), "belly": F.lit(-2.0)}, dict(zip(("front", "belly", "back"), legs, strict=True)))
    return rows.select(
        "o", "n", "p", "s", "t", structures.duration_neutral_weights(*legs)["belly"].alias("neutral_belly"), structures.equal_wing_weights(*legs)["front"].alias("equal_wing"), back.alias("solved_back"),
        structures.normalise_weights(legs, "l1")[0].alias("l1_front"), structures.normalise_weights(legs, "l2")[1].alias("l2_belly"), structures.normalise_weights(legs, "belly_fixed")[2].alias("fixed_back"),
        structures.weighted_value(legs, [1.0, -2.0, 1.0]).alias("value"),
    )


@query(
    f"""WITH {_LEGS}, a AS (SELECT v.*, fi, bi, ki FROM v JOIN l USING (t)) SELECT t, leg, id, weight, price FROM (SELECT t, 'front' AS leg, fi AS id, bd / (fd + kd) AS weight, fp AS price FROM a UNION ALL SELECT t, 'belly', bi, -1.0, bp FROM a UNION ALL SELECT t, 'back', ki, bd / (fd + kd), kp FROM a)""",
    "weight price",
)
def leg_panel(t: Tables) -> DataFrame:
    """One row per day and leg of a structure."""
    return structures.legs_long(_structure(t), "t", ["price"])


_CHANGES = f"""{DAILY}, r AS (SELECT k, t, lag(x) OVER w AS f, x AS y, v AS b FROM q WINDOW w AS (PARTITION BY k ORDER BY t)),
  d AS (SELECT k, t, f - lag(f) OVER w AS f, y - lag(y) OVER w AS y, b - lag(b) OVER w AS b FROM r WINDOW w AS (PARTITION BY k ORDER BY t)), u AS (SELECT k, t, f, y, b, CASE WHEN f IS NOT NULL AND y IS NOT NULL AND b IS NOT NULL THEN 1 END AS ok FROM d)"""
_MOMENTS = ", ".join([f"count(ok) OVER g AS n, avg(y * ok) OVER g AS my, avg(f * ok) OVER g AS mf, avg(b * ok) OVER g AS mb", *(f"covar_pop({p} * ok, {q} * ok) OVER g AS c{p}{q}" for p, q in ("ff", "bb", "fb", "fy", "by"))])


@query(
    f"""WITH {_CHANGES}, c AS (SELECT *, {_MOMENTS} FROM u WINDOW g AS (PARTITION BY k ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)), e AS (SELECT *, CASE WHEN n >= 8 AND abs(cff * cbb - cfb * cfb) > 1e-14 THEN cff * cbb - cfb * cfb END AS det FROM c),
    h AS (SELECT *, (cfy * cbb - cby * cfb) / det AS beta_front, (cby * cff - cfy * cfb) / det AS beta_back FROM e), i AS (SELECT *, my - beta_front * mf - beta_back * mb AS alpha FROM h)
    SELECT k, t, beta_front, beta_back, sum(y - alpha - beta_front * f - beta_back * b) OVER (PARTITION BY k ORDER BY t) AS residual FROM i""",
    "beta_front beta_back residual",
)
def change_residuals(t: Tables) -> DataFrame:
    """Rolling regression of changes, with the residual summed up."""
    rows = t.daily().withColumn("a", DAYS.lag("x"))
    return structures.residual_of_changes(rows, DAYS, "a", "x", "v", 12, 8).select("k", "t", "beta_front", "beta_back", "residual")


@query(
    f"""WITH {DAILY}, r AS (SELECT k, t, lag(x) OVER w AS f, x AS y, v AS b FROM q WINDOW w AS (PARTITION BY k ORDER BY t)), u AS (SELECT *, CASE WHEN f IS NOT NULL THEN 1 END AS ok FROM r), c AS (SELECT *, {_MOMENTS} FROM u WINDOW g AS (PARTITION BY k)),
    e AS (SELECT *, CASE WHEN n >= 8 AND abs(cff * cbb - cfb * cfb) > 1e-14 THEN cff * cbb - cfb * cfb END AS det FROM c), h AS (SELECT *, (cfy * cbb - cby * cfb) / det AS beta_front, (cby * cff - cfy * cfb) / det AS beta_back FROM e)
    SELECT k, t, beta_front, beta_back, y - (my - beta_front * mf - beta_back * mb) - beta_front * f - beta_back * b AS residual FROM h""",
    "beta_front beta_back residual",
)
def static_residuals(t: Tables) -> DataFrame:
    """One regression over all of a series."""
    rows = t.daily().withColumn("a", DAYS.lag("x"))
    return structures.residual_three_legs(rows, DAYS, "a", "x", "v", None, 8).select("k", "t", "beta_front", "beta_back", "residual")


@query(
    """SELECT o_orderkey, country, date_diff('day', DATE '1997-01-01', d::DATE) / 365.25 AS ttm FROM (SELECT o_orderkey, o_orderpriority AS country, o_orderdate AS d FROM orders) WHERE country = '2-HIGH' AND date_diff('day', DATE '1997-01-01', d::DATE) / 365.25 BETWEEN 0.5 AND 3""",
    "ttm",
)
def curve_universe(t: Tables) -> DataFrame:
    """Orders as bonds of a country: those with half a year to three years to run."""
    static = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("country"), F.to_date("o_orderdate").alias("maturity_date"))
    return structures.curve_bonds(static, "1997-01-01", "2-HIGH", 0.5, 3.0).select("o_orderkey", "country", "ttm")


_TENORS = {"front": 2.0, "belly": 4.0, "back": 6.0}


@query(
    """WITH e AS (SELECT date_trunc('hour', ts) AS h, user_id AS id, max(value) / 5 AS ttm FROM events GROUP BY ALL), d AS (SELECT h::DATE AS d, arg_min(h, (abs(extract(hour FROM h) * 3600 - 37800), h)) AS bar, min(abs(extract(hour FROM h) * 3600 - 37800)) AS off FROM e GROUP BY 1),
    l AS (SELECT d.d, """ + ", ".join(f"CASE WHEN min(abs(ttm - {v})) <= 1 THEN arg_min(id, (abs(ttm - {v}), id)) END AS {n}" for n, v in _TENORS.items()) + """ FROM d LEFT JOIN e ON e.h = d.bar AND off <= 1800 GROUP BY d.d)
    SELECT d AS trading_date, """ + ", ".join(f"last_value({n} IGNORE NULLS) OVER (ORDER BY d) AS {n}_id" for n in _TENORS) + " FROM l"
)
def daily_leg_table(t: Tables) -> DataFrame:
    """Per day the legs at the bar nearest to half past ten, missing ones from the day before."""
    hours = t.events.groupBy(F.date_trunc("hour", "ts").alias("datetime"), F.col("user_id").alias("bond_id")).agg((F.max("value") / 5).alias("ttm_years"))
    return selection.daily_legs(hours, _TENORS, 37800)


# -- distributions and alignment --------------------------------------------------


@query(
    f"""WITH {_CDF.replace("SELECT a, b, na, nb, x,", "SELECT a, b, na, nb, xs.x AS x,").replace("lead(x) OVER w", "lead(xs.x) OVER w")}, s AS (SELECT a, b, sum(coalesce(abs(fa - fb) * (nx - x), 0)) AS d FROM st GROUP BY a, b)
    SELECT a, b, d AS distance FROM s UNION ALL SELECT b, a, d FROM s UNION ALL SELECT g, g, 0 FROM n""",
    "distance",
)
def distance_table(t: Tables) -> DataFrame:
    """Wasserstein distances of event types, both ways and with the diagonal."""
    return distributions.distance_matrix(t.events, "event_type", "value")


@query(
    """WITH e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND event_type IN ('view', 'purchase', 'click')), m AS (SELECT event_type AS g, avg(value) AS mu, stddev_pop(value) AS sd FROM e GROUP BY 1 HAVING count(value) >= 5)
    SELECT event_type, count(value) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS q50, avg(pow((value - mu) / sd, 3)) AS skew FROM e JOIN m ON g = event_type GROUP BY 1""",
    "mean q50 skew",
)
def compared_groups(t: Tables) -> DataFrame:
    """Summaries of chosen groups in a window of time."""
    found = distributions.compare_groups(t.events, "event_type", "value", "ts", "2024-01-05", "2024-01-20", ["view", "purchase", "click"], 5)
    return found["summaries"].select("event_type", "n", "mean", "q50", "skew")


@query(
    """WITH q AS (SELECT l_suppkey AS k, l_shipdate AS t, avg(l_quantity) AS x FROM lineitem GROUP BY ALL), s AS (SELECT DISTINCT date_trunc('month', t)::TIMESTAMP AS t FROM q), g AS (SELECT DISTINCT q.k, s.t FROM q, s)
    SELECT g.k, g.t::VARCHAR AS t, q.x FROM g ASOF LEFT JOIN q ON g.k = q.k AND g.t >= q.t""",
    "x",
)
def values_at_months(t: Tables) -> DataFrame:
    """Each supplier's last value at the start of every month."""
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("t")).agg(F.avg("l_quantity").alias("x"))
    stamps = rows.select(F.date_trunc("month", "t").cast("timestamp_ntz").alias("t")).distinct()
    return panel.align_to(rows, stamps, "t", ["k"]).withColumn("t", F.col("t").cast("string"))


@query(
    """WITH a AS (SELECT o_orderdate AS d, o_orderpriority AS s, avg(o_totalprice) AS v, count(*)::DOUBLE AS c FROM orders GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT d FROM a), (SELECT DISTINCT s FROM a))
    SELECT * FROM (SELECT g.d, g.s, last_value(v IGNORE NULLS) OVER (PARTITION BY g.s ORDER BY g.d) AS v, coalesce(c, 0) AS c FROM g LEFT JOIN a ON a.d = g.d AND a.s = g.s) WHERE v IS NOT NULL""",
    "v c",
)
def sources_on_clock(t: Tables) -> DataFrame:
    """Two sources on one clock: a value carried forward, a count that is nothing where it is missing."""
    rows = t.orders.groupBy(F.col("o_orderdate").alias("d"), F.col("o_orderpriority").alias("s")).agg(F.avg("o_totalprice").alias("v"), F.count(F.lit(1)).cast("double").alias("c"))
    clock = rows.select("d").distinct().crossJoin(F.broadcast(rows.select("s").distinct()))  # five priorities
    return panel.align_sources(clock, [rows.select("d", "s", "v"), rows.select("d", "s", "c")], "d", "s", ["v"], {"c": 0.0}, ["v"])


@query("SELECT l_orderkey AS o, l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR AS id, l_quantity::DOUBLE AS ratio FROM lineitem", "ratio")
def hedge_pairs(t: Tables) -> DataFrame:
    """Lists of hedges and ratios as rows."""
    line = F.struct("l_linenumber", "l_partkey", "l_quantity")
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(line)).alias("x"))
    rows = rows.select("o", F.transform("x", lambda r: F.concat(r["l_linenumber"].cast("string"), F.lit("-"), r["l_partkey"].cast("string"))).alias("ids"), F.transform("x", lambda r: r["l_quantity"].cast("double")).alias("ratios"))
    return panel.explode_pairs(rows, ["o"], "ids", "ratios")


@query(
    f"""WITH {PANEL}, a AS (SELECT t, k, sum(v) AS position, avg(x) / 1000 AS dv01 FROM p GROUP BY ALL), r AS (SELECT t, k, k % 3 AS h, 0.5 + k % 2 AS ratio FROM a)
    SELECT a.t AS ts, h AS hedge_id, sum(position * dv01 * ratio / (2.0 + h)) AS target FROM a JOIN r ON r.t = a.t AND r.k = a.k GROUP BY ALL""",
    "target",
)
def hedge_quantities(t: Tables) -> DataFrame:
    """Hedges that offset the positions of a day."""
    rows = t.panel().groupBy(F.col("t").alias("ts"), F.col("k").alias("instrument_id")).agg(F.sum("v").alias("position"), (F.avg("x") / 1000).alias("dv01"))
    ratios = rows.select("ts", "instrument_id", (F.col("instrument_id") % 3).alias("hedge_id"), (0.5 + F.col("instrument_id") % 2).alias("ratio"))
    hedges = ratios.select("ts", "hedge_id").distinct().withColumn("hedge_dv01", 2.0 + F.col("hedge_id"))
    return backtest.hedge_targets(rows, ratios, hedges)


# -- strategies and portfolios -------------------------------------------------------


@query(
    f"""WITH {RETURNS}, n AS (SELECT s FROM r WHERE r IS NOT NULL GROUP BY s HAVING count(*) >= 12), c AS (SELECT r.* FROM r JOIN n USING (s) WHERE r IS NOT NULL) SELECT d::VARCHAR AS d, s, r FROM c WHERE d IN (SELECT d FROM c GROUP BY d HAVING count(*) = (SELECT count(*) FROM n))""",
    "r",
)
def aligned_returns(t: Tables) -> DataFrame:
    """Returns of strategies with enough months, on the months that all have."""
    return strategies.clean_returns(t.returns(), "d", "s", "r", min_obs=12).select(F.col("d").cast("timestamp_ntz").cast("string").alias("d"), "s", "r")


@query(f"WITH {_FULL} SELECT x.s AS a, y.s AS b, covar_samp(x.r, y.r) * CASE WHEN x.s = y.s THEN 1 ELSE 0.9 END AS value FROM c x JOIN c y ON x.d = y.d GROUP BY x.s, y.s", "value")
def shrunk_covariances(t: Tables) -> DataFrame:
    """Sample covariances shrunk towards their diagonal."""
    return portfolio.shrink_to_diagonal(portfolio.sample_cov(t.returns(), "d", "s", "r"), 0.1)


@query(
    f"WITH {RETURNS} SELECT s, d::VARCHAR AS d, 0.1 / (stddev_samp(r) OVER a * sqrt(12)) * r AS whole, 0.1 / nullif(stddev_samp(r) OVER b * sqrt(12), 0) * r AS rolling FROM r WINDOW a AS (PARTITION BY s), b AS (PARTITION BY s ORDER BY d ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)",
    "whole rolling",
)
def scaled_returns(t: Tables) -> DataFrame:
    """Returns scaled to a tenth of volatility, by all months and by the twelve before."""
    rows = t.returns().withColumns({"whole": F.col("r"), "rolling": F.col("r")})
    rows = strategies.scaled_to_vol(rows, "d", "s", "whole", 0.1, 12).drop("scale")
    return strategies.scaled_to_vol(rows, "d", "s", "rolling", 0.1, 12, 12).select("s", F.col("d").cast("timestamp_ntz").cast("string").alias("d"), "whole", "rolling")


_INVERSE = f"{RETURNS}, w AS (SELECT s, (1 / greatest(stddev_samp(r), 1e-6)) / sum(1 / greatest(stddev_samp(r), 1e-6)) OVER () AS w FROM r GROUP BY s)"


def _inverse(t: Tables) -> DataFrame:
    return portfolio.inverse_vol(t.returns().groupBy("s").agg(F.stddev_samp("r").alias("vol")), "s", "vol").select("s", "weight")


@query(f"WITH {_INVERSE} SELECT d::VARCHAR AS d, sum(r * w) - CASE WHEN row_number() OVER (ORDER BY d) = 1 THEN 0.001 ELSE 0 END AS ret FROM r JOIN w USING (s) GROUP BY d", "ret")
def portfolio_path(t: Tables) -> DataFrame:
    """Returns of inverse-volatility weights, the first month paying for the entry."""
    out = portfolio.portfolio_returns(t.returns(), _inverse(t), "d", "s", "r", 0.001)
    return out.select(F.col("d").cast("timestamp_ntz").cast("string").alias("d"), "ret")


@query(f"WITH {_INVERSE}, f AS (SELECT d FROM r GROUP BY d HAVING count(DISTINCT s) = (SELECT count(*) FROM w)), m AS (SELECT x.s AS a, y.s AS b, covar_samp(x.r, y.r) AS v FROM r x JOIN r y ON x.d = y.d WHERE x.d IN (SELECT d FROM f) GROUP BY ALL) SELECT sum(p.w * q.w * v) * 1e6 AS variance, sqrt(sum(p.w * q.w * v)) AS vol FROM m JOIN w p ON p.s = a JOIN w q ON q.s = b", "variance vol")
def portfolio_volatility(t: Tables) -> DataFrame:
    """Variance (in millionths) and volatility of the weighted whole."""
    cov = portfolio.sample_cov(t.returns(), "d", "s", "r")
    return portfolio.portfolio_variance(_inverse(t), cov, "s").withColumn("variance", F.col("variance") * 1e6)


@query(f"WITH {_INVERSE} SELECT s, CASE WHEN abs(w - 0.2) < 0.01 THEN 0.2 ELSE w END AS weight, CASE WHEN w < 0.01 THEN 0 ELSE w END AS entered FROM w", "weight entered")
def banded_weights(t: Tables) -> DataFrame:
    """Weights that only move beyond a band around the old ones."""
    rows = _inverse(t)
    return rows.select("s", portfolio.no_trade_band(F.lit(0.2), F.col("weight"), 0.01).alias("weight"), portfolio.no_trade_band(F.lit(None).cast("double"), F.col("weight"), 0.01).alias("entered"))


@query(
    f"""WITH RECURSIVE {RETURNS}, m AS (SELECT x.s AS a, y.s AS b, corr(x.r, y.r) AS c, count(*) AS n FROM r x JOIN r y ON x.d = y.d GROUP BY ALL HAVING count(*) >= 12), e AS (SELECT a, b FROM m WHERE c >= 0.05 AND a <> b UNION SELECT DISTINCT s, s FROM r),
    p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON e.a = p.b), l AS (SELECT a AS key, min(b) AS cluster FROM p GROUP BY a), v AS (SELECT s AS key, avg(r) / stddev_samp(r) AS sharpe FROM r GROUP BY s)
    SELECT key, cluster, (row_number() OVER (PARTITION BY cluster ORDER BY sharpe DESC, key))::INT AS place FROM l JOIN v USING (key)""",
)
def strategy_clusters(t: Tables) -> DataFrame:
    """Clusters of correlated strategies, their members by Sharpe."""
    labels = portfolio.clusters(portfolio.pairwise(t.returns(), "d", "s", "r", 12), 0.05)
    scores = t.returns().groupBy(F.col("s").alias("key")).agg((F.avg("r") / F.stddev_samp("r")).alias("sharpe"))
    return portfolio.best_of_clusters(labels, scores, "sharpe", 1000).select("key", "cluster", "place")


@query(f"WITH m AS ({SQL['return_metrics']}) SELECT s, sharpe, annual_vol FROM m WHERE n >= 12 AND sharpe >= 0 AND annual_vol <= 0.32", "")
def standalone_gates(t: Tables) -> DataFrame:
    """Strategies that pass thresholds on their own metrics."""
    from .registry import QUERIES

    return portfolio.passes(QUERIES["return_metrics"](t.spark, t.folder), {"n": 12, "sharpe": 0, "no such metric": 1}, {"annual_vol": 0.32}).select("s", "sharpe", "annual_vol")


@query(
    f"""WITH {DAILY}, a AS (SELECT k, t, v, abs(v - coalesce(lag(v) OVER (PARTITION BY k ORDER BY t), 0)) AS tr FROM q) SELECT k, coalesce(avg(tr) / nullif(avg(CASE WHEN v > 0 THEN v END), 0) * 252, 0) AS turnover FROM a GROUP BY k""",
    "turnover",
)
def annual_turnovers(t: Tables) -> DataFrame:
    """Traded over mean gross, per year and part."""
    rows = t.daily().withColumn("tr", F.abs(F.col("v") - F.coalesce(DAYS.lag("v"), F.lit(0.0))))
    return rows.groupBy("k").agg(metrics.annual_turnover(F.col("tr"), F.col("v")).alias("turnover"))


@query(
    f"""WITH {DAILY}, a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM q), f AS (SELECT a.k, a.t, a.i, b.i AS j, b.x - avg(b.x) OVER (PARTITION BY a.k, a.i) AS e FROM a JOIN a b ON b.k = a.k AND b.i BETWEEN a.i - 11 AND a.i),
    s AS (SELECT *, sum(e) OVER (PARTITION BY k, i ORDER BY j) AS s FROM f), g AS (SELECT k, t, count(*) AS n, sum(s * s) / 12 / nullif(sum(e * e), 0) AS kpss FROM s GROUP BY k, t)
    SELECT k, t, CASE WHEN n = 12 THEN kpss END AS kpss, CASE WHEN n < 12 THEN NULL WHEN kpss IS NULL THEN 0 WHEN kpss > 0.739 THEN 0.01 WHEN kpss > 0.463 THEN 0.05 WHEN kpss > 0.347 THEN 0.1 ELSE 0.5 END AS p FROM g""",
    "kpss p",
)
def rolling_stationarity(t: Tables) -> DataFrame:
    """Rolling level-stationarity statistic and p-step of twelve days."""
    stat, p = signals.rolling_kpss(DAYS, "x", 12)
    return t.daily().select("k", "t", stat.alias("kpss"), p.alias("p"))


_MAPPED = """m AS (SELECT c, b, id, a, lead(a) OVER (PARTITION BY c, b ORDER BY a, id) AS z FROM (SELECT o_orderpriority AS c, o_orderstatus AS b, o_orderkey AS id, o_orderdate::DATE AS a FROM orders)), ask AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS d FROM orders),
  n AS (SELECT d, c, b, arg_max(id, (a, id))::VARCHAR AS id FROM ask JOIN m ON a <= d AND (z IS NULL OR d < z) GROUP BY ALL)"""


def _mapped(t: Tables) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.window import Window

    rows = t.orders.select(F.col("o_orderpriority").alias("country"), F.col("o_orderstatus").alias("bucket"), F.col("o_orderkey").alias("isin"), F.to_date("o_orderdate").alias("effective_from"))
    rows = rows.withColumn("effective_to", F.lead("effective_from").over(Window.partitionBy("country", "bucket").orderBy("effective_from", "isin")))
    asked = t.orders.select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("asof")).distinct()
    return rows, asked.join(F.broadcast(rows.select("country").distinct()), F.lit(True))  # five countries


@query(
    f"""WITH {_MAPPED}, f AS (SELECT x.d, x.c, x.id AS i1, y.id AS i2, z.id AS i3 FROM n x JOIN n y ON y.d = x.d AND y.c = x.c AND y.b = 'O' JOIN n z ON z.d = x.d AND z.c = x.c AND z.b = 'P' WHERE x.b = 'F')
    SELECT d AS asof, c AS country, 'CTD_FLY' AS type, c || '_CTD_FOP_FLY' AS name, 'F,O,P' AS tenors, 'short:' || i1 || ';mid:' || i2 || ';long:' || i3 AS legs FROM f
    UNION ALL SELECT x.d, x.c, 'CTD_SWITCH', x.c || '_CTD_FO_SWITCH', 'F,O', 'left:' || x.id || ';right:' || y.id FROM n x JOIN n y ON y.d = x.d AND y.c = x.c AND y.b = 'O' WHERE x.b = 'F'
    UNION ALL SELECT x.d, NULL, 'CROSS_COUNTRY_SPREAD', '1-URGENT5-LOW_BM_' || x.b || '_SPREAD', x.b, '1-URGENT:' || x.id || ';5-LOW:' || y.id FROM n x JOIN n y ON y.d = x.d AND y.b = x.b AND y.c = '5-LOW' WHERE x.c = '1-URGENT' AND x.b IN ('F', 'O')"""
)
def structure_universe(t: Tables) -> DataFrame:
    """Flies, switches and cross-country spreads of the instruments in force at every month's start."""
    mapping, asked = _mapped(t)
    flies = structures.mapped_structures(mapping, asked, "CTD_FLY", [("F", "O", "P")], ("short", "mid", "long"), "CTD")
    switches = structures.mapped_structures(mapping, asked, "CTD_SWITCH", [("F", "O")], ("left", "right"), "CTD")
    return structures.structure_table(flies, switches, structures.mapped_spreads(mapping, asked, [("1-URGENT", "5-LOW")], ["F", "O"]))


@query(
    f"""WITH RECURSIVE {{sig}}, a AS (SELECT z.t, 'fly_' || z.k || '_' || (z.k + 1) || '_' || (z.k + 2) AS strategy_id, s.pos, z.z, z.k FROM z JOIN s USING (k, i) WHERE s.pos <> 0)
    SELECT t AS timestamp, strategy_id, pos::INT AS direction, z AS signal_value, least(abs(z) / 4, 1) AS confidence, (k + o)::VARCHAR AS bond_id, w::DOUBLE AS weight FROM a, (VALUES (0, 1.0), (1, -2.0), (2, 1.0)) l(o, w)""".replace("{sig}", _SIG),
    "signal_value confidence weight",
)
def active_strategy_signals(t: Tables) -> DataFrame:
    """Signals that are not flat, with their legs."""
    rows = _signals(t).withColumns({"b": F.col("k") + 1, "c": F.col("k") + 2, "strength": signals.signal_strength(F.col("z"), F.col("signal"))})
    made = portfolio.chosen_signals(portfolio.strategy_signals(rows, "t", ["k", "b", "c"], z="z"), active=True)
    return made.select("timestamp", "strategy_id", "direction", "signal_value", "confidence", F.explode("legs").alias("leg")).select("timestamp", "strategy_id", "direction", "signal_value", "confidence", "leg.*")


@query(f"WITH {RETURNS}, v AS (SELECT s, stddev_samp(r) AS v FROM r GROUP BY s), m AS (SELECT x.s AS a, y.s AS b, corr(x.r, y.r) AS c FROM r x JOIN r y ON x.d = y.d GROUP BY ALL HAVING count(*) >= 12) SELECT a, b, c * p.v * q.v AS value FROM m JOIN v p ON p.s = a JOIN v q ON q.s = b", "value")
def pairwise_covariances(t: Tables) -> DataFrame:
    """Pairwise correlations scaled by each strategy's own deviation."""
    corr = portfolio.pairwise(t.returns(), "d", "s", "r", 12).where("corr IS NOT NULL")
    return portfolio.cov_of_correlations(t.returns(), "s", "r", corr)


@query(f"WITH w AS ({SQL['rolling_weights']}), x AS (SELECT d, s, CASE WHEN month(d) = 3 THEN -weight WHEN month(d) = 4 AND s = '5-LOW' THEN NULL ELSE weight END AS weight FROM w) SELECT d::VARCHAR AS d, count(*) - count(weight) AS n_missing, sum((weight < 0)::INT)::BIGINT AS n_negative, sum(weight) AS total, count(*) = count(weight) AND min(weight) >= 0 AND abs(sum(weight) - 1) <= 1e-4 AS is_valid FROM x GROUP BY d", "total")
def weight_checks(t: Tables) -> DataFrame:
    """Faults of every month's weights, some of them planted."""
    from .registry import QUERIES

    month = F.month("d")
    rows = QUERIES["rolling_weights"](t.spark, t.folder)
    rows = rows.withColumn("weight", F.when(month == 3, -F.col("weight")).when((month == 4) & (F.col("s") == "5-LOW"), None).otherwise(F.col("weight")))
    return portfolio.weight_faults(rows, ["d"], tolerance=1e-4).withColumn("d", F.col("d").cast("timestamp_ntz").cast("string"))


# -- accounting, books and simulations --------------------------------------------------


@query(
    f"""WITH {DAILY}, a AS (SELECT k, t, CASE WHEN v > 25 THEN 1.0 ELSE -1.0 END AS w, x FROM q), b AS (SELECT k, t, coalesce(lag(w) OVER z, 0) * coalesce(x - lag(x) OVER z, 0) * 2 AS step_pnl FROM a WINDOW z AS (PARTITION BY k ORDER BY t)), c AS (SELECT *, sum(step_pnl) OVER (PARTITION BY k ORDER BY t) AS equity FROM b),
    d AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY k ORDER BY t)) AS peak FROM c) SELECT k, t, step_pnl, equity, peak, peak - equity AS drawdown FROM d""",
    "step_pnl equity peak drawdown",
)
def frictionless_equity(t: Tables) -> DataFrame:
    """Steps, equity, peak and drawdown of targets held at mid."""
    rows = t.daily().withColumn("w", F.when(F.col("v") > 25, 1.0).otherwise(-1.0))
    return backtest.frictionless(rows, DAYS, "w", "x", 2.0).select("k", "t", "step_pnl", "equity", "peak", "drawdown")


@query(
    "SELECT user_id, ts::DATE AS trading_date, sum(value) AS pnl, count(*)::DOUBLE AS n, arg_max(value, ts) AS equity, sum(sum(value)) OVER (PARTITION BY user_id ORDER BY ts::DATE) AS cum_pnl FROM events GROUP BY user_id, ts::DATE",
    "pnl n equity cum_pnl",
)
def day_totals(t: Tables) -> DataFrame:
    """Sums, last values and running totals per user and day."""
    rows = t.events.select("user_id", "ts", F.col("value").alias("pnl"), F.lit(1.0).alias("n"), F.col("value").alias("equity"))
    return backtest.daily_totals(rows, "ts", ["user_id"], ["pnl", "n"], ["equity"])


_ROW = "l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_shipdate AS t"


@query(
    f"""WITH d AS (SELECT {_ROW}, l_quantity - 25 AS q, l_extendedprice / l_quantity AS x, l_discount AS r, l_extendedprice AS e FROM lineitem)
    SELECT o, n, p, s, t, (x + x * (1 + r)) * 0.5 AS mid, e * r / 252 AS interest, q * r * 0.5 * 2 AS coupon, -(greatest(q * x, 0) * r + greatest(-q * x, 0) * (r + 50 / 1e4)) / 252 AS repo, greatest(-10, least(10, q)) AS clipped, CASE WHEN (e - x) / e > 0.95 THEN 0 ELSE 1 END AS flat,
      CASE WHEN (e - x) / e > 0.5 THEN greatest(0, 1 - ((e - x) / e - 0.5) / 0.5) ELSE 1 END AS linear, x AS external FROM d""",
    "mid interest coupon repo clipped flat linear external",
)
def funding_and_marks(t: Tables) -> DataFrame:
    """Marks, interest, coupons, repo, clips and drawdown scales, row by row."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_shipdate").alias("t"), (F.col("l_quantity") - 25).alias("q"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"), F.col("l_discount").alias("r"), F.col("l_extendedprice").alias("e"))
    q, x, r, e = (F.col(c) for c in "qxre")
    year = F.lit(1 / 252)
    return rows.select(
        "o", "n", "p", "s", "t", ex.mark("MID", x, x * (1 + r), x, x).alias("mid"), ex.interest(e, r, year).alias("interest"), ex.coupon(q, r, F.lit(0.5), 2.0).alias("coupon"), ex.repo_cost(q, x, r, F.lit(50.0), year).alias("repo"),
        ex.clip(q, 10.0).alias("clipped"), ex.drawdown_scale(x, e, 0.95).alias("flat"), ex.drawdown_scale(x, e, 0.5, "LINEAR").alias("linear"), ex.mark("EXTERNAL", x, x, x, x).alias("external"),
    )


_SIDES = "b AS (SELECT l_orderkey AS id, l_extendedprice / l_quantity AS px, l_quantity AS sz, l_linenumber AS n, l_partkey AS p FROM lineitem), c AS (SELECT *, coalesce(sum(sz) OVER u, 0) AS up, coalesce(sum(sz) OVER d, 0) AS dn, row_number() OVER (PARTITION BY id ORDER BY px, n, p, sz) AS i, row_number() OVER (PARTITION BY id ORDER BY px DESC, n DESC, p DESC, sz DESC) AS j FROM b WINDOW u AS (PARTITION BY id ORDER BY px, n, p, sz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), d AS (PARTITION BY id ORDER BY px DESC, n DESC, p DESC, sz DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(
    f"""WITH {_SIDES}, g AS (SELECT id, sum(CASE WHEN id % 2 = 0 THEN greatest(0, least(60 - up, sz)) ELSE greatest(0, least(60 - dn, sz)) END) AS got, sum(px * CASE WHEN id % 2 = 0 THEN greatest(0, least(60 - up, sz)) ELSE greatest(0, least(60 - dn, sz)) END) AS paid, max(CASE WHEN i = 1 THEN px END) AS ask, max(CASE WHEN j = 1 THEN px END) AS bid, max(CASE WHEN i = 1 AND id % 2 = 0 THEN sz WHEN j = 1 AND id % 2 = 1 THEN sz END) AS top FROM c GROUP BY id)
    SELECT id, CASE WHEN got < 60 - 1e-12 THEN 0 ELSE got END AS filled, CASE WHEN got >= 60 - 1e-12 THEN paid / got END AS px, CASE WHEN got < 60 - 1e-12 THEN 2 ELSE 0 END::INT AS reason, least(60, top * 0.5) AS top_filled, CASE WHEN id % 2 = 0 THEN ask ELSE bid END AS top_px, ask >= bid AS valid FROM g""",
    "filled px top_filled top_px",
)
def book_fills(t: Tables) -> DataFrame:
    """Sixty units on either side of each order's book, all or nothing, and at the best level."""
    level = F.struct((F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("sz"))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(level)).alias("up"))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["px"].alias("px"), x["sz"].alias("sz")))
    rows = rows.select("id", plain(F.col("up")).alias("ask"), plain(F.reverse("up")).alias("bid"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("side"))
    fill = ex.walk_fill(F.col("side"), F.lit(60.0), F.col("bid"), F.col("ask"), allow_partial=False)
    top = ex.top_fill(F.col("side"), F.lit(60.0), F.col("bid"), F.col("ask"), 0.5)
    a, b = F.col("ask")[0]["px"], F.col("bid")[0]["px"]
    return rows.withColumns({"f": fill, "g": top}).select("id", "f.filled", "f.px", "f.reason", F.col("g.filled").alias("top_filled"), F.col("g.px").alias("top_px"), ex.book_valid(a, a, (a + b) / 2).alias("crossed"), (a >= b).alias("_v")).select("id", "filled", "px", "reason", "top_filled", "top_px", (F.col("crossed") | (F.col("_v"))).alias("valid"))


_MARKET = """q AS (SELECT l_suppkey AS k, l_shipdate AS t, avg(l_extendedprice / l_quantity) AS x, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL),
  b AS (SELECT k, t, x AS mid, v, 2.0::DOUBLE + k % 5 AS dv, x / 100 AS yl, CASE WHEN k % 3 = 0 THEN 0.2 ELSE 50.0 END::DOUBLE AS gain, row_number() OVER w AS i, CASE WHEN count(x) OVER f >= 5 THEN (x - avg(x) OVER f) / greatest(stddev_samp(x) OVER f, 1e-12) END AS z
    FROM q WINDOW w AS (PARTITION BY k ORDER BY t), f AS (PARTITION BY k ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""
#: What is taken of the two levels of a side, at half a point and one and a half from mid, for a quantity q in direction dir.
_TAKE = "least(q, v) + greatest(0, least(q - v, 2 * v)) AS got, CASE WHEN dir > 0 THEN least(q, v) * (mid + 0.5) + greatest(0, least(q - v, 2 * v)) * (mid + 1.5) ELSE least(q, v) * (mid - 0.5) + greatest(0, least(q - v, 2 * v)) * (mid - 1.5) END AS paid"
_BASKET = f"""{_MARKET}, g AS (SELECT * FROM (VALUES (0::BIGINT, 1.0::DOUBLE, 4), (1, 1.0, 9), (2, 1.5, 4)) g(scenario, entry, most)),
s AS (SELECT DISTINCT k, scenario, entry, most, 0::BIGINT AS i, 0 AS side, 0 AS held, 0 AS wait, 0::DOUBLE AS pos, 0::DOUBLE AS cash, 0::DOUBLE AS ey, 0::DOUBLE AS equity, 0 AS code, 0::DOUBLE AS cost, 0::DOUBLE AS pnl FROM b, g
  UNION ALL SELECT k, scenario, entry, most, i, CASE WHEN goes THEN 0 WHEN comes THEN want ELSE side END, CASE WHEN goes OR comes THEN 0 WHEN side <> 0 THEN held + 1 ELSE held END, CASE WHEN goes THEN 2 WHEN side = 0 AND wait > 0 THEN wait - 1 ELSE wait END,
    npos, ncash, CASE WHEN comes THEN yl ELSE ey END, ncash + npos * mid, CASE WHEN why > 0 THEN CASE WHEN fills THEN why ELSE 8 END WHEN tries THEN CASE WHEN NOT fills THEN 2 WHEN wide THEN 4 ELSE 1 END ELSE 0 END, CASE WHEN goes OR comes THEN abs(paid - q * mid) ELSE 0 END, ncash + npos * mid - equity
  FROM (SELECT *, CASE WHEN goes THEN 0 WHEN comes THEN want * q ELSE pos END AS npos, CASE WHEN goes OR comes THEN cash - dir * paid ELSE cash END AS ncash
  FROM (SELECT *, why > 0 AND fills AS goes, tries AND fills AND NOT wide AS comes FROM (SELECT *, got >= q - 1e-9 AS fills, 2 * abs(paid - q * mid) > gain * 100 AS wide
  FROM (SELECT *, {_TAKE} FROM (SELECT *, CASE WHEN side <> 0 THEN abs(pos) ELSE 100 / dv END AS q, CASE WHEN side <> 0 THEN -side ELSE want END AS dir,
    CASE WHEN side = 0 THEN 0 WHEN won <= -4 THEN 6 WHEN held + 1 >= most THEN 7 WHEN won >= 3 OR (coalesce(side * z <= 0, false) AND won > 0) THEN 5 ELSE 0 END AS why, side = 0 AND wait = 0 AND coalesce(abs(z) >= entry, false) AS tries
  FROM (SELECT s.k, scenario, entry, most, b.i, side, held, wait, pos, cash, ey, equity, mid, v, dv, yl, gain, z, CASE WHEN z > 0 THEN 1 ELSE -1 END AS want, side * (ey - yl) AS won FROM s JOIN b ON b.k = s.k AND b.i = s.i + 1)))))))"""


def _market(t: Tables) -> DataFrame:
    """Daily prices of suppliers as books of two levels a side."""
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("ref"), F.col("l_shipdate").alias("ts")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("mid"), F.sum("l_quantity").cast("double").alias("v"))
    level = lambda away, times: F.struct((F.col("mid") + away).alias("px"), (F.col("v") * times).alias("sz"))
    books = rows.withColumn("z", win.zscore(Axis(("ts",), ("ref",)), "mid", 5)).withColumns({"bid": F.array(level(-0.5, 1), level(-1.5, 2)), "ask": F.array(level(0.5, 1), level(1.5, 2)), "dv01": 2.0 + F.col("ref") % 5})
    return books.withColumns({"gain": F.when(F.col("ref") % 3 == 0, 0.2).otherwise(50.0), "package_yield": F.col("mid") / 100})


def _baskets(t: Tables) -> DataFrame:
    leg = F.struct(F.col("ref").alias("id"), "bid", "ask", "mid", "dv01", F.lit(1.0).alias("ratio"))
    market = _market(t).select("ref", "ts", F.array(leg).alias("legs"), "z", "gain", "package_yield")
    grid = t.spark.range(3).select(F.col("id").alias("scenario"), F.when(F.col("id") == 2, 1.5).otherwise(1.0).alias("entry_z"), F.when(F.col("id") == 1, 9).otherwise(4).alias("max_hold"))
    grid = grid.withColumns({"take_profit_yield": F.lit(3.0), "stop_yield": F.lit(4.0), "cooldown": F.lit(2)})
    return backtest.basket_backtest(market, grid, "ref", ["entry_z", "max_hold", "take_profit_yield", "stop_yield", "cooldown"])


@query(f"WITH RECURSIVE {_BASKET} SELECT k AS ref, scenario, b.t AS ts, (i - 1)::INT AS bar, code::INT AS code, side::INT AS state, held::INT AS held, cost, pnl, equity FROM s JOIN b USING (k, i) WHERE i > 0", "cost pnl equity")
def basket_backtests(t: Tables) -> DataFrame:
    """Three scenarios of a basket rule on every supplier's books: entries, exits, costs, equity."""
    return _baskets(t)


@query(
    f"""WITH RECURSIVE {_BASKET}, a AS (SELECT k, scenario, i - 1 AS bar, code, pnl, cost, sum((code = 1)::INT) OVER w AS trade, coalesce(sum((code IN (5, 6, 7))::INT) OVER (PARTITION BY k, scenario ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM s WHERE i > 0 WINDOW w AS (PARTITION BY k, scenario ORDER BY i))
    SELECT k AS ref, scenario, min(bar)::INT AS entry_bar, max(CASE WHEN code IN (5, 6, 7) THEN bar END)::INT AS exit_bar, arg_max(code, bar)::INT AS exit_code, sum(pnl) AS pnl, sum(cost) AS cost FROM a WHERE trade > closed GROUP BY k, scenario, trade""",
    "pnl cost",
)
def basket_trades(t: Tables) -> DataFrame:
    """Trades of the basket simulations."""
    return backtest.basket_trades(_baskets(t))


_SINGLE = f"""{_MARKET}, s AS (SELECT DISTINCT k, 0::BIGINT AS i, 0 AS wait, 0::DOUBLE AS pos, 0::DOUBLE AS cash, 0::DOUBLE AS equity, 0::DOUBLE AS hpos, 0::DOUBLE AS hval, 0 AS code, 0 AS dir, 0::DOUBLE AS q, 0::DOUBLE AS got, 0::DOUBLE AS paid, 0 AS does, 0 AS tries, 0::DOUBLE AS cost, 0::DOUBLE AS hcost, 0::DOUBLE AS pnl, 0::DOUBLE AS hpnl, 0::DOUBLE AS trade, 0::DOUBLE AS hpx, 0::DOUBLE AS alpha, 0 AS dec FROM b
  UNION ALL SELECT k, i, CASE WHEN wait > 0 THEN wait - 1 WHEN does THEN 2 ELSE 0 END, npos, ncash - trade * hpx, ncash - trade * hpx + npos * mid + (hpos + trade) * hm, hpos + trade, (hpos + trade) * hm,
    CASE WHEN wait > 0 THEN 2 WHEN NOT opens THEN 1 WHEN NOT tries THEN 200 WHEN does AND got >= q - 1e-10 THEN 100 WHEN does THEN 101 ELSE 102 END, dir, q, got, paid, does::INT, tries::INT, CASE WHEN does THEN abs(paid - got * mid) ELSE 0 END, abs(trade) * 0.25,
    ncash - trade * hpx + npos * mid + (hpos + trade) * hm - equity, (hpos + trade) * hm - hval - trade * hpx, trade, hpx, alpha, dec::INT
  FROM (SELECT *, npos * dv * -0.5 / 2 - hpos AS trade, hm + 0.25 * sign(npos * dv * -0.5 / 2 - hpos) AS hpx
  FROM (SELECT *, CASE WHEN does THEN pos + dir * got ELSE pos END AS npos, CASE WHEN does THEN cash - dir * paid ELSE cash END AS ncash
  FROM (SELECT *, tries AND got >= 1e-15 AND got >= 0.5 * q AS does FROM (SELECT *, opens AND q >= 1e-15 AS tries, {_TAKE}
  FROM (SELECT *, CASE WHEN least(least(room, 3 * v) * dv, 300) / dv < 2 THEN 0 ELSE round_even(least(least(room, 3 * v) * dv, 300) / dv, 0) END AS q,
    wait = 0 AND coalesce(abs(z) > CASE WHEN dec THEN 0.8 ELSE 1 END, false) AND coalesce(alpha > CASE WHEN dec THEN 0.02 ELSE 0.05 END, false) AND room >= 1e-15 AS opens
  FROM (SELECT *, CASE WHEN dec THEN least(head, abs(pos)) ELSE head END AS room
  FROM (SELECT *, dir * pos < -1e-15 AS dec, 60 - dir * pos AS head FROM (SELECT s.k, b.i, wait, pos, cash, equity, hpos, hval, mid, v, dv, z, 50 + mid / 10 AS hm, CASE WHEN z > 0 THEN -1 ELSE 1 END AS dir, (2 * abs(z) - 0.5) / dv AS alpha FROM s JOIN b ON b.k = s.k AND b.i = s.i + 1)))))))))"""
_BOOK_RULE = backtest.PortfolioRule(z_inc=1.0, z_dec=0.8, alpha_inc=0.05, alpha_dec=0.02, gross_cap=300.0, min_fill=0.5, cooldown=2)


def _hedged_market(t: Tables) -> DataFrame:
    z, mid = F.col("z"), F.col("mid")
    ratios = F.create_map(F.lit("h"), F.lit(-0.5))
    row = F.struct(
        F.lit("a").alias("id"), "bid", "ask", "mid", "dv01", (mid - 2 * z).alias("fair"), "z", F.lit(0.01).alias("p"), F.lit(60.0).alias("long_max"), F.lit(-60.0).alias("short_max"),
        F.lit(1.0).alias("step"), F.lit(2.0).alias("min_qty"), ratios.alias("hedge_ratios"),
    )
    side = lambda away: F.array(F.struct((50 + mid / 10 + away).alias("px"), F.lit(1e6).alias("sz")))
    hedge = F.struct(F.lit("h").alias("id"), side(-0.25).alias("bid"), side(0.25).alias("ask"), (50 + mid / 10).alias("mid"), F.lit(2.0).alias("dv01"))
    return _market(t).select(F.col("ref").alias("book"), "ts", "mid", F.array(row).alias("rows"), F.array(hedge).alias("hedges"))


@query(
    f"""WITH RECURSIVE {_SINGLE} SELECT k AS book, b.t AS ts, code::INT AS code, does::INT AS n_trades, cost, hcost AS hedge_cost, does * got * b.dv AS traded_dv01, pnl, pnl + cost + hcost AS gross_pnl, hpnl AS hedge_pnl, equity, pos * mid AS position_value, hval AS hedge_value,
      pos * b.dv AS net_dv01, abs(pos) * b.dv AS gross_dv01, hpos * 2 AS hedge_dv01, wait::INT AS cooldown, (abs(pos) > 1e-12)::INT AS open_positions FROM s JOIN b USING (k, i) WHERE i > 0""",
    "cost hedge_cost traded_dv01 pnl gross_pnl hedge_pnl equity position_value hedge_value net_dv01 gross_dv01 hedge_dv01",
)
def portfolio_backtests(t: Tables) -> DataFrame:
    """The portfolio simulation on books of one instrument and its hedge: gates, caps, sizes, fills, hedges and equity."""
    return backtest.portfolio_backtest(_hedged_market(t), rule=_BOOK_RULE)


@query(
    f"""WITH RECURSIVE {_SINGLE}, f AS (SELECT k AS book, b.t AS ts, s.*, b.mid, b.dv FROM s JOIN b USING (k, i) WHERE i > 0)
    SELECT book, ts, 'a' AS id, false AS hedge, dir::INT AS side, q AS wanted, does * got AS filled, CASE WHEN got >= 1e-15 THEN paid / got END AS px, mid, does * got * dv AS dv01, alpha, dec = 1 AS reducing, cost, (CASE WHEN got < 1e-15 THEN 2 WHEN does = 0 THEN 4 WHEN got < q - 1e-10 THEN 1 ELSE 0 END)::INT AS became FROM f WHERE tries = 1
    UNION ALL SELECT book, ts, 'h', true, sign(trade)::INT, abs(trade), abs(trade), hpx, 50 + mid / 10, abs(trade) * 2, NULL, false, hcost, 0 FROM f WHERE abs(trade) >= 1e-15""",
    "wanted filled px mid dv01 alpha cost",
)
def portfolio_orders(t: Tables) -> DataFrame:
    """Orders of instruments and hedges in the portfolio simulation, with what became of them."""
    return backtest.portfolio_fills(_hedged_market(t), rule=_BOOK_RULE)


@query(
    f"""WITH RECURSIVE {_SINGLE} SELECT k AS book, b.t AS ts, 'a' AS id, pos AS holding, coalesce(lag(pos) OVER w, 0) * coalesce(b.mid - lag(b.mid) OVER w, 0) + does * dir * (got * b.mid - paid) AS pnl
    FROM s JOIN b USING (k, i) WHERE i > 0 WINDOW w AS (PARTITION BY k ORDER BY i)""",
    "holding pnl",
)
def instrument_profits(t: Tables) -> DataFrame:
    """Holding and profit per book, day and instrument."""
    market = _hedged_market(t)
    fills = backtest.portfolio_fills(market, rule=_BOOK_RULE).where("NOT hedge")
    return backtest.instrument_pnl(fills, market.select("book", "ts", F.lit("a").alias("id"), "mid"))


# -- learning and sweeps ----------------------------------------------------------------


@query("SELECT user_id, value, event_id % 7 AS f FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20' AND user_id IN (1, 2, 3, 5, 8, 13, 21) AND event_type <> 'error'", "value")
def supervised_rows(t: Tables) -> DataFrame:
    """Complete rows of chosen groups and dates."""
    roles = learning.Roles("ts", "value", ("f",), "user_id")
    rows = t.events.select("ts", "user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"), (F.col("event_id") % 7).alias("f"))
    roles.check(rows)
    return roles.complete(roles.only(roles.between(rows, "2024-01-03", "2024-01-20"), [1, 2, 3, 5, 8, 13, 21]), meta=True).select("user_id", "value", "f")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS n_groups, min(ts)::VARCHAR AS first, max(ts)::VARCHAR AS last, avg(value) AS target_mean, stddev_pop(value) AS target_std FROM events", "target_mean target_std")
def supervised_summary(t: Tables) -> DataFrame:
    """Rows, groups, span and target of a supervised table."""
    out = learning.Roles("ts", "value", (), "user_id").summary(t.events)
    return out.withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


@query(f"WITH {DAILY}, h AS (SELECT k, t, lead(x, 1) OVER w - x AS h1, lead(x, 3) OVER w - x AS h3 FROM q WINDOW w AS (PARTITION BY k ORDER BY t)) SELECT k, t, 1::INT AS horizon, h1 AS y FROM h WHERE h1 IS NOT NULL UNION ALL SELECT k, t, 3, h3 FROM h WHERE h3 IS NOT NULL", "y")
def stacked_horizons(t: Tables) -> DataFrame:
    """A row per horizon, the horizon a feature."""
    rows = t.daily().select("k", "t", *(c.alias(n) for n, c in win.forward_targets(DAYS, "x", [1, 3]).items()))
    return learning.stacked(rows, ["target_1", "target_3"])


@query("SELECT event_type, avg(w) AS width_mean, quantile_cont(w, 0.5) AS width_median, stddev_pop(w) AS width_std FROM (SELECT event_type, value + 3 - least(value, 20) AS w FROM events) GROUP BY 1", "width_mean width_median width_std")
def interval_widths(t: Tables) -> DataFrame:
    """Mean, median and deviation of interval widths."""
    return t.events.groupBy("event_type").agg(*learning.interval_width(F.least(F.col("value"), F.lit(20.0)), F.col("value") + 3))


@query("SELECT event_id, regr_intercept(y, x) OVER () + regr_slope(y, x) OVER () * x AS prediction FROM (SELECT event_id, value AS y, event_id % 24 + value / 10 AS x FROM events)", "prediction")
def linear_predictions(t: Tables) -> DataFrame:
    """A linear model fitted on all rows."""
    rows = t.events.select("event_id", F.col("value").alias("y"), (F.col("event_id") % 24 + F.col("value") / 10).alias("x")).withColumn("split", F.lit("train"))
    return learning.fit_predict(rows, learning.make_model("linear", "regression", ["x"], "y")).select("event_id", "prediction")


@query("SELECT event_id, 0.5 + 2 * value - 0.25 * (event_id % 5) AS score, 1 / (1 + exp(-(0.5 + 0.02 * value - 0.25 * (event_id % 5)))) AS chance FROM events", "score chance")
def linear_scores(t: Tables) -> DataFrame:
    """Scores of fixed coefficients, plain and through the logistic link."""
    x = F.array("value", (F.col("event_id") % 5).cast("double"))
    return t.events.select("event_id", learning.linear_score(x, [2.0, -0.25], 0.5).alias("score"), learning.linear_score(x, [0.02, -0.25], 0.5, "logit").alias("chance"))


@query(
    """SELECT scenario, ref, score, extra FROM (SELECT p_partkey AS scenario, 'a' AS ref, p_retailprice AS score, NULL::DOUBLE AS extra FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, 'b', p_retailprice * 2, p_size::DOUBLE FROM part WHERE p_size > 25)""",
    "score extra",
)
def joined_results(t: Tables) -> DataFrame:
    """Results of two runs as one table, columns that one lacks being empty."""
    a = t.part.where("p_size <= 25").select(F.col("p_partkey").alias("scenario"), F.lit("a").alias("ref"), F.col("p_retailprice").alias("score"))
    b = t.part.where("p_size > 25").select(F.col("p_partkey").alias("scenario"), F.lit("b").alias("ref"), (F.col("p_retailprice") * 2).alias("score"), F.col("p_size").cast("double").alias("extra"))
    return sweeps.union_all([a, b])


@query("WITH g AS (SELECT p_brand AS scenario, sum(p_retailprice) AS score FROM part GROUP BY 1), b AS (SELECT scenario FROM g ORDER BY score DESC, scenario LIMIT 5) SELECT p_partkey, p_brand AS scenario, p_retailprice AS score FROM part JOIN b ON scenario = p_brand", "score")
def best_in_full(t: Tables) -> DataFrame:
    """A sweep in two passes: all scenarios scored, the five best run in full."""
    scenarios = t.part.select(F.col("p_brand").alias("scenario")).distinct()
    run = lambda s: t.part.select("p_partkey", F.col("p_brand").alias("scenario"), F.col("p_retailprice").alias("score")).join(s.select("scenario"), "scenario", "left_semi")
    return sweeps.run_sweep(scenarios, run, lambda rows: rows.groupBy("scenario").agg(F.sum("score").alias("score")), 5)[1].select("p_partkey", "scenario", "score")
