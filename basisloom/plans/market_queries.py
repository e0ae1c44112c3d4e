"""Queries on hedged trips, unit roots, selections as of a date, static tables and configured sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import backtest, learning, signals, strategies, sweeps
from ..sources import panels
from . import table_queries  # noqa: F401  its trips are used here
from .registry import DAILY, DAYS, PANEL, QUERIES, RETURNS, SQL, Tables, query

_UNIT = f"""{DAILY}, a AS (SELECT k, t, x AS y, lag(x) OVER w AS l, x - lag(x) OVER w AS d, lag(x) OVER w - lag(x, 2) OVER w AS p FROM q WINDOW w AS (PARTITION BY k ORDER BY t)),
  s AS (SELECT k, count(y)::INT AS n_obs, count(p) AS m, regr_sxx(d, l) FILTER (p IS NOT NULL) AS xx, regr_sxy(d, l) FILTER (p IS NOT NULL) AS xd, regr_syy(d, l) FILTER (p IS NOT NULL) AS dd, regr_sxx(d, p) AS pp, regr_sxy(d, p) AS pd, regr_sxy(l, p) AS xp,
    regr_sxx(d, l) AS fxx, regr_sxy(d, l) AS fxd, regr_syy(d, l) AS fdd FROM a GROUP BY k),
  g AS (SELECT *, xx * pp - xp * xp AS det, dd - xd * xd / xx AS e0, fdd - fxd * fxd / fxx AS f0 FROM s WHERE n_obs >= 20),
  b AS (SELECT *, (xd * pp - pd * xp) / det AS b1, (pd * xx - xd * xp) / det AS h1 FROM g),
  c AS (SELECT *, dd - b1 * xd - h1 * pd AS e1 FROM b),
  z AS (SELECT *, CASE WHEN m * ln(e1 / m) + 6 < m * ln(e0 / m) + 4 THEN 1 ELSE 0 END AS used FROM c),
  t AS (SELECT k, n_obs, used, CASE WHEN used = 1 THEN b1 / sqrt(e1 / (m - 3) * pp / det) ELSE fxd / fxx / sqrt(f0 / (m - 1) / fxx) END AS test_stat, CASE WHEN used = 1 THEN m ELSE m + 1 END AS n FROM z)"""


@query(
    f"""WITH {_UNIT} SELECT k, n_obs, test_stat, used::INT AS used_lag, -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.040 / (n * n * n) AS crit_5,
      CASE WHEN test_stat <= -18.83 THEN true WHEN test_stat > 2.74 THEN false WHEN test_stat <= -1.61 THEN 2.1659 + 1.4412 * test_stat + 0.038269 * test_stat ** 2 < -1.6448536269514722 ELSE false END AS reject FROM t""",
    "test_stat crit_5",
)
def unit_roots(t: Tables) -> DataFrame:
    """Augmented unit-root tests of every part's daily series, the lag chosen by information."""
    return signals.adf_test(t.daily(), DAYS, "x", maxlag=1, min_obs=20).where("test_stat IS NOT NULL").select("k", "n_obs", "test_stat", "used_lag", "crit_5", "reject")


# -- hedges of round trips -----------------------------------------------------

_HEDGED = f"""trips AS ({SQL["fifo_round_trips"]}), bars AS (SELECT l_shipdate AS bar, (sum(l_discount) - 3) * 10 AS hedge_pnl FROM lineitem GROUP BY 1),
  hedges AS (SELECT bar, h.hedge, CASE WHEN month(bar) = 2 AND h.hedge = 'B' THEN 0 ELSE 4 + day(bar) / 10.0 END AS hedge_dv01, 100 + (month(bar) * 31 + day(bar)) % 17 AS bid, 100.25 + (month(bar) * 31 + day(bar)) % 17 AS ask FROM bars, (VALUES ('A'), ('B')) h(hedge)),
  need AS (SELECT DISTINCT l_shipdate AS bar, l_partkey AS k, 1 + l_partkey % 5 AS dv01, h.hedge, CASE WHEN h.hedge = 'A' THEN -0.7 ELSE -0.1 * (l_partkey % 3) END AS ratio FROM lineitem, (VALUES ('A'), ('B')) h(hedge))"""


@query(
    f"""WITH {_HEDGED}, i AS (SELECT *, row_number() OVER () AS id FROM trips), u AS (SELECT id, sum(side * qty * dv01 * ratio / a.hedge_dv01 * CASE WHEN side * ratio > 0 THEN b.bid - a.ask ELSE b.ask - a.bid END) AS theory
      FROM i JOIN need n ON n.k = i.k AND n.bar = entry_bar JOIN hedges a ON a.bar = entry_bar AND a.hedge = n.hedge JOIN hedges b ON b.bar = exit_bar AND b.hedge = n.hedge WHERE a.hedge_dv01 > 0 GROUP BY id),
    m AS (SELECT bar, k, sum(abs(dv01 * ratio)) AS w FROM need GROUP BY ALL), o AS (SELECT id, m.bar, qty * w AS load FROM i JOIN m ON m.k = i.k AND m.bar >= entry_bar AND m.bar < exit_bar),
    tot AS (SELECT bar, sum(load) AS total FROM o GROUP BY bar), al AS (SELECT id, sum(hedge_pnl * load / total) AS net FROM o JOIN tot USING (bar) JOIN bars USING (bar) GROUP BY id)
    SELECT k, entry_bar, exit_bar, side, qty, pnl, pnl + coalesce(theory, 0) AS theoretical_pnl, pnl + coalesce(net, 0) AS net_pnl FROM i LEFT JOIN u USING (id) LEFT JOIN al USING (id)""",
    "qty pnl theoretical_pnl net_pnl",
)
def hedged_trips(t: Tables) -> DataFrame:
    """Round trips of every part with the theoretical and the shared profit of two hedges."""
    trips = QUERIES["fifo_round_trips"](t.spark, t.folder)
    two = F.explode(F.array(F.lit("A"), F.lit("B"))).alias("hedge")
    bars = t.lineitem.groupBy(F.col("l_shipdate").alias("bar")).agg(((F.sum("l_discount") - 3) * 10).alias("hedge_pnl"))
    place = (F.month("bar") * 31 + F.day("bar")) % 17
    hedges = bars.select("bar", two).select("bar", "hedge", F.when((F.month("bar") == 2) & (F.col("hedge") == "B"), 0.0).otherwise(4 + F.day("bar") / 10.0).alias("hedge_dv01"), (100.0 + place).alias("bid"), (100.25 + place).alias("ask"))
    each = t.lineitem.select(F.col("l_shipdate").alias("bar"), F.col("l_partkey").alias("k")).distinct()
    ratios = each.select("bar", "k", two).withColumn("ratio", F.when(F.col("hedge") == "A", -0.7).otherwise(-0.1 * (F.col("k") % 3)))
    dv01 = each.withColumn("dv01", (1 + F.col("k") % 5).cast("double"))
    return backtest.hedged_round_trips(trips, ratios, dv01, hedges, bars, "k")


@query("WITH b AS (SELECT event_type, date_trunc('hour', ts) AS bar, sum(value) AS value, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, bar::VARCHAR AS bar, value, n FROM b WHERE hour(bar) = 16", "value")
def closing_bars(t: Tables) -> DataFrame:
    """The hourly bars of every kind of event that stand at the close."""
    bars = t.events.groupBy("event_type", F.date_trunc("hour", "ts").alias("bar")).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return backtest.close_bars(bars, "bar", "16:00").withColumn("bar", F.date_format("bar", "yyyy-MM-dd HH:mm:ss"))


@query(
    "WITH x AS (SELECT l_shipdate AS bar, p_brand AS issuer, l_quantity * CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN -1 ELSE 0 END * (1 + p_size / 10.0) AS x FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT bar, issuer, sum(x) AS net_dv01, sum(abs(x)) AS gross_dv01, sum((x <> 0)::INT)::BIGINT AS n_open FROM x GROUP BY ALL",
    "net_dv01 gross_dv01",
)
def issuer_exposures(t: Tables) -> DataFrame:
    """Signed and gross exposure of every issuer at every bar."""
    rows = t.lineitem.join(t.part.select("p_partkey", F.col("p_brand").alias("issuer"), (1 + F.col("p_size") / 10.0).alias("dv01")), F.col("l_partkey") == F.col("p_partkey"))
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    return backtest.bucket_exposures(rows.withColumn("bar", F.col("l_shipdate")).withColumn("held", F.col("l_quantity") * flag), ["bar"], "issuer", "held", "dv01")


# -- selection -----------------------------------------------------------------


@query(
    f"""WITH RECURSIVE {RETURNS}, dd AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM r)), a AS (SELECT d AS asked, i AS last FROM dd WHERE month(d) IN (3, 8)),
    w AS (SELECT asked, s, r.d, r.r, i = last AS now FROM a JOIN dd ON i <= last AND i > last - 24 JOIN r ON r.d = dd.d), v AS (SELECT asked, s, count(*) AS n, avg(r) / stddev_samp(r) * sqrt(12) AS sharpe FROM w GROUP BY ALL HAVING count(*) >= 12 AND max(now::INT) = 1),
    ok AS (SELECT * FROM v WHERE sharpe >= -0.5), x AS (SELECT w.* FROM w JOIN ok USING (asked, s)), m AS (SELECT x.asked, x.s AS a, y.s AS b FROM x JOIN x y ON x.asked = y.asked AND x.d = y.d GROUP BY ALL HAVING count(*) >= 12 AND corr(x.r, y.r) >= 0.1),
    e AS (SELECT asked, a, b FROM m WHERE a <> b UNION SELECT asked, s, s FROM ok), p AS (SELECT asked, a, b FROM e UNION SELECT p.asked, p.a, e.b FROM p JOIN e ON e.asked = p.asked AND e.a = p.b),
    l AS (SELECT asked, a AS key, min(b) AS cluster FROM p GROUP BY ALL), f AS (SELECT l.asked, l.key, cluster, n, sharpe, row_number() OVER (PARTITION BY l.asked, cluster ORDER BY sharpe DESC, l.key) AS place FROM l JOIN ok ON ok.asked = l.asked AND ok.s = l.key)
    SELECT asked::DATE AS "asof", key, cluster, n, sharpe FROM f WHERE place = 1""",
    "sharpe",
)
def selections_as_of(t: Tables) -> DataFrame:
    """Strategies chosen at many dates from what each date had seen."""
    rows = t.returns()
    asked = rows.where(F.month("d").isin(3, 8)).select(F.col("d").alias("asof")).distinct()
    rule = strategies.Selection(least={"sharpe": -0.5}, threshold=0.1, min_obs=12, year=12)
    chosen, _ = strategies.select_at(rows, asked, "d", "s", "r", rule, lookback=24, overlap=12)
    return chosen.select(F.col("asof").cast("date").alias("asof"), "key", "cluster", "n", "sharpe")


# -- static tables -------------------------------------------------------------

_CAPS = {"Brand#11": 5.0, "Brand#23": 7.5, "Brand#42": 9.0}


@query(
    f"""WITH {PANEL}, f AS (SELECT k, least(count(x), count(CASE WHEN f = 'A' THEN v END), count(CASE WHEN v > 10 THEN d END)) AS has FROM p GROUP BY k), ids AS (SELECT DISTINCT ps AS id FROM (SELECT l_partkey AS ps FROM lineitem UNION ALL SELECT -1))
    SELECT id AS instrument_id, CASE WHEN coalesce(has, 0) > 0 THEN (p_size % 4 > 0)::INT ELSE 0 END::DOUBLE AS tradable, p_retailprice AS pos_limit, CASE p_brand WHEN 'Brand#23' THEN 1 WHEN 'Brand#42' THEN 2 ELSE 0 END::INT AS issuer, CASE p_brand WHEN 'Brand#23' THEN 7.5 WHEN 'Brand#42' THEN 9.0 ELSE 5.0 END::DOUBLE AS bucket_cap
    FROM ids LEFT JOIN part ON p_partkey = id LEFT JOIN f ON k = id""",
    "pos_limit",
)
def tradable_universe(t: Tables) -> DataFrame:
    """Static rows of the wanted instruments, issuers by their caps, those without a price or signal switched off."""
    meta = t.part.select(F.col("p_partkey").alias("instrument_id"), (F.col("p_size") % 4 > 0).cast("double").alias("tradable"), F.col("p_retailprice").alias("pos_limit"), F.col("p_brand").alias("issuer"))
    ids = t.lineitem.select(F.col("l_partkey").alias("instrument_id")).unionByName(t.spark.range(1).select(F.lit(-1).cast("long").alias("instrument_id")))
    market = t.panel().select(F.col("k").alias("instrument_id"), "x", F.when(F.col("f") == "A", F.col("v")).alias("signal"), F.when(F.col("v") > 10, F.col("d")).alias("score"))
    rows = panels.static_table(meta, "instrument_id long, tradable double, pos_limit double", ids, "instrument_id", "issuer", _CAPS)
    return panels.disable_empty(rows, market, ["x", "signal", "score"])


# -- sweeps --------------------------------------------------------------------

_CONFIG = {"preset": "REALISTIC", "base": {"scale": 2.0}, "grid": {"most": [10.0, 20.0, 30.0, 40.0], "least": [0.0, 0.03, 0.06]}, "top": 3, "name": "gate"}


def _gated(t: Tables):
    """Scores of scenarios per reference: the rows of a reference are counted once per (size, discount), whatever the scenarios."""
    cells = t.lineitem.groupBy(F.col("l_returnflag").alias("ref"), "l_quantity", "l_discount").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.04)).alias("g"))

    def run(scenarios: DataFrame) -> DataFrame:
        met = cells.join(F.broadcast(scenarios), (F.col("l_quantity") <= F.col("most")) & (F.col("l_discount") >= F.col("least")))  # scenarios: a grid from code
        return met.groupBy("scenario", "ref").agg(F.sum("c").alias("fills"), (F.sum(F.col("g") * F.col("scale") * F.col("haircut")) / F.sum("c")).alias("edge"))

    return run


_GATES = """sc AS (SELECT (i * 3 + j)::BIGINT AS scenario, most, least FROM (VALUES (0, 10.0), (1, 20.0), (2, 30.0), (3, 40.0)) m(i, most), (VALUES (0, 0.0), (1, 0.03), (2, 0.06)) l(j, least)),
  rows AS (SELECT scenario, most::DOUBLE AS most, least::DOUBLE AS least, l_returnflag AS ref, count(*) AS fills, sum(l_extendedprice * (l_discount - 0.04)) / count(*) AS edge FROM sc JOIN lineitem ON l_quantity <= most AND l_discount >= least GROUP BY ALL)"""


@query(f"WITH {_GATES} SELECT *, row_number() OVER (PARTITION BY ref ORDER BY edge DESC, scenario)::INT AS rank FROM rows", "edge")
def reference_sweeps(t: Tables) -> DataFrame:
    """Every scenario of a configured grid on every reference, ranked within the reference."""
    scenarios = sweeps.grid(t.spark, _CONFIG["grid"], {**sweeps.PRESETS["REALISTIC"], **_CONFIG["base"]}, "gate")
    return sweeps.reference_sweep(scenarios, _gated(t), "ref", ["edge", "fills"], "edge", ["most", "least"], 5)["summary"]


@query(f"WITH {_GATES}, b AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY edge DESC, scenario) AS p FROM rows), m AS (SELECT ref, avg(edge) AS edge, avg(fills) AS fills FROM b WHERE p <= 5 GROUP BY ref) SELECT avg(edge) AS edge, avg(fills) AS fills, count(*) AS refs FROM m", "edge fills")
def reference_averages(t: Tables) -> DataFrame:
    """Means over references of the means of each reference's best scenarios."""
    scenarios = sweeps.grid(t.spark, _CONFIG["grid"], {**sweeps.PRESETS["REALISTIC"], **_CONFIG["base"]}, "gate")
    return sweeps.reference_sweep(scenarios, _gated(t), "ref", ["edge", "fills"], "edge", ["most", "least"], 5)["averages"]


@query(f"WITH {_GATES}, s AS (SELECT scenario, avg(edge) AS score FROM rows GROUP BY 1), b AS (SELECT scenario FROM s ORDER BY score DESC, scenario LIMIT 3) SELECT r.scenario, ref, fills, edge FROM rows r JOIN b USING (scenario)", "edge")
def configured_best(t: Tables) -> DataFrame:
    """Full results of the best scenarios of a sweep described by a configuration."""
    return sweeps.configured_sweep(t.spark, _CONFIG, _gated(t), lambda rows: rows.groupBy("scenario").agg(F.avg("edge").alias("score")))["best"]


@query()
def quantile_models(t: Tables) -> DataFrame:
    """Linear quantile models of order values, fitted on all rows; tested by the loss of the best fit."""
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").alias("y"), F.month("o_orderdate").cast("double").alias("m"), (F.col("o_custkey") % 10).cast("double").alias("c"))
    models = learning.quantile_fit(rows, ["m", "c"], "y", [0.1, 0.5, 0.9])
    return learning.quantile_predict(rows, models, ["m", "c"])
