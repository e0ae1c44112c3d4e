"""Queries on tables: quality, reshape, joins, distributions, selection, structures, portfolios, books, learning, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import execution as ex
from ..functions.windows import Axis
from ..operators import backtest, distributions, learning, panel, portfolio, selection, structures, sweeps
from ..streaming import replay
from .registry import DAILY, DAYS, PANEL, RETURNS, Tables, query


@query(
    f"""WITH {PANEL}, c AS (SELECT k, t, count(*) AS n, count(x) AS cx, count(v) AS cv FROM p GROUP BY ALL), g AS (SELECT *, date_diff('day', lag(t) OVER (PARTITION BY k ORDER BY t), t) AS gap FROM c)
    SELECT sum(n)::BIGINT AS n_rows, count(DISTINCT t) AS n_dates, count(DISTINCT k) AS n_keys, sum((n > 1)::INT)::BIGINT AS n_duplicates, 0::BIGINT AS n_unordered, max(gap)::INT AS max_gap_days,
      1 - sum(cx + cv) / (sum(n) * 2) AS missing_rate, count(*) = count(DISTINCT t) * count(DISTINCT k) AS is_balanced, sum((n > 1)::INT) = 0 AS is_valid FROM g""",
    "missing_rate",
)
def panel_quality(t: Tables) -> DataFrame:
    """One row on the panel's keys, gaps and missing values."""
    return panel.summarise_quality(t.panel(), "t", "k", ["x", "v"])


@query(f"WITH {PANEL} SELECT k, count(*) AS n, min(t)::VARCHAR AS first, max(t)::VARCHAR AS last, avg(x) AS x_mean, stddev_samp(x) AS x_std, avg(v) AS v_mean, stddev_samp(v) AS v_std FROM p GROUP BY k", "x_mean x_std v_mean v_std")
def panel_summary(t: Tables) -> DataFrame:
    """Rows, span, means and deviations per part."""
    return panel.panel_summary(t.panel(), "t", "k", ["x", "v"]).withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


_SEG = "SELECT o_orderdate AS d, o_orderpriority AS s, avg(o_totalprice) AS v FROM orders GROUP BY ALL"
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _by_priority(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderdate").alias("d"), F.col("o_orderpriority").alias("s")).agg(F.avg("o_totalprice").alias("v"))


@query(f"SELECT d, " + ", ".join(f"max(CASE WHEN s = '{p}' THEN v END) AS p{i}" for i, p in enumerate(_PRIORITIES)) + f" FROM ({_SEG}) GROUP BY d", "p0 p1 p2 p3 p4")
def wide_panel(t: Tables) -> DataFrame:
    """Daily order values per priority as columns."""
    wide = panel.to_wide(_by_priority(t), "d", "s", ["v"], _PRIORITIES)
    return wide.select("d", *(F.col(f"`{p}`").alias(f"p{i}") for i, p in enumerate(_PRIORITIES)))


@query("SELECT o_orderkey, kind, amount FROM (SELECT o_orderkey, o_totalprice AS total, o_custkey::DOUBLE AS customer FROM orders) UNPIVOT (amount FOR kind IN (total, customer))", "amount")
def long_panel(t: Tables) -> DataFrame:
    """Two columns as rows."""
    wide = t.orders.select("o_orderkey", F.col("o_totalprice").alias("total"), F.col("o_custkey").cast("double").alias("customer"))
    return panel.to_long(wide, "o_orderkey", ["total", "customer"], "kind", "amount")


@query(
    f"""WITH a AS ({_SEG}), g AS (SELECT s, d FROM (SELECT DISTINCT s FROM a), (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM a)), j AS (SELECT g.s, g.d, a.v, row_number() OVER w AS i FROM g LEFT JOIN a ON a.s = g.s AND a.d = g.d WINDOW w AS (PARTITION BY g.s ORDER BY g.d)),
    f AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS fv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER w AS fi FROM j WINDOW w AS (PARTITION BY s ORDER BY d))
    SELECT s, d, CASE WHEN i - fi <= 2 THEN fv END AS v FROM f""",
    "v",
)
def filled_panel(t: Tables) -> DataFrame:
    """Every day for every priority, values carried two days at most."""
    return panel.fill_gaps(_by_priority(t), "d", "s", "1 day", "ffill", 2)


@query(f"WITH a AS ({_SEG}), u AS (SELECT d FROM a WHERE s = '1-URGENT' INTERSECT SELECT d FROM a WHERE s = '5-LOW') SELECT d, v FROM a WHERE s = '1-URGENT' AND d IN (SELECT d FROM u)", "v")
def aligned_panels(t: Tables) -> DataFrame:
    """One priority on the days that another has too."""
    rows = _by_priority(t).withColumn("one", F.lit(1))
    a, b = (rows.where(F.col("s") == p) for p in ("1-URGENT", "5-LOW"))
    return panel.align_panels([a, b], "d", "one")[0].select("d", "v")


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", F.col("value").alias("paid"))
    right = t.events.where("event_type = 'view'").select("user_id", "ts", "value", F.col("event_id").alias("seen"))
    return left, right


_L, _R = "(SELECT event_id, user_id, ts, value AS paid FROM events WHERE event_type = 'purchase') l", "(SELECT user_id, ts, value, event_id AS seen FROM events WHERE event_type = 'view') r"


@query(f"SELECT l.event_id, l.paid, CASE WHEN l.ts - r.ts <= INTERVAL 6 HOUR THEN r.value END AS value, CASE WHEN l.ts - r.ts <= INTERVAL 6 HOUR THEN r.seen END AS seen FROM {_L} ASOF LEFT JOIN {_R} ON l.user_id = r.user_id AND l.ts >= r.ts", "paid value")
def asof_backward(t: Tables) -> DataFrame:
    """The last view of the buyer within six hours before each purchase."""
    left, right = _sides(t)
    return panel.asof_join(left, right, "ts", ["user_id"], tolerance="6 hours").select("event_id", "paid", "value", "seen")


@query(f"SELECT l.event_id, r.seen, r.value FROM {_L} ASOF LEFT JOIN {_R} ON l.user_id = r.user_id AND l.ts <= r.ts", "value")
def asof_forward(t: Tables) -> DataFrame:
    """The next view of the buyer after each purchase."""
    left, right = _sides(t)
    return panel.asof_join(left, right, "ts", ["user_id"], "forward").select("event_id", "seen", "value")


@query(
    f"""WITH m AS (SELECT l.event_id, r.seen, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts) AS i FROM {_L} JOIN {_R} ON l.user_id = r.user_id)
    SELECT l.event_id, m.seen FROM {_L} LEFT JOIN m ON m.event_id = l.event_id AND m.i = 1"""
)
def asof_nearest(t: Tables) -> DataFrame:
    """The view nearest to each purchase on either side."""
    left, right = _sides(t)
    return panel.asof_join(left, right, "ts", ["user_id"], "nearest").select("event_id", "seen")


_MAP = "m AS (SELECT o_custkey AS c, o_orderkey AS id, o_orderdate::DATE AS a, (lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::DATE AS b FROM orders), ask AS (SELECT DISTINCT o_custkey AS c, DATE '1998-06-01' AS d FROM orders)"


def _mapping(t: Tables) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    m = t.orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("isin"), F.to_date("o_orderdate").alias("effective_from"), F.to_date(F.lead("o_orderdate").over(w)).alias("effective_to"))
    ask = t.orders.select(F.col("o_custkey").alias("c")).distinct().withColumn("asof", F.to_date(F.lit("1998-06-01")))
    return m, ask


@query(f"WITH {_MAP} SELECT ask.c, ask.d AS asof, arg_max(id, (a, id)) AS isin FROM ask LEFT JOIN m ON m.c = ask.c AND a <= d AND (b IS NULL OR d < b) GROUP BY ALL")
def point_in_time(t: Tables) -> DataFrame:
    """The order of each customer that is in force on a day."""
    m, ask = _mapping(t)
    return panel.resolve_mapping(m, ask, ["c"])


@query(f"WITH {_MAP} SELECT ask.c, ask.d AS asof, string_agg(id::VARCHAR, ',' ORDER BY a DESC, id DESC) AS history FROM ask JOIN m ON m.c = ask.c AND a <= d GROUP BY ALL")
def mapping_histories(t: Tables) -> DataFrame:
    """All orders begun by a day, newest first."""
    m, ask = _mapping(t)
    return panel.mapping_history(m, ask, ["c"]).withColumn("history", F.array_join(F.transform("history", lambda x: x.cast("string")), ","))


_SUM = ", ".join(f"quantile_cont(value, {q}) AS q{round(q * 100):02d}" for q in distributions.QUANTILES)


@query(
    f"""WITH m AS (SELECT event_type AS g, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY 1)
    SELECT event_type, count(value) AS n, count(*) - count(value) AS n_missing, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, {_SUM}, avg(pow((value - mu) / sd, 3)) AS skew, kurtosis_pop(value) AS kurtosis FROM events JOIN m ON g = event_type GROUP BY event_type""",
    "mean std min max q05 q25 q50 q75 q95 skew kurtosis",
)
def group_summaries(t: Tables) -> DataFrame:
    """Distribution summaries of event values per type."""
    return distributions.group_summaries(t.events, "event_type", "value")


_CDF = """c AS (SELECT event_type AS g, value AS x, count(*) AS c FROM events GROUP BY ALL), n AS (SELECT g, sum(c) AS n FROM c GROUP BY g), xs AS (SELECT DISTINCT x FROM c),
  pr AS (SELECT a.g AS a, b.g AS b, a.n AS na, b.n AS nb FROM n a JOIN n b ON a.g < b.g),
  st AS (SELECT a, b, na, nb, x, coalesce(sum(ca.c) OVER w, 0) / na AS fa, coalesce(sum(cb.c) OVER w, 0) / nb AS fb, lead(x) OVER w AS nx FROM pr CROSS JOIN xs LEFT JOIN c ca ON ca.g = a AND ca.x = xs.x LEFT JOIN c cb ON cb.g = b AND cb.x = xs.x WINDOW w AS (PARTITION BY a, b ORDER BY xs.x))"""


@query(
    f"""WITH {_CDF.replace("SELECT a, b, na, nb, x,", "SELECT a, b, na, nb, xs.x AS x,").replace("lead(x) OVER w", "lead(xs.x) OVER w")}, q AS (SELECT event_type AS g, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
    s AS (SELECT a, b, first(na)::BIGINT AS na, first(nb)::BIGINT AS nb, max(abs(fa - fb)) AS ks, sum(coalesce(abs(fa - fb) * (nx - x), 0)) AS wasserstein FROM st GROUP BY a, b)
    SELECT a, b, na, nb, ks, CASE WHEN ks * sqrt(na * nb / (na + nb)) < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), lambda i: (CASE WHEN i % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END) * exp(-2.0::DOUBLE * i * i * ks * ks * na * nb / (na + nb)))))) END AS ks_pvalue, wasserstein, qa.q2 - qb.q2 AS median_diff, (qa.q3 - qa.q1) - (qb.q3 - qb.q1) AS iqr_diff FROM s JOIN q qa ON qa.g = a JOIN q qb ON qb.g = b""",
    "ks ks_pvalue wasserstein median_diff iqr_diff",
)
def pairwise_distributions(t: Tables) -> DataFrame:
    """Two-sample statistics of every pair of event types."""
    return distributions.pairwise_stats(t.events, "event_type", "value")


@query(
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), h AS (SELECT event_type AS g, least(floor((value - lo) / (hi - lo) * 20), 19)::INT AS cell, count(*) AS c FROM events, e GROUP BY ALL),
    gr AS (SELECT g, cell::INT AS cell FROM (SELECT DISTINCT g FROM h), range(20) r(cell)), p AS (SELECT gr.g, gr.cell, coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY gr.g) + 1e-10 AS p FROM gr LEFT JOIN h USING (g, cell)),
    n AS (SELECT g, cell, p / sum(p) OVER (PARTITION BY g) AS p FROM p)
    SELECT a.g AS a, b.g AS b, sum(0.5 * a.p * log2(a.p / ((a.p + b.p) / 2)) + 0.5 * b.p * log2(b.p / ((a.p + b.p) / 2))) AS js FROM n a JOIN n b ON a.cell = b.cell AND a.g < b.g GROUP BY ALL""",
    "js",
)
def jensen_shannon(t: Tables) -> DataFrame:
    """Jensen-Shannon divergence of every pair of event types."""
    return distributions.jensen_shannon(t.events, "event_type", "value")


_BONDS = f"""{DAILY}, b AS (SELECT t, k, v / 5 AS ttm, x AS price FROM q)"""


def _bonds(t: Tables) -> DataFrame:
    return t.daily().select("t", "k", (F.col("v") / 5).alias("ttm"), F.col("x").alias("price"))


_TEN = {"front": 2.0, "belly": 5.0, "back": 8.0}


@query(
    f"WITH {_BONDS} SELECT t, " + ", ".join(f"CASE WHEN min(abs(ttm - {v})) <= 1 THEN arg_min(k, (abs(ttm - {v}), k)) END AS {n}_id, CASE WHEN min(abs(ttm - {v})) <= 1 THEN arg_min(ttm, (abs(ttm - {v}), k)) END AS {n}_ttm" for n, v in _TEN.items()) + " FROM b GROUP BY t",
    "front_ttm belly_ttm back_ttm",
)
def tenor_legs(t: Tables) -> DataFrame:
    """Per day the three keys nearest to three tenors, in one aggregation."""
    return selection.select_legs(_bonds(t), _TEN, "t", "k", "ttm", 1.0)


@query(
    f"""WITH {_BONDS}, r AS (SELECT t, k, ttm, row_number() OVER (PARTITION BY t ORDER BY abs(ttm - 5), k) AS i FROM b WHERE abs(ttm - 5) <= 3), s AS (SELECT t, k, row_number() OVER (PARTITION BY t ORDER BY ttm, k) AS j, count(*) OVER (PARTITION BY t) AS c FROM r WHERE i <= 3)
    SELECT d.t, max(CASE WHEN c = 3 AND j = 1 THEN k END) AS front_id, max(CASE WHEN c = 3 AND j = 2 THEN k END) AS belly_id, max(CASE WHEN c = 3 AND j = 3 THEN k END) AS back_id FROM (SELECT DISTINCT t FROM b) d LEFT JOIN s ON s.t = d.t GROUP BY d.t"""
)
def nearest_three(t: Tables) -> DataFrame:
    """Three nearest keys in order of maturity, or none."""
    return selection.nearest_three(_bonds(t), 5.0, 3.0, "t", "k", "ttm")


_LEGS = f"""{_BONDS}, l AS (SELECT t, arg_min(k, (abs(ttm - 2), k)) AS fi, arg_min(k, (abs(ttm - 5), k)) AS bi, arg_min(k, (abs(ttm - 8), k)) AS ki FROM b GROUP BY t),
v AS (SELECT l.t, f.price AS fp, m.price AS bp, r.price AS kp, f.ttm AS fd, m.ttm AS bd, r.ttm AS kd FROM l JOIN b f ON f.t = l.t AND f.k = fi JOIN b m ON m.t = l.t AND m.k = bi JOIN b r ON r.t = l.t AND r.k = ki)"""


def _structure(t: Tables) -> DataFrame:
    bonds = _bonds(t)
    legs = selection.select_legs(bonds, _TEN, "t", "k", "ttm").drop("front_ttm", "belly_ttm", "back_ttm")
    values = selection.leg_values(bonds, legs, list(_TEN), ["price", "ttm"], "t", "k")
    return structures.fly_series(values, "t", "price", dv01="ttm")


@query(f"WITH {_LEGS} SELECT t, bd / (fd + kd) AS front_weight, -1.0 AS belly_weight, bd / (fd + kd) AS back_weight, fp * bd / (fd + kd) - bp + kp * bd / (fd + kd) AS fly_value FROM v", "front_weight belly_weight back_weight fly_value")
def fly_values(t: Tables) -> DataFrame:
    """A neutral three-leg structure's value per day."""
    return _structure(t).select("t", "front_weight", "belly_weight", "back_weight", "fly_value")


@query(
    f"""WITH {_LEGS}, s AS (SELECT *, bd / (fd + kd) AS w, CASE WHEN fp + kp > 2 * bp THEN -1 ELSE 1 END AS sig FROM v), o AS (SELECT *, coalesce(lag(sig) OVER (ORDER BY t), 0) AS pos FROM s),
    n AS (SELECT *, pos * w * fp AS n1, pos * -1 * bp AS n2, pos * w * kp AS n3, coalesce(fp / lag(fp) OVER z - 1, 0) AS r1, coalesce(bp / lag(bp) OVER z - 1, 0) AS r2, coalesce(kp / lag(kp) OVER z - 1, 0) AS r3 FROM o WINDOW z AS (ORDER BY t)),
    c AS (SELECT *, abs(n1 - coalesce(lag(n1) OVER z, 0)) + abs(n2 - coalesce(lag(n2) OVER z, 0)) + abs(n3 - coalesce(lag(n3) OVER z, 0)) AS traded FROM n WINDOW z AS (ORDER BY t))
    SELECT t, pos::DOUBLE AS position, pos * (w * r1 - r2 + w * r3) AS gross_return, traded AS traded_notional, pos * (w * r1 - r2 + w * r3) - traded / 1e4 AS net_return FROM c""",
    "position gross_return traded_notional net_return",
)
def structure_backtests(t: Tables) -> DataFrame:
    """The structure held a day after a signal, with costs."""
    rows = _structure(t).withColumn("sig", F.when(F.col("front_price") + F.col("back_price") > 2 * F.col("belly_price"), -1).otherwise(1))
    out = backtest.structure_backtest(rows, Axis(("t",)), "sig", cost_bps=1.0)
    return out.select("t", "position", "gross_return", "traded_notional", "net_return")


@query(
    """WITH s AS (SELECT DISTINCT p_size::DOUBLE AS tenor FROM part) SELECT f.tenor AS front, b.tenor AS belly, k.tenor AS back, f.tenor::INT || 'y' || b.tenor::INT || 'y' || k.tenor::INT || 'y' AS name
    FROM s f JOIN s b ON b.tenor - f.tenor >= 2 JOIN s k ON k.tenor - b.tenor >= 2"""
)
def tenor_triples(t: Tables) -> DataFrame:
    """All triples of tenors at least two years apart, with names."""
    sizes = t.part.select(F.col("p_size").cast("double").alias("tenor")).distinct()
    rows = structures.tenor_triples(sizes, min_wing=2.0)
    return rows.withColumn("name", structures.fly_name(F.col("front"), F.col("belly"), F.col("back")))


@query(
    """SELECT * FROM (SELECT p_brand, p_size, p_partkey, lead(p_partkey, 1) OVER w AS id_1, lead(p_size, 1) OVER w AS at_1, lead(p_partkey, 2) OVER w AS id_2, lead(p_size, 2) OVER w AS at_2 FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey))
    WHERE at_1 - p_size >= 1 AND at_2 - at_1 >= 1 AND id_2 IS NOT NULL"""
)
def nearby_structures(t: Tables) -> DataFrame:
    """Adjacent triples along the sizes of a brand."""
    return structures.adjacent(t.part, ["p_brand"], "p_size", "p_partkey", 3, 1.0)


@query("WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer) SELECT c_nationkey, string_agg(c_custkey::VARCHAR, ',' ORDER BY i) AS ids FROM r WHERE i <= 3 GROUP BY 1 HAVING count(*) = 3")
def latest_three(t: Tables) -> DataFrame:
    """The three first keys of each bucket as one structure."""
    out = structures.latest_of(t.customer, ["c_nationkey"], "c_acctbal", "c_custkey", 3)
    return out.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query(
    """WITH n AS (SELECT c_mktsegment AS seg, c_nationkey AS nat, max(c_custkey) AS id FROM customer GROUP BY ALL) SELECT a.seg, a.nat AS side_a, a.id AS id_a, b.nat AS side_b, b.id AS id_b FROM n a JOIN n b ON a.seg = b.seg AND a.nat < b.nat"""
)
def cross_spreads(t: Tables) -> DataFrame:
    """Pairs of nations within a segment."""
    rows = t.customer.groupBy(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat")).agg(F.max("c_custkey").alias("id"))
    return structures.cross_pairs(rows, "seg", "nat", "id")


@query("SELECT c_mktsegment, c_custkey, c_acctbal, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 10", "c_acctbal")
def best_customers(t: Tables) -> DataFrame:
    """The ten best of each segment."""
    return selection.top_k(t.customer, ["c_mktsegment"], "c_acctbal", 10, ["c_custkey"]).select("c_mktsegment", "c_custkey", "c_acctbal", "place")


_SCEN = "s AS (SELECT p_partkey AS scenario, p_brand AS ref, p_type AS kind, p_retailprice AS sharpe, (p_partkey * 37 % 11)::DOUBLE AS drawdown, p_size::DOUBLE AS trades FROM part)"


def _scenarios(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("scenario"), F.col("p_brand").alias("ref"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("sharpe"), (F.col("p_partkey") * 37 % 11).cast("double").alias("drawdown"), F.col("p_size").cast("double").alias("trades"))


@query(
    f"""WITH {_SCEN}, r AS (SELECT *, count(*) OVER (PARTITION BY ref) AS n, rank() OVER (PARTITION BY ref ORDER BY -drawdown) + (count(*) OVER (PARTITION BY ref, drawdown) - 1) / 2.0 AS r1, rank() OVER (PARTITION BY ref ORDER BY sharpe) + (count(*) OVER (PARTITION BY ref, sharpe) - 1) / 2.0 AS r2,
      rank() OVER (PARTITION BY ref ORDER BY trades) + (count(*) OVER (PARTITION BY ref, trades) - 1) / 2.0 AS r3 FROM s),
    c AS (SELECT *, (r1 - 1) / (n - 1) AS score_1, 0.7 * (r2 - 1) / (n - 1) + 0.3 * (r3 - 1) / (n - 1) AS score_2 FROM r)
    SELECT scenario, ref, score_1, score_2, (row_number() OVER (PARTITION BY ref ORDER BY round(score_1, 12) DESC, round(score_2, 12) DESC, scenario))::INT AS rank FROM c""",
    "score_1 score_2",
)
def staged_ranking(t: Tables) -> DataFrame:
    """Scenarios ranked by drawdown, then by Sharpe and trades, within their reference."""
    plan = selection.RankingPlan(((("drawdown", 1.0, False),), (("sharpe", 0.7, True), ("trades", 0.3, True))))
    return selection.rank_scenarios(_scenarios(t), plan, "scenario", ["ref"]).select("scenario", "ref", "score_1", "score_2", "rank")


@query(
    f"""WITH {_SCEN}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY sharpe DESC, scenario) AS i FROM s) WHERE i <= 10), g AS (SELECT kind, trades, avg(sharpe) AS sharpe, avg(drawdown) AS drawdown, count(*) AS n FROM b GROUP BY ALL)
    SELECT * FROM (SELECT *, (row_number() OVER (ORDER BY sharpe DESC, kind, trades))::INT AS rank FROM g) WHERE rank <= 20""",
    "sharpe drawdown",
)
def parameter_leaderboard(t: Tables) -> DataFrame:
    """Mean metrics per parameter tuple over each reference's best."""
    return selection.leaderboard(_scenarios(t), ["kind", "trades"], ["sharpe", "drawdown"], "sharpe", 20, "ref", 10)


@query(f"WITH {_SCEN}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY sharpe DESC, scenario) AS i FROM s) WHERE i <= 5), m AS (SELECT ref, avg(sharpe) AS sharpe, avg(trades) AS trades FROM b GROUP BY ref) SELECT avg(sharpe) AS sharpe, avg(trades) AS trades, count(*) AS refs FROM m", "sharpe trades")
def cross_reference_means(t: Tables) -> DataFrame:
    """Mean over references of the mean of their best."""
    return selection.mean_of_means(_scenarios(t), "ref", ["sharpe", "trades"], "sharpe", 5)


_FULL = f"{RETURNS}, ok AS (SELECT d FROM r GROUP BY d HAVING count(DISTINCT s) = (SELECT count(DISTINCT s) FROM r)), c AS (SELECT * FROM r WHERE d IN (SELECT d FROM ok))"


@query(f"WITH {RETURNS} SELECT x.s AS a, y.s AS b, count(*) AS n, corr(x.r, y.r) AS corr, covar_samp(x.r, y.r) AS cov FROM r x JOIN r y ON x.d = y.d GROUP BY ALL HAVING count(*) >= 12", "corr cov")
def strategy_correlations(t: Tables) -> DataFrame:
    """Pairwise correlations and covariances of strategies."""
    return portfolio.pairwise(t.returns(), "d", "s", "r", 12).where("corr IS NOT NULL")


@query(
    f"""WITH {_FULL}, w AS (SELECT *, pow(0.5, (dense_rank() OVER (PARTITION BY s ORDER BY d DESC) - 1) / 24.0) AS w FROM c) SELECT x.s AS a, y.s AS b, sum(x.w * x.r * y.r) / sum(x.w) - sum(x.w * x.r) / sum(x.w) * sum(x.w * y.r) / sum(x.w) AS value FROM w x JOIN w y ON x.d = y.d GROUP BY ALL""",
    "value",
)
def ewma_covariances(t: Tables) -> DataFrame:
    """Covariances with weights that halve every 24 months."""
    return portfolio.ewma_cov(t.returns(), "d", "s", "r", 24.0)


@query(f"WITH {_FULL}, k AS (SELECT s, d, rank() OVER (PARTITION BY s ORDER BY r) + (count(*) OVER (PARTITION BY s, r) - 1) / 2.0 AS r FROM c) SELECT x.s AS a, y.s AS b, corr(x.r, y.r) AS corr FROM k x JOIN k y ON x.d = y.d GROUP BY ALL", "corr")
def rank_correlations(t: Tables) -> DataFrame:
    """Rank correlations over complete dates."""
    return portfolio.spearman(t.returns(), "d", "s", "r")


@query(f"WITH {RETURNS}, v AS (SELECT s, stddev_samp(r) AS vol FROM r GROUP BY s) SELECT s, (1 / greatest(vol, 1e-6)) / sum(1 / greatest(vol, 1e-6)) OVER () AS weight FROM v", "weight")
def inverse_vol_weights(t: Tables) -> DataFrame:
    """Weights by inverse volatility."""
    vols = t.returns().groupBy("s").agg(F.stddev_samp("r").alias("vol"))
    return portfolio.inverse_vol(vols, "s", "vol").select("s", "weight")


@query(
    f"""WITH {RETURNS}, a AS (SELECT d, s, count(r) OVER f AS n, greatest(stddev_samp(r) OVER f, 1e-6) AS v FROM r WINDOW f AS (PARTITION BY s ORDER BY d ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
    SELECT d, s, CASE WHEN min(n) OVER w >= 12 THEN (1 / v) / sum(1 / v) OVER w ELSE 1.0 / count(*) OVER w END AS weight FROM a WINDOW w AS (PARTITION BY d)""",
    "weight",
)
def rolling_weights(t: Tables) -> DataFrame:
    """Rolling inverse-volatility weights, equal until there is a year."""
    return portfolio.rolling_inverse_vol(t.returns(), "d", "s", "r", 12)


@query()
def risk_parity_weights(t: Tables) -> DataFrame:
    """Equal-risk weights of the strategies' covariance."""
    cov = portfolio.shrink_to_diagonal(portfolio.sample_cov(t.returns(), "d", "s", "r"), 0.1)
    return portfolio.matrix_weights(cov)


@query(
    """WITH x AS (SELECT l_orderkey AS ts, 'b' || (l_partkey % 50) AS bond, l_quantity AS w, CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END AS dir FROM lineitem WHERE l_returnflag <> 'N'),
    g AS (SELECT ts, dir, sum(w) AS g FROM x GROUP BY ALL), d AS (SELECT x.ts, bond, sum(w * x.dir * 100 / g) AS dv01 FROM x JOIN g ON g.ts = x.ts AND g.dir = x.dir GROUP BY ALL), c AS (SELECT ts, bond, greatest(-60, least(60, dv01)) AS dv01 FROM d),
    s AS (SELECT *, sum(abs(dv01)) OVER (PARTITION BY ts) AS tot FROM c) SELECT ts, bond AS bond_id, dv01 * CASE WHEN tot > 90 THEN 90 / tot ELSE 1 END AS dv01 FROM s""",
    "dv01",
)
def bond_targets(t: Tables) -> DataFrame:
    """Nested signals to capped and scaled targets per bond."""
    rows = t.lineitem.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("ts"), F.col("l_returnflag").alias("strategy_id"), F.concat(F.lit("b"), F.col("l_partkey") % 50).alias("bond_id"), F.col("l_quantity").alias("weight"))
    signals = rows.groupBy("ts", "strategy_id").agg(F.collect_list(F.struct("bond_id", "weight")).alias("legs")).withColumn("direction", F.when(F.col("strategy_id") == "A", 1).otherwise(-1))
    signals = signals.withColumn("target_gross_dv01", F.lit(100.0)).withColumn("confidence", F.lit(1.0))
    return portfolio.bond_targets(signals, "ts", 0.5, 60.0, 90.0)


@query(
    """WITH a AS (SELECT l_suppkey AS k, sum(l_quantity) AS new FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT l_suppkey AS k, sum(l_quantity) AS old FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, coalesce(new, 0) AS new, coalesce(old, 0) AS old, coalesce(new, 0) - coalesce(old, 0) AS change, CASE WHEN coalesce(old, 0) <> 0 THEN (coalesce(new, 0) - old) / abs(old) END AS pct FROM a FULL JOIN b ON a.k = b.k""",
    "new old change pct",
)
def position_changes(t: Tables) -> DataFrame:
    """Changes between two target tables over the union of keys."""
    rows = t.lineitem.select(F.col("l_suppkey").alias("k"), "l_quantity", (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")).alias("early"))
    a, b = (rows.where(c).groupBy("k").agg(F.sum("l_quantity").alias("q")) for c in (F.col("early"), ~F.col("early")))
    return portfolio.target_changes(a, b, "k", "q")


_BOOK = "b AS (SELECT l_orderkey AS id, l_extendedprice / l_quantity AS px, l_quantity AS sz, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice / l_quantity, l_linenumber, l_partkey) AS i FROM lineitem)"


def _books(t: Tables) -> DataFrame:
    level = F.struct((F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("sz"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(level)), lambda x: F.struct(x["px"].alias("px"), x["sz"].alias("sz"))).alias("ask"))


@query(
    f"""WITH {_BOOK}, c AS (SELECT *, coalesce(sum(sz * 0.5) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS have FROM b WHERE i <= 4), g AS (SELECT *, greatest(0, least(40 - have, sz * 0.5)) AS got FROM c)
    SELECT id, sum(got) AS filled, CASE WHEN sum(got) > 0 THEN sum(got * px) / sum(got) END AS vwap, sum((got > 0)::INT)::INT AS levels_used FROM g GROUP BY id""",
    "filled vwap",
)
def book_walks(t: Tables) -> DataFrame:
    """Forty units bought down each order's ladder, half of each level, four levels at most."""
    w = ex.walk_book(F.col("ask"), F.lit(40.0), 4, 0.5)
    rows = _books(t).withColumn("w", w)
    return rows.select("id", F.col("w.filled").alias("filled"), ex.vwap(F.col("w")).alias("vwap"), F.col("w.levels_used").alias("levels_used"))


@query(
    f"""WITH {PANEL}, f AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t, o, n) AS i, t, CASE WHEN f = 'A' THEN 1 ELSE -1 END AS side, v AS q, x AS px FROM p), c AS (SELECT *, sum(q) OVER (PARTITION BY k, side ORDER BY i) AS hi FROM f),
    e AS (SELECT k, hi, max(CASE WHEN side = 1 THEN i END) AS bi, max(CASE WHEN side = -1 THEN i END) AS si FROM c GROUP BY ALL),
    n AS (SELECT k, hi - coalesce(lead(hi) OVER w, 0) AS qty, last_value(bi IGNORE NULLS) OVER w AS bi, last_value(si IGNORE NULLS) OVER w AS si FROM e WINDOW w AS (PARTITION BY k ORDER BY hi DESC)),
    m AS (SELECT n.k, n.qty, n.bi, n.si, b.t AS bt, s.t AS st, s.px - b.px AS d FROM n JOIN f b ON b.k = n.k AND b.i = n.bi JOIN f s ON s.k = n.k AND s.i = n.si)
    SELECT k, CASE WHEN bi < si THEN bt ELSE st END AS entry_bar, CASE WHEN bi < si THEN st ELSE bt END AS exit_bar, (CASE WHEN bi < si THEN 1 ELSE -1 END)::INT AS side, qty, qty * d AS pnl FROM m""",
    "qty pnl",
)
def fifo_round_trips(t: Tables) -> DataFrame:
    """First-in-first-out round trips of every part."""
    fills = t.panel().withColumn("side", F.when(F.col("f") == "A", 1).otherwise(-1))
    return backtest.fifo_round_trips(fills, "k", ["t", "o", "n"], "t", "side", "v", "x")


@query(
    f"""WITH {DAILY}, tg AS (SELECT k, t, CASE WHEN v > 30 THEN v END AS tgt, x FROM q), h AS (SELECT *, coalesce(last_value(tgt IGNORE NULLS) OVER w, 0) AS hold, coalesce((x / lag(x) OVER w - 1) * 1e4, 0) AS bp FROM tg WINDOW w AS (PARTITION BY k ORDER BY t)),
    z AS (SELECT *, abs(hold - coalesce(lag(hold) OVER (PARTITION BY k ORDER BY t), 0)) AS tr FROM h)
    SELECT t, sum(hold * bp / 100) AS gross_pnl, sum(tr) AS turnover, sum(tr) * 0.1 AS cost, sum(abs(hold)) AS gross_dv01, sum(hold) AS net_dv01, sum(hold * bp / 100) - sum(tr) * 0.1 AS pnl,
      sum(sum(hold * bp / 100) - sum(tr) * 0.1) OVER (ORDER BY t) AS cum_pnl FROM z GROUP BY t""",
    "gross_pnl turnover cost gross_dv01 net_dv01 pnl cum_pnl",
)
def rebalanced_portfolio(t: Tables) -> DataFrame:
    """Holdings that follow the newest target, with costs."""
    rows = t.daily()
    out = backtest.rebalanced_portfolio(rows, rows.where("v > 30").withColumnRenamed("v", "dv01"), "t", "k", "x", cost_per_dv01=0.1)
    return out.select("t", "gross_pnl", "turnover", "cost", "gross_dv01", "net_dv01", "pnl", "cum_pnl")


@query(
    """WITH a AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_shipdate AS d, CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE -l_quantity END AS x FROM lineitem), b AS (SELECT *, sum(abs(x)) OVER w > 80 OR abs(sum(x) OVER w) > 30 AS breach, greatest(-40, least(40, x)) AS y FROM a WINDOW w AS (PARTITION BY o)),
    c AS (SELECT *, sum(abs(y)) OVER w AS g FROM b WINDOW w AS (PARTITION BY o)), e AS (SELECT *, CASE WHEN g > 80 THEN y * 80 / g ELSE y END AS z FROM c), f AS (SELECT *, abs(sum(z) OVER (PARTITION BY o)) AS nt FROM e)
    SELECT o, n, p, s, d, breach, CASE WHEN nt > 30 THEN z * 30 / nt ELSE z END AS limited FROM f""",
    "limited",
)
def position_limits(t: Tables) -> DataFrame:
    """Targets clipped per leg, then scaled to gross and net."""
    x = F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_shipdate").alias("d"), x.alias("x"))
    return backtest.limit_positions(rows, ["o"], "x", max_leg=40.0, max_gross=80.0, max_net=30.0).drop("x")


@query(
    """SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_shipdate AS d, CASE WHEN l_quantity < 5 THEN 0 ELSE round_even(l_quantity / 2, 0) * 2 END AS size, -(l_quantity * l_extendedprice / l_quantity * 2.5 / 1e4) AS fee,
      l_extendedprice / l_quantity * (1 + 10 * pow(l_quantity / 100, 0.5) / 1e4) AS impact_px, CASE WHEN l_quantity > 20 THEN 20 ELSE l_quantity END AS capped FROM lineitem""",
    "size fee impact_px capped",
)
def execution_costs(t: Tables) -> DataFrame:
    """Sizes rounded half to even, fees, impact and participation caps."""
    q, px = F.col("l_quantity"), F.col("l_extendedprice") / F.col("l_quantity")
    cap = ex.participation_cap(q, 0.2, F.lit(100.0), F.lit(1000.0))
    return t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_shipdate").alias("d"), ex.round_size(q, 5.0, 2.0).alias("size"), ex.fees(q, px, 1.0, 2.5).alias("fee"), ex.impact_price(px, q, F.lit(1.0), 10.0, 0.5, F.lit(100.0)).alias("impact_px"), cap["qty"].alias("capped"))


@query(
    """WITH a AS (SELECT *, CASE WHEN o_orderdate <= TIMESTAMP '1998-06-30' THEN 'train' WHEN o_orderdate <= TIMESTAMP '2000-01-01' THEN 'val' ELSE 'test' END AS split FROM orders), g AS (SELECT o_custkey FROM a GROUP BY 1 HAVING sum((split = 'train')::INT) >= 3 AND sum((split = 'val')::INT) >= 3 AND sum((split = 'test')::INT) >= 3)
    SELECT o_orderkey, split FROM a WHERE o_custkey IN (SELECT o_custkey FROM g)"""
)
def time_splits(t: Tables) -> DataFrame:
    """Train, validation and test by date, for customers with enough rows in each."""
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    return learning.time_split(t.orders, "o_orderdate", ts("1998-06-30"), ts("2000-01-01"), None, "o_custkey", 3).select("o_orderkey", "split")


@query(
    """WITH e AS (SELECT event_id, ts::DATE AS d FROM events), b AS (SELECT min(d) AS lo, max(d) AS hi FROM e), c AS (SELECT lo, unnest(generate_series(lo + INTERVAL 10 DAY, hi::TIMESTAMP, INTERVAL 4 DAY))::DATE AS cut FROM b),
    m AS (SELECT event_id, cut, CASE WHEN d < cut THEN 'train' WHEN d < cut + 3 THEN 'val' ELSE 'test' END AS split FROM e JOIN c ON d >= lo AND d < cut + 6), f AS (SELECT cut, row_number() OVER (ORDER BY cut) - 1 AS fold FROM m GROUP BY cut HAVING count(DISTINCT split) = 3)
    SELECT event_id, split, fold::INT AS fold FROM m JOIN f USING (cut)"""
)
def walk_forward_folds(t: Tables) -> DataFrame:
    """Expanding folds of ten days, then three and three, every four days."""
    return learning.walk_forward(t.events, "ts", 10, 3, 3, 4).select("event_id", "split", "fold")


@query(
    """WITH i AS (SELECT event_id, ts < TIMESTAMP '2024-01-11' AS early, coalesce(CASE WHEN event_type <> 'error' THEN value END, (SELECT avg(value) FROM events WHERE event_type <> 'error' AND ts < TIMESTAMP '2024-01-11')) AS v FROM events),
    q AS (SELECT quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM i WHERE early), w AS (SELECT event_id, early, greatest(lo, least(hi, v)) AS v FROM i, q), s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM w WHERE early) SELECT event_id, (v - m) / sd AS value FROM w, s""",
    "value",
)
def prepared_features(t: Tables) -> DataFrame:
    """Imputed, winsorised and scaled by what the rows of the first days say."""
    rows = t.events.select("event_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    prep = learning.Preparation(("value",), "mean", (0.05, 0.95), "standard").fit(rows.where("ts < TIMESTAMP_NTZ '2024-01-11'"))
    return prep.apply(rows).select("event_id", "value")


@query(
    """WITH a AS (SELECT event_id, event_type, value AS y, 20.0 + event_id % 10 AS p FROM events), r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY y) + (count(*) OVER (PARTITION BY event_type, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY event_type ORDER BY p) + (count(*) OVER (PARTITION BY event_type, p) - 1) / 2.0 AS rp FROM a)
    SELECT event_type, count(*) AS n, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, corr(ry, rp) AS rank_ic FROM r GROUP BY event_type""",
    "mae mse rmse r2 rank_ic",
)
def regression_scores(t: Tables) -> DataFrame:
    """Errors and rank correlation of a naive prediction per type."""
    rows = t.events.select("event_type", F.col("value").alias("y"), (20.0 + F.col("event_id") % 10).alias("p"))
    return learning.regression_scores(rows, "y", "p", ["event_type"])


@query(
    """WITH a AS (SELECT quality AS y, (n_chars > 1500)::INT AS p, n_chars AS s FROM labels JOIN documents USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM a)
    SELECT count(*) AS n, avg((y = p)::INT::DOUBLE) AS accuracy, sum(y * p) / sum(p) AS "precision", sum(y * p) / sum(y) AS recall, 2 * sum(y * p) / (sum(y) + sum(p)) AS f1, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r""",
    'accuracy "precision" recall f1 auc'.replace('"', ""),
)
def classification_scores(t: Tables) -> DataFrame:
    """Accuracy, F1 and area under the curve of a length rule against quality labels."""
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 1500).cast("int").alias("p"), F.col("n_chars").alias("s"))
    return learning.classification_scores(rows, "y", "p", "s")


@query(
    """WITH c AS (SELECT ts, value AS y, 10.0::DOUBLE AS lo, 30.0::DOUBLE AS hi FROM events), k AS (SELECT greatest(lo - y, y - hi) AS s, row_number() OVER (ORDER BY greatest(lo - y, y - hi)) AS i FROM c WHERE ts < TIMESTAMP '2024-01-16'), n AS (SELECT count(*) AS n FROM k),
    h AS (SELECT (n - 1) * least(1.0::DOUBLE, ceil((n + 1) * 0.9::DOUBLE) / n) AS h FROM n), q AS (SELECT sum(CASE WHEN i = floor(h) + 1 THEN s * (1 - (h - floor(h))) ELSE s * (h - floor(h)) END) AS w FROM k, h WHERE i IN (floor(h) + 1, floor(h) + 2))
    SELECT avg((lo - w <= y AND y <= hi + w)::INT::DOUBLE) AS coverage, avg(hi - lo + 2 * w) AS width FROM c, q WHERE ts >= TIMESTAMP '2024-01-16'""",
    "coverage width",
)
def conformal_intervals(t: Tables) -> DataFrame:
    """Intervals widened on the first half of the month to cover nine tenths of the second."""
    rows = t.events.select("ts", F.col("value").alias("y"), F.lit(10.0).alias("lo"), F.lit(30.0).alias("hi"))
    fitted = learning.Conformal(0.1).fit(rows.where("ts < TIMESTAMP_NTZ '2024-01-16'"), "y", "lo", "hi")
    lo, hi = fitted.apply(F.col("lo"), F.col("hi"))
    return rows.where("ts >= TIMESTAMP_NTZ '2024-01-16'").agg(learning.coverage(F.col("y"), lo, hi).alias("coverage"), F.avg(hi - lo).alias("width"))


@query(
    "SELECT (a.i * 6 + b.i * 2 + c.i)::BIGINT AS scenario, 'sweep_' || lpad((a.i * 6 + b.i * 2 + c.i)::VARCHAR, 2, '0') AS name, a.v AS entry_z, b.v AS max_hold, c.v AS cost_gate FROM (VALUES (0, 1.0::DOUBLE), (1, 1.5::DOUBLE), (2, 2.0::DOUBLE)) a(i, v), (VALUES (0, 0), (1, 5), (2, 10)) b(i, v), (VALUES (0, true), (1, false)) c(i, v)"
)
def scenario_grid(t: Tables) -> DataFrame:
    """A cartesian grid of parameters with names."""
    return sweeps.grid(t.spark, {"entry_z": [1.0, 1.5, 2.0], "max_hold": [0, 5, 10], "cost_gate": [True, False]}).select("scenario", "name", "entry_z", "max_hold", "cost_gate")


@query("SELECT s_suppkey, (ntile(7) OVER (ORDER BY s_suppkey) - 1)::INT AS part FROM supplier")
def near_equal_parts(t: Tables) -> DataFrame:
    """Suppliers in seven contiguous parts."""
    return sweeps.near_equal_parts(t.supplier.select("s_suppkey"), "s_suppkey", 7)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL", "total")
def tumbling_windows(t: Tables) -> DataFrame:
    """Hourly counts and sums per type: the stream operator on a finished table."""
    out = replay.tumbling(t.events, "ts", "1 hour", "10 minutes", ["event_type"], "value")
    return out.select(F.col("start").cast("string").alias("start"), "event_type", "n", "total")


@query(
    """WITH a AS (SELECT *, coalesce((ts - lag(ts) OVER w > INTERVAL 2 HOUR)::INT, 1) AS nu FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(nu) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM a)
    SELECT user_id, min(ts)::VARCHAR AS start, count(*) AS n, sum(value) AS total FROM b GROUP BY user_id, run""",
    "total",
)
def user_sessions(t: Tables) -> DataFrame:
    """Sessions of users with gaps below two hours."""
    out = replay.sessions(t.events, "ts", "2 hours", "1 hour", ["user_id"], "value")
    return out.select("user_id", F.col("start").cast("string").alias("start"), "n", "total")


@query(
    f"""WITH {DAILY}, b AS (SELECT t, arg_min(k, (-x, k)) AS top FROM q GROUP BY t) SELECT q.t::DATE AS trading_date, count(*) AS bars, count(DISTINCT top) AS leg_ids, count(DISTINCT top) <= 1 AS stable FROM q JOIN b USING (t) GROUP BY 1"""
)
def leg_stability(t: Tables) -> DataFrame:
    """Whether a day's leg is the same on all its bars."""
    rows = t.daily()
    top = rows.groupBy("t").agg(F.min_by("k", F.struct(-F.col("x"), F.col("k"))).alias("leg_id"))
    return selection.leg_stability(rows.join(top, "t"), ["leg"], "t")


@query(
    f"""WITH {DAILY}, r AS (SELECT * FROM q), g AS (SELECT r.t, r.k, CASE WHEN k % 2 = 1 AND t >= TIMESTAMP '1998-01-01' THEN k - 1 ELSE k END AS src FROM r) SELECT g.t, g.k, r.x FROM g LEFT JOIN r ON r.t = g.t AND r.k = g.src""",
    "x",
)
def rolled_instruments(t: Tables) -> DataFrame:
    """From a date on, odd instruments show the rows of the even ones before them."""
    rows = t.daily().select("t", "k", "x")
    rolls = rows.where("k % 2 = 1").select(F.col("k").alias("from_id"), (F.col("k") - 1).alias("to_id")).distinct().withColumn("effective", F.lit("1998-01-01").cast("timestamp_ntz"))
    return panel.apply_rolls(rows, rolls, "t", "k")


@query(
    """WITH e AS (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i, vec_id, label FROM embeddings), c AS (SELECT label, i, avg(v::DOUBLE) AS m FROM e GROUP BY ALL) SELECT label, sqrt(sum(m * m)) AS norm, max(i)::INT AS dims FROM c GROUP BY label""",
    "norm",
)
def centroid_norms(t: Tables) -> DataFrame:
    """Length of the mean vector of each label: array columns through posexplode."""
    rows = t.embeddings.select("label", F.posexplode("embedding").alias("i", "v"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"), (F.max("i") + 1).alias("dims"))


@query(
    """SELECT n_name, c_mktsegment, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name, c_mktsegment), (n_name), ())""",
    "total",
)
def cost_rollup(t: Tables) -> DataFrame:
    """Totals by nation and segment, by nation, and over all in one pass."""
    small = F.broadcast(t.nation)  # a fixed table of 25 rows
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(small, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))
