"""Backtests of structures and portfolios, and first-in-first-out matching.

What depends on earlier rows only through lags or running sums is windows.  Basket
and portfolio simulations with path-dependent state are one fold per scenario or
reference, with all market rows of a stamp given as arrays.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import Axis

LEGS = ("front", "belly", "back")


def structure_backtest(df: DataFrame, axis: Axis, signal: str, notional: float = 1.0, cost_bps: float = 0.0, dv01_target: float | None = None, legs: Sequence[str] = LEGS) -> DataFrame:
    """Daily structure backtest from ``<leg>_price``, ``<leg>_weight`` (and ``<leg>_dv01``): positions act a row after the signal.

    gross return = position times the weighted leg returns; cost in basis points of
    the change of leg notionals.  No fold is needed: every term is a lag.
    """
    rows = df.withColumn("position", F.coalesce(axis.lag(signal), F.lit(0)).cast("double"))
    if dv01_target is None:
        scale = F.lit(notional)
    else:
        gross = sum((F.abs(F.col(f"{n}_weight") * F.col(f"{n}_dv01")) for n in legs), F.lit(0.0))
        scale = F.when(gross > 1e-12, dv01_target / gross).otherwise(0.0)
    rows = rows.withColumn("_scale", scale)
    for n in legs:
        rows = rows.withColumn(f"_n_{n}", F.col("position") * F.col("_scale") * F.col(f"{n}_weight") * F.col(f"{n}_price"))
        rows = rows.withColumn(f"_r_{n}", F.coalesce(F.col(f"{n}_price") / F.nullif(axis.lag(f"{n}_price"), F.lit(0.0)) - 1, F.lit(0.0)))
    gross_ret = sum((F.col(f"{n}_weight") * F.col(f"_r_{n}") for n in legs), F.lit(0.0))
    traded = sum((F.abs(F.col(f"_n_{n}") - F.coalesce(axis.lag(f"_n_{n}"), F.lit(0.0))) for n in legs), F.lit(0.0))
    rows = rows.withColumn("gross_return", F.col("position") * F.col("_scale") * gross_ret).withColumn("traded_notional", traded)
    rows = rows.withColumn("gross_notional", sum((F.abs(F.col(f"_n_{n}")) for n in legs), F.lit(0.0)))
    rows = rows.withColumn("cost", F.col("traded_notional") * cost_bps / 1e4).withColumn("net_return", F.col("gross_return") - F.col("cost"))
    rows = rows.withColumn("cum_pnl", F.sum("net_return").over(axis.frame(None)))
    return rows.drop("_scale", *(f"_{k}_{n}" for n in legs for k in "nr"))


def daily_totals(df: DataFrame, ts: str, by: Sequence[str], flows: Sequence[str], stocks: Sequence[str]) -> DataFrame:
    """Per date: sums of flows, last stocks, and the running total of the first flow."""
    out = df.groupBy(*by, F.to_date(ts).alias("trading_date")).agg(*(F.sum(c).alias(c) for c in flows), *(F.max_by(c, ts).alias(c) for c in stocks))
    w = Window.partitionBy(*by).orderBy("trading_date").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cum_pnl", F.sum(flows[0]).over(w))


def rebalanced_portfolio(prices: DataFrame, targets: DataFrame, ts: str, key: str, price: str, target: str = "dv01", cost_per_dv01: float = 0.0) -> DataFrame:
    """Per stamp: holdings follow the newest target before the bar's return; pnl = holding times return in basis points / 100."""
    w = Window.partitionBy(key).orderBy(ts)
    rows = prices.select(ts, key, price).join(targets.select(ts, key, F.col(target).alias("_t")), [ts, key], "left")
    rows = rows.withColumn("holding", F.coalesce(F.last("_t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    rows = rows.withColumn("_bp", F.coalesce((F.col(price) / F.nullif(F.lag(price).over(w), F.lit(0.0)) - 1) * 1e4, F.lit(0.0)))
    rows = rows.withColumn("_tr", F.abs(F.col("holding") - F.coalesce(F.lag("holding").over(w), F.lit(0.0))))
    out = rows.groupBy(ts).agg(F.sum(F.col("holding") * F.col("_bp") / 100).alias("gross_pnl"), F.sum("_tr").alias("turnover"), (F.sum("_tr") * cost_per_dv01).alias("cost"), F.sum(F.abs("holding")).alias("gross_dv01"), F.sum("holding").alias("net_dv01"))
    out = out.withColumn("pnl", F.col("gross_pnl") - F.col("cost"))
    return out.withColumn("cum_pnl", F.sum("pnl").over(Window.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)))  # one row per stamp


def fifo_round_trips(fills: DataFrame, key: str, order: Sequence[str], bar: str, side: str, qty: str, px: str) -> DataFrame:
    """First-in-first-out round trips per key: entry bar, exit bar, side, quantity, pnl.

    The k-th unit ever bought is matched with the k-th unit ever sold; whichever of
    the two came first opened the trip.  The ends of the fills' intervals of
    cumulative quantity, of both sides in one order, cut the quantity into pieces
    that lie in one buy and one sell each, the next of either side to end: one sort
    per key and a carried value, no pairs are tried.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = fills.where((F.col(qty) > 0) & (F.col(side) != 0)).select(F.col(key), place.alias("_p"), F.col(bar).alias("_b"), (F.col(side) > 0).alias("_buy"), F.col(qty).cast("double").alias("_q"), F.col(px).cast("double").alias("_px"))
    rows = rows.withColumn("_hi", F.sum("_q").over(Window.partitionBy(key, "_buy").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))
    fill = F.struct("_p", "_b", "_px")
    ends = rows.groupBy(key, "_hi").agg(F.max(F.when(F.col("_buy"), fill)).alias("_bought"), F.max(F.when(~F.col("_buy"), fill)).alias("_sold"))
    down = Window.partitionBy(key).orderBy(F.col("_hi").desc()).rowsBetween(Window.unboundedPreceding, 0)
    amount = F.col("_hi") - F.coalesce(F.lead("_hi").over(Window.partitionBy(key).orderBy(F.col("_hi").desc())), F.lit(0.0))
    met = ends.select(key, amount.alias("qty"), *(F.last(c, ignorenulls=True).over(down).alias(c) for c in ("_bought", "_sold"))).where("_bought IS NOT NULL AND _sold IS NOT NULL")
    b, s, long_ = F.col("_bought"), F.col("_sold"), F.col("_bought._p") < F.col("_sold._p")
    return met.select(
        key, F.when(long_, b["_b"]).otherwise(s["_b"]).alias("entry_bar"), F.when(long_, s["_b"]).otherwise(b["_b"]).alias("exit_bar"),
        F.when(long_, 1).otherwise(-1).alias("side"), "qty", (F.col("qty") * (s["_px"] - b["_px"])).alias("pnl"),
    )


def lot_stats(trips: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hit rate, profit factor and means of round trips."""
    p = F.col("pnl")
    gain, loss = F.sum(F.greatest(p, F.lit(0.0))), F.sum(F.greatest(-p, F.lit(0.0)))
    return trips.groupBy(*by).agg(F.count(F.lit(1)).alias("n_trips"), F.sum("qty").alias("qty"), F.sum("pnl").alias("pnl"), F.avg((p > 0).cast("double")).alias("hit_rate"), F.when(loss > 0, gain / F.nullif(loss, F.lit(0.0))).otherwise(F.lit(math.inf)).alias("profit_factor"))


def hedged_round_trips(trips: DataFrame, ratios: DataFrame, dv01: DataFrame, hedges: DataFrame, bars: DataFrame, key: str, bar: str = "bar") -> DataFrame:
    """Round trips with the profit of their hedges: theoretical_pnl and net_pnl.

    trips as :func:`fifo_round_trips` gives them; ratios (bar, key, hedge, ratio), dv01
    (bar, key, dv01), hedges (bar, hedge, hedge_dv01, bid, ask), bars (bar, hedge_pnl).
    Theoretical: each hedge is traded across its spread at entry and at exit.  Net:
    a bar's hedge profit is shared by all open trips as their hedges' dv01, from
    the entry up to the bar before the exit.  A share grows with a trip's quantity,
    so running sums per key say it for all trips and no trip meets its bars.
    """
    need = ratios.join(dv01, [bar, key])
    side = ["entry_bar", "exit_bar", "side"]
    kinds = trips.select(key, *side).distinct()
    here = need.join(hedges, [bar, "hedge"]).where(F.abs("hedge_dv01") >= 1e-15).select(F.col(bar).alias("entry_bar"), key, "hedge", (F.col("dv01") * F.col("ratio") / F.col("hedge_dv01")).alias("_q"), F.col("bid").alias("_bid"), F.col("ask").alias("_ask"))
    there = hedges.select(F.col(bar).alias("exit_bar"), "hedge", "bid", "ask")
    q = F.col("side") * F.col("_q")
    unit = kinds.join(here, [key, "entry_bar"]).join(there, ["exit_bar", "hedge"])
    unit = unit.groupBy(key, *side).agg(F.sum(q * F.when(q > 0, F.col("bid") - F.col("_ask")).otherwise(F.col("ask") - F.col("_bid"))).alias("_theory"))

    demand = need.groupBy(key, bar).agg(F.sum(F.abs(F.col("dv01") * F.col("ratio"))).alias("_need"))
    moves = trips.select(key, F.explode(F.array(F.struct(F.col("entry_bar").alias(bar), F.col("qty").alias("_dq")), F.struct(F.col("exit_bar").alias(bar), (-F.col("qty")).alias("_dq")))).alias("_m")).select(key, "_m.*")
    both = demand.select(key, bar, "_need", F.lit(0.0).alias("_dq")).unionByName(moves.select(key, bar, F.lit(0.0).alias("_need"), "_dq")).groupBy(key, bar).agg(F.sum("_need").alias("_need"), F.sum("_dq").alias("_dq"))
    order = Window.partitionBy(key).orderBy(bar)
    held = both.withColumn("_load", F.col("_need") * F.sum("_dq").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = held.groupBy(bar).agg(F.sum("_load").alias("_total")).join(bars.select(bar, "hedge_pnl"), bar).select(bar, F.when(F.col("_total") >= 1e-15, F.col("hedge_pnl") / F.when(F.col("_total") >= 1e-15, F.col("_total"))).otherwise(0.0).alias("_rate"))
    upto = held.join(total, bar, "left").select(key, bar, F.coalesce(F.sum(F.coalesce("_rate", F.lit(0.0)) * F.col("_need")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_upto"))
    out = trips.join(unit, [key, *side], "left")
    for end in ("entry", "exit"):
        out = out.join(upto.select(key, F.col(bar).alias(f"{end}_bar"), F.col("_upto").alias(f"_{end}")), [key, f"{end}_bar"])
    return out.select(key, *side, "qty", "pnl", (F.col("pnl") + F.col("qty") * F.coalesce("_theory", F.lit(0.0))).alias("theoretical_pnl"), (F.col("pnl") + F.col("qty") * (F.col("_exit") - F.col("_entry"))).alias("net_pnl"))


def close_bars(bars: DataFrame, ts: str, close: str) -> DataFrame:
    """The bars that stand at one time of day, ``HH:mm`` or ``HH:mm:ss``."""
    return bars.where(F.date_format(ts, "HH:mm:ss") == (close if close.count(":") == 2 else f"{close}:00"))


def bucket_exposures(positions: DataFrame, by: Sequence[str], bucket: str, qty: str, dv01: str) -> DataFrame:
    """Signed and gross dv01 of the positions in each bucket."""
    x = F.coalesce(F.col(qty) * F.col(dv01), F.lit(0.0))
    return positions.groupBy(*by, bucket).agg(F.sum(x).alias("net_dv01"), F.sum(F.abs(x)).alias("gross_dv01"), F.sum((x != 0).cast("int")).alias("n_open"))



def take_levels(px: np.ndarray, sz: np.ndarray, qty: float, haircut: float, levels: int) -> tuple[float, float]:
    """Filled size and notional of a walk down one book side; bad levels are skipped."""
    ok = (px > 0) & (sz > 0)
    px, sz = px[ok][:levels], sz[ok][:levels] * haircut
    have = np.cumsum(sz)
    got = np.clip(qty - (have - sz), 0, sz)
    return float(got.sum()), float((got * px).sum())


#: Codes of the basket simulation.
HOLD, ENTRY_OK, ENTRY_NO_LIQUIDITY, ENTRY_BAD_BOOK, ENTRY_TOO_WIDE, EXIT_TP, EXIT_SL, EXIT_TIME, EXIT_NO_LIQUIDITY = range(9)


@dataclass(frozen=True)
class BasketRule:
    """Long at z >= entry (and the mirror), out at profit, loss or time; costs must stay below the expected gain."""

    entry_z: float = 2.0
    take_profit_z: float = 0.0
    take_profit_yield: float = 5.0
    stop_yield: float = 5.0
    max_hold: int = 0
    cooldown: int = 0
    ref_dv01: float = 100.0
    haircut: float = 1.0
    levels: int = 5
    cost_gate: bool = True
    capital: float = 0.0


def basket_bars(frame: dict[str, np.ndarray], rule: BasketRule, ref: int) -> pd.DataFrame:
    """One scenario: arrays bid_px, bid_sz, ask_px, ask_sz (T, N, L), mid, dv01, ratio (T, N), z, gain, yield (T)."""
    mid, dv01, ratio, z = frame["mid"], frame["dv01"], frame["ratio"], frame["z"]
    steps, legs = mid.shape
    pos, cash, side, held, wait, entry_yield = np.zeros(legs), rule.capital, 0, 0, 0, 0.0
    out = []
    equity = rule.capital
    for t in range(steps):
        code, cost = HOLD, 0.0

        def trade(q: np.ndarray, t: int = t) -> tuple[bool, float, float]:
            """Whether all legs fill, the cash moved, and the cost against mid."""
            moved = lost = 0.0
            for i in np.flatnonzero(np.abs(q) > 1e-12):
                book = ("ask_px", "ask_sz") if q[i] > 0 else ("bid_px", "bid_sz")
                got, paid = take_levels(frame[book[0]][t, i], frame[book[1]][t, i], abs(q[i]), rule.haircut, rule.levels)
                if got < abs(q[i]) - 1e-9:
                    return False, 0.0, 0.0
                moved -= math.copysign(paid, q[i])
                lost += abs(paid - abs(q[i]) * mid[t, i])
            return True, moved, lost

        valid = all(ratio[t, i] == 0 or (0 < frame["bid_px"][t, i, 0] <= mid[t, i] <= frame["ask_px"][t, i, 0]) for i in range(legs))
        if side:
            held += 1
            gain = side * (entry_yield - frame["yield"][t])
            why = EXIT_SL if gain <= -rule.stop_yield else EXIT_TIME if rule.max_hold and held >= rule.max_hold else EXIT_TP if gain >= rule.take_profit_yield or (side * z[t] <= rule.take_profit_z and gain > 0) else HOLD
            if why:
                ok, moved, lost = trade(-pos) if valid else (False, 0.0, 0.0)
                if ok:
                    cash, pos, cost, code, side, held, wait = cash + moved, np.zeros(legs), lost, why, 0, 0, rule.cooldown
                else:
                    code = EXIT_NO_LIQUIDITY
        elif wait:
            wait -= 1
        elif abs(z[t]) >= rule.entry_z:
            want = 1 if z[t] > 0 else -1
            with np.errstate(divide="ignore", invalid="ignore"):
                size = np.where((dv01[t] > 0) & (ratio[t] != 0), want * ratio[t] * rule.ref_dv01 / dv01[t], 0.0)
            if not valid:
                code = ENTRY_BAD_BOOK
            else:
                ok, moved, lost = trade(size)
                if not ok:
                    code = ENTRY_NO_LIQUIDITY
                elif rule.cost_gate and 2 * lost > frame["gain"][t] * rule.ref_dv01:
                    code = ENTRY_TOO_WIDE
                else:
                    cash, pos, cost, code, side, held, entry_yield = cash + moved, size, lost, ENTRY_OK, want, 0, frame["yield"][t]
        now = cash + float((pos * mid[t]).sum())
        out.append((t, code, side, held, cost, now - equity, now))
        equity = now
    return pd.DataFrame(out, columns=["bar", "code", "state", "held", "cost", "pnl", "equity"])


BARS = "bar int, code int, state int, held int, cost double, pnl double, equity double"


def basket_backtest(market: DataFrame, scenarios: DataFrame, ref_col: str = "ref", rule_cols: Sequence[str] = ("entry_z",)) -> DataFrame:
    """Every scenario on every reference's market, which is shuffled once: a task reads a reference and runs all scenarios on it.

    market: ref, ts, legs array<struct<id, bid array<struct<px,sz>>, ask, mid, dv01, ratio>> (in one order, the
    reference first), z, gain, package_yield; one row per stamp.  scenarios: scenario, and fields of the rule; a table
    as small as its grid, which goes to the tasks with the code.
    """
    plain = BasketRule()
    rules = [(r["scenario"], BasketRule(**{c: type(getattr(plain, c))(r[c]) for c in rule_cols})) for r in scenarios.select("scenario", *rule_cols).collect()]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        legs = rows["legs"].tolist()
        levels = max((len(x["bid"]) for r in legs for x in r), default=1)

        def side(name: str, part: str) -> np.ndarray:
            return np.array([[[lv[part] for lv in x[name]] + [0.0] * (levels - len(x[name])) for x in r] for r in legs], float)

        flat = {n: np.array([[x[n] for x in r] for r in legs], float) for n in ("mid", "dv01", "ratio")}
        frame = {"bid_px": side("bid", "px"), "bid_sz": side("bid", "sz"), "ask_px": side("ask", "px"), "ask_sz": side("ask", "sz"), **flat}
        frame |= {"z": rows["z"].to_numpy(float), "gain": rows["gain"].to_numpy(float), "yield": rows["package_yield"].to_numpy(float)}
        made = []
        for scenario, rule in rules:
            out = basket_bars(frame, rule, 0)
            out.insert(0, "ts", rows["ts"].to_numpy())
            out.insert(0, "scenario", scenario)
            out.insert(0, ref_col, rows[ref_col].iloc[0])
            made.append(out)
        return pd.concat(made, ignore_index=True)

    kinds = dict(market.dtypes)
    return market.groupBy(ref_col).applyInPandas(run, f"{ref_col} {kinds[ref_col]}, scenario {dict(scenarios.dtypes)['scenario']}, ts {kinds['ts']}, {BARS}")


def basket_trades(bars: DataFrame, by: Sequence[str] = ("ref", "scenario")) -> DataFrame:
    """Entry and exit bars paired, with the pnl of the bars from one to the other."""
    w = Window.partitionBy(*by).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.withColumn("_trade", F.sum((F.col("code") == ENTRY_OK).cast("int")).over(w))
    closed = F.sum(F.col("code").isin(EXIT_TP, EXIT_SL, EXIT_TIME).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_closed", F.coalesce(closed, F.lit(0))).where("_trade > _closed")
    return rows.groupBy(*by, "_trade").agg(F.min("bar").alias("entry_bar"), F.max(F.when(F.col("code").isin(EXIT_TP, EXIT_SL, EXIT_TIME), F.col("bar"))).alias("exit_bar"), F.max_by("code", "bar").alias("exit_code"), F.sum("pnl").alias("pnl"), F.sum("cost").alias("cost")).drop("_trade")


#: Caps of an allocation: group of each item, side of each item, and by group what is there already (signed) and the most.
Caps = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def greedy_allocation(alpha: np.ndarray, most: np.ndarray, gross: float, caps: Sequence[Caps] = ()) -> np.ndarray:
    """Largest alpha first, each up to its bound, the gross cap and the signed room of its groups."""
    out = np.zeros(len(alpha))
    now = [current.astype(float).copy() for _, _, current, _ in caps]
    for i in np.argsort(-alpha, kind="stable"):
        if alpha[i] <= 0 or gross <= 0:
            break
        x = min([most[i], gross, *(cap[g[i]] - side[i] * have[g[i]] for (g, side, _, cap), have in zip(caps, now, strict=True))])
        if x > 0:
            out[i] = x
            gross -= x
            for (g, side, _, _), have in zip(caps, now, strict=True):
                have[g[i]] += side[i] * x
    return out


def simplex(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray | None:
    """max c.x with a x <= b and x >= 0 by a dense two-phase simplex (least index: no cycling); None if nothing is feasible."""
    m, n = a.shape
    low = np.flatnonzero(b < 0)
    sign = np.where(b < 0, -1.0, 1.0)
    extra = np.zeros((m, len(low)))
    extra[low, np.arange(len(low))] = 1.0
    table = np.hstack([a * sign[:, None], np.diag(sign), extra, np.abs(b)[:, None]])
    basis = np.arange(n, n + m)
    basis[low] = n + m + np.arange(len(low))

    def climb(cost: np.ndarray, columns: int) -> None:
        while True:
            gain = cost[:columns] - cost[basis] @ table[:, :columns]
            better = np.flatnonzero(gain > 1e-11)
            if not len(better):
                return
            col = table[:, better[0]]
            rows = np.flatnonzero(col > 1e-11)
            if not len(rows):
                return  # unbounded, which bounds on every item rule out
            ratio = table[rows, -1] / col[rows]
            ties = rows[ratio <= ratio.min() + 1e-12]
            leave = ties[np.argmin(basis[ties])]
            table[leave] /= table[leave, better[0]]
            others = np.arange(m) != leave
            table[others] -= np.outer(table[others, better[0]], table[leave])
            basis[leave] = better[0]

    if len(low):
        climb(np.concatenate([np.zeros(n + m), -np.ones(len(low))]), n + m)
        if table[basis >= n + m, -1].sum() > 1e-9:
            return None
    climb(np.concatenate([c, np.zeros(m + len(low))]), n + m)
    x = np.zeros(n + m + len(low))
    x[basis] = table[:, -1]
    return np.maximum(x[:n], 0.0)


def linear_allocation(alpha: np.ndarray, most: np.ndarray, gross: float, caps: Sequence[Caps] = ()) -> np.ndarray | None:
    """max alpha.x with 0 <= x <= most, a gross cap and signed group caps; None where these cannot hold together."""
    out = np.zeros(len(alpha))
    keep = np.flatnonzero((alpha > 0) & (most > 0))
    if not len(keep):
        return out
    rows, rhs = [np.eye(len(keep)), np.ones((1, len(keep)))], [most[keep], np.array([gross])]
    for g, side, current, cap in caps:
        signed = (g[keep][None, :] == np.arange(len(cap))[:, None]) * side[keep].astype(float)
        rows += [signed, -signed]
        rhs += [cap - current, cap + current]
    x = simplex(np.vstack(rows), np.concatenate(rhs).astype(float), alpha[keep])
    if x is None:
        return None
    out[keep] = x
    return out


#: What a stamp of the portfolio simulation did (fixed values).
IDLE, NO_CANDIDATE, WAITING, WAITING_REDUCING = 0, 1, 2, 3
DONE, DONE_PARTLY, NO_DEPTH, DONE_GREEDY = 100, 101, 102, 110
INFEASIBLE, NOTHING_SIZED = 200, 201
#: What became of an order (fixed values).
FILLED, FILLED_PARTLY, UNFILLED, TOO_LITTLE = 0, 1, 2, 4


@dataclass(frozen=True)
class PortfolioRule:
    """Gates, caps and execution of the portfolio simulation.

    A trade that brings a position nearer to nothing is reducing and has gates of
    its own.  gross_cap bounds the risk traded at a stamp; the caps of issuers and
    maturity buckets (by number) bound the signed risk held.  After a trade nothing,
    or with ``reduce_while_waiting`` only reducing trades, are done for ``cooldown`` stamps.
    """

    z_inc: float = 2.0
    p_inc: float = 0.05
    z_dec: float = 1.0
    p_dec: float = 0.10
    alpha_inc: float = 0.0
    alpha_dec: float = 0.0
    gross_cap: float = 1000.0
    issuer_caps: tuple[float, ...] = ()
    bucket_caps: tuple[float, ...] = ()
    top_k: int = 10
    haircut: float = 1.0
    levels: int = 5
    min_fill: float = 0.0
    min_maturity: float = 0.0
    cooldown: int = 0
    reduce_while_waiting: bool = False
    use_lp: bool = True
    capital: float = 0.0


@dataclass
class PortfolioState:
    """What a chunk hands to the next: holdings and last mids by id, hedges among them, and what was booked."""

    pos: dict = field(default_factory=dict)
    hedge: dict = field(default_factory=dict)
    cash: float = 0.0
    mids: dict = field(default_factory=dict)
    wait: int = 0
    equity: float = 0.0
    hedge_value: float = 0.0


def _number(x) -> float:
    return float("nan") if x is None else float(x)


def trade_size(q: float, least: float, step: float) -> float:
    """Zero below the least size, else half-to-even to the step."""
    if math.isnan(q) or abs(q) < (least or 0.0):
        return 0.0
    return round(q / step) * step if step and step > 1e-15 else q


def _walk(levels: Sequence[tuple[float, float]], qty: float, rule: PortfolioRule) -> tuple[float, float]:
    """``take_levels`` for the few levels of one order."""
    got = paid = 0.0
    for px, sz in [(p, z) for p, z in levels if p is not None and z is not None and p > 0 and z > 0][: rule.levels]:
        x = min(qty - got, sz * rule.haircut)
        if x <= 0:
            break
        got, paid = got + x, paid + x * px
    return got, paid


def portfolio_candidates(rows: Sequence[dict], state: PortfolioState, rule: PortfolioRule, reducing_only: bool = False) -> list[tuple[float, float, int, bool, dict]]:
    """(alpha, most risk, side, reducing, row) of every side worth trading, best first; alpha is price edge per unit of dv01."""
    out = []
    for r in rows:
        dv01, mid, fair = _number(r["dv01"]), _number(r["mid"]), _number(r["fair"])
        if not r.get("tradable", True) or not dv01 > 1e-15 or math.isnan(fair) or not r["bid"] or not r["ask"]:
            continue
        bid, ask = _number(r["bid"][0][0]), _number(r["ask"][0][0])
        if not (0 < bid <= mid <= ask):
            continue
        have, z, p = state.pos.get(r["id"], 0.0), abs(_number(r["z"])), _number(r["p"])
        for side, edge in ((1, fair - ask), (-1, bid - fair)):
            reducing = side * have < -1e-15
            opens = (z > rule.z_dec and p < rule.p_dec) if reducing else (z > rule.z_inc and p < rule.p_inc and not reducing_only)
            if not opens or edge / dv01 <= (rule.alpha_dec if reducing else rule.alpha_inc):
                continue
            if not reducing and rule.min_maturity > 0 and _number(r.get("maturity", math.inf)) < rule.min_maturity:
                continue
            sizes = [_number(z) for _, z in (r["ask"] if side > 0 else r["bid"])]
            if not sizes[0] > 1e-15:
                continue
            room = r["long_max"] - have if side > 0 else have - r["short_max"]
            most = r.get("most_dec" if reducing else "most_inc")
            room = min(room, abs(have) if reducing else math.inf, math.inf if most is None else most)
            if room >= 1e-15:
                depth = sum(z for z in sizes[: rule.levels] if z > 0) * rule.haircut
                out.append((edge / dv01, min(room, depth) * dv01, side, reducing, r))
    return sorted(out, key=lambda c: (-c[0], str(c[4]["id"])))[: rule.top_k]


def _sized(found: list, rows: Sequence[dict], state: PortfolioState, rule: PortfolioRule) -> np.ndarray:
    """Risk per candidate; nothing is traded where the caps cannot hold."""
    alpha, most, side = (np.array([c[k] for c in found], float) for k in range(3))
    caps = []
    for name, cap in (("issuer", rule.issuer_caps), ("bucket", rule.bucket_caps)):
        if cap:
            held = np.zeros(len(cap))
            for r in rows:
                if 0 <= (r.get(name) if r.get(name) is not None else -1) < len(cap) and not math.isnan(_number(r["dv01"])):
                    held[r[name]] += state.pos.get(r["id"], 0.0) * r["dv01"]
            caps.append((np.array([c[4][name] for c in found]), side, held, np.array(cap, float)))
    if not rule.use_lp:
        return greedy_allocation(alpha, most, rule.gross_cap, caps)
    size = linear_allocation(alpha, most, rule.gross_cap, caps)
    return np.zeros(len(found)) if size is None else size


def portfolio_step(rows: Sequence[dict], state: PortfolioState, rule: PortfolioRule, hedges: Sequence[dict] = ()) -> tuple[dict, list[dict]]:
    """One stamp: (bar, fills).

    rows have id, bid, ask (lists of (px, sz)), mid, dv01, fair, z, p, long_max, short_max, step, min_qty and may have
    tradable, maturity, issuer, bucket, most_inc, most_dec, hedge_ratios (id -> signed ratio); hedges have id, bid, ask,
    mid, dv01 and may have step and min_qty.  Hedges follow the risk of all positions at every stamp.
    """
    fills: list[dict] = []
    cost = hedge_cost = hedge_paid = 0.0
    waiting, code = state.wait > 0, IDLE
    state.wait = max(0, state.wait - 1)
    if waiting:
        code = WAITING_REDUCING if rule.reduce_while_waiting else WAITING
    if not waiting or rule.reduce_while_waiting:
        found = portfolio_candidates(rows, state, rule, waiting)
        if not found and not waiting:
            code = NO_CANDIDATE
        if found:
            sizes = _sized(found, rows, state, rule)
            for (alpha, _, side, reducing, r), risk in zip(found, sizes.tolist(), strict=True):
                want = trade_size(risk / r["dv01"], r["min_qty"], r["step"])
                if not want >= 1e-15:
                    continue
                got, paid = _walk(r["ask"] if side > 0 else r["bid"], want, rule)
                became = UNFILLED if got < 1e-15 else TOO_LITTLE if got < rule.min_fill * want else FILLED_PARTLY if got < want - 1e-10 else FILLED
                vwap = paid / got if got >= 1e-15 else None
                if became in (UNFILLED, TOO_LITTLE):
                    got = paid = 0.0
                lost = abs(paid - got * r["mid"])
                fills.append({"id": str(r["id"]), "hedge": False, "side": side, "wanted": want, "filled": got, "px": vwap, "mid": float(r["mid"]), "dv01": got * r["dv01"], "alpha": alpha, "reducing": reducing, "cost": lost, "became": became})
                state.pos[r["id"]] = state.pos.get(r["id"], 0.0) + side * got
                state.cash -= side * paid
                cost += lost
            kinds = {f["became"] for f in fills}
            done = kinds & {FILLED, FILLED_PARTLY}
            code = ((DONE if rule.use_lp else DONE_GREEDY) if kinds == {FILLED} else DONE_PARTLY) if done else NO_DEPTH if kinds else INFEASIBLE if rule.use_lp else NOTHING_SIZED
            if done:
                state.wait = rule.cooldown
    for h in hedges:
        mid, dv01 = _number(h["mid"]), _number(h["dv01"])
        if math.isnan(mid):
            continue
        # without a dv01 there is no target: the hedge is closed
        target = sum(state.pos.get(r["id"], 0.0) * r["dv01"] * ((r.get("hedge_ratios") or {}).get(h["id"]) or 0.0) for r in rows if _number(r["dv01"]) > 1e-15) / dv01 if dv01 > 1e-15 else 0.0
        want = trade_size(target - state.hedge.get(h["id"], 0.0), h.get("min_qty") or 0.0, h.get("step") or 0.0)
        side = 1 if want > 0 else -1
        got, paid = _walk(h["ask"] if side > 0 else h["bid"], abs(want), rule) if abs(want) >= 1e-15 else (0.0, 0.0)
        if got >= 1e-15:
            lost = abs(paid - got * mid)
            fills.append({"id": str(h["id"]), "hedge": True, "side": side, "wanted": abs(want), "filled": got, "px": paid / got, "mid": mid, "dv01": got * dv01, "alpha": None, "reducing": False, "cost": lost, "became": FILLED if got >= abs(want) - 1e-10 else FILLED_PARTLY})
            state.hedge[h["id"]] = state.hedge.get(h["id"], 0.0) + side * got
            state.cash -= side * paid
            hedge_cost += lost
            hedge_paid += side * paid
    state.mids.update({k["id"]: float(k["mid"]) for k in (*rows, *hedges) if not math.isnan(_number(k["mid"]))})
    value, hedge_value = (sum(q * state.mids.get(k, 0.0) for k, q in held.items()) for held in (state.pos, state.hedge))
    equity = state.cash + value + hedge_value
    risk = {k["id"]: 0.0 if math.isnan(_number(k["dv01"])) else float(k["dv01"]) for k in (*rows, *hedges)}
    net, gross = (sum(f(q) * risk.get(k, 0.0) for k, q in state.pos.items()) for f in (float, abs))
    bar = {
        "code": code, "n_trades": sum(not f["hedge"] and f["filled"] > 0 for f in fills), "cost": cost, "hedge_cost": hedge_cost, "traded_dv01": sum(f["dv01"] for f in fills if not f["hedge"]), "pnl": equity - state.equity, "gross_pnl": equity - state.equity + cost + hedge_cost,
        "hedge_pnl": hedge_value - state.hedge_value - hedge_paid, "equity": equity, "position_value": value, "hedge_value": hedge_value, "net_dv01": net, "gross_dv01": gross, "hedge_dv01": sum(q * risk.get(k, 0.0) for k, q in state.hedge.items()),
        "cooldown": state.wait, "open_positions": sum(abs(q) > 1e-12 for q in state.pos.values()),
    }
    state.equity, state.hedge_value = equity, hedge_value
    return bar, fills


PORTFOLIO_BARS = (
    "code int, n_trades int, cost double, hedge_cost double, traded_dv01 double, pnl double, gross_pnl double, hedge_pnl double, equity double, position_value double, hedge_value double, "
    "net_dv01 double, gross_dv01 double, hedge_dv01 double, cooldown int, open_positions int"
)
PORTFOLIO_FILLS = "id string, hedge boolean, side int, wanted double, filled double, px double, mid double, dv01 double, alpha double, reducing boolean, cost double, became int"


def _portfolio(market: DataFrame, by: str, ts: str, rule: PortfolioRule, fills: bool) -> DataFrame:
    hedged = "hedges" in market.columns

    def plain(rows) -> list[dict]:
        made = [{**r, "bid": [(x["px"], x["sz"]) for x in r["bid"]], "ask": [(x["px"], x["sz"]) for x in r["ask"]]} for r in (rows if rows is not None else ())]
        for r in made:
            if isinstance(r.get("hedge_ratios"), list):
                r["hedge_ratios"] = dict(r["hedge_ratios"])
        return sorted(made, key=lambda r: str(r["id"]))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        state, out = PortfolioState(cash=rule.capital, equity=rule.capital), []
        part = part.sort_values(ts)
        columns = [part[c].tolist() for c in (ts, "rows", *(["hedges"] if hedged else []))]
        for stamp, rows, *rest in zip(*columns, strict=True):
            bar, done = portfolio_step(plain(rows), state, rule, plain(rest[0]) if rest else ())
            out += [{by: part[by].iloc[0], ts: stamp, **x} for x in (done if fills else [bar])]
        return pd.DataFrame(out, columns=names)

    kinds = dict(market.dtypes)
    schema = f"{by} {kinds[by]}, {ts} {kinds[ts]}, {PORTFOLIO_FILLS if fills else PORTFOLIO_BARS}"
    names = [by, ts, *(x.split()[0] for x in (PORTFOLIO_FILLS if fills else PORTFOLIO_BARS).split(", "))]
    return market.groupBy(by).applyInPandas(run, schema)


def portfolio_backtest(market: DataFrame, by: str = "book", ts: str = "ts", rule: PortfolioRule = PortfolioRule()) -> DataFrame:
    """Bars of the portfolio simulation per book, stamps in order; market has one row per (book, stamp) with ``rows`` and, on demand, ``hedges`` (array<struct>)."""
    return _portfolio(market, by, ts, rule, False)


def portfolio_fills(market: DataFrame, by: str = "book", ts: str = "ts", rule: PortfolioRule = PortfolioRule()) -> DataFrame:
    """Orders of the same simulation, instruments and hedges, with what became of them."""
    return _portfolio(market, by, ts, rule, True)


def instrument_pnl(fills: DataFrame, mids: DataFrame, by: str = "book", ts: str = "ts") -> DataFrame:
    """Per book, stamp and instrument: holding after the stamp's fills and the pnl since the stamp before.

    mids: (by, ts, id, mid) of all stamps.  What was held moves with the mid, what was traded from its price to the mid; no fold.
    """
    signed = F.col("side") * F.col("filled")
    moved = fills.groupBy(by, ts, "id").agg(F.sum(signed).alias("_q"), F.sum(-signed * F.coalesce("px", F.lit(0.0))).alias("_cash"))
    w = Window.partitionBy(by, "id").orderBy(ts)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = mids.select(by, ts, F.col("id").cast("string").alias("id"), F.last("mid", ignorenulls=True).over(upto).alias("_mid")).join(moved, [by, ts, "id"], "left").fillna(0.0, ["_q", "_cash"])
    rows = rows.withColumn("holding", F.sum("_q").over(upto)).withColumn("_mid", F.coalesce("_mid", F.lit(0.0)))
    moved = F.coalesce(F.lag("holding").over(w), F.lit(0.0)) * F.coalesce(F.col("_mid") - F.lag("_mid").over(w), F.lit(0.0))
    return rows.select(by, ts, "id", "holding", (moved + F.col("_q") * F.col("_mid") + F.col("_cash")).alias("pnl"))


def hedge_targets(positions: DataFrame, ratios: DataFrame, hedge_dv01: DataFrame, ts: str = "ts") -> DataFrame:
    """Hedge quantities: sum over instruments of position * dv01 * ratio / dv01 of the hedge."""
    rows = positions.join(ratios, [ts, "instrument_id"]).join(hedge_dv01, [ts, "hedge_id"])
    return rows.groupBy(ts, "hedge_id").agg(F.sum(F.col("position") * F.col("dv01") * F.col("ratio") / F.nullif(F.col("hedge_dv01"), F.lit(0.0))).alias("target"))


def frictionless(df: DataFrame, axis: Axis, target: str, price: str, multiplier: float = 1.0) -> DataFrame:
    """Reference path: the target is held from its bar on, at mid, without costs."""
    rows = df.withColumn("step_pnl", F.coalesce(axis.lag(target), F.lit(0.0)) * F.coalesce(F.col(price) - axis.lag(price), F.lit(0.0)) * multiplier)
    rows = rows.withColumn("equity", F.sum("step_pnl").over(axis.frame(None)))
    return rows.withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(axis.frame(None)))).withColumn("drawdown", F.col("peak") - F.col("equity"))


def limit_positions(df: DataFrame, by: Sequence[str], target: str, dv01: str | None = None, max_leg: float | None = None, max_gross: float | None = None, max_net: float | None = None, action: str = "CLIP") -> DataFrame:
    """``limited`` targets: on a breach of gross or net, clip (legs, then gross, then net), flatten, or keep as asked (REJECT)."""
    w = Window.partitionBy(*by)
    unit = F.col(dv01) if dv01 else F.lit(1.0)
    x = F.col(target)
    gross, net = F.sum(F.abs(x * unit)).over(w), F.abs(F.sum(x * unit).over(w))
    breach = F.lit(False)
    if max_gross is not None:
        breach = breach | (gross > max_gross)
    if max_net is not None:
        breach = breach | (net > max_net)
    rows = df.withColumn("breach", breach)
    if action == "FLATTEN":
        return rows.withColumn("limited", F.when(F.col("breach"), 0.0).otherwise(x))
    if action == "REJECT":
        return rows.withColumn("limited", x)
    legs = x if max_leg is None else F.greatest(F.lit(-max_leg), F.least(F.lit(max_leg), x))
    rows = rows.withColumn("limited", legs)
    for total, most in ((F.sum(F.abs(F.col("limited") * unit)).over(w), max_gross), (F.abs(F.sum(F.col("limited") * unit).over(w)), max_net)):
        if most is not None:
            rows = rows.withColumn("_t", total).withColumn("limited", F.col("limited") * F.when(F.col("_t") > most, most / F.nullif(F.col("_t"), F.lit(0.0))).otherwise(1.0)).drop("_t")
    return rows
