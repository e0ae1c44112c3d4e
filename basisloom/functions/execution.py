"""Order books, fills, sizes, limits, costs and funding, as expressions on one row.

A book side is ``array<struct<px double, sz double>>``, best level first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reject reasons of a fill.
OK, NO_DEPTH, PARTIAL_REJECTED, ZERO_QTY = 0, 1, 2, 3


def walk_book(levels: Column, qty: Column, max_levels: int = 1 << 30, haircut: float = 1.0) -> Column:
    """struct<filled, notional, levels_used>: take ``haircut`` of each level's size until qty is met; bad levels are skipped."""
    zero = F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("notional"), F.lit(0).alias("levels_used"))

    def take(acc: Column, x: Column) -> Column:
        ok = (x["px"] > 0) & (x["sz"] > 0) & ~F.isnan(x["px"]) & ~F.isnan(x["sz"])
        got = F.when(ok, F.least(qty - acc["filled"], x["sz"] * haircut)).otherwise(0.0)
        got = F.greatest(F.coalesce(got, F.lit(0.0)), F.lit(0.0))
        return F.struct((acc["filled"] + got).alias("filled"), (acc["notional"] + got * F.coalesce(x["px"], F.lit(0.0))).alias("notional"), (acc["levels_used"] + F.when(got > 0, 1).otherwise(0)).alias("levels_used"))

    return F.aggregate(F.slice(levels, 1, max_levels), zero, take)


def vwap(walk: Column) -> Column:
    return F.when(walk["filled"] > 0, walk["notional"] / F.nullif(walk["filled"], F.lit(0.0)))


def walk_fill(side: Column, qty: Column, bid: Column, ask: Column, max_levels: int = 1 << 30, haircut: float = 1.0, allow_partial: bool = True, reject_if_short: bool = False) -> Column:
    """struct<filled, px, reason>: a buy (side > 0) walks the asks, a sell the bids."""
    w = walk_book(F.when(side > 0, ask).otherwise(bid), qty, max_levels, haircut)
    short = w["filled"] < qty - 1e-12
    refused = short & F.lit(reject_if_short or not allow_partial)
    reason = F.when(qty <= 0, ZERO_QTY).when(w["filled"] <= 0, NO_DEPTH).when(refused, PARTIAL_REJECTED).otherwise(OK)
    filled = F.when(reason == OK, w["filled"]).otherwise(0.0)
    return F.struct(filled.alias("filled"), F.when(reason == OK, vwap(w)).alias("px"), reason.alias("reason"))


def top_fill(side: Column, qty: Column, bid: Column, ask: Column, haircut: float = 1.0, allow_partial: bool = True) -> Column:
    """A fill at the best level only."""
    return walk_fill(side, qty, bid, ask, 1, haircut, allow_partial)


def book_valid(bid0: Column, ask0: Column, mid: Column) -> Column:
    """Positive prices with bid <= mid <= ask; missing values fail."""
    return F.coalesce((bid0 > 0) & (ask0 > 0) & (mid > 0) & (bid0 <= mid) & (mid <= ask0), F.lit(False))


def round_size(q: Column, min_size: float = 0.0, step: float = 0.0, lot: float = 0.0) -> Column:
    """Zero below the minimum, then half-to-even to the step and to the lot."""
    out = F.when(F.abs(q) < min_size, 0.0).otherwise(q)
    for unit in (step, lot):
        if unit > 0:
            out = F.bround(out / unit, 0) * unit
    return out


def participation_cap(q: Column, cap: float, volume: Column, adv: Column, allow_partial: bool = True) -> Column:
    """struct<qty, capped>: at most ``cap`` of the bar's volume (else of the daily volume)."""
    liquid = F.when(volume > 0, volume).otherwise(adv)
    most = F.coalesce(liquid, F.lit(0.0)) * cap
    over = F.abs(q) > most
    kept = F.when(~over, q).otherwise(F.signum(q) * most if allow_partial else F.lit(0.0))
    return F.struct(kept.alias("qty"), over.alias("capped"))


def impact_price(px: Column, qty: Column, side: Column, k_bps: float, alpha: float, liquidity: Column) -> Column:
    """Price moved against the trade by k * (qty / liquidity) ** alpha basis points."""
    share = F.abs(qty) / F.when(liquidity > 0, liquidity)
    return px * (1 + F.signum(side) * F.coalesce(k_bps * F.pow(share, F.lit(alpha)), F.lit(0.0)) / 1e4)


def fees(qty: Column, px: Column, multiplier: float, fee_bps: float, per_unit: float = 0.0) -> Column:
    """Cash paid in fees (never positive)."""
    return -(F.abs(qty) * px * multiplier * fee_bps / 1e4 + F.abs(qty) * per_unit)


def mid(bid0: Column, ask0: Column) -> Column:
    return (bid0 + ask0) * 0.5


def mark(source: str, bid0: Column, ask0: Column, last: Column, external: Column) -> Column:
    choice = {"MID": mid(bid0, ask0), "LAST": last, "EXTERNAL": external}
    if source not in choice:
        raise ValueError(f"mark source must be one of {sorted(choice)}")
    return choice[source]


def interest(cash: Column, rate: Column, years: Column) -> Column:
    return cash * rate * years


def coupon(position: Column, rate: Column, accrual: Column, multiplier: float = 1.0) -> Column:
    """Coupon of one leg; a position's is the sum over its legs."""
    return position * rate * accrual * multiplier


def repo_cost(position: Column, px: Column, repo: Column, borrow_bps: Column, years: Column, multiplier: float = 1.0) -> Column:
    """Funding of longs at repo and of shorts at repo plus the borrow spread (never positive for positive rates)."""
    value = position * px * multiplier
    long_, short = F.greatest(value, F.lit(0.0)), F.greatest(-value, F.lit(0.0))
    return -(long_ * repo + short * (repo + borrow_bps / 1e4)) * years


def clip(x: Column, limit: Column | float) -> Column:
    limit = limit if isinstance(limit, Column) else F.lit(float(limit))
    return F.greatest(-limit, F.least(limit, x))


def scale_to(value: Column, total: Column, most: float | None) -> Column:
    """value times min(1, most / total)."""
    return value if most is None else value * F.when(total > most, most / F.nullif(total, F.lit(0.0))).otherwise(1.0)


def drawdown_scale(equity: Column, peak: Column, limit: float, mode: str = "FLATTEN") -> Column:
    """1 within the limit; beyond it 0, or falling linearly to 0 at twice the limit."""
    dd = (peak - equity) / F.when(peak > 0, peak)
    beyond = F.coalesce(dd > limit, F.lit(False))
    if mode == "FLATTEN":
        return F.when(beyond, 0.0).otherwise(1.0)
    if mode == "LINEAR":
        return F.when(beyond, F.greatest(F.lit(0.0), 1 - (dd - limit) / limit)).otherwise(1.0)
    raise ValueError(f"unknown mode {mode}")
