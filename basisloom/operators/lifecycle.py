"""Position managers and overlays: who may hold what, for how long, and when to stop."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import Axis

HELD, TIME, STOP, EXIT, MISSING, FLIP, ILLIQUID = range(7)


@dataclass(frozen=True)
class ManagerRule:
    """Entry and exit levels of a score; ``follow`` holds with its sign (momentum), else against it (reversion)."""

    entry: float = 2.0
    exit: float = 0.5
    stop: float | None = 4.0
    max_hold: int | None = None
    follow: bool = False


def managed_positions(df: DataFrame, axis: Axis, score: str, rule: ManagerRule = ManagerRule()) -> DataFrame:
    """``position``, ``held`` and ``why`` per series.

    Per row, in this order: a missing score flattens; then time, stop, exit (for a
    following manager a change of sign stops); then an entry from flat.
    """

    def step(rows: pd.DataFrame) -> dict:
        s = rows[score].to_numpy(float, na_value=np.nan)
        pos, held, why = np.zeros(len(s), np.int32), np.zeros(len(s), np.int32), np.zeros(len(s), np.int32)
        side = age = 0
        for i, x in enumerate(s):
            code = HELD
            if side:
                age += 1
                lean = x * side if rule.follow else -x * side
                if math.isnan(x):
                    code = MISSING
                elif rule.max_hold is not None and age >= rule.max_hold:
                    code = TIME
                elif rule.follow and lean < 0:
                    code = FLIP
                elif not rule.follow and rule.stop is not None and lean >= rule.stop:
                    code = STOP
                elif lean <= rule.exit:
                    code = EXIT
                if code:
                    side = age = 0
            elif abs(x) >= rule.entry:
                side = int(math.copysign(1, x)) * (1 if rule.follow else -1)
            pos[i], held[i], why[i] = side, age, code
        return {"position": pos, "held": held, "why": why}

    return axis.fold(df, step, "position int, held int, why int")


@dataclass(frozen=True)
class OverlayRule:
    """Loss and drawdown stops on equity, with a cooldown before the next entry."""

    max_loss: float | None = None
    max_drawdown: float | None = None
    cooldown: int = 0


def governed(df: DataFrame, axis: Axis, desired: str, equity: str, feasible: str, rule: OverlayRule = OverlayRule()) -> DataFrame:
    """``allowed``: the desired position while no stop is hit; entries and exits wait for liquidity (``feasible``)."""

    def step(rows: pd.DataFrame) -> dict:
        out, why = np.zeros(len(rows)), np.zeros(len(rows), np.int32)
        held = peak = start = 0.0
        wait = 0
        for i, (want, worth, ok) in enumerate(zip(rows[desired].fillna(0.0), rows[equity].fillna(0.0), rows[feasible].fillna(False), strict=True)):
            peak = max(peak, worth)
            if held:
                loss = rule.max_loss is not None and start - worth >= rule.max_loss
                fall = rule.max_drawdown is not None and peak - worth >= rule.max_drawdown
                if loss or fall:
                    want, why[i], wait = 0.0, STOP, rule.cooldown
            elif wait:
                want, wait = 0.0, wait - 1
            if want != held and not ok:
                want, why[i] = held, ILLIQUID
            if want and not held:
                start = peak = worth
            held = want
            out[i] = held
        return {"allowed": out, "overlay": why}

    return axis.fold(df, step, "allowed double, overlay int")


def basket_feasible(trades: Column, depth: Column, haircut: float = 1.0) -> Column:
    """Whether every leg's trade fits its depth after the haircut (arrays of equal length)."""
    return F.forall(F.zip_with(trades, depth, lambda q, d: F.abs(q) <= d * haircut + 1e-12), lambda x: F.coalesce(x, F.lit(False)))


def time_stop(position: Column, held: Column, most: int) -> Column:
    return (position != 0) & (held >= most)
