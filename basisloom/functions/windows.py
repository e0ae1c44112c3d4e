"""Leak-safe window expressions over a panel.

An :class:`Axis` names the series key and the total order inside it.  ``shift``
moves a whole frame back, so that with the default of one row no value sees its
own time.  Null is the only missing value: NaN is turned into null on input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec


def clean(c: Column | str) -> Column:
    """A double column whose only missing value is null."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def safe_divide(a: Column, b: Column, floor: float = 0.0) -> Column:
    """a / b, null where |b| <= floor."""
    return F.when(F.abs(b) > floor, a / F.when(b != 0, b))


@dataclass(frozen=True)
class Axis:
    """``by``: series key (an empty key puts the whole table in one partition); ``order``: a total order within it."""

    order: tuple[str, ...]
    by: tuple[str, ...] = ()

    @property
    def spec(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def frame(self, window: int | None, shift: int = 0) -> WindowSpec:
        """The last ``window`` rows (all, if None) up to ``shift`` rows ago."""
        lo = Window.unboundedPreceding if window is None else -(window - 1 + shift)
        return self.spec.rowsBetween(lo, -shift)

    def lag(self, c: Column | str, periods: int = 1, shift: int = 0) -> Column:
        n = periods + shift
        return F.lag(c, n).over(self.spec) if n >= 0 else F.lead(c, -n).over(self.spec)

    def lead(self, c: Column | str, periods: int = 1) -> Column:
        return F.lead(c, periods).over(self.spec)

    def delta(self, c: Column | str, periods: int = 1, shift: int = 1) -> Column:
        return self.lag(c, 0, shift) - self.lag(c, periods, shift)

    def ratio(self, c: Column | str, periods: int = 1, shift: int = 1) -> Column:
        return self.lag(c, 0, shift) / F.nullif(self.lag(c, periods, shift), F.lit(0.0))

    def pct_change(self, c: Column | str, periods: int = 1, shift: int = 1) -> Column:
        return self.ratio(c, periods, shift) - 1

    def rolling(self, how: Callable[[Column], Column], c: Column | str, window: int | None, min_periods: int | None = None, shift: int = 1) -> Column:
        """``how`` over the frame where it has at least ``min_periods`` values (default: the window)."""
        c = F.col(c) if isinstance(c, str) else c
        w = self.frame(window, shift)
        need = min_periods if min_periods is not None else (window or 1)
        return F.when(F.count(c).over(w) >= need, how(c).over(w))

    def mean(self, c, window, min_periods=None, shift=1) -> Column:
        return self.rolling(F.avg, c, window, min_periods, shift)

    def std(self, c, window, min_periods=None, shift=1) -> Column:
        return self.rolling(F.stddev_samp, c, window, min_periods, shift)

    def sum(self, c, window, min_periods=None, shift=1) -> Column:
        return self.rolling(F.sum, c, window, min_periods, shift)

    def min(self, c, window, min_periods=None, shift=1) -> Column:
        return self.rolling(F.min, c, window, min_periods, shift)

    def max(self, c, window, min_periods=None, shift=1) -> Column:
        return self.rolling(F.max, c, window, min_periods, shift)

    def median(self, c, window, min_periods=None, shift=1) -> Column:
        return self.rolling(lambda x: F.percentile(x, F.lit(0.5)), c, window, min_periods, shift)

    def filled(self, c: Column | str) -> Column:
        """The last value that is not null."""
        return F.last(c, ignorenulls=True).over(self.frame(None))

    def fold(self, df: DataFrame, step: Callable[..., pd.DataFrame | dict], added: str, together: bool = False) -> DataFrame:
        """Append the columns ``added`` (DDL) that ``step`` computes from one series in order.

        With ``together`` it is given all complete series of a batch, one after
        another, and their edges: step(rows, edges).

        For recurrences that no frame expresses.  Series are dealt out by key and
        sorted; a task streams through them and holds one at a time, so that many
        short series cost one pass and not one call each.
        """
        schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])
        by, names = list(self.by), [f.name for f in schema.fields]

        def whole(rows: pd.DataFrame) -> pd.DataFrame:
            edge = np.append(np.flatnonzero(_starts(rows, by)), len(rows))
            if together:
                return rows.reset_index(drop=True).assign(**step(rows, edge))[names]
            made = [step(rows.iloc[a:b].reset_index(drop=True)) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            extra = {c: np.concatenate([np.asarray(m[c]) for m in made]) for c in made[0]}
            return rows.reset_index(drop=True).assign(**extra)[names]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for batch in batches:
                rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
                cut = int(np.flatnonzero(_starts(rows, by))[-1]) if len(rows) else 0
                held = rows.iloc[cut:]
                if cut:
                    yield whole(rows.iloc[:cut])
            if held is not None and len(held):
                yield whole(held)

        dealt = df.repartition(*by) if by else df.coalesce(1)
        return dealt.sortWithinPartitions(*by, *self.order).mapInPandas(run, schema)


def _starts(rows: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Whether each row begins a new series of rows sorted by key."""
    out = np.zeros(len(rows), bool)
    out[:1] = True
    for c in by:
        codes = pd.factorize(rows[c])[0]
        out[1:] |= codes[1:] != codes[:-1]
    return out


def ewma(axis: Axis, df: DataFrame, c: str, out: str, span: float | None = None, halflife: float | None = None, alpha: float | None = None, min_periods: int = 1, shift: int = 1, adjust: bool = True) -> DataFrame:
    """Exponentially weighted mean of the shifted series; exactly one of span, halflife and alpha."""
    if sum(x is not None for x in (span, halflife, alpha)) != 1:
        raise ValueError("give exactly one of span, halflife and alpha")

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[c].astype(float).shift(shift)
        return pd.DataFrame({out: x.ewm(span=span, halflife=halflife, alpha=alpha, min_periods=min_periods, adjust=adjust).mean()})

    return axis.fold(df, step, f"`{out}` double")


def zscore(axis: Axis, c: Column | str, window: int, min_periods: int | None = None, shift: int = 0, eps: float = 1e-12, clip: float | None = None) -> Column:
    """(x - mean) / max(std, eps) over the frame, clipped on demand."""
    c = F.col(c) if isinstance(c, str) else c
    z = (c - axis.mean(c, window, min_periods, shift)) / F.greatest(axis.std(c, window, min_periods, shift), F.lit(eps))
    return clipped(z, clip)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _middle(ordered: Column) -> Column:
    """The median of a sorted array."""
    last = F.size(ordered) - 1
    half = F.shiftright(last, 1)
    return (F.get(ordered, half) + F.get(ordered, last - half)) / 2


def robust_zscore(axis: Axis, c: Column | str, window: int, min_periods: int | None = None, eps: float = 1e-12, clip: float | None = None) -> Column:
    """(x - median) / max(1.4826 * MAD, eps), the deviations taken from the frame's own median.

    Both medians come from one list of the frame's values, sorted once.
    """
    c = F.col(c) if isinstance(c, str) else c
    w = axis.frame(window)
    need = min_periods if min_periods is not None else window

    def score(values: Column) -> Column:
        deviations = _let(_middle(values), lambda mid: F.array_sort(F.transform(values, lambda v: F.abs(v - mid))))
        return (c - _middle(values)) / F.greatest(1.4826 * _let(deviations, _middle), F.lit(eps))

    z = F.when(F.count(c).over(w) >= need, _let(F.array_sort(F.collect_list(c).over(w)), score))
    return clipped(z, clip)


def clipped(c: Column, limit: float | None) -> Column:
    return c if limit is None else F.when(c.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), c)))


def cross_rank(c: Column | str, by: Iterable[str], pct: bool = True) -> Column:
    """Average-tie rank of the non-null values within a date, as a share of their number on demand."""
    c = F.col(c) if isinstance(c, str) else c
    by = list(by)
    # nulls get ranks of their own, after the others
    place = F.rank().over(Window.partitionBy(*by).orderBy(c.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    rank = place + (ties - 1) / 2
    return F.when(c.isNotNull(), rank / F.count(c).over(Window.partitionBy(*by)) if pct else rank)


def cross_zscore(c: Column | str, by: Iterable[str]) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    w = Window.partitionBy(*by)
    return safe_divide(c - F.avg(c).over(w), F.stddev_samp(c).over(w))


def cross_demean(c: Column | str, by: Iterable[str]) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c - F.avg(c).over(Window.partitionBy(*by))


def pair_features(axis: Axis, a: str, b: str, window: int, shift: int = 1, epsilon: float = 1e-10) -> dict[str, Column]:
    """Difference, ratio, log ratio and relative strength of two aligned series."""
    la, lb = axis.lag(a, 0, shift), axis.lag(b, 0, shift)
    return {
        "diff": la - lb,
        "ratio": la / (lb + epsilon),
        "log_ratio": F.log((la + epsilon) / (lb + epsilon)),
        "relative_strength": safe_divide(axis.mean(a, window, shift=shift), axis.mean(b, window, shift=shift)),
    }


def forward_targets(axis: Axis, c: str, horizons: Iterable[int], method: str = "change", prefix: str = "target") -> dict[str, Column]:
    """One look-ahead column per horizon: change, return or log_return."""
    made = {}
    for h in horizons:
        ahead = axis.lead(c, h)
        if method == "change":
            made[f"{prefix}_{h}"] = ahead - F.col(c)
        elif method == "return":
            made[f"{prefix}_{h}"] = ahead / F.nullif(F.col(c), F.lit(0.0)) - 1
        elif method == "log_return":
            made[f"{prefix}_{h}"] = F.when((ahead > 0) & (F.col(c) > 0), F.log(ahead / F.col(c)))
        else:
            raise ValueError(f"unknown method {method}")
    return made


def forward_direction(axis: Axis, c: str, horizon: int = 1) -> Column:
    """1 where the value rises over the horizon, else 0; without a future, 0."""
    return F.coalesce((axis.lead(c, horizon) > F.col(c)).cast("int"), F.lit(0))
