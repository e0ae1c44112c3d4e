"""Calendar and trading-session expressions.

Instants are timestamps read in the session time zone; ``tz`` is the exchange's
zone.  With ``aware=False`` a stamp already is local time.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERIODS = {"day_of_week": (7, 0), "day_of_month": (31, 1), "month": (12, 1), "hour": (24, 0), "quarter": (4, 1), "week_of_year": (52, 1)}


def seconds_of(text: str) -> int:
    """"HH:MM" or "HH:MM:SS" as seconds of the day."""
    m = re.fullmatch(r"(\d{1,2}):(\d{2})(?::(\d{2}))?", text)
    if not m or int(m[1]) > 23 or int(m[2]) > 59 or int(m[3] or 0) > 59:
        raise ValueError(f"not a time of day: {text!r}")
    return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3] or 0)


def local(ts: Column, tz: str | None, aware: bool = True) -> Column:
    return F.from_utc_timestamp(ts, tz) if tz and aware else ts


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def in_session(ts: Column, start: str = "07:30", end: str = "17:00", tz: str | None = None) -> Column:
    """Local time of day within [start, end], both ends included (to the microsecond)."""
    t = local(ts.cast("timestamp"), tz)
    day = F.date_trunc("day", t)
    micros = F.unix_micros(t) - F.unix_micros(day)
    return micros.between(seconds_of(start) * 1_000_000, seconds_of(end) * 1_000_000)


def trading_date(ts: Column, session_start: str = "07:30", tz: str | None = None) -> Column:
    """Local date; before the session start still the day before."""
    t = local(ts, tz)
    return F.when(second_of_day(t) < seconds_of(session_start), F.date_sub(F.to_date(t), 1)).otherwise(F.to_date(t))


def time_features(ts: Column, hour: bool = False) -> dict[str, Column]:
    """Calendar parts; Monday is 0 and weeks are ISO weeks."""
    parts = {"day_of_week": F.weekday(ts), "day_of_month": F.dayofmonth(ts), "month": F.month(ts), "quarter": F.quarter(ts), "week_of_year": F.weekofyear(ts)}
    return parts | ({"hour": F.hour(ts)} if hour else {})


def cyclical(ts: Column, component: str = "day_of_week") -> dict[str, Column]:
    """Sine and cosine of a calendar part's place in its period."""
    if component not in PERIODS:
        raise ValueError(f"component must be one of {sorted(PERIODS)}")
    period, first = PERIODS[component]
    angle = (time_features(ts, hour=True)[component] - first) * (2 * math.pi / period)
    return {f"{component}_sin": F.sin(angle), f"{component}_cos": F.cos(angle)}


def session_flags(df: DataFrame, ts: str, start: str = "07:30", end: str = "17:00", tz: str | None = None, tie: tuple[str, ...] = ()) -> DataFrame:
    """is_session, trading_date, and the first and last session row of each date (ties by ``tie``)."""
    inside = in_session(F.col(ts), start, end, tz)
    df = df.withColumn("is_session", inside).withColumn("trading_date", F.to_date(local(F.col(ts), tz)))
    day = Window.partitionBy("trading_date", "is_session")
    first = F.row_number().over(day.orderBy(F.col(ts), *tie)) == 1
    last = F.row_number().over(day.orderBy(F.col(ts).desc(), *tie)) == 1
    return df.withColumn("is_open_bar", F.col("is_session") & first).withColumn("is_close_bar", F.col("is_session") & last)


def rebalance_bar(df: DataFrame, mode: str = "open_only", n_bars: int = 1, ts: str = "datetime", tie: tuple[str, ...] = ()) -> DataFrame:
    """``rebalance``: open_only, close_only, every_bar, or every_n_bars counted over all session bars.

    The count over all days is a count per day plus the days before, so that no
    single partition has to hold every bar.
    """
    if mode == "open_only":
        return df.withColumn("rebalance", F.col("is_open_bar"))
    if mode == "close_only":
        return df.withColumn("rebalance", F.col("is_close_bar"))
    if mode == "every_bar":
        return df.withColumn("rebalance", F.col("is_session"))
    if mode != "every_n_bars":
        raise ValueError(f"unknown mode {mode}")
    per_day = df.where("is_session").groupBy("trading_date").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("trading_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_day = per_day.select("trading_date", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("trading_date", "is_session").orderBy(ts, *tie))
    out = df.withColumn("_place", place).join(per_day, "trading_date", "left")
    hit = F.col("is_session") & (F.pmod(F.col("_before") + F.col("_place") - 1, F.lit(n_bars)) == 0)
    return out.withColumn("rebalance", F.coalesce(hit, F.lit(False))).drop("_place", "_before")


def session_boundaries(df: DataFrame, ts: str, start: str = "07:30", end: str = "17:00", tz: str | None = None) -> DataFrame:
    """First and last session stamp of each trading date."""
    rows = df.where(in_session(F.col(ts), start, end, tz)).withColumn("trading_date", F.to_date(local(F.col(ts), tz)))
    return rows.groupBy("trading_date").agg(F.min(ts).alias("session_open"), F.max(ts).alias("session_close"))
