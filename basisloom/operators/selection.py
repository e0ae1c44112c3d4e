"""Ranking, nearest-key selection and staged scenario ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _nearest(dev: Column, tie: str, value: Column) -> Column:
    return F.min_by(value, F.struct(dev, F.col(tie)))


def nearest_to_tenor(df: DataFrame, tenor: float, ts: str = "datetime", key: str = "bond_id", ttm: str = "ttm_years", max_deviation: float | None = None) -> DataFrame:
    """Per stamp the key whose maturity is nearest to ``tenor`` (ties by key); null beyond the deviation."""
    return select_legs(df, {"leg": tenor}, ts, key, ttm, max_deviation)


def select_legs(df: DataFrame, tenors: Mapping[str, float], ts: str = "datetime", key: str = "bond_id", ttm: str = "ttm_years", max_deviation: float | None = None) -> DataFrame:
    """Per stamp one nearest key per named tenor, all in one aggregation: ``<leg>_id``, ``<leg>_ttm``."""
    rows = df.where(F.col(ttm).isNotNull())
    aggs = []
    for leg, tenor in tenors.items():
        dev = F.abs(F.col(ttm) - tenor)
        aggs.append(_nearest(dev, key, F.struct(F.col(key).alias("id"), F.col(ttm).alias("ttm"), dev.alias("dev"))).alias(leg))
    out = rows.groupBy(ts).agg(*aggs)
    near = {leg: F.lit(True) if max_deviation is None else F.col(f"{leg}.dev") <= max_deviation for leg in tenors}
    return out.select(ts, *(x for leg in tenors for x in (F.when(near[leg], F.col(f"{leg}.id")).alias(f"{leg}_id"), F.when(near[leg], F.col(f"{leg}.ttm")).alias(f"{leg}_ttm"))))


def nearest_three(df: DataFrame, center: float = 5.0, window: float = 3.0, ts: str = "datetime", key: str = "bond_id", ttm: str = "ttm_years", require_distinct: bool = True) -> DataFrame:
    """The three keys nearest to ``center`` within the window, in order of maturity; nulls if there are fewer than three."""
    dev = F.abs(F.col(ttm) - center)
    place = F.row_number().over(Window.partitionBy(ts).orderBy(dev, key))
    best = df.where(dev <= window).withColumn("_p", place).where("_p <= 3")
    legs = best.groupBy(ts).agg(F.sort_array(F.collect_list(F.struct(F.col(ttm).alias("ttm"), F.col(key).alias("id")))).alias("l"))
    full = F.size("l") == 3 if require_distinct else F.size("l") > 0
    stamps = df.select(ts).distinct()
    return stamps.join(legs, ts, "left").select(ts, *(F.when(full, F.get("l", F.lit(i))["id"]).alias(f"{n}_id") for i, n in enumerate(("front", "belly", "back"))))


def daily_legs(df: DataFrame, tenors: Mapping[str, float], at_second: int, ts: str = "datetime", key: str = "bond_id", ttm: str = "ttm_years", max_deviation: float = 1.0, tolerance_minutes: int = 30, carry: bool = True) -> DataFrame:
    """Per date the legs at the bar nearest to a time of day (within the tolerance); missing days take the day before's."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    rows = df.withColumn("trading_date", F.to_date(ts)).withColumn("_off", F.abs(seconds - at_second))
    bar = rows.groupBy("trading_date").agg(F.min_by(ts, F.struct("_off", F.col(ts))).alias("_bar"), F.min("_off").alias("_best"))
    bar = bar.withColumn("_bar", F.when(F.col("_best") <= tolerance_minutes * 60, F.col("_bar")))
    at_bar = df.withColumn("trading_date", F.to_date(ts)).join(bar.select("trading_date", "_bar"), "trading_date").where(F.col(ts) == F.col("_bar"))
    legs = select_legs(at_bar, tenors, "trading_date", key, ttm, max_deviation)
    out = bar.select("trading_date").join(legs, "trading_date", "left")
    if not carry:
        return out
    w = Window.orderBy("trading_date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    return out.select("trading_date", *(F.last(f"{leg}_id", ignorenulls=True).over(w).alias(f"{leg}_id") for leg in tenors))


def leg_values(df: DataFrame, legs: DataFrame, names: Sequence[str], values: Sequence[str], ts: str = "datetime", key: str = "bond_id") -> DataFrame:
    """``legs`` with the values of each leg's key at its stamp: one join and a conditional aggregate, not one join per leg."""
    ids = legs.select(ts, F.explode(F.array(*(F.struct(F.lit(n).alias("leg"), F.col(f"{n}_id").alias(key)) for n in names))).alias("_l")).select(ts, "_l.*")
    found = ids.join(df.select(ts, key, *values), [ts, key], "left")
    wide = found.groupBy(ts).agg(*(F.first(F.when(F.col("leg") == n, F.col(v)), ignorenulls=True).alias(f"{n}_{v}") for n in names for v in values))
    return legs.join(wide, ts, "left")


def leg_stability(df: DataFrame, names: Sequence[str], ts: str = "datetime") -> DataFrame:
    """Per date: bars, distinct ids of each leg, and whether no leg changes."""
    out = df.groupBy(F.to_date(ts).alias("trading_date")).agg(F.count(F.lit(1)).alias("bars"), *(F.countDistinct(f"{n}_id").alias(f"{n}_ids") for n in names))
    stable = F.lit(True)
    for n in names:
        stable = stable & (F.col(f"{n}_ids") <= 1)
    return out.withColumn("stable", stable)


def top_k(df: DataFrame, by: Sequence[str], score: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The k best rows of each key; ties in order of ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), *tie)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def average_rank(c: Column, by: Sequence[Column | str] = ()) -> Column:
    """1-based rank, ties sharing their mean."""
    place = F.rank().over(Window.partitionBy(*by).orderBy(c))
    return place + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2


@dataclass(frozen=True)
class RankingPlan:
    """Stages of (column, weight, higher_is_better); earlier stages outrank later ones."""

    stages: tuple[tuple[tuple[str, float, bool], ...], ...] = field(default_factory=tuple)


def stage_score(features: Sequence[tuple[str, float, bool]], columns: Sequence[str], by: Sequence[str] = ()) -> Column:
    """Weighted sum of ranks scaled to 0..1; columns that are missing are skipped."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    score = F.lit(0.0)
    for name, weight, high in features:
        if name in columns:
            c = F.col(name) if high else -F.col(name)
            score = score + weight * F.when(n > 1, (average_rank(c, by) - 1) / F.nullif((n - 1).cast("double"), F.lit(0.0))).otherwise(0.0)
    return score


def rank_scenarios(df: DataFrame, plan: RankingPlan, index: str = "scenario", by: Sequence[str] = ()) -> DataFrame:
    """``rank`` by the stages' scores, descending in turn, then by index."""
    names = []
    for i, features in enumerate(plan.stages):
        names.append(f"score_{i + 1}")
        df = df.withColumn(names[-1], stage_score(features, df.columns, by))
    w = Window.partitionBy(*by).orderBy(*(F.round(F.col(n), 12).desc() for n in names), index)
    return df.withColumn("rank", F.row_number().over(w))


def leaderboard(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], score: str, top: int, ref: str | None = None, per_ref: int = 10, index: str = "scenario") -> DataFrame:
    """Mean metrics per parameter tuple (nulls are a value), over each reference's best rows, ranked."""
    if ref:
        df = top_k(df, [ref], score, per_ref, [index]).drop("place")
    out = df.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in metrics), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), *(F.col(k).asc_nulls_last() for k in keys)))
    return out.withColumn("rank", place).where(F.col("rank") <= top)


def mean_of_means(df: DataFrame, ref: str, metrics: Sequence[str], score: str | None = None, top: int | None = None, index: str = "scenario") -> DataFrame:
    """Mean per reference (over its best rows, if ``top``), then the mean over references."""
    if top is not None:
        df = top_k(df, [ref], score, top, [index])
    return df.groupBy(ref).agg(*(F.avg(m).alias(m) for m in metrics)).agg(*(F.avg(m).alias(m) for m in metrics), F.count(F.lit(1)).alias("refs"))
