"""End-to-end compositions: panel to structures to signals to backtests, over many structures and parameters at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import Axis, zscore
from ..operators import metrics, selection, signals, structures


def structure_values(panel: DataFrame, flies: DataFrame, ts: str, key: str, ttm: str, value: str, max_deviation: float | None = 1.0) -> DataFrame:
    """(fly, ts, front, belly, back, fly_value) for every row (fly, front, belly, back tenors) of ``flies``.

    Per stamp and tenor the nearest key is found once, whatever number of
    structures use the tenor; structures then join three rows each.
    """
    tenors = flies.select(F.explode(F.array("front", "belly", "back")).alias("tenor")).distinct()
    near = panel.join(F.broadcast(tenors), F.abs(F.col(ttm) - F.col("tenor")) <= (max_deviation if max_deviation is not None else 1e9))
    dev = F.struct(F.abs(F.col(ttm) - F.col("tenor")), F.col(key))
    at = near.groupBy(ts, "tenor").agg(F.min_by(value, dev).alias("v"))
    out = None
    for leg in structures.LEGS:
        side = flies.select("fly", F.col(leg).alias("tenor")).join(at, "tenor").select("fly", ts, F.col("v").alias(leg))
        out = side if out is None else out.join(side, ["fly", ts])
    return out.withColumn("fly_value", F.col("front") - 2 * F.col("belly") + F.col("back"))


def many_structures(panel: DataFrame, flies: DataFrame, params: Sequence[Mapping[str, float]], ts: str, key: str, ttm: str, value: str, cost: float = 0.0, year: float = 252) -> DataFrame:
    """One row per structure and parameter set with its metrics, ranked by Sharpe.

    The rolling score is computed once per window; the state machines of all
    parameter sets run in the same pass over a series.
    """
    values = structure_values(panel, flies, ts, key, ttm, value)
    out = None
    for i, p in enumerate(params):
        rule = signals.ReversionRule(p.get("entry", 2.0), p.get("exit", 0.5), p.get("stop", 4.0), p.get("max_hold"))
        axis = Axis((ts,), ("fly",))
        rows = values.withColumn("z", zscore(axis, "fly_value", int(p.get("window", 20)), clip=4.0))
        rows = signals.mean_reversion_signal(rows, axis, "z", rule)
        rows = signals.signal_backtest(rows, axis, "signal", "fly_value", cost)
        m = rows.groupBy("fly").agg(F.count(F.lit(1)).alias("bars"), F.sum("pnl").alias("pnl"), metrics.sharpe(F.col("pnl"), year).alias("sharpe"), F.sum((F.col("exit_reason") != 0).cast("int")).alias("exits")).withColumn("params", F.lit(i))
        out = m if out is None else out.unionByName(m)
    plan = selection.RankingPlan(((("sharpe", 1.0, True),), (("pnl", 1.0, True),)))
    ranked = selection.rank_scenarios(out.withColumn("scenario", F.concat_ws("/", "fly", F.col("params").cast("string"))), plan, "scenario")
    return ranked.select("rank", "fly", "params", "bars", "pnl", "sharpe", "exits")
