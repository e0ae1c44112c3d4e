"""Parameter sweeps: grids as tables, scenarios in parallel, ranked in two passes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import fields, is_dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.panels import read_run, write_run
from . import selection

PRESETS = {"FAST": {"levels": 1, "haircut": 1.0, "cost_gate": False}, "REALISTIC": {"levels": 5, "haircut": 0.5, "cost_gate": True}, "STRESS": {"levels": 3, "haircut": 0.25, "cost_gate": True}}


def grid(spark: SparkSession, values: Mapping[str, Sequence], base: Mapping | None = None, prefix: str = "sweep") -> DataFrame:
    """One row per combination: scenario (from 0, first parameter slowest), name, and all parameters."""
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in (base or {}).items() if k not in values), *(F.array(*(F.lit(x) for x in v)).alias(k) for k, v in values.items()))
    index, size = F.lit(0).cast("long"), 1
    for k, v in values.items():
        frame = frame.select("*", F.posexplode(k).alias(f"_i_{k}", f"_v_{k}"))
        index, size = index * len(v) + F.col(f"_i_{k}"), size * len(v)
    keep = [k for k in (base or {}) if k not in values]
    out = frame.select(index.alias("scenario"), *keep, *(F.col(f"_v_{k}").alias(k) for k in values))
    return out.withColumn("name", F.concat(F.lit(f"{prefix}_"), F.lpad(F.col("scenario").cast("string"), len(str(max(size - 1, 1))), "0")))


def patched(config, changes: Mapping[str, object]):
    """A frozen config with dotted paths replaced; unknown paths are errors."""
    for path, value in changes.items():
        head, _, rest = path.partition(".")
        if not is_dataclass(config) or head not in {f.name for f in fields(config)}:
            raise KeyError(path)
        config = replace(config, **{head: patched(getattr(config, head), {rest: value}) if rest else value})
    return config


def run_sweep(scenarios: DataFrame, run: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], top: int = 10, key: str = "scenario") -> tuple[DataFrame, DataFrame]:
    """(score of every scenario, full result of the best): the second pass runs the best ones only."""
    scored = score(run(scenarios))
    best = scored.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), key))).where(F.col("rank") <= top)
    return scored, run(scenarios.join(best.select(key), key, "left_semi"))


def configured_sweep(spark: SparkSession, config: Mapping, run: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], folder: str | None = None) -> dict[str, DataFrame]:
    """The sweep that a configuration names: ``grid``, ``base``, ``preset``, ``name``, ``top`` (unknown names are errors).

    Gives scenarios, summary and best, and writes them with the configuration if a
    folder is named; what is written is read back and not computed again.
    """
    if unknown := set(config) - {"grid", "base", "preset", "name", "top"}:
        raise KeyError(f"unknown settings {sorted(unknown)}")
    base = {**(PRESETS[config["preset"]] if "preset" in config else {}), **config.get("base", {})}
    scenarios = grid(spark, config["grid"], base, config.get("name", "sweep"))
    summary, best = run_sweep(scenarios, run, score, config.get("top", 10))
    tables = {"scenarios": scenarios, "summary": summary, "best": best}
    if folder is not None:
        write_run(spark, folder, tables, config)
        tables = {k: v for k, v in read_run(spark, folder)[0].items() if k in tables}
    return tables


def reference_sweep(scenarios: DataFrame, run: Callable[[DataFrame], DataFrame], ref: str, metrics: Sequence[str], score: str, params: Sequence[str], top: int = 10, key: str = "scenario") -> dict[str, DataFrame]:
    """A sweep over many references at once: ``run`` gives metrics per (scenario, reference).

    summary (ranked within each reference), best (its first row), averages (over each
    reference's ``top`` rows, then over references) and leaderboard (per parameter tuple).
    """
    rows = run(scenarios).join(scenarios.select(key, *params), key)
    place = F.row_number().over(Window.partitionBy(ref).orderBy(F.col(score).desc_nulls_last(), key))
    summary = rows.withColumn("rank", place)
    return {
        "summary": summary, "best": summary.where("rank = 1").drop("rank"), "averages": selection.mean_of_means(rows, ref, metrics, score, top, key),
        "leaderboard": selection.leaderboard(rows, params, metrics, score, top, ref, top, key),
    }


def near_equal_parts(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``part``: contiguous slices of the keys whose sizes differ by one at most, larger ones first."""
    return df.withColumn("part", F.ntile(parts).over(Window.orderBy(key)) - 1)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
