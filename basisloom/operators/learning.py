"""Preparing, splitting, fitting, calibrating and scoring: column statistics and MLlib, no matrices on the driver."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Roles:
    """Column roles of a supervised table."""

    ts: str
    target: str
    features: tuple[str, ...]
    group: str | None = None

    def check(self, df: DataFrame) -> None:
        wanted = [self.ts, self.target, *self.features, *([self.group] if self.group else [])]
        if missing := [c for c in wanted if c not in df.columns]:
            raise ValueError(f"missing columns {missing}")

    def ordered(self, df: DataFrame) -> DataFrame:
        return df.orderBy(*([self.group] if self.group else []), self.ts)

    def between(self, df: DataFrame, start=None, end=None) -> DataFrame:
        """start <= stamp <= end, each end optional."""
        if start is not None:
            df = df.where(F.col(self.ts) >= F.lit(start))
        return df if end is None else df.where(F.col(self.ts) <= F.lit(end))

    def only(self, df: DataFrame, groups: Sequence) -> DataFrame:
        if not self.group:
            raise ValueError("there is no group column")
        return df.where(F.col(self.group).isin(list(groups)))

    def complete(self, df: DataFrame, meta: bool = False) -> DataFrame:
        """Features and target without rows that miss any."""
        extra = [self.ts, *([self.group] if self.group else [])] if meta else []
        return df.select(*extra, *self.features, self.target).dropna(subset=[*self.features, self.target])

    def summary(self, df: DataFrame) -> DataFrame:
        groups = F.countDistinct(self.group) if self.group else F.lit(1)
        return df.agg(F.count(F.lit(1)).alias("n"), groups.alias("n_groups"), F.min(self.ts).alias("first"), F.max(self.ts).alias("last"), F.avg(self.target).alias("target_mean"), F.stddev_pop(self.target).alias("target_std"))


@dataclass
class Preparation:
    """Impute, then winsorise, then scale; every statistic comes from the rows it was fitted on.

    Percentiles are those of the imputed values; the standard scale is the
    population deviation, the robust one the interquartile range.
    """

    columns: tuple[str, ...]
    impute: str | None = "mean"
    winsor: tuple[float, float] | None = None
    scale: str | None = "standard"
    stats: dict[str, dict[str, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Preparation:
        centre = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5))}.get(self.impute)
        fill = {c: 0.0 for c in self.columns}
        if centre:
            row = df.agg(*(centre(c).alias(c) for c in self.columns)).first()
            fill = {c: 0.0 if row[c] is None else float(row[c]) for c in self.columns}
        full = df.select(*((F.coalesce(F.col(c), F.lit(fill[c])) if centre else F.col(c)).alias(c) for c in self.columns))
        lo, hi = self.winsor or (0.0, 1.0)
        row = full.agg(*(F.percentile(c, F.array(F.lit(lo), F.lit(hi), F.lit(0.25), F.lit(0.75), F.lit(0.5))).alias(f"q_{c}") for c in self.columns)).first()
        bounds = {c: [float(x) if x is not None else 0.0 for x in (row[f"q_{c}"] or [0.0] * 5)] for c in self.columns}
        if self.winsor:
            full = full.select(*(F.greatest(F.lit(bounds[c][0]), F.least(F.lit(bounds[c][1]), F.col(c))).alias(c) for c in self.columns))
        row = full.agg(*(x for c in self.columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")))).first()
        for c in self.columns:
            spread = {"standard": row[f"s_{c}"], "robust": bounds[c][3] - bounds[c][2]}.get(self.scale, 1.0)
            at = {"standard": row[f"m_{c}"], "robust": bounds[c][4]}.get(self.scale, 0.0)
            self.stats[c] = {"fill": fill[c], "lo": bounds[c][0], "hi": bounds[c][1], "at": float(at or 0.0), "spread": float(spread) if spread and spread > 1e-12 else 1.0}
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        made = {}
        for c in self.columns:
            s, x = self.stats[c], F.col(c)
            if self.impute:
                x = F.coalesce(x, F.lit(s["fill"]))
            if self.winsor:
                x = F.when(x.isNotNull(), F.greatest(F.lit(s["lo"]), F.least(F.lit(s["hi"]), x)))
            made[c] = (x - s["at"]) / s["spread"]
        return df.withColumns(made)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Preparation:
        raw = json.loads(text)
        return cls(tuple(raw["columns"]), raw["impute"], tuple(raw["winsor"]) if raw["winsor"] else None, raw["scale"], raw["stats"])


def time_split(df: DataFrame, ts: str, train_end, val_end, test_end=None, group: str | None = None, min_count: int = 0, half_open: bool = False) -> DataFrame:
    """``split``: train up to train_end, val up to val_end, test after; bounds belong to the earlier part, or with ``half_open`` to the later.

    Groups must have ``min_count`` rows in each of the three.
    """
    t = F.col(ts)
    below = (lambda end: t < F.lit(end)) if half_open else (lambda end: t <= F.lit(end))
    inside = F.lit(True) if test_end is None else below(test_end)
    rows = df.withColumn("split", F.when(below(train_end), "train").when(below(val_end), "val").when(inside, "test")).where("split IS NOT NULL")
    if not group or not min_count:
        return rows
    counts = rows.groupBy(group).agg(*(F.sum((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")))
    return rows.join(counts.where((F.col("train") >= min_count) & (F.col("val") >= min_count) & (F.col("test") >= min_count)).select(group), group, "left_semi")


def walk_forward(df: DataFrame, ts: str, train_days: int, val_days: int, test_days: int, step_days: int, expanding: bool = True) -> DataFrame:
    """(fold, rows of df, split): a fold table joined by range; folds with an empty part are left out and take no number."""
    day = F.to_date(ts)
    ends = df.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    starts = ends.select("_lo", F.explode(F.expr(f"sequence(date_add(_lo, {train_days}), _hi, interval {step_days} day)")).alias("_cut"))
    folds = starts.select(
        F.col("_lo").alias("_a") if expanding else F.date_sub("_cut", train_days).alias("_a"), "_cut",
        F.date_add("_cut", val_days).alias("_v"), F.date_add("_cut", val_days + test_days).alias("_t"),
    )
    rows = df.withColumn("_d", day)
    met = rows.join(F.broadcast(folds), (F.col("_d") >= F.col("_a")) & (F.col("_d") < F.col("_t")))
    met = met.withColumn("split", F.when(F.col("_d") < F.col("_cut"), "train").when(F.col("_d") < F.col("_v"), "val").otherwise("test"))
    full = met.groupBy("_cut").agg(F.countDistinct("split").alias("_k")).where("_k = 3")
    number = full.select("_cut", (F.row_number().over(Window.orderBy("_cut")) - 1).alias("fold"))  # one row per fold
    return met.join(F.broadcast(number), "_cut").drop("_a", "_v", "_t", "_d", "_cut")


MODELS = {
    ("linear", "regression"): lambda **k: LinearRegression(**k), ("ridge", "regression"): lambda regParam=1.0, **k: LinearRegression(regParam=regParam, elasticNetParam=0.0, **k),
    ("rf", "regression"): lambda **k: RandomForestRegressor(**k), ("gbt", "regression"): lambda **k: GBTRegressor(**k),
    ("logistic", "classification"): lambda **k: LogisticRegression(**k), ("rf", "classification"): lambda **k: RandomForestClassifier(**k), ("gbt", "classification"): lambda **k: GBTClassifier(**k),
}


def make_model(name: str, task: str = "regression", features: Sequence[str] = (), target: str = "y", seed: int | None = None, **params) -> Pipeline:
    """An MLlib pipeline from feature columns to ``prediction``."""
    if (name, task) not in MODELS:
        raise ValueError(f"no model {name} for {task}; there are {sorted(MODELS)}")
    if seed is not None and name in ("rf", "gbt"):
        params["seed"] = seed
    model = MODELS[name, task](featuresCol="_x", labelCol=target, **params)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), model])


def fit_predict(df: DataFrame, model: Pipeline, split: str = "split") -> DataFrame:
    """Fit on train rows and predict all."""
    return model.fit(df.where(F.col(split) == "train")).transform(df).drop("_x")


def per_horizon(df: DataFrame, name: str, features: Sequence[str], targets: Sequence[str], split: str = "split", **params) -> DataFrame:
    """One model per horizon column: long rows (columns of df, horizon, y, prediction)."""
    out = None
    for t in targets:
        rows = df.dropna(subset=[*features, t])
        made = fit_predict(rows, make_model(name, "regression", features, t, **params), split)
        part = made.select(*[c for c in df.columns if c not in targets], F.lit(int(t.rsplit("_", 1)[1])).alias("horizon"), F.col(t).alias("y"), "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def stacked(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Rows once per horizon, with the horizon as a feature."""
    keep = [c for c in df.columns if c not in targets]
    parts = F.array(*(F.struct(F.lit(int(t.rsplit("_", 1)[1])).alias("horizon"), F.col(t).alias("y")) for t in targets))
    return df.select(*keep, F.explode(parts).alias("_h")).select(*keep, "_h.*").where("y IS NOT NULL")


def regression_scores(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mae, mse, rmse, r2 and the rank correlation, over complete pairs."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    for c, out in ((y, "_ry"), (p, "_rp")):
        rows = rows.withColumn(out, F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2)
    e = F.col(y) - F.col(p)
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * n, F.lit(0.0))).alias("r2"), F.corr("_ry", "_rp").alias("rank_ic"))


def classification_scores(df: DataFrame, y: str, label: str, score: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """n, accuracy, precision, recall, F1, and the area under the curve by average-tie ranks of the score."""
    t, p = F.col(y).cast("int"), F.col(label).cast("int")
    tp, fp, fn = F.sum(t * p), F.sum((1 - t) * p), F.sum(t * (1 - p))
    rows = df.where(t.isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.avg((t == p).cast("double")).alias("accuracy"), (tp / F.nullif(tp + fp, F.lit(0))).alias("precision"), (tp / F.nullif(tp + fn, F.lit(0))).alias("recall"), (2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1")]
    if score:
        rows = rows.withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy(score)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, score)) - 1) / 2)
        ones = F.sum(t).cast("double")
        zeros = F.count(F.lit(1)) - ones
        aggs.append(((F.sum(F.when(t == 1, F.col("_r"))) - ones * (ones + 1) / 2) / F.nullif(ones * zeros, F.lit(0.0))).alias("auc"))
    return rows.groupBy(*by).agg(*aggs)


def coverage(y: Column, lo: Column, hi: Column) -> Column:
    return F.avg(((lo <= y) & (y <= hi)).cast("double"))


def interval_width(lo: Column, hi: Column) -> list[Column]:
    w = hi - lo
    return [F.avg(w).alias("width_mean"), F.percentile(w, F.lit(0.5)).alias("width_median"), F.stddev_pop(w).alias("width_std")]


@dataclass
class Conformal:
    """Widens intervals to a wanted coverage by the quantile of calibration scores (one for both sides, or one each)."""

    alpha: float = 0.1
    symmetric: bool = True
    widen: tuple[float, float] = (0.0, 0.0)

    def fit(self, df: DataFrame, y: str, lo: str, hi: str) -> Conformal:
        rows = df.where(F.col(y).isNotNull() & F.col(lo).isNotNull() & F.col(hi).isNotNull())
        n = rows.count()
        below, above = F.col(lo) - F.col(y), F.col(y) - F.col(hi)

        def level(a: float) -> float:
            return min(1.0, math.ceil((n + 1) * (1 - a)) / n) if n else 1.0

        if self.symmetric:
            q = rows.agg(F.percentile(F.greatest(below, above), F.lit(level(self.alpha)))).first()[0] or 0.0
            self.widen = (float(q), float(q))
        else:
            q = rows.agg(F.percentile(below, F.lit(level(self.alpha / 2))), F.percentile(above, F.lit(level(self.alpha / 2)))).first()
            self.widen = (float(q[0] or 0.0), float(q[1] or 0.0))
        return self

    def apply(self, lo: Column, hi: Column) -> tuple[Column, Column]:
        return lo - self.widen[0], hi + self.widen[1]


def linear_score(features: Column, coefficients: Sequence[float], intercept: float, link: str = "identity") -> Column:
    """Dot product of an array column with fixed coefficients, through a link: scoring without Python."""
    dot = F.aggregate(F.zip_with(features, F.array(*(F.lit(float(c)) for c in coefficients)), lambda x, c: x * c), F.lit(float(intercept)), lambda a, x: a + x)
    return dot if link == "identity" else 1 / (1 + F.exp(-dot))


def positive_probability(df: DataFrame, column: str = "probability") -> DataFrame:
    return df.withColumn("score", vector_to_array(column)[1])


def folds(df: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """The folds of a walk-forward table, in order; there are as many as steps in its span."""
    for row in df.select("fold").distinct().orderBy("fold").collect():
        yield row[0], df.where(F.col("fold") == row[0])


def quantile_fit(df: DataFrame, features: Sequence[str], target: str, quantiles: Sequence[float], rounds: int = 40, ridge: float = 1e-9) -> dict[float, list[float]]:
    """Linear quantile models, {quantile: [intercept, coefficients]}, by reweighted least squares on sums over partitions.

    A round is one aggregate for all quantiles, whose size is that of the features
    squared; weights follow the residuals' side and inverse size, floored ever
    lower.  Rows with a null or NaN are left out; a table without rows is an error.
    """
    k = len(features) + 1
    rows = df.select(*(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([*features, target]))).dropna()
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *(f(F.col(c)).alias(f"{name}{c}") for c in rows.columns for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not stats["n"]:
        raise ValueError("no complete rows")
    scale = {c: stats[f"s{c}"] or 1.0 for c in rows.columns}
    rows = rows.select(*(((F.col(c) - stats[f"m{c}"]) / scale[c]).alias(c) for c in rows.columns)).persist()
    x, y = [F.lit(1.0), *(F.col(f"_{i}") for i in range(k - 1))], F.col(f"_{k - 1}")
    beta = {q: None for q in quantiles}
    try:
        for turn in range(rounds):
            floor, sums = max(0.5**turn, 1e-6), []
            for j, q in enumerate(quantiles):
                if beta[q] is None:
                    w = F.lit(1.0)
                else:
                    res = y - sum((float(b) * c for b, c in zip(beta[q], x, strict=True)), F.lit(0.0))
                    w = F.when(res > 0, q).otherwise(1 - q) / F.greatest(F.abs(res), F.lit(floor))
                sums += [F.sum(w * x[a] * x[b]).alias(f"x{j}_{a}_{b}") for a in range(k) for b in range(a, k)] + [F.sum(w * x[a] * y).alias(f"y{j}_{a}") for a in range(k)]
            got = rows.agg(*sums).first()
            for j, q in enumerate(quantiles):
                m = np.array([[got[f"x{j}_{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)])
                beta[q] = np.linalg.solve(m + ridge * np.trace(m) / k * np.eye(k), np.array([got[f"y{j}_{a}"] for a in range(k)]))
    finally:
        rows.unpersist()
    out = {}
    for q in quantiles:
        coef = [float(beta[q][i + 1]) * scale[f"_{k - 1}"] / scale[f"_{i}"] for i in range(k - 1)]
        level = stats[f"m_{k - 1}"] + float(beta[q][0]) * scale[f"_{k - 1}"] - sum(c * stats[f"m_{i}"] for i, c in enumerate(coef))
        out[q] = [level, *coef]
    return out


def quantile_predict(df: DataFrame, models: dict[float, list[float]], features: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """A column per quantile (``q10`` and so on); in each row the values are sorted, so that quantiles do not cross."""
    asked = sorted(models)
    names = names or [f"q{round(q * 100):02d}" for q in asked]
    each = F.array_sort(F.array(*(sum((float(b) * F.col(c).cast("double") for b, c in zip(models[q][1:], features, strict=True)), F.lit(float(models[q][0]))) for q in asked)))
    return df.withColumn("_q", each).select("*", *(F.col("_q")[i].alias(n) for i, n in enumerate(names))).drop("_q")


def pinball_loss(y: Column, prediction: Column, q: float) -> Column:
    """Mean pinball loss."""
    return F.avg(F.greatest(q * (y - prediction), (q - 1) * (y - prediction)))
