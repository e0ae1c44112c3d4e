"""Multi-leg structures: weights, values, residuals, and universes as of a date."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import Axis
from .panel import resolve_mapping

LEGS = ("front", "belly", "back")


def weighted_value(legs: Sequence[Column], weights: Sequence[Column | float]) -> Column:
    """Sum of weight times leg; null if a leg is missing."""
    out = F.lit(0.0)
    for leg, w in zip(legs, weights, strict=True):
        out = out + leg * w
    return out


def duration_neutral_weights(front: Column, belly: Column, back: Column) -> Column:
    """Wings 1 and belly -(front + back) / belly; 1, -2, 1 where the belly has no duration."""
    ok = F.abs(belly) > 1e-12
    return F.struct(F.lit(1.0).alias("front"), F.when(ok, -(front + back) / F.when(ok, belly)).otherwise(-2.0).alias("belly"), F.lit(1.0).alias("back"))


def equal_wing_weights(front: Column, belly: Column, back: Column, belly_weight: float = -1.0) -> Column:
    """One weight for both wings that makes the whole neutral; 1, -2, 1 where the wings have no duration."""
    total = front + back
    ok = F.abs(total) > 1e-12
    wing = -belly_weight * belly / F.when(ok, total)
    return F.struct(F.when(ok, wing).otherwise(1.0).alias("front"), F.when(ok, F.lit(belly_weight)).otherwise(-2.0).alias("belly"), F.when(ok, wing).otherwise(1.0).alias("back"))


def neutral_wing(weights: Mapping[str, Column], dv01: Mapping[str, Column], adjust: str = "back") -> Column:
    """The weight of one wing that makes the sum of weight times dv01 zero; an error where its dv01 is zero."""
    rest = F.lit(0.0)
    for leg in LEGS:
        if leg != adjust:
            rest = rest + weights[leg] * dv01[leg]
    return F.when(F.abs(dv01[adjust]) > 1e-12, -rest / dv01[adjust]).otherwise(F.raise_error(F.lit("dv01 of the adjusted leg is zero")).cast("double"))


def normalise_weights(w: Sequence[Column], how: str = "none") -> list[Column]:
    if how == "none":
        return list(w)
    size = {"belly_fixed": F.abs(w[1]), "l1": sum((F.abs(x) for x in w), F.lit(0.0)), "l2": F.sqrt(sum((x * x for x in w), F.lit(0.0)))}
    if how not in size:
        raise ValueError(f"unknown normalisation {how}")
    return [x / F.nullif(size[how], F.lit(0.0)) for x in w]


def fly_name(front: Column, belly: Column, back: Column, prefix: str = "") -> Column:
    """"2y5y10y"; maturities below a year in months."""

    def part(t: Column) -> Column:
        years = F.when(t == F.floor(t), F.format_string("%dy", t.cast("int"))).otherwise(F.concat(F.regexp_replace(F.format_string("%.2f", t.cast("double")), "0+$", ""), F.lit("y")))
        return F.when(t < 1, F.format_string("%dm", F.bround(t * 12, 0).cast("int"))).otherwise(years)

    return F.concat(F.lit(f"{prefix}_" if prefix else ""), part(front), part(belly), part(back))


def tenor_triples(tenors: DataFrame, column: str = "tenor", min_wing: float = 0.5, symmetric: bool = False) -> DataFrame:
    """Ordered triples of a tenor table with wings at least ``min_wing`` apart from the belly."""
    f, b, k = (tenors.select(F.col(column).alias(n)) for n in LEGS)
    out = f.join(b, F.col("belly") - F.col("front") >= min_wing).join(k, F.col("back") - F.col("belly") >= min_wing)
    if symmetric:
        out = out.where(F.abs((F.col("belly") - F.col("front")) - (F.col("back") - F.col("belly"))) < 1e-9)
    return out


def fly_series(values: DataFrame, ts: str, value: str, weights: Sequence[float] = (1.0, -2.0, 1.0), dv01: str | None = None) -> DataFrame:
    """Per stamp the structure's value from ``<leg>_<value>`` columns, with weights fixed or from ``<leg>_<dv01>``."""
    legs = [F.col(f"{n}_{value}") for n in LEGS]
    if dv01:
        w = equal_wing_weights(*(F.col(f"{n}_{dv01}") for n in LEGS))
        cols = [w[n] for n in LEGS]
    else:
        cols = [F.lit(float(x)) for x in weights]
    return values.withColumn("fly_value", weighted_value(legs, cols)).select("*", *(c.alias(f"{n}_weight") for n, c in zip(LEGS, cols, strict=True)))


def legs_long(values: DataFrame, ts: str, columns: Sequence[str]) -> DataFrame:
    """One row per stamp and leg with its id, weight and values."""
    parts = [F.struct(F.lit(n).alias("leg"), F.col(f"{n}_id").alias("id"), F.col(f"{n}_weight").alias("weight"), *(F.col(f"{n}_{c}").alias(c) for c in columns)) for n in LEGS]
    return values.select(ts, F.explode(F.array(*parts)).alias("l")).select(ts, "l.*")


def years_to_maturity(asof: Column, maturity: Column, given: Column | None = None) -> Column:
    years = F.datediff(maturity, asof) / 365.25
    return F.coalesce(given, years) if given is not None else years


def curve_bonds(static: DataFrame, asof: str, country: str, lo: float = 1.0, hi: float = 32.0) -> DataFrame:
    """Bonds of a country with years to maturity in [lo, hi]."""
    given = F.col("ttm_years") if "ttm_years" in static.columns else None
    maturity = F.col("maturity_date") if "maturity_date" in static.columns else F.lit(None).cast("date")
    rows = static.withColumn("ttm", years_to_maturity(F.to_date(F.lit(asof)), maturity, given))
    return rows.where((F.col("country") == country) & F.col("ttm").between(lo, hi) & ~F.isnan("ttm"))


def adjacent(df: DataFrame, by: Sequence[str], order: str, key: str, legs: int = 3, min_gap: float = 0.0) -> DataFrame:
    """Neighbours along a curve: each key with the next one (two legs) or two (three), gaps of at least ``min_gap``."""
    w = Window.partitionBy(*by).orderBy(order, key)
    out = df.select(*by, order, key, *(x for i in range(1, legs) for x in (F.lead(key, i).over(w).alias(f"id_{i}"), F.lead(order, i).over(w).alias(f"at_{i}"))))
    at = [F.col(order), *(F.col(f"at_{i}") for i in range(1, legs))]
    for a, b in zip(at, at[1:], strict=False):
        out = out.where((b - a) >= min_gap)
    return out.where(F.col(f"id_{legs - 1}").isNotNull())


def latest_of(df: DataFrame, by: Sequence[str], start: str, key: str, n: int) -> DataFrame:
    """The newest n keys of each bucket, newest first, as an array; buckets with fewer are left out."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(start).desc(), key))
    best = df.withColumn("_p", place).where(F.col("_p") <= n)
    out = best.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_p", F.col(key).alias("id")))).alias("_l"))
    return out.where(F.size("_l") == n).select(*by, F.transform("_l", lambda x: x["id"]).alias("ids"))


def cross_pairs(df: DataFrame, bucket: str, side: str, key: str) -> DataFrame:
    """Keys of one bucket on two different sides (each unordered pair of sides once)."""
    a = df.select(bucket, F.col(side).alias("side_a"), F.col(key).alias("id_a"))
    b = df.select(bucket, F.col(side).alias("side_b"), F.col(key).alias("id_b"))
    return a.join(b, bucket).where("side_a < side_b")


def mapped_structures(mapping: DataFrame, asked: DataFrame, kind: str, buckets: Sequence[Sequence[str]], roles: Sequence[str], label: str, country: str = "country", bucket: str = "bucket") -> DataFrame:
    """Structures of the instruments in force: per (country, asof) of ``asked`` and tuple of buckets one leg per bucket; all must be mapped.

    mapping: country, bucket, isin, effective_from, effective_to.  All countries, dates
    and tuples are resolved in one pass.
    """
    names = sorted({b for row in buckets for b in row})
    wanted = asked.select(country, "asof").distinct().withColumn(bucket, F.explode(F.array(*(F.lit(n) for n in names))))
    found = resolve_mapping(mapping, wanted, [country, bucket]).where(F.col("isin").isNotNull())
    table = found.groupBy(country, "asof").agg(F.map_from_entries(F.collect_list(F.struct(bucket, F.col("isin").cast("string")))).alias("_isin"))

    def one(row: Sequence[str]) -> Column:
        legs = F.array(*(F.struct(F.lit(role).alias("role"), F.try_element_at("_isin", F.lit(b)).alias("isin")) for b, role in zip(row, roles, strict=True)))
        return F.struct(F.lit(kind).alias("type"), F.concat(F.col(country), F.lit(f"_{label}_{''.join(row)}_{kind.rsplit('_', 1)[-1]}")).alias("name"), F.lit(",".join(row)).alias("tenors"), legs.alias("legs"))

    rows = table.select(country, "asof", F.explode(F.array(*(one(r) for r in buckets))).alias("_s")).select("asof", country, "_s.*")
    return rows.where(F.forall("legs", lambda leg: leg["isin"].isNotNull()))


def mapped_spreads(mapping: DataFrame, asked: DataFrame, pairs: Sequence[tuple[str, str]], buckets: Sequence[str], kind: str = "CROSS_COUNTRY_SPREAD", country: str = "country", bucket: str = "bucket") -> DataFrame:
    """Two countries' instruments of one bucket against each other, per asof of ``asked``."""
    both = mapping.withColumn("_side", F.col(country)).withColumn(country, F.lit("")).withColumn(bucket, F.concat("_side", F.lit("|"), F.col(bucket))).drop("_side")
    dates = asked.select(F.lit("").alias(country), "asof").distinct()
    out = None
    for a, b in pairs:
        part = mapped_structures(both, dates, kind, [(f"{a}|{t}", f"{b}|{t}") for t in buckets], (a, b), "BM", country, bucket)
        tenor = F.substring_index(F.col("tenors"), "|", -1)
        part = part.select("asof", F.lit(None).cast("string").alias(country), "type", F.concat(F.lit(f"{a}{b}_BM_"), tenor, F.lit("_SPREAD")).alias("name"), tenor.alias("tenors"), "legs")
        out = part if out is None else out.unionByName(part)
    return out


def structure_table(*universes: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Structures of all generators in one table, legs as ``role:isin;...``; of chosen types on demand."""
    rows = reduce(lambda a, b: a.unionByName(b), universes)
    rows = rows if types is None else rows.where(F.col("type").isin(list(types)))
    return rows.withColumn("legs", F.array_join(F.transform("legs", lambda x: F.concat(x["role"], F.lit(":"), x["isin"])), ";"))


def _normal(axis: Axis, y: str, x1: str, x2: str, window: int | None, min_obs: int) -> dict[str, Column]:
    """Rolling means, variances and covariances of y on (x1, x2) over complete rows."""
    ok = F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull()
    w = axis.frame(window) if window else Window.partitionBy(*axis.by)
    use = {n: F.when(ok, F.col(c)) for n, c in (("y", y), ("a", x1), ("b", x2))}
    out = {"n": F.count(use["y"]).over(w)}
    for n in use:
        out[f"m{n}"] = F.avg(use[n]).over(w)
    for p, q in (("a", "a"), ("b", "b"), ("a", "b"), ("a", "y"), ("b", "y")):
        out[f"c{p}{q}"] = F.covar_pop(use[p], use[q]).over(w)
    return out


def residual_three_legs(df: DataFrame, axis: Axis, front: str, belly: str, back: str, window: int | None = 252, min_obs: int = 60, ridge: float = 0.0) -> DataFrame:
    """Regression of the belly on both wings, rolling (or over all, without a window): alpha, beta_front, beta_back, residual.

    Two regressors are solved in closed form from rolling covariances, so one
    window pass serves any number of series.
    """
    terms = _normal(axis, belly, front, back, window, min_obs)
    rows = df.select("*", *(c.alias(f"_{n}") for n, c in terms.items()))
    aa, bb, ab = F.col("_caa") + ridge, F.col("_cbb") + ridge, F.col("_cab")
    det = aa * bb - ab * ab
    ok = (F.col("_n") >= min_obs) & (F.abs(det) > 1e-14)
    det = F.when(ok, det)
    rows = rows.withColumn("beta_front", (F.col("_cay") * bb - F.col("_cby") * ab) / det).withColumn("beta_back", (F.col("_cby") * aa - F.col("_cay") * ab) / det)
    rows = rows.withColumn("alpha", F.col("_my") - F.col("beta_front") * F.col("_ma") - F.col("beta_back") * F.col("_mb"))
    return rows.withColumn("residual", F.col(belly) - F.col("alpha") - F.col("beta_front") * F.col(front) - F.col("beta_back") * F.col(back)).drop(*(f"_{n}" for n in terms))


def residual_of_changes(df: DataFrame, axis: Axis, front: str, belly: str, back: str, window: int | None = 252, min_obs: int = 60, ridge: float = 0.0, integrate: bool = True) -> DataFrame:
    """The same on differences, with the residual summed up on demand."""
    rows = df
    for c in (front, belly, back):
        rows = rows.withColumn(f"d_{c}", F.col(c) - axis.lag(c))
    rows = residual_three_legs(rows, axis, f"d_{front}", f"d_{belly}", f"d_{back}", window, min_obs, ridge)
    return rows.withColumn("residual", F.sum("residual").over(axis.frame(None))) if integrate else rows


def ar1(df: DataFrame, axis: Axis, value: str, min_obs: int = 30) -> DataFrame:
    """Per series: x on its lag - n, a, b, t-statistic of b against zero, and the half-life where 0 < b < 1."""
    rows = df.select(*axis.by, F.col(value).alias("_y"), axis.lag(value).alias("_x")).where("_y IS NOT NULL AND _x IS NOT NULL")
    out = rows.groupBy(*axis.by).agg(F.count(F.lit(1)).alias("n"), F.regr_intercept("_y", "_x").alias("a"), F.regr_slope("_y", "_x").alias("b"), F.regr_syy("_y", "_x").alias("_syy"), F.regr_sxx("_y", "_x").alias("_sxx"), F.regr_sxy("_y", "_x").alias("_sxy"))
    rss = F.col("_syy") - F.col("b") * F.col("_sxy")
    se = F.sqrt(F.greatest(rss, F.lit(0.0)) / F.nullif((F.col("n") - 2).cast("double"), F.lit(0.0)) / F.nullif(F.col("_sxx"), F.lit(0.0)))
    enough = F.col("n") >= min_obs
    half = F.when(enough & (F.col("b") > 0) & (F.col("b") < 1), -F.log(F.lit(2.0)) / F.log("b"))
    return out.select(*axis.by, "n", F.when(enough, F.col("a")).alias("a"), F.when(enough, F.col("b")).alias("b"), F.when(enough, F.col("b") / F.nullif(se, F.lit(0.0))).alias("t_stat"), half.alias("half_life"))


def stationarity_grid(df: DataFrame, axis: Axis, front: str, belly: str, back: str, bounds: tuple[float, float] = (-3.0, 3.0), size: int = 21, belly_weight: float = 1.0, min_obs: int = 120) -> DataFrame:
    """Wing weights on a grid with the shortest AR(1) half-life of the combination, per series.

    The regression of x on its lag for any weights follows from sums over the legs,
    so the series are passed once and the grid meets one row per series.
    """
    names = (front, belly, back)
    rows = df.select(*axis.by, *(F.col(c).alias(f"y{i}") for i, c in enumerate(names)), *(axis.lag(c).alias(f"x{i}") for i, c in enumerate(names))).dropna()
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(3):
        for j in range(3):
            aggs += [F.covar_pop(f"x{i}", f"x{j}").alias(f"xx{i}{j}"), F.covar_pop(f"x{i}", f"y{j}").alias(f"xy{i}{j}")]
    sums = rows.groupBy(*axis.by).agg(*aggs).where(F.col("n") >= min_obs)
    step = (bounds[1] - bounds[0]) / (size - 1)
    axis_values = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: bounds[0] + k * step)
    grid = sums.withColumn("w0", F.explode(axis_values)).withColumn("w2", F.explode(axis_values))
    w = [F.col("w0"), F.lit(belly_weight), F.col("w2")]
    xx = sum((w[i] * w[j] * F.col(f"xx{i}{j}") for i in range(3) for j in range(3)), F.lit(0.0))
    xy = sum((w[i] * w[j] * F.col(f"xy{i}{j}") for i in range(3) for j in range(3)), F.lit(0.0))
    b = xy / F.when(xx > 1e-18, xx)
    half = F.when((b > 1e-9) & (b < 1), -F.log(F.lit(2.0)) / F.log(b))
    found = grid.select(*axis.by, "n", F.struct(half.alias("half_life"), F.round("w0", 9).alias("front"), F.round("w2", 9).alias("back")).alias("s")).where("s.half_life IS NOT NULL")
    return found.groupBy(*axis.by).agg(F.min("s").alias("s"), F.first("n").alias("n")).select(*axis.by, "n", "s.*")
