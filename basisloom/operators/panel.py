"""Long-panel operators: validation, reshaping, gap filling, alignment, as-of and interval joins."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def require(df: DataFrame, *columns: str) -> None:
    """Fail before execution where columns are missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def summarise_quality(df: DataFrame, ts: str, key: str, values: Sequence[str] = (), row: str | None = None) -> DataFrame:
    """One row on a panel: rows, dates, keys, duplicate keys, out-of-order rows, longest gap in days, missing rate, balance.

    ``row`` names a column with the physical row order; without it order is not
    judged.  ``is_valid`` is false on duplicate keys or rows out of order only.
    """
    require(df, ts, key, *values)
    per_cell = df.groupBy(ts, key).agg(F.count(F.lit(1)).alias("n"), *(F.count(v).alias(f"c_{v}") for v in values))
    w = Window.partitionBy(key).orderBy(ts)
    gaps = per_cell.withColumn("gap", F.datediff(F.col(ts), F.lag(ts).over(w)))
    found = sum((F.sum(f"c_{v}") for v in values), F.lit(0))
    shape = gaps.agg(
        F.sum("n").alias("n_rows"), F.countDistinct(ts).alias("n_dates"), F.countDistinct(key).alias("n_keys"), F.count(F.lit(1)).alias("n_cells"),
        F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("n_duplicates"), F.max("gap").alias("max_gap_days"), found.alias("_found"),
    )
    if row is None:
        late = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_unordered"))
    else:
        back = F.col(ts) < F.lag(ts).over(Window.partitionBy(key).orderBy(row))
        late = df.withColumn("_back", back).agg(F.coalesce(F.sum(F.col("_back").cast("long")), F.lit(0)).alias("n_unordered"))
    out = shape.crossJoin(late)  # one row each
    rate = F.lit(0.0) if not values else 1 - F.col("_found") / F.nullif(F.col("n_rows") * len(values), F.lit(0))
    return out.select(
        "n_rows", "n_dates", "n_keys", "n_duplicates", "n_unordered", "max_gap_days", rate.alias("missing_rate"),
        (F.col("n_cells") == F.col("n_dates") * F.col("n_keys")).alias("is_balanced"),
        ((F.col("n_duplicates") == 0) & (F.col("n_unordered") == 0)).alias("is_valid"),
    )


def panel_summary(df: DataFrame, ts: str, key: str, values: Sequence[str]) -> DataFrame:
    """Per key: rows, first and last stamp, mean and sample deviation of each value."""
    stats = [x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"))]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"), *stats)


def to_wide(df: DataFrame, ts: str, key: str, values: Sequence[str], keys: Sequence, names: str = "{key}") -> DataFrame:
    """One row per stamp, one column per key and value; a repeated (stamp, key) is an error."""
    cells = df.where(F.col(key).isin(list(keys))).groupBy(ts, key).agg(F.count(F.lit(1)).alias("_n"), *(F.first(v).alias(v) for v in values))
    checked = cells.select(ts, key, *(F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated (stamp, key)")).cast("double")).otherwise(F.col(v)).alias(v) for v in values))
    wide = checked.groupBy(ts).pivot(key, list(keys)).agg(*(F.first(v).alias(v) for v in values))
    if len(values) == 1:
        for k in keys:
            wide = wide.withColumnRenamed(str(k), names.format(key=k))
    return wide


def to_long(wide: DataFrame, ts: str, columns: Sequence[str] | None = None, key: str = "key", value: str = "value") -> DataFrame:
    columns = list(columns) if columns is not None else [c for c in wide.columns if c != ts]
    return wide.unpivot(ts, columns, key, value)


def calendar(df: DataFrame, ts: str, step: str) -> DataFrame:
    """Regular stamps from the first to the last of ``df``; ``step`` is an interval such as "1 day"."""
    ends = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return ends.where("lo IS NOT NULL").select(F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias(ts))


def fill_gaps(df: DataFrame, ts: str, key: str, step: str = "1 day", method: str | None = "ffill", limit: int | None = None) -> DataFrame:
    """All stamps for all keys; values carried forward (or backward) at most ``limit`` rows.

    Each key's grid comes from its row of a key table and the two ends of the
    calendar, so no table is joined without a condition.
    """
    values = [c for c in df.columns if c not in (ts, key)]
    ends = F.broadcast(df.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi")))  # one row
    grid = df.select(key).distinct().join(ends, F.col("_lo").isNotNull()).select(key, F.explode(F.expr(f"sequence(_lo, _hi, interval {step})")).alias(ts))
    out = grid.join(df, [key, ts], "left")
    if method is None:
        return out
    forward = method == "ffill"
    order = F.col(ts).asc() if forward else F.col(ts).desc()
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    out = out.withColumn("_p", place)
    for v in values:
        seen = F.last(v, ignorenulls=True).over(w)
        if limit is not None:
            age = F.col("_p") - F.last(F.when(F.col(v).isNotNull(), F.col("_p")), ignorenulls=True).over(w)
            seen = F.when(age <= limit, seen)
        out = out.withColumn(f"_{v}", seen)
    return out.select(key, ts, *(F.col(f"_{v}").alias(v) for v in values))


def align_panels(frames: Sequence[DataFrame], ts: str, key: str, how: str = "inner") -> list[DataFrame]:
    """Each frame reduced to the keys that all have; ``outer`` leaves them as they are."""
    if how == "outer":
        return list(frames)
    common = reduce(lambda a, b: a.intersect(b), (f.select(ts, key) for f in frames))
    return [f.join(common, [ts, key], "left_semi") for f in frames]


def all_keys(frames: Sequence[DataFrame], ts: str, key: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), (f.select(ts, key) for f in frames)).distinct()


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), direction: str = "backward", tolerance: str | None = None, suffix: str = "_right", tie: Sequence[str] = ()) -> DataFrame:
    """The nearest right row at or before (after; on either side of) each left row, within ``tolerance``.

    Both sides are laid in one order per key and the last right row seen is
    carried, so each side is shuffled once and no pair is tried.  Of right rows
    with one stamp the last by ``tie`` wins backward, the first forward; at equal
    distance the earlier side wins.
    """
    by = list(by)
    values = [c for c in right.columns if c != on and c not in by]
    names = {c: c + suffix if c in left.columns else c for c in values}
    payload = F.struct(F.col(on).alias("_at"), *(F.col(c) for c in values))
    lefts = left.withColumn("_side", F.lit(1)).withColumn("_row", payload_null(right, on, values)).withColumn("_left", F.struct(*left.columns))
    rights = right.select(*by, on, F.lit(0).alias("_side"), payload.alias("_row"), *(F.col(t).alias(f"_tie{i}") for i, t in enumerate(tie)))
    lefts = lefts.select(*by, on, "_side", "_row", "_left")
    both = rights.unionByName(lefts, allowMissingColumns=True)
    ties = [F.col(f"_tie{i}") for i in range(len(tie))]
    back = Window.partitionBy(*by).orderBy(F.col(on), F.col("_side"), *ties).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.col(on).desc(), F.col("_side"), *(t.desc() for t in ties)).rowsBetween(Window.unboundedPreceding, 0)
    before, after = F.last("_row", ignorenulls=True).over(back), F.last("_row", ignorenulls=True).over(ahead)
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction}")
    both = both.withColumn("_b", before if direction != "forward" else F.lit(None)) if direction != "nearest" else both.withColumn("_b", before).withColumn("_a", after)
    if direction == "forward":
        both = both.withColumn("_b", after)
    out = both.where("_side = 1")
    if direction == "nearest":
        d_b = _micros(F.col(on)) - _micros(F.col("_b._at"))
        d_a = _micros(F.col("_a._at")) - _micros(F.col(on))
        out = out.withColumn("_b", F.when(d_a < F.coalesce(d_b, F.lit((1 << 63) - 1)), F.col("_a")).otherwise(F.col("_b")))
    if tolerance is not None:
        near = F.col("_b._at").between(F.col(on) - F.expr(f"interval {tolerance}"), F.col(on) + F.expr(f"interval {tolerance}"))
        out = out.withColumn("_b", F.when(near, F.col("_b")))
    return out.select("_left.*", *(F.col(f"_b.{c}").alias(names[c]) for c in values))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def payload_null(right: DataFrame, on: str, values: Sequence[str]) -> Column:
    kinds = dict(right.dtypes)
    fields = ", ".join([f"_at: {kinds[on]}", *(f"`{c}`: {kinds[c]}" for c in values)])
    return F.lit(None).cast(f"struct<{fields}>")


def align_to(df: DataFrame, stamps: DataFrame, ts: str, by: Sequence[str] = (), fill: bool = True) -> DataFrame:
    """Values at the given stamps, carried forward; per key of ``by`` if given."""
    if by:
        listed = F.broadcast(stamps.agg(F.sort_array(F.collect_set(ts)).alias("_stamps")))  # the reference dates
        grid = df.select(*by).distinct().join(listed, F.lit(True)).select(*by, F.explode("_stamps").alias(ts))
    else:
        grid = stamps.select(ts).distinct()
    if not fill:
        return grid.join(df, [*by, ts], "left")
    return asof_join(grid, df, ts, by)


def resolve_mapping(mapping: DataFrame, asked: DataFrame, keys: Sequence[str], value: str = "isin", asof: str = "asof", start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Point-in-time lookup: the newest row with start <= asof < end (an open end never ends)."""
    m = mapping.select(*(F.col(k).alias(f"_m_{k}") for k in keys), F.col(value).alias(value), F.col(start).alias("_from"), F.col(end).alias("_to"))
    same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_m_{k}") for k in keys))
    valid = (F.col("_from") <= F.col(asof)) & (F.col("_to").isNull() | (F.col(asof) < F.col("_to")))
    found = asked.select(*keys, asof).distinct().join(m, same & valid, "left")
    return found.groupBy(*keys, asof).agg(F.max_by(value, F.struct("_from", value)).alias(value))


def mapping_history(mapping: DataFrame, asked: DataFrame, keys: Sequence[str], value: str = "isin", asof: str = "asof", start: str = "effective_from") -> DataFrame:
    """All values that had begun by asof, newest first."""
    m = mapping.select(*(F.col(k).alias(f"_m_{k}") for k in keys), F.col(value).alias(value), F.col(start).alias("_from"))
    same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_m_{k}") for k in keys))
    found = asked.select(*keys, asof).distinct().join(m, same & (F.col("_from") <= F.col(asof)))
    listed = F.sort_array(F.collect_list(F.struct("_from", value)), asc=False)
    return found.groupBy(*keys, asof).agg(F.transform(listed, lambda x: x[value]).alias("history"))


def align_sources(clock: DataFrame, sources: Sequence[DataFrame], ts: str, key: str, carry: Sequence[str] = (), defaults: dict[str, float] | None = None, essential: Sequence[str] = (), drop_missing: bool = False) -> DataFrame:
    """Sources joined on a clock of (stamp, key); ``carry`` columns go forward, then defaults; rows need an essential value."""
    out = clock
    for s in sources:
        out = out.join(s, [ts, key], "left")
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    out = out.select(ts, key, *((F.last(c, ignorenulls=True).over(w) if c in carry else F.col(c)).alias(c) for c in out.columns if c not in (ts, key)))
    if essential:
        out = out.where(reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in essential)))
    if drop_missing:
        out = out.dropna()
    return out.fillna(defaults) if defaults else out


def apply_rolls(df: DataFrame, rolls: DataFrame, ts: str, key: str) -> DataFrame:
    """From each roll's date on, instrument ``from_id`` shows the rows of ``to_id``; the latest roll of a date on or before wins.

    Each (stamp, instrument) that occurs is asked for once, by an as-of join on the
    rolls; where the source has several rows at that stamp, all of them are shown.
    """
    values = [c for c in df.columns if c not in (ts, key)]
    r = rolls.select(F.col("from_id").alias(key), F.col("effective").alias(ts), F.col("to_id").alias("_to"))
    due = asof_join(df.select(ts, key).distinct(), r, ts, [key], tie=["_to"])
    source = df.select(F.col(ts), F.col(key).alias("_src"), *values)
    return due.withColumn("_src", F.coalesce("_to", key)).join(source, [ts, "_src"], "left").select(ts, key, *values)


def explode_pairs(df: DataFrame, keep: Iterable[str], ids: str, ratios: str) -> DataFrame:
    """Two list columns zipped to rows (id, ratio); lists of different length are an error."""
    checked = F.when(F.size(ids) == F.size(ratios), F.arrays_zip(F.col(ids).alias("id"), F.col(ratios).alias("ratio"))).otherwise(F.raise_error(F.lit("lists differ in length")).cast("array<struct<id:string,ratio:double>>"))
    return df.select(*keep, F.explode(checked).alias("_z")).select(*keep, F.col("_z.id").alias("id"), F.col("_z.ratio").alias("ratio"))
