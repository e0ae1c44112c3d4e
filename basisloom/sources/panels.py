"""Readers and writers of panel tables, plain or in dated chunks, and seeded generators."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.windows import clean

#: Contract of the portfolio's static table (fixed values).
META = "instrument_id string, tradable double, pos_limit_long double, pos_limit_short double, max_trade_notional_inc double, max_trade_notional_dec double, qty_step double, min_qty_trade double, maturity_date date"
HEDGE_META = "instrument_id string, qty_step double, min_qty_trade double"
_DATED = re.compile(r"(?P<base>.+)_(?P<start>\d{8})_(?P<end>\d{8})\.parquet$")


def read_panel(spark: SparkSession, path: str, format: str = "parquet", schema: str | T.StructType | None = None, **options) -> DataFrame:
    """A table with NaN turned into null in its double columns."""
    reader = spark.read.format(format).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df.select(*(clean(c).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, by Spark's file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(s.getPath().getName() for s in path.getFileSystem(conf).listStatus(path))


def dated_files(spark: SparkSession, folder: str, base: str, start: str | None = None, end: str | None = None) -> list[tuple[str, str, str]]:
    """(start, end, path) of base_YYYYMMDD_YYYYMMDD.parquet whose span meets [start, end], in order."""
    out = []
    for name in list_files(spark, folder):
        m = _DATED.match(name)
        if m and m["base"] == base and (start is None or m["end"] >= start) and (end is None or m["start"] <= end):
            out.append((m["start"], m["end"], f"{folder}/{name}"))
    return sorted(out)


def same_spans(spark: SparkSession, folder: str, bases: Sequence[str]) -> None:
    """All sources must cover the same spans with the same columns in every file."""
    spans = {b: {(s, e) for s, e, _ in dated_files(spark, folder, b)} for b in bases}
    first = spans[bases[0]]
    for b in bases:
        if spans[b] != first:
            raise ValueError(f"{b} covers other dates than {bases[0]}: {sorted(spans[b] ^ first)}")
        seen = {tuple(spark.read.parquet(p).columns) for _, _, p in dated_files(spark, folder, b)}
        if len(seen) > 1:
            raise ValueError(f"columns of {b} differ between files: {sorted(seen)}")


def read_dated(spark: SparkSession, folder: str, base: str, ts: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The rows of a dated source between two dates (both included), reading only files that can have them."""
    files = dated_files(spark, folder, base, start, end)
    if not files:
        raise FileNotFoundError(f"no dated files of {base} in {folder}")
    df = spark.read.parquet(*(p for _, _, p in files))
    if start is not None:
        df = df.where(F.to_date(ts) >= F.to_date(F.lit(start), "yyyyMMdd"))
    return df if end is None else df.where(F.to_date(ts) <= F.to_date(F.lit(end), "yyyyMMdd"))


def chunks(spark: SparkSession, folder: str, bases: Sequence[str], ts: str) -> Iterator[tuple[str, dict[str, DataFrame]]]:
    """One set of tables per span, in order."""
    same_spans(spark, folder, bases)
    for start, end, _ in dated_files(spark, folder, bases[0]):
        yield start, {b: read_dated(spark, folder, b, ts, start, end) for b in bases}


def write_dated(df: DataFrame, folder: str, base: str, ts: str, days: int = 1) -> None:
    """One dated folder per span of ``days`` from the first date on."""
    first = df.agg(F.min(F.to_date(ts)), F.max(F.to_date(ts))).first()
    if first[0] is None:
        return
    for (start,) in df.sparkSession.range(0, (first[1] - first[0]).days + 1, days).select(F.date_add(F.lit(first[0]), F.col("id").cast("int"))).collect():
        part = df.where((F.to_date(ts) >= F.lit(start)) & (F.to_date(ts) < F.date_add(F.lit(start), days)))
        last = df.sparkSession.range(1).select(F.date_format(F.date_add(F.lit(start), days - 1), "yyyyMMdd")).first()[0]
        part.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{base}_{start:%Y%m%d}_{last}.parquet")


def book_levels(columns: Sequence[str]) -> int:
    """Levels of a wide book, which must run from 0 without a gap."""
    found = sorted(int(m[1]) for c in columns if (m := re.fullmatch(r"bid_px_l(\d+)", c)))
    if not found or found != list(range(len(found))):
        raise ValueError(f"book levels must be 0, 1, ...; found {found}")
    return len(found)


def ladder(df: DataFrame, keys: Sequence[str] = ("datetime", "instrument_id")) -> DataFrame:
    """A wide book as arrays of levels: bid and ask array<struct<px, sz>>."""
    n = book_levels(df.columns)

    def side(s: str):
        return F.array(*(F.struct(clean(f"{s}_px_l{i}").alias("px"), clean(f"{s}_sz_l{i}").alias("sz")) for i in range(n)))

    return df.select(*keys, side("bid").alias("bid"), side("ask").alias("ask"))


def load_market(spark: SparkSession, folder: str, ref: str, carry: bool = True) -> DataFrame:
    """The five sources of one reference as a long table (datetime, instrument_id): book, mid, dv01, ratio, and the reference's signal.

    Stamps are those of any source; books and prices are carried forward, then mid
    is 0 and dv01 1 where nothing was seen.  The reference's own ratio is 1 and a
    missing one 0; lists of different length are an error.
    """
    from ..operators.panel import align_sources, explode_pairs

    keys = ["datetime", "instrument_id"]
    book, mid, dv01 = ladder(read_panel(spark, f"{folder}/book.parquet")), read_panel(spark, f"{folder}/mid.parquet"), read_panel(spark, f"{folder}/dv01.parquet")
    signal = read_panel(spark, f"{folder}/signal.parquet").where(F.col("instrument_id") == ref)
    hedges = spark.read.parquet(f"{folder}/hedge_ratios.parquet").where(F.col("instrument_id") == ref)
    ratios = explode_pairs(hedges, ["datetime"], "hedge_instruments", "hedge_ratios").select("datetime", F.col("id").alias("instrument_id"), "ratio")
    ids = ratios.select("instrument_id").distinct().union(spark.range(1).select(F.lit(ref))).distinct()
    stamps = book.select("datetime").union(mid.select("datetime")).union(signal.select("datetime")).distinct()
    clock = stamps.join(F.broadcast(ids), F.lit(True))  # the instruments of one reference
    fields = [c for c in signal.columns if c not in keys]
    out = align_sources(clock, [book, mid.select(*keys, "mid_px"), dv01.select(*keys, "dv01"), ratios], "datetime", "instrument_id", ["bid", "ask", "mid_px", "dv01", "ratio"] if carry else [])
    out = out.join(signal.select("datetime", *fields), "datetime", "left")
    w = Window.partitionBy("instrument_id").orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    if carry:
        out = out.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in fields})
    out = out.withColumn("ratio", F.when(F.col("instrument_id") == ref, 1.0).otherwise(F.coalesce("ratio", F.lit(0.0))))
    return out.fillna({"mid_px": 0.0, "dv01": 1.0})


def static_table(meta: DataFrame, required: str, ids: DataFrame | None = None, key: str = "instrument_id", bucket: str | None = None, caps: Mapping[str, float] | None = None) -> DataFrame:
    """A static table, one row per wanted instrument (all of the table, if none are named) with its required columns.

    ``bucket`` becomes the number of its cap in the order of ``caps`` (unknown buckets
    fall into the first, as in the source's contract) and ``bucket_cap`` that cap.
    """
    names = T.StructType.fromDDL(required).fieldNames()
    if missing := [c for c in names if c not in meta.columns and c != key]:
        raise ValueError(f"missing columns {missing}")
    rows = meta.select(key, *(c for c in names if c != key), *([bucket] if bucket and bucket not in names else [])).dropDuplicates([key])
    out = rows if ids is None else ids.select(key).distinct().join(rows, key, "left")
    if bucket and caps:
        at = F.coalesce(F.array_position(F.array(*(F.lit(c) for c in caps)), F.col(bucket).cast("string")), F.lit(0))
        at = F.greatest(at - 1, F.lit(0)).cast("int")
        out = out.withColumn(bucket, at).withColumn("bucket_cap", F.element_at(F.array(*(F.lit(float(v)) for v in caps.values())), F.col(bucket) + 1))
    return out


def disable_empty(meta: DataFrame, market: DataFrame, columns: Sequence[str], key: str = "instrument_id", tradable: str = "tradable") -> DataFrame:
    """``tradable`` becomes 0 for instruments of which a column has no value at all; one aggregate over the market."""
    full = market.groupBy(key).agg(F.least(*(F.count(clean(c)) for c in columns), F.lit(1 << 40)).alias("_values"))
    rows = meta.join(full, key, "left")
    return rows.withColumn(tradable, F.when(F.coalesce("_values", F.lit(0)) > 0, F.col(tradable)).otherwise(0.0)).drop("_values")


def write_run(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], meta: Mapping) -> None:
    """Result tables as Parquet and the run's parameters as one JSON row."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(json.dumps(dict(meta), default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/run_meta")


def read_run(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """What :func:`write_run` wrote; missing parts are left out."""
    names = list_files(spark, folder)
    meta = json.loads(spark.read.text(f"{folder}/run_meta").first()[0]) if "run_meta" in names else {}
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names if n != "run_meta"}, meta


def time_grid(spark: SparkSession, start: str, periods: int, step: str) -> DataFrame:
    """``periods`` stamps from ``start`` on."""
    return spark.range(periods).select(F.col("id").alias("i"), (F.to_timestamp(F.lit(start)) + F.expr(f"id * interval {step}")).alias("datetime"))


def random_walk_panel(spark: SparkSession, ids: Sequence[str], start: str = "2024-01-01 09:00:00", periods: int = 1000, step: str = "1 minute", seed: int = 7, base: float = 100.0, vol: float = 0.01) -> DataFrame:
    """(datetime, id, close, volume): seeded random walks, one window per series."""
    rows = time_grid(spark, start, periods, step).select("*", F.explode(F.array(*(F.lit(x) for x in ids))).alias("id"))
    # a draw is a function of seed, series and step: the same on every plan
    u = [(F.pmod(F.xxhash64(F.lit(seed + k), F.col("id"), F.col("i")), F.lit(1 << 52)) + 0.5) / float(1 << 52) for k in range(3)]
    normal = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * 3.141592653589793 * u[1])
    w = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("datetime", "id", (base * F.exp(F.sum(normal * vol).over(w))).alias("close"), (1000 + 4000 * u[2]).alias("volume"))


def drop_rows(df: DataFrame, share: float, seed: int = 7, keys: Sequence[str] = ("datetime", "id")) -> DataFrame:
    """Rows left out by a hash of their key, the same on every run."""
    u = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)
    return df.where(u >= share)
