"""Structured Streaming: windows with watermarks, chunked replay, and folds with carried state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.signals import ReversionRule, reversion_step


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, file after file."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(df: DataFrame, ts: str, size: str, late: str, by: list[str], value: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per event-time window; rows later than the watermark are left out when streaming."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    base = df.withWatermark(ts, late) if df.isStreaming else df
    out = base.groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, late: str, by: list[str], value: str) -> DataFrame:
    """Sessions of a key: rows less than ``gap`` apart."""
    base = df.withWatermark(ts, late) if df.isStreaming else df
    out = base.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def reversion_stream(df: DataFrame, key: str, ts: str, z: str, rule: ReversionRule = ReversionRule()) -> DataFrame:
    """The reversion state machine with its state carried between micro-batches.

    Within a batch a key's rows are put in time order; files must arrive in time
    order, as a replay does.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        side, held, wait = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(ts, kind="stable")
        out = []
        for stamp, x in zip(rows[ts], rows[z].to_numpy(float, na_value=np.nan).tolist(), strict=True):
            side, held, wait, why = reversion_step(side, held, wait, x, rule)
            out.append((k[0], stamp, side, why, held))
        state.update((side, held, wait))
        yield pd.DataFrame(out, columns=[key, ts, "signal", "exit_reason", "bars_held"])

    kinds = dict(df.dtypes)
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {ts} {kinds[ts]}, signal int, exit_reason int, bars_held int", "side int, held int, wait int", "append", GroupStateTimeout.NoTimeout)


def run_to_end(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream over all that is there and stop; ``sink`` gets each micro-batch with its number."""
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def replay_chunks(chunks: Iterator[tuple[str, DataFrame]], step: Callable[[DataFrame, object], tuple[DataFrame, object]], state: object = None) -> Iterator[tuple[str, DataFrame]]:
    """Ordered chunks through a step that hands its state on."""
    for name, df in chunks:
        out, state = step(df, state)
        yield name, out
