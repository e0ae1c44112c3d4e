"""Sums of fixed-size vectors over partitions, in as many levels as keep every group small."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that a task adds up at most, per key.
FAN = 64


def _add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = None
    for raw in rows["vector"]:
        v = np.frombuffer(raw, "<f8")
        total = v.copy() if total is None else total + v
    return pd.DataFrame({"key": [key[0]], "fan": [key[1]], "vector": [total.tobytes()]})


def summed(parts: DataFrame) -> dict[str, np.ndarray]:
    """Rows (key string, vector binary of doubles), at most one of a key per partition, summed by key; a vector per key comes back.

    Each level adds up to FAN vectors in a group, so that the number of levels
    grows with the logarithm of the number of partitions, and no group grows.
    """
    width = parts._jdf.queryExecution().toRdd().getNumPartitions()
    level = parts.withColumn("fan", F.spark_partition_id())
    while True:
        width = -(-width // FAN)
        level = level.withColumn("fan", F.expr(f"cast(fan div {FAN} as int)")).groupBy("key", "fan").applyInPandas(_add, "key string, fan int, vector binary")
        if width <= 1:
            return {r[0]: np.frombuffer(r[2], "<f8") for r in level.collect()}
