"""Exact deduplication by distributed MSD radix partitioning.

All texts start in one group.  Each level splits every group by the next run of
bytes (runs get longer level by level); a group of one row is finished, a group
whose texts have ended is a class of equal texts, and only the others go on,
with the bytes not yet compared.  Equality is decided by the bytes themselves.
The split of a group is a partial aggregation on (group, bytes), so that a hot
group is combined before it moves; rows learn their new group from the written
split table by a merge join whose skewed side Spark may divide.

Defined results: null text is the empty text; of rows that repeat a doc_id with
equal text one stays; a null doc_id is larger than any other; a very long text is
compared to its last byte, in runs that grow eightfold; an empty table has no
classes; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, exchanges, parts_for

#: Bytes compared at the first level, and the factor by which the run grows.
FIRST_RUN, GROWTH = 48, 8

#: MB of the input to a partition of an exchange, where the session's number of partitions would make them larger.
PART_MB = 32


def normalised(text: Column) -> Column:
    """White space of ASCII as single spaces; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _join(rows: DataFrame, split: DataFrame, on: list[str]) -> DataFrame:
    """Always a merge join, at every size: Spark divides its skewed partitions, and nothing is broadcast."""
    return rows.join(split.hint("merge"), on, "left")


def equal_text_classes(docs: DataFrame, scratch: Scratch | None = None, first_run: int = FIRST_RUN, growth: int = GROWTH) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    with exchanges(docs.sparkSession, parts_for(docs, PART_MB)):
        return _classes(docs, scratch, first_run, growth)


def _classes(docs: DataFrame, scratch: Scratch, run: int, growth: int) -> DataFrame:
    """The levels of :func:`equal_text_classes`, every one a written table."""
    norm = normalised(F.col("text"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"))

    # the first level reads the table twice instead of writing it
    head = base.select(F.substring(F.col("norm").cast("binary"), 1, run).alias("head"))
    many = head.groupBy("head").count().where("count > 1").select("head")
    many = scratch.write(many.withColumn("gid", F.monotonically_increasing_id()), "split")
    rows = base.select("doc_id", F.sha2("norm", 256).alias("sha"), F.col("norm").cast("binary").alias("bytes")).withColumn("head", F.substring("bytes", 1, run))
    rows = _join(rows, many, ["head"])
    level = scratch.write(
        rows.select(
            "doc_id", "sha", "gid", F.monotonically_increasing_id().alias("uid"),
            F.when(F.col("gid").isNotNull(), F.expr(f"substring(bytes, {run + 1})")).alias("rest"),
        ),
        "level",
    )
    done = [level.where("gid IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")]
    active = level.where("gid IS NOT NULL")
    scratch.release()
    while not active.isEmpty():
        run *= growth
        rows = active.select("doc_id", "sha", "gid", "uid", F.substring("rest", 1, run).alias("head"), (F.length("rest") <= run).alias("ended"), F.expr(f"substring(rest, {run + 1})").alias("tail"))
        first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("uid").alias("uid"))
        split = rows.groupBy("gid", "head", "ended").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"), F.min("uid").alias("next")).where("n > 1")
        split = scratch.write(split, "split")
        joined = _join(rows, split, ["gid", "head", "ended"])
        open_ = F.col("n").isNotNull() & ~F.col("ended")
        level = scratch.write(
            joined.select(
                "doc_id", "sha", "uid", open_.alias("open"),
                F.when(open_, F.col("next")).alias("gid"), F.when(open_, F.col("tail")).alias("rest"),
                F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.id")).alias("keep_id"),
                F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                (F.col("n").isNull() | (F.col("uid") == F.col("first.uid"))).alias("kept"),
            ),
            "level",
        )
        done.append(level.where("NOT open").select("doc_id", "keep_id", "group_size", "kept", "sha"))
        active = level.where("open").select("doc_id", "sha", "gid", "uid", "rest")
        scratch.drop(split)
        scratch.release()
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("sha", "text_sha256")
