"""Best-fit-decreasing packing of tokenised documents into fixed-size sequences.

Lengths are whole numbers up to the capacity, so the state of best-fit
decreasing over the *whole* corpus is a histogram of lengths and, per remaining
capacity, runs of equally filled bins.  The driver packs the histogram with a
segment tree over remaining capacities (tightest open bin in logarithmic time;
all items of one length that meet equally filled bins are placed in one step)
and so reproduces document-by-document best-fit decreasing exactly, with work
and memory that depend on the capacity alone.  Executors rank the pieces of
each length and look their place up in that plan.

Defined results: null or empty text is one piece that holds the end id only;
repeated rows are packed once per row; ties between equal lengths go by
(doc_id, piece); a very long text is encoded whole and cut into full pieces, the
last of which may be shorter; an empty table packs to nothing; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .encoding import encoder, tokenizer_path
from .scratch import Scratch, parts_for

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def encode_pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document (``ids``: little-endian uint32), the end id included."""
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            doc_ids = batch.column(0)
            for lo, ids, counts in enc.encode(batch.column(1)):
                # the end id after each document
                at = np.cumsum(counts)
                ids = np.insert(ids, at, np.uint32(end_id)).astype("<u4")
                counts = counts + 1
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                begin = (np.cumsum(counts) - counts)[row] + start
                length = np.minimum(counts[row] - start, capacity)
                raw = pa.py_buffer(ids)
                cuts = np.append(begin, len(ids)).astype(np.int32) * 4
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(lo + row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts), raw])],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class CapacityTree:
    """Segment tree over capacities 0..top: which have open bins; finds the tightest that fits."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        self.any[i] = is_open
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int:
        """The least open capacity of at least ``need``, or -1."""
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


class Placement(NamedTuple):
    """Items rank_lo..rank_hi of one length go, per_bin to a bin, to bins bin_lo, bin_lo+1, ... from ``offset`` on."""

    length: int
    rank_lo: int
    rank_hi: int
    per_bin: int
    bin_lo: int
    offset: int


def plan_best_fit(counts: Mapping[int, int], capacity: int) -> list[Placement]:
    """Best-fit decreasing of ``counts[length]`` items of each length into bins of ``capacity``."""
    tree, open_bins, bins = CapacityTree(capacity), {}, 0
    plan: list[Placement] = []

    def put(room: int, lo: int, n: int) -> None:
        if room > 0 and n > 0:
            open_bins.setdefault(room, []).append((lo, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit capacity {capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, lo = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            else:
                lo, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            per = room // length
            full = min(n, left // per)
            if full:
                plan.append(Placement(length, rank, rank + full * per, per, lo, capacity - room))
                put(room - per * length, lo, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:  # fewer than per items are left: they share one bin
                plan.append(Placement(length, rank, rank + left, left, lo + full, capacity - room))
                put(room - left * length, lo + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, lo + full, n - full)
    return plan


def best_fit_pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece"), scratch: Scratch | None = None) -> DataFrame:
    """``pieces`` (any columns; ``length`` from 1 to ``capacity``) with sequence_id and offset.

    ``pieces`` is written once and read back, so that ranks are taken of fixed rows.
    """
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    ties = [F.col(c) for c in order] + [F.col(c) for c, kind in pieces.dtypes if c not in order and kind in ("bigint", "int", "string", "double", "binary", "boolean")]
    fixed = scratch.write(pieces, "pieces")
    buckets = parts_for(fixed, 2)
    fixed = fixed.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = scratch.write(fixed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "counts")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), "_n")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # capacity rows at most
    plan = plan_best_fit(histogram, capacity)
    own = Window.partitionBy("length", "_bucket").orderBy(*ties)
    ranked = fixed.withColumn("_row", F.row_number().over(own)).join(counts.drop("_n"), ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    return _look_up(ranked, plan, [c for c in pieces.columns])


def _look_up(ranked: DataFrame, plan: list[Placement], keep: list[str]) -> DataFrame:
    """Places by binary search in the plan, whose size depends on the capacity and not on the corpus."""
    plan = sorted(plan)
    table = np.array(plan, np.int64).reshape(-1, len(Placement._fields))
    shared = ranked.sparkSession.sparkContext.broadcast(table)
    frame = ranked.select(*keep, "_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1]) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        span = int(t[:, 2].max()) + 1 if len(t) else 1
        key = t[:, 0] * span + t[:, 1]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            i = np.searchsorted(key, length * span + rank, "right") - 1
            item = rank - t[i, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(t[i, 4] + item // t[i, 3], pa.int64()), pa.array(t[i, 5] + item % t[i, 3] * length, pa.int64())],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return frame.mapInArrow(place, schema)


def sequences(placed: DataFrame, ids: str = "ids") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary), and the pieces in them by offset."""
    part = F.sort_array(F.collect_list(F.struct("offset", F.col(ids).alias("ids"), "doc_id", "piece", "length")))
    rows = placed.groupBy("sequence_id").agg(part.alias("p"))  # a sequence holds at most capacity ids
    return rows.select("sequence_id", F.expr("aggregate(p, binary(''), (a, x) -> concat(a, x.ids))").alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("pieces"))


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Digest rows of all pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = encode_pieces(docs, capacity, end_id, tokenizer)
    return best_fit_pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
