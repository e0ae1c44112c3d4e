"""Removal of repeated substrings with a common-prefix interval tree.

A byte is removed when a string of ``least`` bytes that covers it also starts
earlier (in a smaller doc_id, or earlier in the same document).

1. Every window of ``least`` bytes has an anchor: its least GRAM-byte gram by
   hash, leftmost of equals.  Windows in a row with one anchor are a run.  Equal
   windows have equal anchors at the same place, so they meet when runs are dealt
   out by the anchor's hash; text that holds no repeated anchor never moves here.
2. Of runs that agree in their whole extent all but the first are covered at
   once, on the map side where they lie together and else in their bucket.
3. Where an anchor has several different runs, one of each kind fetches its
   bytes.  The suffixes from the anchors are sorted; a stack scan over the common
   prefixes of neighbours yields the intervals of the suffix tree, and within an
   interval the same is done leftwards from the anchors.  A node of the left tree
   is a string that its members cannot all extend to the left by one byte, a
   member set of the right tree one that they cannot all extend to the right: a
   maximal repeat with all its occurrences.  All but its first are covered.
4. Covers are united per document.

An anchor with more than ``most`` different runs (a passage within ever
different text, at its edges) is settled exactly by grouping its windows, which
no single task has to hold.

Defined results: null text is empty; documents shorter than ``least`` lose
nothing; a very long text is worked on whole; rows that repeat a doc_id are one
document for precedence and their covers are united; a null doc_id comes after all others; an empty table has no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import _TABLE, U64, blocks, by_bucket, mix, pack, powers
from .scratch import Scratch, parts_for

#: Bytes of a repeat, of an anchor gram, and the different runs of one anchor that a task compares.
LEAST, GRAM, MOST = 100, 32, 100_000
#: Runs gathered per task before they are handed on.
FLUSH = 1_000_000
LAST = (1 << 63) - 1

_COVERS = "kind int, slot int, h binary, g binary, doc binary, start binary, left binary, n binary"
_NAMES = ["kind", "slot", "h", "g", "doc", "start", "left", "n"]


def runs(data: np.ndarray, offs: np.ndarray, least: int = LEAST, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: anchor hash h, hash g of the whole extent, row, start in the document, left (bytes before the anchor), n (windows)."""
    sizes = np.diff(offs) - least + 1
    sizes[sizes < 0] = 0
    total = int(sizes.sum())
    if not total:
        z = np.zeros(0, np.int64)
        return {"h": z.view(U64), "g": z.view(U64), "row": z, "start": z, "left": z, "n": z}
    up, down = powers(len(data))
    upto = np.empty(len(data) + 1, U64)
    upto[0] = 0
    np.cumsum(_TABLE[data] * up, out=upto[1:])
    grams = mix((upto[gram:] - upto[:-gram]) * down[: len(data) - gram + 1])
    low = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, have = least - gram + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    row = np.repeat(np.arange(len(sizes)), sizes)
    window = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offs[row]
    anchor = (low[window] & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.ones(total, bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, total))
    start, anchor, row = window[at], anchor[at], row[at]
    end = start + n - 1 + least
    left = anchor - start
    whole = mix((upto[end] - upto[start]) * down[start] + ((end - start) * 1024 + left).astype(U64), 9)
    return {"h": grams[anchor], "g": whole, "row": row, "start": start - offs[row], "left": left, "n": n}


def _covers(parts: int, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Covers packed by the documents' part."""
    order, there, cuts = by_bucket(part_of(doc, parts), parts)
    nothing = pa.nulls(len(there), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ones(len(there)), pa.int32()), pa.array(there, pa.int32()), nothing, nothing, pack(doc[order].astype(np.int64), cuts), pack(start[order].astype(np.int64), cuts), pack(end[order].astype(np.int64), cuts), nothing], _NAMES
    )


def part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix(np.asarray(doc, np.int64).view(U64), 13) % U64(parts)).astype(np.int64)


def _firsts(h: np.ndarray, g: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each run is the first of those that agree in h and g."""
    order = np.lexsort((start, doc, g, h))
    a, b = h[order], g[order]
    lead = np.ones(len(order), bool)
    lead[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.zeros(len(order), bool)
    out[order[lead]] = True
    return out


def _scan(docs: DataFrame, least: int, gram: int, slots: int, parts: int) -> DataFrame:
    """Runs by bucket (kind 0) after combining equal ones of a task, and the covers of those (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            r = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
            first = _firsts(r["h"], r["g"], r["doc"], r["start"])
            rest = ~first
            if rest.any():
                yield _covers(parts, r["doc"][rest], r["start"][rest], (r["start"] + r["n"] - 1 + least)[rest])
            order, there, cuts = by_bucket((r["h"][first] >> U64(33)).astype(np.int64) % slots, slots)
            col = {k: v[first][order] for k, v in r.items()}
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(there)), pa.int32()), pa.array(there, pa.int32()), pack(col["h"], cuts), pack(col["g"], cuts), pack(col["doc"], cuts),
                 pack(col["start"].astype(np.uint32), cuts), pack(col["left"].astype(np.uint16), cuts), pack(col["n"].astype(np.uint16), cuts)], _NAMES)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offs in blocks(batch.column(1)):
                found = runs(data, offs, least, gram)
                found["doc"] = ids[lo + found.pop("row")].astype(np.int64)
                if len(found["h"]):
                    held.append(found)
                    size += len(found["h"])
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return docs.mapInArrow(run, _COVERS)


def _bucket(least: int, parts: int):
    def settle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Of one bucket of runs: covers of all but the first of equal runs; and requests for one run of each kind of anchors with several kinds."""
        r = {k: np.concatenate([np.frombuffer(x, t) for x in rows[k]]) for k, t in (("h", U64), ("g", U64), ("doc", np.int64), ("start", np.uint32), ("left", np.uint16), ("n", np.uint16))}
        first = _firsts(r["h"], r["g"], r["doc"], r["start"])
        rest = ~first
        start = r["start"].astype(np.int64)
        out = [_covers(parts, r["doc"][rest], start[rest], start[rest] + r["n"][rest] - 1 + least).to_pandas()]
        one = np.flatnonzero(first)
        order = one[np.argsort(r["h"][one], kind="stable")]
        h = r["h"][order]
        alike = np.zeros(len(h), bool)
        alike[1:] = h[1:] == h[:-1]
        alike[:-1] |= alike[1:]
        ask = order[alike]
        if len(ask):
            by, there, cuts = by_bucket(part_of(r["doc"][ask], parts), parts)
            ask = ask[by]
            packed = pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(there), 2), pa.int32()), pa.array(there, pa.int32()), pack(r["h"][ask], cuts), pa.nulls(len(there), pa.binary()), pack(r["doc"][ask], cuts),
                 pack(start[ask], cuts), pack(r["left"][ask], cuts), pack(r["n"][ask], cuts)], _NAMES)
            out.append(packed.to_pandas())
        return pd.concat(out, ignore_index=True)

    return settle


def _fetch(least: int):
    def fetch(key: tuple, docs: pa.Table, asked: pa.Table) -> pa.Table:
        """The bytes of the requested runs of one part of the documents."""
        cols = {k: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in asked.column(k)] or [np.zeros(0, t)]) for k, t in (("h", np.int64), ("doc", np.int64), ("start", np.int64), ("left", np.uint16), ("n", np.uint16))}
        order = np.argsort(cols["doc"], kind="stable")
        doc = cols["doc"][order]
        pick, texts = [], []
        ids = docs.column("doc_id").to_numpy()
        text = docs.column("text").combine_chunks() if docs.num_rows else None
        for i in np.argsort(ids, kind="stable").tolist():
            lo, hi = np.searchsorted(doc, ids[i]), np.searchsorted(doc, ids[i], "right")
            if lo == hi:
                continue
            raw = text[i].as_buffer().to_pybytes() if text[i].is_valid else b""
            for k in order[lo:hi].tolist():
                s = int(cols["start"][k])
                e = s + int(cols["n"][k]) - 1 + least
                if e <= len(raw):
                    pick.append(k)
                    texts.append(raw[s:e])
        return pa.table({"h": cols["h"][pick], "doc": cols["doc"][pick], "start": cols["start"][pick], "left": cols["left"][pick].astype(np.int32), "bytes": pa.array(texts, pa.binary())})

    return fetch


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def intervals(lcp: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, lo, hi) of every interval of two or more sorted suffixes lo..hi; lcp[i] is that of i and i+1. Children come first."""
    stack = [(-1, 0)]
    for i, depth in enumerate([*lcp, -1]):
        lo = i
        while stack and stack[-1][0] > depth:
            top, lo = stack.pop()
            yield top, lo, i
        if not stack or stack[-1][0] < depth:
            stack.append((depth, lo))


def anchored_repeats(contexts: Sequence[tuple[int, bytes]], least: int = LEAST) -> Iterator[tuple[int, list[tuple[int, list[int]]]]]:
    """Maximal repeats of at least ``least`` bytes around the anchors of (left, bytes).

    For each node of the right tree: how far its members agree after the anchor,
    and the nodes of its left tree (deepest first), where the next byte to the
    left differs, as (how far they agree before it, all occurrences).
    """
    right = [c[left:] for left, c in contexts]
    left = [c[:k][::-1] for k, c in contexts]
    order = sorted(range(len(contexts)), key=right.__getitem__)
    lcp = [common(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    for depth, lo, hi in intervals(lcp):
        members = sorted(order[lo : hi + 1], key=left.__getitem__)
        back = [common(left[a], left[b]) for a, b in zip(members, members[1:], strict=False)]
        groups = [(ahead, members[i : j + 1]) for ahead, i, j in intervals(back) if ahead + depth >= least]
        if groups:
            yield depth, groups


def settle_anchor(contexts: Sequence[tuple[int, bytes]], rank: Sequence[tuple[int, int]], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Covers (context, bytes before, bytes after its anchor) of all but the first occurrence of each maximal repeat.

    Within a right node an occurrence is covered where it first meets an earlier
    one: nodes above reach no further to the left.
    """
    if len(contexts) == 2:
        (k, a), (m, b) = contexts
        right, left = common(a[k:], b[m:]), common(a[:k][::-1], b[:m][::-1])
        return [(0 if rank[1] < rank[0] else 1, left, right)] if left + right >= least and rank[0] != rank[1] else []
    out = []
    for depth, groups in anchored_repeats(contexts, least):
        done: set[int] = set()
        for ahead, members in groups:
            first = min(rank[m] for m in members)
            for m in members:
                if rank[m] != first and m not in done:
                    done.add(m)
                    out.append((m, ahead, depth))
    return out


def _compare(least: int, parts: int):
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h", kind="stable")
        h = rows["h"].to_numpy()
        doc, start, left, text = rows["doc"].tolist(), rows["start"].tolist(), rows["left"].tolist(), rows["bytes"].tolist()
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])).tolist()
        d, s, e = [], [], []
        for lo, hi in zip(edge, edge[1:], strict=False):
            if hi - lo < 2:
                continue
            for m, before, after in settle_anchor(list(zip(left[lo:hi], text[lo:hi], strict=True)), list(zip(doc[lo:hi], start[lo:hi], strict=True)), least):
                anchor = start[lo + m] + left[lo + m]
                d.append(doc[lo + m])
                s.append(anchor - before)
                e.append(anchor + after)
        return _covers(parts, np.array(d, np.int64), np.array(s, np.int64), np.array(e, np.int64)).to_pandas()

    return compare


def _by_windows(contexts: DataFrame, least: int, parts: int) -> DataFrame:
    """Covers for anchors with very many kinds of runs: their windows are grouped by 128 bits of hash."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offs in blocks(batch.column(2)):
                sizes = np.maximum(np.diff(offs) - least + 1, 0)
                row = np.repeat(np.arange(len(sizes)), sizes)
                inner = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at = inner + offs[row]
                up, down = powers(len(data))
                upto = np.concatenate([np.zeros(1, U64), np.cumsum(_TABLE[data] * up, dtype=U64)])
                other = np.concatenate([np.zeros(1, U64), np.cumsum(mix(data.astype(U64), 77) * up, dtype=U64)])
                w1, w2 = (mix((x[at + least] - x[at]) * down[at], 15).view(np.int64) for x in (upto, other))
                doc, start = (batch.column(k).to_numpy()[lo + row] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w1, w2, doc, start + inner)], ["w1", "w2", "doc", "start"])

    windows = contexts.select("doc", "start", "bytes").mapInArrow(explode, "w1 long, w2 long, doc long, start long")
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("w1", "w2", "first")
    late = windows.join(first, ["w1", "w2"]).where(F.struct("doc", "start") != F.col("first"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                doc, start = (batch.column(k).to_numpy() for k in (0, 1))
                yield _covers(parts, doc, start, start + least)

    return late.select("doc", "start").mapInArrow(cover, _COVERS)


def _cut(docs: pa.Table, covers: pa.Table) -> pa.Table:
    """The documents of one part without their covered bytes."""
    doc, start, end = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in covers.column(k)] or [np.zeros(0, np.int64)]) for k in ("doc", "start", "left"))
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    ids = docs.column("doc_id").to_numpy()
    text = docs.column("text").combine_chunks() if docs.num_rows else []
    sizes, begins, ends, kept = [], [], [], []
    for i in range(docs.num_rows):
        raw = text[i].as_buffer().to_pybytes() if text[i].is_valid else b""
        lo, hi = np.searchsorted(doc, ids[i]), np.searchsorted(doc, ids[i], "right")
        sizes.append(len(raw))
        a, b = start[lo:hi], np.maximum.accumulate(end[lo:hi]) if hi > lo else end[lo:hi]
        b = np.minimum(b, len(raw))
        a, b = a[a < len(raw)], b[a < len(raw)]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] > b[:-1]
        at = np.flatnonzero(new)
        a, b = a[at], b[np.append(at[1:], len(b)) - 1] if len(at) else b
        begins.append(a.tolist())
        ends.append(b.tolist())
        edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
        kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
    ids = pa.array(ids, mask=ids == LAST)
    return pa.table({"doc_id": ids, "n_bytes": pa.array(sizes, pa.int64()), "starts": pa.array(begins, pa.list_(pa.int64())), "ends": pa.array(ends, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, most: int = MOST, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, starts and ends of the removed byte ranges (maximal), kept (binary)."""
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    slots, parts = parts_for(docs, 12), parts_for(docs, 6)
    scanned = scratch.write(_scan(base, least, gram, slots, parts), "runs")
    settled = scratch.write(scanned.where("kind = 0").groupBy("slot").applyInPandas(_bucket(least, parts), _COVERS), "settled")
    scratch.release()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(part_of(batch.column(0).to_numpy(), parts), pa.int32()), *batch.columns], ["slot", "doc_id", "text"])

    by_part = base.mapInArrow(dealt, "slot int, doc_id long, text string")
    asked = settled.where("kind = 2")
    fetch = _fetch(least)
    contexts = by_part.groupBy("slot").cogroup(asked.groupBy("slot")).applyInArrow(lambda docs_, asked_: fetch((), docs_, asked_), "h long, doc long, start long, left int, bytes binary")
    contexts = scratch.write(contexts, "contexts")
    scratch.release()
    wide = scratch.write(contexts.groupBy("h").count().where(F.col("count") > most).select("h"), "wide")
    n = max(8, contexts.count() // 20_000)
    narrow = contexts
    covers = scanned.where("kind = 1").unionByName(settled.where("kind = 1"))
    if not wide.isEmpty():
        narrow = contexts.join(wide, "h", "left_anti")
        covers = covers.unionByName(_by_windows(contexts.join(wide, "h", "left_semi"), least, parts))
    compared = narrow.withColumn("slot2", F.pmod(F.xxhash64("h"), F.lit(n)).cast("int")).groupBy("slot2").applyInPandas(_compare(least, parts), _COVERS)
    covers = scratch.write(covers.unionByName(compared).select("slot", "doc", "start", "left"), "covers")
    scratch.drop(scanned, settled, contexts)
    scratch.release()
    return by_part.groupBy("slot").cogroup(covers.groupBy("slot")).applyInArrow(_cut, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")
