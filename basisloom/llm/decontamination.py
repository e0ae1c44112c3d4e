"""Benchmark decontamination by winnowing.

Of every run of nine consecutive 5-word grams the least hash is kept as a
fingerprint, in documents and benchmark items alike, so that any 13 words in a
row that both have leave a fingerprint in common.  Document fingerprints are
joined with the benchmark's; each hit is extended to the 13-word windows around
it that are windows of an item.  Items of fewer than 13 words are one window
each and are matched as grams of their own length (at most 12 lengths).  The
benchmark is the stated query set: it is taken in blocks of a bounded number of
bytes, each broadcast once; a document meets them one after another in one task
and unites its hits, whatever their number.

Words are runs of ASCII letters and digits and of all non-ASCII characters,
with A-Z folded.

Defined results: null or empty text has no words and no hits; an item without
words matches nothing; rows that repeat an item_id are one item with all their
windows; a null item_id is the item -1; an empty benchmark leaves every
document clean; other columns are ignored; a very long text is one block of its
own and is matched whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM, MIX, U64, blocks, gram_hashes, mix, span_hashes, words

WINDOW, GRAM = 13, 5
#: Benchmark text per block.
BLOCK_BYTES = 16_000_000


def winnow(grams: np.ndarray, edges: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Fingerprint positions of all documents; runs of grams that leave a document are not looked at."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = grams[width - 1 : width - 1 + n].copy()
    place = np.arange(width - 1, width - 1 + n)
    for k in range(width - 2, -1, -1):
        g = grams[k : k + n]
        better = g < least
        np.copyto(least, g, where=better)
        np.copyto(place, np.arange(k, k + n), where=better)
    doc = np.searchsorted(edges, np.arange(n), "right") - 1
    return np.unique(place[np.arange(n) + width + gram - 1 <= edges[doc + 1]])


class Windows:
    """The windows and fingerprints of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        prints = [np.zeros(0, U64)]
        for item, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
            h = span_hashes(data, starts, ends)
            if not len(h):
                continue
            n = min(window, len(h))
            w = gram_hashes(h, n)
            found.setdefault(n, []).append((w, np.full(len(w), item, np.int64)))
            if n == window:
                g = gram_hashes(h, gram)
                prints.append(g[winnow(g, np.array([0, len(h)]), window - gram + 1, gram)])
        self.prints = np.unique(np.concatenate(prints))
        #: length -> distinct window hashes in order, cuts, and the items of each window
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, pairs in found.items():
            w, i = (np.concatenate(x) for x in zip(*pairs, strict=True))
            pair = np.unique(np.stack([w.view(np.int64), i]), axis=1)
            w, i = pair[0].view(U64), pair[1]
            order = np.argsort(w, kind="stable")
            w, i = w[order], i[order]
            keys, first = np.unique(w, return_index=True)
            self.by_length[n] = (keys, np.append(first, len(w)), i)


def _member(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in the sorted keys, -1 if absent."""
    if not len(keys) or not len(values):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def _grams(h: np.ndarray, edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-gram hashes and whether each lies within one document."""
    g = gram_hashes(h, n)
    doc = np.searchsorted(edges, np.arange(len(g)), "right") - 1
    return g, np.arange(len(g)) + n <= edges[doc + 1]


def match(data: np.ndarray, offs: np.ndarray, bench: Windows) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Words per document, and (first word, length, items) of every occurrence of a window, words counted over the block."""
    starts, ends, per_doc = words(data, offs, ALNUM)
    h = span_hashes(data, starts, ends)
    edges = np.concatenate([[0], np.cumsum(per_doc)])
    hits: list[tuple[int, int, np.ndarray]] = []
    for n, (keys, cuts, items) in bench.by_length.items():
        if n == bench.window:
            grams = gram_hashes(h, bench.gram)
            width = n - bench.gram + 1
            place = winnow(grams, edges, width, bench.gram)
            place = place[_member(bench.prints, grams[place]) >= 0]
            if not len(place):
                continue
            at = np.unique((place[:, None] - np.arange(width)[None, :]).ravel())
            at = at[(at >= 0) & (at + n <= len(h))]
            doc = np.searchsorted(edges, at, "right") - 1
            at = at[at + n <= edges[doc + 1]]
            full = np.full(len(at), n, U64)
            for k in range(n):
                full += h[at + k] * MIX[k]
            which = _member(keys, mix(full, n))
        else:
            g, inside = _grams(h, edges, n)
            which = np.where(inside, _member(keys, g), -1) if len(g) else np.zeros(0, np.int64)
            at = np.arange(len(g))
        for p, k in zip(at[which >= 0].tolist(), which[which >= 0].tolist(), strict=True):
            hits.append((p, n, items[cuts[k] : cuts[k + 1]]))
    return per_doc, hits


#: Indexes of this worker process, by block; the one in use is kept.
_indexes: dict[str, Windows] = {}


def _index(key: str, items: list[tuple[int, str]]) -> Windows:
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Windows(items)
    return _indexes[key]


def _scan(docs: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    """``docs`` (doc_id, text, ..., n_words, starts, ends, items) with the hits of one block of items united with those they have."""
    shared, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _index(key, shared.value)
        for batch in batches:
            for lo, hi, data, offs in blocks(batch.column(1)):
                per_doc, hits = match(data, offs, bench)
                edges = np.concatenate([[0], np.cumsum(per_doc)])
                s, e, items = (batch.column(k).slice(lo, hi - lo).to_pylist() for k in (-3, -2, -1))
                at = np.searchsorted(edges, [p for p, _, _ in hits], "right") - 1
                own: dict[int, list[tuple[int, int, np.ndarray]]] = {}
                for d, x in zip(at.tolist(), hits, strict=True):
                    own.setdefault(d, []).append(x)
                for d, found in own.items():
                    spans = _union([*zip(s[d], e[d], strict=True), *((p - edges[d], p - edges[d] + n) for p, n, _ in found)])
                    s[d], e[d] = [a for a, _ in spans], [b for _, b in spans]
                    items[d] = np.unique(np.concatenate([np.array(items[d], np.int64), *(i for _, _, i in found)])).tolist()
                kept = [batch.column(k).slice(lo, hi - lo) for k in range(batch.num_columns - 4)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(per_doc, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (s, e, items))], names)

    return docs.mapInArrow(scan, docs.schema)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((int(a), int(b)) for a, b in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_words, starts and ends of hit word ranges, n_hit, items, contaminated.

    The columns ``carry`` of ``docs`` come along, row by row.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in carry if c != "text"))
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(size) // block_bytes))
    none = F.array().cast("array<long>")
    hits = base.select("*", F.lit(0).cast("long").alias("n_words"), none.alias("starts"), none.alias("ends"), none.alias("items"))
    for k in range(n_blocks):  # blocks of a bounded size, one after another in the same tasks
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        hits = _scan(hits, [(r[0], r[1]) for r in rows.collect()])
    hits = hits.select("doc_id", *carry, "n_words", "starts", "ends", "items")
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    out = hits.withColumn("n_hit", n_hit)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
