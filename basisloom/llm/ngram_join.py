"""N-gram Jaccard self-join with filtering under several global token orders.

Documents are linked when the Jaccard similarity of their word-shingle sets is at
least the threshold.  Under any global order of tokens, two linked sets share a
token in their prefixes (of n - ceil(t n) + 1 tokens); a pair is a candidate only
if it does so under every one of several orders, and only candidates are compared
in full.  All orders put the tokens of a single document first, which no two
documents can share; the first order goes on by exact document frequency and then
by hash, the others by hashes of their own.

1. Equal sets are one class from the start: only its smallest doc_id is joined.
2. Every token travels to its bucket, where its documents are counted; a token
   that many documents of one task have travels there as a count, so that no hot
   token gathers in a bucket.  Only tokens of several documents come back, to the
   part of the documents they are in.  A document is then a record of its size and
   of those tokens; one whose prefix holds none of them has no candidates.
3. Of the documents with a token in their first prefix the fullest is the token's
   centre; a cell is a centre with all documents that share a token of it.  Two
   documents with a common token in their prefixes meet in its cell, once for all
   tokens with this centre.
4. A cell is dealt out in blocks that hold the centre too.  In a block the other
   orders are intersected, what is left is compared in full, and documents already
   linked through others are not compared again.
5. In a cell of several blocks whose documents are not all of one component yet,
   those outside its largest component are compared, in blocks, with all others.

So components are exact, no list is cut, and pairs are never written as rows: a
task returns at most one link per document it holds.

Defined results: null or empty text, and text of white space, has no shingles
and is linked with nothing; a text of fewer words than a shingle is one shingle;
a very long text is one set like any other; rows that repeat a doc_id are linked
with each other; a null doc_id is not joined and is its own (null) component; a
similarity of exactly the threshold links; an empty table has no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import U64, blocks, by_bucket, mix, pack, shingle_sets, spans
from .components import connected_components
from .scratch import Scratch, by_slot, few_rows, keep_only, parts_for

#: Words per shingle, threshold in hundredths, token orders.
WORDS, PERCENT, ORDERS = 5, 75, 3
#: Shingles gathered per task before they are handed on, and the documents of these beyond which a token is counted first.
FLUSH, COMMON = 1 << 20, 128
#: Documents of a cell in one block.
BLOCK_DOCS = 1024


def prefix_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def set_digests(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, and two 64-bit sums over the set; equal sets have equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in blocks(batch.column(1)):
                sets, sizes = shingle_sets(data, offs, words)
                upto = np.concatenate([[0], np.cumsum(sizes)])
                cols = []
                for seed in (21, 22):
                    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets, seed), dtype=U64)])
                    cols.append((total[upto[1:]] - total[upto[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(cols[0]), pa.array(cols[1])], ["doc_id", "n", "d1", "d2"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long")


# -- records: what documents share with others ------------------------------

_MOVED = "kind int, slot int, part int, tokens binary, docs binary, df binary"
#: To a bucket of tokens: postings, counts, postings of counted tokens (passed on); to a part of the documents: postings with
#: frequencies, postings without, frequencies, sizes.
POSTINGS, COUNTS, PASSED, KNOWN, OPEN, FREQUENCIES, SIZES = range(7)


def _moved(kind: int, slot: np.ndarray, part: np.ndarray, tokens: pa.Array | None, docs: pa.Array | None, df: pa.Array | None) -> pa.RecordBatch:
    cols = [pa.nulls(len(slot), pa.binary()) if c is None else c for c in (tokens, docs, df)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), kind), pa.int32()), pa.array(slot, pa.int32()), pa.array(part, pa.int32()), *cols], ["kind", "slot", "part", "tokens", "docs", "df"])


def _column(rows: pa.Table, name: str, kind: type = np.int64) -> np.ndarray:
    """The packed values of all rows, one after another."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in rows.column(name) if x.is_valid)])


def part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(U64), 13) % U64(parts)).astype(np.int64)


def bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> U64(32)) % U64(buckets)).astype(np.int64)


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _postings(docs: DataFrame, words: int, buckets: int, parts: int, common: int) -> DataFrame:
    def flush(tokens: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(tokens, kind="stable")
        first = starts_of(tokens[order])
        times = np.diff(np.append(first, len(tokens)))
        often = np.zeros(len(tokens), bool)
        often[order] = np.repeat(times > common, times)
        hot, count = tokens[order][first][times > common], times[times > common].astype(np.int64)
        order, there, cuts = by_bucket(bucket_of(hot, buckets), buckets)
        yield _moved(COUNTS, there, np.zeros(len(there)), pack(hot[order], cuts), None, pack(count[order], cuts))
        # spread over the buckets by the part they are for, whatever their token
        part = part_of(ids[often], parts)
        order, there, cuts = by_bucket(part, parts)
        yield _moved(PASSED, there % buckets, there, pack(tokens[often][order], cuts), pack(ids[often][order], cuts), None)
        tokens, ids = tokens[~often], ids[~often]
        order, there, cuts = by_bucket(bucket_of(tokens, buckets), buckets)
        yield _moved(POSTINGS, there, np.zeros(len(there)), pack(tokens[order], cuts), pack(ids[order], cuts), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offs in blocks(batch.column(1)):
                sets, sizes = shingle_sets(data, offs, words)
                held.append((sets, np.repeat(ids[lo:hi], sizes)))
                size += len(sets)
                if size >= FLUSH:
                    yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return docs.mapInArrow(run, _MOVED)


def _sizes(digests: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = (batch.column(i).to_numpy().astype(np.int64) for i in range(2))
            order, there, cuts = by_bucket(part_of(ids, parts), parts)
            yield _moved(SIZES, there, there, None, pack(ids[order], cuts), pack(n[order], cuts))

    return digests.mapInArrow(run, _MOVED)


def _count(parts: int):
    def reduce(rows: pa.Table) -> pa.Table:
        """Of one bucket: the tokens of several documents with their frequency, back by part of the documents."""
        kind = rows.column("kind").to_numpy()
        passed = rows.filter(pa.array(kind == PASSED))
        out = [_moved(OPEN, passed.column("part").to_numpy(), passed.column("part").to_numpy(), *(passed.column(c).combine_chunks() for c in ("tokens", "docs")), None)] if passed.num_rows else []
        rows = rows.filter(pa.array(kind != PASSED))
        singles = rows.filter(pa.array(rows.column("kind").to_numpy() == POSTINGS))
        tokens, ids = _column(singles, "tokens", U64), _column(singles, "docs")
        counted = rows.filter(pa.array(rows.column("kind").to_numpy() == COUNTS))
        hot, count = _column(counted, "tokens", U64), _column(counted, "df")
        order = np.argsort(hot, kind="stable")
        hot, count = hot[order], count[order]
        first = starts_of(hot)
        hot, count = hot[first], np.add.reduceat(count, first) if len(first) else count
        order = np.argsort(tokens, kind="stable")
        tokens, ids = tokens[order], ids[order]
        first = starts_of(tokens)
        times = np.diff(np.append(first, len(tokens)))
        if len(hot):
            count = count + np.searchsorted(tokens, hot, "right") - np.searchsorted(tokens, hot)
            at = np.minimum(np.searchsorted(hot, tokens[first]), len(hot) - 1)
            df = np.where(hot[at] == tokens[first], count[at], times)
            every = np.arange(parts)
            out.append(_moved(FREQUENCIES, every, every, pa.array([hot.tobytes()] * parts, pa.binary()), None, pa.array([count.tobytes()] * parts, pa.binary())))
        else:
            df = times
        df = np.repeat(df, times)
        tokens, ids, df = tokens[df > 1], ids[df > 1], df[df > 1].astype(np.int64)
        order, there, cuts = by_bucket(part_of(ids, parts), parts)
        out.append(_moved(KNOWN, there, there, pack(tokens[order], cuts), pack(ids[order], cuts), pack(df[order], cuts)))
        return pa.Table.from_batches(out)

    return reduce


_RECORD = "part int, doc_id long, n long, room int, tokens binary"


def _gather_records(percent: int):
    def reduce(rows: pa.Table) -> pa.Table:
        """Of one part: the documents whose first prefix has a token of several documents, with all such tokens in the first order.

        room: how many of these are in the prefix, after the tokens of this document only.
        """
        kind = rows.column("kind").to_numpy()
        take = lambda k: rows.filter(pa.array(kind == k))
        sizes, known, open_, freq = take(SIZES), take(KNOWN), take(OPEN), take(FREQUENCIES)
        ids, n = _column(sizes, "docs"), _column(sizes, "df")
        order = np.argsort(ids, kind="stable")
        ids, n = ids[order], n[order]
        tokens, doc, df = _column(known, "tokens", U64), _column(known, "docs"), _column(known, "df")
        if open_.num_rows:
            hot, count = _column(freq, "tokens", U64), _column(freq, "df")
            order = np.argsort(hot)
            more = _column(open_, "tokens", U64)
            tokens, doc = np.concatenate([tokens, more]), np.concatenate([doc, _column(open_, "docs")])
            df = np.concatenate([df, count[order][np.searchsorted(hot[order], more)]])
        which = np.searchsorted(ids, doc)
        have = np.bincount(which, minlength=len(ids))
        room = prefix_size(n, percent) - (n - have)
        some = room[which] > 0
        tokens, df, which = tokens[some], df[some], which[some]
        order = np.lexsort((mix(tokens, 31), df, which))
        tokens, which = tokens[order], which[order]
        there = which[starts_of(which)]
        cuts = np.append(starts_of(which), len(which))
        size = len(there)
        part = rows.column("part").to_numpy()[:1]
        return pa.table({"part": pa.array(np.repeat(part, size), pa.int32()), "doc_id": ids[there], "n": n[there], "room": pa.array(room[there], pa.int32()), "tokens": pack(tokens, cuts) if size else pa.array([], pa.binary())})

    return reduce


def records(docs: DataFrame, digests: DataFrame, words: int, percent: int, parts: int, scratch: Scratch, common: int = COMMON) -> DataFrame:
    """part, doc_id, n, room, tokens (uint64, first order) of documents that may have partners; ``docs`` have distinct doc_ids."""
    buckets = parts_for(docs, 2)
    moved = by_slot(_postings(docs, words, buckets, parts, common), "slot", buckets)
    counted = scratch.write(moved.groupBy("slot").applyInArrow(_count(parts), _MOVED), "counted")
    scratch.release()
    rows = _sizes(digests.select("doc_id", "n"), parts).unionByName(counted)
    out = scratch.write(by_slot(rows, "part", parts).groupBy("part").applyInArrow(_gather_records(percent), _RECORD), "records")
    scratch.drop(counted)
    scratch.release()
    return out


# -- cells: documents that share prefix tokens under the first order ---------


def _token_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a binary column, and their offsets by row."""
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.frombuffer(flat.tobytes(), U64), (offs - offs[0]) // 8


def _fullest(token: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per token the documents and, of these, the one with the greatest share of its tokens in others; ties: larger, then smaller id.

    columns: documents, share in millionths, size, count.
    """
    doc, share, n, count = columns
    order = np.lexsort((doc, -n, -share, token))
    token, doc, share, n, count = (x[order] for x in (token, doc, share, n, count))
    first = starts_of(token)
    return token[first], doc[first], share[first], n[first], np.add.reduceat(count, first) if len(first) else count[first]


_LEADS = "bucket int, part int, tokens binary, docs binary, share binary, n binary, count binary"
_LEAD_NAMES = ["bucket", "part", "tokens", "docs", "share", "n", "count"]


def _leads(rows: DataFrame, buckets: int) -> DataFrame:
    """Prefix tokens by bucket, of each task and part the fullest document and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, doc, n, room = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
            flat, offs = _token_slices(batch.column(4))
            share = (offs[1:] - offs[:-1]) * 1_000_000 // np.maximum(n, 1)
            for p in np.unique(part).tolist():
                mine = np.flatnonzero(part == p)
                at, row = spans(offs[mine], room[mine]), np.repeat(mine, room[mine])
                found = _fullest(flat[at], doc[row], share[row], n[row], np.ones(len(row), np.int64))
                order, there, cuts = by_bucket(bucket_of(found[0], buckets), buckets)
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(np.full(len(there), p), pa.int32()), *(pack(x[order], cuts) for x in found)], _LEAD_NAMES)

    return rows.mapInArrow(run, _LEADS)


def _centres(rows: pa.Table) -> pa.Table:
    """Of one bucket: the centre of each token of several documents, back to the parts that have the token."""
    sizes = [len(x.as_buffer()) // 8 for x in rows.column("tokens")]
    token = _column(rows, "tokens", U64)
    cols = [_column(rows, c) for c in ("docs", "share", "n", "count")]
    key, centre, _, _, count = _fullest(token, *cols)
    at = np.searchsorted(key, token)
    part = np.repeat(rows.column("part").to_numpy().astype(np.int64), sizes)[count[at] > 1]
    at = at[count[at] > 1]
    order = np.lexsort((at, part))
    part, at = part[order], at[order]
    new = np.concatenate([[True], (part[1:] != part[:-1]) | (at[1:] != at[:-1])]) if len(part) else np.zeros(0, bool)
    part, at = part[new], at[new]
    first = starts_of(part)
    cuts = np.append(first, len(part))
    return pa.table({"part": pa.array(part[first], pa.int32()), "tokens": pack(key[at], cuts) if len(first) else pa.array([], pa.binary()), "docs": pack(centre[at], cuts) if len(first) else pa.array([], pa.binary())})


_CELL = "cell long, doc_id long, n long, room int, tokens binary"


def _enter(rows: pa.Table, replies: pa.Table) -> pa.Table:
    """Of one part: its documents, once in each cell of a token in their prefix."""
    key, centre = _column(replies, "tokens", U64), _column(replies, "docs")
    if not rows.num_rows or not len(key):
        return pa.table({"cell": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "room": pa.array([], pa.int32()), "tokens": pa.array([], pa.binary())})
    order = np.argsort(key, kind="stable")
    key, centre = key[order], centre[order]
    room = rows.column("room").to_numpy().astype(np.int64)
    tokens = rows.column("tokens").combine_chunks()
    flat, offs = _token_slices(tokens)
    token, row = flat[spans(offs[:-1], room)], np.repeat(np.arange(len(room)), room)
    at = np.minimum(np.searchsorted(key, token), len(key) - 1)
    row, cell = row[key[at] == token], centre[at[key[at] == token]]
    pair = np.unique(np.stack([row, cell]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
    take = pa.array(pair[0])
    return pa.table({"cell": pair[1], **{c: rows.column(c).combine_chunks().take(take) for c in ("doc_id", "n", "room")}, "tokens": tokens.take(take)})


def cells(found: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """cell, and the record of each document in it."""
    buckets = parts_for(found, 3)
    leads = by_slot(_leads(found, buckets), "bucket", buckets)
    replies = scratch.write(leads.groupBy("bucket").applyInArrow(_centres, "part int, tokens binary, docs binary"), "centres")
    left, right = (by_slot(x, "part", parts).groupBy("part") for x in (found, replies))
    out = scratch.write(left.cogroup(right).applyInArrow(_enter, _CELL), "cells")
    scratch.drop(replies)
    return out


# -- comparison within tasks --------------------------------------------------


class Block:
    """Documents of one block of a cell, ready to be compared with any one of them."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, room: np.ndarray, flat: np.ndarray, offs: np.ndarray, percent: int = PERCENT, orders: int = ORDERS):
        self.ids, self.n, self.percent = ids, n, percent
        values, code = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(len(values), bool)
        self.have = np.diff(offs)
        self.full = (code, offs[:-1], self.have)
        room = np.minimum(room, self.have)
        self.prefixes = [(code, offs[:-1], room)]
        row = np.repeat(np.arange(len(ids)), self.have)
        for k in range(1, orders):
            order = np.lexsort((mix(flat, 40 + k), row))
            self.prefixes.append((code[order], offs[:-1], room))

    def _shared(self, sets: tuple[np.ndarray, np.ndarray, np.ndarray], one: int, others: np.ndarray) -> np.ndarray:
        """How many tokens of ``one`` each of the others has."""
        code, start, size = sets
        mine = code[start[one] : start[one] + size[one]]
        self.mark[mine] = True
        got = self.mark[code[spans(start[others], size[others])]]
        self.mark[mine] = False
        upto = np.concatenate([[0], np.cumsum(got)])
        ends = np.cumsum(size[others])
        return upto[ends] - upto[ends - size[others]]

    def linked(self, one: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that are linked with ``one``: sizes, then the prefixes under every order, then whole sets."""
        n, m = self.n[one], self.n[others]
        need = -(-self.percent * (n + m) // (100 + self.percent))  # least overlap of linked sets
        others = others[np.minimum(np.minimum(n, m), np.minimum(self.have[one], self.have[others])) >= need]
        for prefix in self.prefixes:
            if len(others):
                others = others[self._shared(prefix, one, others) > 0]
        if not len(others):
            return others
        common = self._shared(self.full, one, others)
        return others[100 * common >= self.percent * (n + self.n[others] - common)]

    def links(self, queries: np.ndarray, others: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
        """Links (as rows) that join groups; documents of one group are not compared. Within reach of the links ``group`` is made equal."""
        out = []
        for q in queries.tolist():
            rest = others[group[others] != group[q]]
            if not len(rest):
                continue
            hits = self.linked(q, rest)
            for g, at in zip(*np.unique(group[hits], return_index=True), strict=True):
                out.append((q, int(hits[at])))
                group[group == g] = group[q]
        return out


def _by_cell(rows: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    """The rows of one slot, cell by cell."""
    rows = rows.sort_by([(k, "ascending") for k in keys])
    cols = [rows.column(k).to_numpy() for k in keys]
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    edges = np.append(np.flatnonzero(new), rows.num_rows).tolist()
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield rows.slice(lo, hi - lo)


def _block(rows: pa.Table, percent: int, orders: int) -> Block:
    flat, offs = _token_slices(rows.column("tokens").combine_chunks())
    return Block(rows.column("doc_id").to_numpy(), rows.column("n").to_numpy(), rows.column("room").to_numpy().astype(np.int64), flat, offs, percent, orders)


_LINKS = "a long, b long"


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    ab = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.table({"a": ab.min(axis=1), "b": ab.max(axis=1)} if len(ab) else {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def within_blocks(entered: DataFrame, many: DataFrame, percent: int, orders: int) -> DataFrame:
    """Links that join documents within blocks of cells, the centre being in each block. ``many``: cells of several blocks, and how many."""
    slots = parts_for(entered, 2)

    def compare(rows: pa.Table) -> pa.Table:
        out = []
        for one in _by_cell(rows, ["cell", "block"]):
            block = _block(one, percent, orders)
            m = len(block.ids)
            order = np.lexsort((block.ids, -block.n, -(block.have / block.n), block.ids != one.column("cell")[0].as_py()))
            out += [(int(block.ids[a]), int(block.ids[b])) for a, b in block.links(order, np.arange(m), np.arange(m))]
        return _links(out)

    rows = entered.join(few_rows(many.select("cell", "n_blocks")), "cell", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    mine = F.array(F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("n_blocks").cast("int") - 1)
    rows = rows.withColumn("block", F.explode(F.when(F.col("doc_id") == F.col("cell"), every).otherwise(mine))).drop("n_blocks")
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("cell", "block"), F.lit(slots)).cast("int"))
    return by_slot(rows, "slot", slots).groupBy("slot").applyInArrow(compare, _LINKS)


def across_blocks(entered: DataFrame, many: DataFrame, labels: DataFrame, percent: int, orders: int, scratch: Scratch, block_docs: int) -> DataFrame:
    """Links between blocks: documents outside a cell's largest component against all of the cell."""
    rows = entered.join(few_rows(many.select("cell")), "cell")
    rows = scratch.write(rows.join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "labelled")
    sizes = rows.groupBy("cell", "component").count().groupBy("cell").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.max("count").alias("largest"), F.sum("count").alias("docs"))
    mixed = scratch.write(sizes.where("largest < docs"), "mixed")
    rows = rows.join(few_rows(mixed), "cell")
    pieces = lambda n, size: F.ceil(F.col(n) / F.lit(size)).cast("int")
    rows = rows.withColumn("outside", F.col("docs") - F.col("largest")).withColumn("n_q", pieces("outside", block_docs)).withColumn("n_r", pieces("docs", 4 * block_docs))
    own = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = ["cell", "doc_id", "n", "room", "tokens", "component"]
    asked = rows.where("component != main").select(*keep, F.lit(True).alias("query"), own("n_q", 1).alias("q"), every("n_r").alias("r"))
    there = rows.select(*keep, F.lit(False).alias("query"), own("n_r", 2).alias("r"), every("n_q").alias("q")).select(asked.columns)
    slots = parts_for(entered, 2)

    def compare(rows: pa.Table) -> pa.Table:
        out = []
        for one in _by_cell(rows, ["cell", "q", "r"]):
            block = _block(one, percent, orders)
            query = one.column("query").to_numpy(zero_copy_only=False)
            _, group = np.unique(one.column("component").to_numpy(), return_inverse=True)
            out += [(int(block.ids[a]), int(block.ids[b])) for a, b in block.links(np.flatnonzero(query), np.flatnonzero(~query), group)]
        return _links(out)

    dealt = asked.unionByName(there).withColumn("slot", F.pmod(F.xxhash64("cell", "q", "r"), F.lit(slots)).cast("int"))
    return by_slot(dealt, "slot", slots).groupBy("slot").applyInArrow(compare, _LINKS)


def similar_links(docs: DataFrame, digests: DataFrame, words: int, percent: int, orders: int, scratch: Scratch, block_docs: int = BLOCK_DOCS, common: int = COMMON) -> DataFrame:
    """Links (a, b) that join all documents of a component; ``docs`` have distinct, non-null doc_ids and different sets."""
    parts = parts_for(docs, 3)
    found = records(docs, digests, words, percent, parts, scratch, common)
    entered = cells(found, parts, scratch)
    scratch.drop(found)
    many = entered.groupBy("cell").count().where(F.col("count") > block_docs).select("cell", F.ceil(F.col("count") / F.lit(block_docs)).cast("int").alias("n_blocks"))
    many = scratch.write(many, "many")
    links = scratch.write(within_blocks(entered, many, percent, orders), "links")
    if not many.isEmpty():
        links = links.unionByName(scratch.write(across_blocks(entered, many, connected_components(links, scratch), percent, orders, scratch, block_docs), "more_links"))
    scratch.release()
    return links


def similarity_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, orders: int = ORDERS, scratch: Scratch | None = None, block_docs: int = BLOCK_DOCS, common: int = COMMON) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    scratch = scratch or Scratch(docs.sparkSession, "ngrams")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not base.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _of_rows(base, words, percent, orders, scratch, block_docs, common)
    digests = scratch.write(set_digests(base, words), "digests")
    sized = digests.where("n > 0 AND doc_id IS NOT NULL")
    classes = sized.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    many = scratch.write(classes.where("rows > 1"), "classes")
    # members of a class other than its first, by a join that a hot class does not gather in one task
    member = sized.join(few_rows(many.select("n", "d1", "d2", "first")), ["n", "d1", "d2"]).where("doc_id != first")
    copies = scratch.write(member.select(F.col("first").alias("a"), F.col("doc_id").alias("b")), "copies")
    dropped = copies.select(F.col("b").alias("doc_id"))
    firsts = keep_only(base.where("doc_id IS NOT NULL"), dropped, "doc_id", "left_anti")
    links = similar_links(firsts, keep_only(sized, dropped, "doc_id", "left_anti"), words, percent, orders, scratch, block_docs, common)
    labels = connected_components(copies.unionByName(links), scratch).withColumnRenamed("id", "doc_id")
    return digests.join(labels, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _of_rows(base: DataFrame, words: int, percent: int, orders: int, scratch: Scratch, block_docs: int, common: int) -> DataFrame:
    """The same where rows repeat doc_ids: rows are joined by a number of their own, and those of one doc_id are linked."""
    numbered = scratch.write(base.withColumn("row", F.monotonically_increasing_id()), "rows")
    ids = numbered.select("row", "doc_id")
    rows = numbered.where("doc_id IS NOT NULL").select(F.col("row").alias("doc_id"), "text")
    similar = scratch.write(similarity_classes(rows, words, percent, orders, scratch, block_docs, common).withColumnRenamed("doc_id", "row"), "similar")
    alike = similar.where("row != component_id").select(F.col("component_id").alias("a"), F.col("row").alias("b"))
    first = ids.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("row").alias("a"))
    same = ids.join(first, "doc_id").where("row != a").select("a", F.col("row").alias("b"))
    labels = connected_components(alike.unionByName(same), scratch).select(F.col("id").alias("row"), "component")
    placed = scratch.write(ids.join(labels, "row", "left").withColumn("component", F.coalesce("component", "row")), "placed")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    sizes = similar.select("row", "n_shingles").unionByName(set_digests(numbered.where("doc_id IS NULL").select(F.col("row").alias("doc_id"), "text"), words).select(F.col("doc_id").alias("row"), F.col("n").alias("n_shingles")))
    return placed.join(sizes, "row").join(least, "component").select("doc_id", "n_shingles", "component_id")
