"""Token-id shards with a minimal-perfect-hash index.

A store is a folder of

* ``shard-*.ids``: raw little-endian ids (uint16 when the vocabulary allows it,
  else uint32) of documents in ascending doc_id order, shard after shard,
  followed by the documents' offsets, their ids and a footer;
* ``index-*.mph``: per hash bucket of document keys, a minimal perfect hash
  (levels of bit arrays; a key's slot is its bit's rank), and per slot a stored
  32-bit fingerprint, the shard, the position in it and the rows of that key;
* ``manifest.json``: buckets, shards with their documents and ids, and the index
  files with their keys, written last.  ``open_store`` needs nothing else.

A keyed access costs one bucket, a few bit probes, one fingerprint test and one
read; neighbouring documents are read at once.  Tasks write under attempt-private
names and rename; the manifest lists the files of tasks that Spark committed, so
that lost executors and repeated attempts leave the store right.  Documents, keys
of the shards and keys of the index are counted and must agree; a listed file
that is missing is an error.

Defined results: null or empty text holds the end id only; a null doc_id is
kept under the reserved key -2**63 and comes first; rows that repeat a doc_id
are stored next to each other (by their ids) under one key with a row count; a
very long text is encoded whole and is one document of its shard; an empty table
makes an empty store; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import U64, mix, pack
from .encoding import encoder, tokenizer_path
from .scratch import Scratch, parts_for

MAGIC = b"BLTOKEN1"
#: Ids that are read from a shard at once; a longer document is read whole.
READ_IDS = 1 << 21
NULL_KEY = -(1 << 63)


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")


def _put(uri: str, name: str, chunks: Iterator[bytes]) -> str:
    """Write under a private name, then rename; the content is a function of the task's input."""
    fs, base = _fs(uri)
    fs.create_dir(base, recursive=True)
    private = f"{base}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(private) as out:
        for c in chunks:
            out.write(c)
    fs.move(private, f"{base}/{name}")
    return name


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: per level a bit array in which keys that fall alone have their bit."""

    GAMMA, LEVELS = 2.0, 40

    def __init__(self, levels: list[np.ndarray], ranks: list[np.ndarray], n: int):
        self.levels, self.ranks, self.n = levels, ranks, n

    @staticmethod
    def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return ((mix(keys, 11 + level) >> U64(32)) * U64(size) >> U64(32)).astype(np.int64) if size < 1 << 32 else (mix(keys, 11 + level) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) >= cls.LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, int(len(left) * cls.GAMMA + 63) // 64 * 64)
            bit = cls._bit(left, len(levels), size)
            hits = np.bincount(bit, minlength=size)
            levels.append(np.packbits(hits == 1, bitorder="little"))
            left = left[hits[bit] != 1]
        return cls.of(levels)

    @classmethod
    def of(cls, levels: list[np.ndarray]) -> PerfectHash:
        """Rank directories: set bits before each 8-byte word, over all levels."""
        ranks, n = [], 0
        for bits in levels:
            per = np.bitwise_count(bits.view(np.uint64)).astype(np.int64)
            ranks.append(n + np.cumsum(per) - per)
            n += int(per.sum())
        return cls(levels, ranks, n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that surely were not indexed."""
        out = np.full(len(keys), -1, np.int64)
        open_, where = keys, np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            words = bits.view(np.uint64)
            bit = self._bit(open_, level, len(bits) * 8)
            word, low = words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> low) & U64(1) == 1
            below = np.bitwise_count(word & ((U64(1) << low) - U64(1))).astype(np.int64)
            out[where[hit]] = (self.ranks[level][bit >> 6] + below)[hit]
            open_, where = open_[~hit], where[~hit]
        return out


def key_hash(doc_ids: np.ndarray) -> np.ndarray:
    return mix(doc_ids.astype(np.int64).view(np.uint64), 3)


def index_bytes(doc_ids: np.ndarray, shard: np.ndarray, position: np.ndarray, rows: np.ndarray) -> bytes:
    keys = key_hash(doc_ids)
    mph = PerfectHash.build(keys)
    slot = mph.slots(keys)
    cols = {}
    for name, values, kind in (("print", (mix(keys, 7) >> U64(32)), "<u4"), ("shard", shard, "<i4"), ("position", position, "<i8"), ("rows", rows, "<i4")):
        cols[name] = np.empty(len(keys), kind)
        cols[name][slot] = values.astype(kind)
    head = json.dumps({"n": len(keys), "levels": [len(x) for x in mph.levels], "cols": [[k, v.dtype.str] for k, v in cols.items()]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *(x.tobytes() for x in mph.levels), *(v.tobytes() for v in cols.values())])


class Index:
    """One bucket of the index, as read from its file."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not an index file")
        n = struct.unpack_from("<I", raw, 8)[0]
        head, at = json.loads(raw[12 : 12 + n]), 12 + n
        levels = []
        for size in head["levels"]:
            levels.append(np.frombuffer(raw, np.uint8, size, at).copy())
            at += size
        self.mph, self.cols = PerfectHash.of(levels), {}
        for name, kind in head["cols"]:
            self.cols[name] = np.frombuffer(raw, kind, head["n"], at)
            at += self.cols[name].nbytes

    def find(self, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is stored (its fingerprint agrees), its shard, its position there and its rows."""
        keys = key_hash(doc_ids)
        slot = self.mph.slots(keys)
        there = slot >= 0
        slot = np.where(there, slot, 0)
        if len(self.cols["print"]):
            there &= self.cols["print"][slot] == (mix(keys, 7) >> U64(32)).astype(np.uint32)
            return there, self.cols["shard"][slot], self.cols["position"][slot], self.cols["rows"][slot]
        return there, slot, slot, slot


class Shard:
    """One shard, opened at its footer; documents are read by position."""

    FOOTER = struct.Struct("<qqi8s")  # documents, ids, bytes per id, magic

    def __init__(self, uri: str, name: str):
        fs, base = _fs(uri)
        self.file = fs.open_input_file(f"{base}/{name}")
        size = self.file.size()
        n, self.ids, self.width, magic = self.FOOTER.unpack(self.file.read_at(self.FOOTER.size, size - self.FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a shard")
        at = self.ids * self.width
        self.offsets = np.frombuffer(self.file.read_at(8 * (n + 1), at), "<i8")
        self.doc_ids = np.frombuffer(self.file.read_at(8 * n, at + 8 * (n + 1)), "<i8")

    def read(self, position: int, end: int | None = None) -> np.ndarray:
        """Ids of the document at ``position``, or of all from there up to ``end``."""
        a, b = int(self.offsets[position]), int(self.offsets[position + 1 if end is None else end])
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}").astype("<u4")


class TokenStore:
    """A written store, known by its manifest: buckets, shards [number, documents, ids] and index [bucket, keys]."""

    def __init__(self, spark: SparkSession, uri: str, manifest: dict):
        self.spark, self.uri, self.manifest, self.buckets = spark, uri, manifest, manifest["buckets"]
        base, self.base = 0, {}
        for shard, _, n_ids in sorted(manifest["shards"]):
            self.base[shard] = base
            base += n_ids

    def lookup(self, keys: DataFrame, parts: int | None = None) -> DataFrame:
        """Documents of the given doc_id keys, read through the index: doc_id, start, n_tokens, ids (uint32, binary).

        ``parts`` is the number of tasks that read shards; without it Spark deals the
        shards out by the size of their keys, which suits a few keys but not a scan.
        """
        uri, buckets, base, filled = self.uri, self.buckets, self.base, {b for b, _ in self.manifest["index"]}

        def find(bucket: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            fs, path = _fs(uri)
            ids = rows["key"].to_numpy(np.int64)
            if int(bucket[0]) not in filled:
                return pd.DataFrame({"shard": [], "key": [], "position": [], "n": []})  # a bucket without keys has no file
            with fs.open_input_file(f"{path}/index-{int(bucket[0]):06d}.mph") as f:
                there, shard, position, n = Index(f.read()).find(ids)
            return pd.DataFrame({"shard": shard, "key": ids, "position": position, "n": n})[there]

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, name = None, -1
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            size = 0

            def flush() -> pa.RecordBatch:
                key, start, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(key, mask=key == NULL_KEY), pa.array(start), pa.array(counts), pack(ids, np.concatenate([[0], np.cumsum(counts)]))], ["doc_id", "start", "n_tokens", "ids"])

            for batch in batches:
                of, keys, first, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
                # documents that follow each other in a shard are one run
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (first[1:] != first[:-1] + n[:-1])
                edges = np.append(np.flatnonzero(new), len(of)).tolist()
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if of[lo] != name:
                        name = int(of[lo])
                        shard = Shard(uri, f"shard-{name:06d}.ids")
                    own, begin, end = np.repeat(keys[lo:hi], n[lo:hi]), int(first[lo]), int(first[hi - 1] + n[hi - 1])
                    at = begin
                    while at < end:
                        to = min(end, max(at + 1, int(np.searchsorted(shard.offsets, shard.offsets[at] + READ_IDS, "right")) - 1))
                        held.append((own[at - begin : to - begin], base[name] + shard.offsets[at:to].astype(np.int64), np.diff(shard.offsets[at : to + 1]).astype(np.int64), shard.read(at, to)))
                        size, at = size + len(held[-1][3]), to
                        if size >= READ_IDS:
                            yield flush()
                            held, size = [], 0
            if held:
                yield flush()

        key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key")
        wanted = keys.select(key).distinct().withColumn("bucket", bucket_of(F.col("key"), buckets))
        places = wanted.groupBy("bucket").applyInPandas(find, "shard int, key long, position long, n int")
        dealt = places.repartitionById(parts, F.col("shard")) if parts else places.repartition("shard")
        return dealt.sortWithinPartitions("shard", "position").mapInArrow(fetch, "doc_id long, start long, n_tokens long, ids binary")


def bucket_of(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_store(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None, scratch: Scratch | None = None) -> TokenStore:
    """Encode every whole text, append ``end_id``, and write shards in ascending doc_id order with their index."""
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    scratch = scratch or Scratch(spark, "tokens")
    uri = scratch.folder("store")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = parts_for(docs, 16)
    # bounds of near-equal ranges of keys: one narrow exchange, and a row per range comes back
    ranges = docs.select("doc_id").repartitionByRange(parts, "doc_id").select(F.spark_partition_id().alias("p"), "doc_id")
    lows = sorted(r[0] for r in ranges.groupBy("p").agg(F.min("doc_id")).select("min(doc_id)").collect())
    cuts = np.array(lows[1:], np.int64)
    shards = len(cuts) + 1
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            doc_ids = batch.column(0)
            for lo, ids, counts in enc.encode(batch.column(1)):
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype(f"<u{width}")
                own = doc_ids.slice(lo, len(counts))
                shard = np.searchsorted(cuts, own.to_numpy(zero_copy_only=False), "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), own, pack(ids, np.concatenate([[0], np.cumsum(counts + 1)]))], ["shard", "doc_id", "ids"])

    buckets = parts_for(docs, 8, least=32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, sizes, first = [], [], None

        def chunks() -> Iterator[bytes]:
            nonlocal first
            for batch in batches:
                if not batch.num_rows:
                    continue
                if first is None:
                    first = batch.column(0)[0].as_py()
                doc_ids.append(batch.column(1).to_numpy(zero_copy_only=False))
                ids = batch.column(2)
                offs = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
                sizes.append(np.diff(offs) // width)
                yield memoryview(ids.buffers()[2])[offs[0] : offs[-1]]
            if first is not None:
                upto = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<i8")
                yield upto.tobytes()
                yield np.concatenate(doc_ids).astype("<i8").tobytes()
                yield Shard.FOOTER.pack(len(upto) - 1, int(upto[-1]), width, MAGIC)

        stream = chunks()
        head = next(stream, None)
        if head is None:
            return

        def all_chunks() -> Iterator[bytes]:
            yield head
            yield from stream

        _put(uri, f"shard-{first:06d}.ids", all_chunks())
        ids, position, rows = np.unique(np.concatenate(doc_ids), return_index=True, return_counts=True)
        n_ids = int(sum(s.sum() for s in sizes))
        n = len(ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, first), pa.int32()), pa.array(ids, pa.int64()), pa.array(position, pa.int64()), pa.array(rows, pa.int32()), pa.array(np.full(n, n_ids), pa.int64())],
            ["shard", "key", "position", "n", "shard_ids"],
        )

    coded = docs.mapInArrow(encode, "shard int, doc_id long, ids binary")
    dealt = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("doc_id", "ids")
    entries = scratch.write(dealt.mapInArrow(write, "shard int, key long, position long, n int, shard_ids long"), "entries")

    def build(bucket: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raw = index_bytes(*(rows[c].to_numpy(np.int64) for c in ("key", "shard", "position", "n")))
        name = _put(uri, f"index-{int(bucket[0]):06d}.mph", iter([raw]))
        return pd.DataFrame({"bucket": [int(bucket[0])], "name": [name], "keys": [len(rows)]})

    index = entries.withColumn("bucket", bucket_of(F.col("key"), buckets)).groupBy("bucket").applyInPandas(build, "bucket int, name string, keys long")
    files = index.select("bucket", "keys").collect()  # a row per file
    written = entries.groupBy("shard").agg(F.sum("n").alias("documents"), F.first("shard_ids").alias("ids"), F.count(F.lit(1)).alias("keys")).collect()
    counts = {"documents": docs.count(), "documents in shards": sum(r["documents"] for r in written)}, {"keys of shards": sum(r["keys"] for r in written), "keys of the index": sum(r["keys"] for r in files)}
    for pair in counts:
        if len(set(pair.values())) > 1:
            raise ValueError(f"the store in {uri} is not whole: {pair}")
    manifest = {"buckets": buckets, "width": width, "shards": sorted([r["shard"], r["documents"], r["ids"]] for r in written), "index": sorted([r["bucket"], r["keys"]] for r in files)}
    _put(uri, "manifest.json", iter([json.dumps(manifest).encode()]))
    return TokenStore(spark, uri, manifest)


def open_store(spark: SparkSession, uri: str) -> TokenStore:
    """The store in a folder, by its manifest."""
    fs, base = _fs(uri)
    with fs.open_input_file(f"{base}/manifest.json") as f:
        return TokenStore(spark, uri, json.loads(f.read()))
