"""Language identification by error-correcting output codes.

Each language has a codeword; each bit has a binary classifier on hashed byte
n-grams of the folded text, the log-odds of the languages on either side of the
bit, from n-gram counts of the whole training part summed over partitions.  A
document's margins are decoded to the language with the least loss, each bit's
logistic loss weighted by how well the bit separates its sides; a runner-up that
is about as near flags the document as ambiguous.

Codes are exhaustive up to six languages (every two-sided split once) and
random but fixed beyond, with rows that differ pairwise.  Of languages with equal
losses the first by name is taken, and the document is flagged as ambiguous: so is
a text without any n-gram that was learned, whose score is one over their number.

Defined results: null text and text without a letter are ``und`` with score 0;
without training rows every document is ``und``; rows that repeat a text or a
doc_id count as often as they occur; rows with null lang are not
learned from; a null doc_id counts as empty text for the split; a very long text is
used whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import U64, blocks, mix
from .sums import summed

#: Hashed n-gram slots, and the n-grams used.
SLOTS, GRAMS = 1 << 13, (2, 3)
UNKNOWN = "und"
#: A margin is the mean log-odds of an n-gram times STRENGTH, shrunk as if SHRINK n-grams more said nothing.
STRENGTH, SHRINK = 2.0, 8.0
#: A second language whose loss is within this part of a bit's weight makes a document ambiguous.
AMBIGUOUS = 0.05

#: Bytes whose n-grams are held at once.
RUN = 1 << 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_SLOT = {n: [mix(np.arange(256, dtype=np.uint64), 10 * n + k) for k in range(n)] for n in GRAMS}


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def gram_runs(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots of the n-grams of a block and the document of each: one size and at most RUN bytes at a time.

    Only a document that is a block of its own is longer than a run, so that where
    runs end does not depend on a document's neighbours.
    """
    text = _FOLD[data]
    upper = (text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[:-1] == 0xC3)
    text[1:][upper] += 0x20  # capital letters of the Latin-1 range
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    for at in range(0, len(text), RUN):
        for n in GRAMS:
            run, of = text[at : at + RUN + n - 1], doc[at : at + RUN + n - 1]
            m = len(run) - n + 1
            if m <= 0:
                continue
            h = np.zeros(m, U64)
            for k in range(n):
                h += _SLOT[n][k][run[k : k + m]]
            keep = (of[:m] == of[n - 1 :]) & ((run[:m] != 32) | (run[n - 1 :] != 32))
            yield ((h[keep] >> U64(20)) & U64(SLOTS - 1)).astype(np.int64), of[:m][keep]


def gram_slots(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of :func:`gram_runs` at once."""
    runs = list(gram_runs(data, offs))
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([s for s, _ in runs]), np.concatenate([d for _, d in runs])


@dataclass
class Model:
    """langs; code (languages x bits, +1/-1); weights (slots x bits, log-odds); trust (bits)."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every language for rows of margins."""
        return np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :]) @ self.trust


def codewords(n: int) -> np.ndarray:
    if n <= 6:
        splits = range(1, 1 << (n - 1)) if n > 1 else range(1)
        return np.array([[1 if (s >> k) & 1 else -1 for s in splits] for k in range(n)], float).reshape(n, -1)
    rng = np.random.Generator(np.random.PCG64(n))
    bits = int(np.ceil(12 * np.log2(n)))
    best, apart = None, -1
    for _ in range(64):
        code = np.where(rng.random((n, bits)) < 0.5, 1.0, -1.0)
        code = code[:, np.abs(code.sum(0)) < n]
        gap = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if gap > apart:
            best, apart = code, gap
    return best


def fit(docs: DataFrame, smoothing: float = 0.5) -> Model:
    """Learn from rows (text, lang): all of them, summed over partitions."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, hi, data, offs in blocks(batch.column(0), RUN):
                names = sorted(set(langs[lo:hi]))
                number = np.array([names.index(x) for x in langs[lo:hi]])
                got = np.zeros(len(names) * SLOTS, np.int64)
                for slots, doc in gram_runs(data, offs):
                    got += np.bincount(number[doc] * SLOTS + slots, minlength=len(got))
                for name, row in zip(names, got.reshape(len(names), SLOTS), strict=True):
                    total[name] = total.get(name, 0) + row.astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["key", "vector"])

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = summed(rows.mapInArrow(count, "key string, vector binary"))
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, 0)), np.zeros((SLOTS, 0)), np.zeros(0))
    freq = np.stack([(counts[x] + smoothing) / (counts[x] + smoothing).sum() for x in langs])
    code = codewords(len(langs))
    weights, trust = [], []
    for bit in code.T:
        a, b = freq[bit > 0], freq[bit < 0]
        if not len(a) or not len(b):
            continue
        p, q = a.mean(0), b.mean(0)
        w = np.log(p / q)
        weights.append(w)
        trust.append(float(((p - q) * w).sum()))
    if not weights:
        return Model(langs, np.zeros((len(langs), 0)), np.zeros((SLOTS, 0)), np.zeros(0))
    trust_ = np.array(trust)
    return Model(langs, code, np.stack(weights, 1).astype(np.float32), trust_ / max(trust_.mean(), 1e-12))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (any columns, ``text`` among them) with lang_pred, score and ambiguous."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # slots x bits, whatever the corpus
    number = docs.columns.index("text")
    names = [*docs.columns, "lang_pred", "score", "ambiguous"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string, score double, ambiguous boolean"])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            texts, at, pred, score, unsure = batch.column(number), 0, [], [], []
            for lo, hi, data, offs in blocks(texts, RUN):
                n_docs = hi - lo
                size, margins = np.zeros(n_docs, np.int64), np.zeros((n_docs, m.weights.shape[1]))
                for slots, doc in gram_runs(data, offs):
                    size += np.bincount(doc, minlength=n_docs)
                    for b in range(margins.shape[1]):
                        margins[:, b] += np.bincount(doc, weights=m.weights[slots, b], minlength=n_docs)
                margins *= (STRENGTH / (np.maximum(size, 1) + SHRINK))[:, None]
                ascii_letter = np.concatenate([[0], np.cumsum((_FOLD[data] != 32) & (data < 0x80))])
                lettered = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
                for i in np.flatnonzero(~lettered & (np.diff(offs) > 0)).tolist():
                    lettered[i] = any(c.isalpha() for c in texts[lo + i].as_py())
                if not m.langs:
                    lettered[:] = False
                losses = m.losses(margins) if m.langs else np.zeros((n_docs, 1))
                best = losses.argmin(1)
                least = losses[np.arange(n_docs), best]
                prob = 1 / np.exp(least[:, None] - losses).sum(1)
                gap = np.sort(losses, 1)[:, 1] - least if losses.shape[1] > 1 else np.full(n_docs, np.inf)
                pred += [m.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                score += np.where(lettered, prob, 0.0).tolist()
                unsure += (~lettered | (gap < AMBIGUOUS)).tolist()
                at = hi
            assert at == batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names)

    return docs.mapInArrow(predict, schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learned from the documents that are not held out."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(base.where(~held_out(F.col("doc_id"))))
    return identify(base.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
