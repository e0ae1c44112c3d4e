"""Token counts of sections by offset-mapped attribution.

A document is encoded once and as a whole; every token has its character span.
The spans are interval-joined with the document's sections by binary search (both
are in order), and a token that lies over a boundary is given to sections by an
explicit rule:

* ``first``: the section of its first character;
* ``last``: the section of its last character;
* ``majority``: the section with most of its characters, the earliest of equals;
* ``share``: every section by its share of the token's characters.

Tokens without a character in any section count under section -1.

Defined results: null or empty text has no tokens and, by lines, no sections;
given sections must be in order and apart, null sections are dropped, empty ones
get no tokens; rows that repeat a doc_id are counted row by row; other columns
are ignored; a very long text is encoded whole; an empty table has no counts; a
token inside a character (a byte of it) has the whole character
as its span.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import tokenizer_path

RULES = ("first", "last", "majority", "share")


class ByteEncoder:
    """Byte-level BPE from a rank file, with the byte length of every token."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def byte_ends(self, text: str) -> np.ndarray:
        return np.cumsum(self.length[self.encoding.encode_to_numpy(text, disallowed_special=())])


_encoders: dict[tuple[str, str], ByteEncoder] = {}


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end character of every token."""
    key = (path, pattern)
    if key not in _encoders:
        _encoders[key] = ByteEncoder(*key)
    ends = _encoders[key].byte_ends(text)
    if not len(ends):
        return ends, ends
    lead = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
    starts = np.concatenate([[0], ends[:-1]])
    return lead[starts] - 1, lead[ends - 1]


def attribute(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (or shares) of each section, the last value being those of none, and boundary-crossing tokens of each."""
    m = len(begin)
    counts, crossing = np.zeros(m + 1), np.zeros(m + 1, np.int64)
    if not len(starts):
        return counts, crossing
    # sections that have a character of the token: lo..hi-1
    lo = np.searchsorted(end, starts, "right")
    hi = np.searchsorted(begin, ends, "left")
    simple = (hi - lo == 1) & (begin[np.minimum(lo, m - 1)] <= starts) & (end[np.minimum(lo, m - 1)] >= ends) if m else np.zeros(len(starts), bool)
    counts[:m] += np.bincount(lo[simple], minlength=m)[:m]
    for t in np.flatnonzero(~simple).tolist():
        a, b, i, j = int(starts[t]), int(ends[t]), int(lo[t]), int(hi[t])
        own = [(k, min(b, int(end[k])) - max(a, int(begin[k]))) for k in range(i, j)]
        own = [(k, n) for k, n in own if n > 0]
        for k, _ in own:
            crossing[k] += 1
        if rule == "share":
            for k, n in own:
                counts[k] += n / (b - a)
            counts[m] += (b - a - sum(n for _, n in own)) / (b - a)
        elif rule == "majority":
            counts[max(own, key=lambda x: (x[1], -x[0]))[0] if own else m] += 1
        else:
            at = a if rule == "first" else b - 1
            counts[next((k for k, _ in own if begin[k] <= at < end[k]), m)] += 1
    return counts, crossing


def count_tokens(docs: DataFrame, sections: str | None = None, rule: str = "first", tokenizer: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per document and section: doc_id, section, start, n_chars, n_tokens, n_crossing.

    ``sections`` names a column array<struct<start, end>> of character ranges;
    without it the sections are the lines, each with its line end.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    path = tokenizer or tokenizer_path("byte_bpe_50k.tiktoken")
    kind = pa.float64() if rule == "share" else pa.int64()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, number, first, chars, tokens, cross = [], [], [], [], [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                starts, ends = token_spans(text, path, pattern)
                if sections is None:
                    cut = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
                    edge = np.concatenate([[0], cut[cut < len(text)], [len(text)]]) if text else np.zeros(1, np.int64)
                    begin, end = edge[:-1], edge[1:]
                else:
                    given = [s for s in (batch.column(2)[i].as_py() or []) if s is not None]
                    begin = np.array([s["start"] for s in given], np.int64)
                    end = np.array([s["end"] for s in given], np.int64)
                got, over = attribute(starts, ends, begin, end, rule)
                n = len(begin) + bool(got[-1])
                rows += [i] * n
                number += [*range(len(begin)), -1][:n]
                first += [*begin.tolist(), None][:n]
                chars += [*(end - begin).tolist(), None][:n]
                tokens += got.tolist()[:n]
                cross += over.tolist()[:n]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(first, pa.int64()), pa.array(chars, pa.int64()), pa.array(np.array(tokens)).cast(kind), pa.array(cross, pa.int64())],
                ["doc_id", "section", "start", "n_chars", "n_tokens", "n_crossing"],
            )

    wanted = [F.col("doc_id").cast("long"), F.col("text").cast("string")] + ([F.col(sections)] if sections else [])
    amount = "double" if rule == "share" else "long"
    return docs.select(*wanted).mapInArrow(count, f"doc_id long, section int, start long, n_chars long, n_tokens {amount}, n_crossing long")
