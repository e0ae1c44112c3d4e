"""Exact, fast encoding of whole texts with a public word-level BPE vocabulary.

The vocabulary drops white space and never joins characters across a piece (a
run of letters, one digit, a run of other marks, or a short English
contraction), so the ids of a text are the ids of its pieces one after another.
Pieces are found and hashed for a block of texts at once; the tokenizers
library encodes each new piece once, and a bounded per-worker table keeps its
ids.  Texts with characters outside a plain Latin range, where normalisation
could reach across pieces, take the library's full path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from .bytetext import BLOCK, U64, blocks, span_hashes, spans

#: The vocabulary's own rule for pieces (a fixed value).
PIECE_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces kept per worker (about 25 bytes each); a full table starts anew.
MEMO_PIECES = 1_500_000
#: Characters given to the library at once on the full path.
PIECE_CHARS = 1 << 18

_PLAIN = 0x250
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of each plain character."""
    kind, low = np.full(_PLAIN + 1, _ODD, np.uint8), np.arange(_PLAIN + 1, dtype=np.uint32)
    for c in range(_PLAIN):
        ch = chr(c)
        small = ch.lower()
        if ch in " \t\n\r":
            kind[c] = _SPACE
        elif (0x20 < c < 0x7F or c > 0xA0) and len(small) == 1 and ord(small) < _PLAIN:
            low[c] = ord(small)
            kind[c] = _LETTER if regex.fullmatch(r"\p{L}", small) else _DIGIT if regex.fullmatch(r"\p{N}", small) else _OTHER
    return kind, low


_KIND, _LOW = _tables()
_BREAK = regex.compile(r"[ \n\t](?=[!-~])")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes texts to uint32 ids, without special tokens."""

    def __init__(self, path: str, memo: int = MEMO_PIECES):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True  # control strings in a text are ordinary text
        self.bare = Tokenizer.from_file(path)  # for pieces that are normalised and cut already
        self.bare.encode_special_tokens = True
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo = memo
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, U64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def library(self, text: str) -> np.ndarray:
        """Ids by the library's own path, cut before ASCII words so that memory stays bounded."""
        out, at = [], 0
        while len(text) - at > PIECE_CHARS and (m := _BREAK.search(text, at + PIECE_CHARS)):
            out.append(text[at : m.end()])
            at = m.end()
        out.append(text[at:])
        return np.concatenate([np.asarray(self.full.encode(t, add_special_tokens=False).ids, np.uint32) for t in out])

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        if len(self.keys) + len(keys) > self.memo:
            self._reset()
        ids, sizes = [self.pool], []
        for i in range(0, len(pieces), 4096):
            some = pieces[i : i + 4096]
            e = self.bare.encode(" ".join(some), add_special_tokens=False)
            ids.append(np.asarray(e.ids, np.uint32))
            sizes.append(np.bincount(np.asarray(e.word_ids, np.int64), minlength=len(some)))
        size = np.concatenate(sizes).astype(np.int64)
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate(ids)
        order = np.argsort(keys)
        where = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, where, keys[order])
        self.at, self.size = np.insert(self.at, where, at[order]), np.insert(self.size, where, size[order])

    def _plain(self, chars: np.ndarray, kind: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain characters and ids per document; edges: the documents' offsets in characters."""
        n = len(chars)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(edges) - 1, np.int64)
        chars = _LOW[chars]
        begin = np.ones(n, bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        inner = edges[1:-1]
        begin[inner[inner < n]] = True
        # a lone apostrophe takes s, t, m, d, re, ve or ll from the letters after it
        quotes = np.flatnonzero(chars == 39)
        quotes = quotes[begin[quotes] & (quotes + 1 < n)]
        if len(quotes):
            quotes = quotes[(kind[quotes + 1] == _LETTER) & begin[quotes + 1] & ~np.isin(quotes + 1, inner)]
            second = chars[quotes + 1]
            two = np.minimum(quotes + 2, n - 1)
            third = np.where((quotes + 2 < n) & ~begin[two], chars[two], 0)
            one = np.isin(second, [ord(c) for c in "stmd"])
            pair = ((second == ord("r")) & (third == ord("e"))) | ((second == ord("v")) & (third == ord("e"))) | ((second == ord("l")) & (third == ord("l")))
            for hit, k in ((one, 2), (pair & ~one, 3)):
                q = quotes[hit]
                begin[q + 1] = False
                after = q + k
                after = after[after < n]
                begin[after] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        keep = kind[starts] != _SPACE
        starts, ends = starts[keep], ends[keep]
        h = span_hashes(chars.astype("<u2").view(np.uint8), 2 * starts, 2 * ends, lower=False)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        for _ in range(2):
            where = np.searchsorted(self.keys, keys)
            there = where < len(self.keys)
            there[there] = self.keys[where[there]] == keys[there]
            if there.all():
                break
            lost = np.flatnonzero(~there) if len(self.keys) + (~there).sum() <= self.memo else np.arange(len(keys))
            text = chars.astype("<u4").tobytes().decode("utf-32-le")
            self._learn(keys[lost], [text[a:b] for a, b in zip(starts[first[lost]].tolist(), ends[first[lost]].tolist(), strict=True)])
        size = self.size[where][back]
        ids = self.pool[spans(self.at[where][back], size)]
        upto = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(upto[np.searchsorted(starts, edges)])

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids one after another, ids per row) for blocks of rows; null counts as empty."""
        for lo, _, data, offs in blocks(column, BLOCK):
            text = data.tobytes().decode("utf-8", "replace")
            chars = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            edges = lead[offs]
            kind = _KIND[np.minimum(chars, _PLAIN)]
            odd = np.zeros(len(offs) - 1, bool)
            if len(at := np.flatnonzero(kind == _ODD)):
                odd[np.searchsorted(edges, at, "right") - 1] = True
            if not odd.any():
                yield lo, *self._plain(chars, kind, edges)
                continue
            for i in range(len(odd)):
                a, b = edges[i], edges[i + 1]
                if odd[i]:
                    ids = self.library(text[a:b])
                    yield lo + i, ids, np.array([len(ids)])
                else:
                    yield lo + i, *self._plain(chars[a:b], kind[a:b], np.array([0, b - a]))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
