"""Encoding, packing, the token store and token counts."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from test_dedup import frame


def texts(n: int = 40, seed: int = 1) -> list[str | None]:
    rnd = random.Random(seed)
    alphabet = [chr(c) for c in [*range(32, 127), 9, 10, 13, *range(0xA1, 0x250)]] + [" "] * 40 + ["'s", "'re", "'ve", "'ll", "'"] * 3
    out: list[str | None] = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 400))) for _ in range(n)]
    return [*out, None, "", "é ΣΣ 日本", "<|endoftext|> x", "word " * 6000, "\x1c a\xa0b İ"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    from basisloom.llm.encoding import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_encoding_equals_the_library(library):
    from basisloom.llm.encoding import WordEncoder, tokenizer_path

    given = texts(200)
    for memo in (1_500_000, 300):
        enc, got = WordEncoder(tokenizer_path(), memo), {}
        for lo, ids, counts in enc.encode(pa.array(given)):
            for k, part in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
                got[lo + k] = part.tolist()
        assert [got[i] for i in range(len(given))] == [list(library(t)) for t in given]


def twins() -> list[tuple[int, str]]:
    """Pairs of words that agree under any polynomial hash modulo 2**64."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    return [(10 * n + k, w) for n in (1024, 2048, 4096) for k, w in enumerate((word[:n], word[:n].translate(str.maketrans("ab", "ba"))))]


def test_words_that_fool_a_polynomial_keep_their_ids(spark, library):
    from basisloom.llm.packing import encode_pieces
    from basisloom.llm.token_store import write_store

    rows = [*twins(), (1, "t " * 400_000)]  # and a very long text
    want = {i: [*library(t), 2] for i, t in rows}
    store = write_store(frame(spark, rows))
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in store.lookup(frame(spark, rows)).collect()} == want
    got = {}
    for r in sorted(encode_pieces(frame(spark, rows), 2048, 2).collect(), key=lambda r: r["piece"]):
        assert r["length"] == 2048 or r["start"] + r["length"] == len(want[r["doc_id"]])
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == want


def test_packing(spark, library):
    from basisloom.llm.packing import best_fit_pack, encode_pieces, sequences

    given = list(enumerate(texts()))
    pieces = encode_pieces(frame(spark, given), 64, 0)
    placed = best_fit_pack(pieces, 64)
    rows = placed.collect()
    want = {}
    for i, t in given:
        ids = [*library(t), 0]
        for p in range(0, len(ids), 64):
            want[i, p // 64] = (p, ids[p : p + 64])
    assert {(r["doc_id"], r["piece"]): (r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == brute_best_fit([r["length"] for r in rows], 64)
    whole = {r["sequence_id"]: len(r["ids"]) // 4 for r in sequences(placed).collect()}
    assert whole == {k: sum(n for _, n in b) for k, b in bins.items()}


def brute_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_plan_is_best_fit_decreasing():
    from basisloom.llm.packing import plan_best_fit

    rnd = random.Random(4)
    for _ in range(200):
        capacity = rnd.randint(1, 60)
        counts = {rnd.randint(1, capacity): rnd.randint(1, 30) for _ in range(rnd.randint(1, 12))}
        used, fill = set(), {}
        for p in plan_best_fit(counts, capacity):
            for rank in range(p.rank_lo, p.rank_hi):
                k = rank - p.rank_lo
                b, at = p.bin_lo + k // p.per_bin, p.offset + k % p.per_bin * p.length
                assert (p.length, rank) not in used and fill.get(b, 0) == at
                used.add((p.length, rank))
                fill[b] = at + p.length
        assert len(used) == sum(counts.values()) and max(fill.values()) <= capacity
        assert len(fill) == brute_best_fit([n for n, c in counts.items() for _ in range(c)], capacity)


def test_packing_empty_table_and_repeated_rows(spark):
    from basisloom.llm.packing import pack_documents

    assert pack_documents(frame(spark, [])).count() == 0
    got = pack_documents(frame(spark, [(1, "a"), (1, "a"), (None, None)])).collect()
    assert len(got) == 3 and len({(r["sequence_id"], r["offset"]) for r in got}) == 3


def test_token_store(spark, library):
    from basisloom.llm.token_store import write_store

    given = [(i * 13 % 97, t) for i, t in enumerate(texts())]
    store = write_store(frame(spark, given))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in store.lookup(frame(spark, given)).collect()}
    at, want = 0, {}
    for i, t in sorted(given):
        ids = np.array([*library(t), 2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want
    absent = frame(spark, [(5000 + k, "") for k in range(50)])
    assert store.lookup(absent).count() == 0


def test_token_store_edge_cases(spark):
    from basisloom.llm.token_store import PerfectHash, key_hash, open_store, write_store

    rows = frame(spark, [(None, "null id"), (4, "a"), (4, "b"), (9, None)])
    got = write_store(rows).lookup(rows).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(False, 4, 2), (False, 4, 2), (False, 9, 1), (True, 0, 3)]
    assert write_store(frame(spark, [])).lookup(rows).count() == 0
    store = write_store(frame(spark, [(k, f"text {k} " * (k % 7)) for k in range(300)]))
    again = open_store(spark, store.uri)
    some = frame(spark, [(k, "") for k in (3, 4, 5, 90, 299, 300)])
    assert sorted(map(tuple, again.lookup(some).collect())) == sorted(map(tuple, store.lookup(some).collect()))
    assert again.manifest["shards"] and sum(n for _, n, _ in again.manifest["shards"]) == 300 == sum(n for _, n in again.manifest["index"])
    folder = store.uri.removeprefix("file://")
    for name in os.listdir(folder):
        if name.startswith("index-"):
            os.remove(f"{folder}/{name}")
    with pytest.raises(Exception, match="(?i)no such file|not exist|FileNotFound"):
        again.lookup(some).collect()
    keys = key_hash(np.arange(5000))
    mph = PerfectHash.build(keys)
    assert sorted(mph.slots(keys)) == list(range(5000))


def test_token_counts(spark):
    from basisloom.llm.token_counts import RULES, count_tokens, token_spans
    from basisloom.llm.encoding import tokenizer_path
    import public_tokenizers
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    full.encode_special_tokens = True
    given = [(i, t + "\n\n béc\n" if t is not None else None) for i, t in enumerate(texts(30))]

    def spans_of(t):
        """Characters of every token, from the bytes that the library's tokens stand for."""
        data, at, s, e = t.encode(), 0, [], []
        lead = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
        for token in full.encode(t, add_special_tokens=False).tokens:
            s.append(int(lead[at]))
            at += len(token)  # one character of the byte alphabet for each byte
            e.append(int(lead[at - 1]) + 1)
        assert at == len(data)
        return s, e

    for _, t in given[:30]:
        s, e = token_spans(t, path, public_tokenizers.PATTERN)
        assert (list(s), list(e)) == spans_of(t)
    for rule in RULES:
        rows = count_tokens(frame(spark, given), rule=rule).collect()
        got = {}
        for r in rows:
            got.setdefault(r["doc_id"], {})[r["section"]] = r["n_tokens"]
        for i, t in given:
            if not t:
                assert i not in got
                continue
            s, e = spans_of(t)
            lines, at, want = t.split("\n"), 0, {}
            edges = []
            for k, line in enumerate(lines):
                end = min(at + len(line) + 1, len(t))
                if end > at:
                    edges.append((at, end))
                at = end
            want = dict.fromkeys(range(len(edges)), 0)
            for a, b in zip(s, e, strict=True):
                over = [(k, min(b, y) - max(a, x)) for k, (x, y) in enumerate(edges) if min(b, y) > max(a, x)]
                if rule == "share":
                    for k, n in over:
                        want[k] += n / (b - a)
                elif rule == "majority":
                    want[max(over, key=lambda z: (z[1], -z[0]))[0]] += 1
                else:
                    want[over[0 if rule == "first" else -1][0]] += 1
            assert got[i] == pytest.approx(want)
    assert count_tokens(frame(spark, [])).count() == 0


def test_token_counts_of_given_sections(spark):
    from basisloom.llm.token_counts import count_tokens

    rows = spark.createDataFrame([(1, "alpha beta gamma", [{"start": 0, "end": 5}, {"start": 11, "end": 16}]), (2, "x", None)], "doc_id long, text string, parts array<struct<start:long,end:long>>")
    got = {(r["doc_id"], r["section"]): r["n_tokens"] for r in count_tokens(rows, "parts").collect()}
    assert got[1, -1] >= 1 and got[2, -1] == 1 and got[1, 0] >= 1
