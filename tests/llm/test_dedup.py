"""Exact, similar and substring duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gid long, head string, uid string, slot string, kept string"


def frame(spark, rows):
    """Documents with columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "h", "u", "x", "k") for i, t in rows], SCHEMA)


def corpus(seed: int = 3, n: int = 60) -> list[tuple[int, str | None]]:
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdéß ") for _ in range(rnd.randint(1, 6))).strip() or "z" for _ in range(80)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    rows: list[tuple[int, str | None]] = []
    for i in range(n):
        kind = rnd.random()
        own = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))]
        if kind < 0.25 and rows:
            text = rnd.choice(rows)[1]
        elif kind < 0.5 and rows:
            words = (rnd.choice(rows)[1] or "").split(" ")
            for _ in range(rnd.randint(1, 3)):
                words[rnd.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind < 0.7:
            text = " ".join(own[:20]) + " " + passage + " " + " ".join(own[20:40])
        else:
            text = " ".join(own)
        rows.append((i * 7 % 1000, text))
    rows += [(2001, None), (2002, ""), (2003, "   \n"), (2004, "one"), (2005, "ONE"), (2006, "aaaa " * 90), (2007, "aaaa " * 90 + "b"), (2008, "x" * 5000), (2009, "a\tb \n c"), (2010, "a b c")]
    return rows


def test_exact_classes(spark):
    from basisloom.llm.exact_dedup import equal_text_classes

    rows = corpus()
    norm = {i: re.sub("[\x20\x09-\x0d]+", " ", t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    want = {(i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    for run, growth in ((48, 8), (2, 2)):  # many levels of recursion too
        got = equal_text_classes(frame(spark, rows), first_run=run, growth=growth).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(rows)


def test_exact_classes_of_very_long_texts(spark):
    from basisloom.llm.exact_dedup import equal_text_classes

    long = "lorem \t ipsum\n" * 100_000
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in equal_text_classes(frame(spark, [(1, long), (2, long + "!"), (3, long.replace("\t", " ")), (4, long[:-1])])).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}


def test_exact_repeated_rows_and_empty_table(spark):
    from basisloom.llm.exact_dedup import equal_text_classes

    got = equal_text_classes(frame(spark, [(5, "same text"), (5, "same text"), (None, "same text"), (5, "other")])).collect()
    assert sorted((r["group_size"], r["kept"]) for r in got) == [(1, True), (3, False), (3, False), (3, True)]
    assert all(r["keep_id"] == 5 for r in got)
    assert equal_text_classes(frame(spark, [])).count() == 0


def brute_components(rows, words=5, percent=75):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(words, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def near_copies(rnd: random.Random, words: list[str], n: int, most: int, first: int) -> list[tuple[int, str]]:
    """Copies with 0 to ``most`` words changed: the most changed ones lie around the threshold."""
    rows = []
    for k in range(n):
        copy = list(words)
        for j in range(rnd.randint(0, most)):
            copy[rnd.randrange(len(copy))] = f"e{first + k}_{j}"
        rows.append((first + k, " ".join(copy)))
    return rows


def chain(rnd: random.Random, n: int, first: int) -> list[tuple[int, str]]:
    """Texts of which each is near to the next only: 90 words that slide by six."""
    words = ["c%d" % rnd.randrange(10**6) for _ in range(90 + 6 * n)]
    return [(first + k, " ".join(words[6 * k : 6 * k + 90])) for k in range(n)]


@pytest.mark.parametrize(("block", "common"), [(1024, 256), (3, 2), (8, 1)])
def test_similarity_classes(spark, block, common):
    from basisloom.llm.ngram_join import similarity_classes

    rnd = random.Random(9)
    base = ["w%d" % rnd.randrange(300) for _ in range(90)]
    rows = corpus(5, 40) + near_copies(rnd, base, 25, 7, 3000) + chain(rnd, 8, 4000)
    got = similarity_classes(frame(spark, rows), block_docs=block, common=common)
    assert {tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()} == brute_components(rows)


def test_similarity_of_a_hot_group(spark):
    """2,000 rows: 500 near copies of one text, 200 of it within other texts, a chain, and texts of their own."""
    from basisloom.llm.ngram_join import similarity_classes

    rnd = random.Random(10)
    base = ["w%d" % rnd.randrange(300) for _ in range(60)]
    rows = near_copies(rnd, base, 500, 6, 10_000) + chain(rnd, 30, 20_000)
    rows += [(30_000 + k, " ".join([*base[: 20 + k % 40], *("o%d" % rnd.randrange(10**6) for _ in range(k % 30))])) for k in range(200)]
    rows += [(40_000 + k, " ".join("v%d" % rnd.randrange(40) for _ in range(30))) for k in range(1270)]
    want = brute_components(rows)
    assert len({c for _, _, c in want}) < 1900
    for block in (1024, 64):
        got = similarity_classes(frame(spark, rows).repartition(7), block_docs=block, common=16)
        assert {tuple(r) for r in got.collect()} == want


def test_a_very_long_text_and_words_that_fooled_a_polynomial(spark):
    """Words built to agree under any polynomial modulo 2**64 share no shingle."""
    from basisloom.llm.ngram_join import similarity_classes

    word, rows = "a", []
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    for k, n in enumerate((1024, 2048, 4096)):
        rows += [(2 * k, word[:n]), (2 * k + 1, word[:n].translate(str.maketrans("ab", "ba")))]
    long = " ".join(f"t{k}" for k in range(120_000))
    rows += [(100, long), (101, long + " more"), (102, "other " + long[: len(long) // 2])]
    assert {tuple(r) for r in similarity_classes(frame(spark, rows)).collect()} == brute_components(rows)


def test_similarity_edge_cases(spark):
    """Repeated ids are linked, with equal and with different texts; exactly the threshold links; words of no partner do not."""
    from basisloom.llm.ngram_join import similarity_classes

    text = "one two three four five six seven"
    got = {tuple(r) for r in similarity_classes(frame(spark, [(4, text), (4, text), (None, text), (9, text.upper()), (7, None)])).collect()}
    assert got == {(4, 3, 4), (None, 3, None), (9, 3, 4), (7, 0, 7)}
    rows = [(4, text), (4, "a b c d e f"), (2, "A B C D E F"), (None, text), (9, text), (7, None), (7, "")]
    got = sorted(map(tuple, similarity_classes(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(4, 3, 2), (4, 2, 2), (2, 2, 2), (None, 3, None), (9, 3, 2), (7, 0, 7), (7, 0, 7)], key=str)
    assert similarity_classes(frame(spark, [])).count() == 0
    # 6 of 8 shingles: exactly the threshold; 5 of 7 is below
    rows = [(1, "a b c d e f g h i j k"), (2, "b c d e f g h i j k l"), (3, "p q r s t u v w x y"), (4, "q r s t u v w x y z")]
    assert {tuple(r) for r in similarity_classes(frame(spark, rows)).collect()} == {(1, 7, 1), (2, 7, 1), (3, 6, 3), (4, 6, 4)} == brute_components(rows)


def brute_repeats(rows, least=100):
    seen, out = set(), set()
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mask = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if (w := b[p : p + least]) in seen:
                mask[p : p + least] = b"\1" * least
            else:
                seen.add(w)
        spans = [m.span() for m in re.finditer(b"\1+", bytes(mask))]
        out.add((i, len(b), tuple(spans), bytes(x for x, f in zip(b, mask, strict=True) if not f)))
    return out


@pytest.mark.parametrize("most", [100_000, 1])
def test_repeated_substrings(spark, most):
    from basisloom.llm.substring_dedup import remove_repeats

    rows = corpus(11, 50)
    got = remove_repeats(frame(spark, rows), most=most).collect()
    assert {(r["doc_id"], r["n_bytes"], tuple(zip(r["starts"], r["ends"], strict=True)), bytes(r["kept"])) for r in got} == brute_repeats(rows)


def test_repeated_substrings_edge_cases(spark):
    from basisloom.llm.substring_dedup import anchored_repeats, remove_repeats

    assert remove_repeats(frame(spark, [])).count() == 0
    got = remove_repeats(frame(spark, [(None, "q" * 150), (3, "q" * 150)])).collect()
    # a byte repeats the string of 100 before it, but for the first of all; null comes after every doc_id
    assert {(r["doc_id"], bytes(r["kept"])) for r in got} == {(3, b"q"), (None, b"")}
    contexts = [(3, b"abcXYZ1"), (3, b"dbcXYZ2"), (3, b"abcXYZ3"), (2, b"bcXYQ")]
    found = {(ahead, depth, tuple(sorted(m))) for depth, groups in anchored_repeats(contexts, 4) for ahead, m in groups}
    assert (2, 3, (0, 1, 2)) in found and (3, 3, (0, 2)) in found and (2, 2, (0, 1, 2, 3)) in found
