"""Language identification, quality, decontamination and chat formatting."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from test_dedup import frame

SYLLABLES = {"aa": ["the", "ing", "tion", "ou"], "bb": ["ñe", "cio", "que", "llo"], "cc": ["sch", "ung", "ein", "ü"]}


def speech(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    from basisloom.llm.language_id import UNKNOWN, codewords, predict_languages

    rnd = random.Random(2)
    rows = [(i, speech(rnd, lang, rnd.randint(2, 60)), lang) for i, lang in enumerate(rnd.choice(list(SYLLABLES)) for _ in range(200))]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 --- 45", "bb"), (903, speech(rnd, "aa", 20), None), (None, speech(rnd, "bb", 20), "bb"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "1 AS held_out", "0 AS lang_pred")
    got = predict_languages(docs).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows if lang}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert len(held) > 20 and all(r["lang_pred"] == truth[r["doc_id"]] and 0 <= r["score"] <= 1 for r in held)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (900, 901, 902)} == {UNKNOWN}
    assert predict_languages(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in predict_languages(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {UNKNOWN}
    for n in (1, 2, 4, 6, 9, 20):
        code = codewords(n)
        assert len({tuple(r) for r in code}) == n and set(np.unique(code)) <= {-1.0, 1.0}


def test_language_decoding_against_a_dense_reference(spark):
    """Counts, log-odds, margins, losses and ties, written out document by document."""
    from basisloom.llm import language_id as li

    rnd = random.Random(21)
    rows = [(speech(rnd, lang, rnd.randint(1, 30)), lang) for lang in SYLLABLES for _ in range(12)]
    model = li.fit(spark.createDataFrame(rows, "text string, lang string").repartition(5))
    langs, code = sorted(SYLLABLES), li.codewords(3)

    def grams(t):
        data = t.encode()
        slots, _ = li.gram_slots(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        return np.bincount(slots, minlength=li.SLOTS).astype(float)

    freq = []
    for lang in langs:
        total = sum(grams(t) for t, x in rows if x == lang) + 0.5
        freq.append(total / total.sum())
    weights, trust = [], []
    for bit in range(code.shape[1]):
        p, q = (np.mean([f for f, c in zip(freq, code[:, bit], strict=True) if c * side > 0], axis=0) for side in (1, -1))
        weights.append(np.log(p / q))
        trust.append(float(((p - q) * weights[-1]).sum()))
    trust = np.array(trust) / np.mean(trust)
    new = [speech(rnd, lang, n) for lang in SYLLABLES for n in (1, 2, 40)] + ["x", "zz", "the " * 100_000]
    got = li.identify(spark.createDataFrame([(t,) for t in new], "text string"), model).collect()
    for t, r in zip(new, got, strict=True):
        g = grams(t)
        margins = [li.STRENGTH / (max(g.sum(), 1) + li.SHRINK) * float(g @ w.astype(np.float32)) for w in weights]
        loss = np.array([sum(b * np.log1p(np.exp(-m * c)) for b, m, c in zip(trust, margins, word, strict=True)) for word in code])
        assert r["lang_pred"] == langs[int(loss.argmin())]
        assert r["score"] == pytest.approx(1 / np.exp(loss.min() - loss).sum(), abs=1e-6)
        assert r["ambiguous"] == bool(np.sort(loss)[1] - loss.min() < li.AMBIGUOUS)
    # a single letter holds no n-gram: all losses are equal, the first language by name is taken and flagged
    assert (got[-3]["lang_pred"], got[-3]["ambiguous"]) == ("aa", True) and got[-3]["score"] == pytest.approx(1 / 3)


def test_mixed_text_is_flagged(spark):
    from basisloom.llm.language_id import fit, identify

    rnd = random.Random(8)
    train = spark.createDataFrame([(speech(rnd, lang, 40), lang) for lang in ("aa", "bb") for _ in range(40)], "text string, lang string")
    model = fit(train)
    pure = identify(spark.createDataFrame([(speech(rnd, "aa", 40),)], "text string"), model).first()
    mixed = [identify(spark.createDataFrame([(speech(rnd, "aa", 20) + " " + speech(rnd, "bb", 20),)], "text string"), model).first()["score"] for _ in range(3)]
    assert pure["score"] > 0.9 and not pure["ambiguous"] and min(mixed) < pure["score"]


def test_quality(spark):
    from basisloom.llm.quality import isotonic, score_quality

    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = rnd.random() < 0.7
        words = [rnd.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(rnd.randint(5, 80))]
        rows.append((i, " ".join(words).capitalize() + "." if good else " ".join(w.upper() + rnd.choice(["!!", "###", "$$$"]) for w in words)))
        if i % 3:
            labels.append((i, int(good), 0))
    labels += [(1, 1, 0), (2, None, 0), (None, 1, 0), (99999, 0, 0)]
    rows += [(1000, None), (1001, ""), (1002, "x " * 50000)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in score_quality(frame(spark, rows), table).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    truth = {i: q for i, q, _ in labels if q is not None}
    held = [(got[i]["predicted"], truth[i]) for i in truth if i in got and got[i]["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.95
    none = score_quality(frame(spark, rows[:5]), table.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert score_quality(frame(spark, []), table).count() == 0
    x, y = isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.ones(4), np.array([1.0, 0.0, 0.0, 1.0]))
    assert y.tolist() == pytest.approx([1 / 3, 1.0]) and x.tolist() == pytest.approx([1.0, 3.0])


def test_ridge_and_calibration_against_dense_solutions(spark):
    from basisloom.llm import quality

    rng = np.random.default_rng(5)
    d, n = len(quality.STATISTICS), 500
    x = rng.normal(size=(n, d))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=n) > 0.3).astype(float)
    fold = np.arange(n) % quality.FOLDS
    table = spark.createDataFrame([(list(map(float, a)), float(b), int(f)) for a, b, f in zip(x, y, fold, strict=True)], "x array<double>, y double, fold int").repartition(7)
    model = quality.fit(table, features=24)
    z = model.features(x)
    assert model.mean == pytest.approx(x.mean(0)) and model.scale == pytest.approx(x.std(0))
    assert z[:, 1:] == pytest.approx(np.cos(np.clip((x - x.mean(0)) / x.std(0), -6, 6) @ model.turn + model.shift) * np.sqrt(2 / 24), abs=1e-9)

    def ridge(rows):
        a = z[rows].T @ z[rows] / rows.sum() + quality.RIDGE * np.diag([0.0] + [1.0] * 24) + 1e-9 * np.eye(25)
        return np.linalg.solve(a, z[rows].T @ y[rows] / rows.sum())

    assert model.ridge == pytest.approx(ridge(np.ones(n, bool)), abs=1e-6)
    unseen = np.concatenate([z[fold == f] @ ridge(fold != f) for f in range(quality.FOLDS)])
    seen = np.concatenate([y[fold == f] for f in range(quality.FOLDS)])
    edge = np.linspace(-0.5, 1.5, quality.CELLS + 1)
    cell = np.clip(np.searchsorted(edge, unseen) - 1, 0, quality.CELLS - 1)
    at, back = np.unique(cell, return_inverse=True)
    grid = quality.isotonic((edge[at] + edge[at + 1]) / 2, np.bincount(back).astype(float), np.bincount(back, weights=seen))
    assert model.grid[0] == pytest.approx(grid[0], abs=1e-6) and model.grid[1] == pytest.approx(grid[1], abs=1e-6)
    assert (np.diff(model.grid[1]) >= 0).all()


def test_sums_in_levels(spark, monkeypatch):
    from basisloom.llm import sums

    monkeypatch.setattr(sums, "FAN", 3)
    parts = spark.range(0, 20, 1, 20).selectExpr("CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS key", "id")
    packed = parts.rdd.map(lambda r: (r[0], bytearray(np.array([r[1], 1.0]).tobytes()))).toDF("key string, vector binary")
    assert {k: v.tolist() for k, v in sums.summed(packed).items()} == {"a": [90.0, 10.0], "b": [100.0, 10.0]}


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_hits(docs, bench):
    windows = {}
    for item, t in bench:
        w = WORD.findall(low(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(-1 if item is None else item)
    out = []
    for i, t in docs:
        w, hit, items = WORD.findall(low(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    items |= found
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), tuple(sorted(items)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16_000_000, 300])
def test_decontamination(spark, block):
    from basisloom.llm.decontamination import decontaminate

    rnd = random.Random(6)
    vocabulary = [f"w{k}é" if k % 5 == 0 else f"W{k}" for k in range(60)]
    bench = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 40)))) for k in range(20)] + [(50, None), (51, "..."), (None, "only these three"), (3, "another text of item three entirely its own with more than thirteen words in it all told"), (52, "solo")]
    docs = []
    for i in range(40):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 200))]
        if i % 2:
            part = (rnd.choice(bench)[1] or "").split(" ")
            a = rnd.randint(0, max(0, len(part) - 5))
            at = rnd.randint(0, len(words))
            words[at:at] = part[a : a + rnd.randint(5, 40)]
        docs.append((i, rnd.choice([" ", ", ", "-"]).join(words)))
    docs += [(100, None), (101, ""), (102, "!!!"), (None, bench[0][1]), (103, "solo"), (103, "solo"), (103, "x " * 30000 + (bench[1][1] or ""))]
    got = decontaminate(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string"), block).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got), key=str) == brute_hits(docs, bench)


def test_blocks_of_the_benchmark_agree(spark):
    """One block and many give the same rows, on texts and words that a polynomial would take for each other too."""
    from basisloom.llm.decontamination import decontaminate
    from test_tokens import twins

    rnd = random.Random(16)
    words = [f"v{k}" for k in range(400)]
    bench = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 60)))) for k in range(150)] + [(1000 + k, t) for k, (_, t) in enumerate(twins()) if k % 2 == 0]
    docs = [(k, " ".join([*(rnd.choice(words) for _ in range(rnd.randint(0, 300))), *bench[rnd.randrange(150)][1].split()[: rnd.randint(0, 30)]])) for k in range(400)]
    docs += [(5000 + k, t) for k, (_, t) in enumerate(twins())]
    found = []
    for block in (16_000_000, 4000):
        got = decontaminate(frame(spark, docs).repartition(3), spark.createDataFrame(bench, "item_id long, text string"), block).collect()
        found.append(sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got))
    assert found[0] == found[1] == sorted(brute_hits(docs, bench), key=lambda r: r[0])


def test_decontamination_empty(spark):
    from basisloom.llm.decontamination import decontaminate

    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate(frame(spark, [(1, "a b c")]), none).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in got] == [(3, 0, False)]
    assert decontaminate(frame(spark, []), none).count() == 0


def test_chat_round_trip(spark):
    from basisloom.llm.chat_format import examples, format_conversations, materialise, read_back

    rnd = random.Random(7)
    nasty = ["</s>\n", "[INST]", "[/INST]", "<\\", "\\\\", "<", "[", "\n", "é日", "a", " ", "\\"]
    rows = []
    for c in [*range(25), None]:
        for turn in range(rnd.randint(1, 9)):
            rows.append((c, turn, rnd.choice(["user", "assistant", "system", "odd[INST]role"]), None if rnd.random() < 0.1 else "".join(rnd.choice(nasty) for _ in range(rnd.randint(0, 15)))))
    rows += [(77, 0, None, "x"), (77, None, "user", "first"), (77, 1, "assistant", "y"), (77, 1, "assistant", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS at", "2 AS formatted", "3 AS turns")
    made = format_conversations(table).cache()
    want = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], -1 if r[1] is None else r[1], r[2] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    for r in read_back(made).collect():
        turns = [(t["role"], t["text"]) for t in r["turns"]]
        assert turns == want[r["conv_id"]]
        assert r["replies_text"] == [t for role, t in turns if role == "assistant"]
    whole = {r["conv_id"]: r["formatted"] for r in made.collect()}
    assert all(whole[c].count("[INST]") == len(t) == whole[c].count("</s>\n") for c, t in want.items())
    cut = {(r["conv_id"], r["example"]): (r["context"], r["reply"]) for r in materialise(made).collect()}
    for r in examples(made).collect():
        text = whole[r["conv_id"]]
        assert cut[r["conv_id"], r["example"]] == (text[: r["start"]], text[r["start"] : r["end"]])
    assert len(cut) == sum(role == "assistant" for t in want.values() for role, _ in t)
    assert format_conversations(table.limit(0)).count() == 0


def test_chat_of_very_long_texts(spark):
    from basisloom.llm.chat_format import format_conversations, read_back

    long = "[<\\" * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long[::-1]), (2, 0, "assistant", "")]
    got = {r["conv_id"]: r for r in read_back(format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [t["text"] for t in got[1]["turns"]] == [long, long[::-1]] and got[1]["replies_text"] == [long[::-1]] and got[2]["replies_text"] == [""]


def test_chat_query_stays_native(spark, tmp_path):
    from basisloom.llm.queries import op10_chat_format

    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = op10_chat_format(spark, str(tmp_path))
    assert not re.search("Python|Arrow|Pandas|PythonRDD", out._jdf.queryExecution().executedPlan().toString())
    got = {r["conv_id"]: r for r in out.collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-1]["loss_chars"] == len(said) and got[1]["loss_sha256"] == hashlib.sha256(b"a").hexdigest()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(12)
    rows = [(i, speech(rnd, rnd.choice(list(SYLLABLES)), 60)) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " plus"), (102, "12345"), (103, None)]
    passage = speech(rnd, "bb", 30)
    rows.append((104, passage))
    langs = {i: "en" for i, _ in rows}
    docs = spark.createDataFrame([(i, t, langs[i], "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "decontamination", "best_fit_packing"]
    left, gone = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r[0] for r in left.select("doc_id").collect()}
        stage(spark, left, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        left = spark.read.parquet(f"{tmp_path}/{k}")
        assert left.columns == docs.columns
        gone[name] = before - {r[0] for r in left.select("doc_id").collect()}
    assert gone == {"language_id": {102, 103}, "exact_dedup": {100}, "ngram_join": {101}, "decontamination": {104}}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in left.select("doc_id").collect()}


def test_text_stages_decide_by_row(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(13)
    clean = [speech(rnd, "aa", 40) for _ in range(8)]
    passage = speech(rnd, "bb", 30)
    rows = [(None, clean[0]), (None, clean[1]), (7, clean[2]), *((i, t) for i, t in enumerate(clean[3:], 20))]
    junk, dirty = [(None, "12345"), (7, None), (7, "...")], [(None, passage), (7, passage)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words long"
    table = lambda kind: spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in kind], schema)
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage, bad in ((corpus_pipeline.language_id, junk), (corpus_pipeline.decontamination, dirty)):
        left = stage(spark, table(rows + bad), str(tmp_path))
        assert left.columns == table(rows).columns
        assert sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, table(rows).collect()), key=str)


def test_dedup_stages_drop_rows(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(14)
    one, two, three, four = (speech(rnd, "aa", 60) for _ in range(4))
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, _row string")
    rows = [(1, one), (5, one), (5, two), (5, two), (None, two), (None, three), (None, three), (None, one), (9, four), (9, four), (2, None), (None, "")]
    want = {(1, one), (5, two), (None, three), (9, four), (2, None)}
    near = [(1, one), (5, one + " plus"), (5, two), (None, two + " plus"), (None, three), (None, three + " plus"), (9, four)]
    for stage, given, left in ((corpus_pipeline.exact_dedup, rows, [want]), (corpus_pipeline.ngram_join, near, [{(1, one), (5, two), (None, t), (9, four)} for t in (three, three + " plus")])):
        docs = table([(i, t, "en", f"r{k}") for k, (i, t) in enumerate(given)])
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        got = [(r["doc_id"], r["text"]) for r in got.collect()]
        assert len(got) == len(set(got)) and set(got) in left


def test_pipeline_of_odd_tables(spark, tmp_path):
    """An empty table, and one with null ids, repeated rows, null texts and columns named like the operators' own."""
    import corpus_pipeline

    rnd = random.Random(15)
    schema = "doc_id long, text string, lang string, source string, n_chars long, _dropped long, component_id string, kept string, score double"
    texts = [speech(rnd, "aa", 40) for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[0]), (3, texts[1]), (3, texts[1]), (3, texts[2]), (4, None), (5, texts[3] + " x"), (6, texts[3])]
    spark.createDataFrame([(0, "some words")], "item_id long, text string").write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    table = spark.createDataFrame([(i, t, "en", "s", 0, 1, "c", "k", 0.5) for i, t in rows], schema)
    table.write.parquet(f"{tmp_path}/odd/documents.parquet")
    packed = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in packed) == [(False, 3), (False, 3), (False, 5), (True, 0)]
    table.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_chat_query_expands_replies(spark, tmp_path):
    from basisloom.llm.queries import op10_chat_format

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a<["), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (2, 0, "user", "no reply"), (None, 0, "assistant", "c"), (3, 0, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = op10_chat_format(spark, str(tmp_path))
    assert "posexplode" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"], r["loss_sha256"]) for r in out.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == 5 and got[1] == (4, 4, sha("a<[b")) and got[2] == (1, 0, sha("")) and got[None] == (1, 1, sha("c")) and got[3] == (1, 0, sha(""))
