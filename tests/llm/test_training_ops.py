"""The training-data operators against brute force, on a fixture of awkward rows and on sf0.001."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import DATA
from triagelake.llm import bpe, language, line_dedup, lm_score, media, mixing, near_dedup, substring_dedup, topk, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, name, *cols, sf="sf0.001"):
    return [tuple(r) for r in spark.read.parquet(str(DATA / sf / f"{name}.parquet")).select(*cols).collect()]


def awkward():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared, line = say(60), "  This Line stands in MANY documents, Éven with capitals  "
    base = say(200)
    near = base.split()
    near[7] = "changed"
    out = [
        (0, base), (1, " ".join(near)), (2, base), (3, None), (4, ""), (5, "   \n\n  "), (6, "x " * 25), (7, "x " * 30),
        (8, say(40) + " " + shared + " " + say(30)), (9, shared + "\n" + say(50)), (10, "one two three"), (11, "one two three"),
        (12, "日本語のテキスト" * 300), (13, say(30000)), (14, "end <|endoftext|> of text"), (15, "a\tb\x0bc\x0cd\re f"), (16, "1234 *** !!!"),
    ]
    out += [(20 + i, f"{say(10)}\n{line if i % 2 else line.lower()}\n{line}\n{say(12)}") for i in range(7)]
    out += [(40 + i, base + f" tail{i}") for i in range(30)]
    return out


@pytest.fixture(scope="module")
def odd(spark):
    rows = awkward()
    data = [(d, t, ["en", "de", None][d % 3], [None, "a", "b", "c"][d % 4], len(t or ""), "kept", 1) for d, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score string, n_words int").repartition(5)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < -1")


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    docs = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add(d)
    top = {k: max(v) for k, v in docs.items() if len(k) >= 40 and len(v) >= 5}
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if top.get(key(x), d) == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(odd, none):
    got = {r["doc_id"]: (r["__n_lines"], r["__n_dropped"], r["text"]) for r in line_dedup.dedup_lines(odd).collect()}
    want = brute_lines(awkward())
    assert got == want and sum(v[1] for v in want.values()) == 9
    assert line_dedup.dedup_lines(none).collect() == []


def test_line_dedup_compacts_and_takes_null_and_repeated_ids(spark):
    line = "a line that is surely longer than forty characters"
    data = [(i, f"{line}\n{i}") for i in range(40)] + [(None, f"{line}\nnull")] + [(3, f"{line}\n3")] * 2
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = line_dedup.dedup_lines(df, batches=9).collect()
    assert len(got) == 43
    assert {r["doc_id"] for r in got if r["__n_dropped"] == 0} == {39}


def test_line_runs_hold_each_key_once(spark, tmp_path):
    """Only the anti-join keeps a key out of later runs, with the smaller documents of later batches."""
    runs = line_dedup.LineRuns(spark, str(tmp_path))
    for batch in range(7):  # descending documents
        data = [(1, 1, 100 - batch), (2, batch % 2, 90 - batch), (3, batch, 80 - batch)]
        runs.add(spark.createDataFrame(data, "__h1 long, __h2 long, __d long"))
        held = [tuple(r) for run in runs.runs() for r in spark.table(run).collect()]
        assert len({r[:2] for r in held}) == len(held) and (1, 1, 100) in held
    assert len(runs.levels) > 1 and runs.levels[1]
    assert sorted(map(tuple, runs.frequent(4).collect())) == [(1, 1, 100), (2, 0, 90)]
    plan = spark.table(runs.runs()[0]).join(spark.table(runs.counts[-1]).hint("merge"), line_dedup.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.drop()


def test_mixing(spark, odd):
    for docs in (odd, spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))):
        got = mixing.mix(docs).collect()
        size = defaultdict(int)
        for r in got:
            assert r["__size"] == len(WORD.findall(r["text"] or ""))
            size[r["source"]] += r["__size"]
        total = sum(size.values())
        order = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
        weight = {s: i % 3 + 1 for i, s in enumerate(order)}
        goal, open_ = {}, set(order)
        while True:  # pour until none is above
            rest = total - sum(goal.values())
            over = {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 3 * size[s]}
            if not over:
                goal |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
                break
            goal |= {s: 3 * size[s] for s in over}
            open_ -= over
        taken = defaultdict(int)
        largest = defaultdict(int)
        for r in got:
            assert r["__target"] == pytest.approx(goal[r["source"]])
            assert 0 <= r["__times"] <= 3 and (r["__size"] > 0 or r["__times"] == 0)
            taken[r["source"]] += r["__times"] * r["__size"]
            largest[r["source"]] = max(largest[r["source"]], r["__size"])
        for s in order:
            assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1
        again = {(r["doc_id"], r["__times"]) for r in mixing.mix(docs).collect()}
        assert again == {(r["doc_id"], r["__times"]) for r in got}


def test_mixing_takes_by_unequal_probabilities(spark):
    """Documents of 64 words are included about 4 times as often as those of 4; a plain random order takes both alike."""
    data = [(i, "a", "w " * (64 if i % 2 else 4)) for i in range(4000)] + [(9000 + i, "b", "w " * 40) for i in range(20)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, source string, text string"), weights=(1, 9)).collect()
    taken = Counter((r["__size"], r["__times"]) for r in got if r["source"] == "a")
    times = sum(r["__target"] for r in got if r["doc_id"] == 0) / (4000 * 34)
    whole = int(times)
    share = {n: taken[n, whole + 1] / 2000 for n in (4, 64)}
    assert times < 3 and 0 < share[4] < 1 and (share[64] == 1 or 3 < share[64] / share[4] < 5.5)
    assert abs(sum(r["__size"] * r["__times"] for r in got if r["source"] == "a") - times * 4000 * 34) <= 33


def test_mixing_without_broadcast(spark, odd, monkeypatch):
    want = {(r["doc_id"], r["__times"], r["__target"]) for r in mixing.mix(odd).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert {(r["doc_id"], r["__times"], r["__target"]) for r in mixing.mix(odd).collect()} == want


def test_mixing_empty_and_repeated(spark, none):
    assert mixing.mix(none).collect() == []
    twice = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c d e", None), (None, None, None), (2, " ", "t")], "doc_id long, text string, source string")
    got = mixing.mix(twice).collect()
    assert len(got) == 5 and len({r["__times"] for r in got if r["doc_id"] == 1}) == 1
    assert all(r["__times"] == 0 for r in got if r["__size"] == 0)


def test_topk_edges(spark):
    rnd = random.Random(2)
    data = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(900)]
    data += [(1000 + i, [0.5] * 8) for i in range(400)]
    odd = [(None, [0.1] * 8), (2000, None), (2100, [0.1, None] * 4), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8), (2500, [0.2] * 3)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>")
    rows = topk.integers(df)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(rows.where("id % 100 = 0"), rows, tree_rows=300).collect())
    assert got == sorted(topk.brute_force((i, [math.floor(1024 * x) for x in v]) for i, v in data))
    assert topk.top_k(rows.where("id < 0"), rows.where("id < 0")).collect() == []
    empty = topk.integers(spark.createDataFrame([(100, []), (101, []), (101, []), (102, [1.0])], "vec_id long, embedding array<double>"))
    got = topk.top_k(empty.where("id = 100"), empty).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 101, 0), (2, 101, 0)]


def test_mtree_skips_distances():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(4000, 4)) * 1024).astype(np.int64)
    pages, m2 = topk.build(np.arange(4000), x)
    counts = [0]
    best = topk.search(pages, m2, x[5], 5, 10, counts)
    scores = x @ x[5]
    want = sorted(((int(-s), i) for i, s in enumerate(scores) if i != 5))[:10]
    assert best == [(-s, i) for s, i in want] and counts[0] < 2000


def test_bpe(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_tokenizer())
    rows = bpe.encode(odd).collect()
    for r in rows:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["score"] == "kept"
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd)).select("text", "decoded").collect()
    assert all((r["text"] or "") == r["decoded"] for r in back)
    assert bpe.encode(none).collect() == []


@pytest.mark.parametrize("bits", [4, 7, 10])
def test_bpe_joins_are_repaired(bits, monkeypatch):
    monkeypatch.setattr(bpe, "CUT_BITS", bits)
    rnd = random.Random(3)
    alphabet = ["the", "a", " ", "  ", "\n", "é", "1", "'s", "don't", "…", "日本", "word", "x", "<|endoftext|>", "\t", "A", "🙂"]
    tok = bpe.Coder(bpe.default_tokenizer())
    shared = " ".join(rnd.choice(alphabet) for _ in range(4000))
    texts = ["".join(rnd.choice(alphabet) for _ in range(n)) + shared for n in (10, 2000, 6000)]
    texts += ["日本語のテキスト" * 400, "a" * 5000, " " * 3000 + "x", "ab'" * 900, "<|endoftext|>" * 300, "1234567890" * 300, "", None, "é"]
    for text, (ids, back) in zip(texts, tok.texts(texts)):
        assert b"".join(bpe.chunks((text or "").encode())) == (text or "").encode()
        want = tok.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and back.decode() == tok.tokenizer.decode(want, skip_special_tokens=False)
    assert tok.reused > 5 and tok.reused_bytes > len(shared)


@given(st.lists(st.sampled_from(["the", " ", "  ", "\n\n", "é", "12", "'s", "'", "n't", "日", "word", "<|endoftext|>", "<|endo", "ftext|>", "\u00a0", "🙂", "!?", "\r"]), max_size=300))
@settings(max_examples=150, deadline=None)
def test_bpe_equals_the_library(parts):
    import unittest.mock

    tok = bpe.coder(bpe.default_tokenizer())
    text = "".join(parts)
    with unittest.mock.patch.object(bpe, "CUT_BITS", 4):
        ids, _ = next(tok.texts([text]))
    assert np.frombuffer(ids, "<u4").tolist() == tok.tokenizer.encode(text, add_special_tokens=False).ids


def brute_classes(rows):
    bags = {}
    for d, t in rows:
        w = (t or "").lower().encode().split()
        n = min(5, len(w))
        bags[d] = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()
    parent = {d: d for d in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for d, b in bags.items():
        for s in b:
            where[s].append(d)
    pairs = {(a, b) for v in where.values() for a in v for b in v if a < b}
    for a, b in pairs:
        both = sum((bags[a] & bags[b]).values())
        if both / (sum(bags[a].values()) + sum(bags[b].values()) - both) >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: root(d) for d in bags}


def test_near_dedup(spark, odd, none):
    assert {r["id"]: r["class"] for r in near_dedup.classes(odd).collect()} == brute_classes(awkward())
    assert near_dedup.classes(none).collect() == []
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == set(brute_classes(awkward()).values())


def test_near_dedup_on_table(spark):
    rows = rows_of(spark, "documents", "doc_id", "text", sf="sf0.01")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["class"] for r in near_dedup.classes(df).collect()}
    want = brute_classes(rows)
    assert sum(got[d] != want[d] for d in want) <= len(want) // 1000
    repeated = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None)], "doc_id long, text string")
    assert len(near_dedup.classes(repeated).collect()) == 4


def test_near_dedup_of_ids_with_other_texts(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven", "other words stand in this text")
    df = spark.createDataFrame([(1, a), (1, b), (2, c), (3, b), (4, a), (None, a), (None, None), (4, a)], "doc_id long, text string")
    kept = near_dedup.keep_one(df).collect()
    assert Counter(r["text"] for r in kept) == Counter([a, b, c, None])
    got = {(r["real"], r["name"], (r["id"] == r["class"])) for r in near_dedup.classes(df).collect()}
    assert {x[:2] for x in got} == {(1, 1), (2, 2), (3, 1), (4, 1), (None, 1), (None, None)}


def test_near_dedup_tiles():
    rng = random.Random(4)
    base = [rng.randrange(10**9) for _ in range(300)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 12)):
            w[rng.randrange(300)] = rng.randrange(10**9)
        texts.append(" ".join(map(str, w)))
    bags = [near_dedup.shingles(t) for t in texts]
    links = near_dedup.tile_links(list(range(60)), list(range(60)), bags)
    want = brute_classes(list(enumerate(texts)))
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
        assert near_dedup.jaccard(bags[a], bags[b]) >= 0.8
    assert len({root(i) for i in range(60)}) == len(set(want.values())) and len(links) == 60 - len(set(want.values()))


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(8)
    e = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    a, b = rng.integers(1, 5, len(e)).astype(float) * 0.75, rng.integers(1, 5, len(e)).astype(float) * 0.75
    x, y = near_dedup.dart_minhash([(e, a), (e, b)], 4000)
    assert abs((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_language(spark, odd, none):
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    from triagelake.llm.queries import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op6_language"](spark, str(DATA / "sf0.01")).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in held} == {d for d, r in got.items() if r["held_out"]}
    real = [r for r in held if r["lang"] and re.search(r"[^\W\d_]", r["text"] or "")]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in real) >= 0.97 * len(real)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    model = language.train(odd, language.learnable(odd["doc_id"]))
    out = {r["doc_id"]: r["lang_pred"] for r in language.predict(odd, model).collect()}
    assert out[3] == out[4] == out[5] == out[16] == "und" and out[0] in ("en", "de")
    assert language.keep_language(none).collect() == []
    kept = language.keep_language(odd).collect()
    assert kept and all(r["score"] == "kept" for r in kept)  # a column of the same name stays what it was
    assert [language.predict_one(model, t)[0] for t in ("½ ²", "Ⅷ ①", "12 _", None)] == ["und"] * 4
    again = spark.createDataFrame([(None, "w1 w2", "en"), (3, "w1 w2", "en"), (3, "w1 w2", "en")], "doc_id long, text string, lang string")
    assert len({(r["lang_pred"], r["score"]) for r in language.predict(again, model).collect()}) == 1


def test_language_grams_are_of_characters():
    def brute(text):
        t = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
        return sum(max(0, len(t) - n + 1) for n in (1, 2, 3, 4))

    for text in ("日本語 text", "Привет, мир 12", "a", "né!!x"):
        assert language.grams(text)[1].sum() == brute(text)
    assert not len(language.grams("12 ?")[0])


def brute_lm(rows):
    learn = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    split = lambda t: (t or "").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    tokens = lambda t: WORD.findall(split(t)) + [None]
    c = Counter(w for _, t in learn for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {d: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, t in rows}


def test_lm_score(spark, odd, none):
    from pyspark.sql import functions as F

    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    docs = odd.withColumn("__row", F.lit(1)).withColumn("Base_Score", F.lit("x"))
    want, scores = brute_lm(awkward()), []
    for head, most in ((200_000, 10**6), (20, 30)):  # words and pairs that are not shared are joined
        out = lm_score.score(docs, crc != 2, head=head, most_pairs=most)
        assert sorted(out.columns) == sorted(["doc_id", "lang", "source", "n_chars", "n_words", "__row", *lm_score.NEW])
        got = out.collect()
        assert len(got) == len(want)
        for r in got:
            w = want[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
            assert r["base_score"] == pytest.approx(w[3], rel=1e-9) and r["score"] < 0
        scores.append({r["doc_id"]: r["score"] for r in got})
    for s in scores[1:]:
        assert s == pytest.approx(scores[0], rel=1e-4)
    assert lm_score.score(none.select("doc_id", "text"), crc != 2).collect() == []
    odd_ids = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (None, None)], "doc_id long, text string")
    rows = lm_score.score(odd_ids, F.coalesce(crc != 2, F.lit(False))).collect()
    assert len(rows) == 4 and {r["n_tokens"] for r in rows} == {1, 3} and rows[0]["train_tokens"] == 6


def test_lm_score_of_a_word_by_hand(spark):
    """Every probability anew, from counts and weights: the mean of ids and share, of a frequent, a rare and a new word."""
    rng = np.random.default_rng(2)
    sub, m = lm_score.subwords(lm_score.default_ranks()), lm_score.Model(rng.integers(0, 50, lm_score.IDS))
    pairs = np.array([(10, 20, 5), (20, 30, 7)])
    m.within(pairs, np.array([(10, m.of[20], 5), (20, m.of[30], 7)]))
    text, known = [b"alpha", b"beta", b"alpha", b"gammas"], {b"alpha": 9, b"beta": 4}
    inside = lambda ids: float(m.insides(ids, np.zeros(1, np.int64))[0][0])
    flat = [sub.encode([w])[0].astype(np.int64) for w in text]
    seq = np.append(np.concatenate(flat), lm_score.END_ID)
    ins, outs, ok, _ = m.windows([seq])
    logs = m.forward(ins).reshape(*ins.shape, -1)[:, lm_score.OVERLAP :]
    each = np.take_along_axis(logs, m.of[outs][:, :, None], 2)[:, :, 0][ok]
    edge, want = np.cumsum([0, *map(len, flat)]), 0.0
    for i, w in enumerate(text):
        want += math.log10(0.5 * known.get(w, 0) / 40 + 0.5 * math.exp(each[edge[i] : edge[i + 1]].sum() + inside(flat[i])))
    want += math.log10(0.5 * 6 / 40 + 0.5 * math.exp(each[-1] + m.inside[lm_score.END_ID]))
    m.freeze().know(sub, list(known), np.array(list(known.values())), 6, 40)
    found, base, total, *later = m.block(sub, [text])
    assert total[0] == pytest.approx(want, rel=1e-5) and found[0] == 3 and later[2] == [b"gammas"] and base[0] == pytest.approx(2 * math.log10(10) + math.log10(5))


def test_lm_beats_the_base_where_it_learnt(spark):
    from triagelake.llm.queries import QUERIES

    got = QUERIES["op7_lm_score"](spark, str(DATA / "sf0.01")).collect()
    learnt = [r for r in got if not r["held_out"]]
    assert learnt and sum(r["score"] for r in learnt) > sum(r["base_score"] for r in learnt)


def test_lm_scores_each_token_once():
    model = lm_score.Model(np.ones(lm_score.IDS)).freeze()
    for n in (1, 11, 12, 13, 24, 25, 200):
        _, outs, ok, _ = model.windows([np.arange(n)])
        assert outs[ok].tolist() == list(range(n))


def test_lm_least_count_is_exact(spark):
    rng = random.Random(6)
    for counts, most, cells in (([1] * 50, 9, 7), (list(range(1, 500)), 40, 5), ([rng.randrange(1, 10**6) for _ in range(400)], 100, 8), ([5, 5, 5, 9], 2, 4), ([3], 1, 4)):
        df = spark.createDataFrame([(c,) for c in counts], "n long")
        t = lm_score._least(df, most, cells)
        kept = lambda t: sum(c >= t for c in counts)
        assert kept(t) <= most and (t == 1 or kept(t - 1) > most)


def test_lm_shares_within_classes():
    rng = np.random.default_rng(5)
    m = lm_score.Model(rng.integers(0, 50, lm_score.IDS))
    pairs = np.unique(rng.integers(0, 400, (600, 2)), axis=0)
    pairs = np.column_stack([pairs, rng.integers(1, 90, len(pairs))])
    n = {(i, j): k for i, j, k in pairs.tolist()}
    by = Counter()
    for (i, j), k in n.items():
        by[i, int(m.of[j])] += k
    m.within(pairs, np.array([(*k, v) for k, v in by.items()]))
    for i in (int(pairs[0, 0]), int(pairs[-1, 0]), 7000):  # the last has no pair
        for c in {int(m.of[j]) for a, j, _ in pairs if a == i} | {int(m.of[40000])}:
            ids = np.flatnonzero(m.of == c)
            words = np.column_stack([np.full(len(ids), i), ids]).astype(np.uint16)
            got = m.insides(words.ravel(), 2 * np.arange(len(ids)))[0] - m.inside[i]
            total = sum(n.get((i, int(j)), 0) for j in ids)
            want = [(n.get((i, int(j)), 0) + lm_score.PSEUDO * math.exp(m.inside[j])) / (total + lm_score.PSEUDO) for j in ids]
            assert np.exp(got) == pytest.approx(np.array(want), rel=1e-4) and np.exp(got).sum() == pytest.approx(1, abs=1e-4)
    ids = np.array([9, 8, 7, 9], np.uint16)
    both, word, code = m.insides(ids, np.array([0, 3]))
    assert word.tolist() == [0, 0] and code.tolist() == [(9 << 16) + 8, (8 << 16) + 7]
    alone = [m.insides(x, np.array([0]))[0][0] for x in (ids[:2], ids[1:3])]
    assert both[1] == m.inside[9] and both[0] == pytest.approx(alone[0] + alone[1] - m.inside[8])


def trained(rng):
    m = lm_score.Model(rng.integers(0, 50, lm_score.IDS), rng.random(lm_score.IDS) < 0.5)
    pairs = np.unique(rng.integers(0, [lm_score.IDS, lm_score.CLASSES], (50_000, 2)), axis=0)
    pairs[:500, 1] = -1
    pairs = np.unique(pairs, axis=0)
    m.follow(np.column_stack([pairs, rng.integers(1, 90, len(pairs))]), rng.integers(0, 9, lm_score.CLASSES))
    for n, a in m.w.items():
        m.w[n] = (a + rng.normal(0, 0.2, a.shape)).astype(np.float32)
    return m


@pytest.mark.parametrize("far", [0, 90])
def test_lm_score_is_the_log_softmax_of_forward(far):
    rng = np.random.default_rng(4)
    m = trained(rng)
    m.w["b"] += np.float32(far)  # large logits too
    docs = [np.append(rng.integers(0, lm_score.IDS - 1, n), lm_score.END_ID) for n in (0, 1, 11, 12, 40, 3000)]
    ins, outs, ok, whose = m.windows(docs)
    z = m.forward(ins).reshape(*ins.shape, -1)[:, lm_score.OVERLAP :]
    assert np.exp(z[:50]).sum(2) == pytest.approx(1, abs=1e-4)
    want = np.take_along_axis(z, m.of[outs][:, :, None], 2)[:, :, 0][ok]
    assert m.freeze().score(docs) == pytest.approx(want, rel=2e-3, abs=2e-3)


@given(st.lists(st.text(alphabet=st.sampled_from("ab'sD9é\u00a0\u3000\x1c\x85中!-"), min_size=1, max_size=6), max_size=12))
@settings(max_examples=200, deadline=None)
def test_lm_encodes_words_together_as_alone(words):
    sub = lm_score.subwords(lm_score.default_ranks())
    words = [w.encode() for w in words]
    ids, begin = sub.encode(words)
    got = [x.tolist() for x in np.split(ids, begin[1:])] if words else []
    assert got == [sub.encoding.encode_ordinary(" " + w.decode()) for w in words]


def test_lm_gradients():
    rng = np.random.default_rng(0)
    m = lm_score.Model(np.ones(lm_score.IDS), rng.random(lm_score.IDS) < 0.5)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    ids, out = rng.integers(0, 500, (30, lm_score.WINDOW)), rng.integers(0, 50000, (30, lm_score.WINDOW - 2))

    def loss():
        z = m.forward(ids).reshape(30, lm_score.WINDOW, -1)[:, 2:]
        return -float(np.take_along_axis(z, m.of[out][:, :, None], 2).mean())

    g = m.gradients(ids, out)
    rows = g.pop("rows").tolist()
    for name in g:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in m.w[name].shape)
            if name == "E":
                at = (rows[at[0] % len(rows)], at[1])
            own = g[name][rows.index(at[0]), at[1]] if name == "E" else g[name][at]
            m.w[name][at] += 1e-4
            up = loss()
            m.w[name][at] -= 2e-4
            down = loss()
            m.w[name][at] += 1e-4
            assert (up - down) / 2e-4 == pytest.approx(own, abs=2e-5), name


def test_lm_gradients_of_16_bit_ids():
    rng = np.random.default_rng(1)
    m = trained(rng)
    ids, out = rng.integers(0, lm_score.IDS, (40, lm_score.WINDOW)), rng.integers(0, lm_score.IDS, (40, lm_score.WINDOW - lm_score.OVERLAP))
    want, got = m.gradients(ids, out), m.gradients(ids.astype(np.uint16), out.astype(np.uint16))  # as piece_windows has them
    for n in want:
        assert got[n] == pytest.approx(want[n], abs=1e-6), n


def test_lm_counts_words_where_it_cuts_pieces():
    texts = [t for _, t in awkward()] + ["\u00c9 \u00c0B\x1cc\x1d d\x85e \x0b\x0cA\x00B", " \r\n", "\u0130 I K \u3000 i"]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "t": texts})
    want = Counter(w for t in texts for w in [*lm_score.words_of(t), lm_score.END])
    sub = lm_score.subwords(lm_score.default_ranks())
    for most, step in ((10**6, 100), (100, 7)):  # one vocabulary, or a new one whenever it is full
        run = lm_score._pieces(lm_score.default_ranks(), True, most)
        rows = [r for b in run(iter([batch.slice(i, step) for i in range(0, len(texts), step)])) for r in b.to_pylist()]
        got = Counter()
        for r in rows:
            if r["turn"] < 0:
                got[r["ids"]] += r["n"]
        assert got == want
        for k, t in enumerate(texts):
            own = sorted((r["turn"], r["ids"]) for r in rows if r["turn"] >= 0 and r["key"] == k)
            ids = np.concatenate([np.frombuffer(x, "<u2")[lm_score.OVERLAP + 1 :] for _, x in own])
            assert ids.tolist() == [*sub.encode(lm_score.words_of(t))[0].tolist(), lm_score.END_ID]
    assert [len(b) for b in lm_score._pieces(lm_score.default_ranks(), True)(iter([]))] == []


def test_lm_fits_on_every_window(spark, odd, tmp_path):
    sub = lm_score.subwords(lm_score.default_ranks())
    texts = [np.append(sub.encode(lm_score.words_of(t))[0], lm_score.END_ID) for _, t in awkward()]
    pieces = [r for b in lm_score._pieces(lm_score.default_ranks())([pa.RecordBatch.from_pydict({"k": [k for k, _ in awkward()], "t": [t for _, t in awkward()]})]) for r in b.to_pylist()]
    ins, outs, ok = lm_score.piece_windows([r["ids"] for r in pieces])
    scored = lm_score.Model(np.ones(lm_score.IDS)).windows(texts)
    kinds = lambda a, b, c: sorted((*x.tolist(), *y[z].tolist()) for x, y, z in zip(a, b, c) if z.all())
    assert kinds(ins, outs, ok) == kinds(*scored[:3])  # the windows that scoring has, whole ones with context and all
    assert sorted(outs[ok].tolist()) == sorted(np.concatenate(texts).tolist())
    got = []
    for parts in (1, 5):
        m = lm_score.Model(np.ones(lm_score.IDS))
        n = lm_score.fit_all(odd.select("doc_id", "text").repartition(parts), m, lm_score.default_ranks(), str(tmp_path / str(parts)))
        assert n == sum(map(len, texts))
        got.append(m.flat())
    assert got[0] == pytest.approx(got[1], abs=1e-5)
    seen = (m.w["E"] != lm_score.Model(np.ones(lm_score.IDS)).w["E"]).any(1)
    assert seen[np.unique(np.concatenate(texts))].all()  # a weight of every id of every text was fitted


def test_substring_dedup(spark, odd, none):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(odd).collect()}
    assert got == substring_dedup.brute_force(awkward())
    assert substring_dedup.dedup(none).collect() == []
    rows = rows_of(spark, "documents", "doc_id", "text")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(df, keep_text=False).collect()}
    assert got == substring_dedup.brute_force(rows)
    twice = spark.createDataFrame([(1, "q " * 22), (1, "q " * 22), (None, None)], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.dedup(twice).orderBy("doc_id").collect()] == [0, 21, 21]


def test_anchor_of_equal_windows_is_counted_twice():
    w = substring_dedup.hashes([b"x"] * 21)
    low, at = substring_dedup.anchors(w)
    assert len(low) == 2 and len(at) >= 2
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2**63, 500).astype(np.uint64)
    g = substring_dedup.rolling(w, 5, substring_dedup._A | np.uint64(1))
    low, at = substring_dedup.anchors(w)
    assert low.tolist() == [g[s : s + 16].min() for s in range(481)] and set(low.tolist()) == set(at.tolist())


def test_media(odd, none):
    for r in media.media(odd).collect():
        assert r["score"] == "kept"
    by = {r["doc_id"]: r for r in media.media(odd).collect()}
    for d, t in awkward():
        raw = (t or "").encode()
        pay = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = by[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert media.from_wav(bytes(r["media"])) == pay and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
    assert by[0]["feature"] == by[2]["feature"] != by[9]["feature"] and len(by[0]["fingerprints"]) > 3
    assert media.media(none).collect() == []


def test_warc(spark):
    pages = [(i, f"http://x/{i}", f"<p>{'same' if i % 3 == 0 else i}</p>" * 50, "extra") for i in range(60)]
    pages += [(100, None, None, None), (101, "u\r\nX: 1", "", ""), (None, "n", "<p>null</p>", ""), (102, "u", "\r\n\r\nWARC/1.1\r\n é" * 9000, ""), (59, "again", "<p>twice</p>", ""), (59, "again", "<p>twice</p>", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string").repartition(4)
    archives = warc.write(df)
    got = warc.read_archives(archives).collect()
    top = defaultdict(lambda: -1)
    for i, _, h, _ in pages:
        top[h or ""] = max(top[h or ""], -1 if i is None else i)
    want = []
    for i, _, h, _ in pages:
        data = (h or "").encode()
        t = top[h or ""]
        again = i is not None and i != t
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", t if again else None, b"" if again else data))
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in got) == Counter(want)
    assert warc.read_archives(warc.write(df.where("page_id < 0"))).collect() == []


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_mixing", "op3_topk", "op8_substring_dedup", "op10_warc"])
def test_query_equals_sql(spark, name):
    import duckdb

    from triagelake.llm.queries import QUERIES, SQL

    got = QUERIES[name](spark, str(DATA / "sf0.001"))
    con = duckdb.connect()
    for p in (DATA / "sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    order = [want.columns.index(c) for c in got.columns]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(key(tuple(r[i] for i in order)) for r in want.fetchall())


def test_media_fingerprints_by_direct_transform():
    rng = np.random.default_rng(3)
    data = (np.sin(np.arange(2048) / 5) * 40 + np.sin(np.arange(2048) / 3) * 30 + 128 + rng.normal(0, 2, 2048)).astype(np.uint8).tobytes()
    x = np.frombuffer(data, np.uint8).astype(float) - 128
    tops = []
    for start in range(0, len(x) - media.FRAME + 1, media.HOP):
        frame = x[start : start + media.FRAME] * np.hanning(media.FRAME)
        mag = np.array([abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(media.FRAME) / media.FRAME))) for k in range(media.FRAME // 2 + 1)])
        peaks = sorted((k for k in range(1, len(mag) - 1) if mag[k - 1] < mag[k] >= mag[k + 1]), key=lambda k: -mag[k])
        tops.append(peaks[: media.PEAKS])
    want = sorted((t << 24) | (a << 14) | (b << 4) | gap for t in range(len(tops)) for gap in range(1, media.REACH + 1) if t + gap < len(tops) for a in tops[t] for b in tops[t + gap])
    assert media.fingerprints(data).tolist() == want


def test_warc_reader_rejects_damage():
    w = warc.Writer(b"some raw content of a dictionary", True)
    good = w.start() + w.add(warc.record(1, "u", b"hello", None))
    assert warc.parse(next(warc.frames(good)))["payload"] == b"hello"
    rec = warc.record(1, "u", b"hello", None)
    for bad in (rec[:-1], rec.replace(b"hello", b"hellO"), rec.replace(b"WARC/1.1", b"WARC/9"), rec.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    for bad in (good[:-3], good[8:], b"", good[:20]):
        with pytest.raises(Exception):
            list(map(warc.parse, warc.frames(bad)))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet"))
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], str(DATA / "sf0.001")).persist())
    assert all(f.columns == docs.columns for f in frames[1:-1])
    counts = [f.count() for f in frames]
    assert counts[1] >= 0.9 * counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] == counts[5]
    lines = {r["doc_id"]: r["text"] for r in frames[2].collect()}
    want = brute_lines([(r["doc_id"], r["text"]) for r in frames[1].collect()])
    assert lines == {d: v[2] for d, v in want.items()}
    near = brute_classes([(r["doc_id"], r["text"]) for r in frames[2].collect()])
    assert {r["doc_id"] for r in frames[3].collect()} == set(near.values())
    times = Counter(r["doc_id"] for r in frames[4].collect())
    assert times == Counter({r["doc_id"]: r["__times"] for r in mixing.mix(frames[3]).collect() if r["__times"]})
    assert corpus_pipeline.run(spark, str(DATA / "sf0.001")).count() == counts[5]


def test_pipeline_stages_take_awkward_and_empty_tables(spark, odd, none):
    import corpus_pipeline

    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            rows = out.collect()
            assert name == "tokens" or out.columns == docs.columns
            assert docs is odd or rows == []


def test_components_of_few_links_take_few_jobs(spark, tmp_path):
    """One task unites them, with the labels of the shuffled way and of a plain union."""
    rnd = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rnd.integers(-(2**62), 2**62, 400)[rnd.integers(0, 400, (300, 2))]] + [(i, i + 1) for i in range(50)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    edges.write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = {tuple(r) for r in near_dedup.components(edges, str(tmp_path / "one")).collect()}
    assert len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before) <= 5
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == set(root.items())
    assert got == {tuple(r) for r in near_dedup.components(edges, str(tmp_path / "many"), one_task=0).collect()}
    none = spark.createDataFrame([], "a long, b long")
    assert near_dedup.components(none, str(tmp_path / "none")).count() == 0
