"""Suffix arrays, nearest neighbours, SimHash and the language model: against brute force, with the odd cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.llm import ann, gru_lm, simhash, suffix_dedup
from tests.llm.test_text_operators import documents

RANDOM = random.Random(5)
PIECES = ["".join(RANDOM.choice("ab\0c") for _ in range(RANDOM.randint(5, 40))) for _ in range(10)]
TEXTS = ["".join(RANDOM.choice(PIECES) if RANDOM.random() < 0.3 else "".join(RANDOM.choice("defghijk") for _ in range(20)) for _ in range(RANDOM.randint(0, 9))) for _ in range(80)]
TEXTS += [None, "", "a" * 300, "ab" * 200, "é" * 60, "x" * 19, "x" * 20, "zqwertyuiopasdfghjklmn", "zqwertyuiopasdfghjklmn"]


def removed(spark, texts, length, gram):
    return {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(documents(spark, texts), length, gram).collect()}


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 2])
def test_repeats_by_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    want = suffix_dedup.brute_force(TEXTS, 20)
    assert 0 < sum(w[1] for w in want) < 0.9 * sum(w[0] for w in want)
    assert removed(spark, TEXTS, 20, 6) == dict(enumerate(want))


def test_repeats_at_full_length(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    passage, other = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(200))
    texts = [other, f"{word()} {passage} {word()}", f"x{passage}", other[:199], passage[:199], passage[100:320], None, "é" * 150, "ü" + "é" * 99]
    assert removed(spark, texts, 200, 40) == dict(enumerate(suffix_dedup.brute_force(texts, 200)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6), st.sampled_from([1, 3, 100]))
def test_family_of_levels(texts, batch):
    """Whatever the batches, the family finds what looking every window up finds."""
    data, length, gram = [t.encode() for t in texts], 8, 3
    rows = [(k, s, n, o) for which, _, _, low, size, offset in suffix_dedup.anchors_of(data, length, gram) for k, s, n, o in zip(which, low, size, offset)]
    family = suffix_dedup.Family(length, gram)
    for a in range(0, len(rows), batch):
        part = rows[a : a + batch]
        family.add([data[k][s : s + n] for k, s, n, _ in part], np.array([o for *_, o in part]))
    spans: dict[int, list] = {}
    for (k, s, n, _), a, e in zip(rows, *family.find()):
        if e:
            spans.setdefault(int(k), []).append((int(s + a), int(s + e)))
    for k, want in enumerate(suffix_dedup.brute_force(texts, length)):
        runs = suffix_dedup.merge_spans(spans.get(k, []))
        assert (sum(e - s for s, e in runs), len(runs)) == want[1:3]


def test_batches_meet_levels_of_their_own_grams():
    """A batch that comes later finds its gram's entries in every level, and no others."""
    rng = random.Random(2)
    word = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    passages = [word(40) for _ in range(5)]
    texts = [word(rng.randint(0, 20)) + rng.choice(passages)[rng.randint(0, 9) :] + word(rng.randint(0, 20)) for _ in range(120)]
    rows = [(k, s, n, o, g) for which, g, _, low, size, offset in suffix_dedup.anchors_of(texts, 20, 6) for k, g, s, n, o in zip(which, g.view(np.int64), low, size, offset)]
    rng.shuffle(rows)
    family, spans = suffix_dedup.Family(20, 6), {}
    for a in range(0, len(rows), 17):
        part = rows[a : a + 17]
        family.add([texts[k][s : s + n] for k, s, n, *_ in part], np.array([r[3] for r in part]), np.array([r[4] for r in part]))
    for (k, s, *_), a, e in zip(rows, *family.find()):
        if e:
            spans.setdefault(int(k), []).append((int(s + a), int(s + e)))
    want = suffix_dedup.brute_force([t.decode() for t in texts], 20)
    assert [sum(e - s for s, e in suffix_dedup.merge_spans(spans.get(k, []))) for k in range(len(texts))] == [w[1] for w in want]


def test_levels_carry_like_a_counter():
    family = suffix_dedup.Family(8, 3)
    for k in range(5):
        family.add([bytes([97 + k]) * 10], np.array([2]))
    assert [len(x) if x else 0 for x in family.levels] == [1, 0, 4]


def test_segments_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 50)
    data = ["".join(RANDOM.choice(PIECES) for _ in range(30)), "q" * 30 + PIECES[0] * 3]
    encoded = [d.encode() for d in data]
    whole = sum(len(x[0]) for x in suffix_dedup.anchors_of(encoded, 20, 6))
    covered = {(int(k), int(p)) for which, _, _, low, size, _ in suffix_dedup.anchors_of(encoded, 20, 6) for k, s, n in zip(which, low, size) for p in range(s, s + n - 19)}
    assert whole and covered == {(k, p) for k, d in enumerate(encoded) for p in range(len(d) - 19)}


def test_repeats_of_rows_and_ids(spark):
    rows = [(1, "abcdefghijklmnopqrstuvwxyz"), (1, "abcdefghijklmnopqrstuvwxyz"), (2, "0123456789"), (2, "9876543210987654321098"), (None, "some text of no document"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs, 20, 6).collect())
    want = sorted((i or -1, w[0], w[1]) for (i, _), w in zip(rows, suffix_dedup.brute_force([t for _, t in rows], 20)))
    assert got == want


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.similar_groups(docs).count() == 0
    assert gru_lm.score_documents(docs).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def vectors(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"bucket": F.lit(1), "query": F.lit("clash"), "vec": F.lit(0)})


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[1500:] = x[:1500] + 0.3 * rng.normal(size=(1500, 32)).astype(np.float32)
    want = ann.brute_force(np.arange(3000), x.astype(float))
    rows = ann.search(vectors(spark, x)).collect()
    assert sorted({r["query_id"] for r in rows}) == sorted(want)
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q, hits in got.items():
        exact = {i: np.sqrt(((x[i].astype(float) - x[q].astype(float)) ** 2).sum()) for i, _ in hits}
        assert all(s == pytest.approx(exact[i], rel=1e-12) for i, s in hits) and len(hits) == 10
        assert [(s, i) for i, s in hits] == sorted((s, i) for i, s in hits)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    same = [[1.0, 2.0]] * 40
    x = same + [[2.0, 1.0], [-1.0, -2.0]]
    odd = spark.createDataFrame([(500, None), (501, [0.0, 0.0]), (502, [float("nan"), 1.0]), (503, [float("inf"), 1.0]), (504, [1.0, None]), (505, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (600, [-0.0, 5.0]), (7, [1.0, 2.0])], "vec_id long, embedding array<float>")
    rows = ann.search(vectors(spark, x).select("vec_id", "embedding").unionByName(odd), every=20).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 600}
    assert got[0] == [(k, k, 0.0) for k in range(1, 11)] and got[20] == [(k + 1, k, 0.0) for k in range(10)]
    assert [i for _, i, _ in got[40]] == list(range(10)) and len(got[600]) == 10


def test_few_candidates_are_all_found(spark):
    rows = ann.search(vectors(spark, [[1.0, 0, 0, 0], [-1.0, 0, 0, 0], [0, 0, 0, 3.0], [0, -2.0, 1, 1]], [0, 5, 100, 7]), probes=1).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in rows) == [(0, 5), (0, 7), (0, 100), (100, 0), (100, 5), (100, 7)]
    assert ann.search(vectors(spark, [[1.0, 2.0]], [0])).count() == 0


def components(links, n):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def brute_components(spark, docs):
    rows = docs.collect()
    fps = [simhash.fingerprint((r["text"] or "").encode()) for r in rows]
    ids = [r["doc_id"] for r in rows]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3]
    root = components(links, len(fps))
    least: dict = {}
    for r, i in zip(root, ids):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted((i if i is not None else -1, f"{f:016x}", least.get(r)) for i, f, r in zip(ids, fps, root))


def test_simhash_by_brute_force(spark):
    base = [" ".join(RANDOM.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60)) for _ in range(6)]
    texts = [None, "", " ", "one", "ONE", "one two", "a b c", "a b c d"] + base
    for t in base:
        words = t.split()
        for _ in range(6):
            w = words[:]
            w[RANDOM.randrange(len(w))] = RANDOM.choice(["alpha", "changed"])
            texts.append(" ".join(w))
    docs = documents(spark, texts + texts[:9])
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint(), "component_id").collect()
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in rows) == brute_components(spark, docs)


def test_fingerprint_equals_sparks_hash(spark):
    words = "The quick  brown\tfox\njumps".lower().split()
    shingles = [" ".join(words[k : k + 3]) for k in range(3)]
    row = spark.range(1).select(*[F.xxhash64(F.lit(s)) for s in shingles]).first()
    hashes = [h % 2**64 for h in row]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 1.5)
    assert simhash.fingerprint(b"The quick  brown\tfox\njumps") == want


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 150))
def test_bit_sliced_links(seed, n):
    """Small and large buckets: the forest connects exactly what is linked."""
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 2**63, 3).astype(np.uint64)
    flips = rng.integers(0, 7, n)
    out = set()
    for f in flips:
        x = int(values[rng.integers(3)])
        for b in rng.choice(64, f, replace=False):
            x ^= 1 << int(b)
        out.add(x)
    v = np.array(sorted(out), dtype=np.uint64)
    want = components([(a, b) for a in range(len(v)) for b in range(a) if bin(int(v[a]) ^ int(v[b])).count("1") <= 3], len(v))
    at = {int(x): k for k, x in enumerate(v)}
    for keys, own in ((np.zeros(len(v), np.uint64), v), (simhash._bucket_keys(v).reshape(-1), np.repeat(v, 16))):
        a, b = simhash.bucket_links(keys, own)
        assert components([(at[int(x)], at[int(y)]) for x, y in zip(a, b)], len(v)) == want


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 130), st.integers(1, 60))
def test_wide_links(seed, n, radius):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, (3, 2)).astype(np.uint64)
    prints = base[rng.integers(0, 3, n)]
    for k in range(n):
        for b in rng.choice(128, rng.integers(0, 40), replace=False):
            prints[k, b // 64] ^= np.uint64(1 << int(b % 64))
    distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    want = components([(a, b) for a in range(n) for b in range(a) if distance[a, b] <= radius], n)
    a, b = simhash.wide_links(np.zeros(n, np.int64), prints, radius)
    assert components(list(zip(a.tolist(), b.tolist())), n) == want


def test_similar_groups(spark):
    words = [f"w{k}" for k in range(400)]
    other = words[:]
    other[100] = other[300] = "changed"
    far = [w if k % 3 else "other" for k, w in enumerate(words)]
    rows = simhash.similar_groups(documents(spark, [" ".join(words), " ".join(other), " ".join(far), " ".join(words), None, "", "single"])).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4, 5: 4, 6: 6}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100}


LM_TEXTS = [None, "", " \n", "The cat sat.", "the the THE cat", "ünï \x0b x", "w " * 3000] + [" ".join(RANDOM.choice("a b c d e".split()) for _ in range(30)) for _ in range(40)] + ["a b", "a b"]


def test_language_model_base_by_brute_force(spark):
    docs = documents(spark, LM_TEXTS)
    rows = sorted((tuple(r) for r in gru_lm.score_documents(docs).collect()), key=lambda r: r[0])
    want = gru_lm.brute_force(list(enumerate(LM_TEXTS)))
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert [r[5] for r in rows] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(np.isfinite(r[6]) and r[6] < 0 for r in rows)


def test_outputs_are_a_distribution():
    stats = gru_lm.Statistics(1000, 50, np.arange(1, 21, dtype=np.uint64), np.arange(20, 0, -1), np.full(gru_lm.TAILS, 20.0), np.full(gru_lm.TAILS, 5.0), np.full(gru_lm.TAILS, 2.0))
    w = gru_lm.start_weights(stats)
    rng = np.random.default_rng(0)
    w["wc"], w["ww"] = rng.normal(size=w["wc"].shape).astype(np.float32), rng.normal(size=w["ww"].shape).astype(np.float32)
    h = rng.normal(size=(3, gru_lm.HIDDEN)).astype(np.float32)
    every = np.arange(gru_lm.HEAD + gru_lm.TAILS)
    for one in h:
        assert np.exp(gru_lm.log_outputs(w, np.repeat(one[None], len(every), axis=0), every)).sum() == pytest.approx(1, abs=1e-4)


def plain_steps(w, inputs, begins):
    """States after each input of one stream, one unit at a time; begins: where the state is zero."""
    n, h, out = gru_lm.HIDDEN, np.zeros(gru_lm.HIDDEN), []
    sigma = lambda x: 1 / (1 + np.exp(-x))
    for x, new in zip(inputs, begins):
        h = np.zeros(n) if new else h
        gx, gh = w["wx"][x] + w["b"], h @ w["u"]
        r, z = sigma(gx[:n] + gh[:n]), sigma(gx[n : 2 * n] + gh[n : 2 * n])
        h = (1 - z) * np.tanh(gx[2 * n :] + r * gh[2 * n :]) + z * h
        out.append(h)
    return out


def plain_log(w, h, target):
    """Natural log of the class' probability, times the word's within it for head words."""
    per, soft = gru_lm.HEAD // gru_lm.HEAD_CLASSES, lambda x: x - np.log(np.exp(x).sum())
    own = target // per if target < gru_lm.HEAD else gru_lm.HEAD_CLASSES + target - gru_lm.HEAD
    out = soft(h @ w["wc"] + w["bc"])[own]
    return out + (soft(h @ w["ww"][own] + w["bw"][own])[target % per] if target < gru_lm.HEAD else 0)


def some_weights(seed=0):
    stats = gru_lm.Statistics(1000, 50, np.arange(1, 21, dtype=np.uint64), np.arange(20, 0, -1), np.full(gru_lm.TAILS, 20.0), np.full(gru_lm.TAILS, 5.0), np.full(gru_lm.TAILS, 2.0))
    rng = np.random.default_rng(seed)
    return {k: (v + 0.4 * rng.normal(size=v.shape)).astype(np.float32) for k, v in gru_lm.start_weights(stats).items()}


def test_gradient_by_differences():
    """Every kind of weight: the gradient of a window is that of the loss written out plainly."""
    w, rng, begin = some_weights(), np.random.default_rng(1), gru_lm.HEAD + gru_lm.TAILS
    steps, streams = 6, 3
    targets = rng.choice([0, 1, 5, 40, 70, gru_lm.HEAD + 3, gru_lm.HEAD + 9], (steps, streams))
    inputs = np.concatenate([np.full((1, streams), begin), targets[:-1]])
    fresh = inputs == 1
    fresh[0] = True
    inputs = np.where(fresh, begin, inputs)
    grad = gru_lm.views(np.ones(sum(v.size for v in w.values()), np.float32))
    gru_lm.gradient(w, grad, inputs, targets, fresh, np.full((streams, gru_lm.HIDDEN), 7, np.float32))

    def loss(own):
        return -np.mean([plain_log(own, h, t) for k in range(streams) for h, t in zip(plain_steps(own, inputs[:, k], fresh[:, k]), targets[:, k])])

    wide = {k: v.astype(float) for k, v in w.items()}
    for name, value in wide.items():
        flat, known = value.reshape(-1), grad[name].reshape(-1)
        places = {int(np.abs(known).argmax()), *rng.choice(np.flatnonzero(known), 4).tolist(), *rng.integers(0, len(flat), 4).tolist()}
        for k in places:
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss(wide)
            flat[k] = old - 1e-5
            down = loss(wide)
            flat[k] = old
            assert known[k] == pytest.approx((up - down) / 2e-5, rel=2e-3, abs=2e-6), (name, k)


def test_score_by_brute_force(spark, monkeypatch):
    """The score is the sum over tokens of what the formulas give, one token at a time."""
    w, seen = some_weights(5), []
    monkeypatch.setattr(gru_lm, "CHUNK_BYTES", 400)
    monkeypatch.setattr(gru_lm, "train", lambda chunks, stats: seen.append(stats) or w)
    texts = [t for t in LM_TEXTS if t != "w " * 3000] + ["never seen", " ".join(f"z{k % 7}x" for k in range(60))] + [f"only{k} once" for k in range(1600)]
    rows = {r["doc_id"]: r["score"] for r in gru_lm.score_documents(documents(spark, texts)).collect()}
    (stats,) = seen
    import zlib
    from collections import Counter

    split = [[*(t or "").encode().lower().split(), b"\n"] for t in texts]
    count = Counter(x for k, words in enumerate(split) if zlib.crc32(str(k).encode()) % 7 != 2 for x in words)
    numbers = {x: (int(stats.place(gru_lm.word_hash([x]))[0]), zlib.crc32(x[-3:]) % gru_lm.TAILS) for words in split for x in words}
    assert len(stats.head) == gru_lm.HEAD and any(h < 0 for h, _ in numbers.values())
    wide = {k: v.astype(float) for k, v in w.items()}
    for k, words in enumerate(split):
        if k > 60 and k % 100:
            continue
        tokens = [h if h >= 0 else gru_lm.HEAD + tail for h, tail in map(numbers.get, words)]
        states = plain_steps(wide, [gru_lm.HEAD + gru_lm.TAILS, *tokens[:-1]], [True] + [False] * len(tokens[:-1]))
        want = sum(plain_log(wide, h, t) for h, t in zip(states, tokens)) / np.log(10)
        for word, (head, tail) in zip(words, map(numbers.get, words)):
            if head < 0:
                rest = [(x, n) for x, n in count.items() if numbers[x][0] < 0 and numbers[x][1] == tail]
                new = (sum(n == 1 for _, n in rest) + 0.5) / (sum(n for _, n in rest) + 1)
                want += np.log10((1 - new) * (count[word] + 1) / (sum(n for _, n in rest) + len(rest)) if count[word] else new / max(len(rest), 1))
        assert rows[k] == pytest.approx(want, rel=1e-4), k


def test_training_lowers_the_loss():
    """The training step lowers the loss of a sequence that it has seen."""
    stats = gru_lm.Statistics(1000, 50, np.arange(1, 21, dtype=np.uint64), np.arange(20, 0, -1), np.full(gru_lm.TAILS, 20.0), np.full(gru_lm.TAILS, 5.0), np.full(gru_lm.TAILS, 2.0))
    tokens = np.array([1, 2, 3, 4, 0] * 8000)
    before = gru_lm.start_weights(stats)
    after = gru_lm.train_replica(before, tokens, 0)
    sizes = np.full(8000, 5)
    score = lambda w: gru_lm.score_sequences(w, tokens, sizes).sum()
    assert score(after) > 0.6 * score(before)
    packed = gru_lm.unpack(gru_lm.pack(after))
    assert all((packed[k] == after[k]).all() for k in after)


def test_scores_do_not_depend_on_company():
    """A sequence's score is the same alone and among others of any length."""
    stats = gru_lm.Statistics(1000, 50, np.arange(1, 21, dtype=np.uint64), np.arange(20, 0, -1), np.full(gru_lm.TAILS, 20.0), np.full(gru_lm.TAILS, 5.0), np.full(gru_lm.TAILS, 2.0))
    w = gru_lm.train_replica(gru_lm.start_weights(stats), np.random.default_rng(1).integers(0, 20, 3000), 0)
    rng = np.random.default_rng(4)
    sizes = np.array([3, 50, 1, 700, 20])
    tokens = rng.integers(0, gru_lm.HEAD + gru_lm.TAILS, sizes.sum())
    together = gru_lm.score_sequences(w, tokens, sizes, 64)
    first = np.cumsum(sizes) - sizes
    alone = [gru_lm.score_sequences(w, tokens[a : a + n], np.array([n]))[0] for a, n in zip(first, sizes)]
    assert together == pytest.approx(alone, rel=1e-4)


def brute_groups(texts):
    sets = [{int(h) for h in simhash.shingle_hashes((t or "").encode(), 5)} for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    return components(pairs, len(sets))


def test_similar_groups_around_the_threshold(spark):
    """Pairs link by exact Jaccard similarity at 0.8, not by an estimate of it."""
    rng, texts = random.Random(11), []
    for n in (6, 8, 9, 13, 30, 60, 200, 400):
        for changed in range(1, 1 + n // 8):
            words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            other = words[:]
            for k in range(changed if n > 30 else 1):
                other[rng.choice([0, n - 1]) if n <= 30 else rng.randrange(n)] = f"x{rng.randrange(10**9)}"
            texts += [" ".join(words), " ".join(other)]
    for extra in range(1, 60):  # at the end of 100 distinct shingles: similarity 100 / (100 + extra)
        words = [f"v{rng.randrange(10**9)}" for _ in range(104)]
        texts += [" ".join(words), " ".join(words + [f"y{rng.randrange(10**9)}" for _ in range(extra)])]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(documents(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == list(brute_groups(texts))


def test_similar_groups_of_repeated_lines(spark):
    """Repeats of a line neither part texts of one shingle set nor join texts that share only the line."""
    rng, texts = random.Random(12), []
    for _ in range(6):
        words, line = [f"w{rng.randrange(10**9)}" for _ in range(300)], [f"l{rng.randrange(10**9)}" for _ in range(8)]
        texts += [" ".join(words + line * 2), " ".join(words + line * 100)]
    line = [f"c{k}" for k in range(8)]
    for _ in range(12):
        texts.append(" ".join([f"u{rng.randrange(10**9)}" for _ in range(120)] + line * rng.randint(50, 100)))
    want = brute_groups(texts)
    assert want == [k - k % 2 if k < 12 else k for k in range(24)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(documents(spark, texts)).collect()}
    assert [got[k] for k in range(24)] == want


def test_wide_print_is_of_the_set(spark):
    texts = ["x y z " * 4 + "a b c d e", "x y z " * 90 + "a b c d e"]
    fps = [bytes(r["fp"]) for r in simhash.similar_groups(documents(spark, texts)).collect()]
    assert fps[0] == fps[1]


def test_many_texts_of_one_id(spark):
    """Texts of one id, or of none, never get each other's spans: 3 000 share few tags of 16 bits, none of 64."""
    rng = random.Random(3)
    rows = []
    for k in range(3000):
        own = "".join(rng.choice("abcdefghijklmnop") for _ in range(60))
        rows.append((None if k % 2 else 5, own + ("0123456789" * 3 if k % 3 == 0 else "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs, 20, 6).collect())
    assert got == sorted(suffix_dedup.brute_force([t for _, t in rows], 20))


def test_every_training_document_is_learnt(spark, monkeypatch):
    """The rounds' replicas together go over each training token once."""
    learnt, average = [], gru_lm._average

    def counted(rows):
        out = average(rows)
        learnt.append(out[1] if out else 0)
        return out

    monkeypatch.setattr(gru_lm, "_average", counted)
    row = gru_lm.score_documents(documents(spark, LM_TEXTS)).first()
    assert sum(learnt) == row["train_tokens"]


def test_components_out_of_the_range_of_squares(spark):
    """Finite vectors of any size take part, by their exact distances."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(34, 6))
    x[2:20, 3] *= 1e200
    x[20:30] *= 1e-200
    x[1] = x[0] + np.array([1.0, 0, 0, 0, 0, 0])
    x[33] = 1.7e308
    x[32] = -x[33]
    rows = ann.search(spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), every=8).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {0, 8, 16, 24, 32} and all(len(v) == 10 for v in got.values())
    from math import dist

    for q, hits in got.items():
        scale = 2.0**-20 if q else 1.0
        exact = {i: dist(x[q] * scale, x[i] * scale) / scale for i in range(34) if i != q}
        assert [s for _, s in hits] == pytest.approx([exact[i] for i, _ in hits], rel=1e-9)
    assert got[0][0][1] <= 1.0


def test_probes_are_fitted_and_prune(spark):
    """The share of vectors that a query meets falls as the table grows, at a recall over 0.9."""
    rng, shares = np.random.default_rng(12), []
    for n in (2000, 16_000):
        x = rng.normal(size=(n, 32))
        hasher = ann.Hasher(32, n)
        frame = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "class long, vec array<double>")
        asked = frame.where("class % 400 = 0").withColumnRenamed("class", "query")
        looks = ann.probes_needed(asked, frame, hasher, 11)
        q = np.arange(0, n, 100)
        met = np.zeros((len(q), n), bool)
        for t in range(hasher.tables):
            (first, fine), (own, code) = hasher.probes(x[q], t, looks), hasher.buckets(x, t)
            for k in range(len(q)):
                met[k] |= np.isin(own * (1 << 40) + code, first[k] * (1 << 40) + fine[k])
        want = ann.brute_force(np.arange(n), x)
        assert np.mean([met[k, i] for k in range(len(q)) for i, _ in want[int(q[k])]]) >= 0.9
        shares.append(met.mean())
    assert shares[1] < 0.8 * shares[0]


@pytest.mark.parametrize("part", [3, 20_000])
def test_hot_buckets_are_split_into_blocks(spark, monkeypatch, part):
    """Whatever the size of blocks, components and groups are the same."""
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "GROUP", part)
    rng = random.Random(21)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(40):
        own = words[:]
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(100)) for _ in range(10)] + [None, "", "one"]
    docs = documents(spark, texts)
    rows = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint(), "component_id").collect()
    assert sorted((r[0], r[1], r[2]) for r in rows) == brute_components(spark, docs)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert [got[k] for k in range(len(texts))] == list(brute_groups(texts))


def test_near_duplicates_are_found_and_no_others(spark):
    """The groups of many altered copies are those of all pairs compared: recall 1, and nothing below the similarity."""
    rng, texts = random.Random(31), []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 300))]
        texts.append(" ".join(words))
        for _ in range(3):
            own = words[:]
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                own[rng.randrange(len(own))] = f"y{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(documents(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == list(brute_groups(texts))


def test_very_long_and_odd_rows_of_fingerprints(spark):
    long = "a b c d e f g " * 60_000
    docs = spark.createDataFrame([(None, long), (1, long + "h"), (1, None), (2, "")], "doc_id long, text string")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 4 and {r["component_id"] for r in rows if r["doc_id"] == 2} == {1}
    assert {(r["doc_id"], r["component_id"]) for r in simhash.similar_groups(docs).collect()} == {(None, 1), (1, 1), (2, 1)}
