"""Quality rules and toxicity: held-out accuracy and the odd cases; then the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import rules, secrets, simhash, toxicity
from quarry.llm.common import crc_mod
from tests.llm.test_text_operators import documents

RANDOM = random.Random(9)
SYLLABLES = "er in th an re on at en nd ti es or te of ed is it al ar st".split()


def word():
    return "".join(RANDOM.choice(SYLLABLES) for _ in range(RANDOM.randint(1, 4)))


def prose(n=None):
    return " ".join(word() for _ in range(n or RANDOM.randint(20, 120))).capitalize() + "."


def noise():
    return " ".join(word() + RANDOM.choice(["$$$", "###", "!!"]) for _ in range(RANDOM.randint(20, 80)))


INSULTS = ["grumplet", "snodwick", "blargh", "fizzlewit"]


def insulted():
    words = prose().split()
    for _ in range(3):
        words.insert(RANDOM.randrange(len(words)), RANDOM.choice(INSULTS))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [noise() if k % 4 == 0 else insulted() if k % 4 == 1 else prose() for k in range(600)]
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(k, int(k % 4 != 0), int(k % 4 == 1)) for k in range(600)], "doc_id long, quality int, toxic int").withColumns({"text": F.lit("clash"), "s_n_bytes": F.lit(1)})
    return docs.cache(), labels.cache()


def accuracy(rows, want):
    return np.mean([(r["score"] >= 0.5) == want(r["doc_id"]) for r in rows if r["doc_id"] < 600])


def test_quality_on_the_held_fold(corpus):
    docs, labels = corpus
    found = rules.train(docs, labels)
    assert found.rules
    rows = rules.score_documents(docs, found).where(crc_mod(F.col("doc_id"), 3) == 1).collect()
    assert accuracy(rows, lambda k: k % 4 != 0) > 0.97
    every = rules.score_documents(docs, found).collect()
    assert len(every) == 602 and all(0 <= r["score"] <= 1 for r in every)


def test_rules_as_columns_and_as_arrays(spark, corpus):
    docs, labels = corpus
    found = rules.train(docs, labels)
    rows = rules.with_statistics(docs).withColumn("score", found.column()).toPandas()
    want = found.predict(rows[[f"s_{c}" for c in rules.STATISTICS]].to_numpy(float))
    assert rows["score"].to_numpy() == pytest.approx(want)


def test_held_fold_is_not_learnt(spark, corpus):
    docs, labels = corpus
    turned = labels.withColumn("quality", F.when(crc_mod(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = rules.train(docs, labels), rules.train(docs, turned)
    assert a.rules == b.rules and a.intercept == b.intercept


@pytest.mark.parametrize("kind", ["none", "one", "null"])
def test_labels_of_one_kind(spark, corpus, kind):
    docs, labels = corpus
    labels = {"none": labels.limit(0), "one": labels.where("quality = 1 and toxic = 0"), "null": labels.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})}[kind]
    for rows in (rules.score_documents(docs, rules.train(docs, labels)).collect(), toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()):
        assert len(rows) == 602 and len({round(r["score"], 12) for r in rows}) == 1 and 0 <= rows[0]["score"] <= 1


def test_toxicity_on_the_held_fold(corpus):
    docs, labels = corpus
    machine = toxicity.train(docs, labels)
    rows = toxicity.score_documents(docs, machine).where(crc_mod(F.col("doc_id"), 5) == 0).collect()
    assert accuracy(rows, lambda k: k % 4 == 1) > 0.97
    every = toxicity.score_documents(docs, machine).collect()
    assert len(every) == 602 and all(0 <= r["score"] <= 1 for r in every)
    assert all(r["score"] < 0.5 for r in every if r["doc_id"] >= 600)


def test_gaps_and_put_in_letters(corpus):
    docs, labels = corpus
    machine = toxicity.train(docs, labels).start()
    value = lambda w: float(machine.values([w])[0])
    clean = max(value(word().encode()) for _ in range(300))
    assert all(value(w) > clean for w in (b"grumplet", b"grumxplet", b"snodwwick", b"fizzleewit"))
    assert toxicity.tokens("S.n.o.d.w.i.c.k and g r u m p l e t, b1argh") == [b"snodwick", b"and", b"g", b"r", b"u", b"m", b"p", b"l", b"e", b"t", b"biargh", b"grumplet"]


@pytest.mark.parametrize(("altered", "found"), [(False, 0.95), (True, 0.9)])
def test_one_insult_and_put_in_letters_in_whole_documents(spark, corpus, altered, found):
    """Documents of the held fold with one insult, or four with a foreign letter each, are found; clean ones aren't."""
    docs, labels = corpus
    rng = random.Random(4)

    def hidden(k, text):
        words = text.split()
        for _ in range((4 if altered else 1) if k % 2 else 0):
            insult = rng.choice(INSULTS)
            at = rng.randrange(1, len(insult))
            insult = insult[:at] + rng.choice("bcdfgklmpqvwxz") + insult[at:] if altered else insult
            words.insert(rng.randrange(len(words)), insult)
        return " ".join(words)

    texts = [hidden(k, prose()) for k in range(300)]
    rows = toxicity.score_documents(documents(spark, texts), toxicity.train(docs, labels)).collect()
    toxic, clean = ([r["score"] >= 0.5 for r in rows if r["doc_id"] % 2 == y] for y in (1, 0))
    assert np.mean(toxic) >= found and np.mean(clean) <= 0.02


def test_kernel_by_definition():
    """The window kernel against a plain count of common subsequences."""

    def plain(a, b):
        def parts(x):
            out = {}
            for i in range(len(x)):
                for j in range(i + 1, len(x)):
                    for k in range(j + 1, min(i + toxicity.SPAN, len(x) - 1) + 1):
                        u = (x[i], x[j], x[k])
                        out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i - 2)
            return out

        p, q = parts(a), parts(b)
        return sum(v * q.get(u, 0) for u, v in p.items())

    words = [b"idiot", b"idxiot", b"tidy", b"abc"]
    rows, first = toxicity.windows(words)
    marks = toxicity.Landmarks(rows)
    got = marks.kernel(rows) ** (1 / toxicity.POWER)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            x, y = ([int(c) for c in r if c] for r in (a, b))
            assert got[i, j] == pytest.approx(plain(x, y) / toxicity._NORM[len(x)] / toxicity._NORM[len(y)], rel=1e-4, abs=1e-5)


def test_pipeline(spark, corpus, tmp_path):
    docs, labels = corpus
    texts = [r["text"] for r in docs.where("doc_id < 600").orderBy("doc_id").select("text").collect()]
    good = texts[2]
    changed = good.split()
    changed[0] = "changed"
    passage = prose(40)
    extra = [(600, good), (601, " ".join(changed)), (602, f"{prose(60)} {passage} {prose(30)}"), (603, f'{prose(60)} password="ABCDEFGH12345678" {prose(40)}'), (604, None)]
    rows = [(k, t, "en", "src", len(t or "")) for k, t in [*enumerate(texts), *extra]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels.select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, read, str(tmp_path))
        assert out.columns == frame.columns
        path = f"{tmp_path}/{len(seen)}.parquet"
        out.write.parquet(path)
        read = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r for r in read.collect()}
    quality, unique, clean, masked = seen.values()
    assert sum(k % 4 == 0 for k in quality if k < 600) <= 3 and sum(k % 4 != 0 for k in quality if k < 600) >= 445
    assert 2 in unique and 600 not in unique and 601 not in unique and len(unique) >= len(quality) - 8
    assert 602 in unique and 602 not in clean and len(clean) == len(unique) - 1
    assert "ABCDEFGH12345678" not in masked[603]["text"] and "[SECRET]" in masked[603]["text"] and masked[603]["n_chars"] == len(masked[603]["text"])
    assert all(masked[k]["text"] == clean[k]["text"] for k in clean if not secrets.brute_force(clean[k]["text"]))
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in last} == set(masked) and all(r["n_tokens"] == len(r["token_ids"]) for r in last)


def test_wide_radius():
    assert simhash.wide_radius(1.0, 512) == 0 < simhash.wide_radius(0.9, 512) < simhash.wide_radius(0.8, 512)


def test_pipeline_rows_of_null_and_repeated_ids(spark, tmp_path):
    texts = [prose(60) for _ in range(8)]
    secret = f'{prose(30)} password="ABCDEFGH12345678" {prose(30)}'
    rows = [(None, texts[0]), (None, texts[1]), (None, secret), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[3]), (7, texts[4]), (9, texts[4]), (1, texts[5]), (None, texts[5])]
    docs = spark.createDataFrame([(i, t, "src", len(t)) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    unique = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    want = [(None, texts[0]), (None, texts[1]), (None, secret), (7, texts[2]), (7, texts[3]), (7, texts[4]), (1, texts[5])]
    order = lambda x: (x[0] or -1, x[1])
    assert sorted(((r["doc_id"], r["text"]) for r in unique.collect()), key=order) == sorted(want, key=order)
    masked = corpus_pipeline.mask_secrets(spark, docs, str(tmp_path)).collect()
    hidden = [(i, secrets.brute_force(t) and t[: secrets.brute_force(t)[0][1]] + "[SECRET]" + t[secrets.brute_force(t)[0][2] :] or t) for i, t in rows]
    assert sorted(((r["doc_id"], r["text"]) for r in masked), key=order) == sorted(hidden, key=order)


def test_quality_of_repeated_ids_and_empty_tables(spark, corpus, monkeypatch):
    """Rows of one id can't make the sample larger than its bound, nor their order another model; no documents, no rows."""
    docs, labels = corpus
    many, labels = docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") % 40), labels.where("doc_id < 40")
    a = rules.train(many, labels, most=200)
    b = rules.train(many.orderBy(F.desc("text")).repartition(3), labels, most=200)
    assert a.rules == b.rules and a.intercept == b.intercept
    seen = []
    monkeypatch.setattr(rules, "fit", lambda x, y: seen.append(len(y)) or rules.Rules(0.0))
    rules.train(many, labels, most=200)
    assert seen == [200]
    none = docs.limit(0)
    for found in (rules.train(none, labels.limit(0)), a):
        assert rules.score_documents(none, found).count() == 0
    assert toxicity.score_documents(none, toxicity.train(none, labels)).count() == 0


def test_pipeline_with_columns_of_any_name(spark, tmp_path):
    """A stage keeps the columns it is given, whatever they are called, and their values."""
    names = ["spans", "score", "kept_id", "n_words", "items", "of_id", "s_n_bytes", "text_key", "key", "base", "live", "hashes", "fp", "node", "y", "_key", "_spans", "id", "a.b", "owner", "repository"]
    texts = [prose(60) for _ in range(12)] + [f'{prose(30)} password="ABCDEFGH12345678" {prose(30)}']
    texts += [texts[0], f"{prose(30)} {texts[1]}", None, ""]
    docs = spark.createDataFrame([(k, t, "src", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, read, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}.parquet")
        read = spark.read.parquet(f"{tmp_path}/{k}.parquet")
    rows = read.collect()
    assert {r["doc_id"] for r in rows} == {0, *range(2, 13), 15}
    assert all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in names)
    assert [r["text"].count("[SECRET]") for r in rows if r["doc_id"] == 12] == [1]
