"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel counts the subsequences of three letters that two windows of at most twelve
letters, a word's ends among them, share, gaps allowed at a decay, so that an insult stays close to itself with
letters put in or left out. Punctuation within words is dropped, common digit
spellings are read as letters and words written letter by letter are put together,
before windows are cut.

Learning takes a bounded sample of labelled documents (MAX_TRAIN, smallest hashes of
doc_id). Their sentences give words and contexts (at most MAX_WORDS words of either kind
are learnt from, with three times MAX_WORDS / 2 clean ones that score high; scoring sees every word): a word that toxic documents hold in
several distinct contexts, and clean ones hardly, is a positive bag of windows; words
of clean documents are negative. Counting distinct contexts instead of documents
keeps copies of a document from looking like evidence. Landmarks are windows of both
kinds; the machine is a squared-hinge SVM in the Nyström space, refitted as each bag
picks its best window and clean words that score high are added; those of several clean
documents weigh like toxic words. Words that are surely toxic (SURE) are learnt with a
letter put in, too. A coarse machine in the plain kernel, folded into one table of
64^3 numbers, spares the windows that are far from everything toxic the landmarks. A
document's figures are the values of its three most toxic words and its length, put
through a logistic curve fitted on the sample and on clean documents of it, half as many
as there are toxic ones, with one surely toxic word put in, as it is or altered.

Defined cases: null and empty texts, and texts without a word of three letters, get
the score of the least value; without labels of both kinds, every score is the share
of label 1 among those seen (0.5 if none, kept below 0.5 where no word stands out);
a null label is no label; repeated rows, and rows of a null doc_id, each get a row; very
long texts are scored whole; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import checkpointed, clashless
from quarry.llm.rules import labelled_sample

MAX_TRAIN = 16_000
MAX_WORDS = 4_000
WIDTH, DECAY, SPAN, LANDMARKS, POWER = 12, 0.6, 5, 320, 3
#: Token values a worker remembers; beyond that it starts afresh, with the same results.
REMEMBERED = 300_000
#: Log-likelihood ratio from which a word's leaning to toxic documents isn't chance, among so many words.
SURPRISE, CHANCE = 14.0, 0.6
#: Share of toxic documents from which a word is surely toxic, and its forms with a letter put in that are learnt.
SURE, FORMS = 0.97, 20
#: Weight against toxic words of a clean word that scores high and stands in several clean documents.
FIRM = 2.0
_FLOOR = -3.0

_LETTER = np.zeros(256, np.int32)
_LETTER[97:123] = np.arange(1, 27)
_LETTER[128:] = 27 + np.arange(128, 256) % 35
_LETTER[1], _LETTER[2] = 62, 63  # a word's two ends
_READ_AS = bytes.maketrans(b"01345@", b"oieasa")
_DROP = bytes(b for b in range(128) if not (97 <= b <= 122 or b in b" \t\n\r\x0b\x0c"))
_SPELLED = re.compile(rb"(?<![^\s])(?:[a-z] ){2,}[a-z](?![^\s])")
_COMBOS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]
_NORM = np.array([np.sqrt(max(1e-9, sum(max(0, n - b) * DECAY ** (2 * (b - 2)) for _, b in _COMBOS))) for n in range(WIDTH + 1)], np.float32)


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, letters only, those written letter by letter put together."""
    data = (text or "").lower().encode().translate(_READ_AS).translate(None, _DROP)
    words = data.split()
    words += [x.replace(b" ", b"") for x in _SPELLED.findall(data)]
    return words


def windows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of every window of the words with their ends, one row each, and where each word's rows begin."""
    if not words:
        return np.zeros((0, WIDTH), np.int32), np.zeros(0, np.int64)
    gap = b"\0" * WIDTH
    codes = _LETTER[np.frombuffer(b"\1" + (b"\2" + gap + b"\1").join(words) + b"\2" + gap, np.uint8)]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.concatenate([[0], np.cumsum(sizes + WIDTH)[:-1]])
    count = np.maximum(1, sizes - WIDTH + 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    rows = np.arange(count.sum()) - np.repeat(first, count) + np.repeat(begin, count)
    return np.lib.stride_tricks.sliding_window_view(codes, WIDTH)[rows], first


def weigh(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The normalised kernel sum of each window against a table over subsequences."""
    out = np.zeros(len(rows), np.float32)
    for k in range(0, len(rows), 1 << 15):
        part = rows[k : k + (1 << 15)]
        total = np.zeros(len(part), np.float32)
        for a, b in _COMBOS:
            at = (part[:, : WIDTH - b] << 12) | (part[:, a : WIDTH - b + a] << 6) | part[:, b:]
            total += np.float32(DECAY ** (b - 2)) * table[at].sum(axis=1)
        out[k : k + len(part)] = total / _NORM[(part > 0).sum(axis=1)]
    return out


def parts(row: np.ndarray) -> dict[int, float]:
    """The subsequences of one window with their decayed counts, normalised."""
    out: dict[int, float] = {}
    size = int((row > 0).sum())
    for a, b in _COMBOS:
        for i in range(size - b):
            at = int((row[i] << 12) | (row[i + a] << 6) | row[i + b])
            out[at] = out.get(at, 0.0) + DECAY ** (b - 2)
    return {k: v / float(_NORM[size]) for k, v in out.items()}


class Landmarks:
    """Kernel values against fixed windows, over the subsequences that these have."""

    def __init__(self, marks: np.ndarray):
        self.marks, own = marks, [parts(m) for m in marks]
        used = sorted(set().union(*own))
        self.place = np.zeros(1 << 18, np.int32)
        self.place[used] = np.arange(1, len(used) + 1)
        self.counts = np.zeros((len(used) + 1, len(marks)), np.float32)
        for k, x in enumerate(own):
            for at, v in x.items():
                self.counts[self.place[at], k] = v

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        """The kernel with each landmark, to the power that sharpens it."""
        out = np.zeros((len(rows), len(self.marks)), np.float32)
        for k in range(0, len(rows), 1024):
            part = rows[k : k + 1024]
            total = np.zeros((len(part), len(self.marks)), np.float32)
            for a, b in _COMBOS:
                at = self.place[(part[:, : WIDTH - b] << 12) | (part[:, a : WIDTH - b + a] << 6) | part[:, b:]]
                for column in range(at.shape[1]):
                    live = np.flatnonzero(at[:, column])
                    if len(live):
                        total[live] += np.float32(DECAY ** (b - 2)) * self.counts[at[live, column]]
            out[k : k + len(part)] = total / _NORM[(part > 0).sum(axis=1)][:, None]
        return out**POWER

    def folded(self, weights: np.ndarray) -> np.ndarray:
        """One table over all subsequences for a weighted sum of plain kernel values."""
        table = np.concatenate([[0], self.counts[1:] @ weights.astype(np.float32)]).astype(np.float32)
        return table[self.place]


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Squared-hinge weights (the last one is the bias), by Newton steps on the active rows."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)
    w = np.zeros(z.shape[1])
    loss = lambda v: float((cost * np.maximum(0, 1 - y * (z @ v)) ** 2).sum() + ridge * (v[:-1] @ v[:-1]))
    for _ in range(30):
        active = y * (z @ w) < 1
        za = z[active] * cost[active, None]
        hess = za.T @ z[active] + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, za.T @ y[active]) - w
        pace, now = 1.0, loss(w)
        while loss(w + pace * step) > now and pace > 1e-4:
            pace /= 2
        w = w + pace * step
        if np.abs(pace * step).max() < 1e-6:
            break
    return w


@dataclass
class Machine:
    """sum of weights times the sharpened kernel with the marks, plus bias.

    sieve: a table whose plain kernel sum is below cut for windows far from every toxic mark; these get the least value.
    """

    marks: np.ndarray
    weights: np.ndarray
    bias: float
    sieve: np.ndarray
    cut: float
    curve: np.ndarray

    def start(self) -> Machine:
        self.landmarks = Landmarks(self.marks)
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "landmarks"}

    def rows(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), _FLOOR, np.float32)
        near = np.flatnonzero(weigh(rows, self.sieve) >= self.cut)
        out[near] = np.maximum(self.landmarks.kernel(rows[near]) @ self.weights.astype(np.float32) + np.float32(self.bias), _FLOOR)
        return out

    def values(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.float32)
        rows, first = windows(words)
        return np.maximum.reduceat(self.rows(rows), first)


def _even(share: float) -> Machine:
    """A machine that gives every text the same score."""
    shift = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    return Machine(np.zeros((0, WIDTH), np.int32), np.zeros(0), 0.0, np.zeros(1 << 18, np.float32), np.inf, np.array([0.0, 0.0, 0.0, 0.0, shift]))


class Scorer:
    """The log-odds of the three most toxic words of each text and the log of its words, remembering the values of words."""

    def __init__(self, machine: Machine):
        self.machine, self.known = machine, {}
        if len(machine.marks):
            machine.start()

    def figures(self, texts: list[str | None]) -> np.ndarray:
        out = np.full((len(texts), 4), _FLOOR)
        for k in range(0, len(texts), 512):
            held = [{w for w in tokens(t) if len(w) > 2} for t in texts[k : k + 512]]
            if len(self.known) > REMEMBERED:
                self.known = {}
            known = self.known
            new = [w for w in set().union(*held) if w not in known]
            known.update(zip(new, self.machine.values(new).tolist() if len(self.machine.marks) else [_FLOOR] * len(new)))
            for i, words in enumerate(held, k):
                best = heapq.nlargest(3, map(known.__getitem__, words))
                out[i, : len(best)] = best
                out[i, 3] = np.log1p(len(words))
        out[:, :3] = _odds(out[:, :3])
        return out


def _odds(values: np.ndarray) -> np.ndarray:
    """The log-odds of words: squared hinge against both labels estimates 2 p - 1."""
    value = np.clip(values, -0.999, 0.999)
    return np.log((1 + value) / (1 - value))


def _evidence(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean, contexts): documents of either kind that hold a word, and its distinct contexts in toxic ones."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            seen: dict[tuple[bytes, int, int], int] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                words = tokens(text)
                if y:
                    for before, word, after in zip([b"", *words], words, [*words[1:], b""]):
                        if len(word) > 2:
                            seen[word, xxhash.xxh64_intdigest(before + b" " + after) >> 1 | 1, 1] = 1
                for word in set(words):
                    if len(word) > 2:
                        seen[word, 0, y] = seen.get((word, 0, y), 0) + 1
            cols = list(zip(*[(w, c, y, n) for (w, c, y), n in seen.items()])) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["word", "context", "y", "n"])

    rows = sample.select("text", "y").mapInArrow(scan, "word binary, context bigint, y int, n bigint")
    once = rows.groupBy("word", "context", "y").agg(F.sum("n").alias("n"))
    docs = lambda y: F.sum(F.when((F.col("context") == 0) & (F.col("y") == y), F.col("n")).otherwise(0))
    return once.groupBy("word").agg(docs(1).alias("toxic"), docs(0).alias("clean"), F.sum((F.col("context") != 0).cast("int")).alias("contexts"))


def _altered(words: list[bytes], forms: int, seed: int) -> tuple[list[bytes], np.ndarray]:
    """Each word of four letters or more with one letter put in, in some forms, and the numbers of the words."""
    rng = np.random.default_rng(seed)
    out, of = [], []
    for k, w in enumerate(words):
        for _ in range(forms if len(w) >= 4 and w.isascii() else 0):
            i = int(rng.integers(1, len(w)))
            out.append(w[:i] + bytes([97 + int(rng.integers(26))]) + w[i:])
            of.append(k)
    return out, np.array(of, int)


def _fit(bad: list[bytes], weights: np.ndarray, chance: np.ndarray, good: list[bytes], firm: list[bytes], rounds: int = 3) -> Machine:
    """chance: the share of toxic ones among the documents that hold each word; the rest counts against it. firm: clean words that weigh like toxic ones."""
    sure = np.flatnonzero(chance >= SURE)
    altered, of = _altered([bad[k] for k in sure], FORMS, 5)
    bad, weights, chance = bad + altered, np.concatenate([weights, np.zeros(len(altered))]), np.concatenate([chance, chance[sure[of]]])
    bad_rows, bad_first = windows(bad)
    bag = np.repeat(np.arange(len(bad)), np.diff([*bad_first, len(bad_rows)]))
    good_rows = np.unique(windows(good)[0], axis=0)
    firm_rows = windows(firm)[0]
    spread = np.concatenate([firm_rows[: LANDMARKS // 4], good_rows[np.random.default_rng(11).permutation(len(good_rows))]])[: LANDMARKS // 2]
    marks = np.concatenate([bad_rows[np.argsort(-weights[bag], kind="stable")][: LANDMARKS // 2], spread])
    marks = marks[np.sort(np.unique(marks, axis=0, return_index=True)[1])]
    landmarks = Landmarks(marks)
    values, vectors = np.linalg.eigh(landmarks.kernel(marks).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    bad_x, good_x, firm_x = (landmarks.kernel(rows) @ root for rows in (bad_rows, good_rows, firm_rows))
    chosen = np.arange(len(bad_rows))
    for _ in range(rounds):
        x = np.concatenate([bad_x[chosen], bad_x[chosen], good_x, firm_x])
        y = np.concatenate([np.ones(len(chosen)), -np.ones(len(x) - len(chosen))])
        sure = chance[bag[chosen]]
        cost = np.concatenate([sure / len(chosen), (1 - sure) / len(chosen), np.full(len(good_x), 4 / max(len(good_x), 1)), np.full(len(firm_x), FIRM / len(chosen))]) * 100
        w = _svm(x, y, cost)
        order = np.lexsort((-(bad_x @ w[:-1]), bag))
        chosen = order[np.unique(bag[order], return_index=True)[1]]
    # a machine in the plain kernel, which folds into one table: a coarse sieve for whole texts
    plain = lambda rows: landmarks.kernel(rows) ** (1 / POWER)
    values, vectors = np.linalg.eigh(plain(marks).astype(np.float64))
    flat = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    x = np.concatenate([plain(bad_rows[chosen]), plain(good_rows)]) @ flat
    y = np.concatenate([np.ones(len(chosen)), -np.ones(len(good_rows))])
    coarse = _svm(x, y, np.concatenate([np.full(len(chosen), 1 / len(chosen)), np.full(len(good_rows), 1 / max(len(good_rows), 1))]) * 400, 1e-2)
    sieve = landmarks.folded(flat @ coarse[:-1])
    cut = min(float(np.quantile(weigh(good_rows, sieve), 0.9)), float(weigh(bad_rows[chosen], sieve).min()) - 0.05)
    return Machine(marks, root @ w[:-1], float(w[-1]), sieve, cut, np.array([1.0, 0.0, 0.0, 0.0, 0.0]))


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights for the figures of a text and a shift, ridged so that separable samples stay finite."""
    z, w = np.concatenate([x, np.ones((len(x), 1))], axis=1), np.zeros(x.shape[1] + 1)
    ridge = np.diag([0.2] * x.shape[1] + [1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        c = p * (1 - p) + 1e-6
        step = np.clip(np.linalg.solve((z * c[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w), -3, 3)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _with_one(x: np.ndarray, machine: Machine, bad: list[bytes], weight: np.ndarray, share: np.ndarray, n: int) -> np.ndarray:
    """Figures of n of the clean texts with one surely toxic word put in, as it is or with a letter more."""
    sure = np.flatnonzero(share >= SURE)
    if not len(sure) or not len(x):
        return x[:0]
    words = [bad[k] for k in sure]
    altered, of = _altered(words, 4, 9)
    odds = _odds(machine.start().values(words + altered).astype(float))
    usual = np.concatenate([weight[sure], weight[sure[of]] / 4])
    rng = np.random.default_rng(3)
    out = x[rng.integers(len(x), size=n)]
    put = rng.choice(odds, n, p=usual / usual.sum())
    out[:, :3] = -np.sort(-np.concatenate([out[:, :3], put[:, None]], axis=1), axis=1)[:, :3]
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_fold: int = 0, most: int = MAX_TRAIN) -> Machine:
    sample = checkpointed(labelled_sample(docs, labels, label, folds, held_fold, most).select("text", "y"))
    counts = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return _even(counts.get(1, 0) / sum(counts.values()) if counts else 0.5)
    words = checkpointed(_evidence(sample))
    usual = counts[1] / (counts[0] + counts[1])
    seen = F.least("toxic", "contexts").cast("double")
    chance = seen / (seen + F.col("clean"))
    surprise = seen * F.log(chance / usual) + F.col("clean") * F.log(F.greatest(1 - chance, F.lit(1e-9)) / (1 - usual))
    bad = words.where((chance >= CHANCE) & (surprise >= SURPRISE)).orderBy(F.desc("toxic"), "word").limit(MAX_WORDS).collect()
    if not bad:
        return _even(min(usual, 0.49))
    clean = words.where((F.col("clean") > 0) & (chance < CHANCE))
    good = [bytes(r["word"]) for r in clean.orderBy(F.xxhash64("word"), "word").limit(MAX_WORDS).select("word").collect()]
    bad_words, weight = [bytes(r["word"]) for r in bad], np.array([r["toxic"] for r in bad], float)
    share = np.array([(r["toxic"] + 0.5) / (r["toxic"] + r["clean"] + 1) for r in bad])
    firm: list[bytes] = []
    machine = _fit(bad_words, weight, share, good, firm)
    for _ in range(3):  # clean words that score high become negatives, too
        shared = docs.sparkSession.sparkContext.broadcast(machine)

        def value(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            own = shared.value.start()
            for batch in batches:
                word = batch.column("word")
                yield pa.RecordBatch.from_arrays([word, batch.column("clean"), pa.array(own.values(word.to_pylist()))], ["word", "clean", "v"])

        hard = clean.select("word", "clean").mapInArrow(value, "word binary, clean bigint, v float").orderBy(F.desc("v"), "word").limit(MAX_WORDS // 2).collect()
        good = list(dict.fromkeys(good + [bytes(r["word"]) for r in hard]))
        firm = list(dict.fromkeys(firm + [bytes(r["word"]) for r in hard if r["v"] > 0 and r["clean"] > 1]))
        machine = _fit(bad_words, weight, share, good, firm)
    # repeated ids can make more rows than there are labels, so the bound holds here, too
    figures = _figures(sample, machine, ("y",))
    frame = figures.orderBy(F.xxhash64(*_FIGURES), *_FIGURES, "y").limit(most).toPandas()
    x, y = frame[list(_FIGURES)].to_numpy(float), frame["y"].to_numpy(float)
    more = _with_one(x[y == 0], machine, bad_words, weight, share, int(y.sum()) // 2)
    machine.curve = _curve(np.concatenate([x, more]), np.concatenate([y, np.ones(len(more))]))
    return machine


_FIGURES = ("value", "second", "third", "log_words")


def _figures(docs: DataFrame, machine: Machine, keep: tuple[str, ...], text_column: str = "text") -> DataFrame:
    shared, kinds = docs.sparkSession.sparkContext.broadcast(machine), dict(docs.dtypes)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for batch in batches:
            x = scorer.figures(batch.column(text_column).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x[:, k]) for k in range(4))], [*keep, *_FIGURES])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} double" for c in _FIGURES)])
    return clashless(docs, *dict.fromkeys([*keep, text_column])).mapInArrow(scan, schema)


def score_documents(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, value (of the most toxic word) and score (0 to 1) of every document."""
    total = F.lit(float(machine.curve[-1]))
    for name, weight in zip(_FIGURES, machine.curve):
        total = total + F.col(name) * F.lit(float(weight))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))
    return _figures(docs, machine, keep).withColumn("score", score).drop(*_FIGURES[1:])
