"""Quality classifier: a sparse rule ensemble.

Statistics of whole texts are columns; shallow boosted trees on a bounded labelled
sample give paths, each path is a conjunction of thresholds, an L1-penalised logistic
fit keeps few of them, and the kept rules are compiled into one Spark column expression
over the statistics.

The sample is at most MAX_TRAIN labelled rows, those of the smallest hash of doc_id
among the rows allowed for learning; its size doesn't grow with the input. Rows of one
doc_id each count until the bound is reached, in the order of their statistics. Scoring
covers every text whole.

Defined cases: a null or empty text has all statistics zero and gets the score that
the rules give to those; without labels of both kinds, every score is the share of
label 1 among those seen (0.5 if none); repeated labels of a document each count;
a null label is no label, a null doc_id has none; equal texts have equal scores; very
long texts are read whole; empty tables give no rows; extra columns are ignored, or kept
as they are where asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm.common import binary_column, clashless, crc_mod

MAX_TRAIN = 12_000
STATISTICS = (
    "n_bytes", "n_words", "mean_word", "longest_word", "distinct_words", "top_word", "upper", "digit", "symbol", "stop",
    "comma", "pipe", "bang", "quote", "distinct_lines", "line_bytes", "non_ascii", "symbol_words", "upper_words", "short_words",
)

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#$%&*+<=>@\\^_`{}~/[]"
_BYTES_HIGH = bytes(range(128, 256))
_SYMBOL_WORD = re.compile(rb"[#$%&*+<=>@\\^_`{}~/\[\]]{2,}")
_UPPER_WORD = re.compile(rb"(?<![A-Za-z])[A-Z]{2,}(?![a-z])")


def statistics(text: bytes) -> tuple[float, ...]:
    """The figures of one text, in the order of STATISTICS; shares are of bytes, words or lines."""
    n = len(text)
    if not n:
        return (0.0,) * len(STATISTICS)
    words = text.split()
    count = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda drop: (n - len(text.translate(None, drop))) / n
    sizes = list(map(len, words))
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    w = max(count, 1)
    return (
        float(n), float(count), sum(sizes) / w, float(max(sizes, default=0)), len(kinds) / w, max(kinds.values(), default=0) / w,
        share(_UPPER), share(_DIGIT), share(_SYMBOL), text.count(b".") / n, text.count(b",") / n, text.count(b"|") / n, text.count(b"!") / n,
        (text.count(b'"') + text.count(b"'")) / n, len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), share(_BYTES_HIGH),
        len(_SYMBOL_WORD.findall(text)) / w, len(_UPPER_WORD.findall(text)) / w, sum(s <= 2 for s in sizes) / w,
    )


def with_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, kept columns and the statistics s_<name> of every document."""
    kept = list(dict.fromkeys([id_column, *keep]))
    names = [f"s_{x}" for x in STATISTICS]

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = np.array([statistics(t) for t in binary_column(batch, text_column)], dtype=np.float64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(rows[:, k]) for k in range(len(names)))], [*kept, *names])

    schema = StructType([*(docs.schema[c] for c in kept), *(StructField(c, DoubleType()) for c in names)])
    return clashless(docs, *dict.fromkeys([*kept, text_column])).mapInArrow(scan, schema)


@dataclass
class Rules:
    """intercept + sum of weights of the rules that hold; a rule is ((statistic, above, threshold), ...)."""

    intercept: float
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]] = field(default_factory=list)

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.stack([_holds(r, x) for r, _ in self.rules], axis=1) if self.rules else np.zeros((len(x), 0), bool)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + self.holds(x) @ np.array([w for _, w in self.rules]))))

    def column(self) -> Column:
        """The score as a Spark expression over the s_ columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = F.lit(True)
            for k, above, cut in rule:
                c = F.col(f"s_{STATISTICS[k]}")
                test = test & ((c > cut) if above else (c <= cut))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) if above else (x[:, k] <= cut)
    return out


def _grow(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, least: int) -> list[tuple[np.ndarray, float]]:
    """A regression tree on binned statistics; appends every node's path to out. Gives the leaves."""
    mean = grad[rows].mean()
    if path:
        out.append(path)
    if not depth or len(rows) < 2 * least:
        return [(rows, mean)]
    best = (1e-9, -1, -1)
    total, n = grad[rows].sum(), len(rows)
    for k, own in enumerate(cuts):
        if not len(own):
            continue
        b = binned[rows, k]
        size = np.bincount(b, minlength=len(own) + 1).cumsum()[:-1]
        part = np.bincount(b, weights=grad[rows], minlength=len(own) + 1).cumsum()[:-1]
        gain = np.where((size >= least) & (n - size >= least), part**2 / np.maximum(size, 1) + (total - part) ** 2 / np.maximum(n - size, 1) - total**2 / n, 0)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (gain[at], k, at)
    _, k, at = best
    if k < 0:
        return [(rows, mean)]
    low = binned[rows, k] <= at
    cut = float(cuts[k][at])
    below = _grow(binned, cuts, grad, rows[low], depth - 1, (*path, (k, False, cut)), out, least)
    return below + _grow(binned, cuts, grad, rows[~low], depth - 1, (*path, (k, True, cut)), out, least)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, l1: float = 2e-3, steps: int = 300, seed: int = 7) -> Rules:
    """Boosted trees for the paths, then L1-penalised logistic weights by accelerated proximal gradient."""
    if not len(y):
        return Rules(0.0)
    share = float(y.mean())
    if share in (0.0, 1.0):
        return Rules(np.log((share * len(y) + 0.5) / ((1 - share) * len(y) + 0.5)))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65)[1:-1])) for k in range(x.shape[1])]
    cuts = [c[c < x[:, k].max()] for k, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    score = np.full(len(y), np.log(share / (1 - share)))
    paths: list[tuple] = []
    least = max(5, len(y) // 500)
    for _ in range(trees):
        grad = y - 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        if len(rows) < 2 * least:
            rows = np.arange(len(y))
        grown: list[tuple] = []
        _grow(binned, cuts, grad, rows, depth, (), grown, least)
        paths += grown
        deepest = [p for p in grown if not any(q != p and q[: len(p)] == p for q in grown)]
        for p in deepest:
            held = _holds(p, x)
            g = y[held] - 1 / (1 + np.exp(-score[held]))
            curve = (1 / (1 + np.exp(-score[held]))) * (1 - 1 / (1 + np.exp(-score[held])))
            score[held] += rate * np.clip(g.sum() / (curve.sum() + 1.0), -4, 4)
    distinct: dict[bytes, tuple] = {}
    for p in paths:
        held = _holds(p, x)
        if 0 < held.sum() < len(y):
            distinct.setdefault(np.packbits(held).tobytes(), p)
    rules = list(distinct.values())
    held = np.stack([_holds(p, x) for p in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    spread = np.maximum(held.std(axis=0), 1e-3)
    held /= spread
    weight, bias = np.zeros(held.shape[1], np.float32), np.log(share / (1 - share))
    v = np.ones(held.shape[1], np.float32)
    for _ in range(12):  # the largest curvature, by power iteration
        v = held.T @ (held @ v)
        v /= np.linalg.norm(v) + 1e-12
    pace = 1 / (0.25 * (float(v @ (held.T @ (held @ v))) / len(y) + 1) + 1e-9)
    ahead, ahead_bias, t = weight.copy(), bias, 1.0
    for _ in range(steps):
        gap = (1 / (1 + np.exp(-(held @ ahead + ahead_bias))) - y).astype(np.float32)
        new = ahead - pace * (held.T @ gap) / len(y)
        new = (np.sign(new) * np.maximum(np.abs(new) - pace * l1, 0)).astype(np.float32)
        new_bias = ahead_bias - pace * float(gap.mean())
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t_next * (new - weight), new_bias + (t - 1) / t_next * (new_bias - bias)
        weight, bias, t = new, new_bias, t_next
    return Rules(float(bias), [(p, float(w / s)) for p, w, s in zip(rules, weight, spread) if w])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_fold: int, most: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text and y of at most `most` labelled rows outside the held fold, of the smallest hash of the id."""
    known = labels.select(F.col(id_column).alias("of_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    known = known.where(crc_mod(F.col("of_id"), folds) != held_fold).orderBy(F.xxhash64("of_id"), "of_id", "y").limit(most)
    # bounded by `most` rows of two numbers, whatever the input
    return clashless(docs, id_column, text_column).join(F.broadcast(known), F.col(id_column) == F.col("of_id")).drop("of_id")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_fold: int = 1, most: int = MAX_TRAIN) -> Rules:
    names = [f"s_{c}" for c in STATISTICS]
    sample = with_statistics(labelled_sample(docs, labels, label, folds, held_fold, most), keep=("y",))
    # repeated ids can make more rows than there are labels, so the bound holds here, too
    frame = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "y", *names).limit(most).toPandas().sort_values("doc_id", kind="stable")
    return fit(frame[names].to_numpy(float), frame["y"].to_numpy(float))


def score_documents(docs: DataFrame, rules: Rules, keep: tuple[str, ...] = (), score_column: str = "score") -> DataFrame:
    """doc_id, kept columns and score (0 to 1) of every document."""
    return with_statistics(docs, keep=keep).withColumn(score_column, rules.column()).drop(*[f"s_{c}" for c in STATISTICS])
