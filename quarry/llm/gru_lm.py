"""Language-model scoring with a gated recurrent network over corpus-wide counts.

Tokens are words and one end a document. The corpus is split into words once: chunks of
CHUNK_BYTES of text, cut from the rows as they are read, keep the hashes and tail classes
of their distinct words, how often these stand in training documents, and the text as
numbers of these words. Everything after reads this table. Chunks send the counts of their
words, packed by hash bucket, to tasks that add them up and answer with the corpus' counts,
so that no table of the vocabulary is ever sent whole.

The most frequent words (HEAD of them) get outputs of their own, in classes of equal size;
every other word belongs to one of TAILS classes by its ending, within which it has its
share of the corpus counts; words never seen share what words seen once have. The network
(a numpy GRU) gives the class from the words so far, and for head words the word within
its class, so that a token's probability is P(class | state) P(word | class, state), or
P(class | state) times the word's share. Biases start at the corpus' own frequencies, so
that training starts from the unigram model.

Training is truncated backpropagation through time on every training document, each in
one of ROUNDS rounds (by its chunk), in replicas of bounded text that start from the same
weights; the weights are averaged after a round. Scoring covers every whole document, its
state carried from window to window; the documents of some chunks advance together.

Defined cases: null and empty texts are one end token; with no training document,
counts are zero and the model stays at its start; an empty table gives no rows; repeated
rows are scored each, and copies lie wherever their rows were read, never together; a
null doc_id is of the fold of the empty text; a very long text is a chunk of its own;
words are told apart by 64 bits of hash; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import LARGE_ROWS, binary_column, crc_mod, discard, shuffle_width, spaced_words, word_hash, written

HEAD, HEAD_CLASSES, TAILS, HIDDEN = 1024, 32, 32, 24
ROUNDS, STREAMS, STEPS, RATE = 2, 128, 20, 3e-2
#: Text of a chunk, tokens that a replica learns from, tokens that are scored together, and text to a hash bucket of counts.
CHUNK_BYTES, REPLICA_TOKENS, TOGETHER, BUCKET_BYTES = 4 << 20, 600_000, 2_500_000, 64 << 20
_END = b"\n"  # no word holds white space
_NAMES = ("wx", "u", "b", "wc", "bc", "ww", "bw")


def word_tail(words: list[bytes]) -> np.ndarray:
    """The tail class of each word, by its last three bytes."""
    return np.fromiter((zlib.crc32(w[-3:]) % TAILS for w in words), np.int64, len(words))


@dataclass
class Statistics:
    """What the corpus gives: tokens, types, the head words' hashes and counts, and the tails' sums of counts and of types."""

    n: int
    v: int
    head: np.ndarray
    head_count: np.ndarray
    tail_count: np.ndarray
    tail_types: np.ndarray
    tail_ones: np.ndarray

    @property
    def total(self) -> float:
        return float(self.n + self.v + 1)

    def tail_mass(self) -> np.ndarray:
        """Probability of each tail class: of its seen words and an equal share of what is kept for unseen ones."""
        return (self.tail_count + self.tail_types + 1 / TAILS) / self.total

    def tail_share(self, tail: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Share of a word within its tail class.

        New words have together the share of words seen once (Good and Turing's estimate),
        each as if there were as many of them as types seen.
        """
        new = (self.tail_ones + 0.5) / (self.tail_count + 1)
        types = np.maximum(self.tail_types, 1)
        seen = (1 - new[tail]) * (count + 1.0) / np.maximum(self.tail_count + self.tail_types, 1)[tail]
        return np.where(count > 0, seen, (new / types)[tail])

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash among the head words (which are in order of count), or -1."""
        if not len(self.head):
            return np.full(len(hashes), -1)
        order = np.argsort(self.head)
        at = np.minimum(np.searchsorted(self.head[order], hashes), len(order) - 1)
        return np.where(self.head[order][at] == hashes, order[at], -1)


def start_weights(stats: Statistics, seed: int = 3) -> dict[str, np.ndarray]:
    """Small random weights; biases at the corpus' frequencies."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    per = HEAD // HEAD_CLASSES
    count = np.full(HEAD, 1e-6)
    count[: len(stats.head)] = stats.head_count + 1
    by_class = count.reshape(HEAD_CLASSES, per)
    classes = np.concatenate([by_class.sum(axis=1) / stats.total, stats.tail_mass()])
    return {
        "wx": draw(HEAD + TAILS + 1, 3 * HIDDEN), "u": draw(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
        "wc": draw(HIDDEN, HEAD_CLASSES + TAILS) * 0, "bc": np.log(classes).astype(np.float32),
        "ww": draw(HEAD_CLASSES, HIDDEN, per) * 0, "bw": np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def pack(weights: dict[str, np.ndarray]) -> bytes:
    return b"".join(weights[k].astype("<f4").tobytes() for k in _NAMES)


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The weights by name, as parts of one array."""
    per = HEAD // HEAD_CLASSES
    shapes = {"wx": (HEAD + TAILS + 1, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "wc": (HIDDEN, HEAD_CLASSES + TAILS), "bc": (HEAD_CLASSES + TAILS,), "ww": (HEAD_CLASSES, HIDDEN, per), "bw": (HEAD_CLASSES, per)}
    at, out = 0, {}
    for k in _NAMES:
        n = int(np.prod(shapes[k]))
        out[k] = flat[at : at + n].reshape(shapes[k])
        at += n
    return out


def unpack(data: bytes) -> dict[str, np.ndarray]:
    return views(np.frombuffer(data, "<f4").copy())


def class_of(target: np.ndarray) -> np.ndarray:
    per = HEAD // HEAD_CLASSES
    return np.where(target < HEAD, target // per, HEAD_CLASSES + target - HEAD)


def _far(weights: np.ndarray, bias: np.ndarray) -> float:
    """No logit is larger, as states lie between -1 and 1."""
    return float((np.abs(weights).sum(axis=-2) + np.abs(bias)).max())


def _log_sum(logits: np.ndarray, far: float) -> np.ndarray:
    """Log of the sum of exponentials by row; spoils logits."""
    if far >= 80:
        top = logits.max(axis=1)
        return top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
    np.exp(logits, out=logits)
    return np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def log_outputs(w: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log P(class | state), times P(word | class, state) for head words, of each target."""
    own = class_of(target)
    logits = h @ w["wc"]
    logits += w["bc"]
    out = logits[np.arange(len(h)), own] - _log_sum(logits, _far(w["wc"], w["bc"]))
    order = np.argsort(own.astype(np.int16), kind="stable")
    edges = np.searchsorted(own[order], np.arange(HEAD_CLASSES + 1))
    per, far = HEAD // HEAD_CLASSES, _far(w["ww"], w["bw"])
    for c in range(HEAD_CLASSES):
        rows = order[edges[c] : edges[c + 1]]
        if len(rows):
            words = h[rows] @ w["ww"][c]
            words += w["bw"][c]
            out[rows] += words[np.arange(len(rows)), target[rows] - c * per] - _log_sum(words, far)
    return out


def _advance(rows: np.ndarray, u: np.ndarray, h: np.ndarray) -> np.ndarray:
    """step() without what a derivative needs; rows: the inputs' weights with the bias, which are spoilt."""
    gh = h @ u
    gates = rows[:, : 2 * HIDDEN]
    gates += gh[:, : 2 * HIDDEN]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    n = gh[:, 2 * HIDDEN :]
    n *= gates[:, :HIDDEN]
    n += rows[:, 2 * HIDDEN :]
    np.tanh(n, out=n)
    new = h - n
    new *= gates[:, HIDDEN:]
    new += n
    return new


def _shares(logits: np.ndarray, goal: np.ndarray, far: float, rows: int) -> None:
    """In place: the derivative of the mean loss over `rows` rows by the logits of a softmax."""
    if far >= 80:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= (np.float32(1 / rows) / (logits @ np.ones(logits.shape[1], np.float32)))[:, None]
    logits[np.arange(len(goal)), goal] -= np.float32(1 / rows)


def gradient(w: dict[str, np.ndarray], grad: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Fills grad with the gradient of the mean loss over a window, (steps, streams) each; gives the last states.

    fresh: where a document begins, and the state is zero.
    """
    (steps, streams), per, u = inputs.shape, HEAD // HEAD_CLASSES, w["u"]
    grad["ww"].fill(0), grad["bw"].fill(0), grad["wx"].fill(0)
    flat = inputs.reshape(-1)
    gx = w["wx"][flat].reshape(steps, streams, 3 * HIDDEN)
    gx += w["b"]
    before, after, new, hn = (np.empty((steps, streams, HIDDEN), np.float32) for _ in range(4))
    gates = np.empty((steps, streams, 2 * HIDDEN), np.float32)
    keep = (~fresh).astype(np.float32)[:, :, None]
    for t in range(steps):
        gh = np.multiply(h, keep[t], out=before[t]) @ u
        a = np.add(gx[t, :, : 2 * HIDDEN], gh[:, : 2 * HIDDEN], out=gates[t])
        np.negative(a, out=a)
        np.exp(a, out=a)
        a += 1
        np.reciprocal(a, out=a)
        hn[t] = gh[:, 2 * HIDDEN :]
        n = np.multiply(hn[t], a[:, :HIDDEN], out=new[t])
        n += gx[t, :, 2 * HIDDEN :]
        np.tanh(n, out=n)
        h = np.subtract(before[t], n, out=after[t])
        h *= a[:, HIDDEN:]
        h += n
    big, goal = after.reshape(-1, HIDDEN), targets.reshape(-1)
    own = class_of(goal)
    p = big @ w["wc"]
    p += w["bc"]
    _shares(p, own, _far(w["wc"], w["bc"]), len(goal))
    np.matmul(big.T, p, out=grad["wc"])
    p.sum(axis=0, out=grad["bc"])
    dh = p @ w["wc"].T
    order = np.argsort(own.astype(np.int16), kind="stable")
    edges = np.searchsorted(own[order], np.arange(HEAD_CLASSES + 1))
    order = order[: edges[-1]]
    states, q, back = big[order], np.empty((len(order), per), np.float32), np.empty((len(order), HIDDEN), np.float32)
    parts = [(c, edges[c], edges[c + 1]) for c in range(HEAD_CLASSES) if edges[c] < edges[c + 1]]
    for c, x, y in parts:
        np.matmul(states[x:y], w["ww"][c], out=q[x:y])
        q[x:y] += w["bw"][c]
    _shares(q, goal[order] % per, _far(w["ww"], w["bw"]), len(goal))
    for c, x, y in parts:
        np.matmul(states[x:y].T, q[x:y], out=grad["ww"][c])
        q[x:y].sum(axis=0, out=grad["bw"][c])
        np.matmul(q[x:y], w["ww"][c].T, out=back[x:y])
    dh[order] += back
    dh = dh.reshape(steps, streams, HIDDEN)
    r, z = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
    by_new, by_z, by_r = (1 - z) * (1 - new * new), (before - new) * z * (1 - z), hn * r * (1 - r)
    gx, gh, turned, back = np.empty_like(gx), np.empty_like(gx), np.ascontiguousarray(u.T), np.zeros((streams, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        d = dh[t]
        d += back
        dn = np.multiply(d, by_new[t], out=gx[t, :, 2 * HIDDEN :])
        np.multiply(dn, by_r[t], out=gh[t, :, :HIDDEN])
        np.multiply(d, by_z[t], out=gh[t, :, HIDDEN : 2 * HIDDEN])
        np.multiply(dn, r[t], out=gh[t, :, 2 * HIDDEN :])
        back = gh[t] @ turned
        d *= z[t]
        back += d
        back *= keep[t]
    gx[:, :, : 2 * HIDDEN] = gh[:, :, : 2 * HIDDEN]
    np.matmul(before.reshape(-1, HIDDEN).T, gh.reshape(-1, 3 * HIDDEN), out=grad["u"])
    gx = gx.reshape(-1, 3 * HIDDEN)
    gx.sum(axis=0, out=grad["b"])
    order = np.argsort(flat.astype(np.int16), kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    grad["wx"][flat[order[first]]] = np.add.reduceat(gx[order], first, axis=0)
    return after[-1]


def train_replica(w: dict[str, np.ndarray], tokens: np.ndarray, end: int, streams: int = STREAMS, steps: int = STEPS, rate: float = RATE) -> dict[str, np.ndarray]:
    """Truncated backpropagation through time over a sequence of documents, cut into parallel streams."""
    data = np.frombuffer(pack(w), "<f4").copy()
    # as many streams as leave some 200 steps of descent
    streams = max(1, min(streams, max(4, len(tokens) // (200 * steps)), len(tokens) // (2 * steps)))
    length = len(tokens) // streams
    if not length:
        return views(data)
    slope, first, second, spare = (np.zeros_like(data) for _ in range(4))
    own, grad = views(data), views(slope)
    grid = tokens[: length * streams].reshape(streams, length)
    h, last = np.zeros((streams, HIDDEN), np.float32), np.full(streams, end)
    for count, at in enumerate(range(0, length, steps), 1):
        targets = np.ascontiguousarray(grid[:, at : at + steps].T)
        inputs = np.concatenate([last[None], targets[:-1]])
        fresh, last = inputs == end, targets[-1]
        h = gradient(own, grad, np.where(fresh, HEAD + TAILS, inputs), targets, fresh, h)
        if (norm := float(np.sqrt(slope @ slope))) > 1:
            slope *= np.float32(1 / norm)
        pace = rate * min(1.0, count / 20) * (1 - 0.9 * count * steps / length)
        # moving means of the slope and of its square, in place
        for mean, new, part in ((first, slope, 0.1), (second, np.multiply(slope, slope, out=slope.copy()), 0.01)):
            np.subtract(new, mean, out=spare)
            spare *= np.float32(part)
            mean += spare
        np.sqrt(second, out=spare)
        spare *= np.float32(1 / np.sqrt(1 - 0.99**count))
        spare += np.float32(1e-6)
        np.divide(first, spare, out=spare)
        spare *= np.float32(max(pace, 0.0) / (1 - 0.9**count))
        data -= spare
    return own


def score_sequences(w: dict[str, np.ndarray], tokens: np.ndarray, sizes: np.ndarray, rows_at_once: int = 1 << 13) -> np.ndarray:
    """Sum of log_outputs over each whole sequence; the states go on through all of it."""
    out = np.zeros(len(sizes))
    order = np.argsort(-sizes, kind="stable")
    base = (np.cumsum(sizes) - sizes)[order]
    own = sizes[order]
    h = np.zeros((len(sizes), HIDDEN), np.float32)
    inputs = np.full(len(sizes), HEAD + TAILS, tokens.dtype)
    states, goals, whose, held = [], [], [], 0

    def settle() -> None:
        if states:
            value = log_outputs(w, np.concatenate(states), np.concatenate(goals))
            np.add.at(out, order[np.concatenate(whose)], value)
            states.clear(), goals.clear(), whose.clear()

    live = len(own)
    numbers = np.arange(len(own))
    by_input = w["wx"] + w["b"]
    for t in range(int(own[0]) if len(own) else 0):
        while live and own[live - 1] <= t:
            live -= 1
        h = _advance(by_input[inputs[:live]], w["u"], h[:live])
        inputs = tokens[base[:live] + t]
        states.append(h), goals.append(inputs), whose.append(numbers[:live])
        held += live
        if held >= rows_at_once:
            settle()
            held = 0
    settle()
    return out


def _bucket_order(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of hashes by bucket, the buckets that have any, and where each of these begins."""
    bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
    order = np.lexsort((hashes, bucket))
    first = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1))
    return order, bucket[order[first]].astype(np.int64), first


def split_words(rows: DataFrame) -> DataFrame:
    """The chunks of the corpus as a table in the shared folder; rows: id, text, held_out."""
    kind = dict(rows.dtypes)["id"]

    def chunk(number: str, held: list):
        import pyarrow as pa

        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        known[_END] = 0
        parts, sizes, end = [], [], np.zeros(1, np.int32)
        for batch in held:
            for text in binary_column(batch, "text"):
                words = spaced_words(text)
                parts += [np.fromiter(map(known.__getitem__, words), np.int32, len(words)), end]
                sizes.append(len(words) + 1)
        words, tokens, sizes = list(known), np.concatenate(parts), np.array(sizes, np.int64)
        out = np.concatenate([b.column("held_out").to_numpy(zero_copy_only=False) for b in held])
        times = np.bincount(tokens[~np.repeat(out, sizes)], minlength=len(words)).astype("<u4")
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        ids = pa.concat_arrays([b.column("id") for b in held])
        blobs = [word_hash(words).astype("<u8"), word_tail(words).astype("u1"), times, tokens.astype("<i4")]
        return pa.RecordBatch.from_arrays([pa.array([number]), one(ids), one(pa.array(out)), one(pa.array(sizes)), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], ["chunk", "ids", "held", "sizes", "hashes", "tails", "times", "tokens"])

    def scan(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for whole in batches:
            cuts, sizes = [0], [len(t) for t in binary_column(whole, "text")]
            for k, n in enumerate(sizes):
                if size and size + n > CHUNK_BYTES:
                    if k > cuts[-1]:
                        held.append(whole.slice(cuts[-1], k - cuts[-1]))
                    cuts.append(k)
                    yield chunk(f"{part}-{number}", held)
                    held, size, number = [], 0, number + 1
                size += n
            if cuts[-1] < whole.num_rows:
                held.append(whole.slice(cuts[-1]))
        if held:
            yield chunk(f"{part}-{number}", held)

    schema = f"chunk string, ids array<{kind}>, held array<boolean>, sizes array<bigint>, hashes binary, tails binary, times binary, tokens binary"
    return written(rows.mapInArrow(scan, schema), f"chunks-{uuid.uuid4().hex}", **LARGE_ROWS)


def _packets(chunks: DataFrame, buckets: int) -> DataFrame:
    """The words of every chunk with their counts in training documents, packed by bucket."""

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for chunk, *blobs in zip(*(batch.column(c).to_pylist() for c in ("chunk", "hashes", "times", "tails"))):
                hashes, times, tails = (np.frombuffer(x, kind) for x, kind in zip(blobs, ("<u8", "<u4", "u1")))
                order, some, first = _bucket_order(hashes, buckets)
                edges = [*first.tolist(), len(order)]
                packed = [pa.array([x[order[a:b]].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()) for x in (hashes, times, tails)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some)), pa.array(some.astype(np.int32)), *packed], ["chunk", "bucket", "hashes", "times", "tails"])

    return chunks.select("chunk", "hashes", "times", "tails").mapInArrow(deal, "chunk string, bucket int, hashes binary, times binary, tails binary")


def _add_up(table):
    """One bucket: its distinct words with their counts and tails, and its sums."""
    import pyarrow as pa

    join = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    hashes, first, which = np.unique(join("hashes", np.uint64), return_index=True, return_inverse=True)
    times = np.bincount(which, weights=join("times", np.uint32), minlength=len(hashes)).astype(np.int64)
    tails = join("tails", np.uint8)[first]
    hashes, times, tails = (x[times > 0] for x in (hashes, times, tails))
    top = np.argsort(-times, kind="stable")[:HEAD]
    sums = np.bincount(tails, weights=times, minlength=TAILS)
    types, ones = np.bincount(tails, minlength=TAILS), np.bincount(tails[times == 1], minlength=TAILS)
    return pa.table({
        "bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "hashes": pa.array([hashes.tobytes()], pa.binary()), "times": pa.array([times.tobytes()], pa.binary()),
        "top": pa.array([[{"hash": int(hashes[k].view(np.int64)), "times": int(times[k]), "tail": int(tails[k])} for k in top]], pa.list_(pa.struct([("hash", pa.int64()), ("times", pa.int64()), ("tail", pa.int32())]))),
        "sums": pa.array([sums.tolist()], pa.list_(pa.float64())), "types": pa.array([types.tolist()], pa.list_(pa.float64())), "ones": pa.array([ones.tolist()], pa.list_(pa.float64())),
    })


def _statistics(counts: DataFrame) -> Statistics:
    """Head words and sums; the driver receives HEAD words and TAILS sums, whatever the vocabulary."""
    sums = counts.select(F.posexplode(F.arrays_zip("sums", "types", "ones")).alias("tail", "x")).groupBy("tail").agg(F.sum("x.sums").alias("s"), F.sum("x.types").alias("t"), F.sum("x.ones").alias("o")).collect()
    tail_count, tail_types, tail_ones = np.zeros(TAILS), np.zeros(TAILS), np.zeros(TAILS)
    for r in sums:
        tail_count[r["tail"]], tail_types[r["tail"]], tail_ones[r["tail"]] = r["s"], r["t"], r["o"]
    n, v = int(tail_count.sum()), int(tail_types.sum())
    top = counts.select(F.explode("top").alias("x")).select("x.*").orderBy(F.desc("times"), "hash").limit(HEAD).collect()
    for r in top:  # a head word isn't in its tail
        tail_count[r["tail"]] -= r["times"]
        tail_types[r["tail"]] -= 1
        tail_ones[r["tail"]] -= r["times"] == 1
    return Statistics(n, v, np.array([r["hash"] for r in top], np.int64).view(np.uint64), np.array([r["times"] for r in top], np.int64), tail_count, tail_types, tail_ones)


def _inputs(hashes: np.ndarray, tails: np.ndarray, stats: Statistics) -> np.ndarray:
    """The network's token number of each word."""
    head = stats.place(hashes)
    return np.where(head >= 0, head, HEAD + tails.astype(np.int64))


def _average(rows: DataFrame) -> tuple[bytes, float] | None:
    """The mean of packed weights, added up 32 at a time until few are left."""
    def add(table):
        import pyarrow as pa

        n = np.array(table["n"].to_pylist())
        mean = sum(np.frombuffer(w, "<f4").astype(np.float64) * k for w, k in zip(table["weights"].to_pylist(), n)) / max(n.sum(), 1e-9)
        return pa.table({"replica": table["replica"][:1], "n": pa.array([float(n.sum())]), "weights": pa.array([mean.astype("<f4").tobytes()], pa.binary())})

    left = rows.count()
    while left > 32:
        left = -(-left // 32)
        rows = written(rows.groupBy(F.pmod(F.xxhash64("replica"), F.lit(left)).alias("g")).applyInArrow(add, "replica bigint, n double, weights binary"), f"weights-{uuid.uuid4().hex}")
    few = rows.collect()
    if not few:
        return None
    n = sum(r["n"] for r in few)
    mean = sum(np.frombuffer(r["weights"], "<f4").astype(np.float64) * r["n"] for r in few) / max(n, 1e-9)
    return mean.astype("<f4").tobytes(), n


def _text_rows(docs: DataFrame, id_column: str, text_column: str, folds: int, held_fold: int) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), (crc_mod(F.col(id_column), folds) == held_fold).alias("held_out"))


def count_words(packets: DataFrame) -> DataFrame:
    """Counts of all training tokens, one row per bucket, as a table in the shared folder."""
    added = packets.select("bucket", "hashes", "times", "tails").groupBy("bucket").applyInArrow(_add_up, "bucket int, hashes binary, times binary, top array<struct<hash:bigint,times:bigint,tail:int>>, sums array<double>, types array<double>, ones array<double>")
    return written(added, f"counts-{uuid.uuid4().hex}")


def train(chunks: DataFrame, stats: Statistics) -> dict[str, np.ndarray]:
    """ROUNDS rounds of replicas over all training documents; a replica learns from some chunks of a task."""
    weights, spark = start_weights(stats), chunks.sparkSession
    end = int(_inputs(word_hash([_END]), word_tail([_END]), stats)[0])
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast((pack(weights), stats))

        def learn(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            data, own = shared.value
            held, n, number = [], 0, 0

            def learnt():
                new = train_replica(unpack(data), np.concatenate(held), end)
                return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([float(n)]), pa.array([pack(new)], pa.binary())], ["replica", "n", "weights"])

            for batch in batches:
                for k in range(batch.num_rows):
                    number = zlib.crc32(batch.column("chunk")[k].as_py().encode())
                    hashes, tails, tokens = (np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in (("hashes", "<u8"), ("tails", "u1"), ("tokens", "<i4")))
                    out, sizes = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("held", "sizes"))
                    held.append(_inputs(hashes, tails, own)[tokens[~np.repeat(out, sizes)]])
                    n += len(held[-1])
                    if n >= REPLICA_TOKENS:
                        yield learnt()
                        held, n = [], 0
            if n:
                yield learnt()

        part = chunks.where(F.crc32(F.col("chunk").cast("binary")) % ROUNDS == number).select("chunk", "held", "sizes", "hashes", "tails", "tokens")
        found = written(part.mapInArrow(learn, "replica bigint, n double, weights binary"), f"replicas-{uuid.uuid4().hex}")
        if (mean := _average(found)) is not None:
            weights = unpack(mean[0])
        discard(found)
    return weights


def _answer(asked, held):
    """Counts of the hashes that the chunks ask for, in the order asked."""
    import pyarrow as pa

    known = np.frombuffer(held["hashes"][0].as_py(), np.uint64) if len(held) else np.zeros(0, np.uint64)
    times = np.frombuffer(held["times"][0].as_py(), np.int64) if len(held) else np.zeros(0, np.int64)
    out = []
    for data in asked["hashes"].to_pylist():
        want = np.frombuffer(data, np.uint64)
        at = np.minimum(np.searchsorted(known, want), max(len(known) - 1, 0))
        out.append((np.where(known[at] == want, times[at], 0) if len(known) else np.zeros(len(want), np.int64)).astype(np.int64).tobytes())
    return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "counts": pa.array(out, pa.binary())})


def score_documents(docs: DataFrame, folds: int = 7, held_fold: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_column]
    rows, ways = _text_rows(docs, id_column, text_column, folds, held_fold), spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < ways:  # a small table lies in fewer parts than there are cores
        rows = rows.repartition(ways)
    chunks = split_words(rows)
    total = chunks.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(shuffle_width(spark), -(-total // BUCKET_BYTES))
    packets = _packets(chunks, buckets)
    counts = count_words(packets)
    stats = _statistics(counts)
    shared = spark.sparkContext.broadcast((pack(train(chunks, stats)), stats))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        data, own = shared.value
        weights = unpack(data)
        held, n = [], 0

        def scored():
            sizes = np.concatenate([x[2] for x in held])
            first = np.cumsum(sizes) - sizes
            add = lambda k: np.add.reduceat(np.concatenate([x[k] for x in held]), first)
            network = score_sequences(weights, np.concatenate([x[3] for x in held]), sizes)
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([x[0] for x in held]), pa.concat_arrays([x[1] for x in held]), pa.array(sizes), pa.array(add(4)), pa.array(add(5)), pa.array(network / np.log(10) + add(6))],
                ["id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

        for batch in batches:
            for k in range(batch.num_rows):
                hashes, tails, tokens = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in (("hashes", "<u8"), ("tails", "u1"), ("tokens", "<i4")))
                got = sorted((x["bucket"], x["counts"]) for x in batch.column("answers")[k].as_py())
                c = np.empty(len(hashes), np.int64)
                c[_bucket_order(hashes, buckets)[0]] = np.frombuffer(b"".join(x for _, x in got), np.int64)
                inputs = _inputs(hashes, tails, own)
                in_tail = np.where(inputs < HEAD, 0.0, np.log10(own.tail_share(tails.astype(np.int64), c)))
                ids, out, sizes = (batch.column(x)[k].values for x in ("ids", "held", "sizes"))
                held.append((ids, out, sizes.to_numpy(), inputs.astype(np.int16)[tokens], (c > 0)[tokens].astype(np.int64), np.log10((c + 1) / own.total)[tokens], in_tail[tokens]))
                n += len(tokens)
                if n >= TOGETHER:
                    yield scored()
                    held, n = [], 0
        if held:
            yield scored()

    answers = packets.select("chunk", "bucket", "hashes").groupBy("bucket").cogroup(counts.select("bucket", "hashes", "times").groupBy("bucket")).applyInArrow(_answer, "chunk string, bucket int, counts binary")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers")).withColumnRenamed("chunk", "of")
    whole = chunks.join(answers, F.col("chunk") == F.col("of")).select("ids", "held", "sizes", "hashes", "tails", "tokens", "answers")
    scored = whole.mapInArrow(score, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(stats.n).cast("bigint").alias("train_tokens"), "base_score", "score")


def brute_force(docs: list[tuple[int, str | None]], folds: int = 7, held_fold: int = 2) -> list[tuple]:
    """id, held_out, n_tokens, n_known, train_tokens and base_score by one plain count; for small inputs."""
    out, count = [], Counter()
    held = {i: zlib.crc32(str(i).encode()) % folds == held_fold for i, _ in docs}
    each = [(i, [*spaced_words((t or "").encode()), _END]) for i, t in docs]
    for i, words in each:
        if not held[i]:
            count.update(words)
    n, v = sum(count.values()), len(count)
    for i, words in each:
        out.append((i, held[i], len(words), sum(w in count for w in words), n, float(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in words))))
    return out
