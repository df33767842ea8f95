"""Benchmark decontamination by a distributed, stored positional inverted index.

build() stores the index of a table of documents in the shared folder. It is split by
document: a row holds the postings of some documents, for every term the ascending
positions at which it stands, as arrays packed by term. search() looks the windows of
benchmark items up in every row: a window starts from the postings of its rarest term,
moved back by the term's place; each further term, rarer ones first, keeps the starts at
whose offset it stands. That leaves exact phrases (slop 0), or places where every term
is within `slop` words of its own place (proximity), never across documents. The texts
are read once, however many benchmarks are held against the index.

The benchmark is the query set. It reaches the tasks in blocks of items of at most
BLOCK_BYTES of text, one pass over the index for each block; a single block is the usual
case. Windows with a term that a row lacks are put aside at once, all of them by a few
array operations. No item, window or place is left out.

Defined cases: null or empty texts and texts without words have no words and no
hits; empty documents: no rows; empty benchmark: no hits; items that repeat an id count
once in n_items; an item without words has no window; a null item id is written as
"null"; rows of a repeated or null doc_id are judged separately; a very long text is one
row of the index; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import LARGE_ROWS, alnum_words, binary_column, text_key, word_hash, written

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Text that is indexed in one row, and candidate starts that are held at once.
SHARD_BYTES, CANDIDATES = 8 << 20, 1 << 21
_ABSENT = 1 << 60
_SPAN = "array<struct<s:bigint,e:bigint>>"


class Queries:
    """The windows of a block of items: their terms in order of hash, and all words as numbers of these."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.width, self.names = width, list(dict.fromkeys(name for name, _ in items))
        number, known = {n: k for k, n in enumerate(self.names)}, defaultdict()
        known.default_factory = known.__len__
        tokens, starts, of, at = [], [], [], 0
        for name, text in items:
            words = alnum_words(text)
            if not words:
                continue
            # so many words that are none follow each item that its last window can be cut out
            tokens.append(np.concatenate([np.fromiter(map(known.__getitem__, words), np.int32, len(words)), np.full(width, -1, np.int32)]))
            count = max(1, len(words) - width + 1)
            starts.append(at + np.arange(count))
            of.append(np.full(count, number[name]))
            at += len(words) + width
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.tokens, self.starts, self.item = join(tokens, np.int32), join(starts, np.int64), join(of, np.int64)
        self.terms = list(known)
        self.hashes = word_hash(self.terms)


class Shard:
    """Postings of some documents: words in order of hash, where each one's postings begin, and the postings."""

    def __init__(self, words: list[bytes], hashes: np.ndarray, starts: np.ndarray, postings: np.ndarray, n_words: np.ndarray):
        self.words, self.hashes, self.starts, self.postings, self.n_words = words, hashes, starts, postings, n_words
        self.at = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)

    @classmethod
    def of(cls, texts: list[bytes]) -> Shard:
        known = defaultdict()
        known.default_factory = known.__len__
        parts, sizes = [], []
        for text in texts:
            words = alnum_words(text)
            parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            sizes.append(len(words))
        names = list(known)
        hashes = word_hash(names)
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        flat = rank[np.concatenate(parts)] if len(names) else np.zeros(0, np.int64)
        placed = np.sort((flat << 32) | np.arange(len(flat)))
        starts = np.searchsorted(placed, np.arange(len(names) + 1) << 32)
        return cls([names[k] for k in order], hashes[order], starts, (placed & 0xFFFFFFFF).astype(np.int32), np.array(sizes, np.int64))

    def _terms(self, queries: Queries) -> np.ndarray:
        """The number of each of the queries' terms here, or -1."""
        out = np.full(len(queries.terms), -1)
        if len(self.words):
            at = np.searchsorted(self.hashes, queries.hashes)
            for k in np.flatnonzero(self.hashes[np.minimum(at, len(self.words) - 1)] == queries.hashes):
                place = at[k]  # words of one hash stand side by side
                while place < len(self.words) and self.hashes[place] == queries.hashes[k]:
                    if self.words[place] == queries.terms[k]:
                        out[k] = place
                    place += 1
        return out

    def search(self, queries: Queries, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, item, and first and last word (exclusive, in all of the shard's words) of every match."""
        term, width, total = self._terms(queries), queries.width, int(self.at[-1]) + 1
        size = np.where(term >= 0, self.starts[term + 1] - self.starts[term], 0) if len(self.words) else np.zeros(len(term), np.int64)
        size = np.append(size, _ABSENT)  # of the number -1, what is no word
        of_token = size[queries.tokens]
        least = np.full(len(queries.starts), _ABSENT)
        for k in range(width):
            least = np.minimum(least, of_token[queries.starts + k])
        live = np.flatnonzero(least > 0)
        # the postings of the terms asked for, so that one sorted array answers whether a term stands at a place
        used = np.flatnonzero(term >= 0)
        rank = np.zeros(len(term) + 1, np.int64)
        rank[used] = np.arange(len(used))
        counts = size[used]
        begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        source = np.repeat(self.starts[term[used]] - begin[:-1], counts) + np.arange(begin[-1])
        keys = np.repeat(np.arange(len(used)) * total, counts) + self.postings[source]
        found: list[tuple[np.ndarray, ...]] = []
        work = np.cumsum(least[live] * (2 * slop + 1))
        a = 0
        while a < len(live):
            b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + CANDIDATES, side="right")))
            found.append(self._block(queries, live[a:b], size, rank, begin, keys, total, slop))
            a = b
        join = lambda k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)
        return join(0), join(1), join(2), join(3)

    def _block(self, queries: Queries, chosen, size, rank, begin, keys, total: int, slop: int) -> tuple[np.ndarray, ...]:
        windows = queries.tokens[queries.starts[chosen][:, None] + np.arange(queries.width)]
        length = (windows >= 0).sum(axis=1)
        order = np.argsort(size[windows], axis=1, kind="stable")
        rows = np.arange(len(chosen))
        first = windows[rows, order[:, 0]]
        count = size[first]
        who = np.repeat(rows, count)
        inside = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        place = keys[begin[rank[first]][who] + inside] % total
        doc = np.searchsorted(self.at, place, side="right") - 1
        start = place - order[who, 0]
        if slop:
            shift = np.arange(-slop, slop + 1)
            who, doc, start = np.repeat(who, len(shift)), np.repeat(doc, len(shift)), (start[:, None] + shift).reshape(-1)
        for k in range(1, queries.width):
            asked = k < length[who]
            at = order[who, k]
            term = rank[windows[who, at]] * total
            low = np.maximum(self.at[doc], start + at - slop)
            high = np.minimum(self.at[doc + 1] - 1, start + at + slop)
            next_ = np.searchsorted(keys, term + low)
            met = keys[np.minimum(next_, len(keys) - 1)]
            stay = ~asked | ((next_ < len(keys)) & (low <= high) & (met >= term + low) & (met <= term + high))
            who, doc, start = who[stay], doc[stay], start[stay]
            if not len(who):
                break
        if slop:
            who, doc, start = np.unique(np.stack([who, doc, start]), axis=1)
        item = queries.item[chosen[who]]
        begins, ends = self.at[doc], self.at[doc + 1]  # a near match may begin before its document, or end after it
        return doc, item, np.clip(start, begins, ends), np.clip(start + length[who], begins, ends)


def _covered(low: np.ndarray, high: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the words that any match covers."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    hit = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(hit))
    return edges[::2], edges[1::2]


def build(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The index of all documents as a table in the shared folder, one row for up to SHARD_BYTES of text."""
    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), text_key(text_column).alias("key"), F.col(text_column).alias("text"))

    def index(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = binary_column(batch, "text")
            cuts, held = [0], 0
            for k, text in enumerate(texts):
                if held and held + len(text) > SHARD_BYTES:
                    cuts.append(k)
                    held = 0
                held += len(text)
            for a, b in zip(cuts, [*cuts[1:], len(texts)]):
                if a == b:
                    continue
                shard = Shard.of(texts[a:b])
                lists = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), x) for x in (batch.column("id").slice(a, b - a), batch.column("key").slice(a, b - a), pa.array(shard.n_words))]
                blobs = [b" ".join(shard.words), shard.hashes.astype("<u8").tobytes(), shard.starts.astype("<i8").tobytes(), shard.postings.astype("<i4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists, *(pa.array([x], pa.binary()) for x in blobs)], ["shard", "ids", "keys", "n_words", "words", "hashes", "starts", "postings"])

    schema = f"shard string, ids array<{kind}>, keys array<binary>, n_words array<bigint>, words binary, hashes binary, starts binary, postings binary"
    return written(rows.mapInArrow(index, schema), f"postings-{uuid.uuid4().hex}", **LARGE_ROWS)


def benchmark_blocks(benchmark: DataFrame, item_column: str, text_column: str) -> list[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size: they are dealt by their hash, as many ways as their size asks for."""
    items = benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    ways = max(1, -(-total // BLOCK_BYTES))
    pick = F.pmod(F.xxhash64("item", "text"), F.lit(ways))
    return [[(r["item"], r["text"].encode()) for r in (items if ways == 1 else items.where(pick == k)).toLocalIterator()] for k in range(ways)]


def _held_against(index: DataFrame, block: list[tuple[str, bytes]], window: int, slop: int, hits_only: bool) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(Queries(block, window))
    kind = dict(index.dtypes)["ids"][len("array<") : -1]

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        queries = shared.value
        for batch in batches:
            blobs = {c: batch.column(c) for c in ("words", "hashes", "starts", "postings")}
            for k in range(batch.num_rows):
                n_words = batch.column("n_words")[k].values.to_numpy()
                read = lambda c, kind: np.frombuffer(blobs[c][k].as_py(), kind)
                shard = Shard(blobs["words"][k].as_py().split(b" ") if len(read("hashes", "<u8")) else [], read("hashes", "<u8"), read("starts", "<i8"), read("postings", "<i4"), n_words)
                doc, item, low, high = shard.search(queries, slop)
                spans: list[list] = [[] for _ in n_words]
                items: list[list[str]] = [[] for _ in n_words]
                if len(doc):
                    pairs = np.unique(doc * len(queries.names) + item)
                    for pair in pairs.tolist():
                        items[pair // len(queries.names)].append(queries.names[pair % len(queries.names)])
                    edge = shard.at[1:-1]
                    for s, e in zip(*_covered(low, high, int(shard.at[-1]))):
                        # runs of neighbouring documents touch where these are hit to their edges
                        cut = [s, *edge[np.searchsorted(edge, s, side="right") : np.searchsorted(edge, e)].tolist(), e]
                        for x, y in zip(cut, cut[1:]):
                            d = int(np.searchsorted(shard.at, x, side="right")) - 1
                            spans[d].append({"s": int(x - shard.at[d]), "e": int(y - shard.at[d])})
                keep = np.array([d for d in range(len(n_words)) if items[d] or not hits_only], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("shard")[k].as_py()] * len(keep), pa.string()), pa.array(keep.astype(np.int32)), batch.column("ids")[k].values.take(pa.array(keep)), batch.column("keys")[k].values.take(pa.array(keep)),
                     pa.array(n_words[keep]), pa.array([spans[d] for d in keep], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array([items[d] for d in keep], pa.list_(pa.string()))],
                    ["shard", "doc", "id", "key", "n_words", "spans", "items"],
                )

    return index.mapInArrow(scan, f"shard string, doc int, id {kind}, key binary, n_words bigint, spans {_SPAN}, items array<string>")


def _merged(spans):
    """Maximal runs of spans that may overlap, as a column."""
    ordered = F.array_sort("spans")

    def step(out, x):
        last = F.element_at(out, -1)
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(out) > 0) & (x["s"] <= F.get(out, F.size(out) - 1)["e"]), longer).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(ordered, F.array().cast(_SPAN), step)


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per indexed document: id, key (of its text), n_words, hit spans of words (end exclusive) and the ids of items that occur.

    slop over 0 asks for proximity matches: some start at which every term stands within slop words of its place.
    """
    if slop < 0 or window < 1:
        raise ValueError("slop is 0 at least, a window 1")
    first, *more = benchmark_blocks(benchmark, item_column, item_text)
    out = _held_against(index, first, window, slop, hits_only=False)
    if more:
        hits = None
        for block in more:
            part = _held_against(index, block, window, slop, hits_only=True).select(F.col("shard").alias("of"), F.col("doc").alias("at"), F.col("spans").alias("new"), F.col("items").alias("met"))
            hits = part if hits is None else hits.unionByName(part)
        hits = hits.groupBy("of", "at").agg(F.flatten(F.collect_list("new")).alias("new"), F.flatten(F.collect_list("met")).alias("met"))
        out = out.join(hits, (F.col("shard") == F.col("of")) & (F.col("doc") == F.col("at")), "left")
        both = lambda a, b, kind: F.concat(a, F.coalesce(b, F.array().cast(kind)))
        out = out.withColumn("spans", both("spans", "new", _SPAN)).withColumn("spans", _merged("spans")).withColumn("items", F.array_distinct(both("items", "met", "array<string>")))
    return out.select("id", "key", "n_words", "spans", "items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """search() over a new index of docs, with the id under its own name."""
    return search(build(docs, id_column, text_column), benchmark, window, slop, item_column, item_text).withColumnRenamed("id", id_column)


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The figures of the contract, from what find_contamination gives."""
    items = F.array_sort("items")
    return found.select(
        F.col(id_column),
        "n_words",
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["e"] - x["s"]).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW, slop: int = 0) -> list[tuple]:
    """The contract's rows by trying every start of every document; for small inputs."""
    wanted: dict[tuple[bytes, ...], set[str]] = {}
    for name, text in items:
        words = alnum_words((text or "").encode())
        for k in range(max(1, len(words) - window + 1) if words else 0):
            wanted.setdefault(tuple(words[k : k + window]), set()).add("null" if name is None else str(name))
    out = []
    for doc_id, text in docs:
        words = alnum_words((text or "").encode())
        hit, found = [False] * len(words), set()
        for terms, names in wanted.items():
            for k in range(-slop, len(words) + slop):
                if all(t in words[max(0, k + j - slop) : max(0, k + j + slop + 1)] for j, t in enumerate(terms)):
                    found |= names
                    for j in range(max(0, k), min(k + len(terms), len(words))):
                        hit[j] = True
        out.append((doc_id, len(words), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return out
