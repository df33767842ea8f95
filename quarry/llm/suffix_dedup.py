"""Exact removal of long repeats by a logarithmic family of sparse suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else in
the corpus. Every window of LENGTH bytes has one anchor, the place of its least gram
hash, and equal windows have equal anchors at equal offsets; so only the suffixes at
anchors are indexed, about one in 80 bytes. The windows that share an anchor make up
its region, and equal regions are one entry with a multiplicity.

1. Anchors of all documents are counted by gram. A gram seen once takes part in no
   repeat. One whose regions are all equal needs no index: each region is repeated.
2. The distinct regions of the other grams are indexed, dealt by gram. Each task adds
   them in batches to its index family: a batch gets a suffix array (text from the
   anchor on) and a prefix array (text before it, backwards), is merge-scanned against
   every level, and levels of equal size merge, as digits of a binary counter carry.
   A scan takes, for each offset, the entries whose classes agree in both arrays; of a
   level, only entries of the batch's own grams, as no others share a window with it.
3. A gram with more than GROUP distinct regions doesn't go to one task: its windows
   are counted by hash instead, which spreads them evenly and gives the same result.
4. The spans go back to the documents, are merged, and the rest of the text is kept.

Defined cases: a null text counts as empty; texts under LENGTH bytes lose nothing;
rows that repeat as a whole lose whatever lies in windows; several rows of one doc_id, or
of none, are judged separately (rows are told apart by 128 bits of id and text together,
and rows of equal id and text have equal results); strings never cross documents; very
long texts are looked at in segments that overlap; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import binary_column, discard, shuffle_width, written

LENGTH, GRAM = 200, 40
#: Distinct regions of one gram that a task may index.
GROUP = 20_000
#: Entries of a batch that gets a suffix array of its own, and about how many a task indexes.
BATCH, ENTRIES = 16_384, 250_000
#: Windows are looked at in segments of so many starts.
SEGMENT = 1 << 22
_BLOCK = 1 << 17

_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = 0x9E3779B97F4A7C15
_MASK32 = np.uint64(0xFFFFFFFF)


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_MUL, -1, 1 << 64)
            self.up = np.concatenate([[np.uint64(1)], np.full(n - 1, _MUL, np.uint64)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([[np.uint64(1)], np.full(n - 1, inverse, np.uint64)]).cumprod(dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of the windows that start from first to last (inclusive, ascending ranges) in one buffer.

    Gives gram hash, region hash, and first and last window start and place of each anchor.
    """
    n = len(data)
    up, down = _POWERS.get(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=prefix[1:])
    own = _mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    least = (own & ~_MASK32) | np.arange(len(own), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    place = (least & _MASK32).astype(np.int64)
    edge = np.zeros(len(place) + 1, np.int8)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    at = place[starts]
    new = np.concatenate([[True], (np.diff(starts) > 1) | (np.diff(at) != 0)]) if len(starts) else np.zeros(0, bool)
    # a range's first window begins a run, whatever came before it
    begin = np.flatnonzero(new | np.isin(starts, first))
    end = np.concatenate([begin[1:], [len(starts)]]) - 1 if len(begin) else begin
    low, high, x = starts[begin], starts[end], at[begin]
    shape = ((high - low).astype(np.uint64) << np.uint64(16)) + (x - low).astype(np.uint64)
    region = _mix((prefix[high + length] - prefix[low]) * down[low] + _mix(shape + np.uint64(1)))
    return own[x], region, low, high, x


def anchors_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, gram, region, lowest start, region's size, anchor's offset), block by block."""
    block: list[tuple[int, int, bytes]] = []
    held = 0

    def flush():
        data = np.frombuffer(b"".join(b for _, _, b in block), np.uint8)
        sizes = np.array([len(b) for _, _, b in block])
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        g, r, low, high, x = anchors(data, base, base + sizes - length, length, gram)
        which = np.searchsorted(base, low, side="right") - 1
        number = np.array([k for k, _, _ in block])[which]
        shift = np.array([s for _, s, _ in block])[which] - base[which]
        return number, g, r, low + shift, high - low + length, x - low

    for k, text in enumerate(texts):
        for a in range(0, len(text) - length + 1, SEGMENT):
            piece = text[a : a + SEGMENT + length - 1] if len(text) > SEGMENT else text
            if held and held + len(piece) > _BLOCK:
                yield flush()
                block, held = [], 0
            block.append((k, a, piece))
            held += len(piece)
    if block:
        yield flush()


class Level:
    """Entries sorted by the text from the anchor on, and by the text before it read backwards."""

    def __init__(self, right: np.ndarray, right_ids: np.ndarray, left: np.ndarray, left_ids: np.ndarray):
        self.right, self.right_ids, self.left, self.left_ids = right, right_ids, left, left_ids

    def __len__(self) -> int:
        return len(self.right)

    @classmethod
    def of(cls, right: np.ndarray, left: np.ndarray, ids: np.ndarray) -> Level:
        a, b = np.argsort(right, kind="stable"), np.argsort(left, kind="stable")
        return cls(right[a], ids[a], left[b], ids[b])

    def only(self, kept: np.ndarray) -> Level:
        """The entries that kept, by id, says."""
        a, b = kept[self.right_ids], kept[self.left_ids]
        return Level(self.right[a], self.right_ids[a], self.left[b], self.left_ids[b])

    def merged(self, other: Level) -> Level:
        a = np.searchsorted(self.right, other.right, side="right")
        b = np.searchsorted(self.left, other.left, side="right")
        return Level(
            np.insert(self.right, a, other.right), np.insert(self.right_ids, a, other.right_ids),
            np.insert(self.left, b, other.left), np.insert(self.left_ids, b, other.left_ids),
        )


def common_prefix(keys: np.ndarray) -> np.ndarray:
    """Bytes that each sorted key shares with the one before it (0 for the first)."""
    width = keys.dtype.itemsize
    rows = keys.view(np.uint8).reshape(len(keys), width)
    out = np.zeros(len(keys), np.int64)
    for k in range(1, len(keys), 8192):
        part = rows[k : k + 8192] != rows[k - 1 : k - 1 + min(8192, len(keys) - k)]
        out[k : k + 8192] = np.where(part.any(axis=1), part.argmax(axis=1), width)
    return out


class Family:
    """A logarithmic family of levels; find() has the offsets of repeated windows around each anchor."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.back = length, max(1, length - gram)
        self.levels: list[Level | None] = []
        self.n = 0
        self.least = self.most = np.zeros(0, np.int64)
        self.low = self.high = np.zeros(0, np.int64)
        self.grams = np.zeros(0, np.int64)

    def add(self, contexts: list[bytes], offsets: np.ndarray, grams: np.ndarray | None = None) -> None:
        """A batch of regions, with the offset of the anchor in each, and hashes of the anchors' grams (all alike, if not given)."""
        ids = np.arange(self.n, self.n + len(contexts))
        sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
        right = np.array([c[o : o + self.length] for c, o in zip(contexts, offsets)], dtype=f"S{self.length}")
        left = np.array([c[:o][::-1] for c, o in zip(contexts, offsets)], dtype=f"S{self.back}")
        self.n += len(contexts)
        self.most = np.concatenate([self.most, offsets])
        self.least = np.concatenate([self.least, offsets - (sizes - self.length)])
        self.low = np.concatenate([self.low, np.full(len(ids), self.length + 1)])
        self.high = np.concatenate([self.high, np.full(len(ids), -1)])
        self.grams = np.concatenate([self.grams, np.zeros(len(ids), np.int64) if grams is None else grams])
        level = Level.of(right, left, ids)
        self._scan(level)
        met = np.isin(self.grams, self.grams[ids])  # no window is shared without its gram
        met[ids] = False
        for old in self.levels:
            if old is not None and len(near := old.only(met)):
                self._scan(near.merged(level))
        place = 0
        while place < len(self.levels) and self.levels[place] is not None:
            level = self.levels[place].merged(level)
            self.levels[place] = None
            place += 1
        if place == len(self.levels):
            self.levels.append(None)
        self.levels[place] = level

    def _scan(self, level: Level) -> None:
        """Notes each entry's least and largest offset at which another one has the same window."""
        if len(level) < 2:
            return
        by_right, by_left = common_prefix(level.right), common_prefix(level.left)
        reach, back = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        reach[level.right_ids] = np.maximum(by_right, np.append(by_right[1:], 0))
        back[level.left_ids] = np.maximum(by_left, np.append(by_left[1:], 0))
        ids = level.right_ids
        lo = np.maximum(self.least[ids], self.length - reach[ids])
        hi = np.minimum(self.most[ids], back[ids])
        ids, lo, hi = ids[lo <= hi], lo[lo <= hi], hi[lo <= hi]
        if not len(ids):
            return
        right_class, left_class = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for offset in range(int(lo.min()), int(hi.max()) + 1):
            own = ids[(lo <= offset) & (offset <= hi)]
            if len(own) < 2:
                continue
            right_class[level.right_ids] = np.cumsum(by_right < self.length - offset)
            left_class[level.left_ids] = np.cumsum(by_left < offset)
            key = right_class[own] * (len(level) + 1) + left_class[own]
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            found = own[order[np.append(same, False) | np.insert(same, 0, False)]]
            self.low[found] = np.minimum(self.low[found], offset)
            self.high[found] = np.maximum(self.high[found], offset)

    def find(self) -> tuple[np.ndarray, np.ndarray]:
        """Per entry in order of adding: start and end of what is repeated, from the region's start (end 0: nothing)."""
        found = self.high >= 0
        return np.where(found, self.most - self.high, 0), np.where(found, self.most - self.low + self.length, 0)


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """own (the id), text, and id and tag: two halves of a 128-bit digest of both, which tell rows apart."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("null")), F.lit("|"), text).cast("binary"))
    half = lambda k: F.conv(F.substring(digest, k, 16), 16, -10).cast("bigint")
    return docs.select(F.col(id_column).alias("own"), half(1).alias("id"), half(17).alias("tag"), text.alias("text"))


def _anchor_rows(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tag"))
            for which, g, r, low, size, offset in anchors_of(binary_column(batch, "text"), length, gram):
                place = (low.astype(np.int64) << 24) | ((size - length) << 12) | offset
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(r.view(np.int64)), pa.array(ids[which]), pa.array(tags[which]), pa.array(place)], ["gram", "region", "id", "tag", "place"])

    return keyed.select("id", "tag", "text").mapInArrow(scan, "gram bigint, region bigint, id bigint, tag bigint, place bigint")


def _index(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram, region, s, e) of entries with a repeated part, from entries dealt by gram."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        family, grams, regions, times, sizes = Family(length, gram), [], [], [], []
        waiting: list = []

        def add() -> None:
            part = pa.Table.from_batches(waiting)
            family.add([bytes(x) for x in part["context"].to_pylist()], part["offset"].to_numpy().astype(np.int64), part["gram"].to_numpy())
            waiting.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            grams.append(batch.column("gram").to_numpy())
            regions.append(batch.column("region").to_numpy())
            times.append(batch.column("n").to_numpy())
            sizes.append(batch.column("size").to_numpy())
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= BATCH:
                add()
        if waiting:
            add()
        if grams:
            grams, regions, times, sizes = (np.concatenate(x) for x in (grams, regions, times, sizes))
            s, e = family.find()
            s, e = np.where(times > 1, 0, s), np.where(times > 1, sizes, e)
            keep = e > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (grams, regions, s.astype(np.int64), e.astype(np.int64))], ["gram", "region", "s", "e"])

    return rows.mapInArrow(scan, "gram bigint, region bigint, s bigint, e bigint")


def _windows_by_hash(rows: DataFrame, length: int) -> DataFrame:
    """The same as _index for grams of very many regions: windows are counted by hash and offset."""

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for g, r, n, o, c in zip(*(batch.column(x).to_pylist() for x in ("gram", "region", "n", "offset", "context"))):
                starts = range(len(c) - length + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * len(starts), pa.int64()), pa.array([r] * len(starts), pa.int64()), pa.array([n] * len(starts), pa.int64()), pa.array([o - s for s in starts], pa.int64()), pa.array(list(starts), pa.int64()), pa.array([hashlib.blake2b(c[s : s + length], digest_size=16).digest() for s in starts], pa.binary())],
                    ["gram", "region", "n", "offset", "start", "window"],
                )

    each = rows.mapInArrow(deal, "gram bigint, region bigint, n bigint, offset bigint, start bigint, window binary")
    repeated = each.groupBy("offset", "window").agg(F.sum("n").alias("times")).where("times > 1").select("offset", "window")
    return each.join(repeated, ["offset", "window"]).groupBy("gram", "region").agg(F.min("start").alias("s"), (F.max("start") + length).alias("e"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, tag, spans): the places [s, e) of each document that lie in repeated strings, unmerged."""
    spark = keyed.sparkSession
    found = _anchor_rows(keyed, length, gram)
    by_gram = found.groupBy("gram").agg(F.count(F.lit(1)).alias("times"), F.min("region").alias("first"), F.max("region").alias("last")).where("times > 1")
    # as a table of its own, so that the join has two plain exchanges and splits a frequent gram's rows
    by_gram = written(by_gram.select(F.col("gram").alias("of_gram"), (F.col("first") != F.col("last")).alias("mixed")), f"grams-{uuid.uuid4().hex}")
    taking = written(found.join(by_gram, found["gram"] == by_gram["of_gram"]).drop("of_gram"), f"anchors-{uuid.uuid4().hex}")
    low, size = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(0xFFF) + length
    whole = taking.where("not mixed").select("id", "tag", low.alias("s"), (low + size).alias("e"))
    mixed = taking.where("mixed")
    entries = mixed.groupBy("gram", "region").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "tag", "place")).alias("one"))
    entries = written(entries.select("gram", "region", "n", F.col("one.id").alias("of_id"), F.col("one.tag").alias("of_tag"), "one.place"), f"entries-{uuid.uuid4().hex}")
    discard(by_gram)
    tasks = max(shuffle_width(spark), -(-entries.count() // ENTRIES))
    context = F.substring(F.col("text").cast("binary"), (low + 1).cast("int"), size.cast("int"))

    def with_context(some: DataFrame) -> DataFrame:
        # the same columns of the documents as in the last join, whose exchange is used again
        joined = keyed.join(some, (F.col("id") == F.col("of_id")) & (F.col("tag") == F.col("of_tag")))
        rows = joined.select("gram", "region", "n", F.col("place").bitwiseAND(0xFFF).alias("offset"), size.alias("size"), context.alias("context"))
        # rows that repeat as a whole have given the same text
        return rows.repartition(tasks, "gram").dropDuplicates(["gram", "region"])

    crowded = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("regions")).where(F.col("regions") > GROUP).select("gram")
    if crowded.isEmpty():
        known = _index(with_context(entries), length, gram)
    else:
        known = _index(with_context(entries.join(crowded, "gram", "left_anti")), length, gram)
        known = known.unionByName(_windows_by_hash(with_context(entries.join(crowded, "gram", "left_semi")), length))
    known = known.select(F.col("gram").alias("g"), F.col("region").alias("r"), F.col("s").alias("from"), F.col("e").alias("to"))
    partly = mixed.join(known, (F.col("gram") == F.col("g")) & (F.col("region") == F.col("r"))).select("id", "tag", (low + F.col("from")).alias("s"), (low + F.col("to")).alias("e"))
    return whole.unionByName(partly).distinct().groupBy("id", "tag").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the covered bytes."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text", with_kept: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary) if asked for."""
    if not 1 <= gram <= length < 4096:
        raise ValueError("a gram is at most as long as the string, which is under 4096 bytes")
    keyed = _keyed(docs, id_column, text_column)
    spans = repeated_spans(keyed, length, gram).select(F.col("id").alias("at_id"), F.col("tag").alias("at_tag"), "spans")
    joined = keyed.join(spans, (F.col("id") == F.col("at_id")) & (F.col("tag") == F.col("at_tag")), "left").select("own", "text", "spans")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(binary_column(batch, "text"), batch.column("spans").to_pylist()):
                runs = merge_spans([(x["s"], x["e"]) for x in found]) if found else []
                kept, at = [], 0
                for s, e in runs:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                rest = b"".join(kept)
                for column, v in zip(out, (len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest)):
                    column.append(v)
            ids = batch.column("own")
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            columns = [ids, *(pa.array(c, k) for c, k in zip(out[: 4 + with_kept], kinds))]
            yield pa.RecordBatch.from_arrays(columns, ["own", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept])

    schema = f"own {dict(docs.dtypes)[id_column]}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept
    found = joined.mapInArrow(cut, schema)
    return found.select(F.col("own").alias(id_column), *found.columns[1:])


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans and kept_sha256 by looking every string up; for small inputs."""
    data = [(t or "").encode() for t in texts]
    times: dict[bytes, int] = {}
    for d in data:
        for k in range(len(d) - length + 1):
            times[d[k : k + length]] = times.get(d[k : k + length], 0) + 1
    out = []
    for d in data:
        runs = merge_spans([(k, k + length) for k in range(len(d) - length + 1) if times[d[k : k + length]] > 1])
        rest, at = b"", 0
        for s, e in runs:
            rest, at = rest + d[at:s], e
        rest += d[at:]
        out.append((len(d), len(d) - len(rest), len(runs), hashlib.sha256(rest).hexdigest()))
    return out
