"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints have 64 bits. A pair within 3 bits agrees on one of 4 bands of 16 bits
whole, and within the other 48 bits on one of 4 sub-bands of 12 bits, so the distinct
fingerprints are dealt into 16 families of buckets of 28 bits. A bucket's
fingerprints are stored as vertical bit planes; carry-save counters of two bits and
an overflow bit add up 64 distances a machine word, and a block of lanes is
abandoned once every lane is over the radius. Each bucket gives a spanning forest of
its links, never all pairs; components come from star contraction over the links,
with a checkpoint each round. Copies of a fingerprint are one node throughout. A bucket of
over PART members is cut into blocks, and every pair of blocks is a bucket of its own, so
that no task holds more than two blocks of it.

Defined cases: null and empty texts, and texts without words, have fingerprint zero,
which links like any other; fewer words than the shingle: the whole sequence is the
one shingle; repeated rows each get their row; a null doc_id never is a component's
id unless it has no other; a very long text is hashed whole, in bounded memory a shingle; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import binary_column, checkpointed, clashless, discard, shuffle_width, spaced_words, text_key, written

SEED, RADIUS, SHINGLE = 42, 3, 3
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Edges of a partition between rounds of contraction.
EDGES = 100_000
#: Buckets up to this size are compared as lanes of pairs, larger ones probe against block.
SMALL = 48
#: Members of a bucket, and of a group whose sets are compared, from which these are split; rows of buckets to a task.
PART, GROUP, TASK_ROWS = 20_000, 2_000, 500_000
#: Split keys up to which these are sent to every task.
FEW_KEYS = 100_000


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included; one for a text of fewer words, none without words."""
    import xxhash

    words = spaced_words(text)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), seed)] if words else [], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = [0, *ends[: len(words) - shingle].tolist()]
    return np.array([digest(joined[a:b], seed) for a, b in zip(begin, (ends[shingle - 1 :] - 1).tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> np.uint64:
    """Each bit that over half the hashes have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return int(majority(shingle_hashes(text, shingle, seed)))


def _remixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Independent hashes from hashes."""
    h = hashes + np.uint64((number * 0x9E3779B97F4A7C15) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id and fp, the fingerprint as a signed bigint."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in binary_column(batch, text_column)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(fps.view(np.int64))], [id_column, "fp"])

    return clashless(docs, id_column, text_column).mapInArrow(scan, f"`{id_column}` {dict(docs.dtypes)[id_column]}, fp bigint")


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 bit planes, each with one bit a value, in words of 64 lanes."""
    words = -(-len(values) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(differ, shape: tuple[int, ...], lanes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Bits of the lanes whose distance is at most 3 (radius).

    differ(plane, live) gives the words of a plane's differing bits, for the live blocks.
    lanes: the bits of lanes that exist. Counters are carry-save: ones and twos, and over.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two-bit counters reach a radius of 3")
    live = np.arange(int(np.prod(shape)))
    ones, twos = np.zeros(len(live), np.uint64), np.zeros(len(live), np.uint64)
    over = ~np.broadcast_to(lanes, shape).reshape(-1)
    out = np.zeros(len(live), np.uint64)
    for plane in range(64):
        x = differ(plane, live)
        carry = ones & x
        ones = ones ^ x
        over = over | (twos & carry)
        twos = twos ^ carry
        if plane % 8 == 7 and plane < 63:
            alive = over != _ONES
            if not alive.all():
                live, ones, twos, over = live[alive], ones[alive], twos[alive], over[alive]
                if not len(live):
                    return out.reshape(shape)
    if radius == 2:
        over = over | (ones & twos)
    elif radius == 1:
        over = over | twos
    elif radius == 0:
        over = over | ones | twos
    out[live] = ~over
    return out.reshape(shape)


def within_wide(differ, shape: tuple[int, ...], lanes: np.ndarray, planes: int, radius: int) -> np.ndarray:
    """As within, for fingerprints of many planes and any radius: counters of as many bits as the radius needs."""
    live = np.arange(int(np.prod(shape)))
    digits = [np.zeros(len(live), np.uint64) for _ in range(radius.bit_length())]
    over = ~np.broadcast_to(lanes, shape).reshape(-1)
    out = np.zeros(len(live), np.uint64)
    for plane in range(planes):
        carry = differ(plane, live)
        for k, digit in enumerate(digits):
            digits[k], carry = digit ^ carry, digit & carry
        over = over | carry
        if plane % 32 == 31 or plane == planes - 1:
            above, equal = np.zeros(len(live), np.uint64), np.full(len(live), _ONES)
            for k in reversed(range(len(digits))):
                if radius >> k & 1:
                    equal = equal & digits[k]
                else:
                    above = above | (equal & digits[k])
                    equal = equal & ~digits[k]
            over = over | above
            alive = over != _ONES
            live, over, digits = live[alive], over[alive], [d[alive] for d in digits]
            if not len(live):
                return out.reshape(shape)
    out[live] = ~over
    return out.reshape(shape)


def _lane_bits(n: int) -> np.ndarray:
    return np.packbits(np.arange(-(-n // 64) * 64) < n, bitorder="little").view("<u8")


def _places(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), bitorder="little"))


def hot_keys(rows: DataFrame, key: str, part: int) -> DataFrame | None:
    """(of_hot, ways): the keys with over `part` rows, and how many blocks each is cut into; None if there are none."""
    counted = rows.groupBy(F.col(key).alias("of_hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part)
    hot = written(counted.select("of_hot", F.ceil(F.col("n") / part).cast("int").alias("ways")), f"hot-{uuid.uuid4().hex}")
    n = hot.count()
    if not n:
        discard(hot)
        return None
    return F.broadcast(hot) if n <= FEW_KEYS else hot


def in_block_pairs(rows: DataFrame, key: str, member: str, hot: DataFrame | None) -> DataFrame:
    """rows with the key of a hot bucket changed to keys of its pairs of blocks: each row once for each block it is to meet.

    Keys that met by chance would only make two buckets one.
    """
    if hot is None:
        return rows
    joined = rows.join(hot, F.col(key) == F.col("of_hot"), "left")
    own = F.pmod(F.xxhash64(member, F.lit(7)), F.col("ways")).cast("int")
    each = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("ways"), F.lit(1)) - 1)))
    pair = F.xxhash64(key, F.least(own, "other"), F.greatest(own, "other"))
    return each.withColumn(key, F.when(F.col("ways").isNull(), F.col(key)).otherwise(pair)).select(*rows.columns)


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by smallest place, of all the given links at once."""
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        apart = low != high
        if not apart.any():
            return
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while True:
            flat = root[root]
            if (flat == root).all():
                break
            root[:] = flat


def _link_block(own: np.ndarray, root: np.ndarray, base: int, near_lanes) -> None:
    """Joins a large bucket's linked fingerprints in root, a view whose entries count from base.

    Probes need no lanes of their own component: members of the largest one, which in a bucket
    of altered copies soon holds nearly all, are compared with the rest only.
    """
    n, words = own.shape
    root -= base
    for k in range(0, n, 256):
        names, counts = np.unique(root, return_counts=True)
        if len(names) == 1:
            break
        inside = root == names[counts.argmax()]
        probes = np.arange(k, min(k + 256, n))
        for some, others in ((probes[inside[probes]], np.flatnonzero(~inside)), (probes[~inside[probes]], np.arange(n))):
            if not len(some) or not len(others):
                continue
            planes = [planes_of(own[others, w]) for w in range(words)]
            lanes = _lane_bits(len(others))
            width = len(lanes)

            def differ(p: int, live: np.ndarray) -> np.ndarray:
                bit = (own[some, p >> 6] >> np.uint64(p & 63)) & np.uint64(1)
                return planes[p >> 6][p & 63][live % width] ^ np.where(bit == 1, _ONES, np.uint64(0))[live // width]

            near = near_lanes(differ, (len(some), width), lanes)
            for i in np.flatnonzero(near.any(axis=1)):
                other = others[_places(near[i])]
                other = other[other != some[i]]
                _merge(root, np.full(len(other), some[i]), other)
    root += base


def bucket_links(keys: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of values, of the links within each bucket."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    size_at = np.repeat(sizes, sizes)
    root = np.arange(len(values))
    small = np.flatnonzero((size_at > 1) & (size_at <= SMALL))
    for a in range(0, len(small), 1 << 16):
        # a run of buckets that begins in this stretch and ends in the next is in both, so that no pair is missed
        held, shift = small[a : a + (1 << 16) + SMALL], 1
        while len(held):
            planes, own = planes_of(values[held]), keys[held]
            for ahead in range(shift, 2 * shift):  # every lane against the one so many lanes on, in all buckets at once
                same = np.zeros(planes.shape[1] * 64, np.uint8)
                same[: max(0, len(held) - ahead)] = own[ahead:] == own[:-ahead]
                lanes = np.packbits(same, bitorder="little").view("<u8")
                if not lanes.any():
                    continue
                far = planes >> np.uint64(ahead)
                far[:, :-1] |= planes[:, 1:] << np.uint64(64 - ahead)
                gap = planes ^ far
                hit = _places(within(lambda p, live: gap[p][live], (len(lanes),), lanes, radius))
                _merge(root, held[hit], held[hit + ahead])
            shift *= 2
            held = held[size_at[held] > shift]
    for at, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        _link_block(values[at : at + n, None], root[at : at + n], at, lambda differ, shape, lanes: within(differ, shape, lanes, radius))
    linked = np.flatnonzero(root != np.arange(len(root)))
    return values[root[linked]], values[linked]


def wide_radius(similarity: float, bits: int) -> int:
    """Expected differing bits of two sets of one size at a Jaccard similarity."""
    return int(np.floor(bits * np.arccos(2 * similarity / (1 + similarity)) / np.pi))


def wide_links(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of rows, of the links within each bucket; prints is (rows, words)."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    root = np.arange(len(keys))  # by place in order
    words = prints.shape[1]
    size_at = np.repeat(sizes, sizes)
    small = np.flatnonzero((size_at > 1) & (size_at <= SMALL))
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    shift = 1
    while len(small):
        small = small[small + shift < len(keys)]
        small = small[bucket[small] == bucket[small + shift]]
        for k in range(0, len(small), 1 << 14):
            left = small[k : k + (1 << 14)]
            gap = prints[order[left]] ^ prints[order[left + shift]]
            planes = [planes_of(gap[:, w]) for w in range(words)]
            hit = _places(within_wide(lambda p, live: planes[p >> 6][p & 63][live], (planes[0].shape[1],), _lane_bits(len(left)), 64 * words, radius))
            _merge(root, left[hit], left[hit] + shift)
        shift += 1
    for at, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        _link_block(prints[order[at : at + n]], root[at : at + n], at, lambda differ, shape, lanes: within_wide(differ, shape, lanes, 64 * words, radius))
    linked = np.flatnonzero(root != np.arange(len(root)))
    return order[root[linked]], order[linked]


def _bucket_keys(values: np.ndarray) -> np.ndarray:
    """16 bucket keys a fingerprint: band, sub-band of the rest, and their 28 bits."""
    out = []
    for band in range(4):
        part = (values >> np.uint64(16 * band)) & np.uint64(0xFFFF)
        low = values & np.uint64((1 << (16 * band)) - 1)
        rest = low | (((values >> np.uint64(16 * band)) >> np.uint64(16)) << np.uint64(16 * band))
        for sub in range(4):
            bits = (rest >> np.uint64(12 * sub)) & np.uint64(0xFFF)
            out.append(np.uint64((band * 4 + sub) << 28) | (part << np.uint64(12)) | bits)
    return np.stack(out, axis=1)


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a < b between distinct fingerprints (column fp), enough of them to connect whatever is linked."""

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            keys = _bucket_keys(values)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(values, 16).view(np.int64))], ["bucket", "fp"])

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parts = [(b.column("bucket").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False)) for b in batches]
        if parts:
            keys, values = (np.concatenate(x) for x in zip(*parts))
            a, b = bucket_links(keys, values.view(np.uint64), radius)
            a, b = a.view(np.int64), b.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    dealt = fingerprints.select("fp").mapInArrow(deal, "bucket bigint, fp bigint")
    tasks = max(shuffle_width(fingerprints.sparkSession), -(-16 * fingerprints.count() // TASK_ROWS))
    buckets = in_block_pairs(dealt, "bucket", "fp", hot_keys(dealt, "bucket", PART)).repartition(tasks, "bucket")
    return buckets.mapInArrow(compare, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by large-star and small-star steps."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        low = df.groupBy(F.col("n").alias("k")).agg(F.min("m").alias("low"))
        low = low.select("k", F.least("k", "low").alias("low"))
        joined = df.join(low, df["n"] == low["k"])
        if large:
            out = joined.where("m > n").select(F.col("low").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("low").alias("a"), F.col("m").alias("b")).union(low.select(F.col("low").alias("a"), F.col("k").alias("b")))
        return out.where("a < b").distinct()

    edges = checkpointed(edges)
    seen = mark(edges)
    while True:
        parts = 1 + seen[0] // EDGES  # as many partitions as the edges need, so that a round over few is short
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).union(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
        edges = star(both, True)
        edges = checkpointed(star(edges.select(F.col("b").alias("n"), F.col("a").alias("m")), False).coalesce(parts))
        if (now := mark(edges)) == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, fp and component_id, the smallest id that it reaches over links."""
    rows = checkpointed(with_fingerprint(docs, shingle, id_column, text_column))
    nodes = rows.groupBy("fp").agg(F.min(id_column).alias("low"))
    linked = components(links(nodes, radius))
    grouped = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    of = grouped.join(least, "root").select(F.col("fp").alias("of_fp"), "component_id")
    return rows.join(of, rows["fp"] == of["of_fp"]).select(id_column, "fp", "component_id")


WIDE_WORDS, LEAST_SHINGLES, SLACK = 8, 8, 0.3


def wide_print(distinct: np.ndarray) -> bytes:
    """WIDE_WORDS words of majorities, over remixed hashes of a set: repeats don't count."""
    return b"".join(int(majority(_remixed(distinct, k))).to_bytes(8, "little") for k in range(WIDE_WORDS))


def set_node(distinct: np.ndarray) -> int:
    """64 bits, signed, of a set of shingle hashes in order."""
    return int.from_bytes(hashlib.blake2b(distinct.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


def exact_roots(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Component of each set, by its smallest place, where pairs of exact Jaccard similarity are linked.

    Sets are compared with those of other components only; pairs whose sizes alone rule the
    similarity out are passed over.
    """
    root, sizes = np.arange(len(sets)), np.array([len(x) for x in sets], np.int64)
    names, codes = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, np.int64))
    parts = np.split(codes, np.cumsum(sizes)[:-1])
    marked = np.zeros(len(names), bool)
    for i in range(len(sets) - 1):
        others = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[low / np.maximum(high, 1) >= similarity]
        if not len(others):
            continue
        marked[parts[i]] = True
        met = {root[i]}
        for j in others:
            if root[j] not in met:
                common = np.count_nonzero(marked[parts[j]])
                if common / (sizes[i] + sizes[j] - common) >= similarity:
                    met.add(root[j])
        marked[parts[i]] = False
        if len(met) > 1:
            root[np.isin(root, list(met))] = min(met)
    return root


def _keyed_groups(docs: DataFrame, shingle: int, similarity: float, id_column: str, text_column: str) -> DataFrame:
    """id, key (of the text), fp, and least: the smallest (no_id, id, key) of the row's component."""
    kind = dict(docs.dtypes)[id_column]
    keyed = clashless(docs, id_column, text_column).withColumn("key", text_key(text_column))

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            prints, keys, nodes = [], [], []
            for text in binary_column(batch, text_column):
                distinct = np.unique(shingle_hashes(text, shingle))
                prints.append(wide_print(distinct))
                keys.append(distinct[:LEAST_SHINGLES].view(np.int64))
                nodes.append(set_node(distinct))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column), batch.column("key"), pa.array(nodes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                [id_column, "key", "node", "fp", "keys"],
            )

    radius = wide_radius(max(similarity - SLACK, 0.0), 64 * WIDE_WORDS)
    rows = checkpointed(keyed.mapInArrow(scan, f"`{id_column}` {kind}, key binary, node bigint, fp binary, keys array<bigint>"))
    first = F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id"), F.col("key").alias("key"))
    nodes = rows.groupBy("node").agg(F.min(first).alias("low"), F.min("fp").alias("fp"), F.min("keys").alias("keys"))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            prints = np.frombuffer(b"".join(table["fp"].to_pylist()), "<u8").reshape(-1, WIDE_WORDS)
            names = table["node"].to_numpy()
            a, b = wide_links(table["bucket"].to_numpy(), prints, radius)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(names[a], names[b])), pa.array(np.maximum(names[a], names[b]))], ["a", "b"])

    buckets = nodes.select(F.explode("keys").alias("bucket"), "node", "fp")
    buckets = in_block_pairs(buckets, "bucket", "node", hot_keys(buckets, "bucket", PART))
    buckets = buckets.repartition(max(shuffle_width(docs.sparkSession), -(-LEAST_SHINGLES * nodes.count() // TASK_ROWS)), "bucket")
    loose = components(buckets.mapInArrow(compare, "a bigint, b bigint").where("a < b").distinct())
    loose = loose.unionByName(loose.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("in_node"), F.col("root").alias("loose"))
    loose = checkpointed(loose)
    members = nodes.join(loose, F.col("node") == F.col("in_node")).select("node", "loose", F.col("low.key").alias("of_key"))
    hot = hot_keys(loose, "loose", GROUP)

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            for node, group, text in zip(batch.column("node").to_pylist(), batch.column("loose").to_pylist(), binary_column(batch, text_column)):
                if node not in seen:
                    seen.add(node)
                    out.append((node, group, np.unique(shingle_hashes(text, shingle)).astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["node", "loose", "shingles"])

    def decide(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def settled(group: dict[int, bytes]):
            names = np.sort(np.fromiter(group, np.int64, len(group)))
            root = exact_roots([np.frombuffer(group[k], "<u8") for k in names.tolist()], similarity)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], ["node", "root"])

        group, at = {}, None
        for batch in batches:
            for node, loose_root, shingles in zip(*(batch.column(c).to_pylist() for c in ("node", "loose", "shingles"))):
                if loose_root != at and group:
                    yield settled(group)
                    group = {}
                at = loose_root
                group[node] = shingles
        if group:
            yield settled(group)

    texts = keyed.select("key", text_column).join(members, F.col("key") == F.col("of_key")).select("node", "loose", text_column)
    dealt = in_block_pairs(texts.mapInArrow(sets, "node bigint, loose bigint, shingles binary"), "loose", "node", hot).repartition(shuffle_width(docs.sparkSession), "loose").sortWithinPartitions("loose")
    linked = dealt.mapInArrow(decide, "node bigint, root bigint")
    if hot is not None:  # links of block pairs meet
        linked = components(linked.select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b")).where("a < b").distinct())
    linked = linked.select(F.col("node").alias("n"), "root")
    of = nodes.select("node", "low").join(linked, F.col("node") == F.col("n"), "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    of = checkpointed(of)
    least = of.groupBy("root").agg(F.min("low").alias("least"))
    of = of.join(least, "root").select(F.col("node").alias("of_node"), "least")
    return rows.select(id_column, "key", "node", "fp").join(of, F.col("node") == F.col("of_node")).select(id_column, "key", "fp", "least")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp, component_id) of every document, linked where shingle sets are similar.

    For similarities well under one, 64 bits and 3 of them are too few. Here 512-bit
    fingerprints are compared, bit-sliced, between documents that share one of the 8 least
    shingle hashes of either, at a similarity less SLACK (some six standard deviations of
    the estimate). This only chooses what to compare: within the groups so met, pairs link
    by the exact Jaccard similarity of their sets of distinct shingles. Of the 8 least
    hashes of two sets together, each is in both with the probability of their similarity,
    so a pair at 0.8 shares none with 0.2^8, three in a million. Groups of over GROUP sets
    are compared in pairs of blocks. Texts of equal sets are one node; texts without words
    are one group.
    """
    found = _keyed_groups(docs, shingle, similarity, id_column, text_column)
    return found.select(id_column, "fp", F.col("least.id").alias("component_id"))


def representatives(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, key) of the least row of each group of similar documents; key is text_key of its text."""
    least = _keyed_groups(docs, shingle, similarity, id_column, text_column).select("least").distinct()
    return least.select(F.col("least.id").alias(id_column), F.col("least.key").alias("key"))


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0")).alias("fingerprint")
