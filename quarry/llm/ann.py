"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors go through three rounds of random signs and a fast Hadamard transform, a
pseudo-rotation, and are hashed to the nearest signed axis. Each of TABLES tables joins
as many such hashes, the last one over fewer axes, as leave a bucket about OCCUPANCY
vectors, so that buckets get finer as the table grows. A query looks into its buckets
of least penalty (squared distance of its coordinates from the largest ones) in every
table, and what it meets there is ranked by its exact distance.

How many buckets a query looks into is fitted: the true neighbours of SAMPLE queries
are found by comparing these with every vector, and the number is taken that would have
met the share RECALL of them. The index holds every vector.

Equal vectors are one entry with their smallest ids (as many as can matter), so that
a vector which a third of the rows share is compared once. Entries and queries are dealt
by table and first axis, in parts of about PART entries, and only the nearest few of a
part leave it. A query that meets fewer neighbours than asked for is searched again
against every entry, in parts.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part; a query's own vec_id is no candidate; repeated rows of a vec_id with
the same vector count once, with another vector each counts; only vectors of the same
number of components are compared; null vec_ids take no part; ties go to the smaller
vec_id; an empty table gives no rows; components so large or small that their squares
leave the range of doubles are scaled before they are squared, and a distance that no
double holds is infinite.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.common import checkpointed, shuffle_width

TABLES, NEAREST, PART, SEED = 16, 10, 20_000, 77
#: Vectors that a bucket should hold, sampled queries, share of their neighbours to be met, most buckets to look into.
OCCUPANCY, SAMPLE, RECALL, MOST_PROBES = 16, 64, 0.97, 1024
#: Axes of each hash that a query's probes are made of.
_AXES = 32
_HIT = "array<struct<distance:double,vec_id:bigint>>"


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rounds of signs and a normalised Hadamard transform; x is (..., a power of two), signs (rounds, ...)."""
    width = x.shape[-1]
    for own in signs:
        x = x * own
        step = 1
        while step < width:
            pairs = x.reshape(*x.shape[:-1], width // (2 * step), 2, step)
            new = np.empty_like(pairs)
            np.add(pairs[..., 0, :], pairs[..., 1, :], out=new[..., 0, :])
            np.subtract(pairs[..., 0, :], pairs[..., 1, :], out=new[..., 1, :])
            x = new.reshape(x.shape)
            step *= 2
        x = x / np.asarray(np.sqrt(width), x.dtype)
    return x


class Hasher:
    """Buckets of vectors, and buckets to look into, table by table: (first axis, code of the further axes)."""

    def __init__(self, dim: int, n: int, tables: int = TABLES, seed: int = SEED):
        self.width = 1 << max(1, (dim - 1).bit_length())
        full, bits = (2 * self.width).bit_length() - 1, max(1, (max(n, 1) // OCCUPANCY).bit_length() - 1)
        self.sizes = []  # signed axes of each hash
        while bits > 0:
            self.sizes.append(1 << min(full, bits))
            bits -= full
        self.tables, self.first = tables, self.sizes[0]
        signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, len(self.sizes), 3, self.width))
        self.signs = signs.astype(np.float32).transpose(2, 0, 1, 3)  # rounds, tables, hashes, width

    def axes(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """Of each hash of a table, every vector's coordinate along each signed axis."""
        unit = x / np.abs(x).max(axis=1, keepdims=True)
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        padded = np.zeros((len(x), 1, self.width), np.float32)
        padded[:, 0, : x.shape[1]] = unit
        turned = rotate(padded, self.signs[:, table])
        return [np.concatenate([turned[:, k, : n // 2], -turned[:, k, : n // 2]], axis=1) for k, n in enumerate(self.sizes)]

    def buckets(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        first, *rest = [a.argmax(axis=1) for a in self.axes(x, table)]
        fine = np.zeros(len(x), np.int64)
        for n, own in zip(self.sizes[1:], rest):
            fine = fine * n + own
        return first.astype(np.int64), fine

    def probes(self, x: np.ndarray, table: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, up to `most`) first axes and codes, in order of their penalty."""
        first = fine = cost = None
        for n, own in zip(self.sizes, self.axes(x, table)):
            best = np.argsort(-own, axis=1, kind="stable")[:, : min(n, _AXES if len(self.sizes) > 1 else n)]
            value = np.take_along_axis(own, best, axis=1)
            more = (value[:, :1] - value) ** 2
            if first is None:
                first, fine, cost = best.astype(np.int64), np.zeros(best.shape, np.int64), more
            else:
                joined = (cost[:, :, None] + more[:, None, :]).reshape(len(x), -1)
                order = np.argsort(joined, axis=1, kind="stable")[:, :most]
                before, axis = order // best.shape[1], order % best.shape[1]
                cost = np.take_along_axis(joined, order, axis=1)
                first = np.take_along_axis(first, before, axis=1)
                fine = np.take_along_axis(fine, before, axis=1) * n + np.take_along_axis(best, axis, axis=1)
        return first[:, :most], fine[:, :most]


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def distances(entries: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; rows whose squares would leave the range of doubles are scaled."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        gap = entries - query
        out = np.sqrt((gap * gap).sum(axis=1))
        large = np.abs(gap).max(axis=1, initial=0.0)
        odd = ((large > 1e150) & np.isfinite(large)) | ((large > 0) & (large < 1e-150))
        if odd.any():
            out[odd] = large[odd] * np.sqrt(((gap[odd] / large[odd, None]) ** 2).sum(axis=1))
        out[np.isinf(large)] = np.inf
    return out


def nearest(query: np.ndarray, entries: np.ndarray, lowest: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the nearest entries, ties to the lower id."""
    d = distances(entries, query)
    place = np.arange(len(d))
    if len(d) > keep:
        place = np.flatnonzero(d <= np.partition(d, keep - 1)[keep - 1])
    order = np.lexsort((lowest[place], d[place]))[:keep]
    return place[order], d[place[order]]


def _search(rows: DataFrame, keep: int) -> DataFrame:
    """rows: bucket, part, vec, and ids and code (an entry) or query and codes (null: all). Gives (query, hits) for each task's parts."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        key = table["bucket"].to_numpy() * (1 << 32) + table["part"].to_numpy()
        vec = _matrix(table["vec"].chunk(0))
        asks, ids, code, codes = (table[c].to_pylist() for c in ("query", "ids", "code", "codes"))
        is_query = np.array([x is None for x in ids])
        order = np.argsort(key, kind="stable")
        met: dict[int, set] = {}  # a query's nearest in any of the task's parts leave it together
        for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            query, entry = group[is_query[group]], group[~is_query[group]]
            if not len(query) or not len(entry):
                continue
            own = np.array([code[e] for e in entry])
            by_code = np.argsort(own, kind="stable")
            own, entry = own[by_code], entry[by_code]
            lowest, vectors = np.array([ids[e][0] for e in entry]), vec[entry]
            for q in query:
                if codes[q] is None:
                    at = np.arange(len(entry))
                else:
                    want = np.array(codes[q], np.int64)
                    begin, end = np.searchsorted(own, want), np.searchsorted(own, want, side="right")
                    size = end - begin
                    at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                if not len(at):
                    continue
                place, distance = nearest(vec[q], vectors[at], lowest[at], keep)
                met.setdefault(asks[q], set()).update((d, x) for d, p in zip(distance.tolist(), at[place].tolist()) for x in ids[entry[p]])
                if len(met[asks[q]]) > 8 * keep:
                    met[asks[q]] = set(sorted(met[asks[q]])[:keep])
        hits = [[{"distance": d, "vec_id": x} for d, x in sorted(found)[:keep]] for found in met.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.int64()), pa.array(hits, pa.list_(pa.struct([("distance", pa.float64()), ("vec_id", pa.int64())])))], ["query", "hits"])

    return rows.repartition(shuffle_width(rows.sparkSession), "bucket", "part").mapInArrow(scan, f"query bigint, hits {_HIT}")


def probes_needed(queries: DataFrame, entries: DataFrame, hasher: Hasher, keep: int) -> int:
    """Buckets a table to look into, from the true neighbours of SAMPLE queries among all entries.

    The driver receives SAMPLE queries and the neighbours of each; a task holds no more than these.
    """
    asked = queries.orderBy(F.xxhash64("query"), "query").limit(SAMPLE).collect()
    if not asked:
        return 1
    points = np.array([r["vec"] for r in asked], np.float64)
    shared = queries.sparkSession.sparkContext.broadcast((points, [r["query"] for r in asked]))

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, names = shared.value
        best: list[list[tuple]] = [[] for _ in own]
        for batch in batches:
            if not batch.num_rows:
                continue
            low, vec = batch.column("class").to_numpy(), _matrix(batch.column("vec"))
            for k, point in enumerate(own):
                place, d = nearest(point, vec, low, keep)
                best[k] = sorted([*best[k], *zip(d.tolist(), low[place].tolist(), map(tuple, vec[place].tolist()))])[:keep]
        flat = [(names[k], d, c, list(v)) for k, found in enumerate(best) for d, c, v in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], t) for j, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())))], ["query", "distance", "class", "near"])

    found = entries.select("class", "vec").mapInArrow(scan, "query bigint, distance double, class bigint, near array<double>")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "class"))
    true = found.withColumn("rank", rank).where((F.col("rank") <= keep) & (F.col("class") != F.col("query"))).select("query", "near").collect()
    if not true:
        return 1
    number = {r["query"]: k for k, r in enumerate(asked)}
    who, near = np.array([number[r["query"]] for r in true]), np.array([r["near"] for r in true], np.float64)
    needed = np.full(len(true), MOST_PROBES)
    for t in range(hasher.tables):
        first, fine = hasher.probes(points, t, MOST_PROBES)
        at = hasher.buckets(near, t)
        same = (first[who] == at[0][:, None]) & (fine[who] == at[1][:, None])
        needed = np.minimum(needed, np.where(same.any(axis=1), same.argmax(axis=1) + 1, MOST_PROBES))
    return int(np.quantile(needed, RECALL, method="higher"))


def _best(found: DataFrame, keep: int) -> DataFrame:
    """One row per query with its nearest `keep` hits; each task that has met it sends `keep` at most."""
    each = found.select("query", F.explode("hits").alias("hit")).distinct()
    rank = F.row_number().over(Window.partitionBy("query").orderBy("hit.distance", "hit.vec_id"))
    top = each.withColumn("rank", rank).where(F.col("rank") <= keep)
    return top.groupBy("query").agg(F.array_sort(F.collect_list("hit")).alias("hits"))


def _one_dim(rows: DataFrame, dim: int, every: int, tables: int, probes: int | None, k: int) -> DataFrame:
    keep, kind = k + 1, dict(rows.dtypes)["vec"]
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    entries = rows.distinct().withColumn("rank", rank).where(F.col("rank") <= keep).groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = checkpointed(entries.withColumn("class", F.element_at("ids", 1)))
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    asked = checkpointed(asked.join(entries.select(F.col("vec").alias("v"), "class"), F.col("vec") == F.col("v")).select("vec_id", "class"))
    queries = entries.join(asked.select(F.col("class").alias("q")).distinct(), F.col("class") == F.col("q"), "left_semi").select(F.col("class").alias("query"), "vec")

    n = entries.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n")).first()["n"]
    hasher = Hasher(dim, n, tables)
    looks = probes or probes_needed(queries, entries, hasher, keep)

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column("vec"))
            for t in range(tables):
                first, fine = hasher.buckets(x, t)
                yield pa.RecordBatch.from_arrays([pa.array(first + t * hasher.first), pa.array(fine), batch.column("vec"), batch.column("ids")], ["bucket", "code", "vec", "ids"])

    def looked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column("vec"))
            for t in range(tables):
                first, fine = hasher.probes(x, t, looks)
                row, bucket, codes = [], [], []
                for k in range(len(x)):
                    order = np.argsort(first[k], kind="stable")
                    names, begin = np.unique(first[k][order], return_index=True)
                    row += [k] * len(names)
                    bucket += (names + t * hasher.first).tolist()
                    codes += [c.tolist() for c in np.split(fine[k][order], begin[1:])]
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(codes, pa.list_(pa.int64())), batch.column("vec").take(at), batch.column("query").take(at)], ["bucket", "codes", "vec", "query"])

    none = lambda kind: F.lit(None).cast(kind)
    index = entries.select("vec", "ids").mapInArrow(hashed, f"bucket bigint, code bigint, vec {kind}, ids array<bigint>")
    sizes = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("bigint"))
    # at most tables * 2 * width rows, whatever the input
    parts = F.broadcast(sizes.select(F.col("bucket").alias("b"), "parts"))
    index = index.join(parts, F.col("bucket") == F.col("b")).select("bucket", F.pmod(F.xxhash64("ids"), "parts").alias("part"), "vec", "ids", "code", none("bigint").alias("query"), none("array<bigint>").alias("codes"))
    probing = queries.select("vec", "query").mapInArrow(looked, f"bucket bigint, codes array<bigint>, vec {kind}, query bigint")
    probing = probing.join(parts, F.col("bucket") == F.col("b")).select("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "vec", none("array<bigint>").alias("ids"), none("bigint").alias("code"), "query", "codes")
    best = checkpointed(_best(_search(index.unionByName(probing), keep), keep))
    wanted = min(keep, n)
    short = queries.join(best.where(F.size("hits") >= wanted).select(F.col("query").alias("q")), F.col("query") == F.col("q"), "left_anti")
    if not short.isEmpty():  # too few met: every entry is looked at
        ways = max(1, -(-n // PART))
        all_in = entries.select(F.lit(0).cast("bigint").alias("bucket"), F.pmod(F.xxhash64("ids"), F.lit(ways)).alias("part"), "vec", "ids", F.lit(0).cast("bigint").alias("code"), none("bigint").alias("query"), none("array<bigint>").alias("codes"))
        each = short.select(F.lit(0).cast("bigint").alias("bucket"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ways - 1).cast("bigint"))).alias("part"), "vec", none("array<bigint>").alias("ids"), none("bigint").alias("code"), "query", none("array<bigint>").alias("codes"))
        best = best.where(F.size("hits") >= wanted).unionByName(_best(_search(all_in.unionByName(each), keep), keep))
    joined = asked.join(best, asked["class"] == best["query"])
    own = F.slice(F.filter("hits", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    out = joined.select(F.col("vec_id").alias("query_id"), F.posexplode(own).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.distance").alias("score"))


def search(vectors: DataFrame, every: int = 100, tables: int = TABLES, probes: int | None = None, k: int = NEAREST, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every row whose id is divisible by `every`; probes: buckets a table (fitted, if not given)."""
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    # single precision is shipped as it is; distances are always taken in double
    kind = "float" if dict(vectors.dtypes)[vector_column] == "array<float>" else "double"
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast(f"array<{kind}>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).where(fine)
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0).cast(kind)))  # one zero only
    dims = [r["d"] for r in rows.select(F.size("vec").alias("d")).distinct().orderBy("d").collect()]
    out = None
    for dim in dims:
        part = _one_dim(rows.where(F.size("vec") == dim) if len(dims) > 1 else rows, dim, every, tables, probes, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return out


def brute_force(ids: np.ndarray, x: np.ndarray, every: int = 100, k: int = NEAREST) -> dict[int, list[tuple[int, float]]]:
    """The exact answer, for small inputs of distinct ids and valid vectors."""
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in order]
    return out
