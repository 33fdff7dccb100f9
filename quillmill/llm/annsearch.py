"""Approximate nearest neighbours by cross-polytope hashing.

A hash rotates a unit vector pseudo-randomly (three rounds of random signs and a fast
Hadamard transform, on the next power of two) and takes the axis, with its sign, that
the rotated vector is nearest to. A table concatenates as many hashes as make its
buckets grow with the number of rows (``bucket`` rows are aimed at). A query
probes the buckets whose axes its own rotations are nearest to, best sums first, in
each of ``tables`` tables. All rows of the probed buckets are candidates and are
ranked by their exact Euclidean distance on the original vectors, in double precision.

How many buckets are probed is measured, not guessed: the true neighbours of at most
``calibration`` queries, picked by a hash of the id, are found by one scan of all rows,
and the least number of probes that would have collected ``target`` of them is
taken. Clustered vectors need few probes, vectors without structure many; where even
``most_probes`` don't do, tables get one hash less, and with one hash all buckets can
be probed. The index holds every row.

Rows of equal vectors are one bucket whatever is hashed. Only the k + 1 smallest ids
of a vector can be among anybody's k nearest, so the others are taken out first, by a
limit that every task applies before the shuffle; a vector that a third of all rows
share thus costs no more than others. Buckets are shuffled in groups of a common first
axis, so a query's vector goes to a group once, with the list of buckets to look at,
and meets the rows' vectors there: a query has more candidates than a row has tables,
so this moves less than pairs of candidates would. Groups grow to about ``part`` rows
and are then divided by their buckets; a group beyond that, as around a hot direction,
is dealt into parts that are all searched. A part answers with its own best ``k``
per query, of which the best ``k`` are taken; that is exact over the union of
candidates, and nothing is capped. Queries with fewer than ``k`` candidates are
searched again over all rows, in blocks.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part, as rows or as queries. Vectors of different lengths have no distance;
each length is searched for itself. Rows without an id take no part. Rows that repeat
an id are one candidate and one query, at the least distance of any of their vectors;
a query's own id is never its candidate. Ties go to the smaller id. Distances beyond
the range of doubles are infinite and rank last. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import saved
from .shingles import mix


@dataclass(frozen=True)
class CrossPolytope:
    tables: int = 8
    bucket: int = 4  #: rows that a bucket is to hold on average
    target: float = 0.96  #: share of true neighbours that the probes must collect
    calibration: int = 256  #: most queries that probes are measured with
    most_probes: int = 1024  #: buckets of a table
    seed: int = 11
    part: int = 4000  #: rows that are searched together


@dataclass(frozen=True)
class Index:
    """How rows are hashed and queries probe."""

    hashes: int
    probes: int
    splits: int  #: groups of a first axis
    c: CrossPolytope


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x after rounds of signs and the normalised Hadamard transform."""
    n, d = x.shape
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            x = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
            h *= 2
        x = x / np.sqrt(d)
    return x


def _axes(vectors: np.ndarray, table: int, hashes: int, c: CrossPolytope) -> list[np.ndarray]:
    """For every hash of a table how near each vector is to all signed axes; axis a and its opposite are a and a + d."""
    n, dim = vectors.shape
    d = 1 << max(dim - 1, 1).bit_length()
    unit = np.zeros((n, d))
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit[:, :dim] = scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))
    rng = np.random.default_rng((c.seed, table))
    turned = (rotate(unit, rng.choice((-1.0, 1.0), (3, d))) for _ in range(hashes))
    return [np.hstack((y, -y)) for y in turned]


def _bucket(before: np.ndarray, axis: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + axis.astype(np.uint64) + np.uint64(1))


def buckets(vectors: np.ndarray, hashes: int, c: CrossPolytope) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and first axis of every vector in every table: two arrays (rows, tables)."""
    out, first = np.zeros((len(vectors), c.tables), np.uint64), np.zeros((len(vectors), c.tables), np.int64)
    for t in range(c.tables):
        code = np.full(len(vectors), t, np.uint64)
        for k, near in enumerate(_axes(vectors, t, hashes, c)):
            axis = near.argmax(axis=1)
            first[:, t] = axis if k == 0 else first[:, t]
            code = _bucket(code, axis)
        out[:, t] = code
    return out, first


def probed(vectors: np.ndarray, table: int, hashes: int, probes: int, c: CrossPolytope) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a table that queries look at, best first, and their first axes: arrays (queries, probes at most)."""
    n = len(vectors)
    code, score, first = np.full((n, 1), table, np.uint64), np.zeros((n, 1)), np.zeros((n, 1), np.int64)
    for k, near in enumerate(_axes(vectors, table, hashes, c)):
        axes = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        sums = score[:, :, None] + np.take_along_axis(near, axes, axis=1)[:, None, :]
        best = np.argsort(-sums.reshape(n, -1), axis=1, kind="stable")[:, :probes]
        at, own = best // axes.shape[1], np.take_along_axis(axes, best % axes.shape[1], axis=1)
        score = np.take_along_axis(sums.reshape(n, -1), best, axis=1)
        code = _bucket(np.take_along_axis(code, at, axis=1), own)
        first = own if k == 0 else np.take_along_axis(first, at, axis=1)
    return code, first


def _group(bucket: np.ndarray, first: np.ndarray, table, splits: int) -> np.ndarray:
    """What is shuffled together: rows of a table and a first axis, in splits by bucket."""
    return mix(_bucket(np.zeros(1, np.uint64) + np.uint64(table), first) + bucket % np.uint64(splits)).view(np.int64)


def _stacked(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, most: int = 1000):
    """Slices of a batch whose vectors v have one length, given with them."""
    sizes = np.asarray(batch.column("dim"))
    for dim in np.unique(sizes).tolist():
        own = batch if (sizes == dim).all() else batch.take(pa.array(np.flatnonzero(sizes == dim)))
        for start in range(0, own.num_rows, most):
            yield dim, own.slice(start, most)


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, dim, v) of the rows that take part; floats stay floats here and are reckoned with as doubles."""
    v = F.col("v")
    kind = rows.select(vector).schema[0].dataType.simpleString()
    own = F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")
    named = rows.select(F.col(vec_id).cast("long").alias("vec_id"), own.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return named.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.size(v).alias("dim"), "v")


def _candidates(rows: DataFrame, k: int) -> DataFrame:
    """rows without those that can't be among k nearest: of equal vectors the k + 1 smallest ids stay."""
    order = Window.partitionBy("v").orderBy("vec_id")
    once = rows.groupBy("vec_id", "dim", "v").agg(F.lit(1))
    return once.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k + 1).select("vec_id", "dim", "v")


def distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to q; squares that overflow or vanish are taken after scaling."""
    with np.errstate(over="ignore", invalid="ignore"):
        off = rows - q
        square = (off**2).sum(axis=1)
        dist = np.sqrt(square)
        for i in np.flatnonzero(~np.isfinite(square) | (square < 1e-280)):
            most = np.abs(off[i]).max()
            dist[i] = most * np.sqrt(((off[i] / most) ** 2).sum()) if 0 < most < np.inf else most
    return dist


def _best(query: np.ndarray, own: int, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest rows, of which ids ascend; ties to the smaller id."""
    other = ids != own
    rows, ids = (rows, ids) if other.all() else (rows[other], ids[other])
    if not len(ids):
        return ids, np.zeros(0)
    dist = distances(rows, query)
    # Rows that repeat an id lie side by side; the nearest of them counts.
    if (ids[1:] == ids[:-1]).any():
        first = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1]
        dist, ids = np.minimum.reduceat(dist, first), ids[first]
    near = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1]) if len(dist) > k else np.arange(len(dist))
    near = near[np.argsort(dist[near], kind="stable")][:k]
    return ids[near], dist[near]


_FOUND = "query_id long, vec_id long, score double"


def _found(q_ids: list, ids: list, dist: list) -> dict[str, pa.Array]:
    named = np.repeat(np.array(q_ids, np.int64), [len(x) for x in ids])
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return {"query_id": pa.array(named, pa.int64()), "vec_id": pa.array(join(ids, np.int64), pa.int64()), "score": pa.array(join(dist, np.float64), pa.float64())}


def _calibrated(queries: DataFrame, rows: DataFrame, n: int, k: int, c: CrossPolytope) -> Index:
    """The index for n rows, with the probes that a bounded sample of queries needs."""
    sample = queries.orderBy(F.xxhash64("vec_id", F.lit(c.seed)), "vec_id").limit(c.calibration).collect()  # bounded by calibration
    asked: dict[int, list] = {}
    for r in sample:
        asked.setdefault(r["dim"], []).append((r["vec_id"], np.array(r["v"], np.float64)))
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def nearest_here(batches):
        for b in batches:
            for dim, part in _by_length(b):
                order = np.argsort(np.asarray(part.column("vec_id")), kind="stable")
                x, ids = _stacked(part.column("v"))[order], np.asarray(part.column("vec_id"))[order]
                for own, q in shared.value.get(dim, ()):
                    near, dist = _best(q, own, x, ids, k)
                    at = np.searchsorted(ids, near)
                    yield pa.RecordBatch.from_arrays([pa.array([own] * len(near), pa.int64()), pa.array(near, pa.int64()), pa.array(dist, pa.float64()), pa.array([dim] * len(near), pa.int32()), pa.array(list(x[at]), pa.list_(pa.float64()))], ["query_id", "vec_id", "score", "dim", "v"])

    found = rows.mapInArrow(nearest_here, f"{_FOUND}, dim int, v array<double>")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    true: dict[tuple[int, int], list] = {}
    for r in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).collect():  # calibration x k rows
        true.setdefault((r["query_id"], r["dim"]), []).append(r["v"])
    most_axes = max((2 << max(dim - 1, 1).bit_length() for dim in asked), default=2)
    hashes = max(1, round(log(max(n, 2) / c.bucket, most_axes)))
    while True:
        probes = _probes_needed(asked, true, hashes, max(c.most_probes, most_axes), c)
        if probes or hashes == 1:
            return Index(hashes, probes or most_axes, max(1, ceil(n / (most_axes * c.part))), c)
        hashes -= 1


def _probes_needed(asked: dict, true: dict, hashes: int, most: int, c: CrossPolytope) -> int | None:
    """The first of a ladder of probes that collects the target share of true neighbours, if most do."""
    ranks = []
    for dim, queries in asked.items():
        for start in range(0, len(queries), 16):  # so many lists of probes are held at once
            part = queries[start : start + 16]
            q = np.array([x for _, x in part])
            lists = [probed(q, t, hashes, most, c)[0] for t in range(c.tables)]
            for i, (own, _) in enumerate(part):
                if near := true.get((own, dim)):
                    codes, _ = buckets(np.array(near, np.float64), hashes, c)
                    hit = np.full(len(near), most + 1)
                    for t in range(c.tables):
                        same = lists[t][i][None, :] == codes[:, t][:, None]
                        hit = np.minimum(hit, np.where(same.any(axis=1), same.argmax(axis=1) + 1, most + 1))
                    ranks.append(hit)
    if not ranks:
        return 1
    ranks, probes = np.concatenate(ranks), 1
    while (ranks <= probes).mean() < c.target:
        if probes >= most:
            return None
        probes = min(probes + max(1, probes // 4), most)
    return probes


def _hashed(rows: DataFrame, x: Index) -> DataFrame:
    """rows once for every table, with their bucket and its group."""
    c = x.c

    def run(batches):
        for b in batches:
            for _, part in _by_length(b):
                codes, first = buckets(_stacked(part.column("v")), x.hashes, c)
                for t in range(c.tables):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codes[:, t].view(np.int64)), pa.array(_group(codes[:, t], first[:, t], t, x.splits))], [*part.schema.names, "bucket", "grp"])

    return rows.mapInArrow(run, f"vec_id long, dim int, v {rows.schema['v'].dataType.simpleString()}, bucket long, grp long")


def _asking(queries: DataFrame, x: Index) -> DataFrame:
    """queries once for every group they look into, with the buckets there."""
    c = x.c

    def run(batches):
        for b in batches:
            for _, part in _by_length(b, 64):
                q = _stacked(part.column("v"))
                for t in range(c.tables):
                    codes, first = probed(q, t, x.hashes, x.probes, c)
                    groups = _group(codes, first, t, x.splits)
                    order = np.argsort(groups, axis=1, kind="stable")
                    groups, codes = np.take_along_axis(groups, order, axis=1), np.take_along_axis(codes, order, axis=1)
                    starts = np.ones(groups.shape, bool)
                    starts[:, 1:] = groups[:, 1:] != groups[:, :-1]
                    of, offsets = np.nonzero(starts)[0], np.r_[np.flatnonzero(starts), groups.size]
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(codes.reshape(-1).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([*(x.take(pa.array(of)) for x in part.columns), lists, pa.array(groups[starts])], [*part.schema.names, "buckets", "grp"])

    return queries.mapInArrow(run, f"vec_id long, dim int, v {queries.schema['v'].dataType.simpleString()}, buckets array<bigint>, grp long")


def _searched(queries: DataFrame, rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Best k of every query in each group of keys: of the rows in its buckets, or of all without buckets."""

    def search(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table(_found([], [], []))
        ids = np.asarray(right.column("vec_id"))
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], _stacked(right.column("v").combine_chunks())[order]
        of = np.asarray(right.column("bucket"))[order] if "buckets" in left.column_names else None
        out: tuple[list, list, list] = ([], [], [])
        for i, (own, q) in enumerate(zip(left.column("vec_id").to_pylist(), _stacked(left.column("v").combine_chunks()), strict=True)):
            at = slice(None) if of is None else np.flatnonzero(np.isin(of, np.asarray(left.column("buckets")[i].values)))
            near, dist = _best(q, own, x[at], ids[at], k)
            if len(near):
                for into, value in zip(out, (own, near, dist), strict=True):
                    into.append(value)
        return pa.table(_found(*out))

    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(search, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, c: CrossPolytope = CrossPolytope()) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found. Both frames are as usable() makes them."""
    spark = rows.sparkSession
    rows, queries = saved(_candidates(rows, k)), saved(queries.groupBy("vec_id", "dim", "v").agg(F.lit(1)).select("vec_id", "dim", "v"))
    n = rows.count()
    index = _calibrated(queries, rows, n, k, c)
    indexed = _hashed(rows, index)
    # Most groups are one part; only those beyond are listed, and they are at most n x tables / part.
    large = saved(indexed.groupBy("dim", "grp").count().where(F.col("count") > 2 * c.part).select("dim", "grp", F.ceil(F.col("count") / c.part).cast("int").alias("parts")))
    large = F.broadcast(large) if large.count() <= 100_000 else large
    parts = F.coalesce("parts", F.lit(1))
    dealt = indexed.join(large, ["dim", "grp"], "left").withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int")).drop("parts")
    asked = _asking(queries, index).join(large, ["dim", "grp"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    first = saved(_top(_searched(asked, dealt, ["dim", "grp", "part"], k), k))
    found = first.groupBy("query_id").count().where(F.col("count") >= k)
    short = saved(queries.join(found, F.col("vec_id") == F.col("query_id"), "left_anti"))
    if short.isEmpty():
        return first
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 20_000))
    all_rows = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    all_asked = short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    again = _top(_searched(all_asked, all_rows, ["dim", "part"], k), k)
    return first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)


def search_table(embeddings: DataFrame, every: int = 100, k: int = 10, c: CrossPolytope = CrossPolytope()) -> DataFrame:
    """The k nearest of every row whose id is divisible by every."""
    rows = usable(embeddings)
    return nearest(rows.where(F.col("vec_id") % every == 0), rows, k, c)
