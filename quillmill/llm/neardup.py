"""Near-duplicate classes by improved consistent weighted sampling.

A document is a weighted set: its shingles of five words (in lower case, without
punctuation), each weighing its count times an inverse document frequency. Document
frequencies are counted over all documents in a hashed table of fixed size (2^20
counters), so the table that travels to the workers doesn't grow with the corpus;
shingles that share a counter share a frequency. The frequency weight of a share f of
all documents is (a + ln 1/f) / (a + ln 1/f0): the logarithm of the inverse frequency
over its whole range, on top of a constant a = ``smoothing`` * ln 1/f0. Shares below
f0 = ``rarest`` count as f0, so the weight means the same at any size of the corpus.
The constant bounds the range of weights to 1 + 1 / smoothing, 4 to 3 by default. It
has to be there: the shingles of a group of copies that holds a third of all
documents are as frequent as boilerplate, and by the bare logarithm each member's own
few edits would outweigh all that it shares. With it every pair of plain similarity
of at least 0.8422 is similar (s / (s + (1 - s) 4 / 3) = 0.8), whatever its group's
size, and none below 0.75. Documents are similar if their weighted Jaccard similarity (sum
of minima over sum of maxima) is at least ``threshold``.

Sampling follows Ioffe's improved consistent weighted sampling: an element of
weight w draws r, c ~ Gamma(2,1) and b ~ U(0,1) from its own hash, takes
t = floor(ln w / r + b), and the element with the least c / exp(r (t - b + 1))
gives the sample (element, t). Instead of drawing for every element and every
sample, elements are dealt into bins and each bin keeps its least element; empty
bins borrow from bins named by a fixed table, so equal sets borrow alike. Four
samples make a band, and documents that share a band are candidates.

Equal texts are one node from the start. Each document is first linked to the
smallest document that it shares a bucket with, and these links are verified on the
whole texts. That joins most of a group of copies at a linear cost. Buckets whose
members still lie in several components are then compared exactly: their members'
shingles meet by bucket, and a product of the members-by-shingles matrix with
itself gives all weighted similarities at once, without a row per pair. Such a task
returns no more links than join its components. A bucket too large for a task is
dealt into blocks, and each two blocks meet in a task of their own, so memory stays
bounded and no pair is left out; the work on one bucket of b members in m
components that stay apart grows with b squared. Buckets with the same members are
compared once. Classes are the connected components of the verified links.

With similarity s a pair shares one of 32 bands of four samples with probability
1 - (1 - s^4)^32: at 0.8 all but 5 in 10^8 in the limit of long texts.

Defined results: ids are whole numbers; other types are refused. A document's class is the smallest doc_id in it. Texts without a
word (null, empty, white space) have no shingles and are alone. Rows that repeat an
id are one document; with different texts, it is linked by any of them. Rows without an id have no class (null). An empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from .common import filled_text, private, released, removed, saved, stored
from .components import components
from .shingles import document_shingles, mix, sliced

_BITS = 20
_BLOCKS = 1024


@dataclass(frozen=True)
class Sampling:
    size: int = 5  #: words in a shingle
    threshold: float = 0.8
    smoothing: float = 3.0  #: constant part of the frequency weight against the largest logarithm
    rarest: float = 1e-4  #: share of documents below which a shingle is no rarer
    passes: int = 2  #: independent ways to deal elements into bins
    bins: int = 64  #: of each pass; a bin gives one sample
    rows: int = 4  #: samples in a band
    attempts: int = 48  #: tries of an empty bin before it takes the next full one
    block_members: int = 1024  #: of a bucket, compared in one task with as many others
    block_elements: int = 500_000


def frequencies(docs: DataFrame, size: int = 5) -> tuple[np.ndarray, int]:
    """Document frequencies by hashed counter, over all rows of docs, and the number of rows."""

    def count(batches):
        total, n = np.zeros(1 << _BITS, np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, texts in sliced(b.column(0)):
                for shingles, _ in document_shingles(texts, size):
                    at = (shingles >> np.uint64(64 - _BITS)).astype(np.int64)
                    total[np.unique(at)] += 1
        width = len(total) // _BLOCKS
        used = [k for k in range(_BLOCKS) if total[k * width : (k + 1) * width].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([total[k * width : (k + 1) * width].tobytes() for k in used], pa.binary()), pa.array([0] * len(used), pa.int64())], ["block", "counts", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.binary()), pa.array([n], pa.int64())], ["block", "counts", "n"])

    def add(key, rows):
        blobs = [np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist() if x is not None]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.sum(blobs, axis=0).tobytes() if blobs else None], pa.binary()), "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64())})

    kinds = "block int, counts binary, n long"
    df, n = np.zeros(1 << _BITS, np.int64), 0
    for r in docs.select(filled_text().alias("text")).mapInArrow(count, kinds).groupBy("block").applyInArrow(add, kinds).collect():  # 8 MB at most
        if r["block"] < 0:
            n = r["n"]
        else:
            width = len(df) // _BLOCKS
            df[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return df, n


def log_idf(df: np.ndarray, n: int, s: Sampling) -> np.ndarray:
    """ln of the weight of every counter."""
    most = -np.log(s.rarest)
    inverse = np.minimum(np.log(max(n, 1) / np.clip(df, 1, max(n, 1))), most)
    return np.log((s.smoothing * most + inverse) / (s.smoothing * most + most)).astype(np.float32)


def log_weights(shingles: np.ndarray, counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
    return np.log(counts) + logs[(shingles >> np.uint64(64 - _BITS)).astype(np.int64)]


def _uniform(x: np.ndarray, seed: int) -> np.ndarray:
    """In (0, 1), from the hash of x and a seed."""
    return ((mix(x + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def samples(shingles: np.ndarray, log_w: np.ndarray, doc: np.ndarray, n_docs: int, s: Sampling) -> np.ndarray:
    """Codes of the samples, one row per document and passes * bins columns. Documents must have a shingle to have meaning."""
    out = []
    for p in range(s.passes):
        x = mix(shingles ^ np.uint64((p + 1) * 0xD1B54A32D192ED03 % 2**64))
        r = -np.log(_uniform(x, 1) * _uniform(x, 2))
        c = -np.log(_uniform(x, 3) * _uniform(x, 4))
        b = _uniform(x, 5)
        t = np.floor(log_w / r + b)
        log_a = np.log(c) - r * (t - b + 1)
        at = doc * s.bins + (x % np.uint64(s.bins)).astype(np.int64)
        least = np.full(n_docs * s.bins, np.inf)
        np.minimum.at(least, at, log_a)
        won = log_a == least[at]
        codes = np.zeros(n_docs * s.bins, np.uint64)
        codes[at[won]] = mix(x[won] + t[won].astype(np.int64).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        out.append(_borrowed(codes.reshape(n_docs, s.bins), np.isfinite(least).reshape(n_docs, s.bins), s, p))
    return np.hstack(out)


def _borrowed(codes: np.ndarray, full: np.ndarray, s: Sampling, p: int) -> np.ndarray:
    """codes, with those of empty bins taken from full ones of the same document."""
    tries = np.random.default_rng(p).integers(0, s.bins, (s.attempts, s.bins))
    codes = codes.copy()
    rows, cols = np.nonzero(~full & full.any(axis=1)[:, None])
    turn = np.arange(s.bins)
    for k in range(s.attempts + 1):
        if not len(rows):
            break
        if k < s.attempts:
            source = tries[k][cols]
        else:  # the next full bin, going round
            source = np.array([(c + 1 + np.argmax(full[r][(c + 1 + turn) % s.bins])) % s.bins for r, c in zip(rows, cols, strict=True)])
        ok = full[rows, source]
        codes[rows[ok], cols[ok]] = codes[rows[ok], source[ok]]
        rows, cols = rows[~ok], cols[~ok]
    return codes


def band_keys(codes: np.ndarray, s: Sampling) -> np.ndarray:
    n, m = codes.shape
    key = np.zeros((n, m // s.rows), np.uint64)
    for j in range(s.rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + codes[:, j :: s.rows][:, : key.shape[1]])
    return mix(key + np.arange(key.shape[1], dtype=np.uint64)[None, :]).view(np.int64)


def _signed(docs: DataFrame, logs, s: Sampling) -> DataFrame:
    """doc_id, digest of the text and band keys (null for a text without words)."""
    rows = docs.select("doc_id", filled_text().alias("text"), F.unhex(F.md5(filled_text().cast("binary"))).alias("digest"))

    def run(batches):
        for b in batches:
            keys: list = []
            for _, texts in sliced(b.column("text")):
                sets = list(document_shingles(texts, s.size))
                sizes = np.array([len(x) for x, _ in sets])
                shingles = np.concatenate([x for x, _ in sets])
                log_w = log_weights(shingles, np.concatenate([c for _, c in sets]), logs.value)
                found = band_keys(samples(shingles, log_w, np.repeat(np.arange(len(sets)), sizes), len(sets), s), s)
                keys += [k if n else None for k, n in zip(found, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "keys"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, digest binary, keys array<bigint>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sets of (ascending shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 0.0


def _verified(links: DataFrame, texts: DataFrame, logs, s: Sampling) -> DataFrame:
    """The links (doc, rep) whose texts are similar enough.

    A hot rep's texts are replicated to its links only; adaptive execution splits
    the join. A worker keeps the last rep's set.
    """
    left = links.join(texts.select(F.col("node").alias("doc"), F.col("text").alias("a")), "doc")
    both = left.join(texts.select(F.col("node").alias("rep"), F.col("text").alias("b")), "rep").select("doc", "rep", "a", "b")

    def weighted(texts):
        return [(x, np.exp(log_weights(x, c, logs.value))) for x, c in document_shingles(texts, s.size)]

    def run(batches):
        last: tuple = (None, None)
        for b in batches:
            ok = []
            for start, part in sliced(b.column("a")):
                reps = b.column("b").slice(start, len(part))
                for k, one in enumerate(weighted(part)):
                    text = reps[k].as_py()
                    if last[0] != text:
                        last = (text, weighted(pa.array([text]))[0])
                    ok.append(weighted_jaccard(one, last[1]) >= s.threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("rep")], ["doc", "rep"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "doc long, rep long")


def _open_buckets(members: DataFrame, tried: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, doc, component) of the buckets that hold several components and more than one compared pair; of buckets with the same members one."""
    named = members.select("key", "doc").join(classes, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    whole = named.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.bit_xor(F.xxhash64("doc")).alias("mark"), F.min("component").alias("a"), F.max("component").alias("b"))
    pairs = tried.select(F.col("rep").alias("lo"), F.col("doc").alias("hi"), F.lit(2).cast("long").alias("n"))
    left = whole.where("a < b").join(pairs, ["lo", "hi", "n"], "left_anti")
    return named.join(left.groupBy("n", "lo", "hi", "mark").agg(F.min("key").alias("key")).select("key"), "key")


def _elements(texts: DataFrame, s: Sampling) -> DataFrame:
    """node, size, elements: a text's shingles in ascending order, each as often as it occurs."""

    def run(batches):
        for b in batches:
            sets = [np.repeat(x, n) for _, part in sliced(b.column("text")) for x, n in document_shingles(part, s.size)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "size", "elements"])

    return texts.mapInArrow(run, "node long, size long, elements binary")


def similarities(sets: list[np.ndarray], logs: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Weighted Jaccard similarities of all sets of ascending, possibly repeated shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    every = np.concatenate(sets)
    same = np.r_[False, (every[1:] == every[:-1]) & (owner[1:] == owner[:-1])]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(every))))
    # The k-th occurrence of a shingle is an element of its own, so minima of counts are intersections.
    element = every + (np.arange(len(every)) - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    weight = np.exp(logs[(every >> np.uint64(64 - _BITS)).astype(np.int64)].astype(np.float64))
    total = np.bincount(owner, weights=weight, minlength=len(sets))
    _, at, n = np.unique(element, return_inverse=True, return_counts=True)
    use = n[at] > 1
    owner, weight = owner[use], weight[use]
    at = np.unique(at[use], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    at, owner, weight = at[order], owner[order], weight[order]
    shared = np.zeros((len(sets), len(sets)))
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        i, j = np.searchsorted(at, (start, start + columns))
        plain = np.zeros((len(sets), columns))
        plain[owner[i:j], at[i:j] - start] = 1.0
        heavy = np.zeros(columns)
        heavy[at[i:j] - start] = weight[i:j]
        shared += (plain * heavy) @ plain.T
    return shared / (total[:, None] + total[None, :] - shared)


def spanning(links: np.ndarray, nodes: np.ndarray) -> list[int]:
    """Positions of those links (pairs of positions in nodes) that join parts not joined before."""
    names, at = np.unique(nodes, return_inverse=True)
    up = list(range(len(names)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k, (i, j) in enumerate(links.tolist()):
        a, b = top(int(at[i])), top(int(at[j]))
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append(k)
    return out


def _compared(opened: DataFrame, texts: DataFrame, logs, s: Sampling) -> DataFrame:
    """Links (doc, rep) that join components within the opened buckets."""
    needed = opened.select(F.col("doc").alias("node")).distinct()
    elements = saved(_elements(texts.join(needed, "node", "left_semi"), s))
    sized = opened.join(elements.select(F.col("node").alias("doc"), "size"), "doc")
    parts = F.greatest(F.ceil(F.sum("size") / s.block_elements), F.ceil(F.count("*") / s.block_members)).cast("int").alias("parts")
    blocks = opened.join(sized.groupBy("key").agg(parts), "key").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    dealt = blocks.select("key", "doc", "component", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", "doc", "component", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    dealt = dealt.join(elements.select(F.col("node").alias("doc"), "elements"), "doc")

    def compare(key, rows):
        docs, groups = np.asarray(rows.column("doc")), np.asarray(rows.column("component"))
        found = np.zeros((0, 2), np.int64)
        if len(set(groups.tolist())) > 1:
            near = similarities([np.frombuffer(x, np.uint64) for x in rows.column("elements").to_pylist()], logs.value) >= s.threshold - 1e-12
            near &= groups[:, None] != groups[None, :]
            found = np.argwhere(np.triu(near, 1))
            found = docs[found[spanning(found, groups)]]
        return pa.table({"doc": pa.array(found.max(axis=1), pa.int64()), "rep": pa.array(found.min(axis=1), pa.int64())})

    return dealt.groupBy("key", "one", "two").applyInArrow(compare, "doc long, rep long").distinct()


def near_duplicate_classes(docs: DataFrame, s: Sampling = Sampling()) -> DataFrame:
    """doc_id and class_id of every row."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be a whole number, not {kind.simpleString()}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    df, n = frequencies(docs, s.size)
    logs = spark.sparkContext.broadcast(log_idf(df, n, s))
    signed = saved(_signed(docs, logs, s))
    known = signed.where("doc_id IS NOT NULL AND keys IS NOT NULL")
    # One node for equal texts: the smallest document that has the text.
    firsts = saved(known.groupBy("digest").agg(F.min("doc_id").alias("node")))
    nodes = known.join(firsts.select(F.col("digest").alias("d"), "node"), (F.col("doc_id") == F.col("node")) & (F.col("digest") == F.col("d")), "left_semi")
    members = nodes.select(F.explode("keys").alias("key"), F.col("doc_id").alias("doc")).distinct()
    buckets = members.groupBy("key").agg(F.min("doc").alias("rep"), F.max("doc").alias("most")).where("rep < most").drop("most")
    members = saved(members.join(buckets, "key"))
    # Only documents that share a bucket are looked at again; the others' texts move once at most.
    sharing = members.select("doc").distinct()
    texts, path = stored(docs.join(sharing, F.col("doc_id") == F.col("doc"), "left_semi").select(F.col("doc_id").alias("node"), filled_text().alias("text")))
    released(spark)

    tried = saved(members.where("doc > rep").groupBy("doc").agg(F.min("rep").alias("rep")))
    sure = saved(_verified(tried, texts, logs, s))
    released(spark)
    opened = saved(_open_buckets(members, tried, components(sure)))
    released(spark)
    more = saved(_compared(opened, texts, logs, s))
    removed(spark, path)
    released(spark)
    classes = components(sure.unionByName(more))

    named = firsts.join(classes, "node", "left").select(F.col("digest").alias("d"), F.coalesce("component", "node").alias("class"))
    by_row = signed.join(named, (F.col("digest") == F.col("d")) & F.col("keys").isNotNull() & F.col("doc_id").isNotNull(), "left")
    return by_row.select("doc_id", F.coalesce("class", "doc_id").alias("class_id"))


def representatives(docs: DataFrame, s: Sampling = Sampling()) -> DataFrame:
    """The rows of docs whose document is the smallest of its class, and all rows without an id."""
    gone, = private(docs, "gone")
    lost = near_duplicate_classes(docs, s).groupBy("doc_id").agg(F.min("class_id").alias("c")).where("doc_id <> c")
    return docs.join(saved(lost.select(F.col("doc_id").alias(gone))), F.col("doc_id") == F.col(gone), "left_anti")
