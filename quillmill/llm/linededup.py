"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

A line's key is the line without white space (space, tab to carriage return) at
both ends, A-Z in lower case. Keys of at least ``least`` code points that at least
two documents hold lose all their lines but those in the document with the
smallest id.

The index has four tables. ``postings`` is exact: which document holds which key
digest, in how many rows. ``counts`` is exact too: references, smallest and
largest document per key. ``filters`` has one cuckoo filter per shard of the key
space, over the keys in ``counts``, and ``docs`` the documents. Everything comes in by
``insert``: a batch first probes the filters, shard by shard; keys that no filter
knows are new for certain and are appended to ``counts`` as they are, and only the
others are joined with it. What a document is known to hold already is not counted
again, so inserting it twice changes nothing. When the keys outgrow their shards, all
filters are built anew over more shards, so a shard's size is bounded. Deleting
documents takes their postings out, recounts just the keys they held, and takes keys
that nobody holds any more out of the filters. So every verdict after a deletion is
that of an index which never saw the deleted documents. The query inserts its table in
``batches`` parts.

A key held by a third of all documents is counted by partial aggregation, and the
join of postings with the repeated keys is one that adaptive execution splits.

Defined results: null or empty text is one empty line. Rows without a document id
belong to no document: they keep all lines and hold no key. Rows that repeat an id
are parts of one document. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import filled_text, private, saved
from .cuckoo import CuckooFilter, Full, built

LEAST = 10
_KEYS_PER_SHARD = 16_384
_MIN_SHARDS = 64
#: Inserted batches that postings may consist of before they are written as one table.
_MOST_PARTS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\x0c\r"


@dataclass
class LineIndex:
    postings: DataFrame  #: key binary, doc_id, refs long
    counts: DataFrame  #: key binary, refs long, first, last (of doc_id's type)
    filters: DataFrame  #: shard int, filter binary
    docs: DataFrame  #: doc_id
    shards: int
    least: int = LEAST
    parts: int = 1


def _keys(text: Column, least: int) -> Column:
    """Digests of a text's distinct keys of sufficient length."""
    key = lambda line: F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)
    long_enough = F.filter(F.array_distinct(F.transform(F.split(text, "\n"), key)), lambda k: F.length(k) >= least)
    return F.transform(long_enough, lambda k: F.unhex(F.md5(k.cast("binary"))))


def line_postings(docs: DataFrame, least: int = LEAST) -> DataFrame:
    held = docs.where("doc_id IS NOT NULL").select(F.explode(_keys(filled_text(), least)).alias("key"), "doc_id")
    return held.withColumn("refs", F.lit(1).cast("long"))


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("key").agg(F.sum("refs").alias("refs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _numbers(keys) -> np.ndarray:
    """64 bits of every key digest."""
    return np.frombuffer(b"".join(keys.to_pylist()), "<i8")[::2]


def _build_filters(counts: DataFrame, shards: int) -> DataFrame:
    def build(key, rows):
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([built(_numbers(rows.column("key"))).to_bytes()], pa.binary())})

    return counts.select("key", _shard(shards).alias("shard")).groupBy("shard").applyInArrow(build, "shard int, filter binary")


def _shards(keys: int) -> int:
    return max(_MIN_SHARDS, -(-keys // _KEYS_PER_SHARD))


def empty_index(docs: DataFrame, least: int = LEAST) -> LineIndex:
    """An index without documents, for ids like those of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    none = lambda columns: docs.sparkSession.createDataFrame([], columns)
    return LineIndex(none(f"key binary, doc_id {kind}, refs long"), none(f"key binary, refs long, first {kind}, last {kind}"), none("shard int, filter binary"), none(f"doc_id {kind}"), 0, least, 0)


def new_index(docs: DataFrame, least: int = LEAST, batches: int = 1) -> LineIndex:
    """An index of docs alone, inserted in batches that a hash of the id picks."""
    index = empty_index(docs, least)
    for k in range(batches):
        part = docs if batches == 1 else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k)
        index = insert(index, part)
    return index


def _updated_filters(index: LineIndex, changed: DataFrame, counts: DataFrame, insert: bool) -> DataFrame:
    """Filters after all keys of changed came or went; a full one is rebuilt from the exact counts of its shard."""

    def update(key, left, right):
        keys = _numbers(left.column("key"))
        old = right.column("filter").to_pylist()
        f = CuckooFilter.from_bytes(old[0]) if old else CuckooFilter.sized(len(keys))
        try:
            (f.insert if insert else f.delete)(keys)
            blob = f.to_bytes()
        except Full:
            blob = None
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([blob], pa.binary())})

    pairs = changed.select("key", _shard(index.shards).alias("shard")).groupBy("shard").cogroup(index.filters.groupBy("shard"))
    new = saved(pairs.applyInArrow(update, "shard int, filter binary"))
    full = new.where("filter IS NULL").select(F.col("shard").alias("full"))
    again = _build_filters(counts.join(full, _shard(index.shards) == F.col("full"), "left_semi"), index.shards)
    return new.where("filter IS NOT NULL").unionByName(again)


def _probed(fresh: DataFrame, index: LineIndex) -> DataFrame:
    """fresh with maybe: whether the shard's filter knows the key."""

    def probe(key, left, right):
        old = right.column("filter").to_pylist()
        hit = CuckooFilter.from_bytes(old[0]).contains(_numbers(left.column("key"))) if old else np.zeros(left.num_rows, bool)
        return left.drop_columns(["shard"]).append_column("maybe", pa.array(hit))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fresh.schema)
    pairs = fresh.withColumn("shard", _shard(index.shards)).groupBy("shard").cogroup(index.filters.groupBy("shard"))
    return pairs.applyInArrow(probe, f"{kinds}, maybe boolean")


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with the documents of docs added."""
    batch, ids = line_postings(docs, index.least), docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    if not index.shards:
        postings = saved(batch)
        counts = saved(_counted(postings))
        shards = _shards(counts.count())
        return LineIndex(postings, counts, saved(_build_filters(counts, shards)), saved(ids), shards, index.least)
    again = saved(index.docs.join(ids, "doc_id", "left_semi"))
    if not again.isEmpty():
        held = index.postings.join(again, "doc_id", "left_semi").select("key", "doc_id")
        batch = batch.join(held, ["key", "doc_id"], "left_anti")
    batch = saved(batch)
    probed = saved(_probed(_counted(batch), index))
    unseen = probed.where("NOT maybe").drop("maybe")
    maybe = probed.where("maybe").drop("maybe")
    # Only keys that a filter knows meet the exact table.
    touched = saved(index.counts.join(maybe.select("key"), "key", "left_semi"))
    merged = maybe.unionByName(touched).groupBy("key").agg(F.sum("refs").alias("refs"), F.min("first").alias("first"), F.max("last").alias("last"))
    counts = saved(index.counts.join(touched.select("key"), "key", "left_anti").unionByName(unseen).unionByName(merged))
    shards = _shards(counts.count())
    if shards > 2 * index.shards:
        filters = _build_filters(counts, shards)
    else:
        shards = index.shards
        filters = _updated_filters(index, unseen.unionByName(maybe.join(touched.select("key"), "key", "left_anti")), counts, True)
    postings, parts = index.postings.unionByName(batch), index.parts + 1
    if parts > _MOST_PARTS:
        postings, parts = saved(postings), 1
    return LineIndex(postings, counts, saved(filters), saved(index.docs.unionByName(ids).distinct()), shards, index.least, parts)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents whose ids are in the column doc_id."""
    ids = doc_ids.select("doc_id").distinct()
    postings = saved(index.postings.join(ids, "doc_id", "left_anti").select("key", "doc_id", "refs"))
    touched = saved(index.postings.join(ids, "doc_id", "left_semi").select("key").distinct())
    recount = _counted(postings.join(touched, "key", "left_semi"))
    counts = saved(index.counts.join(touched, "key", "left_anti").unionByName(recount))
    gone = touched.join(counts.select("key"), "key", "left_anti")
    return LineIndex(postings, counts, saved(_updated_filters(index, gone, counts, False)), saved(index.docs.join(ids, "doc_id", "left_anti")), index.shards, index.least)


def drops(index: LineIndex) -> DataFrame:
    """(doc_id, keys): the key digests whose lines a document loses."""
    repeated = index.counts.where("first <> last").select("key", "first")
    lost = index.postings.join(repeated, "key").where(F.col("doc_id") != F.col("first"))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _cut(text: str, lost: set[bytes]) -> tuple[int, int, str]:
    lines = text.split("\n")
    if not lost:
        return len(lines), 0, text
    # bytes.strip and bytes.lower are the key's white space and A-Z.
    kept = [x for x in lines if hashlib.md5(x.encode().strip().lower()).digest() not in lost]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def _with_drops(docs: DataFrame, index: LineIndex) -> tuple[DataFrame, str]:
    at, keys = private(docs, "drop_id", "drop_keys")
    lost = drops(index).select(F.col("doc_id").alias(at), F.col("keys").alias(keys))
    return docs.join(lost, F.col("doc_id") == F.col(at), "left").drop(at), keys


def line_report(docs: DataFrame, index: LineIndex) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the kept text."""
    joined, keys = _with_drops(docs.select("doc_id", filled_text().alias("text")), index)
    id_type = joined.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [_cut(t.as_py(), set(k.as_py() or ())) for t, k in zip(b.column("text"), b.column(keys), strict=True)]
            n, d, kept = zip(*rows, strict=True) if rows else ((), (), ())
            digests = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d, pa.int64()), digests], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(run, f"doc_id {id_type}, n_lines long, n_dropped long, kept_sha256 string")


def without_repeats(docs: DataFrame, index: LineIndex, drop_emptied: bool = False) -> DataFrame:
    """docs with the repeated lines cut out of text; n_chars, if there, follows. Null texts stay null.

    drop_emptied takes out the rows that lost lines and have nothing but white space left.
    """
    joined, keys = _with_drops(docs, index)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            cuts = [None if (s := t.as_py()) is None else _cut(s, set(k.as_py() or ())) for t, k in zip(b.column("text"), b.column(keys), strict=True)]
            b = b.set_column(at, b.schema.field(at), pa.array([c and c[2] for c in cuts], b.schema.field(at).type))
            if drop_emptied:
                b = b.filter(pa.array([c is None or not c[1] or bool(c[2].strip()) for c in cuts], pa.bool_()))
            yield b.select([c for c in b.schema.names if c != keys])

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_report(docs: DataFrame, least: int = LEAST, batches: int = 2) -> DataFrame:
    """line_report of a new index of docs, to which they came in batches."""
    return line_report(docs, new_index(docs, least, batches))
