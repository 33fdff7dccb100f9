"""Substring dedup by content-defined chunking.

A gear hash rolls over a text's bytes, in which every run of white space counts as
one space, so passages that were wrapped anew still meet: h = 2 h + G[byte], of
which the top bits of a 16-bit word are looked at, so only the last 16 bytes matter
and all positions are computed at once by doubling. A chunk ends where those bits
are zero, not before ``least`` and not after ``most`` bytes, and never inside a
character. As cuts depend on nearby bytes only, an insertion changes the chunks
around it and no others. Chunks are deduplicated by a 128-bit digest: a chunk is repeated if two
documents hold it, and its first holder is the smallest of them.

Neighbouring repeated chunks make a run. The report lists runs of at least
``least_words`` words; single short chunks that documents share by chance, or a
shared heading, stay out. A run is listed in parts where some of its chunks have the
document itself as first holder and others don't, so what a part says holds for all of
it. A repeated passage loses up to a chunk at either end.

Digests are counted by partial aggregation. Those that hold more than 1 / (4 x
partitions) of all repeated chunks, fewer than four times the partitions, are hot: they
travel to the tasks that cut the chunks, and their chunks are dealt on by place
instead of digest. The others are joined back by digest. So a passage in a third of
all documents gathers nowhere.

Defined results: null text is empty and has no chunks. Rows without an id take no
part. Rows that repeat an id are one document: what only they share is not
repeated. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import filled_text, parallelism, private, saved

_GEAR = np.random.default_rng(16).integers(0, 1 << 16, 256, dtype=np.uint16)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Chunking:
    least: int = 16  #: bytes
    bits: int = 4  #: a cut is expected every 2^bits bytes after least
    most: int = 128
    least_words: int = 20  #: of a reported run


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash at every byte: the sum of G[data[i - j]] << j."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        moved = h[:-step] << np.uint16(step)
        h = h.copy()
        h[step:] += moved
    return h


def squeezed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes with one space for every run of white space, and how many code points of the original end at or before each."""
    blank = _BLANK[data]
    keep = ~blank
    keep[:1] = True
    keep[1:] |= ~blank[:-1]
    return np.where(blank, np.uint8(32), data)[keep], np.cumsum((data & 0xC0) != 0x80)[keep]


def chunk_ends(data: np.ndarray, c: Chunking) -> list[int]:
    """Where the chunks of UTF-8 bytes end."""
    n = len(data)
    if not n:
        return []
    starts = np.r_[(data[1:] & 0xC0) != 0x80, True]  # whether a character starts after the byte
    h = np.where(starts, gear_hashes(data), np.uint16(0xFFFF))
    cuts = np.flatnonzero((h >> np.uint16(16 - c.bits) == 0) & starts) + 1
    ends, at, k, m = [], 0, 0, len(cuts)
    cuts = cuts.tolist()
    while at < n:
        while k < m and cuts[k] < at + c.least:
            k += 1
        end = cuts[k] if k < m else n
        if end > at + c.most:
            # No cut in reach, as in periodic text: the last of the least hashes there, which moves with the content.
            reach = h[at + c.least - 1 : at + c.most]
            end = at + c.most - int(reach[::-1].argmin())
            while not starts[end - 1]:
                end += 1
        ends.append(end)
        at = end
    return ends


def chunks(docs: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """One row per chunk: doc_id, start and size in code points, words that begin in it, digest as hi and lo. Chunks tile the text."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", filled_text().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "size", "words", "hi", "lo"]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def run(batches):
        import xxhash

        for b in batches:
            of, columns, size = [], [[] for _ in kinds], 0
            for row, t in enumerate(b.column("text")):
                raw = t.as_buffer()
                data, place = squeezed(np.frombuffer(raw if raw is not None else b"", np.uint8))
                ends = chunk_ends(data, c)
                if not ends:
                    continue
                e, raw = np.array(ends), data.tobytes()
                points = place[e - 1]
                blank = data == 32
                words = np.cumsum(~blank & np.r_[True, blank[:-1]])[e - 1]
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)), "<i8").reshape(-1, 2)
                of.append(np.full(len(e), row))
                for into, x in zip(columns, (np.r_[0, points[:-1]], np.diff(points, prepend=0), np.diff(words, prepend=0), digests[:, 0], digests[:, 1]), strict=True):
                    into.append(x)
                size += len(e)
                if size > 100_000:
                    yield batch(b, of, columns)
                    of, columns, size = [], [[] for _ in kinds], 0
            if size:
                yield batch(b, of, columns)

    def batch(b, of, columns):
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(np.concatenate(of))), *(pa.array(np.concatenate(x), k) for x, k in zip(columns, kinds, strict=True))], names)

    return rows.mapInArrow(run, f"doc_id {id_type}, start int, size int, words int, hi long, lo long")


def repeated_chunks(docs: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """The chunks that at least two documents hold, with the smallest of those as first."""
    every = chunks(docs, c)
    held = every.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    held = saved(held.where("first <> last").select(F.col("hi").alias("h"), F.col("lo").alias("l"), "first", "n"))
    most = (held.agg(F.sum("n")).first()[0] or 0) / (4 * parallelism(docs.sparkSession))
    hot = F.broadcast(held.where(F.col("n") > most).select(F.col("h").alias("hi"), F.col("l").alias("lo"), F.col("first").alias("hot_first")))
    dealt = every.join(hot, ["hi", "lo"], "left")
    dealt = dealt.withColumn("by", F.when(F.col("hot_first").isNotNull(), F.xxhash64("doc_id", "start")).otherwise(F.col("hi")))
    joined = dealt.join(held.where(F.col("n") <= most).drop("n"), (F.col("by") == F.col("h")) & (F.col("lo") == F.col("l")), "left")
    return joined.select("doc_id", "start", "size", "words", F.coalesce("hot_first", "first").alias("first")).where("first IS NOT NULL")


def runs_of(parts: list[dict], doc_id, least_words: int) -> list[list]:
    """[start, stop, n_chunks, n_words, first] of the listed parts of runs, from a document's repeated chunks in order."""
    out, run = [], []
    for p in [*parts, None]:
        if p is not None and run and p["start"] == run[-1]["start"] + run[-1]["size"]:
            run.append(p)
            continue
        if sum(x["words"] for x in run) >= least_words:
            for x in run:
                if out and out[-1][1] == x["start"] and (out[-1][4] == doc_id) == (x["first"] == doc_id):
                    out[-1][1:4] = x["start"] + x["size"], out[-1][2] + 1, out[-1][3] + x["words"]
                else:
                    out.append([x["start"], x["start"] + x["size"], 1, x["words"], x["first"]])
        run = [] if p is None else [p]
    return out


def repeated_runs(docs: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """Runs of repeated chunks: doc_id, start and stop in code points, n_chunks, n_words, first_doc_id.

    first_doc_id is the smallest document that holds the first chunk listed.
    """
    found = repeated_chunks(docs, c).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "size", "words", "first"))).alias("parts"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            of, rows = [], []
            for row, (doc_id, parts) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("parts"), strict=True)):
                found = runs_of(parts.as_py(), doc_id, c.least_words)
                of += [row] * len(found)
                rows += found
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), b.schema.field("doc_id").type)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of, pa.int64())), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", "start", "stop", "n_chunks", "n_words", "first_doc_id"])

    return found.mapInArrow(run, f"doc_id {id_type}, start int, stop int, n_chunks int, n_words int, first_doc_id {id_type}")


def without_repeated_runs(docs: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """docs with the reported runs cut out of text, but for the parts that the document holds first.

    Ids are taken to be unique here: rows that repeat an id are cut alike.
    """
    at, cuts = private(docs, "cut_id", "cuts")
    lost = repeated_runs(docs, c).where("first_doc_id <> doc_id").groupBy(F.col("doc_id").alias(at)).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(cuts))
    joined = docs.join(lost, F.col("doc_id") == F.col(at), "left").drop(at)

    def run(batches):
        for b in batches:
            k, out = b.schema.get_field_index("text"), []
            for t, spans in zip(b.column(k).to_pylist(), b.column(cuts).to_pylist(), strict=True):
                parts, done = [], 0
                for s in spans or ():
                    parts.append(t[done : s["start"]])
                    done = max(done, s["stop"])
                out.append("".join([*parts, t[done:]]) if parts else t)
            b = b.set_column(k, b.schema.field(k), pa.array(out, b.schema.field(k).type))
            yield b.select([x for x in b.schema.names if x != cuts])

    return joined.mapInArrow(run, docs.schema)
