"""Best-fit packing planned over a histogram of lengths.

Documents are cut into pieces of at most ``capacity`` tokens (a longer one's
first piece takes the remainder). Packing then looks at counts only: best-fit
decreasing runs over the histogram of piece lengths, placing whole groups of
equal pieces into whole groups of equally filled sequences. The plan is a list
of slots ranges (length, ranks from-to, sequences from-to, offset); its size
depends on the capacity, not on the number of documents. Pieces find their slot
by joining on the rank within their length.

The rank needs no single ordering of all pieces of a length: pieces are dealt
into blocks by a hash, numbered inside (length, block), and shifted by the
pieces in the blocks before. Hot lengths thus spread over all blocks.

Defined results: null text is empty and packs as the end-of-text token alone;
repeated rows and null ids are documents of their own; an empty table gives no
rows. A sequence's offsets run gapless from 0 to its fill.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import parallelism, saved
from .vocabularies import library_encoder

CAPACITY = 1024
#: More slot ranges than this are joined by shuffle instead of broadcast, in so many shares of each length.
MOST_BROADCAST, SHARES = 200_000, 64


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    if n <= capacity:
        return [n]
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def with_added(encode: Callable[[str], list[int]], added: dict[str, int]) -> Callable[[str], list[int]]:
    """encode, but that texts are cut at added tokens, which stand for their own ids."""
    if not added:
        return encode
    found = re.compile("(" + "|".join(re.escape(a) for a in sorted(added, key=len, reverse=True)) + ")")

    def run(text: str) -> list[int]:
        ids: list[int] = []
        for part in found.split(text):
            if part in added:
                ids.append(added[part])
            elif part:
                ids += encode(part)
        return ids

    return run


def pieces(docs: DataFrame, encode_with: tuple[str, str], end_id: int, capacity: int = CAPACITY, added: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, key, piece, start, length, ids_crc32); key is a hash that tells rows apart."""
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode, end = with_added(library_encoder(*encode_with), added or {}), np.array([end_id], "<u4")
        for b in batches:
            of, out = [], []
            for row, t in enumerate(b.column("text")):
                t = t.as_py() or ""
                ids = np.concatenate([np.array(encode(t), "<u4"), end])
                start, key = 0, zlib.crc32(t.encode())
                for k, n in enumerate(piece_lengths(len(ids), capacity)):
                    of.append(row)
                    out.append((key, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
                    start += n
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of, pa.int64())), *(pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "key", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"doc_id {id_type}, key long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: slots (length, rank from, rank to, first sequence, offset), and the number of sequences.

    Rank r of a length lies in the slot with from <= r < to; its sequence is
    first + r - from.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # room left -> groups (first sequence, how many)
    rooms: list[int] = []
    made = 0

    def add(room: int, first: int, n: int) -> None:
        if room <= 0 or n <= 0:
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        heapq.heappush(open_[room], (first, n))

    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = heapq.heappop(open_[room])
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                m = min(n, left)
                slots.append((length, rank, rank + m, first, capacity - room))
                add(room, first + m, n - m)
                add(room - length, first, m)
                left, rank = left - m, rank + m
                continue
            # No open sequence has room: new ones take as many of this length as fit.
            each = capacity // length
            whole, rest = divmod(left, each)
            for n, k in ((whole, each), (1, rest)):
                if n and k:
                    for j in range(k):
                        slots.append((length, rank, rank + n, made, j * length))
                        rank += n
                    add(capacity - k * length, made, n)
                    made += n
            left = 0
    return slots, made


def _ranked(parts: DataFrame, blocks: int) -> DataFrame:
    """parts with the rank of each row within its length, from 0."""
    dealt = parts.withColumn("block", F.pmod(F.xxhash64("doc_id", "key", "piece"), F.lit(blocks)))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "key", "piece")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "block").agg(F.count("*").alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return dealt.withColumn("at", F.row_number().over(inside) - 1).join(counts, ["length", "block"]).withColumn("rank", F.col("shift") + F.col("at")).drop("block", "at", "shift")


def packed(parts: DataFrame, capacity: int = CAPACITY, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """parts with sequence_id and offset."""
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    slots, _ = plan(histogram, capacity)
    # Planned slots of a length follow each other in rank, so a piece has one slot.
    table = spark.createDataFrame(slots, "len long, lo long, hi long, first long, offset long")
    ranked = _ranked(parts, 4 * parallelism(spark))
    same = (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    if len(slots) <= most_broadcast:
        at = ranked.join(F.broadcast(table), same)
    else:
        table = table.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        at = ranked.join(table, same & (F.pmod("rank", F.lit(SHARES)) == F.col("share")))
    return at.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def best_fit_sequences(docs: DataFrame, encode_with: tuple[str, str], end_id: int = 2, capacity: int = CAPACITY, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece with its place. added are the tokens beyond the rank file. The pieces are saved once, so ranks, histogram and plan agree."""
    return packed(saved(pieces(docs, encode_with, end_id, capacity, added)), capacity)
