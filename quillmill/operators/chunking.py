"""Greedy packing of paragraphs into chunks of bounded token length.

A chapter's chunks depend on the order of its paragraphs, so a chapter is packed by
one task, and chapters in parallel. ``chunk_documents`` takes any tokenizer;
``paragraph_chunks`` is the fold over the word tokenizer's counts in the JVM. Both
split paragraphs that are too long.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K, text as T, tokenizers
from ..functions.columns import once

PROMPT_BUDGET = 64
#: A Python worker gives its chunks away when they hold so many tokens.
BATCH_TOKENS = 1 << 18
_SENTENCE = re.compile(rf"(?<=[{K.SENTENCE_END}])\s+(?=[{K.SENTENCE_START}])")


def chunk_budget(seq_len: int = 2048) -> int:
    """Tokens of a chunk, with room for the prompt."""
    return seq_len - PROMPT_BUDGET


def _fitting(parts: list[tuple[int, str]], most: int) -> Iterator[list[tuple[int, str]]]:
    """Runs of (tokens, text) that add up to at most most each."""
    run, total = [], 0
    for n, part in parts:
        if run and total + n > most:
            yield run
            run, total = [], 0
        run.append((n, part))
        total += n
    if run:
        yield run


def split_paragraph(text: str, tokenizer: tokenizers.Tokenizer, most: int) -> list[list[int]]:
    """Ids of a paragraph that is too long, by whole sentences; a sentence that is too long itself is sliced."""
    counted = [(tokenizer.encode(s), s) for s in _SENTENCE.split(text)]
    counted = [(ids, s) for ids, s in counted if ids]
    out, at = [], 0
    while at < len(counted):
        ids, _ = counted[at]
        if len(ids) > most:
            out += [ids[k : k + most] for k in range(0, len(ids), most)]
            at += 1
            continue
        stop = next((k for k in range(at, len(counted)) if len(counted[k][0]) > most), len(counted))
        # The sentences are encoded anew together, so a piece may come out longer than their sum.
        out += [tokenizer.encode(" ".join(s for _, s in run)) for run in _fitting([(len(i), s) for i, s in counted[at:stop]], most)]
        at = stop
    return out


def chunk_text(text: str, tokenizer: tokenizers.Tokenizer, most: int, eos: int | None = None, between: str = K.CHUNK_PARAGRAPH) -> list[list[int]]:
    """Ids of the chunks of a chapter."""
    separator, chunks, open_ = tokenizer.encode("\n\n"), [], False
    for paragraph in filter(None, (p.strip() for p in re.split(between, text))):
        ids = tokenizer.encode(paragraph)
        if len(ids) > most:
            chunks += split_paragraph(paragraph, tokenizer, most)
            open_ = False
        elif open_ and chunks[-1] and len(chunks[-1]) + len(separator) + len(ids) <= most:
            chunks[-1] += separator + ids
        elif open_ and not chunks[-1]:
            chunks[-1] = list(ids)  # nothing before it: no separator
        else:
            chunks.append(list(ids))
            open_ = True
    if chunks and open_ and not chunks[-1]:
        chunks.pop()
    if eos is not None and chunks:
        chunks[-1] = [*chunks[-1][: most - 1], eos]
    return chunks


def chunk_batches(batches: Iterable[pa.RecordBatch], names: list[str], tokenizer: tokenizers.Tokenizer, most: int, eos: int | None, between: str, decode: bool) -> Iterator[pa.RecordBatch]:
    """Chunks of batches of ids and texts. A text at a time is held as Python objects, and finished chunks are given away by BATCH_TOKENS."""
    kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), *([pa.string()] if decode else []))

    def made(b, of, out):
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    for b in batches:
        of, out, held = [], [], 0
        for row, t in enumerate(b.column("text")):
            chunks = chunk_text(t.as_py(), tokenizer, most, eos, between)
            for k, ids in enumerate(chunks):
                of.append(row)
                out.append((k, len(ids), k == len(chunks) - 1, np.array(ids, np.int32), *([tokenizer.decode(ids)] if decode else [])))
                held += len(ids)
                if held >= BATCH_TOKENS:
                    yield made(b, of, out)
                    of, out, held = [], [], 0
        yield made(b, of, out)


def chunk_documents(docs: DataFrame, tokenizer: tokenizers.Tokenizer, most: int = chunk_budget(), eos: int | None = None, doc_id: str = "doc_id", text: str = "text", between: str = K.CHUNK_PARAGRAPH, decode: bool = False) -> DataFrame:
    """(doc_id, chunk_idx, n_tokens, is_chapter_end, input_ids) of every chunk, and its decoded text if asked for."""
    rows = docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = [doc_id, "chunk_idx", "n_tokens", "is_chapter_end", "input_ids", *(["text"] if decode else [])]
    kind = rows.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(lambda batches: chunk_batches(batches, names, tokenizer, most, eos, between, decode), f"{doc_id} {kind}, chunk_idx int, n_tokens int, is_chapter_end boolean, input_ids array<int>" + ", text string" * decode)


def packed_runs(lengths: Column, most: int, separator: int) -> Column:
    """The runs of elements that go together, as (start, n, used), from an array of token counts that are at most most; a negative count is an element of that many tokens that stays alone. One pass; the array of runs grows only where one ends."""
    runs = "array<struct<start:int,n:int,used:int>>"
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).alias("used"), F.array().cast(runs).alias("out"))

    def run(acc):
        return F.struct(acc["start"].alias("start"), acc["n"].alias("n"), F.abs(acc["used"]).alias("used"))

    def step(acc, tokens):
        fits = (acc["n"] > 0) & (acc["used"] > 0) & (tokens > 0) & (acc["used"] + separator + tokens <= most)
        first = acc["n"] == 0
        out = F.when(fits | first, acc["out"]).otherwise(F.array_append(acc["out"], run(acc)))
        start = F.when(fits | first, acc["start"]).otherwise(acc["start"] + acc["n"])
        return F.struct(start.alias("start"), F.when(fits, acc["n"] + 1).otherwise(1).alias("n"), F.when(fits, acc["used"] + separator + tokens).otherwise(tokens).alias("used"), out.alias("out"))

    return F.aggregate(lengths, zero, step, lambda acc: F.when(acc["n"] == 0, acc["out"]).otherwise(F.array_append(acc["out"], run(acc))))


def _counted(texts: Column) -> Column:
    return F.transform(texts, lambda p: F.struct(p.alias("p"), tokenizers.token_count(p).alias("n")))


def _pieces(paragraph: Column, most: int) -> Column:
    """split_paragraph by the word tokenizer, as (p, n) with n negative: no piece shares a chunk. Slices of a sentence are its tokens with spaces between."""
    sentences = F.filter(_counted(T.pieces_by_sentence(paragraph)), lambda s: s["n"] > 0)

    def slices(s):
        tokens = tokenizers.tokens(s["p"])
        starts = F.sequence(F.lit(1), s["n"], F.lit(most))
        return F.transform(starts, lambda k: F.struct(F.array_join(F.slice(tokens, k, most), " ").alias("p"), (-F.least(F.lit(most), s["n"] - k + 1)).alias("n")))

    parts = F.flatten(F.transform(sentences, lambda s: F.when(s["n"] > most, slices(s)).otherwise(F.array(s))))

    def joined(parts, runs):
        return F.transform(runs, lambda r: F.struct(F.array_join(F.transform(F.slice(parts, r["start"] + 1, r["n"]), lambda x: x["p"]), " ").alias("p"), (-r["used"]).alias("n")))

    # An array of one binds the parts, which would be worked out again for each run.
    return F.flatten(F.transform(F.array(parts), lambda ps: joined(ps, packed_runs(F.transform(ps, lambda x: x["n"]), most, 0))))


def paragraph_chunks(docs: DataFrame, most: int, separator: int = 1, between: str = K.CHUNK_PARAGRAPH, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, chunk_idx, n_paragraphs, n_tokens, is_chapter_end, text) and the columns of docs in keep, by the word tokenizer. Pieces of a paragraph longer than most are chunks of their own. No text is shuffled."""
    df = once(docs.select(doc_id, *keep, text).where(F.col(text).isNotNull()), paras=T.paragraphs(F.col(text), between)).drop(text)
    df = once(df, all=F.filter(_counted(F.col("paras")), lambda x: x["n"] >= 1)).drop("paras")
    df = once(df, counted=F.flatten(F.transform("all", lambda x: F.when(x["n"] > most, _pieces(x["p"], most)).otherwise(F.array(x))))).drop("all")
    df = once(df, runs=packed_runs(F.col("counted.n"), most, separator))
    rows = df.select(doc_id, *keep, "counted", F.size("runs").alias("n_chunks"), F.posexplode("runs").alias("chunk_idx", "run"))
    body = F.transform(F.slice("counted", F.col("run.start") + 1, F.col("run.n")), lambda x: x["p"])
    return rows.select(doc_id, "chunk_idx", F.col("run.n").cast("long").alias("n_paragraphs"), F.col("run.used").cast("long").alias("n_tokens"), (F.col("chunk_idx") == F.col("n_chunks") - 1).alias("is_chapter_end"), F.array_join(body, "\n\n").alias("text"), *keep)
