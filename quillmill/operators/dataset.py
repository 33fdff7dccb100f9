"""Training sets: chunks joined with briefs, capped, split, packed and labelled.

Sampling orders by a digest of the seed and the row's key instead of a random
generator's sequence: every engine draws the same rows, and in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.columns import draw, with_drawn_rank

TRAIN, VAL, TEST = 0, 1, 2
SPLIT_NAMES = {"train": TRAIN, "val": VAL, "test": TEST}
KEY = ("path", "chunk_idx")


def last_briefs(briefs: DataFrame, order: str = "line", keys=KEY) -> DataFrame:
    """One brief per key: the one that comes last."""
    rest = [c for c in briefs.columns if c not in (*keys, order)]
    last = briefs.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x"))
    return last.select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))


def with_briefs(chunks: DataFrame, briefs: DataFrame, keys=KEY) -> DataFrame:
    """Chunks that have a brief that isn't empty."""
    return chunks.join(briefs.where(F.col("brief") != ""), list(keys))


def without_briefs(chunks: DataFrame, briefs: DataFrame, keys=KEY) -> DataFrame:
    """The chunks that with_briefs drops; also those a resumed run has still to do."""
    return chunks.join(briefs.where(F.col("brief") != ""), list(keys), "left_anti")


def capped(rows: DataFrame, cap: int, seed: int = 42, author: str = "author", keys=KEY) -> DataFrame:
    """At most cap rows of each author; all if cap isn't positive. The cap is the operator: a sample per author."""
    if cap <= 0:
        return rows
    w = Window.partitionBy(author).orderBy(draw(seed, *keys), *keys)
    return rows.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= cap).drop("__at")


def held_size(n: Column, share: float) -> Column:
    """Rows of a group of n for validation or test: none below 10, else the rounded share, half to even, and at least 1."""
    return F.when(n < 10, 0).otherwise(F.greatest(F.rint(n * share), F.lit(1.0))).cast("long")


def stratified_split(rows: DataFrame, val_share: float = 0.10, test_share: float = 0.10, seed: int = 42, author: str = "author", keys=KEY) -> DataFrame:
    """rows with split: per author, in drawn order, first the test rows, then validation, then training."""
    df = with_drawn_rank(rows, draw(seed + 1, *keys), (author,), tuple(keys), "__at", "__n")
    test, val = held_size(F.col("__n"), test_share), held_size(F.col("__n"), val_share)
    split = F.when(F.col("__at") <= test, TEST).when(F.col("__at") <= test + val, VAL).otherwise(TRAIN)
    return df.withColumn("split", split.cast("tinyint")).drop("__at", "__n")


def author_vocabulary(rows: DataFrame, author: str = "author", first: str = "first_seen") -> DataFrame:
    """(author, author_id): by falling number of rows, then by first appearance."""
    n = rows.groupBy(author).agg(F.count("*").alias("n"), F.min(first).alias("f"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "f", author)  # a row per author
    ids = n.select(author, (F.row_number().over(w) - 1).alias("author_id"))
    checked = F.assert_true(F.col("author_id") <= 127, F.lit("more than 128 authors don't fit the id's type"))
    return ids.where(checked.isNull()).withColumn("author_id", F.col("author_id").cast("tinyint"))


def split_tally(rows: DataFrame, author: str = "author", tokens: str = "n_tokens") -> DataFrame:
    """train, val, test, total and tokens of each author, and of all (author is TOTAL)."""
    part = lambda k: F.count_if(F.col("split") == k)
    out = rows.rollup(author).agg(part(TRAIN).alias("train"), part(VAL).alias("val"), part(TEST).alias("test"), F.count("*").alias("total"), F.sum(tokens).alias("tokens"), F.grouping(author).alias("g"))
    return out.withColumn(author, F.when(F.col("g") == 1, F.lit("TOTAL")).otherwise(F.col(author))).drop("g")


def split_histogram(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.count_if(F.col("split") == k).alias(name) for name, k in SPLIT_NAMES.items()))


def packed_rows(rows: DataFrame, prompt_ids: str = "prompt_ids", chunk_ids: str = "chunk_ids", length: int = 2048, eos: int = 2) -> DataFrame:
    """rows with input_ids and attention_mask of the length, prompt_length, n_tokens and whether the end was cut.

    Prompt and chunk are followed by one end token, cut so that it is the last, and
    padded with it.
    """
    ids = F.concat(prompt_ids, chunk_ids)
    ended = F.when(F.try_element_at(ids, F.lit(-1)) == eos, ids).otherwise(F.array_append(ids, F.lit(eos)))
    df = rows.withColumn("__ids", ended)
    cut = F.size("__ids") > length
    df = df.withColumn("was_cut", cut).withColumn("__ids", F.when(cut, F.array_append(F.slice("__ids", 1, length - 1), F.lit(eos))).otherwise(F.col("__ids")))
    n = F.size("__ids")
    return df.withColumns(
        {
            "input_ids": F.concat("__ids", F.array_repeat(F.lit(eos), F.lit(length) - n)),
            "attention_mask": F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n)).cast("array<tinyint>"),
            "prompt_length": F.least(F.size(prompt_ids), F.lit(length)).cast("smallint"),
            "n_tokens": n.cast("smallint"),
        }
    ).drop("__ids")


def with_labels(rows: DataFrame, ignore: int = -100) -> DataFrame:
    """rows with labels: input_ids, but ignore in the prompt and where the mask is 0."""
    pairs = F.zip_with("input_ids", "attention_mask", lambda i, m: F.struct(i.alias("i"), m.alias("m")))
    return rows.withColumn("labels", F.transform(pairs, lambda x, at: F.when((x["m"] == 0) | (at < F.col("prompt_length")), ignore).otherwise(x["i"]).cast("long")))


def training_split(rows: DataFrame, name: str) -> DataFrame:
    """One split of a stored set, pruned by its partition column."""
    return rows.where(F.col("split") == SPLIT_NAMES[name])


def with_prompts(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """rows with the prompt of their register and brief."""
    return rows.join(F.broadcast(dimension.select(F.col("name").alias("register"), "display")), "register").withColumn("prompt", T.prompt(F.col("display"), F.col("brief"))).drop("display")
