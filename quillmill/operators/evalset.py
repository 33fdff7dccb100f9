"""Held-out evaluation sets: replayed splits, filters with counted reasons, samples and constraint probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import constants as K, text as T
from ..functions.columns import draw
from . import dataset
from .registers import reason


def replayed_split(chunks: DataFrame, briefs: DataFrame, cap: int = 200, val_share: float = 0.10, test_share: float = 0.10, seed: int = 42) -> DataFrame:
    """The split as the training set has it; by the same functions, so it can't drift."""
    joined = dataset.with_briefs(chunks, briefs)
    return dataset.stratified_split(dataset.capped(joined, cap, seed), val_share, test_share, seed)


def split_differences(replayed: DataFrame, stored: DataFrame, by: tuple[str, ...] = ("register",)) -> DataFrame:
    """(by, same) for every group: whether all three counts agree."""
    a, b = dataset.split_histogram(replayed, by), dataset.split_histogram(stored, by)
    names = list(dataset.SPLIT_NAMES)
    both = a.join(b.select(*by, *(F.col(n).alias(f"stored_{n}") for n in names)), list(by), "full")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"stored_{n}"))
    return both.withColumn("same", same)


def test_briefs(briefs: DataFrame, split: DataFrame, keys=dataset.KEY) -> DataFrame:
    return briefs.join(split.where(F.col("split") == dataset.TEST).select(*keys), list(keys))


def judged_briefs(briefs: DataFrame, least: int = 10, most: int = 80) -> DataFrame:
    """briefs with reason: length before leakage, else kept."""
    return briefs.withColumn("reason", reason((~T.space_words(F.col("brief")).between(least, most), "length"), (T.is_leaked(F.col("brief")), "leakage"), otherwise="kept"))


def attrition(judged: DataFrame, by: str = "register") -> DataFrame:
    count = lambda r: F.count_if(F.col("reason") == r)
    return judged.groupBy(by).agg(F.count("*").alias("raw"), count("length").alias("dropped_length"), count("leakage").alias("dropped_leakage"), count("kept").alias("kept"))


def sampled(pool: DataFrame, k: int = 2, seed: int = 42, by: str = "register", keys=dataset.KEY) -> DataFrame:
    """k briefs of each register, or all if there are fewer, with ids of register and place; and a key that is unique."""
    w = Window.partitionBy(by).orderBy(draw(seed, *keys), *keys)
    out = pool.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return out.withColumns({"brief_id": F.format_string("%s-%03d", F.col(by), F.col("chunk_idx")), "brief_key": F.concat_ws("/", by, *keys)})


def constraints(spark: SparkSession, rows=K.CONSTRAINTS) -> DataFrame:
    return spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows, 1)], "place int, constraint_id string, constraint_text string")


def instruction_probe(pool: DataFrame, constraints_: DataFrame, seed: int = 43, keys=dataset.KEY) -> DataFrame:
    """One brief for each constraint, in drawn order, while there are any."""
    n = constraints_.count()  # a fixed handful
    first = pool.withColumn("__draw", draw(seed, *keys)).orderBy("__draw", *keys).limit(n)
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__draw", *keys))).drop("__draw")
    joined = placed.join(F.broadcast(constraints_), "place")
    return joined.withColumns({"brief_id": F.format_string("instr-%02d-%s", F.col("place") - 1, F.col("constraint_id")), "brief": F.concat_ws(" ", "brief", "constraint_text")})


def checks_constraint(text: str = "text", constraint_id: str = "constraint_id"):
    """Whether a generated text keeps the constraints that can be told from the text; null for the others."""
    t, c = F.col(text), F.col(constraint_id)
    return (
        F.when(c == "ends_question", T.stripped(t).endswith("?"))
        .when(c == "no_dialogue", ~T.has_speech(t))
        .when(c == "under_200_words", T.space_words(t) < 200)
        .when(c == "named_eleanor", t.rlike(r"\bEleanor\b"))
        .when(c == "first_person", t.rlike(r"\b(I|me|my|we)\b"))
        .when(c == "set_at_dawn", t.rlike(r"(?i)\b(dawn|daybreak|sunrise)\b"))
    )
