"""Small helpers on DataFrames and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each evaluated once a row.

    The generator keeps the optimizer from pasting an expression into every place
    that uses its column, which would split a text again for each of its words.
    """
    return df.select("*", F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def at_least_one(c: Column) -> Column:
    return F.greatest(c, F.lit(1))


def draw(seed: int, *key: str) -> Column:
    """A text to order by that stands for a random number: the same for a key on every run and in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)).cast("binary"))


def rounded(c: Column, places: int = 6) -> Column:
    """Sums of doubles depend on the order of addition; results that hold them are given to some places."""
    return F.round(c, places)


def with_drawn_rank(rows: DataFrame, draw_: Column, by: tuple[str, ...], keys: tuple[str, ...], at: str = "__at", of: str = "__of") -> DataFrame:
    """rows with their place in the drawn order of their group, from 1, and the group's size.

    A group isn't sorted by one task: the first two digits of the draw part it into
    256 bins, which are ranked apart and moved up by the rows in the bins before.
    """
    drawn = rows.withColumn("__draw", draw_).withColumn("__bin", F.substring("__draw", 1, 2))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    bins = drawn.groupBy(*by, "__bin").agg(F.count("*").alias("__in_bin"))
    bins = bins.withColumns({"__before": F.sum("__in_bin").over(group.orderBy("__bin")) - F.col("__in_bin"), of: F.sum("__in_bin").over(group)}).drop("__in_bin")
    ranked = drawn.withColumn("__inside", F.row_number().over(Window.partitionBy(*by, "__bin").orderBy("__draw", *keys)))
    other = bins.select(*(F.col(c).alias(f"__g_{c}") for c in by), F.col("__bin").alias("__b"), "__before", of)
    same = F.col("__bin") == F.col("__b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    return ranked.join(other, same).withColumn(at, F.col("__before") + F.col("__inside")).drop("__draw", "__bin", "__b", "__before", "__inside", *(f"__g_{c}" for c in by))
