"""The register dimension, axis quartiles and the separation verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import constants as K

SCHEMA = "name string, display string, authors array<string>, style_hint string"


def registers(spark: SparkSession, rows=K.REGISTERS) -> DataFrame:
    return spark.createDataFrame([(n, d, list(a), h) for n, d, a, h in rows], SCHEMA)


def author_dimension(dimension: DataFrame) -> DataFrame:
    """(author, register), a row per author of each register; small by nature."""
    return dimension.select(F.explode("authors").alias("author"), F.col("name").alias("register"))


def known(dimension: DataFrame, name: str) -> DataFrame:
    """The register of that name; fails on use if there is none."""
    found = dimension.where(F.col("name") == name)
    guard = dimension.groupBy().agg(F.max(F.col("name") == name).alias("ok")).select(F.assert_true(F.coalesce("ok", F.lit(False)), F.lit(f"unknown register {name!r}")).alias("checked"))
    return found.join(F.broadcast(guard), F.col("checked").isNull()).drop("checked")


def of_register(records: DataFrame, dimension: DataFrame, name: str | None = None) -> DataFrame:
    """Records by authors of the register, or of any."""
    authors = author_dimension(dimension)
    authors = authors if name is None else authors.where(F.col("register") == name)
    return records.join(F.broadcast(authors.select("author").distinct()), "author", "left_semi")


def quartiles(values: Column) -> dict[str, Column]:
    """Elements at a quarter, half and three quarters of the length of a sorted array; zeros if it is empty."""
    s, n = F.sort_array(values), F.size(values)
    at = lambda num, den: F.when(n == 0, 0.0).otherwise(F.element_at(s, F.floor(n * num / den).cast("int") + 1))
    return {"q1": at(1, 4), "median": at(1, 2), "q3": at(3, 4)}


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Whether two closed intervals meet."""
    return ~((a_hi < b_lo) | (b_hi < a_lo))


def axis_quartiles(profile: DataFrame, dimension: DataFrame, axes=K.AXES) -> DataFrame:
    """(register, axis, n, q1, median, q3) over the register's authors that have a profile. A group holds a value per author."""
    members = profile.join(F.broadcast(author_dimension(dimension)), "author")
    long = members.select("register", F.inline(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("value")) for a in axes)))).where("value IS NOT NULL")
    groups = long.groupBy("register", "axis").agg(F.count("*").alias("n"), F.collect_list("value").alias("values"))
    return groups.select("register", "axis", "n", *(q.alias(k) for k, q in quartiles(F.col("values")).items()))


def separation(quartiles_: DataFrame) -> DataFrame:
    """(register, n_strong, n_extreme, strong, extreme, valid).

    An axis separates a register strongly if its interquartile range meets no
    other register's, and extremely if its median is the least or the largest.
    """
    by_axis = Window.partitionBy("axis")  # a row per register
    every = F.collect_list(F.struct("register", "q1", "q3")).over(by_axis)
    meets = F.exists("every", lambda o: (o["register"] != F.col("register")) & overlaps(F.col("q1"), F.col("q3"), o["q1"], o["q3"]))
    extreme = (F.col("median") == F.min("median").over(by_axis)) | (F.col("median") == F.max("median").over(by_axis))
    named = quartiles_.withColumns({"every": every, "is_extreme": extreme}).withColumn("is_strong", ~meets)
    lists = {k: F.sort_array(F.collect_list(F.when(F.col(f"is_{k}"), F.col("axis")))) for k in ("strong", "extreme")}
    out = named.groupBy("register").agg(*(v.alias(k) for k, v in lists.items())).select("register", *(F.size(k).alias(f"n_{k}") for k in lists), *lists)
    return out.withColumn("valid", (F.col("n_strong") >= 1) | (F.col("n_extreme") >= 2))


def reason(*cases: tuple[Column, str], otherwise: str) -> Column:
    """The first case that holds."""
    return F.coalesce(reduce(lambda acc, c: F.coalesce(acc, F.when(c[0], c[1])), cases, F.lit(None).cast("string")), F.lit(otherwise))
