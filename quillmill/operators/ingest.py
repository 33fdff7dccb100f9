"""Ingest: catalog matching, work dedup, boilerplate, chapters, the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as K, text as T
from ..functions.columns import once


def catalog_works(catalog: DataFrame) -> DataFrame:
    """English texts with an id, with a clean title and slugs. Several languages in one field don't count as English."""
    rows = catalog.where((F.col("Type") == "Text") & (F.col("Language") == "en") & (F.coalesce("Text#", F.lit("")) != ""))
    title = T.first_line(F.coalesce("Title", F.lit("untitled")))
    work = F.left(T.slug(title), F.lit(60))
    return rows.withColumns({"work_title": title, "pg_id": F.col("Text#")}).withColumn("work_slug", F.when(work == "", F.concat(F.lit("pg-"), F.col("pg_id"))).otherwise(work))


def author_works(catalog: DataFrame, authors: DataFrame, authors_field: str = "Authors") -> DataFrame:
    """Rows of catalog once for each author whose name, in any 'Last, First' form, is in the authors field.

    Case and accents don't count. The names travel as one array and are tried on
    each row, so no join is needed; authors is a dimension of a few names.
    """
    needles = authors.select("author", F.explode(T.name_forms(F.col("author"))).alias("needle")).select("author", T.unaccented(F.col("needle")).alias("needle"))
    every = needles.agg(F.collect_set(F.struct("author", "needle")).alias("every"))
    rows = catalog.withColumns({"__field": T.unaccented(F.coalesce(authors_field, F.lit(""))), "__every": every.scalar()})
    found = F.array_distinct(F.transform(F.filter("__every", lambda x: F.contains(F.col("__field"), x["needle"])), lambda x: x["author"]))
    return rows.select(*(F.col(f"`{c}`") for c in catalog.columns), F.explode(found).alias("author"))


def first_works(works: DataFrame, most: int, position: str = "position") -> DataFrame:
    """Each author's first works in catalog order; the limit is the operator."""
    w = Window.partitionBy("author").orderBy(position)
    return works.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= most).drop("__at")


def new_works(works: DataFrame, seen: DataFrame | None = None, position: str = "position") -> DataFrame:
    """One work per (author_slug, work_slug), the first, without those already in seen."""
    keyed = works.withColumn("author_slug", T.slug(F.col("author")))
    w = Window.partitionBy("author_slug", "work_slug").orderBy(position)
    once_each = keyed.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")
    return once_each if seen is None else once_each.join(seen.select("author_slug", "work_slug").distinct(), ["author_slug", "work_slug"], "left_anti")


def is_fetched_text(text: Column) -> Column:
    """Whether a downloaded body is what was asked for."""
    return F.coalesce((text != "") & F.contains(F.left(text, F.lit(8000)), F.lit(K.MARKER_NAME)), F.lit(False))


def chapters(works: DataFrame, text: str = "text", least_words: int = 100, least_whole: int = 500) -> DataFrame:
    """works once for each chapter: chapter_num from 1 and body.

    With fewer than two headings the whole text is one chapter if it has more than
    least_whole words; else text before the first heading is dropped, and so are
    chapters of at most least_words words, before they are numbered.
    """
    df = once(works, __parts=F.split(F.coalesce(text, F.lit("")), f"(?Umd){K.CHAPTER_HEADING}"))
    whole = F.filter(F.array(T.stripped(F.coalesce(F.col(text), F.lit("")))), lambda b: T.space_words(b) > least_whole)
    cut = F.filter(F.transform(F.slice("__parts", 2, F.greatest(F.size("__parts") - 1, F.lit(0))), T.stripped), lambda b: T.space_words(b) > least_words)
    df = once(df, __bodies=F.when(F.size("__parts") < 3, whole).otherwise(cut))
    out = df.select("*", F.posexplode("__bodies").alias("__at", "body")).withColumn("chapter_num", F.col("__at") + 1)
    return out.drop("__parts", "__bodies", "__at", text)


def manifest(chapters_: DataFrame) -> DataFrame:
    """One row per chapter with path, words and chars."""
    path = F.format_string("source/%s/%s/chapter-%03d.txt", F.col("author_slug"), F.col("work_slug"), F.col("chapter_num"))
    return chapters_.select("author", "cluster", "work_title", "work_slug", "pg_id", "chapter_num", T.forward_slashes(path).alias("path"), T.space_words(F.col("body")).alias("words"), F.length("body").alias("chars"))


def extended_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and the rows of new whose path old doesn't have."""
    return old.unionByName(new.join(old.select("path"), "path", "left_anti").select(*old.columns))


def manifest_tally(manifest_: DataFrame, by: str = "cluster") -> DataFrame:
    """chapters and words per group, and of all (TOTAL)."""
    out = manifest_.rollup(by).agg(F.count("*").alias("chapters"), F.sum("words").alias("words"), F.grouping(by).alias("g"))
    return out.withColumn(by, F.when(F.col("g") == 1, F.lit("TOTAL")).otherwise(F.col(by))).drop("g")


def brief_sources(manifest_: DataFrame, cluster: str | None = None, cap: int = 50, seed: int = 42) -> DataFrame:
    """Prose chapters for briefs: at most cap of each author, ordered."""
    from .dataset import capped

    rows = manifest_ if cluster is None else manifest_.where(F.col("cluster") == cluster)
    rows = rows.where(~T.is_not_prose(F.coalesce("work_title", F.lit(""))))
    return capped(rows, cap, seed, "author", ("path",)).orderBy("author", "work_slug", "chapter_num")
