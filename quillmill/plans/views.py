"""The driver's tables in the roles of chapters, works, catalogs and briefs.

``documents`` are chapters, their ``source`` is the author, and the register of
source number n is the (n mod 5)-th of the five. Their texts have single line ends
between paragraphs. Every view covers the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as K
from ..operators import chunking, generation
from ..sources.shared import saved
from ..sources.tables import table

CHUNK_TOKENS = 200
PACKED_LENGTH = 256
CATALOG_AUTHORS = ("Austen, Jane, 1775-1817", "BRONTE, EMILY", "Brontë, Charlotte, 1816-1855; Gaskell, Elizabeth Cleghorn", "Le Fanu, Joseph Sheridan, 1814-1873", "James, M. R. (Montague Rhodes)", "Twain, Mark", "Nobody, At All", "Crane, Stephen; London, Jack")


def _of(names: tuple[str, ...], source):
    n = F.substring(source, 4, 10).try_cast("int")
    return F.element_at(F.array(*map(F.lit, names)), n % len(names) + 1)


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, author, register."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("author"), _of(tuple(r[0] for r in K.REGISTERS), F.col("source")).alias("register"))


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register dimension with the sources as authors."""
    found = chapters(spark, sf_dir).select("author", "register").distinct().groupBy(F.col("register").alias("name")).agg(F.sort_array(F.collect_set("author")).alias("authors"))
    shown = spark.createDataFrame([(n, d, h) for n, d, _, h in K.REGISTERS], "name string, display string, style_hint string")
    return found.join(F.broadcast(shown), "name").select("name", "display", "authors", "style_hint")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path (the doc_id), chunk_idx, n_paragraphs, n_tokens, is_chapter_end, text, author, register."""
    return chunking.paragraph_chunks(chapters(spark, sf_dir), CHUNK_TOKENS, 1, r"\n", keep=("author", "register")).withColumnRenamed("doc_id", "path")


def briefs(chunks_: DataFrame) -> DataFrame:
    """(path, chunk_idx, author, register, brief): first sentences of at least 20 characters."""
    return _long_enough(generation.extractive_briefs(chunks_))


def _long_enough(rows: DataFrame) -> DataFrame:
    return rows.where(F.length("brief") >= 20).select("path", "chunk_idx", "author", "register", "brief")


def chunks_and_briefs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """chunks without their text, and their briefs. Both are read off one table of rows without texts, since texts are costly to cut twice."""
    made = chunks(spark, sf_dir).withColumn("brief", generation.first_sentence(F.col("text"))).drop("text")
    made = saved(made)
    return made.drop("brief"), _long_enough(made.where(F.col("brief") != ""))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles are first lines, with a subtitle on a line of its own."""
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("source") == "src3", "Sound").otherwise("Text")
    return docs.select(F.col("doc_id").cast("string").alias("Text#"), kind.alias("Type"), F.concat(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("\nA subtitle, \"quoted\"")).alias("Title"), F.col("lang").alias("Language"), _of(CATALOG_AUTHORS, F.col("source")).alias("Authors"), F.col("doc_id").alias("position"))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work, text): ten documents each under chapter headings, between start and end markers."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("work"), "doc_id", "text")
    body = F.concat(F.lit("CHAPTER "), (F.col("doc_id") % 10 + 1).cast("string"), F.lit("\n"), F.col("text"), F.lit("\n")).alias("body")
    joined = docs.groupBy("work").agg(F.sort_array(F.collect_list(F.struct("doc_id", body))).alias("parts"))  # ten rows
    start, end = "Front matter\n*** START OF THE PROJECT GUTENBERG EBOOK WORK ***\n", "*** END OF THE PROJECT GUTENBERG EBOOK WORK ***\nlicence"
    return joined.select("work", F.concat(F.lit(start), F.array_join("parts.body", ""), F.lit(end)).alias("text"))
