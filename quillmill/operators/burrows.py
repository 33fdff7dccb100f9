"""Most frequent words, z-scores over chapters and Burrows' Delta.

Chapters hold few of the words, so means and variances are reckoned from those that
have the word and the number of all. Only Delta, which compares all words of a chapter
with a centroid's, fills a small row of scores per chapter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import constants as K, text as T
from ..functions.columns import once

LEAST_SIGMA = 1e-9
MOST_CENTRES = 10_000


def word_counts(chapters: DataFrame, chapter: str = "doc_id", text: str = "text") -> DataFrame:
    """(chapter, word, n), lower case."""
    df = once(chapters.select(chapter, text), lower=T.lowered(T.words(F.col(text)))).drop(text)
    return df.select(chapter, F.explode("lower").alias("word")).groupBy(chapter, "word").agg(F.count("*").alias("n"))


def word_totals(chapters: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all chapters, added up before anything is shuffled."""
    df = once(chapters.select(text), lower=T.lowered(T.words(F.col(text))))
    return df.select(F.explode("lower").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def frequent_words(counts: DataFrame, top: int = 150) -> DataFrame:
    """(word, total, place); of equally frequent words the alphabetically first. counts has word and n."""
    best = counts.groupBy("word").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "word").limit(top)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), "word")))  # top rows


def word_frequencies(chapters: DataFrame, words: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys, word, freq) of the frequent words that a chapter has, freq being of all its words; a chapter is a row of chapters, told by its keys."""
    df = once(chapters.select(*keys, text), lower=T.lowered(T.words(F.col(text)))).drop(text)
    long = df.select(*keys, F.size("lower").alias("all_words"), F.explode("lower").alias("word"))
    hits = long.join(F.broadcast(words.select("word")), "word").groupBy(*keys, "all_words", "word").agg(F.count("*").alias("n"))
    return hits.select(*keys, "word", (F.col("n") / F.col("all_words")).alias("freq"))


def chapters_with_words(chapters: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """(by, n): how many chapters have words."""
    return chapters.where(F.col(text).rlike(K.WORD)).groupBy(*by).agg(F.count("*").alias("n"))


def relative_frequencies(counts: DataFrame, words: DataFrame, chapter: str = "doc_id") -> DataFrame:
    """(chapter, word, freq) of the frequent words that a chapter has; freq is of all its words."""
    totals = counts.groupBy(chapter).agg(F.sum("n").alias("all_words"))
    return counts.join(F.broadcast(words.select("word")), "word").join(totals, chapter).select(chapter, "word", (F.col("n") / F.col("all_words")).alias("freq"))


def scale(freqs: DataFrame, words: DataFrame, n_chapters: DataFrame) -> DataFrame:
    """(word, mu, sigma) over all chapters with words, sigma of the population; n_chapters is one row with n.

    Mean and variance of the chapters that have a word are joined with the zeros of
    the others as two groups are: no value is squared before its mean is taken out.
    """
    own = freqs.groupBy(F.col("word").alias("w")).agg(F.count("*").alias("h"), F.avg("freq").alias("m"), F.var_pop("freq").alias("v"))
    both = words.select("word").join(own, F.col("word") == F.col("w"), "left").withColumn("n", n_chapters.scalar())
    h, m, v, n = F.coalesce("h", F.lit(0)), F.coalesce("m", F.lit(0.0)), F.coalesce("v", F.lit(0.0)), F.col("n")
    sigma = F.sqrt((h * v + h * (n - h) / n * m**2) / n)
    return both.select("word", (h * m / n).alias("mu"), F.greatest(sigma, F.lit(LEAST_SIGMA)).alias("sigma"))


def chapter_count(counts: DataFrame, chapter: str = "doc_id") -> DataFrame:
    """One row: n, the chapters that have words."""
    return counts.select(chapter).distinct().agg(F.count("*").alias("n"))


def chapter_vectors(freqs: DataFrame, scaled: DataFrame, chapters: DataFrame, chapter: str = "doc_id") -> DataFrame:
    """(chapter, z): z-scores in the order of the words, for every chapter in chapters (ids with words).

    One small row per chapter: the words it lacks get the score of frequency 0.
    """
    places = scaled.select("word", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("word")) - 1).alias("i"))  # the frequent words
    own = freqs.join(F.broadcast(places), "word").groupBy(chapter).agg(F.sort_array(F.collect_list(F.struct("i", "freq"))).alias("have"))
    row = scaled.agg(F.sort_array(F.collect_list(F.struct("word", "mu", "sigma"))).alias("scale"))
    df = chapters.join(own, chapter, "left").withColumn("scale", row.scalar())
    have = F.coalesce("have", F.array().cast("array<struct<i:int,freq:double>>"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    before = lambda j: F.when(j == 0, F.lit(-1)).otherwise(F.element_at("have", F.greatest(j, F.lit(1)))["i"])
    filled = F.flatten(F.transform(have, lambda e, j: F.concat(zeros(e["i"] - before(j) - 1), F.array(e["freq"]))))
    df = once(df, filled=filled)
    dense = F.concat("filled", zeros(F.size("scale") - F.size("filled")))
    return df.select(*chapters.columns, F.zip_with(dense, "scale", lambda f, s: (f - s["mu"]) / s["sigma"]).alias("z"))


def centroids(vectors: DataFrame, register: str = "register") -> DataFrame:
    """(register, n, z): the mean of each word's score."""
    long = vectors.select(register, F.posexplode("z").alias("at", "x"))
    means = long.groupBy(register, "at").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy(register).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "x"))).alias("s")).select(register, "n", F.col("s.x").alias("z"))


def word_centroids(freqs: DataFrame, scaled: DataFrame, sizes: DataFrame, register: str = "register") -> DataFrame:
    """(register, n, word, z): the means of scores from sums of frequencies; no chapter's scores are filled in.

    sizes has a row (register, n) per register, scaled one per frequent word.
    """
    sums = freqs.groupBy(F.col(register).alias("of"), F.col("word").alias("w")).agg(F.sum("freq").alias("sum"))
    row = scaled.agg(F.collect_list(F.struct("word", "mu", "sigma")).alias("scale"))
    grid = sizes.withColumn("scale", row.scalar()).select(register, "n", F.inline("scale"))
    both = grid.join(sums, (F.col(register) == F.col("of")) & (F.col("word") == F.col("w")), "left")
    return both.select(register, "n", "word", ((F.coalesce("sum", F.lit(0.0)) / F.col("n") - F.col("mu")) / F.col("sigma")).alias("z"))


def delta(a, b):
    """Mean absolute difference of two score arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1))


def pairwise_delta(centres: DataFrame, register: str = "register") -> DataFrame:
    """Of every two registers; a row per register makes this small."""
    a = centres.select(F.col(register).alias("register_a"), F.col("z").alias("za"))
    b = centres.select(F.col(register).alias("register_b"), F.col("z").alias("zb"))
    return a.join(F.broadcast(b), F.col("register_a") != F.col("register_b")).select("register_a", "register_b", delta(F.col("za"), F.col("zb")).alias("delta"))


def cohesion(vectors: DataFrame, centres: DataFrame, register: str = "register") -> DataFrame:
    """(register, n, delta): mean Delta of a register's chapters from its centroid."""
    c = F.broadcast(centres.select(F.col(register).alias("of"), F.col("z").alias("zc")))
    return vectors.join(c, F.col(register) == F.col("of")).groupBy(register).agg(F.count("*").alias("n"), F.avg(delta(F.col("z"), F.col("zc"))).alias("delta"))


def nearest_register(vectors: DataFrame, centres: DataFrame, chapter: str = "doc_id", register: str = "register") -> DataFrame:
    """(chapter, nearest, delta): the centroid with the least Delta, of equals the first by name. Centroids travel as one array, so there may be MOST_CENTRES at most."""
    few = F.assert_true(F.count("*") <= MOST_CENTRES, F.lit(f"more than {MOST_CENTRES} centroids"))
    every = F.sort_array(F.collect_list(F.struct(F.col(register).alias("name"), "z")))
    row = centres.agg(every.alias("every"), few.alias("few")).select(F.when(F.col("few").isNull(), F.col("every")).alias("centres"))
    every = F.transform("centres", lambda c: F.struct(delta(F.col("z"), c["z"]).alias("delta"), c["name"].alias("name")))
    return vectors.withColumn("centres", row.scalar()).select(chapter, F.array_min(every).alias("best")).select(chapter, F.col("best.name").alias("nearest"), F.col("best.delta").alias("delta"))


def index_document(words: DataFrame, scaled: DataFrame, centres: DataFrame, register: str = "register") -> DataFrame:
    """One row with the whole index, to be written as JSON."""
    head = words.join(scaled, "word").agg(F.sort_array(F.collect_list(F.struct("place", "word", "mu", "sigma"))).alias("w"))
    body = centres.agg(F.map_from_entries(F.collect_list(F.struct(register, "z"))).alias("cluster_centroids"), F.map_from_entries(F.collect_list(F.struct(register, "n"))).alias("cluster_chapter_counts"))
    return head.join(F.broadcast(body)).select(F.size("w").alias("mfw_n"), F.col("w.word").alias("mfw_words"), F.col("w.mu").alias("corpus_mu"), F.col("w.sigma").alias("corpus_sigma"), "cluster_centroids", "cluster_chapter_counts")
