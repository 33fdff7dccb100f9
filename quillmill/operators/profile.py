"""Style profiles: measures per chapter, ratios per author, distinguishing bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as K, text as T
from ..functions.columns import at_least_one, once

COUNTERS = ("n_chars", "n_words", "n_unique_words", "n_sentences", "n_paragraphs", "total_word_chars", "ly_words", "commas", "semis", "dialogue_paras", "passive_sentences", "nominalization_hits", "function_word_hits", "end_period", "end_excl", "end_quest")


def _is(what: str):
    """For transform: the element if it is what, else null. (A default argument of a lambda would be taken for the position.)"""
    return lambda e: F.when(e == what, e)


def chapter_stats(chapters: DataFrame, text: str = "text", paragraph: str = K.PROFILE_PARAGRAPH, counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """chapters that have a paragraph, with the 16 counters, or some of them, and para_sentence_counts. text goes. Words are only cut out for counters of words."""
    t, worded = F.col(text), any("word" in c for c in counters)
    paras = F.transform(T.paragraphs(t, paragraph), lambda p: F.when(F.contains(p, F.lit("\n")), T.unwrapped(p)).otherwise(p))
    df = once(chapters.where(t.isNotNull()), paras=paras, **({"words": T.words(t)} if worded else {})).where(F.size("paras") > 0)
    df = once(df, by_para=F.transform("paras", T.sentences), **({"lower": T.lowered(F.col("words"))} if worded else {}))
    df = once(df, sents=F.flatten("by_para"))
    df = once(df, ends=F.transform("sents", lambda s: F.substring(s, -1, 1)))  # a paragraph is stripped, so none ends in white space
    size_where = lambda c, f: F.size(F.filter(c, f))
    stats = dict(
        n_chars=F.length(t),
        n_words=at_least_one(F.size("words")),
        n_unique_words=F.size(F.array_distinct("lower")),
        n_sentences=at_least_one(F.size("sents")),
        n_paragraphs=F.size("paras"),
        total_word_chars=F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w)),
        ly_words=T.adverbs(t),
        commas=T.occurrences(t, ","),
        semis=T.occurrences(t, ";"),
        dialogue_paras=size_where("paras", T.has_speech),
        passive_sentences=size_where("sents", T.is_passive),
        nominalization_hits=T.nominalizations(t),
        function_word_hits=T.function_words(F.col("lower")),
        **{f"end_{name}": F.size(F.array_compact(F.transform("ends", _is(c)))) for name, c in (("period", "."), ("excl", "!"), ("quest", "?"))},
    )
    df = once(df, **{k: v.cast("long") for k, v in stats.items() if k in counters}, para_sentence_counts=F.transform("by_para", F.size))
    return df.drop(text, "paras", "words", "lower", "by_para", "sents", "ends")


def upper_median(values: Column) -> Column:
    """The element at half the length of a sorted array; 0 if it is empty."""
    return F.when(F.size(values) == 0, 0).otherwise(F.element_at(F.sort_array(values), F.floor(F.size(values) / 2).cast("int") + 1))


def author_totals(stats: DataFrame, author: str = "author") -> DataFrame:
    """Sums per author, the mean of the chapters' type-token ratios and the upper median of paragraph lengths.

    The median is read off a histogram of paragraph lengths, so no author's
    paragraphs gather in one row. Sums and histogram are made together: stats are
    costly and would be made anew for each.
    """
    lengths = F.concat(F.array(F.lit(None).cast("int")), "para_sentence_counts")  # the chapter's own row has no length
    rows = stats.select(author, *COUNTERS, F.posexplode(lengths).alias("__k", "len")).withColumn("__own", F.col("__k") == 0)
    own = lambda c: F.when(F.col("__own"), c)
    sums = (F.count(own(F.lit(1))).alias("chapters"), *(F.sum(own(F.col(c))).alias(c) for c in COUNTERS), F.sum(own(F.col("n_unique_words") / F.col("n_words"))).alias("ttr"))
    by_length = rows.groupBy(author, "len").agg(F.count(F.when(~F.col("__own"), 1)).alias("n"), *sums)
    mine = Window.partitionBy(author)
    upto = by_length.withColumns({"upto": F.sum("n").over(mine.orderBy("len")), "all": F.sum("n").over(mine)})
    middle = F.when((F.col("n") > 0) & (F.col("upto") > F.floor(F.col("all") / 2)), F.col("len"))
    out = upto.groupBy(author).agg(*(F.sum(c).alias(c) for c in ("chapters", *COUNTERS, "ttr")), F.min(middle).alias("median_len"))
    return out.withColumn("ttr", F.col("ttr") / F.col("chapters"))


def author_profile(stats: DataFrame, author: str = "author") -> DataFrame:
    """One row per author; ratios are sums over sums and not rounded."""
    s = {c: F.col(c) for c in COUNTERS}
    n_words, n_sent, n_para = (at_least_one(s[c]) for c in ("n_words", "n_sentences", "n_paragraphs"))
    n_end = at_least_one(s["end_period"] + s["end_excl"] + s["end_quest"])
    return author_totals(stats, author).select(
        author,
        "chapters",
        s["n_words"].alias("total_words"),
        s["n_sentences"].alias("total_sentences"),
        s["n_paragraphs"].alias("total_paragraphs"),
        (s["total_word_chars"] / n_words).alias("mean_word_length_chars"),
        (n_words / n_sent).alias("mean_sentence_length_words"),
        (n_sent / n_para).alias("mean_paragraph_length_sentences"),
        F.coalesce("median_len", F.lit(0)).cast("long").alias("median_paragraph_length_sentences"),
        F.round("ttr", 6).alias("type_token_ratio_chapter_avg"),
        (s["ly_words"] / n_words * 100).alias("adverb_ly_density_pct"),
        (s["commas"] / n_sent).alias("commas_per_sentence"),
        (s["semis"] / n_words * 1000).alias("semicolons_per_1k_words"),
        (s["dialogue_paras"] / n_para * 100).alias("dialogue_paragraph_pct"),
        (s["passive_sentences"] / n_sent * 100).alias("passive_ratio_pct_of_sentences"),
        (s["nominalization_hits"] / n_words * 1000).alias("nominalization_per_1k_words"),
        ((1 - s["function_word_hits"] / n_words) * 100).alias("lexical_density_pct"),
        *((s[f"end_{e}"] / n_end * 100).alias(f"end_{e}_pct") for e in ("period", "excl", "quest")),
    )


def rounded_profile(profile: DataFrame) -> DataFrame:
    """Places as they are shown, and sentence ends as one struct."""
    places = dict(mean_word_length_chars=2, mean_sentence_length_words=2, mean_paragraph_length_sentences=2, type_token_ratio_chapter_avg=4, adverb_ly_density_pct=3, commas_per_sentence=3, semicolons_per_1k_words=3, dialogue_paragraph_pct=2, passive_ratio_pct_of_sentences=2, nominalization_per_1k_words=3, lexical_density_pct=2)
    ends = F.struct(*(F.bround(f"end_{e}_pct", 1).alias(e) for e in ("period", "excl", "quest"))).alias("sentence_end_pct")
    return profile.withColumns({c: F.bround(c, n) for c, n in places.items()}).select("*", ends).drop("end_period_pct", "end_excl_pct", "end_quest_pct")


def bigram_counts(chapters: DataFrame, author: str = "author", text: str = "text") -> DataFrame:
    """(author, w1, w2, n); pairs cross sentences but not chapters, and are added up before they are shuffled."""
    df = once(chapters.select(author, text), lower=T.lowered(T.words(F.col(text)))).drop(text)
    pairs = df.select(author, "lower", F.posexplode("lower").alias("__k", "w2")).where("__k > 0").select(author, F.element_at("lower", F.col("__k")).alias("w1"), "w2")
    return pairs.groupBy(author, "w1", "w2").agg(F.count("*").alias("n"))


def distinguishing_bigrams(counts: DataFrame, author: str = "author", top: int = 30, least_count: int = 30, least_ratio: float = 2.0, least_rate: float = 1e-7) -> DataFrame:
    """Each author's bigrams with the highest rate against all other authors.

    Totals are of unfiltered counts. Only bigrams frequent with some author can
    score, so the others' counts are added up for those alone.
    """
    totals = counts.groupBy(F.col(author).alias("of")).agg(F.sum("n").alias("mine"))
    totals = totals.withColumn("everyone", F.sum("mine").over(Window.partitionBy(F.lit(0))))  # a row per author
    overall = counts.groupBy("w1", "w2").agg(F.sum("n").alias("everywhere"), F.max("n").alias("most")).where(F.col("most") >= least_count).drop("most")
    scored = counts.where(F.col("n") >= least_count).join(overall, ["w1", "w2"]).join(totals, F.col(author) == F.col("of"))
    scored = scored.withColumns({"my_rate": F.col("n") / at_least_one(F.col("mine")), "other_rate": (F.col("everywhere") - F.col("n")) / at_least_one(F.col("everyone") - F.col("mine"))})
    scored = scored.where(F.col("other_rate") >= least_rate).withColumn("ratio", F.col("my_rate") / F.col("other_rate")).where(F.col("ratio") >= least_ratio)
    best = Window.partitionBy(author).orderBy(F.desc("ratio"), F.desc("w1"), F.desc("w2"))
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).select(author, "place", F.concat_ws(" ", "w1", "w2").alias("bigram"), "my_rate", "other_rate", "ratio")


def profile_documents(profile: DataFrame, bigrams: DataFrame, author: str = "author") -> DataFrame:
    """The profile with each author's bigrams as an array, empty where there are none."""
    item = F.struct("place", "bigram", F.bround(F.col("my_rate") * 1e4, 2).alias("my_rate"), F.bround(F.col("other_rate") * 1e4, 2).alias("other_rate"), F.bround("ratio", 1).alias("ratio"))
    lists = bigrams.groupBy(F.col(author).alias("of")).agg(F.sort_array(F.collect_list(item)).alias("distinguishing_bigrams"))  # at most top each
    joined = rounded_profile(profile).join(lists, F.col(author) == F.col("of"), "left").drop("of")
    return joined.withColumn("distinguishing_bigrams", F.coalesce("distinguishing_bigrams", F.array().cast(lists.schema["distinguishing_bigrams"].dataType)))
