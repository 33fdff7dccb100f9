"""Faster forms of the measures give what the plain patterns give, on odd texts too, and a profile works its chapters out once."""

import random

from helpers import SMALL
from pyspark.sql import functions as F
from quillmill.functions import constants as K, text as T
from quillmill.plans import registry

BITS = ["ly", "quickly", "LY", "nation", "natıon", "natİon", "neſs", "kindneſs", "aity", "abity", "Mr.", "xmr.", "St. Paul", "1age", "éage", "𝐚ly", "😀ly", "😀age", "𝐚𝐚age", "a𝐚age", "e\u0301ery", "\u0301ly", "__ness", "x-ly", " ", "\n", "\u00a0", "\u2003", "\x85", "\x1c", "\u200b", ". ", "! A", "“Ja”", "No. 5", "vs. Them", "tion_", "tion1", "was killed.", "\x01"]


def odd(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(BITS) + rng.choice(["", " ", ". "]) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    return spark.createDataFrame([(t,) for t in ["", " ", "\n", *texts]], "text string")


def test_measures_equal_the_plain_patterns(spark):
    t = F.col("text")
    masked = F.regexp_replace(t, rf"(?iU)\b({'|'.join(K.ABBREVIATIONS)})\.", "$1\u0001")
    plain = {
        "adverbs": F.regexp_count(t, F.lit(r"(?iU)\b\w+ly\b")),
        "nominalizations": F.regexp_count(t, F.lit(rf"(?iU)\b\w{{2,}}(?:{'|'.join(K.NOMINAL_SUFFIXES)})\b")),
        "stripped": F.regexp_replace(t, r"^(?U:\s)+|(?U:\s)+$", ""),
        "sentences": F.transform(T.pieces_by_sentence(masked), lambda s: F.translate(s, "\u0001", ".")),
    }
    for name, c in plain.items():
        assert odd(spark).where(~c.eqNullSafe(getattr(T, name)(t))).count() == 0, name


def test_nothing_is_matched_at_each_word_to_find_few(spark):
    """Patterns that start at any word cost several times as much."""
    text = registry.QUERIES["chapter_stats"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert r"\b\w+ly" not in text
    assert r"\b(Adm" not in text


def test_a_profile_works_its_chapters_out_once(spark):
    text = registry.QUERIES["author_profile"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") == 1


def test_paragraphs_are_counted_without_words(spark):
    text = registry.QUERIES["chapter_paragraphs"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert K.WORD not in text
