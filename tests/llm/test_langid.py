import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillmill.llm import langid


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(documents):
    got = langid.predict_held_out(documents).where("held_out").join(documents.where(F.length("text") > 30).select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred = lang").count() / got.count() > 0.98
    assert got.where("score < 0 OR score > 1").isEmpty()


def test_held_out_is_the_crc_of_the_id(documents):
    import zlib

    for r in langid.predict_held_out(documents.limit(50)).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_predictions_use_the_text_alone(documents):
    """Languages of held-out documents, and ids, don't matter."""
    a = {r["doc_id"]: tuple(r)[1:] for r in langid.predict_held_out(documents).collect()}
    changed = documents.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert {r["doc_id"]: tuple(r)[1:] for r in langid.predict_held_out(changed).collect()} == a


def test_mixtures_of_two_languages(documents):
    model = langid.learn(documents)
    texts = {r["lang"]: r["t"] for r in documents.where("length(text) > 2000").groupBy("lang").agg(F.min("text").alias("t")).collect()}
    mixed = texts["en"][:1500] + " " + texts["de"][:1500]
    one, two = langid.mixtures(pa.array([texts["en"][:1500], mixed]), model)
    at = {n: k for k, n in enumerate(model.names)}
    assert (one > 0).sum() == 1
    assert one[at["en"]] == pytest.approx(1)
    assert {n for n in model.names if two[at[n]] > 0} == {"en", "de"}
    assert abs(two[at["en"]] - 0.5) < 0.1
    assert two.sum() == pytest.approx(1)


def test_em_reaches_the_likelihoods_maximum():
    rng = np.random.default_rng(0)
    likely = rng.random((200, 2))
    n = rng.integers(1, 5, 200)
    pi, logl = langid._fit(likely, n, np.zeros(200, int), np.zeros(1, int), np.array([n.sum()]), np.ones((1, 2)), langid.LanguageConfig(steps=200))
    grid = np.linspace(0.001, 0.999, 999)
    best = max((n * np.log(likely @ [p, 1 - p])).sum() for p in grid)
    assert logl[0] >= best - 1e-3


def scalar_words(text):
    """Runs of letters and marks that begin with a letter, lower case."""
    out, now = [], ""
    for ch in text.lower():
        kind = unicodedata.category(ch)[0]
        if kind == "L" or (kind == "M" and now):
            now += ch
        elif now:
            out.append(now)
            now = ""
    return out + [now] * bool(now)


def scalar_prediction(text, counts, c=langid.LanguageConfig()):
    """(language, proportion, languages selected) by EM over single words, in plain Python."""
    names = sorted(counts)
    totals = {n: sum(counts[n].values()) for n in names}
    space = 1 << c.bits
    words = [w[k : k + c.word_chars] for w in scalar_words(text) for k in range(0, len(w), c.word_chars)]
    if not words or not names:
        return "und", 0.0, 0
    grams = {w: [f"\x02{w}\x03"[k : k + 3] for k in range(len(w))] for w in set(words)}
    log = {w: [sum(math.log((counts[n].get(hashed(g), 0) + c.smoothing) / (totals[n] + c.smoothing * space)) for g in gs) for n in names] for w, gs in grams.items()}
    like = {w: [max(math.exp(x - max(v)), 1e-30) for x in v] for w, v in log.items()}
    base, allowed, best = sum(max(log[w]) for w in words), set(range(len(names))), None
    while allowed:
        pi = {k: 1 / len(allowed) for k in allowed}
        for _ in range(c.steps):
            new = dict.fromkeys(allowed, 0.0)
            for w in words:
                total = sum(pi[k] * like[w][k] for k in allowed)
                for k in allowed:
                    new[k] += pi[k] * like[w][k] / total
            pi = {k: max(v / len(words), c.floor) for k, v in new.items()}
            pi = {k: v / sum(pi.values()) for k, v in pi.items()}
        logl = base + sum(math.log(sum(pi[k] * like[w][k] for k in allowed)) for w in words)
        bic = logl - (len(allowed) - 1) / 2 * math.log(len(words))
        if best is None or bic >= best[0]:
            best = bic, pi
        allowed.discard(min(allowed, key=lambda k: (pi[k], k)))
    top = max(best[1], key=lambda k: (best[1][k], -k))
    return names[top], best[1][top], len(best[1])


def hashed(gram):
    """An n-gram's bucket by plain integers."""
    h = 0
    for ch in gram:
        h = (h * 0x100000001B3 + ord(ch)) % 2**64
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> 33)) * m % 2**64
    return (h ^ (h >> 33)) >> 48


def test_all_rows_by_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.collect()
    counts = {}
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            for w in scalar_words(r["text"]):
                for k in range(len(w)):
                    counts.setdefault(r["lang"], Counter())[hashed(f"\x02{w}\x03"[k : k + 3])] += 1
    got = {r["doc_id"]: r for r in langid.predict_held_out(df).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, score, n = scalar_prediction(r["text"], counts)
        mine = got[r["doc_id"]]
        assert (mine["lang_pred"], mine["n_langs"]) == (lang, n)
        assert mine["score"] == pytest.approx(score, abs=1e-9)


def test_words_keep_their_marks():
    import pyarrow as pa

    words, codes, of = langid._words(pa.array(["ne\u0301e हिन्दी \u0301x", None, "42"]), langid.LanguageConfig())
    assert [words[k] for k in codes] == ["ne\u0301e", "हिन्दी", "x"] and of.tolist() == [0, 0, 0]


def test_memory_follows_the_vocabulary(documents):
    """A text a thousand times as long has the same mixture, and its words are held once."""
    model = langid.learn(documents)
    text = documents.where("lang = 'fr' AND length(text) > 500").first()["text"][:500]
    a, b = langid.mixtures(pa.array([text, " ".join([text] * 1000)]), model)
    assert a.argmax() == b.argmax()


def test_rows_without_an_id_are_learned_from(spark):
    rows = [(None, f"mot francais numero {k} ecrit ici", "fr") for k in range(40)] + [(None, f"english word number {k} written here", "en") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, langid.LanguageConfig(docs_per_language=20))
    assert model.names == ("en", "fr")


def test_edges(edge, none, spark):
    rows = langid.predict_held_out(edge).collect()
    assert len(rows) == edge.count()
    blank = {r["doc_id"]: r for r in rows if r["doc_id"] in (2, 3, 4)}
    assert {(r["lang_pred"], r["score"]) for r in blank.values()} == {("und", 0.0)}
    assert langid.predict_held_out(none).count() == 0
    digits = spark.createDataFrame([(1, "123 !?", "en")], "doc_id long, text string, lang string")
    assert langid.predict_held_out(digits).first()["lang_pred"] == "und"


def test_nothing_learned_gives_und(edge):
    assert {r["lang_pred"] for r in langid.predict_held_out(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
