import pytest
from pyspark.sql import functions as F
from quillmill.operators import burrows, profile, registers


def test_a_chapter_by_hand(spark):
    text = "Mr. Smith was taken away; he, sadly, left.\n\n\n“Go!” he said. Is it?"
    df = spark.createDataFrame([("a", text), ("a", " \n\n\n "), ("a", None)], "author string, text string")
    rows = profile.chapter_stats(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["n_paragraphs"], r["n_sentences"], r["n_words"], r["commas"], r["semis"]) == (2, 3, 13, 2, 1)
    assert (r["dialogue_paras"], r["passive_sentences"], r["ly_words"]) == (1, 1, 1)
    assert (r["end_period"], r["end_excl"], r["end_quest"]) == (2, 0, 1)
    assert r["para_sentence_counts"] == [1, 2]
    assert r["function_word_hits"] == 5  # was, he, he, is, it


def stats(spark, rows):
    df = spark.createDataFrame(rows, "author string, n_unique_words long, n_words long, para_sentence_counts array<int>")
    return df.select("*", *(F.lit(1).cast("long").alias(c) for c in profile.COUNTERS if c not in df.columns))


def test_type_token_ratio_is_not_weighted(spark):
    got = profile.author_profile(stats(spark, [("a", 1, 2, [1]), ("a", 100, 100, [1])])).first()
    assert got["type_token_ratio_chapter_avg"] == 0.75
    assert got["mean_word_length_chars"] == 2 / 102


@pytest.mark.parametrize(("counts", "want"), [([[1, 2], [3, 4]], 3), ([[1]], 1), ([[5, 1, 3]], 3), ([[]], 0)])
def test_upper_median_over_chapters(spark, counts, want):
    got = profile.author_profile(stats(spark, [("a", 1, 1, c) for c in counts])).first()
    assert got["median_paragraph_length_sentences"] == want
    flat = sorted(x for c in counts for x in c)
    assert spark.range(1).select(profile.upper_median(F.array(*map(F.lit, flat)).cast("array<int>")).alias("x")).first()["x"] == want


def test_bigram_thresholds(spark):
    rows = [("a", "x", "y", 30), ("a", "u", "v", 29), ("a", "only", "mine", 500), ("a", "z", "z", 441), ("b", "x", "y", 15), ("b", "u", "v", 1), ("b", "z", "z", 984)]
    got = profile.distinguishing_bigrams(spark.createDataFrame(rows, "author string, w1 string, w2 string, n long")).collect()
    assert [(r["author"], r["bigram"]) for r in got] == [("a", "x y"), ("b", "z z")]
    assert got[0]["ratio"] == pytest.approx(2.0)


def test_profile_document_has_an_empty_list(spark):
    p = profile.author_profile(stats(spark, [("a", 1, 1, [1]), ("b", 1, 1, [1])]))
    b = profile.distinguishing_bigrams(spark.createDataFrame([("a", "x", "y", 40), ("b", "x", "y", 1), ("b", "q", "q", 60)], "author string, w1 string, w2 string, n long"))
    got = {r["author"]: r["distinguishing_bigrams"] for r in profile.profile_documents(p, b).collect()}
    assert len(got["a"]) == 1
    assert got["b"] == []


def test_quartiles_and_overlap(spark):
    q = registers.quartiles(F.array(*(F.lit(float(x)) for x in (5, 4, 3, 2, 1))))
    assert tuple(spark.range(1).select(*(c.alias(k) for k, c in q.items())).first()) == (2.0, 3.0, 4.0)
    meet = spark.range(1).select(registers.overlaps(F.lit(1), F.lit(2), F.lit(2), F.lit(3)).alias("a"), registers.overlaps(F.lit(1), F.lit(2), F.lit(2.5), F.lit(3)).alias("b")).first()
    assert tuple(meet) == (True, False)


def test_separation(spark):
    rows = [("r1", "x", 1.0, 2.0, 3.0), ("r2", "x", 4.0, 5.0, 6.0), ("r3", "x", 5.5, 5.6, 7.0)]
    got = {r["register"]: r for r in registers.separation(spark.createDataFrame(rows, "register string, axis string, q1 double, median double, q3 double")).collect()}
    assert (got["r1"]["strong"], got["r1"]["valid"]) == (["x"], True)
    assert (got["r2"]["n_strong"], got["r2"]["n_extreme"], got["r2"]["valid"]) == (0, 0, False)
    assert (got["r3"]["n_strong"], got["r3"]["n_extreme"], got["r3"]["valid"]) == (0, 1, False)


def test_register_lookup(spark):
    dim = registers.registers(spark)
    assert registers.known(dim, "gothic-dark").first()["display"] == "Gothic dark"
    with pytest.raises(Exception, match="unknown register"):
        registers.known(dim, "none").collect()
    records = spark.createDataFrame([("Jane Austen",), ("Mark Twain",), ("Nobody",)], "author string")
    assert registers.of_register(records, dim).count() == 2
    assert registers.of_register(records, dim, "plain-realist").first()["author"] == "Mark Twain"


def test_burrows_by_brute_force(spark):
    import statistics

    texts = {1: "the cat the dog", 2: "the the bird", 3: "cat dog", 4: ""}
    docs = spark.createDataFrame([(k, t, "r1" if k < 3 else "r2") for k, t in texts.items()], "doc_id long, text string, register string")
    counts = burrows.word_counts(docs)
    words = burrows.frequent_words(counts, 3)
    assert [r["word"] for r in words.orderBy("place").collect()] == ["the", "cat", "dog"]
    freqs = burrows.relative_frequencies(counts, words)
    scaled = burrows.scale(freqs, words, burrows.chapter_count(counts))
    split = {k: t.split() for k, t in texts.items() if t}
    z = {}
    for r in scaled.collect():
        f = [t.count(r["word"]) / len(t) for t in split.values()]
        assert r["mu"] == pytest.approx(statistics.mean(f))
        assert r["sigma"] == pytest.approx(statistics.pstdev(f))
        z[r["word"]] = [(x - statistics.mean(f)) / statistics.pstdev(f) for x in f]
    ids = counts.select("doc_id").distinct().join(docs.select("doc_id", "register"), "doc_id")
    vectors = burrows.chapter_vectors(freqs, scaled, ids)
    got = {r["doc_id"]: r["z"] for r in vectors.collect()}
    assert set(got) == {1, 2, 3}
    for k, d in enumerate((1, 2, 3)):
        assert got[d] == pytest.approx([z[w][k] for w in sorted(z)])
    centres = burrows.centroids(vectors)
    near = {r["doc_id"]: r["nearest"] for r in burrows.nearest_register(vectors, centres).collect()}
    assert near[3] == "r2"
    assert burrows.index_document(words, scaled, centres).count() == 1


def test_equal_frequencies_have_the_least_sigma(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id long, text string")
    counts = burrows.word_counts(docs)
    words = burrows.frequent_words(counts, 1)
    assert burrows.scale(burrows.relative_frequencies(counts, words), words, burrows.chapter_count(counts)).first()["sigma"] == 1e-9


def test_sparse_steps_equal_the_dense_ones(spark):
    import random

    rng = random.Random(4)
    rows = [(k, f"r{k % 3}", " ".join(rng.choices(["aa", "bb", "cc", "dd", "ee"], k=rng.randint(0, 30)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, register string, text string")
    counts = burrows.word_counts(docs)
    words = burrows.frequent_words(counts, 4)
    assert words.collect() == burrows.frequent_words(burrows.word_totals(docs), 4).collect()
    dense, sparse = burrows.relative_frequencies(counts, words), burrows.word_frequencies(docs, words, ("doc_id", "register"))
    assert sorted(map(tuple, dense.collect())) == sorted((r["doc_id"], r["word"], r["freq"]) for r in sparse.collect())
    sizes = burrows.chapters_with_words(docs, "register")
    scaled = burrows.scale(sparse, words, burrows.chapter_count(counts))
    ids = counts.select("doc_id").distinct().join(docs.select("doc_id", "register"), "doc_id")
    want = {r["register"]: (r["n"], r["z"]) for r in burrows.centroids(burrows.chapter_vectors(dense, scaled, ids)).collect()}
    order = sorted(r["word"] for r in words.collect())
    for r in burrows.word_centroids(sparse, scaled, sizes).collect():
        n, z = want[r["register"]]
        assert r["n"] == n and r["z"] == pytest.approx(z[order.index(r["word"])], abs=1e-9)


def test_more_centroids_than_one_row_may_hold_are_refused(spark, monkeypatch):
    monkeypatch.setattr(burrows, "MOST_CENTRES", 2)
    rows = spark.createDataFrame([(k, f"r{k}", [1.0]) for k in range(3)], "doc_id long, register string, z array<double>")
    with pytest.raises(Exception, match="more than 2 centroids"):
        burrows.nearest_register(rows, rows.select("register", "z")).collect()
