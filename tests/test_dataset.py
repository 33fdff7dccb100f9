import pytest
from helpers import SMALL
from pyspark.sql import functions as F
from quillmill.functions import tokenizers
from quillmill.functions.tokenizers import WordTokenizer
from quillmill.operators import chunking, classifier, dataset, evalset
from quillmill.plans import registry, views


class Letters:
    """A token for every non-blank character."""

    def encode(self, text):
        return [ord(c) for c in text if not c.isspace()]

    def decode(self, ids):
        return "".join(map(chr, ids))


class Separated(Letters):
    def encode(self, text):
        return [0] if text == "\n\n" else super().encode(text)


def lengths(text, most, **k):
    return [len(c) for c in chunking.chunk_text(text, Separated(), most, **k)]


def test_greedy_chunks_by_hand():
    assert lengths("aaaa\n\nbbbb\n\ncccc", 9) == [9, 4]
    assert lengths("", 9) == []
    assert lengths("aaa\n\nbbbbbbbbbbbb\n\ncc", 10) == [3, 10, 2, 2]
    assert lengths("aaa\n \nbb", 10) == [6]


def test_long_paragraphs_go_by_sentences():
    assert lengths("Aaaa. Bbbb. Cccc.", 10) == [10, 5]
    assert lengths("Aaaa. " + "B" * 12 + ". Cc.", 10) == [5, 10, 3, 3]


def test_end_token_goes_to_the_last_chunk():
    chunks = chunking.chunk_text("aaaa\n\nbbbb", Separated(), 4, eos=7)
    assert chunks[0] == [97] * 4
    assert chunks[1] == [98, 98, 98, 7]
    assert chunking.chunk_text("aaa", Separated(), 4, eos=7) == [[97, 97, 97, 7]]


def test_chunk_table(spark):
    docs = spark.createDataFrame([(1, "a a a a\n\nb b b b\n\nc c c c"), (2, None), (3, "")], "doc_id long, text string")
    rows = chunking.chunk_documents(docs, WordTokenizer(), 8).orderBy("doc_id", "chunk_idx").collect()
    assert [(r["doc_id"], r["chunk_idx"], r["n_tokens"], r["is_chapter_end"]) for r in rows] == [(1, 0, 8, False), (1, 1, 4, True)]


def test_native_fold_equals_the_general_one(spark):
    import random

    rng = random.Random(5)
    texts = ["\n\n".join(" ".join(["w"] * rng.randint(1, 9)) for _ in range(rng.randint(0, 12))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    class OneSeparator(WordTokenizer):
        def encode(self, text):
            return [0] if text == "\n\n" else super().encode(text)

    native = {(r["doc_id"], r["chunk_idx"]): (r["n_tokens"], r["is_chapter_end"]) for r in chunking.paragraph_chunks(docs, 12).collect()}
    general = {(d, k): (len(c), k == len(cs) - 1) for d, t in enumerate(texts) for cs in [chunking.chunk_text(t, OneSeparator(), 12)] for k, c in enumerate(cs)}
    assert native == general


def test_native_fold_splits_long_paragraphs_like_the_general_one(spark):
    import random

    rng = random.Random(6)
    sentence = lambda: "S" + " w7!"[: rng.randint(0, 4)] + " " + " ".join(["w", "é", "12"][rng.randrange(3)] for _ in range(rng.randint(1, 30))) + "."
    texts = ["\n\n".join(" ".join(sentence() for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 8))) for _ in range(60)] + ["w " * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    class OneSeparator(WordTokenizer):
        def encode(self, text):
            return [0] if text == "\n\n" else super().encode(text)

    native = {(r["doc_id"], r["chunk_idx"]): (r["n_tokens"], r["is_chapter_end"], WordTokenizer().encode(r["text"])) for r in chunking.paragraph_chunks(docs, 12).collect()}
    general = {(d, k): (len(c), k == len(cs) - 1, [i for i in c if i]) for d, t in enumerate(texts) for cs in [chunking.chunk_text(t, OneSeparator(), 12)] for k, c in enumerate(cs)}
    assert native == general
    assert sum(len(ids) for _, _, ids in native.values()) == sum(len(WordTokenizer().encode(t)) for t in texts)


def test_last_brief_wins_and_empty_ones_drop(spark):
    briefs = spark.createDataFrame([("p", 0, "old", 1), ("p", 0, "new", 2), ("p", 1, "", 3)], "path string, chunk_idx int, brief string, line long")
    chunks = spark.createDataFrame([("p", 0), ("p", 1), ("p", 2)], "path string, chunk_idx int")
    last = dataset.last_briefs(briefs)
    assert [tuple(r) for r in dataset.with_briefs(chunks, last).collect()] == [("p", 0, "new")]
    assert dataset.without_briefs(chunks, last).count() == 2


@pytest.mark.parametrize(("n", "want"), [(9, (9, 0, 0)), (10, (8, 1, 1)), (25, (21, 2, 2)), (35, (27, 4, 4))])
def test_split_sizes(spark, n, want):
    rows = spark.range(n).select(F.lit("a").alias("author"), F.col("id").alias("path"), F.lit(0).alias("chunk_idx"))
    got = dataset.split_histogram(dataset.stratified_split(rows)).first()
    assert (got["train"], got["val"], got["test"]) == want


def test_cap(spark):
    rows = spark.range(30).select((F.col("id") % 2).cast("string").alias("author"), F.col("id").alias("path"), F.lit(0).alias("chunk_idx"))
    assert dataset.capped(rows, 15).count() == 30
    assert {r["count"] for r in dataset.capped(rows, 4).groupBy("author").count().collect()} == {4}
    assert dataset.capped(rows, 0).count() == 30
    assert sorted(map(tuple, dataset.capped(rows, 4).collect())) == sorted(map(tuple, dataset.capped(rows.repartition(5), 4).collect()))


def test_packed_rows_and_labels(spark):
    df = spark.createDataFrame([([1, 3, 4], list(range(10, 20))), ([1], [5, 2]), ([], [])], "prompt_ids array<int>, chunk_ids array<int>")
    a, b, c = dataset.with_labels(dataset.packed_rows(df, length=8)).collect()
    assert (a["input_ids"], a["was_cut"], a["n_tokens"]) == ([1, 3, 4, 10, 11, 12, 13, 2], True, 8)
    assert a["labels"] == [-100, -100, -100, 10, 11, 12, 13, 2]
    assert (b["input_ids"], b["attention_mask"]) == ([1, 5, 2, 2, 2, 2, 2, 2], [1, 1, 1, 0, 0, 0, 0, 0])
    assert b["labels"] == [-100, 5, 2, -100, -100, -100, -100, -100]
    assert (c["n_tokens"], c["prompt_length"]) == (1, 0)


def test_author_vocabulary(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("c", 0)], "author string, first_seen long")
    assert {r["author"]: r["author_id"] for r in dataset.author_vocabulary(rows).collect()} == {"a": 0, "c": 1, "b": 2}


def test_brief_filters(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [("r", words(9)), ("r", words(10)), ("r", words(80)), ("r", words(81)), ("r", words(10) + " edited by x")]
    got = evalset.attrition(evalset.judged_briefs(spark.createDataFrame(rows, "register string, brief string"))).first()
    assert (got["raw"], got["dropped_length"], got["dropped_leakage"], got["kept"]) == (5, 2, 1, 2)


def test_split_differences(spark):
    a = spark.createDataFrame([("r", 0), ("r", 1), ("s", 2)], "register string, split int")
    b = spark.createDataFrame([("r", 0), ("r", 1), ("s", 0), ("t", 0)], "register string, split int")
    assert {r["register"]: r["same"] for r in evalset.split_differences(a, b).collect()} == {"r": True, "s": False, "t": False}


def test_instruction_probe_stops_with_the_pool(spark):
    pool = spark.createDataFrame([("p", k, f"b{k}") for k in range(3)], "path string, chunk_idx int, brief string")
    got = evalset.instruction_probe(pool, evalset.constraints(spark)).orderBy("place").collect()
    assert [r["brief_id"] for r in got] == ["instr-00-first_person", "instr-01-named_eleanor", "instr-02-weather"]
    assert got[0]["brief"].endswith("Use first-person past-tense narration.")


def test_word_windows(spark):
    docs = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in (0, 249, 250, 500, 749, 750)], "doc_id long, text string")
    got = {r["doc_id"]: r["count"] for r in classifier.word_windows(docs).groupBy("doc_id").count().collect()}
    assert got == {250: 1, 500: 1, 749: 1, 750: 2}


def test_group_split_cuts_no_group(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("doc_id"), "id")
    got = classifier.group_split(rows)
    sides = got.groupBy("doc_id").agg(F.countDistinct("is_test").alias("n")).collect()
    assert {r["n"] for r in sides} == {1}
    assert got.where("is_test").select("doc_id").distinct().count() == 10


def test_confusion_and_report(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, predicted string")
    cells = {(r["label"], r["predicted"]): (r["n"], r["row_pct"]) for r in classifier.confusion(rows).collect()}
    assert cells[("a", "b")] == (1, 50.0)
    assert cells[("c", "c")] == (0, 0.0)
    report = {r["class"]: r for r in classifier.class_report(rows).collect()}
    assert report["b"]["precision"] == pytest.approx(1 / 3)
    assert report["c"]["f1"] == 0
    assert report["accuracy"]["f1"] == 0.5
    assert report["weighted avg"]["recall"] == 0.5


def test_constraint_checks(spark):
    rows = [("Is it?", "ends_question", True), ("No.", "ends_question", False), ("“x”", "no_dialogue", False), ("I went", "first_person", True), ("x", "weather", None)]
    df = spark.createDataFrame(rows, "text string, constraint_id string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", evalset.checks_constraint()).collect())


def test_chunks_lose_no_token(spark):
    docs = views.chapters(spark, SMALL)
    want = docs.agg(F.sum(tokenizers.token_count(F.col("text")))).first()[0]
    made = views.chunks(spark, SMALL)
    assert made.agg(F.sum(tokenizers.token_count(F.col("text")))).first()[0] == want
    assert made.agg(F.max("n_tokens")).first()[0] <= views.CHUNK_TOKENS
    assert registry.QUERIES["greedy_chunks"](spark, SMALL).count() == made.count()
    # The SQL has texts of long paragraphs too.
    assert docs.where(F.exists(F.split("text", "\n"), lambda p: tokenizers.token_count(p) > views.CHUNK_TOKENS)).count() > 10


def test_tfidf_by_brute_force(spark):
    import re
    from collections import Counter

    folder = SMALL.replace("0.001", "0.01")
    rows = classifier.word_windows(views.chapters(spark, folder)).collect()
    df, total = Counter(), Counter()
    for r in rows:
        w = [x.lower() for x in re.findall(r"[a-zA-Z][a-zA-Z'-]*[a-zA-Z]|[a-zA-Z][a-zA-Z]", r["window"])]
        tf = Counter([*w, *map(" ".join, zip(w, w[1:], strict=False))])
        df.update(tf.keys())
        total.update(tf)
    best = sorted((t for t in df if df[t] >= 5), key=lambda t: (-total[t], t))[:20_000]
    got = {r["term"]: (r["df"], r["total"]) for r in registry.QUERIES["tfidf_terms"](spark, folder).collect()}
    assert got == {t: (df[t], total[t]) for t in best}
    assert len(got) > 2000
    weighed = registry.QUERIES["tfidf_weights"](spark, folder)
    assert weighed.agg(F.sum("n")).first()[0] == sum(df[t] for t in best)


def test_the_style_classifier_is_the_reference_s(spark, monkeypatch):
    seen = {}
    for name, at in (("word_windows", 1), ("vocabulary", 2), ("train", 3)):
        f = getattr(classifier, name)
        monkeypatch.setattr(classifier, name, lambda *a, _f=f, _n=name, _at=at, **k: seen.update({_n: (a[_at:], k)}) or _f(*a, **k))
    assert registry.QUERIES["style_classifier"](spark, SMALL).count() > 0
    assert seen == {"word_windows": ((), {}), "vocabulary": ((), {}), "train": ((), {})}
