import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillmill.llm import neardup
from quillmill.llm.components import components
from quillmill.llm.shingles import document_shingles


def classes(df, **k):
    return {r["doc_id"]: r["class_id"] for r in neardup.near_duplicate_classes(df, **k).collect()}


def brute(ids, texts, s=neardup.Sampling()):
    """Connected components of all pairs above the threshold."""
    sets = list(document_shingles(pa.array(texts, pa.string()), s.size))
    df = np.zeros(1 << neardup._BITS, np.int64)
    for x, _ in sets:
        df[np.unique((x >> np.uint64(64 - neardup._BITS)).astype(np.int64))] += 1
    logs = neardup.log_idf(df, len(texts), s)
    weighted = [(x, np.exp(neardup.log_weights(x, c, logs))) for x, c in sets]
    up = dict(zip(ids, ids, strict=True))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and neardup.weighted_jaccard(weighted[i], weighted[j]) >= s.threshold - 1e-12:
                a, b = sorted((top(ids[i]), top(ids[j])))
                up[b] = a
    return {k: top(k) for k in ids}


def test_documents_by_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    assert classes(df) == brute([r["doc_id"] for r in rows], [r["text"] for r in rows])


@pytest.fixture(scope="module")
def planted():
    """Groups of copies with edits of many sizes, and documents of their own."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(5, 200))) for _ in range(60)]
    base = rng.choices(words, k=150)
    for n in (*[0] * 3, *[1] * 20, *[2] * 30, *[3] * 30, 5, 8, 13, 40):
        copy = list(base)
        for _ in range(n):
            copy[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(copy))
    for t in texts[:20]:
        parts = t.split()
        parts[len(parts) // 2] = "changed"
        texts.append("\n".join(parts))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_planted_groups_by_brute_force(spark, planted):
    got = classes(spark.createDataFrame(planted, "doc_id long, text string"))
    assert got == brute([k for k, _ in planted], [t for _, t in planted])


def test_blocks_don_t_change_the_result(spark, planted):
    df = spark.createDataFrame(planted, "doc_id long, text string")
    assert classes(df, s=neardup.Sampling(block_members=8, block_elements=1000)) == classes(df)


def test_similarities_are_exact():
    rng = np.random.default_rng(1)
    logs = np.log(rng.random(1 << neardup._BITS) + 0.1).astype(np.float32)
    vocabulary = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.sort(rng.choice(vocabulary, rng.integers(1, 80))) for _ in range(12)]
    got = neardup.similarities(sets, logs, columns=7)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                wa, wb = (((u := np.unique(x, return_counts=True))[0], np.exp(neardup.log_weights(*u, logs))) for x in (a, b))
                assert got[i, j] == pytest.approx(neardup.weighted_jaccard(wa, wb))


@pytest.mark.parametrize("share", [0.2, 0.4, 0.6, 0.8, 0.9, 0.96])
def test_samples_estimate_weighted_similarity(share):
    """Dealt into bins or not, samples agree as often as the sets are similar, with uneven weights too."""
    rng, s, errors = np.random.default_rng(2), neardup.Sampling(), []
    for _ in range(40):
        n = int(rng.integers(200, 900))
        both, own = int(n * share), n - int(n * share)
        common = rng.integers(0, 2**63, both).astype(np.uint64)
        a, b = (np.r_[common, rng.integers(0, 2**63, own).astype(np.uint64)] for _ in range(2))
        w = np.r_[rng.uniform(0.75, 4, both), rng.uniform(0.75, 4, own)]
        codes = neardup.samples(np.r_[a, b], np.log(np.r_[w, w]), np.repeat([0, 1], n), 2, s)
        true = w[:both].sum() / (w[:both].sum() + 2 * w[both:].sum())
        errors.append((codes[0] == codes[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.015
    assert np.std(errors) < 0.06  # 128 independent samples have at most 0.044


def test_weights_follow_the_inverse_frequency_in_bounds():
    s, n = neardup.Sampling(), 1_000_000
    w = np.exp(neardup.log_idf(np.array([1, 100, 1000, 10_000, 100_000, 400_000, n]), n, s))
    assert w[0] == pytest.approx(1) and w[1] == pytest.approx(1) and w[-1] == pytest.approx(0.75)
    assert (np.diff(w[1:]) < -0.01).all()
    assert np.diff(w[1:5]) == pytest.approx([-1 / 16] * 3)  # a tenfold share costs a quarter of a quarter


def test_copies_in_a_group_of_a_third_are_found(spark):
    """Every two members differ in edits of their own; what they share is as frequent as boilerplate."""
    rng = random.Random(8)
    base, rows = [f"b{k}" for k in range(200)], []
    for k in range(300):
        words = [f"x{k}y{j}" for j in range(200)]
        if k % 3 == 0:
            words = list(base)
            for at in rng.sample(range(5, 195), 1):
                words[at] = f"edit{k}"
        rows.append((k, " ".join(words)))
    got = classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {got[k] for k in range(0, 300, 3)} == {0}
    assert all(got[k] == k for k in range(300) if k % 3)


def test_other_ids_are_refused(spark):
    with pytest.raises(TypeError, match="whole number"):
        neardup.near_duplicate_classes(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_edges(edge, none):
    got = neardup.near_duplicate_classes(edge).collect()
    assert len(got) == edge.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert by[1] == {1}
    assert by[2] == {2}
    assert by[3] == {3}
    assert by[None] == {None}
    assert by[7] == {1}
    assert neardup.near_duplicate_classes(none).count() == 0


def test_representatives_keep_rows_and_columns(edge):
    kept = neardup.representatives(edge)
    assert kept.columns == edge.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 1, 2, 3, 4, 5, 6, 8, None]


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40) if k % 10] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "doc long, rep long")).collect()}
    assert got[40] == 31
    assert got[20] == 11
    assert got[200] == got[150] == 100
    assert components(spark.createDataFrame([], "doc long, rep long")).count() == 0


def test_hot_copies_are_one_node(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text that a third of all rows share among them").otherwise(F.concat(F.lit("own "), F.md5(F.col("id").cast("string").cast("binary")))).alias("text"))
    got = classes(df)
    assert {got[k] for k in range(0, 3000, 3)} == {0}
    assert all(got[k] == k for k in range(3000) if k % 3)


def test_punctuation_and_case_don_t_matter(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in rng.sample(range(900), 120)]
    other = " ".join(w.title() + rng.choice([".", ",", "", "!"]) for w in words)
    rows = [(5, " ".join(words)), (6, other), (7, "*** --- $$$"), (8, "*** --- $$$"), (9, "--- *** %%%")]
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == {5: 5, 6: 5, 7: 7, 8: 7, 9: 9}


def test_words_by_hand():
    from quillmill.llm.shingles import word_hashes

    h, at = word_hashes(pa.array(["Don't stop, STOP!", None, "*** dont É", "é"]))
    assert at.tolist() == [0, 3, 3, 6, 7]
    assert h[0] == h[4]
    assert h[1] == h[2]
    assert h[5] == h[6]
    assert len({*h.tolist()}) == 4
