import math
import random

from pyspark.sql import functions as F
from quillmill.llm import quality as Q


def measures(t):
    import re

    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(windows) < 3000 else None
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), None if hit is None else len(hit)


def test_measures_by_brute_force(spark, labels):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "b", "c#", "dé", "\n", "\t\x0b", "E*"], k=rng.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in Q.quality_verdicts(df, labels).collect():
        assert tuple(r[1:6]) == measures(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def corpus(spark, share, n=4000, n_bad=300):
    """Good documents of which a share have many symbols, and bad ones that all do; distinct words."""
    rng = random.Random(0)
    rows, labels = [], []
    for k in range(n + n_bad):
        words = [f"w{k}x{j}" for j in range(60)]
        if k >= n or rng.random() < share:
            words[:30] = [w + "#" for w in words[:30]]
        rows.append((k, " ".join(words), "en"))
        labels.append((k, int(k < n)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def cutoffs(df, labels, config=Q.RiskConfig()):
    measured, m = Q.with_measures(df)
    return {(r["stratum"], r["rule"]): r for r in Q.certified_cutoffs(measured, m, "lang", "doc_id", labels, config).collect()}


def test_certified_cutoffs_reject_the_bad_and_keep_the_good(spark):
    df, labels = corpus(spark, 0.0)
    got = cutoffs(df, labels)
    r = got["en", "symbols"]
    assert r["cutoff"] <= 0.4
    a, levels = 0.02 / 4, 4
    assert r["p_value"] <= 0.05 / levels
    exact = sum(math.comb(r["n"], i) * a**i * (1 - a) ** (r["n"] - i) for i in range(r["rejected"] + 1))
    assert math.isclose(exact, r["p_value"], rel_tol=1e-6)
    kept = Q.quality_verdicts(df, labels)
    assert kept.where("kept AND doc_id >= 4000").isEmpty()
    assert kept.where("NOT kept AND doc_id < 4000").count() <= 0.02 * 4000


def test_a_rule_that_would_reject_good_documents_is_not_certified(spark):
    df, labels = corpus(spark, 0.03)
    assert ("en", "symbols") not in cutoffs(df, labels) or cutoffs(df, labels)["en", "symbols"]["cutoff"] >= 0.5


def test_few_labels_certify_nothing(spark):
    df, labels = corpus(spark, 0.0, 200, 50)
    assert cutoffs(df, labels) == {}
    assert Q.quality_verdicts(df, labels).where("NOT kept").isEmpty()


def test_few_labels_certify_all_rules_together(spark):
    df, labels = corpus(spark, 0.0, 400, 50)
    config = Q.RiskConfig(joint=True)
    assert cutoffs(df, labels) == {}
    got = cutoffs(df, labels, config)
    assert set(got) == {("en", r) for r in config.ladders}
    assert {(r["n"], r["rejected"]) for r in got.values()} == {(400, 0)}
    assert all(math.isclose(r["p_value"], 0.98**400, rel_tol=1e-6) for r in got.values())
    kept = Q.quality_verdicts(df, labels, config)
    assert kept.where("kept").count() == kept.where("kept AND doc_id < 400").count() == 400
    assert Q.keep_good(df, labels, config).count() == 400


def test_rules_together_keep_the_bound(spark):
    df, labels = corpus(spark, 0.03, 400, 50)
    got = cutoffs(df, labels, Q.RiskConfig(joint=True))
    assert all(r["p_value"] <= 0.05 / 4 for r in got.values())
    assert ("en", "symbols") not in got or got["en", "symbols"]["cutoff"] >= 0.5
    df, labels = corpus(spark, 0.0, 200, 50)
    assert cutoffs(df, labels, Q.RiskConfig(joint=True)) == {}


def test_with_many_labels_nothing_is_joint(spark):
    df, labels = corpus(spark, 0.0)
    assert cutoffs(df, labels, Q.RiskConfig(joint=True)) == cutoffs(df, labels)


def test_joint_sets_are_nested():
    sets = Q.joint_sets(Q.RiskConfig())
    for a, b in zip(sets, sets[1:], strict=False):
        assert all(b[r] <= c for r, c in a.items())
    assert sets[-1] == {r: cs[-1] for r, cs in Q.RiskConfig().ladders.items()}


def test_edges(edge, none, labels):
    rows = Q.quality_verdicts(edge, labels).collect()
    assert len(rows) == edge.count()
    assert {r["stratum"] for r in rows} == {"en", "de", "fr", "und"}
    assert all(r["base_failed"] for r in rows if r["doc_id"] in (2, 3, 4))
    assert Q.quality_verdicts(none, labels).count() == 0
    assert Q.quality_verdicts(edge, labels.limit(0)).count() == edge.count()
    kept = Q.keep_good(edge, labels)
    assert kept.columns == edge.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted((r["doc_id"] for r in rows if r["kept"]), key=str)
    assert Q.keep_good(none, labels).count() == 0


def test_stage_and_query_agree(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in Q.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in Q.quality_verdicts(docs, labels).where("kept").collect()}
    good = labels.where("quality = 1").join(docs, "doc_id").select("doc_id", F.col("text"))
    lost = Q.quality_verdicts(docs, labels).where("NOT base_failed AND NOT kept").join(good, "doc_id").count()
    assert lost <= 0.02 * good.count()


def test_the_plan_is_native(spark, labels, edge):
    plan = Q.quality_verdicts(edge, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan
