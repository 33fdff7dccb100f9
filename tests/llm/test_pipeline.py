from collections import Counter

import corpus_pipeline as P
import pytest
from quillmill.llm import neardup, quality, secrets
from test_linededup import BLANK, UPPER
from test_neardup import brute as brute_classes
from test_packing import best_fit, checked

SF = "/root/testdata/sf0.001"


def dedup_lines(docs):
    holders = {}
    for d, t in docs.items():
        for line in t.split("\n"):
            key = line.strip(BLANK).translate(UPPER)
            if len(key) >= 10:
                holders.setdefault(key, set()).add(d)
    keep = lambda d, x: len(h := holders.get(x.strip(BLANK).translate(UPPER), ())) < 2 or min(h) == d
    left = {d: "\n".join(x for x in t.split("\n") if keep(d, x)) for d, t in docs.items()}
    return {d: t for d, t in left.items() if t.strip() or t == docs[d]}  # what is emptied goes


def redact(t):
    found, out, done = secrets.Scanner()(t), [], 0
    for s, k, e in found:
        if s >= done:
            out += [t[done:s], f"[{secrets.RULES[k].kind}]"]
        done = max(done, e)
    return "".join([*out, t[done:]])


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for k, (name, f) in enumerate(P.STAGES):
        f(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append((name, docs))
    return out


def test_each_stage_by_brute_force(spark, stages, duck):
    from quillmill.llm.oracles import ORACLES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [{r["doc_id"]: r["text"] for r in df.collect()} for _, df in stages[:4]]
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({ORACLES['op9_quality_rules']}) WHERE kept").fetchall()}
    assert got[0] == {d: t for d, t in texts.items() if d in kept}
    assert got[1] == dedup_lines(got[0])
    classes = brute_classes(list(got[1]), list(got[1].values()))
    assert got[2] == {d: t for d, t in got[1].items() if classes[d] == d}
    assert got[3] == {d: redact(t) for d, t in got[2].items()}


def test_columns_and_lengths(spark, stages):
    for _, df in stages[:4]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert df.where("n_chars <> length(text)").isEmpty()


def test_packing_of_what_is_left(stages):
    rows = stages[4][1].collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stages[3][1].collect()}
    assert checked(rows) == best_fit([r["length"] for r in rows], 1024)


def test_run_gives_the_stages_rows(spark, stages):
    key = lambda df: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(P.run(spark, SF)) == key(stages[4][1])


def test_stages_take_any_columns_and_nothing(spark, edge, none):
    for docs in (edge, none):
        for _, f in P.STAGES[:4]:
            out = f(spark, docs, SF)
            assert out.columns == docs.columns
            out.collect()
        P.STAGES[4][1](spark, docs, SF).collect()


def test_order_of_stages():
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "near-dedup", "secret scans", "best-fit packing"]
    assert P.ORACLE_SQL is None
    assert quality and neardup
