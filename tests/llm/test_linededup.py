import dataclasses
import hashlib
import random

import numpy as np
import pytest
from quillmill.llm import linededup as L
from quillmill.llm.cuckoo import CuckooFilter, Full, built

BLANK = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(BLANK).translate(UPPER)
            if d is not None and len(key) >= 10:
                holders.setdefault(key, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(h := holders.get(x.strip(BLANK).translate(UPPER), ())) < 2 or min(h) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def report(df, index=None):
    r = L.dedup_report(df) if index is None else L.line_report(df, index)
    return sorted(map(tuple, r.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    pool = [f"  Line number {k} Of Many \t" for k in range(60)] + ["short", "ÀÉ accented ÉÀ line", "", "\x0bvertical tab line\x0c"]
    docs = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.3 else f"own line {k} {j} text" for j in range(rng.randint(1, 15)))) for k in range(150)]
    return [*docs, (3, "LINE NUMBER 5 of many\nsecond part of three"), (None, "Line number 5 of many"), (500, None), (501, "")]


def test_by_brute_force(spark, rows):
    assert report(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_edges(edge, none):
    assert report(edge) == brute([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert report(none) == []
    out = L.without_repeats(edge, L.new_index(edge))
    assert out.columns == edge.columns
    assert out.count() == edge.count()
    assert next(r for r in out.collect() if r["doc_id"] == 2)["text"] is None


def as_rows(index):
    return sorted(map(tuple, index.counts.collect())), sorted(map(tuple, index.postings.collect()))


def test_insertions_and_deletions_are_reversible(spark, rows):
    rows = [r for r in rows if r[0] is not None]
    df = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    first, second = [r for r in rows if r[0] % 3], [r for r in rows if r[0] % 3 == 0]
    both = L.insert(L.new_index(df(first)), df(second))
    whole = L.new_index(df(first + second))
    assert as_rows(both) == as_rows(whole)
    assert report(df(first + second), both) == brute(first + second)
    back = L.delete(both, df(second))
    assert as_rows(back) == as_rows(L.new_index(df(first)))
    assert report(df(first), back) == brute(first)
    again = L.insert(back, df(second))
    assert as_rows(again) == as_rows(whole)
    # Every key that is counted is known to its filter; keys that left mostly are not.
    filters = {r["shard"]: CuckooFilter.from_bytes(r["filter"]) for r in again.filters.collect()}
    for r in again.counts.select("key", L._shard(again.shards).alias("shard")).collect():
        assert filters[r["shard"]].contains(np.array([int.from_bytes(r["key"][:8], "little", signed=True)], np.int64))[0]


def test_inserting_a_document_again_changes_nothing(spark, rows):
    rows = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    once = L.new_index(df, batches=3)
    assert as_rows(once) == as_rows(L.new_index(df))
    twice = L.insert(once, df.where("doc_id < 70"))
    assert as_rows(twice) == as_rows(once)
    # A new version of a document adds the keys that it didn't hold, and no others.
    more = L.insert(once, spark.createDataFrame([(1, rows[1][1] + "\na line of the second version")], "doc_id long, text string"))
    assert more.counts.count() == once.counts.count() + 1
    assert more.counts.agg({"refs": "sum"}).first()[0] == once.counts.agg({"refs": "sum"}).first()[0] + 1


def test_the_verdict_comes_through_the_filters(spark, rows):
    """Filters that have forgotten their keys let repeats pass as new."""
    df = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string")
    first, second = df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1")
    index = L.new_index(first)
    emptied = [(r["shard"], bytes(len(r["filter"]))) for r in index.filters.collect()]
    broken = dataclasses.replace(index, filters=spark.createDataFrame(emptied, "shard int, filter binary"))
    want = brute([tuple(r) for r in df.collect()])
    assert report(df, L.insert(index, second)) == want
    assert report(df, L.insert(broken, second)) != want


def test_shards_grow_with_the_keys(spark, monkeypatch):
    monkeypatch.setattr(L, "_KEYS_PER_SHARD", 4)
    monkeypatch.setattr(L, "_MIN_SHARDS", 2)
    rows = [(k, f"line of document {k} alone\nline that all of them share {k % 3}") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small = L.new_index(df.where("doc_id < 8"))
    grown = L.insert(small, df.where("doc_id >= 8"))
    assert small.shards == 3 and grown.shards == 26 and grown.filters.count() <= 26
    assert report(df, grown) == brute(rows)


def test_emptied_documents_may_go(spark):
    rows = [(1, "a line that is repeated"), (2, "A line that is repeated\n \n"), (3, ""), (4, None), (5, "a line that is repeated\nand one of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in L.without_repeats(df, L.new_index(df), drop_emptied=True).collect()}
    assert out == {1: rows[0][1], 3: "", 4: None, 5: "and one of its own"}


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys, other = rng.integers(-(2**63), 2**63, 20_000), rng.integers(-(2**63), 2**63, 20_000)
    f = built(keys)
    assert f.contains(keys).all()
    assert f.contains(other).mean() < 0.001
    f = CuckooFilter.from_bytes(f.to_bytes())
    f.delete(keys[:10_000])
    assert f.contains(keys[10_000:]).all()
    assert f.contains(keys[:10_000]).mean() < 0.01
    f.delete(keys[10_000:])
    assert not f.table.any()
    with pytest.raises(Full):
        CuckooFilter(2).insert(rng.integers(-(2**63), 2**63, 100))
    assert not CuckooFilter.sized(0).contains(keys[:3]).any()
