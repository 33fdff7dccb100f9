import base64
import hashlib
import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from quillmill.llm import bpe
from quillmill.llm.vocabularies import byte_level


@pytest.fixture(scope="module")
def reference():
    path, pattern = byte_level()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def small():
    return bpe.Codec(*byte_level(), leaf=5, least=3)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 'sté9\n\t.!  \x1c🙂lld")), max_size=120))
def test_tree_equals_the_library(reference, small, text):
    ids = small.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert small.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_characters(reference, small, text):
    assert small.encode(text) == reference.encode_ordinary(text)


@pytest.mark.parametrize("text", ["x" * 3000, " " * 3000, "ab" * 500 + " " * 700 + "!" * 900, "word " * 4000, "<|endoftext|> a"])
def test_long_runs(reference, small, text):
    assert small.encode(text) == reference.encode_ordinary(text)
    assert bpe.Codec(*byte_level()).encode(text * 20) == reference.encode_ordinary(text * 20)


def test_long_matches_join_in_small_windows(reference):
    """A match without a seam in sight is reduced up the tree, and merges look at few bytes each."""
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij") for _ in range(40_000))
    c, most = bpe.Codec(*byte_level()), 0
    merged = c._merged

    def watched(data):
        nonlocal most
        most = max(most, len(data))
        return merged(data)

    c._merged = watched
    assert c.encode(text) == reference.encode_ordinary(text)
    assert most <= 4 * bpe.LEAST and c.joins == -(-len(text) // bpe.LEAF) - 1
    for run in ("=" * 50_001, "ab" * 20_000, "\x00" * 3000):
        assert c.encode(run) == reference.encode_ordinary(run)


def test_windows_of_any_size(small):
    """Both ways to merge give the same tokens."""
    rng = random.Random(5)
    for n in (1, 2, 70, 400):
        data = "".join(rng.choice("the ring=é") for _ in range(n)).encode()
        whole = small._merged_long(data)
        small.least, was = 10**9, small.least
        assert small._merged(data) == whole
        small.least = was


def test_most_documents_go_through_the_tree():
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    c, joined = bpe.Codec(*byte_level()), 0
    for t in docs:
        before = c.joins
        c.encode(t)
        joined += c.joins > before
    assert joined > 0.6 * len(docs)
    assert "tiktoken" not in Path(bpe.__file__).read_text()


def test_results_may_be_forgotten(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    text = "one two three four five, six! seven eightnineten\n" * 30
    assert bpe.Codec(*byte_level(), leaf=7, least=2).encode(text) == reference.encode_ordinary(text)


def test_documents(spark, reference):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    rows = bpe.round_trip_digests(df, *byte_level()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["round_trip"]


def test_edges(edge, none):
    rows = bpe.round_trip_digests(edge, *byte_level()).collect()
    assert len(rows) == edge.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, empty, empty) for r in rows if r["doc_id"] in (2, 3))
    assert bpe.round_trip_digests(none, *byte_level()).count() == 0


def test_columns_of_ids(edge):
    ids = bpe.encoded(edge.select("doc_id", "text"), *byte_level())
    back = bpe.decoded(ids, *byte_level()).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
