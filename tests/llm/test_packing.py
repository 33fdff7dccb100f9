import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from quillmill.llm import packing
from quillmill.llm.vocabularies import byte_level, byte_level_added


def checked(rows, capacity=1024):
    """Sequences are gapless and within the capacity; gives how many there are."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences)


def best_fit(lengths, capacity):
    """Best-fit decreasing over single pieces."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_is_best_fit_over_counts(lengths):
    slots, made = packing.plan(dict(Counter(lengths)), 30)
    assert made == best_fit(lengths, 30)
    rows, ranks = [], defaultdict(list)
    for n, lo, hi, first, offset in slots:
        ranks[n] += range(lo, hi)
        rows += [{"sequence_id": first + k, "offset": offset, "length": n} for k in range(hi - lo)]
    assert checked(rows, 30) == made
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(k)) for n, k in Counter(lengths).items()}


def test_plan_of_a_histogram_is_small():
    slots, _ = packing.plan({n: 10**9 + n for n in range(1, 1025)})
    assert len(slots) < 20_000


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_by_the_tokenizers_library(spark, tokenizer):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    df = df.unionByName(spark.createDataFrame([(-1, "x <|endoftext|> y"), (-2, "<|endoftext|>" * 1100)], df.schema))
    rows = packing.best_fit_sequences(df, byte_level(), added=byte_level_added()).collect()
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for r in df.collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        cuts = [0, *range(first, len(ids), 1024), len(ids)] if first else list(range(0, len(ids) + 1, 1024))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r["doc_id"], k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert got == want
    lengths = [v[1] for v in want.values()]
    n = checked(rows)
    assert n == best_fit(lengths, 1024)
    assert n <= -(-sum(lengths) // 1024) + 1


def test_added_tokens_by_the_default_tokenizer(spark, tmp_path):
    from quillmill.llm import queries
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    parts = ["<|endoftext|>", " ", "a", "é🙂", "\n\n", "<|", "endoftext|>", " word", "<|endoftext|", "x  y"]
    texts = ["a <|endoftext|> b", *("".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(300))]
    spark.createDataFrame([(k, x, "en", "src0", len(x)) for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: [*t.encode(x, add_special_tokens=False).ids, 2] for k, x in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 2]
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in queries.op8_best_fit_packing(spark, str(tmp_path)).collect()}
    assert got == {k: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in want.items()}
    assert byte_level_added() == {"<|endoftext|>": 50256}


def test_edges(edge, none, tokenizer):
    rows = packing.best_fit_sequences(edge, byte_level(), added=byte_level_added()).collect()
    checked(rows)
    for r in edge.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        if len(ids) <= 1024:
            assert (len(ids), zlib.crc32(ids.tobytes())) in {(x["length"], x["ids_crc32"]) for x in rows if x["doc_id"] == r["doc_id"]}
    starts = Counter(r["doc_id"] for r in rows if r["piece"] == 0)
    assert starts == Counter(r["doc_id"] for r in edge.collect())
    assert {r["length"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert packing.best_fit_sequences(none, byte_level()).count() == 0


def test_slots_by_shuffle_are_the_same(spark):
    df = spark.range(500).selectExpr("id AS doc_id", "repeat('word ', cast(1 + id % 7 AS int)) AS text")
    parts = packing.pieces(df, byte_level(), 2)
    placed = lambda rows: sorted((r["doc_id"], r["sequence_id"], r["offset"]) for r in rows.collect())
    assert placed(packing.packed(parts, 64)) == placed(packing.packed(parts, 64, most_broadcast=0))


def test_one_hot_length(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "'same words here' AS text")
    rows = packing.best_fit_sequences(df, byte_level()).collect()
    each = 1024 // rows[0]["length"]
    assert checked(rows) == -(-3000 // each)


@pytest.mark.parametrize(("n", "want"), [(5, [5]), (10, [10]), (11, [1, 10]), (20, [10, 10]), (25, [5, 10, 10])])
def test_piece_lengths(n, want):
    assert packing.piece_lengths(n, 10) == want
