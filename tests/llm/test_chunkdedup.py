import random

import numpy as np
import pytest
from quillmill.llm import chunkdedup as C


def text(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """60 documents; passages of 55 to 80 words stand in two or three of the first 40."""
    rng = random.Random(7)
    docs = [text(rng, rng.randint(100, 300)).split() for _ in range(60)]
    held = set()
    for _ in range(15):
        passage = text(rng, rng.randint(55, 80)).split()
        for d in rng.sample(range(40), rng.randint(2, 3)):
            docs[d][(at := rng.randrange(len(docs[d]))) : at] = passage
            held.add(d)
    return [(k, " ".join(w)) for k, w in enumerate(docs)], held


def test_planted_passages(spark, rows):
    docs, held = rows
    got = C.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == held
    texts = dict(docs)
    for r in got:
        assert texts[r["doc_id"]][r["start"] : r["stop"]] in texts[r["doc_id"]]
        assert r["n_words"] >= C.Chunking().least_words


def test_white_space_doesn_t_matter(spark):
    rng = random.Random(1)
    passage = text(rng, 60)
    docs = [(1, text(rng, 50) + "\n" + passage), (2, text(rng, 40) + " \t" + passage.replace(" ", "\n "))]
    got = C.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {1, 2}


def test_chunks_cover_the_text():
    rng = random.Random(2)
    for t in ["", "a", "é" * 400, "x" * 1000, text(rng, 500), "ab" * 999 + "🙂" * 99]:
        data, place = C.squeezed(np.frombuffer(t.encode(), np.uint8))
        ends = C.chunk_ends(data, C.Chunking())
        assert ends == sorted(set(ends))
        assert (ends[-1] if ends else 0) == len(data)
        assert all(b - a <= C.Chunking().most + 3 for a, b in zip([0, *ends], ends, strict=False))
        data.tobytes()[: ends[0] if ends else 0].decode()


def test_an_insertion_moves_few_chunks():
    t = text(random.Random(3), 2000)
    cut = lambda x: {x[a:b] for e in [C.chunk_ends(np.frombuffer(x.encode(), np.uint8), C.Chunking())] for a, b in zip([0, *e], e, strict=False)}
    a, b = cut(t), cut(t[:5000] + "INSERTED" + t[5000:])
    assert len(a - b) <= 6


def test_gear_hash_is_the_rolling_one():
    data = np.frombuffer(b"the quick brown fox jumps over it", np.uint8)
    h, want = 0, []
    for x in data:
        h = (2 * h + int(C._GEAR[x])) % 2**16
        want.append(h)
    assert C.gear_hashes(data).tolist() == want


def test_edges(edge, none):
    got = C.repeated_runs(edge).collect()
    assert {r["doc_id"] for r in got} == {1, 7}  # the row without an id takes no part
    assert C.repeated_runs(none).count() == 0
    cut = C.without_repeated_runs(edge)
    assert cut.columns == edge.columns
    assert cut.count() == edge.count()
    assert C.without_repeated_runs(none).count() == 0


def test_repeats_within_a_document_are_none(spark):
    t = text(random.Random(4), 60)
    assert C.repeated_runs(spark.createDataFrame([(1, t + " " + t), (1, t)], "doc_id long, text string")).count() == 0


def scalar_chunks(text, c=C.Chunking()):
    """(start, stop) in code points, words and bytes of every chunk, byte by byte."""
    data, place, points = bytearray(), [], 0
    for ch in text:
        points += 1
        blank = ch in " \t\n\x0b\x0c\r"
        if blank and data and data[-1] == 32:
            continue  # the run's first stands for it, and keeps its place
        for x in (b" " if blank else ch.encode()):
            data.append(x)
            place.append(points)
    ends_char = [k + 1 == len(data) or data[k + 1] & 0xC0 != 0x80 for k in range(len(data))]
    h, hashes = 0, []
    for x in data:
        h = (2 * h + int(C._GEAR[x])) % 2**16
        hashes.append(h)
    out, at = [], 0
    while at < len(data):
        end = next((k + 1 for k in range(at + c.least - 1, min(len(data), at + c.most)) if ends_char[k] and hashes[k] >> (16 - c.bits) == 0), None)
        if end is None and len(data) <= at + c.most:
            end = len(data)
        elif end is None:
            reach = [(hashes[k] if ends_char[k] else 0xFFFF, -k) for k in range(at + c.least - 1, at + c.most)]
            end = -min(reach)[1] + 1
            while not ends_char[end - 1]:
                end += 1
        words = sum(data[k] != 32 and (k == 0 or data[k - 1] == 32) for k in range(at, end))
        out.append((place[at - 1] if at else 0, place[end - 1], words, bytes(data[at:end])))
        at = end
    return out


def brute(docs, c=C.Chunking()):
    """All listed runs, without Spark, digests or arrays."""
    cut, holders = {d: scalar_chunks(t) for d, t in docs.items()}, {}
    for d, parts in cut.items():
        for p in parts:
            holders.setdefault(p[3], set()).add(d)
    out = []
    for d, parts in cut.items():
        run = []
        for p in [*parts, (0, 0, 0, b"")]:
            if len(holders.get(p[3], ())) > 1:
                run.append(p)
                continue
            if sum(x[2] for x in run) >= c.least_words:
                k = 0
                while k < len(run):
                    own = min(holders[run[k][3]]) == d
                    stop = k
                    while stop < len(run) and (min(holders[run[stop][3]]) == d) == own:
                        stop += 1
                    out.append((d, run[k][0], run[stop - 1][1], stop - k, sum(x[2] for x in run[k:stop]), min(holders[run[k][3]])))
                    k = stop
            run = []
    return sorted(out)


def test_all_rows_by_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = {r["doc_id"]: r["text"] for r in df.collect()}
    want = brute(docs)
    assert want
    assert sorted(map(tuple, C.repeated_runs(df).collect())) == want


def test_all_rows_of_planted_and_odd_texts(spark, rows):
    docs = dict(rows[0]) | {100: "x" * 900, 101: "x" * 700 + " y", 102: "é" * 300, 103: "é" * 400, 104: " \t", 105: "🙂 \n a" * 200, 106: "🙂 a" * 300}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert sorted(map(tuple, C.repeated_runs(df).collect())) == brute(docs)


def test_what_is_reported_is_shared(spark, rows):
    """Precision: the text of every run stands in another document, in pieces if several share it."""
    docs = dict(rows[0])
    df = spark.createDataFrame(rows[0], "doc_id long, text string")
    squeeze = lambda t: " ".join(t.split())
    for r in C.repeated_runs(df).collect():
        words = squeeze(docs[r["doc_id"]][r["start"] : r["stop"]]).split()[1:-1]
        elsewhere = [squeeze(t) for d, t in docs.items() if d != r["doc_id"]]
        shared = sum(any(" ".join(words[k : k + 5]) in t for t in elsewhere) for k in range(len(words) - 4))
        assert shared >= 0.9 * (len(words) - 4)


def test_a_passage_in_a_third_of_all_documents(spark, monkeypatch):
    rng = random.Random(11)
    passage = text(rng, 60)
    docs = {k: text(rng, 20) + (" " + passage if k % 3 == 0 else "") + " " + text(rng, 20) for k in range(300)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert sorted(map(tuple, C.repeated_runs(df).collect())) == brute(docs)


def test_each_chunk_stays_with_its_first_holder(spark):
    rng = random.Random(5)
    a, b = text(rng, 70), text(rng, 70)
    docs = [(1, text(rng, 30) + " " + a + " " + text(rng, 30)), (2, a + " " + b + " " + text(rng, 30)), (3, text(rng, 30) + " " + b)]
    left = {r["doc_id"]: r["text"] for r in C.without_repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    middle = lambda t: " ".join(t.split()[20:-20])
    assert middle(a) in left[1] and middle(a) not in left[2]
    assert middle(b) in left[2] and middle(b) not in left[3]


def test_recall_on_documents(spark):
    """Against all shared runs of 51 words, by a set of word windows."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = {r["doc_id"]: r["text"].split() for r in df.collect()}
    first, shared = {}, set()
    for d, w in docs.items():
        for k in range(len(w) - 50):
            key = hash(tuple(w[k : k + 51]))
            if first.setdefault(key, d) != d:
                shared |= {d, first[key]}
    got = {r["doc_id"] for r in C.repeated_runs(df).select("doc_id").distinct().collect()}
    assert len(shared & got) >= 0.99 * len(shared)
