import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillmill.functions import text as T
from quillmill.operators import algebra, generation, ingest, registers
from quillmill.sources import readers, writers
from quillmill.streaming import incremental


def works(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "work long, text string")


def words(n):
    return " ".join(["w"] * n)


def test_chapters_by_hand(spark):
    got = ingest.chapters(works(spark, f"preface\nCHAPTER I.\n{words(101)}\n  Chapter Two \n{words(100)}\n", f"CHAPTER 1\n{words(501)}", words(500), f"{words(200)}\nno heading CHAPTER\n{words(301)}", None)).collect()
    assert [(r["work"], r["chapter_num"], len(r["body"].split())) for r in got] == [(0, 1, 101), (1, 1, 503), (3, 1, 504)]


def test_heading_before_a_carriage_return_is_none(spark):
    assert ingest.chapters(works(spark, f"CHAPTER I\rx\n{words(101)}\nCHAPTER II\rx\n{words(101)}")).count() == 0


CATALOG = '''Text#,Type,Issued,Title,Language,Authors,Subjects,LoCC,Bookshelves
1,Text,,"Emma
a novel",en,"Austen, Jane, 1775-1817",,,
2,Text,,Emma,en,"Austen, Jane",,,
3,Text,,Other,en; fr,"Austen, Jane",,,
4,Sound,,Song,en,"Austen, Jane",,,
5,Text,,Heights,en,"Bronte, Emily",,,
,Text,,No id,en,"Austen, Jane",,,
6,Text,,???,en,"Le Fanu, Joseph Sheridan",,,
'''


def test_catalog_to_works(spark, tmp_path):
    path = tmp_path / "catalog.csv"
    path.write_text(CATALOG)
    rows = ingest.catalog_works(readers.catalog(spark, str(path)))
    found = ingest.author_works(rows, registers.author_dimension(registers.registers(spark)))
    assert sorted((r["author"], r["pg_id"]) for r in found.collect()) == [("Emily Brontë", "5"), ("Jane Austen", "1"), ("Jane Austen", "2"), ("Joseph Sheridan Le Fanu", "6")]
    fresh = {r["pg_id"]: (r["work_title"], r["work_slug"]) for r in ingest.new_works(found).collect()}
    assert fresh == {"1": ("Emma", "emma"), "5": ("Heights", "heights"), "6": ("???", "pg-6")}
    seen = spark.createDataFrame([("jane-austen", "emma")], "author_slug string, work_slug string")
    assert ingest.new_works(found, seen).count() == 2
    assert ingest.first_works(found, 1).count() == 3


def test_fetched_text(spark):
    df = spark.createDataFrame([("the Project Gutenberg x",), ("",), (None,), ("x" * 8000 + "Project Gutenberg",)], "t string")
    assert [r[0] for r in df.select(ingest.is_fetched_text(F.col("t"))).collect()] == [True, False, False, False]


def test_manifest_round_trip(spark, tmp_path):
    ch = spark.createDataFrame([("Jane Austen", "victorian-formal", "Emma", "emma", "1", 1, "a b c", "jane-austen")], "author string, cluster string, work_title string, work_slug string, pg_id string, chapter_num int, body string, author_slug string")
    m = ingest.manifest(ch)
    writers.json_lines(m, str(tmp_path / "m"))
    back = readers.manifest(spark, str(tmp_path / "m"), "victorian-formal")
    row = back.first()
    assert (row["path"], row["words"], row["chars"]) == ("source/jane-austen/emma/chapter-001.txt", 3, 5)
    assert ingest.extended_manifest(m, m).count() == 1
    assert readers.manifest(spark, str(tmp_path / "m"), "none").count() == 0
    writers.chapter_texts(ch, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).first()["body"] == "a b c"


def test_append_is_resumable(spark, tmp_path):
    rows = spark.createDataFrame([("p", 0, "b", "a", "c")], readers.BRIEFS)
    for _ in range(2):
        writers.append_new(rows, str(tmp_path / "b"), ["chapter_path", "chunk_idx"], readers.BRIEFS)
    assert readers.briefs(spark, str(tmp_path / "b")).count() == 1


def test_documents_and_sets(spark, tmp_path):
    writers.document(spark.createDataFrame([(1, "é")], "a int, b string"), str(tmp_path / "d"))
    part = next((tmp_path / "d").glob("part-*"))
    assert json.loads(part.read_text()) == {"a": 1, "b": "é"}
    rows = spark.createDataFrame([(0, [1]), (2, [2])], "split int, input_ids array<int>")
    writers.training_set(rows, str(tmp_path / "s"), {"seed": 42})
    assert readers.training_set(spark, str(tmp_path / "s"), "test", ("input_ids",)).first()["input_ids"] == [2]
    assert spark.read.json(str(tmp_path / "s.meta")).first()["seed"] == 42


def test_whole_texts_and_cache(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\ny")
    assert readers.whole_texts(spark, str(tmp_path / "in")).first()["text"] == "x\ny"
    url = (tmp_path / "in" / "a.txt").as_uri()
    cached = readers.cached_file(url, str(tmp_path / "cache" / "a"))
    (tmp_path / "in" / "a.txt").write_text("new")
    assert open(readers.cached_file(url, cached)).read() == "x\ny"
    assert open(readers.cached_file(url, cached, refresh=True)).read() == "new"


def test_projection(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 6)) * [9, 5, 1, 1, 1, 1]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    u = algebra.top_directions(rows, 2)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(u @ u.T, vt[:2].T @ vt[:2])
    out = rows.where("vec_id = 3").select(algebra.projected(F.col("embedding"), u).alias("p")).first()["p"]
    assert np.allclose(out, x[3] - u @ (u.T @ x[3]))
    assert algebra.top_directions(rows, 0).shape == (6, 0)


def test_redistribution(spark):
    rng = np.random.default_rng(1)
    w, a, b = rng.normal(size=(5, 4)), rng.normal(size=(2, 4)), rng.normal(size=(5, 2))
    u = algebra.top_left_singular(w, 2)
    assert u.shape == (5, 2)
    assert algebra.top_left_singular(w, 9).shape[1] <= 4
    new = algebra.redistributed(a, b, u, 0.0)
    assert np.allclose(new @ a, (np.eye(5) - u @ u.T) @ b @ a)
    df = spark.createDataFrame([("m", w.tolist(), a.tolist(), b.tolist())], "name string, weight array<array<double>>, a array<array<double>>, b array<array<double>>")
    assert np.allclose(algebra.reproject_adapters(df, 2).first()["b"], algebra.redistributed(a, b, u))
    share = algebra.parameter_share(spark.createDataFrame([("x", 3, True), ("y", 1, False)], "name string, size long, trainable boolean")).first()
    assert share["share"] == 0.75


def test_adapters(spark):
    rows = [("a", "x/checkpoint-90"), ("a", "x/checkpoint-250"), ("b", "x\\checkpoint-9"), ("b", "x\\final"), ("c", "x/other")]
    got = {r["register"]: r["path"] for r in generation.chosen_adapter(spark.createDataFrame(rows, "register string, path string")).collect()}
    assert got == {"a": "x/checkpoint-250", "b": "x\\final"}


def test_generation_plug(spark):
    rows = spark.createDataFrame([("A man. He",), ("",)], "text string")
    out = generation.synthesized_briefs(rows, lambda config: lambda prompts: [f"{p} Brief: said {len(p)} {config.temperature}\nmore" for p in prompts])
    assert all(r["brief"].startswith("said") for r in out.collect())
    assert [r["brief"] for r in generation.extractive_briefs(rows).collect()] == ["A man."]


def test_streams(spark, tmp_path):
    source = tmp_path / "src"
    row = '{"author": "%s", "cluster": "c", "work_title": "t", "work_slug": "s", "pg_id": "1", "chapter_num": 1, "path": "%s", "words": 1, "chars": 1}\n'
    source.mkdir()
    (source / "1.json").write_text(row % ("a", "p1") + row % ("a", "p1") + row % ("b", "p2"))

    def run():
        stream = incremental.new_rows(incremental.manifest_stream(spark, str(source)), ["path"])
        incremental.append_sink(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        return spark.read.json(str(tmp_path / "out")).count()

    assert run() == 2
    (source / "2.json").write_text(row % ("a", "p1") + row % ("c", "p3"))
    assert run() == 3


def test_running_counts(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"author": "a", "text": "one two"}\n{"author": "a", "text": "three"}\n')
    stream = spark.readStream.schema("author string, text string").json(str(tmp_path))
    q = incremental.running_word_counts(stream).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = spark.table("running").first()
    assert (r["author"], r["chapters"], r["words"]) == ("a", 2, 3)


@pytest.mark.parametrize("times", [1, 2])
def test_upsert(spark, times):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    for _ in range(times):
        incremental.upserted(rows, f"upsert_{times}", ["k"])
    assert spark.table(f"upsert_{times}").count() == 2


def test_unaccented_is_python_s_decomposition(spark):
    import unicodedata

    every = "".join(chr(k) for k in [*range(1, 0xD800), *range(0xE000, 0x30000)] if unicodedata.category(chr(k)) not in ("Cn", "Co") and not 0xAC00 <= k <= 0xD7A3)
    rows = [(k, every[k : k + 500]) for k in range(0, len(every), 500)] + [(-1, "Brontë e\u0301É ẞ")]
    got = {r["k"]: r["u"] for r in spark.createDataFrame(rows, "k int, t string").select("k", T.unaccented(F.col("t")).alias("u")).collect()}
    bare = lambda t: "".join(x for x in unicodedata.normalize("NFD", t) if unicodedata.category(x) != "Mn")
    same = sum(unicodedata.normalize("NFD", got[k]) == unicodedata.normalize("NFD", bare(t).lower()) for k, t in rows)
    assert got[-1] == "bronte ee ß" and same >= 0.97 * len(rows)


def test_later_lines_win_whatever_their_files_are_called(spark, tmp_path):
    from quillmill.operators import dataset

    path = str(tmp_path / "b")
    for k in range(4):
        rows = [("p", j, f"brief {k}" if j < 40 else "x" * 2000 * (4 - k), "a", "c") for j in range(50 if k else 300)]
        spark.createDataFrame(rows, readers.BRIEFS).coalesce(1).write.mode("append").json(path)
    last = {r["chunk_idx"]: r["brief"] for r in dataset.last_briefs(readers.briefs(spark, path)).collect()}
    assert len(last) == 300 and {last[j] for j in range(40)} == {"brief 3"} and last[45] == "x" * 2000


def test_append_new_takes_one_of_equal_keys(spark, tmp_path):
    rows = spark.createDataFrame([("p", 0, "a", "x", "c"), ("p", 0, "b", "x", "c"), ("p", 1, "c", "x", "c")], readers.BRIEFS)
    for _ in range(2):
        writers.append_new(rows, str(tmp_path / "n"), ["chapter_path", "chunk_idx"], readers.BRIEFS)
    assert readers.briefs(spark, str(tmp_path / "n")).count() == 2


def test_many_directions_are_taken_out_as_one_matrix(spark):
    rng = np.random.default_rng(3)
    u = np.linalg.qr(rng.normal(size=(12, 5)))[0]
    x = rng.normal(size=(30, 12))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "id int, v array<float>")
    got = {r["id"]: r["v"] for r in algebra.without_directions(rows, u, "v").collect()}
    native = {r["id"]: r["p"] for r in rows.select("id", algebra.projected(F.col("v"), u).alias("p")).collect()}
    assert got[99] is None
    for k in range(30):
        assert got[k] == pytest.approx(native[k], abs=1e-9) and got[k] @ u == pytest.approx(np.zeros(5), abs=1e-6)
