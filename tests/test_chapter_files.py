"""Stored chapters make files by author, not by work."""

from quillmill.sources import writers


def test_works_share_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"a{i % 2}", f"w{i}", 1, f"body {i}") for i in range(40)], "author_slug string, work_slug string, chapter_num int, body string").coalesce(1)
    writers.chapter_texts(rows, f"file://{tmp_path}/c")
    assert len(list((tmp_path / "c").rglob("*.parquet"))) == 2
    assert spark.read.parquet(f"file://{tmp_path}/c").select(*rows.columns).exceptAll(rows).count() == 0
