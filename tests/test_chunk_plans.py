"""Chunks are cut once, and no text is moved for them."""

from helpers import SMALL
from quillmill.plans import registry, views
from quillmill.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_text_is_joined_for_its_author(spark):
    assert "Join" not in plan(views.chunks(spark, SMALL))


def test_briefs_and_chunks_come_from_one_table_without_texts(spark):
    for name in ("chunks_join_briefs", "chunks_to_do", "stratified_split"):
        assert "Relation [" not in plan(registry.QUERIES[name](spark, SMALL)), name
    chunks, briefs = views.chunks_and_briefs(spark, SMALL)
    assert "text" not in chunks.columns
    wanted = views.briefs(views.chunks(spark, SMALL))
    assert briefs.count() == wanted.count()
    assert wanted.exceptAll(briefs).count() == 0
    assert tables.table(spark, SMALL, "documents").count() >= chunks.select("path").distinct().count()
