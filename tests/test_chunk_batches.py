"""The chunker's Python worker holds little at a time."""

import pyarrow as pa
from quillmill.functions.tokenizers import WordTokenizer
from quillmill.operators import chunking


def test_finished_chunks_are_given_away(monkeypatch):
    monkeypatch.setattr(chunking, "BATCH_TOKENS", 100)
    texts = ["\n\n".join(f"w{k} x y z" for k in range(30)), "", "a b c"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(15)), pa.array(texts)], ["doc_id", "text"])
    names = ["doc_id", "chunk_idx", "n_tokens", "is_chapter_end", "input_ids"]
    made = list(chunking.chunk_batches([batch], names, WordTokenizer(), 20, None, r"\n\s*\n+", False))
    assert max(sum(b.column("n_tokens").to_pylist()) for b in made) < 120
    rows = [r for b in made for r in b.to_pylist()]
    for doc, t in enumerate(texts):
        assert [r["input_ids"] for r in rows if r["doc_id"] == doc] == chunking.chunk_text(t, WordTokenizer(), 20)


def test_a_tokenizer_may_remember_nothing():
    t = WordTokenizer(remembers=False)
    assert t.encode("a b a") == WordTokenizer().encode("a b a")
    assert not t.seen
