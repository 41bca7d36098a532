"""Pieces of texts with and without separators."""

from __future__ import annotations

from tidemark.functions import text as tx
from tidemark.plans import catalogue


def test_cuts_at_the_first_separator_there_is():
    assert tx.split_recursive("", 20, 5) == []
    assert tx.split_recursive("short", 20, 5) == ["short"]
    assert tx.split_recursive("x" * 50, 20, 5) == ["x" * 50]
    assert tx.split_recursive("aaaa aaaa\n\nbbbb bbbb\n\ncccc cccc", 20, 5) == ["aaaa aaaa\n\nbbbb bbbb", "cccc cccc"]
    assert tx.split_recursive("one two three\nfour five six\nseven", 20, 8) == ["one two three", "four five six\nseven"]
    assert tx.split_recursive("aa\nbb\ncc\ndd", 6, 3) == ["aa\nbb", "bb\ncc", "cc\ndd"]


def test_no_sentence_is_cut(spark, tmp_path):
    text = ". ".join(f"Sentence {k} has some words of its own" for k in range(200)) + "."
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["document_passages"](spark, str(tmp_path)).orderBy("doc_id", "chunk").collect()
    assert {r.doc_id for r in got} == {1} and len(got) > 3
    assert all(len(r.piece) <= 2000 and r.piece.lstrip(". ").startswith("Sentence") for r in got)
    assert all(a.piece.split(". ")[-1] in b.piece for a, b in zip(got, got[1:], strict=False))


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["x" * 1000] * 39 + ["y" * 9000])], ["doc_id", "text"])
    parts = list(tx.parts(batch, 4000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or p.nbytes <= 4000 for p in parts) and len(parts) > 10
