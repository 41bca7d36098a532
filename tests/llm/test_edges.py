"""Nulls, empty texts and tables, repeated rows, long texts and clashing names for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chunks, classifier, decontaminate, licenses, mixing, pii, quality, simhash, suffix, warc
from tidemark.llm.classifier import Model


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "seven small boats sail past the old harbour wall at dawn and nobody hears"), (2, None), (None, "a" * 90), (3, "short")], "item_id long, text string")


PER_ROW = {
    "quality": lambda d, b: quality.quality_rules(d),
    "decontaminate": lambda d, b: decontaminate.contamination(d, b),
    "suffix": lambda d, b: suffix.repeated_strings(d),
    "licenses": lambda d, b: licenses.license_scan(d),
    "classifier": lambda d, b: classifier.score(d, Model(b"abc" * 99, b"xyz" * 99, 1.0, 0.0)),
    "simhash": lambda d, b: simhash.near_duplicates(d),
    "mixing": lambda d, b: mixing.mix(d),
    "chunks": lambda d, b: chunks.repeated_chunks(d),
    "pii": lambda d, b: pii.detect(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_row_for_each_row(odd, nothing, bench, name):
    got = PER_ROW[name](odd, bench).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())
    assert PER_ROW[name](nothing, bench).count() == 0


def test_decontamination_finds_the_passage(odd, bench):
    got = {r.doc_id: r["items"] for r in decontaminate.contamination(odd, bench).collect()}
    assert got[1] == [1] and got[7] == [1] and got[9] == [] and got[3] == []
    kept = decontaminate.keep_clean(odd, bench)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 7)").count() == 0 and kept.where("doc_id = 9").count() == 1


def test_warc_edges(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nx", "same"), (2, None, "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "v", "same"), (5, "w", "x" * 1_000_000), (6, "w", "HTTP/1.1 \r\n\r\n")], "page_id long, url string, html string").withColumn("bundle", F.lit(1))
    index = warc.write_archives(pages, frame_bytes=1000)
    got = warc.read_archives(index).collect()
    assert len(got) == 8 and all(r.intact for r in got)
    kinds = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got}
    assert kinds == {(1, "revisit", 2, 4), (2, "response", None, 4), (None, "revisit", 2, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 1_000_000), (6, "response", None, 13)}
    back = {r.page_id: r.payload for r in warc.fetch(index).collect()}
    assert bytes(back[5]) == b"x" * 1_000_000 and back[1] is None and bytes(back[6]) == b"HTTP/1.1 \r\n\r\n"
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_keep_one_loses_no_document(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r.doc_id) for r in kept.select("doc_id").collect())
    assert ids.count("1") == 1 and "6" in ids and "8" in ids and ids.count("2") == 1  # 2's other text has no twin
    assert kept.where("doc_id is null").count() <= 1


def test_redaction_keeps_rows(odd):
    got = pii.redact(odd.withColumn("text", F.concat("text", F.lit(" mail a@b.co"))))
    assert got.count() == odd.count() and got.columns == odd.columns
    assert got.where("text like '%a@b.co%'").count() == 0 and got.where("text is null").count() == odd.where("text is null").count()


def test_pipeline_stages_take_odd_rows(spark, odd, nothing, bench, tmp_path):
    for name, t in (("documents", odd), ("benchmark", bench), ("labels", spark.createDataFrame([(1, 1, 0), (9, 0, 0), (8, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"))):
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, nothing):
            got = stage(spark, docs, str(tmp_path))
            assert got.count() <= odd.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
