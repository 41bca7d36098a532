"""The pipeline's stages by their decisions, document by document, on the smallest tables."""

from __future__ import annotations

import tracemalloc
from collections import defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from tidemark.llm import classifier, decontaminate, pii
from tidemark.llm.common import BATCH, BATCH_BYTES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def rows(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def test_quality_keeps_what_scores_half_or_more(spark, docs):
    model = classifier.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = rows(corpus_pipeline.quality(spark, docs, SF))
    assert set(got) == {i for i, t in texts.items() if model.score(t) >= 0.5} and 0 < len(got) < len(texts)
    assert all(got[i] == r for i, r in rows(docs).items() if i in got)


def test_decontamination_drops_documents_with_a_unit(spark, docs):
    units = decontaminate.units([(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    got = rows(corpus_pipeline.decontaminated(spark, docs, SF))
    dirty = {i for i, r in rows(docs).items() if decontaminate.search([(r["text"] or "").encode()], units)}
    assert set(got) == set(rows(docs)) - dirty and dirty


def test_personal_data_becomes_its_kind(spark, docs):
    got, before = rows(corpus_pipeline.redacted(spark, docs, SF)), rows(docs)
    spans = {r.doc_id: r.spans for r in pii.detect(docs).collect()}
    assert set(got) == set(before)
    for i, r in before.items():
        out, end = "", 0
        for kind, s, e in sorted((x.split(":") for x in spans[i].split(",") if x), key=lambda x: (int(x[1]), -int(x[2]))):
            if int(s) >= end:
                out, end = out + r["text"][end : int(s)] + f"<{kind}>", int(e)
            elif int(e) > end:
                end = int(e)
        if r["text"] is not None:
            assert got[i]["text"] == out + r["text"][end:] and got[i]["n_chars"] == len(got[i]["text"])


def test_mix_takes_near_the_targets(spark, docs):
    got = corpus_pipeline.mix(spark, docs, SF).collect()
    by = defaultdict(list)
    for r in got:
        assert r.taken == r["size"] * r.copies > 0 and r.copies <= 2
        by[r.source, r.target].append(r)
    for (_, target), rs in by.items():
        assert abs(sum(r.taken for r in rs) - target) <= max(r["size"] for r in rs)


@pytest.mark.parametrize("stage", ["quality", "decontaminated", "redacted"])
@pytest.mark.parametrize("before,after", [("64MB", str(BATCH_BYTES)), ("1MB", "1MB")])
def test_stages_send_small_batches_to_python(spark, docs, stage, before, after):
    spark.conf.set(BATCH, before)
    try:
        getattr(corpus_pipeline, stage)(spark, docs, SF)
        assert spark.conf.get(BATCH) == after
    finally:
        spark.conf.unset(BATCH)


@pytest.mark.parametrize("helper", ["keep_rows", "in_arrow"])
def test_a_search_of_what_it_gets_at_once_holds_little(spark, docs, monkeypatch, helper):
    taken = []
    monkeypatch.setattr(decontaminate, helper, lambda df, *args: taken.append(args[2] if len(args) > 2 else 8 << 20) or df)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    decontaminate.keep_clean(docs, bench) if helper == "keep_rows" else decontaminate._searched(docs, next(decontaminate.blocks(bench)), "bigint")
    texts = [(r.text or "").encode() for r in docs.collect()]
    texts *= 1 + taken[0] // sum(map(len, texts))
    while sum(map(len, texts)) > taken[0]:
        texts.pop()
    units = decontaminate.units([(r.item_id, r.text.encode()) for r in bench.collect()])
    tracemalloc.start()
    decontaminate.search(texts, units)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
