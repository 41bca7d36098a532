"""Texts and ids that are legal and unusual: none fails a table, and what they give is defined."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chunks, decontaminate, mixing, pii, simhash, suffix, warc

TEXTS = [
    "0" * 5_000 + ".1.1.1", "1.2.3." + "0" * 10_000 + "7", "9" * 10_000, "+" + "1" * 10_000, "4 " * 10_000, "+1" + "(" * 10_000, "a@" + "b." * 10_000 + "c", "@" * 10_000, "." * 10_000,
    "0.0.0.0 00.0.0.0 255.255.255.255 256.1.1.1", "write to a (at] b.com", "write to a {AT) b [dot} com", "[at]", "x" * 10_000 + "@" + "y" * 10_000 + ".z", "1:2:3:4:5:6:7:8" * 1_000,
    "a1@b.co555-123-4567", "\x00￿\U0010ffff", "",
]


def test_no_text_fails():
    for text in TEXTS:
        for s, k, e, base, key in pii.candidates(text):
            assert 0 <= s < e <= len(text) and len(key) == 3 + pii.LABELERS and (base or k < 4)


def test_random_texts_of_hostile_parts():
    rng = random.Random(1)
    parts = ["0" * 400, "1.2.3.4", "a@b.co", "+1 (555)", "(at]", " dot ", "[dot)", "555 123 4567", "4111 1111 1111 1111", "::", "ffff:", "@", ".", "é", "\n"]
    for _ in range(2_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        found = pii.candidates(text)
        base = [(s, e) for s, _, e, b, _ in found if b]
        for s, _, e, b, _ in found:
            assert b or not any(x < e and s < y for x, y in base)


def test_wider_candidates_see_every_span_before_them():
    """A long base span stays in sight, however many short ones begin after it."""
    inner = "1.1.1.1-" * 6 + "555-123-4567"
    found = pii.candidates(f"x{inner}@b.com")
    assert [(s, e) for s, k, e, _, _ in found if k == 0] == [(0, len(inner) + 7)]
    assert not [1 for _, k, _, b, _ in found if k == 3 and not b]


def test_mixed_brackets_are_candidates():
    for text in ("a (at] b.com", "a {AT) b.com", "me [at} host (dot] org"):
        assert [k for _, k, *_ in pii.candidates(text)] == [0], text


def test_tables_of_hostile_texts(spark):
    df = spark.createDataFrame([(f"id-{k}" if k % 2 else str(k), t, "s") for k, t in enumerate(TEXTS)], "doc_id string, text string, source string")
    got = {r.doc_id: r for r in pii.detect(df).collect()}
    assert got["0"].n_ip == 1 and got["0"].spans.split(",")[0] == "ip:0:5006" and len(got) == len(TEXTS)
    assert pii.redact(df).count() == len(TEXTS)


BY_ID = {"mix": mixing.mix, "chunks": chunks.repeated_chunks, "strings": suffix.repeated_strings, "simhash": simhash.near_duplicates}


@pytest.mark.parametrize("name", BY_ID)
def test_ids_that_are_no_numbers_are_null(spark, name):
    long = "the same passage of many words stands in every one of these texts and goes on for more than fifty bytes "
    df = spark.createDataFrame([("abc", long, "s"), ("12", long, "s"), ("12", long, "s"), ("7x", "short", "s"), (None, None, None), ("9999999999999999999999", long + "x", "t")], "doc_id string, text string, source string")
    got = sorted(str(r.doc_id) for r in BY_ID[name](df).collect())
    assert got == ["12", "12", "None", "None", "None", "None"]


def test_stages_and_archives_take_such_ids(spark, tmp_path):
    df = spark.createDataFrame([("abc", "one text", "s", 8), ("12", "another text", "s", 12)], "doc_id string, text string, source string, n_chars long")
    assert corpus_pipeline.near_duplicates(spark, df, "").count() == 2 and corpus_pipeline.mix(spark, df, "").count() <= 2
    bench = spark.createDataFrame([("b", "x" * 90)], "item_id string, text string")
    assert decontaminate.contamination(df, bench).count() == 2
    pages = spark.createDataFrame([("p", "u", "h")], "page_id string, url string, html string")
    assert warc.read_archives(warc.write_archives(pages)).count() == 1


def test_repeated_rows_of_one_text_meet_in_parts(spark):
    """Ten thousand rows of one id and text: each has the same chunks removed, and none by its own copies."""
    passage = " ".join(f"word{k}" for k in range(60))
    rows = spark.range(10_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(passage).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(1, "start " + passage)], "doc_id long, text string"))
    got = chunks.repeated_chunks(rows).where("doc_id = 5").select(F.to_json("repeats").alias("r")).groupBy("r").count().collect()
    assert len(got) == 1 and got[0]["count"] == 10_000 and got[0].r != "[]"
