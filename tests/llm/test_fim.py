"""Rank and select against counting, and the transformation against its rules in plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import fim, queries


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 511, 512, 513, 5000])
@pytest.mark.parametrize("density", [0.0, 0.01, 0.5, 1.0])
def test_rank_and_select(size, density):
    bits = np.random.default_rng(size).random(size) < density
    vector, ones = fim.BitVector(bits), np.flatnonzero(bits)
    at = np.arange(size + 1)
    assert vector.rank(at).tolist() == [int(bits[:k].sum()) for k in at]
    assert vector.select(np.arange(len(ones))).tolist() == ones.tolist()


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the contract's words."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rows_as_the_contract_says(spark, odd, nothing):
    rng = random.Random(5)
    texts = ["".join(rng.choices(["a", "Zb", "é", "\U0001f600", " ", "\n", "<", "P>", ">", "S", "\x00", "ß9"], k=rng.randint(0, 60))) for _ in range(300)]
    texts += ["a<P>b", "<S>", "x<M", "<", "P><", None, "", "é" * 70_000 + "word " * 70_000, "letters", "letters"]
    rows = list(enumerate(texts)) + [(None, "no id"), (5, texts[5])]
    got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    back = got.withColumn("back", fim.restored(got["output"], got["form"])).collect()
    want = sorted(((d, *plain(d, t)) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back), key=str) == want
    assert sorted(r.back for r in back) == sorted(t or "" for _, t in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    got = fim.fill_in_middle(odd).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted(((r.doc_id, *plain(r.doc_id, r.text)) for r in odd.collect()), key=str)
    assert fim.fill_in_middle(nothing).count() == 0


def test_string_ids(spark):
    got = fim.fill_in_middle(spark.createDataFrame([("abc", "one two three")], "doc_id string, text string")).first()
    assert (got.doc_id, got.n, got.output) == ("abc", 5, plain("abc", "one two three")[-1])


def test_query_returns_hashes_of_output_and_text(spark, tmp_path):
    rows = [(k, f"Word{k} and é {k * 7} more." * (k % 5)) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((d, n, form, p, m, sha(out), sha(t)) for d, t in rows for n, form, p, m, out in [plain(d, t)])
    assert sorted(tuple(r) for r in queries.op11_fill_in_middle(spark, str(tmp_path)).collect()) == want
