"""The pipeline's near-duplicates stage against all pairs of five-word shingle sets."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

import corpus_pipeline
from tidemark.llm import shingles


def made():
    """Texts with copies of which some words are others, in one large group and in small ones."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for size in (70, 3, 2, 2, 4, 1, 1):
        base = rng.choices(vocabulary, k=150)
        for _ in range(size):
            words = list(base)
            for at in rng.sample(range(150), rng.randint(0, 4)):
                words[at] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    return [*texts, "", " \n"]


def kept(texts):
    """Places of the texts that are the first of their component."""
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [k for k in range(len(texts)) if find(k) == k]


@pytest.mark.parametrize("pairwise", [32, 1])
def test_stage_finds_all_similar_pairs(spark, pairwise):
    texts = made()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.keep_one(docs, pairwise=pairwise).collect()) == kept(texts)


def test_pipeline_drops_copies_that_simhash_keeps(spark):
    texts = made()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == kept(texts)


def test_stage_takes_fingerprints_first_and_checks_them(spark, monkeypatch):
    """Covering hashing proposes pairs (made of fingerprints that differ in up to three bits), and sets under 0.8 stay apart."""
    from tidemark.llm import ngram_join, simhash

    texts = made()
    near = [t for t in (simhash.fingerprint(t.encode(), 5) for t in texts) if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    proposed = []
    whole = ngram_join.fingerprint_pairs
    monkeypatch.setattr(ngram_join, "fingerprint_pairs", lambda *a: proposed.append(whole(*a)) or proposed[-1])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == kept(texts)
    assert len(proposed) == 1 and proposed[0].count() >= len(near) - len(set(near))
    far = ["a b c d e f g h", "a b c d e f g h h"]  # four of five shingles are 0.8; as fingerprints they may be any
    monkeypatch.setattr(ngram_join, "fingerprint_pairs", lambda nodes, *_: nodes.alias("x").crossJoin(nodes.alias("y")).selectExpr("x.node AS u", "y.node AS v"))
    rows = list(enumerate([*far, "a b c d e f g i", "p q r s t u v w"]))
    assert sorted(r.doc_id for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [0, 2, 3]


def test_stage_takes_odd_rows(spark, odd, nothing):
    kept_odd = corpus_pipeline.near_duplicates(spark, odd, "")
    assert kept_odd.columns == odd.columns
    ids = sorted(str(r.doc_id) for r in kept_odd.collect())
    assert ids == ["1", "2", "3", "6", "7", "8", "9"]  # 7 shares 17 of 27 shingles with 1
    assert corpus_pipeline.near_duplicates(spark, nothing, "").count() == 0


def test_sketches_lose_no_similar_pair():
    """Bits in which two sketches differ are never more than the shingles that one text has alone."""
    texts = [t for t in made() if t.strip()] + ["a b c d e f g " * 400]
    sets = [shingles.shingle_hashes(t.encode()) for t in texts]
    bits = [shingles.sketch(s) for s in sets]
    for (a, x), (b, y) in combinations(zip(sets, bits, strict=True), 2):
        differ = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x ^ y)
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))
