"""The n-gram Jaccard join against all pairs of sets, and its tries against plain intersections."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import ngram_join


def made(seed=3, sizes=(60, 30, 3, 2, 2, 4, 1, 1), edits=4, words=120):
    """Texts in groups of copies of which some words are others, among texts that share a long passage and nothing else."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for size in sizes:
        base = rng.choices(vocabulary, k=words)
        for _ in range(size):
            copy = list(base)
            for at in rng.sample(range(words), rng.randint(0, edits)):
                copy[at] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [" ".join(passage + rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(40)]
    return [*texts, texts[0], texts[0].upper(), "", " \n\t", None, "one two", "One  two", "one two three", "solo", "a b c d e", "a b c d e a b c d e", "x " * 4000]


def plain(rows):
    """(doc_id, n_shingles, component_id) by all pairs."""
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        sets.append(set(zip(*(words[k:] for k in range(5)), strict=False)) if len(words) >= 5 else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    out = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((doc_id, len(sets[k]), (min(ids, default=None) if sets[k] else doc_id)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("common", "edits", "sizes"), [(1 << 16, 4, (60, 30, 3, 2, 2, 4, 1, 1)), (0, 4, (60, 3, 2)), (50, 9, (70, 20))])
def test_components_as_all_pairs(spark, monkeypatch, common, edits, sizes):
    monkeypatch.setattr(ngram_join, "SETS", 16)
    rows = list(enumerate(made(seed=common, edits=edits, sizes=sizes)))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(len(rows) - k, t) for k, t in rows], "doc_id long, text string").repartition(5)
    got = ngram_join.near_duplicates(df, common=common).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain([(len(rows) - k, t) for k, t in rows])


def test_odd_rows(spark, odd, nothing):
    got = ngram_join.near_duplicates(odd).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain([(r.doc_id, r.text) for r in odd.collect()])
    assert ngram_join.near_duplicates(nothing).count() == 0
    named = ngram_join.near_duplicates(spark.createDataFrame([("abc", "a b c"), ("7", "a b c"), ("x", None)], "doc_id string, text string")).collect()
    assert sorted((tuple(r) for r in named), key=str) == [(7, 1, 7), (None, 0, None), (None, 1, 7)]


def test_tries_find_what_intersections_find():
    rng = np.random.default_rng(1)
    for round_ in range(200):
        base = rng.choice(500, rng.integers(1, 60), replace=False)
        found = {}
        for _ in range(rng.integers(1, 40)):
            kept = base[rng.random(len(base)) < rng.choice([0.5, 0.9, 1.0])]
            one = np.unique(np.concatenate((kept, rng.choice(500, rng.integers(0, 4)))).astype(np.uint64))
            if len(one):
                found[one.tobytes()] = one
        sets = list(found.values())
        if not sets:
            continue
        query = sets[rng.integers(len(sets))] if round_ % 2 else np.unique(base.astype(np.uint64))
        both = [len(np.intersect1d(query, s)) for s in sets]
        want = [k for k, s in enumerate(sets) if 100 * both[k] >= 80 * (len(query) + len(s) - both[k])]
        assert sorted(ngram_join.similar(query, sets)) == want


def test_similar_sets_share_a_prefix_member():
    rng = np.random.default_rng(2)
    order = ngram_join.Order(rng.choice(300, 20, replace=False).astype(np.uint64))
    for _ in range(500):
        a = np.unique(rng.choice(300, rng.integers(1, 50))).astype(np.uint64)
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.95], rng.choice(300, rng.integers(0, 4)).astype(np.uint64))))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        a, b = order.keys(a), order.keys(b)
        assert (np.diff(a.astype(object)) > 0).all()
        if ngram_join.enough(both, len(a), len(b)):
            assert set(a[: ngram_join.prefix_length(len(a))].tolist()) & set(b[: ngram_join.prefix_length(len(b))].tolist())


def test_common_ngrams_come_last(spark):
    rows = [(k, "the same five words everywhere " + f"x{k} y{k} z{k} q{k} r{k}") for k in range(50)]
    common = ngram_join.common_ngrams(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), most=4)
    words = ngram_join.Words()
    assert common[-1] == ngram_join.ngrams([b"the same five words everywhere"], words)[0][0]
    keys = ngram_join.Order(common).keys(ngram_join.ngrams([rows[3][1].encode()], words)[0])
    assert keys[-1] == ngram_join.LAST | np.uint64(len(common) - 1)


def test_sketches_and_first_keys():
    rng = np.random.default_rng(4)
    order = ngram_join.Order(rng.choice(1 << 40, 500, replace=False).astype(np.uint64))
    for size in (1, 5, 400, 3000):
        base = np.unique(np.concatenate((rng.integers(0, 1 << 62, size).astype(np.uint64), rng.choice(order.common, min(size, 300)))))
        for most in (1, 7, size):
            assert order.first(base, most).tolist() == order.keys(base)[:most].tolist()
        for share in (0.1, 0.5, 0.99):
            other = np.unique(np.concatenate((base[rng.random(len(base)) < share], rng.integers(0, 1 << 62, 3).astype(np.uint64))))
            assert ngram_join.apart(ngram_join.wide_sketch(base), ngram_join.wide_sketch(other)) <= len(np.setxor1d(base, other))
