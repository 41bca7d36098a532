"""The divergence of sources against whole fractions over every term, zeros included."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tidemark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least, top):
    rows = [(lang or "", source or "", TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs = Counter(t for x, _, terms in rows if x == lang for t in set(terms))
        kept = sorted(t for t, n in docs.items() if n >= least)
        sources = sorted({s for x, s, _ in rows if x == lang}, key=lambda s: s.encode())
        counts = {s: Counter(t for x, y, terms in rows if (x, y) == (lang, s) for t in terms) for s in sources}
        total = sum(counts.values(), Counter())

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: share(counts[s]) for s in sources}, share(total)
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top}
    return out


@pytest.mark.parametrize(("least", "top"), [(30, 50), (3, 4)])
def test_rows_as_plain_python(spark, least, top):
    rng = random.Random(least)
    words = [f"w{chr(97 + k)}" for k in range(26)] + ["THE", "the", "é", "\U0001f600", "ÉTÉ", "été", "日本", "x9y"]
    made = [(rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "c", "", None, "é"]), " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 12)))) for _ in range(400)]
    made += [("fr", "a", "rare words"), ("fr", "b", None), ("en", "empty", ""), ("en", "nothing", "123 ++"), ("one", "alone", "bonjour"), ("en", "long", "the wa " * 40_000), made[0], made[0]]
    df = spark.createDataFrame(made, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS n", "3 AS docs", "4 AS v", "5 AS cells").repartition(5)
    got = divergence.divergence(df, least_docs=least, top=top).collect()
    assert {tuple(r) for r in got} == plain(made, least, top) and len(got) == len({tuple(r) for r in got})


def test_counts_leave_a_task_in_parts(spark):
    rows = [("en", f"s{k % 3}", f"w{chr(97 + k % 26)} w{chr(97 + k // 26)}") for k in range(600)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    count = lambda e: sorted(tuple(r) for r in divergence.term_counts(df, entries=e).collect())
    assert count(1) == count(10**6)


def test_odd_rows_and_none(odd, nothing):
    got = divergence.divergence(odd).collect()
    assert {r.part for r in got} == {"pair"} and {r.value for r in got} == {0}
    assert divergence.divergence(nothing).count() == 0
