"""Search levels by plain loops over requests and articles."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tidemark.operators import search


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(requests, articles, trusted):
    out = set()
    for request, terms in requests:
        levels = {}
        for i, title, content, country, category, domain in articles:
            t, c = (" " + " ".join(words(x)) + " " for x in (title, content))
            real = [[" " + " ".join(words(p)) + " " for p in alternatives if words(p)] for alternatives in terms]
            titled = sum(any(p in t for p in ps) for ps in real)
            anywhere = sum(any(p in t or p in c for p in ps) for ps in real)
            n, wide, business = len(terms), country in ("in", "us", "gb", "sg"), category == "business"
            if not anywhere:
                continue
            if titled == n and country == "in" and business:
                levels[i] = 0 if domain in trusted else 1
            elif anywhere == n and wide and business:
                levels[i] = 2
            elif wide:
                levels[i] = 3
            elif business:
                levels[i] = 4
        out |= {(request, i, v) for i, v in levels.items() if v == min(levels.values())}
    return out


def test_levels_phrases_and_aliases(spark):
    rng = random.Random(1)
    vocabulary = ["apple", "inc", "earnings", "revenue", "bank", "été", "x9", "the"]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k)) + rng.choice([".", "!", ""])
    articles = [(k, rng.choice([None, text(3)]), rng.choice([None, text(8)]), rng.choice(["in", "us", "fr", None]), rng.choice(["business", "world"]), rng.choice(["a.in", "b.com"])) for k in range(150)]
    requests = [(1, [["apple"], ["earnings"]]), (2, [["Apple Inc", "bank"], ["revenue", "earnings"]]), (3, [["nothing"]]), (4, [["été", ""]]), (5, [["the bank x9 inc"]]), (6, [["apple"], ["nothing"]]), (7, [])]
    a = spark.createDataFrame(articles, "id int, title string, content string, country string, category string, domain string")
    r = spark.createDataFrame(requests, "request int, terms array<array<string>>")
    got = {tuple(x) for x in search.search_levels(r, a, ["a.in"]).collect()}
    assert got == plain(requests, articles, ["a.in"]) and len({x[2] for x in got}) >= 2


def test_terms(spark):
    got = spark.range(1).select(search.query_terms(F.lit("Rate HIKE, 2024")).alias("q"), search.themed_terms(F.array(F.lit("Apple"), F.lit("Apple INC")), F.lit("earnings OR revenue")).alias("t")).head()
    assert got.q == [["rate"], ["hike"], ["2024"]] and got.t == [["Apple", "Apple INC"], ["earnings", "or", "revenue"]]
