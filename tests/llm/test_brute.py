"""Operators against plain Python on the smallest tables and on planted cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chunks, classifier, decontaminate, licenses, lyndon, mixing, pii, quality, queries, simhash, suffix, warc

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@needs_tables
def test_op1_query_with_planted_copies(spark, tmp_path):
    """Every result column from plain Python over the pages and copies of them, empty and null payloads included."""
    import base64

    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages += [(10_000 + k, "http://copy/", pages[k % 7][2]) for k in range(40)] + [(20_000, "u", ""), (20_001, None, None), (20_002, "u", "é" * 300_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    body = {i: (h or "").encode() for i, _, h in pages}
    last: dict[bytes, int] = {}
    for i in sorted(body):
        last[body[i]] = i
    want = {
        (i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if last[b] == i else "revisit", None if last[b] == i else last[b], True)
        for i, b in body.items()
    }
    assert {tuple(r) for r in queries.op1_warc(spark, str(tmp_path)).collect()} == want


def test_op1_bundles_are_read_by_tasks_of_their_own(spark):
    pages = spark.range(200).selectExpr("id AS page_id", "'u' AS url", "concat_ws(' ', transform(sequence(1, 40), k -> sha2(string(id * 100 + k), 512))) AS html")
    index = warc.write_archives(pages, frame_bytes=5000, bundle_bytes=20000)
    bundles = index.select("bundle").distinct().count()
    tasks = warc.read_archives(index).select(F.spark_partition_id().alias("p")).distinct().count()
    assert bundles > 8 and tasks == bundles


@needs_tables
def test_op2_counts(spark, texts):
    got = {r.doc_id: r for r in queries.op2_quality_rules(spark, SF).collect()}
    for i, t in texts.items():
        words = WORD.findall(t)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = {w for w, n in Counter(windows).items() if n > 1}
        inside = {k + j for k, w in enumerate(windows) if w in often for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_op2_lines_of_many_documents(spark):
    body = [f"a line of its own number {k} {'xyz'[k % 3] * (k + 3)} with enough words to be kept here today" for k in range(30)]
    same = "subscribe to our newsletter for more stories like this one every single week of the year and beyond forever"
    rows = [(k, "h", f"{body[k]}\n{same}") for k in range(25)] + [(99, "h", same), (100, "other", same)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[3].kept and got[3].n_frequent_lines == 1
    assert not got[99].base_failed and not got[99].kept and got[100].kept


def least_edits(unit: bytes, text: bytes) -> np.ndarray:
    """For each end in text: the least edits of the whole unit against some part that ends there."""
    row = np.zeros(len(text) + 1, np.int32)
    t, places = np.frombuffer(text, np.uint8), np.arange(len(text) + 1, dtype=np.int32)
    for k, c in enumerate(unit, 1):
        new = np.concatenate([[np.int32(k)], np.minimum(row[1:] + 1, row[:-1] + (t != c))])
        row = np.minimum.accumulate(new - places) + places
    return row


@needs_tables
def test_op2_query_against_sql(spark, docs, tmp_path):
    """Every column of every document on the table's hosts, and on two hosts with planted lines of which some go."""
    import duckdb

    footer = F.when(F.col("doc_id") % 3 == 0, F.lit("\nRead Page 12 of our long footer, which says the same on every page,  again and again")).otherwise("")
    docs.select("doc_id", F.concat("text", footer, F.when(F.col("doc_id") % 9 == 0, F.repeat(footer, 40)).otherwise("")).alias("text"), F.when(F.col("doc_id") < 20, "few").otherwise("many").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    for sf, planted in ((SF, False), (str(tmp_path), True)):
        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{sf}/documents.parquet{'/*.parquet' if planted else ''}'")
        want = con.sql(queries.oracle_sql()["op2_quality_rules"])
        got = queries.op2_quality_rules(spark, sf).select(*want.columns).collect()
        assert sorted(map(tuple, got)) == sorted(want.fetchall())
        if planted:
            assert sum(r.n_frequent_lines > 0 for r in got) > 50 and any(not r.kept and not r.base_failed for r in got) or any(r.frequent_chars > 0.7 * r.word_chars for r in got)


def test_op2_depleted_on_a_small_host(spark):
    same = "this footer stands under every page of the small host and fills most of what there is to read on it"
    rows = [(k, "small", f"one short line of its own {'abcdefghij'[k % 10]} {k}\n{same} {same[k:]}\n{same}\n{same}") for k in range(12)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert all(r.n_frequent_lines == 2 for r in got)


@needs_tables
def test_op3_query_against_full_alignment(spark, tmp_path):
    """Whole texts through the query, with every fifth unit; texts with as many edits as a unit allows are added."""
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:12]
    bench += [(1000, "seven small boats sail"), (1001, "a note"), (1002, "x" * 14 + " y")]
    units = decontaminate.units([(i, t.encode()) for i, t in bench])
    rng = random.Random(1)
    for k, u in enumerate(units.texts):
        b = bytearray(u)
        for at in sorted(rng.sample(range(len(b)), int(units.edits[k])), reverse=True):
            b[at : at + 1] = rng.choice([b"", b"\x7f", bytes([b[at]]) + b"\x7f"])
        texts.append((10_000 + k, "some words before it " + b.decode(errors="replace") + " and after"))
    texts += [(20_000, "the seven small boats sail on"), (20_001, "the seven small boats sailed"), (20_002, "seven small boats sail"), (20_003, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = [b" " + decontaminate.normal((t or "").encode()) + b" " for _, t in texts]
    joined = b"\n".join(plain)
    ends = np.cumsum([len(t) + 1 for t in plain])
    want = {i: {} for i, _ in texts}
    for u, unit in enumerate(units.texts):
        cost = least_edits(unit, joined)
        for (i, _), end, t in zip(texts, ends.tolist(), plain, strict=True):
            # the line feed between texts is in no unit: a match over it costs an edit, so that only matches inside count
            if (e := int(least_edits(unit, t).min()) if cost[end - len(t) - 1 : end].min() <= units.edits[u] else 10**6) <= units.edits[u]:
                item = int(units.items[u])
                want[i][item] = min(e, want[i].get(item, e))
    got = {r.doc_id: (list(r["items"]), r.edits) for r in queries.op3_decontamination(spark, str(tmp_path)).collect()}
    assert got == {i: (sorted(w), min(w.values(), default=None)) for i, w in want.items()}
    assert got[20_000][0] == got[20_002][0] == [1000] and got[20_001][0] == [] and sum(bool(w) for w in want.values()) > len(units.texts)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    small = decontaminate.contamination(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"), block_bytes=2000)
    assert {r.doc_id: (list(r["items"]), r.edits) for r in small.collect()} == got
    kept = decontaminate.keep_clean(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"), block_bytes=2000)
    assert {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w}


@pytest.mark.parametrize("size", [32, 80, 120, 169, 170, 179, 180])
def test_op3_full_budget_at_every_shift(size):
    """As many deletions, or insertions, as the budget allows, all on one side of the diagonal."""
    rng = random.Random(size)
    unit = bytes(rng.choices(range(97, 123), k=size))
    one = decontaminate.units([(1, unit)])
    e = int(one.edits[0])
    step = size // (e + 1)
    fewer = b"".join(unit[k * step : (k + 1) * step - 1] if k < e else unit[k * step :] for k in range(e + 1))
    more = b"".join(unit[k * step : (k + 1) * step] + b"#" if k < e else unit[k * step :] for k in range(e + 1))
    for made in (fewer, more):
        assert least_edits(unit, made).min() <= e
        for shift in range(33):
            assert decontaminate.search([b"~" * shift + made + b"~~"], one), (shift, made)


def test_op4_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(200):
        letters = int(rng.integers(1, 4))
        texts = [[*rng.integers(2, 2 + letters, int(rng.integers(0, 60))).tolist(), 1] for _ in range(int(rng.integers(1, 6)))]
        texts += [[2, 3] * int(rng.integers(0, 9)) + [1]]
        edge = np.cumsum([0, *map(len, texts)])
        got = lyndon.suffix_arrays(np.array(sum(texts, [])), edge)
        for k, s in enumerate(texts):
            assert (got[edge[k] : edge[k + 1]] - edge[k]).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_op4_construction_is_linear(monkeypatch):
    """Places that the construction touches, counted by its own gathering step, double with the text."""
    seen = []
    plain = lyndon._places
    monkeypatch.setattr(lyndon, "_places", lambda first, count: seen.append(int(count.sum())) or plain(first, count))
    rng = np.random.default_rng(2)
    work = []
    for size in (1 << 13, 1 << 14, 1 << 15):
        seen.clear()
        lyndon.suffix_arrays(np.append(rng.integers(3, 30, size), 1), np.array([0, size + 1]))
        work.append(sum(seen) / size)
    assert max(work) < 5 and max(work) / min(work) < 1.1


@needs_tables
@pytest.mark.parametrize("how", [{}, {"piece": 1 << 16, "bucket": 1 << 15, "hot": 2}, {"piece": 1 << 17, "bucket": 1 << 16, "hot": 20}])
def test_op4_every_byte(docs, texts, how):
    first: dict[bytes, int] = {}
    data = {i: t.encode() for i, t in texts.items()}
    for i in sorted(data):
        for k in range(len(data[i]) - 49):
            first.setdefault(data[i][k : k + 50], i)
    got = {r.doc_id: r for r in suffix.repeated_strings(docs, **how).collect()}
    for i, t in data.items():
        covered = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                covered[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        assert bytes(got[i].kept) == kept and sum(e - s for s, e in zip(got[i].starts, got[i].ends, strict=True)) == sum(covered)


def test_op5_notices():
    mit = licenses.TEMPLATES["MIT"][2]
    text = f"Foo bar baz.\nReleased under the MIT License.\nmore words here\n{mit.replace('publish', 'print')}\nand the license of nothing. Licensed under CC BY-NC 4.0."
    got = licenses.scan(text)
    assert [x[0] for x in got] == ["MIT", "MIT", "CC-BY-NC-4.0"]
    assert text[got[0][2] : got[0][3]] == "Released under the MIT License" and got[1][1] > 0.95
    assert licenses.scan("a driving license is required and permission was denied") == []
    twice = "Licensed under the Apache License, Version 2.0. " * 2
    assert len(licenses.scan(twice)) == 2
    assert licenses.patience(list("abcxyz"), list("xabcz")) == [(0, 1), (1, 2), (2, 3), (5, 4)]


@needs_tables
def test_op6_fold_and_learning(spark):
    good, bad = "the river ran past the quiet village and the people walked home ", "$$$ buy now!!! cheap pills click here %%% win cash prize "
    rng = random.Random(2)
    mixed = lambda s: " ".join(rng.sample(s.split(), len(s.split()))) * rng.randint(2, 6)
    rows = [(k, mixed(good if k % 2 else bad), k % 2) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = classifier.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    got = {r.doc_id: r.score for r in classifier.score(df, model).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((got[k] >= 0.5) == bool(k % 2) for k in held) / len(held) > 0.95
    out = queries.op6_quality_classifier(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_op7_masks_cover():
    masks = simhash.covering_masks()
    rng = random.Random(4)
    for _ in range(2000):
        differing = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(differing & m == 0 for m in masks)


@needs_tables
@pytest.mark.parametrize("pairwise", [512, 1])
def test_op7_components(docs, texts, pairwise):
    import xxhash

    def print_of(t):
        words = [w.decode() for w in t.encode().lower().split()] if t else []
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in t))
        if not words:
            return 0
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = {i: print_of(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs, pairwise=pairwise).collect()}
    assert got == {i: (prints[i], root(i)) for i in texts}


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_components_of_chains_and_stars(spark, broadcast):
    from tidemark.llm.components import components

    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(60, 7), (3, 3), (7, 8), (8, 7)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long"), broadcast).collect())
    assert got == {k: 100 for k in range(101, 141)} | {k: 7 for k in range(8, 61)}


@needs_tables
@pytest.mark.parametrize("fan", [128, 8])
def test_op8_targets_and_reruns(spark, docs, texts, fan):
    """Sizes from the texts; where a source is one fold, no copy more or less of a document but the last would bring it nearer to its target."""
    got = [(r.doc_id, r["size"], r.source_size, r.target, r["size"] * r.copies, r.source) for r in mixing.mix(docs, fan=fan).collect()]
    by = defaultdict(list)
    for i, size, source_size, target, taken, source in got:
        assert size == len(WORD.findall(texts[i])) and 0 <= taken <= 2 * size and taken % max(1, size) == 0
        by[source, source_size, target].append((size, taken))
    for (_, source_size, target), rows in by.items():
        assert source_size == sum(s for s, _ in rows)
        miss, low = sum(t for _, t in rows) - target, int(target / max(1, source_size))
        if target < 2 * source_size and fan == 128:
            better = [s for s, t in rows if s and abs(miss + (s if t == low * s else -s)) < abs(miss) - 1e-6]
            assert len(better) <= 1
        assert abs(miss) <= max(s for s, _ in rows) / (2 if fan == 128 else 1)
    assert sorted(got, key=str) == sorted(((r.doc_id, r["size"], r.source_size, r.target, r["size"] * r.copies, r.source) for r in mixing.mix(docs.repartition(3), fan=fan).collect()), key=str)
    if fan == 128:
        assert sorted(x[:5] for x in got) == sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in queries.op8_mixing(spark, SF).collect())


def test_op8_chances(spark):
    """Over many seeds a document is taken as often as it wants, and the sums stay."""
    rows = [(k, "a", 1 + k % 7) for k in range(40)] + [(k, "b", 3) for k in range(40, 60)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n int").cache()
    runs = 12
    seen = Counter()
    for seed in range(runs):
        got = mixing.mix(sized, size=F.col("n").cast("long"), seed=seed).collect()
        for source in "ab":
            assert abs(sum(r["size"] * r.copies for r in got if r.source == source) - next(r.target for r in got if r.source == source)) <= 3
        seen.update({r.doc_id: r.copies for r in got})
    for source, ids in (("a", range(40)), ("b", range(40, 60))):
        want = next(r.target / r.source_size for r in got if r.source == source)
        assert abs(sum(seen[i] for i in ids) / runs / len(ids) - want) < 0.2
        assert all(abs(seen[i] / runs - want) < 0.75 for i in ids)


def test_op8_repeated_rows(spark):
    """A million rows with null ids and one size are one member; they come out one by one, near the target."""
    same = spark.range(1_000_000).selectExpr("cast(null as long) AS doc_id", "'a' AS source", "7L AS n").unionByName(spark.range(50).selectExpr("id AS doc_id", "'b' AS source", "id AS n"))
    got = {r.source: r for r in mixing.mix(same, size=F.col("n")).groupBy("source").agg(F.count("*").alias("k"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()}
    assert got["a"].k == 1_000_000 and abs(got["a"].taken - got["a"].target) <= 7 and got["a"].most - got["a"].least == 1
    assert got["b"].k == 50 and got["b"].most <= 2


def test_op8_target_arithmetic(spark):
    sized = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 50)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sized).collect()}
    # 1740 to share by 5, 2, 1, 5: a, c and null stop at twice their size, b takes what is left
    assert got["a"] == 200 and got["c"] == 20 and got[None] == 100 and got["b"] == pytest.approx(1420)


@needs_tables
def test_op9_repeats(docs, texts):
    table = chunks.gear_table()
    data = {i: t.encode() for i, t in texts.items()}
    first: dict[bytes, tuple[int, int]] = {}
    cut = {}
    for i in sorted(data):
        h, hashes, ends, last = 0, [], [], 0
        for b in data[i]:
            h = ((h << 1) + int(table[b])) & 0xFFFFFFFF
            hashes.append(h)
        for k, x in enumerate(hashes):
            least = x <= min(hashes[max(0, k - chunks.AROUND) : k + 1 + chunks.AROUND]) and all(x < y for y in hashes[max(0, k - chunks.LEAST) : k])
            if least or k + 1 - last == chunks.MOST:
                ends.append(k + 1)
                last = k + 1
        if last < len(data[i]):
            ends.append(len(data[i]))
        cut[i] = list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []
        for s, e in cut[i]:
            first.setdefault(data[i][s:e], (i, s))
    want = {}
    for i in data:
        runs: list[list[tuple[int, int, int]]] = []
        for s, e in cut[i]:
            if first[data[i][s:e]] != (i, s):
                (runs[-1] if runs and runs[-1][-1][1] == s else runs.append([]) or runs[-1]).append((s, e, first[data[i][s:e]][0]))
        want[i] = [x for run in runs if run[-1][1] - run[0][0] >= chunks.RUN for x in run]
    got = {r.doc_id: [(x.start, x.start + x.size, x.doc_id) for x in r.repeats] for r in chunks.repeated_chunks(docs).collect()}
    assert got == want and sum(map(len, want.values())) > 100
    kept = {r.doc_id: r.text for r in chunks.without_repeats(docs).collect()}
    i = max(got, key=lambda k: len(got[k]))
    assert len(kept[i].encode()) <= len(data[i])


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_op10_base_patterns_on_noise():
    rng = random.Random(5)
    parts = ["a@b.c", "x@@y.z", "1.2.3.4", "1.2.3.4.5.6", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+1", "0", ".", "-", " ", "@", "é", "12", "a.b-c@d-e.f.g", "++49 30 123456", "007.008.009.010"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert pii.base_spans(text)[0] == base(text), text
    long = "1." * 30000 + "@" * 1000 + "9" * 30000 + "+1" + "(" * 30000
    pii.base_spans(long)


@needs_tables
def test_op10_results(spark, texts):
    for r in queries.op10_pii(spark, SF).collect():
        want = base(texts[r.doc_id])
        name = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert r.base_sha256 == hashlib.sha256(",".join(name).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in want) for j in range(4))
        assert set(name) <= set(r.spans.split(",")) | {""}


def test_op10_weak_labels_learn_written_out_addresses(spark):
    rows = [(k, f"please email me at user{k} [at] mail{k % 7} [dot] com or call 415-555-{1000 + k}") for k in range(60)] + [(k, f"contact user{k}@mail.com phone +1 415 555 {1000 + k}") for k in range(60, 200)]
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("doc_id < 60 and n_added > 0").count() > 30
    assert got.where("doc_id >= 60 and n_email != 1").count() == 0
    assert pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).where(F.col("text").contains("@")).count() == 0
