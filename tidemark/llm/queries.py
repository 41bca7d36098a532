"""The opN_ queries: each applies one operator to its whole table and derives the contract's columns from its results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, classifier, decontaminate, divergence, fim, licenses, mixing, ngram_join, pii, quality, simhash, suffix, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_read(spark, sf_dir, "pages"))
    return warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_lines", "frequent_chars"
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "edits")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_strings(_read(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(_read(spark, sf_dir, "documents"))
    spans = F.transform("notices", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"]))
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_sort(F.array_distinct("notices.license")).alias("licenses"), F.array_max("notices.coverage").alias("coverage"), F.concat_ws(",", spans).alias("spans"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    found = classifier.score(docs, classifier.fit(docs, labels))
    return found.select("doc_id", (classifier.fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.repeated_chunks(_read(spark, sf_dir, "documents"))
    spans = F.transform("repeats", lambda x: F.concat_ws(":", x["start"], x["start"] + x["size"]))
    removed = F.aggregate("repeats.size", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("repeats").cast("long").alias("n_chunks_removed"), F.array_sort(F.array_distinct("repeats.doc_id")).alias("first_docs"), F.concat_ws(",", spans).alias("removed"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_read(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle forms of all documents; the second hash is of the text rebuilt from output and form."""
    found = fim.fill_in_middle(_read(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of all documents, as the operator gives it."""
    return divergence.divergence(_read(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under the Jaccard join of their five-word shingles."""
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_quality_rules, op3_decontamination, op4_suffix_array_dedup, op5_license_scan, op6_quality_classifier, op7_simhash, op8_mixing, op9_chunk_dedup, op10_pii, op11_fill_in_middle, op12_source_divergence, op13_ngram_join)}


#: Lines and windows are grouped by their text here, where the operator groups by hashes.
_QUALITY = r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
  w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS l, text FROM d),
  p AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
  g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM p),
  t AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
  r AS (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM t),
  n AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM r GROUP BY 1),
  l AS (SELECT d.doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
  k AS (SELECT doc_id, source, line, trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS n,
    length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
  h AS (SELECT source, count(DISTINCT doc_id) AS docs FROM k GROUP BY 1),
  f AS (SELECT source, n FROM (SELECT source, n, count(DISTINCT doc_id) AS docs FROM k GROUP BY ALL) c JOIN h USING (source)
    WHERE c.docs > 3 AND c.docs > CASE WHEN h.docs * 0.1::DOUBLE < 20 THEN h.docs * 0.1::DOUBLE ELSE 20 END),
  x AS (SELECT doc_id, count(*) AS lines, sum(chars)::BIGINT AS chars FROM k SEMI JOIN f USING (source, n) GROUP BY 1),
  u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM k GROUP BY 1),
  o AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lines, 0)::BIGINT AS n_frequent_lines, coalesce(chars, 0)::BIGINT AS frequent_chars
    FROM w LEFT JOIN u USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN x USING (doc_id))
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND word_chars - frequent_chars >= 0.3::DOUBLE * word_chars AS kept FROM o"""


_FIM = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
  u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
  c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
  p AS (SELECT *, coalesce(array_to_string(u[1 : a], ''), '') AS p, coalesce(array_to_string(u[a + 1 : b], ''), '') AS m, coalesce(array_to_string(u[b + 1 : ], ''), '') AS s FROM c),
  o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM p),
  x AS (SELECT *, string_split_regex(output, '<[PSM]>') AS x FROM o)
  SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN x[2] || x[4] || x[3] ELSE x[3] || x[4] || x[2] END) AS restored_sha256 FROM x"""

#: Every kept term of every group is a row here, zeros included, where the operator tallies pairs of counts.
_DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  t AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
  v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
  g AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
  m AS (SELECT lang, source, term, coalesce(c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
  a AS (SELECT lang, source, term, c, sum(c) OVER (PARTITION BY lang, source) AS n, sum(c) OVER (PARTITION BY lang, term) AS lc, sum(c) OVER (PARTITION BY lang) AS ln FROM m),
  p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lc + 5)) // (ln + 5 * v) AS q FROM a JOIN v USING (lang)),
  s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source != y.source GROUP BY ALL),
  e AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source != y.source
    LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
  w AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE c > 0 AND p > q),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM e UNION ALL FROM w))
  SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50"""

#: Sets are compared member by member here, and links followed from each set.
_NGRAMS = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS g FROM w),
  d AS (SELECT doc_id, len(g)::BIGINT AS n, CASE WHEN len(g) > 0 THEN md5(array_to_string(g, chr(10))) END AS node, g FROM g),
  c AS (SELECT node, min(doc_id) AS least, any_value(n) AS n, any_value(g) AS g FROM d WHERE node IS NOT NULL GROUP BY node),
  m AS (SELECT least, n, unnest(g) AS x FROM c),
  l AS (SELECT a.least AS u, b.least AS v FROM m a JOIN m b ON a.x = b.x AND a.least != b.least AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
    GROUP BY a.least, a.n, b.least, b.n HAVING 180 * count(*) >= 80 * (a.n + b.n)),
  r AS (SELECT least AS u, least AS v FROM c UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
  k AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
  SELECT d.doc_id, d.n AS n_shingles, coalesce(k.component_id, d.doc_id) AS component_id FROM d LEFT JOIN c USING (node) LEFT JOIN k ON c.least = k.u"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can say; the others have plain Python in tests/llm."""
    return {"op2_quality_rules": _QUALITY, "op11_fill_in_middle": _FIM, "op12_source_divergence": _DIVERGENCE, "op13_ngram_join": _NGRAMS}
