"""The ``opN_<name>`` queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpecount, chat, dac, decontaminate, divergence, langid, ngram_join, packing, quality, resample, substring_dedup, suffix_dedup, toxicity
from .runtime import shared_dir, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids: one row per piece."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), window=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the most similar window."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("hamming").withColumn("similarity", F.round("similarity", 6))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered and canonically rendered turns of every conversation."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    return bpecount.token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the robust outlier verdict of every document."""
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as directly addressable codes and read back from the files."""
    out = f"{shared_dir(spark)}/weft-tokens-{uuid.uuid4().hex}"
    dac.write_tokens(table(spark, sf_dir, "documents"), out, end_id=1)
    return dac.read_tokens(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes when every byte covered by a repeated 200-byte string is removed."""
    return suffix_dedup.removals(table(spark, sf_dir, "documents"), length=200).drop("spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows that are not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's n-grams."""
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=25, min_words=20, n_buckets=10_000, max_n=2, seed=7)
    return drawn.drop("n_words")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes when every window of 50 words that an earlier document has is removed."""
    return substring_dedup.removals(table(spark, sf_dir, "documents"), length=50).drop("spans").withColumn("longest", F.coalesce("longest", F.lit(0)))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each source from the others of its language, and the terms that set it off."""
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=3, top_terms=200)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_decontamination": op2_decontamination,
        "op3_chat_format": op3_chat_format,
        "op4_token_counts": op4_token_counts,
        "op5_ngram_join": op5_ngram_join,
        "op6_language_id": op6_language_id,
        "op7_quality_rules": op7_quality_rules,
        "op8_token_files": op8_token_files,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_resampling": op11_resampling,
        "op12_substring_dedup": op12_substring_dedup,
        "op13_divergence": op13_divergence,
    }


_OP3 = """
SELECT conv_id,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS turn_no,
       lower(trim(role)) AS role,
       coalesce(text, '') AS text,
       '<|' || lower(trim(role)) || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' AS rendered
FROM conversations
"""

#: Weighted Jaccard similarity of every window of an item's size that shares a shingle with it; the best window of each document and item.
_OP2_WORDS = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_OP2 = f"""
WITH dw AS (SELECT doc_id, {_OP2_WORDS} AS w FROM documents WHERE text IS NOT NULL
), iw AS (SELECT item_id, {_OP2_WORDS} AS w FROM benchmark WHERE text IS NOT NULL
), ds AS (SELECT doc_id, n, j, array_to_string(w[j + 1:j + 5], ' ') AS g FROM (SELECT doc_id, w, len(w) AS n, unnest(range(0, len(w) - 4)) AS j FROM dw)
), bs AS (SELECT item_id, m, o, array_to_string(w[o + 1:o + 5], ' ') AS g FROM (SELECT item_id, w, len(w) AS m, unnest(range(0, len(w) - 4)) AS o FROM iw)
), total AS (SELECT count(*)::DOUBLE AS n_items FROM iw
), wt AS (SELECT g, CAST(round((1 + ln(any_value(n_items) / count(DISTINCT item_id))) * 1048576) AS BIGINT) AS w FROM bs, total GROUP BY g
), meet AS (SELECT DISTINCT doc_id, item_id, j, least(m, n) AS k, n FROM ds JOIN bs USING (g)
), win AS (
  SELECT DISTINCT doc_id, item_id, k, unnest(range(greatest(j - k + 5, 0), least(j, n - k) + 1)) AS s FROM meet
), a AS (
  SELECT win.doc_id, win.item_id, s, k, ds.g, count(*) AS c, coalesce(any_value(wt.w), any_value(CAST(round((1 + ln(n_items)) * 1048576) AS BIGINT))) AS w
  FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.j BETWEEN s AND s + k - 5 LEFT JOIN wt ON wt.g = ds.g, total GROUP BY ALL
), b AS (SELECT item_id, g, count(*) AS c FROM bs GROUP BY ALL
), size AS (SELECT item_id, sum(c * wt.w) AS whole FROM b JOIN wt USING (g) GROUP BY item_id
), sim AS (
  SELECT a.doc_id, a.item_id, s, k, sum(a.w * least(a.c, coalesce(b.c, 0))) AS low, sum(a.w * a.c) AS mine
  FROM a LEFT JOIN b ON b.item_id = a.item_id AND b.g = a.g GROUP BY ALL
), best AS (
  SELECT *, low / (mine + whole - low) AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY low / (mine + whole - low) DESC, s) AS rn FROM sim JOIN size USING (item_id)
)
SELECT doc_id, item_id, s AS start_word, k AS n_words, round(similarity, 6) AS similarity FROM best WHERE rn = 1 AND similarity >= 0.8
"""

#: Connected components of the linked pairs, by recursion over the distinct (shingle, document) rows.
_OP5 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * c >= 90 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(c) AS component_id FROM r GROUP BY id) m USING (doc_id)
"""


#: Every 200-byte window by its digest; covered bytes as islands of window starts; the rest is what lies between islands.
_OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i FROM d)
), r AS (SELECT s FROM p GROUP BY s HAVING count(*) > 1
), c AS (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + 200 THEN 1 ELSE 0 END AS cut FROM p SEMI JOIN r USING (s) WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), g AS (SELECT doc_id, i, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM c
), t AS (SELECT doc_id, span, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, span
), k AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER w, 0) AS after, lead(a) OVER w IS NULL AS is_last FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY a)
), x AS (
  SELECT k.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * after + 1, 2 * (a - after)) || CASE WHEN is_last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
  FROM k JOIN d USING (doc_id) GROUP BY k.doc_id
)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""


#: CRC-32 of each distinct feature, byte by byte over a table of remainders that is itself derived.
_OP11 = """
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) AS r(i))
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), q AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), df AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM d
), qf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM q
), codes AS (
  SELECT g, xor(list_reduce(list_transform(range(0, octet_length(encode(g))), lambda i: CAST('0x' || substr(hex(encode(g)), 2 * i + 1, 2) AS BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT g FROM df UNION SELECT g FROM qf), tab
), s AS (SELECT bucket, count(*) AS s FROM df JOIN codes USING (g) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM qf JOIN codes USING (g) GROUP BY bucket
), totals AS (SELECT (SELECT count(*) FROM df)::DOUBLE AS s_all, (SELECT count(*) FROM qf)::DOUBLE AS t_all
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain
  FROM (SELECT bucket FROM codes GROUP BY bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals
), w AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM df JOIN codes USING (g) JOIN gain USING (bucket) GROUP BY r
), x AS (
  SELECT d.r, doc_id, len(w) >= 20 AS able, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN w USING (r)
), y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x
), z AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY able) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM z
"""


#: Every 50-word window by its digest; what an earlier document has is removed. Windows of each doubled length have the digest of their halves' digests.
_OP12 = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)
), r AS (SELECT doc_id, i FROM p JOIN (SELECT s, min(doc_id) AS lo FROM p GROUP BY s) m USING (s) WHERE lo < doc_id
), u AS (
  SELECT 50::BIGINT AS size, doc_id, i, s FROM p
  UNION ALL SELECT 2 * a.size, a.doc_id, a.i, md5(a.s || b.s) FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.i = a.i + a.size
), longest AS (
  SELECT doc_id, max(size) AS longest FROM u JOIN (SELECT size, s, min(doc_id) AS lo FROM u GROUP BY size, s) USING (size, s) WHERE lo < doc_id GROUP BY doc_id
), c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM r
), k AS (
  SELECT doc_id, count(c.j) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY e.j) FILTER (c.j IS NULL), '') AS kept
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS j FROM d) e LEFT JOIN c USING (doc_id, j) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(longest, 0) AS longest
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

#: Each pair of sources against every kept term of the language, whole numbers of 128 bits.
_OP13 = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), e AS (SELECT r, lang, source, unnest(w) AS term FROM d
), k AS (SELECT lang, term, count(*) AS n FROM e GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), c AS (SELECT lang, source, term, count(*) AS n FROM e SEMI JOIN k USING (lang, term) GROUP BY ALL
), v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS lang_total FROM k GROUP BY lang
), g AS (
  SELECT x.lang, x.source, coalesce(total, 0)::HUGEINT AS total, v, lang_total FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) y ON x.lang = y.lang AND x.source = y.source LEFT JOIN v ON v.lang = x.lang
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS own, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (total + v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 1) // (lang_total + v) AS q
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE own > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    """Only where SQL gives the whole result; the others are tested against brute force in ``tests/llm``."""
    return {"op2_decontamination": _OP2, "op3_chat_format": _OP3, "op5_ngram_join": _OP5, "op9_suffix_dedup": _OP9, "op11_resampling": _OP11, "op12_substring_dedup": _OP12, "op13_divergence": _OP13}
