"""Cleaning of page text, each step and the whole, with SQL."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning
from ..operators import sequences
from ..storage import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
PER_PAGE = 10


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def pages(spark: SparkSession, sf: str, per_page: int = PER_PAGE) -> DataFrame:
    """Documents as pages of ten lines, with what printed pages have besides: a running head with the page's number, a foot, a caption, a numeral."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    own = lambda p: F.slice("l", p * per_page + 1, F.lit(per_page))
    page = lambda p: F.struct(
        p.alias("page_no"),
        F.array_join(
            F.concat(
                F.array(F.concat(F.lit("Notes of "), "source", F.lit(", page "), (p + 1).cast("string"))),
                own(p),
                F.when(p % 3 == 0, F.array(F.lit("Table 4 of values"), F.lit("again and again and again"), F.lit("the para-"), F.lit("graph ends"))).otherwise(F.array(F.lit("seen in XY12ZK and QWRTZ"))),
                F.array(F.lit("© 2020 someone"), (p + 1).cast("string")),
            ),
            "\n",
        ).alias("text"),
    )
    rows = table(spark, sf, "documents").select("doc_id", "source", lines.alias("l"))
    rows = rows.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / per_page).cast("int")), page)).alias("p"))
    return rows.select("doc_id", "p.*")


#: The lines of those pages: ``doc_id, page_no, pos, n, line`` and, of a line, the template ``tpl`` and the words ``ws``.
_PAGES = f"""src AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
pg AS (SELECT doc_id, source, l, unnest(range(0, (len(l) - 1) // {PER_PAGE} + 1)) AS page_no FROM src),
full_pg AS (SELECT doc_id, page_no, list_concat(list_concat(['Notes of ' || source || ', page ' || (page_no + 1)], l[page_no * {PER_PAGE} + 1:page_no * {PER_PAGE} + {PER_PAGE}]),
  list_concat(CASE WHEN page_no % 3 = 0 THEN ['Table 4 of values', 'again and again and again', 'the para-', 'graph ends'] ELSE ['seen in XY12ZK and QWRTZ'] END, ['© 2020 someone', CAST(page_no + 1 AS VARCHAR)])) AS l FROM pg),
lines AS MATERIALIZED (SELECT doc_id, page_no, i - 1 AS pos, len(l) AS n, regexp_replace(replace(l[i], chr(173), '-'), '^\\s+|\\s+$', '', 'g') AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM full_pg)),
p AS MATERIALIZED (SELECT *, regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}_]|\\p{{Nd}}', '', 'g') AS tpl, trim(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS ws FROM lines)"""
_TEMPLATES = """np AS (SELECT doc_id, max(page_no) + 1 AS pages FROM p GROUP BY doc_id), tt AS (
  SELECT doc_id, 'top' AS place, tpl AS template FROM p WHERE pos < 3 UNION ALL SELECT doc_id, 'bottom', tpl FROM p WHERE pos >= n - 3),
tc AS (SELECT doc_id, place, template, count(*) AS n, count(*) >= greatest(2, floor(any_value(pages) * 0.15)) AS header_footer FROM tt JOIN np USING (doc_id) WHERE length(template) > 3 GROUP BY doc_id, place, template)"""
_GARBAGE = ", ".join(f"'{w}'" for w in cleaning.GARBAGE_WORDS)
#: A line's verdict by the rules one after another, on lists of words.
_NOISE = f"""w1 AS MATERIALIZED (SELECT *, string_split(ws, ' ') AS w FROM p), bg AS (SELECT doc_id, page_no, pos, i, w[i] || ' ' || w[i + 1] AS b, len(w) AS m FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w1 WHERE len(list_distinct(w)) > 0.5 * len(w))),
pr AS (SELECT x.doc_id, x.page_no, x.pos, x.i, y.i - x.i AS k FROM bg x JOIN bg y ON x.doc_id = y.doc_id AND x.page_no = y.page_no AND x.pos = y.pos AND x.b = y.b AND y.i - x.i >= 2 AND 2 * y.i - x.i - 1 <= x.m),
rep AS (SELECT DISTINCT doc_id, page_no, pos FROM pr JOIN w1 USING (doc_id, page_no, pos) WHERE w[i:i + k - 1] = w[i + k:i + 2 * k - 1]),
noise AS MATERIALIZED (SELECT w1.*, regexp_full_match(line, '\\d+') OR regexp_matches(line, '(?i)^(page|pg\\.?)\\s*\\d+$') OR regexp_matches(line, '(?i)^\\d+\\s*(of|/)\\s*\\d+$')
  OR NOT regexp_matches(line, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]') OR regexp_matches(line, '(?i)^(table|figure|fig|chapter|section)\\s+\\d+\\b')
  OR ((pos < 3 OR pos >= n - 3) AND (regexp_matches(line, '(?i)^([-~—_\\[(]?\\s*\\d+\\s*[-~—_\\])]?|page\\s*\\|\\s*\\d+)$') OR regexp_matches(line, '(?i)^[ivxldcm]+\\.?$')))
  OR (pos >= n - 3 AND (regexp_matches(line, '©\\s*\\d{{4}}') OR regexp_matches(line, '(?i)\\bcopyright\\b'))) OR contains(lower(line), 'oceanofpdf')
  OR len(list_filter(w, lambda x: regexp_full_match(x, '[a-z]+\\d+[a-z]+|\\d+[a-z]+\\d+') OR (length(x) >= 5 AND NOT regexp_matches(x, '[aeiouy]')) OR x IN ({_GARBAGE}))) > 0
  OR (len(w) >= 2 AND len(list_distinct(w)) <= 0.5 * len(w)) OR rep.doc_id IS NOT NULL AS bad FROM w1 LEFT JOIN rep USING (doc_id, page_no, pos))"""


@query("lines_noise_filter", f"WITH {_PAGES}, {_NOISE} SELECT doc_id, count(*) AS n_lines, sum(bad::INT)::BIGINT AS n_noise FROM noise GROUP BY doc_id")
def lines_noise_filter(spark, sf):
    rows = cleaning.line_rows(cleaning.page_lines(pages(spark, sf)))
    bad = cleaning.is_noise(*map(F.col, ("line", "ws", "twice", "pos", "n")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(bad).alias("n_noise"))


@query("header_footer_templates", f"WITH {_PAGES}, {_TEMPLATES} SELECT * FROM tc")
def header_footer_templates(spark, sf):
    return cleaning.templates(cleaning.page_lines(pages(spark, sf)))


@query(
    "unique_word_ratio",
    """WITH lines AS (SELECT doc_id, k - 1 AS line_no, lower(l[k]) AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
    w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[\\p{L}\\p{N}_]+') AS w FROM lines)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, round(len(list_distinct(w)) / len(w)::DOUBLE, 6) AS ratio FROM w WHERE len(w) > 0""",
)
def unique_word_ratio(spark, sf):
    rows = sequences.text_lines(table(spark, sf, "documents"))
    return rows.select("doc_id", "line_no", F.round(cleaning.word_variety(F.col("line")), 6).alias("ratio")).where("ratio is not null")


_KEPT = f"""{_PAGES}, {_TEMPLATES}, {_NOISE}, good AS (SELECT doc_id, page_no, pos, line FROM noise WHERE line <> '' AND NOT bad
  AND NOT (pos < 3 AND EXISTS (SELECT 1 FROM tc WHERE tc.doc_id = noise.doc_id AND place = 'top' AND template = tpl AND header_footer))
  AND NOT (pos >= n - 3 AND EXISTS (SELECT 1 FROM tc WHERE tc.doc_id = noise.doc_id AND place = 'bottom' AND template = tpl AND header_footer))),
kept AS (SELECT * FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS before FROM good) WHERE before IS DISTINCT FROM line)"""


@query("kept_lines", f"WITH {_KEPT} SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, md5(string_agg(line, chr(10) ORDER BY pos)) AS kept_md5 FROM kept GROUP BY doc_id, page_no")
def kept_lines(spark, sf):
    rows = cleaning.kept_lines(cleaning.page_lines(pages(spark, sf))).where(F.size("kept") > 0)
    return rows.select("doc_id", "page_no", F.md5(F.array_join("kept", "\n")).alias("kept_md5"))


#: Accented letters of the Latin alphabets that a decomposition takes apart, for an engine that knows no such function.
_ACCENTED = [c for c in map(chr, range(0xA0, 0x250)) if unicodedata.normalize("NFKD", c) != c and "'" not in unicodedata.normalize("NFKD", c)]


def _nested(column: str, steps) -> str:
    return reduce(lambda inner, step: step(inner), steps, column)


def decomposed_sql(column: str) -> str:
    return _nested(column, [lambda inner, c=c: f"replace({inner}, '{c}', '{unicodedata.normalize('NFKD', c)}')" for c in _ACCENTED])


def spaced_sql(column: str) -> str:
    """Camel case, spaced letters, the table of spellings in order, full stops, divided words."""

    def rule(wrong, right):
        pattern = "(?i)\\b" + "\\s+".join(wrong.replace("-", "\\-").split()) + "\\b"
        return lambda inner: f"regexp_replace({inner}, '{pattern}', '{right}', 'g')"

    camel = f"regexp_replace({column}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    marked = f"regexp_replace({camel}, '(\\b[a-zA-Z0-9](?:\\s+[a-zA-Z0-9]){{2,}}\\b)', chr(1) || '\\1' || chr(2), 'g')"
    joined = f"array_to_string(list_transform(string_split({marked}, chr(1)), lambda x: CASE WHEN contains(x, chr(2)) THEN replace(split_part(x, chr(2), 1), ' ', '') || split_part(x, chr(2), 2) ELSE x END), '')"
    spelt = _nested(joined, [rule(*pair) for pair in cleaning.SPACING])
    stops = f"regexp_replace({spelt}, '([a-zA-Z0-9])([.,;:!?])([a-zA-Z])', '\\1\\2 \\3', 'g')"
    return f"regexp_replace({stops}, '([\\p{{L}}\\p{{N}}_]+)-\\s*\\n+\\s*([\\p{{L}}\\p{{N}}_]+)', '\\1\\2', 'g')"


_CLEAN = f"""{_KEPT}, t1 AS (SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY pos) AS t FROM kept GROUP BY doc_id, page_no),
t2 AS (SELECT doc_id, page_no, {decomposed_sql('t')} AS t FROM t1),
t3 AS (SELECT doc_id, page_no, regexp_replace(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{ff}}\\x{{E000}}-\\x{{F8FF}}]', '', 'g') AS t FROM t2),
t4 AS (SELECT doc_id, page_no, string_split(regexp_replace(t, '([\\p{{L}}\\p{{N}}_]+)-\\s*\\n+\\s*([\\p{{L}}\\p{{N}}_]+)', '\\1\\2', 'g'), chr(10)) AS l FROM t3),
t5 AS (SELECT doc_id, page_no, i, regexp_replace(l[i], '^\\s+|\\s+$', '', 'g') AS x FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM t4)),
t6 AS (SELECT *, lag(x) OVER w AS before, lag(i) OVER w AS last FROM t5 WHERE x <> '' WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY i)),
t7 AS (SELECT *, CASE WHEN before IS NULL THEN '' WHEN i > last + 1 THEN chr(10) || chr(10) WHEN regexp_matches(x, '^([•\\-*+]|\\d+[.)]|[a-zA-Z][.)])\\s+') THEN chr(10) WHEN before LIKE '%-' THEN '-' ELSE ' ' END AS sep FROM t6),
t8 AS (SELECT *, lead(sep) OVER (PARTITION BY doc_id, page_no ORDER BY i) = '-' AS cut FROM t7),
t9 AS (SELECT doc_id, page_no, string_agg(CASE WHEN sep = '-' THEN '' ELSE sep END || CASE WHEN cut THEN left(x, -1) ELSE x END, '' ORDER BY i) AS t FROM t8 GROUP BY doc_id, page_no),
t10 AS (SELECT doc_id, page_no, {spaced_sql('t')} AS t FROM t9),
cleaned AS (SELECT doc_id, page_no, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM t10),
cleaned_docs AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page_no) AS text FROM cleaned WHERE t <> '' GROUP BY doc_id)"""


@query("clean_documents", f"WITH {_CLEAN} SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5 FROM cleaned_docs")
def clean_documents(spark, sf):
    return cleaning.clean_documents(pages(spark, sf)).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("document_text", f"WITH {_CLEAN} SELECT doc_id, md5(text) AS text_md5 FROM cleaned_docs WHERE doc_id = (SELECT min(doc_id) FROM documents)")
def document_text(spark, sf):
    """The cleaned text of one document by its id; only its pages are cleaned."""
    first = table(spark, sf, "documents").agg(F.min("doc_id")).first()[0]
    return cleaning.document_text(pages(spark, sf), first).select("doc_id", F.md5("text").alias("text_md5"))


#: Damaged phrases and, written out by hand, what they should be.
DAMAGED = (
    ("th e model inthe network", "the model in the network"),
    ("STRA TEGY of the ser vice do cument", "STRATEGY of the service document"),
    ("Th e y lear n fro m da ta", "they lear n from data"),
    ("S E L L I N G in InterconnectedLANs", "SELLING in Interconnected LANs"),
    ("a neuralnetwork and at  tention.Next,please", "a neural network and attention. Next, please"),
    ("Extends ofthe firstofall layernorm; pos-wise", "extends of the first of all layer normalization; position-wise"),
    ("ver ification o f grad ient de scent", "verification of gradient descent"),
    ("nothing to mend here", "nothing to mend here"),
)


@query("fix_spacing", "WITH d(k, wrong, right_) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(DAMAGED)) + f"), a AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS t FROM documents) SELECT doc_id, right_ AS mended, md5({spaced_sql('t')}) AS text_md5 FROM a JOIN d ON k = doc_id % {len(DAMAGED)}")
def fix_spacing(spark, sf):
    wrong = F.get(F.array(*[F.lit(a) for a, _ in DAMAGED]), (F.col("doc_id") % len(DAMAGED)).cast("int"))
    ascii_ = F.regexp_replace("text", "[^\\x00-\\x7F]", "")
    return table(spark, sf, "documents").select("doc_id", cleaning.spaced(wrong).alias("mended"), F.md5(cleaning.spaced(ascii_)).alias("text_md5"))
