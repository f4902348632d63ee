"""Names, clusters, canonical nodes and relations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import resolve
from ..storage import materialise, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# ---- cleaning of names ---------------------------------------------------------------------------------------------------

#: Part names in four states of untidiness.
_RAW = "raw AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'the ' || p_name || 's,' WHEN 2 THEN '\"' || upper(p_name) || '\"' ELSE p_name || ' of a ' || p_type END AS raw FROM part)"


def raw_names(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("the "), "p_name", F.lit("s,"))).when(k == 2, F.concat(F.lit('"'), F.upper("p_name"), F.lit('"'))).otherwise(F.concat("p_name", F.lit(" of a "), "p_type"))
    return p.select("p_partkey", raw.alias("raw"))


_EDGE = "|".join(sorted(names.EDGE_WORDS, key=lambda w: (-len(w), w)))
SINGULAR = """CASE WHEN lower({0}) LIKE '%ies' THEN left({0}, -3) || 'y' WHEN lower({0}) LIKE '%ices' THEN left({0}, -4) || 'ex' WHEN lower({0}) LIKE '%es' THEN left({0}, -2)
  WHEN lower({0}) LIKE '%s' AND NOT regexp_matches(lower({0}), '(ss|us|is)$') THEN left({0}, -1) ELSE {0} END"""


def normal_sql(raw: str, source: str, keep: str) -> str:
    """Tables ``{source}1 .. {source}_norm`` with ``name`` cleaned from the column ``raw`` of ``source``; the columns ``keep`` go along."""
    return f"""{source}1 AS (SELECT {keep}, regexp_replace(regexp_replace(regexp_replace(trim({raw}), '^["''`*_]+|["''`*_]+$', '', 'g'), '[,.;:-]+$', ''), '\\s+', ' ', 'g') AS n FROM {source}),
{source}2 AS (SELECT {keep}, regexp_replace(regexp_replace(n, '(?i)^(?:(?:{_EDGE})(?: |$))+', ''), '(?i)(?:(?:^| )(?:{_EDGE}))+$', '') AS n FROM {source}1),
{source}3 AS (SELECT {keep}, {SINGULAR.format('n')} AS n FROM {source}2),
{source}_norm AS (SELECT {keep}, array_to_string(list_transform(string_split(n, ' '), lambda w: CASE WHEN upper(w) = w AND lower(w) <> w AND length(w) > 1 THEN w ELSE
  array_to_string(list_transform(string_split(w, '-'), lambda p: upper(left(p, 1)) || substr(p, 2)), '-') END), ' ') AS name FROM {source}3)"""


NORM = f"{_RAW}, {normal_sql('raw', 'raw', 'p_partkey, raw')}, norm AS (SELECT * FROM raw_norm)"


@query("normalize_names", f"WITH {NORM} SELECT p_partkey, raw, name FROM norm")
def normalize_names(spark, sf):
    return raw_names(spark, sf).select("p_partkey", "raw", names.normalize_name(F.col("raw")).alias("name"))


def quality_sql(source: str, keep: str, generic: str) -> str:
    """Tables ``q`` and ``quality`` with the score of ``name`` of ``source``; ``generic``: a subquery of general nouns."""
    return f"""q AS (SELECT {keep}, name, lower(name) AS low, string_split(lower(name), ' ') AS ws, lower(name) IN ({generic}) OR lower(name) IN ({_listed(names.generic_words())}) AS general,
  lower(name) LIKE '%s' AND NOT regexp_matches(lower(name), '(ss|us|is)$') AND (left(lower(name), -1) IN ({generic}) OR left(lower(name), -1) IN ({_listed(names.generic_words())})) AS generals FROM {source}),
quality AS (SELECT {keep}, name, CASE
  WHEN length(name) < 3 OR len(ws) > 4 OR length(name) > 40 OR (len(ws) = 1 AND length(name) > 17) OR regexp_matches(name, '[.!?;:]\\s') THEN 0.0
  WHEN list_has_any(ws, [{_listed(names.SENTENCE_VERBS)}]) OR list_has_any(ws, [{_listed(names.SPAM_WORDS)}]) OR regexp_matches(low, 'abc xyz|xyz qwe|testtest') THEN 0.0
  WHEN length(name) < 4 AND NOT (regexp_replace(name, '[^a-zA-Z]', '', 'g') <> '' AND upper(regexp_replace(name, '[^a-zA-Z]', '', 'g')) = regexp_replace(name, '[^a-zA-Z]', '', 'g')) THEN 0.0
  WHEN general OR generals THEN 0.0
  WHEN len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1] AND length(ws[i]) >= 2)) > 0 THEN 0.0
  WHEN len(list_filter(range(1, length(low) + 1), lambda i: len(list_filter(range(3, length(low) // 2 + 1), lambda k: substr(low, i, k) = substr(low, i + k, k) AND regexp_full_match(substr(low, i, k), '\\w+'))) > 0)) > 0 THEN 0.0
  WHEN regexp_matches(low, '\\b[a-z]+\\d+[a-z]+\\b|\\b\\d+[a-z]+\\d+\\b') OR len(list_filter(ws, lambda w: length(w) >= 4 AND NOT regexp_matches(w, '[aeiouy]'))) > 0 THEN 0.0
  WHEN length(regexp_replace(name, '[a-zA-Z0-9\\s-]', '', 'g')) > 2 THEN 0.1 WHEN regexp_matches(name, '\\d{{3,}}') THEN 0.2
  WHEN regexp_matches(name, '^[_\\-\\d\\s\\W]+$') OR regexp_matches(low, '^(chapter|section|figure|table|page|index|appendix|vol|volume|no|part|fig)\\b') THEN 0.0
  WHEN regexp_matches(low, '^(for example|such as|based on|due to|in order to)') THEN 0.1 ELSE 1.0 END::DOUBLE AS quality FROM q)"""


#: Names of every kind that the ladder knows: tidy, generic (a noun alone, also in the plural), sentences, spam, codes, headings, too long.
_TRIED = """tried AS (SELECT p_partkey, CASE p_partkey % 13 WHEN 0 THEN string_split(p_name, ' ')[2] WHEN 1 THEN string_split(p_name, ' ')[2] || 's' WHEN 2 THEN p_name || ' is old' WHEN 3 THEN p_name || ' ' || p_name
  WHEN 4 THEN 'Lorem ' || p_name WHEN 5 THEN 'XY' || p_size || 'ZK' WHEN 6 THEN 'Section ' || p_size WHEN 7 THEN p_name || ' ' || p_type || ' ' || p_brand || ' x y' WHEN 8 THEN upper(left(p_type, 3)) WHEN 9 THEN p_name || ' ' || (1000 + p_size)
  WHEN 10 THEN 'such as ' || p_name WHEN 11 THEN p_name || ' (a) [b]' ELSE p_name END AS raw FROM part), generic AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS w FROM part)"""


def _tried(spark, sf):
    p = table(spark, sf, "part")
    noun = F.element_at(F.split("p_name", " "), 2)
    kinds = [
        noun, F.concat(noun, F.lit("s")), F.concat("p_name", F.lit(" is old")), F.concat_ws(" ", "p_name", "p_name"), F.concat(F.lit("Lorem "), "p_name"), F.concat(F.lit("XY"), "p_size", F.lit("ZK")),
        F.concat(F.lit("Section "), "p_size"), F.concat_ws(" ", "p_name", "p_type", "p_brand", F.lit("x y")), F.upper(F.substring("p_type", 1, 3)), F.concat("p_name", F.lit(" "), F.col("p_size") + 1000),
        F.concat(F.lit("such as "), "p_name"), F.concat("p_name", F.lit(" (a) [b]")),
    ]
    raw = F.col("p_name")
    for i, one in enumerate(kinds):
        raw = F.when(F.col("p_partkey") % 13 == i, one).otherwise(raw)
    return p.select("p_partkey", raw.alias("raw"))


def _nouns(spark, sf) -> list[str]:
    """General nouns for the tests: what the parts are."""
    return [r[0] for r in table(spark, sf, "part").select(F.element_at(F.split("p_name", " "), 2)).distinct().collect()]


@query("entity_quality", f"WITH {_TRIED}, {normal_sql('raw', 'tried', 'p_partkey')}, {quality_sql('tried_norm', 'p_partkey', 'SELECT w FROM generic')} SELECT p_partkey, name, quality FROM quality")
def entity_quality(spark, sf):
    score = names.entity_quality(F.col("raw"), F.lit("Concept"), _nouns(spark, sf))
    return _tried(spark, sf).select("p_partkey", names.normalize_name(F.col("raw")).alias("name"), score.alias("quality"))


@query("quality_gate", f"WITH {_TRIED}, {normal_sql('raw', 'tried', 'p_partkey')}, {quality_sql('tried_norm', 'p_partkey', 'SELECT w FROM generic')} SELECT p_partkey % 13 AS doc_id, round(avg((quality <= 0.7)::INT), 6) AS low_share, avg((quality <= 0.7)::INT) <= 0.8 AS passed FROM quality GROUP BY 1")
def quality_gate(spark, sf):
    score = names.entity_quality(F.col("raw"), F.lit("Concept"), _nouns(spark, sf))
    rows = _tried(spark, sf).select((F.col("p_partkey") % 13).alias("doc_id"), score.alias("quality"))
    return resolve.quality_gate(rows).withColumn("low_share", F.round("low_share", 6))


# ---- similarity ----------------------------------------------------------------------------------------------------------

_SHORT = "('of', 'and', 'in', 'from', 'for', 'with', 'the')"


def features_sql(source: str) -> str:
    """Table ``ft`` with what the similarity of names looks at, for the distinct ``name`` of ``source``."""
    cut = "regexp_replace(w, '[,.;:()\\[\\]{}_-]+$', '')"
    plural = "CASE WHEN w LIKE '%ies' THEN left(w, -3) || 'y' WHEN w LIKE '%es' AND w NOT LIKE '%see' THEN left(w, -2) WHEN w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, -1) ELSE w END"
    return f"""fn AS (SELECT DISTINCT name, lower(trim(name)) AS low FROM {source}), ft AS (SELECT name, low, regexp_split_to_array(low, '\\s+') AS words,
  list_filter(list_transform(list_transform(list_transform(regexp_split_to_array(replace(low, '-', ' '), '\\s+'), lambda w: {cut}), lambda w: {plural}), lambda w: CASE WHEN w LIKE '%ing' THEN left(w, -3) ELSE w END), lambda w: w <> '') AS st,
  regexp_replace(low, '[^a-z]', '', 'g') AS letters, list_filter(regexp_split_to_array(regexp_replace(low, '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS plain FROM fn)"""


def similar_sql(a: str, b: str) -> str:
    def acronym(x, y):
        first = f"array_to_string(list_transform({y}.plain, lambda w: left(w, 1)), '')"
        main = f"array_to_string(list_transform(list_filter({y}.plain, lambda w: w NOT IN {_SHORT}), lambda w: left(w, 1)), '')"
        return f"(length({x}.letters) BETWEEN 2 AND 6 AND len({y}.plain) >= 2 AND ({x}.letters = {first} OR {x}.letters = {main}))"

    short = f"CASE WHEN length({a}.low) < length({b}.low) THEN {a}.low ELSE {b}.low END"
    long = f"CASE WHEN length({a}.low) < length({b}.low) THEN {b}.low ELSE {a}.low END"
    first = f"CASE WHEN length({a}.low) < length({b}.low) THEN {a}.words[1] ELSE {b}.words[1] END"
    rest = f"CASE WHEN length({a}.low) < length({b}.low) THEN {b}.words ELSE {a}.words END"
    return f"""({a}.low = {b}.low OR {acronym(a, b)} OR {acronym(b, a)} OR {a}.st = {b}.st OR len(list_intersect({a}.st, {b}.st)) >= 0.6 * len(list_distinct(list_concat({a}.st, {b}.st)))
  OR (length({a}.low) > 4 AND length({b}.low) > 4 AND contains({long}, {short}) AND list_contains({rest}, {first})))"""


#: Tidy names, phrases of three and four words, and the initials of those with and without short words.
_POOL = f"""{NORM}, pool AS (SELECT name FROM norm UNION SELECT p_name || ' ' || lower(p_type) FROM part UNION SELECT p_name || ' of ' || lower(p_type) FROM part
  UNION SELECT upper(left(p_name, 1) || left(string_split(p_name, ' ')[2], 1) || left(p_type, 1)) FROM part UNION SELECT upper(left(p_name, 1) || left(string_split(p_name, ' ')[2], 1) || 'o' || left(p_type, 1)) FROM part)"""


def _pool(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    noun = F.element_at(F.split("p_name", " "), 2)
    initial = lambda *cs: F.upper(F.concat(*[F.substring(c, 1, 1) if not isinstance(c, str) else F.lit(c) for c in cs]))
    made = [F.concat_ws(" ", "p_name", F.lower("p_type")), F.concat_ws(" ", "p_name", F.lit("of"), F.lower("p_type")), initial(F.col("p_name"), noun, F.col("p_type")), initial(F.col("p_name"), noun, "o", F.col("p_type"))]
    out = raw_names(spark, sf).select(names.normalize_name(F.col("raw")).alias("name"))
    return out.unionByName(p.select(F.explode(F.array(*made)).alias("name"))).distinct()


@query("acronym_pairs", f"WITH {_POOL}, {features_sql('pool')}, s AS (SELECT * FROM ft WHERE length(name) <= 4) SELECT s.name AS short, p.name AS phrase, (length(s.letters) BETWEEN 2 AND 6 AND len(p.plain) >= 2 AND s.letters IN (array_to_string(list_transform(p.plain, lambda w: left(w, 1)), ''), array_to_string(list_transform(list_filter(p.plain, lambda w: w NOT IN {_SHORT}), lambda w: left(w, 1)), ''))) AS acronym FROM s JOIN ft p ON left(s.low, 1) = left(p.low, 1)")
def acronym_pairs(spark, sf):
    """Every short name against every name of the same first letter; most are no acronyms."""
    pool = _pool(spark, sf)
    short = pool.where(F.length("name") <= 4).select(F.col("name").alias("short"), F.lower(F.substring("name", 1, 1)).alias("k"))
    phrase = pool.select(F.col("name").alias("phrase"), F.lower(F.substring("name", 1, 1)).alias("k"))
    return short.join(phrase, "k").select("short", "phrase", names.is_acronym(F.col("short"), F.col("phrase")).alias("acronym"))


@query("name_similarity", f"WITH {_POOL}, {features_sql('pool')}, n AS (SELECT * FROM ft) SELECT a.name AS a, b.name AS b, {similar_sql('a', 'b')} AS similar FROM n a JOIN n b ON length(a.name) = length(b.name) + 2")
def name_similarity(spark, sf):
    pool = _pool(spark, sf)
    pairs = pool.select(F.col("name").alias("a"), (F.length("name") - 2).alias("k")).join(pool.select(F.col("name").alias("b"), F.length("name").alias("k")), "k")
    return pairs.select("a", "b", names.similar_names(F.col("a"), F.col("b")).alias("similar"))


@query("similar_pairs", f"WITH {_POOL}, {features_sql('pool')} SELECT a.name AS a, b.name AS b FROM ft a JOIN ft b ON a.name < b.name WHERE {similar_sql('a', 'b')}")
def similar_pairs(spark, sf):
    return resolve.similar_pairs(_pool(spark, sf))


# ---- clusters ------------------------------------------------------------------------------------------------------------

_MENTIONS = f"""{NORM}, men AS (SELECT CAST(p_partkey % 20 AS VARCHAR) AS doc_id, CAST(p_partkey AS INTEGER) AS ord, CASE p_partkey % 5 WHEN 0 THEN 'Topic' WHEN 1 THEN 'Keyword' ELSE 'Concept' END AS label, name,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'About ' || name END AS description, p_partkey < 40 AS is_existing FROM norm)"""


def _mentions(spark, sf):
    rows = raw_names(spark, sf).select((F.col("p_partkey") % 20).cast("string").alias("doc_id"), F.col("p_partkey").cast("int").alias("ord"), names.normalize_name(F.col("raw")).alias("name"))
    label = F.when(F.col("ord") % 5 == 0, "Topic").when(F.col("ord") % 5 == 1, "Keyword").otherwise("Concept")
    about = F.when(F.col("ord") % 3 == 0, "").otherwise(F.concat(F.lit("About "), "name"))
    return rows.select("doc_id", "ord", label.alias("label"), "name", about.alias("description"), (F.col("ord") < 40).alias("is_existing"))


#: Each name in turn joins the first cluster whose leader is similar, or leads a new one.
CLUSTERS = f"""{_MENTIONS}, mk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY is_existing DESC, ord) AS k FROM men WHERE name <> ''), {features_sql('men')},
alike AS (SELECT a.name AS x, b.name AS y FROM ft a, ft b WHERE {similar_sql('a', 'b')}),
near AS (SELECT a.doc_id, a.k, list(b.k) AS js FROM mk a JOIN alike ON x = a.name JOIN mk b ON b.doc_id = a.doc_id AND b.name = y AND b.k < a.k GROUP BY a.doc_id, a.k),
steps AS (SELECT mk.doc_id, mk.k, coalesce(js, []) AS js FROM mk LEFT JOIN near USING (doc_id, k)),
led AS (SELECT doc_id, CAST(1 AS BIGINT) AS k, [CAST(1 AS BIGINT)] AS leaders, CAST(0 AS BIGINT) AS cluster FROM steps WHERE k = 1
  UNION ALL SELECT s.doc_id, s.k, CASE WHEN h IS NULL THEN list_append(leaders, s.k) ELSE leaders END, CASE WHEN h IS NULL THEN len(leaders) ELSE list_position(leaders, h) - 1 END
  FROM (SELECT s.doc_id, s.k, led.leaders, list_filter(led.leaders, lambda x: list_contains(s.js, x))[1] AS h FROM led JOIN steps s ON s.doc_id = led.doc_id AND s.k = led.k + 1) s),
clustered AS (SELECT mk.*, CAST(led.cluster AS INTEGER) AS cluster FROM mk JOIN led USING (doc_id, k))"""


@query("leader_clusters", f"WITH RECURSIVE {CLUSTERS} SELECT doc_id, ord, cluster FROM clustered")
def leader_clusters(spark, sf):
    return resolve.leader_clusters(_mentions(spark, sf)).select("doc_id", "ord", "cluster")


_PRIORITY = "coalesce(list_position(['Topic', 'Paper', 'Author', 'Concept', 'Keyword'], {0}), 99)"
_TITLED = "(regexp_matches({0}, '[A-Za-z]') AND NOT regexp_matches({0}, '[A-Za-z][A-Z]|(^|[^A-Za-z])[a-z]'))"
_SWAP = f"""CASE WHEN x.is_existing AND NOT r.is_existing THEN x WHEN r.is_existing AND NOT x.is_existing THEN r WHEN {_PRIORITY.format('x.label')} < {_PRIORITY.format('r.label')} THEN x
  WHEN {_PRIORITY.format('x.label')} = {_PRIORITY.format('r.label')} AND (length(x.name) > length(r.name) OR ({_TITLED.format('x.name')} AND NOT {_TITLED.format('r.name')})) THEN x ELSE r END"""
CANONICAL = f"""{CLUSTERS}, folded AS (SELECT doc_id, cluster, list({{'label': label, 'name': name, 'is_existing': is_existing}} ORDER BY k) AS m, list(trim(description) ORDER BY k) FILTER (WHERE trim(description) <> '') AS d, count(*) AS members FROM clustered GROUP BY doc_id, cluster),
told AS (SELECT doc_id, cluster, list_reduce(m, lambda r, x: {_SWAP}) AS rep, members, coalesce(array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), ' '), '') AS t FROM folded),
canonical AS (SELECT doc_id, cluster, rep.label AS label, trim(rep.name) AS name, CASE WHEN length(t) > 300 THEN left(t, 297) || '...' ELSE t END AS description, CAST(members AS INTEGER) AS members FROM told)"""


@query("canonical_nodes", f"WITH RECURSIVE {CANONICAL} SELECT * FROM canonical")
def canonical_nodes(spark, sf):
    return resolve.canonical_nodes(resolve.leader_clusters(_mentions(spark, sf)))


_MAPPING = f"{CANONICAL}, mapping AS (SELECT c.doc_id, lower(trim(c.name)) AS key, arg_max(n.name, c.cluster) AS canonical FROM clustered c JOIN canonical n USING (doc_id, cluster) GROUP BY 1, 2)"


def _resolved(spark, sf):
    clustered = materialise(resolve.leader_clusters(_mentions(spark, sf)), "clusters")
    canonical = materialise(resolve.canonical_nodes(clustered), "canonical")
    return clustered, canonical, resolve.name_mapping(clustered, canonical)


@query("name_mapping", f"WITH RECURSIVE {_MAPPING} SELECT * FROM mapping")
def name_mapping(spark, sf):
    return _resolved(spark, sf)[2]


@query("name_frequency", f"WITH RECURSIVE {_MAPPING} SELECT c.doc_id, m.canonical AS name, count(*) AS freq FROM clustered c JOIN mapping m ON m.doc_id = c.doc_id AND m.key = lower(trim(c.name)) WHERE NOT c.is_existing GROUP BY 1, 2")
def name_frequency(spark, sf):
    clustered, _, mapping = _resolved(spark, sf)
    return resolve.name_frequency(clustered.where("not is_existing"), mapping)


_RELS = f"""{_MAPPING}, rel AS (SELECT a.doc_id, a.name AS f, b.name AS t, CASE a.ord % 4 WHEN 0 THEN 'utilizes' WHEN 1 THEN 'part of' WHEN 2 THEN 'requires' ELSE NULL END AS type FROM men a JOIN men b ON b.doc_id = a.doc_id AND b.ord = a.ord + 20),
mapped AS (SELECT rel.doc_id, coalesce(x.canonical, f) AS from_name, coalesce(y.canonical, t) AS to_name, CASE type WHEN 'utilizes' THEN 'USES' WHEN 'part of' THEN 'CONTAINS' WHEN 'requires' THEN 'PREREQUISITE_OF' ELSE 'RELATED_TO' END AS type
  FROM rel LEFT JOIN mapping x ON x.doc_id = rel.doc_id AND x.key = lower(trim(f)) LEFT JOIN mapping y ON y.doc_id = rel.doc_id AND y.key = lower(trim(t)))"""


@query("canonical_rels", f"WITH RECURSIVE {_RELS} SELECT DISTINCT doc_id, from_name, to_name, type FROM mapped WHERE lower(trim(from_name)) <> lower(trim(to_name))")
def canonical_rels(spark, sf):
    clustered, _, mapping = _resolved(spark, sf)
    m = _mentions(spark, sf).select("doc_id", "ord", "name")
    kind = F.when(F.col("ord") % 4 == 0, "utilizes").when(F.col("ord") % 4 == 1, "part of").when(F.col("ord") % 4 == 2, "requires")
    rels = m.withColumn("type", kind).join(m.select("doc_id", (F.col("ord") - 20).alias("ord"), F.col("name").alias("to_name")), ["doc_id", "ord"])
    return resolve.canonical_relations(rels.select("doc_id", F.col("name").alias("from_name"), "to_name", "type"), mapping)


@query(
    "rel_type_normalize",
    """WITH k AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'tested-on' WHEN 'click' THEN 'part of' WHEN 'error' THEN 'contradicts' WHEN 'purchase' THEN 'Requires' ELSE 'author_of' END AS kind FROM events)
    SELECT event_id, kind, CASE kind WHEN 'tested-on' THEN 'EVALUATED_ON' WHEN 'part of' THEN 'CONTAINS' WHEN 'contradicts' THEN 'RELATED_TO' WHEN 'Requires' THEN 'PREREQUISITE_OF' ELSE 'AUTHORED_BY' END AS type FROM k""",
)
def rel_type_normalize(spark, sf):
    e = F.col("event_type")
    kind = F.when(e == "view", "tested-on").when(e == "click", "part of").when(e == "error", "contradicts").when(e == "purchase", "Requires").otherwise("author_of")
    return table(spark, sf, "events").select("event_id", kind.alias("kind")).withColumn("type", names.relation_type(F.col("kind")))
