"""Client-side queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import title_case
from ..functions.text import ellipsis, iso, iso_now, main_topic, node_radius, repair_json, topic_description, url_name
from ..operators import client
from ..operators.mutations import merge_settings
from ..sources.derived import GRAPH_SQL
from ..sources.derived import stored_graph as derived_graph
from ..storage import table
from .graph_queries import _BEST_ROOT, _CTX, _TGT, SESSION, _learn, _paths_sql, busiest, node_with_context

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "graph_validation",
    f"""WITH {GRAPH_SQL}, v AS (SELECT id FROM nodes WHERE label <> 'Document'), e AS (SELECT src, dst, CASE WHEN type = 'EXTENDS' THEN 'RELATED_TO' ELSE type END AS type FROM edges)
    SELECT src, dst, type FROM e WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)""",
)
def graph_validation(spark, sf):
    g = derived_graph(spark, sf)
    nodes = g.nodes.withColumn("label", F.when(F.col("label") == "Document", " ").otherwise(F.col("label")))
    edges = g.edges.withColumn("type", F.when(F.col("type") == "EXTENDS", "").otherwise(F.col("type")))
    return client.valid_graph(nodes, edges)[1].select("src", "dst", "type")


@query("label_group_nodes", f"WITH {GRAPH_SQL} SELECT id FROM nodes WHERE label IN ('Paper', 'Author')")
def label_group_nodes(spark, sf):
    return client.label_group(derived_graph(spark, sf).nodes, "Paper").select("id")


@query("keyword_count", f"WITH {GRAPH_SQL} SELECT sum((label = 'Keyword')::INT)::BIGINT AS n FROM nodes")
def keyword_count(spark, sf):
    return derived_graph(spark, sf).nodes.agg(F.count_if(F.col("label") == "Keyword").alias("n"))


@query("around_one_hop", f"WITH {GRAPH_SQL}, {_TGT} SELECT DISTINCT src, dst, type FROM edges, tgt WHERE type = 'PREREQUISITE_OF' AND (src = tgt.id OR dst = tgt.id)")
def around_one_hop(spark, sf):
    g = derived_graph(spark, sf)
    return client.around(g, busiest(g))


@query("selectable_texts", "SELECT doc_id FROM documents WHERE length(trim(text)) > 200")
def selectable_texts(spark, sf):
    return client.selectable(table(spark, sf, "documents"), least=200).select("doc_id")


_SESSIONS = "ss AS (SELECT CAST(user_id AS VARCHAR) AS id, 'User ' || user_id AS name, epoch_us(ts) // 1000 AS created_at, event_id AS ord FROM events)"


def _sessions(spark, sf):
    """A session entry for each event, most of them repeats."""
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), F.concat(F.lit("User "), "user_id").alias("name"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"), F.col("event_id").cast("long").alias("ord"))


@query("newest_sessions", f"WITH {_SESSIONS} SELECT id, name, created_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM ss) WHERE rn = 1")
def newest_sessions(spark, sf):
    return client.newest_sessions(_sessions(spark, sf)).select("id", "name", "created_at")


@query("create_session", f"WITH {_SESSIONS}, al AS (SELECT * FROM ss UNION ALL SELECT 'fresh', 'Untitled Session', 99, (SELECT max(ord) + 1 FROM ss) UNION ALL SELECT (SELECT min(id) FROM ss), 'taken', 1, (SELECT max(ord) + 2 FROM ss)) SELECT id, name, created_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM al) WHERE rn = 1")
def create_session(spark, sf):
    """A new session without a name, then one whose id is taken: that changes nothing."""
    s = _sessions(spark, sf)
    taken = s.agg(F.min("id")).first()[0]
    s = client.create_session_entry(s, "fresh", None, 99)
    return client.create_session_entry(s, taken, "taken", 1).select("id", "name", "created_at")


@query("delete_session_entry", f"WITH {_SESSIONS}, f AS (SELECT id, name, created_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM ss) WHERE rn = 1), g AS (SELECT id FROM f ORDER BY created_at DESC, id LIMIT 1), l AS (SELECT * FROM f WHERE id <> (SELECT id FROM g)) SELECT id, id = (SELECT id FROM l ORDER BY created_at DESC, id LIMIT 1) AS is_current FROM l")
def delete_session_entry(spark, sf):
    """The newest session, which is the current one, goes; the newest of the others takes its place."""
    s = client.newest_sessions(_sessions(spark, sf))
    newest = s.orderBy(F.desc("created_at"), "id").first()["id"]
    left, current = client.delete_session_entry(s, newest, newest)
    return left.select("id", (F.col("id") == current).alias("is_current"))


@query("name_sessions", "WITH d AS (SELECT CAST(o_custkey AS VARCHAR) AS id, arg_min('Order ' || o_orderkey, o_orderkey) AS title FROM orders GROUP BY 1) SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(title, c_name) AS name FROM customer LEFT JOIN d ON d.id = CAST(c_custkey AS VARCHAR)")
def name_sessions(spark, sf):
    sessions = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    docs = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("session_id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.col("o_orderkey").alias("ord"))
    return client.name_sessions(sessions, docs)


_LIST = "li AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, 'processing' AS status, 10 AS progress_pct FROM orders)"


def _documents(spark, sf):
    docs = client.in_order(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return docs.select(F.col("o_orderkey").cast("string").alias("id"), "pos", F.lit("processing").alias("status"), F.lit(10).alias("progress_pct"))


@query("list_operations", f"WITH {_LIST} SELECT id, pos, status, progress_pct FROM (SELECT 'new' AS id, 0 AS pos, 'processing' AS status, 10 AS progress_pct UNION ALL SELECT id, pos + 1, CASE WHEN pos % 2 = 0 THEN 'done' ELSE status END, CASE WHEN pos % 2 = 0 THEN 100 ELSE progress_pct END FROM li) WHERE id <> (SELECT min(id) FROM li)")
def list_operations(spark, sf):
    """A document before all others, every second old one done, one removed."""
    docs = _documents(spark, sf)
    new = spark.createDataFrame([("new", 0, "processing", 10)], "id string, pos long, status string, progress_pct int")
    rows = client.set_status(docs, docs.where("pos % 2 = 0").select("id", F.lit("done").alias("status"), F.lit(100).alias("progress_pct")))
    return client.remove(client.prepend(rows, new), docs.agg(F.min("id").alias("id")))


@query(
    "retry_schedule",
    """WITH c AS (SELECT event_id, user_id, event_type <> 'error' AS ok, row_number() OVER w AS n, coalesce(bool_or(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, CASE WHEN ok THEN 'ok' WHEN NOT before AND n < 3 THEN 'retrying' ELSE 'error' END AS state, CASE WHEN NOT ok AND NOT before AND n < 3 THEN n * 1000 ELSE 15000 END::BIGINT AS wait_ms FROM c""",
)
def retry_schedule(spark, sf):
    """Each event is a check of the service of its user's number; errors have failed."""
    checks = table(spark, sf, "events").select(F.col("event_id").alias("check_id"), F.col("user_id").alias("service"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return client.check_waits(checks).select(F.col("check_id").alias("event_id"), "state", "wait_ms")


@query("services_ok", "SELECT CASE WHEN bool_or(event_type = 'error') THEN 'degraded' ELSE 'ok' END AS status, sum((event_type = 'error')::INT)::BIGINT AS failing FROM events")
def services_ok(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_type") == "error", "down").otherwise("ok").alias("status"))
    return client.services_ok(e)


@query("node_radius", f"WITH {GRAPH_SQL}, d AS (SELECT n.id, (SELECT count(*) FROM edges e WHERE e.src = n.id) + (SELECT count(*) FROM edges e WHERE e.dst = n.id) AS k FROM nodes n WHERE session_id = '{SESSION}') SELECT id, round(3 + sqrt(k) * 1.5, 6) AS radius FROM d")
def radius(spark, sf):
    g = derived_graph(spark, sf)
    own = g.nodes.where(F.col("session_id") == SESSION).select("id")
    return g.degrees().join(own, "id", "left_semi").select("id", F.round(node_radius(F.col("degree")), 6).alias("radius"))


@query("url_names", "SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] AS name FROM pages")
def url_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", url_name(F.col("url")).alias("name"))


_TOPIC = """t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'On ATTENTION. ' WHEN 1 THEN 'A zkp. ' ELSE '' END || text AS text, CASE doc_id % 7 WHEN 0 THEN 'online-voting_rules.v2.pdf' WHEN 1 THEN '.pdf' ELSE source || '_notes.pdf' END AS f FROM documents),
  k AS (SELECT doc_id, f, CASE WHEN regexp_matches(lower(substr(text, 1, 15000)), 'attention|transformer') THEN 1 WHEN regexp_matches(lower(substr(text, 1, 15000)), 'voting|blockchain|zkp') OR contains(f, 'voting') THEN 2 WHEN f = '.pdf' THEN 3 ELSE 4 END AS k FROM t)"""


def _named(spark, sf):
    k = F.col("doc_id")
    said = F.concat(F.when(k % 4 == 0, "On ATTENTION. ").when(k % 4 == 1, "A zkp. ").otherwise(""), "text")
    file = F.when(k % 7 == 0, "online-voting_rules.v2.pdf").when(k % 7 == 1, ".pdf").otherwise(F.concat("source", F.lit("_notes.pdf")))
    return table(spark, sf, "documents").select("doc_id", said.alias("text"), file.alias("file"))


@query("main_topics", f"WITH {_TOPIC} SELECT doc_id, CASE k WHEN 1 THEN 'Transformer Architecture' WHEN 2 THEN 'Secure Online Voting System' WHEN 3 THEN 'Document Analysis' ELSE upper(left(f, 1)) || substr(f, 2, length(f) - 11) || ' Notes' END AS topic, CASE k WHEN 1 THEN 'A novel ' WHEN 2 THEN 'A secure' ELSE 'Unified ' END AS about, CASE WHEN k > 2 THEN f END AS file FROM k")
def main_topics(spark, sf):
    d = _named(spark, sf)
    about = topic_description(F.col("text"), F.col("file"))
    told = F.when(about.startswith("Unified "), F.regexp_extract(about, "of the document (.*)\\.$", 1))
    return d.select("doc_id", main_topic(F.col("text"), F.col("file")).alias("topic"), F.substring(about, 1, 8).alias("about"), told.alias("file"))


@query("clock", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at, true AS now_is_later FROM events")
def clock(spark, sf):
    """Times of events as the service writes them; as text they compare with the clock's as times do."""
    at = iso(F.col("ts"))
    return table(spark, sf, "events").select("event_id", at.alias("at"), (iso_now() > at).alias("now_is_later"))


@query("json_of_models", "SELECT conv_id, turn, role = 'assistant' AS readable, CASE WHEN role = 'assistant' THEN text END AS name, CASE WHEN role = 'assistant' THEN 1 END AS n_rels FROM conversations")
def json_of_models(spark, sf):
    """What a model says, as JSON within a code fence, read back; other roles say no JSON."""
    rows = table(spark, sf, "conversations")
    node = F.struct(F.lit("Concept").alias("label"), F.col("text").alias("name"), F.lit("").alias("description"))
    rel = F.struct(F.lit("a").alias("from"), F.lit("b").alias("to"), F.lit("USES").alias("type"))
    made = F.to_json(F.struct(F.array(node).alias("nodes"), F.array(rel).alias("relationships")))
    raw = F.when(F.col("role") == "assistant", F.concat(F.lit("```json\n"), made, F.lit("\n```"))).otherwise(F.col("text"))
    got = rows.select("conv_id", "turn", repair_json(raw).alias("got"))
    size = F.when(F.col("got").isNotNull(), F.size("got.relationships"))
    return got.select("conv_id", "turn", F.col("got").isNotNull().alias("readable"), F.get(F.col("got.nodes"), F.lit(0))["name"].alias("name"), size.alias("n_rels"))


@query(
    "prompt_context",
    f"""WITH {GRAPH_SQL}{_CTX}, l AS (SELECT string_agg(name, ', ' ORDER BY rank) FILTER (WHERE bucket = 'prerequisites') AS pre, string_agg(name, ', ' ORDER BY rank) FILTER (WHERE bucket = 'related') AS rel, string_agg(name, ', ' ORDER BY rank) FILTER (WHERE bucket = 'papers') AS pap FROM r WHERE rank <= 10)
    SELECT 1 AS k, 'Focus Node: ' || name || chr(10) || 'Description: ' || coalesce(description, '') || chr(10) || 'Difficulty: ' || difficulty_level || chr(10) || coalesce('Prerequisites: ' || pre || chr(10), '') || coalesce('Related concepts: ' || rel || chr(10), '') || coalesce('Grounding Papers: ' || pap || chr(10), '') AS context FROM nodes JOIN tgt USING (id), l
    UNION ALL SELECT 2, 'No focus node currently selected.'""",
)
def prompt_context(spark, sf):
    g = derived_graph(spark, sf)
    node = node_with_context(g, busiest(g))
    names = [F.col(c) for c in ("prerequisites", "related", "papers")]
    told = node.select(F.lit(1).alias("k"), client.prompt_context(F.col("node"), *names).alias("context"))
    none = node.select(F.lit(2).alias("k"), client.prompt_context(F.when(F.col("node.name").isNull(), F.col("node")), *names).alias("context"))
    return told.unionByName(none)


@query("path_nodes", f"WITH RECURSIVE {GRAPH_SQL}{_paths_sql(5)}, {_BEST_ROOT} SELECT i - 1 AS pos, id, name FROM (SELECT path[i] AS id, i FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM best)) JOIN nodes USING (id)")
def path_nodes(spark, sf):
    """The nodes of a path, one of whose ids is nowhere."""
    g, best = _learn(spark, sf)
    missing = best.select(F.concat("path", F.array(F.lit("nowhere"))).alias("path"))
    return client.path_nodes(missing, g.nodes).select(F.col("pos").cast("long").alias("pos"), "id", "name")


@query("settings_merge", "SELECT o_orderkey, 'high' AS a, o_orderstatus AS b, CASE WHEN o_orderkey % 2 = 0 THEN 'x' END AS c FROM orders")
def settings_merge(spark, sf):
    """A stored record with some of its entries replaced and one added."""
    old = F.create_map(F.lit("a"), F.lit("low"), F.lit("b"), F.col("o_orderstatus"))
    new = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("high"), F.lit("c"), F.lit("x"))).otherwise(F.create_map(F.lit("a"), F.lit("high")))
    rows = table(spark, sf, "orders").select("o_orderkey", merge_settings(old, new).alias("m"))
    return rows.select("o_orderkey", *[F.col("m")[k].alias(k) for k in "abc"])


@query("label_truncation", "SELECT doc_id, CASE WHEN length(text) > 18 THEN left(text, 15) || '...' ELSE text END AS label FROM documents")
def label_truncation(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ellipsis(F.col("text"), 18).alias("label"))


@query("title_case", "SELECT p_partkey, upper(left(p_name, 1)) || substr(string_split(p_name, ' ')[1], 2) || chr(39) || upper(left(string_split(p_name, ' ')[2], 1)) || substr(string_split(p_name, ' ')[2], 2) || '2' || upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS title FROM part")
def title_cases(spark, sf):
    words = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", title_case(F.concat(words[0], F.lit("'"), words[1], F.lit("2"), "p_type")).alias("title"))
