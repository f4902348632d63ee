"""Learning sequences written out in text, with SQL: line items of an order as phases, numbered lists and arrow chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences
from ..storage import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: Items of each order; every seventh part is written as an instruction, which is no step of a sequence.
_ITEMS = """items AS (SELECT *, l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_name, l_partkey) - 1 AS line_no, l_linenumber || '.' || (l_partkey % 12) AS number,
  l_partkey % 7 <> 0 AS valid, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS name
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey))"""


def _item_lists(spark, sf):
    """``doc_id, s``: the different items of each order, in order. Rows are dealt out by order once, for this and for all that is made of a whole order."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "p_name", "l_partkey")
    got = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name", "l_partkey"))).alias("s"))
    return got.select("doc_id", F.filter("s", lambda x, i: (i == 0) | ~x.eqNullSafe(F.get("s", i - 1))).alias("s"))


def _said(item):
    return F.when(item["l_partkey"] % 7 == 0, F.concat(F.lit("run "), item["p_name"])).otherwise(item["p_name"])


def _number(item):
    return F.concat_ws(".", item["l_linenumber"], item["l_partkey"] % 12)


def _items(spark, sf):
    rows = _item_lists(spark, sf).select("doc_id", F.posexplode("s").alias("line_no", "x"))
    x = F.col("x")
    return rows.select("doc_id", "line_no", x["l_linenumber"].alias("l_linenumber"), _number(x).alias("number"), _said(x).alias("said"))


def _phase_line(number, said):
    kind = F.when(F.col("doc_id") % 3 == 0, "Step ").when(F.col("doc_id") % 3 == 1, "- Phase ").otherwise("## Section ")
    return F.concat(kind, number, F.lit(": "), said)


def _list_line(number, said):
    return F.concat(number, F.lit(". "), said)


def _phase_lines(items):
    return items.select("doc_id", "line_no", _phase_line(F.col("number"), F.col("said")).alias("line"))


def _list_lines(items):
    return items.select("doc_id", "line_no", _list_line(F.col("l_linenumber"), F.col("said")).alias("line"))


def _arrow_line():
    """The chain of an order's items ``s``."""
    parts = F.transform("s", _said)
    return F.when(F.col("doc_id") % 2 == 0, F.array_join(parts, " -> ")).otherwise(F.array_join(parts, " → "))


_PHASES = f"""{_ITEMS}, ph AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'Step' WHEN 1 THEN 'Phase' ELSE 'Section' END AS seq, count(*) OVER (PARTITION BY doc_id) AS c FROM items WHERE valid),
phases AS (SELECT doc_id, seq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY list_transform(string_split(number, '.'), lambda x: CAST(x AS DOUBLE)), line_no) AS INTEGER) AS pos, name, number FROM ph WHERE c >= 2)"""


@query("phase_sequence", f"WITH {_PHASES} SELECT * FROM phases")
def phase_sequence(spark, sf):
    return sequences.phases(_phase_lines(_items(spark, sf)))


_RUNS = """cuts AS (SELECT *, (l_linenumber = 1 OR l_linenumber IS DISTINCT FROM lag(l_linenumber) OVER w + 1)::INT AS cut FROM items WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
runs AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY line_no) AS seq FROM cuts), heads AS (SELECT *, first_value(l_linenumber) OVER w AS head, count(*) OVER (PARTITION BY doc_id, seq) AS n FROM runs WINDOW w AS (PARTITION BY doc_id, seq ORDER BY line_no)),
good_runs AS (SELECT *, count(*) OVER (PARTITION BY doc_id, seq) AS good FROM heads WHERE head = 1 AND n >= 2 AND valid),
numbered AS (SELECT doc_id, CAST(seq AS VARCHAR) AS seq, CAST(row_number() OVER (PARTITION BY doc_id, seq ORDER BY line_no) AS INTEGER) AS pos, name FROM good_runs WHERE good >= 2)"""


@query("numbered_runs", f"WITH {_ITEMS}, {_RUNS} SELECT * FROM numbered")
def numbered_runs(spark, sf):
    return sequences.numbered_runs(_list_lines(_items(spark, sf)))


_ARROWS = "ar AS (SELECT doc_id, CAST(line_no AS INTEGER) AS pos, name, count(*) OVER (PARTITION BY doc_id) AS c FROM items WHERE valid), arrows AS (SELECT doc_id, '0' AS seq, pos, name FROM ar WHERE c >= 2)"


@query("arrow_chain", f"WITH {_ITEMS}, {_ARROWS} SELECT * FROM arrows")
def arrow_chain(spark, sf):
    return sequences.arrow_chains(_item_lists(spark, sf).select("doc_id", F.lit(0).alias("line_no"), _arrow_line().alias("line")))


def _texts(spark, sf):
    """Every order as a text: its phases, its list, its chain."""
    lines = F.concat(F.transform("s", lambda x: _phase_line(_number(x), _said(x))), F.transform("s", lambda x: _list_line(x["l_linenumber"], _said(x))), F.array(_arrow_line()))
    return _item_lists(spark, sf).select("doc_id", F.array_join(lines, "\n").alias("text"))


_SEQUENCES = f"{_PHASES}, {_RUNS}, {_ARROWS}, steps AS (SELECT doc_id, 0 AS k, seq, pos, name, seq || ' ' || number || ' of the study sequence: ' || name || '.' AS about FROM phases UNION ALL SELECT doc_id, 1, seq, pos, name, 'Found in sequential list: ' || name || '.' FROM numbered UNION ALL SELECT doc_id, 2, seq, pos, name, 'Extracted from prerequisite sequence: ' || name || '.' FROM arrows)"


@query("learning_sequences", f"WITH {_SEQUENCES}, l AS (SELECT doc_id, name AS from_name, lead(name) OVER (PARTITION BY doc_id, k, seq ORDER BY pos) AS to_name FROM steps) SELECT DISTINCT doc_id, from_name, to_name, 'PREREQUISITE_OF' AS type FROM l WHERE to_name IS NOT NULL AND lower(from_name) <> lower(to_name)")
def learning_sequences(spark, sf):
    return sequences.parse_sequences(_texts(spark, sf))[1]


@query("learning_sequence_nodes", f"WITH {_SEQUENCES} SELECT doc_id, 'Concept' AS label, name, arg_min(about, k * 1000000 + pos) AS description FROM steps GROUP BY doc_id, name")
def learning_sequence_nodes(spark, sf):
    return sequences.parse_sequences(_texts(spark, sf))[0]
