"""Learning sequences written out in text: numbered phases, numbered lists and arrow chains.

Lines are rows ``doc_id, line_no, line``; every parser gives ``doc_id, seq, pos, name`` and ``links`` turns them into prerequisites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import normalize_name, valid_concept
from ..storage import materialise
from .resolve import first_wins


def text_lines(docs: DataFrame) -> DataFrame:
    # before a plain explode the optimiser asks for the array's size, below the projection, and makes it twice
    return docs.select("doc_id", F.split("text", "\n").alias("raw")).select("doc_id", F.posexplode_outer("raw").alias("line_no", "raw")).where("raw is not null").select("doc_id", "line_no", F.trim("raw").alias("line"))


#: The kinds of sequences, in order of their weight.
PHASE, RUN, ARROW = 0, 1, 2
_STEP = "array<struct<k:int,seq:string,number:string,num:bigint,sub:int,raw:string>>"


def _step(k: int, raw: Column, seq=None, number=None, num=None, sub=None) -> Column:
    kinds = {"seq": (seq, "string"), "number": (number, "string"), "num": (num, "bigint"), "sub": (sub, "int")}
    return F.struct(F.lit(k).alias("k"), *[(F.lit(None) if c is None else c).cast(kind).alias(name) for name, (c, kind) in kinds.items()], raw.alias("raw"))


def _parts(line: Column, pattern: str, n: int) -> Column:
    """The groups of a pattern that begins with the line, where it is found: taken from one match, parted by a sign."""
    marked = F.regexp_replace(line, f"(?s){pattern}.*$", "\x01".join(f"${k + 1}" for k in range(n)))
    return F.when(line.rlike(pattern), F.split(marked, "\x01", n))


_PHASE_LINE = "(?i)^\\s*(?:#+\\s+|-\\s+|\\*\\s+|\\d+\\.\\s+)?\\b(Phase|Step|Section)\\s+(\\d+(?:\\.\\d+)*)\\s*[:.-]?\\s*([^\\n.!?]{2,60})"
_RUN_LINE = "^\\s*(?:#+\\s+)?(\\d+)\\.\\s*([^\\n.!?]{2,60})"


def _phase(line: Column, m: Column) -> Column:
    return F.when(m.isNotNull(), F.array(_step(PHASE, F.trim(m[2]), seq=F.initcap(m[0]), number=m[1])))


def _run(line: Column, m: Column) -> Column:
    # digits too many for a whole number are none, and a line that is no bullet either is prose
    number = F.when(m[0].try_cast("long").isNotNull(), F.array(_step(RUN, F.trim(m[1]), num=m[0].try_cast("long"))))
    return F.coalesce(number, F.when(line.startswith("- ") | line.startswith("* "), F.array(_step(RUN, F.lit("")))))


def _arrow(line: Column, m: Column) -> Column:
    return F.when(m.isNotNull(), F.transform(m, lambda x, i: _step(ARROW, x, sub=i)))


#: Of each kind: the parts of a line, and the steps that are made of them.
_KINDS = {
    PHASE: (lambda line: _parts(line, _PHASE_LINE, 3), _phase),
    RUN: (lambda line: _parts(line, _RUN_LINE, 2), _run),
    ARROW: (lambda line: F.when(F.contains(line, F.lit("->")) | F.contains(line, F.lit("→")), F.split(line, "->|→")), _arrow),
}


def steps_of(lines: DataFrame, *kinds: int) -> DataFrame:
    """``doc_id, k, seq, pos, name, number, to_name`` of the sequences of two steps or more: the step after each is ``to_name``.

    Lines are looked at once for all kinds, each different name is cleaned and judged once, and all that follows goes by documents: rows are dealt out by them once.
    """
    none = F.array().cast(_STEP)
    line = F.col("line")
    parts = lines.select("doc_id", "line_no", "line", *[_KINDS[k][0](line).alias(f"m{k}") for k in kinds])
    # an array is a column before it is exploded: a generator evaluates an expression without compiling it
    # (and outer, as in ``text_lines``)
    found = parts.select("doc_id", "line_no", F.concat(*[F.coalesce(_KINDS[k][1](line, F.col(f"m{k}")), none) for k in kinds]).alias("s"))
    rows = materialise(found.select("doc_id", "line_no", F.explode_outer("s").alias("s")).where("s is not null").select("doc_id", "line_no", "s.*"), "steps")
    # different names are written first: else the optimiser judges each row before it looks for what is different
    judged = materialise(rows.select("raw").distinct(), "names", light=True).withColumn("name", normalize_name(F.col("raw"))).where(valid_concept(F.col("name")))
    rows = rows.join(materialise(judged, "judged", light=True), "raw", "left").where(f"name is not null or k = {RUN}").drop("raw").repartition("doc_id")

    w = Window.partitionBy("doc_id", "k").orderBy("line_no", "sub")
    cut = F.col("num").isNull() | (F.col("num") == 1) | F.coalesce(F.col("num") != F.lag("num").over(w) + 1, F.lit(True))
    rows = rows.withColumn("seq", F.when(F.col("k") == RUN, F.sum(cut.cast("int")).over(w).cast("string")).when(F.col("k") == ARROW, F.col("line_no").cast("string")).otherwise(F.col("seq")))
    rows = rows.withColumn("place", F.transform(F.split("number", "\\."), lambda x: x.cast("double")))
    w = Window.partitionBy("doc_id", "k", "seq").orderBy("place", "line_no", "sub")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("first", F.first("num").over(whole)).where(f"name is not null and (k != {RUN} or first = 1)")
    rows = rows.withColumn("n", F.count("*").over(whole)).withColumn("at", F.row_number().over(w)).withColumn("to_name", F.lead("name").over(w)).where("n >= 2")
    return rows.select("doc_id", "k", "seq", F.when(F.col("k") == ARROW, F.col("sub")).otherwise(F.col("at")).alias("pos"), "name", "number", "to_name")


def phases(lines: DataFrame) -> DataFrame:
    """``Phase 2.1: name`` lines, ordered by their dotted numbers within each kind."""
    return steps_of(lines, PHASE).select("doc_id", "seq", "pos", "name", "number")


def numbered_runs(lines: DataFrame) -> DataFrame:
    """Runs of ``1. 2. 3.`` lines: a 1, a gap or a bullet ends a run, prose does not; after a gap nothing counts until the next 1."""
    return steps_of(lines, RUN).select("doc_id", "seq", "pos", "name")


def arrow_chains(lines: DataFrame) -> DataFrame:
    """``A -> B -> C`` lines."""
    return steps_of(lines, ARROW).select("doc_id", "seq", "pos", "name")


def parse_sequences(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, label, name, description``, ``doc_id, from_name, to_name, type``) of all three kinds.

    Relations are those of consecutive steps, the first of each pair (regardless of case), no self-loops.
    """
    steps = steps_of(text_lines(docs), PHASE, RUN, ARROW)
    about = (
        F.when(F.col("k") == PHASE, F.concat("seq", F.lit(" "), "number", F.lit(" of the study sequence: "), "name", F.lit(".")))
        .when(F.col("k") == RUN, F.concat(F.lit("Found in sequential list: "), "name", F.lit(".")))
        .otherwise(F.concat(F.lit("Extracted from prerequisite sequence: "), "name", F.lit(".")))
    )
    nodes = first_wins(steps.select("doc_id", "k", "seq", "pos", F.lit("Concept").alias("label"), "name", about.alias("description")), ["doc_id", F.lower("name")], ["k", "seq", "pos"])
    rels = steps.where("to_name is not null and lower(name) != lower(to_name)")
    rels = rels.select("doc_id", "k", "seq", "pos", F.col("name").alias("from_name"), "to_name", F.lit("PREREQUISITE_OF").alias("type"))
    rels = first_wins(rels, ["doc_id", F.lower("from_name"), F.lower("to_name")], ["k", "seq", "pos"])
    return nodes.drop("k", "seq", "pos"), rels.drop("k", "seq", "pos")
