"""Findings of round 4: each of these failed before."""

import random
import re

import numpy as np
from pyspark.sql import functions as F
from weftgraph.functions import cleaning, squares
from weftgraph.operators import extract, resolve, sequences
from weftgraph.plans import ingest, sequence_queries, text_queries


def test_names_of_ingest_are_cleaned_once_each(spark):
    found = spark.createDataFrame([(d, 0, o, label, name, "x") for d in ("a", "b") for o, (label, name) in enumerate([("Concept", "the linear gears"), (None, None), ("Nonsense", "Gears")])], "doc_id string, chunk_no int, ord int, label string, name string, description string")
    got = ingest.scored_names(found)
    assert "Join" in got._jdf.queryExecution().analyzed().toString()
    want = [(0, "Concept", "Linear Gear", 1.0), (1, None, "", 0.0), (2, "Nonsense", "Gear", 0.0)]
    for d in "ab":
        assert [(r["ord"], r["label"], r["name"], r["quality"]) for r in got.where(F.col("doc_id") == d).orderBy("ord").collect()] == want
    rels = spark.createDataFrame([("a", "the gears", "gears", "USES"), ("a", None, "gears of", "USES")], "doc_id string, from_name string, to_name string, type string")
    assert sorted((r["from_name"], r["to_name"]) for r in ingest.tidy_relations(rels).collect()) == [("", "Gear"), ("Gear", "Gear")]


def test_only_names_that_stay_are_described(spark):
    text = " ".join(f"Gear{chr(97 + k)} Wheel is a round thing of iron." for k in range(20)) + " An older system model holds."
    pieces = spark.createDataFrame([("d", 0, text)], "doc_id string, chunk_no int, chunk string")
    got = extract.concepts(pieces)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract(") < plan.index("Window [")  # above the window that keeps the first of a chunk
    rows = got.orderBy("ord").collect()
    assert len(rows) == 15 and (rows[0]["name"], rows[0]["label"], rows[0]["description"]) == ("Geara Wheel", "Concept", "Round thing of iron")


def test_names_in_texts_that_are_not_ascii_take_no_pattern(monkeypatch):
    whole, rng = resolve._whole, random.Random(3)
    monkeypatch.setattr(resolve, "_whole", None)
    for _ in range(2000):
        name, text = "".join(rng.choice("abK s") for _ in range(rng.randint(1, 3))), "".join(rng.choice("aAbBkK sSéßΣK_1.") for _ in range(30))
        assert resolve.places_of(name, text, text.lower()) == [m.span() for m in whole(name).finditer(text)]
    monkeypatch.setattr(resolve, "_whole", whole)
    for text in ("aİ k", "iıi i", "sſ s"):
        assert all(resolve.places_of(n, text, text.lower()) == [m.span() for m in whole(n).finditer(text)] for n in "ais")


def test_descriptions_look_only_where_something_is_defined():
    rng = random.Random(5)
    words = ["gear", "Gear", "wheel", "is", "are", "refers", "to", "is defined as", "represents", "iron", "and", "turns.", "é", "denotes", "of", "slowly!", "why?"]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(120))
        low = text.lower()
        assert resolve.describe("gear", "", text, low, resolve.defining_places(text, low)) == resolve.describe("gear", "", text)
    assert resolve.defining_places("x is are y", "x is are y") == [1, 4]
    assert resolve.defining_places("İ is", "İ is".lower()) is None


def test_lines_without_a_repeated_phrase_are_sifted(monkeypatch):
    numbers = np.arange(5000, dtype=np.int64)
    monkeypatch.setattr(squares, "_long_phrase", None)
    assert squares.with_repeated_phrase(numbers, np.array([0, 2500, 5000])).tolist() == [False, False]
    assert squares.with_repeated_phrase(np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 1, 2]), np.array([0, 10, 12])).tolist() == [True, False]


def test_long_phrases_that_follow_themselves():
    rng = np.random.default_rng(2)
    for k in range(300):
        sizes = rng.integers(0, 50, size=6)
        off = np.concatenate([[0], np.cumsum(sizes)])
        numbers = rng.integers(0, 3 + k % 30, size=off[-1])
        p = int(rng.integers(6, 20))
        if k % 2 and sizes[3] >= 2 * p:
            numbers[off[3] + p : off[3] + 2 * p] = numbers[off[3] : off[3] + p]
        want = [squares.repeats_itself(numbers[a:b].tolist()) for a, b in zip(off, off[1:], strict=False)]
        assert squares.with_repeated_phrase(numbers, off).tolist() == want


def test_hyphens_edges_and_words_of_lines(spark):
    odd = ["a-\nb-\nc", "a-\nbb-\nc d", "é-\n\n b", "x - \ny", "no", None, "_a1-\n2b", "a--\nb"]
    frame = spark.createDataFrame([(x,) for x in odd], "t string").select("t", cleaning.join_hyphens(F.col("t")).alias("got"))
    want = lambda t: t and re.sub(r"([^\W]+)-\s*\n+\s*([^\W]+)", r"\1\2", t)
    assert all(r["got"] == want(r["t"]) for r in frame.collect())
    edges = [" a b　", "\x85x ", " \t", "\x1cq\x1f", "\xa0é  y "]
    pages = spark.createDataFrame([(1, 0, "\n".join(edges))], "doc_id long, page_no int, text string")
    assert cleaning.page_lines(pages).first()["lines"] == ["a b", "x", "", "\x1cq\x1f", "é  y"]
    lines = spark.createDataFrame([("Ab-1 é_٣", ), ("A.b  C_1!",)], "l string")
    assert [tuple(r) for r in lines.select(cleaning.words_of(F.col("l")), cleaning.template(F.col("l"))).collect()] == [("ab 1 é_٣", "abé_"), ("a b c_1", "abc_")]


def test_sequences_are_dealt_out_by_document_once(spark, sf, monkeypatch):
    stored, write = [], sequences.materialise
    monkeypatch.setattr(sequences, "materialise", lambda df, label, **kw: stored.append(label) or write(df, label, **kw))
    nodes, rels = sequences.parse_sequences(sequence_queries._texts(spark, sf))
    assert stored == ["steps", "names", "judged"]
    for got in (nodes, rels):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan
    plan = sequence_queries._texts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "Window" not in plan


def test_sequences_of_odd_lines(spark):
    lines = ["1. linear gears", "2. iron wheels", "99999999999999999999. too many digits", "- a bullet", "3. brass levers", "1. copper wires", "2. go home", "3. steel springs", "Phase 2.10: late gears", "Phase 2.9: early\x01gears", "a \u2192 red wheels -> blue wheels"]
    docs = spark.createDataFrame([("d", "\n".join(lines)), ("e", None), ("f", "")], "doc_id string, text string")
    nodes, rels = sequences.parse_sequences(docs)
    assert {(r["from_name"], r["to_name"]) for r in rels.collect()} == {("Linear Gear", "Iron Wheel"), ("Copper Wir", "Steel Spring"), ("Early\x01gear", "Late Gear"), ("Red Wheel", "Blue Wheel")}
    assert {r["name"] for r in nodes.where("doc_id = 'd'").collect()} == {"Linear Gear", "Iron Wheel", "Copper Wir", "Steel Spring", "Early\x01gear", "Late Gear", "Red Wheel", "Blue Wheel"}


def test_texts_of_a_session_view_are_made_once(spark, sf, monkeypatch):
    stored, write = [], text_queries.materialise
    monkeypatch.setattr(text_queries, "materialise", lambda df, label, **kw: stored.append(label) or write(df, label, **kw))
    got = text_queries.session_view(spark, sf)
    assert stored == ["said"]
    # line items reach the view by the stored graph and the stored texts only
    assert "l_linenumber" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_the_text_of_an_order_is_that_of_its_first_item(spark, tmp_path):
    made = {
        "orders": ([(1, 1), (2, 1), (6, 1), (8, 9), (9, 1)], "o_orderkey long, o_custkey long"), "customer": ([(1, 7)], "c_custkey long, c_nationkey int"),
        "lineitem": ([(1, 2, 1), (1, 1, 3), (1, 1, 2), (2, 1, 4), (6, 1, 1), (8, 1, 1), (9, 1, 5)], "l_orderkey long, l_linenumber int, l_partkey long"),
        "part": ([(1, "red"), (2, "blue"), (3, "green"), (4, None)], "p_partkey long, p_name string"),
    }
    for name, (rows, kind) in made.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = text_queries._said(spark, str(tmp_path)).orderBy("o_orderkey").collect()
    assert [tuple(r) for r in got] == [(1, "7", "On blue by a transformer gradient"), (2, "7", None)]
