"""Leader clusters in rounds against the sequential rule, one name after another."""

import random

import pytest
from plain_names import Name
from pyspark.sql import functions as F

from weftgraph.operators import resolve


def sequential(rows):
    """{(scope, ord, is_existing, name): cluster}."""
    out = {}
    for scope in {r[0] for r in rows}:
        leaders, known = [], {}
        for _, ord_, _, name, _, existing in sorted((r for r in rows if r[0] == scope and r[3]), key=lambda r: (not r[5], r[1], r[3])):
            if name not in known:
                own = Name(name)
                at = next((i for i, x in enumerate(leaders) if own.like(x)), None)
                if at is None:
                    at = len(leaders)
                    leaders.append(own)
                known[name] = at
            out[scope, ord_, existing, name] = known[name]
    return out


COLUMNS = "doc_id string, ord int, label string, name string, description string, is_existing boolean"
WORDS = ["neural", "network", "networks", "deep", "learning", "graph", "theory", "of", "theories", "model", "modeling", "models", "analysis", "data"]


def check(spark, rows, scope="doc_id"):
    got = resolve.leader_clusters(spark.createDataFrame(rows, COLUMNS.replace("doc_id", scope)), scope)
    assert got.columns == [scope, "ord", "label", "name", "description", "is_existing", "cluster"]
    have = {(r[0], r["ord"], r["is_existing"], r["name"]): r["cluster"] for r in got.collect()}
    assert have == sequential(rows)


def test_random_names(spark):
    rnd = random.Random(4)
    rows = []
    for scope, n in (("a", 150), ("b", 60), (None, 40), ("one", 1)):
        for i in range(n):
            words = [rnd.choice(WORDS) for _ in range(rnd.randint(1, 4))]
            name = " ".join(words)
            name = rnd.choice([name, name, name.title(), "".join(w[0] for w in words).upper(), name + "s", name.replace(" ", "-", 1)])
            rows.append((scope, i, "Concept", name, "", rnd.random() < 0.2))
    rows += [("a", 900, "Concept", None, "", False), ("a", 901, "Concept", "", "", False), ("a", 902, "Topic", rows[0][3], "again", True)]
    check(spark, rows)


def test_chain_of_names_that_wait_for_one_another(spark):
    """Each name is similar to its neighbours only: every second one leads, one round after the other."""
    names = [f"{'x' * 3}{i} {'x' * 3}{i + 1} {'x' * 3}{i + 2} {'x' * 3}{i + 3}" for i in range(9)]
    rows = [("d", i, "Concept", n, "", False) for i, n in enumerate(names)]
    check(spark, rows, "scope_id")


def test_numbers_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(resolve, "_BLOCK", 7)
    check(spark, [("d", i * 3, "Concept", f"{chr(97 + i)}name{i}q", "", i % 5 == 0) for i in range(26)])


def test_edges(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert resolve.leader_clusters(empty).count() == 0
    check(spark, [("d", 1, "Concept", "...", "", False), ("d", 2, "Concept", "--", "", False), ("d", 2, "Concept", "alpha", "", False), ("d", 3, "Topic", " ", "", True)])


@pytest.mark.parametrize("scope", ["doc_id"])
def test_no_scope_is_one_group(spark, scope):
    rows = spark.createDataFrame([("d", 1, "Concept", "alpha", "", False)], COLUMNS)
    plan = resolve.leader_clusters(rows, scope)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Python" not in plan


def test_many_names_in_one_scope(spark):
    rows = spark.range(20_000).select(F.lit("s").alias("doc_id"), F.col("id").cast("int").alias("ord"), F.lit("Concept").alias("label"), F.concat(F.lit("term"), F.col("id"), F.lit(" of kind"), F.floor(F.col("id") / 2)).alias("name"), F.lit("").alias("description"), F.lit(False).alias("is_existing"))
    got = resolve.leader_clusters(rows)
    assert got.agg(F.countDistinct("cluster"), F.count("*")).first()[1] == 20_000
