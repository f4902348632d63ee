"""Client operators."""

from pyspark.sql import functions as F

from weftgraph.operators import client, mutations


def test_valid_graph(spark):
    nodes = spark.createDataFrame([("a", "Concept", "", None, None, float("nan")), (" ", "Concept", "x", None, None, 1.0), ("b", None, "y", None, None, 1.0), ("c", "Topic", "z", "d", "Advanced", 2.0)], "id string, label string, name string, description string, difficulty_level string, x double")
    edges = spark.createDataFrame([("a", "c", None), ("a", "b", "USES")], "src string, dst string, type string")
    n, e = client.valid_graph(nodes, edges)
    assert sorted(map(tuple, n.collect())) == [("a", "Concept", "Unknown Node", "", "Beginner", None), ("c", "Topic", "z", "d", "Advanced", 2.0)]
    assert [tuple(r) for r in e.collect()] == [("a", "c", "RELATED_TO")]


def test_lists(spark):
    s = spark.createDataFrame([("a", "x", 1, 0), ("b", "y", 3, 1), ("a", "z", 9, 2)], "id string, name string, created_at long, ord int")
    newest = client.newest_sessions(s)
    assert [r["id"] for r in newest.collect()] == ["b", "a"]
    left, current = client.delete_session_entry(newest, "b", "b")
    assert [r["id"] for r in left.collect()] == ["a"] and current == "a"
    assert client.delete_session_entry(left, "a", "a")[1] == "a"
    old = spark.createDataFrame([(0, "p"), (1, "q")], "pos int, v string")
    new = spark.createDataFrame([(0, "n")], "pos int, v string")
    assert sorted(map(tuple, client.prepend(old, new).collect())) == [(0, "n"), (1, "p"), (2, "q")]
    paths = spark.createDataFrame([(["c", "zz", "a"],)], "path array<string>")
    assert [r["id"] for r in client.path_nodes(paths, s.select("id").distinct()).orderBy("pos").collect()] == ["a"]


def test_state_and_prompt(spark):
    up = spark.createDataFrame([("ok",), ("ok",)], "status string")
    assert tuple(client.services_ok(up).first()) == ("ok", 0)
    assert client.services_ok(up.unionByName(spark.createDataFrame([("down",)], "status string"))).first()["status"] == "degraded"
    none = F.array().cast("array<string>")
    got = spark.range(1).select(client.prompt_context(F.struct(F.lit("N").alias("name"), F.lit("D").alias("description"), F.lit("Beginner").alias("difficulty_level")), F.array(F.lit("P"), F.lit("Q")), none, none)).first()[0]
    assert got == "Focus Node: N\nDescription: D\nDifficulty: Beginner\nPrerequisites: P, Q\n"
    merged = spark.range(1).select(mutations.merge_settings(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2)))).first()[0]
    assert merged == {"a": 1, "b": 2}


def test_isolated_extraction(spark):
    chunks = spark.createDataFrame([("d", 0, "fine"), ("d", 1, "boom")], "doc_id string, chunk_no int, chunk string")

    def extract(text):
        if text == "boom":
            raise ValueError("bad chunk")
        return {"nodes": [{"label": "Odd", "name": "N", "description": ""}], "relationships": []}

    got = {r["chunk_no"]: r for r in client.isolated_extraction(chunks, extract).collect()}
    assert got[0]["error"] is None and got[0]["nodes"][0]["label"] == "Concept"
    assert got[1]["error"] == "ValueError: bad chunk" and got[1]["nodes"] == []


def test_waits_between_checks(spark):
    rows = [(1, "a", 1, False), (2, "a", 2, None), (3, "a", 3, False), (4, "a", 4, False), (5, "a", 5, True)]  # the whole first load fails
    rows += [(6, "b", 1, False), (7, "b", 2, True), (8, "b", 3, False), (9, None, 1, False), (10, None, 1, True)]
    checks = spark.createDataFrame(rows, "check_id int, service string, at int, ok boolean")
    got = {r["check_id"]: (r["state"], r["wait_ms"]) for r in client.check_waits(checks).collect()}
    assert got == {
        1: ("retrying", 1000), 2: ("retrying", 2000), 3: ("error", 15000), 4: ("error", 15000), 5: ("ok", 15000),
        6: ("retrying", 1000), 7: ("ok", 15000), 8: ("error", 15000), 9: ("retrying", 1000), 10: ("ok", 15000),
    }
    assert client.check_waits(checks.where("false")).count() == 0
