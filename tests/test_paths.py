"""Longest chains and strong components against plain programs."""

import itertools
import random

import pytest

from weftgraph.operators import paths
from weftgraph.operators.graph import PropertyGraph
from weftgraph.sources.seed import seed_graph


def frame(spark, links):
    return spark.createDataFrame(links, "src string, dst string")


def reach(links, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in links:
            if a == todo[0] and b not in seen:
                seen.add(b)
                todo.append(b)
        todo.pop(0)
    return seen


def components(links):
    nodes = {x for a, b in links if a != b for x in (a, b)}
    to = {n: reach(links, n) | {n} for n in nodes}
    return {n: max(m for m in nodes if m in to[n] and n in to[m]) for n in nodes}


def chain(links, preceded, target, prefer_root):
    """The best chain to a node, by listing them all."""
    of = components(links)
    links = [(a, b) for a, b in set(links) if a != b and of[a] != of[b]]
    best = None
    todo = [(target,)]
    while todo:
        path = todo.pop()
        root = path[0] not in preceded
        key = (not (root and prefer_root and len(path) > 1), -len(path), path)
        if best is None or key < best[0]:
            best = (key, path, root)
        todo += [(a, *path) for a, b in links if b == path[0]]
    return best[1], len(best[1]) - 1, best[2]


GRAPHS = [(7, 9, 1), (9, 14, 2), (12, 16, 3)]


@pytest.mark.parametrize(("n", "m", "seed"), GRAPHS)
def test_strong_components(spark, n, m, seed):
    rnd = random.Random(seed)
    links = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)]
    got = {r["id"]: r["component"] for r in paths.strong_components(frame(spark, links)).collect()}
    assert got == components(links)


def test_nested_cycles_and_self_loops(spark):
    links = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f"), ("f", "f"), ("g", "a"), ("d", "c")]
    got = {r["id"]: r["component"] for r in paths.strong_components(frame(spark, links)).collect()}
    assert got == components(links) and got["c"] == "e" and got["a"] == "b" and got["f"] == "f"
    left = {tuple(r) for r in paths.ordered_links(frame(spark, links)).collect()}
    assert left == {("b", "c"), ("e", "f"), ("g", "a")}


@pytest.mark.parametrize(("n", "m", "seed", "prefer_root"), [(8, 14, 5, True), (11, 16, 7, False)])
def test_longest_chain(spark, n, m, seed, prefer_root):
    rnd = random.Random(seed)
    links = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)]
    links += [(f"n{min(a, b)}", f"n{max(a, b)}") for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(m))]
    target = f"n{n - 1}"
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(n)], "id string")
    edges = spark.createDataFrame([(a, b, "PREREQUISITE_OF") for a, b in links] + [("n0", target, "RELATED_TO")], "src string, dst string, type string")
    got = PropertyGraph(nodes, edges).longest_learning_path(target, prefer_root).collect()
    assert [(tuple(r["path"]), r["hops"], r["root"]) for r in got] == [chain_of(links, target, prefer_root)]


def chain_of(links, target, prefer_root):
    up = {target} | {a for a, _ in links if target in reach(links, a)}
    return chain([(a, b) for a, b in links if b in up], {b for _, b in links}, target, prefer_root)


def test_seed_has_a_chain_of_twelve_hops(spark):
    g = seed_graph(spark)
    row = g.longest_learning_path("c-transformers").first()
    assert row["hops"] == 12 and row["root"] and row["path"][-1] == "c-transformers"
    start = g.longest_learning_path("c-calculus").collect()
    assert [(r["path"], r["hops"], r["root"]) for r in start] == [(["c-calculus"], 0, True)]
    assert g.longest_learning_path("nobody").count() == 0


@pytest.mark.parametrize("left", [0, 1, 2, 3])
def test_representatives_stand_for_all(left):
    rnd = random.Random(left)
    for _ in range(30):
        k = rnd.randrange(1, 4)
        all_ = sorted({("s", *rnd.sample("abcdefg", k), "t") for _ in range(40)}, key=">".join)
        kept = paths.representatives([list(p) for p in all_], left)
        assert len(kept) <= sum(k**i for i in range(left + 1))
        for n in range(left + 1):
            for without in itertools.combinations("abcdefg", n):
                first = next((list(p) for p in all_ if not set(p) & set(without)), None)
                assert first is None or first == next(p for p in kept if not set(p) & set(without))


@pytest.mark.parametrize(("n", "m", "hops", "prefer_root", "seed"), [(7, 22, 4, True, 1), (7, 25, 6, False, 2), (9, 30, 5, True, 3), (9, 18, 5, True, 4)])
def test_learning_path_is_the_first_of_all_chains(spark, n, m, hops, prefer_root, seed):
    rnd = random.Random(seed)
    links = {(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)} | {("root", "n5")}
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(n)] + [("root",)], "id string")
    edges = spark.createDataFrame([(a, b, "PREREQUISITE_OF") for a, b in links], "src string, dst string, type string")
    preceded, todo, every = {b for _, b in links}, [("n0",)], []
    while todo:
        path = todo.pop()
        every.append(path)
        todo += [(a, *path) for a, b in links if b == path[0] and a not in path and len(path) <= hops]
    key = lambda p: (not (prefer_root and len(p) > 1 and p[0] not in preceded), -len(p), ">".join(p))
    best = min(every, key=key)
    row = PropertyGraph(nodes, edges).learning_path("n0", hops, prefer_root).first()
    assert (tuple(row["path"]), row["hops"], row["root"]) == (best, len(best) - 1, best[0] not in preceded)


def test_chains_of_a_complete_graph_are_not_listed(spark):
    n, hops = 60, 5  # some 700 million chains
    ids = [f"n{i:02d}" for i in range(n)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    edges = spark.createDataFrame([(a, b, "PREREQUISITE_OF") for a in ids for b in ids if a != b], "src string, dst string, type string")
    row = PropertyGraph(nodes, edges).learning_path(ids[-1], hops).first()
    assert row["path"] == [*ids[:hops], ids[-1]] and not row["root"]
    held = paths.simple_chains(edges, nodes.where(f"id = '{ids[-1]}'"), hops)
    assert held.count() <= n * (1 + 1 + 4 + 7 + 4 + 1)
    assert PropertyGraph(nodes, edges).learning_path("nobody").count() == 0


def test_values_spread_in_slices_as_along_single_links(spark, monkeypatch):
    rng = random.Random(5)
    links = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(40)] + [(f"c{i}", f"c{i + 1}") for i in range(6)]
    begin = {"n3": "é", "n4": "b", "c0": "z", "lone": "q"}
    want, more = dict(begin), True
    while more:
        more = False
        for a, b in links:
            if a in want and want[a] > want.get(b, ""):
                want[b], more = want[a], True
    a_b, start = spark.createDataFrame(links, "a string, b string").repartition(5), spark.createDataFrame([*begin.items(), ("n5", None)], "id string, c string")
    for size in (1 << 21, 20):
        monkeypatch.setattr(paths, "_SLICE", size)
        assert dict(map(tuple, paths.spread(a_b, start).collect())) == want


def test_upstream_of_a_long_chain_takes_no_round_for_each_step(spark, monkeypatch):
    stored, write = [], paths.materialise
    monkeypatch.setattr(paths, "materialise", lambda df, label, **kw: stored.append(label) or write(df, label, **kw))
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(60)] + [("n9", "off")], "src string, dst string")
    got = paths.upstream(chain, spark.createDataFrame([("n50",)], "id string"))
    assert got.count() == 50 and len(stored) < 8
