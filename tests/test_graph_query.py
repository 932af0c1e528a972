"""Graph queries against a plain breadth-first search."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import graph as gr
from tarnfold.operators.graph_query import GraphQuery, split_hubs

RNG = random.Random(3)
V = [(f"v{i}", "ab"[i % 2], f"Name {i}", (i % 10) / 10, {"colour": "red" if i % 3 else "blue"}) for i in range(60)]
E = [("v0", f"v{i}", "LIKES", i / 60) for i in range(1, 60)]  # a hub
E += [(f"v{RNG.randrange(60)}", f"v{RNG.randrange(60)}", RNG.choice(["LIKES", "KNOWS"]), RNG.randrange(1, 9) / 8) for _ in range(120)]
E += [("v7", "v7", "LIKES", 1.0), ("v1", "nowhere", "LIKES", 1.0), ("v3", "v4", "LIKES", 0.1), ("v3", "v4", "LIKES", 0.9)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(V, "id string, type string, name string, importance double, properties map<string,string>"), spark.createDataFrame(E, "src string, dst string, type string, weight double")


def plain(starts, fit, types, depth, direction):
    node = {v[0]: v for v in V if fit(v)}
    out = {}
    for s in (v for v in node if starts(node[v])):
        seen, level = {s}, {s: [s]}
        for d in range(1, depth + 1):
            best = defaultdict(list)
            for a, b, t, w in E:
                if types and t not in types:
                    continue
                for x, y in [(a, b)] * (direction != "in") + [(b, a)] * (direction != "out"):
                    if x in level and y in node and y not in seen:
                        best[y].append((-w, level[x] + [y]))
            level = {y: min(ways)[1] for y, ways in best.items()}
            for y, ways in best.items():
                out[s, y] = (d, node[y][3] * -min(ways)[0] / d, min(ways)[1])
            seen |= set(level)
    return out


@pytest.mark.parametrize("part", [None, 5])
@pytest.mark.parametrize("direction,depth", [("out", 2), ("in", 3), ("both", 2)])
def test_traversal(spark, tables, part, direction, depth):
    q = GraphQuery().start_type("a").where(F.col("importance") >= 0.2).traverse("LIKES", depth=depth, direction=direction).with_paths()
    got = {(r["start"], r["id"]): (r["depth"], r["score"], r["path"]) for r in q.matches(*tables, part).collect()}
    want = plain(lambda v: v[1] == "a", lambda v: v[3] >= 0.2, ("LIKES",), depth, direction)
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) and got[k][2] == want[k][2] for k in want)
    once = {r["id"]: r["start"] for r in q.distinct().matches(*tables, part).collect()}
    assert once == {i: min(s for s, j in want if j == i) for _, i in want}


def test_hubs_are_dealt_out(spark, tables):
    step, hubs = split_hubs(tables[1].select("src", "dst"), 5)
    assert {r["src"]: r["parts"] for r in hubs.collect()}["v0"] >= 12
    assert step.where("src = 'v0'").groupBy("part").count().agg(F.max("count")).first()[0] < 20
    assert split_hubs(tables[1].select("src", "dst"))[1] is None


def test_strings(spark, tables):
    v, e = tables
    page = GraphQuery.parse("from:v0 traverse:LIKES depth:1 importance:>0.5 colour:red limit:3").sort("score", True).run(v, e).collect()
    want = sorted(((-s, i) for (_, i), (_, s, _) in plain(lambda x: x[0] == "v0", lambda x: (x[3] >= 0.5 and x[4]["colour"] == "red"), ("LIKES",), 1, "out").items()))
    assert page == [] and want == []  # v0 itself has importance 0: a start is filtered too
    page = GraphQuery.parse("from:v1 traverse:LIKES,KNOWS depth:3 importance:<0.8 limit:3").sort("score", True).page(3, 2).run(v, e).collect()
    want = sorted(((-s, i) for (_, i), (_, s, _) in plain(lambda x: x[0] == "v1", lambda x: x[3] <= 0.8, ("LIKES", "KNOWS"), 3, "out").items()))
    assert [r["id"] for r in page] == [i for _, i in want[2:5]] and {r["total"] for r in page} == {len(want)} and {r["truncated"] for r in page} == {len(want) > 5}
    assert {r["id"] for r in GraphQuery.parse("type:a colour:blue NAME 1").matches(v, e).collect()} == {x[0] for x in V if x[1] == "a" and x[4]["colour"] == "blue" and "name 1" in x[2].lower()}
    assert GraphQuery.parse("nosuch:thing").matches(v.drop("properties"), e).count() == 0
    assert GraphQuery.parse("").matches(v, e).count() == 60 and GraphQuery().start_name("name 5").matches(v, e).count() == 1 and GraphQuery().start_name("name 5", fuzzy=True).matches(v, e).count() == 11
    for bad in ("depth:x", "importance:>", "limit:many"):
        with pytest.raises(ValueError):
            GraphQuery.parse(bad)


def test_nothing_reached_and_khop_by_hubs(spark, tables, monkeypatch):
    v, e = tables
    assert GraphQuery().start("absent").traverse("LIKES").matches(v, e).count() == 0
    assert GraphQuery().traverse("NOSUCH", depth=2).run(v, e).collect() == []
    before = {tuple(r) for r in gr.k_hop(e, v.where("id = 'v0'"), 2).collect()}
    monkeypatch.setattr("tarnfold.operators.graph_query.PART_EDGES", 4)
    assert {tuple(r) for r in gr.k_hop(e, v.where("id = 'v0'"), 2).collect()} == before and len(before) == 60
