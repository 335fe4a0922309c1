"""Work on pairs grows with what is found, not with the square of a group."""

import random

from larkspur.operators import content as C
from larkspur.operators import graph as G
from larkspur.plans import queries as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_of_several_results_are_found_by_pairs_of_results(spark):
    r = random.Random(7)
    rows = [(i, ["every"] + [f"u{r.randint(1, 25)}" for _ in range(r.randint(0, 12))] + [None] * (i % 3 == 0)) for i in range(150)] + [(500, None), (501, []), (502, ["every"])]
    serps = spark.createDataFrame(rows, "id long, urls array<string>")
    every = {tuple(x) for x in G.serp_edges(serps).collect()}
    for least in (2, 3, 5):
        out = G.serp_edges(serps, least=least)
        assert {tuple(x) for x in out.collect()} == {x for x in every if x[2] >= least} and out.count() > 0


def test_drift_query_makes_edges_once(spark, monkeypatch):
    made, true = [], G.serp_edges
    monkeypatch.setattr(G, "serp_edges", lambda *a, **b: made.append(b) or true(*a, **b))
    assert Q.QUERIES["cluster_drift"](spark, "/root/testdata/sf0.001").count() == 1
    assert made == [{"least": 3}]


def test_mates_are_listed_once_for_clusters_not_for_members(spark):
    r = random.Random(8)
    was, is_ = ({i: r.randint(1, 4) for i in range(200) if i % k} for k in (9, 8))
    is_ |= {i: was[i] for i in is_ if i % 3 and i in was}
    df = lambda x: spark.createDataFrame(list(x.items()), "id long, cluster_id int")
    both = was.keys() & is_.keys()
    want = {}
    for i in both:
        old, new = {j for j in both if was[j] == was[i]}, {j for j in both if is_[j] == is_[i]}
        if old != new:
            want[i] = (sorted(old - new), sorted(new - old))
    out = G.mates_changed(df(was), df(is_))
    assert {x["id"]: (x["left"], x["joined"]) for x in out.collect()} == want
    assert "array_except" not in plan(out)  # the rows only get what was listed


def test_prescribed_forbidden_pairs_each_set_once(spark):
    rows = [(s, p, f) for s, p, f in [("a", " Big  Cat", False), ("b", "big cat", True), ("a", "dog", True), ("c", "BIG CAT ", True), ("d", None, True)] for _ in range(2000)]
    out = C.prescribed_forbidden(spark.createDataFrame(rows, "set string, phrase string, forbidden boolean"))
    assert sorted(tuple(x) for x in out.collect()) == [("big cat", "a", "b"), ("big cat", "a", "c")]
    assert out._jdf.queryExecution().optimizedPlan().toString().lstrip().split("\n")[1].lstrip(" +-:").startswith("Join")  # of distinct sides
