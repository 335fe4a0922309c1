"""Edges at size: results that very many queries show don't make a row for each two of these queries."""

import random
from collections import Counter
from itertools import combinations

import pytest

from larkspur.operators import graph as G
from larkspur.plans import queries as Q


def most_rows(df):
    """The rows of the largest output in the plan of ``df`` as it ran."""

    def nodes(p):
        yield p
        kind = p.getClass().getSimpleName()
        for c in [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]:
            yield from nodes(c)

    counts = (p.metrics() for p in nodes(df._jdf.queryExecution().executedPlan()))
    return max(m.apply(k).value() for m in counts for k in ("numOutputRows", "pythonNumRowsReceived") if m.contains(k))


def lines(spark, folder, n, common):
    """``n`` parts, each with the suppliers 1 to ``common``, most of these parts' quantity, and some of others; the edges that are right."""
    r = random.Random(5)
    tops = {i: [*range(1, common + 1), *r.sample(range(100, 100 + n), 9 - common)] for i in range(n)}
    rows = [(i, s, 50.0 - k) for i, top in tops.items() for k, s in enumerate(top)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    by, met = {}, Counter()
    for i, top in tops.items():
        for s in top[common:]:
            for j in by.setdefault(s, []):
                met[j, i] += 1
            by[s].append(i)
    return {(a, b, c + common) for (a, b), c in met.items() if c + common >= 3}


@pytest.mark.parametrize("common", [1, 2])
def test_query_makes_no_pair_of_all_queries_of_one_result_or_two(spark, tmp_path, common):
    want = lines(spark, tmp_path, 1500, common)
    out = Q.QUERIES["serp_edges"](spark, str(tmp_path))
    assert {tuple(x) for x in out.collect()} == want and want
    assert most_rows(out) < 1500 * 1499 // 20


@pytest.mark.parametrize("group, together", [(1 << 16, 1 << 22), (40, 1), (300, 50)])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_edges_are_those_of_every_pair_of_queries(spark, monkeypatch, kind, group, together):
    monkeypatch.setattr(G, "GROUP", group), monkeypatch.setattr(G, "TOGETHER", together)
    r = random.Random(3)
    name = int if kind == "long" else (lambda i: f"q{i}")
    rows = [(name(i), [r.choice(["hot", "warm", None, ""]) if r.random() < 0.3 else f"u{int(r.paretovariate(0.7))}" for _ in range(r.randint(0, 14))]) for i in range(120)]
    rows += [(name(900 + i), [f"same{k}" for k in range(10)]) for i in range(4)] + [(None, ["hot", "warm", "u1", "u2"]), (name(800), None)]
    tops = {i: set(urls[:10]) - {None} for i, urls in rows if i is not None and urls}
    met = {(*sorted(p), len(tops[p[0]] & tops[p[1]])) for p in combinations(tops, 2)}
    serps = spark.createDataFrame(rows, f"id {kind}, urls array<string>")
    for least in (2, 3, 10):
        got = [tuple(x) for x in G.serp_edges(serps, least=least).collect()]
        want = {x for x in met if x[2] >= least}
        assert len(got) == len(want) > 0 and set(got) == want


def test_no_queries_no_edges(spark):
    assert G.serp_edges(spark.createDataFrame([], "id long, urls array<string>"), least=3).collect() == []
