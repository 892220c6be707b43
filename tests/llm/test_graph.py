"""Connected components: against a plain search, in few shuffles a step, and without a step where all are stars."""

import random
import re

import pytest
from chronofold.llm import graph


def plain(edges):
    near, found = {}, {}
    for u, v in edges:
        if u is not None and v is not None:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    for first in sorted(near):
        todo = [first]
        while todo:
            node = todo.pop()
            if node not in found:
                found[node] = first
                todo += near[node]
    return found


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_a_plain_search(spark, seed):
    rng = random.Random(seed)
    names = rng.sample(range(10_000), 400)
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(180)] + list(zip(names[:40], names[1:41], strict=True))
    edges += [(names[50], x) for x in names[60:90]] + [(7, 7), (None, 3), (4, None), edges[0], edges[0][::-1]]
    got = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["component"] for r in got} == plain(edges)


def test_stars_take_no_step_and_no_links_no_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "_large_star", lambda links: pytest.fail("a step over links that no step changes"))
    edges = [(1, k) for k in range(2, 60)] + [(k, 100) for k in range(101, 130)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == plain(edges)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_step_is_five_shuffles_at_most(spark):
    """The driver keeps every task's and plan's figures, so its memory follows the shuffles of a step."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = graph.cut(spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "u long, v long"))
        step = graph._small_star(graph._large_star(links))
        step.collect()
        plan = step._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan.split("== Initial Plan ==")[0]
    assert len(re.findall(r"[+:]- Exchange ", final)) <= 5, final
