"""Components of links: the same by one task and by rounds, and few jobs as long as one task can do."""

import random

import pytest

from ferrule.llm import history


def edges_of(spark, edges):
    return spark.createDataFrame(edges, "form string, other string")


def smallest(edges):
    """By brute force."""
    comp = {x: x for e in edges for x in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {x: c for x, c in comp.items() if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("most", [0, history.TASK_EDGES])
def test_components(spark, most):
    rng = random.Random(2)
    edges = [(f"{rng.randrange(60):02}", f"{rng.randrange(60):02}") for _ in range(40)] + [("a1", "a2"), ("a2", "a1"), ("a3", "a3"), ("a2", "a0")]
    assert {r.form: r.comp for r in history.components(edges_of(spark, edges), most).collect()} == smallest(edges)
    assert history.components(edges_of(spark, []), most).count() == 0


def test_a_long_chain_takes_few_jobs(spark):
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(100)]
    spark.sparkContext.setJobGroup("chain", "components of a chain")
    try:
        comp = history.components(edges_of(spark, chain)).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.comp for r in comp} == {"000"} and len(comp) == 101
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 12
