"""Filling containers."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrule.llm import packing


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=25), st.integers(30, 60))
def test_plan_is_whole_and_fits(sizes, capacity):
    sizes = {s: n for s, n in sizes.items() if s <= capacity}
    steps, opened = packing.plan(sizes, capacity)
    fill, ranks = {}, {}
    for size, a, b, each, first in steps.tolist():
        for r in range(a, b):
            box = first + (r - a) // each
            fill[box] = fill.get(box, 0) + size
            ranks.setdefault(size, []).append(r)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in sizes.items() if n}
    assert all(f <= capacity for f in fill.values()) and len(fill) == opened
    total = sum(s * n for s, n in sizes.items())
    # no packing needs fewer containers than the whole fills, nor than there are items of more than half a container
    least = max(total / capacity, sum(n for s, n in sizes.items() if 2 * s > capacity))
    assert opened <= 1.7 * least + 2


def test_dense():
    rng = random.Random(1)
    sizes = {}
    for _ in range(20000):
        s = min(512, max(1, int(rng.lognormvariate(5, 1))))
        sizes[s] = sizes.get(s, 0) + 1
    _, opened = packing.plan(sizes, 512)
    assert sum(s * n for s, n in sizes.items()) / (512 * opened) > 0.98


@pytest.mark.parametrize("shard_rows", [7, 50_000])
def test_frame(spark, shard_rows):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0, 5, 5, 5, 40, 60, 99, 100, 101, 250, 1000])) for i in range(500)] + [(7, 5), (7, 5)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("size", F.lit("x"))
    out = packing.pack(df, 100, shard_rows=shard_rows).collect()
    load = {}
    for r in out:
        load[r.container_no] = load.get(r.container_no, 0) + r["size"]
    assert max(load.values()) <= 100 and sum(load.values()) == sum(n or 0 for _, n in rows)
    assert {r.doc_id for r in out} == {i for i, _ in rows}
    pieces = [r for r in out if r["size"] == 100 and r.piece_no > 0]
    assert len({r.container_no for r in pieces}) == len(pieces)
    whole = [r for r in out if r.doc_id not in {i for i, n in rows if (n or 0) > 100}]
    assert all(r.piece_no == 1 for r in whole)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 0)


def test_fill_and_invariants(spark):
    rows = [(i, n) for i, n in enumerate([0, None, 1, 5, 10, 11, 25, 4, 6, 6, 4, 3, 3, 3] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    f = packing.fill(packing.pack(df, 10, shard_rows=7), 10).first()
    assert f.n_items == len(rows) and f.n_over == 0 and f.n_cut == 0 and f.fill > 0.95
