"""The best representative of each group."""

import glob
import os
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from ferrule.llm import survivors

SCHEMA = "mention_id long, dup_group long, normalized_value string, ea_type string, section string, confidence double, extracted_at timestamp, source_type string, paper_id string, v string"


def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = entry.queries()["p7_found"](spark, sf).toPandas().sort_values("dup_group").reset_index(drop=True)
    want = con.execute(entry.oracle_sql()["p7_found"]).df().sort_values("dup_group").reset_index(drop=True)
    assert len(got) and got.astype(str).equals(want[got.columns].astype(str))


def test_cases(spark):
    t = datetime(2024, 1, 1)
    rows = [
        (1, 1, "a", "unspecified", " Results ", 0.5, None, "x", "p", "z"), (2, 1, "b", "NONE", "N/A", 90.0, None, "x", "p", "z"), (3, 1, " ", "bulk", None, 0.95, t, "x", "p", "z"),
        (4, 2, "a", None, None, None, t, "x", "p", "z"), (5, 2, "b", None, None, -1.0, None, "x", "p", "z"), (6, 3, "x", None, None, 0.5, t, "x", "p", "z"), (5_0, 3, "y", None, None, 0.5, t, "x", "p", "z"), (7, None, "q", "q", "q", 1.0, t, "x", "p", "z"),
        (8, 4, None, None, None, float("nan"), None, None, None, None),
    ]
    df = spark.createDataFrame(rows + rows[:2], SCHEMA)
    got = {r.dup_group: tuple(r)[1:] for r in survivors.survivors(df).collect()}
    assert got == {1: ("b", "bulk", "Results", 950), 2: ("a", "NONE", "NONE", 0), 3: ("x", "NONE", "NONE", 500), 4: ("NONE", "NONE", "NONE", 0)}
    assert survivors.survivors(df.limit(0)).count() == 0


def test_truth_prefers_reliable_sources(spark):
    rows = []
    for g in range(60):
        rows += [(g * 10, g, f"t{g}", None, None, 0.5, None, "good", "1", ""), (g * 10 + 1, g, f"t{g}", None, None, 0.5, None, "good", "2", ""), (g * 10 + 2, g, f"f{g}", None, None, 0.5, None, "bad", "3", "")]
    rows += [(10_000, 1000, "right", None, None, 0.5, None, "good", "1", ""), (10_001, 1000, "wrong", None, None, 0.5, None, "bad", "3", "")]
    values, trust = survivors.discover_truth(spark.createDataFrame(rows, SCHEMA), source=("source_type",))
    assert {r.dup_group: r.value for r in values.collect()}[1000] == "right"
    t = {r.source: r.trust for r in trust.collect()}
    assert t["good"] > 0.6 > t["bad"]
    assert survivors.discover_truth(spark.createDataFrame([], SCHEMA))[0].count() == 0


@pytest.mark.parametrize(("value", "milli"), [(0.4365, 437), (81.3, 813), (1.0, 1000), (-1.0, None), (101.0, None), (0.0, 0)])
def test_scales(spark, value, milli):
    from pyspark.sql import functions as F

    assert spark.range(1).select(survivors.confidence_milli(F.lit(value))).first()[0] == milli


def test_truth_by_brute_force(spark, sf):
    """The same rounds in plain Python over the whole smallest table."""
    from collections import defaultdict
    from math import log

    from ferrule.session import table

    m = table(spark, sf, "mentions")
    fields = ("normalized_value", "ea_type", "section")
    rows = m.where("dup_group is not null").select("mention_id", "dup_group", "source_type", "paper_id", *(survivors.value_of(f).alias(f) for f in fields)).distinct().collect()
    claims = defaultdict(int)
    for r in {(r.mention_id, r.dup_group, f"{r.source_type or 'NONE'}\u0001{r.paper_id or 'NONE'}", f, r[f]) for r in rows for f in fields if r[f] is not None}:
        claims[r[1], r[3], r[4], r[2]] += 1
    trust = {s: 0.8 for _, _, _, s in claims}
    while True:
        w, whole = defaultdict(float), defaultdict(float)
        for (g, f, v, s), n in claims.items():
            x = n * log((1 + trust[s]) / (1.02 - trust[s]))
            w[g, f, v] += x
            whole[g, f] += x
        total, count = defaultdict(float), defaultdict(int)
        for (g, f, v, s), n in claims.items():
            total[s] += n * w[g, f, v] / whole[g, f]
            count[s] += n
        fresh = {s: (total[s] + 1.6) / (count[s] + 2) for s in trust}
        change = max(abs(fresh[s] - trust[s]) for s in trust)
        trust = fresh
        if change < 0.005:
            break
    w = defaultdict(float)
    for (g, f, v, s), n in claims.items():
        w[g, f, v] += n * log((1 + trust[s]) / (1.02 - trust[s]))
    best = {}
    for (g, f, v), x in w.items():
        if (g, f) not in best or (round(x, 9), v.encode()) > (round(best[g, f][0], 9), best[g, f][1].encode()):
            best[g, f] = (x, v)
    values, found = survivors.discover_truth(m)
    got = {(r.dup_group, r.field): r.value for r in values.collect()}
    assert set(got) == set(best) and sum(got[k] != best[k][1] for k in got) == 0
    assert {r.source: round(r.trust, 6) for r in found.collect()} == {s: round(t, 6) for s, t in trust.items()}


def test_truth_settles_or_says_so(spark):
    rows = [(i * 10 + k, i, v, None, None, 0.5, None, s, "1", "") for i in range(40) for k, (s, v) in enumerate((("a", "x"), ("b", "x" if i % 2 else "y"), ("c", "y" if i % 3 else "x")))]
    df = spark.createDataFrame(rows, SCHEMA)
    by = {"source": ("source_type",), "fields": ("normalized_value",)}
    a, b = (survivors.discover_truth(df, **by, settled=s)[1] for s in (0.0001, 0.00001))
    assert {r.source: round(r.trust, 2) for r in a.collect()} == {r.source: round(r.trust, 2) for r in b.collect()}
    with pytest.raises(RuntimeError):
        survivors.discover_truth(df, **by, rounds=1, settled=0.00001)
