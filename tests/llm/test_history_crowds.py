"""Keys that many forms share: the same rows as when each form is compared with each."""

import random

import pytest
from pyspark.sql import functions as F

from ferrule.llm import history

SCHEMA = "paper_id string, title string, doi string, filename string"
HEAD = "Mapping slow anion redox of quenched Na3PS4 after long ageing in dry argon: what pressure does to "
# six edits from the first to the last, which no key and no center but the one in the middle brings together
CHAIN = [HEAD + x for x in ("thin pellets", "thin pelxyz", "thin pewvxyz")]


def found(df, **more):
    return sorted((r.paper_id_a, r.paper_id_b) for r in history.repeats(df, **more).collect())


@pytest.mark.parametrize("crowd", [1, 200])
def test_a_form_matches_others_than_its_center(spark, crowd):
    """The middle one belongs to the longest one's center and holds the last one too."""
    words = [history.read_title(t)[2] for t in CHAIN]
    same = [history.same_title(words[i], words[j], False, False) for i, j in ((0, 1), (1, 2), (0, 2))]
    assert same == [True, True, False]
    rows = [(f"{i}", t, None, "hot.pdf") for i, t in enumerate(CHAIN)]
    assert found(spark.createDataFrame(rows, SCHEMA), crowd=crowd) == [("0", "1"), ("0", "2")]


@pytest.mark.parametrize("crowd", [1, 200])
def test_a_cut_off_title_counts_all_whole_ones(spark, crowd):
    """Two whole titles begin like it, so it is neither's, however long they are."""
    rows = [("1", HEAD + "thin pellets", None, None), ("2", HEAD[:-12] + "heat does to a cell", None, None), ("3", HEAD[:70] + "…", None, None)]
    assert found(spark.createDataFrame(rows, SCHEMA), crowd=crowd) == []
    assert found(spark.createDataFrame(rows[1:], SCHEMA), crowd=crowd) == [("2", "3")]


@pytest.mark.parametrize("crowd", [1, 200])
def test_no_block_in_common(spark, crowd):
    """Under one DOI, two forms that have no quarter alike."""
    a, b = "Mapping slow void growth in aged cells of Na3PS4 under pressure and heat", "Mapping slow voidgrowth in aged cells of Na3PS4 under pressure and haet"
    rows = [(f"{i}", t, "10.99100/csr.2020.aaaaaa", f"{i}.pdf") for i, t in enumerate((HEAD + "thin pellets", a, b))]
    assert found(spark.createDataFrame(rows, SCHEMA), crowd=crowd) == [("1", "2")]


def test_papers(spark, sf):
    from ferrule.session import table

    papers = table(spark, sf, "papers")
    few, many = history.repeats(papers, crowd=1).cache(), history.repeats(papers).cache()
    assert few.count() == many.count() > 0 and few.exceptAll(many).count() == 0


def test_grams_drop_no_pair():
    """Of two forms that are one title the shorter has all but the spared grams in the longer, also by its marks."""
    rng, n = random.Random(5), 0
    base = [history.read_title(HEAD + "thin pellets")[2], "lithium cells", "solid ions", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a"]
    for _ in range(4000):
        a = b = rng.choice(base)
        for _ in range(rng.randrange(6)):
            i = rng.randrange(len(b))
            b = rng.choice((b[:i] + b[i + 1 :], b[:i] + "x" + b[i:], b[:i] + "y" + b[i + 1 :], b[:i] + b[i : i + 2][::-1] + b[i + 2 :]))
        short = rng.random() < 0.3
        b = b[: rng.randrange(20, 40 + len(b))] if short else b
        if not b.replace(" ", "") or not history.same_title(a, b, False, short):
            continue
        (gx, lone, mx, nx, spare), (gy, _, my, ny, _) = sorted(map(history.grams_of, (a, b)), key=lambda g: g[3])
        n += 1
        assert len(set(gx) - set(gy)) <= spare and sum((x & ~y & (2**64 - 1)).bit_count() for x, y in zip(mx, my)) <= spare
        assert not lone or 0 in lone or ny in lone
    assert n > 1500
