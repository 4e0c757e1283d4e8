"""Repair of scanned text."""

import random

import pytest

from ferrule.functions.pages import furniture
from ferrule.llm import scan_repair as sr

WORDS = "the measured activation energy of sintered pellets amounts to high values once vacancies dominate transport in solid-state grain-boundary network and conductivity reported here was reproduced".split()


def brute(words, word, most):
    def d(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    return {w: k for w in words if (k := d(word, w)) <= most}


def test_automaton_finds_all():
    rng = random.Random(4)
    trie = sr.Trie(dict.fromkeys(WORDS, 1))
    for _ in range(400):
        w = list(rng.choice(WORDS))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "x", "e", "rn"])
        w = "".join(w) or "a"
        for most in (0, 1, 2):
            assert {x: k for k, x in trie.near(w, most)} == brute(set(WORDS), w, most)


@pytest.mark.parametrize("line", ["12", "- 275 -", "– 241 –", "[235]", "S46", "| 233", "p. 373", "Page 320 of 512", "185/512"])
def test_page_numbers(line):
    assert furniture(line) == "pageno"


@pytest.mark.parametrize(
    "line",
    ["SOLID ION REPORTS", "HOT-PRESSED MOISTURE UPTAKE   664", "Garnet and Glass Quarterly, Vol. 69, No. 9, 2015", "704    Ekbu and Ravsto: Surface Carbonate Formation", "Tolphaell et al. / Applied Ionics Quarterly 88 (1998) 674–683", "Downloaded from the Thin Film Ionics Letters archive on 17/1/2015", "Author manuscript - Solid Ion Letters", "Accepted version, Solid Ion Quarterly", "Scanned copy: Solid Ion Letters"],
)
def test_heads(line):
    assert furniture(line) == "header"


@pytest.mark.parametrize("line", ["(17)", "0.20", "8.15", "LiCoO2 | 67.03 | 4.03", "V2O5", "D = MSD(t) / (6 t)", "Missing entries could not be determined.", "GPa", "", "12345", "σ = σ0"])
def test_content_lines(line):
    assert furniture(line) is None


CLEAN = ["The measured activation energy of sintered pellets amounts to high values.", "These vacancies dominate transport in solid-state grain-boundary network.", "Here conductivity reported was reproduced twice."] * 60
DIRTY = [
    ("The measured acti-\nvation energy\n12\nof slntered pellets arnounts to high values.", {("hyphen", "activation"), ("pageno", "12"), ("char", "sintered"), ("char", "amounts")}, "The measured activation energy of sintered pellets amounts to high values."),
    ("These vacancies dominate transport in solid-\r\nSOLID ION REPORTS\n state grain-boundary net¬\nwork.", {("hyphen", "solid-state"), ("hyphen", "network"), ("header", "SOLID ION REPORTS")}, "These vacancies dominate transport in solid-state grain-boundary network."),
    ("Here concluc‐\ntivity rep0rted was reproduccd twice.", {("hyphen", "conductivity"), ("char", "conductivity"), ("char", "reported"), ("char", "reproduced")}, "Here conductivity reported was reproduced twice."),
    ("Here c0nductivity of Li7La3Zr2O12 and V2O5 at 0.35 eV", {("char", "conductivity")}, "Here conductivity of Li7La3Zr2O12 and V2O5 at 0.35 eV"),
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [("mentions", i, t, "k") for i, t in enumerate(CLEAN + [d[0] for d in DIRTY] + [" ", "\n\n", "7", "-\n-", "x" * 5000])]
    return spark.createDataFrame(rows, "src string, rec_id long, text string, kind string").select("src", "rec_id", "text")


def test_found(texts):
    got = {}
    for r in sr.find_repairs(texts.union(texts.limit(5))).collect():
        got.setdefault(r.rec_id, set()).add((r.kind, r.fixed))
    assert got == {len(CLEAN) + i: d[1] for i, d in enumerate(DIRTY)}


def test_text(texts):
    got = {r.rec_id: r.text for r in sr.repaired(texts).collect()}
    assert [got[len(CLEAN) + i] for i in range(len(DIRTY))] == [d[2] for d in DIRTY]
    assert got[0] == CLEAN[0]


def test_empty(spark):
    assert sr.find_repairs(spark.createDataFrame([], "src string, rec_id long, text string")).count() == 0


def test_rare_words_stay():
    """A word that no confusion explains is left alone unless its neighbours speak for the candidate."""
    words = {w: 50 for w in ("electrode", "relation", "conductor", "reaction", "composition", "the", "surface")}
    r = sr.Repairer(words, {("the", "surface")})
    for w in ("electrodes", "relations", "conductors", "reactions", "compositions", "surfoce"):
        assert r.fix(w, None, None) is None
    assert r.fix("surfoce", "the", None) == "surface" and r.fix("surf&ce", None, None) == "surface" and r.fix("reacti0n", None, None) == "reaction"


def test_paragraphs_are_kept():
    r = sr.Repairer({w: 9 for w in ("One", "first", "second", "continuous", "starts", "here")}, set())
    text = "One first\nsecond.\n\nOne starts contin-\nuous\n\n- 12 -\n\nfirst here.\n\n\nOne starts"
    assert r.text(text) == "One first second.\n\nOne starts continuous first here.\n\nOne starts"
    assert r.text("One  first") == "One first" and r.text("") == ""


def test_texts_of_scans(spark):
    """Planted damage in every text comes out again as the text that it was made of."""
    base = [f"the measured conductivity of sample {i} remains stable during prolonged storage" for i in range(40)]
    rows = [("mentions", i, t) for i, t in enumerate(base)]
    rows += [("mentions", 100 + i, t.replace("conductivity", "conduc-\ntivity").replace("stable", "stab1e").replace(" during", "\nPage 7\nduring")) for i, t in enumerate(base)]
    df = spark.createDataFrame(rows, "src string, rec_id long, text string")
    got = {r.rec_id: r.text for r in sr.repaired(df).collect()}
    assert [got[100 + i] for i in range(40)] == base and [got[i] for i in range(40)] == base
