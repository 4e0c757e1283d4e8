"""New batches against all history."""

import pytest
from pyspark.sql import functions as F

from ferrule.llm import history

BASE = "Tuning void formation in aged LiFe0.58Mn0.42PO4 in dry air: guidance for binder choice"


@pytest.mark.parametrize(
    "title",
    [
        "TUNING VOID FORMATION IN AGED LIFE0.58MN0.42PO4 IN DRY AIR - GUIDANCE FOR BINDER CHOICE",
        "Tuning  void formation in aged LiFe<sub>0.58</sub>Mn<sub>0.42</sub>PO<sub>4</sub> in dry air: guidance for binder choice †",
        "Tuning void formation in aged LiFe$_{0.58}$Mn$_{0.42}$PO$_{4}$ in dry air: guidance for binder choice | Molten Salt Annals",
        "[Article] Tuning void formation in the aged LiFe₀.₅₈Mn₀.₄₂PO₄ in dry air: guidance for binder choice*",
        "Full Paper – Title: Tuning void formation in aged LiFe0.58Mn0.42PO4 in dry air - guidance for binder choice // Thin Film Ionics Letters",
    ],
)
def test_decorations(title):
    assert history.read_title(title)[:4] == history.read_title(BASE)[:4]


def test_marks():
    assert history.read_title("Correction to: " + BASE)[0] == "correction" and history.read_title("Reply to the comment on: " + BASE)[0] == "reply" and history.read_title("Erratum – " + BASE)[0] == "erratum"
    assert [history.read_title(BASE + x)[1] for x in ("", " - II", " (Part 2)", ". Part II", " - III")] == ["", "2", "2", "2", "3"]
    assert history.read_title("Microsoft Word - Document1") is None and history.read_title("untitled") is None and history.read_title(None) is None and history.read_title("…") is None


def test_edits():
    for a, b, want in [("", "", 0), ("abc", "abc", 0), ("abcd", "abdc", 1), ("abc", "abbc", 1), ("abc", "ac", 1), ("kitten", "sitting", 3), ("abc", "xyz", 3), ("abc", "uvwxyz", 4)]:
        assert history.edits(a, b, 3) == min(want, 4)


def test_bits_change_in_one_block():
    a, b = history.fingerprint(history.read_title(BASE)[2]), history.fingerprint(history.read_title(BASE.replace("formation", "formatoin"))[2])
    assert sum(x == y for x, y in zip(a, b)) >= 3


@pytest.mark.parametrize(("doi", "key"), [("https://doi.example/10.99100/csq.2015.lp0rnm", "lp0rnm"), ("10.99100%2Fsir.2018.LT4GVN].", "lt4gvn"), (" 10.99100/ sir.2015.lxfapf;", "lxfapf"), ("10.98100/pre.dhmbliv3", "dhmbli"), ("10.1/x", None), ("n/a", None), (None, None), ("10.99100/a.2020.abcdef?via=list", "abcdef"), ("10.99100/a.2020.abcdef/pdf", "abcdef"), ("10.5555/other-form", "other-form")])
def test_doi(spark, doi, key):
    assert spark.createDataFrame([(doi,)], "d string").select(history.doi_key(F.col("d"))).first()[0] == key


ROWS = [
    ("01", BASE, "10.99100/csr.2020.aaaaaa", "a.pdf"),
    ("02", BASE.replace("void", "viod").upper(), None, "b.pdf"),  # damaged title, nothing else
    ("03", BASE[:70] + "…", "10.98100/pre.aaaaaav2", "c.pdf"),  # cut off, preprint
    ("04", "Correction to: " + BASE, None, "a.pdf"),
    ("05", BASE + " - II", "n/a", "d.pdf"),
    ("06", "NONE", "doi:10.99100/CSR.2020.AAAAAA", "e.pdf"),  # DOI only
    ("07", None, None, "papers/A.pdf"),  # file only: the last work it held was the correction
    ("08", BASE.replace("0.58", "0.61").replace("0.42", "0.39"), "10.99100/csr.2020.aaaaaa", "a.pdf"),  # wrong DOI, name taken over
    ("09", None, "", None),
    ("10", "Correction to: " + BASE + "*", "", "z.pdf"),
    ("11", BASE + " (Part 2)", None, "y.pdf"),
]
SCHEMA = "paper_id string, title string, doi string, filename string"
WANT = [("01", "02"), ("01", "03"), ("01", "06"), ("04", "07"), ("04", "10"), ("05", "11")]


def test_works(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted((r.paper_id_a, r.paper_id_b) for r in history.repeats(df.union(df.limit(3))).collect()) == WANT


def test_empty(spark):
    assert history.repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_copies(spark):
    df = spark.range(3000).select(F.format_string("%06d", "id").alias("paper_id"), F.lit(BASE).alias("title"), F.lit("10.99100/csr.2020.aaaaaa").alias("doi"), F.lit("a.pdf").alias("filename"))
    out = history.repeats(df)
    assert out.count() == 2999 and out.select("paper_id_a").distinct().count() == 1


def found(index, number=None):
    return sorted((r.paper_id_a, r.paper_id_b) for r in index.repeats(number).collect())


def test_batches_equal_whole(spark, tmp_path):
    """DOI only, file only, cut-off, damaged and bare rows, each in a batch after what they repeat."""
    index = history.HistoryIndex(spark, f"{tmp_path}/index")
    for n in range(0, len(ROWS), 3):
        for _ in range(2 if n == 3 else 1):  # a retry changes nothing
            index.accept(spark.createDataFrame(ROWS[n : n + 3], SCHEMA), n)
    assert found(index) == WANT
    assert found(index, 3) == [("01", "06")] and found(index, 9) == [("04", "10"), ("05", "11")]
    again = history.HistoryIndex(spark, f"{tmp_path}/index")  # what another process sees
    assert found(again) == WANT


def test_batches_of_papers_equal_whole(spark, sf):
    from ferrule.session import table

    papers = table(spark, sf, "papers")
    assert len(history.deliveries(papers, "batch_no", 20)) > 3
    parts, whole = history.repeats(papers, batch="batch_no", least=20).cache(), history.repeats(papers).cache()
    assert parts.count() == whole.count() > 0 and parts.exceptAll(whole).count() == 0


def test_unseen_keys_only_are_appended(spark, tmp_path):
    index = history.HistoryIndex(spark, f"{tmp_path}/index")
    index.accept(spark.createDataFrame(ROWS[:2], SCHEMA), 1)
    n = spark.read.parquet(f"{tmp_path}/index/keys").count()
    index.accept(spark.createDataFrame([("99", ROWS[0][1], ROWS[0][2], "other.pdf")], SCHEMA), 2)
    fresh = spark.read.parquet(f"{tmp_path}/index/keys").where("batch = 2")
    assert n > 12 and {r.kind for r in fresh.collect()} == {history.SHARED}  # a known form under a new file
    assert found(index) == [("01", "02"), ("01", "99")]


def test_short_titles(spark):
    """Titles of a word or two have fingerprints of their letters, so unlike ones don't meet."""
    prints = {t: history.fingerprint(t) for t in ("lithium", "sodium cells", "solid ions", "a b")}
    assert len({tuple(x) for x in prints.values()}) == 4 and all(prints["lithium"])
    rows = [(f"{i:02}", t, None, None) for i, t in enumerate(["Lithium", "Sodium cells", "Solid ions", "SODIUM CELLS", "Sodium celsl"])]
    assert [(r.paper_id_a, r.paper_id_b) for r in history.repeats(spark.createDataFrame(rows, SCHEMA)).orderBy("paper_id_b").collect()] == [("01", "03"), ("01", "04")]


@pytest.mark.parametrize("crowd", [1, 200])
def test_crowded_keys(spark, crowd):
    """One file and one beginning shared by all titles: the same links however few forms may share a key."""
    ends = ["guidance for binder choice", "what pressure does to pellets", "a machine learning potential", "from thin films to cells", "evidence from operando work"]
    rows = [(f"{i:02}", f"Tuning void formation in aged Na3PS4 in dry air: {e}", None, "hot.pdf") for i, e in enumerate(ends)]
    rows += [(f"{i + 10:02}", f"Tuning void formatoin in aged Na3PS4 in dry air: {e}".upper(), None, "hot.pdf") for i, e in enumerate(ends)]
    got = sorted((r.paper_id_a, r.paper_id_b) for r in history.repeats(spark.createDataFrame(rows, SCHEMA), crowd=crowd).collect())
    assert got == [(f"{i:02}", f"{i + 10:02}") for i in range(5)]


def test_ambiguous_beginning_waits(spark, tmp_path):
    """A cut-off title is linked as long as one whole title begins like it, and no longer once another does."""
    index = history.HistoryIndex(spark, f"{tmp_path}/index")
    cut = BASE[:62] + "…"
    index.accept(spark.createDataFrame([("01", BASE, None, None), ("02", cut, None, None)], SCHEMA), 1)
    assert found(index) == [("01", "02")]
    index.accept(spark.createDataFrame([("03", BASE.replace("guidance for binder choice", "a long look at each of the pores"), None, None)], SCHEMA), 2)
    assert found(index) == []
