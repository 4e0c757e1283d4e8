"""Several values packed in one field."""

import pytest

from ferrule.operators import split_values
from ferrule.operators.split_values import split_names

CASES = {
    "Lumvekott-Tesne R, Mirminér WE": ["Lumvekott-Tesne R", "Mirminér WE"],
    "Mirloris ET, Kalstoai K": ["Mirloris ET", "Kalstoai K"],
    "Çelriux, I. E.;Lumguygg, E.;Ulvzenér, P.": ["Çelriux, I. E.", "Lumguygg, E.", "Ulvzenér, P."],
    "Isbé R. Škoneai1,2, Salix Mirskaris⁴, Helix L. Jorlanell-Ravne1,*, Ligor Zan2,†": ["Isbé R. Škoneai", "Salix Mirskaris", "Helix L. Jorlanell-Ravne", "Ligor Zan"],
    "Wexjin, J., von Ulv, M. H., and Tol-Öst, G. Z.": ["Wexjin, J.", "von Ulv, M. H.", "Tol-Öst, G. Z."],
    '"Fami N. ""Moren"" Zanlande"; Ruvik-Pilix Gostskaygg': ['Fami N. "Moren" Zanlande', "Ruvik-Pilix Gostskaygg"],
    "Heren Ekriven et al.": ["Heren Ekriven"],
    "Rutho Quo; Samara Hullović; et al": ["Rutho Quo", "Samara Hullović"],
    "Oldo Ek, Ellix Dro and others": ["Oldo Ek", "Ellix Dro"],
    "['Berial Kal', \"Dolo O'Mir\"]": ["Berial Kal", "Dolo O'Mir"],
    '"Round Robin Team; Working Party 2"; Mozan Kal': ["Round Robin Team; Working Party 2", "Mozan Kal"],
    "Piren Selle; Samara Hul, Jr.; Olo Dro, III": ["Piren Selle", "Samara Hul, Jr.", "Olo Dro, III"],
    "Ana Bel\tCid Dor\r\nEli  Fox \n Gus Hil": ["Ana Bel", "Cid Dor", "Eli Fox", "Gus Hil"],
    "Ana\xa0B.\xa0Bel • Cid Dor · Eli Fox | Gus Hil / Ian Jon": ["Ana B. Bel", "Cid Dor", "Eli Fox", "Gus Hil", "Ian Jon"],
    '"Nim, Katho R." "Tes, Cabé"': ["Nim, Katho R.", "Tes, Cabé"],
    "Ana Bel und Cid Dor & Eli Fox": ["Ana Bel", "Cid Dor", "Eli Fox"],
    "Sas Mir; Hev Öst, Bet Tol; Kav Çel and Moz Jor": ["Sas Mir", "Hev Öst", "Bet Tol", "Kav Çel", "Moz Jor"],
    "Piren Selle; ;": ["Piren Selle"],
    "NONE": [], "": [], " ": [], None: [], ";;, ;": [],
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(str(i), f, "x") for i, f in enumerate(CASES)]
    out = {}
    for r in split_names(spark.createDataFrame(rows + rows[:3], "paper_id string, authors string, author string"), "paper_id", "authors").collect():
        out.setdefault(int(r.paper_id), []).append((r.pos_no, r.author))
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_forms(found, i):
    want = list(CASES.values())[i]
    assert sorted(found.get(i, [])) == list(enumerate(want, 1))


def test_very_long_and_empty(spark):
    names = [f"Ana{'x' * (i % 5)} Bel" for i in range(3000)]
    one = split_names(spark.createDataFrame([("p", "; ".join(names))], "paper_id string, authors string"), "paper_id", "authors")
    assert [r.author for r in one.orderBy("pos_no").collect()] == names
    assert split_names(spark.createDataFrame([], "paper_id string, authors string"), "paper_id", "authors").count() == 0


def test_fields_of_any_length(spark):
    """A quoted group and a listed one of a million characters, and rules that are too large to be broadcast."""
    long = "x" * 1_000_000
    rows = [("1", f'"A {long}"; B. Doe'), ("2", f"['A {long}', 'B. Doe']"), ("3", "Jane Roe; Ann Poe")]
    df = spark.createDataFrame(rows, "id string, a string")
    for most in (split_values.RULE_BYTES, 0):
        got = sorted((r.id, r.pos_no, len(r.author)) for r in split_values.split_names(df, "id", "a", most).collect())
        assert got == [("1", 1, 1_000_002), ("1", 2, 6), ("2", 1, 1_000_002), ("2", 2, 6), ("3", 1, 8), ("3", 2, 7)]
