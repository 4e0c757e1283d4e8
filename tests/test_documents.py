"""The engine's queries over the texts of documents, against brute force over each text."""

import re

import pytest

import __spark_entry__ as entry
from ferrule.operators import layout

LONG = "The lattice of LiCoO2 was kept. " * 900 + "The band gap of LiCoO2 was 2.7 eV."
TEXTS = {
    1: "On garnets\nAbstract\nAn ionic conductivity of 3 mS/cm was measured in Li7La3Zr2O12.\n1. Introduction\nAs before.\nFigure 2. SEM of LiFePO4, see Table 3.\nsigma = A exp(x) (4)\nReferences\n[1] One\nwrapped\n[2] Two",
    2: LONG,
    3: "Über Leitfähigkeit\nWir fanden eine Aktivierungsenergie.\nMethods\nWe ran an AIMD simulation in a supercell with VASP. It was short.",
    4: None,
    5: "",
    6: " \n\t\n",
    7: "\ufeffTable 1. Capacity \U0001f50b\nE = m c (1)\nConclusion\nThe MSD gave a diffusion coefficient of 1.2×10^-8 cm2/s.",
    8: "References\nlost line\n[1] Sole",
}
SPACE = "\\s\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
HEAD = sorted(((w, n) for n, ws in layout.SECTIONS.items() for w in ws), key=lambda x: -len(x[0]))


def strip(s):
    return re.sub(f"^[{SPACE}]+|[{SPACE}]+$", "", s)


def brute():
    """(doc, line_no, section, type, line) by one loop over the lines of each text."""
    out = []
    for doc, text in TEXTS.items():
        section = "Metadata/Header"
        for no, line in enumerate((text or "").split("\n")):
            if not (line := strip(line)):
                continue
            head = next((n for w, n in HEAD if len(line) < 60 and re.sub(r"^(?:(?:[ivx]+|\d+(?:\.\d+)*)[.)\s]+)?\s*", "", line.lower()).startswith(w)), None)
            section = head or section
            kind = "header" if head else "reference" if section == "References" else "Caption" if re.match(r"(?i)(Fig(?:ure)?s?|Table)\.?\s*\d", line) else "EquationCandidate" if re.search(r"=.*\(\d\)$", line) else "Text"
            out.append((str(doc), no, section, kind, line))
    return out


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return lambda name: entry.queries()[f"documents_{name}"](spark, folder).collect()


def test_sections(found):
    assert sorted((r.paper_id, r.line_no, r.section, r.type) for r in found("section_carry_forward")) == sorted(x[:4] for x in brute())


def test_blocks_captions_references(found):
    want, refs = [], []
    for doc, no, section, kind, line in brute():
        if kind == "Text" and want and want[-1][:3] == [doc, "Text", section] and want[-1][4] == no - 1:
            want[-1][3] += " " + line
            want[-1][4] = no
        elif kind in ("Text", "Caption", "EquationCandidate"):
            want.append([doc, kind, section, line, no])
        elif kind == "reference":
            if refs and refs[-1][0] == doc and not re.match(r"\[?\d{1,3}\]?\.?\s+\S", line):
                refs[-1][1] += " " + line
                continue
            refs.append([doc, line])
    got = found("paragraphs")
    assert sorted((r.paper_id, r.type, r.section, r.text) for r in got) == sorted(tuple(w[:4]) for w in want)
    assert sorted((r.paper_id, r.ref_kind, r.ref_number, r.text) for r in found("captions")) == sorted((w[0], "Table" if w[3][0] == "T" else "Figure", re.search(r"\d+", w[3])[0], w[3]) for w in want if w[1] == "Caption")
    assert {(r.paper_id, r.entry) for r in found("references_split")} == {tuple(r) for r in refs}


def test_sentences_and_mentions(found):
    sentences = [(doc, s) for doc, _, _, kind, line in brute() if kind in ("Text", "Caption") for s in re.split(r"(?<=[.!?])\s+", line) if len(s) >= 4]
    joined = {(r.paper_id, r.sentence) for r in found("sentences_scored")}
    assert {x for x in sentences if x[0] == "2"} <= joined and len([1 for r in found("sentences_scored") if r.paper_id == "2"]) == 901
    got = {(r.paper_id, r.property_name, r.normalized_value, r.formula) for r in found("all_mentions")}
    names = {"Band_Gap", "Ionic_Conductivity", "Diffusion_Coefficient", "Software"}
    assert {(d, n) for d, n, _, _ in got if n in names} == {("1", "Ionic_Conductivity"), ("2", "Band_Gap"), ("3", "Software"), ("7", "Diffusion_Coefficient")}
    assert ("1", "Ionic_Conductivity", "0.003 S/cm", "Li7La3Zr2O12") in got and ("2", "Band_Gap", "2.7 eV", "LiCoO2") in got and ("3", "Software", "VASP", "NONE") in got


def test_annotations(found):
    assert {(r.paper_id, r.equation_text) for r in found("equations_typed") if r.equation_type == "Unclassified"} == {(d, line) for d, _, _, kind, line in brute() if kind == "EquationCandidate"}
    assert [(r.paper_id, r.figure_number, r.referenced_materials, r.referenced_tables) for r in found("figures_xref")] == [("1", "2", "LiFePO4", "3")]
    assert {(r.paper_id, r.stage) for r in found("workflow_steps")} == {("1", "Conductivity Extraction"), ("3", "AIMD"), ("3", "Supercell Construction"), ("7", "MSD Analysis"), ("7", "Diffusion Analysis")}
