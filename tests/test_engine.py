"""The extraction engine: lexicon, layout, formulas, mentions, tables, sinks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ferrule.functions import formulas, lexicon, numbers
from ferrule.operators import annotate, extract, layout, rank, tables
from ferrule.sources import documents
from ferrule.streaming import incremental

EXAMPLES = {
    "Activation_Energy": ("The apparent activation energy of LLZO was 0.35 eV", "0.35 eV"), "Migration_Barrier": ("a migration barrier of 250 meV", "0.25 eV"), "Diffusion_Coefficient": ("diffusion coefficient of 1.2×10^-8 cm2/s", "1.2e-08 cm**2/s"),
    "Ionic_Conductivity": ("ionic conductivity of 3 mS/cm", "0.003 S/cm"), "Voltage": ("average voltage near 3700 mV", "3.7 V"), "Capacity": ("discharge capacity of 150 mAh/g", "150 mAh/g"), "Cycle_Life": ("cycle life of 500 cycles", "500"),
    "Capacity_Retention": ("capacity retention of 95.5 %", "95.50 %"), "C_Rate": ("cycled at 2 C for days", "2"), "Interfacial_Resistance": ("interfacial resistance of 12 Ω cm2", "12 ohm*cm**2"), "Formation_Energy": ("formation energy of -1.5 eV/atom", "-1.5 eV"),
    "Surface_Energy": ("surface energy of 0.1 eV/Å2", "1.602 J/m**2"), "Bulk_Modulus": ("bulk modulus of Li7La3Zr2O12 was found to be 150 GPa", "150 GPa"), "Poisson_Ratio": ("Poisson's ratio of 0.28", "0.28"), "Lattice_Parameter_a": ("lattice parameter a of 1.2 nm", "12 angstrom"),
    "Space_Group": ("space group Ia-3d", "Ia-3d"), "Crystal_System": ("a Cubic phase", "Cubic"), "Band_Gap": ("band gap of 5.4 eV", "5.4 eV"), "Melting_Point": ("melting point of 180 °C", "453.1 kelvin"), "Raman_Peak": ("Raman shift at 612 cm-1", "612 cm**-1"), "XRD_Peak": ("XRD peak at 25.1 °", "25.1 degree"),
    "Software": ("run in VASP", "VASP"), "Cutoff_Energy": ("cutoff energy of 520 eV", "520 eV"), "Kpoint_Mesh": ("k-point mesh of 4×4×4", "4×4×4"), "Simulation_Time": ("simulation time of 2 ns", "2000 ps"), "Ensemble": ("in the NVT ensemble", "NVT"),
    "Algorithm": ("a random forest was used", "random forest"), "Cross_Validation": ("by 5-fold cross-validation", "5"), "MAE": ("MAE of 0.03", "0.03"), "R2": ("R2 of 0.97", "0.97"), "Method": ("by ball milling", "ball milling"), "Atmosphere": ("under argon", "argon"), "Technique": ("seen by SEM", "SEM"),
}


def test_lexicon_counts():
    assert len(lexicon.ENTRIES) == 104
    assert list(Counter(e.category for e in lexicon.ENTRIES).values()) == [22, 7, 4, 10, 5, 6, 3, 19, 8, 15, 4, 1]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(str(i), 0, 1, "Text", "Results", 0, s, 0.5) for i, (s, _) in enumerate(EXAMPLES.values())]
    df = spark.createDataFrame(rows, "paper_id string, block_no int, page int, type string, section string, sent_no int, sentence string, score double")
    return {(int(r.paper_id), r.property_name): r.normalized_value for r in extract.mentions(extract.with_mentions(df)).collect()}


@pytest.mark.parametrize("name", EXAMPLES)
def test_property(found, name):
    assert found.get((list(EXAMPLES).index(name), name)) == EXAMPLES[name][1]


def test_bounds_and_dimensions():
    assert extract.normal_text("11", "eV", "energy") == "NONE" and extract.normal_text("10", "eV", "energy") == "10 eV"
    assert extract.normal_text("50", "kJ/mol", "energy") == "50 kJ/mol"
    assert extract.normal_text("5", "furlong", "length") == "NONE" and extract.normal_text(None, None, "count") == "NONE"
    assert extract.normal_text("2.3985", "V", "voltage") == f"{2.3985:.4g} V"


def test_headings(spark):
    lines = {"Abstract": "Abstract", "1. Introduction": "Introduction", "Introduction": "Introduction", "2.1 Results and Discussion": "Results", "IV. Experimental details": "Methods", "Methodology of all": "Methods", "We find": None, "abstract " + "x" * 80: None}
    df = spark.createDataFrame([(k,) for k in lines], "line string").withColumn("s", layout.section_of(F.col("line")))
    assert {r.line: r.s for r in df.collect()} == lines


def test_pages_empty(spark):
    pages = spark.createDataFrame([("a", 1, None), ("a", 2, ""), ("b", 1, " \n\t\n")], "paper_id string, page int, text string")
    assert layout.blocks(layout.typed_lines(layout.lines(pages))).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [("Li7La3Zr2O12 and LLZO", ["Li7La3Zr2O12", "Li7La3Zr2O12"]), ("NMC811", ["Li1Mn0.1Co0.1Ni0.8O2"]), ("Li2S-P2S5 glass", ["Li2S-P2S5"]), ("Li3InCl6·2H2O", ["Li3InCl6·2H2O"]), ("DFT, XRD, PBE0 and KNN", []), ("Li2O2 and H2O2", ["Li2O2", "H2O2"]), ("Na2O2, KNO3, Li2O", ["Na2O2", "KNO3", "Li2O"]), ("LGPS", ["Li10Ge(PS6)2"]), ("Li7−xLa3Zr2O12 (LiF)", ["Li7La3Zr2O12", "LiF"]), ("LiCoO2 + binder, xLiF", ["LiCoO2"]), ("Zr3(PO4)4", ["Zr3(PO4)4"]), ("", [])],
)
def test_materials(text, want):
    assert [m[1] for m in formulas.find_materials(text)] == want


def test_ranking_caps(spark):
    rows = [("p", i, 1, "Text", "Results", 0, 0, i, "ELECTROCHEMICAL", "Voltage", f"{i % 7} V", "NONE", 0.5, 0.5, "LiCoO2", "proximity") for i in range(70)]
    df = spark.createDataFrame(rows, "paper_id string, block_no int, page int, type string, section string, sent_no int, prop_idx int, match_no int, category string, property_name string, normalized_value string, ea_type string, confidence double, score double, formula string, extraction_method string")
    assert rank.ranked(df).count() == rank.TOP
    assert rank.relations(df).groupBy("normalized_value").count().agg(F.max("count")).first()[0] == rank.CAP
    assert rank.agree(df).agg(F.max("confidence")).first()[0] == pytest.approx(0.65)
    # agreement doesn't raise a relation
    assert {r.relation_confidence for r in rank.relations(rank.agree(df)).collect()} == {0.6}


def test_merged_headers(spark):
    g = spark.createDataFrame([("p", 1, 1, [["Material", None, "E_a (eV)", "E_a (eV)"], ["LFP", "", "0.3", "x", "extra"], ["", None, "", ""]])], "paper_id string, page int, t_idx int, cells array<array<string>>")
    h = tables.headed(g)
    assert h.first().headers == ["Material", "Material_2", "E_a (eV)", "E_a (eV)_2"]
    r = tables.rows(h).collect()
    assert len(r) == 1 and r[0].row["Column_4"] == "extra"
    m = tables.table_mentions(tables.rows(h)).collect()
    assert [(x.normalized_value, x.formula, x.unit) for x in m] == [("0.3 eV", "LiFePO4", "eV")]


def test_equations_once(spark):
    b = spark.createDataFrame([("p", 0, 1, "EquationCandidate", "Results", "D = kT (1)", None, None), ("p", 1, 1, "EquationCandidate", "Results", "D = kT (1)", None, None), ("p", 2, 1, "Text", "Results", "An Arrhenius law. An Arrhenius law again.", None, None)], "paper_id string, block_no int, page int, type string, section string, text string, ref_kind string, ref_number string")
    assert sorted(r.equation_type for r in annotate.equations(b, extract.sentences(b)).collect()) == ["Arrhenius", "Unclassified"]


def test_stream_publishes_once(spark, tmp_path):
    src, target = f"{tmp_path}/in", f"{tmp_path}/out"
    page = "paper_id string, page int, text string"
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], page).write.parquet(src)
    extract_ = lambda p: p.groupBy("paper_id").agg(F.count("*").alias("n"))
    incremental.publish(spark, src, target, extract_)
    spark.createDataFrame([("b", 1, "y2"), ("c", 1, "z")], page).write.mode("append").parquet(src)
    incremental.publish(spark, src, target, extract_)
    incremental.publish(spark, src, target, extract_)
    assert sorted(r.paper_id for r in spark.read.parquet(f"{target}/data").collect()) == ["a", "b", "c"]


def test_stream_stops_between_batches(spark, tmp_path):
    src, target, seen = f"{tmp_path}/in", f"{tmp_path}/out", []
    for name in "abc":
        spark.createDataFrame([(name, 1, "x")], "paper_id string, page int, text string").coalesce(1).write.mode("append").parquet(src)
    count = lambda p: p.groupBy("paper_id").agg(F.count("*").alias("n"))
    incremental.publish(spark, src, target, count, 1, seen.append, stop=lambda: len(seen) >= 2)
    assert len(seen) == 2 and spark.read.parquet(f"{target}/data").count() == 2
    incremental.publish(spark, src, target, count, 1)
    assert sorted(r.paper_id for r in spark.read.parquet(f"{target}/data").collect()) == ["a", "b", "c"]


def test_folders_of_an_application(spark):
    from ferrule import session

    df = session.stored(spark.range(3), "x")
    assert session.exists(spark, f"{session.work_dir(spark)}") and df.count() == 3
    session.discard(df)
    session.discard(df)
    assert session.shared_dir(spark).startswith("file:")


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/A.PDF").write_bytes(b"one\x0ctwo " + b"x" * 60)
    (tmp_path / "in/b.pdf").write_bytes(b"bad")
    (tmp_path / "in/c.txt").write_bytes(b"no")

    def decode(data):
        if data == b"bad":
            raise ValueError("broken")
        return data.decode().split("\x0c")

    rows = documents.decode_files(documents.files(spark, f"{tmp_path}/in"), decode, lambda d, i: f"ocr {i}").collect()
    assert sorted((r.paper_id, r.page or 0, r.text[:5] if r.text else r.error) for r in rows) == [("A.PDF", 1, "ocr 1"), ("A.PDF", 2, "two x"), ("b.pdf", 0, "broken")]
    df = spark.createDataFrame([("a", [1, 2])], "paper_id string, xs array<int>")
    documents.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().xs == "[1,2]"
    for _ in range(2):
        documents.append_json(df, f"{tmp_path}/json")
        documents.append_table(df, f"{tmp_path}/tab", "1")
    assert spark.read.json(f"{tmp_path}/json").count() == spark.read.parquet(f"{tmp_path}/tab").count() == 1
    assert spark.createDataFrame([("<p>a &amp; b</p>c",)], "h string").select(documents.html_text(F.col("h"))).first()[0] == "a & b\nc"


def test_tables_join_the_paper(spark):
    import json

    from ferrule.plans import pipeline

    pages = spark.createDataFrame([("p", 1, "Results\nTable 1. Values at hand.\nAn ionic conductivity of 3 mS/cm was found in LiCoO2.\nD = kT (1)\nFigure 4. SEM of LiCoO2.\nReferences\n[1] One")], "paper_id string, page int, text string")
    grids = spark.createDataFrame([("p", 1, 1, [["Material", "Ionic conductivity (mS/cm)", "Activation energy, GB (eV)"], ["LFP", "3", "0.3"]])], "paper_id string, page int, t_idx int, cells array<array<string>>")
    x = pipeline.run(pages, ("ELECTROCHEMICAL",), grids)
    assert sorted((r.property_name, r.value, r.ea_type, r.material_formula, r.extraction_method, r.sentence[:7]) for r in pipeline.relations(x).collect()) == [("Activation_Energy", "0.3 eV", "grain boundary", "LiFePO4", "table_row", "Table 1"), ("Ionic_Conductivity", "0.003 S/cm", "NONE", "LiCoO2", "proximity", "An ioni"), ("Ionic_Conductivity", "0.003 S/cm", "NONE", "LiFePO4", "table_row", "Table 1")]
    record = json.loads(pipeline.nested(x).first().payload)
    assert [m["normalized_formula"] for m in record["materials"]] == ["LiCoO2", "LiFePO4"]
    assert [len(record[k]) for k in ("equations", "figures", "tables", "references")] == [1, 1, 1, 1] and record["tables"][0]["caption"] == "Table 1. Values at hand."


def test_numbers():
    assert [n.text for n in numbers.numbers("0.2-0.3 eV, 216±31 meV, 1.2×10−8 cm2/s, -5, x2.5.6, 3 e-3, Li7La3")] == ["0.2", "0.3", "216", "1.2×10−8", "2", "-5", "2.5", "3 e-3", "7", "3"]
    assert [numbers.parse(x) for x in (".5", "-.5", "1.2×10−8", "2x10^3", "1e400", "", None, "a", "1.")] == [0.5, -0.5, 1.2e-8, 2000.0, float("inf"), None, None, None, None]
    assert extract.normal_text(".5", "eV", "energy") == "0.5 eV" and extract.normal_text("3", "ms/cm", "conductivity") == "3 ms/cm" and extract.normal_text("3", "mScm", "conductivity") == "NONE"


def test_search_is_linear_in_length():
    """100,000 characters of triggers without values, of digits, and of a value at the end."""
    import time

    search = lexicon.Search()
    began = time.time()
    for text in ("activation energy voltage band gap " * 3000, "1.5 " * 25_000, "of " * 33_000 + "a band gap of 2 eV in LiCoO2", "(Li" * 33_000):
        found = extract.read_sentence(text, search)[0]
        assert [f["normalized_value"] for f in found] == (["2 eV"] if "LiCoO2" in text else [])
    assert time.time() - began < 20


def test_superscripts_are_read(spark):
    pages = spark.createDataFrame([("p", 1, "Results\nThe ionic conductivity of Li₇La₃Zr₂O₁₂ was 1.2×10⁻³ S/cm.\nﬁne")], "paper_id string, page int, text string")
    from ferrule.plans import pipeline

    x = pipeline.run(pages)
    assert [(r.normalized_value, r.formula, r.raw_value) for r in x.linked.collect()] == [("0.0012 S/cm", "Li7La3Zr2O12", "('1.2×10−3', 'S/cm')")]
    assert x.blocks.first().text.endswith("fine")


def test_cells_are_composed(spark):
    g = spark.createDataFrame([("p", 1, 1, [["Sample", "Density\n(g/cm³)", "Space group"], ["LFP", "3.5", "2 Pnma"], ["LCO", ".5", "x"]]), ("q", 1, 1, []), ("r", 1, 1, [[]])], "paper_id string, page int, t_idx int, cells array<array<string>>")
    m = tables.table_mentions(tables.rows(tables.headed(g))).collect()
    assert sorted((x.property_name, x.normalized_value, x.raw_value, x.formula) for x in m) == [("Density", "3.5 g/cm**3", "3.5", "LiFePO4"), ("Space_Group", "2", "2 Pnma", "LiFePO4")]


def test_doi_and_year(spark):
    pages = spark.createDataFrame([("a", 1, "x 2001 doi 10.1234/abc."), ("a", 2, "Published 1999"), ("a", 3, "© 2005"), ("b", 1, "none"), ("c", 1, "Received: May 1850, in 2010")], "paper_id string, page int, text string")
    info = spark.createDataFrame([("a", "t", "D:2020"), ("b", "see 10.5555/t-1)", "D:20180101")], "paper_id string, title string, creation_date string")
    got = {r.paper_id: (r.doi, r.publication_year) for r in layout.doi_and_year(pages, info).collect()}
    assert got == {"a": ("10.1234/abc", "2005"), "b": ("10.5555/t-1", "2018"), "c": ("NONE", "2010")}


def test_metadata_and_tables_of_files(spark, tmp_path):
    info = spark.createDataFrame([("a", "A title", "X", " ", "D:2019"), ("b", "untitled-1", None, "J", None), ("c", None, "", "", "")], "paper_id string, title string, author string, subject string, creation_date string")
    spans = spark.createDataFrame([("b", 1, 1, 9.0, "small text"), ("b", 1, 2, 20.0, "Large title "), ("b", 2, 3, 30.0, "Other page"), ("c", 1, 1, 20.0, "tiny")], "paper_id string, page int, seq int, size double, text string")
    got = sorted(tuple(r) for r in documents.paper_info(info, spans).collect())
    assert got == [("a", "A title", "X", None, "D:2019"), ("b", "Large title", None, "J", None), ("c", None, None, None, None)]
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"bad"))], "paper_id string, content binary")

    def decode(data):
        if data == b"bad":
            raise ValueError("no tables")
        return [[], [[["Material", None], ["LFP", 3]]]]

    assert sorted((r.paper_id, r.page, r.t_idx, r.cells, r.error) for r in documents.decode_tables(files, decode).collect()) == [("a", 2, 1, [["Material", None], ["LFP", "3"]], None), ("b", None, None, None, "no tables")]


def test_csv_grows_by_batches(spark, tmp_path):
    df = spark.createDataFrame([("ä", 'x "q", y\nz', None, [1])], "paper_id string, t string, n string, xs array<int>")
    for batch in ("1", "2", "2"):
        documents.append_csv(df, f"{tmp_path}/c", batch)
    data = next(p for p in tmp_path.glob("c/batch=1/*.csv")).read_bytes()
    assert data.startswith(b"\xef\xbb\xbfpaper_id")
    assert [tuple(r) for r in documents.read_csv(spark, f"{tmp_path}/c").collect()] == [("ä", 'x "q", y\nz', "NONE", "[1]")] * 2


def test_order_in_the_record(spark):
    """Figures by page and number, equations by page and place, materials and relations from the surest down."""
    import json

    from ferrule.plans import pipeline

    page = "Results\nFigure 9. SEM.\nFigure 2. TEM.\nz = 1 (2)\nb = 2 (1)\nA porosity of 3 % in LiF.\nIntroduction\nPrevious work reported a porosity of 4 % in NaCl.\nConclusion\nWe measured a porosity of 5 % in KBr."
    x = pipeline.run(spark.createDataFrame([("p", 1, page), ("q", 1, "")], "paper_id string, page int, text string"))
    r = {r.paper_id: json.loads(r.payload) for r in pipeline.nested(x).collect()}
    p = r["p"]
    assert [f["figure_number"] for f in p["figures"]] == ["2", "9"] and [e["equation_text"] for e in p["equations"]] == ["z = 1 (2)", "b = 2 (1)"]
    assert [m["normalized_formula"] for m in p["materials"]] == ["KBr", "LiF", "NaCl"] and [m["material_id"] for m in p["materials"]] == ["MAT_3", "MAT_1", "MAT_2"]
    assert [q["confidence"] for q in p["relations"]] == [0.95, 0.8, 0.25]
    assert r["q"]["materials"] == [] and r["q"]["filename"] == "q" and r["q"]["metadata"]["doi"] == "NONE"
