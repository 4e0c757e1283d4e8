"""A corpus of papers generated from the test tables by fixed templates, with what a reader finds in each of their sentences.

One paper per part: its key picks the material and the kind of paper, its size the numbers. Numbers are put together from
whole numbers, so their text is the same in every engine. ``LINES`` declares each line with its section, type and
sentences, and for each sentence the mentions and materials that it holds by the rules; the SQL twins rank, register and
link these by SQL of their own. Papers of kind 6 are empty; those of kind 7 hold one of ``EXAMPLES``, which cover the lexicon.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.lexicon import ENTRIES
from ferrule.session import table

MATERIALS = ("Li7La3Zr2O12", "LiFePO4", "Li6PS5Cl", "Na3PS4", "LiCoO2")
KINDS = 8
EMPTY, EXAMPLE = 6, 7
#: Elements of each formula that the corpus holds, by symbol.
ELEMENTS = {
    "Li7La3Zr2O12": "La:3 Li:7 O:12 Zr:2", "LiFePO4": "Fe:1 Li:1 O:4 P:1", "Li6PS5Cl": "Cl:1 Li:6 P:1 S:5", "Na3PS4": "Na:3 P:1 S:4", "LiCoO2": "Co:1 Li:1 O:2", "Li3InCl6·2H2O": "Cl:6 H:4 In:1 Li:3 O:2",
    "Li2S-P2S5": "Li:2 P:2 S:6", "Li1Mn0.1Co0.1Ni0.8O2": "Co:0.1 Li:1 Mn:0.1 Ni:0.8 O:2", "Li2O2": "Li:2 O:2",
}


class Mention(NamedTuple):
    """What a sentence states: property, value and unit, kind of activation energy, material. {…} are SQL expressions."""

    name: str
    value: str
    unit: str = "NONE"
    ea: str = "NONE"
    formula: str | None = None


class Line(NamedTuple):
    kinds: tuple[int, ...] | None  #: kinds of papers that have it, None for all but the empty ones
    page: int
    section: str
    type: str
    sentences: tuple[str, ...]
    mentions: tuple[tuple[int, Mention], ...] = ()
    materials: tuple[tuple[int, tuple[str, ...]], ...] = ()  #: by sentence, in the order in which they are registered


def _text(kinds, page, section, sentence, mentions=(), materials=()):
    return Line(kinds, page, section, "Text", (sentence,), tuple((0, m) for m in mentions), ((0, tuple(materials)),) if materials else ())


_EV = "{format('{:.4g} eV', s / 100.0)}"
_H, _A, _I, _R, _C, _REF = "Metadata/Header", "Abstract", "Introduction", "Results", "Conclusion", "References"
#: Templates; {k} the key, {s} the size, {v} the size in two digits, {m} key mod 5, {M} the material, {E} the example.
LINES: tuple[Line, ...] = (
    Line(None, 1, _H, "Text", ("Transport study number {k}",)),
    Line(None, 1, _A, "header", ("Abstract",)),
    _text(None, 1, _A, "We measured an activation energy of 0.{v} eV in {M}.", [Mention("Activation_Energy", _EV, "eV", "unspecified", "{M}")], ["{M}"]),
    Line(None, 1, _I, "header", ("1. Introduction",)),
    _text(None, 1, _I, "Previous literature reported a bulk activation energy of 0.{v} eV for {M}.", [Mention("Activation_Energy", _EV, "eV", "bulk", "{M}")], ["{M}"]),
    _text(None, 1, _I, "The identifier is 10.1234/part.{k} and it was Published 201{m}."),
    Line(None, 2, _R, "header", ("2. Results",)),
    _text(None, 2, _R, "The grain boundary activation energy of {M} was {s}0 meV.", [Mention("Activation_Energy", _EV, "eV", "grain boundary", "{M}")], ["{M}"]),
    _text(None, 2, _R, "An ionic conductivity of {s} mS/cm was obtained for {M}.", [Mention("Ionic_Conductivity", "{format('{:.4g} S/cm', s / 1000.0)}", "S/cm", "NONE", "{M}")], ["{M}"]),
    # the material linked is registered before the one that stands first; at equal distance the first one counts
    _text((1,), 2, _R, "LiCoO2 was cycled before Na3PS4 gave a voltage of 3.{m} V.", [Mention("Voltage", "{format('{:.4g} V', 3 + m / 10.0)}", "V", "NONE", "Na3PS4")], ["Na3PS4", "LiCoO2"]),
    _text((1,), 2, _R, "LiFePO4: voltage 2.{m} V for a sample LiCoO2.", [Mention("Voltage", "{format('{:.4g} V', 2 + m / 10.0)}", "V", "NONE", "LiFePO4")], ["LiFePO4", "LiCoO2"]),
    # seven values of one property
    *(_text((2,), 2, _R, f"An overpotential of 0.{i}{{m}} V was seen.", [Mention("Overpotential", f"{{format('{{:.4g}} V', 0.{i} + m / 100.0)}}", "V")]) for i in range(1, 8)),
    # five times the same relation, and the conclusion says so too
    *(_text((3,), 2, _R, "A porosity of {v} % in LiCoO2.", [Mention("Porosity", "{format('{:.2f} %', cast(s as double))}", "%", "NONE", "LiCoO2")], ["LiCoO2"]) for _ in range(5)),
    # crystal water, two phases, shorthand, a peroxide, acronyms
    _text((4,), 2, _R, "A band gap of 2.5 eV in Li3InCl6·2H2O.", [Mention("Band_Gap", "2.5 eV", "eV", "NONE", "Li3InCl6·2H2O")], ["Li3InCl6·2H2O"]),
    _text((4,), 2, _R, "A migration barrier of 300 meV was computed for Li2S-P2S5 and NMC811.", [Mention("Migration_Barrier", "0.3 eV", "eV", "unspecified", "Li2S-P2S5")], ["Li2S-P2S5", "Li1Mn0.1Co0.1Ni0.8O2"]),
    _text((4,), 2, _R, "The bulk modulus of LLZO was 150 GPa.", [Mention("Bulk_Modulus", "150 GPa", "GPa", "NONE", "Li7La3Zr2O12")], ["Li7La3Zr2O12"]),
    _text((4,), 2, _R, "Li2O2 had a density of 2.3 g/cm3.", [Mention("Density", "2.3 g/cm**3", "g/cm**3", "NONE", "Li2O2")], ["Li2O2"]),
    _text((4,), 2, _R, "KNN and DFT gave a porosity of 3 %.", [Mention("Porosity", "3.00 %", "%")]),
    # superscripts, an uncertainty, a range, bounds, a unit of another dimension, no unit, an offset, two kinds in one sentence
    _text((5,), 2, _R, "An ionic conductivity of 1.2×10⁻³ S/cm in Na3PS4.", [Mention("Ionic_Conductivity", "0.0012 S/cm", "S/cm", "NONE", "Na3PS4")], ["Na3PS4"]),
    _text((5,), 2, _R, "The migration barrier is 216±31 meV.", [Mention("Migration_Barrier", "0.216 eV", "eV", "unspecified")]),
    _text((5,), 2, _R, "A hopping barrier of 0.2-0.3 eV.", [Mention("Migration_Barrier", "0.3 eV", "eV", "unspecified")]),
    _text((5,), 2, _R, "A formation energy of 11 eV was ruled out."),
    _text((5,), 2, _R, "A binding energy of 10 eV stays.", [Mention("Binding_Energy", "10 eV", "eV")]),
    _text((5,), 2, _R, "An adsorption energy of 50 kJ/mol in Na3PS4.", [Mention("Adsorption_Energy", "50 kJ/mol", "kJ/mol", "NONE", "Na3PS4")], ["Na3PS4"]),
    _text((5,), 2, _R, "The reaction energy was 3 furlong."),
    _text((5,), 2, _R, "The melting point is 180 °C.", [Mention("Melting_Point", "453.1 kelvin", "kelvin")]),
    _text((5,), 2, _R, "Both bulk Ea of 0.3 eV and surface Ea of 0.5 eV hold.", [Mention("Activation_Energy", "0.3 eV", "eV", "bulk"), Mention("Activation_Energy", "0.5 eV", "eV", "surface")]),
    _text((EXAMPLE,), 2, _R, "{E}"),
    Line(None, 2, _R, "Caption", ("Figure 1.", "Ionic conductivity of {M} from EIS, see Table 2 and Eq. 3."), ((1, Mention("Technique", "EIS", "NONE", "NONE", "{M}")),), ((1, ("{M}",)),)),
    # six materials and seven tables: lists of a figure are whole
    Line((4,), 2, _R, "Caption", ("Fig. 2.", "LiF, LiCl, LiBr, NaF, NaCl and NaBr, see Tables 1 and Table 3, Table 4, Table 5, Table 6, Table 7 and Table 8."), (), ()),
    Line(None, 2, _R, "EquationCandidate", ("sigma = A exp(x) (1)",)),
    _text(None, 2, _R, "The band gap was {m}.{v} eV with VASP and PBE.", [Mention("Band_Gap", "{format('{:.4g} eV', m + s / 100.0)}", "eV"), Mention("Software", "VASP"), Mention("Functional", "PBE")]),
    Line(None, 2, _C, "header", ("Conclusion",)),
    _text(None, 2, _C, "The discharge capacity reached 1{v} mAh/g at the end.", [Mention("Capacity", "{format('{:.4g} mAh/g', 100.0 + s)}", "mAh/g")]),
    _text((3,), 2, _C, "The porosity was {v} % in all.", [Mention("Porosity", "{format('{:.2f} %', cast(s as double))}", "%")]),
    Line(None, 3, _REF, "header", ("References",)),
    Line(None, 3, _REF, "reference", ("[1] First entry of paper {k}",)),
    Line(None, 3, _REF, "reference", ("continued here",)),
    Line(None, 3, _REF, "reference", ("[2] Second entry",)),
)
EXAMPLE_LINE = next(i for i, x in enumerate(LINES) if x.sentences == ("{E}",))


def _e(text: str, *found: tuple) -> tuple[str, tuple[Mention, ...]]:
    return text, tuple(Mention(*f) for f in found)


#: Sentences with all that they state; together they hold every property that a sentence can state.
EXAMPLES: tuple[tuple[str, tuple[Mention, ...]], ...] = (
    _e("The apparent activation energy here was 0.35 eV.", ("Activation_Energy", "0.35 eV", "eV", "unspecified")), _e("Its percolation barrier is 250 meV.", ("Migration_Barrier", "0.25 eV", "eV", "unspecified")), _e("A diffusion coefficient of 1.2×10-8 cm2/s holds.", ("Diffusion_Coefficient", "1.2e-08 cm**2/s", "cm**2/s")),
    _e("Total conductivity of 3 mS/cm.", ("Ionic_Conductivity", "0.003 S/cm", "S/cm")), _e("Electronic conductivity of 4 uS/cm.", ("Electronic_Conductivity", "4e-06 S/cm", "S/cm")), _e("Redox potential of 1.1 V.", ("Redox_Potential", "1.1 V", "V")), _e("An electrochemical stability window of 5 V.", ("Stability_Window", "5 V", "V")),
    _e("An average voltage of 3700 mV.", ("Voltage", "3.7 V", "V")), _e("An overpotential of 30 mV.", ("Overpotential", "0.03 V", "V")), _e("Areal capacity of 3 mAh/cm2.", ("Capacity", "3 mAh/cm**2", "mAh/cm**2")), _e("The specific capacity was 150 Ah/kg.", ("Capacity", "150 mAh/g", "mAh/g"), ("Specific_Capacity", "150 mAh/g", "mAh/g")),
    _e("Initial discharge capacity: 160 mAh/g.", ("Capacity", "160 mAh/g", "mAh/g"), ("Initial_Capacity", "160 mAh/g", "mAh/g")), _e("An energy density of 1 kWh/kg.", ("Energy_Density", "1000 Wh/kg", "Wh/kg")), _e("An energy density of 500 Wh/L.", ("Energy_Density", "500 Wh/L", "Wh/L")), _e("A power density of 2 kW/kg.", ("Power_Density", "2000 W/kg", "W/kg")),
    _e("A current density of 1 A/cm2.", ("Current_Density", "1000 mA/cm**2", "mA/cm**2")), _e("The critical current density is 2 mA/cm2.", ("Current_Density", "2 mA/cm**2", "mA/cm**2"), ("Critical_Current_Density", "2 mA/cm**2", "mA/cm**2")), _e("A cycle life of 500 cycles.", ("Cycle_Life", "500")), _e("Capacity retention of 95.5 %.", ("Capacity_Retention", "95.50 %", "%")),
    _e("Coulombic efficiency near 99 percent.", ("Coulombic_Efficiency", "99.00 %", "%")), _e("Rate capability up to 5 C.", ("Rate_Capability", "5")), _e("It ran at 2 C for days.", ("C_Rate", "2")), _e("An interfacial resistance of 12 Ω cm2.", ("Interfacial_Resistance", "12 ohm*cm**2", "ohm*cm**2")),
    _e("A formation energy of -1.5 eV/atom.", ("Formation_Energy", "-1.5 eV", "eV")), _e("Energy above the hull: 20 meV/atom.", ("Energy_Above_Hull", "0.02 eV", "eV")), _e("A reaction energy of 0.4 eV.", ("Reaction_Energy", "0.4 eV", "eV")), _e("A surface energy of 0.1 eV/Å2.", ("Surface_Energy", "1.602 J/m**2", "J/m**2")),
    _e("The vacancy formation energy is 2 eV.", ("Formation_Energy", "2 eV", "eV"), ("Vacancy_Formation_Energy", "2 eV", "eV")), _e("Binding energy 0.9 eV.", ("Binding_Energy", "0.9 eV", "eV")), _e("Adsorption energy 0.7 eV.", ("Adsorption_Energy", "0.7 eV", "eV")), _e("Bulk modulus of 1500 MPa.", ("Bulk_Modulus", "1.5 GPa", "GPa")),
    _e("Young's modulus of 70 GPa.", ("Young_Modulus", "70 GPa", "GPa")), _e("A shear modulus of 30 GPa.", ("Shear_Modulus", "30 GPa", "GPa")), _e("Poisson's ratio of 0.28.", ("Poisson_Ratio", "0.28")), _e("Lattice parameter a of 1.2 nm.", ("Lattice_Parameter_a", "12 angstrom", "angstrom")), _e("Lattice constant c = 1300 pm.", ("Lattice_Parameter_c", "13 angstrom", "angstrom")),
    _e("A unit cell volume of 2 nm3.", ("Cell_Volume", "2000 angstrom**3", "angstrom**3")), _e("A mass density of 5000 kg/m3.", ("Density", "5 g/cm**3", "g/cm**3")), _e("It has space group Ia-3d at rest.", ("Space_Group", "Ia-3d")), _e("A tetragonal phase.", ("Crystal_System", "tetragonal")), _e("A grain size of 2 um.", ("Grain_Size", "2e+04 angstrom", "angstrom")),
    _e("A particle size of 30 nm.", ("Particle_Size", "300 angstrom", "angstrom")), _e("A porosity of 12 percent.", ("Porosity", "12.00 %", "%")), _e("Its relative density was 97 %.", ("Relative_Density", "97.00 %", "%")), _e("A bandgap of 5.4 eV.", ("Band_Gap", "5.4 eV", "eV")), _e("A Bader charge of 0.8 e per site.", ("Bader_Charge", "0.8")),
    _e("The density of states is flat.", ("DOS_Mentioned", "density of states")), _e("See the PDOS.", ("PDOS_Mentioned", "PDOS")), _e("The COHP is given.", ("COHP_Mentioned", "COHP")), _e("An activation temperature of 600 K.", ("Activation_Temperature", "600 kelvin", "kelvin")), _e("A melting point of 700 K.", ("Melting_Point", "700 kelvin", "kelvin")),
    _e("Glass transition temperature Tg of 200 °C.", ("Glass_Transition_Temperature", "473.1 kelvin", "kelvin")), _e("A Debye temperature of 400 K.", ("Debye_Temperature", "400 kelvin", "kelvin")), _e("A thermal conductivity of 1.5 W/mK.", ("Thermal_Conductivity", "1.5 W/m/K", "W/m/K")), _e("The thermal expansion coefficient is 9 ppm/K.", ("Thermal_Expansion_Coefficient", "9")),
    _e("Raman shift at 612 cm-1.", ("Raman_Peak", "612 cm**-1", "cm**-1"), ("Technique", "Raman")), _e("FTIR at 900 cm-1.", ("FTIR_Peak", "900 cm**-1", "cm**-1"), ("Technique", "FTIR")), _e("An XRD peak at 25.1 °.", ("XRD_Peak", "25.1 degree", "degree"), ("Technique", "XRD")), _e("All in CASTEP.", ("Software", "CASTEP")), _e("Code version 6.3 is meant.", ("Version", "6.3")),
    _e("HSE06 throughout.", ("Functional", "HSE06"), ("Hybrid_Functional", "HSE06")), _e("A Hubbard U of 4 eV.", ("Hubbard_U", "4 eV", "eV")), _e("A cutoff energy of 520 eV.", ("Cutoff_Energy", "520 eV", "eV")), _e("With ecutwfc 40 Ry.", ("Ecutwfc", "544.2 eV", "eV")), _e("With ecutrho 30 Ry.", ("Ecutrho", "408.2 eV", "eV")), _e("The PAW method.", ("Pseudopotential", "PAW")),
    _e("A k-point mesh of 4×4×4.", ("Kpoint_Mesh", "4×4×4")), _e("SCF convergence of 0.001 eV.", ("SCF_Convergence", "0.001 eV", "eV")), _e("A full relaxation.", ("Relaxation_Type", "full relaxation")), _e("By NEB paths.", ("NEB", "NEB")), _e("Spin-polarized runs.", ("Spin_Polarization", "Spin-polarized")), _e("With spin-orbit coupling.", ("SOC", "spin-orbit coupling")),
    _e("With DFT-D3 added.", ("Dispersion_Correction", "DFT-D3")), _e("SCAN is used.", ("Functional", "SCAN"), ("Meta_GGA", "SCAN")), _e("A supercell of 2×2×1.", ("Supercell_Size", "2×2×1"), ("Supercell", "2×2×1")), _e("A vacancy concentration of 2 %.", ("Vacancy_Concentration", "2.00 %", "%")), _e("A pressure of 10 bar.", ("Pressure", "0.001 GPa", "GPa")), _e("A simulation time of 2 ns.", ("Simulation_Time", "2000 ps", "ps")),
    _e("A time step of 2 fs.", ("Timestep", "0.002 ps", "ps")), _e("In the NVT ensemble.", ("Ensemble", "NVT")), _e("Trajectories of 100 ps.", ("Trajectory_Length", "100 ps", "ps")), _e("From the mean squared displacement.", ("MSD_Mentioned", "mean squared displacement")), _e("A random forest did it.", ("Algorithm", "random forest")), _e("The SOAP kernel.", ("Descriptor", "SOAP")),
    _e("A training set of 800 samples.", ("Training_Size", "800")), _e("A validation set of 100.", ("Validation_Size", "100")), _e("A test set of 90 structures.", ("Test_Size", "90")), _e("By 5-fold cross-validation.", ("Cross_Validation", "5")), _e("An accuracy of 93 %.", ("Accuracy", "93.00 %", "%")), _e("A precision of 91 %.", ("Precision", "91.00 %", "%")), _e("A recall of 88 %.", ("Recall", "88.00 %", "%")),
    _e("An F1 score of 0.9.", ("F1_Score", "0.9")), _e("The MAE of 0.03.", ("MAE", "0.03")), _e("The RMSE of 0.05.", ("RMSE", "0.05")), _e("An R2 of 0.97.", ("R2", "0.97")), _e("The AUC of 0.8.", ("ROC_AUC", "0.8")), _e("Read by SHAP.", ("Explainability_Method", "SHAP")), _e("Made by ball milling.", ("Method", "ball milling")), _e("It was sintered at 1100 °C.", ("SYNTHESIS|Temperature", "1373 kelvin", "kelvin")),
    _e("It was held for 2 h."), _e("Under argon gas.", ("Atmosphere", "argon")), _e("Seen by SEM alone.", ("Technique", "SEM")),
)


def entry_of(name: str) -> int:
    """The place of a property in the lexicon, by its name or by category|name."""
    return next(i for i, e in enumerate(ENTRIES) if name in (e.name, f"{e.category}|{e.name}"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_text(template: str) -> str:
    """A template as SQL over the columns of :func:`part_sql`."""
    for key, column in {"{k}": "cast(k as varchar)", "{s}": "cast(s as varchar)", "{v}": "v", "{m}": "cast(m as varchar)", "{M}": "mat", "{E}": "example"}.items():
        template = template.replace(key, f"\0{column}\0")
    return " || ".join(_quoted(x) if i % 2 == 0 else x for i, x in enumerate(template.split("\0")) if x or i % 2)


def sql_value(value: str | None) -> str:
    """A declared value or formula as SQL."""
    if value is None:
        return "null"
    return "mat" if value == "{M}" else value[1:-1] if value.startswith("{") else _quoted(value)


def part_sql() -> str:
    """The generating columns of each paper."""
    mat = "case p_partkey % 5 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(MATERIALS)) + " end"
    examples = "[" + ", ".join(_quoted(t) for t, _ in EXAMPLES) + "]"
    return f"(select 'P' || lpad(cast(p_partkey as varchar), 8, '0') as paper_id, {mat} as mat, p_partkey as k, p_size as s, lpad(cast(p_size as varchar), 2, '0') as v, p_partkey % 5 as m, p_partkey % {KINDS} as kind, (p_partkey // {KINDS}) % {len(EXAMPLES)} as ex, {examples}[(p_partkey // {KINDS}) % {len(EXAMPLES)} + 1] as example from part)"


def _where(line: Line) -> str:
    return f"kind <> {EMPTY}" if line.kinds is None else f"kind in ({', '.join(map(str, line.kinds))})"


def lines_sql() -> str:
    """(paper_id, page, no, line, section, type) of every line."""
    return " union all ".join(f"select paper_id, {x.page} as page, {n} as no, {sql_text(' '.join(x.sentences))} as line, '{x.section}' as section, '{x.type}' as type from {part_sql()} where {_where(x)}" for n, x in enumerate(LINES))


def sentences_sql() -> str:
    """(paper_id, page, no, sn, section, type, sentence) of every sentence of texts and captions."""
    return " union all ".join(f"select paper_id, {x.page} as page, {n} as no, {i} as sn, '{x.section}' as section, '{x.type}' as type, {sql_text(t)} as sentence from {part_sql()} where {_where(x)}" for n, x in enumerate(LINES) if x.type in ("Text", "Caption") for i, t in enumerate(x.sentences))


def _mention(m: Mention) -> str:
    i = entry_of(m.name)
    return f"{i} as pi, '{ENTRIES[i].category}' as category, '{ENTRIES[i].name}' as property_name, {sql_value(m.value)} as value, {_quoted(m.unit)} as unit, '{m.ea}' as ea_type, {sql_value(m.formula)} as formula"


def mentions_sql() -> str:
    """(paper_id, no, sn, mn, pi, category, property_name, value, unit, ea_type, formula) of every mention declared."""
    rows = [f"select paper_id, {n} as no, {i} as sn, {k} as mn, {_mention(m)} from {part_sql()} where {_where(x)}" for n, x in enumerate(LINES) for k, (i, m) in enumerate(x.mentions)]
    rows += [f"select paper_id, {EXAMPLE_LINE}, 0, {k}, {_mention(m)} from {part_sql()} where kind = {EXAMPLE} and ex = {x}" for x, (_, ms) in enumerate(EXAMPLES) for k, m in enumerate(ms)]
    return " union all ".join(rows)


def materials_sql() -> str:
    """(paper_id, no, sn, pos, formula) of every material of a sentence that holds a mention."""
    return " union all ".join(f"select paper_id, {n} as no, {i} as sn, {k} as pos, {sql_value(f)} as formula from {part_sql()} where {_where(x)}" for n, x in enumerate(LINES) for i, fs in x.materials for k, f in enumerate(fs))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, page, text) of the generated papers: one projection of the part table, no shuffle."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    of = lambda xs, i: F.element_at(F.array(*(F.lit(x) for x in xs)), (i + 1).cast("int"))
    key, kind = F.col("p_partkey"), F.col("p_partkey") % KINDS
    example = of([t for t, _ in EXAMPLES], F.floor(key / KINDS) % len(EXAMPLES))
    values = {"{k}": key.cast("string"), "{s}": F.col("p_size").cast("string"), "{v}": F.lpad(F.col("p_size").cast("string"), 2, "0"), "{m}": (key % 5).cast("string"), "{M}": of(MATERIALS, key % 5), "{E}": example}

    def filled(line: Line):
        template = " ".join(line.sentences)
        c = F.lit(template)
        for name, value in values.items():
            if name in template:
                c = F.replace(c, F.lit(name), value)
        return F.when(kind != EMPTY if line.kinds is None else kind.isin(*line.kinds), c)

    page = F.array(*(F.struct(F.lit(p).alias("page"), F.concat_ws("\n", *(filled(x) for x in LINES if x.page == p)).alias("text")) for p in (1, 2, 3)))
    return part.select(F.concat(F.lit("P"), F.lpad(key.cast("string"), 8, "0")).alias("paper_id"), F.inline(page))
