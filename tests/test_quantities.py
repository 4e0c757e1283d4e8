"""Quantities in different units."""

import numpy as np
import pandas as pd
import pytest

from ferrule.functions.units import unit
from ferrule.operators import quantities as q

KINDS = [("Activation_Energy", "eV"), ("Ionic_Conductivity", "S/cm"), ("Diffusion_Coefficient", "cm**2/s"), ("Melting_Point", "kelvin"), ("Specific_Capacity", "mAh/g"), ("Thermal_Conductivity", "W/m/K"), ("Voltage", "V"), ("Space_Group", None), ("Energy_Density", "Wh/kg")]
COLUMNS = "mention_id long, property_name string, raw_value string, value_numeric double, normalized_value string, unit string, sentence string, source_type string, val string"


@pytest.mark.parametrize(
    ("text", "value", "power"),
    [("2,79", 2.79, None), ("1,080", 1080, None), ("0,265", 0.265, None), ("12 345", 12345, None), ("1.57*10^1", 1.57, 1), ("1.34×10−7", 1.34, -7), ("2.15×102", 2.15, 2), ("3.3 × 10²", 3.3, 2), ("7 ×10⁻⁵ S", 7, -5), ("~ .348", 0.348, None), ("ca. 15.3", 15.3, None), ("0.233(2)", 0.233, None), ("0.3±0.01 eV", 0.3, None), ("3.39E+01", 3.39, 1), ("-4", -4, None), ("1,234.5", 1234.5, None), ("1.234,5", 1234.5, None)],
)
def test_numbers(text, value, power):
    m, p, _ = q.number(text)
    assert (m, p) == (value, power)


def test_no_number():
    assert q.number("Pnma") is None and q.number("") is None


@pytest.mark.parametrize(("a", "b", "ratio"), [("kJ/mol", "eV", 0.010364), ("kcal mol⁻¹", "eV", 0.043364), ("mS cm-1", "S/cm", 1e-3), ("square centimetres per second", "m2/s", 1e-4), ("W/(cm K)", "W/m/K", 100), ("mW/mK", "W/m/K", 1e-3), ("C/g", "mAh/g", 1 / 3.6), ("erg/cm2", "J/m**2", 1e-3), ("kbar", "GPa", 0.1), ("Ω m2", "ohm*cm**2", 1e4), ("µm2/s", "cm**2/s", 1e-8), ("millisiemens per centimetre", "S/cm", 1e-3), ("eV/Å2", "J/m**2", 16.0218)])
def test_units(a, b, ratio):
    x, y = unit(a), unit(b)
    assert x[2] == y[2] and x[0] / y[0] == pytest.approx(ratio, rel=1e-4)


def test_not_units():
    assert unit("converge") is None and unit("") is None and unit(None) is None and unit("10^-4") is None


def rows(spark, data):
    return spark.createDataFrame([(i, *d, "other") for i, d in enumerate(data)], COLUMNS)


def test_rows(spark):
    kinds = spark.createDataFrame(KINDS, "property_name string, common_unit string")
    data = [
        ("Activation_Energy", "('15.3', 'kJ mol^-1')", None, "junk", "NONE", None, "Text"),
        ("Ionic_Conductivity", "36.9 ×10⁻⁵ S cm⁻¹", 36.9, None, "×10⁻⁵ S cm⁻¹", None, "Text"),
        ("Diffusion_Coefficient", "28.8", None, None, "10−12 m2 s−1", None, "Text"),
        ("Melting_Point", "910", None, None, "", "It was found to be\n– 12 –\nSOLID ION LETTERS\n910 degrees Celsius here.", "Text"),
        ("Thermal_Conductivity", "0.5", None, None, None, "Table 3. Thermal conductivity (W/(m·K)) of all: A | 0.5", "Table"),
        ("Voltage", "2,44", None, None, "V vs Li/Li+", None, "Text"),
        ("Specific_Capacity", "51 mAh cm⁻²", None, None, None, None, "Text"),
        ("Energy_Density", "300", None, None, "Wh/L", None, "Text"),
        ("Space_Group", "Pnma", None, None, None, None, "Text"),
        ("Voltage", None, None, None, None, None, None),
        ("Voltage", "NONE", None, "3.1 V", "NONE", "", "Text"),
        ("Voltage", "", 2.5, None, "V", "", "Text"),
        (None, "1", 1.0, "1", "V", "1 V", "Text"),
        ("Voltage", "1e400", None, None, "V", None, "Text"),
    ]
    df = rows(spark, data)
    got = {r.mention_id: (r.val, r.common_unit) for r in q.in_common_units(df.union(df.limit(2)), kinds).collect()}
    assert got == {0: ("1.59e-01", "eV"), 1: ("3.69e-04", "S/cm"), 2: ("2.88e-07", "cm**2/s"), 3: ("1.18e+03", "kelvin"), 4: ("5.00e-01", "W/m/K"), 5: ("2.44e+00", "V"), 10: ("3.10e+00", "V"), 11: ("2.50e+00", "V")}


def test_empty(spark):
    kinds = spark.createDataFrame(KINDS, "property_name string, common_unit string")
    assert q.in_common_units(rows(spark, []), kinds).count() == 0


def test_model_held_out(sf):
    """Without the sentence, the ensemble is right about nine in ten of its sure predictions, and surer than that on average."""
    d = pd.read_parquet(sf.replace("sf0.001", "sf0.01") + "/mentions.parquet").drop_duplicates("mention_id")
    kinds = pd.read_parquet(f"{sf}/property_kinds.parquet").dropna(subset=["common_unit"])
    dims = {p: unit(u)[2] for p, u in zip(kinds.property_name, kinds.common_unit)}
    seen = []
    for p, raw, num, norm, u, s, src in d[d.property_name.isin(dims)][["property_name", "raw_value", "value_numeric", "normalized_value", "unit", "sentence", "source_type"]].itertuples(index=False, name=None):
        r = q.read(raw, u, num, s, norm, dims[p], always=True)
        if r.own is not None and r.bare is not None and p == "Activation_Energy":
            seen.append((r, src))
    model = q.UnitModel()
    cut = len(seen) * 2 // 3
    units = []
    y = []
    for r, _ in seen:
        k = next((i for i, u in enumerate(units) if q._same(u, r.own)), len(units))
        if k == len(units):
            units.append(r.own)
        y.append(k)
    model.classes["Activation_Energy"] = units
    x = np.array([model.features("Activation_Energy", r._replace(told=None), s) for r, s in seen])
    y = np.array(y)
    forest = q.Forest().fit(x[:cut], y[:cut], len(units))
    which, sure = forest.predict(x[cut:])
    right = which == y[cut:]
    confident = sure >= q.SURE
    assert right.mean() > 0.7 and confident.mean() > 0.2 and right[confident].mean() > 0.9


def test_masked_units(spark, sf):
    """The ensemble alone, with the stated unit and the sentence masked, on rows that it wasn't fitted on."""
    from ferrule.operators import quantities
    from ferrule.session import table

    s = quantities.masked_score(table(spark, sf.replace("sf0.001", "sf0.01"), "mentions"), table(spark, sf, "property_kinds"))
    assert s["rows"] > 1000 and s["right"] > 0.85 and s["sure"] > 0.6 and s["sure_right"] > 0.95 and abs(s["confidence"] - s["sure_right"]) < 0.04


def test_units_of_many_words():
    from ferrule.operators import quantities

    long = "kg" + " kg" * 30 + " and more"
    assert quantities._leading_unit(long, (0, 31, 0, 0, 0))[2] == (0, 31, 0, 0, 0)
