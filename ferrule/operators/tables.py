"""From grids of cells to property values: headers, rows, captions, and the table path of extraction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.formulas import find_materials
from ferrule.functions.lexicon import ENTRIES
from ferrule.functions.numbers import numbers
from ferrule.functions.text import BLANKS, nfkc
from ferrule.functions.wording import any_of
from ferrule.operators.extract import EA_PROPERTIES, ea_type, materials_in, normal_text

NONE = "NONE"
# What a column's header names, longest wording first; and the headers of material columns.
HEADERS = (
    ("ionic conductivity", "Ionic_Conductivity"), ("electronic conductivity", "Electronic_Conductivity"), ("conductivity", "Ionic_Conductivity"), ("activation energy", "Activation_Energy"), ("migration barrier", "Migration_Barrier"),
    ("diffusion coefficient", "Diffusion_Coefficient"), ("diffusivity", "Diffusion_Coefficient"), ("capacity retention", "Capacity_Retention"), ("specific capacity", "Specific_Capacity"), ("capacity", "Capacity"),
    ("coulombic efficiency", "Coulombic_Efficiency"), ("voltage", "Voltage"), ("energy density", "Energy_Density"), ("power density", "Power_Density"), ("current density", "Current_Density"), ("band gap", "Band_Gap"),
    ("formation energy", "Formation_Energy"), ("bulk modulus", "Bulk_Modulus"), ("young's modulus", "Young_Modulus"), ("cell volume", "Cell_Volume"), ("density", "Density"), ("space group", "Space_Group"), ("crystal system", "Crystal_System"),
    ("grain size", "Grain_Size"), ("particle size", "Particle_Size"), ("porosity", "Porosity"), ("melting point", "Melting_Point"), ("thermal conductivity", "Thermal_Conductivity"), ("cutoff energy", "Cutoff_Energy"), ("temperature", "Temperature"),
)
CATEGORY_OF = {"Temperature": "AIMD"}
MATERIAL_HEADERS = ("material", "materials", "sample", "composition", "compound", "electrolyte")
CONFIDENCE = {"material": 0.85, "field": 0.9, "relation": 0.95}
_ENTRY = {e.name: e for e in ENTRIES if e.category == CATEGORY_OF.get(e.name, e.category)}


#: A header that begins with the symbol of an activation energy.
_EA_HEADER = rf"(?i)^\s*{any_of(('E~(_)~a',))}\b"
#: What may follow a number in a cell as its unit.
_CELL_UNIT = re.compile(r"\s*([A-Za-zΩ°μ%][\w/.^%°μΩ⁻−-]*)")


def cleaned(grids: DataFrame) -> DataFrame:
    """Grids whose cells are composed for compatibility, on one line and trimmed, null cells empty. Grids without a row or
    whose first row is empty are left out."""

    def clean(c: Column) -> Column:
        return F.btrim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(BLANKS))

    # one string a grid goes through Python, and only where it holds other characters than ASCII
    flat = F.to_json("cells")
    other = F.when(flat.rlike(r"[^\x00-\x7F]"), flat)
    cells = F.coalesce(F.from_json(nfkc(other), "array<array<string>>"), F.col("cells"))
    g = grids.where("size(cells) > 0 and size(cells[0]) > 0").withColumn("cells", cells)
    return g.withColumn("cells", F.transform("cells", lambda r: F.transform(r, clean)))


def header_row(first: Column) -> Column:
    """Names of a grid's columns: merged (empty) header cells take the name before them, 'Column' at the start; repeats get _2, _3."""
    filled = F.aggregate(first, F.array().cast("array<string>"), lambda acc, c: F.concat(acc, F.array(F.when(c != "", c).otherwise(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("Column"))))))
    return F.transform(filled, lambda c, i: F.when(F.size(F.filter(F.slice(filled, 1, i + 1), lambda x: x == c)) == 1, c).otherwise(F.concat(c, F.lit("_"), F.size(F.filter(F.slice(filled, 1, i + 1), lambda x: x == c)).cast("string"))))


def headed(grids: DataFrame) -> DataFrame:
    """Grids (paper_id, page, t_idx, cells) cleaned, with ``headers``, ``material_column`` (null if none) and ``props``, for each
    header the property that it names and the last unit in brackets in it."""
    g = cleaned(grids).withColumn("headers", header_row(F.element_at("cells", 1)))
    named = F.filter("headers", lambda h: F.lower(h).isin(*MATERIAL_HEADERS))
    props = F.transform("headers", lambda h: F.struct(property_of(h).alias("p"), F.try_element_at(F.regexp_extract_all(h, F.lit(r"\(([^)]+)\)"), F.lit(1)), F.lit(-1)).alias("u")))
    return g.withColumns({"material_column": F.try_element_at(named, F.lit(1)), "props": props})


def rows(headed_grids: DataFrame) -> DataFrame:
    """(paper_id, page, t_idx, row_no, headers, material_column, props, row): each data row that isn't empty as a map of header to
    cell; cells beyond the headers are Column_i, counted from 0 (with a + where a header has that name)."""
    r = _data_rows(headed_grids, "headers", "material_column", "props")
    name = lambda i: F.concat(F.lit("Column_"), i.cast("string"))
    pairs = F.transform("cs", lambda c, i: F.struct(F.coalesce(F.try_element_at(F.col("headers"), i + 1), F.concat(name(i), F.when(F.array_contains("headers", name(i)), "+").otherwise(""))).alias("k"), c.alias("v")))
    return r.withColumn("row", F.map_from_entries(pairs)).drop("cs")


def _data_rows(grids: DataFrame, *columns: str | Column) -> DataFrame:
    """The data rows of each grid that aren't empty, as their cells ``cs``."""
    r = grids.select("paper_id", "page", "t_idx", *columns, F.posexplode(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(1)))).alias("row_no", "cs"))
    return r.where(F.exists("cs", lambda c: c != ""))


def _material_cell() -> Column:
    """The cell of a row in the material column, empty if there is none."""
    return F.coalesce(F.get("cs", F.array_position("headers", F.col("material_column")).cast("int") - 1), F.lit(""))


def captioned(grids: DataFrame, captions: DataFrame) -> DataFrame:
    """Grids with ``caption`` and ``table_number``: the table caption of their page whose number is their ordinal, else the page's first."""
    of = captions.where("ref_kind = 'Table'").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("block_no", F.col("page").alias("on"), "text", "ref_number"))).alias("captions"))
    # a paper's captions are joined as one list, by paper alone
    g = grids.join(of, "paper_id", "left")
    g = g.withColumn("captions", F.filter("captions", lambda c: c["on"] == F.col("page")))
    exact = F.get(F.filter("captions", lambda c: c["ref_number"].cast("int") == F.col("t_idx")), F.lit(0))["text"]
    g = g.withColumns({"first": F.get("captions", F.lit(0)), "exact": exact})
    number = F.when(F.col("exact").isNotNull(), F.col("t_idx").cast("string")).otherwise(F.coalesce("first.ref_number", F.col("t_idx").cast("string")))
    return g.withColumns({"caption": F.coalesce("exact", "first.text", F.lit(NONE)), "table_number": number}).drop("captions", "exact", "first")


def property_of(header: Column) -> Column:
    """The property that a header names, null if none; a header that begins like E_a is an activation energy."""
    low = F.lower(header)
    c = F.when(header.rlike(_EA_HEADER), "Activation_Energy")
    for wording, name in sorted(HEADERS, key=lambda x: -len(x[0])):
        c = c.when(low.contains(wording), name)
    return c


def read_cell(cell: str, bracket: str | None, kind: str) -> str:
    """The normalised value that begins a cell, with the unit of the cell or else the one given; NONE if there is none."""
    n = next(iter(numbers(cell)), None)
    if n is None or n.start:
        return NONE
    unit = next((u[1] for u in (_CELL_UNIT.match(cell, e) for e in (n.past, n.end)) if u), None)
    return normal_text(n.text, unit or (bracket or "").strip(), kind)


def _each(read: Callable[..., str | None], *columns: pa.Array) -> pa.Array:
    """``read`` of each row's texts; equal ones are read once."""
    codes = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        e = c.dictionary_encode(null_encoding="encode")
        codes = codes * max(1, len(e.dictionary)) + e.indices.to_numpy(zero_copy_only=False)
    _, first, at = np.unique(codes, return_index=True, return_inverse=True)
    rows = zip(*(c.take(pa.array(first)).to_pylist() for c in columns))
    return pa.array([read(*r) for r in rows], pa.string()).take(pa.array(at.ravel()))


def _formula(text: str) -> str | None:
    return next((m.formula for m in find_materials(text)), None)


def _energy(text: str | None) -> str | None:
    """The kind of activation energy that a text names first, null if none."""
    kind = ea_type(text or "")
    return None if kind == "unspecified" else kind


def _read_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells that hold a value, with ``normalized_value``, ``formula`` and ``ea_type``: of an activation energy as its header names
    it, else the row's other cells, else the caption; NONE for other properties."""
    for b in batches:
        value = _each(read_cell, b["cell"], b["bracket"], b["kind"])
        held = pc.not_equal(value, NONE)
        b, value = b.filter(held), value.filter(held)
        energy = pc.is_in(b["property_name"].cast(pa.string()), pa.array(EA_PROPERTIES))
        # the texts of other properties aren't read for a type
        typed = [_each(_energy, pc.if_else(energy, b[c], None)) for c in ("header", "row_text", "caption")]
        kind = pc.if_else(energy, pc.coalesce(*typed, pa.scalar("unspecified")), NONE)
        yield pa.RecordBatch.from_arrays([*b.columns, value, _each(_formula, b["material_cell"]), kind], names=[*b.schema.names, *_READ])


_READ = ("normalized_value", "formula", "ea_type")


def table_mentions(table_rows: DataFrame) -> DataFrame:
    """(…, row_no, col_no, property_name, category, raw_value, normalized_value, unit, confidence, formula, extraction_method):
    the value that begins each property cell, with the unit of the cell or else the last one in brackets in its header,
    linked to the first material of the row's material cell."""
    # what a row's cells are named by, in the order of its headers
    cs = F.transform("headers", lambda h: F.element_at(F.col("row"), h))
    r = table_rows.select("paper_id", "page", "t_idx", "row_no", F.lit(NONE).alias("caption"), "headers", "material_column", "props", cs.alias("cs"))
    return _mentions(r).drop("caption", "ea_type")


def _mentions(data_rows: DataFrame) -> DataFrame:
    """:func:`table_mentions` of rows given as their cells ``cs``, with ``caption`` and ``ea_type``."""
    kept = [c for c in data_rows.columns if c not in ("headers", "material_column", "props", "cs")]
    others = F.filter(F.arrays_zip("headers", "props", "cs"), lambda x: x["headers"].isNotNull() & x["props"]["p"].isNull())
    cells = F.transform("headers", lambda h, i: F.struct(i.alias("col_no"), h.alias("header"), F.get("props", i)["p"].alias("property_name"), F.get("props", i)["u"].alias("bracket"), F.get("cs", i).alias("cell")))
    wanted = F.filter(cells, lambda c: c["property_name"].isNotNull() & (c["cell"] != "") & ~F.equal_null(c["header"], F.col("material_column")))
    c = data_rows.select(*kept, _material_cell().alias("material_cell"), F.array_join(F.transform(others, lambda x: x["cs"]), " ").alias("row_text"), F.inline(wanted))
    names = sorted({n for _, n in HEADERS})
    kinds, cats = (F.create_map(*(F.lit(x) for n in names for x in (n, getattr(_ENTRY[n], f)))) for f in ("kind", "category"))
    c = c.withColumns({"kind": F.element_at(kinds, F.col("property_name")), "category": F.element_at(cats, F.col("property_name"))})
    # by batches that Python passes on: Spark would keep the rows of a column's function, on disk if need be, until its answer comes
    c = c.mapInArrow(_read_cells, T.StructType([*c.schema.fields, *(T.StructField(f, T.StringType()) for f in _READ)]))
    unit = F.coalesce(F.nullif(F.regexp_extract("normalized_value", r"^\S+ (.+)$", 1), F.lit("")), F.lit(NONE))
    return c.select(*kept, "col_no", "header", "row_text", "category", "property_name", F.col("cell").alias("raw_value"), "normalized_value", unit.alias("unit"), F.lit(CONFIDENCE["field"]).alias("confidence"), "formula", F.when(F.col("formula").isNotNull(), "table_row").alias("extraction_method"), "ea_type")


#: Blocks of tables come after those of the text.
TABLES_FROM = 1_000_000


def _block(page: str = "page", t_idx: str = "t_idx") -> Column:
    return (F.lit(TABLES_FROM) + F.col(page) * 1000 + F.col(t_idx)).cast("int")


def linked(captioned_grids: DataFrame) -> DataFrame:
    """The mentions of captioned grids in the columns of :func:`ferrule.operators.extract.mentions`: in Results, after all
    text, their caption as sentence. An activation energy is typed by its header, else the row's other cells, else the caption."""
    m = _mentions(_data_rows(captioned_grids, "headers", "material_column", "props", "caption"))
    index = F.create_map(*(F.lit(v) for i, e in enumerate(ENTRIES) for v in (f"{e.category}|{e.name}", i)))
    return m.select(
        "paper_id", _block().alias("block_no"), "page", F.lit("Table").alias("type"), F.lit("Results").alias("section"), F.col("row_no").alias("sent_no"), F.col("caption").alias("sentence"), F.lit(CONFIDENCE["field"]).alias("score"),
        F.col("col_no").alias("prop_idx"), F.element_at(index, F.concat_ws("|", "category", "property_name")).alias("match_no"), "raw_value", "category", "property_name", "normalized_value", "ea_type", "unit", "confidence",
        F.lit("Table").alias("source_type"), "formula", "extraction_method",
    )


def brought_up(captioned_grids: DataFrame) -> DataFrame:
    """The first material of each row's material cell, in the columns of :func:`ferrule.operators.extract.brought_up`; it
    counts whether or not the row has a property."""
    r = _data_rows(captioned_grids.where("material_column is not null"), "headers", "material_column").select("paper_id", "page", "t_idx", "row_no", _material_cell().alias("cell"))
    r = r.select("paper_id", "page", "t_idx", "row_no", F.try_element_at(materials_in("cell"), F.lit(1)).alias("m")).where("m is not null")
    return r.select("paper_id", F.struct(_block().alias("block_no"), F.col("row_no").alias("sent_no"), F.lit(0).alias("n")).alias("at"), *(F.col(f"m.{f}").alias(f) for f in ("formula", "raw", "elements", "alias")), F.lit(CONFIDENCE["material"]).alias("score"), F.col("page").cast("string").alias("page"), F.lit("Results").alias("section"), F.lit("Table").alias("type"))
