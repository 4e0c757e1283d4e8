"""The whole way from page text to the published tables, each stage a lazy DataFrame except where several stages read it."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.lexicon import CATEGORIES, ENTRIES
from ferrule.operators import annotate, extract, layout, rank, tables
from ferrule.session import bucketed, discard, stored, tidy, written

NONE = "NONE"
META = ("title", "authors", "journal", "creation_date", "doi", "publication_year")
# The properties that a report names for each paper.
HEADLINES = ("Activation_Energy", "Ionic_Conductivity", "Capacity", "Voltage", "Band_Gap", "Formation_Energy", "Bulk_Modulus", "Density")

# Papers of a bucket.
PAPERS = 3000


@dataclass
class Extracted:
    """The stages of one extraction."""

    pages: DataFrame
    typed: DataFrame
    blocks: DataFrame
    sentences: DataFrame
    linked: DataFrame
    materials: DataFrame
    grids: DataFrame | None = None
    info: DataFrame | None = None
    parts: int | None = None  #: buckets of papers in which the stages are written, see :func:`run_by_paper`

    @cached_property
    def ranked(self) -> DataFrame:
        return rank.ranked(self.linked)

    @cached_property
    def relations(self) -> DataFrame:
        return rank.relations(self.linked)

    @cached_property
    def registry(self) -> DataFrame:
        return extract.registry(self.materials)

    def settled(self) -> Extracted:
        """The same with registry, ranks and relations written once, for what reads them several times over."""
        x = replace(self)
        if self.parts:  # ranks and relations need no shuffle, so they are cheaper worked out than kept
            x.__dict__ |= {"registry": bucketed(self.registry, "registry", self.parts)}
            return x
        x.__dict__ |= {"ranked": written(self.ranked, "ranked"), "relations": written(self.relations, "relations"), "registry": written(self.registry, "registry")}
        return x


def run(pages: DataFrame, categories: tuple[str, ...] = CATEGORIES, grids: DataFrame | None = None, info: DataFrame | None = None) -> Extracted:
    """Extract from (paper_id, page, text) and, where given, cell grids (paper_id, page, t_idx, cells), whose mentions stand
    with those of the text, and ``info`` (paper_id, title, authors, journal, creation_date). Blocks and the sentences that
    hold mentions are read by several tables, so both are written once, in the shared folder."""
    typed = layout.typed_lines(layout.lines(pages))
    blocks = written(layout.blocks(typed), "blocks")
    sentences = extract.sentences(blocks)
    # few bytes but much work a sentence, so adaptive execution must not put them into few tasks
    spark = pages.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    read = written(extract.with_mentions(sentences.repartition(tasks, "paper_id", "block_no"), categories), "read")
    linked, materials = extract.mentions(read), extract.brought_up(read)
    if grids is not None:
        grids = written(tables.captioned(tables.headed(grids), blocks), "grids")
        # cells are read once, however many tables their mentions are in
        linked = linked.unionByName(written(tables.linked(grids).where(F.col("category").isin(*categories)), "table-mentions"))
        materials = materials.unionByName(written(tables.brought_up(grids), "table-materials"))
    return Extracted(pages, typed, blocks, sentences, linked, materials, grids, info)


def buckets(pages: DataFrame) -> int:
    """The number of buckets by paper for :func:`run_by_paper`: so many that what one holds is sorted in a task's memory."""
    spark = pages.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pages.select("paper_id").distinct().count() // PAPERS))


def run_by_paper(pages: DataFrame, n: int, grids: DataFrame, info: DataFrame | None = None) -> Extracted:
    """:func:`run` with each stage written in ``n`` buckets by paper, so that what follows is worked out bucket by bucket, without
    shuffles that stay on disk until the end. Only text is shuffled, and each shuffle dropped before the next stage; ``grids``
    should come in ``n`` parts by paper (else a bucket has many files)."""
    spark = pages.sparkSession
    typed = bucketed(layout.typed_lines(layout.lines(pages).repartition(n, "paper_id")), "typed", n)
    blocks = bucketed(layout.blocks(typed), "blocks", n)
    tidy(spark)
    sentences = extract.sentences(blocks)
    read = stored(extract.with_mentions(sentences.repartition(n, "paper_id"), CATEGORIES), "read")
    tidy(spark)
    headed = bucketed(tables.headed(grids), "headed", n)
    tidy(spark)
    grids = bucketed(tables.captioned(headed, blocks), "grids", n)
    discard(headed)
    linked = bucketed(extract.mentions(read).unionByName(tables.linked(grids).where(F.col("category").isin(*CATEGORIES))), "mentions", n)
    materials = bucketed(extract.brought_up(read).unionByName(tables.brought_up(grids)), "materials", n)
    discard(read)
    return Extracted(pages, typed, blocks, sentences, linked, materials, grids, info, n)


def strict(df: DataFrame) -> DataFrame:
    """No nulls, empty texts or control characters: what is missing is NONE."""
    return df.select(*(F.coalesce(F.nullif(F.regexp_replace(F.col(c).cast("string"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), F.lit("")), F.lit(NONE)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def _ids(x: Extracted) -> DataFrame:
    return x.registry.select("paper_id", "material_id", F.col("normalized_formula").alias("formula"))


def properties(x: Extracted) -> DataFrame:
    """The ranked mentions with the material they are linked to."""
    p = x.ranked.join(_ids(x), ["paper_id", "formula"], "left")
    return strict(p.select("paper_id", "material_id", "category", "property_name", "raw_value", "normalized_value", "unit", "ea_type", F.round("confidence", 3).alias("confidence"), F.col("page").cast("string").alias("page"), "section", "sentence", "source_type"))


def activation_energy(x: Extracted) -> DataFrame:
    """The ranked activation energies and migration barriers, with the material of the capped relation they are in."""
    kept = x.relations.select("paper_id", *rank.KEY, "formula")
    a = x.ranked.where(F.col("property_name").isin(*extract.EA_PROPERTIES)).drop("formula").join(kept, ["paper_id", *rank.KEY], "left").join(_ids(x), ["paper_id", "formula"], "left")
    return strict(a.select("paper_id", "material_id", F.col("formula").alias("material_formula"), F.replace("property_name", F.lit("_"), F.lit(" ")).alias("matched_as"), "ea_type", "raw_value", "normalized_value", "unit", F.round("confidence", 3).alias("confidence"), F.col("page").cast("string").alias("page"), "section", "sentence", "source_type"))


def relations(x: Extracted) -> DataFrame:
    """The capped links of values to materials."""
    r = x.relations.join(_ids(x), ["paper_id", "formula"])
    return strict(r.select("paper_id", "material_id", F.col("formula").alias("material_formula"), "category", "property_name", F.col("normalized_value").alias("value"), "unit", "ea_type", F.round("relation_confidence", 3).alias("confidence"), "extraction_method", "sentence", F.col("page").cast("string").alias("page")))


def materials(x: Extracted) -> DataFrame:
    """The materials of each paper, elements as JSON."""
    return strict(x.registry.withColumn("elements", F.to_json("elements")).withColumn("confidence", F.round("confidence", 3)))


def papers(x: Extracted) -> DataFrame:
    """One row a paper: metadata, DOI, year and how much was found."""
    out = x.pages.select("paper_id").distinct().join(metadata(x), "paper_id", "left")
    counts = [(x.registry, "n_materials"), (x.relations, "n_relations"), (layout.references(x.typed), "n_references")]
    for df, name in counts:
        out = out.join(df.groupBy("paper_id").agg(F.count("*").alias(name)), "paper_id", "left")
    return strict(out.select("paper_id", F.col("paper_id").alias("filename"), "title", "authors", "journal", "doi", "publication_year", *(F.coalesce(c, F.lit(0)).alias(c) for _, c in counts)))


def metadata(x: Extracted) -> DataFrame:
    """(paper_id, title, authors, journal, creation_date, doi, publication_year), NONE for what isn't known."""
    m = layout.doi_and_year(x.pages, x.info)
    given = [c for c in META[:4] if x.info is not None and c in x.info.columns]
    if given:
        m = m.join(x.info.select("paper_id", *(F.nullif(F.trim(c), F.lit("")).alias(c) for c in given)), "paper_id", "left")
    return m.select("paper_id", *(F.coalesce(c, F.lit(NONE)).alias(c) if c in m.columns else F.lit(NONE).alias(c) for c in META))


def _field(c: Column) -> list[tuple[str, Column]]:
    none = F.lit(NONE)
    return [("Raw", F.coalesce(c["raw_value"], none)), ("Value", F.coalesce(c["normalized_value"], none)), ("Unit", F.coalesce(c["unit"], none)), ("Confidence", F.round(F.coalesce(c["confidence"], F.lit(0.0)), 3)), ("Page", F.coalesce(c["page"], none)), ("Section", F.coalesce(c["section"], none)), ("SourceType", F.coalesce(c["source_type"], none))]


def _top(df: DataFrame, text: Column, name: str, *order: Column) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("paper_id").orderBy(*order))
    top = df.withColumn("n", n).where("n <= 5").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))).alias("ts"))
    return top.select("paper_id", F.array_join(F.transform("ts", lambda t: t["t"]), " | ").alias(name))


def wide_summary(x: Extracted) -> DataFrame:
    """One row a paper: its metadata, of every property of every category the best value with all that is known of it and
    two runners-up (``_Cand2``, ``_Cand3``), and its first materials and relations. Columns begin with the first five letters
    of the category; activation energies and migration barriers have their ``_Type`` too. What is missing is NONE."""
    x = x.settled()
    n = F.row_number().over(Window.partitionBy("paper_id", "category", "property_name").orderBy(F.desc("confidence"), *rank.KEY))
    best = x.ranked.withColumn("n", n).where("n <= 3")
    kept = ("raw_value", "normalized_value", "unit", "confidence", F.col("page").cast("string").alias("page"), "section", "source_type", "ea_type")
    key = F.concat_ws("|", "category", "property_name", "n")
    held = best.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct(key, F.struct(*kept)))).alias("held"))  # three a property at most
    first = _top(x.registry, F.col("normalized_formula"), "Top_Materials", F.desc("confidence"), F.length("material_id"), F.col("material_id"))
    told = F.concat("formula", F.lit("["), "property_name", F.lit("="), "normalized_value", F.lit("]"))
    links = _top(x.relations, told, "Top_Relations", F.desc("relation_confidence"), *map(F.col, rank.KEY))
    out = x.pages.select("paper_id").distinct()
    for df in (metadata(x), held, first, links):
        out = out.join(df, "paper_id", "left")
    columns = [F.col("paper_id").alias("Filename")]
    for m in META:
        known = F.col(m) != NONE
        columns += [F.col(m).alias(f"Meta_{m}_{w}") for w in ("Raw", "Value")] + [F.lit(NONE).alias(f"Meta_{m}_Unit"), F.when(known, 1.0).otherwise(0.0).alias(f"Meta_{m}_Confidence"), F.when(known, "1").otherwise(NONE).alias(f"Meta_{m}_Page"), *(F.when(known, "Metadata").otherwise(NONE).alias(f"Meta_{m}_{w}") for w in ("Section", "SourceType"))]
    for e in ENTRIES:
        name, at = f"{e.category[:5].capitalize()}_{e.name}", [F.element_at("held", F.lit(f"{e.category}|{e.name}|{k}")) for k in (1, 2, 3)]
        columns += [c.alias(f"{name}_{w}") for w, c in _field(at[0])]
        columns += [F.coalesce(F.nullif(at[0]["ea_type"], F.lit(NONE)), F.lit(NONE)).alias(f"{name}_Type")] if e.name in extract.EA_PROPERTIES else []
        columns += [F.coalesce(at[k - 1]["normalized_value"], F.lit(NONE)).alias(f"{name}_Cand{k}") for k in (2, 3)]
    return out.select(*columns, *(F.coalesce(c, F.lit(NONE)).alias(c) for c in ("Top_Materials", "Top_Relations")))


def _listed(df: DataFrame, name: str, *columns: str | Column) -> DataFrame:
    """The rows of each paper as one list, in the order of its columns."""
    return df.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def _shown(rows: Column, fields: list[str]) -> Column:
    """A list of structs without the fields that only put it in order; amounts as an object, references as texts."""
    if fields == ["ref_no", "entry"]:
        return F.transform(rows, lambda e: e["entry"])
    kept = [f for f in fields if f not in ("no", "at", "sure", *rank.KEY)]
    return F.transform(rows, lambda e: F.struct(*(F.map_from_entries(e[f]).alias(f) if f == "elements" else e[f].alias(f) for f in kept)))


def nested(x: Extracted) -> DataFrame:
    """One JSON record a paper: filename, metadata, materials with their properties, properties of the paper by category,
    relations, tables, figures, equations, workflow and references. A paper in which nothing was found has its record too."""
    x = x.settled()
    shown = ("raw_value", "normalized_value", "unit", F.round("confidence", 3).alias("confidence"), F.col("page").cast("string").alias("page"), "section", "sentence", "source_type", F.nullif("ea_type", F.lit(NONE)).alias("ea_type"))
    own = x.linked.where("formula is not null").groupBy("paper_id", "formula").agg(F.array_sort(F.collect_list(F.struct(*rank.KEY, F.struct("property_name", *shown).alias("p")))).alias("ps"))
    # a paper's materials and values are put together by its lists, so that all is joined by paper alone
    own = own.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("formula", F.transform("ps", lambda p: p["p"])))).alias("own"))
    mats = x.registry.select("paper_id", F.struct(-F.col("confidence"), F.substring("material_id", 5, 12).cast("int")).alias("no"), "material_id", "raw_formula", "normalized_formula", F.map_entries("elements").alias("elements"), "is_known_alias", F.round("confidence", 3).alias("confidence"), "page", "section")
    mats = mats.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(*mats.columns[1:]))).alias("ms"), F.map_from_entries(F.collect_list(F.struct("normalized_formula", "material_id"))).alias("ids")).join(own, "paper_id", "left")
    of = mats.schema["ms"].dataType.elementType.names
    parts = [("materials", mats.select("paper_id", F.transform("ms", lambda m: F.struct(*(m[f].alias(f) for f in of), F.coalesce(F.element_at("own", m["normalized_formula"]), F.array()).alias("properties"))).alias("materials"), "ids"))]
    whole = x.ranked.groupBy("paper_id", "category", "property_name").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), *rank.KEY, F.struct(*shown).alias("p")))).alias("ps"))
    whole = whole.withColumn("ps", F.transform("ps", lambda p: p["p"]))
    parts.append(("paper_level_properties", _listed(whole, "paper_level_properties", "category", "property_name", "ps")))
    links = x.relations.withColumns({"sure": -F.col("relation_confidence"), "confidence": F.round("relation_confidence", 3), "page": F.col("page").cast("string"), "material_id": F.lit(None).cast("string")})
    parts.append(("relations", _listed(links, "relations", "sure", *rank.KEY, "material_id", F.col("formula").alias("material_formula"), "category", "property_name", F.col("normalized_value").alias("value"), "unit", "ea_type", "confidence", "extraction_method", "sentence", "page")))
    if x.grids is not None:
        parts.append(("tables", _listed(x.grids, "tables", "page", "t_idx", "table_number", "caption", "headers", "material_column", "cells")))
    figures = annotate.figures(x.blocks)
    parts.append(("figures", _listed(figures, "figures", F.col("page").alias("at"), F.coalesce(F.col("figure_number").try_cast("int"), F.lit(0)).alias("no"), "block_no", *figures.columns[1:-1])))
    equations = annotate.equations(x.blocks, x.sentences)
    parts.append(("equations", _listed(equations, "equations", F.col("page").alias("at"), "block_no", "sent_no", *equations.columns[1:-2])))
    flow = annotate.workflow(x.blocks)
    parts.append(("workflow", _listed(flow, "workflow", *flow.columns[1:])))
    parts.append(("references", _listed(layout.references(x.typed), "references", "ref_no", "entry")))
    out = x.pages.select("paper_id").distinct().join(metadata(x), "paper_id", "left")
    for _, df in parts:
        out = out.join(df, "paper_id", "left")
    known = F.filter("relations", lambda r: F.element_at("ids", r["material_formula"]).isNotNull())
    out = out.withColumn("relations", F.transform(known, lambda r: r.withField("material_id", F.element_at("ids", r["material_formula"]))))
    lists = [_shown(F.coalesce(name, F.array().cast(df.schema[name].dataType)), df.schema[name].dataType.elementType.names).alias(name) for name, df in parts]
    return out.select("paper_id", F.to_json(F.struct(F.col("paper_id").alias("filename"), F.struct(*META).alias("metadata"), *lists)).alias("payload"))


def run_report(x: Extracted) -> DataFrame:
    """Totals of a run: papers, materials, relations, and papers with an activation energy."""
    n = [(x.pages.select("paper_id").distinct(), "n_papers"), (x.registry, "n_materials"), (x.relations, "n_relations"), (x.linked.where("property_name = 'Activation_Energy'").select("paper_id").distinct(), "n_with_activation_energy")]
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for df, name in n))


def headline_report(x: Extracted) -> DataFrame:
    """(paper_id, what, value, ea_type, confidence): of each paper the best value of the properties that a report names, its
    first materials, and how many relations, tables, figures and equations it has."""
    n = F.row_number().over(Window.partitionBy("paper_id", "property_name").orderBy(F.desc("confidence"), *rank.KEY))
    best = x.ranked.where(F.col("property_name").isin(*HEADLINES)).withColumn("n", n).where("n = 1")
    rows = [best.select("paper_id", F.col("property_name").alias("what"), F.col("normalized_value").alias("value"), "ea_type", F.round("confidence", 2).alias("confidence"))]
    extra = (F.lit(NONE).alias("ea_type"), F.lit(None).cast("double").alias("confidence"))
    first = _top(x.registry, F.col("normalized_formula"), "value", F.desc("confidence"), F.length("material_id"), F.col("material_id"))
    rows.append(first.select("paper_id", F.lit("Materials").alias("what"), F.replace("value", F.lit(" | "), F.lit(", ")).alias("value"), *extra))
    counted = [("Relations", x.relations), ("Figures", annotate.figures(x.blocks)), ("Equations", annotate.equations(x.blocks, x.sentences))] + ([("Tables", x.grids)] if x.grids is not None else [])
    rows += [df.groupBy("paper_id").agg(F.count("*").cast("string").alias("value")).select("paper_id", F.lit(name).alias("what"), "value", *extra) for name, df in counted]
    return reduce(DataFrame.unionByName, rows)


def new_only(pages: DataFrame, existing: DataFrame) -> DataFrame:
    """The pages of papers whose file isn't among those published before."""
    return pages.join(existing.select("paper_id").distinct(), "paper_id", "left_anti")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows of a published table; columns that one lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)
