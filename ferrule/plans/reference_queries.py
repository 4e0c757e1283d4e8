"""Queries of the extraction engine over the generated corpus, with SQL twins from the generating columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.lexicon import ENTRIES
from ferrule.operators import annotate, extract, layout, tables
from ferrule.plans import corpus, pipeline
from ferrule.session import table
from ferrule.streaming import incremental

Pages = Callable[[SparkSession, str], DataFrame]


def _typed(spark: SparkSession, sf_dir: str, pages: Pages = corpus.pages) -> DataFrame:
    return layout.typed_lines(layout.lines(pages(spark, sf_dir)))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, page, text) of the documents: one page each; null texts have no lines."""
    return table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("paper_id"), F.lit(1).alias("page"), "text")


def line_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed, numbered lines of the documents in plain characters (what composing does to others, SQL can't say)."""
    plain = _documents(spark, sf_dir).where(~F.col("text").rlike(r"[^\x00-\x7F]"))
    return layout.lines(plain).select("paper_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line_md5"))


def section_carry_forward(spark: SparkSession, sf_dir: str, pages: Pages = corpus.pages) -> DataFrame:
    """The section of each line of the corpus."""
    return _typed(spark, sf_dir, pages).select("paper_id", "page", "line_no", "section", "type")


def paragraphs(spark: SparkSession, sf_dir: str, pages: Pages = corpus.pages) -> DataFrame:
    """The blocks of the corpus."""
    return layout.blocks(_typed(spark, sf_dir, pages)).select("paper_id", "block_no", "page", "type", "section", "text", F.coalesce("ref_number", F.lit("NONE")).alias("ref_number"))


def references_split(spark: SparkSession, sf_dir: str, pages: Pages = corpus.pages) -> DataFrame:
    """The entries of the reference lists."""
    return layout.references(_typed(spark, sf_dir, pages))


def doi_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOI and year of each paper."""
    return layout.doi_and_year(corpus.pages(spark, sf_dir))


def sentences_scored(spark: SparkSession, sf_dir: str, pages: Pages = corpus.pages) -> DataFrame:
    """The sentences of the corpus with their scores."""
    return extract.sentences(layout.blocks(_typed(spark, sf_dir, pages))).select("paper_id", "sentence", F.round(F.col("score") * 100).cast("int").alias("score_pct"))


def _x(spark: SparkSession, sf_dir: str, pages: Pages = corpus.pages, **more) -> pipeline.Extracted:
    return pipeline.run(pages(spark, sf_dir), **more)


def _milli(c: str) -> Column:
    return F.round(F.col(c) * 1000).cast("int").alias("conf_milli")


def all_mentions(spark: SparkSession, sf_dir: str, pages: Pages = corpus.pages) -> DataFrame:
    """Every mention of all 104 properties in the corpus."""
    return _x(spark, sf_dir, pages).linked.select("paper_id", "category", "property_name", "normalized_value", "unit", "ea_type", F.coalesce("formula", F.lit("NONE")).alias("formula"))


def materials_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The materials of each sentence that holds a mention, in the order in which they are registered."""
    m = _x(spark, sf_dir).materials
    return m.select("paper_id", F.col("formula"), F.col("at.n").cast("int").alias("place"), F.round(F.col("score") * 1000).cast("int").alias("score_milli"))


def ea_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many activation energies of each kind the corpus states."""
    m = _x(spark, sf_dir, categories=("ELECTROCHEMICAL",)).linked.where(F.col("property_name").isin(*extract.EA_PROPERTIES))
    return m.groupBy("property_name", "ea_type").agg(F.count("*").alias("n"))


def property_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published properties with the material that each is linked to."""
    return pipeline.properties(_x(spark, sf_dir)).select("paper_id", "material_id", "category", "property_name", "normalized_value", "ea_type", _milli("confidence"), "page", "section")


def ranked_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked properties."""
    return _x(spark, sf_dir).ranked.select("paper_id", "category", "property_name", "normalized_value", "ea_type", _milli("confidence"), "rank")


def activation_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published activation energies and migration barriers."""
    return pipeline.activation_energy(_x(spark, sf_dir)).select("paper_id", "material_id", "material_formula", "matched_as", "ea_type", "normalized_value", "unit", _milli("confidence"), "page", "section", "sentence")


def material_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The materials of each paper."""
    amounts = F.transform(F.array_sort(F.map_entries("elements")), lambda e: F.concat(e["key"], F.lit(":"), F.regexp_replace(e["value"].cast("string"), r"\.0$", "")))
    return _x(spark, sf_dir).registry.select("paper_id", "material_id", "normalized_formula", _milli("confidence"), "page", "section", F.array_join(amounts, " ").alias("elements"))


def relations_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capped relations of the corpus."""
    return pipeline.relations(_x(spark, sf_dir)).select("paper_id", "material_id", "material_formula", "category", "property_name", "value", "ea_type", _milli("confidence"), "extraction_method")


def papers_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a paper."""
    return pipeline.papers(_x(spark, sf_dir, info=_info(spark, sf_dir)))


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded metadata: titles from part names, every third one blank."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("paper_id"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("authors"), F.lit("D:20170304").alias("creation_date"))


def wide_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All properties of a paper as columns: best value, two runners-up, first materials and relations. The columns of
    metadata, pages, raw texts, sections and sources of the whole summary are left to its other readers."""
    w = pipeline.wide_summary(_x(spark, sf_dir))
    kept = [c for c in w.columns if c == "Filename" or c.startswith("Top_") or c.endswith(("_Value", "_Confidence", "_Cand2", "_Cand3", "_Type")) and not c.startswith("Meta_")]
    return w.select(*kept)


def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested record of each paper, with a table of the line items of its part."""
    pages = corpus.pages(spark, sf_dir)
    n = pipeline.buckets(pages)
    return pipeline.nested(pipeline.run_by_paper(pages, n, _paper_grids(spark, sf_dir, n), _info(spark, sf_dir)))


def nested_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each part of a paper's nested record holds, read back from the JSON of a run over text alone."""
    p = pipeline.nested(_x(spark, sf_dir))
    parts = ("materials", "paper_level_properties", "relations", "figures", "equations", "workflow", "references")
    return p.select("paper_id", F.get_json_object("payload", "$.metadata.doi").alias("doi"), *(F.coalesce(F.json_array_length(F.get_json_object("payload", f"$.{n}")), F.lit(0)).alias(f"n_{n}") for n in parts))


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run."""
    return pipeline.run_report(_x(spark, sf_dir))


def headline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline values of each paper."""
    return pipeline.headline_report(_x(spark, sf_dir)).select("paper_id", "what", "value", "ea_type", F.coalesce(F.round(F.col("confidence") * 100).cast("int"), F.lit(0)).alias("conf_pct"))


def equations_typed(spark: SparkSession, sf_dir: str, pages: Pages = corpus.pages) -> DataFrame:
    """The equations of the corpus."""
    b = layout.blocks(_typed(spark, sf_dir, pages))
    return annotate.equations(b, extract.sentences(b)).select("paper_id", "equation_type", "equation_text", "page", "section", "variables")


def figures_xref(spark: SparkSession, sf_dir: str, pages: Pages = corpus.pages) -> DataFrame:
    """The figures of the corpus with what they refer to."""
    f = annotate.figures(layout.blocks(_typed(spark, sf_dir, pages)))
    return f.select("paper_id", "figure_number", "referenced_materials", "referenced_properties", "referenced_tables", "referenced_equations", "mentioned_methods")


def workflow_steps(spark: SparkSession, sf_dir: str, pages: Pages = corpus.pages) -> DataFrame:
    """The workflow of each paper."""
    return annotate.workflow(layout.blocks(_typed(spark, sf_dir, pages))).select("paper_id", "step_order", "stage", "page")


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell grids from line items: one table an order, with merged and repeated header cells, an empty row and cells beyond
    the headers."""
    return _tabled(table(spark, sf_dir, "lineitem").withColumn("paper_id", F.col("l_orderkey").cast("string")), 1, "l_linenumber")


def _paper_grids(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Cell grids of the papers of the corpus, in ``n`` parts by paper: on its second page each has the line items of its part as
    a table."""
    items = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("paper_id"), "l_orderkey", "l_linenumber", "l_quantity")
    return _tabled(items.repartition(n, "paper_id"), 2, "l_orderkey", "l_linenumber")


def _tabled(items: DataFrame, page: int, *order: str) -> DataFrame:
    l = items.select("paper_id", *{*order, "l_linenumber"}, F.col("l_quantity").cast("int").cast("string").alias("q"))
    # cells are made of the grouped items, which are smaller
    cell = lambda r: F.array(F.element_at(F.array(*(F.lit(m) for m in corpus.MATERIALS)), F.pmod(r["l_linenumber"], F.lit(5)) + 1), r["q"], F.lit("grain\nboundary"), F.concat(r["q"], F.lit("0 meV")), F.lit("0.5"), F.lit(" over "))
    g = l.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(*order, *{"l_linenumber"} - {*order}, "q"))).alias("rs"))
    head = F.array(F.lit("Material"), F.lit("Ionic conductivity (total) (mS/cm)"), F.lit("Kind"), F.lit("Activation energy"), F.lit(None).cast("string"))
    blank = F.array(F.array(F.lit(""), F.lit(None).cast("string")))
    return g.select("paper_id", F.lit(page).alias("page"), F.lit(1).alias("t_idx"), F.concat(F.array(head), F.transform("rs", cell), blank).alias("cells"))


def table_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property values of table cells."""
    m = tables.table_mentions(tables.rows(tables.headed(_grids(spark, sf_dir))))
    return m.select("paper_id", F.col("row_no").cast("int").alias("row_no"), F.col("col_no").cast("int").alias("col_no"), "property_name", "raw_value", "normalized_value", "unit", "formula")


def table_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and material column of each grid."""
    return tables.headed(_grids(spark, sf_dir)).select("paper_id", F.array_join("headers", "|").alias("headers"), "material_column")


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data rows of each grid; what goes beyond the headers is in columns counted from 0."""
    r = tables.rows(tables.headed(_grids(spark, sf_dir)))
    return r.select("paper_id", F.col("row_no").cast("int").alias("row_no"), F.array_join(F.array_sort(F.transform(F.map_entries("row"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("cells"))


def table_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations that tables alone give: confidence, kind of activation energy from the row, caption by number."""
    grids = _grids(spark, sf_dir)
    pages = grids.select("paper_id", F.lit(1).alias("page"), F.lit("Results\nTable 7. Other values.\nTable 1. Values of this order.").alias("text"))
    x = pipeline.run(pages, grids=grids)
    return pipeline.relations(x).groupBy("paper_id", "property_name", "ea_type", "sentence", "extraction_method", _milli("confidence")).agg(F.count("*").alias("n"), F.count_distinct("material_id").alias("n_materials"))


def new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers not yet published, where those of even keys are."""
    p = corpus.pages(spark, sf_dir)
    return pipeline.new_only(p, p.where("cast(substring(paper_id, 2) as int) % 2 = 0")).select("paper_id", "page")


def merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published papers and new ones in one table."""
    p = corpus.pages(spark, sf_dir).where("page = 1").select("paper_id", F.length("text").alias("n"))
    even = F.expr("cast(substring(paper_id, 2) as int) % 2 = 0")
    return pipeline.merge(p.where(even).select("paper_id"), p.where(~even)).select("paper_id", F.col("n").isNotNull().alias("has_n"))


def captions(spark: SparkSession, sf_dir: str, pages: Pages = corpus.pages) -> DataFrame:
    """The captions of the corpus."""
    return layout.blocks(_typed(spark, sf_dir, pages)).where("type = 'Caption'").select("paper_id", "page", "ref_kind", "ref_number", "text")


def incremental_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of papers from a file stream read to its end in batches, each published once."""
    return incremental.published(spark, incremental.stage_pages(corpus.pages(spark, sf_dir)), lambda pages: layout.lines(pages).groupBy("paper_id").agg(F.count("*").alias("n_lines")))


_F = [merge_union, captions, incremental_stream, line_layout, section_carry_forward, paragraphs, references_split, doi_year, sentences_scored, all_mentions, materials_found, ea_types, property_links, ranked_properties, activation_energy, material_registry, relations_capped, papers_summary, wide_summary, nested_json, nested_parts, run_report, headline_report, equations_typed, figures_xref, workflow_steps, table_headers, table_rows, table_properties, table_relations, new_only]
#: The same over every text of documents, whole; nothing but the same rules could work out their answer, so they have no SQL twins.
_OVER_DOCUMENTS = [section_carry_forward, paragraphs, references_split, sentences_scored, all_mentions, equations_typed, figures_xref, captions, workflow_steps]
QUERIES = {f.__name__: f for f in _F} | {f"documents_{f.__name__}": partial(f, pages=_documents) for f in _OVER_DOCUMENTS}

_PART = corpus.part_sql()
_FULL = f"(select * from {_PART} where kind <> {corpus.EMPTY})"
_LINES = f"({corpus.lines_sql()})"
_CUES = " or ".join("contains(lower(sentence), '{}')".format(w) for w in ("our", "this work", "calculated", "measured", "achieved", "exhibits", "shows", "observed", "obtained", "found", "demonstrate", "confirmed"))
_AGAINST = " or ".join("contains(lower(sentence), '{}')".format(w) for w in ("previous", "literature", "reported", "ref", "et al", "according to", "compared to", "in contrast to"))
_SCORE = f"round(least(0.99, greatest(0.01, 0.5 + case when type = 'Caption' then 0.25 else 0 end + case when section in ('Results', 'Abstract', 'Conclusion') then 0.2 else 0 end + case when {_CUES} then 0.15 else 0 end - case when {_AGAINST} then 0.35 else 0 end)), 6)"
# what the corpus declares, ranked, linked and registered by SQL of its own
_WITH = f"""with sent as (select *, {_SCORE} as score from ({corpus.sentences_sql()})),
m as (select a.*, s.section, s.page, s.type, s.sentence, s.score from ({corpus.mentions_sql()}) a join sent s using (paper_id, no, sn)),
mats as (select a.*, s.section, s.page, s.type, s.score from ({corpus.materials_sql()}) a join sent s using (paper_id, no, sn)),
reg as (select *, 'MAT_' || row_number() over (partition by paper_id order by no, sn, pos) as material_id from (select paper_id, formula, no, sn, pos, page, section, max(score) over (partition by paper_id, formula) as confidence,
  row_number() over (partition by paper_id, formula order by no, sn, pos) as first from mats) where first = 1),
boosted as (select *, round(least(0.99, score + case when n > 1 then least(0.15, 0.05 * log2(n + 1)) else 0 end + case when core and section not in ('Abstract', 'Conclusion') then 0.1 else 0 end), 6) as confidence
  from (select *, count(*) over w as n, bool_or(section in ('Abstract', 'Conclusion')) over w as core from m window w as (partition by paper_id, category, property_name, value))),
ranked as (select *, row_number() over (partition by paper_id, category, property_name, ea_type order by confidence desc, no, sn, pi, mn) as rank
  from (select *, row_number() over (partition by paper_id, category, property_name, value, ea_type order by confidence desc, no, sn, pi, mn) as one from boosted) where one = 1 qualify rank <= 5),
rel as (select *, round(least(0.99, score + 0.1), 6) as rc from m where formula is not null qualify row_number() over (partition by paper_id, formula, category, property_name, value order by rc desc, no, sn, pi, mn) <= 3)
"""
_ELEMENTS = "case formula " + " ".join(f"when '{f}' then '{e}'" for f, e in corpus.ELEMENTS.items()) + " end"
_TOP = "(select paper_id, category, property_name, value, confidence, ea_type, row_number() over (partition by paper_id, category, property_name order by confidence desc, no, sn, pi, mn) as nth from ranked)"
_COLUMNS = []
for _e in ENTRIES:
    _at, _name = f"category = '{_e.category}' and property_name = '{_e.name}' and nth =", f"{_e.category[:5].capitalize()}_{_e.name}"
    _COLUMNS += [f"coalesce(max(case when {_at} {k} then value end), 'NONE') as \"{_name}_{c}\"" for k, c in ((1, "Value"), (2, "Cand2"), (3, "Cand3"))]
    _COLUMNS.append(f"round(coalesce(max(case when {_at} 1 then confidence end), 0.0), 3) as \"{_name}_Confidence\"")
    if _e.name in extract.EA_PROPERTIES:
        _COLUMNS.append(f"coalesce(max(case when {_at} 1 then ea_type end), 'NONE') as \"{_name}_Type\"")
_FIRST = "select paper_id, string_agg(formula, '{}' order by n) as t from (select *, row_number() over (partition by paper_id order by confidence desc, no, sn, pos) as n from reg qualify n <= 5) group by paper_id"
_ROW = "from lineitem"
_LMAT = "case l_linenumber % 5 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(corpus.MATERIALS)) + " end"

ORACLES = {
    "line_layout": "select cast(doc_id as varchar) as paper_id, n - 1 as line_no, md5(line) as line_md5 from (select doc_id, generate_subscripts(ls, 1) as n, regexp_replace(unnest(ls), '^[\\s\\x{001c}-\\x{001f}\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+|[\\s\\x{001c}-\\x{001f}\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+$', '', 'g') as line from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null and regexp_matches(text, '^[\\x{0000}-\\x{007f}]*$'))) where line <> ''",
    "section_carry_forward": f"select paper_id, page, row_number() over (partition by paper_id, page order by no) - 1 as line_no, section, type from {_LINES}",
    "paragraphs": f"""select paper_id, row_number() over (partition by paper_id order by first_no) - 1 as block_no, page, type, section, text, case when type = 'Caption' then regexp_extract(text, '[0-9]+') else 'NONE' end as ref_number from
(select paper_id, page, type, section, min(no) as first_no, string_agg(replace(line, '⁻³', '−3'), ' ' order by no) as text from (select *, case when type = 'Text' then i - row_number() over (partition by paper_id, page, type order by no) else 1000 + i end as grp from (select *, row_number() over (partition by paper_id, page order by no) as i from {_LINES}) where type in ('Text', 'Caption', 'EquationCandidate')) group by paper_id, page, type, section, grp)""",
    "references_split": f"select paper_id, 1 as ref_no, '[1] First entry of paper ' || k || ' continued here' as entry from {_FULL} union all select paper_id, 2, '[2] Second entry' from {_FULL}",
    "doi_year": f"select paper_id, case when kind = {corpus.EMPTY} then 'NONE' else '10.1234/part.' || k end as doi, case when kind = {corpus.EMPTY} then 'NONE' else '201' || m end as publication_year from {_PART}",
    "sentences_scored": f"{_WITH} select paper_id, replace(sentence, '⁻³', '−3') as sentence, cast(round(score * 100) as int) as score_pct from sent",
    "all_mentions": f"{_WITH} select paper_id, category, property_name, value as normalized_value, unit, ea_type, coalesce(formula, 'NONE') as formula from m",
    "materials_found": f"{_WITH} select paper_id, formula, cast(pos as int) as place, cast(round(score * 1000) as int) as score_milli from mats",
    "ea_types": f"{_WITH} select property_name, ea_type, count(*) as n from m where property_name in ('Activation_Energy', 'Migration_Barrier') group by all",
    "property_links": f"{_WITH} select paper_id, coalesce(material_id, 'NONE') as material_id, category, property_name, value as normalized_value, ea_type, cast(round(round(ranked.confidence, 3) * 1000) as int) as conf_milli, cast(ranked.page as varchar) as page, ranked.section from ranked left join reg using (paper_id, formula)",
    "ranked_properties": f"{_WITH} select paper_id, category, property_name, value as normalized_value, ea_type, cast(round(confidence * 1000) as int) as conf_milli, rank from ranked",
    "activation_energy": f"""{_WITH} select r.paper_id, coalesce(material_id, 'NONE') as material_id, coalesce(k.formula, 'NONE') as material_formula, replace(r.property_name, '_', ' ') as matched_as, r.ea_type, r.value as normalized_value, r.unit, cast(round(round(r.confidence, 3) * 1000) as int) as conf_milli, cast(r.page as varchar) as page, r.section, r.sentence
from ranked r left join rel k using (paper_id, no, sn, pi, mn) left join reg on reg.paper_id = r.paper_id and reg.formula = k.formula where r.property_name in ('Activation_Energy', 'Migration_Barrier')""",
    "material_registry": f"{_WITH} select paper_id, material_id, formula as normalized_formula, cast(round(confidence * 1000) as int) as conf_milli, cast(page as varchar) as page, section, {_ELEMENTS} as elements from reg",
    "relations_capped": f"{_WITH} select paper_id, material_id, formula as material_formula, category, property_name, value, ea_type, cast(round(rc * 1000) as int) as conf_milli, 'proximity' as extraction_method from rel join reg using (paper_id, formula)",
    "papers_summary": f"""{_WITH} select p.paper_id, p.paper_id as filename, case when k % 3 = 0 then 'NONE' else p_name end as title, p_brand as authors, 'NONE' as journal, case when kind = {corpus.EMPTY} then 'NONE' else '10.1234/part.' || k end as doi, case when kind = {corpus.EMPTY} then '2017' else '201' || m end as publication_year,
(select count(*) from reg where reg.paper_id = p.paper_id) as n_materials, (select count(*) from rel where rel.paper_id = p.paper_id) as n_relations, case when kind = {corpus.EMPTY} then 0 else 2 end as n_references from {_PART} p join part on p_partkey = k""",
    "wide_summary": f"""{_WITH}, first as ({_FIRST.format(" | ")}), links as (select paper_id, string_agg(formula || '[' || property_name || '=' || value || ']', ' | ' order by n) as t from (select *, row_number() over (partition by paper_id order by rc desc, no, sn, pi, mn) as n from rel qualify n <= 5) group by paper_id),
cells as (select p.paper_id, {', '.join(_COLUMNS)} from {_PART} p left join {_TOP} t using (paper_id) group by p.paper_id)
select cells.* exclude (paper_id), cells.paper_id as "Filename", coalesce(first.t, 'NONE') as "Top_Materials", coalesce(links.t, 'NONE') as "Top_Relations" from cells left join first using (paper_id) left join links using (paper_id)""",
    "nested_parts": f"""{_WITH} select paper_id, case when kind = {corpus.EMPTY} then 'NONE' else '10.1234/part.' || k end as doi, (select count(*) from reg where reg.paper_id = p.paper_id) as n_materials, (select count(distinct category || property_name) from ranked where ranked.paper_id = p.paper_id) as n_paper_level_properties,
(select count(*) from rel where rel.paper_id = p.paper_id) as n_relations, (select count(*) from {_LINES} l where l.paper_id = p.paper_id and type = 'Caption') as n_figures, n_equations, n_workflow, case when kind = {corpus.EMPTY} then 0 else 2 end as n_references from ({{steps}}) p""",
    "run_report": f"{_WITH} select 'n_papers' as what, count(*) as n from {_PART} union all select 'n_materials', count(*) from reg union all select 'n_relations', count(*) from rel union all select 'n_with_activation_energy', count(distinct paper_id) from m where property_name = 'Activation_Energy'",
    "headline_report": f"""{_WITH} select paper_id, property_name as what, value, ea_type, cast(round(round(confidence, 2) * 100) as int) as conf_pct from (select *, row_number() over (partition by paper_id, property_name order by confidence desc, no, sn, pi, mn) as k from ranked where property_name in ('Activation_Energy', 'Ionic_Conductivity', 'Capacity', 'Voltage', 'Band_Gap', 'Formation_Energy', 'Bulk_Modulus', 'Density')) where k = 1
union all select paper_id, 'Materials', t, 'NONE', 0 from ({_FIRST.format(", ")}) union all select paper_id, 'Relations', cast(count(*) as varchar), 'NONE', 0 from rel group by paper_id
union all select paper_id, 'Figures', cast(count(*) as varchar), 'NONE', 0 from {_LINES} where type = 'Caption' group by paper_id union all select paper_id, 'Equations', cast(n_equations as varchar), 'NONE', 0 from ({{steps}}) where n_equations > 0""",
    "equations_typed": f"""select paper_id, 'Unclassified' as equation_type, 'sigma = A exp(x) (1)' as equation_text, 2 as page, 'Results' as section, 'A | exp | x' as variables from {_FULL}
union all select paper_id, case ex when {{neb}} then 'NEB' else 'MSD/Diffusion' end, example, 2, 'Results', case ex when {{neb}} then 'By | NEB' else 'NONE' end from {_PART} where kind = {corpus.EXAMPLE} and ex in ({{neb}}, {{msd}})""",
    "figures_xref": f"""select paper_id, '1' as figure_number, mat as referenced_materials, 'Technique' as referenced_properties, '2' as referenced_tables, '3' as referenced_equations, 'EIS' as mentioned_methods from {_FULL}
union all select paper_id, '2', 'LiF | LiCl | LiBr | NaF | NaCl | NaBr', 'NONE', '1 | 3 | 4 | 5 | 6 | 7 | 8', 'NONE', 'NONE' from {_PART} where kind = 4""",
    "workflow_steps": f"""select paper_id, row_number() over (partition by paper_id order by pos) as step_order, stage, 2 as page from (select paper_id, 'Conductivity Extraction' as stage, 100 as pos from {_FULL}
union all select paper_id, stage, pos from {_PART} join (values {{stages}}) t(ex, stage, pos) using (ex) where kind = {corpus.EXAMPLE})""",
    "table_headers": "select distinct cast(l_orderkey as varchar) as paper_id, 'Material|Ionic conductivity (total) (mS/cm)|Kind|Activation energy|Activation energy_2' as headers, 'Material' as material_column from lineitem",
    "table_rows": f"select cast(l_orderkey as varchar) as paper_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, cast(cast(l_quantity as int) as varchar)) - 1 as int) as row_no, 'Activation energy=' || cast(cast(l_quantity as int) as varchar) || '0 meV|Activation energy_2=0.5|Column_5=over|Ionic conductivity (total) (mS/cm)=' || cast(cast(l_quantity as int) as varchar) || '|Kind=grain boundary|Material=' || {_LMAT} as cells from lineitem",
    "table_properties": f"""select cast(l_orderkey as varchar) as paper_id, cast(row_number() over (partition by l_orderkey, c order by l_linenumber, q) - 1 as int) as row_no, cast(c as int) as col_no, case c when 1 then 'Ionic_Conductivity' else 'Activation_Energy' end as property_name, case c when 1 then q else q || '0 meV' end as raw_value,
case c when 1 then format('{{:.4g}} S/cm', cast(q as int) / 1000.0) else format('{{:.4g}} eV', cast(q as int) / 100.0) end as normalized_value, case c when 1 then 'S/cm' else 'eV' end as unit, {_LMAT} as formula from (select *, cast(cast(l_quantity as int) as varchar) as q from lineitem), (values (1), (3)) t(c)""",
    "table_relations": f"""select paper_id, property_name, ea_type, 'Table 1. Values of this order.' as sentence, 'table_row' as extraction_method, 950 as conf_milli, count(*) as n, count(distinct formula) as n_materials from (select cast(l_orderkey as varchar) as paper_id, p as property_name, case p when 'Activation_Energy' then 'grain boundary' else 'NONE' end as ea_type, {_LMAT} as formula,
row_number() over (partition by l_orderkey, p, {_LMAT}, cast(l_quantity as int) order by l_linenumber) as k from lineitem, (values ('Ionic_Conductivity'), ('Activation_Energy')) t(p)) where k <= 3 group by paper_id, property_name, ea_type""",
    "merge_union": f"select paper_id, k % 2 = 1 as has_n from {_PART}",
    "captions": f"select paper_id, page, 'Figure' as ref_kind, regexp_extract(line, '[0-9]+') as ref_number, line as text from {_LINES} where type = 'Caption'",
    "incremental_stream": f"select paper_id, count(*) as n_lines from {_LINES} group by paper_id",
    "new_only": f"select paper_id, t.page from {_PART}, (values (1), (2), (3)) t(page) where k % 2 = 1",
}


def _example(text: str) -> int:
    return next(i for i, (t, _) in enumerate(corpus.EXAMPLES) if text in t)


# stages that an example names: by the example, the stage and its place before (from 0) or among those of the block
_STAGE_EXAMPLES = [("supercell", "Supercell Construction", 1), ("mean squared", "MSD Analysis", 1), ("diffusion coefficient", "Diffusion Analysis", 1), ("random forest", "Machine Learning", 200)]
_STEPS = f"select *, case when kind = {corpus.EMPTY} then 0 when kind = {corpus.EXAMPLE} and ex in ({_example('By NEB')}, {_example('mean squared')}) then 2 else 1 end as n_equations, case when kind = {corpus.EMPTY} then 0 when kind = {corpus.EXAMPLE} and ex in ({', '.join(str(_example(t)) for t, _, _ in _STAGE_EXAMPLES)}) then 2 else 1 end as n_workflow from {_PART}"
for _name, _sql in ORACLES.items():
    for _key, _value in {"{steps}": _STEPS, "{neb}": str(_example("By NEB")), "{msd}": str(_example("mean squared")), "{stages}": ", ".join(f"({_example(t)}, '{n}', {at})" for t, n, at in _STAGE_EXAMPLES)}.items():
        _sql = _sql.replace(_key, _value)
    ORACLES[_name] = _sql
