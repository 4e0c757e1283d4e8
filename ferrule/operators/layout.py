"""From page text to typed blocks: lines, sections, paragraphs, captions, equations, references, and a paper's DOI and year."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import BLANKS, nfkc

# The wordings of section headings, by canonical name.
SECTIONS: dict[str, tuple[str, ...]] = {
    "Abstract": ("abstract",),
    "Introduction": ("introduction", "background"),
    "Methods": ("methods", "method", "experimental", "materials and methods", "simulation details", "computational details", "computational methods", "theory", "theoretical methods", "experimental section", "experimental details"),
    "Results": ("results", "results and discussion"),
    "Discussion": ("discussion",),
    "Conclusion": ("conclusion", "conclusions", "summary", "concluding remarks"),
    "Supplementary": ("supplementary information", "supplementary materials", "supporting information", "supplementary", "appendix", "electronic supplementary material", "esi"),
    "Boilerplate": ("author contributions", "conflict of interest", "conflicts of interest", "competing interests", "acknowledgements", "acknowledgments", "data availability", "funding", "declaration of competing interest"),
    "References": ("references", "bibliography"),
}
# How prose lines begin that aren't equations.
PROSE = ("the ", "this ", "in ", "for ", "we ", "it ", "these", "when ", "if ", "a ", "an ", "as ", "to ", "that ")
# What captions begin with, what stands before a year of publication, and how a DOI is written (the form that
# its registration agency recommends for matching).
FIGURE_WORDS, TABLE_WORDS = ("figures", "figure", "figs", "fig"), ("table",)
YEAR_WORDS = ("©", "Received", "Published", "Accepted", "Copyright")
DOI = r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)"
CAPTION = rf"(?iu)^({'|'.join((*FIGURE_WORDS, *TABLE_WORDS))})[.]?\s*([0-9]+)"
START = "Metadata/Header"
#: Headings are read with the numbering in front taken off; a roman number must be followed by a mark or a blank, so that
#: "Introduction" keeps its first letter. ``strict=False`` takes leading letters of roman numbers off as well.
NUMBERING = r"^(?:(?:[ivx]+|\d+(?:\.\d+)*)[.)\s]+)?\s*"
LOOSE_NUMBERING = r"^[ivx\d.\s]*"


def lines(pages: DataFrame) -> DataFrame:
    """(paper_id, page, line_no, line): the trimmed lines of each page that aren't empty, numbered as they stand.

    The text is composed for compatibility first, so that superscripts, ligatures and the like are plain; Python sees only
    pages that hold other characters than ASCII.
    """
    text = F.when(F.col("text").rlike(r"[^\x00-\x7F]"), nfkc(F.col("text"))).otherwise(F.col("text"))
    each = pages.select("paper_id", "page", text.alias("text")).select("paper_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line <> ''")


def section_of(line: Column, strict: bool = True) -> Column:
    """The canonical section that a line is the heading of, else null: a short line that begins with one of the wordings."""
    names = {w: n for n, ws in SECTIONS.items() for w in ws}
    wordings = "|".join(sorted(names, key=lambda w: -len(w)))
    # one expression takes the numbering off and finds the longest wording
    head = F.regexp_extract(F.lower(line), f"{NUMBERING if strict else LOOSE_NUMBERING}({wordings})", 1)
    return F.when(F.length(line) < 60, F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.nullif(head, F.lit(""))))


def is_equation(line: Column) -> Column:
    """Whether a line is set as an equation: an equals sign, short, not prose, and numbered or with hardly a word in it."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    long_words = F.filter(words, lambda w: w.rlike(r"^\p{L}{4,}$"))
    prose = F.lit(False)
    for p in PROSE:
        prose = prose | F.lower(line).startswith(p)
    # numbered: what follows the last opening bracket is a number and the closing one, and an equals sign comes before
    tail = F.substring_index(line, "(", -1)
    number = F.trim(F.regexp_replace(tail, r"\)\s*$", ""))
    numbered = F.rtrim(tail).endswith(")") & number.rlike("^[0-9]+$") & F.substring(line, F.lit(1), F.length(line) - F.length(tail)).contains("=")
    return line.contains("=") & (F.length(line) <= 80) & ~prose & (numbered | ((F.size(words) <= 12) & (F.size(long_words) <= 1)))


def typed_lines(line_rows: DataFrame, strict: bool = True) -> DataFrame:
    """Lines with their section (carried forward over pages) and type: header, reference, Caption, EquationCandidate or Text."""
    w = Window.partitionBy("paper_id").orderBy("page", "line_no")
    t = line_rows.withColumn("head", section_of(F.col("line"), strict)).withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit(START)))
    kind = F.when(F.col("head").isNotNull(), "header").when(F.col("section") == "References", "reference").when(F.col("line").rlike(CAPTION), "Caption").when(is_equation(F.col("line")), "EquationCandidate").otherwise("Text")
    return t.withColumn("type", kind).drop("head")


def blocks(typed: DataFrame) -> DataFrame:
    """(paper_id, block_no, page, type, section, text, ref_kind, ref_number): paragraphs, captions and equations in order.

    Consecutive plain lines of a page are one paragraph; headings, captions, equations and page ends close it. Texts
    under three characters and reference lists give no block.
    """
    page = Window.partitionBy("paper_id", "page").orderBy("line_no")
    island = F.sum((F.col("type") != "Text").cast("int")).over(page)
    t = typed.withColumn("island", F.when(F.col("type") == "Text", island).otherwise(-F.col("line_no") - 1))
    g = t.where("type in ('Text', 'Caption', 'EquationCandidate')").groupBy("paper_id", "page", "island", "type", "section").agg(F.min("line_no").alias("at"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    g = g.select("paper_id", "page", "at", "type", "section", F.array_join(F.transform("ls", lambda x: x["line"]), " ").alias("text")).where(F.length("text") >= 3)
    cap = F.col("type") == "Caption"
    g = g.withColumns({"ref_kind": F.when(cap, F.when(F.lower("text").startswith("t"), "Table").otherwise("Figure")), "ref_number": F.when(cap, F.regexp_extract("text", CAPTION, 2))})
    return g.withColumn("block_no", F.row_number().over(Window.partitionBy("paper_id").orderBy("page", "at")) - 1).select("paper_id", "block_no", "page", "type", "section", "text", "ref_kind", "ref_number")


def references(typed: DataFrame) -> DataFrame:
    """(paper_id, ref_no, entry): the entries of reference lists; lines that don't begin an entry are joined to the one before."""
    w = Window.partitionBy("paper_id").orderBy("page", "line_no")
    # an entry begins with a number of one to three digits, plain, dotted or in brackets, and has a text behind it
    first = F.split("line", r"\s+", 2)
    digits = F.translate(F.rtrim(F.get(first, F.lit(0))), "[].", "")
    starts = digits.rlike("^[0-9]{1,3}$") & F.coalesce(F.length(F.get(first, F.lit(1))) > 0, F.lit(False))
    r = typed.where("type = 'reference'").withColumn("n", F.sum(starts.cast("int")).over(w))
    r = r.groupBy("paper_id", "n").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "line"))).alias("ls"))
    return r.select("paper_id", (F.row_number().over(Window.partitionBy("paper_id").orderBy("n"))).alias("ref_no"), F.array_join(F.transform("ls", lambda x: x["line"]), " ").alias("entry"))


def doi_and_year(pages: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """(paper_id, doi, publication_year): the first DOI of the first page, else of the last, else of title or journal; the
    first plausible year after a word like Published on the first page, else the last, else any year there, else that of
    the creation date; NONE where there is none. ``info``: (paper_id, title, journal, creation_date), all of them optional."""
    this_year = date.today().year + 1
    edge = pages.groupBy("paper_id").agg(F.min_by("text", "page").alias("first"), F.max_by("text", "page").alias("last"))
    if info is not None:
        edge = edge.join(info.select("paper_id", *(F.col(c) if c in info.columns else F.lit(None).cast("string").alias(c) for c in ("title", "journal", "creation_date"))), "paper_id", "left")
    else:
        edge = edge.withColumns({c: F.lit(None).cast("string") for c in ("title", "journal", "creation_date")})

    def found(c: str) -> Column:
        return F.nullif(F.rtrim(F.regexp_extract(c, DOI, 1), F.lit(".,;)")), F.lit(""))

    def plausible(y: Column) -> Column:
        return F.when(y.cast("int").between(1950, this_year), y)

    near = rf"(?iu)(?:{'|'.join(YEAR_WORDS)})\D{{0,20}}([0-9]{{4}})"
    told = [plausible(F.nullif(F.regexp_extract(c, near, 1), F.lit(""))) for c in ("first", "last")]
    any_ = [F.try_element_at(F.filter(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int").between(1950, this_year)), F.lit(1)) for c in ("first", "last")]
    made = plausible(F.nullif(F.regexp_extract("creation_date", "((?:19|20)[0-9]{2})", 1), F.lit("")))
    return edge.select("paper_id", F.coalesce(*(found(c) for c in ("first", "last", "title", "journal")), F.lit("NONE")).alias("doi"), F.coalesce(*told, *any_, made, F.lit("NONE")).alias("publication_year"))
