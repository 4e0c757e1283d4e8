"""Where pages come from and where tables go: directories of files, HTML pages, grids; Parquet, CSV, JSON and XLSX.

Decoding PDF files, OCR and ruled-table detection need libraries that aren't part of this package; they are callables
given to :func:`decode_files`, run in Arrow batches, so that a failure of one file leaves a row and not a failed job.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pages with fewer characters than this are given to OCR.
OCR_BELOW = 50
_PAGES = T.StructType([T.StructField("paper_id", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def files(spark: SparkSession, folder: str, ending: str = ".pdf") -> DataFrame:
    """(paper_id, path, modificationTime, length, content) of a folder's own files with an ending, in any letter case."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return f.where(F.lower("path").endswith(ending.lower())).withColumn("paper_id", F.regexp_extract("path", r"([^/]+)$", 1))


def decode_files(binary: DataFrame, decode: Callable[[bytes], list[str]], ocr: Callable[[bytes, int], str | None] | None = None) -> DataFrame:
    """(paper_id, page, text, error): the pages of each file; nearly empty pages go to ``ocr``, whose failure keeps the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for name, content in zip(b["paper_id"], b["content"]):
                try:
                    for i, text in enumerate(decode(bytes(content)), 1):
                        if ocr and len(text.strip()) < OCR_BELOW:
                            try:
                                text = ocr(bytes(content), i) or text
                            except Exception:  # noqa: BLE001 - a plugin may raise anything
                                pass
                        rows.append((name, i, text, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((name, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=_PAGES.names)

    return binary.select("paper_id", "content").mapInPandas(run, _PAGES)


def ordered_text(spans: DataFrame, middle: float) -> DataFrame:
    """(paper_id, page, text) from text spans (paper_id, page, seq, x, y, text): left column before right, each from the top."""
    key = F.struct((F.col("x") >= middle).cast("int").alias("side"), F.round("y", 1).alias("y"), "seq", "text")
    return spans.groupBy("paper_id", "page").agg(F.array_sort(F.collect_list(key)).alias("s")).select("paper_id", "page", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("text"))


def title_from_spans(spans: DataFrame) -> DataFrame:
    """(paper_id, title): the text of the largest font on page 1 that is longer than five characters, the first of equals."""
    first = spans.where("page = 1") if "page" in spans.columns else spans
    return first.where("length(trim(text)) > 5").groupBy("paper_id").agg(F.trim(F.max_by("text", F.struct("size", -F.col("seq")))).alias("title"))


def paper_info(embedded: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(paper_id, title, authors, journal, creation_date) from the metadata embedded in files (paper_id, title, author, subject,
    creation_date) and, where a title is missing or says "untitled", from the fonts of the first page; null if nothing says it."""

    def told(c: str):
        return F.nullif(F.trim(c), F.lit(""))

    bad = F.col("title").isNull() | (F.col("title") == "") | F.lower("title").contains("untitled")
    i = embedded.withColumn("title", F.when(~bad, F.col("title")))
    if spans is not None:
        i = i.join(title_from_spans(spans).withColumnRenamed("title", "_large"), "paper_id", "left")
    else:
        i = i.withColumn("_large", F.lit(None).cast("string"))
    # without a large font the title stays as it was embedded
    i = i.join(embedded.select("paper_id", F.col("title").alias("_was")), "paper_id", "left")
    return i.select("paper_id", F.coalesce(told("title"), told("_large"), told("_was")).alias("title"), told("author").alias("authors"), told("subject").alias("journal"), told("creation_date").alias("creation_date"))


_GRIDS = T.StructType([T.StructField("paper_id", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("t_idx", T.IntegerType()), T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("error", T.StringType())])


def decode_tables(binary: DataFrame, decode: Callable[[bytes], list[list[list[list[str | None]]]]]) -> DataFrame:
    """(paper_id, page, t_idx, cells, error): the ruled tables of each page of each file, as ``decode`` finds them (pages of
    tables of rows of cells). A file whose tables can't be read gives one row with the error and no others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for name, content in zip(b["paper_id"], b["content"]):
                try:
                    rows += [(name, p, t, [[None if c is None else str(c) for c in r] for r in grid], None) for p, grids in enumerate(decode(bytes(content)), 1) for t, grid in enumerate(grids, 1)]
                except Exception as e:  # noqa: BLE001 - a plugin may raise anything
                    rows.append((name, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=_GRIDS.names)

    return binary.select("paper_id", "content").mapInPandas(run, _GRIDS)


@F.pandas_udf(T.StringType())
def html_text(markup: pd.Series) -> pd.Series:
    """The text of HTML, block elements ending lines, entities resolved."""

    def plain(m: str | None) -> str | None:
        if m is None:
            return None
        m = re.sub(r"(?is)<(script|style)\b.*?</\1>", "", m)
        m = re.sub(r"(?i)<(?:br|/p|/div|/h\d|/li|/tr)\s*/?>", "\n", m)
        return html.unescape(re.sub(r"(?s)<[^>]+>", "", m))

    return markup.map(plain)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs as JSON text."""
    flat = df.select(*(F.to_json(F.col(c)).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes))
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


BOM = "\ufeff"


def append_csv(df: DataFrame, path: str, batch: str) -> None:
    """Add a batch to a CSV table: a folder of files that spreadsheets read, each in UTF-8 with a byte order mark and a header.
    Writing the batch again replaces it. Nulls and empty texts are NONE; arrays, maps and structs are JSON text."""
    flat = df.select(*(F.to_json(F.col(c)).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string").alias(c) for c, t in df.dtypes))
    flat = flat.select(*(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("NONE")).alias(c) for c in flat.columns))
    # the mark goes before the first column's name, where each file's header begins
    flat = flat.withColumnRenamed(flat.columns[0], BOM + flat.columns[0])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').option("quote", '"').option("encoding", "UTF-8").csv(f"{path}/batch={batch}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table written by :func:`append_csv`, all batches, texts as they are; columns that a batch lacks are null."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return df.select(*(F.col(f"`{c}`").alias(c.lstrip(BOM)) for c in df.columns if c != "batch"))


def append_table(df: DataFrame, path: str, batch: str) -> None:
    """Append as a partition of its batch; writing the batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def append_json(df: DataFrame, path: str, key: str = "paper_id") -> None:
    """Append records whose key isn't there yet."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df = df.join(spark.read.json(path).select(key).distinct(), key, "left_anti")
    df.write.mode("append").json(path)


def write_xlsx(tables: dict[str, DataFrame], path: str, most_rows: int = 1_000_000) -> None:
    """One sheet a table on the driver, for tables within a sheet's size only; rows of sheets that are there already come first."""
    import os

    old = pd.read_excel(path, sheet_name=None) if os.path.exists(path) else {}
    sheets = {}
    for name, df in tables.items():
        if df.limit(most_rows + 1).count() + len(old.get(name[:31], ())) > most_rows:
            raise ValueError(f"{name} has more rows than a sheet can hold")
        sheets[name[:31]] = pd.concat([old.get(name[:31]), df.toPandas()], ignore_index=True) if name[:31] in old else df.toPandas()
    with pd.ExcelWriter(path) as book:
        for name, frame in (old | sheets).items():
            frame.fillna("NONE").replace("", "NONE").to_excel(book, sheet_name=name, index=False)
