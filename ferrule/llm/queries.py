"""Queries of the operators on training texts, over their whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import encode, history, packing, scan_repair, subjects, survivors
from ferrule.session import table, written


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.scanned_texts({t: table(spark, sf_dir, t) for t, _, _ in scan_repair.SOURCES})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repair of the scanned texts."""
    return scan_repair.find_repairs(_scanned(spark, sf_dir))


def p3_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned texts as continuous text."""
    return scan_repair.repaired(_scanned(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each papers row whose work came before, with the row that was first: the batches taken in one after the other."""
    return history.repeats(table(spark, sf_dir, "papers").select("paper_id", "title", "doi", "filename", "batch_no"), batch="batch_no")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record for each group of duplicate mentions."""
    return survivors.survivors(table(spark, sf_dir, "mentions"))


def p7_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of highest support for each field of each group of duplicate mentions, by truth discovery."""
    return survivors.discover_truth(table(spark, sf_dir, "mentions"))[0]


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    return encode.encode(table(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, DataFrame]]:
    counts = written(encode.token_counts(table(spark, sf_dir, "documents")), "token-counts")
    sizes = table(spark, sf_dir, "capacities").select("container_kind", "capacity_tokens").distinct().collect()  # a table of fixed size
    return [(k, int(c), packing.pack(counts, int(c))) for k, c in sorted(sizes)]


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document, or each piece of it, goes for each capacity."""
    return reduce(DataFrame.unionByName, (df.withColumn("container_kind", F.lit(k)) for k, _, df in _packed(spark, sf_dir)))


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind of container: how many documents are placed, how many containers hold too much, and how many documents
    are cut that a container could have held."""
    return reduce(DataFrame.unionByName, (packing.fill(df, c).select(F.lit(k).alias("container_kind"), "n_items", "n_over", "n_cut") for k, c, df in _packed(spark, sf_dir)))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each kind are."""
    return reduce(DataFrame.unionByName, (packing.fill(df, c).select(F.lit(k).alias("container_kind"), "n_containers", "fill") for k, c, df in _packed(spark, sf_dir)))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects that each document is about."""
    return subjects.subjects_of(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subjects")))


def p10_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject mixture of each document, and the share of each subject in its sentences."""
    return subjects.mixtures(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subjects")))


QUERIES = {"p3_found": p3_found, "p3_texts": p3_texts, "p5_found": p5_found, "p7_found": p7_found, "p7_truth": p7_truth, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_invariants": p9_invariants, "p9_fill": p9_fill, "p10_found": p10_found, "p10_mixtures": p10_mixtures}
MISSING = "('', 'none', 'null', 'nil', 'nan', 'n/a', 'n.a.', 'na', 'n.d.', 'nd', '-', '--', '---', '–', '—', '?', 'unknown', 'missing', 'not available', 'not given', 'untitled', 'tbd')"


def _field(f: str, more: str = "") -> str:
    return f"coalesce(max(struct_pack(c := c, t := t, i := -mention_id, v := trim({f}))) filter (where {f} is not null and lower(trim({f})) not in {MISSING}{more}).v, 'NONE')"


ORACLES = {
    "p9_invariants": "select container_kind, (select count(distinct doc_id) from documents) as n_items, 0 as n_over, 0 as n_cut from capacities",
    "p7_found": f"""
with m as (select *, coalesce(cast(round(round(case when confidence is null or isnan(confidence) or confidence < 0 or confidence > 100 then null when confidence > 1 then confidence / 100 else confidence end * 1000, 6)) as bigint), -1) as c,
  coalesce(epoch_us(extracted_at), -9223372036854775808) as t from mentions where dup_group is not null)
select dup_group, {_field("normalized_value")} as normalized_value, {_field("ea_type", " and lower(trim(ea_type)) <> 'unspecified'")} as ea_type,
  {_field("section")} as section, greatest(max(c), 0) as conf_milli from m group by dup_group""",
}
