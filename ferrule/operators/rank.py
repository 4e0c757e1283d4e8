"""Ranking of competing mentions: agreement, duplicates, top five, and capped relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NONE = "NONE"
TOP, CAP, TABLE_ROW = 5, 3, 0.95
KEY = ("block_no", "sent_no", "prop_idx", "match_no")


def agree(mention_rows: DataFrame) -> DataFrame:
    """Confidence raised where mentions of a paper state one value, where its abstract or conclusion does, and where a table row links it."""
    w = Window.partitionBy("paper_id", "category", "property_name", "normalized_value")
    core = F.col("section").isin("Abstract", "Conclusion")
    n = F.count("*").over(w)
    boost = F.when(n > 1, F.least(F.lit(0.15), 0.05 * F.log2(n + 1))).otherwise(0.0)
    boost = boost + F.when(F.max(core).over(w) & ~core, 0.1).otherwise(0.0) + F.when(F.coalesce(F.col("extraction_method").isin("dependency_parse", "table_row"), F.lit(False)), 0.1).otherwise(0.0)
    return mention_rows.withColumn("confidence", F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("confidence") + boost)), 6))


def ranked(mention_rows: DataFrame) -> DataFrame:
    """The best mention of each value and type, and of those the best five of each property and type, with their ``rank``."""
    best = Window.partitionBy("paper_id", "category", "property_name", "normalized_value", "ea_type").orderBy(F.desc("confidence"), *KEY)
    one = agree(mention_rows).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    top = Window.partitionBy("paper_id", "category", "property_name", "ea_type").orderBy(F.desc("confidence"), *KEY)
    return one.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= TOP)


def relations(linked: DataFrame, cap: int = CAP) -> DataFrame:
    """Links of mentions to materials, at most ``cap`` of each material, property and value, the surest first. A link is as
    sure as its sentence and a little more, however many agree; one of a table row has the confidence of table rows."""
    w = Window.partitionBy("paper_id", "formula", "category", "property_name", "normalized_value").orderBy(F.desc("relation_confidence"), *KEY)
    sure = F.when(F.col("extraction_method") == "table_row", F.lit(TABLE_ROW)).otherwise(F.round(F.least(F.lit(0.99), F.col("score") + 0.1), 6))
    r = linked.where("formula is not null").withColumn("relation_confidence", sure)
    return r.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
