"""The best representative of each group of duplicate records, field by field.

:func:`survivors` follows a fixed order of trust: confidence, then recency, then the smallest id, among the records that
state the field. :func:`discover_truth` is iterative truth discovery for groups without a dependable confidence: it
estimates each source's reliability from how much its values are supported, and each value's support from the
reliability of the sources that state it, in turn until the reliabilities settle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import stated
from ferrule.session import discard, stored

NONE = "NONE"
#: Sources whose reliabilities are broadcast, at most.
BROADCAST_SOURCES = 1_000_000
#: What states nothing besides the usual words, by field.
EMPTY = {"ea_type": ("unspecified",)}


def confidence_milli(c: Column) -> Column:
    """A confidence in thousandths: shares as they are, percentages above 1 scaled down; null for gaps and sentinels."""
    share = F.when(F.isnan(c) | (c < 0) | (c > 100), None).when(c > 1, c / 100).otherwise(c)
    return F.round(F.round(share * 1000, 6)).cast("long")


def value_of(field: str) -> Column:
    """The trimmed text of a field, null where it states nothing."""
    v = stated(F.col(field))
    return F.when(~F.lower(v).isin(*EMPTY[field]), v) if field in EMPTY else v


def survivors(records: DataFrame, group: str = "dup_group", fields: tuple[str, ...] = ("normalized_value", "ea_type", "section"), record_id: str = "mention_id", confidence: str = "confidence", recency: str = "extracted_at") -> DataFrame:
    """One record a group: each field from the record of highest confidence that states it, then the most recent, then the smallest id.

    Unknown confidences are lowest, null times oldest; a field that no record states is NONE; conf_milli is the group's
    highest confidence in thousandths, 0 if unknown. Rows without a group don't take part, repeated rows change nothing.
    One aggregation with partial maxima before the shuffle, so a group of any size costs one row a task.
    """
    milli = confidence_milli(F.col(confidence).cast("double"))
    when = F.unix_micros(F.col(recency).cast("timestamp")) if dict(records.dtypes)[recency] == "timestamp" else F.unix_micros(F.to_utc_timestamp(F.col(recency), "UTC"))
    key = (F.coalesce(milli, F.lit(-1)).alias("c"), F.coalesce(when, F.lit(-(2**63))).alias("t"), (-F.col(record_id)).alias("i"))
    rows = records.where(F.col(group).isNotNull()).select(F.col(group), milli.alias("_m"), *(F.when(value_of(f).isNotNull(), F.struct(*key, value_of(f).alias("v"))).alias(f) for f in fields))
    best = rows.groupBy(group).agg(*(F.max(f).alias(f) for f in fields), F.max("_m").alias("conf_milli"))
    return best.select(group, *(F.coalesce(F.col(f"{f}.v"), F.lit(NONE)).alias(f) for f in fields), F.coalesce("conf_milli", F.lit(0)).alias("conf_milli"))


def discover_truth(records: DataFrame, group: str = "dup_group", fields: tuple[str, ...] = ("normalized_value", "ea_type", "section"), source: tuple[str, ...] = ("source_type", "paper_id"), record_id: str = "mention_id", rounds: int = 200, settled: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """(values, reliabilities): the value of highest support for each field of each group, and each source's reliability.

    values: (group, field, value, support from 0 to 1, n_values); ties go to the smaller value. A source is a combination
    of ``source`` columns, null counting as one of them; repeated records count once. All claims take part in each round;
    the claims are aggregated to (group, field, value, source) first, so that rounds don't see records again. Rounds go on
    until no reliability changes by ``settled`` or more; if ``rounds`` aren't enough for that, it is an error.
    """
    claim = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), value_of(f).alias("value")) for f in fields))).alias("x")
    who = F.concat_ws("\u0001", *(F.coalesce(F.col(s).cast("string"), F.lit(NONE)) for s in source)).alias("source")
    claims = records.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(record_id).alias("r"), who, claim).select("g", "r", "source", "x.field", "x.value").where("value is not null").distinct()
    claims = stored(claims.groupBy("g", "field", "value", "source").agg(F.count("*").alias("n")), "truth-claims")
    trust = stored(claims.select("source").distinct().withColumn("trust", F.lit(0.8)), "truth-trust")
    # sources are skewed, so that their reliabilities go to the claims rather than both by source, as far as their number allows
    by = (lambda t: F.broadcast(t)) if trust.count() <= BROADCAST_SOURCES else (lambda t: t)

    def voted() -> DataFrame:
        votes = claims.join(by(trust), "source").withColumn("w", F.col("n") * F.log((1 + F.col("trust")) / (1.02 - F.col("trust"))))
        return votes.groupBy("g", "field", "value").agg(F.sum("w").alias("w"))

    for _ in range(rounds):
        w = voted()
        share = w.groupBy("g", "field").agg(F.sum("w").alias("all"))
        support = w.join(share, ["g", "field"]).select("g", "field", "value", (F.col("w") / F.col("all")).alias("support"))
        fresh = claims.join(support, ["g", "field", "value"]).groupBy("source").agg(F.sum(F.col("n") * F.col("support")).alias("s"), F.sum("n").alias("m"))
        # two pseudo-claims at 0.8 keep sources with few claims from running to the ends
        fresh = stored(fresh.select("source", ((F.col("s") + 1.6) / (F.col("m") + 2)).alias("trust")), "truth-trust")
        change = fresh.join(trust.withColumnRenamed("trust", "old"), "source").agg(F.max(F.abs(F.col("trust") - F.col("old")))).first()[0] or 0.0
        discard(trust)
        trust = fresh
        if change < settled:
            break
    else:
        raise RuntimeError(f"reliabilities still change by {change:.4f} after {rounds} rounds")
    best = voted().groupBy("g", "field").agg(F.max_by("value", F.struct(F.col("w"), F.hex("value"))).alias("value"), (F.max("w") / F.sum("w")).alias("support"), F.count("*").alias("n_values"))
    return best.withColumnRenamed("g", group), trust
