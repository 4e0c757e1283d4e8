"""Queries of the record-processing operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.text import MISSING
from ferrule.operators import ledger, nested, quantities, split_values
from ferrule.session import table, written


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers rows that each successful run had to process: the items of the ledger that it leased and brought to done."""
    rows = table(spark, sf_dir, "papers").select("paper_id", "filename", "batch_no", "content_md5")
    items = ledger.replay(rows, table(spark, sf_dir, "run_log"), key=ledger.file_key(F.col("filename")), row_id="paper_id", batch="batch_no", fingerprint=F.col("content_md5"))
    return items.where("state = 'done'").select("run_id", "paper_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per author of each paper."""
    return split_values.split_names(table(spark, sf_dir, "papers").select("paper_id", "authors"), "paper_id", "authors")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials, elements, properties and relations of each exported record."""
    return nested.children(written(nested.nodes(table(spark, sf_dir, "paper_records").select("record_id", "payload")), "record-nodes"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stated quantity in the common unit of its property."""
    return quantities.in_common_units(table(spark, sf_dir, "mentions"), table(spark, sf_dir, "property_kinds"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p6_found": p6_found}
_BLANKS = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_STATED = "lower({0}) not in (" + ", ".join("'" + m + "'" for m in MISSING) + ")"
_OK = ", ".join(f"'{d}'" for d in ledger.DONE)
ORACLES: dict[str, str] = {
    "p1_found": f"""
with named as (select paper_id, batch_no, regexp_replace(filename, '^{_BLANKS}+|{_BLANKS}+$', '', 'g') as n, trim(content_md5) as h from papers),
 decoded as (select *, nfc_normalize(case when regexp_matches(n, '%[0-9A-Fa-f]{{2}}') then url_decode(n) else n end) as d from named),
 items as (select paper_id, batch_no, case when {_STATED.format("n")} then lower(regexp_replace(regexp_replace(regexp_replace(d, '{_BLANKS}+$', ''), '^.*[/\\\\]', ''), '^{_BLANKS}+|{_BLANKS}+$', '', 'g')) end as f,
   case when {_STATED.format("h")} then lower(h) end as fp from decoded),
 runs as (select run_id, last_batch as hi, coalesce(max(last_batch) over (order by run_id rows between unbounded preceding and 1 preceding), -2147483648) as lo from run_log where lower(trim(status)) in ({_OK}) and last_batch is not null),
 last as (select coalesce(f, chr(1) || paper_id) as key, run_id, max_by(paper_id, struct_pack(b := batch_no, p := paper_id)) as paper_id, max_by(struct_pack(fp := fp), struct_pack(b := batch_no, p := paper_id)).fp as fp
   from items join runs on batch_no <= hi and batch_no > lo group by 1, 2),
 seen as (select *, row_number() over w as n, lag(fp) over w as before from last window w as (partition by key order by run_id))
select run_id, paper_id from seen where n = 1 or fp is null or before is null or fp <> before""",
}
