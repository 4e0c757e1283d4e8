"""Processing only new or changed records."""

import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from ferrule.operators import ledger

PAPERS = "paper_id string, filename string, batch_no int, content_md5 string"
RUNS = "run_id int, status string, last_batch int"


def replayed(spark, papers, runs):
    p, r = spark.createDataFrame(papers, PAPERS), spark.createDataFrame(runs, RUNS)
    out = ledger.replay(p, r, key=ledger.file_key(F.col("filename")), row_id="paper_id", batch="batch_no", fingerprint=F.col("content_md5"))
    return sorted((x.run_id, x.paper_id) for x in out.where("state = 'done'").collect())


@pytest.mark.parametrize(
    ("name", "key"),
    [("  /data/in/Über A.PDF\t", "über a.pdf"), ("inbox\\x (1).pdf", "x (1).pdf"), (unicodedata.normalize("NFD", "Über A.pdf"), "über a.pdf"), ("%C3%9Cber%20A.pdf", "über a.pdf"), ("50% a.pdf", "50% a.pdf"), ("a+b.pdf", "a+b.pdf"), ("a_copy1.pdf", "a_copy1.pdf"), ("NONE", None), ("", None), (None, None)],
)
def test_file_key(spark, name, key):
    assert spark.createDataFrame([(name,)], "f string").select(ledger.file_key(F.col("f"))).first()[0] == key


def test_cases(spark):
    papers = [("1", "a", 1, "x"), ("2", "A ", 2, "X"), ("3", "a", 3, "y"), ("4", "b", 3, None), ("5", "b", 4, "q"), ("6", "b", 5, "q"), ("7", "c", 5, "m"), ("8", "c", 5, "n"), ("8", "c", 5, "n"), ("9", None, 1, "z"), ("10", "d", None, "z"), ("11", "e", 9, "z")]
    runs = [(1, "success", 1), (2, "FAILED", 2), (3, "Succeeded", 3), (4, "ok", 4), (5, "SUCCESS", 5), (6, "running", 9)]
    # the failed run's rows come to the next one; an unchanged file is no case; a missing fingerprint always is
    assert replayed(spark, papers, runs) == [(1, "1"), (1, "9"), (3, "3"), (3, "4"), (4, "5"), (5, "8")]


def test_empty(spark):
    assert replayed(spark, [], [(1, "success", 1)]) == []
    assert replayed(spark, [("1", "a", 1, "x")], []) == []


def test_brute_force(spark, sf):
    import __spark_entry__ as e

    got = sorted((x.run_id, x.paper_id) for x in e.queries()["p1_found"](spark, sf).collect())
    con = duckdb.connect()
    rows = con.execute(f"select paper_id, filename, batch_no, content_md5 from '{sf}/papers.parquet'").fetchall()
    runs = con.execute(f"select run_id, status, last_batch from '{sf}/run_log.parquet' order by run_id").fetchall()
    done, seen, want = {}, 0, []
    for run, status, last in runs:
        if not status.lower().startswith("succe"):
            continue
        latest = {}
        for pid, name, batch, md5 in sorted(rows, key=lambda r: (r[2], r[0])):
            if seen < batch <= last:
                key = unicodedata.normalize("NFC", name.strip().replace("\\", "/").rsplit("/", 1)[-1].strip()).lower()
                latest[key] = (pid, md5.lower() if md5 else None)
        for key, (pid, md5) in latest.items():
            if key not in done or md5 is None or done[key] is None or done[key] != md5:
                want.append((run, pid))
                done[key] = md5
        seen = last
    assert got == sorted(want)


PASSES = [("01", "a", 1, "x"), ("02", "b", 1, "k"), ("03", "a", 2, "x"), ("04", "b", 2, "l"), ("05", "c", 3, None), ("06", "c", 4, None), ("07", "a", 4, "w")]


def seen_to(spark, last):
    p = spark.createDataFrame(PASSES, PAPERS)
    return p.where(F.col("batch_no") <= last).select(ledger.file_key(F.col("filename")).alias("key"), F.col("paper_id").alias("row"), F.col("batch_no").alias("batch"), F.col("content_md5").alias("fp"))


def some(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "row string")


def rows(df):
    return sorted(r.row for r in df.collect())


def test_states_leases_and_paths(spark):
    p, r = spark.createDataFrame(PASSES, PAPERS), spark.createDataFrame([(1, "ok", 1), (2, "failed", 2), (3, "killed", 3), (4, "ok", 3), (5, "ok", 4)], RUNS)
    out = ledger.replay(p, r, key=ledger.file_key(F.col("filename")), row_id="paper_id", batch="batch_no", fingerprint=F.col("content_md5"), folder="/o")
    assert sorted((x.paper_id, x.run_id, x.state, x.expired, x.path) for x in out.collect()) == [
        ("01", 1, "done", [], "/o/token=00000001"), ("02", 1, "done", [], "/o/token=00000001"), ("03", 4, "unchanged", [2, 3], "/o/token=00000004"), ("04", 4, "done", [2, 3], "/o/token=00000004"),
        ("05", 4, "done", [3], "/o/token=00000004"), ("06", 5, "done", [], "/o/token=00000005"), ("07", 5, "done", [], "/o/token=00000005"),
    ]


def test_ledger_steps_equal_replay(spark, tmp_path):
    book, out, now = ledger.WorkLedger(spark, f"{tmp_path}/ledger", ttl=10), [], 0.0
    for token, last, dies in [(1, 1, False), (2, 2, True), (3, 3, False), (4, 4, False)]:
        now += 20
        leased = book.lease(seen_to(spark, last), token, now)
        again = book.lease(seen_to(spark, last), token, now)  # a retry gets the same items
        assert rows(leased) == rows(again)
        if not dies:
            book.commit(token, again.select("row"))
            out += [(token, r) for r in rows(again)]
    assert out == replayed(spark, PASSES, [(1, "success", 1), (2, "failed", 2), (3, "success", 3), (4, "success", 4)])
    with pytest.raises(ledger.StaleToken):
        book.commit(2, some(spark, "04"))
    assert sorted((r.token, r.row) for r in book.done().collect()) == out
    assert book.output_path(3) == book.output_path(3)


def test_partial_commit_loses_and_repeats_nothing(spark, tmp_path):
    """A run that processed one of two items commits that one; the other comes to the next run, and so does what it supersedes."""
    book = ledger.WorkLedger(spark, f"{tmp_path}/ledger")
    assert rows(book.lease(seen_to(spark, 2), 1)) == ["03", "04"]
    book.commit(1, some(spark, "04"))
    assert {r.row: r.state for r in book.table().collect()} == {"01": "pending", "02": "settled", "03": "pending", "04": "done"}
    assert rows(book.lease(seen_to(spark, 2), 2)) == ["03"]
    book.commit(2, some(spark, "03"))
    assert rows(book.lease(seen_to(spark, 2), 3)) == []
    assert sorted((r.row, r.token) for r in book.done().collect()) == [("03", 2), ("04", 1)]


def test_live_lease_is_left_alone_and_a_stale_writer_undoes_nothing(spark, tmp_path):
    book = ledger.WorkLedger(spark, f"{tmp_path}/ledger", ttl=100)
    assert rows(book.lease(seen_to(spark, 1), 1, now=0.0)) == ["01", "02"]
    assert rows(book.lease(seen_to(spark, 3), 2, now=50.0)) == ["05"]  # files a and b are still being worked on
    book.commit(2, some(spark, "05"))
    assert rows(book.lease(seen_to(spark, 3), 3, now=150.0)) == ["03", "04"]
    with pytest.raises(ledger.StaleToken):
        book.commit(1, some(spark, "01", "02"))
    book._append(book.log().where("token = 1").withColumn("state", F.lit("done")), 1, 1)  # what a writer appends after it lost its lease
    assert {r.row for r in book.done().collect()} == {"05"}
    book.commit(3, some(spark, "03", "04"))
    assert sorted((r.row, r.token) for r in book.done().collect()) == [("03", 3), ("04", 3), ("05", 2)]
    with pytest.raises(ledger.StaleToken):
        book.lease(seen_to(spark, 4), 0, now=500.0)


def test_a_token_has_one_owner(spark, tmp_path):
    book = ledger.WorkLedger(spark, f"{tmp_path}/ledger")
    assert book.claim(1) and not book.claim(1)
    assert [book.next_token(), book.next_token()] == [2, 3]
