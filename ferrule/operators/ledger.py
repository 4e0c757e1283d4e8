"""Processing only new or changed records: a ledger of work items.

A *work item* is one delivered row of a keyed record (here a paper's file). It is ``pending`` until a run leases it,
``leased`` until that run commits or its lease expires, and ``done`` once it was processed by a run that committed. Each
run has a *fencing token* (its place in the order of runs). An expired lease makes its items pending again, and the next
run leases them under its own, larger token; a commit with the smaller token counts for nothing after that. What a run
writes lies in a folder whose name follows from the token alone, so a retry replaces its own output and nothing else.

Two forms share these rules:

* :func:`replay` passes all items of a history through a whole run log at once: it gives the run that finished each item,
  the runs before it whose leases expired, its state and the place of its output. There is no loop over runs and no join.
* :class:`WorkLedger` keeps the ledger for runs as they happen, as a log of transitions that is only appended to.
"""

from __future__ import annotations

import time

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions.text import BLANK, nfc, stated

DONE = ("success", "succeeded", "successful", "ok", "done", "completed", "complete", "finished")


def file_key(name: Column) -> Column:
    """One spelling of a file's name: no location, lower case, percent signs decoded, composed accents, no outer blanks.

    Copy and version marks stay, as they make another name. A missing name gives null.
    """
    n = stated(name)
    n = F.when(n.rlike("%[0-9A-Fa-f]{2}"), F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_replace(n, r"\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25")), n)).otherwise(n)
    n = F.when(n.rlike(r"[^\x00-\x7F]"), nfc(n)).otherwise(n)
    n = F.regexp_replace(F.regexp_replace(n, f"{BLANK}+$", ""), r"^.*[/\\]", "")
    return F.lower(F.regexp_replace(n, f"^{BLANK}+|{BLANK}+$", ""))


def output_path(folder: str, token: Column | int) -> Column | str:
    """Where the run with this token writes; the same for each retry."""
    return f"{folder}/token={token:08d}" if isinstance(token, int) else F.concat(F.lit(f"{folder}/token="), F.lpad(token.cast("string"), 8, "0"))


class Runs:
    """The run log as spans of batches: span k holds the batches that the k-th committed run is the first to have seen."""

    def __init__(self, run_log: DataFrame):
        rows = run_log.select("run_id", F.lower(F.trim("status")).isin(*DONE).alias("ok"), "last_batch").where("run_id is not null and last_batch is not null").orderBy("run_id").collect()  # one row a run
        self.spans: list[tuple[int, int, list[tuple[int, int]]]] = []  # (run, last batch, runs that died before it)
        died: list[tuple[int, int]] = []
        for r in rows:
            if not r["ok"]:
                died.append((r["run_id"], r["last_batch"]))
            elif not self.spans or r["last_batch"] > self.spans[-1][1]:
                self.spans.append((r["run_id"], r["last_batch"], died))
                died = []
            else:
                died = []

    def leases(self, items: DataFrame, batch: str) -> DataFrame:
        """Items with ``token`` (the run that finishes them) and ``expired`` (the runs that leased them and died, in order);
        items that no committed run has seen are left out. The span is found by binary search, so nothing is joined."""
        ends = sorted({-float(last) for _, last, _ in self.spans})
        at = Bucketizer(splits=[float("-inf"), *ends, float("inf")], inputCol="_at", outputCol="_span", handleInvalid="skip")
        found = at.transform(items.where(F.col(batch).isNotNull()).withColumn("_at", -F.col(batch).cast("double"))).where("_span > 0")
        k = F.lit(len(self.spans) + 1) - F.col("_span").cast("int")
        tokens = F.array(*(F.lit(run).cast("int") for run, _, _ in self.spans))
        dead = F.array(*(F.array(*(F.struct(F.lit(r).cast("int").alias("run"), F.lit(b).cast("long").alias("last")) for r, b in died)).cast("array<struct<run:int,last:bigint>>") for _, _, died in self.spans))
        found = found.withColumns({"token": F.element_at(tokens, k), "_dead": F.element_at(dead, k)})
        return found.withColumn("expired", F.transform(F.filter("_dead", lambda d: d["last"] >= F.col(batch)), lambda d: d["run"])).drop("_at", "_span", "_dead")


def replay(rows: DataFrame, run_log: DataFrame, *, key: Column, row_id: str, batch: str, fingerprint: Column, folder: str = "out") -> DataFrame:
    """The newest item of each key that each committed run leased: (run_id, ``row_id``, state, expired, path).

    Of the rows that a committed run saw and no committed run before it, the last row of each key (highest batch, then
    largest id) is leased; the older ones are superseded by it and don't come out. Its state is ``done`` if its key was
    never processed, if its fingerprint differs from the one last processed, or if either fingerprint is missing, and
    ``unchanged`` otherwise. Runs that failed finish nothing: they are in ``expired``, and the next committed run takes
    their items over. ``path`` is where the run that finished the item wrote.

    Rows without a key stand for themselves. Rows with a null batch are never seen. Rows of batches beyond the last
    committed run stay pending and don't come out. A repeated row counts once. An empty table or run log gives no rows.
    """
    runs = Runs(run_log)
    items = rows.select(F.coalesce(key, F.concat(F.lit("\u0000"), F.col(row_id).cast("string"))).alias("_key"), F.col(row_id).alias("_row"), F.col(batch).alias("_batch"), F.lower(stated(fingerprint)).alias("_fp"))
    if not runs.spans:
        items = items.limit(0).withColumns({"token": F.lit(0), "expired": F.array().cast("array<int>")})
    else:
        items = runs.leases(items, "_batch")
    # the superseded rows go in a map-side combined aggregate, so that a hot key shuffles few rows
    last = items.groupBy("_key", "token").agg(F.max(F.struct("_batch", "_row", "_fp", "expired")).alias("_last"))
    w = Window.partitionBy("_key").orderBy("token")
    last = last.select("_key", "token", "_last.*").withColumn("_before", F.lag(F.struct("_fp")).over(w))
    # an unchanged row has the fingerprint of the one last processed, so the row before stands for it
    case = F.col("_before").isNull() | F.col("_fp").isNull() | F.col("_before._fp").isNull() | (F.col("_fp") != F.col("_before._fp"))
    return last.select(F.col("token").alias("run_id"), F.col("_row").alias(row_id), F.when(case, "done").otherwise("unchanged").alias("state"), "expired", output_path(folder, F.col("token")).alias("path"))


class StaleToken(RuntimeError):
    """A run tried to lease or commit with a token that a newer run has taken over from."""


class WorkLedger:
    """A ledger in a folder that all executors share: a log of transitions of items, which is only appended to.

    Each step of a run (its lease, its commits) is one folder named after token and step. A token is claimed by creating
    its file, which only one writer can. An item's state follows from the log alone: the transition of the largest token
    decides, so what a stale writer appends late can't undo anything. A run appends its own transitions only; the state of
    past items is read from narrow rows.

    Transitions: ``leased`` (to be processed), ``unchanged`` and ``superseded`` (to be settled with the key's leased row)
    at the lease; ``done``, ``settled`` and ``released`` (back to pending) at the commit.
    """

    SCHEMA = "key string, row string, batch int, fp string, state string, expires double, token int, step int"

    def __init__(self, spark: SparkSession, folder: str, ttl: float = 3600.0):
        self.spark, self.folder, self.ttl = spark, folder.rstrip("/"), ttl

    def _path(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def claim(self, token: int) -> bool:
        """Claim a token for this writer; False if another has it."""
        path, fs = self._path("tokens", f"{token:08d}")
        return bool(fs.createNewFile(path))

    def next_token(self) -> int:
        """Claim the smallest token above all claimed ones."""
        path, fs = self._path("tokens")
        token = max((int(s.getPath().getName()) for s in fs.listStatus(path)), default=0) + 1 if fs.exists(path) else 1
        while not self.claim(token):
            token += 1
        return token

    def output_path(self, token: int) -> str:
        """Where the run with this token writes; the same for each retry."""
        return output_path(f"{self.folder}/out", token)

    def log(self) -> DataFrame:
        """All transitions of steps that were written to their end."""
        path, fs = self._path("log")
        good = [str(p) for p in ([s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return self.spark.read.schema(self.SCHEMA).parquet(*good) if good else self.spark.createDataFrame([], self.SCHEMA)

    def _append(self, df: DataFrame, token: int, step: int) -> DataFrame:
        path = f"{self.folder}/log/{token:08d}-{step:04d}"
        df.withColumns({"token": F.lit(token), "step": F.lit(step)}).select(*(c.split()[0] for c in self.SCHEMA.split(", "))).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.SCHEMA).parquet(path)

    def table(self, now: float | None = None) -> DataFrame:
        """(key, row, batch, fp, state, token, taken): each item as it stands at ``now``; ``taken`` is what its lease said."""
        last = F.max(F.struct("token", "step", "key", "batch", "fp", "state", "expires"))
        t = self.log().groupBy("row").agg(last.alias("x")).select("row", "x.*")
        over = F.col("expires") <= F.lit(time.time() if now is None else now)
        open_ = F.col("state").isin("leased", "unchanged", "superseded")
        state = F.when((open_ & over) | (F.col("state") == "released"), "pending").when(open_, "leased").otherwise(F.col("state"))
        return t.select("key", "row", "batch", "fp", state.alias("state"), "token", F.col("state").alias("taken"))

    def done(self) -> DataFrame:
        """(row, token): the items processed and the run whose output of them holds; output of other runs is void."""
        return self.table().where("state = 'done'").select("row", "token")

    def lease(self, rows: DataFrame, token: int, now: float | None = None) -> DataFrame:
        """Register unseen rows (key, row, batch, fp) and lease what has to be processed; returns the leased items.

        Leasing again with the same token gives the same items. Items under a lease that hasn't expired stay with their
        run, and other items of their keys wait. A token smaller than one that has leased is refused.
        """
        now = time.time() if now is None else now
        self.claim(token)
        path, fs = self._path("log", f"{token:08d}-0000")
        if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            return self.spark.read.schema(self.SCHEMA).parquet(str(path)).where("state = 'leased'")
        newest = self.log().agg(F.max("token")).first()[0]
        if newest is not None and newest > token:
            raise StaleToken(f"token {token} is older than {newest}")
        old = self.table(now)
        fresh = rows.select("key", "row", "batch", "fp").dropDuplicates(["row"]).join(old.select("row"), "row", "left_anti")
        pending = fresh.unionByName(old.where("state = 'pending'").select("key", "row", "batch", "fp"))
        pending = pending.join(old.where("state = 'leased'").select("key").distinct(), "key", "left_anti")
        last = pending.groupBy("key").agg(F.max(F.struct("batch", "row", "fp")).alias("x"))
        done = old.where("state = 'done'").groupBy("key").agg(F.max(F.struct("token", "batch", "row", "fp")).alias("d"))
        plan = last.join(done, "key", "left").select(F.col("x.row").alias("row"), F.when(F.col("d").isNotNull() & (F.col("x.fp") == F.col("d.fp")), "unchanged").otherwise("leased").alias("state"))
        taken = pending.join(plan, "row", "left").select("key", "row", "batch", "fp", F.coalesce("state", F.lit("superseded")).alias("state"), F.lit(now + self.ttl).alias("expires"))
        return self._append(taken, token, 0).where("state = 'leased'")

    def commit(self, token: int, processed: DataFrame, step: int = 1) -> None:
        """Mark the leased items in ``processed`` (their rows) done. Items leased but not processed go back to pending, and
        so do the rows they supersede; unchanged items are settled. Raises if a newer run has taken items over."""
        mine = self.table(now=float("-inf")).where(F.col("row").isNotNull())
        lease = self.log().where((F.col("token") == token) & (F.col("step") == 0))
        lost = lease.select("row").join(mine.where(F.col("token") == token).select("row"), "row", "left_anti")
        if lost.limit(1).count():
            raise StaleToken(f"items of token {token} were leased by a newer run")
        did = processed.select("row").distinct().withColumn("did", F.lit(True))
        x = lease.select("key", "row", "batch", "fp", "state").join(did, "row", "left")
        # of a key one row at most is leased or unchanged; the superseded ones follow it
        head = x.where("state <> 'superseded'").select("key", (F.coalesce("did", F.lit(False)) | (F.col("state") == "unchanged")).alias("held"))
        x = x.join(head, "key", "left")
        end = F.when((F.col("state") == "leased") & F.col("did"), "done").when((F.col("state") != "leased") & F.col("held"), "settled").otherwise("released")
        self._append(x.select("key", "row", "batch", "fp", end.alias("state"), F.lit(None).cast("double").alias("expires")), token, step)


__all__ = ["Runs", "StaleToken", "WorkLedger", "file_key", "output_path", "replay"]
