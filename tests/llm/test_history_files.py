"""How many files the batches of a history cost: each small file starts processes that share an executor's memory."""

import os

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from ferrule.llm import history

SCHEMA = "paper_id string, title string, doi string, filename string"
SUBJECTS = ("void growth in Na3PS4 under stack pressure and heat", "ion transport along grain borders of Li6PS5Cl pellets", "slow anion redox of layered Na2Mn3O7 after long ageing", "how binders wet coarse particles of LiFePO4 in thick coatings")


def papers(spark, first, n):
    """n rows: each subject again and again, in two forms, under DOIs of its own."""
    rows = [(f"{i:04}", f"On {SUBJECTS[i % 4]}" + " revisited" * (i % 3 == 0), f"10.99100/abc.{2000 + i % 4}.{i % 8:06}", f"f{i % 16}.pdf") for i in range(first, first + n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def written(spark, monkeypatch):
    """(columns, part files, path) of all that is written, in order. Partitions aren't coalesced, as those of a large batch aren't."""
    made, write = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **more):
        write(self, path, *args, **more)
        files = [f for _, _, names in os.walk(path.removeprefix("file://")) for f in names if f.startswith("part-")]
        made.append((self._df.columns, len(files), path))

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield made
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_keys_of_a_small_batch_are_written_once_in_one_file(spark, tmp_path, written):
    index = history.HistoryIndex(spark, f"{tmp_path}/index")
    for number in range(2):
        index.accept(papers(spark, 40 * number, 40), number)
    besides = [files for columns, files, path in written if "key" in columns and "/keys/" not in path]
    assert besides == [1, 1]
    assert all(files <= history.BUCKETS for columns, files, path in written if "/keys/" in path)


def test_tasks_follow_the_keys(spark, tmp_path, written, monkeypatch):
    """More keys are spread over more tasks, with the same works and the same keys in the index."""

    def run(name, keys):
        monkeypatch.setattr(history, "TASK_KEYS", keys)
        written.clear()
        index = history.HistoryIndex(spark, f"{tmp_path}/{name}")
        for number in range(2):
            index.accept(papers(spark, 30 * number, 40), number)  # ten rows come twice
        kept = spark.read.parquet(f"{tmp_path}/{name}/keys").select("key", "form", "kind", "batch", "bucket")
        besides = [files for columns, files, path in written if "key" in columns and "/keys/" not in path]
        return besides, sorted(map(tuple, kept.collect())), sorted(map(tuple, index.repeats().collect()))

    few, many = run("few", 100_000), run("many", 30)
    assert few[0] == [1, 1] and min(many[0]) > 4
    assert few[1:] == many[1:]
    assert len({row[:2] for row in few[1]}) == len(few[1])  # what is known under its key isn't appended again
    assert few[2] == sorted((f"{i % 4:04}", f"{i:04}") for i in range(4, 70))
