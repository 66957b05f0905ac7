"""Sets of tables that replace each other whole, and single partitions."""

import os

import pytest
from pyspark.sql import functions as F

from steadymark.sources import tablesets
from steadymark.sources.tables import write_single_file
from steadymark.sources.tablesets import discard, published, read_member, recover, replace_partitions

NAMES = ("a.parquet", "b.parquet", "c.parquet")


def write_set(spark, root, value, names=NAMES):
    with published(spark, root) as place:
        for name in names:
            write_single_file(spark.range(1).select(F.lit(value).alias("v")), f"{place}/{name}")


def values(spark, root):
    return {name: spark.read.parquet(f"{root}/{name}").first()["v"] for name in sorted(os.listdir(root)) if not name.startswith(("_", "."))}


@pytest.fixture
def root(spark, tmp_path):
    place = str(tmp_path / "set")
    write_set(spark, place, 1)
    return place


def test_a_set_replaces_tables_of_its_names(spark, root):
    write_set(spark, root, 2, NAMES[:2])
    assert values(spark, root) == {"a.parquet": 2, "b.parquet": 2, "c.parquet": 1}
    assert sorted(os.listdir(root)) == list(NAMES)


def test_a_failed_job_leaves_the_former_set(spark, root):
    with pytest.raises(ZeroDivisionError), published(spark, root) as place:
        write_single_file(spark.range(1).select(F.lit(2).alias("v")), f"{place}/a.parquet")
        raise ZeroDivisionError
    assert values(spark, root) == dict.fromkeys(NAMES, 1) and sorted(os.listdir(root)) == list(NAMES)


def test_a_job_killed_while_it_writes_leaves_the_former_set(spark, root):
    started = published(spark, root)
    place = started.__enter__()  # never left: the process is gone
    write_single_file(spark.range(1).select(F.lit(2).alias("v")), f"{place}/a.parquet")
    assert read_member(spark, root, "a.parquet").first()["v"] == 1 and values(spark, root) == dict.fromkeys(NAMES, 1)
    discard(spark, root)
    assert sorted(os.listdir(root)) == list(NAMES)


@pytest.mark.parametrize("moves", range(6))
def test_a_job_killed_while_it_replaces_is_completed(spark, root, monkeypatch, moves):
    """Two moves a table: the old one aside, the new one in place. The next reader does the rest."""
    done, move = [], tablesets._Folder.move

    def stopping(self, source, target):
        if len(done) == moves:
            raise KeyboardInterrupt
        done.append(source)
        move(self, source, target)

    monkeypatch.setattr(tablesets._Folder, "move", stopping)
    with pytest.raises(KeyboardInterrupt):
        write_set(spark, root, 2)
    monkeypatch.setattr(tablesets._Folder, "move", move)
    assert read_member(spark, root, "c.parquet").first()["v"] == 2
    assert values(spark, root) == dict.fromkeys(NAMES, 2) and sorted(os.listdir(root)) == list(NAMES)
    recover(spark, root)
    assert values(spark, root) == dict.fromkeys(NAMES, 2)


def test_one_model_replaces_its_own_partitions(spark, tmp_path):
    path = str(tmp_path / "scores")
    rows = spark.createDataFrame([(m, level, i, 0) for m in (4, 16, 32) for level in ("shallow", "heavy") for i in range(5)], "adapter int, level string, id int, v int")
    replace_partitions(rows, path, ["adapter", "level"])
    replace_partitions(rows.where("adapter = 16 and level = 'heavy' and id < 3").withColumn("v", F.lit(1)), path, ["adapter", "level"])
    found = {(r["adapter"], r["level"]): (r["n"], r["v"]) for r in spark.read.parquet(path).groupBy("adapter", "level").agg(F.count("*").alias("n"), F.sum("v").alias("v")).collect()}
    assert found.pop((16, "heavy")) == (3, 3) and len(found) == 5 and set(found.values()) == {(5, 0)}
