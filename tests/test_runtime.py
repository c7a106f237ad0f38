import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from embedflow import runtime as R


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(10).withColumn("a", F.array(F.col("id"))).withColumn("s", F.struct("id"))
    kept = R.materialize(df)
    assert kept.dtypes == df.dtypes and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert R.materialize(df.limit(0)).count() == 0
    own = Path(R.shared_dir(spark)) / f"embedflow-{spark.sparkContext.applicationId}"
    assert own.is_dir()
    R.clean(spark)
    assert not own.exists()
    assert R.materialize(df).count() == 10


def test_spread_only_few_partitions(spark):
    wide = spark.range(0, 1000, 1, 64)
    assert R.spread(wide, "id") is wide
    assert R.spread(spark.range(0, 1000, 1, 1), "id").rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_package_is_found_by_workers(spark):
    assert str(Path(R.__file__).resolve().parent.parent) in os.environ["PYTHONPATH"]
    assert R.ship(spark) is spark and not R._shipped


def test_tables_are_dropped_and_folders_replaced(spark, tmp_path):
    table = R.materialize(spark.range(3))
    assert Path(table._embedflow_table).is_dir()
    R.drop(table)
    assert not Path(table._embedflow_table).exists()
    for n in (1, 2):
        (tmp_path / "made").mkdir()
        (tmp_path / "made" / f"{n}").write_text("x")
        R.publish(spark, str(tmp_path / "made"), str(tmp_path / "there"))
        assert [f.name for f in (tmp_path / "there").iterdir() if f.suffix != ".crc"] == [f"{n}"]
    with pytest.raises(OSError):
        R.publish(spark, str(tmp_path / "missing"), str(tmp_path / "there"))
    assert (tmp_path / "there" / "2").exists() and sorted(f.name for f in tmp_path.iterdir()) == ["there"]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(R, "is_local", lambda spark: False)
    assert R.shared_dir(spark)  # set for the tests
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    if not spark.sparkContext.getCheckpointDir():
        with pytest.raises(RuntimeError):
            R.shared_dir(spark)
