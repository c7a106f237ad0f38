"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[tuple[str, str]] = set()
_own: set[str] = set()

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", shuffle_partitions)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and tasks are one process, and so on one machine."""
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, unless their Python finds it already (PYTHONPATH, or local mode's folder)."""
    root = Path(__file__).resolve().parent.parent
    known = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    local = is_local(spark) and Path.cwd() == root
    key = (spark.sparkContext.applicationId, str(root))
    if root not in known and not local and key not in _shipped:
        _shipped.add(key)
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted((root / "embedflow").rglob("*.py")):
                z.write(f, f.relative_to(root))
        target = f"{_own_dir(spark)}/embedflow.zip"
        path, fs = _file_system(spark, target)
        out = fs.create(path, True)
        out.write(bytearray(packed.getvalue()))
        out.close()
        spark.sparkContext.addPyFile(target)
    return spark


def ship_file(spark: SparkSession, path: str, name: str) -> None:
    """Send a file of the driver to all workers under a name; they fetch it from the shared folder, not from the driver."""
    target, fs = _file_system(spark, f"{_own_dir(spark)}/files/{name}")
    fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(Path(path).resolve().as_uri()), target)
    spark.sparkContext.addFile(str(target))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in local mode alone, one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="embedflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spread(df: DataFrame, key: str, tasks_per_core: int = 2) -> DataFrame:
    """df in enough partitions to keep all cores busy with costly work on each row; large inputs have them already.

    A few small files are read by a few tasks, however much each row costs afterwards. One shuffle of the rows by
    key; key should hold few repeated values.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism * tasks_per_core
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df


def _own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared folder; removed when the process ends, or by clean()."""
    path = f"{shared_dir(spark)}/embedflow-{spark.sparkContext.applicationId}"
    if path not in _own:
        _own.add(path)
        atexit.register(clean, spark)
    return path


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def clean(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application. Frames that still read them can't be used afterwards."""
    path = f"{shared_dir(spark)}/embedflow-{spark.sparkContext.applicationId}" if spark.sparkContext._jsc else None
    if path in _own:
        at, fs = _file_system(spark, path)
        fs.delete(at, True)
        _own.discard(path)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back.

    Cuts lineage without executor-local storage: when an executor is lost, its part is read again from the
    table instead of being computed again. Keeps the schema, also of an empty frame. The table stays until drop(), or
    clean() at the end of the application.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._embedflow_table = path
    return out


def drop(table: DataFrame) -> None:
    """Remove a table that materialize() wrote, once nothing reads it any more."""
    remove(table.sparkSession, table._embedflow_table)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for what runs inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _file_system(spark, path)
    fs.delete(at, True)


def publish(spark: SparkSession, made: str, path: str) -> None:
    """Put a finished folder in the place of another: a reader finds the old one or the new one, or for a moment none,
    never a part. What was there stays aside until the new one is in place."""
    new, fs = _file_system(spark, made)
    target, old = _file_system(spark, path)[0], _file_system(spark, f"{path}.replaced-{uuid.uuid4().hex}")[0]
    there = fs.exists(target)
    if there and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved")
    try:
        moved = fs.rename(new, target)
    except Exception:  # some file systems say no by an exception
        moved = False
    if not moved:
        if there:
            fs.rename(old, target)
        raise OSError(f"{made} can't be moved to {path}")
    if there:
        fs.delete(old, True)
