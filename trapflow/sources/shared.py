"""Working folders that all executors see."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset (tests), a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.gettempdir() + "/trapflow-shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Folders made since the last release, by application.
_made: dict[str, list[str]] = {}


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new path in the shared folder; what is written there goes with ``release``."""
    path = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete all intermediate folders made so far: call it when the results of queries have been written."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, an executor may be lost. The folder
    goes with ``release``, or when the driver ends."""
    path = fresh_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    fs, at = _fs(df.sparkSession, path)
    fs.deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def newest_json(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """Number and content of the newest version in ``folder``; (0, None) if there is none."""
    fs, at = _fs(spark, folder)
    if not fs.exists(at):
        return 0, None
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    newest = max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=0)
    if not newest:
        return 0, None
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{newest}.json"))
    try:
        return newest, json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def swap_json(spark: SparkSession, folder: str, version: int, value: dict) -> bool:
    """Make ``value`` the version of that number, unless there is one: written aside, then renamed to a
    name that must be free. False if another writer was first."""
    fs, aside = _fs(spark, f"{folder}/aside-{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{version}.json")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(aside, at, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception:  # noqa: BLE001 - a Py4JJavaError of any file system
        if not fs.exists(at):
            raise
        fs.delete(aside, False)
        return False
    return True


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder with all it holds; nothing happens if there is none."""
    fs, at = _fs(spark, path)
    fs.delete(at, True)
