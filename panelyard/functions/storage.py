"""Cutting lineage through the shared folder of the cluster."""

from __future__ import annotations

import errno
import os
import tempfile
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder for materialized tables: ``spark.checkpoint.dir`` as the session names it.

    A machine-local folder is used only under a local master, where the driver and the
    executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIR:
        _LOCAL_DIR[app] = tempfile.mkdtemp(prefix="spark-panelyard-")
    return _LOCAL_DIR[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet and continue from the written table.

    Unlike a cache this survives lost executors, gives later branches one identical copy
    (float sums may differ in the last bit between two evaluations of a plan) and keeps
    column pruning for every later read.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    note(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table


def note(spark: SparkSession, path: str) -> str:
    """Have ``release`` delete a folder that an operator writes itself."""
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(spark: SparkSession) -> list[str]:
    """Folders that were written in this application and are still there, oldest first."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, ()))


def path_of(table: DataFrame) -> str | None:
    """Where ``materialize`` wrote the table that it returned."""
    return getattr(table, "_written_path", None)


def written_rows(table: DataFrame) -> int | None:
    """Rows of a table that ``materialize`` returned, from its file footers; None for any other."""
    return None if path_of(table) is None else table.count()


def release(spark: SparkSession, before: Sequence[str] = (), keep: Sequence[DataFrame] = ()) -> int:
    """Delete what was written in this application (tables of ``materialize``, noted folders), once the results are consumed; their number.

    Folders at the paths ``before`` (what ``written`` gave earlier) and the tables ``keep`` stay.
    """
    spared = {*before, *map(path_of, keep)}
    app = spark.sparkContext.applicationId
    paths = [p for p in _WRITTEN.get(app, ()) if p not in spared]
    _WRITTEN[app] = [p for p in _WRITTEN.get(app, ()) if p in spared]
    delete(spark, paths)
    return len(paths)


def delete(spark: SparkSession, paths: Sequence[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def _file_system(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, target.getFileSystem(conf), target


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Committed versions of a table of versions: number to folder, in order."""
    _, _, fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return {}
    names = [str(s.getPath().getName()) for s in fs.listStatus(target) if s.isDirectory()]
    return {int(n[1:]): f"{path.rstrip('/')}/{n}" for n in sorted(names) if len(n) == 11 and n[0] == "v" and n[1:].isdigit()}


def stage_version(df: DataFrame, path: str) -> str:
    """Write rows of a coming version aside, where no reader looks."""
    staged = f"{path.rstrip('/')}/_staged/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(staged)
    return staged


def commit_version(spark: SparkSession, staged: str, path: str, version: int) -> bool:
    """Publish staged rows as ``version`` by one rename that fails if the version is there: whole, or not at all.

    False if another writer has committed this version; the staged rows stay for another try.
    """
    target = f"{path.rstrip('/')}/v{version:010d}"
    jvm, conf, fs, where = _file_system(spark, target)
    if fs.getUri().getScheme() == "file":
        try:
            os.rename(jvm.org.apache.hadoop.fs.Path(staged).toUri().getPath(), where.toUri().getPath())
        except OSError as error:
            if error.errno in (errno.ENOTEMPTY, errno.EEXIST):
                return False
            raise
        return True
    if fs.exists(where):
        return False
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(staged), where, options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
            return False
        raise
    return True
