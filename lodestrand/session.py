"""Session helpers shared by every operator: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_BUILT: dict[tuple, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``. A temporary folder of this machine is made
    only where that setting is empty and Spark runs in this one process, as in tests; on a cluster that raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="lodestrand-")
    return _OWN_FOLDERS[app]


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as a compressed table into the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of executors: a later read comes from the shared
    files. The files are removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestrand-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def once(source: DataFrame, name: str, build: Callable):
    """What ``build`` makes of the files behind ``source``, made once an application and shared by all queries: indexes
    whose tables are staged. New files mean a new build."""
    key = (source.sparkSession.sparkContext.applicationId, name, *sorted(source.inputFiles()))
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def dropped(df: DataFrame) -> None:
    """Remove the files of a table made by ``staged`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Let the executors' Python import this package, wherever the driver was started: its sources go along once an
    application as a file of the application's own file server."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lodestrand-")) / "lodestrand_sources.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, Path(package.name) / source.relative_to(package))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_rows(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per ``key`` with its least non-null ``value``; rows whose key or value is null count nowhere."""
    return df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value))
