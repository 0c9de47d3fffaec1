"""Tables cut out of a long lineage, written to the shared checkpoint folder.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only
where it is unset (tests, a laptop) does the session get one of its own.
A cut table is read back from shared storage, so a lost executor costs a
re-read and never a recomputation of everything before the cut.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: dict[str, str] = {}
_WRITTEN: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="spark-colloquy-")
        spark.sparkContext.setCheckpointDir(_OWN_FOLDER[app])
    return _OWN_FOLDER[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet, under the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/colloquy/{app}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _state_of(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of what a folder holds, so that a rewritten input is seen."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.listStatus(path) if fs.exists(path) else []
    return ",".join(sorted(f"{x.getPath().getName()}:{x.getLen()}:{x.getModificationTime()}" for x in held))


def cut_once(spark: SparkSession, source: str, name: str, build) -> DataFrame:
    """As ``cut``, remembered per application, source folder with what it holds, and name."""
    tag = hashlib.sha1(f"{source} {_state_of(spark, source)}".encode()).hexdigest()[:10]
    key = (spark.sparkContext.applicationId, f"{name}@{tag}")
    if key not in _WRITTEN:
        path = fresh_path(spark, f"{name}-{tag}")
        build().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
