"""What the operators need from the cluster: a shared folder for tables that cut lineage, and this
package on the executors."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loanloom.llm import textbatch

#: Bytes of rows that Spark hands to a Python worker at once: long texts come in smaller batches.
BATCH_BYTES = 4 << 20
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local master (tests on
    one machine) gets a temporary folder of this process; on a cluster no folder of one machine would do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it back: the lineage ends there, so a lost
    executor costs only the tasks that read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a table that written() made, once nothing will read it again."""
    spark = df.sparkSession
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if not re.search("-[0-9a-f]{32}$", folder):
            raise ValueError(f"{folder} isn't a table of written()")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, and lowers the session's Arrow batches to
    BATCH_BYTES where they may be larger."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(limit).rstrip("b")
    if size.isdigit() and int(size) > BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))
    context = spark.sparkContext
    key = context.applicationId + ":package"
    if key in _own:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = tempfile.mkdtemp(prefix="spark-")
    shutil.copytree(root, os.path.join(top, "tree", os.path.basename(root)), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(top, "loanloom_package"), "zip", os.path.join(top, "tree")))
    _own[key] = top


def mapped(df: DataFrame, run: Callable, schema: object) -> DataFrame:
    """df.mapInArrow with this package on the executors; workers keep nothing large between partitions."""
    ship(df.sparkSession)
    return df.mapInArrow(textbatch.released(run), schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with those an operator adds."""
    return df.select(*[df[c] for c in columns])
