"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a folder of this machine serves in local mode alone;
    elsewhere executors would not see each other's files, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        own = tempfile.mkdtemp(prefix="maskwright-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_folder.append("file://" + own)
    return _own_folder[0]


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and fixes values that a
    recomputation could change. The table is all that later stages need, so lost executors only
    cost the tasks they were running. An application's tables are in a folder of its own, maskwright-<application>, which
    can go when it has ended."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/maskwright-{spark.conf.get('spark.app.id', 'session')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's setting that removes an execution's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind. Else they stay until the driver happens to collect its garbage,
    and those of one table after another add up on disk."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def drop_tables(*tables: DataFrame) -> None:
    """Empty the folders of tables of write_table, once all that was made of them is written itself."""
    for df in tables:
        for path in df.inputFiles()[:1]:
            df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path.rsplit("/", 1)[0])
