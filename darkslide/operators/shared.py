"""Tables written to the shared folder, to cut lineage in iterative plans.

The folder is the one named by ``spark.checkpoint.dir``. Only a local session
in which that is unset, as in tests, gets a temporary folder of its own; on a
cluster its absence is an error, since a folder of one machine would not
survive the loss of that machine.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_own_folder: str | None = None
_folders: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables of this application."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="darkslide-")
            atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
        named = _own_folder
    folder = f"{named.rstrip('/')}/darkslide-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is; one that is gone does no harm."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session's virtual machine may be gone at exit
        pass


class Written:
    """A DataFrame written as parquet to the shared folder.

    ``df`` reads it again: the plan then begins at a scan, a lost executor costs
    no recomputation, and the optimizer knows the size. ``drop()`` deletes it; what a
    result still reads goes with the application's folder when the driver ends.
    """

    def __init__(self, df: DataFrame, label: str, **stats: Column):
        """``stats``: aggregates of the rows by name; ``self.stats`` has them.

        They are read from the table, in one job; one that observes the write would do
        without, but leaves the session in a state that models' functions cannot be sent with.
        """
        spark = df.sparkSession
        self._spark, self.path = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        self.stats = self.df.agg(*[c.alias(n) for n, c in stats.items()]).first().asDict() if stats else {}

    def drop(self) -> None:
        _delete(self._spark, self.path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, before costly work in Python.

    A scan of many files, as all large ones are, stays as it is; one of a few files
    would leave cores idle and is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)
