"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a Parquet table below
``spark.checkpoint.dir`` and reading it back.  A lost executor then costs no more
than the running step, and the files carry true sizes, from which the planner picks
join strategies.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: Folders of applications with a local master and no setting.
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for a local master without one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="ontoloom-")
        atexit.register(shutil.rmtree, _local[sc.applicationId], ignore_errors=True)
    return _local[sc.applicationId]


class Scratch:
    """A set of intermediate tables of one operator call.

    A table that the returned DataFrame reads lazily stays until the process ends; operators
    ``drop`` those that no later step needs.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/ontoloom-{label}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as table ``name`` and return it as read back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, schema: StructType) -> DataFrame:
        """The tables below ``name``, as one; folders called key=value make columns of ``schema``."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self._remove(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone by the time of the atexit call
            pass
