"""Lineage cutting for iterative plans.

Each iteration is written as a Parquet table below the folder the cluster
names in ``spark.checkpoint.dir``.  A table there survives lost executors, has
exact column sizes (so Catalyst's own broadcast threshold works on facts) and
its row count comes from the write job itself.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_FALLBACK: dict[str, str] = {}
#: Folders in use, by application.
_ROOTS: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's, or a local one in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="hopgraph-")
    return _FALLBACK[app]


class Scratch:
    """A private sub-folder of the shared folder; one per algorithm run."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/hopgraph/{label}-{uuid.uuid4().hex[:12]}"
        self._serial = 0
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **extra: Column) -> int | tuple[int, dict]:
        """Write one table and return its row count, in a single job.

        ``extra`` names further aggregates to take along; they come back as a dict.
        """
        seen = Observation()
        named = [v.alias(k) for k, v in extra.items()]
        df.observe(seen, F.count(F.lit(1)).alias("n"), *named).write.mode("errorifexists").parquet(
            self.path(name)
        )
        got = seen.get
        return (int(got["n"]), got) if extra else int(got["n"])

    def read(self, name: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def save(self, df: DataFrame, name: str | None = None) -> tuple[DataFrame, int]:
        """Materialise ``df``; return the stored table and its row count."""
        if name is None:
            self._serial += 1
            name = f"t{self._serial}"
        n = self.write(df, name)
        return self.read(name, df.schema), n

    def cut(self, df: DataFrame, name: str | None = None) -> DataFrame:
        return self.save(df, name)[0]

    def read_many(self, names: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[self.path(n) for n in names])

    def remove(self, name: str) -> None:
        """Delete one table that nothing reads any more."""
        _delete(self.spark, self.path(name))

    def drop(self) -> None:
        """Delete this run's tables; call when its results are stored elsewhere."""
        _delete(self.spark, self.root)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> int:
    """Delete all intermediate tables of this application; returns the number of folders.

    To be called between jobs, when the results that were wanted are stored: data frames
    and prepared graphs made before cannot be read afterwards.
    """
    roots = _ROOTS.pop(spark.sparkContext.applicationId, [])
    for root in roots:
        _delete(spark, root)
    return len(roots)
