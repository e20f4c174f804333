"""Stage tables in the shared folder, so that lineage is cut once and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors, once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="studyweave-")) / "studyweave.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="studyweave-")


def written_whole(spark: SparkSession, path: str, mark: str = "_SUCCESS") -> bool:
    """Whether a write into the folder came to its end."""
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{mark}")
    return file.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(file)


def mark_whole(spark: SparkSession, path: str, mark: str = "_SUCCESS") -> None:
    """Says so, of a folder that was written as part of another."""
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{mark}")
    file.getFileSystem(spark._jsc.sc().hadoopConfiguration()).create(file, True).close()


class Workspace:
    """Writes each named frame once and reads it back from parquet from then on.

    Each workspace has a folder of its own. It holds a snapshot of its input: open a new one for
    changed input.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = f"{(folder or shared_folder(spark)).rstrip('/')}/studyweave-{uuid.uuid4().hex}"
        self._tables: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._tables:
            frame = build()
            path = f"{self.folder}/{name}"
            frame.write.mode("overwrite").parquet(path)
            self._tables[name] = self.spark.read.schema(frame.schema).parquet(path)
        return self._tables[name]

    def rows(self, name: str) -> int:
        """Row count of a written table (answered from the file footers)."""
        if name not in self._rows:
            self._rows[name] = self._tables[name].count()
        return self._rows[name]

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def fresh_path(self, name: str) -> str:
        """A path that nothing else uses."""
        return self.path(f"{name}-{uuid.uuid4().hex}")

    def close(self) -> None:
        """Removes the folder: nothing that was read from it can be read again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).delete(path, True)
        self._tables.clear()
        self._rows.clear()
