"""What a run has written, read back by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_status(spark: SparkSession, path: str):
    """The status of a path on any store that Spark reaches, None if there is nothing."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(at) if fs.exists(at) else None


def latest_output(spark: SparkSession, base: str) -> str | None:
    """The folder base if there is one, else that of the folders base_... beside it whose name is the greatest, else None."""
    base = base.rstrip("/")
    if file_status(spark, base):
        return base
    jvm = spark.sparkContext._jvm
    beside = jvm.org.apache.hadoop.fs.Path(f"{base}_*")
    found = beside.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(beside) or []
    folders = [x.getPath() for x in found if x.isDirectory()]
    return max(folders, key=lambda p: p.getName()).toString() if folders else None


class Artifacts:
    """Files and tables below a folder. Names are relative to it and cannot lead out of it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        if not name or name.startswith("/") or ":" in name or ".." in name.split("/"):
            raise ValueError(f"not below the folder: {name}")
        return f"{self.root}/{name}"

    def _there(self, name: str) -> str:
        path = self.path(name)
        if file_status(self.spark, path) is None:
            raise FileNotFoundError(name)
        return path

    def json(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """A file that holds one JSON array, a row per element, or one object, a single row."""
        return self._reader(schema).option("multiLine", True).json(self._there(name))

    def jsonl(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """A row per line; blank lines are passed over."""
        return self._reader(schema).json(self._there(name))

    def records(self, stem: str, schema: T.StructType | None = None) -> DataFrame:
        """stem.jsonl if there is one, else stem.json, else no rows (of the schema)."""
        if file_status(self.spark, self.path(f"{stem}.jsonl")):
            return self.jsonl(f"{stem}.jsonl", schema)
        if file_status(self.spark, self.path(f"{stem}.json")):
            return self.json(f"{stem}.json", schema)
        return self.spark.createDataFrame([], schema or T.StructType([]))

    def text(self, name: str) -> DataFrame:
        """value: a file's whole text."""
        return self.spark.read.text(self._there(name), wholetext=True)

    def listing(self) -> DataFrame:
        """name of every file, in order; Spark's own bookkeeping (names that begin with _ or .) is left out. Contents are not read."""
        base = file_status(self.spark, self.root)
        if base is None:
            return self.spark.createDataFrame([], "name string")
        at = base.getPath().toUri().getPath().rstrip("/") + "/"
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.root)
        return files.select(F.substring_index("path", at, -1).alias("name")).orderBy("name")

    def _reader(self, schema: T.StructType | None):
        return self.spark.read if schema is None else self.spark.read.schema(schema)
