"""A table as a base and numbered deltas: the last write of a key wins, whichever order the writes arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a delta has beside the caller's columns.
SEQUENCE, GONE = "_sequence", "_gone"


class KeyedLog:
    """Upserts and deletions by key below a folder. A write with a number that is there already replaces that write, so a
    write that is repeated changes nothing; of two writes the larger number wins, also if it came first."""

    def __init__(self, spark: SparkSession, root: str, key: list[str]) -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _latest(self, rows: DataFrame, by: str) -> DataFrame:
        """One row per key. Maxima are taken before anything is shuffled, so a hot key costs a row per task."""
        rest = [c for c in rows.columns if c not in self.key]
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), by).alias("r")).select(*self.key, "r.*").select(rows.columns)

    def write(self, sequence: int, rows: DataFrame, by: list[str], gone: str = "false") -> None:
        """A numbered write, from 1. Of rows with one key that with the largest by counts (ties: the largest of all its
        columns, so that equal writes are equal); where the condition gone holds for it, the key is deleted. A write that the base has in it is passed over."""
        if sequence <= self._base():
            return
        told = rows.withColumn(GONE, F.expr(gone)).withColumn("_by", F.struct(*by, F.struct(*rows.columns)))
        self._latest(told, "_by").drop("_by").write.mode("overwrite").parquet(f"{self.root}/delta/{SEQUENCE}={sequence}")

    def _folders(self, kind: str) -> list[int]:
        """The numbers of the writes below a folder that are whole."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [x.getPath() for x in fs.listStatus(at)] if fs.exists(at) else []  # a folder per write since the base
        return sorted(int(p.getName().split("=")[1]) for p in found if "=" in p.getName() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _base(self) -> int:
        return max(self._folders("base"), default=0)

    def _rows(self) -> DataFrame:
        """The latest row of every key, deleted ones too."""
        base = self._base()
        paths = [f"{self.root}/base/{SEQUENCE}={base}"] * (base > 0)
        deltas = [n for n in self._folders("delta") if n > base]
        schema = self.spark.read.parquet(f"{self.root}/delta/{SEQUENCE}={deltas[-1]}" if deltas else paths[0]).schema
        every = [self.spark.read.schema(schema).parquet(p).withColumn(SEQUENCE, F.lit(n)) for p, n in [*((p, base) for p in paths), *((f"{self.root}/delta/{SEQUENCE}={n}", n) for n in deltas)]]
        rows = every[0]
        for more in every[1:]:
            rows = rows.unionByName(more)
        return rows if len(every) == 1 else self._latest(rows, SEQUENCE)

    def read(self) -> DataFrame:
        return self._rows().where(f"not {GONE}").drop(SEQUENCE, GONE)

    def compact(self) -> None:
        """Puts the base and all deltas into a new base, without deleted keys. The old ones stay until vacuum(), for who reads them."""
        upto = max([*self._folders("delta"), self._base()])
        if upto > self._base():
            self._rows().where(f"not {GONE}").drop(SEQUENCE).write.mode("overwrite").parquet(f"{self.root}/base/{SEQUENCE}={upto}")

    def vacuum(self) -> None:
        """Deletes what the base has in it."""
        jvm, base = self.spark.sparkContext._jvm, self._base()
        for kind in ("base", "delta"):
            for n in self._folders(kind):
                if n < base or kind == "delta" and n == base:
                    at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}/{SEQUENCE}={n}")
                    at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
