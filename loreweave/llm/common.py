"""What the corpus operators share: the folder that all executors see, written intermediate tables, column guards."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and Spark runs in this one machine, a folder of our own."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _own_dirs:
        folder = tempfile.TemporaryDirectory(prefix="loreweave-", ignore_cleanup_errors=True)
        atexit.register(folder.cleanup)
        _own_dirs[app] = f"file://{folder.name}"
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.loreweave_path = path
    return out


def dropped(df: DataFrame) -> None:
    if path := getattr(df, "loreweave_path", None):
        drop_path(df.sparkSession, path)


def sent_if_small(table: DataFrame, column: str, row_bytes: int = 64, most: int = 32 << 20) -> DataFrame:
    """A written table to look a column up in: broadcast where its size, which is measured, is at most so many bytes."""
    size = table.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + row_bytes), F.lit(0))).collect()[0][0]
    return F.broadcast(table) if size <= most else table


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def numbered(rows: DataFrame, *order: Column | str, name: str = "numbered") -> DataFrame:
    """rows with at, their place from 0 in that order over the whole table, as a written table.

    Ranges of the order are sorted apart; each range's rows lie behind those of the ranges before it, whose sizes (a row
    per range) are added up. rows should be cheap to read twice, as ranges are sampled.
    """
    spark = rows.sparkSession
    shard, place = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), name)
    sizes = placed.groupBy(shard.alias("shard")).count().orderBy("shard").collect()
    ahead = list(accumulate((r["count"] for r in sizes), initial=0))
    before = spark.createDataFrame([(r["shard"], n) for r, n in zip(sizes, ahead)], "shard int, before long")
    out = placed.withColumn("shard", shard).join(F.broadcast(before), "shard").select(*rows.columns, (place + F.col("before")).alias("at"))
    out.loreweave_path = placed.loreweave_path
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII text takes the byte-wise path of lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def packed_row(docs: DataFrame) -> Column:
    """All columns of a table as one struct, so that no column of ours can clash with one of the caller's."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def power_of_two(least: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, least))))
