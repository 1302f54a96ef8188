"""A small corpus on which the rule tables have something to find, for queries and tests: the same rows in Spark and in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions.lineage import shared_dir, written

CORPUS = (
    ("book1_ch01", 0, "Mira Vale rode to Winterfell with House Rook. A prophecy warned them.\n\nWho had opened the gate? Mira Vale kept it hidden, a secret oath.\r\n\r\n\n  The siege began at Winterfell; Mira Vale, enemy of Tor Hale, was crowned.  "),
    ("book1_ch02", 1, "We sailed aboard the Grey Gull. The Grey Gull left the harbor.\n\nAnother dream, then a Dream. Queen of the Far Isles swore war was coming."),
    ("notes", 2, "   \n\n  "),
    ("book2_ch01", 3, "Tor Hale, son of Mira Vale, was allied with House Fenn at Riverrun.\n\nTor Hale swore an oath and kept a promise: the sword of valyrian steel, Longclaw, hung there.\n\nWhat was said that Tor Hale will live? What was said that Mira Vale will die?\n\nAnn the Bold and the captain of the Grey Gull found a vial of poison near Casterly Rock."),
    ("book2_ch02", 4, "The journey to King's Landing was long. Lord of Oldtown and Hand of the King departed.\n\nThe treaty ended; Ann the Bold died at Dragonstone, and Tor Hale owed a debt.\n\nNo one knew her real name. Why would House Rook keep it hidden? Three heads, said the prophecy. The Wall stood."),
    ("appendix", 5, "Iron Throne and Dark Sister: a hidden truth.\n\nThe Grey Gull set off toward the harbor of Pyke. The ship joined the fleet of House Fenn.\n\nTor Hale commanded the Grey Gull; Mira Vale discovered a dream, and the conflict would not end."),
)


def docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CORPUS), "source_id string, order_hint int, raw_text string")


def files(spark: SparkSession) -> str:
    """A folder in the shared one with the corpus as text files, one of them not of a suffix that is read."""
    root = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, text in [*((f"{source}.{'MD' if source == 'notes' else 'txt'}", text) for source, _, text in CORPUS), ("picture.png", "no text")]:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(conf).create(path)
        out.write(bytearray(text.encode()))
        out.close()
    return root


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'"


def sql() -> str:
    """corpus(source_id, order_hint, raw_text) as a common table expression."""
    rows = ", ".join(f"({_quoted(s)}, {o}, {_quoted(t)})" for s, o, t in CORPUS)
    return f"corpus AS (SELECT * FROM (VALUES {rows}) AS v(source_id, order_hint, raw_text))"


#: Letters that tell names of a story apart.
LETTERS = "bcdfghjklmnprst"


def _story_text(doc_id: Column) -> Column:
    texts = [t for _, _, t in CORPUS if t.strip()]
    text = F.element_at(F.array(*map(F.lit, texts)), (doc_id % len(texts) + 1).cast("int"))
    letter = lambda n: F.substring(F.lit(LETTERS), (n % len(LETTERS) + 1).cast("int"), F.lit(1))
    return F.replace(F.replace(text, F.lit("Vale"), F.concat(F.lit("Va"), letter(doc_id), F.lit("e"))), F.lit("Hale"), F.concat(F.lit("Ha"), letter(F.floor(doc_id / len(LETTERS))), F.lit("e")))


def story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of the corpus for each document, with names and order by its doc_id: names that many passages share, equal
    phrases everywhere, and two documents at each place of the order."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    d = d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # files are dealt by their texts, of which nothing is read
    return d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.floor(F.col("doc_id") / 2).cast("int").alias("order_hint"), _story_text(F.col("doc_id")).alias("raw_text"))


#: Labels of documents are sent to the texts up to so many rows, some 64 bytes each, and joined beyond.
SENT_LABELS = 2 << 20


def _version(prefix: str = "d", shift: int = 0, order: Column | None = None) -> Column:
    """A document's text with a story behind it, as source_id, order_hint, raw_text."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), _story_text(F.col("doc_id") + shift))
    order = F.floor(F.col("doc_id") / 2).cast("int") if order is None else order
    return F.struct(F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias("source_id"), order.alias("order_hint"), text.alias("raw_text"))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's own text with that of story() behind it, so that the rule tables find something in driver's texts."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(_version().alias("v")).select("v.*")


def annotated_before(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An earlier version of annotated(), and what leads to it: changed documents, and removed source_ids. Of the labelled
    documents those of low quality had another story, toxic ones are new, and those of high quality had a copy each at
    the very beginning that is gone. Each version reads a text once, and shuffles none unless labels are too many to be sent to them."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    told = written(labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("doc_id is not null"))
    d = d.join(F.broadcast(told) if told.count() <= SENT_LABELS else told, "doc_id", "left")
    new, other = F.coalesce(F.col("toxic") == 1, F.lit(False)), F.coalesce(F.col("quality") == 0, F.lit(False))
    each = F.array(F.when(~new, F.when(other, _version(shift=7)).otherwise(_version())), F.when(F.col("quality") == 1, _version("x", order=F.lit(-1))))
    before = d.select(F.explode(each).alias("v")).where("v is not null").select("v.*")
    return before, d.where(new | other).select(_version().alias("v")).select("v.*"), told.where("quality = 1").select(F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("source_id"))


def story_sql() -> str:
    """corpus(source_id, order_hint, raw_text) as a common table expression over documents."""
    texts = [t for _, _, t in CORPUS if t.strip()]
    letter = lambda n: f"substr('{LETTERS}', CAST({n} % {len(LETTERS)} + 1 AS INTEGER), 1)"
    named = f"replace(replace([{', '.join(map(_quoted, texts))}][CAST(doc_id % {len(texts)} + 1 AS INTEGER)], 'Vale', 'Va' || {letter('doc_id')} || 'e'), 'Hale', 'Ha' || {letter(f'(doc_id // {len(LETTERS)})')} || 'e')"
    return f"corpus AS (SELECT 'd' || doc_id AS source_id, CAST(doc_id // 2 AS INTEGER) AS order_hint, {named} AS raw_text FROM documents)"


def annotated_sql() -> str:
    """corpus(source_id, order_hint, raw_text) as a common table expression over documents, their texts before those of a story."""
    return f"{story_sql().replace('corpus AS', 'told AS')}, corpus AS (SELECT source_id, order_hint, coalesce(text, '') || chr(10) || chr(10) || raw_text AS raw_text FROM told JOIN documents ON source_id = 'd' || doc_id)"
