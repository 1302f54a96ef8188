"""Documents from files, paths and their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreweave.functions.ranking import ranked
from loreweave.sources.artifacts import file_status

#: Suffixes that are read.
TEXT_SUFFIXES = ("txt", "md", "markdown")
ALL_SUFFIXES = (*TEXT_SUFFIXES, "docx", "pdf")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def filename_metadata(paths: DataFrame) -> DataFrame:
    """path, book_label, chapter_label: names book..._rest are split once, if rest is digits or longer than four characters
    or the name starts with more than book; otherwise the whole name is the chapter."""
    name = stem(F.col("path"))
    rest = F.expr("substring(s, instr(s, '_') + 1)")
    d = paths.select("path", name.alias("s")).withColumn("head", F.substring_index("s", "_", 1)).withColumn("rest", rest)
    split = F.col("s").startswith("book") & F.col("s").contains("_") & (F.substring("head", 5, 99).rlike("^[0-9]+$") | (F.length("head") > 4))
    return d.select("path", F.when(split, F.col("head")).alias("book_label"), F.when(split, F.col("rest")).otherwise(F.col("s")).alias("chapter_label"))


def _texts(files: DataFrame) -> DataFrame:
    """path, raw_text of files as binaryFile has them: line ends read as \\n, null where a file is not UTF-8."""
    return files.select("path", F.when(F.is_valid_utf8("content"), F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")).alias("raw_text"))


def _documents(texts: DataFrame, hints: DataFrame) -> DataFrame:
    d = texts.join(hints, "path").join(filename_metadata(texts.select("path")), "path")
    return d.select(stem(F.col("path")).alias("source_id"), F.col("path").alias("source_path"), "order_hint", "raw_text", "book_label", "chapter_label")


def _by_name(files: DataFrame) -> DataFrame:
    """path, order_hint: the place of a file in the order of names."""
    return ranked(files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name")), "name", "path").select("path", F.col("rank").alias("order_hint"))


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """source_id, source_path, order_hint, raw_text, book_label, chapter_label of the text files in a folder, ordered by name.

    Line ends read as \\n. Files that are not UTF-8 have a null raw_text; quarantine() lists them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).where(suffix(F.col("path")).isin(*TEXT_SUFFIXES))
    return _documents(_texts(files), _by_name(files))


def load_files(spark: SparkSession, paths: list[str], ordered: bool = False) -> DataFrame:
    """Listed files as scan_documents has them: each with order_hint 0 or, ordered, in order of their names, which is how
    changed files of a folder are read. A path that is missing, a folder, or of another suffix is an error before anything is read."""
    for p in paths:
        status = file_status(spark, p)
        if status is None:
            raise FileNotFoundError(p)
        if status.isDirectory():
            raise ValueError(f"a folder, not a file: {p}")
        if p.rpartition("/")[2].rpartition(".")[2].lower() not in ALL_SUFFIXES:
            raise ValueError(f"not a suffix that is read: {p}")
    if not paths:
        return spark.createDataFrame([], "source_id string, source_path string, order_hint int, raw_text string, book_label string, chapter_label string")
    files = spark.read.format("binaryFile").load(paths)
    plain = _texts(files.where(suffix(F.col("path")).isin(*TEXT_SUFFIXES)))
    rich = [p for p in paths if p.lower().endswith((".docx", ".pdf"))]
    texts = plain.unionByName(binary_text(spark, rich).withColumnRenamed("source_path", "path")) if rich else plain
    return _documents(texts, _by_name(files) if ordered else files.select("path", F.lit(0).alias("order_hint")))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder, or the one of a file."""
    status = file_status(spark, path)
    return scan_documents(spark, path) if status is not None and status.isDirectory() else load_files(spark, [path])


def quarantine(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("raw_text").isNull()).select("source_path")


def binary_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_path, raw_text of .docx and .pdf files, by python-docx and pypdf where executors have them: paragraphs joined
    by a line end, pages headed === Page N === and joined by a blank line."""
    import pandas as pd

    def read(batches):
        import io

        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"]):
                if name.lower().endswith(".docx"):
                    import docx

                    out.append("\n".join(p.text for p in docx.Document(io.BytesIO(content)).paragraphs))
                else:
                    import pypdf

                    out.append("\n\n".join(f"=== Page {i} ===\n{p.extract_text() or ''}" for i, p in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages, 1)))
            yield pd.DataFrame({"source_path": batch["path"], "raw_text": out})

    files = spark.read.format("binaryFile").load(path).where(suffix(F.col("path")).isin("docx", "pdf"))
    return files.select("path", "content").mapInPandas(read, "source_path string, raw_text string")


def changed_files(paths: DataFrame, root: str) -> DataFrame:
    """path of changed files strictly below root with a suffix that is read; relative paths are taken from root."""
    base = root.rstrip("/")
    full = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(base + "/"), F.col("path")))
    p = paths.select(full.alias("path")).where(F.col("path").startswith(base + "/") & ~F.col("path").contains("/../"))
    return p.where(suffix(F.col("path")).isin(*ALL_SUFFIXES)).distinct()


def source_ids(paths: DataFrame) -> DataFrame:
    return paths.select(stem(F.col("path")).alias("source_id")).where("source_id <> ''").distinct()


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """upload_id, name and stored_name of uploads: a name that is taken or comes again gets the next free (2), (3), ...

    Numbers that stored files or uploads have in their own names are not free, so that nothing is overwritten.
    """
    ending = F.regexp_extract("name", r"(?<=.)(\.[^.]*)$", 1)
    named = taken.select("name").unionByName(wanted.select("name")).distinct().withColumn("ending", ending).withColumn("head", stem(F.col("name")))
    number = F.regexp_extract("head", r" \(([0-9]{1,9})\)$", 1).cast("int")
    held = named.where("head rlike ' [(][0-9]{1,9}[)]$'").select(F.concat(F.regexp_replace("head", r" \([0-9]{1,9}\)$", ""), "ending").alias("name"), number.alias("n")).where("n > 1")
    held = held.unionByName(taken.select("name", F.lit(1).alias("n"))).groupBy("name").agg(F.array_sort(F.collect_set("n")).alias("held"))
    w = wanted.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("upload_id"))).join(held, "name", "left").withColumn("held", F.coalesce("held", F.array().cast("array<int>")))
    # before the t-th of the held numbers, x, lie x - t free ones
    w = w.withColumn("n", F.col("k") + F.size(F.filter("held", lambda x, t: x - t - 1 < F.col("k"))))
    stored = F.concat(stem(F.col("name")), F.lit(" ("), F.col("n").cast("string"), F.lit(")"), ending)
    return w.select("upload_id", "name", F.when(F.col("n") == 1, F.col("name")).otherwise(stored).alias("stored_name"))


def documents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as source_id, order_hint, raw_text."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("source_id"), F.col("doc_id").alias("order_hint"), F.col("text").alias("raw_text"))
