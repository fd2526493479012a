"""Readers of corpora. Each returns plain columns; ``source`` is the folder right below the root."""

from __future__ import annotations

import json
import warnings
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.arrow import arrow_map
from corpusmill.operators.fingerprint import fingerprint

CATALOG = "`Text#` int, Type string, Issued string, Title string, Language string, Authors string, Subjects string, LoCC string, Bookshelves string"


def require_folder(path: str) -> None:
    """An error before any job if a local input folder is missing."""
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)


def source_of(path: Column, root: str) -> Column:
    """First folder below the root, or null for files in the root itself."""
    below = F.regexp_extract(path, r"(?:^|/)" + root.strip("/").rpartition("/")[2] + r"/([^/]+)/", 1)
    return F.when(below != "", below)


def text_files(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """``path``, ``source``, ``text`` of all text files below the root; bad bytes become U+FFFD."""
    require_folder(root)
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return rows.select(path.alias("path"), source_of(path, root).alias("source"), F.col("value").alias("text"))


def text_files_lossy(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """As :func:`text_files`, but bad bytes are dropped."""
    require_folder(root)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")

    def run(batches):
        for b in batches:
            texts = [c.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string())], ["path", "text"])

    return arrow_map(rows, run, "path string, text string").select("path", source_of(F.col("path"), root).alias("source"), "text")


def catalog(spark: SparkSession, path: str, schema: str = CATALOG) -> DataFrame:
    """A book catalog in CSV, quoted fields over several lines included."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def first_files(files: DataFrame) -> DataFrame:
    """``book_id``, ``path``, ``text``: of each folder ``epub/<id>/`` the first text file by name."""
    ids = files.withColumn("book_id", F.regexp_extract("path", r"/epub/(\d+)/", 1)).where("book_id <> ''")
    one = ids.groupBy("book_id").agg(F.min(F.struct("path", "text")).alias("r"))
    return one.select(F.col("book_id").cast("int").alias("book_id"), "r.path", "r.text")


def json_records(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """``file_name``, ``rec_idx`` and the fields of JSONL records, in the order of their lines; blank lines are skipped."""
    require_folder(root)
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root, wholetext=True)
    lines = files.select(F.col("_metadata.file_name").alias("file_name"), F.posexplode(F.split("value", "\r?\n")).alias("rec_idx", "line"))
    return lines.where(F.trim("line") != "").select("file_name", "rec_idx", F.from_json("line", schema).alias("r")).select("file_name", "rec_idx", "r.*")


def parquet_columns(spark: SparkSession, path: str, columns: list[str], recursive: bool = False) -> DataFrame:
    """Chosen columns; the others are not read."""
    return spark.read.option("recursiveFileLookup", recursive).parquet(path).select(*columns)


def markup_files(spark: SparkSession, root: str) -> DataFrame:
    """``path``, ``content`` of XML files; part-of-speech variants are never opened."""
    require_folder(root)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(root)
    return rows.where(~F.col("_metadata.file_name").startswith("OBC2POS")).select("path", "content")


def config(path: str) -> dict:
    """A run's settings from a JSON file; anything but a mapping is an error."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def saved_prints(spark: SparkSession, root: str, min_chars: int) -> DataFrame | None:
    """Fingerprints that an earlier run with the same parameter has written below ``root``, or nothing: what to resume from."""
    path = f"{root}/min_chars={min_chars}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(path)


def resumed_prints(spark: SparkSession, root: str, docs: DataFrame, min_chars: int = 200) -> DataFrame:
    """The fingerprints below ``root``, made and written first if they aren't there. Parameters are part of the path, so a table never stands for other ones."""
    found = saved_prints(spark, root, min_chars)
    if found is None:
        fingerprint(docs, min_chars=min_chars).write.mode("overwrite").parquet(f"{root}/min_chars={min_chars}")
        found = saved_prints(spark, root, min_chars)
    return found


def packed_rows(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Packed rows, of one split if the table has splits; asking for one that isn't there is an error, naming one where there are none a warning."""
    rows = spark.read.parquet(path)
    if "split" not in rows.columns:
        if split is not None:
            warnings.warn(f"the table has no splits; {split!r} is ignored", stacklevel=2)
        return rows
    if split is None:
        raise ValueError("the table has splits; name one")
    part = rows.where(F.col("split") == split)
    if part.limit(1).count() == 0:
        raise ValueError(f"no split {split}")
    return part
