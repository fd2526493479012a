"""Writers. Tables are the canonical form; single files are exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_corpus(df: DataFrame, path: str, by: tuple[str, ...] = ("source",), mode: str = "errorifexists") -> None:
    """Parquet partitioned by source (and split), so that later reads are pruned."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_packed(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows of ``input_ids ARRAY<INT>`` and ``file_names ARRAY<STRING>``."""
    df.select(F.col("input_ids").cast("array<int>").alias("input_ids"), F.col("file_names").cast("array<string>").alias("file_names")).write.mode(mode).parquet(path)


def export_texts(df: DataFrame, folder: str, name: str = "name", text: str = "text") -> None:
    """One text file for each row, written by the executors into a folder that they share."""

    def write(rows):
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            if r[name] is None or "/" in r[name]:
                raise ValueError(f"no file name: {r[name]!r}")
            with open(os.path.join(folder, r[name]), "w", encoding="utf-8", newline="\n") as f:
                f.write(r[text] or "")

    df.select(name, text).foreachPartition(write)


def manifest(prints: DataFrame, n_buckets: DataFrame) -> DataFrame:
    """One row: ``num_docs``, ``num_exact_groups_total``, ``num_exact_duplicate_groups``, ``num_buckets``."""
    groups = prints.groupBy("sha1").agg(F.count(F.lit(1)).alias("n"))
    totals = groups.agg(
        F.sum("n").alias("num_docs"), F.count(F.lit(1)).alias("num_exact_groups_total"), F.count_if(F.col("n") > 1).alias("num_exact_duplicate_groups")
    )
    return totals.crossJoin(n_buckets.agg(F.count(F.lit(1)).alias("num_buckets")))
