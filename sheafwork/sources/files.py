"""Loading folders of documents, and writing texts, backups and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load_folder(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder and its subfolders as deliveries (case_id, arrival, name, content): the case is the folder of a file, arrival its place by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    parts = F.split("path", "/")
    named = files.select("path", F.element_at(parts, -2).alias("case_id"), F.element_at(parts, -1).alias("name"))
    # paths are numbered without their contents, which meet their numbers afterwards
    numbered = named.withColumn("arrival", F.row_number().over(Window.partitionBy("case_id").orderBy("path")).cast("long"))
    return numbered.join(files.select("path", "content"), "path").select("case_id", "arrival", "name", "content")


def append_exceptions(rejects: DataFrame, path: str) -> None:
    """Rejects added to the table of exceptions."""
    rejects.write.mode("append").parquet(path)


def write_texts(texts: DataFrame, path: str) -> None:
    """One text file for each case, in a folder named by the case."""
    texts.select("case_id", "text").repartition("case_id").write.partitionBy("case_id").option("lineSep", "\n").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines of texts (case_id, ord, line) in folders by case, as many files as a case needs: by name, then by line, they read in order."""
    placed = lines.select("case_id", "ord", F.col("line").alias("value"))
    placed.repartitionByRange("case_id", "ord").sortWithinPartitions("case_id", "ord").drop("ord").write.partitionBy("case_id").text(path)


def write_backups(backups: DataFrame, path: str) -> None:
    """JSON documents by case, a line and a file each, from documents (case_id, json) or their fragments (case_id, part_no, place, text). Fragments are sorted, which spills, and written one after the other with a space between, so no document is held whole."""
    if "json" in backups.columns:
        backups.select("case_id", F.col("json").alias("value")).repartition("case_id").write.partitionBy("case_id").text(path)
    else:
        dealt = backups.repartition("case_id").sortWithinPartitions("case_id", "part_no", "place")
        dealt.select("case_id", F.col("text").alias("value")).write.partitionBy("case_id").option("lineSep", " ").text(path)


def overwrite_readings(readings: DataFrame, path: str) -> None:
    """Readings written over those of the same cases only."""
    readings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """Rows of a backup (case_id, part, json) as JSON lines in folders by case and part."""
    records.select("case_id", "part", F.col("json").alias("value")).write.partitionBy("case_id", "part").text(path)
