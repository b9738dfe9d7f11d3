"""File sources: text folders, JSON lines, judgments."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of the .md, .mdx and .txt files of a folder, not of its subfolders;
    doc_id is the file's name."""
    name = F.col("_metadata.file_name")
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=False)
    return files.select(name.alias("doc_id"), F.col("value").alias("text")).where(F.col("doc_id").rlike(r"^.+\.(md|mdx|txt)$"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(_id, title, text); blank lines are skipped."""
    return spark.read.schema("_id string, title string, text string").option("mode", "FAILFAST").json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, id, grade) of tab-separated lines after a header; incomplete lines are
    skipped, and the last line of a pair counts. Files are split like any text; a line's place is
    its split's and its number in it."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), place.alias("place"))
    parts = F.split("value", "\t")
    rows = lines.select("place", *[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("query_id", "id", "grade"))])
    heads = lines.where("place.split = 0").groupBy(F.col("place.file").alias("file")).agg(F.min("place").alias("head"))
    body = rows.join(F.broadcast(heads), rows["place"] == heads["head"], "left_anti")
    full = body.where("query_id <> '' and id <> '' and grade <> ''")
    return full.groupBy("query_id", "id").agg(F.max_by(F.expr("try_cast(grade AS double)"), "place").alias("grade"))


def read_f32(spark: SparkSession, path: str) -> DataFrame:
    """(ord, embedding) of a matrix file: the number of columns as four bytes, then rows of
    four-byte floats, all little-endian. Rows are read in splits."""
    dim = int.from_bytes(spark.sparkContext.binaryRecords(path, 4).first(), "little")
    # Four bytes before the first row: fields of one float, of which the first is the head.
    floats = spark.sparkContext.binaryRecords(path, 4).zipWithIndex().filter(lambda x: x[1] > 0)
    rows = floats.map(lambda x: ((x[1] - 1) // dim, (x[1] - 1) % dim, struct.unpack("<f", x[0])[0])).toDF("ord long, place long, value float")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda v: v["value"])
    return rows.groupBy("ord").agg(in_order.alias("embedding"))
