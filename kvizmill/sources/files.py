"""Readers and writers of files beside parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that is one document or list; the schema is given, so that nothing is read twice."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A table of a database over JDBC, read in ranges of a numeric key. The driver's jar is the session's matter."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """``username, link`` of a text file of channels or feeds, one a line: names with or without @, or links; what follows # is a remark."""
    line = F.trim(F.regexp_replace("value", r"\s*(?:^|\s)#.*$", ""))
    name = F.regexp_extract(line, r"^(?:https?://)?(?:t\.me/(?:s/)?|@)?(\w+)/?$", 1)
    lines = spark.read.text(path).select(line.alias("link"), F.nullif(name, F.lit("")).alias("username")).where("link <> ''")
    return lines.select("username", "link").distinct()


def read_markdown_questions(spark: SparkSession, path: str) -> DataFrame:
    """``path, number, id, body`` of Markdown files with blocks ``### 12. (#345)`` or numbered ``12. ...``."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.replace("value", F.lit("\r"), F.lit("")).alias("text"))
    blocks = files.select("path", F.explode(F.split("text", r"(?m)^(?=(?:#{2,4}\s*)?(?:Q)?\d+\s*[.(])")).alias("block"))
    head = r"^(?:#{2,4}\s*)?Q?(\d+)\s*\.?\s*(?:\((?:#|id\s*)?(\d+)\))?\.?\s*"
    found = blocks.where(F.regexp_like("block", F.lit(head)))
    return found.select(
        "path",
        F.regexp_extract("block", head, 1).cast("int").alias("number"),
        F.regexp_extract("block", head, 2).try_cast("long").alias("id"),
        F.regexp_replace(F.regexp_replace("block", head, ""), r"^\s+|\s+$", "").alias("body"),
    )


def read_survey(spark: SparkSession, path: str, categories: list[str]) -> DataFrame:
    """``person, category, score`` of a CSV with a name and a column per category; blanks are 0, nameless rows are left out."""
    wide = spark.read.csv(path, header=True)
    named = wide.where(F.trim(F.coalesce(F.col(wide.columns[0]), F.lit(""))) != "")
    scores = [F.coalesce(F.col(f"`{c}`").try_cast("int"), F.lit(0)).alias(c) for c in categories]
    return named.select(F.col(wide.columns[0]).alias("person"), *scores).unpivot("person", categories, "category", "score")


def unprocessed(rows: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the processed ones."""
    return rows.join(processed.select(key), key, "left_anti")
