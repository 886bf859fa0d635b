"""Id sets from text, arguments and other files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _parsed(rows: DataFrame, default_type: str) -> DataFrame:
    """(type, id) of rows with a column value: an optional n, w or r before digits, cut at a space or #."""
    text = F.trim(F.regexp_extract("value", "^[^ #]*", 0))
    bad = F.raise_error(F.concat(F.lit("Not an id: "), F.col("value")))
    kind = F.when(text.rlike("^[nwr]"), F.substring(text, 1, 1)).otherwise(default_type)
    number = F.when(text.rlike("^[nwr]?[0-9]+$"), F.regexp_replace(text, "^[nwr]", "").cast("bigint")).otherwise(bad.cast("bigint"))
    return rows.where(text != "").select(kind.alias("type"), number.alias("id")).distinct()


def read_ids(spark: SparkSession, path: str, default_type: str = "n") -> DataFrame:
    """From a text file, one id a line; negative ids are an error."""
    return _parsed(spark.read.text(path), default_type)


def ids_of_arguments(spark: SparkSession, arguments: list[str], default_type: str = "n") -> DataFrame:
    """From words with ids, several in a word parted by tab, space, semicolon, comma, slash or bar."""
    words = [w for a in arguments for w in re.split(r"[\t ;,/|]", a) if w]
    return _parsed(spark.createDataFrame([(w,) for w in words], "value string"), default_type)


def ids_of_objects(objects: DataFrame) -> DataFrame:
    """All (type, absolute id) of objects."""
    return objects.select("type", F.abs("id").alias("id")).distinct()
