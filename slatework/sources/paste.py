"""Lists pasted from a page, whose rows alternate between numbers and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.operators.ordering import running


def paste_pairs(lines: DataFrame, number: str = r"^\s*[0-9]+(\.[0-9]+)?(\s+[0-9.%-]+)*\s*$", name: str = r"^[\p{Lu}][\p{L}.'-]*(\s+[\p{L}.'-]+)+$") -> DataFrame:
    """``row_no, name, value``: every name line with the first number of the number line last seen before it.

    Input: ``row_no, line``. Lines that are neither fall out; a number serves the next name only, and a name
    without a number before it falls out. The last number and name are found by a running fold over range partitions.
    """
    kinds = lines.withColumn("_num", F.when(F.col("line").rlike(number), F.regexp_extract("line", r"([0-9]+(?:\.[0-9]+)?)", 1).cast("double")))
    kinds = kinds.withColumn("_name", F.when(F.col("line").rlike(name), F.trim("line"))).where("_num is not null or _name is not null")
    mark = F.struct(F.col("_num").alias("value"), F.col("_name").alias("name"))
    seen = running(kinds, [], [F.col("row_no")], last_before={"_before": mark})
    return seen.where("_name is not null and _before.value is not null").select("row_no", F.col("_name").alias("name"), F.col("_before.value").alias("value"))
