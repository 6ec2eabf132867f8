"""Documents of ordered lines.

A document is a DataFrame of ``part, key, at, line``: parts follow each other, keys order a part,
``at`` orders the lines of one key. Spark deals the keys by ranges, so the part files in name order are
the document, and all lines of a key are in one of them; small ones can be written as one file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>'


def escaped(x: Column) -> Column:
    """Text for an XML attribute."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x.cast("string"), F.lit(a), F.lit(b))
    return x


def element(tag: str, attributes: dict[str, Column], indent: int = 4, close: bool = True) -> Column:
    """``<tag a="..."/>``; null attributes are left out."""
    parts = [F.coalesce(F.concat(F.lit(f' {k}="'), escaped(v), F.lit('"')), F.lit("")) for k, v in attributes.items()]
    return F.concat(F.lit(" " * indent + f"<{tag}"), *parts, F.lit("/>" if close else ">"))


def fixed(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", x)


def section(part: int, rows: DataFrame, key: Column, line: Column, at: int = 0) -> DataFrame:
    return rows.select(F.lit(part).alias("part"), key.cast("string").alias("key"), F.lit(at).alias("at"), line.alias("line"))


def block(part: int, rows: DataFrame, key: Column, *lines: Column | str) -> DataFrame:
    """Several lines for each row, in order."""
    every = F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))
    own = rows.select(key.cast("string").alias("key"), F.posexplode(every).alias("at", "line"))
    return own.select(F.lit(part).alias("part"), "key", "at", "line")


def text(spark: SparkSession, part: int, *lines: str) -> DataFrame:
    """Fixed lines: a head, a foot, a template."""
    return spark.createDataFrame([(part, "", i, line) for i, line in enumerate(lines)], "part int, key string, at int, line string")


def document(*sections: DataFrame) -> DataFrame:
    # dealt by key alone: a part file never ends between the lines of one element, which a reader of parts would lose
    return reduce(DataFrame.union, sections).repartitionByRange("part", "key").sortWithinPartitions("part", "key", "at")


def write(lines: DataFrame, path: str, one_file: bool = False) -> None:
    """Write a document. ``one_file`` sends all lines through one task: for documents that a report or a tool wants whole."""
    ordered = lines.select("line")
    (ordered.coalesce(1) if one_file else ordered).write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")
