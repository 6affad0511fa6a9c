"""Places in an order over tables of any size: a range-partitioned sort, counts by partition, no window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.shared import Written


def numbered(rows: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """rows with their place (from 0) in an order that leaves no ties; the sorted rows are written once.

    A row's number within its partition comes with it, and the partitions' counts, one row each, give what lies before.
    """
    made = Written(rows.sparkSession)
    at = F.monotonically_increasing_id()
    held = made(rows.orderBy(*order).select(*rows.columns, at.alias("_at")), "order")
    part = F.shiftrightunsigned("_at", 33)
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition of the sort
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("_part", part).join(F.broadcast(before), "_part").select(*rows.columns, place.alias(name))


def numbered_in(rows: DataFrame, group: str, order: list[Column], name: str = "pos") -> DataFrame:
    """rows with their place (from 1) in their group: the place among all, less that of the group's first."""
    every = numbered(rows, [F.col(group).asc(), *order], "_place")
    first = every.groupBy(group).agg(F.min("_place").alias("_first"))
    return every.join(first, group).select(*rows.columns, (F.col("_place") - F.col("_first") + 1).alias(name))


def natural(c: Column) -> Column:
    """A text that sorts as people do, whatever the length of its numbers: lower case; a number is its digits' count, in eight places, and its digits without leading zeros."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))

    def number(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        return F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 8, "0"), digits)

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(p)), "")


def natural_order(rows: DataFrame, column: str, key: str, descending: bool = False) -> DataFrame:
    """rows with their place (from 1) in natural order of a column, ties by the text itself and then by ``key``; descending turns all of it round. Null texts count as empty."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    order = [natural(text), text, F.col(key)]
    return numbered(rows, [c.desc() if descending else c.asc() for c in order], "_place").withColumn("pos", F.col("_place") + 1).drop("_place")
