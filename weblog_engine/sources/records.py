"""Records of large quoted CSV files, read by many tasks.

A quoted field may hold line breaks, so where a record ends depends on all quotes
before. Lines are read in blocks as Spark splits the file; the quotes of each block
are counted, a running sum over a file's blocks (a row a block) gives the parity at
which each begins, and one inside a block the parity at each line. A line with even
parity before and after is a record and stays where it is; only lines of records
that span several are brought together, over block ends too.

Quotes inside a quoted field are doubled, as RFC 4180 has them; a quote that is
never closed makes one record of the rest of its file. Line breaks inside a field
are kept as they are; a carriage return that ends a record is not part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, block, line, record): each record's text; (file, block, line) is its
    place in order. Empty lines between records are records without text."""
    m = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        m.file_path.alias("file"), m.file_block_start.alias("block"), F.monotonically_increasing_id().alias("line"), "value",
        (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))).cast("long").alias("quotes"))
    in_block = Window.partitionBy("file", "block").orderBy("line")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def running(rows: DataFrame, column: str, name: str) -> DataFrame:
        """The sum of ``column`` over a file's lines up to each line."""
        blocks = rows.groupBy("file", "block").agg(F.sum(column).alias("_t"))
        before = blocks.select("file", "block", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
        return rows.withColumn("_in", F.sum(column).over(in_block)).join(before, ["file", "block"]) \
            .withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before")

    lines = running(lines, "quotes", "upto")
    inside_before, inside_after = (F.col("upto") - F.col("quotes")) % 2 == 1, F.col("upto") % 2 == 1
    lines = lines.select("file", "block", "line", "value", inside_before.alias("a"), inside_after.alias("b"))
    whole = lines.where("NOT a AND NOT b").select("file", "block", "line", F.col("value").alias("record"))
    parts = lines.where("a OR b").withColumn("starts", (~F.col("a")).cast("long"))
    parts = running(parts, "starts", "number").groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("l"))
    joined = parts.select("file", F.col("l")[0]["block"].alias("block"), F.col("l")[0]["line"].alias("line"),
                          F.array_join(F.col("l")["value"], "\n").alias("record"))
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r$", ""))
