"""Positioned words of a page (doc, page, x0, x1, y, text): lines, cells, columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Points: how far a word's middle may be from its line's, and the least gap between two cells.
LINE, GAP = 3.5, 18.0
PAGE = ["doc", "page"]


def lines(words: DataFrame, tolerance: float = LINE) -> DataFrame:
    """words with line, from 0 down the page: a word is of the line above it while it is near the mean middle of that
    line's words so far. The mean moves with each word, so a page's words are folded as one array; a page is bounded."""
    first = ["y", "x0", "x1", "text"]
    rest = [c for c in words.columns if c not in (*PAGE, *first)]
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("n"), F.array().cast("array<bigint>").alias("out"))

    def place(a: Column, w: Column) -> Column:
        far = F.coalesce(F.abs(a["mean"] - w["y"]) > tolerance, F.lit(True)) | (a["at"] < 0)
        at, n = F.when(far, a["at"] + 1).otherwise(a["at"]), F.when(far, F.lit(0.0)).otherwise(a["n"])
        mean = F.when(far, w["y"].cast("double")).otherwise((a["mean"] * a["n"] + w["y"]) / (a["n"] + 1))
        return F.struct(at.alias("at"), mean.alias("mean"), (n + 1).alias("n"), F.concat(a["out"], F.array(at)).alias("out"))

    pages = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*first, *rest))).alias("w"))
    placed = pages.withColumn("line", F.aggregate("w", start, place, lambda a: a["out"]))
    return placed.select(*PAGE, F.explode(F.arrays_zip("w", "line")).alias("z")).select(*PAGE, "z.w.*", "z.line")


def page_lines(words: DataFrame, tolerance: float = LINE) -> DataFrame:
    """(doc, page, line, w): lines(), a row a line, w its words (y, x0, x1, text) down the page. Words of a line follow each
    other once they are sorted, so a fold says where lines begin, and words are shuffled once, by page."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("n"), F.array().cast("array<int>").alias("out"))

    def place(a: Column, w: Column) -> Column:
        far = F.coalesce(F.abs(a["mean"] - w["y"]) > tolerance, F.lit(True)) | (a["i"] == 0)
        n, y = F.when(far, F.lit(0.0)).otherwise(a["n"]), w["y"].cast("double")
        mean = F.when(far, y).otherwise((a["mean"] * a["n"] + w["y"]) / (a["n"] + 1))
        return F.struct((a["i"] + 1).alias("i"), mean.alias("mean"), (n + 1).alias("n"), F.when(far, F.concat(a["out"], F.array(a["i"]))).otherwise(a["out"]).alias("out"))

    pages = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y", "x0", "x1", "text"))).alias("all"))
    begun = pages.withColumn("starts", F.aggregate("all", start, place, lambda a: a["out"]))
    each = begun.select(*PAGE, "all", "starts", F.posexplode_outer("starts").alias("k", "i"))  # a plain one would be filtered before, by a second fold
    size = F.coalesce(F.get(F.col("starts"), F.col("k") + 1), F.size("all")) - F.col("i")
    return each.select(*PAGE, F.col("k").cast("long").alias("line"), F.slice("all", F.col("i") + 1, size).alias("w"))


def cells(words: DataFrame, gap: float = GAP) -> DataFrame:
    """(doc, page, line, cell, x0, x1, text) of words with line: a gap wider than gap parts two cells."""
    along = Window.partitionBy(*PAGE, "line").orderBy("x0", "x1", "text")
    parted = words.withColumn("_gap", (F.col("x0") - F.lag("x1").over(along) > gap).cast("int"))
    celled = parted.withColumn("cell", F.coalesce(F.sum("_gap").over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("long"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda w: w["text"]), " ")
    return celled.groupBy(*PAGE, "line", "cell").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), said.alias("text"))


def in_columns(cells_: DataFrame, heads: DataFrame) -> DataFrame:
    """cells_ with column: the page's head (doc, page, name, x0, x1) whose middle is nearest, the left one of two."""
    centre = lambda a, b: (a + b) / 2
    by_page = heads.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(centre(F.col("x0"), F.col("x1")).alias("c"), "name"))).alias("heads"))
    near = F.array_min(F.transform("heads", lambda h: F.struct(F.abs(h["c"] - centre(F.col("x0"), F.col("x1"))).alias("d"), h["c"].alias("c"), h["name"].alias("name"))))
    return cells_.join(by_page, PAGE, "left").withColumn("column", near["name"]).drop("heads")
