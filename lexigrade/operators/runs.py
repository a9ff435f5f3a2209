"""Gaps and islands: runs of adjacent comments, and parts cut out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigrade.functions.licenses import is_data_line, is_license_line, is_license_text, is_structured, lines_of


def island(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """df with a running number per keys that grows where ``starts`` holds."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(starts.cast("int")).over(window))


def line_runs(comments: DataFrame) -> DataFrame:
    """``comments(path, start_row, end_row, opener, block, trailing, body)`` with ``run``.

    A line comment goes on with the run before it if both are line comments with the same
    opener, neither is trailing and it is on the next row.
    """
    window = Window.partitionBy("path").orderBy("start_row")
    before = lambda c: F.lag(c).over(window)
    goes_on = ~F.col("block") & ~before("block") & (F.col("opener") == before("opener")) & ~F.col("trailing") & ~before("trailing") & (F.col("start_row") == before("end_row") + 1)
    return island(comments, ["path"], ["start_row"], ~F.coalesce(goes_on, F.lit(False)), "run")


def cut_parts(comments: DataFrame, in_part, drop, keys: list[str], order: str) -> DataFrame:
    """Rows with ``segment``: maximal stretches left when parts are dropped.

    A part is a maximal run of comments whose every line passes ``in_part`` (or none does);
    a comment without lines follows the one before it.  Parts whose text ``drop`` accepts go.
    """
    window = Window.partitionBy(*keys).orderBy(order)
    lines = lines_of(F.col("body"))
    flag = F.when(F.size(lines) > 0, F.forall(lines, in_part))
    rows = comments.withColumn("_flag", flag).withColumn("_flag", F.coalesce(F.last("_flag", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    changed = F.col("_flag") != F.lag("_flag").over(window)
    rows = island(rows, keys, [order], F.coalesce(changed, F.lit(True)), "_part")
    parts = rows.groupBy(*keys, "_part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "body"))), lambda s: s.body), "\n").alias("_text"))
    kept = parts.withColumn("_drop", drop(F.col("_text"))).withColumn("segment", F.sum(F.col("_drop").cast("int")).over(Window.partitionBy(*keys).orderBy("_part")))
    return rows.join(kept.where("not _drop").select(*keys, "_part", "segment"), [*keys, "_part"]).drop("_flag", "_part")


def without_structured(comments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Runs without structured data; what is left of a run is tested once more."""
    cut = cut_parts(comments, is_data_line, is_structured, keys, order)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "body"))), lambda s: s.body), "\n")
    good = cut.groupBy(*keys, "segment").agg(text.alias("_text")).where(~is_structured(F.col("_text"))).drop("_text")
    return cut.join(good, [*keys, "segment"], "left_semi")


def without_license(comments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Runs without license text; a run of one comment stays as it is."""
    cut = cut_parts(comments, is_license_line, is_license_text, keys, order)
    single = comments.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n").withColumn("segment", F.lit(0).cast("long"))
    many = cut.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    counted = comments.groupBy(*keys).agg(F.count("*").alias("_all")).where("_all > 1").drop("_all")
    return many.drop("_n").join(counted, keys, "left_semi").select(*comments.columns, "segment").union(single.select(*comments.columns, "segment"))
