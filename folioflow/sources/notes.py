"""Notes from files and tables, as (doc_id, text), and where the cursor stands after an edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edits
from . import scratch


def folder(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """A note for each file below ``path``: its path as Spark names it (doc_id) and its whole text."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def numbered(notes: DataFrame) -> DataFrame:
    """``notes`` with an id of its own for each in note_id, whatever their doc_ids: a written table, so that ids last."""
    return scratch.written(notes.withColumn("note_id", F.monotonically_increasing_id()))


def whole(notes: DataFrame) -> DataFrame:
    """doc_id, text, cursor (0) and input, the whole text."""
    return notes.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("cursor"), F.coalesce("text", F.lit("")).alias("input"))


def selection(notes: DataFrame, anchor: str = "anchor", head: str = "head", strict: bool = False, units: bool = False) -> DataFrame:
    """``notes`` with sel_from, sel_to, cursor and input, the selected text; rows without both ends have a null input, or are an error if ``strict``. Places are code
    points, or UTF-16 units with ``units``, where one within a pair of units selects as the one before it does."""
    start, end = F.least(anchor, head), F.greatest(anchor, head)
    both = F.col(anchor).isNotNull() & F.col(head).isNotNull()
    place = (lambda c: edits.in_points(F.col("text"), c)) if units else (lambda c: c)
    text = F.substr(F.col("text"), (place(start) + 1).cast("int"), (place(end) - place(start)).cast("int"))
    none = F.raise_error(F.lit("no selection")).cast("string") if strict else F.lit(None).cast("string")
    return notes.select("doc_id", "text", start.alias("sel_from"), end.alias("sel_to"), F.col(head).alias("cursor"), F.when(both, text).otherwise(none).alias("input"))


def pasted(notes: DataFrame, clips: DataFrame) -> DataFrame:
    """``notes`` (doc_id, text, cursor) with the texts of ``clips`` (doc_id, text) that are pasted into them as input."""
    return notes.select("doc_id", "text", "cursor").join(clips.select("doc_id", F.col("text").alias("input")), "doc_id")


def cursor_after(plan: Column, units: bool = False) -> Column:
    """Where the cursor stands after a plan: behind the insert of its first edit by place; null for an empty plan. In UTF-16 units if the plan is (``units``)."""
    size = edits.n_units if units else F.length
    first = F.get(F.array_sort(F.transform(plan, lambda e, i: F.struct(e["from"].alias("from"), i.alias("i"), size(e["insert"]).alias("n")))), F.lit(0))
    return first["from"] + first["n"]
