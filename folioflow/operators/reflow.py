"""Re-flowing of hard-wrapped text into paragraphs and lists.

A run is a maximal stretch of paragraph and list lines. Where a piece of it begins, and what stands before each line, depends on the line, the one before it
and two facts of the run (its width, whether it has markers): windows by note, no fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as js
from . import lines as L

#: Markers, ends of sentences and the share of a run's width below which a line is short: fixed values.
UNORDERED = rf"^{js.WS}*([-*+•·‣▪◦–—]){js.WS}+({js.DOT}*)\z"
ORDERED = rf"^{js.WS}*([0-9]+[.)]){js.WS}+({js.DOT}*)\z"
SENTENCE_END = r"[.!?:][)\"'’”\]]*\z"
HYPHEN = r"[A-Za-z]-\z"
SHORT = 0.66


def _stripped(x: Column | str) -> Column:
    # Native, and looks at no character but those at the ends.
    return F.btrim(x, F.lit(js.BLANKS))


def reflow_rows(notes: DataFrame) -> DataFrame:
    """doc_id, line_no, flowed (what a line with what follows it becomes), run (the number of its run, null outside of runs that change), off and end."""
    k = L.with_off(L.kinds(notes)).withColumn("flows", F.col("kind").isin("paragraph", "listItem"))
    k = k.withColumn("run", F.sum((~F.col("flows")).cast("int")).over(L.so_far()))
    run = Window.partitionBy("doc_id", "run", "flows")
    ordered = run.orderBy("line_no")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("line").rlike(UNORDERED), "- ").when(F.col("line").rlike(ORDERED), F.concat(F.regexp_extract("line", ORDERED, 1), F.lit(" ")))
    item = F.when(F.col("line").rlike(UNORDERED), F.regexp_extract("line", UNORDERED, 2)).when(F.col("line").rlike(ORDERED), F.regexp_extract("line", ORDERED, 2))
    k = k.withColumn("mark", mark).withColumn("item", _stripped(item)).withColumn("bare", _stripped("line")).withColumn("solid", F.rtrim("line", F.lit(js.BLANKS)))
    k = k.withColumn("listed", F.max(F.col("mark").isNotNull()).over(run)).withColumn("width", F.max(F.length("solid")).over(run)).withColumn("size", F.count("*").over(run))
    k = k.withColumn("prev", F.lag("solid").over(ordered)).withColumn("last", F.lead("line_no").over(ordered).isNull())
    word = F.length(F.regexp_extract("bare", "^[^" + js.WS[1:] + "*", 0))
    short = F.length("prev") + 1 + word <= F.col("width") * F.lit(SHORT)
    ends = ~F.col("prev").rlike(HYPHEN) & (F.col("prev").rlike(SENTENCE_END) | short)
    k = k.withColumn("begins", F.when(F.col("prev").isNull(), True).when(F.col("listed"), F.col("mark").isNotNull()).otherwise(ends))
    k = k.withColumn("piece", F.when(F.col("begins"), F.coalesce("item", "bare")).otherwise(F.col("bare")))
    above = F.lag("piece").over(ordered)
    # In a run with markers only its first piece can be without one.
    tight = F.coalesce(F.max(F.col("mark").isNotNull()).over(before), F.lit(False))
    gap = F.when(F.col("prev").isNull(), "").when(~F.col("begins"), F.when((above == "") | above.rlike(HYPHEN), "").otherwise(" ")).when(tight, "\n").otherwise("\n\n")
    flowed = F.concat(gap, F.when(F.col("begins"), F.coalesce("mark", F.lit(""))).otherwise(""), "piece", F.when(F.col("last"), F.col("sep")).otherwise(""))
    k = k.withColumn("flowed", F.when(F.col("flows") & (F.col("size") > 1), flowed).otherwise(F.concat("line", "sep")))
    # The run as it was, with line feeds before lines instead of behind them: it stays the same where every line does.
    was = F.concat(F.when(F.col("prev").isNull(), "").otherwise("\n"), "line", F.when(F.col("last"), F.col("sep")).otherwise(""))
    k = k.withColumn("differs", F.max(F.col("flowed") != was).over(run) & F.col("flows") & (F.col("size") > 1))
    end = (F.col("off") + F.length("line") + F.length("sep")).cast("int")
    return k.select("doc_id", "line_no", "flowed", F.when(F.col("differs"), F.col("run")).alias("run"), "off", end.alias("end"))


def run_edits(rows: DataFrame) -> DataFrame:
    """doc_id, line_no (of its first line) and edit of every run of ``reflow_rows`` that changes."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "flowed"))), lambda x: x["flowed"])
    runs = rows.where("run is not null").groupBy("doc_id", "run").agg(F.min("line_no").alias("line_no"), F.min("off").alias("from"), F.max("end").alias("to"), F.array_join(each, "").alias("insert"))
    return runs.select("doc_id", "line_no", F.struct("from", "to", "insert").alias("edit"))


def reflow(notes: DataFrame) -> DataFrame:
    """Runs of several lines become pieces. With a marker in the run, each marker begins an item and other lines continue it; else a new paragraph begins
    behind the end of a sentence or a line so short that the next word had fitted. Items follow each other directly, other pieces behind a blank line. A
    line that ends in a hyphen behind a letter is continued without a space. Null text is empty."""
    return L.rebuilt(reflow_rows(notes), "flowed")
