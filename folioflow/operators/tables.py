"""Tables drawn with frames, in box characters or ASCII, turned into Markdown tables.

A run is the part of an island of frame and cell lines from its first rule with a corner on: islands, runs and logical rows are running sums over one
window by note, cells are split and merged natively, and a run with lines of unequal numbers of cells is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as js
from . import lines as L

#: Glyphs of frames: fixed values.
SEPARATORS = ("│", "┃", "║", "|")
CORNER = "[┌┬┐├┼┤└┴┘┏┳┓┣╋┫┗┻┛╔╦╗╠╬╣╚╩╝+]"
RULE = "[─━═\\-=]"
_GLYPHS = "┌┬┐├┼┤└┴┘─┏┳┓┣╋┫┗┻┛━╔╦╗╠╬╣╚╩╝═│┃║|+=-"
FRAME = f"^(?:{js.WS}|[{_GLYPHS}])+\\z"
#: A line of a text that is a frame with a corner and a rule.
_TOP = f"(?<![^\\n])(?=(?:{js.WS.replace(chr(92) + 'n', '')}|[{_GLYPHS}])++(?![^\\n]))(?=[^\\n]*{CORNER})[^\\n]*{RULE}"


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^{js.WS}+|{js.WS}+\\z", "")


def _cells(line: Column, separator: Column) -> Column:
    """The cells of a line, without one empty piece before the first and one behind the last separator."""
    parts = F.transform(F.split(line, F.concat(F.lit("\\Q"), separator, F.lit("\\E")), -1), _trimmed)
    parts = F.when((F.size(parts) > 1) & (parts[0] == ""), F.slice(parts, 2, F.size(parts))).otherwise(parts)
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda v: F.replace(v, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def framed(text: Column) -> Column:
    """Whether a text has a rule with a corner, without which it has no drawn table."""
    # A range that has all corners: one comparison a character of texts without any.
    return F.when(text.rlike("[+\u250C-\u256C]"), text.rlike(_TOP)).otherwise(F.lit(False))


def box_rows(notes: DataFrame) -> DataFrame:
    """doc_id, line_no, piece (a line with what follows it, or a whole table in the place of its first line), did and edit: the runs of lines that become tables."""
    k = L.with_off(L.kinds(notes)).select("doc_id", "line_no", "line", "sep", "kind", "off")
    line = F.col("line")
    drawn = ~F.col("kind").isin("fencedCode", "frontmatter") & ~line.rlike(js.BLANK)
    border = drawn & line.rlike(FRAME)
    solid = border | (drawn & line.rlike("[│┃║|]"))
    k = k.withColumn("border", border).withColumn("solid", solid).withColumn("top", border & line.rlike(CORNER) & line.rlike(RULE))
    k = k.withColumn("before", F.coalesce(~F.lag("line").over(L.by_doc()).rlike(js.BLANK), F.lit(False))).withColumn("behind", F.coalesce(~F.lead("line").over(L.by_doc()).rlike(js.BLANK), F.lit(False)))
    k = k.withColumn("island", F.sum((~F.col("solid")).cast("int")).over(L.so_far()))
    island = Window.partitionBy("doc_id", "island")
    upto = island.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = k.withColumn("in_run", F.col("solid") & F.max("top").over(upto))
    content = F.col("in_run") & ~F.col("border")
    k = k.withColumn("content", content).withColumn("group", F.sum((~F.col("content")).cast("int")).over(upto))
    lines = k.where("in_run")
    # The most frequent separator of a run's cell lines, the earlier of equals.
    count = [F.sum(F.when(F.col("content"), F.length("line") - F.length(F.replace("line", F.lit(s)))).otherwise(0)).over(island) for s in SEPARATORS]
    best = F.greatest(*count)
    separator = F.coalesce(*[F.when(c == best, F.lit(s)) for c, s in zip(count, SEPARATORS)])
    cells = lines.withColumn("separator", separator).where("content").withColumn("cells", _cells(F.col("line"), F.col("separator")))
    rows = cells.groupBy("doc_id", "island", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "cells"))), lambda r: r["cells"]).alias("pieces"), F.min(F.size("cells")).alias("least"), F.max(F.size("cells")).alias("most"))
    merged = F.transform(F.sequence(F.lit(0), F.col("most") - 1), lambda c: F.array_join(F.filter(F.transform("pieces", lambda p: F.get(p, c)), lambda v: v != ""), " "))
    runs = rows.withColumn("row", _row(merged)).groupBy("doc_id", "island").agg(F.transform(F.array_sort(F.collect_list(F.struct("group", "row"))), lambda r: r["row"]).alias("rows"), F.min("least").alias("least"), F.max("most").alias("most")).where("least = most")
    rule = _row(F.array_repeat(F.lit("---"), F.col("most")))
    runs = runs.select("doc_id", "island", F.array_join(F.concat(F.slice("rows", 1, 1), F.array(rule), F.slice("rows", F.lit(2), F.size("rows"))), "\n").alias("table"))
    k = k.join(runs, ["doc_id", "island"], "left").withColumn("turned", F.col("table").isNotNull() & F.col("in_run"))
    turned = Window.partitionBy("doc_id", "island", "turned")
    last = F.max_by(F.struct("sep", "behind"), "line_no").over(turned)
    k = k.withColumn("first", F.min("line_no").over(turned) == F.col("line_no")).withColumn("last", last)
    table = F.concat(F.when(F.col("before"), "\n").otherwise(""), "table", "last.sep", F.when(F.col("last.behind") & (F.col("last.sep") == "\n"), "\n").otherwise(""))
    k = k.withColumn("end", F.max(F.col("off") + F.length("line") + F.length("sep")).over(turned)).where(~F.col("turned") | F.col("first"))
    k = k.withColumn("did", F.col("turned")).withColumn("edit", F.when(F.col("turned"), F.struct(F.col("off").alias("from"), F.col("end").cast("int").alias("to"), table.alias("insert"))))
    return k.select("doc_id", "line_no", F.when(F.col("turned"), table).otherwise(F.concat("line", "sep")).alias("piece"), "did", "edit")


def box_table(notes: DataFrame) -> DataFrame:
    """Drawn tables of notes become Markdown tables, with a blank line to neighbouring text; fenced code and front matter are left alone."""
    return L.rebuilt(box_rows(notes), "piece")
