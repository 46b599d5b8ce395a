"""Clean-up of notes: hyphens, wrapped lines, glyphs, white space, bullets, numbers and headings. Text in, text out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as js
from . import lines as L
from .edits import bound


def _free() -> Column:
    return ~F.col("kind").isin(*js.PROTECTED)


# Each step of the clean-up is a function of rows: lines (doc_id, line_no, line, sep, raw, kind, block_no, off), one window partition by doc_id apart, which
# come back with line and sep as the step leaves them, ``did`` (whether it changes something there) and ``edit``, what it changes: an edit (from, to, insert) in the
# text of the rows it was given, or null. Steps that take rows away say so. ``plans.format`` chains them over one table of lines.


def _changed(rows: DataFrame, line: Column, start: Column | None = None, end: Column | None = None, insert: Column | None = None) -> DataFrame:
    """``rows`` with ``line`` in place of their lines; the edit of a line that differs is the whole line, or from ``start`` to ``end`` in it."""
    rows = rows.withColumn("_line", line)
    at = F.col("off") + (F.lit(0) if start is None else start)
    edit = _edit(at, F.col("off") + (F.length("line") if end is None else end), F.col("_line") if insert is None else insert)
    differs = F.col("_line") != F.col("line")
    # What a changed line is must be found again, unless it is protected.
    raw = F.when(differs & ~F.col("raw").isin("frontmatter", "fencedCode"), L.raw_kind(F.col("_line"))).otherwise(F.col("raw"))
    return rows.withColumns({"did": differs, "edit": F.when(differs, edit), "raw": raw, "line": F.col("_line")})


def _rows(notes: DataFrame) -> DataFrame:
    return L.with_off(L.classified(L.raw_lines(notes)))


def _ticks(k: DataFrame) -> DataFrame:
    """``k`` with ticks_before, the number of backticks in a line's block before the line, and ticks, those of the block."""
    block = Window.partitionBy("doc_id", "block_no").orderBy("line_no")
    k = k.withColumn("_own", F.length("line") - F.length(F.replace("line", F.lit("`"))))
    before = F.sum("_own").over(block.rowsBetween(Window.unboundedPreceding, -1))
    return k.withColumns({"ticks_before": F.coalesce(before, F.lit(0)), "ticks": F.sum("_own").over(block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_next": F.lead("line").over(block)})


def dehyphenate_rows(k: DataFrame) -> DataFrame:
    """Lines that end in a hyphen behind a letter lose it and their sep, where the next line of their block begins with a letter and no code is open. A letter that
    ends one break cannot begin the next: of lines that are only a letter and a hyphen every other one is joined."""
    block = Window.partitionBy("doc_id", "block_no")
    ordered = block.orderBy("line_no")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = _ticks(k)
    here = F.col("ticks_before") + F.col("_own")
    in_code = (here % 2 == 1) & (F.col("ticks") > here)
    breaks = _free() & F.col("line").rlike(r"[a-z]-\z") & F.coalesce(F.col("_next").rlike("^[a-z]"), F.lit(False)) & ~in_code
    k = k.withColumns({"_breaks": breaks, "_short": breaks & (F.length("line") == 2)})
    last = F.coalesce(F.last(F.when(~F.col("_short"), F.struct("line_no", "_breaks")), ignorenulls=True).over(upto), F.struct((F.min("line_no").over(ordered) - 1).alias("line_no"), F.lit(False).alias("_breaks")))
    even = (F.col("line_no") - last["line_no"]) % 2 == 0
    joins = F.col("_breaks") & (~F.col("_short") | (even == last["_breaks"]))
    k = k.withColumn("_joins", joins)
    edit = _edit(F.col("off") + F.length("line") - 1, F.col("off") + F.length("line") + 1, F.lit(""))
    joined = F.when(F.col("_joins"), F.substr("line", F.lit(1), F.length("line") - 1)).otherwise(F.col("line"))
    return k.withColumns({"did": F.col("_joins"), "edit": F.when(F.col("_joins"), edit), "sep": F.when(F.col("_joins"), "").otherwise(F.col("sep")), "line": joined})


def dewrap_rows(k: DataFrame) -> DataFrame:
    """Line feeds inside paragraphs become spaces. A paragraph's edit is the whole block, which is known when its lines are put together (``merged``)."""
    # Paragraph lines in a row are of one block.
    after = F.lead("kind").over(Window.partitionBy("doc_id", "block_no").orderBy("line_no"))
    inner = (F.col("kind") == "paragraph") & (after == "paragraph") & (F.col("sep") == "\n")
    return k.withColumn("sep", F.when(inner, " ").otherwise(F.col("sep")))


def merged(k: DataFrame, **sums: Column) -> DataFrame:
    """Rows whose sep isn't a line feed put together with the next one, within the notes' partitions: doc_id, line_no, line, sep, raw and the columns ``sums`` of
    their rows; ``did`` and ``edit`` are those of paragraphs that became one line."""
    # By block and line, the order that the steps before need for their blocks.
    ordered = Window.partitionBy("doc_id").orderBy("block_no", "line_no")
    above = F.sum((F.col("sep") == "\n").cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    k = k.withColumn("_at", F.coalesce(above, F.lit(0)))
    each = F.array_sort(F.collect_list(F.struct("line_no", "line", "sep")))
    out = k.groupBy("doc_id", "_at").agg(each.alias("_each"), F.min_by("raw", "line_no").alias("raw"), *[v.alias(n) for n, v in sums.items()])
    whole = F.array_join(F.transform("_each", lambda x: F.concat(x["line"], x["sep"])), "")
    out = out.withColumns({"sep": F.element_at("_each", -1)["sep"], "did": F.exists("_each", lambda x: x["sep"] == " ")})
    out = out.withColumn("line", F.when(F.size("_each") == 1, F.get("_each", F.lit(0))["line"]).otherwise(F.substr(whole, F.lit(1), F.length(whole) - F.length("sep"))))
    out = L.with_off(out.withColumnRenamed("_at", "line_no").withColumn("raw", F.when(F.size("_each") > 1, L.raw_kind(F.col("line"))).otherwise(F.col("raw"))))
    block = _edit(F.col("off"), F.col("off") + F.length("line") + F.length("sep"), F.concat("line", "sep"))
    return out.withColumn("edit", F.when(F.col("did"), block)).drop("_each")


def ligature_rows(k: DataFrame) -> DataFrame:
    """Glyphs become plain letters outside protected blocks and inline code, which may span lines of a block."""
    k = _ticks(k)
    plain = lambda x: reduce(lambda t, g: F.replace(t, F.lit(g[0]), F.lit(g[1])), js.GLYPHS.items(), x)
    # Before the i-th piece between backticks stand so many of the block; the piece is code if they are odd and one more follows.
    code = lambda i: ((F.col("ticks_before") + i) % 2 == 1) & (F.col("ticks") > F.col("ticks_before") + i)
    pieces = F.transform(F.split("line", "`", -1), lambda x, i: F.when(code(i), x).otherwise(plain(x)))
    some = F.col("line").rlike("[" + "".join(js.GLYPHS) + "]")
    fixed = F.when(_free() & some, F.when(F.col("ticks") == 0, plain(F.col("line"))).otherwise(F.array_join(pieces, "`"))).otherwise(F.col("line"))
    return _changed(k, fixed)


def whitespace_rows(k: DataFrame) -> DataFrame:
    """Lines with single spaces inside and no blanks at their ends; of three or more blank lines in a row only the first is still there, with their edit."""
    blank = F.col("kind") == "blank"
    near = {"_one": F.lag("kind", 1), "_two": F.lag("kind", 2), "_after": F.lead("kind", 1), "_third": F.lead("kind", 2)}
    whole = L.by_doc().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = F.length("line") + F.length("sep")
    k = k.withColumns({"_total": F.sum(size).over(whole), **{n: F.coalesce(c.over(L.by_doc()) == "blank", F.lit(False)) for n, c in near.items()}})
    # A blank line behind another one goes if a third one is before or behind it.
    goes = blank & F.col("_one") & (F.col("_two") | F.col("_after"))
    opens = blank & ~F.col("_one") & F.col("_after") & F.col("_third")
    k = k.withColumns({"_goes": goes, "_opens": opens, "_behind": F.col("off") + size})
    lead = F.regexp_extract("line", f"^{js.WS}*", 0)
    tidy = F.concat(lead, F.regexp_replace(F.regexp_replace(F.substring("line", F.length(lead) + 1, F.length("line")), "  +", " "), r"[ \t]+\z", ""))
    # A line that is white space only is blank, so its lead never reaches the end.
    loose = F.col("line").rlike(r"  |[ \t]\z") & _free() & ~blank & (F.col("kind") != "tableRow")
    k = _changed(k, F.when(loose, tidy).otherwise(F.col("line")))
    k = k.withColumn("_order", F.col("line_no")).where("not _goes")
    # A run ends where the next line that stays begins, or with the note.
    left = L.in_place(k)
    k = k.withColumns({"line_no": F.row_number().over(left).cast("long") - 1, "_end": F.coalesce(F.lead("off").over(left), F.col("_total"))})
    squeezed = _edit(F.col("_behind"), F.col("_end"), F.lit(""))
    return k.withColumns({"did": F.col("did") | F.col("_opens"), "edit": F.when(F.col("_opens"), squeezed).otherwise(F.col("edit"))})


def bullet_rows(k: DataFrame) -> DataFrame:
    """Bullets of list items become hyphens."""
    lead = F.length(F.regexp_extract("line", js.BULLET, 1))
    return _changed(k, F.when(F.col("kind") == "listItem", F.regexp_replace("line", js.BULLET, "$1-$3")).otherwise(F.col("line")), lead, lead + 1, F.lit("-"))


def ordered_rows(k: DataFrame) -> DataFrame:
    """Ordered items are counted from 1 at each indentation; anything but list items and blank lines starts anew.

    The number of an item is how many items of its indentation lie behind the last one with a smaller indentation, within its segment. Each indentation of
    a segment is a window of its own, in which the count at the last item with a smaller one is taken off; an item is repeated for its own and the larger
    indentations of its note, which are few (a new one takes as many characters)."""
    part = lambda i: F.regexp_extract("line", js.ORDERED, i)
    item = (F.col("kind") == "listItem") & F.col("line").rlike(js.ORDERED)
    so_far = L.in_place(k).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = k.withColumns({"_segment": F.sum((~F.col("kind").isin("blank", "listItem")).cast("int")).over(so_far), "_indent": F.when(item, F.length(part(1)))})
    # Those of the note, not of the segment: these need no other order of the lines.
    levels = F.collect_set("_indent").over(Window.partitionBy("doc_id"))
    k = k.withColumn("_levels", F.when(F.col("_indent").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.filter(levels, lambda v: v >= F.col("_indent"))))
    k = k.withColumn("_level", F.explode("_levels"))
    upto = Window.partitionBy("doc_id", "_segment", "_level").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = k.withColumn("_count", F.sum((F.col("_indent") == F.col("_level")).cast("int")).over(upto))
    before = F.coalesce(F.max(F.when(F.col("_indent") < F.col("_level"), F.col("_count"))).over(upto), F.lit(0))
    k = k.withColumn("_number", (F.col("_count") - before).cast("string")).where("_indent is null or _indent = _level")
    plain = F.regexp_replace(part(2), "^0+(?=[0-9])", "")
    renumbered = F.concat(part(1), F.col("_number"), F.substring("line", F.length(part(1)) + F.length(part(2)) + 1, F.length("line")))
    line = F.when(F.col("_indent").isNotNull() & (plain != F.col("_number")), renumbered).otherwise(F.col("line"))
    return _changed(k, line, F.col("_indent"), F.col("_indent") + F.length(part(2)), F.col("_number"))


def heading_levels(k: DataFrame) -> DataFrame:
    """``k`` with _mark, the level of a heading line, and _to, the level it gets: its place plus the least (level - place) so far."""
    is_heading = F.col("line").rlike(js.HEADING)
    so_far = L.in_place(k).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = k.withColumns({"_mark": F.when(is_heading, F.length(F.regexp_extract("line", js.HEADING, 1))), "_ord": F.sum(is_heading.cast("int")).over(so_far)})
    return k.withColumn("_to", (F.col("_ord") + F.min(F.col("_mark") - F.col("_ord")).over(so_far)).cast("int"))


def heading_rows(k: DataFrame) -> DataFrame:
    """No heading is more than one level below the heading before it (``heading_levels``, which a step that leaves headings alone may have come behind). Code is not
    excepted."""
    if "_to" not in k.columns:
        k = heading_levels(k)
    line = F.when(F.col("_mark").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("_to")), F.substring("line", F.col("_mark") + 1, F.length("line")))).otherwise(F.col("line"))
    return _changed(k, line)


def dehyphenate(notes: DataFrame) -> DataFrame:
    """Words broken by a hyphen at a line end are joined within unprotected blocks, outside inline code."""
    return L.rebuilt(dehyphenate_rows(_rows(notes)), "line", "sep")


def dewrap(notes: DataFrame) -> DataFrame:
    """The lines of each paragraph become one, joined by single spaces."""
    return L.rebuilt(dewrap_rows(_rows(notes)), "line", "sep")


def decompose_ligatures(notes: DataFrame) -> DataFrame:
    """Typographic glyphs become plain letters outside protected blocks and inline code."""
    return L.rebuilt(ligature_rows(_rows(notes)), "line", "sep")


def tidy_whitespace(notes: DataFrame) -> DataFrame:
    """Runs of spaces inside lines become one, blanks at line ends go, and of three or more blank lines in a row the first stays."""
    return L.rebuilt(whitespace_rows(_rows(notes)), "line", "sep")


def normalize_bullets(notes: DataFrame) -> DataFrame:
    """Bullets of list items become hyphens."""
    return L.rebuilt(bullet_rows(_rows(notes)), "line", "sep")


def normalize_ordered(notes: DataFrame) -> DataFrame:
    """Ordered items are counted from 1 at each indentation (``ordered_rows``)."""
    return L.rebuilt(ordered_rows(_rows(notes)), "line", "sep")


def mask_inline_code(text: Column, sign: str = "\0") -> Column:
    """``text`` with the inside of each pair of backticks, over lines too, put out of sight: as many times ``sign``."""
    parts = F.regexp_extract_all(text, F.lit("`[^`]*`|[^`]+|`"), F.lit(0))
    hidden = lambda x: F.concat(F.lit("`"), F.repeat(F.lit(sign), F.length(x) - 2), F.lit("`"))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^`[^`]*`\z"), hidden(x)).otherwise(x)), "")


def headings(notes: DataFrame) -> DataFrame:
    """doc_id, ord (from 1), line_no, off, level, title of every heading line; code is not excepted."""
    h = L.lines(notes).where(F.col("line").rlike(js.HEADING)).withColumn("level", F.length(F.regexp_extract("line", js.HEADING, 1)).cast("long"))
    title = F.regexp_replace(F.substring("line", F.col("level").cast("int") + 1, F.length("line")), f"^{js.WS}+|{js.WS}+\\z", "")
    return h.select("doc_id", F.row_number().over(L.by_doc()).cast("long").alias("ord"), "line_no", "off", "level", title.alias("title"))


def normalize_headings(notes: DataFrame) -> DataFrame:
    """No heading is more than one level below the heading before it (``heading_rows``)."""
    rows = L.lines(notes).withColumn("sep", F.when(F.lead("line_no").over(L.by_doc()).isNull(), "").otherwise("\n")).withColumn("raw", F.lit("paragraph"))
    return L.rebuilt(heading_rows(rows), "line", "sep")


def shift_headings(text: Column, by: Column) -> Column:
    """Every heading mark of ``text`` moved by ``by`` levels, within 1 and 6."""
    mark = lambda x: F.regexp_extract(x, r"^(#{1,6})(?=" + js.WS + r"|\z)", 1)
    moved = lambda x, by: F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), F.length(mark(x)) + by))), F.substring(x, F.length(mark(x)) + 1, F.length(x)))
    # The mark of the last line must have white space behind it, which for the others may be their line feed.
    marked = lambda x, i, parts: x.startswith("#") & (mark(x) != "") & ((i < F.size(parts) - 1) | x.rlike(js.HEADING))
    each = lambda parts, by: F.array_join(F.transform(parts, lambda x, i: F.when(marked(x, i, parts), moved(x, by)).otherwise(x)), "\n")
    return bound(by, lambda by: bound(F.split(text, "\n", -1), lambda parts: each(parts, by)))


def _levels(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, "\n", -1), lambda x: x.startswith("#") & x.rlike(js.HEADING)), lambda x: F.length(F.regexp_extract(x, js.HEADING, 1)))


def context_level(text: Column, cursor: Column) -> Column:
    """The level of the last heading before ``cursor``, null without one."""
    return F.try_element_at(_levels(F.substr(text, F.lit(1), cursor.cast("int"))), F.lit(-1))


def cascaded(text: Column, cursor: Column, fragment: Column) -> Column:
    """``fragment`` with its headings moved, so that the highest is one below the last heading before ``cursor``; null if either has no heading."""
    shift = context_level(text, cursor) + 1 - F.array_min(_levels(fragment))
    return bound(shift, lambda s: F.when(s.isNotNull(), shift_headings(fragment, s)))


def _edit(start: Column, end: Column, insert: Column) -> Column:
    return F.struct(start.cast("int").alias("from"), end.cast("int").alias("to"), insert.alias("insert"))


_PLAN = "array<struct<from:int,to:int,insert:string>>"


def cascade(text: Column, cursor: Column, fragment: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """The plan that puts the cascaded fragment at ``cursor``, or in the place of ``start`` to ``end`` where these are given; empty if nothing cascades."""
    moved = cascaded(text, cursor, fragment)
    at, to = (cursor, cursor) if start is None else (F.coalesce(start, cursor), F.coalesce(end, cursor))
    return bound(moved, lambda m: F.when(m.isNull(), F.array().cast(_PLAN)).otherwise(F.array(_edit(at, to, m))))


def cascade_or_insert(text: Column, cursor: Column, fragment: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """As ``cascade``, but a fragment that doesn't cascade is put in as it is; an empty or null one gives an empty plan."""
    at, to = (cursor, cursor) if start is None else (F.coalesce(start, cursor), F.coalesce(end, cursor))
    return F.when(F.coalesce(F.length(fragment), F.lit(0)) == 0, F.array().cast(_PLAN)).otherwise(F.array(_edit(at, to, F.coalesce(cascaded(text, cursor, fragment), fragment))))
