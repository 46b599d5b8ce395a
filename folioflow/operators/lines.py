"""Lines and blocks of notes, as tables with one row per line or block.

Everything here is one exchange by ``doc_id`` at most: all windows and regroupings use that key. The only state that isn't a window, open code
fences, is folded over the few candidate lines of a note before its lines are made rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import functions as js


def by_doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def in_place(rows: DataFrame) -> WindowSpec:
    """The lines of a note in their order. Rows that are sorted already by the lines they were (``_order``) or the blocks they were in (``_block``), which ascend with
    line_no, needn't be sorted again."""
    keys = ["_order"] if "_order" in rows.columns else ["_block", "line_no"] if "_block" in rows.columns else ["line_no"]
    return Window.partitionBy("doc_id").orderBy(*keys)


def so_far() -> WindowSpec:
    return by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _texts(notes: DataFrame, *more: str) -> DataFrame:
    return notes.select("doc_id", *more, F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1).alias("ls"))


def lines(notes: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), off (of its first character, code points), line; null text is one empty line."""
    rows = _texts(notes).select("doc_id", F.posexplode("ls").alias("line_no", "line"))
    # Numbered as they stay before they are sorted, so that what follows needn't sort them again.
    rows = rows.withColumn("line_no", F.col("line_no").cast("long"))
    before = F.coalesce(F.sum(F.length("line") + 1).over(by_doc().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("doc_id", "line_no", before.cast("long").alias("off"), "line")


def in_order(notes: DataFrame) -> DataFrame:
    """``lines`` for operators that look at neighbouring lines: with ``next``, the line behind, null behind the last. Notes that share a doc_id are an error."""
    rows = lines(notes).withColumn("next", F.lead("line").over(by_doc()))
    same = F.coalesce(F.lag("line_no").over(by_doc()) == F.col("line_no"), F.lit(False))
    return rows.withColumn("line", F.when(same, shared_id().cast("string")).otherwise(F.col("line")))


def digits(number: Column) -> Column:
    """The digits of a number without zeros before them: equal numbers have equal digits, however long they are."""
    return F.regexp_replace(number, "^0+(?=[0-9])", "")


def _fences(ls: Column, after: Column) -> Column:
    """Spans (a, b) of fenced code behind line ``after``."""
    marks = F.transform(ls, lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, js.FENCE, 1).alias("run")))
    return _fence_spans(F.filter(marks, lambda m: (m["run"] != "") & (m["i"] > after)))


def _fence_spans(marks: Column) -> Column:
    """Spans (a, b) of fenced code by its candidate lines (i, run): a fence closes at the next one of its character that is at least as long."""
    spans = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(F.lit(-1).alias("at"), F.lit("").alias("run"), spans.alias("spans"))

    def step(s: Column, m: Column) -> Column:
        closes = (F.substring(m["run"], 1, 1) == F.substring(s["run"], 1, 1)) & (F.length(m["run"]) >= F.length(s["run"]))
        closed = F.struct(F.lit(-1).alias("at"), F.lit("").alias("run"), F.array_append(s["spans"], F.struct(s["at"].alias("a"), m["i"].alias("b"))).alias("spans"))
        return F.when(s["at"] < 0, F.struct(m["i"].alias("at"), m["run"].alias("run"), s["spans"].alias("spans"))).when(closes, closed).otherwise(s)

    rest = lambda s: F.when(s["at"] >= 0, F.array_append(s["spans"], F.struct(s["at"].alias("a"), F.lit(2147483647).alias("b")))).otherwise(s["spans"])
    return F.aggregate(marks, start, step, rest)


def _inside(spans: Column, n: Column) -> Column:
    """For each of ``n`` lines whether a span covers it: gaps and spans as runs of equal flags, one after the other."""
    last = lambda s: F.least(s["b"], n - 1)
    run = lambda s, i: F.concat(F.array_repeat(F.lit(False), s["a"] - F.coalesce(F.get(spans, i - 1)["b"], F.lit(-1)) - 1), F.array_repeat(F.lit(True), last(s) - s["a"] + 1))
    rest = n - 1 - F.coalesce(last(F.get(spans, F.size(spans) - 1)), F.lit(-1))
    return F.concat(F.flatten(F.transform(spans, run)), F.array_repeat(F.lit(False), rest))


def raw_kind(line: Column) -> Column:
    """What a line is by itself: the first rule that fits, where underlines are ``toggle`` or (also a break) ``rule``."""
    fits = lambda pattern: line.rlike(pattern)
    return (
        F.when(fits(js.ATX), "atxHeading").when(fits(js.BLANK), "blank").when(fits(js.QUOTE), "blockquote").when(fits(js.LIST_ITEM), "listItem").when(fits(js.TABLE_ROW), "tableRow")
        .when(fits(js.UNDERLINE), F.when(fits(js.THEMATIC), "rule").otherwise("toggle")).when(fits(js.THEMATIC), "thematicBreak").when(fits(js.INDENTED), "indentedCode").otherwise("paragraph")
    )


def raw_lines(notes: DataFrame, *more: str) -> DataFrame:
    """doc_id, line_no, line, sep (what follows the line in the text) and raw: front matter, fenced code, or what the line is by itself. The first line of a note
    brings its columns ``more`` along."""
    ls = F.col("ls")
    closing = F.array_position(F.slice(ls, 2, F.size(ls)), F.lit("---")).cast("int")
    front = F.when(F.get(ls, F.lit(0)) == "---", F.when(closing > 0, closing).otherwise(F.size(ls) - 1)).otherwise(-1)
    rows = _texts(notes, *more).withColumn("front", front)
    rows = rows.withColumn("fences", _fences(ls, F.col("front"))).withColumn("n", F.size(ls)).withColumn("fenced", _inside(F.col("fences"), F.col("n")))
    rows = rows.select("doc_id", *more, "front", "n", F.posexplode(F.arrays_zip(ls.alias("line"), F.col("fenced").alias("fenced"))).alias("line_no", "x")).select("doc_id", *more, "front", "n", "line_no", "x.line", "x.fenced")
    no = F.col("line_no")
    rows = rows.withColumns({c: F.when(no == 0, F.col(c)) for c in more})
    raw = F.when(no <= F.col("front"), "frontmatter").when(F.col("fenced"), "fencedCode").otherwise(raw_kind(F.col("line")))
    return rows.select("doc_id", *more, no.cast("long").alias("line_no"), "line", F.when(no < F.col("n") - 1, "\n").otherwise("").alias("sep"), raw.alias("raw"))


def classified(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, line_no, raw, ...) with kind and block_no; line numbers have no gaps. Notes that share a doc_id are an error.

    Whether an underline makes a heading depends on the line before being a paragraph, which underlines change in turn: that state is the last value set by
    another line, flipped once for every line since, as these are all underlines.
    """
    by = in_place(rows)
    columns = [c for c in rows.columns if c not in ("kind", "block_no")]
    set_by = F.when(F.col("raw") != "toggle", F.struct((F.col("raw") == "paragraph").cast("int").alias("value"), "line_no"))
    none = F.struct(F.lit(0).alias("value"), F.lit(-1).cast("long").alias("line_no"))
    now, past = (F.coalesce(F.last(set_by, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, end)), none) for end in (Window.currentRow, -1))
    same = F.coalesce(F.lag("line_no").over(by) == F.col("line_no"), F.lit(False))
    out = rows.select(*columns, now.alias("_now"), past.alias("_past"), same.alias("_same"), F.lead("raw").over(by).alias("_lead"))
    state = F.pmod(F.col("_now.value") + F.col("line_no") - F.col("_now.line_no"), F.lit(2)) == 1
    before = F.pmod(F.col("_past.value") + F.col("line_no") - 1 - F.col("_past.line_no"), F.lit(2)) == 1
    underlines = lambda c: F.col(c).isin("toggle", "rule")
    kind = F.when(underlines("raw") & before, "setextHeading").when(state & F.coalesce(underlines("_lead"), F.lit(False)), "setextHeading").when(F.col("raw") == "toggle", "paragraph").when(F.col("raw") == "rule", "thematicBreak").otherwise(F.col("raw"))
    out = out.select(*columns, F.when(F.col("_same"), shared_id().cast("string")).otherwise(kind).alias("kind"))
    new = (F.lag("kind").over(by).isNull() | (F.col("kind") == "blank") | (F.lag("kind").over(by) != F.col("kind"))).cast("int")
    return out.withColumn("_new", new).select(*columns, "kind", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("block_no"))


def reopened(rows: DataFrame) -> DataFrame:
    """``rows`` of notes whose lines a step has changed: where a first line has become the opening of front matter, the lines up to its closing one, or all, are
    front matter now, and the fences behind it are found anew."""
    opens = (F.col("line_no") == 0) & (F.col("line") == "---") & (F.col("raw") != "frontmatter")
    closes = (F.col("line_no") > 0) & (F.col("line") == "---")
    out = rows.withColumns({"_opened": F.max(opens).over(so_far()), "_closed": F.coalesce(F.max(closes).over(by_doc().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))})
    run = F.regexp_extract("line", js.FENCE, 1)
    mark = F.when(F.col("_opened") & F.col("_closed") & (run != ""), F.struct(F.col("line_no").cast("int").alias("i"), run.alias("run")))
    out = out.withColumn("_marks", F.collect_list(mark).over(by_doc().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # What was code below no longer is unless a fence is found again.
    fenced = F.exists(_fence_spans(F.col("_marks")), lambda s: (F.col("line_no") >= s["a"]) & (F.col("line_no") <= s["b"]))
    raw = F.when(~F.col("_opened"), F.col("raw")).when(~F.col("_closed"), "frontmatter").when(fenced, "fencedCode").when(F.col("raw") == "fencedCode", raw_kind(F.col("line"))).otherwise(F.col("raw"))
    return out.withColumn("raw", raw).select(*rows.columns)


def kinds(notes: DataFrame) -> DataFrame:
    """doc_id, line_no, line, sep (what follows the line in the text), kind, block_no."""
    return classified(raw_lines(notes)).select("doc_id", "line_no", "line", "sep", "kind", "block_no")


def with_off(rows: DataFrame) -> DataFrame:
    """``rows`` with off, the place of each line's first character in the text of ``line`` and ``sep``."""
    before = F.sum(F.length("line") + F.length("sep")).over(in_place(rows).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("off", F.coalesce(before, F.lit(0)).cast("int"))


def blocks(notes: DataFrame) -> DataFrame:
    """doc_id, block_no (from 1), kind, start_line, end_line, start_off, end_off (past the line feed, within the text)."""
    rows = kinds(notes).withColumn("end", F.sum(F.length("line") + F.length("sep")).over(so_far()))
    out = rows.groupBy("doc_id", "block_no", "kind").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.min(F.col("end") - F.length("line") - F.length("sep")).cast("long").alias("start_off"), F.max("end").cast("long").alias("end_off"))
    return out.select("doc_id", "block_no", "kind", "start_line", "end_line", "start_off", "end_off")


def rebuilt(rows: DataFrame, *pieces: str, key: str = "line_no", **more: Column) -> DataFrame:
    """Notes again from rows of (doc_id, ``key``) and the string columns ``pieces``, joined in order, with the aggregates ``more``. Notes whose doc_id another note
    has, too (null ids as well), would come out mixed: that is an error; ``sources.notes.numbered`` gives every note an id of its own."""
    each = F.array_sort(F.collect_list(F.struct(key, F.concat(*pieces).alias("piece"))))
    out = rows.groupBy("doc_id").agg(each.alias("each"), *[v.alias(n) for n, v in more.items()])
    twice = F.size(F.array_distinct(F.transform("each", lambda x: x[key]))) < F.size("each")
    text = F.array_join(F.transform("each", lambda x: x["piece"]), "")
    return out.select("doc_id", F.when(twice, shared_id().cast("string")).otherwise(text).alias("text"), *more)


def shared_id() -> Column:
    return F.raise_error(F.concat(F.lit("several notes with doc_id "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
