"""Citations, footnote references and definitions of notes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as js
from ..sources import scratch
from . import lines as L
from .edits import bound

ATX = rf"^(#{{1,6}})[ \t]+({js.DOT}+?)[ \t]*\z"
DEF = rf"^\[\^([^\]]+)\]: ({js.DOT}*)\z"
DEF_LINE = r"^\[\^[^\]]+\]:"
LINK_LINE = r"^\[([^\]]*)\]\(([^)]+)\)\z"
CITATION = r"(?<!\^)\[0*([0-9]+)\](?!\()"


def definitions(notes: DataFrame) -> DataFrame:
    """doc_id, line_no, id, alpha, snippet, title, url of every definition; a link alone on the next line belongs to it. Notes that share a doc_id are an error.

    Definitions are found in the notes' rows, so that of their lines only these are exchanged and made rows."""
    ls = F.col("ls")
    found = F.filter(F.transform(ls, lambda x, i: F.struct(i.cast("long").alias("line_no"), x.alias("line"), F.get(ls, i + 1).alias("next"))), lambda d: d["line"].rlike(DEF))
    rows = notes.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls")).select("doc_id", found.alias("found"))
    shared = F.count("*").over(Window.partitionBy("doc_id")) > 1
    rows = rows.withColumn("shared", shared).select("doc_id", F.inline(F.when(F.col("shared"), L.shared_id().cast("array<struct<line_no:bigint,line:string,next:string>>")).otherwise(F.col("found"))))
    rows = rows.withColumn("two", F.coalesce(F.col("next").rlike(LINK_LINE), F.lit(False)))
    part = lambda i: F.when(F.col("two"), F.regexp_extract("next", LINK_LINE, i))
    name = F.regexp_extract("line", DEF, 1)
    return rows.select("doc_id", "line_no", name.alias("id"), (~name.rlike(r"^[0-9]+\z")).alias("alpha"), F.regexp_extract("line", DEF, 2).alias("snippet"), part(1).alias("title"), part(2).alias("url"))


def references(notes: DataFrame) -> DataFrame:
    """doc_id, line_no, ord (in the line, from 1), id of inline references outside definition lines (references within a line)."""
    rows = L.lines(notes).where(~F.col("line").rlike(DEF_LINE))
    return rows.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(r"\[\^([^\]]+)\](?!:)"), F.lit(1))).alias("p", "id")).select("doc_id", "line_no", (F.col("p") + 1).cast("long").alias("ord"), "id")


def reference_spans(notes: DataFrame) -> DataFrame:
    """doc_id, line_no, off, end, id, alpha of inline references anywhere in the text, whose names may span lines; those that begin in a definition line don't count.

    The text is cut into references and what is between them; their places and those of the lines are swept in one order, in which the last line before a
    reference is the one that it begins in. Null text has none."""
    tokens = notes.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\[\^[^\]]+\](?!:)|[^\[]+|\["), F.lit(0))).alias("p", "t"))
    before = F.sum(F.length("t")).over(Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    refs = tokens.withColumn("off", F.coalesce(before, F.lit(0)).cast("long")).where((F.length("t") > 1) & F.col("t").startswith("[^"))
    name = F.substr("t", F.lit(3), F.length("t") - 3)
    refs = refs.select("doc_id", "off", (F.col("off") + F.length("t")).alias("end"), name.alias("id"), F.lit(None).cast("struct<line_no:bigint,def:boolean>").alias("line"))
    at = L.lines(notes).select("doc_id", "off", F.lit(None).cast("long").alias("end"), F.lit(None).cast("string").alias("id"), F.struct("line_no", F.col("line").rlike(DEF_LINE).alias("def")).alias("line"))
    sweep = Window.partitionBy("doc_id").orderBy("off", F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = refs.unionByName(at).withColumn("line", F.last("line", ignorenulls=True).over(sweep)).where("id is not null and not line.def")
    return both.select("doc_id", "line.line_no", "off", "end", "id", (~F.col("id").rlike(r"^[0-9]+\z")).alias("alpha"))


def citations(notes: DataFrame) -> DataFrame:
    """doc_id, line_no, ord, number (as printed) of bare citations outside definition lines."""
    rows = L.lines(notes).where(~F.col("line").rlike(DEF_LINE))
    return rows.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(r"(?<!\^)\[([0-9]+)\](?!\()"), F.lit(1))).alias("p", "number")).select("doc_id", "line_no", (F.col("p") + 1).cast("long").alias("ord"), "number")


def from_citations(text: Column) -> Column:
    """Bare citations outside definition lines become references; row-local."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(DEF_LINE), x).otherwise(F.regexp_replace(x, CITATION, "[^$1]"))), "\n")


def existing_refs(notes: DataFrame) -> DataFrame:
    """doc_id, line_no, id, url of numeric definitions; the url of a link that opens the next line, else empty. The id is null where it has over 64 bits."""
    rows = L.in_order(notes).withColumn("next", F.coalesce("next", F.lit("")))
    rows = rows.where(F.col("line").rlike(r"^\[\^[0-9]+\]:"))
    return rows.select("doc_id", "line_no", F.regexp_extract("line", r"^\[\^([0-9]+)\]:", 1).try_cast("long").alias("id"), F.regexp_extract("next", r"^\[[^\]]*\]\(([^)]+)\)", 1).alias("url"))


def atx(line: Column) -> Column:
    """The level and the text of a heading line (blanks or tabs behind its marks, and a text), null for others."""
    return F.when(line.rlike(ATX), F.struct(F.length(F.regexp_extract(line, ATX, 1)).cast("long").alias("level"), F.regexp_extract(line, ATX, 2).alias("text")))


def section_name(setting: str) -> str:
    """The name of the section for definitions that ``setting`` asks for, which may have heading marks before it."""
    return re.sub(r"^#{1,6}[ \t]*", "", setting.strip()).strip() or "Resources"


def section_heading(setting: str) -> str:
    """The heading of that section where a note has none yet: ``setting`` itself if it is a heading, else one of the second level."""
    found = re.match(r"(#{1,6})[ \t]+(.+?)[ \t]*$", setting.strip())
    return f"{found[1]} {found[2]}" if found else f"## {section_name(setting)}"


def with_section(rows: DataFrame, name: str = "Resources") -> DataFrame:
    """Lines (doc_id, line_no, off, line) of notes with start_line, section_level, start_off and end_off of the note's first section with the heading ``name``: up to
    the next heading of its level or above, or the end; null in notes without one. Running values over the notes' lines, no join."""
    note = Window.partitionBy("doc_id")
    rows = rows.withColumn("atx", atx(F.col("line")))
    first = F.col("line_no") == F.col("start_line")
    rows = rows.withColumn("start_line", F.min(F.when(F.col("atx.text") == name, F.col("line_no"))).over(note))
    rows = rows.withColumn("start_off", F.max(F.when(first, F.col("off"))).over(note)).withColumn("section_level", F.max(F.when(first, F.col("atx.level"))).over(note))
    ends = (F.col("line_no") > F.col("start_line")) & (F.col("atx.level") <= F.col("section_level"))
    end = F.coalesce(F.min(F.when(ends, F.col("off"))).over(note), F.max(F.col("off") + F.length("line")).over(note))
    return rows.withColumn("end_off", F.when(F.col("start_line").isNotNull(), end)).drop("atx")


def resources_section(notes: DataFrame, name: str = "Resources") -> DataFrame:
    """doc_id, level, start_off, end_off of the first section with the heading ``name`` of every note that has one."""
    return with_section(L.lines(notes), name).where(F.col("line_no") == F.col("start_line")).select("doc_id", F.col("section_level").alias("level"), "start_off", "end_off")


def note_footnotes(notes: DataFrame) -> DataFrame:
    """Everything about footnotes in notes, as rows (doc_id, what, line_no, ord, id, title, url): definitions, references, citations and the section."""
    # Read once for each of the four.
    notes = scratch.written(notes.select("doc_id", "text"))
    none, at = F.lit(None).cast("string"), F.lit(1).cast("long")
    out = definitions(notes).select("doc_id", F.lit("definition").alias("what"), "line_no", at.alias("ord"), "id", "title", "url")
    out = out.unionByName(references(notes).select("doc_id", F.lit("reference").alias("what"), "line_no", "ord", "id", none.alias("title"), none.alias("url")))
    out = out.unionByName(citations(notes).select("doc_id", F.lit("citation").alias("what"), "line_no", "ord", F.col("number").alias("id"), none.alias("title"), none.alias("url")))
    # Where the first section begins takes no other line of its note.
    section = L.lines(notes).where(atx(F.col("line"))["text"] == "Resources").groupBy("doc_id").agg(F.min("line_no").alias("line_no"))
    return out.unionByName(section.select("doc_id", F.lit("section").alias("what"), "line_no", at.alias("ord"), none.alias("id"), F.lit("Resources").alias("title"), none.alias("url")))


def count_definitions(plan: Column) -> Column:
    """How many different numbers the definitions have that a plan of edits inserts."""
    ids = F.flatten(F.transform(plan, lambda e: F.regexp_extract_all(e["insert"], F.lit(r"(?<![^\n\r\u2028\u2029])\[\^([0-9]+)\]:"), F.lit(1))))
    return F.size(F.array_distinct(ids)).cast("long")


def two_line(number: Column, snippet: Column, title: Column, url: Column) -> Column:
    return F.concat(F.lit("[^"), number.cast("string"), F.lit("]: "), snippet, F.lit("\n["), title, F.lit("]("), url, F.lit(")"))


def compact(number: Column, title: Column, url: Column) -> Column:
    return F.concat(F.lit("[^"), number.cast("string"), F.lit("]: ["), title, F.lit("]("), url, F.lit(")"))


def renamed(body: Column, ids: Column) -> Column:
    """``body`` with its numeric references named by the map ``ids`` (bigint to bigint); others stay."""
    number = lambda p: F.regexp_extract(p, r"\[\^([0-9]+)\]\z", 1)
    to = lambda p: F.try_element_at(ids, number(p).try_cast("bigint"))
    new = lambda p: F.concat(F.substr(p, F.lit(1), F.length(p) - F.length(number(p)) - 3), F.lit("[^"), to(p).cast("string"), F.lit("]"))
    return F.array_join(F.transform(F.split(body, r"(?<=\])", -1), lambda p: F.when((number(p) != "") & to(p).isNotNull(), new(p)).otherwise(p)), "")


def move_to_resources(rows: DataFrame, name: str = "Resources", heading: str | None = None) -> DataFrame:
    """``rows`` (doc_id, text, defs: array of definitions that are text already) as (doc_id, plan): the edit that puts the definitions at the end of the note's
    section ``name``, or into a new one at its end; empty without definitions."""
    text = F.coalesce("text", F.lit(""))
    section = resources_section(rows.select("doc_id", "text"), name)
    out = rows.select("doc_id", text.alias("text"), F.coalesce("defs", F.array().cast("array<string>")).alias("defs")).join(section, "doc_id", "left")
    body = F.when(F.exists("defs", lambda d: d.contains("\n")), F.array_join("defs", "\n\n")).otherwise(F.array_join("defs", "\n"))
    at = F.coalesce("end_off", F.length("text")).cast("int")
    insert = F.when(F.col("end_off").isNull(), F.concat(F.lit(f"\n{heading or '## ' + name}\n\n"), body)).otherwise(F.concat(F.lit("\n"), body, F.lit("\n")))
    plan = F.when(F.size("defs") > 0, F.array(F.struct(at.alias("from"), at.alias("to"), insert.alias("insert")))).otherwise(F.array())
    return out.select("doc_id", plan.cast("array<struct<from:int,to:int,insert:string>>").alias("plan"))


def id_map(notes: DataFrame, norm) -> DataFrame:
    """doc_id, old_id, new_id of numeric footnotes: in the order of their first references, then of definitions without one; ids whose first
    definitions have equal urls (by ``norm``) share a number. ``old`` has the digits of the old id, which is null where it has over 64 bits."""
    return _ids(notes, norm).drop("kept")


def _ids(notes: DataFrame, norm) -> DataFrame:
    """``id_map`` with kept, the line_no of the first definition of a new number."""
    numeric = lambda c: F.col(c).rlike(r"^[0-9]+\z")
    big = lambda c: L.digits(F.col(c))
    refs = references(notes).where(numeric("id")).select("doc_id", big("id").alias("old_id"), F.struct(F.lit(0).alias("k"), "line_no", "ord").alias("at"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("long").alias("d"))
    defs = definitions(notes).where(~F.col("alpha")).select("doc_id", big("id").alias("old_id"), F.struct(F.lit(1).alias("k"), "line_no", F.lit(0).cast("long").alias("ord")).alias("at"), norm(F.col("url")).alias("url"), F.col("line_no").alias("d"))
    ids = refs.unionByName(defs).groupBy("doc_id", "old_id").agg(F.min("at").alias("at"), F.min_by(F.struct("url"), "d").alias("u"), F.min("d").alias("d"))
    key = F.coalesce(F.concat(F.lit("u:"), F.col("u.url")), F.concat(F.lit("i:"), F.col("old_id")))
    same = Window.partitionBy("doc_id", key)
    ids = ids.withColumns({"first": F.min("at").over(same), "kept": F.min("d").over(same)})
    return ids.select("doc_id", F.col("old_id").alias("old"), F.col("old_id").try_cast("long").alias("old_id"), F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first")).cast("long").alias("new_id"), "kept")


def _parts(notes: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, off, line, sep) with what they are to numeric definitions: ``def`` (the number), ``title`` and ``url`` of the link line that
    belongs to it, and ``owner`` and ``owner_off``, the line_no and the off of the definition that a line is of, and ``owner_def``, its number."""
    rows = L.in_order(notes)
    name = F.regexp_extract("line", DEF, 1)
    number = F.when(F.col("line").rlike(DEF) & name.rlike(r"^[0-9]+\z"), L.digits(name))
    two = F.col("line").rlike(DEF) & F.coalesce(F.col("next").rlike(LINK_LINE), F.lit(False))
    part = lambda i: F.when(F.col("two"), F.regexp_extract("next", LINK_LINE, i))
    rows = rows.withColumn("sep", F.when(F.col("next").isNull(), "").otherwise("\n")).withColumn("def", number).withColumn("two", two).withColumn("title", part(1)).withColumn("url", part(2))
    own = F.struct(F.col("line_no").alias("owner"), F.col("off").alias("owner_off"), F.col("def").alias("owner_def"))
    before = F.lag(F.when(F.col("two") & F.col("def").isNotNull(), own)).over(L.by_doc())
    return rows.withColumn("_own", F.when(F.col("def").isNotNull(), own).otherwise(before)).select("*", "_own.*").drop("next", "_own")


def _renamed(line: Column, ids: Column) -> Column:
    """Numeric references of ``line`` named by the map ``ids``. A reference ends a piece that a closing bracket ends and begins at the piece's first mark."""

    def rename(p: Column, i: Column, pieces: Column) -> Column:
        at = F.locate("[^", p)
        name = F.substr(p, at + 2, F.length(p) - at - 2)
        is_ref = (at > 0) & p.endswith("]") & name.rlike(r"^[0-9]+\z") & ~F.coalesce(F.get(pieces, i + 1), F.lit("")).startswith(":")
        to = F.try_element_at(ids, L.digits(name))
        return F.when(is_ref & to.isNotNull(), F.concat(F.substr(p, F.lit(1), at + 1), to.cast("string"), F.lit("]"))).otherwise(p)

    # The line is cut up once, not again for what follows each of its pieces.
    each = lambda pieces: F.array_join(F.transform(pieces, lambda p, i: rename(p, i, pieces)), "")
    return F.when(line.contains("[^"), bound(F.split(line, r"(?<=\])", -1), each)).otherwise(line)


def identity(notes: DataFrame, norm) -> DataFrame:
    """Numeric footnotes of notes get the numbers of ``id_map``; of the definitions that share one the first stays."""
    ids = _ids(notes, norm).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("old", F.struct("new_id", "kept").alias("to")))).alias("to"))
    ids = ids.select("doc_id", F.transform_values("to", lambda k, v: v["new_id"]).alias("ids"), F.transform_values("to", lambda k, v: v["kept"]).alias("kept"))
    rows = _parts(notes).join(ids, "doc_id", "left").withColumn("new", F.try_element_at("ids", "def"))
    # A definition that isn't the first of its number goes with its link line.
    gone = F.try_element_at("kept", "owner_def") != F.col("owner")
    rows = rows.where(~F.coalesce(gone, F.lit(False)))
    line = F.when(F.col("new").isNotNull(), F.concat(F.lit("[^"), F.col("new").cast("string"), F.substr(F.col("line"), F.locate("]:", F.col("line")), F.length("line"))))
    line = line.when(F.col("line").rlike(DEF_LINE) | F.col("ids").isNull(), F.col("line")).otherwise(_renamed(F.col("line"), F.col("ids")))
    left = L.rebuilt(rows.withColumn("line", line), "line", "sep")
    # A note of which every line went is an empty note.
    return notes.select("doc_id").join(left, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def move(notes: DataFrame, name: str = "Resources", heading: str | None = None) -> DataFrame:
    """Numeric definitions outside the section ``name`` go to its end, or into a new one at the note's end; others stay."""
    rows = with_section(_parts(notes), name)
    outside = F.col("owner").isNotNull() & (F.col("start_off").isNull() | (F.col("owner_off") < F.col("start_off")) | (F.col("owner_off") >= F.col("end_off")))
    rows = rows.withColumn("moves", outside)
    text = F.concat(F.lit("[^"), F.regexp_extract("line", DEF, 1), F.lit("]: "), F.regexp_extract("line", DEF, 2), F.when(F.col("two"), F.concat(F.lit("\n["), "title", F.lit("]("), "url", F.lit(")"))).otherwise(""))
    size = F.max(F.col("line_no")) + 1
    each = F.transform(F.array_sort(F.collect_list(F.when(F.col("moves") & F.col("def").isNotNull(), F.struct("line_no", text.alias("t"))))), lambda x: x["t"])
    # Where the section ends: before the line at its end, or behind the last.
    at = F.coalesce(F.min(F.when((F.col("off") == F.col("end_off")) & F.col("line").rlike(ATX), F.col("line_no"))), size)
    kept = F.array_sort(F.collect_list(F.when(~F.col("moves"), F.struct("line_no", F.concat("line", "sep").alias("piece")))))
    notes = rows.groupBy("doc_id").agg(each.alias("defs"), at.alias("at"), F.max("start_off").alias("start"), kept.alias("kept"))
    apart = F.when(F.exists("defs", lambda d: d.contains("\n")), "\n\n").otherwise("\n")
    body = F.array_join(F.transform(F.slice("defs", F.lit(2), F.size("defs")), lambda d: F.concat(apart, d)), "")
    body = F.concat(F.get("defs", F.lit(0)), body)
    new = F.concat(F.lit(f"\n{heading or '## ' + name}\n\n"), body)
    put = F.when(F.size("defs") == 0, "").when(F.col("start").isNull(), new).otherwise(F.concat(F.lit("\n"), body, F.lit("\n")))
    above = F.array_join(F.transform(F.filter("kept", lambda x: x["line_no"] < F.col("at")), lambda x: x["piece"]), "")
    below = F.array_join(F.transform(F.filter("kept", lambda x: x["line_no"] >= F.col("at")), lambda x: x["piece"]), "")
    return notes.select("doc_id", F.concat(above, put, below).alias("text"))


def tidy(notes: DataFrame, norm, name: str = "Resources", citations_first: bool = True, number: bool = True, to_section: bool = True) -> DataFrame:
    """Bare citations become references, footnotes are numbered, definitions go to their section; each step can be left out.

    Numbering and moving read their notes several times, so each gets them as a written table instead of a plan that would be run as often."""
    out = notes.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if citations_first:
        out = out.select("doc_id", from_citations(F.col("text")).alias("text"))
    if number:
        out = identity(scratch.written(out), norm)
    return move(scratch.written(out), name) if to_section else out
