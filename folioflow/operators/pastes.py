"""What pasted answers say: prose, the marks in it and the sources they stand for.

Every parser gives doc_id, body, inline (array of marker and n, in order) and sources (array of id, snippet, title and url, in order). Null text is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as js
from . import edits
from . import lines as L
from .surfaces import DOWNLOAD_DEF, LINK, SOURCE, SOURCES_LINE

#: Marks of headings and citations, and what is noise in downloads: fixed values.
ANSWER, HEAD = "## Answer", "## "
PIECES = r"\[[0-9]+\]|[^\[]+|\["
DOWNLOAD_MARK = r"(\[\^[A-Za-z0-9_]+_[A-Za-z0-9_]+\])(?!:)"
NOISE = (r"(?i)<img[^>]*/?>", r"(?i)<span[^>]*>[\s\S]*?</span>", r"(?i)<div[^>]*>[\s\S]*?</div>", "⁂")

_INLINE = "array<struct<marker:string,n:bigint>>"
_SOURCES = "array<struct<id:bigint,snippet:string,title:string,url:string>>"


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^{js.WS}+|{js.WS}+\\z", "")


def _source(i: Column, title: Column, url: Column) -> Column:
    return F.struct(i.cast("long").alias("id"), title.alias("snippet"), title.alias("title"), url.alias("url"))


def parse_app(pastes: DataFrame) -> DataFrame:
    """Answers under headings, each with its own list of sources behind a line that opens it. Sources are counted through all answers by their place, marks
    move by the number of sources of earlier answers, and the lists leave the body. Text without an answer gives an empty body.

    Which answer a line is in and whether it is in a list are running values over one window by note. Numbers of over 18 digits are no marks."""
    rows = L.in_order(pastes).select("doc_id", "line_no", "line")
    answer, opens = F.col("line").startswith(ANSWER), F.col("line").rlike(SOURCES_LINE)
    rows = rows.withColumn("block", F.sum(answer.cast("int")).over(L.so_far()))
    event = F.when(answer, 0).when(opens, 1).when(F.col("line").startswith(HEAD), 0)
    rows = rows.withColumn("listed", (F.col("block") > 0) & (F.coalesce(F.last(event, ignorenulls=True).over(L.so_far()), F.lit(0)) == 1))
    rows = rows.withColumn("is_source", F.col("listed") & ~opens & F.col("line").rlike(SOURCE))
    rows = rows.withColumn("count", F.sum(F.col("is_source").cast("int")).over(L.so_far()))
    rows = rows.withColumn("offset", F.coalesce(F.last(F.when(answer, F.col("count")), ignorenulls=True).over(L.so_far()), F.lit(0)))
    pieces = F.when((F.col("block") > 0) & ~F.col("listed"), F.regexp_extract_all("line", F.lit(PIECES), F.lit(0)))
    is_mark = lambda p: p.rlike(r"^\[0*[0-9]{1,18}\]\z")
    number = lambda p: F.when(is_mark(p), F.substr(p, F.lit(2), F.length(p) - 2).try_cast("decimal(38,0)").cast("long")) + F.col("offset")
    moved = lambda p: F.when(is_mark(p) & (F.col("offset") > 0), F.concat(F.lit("["), number(p).cast("string"), F.lit("]"))).otherwise(p)
    marks = F.transform(F.filter("pieces", is_mark), lambda p: F.struct(F.concat(F.lit("["), number(p).cast("string"), F.lit("]")).alias("marker"), number(p).cast("long").alias("n")))
    line = F.concat(F.when(answer & (F.col("block") > 1), "\n").otherwise(""), F.when(F.col("pieces").isNull(), F.col("line")).otherwise(F.array_join(F.transform("pieces", moved), "")))
    rows = rows.withColumn("pieces", pieces).withColumn("said", F.when(~F.col("listed"), line)).withColumn("marks", marks)
    rows = rows.withColumn("source", F.when(F.col("is_source"), _source(F.col("count"), _trimmed(F.regexp_extract("line", SOURCE, 2)), F.regexp_extract("line", SOURCE, 3))))
    each = F.array_sort(F.collect_list(F.struct("line_no", "said", "marks", "source")))
    out = rows.groupBy("doc_id").agg(each.alias("ls"), F.max("block").alias("blocks"))
    some = F.col("blocks") > 0
    body = F.when(some, F.array_join(F.filter(F.transform("ls", lambda x: x["said"]), lambda x: x.isNotNull()), "\n")).otherwise("")
    inline = F.flatten(F.filter(F.transform("ls", lambda x: x["marks"]), lambda x: x.isNotNull()))
    sources = F.filter(F.transform("ls", lambda x: x["source"]), lambda x: x.isNotNull())
    return out.select("doc_id", body.alias("body"), inline.cast(_INLINE).alias("inline"), sources.cast(_SOURCES).alias("sources"))


def parse_web(pastes: DataFrame) -> DataFrame:
    """Every link of the text, images aside, is a source and a mark; the body is the text. Row-local."""
    text = F.coalesce("text", F.lit(""))
    part = lambda i: F.regexp_extract_all(text, F.lit(LINK), F.lit(i))
    found = pastes.select("doc_id", text.alias("body"), F.arrays_zip(part(0).alias("m"), part(1).alias("t"), part(2).alias("u")).alias("found"))
    inline = F.transform("found", lambda x, i: F.struct(x["m"].alias("marker"), (i + 1).cast("long").alias("n")))
    return found.select("doc_id", "body", inline.cast(_INLINE).alias("inline"), F.transform("found", lambda x, i: _source(i + 1, x["t"], x["u"])).cast(_SOURCES).alias("sources"))


def host(url: Column) -> Column:
    """The host and the port, if it isn't the scheme's own, of a URL; text that has no scheme is given back."""
    at = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#@]*)", 1))
    port = F.when(url.rlike("^(?i)http:"), F.regexp_replace(at, r":(80)?\z", "")).when(url.rlike("^(?i)https:"), F.regexp_replace(at, r":(443)?\z", "")).otherwise(at)
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), port).otherwise(url)


def parse_download(pastes: DataFrame) -> DataFrame:
    """Definition lines are the sources, in order, named by their hosts; the body is the text without tags and definitions; marks in it that a definition
    has are inline. A mark defined twice stands for the later source. Row-local."""
    text = F.coalesce("text", F.lit(""))
    is_def = lambda x: _trimmed(x).rlike(DOWNLOAD_DEF)
    clean = text
    for n in NOISE:
        clean = F.regexp_replace(clean, n, "")
    defs = F.transform(F.filter(F.split(text, "\n", -1), is_def), _trimmed)
    prose = F.array_join(F.filter(F.split(clean, "\n", -1), lambda x: ~is_def(x)), "\n")
    out = pastes.select("doc_id", defs.alias("defs"), prose.alias("prose"))
    url = lambda d: F.regexp_extract(d, DOWNLOAD_DEF, 3)
    known = F.transform("defs", lambda d, i: F.struct(F.regexp_extract(d, r"^(\[[^\]]*\])", 1).alias("marker"), (i + 1).cast("long").alias("id")))
    out = out.withColumn("known", known).withColumn("marks", F.regexp_extract_all("prose", F.lit(DOWNLOAD_MARK), F.lit(1)))
    inline = F.transform("marks", lambda m: F.struct(m.alias("marker"), F.array_max(F.transform(F.filter("known", lambda k: k["marker"] == m), lambda k: k["id"])).alias("n")))
    body = F.concat(F.regexp_replace(F.regexp_replace("prose", "\n{3,}", "\n\n"), f"{js.WS}+\\z", ""), F.lit("\n"))
    return out.select("doc_id", body.alias("body"), F.filter(inline, lambda x: x["n"].isNotNull()).cast(_INLINE).alias("inline"), F.transform("defs", lambda d, i: _source(i + 1, host(url(d)), url(d))).cast(_SOURCES).alias("sources"))


def cited(sources: Column, inline: Column) -> Column:
    """The sources that a mark stands for."""
    return F.filter(sources, lambda s: F.exists(inline, lambda m: m["n"] == s["id"]))


#: What a mark is at the place where its bracket opens, in the three grammars.
APP_FORM, WEB_FORM, DOWNLOAD_FORM = r"^(\[[0-9]+\])(?!\()", r"^(\[[^\[\]]*\]\([^\[)]*\))", r"^(\[\^[A-Za-z0-9_]+\])"


def placed(parsed: DataFrame, form: str) -> DataFrame:
    """Of ``parsed`` (doc_id, body, inline): doc_id and the body as text, in which the k-th place of a mark is a reference with the number of the mark's k-th
    entry in ``inline``; further places stay. Bodies are cut once before each opening bracket; places and entries meet by mark and k.

    Marks with a bracket inside would be cut; bodies with such a mark are searched for each mark instead."""
    odd = F.exists("inline", lambda m: F.locate("[", m["marker"], 2) > 0)
    rows = parsed.select("doc_id", "body", "inline", odd.alias("odd"))
    pieces = rows.where("not odd").select("doc_id", F.posexplode(F.split("body", r"(?=\[)", -1)).alias("at", "piece")).withColumn("marker", F.nullif(F.regexp_extract("piece", form, 1), F.lit("")))
    k = lambda order: F.row_number().over(Window.partitionBy("doc_id", "marker").orderBy(order))
    pieces = pieces.withColumn("k", F.when(F.col("marker").isNotNull(), k("at")))
    entries = rows.where("not odd").select("doc_id", F.posexplode("inline").alias("i", "m")).select("doc_id", "i", "m.marker", "m.n").withColumn("k", k("i")).drop("i")
    new = F.concat(F.lit("[^"), F.col("n").cast("string"), F.lit("]"), F.substr("piece", F.length("marker") + 1, F.length("piece")))
    both = pieces.join(entries, ["doc_id", "marker", "k"], "left").withColumn("piece", F.when(F.col("n").isNotNull(), new).otherwise(F.col("piece")))
    return L.rebuilt(both, "piece", key="at").unionByName(rows.where("odd").select("doc_id", replace_markers(F.col("body"), F.col("inline")).alias("text")))


def replace_markers(body: Column, inline: Column) -> Column:
    """The body with its marks as references: the k-th place of a mark's text gets the number of its k-th entry. Every mark searches the body; ``placed`` does not."""
    kth = F.transform(inline, lambda m, i: F.struct(m["marker"].alias("marker"), m["n"].alias("n"), F.size(F.filter(F.slice(inline, F.lit(1), i + 1), lambda x: x["marker"] == m["marker"])).alias("k")))
    placed = F.transform(kth, lambda m: F.struct(F.length(F.call_function("substring_index", body, m["marker"], m["k"])).alias("from"), m["marker"].alias("marker"), m["n"].alias("n")))
    plan = F.transform(F.filter(placed, lambda p: p["from"] < F.length(body)), lambda p: F.struct(p["from"].alias("from"), (p["from"] + F.length(p["marker"])).alias("to"), F.concat(F.lit("[^"), p["n"].cast("string"), F.lit("]")).alias("insert")))
    return edits.apply_edits(body, plan)


def resolve(incoming: DataFrame, existing: DataFrame, norm) -> DataFrame:
    """doc_id, incoming_id, id, is_new: the number in the note of every source of ``incoming`` (doc_id, id, url). Sources of one url (by ``norm``) share a number;
    it is that of the last definition of ``existing`` (doc_id, line_no, id, url) with the url, or the next one behind the largest, in the order of incoming ids.
    A repeated incoming id counts once, by the least of its urls."""
    key = lambda c: F.coalesce(norm(F.col(c)), F.lit(""))
    have = existing.withColumn("key", key("url")).groupBy("doc_id", "key").agg(F.max_by("id", "line_no").alias("have"))
    top = existing.groupBy("doc_id").agg(F.greatest(F.max("id"), F.lit(0)).alias("top"))
    rows = incoming.groupBy("doc_id", F.col("id").alias("incoming_id")).agg(F.min("url").alias("url")).withColumn("key", key("url"))
    rows = rows.join(have, ["doc_id", "key"], "left").join(top, "doc_id", "left")
    rows = rows.withColumn("first", F.min("incoming_id").over(Window.partitionBy("doc_id", "key"))).withColumn("is_new", F.col("have").isNull())
    place = F.dense_rank().over(Window.partitionBy("doc_id", "is_new").orderBy("first"))
    return rows.select("doc_id", "incoming_id", F.coalesce("have", F.coalesce("top", F.lit(0)) + place).cast("long").alias("id"), (F.col("is_new") & (F.col("first") == F.col("incoming_id"))).alias("is_new"))
