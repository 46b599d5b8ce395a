"""Pasted answers put into notes: marks become references, sources become definitions that share numbers with those the note has, the body goes under the note's
heading, and new definitions go to the note's section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import cleanup, edits, footnotes, pastes, surfaces, urls

#: By grammar: whether a text has it, its parser, the form of its marks, whether sources without a mark are left out, and whether definitions have two lines.
GRAMMARS = {
    "app": (surfaces.is_app, pastes.parse_app, pastes.APP_FORM, True, True),
    "web": (surfaces.is_web, pastes.parse_web, pastes.WEB_FORM, False, False),
    "web-download": (surfaces.is_download, pastes.parse_download, pastes.DOWNLOAD_FORM, True, False),
}


def paste_identity(parsed: DataFrame, notes: DataFrame, norm=urls.normalize_url) -> DataFrame:
    """The numbers in the note of the sources of ``parsed`` (doc_id, sources) against the definitions of ``notes`` (doc_id, text): doc_id, incoming_id, id, is_new
    and the source's snippet, title and url."""
    incoming = parsed.select("doc_id", F.explode("sources").alias("s")).select("doc_id", F.col("s.id").alias("id"), "s.snippet", "s.title", "s.url")
    found = pastes.resolve(incoming.select("doc_id", "id", "url"), footnotes.existing_refs(notes), norm)
    return found.join(incoming.withColumnRenamed("id", "incoming_id"), ["doc_id", "incoming_id"])


def convert(rows: DataFrame, grammar: str, norm=urls.normalize_url, name: str = "Resources", heading: str | None = None) -> DataFrame:
    """``rows`` (doc_id, text: the note, cursor, input: the pasted answer, and rep_from, rep_to if it is to take the place of a part of the note) of which the
    input has ``grammar``: doc_id, plan and the note after it as text."""
    fits, parse, form, only_cited, two_lines = GRAMMARS[grammar]
    rows = scratch.written(rows.where(fits(F.coalesce("input", F.lit("")))).withColumn("text", F.coalesce("text", F.lit(""))))
    parsed = parse(rows.select("doc_id", F.col("input").alias("text")))
    parsed = scratch.written(parsed.withColumn("sources", pastes.cited(F.col("sources"), F.col("inline"))) if only_cited else parsed)
    found = scratch.written(paste_identity(parsed, rows.select("doc_id", "text"), norm))
    ids = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("incoming_id", "id"))).alias("ids"), F.collect_set("incoming_id").alias("known"))
    line = footnotes.two_line(F.col("id"), F.col("snippet"), F.col("title"), F.col("url")) if two_lines else footnotes.compact(F.col("id"), F.col("title"), F.col("url"))
    defs = found.where("is_new").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda d: d["line"]).alias("defs"))
    if grammar == "app":  # a mark without a source stays as it is
        known = parsed.join(ids.select("doc_id", "known"), "doc_id", "left")
        parsed = known.withColumn("inline", F.filter("inline", lambda m: F.coalesce(F.array_contains("known", m["n"]), F.lit(False))))
    body = pastes.placed(parsed, form).withColumnRenamed("text", "body")
    whole = rows.join(body, "doc_id").join(ids.drop("known"), "doc_id", "left").join(defs, "doc_id", "left")
    whole = whole.withColumn("body", F.when(F.col("ids").isNull(), F.col("body")).otherwise(footnotes.renamed(F.col("body"), F.col("ids"))))
    whole = scratch.written(whole)
    place = (F.col("rep_from"), F.col("rep_to")) if "rep_from" in rows.columns else ()
    own = cleanup.cascade_or_insert(F.col("text"), F.col("cursor"), F.col("body"), *place)
    moved = footnotes.move_to_resources(whole.select("doc_id", "text", "defs"), name, heading).withColumnRenamed("plan", "moved")
    out = whole.join(moved, "doc_id").withColumn("plan", F.concat(own, "moved"))
    return out.select("doc_id", "plan", edits.apply_edits(F.col("text"), F.col("plan")).alias("text"))
