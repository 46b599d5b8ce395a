"""The operations by name, scripts that users add, and which of them takes a pasted text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cleanup, convert, edits, footnotes, reflow, surfaces, tables, urls

API_VERSION = "1.0"


def _texts(op: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda notes: op(notes.select("doc_id", "text"))


#: Operations on notes (doc_id, text) by name; each alone, whatever a recipe says. ``headings.cascade`` also takes cursor and input; ``util.normalizeUrl`` is a function of
#: a column.
OPERATIONS: dict[str, Callable] = {
    "headings.cascade": lambda notes: notes.select("doc_id", edits.apply_edits(F.col("text"), cleanup.cascade(F.col("text"), F.col("cursor"), F.col("input"))).alias("text")),
    "headings.normalize": _texts(cleanup.normalize_headings),
    "footnotes.fromCitations": lambda notes: notes.select("doc_id", footnotes.from_citations(F.coalesce("text", F.lit(""))).alias("text")),
    "footnotes.identity": _texts(lambda notes: footnotes.identity(notes, urls.normalize_url)),
    "footnotes.move": _texts(footnotes.move),
    "util.normalizeUrl": urls.normalize_url,
    "cleanup.boxTable": _texts(tables.box_table),
    "cleanup.reflow": _texts(reflow.reflow),
    "cleanup.dewrap": _texts(cleanup.dewrap),
    "cleanup.dehyphenate": _texts(cleanup.dehyphenate),
    "cleanup.decomposeLigatures": _texts(cleanup.decompose_ligatures),
    "cleanup.tidyWhitespace": _texts(cleanup.tidy_whitespace),
    "lists.normalizeBullets": _texts(cleanup.normalize_bullets),
    "lists.normalizeOrdered": _texts(cleanup.normalize_ordered),
}


@dataclass(frozen=True)
class Script:
    """``run`` takes rows (doc_id, text, cursor, input) and gives (doc_id, plan, text) of those it has a result for; ``can_handle`` says of an input column whether the
    script takes a pasted text."""

    id: str
    run: Callable[[DataFrame], DataFrame]
    can_handle: Callable[[Column], Column] | None = None
    priority: int = 0
    provenance: str = "imported"


SCRIPTS: dict[str, Script] = {}


def register_script(id: str, run: Callable, can_handle: Callable | None = None, priority: int = 0, provenance: str = "imported", requires: str = API_VERSION) -> Script:
    """Add a script, or put it in the place of the one with its id. Raises where it is no script: ``run`` must be a function, ``can_handle`` one or nothing, the priority
    a number, and the required version ``major.minor`` of this major version and not above it."""
    if not id or not callable(run) or not (can_handle is None or callable(can_handle)) or isinstance(priority, bool) or not isinstance(priority, (int, float)):
        raise ValueError(f"not a script: {id!r}")
    own, other = API_VERSION.split("."), requires.split(".") if re.fullmatch("[0-9]+[.][0-9]+", requires) else ("", "0")
    if other[0] != own[0] or int(other[1]) > int(own[1]):
        raise ValueError(f"script {id!r} asks for version {requires!r}")
    SCRIPTS[id] = Script(id, run, can_handle, priority, provenance)
    return SCRIPTS[id]


for _name, _priority in (("app", 300), ("web-download", 200), ("web", 100)):
    register_script(_name, lambda rows, g=_name: convert.convert(rows, g), {"app": surfaces.is_app, "web": surfaces.is_web, "web-download": surfaces.is_download}[_name], _priority, "curated")


def paste_chain(scripts: dict[str, Script] | None = None) -> list[Script]:
    """The scripts that take pasted texts: curated ones first, then by falling priority, then by id."""
    some = [s for s in (SCRIPTS if scripts is None else scripts).values() if s.can_handle]
    return sorted(some, key=lambda s: (s.provenance != "curated", -s.priority, s.id))


def paste_and_run(rows: DataFrame, scripts: dict[str, Script] | None = None) -> DataFrame:
    """``rows`` (doc_id, text, cursor, input): the first script of the chain that takes a row's input runs on it; where none does, or it has no result, the input is put
    in at the cursor. Gives doc_id, handler (``raw`` for the latter), plan and text."""
    chain = paste_chain(scripts)
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("input", F.coalesce("input", F.lit("")))
    first = F.coalesce(*[F.when(s.can_handle(F.col("input")), F.lit(s.id)) for s in chain], F.lit("raw"))
    rows = rows.select("doc_id", "text", "cursor", "input", first.alias("handler"))
    done = [s.run(rows.where(F.col("handler") == s.id).select("doc_id", "text", "cursor", "input")).select("doc_id", F.lit(s.id).alias("handler"), "plan", "text") for s in chain]
    plan = F.array(F.struct(F.col("cursor").cast("int").alias("from"), F.col("cursor").cast("int").alias("to"), F.col("input").alias("insert")))
    out = None
    for d in done:
        out = d if out is None else out.unionByName(d)
    rest = rows if out is None else rows.join(out.select("doc_id"), "doc_id", "left_anti")
    raw = rest.select("doc_id", F.lit("raw").alias("handler"), plan.alias("plan"), edits.apply_edits(F.col("text"), plan).alias("text"))
    return raw if out is None else out.unionByName(raw)
