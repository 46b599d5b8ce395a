"""The clean-up pipeline: a fixed order of steps, each of which can be left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cleanup, edits, footnotes, reflow, tables, urls
from ..operators import lines as L
from ..sources import scratch

#: The steps of the clean-up, in their order: first those that make other lines of a note, then those that go over one table of lines.
NOTE_STEPS = ("box_table", "reflow")
ROW_STEPS = {
    "dehyphenate": cleanup.dehyphenate_rows, "dewrap": cleanup.dewrap_rows, "tidy_whitespace": cleanup.whitespace_rows, "decompose_ligatures": cleanup.ligature_rows,
    "normalize_bullets": cleanup.bullet_rows, "normalize_ordered": cleanup.ordered_rows, "normalize_headings": cleanup.heading_rows,
}
STEPS = (*NOTE_STEPS, *ROW_STEPS)
_PLAN = "array<struct<from:int,to:int,insert:string>>"


@dataclass(frozen=True)
class Recipe:
    box_table: bool = True
    reflow: bool = False
    dehyphenate: bool = True
    dewrap: bool = True
    tidy_whitespace: bool = True
    decompose_ligatures: bool = True
    normalize_bullets: bool = True
    normalize_ordered: bool = True
    normalize_headings: bool = True
    cascade: bool = True
    from_citations: bool = True
    identity: bool = True
    move: bool = True


def _each(edit: str) -> Column:
    """The edits of a note in the order of their places."""
    found = F.array_sort(F.collect_list(F.when(F.col(edit).isNotNull(), F.struct(F.col(f"{edit}.from").alias("from"), F.col(edit).alias("e")))))
    return F.transform(found, lambda x: x["e"]).cast(_PLAN)


def _joined(plan: str) -> Column:
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.col(plan).alias("p")))), lambda x: x["p"])).cast(_PLAN)


def _opens(text: Column) -> Column:
    """Whether front matter may come about: only a first line of three hyphens or dashes with blanks behind them can become its opening."""
    return text.rlike(r"^(?!---(\n|\z))[-–—]{3}[ \t]*(\n|\z)")


def _boxed(notes: DataFrame) -> DataFrame:
    """Notes (doc_id, text, framed, opens) after their drawn tables, with opens, n_box_table and plan_box_table; only notes with a frame are cut into lines for it."""
    done = L.rebuilt(tables.box_rows(notes.where("framed").select("doc_id", "text")), "piece", n_box_table=F.count_if("did"), plan_box_table=_each("edit"))
    rest = notes.where("not framed").select("doc_id", "text", "opens", F.lit(0).cast("long").alias("n_box_table"), F.array().cast(_PLAN).alias("plan_box_table"))
    return done.withColumn("opens", _opens(F.col("text"))).unionByName(rest)


def _reflowed(notes: DataFrame, carried: list[str]) -> DataFrame:
    """Notes after re-flowing with n_reflow, plan_reflow and the columns ``carried``."""
    rows = reflow.reflow_rows(notes)
    runs = reflow.run_edits(rows).groupBy("doc_id").agg(F.count("*").alias("n_reflow"), _each("edit").alias("plan_reflow"))
    out = L.rebuilt(rows, "flowed").join(runs, "doc_id", "left")
    out = out.withColumn("n_reflow", F.coalesce("n_reflow", F.lit(0))).withColumn("plan_reflow", F.coalesce("plan_reflow", F.array().cast(_PLAN)))
    return out.join(notes.select("doc_id", *carried), "doc_id") if carried else out


def clean_steps(notes: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """Notes (doc_id, text) after the steps of the clean-up that ``recipe`` turns on, in their order, with n_<step> and plan_<step> of each of them: how many edits it
    makes, and the edits (from, to, insert) of the text that the step before it left. Columns that aren't asked for cost nothing.

    One table of lines goes through all steps from ``dehyphenate`` on: it is exchanged once by doc_id, each step changes its rows in place, only lines that a step
    has changed are classified again, and the lines are put together once."""
    on = [s for s in STEPS if getattr(recipe, s)]
    # Read four times (with frames or not, a first line that may open front matter or not), so that texts that are computed are computed and looked through once.
    notes = notes.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    framed = tables.framed(F.col("text")) if "box_table" in on else F.lit(False)
    notes = scratch.written(notes.withColumns({"framed": framed, "opens": _opens(F.col("text"))}))
    notes = _boxed(notes) if "box_table" in on else notes.drop("framed")
    if "reflow" in on:
        notes = _reflowed(scratch.written(notes.drop("opens")), [c for c in notes.columns if c.endswith("_box_table")])
        notes = notes.withColumn("opens", _opens(F.col("text")))
    steps = [s for s in on if s in ROW_STEPS]
    if not steps:
        return notes.drop("opens")
    if not {"tidy_whitespace", "decompose_ligatures"} & set(steps):
        return _row_steps(notes.drop("opens"), steps, False).select("doc_id", "text", *[c for s in on for c in (f"n_{s}", f"plan_{s}")])
    done = _row_steps(notes.where("not opens").drop("opens"), steps, False).unionByName(_row_steps(notes.where("opens").drop("opens"), steps, True))
    return done.select("doc_id", "text", *[c for s in on for c in (f"n_{s}", f"plan_{s}")])


def _row_steps(notes: DataFrame, steps: list[str], opening: bool) -> DataFrame:
    """Notes after ``steps`` over one table of their lines; ``opening`` says whether front matter may come about."""
    carried = [c for c in notes.columns if c not in ("doc_id", "text")]
    rows = L.classified(L.raw_lines(notes, *carried))
    sums: dict[str, Column] = {}
    placed = False
    for name in steps:
        if name == "normalize_ordered" and "normalize_headings" in steps:
            # Numbers leave headings alone, whose levels are found before items are sorted by their indentations.
            rows = cleanup.heading_levels(rows)
        # Lines that were just put together have their places, and bullets are as long as the hyphens that they become.
        if not placed:
            rows = L.with_off(rows)
        rows = ROW_STEPS[name](rows)
        placed = name in ("dehyphenate", "dewrap", "normalize_bullets")
        if name == "dehyphenate":
            rows = rows.withColumnsRenamed({"did": "n_dehyphenate", "edit": "plan_dehyphenate"})
            if "dewrap" in steps:
                # Both break lines up in paragraphs only, so their lines are put together at once.
                continue
        if name in ("dehyphenate", "dewrap"):
            more = {c: F.min_by(c, "line_no") for c in carried}
            if "dehyphenate" in steps:
                more |= {"n_dehyphenate": F.count_if("n_dehyphenate"), "plan_dehyphenate": _each("plan_dehyphenate")}
                sums |= {"n_dehyphenate": F.sum("n_dehyphenate"), "plan_dehyphenate": _joined("plan_dehyphenate")}
            rows = cleanup.merged(rows, **more)
        if name == "dehyphenate":
            rows = rows.drop("did", "edit")
        else:
            rows = rows.withColumnsRenamed({"did": f"did_{name}", "edit": f"edit_{name}"})
            sums |= {f"n_{name}": F.count_if(f"did_{name}"), f"plan_{name}": _each(f"edit_{name}")}
        if opening and name in ("tidy_whitespace", "decompose_ligatures"):
            rows = L.reopened(rows)
        if name == "decompose_ligatures":
            # Its rows are sorted by block, which what follows needs not change.
            rows = rows.drop("_block", "_order").withColumnRenamed("block_no", "_block")
        if name in ("dehyphenate", "dewrap", "tidy_whitespace", "decompose_ligatures"):
            rows = L.classified(rows)
    return L.rebuilt(rows, "line", "sep", **sums, **{c: F.min_by(c, "line_no") for c in carried})


def apply_cleanup(notes: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """Notes after the steps of the clean-up that ``recipe`` turns on, in their order; each step sees the text the one before it left."""
    return clean_steps(notes, recipe).select("doc_id", "text")


def _tidied(notes: DataFrame, recipe: Recipe, section: str) -> DataFrame:
    return footnotes.tidy(notes, urls.normalize_url, section, recipe.from_citations, recipe.identity, recipe.move)


def format_notes(notes: DataFrame, recipe: Recipe = Recipe(), section: str = "Resources") -> DataFrame:
    """Whole notes after the clean-up and the tidying of their footnotes."""
    return _tidied(apply_cleanup(notes, recipe), recipe, section)


def format_selection(notes: DataFrame, recipe: Recipe = Recipe(), section: str = "Resources") -> DataFrame:
    """``notes`` (doc_id, text, cursor, sel_from, sel_to, input) cleaned up, with the selected text cascaded under its heading and footnotes tidied: doc_id, plan (none
    or one edit of the original) and text. The selection keeps its original offsets and text; notes without one have null ends."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = scratch.written(notes.select("doc_id", text("text").alias("original"), "cursor", "sel_from", "sel_to", "input"))
    clean = rows.join(apply_cleanup(rows.select("doc_id", F.col("original").alias("text")), recipe), "doc_id")
    if recipe.cascade:
        moved = F.when(F.col("sel_from").isNotNull() & F.col("sel_to").isNotNull(), cleanup.cascaded(F.col("text"), F.col("cursor"), text("input")))
        put = F.concat(F.substr("text", F.lit(1), F.col("sel_from").cast("int")), moved, F.substr("text", F.col("sel_to").cast("int") + 1, F.length("text")))
        clean = clean.withColumn("text", F.coalesce(put, "text"))
    done = _tidied(clean.select("doc_id", "text"), recipe, section)
    both = edits.diff_plan(rows.select("doc_id", "original").join(done, "doc_id"), "original", "text")
    return both.select("doc_id", "plan", "text")


def paste_and_format(pastes: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """Pasted texts (doc_id, text) after the clean-up. A line feed before them keeps a first line of three hyphens from opening front matter, and goes again."""
    out = apply_cleanup(pastes.select("doc_id", F.concat(F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text")), recipe)
    return out.select("doc_id", F.regexp_replace("text", "^\n", "").alias("text"))
