"""The fused clean-up against its steps one by one, and its plans against their texts."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from folioflow.operators import cleanup, edits, footnotes, pastes, reflow, tables
from folioflow.operators import lines as L
from folioflow.plans import format
from folioflow.sources import scratch

LINES = [
    "---", "--- ", "———", "–––", "-", "--", "- ", "* ", "1. ", "**", "*", "_", "=", "===", "—", "— x", "a-", "b-", "c-", "foo-", "bar", "bar  baz ", "", "", " ", "```", "~~~", "````js", "``",
    "# H", "### J", "#", "###### K", "#\t", "* a", "+ b", "• c", "3. x", "  7) y", "01. z", "    code", "\tx", "> q", "| t", "ﬁne “x”", "`co—de` —", "`open", "open` —", "+--+", "| a |", "│ b │", "┌─┐", "x  ", "·  d",
]
SINGLE = {
    "box_table": tables.box_table, "reflow": reflow.reflow, "dehyphenate": cleanup.dehyphenate, "dewrap": cleanup.dewrap, "tidy_whitespace": cleanup.tidy_whitespace,
    "decompose_ligatures": cleanup.decompose_ligatures, "normalize_bullets": cleanup.normalize_bullets, "normalize_ordered": cleanup.normalize_ordered, "normalize_headings": cleanup.normalize_headings,
}


@pytest.fixture(scope="module")
def notes(spark):
    rng = random.Random(11)
    texts = [None, "", "\n", "\n\n\n\n", "--- \nk: v\n--- \n```\n", "———\n```\nx\n———\n```\n— a\n```\n* b"]
    texts += ["\n".join(rng.choices(LINES, k=rng.randint(1, 30))) for _ in range(250)]
    texts += [rng.choice(["--- ", "———", "— —", "--—"]) + "\n" + "\n".join(rng.choices(LINES[:30], k=rng.randint(1, 14))) for _ in range(80)]
    texts += ["\n".join(rng.choices(["a-", "b-", "foo-", "bar", "`", "x`-", "c` d-"], k=rng.randint(2, 9))) for _ in range(80)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()


@pytest.mark.parametrize("off", [(), ("dewrap", "tidy_whitespace"), tuple(format.ROW_STEPS)])
def test_steps_one_by_one(notes, off):
    recipe = replace(format.Recipe(), reflow=not off, **{s: False for s in off})
    done = format.clean_steps(notes, recipe).cache()
    want = notes.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    have = want
    for s in (s for s in format.STEPS if getattr(recipe, s)):
        want = scratch.written(SINGLE[s](want))
        have = have.join(done.select("doc_id", f"plan_{s}", f"n_{s}"), "doc_id")
        have = have.select("doc_id", edits.apply_edits(F.col("text"), F.col(f"plan_{s}")).alias("text"), (F.size(f"plan_{s}") == F.col(f"n_{s}")).alias("ok"))
        have = scratch.written(have)
        both = have.join(want.withColumnRenamed("text", "want"), "doc_id")
        assert both.count() == notes.count() and not both.where("not ok or text <> want").head(3), s
        have = have.select("doc_id", "text")
    assert not done.select("doc_id", F.col("text").alias("t")).join(want, "doc_id").where("t <> text").head(3)


def test_counts_by_hand(spark):
    text = "# H\n### J\ndis-\ntance is ﬁne.  \nnext  x\n\n\n\n* a\n+ b\n2. c\n5. d\n+---+\n| a |\n+---+\ntail"
    row = format.clean_steps(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.text == "# H\n## J\ndistance is fine. next x\n\n- a\n- b\n1. c\n2. d\n\n| a |\n| --- |\n\ntail"
    assert [row[f"n_{s}"] for s in format.STEPS if s != "reflow"] == [1, 1, 1, 2, 1, 2, 2, 1]
    assert [tuple(e) for e in row.plan_tidy_whitespace] == [(10, 36, "distance is ﬁne. next x"), (38, 40, "")] and [tuple(e) for e in row.plan_normalize_ordered] == [(44, 45, "1"), (49, 50, "2")]


def test_one_exchange_by_note(spark, notes):
    text = format.apply_cleanup(notes, replace(format.Recipe(), box_table=False))
    plan = text._jdf.queryExecution().executedPlan().toString()
    # One for all notes, one for those whose first line may open front matter.
    assert plan.count("Exchange hashpartitioning") == 2, plan


def test_notes_of_one_id_are_an_error(spark):
    same = spark.createDataFrame([(1, "# a\n### b"), (1, "# c\n### d")], "doc_id long, text string")
    none = spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string")
    for run in (format.apply_cleanup, cleanup.normalize_headings, L.blocks, footnotes.definitions, pastes.parse_app):
        for n in (same, none):
            with pytest.raises(Exception, match="several notes with doc_id"):
                run(n).collect()
    assert format.clean_steps(same.limit(0)).count() == 0


def test_five_sorts_of_the_lines(notes):
    """The steps that look at blocks, merge lines, look at lines, at blocks again and at items by indentation; nothing else sorts lines."""
    text = format._row_steps(notes, list(format.ROW_STEPS), False).select("doc_id", "text")
    assert text._jdf.queryExecution().executedPlan().toString().count("Sort [") == 5


def test_texts_are_looked_through_once(notes):
    """Whether a note has a frame or may open front matter is a column of the written table, not a pattern that each of its four readers matches again."""
    plan = format.apply_cleanup(notes)._jdf.queryExecution().optimizedPlan().toString()
    assert tables._TOP not in plan


def test_six_sorts_with_plans(notes):
    """Places of edits are found in the order that the lines have: only those behind the numbered items sort them once more."""
    done = format._row_steps(notes, list(format.ROW_STEPS), False).select("doc_id", "text", *[f"plan_{s}" for s in format.ROW_STEPS])
    assert done._jdf.queryExecution().executedPlan().toString().count("Sort [") == 6


def test_squeezed_lines_to_the_end(spark):
    texts = ["a\n\n\n\n", "\n\n\n\n\nb\n \n\t\n\nc", "\n\n\n", "x\n\n\ny", "", "*  a\n+ b  c\n\n\n\n 7. é\n"]
    done = format.clean_steps(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    plans = [[tuple(e) for e in r.plan_tidy_whitespace] for r in done]
    assert plans == [[(3, 5, "")], [(1, 5, ""), (9, 12, "")], [(1, 3, "")], [], [], [(0, 4, "* a"), (5, 11, "+ b c"), (13, 15, "")]], plans
    assert [tuple(e) for e in done[5].plan_normalize_bullets] == [(0, 1, "-"), (4, 5, "-")] and [tuple(e) for e in done[5].plan_normalize_ordered] == [(12, 13, "1")]
