"""What the footnote operators do once a note, and what they still refuse."""

import pytest

from folioflow.operators import footnotes, urls

TEXT = "a [^2] b [^9]\n[^9]: nine\n[n](http://x.y/)\n## Resources\n[^2]: two\n[t](HTTP://x.y:80)\n# End\n[^5]: five"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_made_once(spark):
    notes = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    # Kept lines and moved definitions come of one table of lines.
    assert _plan(footnotes.move(notes)).count("Generate posexplode") == 1
    # Numbering sorts the lines once; which definition of a number stays is found with the numbers.
    lines = [x for x in _plan(footnotes.identity(notes, urls.normalize_url)).split("\n") if "Sort [doc_id" in x and "line_no" in x]
    assert len(lines) == 1, lines
    # Only definitions are exchanged, not all lines.
    assert "Generate posexplode" not in _plan(footnotes.definitions(notes))


def test_tidied_by_hand(spark):
    notes = spark.createDataFrame([(1, TEXT), (2, ""), (3, None), (4, "[^1]: only")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in footnotes.tidy(notes, urls.normalize_url).collect()}
    assert got[1] == "a [^1] b [^1]\n## Resources\n\n[^1]: nine\n[n](http://x.y/)\n\n[^2]: five\n# End\n"
    assert got[2] == got[3] == "" and got[4] == "\n## Resources\n\n[^1]: only"


def test_notes_of_one_id_are_an_error(spark):
    for rows in ([(1, "a"), (1, "b")], [(None, "a"), (None, "b")]):
        same = spark.createDataFrame(rows, "doc_id long, text string")
        for run in (footnotes.definitions, footnotes.note_footnotes, footnotes.move):
            with pytest.raises(Exception, match="several notes with doc_id"):
                run(same).collect()
