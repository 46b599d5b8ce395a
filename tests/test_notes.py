"""Note operators: written cases, and closed forms against sequential definitions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioflow.operators import cleanup, edits, footnotes, lines, pastes, registry, tables, urls
from folioflow.sources import notes as notes_source


def run(spark, op, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in op(df).orderBy("doc_id").collect()]


def kinds(spark, text):
    rows = lines.kinds(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line_no").collect()
    return [r.kind for r in rows]


def test_block_kinds(spark):
    assert kinds(spark, "---\na: b\n---\n# T\n\ntext\n===\n* * *\n***\n> q\n| a |\n    code\n") == ["frontmatter"] * 3 + ["atxHeading", "blank", "setextHeading", "setextHeading", "listItem", "thematicBreak", "blockquote", "tableRow", "indentedCode", "blank"]
    assert kinds(spark, "```js\nx\n~~~\n```` end\ny") == ["fencedCode"] * 4 + ["paragraph"]
    assert kinds(spark, "> ```\nx") == ["blockquote", "paragraph"]
    assert kinds(spark, "===\n===") == ["setextHeading", "setextHeading"]
    assert kinds(spark, "a\nb\n---\n---") == ["paragraph", "setextHeading", "setextHeading", "thematicBreak"]


def test_clean_up_cases(spark):
    assert run(spark, cleanup.dehyphenate, "dis-\ntance", "`a-\nb` c-\nd", "a-\nb-\nc", None) == ["distance", "`a-\nb` cd", "ab-\nc", ""]
    assert run(spark, cleanup.dewrap, "one\ntwo\n\n* a\n* b\nend\n", "x\ny\n") == ["one two\n\n* a\n* b\nend\n", "x y\n"]
    assert run(spark, cleanup.decompose_ligatures, "ﬁne — `ﬁ` “q”", "```\nﬁ\n```") == ['fine - `ﬁ` "q"', "```\nﬁ\n```"]
    assert run(spark, cleanup.tidy_whitespace, "a  b  \n  c   d\t\n\n\n\ne", "a\n\n\n\n", "|  x  |", "a\n\n\nb") == ["a b\n  c d\n\ne", "a\n\n", "|  x  |", "a\n\n\nb"]
    assert run(spark, cleanup.normalize_bullets, "* a\n+ b\n  • c\n- d\n* * *") == ["- a\n- b\n  - c\n- d\n- * *"]
    assert run(spark, cleanup.normalize_ordered, "3. a\n3. b\n  7) c\n  7) d\n9. e\n\n5. f\ntext\n4. g\n01. h") == ["1. a\n2. b\n  1) c\n  2) d\n3. e\n\n4. f\ntext\n1. g\n2. h"]


def test_heading_levels(spark):
    assert run(spark, cleanup.normalize_headings, "# A\n### B\n#### C\n## D\n###### E", "### x\n# y\n### z") == ["# A\n## B\n### C\n## D\n### E", "### x\n# y\n## z"]
    rng = random.Random(1)
    levels = [[rng.randint(1, 6) for _ in range(rng.randint(1, 12))] for _ in range(200)]
    got = run(spark, cleanup.normalize_headings, *("\n".join("#" * x + " h" for x in n) for n in levels))
    for n, text in zip(levels, got):
        want = []
        for x in n:
            want.append(min(x, want[-1] + 1) if want else x)
        assert [len(x.split()[0]) for x in text.split("\n")] == want


def test_ordered_items_match_a_stack(spark):
    rng = random.Random(2)
    notes = ["\n".join(rng.choice(["", "  ", "    "]) + rng.choice(["3. x", "- y", "", "7) z"]) if rng.random() < 0.9 else "text" for _ in range(14)) for _ in range(60)]
    for text, got in zip(notes, run(spark, cleanup.normalize_ordered, *notes)):
        stack, want = [], []
        for line, kind in zip(text.split("\n"), kinds_by_rule(text)):
            m = re.match(r"(\s*)(\d+)([.)])", line) if kind == "listItem" else None
            if kind not in ("blank", "listItem"):
                stack = []
            if m:
                indent = len(m[1])
                while stack and stack[-1][0] > indent:
                    stack.pop()
                if not stack or stack[-1][0] < indent:
                    stack.append([indent, 0])
                stack[-1][1] += 1
                line = m[1] + str(stack[-1][1]) + line[m.end(2) :]
            want.append(line)
        assert got == "\n".join(want)


def kinds_by_rule(text):
    return ["blank" if not x.strip() else "listItem" if re.match(r"\s*([-*+]|\d+[.)]) ", x) else "indentedCode" if x.startswith("    ") else "paragraph" for x in text.split("\n")]


def test_footnotes(spark):
    text = "see [1] and [^2] and [007], [3](u)\n[^2]: two\n[t](http://a.b/)\n[^x]: alpha [4]\n## Resources\nend"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert df.select(footnotes.from_citations(F.col("text"))).first()[0].split("\n")[0] == "see [^1] and [^2] and [^7], [3](u)"
    assert [(r.id, r.alpha, r.title, r.url) for r in footnotes.definitions(df).orderBy("line_no").collect()] == [("2", False, "t", "http://a.b/"), ("x", True, None, None)]
    assert [r.number for r in footnotes.citations(df).orderBy("ord").collect()] == ["1", "007"]
    assert footnotes.resources_section(df).first().asDict() == {"doc_id": 1, "level": 2, "start_off": text.index("## R"), "end_off": len(text)}


@pytest.mark.parametrize("raw, want", [("HTTPS://User@EX.com:443/a/?b=2&a=1&a=0#f", "https://ex.com/a?a=1&a=0&b=2"), ("http://x.com/", "http://x.com"), (" Mailto:A@B ", "mailto:a@b"), ("http://x.com:8080/P?b&a=", "http://x.com:8080/P?a=&b="),
    ("https:\\\\a.b\\x/../y/./%2E%2e/z/..", "https://a.b"), ("http://a.b/x y/é\"?q=a b+c%20d/é&p=%zz~*", "http://a.b/x%20y/%C3%A9%22?p=%25zz%7E*&q=a+b+c+d%2F%C3%A9"), ("http://a.b:080/./", "http://a.b"), ("http://a.b:99999/X", "http://a.b:99999/x"),
    ("http:// A/", "http:// a/"), ("http://[::1]:443/", "http://[::1]:443"), ("https://Bücher.example:443/ü", "https://xn--bcher-kva.example/%C3%BC"), ("http://0x7f.1/a", "http://127.0.0.1/a"), ("http://1.2.3.256/A", "http://1.2.3.256/a"), ("ht\ttp://a.b/\n..", "http://a.b"), ("http://", "http://")])
def test_urls(spark, raw, want):
    assert spark.range(1).select(urls.normalize_url(F.lit(raw))).first()[0] == want


HOSTS = {
    "münchen.de": "xn--mnchen-3ya.de", "MÜNCHEN.de.": "xn--mnchen-3ya.de.", "0x7f.1": "127.0.0.1", "127.1": "127.0.0.1", "0300.0250.1": "192.168.0.1", "4294967295": "255.255.255.255", "0x": "0.0.0.0", "1.2.3.4.": "1.2.3.4",
    "256.1.1.1": None, "1.2.3.4.5": None, "4294967296": None, "08.1": None, "a.0x1g": "a.0x1g", "a.1": None, "9" * 40: None, "ex%41mple.com": "example.com", "a%zz": None, "a%20b": None, "": None, "a b": None,
    "ｅｘ。com": "ex.com", "b\u00adc.d": "bc.d", "[0:0:0:0:0:0:0:1]": "[::1]", "[1:0:0:2:0:0:0:3]": "[1:0:0:2::3]", "[1::0:0:1]": "[1::1]", "[::ffff:1.2.3.4]": "[::ffff:102:304]", "[::]": "[::]", "[1:2:3:4:5:6:7::]": "[1:2:3:4:5:6:7:0]",
    "[1:2:3]": None, "[1::2::3]": None, "[::1.2.3]": None, "[00AB::]": "[ab::]", "[0:10:0:0:1:2:3:4]": "[0:10::1:2:3:4]", "[1:2:3:4:5:6:7:8:9]": None, "☃.net": "xn--n3h.net", "ΣΊΣΥΦΟΣ.gr": "xn--" + "σίσυφοσ".encode("punycode").decode() + ".gr",
}


def test_host_names(spark):
    got = spark.createDataFrame(list(HOSTS.items()), "host string, want string").withColumn("got", urls.host_name(F.col("host"))).collect()
    assert {r.host: r.got for r in got} == HOSTS


def test_punycode_and_addresses_by_random(spark):
    import ipaddress

    rng = random.Random(11)
    alphabet = "ab-9zäßéσ漢字한글кириллица😀𐍈\u0301"
    labels = ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(400)] + ["ü" * 60, "a" * 58 + "ü", "😀a" * 25]
    got = spark.createDataFrame([(x,) for x in labels], "x string").withColumn("p", urls.punycode(F.col("x"))).collect()
    assert [r.p for r in got] == [r.x.encode("punycode").decode() for r in got]
    six = [ipaddress.IPv6Address(sum((rng.getrandbits(16) if rng.random() < 0.4 else 0) << 16 * k for k in range(8))) for _ in range(300)]
    got = spark.createDataFrame([(f"[{a.exploded}]", f"[{a.compressed}]") for a in six], "x string, want string").withColumn("p", urls.host_name(F.col("x"))).collect()
    # Python leaves out single zeros of mapped addresses as dots only from its version 3.13 on.
    assert [r.p for r in got if "." not in r.want] == [r.want for r in got if "." not in r.want]


def test_edits_round_trip(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("ab\n", k=rng.randint(0, 9))), "".join(rng.choices("ab\n", k=rng.randint(0, 9)))) for _ in range(300)]
    df = edits.diff_plan(spark.createDataFrame(pairs, "a string, b string"), "a", "b")
    for r in df.select("a", "b", "plan", edits.apply_edits(F.col("a"), F.col("plan")).alias("out")).collect():
        assert r.out == r.b and (len(r.plan) == (r.a != r.b))


def test_places_in_units(spark):
    """Against slices of UTF-16."""
    rng = random.Random(8)
    rows = []
    for i in range(200):
        text = "".join(rng.choices("aé漢😀𐍈\n", k=rng.randint(0, 12)))
        n = len(text.encode("utf-16-le")) // 2
        rows.append((i, text, *sorted((rng.randint(0, n), rng.randint(0, n)))))
    df = spark.createDataFrame([*rows, (None, None, 1, 2), (900, "a😀", None, 1)], "doc_id long, text string, anchor long, head long")
    for r in notes_source.selection(df, units=True).where("doc_id < 900").collect():
        raw, point = rows[r.doc_id][1].encode("utf-16-le"), lambda u, t=rows[r.doc_id][1]: next(k for k in range(len(t), -1, -1) if len(t[:k].encode("utf-16-le")) // 2 <= u)  # noqa: B023
        assert r.input == rows[r.doc_id][1][point(r.sel_from) : point(r.sel_to)]
        whole = raw[2 * r.sel_from : 2 * r.sel_to].decode("utf-16-le", "surrogatepass")
        assert r.input == whole or any("\ud800" <= c <= "\udfff" for c in whole)
    plan = F.array(F.struct(F.lit(1).alias("from"), F.lit(2).alias("to"), F.lit("😀").alias("insert")))
    one = spark.createDataFrame([("😀😀b",)], "text string").select(edits.plan_in_units(F.col("text"), plan).alias("u")).select("u", notes_source.cursor_after(F.col("u"), True).alias("c")).first()
    assert one.u[0].asDict() == {"from": 2, "to": 4, "insert": "😀"} and one.c == 4


def test_version_gate(spark):
    cases = [("1.0", "1.0", True), ("1.2", "1.3", False), ("2.0", "1.0", False), ("1", "1.0", False), (None, "1.0", False)]
    rows = spark.createDataFrame(cases, "a string, r string, want boolean").select(registry.version_allows(F.col("a"), F.col("r")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)


def test_queries_match_sql(spark):
    """Every note query against its SQL on the smallest tables."""
    import os

    import duckdb

    from folioflow.plans import queries

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    db = duckdb.connect()
    for t in os.listdir(d):
        db.execute(f"create view {t.split('.')[0]} as from '{d}/{t}'")
    key = lambda x: tuple((v is None, str(v)) for v in x)
    for name in ("st2_blocks", "cl5_reflow", "cp2_app_parse", "cp4_download_parse", "cl4_tidy_whitespace", "cl6_box_table", "li2_normalize_ordered", "he2_cascade", "he3_cascade_or_insert", "fn2_id_map", "fn4_tidy", "fn5_resolve", "sc1_app", "sc2_web", "sc3_web_download", "di2_dispatch", "rg2_materialize", "rg4_resolved_states"):
        df = queries.QUERIES[name](spark, d)
        found = db.execute(queries.ORACLES[name])
        at = [[c[0] for c in found.description].index(c) for c in df.columns]
        want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=key)
        assert sorted(map(tuple, df.collect()), key=key) == want, name


def test_drawn_tables(spark):
    box = "cap\n┌───┬───┐\n│ a │ b|c │\n├───┼───┤\n│ x │ y │\n│ z │   │\n└───┴───┘\nend"
    ragged = "+--+--+\n| a | b |\n+--+--+\n| c |\n+--+--+"
    ascii_ = "    +---+\n    | h |\n    +===+\n    | v |\n    +---+\n"
    want = ["cap\n\n| a | b\\|c |\n| --- | --- |\n| x z | y |\n\nend", ragged, "| h |\n| --- |\n| v |\n", "```\n" + ascii_ + "```", "| a | b |\n|---|---|", ""]
    assert run(spark, tables.box_table, box, ragged, ascii_, "```\n" + ascii_ + "```", "| a | b |\n|---|---|", None) == want


def test_footnotes_are_numbered_and_moved(spark):
    number = lambda df: footnotes.identity(df, urls.normalize_url)
    note = "b[^5] a[^2][^9]: x[^y]\n[^2]: two\n[t](https://ex.com/a)\n[^5]: five\n[^7]: dup\n[u](https://EX.com/a/)\n[^5]: again"
    assert run(spark, number, note, "[^1] [^1]: x", "no", None, "[^3]: only") == ["b[^1] a[^2][^9]: x[^y]\n[^2]: two\n[t](https://ex.com/a)\n[^1]: five\n", "[^1] [^1]: x", "no", "", "[^1]: only"]
    notes = ["a\n[^1]: one\nb\n## Resources\n[^2]: in\n# Next\n[^3]: three\n[t](u)\nz", "x\n[^1]: one\n[^q]: alpha", "none", None]
    assert run(spark, footnotes.move, *notes) == ["a\nb\n## Resources\n[^2]: in\n\n[^1]: one\n\n[^3]: three\n[t](u)\n# Next\nz", "x\n[^q]: alpha\n## Resources\n\n[^1]: one", "none", ""]
    tidy = lambda df: footnotes.tidy(df, urls.normalize_url)
    assert run(spark, tidy, "p [4]\n[^4]: four\n") == ["p [^1]\n\n## Resources\n\n[^1]: four"]


def test_notes_from_files(spark, tmp_path):
    from folioflow.sources import notes

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("one\ntwo\n")
    (tmp_path / "y.txt").write_text("no")
    assert [(r.doc_id[-6:], r.text) for r in notes.folder(spark, str(tmp_path)).collect()] == [("a/x.md", "one\ntwo\n")]
    df = spark.createDataFrame([(1, "hello", 4, 1), (2, "hello", None, 1)], "doc_id long, text string, anchor int, head int")
    assert [(r.sel_from, r.sel_to, r.cursor, r.input) for r in notes.selection(df).orderBy("doc_id").collect()][0] == (1, 4, 1, "ell")
    assert notes.selection(df).where("doc_id = 2").first().input is None


def test_reflow(spark):
    from folioflow.operators.reflow import reflow

    wide = "This line is as wide as the others are in this note,"
    cases = {
        f"{wide}\nand it goes on here until its end comes at last.\nA new paragraph begins behind the end of a sentence.": f"{wide} and it goes on here until its end comes at last.\n\nA new paragraph begins behind the end of a sentence.",
        f"Title\n{wide}\nmore": f"Title\n\n{wide} more",
        "Intro text\n• one\ntwo\n‣ three on-\nfour\n1) five": "Intro text\n\n- one two\n- three on-four\n1) five",
        f"{wide[:-1]} com-\nplex\n\n```\na\nb\n```\nx": f"{wide[:-1]} com-plex\n\n```\na\nb\n```\nx",
        "single\n": "single\n",
        "* a\n* b\n": "- a\n- b\n",
        "": "",
    }
    assert run(spark, reflow, *cases) == list(cases.values())
    assert run(spark, reflow, None) == [""]


def test_pasted_answers(spark):
    from folioflow.operators import pastes

    df = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    app = "## Question\nq\n## Answer\nfact [1][2]\nSources\n[1] First https://a.org/x\nlost\n[9] Second  http://b.org \n## Question\nmore\n## Answer\nyes [01] no [x]\nQuellen\n[1] Third https://c.org"
    r = pastes.parse_app(df(app, "no answer [1]", None)).orderBy("doc_id").collect()
    assert r[0].body == "## Question\nq\n## Answer\nfact [1][2]\n## Question\nmore\n\n## Answer\nyes [3] no [x]"
    assert [(m.marker, m.n) for m in r[0].inline] == [("[1]", 1), ("[2]", 2), ("[3]", 3)]
    assert [(s.id, s.title, s.url) for s in r[0].sources] == [(1, "First", "https://a.org/x"), (2, "Second", "http://b.org"), (3, "Third", "https://c.org")]
    assert [(x.body, x.inline, x.sources) for x in r[1:]] == [("", [], [])] * 2
    web = pastes.parse_web(df("see [a](http://x) and ![i](p.png) [a](http://x)[b](u)"))
    r = web.select("body", "inline", "sources", pastes.replace_markers(F.col("body"), F.col("inline")).alias("marked")).first()
    assert r.marked == "see [^1] and ![i](p.png) [^2][^3]" and [s.url for s in r.sources] == ["http://x", "http://x", "u"]
    down = '<img src="l.png"/>\n# T\n\n\n\nfact[^1_1][^1_2][^7_7]<span style="display:none">[^1_3]</span>\n<div align="center">⁂</div>\n\n[^1_1]: https://WWW.a.org:443/p\n[^1_2]: plain\n'
    r = pastes.parse_download(df(down)).select("*", pastes.cited(F.col("sources"), F.col("inline")).alias("cited")).first()
    assert r.body == "\n# T\n\nfact[^1_1][^1_2][^7_7]\n" and [(m.marker, m.n) for m in r.inline] == [("[^1_1]", 1), ("[^1_2]", 2)]
    assert [(s.id, s.title, s.url) for s in r.sources] == [(1, "www.a.org", "https://WWW.a.org:443/p"), (2, "plain", "plain")] and len(r.cited) == 2
    incoming = spark.createDataFrame([(1, 1, "http://a/"), (1, 2, "http://new"), (1, 3, "http://A"), (1, 4, "http://new/"), (1, 5, "http://z"), (2, 1, "u")], "doc_id long, id long, url string")
    existing = spark.createDataFrame([(1, 0, 4, "http://a"), (1, 1, 7, "http://a"), (1, 2, 2, "")], "doc_id long, line_no long, id long, url string")
    got = pastes.resolve(incoming, existing, urls.normalize_url).orderBy("doc_id", "incoming_id").collect()
    assert [(x.incoming_id, x.id, x.is_new) for x in got] == [(1, 7, False), (2, 8, True), (3, 7, False), (4, 8, False), (5, 9, True), (1, 1, True)]


def test_code_tokens(spark):
    from folioflow.operators.code_tokens import quote_code

    cases = {
        "in tides/moon.c:7-12 and near:: [[Harbour]], x.y: [] or [[Dune 3]] as sea.shell_4 too": "in `tides/moon.c:7-12` and `near:: [[Harbour]]`, `x.y: []` or `[[Dune 3]]` as `sea.shell_4` too",
        "`foo.bar` [foo.bar](u.v) ```\nfoo.bar\n``` call.it(x) end.": "`foo.bar` [foo.bar](u.v) ```\nfoo.bar\n``` call.it(x) end.",
        "": "",
        None: None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert [r[0] for r in df.orderBy("doc_id").select(quote_code(F.col("text"))).collect()] == list(cases.values())


def test_long_notes(spark):
    import time

    note = "\n".join("  " * (i % 3) + f"{i}. item" if i % 7 else "```" for i in range(10_000))
    df = spark.createDataFrame([(1, "\n".join(f"{i}. item" for i in range(1, 10_001)).replace("5. item", "5) item")), (2, note)], "doc_id long, text string")
    run(spark, cleanup.normalize_ordered, "1. warm")
    began = time.time()
    rows = {r.doc_id: r.text for r in cleanup.normalize_ordered(df).collect()}
    assert time.time() - began < 10 and rows[1].split("\n")[-1] == "10000. item" and len(rows[2].split("\n")) == 10_000


def test_notes_with_one_id_are_refused(spark):
    from folioflow.sources import notes

    twice = spark.createDataFrame([(1, "a\nb", "x"), (1, "c\nd", "y"), (None, "e", "z")], "doc_id long, text string, more string")
    with pytest.raises(Exception, match="several notes with doc_id 1"):
        cleanup.dewrap(twice).collect()
    own = notes.numbered(twice)
    assert sorted(r.text for r in cleanup.dewrap(own.select(F.col("note_id").alias("doc_id"), "text")).collect()) == ["a b", "c d", "e"]


def test_marks_become_references(spark):
    from folioflow.operators import pastes

    inline = lambda *m: [(k, n) for k, n in m]
    rows = [(1, "![a](u) [a](u) [a](u)[b](v", inline(("[a](u)", 1), ("[a](u)", 2))), (2, "x [a[b](u) [a[b](u)", inline(("[a[b](u)", 5))), (3, "", []), (4, "[2] [2](u) [02] [2][3]", inline(("[2]", 2), ("[2]", 2), ("[9]", 9)))]
    df = spark.createDataFrame(rows, "doc_id long, body string, inline array<struct<marker:string,n:long>>")
    got = {r.doc_id: r.text for r in pastes.placed(df.where("doc_id < 4"), pastes.WEB_FORM).collect()}
    assert got == {1: "![^1] [^2] [a](u)[b](v", 2: "x [^5] [a[b](u)", 3: ""}
    assert pastes.placed(df.where("doc_id = 4"), pastes.APP_FORM).first().text == "[^2] [2](u) [02] [^2][3]"
    assert spark.range(1).select(footnotes.renamed(F.lit("a[^1] [^x [^3] [^2]: [^12]"), F.create_map(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"), F.lit(3).cast("bigint"), F.lit(1).cast("bigint")))).first()[0] == "a[^4] [^x [^1] [^2]: [^12]"


def test_answers_in_notes(spark):
    from folioflow.plans import operations
    from folioflow.sources import notes

    note = "# Trip\nOld [^2].\n[^2]: Ferry\n[ferry](https://sea.example/f?b=1&a=2)\n"
    answer = "## Answer\n### Boats\nTake it [1][2], or walk [3].\nSources\n[1] Ferry again https://SEA.example/f/?a=2&b=1\n[2] Isles https://isles.example/\n"
    rows = spark.createDataFrame([(1, note, 17, answer), (2, "", 0, "see [map](http://m.example)"), (3, "ab", 1, "plain"), (4, None, 0, None)], "doc_id long, text string, cursor int, input string")
    got = {r.doc_id: r for r in operations.paste_and_run(rows).withColumn("at", notes.cursor_after(F.col("plan"))).collect()}
    assert got[1].handler == "app" and got[1].text == "# Trip\nOld [^2].\n## Answer\n### Boats\nTake it [^2][^3], or walk [3].[^2]: Ferry\n[ferry](https://sea.example/f?b=1&a=2)\n\n## Resources\n\n[^3]: Isles\n[Isles](https://isles.example/)"
    assert got[2].text == "see [^1]\n## Resources\n\n[^1]: [map](http://m.example)" and (got[3].handler, got[3].text, got[3].at) == ("raw", "aplainb", 6) and got[4].text == ""
    assert [s.id for s in operations.paste_chain()] == ["app", "web-download", "web"]
    own = {"z": operations.Script("z", lambda r: r.select("doc_id", F.array().cast("array<struct<from:int,to:int,insert:string>>").alias("plan"), F.upper("input").alias("text")), lambda c: c == "plain", 5)}
    assert {r.doc_id: r.handler for r in operations.paste_and_run(rows, own).collect()} == {1: "raw", 2: "raw", 3: "z", 4: "raw"}
    for bad in ({"run": None}, {"run": len, "priority": "1"}, {"run": len, "requires": "2.0"}, {"run": len, "requires": "x"}):
        with pytest.raises(ValueError):
            operations.register_script("bad", **bad)
    assert len(operations.OPERATIONS) == 14
    df = rows.where("doc_id = 3").select("doc_id", F.lit("# a\nx").alias("text"), F.lit(5).alias("cursor"), F.lit("# b").alias("input"))
    assert operations.OPERATIONS["headings.cascade"](df).first().text == "# a\nx## b"


def test_sections_and_formats(spark):
    from folioflow.plans import format

    assert [footnotes.section_name(x) for x in ("## Quellen ", "", " # ", "Links")] == ["Quellen", "Resources", "Resources", "Links"]
    assert [footnotes.section_heading(x) for x in ("###\t Quellen  ", "Links", "##")] == ["### Quellen", "## Links", "## Resources"]
    paste = lambda df: format.paste_and_format(df)
    assert run(spark, paste, "---\n* a  b\n---", None) == ["---\n- a b\n---", ""]
    rows = spark.createDataFrame([(1, "# A\n# B [1]\n[^1]: one", 3, 4, 12, "# B [1]\n"), (2, "x", None, None, None, None)], "doc_id long, text string, cursor int, sel_from int, sel_to int, input string")
    got = {r.doc_id: r for r in format.format_selection(rows).collect()}
    assert got[1].text == "# A\n## B [^1]\n\n## Resources\n\n[^1]: one" and len(got[1].plan) == 1 and got[2].plan == []
    off = format.Recipe(cascade=False, from_citations=False, identity=False, move=False)
    assert {r.doc_id: r.text for r in format.format_selection(rows, off).collect()}[1] == "# A\n# B [1]\n[^1]: one"


def test_catalog_and_records(spark, tmp_path):
    import hashlib

    from folioflow.sources import catalog

    body = b"// description: Waves\nrun()"
    mark = "sha256:" + hashlib.sha256(body).hexdigest()
    (tmp_path / "index.json").write_text('{"schemaVersion": 1, "ref": "theirs", "scripts": {"waves": {"id": "waves", "version": 2, "checksum": "%s", "path": "waves.cjs", "name": "Waves", "description": "d"}, "dunes": {"id": "dunes", "version": 1}}}' % mark)
    (tmp_path / "waves.cjs").write_bytes(body)
    (tmp_path / "store.json").write_text('{"scripts": {"waves": {"enabled": true, "okayed": {"version": 1, "checksum": "%s"}}, "half": {"okayed": {"version": 1}, "enabled": true}, "own": {"provenance": "imported"}}}' % mark)
    (tmp_path / "versions.json").write_text('{"waves": 1, "odd": "x"}')
    (tmp_path / "broken.json").write_text("[")
    d = str(tmp_path)
    entries, files = catalog.index(spark, d, "pinned"), catalog.files(spark, d)
    assert {(r.id, r.version, r.ref) for r in entries.collect()} == {("waves", 2, "pinned"), ("dunes", 1, "pinned")} and bytes(files.first().content) == body
    stored = registry.with_defaults(catalog.records(spark, f"{d}/store.json"))
    assert {(r.id, r.provenance, r.enabled, r.okayed_version, r.source, r.command) for r in stored.collect()} == {("waves", "curated", True, 1, "", False), ("half", "curated", True, None, "", False), ("own", "imported", False, None, "", False)}
    versions = catalog.versions(spark, f"{d}/versions.json")
    state = lambda c: {r.id: r.state for r in registry.resolved(stored, c, files.select("id", "content"), versions).collect()}
    assert state(entries) == {"waves": "UpdateAvailable", "half": "Available", "own": "Disabled", "dunes": "Available"}
    assert state(None) == {"waves": "Active", "half": "Available", "own": "Disabled"}
    assert catalog.versions(spark, f"{d}/broken.json").count() == 0


def test_long_numbers_end_no_job(spark):
    """Numbers beyond 64 bits and beyond 38 digits are numbers like others."""
    for n in (20, 45):
        big = "9" * n
        note = spark.createDataFrame([(1, f"see [^{big}] and [^7]\n[^7]: a\n[^0{big}]: z\n[t](https://e.x/)")], "doc_id long, text string")
        assert [(r.id, r.url) for r in footnotes.existing_refs(note).orderBy("line_no").collect()] == [(7, ""), (None, "https://e.x/")]
        assert footnotes.identity(note, urls.normalize_url).first().text == "see [^1] and [^2]\n[^2]: a\n[^1]: z\n[t](https://e.x/)"
        assert {(r.old, r.old_id, r.new_id) for r in footnotes.id_map(note, urls.normalize_url).collect()} == {(big, None, 1), ("7", 7, 2)}
        assert footnotes.move(note).count() == 1
        paste = spark.createDataFrame([(1, f"## Answer\nfirst\nSources\n[1] a http://x.y\n## Answer\nx [{big}] y [1]")], "doc_id long, text string")
        row = pastes.parse_app(paste).first()
        assert row.body == f"## Answer\nfirst\n\n## Answer\nx [{big}] y [2]" and [tuple(m) for m in row.inline] == [("[2]", 2)]
        pairs = spark.createDataFrame([("1.0", f"1.{big}"), (f"1.{big}", "1.5"), (f"0{big}.2", f"{big}.01"), ("1.10", "1.9"), ("1.9", "1.10")], "a string, r string")
        assert [r[0] for r in pairs.select(registry.version_allows(F.col("a"), F.col("r"))).collect()] == [False, True, True, True, False]


def test_references_over_lines(spark):
    texts = [None, "a [^1] b [^x\ny] [^2]:\n[^3]: d [^4]\n[^p\n[^5] q", "[^a\n[^b]: x [^6", "[^] [^\n] [[^7]]"]
    rng = random.Random(4)
    texts += ["".join(rng.choices(["[^", "]", ":", "\n", "1", "a", "[", " "], k=rng.randint(1, 25))) for _ in range(300)]
    want = set()
    for i, t in enumerate(texts):
        t = t or ""
        for m in re.finditer(r"\[\^([^\]]+)\](?!:)", t):
            line_no = t.count("\n", 0, m.start())
            if not re.match(r"\[\^[^\]]+\]:", t.split("\n")[line_no]):
                want.add((i, line_no, m.start(), m.end(), m[1], re.fullmatch("[0-9]+", m[1]) is None))
    got = footnotes.reference_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)
