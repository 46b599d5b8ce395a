"""The registered queries on notes, and for each the same result by DuckDB SQL written from the definition."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleanup, edits, footnotes, lines, reflow, registry, surfaces, tables, urls
from ..sources import notes as notes_source
from ..sources import scratch
from . import builders, format

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _built(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    name = re.findall("FROM ([a-z]+)", sql)[-1]
    return spark.sql(sql.replace(f"FROM {name}", "FROM {" + name + "}"), **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet")})


def _query(name: str, fixture: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = lambda spark, sf_dir: run(_built(spark, sf_dir, fixture))
        if sql:
            ORACLES[name] = sql
        return run

    return add


_W = r"[ \t\n\f\r\x0b]"
_N, _FN = builders.NOTES, builders.FOOTNOTES


def _lines_sql(notes: str, x: str = "") -> str:
    return f"""n{x} AS ({notes}),
 p{x} AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM n{x}),
 l{x} AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls)))::BIGINT AS i, len(ls) AS n FROM p{x})"""


def _kinds_sql(notes: str, x: str = "") -> str:
    """Lines read one by one, with the open front matter or fence and the kind of the line before as state; names end in ``x``."""
    return f"""n{x} AS ({notes}),
 p{x} AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM n{x}),
 l{x} AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls)))::BIGINT AS i, len(ls) AS n FROM p{x}),
 c{x} AS (SELECT doc_id, i, line, CASE WHEN i < n - 1 THEN chr(10) ELSE '' END AS sep, regexp_extract(line, '^{_W}{{0,3}}(`{{3,}}|~{{3,}})', 1) AS run, regexp_matches(line, '^(=+|-+){_W}*$') AS u,
  CASE WHEN regexp_matches(line, '^#{{1,6}}({_W}|$)') THEN 'atxHeading' WHEN regexp_matches(line, '^{_W}*$') THEN 'blank' WHEN regexp_matches(line, '^{_W}*>') THEN 'blockquote'
   WHEN regexp_matches(line, '^{_W}*([-*+•–·]|[0-9]+[.)]) ') THEN 'listItem' WHEN regexp_matches(line, '^{_W}*[|]') THEN 'tableRow' WHEN regexp_matches(line, '^{_W}*([-*_]{_W}*){{3,}}$') THEN 'thematicBreak'
   WHEN line LIKE '    %' THEN 'indentedCode' ELSE 'paragraph' END AS base FROM l{x}),
 r{x} AS (SELECT doc_id, i, line, sep, line = '---' AS fm, CASE WHEN line <> '---' THEN substr(run, 1, 1) ELSE '' END AS ch, CASE WHEN line <> '---' THEN len(run) ELSE 0 END AS fl,
   CASE WHEN line = '---' THEN 'frontmatter' WHEN run <> '' THEN 'fencedCode' ELSE base END AS kind FROM c{x} WHERE i = 0
  UNION ALL
  SELECT c{x}.doc_id, c{x}.i, c{x}.line, c{x}.sep, r{x}.fm AND c{x}.line <> '---', CASE WHEN r{x}.fm THEN '' WHEN r{x}.fl > 0 THEN CASE WHEN substr(c{x}.run, 1, 1) = r{x}.ch AND len(c{x}.run) >= r{x}.fl THEN '' ELSE r{x}.ch END ELSE substr(c{x}.run, 1, 1) END,
   CASE WHEN r{x}.fm THEN 0 WHEN r{x}.fl > 0 THEN CASE WHEN substr(c{x}.run, 1, 1) = r{x}.ch AND len(c{x}.run) >= r{x}.fl THEN 0 ELSE r{x}.fl END ELSE len(c{x}.run) END,
   CASE WHEN r{x}.fm THEN 'frontmatter' WHEN r{x}.fl > 0 OR c{x}.run <> '' THEN 'fencedCode' WHEN c{x}.u AND c{x}.base IN ('thematicBreak', 'paragraph') AND r{x}.kind = 'paragraph' THEN 'setextHeading' ELSE c{x}.base END
  FROM r{x} JOIN c{x} ON c{x}.doc_id = r{x}.doc_id AND c{x}.i = r{x}.i + 1),
 s{x} AS (SELECT doc_id, i, line, sep, CASE WHEN kind = 'paragraph' AND lead(kind) OVER w = 'setextHeading' THEN 'setextHeading' ELSE kind END AS kind FROM r{x} WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 t{x} AS (SELECT *, CASE WHEN kind = 'blank' OR lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS new FROM s{x} WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 k{x} AS (SELECT * EXCLUDE (new), sum(new) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS b FROM t{x}),
 free{x} AS (SELECT *, kind NOT IN ('fencedCode', 'indentedCode', 'frontmatter') AS free FROM k{x})"""


_KINDS = f"WITH RECURSIVE {_kinds_sql(_N)}"
_JOINED = "SELECT doc_id, string_agg({0}, '' ORDER BY i) AS text FROM {1} GROUP BY doc_id"
def _bodies(notes: str, x: str) -> str:
    return _kinds_sql(notes, x) + f", bb{x} AS (SELECT doc_id, b AS i, free, string_agg(line || sep, '' ORDER BY i) AS body FROM free{x} GROUP BY doc_id, b, free)"


_PLAIN = "x"
for _g, _p in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("æ", "ae"), ("œ", "oe"), ("“", '"'), ("”", '"'), ("‘", "''"), ("’", "''"), ("—", "-"), ("–", "-"), ("…", "...")):
    _PLAIN = f"replace({_PLAIN}, '{_g}', '{_p}')"
_TRIM = f"regexp_replace(regexp_replace({{0}}, '^{_W}+', ''), '{_W}+$', '')"

# Each step of the clean-up: of a SELECT of notes, and an ending for names, the tables it needs and the SELECT of the notes after it.


def _dehyphenate_sql(notes, x=""):
    return _bodies(notes, x), _JOINED.format("CASE WHEN free THEN regexp_replace(body, '(`[^`]*`)|([a-z])-\n([a-z])', '\\1\\2\\3', 'g') ELSE body END", f"bb{x}")


def _dewrap_sql(notes, x=""):
    return _kinds_sql(notes, x) + f", d{x} AS (SELECT *, CASE WHEN kind = 'paragraph' AND lead(b) OVER (PARTITION BY doc_id ORDER BY i) = b THEN ' ' ELSE sep END AS s2 FROM k{x})", _JOINED.format("line || s2", f"d{x}")


def _ligatures_sql(notes, x=""):
    return _bodies(notes, x), _JOINED.format(f"CASE WHEN free THEN array_to_string(list_transform(regexp_extract_all(body, '`[^`]*`|[^`]+|`'), lambda x: CASE WHEN x LIKE '`%`' AND len(x) > 1 THEN x ELSE {_PLAIN} END), '') ELSE body END", f"bb{x}")


def _whitespace_sql(notes, x=""):
    return _kinds_sql(notes, x) + f""",
 y{x} AS (SELECT doc_id, i, sep, kind, CASE WHEN free AND kind NOT IN ('blank', 'tableRow') THEN regexp_replace(regexp_extract(line, '^{_W}*') || regexp_replace(regexp_replace(line, '^{_W}*', ''), '  +', ' ', 'g'), '[ \\t]+$', '') ELSE line END AS line,
  sum(CASE WHEN kind = 'blank' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM free{x}),
 z{x} AS (SELECT *, count(*) FILTER (kind = 'blank') OVER (PARTITION BY doc_id, g) AS m, row_number() OVER (PARTITION BY doc_id, g, kind = 'blank' ORDER BY i) AS q FROM y{x})""", f"SELECT doc_id, string_agg(line || sep, '' ORDER BY i) AS text FROM z{x} WHERE kind <> 'blank' OR m < 3 OR q = 1 GROUP BY doc_id"


def _bullets_sql(notes, x=""):
    return _kinds_sql(notes, x), _JOINED.format(f"CASE WHEN kind = 'listItem' THEN regexp_replace(line, '^({_W}*)[-*+•–·]([ \\t])', '\\1-\\2') ELSE line END || sep", f"k{x}")


def _ordered_sql(notes, x=""):
    return _kinds_sql(notes, x) + f""",
 g{x} AS (SELECT *, sum(CASE WHEN kind IN ('blank', 'listItem') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g, len(regexp_extract(line, '^{_W}*')) AS ind, regexp_extract(line, '^{_W}*([0-9]+)[.)]', 1) AS dg FROM k{x}),
 it{x} AS (SELECT * FROM g{x} WHERE kind = 'listItem' AND dg <> ''),
 nr{x} AS (SELECT a.doc_id, a.i, count(*) AS nr FROM it{x} a JOIN it{x} x ON x.doc_id = a.doc_id AND x.g = a.g AND x.i <= a.i AND x.ind = a.ind
  AND NOT EXISTS (SELECT 1 FROM it{x} y WHERE y.doc_id = a.doc_id AND y.g = a.g AND y.i > x.i AND y.i < a.i AND y.ind < a.ind) GROUP BY a.doc_id, a.i)""", f"SELECT g.doc_id, string_agg(CASE WHEN nr IS NOT NULL AND dg::HUGEINT <> nr THEN substr(line, 1, ind) || nr || substr(line, ind + len(dg) + 1) ELSE line END || sep, '' ORDER BY g.i) AS text FROM g{x} g LEFT JOIN nr{x} nr ON nr.doc_id = g.doc_id AND nr.i = g.i GROUP BY g.doc_id"


def _heads_sql(x=""):
    return f"h{x} AS (SELECT doc_id, i, line, len(regexp_extract(line, '^(#{{1,6}}){_W}', 1)) AS level FROM l{x} WHERE regexp_matches(line, '^#{{1,6}}{_W}'))"


def _headings_sql(notes, x=""):
    return f"""n{x} AS ({notes}), p{x} AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM n{x}), l{x} AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls)))::BIGINT AS i FROM p{x}), {_heads_sql(x)},
 o{x} AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ord FROM h{x}),
 r{x} AS (SELECT doc_id, i, ord, level, level AS t FROM o{x} WHERE ord = 1 UNION ALL SELECT o.doc_id, o.i, o.ord, o.level, least(o.level, r{x}.t + 1) FROM r{x} JOIN o{x} o ON o.doc_id = r{x}.doc_id AND o.ord = r{x}.ord + 1)""", f"SELECT l.doc_id, string_agg(CASE WHEN t IS NOT NULL THEN repeat('#', t) || substr(line, r.level + 1) ELSE line END, chr(10) ORDER BY l.i) AS text FROM l{x} l LEFT JOIN r{x} r ON r.doc_id = l.doc_id AND r.i = l.i GROUP BY l.doc_id"


_FRAME = r"^([ \t\n\f\r\x0b]|[┌┬┐├┼┤└┴┘─┏┳┓┣╋┫┗┻┛━╔╦╗╠╬╣╚╩╝═│┃║|+=-])+$"


def _boxes_sql(notes, x=""):
    mark = lambda s: f"sum(CASE WHEN content THEN len(line) - len(replace(line, '{s}', '')) ELSE 0 END) OVER (PARTITION BY doc_id, isl)"
    row = lambda v: f"'| ' || array_to_string(list_transform({v}, lambda v: replace(v, '|', '\\|')), ' | ') || ' |'"
    return _kinds_sql(notes, x) + f""",
 x1{x} AS (SELECT doc_id, i, line, sep, kind NOT IN ('fencedCode', 'frontmatter') AND NOT regexp_matches(line, '^{_W}*$') AS drawn, coalesce(NOT regexp_matches(lag(line) OVER w, '^{_W}*$'), false) AS above, coalesce(NOT regexp_matches(lead(line) OVER w, '^{_W}*$'), false) AS below FROM k{x} WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 x2{x} AS (SELECT *, drawn AND regexp_matches(line, '{_FRAME}') AS border FROM x1{x}),
 x3{x} AS (SELECT *, border OR drawn AND regexp_matches(line, '[│┃║|]') AS solid, border AND regexp_matches(line, '[┌┬┐├┼┤└┴┘┏┳┓┣╋┫┗┻┛╔╦╗╠╬╣╚╩╝+]') AND regexp_matches(line, '[─━═=-]') AS top FROM x2{x}),
 x4{x} AS (SELECT *, sum(CASE WHEN solid THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS isl FROM x3{x}),
 x5{x} AS (SELECT *, solid AND bool_or(top) OVER (PARTITION BY doc_id, isl ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM x4{x}),
 x6{x} AS (SELECT *, run AND NOT border AS content FROM x5{x}),
 x7{x} AS (SELECT *, sum(CASE WHEN content THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, isl ORDER BY i) AS grp, {mark('│')} AS s1, {mark('┃')} AS s2, {mark('║')} AS s3, {mark('|')} AS s4 FROM x6{x}),
 x8{x} AS (SELECT doc_id, isl, grp, i, list_transform(string_split(line, CASE greatest(s1, s2, s3, s4) WHEN s1 THEN '│' WHEN s2 THEN '┃' WHEN s3 THEN '║' ELSE '|' END), lambda v: {_TRIM.format('v')}) AS ps FROM x7{x} WHERE content),
 x9{x} AS (SELECT doc_id, isl, grp, i, CASE WHEN len(ps) > 1 AND ps[1] = '' THEN ps[2:] ELSE ps END AS ps FROM x8{x}),
 xa{x} AS (SELECT doc_id, isl, grp, i, CASE WHEN len(ps) > 1 AND ps[-1] = '' THEN ps[:-2] ELSE ps END AS ps FROM x9{x}),
 xb{x} AS (SELECT doc_id, isl, grp, list(ps ORDER BY i) AS pieces, min(len(ps)) AS a, max(len(ps)) AS z FROM xa{x} GROUP BY doc_id, isl, grp),
 xc{x} AS (SELECT doc_id, isl, grp, a, z, list_transform(range(1, z + 1), lambda c: array_to_string(list_filter(list_transform(pieces, lambda p: p[c]), lambda v: v <> ''), ' ')) AS cs FROM xb{x}),
 xd{x} AS (SELECT doc_id, isl, list({row('cs')} ORDER BY grp) AS rs, max(z) AS z FROM xc{x} GROUP BY doc_id, isl HAVING min(a) = max(z)),
 xe{x} AS (SELECT doc_id, isl, array_to_string(list_concat(list_concat(rs[1:1], ['| ' || array_to_string(list_transform(range(z), lambda v: '---'), ' | ') || ' |']), rs[2:]), chr(10)) AS tbl FROM xd{x}),
 xf{x} AS (SELECT x7{x}.*, tbl, tbl IS NOT NULL AND run AS turned FROM x7{x} LEFT JOIN xe{x} USING (doc_id, isl)),
 xg{x} AS (SELECT *, min(i) OVER w = i AS first, arg_max(sep, i) OVER w AS ls, arg_max(below, i) OVER w AS lb FROM xf{x} WINDOW w AS (PARTITION BY doc_id, isl, turned))""", f"SELECT doc_id, string_agg(CASE WHEN turned THEN CASE WHEN above THEN chr(10) ELSE '' END || tbl || ls || CASE WHEN lb AND ls = chr(10) THEN chr(10) ELSE '' END ELSE line || sep END, '' ORDER BY i) AS text FROM xg{x} WHERE NOT turned OR first GROUP BY doc_id"


def _chained(notes: str, *steps, x: str = "_") -> tuple[str, str]:
    """The tables of several steps one after the other, and the SELECT of the last."""
    tables = []
    for i, step in enumerate(steps):
        more, notes_after = step(notes, f"{x}{i}")
        tables += [more, f"out{x}{i} AS ({notes_after})"]
        notes = f"SELECT doc_id, text FROM out{x}{i}"
    return ",\n".join(tables), notes


def _sql(step) -> str:
    return f"WITH RECURSIVE {step[0]} {step[1]}"


_CLEANUP = (_boxes_sql, _dehyphenate_sql, _dewrap_sql, _whitespace_sql, _ligatures_sql, _bullets_sql, _ordered_sql, _headings_sql)


@_query("st1_lines", "SELECT doc_id, text FROM documents", f"WITH {_lines_sql('SELECT doc_id, text FROM documents')} SELECT doc_id, i AS line_no, coalesce(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, line FROM l")
def _lines(notes):
    return lines.lines(notes)


@_query("st2_blocks", _N, _KINDS + ", e AS (SELECT *, sum(len(line) + len(sep)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS o FROM k) SELECT doc_id, b AS block_no, kind, min(i) AS start_line, max(i) AS end_line, min(o - len(line) - len(sep))::BIGINT AS start_off, max(o) AS end_off FROM e GROUP BY doc_id, b, kind")
def _blocks(notes):
    return lines.blocks(notes)


@_query("cl1_dehyphenate", _N, _sql(_dehyphenate_sql(_N)))
def _dehyphenate(notes):
    return cleanup.dehyphenate(notes)


@_query("cl2_dewrap", _N, _sql(_dewrap_sql(_N)))
def _dewrap(notes):
    return cleanup.dewrap(notes)


@_query("cl3_decompose_ligatures", _N, _sql(_ligatures_sql(_N)))
def _ligatures(notes):
    return cleanup.decompose_ligatures(notes)


@_query("cl4_tidy_whitespace", _N, _sql(_whitespace_sql(_N)))
def _tidy(notes):
    return cleanup.tidy_whitespace(notes)


@_query("li1_normalize_bullets", _N, _sql(_bullets_sql(_N)))
def _bullets(notes):
    return cleanup.normalize_bullets(notes)


@_query("li2_normalize_ordered", _N, _sql(_ordered_sql(_N)))
def _ordered(notes):
    return cleanup.normalize_ordered(notes)


_HEADS = _heads_sql()


@_query("st4_headings", _N, f"WITH {_lines_sql(_N)}, {_HEADS}, o AS (SELECT doc_id, i, coalesce(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM l) SELECT h.doc_id, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.i) AS ord, h.i AS line_no, off, level::BIGINT AS level, regexp_replace(regexp_replace(substr(line, level + 1), '^{_W}+', ''), '{_W}+$', '') AS title FROM h JOIN o ON h.doc_id = o.doc_id AND h.i = o.i")
def _headings(notes):
    return cleanup.headings(notes)


@_query("he1_normalize_headings", _N, _sql(_headings_sql(_N)))
def _normalize_headings(notes):
    return cleanup.normalize_headings(notes)


#: The pasted fragment and the caret of cascading: the text's second half goes in behind its first.
_CUT = "length(text) // 2"


@_query("he2_cascade", _N, f"""WITH m AS (SELECT doc_id, substr(text, 1, {_CUT}) AS a, substr(text, {_CUT} + 1) AS b FROM ({_N})),
 x AS (SELECT *, list_transform(list_filter(string_split(a, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}}{_W}')), lambda x: len(regexp_extract(x, '^#+'))) AS ca, list_min(list_transform(list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}}{_W}')), lambda x: len(regexp_extract(x, '^#+')))) AS low FROM m),
 y AS (SELECT *, ca[-1] + 1 - low AS shift, string_split(b, chr(10)) AS ls FROM x)
 SELECT doc_id, ca[-1]::BIGINT AS context, CASE WHEN shift IS NULL THEN NULL ELSE a || array_to_string(list_transform(ls, lambda x, i: CASE WHEN regexp_matches(x, '^#{{1,6}}({_W}|$)') AND (i < len(ls) OR regexp_matches(x, '^#{{1,6}}{_W}')) THEN repeat('#', least(6, greatest(1, len(regexp_extract(x, '^#+')) + shift))::INT) || substr(x, len(regexp_extract(x, '^#+')) + 1) ELSE x END), chr(10)) END AS text FROM y""")
def _cascade(notes):
    cut = F.floor(F.length("text") / 2).cast("int")
    parts = notes.select("doc_id", F.substr(F.col("text"), F.lit(1), cut).alias("a"), F.substr(F.col("text"), cut + 1, F.length("text")).alias("b"))
    from .. import functions as js

    levels = lambda c: F.transform(F.filter(F.split(c, "\n", -1), lambda x: x.rlike(js.HEADING)), lambda x: F.length(F.regexp_extract(x, js.HEADING, 1)))
    parts = parts.withColumn("context", F.try_element_at(levels("a"), F.lit(-1)).cast("long")).withColumn("shift", (F.col("context") + 1 - F.array_min(levels("b"))).cast("int"))
    return parts.select("doc_id", "context", F.when(F.col("shift").isNotNull(), F.concat("a", cleanup.shift_headings(F.col("b"), F.col("shift")))).alias("text"))


#: How many edits a step makes in a note: of the names' ending, a SELECT of doc_id and n (not for notes without any).
_COUNTS = {
    "box_table": lambda x: f"SELECT doc_id, count(*) AS n FROM xg{x} WHERE turned AND first GROUP BY doc_id",
    "dehyphenate": lambda x: f"SELECT doc_id, sum(CASE WHEN free THEN len(body) - len(regexp_replace(body, '(`[^`]*`)|([a-z])-\n([a-z])', '\\1\\2\\3', 'g')) ELSE 0 END)::BIGINT // 2 AS n FROM bb{x} GROUP BY doc_id",
    "dewrap": lambda x: f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM k{x} WHERE kind = 'paragraph' GROUP BY doc_id, b HAVING count(*) > 1) GROUP BY doc_id",
    "tidy_whitespace": lambda x: f"SELECT z.doc_id, count(*) AS n FROM z{x} z JOIN k{x} k ON k.doc_id = z.doc_id AND k.i = z.i WHERE k.line <> z.line OR z.kind = 'blank' AND m >= 3 AND q = 1 GROUP BY z.doc_id",
    "decompose_ligatures": lambda x: f"SELECT doc_id, sum(len(list_filter(list_zip(string_split(body, chr(10)), string_split(fixed, chr(10))), lambda p: p[1] <> p[2])))::BIGINT AS n FROM (SELECT doc_id, body, CASE WHEN free THEN array_to_string(list_transform(regexp_extract_all(body, '`[^`]*`|[^`]+|`'), lambda x: CASE WHEN x LIKE '`%`' AND len(x) > 1 THEN x ELSE {_PLAIN} END), '') ELSE body END AS fixed FROM bb{x}) GROUP BY doc_id",
    "normalize_bullets": lambda x: f"SELECT doc_id, count(*) AS n FROM k{x} WHERE kind = 'listItem' AND regexp_matches(line, '^{_W}*[*+•–·][ \t]') GROUP BY doc_id",
    "normalize_ordered": lambda x: f"SELECT g.doc_id, count(*) AS n FROM g{x} g JOIN nr{x} nr ON nr.doc_id = g.doc_id AND nr.i = g.i WHERE TRY_CAST(dg AS HUGEINT) <> nr GROUP BY g.doc_id",
    "normalize_headings": lambda x: f"SELECT doc_id, count(*) AS n FROM r{x} WHERE t <> level GROUP BY doc_id",
}


def _counted_sql(notes: str) -> str:
    tables, last = _chained(notes, *_CLEANUP)
    each = ", ".join(f"c_{name} AS ({sql(f'_{i}')})" for i, (name, sql) in enumerate(_COUNTS.items()))
    joins = " ".join(f"LEFT JOIN c_{name} USING (doc_id)" for name in _COUNTS)
    return f"WITH RECURSIVE {tables}, done AS ({last}), {each} SELECT doc_id, text, {', '.join(f'coalesce(c_{n}.n, 0)::BIGINT AS n_{n}' for n in _COUNTS)} FROM done {joins}"


@_query("pi1_step_counts_of_frames", builders.FRAMES, _counted_sql(builders.FRAMES))
@_query("pi1_step_counts", _N, _counted_sql(_N))
def _step_counts(notes):
    done = format.clean_steps(notes)
    return done.select("doc_id", "text", *[f"n_{s}" for s in _COUNTS])


@_query("pi1_step_plans", _N, _counted_sql(_N))
def _step_plans(notes):
    """The same by way of the plans: each is applied to the text that the one before it left."""
    # Read twice, so that texts that are computed are computed once.
    notes = scratch.written(notes)
    done = notes.select("doc_id", F.coalesce("text", F.lit("")).alias("was")).join(format.clean_steps(notes), "doc_id")
    for s in _COUNTS:
        done = done.withColumn("was", edits.apply_edits(F.col("was"), F.col(f"plan_{s}")))
    return done.select("doc_id", F.col("was").alias("text"), *[F.size(f"plan_{s}").cast("long").alias(f"n_{s}") for s in _COUNTS])


@_query("pi1_cleanup_headings_lists", _N, _sql(_chained(_N, *_CLEANUP)))
def _cleanup(notes):
    return format.apply_cleanup(notes)


_NOT_DEF = r"NOT regexp_matches(line, '^\[\^[^\]]+\]:')"
def _cites_sql(notes: str, x: str = "") -> str:
    """RE2 looks neither back nor ahead: marks are split off by the characters around them."""
    return f"""{_lines_sql(notes, x)},
 pc{x} AS (SELECT doc_id, i, line, regexp_extract_all(line, '\\[[0-9]+\\]|\\[[^\\[]*|[^\\[]+') AS ts FROM l{x} WHERE {_NOT_DEF}),
 tk{x} AS (SELECT doc_id, i, unnest(ts) AS t, unnest(range(len(ts))) AS j FROM pc{x}),
 ck{x} AS (SELECT *, regexp_matches(t, '^\\[[0-9]+\\]$') AND coalesce(lead(t) OVER w, '') NOT LIKE '(%' AND coalesce(lag(t) OVER w, '') NOT LIKE '%^' AS cite FROM tk{x} WINDOW w AS (PARTITION BY doc_id, i ORDER BY j))"""


_CITES = _cites_sql(_FN)


def _citations_sql(notes, x=""):
    return _cites_sql(notes, x) + f", x{x} AS (SELECT doc_id, i, string_agg(CASE WHEN cite THEN '[^' || t[2:-2]::HUGEINT || ']' ELSE t END, '' ORDER BY j) AS line FROM ck{x} GROUP BY doc_id, i)", f"SELECT l.doc_id, string_agg(coalesce(x.line, l.line), chr(10) ORDER BY l.i) AS text FROM l{x} l LEFT JOIN x{x} x ON x.doc_id = l.doc_id AND x.i = l.i GROUP BY l.doc_id"


@_query("st9_citations", _FN, f"WITH {_CITES} SELECT doc_id, i AS line_no, row_number() OVER (PARTITION BY doc_id, i ORDER BY j) AS ord, t[2:-2] AS number FROM ck WHERE cite")
def _citations(notes):
    return footnotes.citations(notes)


@_query("fn1_from_citations", _FN, _sql(_citations_sql(_FN)))
def _from_citations(notes):
    return notes.select("doc_id", footnotes.from_citations(F.col("text")).alias("text"))


def _defs_sql(notes: str, x: str = "") -> str:
    return f"""{_lines_sql(notes, x)}, nx{x} AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nl FROM l{x}),
 df{x} AS (SELECT doc_id, i AS line_no, regexp_extract(line, '^\\[\\^([^\\]]+)\\]: (.*)$', 1) AS id, regexp_extract(line, '^\\[\\^([^\\]]+)\\]: (.*)$', 2) AS snippet, coalesce(regexp_matches(nl, '^\\[[^\\]]*\\]\\([^)]+\\)$'), false) AS two, nl FROM nx{x} WHERE regexp_matches(line, '^\\[\\^[^\\]]+\\]: '))"""


_DEFS = _defs_sql(_FN)


@_query("st7_definitions", _FN, f"WITH {_DEFS} SELECT doc_id, line_no, id, NOT regexp_matches(id, '^[0-9]+$') AS alpha, snippet, CASE WHEN two THEN regexp_extract(nl, '^\\[([^\\]]*)\\]\\(([^)]+)\\)$', 1) END AS title, CASE WHEN two THEN regexp_extract(nl, '^\\[([^\\]]*)\\]\\(([^)]+)\\)$', 2) END AS url FROM df")
def _definitions(notes):
    return footnotes.definitions(notes)


def _refs_sql(x: str = "") -> str:
    return f"""pr{x} AS (SELECT doc_id, i, regexp_extract_all(line, '\\[\\^[^\\]]+\\]|[^\\[]+|\\[') AS ts FROM l{x} WHERE {_NOT_DEF}),
 tr{x} AS (SELECT doc_id, i, unnest(ts) AS t, unnest(range(len(ts))) AS j FROM pr{x}),
 rf{x} AS (SELECT doc_id, i, j, t[3:-2] AS id FROM (SELECT *, lead(t) OVER (PARTITION BY doc_id, i ORDER BY j) AS nt FROM tr{x}) WHERE t LIKE '[^%]' AND coalesce(nt, '') NOT LIKE ':%')"""


_REFS = _refs_sql()


@_query("st8_references", _FN, f"WITH {_lines_sql(_FN)}, {_REFS} SELECT doc_id, i AS line_no, row_number() OVER (PARTITION BY doc_id, i ORDER BY j) AS ord, id FROM rf")
def _references(notes):
    return footnotes.references(notes)


#: Notes with footnotes some of whose names span lines or hold an opening bracket.
_WIDE = f"SELECT doc_id, replace(replace(text, '[^x]', '[^x' || chr(10) || 'y]'), ' [2] ', ' [^p' || chr(10) || '[^4] ') AS text FROM ({_FN})"


@_query("st8_reference_spans", _WIDE, f"""WITH {_lines_sql(_WIDE)}, o AS (SELECT *, coalesce(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM l),
 tk AS (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS j FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\[\\^[^\\]]+\\]|[^\\[]+|\\[') AS ts FROM n)),
 sp AS (SELECT *, coalesce(sum(len(t)) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, lead(t) OVER (PARTITION BY doc_id ORDER BY j) AS nt FROM tk)
 SELECT sp.doc_id, o.i AS line_no, sp.off, sp.off + len(t) AS "end", t[3:-2] AS id, NOT regexp_full_match(t[3:-2], '[0-9]+') AS alpha FROM sp JOIN o ON o.doc_id = sp.doc_id AND sp.off BETWEEN o.off AND o.off + len(o.line)
 WHERE t LIKE '[^%' AND coalesce(nt, '') NOT LIKE ':%' AND {_NOT_DEF}""")
def _reference_spans(notes):
    return footnotes.reference_spans(notes)


@_query("st10_resources_section", _FN, f"""WITH {_lines_sql(_FN)}, o AS (SELECT *, coalesce(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM l),
 h AS (SELECT doc_id, i, off, len(regexp_extract(line, '^#+')) AS level, trim(substr(line, len(regexp_extract(line, '^#+')) + 1)) AS title FROM o WHERE regexp_matches(line, '^#{{1,6}}{_W}')),
 f AS (SELECT * FROM h WHERE title = 'Resources' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1)
 SELECT f.doc_id, f.level::BIGINT AS level, f.off AS start_off, coalesce((SELECT min(off) FROM h WHERE h.doc_id = f.doc_id AND h.i > f.i AND h.level <= f.level), len(n.text))::BIGINT AS end_off FROM f JOIN n ON n.doc_id = f.doc_id""")
def _section(notes):
    return footnotes.resources_section(notes)


@_query("st12_existing_refs", _FN, f"WITH {_lines_sql(_FN)}, nx AS (SELECT *, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY i), '') AS nl FROM l) SELECT doc_id, i AS line_no, regexp_extract(line, '^\\[\\^([0-9]+)\\]:', 1)::BIGINT AS id, regexp_extract(nl, '^\\[[^\\]]*\\]\\(([^)]+)\\)', 1) AS url FROM nx WHERE regexp_matches(line, '^\\[\\^[0-9]+\\]:')")
def _existing(notes):
    return footnotes.existing_refs(notes)


@_query("st13_definition_count", _FN, f"WITH {_lines_sql(_FN)} SELECT doc_id, count(DISTINCT regexp_extract(line, '^\\[\\^([0-9]+)\\]:', 1)) AS n_ids FROM l WHERE regexp_matches(line, '^\\[\\^[0-9]+\\]:') GROUP BY doc_id")
def _count(notes):
    return footnotes.existing_refs(notes).groupBy("doc_id").agg(F.count_distinct("id").alias("n_ids"))


def _keys_sql(source: str) -> str:
    """A table uk (url, key) of the URLs of ``source`` (url) and what they are canonically."""
    form = lambda v: f"replace(replace(replace(url_encode(url_decode(replace({v}, '+', ' '))), '%20', '+'), '~', '%7E'), '%2A', '*')"
    return f"""ut AS (SELECT DISTINCT url, trim(url) AS x FROM {source} WHERE url IS NOT NULL),
 uw AS (SELECT *, lower(regexp_extract(x, '^(?i)(https?)://', 1)) AS sc, regexp_replace(regexp_replace(x, '^[A-Za-z]+://', ''), '#.*$', '') AS y FROM ut),
 uv AS (SELECT *, regexp_extract(y, '^[^/?]*') AS h, regexp_replace(regexp_extract(y, '^[^/?]*([^?]*)', 1), '/$', '') AS p, CASE WHEN contains(y, '?') THEN substr(y, instr(y, '?') + 1) ELSE '' END AS q FROM uw),
 us AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(q, '&'), lambda e: e <> ''), lambda e, i: {{'n': url_decode(replace(string_split(e, '=')[1], '+', ' ')), 'i': i, 'e': {form("string_split(e, '=')[1]")} || '=' || CASE WHEN contains(e, '=') THEN {form("substr(e, instr(e, '=') + 1)")} ELSE '' END}})), lambda e: e.e), '&') AS qs FROM uv),
 uk AS (SELECT url, CASE WHEN sc = '' THEN lower(x) ELSE sc || '://' || regexp_replace(regexp_replace(lower(h), '^.*@', ''), CASE WHEN sc = 'http' THEN ':(80)?$' ELSE ':(443)?$' END, '') || p || CASE WHEN qs = '' THEN '' ELSE '?' || qs END END AS key FROM us)"""


def _ids_sql(x: str = "") -> str:
    """A table im (doc_id, id, nid) of the numbers that footnotes get, behind the tables of definitions and references of notes."""
    return f"""ud{x} AS (SELECT regexp_extract(nl, '^\\[([^\\]]*)\\]\\(([^)]+)\\)$', 2) AS url FROM df{x} WHERE two), {_keys_sql(f'ud{x}')},
 a{x} AS (SELECT doc_id, id::HUGEINT AS id, 0 AS k, i, j FROM rf{x} WHERE regexp_matches(id, '^[0-9]+$') UNION ALL SELECT doc_id, id::HUGEINT, 1, line_no, 0 FROM df{x} WHERE regexp_matches(id, '^[0-9]+$')),
 o{x} AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY min((k, i, j))) AS o FROM a{x} GROUP BY doc_id, id),
 fd{x} AS (SELECT doc_id, id::HUGEINT AS id, CASE WHEN two THEN regexp_extract(nl, '^\\[([^\\]]*)\\]\\(([^)]+)\\)$', 2) END AS url FROM df{x} WHERE regexp_matches(id, '^[0-9]+$') QUALIFY row_number() OVER (PARTITION BY doc_id, id::HUGEINT ORDER BY line_no) = 1),
 ge{x} AS (SELECT o.*, min(o) OVER (PARTITION BY o.doc_id, CASE WHEN fd.url IS NULL THEN 'i' || o.id ELSE 'u' || key END) AS m FROM o{x} o LEFT JOIN fd{x} fd ON fd.doc_id = o.doc_id AND fd.id = o.id LEFT JOIN uk ON uk.url = fd.url),
 im{x} AS (SELECT doc_id, id, dense_rank() OVER (PARTITION BY doc_id ORDER BY m) AS nid FROM ge{x})"""


_IDS = f"{_DEFS}, {_REFS}, {_ids_sql()}"


def _identity_sql(notes, x=""):
    return f"""{_defs_sql(notes, x)}, {_refs_sql(x)}, {_ids_sql(x)},
 tj{x} AS (SELECT *, lead(t) OVER (PARTITION BY doc_id, i ORDER BY j) AS nt, regexp_matches(t, '^\\[\\^[0-9]+\\]$') AS num FROM tr{x}),
 rn{x} AS (SELECT tj.doc_id, tj.i, string_agg(CASE WHEN nid IS NOT NULL AND coalesce(nt, '') NOT LIKE ':%' THEN '[^' || nid || ']' ELSE t END, '' ORDER BY j) AS line FROM tj{x} tj LEFT JOIN im{x} im ON im.doc_id = tj.doc_id AND im.id = CASE WHEN num THEN t[3:-2]::HUGEINT END GROUP BY tj.doc_id, tj.i),
 dn{x} AS (SELECT nd.*, nid, row_number() OVER (PARTITION BY nd.doc_id, nid ORDER BY line_no) AS q FROM (SELECT doc_id, line_no, two, id::HUGEINT AS id FROM df{x} WHERE NOT regexp_matches(id, '[^0-9]')) nd JOIN im{x} im ON im.doc_id = nd.doc_id AND im.id = nd.id)""", f"""SELECT l.doc_id, coalesce(string_agg(CASE WHEN dn.q = 1 THEN '[^' || dn.nid || substr(l.line, instr(l.line, ']:')) ELSE coalesce(rn.line, l.line) END || CASE WHEN l.i < l.n - 1 THEN chr(10) ELSE '' END, '' ORDER BY l.i) FILTER (coalesce(dn.q, 1) = 1 AND NOT (coalesce(pd.q, 1) > 1 AND coalesce(pd.two, false))), '') AS text
 FROM l{x} l LEFT JOIN dn{x} dn ON dn.doc_id = l.doc_id AND dn.line_no = l.i LEFT JOIN dn{x} pd ON pd.doc_id = l.doc_id AND pd.line_no = l.i - 1 LEFT JOIN rn{x} rn ON rn.doc_id = l.doc_id AND rn.i = l.i GROUP BY l.doc_id"""


@_query("fn2_id_map", _FN, f"WITH {_IDS} SELECT doc_id, id::BIGINT AS old_id, nid AS new_id FROM im")
def _id_map(notes):
    return footnotes.id_map(notes, urls.normalize_url).drop("old")


@_query("fn2_identity", _FN, _sql(_identity_sql(_FN)))
def _identity(notes):
    return footnotes.identity(notes, urls.normalize_url)


_ATX = r"^(#{1,6})[ \t]+(.+?)[ \t]*$"


def _section_sql(x: str = "") -> str:
    """Tables h (headings) and sc (the lines a at which the first section of definitions begins and z before which it ends, with its level), of lines l."""
    return f"""h{x} AS (SELECT doc_id, i, len(regexp_extract(line, '{_ATX}', 1)) AS level, regexp_extract(line, '{_ATX}', 2) AS title FROM l{x} WHERE regexp_matches(line, '{_ATX}')),
 f{x} AS (SELECT * FROM h{x} WHERE title = 'Resources' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1),
 sc{x} AS (SELECT f.doc_id, f.i AS a, f.level, (SELECT min(i) FROM h{x} h WHERE h.doc_id = f.doc_id AND h.i > f.i AND h.level <= f.level) AS z FROM f{x} f)"""


def _move_sql(notes, x=""):
    return f"""{_defs_sql(notes, x)}, {_section_sql(x)},
 mv{x} AS (SELECT df.*, sc.a, sc.z FROM df{x} df LEFT JOIN sc{x} sc ON sc.doc_id = df.doc_id WHERE NOT regexp_matches(id, '[^0-9]') AND (sc.a IS NULL OR line_no < sc.a OR line_no >= sc.z)),
 ct{x} AS (SELECT doc_id, any_value(a) AS a, any_value(z) AS z, CASE WHEN bool_or(two) THEN string_agg('[^' || id || ']: ' || snippet || CASE WHEN two THEN chr(10) || nl ELSE '' END, chr(10) || chr(10) ORDER BY line_no) ELSE string_agg('[^' || id || ']: ' || snippet || CASE WHEN two THEN chr(10) || nl ELSE '' END, chr(10) ORDER BY line_no) END AS body FROM mv{x} GROUP BY doc_id),
 ps{x} AS (SELECT l.doc_id, l.i * 2 + 1 AS k, line || CASE WHEN l.i < l.n - 1 THEN chr(10) ELSE '' END AS piece FROM l{x} l LEFT JOIN mv{x} mv ON mv.doc_id = l.doc_id AND (mv.line_no = l.i OR (mv.line_no = l.i - 1 AND mv.two)) WHERE mv.doc_id IS NULL
  UNION ALL SELECT doc_id, CASE WHEN a IS NULL OR z IS NULL THEN 1000000000 ELSE z * 2 END, CASE WHEN a IS NULL THEN chr(10) || '## Resources' || chr(10) || chr(10) || body ELSE chr(10) || body || chr(10) END FROM ct{x})""", f"SELECT doc_id, string_agg(piece, '' ORDER BY k) AS text FROM ps{x} GROUP BY doc_id"


_TIDY = (_citations_sql, _identity_sql, _move_sql)


@_query("fn3_move", _FN, _sql(_move_sql(_FN)))
def _move(notes):
    return footnotes.move(notes)


@_query("fn4_tidy", _FN, _sql(_chained(_FN, *_TIDY)))
def _tidy_notes(notes):
    return footnotes.tidy(notes, urls.normalize_url)


@_query("pi3_format_notes", _FN, _sql(_chained(_FN, *_CLEANUP, *_TIDY)))
def _format_notes(notes):
    return format.format_notes(notes)


@_query("cl6_box_table", builders.FRAMES, _sql(_boxes_sql(builders.FRAMES)))
def _box_table(notes):
    return tables.box_table(notes)


@_query("io6_diff_apply", _N, f"""WITH m AS (SELECT doc_id, text AS a, replace(text, chr(10), ' ') AS b FROM ({_N})),
 q AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS p FROM m),
 s AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) - p + 1), lambda i: a[len(a) + 1 - i] <> b[len(b) + 1 - i])) - 1, least(len(a), len(b)) - p) AS z FROM q)
 SELECT doc_id, (a <> b)::BIGINT AS n_edits, CASE WHEN a <> b THEN p END::BIGINT AS edit_from, CASE WHEN a <> b THEN len(a) - z END::BIGINT AS edit_to, CASE WHEN a <> b THEN substr(b, p + 1, len(b) - z - p) END AS edit_insert, b AS applied FROM s""")
def _diff(notes):
    both = notes.select("doc_id", F.col("text").alias("a"), F.translate("text", "\n", " ").alias("b"))
    both = edits.diff_plan(both, "a", "b")
    e = F.get("plan", F.lit(0))
    return both.select("doc_id", F.size("plan").cast("long").alias("n_edits"), e["from"].cast("long").alias("edit_from"), e["to"].cast("long").alias("edit_to"), e["insert"].alias("edit_insert"), edits.apply_edits(F.col("a"), F.col("plan")).alias("applied"))


@_query("ut1_normalize_url", builders.URLS, f"WITH u AS ({builders.URLS}), {_keys_sql('u')} SELECT doc_id, key AS url FROM u JOIN uk USING (url)")
def _urls(rows):
    return rows.select("doc_id", urls.normalize_url(F.col("url")).alias("url"))


_DOTTED = "(b >> 24) || '.' || ((b >> 16) & 255) || '.' || ((b >> 8) & 255) || '.' || (b & 255)"


@_query("ut1_url_hosts", builders.HOSTS, f"""WITH h AS (SELECT *, CASE WHEN doc_id % 8 = 3 THEN ((v >> 24) % 8) * 16777216 + v % 16777216 ELSE v END AS b FROM ({builders.HOSTS}))
 SELECT doc_id, 'http://' || CASE doc_id % 8 WHEN 4 THEN (v + 4294967296) || '/' WHEN 5 THEN 'a-' || v || '.ex' WHEN 6 THEN '[0:' || printf('%x', v % 65535 + 1) || ':0:0:1::]' WHEN 7 THEN '1.2.3.' || (v % 512) || CASE WHEN v % 512 > 255 THEN '/' ELSE '' END ELSE {_DOTTED} END AS url FROM h""")
def _hosts(rows):
    return rows.select("doc_id", urls.normalize_url(F.concat(F.lit("HTTP://"), F.col("host"), F.lit("/"))).alias("url"))


@_query("io2_selection_units", builders.WIDE, f"""WITH w AS ({builders.WIDE}), s AS (SELECT *, regexp_replace(text, '([\\x{{10000}}-\\x{{10FFFF}}])', '\\1' || chr(1), 'g') AS s, anchor IS NOT NULL AND head IS NOT NULL AS whole, least(anchor, head) AS a, greatest(anchor, head) AS z FROM w),
 p AS (SELECT *, CASE WHEN substr(s, a + 1, 1) = chr(1) THEN a - 1 ELSE a END AS f, CASE WHEN substr(s, z + 1, 1) = chr(1) THEN z - 1 ELSE z END AS t FROM s)
 SELECT doc_id, a AS sel_from, z AS sel_to, CASE WHEN whole THEN replace(substr(s, f + 1, t - f), chr(1), '') END AS input, CASE WHEN whole THEN replace(substr(s, 1, f) || '[😀]' || substr(s, t + 1), chr(1), '') END AS applied,
 CASE WHEN whole THEN f END AS edit_from, CASE WHEN whole THEN t END AS edit_to, CASE WHEN whole THEN f + 4 END AS cursor FROM p""")
def _selection_units(rows):
    text = F.col("text")
    edit = F.struct(F.col("sel_from").alias("from"), F.col("sel_to").alias("to"), F.lit("[😀]").alias("insert"))
    chosen = notes_source.selection(rows, units=True).withColumn("plan", F.when(F.col("input").isNotNull(), edits.plan_in_points(text, F.array(edit))))
    out = chosen.withColumn("back", edits.plan_in_units(text, F.col("plan")))
    of = lambda k: F.get("back", F.lit(0))[k].cast("long").alias(f"edit_{k}")
    return out.select("doc_id", "sel_from", "sel_to", "input", edits.apply_edits(text, F.col("plan")).alias("applied"), of("from"), of("to"), notes_source.cursor_after(F.col("back"), True).cast("long").alias("cursor"))


_LINKS = r"\!?\[[^\]]+\]\([^)]+\)"


@_query("di2_dispatch", builders.PASTES, f"""WITH n AS ({builders.PASTES}), s AS (SELECT *, string_split(text, chr(10)) AS ls FROM n)
 SELECT doc_id, CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '^(Sources|Citations:|Quellen){_W}*$'))) > 0 AND len(list_filter(ls, lambda x: regexp_matches(x, '^\\[[0-9]+\\]{_W}+.+{_W}+https?://[^ \\t]+{_W}*$'))) > 0 THEN 'app'
  WHEN len(list_filter(ls, lambda x: regexp_matches(trim(x), '^\\[\\^[A-Za-z0-9_]+_[A-Za-z0-9_]+\\]:{_W}+[^ \\t]+$'))) > 0 THEN 'web-download'
  WHEN len(list_filter(ls, lambda x: regexp_matches(x, '^(Sources\\b|Citations:|Quellen\\b|\\[\\^[^\\]]+\\]:)'))) = 0 AND len(list_filter(regexp_extract_all(text, '{_LINKS}'), lambda x: x NOT LIKE '!%')) > 0 THEN 'web' ELSE 'raw' END AS handler FROM s""")
def _dispatch(pastes):
    return pastes.select("doc_id", surfaces.handler(F.col("text")).alias("handler"))


@_query("cp3_web_sources", builders.PASTES, f"""WITH n AS ({builders.PASTES}), s AS (SELECT doc_id, list_filter(regexp_extract_all(text, '{_LINKS}'), lambda x: x NOT LIKE '!%') AS ks FROM n), e AS (SELECT doc_id, unnest(ks) AS k, unnest(range(len(ks)))::BIGINT + 1 AS id FROM s)
 SELECT doc_id, id, regexp_extract(k, '^\\[([^\\]]+)\\]\\(([^)]+)\\)$', 1) AS title, regexp_extract(k, '^\\[([^\\]]+)\\]\\(([^)]+)\\)$', 2) AS url FROM e""")
def _web_sources(pastes):
    return surfaces.web_sources(pastes)


@_query("sc4_code_tokens", _N)
def _code(notes):
    from ..operators.code_tokens import quote_code

    return notes.select("doc_id", quote_code(F.col("text")).alias("text"))


_FLOW = "kind IN ('paragraph', 'listItem')"


@_query("cl5_reflow", _N, _KINDS + f""",
 f0 AS (SELECT *, {_FLOW} AS fl, sum(CASE WHEN {_FLOW} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run, regexp_replace(line, '{_W}+$', '') AS solid, {_TRIM.format('line')} AS bare,
  CASE WHEN regexp_matches(line, '^{_W}*[-*+•·‣▪◦–—]{_W}+') THEN '- ' WHEN regexp_matches(line, '^{_W}*[0-9]+[.)]{_W}+') THEN regexp_extract(line, '[0-9]+[.)]') || ' ' END AS mark,
  {_TRIM.format(f"regexp_replace(line, '^{_W}*([-*+•·‣▪◦–—]|[0-9]+[.)]){_W}+', '')")} AS item FROM k),
 f1 AS (SELECT *, bool_or(mark IS NOT NULL) OVER r AS listed, max(len(solid)) OVER r AS width, count(*) OVER r AS size, lag(solid) OVER w AS prev, lead(i) OVER w IS NULL AS z FROM f0 WINDOW r AS (PARTITION BY doc_id, run, fl), w AS (PARTITION BY doc_id, run, fl ORDER BY i)),
 f2 AS (SELECT *, CASE WHEN prev IS NULL THEN true WHEN listed THEN mark IS NOT NULL ELSE NOT regexp_matches(prev, '[A-Za-z]-$') AND (regexp_matches(prev, '[.!?:][)"''’”\\]]*$') OR len(prev) + 1 + len(regexp_extract(bare, '^[^ \\t\\n\\f\\r\\x0b]*')) <= width * 0.66::DOUBLE) END AS begins FROM f1),
 f3 AS (SELECT *, CASE WHEN begins AND mark IS NOT NULL THEN item ELSE bare END AS piece FROM f2),
 f4 AS (SELECT *, lag(piece) OVER w AS above, coalesce(bool_or(mark IS NOT NULL) OVER (PARTITION BY doc_id, run, fl ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS tight FROM f3 WINDOW w AS (PARTITION BY doc_id, run, fl ORDER BY i)),
 f5 AS (SELECT doc_id, i, CASE WHEN NOT fl OR size = 1 THEN line || sep ELSE CASE WHEN prev IS NULL THEN '' WHEN NOT begins THEN CASE WHEN above = '' OR regexp_matches(above, '[A-Za-z]-$') THEN '' ELSE ' ' END WHEN tight THEN chr(10) ELSE chr(10) || chr(10) END
  || CASE WHEN begins THEN coalesce(mark, '') ELSE '' END || piece || CASE WHEN z THEN sep ELSE '' END END AS p FROM f4) """ + _JOINED.format("p", "f5"))
def _reflow(notes):
    return reflow.reflow(notes)


@_query("rg1_lifecycle_state", builders.SCRIPTS, f"""SELECT id, CASE WHEN provenance IS NULL AND in_catalog THEN 'Available' WHEN provenance IS NULL THEN 'Absent' WHEN NOT enabled THEN 'Disabled' WHEN okayed_version IS NULL AND provenance = 'curated' THEN 'Available' WHEN okayed_version IS NULL THEN 'Absent'
 WHEN local_version IS NULL AND online THEN 'Materializing' WHEN local_version IS NULL THEN 'Blocked:offline' WHEN local_version <> okayed_version THEN 'Materializing' WHEN local_checksum <> okayed_checksum THEN 'Blocked:drift' WHEN provenance = 'curated' AND catalog_version > okayed_version THEN 'UpdateAvailable' ELSE 'Active' END AS state FROM ({builders.SCRIPTS})""")
def _state(s):
    names = ("provenance", "enabled", "okayed_version", "okayed_checksum", "local_version", "local_checksum", "in_catalog", "catalog_version", "online")
    return s.select("id", registry.lifecycle_state(*map(F.col, names)).alias("state"))


@_query("rg3_checksum", "SELECT page_id, html FROM pages", "SELECT page_id, 'sha256:' || sha256(html) AS checksum FROM pages")
def _checksum(pages):
    return pages.select("page_id", registry.checksum(F.col("html")).alias("checksum"))


@_query("pi8_version_gate", builders.SCRIPTS, f"SELECT id, CASE WHEN regexp_matches(available, '^[0-9]+\\.[0-9]+$') AND regexp_matches(required, '^[0-9]+\\.[0-9]+$') THEN string_split(available, '.')[1]::BIGINT = string_split(required, '.')[1]::BIGINT AND string_split(required, '.')[2]::BIGINT <= string_split(available, '.')[2]::BIGINT ELSE false END AS allowed FROM ({builders.SCRIPTS})")
def _gate(s):
    return s.select("id", registry.version_allows(F.col("available"), F.col("required")).alias("allowed"))


@_query("di1_paste_order", builders.SCRIPTS, f"SELECT id, row_number() OVER (PARTITION BY catalog_version ORDER BY CASE WHEN provenance = 'curated' THEN 0 ELSE 1 END, local_version DESC NULLS LAST, id) AS place FROM ({builders.SCRIPTS})")
def _order(s):
    from pyspark.sql import Window

    return s.select("id", F.row_number().over(Window.partitionBy("catalog_version").orderBy(*registry.paste_order(F.col("provenance"), F.col("local_version"), F.col("id")))).cast("long").alias("place"))


from . import paste_queries  # noqa: E402, F401  (adds its queries)
