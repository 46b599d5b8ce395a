"""The registered queries on pasted answers, formats of whole notes and the script registry, and for each the same result by DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleanup, convert, edits, footnotes, pastes, registry, runner, urls
from ..sources import notes as sources
from ..sources import scratch
from . import builders, format, operations
from .queries import _ATX, _CLEANUP, _DEFS, _FN, _LINKS, _N, _REFS, _TIDY, _TRIM, _W, _chained, _cites_sql, _keys_sql, _lines_sql, _query, _section_sql, _sql

_SOURCE = rf"^\[([0-9]+)\]{_W}+(.+?){_W}+(https?://[^ \t\n\f\r\x0b]+){_W}*$"
_DEF = r"^\[\^[A-Za-z0-9_]+_[A-Za-z0-9_]+\]:" + _W + r"+([^ \t\n\f\r\x0b]+)$"


def _app_sql(pastes_: str) -> str:
    """Tables pb (doc_id, body), pm (doc_id, j, marker, n) and ps (doc_id, id, snippet, title, url) of ``pastes_`` (doc_id, input)."""
    return rf"""al AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(input, chr(10)) AS ls FROM {pastes_})),
 a1 AS (SELECT *, starts_with(line, '## Answer') AS ans, regexp_matches(line, '^(Sources|Citations:|Quellen){_W}*$') AS op FROM al),
 a2 AS (SELECT *, sum(ans::INT) OVER w AS blk, coalesce(last_value(CASE WHEN ans THEN 0 WHEN op THEN 1 WHEN starts_with(line, '## ') THEN 0 END IGNORE NULLS) OVER w, 0) AS md FROM a1 WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
 a3 AS (SELECT *, blk > 0 AND md = 1 AS listed, blk > 0 AND md = 1 AND NOT op AND regexp_matches(line, '{_SOURCE}') AS src FROM a2),
 a4 AS (SELECT *, sum(src::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cnt FROM a3),
 a5 AS (SELECT *, coalesce(last_value(CASE WHEN ans THEN cnt END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS off FROM a4),
 ps AS (SELECT doc_id, cnt::BIGINT AS id, {_TRIM.format(f"regexp_extract(line, '{_SOURCE}', 2)")} AS snippet, snippet AS title, regexp_extract(line, '{_SOURCE}', 3) AS url FROM a5 WHERE src),
 a6 AS (SELECT doc_id, i, blk, off, unnest(ts) AS t, unnest(range(len(ts))) AS j FROM (SELECT *, regexp_extract_all(line, '\[[0-9]+\]|[^\[]+|\[') AS ts FROM a5 WHERE NOT listed)),
 a7 AS (SELECT *, CASE WHEN blk > 0 AND regexp_matches(t, '^\[[0-9]+\]$') THEN t[2:-2]::HUGEINT + off END AS num FROM a6),
 pm AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS j, '[' || num || ']' AS marker, num::BIGINT AS n FROM a7 WHERE num IS NOT NULL),
 a8 AS (SELECT doc_id, i, string_agg(CASE WHEN num IS NOT NULL AND off > 0 THEN '[' || num || ']' ELSE t END, '' ORDER BY j) AS line FROM a7 GROUP BY doc_id, i),
 pb AS (SELECT a5.doc_id, CASE WHEN max(a5.blk) > 0 THEN coalesce(string_agg(CASE WHEN ans AND a5.blk > 1 THEN chr(10) ELSE '' END || coalesce(a8.line, ''), chr(10) ORDER BY a5.i) FILTER (NOT listed), '') ELSE '' END AS body FROM a5 LEFT JOIN a8 ON a8.doc_id = a5.doc_id AND a8.i = a5.i GROUP BY a5.doc_id)"""


def _web_sql(pastes_: str) -> str:
    return rf"""w1 AS (SELECT doc_id, unnest(ks) AS k, unnest(range(len(ks))) + 1 AS j FROM (SELECT doc_id, list_filter(regexp_extract_all(input, '{_LINKS}'), lambda x: x NOT LIKE '!%') AS ks FROM {pastes_})),
 ps AS (SELECT doc_id, j::BIGINT AS id, regexp_extract(k, '^\[([^\]]+)\]\(([^)]+)\)$', 1) AS snippet, snippet AS title, regexp_extract(k, '^\[([^\]]+)\]\(([^)]+)\)$', 2) AS url FROM w1),
 pm AS (SELECT doc_id, j, k AS marker, j::BIGINT AS n FROM w1), pb AS (SELECT doc_id, input AS body FROM {pastes_})"""


def _download_sql(pastes_: str) -> str:
    clean = "input"
    for noise in (r"<img[^>]*/?>", r"<span[^>]*>[\s\S]*?</span>", r"<div[^>]*>[\s\S]*?</div>"):
        clean = f"regexp_replace({clean}, '(?i){noise}', '', 'g')"
    return rf"""d1 AS (SELECT doc_id, unnest(ds) AS d, unnest(range(len(ds))) + 1 AS id FROM (SELECT doc_id, list_filter(list_transform(string_split(input, chr(10)), lambda x: {_TRIM.format('x')}), lambda x: regexp_matches(x, '{_DEF}')) AS ds FROM {pastes_})),
 d2 AS (SELECT doc_id, id, regexp_extract(d, '^\[[^\]]*\]') AS marker, regexp_extract(d, '{_DEF}', 1) AS url FROM d1),
 ps AS (SELECT doc_id, id::BIGINT AS id, CASE WHEN regexp_matches(url, '^[A-Za-z]+://') THEN regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), CASE WHEN url ILIKE 'https:%' THEN ':443$' ELSE ':80$' END, '') ELSE url END AS snippet, snippet AS title, url FROM d2),
 d3 AS (SELECT doc_id, array_to_string(list_filter(string_split(replace({clean}, '⁂', ''), chr(10)), lambda x: NOT regexp_matches({_TRIM.format('x')}, '{_DEF}')), chr(10)) AS prose FROM {pastes_}),
 d4 AS (SELECT doc_id, unnest(ms) AS m, unnest(range(len(ms))) + 1 AS j FROM (SELECT doc_id, regexp_extract_all(prose, '\[\^[A-Za-z0-9_]+_[A-Za-z0-9_]+\]:?') AS ms FROM d3)),
 pm AS (SELECT d4.doc_id, j, m AS marker, max(d2.id)::BIGINT AS n FROM d4 JOIN d2 ON d2.doc_id = d4.doc_id AND d2.marker = m WHERE m NOT LIKE '%:' GROUP BY ALL),
 pb AS (SELECT doc_id, regexp_replace(regexp_replace(prose, '\n{{3,}}', chr(10) || chr(10), 'g'), '{_W}+$', '') || chr(10) AS body FROM d3)"""


def _parsed_sql(fixture: str, tables) -> str:
    return rf"""WITH c AS (SELECT doc_id, text AS input FROM ({fixture})), {tables('c')}
 SELECT doc_id, body, coalesce((SELECT string_agg(marker || n, '' ORDER BY j) FROM pm WHERE pm.doc_id = pb.doc_id), '') AS marks, coalesce((SELECT string_agg(concat_ws(' ', id, title, url), ';' ORDER BY id) FROM ps WHERE ps.doc_id = pb.doc_id), '') AS sources FROM pb"""


def _parsed(p):
    marks = F.array_join(F.transform("inline", lambda m: F.concat(m["marker"], m["n"].cast("string"))), "")
    return p.select("doc_id", "body", marks.alias("marks"), F.array_join(F.transform("sources", lambda s: F.concat_ws(" ", s["id"], s["title"], s["url"])), ";").alias("sources"))


@_query("cp2_app_parse", builders.ANSWERS, _parsed_sql(builders.ANSWERS, _app_sql))
def _app(rows):
    return _parsed(pastes.parse_app(rows))


@_query("cp3_web_parse", builders.PASTES, _parsed_sql(builders.PASTES, _web_sql))
def _web(rows):
    return _parsed(pastes.parse_web(rows))


@_query("cp4_download_parse", builders.DOWNLOADS, _parsed_sql(builders.DOWNLOADS, _download_sql))
def _download(rows):
    return _parsed(pastes.parse_download(rows))


#: By grammar: its parser, when a text has it, its marks as pieces, whether only cited sources count, and a definition.
_GRAMMARS = {
    "app": (_app_sql, rf"len(list_filter(string_split(input, chr(10)), lambda x: regexp_matches(x, '^(Sources|Citations:|Quellen){_W}*$'))) > 0 AND len(list_filter(string_split(input, chr(10)), lambda x: regexp_matches(x, '{_SOURCE}'))) > 0", r"\[[0-9]+\]", True, "'[^' || nid || ']: ' || snippet || chr(10) || '[' || title || '](' || url || ')'"),
    "web": (_web_sql, rf"len(list_filter(string_split(input, chr(10)), lambda x: regexp_matches(x, '^(Sources\b|Citations:|Quellen\b|\[\^[^\]]+\]:)'))) = 0 AND len(list_filter(regexp_extract_all(input, '{_LINKS}'), lambda x: x NOT LIKE '!%')) > 0", r"\[[^\[\]]*\]\([^\[)]*\)", False, "'[^' || nid || ']: [' || title || '](' || url || ')'"),
    "web-download": (_download_sql, f"len(list_filter(string_split(input, chr(10)), lambda x: regexp_matches({_TRIM.format('x')}, '{_DEF}'))) > 0", r"\[\^[A-Za-z0-9_]+\]", True, "'[^' || nid || ']: [' || title || '](' || url || ')'"),
}


def _resolved_sql(grammar: str) -> str:
    parse, fits, _, cited, _ = _GRAMMARS[grammar]
    return rf"""c AS ({builders.INTO_NOTES[grammar]}), ft AS (SELECT * FROM c WHERE {fits}), {parse('ft')},
 ci AS (SELECT * FROM ps {'WHERE EXISTS (SELECT 1 FROM pm WHERE pm.doc_id = ps.doc_id AND pm.n = ps.id)' if cited else ''}),
 {_lines_sql('SELECT doc_id, text FROM ft', '_t')},
 ex AS (SELECT doc_id, i, regexp_extract(line, '^\[\^([0-9]+)\]:', 1)::BIGINT AS id, regexp_extract(coalesce(nl, ''), '^\[[^\]]*\]\(([^)]+)\)', 1) AS url FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nl FROM l_t) WHERE regexp_matches(line, '^\[\^[0-9]+\]:')),
 au AS (SELECT url FROM ci UNION SELECT url FROM ex), {_keys_sql('au')},
 hv AS (SELECT ex.doc_id, key, arg_max(id, i) AS have FROM ex JOIN uk USING (url) GROUP BY ex.doc_id, key), tp AS (SELECT doc_id, max(id) AS top FROM ex GROUP BY doc_id),
 r1 AS (SELECT ci.*, key, min(ci.id) OVER (PARTITION BY ci.doc_id, key) AS fst FROM ci JOIN uk USING (url)),
 r2 AS (SELECT r1.*, have, coalesce(top, 0) AS top FROM r1 LEFT JOIN hv ON hv.doc_id = r1.doc_id AND hv.key = r1.key LEFT JOIN tp ON tp.doc_id = r1.doc_id),
 rs AS (SELECT *, coalesce(have, top + dense_rank() OVER (PARTITION BY doc_id, have IS NULL ORDER BY fst))::BIGINT AS nid, have IS NULL AND fst = id AS fresh FROM r2)"""


def _convert_sql(grammar: str) -> str:
    _, _, mark, _, line = _GRAMMARS[grammar]
    app = grammar == "app"
    fits = "coalesce(lead(t) OVER (PARTITION BY doc_id ORDER BY j), '') NOT LIKE '(%'" if app else "true"
    level = f"regexp_matches(x, '^#{{1,6}}{_W}')"
    return rf"""WITH {_resolved_sql(grammar)},
 m0 AS (SELECT pm.*, row_number() OVER (PARTITION BY pm.doc_id, marker ORDER BY j) AS k FROM pm {'WHERE EXISTS (SELECT 1 FROM rs WHERE rs.doc_id = pm.doc_id AND rs.id = pm.n)' if app else ''}),
 b1 AS (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS j FROM (SELECT doc_id, regexp_extract_all(body, '{mark}|[^\[]+|\[') AS ts FROM pb)),
 b2 AS (SELECT *, regexp_matches(t, '^{mark}$') AND {fits} AS is_mark FROM b1),
 b3 AS (SELECT *, CASE WHEN is_mark THEN row_number() OVER (PARTITION BY doc_id, t, is_mark ORDER BY j) END AS k FROM b2),
 b4 AS (SELECT b3.doc_id, string_agg(CASE WHEN m0.n IS NOT NULL THEN '[^' || m0.n || ']' ELSE t END, '' ORDER BY b3.j) AS body FROM b3 LEFT JOIN m0 ON m0.doc_id = b3.doc_id AND m0.marker = b3.t AND m0.k = b3.k GROUP BY b3.doc_id),
 b5 AS (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS j FROM (SELECT doc_id, regexp_extract_all(body, '\[\^[0-9]+\]|[^\[]+|\[') AS ts FROM b4)),
 b6 AS (SELECT b5.doc_id, string_agg(CASE WHEN nid IS NOT NULL THEN '[^' || nid || ']' ELSE t END, '' ORDER BY j) AS body FROM b5 LEFT JOIN rs ON rs.doc_id = b5.doc_id AND rs.id = CASE WHEN regexp_matches(t, '^\[\^[0-9]+\]$') THEN t[3:-2]::HUGEINT END GROUP BY b5.doc_id),
 g1 AS (SELECT ft.*, coalesce(b6.body, '') AS body FROM ft LEFT JOIN b6 USING (doc_id)),
 g2 AS (SELECT *, list_transform(list_filter(string_split(substr(text, 1, cursor), chr(10)), lambda x: {level}), lambda x: len(regexp_extract(x, '^#+')))[-1] + 1 - list_min(list_transform(list_filter(string_split(body, chr(10)), lambda x: {level}), lambda x: len(regexp_extract(x, '^#+')))) AS shift, string_split(body, chr(10)) AS ls FROM g1),
 g3 AS (SELECT *, CASE WHEN shift IS NULL THEN body ELSE array_to_string(list_transform(ls, lambda x, i: CASE WHEN regexp_matches(x, '^#{{1,6}}({_W}|$)') AND (i < len(ls) OR {level}) THEN repeat('#', least(6, greatest(1, len(regexp_extract(x, '^#+')) + shift))::INT) || substr(x, len(regexp_extract(x, '^#+')) + 1) ELSE x END), chr(10)) END AS put FROM g2),
 dl AS (SELECT doc_id, string_agg({line}, {"chr(10) || chr(10)" if app else "chr(10)"} ORDER BY nid) AS defs FROM rs WHERE fresh GROUP BY doc_id),
 {_section_sql('_t')},
 en AS (SELECT sc_t.doc_id, coalesce((SELECT sum(len(line) + 1) FROM l_t WHERE l_t.doc_id = sc_t.doc_id AND l_t.i < sc_t.z), (SELECT len(text) FROM ft WHERE ft.doc_id = sc_t.doc_id))::BIGINT AS spot FROM sc_t),
 g4 AS (SELECT g3.*, CASE WHEN defs IS NULL THEN '' WHEN en.spot IS NULL THEN chr(10) || '## Resources' || chr(10) || chr(10) || defs ELSE chr(10) || defs || chr(10) END AS more, coalesce(en.spot, len(text)) AS spot FROM g3 LEFT JOIN dl USING (doc_id) LEFT JOIN en USING (doc_id))
 SELECT doc_id, (put <> '')::BIGINT + (more <> '')::BIGINT AS n_edits, substr(text, 1, cursor) || put || substr(text, cursor + 1, spot - cursor) || more || substr(text, spot + 1) AS text FROM g4"""


def _converts(grammar: str):
    return lambda rows: convert.convert(rows, grammar).select("doc_id", F.size("plan").cast("long").alias("n_edits"), "text")


for _name, _grammar in (("sc1_app", "app"), ("sc2_web", "web"), ("sc3_web_download", "web-download")):
    _query(_name, builders.INTO_NOTES[_grammar], _convert_sql(_grammar))(_converts(_grammar))


def _identity_of(grammar: str):
    def run(rows):
        fits, parse, _, cited, _ = convert.GRAMMARS[grammar]
        rows = rows.where(fits(F.col("input")))
        parsed = parse(rows.select("doc_id", F.col("input").alias("text")))
        parsed = parsed.withColumn("sources", pastes.cited(F.col("sources"), F.col("inline"))) if cited else parsed
        return convert.paste_identity(parsed, rows.select("doc_id", "text")).select("doc_id", "incoming_id", "id", "is_new")

    return run


_query("fn5_resolve", builders.INTO_NOTES["web"], f"WITH {_resolved_sql('web')} SELECT doc_id, id AS incoming_id, nid AS id, fresh AS is_new FROM rs")(_identity_of("web"))
_query("pi7_paste_identity", builders.INTO_NOTES["app"], f"WITH {_resolved_sql('app')} SELECT doc_id, id AS incoming_id, nid AS id, fresh AS is_new FROM rs")(_identity_of("app"))


@_query("cp5_cited", builders.DOWNLOADS, f"WITH c AS (SELECT doc_id, text AS input FROM ({builders.DOWNLOADS})), {_download_sql('c')} SELECT doc_id, id, url FROM ps WHERE EXISTS (SELECT 1 FROM pm WHERE pm.doc_id = ps.doc_id AND pm.n = ps.id)")
def _cited(rows):
    p = pastes.parse_download(rows)
    return p.select("doc_id", F.explode(pastes.cited(F.col("sources"), F.col("inline"))).alias("s")).select("doc_id", "s.id", "s.url")


_PIECES = r"regexp_extract_all(text, '\[\^[0-9]+\]|[^\[]+|\[')"


@_query("fn6_rename", _FN, f"SELECT doc_id, array_to_string(list_transform({_PIECES}, lambda t: CASE t WHEN '[^1]' THEN '[^12]' WHEN '[^2]' THEN '[^7]' WHEN '[^12]' THEN '[^1]' ELSE t END), '') AS text FROM ({_FN})")
def _rename(notes):
    ids = F.create_map(*[F.lit(x).cast("bigint") for x in (1, 12, 2, 7, 12, 1)])
    return notes.select("doc_id", footnotes.renamed(F.col("text"), ids).alias("text"))


@_query("fn8_definitions", "SELECT page_id, url FROM pages", "SELECT page_id, '[^' || page_id || ']: a page' || chr(10) || '[' || url || '](' || url || ')' AS two, '[^' || page_id || ']: [' || url || '](' || url || ')' AS one FROM pages")
def _formats(pages):
    number, url = F.col("page_id"), F.col("url")
    return pages.select("page_id", footnotes.two_line(number, F.lit("a page"), url, url).alias("two"), footnotes.compact(number, url, url).alias("one"))


@_query("fn9_move_to_resources", _FN, rf"""WITH {_lines_sql(_FN)}, {_section_sql()}, d AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '[^1]: a' || chr(10) || '[^01]: b' ELSE '[^1]: a' || chr(10) || '[t](u)' || chr(10) || chr(10) || '[^1]: c' END AS b FROM n),
 en AS (SELECT sc.doc_id, (SELECT sum(len(line) + 1) FROM l WHERE l.doc_id = sc.doc_id AND l.i < sc.z) AS spot, true AS have FROM sc)
 SELECT d.doc_id, coalesce(spot, len(text))::BIGINT AS edit_at, CASE WHEN have THEN chr(10) || b || chr(10) ELSE chr(10) || '## Resources' || chr(10) || chr(10) || b END AS insert, CASE doc_id % 3 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS n_defs FROM d LEFT JOIN en USING (doc_id) WHERE b IS NOT NULL""")
def _to_resources(notes):
    defs = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 1, F.array(F.lit("[^1]: a"), F.lit("[^01]: b"))).otherwise(F.array(F.lit("[^1]: a\n[t](u)"), F.lit("[^1]: c")))
    plan = footnotes.move_to_resources(notes.withColumn("defs", defs)).where(F.size("plan") > 0)
    return plan.select("doc_id", F.col("plan")[0]["from"].cast("long").alias("edit_at"), F.col("plan")[0]["insert"].alias("insert"), footnotes.count_definitions(F.col("plan")).alias("n_defs"))


@_query("st3_mask_code", _N, f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '`[^`]*`|[^`]+|`'), lambda x: CASE WHEN x LIKE '`%`' AND len(x) > 1 THEN '`' || repeat('#', len(x) - 2) || '`' ELSE x END), '') AS text FROM ({_N})")
def _mask(notes):
    return notes.select("doc_id", cleanup.mask_inline_code(F.col("text"), "#").alias("text"))


@_query("st5_atx_headings", _N, f"WITH {_lines_sql(_N)} SELECT doc_id, i AS line_no, len(regexp_extract(line, '{_ATX}', 1))::BIGINT AS level, regexp_extract(line, '{_ATX}', 2) AS title FROM l WHERE regexp_matches(line, '{_ATX}')")
def _atx(notes):
    from ..operators import lines

    rows = lines.lines(notes).withColumn("h", footnotes.atx(F.col("line"))).where("h is not null")
    return rows.select("doc_id", "line_no", "h.level", F.col("h.text").alias("title"))


@_query("st6_note_footnotes", _FN, rf"""WITH {_DEFS}, {_REFS}, {_section_sql()}, {_cites_sql(_FN, '_c')}
 SELECT doc_id, 'definition' AS what, line_no, 1::BIGINT AS ord, id, CASE WHEN two THEN regexp_extract(nl, '^\[([^\]]*)\]\(([^)]+)\)$', 1) END AS title, CASE WHEN two THEN regexp_extract(nl, '^\[([^\]]*)\]\(([^)]+)\)$', 2) END AS url FROM df
 UNION ALL SELECT doc_id, 'reference', i, row_number() OVER (PARTITION BY doc_id, i ORDER BY j), id, NULL, NULL FROM rf
 UNION ALL SELECT doc_id, 'citation', i, row_number() OVER (PARTITION BY doc_id, i ORDER BY j), t[2:-2], NULL, NULL FROM ck_c WHERE cite
 UNION ALL SELECT doc_id, 'section', a, 1, NULL, 'Resources', NULL FROM sc""")
def _everything(notes):
    return footnotes.note_footnotes(notes)


_HALF = "length(text) // 2"


@_query("he3_cascade_or_insert", _N, rf"""WITH m AS (SELECT doc_id, text, substr(text, 1, {_HALF}) AS a, substr(text, {_HALF} + 1) AS b FROM ({_N})),
 x AS (SELECT *, list_transform(list_filter(string_split(a, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}}{_W}')), lambda x: len(regexp_extract(x, '^#+')))[-1] + 1 - list_min(list_transform(list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}}{_W}')), lambda x: len(regexp_extract(x, '^#+')))) AS shift, string_split(b, chr(10)) AS ls FROM m),
 y AS (SELECT *, CASE WHEN shift IS NULL THEN b ELSE array_to_string(list_transform(ls, lambda x, i: CASE WHEN regexp_matches(x, '^#{{1,6}}({_W}|$)') AND (i < len(ls) OR regexp_matches(x, '^#{{1,6}}{_W}')) THEN repeat('#', least(6, greatest(1, len(regexp_extract(x, '^#+')) + shift))::INT) || substr(x, len(regexp_extract(x, '^#+')) + 1) ELSE x END), chr(10)) END AS put FROM x)
 SELECT doc_id, len(a)::BIGINT AS edit_from, CASE WHEN doc_id % 2 = 0 THEN len(text) ELSE len(a) END::BIGINT AS edit_to, put AS insert, len(a) + len(put) AS cursor FROM y WHERE b <> ''""")
def _cascade_or_insert(notes):
    half = F.floor(F.length("text") / 2).cast("int")
    # The plan names its columns many times; as a table they are computed once.
    rows = scratch.written(notes).select("doc_id", "text", half.alias("cursor"), F.substr(F.col("text"), half + 1, F.length("text")).alias("input"), F.when(F.col("doc_id") % 2 == 0, F.length("text")).alias("end"))
    plan = cleanup.cascade_or_insert(F.col("text"), F.col("cursor"), F.col("input"), F.col("cursor"), F.col("end"))
    e = F.get("plan", F.lit(0))
    rows = scratch.written(rows.withColumn("plan", plan)).where(F.size("plan") > 0)
    return rows.select("doc_id", e["from"].cast("long").alias("edit_from"), e["to"].cast("long").alias("edit_to"), e["insert"].alias("insert"), sources.cursor_after(F.col("plan")).cast("long").alias("cursor"))


@_query("pi4_paste_and_format", _N, f"WITH RECURSIVE {_chained(f'SELECT doc_id, chr(10) || text AS text FROM ({_N})', *_CLEANUP)[0]} SELECT doc_id, regexp_replace(text, '^\n', '') AS text FROM out_{len(_CLEANUP) - 1}")
def _paste_format(rows):
    return format.paste_and_format(rows)


#: Notes with a selection in every second one: 80 characters from the 40th on.
_SELECTED = f"SELECT doc_id, text, 40 AS cursor, CASE WHEN doc_id % 2 = 0 THEN 40 END AS sel_from, CASE WHEN doc_id % 2 = 0 THEN 120 END AS sel_to, CASE WHEN doc_id % 2 = 0 THEN substr(text, 41, 80) END AS input FROM ({_FN})"
_CLEANED, _CLEAN = _chained(f"SELECT doc_id, text FROM ({_SELECTED})", *_CLEANUP, x="_f")
_SHIFTED = rf"""SELECT doc_id, CASE WHEN shift IS NULL OR sel_from IS NULL THEN text ELSE substr(text, 1, sel_from) || array_to_string(list_transform(ls, lambda x, i: CASE WHEN regexp_matches(x, '^#{{1,6}}({_W}|$)') AND (i < len(ls) OR regexp_matches(x, '^#{{1,6}}{_W}')) THEN repeat('#', least(6, greatest(1, len(regexp_extract(x, '^#+')) + shift))::INT) || substr(x, len(regexp_extract(x, '^#+')) + 1) ELSE x END), chr(10)) || substr(text, sel_to + 1) END AS text FROM sh"""
_TIDIED, _LAST = _chained(_SHIFTED, *_TIDY, x="_g")


@_query("pi3_format_selection", _SELECTED, rf"""WITH RECURSIVE {_CLEANED}, se AS ({_SELECTED}),
 sh AS (SELECT o.doc_id, o.text, sel_from, sel_to, string_split(coalesce(input, ''), chr(10)) AS ls, list_transform(list_filter(string_split(substr(o.text, 1, cursor), chr(10)), lambda x: regexp_matches(x, '^#{{1,6}}{_W}')), lambda x: len(regexp_extract(x, '^#+')))[-1] + 1 - list_min(list_transform(list_filter(string_split(coalesce(input, ''), chr(10)), lambda x: regexp_matches(x, '^#{{1,6}}{_W}')), lambda x: len(regexp_extract(x, '^#+')))) AS shift FROM ({_CLEAN}) o JOIN se USING (doc_id)),
 {_TIDIED} SELECT o.doc_id, (o.text <> se.text)::BIGINT AS n_edits, o.text FROM ({_LAST}) o JOIN se USING (doc_id)""")
def _format_selection(notes):
    return format.format_selection(notes).select("doc_id", F.size("plan").cast("long").alias("n_edits"), "text")


@_query("di2_paste_and_run", builders.INTO_NOTES["web"], rf"""WITH c AS ({builders.INTO_NOTES['web']}) SELECT doc_id, CASE WHEN {_GRAMMARS['app'][1]} THEN 'app' WHEN {_GRAMMARS['web-download'][1]} THEN 'web-download' WHEN {_GRAMMARS['web'][1]} THEN 'web' ELSE 'raw' END AS handler,
 CASE WHEN handler = 'raw' THEN substr(text, 1, cursor) || input || substr(text, cursor + 1) END AS raw FROM c""")
def _run(rows):
    return operations.paste_and_run(rows).select("doc_id", "handler", F.when(F.col("handler") == "raw", F.col("text")).alias("raw"))


_CONTENT = "'c' || CAST(p_size % 5 AS VARCHAR(9))"
_CALLS = rf"""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'imported' ELSE 'curated' END AS provenance, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 2 END AS okayed_version, 'c' || CAST(p_size % 4 AS VARCHAR(9)) AS okayed, p_partkey % 7 <> 0 AS reachable,
 CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 2 + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END END AS entry_version, 'c' || CAST((p_size + CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END) % 4 AS VARCHAR(9)) AS entry, CASE WHEN p_partkey % 19 <> 0 THEN 'c' || CAST((p_size + CASE WHEN p_partkey % 23 = 0 THEN 1 ELSE 0 END) % 4 AS VARCHAR(9)) END AS content, p_size % 2 = 0 AS enabled, p_name AS name FROM part"""


@_query("rg2_materialize", _CALLS, rf"""SELECT id, CASE WHEN okayed_version IS NULL THEN 'drift' WHEN provenance = 'curated' THEN CASE WHEN NOT reachable THEN 'offline' WHEN entry_version IS NULL THEN 'source-missing' WHEN content IS NULL THEN 'offline' WHEN content <> entry THEN 'checksum-mismatch' WHEN entry_version <> okayed_version OR content <> okayed THEN 'drift' END
 ELSE CASE WHEN content IS NULL THEN 'source-missing' WHEN content <> okayed THEN 'drift' END END AS reason FROM ({_CALLS})""")
def _materialize(rows):
    check = lambda c: registry.checksum(F.col(c))
    return rows.select("id", registry.materialize(F.col("provenance"), F.col("okayed_version"), check("okayed"), F.col("reachable"), F.col("entry_version"), check("entry"), F.col("content")).alias("reason"))


@_query("rg10_consent", _CALLS, f"SELECT id, CASE WHEN NOT enabled THEN 'disable' WHEN okayed_version = 1 AND okayed = content THEN 'enable-session' ELSE 'ask' END AS decision FROM ({_CALLS})")
def _consent(rows):
    return rows.select("id", registry.consent(F.col("enabled"), F.col("okayed_version"), F.col("okayed"), F.lit(1), F.col("content")).alias("decision"))


@_query("rg7_description", "SELECT p_partkey AS id, p_name AS name FROM part", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS description FROM part")
def _description(rows):
    source = F.concat(F.lit("run()\n"), F.when(F.col("id") % 3 == 1, F.lit("  // Description: ")).when(F.col("id") % 3 == 2, F.lit("//DESCRIPTION:")).otherwise(F.lit("/* description: ")), "name", F.lit(" \n// description: other"))
    source = F.when(F.col("id") % 3 == 0, F.lit("no // description: here")).otherwise(source)
    return rows.select("id", registry.description(source).alias("description"))


@_query("rg4_resolved_states", builders.SCRIPTS, rf"""WITH s AS (SELECT id, coalesce(provenance, 'curated') AS provenance, coalesce(enabled, false) AS enabled, CASE WHEN okayed_version IS NOT NULL AND okayed_checksum IS NOT NULL THEN okayed_version END AS ov, okayed_checksum AS oc, provenance IS NULL AS lost, in_catalog, catalog_version, local_version, local_checksum FROM ({builders.SCRIPTS})),
 r AS (SELECT *, CASE WHEN local_checksum IS NULL THEN NULL ELSE coalesce(CASE WHEN id % 2 = 0 THEN local_version END, ov, 0) END AS lv FROM s WHERE NOT lost),
 a AS (SELECT id, CASE WHEN NOT enabled THEN 'Disabled' WHEN ov IS NULL THEN CASE provenance WHEN 'curated' THEN 'Available' ELSE 'Absent' END WHEN lv IS NULL THEN 'Materializing' WHEN lv <> ov THEN 'Materializing' WHEN local_checksum <> oc THEN 'Blocked:drift' WHEN provenance = 'curated' AND in_catalog AND catalog_version > ov THEN 'UpdateAvailable' ELSE 'Active' END AS state FROM r
  UNION ALL SELECT id, 'Available' FROM s WHERE lost AND in_catalog)
 SELECT id, state, CASE state WHEN 'Disabled' THEN '"' || id || '" is disabled' WHEN 'Blocked:drift' THEN '"' || id || '" is blocked (drift)' WHEN 'Materializing' THEN '"' || id || '" is not ready yet' WHEN 'UpdateAvailable' THEN '"' || id || '" has an update: update it to run it' WHEN 'Active' THEN NULL ELSE '"' || id || '" is not active' END AS notice FROM a""")
def _resolved(rows):
    stored = registry.with_defaults(rows.where("provenance is not null").select("id", "provenance", "enabled", "okayed_version", F.when(F.col("okayed_checksum").isNotNull(), registry.checksum(F.col("okayed_checksum"))).alias("okayed_checksum")))
    catalog = rows.where("in_catalog").select("id", F.col("catalog_version").alias("version"))
    local = rows.where("local_checksum is not null").select("id", F.col("local_checksum").alias("content"))
    out = registry.resolved(stored, catalog, local, rows.where("id % 2 = 0 and local_version is not null").select("id", F.col("local_version").alias("version")))
    return out.select("id", "state", registry.state_notice(F.col("state"), F.col("id").cast("string")).alias("notice"))


@_query("rg12_import_paths", "SELECT page_id, url FROM pages", r"SELECT page_id, page_id % 4 = 0 OR page_id % 4 = 3 AS allowed, regexp_replace(regexp_extract(url, '[^/\\]*$'), '(?i)\.cjs$', '') AS id FROM pages")
def _imports(pages):
    path = F.when(F.col("page_id") % 4 == 0, F.lit("a/..b/x.CJS")).when(F.col("page_id") % 4 == 1, F.lit("/a/x.cjs")).when(F.col("page_id") % 4 == 2, F.lit("a\\..\\x")).otherwise(F.lit("x..cjs"))
    return pages.select("page_id", registry.is_inside(path).alias("allowed"), registry.script_id(F.col("url")).alias("id"))


#: Texts cut in two: the second half is put in behind the first by a script that fails on some, has nothing to do for others, and may not run on others.
_RUNS = """SELECT doc_id, substr(text, 1, CAST(floor(length(text) / 2) AS INT)) AS text, CAST(floor(length(text) / 2) AS INT) - 1 AS cursor, substr(text, CAST(floor(length(text) / 2) AS INT) + 1) AS input,
 CASE doc_id % 6 WHEN 0 THEN 'disabled' WHEN 1 THEN 'ask' WHEN 2 THEN 'ask' ELSE 'enabled' END AS policy, CASE doc_id % 18 WHEN 1 THEN 'enable-once' WHEN 2 THEN 'disable' WHEN 7 THEN 'enable-session' END AS decision FROM documents"""


def _quoting(text: str, cursor: int, given: str):
    if len(given) % 5 == 0:
        raise ValueError(f"no rule for {len(given)}")
    if len(given) % 5 < 3:
        return None if len(given) % 5 == 1 else []
    return [(cursor, cursor, f"«{given}»"), (0, 0, "> ")]


@_query("rg6_runner", _RUNS, rf"""WITH c AS (SELECT *, len(input) % 5 AS m, greatest(0, least(cursor, len(text))) AS pos, policy = 'enabled' OR policy = 'ask' AND coalesce(decision <> 'disable', false) AS goes FROM ({_RUNS}))
 SELECT doc_id, CASE WHEN NOT goes THEN 'blocked' WHEN m = 0 THEN 'failed' WHEN m < 3 THEN 'noop' ELSE 'applied' END AS kind, CASE WHEN goes AND m = 0 THEN 'script failed: no rule for ' || len(input) END AS said, CASE WHEN goes AND m > 2 THEN 2 ELSE 0 END::BIGINT AS n,
 CASE WHEN NOT goes OR m IN (1, 2) THEN text WHEN m = 0 THEN substr(text, 1, pos) || input || substr(text, pos + 1) WHEN pos = 0 THEN '«' || input || '»> ' || text ELSE '> ' || substr(text, 1, pos) || '«' || input || '»' || substr(text, pos + 1) END AS text FROM c""")
def _runner(rows):
    done = runner.run(rows, _quoting, F.col("policy"), F.col("decision"))
    return done.select("doc_id", "kind", runner.notice(F.col("kind"), F.col("reason")).alias("said"), F.size("plan").cast("long").alias("n"), "text")
