"""Notes, pastes and scripts made of the test tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

_NL = "chr(10)"


def _put(text: str, changes: list[tuple[str, str]]) -> str:
    for needle, sql in changes:
        text = f"replace({text}, '{needle}', {sql})"
    return text


def _s(*parts: str) -> str:
    """Literals and line feeds (given as \\n) put together."""
    out = []
    for p in parts:
        for i, x in enumerate(p.split("\n")):
            out += [_NL] * (i > 0) + ([f"'{x}'"] if x else [])
    return "(" + " || ".join(out) + ")"


_STRUCTURE = [
    (" the ", _s("\n## ")), (" and ", _s("\n* ")), (" of ", _s("\n  3. ")), (" in ", _s("\n\n")), (" to ", _s("\n> ")), (" that ", _s("\n---\n")), (" is ", _s("\n```\n")),
    (" for ", _s("\n===\n")), (" a ", _s("\n1) ")), (" it ", _s("\n    ")), (" was ", _s("\n\n\n\n")), (" de ", _s("-\n")), (" la ", _s("\n\n# ")), (" le ", _s("  ")),
    (" les ", _s("\n- ")), (" en ", _s("\n #### ")), (" der ", _s("\n~~~~\n")), (" die ", _s("\n• ")), (" und ", _s("\n##### ")), (" el ", _s(" \n")), (" que ", _s("\n| ")), (" los ", _s("\n2. ")),
    ("tion", "'ﬁ'"), (" on ", _s(" `co—de` ")), ("ou", "'œ'"), (" er ", _s("—")), (" an", _s("-\nan")), (" ea", _s("   ea")),
]
#: Notes with Markdown structure all over: words of the texts become marks.
NOTES = f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN {_s('---', chr(10), 'title: x', chr(10), '---', chr(10))} WHEN 1 THEN {_s('```js', chr(10), 'x', chr(10), '``', chr(10), '````', chr(10))} ELSE '' END || {_put('text', _STRUCTURE)} AS text FROM documents"

_MARKS = [
    (" the ", _s(" [2] ")), (" and ", _s("[^3] ")), (" of ", _s("\n[^3]: a note\n[t](https://ex.com/a/?b=1&a=2)\n")), (" in ", _s(" [^1] ")), (" to ", _s("\n[^1]: one\n")), (" that ", _s("\n[^x]: alpha\n")),
    (" is ", _s("[007]")), (" for ", _s("\n[^12]: twelve\n[u](HTTPS://EX.com:443/a?a=2&b=1#f)\n")), (" a ", _s("[^12]")), (" it ", _s(" [5](u) ")), (" was ", _s("\n## Resources\n")), (" de ", _s(" [4] ")), (" la ", _s("[^7]")),
    (" les ", _s("\n# Head\n")), (" der ", _s("\n### Resources\n")), (" die ", _s("\n[^7]: seven\n")), (" und ", _s("[^x]")), (" que ", _s("\n[^2]:no space\n")), (" el ", _s("[^2]: ")),
]
#: Notes with citations, references, definitions and sections.
FOOTNOTES = f"SELECT doc_id, {_put('text', _MARKS)} AS text FROM documents"

_PASTE = f"""CASE (conv_id + turn) % 5
 WHEN 0 THEN text || {_s(chr(10), 'Sources', chr(10), '[1] A title https://ex.com/', chr(10))}
 WHEN 1 THEN {_put('text', [(' the ', _s(' [the](https://ex.com/t) ')), (' an', _s(' ![an](img.png) [host](http://h.org)'))])}
 WHEN 2 THEN text || {_s(chr(10), '  [^1_2]: https://ex.org/x  ')}
 WHEN 3 THEN {_s('Sources: none', chr(10))} || {_put('text', [(' the ', _s(' [the](https://ex.com/t) '))])}
 ELSE text END"""
#: Pasted answers in the three grammars, and plain texts.
PASTES = f"SELECT conv_id * 1000 + turn AS doc_id, {_PASTE} AS text FROM conversations"

_ANSWER = f"""{_s('pre', chr(10))} || CASE WHEN (conv_id + turn) % 5 = 0 THEN '' ELSE {_s('pre [1] [^2]', chr(10), '## Answer', chr(10))} || {_put('text', [(' the ', _s(' [1] ')), (' an', _s(' [02][x] an')), (' of ', _s(chr(10), '### Part', chr(10))), (' in ', _s(' [7](u) '))])}
 || {_s(chr(10), 'Sources', chr(10), '[1] A title https://ex.com/ ', chr(10), 'lost', chr(10), '[7] B  https://b.org', chr(10))} || CASE turn % 3 WHEN 0 THEN '' ELSE {_s('## Answer two', chr(10), 'again [1] [03]', chr(10), 'Quellen ', chr(10), '[1] C https://c.org/x', chr(10), '[2] D HTTPS://EX.com:443', chr(10), '## Tail', chr(10), 'end')} END END"""
#: Pasted answers of one or two blocks with sources each; every fifth without an answer.
ANSWERS = f"SELECT conv_id * 1000 + turn AS doc_id, {_ANSWER} AS text FROM conversations"

_DOWNLOAD = f"""{_s('<IMG src="x"/>')} || {_put('text', [(' the ', _s(' [^1_1] ')), (' an', _s('<span style="a">[^1_2]', chr(10), '</span> an[^9_9]')), (' of ', _s(chr(10), chr(10), chr(10), chr(10), '## Of', chr(10)))])} || CASE turn % 3 WHEN 0 THEN ' [^1_2] [^1_1]:' ELSE '' END
 || {_s(chr(10), '<div>⁂</div>', chr(10), chr(10), '  [^1_1]: https://WWW.Ex.com:443/a', chr(10))} || CASE turn % 4 WHEN 0 THEN {_s('[^1_2]: plain', chr(10), chr(10))} WHEN 1 THEN {_s('[^1_2]: http://h.org/?q=1', chr(10), '[^1_3]: http://x.y', chr(10))} ELSE {_s('tail ', chr(10))} END"""
#: Downloaded answers with tags, marks and definitions.
DOWNLOADS = f"SELECT conv_id * 1000 + turn AS doc_id, {_DOWNLOAD} AS text FROM conversations"

_NOTE = f"""CASE conv_id % 7 WHEN 0 THEN {_s('plain', chr(10))} ELSE {_s('# Top', chr(10), 'see [^3]', chr(10))} || CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN {_s('## Resources', chr(10), '[^3]: old', chr(10), '[t](https://b.org/)', chr(10))}
 ELSE {_s('### Deep', chr(10), '[^4]: x', chr(10), '[u](https://ex.com/)', chr(10), '[^9]: none', chr(10), '## Resources', chr(10), chr(10), '# Next', chr(10))} END END"""


def _into_notes(paste: str) -> str:
    return f"SELECT conv_id * 1000 + turn AS doc_id, {_NOTE} AS text, CASE WHEN conv_id % 7 = 0 THEN 0 ELSE 15 END AS cursor, {paste} AS input FROM conversations"


#: Notes with a cursor into which answers of each grammar are pasted: with headings or without, with definitions and a section for them or without.
INTO_NOTES = {"app": _into_notes(_ANSWER), "web": _into_notes(_PASTE), "web-download": _into_notes(_DOWNLOAD)}

#: URLs of pages in several spellings.
URLS = """SELECT page_id AS doc_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN upper(substr(url, 1, 12)) || substr(url, 13) WHEN 2 THEN ' ' || url || '?z=1&b=2&a&b=1'
 WHEN 3 THEN replace(url, 'example', 'me:pw@example') || '/#top' WHEN 4 THEN 'mailto:' || upper(url) ELSE url || ':80/' END AS url FROM pages"""

#: Hosts that are 32-bit numbers (v) in six spellings, and names.
HOSTS = """SELECT page_id AS doc_id, v, CASE page_id % 8 WHEN 0 THEN CAST(v AS VARCHAR(20)) WHEN 1 THEN '0X' || hex(v) WHEN 2 THEN '0x' || hex(CAST(floor(v / 16777216) AS BIGINT)) || '.' || CAST(v % 16777216 AS VARCHAR(20))
 WHEN 3 THEN '000' || CAST(CAST(floor(v / 16777216) AS BIGINT) % 8 AS VARCHAR(20)) || '.' || CAST(CAST(floor(v / 65536) AS BIGINT) % 256 AS VARCHAR(20)) || '.0x' || hex(v % 65536) WHEN 4 THEN CAST(v + 4294967296 AS VARCHAR(20)) WHEN 5 THEN 'a%2d' || CAST(v AS VARCHAR(20)) || '.Ex'
 WHEN 6 THEN '[0:' || lower(hex(v % 65535 + 1)) || ':0:0:00' || '1:0:0:0]' ELSE '1.2.3.' || CAST(v % 512 AS VARCHAR(20)) END AS host FROM (SELECT page_id, (page_id * 2654435761) % 4294967296 AS v FROM pages)"""

#: Texts with characters of two units, and two places in them that are counted in units.
WIDE = """SELECT doc_id, t AS text, CASE WHEN doc_id % 9 <> 0 THEN CAST(floor(length(t) / 3) AS BIGINT) END AS anchor, CAST(floor(length(t) / (1 + doc_id % 3)) AS BIGINT) AS head
 FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text ELSE replace(replace(text, 'e', '😀'), 'o', 'é') END AS t FROM documents) AS w"""

#: Scripts in all combinations of what decides on their state.
SCRIPTS = """SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'imported' ELSE 'curated' END AS provenance, p_size % 5 <> 0 AS enabled,
 CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 3 END AS okayed_version, CASE WHEN p_partkey % 11 <> 0 THEN 'c' || CAST(p_size % 4 AS VARCHAR(9)) END AS okayed_checksum,
 CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey + p_size % 2) % 3 END AS local_version, CASE WHEN p_partkey % 13 <> 0 THEN 'c' || CAST((p_size % 4 + CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END) AS VARCHAR(9)) END AS local_checksum,
 p_size % 2 = 0 AS in_catalog, CASE WHEN p_size % 2 = 0 THEN p_partkey % 4 END AS catalog_version, p_size % 3 <> 0 AS online,
 CAST(p_size % 3 AS VARCHAR(9)) || CASE WHEN p_size % 19 = 0 THEN '' ELSE '.' END || CAST(p_partkey % 5 AS VARCHAR(9)) AS available, CAST(p_partkey % 3 AS VARCHAR(9)) || '.' || CAST(p_size % 4 AS VARCHAR(9)) AS required, p_name AS name FROM part"""

#: Captioned frames of two to four logical rows and two or three columns in four styles, some ragged or indented, with text close behind them or not.
FRAMES = f"""SELECT c_custkey AS doc_id, translate({_s('cap', chr(10))} || CASE WHEN c_custkey % 7 = 0 THEN chr(10) ELSE '' END || {_s('┌──┬──┐', chr(10), '│ ')} || c_name || ' │ ' || c_mktsegment || CASE WHEN c_custkey % 11 = 0 THEN ' │ third' ELSE '' END || {_s(' │', chr(10), '├──┼──┤', chr(10), '│ k')} || CAST(c_nationkey AS VARCHAR(9)) || ' │ x|y │' || CASE WHEN c_custkey % 5 = 0 THEN ' z │' ELSE '' END || CASE WHEN c_custkey % 11 = 0 THEN ' w │' ELSE '' END
 || {_s(chr(10), '│  │ m')} || CAST(c_custkey % 7 AS VARCHAR(9)) || CASE WHEN c_custkey % 11 = 0 OR c_custkey % 5 = 0 THEN ' │ ' ELSE '' END || CASE WHEN c_custkey % 55 = 0 THEN ' │ ' ELSE '' END || {_s(' │', chr(10))} || CASE WHEN c_custkey % 2 = 0 THEN {_s('├──┼──┤', chr(10), '│ a │ b ', chr(10), '  free', chr(10))} ELSE '' END || {_s('└──┴──┘')}
 || CASE WHEN c_custkey % 3 = 0 THEN {_s(chr(10), 'end', chr(10))} ELSE '' END, '┌┬┐├┼┤└┴┘─│', CASE c_custkey % 4 WHEN 0 THEN '┌┬┐├┼┤└┴┘─│' WHEN 1 THEN '╔╦╗╠╬╣╚╩╝═║' WHEN 2 THEN '┏┳┓┣╋┫┗┻┛━┃' ELSE '+++++++++-│' END) AS text FROM customer"""
