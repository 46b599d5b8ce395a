"""Character classes and regular expressions with the meaning they have for the notes' original engine (JavaScript), written for Java."""

#: White space: fixed values of the ECMAScript class, which Java's \\s is not.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The characters of that class.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Any character but line ends of ECMAScript.
DOT = r"[^\n\r\u2028\u2029]"

FENCE = rf"^{WS}{{0,3}}(`{{3,}}|~{{3,}})"
ATX = rf"^#{{1,6}}({WS}|\z)"
BLANK = rf"^{WS}*\z"
QUOTE = rf"^{WS}*>"
LIST_ITEM = rf"^{WS}*([-*+•–·]|[0-9]+[.)]) "
TABLE_ROW = rf"^{WS}*[|]"
UNDERLINE = rf"^(=+|-+){WS}*\z"
THEMATIC = rf"^{WS}*([-*_]{WS}*){{3,}}\z"
INDENTED = r"^ {4}"
HEADING = rf"^(#{{1,6}}){WS}"
BULLET = rf"^({WS}*)([-*+•–·])([ \t])"
ORDERED = rf"^({WS}*)([0-9]+)([.)])"
#: Block kinds whose text is left alone.
PROTECTED = ("fencedCode", "indentedCode", "frontmatter")
#: Glyphs and what they become: fixed values.
GLYPHS = {
    "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "æ": "ae", "œ": "oe",
    "“": '"', "”": '"', "‘": "'", "’": "'", "—": "-", "–": "-", "…": "...",
}
