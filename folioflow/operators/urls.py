"""Canonical forms of URLs, for finding equal sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import functions as js

_URL = r"^(?i:(https?)):[/\\]*([^/\\?#]*)([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?\z"
_HOST = r"^(\[[^\]]*\]|[^:]*)(?::([0-9]*))?\z"
#: What no host name has: fixed values.
_FORBIDDEN = r"[\x00-\x20\x7F#%/:<>?@\[\\\]^|�]"
#: Signs that names leave out, and other forms of the dot: fixed values.
_IGNORED, _DOTS = "[­​⁠﻿︀-️]", "[。｡]"
#: Full-width forms are ASCII's signs, moved; a capital sigma is never a final one.
_NARROW = {**{chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}, "Σ": "σ"}
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: What paths have escaped, beside what isn't ASCII: fixed values.
_ESCAPED = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "`": "%60", "{": "%7B", "}": "%7D", "^": "%5E"}


def _without_dots(path: Column) -> Column:
    """A path without dot segments: two dots take the segment before them away."""
    parts = F.split(path, "/", -1)
    is_dot, is_up = (lambda x, p=p: x.rlike(rf"^(?i:{p})\z") for p in (r"\.|%2e", r"(\.|%2e)(\.|%2e)"))
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), lambda x, i: F.struct(x.alias("x"), (i == F.size(parts) - 2).alias("last")))
    less = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    end = lambda a, last: F.when(last, F.array_append(a, F.lit(""))).otherwise(a)
    kept = F.aggregate(rest, F.array().cast("array<string>"), lambda a, s: F.when(is_up(s["x"]), end(less(a), s["last"])).when(is_dot(s["x"]), end(a, s["last"])).otherwise(F.array_append(a, s["x"])))
    return F.when(path.rlike(r"(?i:/(\.|%2e){1,2}(/|\z))"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def _escaped(path: Column) -> Column:
    for sign, code in _ESCAPED.items():
        path = F.replace(path, F.lit(sign), F.lit(code))
    runs = F.regexp_extract_all(path, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]+"), F.lit(0))
    return F.when(path.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^[^\x00-\x7F]"), F.url_encode(r)).otherwise(r)), "")).otherwise(path)


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _whole(a: Column, b) -> Column:
    """The whole quotient of numbers that aren't negative."""
    return F.floor(a / b).cast("long")


def _digits(delta: Column, bias: Column) -> Column:
    """A number in the generalised variable-length digits of RFC 3492."""

    def step(s: Column, k: Column) -> Column:
        t = F.least(F.greatest(k - bias, F.lit(1)), F.lit(26)).cast("long")
        last, left = s["q"] < t, s["q"] - t
        digit = F.when(last, s["q"]).otherwise(t + left % (36 - t))
        out = F.concat(s["out"], F.substr(F.lit(_DIGITS), (digit + 1).cast("int"), F.lit(1)))
        new = F.struct(F.when(last, F.lit(-1)).otherwise(_whole(left, 36 - t)).cast("long").alias("q"), out.alias("out"))
        return F.when(s["q"] < 0, s).otherwise(new)

    return F.aggregate(F.sequence(F.lit(36), F.lit(36 * 12), F.lit(36)), F.struct(delta.alias("q"), F.lit("").alias("out")), step, lambda s: s["out"])


def _adapted(delta: Column, n: Column, first: Column) -> Column:
    """The bias behind a number: n are the signs placed so far."""
    less = _whole(delta, F.when(first, 700).otherwise(2))
    start = F.struct((less + _whole(less, n)).alias("d"), F.lit(0).cast("long").alias("k"))
    step = lambda s, _: F.when(s["d"] > 455, F.struct(_whole(s["d"], 35).alias("d"), (s["k"] + 36).alias("k"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step, lambda s: s["k"] + _whole(36 * s["d"], s["d"] + 38))


def punycode(label: Column) -> Column:
    """A label as RFC 3492 encodes it, without the prefix. Its signs beyond ASCII are placed in the order of their code points; each is told by how far it is from the one
    before, counted in places of all strings that lie between: code points in between times places, and the places before it."""
    signs = F.transform(F.split(label, ""), lambda x, i: F.struct(F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("long").alias("c"), i.alias("i")))

    def encoded(signs: Column) -> Column:
        plain = F.filter(signs, lambda s: s["c"] < 128)
        head = F.array_join(F.transform(plain, lambda s: F.chr(s["c"])), "")
        # Of each sign beyond ASCII: its code point, how many are placed before it, and how many of these stand before it.
        order = F.array_sort(F.filter(signs, lambda s: s["c"] >= 128))
        earlier = lambda s: F.size(F.filter(signs, lambda o: (o["i"] < s["i"]) & (o["c"] <= s["c"]))).cast("long")
        placed = F.transform(order, lambda s, k: F.struct(s["c"].alias("c"), (F.size(plain) + k).cast("long").alias("n"), earlier(s).alias("at")))

        def step(a: Column, s: Column) -> Column:
            def add(delta: Column) -> Column:
                bias = _adapted(delta, s["n"] + 1, a["first"])
                return F.struct(F.concat(a["out"], _digits(delta, a["bias"])).alias("out"), bias.alias("bias"), s["c"].alias("c"), (s["at"] + 1).alias("at"), F.lit(False).alias("first"))

            return _bound((s["c"] - a["c"]) * (s["n"] + 1) + s["at"] - a["at"], add)

        zero = F.lit(0).cast("long")
        start = F.struct(F.when(F.size(plain) > 0, F.concat(head, F.lit("-"))).otherwise("").alias("out"), F.lit(72).cast("long").alias("bias"), F.lit(128).cast("long").alias("c"), zero.alias("at"), F.lit(True).alias("first"))
        return F.aggregate(placed, start, step, lambda a: a["out"])

    return _bound(signs, encoded)


def _number(part: Column) -> Column:
    """A part of an IPv4 address, decimal, octal (0 before it) or hexadecimal (0x); null for anything else and for more than 11 digits."""
    digits = F.regexp_replace(F.regexp_replace(part, "^0x", ""), "^0+(?=[0-9a-f])", "")
    form = F.when(part.rlike(r"^0x[0-9a-f]*\z"), 16).when(part.rlike(r"^0[0-7]+\z"), 8).when(part.rlike(r"^(0|[1-9][0-9]*)\z"), 10)
    of = lambda base: F.conv(digits, base, 10).cast("long")
    return F.when((form == 16) & (digits == ""), F.lit(0).cast("long")).when(F.length(digits) <= 11, F.when(form == 16, of(16)).when(form == 8, of(8)).when(form == 10, of(10)))


def _ipv4(host: Column) -> Column:
    """The number of an IPv4 address of one to four parts, the last of which stands for all bytes that are left; null if it is none."""

    def value(n: Column) -> Column:
        k = F.size(n)
        fits = F.forall(n, lambda x: x.isNotNull()) & (k <= 4) & F.forall(F.slice(n, F.lit(1), F.greatest(k - 1, F.lit(0))), lambda x: x <= 255) & (F.element_at(n, -1) < F.pow(F.lit(256), 5 - k))
        at = F.transform(n, lambda x, i: F.when(i == k - 1, x).otherwise(x * F.pow(F.lit(256), 3 - i).cast("long")))
        return F.when(fits, F.aggregate(at, F.lit(0).cast("long"), lambda a, x: a + x))

    return _bound(F.transform(F.split(F.regexp_replace(host, r"\.\z", ""), r"\.", -1), _number), value)


def _dotted(address: Column) -> Column:
    return _bound(address, lambda n: F.when(n.isNotNull(), F.array_join(F.array(*[F.shiftright(n, 8 * k).bitwiseAND(F.lit(255)) for k in (3, 2, 1, 0)]), ".")))


def _ipv6(text: Column) -> Column:
    """An IPv6 address with its first longest run of zeros left out; null if it is none."""
    tail = F.regexp_extract(text, r"^.*:((?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!\z)|\z)){4})\z", 1)
    word = lambda k: F.lower(F.hex(F.shiftright(_ipv4(tail), k).bitwiseAND(F.lit(0xFFFF))))
    plain = F.when(tail == "", text).otherwise(F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(tail)), word(16), F.lit(":"), word(0)))

    def short(t: Column) -> Column:
        groups = lambda x: F.filter(F.split(x, ":", -1), lambda g: g != "")
        front, back = groups(F.substring_index(t, "::", 1)), F.when(t.contains("::"), groups(F.substring_index(t, "::", -1))).otherwise(F.array())
        n = F.size(front) + F.size(back)
        well = t.rlike(r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?\z") & F.when(t.contains("::"), n <= 7).otherwise(n == 8)
        full = F.concat(front, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), back)
        return F.when(well, F.array_join(F.transform(full, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":"))

    def left_out(t: Column) -> Column:
        run = lambda k: rf"^(.*?)(?<![0-9a-f])(?:^|:)?0(?::0){{{k - 1}}}(?![0-9a-f]):?(.*)\z"
        out = t
        for k in range(2, 9):
            out = F.when(t.rlike(run(k)), F.regexp_replace(t, run(k), "$1::$2")).otherwise(out)
        return F.concat(F.lit("["), F.regexp_replace(out, ":::+", "::"), F.lit("]"))

    return _bound(_bound(plain, short), left_out)


def host_name(host: Column) -> Column:
    """A host as URLs have it: names in lower case, escapes decoded, labels beyond ASCII in Punycode; numbers as IPv4 addresses with four parts; IPv6 addresses in brackets
    with the first longest run of zeros left out. Null for what is no host. Of Unicode's compatible forms only full-width signs and other dots are unified, and decomposed
    letters are not composed."""

    def name(h: Column) -> Column:
        labels = F.transform(F.split(h, r"\.", -1), lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("xn--"), punycode(x))).otherwise(x))
        ascii_ = F.when(h.rlike(r"[^\x00-\x7F]"), F.array_join(labels, ".")).otherwise(h)
        checked = F.when((h != "") & ~h.rlike(_FORBIDDEN), ascii_)
        return F.when(h.rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?\z"), _dotted(_ipv4(h))).otherwise(checked)

    decoded = F.when(host.contains("%"), F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B")))).otherwise(host)
    wide = F.translate(F.regexp_replace(F.regexp_replace(decoded, _IGNORED, ""), _DOTS, "."), "".join(_NARROW), "".join(_NARROW.values()))
    mapped = F.lower(F.when(decoded.rlike(r"[^\x00-\x7F]"), wide).otherwise(decoded))
    return F.when(host.startswith("["), _ipv6(F.lower(F.regexp_extract(host, r"^\[(.*)\]\z", 1)))).otherwise(_bound(mapped, name))


def _parameters(query: Column) -> Column:
    """Parameters sorted by name, those of one name as they stand, encoded as forms are. An escape without two digits is a percent sign."""
    decoded = lambda x: F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))
    value = lambda x: F.when(F.contains(x, F.lit("=")), F.substr(x, F.locate("=", x) + 1, F.length(x))).otherwise("")
    named = lambda x, i: F.struct(decoded(F.substring_index(x, "=", 1)).alias("name"), i.alias("i"), decoded(value(x)).alias("value"))
    pairs = F.array_sort(F.transform(F.filter(F.split(query, "&", -1), lambda x: x != ""), named))
    return F.array_join(F.transform(pairs, lambda x: F.concat(F.url_encode(x["name"]), F.lit("="), F.url_encode(x["value"]))), "&")


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case without user and default port, the host as ``host_name`` has it, path without dot segments and without one slash at its end, parameters
    sorted by name and encoded as forms are, no fragment. Anything but a URL of http(s) is trimmed and put in lower case. Each step is evaluated once a row."""
    text = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")

    def parts(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, _URL, i)
        path = _bound(F.replace(part(3), F.lit("\\"), F.lit("/")), lambda p: F.regexp_replace(_escaped(_without_dots(p)), r"/\z", ""))
        fields = F.struct(F.lower(part(1)).alias("scheme"), F.regexp_replace(part(2), "^(?s:.*)@", "").alias("whole"), path.alias("path"), _parameters(part(4)).alias("query"))
        return F.when(t.rlike(_URL), _bound(fields, joined))

    def joined(u: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(u["whole"], _HOST, 2), "^0+(?=[0-9])", "")
        host = F.when(u["whole"].rlike(_HOST), host_name(F.regexp_extract(u["whole"], _HOST, 1)))
        query = F.when(u["query"] == "", "").otherwise(F.concat(F.lit("?"), u["query"]))
        own = F.when(u["scheme"] == "http", "80").otherwise("443")
        port = lambda n: F.when((n == "") | (n == own), "").when(n.try_cast("long") <= 65535, F.concat(F.lit(":"), n))
        return F.concat(u["scheme"], F.lit("://"), host, _bound(number, port), u["path"], query)

    return F.coalesce(_bound(text, parts), F.lower(F.regexp_replace(url, f"^{js.WS}+|{js.WS}+\\z", "")))
