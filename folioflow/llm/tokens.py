"""Exact, memoised encoding with the public tokenizers files.

Both tokenizers split a text into words before they merge, and no merge crosses a word. A text is therefore cut at places that are
word limits for the tokenizer whatever stands around them, each piece is encoded once by the ``tokenizers`` library, and its ids are
kept in a bounded memo of the worker. The ids of a text are the joined ids of its pieces, equal to those of one call on the whole text.
Texts are cut and equal pieces found by Arrow, some megabytes of texts at once; only different pieces are looked up, and numpy gathers the ids.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers before it starts anew (about 250 bytes each), and the longest piece it remembers.
MEMO_PIECES, MEMO_LENGTH = 700_000, 48

#: White space other than the space and the line feed.
_RARE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Texts whose white space is more than single spaces and line feeds between words (for Arrow).
_UNEVEN = r"^[ \n]|[ \n]$|  |\n\n| \n|\n |[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bytes of text that are encoded at once, one text at least.
SLICE_BYTES = 8 << 20
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


#: The printable stand-ins of bytes in byte-level vocabularies (a fixed rule: printable Latin-1 bytes stand for themselves, others from 256 on).
_SELF = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = iter(range(256, 512))
_BYTE_SIGNS = [chr(b if b in _SELF else next(_OTHERS)) for b in range(256)]


class _Memo(dict):
    """Ids by piece."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def _plain(piece: str) -> bool:
    """Whether ``piece`` is of letters of Latin-1 only, about which no two versions of Unicode differ and which lower-casing and composing leave single."""
    return piece.isalpha() and (piece.isascii() or max(piece) <= "\xff")


class Encoder:
    """Encodes texts to little-endian ids of ``width`` bytes, as the library does by default: strings of special tokens in a text are those tokens. Null
    texts count as empty."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.width = 2 if self.vocab_size <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        # A byte-level pre-tokenizer hangs a space on the word after it; one that lower-cases and splits drops white space.
        self.keeps_space = self.tokenizer.normalizer is None
        self.model = self.tokenizer.model
        self.packers = [struct.Struct(f"<{n}{'H' if self.width == 2 else 'I'}").pack for n in range(64)]
        self.firsts = _Memo(self._first)
        self.rest = _Memo(self._after_space if self.keeps_space else self._lower)

    def _packed(self, ids: list[int]) -> bytes:
        return self.packers[len(ids)](*ids) if len(ids) < 64 else np.array(ids, self.dtype).tobytes()

    def _encode(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str, space: str = "") -> bytes:
        """One word of Latin letters, behind a space or not: the splitter would leave it whole, so the library's merging model takes it at once."""
        signs = word if word.isascii() else "".join([_BYTE_SIGNS[b] for b in word.encode()])
        return self._packed([t.id for t in self.model.tokenize(space + signs)])

    def _first(self, piece: str) -> bytes:
        return self._word(piece) if _plain(piece) else self._encode(piece)

    def _after_space(self, piece: str) -> bytes:
        if _plain(piece):
            return self._word(piece, _BYTE_SIGNS[32])
        if piece[:1] == "\n":
            # A line feed is a token of its own before anything but white space.
            return self.firsts["\n"] + self.firsts[piece[1:]] if _plain(piece[1:]) else self._encode(piece)
        head = piece[:-1]
        if piece[-1:] in (".", ",") and _plain(head):
            return self.rest[head] + self.firsts[piece[-1]]
        return self._encode(" " + piece)

    def _lower(self, piece: str) -> bytes:
        if _plain(piece):
            low = piece.lower()
            return self._word(low) if low == piece else self.rest[low]
        head = piece[:-1]
        # Other letters may become several signs in lower case, of which the last joins the mark behind it.
        return self.rest[head] + self.rest[piece[-1]] if piece[-1:] in (".", ",") and _plain(head) else self._encode(piece)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.keeps_space:
            return b"".join(map(self.rest.__getitem__, text.replace("\n", " ").split(" ")))
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _RARE.search(text):
            # Cut only before a lone space with words on both sides.
            first, *rest = _LONE_SPACE.split(text)
        else:
            # White space is single spaces and line feeds: cut before each of them.
            first, *rest = text.replace("\n", " \n").split(" ")
        return self.firsts[first] + b"".join(map(self.rest.__getitem__, rest))

    def encode_column(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` (strings, null as empty), each followed by ``end``, and where each text's ids begin and end: n + 1 places."""
        n = len(texts)
        texts = pc.fill_null(texts, "")
        uneven = np.zeros(0, np.int64)
        if self.keeps_space:
            odd = pc.match_substring_regex(texts, _UNEVEN)
            uneven = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            words = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        else:
            words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
        flat = words.flatten()
        found = flat.dictionary_encode()
        at = found.indices.to_numpy().astype(np.int32)
        pieces = list(map(self.rest.__getitem__, found.dictionary.to_pylist()))
        if self.keeps_space and n:
            firsts = np.append(0, ends[:-1])
            at[firsts] = np.arange(len(pieces), len(pieces) + n)
            heads = list(map(self.firsts.__getitem__, flat.take(pa.array(firsts)).to_pylist()))
            for i in uneven.tolist():
                heads[i] = self.encode(texts[i].as_py())
            pieces += heads
        if end is not None:
            at = np.insert(at, ends, len(pieces))
            ends = ends + np.arange(1, n + 1)
            pieces.append(self._packed([end]))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.width
        ids = np.frombuffer(b"".join(pieces), self.dtype)
        counts = sizes[at]
        after = np.cumsum(counts)
        total = int(after[-1]) if len(after) else 0
        place = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
        moved = ((np.cumsum(sizes) - sizes)[at] - (after - counts)).astype(place)
        return ids[np.repeat(moved, counts) + np.arange(total, dtype=place)], np.append(0, np.append(0, after)[ends])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; kept over tasks, as building it takes about a tenth of a second."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc_u32(ids: np.ndarray | bytes, dtype: np.dtype | None = None) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    a = np.frombuffer(ids, dtype) if isinstance(ids, (bytes, memoryview)) else ids
    return zlib.crc32(a.astype("<u4").tobytes())


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded_batches(batches: Iterable, path: str, end: int):
    """Of record batches (doc_id, text), in slices: doc_ids, the ids of all texts with the end id behind each, and their n + 1 limits."""
    enc = encoder(path)
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            part = b.slice(at, to - at)
            yield part.column(0), *enc.encode_column(part.column(1), end)
            at = to
