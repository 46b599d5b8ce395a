"""Alignment of two tokenizers against whole texts and plain loops."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from folioflow.llm import alignment, tokens

A, B = tokens.public_path("byte_bpe_50k.json"), tokens.public_path("piece_bpe_32k.model")
PARTS = ["river", "stone", "Übermut", "naïve", "it's", "'s", "12", "3,5", ".", "..", ",", " ", "  ", "\n", "\n\n", " \n", "\t", "\xa0", "\x85", "\x1c", " ", "中文", "😀", "é", "́", "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "the", "The", "x" * 40, "\x00", "ﬁ", "​", "▂"]
ODD = [None, "", " ", "\n", "a", "  lead", "trail ", "two  spaces", "a▁b", "one\ntwo", "\none", "one\n", "x" * 3000, "<|endoftext|> and <s> stay", "é 中 😀\n😀", "tab\there"]


@pytest.fixture(scope="module")
def plain():
    """Tokens of whole texts by the libraries: ids and bytes of A and of B, or None."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: i for i, c in enumerate(tokens._BYTE_SIGNS)}

    def of_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    def encode(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a, bytes_b = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a], [of_b(i) for i in ids_b]
        return (ids_a, ids_b, bytes_a, bytes_b) if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode() else None

    return encode


def aligned(found):
    """Groups as text and links, by byte ranges."""
    ids_a, ids_b, bytes_a, bytes_b = found

    def ranges(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    of_a, of_b = ranges(bytes_a), ranges(bytes_b)
    cuts = sorted({e for _, e in of_a} & {e for _, e in of_b})
    groups = [",".join(str(i) for i, (s, e) in zip(ids_a, of_a) if low <= s and e <= high) + "|" + ",".join(str(i) for i, (s, e) in zip(ids_b, of_b) if low <= s and e <= high) for low, high in zip([0, *cuts], cuts)]
    links = [(i, j) for i, (s, e) in zip(ids_a, of_a) for j, (t, f) in zip(ids_b, of_b) if s < f and t < e]
    return ";".join(groups), links


def random_texts(n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(1, longest))) for _ in range(n)] + [" ".join("".join(rng.choices(PARTS, k=rng.randint(1, 2))) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_pieces_equal_whole_texts(plain):
    tool = alignment.Aligner(A, B)
    texts = [*ODD, *random_texts(1500, 12, 3)]
    for text, got in zip(texts, tool.align(texts), strict=True):
        want = plain(text)
        assert (want is None) == (got is None), text
        if want:
            groups, links = aligned(want)
            assert got.groups == groups and (got.n_a, got.n_b, got.n_groups) == (len(want[0]), len(want[1]), groups.count(";") + 1), text
            assert sorted(divmod(int.from_bytes(got.links[i : i + 4], "little"), 1 << 16) for i in range(0, len(got.links), 4)) == sorted(links), text


def test_signs_and_groups():
    spell = lambda sizes, end: [alignment.token_signs(n, end) for n in sizes]
    signs = alignment.label_string(spell([2, 3, 1], alignment.A_END), spell([1, 4, 1], alignment.B_END))
    assert signs == b"ba``cc" and alignment.group_sizes(signs) == [(2, 2), (1, 1)]
    assert [divmod(int(x), 1 << 16) for x in alignment.group_links(signs, np.array([7, 8, 9]), np.array([1, 2, 3]))] == [(7, 1), (7, 2), (8, 2), (9, 3)]
    assert alignment.label_string([], []) == b"" and alignment.group_sizes(b"") == []


@pytest.mark.parametrize("size", [40, 8 << 20])
def test_alignment_by_brute_force(spark, plain, monkeypatch, size):
    monkeypatch.setattr(alignment, "CHUNK_SIGNS", size)
    texts = [*ODD, *random_texts(40, 8, 4), *ODD[4:8], "same text\nagain", "same text\nagain"]
    ids = [None if i in (2, 5) else i // 2 * 2 if i % 9 == 3 else i for i in range(len(texts))]
    rows = spark.createDataFrame([(i, t, -1, "x") for i, t in zip(ids, texts)], "doc_id long, text string, pair int, chunk string").repartition(3)
    each = [plain(t) for t in texts]
    found = [aligned(e) if e else None for e in each]
    count = Counter(p for f in found if f for p in set(f[1]))
    most = Counter()
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    want = []
    for i, e, f in zip(ids, each, found):
        if f:
            groups, links = f
            want.append((i, len(e[0]), len(e[1]), groups.count(";") + 1, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest()))
        else:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
    got = [tuple(r) for r in alignment.align_documents(rows, A, B).collect()]
    assert Counter(got) == Counter(want)


def test_alignment_of_nothing(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    [row] = alignment.align_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()
    assert row.n_a == row.n_links == row.count_sum == 0 and row.groups_sha256 == ""
